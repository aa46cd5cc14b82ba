"""Two-phase entity resolution with explicit verdicts: groups first, then their members.

Reference catalogs are tables. Lookups are equi-joins whose hits are counted, so that
two candidates are never a guess; Spark broadcasts them while they are small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import alpha_prefix, canonical_number, comparable_name, group_name, name_fold, name_parts


def unique_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value`` of the keys that have exactly one row."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min(value).alias(value)).filter("__n = 1").drop("__n")


def dangling_aliases(aliases: DataFrame, catalog: DataFrame) -> DataFrame:
    """Alias targets ``(slug, target)`` that the catalog of physical groups doesn't hold."""
    return aliases.select("slug", F.explode("targets").alias("target")).join(catalog.filter("physical").select(F.col("group_id").alias("target")), "target", "left_anti")


@dataclass(frozen=True)
class AliasShelf:
    """A shelf whose groups are found in a catalog of their own, by alias only: a hit or an honest miss, never a name."""

    name: str
    catalog: DataFrame
    aliases: DataFrame


def _refuse_dangling(aliases: DataFrame, catalog: DataFrame, what: str) -> None:
    if bad := dangling_aliases(aliases, catalog).limit(5).collect():
        raise ValueError(f"{what} name groups that the catalog lacks: {[(r['slug'], r['target']) for r in bad]}")


def resolve_groups(groups: DataFrame, catalog: DataFrame, aliases: DataFrame, shelf: Column, promo_slug: str, franchise: str, open_shelf: str = "main", alias_only: AliasShelf | None = None) -> DataFrame:
    """``slug, shelf, kind, target_ids``: the shelf's wall, the promo pool, an alias, a unique name, or unmapped.

    ``groups(slug, name)``, ``catalog(group_id, name, physical)``, ``aliases(slug, targets)``. A dangling alias is an error.
    Groups of the ``alias_only`` shelf are mapped by its aliases into its catalog and by nothing else; without it they are
    walled like those of any other shelf."""
    _refuse_dangling(aliases, catalog, "aliases")
    names = unique_by(catalog.filter("physical").select("group_id", group_name(F.col("name"), franchise).alias("__name")), "__name", "group_id")
    g = groups.select("slug", "name", shelf.alias("shelf"), group_name(F.col("name"), franchise).alias("__name"))
    g = g.join(aliases.select("slug", "targets"), "slug", "left").join(names, "__name", "left")
    walled, promo = F.col("shelf") != open_shelf, F.col("slug") == promo_slug
    found = F.when(~walled, F.coalesce("targets", F.when(F.col("group_id").isNotNull(), F.array("group_id"))))
    if alias_only is not None:
        _refuse_dangling(alias_only.aliases, alias_only.catalog, f"aliases of {alias_only.name}")
        g = g.join(alias_only.aliases.select("slug", F.col("targets").alias("__own")), "slug", "left")
        found = F.when(F.col("shelf") == alias_only.name, F.col("__own")).otherwise(found)
    kind = F.when(~walled & promo, "promo_pool").when(found.isNotNull(), "mapped").otherwise("unmapped")
    return g.select("slug", "shelf", kind.alias("kind"), F.coalesce(F.when(kind == "mapped", found), F.array().cast("array<string>")).alias("target_ids"))


def sibling_groups(catalog: DataFrame, suffixes: dict[str, str]) -> DataFrame:
    """``group_id, prefix, sibling_id``: the one group whose name is the parent's plus the suffix of a number prefix."""
    folded = catalog.filter("physical").select("group_id", name_fold(F.col("name")).alias("__name"))
    unique = unique_by(folded, "__name", "group_id").select(F.col("__name").alias("__sibling"), F.col("group_id").alias("sibling_id"))
    table = F.explode(F.create_map(*[F.lit(x) for pair in suffixes.items() for x in pair])).alias("prefix", "__suffix")
    parents = folded.select("group_id", "__name", table)
    return parents.withColumn("__sibling", F.concat_ws(" ", "__name", "__suffix")).join(unique, "__sibling").select("group_id", "prefix", "sibling_id")


def promo_groups(catalog: DataFrame, ending: str) -> DataFrame:
    """``prefix, group_id`` of groups named ``<PREFIX> <ending>``, if only one is."""
    folded = catalog.filter("physical").select("group_id", name_fold(F.col("name")).alias("__name"))
    promos = folded.filter(F.col("__name").endswith(f" {ending}")).select("group_id", F.regexp_replace("__name", f" {ending}$", "").alias("prefix"))
    return unique_by(promos, "prefix", "group_id")


def _few(df: DataFrame, *columns: str, most: int = 1_000) -> list[tuple]:
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows of {columns}")
    return sorted(tuple(r) for r in rows)


VERDICT = ["status", "number", "official", "group_id", "member_id", "name"]


def _evidence(out: DataFrame, key: str) -> DataFrame:
    """The verdict's columns: the agreeing hit of a confirmed one, the first hit of a mismatch, else nulls."""
    confirmed = F.col("status") == "confirmed"
    hit = F.when(confirmed, F.col("good")).when(F.col("status") == "name_mismatch", F.col("first"))
    return out.select(key, "status", F.when(confirmed, F.col("good.local_id")).alias("number"), F.when(confirmed, F.nullif(F.col("good.official"), F.lit(0))).alias("official"), hit["group_id"].alias("group_id"), hit["member_id"].alias("member_id"), hit["ref_name"].alias("name"))


def match_members(members: DataFrame, mapping: DataFrame, catalog_members: DataFrame, catalog: DataFrame, siblings: DataFrame, promos: DataFrame, synonyms: dict[str, str], key: str = "id") -> DataFrame:
    """A verdict for each member: ``key, status, number, official, group_id, member_id, name``.

    ``members(key, slug, name)``; ``catalog_members(group_id, member_id, local_id, name)``. Routed groups (siblings and
    promos that the number's prefix names) are tried first, then the mapped ones; within the first of both that holds
    the number, one agreeing name confirms, several are ambiguous, none is a mismatch with the first hit as evidence.

    One pass over the members: a group's siblings are gathered beside it, so a member meets its group once, unfolds its
    routes, meets the catalog by group and number, and is judged in one aggregation. Promo groups are few, and refused
    if they are not."""
    few = _few(promos, "prefix", "group_id")
    promo_of = F.create_map(*[F.lit(x) for pair in few for x in pair]) if few else F.lit(None).cast("map<string,string>")
    targets = mapping.select("slug", "kind", F.posexplode_outer("target_ids").alias("pos", "group_id"))
    beside = siblings.groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("prefix", "sibling_id"))).alias("siblings"))
    routes = targets.join(beside, "group_id", "left").groupBy("slug").agg(F.first("kind").alias("kind"), F.collect_list(F.when(F.col("group_id").isNotNull(), F.struct("pos", "group_id", "siblings"))).alias("targets"))
    parts = name_parts(F.col("name"))
    m = members.join(routes, "slug", "left").select(key, F.coalesce("kind", F.lit("unmapped")).alias("kind"), "targets", parts["number"].alias("member_number"), comparable_name(parts["base"], synonyms).alias("__base"))
    m = m.withColumn("prefix", alpha_prefix(F.col("member_number"))).withColumn("__canonical", canonical_number(F.col("member_number")))
    route = lambda tier, ord_, group: F.struct(F.lit(tier).alias("tier"), ord_.cast("int").alias("ord"), group.alias("group_id"))
    promo = promo_of[F.col("prefix")]
    mapped = F.concat(
        F.transform("targets", lambda t: route(0, t["pos"] * 2, t["siblings"][F.col("prefix")])),
        F.transform("targets", lambda t: route(0, t["pos"] * 2 + 1, promo)),
        F.transform("targets", lambda t: route(1, t["pos"] * 2, t["group_id"])),
    )
    # A bare number may be any era's.
    every = F.array(*[route(0, F.lit(0), F.lit(g)) for g in sorted({g for _, g in few})]) if few else F.array().cast("array<struct<tier:int,ord:int,group_id:string>>")
    pool = F.when(F.col("prefix") == "", every).otherwise(F.array(route(0, F.lit(0), promo)))
    chosen = F.when(F.col("member_number").isNull(), F.lit(None)).when(F.col("kind") == "mapped", mapped).when(F.col("kind") == "promo_pool", pool)
    m = m.withColumn("route", F.explode_outer(F.filter(chosen, lambda r: r["group_id"].isNotNull()))).select(key, "kind", "member_number", "__canonical", "__base", "route.*")
    refs = catalog_members.select("group_id", "member_id", "local_id", F.col("name").alias("ref_name"), canonical_number(F.col("local_id")).alias("__canonical"), comparable_name(F.col("name"), synonyms).alias("__ref"))
    refs = refs.join(catalog.select("group_id", "official"), "group_id")
    hits = m.join(refs, ["group_id", "__canonical"], "left")
    found = F.col("member_id").isNotNull()
    row = F.struct("ord", "group_id", "member_id", "local_id", "ref_name", "official")
    agrees = found & (F.col("__base") == F.col("__ref"))
    tier = lambda t: F.struct(F.count_if(agrees & (F.col("tier") == t)).alias("agreeing"), F.min(F.when(agrees & (F.col("tier") == t), row)).alias("good"), F.min(F.when(found & (F.col("tier") == t), row)).alias("first"))
    out = hits.groupBy(key).agg(F.first("kind").alias("kind"), F.first("member_number").alias("member_number"), tier(0).alias("t0"), tier(1).alias("t1"))
    best = F.when(F.col("t0.first").isNotNull(), F.col("t0")).otherwise(F.col("t1"))
    out = out.select(key, "kind", "member_number", best["agreeing"].alias("agreeing"), best["good"].alias("good"), best["first"].alias("first"))
    status = (
        F.when(F.col("member_number").isNull(), "no_number")
        .when(F.col("kind") == "unmapped", "unmapped_set")
        .when(F.col("first").isNull(), "number_not_found")
        .when(F.col("agreeing") == 1, "confirmed")
        .when(F.col("agreeing") > 1, "ambiguous")
        .otherwise("name_mismatch")
    )
    return _evidence(out.withColumn("status", status), key)


def match_across_scripts(members: DataFrame, mapping: DataFrame, catalog_members: DataFrame, catalog: DataFrame, tags: DataFrame, ref_tags: DataFrame, key: str = "id") -> DataFrame:
    """Number matches guarded by shared tags instead of names, for groups of another catalog: the same columns as
    ``match_members``.

    ``tags(key, ids)`` and ``ref_tags(member_id, ids)`` are arrays of entity ids. A member without tags, or whose hits all
    name no entity, has nobody to vouch for it (``no_guard``); one agreeing hit confirms, several are ambiguous, and where
    some hit names another entity the first one, in the order of the mapping, is evidence of a mismatch.

    References of one group and number, which grow with the catalog, are first brought down to how many there are and the
    first of them, over all and for each tag. So a member meets one row for each of its groups and tags, not all hits, and
    whether one agrees or several is read from the counts and from the least and the greatest of what it met."""
    number = name_parts(F.col("name"))["number"]
    targets = F.when(F.col("kind") == "mapped", F.col("target_ids"))
    m = members.join(mapping, "slug", "left").select(key, F.coalesce("kind", F.lit("unmapped")).alias("kind"), number.alias("member_number"), targets.alias("targets"), canonical_number(number).alias("__canonical"))
    m = m.select(key, "kind", "member_number", "__canonical", F.posexplode_outer("targets").alias("ord", "group_id"))
    refs = catalog_members.select("group_id", "member_id", "local_id", F.col("name").alias("ref_name"), canonical_number(F.col("local_id")).alias("__canonical"))
    refs = refs.join(ref_tags.withColumnRenamed("ids", "__ref_ids"), "member_id", "left").join(catalog.select("group_id", "official"), "group_id")
    # Once for the number and once for each tag; null stands for the number alone.
    kind = tags.schema["ids"].dataType
    whole = lambda c: F.array_compact(F.array_distinct(F.coalesce(c, F.array().cast(kind))))
    unfold = lambda c: F.explode(F.concat(F.array(F.lit(None).cast(kind.elementType)), whole(c)))
    ref = F.struct("group_id", "member_id", "local_id", "ref_name", "official", "__ref_ids")
    refs = refs.select("group_id", "__canonical", unfold(F.col("__ref_ids")).alias("__tag"), ref.alias("ref")).groupBy("group_id", "__canonical", "__tag")
    refs = refs.agg(F.count(F.lit(1)).alias("n"), F.min("ref").alias("ref"), F.max(F.size("ref.__ref_ids") > 0).alias("named"))
    m = m.join(tags.withColumnRenamed("ids", "__ids"), key, "left").withColumn("tagged", F.coalesce(F.size("__ids") > 0, F.lit(False)))
    m = m.select("*", unfold(F.col("__ids")).alias("__tag")).drop("__ids")
    hits = m.join(refs.withColumnsRenamed({"group_id": "__g", "__canonical": "__c", "__tag": "__t"}), (F.col("group_id") == F.col("__g")) & (F.col("__canonical") == F.col("__c")) & F.col("__tag").eqNullSafe(F.col("__t")), "left")
    row = lambda *more: F.struct("ord", *[F.col(f"ref.{c}").alias(c) for c in ("group_id", "member_id", "local_id", "ref_name", "official", *more)])
    agree, found = F.col("n").isNotNull() & F.col("__tag").isNotNull(), F.col("n").isNotNull() & F.col("__tag").isNull()
    least, most = F.min(F.when(agree, row("__ref_ids"))), F.max(F.when(agree, row("__ref_ids")))
    agreeing = F.when(least.isNull(), 0).when((F.max(F.when(agree, F.col("n"))) == 1) & (least == most), 1).otherwise(2)
    out = hits.groupBy(key).agg(
        F.first("kind").alias("kind"), F.first("member_number").alias("member_number"), agreeing.alias("agreeing"), F.min(F.when(agree, row())).alias("good"), F.min(F.when(found, row())).alias("first"),
        F.max("tagged").alias("tagged"), F.max(F.when(found, F.col("named"))).alias("named"),
    )
    status = (
        F.when(F.col("member_number").isNull(), "no_number").when(F.col("kind") != "mapped", "unmapped_set").when(F.col("first").isNull(), "number_not_found").when(~F.col("tagged"), "no_guard")
        .when(F.col("agreeing") == 1, "confirmed").when(F.col("agreeing") > 1, "ambiguous").when(F.col("named"), "name_mismatch").otherwise("no_guard")
    )
    return _evidence(out.withColumn("status", status), key)


def match_shelves(members: DataFrame, mapping: DataFrame, shelf: str, near: dict, far: dict, key: str = "id") -> DataFrame:
    """Verdicts of all members, each by its group's shelf: those of ``shelf`` across scripts, in their own catalog, all others
    by name. ``near`` and ``far`` are the further arguments of ``match_members`` and ``match_across_scripts``."""
    routed = members.join(mapping.select("slug", "shelf"), "slug", "left")
    there = F.coalesce(F.col("shelf") == shelf, F.lit(False))
    here = match_members(routed.filter(~there).drop("shelf"), mapping, key=key, **near)
    return here.unionByName(match_across_scripts(routed.filter(there).drop("shelf"), mapping, key=key, **far))


def coverage_crosstab(verdicts: DataFrame, shelf: str, status: str, statuses: list[str]) -> DataFrame:
    """Counts of statuses by shelf with a total row (``shelf`` null) and the confirmed share in percent."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in statuses]
    out = verdicts.rollup(shelf).agg(F.count(F.lit(1)).alias("total"), *counts)
    return out.withColumn("confirmed_pct", F.round(F.col(statuses[0]) * 100.0 / F.col("total"), 2))
