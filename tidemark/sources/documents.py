"""Files: declared schemas, strict JSON documents, alias and override files, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import trailing_id


def scan(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


CATALOG_DOC = """id string, name string, serie struct<id string, name string>, releaseDate string,
    cardCount struct<official int, total int>, cards array<struct<id string, localId string, name string>>"""


def catalog_documents(spark: SparkSession, path: str, expected: int, digital_serie: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups and members of one JSON document for each group. Fewer documents than the manifest says, or one
    without its required fields, is an error; more is fine."""
    docs = spark.read.schema(CATALOG_DOC).option("multiLine", True).option("mode", "FAILFAST").json(path)
    missing = docs.filter("id is null or name is null or cards is null")
    if not missing.isEmpty():
        raise ValueError("a catalog document lacks a required field")
    if (n := docs.count()) < expected:
        raise ValueError(f"{n} catalog documents, but the manifest lists {expected}")
    physical = F.lit(True) if digital_serie is None else ~F.col("serie.id").eqNullSafe(F.lit(digital_serie))
    groups = docs.select(F.col("id").alias("group_id"), "name", F.col("serie.name").alias("series"), F.to_date("releaseDate").alias("released_on"), F.col("cardCount.official").alias("official"), physical.alias("physical"))
    members = docs.select(F.col("id").alias("group_id"), F.explode("cards").alias("c")).select("group_id", F.col("c.id").alias("member_id"), F.col("c.localId").alias("local_id"), F.col("c.name").alias("name"))
    return groups, members


SPECIES_DOC = """id int, name string, names array<struct<language struct<name string>, name string>>, generation struct<name string>,
    color struct<name string>, habitat struct<name string>, evolves_from_species struct<url string>, egg_groups array<struct<name string>>,
    evolution_chain struct<url string>, varieties array<struct<is_default boolean, {entity} struct<url string>>>"""
TYPE_DOC = "id int, types array<struct<slot int, type struct<name string>>>"


def species_documents(spark: SparkSession, species_path: str, types_path: str, entity: str) -> DataFrame:
    """Species joined to the types of their default variety by the ids that end URLs, ordered arrays kept so.
    ``entity`` is the field of a variety that holds the URL of its document."""
    read = lambda schema, path: spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    s = read(SPECIES_DOC.format(entity=entity), species_path)
    default = F.filter("varieties", lambda v: v["is_default"])[0][entity]["url"]
    types = read(TYPE_DOC, types_path).select(F.col("id").alias("__variety"), F.transform(F.array_sort("types"), lambda t: t["type"]["name"]).alias("types"))
    s = s.withColumn("__variety", trailing_id(default).cast("int")).join(types, "__variety", "left")
    english = F.filter("names", lambda n: n["language"]["name"] == "en")[0]["name"]
    return s.select(
        "id", F.col("name").alias("slug"), english.alias("name"), F.col("generation.name").alias("generation"), F.col("color.name").alias("color"), F.col("habitat.name").alias("habitat"),
        trailing_id(F.col("evolves_from_species.url"), strict=False).cast("int").alias("evolves_from"), trailing_id(F.col("evolution_chain.url"), strict=False).cast("int").alias("chain_id"),
        F.array_sort(F.transform("egg_groups", lambda g: g["name"])).alias("egg_groups"), "types",
        F.map_from_entries(F.transform("names", lambda n: F.struct(n["language"]["name"], n["name"]))).alias("names"),
    )


def alias_file(spark: SparkSession, path: str) -> DataFrame:
    """``slug, targets, reason`` of an array of objects; empty fields and slugs that repeat are errors."""
    rows = spark.read.schema("slug string, targets array<string>, reason string").option("multiLine", True).option("mode", "FAILFAST").json(path)
    bad = rows.filter("coalesce(trim(slug), '') = '' or coalesce(size(targets), 0) < 1 or coalesce(trim(reason), '') = ''")
    again = rows.groupBy("slug").count().filter("count > 1")
    if not bad.isEmpty() or not again.isEmpty():
        raise ValueError("an alias is empty or repeats")
    return rows


def object_map_file(spark: SparkSession, path: str) -> DataFrame:
    """``key, value`` of one JSON object. The object is read as text, as parsed maps drop keys that repeat."""
    text = spark.read.option("wholetext", True).text(path)
    pairs = text.select(F.explode(F.expr(r"""regexp_extract_all(value, '"((?:[^"\\\\]|\\\\.)*)"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)"', 0)""")).alias("p"))
    rows = pairs.select(F.expr(r"""regexp_extract(p, '^"((?:[^"\\\\]|\\\\.)*)"', 1)""").alias("key"), F.expr(r"""regexp_extract(p, ':\\s*"((?:[^"\\\\]|\\\\.)*)"$', 1)""").alias("value"))
    if rows.isEmpty() or not rows.groupBy("key").count().filter("count > 1").isEmpty() or not rows.filter("trim(key) = '' or trim(value) = ''").isEmpty():
        raise ValueError("the map is empty, or a key repeats or is empty")
    return rows


def exclusion_file(spark: SparkSession, path: str) -> DataFrame:
    """``slug`` of a JSON document with one list, whatever the case of its name."""
    doc = spark.read.option("wholetext", True).text(path).select(F.from_json(F.regexp_replace("value", '(?i)"slugs"', '"slugs"'), "slugs array<string>", {"mode": "FAILFAST"}).alias("d"))
    return doc.select(F.explode("d.slugs").alias("slug")).distinct()


def quoted_csv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path)


def to_fetch(listed: DataFrame, held: DataFrame, key: str, content: str) -> DataFrame:
    """Listed keys that aren't held, and held ones without content."""
    lacking = held.filter(F.coalesce(F.size(content), F.lit(0)) < 1).select(key)
    return listed.select(key).join(held.select(key), key, "left_anti").union(lacking)


def tree_depths(spark: SparkSession, trees: DataFrame, tree_id: str, document: str) -> DataFrame:
    """``tree_id, node_id, depth`` of every node of nested JSON trees ``{species: {url}, evolves_to: [...]}``."""
    return spark.sql(
        """
        WITH RECURSIVE nodes(tree, node, depth) AS (
            SELECT tree, parse_json(document), 1 FROM {trees}
            UNION ALL
            SELECT n.tree, c.value, n.depth + 1 FROM nodes n, LATERAL variant_explode(variant_get(n.node, '$.evolves_to')) c)
        SELECT tree, CAST(regexp_extract(variant_get(node, '$.species.url', 'string'), '([0-9]+)/?$', 1) AS BIGINT) AS node_id, depth FROM nodes
        """,
        trees=trees.select(F.col(tree_id).alias("tree"), F.col(document).alias("document")),
    ).withColumnRenamed("tree", tree_id)


def species_rows(species: DataFrame, variants: DataFrame, chains: DataFrame, entity: str) -> DataFrame:
    """Species out of three tables of JSON documents (one column ``document`` each), joined by the ids that end URLs.

    * ``species``: as ``SPECIES_DOC`` with ``is_legendary`` and ``is_mythical``; ``variants``: ``TYPE_DOC``; ``chains``:
      ``{id, chain: {species: {url}, evolves_to: [...]}}``, nested to any depth.
    * The default variety gives the types, in the order of slots; the chain gives the stage, 1 at its root. Both are
      looked up by id, so a chain of thousands and a chain of one cost the same join.
    * ``status`` is mythical before legendary before ordinary.
    * ``drift`` says what is wrong: not JSON, a required field that lacks, no or more than one default variety, a variant or
      chain that isn't there, or a chain that doesn't name the species. Such rows keep their id and have no facts.
    """
    schema = SPECIES_DOC.format(entity=entity) + ", is_legendary boolean, is_mythical boolean"
    s = species.select("document", F.from_json("document", schema).alias("s")).select("document", "s.*")
    default = F.filter("varieties", lambda v: F.coalesce(v["is_default"], F.lit(False)))
    url = F.when(F.size(default) == 1, F.get(default, F.lit(0))[entity]["url"])
    chain_id = trailing_id(F.col("evolution_chain.url"), strict=False).cast("int")
    s = s.withColumns({"__variety": trailing_id(url, strict=False).cast("int"), "chain_id": chain_id})
    types = variants.select(F.from_json("document", TYPE_DOC).alias("t")).select(F.col("t.id").alias("__variety"), F.transform(F.array_sort("t.types"), lambda t: t["type"]["name"]).alias("types"))
    trees = chains.select(F.from_json("document", "id int, chain string").alias("c")).select("c.*").filter("chain is not null")
    stages = tree_depths(species.sparkSession, trees, "id", "chain").groupBy(F.col("id").alias("chain_id"), F.col("node_id").cast("int").alias("id")).agg(F.min("depth").alias("stage"))
    held = trees.select(F.col("id").alias("chain_id"), F.lit(True).alias("__chain")).distinct()
    s = s.join(types, "__variety", "left").join(held, "chain_id", "left").join(stages, ["chain_id", "id"], "left")
    english = F.get(F.filter("names", lambda n: n["language"]["name"] == "en"), F.lit(0))["name"]
    lacks = [F.when(F.col(c).isNull(), c) for c in ("id", "name", "names", "generation", "color", "egg_groups", "evolution_chain", "varieties", "is_legendary", "is_mythical")]
    missing = F.array_compact(F.array(*lacks, F.when(F.col("names").isNotNull() & english.isNull(), "english name")))
    drift = (
        F.when(F.size(missing) == len(lacks), "not a species document").when(F.size(missing) > 0, F.concat(F.lit("lacks "), F.array_join(missing, ","))).when(F.size(default) != 1, "not one default variety")
        .when(F.col("types").isNull(), "no such variant").when(F.col("__chain").isNull(), "no such chain").when(F.col("stage").isNull(), "not in its chain")
    )
    status = F.when(F.col("is_mythical"), "mythical").when(F.col("is_legendary"), "legendary").otherwise("ordinary")
    facts = {
        "slug": F.col("name"), "name": english, "generation": F.col("generation.name"), "color": F.initcap("color.name"), "habitat": F.initcap("habitat.name"), "status": status, "stage": F.col("stage"),
        "evolves_from": trailing_id(F.col("evolves_from_species.url"), strict=False).cast("int"), "types": F.col("types"), "egg_groups": F.transform("egg_groups", lambda g: g["name"]),
        "names": F.map_from_entries(F.transform(F.array_sort(F.transform("names", lambda n: F.struct(n["language"]["name"].alias("language"), n["name"].alias("name")))), lambda n: F.struct(n["language"], n["name"]))),
    }
    s = s.withColumn("drift", drift)
    return s.select("id", *[F.when(F.col("drift").isNull(), c).alias(k) for k, c in facts.items()], "drift")
