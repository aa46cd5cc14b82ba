"""Operators on small tables: idempotence, files, tagging, streams."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import coverage, history, resolve, sync, tagging
from tidemark.sources import documents, pages
from tidemark.streaming import visits


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_change_only_default_zero(spark):
    series = spark.createDataFrame([(1, d, v) for d, v in enumerate([0, 5, 5, 7, 0, 0, 5])], "k int, d int, v int")
    assert rows(history.change_only_history(series, ["k"], "d", "v")) == [(1, 1, 5), (1, 3, 7), (1, 4, 0), (1, 6, 5)]


def test_dedup_append_twice_adds_nothing(spark):
    old = spark.createDataFrame([("a", 1, 0)], "source string, id int, t int")
    new = spark.createDataFrame([("a", 1, 5), ("b", 1, 7), ("b", 1, 6), ("b", 1, 6)], "source string, id int, t int")
    added = history.dedup_append(old, new, ["source", "id"], [F.col("t")])
    assert rows(added) == [("b", 1, 6)]
    assert history.dedup_append(old.union(added), new, ["source", "id"], [F.col("t")]).count() == 0


def test_cut_writes_what_it_removes(spark, tmp_path):
    df = spark.createDataFrame([(1, d) for d in range(10)] + [(2, 3)], "key int, day int")
    cuts = spark.createDataFrame([(1, 4)], "key int, cut_at int")
    assert coverage.execute_cut(df, cuts, "key", "day", str(tmp_path / "undo"), str(tmp_path / "kept")) == (4, 4)
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 7


def test_exclusions_stay_uncut(spark):
    gaps = spark.createDataFrame([(1, 9, 9, 3, 40, 30)], "key int, at int, batch_oldest int, last_known int, rows_written int, page_cap int")
    assert rows(coverage.cut_list(gaps, "key", "at")) == [(1, 9)]
    assert coverage.cut_list(gaps, "key", "at", spark.createDataFrame([(1, 9)], "key int, batch_oldest int")).count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, d int, v int")
    assert history.latest_by_key(empty, ["k"], "d", "v").count() == 0
    assert history.change_only_history(empty, ["k"], "d", "v").count() == 0
    assert sync.scd1_actions(empty, empty, "k", ["v"]).count() == 0


def test_burst_rate_bounds(spark):
    day = lambda n: f"2024-01-{n:02d}"
    e = spark.createDataFrame([(1, "a", day(30), i) for i in range(3)] + [(2, "a", day(30), 1), (2, "a", day(30), 2), (3, "a", "2023-12-31", 1)], "k int, b string, d string, i int").withColumn("d", F.to_date("d"))
    got = dict(rows(coverage.burst_rate(e, "k", "b", "d", F.lit("2024-01-30").cast("date"), ["i"])))
    assert got == {1: 3.0, 2: pytest.approx(2 / 30), 3: 0.0}


def test_dictionary_consumes_longest_first():
    d = tagging.Dictionary([("mew", 1), ("mewtwo", 2), ("mr. mime", 3), ("mr. mime jr.", 4), ("nidoran♀", 5)])
    assert d.tag("mewtwo and mew") == [2, 1]
    assert d.tag("mews mewtwos") == []
    assert d.tag("mew's card") == [1]
    assert d.tag("mr. mime jr. gx") == [4]
    assert d.tag("nidoran♀ x") == [5]
    assert d.tag("nidoran♀♂") == []
    assert tagging.Dictionary([("ピカ", 1)], boundaries=False).tag("xピカチュウ") == [1]


def test_tagging_sweep_is_idempotent(spark):
    titles = spark.createDataFrame([(1, "Mew #1"), (2, "Ditto"), (3, "Mew Mewtwo")], "id int, title string")
    d = tagging.Dictionary([("mew", 7), ("mewtwo", 8)])
    state = spark.createDataFrame([(2, "manual", "x")], "id int, method string, tagged_name string")
    links = spark.createDataFrame([(2, 9, "manual"), (3, 6, "machine")], "id int, tag int, method string")
    verdicts, diff = tagging.tagging_sweep(titles, state, links, d, "id", "title", "tag")
    assert rows(verdicts.select("id", "status")) == [(1, "tagged"), (3, "tagged")]
    assert rows(diff) == [(1, 7, "add"), (3, 6, "delete"), (3, 7, "add"), (3, 8, "add")]
    after = spark.createDataFrame([(1, "machine", "Mew #1"), (2, "manual", "x"), (3, "machine", "Mew Mewtwo")], state.schema)
    assert tagging.tagging_sweep(titles, after, links, d, "id", "title", "tag")[0].count() == 0


def test_dangling_alias_is_refused(spark):
    groups = spark.createDataFrame([("s", "n")], "slug string, name string")
    catalog = spark.createDataFrame([("g", "n", False)], "group_id string, name string, physical boolean")
    aliases = spark.createDataFrame([("s", ["g"])], "slug string, targets array<string>")
    with pytest.raises(ValueError, match="lacks"):
        resolve.resolve_groups(groups, catalog, aliases, F.lit("main"), "p", "m")


def test_alias_only_shelf_never_falls_back_to_names(spark):
    groups = spark.createDataFrame([("far-a", "Known"), ("far-b", "Known"), ("near", "Known"), ("wall", "Known")], "slug string, name string")
    catalog = spark.createDataFrame([("g", "Known", True)], "group_id string, name string, physical boolean")
    far = spark.createDataFrame([("j", 5, True), ("k", 5, False)], "group_id string, official int, physical boolean")
    none = spark.createDataFrame([], "slug string, targets array<string>")
    shelf = F.when(F.col("slug").startswith("far"), "far").when(F.col("slug") == "wall", "x").otherwise("main")
    go = lambda target: resolve.resolve_groups(groups, catalog, none, shelf, "p", "m", alias_only=resolve.AliasShelf("far", far, spark.createDataFrame([("far-a", [target]), ("near", ["j"])], none.schema)))
    assert rows(go("j").select("slug", "kind", F.array_join("target_ids", ","))) == [("far-a", "mapped", "j"), ("far-b", "unmapped", ""), ("near", "mapped", "g"), ("wall", "unmapped", "")]
    for dangling in ("k", "nowhere"):
        with pytest.raises(ValueError, match="aliases of far"):
            go(dangling)


def test_across_scripts(spark):
    members = spark.createDataFrame([(1, "s", "x #01"), (2, "s", "x #01"), (3, "s", "x #9"), (4, "s", "x")], "id int, slug string, name string")
    mapping = spark.createDataFrame([("s", "mapped", ["g"])], "slug string, kind string, target_ids array<string>")
    refs = spark.createDataFrame([("g", "g-1", "1", "ピカ")], "group_id string, member_id string, local_id string, name string")
    tags = spark.createDataFrame([(1, [25]), (2, [7])], "id int, ids array<int>")
    ref_tags = spark.createDataFrame([("g-1", [25])], "member_id string, ids array<int>")
    got = resolve.match_across_scripts(members, mapping, refs, spark.createDataFrame([("g", 9)], "group_id string, official int"), tags, ref_tags)
    assert rows(got.select("id", "status")) == [(1, "confirmed"), (2, "name_mismatch"), (3, "number_not_found"), (4, "no_number")]


def test_files(spark, tmp_path):
    (tmp_path / "alias.json").write_text(json.dumps([{"slug": "a", "targets": ["x"], "reason": "r"}]))
    assert documents.alias_file(spark, str(tmp_path / "alias.json")).count() == 1
    (tmp_path / "again.json").write_text(json.dumps([{"slug": "a", "targets": ["x"], "reason": "r"}] * 2))
    with pytest.raises(ValueError):
        documents.alias_file(spark, str(tmp_path / "again.json"))
    (tmp_path / "map.json").write_text('{"A": "one", "B": "two"}')
    assert rows(documents.object_map_file(spark, str(tmp_path / "map.json"))) == [("A", "one"), ("B", "two")]
    (tmp_path / "twice.json").write_text('{"A": "one", "A": "two"}')
    with pytest.raises(ValueError):
        documents.object_map_file(spark, str(tmp_path / "twice.json"))
    (tmp_path / "not.json").write_text('{"Slugs": ["x", "y", "x"]}')
    assert documents.exclusion_file(spark, str(tmp_path / "not.json")).count() == 2
    (tmp_path / "q.csv").write_text('1,"a, ""b"""\n')
    assert rows(documents.quoted_csv(spark, str(tmp_path / "q.csv"), "id int, name string")) == [(1, 'a, "b"')]
    (tmp_path / "docs").mkdir()
    doc = {"id": "g", "name": "G", "serie": {"id": "s", "name": "S"}, "releaseDate": "2024-01-02", "cardCount": {"official": 1, "total": 1}, "cards": [{"id": "g-1", "localId": "1", "name": "n"}]}
    (tmp_path / "docs/g.json").write_text(json.dumps(doc))
    groups, members = documents.catalog_documents(spark, str(tmp_path / "docs"), 1)
    assert (groups.count(), members.count()) == (1, 1)
    with pytest.raises(ValueError, match="manifest"):
        documents.catalog_documents(spark, str(tmp_path / "docs"), 2)


def test_page_verdicts(spark):
    html = ["<title>t</title><article>x", "<title> </title><article>", "<title>t</title><p>", None, "<title>t</title><article><blink>"]
    df = spark.createDataFrame(list(enumerate(html)), "id int, html string")
    got = pages.page_facts(df, known_tags=("title", "article", "p"))
    assert [r["verdict"] for r in got.orderBy("id").collect()] == ["ok", "drift", "rejected", "drift", "drift"]
    assert pages.balanced_object("x = {a: {b}} tail", "x") == "{a: {b}}"
    assert pages.balanced_object("x = {a", "x") is None


def test_no_cartesian_products(spark, sf):
    from tidemark.plans import catalogue

    for name in ("gap_audit", "match_cards", "tagging_diff", "history_cut_plan"):
        plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_uncommitted_batches_are_invisible(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, v int").schema
    t = visits.BatchTable(spark, str(tmp_path / "t"), schema)
    assert t.read().count() == 0
    t.write(spark.createDataFrame([(1, 1)], schema), 0)
    t.commit(0)
    t.write(spark.createDataFrame([(2, 2)], schema), 1)
    assert rows(t.read()) == [(1, 1)]
    t.write(spark.createDataFrame([(3, 3)], schema), 1)
    t.commit(1)
    assert rows(t.read()) == [(1, 1), (3, 3)]


def test_species_documents(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "t").mkdir()
    species = {
        "id": 2, "name": "b", "names": [{"language": {"name": "en"}, "name": "Bee"}], "generation": {"name": "generation-i"}, "color": {"name": "red"}, "habitat": None,
        "evolves_from_species": {"url": "https://x/species/1/"}, "egg_groups": [{"name": "z"}, {"name": "a"}], "evolution_chain": {"url": "https://x/chain/9/"},
        "varieties": [{"is_default": False, "creature": {"url": "https://x/creature/8/"}}, {"is_default": True, "creature": {"url": "https://x/creature/7/"}}],
    }
    (tmp_path / "s/2.json").write_text(json.dumps(species))
    (tmp_path / "t/7.json").write_text(json.dumps({"id": 7, "types": [{"slot": 2, "type": {"name": "wind"}}, {"slot": 1, "type": {"name": "fire"}}]}))
    r = documents.species_documents(spark, str(tmp_path / "s"), str(tmp_path / "t"), "creature").first()
    assert (r["id"], r["name"], r["evolves_from"], r["chain_id"], r["types"], r["egg_groups"], r["names"]) == (2, "Bee", 1, 9, ["fire", "wind"], ["a", "z"], {"en": "Bee"})
