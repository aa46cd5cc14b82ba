"""Steps whose rows must not grow faster than their input."""

import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import integrity, resolve
from tidemark.plans import history
from tidemark.sources import detail, slices, visit_page
from tidemark.streaming import visits


def most_rows(df):
    """The most rows that a node of the plan made, after the plan has run without adaptive changes."""

    def made(plan):
        metric = plan.metrics().get("numOutputRows")
        children = plan.children()
        return max([metric.get().value() if metric.isDefined() else 0, *[made(children.apply(i)) for i in range(children.size())]])

    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fresh = df.select("*")
        fresh.collect()
        return made(fresh._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def across(spark, members, refs, tags, ref_tags, targets):
    return resolve.match_across_scripts(
        spark.createDataFrame(members, "id int, slug string, name string"), spark.createDataFrame([("a", "mapped", targets)], "slug string, kind string, target_ids array<string>"),
        spark.createDataFrame(refs, "group_id string, member_id string, local_id string, name string"), spark.createDataFrame([("g", 10), ("h", 0)], "group_id string, official int"),
        spark.createDataFrame(tags, "id int, ids array<int>"), spark.createDataFrame(ref_tags, "member_id string, ids array<int>"),
    )


def test_members_and_references_of_one_number_do_not_multiply(spark):
    n = 300
    members, refs = [(i, "a", "x #7") for i in range(n)], [("g", f"r{i:03d}", "7", "y") for i in range(n)]
    df = across(spark, members, refs, [(i, [i % 3, 5]) for i in range(n)], [(f"r{i:03d}", [i % 3]) for i in range(n)], ["g"])
    assert most_rows(df) <= 4 * n and {r["status"] for r in df.collect()} == {"ambiguous"}


def test_verdicts_across_scripts_equal_those_of_all_pairs(spark):
    rnd = random.Random(7)
    some = lambda: rnd.choice([None, [], [rnd.randrange(4)], [rnd.randrange(9), rnd.randrange(9), None]])
    members = [(i, "a", f"x #{rnd.randrange(1, 9)}") for i in range(150)]
    refs = [(rnd.choice("gh"), f"r{i}", rnd.choice(["", "0"]) + str(rnd.randrange(1, 9)), f"y{i}") for i in range(24)]
    tags, ref_tags = {i: some() for i in range(140)}, {f"r{i}": some() for i in range(20)}
    got = {r["id"]: (r["status"], r["member_id"]) for r in across(spark, members, refs, list(tags.items()), list(ref_tags.items()), ["h", "g"]).collect()}
    expected = {}
    for i, _, name in members:
        hits = sorted(("hg".index(g), g, m) for g, m, local, _ in refs if int(local) == int(name[3:]))
        ids = lambda x: {t for t in x or () if t is not None}
        good = [h for h in hits if ids(tags.get(i)) & ids(ref_tags.get(h[2]))]
        status = "number_not_found" if not hits else "no_guard" if not tags.get(i) else "confirmed" if len(good) == 1 else "ambiguous" if good else "name_mismatch" if any(ref_tags.get(h[2]) for h in hits) else "no_guard"
        expected[i] = (status, good[0][2] if status == "confirmed" else hits[0][2] if status == "name_mismatch" else None)
    assert got == expected and {s for s, _ in got.values()} >= {"confirmed", "ambiguous", "name_mismatch", "no_guard"}


def test_slices_hold_few_texts_and_few_bytes_and_lose_none():
    texts = ["x" * 10] * 150 + [None, "y" * (3 << 20), "", "z" * (1 << 19), "z" * (1 << 19), "z"]
    parts = [p.to_pylist() for p in slices.slices(pa.array(texts))]
    assert sum(parts, []) == texts and max(map(len, parts)) <= slices.MOST_TEXTS
    assert all(sum(len(t or "") for t in p) <= slices.MOST_BYTES or len(p) == 1 for p in parts) and list(slices.slices(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("read", ["page", "listing"])
def test_pages_are_read_and_handed_on_slice_by_slice(spark, read):
    rows = [(i, None if i % 50 == 7 else f'<title>{i}</title><table><tr id="product-{i}"><td class="title"><a href="/game/{i}">{i}</a></td></tr></table>') for i in range(300)]
    layout = visit_page.Layout(series={}, graders=(), sources=(), known_labels=(), image="x")
    column = visit_page.page_parts(F.col("html"), layout) if read == "page" else detail.listing(F.col("html"))
    df = spark.createDataFrame(rows, "id int, html string").coalesce(1).select("id", column.alias("r"))
    got = {x["id"]: x["r"]["title"] if read == "page" else [p["name"] for p in x["r"]["products"]] for x in df.collect()}
    assert got == {i: None if html is None and read == "page" else [] if html is None else str(i) if read == "page" else [str(i)] for i, html in rows}


def test_tasks_of_the_cap_classes_grow_with_their_rows(spark):
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [history._tasks(spark, n) for n in (0, 250_000, 250_000 * own + 1)] == [own, own, own + 1]
    rows = spark.range(100).select((F.col("id") % 40).alias("key"), F.lit("").alias("stream"), F.col("id").alias("position"), F.col("id").alias("cents"), F.current_date().alias("day"), F.col("id").alias("row_id"))
    given = [["key"], "stream", "position", "cents", "day", ["row_id"]]
    out = integrity.cap_classification(rows, *given, partitions=37)
    assert out.rdd.getNumPartitions() == 37 and sorted(out.collect()) == sorted(integrity.cap_classification(rows, *given).collect())


def test_a_keys_rows_are_sorted_and_widened_as_arrays():
    frames = [pd.DataFrame({"k": [3, 1], "t": pd.to_datetime(["2024-01-02", "2024-01-01"]), "s": ["b", "a"]}), pd.DataFrame({"k": [2], "t": pd.to_datetime(["2024-01-01"]), "s": ["c"]})]
    for order, expected in ((["t", "k"], [1, 2, 3]), (["s"], [1, 3, 2])):
        rows = visits.in_order(iter(frames), order)
        out = visits.with_columns(rows, ["n", "ok"], [(i, i > 0) for i in range(3)])
        assert list(out.columns) == ["k", "t", "s", "n", "ok"] and out["k"].tolist() == expected and out["ok"].tolist() == [False, True, True]
    one = visits.in_order(iter([frames[0].iloc[1:]]), ["k"])
    assert visits.with_columns(one, ["n"], [(7,)]).to_dict("records") == [{"k": 1, "t": pd.Timestamp("2024-01-01"), "s": "a", "n": 7}]
