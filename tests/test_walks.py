import pytest
from pyspark.sql import functions as F

from tidemark.operators import walks


@pytest.mark.parametrize("most", [20, 3, 1])
def test_walks_of_every_kind(spark, most):
    chain = lambda name, n, end=None: [(name, "" if i == 0 else f"{i}", f"{i + 1}" if i < n - 1 else end, None, [(f"{name}{i}", i), (f"{name}x", i)]) for i in range(n)]
    rows = chain("one", 1) + chain("fits", 20) + chain("long", 21) + chain("very", 70) + chain("circle", 4, "1") + chain("self", 1, "") + chain("torn", 5, "gone")
    rows += [("drift", "", "1", None, [("d0", 0)]), ("drift", "1", None, "odd", []), ("empty", "", None, None, [])]
    pages = spark.createDataFrame(rows, "host string, cursor string, following string, drift string, products array<struct<id: string, place: int>>").withColumn("n", F.size("products"))
    hosts = spark.createDataFrame([(h,) for h in {r[0] for r in rows} | {"absent"}], "host string")
    steps = walks.walk_steps(hosts, pages, "host", "cursor", "following", most)
    assert steps.groupBy("host").count().filter(F.col("count") > most).isEmpty() and steps.groupBy("host", "step").count().filter("count > 1").isEmpty()
    got = {r["host"]: (r["outcome"], r["completed"], r["pages"], r["seen"]) for r in walks.walk_verdicts(steps, pages, "host", "cursor", "following", "drift", "n", most).collect()}
    by = {r[0] + "|" + r[1]: r for r in rows}

    def walk(host):
        at, read, seen = "", 0, 0
        while True:
            page = by.get(f"{host}|{at}")
            if page is None or page[3]:
                return "missing page" if page is None else "drift", False, read, seen
            read, seen = read + 1, seen + len(page[4])
            if page[2] is None:
                return "completed", True, read, seen
            if read == most:
                return "runaway", False, read, seen
            at = page[2]

    assert got == {h: walk(h) for h in got} and len(got) == 10
    found = {(r["host"], r["id"]): r["place"] for r in walks.walked_rows(steps, pages, "host", "cursor", "products", "id").collect()}
    assert found[("long", "longx")] == min(most, 20) - 1 and ("long", "long20") not in found and ("one", "one0") in found
