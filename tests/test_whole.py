"""Queries that must read their whole input, against brute force in Python."""

import re

from tidemark.functions.text import NAME_ACCENTED, NAME_BASE
from tidemark.plans import catalogue


def test_name_fold_reads_whole_texts(spark, tmp_path):
    rows = [(1, "é-" * 150 + "Zürich end"), (2, "a" * 500), (3, " x "), (4, ""), (5, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    table = str.maketrans(NAME_ACCENTED, NAME_BASE)
    expected = {i: None if t is None else re.sub("[^A-Za-z0-9]+", " ", t.translate(table)).strip().upper() for i, t in rows}
    assert {r["id"]: r["folded"] for r in catalogue.queries()["name_fold"](spark, str(tmp_path)).collect()} == expected


def test_unnest_rows_keeps_every_element(spark, tmp_path):
    rows = [(1, [i / 7 for i in range(64)]), (2, [0.5] * 9), (3, [1.0]), (4, []), (5, None)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted((r["vec_id"], r["slot"], r["value"]) for r in catalogue.queries()["unnest_rows"](spark, str(tmp_path)).collect())
    assert [x[:2] for x in got] == [(i, k + 1) for i, v in rows for k in range(len(v or []))]
    assert all(abs(value - dict(rows)[i][slot - 1]) < 1e-6 for i, slot, value in got)
