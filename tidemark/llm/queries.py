"""The registered queries of this subpackage, with their parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import encode_documents
from tidemark.llm.common import table
from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.fill_in_middle import fill_in_middle, restore
from tidemark.llm.jaccard_join import ngram_jaccard_join
from tidemark.llm.language_id import identify_languages
from tidemark.llm.pii import find_pii, train_pii_model
from tidemark.llm.quality import classify_quality
from tidemark.llm.sharding import shard_rows
from tidemark.llm.spelling import corrupt, spelling_groups
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.token_counts import count_tokens
from tidemark.llm.warc import archive_round_trip

#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=100, keep_text=False)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_pii(docs, train_pii_model(docs), redacted=False)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), limit=4096, prefixes=False)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), keep_ids=False)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"), change=corrupt(199))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"), seed=42)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def oracle_sql() -> dict[str, str]:
    return {
        "op5_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
                 k AS (SELECT h, max(page_id) AS keep FROM p WHERE strlen(h) >= 1000 GROUP BY h)
            SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
                   CASE WHEN keep IS NULL OR keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN keep <> page_id THEN keep END AS refers_to
            FROM p LEFT JOIN k USING (h)""",
        "op8_exact_dedup": f"""
            WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents),
                 g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
        "op9_sharding": f"""
            WITH r AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
                              ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
                 e AS (SELECT r.*, d, h >> (60 - d)::INT AS p FROM r, range(0, 61) AS x(d)),
                 f AS (SELECT d, p FROM e GROUP BY d, p HAVING sum(n_bytes) <= {SHARD_BYTES} OR count(*) = 1),
                 l AS (SELECT doc_id, n_bytes, h, min(d) AS depth FROM e JOIN f USING (d, p) GROUP BY doc_id, n_bytes, h)
            SELECT doc_id, n_bytes, depth || '-' || lower(to_hex(h >> (60 - depth)::INT)) AS shard_id, depth::INT AS depth FROM l""",
        "op12_fill_in_middle": r"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x,
                              regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
                 h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
                 c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                              CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
                 p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
            SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
                   sha256(t) AS restored_sha256
            FROM p""",
    }
