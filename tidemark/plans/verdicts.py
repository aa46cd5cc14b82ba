"""Queries over visit states, verdicts, worksheets and page facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import verdicts
from tidemark.plans.common import NOW, STATES, now, states, table
from tidemark.sources import detail

def _full(spark, sf_dir):
    s = states(spark, sf_dir)
    return s.withColumns({
        "last_seen_at": F.col("last_visited_at"), "image_hash": F.when(F.col("id") % 4 == 0, F.concat(F.lit("h"), F.col("id").cast("string"))),
        "image_fetched_at": F.when(F.col("id") % 8 == 0, F.col("last_visited_at")), "failure_streak": (F.col("id") % 5).cast("int"),
    })


def visit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _full(spark, sf_dir)
    i = F.col("id")
    visits = s.filter("id % 2 = 0").select("id", (i % 10 / F.lit(2.0)).alias("rate"), (i % 6 == 0).alias("at_cap"), F.when(i % 7 != 0, i % 14).alias("margin"), F.concat(F.lit("n"), i.cast("string")).alias("image_hash"))
    out = verdicts.apply_visits(s, visits, now())
    return out.select("id", "rate", "any_at_cap", "newly_at_cap", (F.col("near_miss_at") == now()).alias("near_now"), F.col("near_miss_at").isNotNull().alias("near"), "image_hash", "failure_streak", F.col("gone_at").isNotNull().alias("gone"), F.col("delisted_at").isNotNull().alias("delisted"), F.col("quarantined_until").isNotNull().alias("benched"), F.col("refresh_requested_at").isNotNull().alias("asked"))


def gone_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    missing = c.filter("c_custkey % 3 = 0").select(k.alias("id"), F.col("c_nationkey").alias("set_id"), F.lit("/old").alias("failing_url"), F.when(k % 5 == 0, "/new").otherwise("/old").alias("url"), F.when(k % 7 == 0, now()).alias("last_seen_at"))
    walks = table(spark, sf_dir, "nation").filter("n_nationkey <> 3").select(F.col("n_nationkey").alias("set_id"), (F.col("n_nationkey") % 4 != 1).alias("completed"), (F.col("n_nationkey") % 6).alias("seen"))
    return verdicts.gone_verdicts(missing, walks, now(), gone_today=2, most_a_day=25)


def still_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _full(spark, sf_dir)
    sets = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("slug"), F.when(F.col("s_suppkey") % 3 > 0, now() - F.make_dt_interval((F.col("s_suppkey") % 20).cast("int"))).alias("last_walked_at"))
    excluded = spark.createDataFrame([("s3",), ("s7",)], "slug string")
    parts = {"probe": verdicts.delisted_probe(s, now(), most=3), "image": verdicts.pending_images(s), "walk": verdicts.pending_walks(sets, excluded, now(), 7), "first": verdicts.first_unvisited(s)}
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("list"), F.col("id").cast("bigint").alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def request_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'click'")
    return verdicts.one_flight(e.select("user_id", F.col("event_id").alias("first_id")), "user_id", "first_id")


def worksheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    details = keys.filter("id % 4 <> 0").select("id", (F.col("id") % 3).alias("match_status"))
    pending = verdicts.pending_worksheet(keys, details, pending=0)
    words = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("name"))
    words = words.withColumn("tag", F.length("name") * 1000 + F.ascii("name"))
    names = words.groupBy("tag").agg(F.min("name").alias("name"))
    return verdicts.tag_listing(pending, words.filter("tag % 2 = 0").select("id", "tag").distinct(), names)


def canary_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("mode"))
    tiers = line.groupBy("id", "mode").agg(F.count(F.lit(1)).cast("int").alias("n"))
    facts = tiers.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("mode", F.sequence(F.lit(1), F.col("n"))))).alias("chart"), F.collect_list("mode").alias("sale_tiers"))
    facts = facts.withColumn("has_population", F.col("id") % 9 != 0).withColumn("sale_tiers", F.slice("sale_tiers", 1, (F.col("id") % 4 + 1).cast("int")))
    out = verdicts.canary(facts, ["AF", "NF", "NO", "RF", "XX"], "AF", least_months=150)
    return out.select("id", F.array_join("failures", "; ").alias("failures"))


def _chart(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    point = F.concat(F.lit("["), (F.unix_date(F.to_date("o_orderdate")).cast("bigint") * 86_400_000 + 18_000_000).cast("string"), F.lit(","), F.floor("o_totalprice").cast("string"), F.lit("]"))
    name = F.when((F.col("o_custkey") % 50 == 7) & (F.col("o_orderkey") % 2 == 0), "odd").otherwise(F.concat(F.lit("s"), (F.col("o_orderkey") % 3).cast("string")))
    series = o.select(F.col("o_custkey").alias("id"), name.alias("name"), F.col("o_orderkey").alias("k"), point.alias("point")).groupBy("id", "name").agg(F.concat(F.lit('"'), F.col("name"), F.lit('":['), F.array_join(F.array_sort(F.collect_list("point")), ","), F.lit("]")).alias("text"))
    return series.groupBy("id").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("text")), ","), F.lit("}")).alias("chart"))


def chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detail.chart_rows(_chart(spark, sf_dir), "id", "chart", {"s0": "Ungraded", "s1": "Nine", "s2": "Ten"})
    return rows.select("id", "tier", "day", F.col("cents").cast("bigint").alias("cents"), "reason")


def population_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    doc = F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).when(F.col("c_custkey") % 5 == 1, F.concat(F.lit('{"psa":['), k, F.lit(",1]}"))).when(F.col("c_custkey") % 5 == 2, F.concat(F.lit('{"psa":[2],"cgc":['), k, F.lit("]}"))).when(F.col("c_custkey") % 5 == 3, F.lit('{"bgs":[1],"abc":[2]}')).otherwise(F.lit("{}"))
    p = c.select("c_custkey", detail.population(doc, ["psa", "cgc"]).alias("p"))
    return p.select("c_custkey", F.array_join(F.col("p.counts.psa").cast("array<string>"), ",").alias("psa"), F.array_join(F.col("p.counts.cgc").cast("array<string>"), ",").alias("cgc"), F.col("p.reason").alias("reason"))


def kind_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    labels = F.when(k % 3 == 0, F.split("p_name", " ")).when(k % 3 == 1, F.array().cast("array<string>"))
    genre = F.when(k % 4 == 0, "Trading Card").when(k % 4 == 1, F.col("p_type")).when(k % 4 == 2, "")
    return p.select("p_partkey", detail.kind_verdict(labels, genre, ["red", "blue"], "card").alias("verdict"))


def zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    arrays = line.select("l_orderkey", F.col("x.l_linenumber").alias("line"), F.col("x.l_partkey").alias("part"), F.col("x.l_suppkey").alias("supp"))
    return detail.zipped_rows(arrays, "l_orderkey", "line", "part", "supp")


def _listing_page(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    href = F.when(F.col("p_partkey") % 400 == 399, F.lit("/game/../x")).otherwise(F.concat(F.lit("/game/"), k))
    row = F.concat(F.lit('<tr id="product-'), k, F.lit('"><td class="image"><a href="/x">pic</a></td><td class="title"><a href="'), href, F.lit('"> '), F.col("p_name"), F.lit(" </a></td></tr>"))
    sale = F.concat(F.lit('<div class="tab tier-'), F.element_at(F.split("p_type", " "), 1), F.lit('"><table><tr data-sale="'), k, F.lit('" data-cents="'), F.col("p_size").cast("string"), F.lit('"></tr></table></div>'))
    pages = p.groupBy((F.col("p_partkey") % 40).alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"), F.array_join(F.array_sort(F.collect_list(sale)), "").alias("sales"))
    form = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<form class="js-next-page"><input type="hidden" name="cursor" value="'), F.col("page_id").cast("string"), F.lit('"></form>'))).otherwise("")
    return pages.select("page_id", detail.listing(F.concat(F.lit("<body><table>"), "rows", F.lit("</table>"), "sales", form, F.lit("</body>"))).alias("r"))


def listing_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _listing_page(spark, sf_dir).filter("r.reason is null")
    return p.select("page_id", F.col("r.next")["cursor"].alias("cursor"), F.explode("r.products").alias("x")).select("page_id", "cursor", "x.id", "x.href", "x.name")


def listing_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listing_page(spark, sf_dir).filter("r.reason is null").select("page_id", F.explode("r.sales").alias("x")).select("page_id", F.col("x.sale").cast("bigint").alias("sale"), "x.tier", "x.cents")


def outcome_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(verdicts.outcome_tag(F.col("user_id") % 5).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (visit_state, gone_verdict, still_to_do, request_flights, worksheet, canary_failures, chart_points, population_counts, kind_verdicts, zipped, listing_products, listing_sales, outcome_tags)}

_BAD_PAGES = "(SELECT p_partkey % 40 FROM part WHERE p_partkey % 400 = 399)"
ORACLES = {
    "visit_state": f"""WITH {STATES}, x AS (SELECT *, id % 2 = 0 AS seen, CASE WHEN id % 7 <> 0 THEN id % 14 END AS margin FROM s)
        SELECT id, CASE WHEN seen THEN (id % 10) / 2.0 ELSE rate END AS rate, CASE WHEN seen THEN id % 6 = 0 ELSE any_at_cap END AS any_at_cap, seen AND id % 6 = 0 AND NOT any_at_cap AS newly_at_cap,
               CASE WHEN seen THEN CASE WHEN margin > 0 AND margin <= 8 THEN true END ELSE near_miss_at = TIMESTAMP '{NOW}' END AS near_now,
               CASE WHEN seen THEN coalesce(margin > 0 AND margin <= 8, false) ELSE near_miss_at IS NOT NULL END AS near,
               CASE WHEN id % 4 = 0 THEN 'h' || id WHEN seen THEN 'n' || id END AS image_hash, CASE WHEN seen THEN 0 ELSE (id % 5)::INT END AS failure_streak,
               gone_at IS NOT NULL AND NOT seen AS gone, delisted_at IS NOT NULL AS delisted, quarantined_until IS NOT NULL AND NOT seen AS benched, refresh_requested_at IS NOT NULL AND NOT seen AS asked FROM x""",
    "gone_verdict": """WITH m AS (SELECT c_custkey AS id, c_custkey % 5 = 0 AS healed, n_nationkey IS NOT NULL AND n_nationkey <> 3 AND n_nationkey % 4 <> 1 AND n_nationkey % 6 > 0 AND c_custkey % 7 <> 0 AS gone
              FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY gone AND NOT healed ORDER BY id) AS k FROM m)
        SELECT id, CASE WHEN healed THEN 'healed' WHEN gone AND k <= 23 THEN 'gone' ELSE 'no_verdict' END AS verdict FROM r""",
    "still_to_do": f"""WITH {STATES}, w AS (SELECT s_suppkey AS id, 's' || s_nationkey AS slug, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 20 END AS days FROM supplier)
        SELECT 'probe' AS list, id::BIGINT AS id FROM (SELECT id FROM s WHERE delisted_at IS NOT NULL AND (delisted_probed_at IS NULL OR delisted_probed_at < TIMESTAMP '{NOW}' - INTERVAL 1 DAY) ORDER BY delisted_probed_at NULLS FIRST, id LIMIT 3)
        UNION ALL SELECT 'image', id FROM (SELECT id FROM d WHERE living AND id % 4 = 0 AND (id % 8 <> 0 OR last_visited_at IS NULL) ORDER BY id LIMIT 50)
        UNION ALL SELECT 'walk', id FROM w WHERE (days IS NULL OR days > 7) AND slug NOT IN ('s3', 's7')
        UNION ALL SELECT 'first', id FROM (SELECT id FROM d WHERE living AND last_visited_at IS NULL ORDER BY id LIMIT 1)""",
    "request_flights": "SELECT user_id, min(event_id) AS first_id, count(*) AS served FROM events WHERE event_type = 'click' GROUP BY 1",
    "worksheet": """WITH w AS (SELECT id, name, length(name) * 1000 + ascii(name) AS tag FROM (SELECT p_partkey AS id, unnest(list_distinct(string_split(p_name, ' '))) AS name FROM part)),
        t AS (SELECT tag, min(name) AS name FROM w GROUP BY tag), j AS (SELECT id, string_agg(t.name, ' · ' ORDER BY tag) AS tags FROM (SELECT DISTINCT id, tag FROM w WHERE tag % 2 = 0) JOIN t USING (tag) GROUP BY id)
        SELECT p_partkey AS id, p_brand AS brand, tags FROM part LEFT JOIN j ON j.id = p_partkey WHERE p_partkey % 4 = 0 OR p_partkey % 3 = 0""",
    "canary_failures": """WITH c AS (SELECT l_suppkey AS id, l_returnflag || l_linestatus AS mode, count(*) AS n FROM lineitem GROUP BY ALL),
        g AS (SELECT id, list(mode) AS modes, max(CASE WHEN mode = 'AF' THEN n END) AS af, count(*) AS k FROM c GROUP BY id)
        SELECT id, concat_ws('; ', 'no series for ' || array_to_string(list_filter(['AF', 'NF', 'NO', 'RF', 'XX'], lambda x: NOT list_contains(modes, x)), ', '),
               CASE WHEN af < 150 THEN 'AF goes back ' || af || ' months' END, CASE WHEN id % 9 = 0 THEN 'no census' END, CASE WHEN least(k, id % 4 + 1) < 3 THEN 'sales in under 3 tiers' END) AS failures FROM g""",
    "chart_points": """WITH o AS (SELECT o_custkey AS id, o_custkey % 50 = 7 AND o_orderkey % 2 = 0 AS odd, o_orderkey % 3 AS k, CAST(o_orderdate AS DATE) AS day, floor(o_totalprice)::BIGINT AS cents FROM orders),
        b AS (SELECT DISTINCT id FROM o WHERE odd)
        SELECT id, CASE k WHEN 0 THEN 'Ungraded' WHEN 1 THEN 'Nine' ELSE 'Ten' END AS tier, day, cents, NULL::VARCHAR AS reason FROM o WHERE id NOT IN (SELECT id FROM b)
        UNION ALL SELECT id, NULL, NULL, NULL, 'unknown series: odd' FROM b""",
    "population_counts": """SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN c_custkey || ',1' WHEN 2 THEN '2' WHEN 4 THEN '' END AS psa, CASE c_custkey % 5 WHEN 1 THEN '' WHEN 2 THEN c_custkey::VARCHAR WHEN 4 THEN '' END AS cgc,
        CASE WHEN c_custkey % 5 = 3 THEN 'unknown graders: abc,bgs' END AS reason FROM customer""",
    "kind_verdicts": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN list_has_any(string_split(p_name, ' '), ['red', 'blue']) THEN 'ok' WHEN p_partkey % 4 = 0 OR (p_partkey % 4 = 1 AND contains(lower(p_type), 'card')) THEN 'drift' ELSE 'rejected' END
        WHEN p_partkey % 4 = 1 AND NOT contains(lower(p_type), 'card') THEN 'rejected' ELSE 'ok' END AS verdict FROM part""",
    "zipped": "SELECT l_orderkey, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp FROM lineitem",
    "listing_products": f"""SELECT p_partkey % 40 AS page_id, CASE WHEN (p_partkey % 40) % 2 = 0 THEN (p_partkey % 40)::VARCHAR END AS cursor, p_partkey::BIGINT AS id, '/game/' || p_partkey AS href, trim(p_name) AS name
        FROM part WHERE p_partkey % 40 NOT IN {_BAD_PAGES}""",
    "listing_sales": f"""SELECT p_partkey % 40 AS page_id, p_partkey::BIGINT AS sale, split_part(p_type, ' ', 1) AS tier, p_size::BIGINT AS cents FROM part WHERE p_partkey % 40 NOT IN {_BAD_PAGES}""",
    "outcome_tags": "SELECT CASE user_id % 5 WHEN 0 THEN 'parsed' WHEN 1 THEN 'http_error' WHEN 2 THEN 'parse_failed' WHEN 3 THEN 'not_a_card' ELSE 'unknown' END AS tag, count(*) AS n FROM events GROUP BY 1",
}
