"""Queries over paged listings and category pages made of ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import sync, walks
from tidemark.plans.common import now, table
from tidemark.sources import detail
from tidemark.storage import written

#: Pages of a host are its listing, in order. Each lists three products, one of which the next page lists again, and names
#: the next page; some are missing, some are drift, and the last page of some hosts names the first. The same text on both engines.
CHAIN = """
    SELECT p.*, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS place, count(*) OVER (PARTITION BY host) AS n,
           lead(page_id) OVER (PARTITION BY host ORDER BY page_id) AS next_id, min(page_id) OVER (PARTITION BY host) AS first_id
    FROM (SELECT page_id, html, {host} AS host FROM {pages}) p
"""
HOST_SPARK = "concat(regexp_extract(url, '://([^/]*)', 1), '-', CAST(page_id % 3 AS STRING))"


def _listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = spark.sql(CHAIN.replace("{host}", HOST_SPARK), pages=table(spark, sf_dir, "pages"))
    at = F.when(F.col("place") == 0, walks.FIRST).otherwise(F.col("page_id").cast("string"))
    following = F.coalesce(F.col("next_id"), F.when(F.col("first_id") % 4 == 1, F.col("first_id")))
    # A circle goes back to a page with a cursor, not to the first one, which has none.
    following = F.when((F.col("n") == 1) & F.col("next_id").isNull(), F.lit(None)).otherwise(following)
    cursor = F.when(F.col("next_id").isNull() & following.isNotNull(), F.lit("")).otherwise(following.cast("string"))
    row = lambda id_, href, name: F.concat(F.lit('<tr id="product-'), id_.cast("string"), F.lit('"><td class="title"><a href="'), href, F.lit('">'), name, F.lit("</a></td></tr>"))
    i = F.col("page_id")
    href = F.when(i % 29 == 3, F.lit("/else/1")).otherwise(F.concat(F.lit("/game/"), i.cast("string")))
    body = F.concat(
        F.lit("<table>"), row(i * 2, href, F.concat(F.lit("Name &amp; "), i.cast("string"))), row(i * 2 + 1, F.concat(F.lit("/game/b"), i.cast("string")), F.lit(" b ")),
        F.when(F.col("next_id").isNotNull(), row(F.col("next_id") * 2, F.lit("/game/early"), F.lit("early"))).otherwise(""), F.lit("</table>"),
        F.when(following.isNotNull(), F.concat(F.lit('<form class="js-next-page"><input type="hidden" name="sort" value="x"><input type="hidden" name="cursor" value="'), cursor, F.lit('"></form>'))).otherwise(""),
    )
    made = c.filter("place = 0 or page_id % 31 <> 5").select("host", at.alias("cursor"), F.concat(F.replace("html", F.lit("</body></html>"), F.lit("")), body).alias("html"))
    read = made.select("host", "cursor", detail.listing(F.col("html")).alias("r"))
    pages = read.select("host", "cursor", F.col("r.next")["cursor"].alias("following"), F.col("r.reason").alias("drift"), F.coalesce("r.products", F.array().cast("array<struct<id:bigint,href:string,name:string>>")).alias("products"))
    return c.select("host").distinct(), written(pages.withColumn("listed", F.size("products")), "listing-pages")


def set_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings, pages = _listings(spark, sf_dir)
    steps = walks.walk_steps(listings, pages, "host", "cursor", "following")
    return walks.walk_verdicts(steps, pages, "host", "cursor", "following", "drift", "listed")


def walked_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What walks list, merged into a catalog that knows every fifth product already."""
    listings, pages = _listings(spark, sf_dir)
    seen = walks.walked_rows(walks.walk_steps(listings, pages, "host", "cursor", "following"), pages, "host", "cursor", "products", "id")
    then = F.lit("2024-01-01").cast("timestamp")
    p = table(spark, sf_dir, "pages").filter("page_id % 5 = 0").select((F.col("page_id") * 2).alias("id"), F.lit("/old").alias("href"), F.lit("old").alias("name"), then.alias("first_seen_at"), then.alias("last_seen_at"))
    # Products that hosts share go by the greatest host.
    seen = seen.groupBy("id").agg(F.max(F.struct("host", "href", "name")).alias("r")).select("id", "r.href", "r.name")
    out = sync.catalog_upsert(p, seen, "id", ["href", "name"], now())
    return out.select("id", "href", "name", (F.col("first_seen_at") == now()).alias("new"), (F.col("last_seen_at") == now()).alias("seen"))


def category_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories made of pages: their words link below /console/ inside the block, with repeats, and outside of it."""
    p = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    link = lambda slug, name: F.concat(F.lit('<li><a href="/console/'), slug, F.lit('">'), name, F.lit("</a>"))
    text = lambda x: x.cast("string")
    inside = F.concat(
        F.lit("<ul>"), link(F.concat(F.lit("s"), text(i % 7)), F.lit(" First &amp; <i>last</i> ")), link(F.concat(F.lit("t&amp;"), text(i)), F.lit("Own")), link(F.concat(F.lit("s"), text(i % 7)), F.lit("Again")),
        F.lit('<li><a href="/game/x">no</a>'), link(F.concat(F.lit("s"), text(i % 5)), F.lit("Fifth")), F.lit("</ul>"),
    )
    block = F.when(i % 13 == 4, inside).otherwise(F.concat(F.lit('<div id="home-page"><p>'), inside, F.lit("</div>")))
    html = F.concat(link(F.lit("nav"), F.lit("Nav")), F.replace("html", F.lit("</body></html>"), F.lit("")), block, link(F.lit("foot"), F.lit("Foot")))
    read = p.select("page_id", detail.block_links(html, "home-page", "/console/").alias("r"))
    rows = read.select("page_id", F.posexplode_outer("r.links").alias("pos", "link"), F.col("r.reason").alias("reason"))
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), "link.slug", "link.name", "reason")


QUERIES = {f.__name__: f for f in (set_walks, walked_catalog, category_links)}

_WALKS = f"""c AS ({CHAIN.replace("{pages}", "pages").replace("{host}", "regexp_extract(url, '://([^/]*)', 1) || '-' || (page_id % 3)")}),
    q AS (SELECT *, place > 0 AND page_id % 31 = 5 AS missing, page_id % 29 = 3 AS drift, CASE WHEN next_id IS NULL AND (n = 1 OR first_id % 4 <> 1) THEN NULL WHEN next_id IS NULL THEN 0 ELSE place + 1 END AS onward, 2 + (next_id IS NOT NULL)::INT AS listed FROM c),
    w AS (SELECT host, place, missing, drift, onward, listed, page_id, next_id, 0 AS step FROM q WHERE place = 0
          UNION ALL SELECT q.host, q.place, q.missing, q.drift, q.onward, q.listed, q.page_id, q.next_id, w.step + 1 FROM w JOIN q ON q.host = w.host AND q.place = w.onward WHERE NOT w.missing AND NOT w.drift AND w.step < 19)"""
ORACLES = {
    "set_walks": f"""WITH RECURSIVE {_WALKS}, l AS (SELECT * FROM w QUALIFY step = max(step) OVER (PARTITION BY host)),
        o AS (SELECT host, CASE WHEN missing THEN 'missing page' WHEN drift THEN 'drift' WHEN onward IS NULL THEN 'completed' ELSE 'runaway' END AS outcome FROM l)
        SELECT host, outcome, outcome = 'completed' AS completed, count(*) FILTER (WHERE NOT missing AND NOT drift) AS pages, coalesce(sum(listed) FILTER (WHERE NOT missing AND NOT drift), 0)::BIGINT AS seen FROM w JOIN o USING (host) GROUP BY ALL""",
    "walked_catalog": f"""WITH RECURSIVE {_WALKS}, r AS (SELECT host, step, page_id, next_id FROM w WHERE NOT missing AND NOT drift),
        a AS (SELECT host, step, 0 AS pos, page_id * 2 AS id, '/game/' || page_id AS href, 'Name & ' || page_id AS name FROM r UNION ALL SELECT host, step, 1, page_id * 2 + 1, '/game/b' || page_id, 'b' FROM r UNION ALL SELECT host, step, 2, next_id * 2, '/game/early', 'early' FROM r WHERE next_id IS NOT NULL),
        s AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY host DESC, step DESC, pos DESC) = 1), k AS (SELECT page_id * 2 AS id FROM pages WHERE page_id % 5 = 0)
        SELECT coalesce(s.id, k.id) AS id, coalesce(href, '/old') AS href, coalesce(name, 'old') AS name, k.id IS NULL AS new, s.id IS NOT NULL AS seen FROM s FULL JOIN k ON s.id = k.id""",
    "category_links": """WITH l AS (SELECT page_id, unnest([{k: 0, slug: 's' || page_id % 7, name: 'First & last'}, {k: 1, slug: 't&' || page_id, name: 'Own'}, {k: 2, slug: 's' || page_id % 5, name: 'Fifth'}], recursive := true) FROM pages WHERE page_id % 13 <> 4),
        u AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY page_id, slug ORDER BY k) = 1)
        SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, slug, name, NULL::VARCHAR AS reason FROM u UNION ALL SELECT page_id, NULL, NULL, NULL, 'no block home-page' FROM pages WHERE page_id % 13 = 4""",
}
