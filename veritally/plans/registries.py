"""Registry and streaming queries, on urls, pages and the event log."""

from pyspark.sql import functions as F

from ..sources import registry
from ..streaming import digits as stream
from .digits import _digit
from .registry import load, query, shown

_ROWS = """(SELECT 'p' || page_id AS id, 'page' AS name, CASE WHEN page_id % 7 = 0 THEN '' ELSE 'host' END AS provider, CASE WHEN page_id % 5 = 0 THEN NULL ELSE url END AS url,
  CASE WHEN page_id % 3 = 0 THEN 'open' WHEN page_id % 3 = 1 THEN 'archive_visit' ELSE 'paywalled' END AS access,
  CASE WHEN page_id % 4 = 0 THEN 'blocked' WHEN page_id % 4 = 1 THEN 'verified' WHEN page_id % 4 = 2 THEN 'unverified' ELSE 'partial' END AS status,
  {sha} AS sha256 FROM pages)"""


def _sources(spark, sf_dir):
    load(spark, sf_dir, "pages").createOrReplaceTempView("_registry_pages")
    rows = spark.sql(f"SELECT * FROM {_ROWS.format(sha='sha2(html, 256)').replace('FROM pages', 'FROM _registry_pages')}")
    have = set(rows.columns)
    names = [(f.split()[0], f.split()[1]) for f in registry.SOURCE.split(", ")]
    return rows.select(*(F.col(n) if n in have else F.lit(None).cast(k).alias(n) for n, k in names))


@query(f"""WITH s AS {_ROWS.format(sha="sha256(html)")}
SELECT id, 'id, name and provider must be given' AS problem FROM s WHERE provider = ''
UNION ALL SELECT id, 'a blocked source needs a reason' FROM s WHERE status = 'blocked'
UNION ALL SELECT id, 'a verified source needs a probe or a local file' FROM s WHERE status = 'verified'
UNION ALL SELECT id, 'an unverified source needs notes' FROM s WHERE status = 'unverified'
UNION ALL SELECT id, 'only sources that aren''t on the net may lack a url' FROM s WHERE url IS NULL AND access <> 'archive_visit'""")
def registry_rules(spark, sf_dir):
    return registry.validate_sources(_sources(spark, sf_dir))


@query(f"""WITH s AS {_ROWS.format(sha="sha256(html)")},
f AS (SELECT 'p' || page_id AS id, CASE WHEN page_id % 6 = 0 THEN 200 WHEN page_id % 6 = 1 THEN 403 WHEN page_id % 6 = 2 THEN 404 WHEN page_id % 6 = 3 THEN 500 WHEN page_id % 6 = 4 THEN 418 END AS code,
  CASE WHEN page_id % 6 = 0 AND page_id % 4 <> 0 THEN sha256(url) END AS got, CASE WHEN page_id % 9 = 3 THEN 'timed out' END AS error FROM pages WHERE page_id % 6 < 5)
SELECT id, status, CASE WHEN code IS NULL THEN status WHEN error IS NULL AND got IS NOT NULL THEN 'verified' WHEN code = 403 THEN 'blocked' WHEN access = 'paywalled' AND code IN (403, 418) THEN 'blocked' WHEN code = 404 THEN 'unverified' ELSE 'partial' END AS new_status,
       CASE WHEN code IS NULL OR (error IS NULL AND got IS NOT NULL) THEN NULL WHEN code = 403 THEN 'HTTP 403' WHEN access = 'paywalled' AND code = 418 THEN 'HTTP 418 (paywalled source)' END AS blocked_reason,
       CASE WHEN code IS NULL OR (error IS NULL AND got IS NOT NULL) THEN NULL ELSE '2026-01-01 u: ' || coalesce(error, 'HTTP ' || code) END AS notes,
       CASE WHEN code IS NOT NULL AND error IS NULL AND got IS NOT NULL THEN got ELSE sha256 END AS sha256,
       CAST(code AS BIGINT) AS http_status FROM s LEFT JOIN f USING (id)""")
def fetch_state_machine(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").where("page_id % 6 < 5")
    code = F.element_at(F.array(*(F.lit(c) for c in (200, 403, 404, 500, 418))), (F.col("page_id") % 6 + 1).cast("int"))
    null = lambda kind: F.lit(None).cast(kind)
    got = F.when((F.col("page_id") % 6 == 0) & (F.col("page_id") % 4 != 0), registry.digest("url")).alias("sha256")
    fetches = pages.select(
        F.concat(F.lit("p"), "page_id").alias("source_id"), F.lit("u").alias("url"), F.lit("2026-01-01").alias("finished_at"), code.alias("http_status"),
        F.when(F.col("page_id") % 9 == 3, "timed out").alias("error"), got, null("long").alias("bytes"), null("string").alias("local_path"), F.lit(False).alias("skipped_cached"),
    )
    return shown(registry.transitions(_sources(spark, sf_dir), fetches), "id", "status", "new_status", "blocked_reason", "notes", "sha256", "http_status")


@query("SELECT page_id, sha256(html) AS sha256 FROM pages")
def content_sha256(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", registry.digest("html").alias("sha256"))


@query("""WITH g AS (SELECT CAST(user_id % 50 AS BIGINT) AS host, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS gap FROM events)
SELECT host, count(*) AS requests, count(*) FILTER (gap < 1000.0) AS too_soon FROM g GROUP BY host""")
def request_rate_audit(spark, sf_dir):
    return shown(registry.rate_audit(load(spark, sf_dir, "events"), F.col("user_id") % 50, "ts", 0.001, "event_id"))


@query(f"""WITH v AS (SELECT CAST(ts AS DATE) AS day, event_type, {_digit("value", "first")} AS digit FROM events WHERE value > 0)
SELECT CAST(day AS VARCHAR) AS day, event_type, digit, count(*) AS n FROM v GROUP BY 1, 2, 3""")
def stream_digit_counts(spark, sf_dir):
    counts = stream.windowed_digit_counts(load(spark, sf_dir, "events"), "ts", "value", ["event_type"])
    return counts.select(F.to_date("window_start").cast("string").alias("day"), "event_type", "digit", "n")
