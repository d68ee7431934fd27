"""A registry of sources: its rules, the fetch log, and what a fetch does to an entry."""

from __future__ import annotations

import datetime as dt
import json
import threading
import time
import urllib.parse
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core.errors import AnalysisError, CatalogueError, require

SOURCE = (
    "id string, name string, provider string, url string, access string, status string, fetched_at string, http_status int, sha256 string, bytes long, "
    "local_path string, license string, notes string, blocked_reason string, evidence string, download_plan string, verification map<string,string>"
)
FETCH = "source_id string, url string, tool string, started_at string, finished_at string, http_status int, bytes long, sha256 string, local_path string, error string, skipped_cached boolean"
ACCESS = ("open", "registration", "paywalled", "archive_visit", "manual_transcription")
STATUS = ("verified", "partial", "unverified", "blocked")
OFFLINE = ("archive_visit", "manual_transcription")
#: Responses that say a source can't be had.
BLOCKING = (401, 402, 403, 451)


def now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")


def rules() -> list[tuple[str, Column]]:
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    status = F.coalesce(F.col("status"), F.lit(""))
    probed = F.coalesce(F.col("http_status").isin(200, 206), F.lit(False)) & ~empty("fetched_at")
    return [
        ("id, name and provider must be given", empty("id") | empty("name") | empty("provider")),
        ("access is unknown", ~F.coalesce(F.col("access").isin(*ACCESS), F.lit(False))),
        ("status is unknown", ~F.coalesce(F.col("status").isin(*STATUS), F.lit(False))),
        ("a blocked source needs a reason", (status == "blocked") & empty("blocked_reason")),
        ("a verified source needs a probe or a local file", (status == "verified") & ~probed & empty("local_path")),
        ("a local file needs its sha256", ~empty("local_path") & empty("sha256")),
        ("an unverified source needs notes", (status == "unverified") & empty("notes")),
        ("only sources that aren't on the net may lack a url", empty("url") & ~F.coalesce(F.col("access").isin(*OFFLINE), F.lit(False))),
        ("sha256 isn't 64 hexadecimal digits", ~empty("sha256") & ~F.coalesce(F.col("sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False))),
        ("bytes is negative", F.coalesce(F.col("bytes") < 0, F.lit(False))),
        ("http_status is out of range", F.coalesce((F.col("http_status") < 100) | (F.col("http_status") > 599), F.lit(False))),
    ]


def validate_sources(sources: DataFrame) -> DataFrame:
    """All problems at once: (id, problem), repeated ids among them."""
    found = F.array(*(F.when(when, F.lit(text)) for text, when in rules()), F.when(F.col("_same") > 1, F.lit("id repeats")))
    return sources.withColumn("_same", F.count("*").over(W.partitionBy("id"))).select("id", F.explode(F.filter(found, lambda p: p.isNotNull())).alias("problem"))


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SOURCE).json(path)


def save_sources(sources: DataFrame, path: str) -> None:
    """Refused if any entry has a problem.

    The registry is written aside and then takes the old one's place, so ``sources`` may have been read from ``path``,
    and a write that fails leaves the old registry.
    """
    bad = validate_sources(sources).limit(1).collect()
    require(not bad, f"{bad and bad[0]['id']}: {bad and bad[0]['problem']}", CatalogueError)
    spark, mark = sources.sparkSession, uuid.uuid4().hex
    aside, old = f"{path.rstrip('/')}.new-{mark}", f"{path.rstrip('/')}.old-{mark}"
    sources.coalesce(1).write.json(aside)
    jvm = spark.sparkContext._jvm
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    system = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = system.exists(place(path))
    require(not there or system.rename(place(path), place(old)), f"{path} can't be replaced", CatalogueError)
    require(system.rename(place(aside), place(path)), f"{path} can't be written; the old one is {old}", CatalogueError)
    if there:
        system.delete(place(old), True)
    spark.catalog.refreshByPath(path)


def update_source(sources: DataFrame, source_id: str, **fields) -> DataFrame:
    """The registry with some fields of one entry replaced."""
    kinds = dict(sources.dtypes)
    unknown = set(fields) - set(kinds)
    require(not unknown, f"unknown fields {sorted(unknown)}", CatalogueError)
    here = F.col("id") == source_id
    return sources.withColumns({k: F.when(here, F.lit(v).cast(kinds[k])).otherwise(F.col(k)) for k, v in fields.items()})


def log_fetch(spark: SparkSession, path: str, record: dict) -> None:
    """Append one record to a log of JSON lines."""
    names = [f.split()[0] for f in FETCH.split(", ")]
    spark.createDataFrame([tuple(record.get(n) for n in names)], FETCH).write.mode("append").json(path)


def transitions(sources: DataFrame, fetches: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """Every source after its last fetch that wasn't served from the cache: status, reason, notes and recorded file.

    A fetch without an error and with a digest verifies the entry and clears its reason. Any other appends a dated note,
    and lowers the status unless the recorded file is intact: ``digests`` (path, sha256) has it with the recorded digest.
    """
    facts = F.struct("url", "http_status", "error", "finished_at", "sha256", "bytes", "local_path")
    last = fetches.where(~F.coalesce("skipped_cached", F.lit(False))).groupBy("source_id").agg(F.max_by(facts, F.struct("finished_at", "http_status")).alias("f"))
    out = sources.join(last, F.col("id") == F.col("source_id"), "left")
    if digests is not None:
        files = digests.select(F.col("path").alias("local_path"), F.col("sha256").alias("_digest")).dropDuplicates(["local_path"])
        out = out.join(files, "local_path", "left").withColumn("_intact", F.coalesce(F.lower("_digest") == F.lower("sha256"), F.lit(False)))
    else:
        out = out.withColumn("_intact", F.lit(False))
    code, none = F.col("f.http_status"), F.col("f").isNull()
    good = F.col("f.error").isNull() & F.col("f.sha256").isNotNull()
    refused = F.coalesce(code.isin(*BLOCKING), F.lit(False))
    behind = F.coalesce((F.col("access") == "paywalled") & (code >= 400) & (code < 500) & (code != 404), F.lit(False))
    status = (
        F.when(none, F.col("status")).when(good, "verified").when(F.col("_intact"), F.col("status"))
        .when(refused | behind, "blocked").when(code == 404, "unverified").otherwise("partial")
    )
    said = F.concat(F.lit("HTTP "), F.coalesce(code.cast("string"), F.lit("None")))
    reason = F.when(none, F.col("blocked_reason")).when(good, F.lit(None)).when(F.col("_intact"), F.col("blocked_reason")).when(refused, said).when(behind, F.concat(said, F.lit(" (paywalled source)"))).otherwise(F.col("blocked_reason"))
    note = F.concat(F.coalesce("f.finished_at", F.lit("None")), F.lit(" "), F.coalesce("f.url", F.lit("None")), F.lit(": "), F.coalesce("f.error", said))
    before = F.trim(F.coalesce("notes", F.lit("")))
    notes = F.when(none | good, F.col("notes")).otherwise(F.when(before == "", note).otherwise(F.concat(before, F.lit("\n"), note)))
    taken = lambda c: F.when(F.coalesce(good & ~none, F.lit(False)), F.col(f"f.{c}")).otherwise(F.col(c)).alias(c)
    fetched = F.coalesce("f.finished_at", "fetched_at").alias("fetched_at")
    return out.select("id", "status", status.alias("new_status"), reason.alias("blocked_reason"), code.alias("http_status"), notes.alias("notes"), taken("sha256"), taken("bytes"), taken("local_path"), fetched)


def placement(responses: DataFrame) -> DataFrame:
    """What to do with a body, from (part_bytes, http_status, content_range): write, append, restart or refuse.

    A part is appended only where the local file ends and begins anew only at byte 0; a range that starts elsewhere, or that
    can't be read, is refused.
    """
    start = F.regexp_extract(F.coalesce("content_range", F.lit("")), r"^\s*bytes\s+(\d+)-(\d+)/(\d+|\*)\s*$", 1)
    begins = F.when(start != "", start.cast("long"))
    part = F.coalesce(F.col("http_status") == 206, F.lit(False))
    plan = F.when(F.col("http_status") == 200, "write").when(part & (F.col("part_bytes") > 0) & (begins == F.col("part_bytes")), "append").when(part & (begins == 0), "restart").otherwise("refuse")
    return responses.withColumn("plan", plan)


def size_errors(responses: DataFrame) -> DataFrame:
    """Whether a body of ``received`` bytes is empty or not as long as announced."""
    total = F.regexp_extract("content_range", r"/(\d+)$", 1)
    want = F.coalesce(F.when(total != "", total.cast("long")), F.col("content_length"))
    text = F.when(F.col("received") == 0, "the body is empty").when(want != F.col("received"), F.concat(F.lit("expected "), want.cast("string"), F.lit(" bytes, got "), F.col("received").cast("string")))
    return responses.withColumn("size_error", text)


def digest(content: Column | str) -> Column:
    """SHA-256 in lower-case hexadecimal digits; of a string its UTF-8 bytes."""
    return F.sha2(content, 256)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", digest("content").alias("sha256"))


def rate_audit(requests: DataFrame, host: Column, ts: str, per_second: float, order: str) -> DataFrame:
    """Per host: requests, and how many came sooner after the one before than the rate allows."""
    keyed = W.partitionBy("host").orderBy(ts, order)
    rows = requests.select(host.alias("host"), ts, order)
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    gap = seconds(ts) - F.lag(seconds(ts)).over(keyed)
    return rows.select("host", gap.alias("gap")).groupBy("host").agg(F.count("*").alias("requests"), F.count(F.when(F.col("gap") < 1.0 / per_second, 1)).alias("too_soon"))


class RateLimiter:
    """A token bucket; ``wait`` returns the seconds slept."""

    def __init__(self, per_second: float, burst: int = 1, clock=time.monotonic, sleep=time.sleep):
        require(per_second > 0 and burst >= 1, "need a positive rate and a burst of one at least")
        self.rate, self.burst, self.clock, self.sleep = per_second, burst, clock, sleep
        self.tokens, self.at, self.lock = float(burst), clock(), threading.Lock()

    def wait(self) -> float:
        with self.lock:
            t = self.clock()
            self.tokens = min(self.burst, self.tokens + (t - self.at) * self.rate)
            self.at = t
            pause = max(0.0, (1 - self.tokens) / self.rate)
            self.tokens -= 1
        if pause:
            self.sleep(pause)
        return pause


_limiters: dict[str, RateLimiter] = {}


def limiter_for(url: str, per_second: float = 1.0) -> RateLimiter:
    return _limiters.setdefault(urllib.parse.urlsplit(url).netloc.lower(), RateLimiter(per_second))


def reset_limiters() -> None:
    _limiters.clear()


def plan_acquisition(sources: DataFrame, acquirers: list[str], only: list[str] | None = None) -> DataFrame:
    """(id, attempt, reason): which sources can be fetched now, and why others can't."""
    known = F.coalesce(F.col("id").isin(*acquirers), F.lit(False)) if acquirers else F.lit(False)
    reason = (
        F.when(~F.col("id").isin(*only), "not asked for") if only else F.when(F.lit(False), "")
    ).when(F.col("status") == "blocked", F.concat(F.lit("blocked: "), F.coalesce("blocked_reason", F.lit("no reason given")))).when(F.col("access").isin(*OFFLINE), "not on the net").when(~known, "no acquirer")
    return sources.select("id", reason.isNull().alias("attempt"), reason.alias("reason"))


def load_config(spark: SparkSession, *paths: str) -> dict:
    """TOML settings, later files overriding earlier ones key by key."""
    import tomllib

    def merge(a: dict, b: dict) -> dict:
        return a | {k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    out: dict = {}
    for path in paths:
        out = merge(out, tomllib.loads(spark.read.text(path, wholetext=True).first()["value"]))
    return out


def require_contact(config: dict) -> str:
    """The contact that requests name; a placeholder is refused."""
    contact = str(config.get("http", {}).get("contact", ""))
    if "@" not in contact or "example" in contact:
        raise AnalysisError("set http.contact before fetching anything")
    return contact


def main(arguments: list[str] | None = None) -> int:
    """validate | status | sha256 PATH"""
    import sys

    command, path = (arguments or sys.argv[1:])[:2]
    spark = SparkSession.builder.getOrCreate()
    if command == "sha256":
        rows = file_digests(spark, path)
    else:
        sources = load_sources(spark, path)
        rows = validate_sources(sources) if command == "validate" else sources.groupBy("status").count().orderBy("status")
    found = rows.collect()
    for r in found:
        print(json.dumps(r.asDict()))
    return int(command == "validate" and bool(found))


if __name__ == "__main__":
    raise SystemExit(main())
