"""Notch catalogues: validated rows, and a scan of a table's columns for every entry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..core.errors import CatalogueError, require
from ..operators.bunching import Kink, Notch, Window, bin_counts, bunching

SCHEMA = "id string, variable string, threshold double, kind string, side string, incentive string, evidence string, confounds array<string>, status string, notes string"
KINDS, SIDES, STATUSES = ("notch", "kink"), ("above", "below"), ("verified", "unverified")


def load_notches(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue in JSON, or in YAML where a YAML library is installed; ids must not repeat."""
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as missing:
            raise CatalogueError("reading YAML needs the yaml library") from missing
        text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
        listed = yaml.safe_load(text) or []
        listed = listed.get("notches", []) if isinstance(listed, dict) else listed
        rows = spark.createDataFrame([tuple(e.get(f.split()[0]) for f in SCHEMA.split(", ")) for e in listed], SCHEMA)
    else:
        rows = spark.read.schema(SCHEMA).json(path, multiLine=True)
    repeated = rows.groupBy("id").count().where("count > 1").limit(1).collect()
    require(not repeated, f"id {repeated and repeated[0]['id']!r} repeats", CatalogueError)
    return rows


def rules() -> list[tuple[str, str, Column]]:
    """Severity, what is wrong, and when."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    outside = lambda c, allowed: ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    return [
        *(("error", f"{c} is missing", empty(c)) for c in ("id", "variable", "incentive", "evidence")),
        ("error", "threshold is not a number", F.col("threshold").isNull() | F.isnan("threshold")),
        ("error", "kind is unknown", outside("kind", KINDS)),
        ("error", "side is unknown", F.col("side").isNotNull() & outside("side", SIDES)),
        ("error", "status is unknown", F.col("status").isNotNull() & outside("status", STATUSES)),
        ("warning", "no confounds are listed", F.coalesce(F.size("confounds"), F.lit(0)) <= 0),
    ]


def to_notch(entry: Row | dict) -> Notch | Kink:
    """The threshold of an entry as the estimators take it, with its id as label."""
    e = entry.asDict() if isinstance(entry, Row) else entry
    kind, side = e.get("kind") or KINDS[0], e.get("side") or SIDES[0]
    require(kind in KINDS, f"kind is unknown: {kind!r}", CatalogueError)
    require(e.get("threshold") is not None, f"entry {e.get('id')!r} has no threshold", CatalogueError)
    return Kink(float(e["threshold"]), e["id"]) if kind == "kink" else Notch(float(e["threshold"]), side, e["id"])


def validate_notches(catalogue: DataFrame) -> DataFrame:
    """All problems at once: (id, severity, problem)."""
    found = F.array(*(F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(text).alias("problem"))) for severity, text, when in rules()))
    return catalogue.select("id", F.explode(F.filter(found, lambda p: p.isNotNull())).alias("p")).select("id", "p.severity", "p.problem")


def scan_all(df: DataFrame, catalogue: DataFrame, window: Window, skip_out_of_range: bool = True) -> DataFrame:
    """Every entry whose variable is a column: its fit, by normalised excess downwards.

    Columns are stacked and joined with the catalogue by name. Entries beyond the column's values are
    skipped, or refused.
    """
    names = [r["variable"] for r in catalogue.select("variable").distinct().collect() if r["variable"] in df.columns]
    require(bool(names), "no entry names a column", CatalogueError)
    pairs = ", ".join(f"'{n}', cast(`{n}` as double)" for n in names)
    values = df.select(F.expr(f"stack({len(names)}, {pairs}) as (variable, x)"))
    spans = values.where("x is not null and not isnan(x)").groupBy("variable").agg(F.min("x").alias("least"), F.max("x").alias("most"))
    inside = F.col("threshold").between(F.col("least"), F.col("most"))
    entries = catalogue.join(spans, "variable").select("id", "variable", "threshold", "kind", "side", inside.alias("inside"))
    if not skip_out_of_range:
        entries = entries.withColumn("threshold", F.when(F.col("inside"), F.col("threshold")).otherwise(F.raise_error(F.lit("a threshold lies beyond its column")).cast("double")))
    rows = values.join(F.broadcast(entries.where("inside")), "variable")  # the catalogue is a driver-side list
    counts = bin_counts(rows, "x", F.col("threshold"), window.bin_width, ["id", "variable", "threshold", "kind"])
    return bunching(counts, window, ["id", "variable", "threshold", "kind"]).orderBy(F.col("normalized_excess").desc_nulls_last(), "id")


def in_range(df: DataFrame, value: str, thresholds: Sequence[float]) -> DataFrame:
    """Which thresholds lie among the finite values of a column."""
    x = F.col(value).cast("double")
    span = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).agg(F.min(x).alias("least"), F.max(x).alias("most"))
    return span.select(F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"), "least", "most").select("threshold", F.coalesce(F.col("threshold").between(F.col("least"), F.col("most")), F.lit(False)).alias("in_range"))
