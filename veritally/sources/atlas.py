"""Power atlases as Parquet: saved with their settings, published after checks, looked up without guessing.

A folder of atlases (``*.parquet``, each a file or a folder of part files) is one table with the name of its atlas in every row; what is
checked and told apart are groups of that table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..core.errors import AtlasError, require
from ..operators.power import SEMANTICS, detectable, minimum_detectable_effect

COLUMNS = ("method", "n", "effect_size", "power", "power_se", "n_replicates", "alpha", "false_positive_rate")


def save_atlas(atlas: DataFrame, path: str, spec: dict | None = None) -> None:
    atlas.withColumn("_spec", F.lit(json.dumps(spec or {}, sort_keys=True))).coalesce(1).write.mode("overwrite").parquet(path)


def load_atlas(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The atlas without its settings, and the settings."""
    rows = spark.read.parquet(path)
    if "_spec" not in rows.columns:
        return rows, {}
    first = rows.select("_spec").first()
    return rows.drop("_spec"), json.loads(first["_spec"] or "{}") if first else {}


def from_ladder(ladder: DataFrame, rung: str, semantics: str, method: str) -> DataFrame:
    """One rung of an aggregation ladder in the columns of an atlas."""
    rows = ladder.where((F.col("level") == rung) & (F.col("semantics") == semantics))
    return rows.select(F.lit(method).alias("method"), F.col("n_units").alias("n"), *COLUMNS[2:])


def publish_atlas(frame: DataFrame, path: str, method: str, aggregation: str, semantics: str | None = None, seed: int | None = None, settings: dict | None = None) -> None:
    """Check everything, then write; a ladder is reduced to the rung named by ``aggregation``."""
    if "level" in frame.columns:
        require(semantics in SEMANTICS, f"a ladder needs semantics among {SEMANTICS}", AtlasError)
        rungs = {r["level"] for r in frame.select("level").distinct().collect()}
        require(aggregation in rungs, f"no rung {aggregation!r}; there are {sorted(rungs)}", AtlasError)
        held = {r["semantics"] for r in frame.where(F.col("level") == aggregation).select("semantics").distinct().collect()}
        require(semantics in held, f"rung {aggregation!r} was measured for {sorted(held)}, not {semantics!r}", AtlasError)
        stated = (settings or {}).get("semantics", semantics)
        require(stated == semantics, f"the settings say {stated!r}, but {semantics!r} is published", AtlasError)
        sizes = frame.where((F.col("level") == aggregation) & (F.col("semantics") == semantics)).agg(F.max("mean_group_size")).first()[0]
        settings = {"mean_group_size": sizes, **(settings or {})}
        frame = from_ladder(frame, aggregation, semantics, method)
    else:
        require(aggregation == "unit", f"a frame without levels is a curve of units, not of {aggregation!r}", AtlasError)
    missing = set(COLUMNS) - set(frame.columns)
    require(not missing, f"columns are missing: {sorted(missing)}", AtlasError)
    facts = frame.agg(F.collect_set("method").alias("methods"), F.countDistinct("alpha").alias("alphas"), F.count("*").alias("n")).first()
    require(facts["n"] > 0, "the atlas is empty", AtlasError)
    require(facts["methods"] == [method], f"the atlas is of {sorted(facts['methods'])}, not {method!r}", AtlasError)
    require(facts["alphas"] == 1, "the atlas mixes levels of alpha", AtlasError)
    save_atlas(frame.select(*COLUMNS), path, {"method": method, "aggregation": aggregation, "semantics": semantics, "seed": seed, "settings": settings or {}, "library_version": __version__})


def read_atlases(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the atlases of a folder, with ``_atlas`` (the name of the file or part folder) and ``_spec``. Folders within are not looked into."""
    rows = spark.read.option("recursiveFileLookup", "false").option("mergeSchema", "true").parquet(f"{folder.rstrip('/')}/*.parquet")
    require({*COLUMNS, "_spec"} <= set(rows.columns), f"{folder} holds atlases without settings", AtlasError)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+\.parquet)(/[^/]*)?$", 1)
    return rows.select(name.alias("_atlas"), "_spec", *COLUMNS)


def atlas_table(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each atlas of a folder: its name, method, aggregation, semantics, seed, version, rows, sizes, effects, and fingerprint.

    Equal fingerprints are the same atlas under two names. ``problem`` says what is wrong with one: rows that disagree on the settings, no settings or
    no version, a method in the rows that isn't that of the settings.
    """
    spec = F.from_json("_spec", "method string, aggregation string, semantics string, seed long, library_version string")
    rows = read_atlases(spark, folder).withColumn("spec", spec).withColumn("row", F.xxhash64(*COLUMNS).cast("decimal(38,0)"))
    out = rows.groupBy("_atlas").agg(
        F.min("_spec").alias("settings"), F.max("_spec").alias("other"), F.count_if(F.col("_spec").isNull()).alias("bare"), F.count("*").alias("n_rows"), F.sort_array(F.collect_set("n")).alias("sample_sizes"),
        F.sort_array(F.collect_set("effect_size")).alias("effect_sizes"), F.min("spec").alias("s"), F.sum("row").alias("h"), F.min("method").alias("low"), F.max("method").alias("high"), F.countDistinct("alpha").alias("alphas"),
    )
    problem = (
        F.when((F.col("settings") != F.col("other")) | ((F.col("bare") > 0) & F.col("settings").isNotNull()), "its rows disagree on the settings")
        .when(F.coalesce("s.library_version", F.lit("")) == "", "it has no settings or version")
        .when((F.col("low") != F.col("high")) | (F.col("low") != F.col("s.method")), "its rows are of another method")
        .when(F.col("alphas") != 1, "it mixes levels of alpha")
    )
    fingerprint = F.sha2(F.concat_ws(":", "settings", F.col("h").cast("string")), 256)
    return out.select(F.col("_atlas").alias("atlas"), "s.method", "s.aggregation", "s.semantics", "s.seed", "s.library_version", "n_rows", "sample_sizes", "effect_sizes", fingerprint.alias("fingerprint"), problem.alias("problem"), "settings")


class PowerLookup:
    """Published atlases by method and rung, from paths of single ones, or with ``folder`` all of a folder; equal ones count once."""

    def __init__(self, spark: SparkSession, paths: str | Sequence[str] = (), folder: str | None = None):
        self.entries: dict[str, tuple[DataFrame, dict]] = {}
        for path in [paths] if isinstance(paths, str) else paths:
            rows, spec = load_atlas(spark, path)
            require(bool(spec.get("library_version")), f"{path} has no settings or version", AtlasError)
            total = rows.agg(F.sum(F.xxhash64(*COLUMNS).cast("decimal(38,0)")).alias("h")).first()["h"]
            self.entries[f"{json.dumps(spec, sort_keys=True)}:{total}"] = (rows, spec)
        if folder is not None:
            listed = atlas_table(spark, folder).collect()  # a row for each atlas
            bad = [r for r in listed if r["problem"]]
            require(not bad, "; ".join(f"{r['atlas']}: {r['problem']}" for r in bad), AtlasError)
            every = read_atlases(spark, folder)
            for r in listed:
                self.entries.setdefault(r["fingerprint"], (every.where(F.col("_atlas") == r["atlas"]).drop("_atlas", "_spec"), json.loads(r["settings"])))

    def __len__(self) -> int:
        return len(self.entries)

    def methods(self) -> list[str]:
        return sorted({s["method"] for _, s in self.entries.values()})

    def rungs(self, method: str | None = None) -> list[str]:
        return sorted({s["aggregation"] for _, s in self.entries.values() if method in (None, s["method"])})

    def select(self, method: str, aggregation: str | None = None) -> DataFrame:
        found = [(rows, s) for rows, s in self.entries.values() if s["method"] == method and aggregation in (None, s["aggregation"])]
        cited = "; ".join(cite(s) for _, s in found)
        require(len(found) == 1, f"{len(found)} atlases match method {method!r} and aggregation {aggregation!r}{': ' * bool(cited)}{cited}", AtlasError)
        return found[0][0]

    def minimum_detectable_effect(self, method: str, n: int, aggregation: str | None = None, target_power: float = 0.8) -> float:
        row = minimum_detectable_effect(self.select(method, aggregation).where(F.col("n") == n), target_power).first()
        require(row is not None, f"n = {n} wasn't measured", AtlasError)
        require(row["status"] == "ok", row["status"], AtlasError)
        return row["minimum_detectable_effect"]

    def detectable(self, method: str, n: int, effect: float, aggregation: str | None = None) -> bool:
        row = detectable(self.select(method, aggregation).where(F.col("n") == n), effect).first()
        return bool(row and row["detectable"])

    def describe(self) -> str:
        return "\n".join(cite(s) for _, s in self.entries.values())


def cite(spec: dict) -> str:
    """An atlas in one line."""
    seed = "" if spec.get("seed") is None else f", seed {spec['seed']}"
    return f"{spec['method']} ({spec['aggregation']}), version {spec['library_version']}{seed}"
