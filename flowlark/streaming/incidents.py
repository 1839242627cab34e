"""Incidents on a stream of alerts.

Doubles are dropped by alert id, so a busy incident's alerts spread over all tasks; the
incident itself is one aggregate row of state, fed by map-side partial rows. State goes
when the watermark (event time minus the retention) has passed the hour of the bucket, in
place of a wall clock.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlark.operators.incidents import KEYS, finish_headers, header_aggregates, with_incident
from flowlark.session import folder_names, remove_folder
from flowlark.streaming.run import drain_batches

COMPACT_EVERY = 20


def incident_updates(alerts: DataFrame, minutes: int = 5, retention_minutes: int = 60) -> DataFrame:
    """Headers of the incidents each micro-batch changed; run in update mode."""
    marked = alerts.withWatermark("timestamp", f"{retention_minutes} minutes")
    once = marked.dropDuplicatesWithinWatermark(["alert_id"])
    keyed = with_incident(once, minutes)
    groups = keyed.groupBy(F.window("timestamp", "1 hour").alias("hour"), "incident_id", *KEYS).agg(*header_aggregates())
    return finish_headers(groups, minutes)


def write_incident_updates(updates: DataFrame, out: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> None:
    """Each micro-batch overwrites its own part of `out`, so a repeated batch changes nothing; every so many are compacted."""

    def step(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        if epoch % compact_every == compact_every - 1:
            compact_incidents(batch.sparkSession, out, epoch)

    drain_batches(updates, step, checkpoint, "update")


def _numbered(names: list[str], prefix: str) -> list[int]:
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def _bases(spark: SparkSession, out: str) -> list[int]:
    """Epochs up to which a finished base exists, in order; a base is finished by the marker its write ends with."""
    found = _numbered(folder_names(spark, f"{out}/base"), "upto=")
    return [b for b in found if "_SUCCESS" in folder_names(spark, f"{out}/base/upto={b}")]


def _latest(spark: SparkSession, out: str, until: int | None = None) -> DataFrame | None:
    """The latest header of each incident with its epoch: the newest base and the epochs after it."""
    bases = [b for b in _bases(spark, out) if until is None or b <= until]
    after = [e for e in _numbered(folder_names(spark, out), "epoch=") if (not bases or e > bases[-1]) and (until is None or e <= until)]
    parts = []
    if bases:
        parts.append(spark.read.parquet(f"{out}/base/upto={bases[-1]}"))
    if after:
        read = spark.read.option("basePath", out).parquet(*[f"{out}/epoch={e}" for e in after])
        parts.append(read.withColumn("epoch", F.col("epoch").cast("bigint")))
    if not parts:
        return None
    rows = reduce(DataFrame.unionByName, parts)
    names = [c for c in rows.columns if c not in ("epoch", "incident_id")]
    newest = rows.groupBy("incident_id").agg(F.max_by(F.struct(*names), "epoch").alias("r"), F.max("epoch").alias("epoch"))
    return newest.select("incident_id", "r.*", "epoch")


def compact_incidents(spark: SparkSession, out: str, epoch: int) -> None:
    """Writes a base with the latest header of each incident up to an epoch, then removes what the base before it replaced.

    Readers go over to the new base when its write is finished. What it replaces itself stays until the next
    compaction, so a reader that has begun still finds its files; a repeated compaction changes nothing.
    """
    before = [b for b in _bases(spark, out) if b < epoch]
    if epoch not in _bases(spark, out):
        rows = _latest(spark, out, epoch)
        if rows is None:
            return
        rows.write.mode("overwrite").parquet(f"{out}/base/upto={epoch}")
    if before:
        for old in before[:-1]:
            remove_folder(spark, f"{out}/base/upto={old}")
        for old in _numbered(folder_names(spark, out), "epoch="):
            if old <= before[-1]:
                remove_folder(spark, f"{out}/epoch={old}")


def current_incidents(spark: SparkSession, out: str) -> DataFrame:
    """The latest header of each incident."""
    rows = _latest(spark, out)
    if rows is None:
        raise FileNotFoundError(f"no incidents in {out}")
    return rows.drop("epoch")
