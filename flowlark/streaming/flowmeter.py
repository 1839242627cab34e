"""Flow metering on a stream of packets, with a state of one row for each open flow.

A micro-batch takes the packets up to its watermark, in time order after all earlier ones. What
those left behind is two small rows: for each 5-tuple the carry that a time slice hands to the next
(so one hot 5-tuple is split over many tasks here too), and for each open flow the sums and extremes of
its packets, to which those of the batch are added. Packets inside the allowed delay wait, as
earlier ones may still come. Flows idle at the watermark come out. All outputs are written per
epoch, so a repeated batch gives the same files; the state before the last but one epoch is removed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlark.operators import flowmeter as M
from flowlark.session import cut_lineage, remove_folder
from flowlark.sources.flow_files import PACKETS
from flowlark.streaming.run import drain_batches

COLUMNS = [part.split()[0] for part in PACKETS.split(", ")]
PARTS = ("carry", "flows", "waiting")


def _kept(spark: SparkSession, state: str, part: str, epoch: int) -> DataFrame | None:
    return None if epoch < 0 else spark.read.parquet(f"{state}/{part}/epoch={epoch}")


def _clock(spark: SparkSession, state: str, epoch: int) -> int | None:
    """Greatest event time seen up to an epoch, in microseconds."""
    if epoch < 0:
        return None
    return spark.read.parquet(f"{state}/clock/epoch={epoch}").first()["seen_us"]


def _together(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if old is None else old.unionByName(new)


def _advance(spark: SparkSession, state: str, epoch: int, packets: DataFrame, limits: dict) -> tuple[DataFrame, DataFrame]:
    """Carry and flows after these packets, which come after all that the state of `epoch` holds."""
    shares, carry = M.shares_after(packets, _kept(spark, state, "carry", epoch), **limits)
    flows = M.merged_partials(_together(_kept(spark, state, "flows", epoch), M.flow_partials(shares)))
    return carry, flows


def meter_step(batch: DataFrame, epoch: int, out: str, state: str, delay_seconds: float, limits: dict) -> None:
    spark = batch.sparkSession
    delay = int(delay_seconds * 1_000_000)
    idle = int(limits.get("idle_timeout", 5.0) * 1_000_000)
    before = _clock(spark, state, epoch - 1)
    us = F.unix_micros("ts")
    late = F.lit(False) if before is None else us < before - delay
    seen = batch.agg(F.max(us).alias("m"), F.count(F.when(late, 1)).alias("n_late")).first()
    now = max((v for v in (before, seen["m"]) if v is not None), default=None)
    mark = -1 if now is None else now - delay

    pool = _together(_kept(spark, state, "waiting", epoch - 1), batch.filter(~late).select(*COLUMNS))
    ready = us < mark
    carry, flows = _advance(spark, state, epoch - 1, pool.filter(ready), limits)
    flows = cut_lineage(flows)
    ended = F.col("last_us") <= mark - idle
    M.features_of_flows(M.finished_flows(flows.filter(ended))).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    flows.filter(~ended).write.mode("overwrite").parquet(f"{state}/flows/epoch={epoch}")
    carry.filter(F.col("last") > mark - idle).write.mode("overwrite").parquet(f"{state}/carry/epoch={epoch}")
    pool.filter(~ready).write.mode("overwrite").parquet(f"{state}/waiting/epoch={epoch}")
    row = spark.range(1).select(F.lit(now).cast("bigint").alias("seen_us"), F.lit(seen["n_late"]).cast("bigint").alias("n_late"))
    row.write.mode("overwrite").parquet(f"{state}/clock/epoch={epoch}")
    # A repeated batch reads the epoch before; what lies further back is done with.
    for part in PARTS:
        remove_folder(spark, f"{state}/{part}/epoch={epoch - 2}")


def last_epoch(spark: SparkSession, state: str) -> int:
    """The last epoch in the state folder, -1 if there is none."""
    try:
        return spark.read.option("basePath", f"{state}/clock").parquet(f"{state}/clock/epoch=*").agg(F.max("epoch")).first()[0]
    except AnalysisException:  # no epoch was ever written
        return -1


def meter_stream(packets: DataFrame, out: str, state: str, checkpoint: str, delay_seconds: float = 0.0, **limits) -> int:
    """Meters all available packets; returns the last epoch of the state, for `flush`, also when a restart finds nothing new."""

    def step(batch: DataFrame, epoch: int) -> None:
        meter_step(batch, epoch, out, state, delay_seconds, limits)

    drain_batches(packets, step, checkpoint)
    return last_epoch(packets.sparkSession, state)


def flush(spark: SparkSession, out: str, state: str, epoch: int, **limits) -> None:
    """Writes the flows still open, as stopping the capture does."""
    waiting = _kept(spark, state, "waiting", epoch)
    if waiting is not None:
        _, flows = _advance(spark, state, epoch, waiting, limits)
        M.features_of_flows(M.finished_flows(flows)).write.mode("overwrite").parquet(f"{out}/epoch={epoch + 1}")


def late_packets(spark: SparkSession, state: str) -> DataFrame:
    """Packets dropped for coming after the watermark, per epoch."""
    return spark.read.option("basePath", f"{state}/clock").parquet(f"{state}/clock/epoch=*").select("epoch", "n_late")
