"""Reading and writing flow tables: CSV folders, Parquet splits, CSV reports, JSON batches."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlark.functions import fixed

MAX_FLOWS = 5000
WINDOW_MINUTES = 5
OPEN_AT_ONCE = 16


def _list_files(spark: SparkSession, folder: str, ending: str) -> list[str]:
    """File names of a folder on any file system Spark can reach, sorted."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().toString() for s in system.listStatus(path)]
    return sorted(n for n in names if n.lower().endswith(ending))


def flow_schema(features: list[str] = fixed.FLOW_FEATURES, label: str = "Label") -> T.StructType:
    fields = [T.StructField(f, T.DoubleType()) for f in features]
    return T.StructType([*fields, T.StructField(label, T.StringType())])


def _first_line(spark: SparkSession, name: str) -> str | None:
    """The first line of a file that is not blank, or None."""
    io, path = spark._jvm.java.io, spark._jvm.org.apache.hadoop.fs.Path(name)
    lines = io.BufferedReader(io.InputStreamReader(path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path), "UTF-8"))
    try:
        line = lines.readLine()
        while line is not None and not line.strip():
            line = lines.readLine()
        return line
    finally:
        lines.close()


def files_by_header(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """Files by their first line, found by opening each; no Spark job runs, and files without a line are left out."""
    with ThreadPool(OPEN_AT_ONCE) as pool:
        lines = pool.map(lambda name: _first_line(spark, name), files)
    found: dict[str, list[str]] = {}
    for name, line in zip(files, lines):
        if line is not None:
            found.setdefault(line, []).append(name)
    return found


def ingest_csv(spark: SparkSession, folder: str, dataset: str, schema: T.StructType | None = None) -> DataFrame:
    """All CSV files of a folder as one table, with `dataset` and `source_file`.

    Header names lose their outer blanks and columns are matched by name. Files with the
    same header line are read together in one scan, so jobs grow with the different headers and not with the files; a
    column a file lacks is null, and an empty file gives no rows. A given schema sets the types; without one every column
    is text. `Infinity` reads as infinite.
    """
    files = _list_files(spark, folder, ".csv")
    if not files:
        raise FileNotFoundError(f"no CSV files in {folder}")
    parts = []
    for names in files_by_header(spark, files).values():
        header = spark.read.csv(names[0], header=True).columns  # reads one line
        trimmed = [h.strip() for h in header]
        wanted = {f.name: f.dataType for f in schema.fields} if schema else {}
        as_read = T.StructType([T.StructField(h, wanted.get(t, T.StringType())) for h, t in zip(header, trimmed)])
        rows = spark.read.csv(
            names, header=True, schema=as_read, enforceSchema=True, positiveInf="Infinity", negativeInf="-Infinity", nanValue="NaN"
        )
        file_name = F.col("_metadata.file_name")
        rows = rows.select(*[F.col("`" + h.replace("`", "``") + "`").alias(t) for h, t in zip(header, trimmed)], file_name.alias("source_file"))
        parts.append(rows.withColumn("dataset", F.lit(dataset)))
    if not parts:
        own = [T.StructField(name, T.StringType()) for name in ("source_file", "dataset")]
        return spark.createDataFrame([], T.StructType([*(schema.fields if schema else []), *own]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def write_splits(df: DataFrame, folder: str) -> None:
    """One Parquet table partitioned by split, so a reader of one split opens only its files."""
    df.write.mode("overwrite").partitionBy("split").parquet(folder)


def read_split(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    rows = spark.read.parquet(folder)
    return rows if split is None else rows.filter(F.col("split") == split)


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def write_report(df: DataFrame, folder: str) -> None:
    """A report as CSV files with a header line, written by many tasks."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(folder)


def read_report(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(folder)


FLOW_JSON = (
    "flow_id string, src_ip string, dst_ip string, src_port string, dst_port string, protocol string, duration string, "
    "total_packets string, total_bytes string, packets_src_to_dst string, packets_dst_to_src string, "
    "bytes_src_to_dst string, bytes_dst_to_src string, packet_rate string, byte_rate string, avg_packet_size string, "
    "tcp_flags string, label string, timestamp string, sensor_id string, asset_id string, hostname string, username string"
)


def batch_problem(payload: Column, limit: int = MAX_FLOWS) -> Column:
    """Why a JSON batch is refused, or null. A batch without `flows` counts as empty."""
    size = F.json_array_length(F.get_json_object(payload, "$.flows"))
    named = F.coalesce(F.array_contains(F.json_object_keys(payload), "flows"), F.lit(False))
    return (
        F.when(named & size.isNull(), "'flows' must be a JSON array.")
        .when(F.coalesce(size, F.lit(0)) == 0, "'flows' must contain at least one entry.")
        .when(size > limit, F.lit(f"Batch too large. Maximum {limit} flows per request."))
    )


def batch_validate(batches: DataFrame, payload: str = "payload", limit: int = MAX_FLOWS) -> DataFrame:
    """Adds `reason`: null for good batches. Filter on it for the good and the refused ones."""
    return batches.withColumn("reason", batch_problem(F.col(payload), limit))


def flow_batches(batches: DataFrame, keys: list[str], payload: str = "payload", schema: str = FLOW_JSON) -> DataFrame:
    """One row per flow of every JSON batch: keys, row_index, window_minutes and the flow fields.

    A batch holds at most 5,000 flows, so one exploded row stays small.
    """
    shape = f"flows array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in schema.split(','))}>>, correlation_window_minutes int"
    parsed = batches.withColumn("__p", F.from_json(F.col(payload), shape))
    minutes = F.coalesce(F.nullif(F.col("__p.correlation_window_minutes"), F.lit(0)), F.lit(WINDOW_MINUTES))
    return parsed.select(*keys, minutes.alias("window_minutes"), F.posexplode("__p.flows").alias("row_index", "__f")).select(
        *keys, "window_minutes", "row_index", "__f.*"
    )


PACKETS = (
    "packet_id bigint, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
    "pkt_len int, tcp_flags string, header_len int, window_size int, payload_len int"
)


def packet_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Packet rows as a stream from a folder of Parquet files. Only TCP and UDP rows pass."""
    reader = spark.readStream.schema(PACKETS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).filter(F.col("protocol").isin("TCP", "UDP"))


