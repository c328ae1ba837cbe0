"""File sources and sinks: image listings, decoded images, array files, JSON documents, logs, stage outputs."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted image extensions.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "tiff", "webp"]
ARRAY_SCHEMA = "path string, h int, w int, px array<float>"
LOG_SCHEMA = ("ts timestamp, component string, operation string, duration_ms double, memory_mb double, gpu_mb double, "
              "cpu_percent double, error_occurred boolean, error_message string")
STAGE_SCHEMA = ("stage_name string, timestamp string, status string, data struct<processed_items:bigint,"
                "quality_scores:array<double>,output_paths:array<string>>, metadata struct<test:boolean,"
                "processing_time_seconds:double>, _corrupt_record string")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does a path (of any file system Spark knows) exist."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the paths that a glob pattern finds."""
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return [f.getPath().getName() for f in found or []]


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library has written, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scan_files(spark: SparkSession, path: str, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """Files below ``path`` with an accepted extension (any case); contents are not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path) \
        .select("path", "modificationTime", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return listing.withColumn("ext", ext).filter(F.col("ext").isin(list(extensions)))


def scan_images(spark: SparkSession, path: str, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """Decoded size, channels and bytes of the image files below ``path``; unreadable files have ``is_corrupted``.

    One scan: size and time of a file come with the decoded image, and only files with an accepted extension are
    opened. WebP has no decoder in the JVM and is reported as unreadable.
    """
    # a glob knows no case, so each letter is given both ways
    both = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions)
    decoded = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True) \
        .option("pathGlobFilter", f"*.{{{both}}}").load(path)
    size = F.col("image.height")
    return decoded.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modificationTime"),
        F.col("_metadata.file_size").alias("length"), F.lower(F.regexp_extract("_metadata.file_path", r"\.([^./]+)$", 1)).alias("ext"),
        F.when(size > 0, size).alias("h"), F.when(size > 0, F.col("image.width")).alias("w"),
        F.when(size > 0, F.col("image.nChannels")).alias("channels"), F.when(size > 0, F.col("image.data")).alias("data"),
        F.coalesce(size <= 0, F.lit(True)).alias("is_corrupted"))


def planes(df: DataFrame) -> DataFrame:
    """Colour planes ``r, g, b`` (row-major doubles) of decoded images; grey images have three equal planes.

    Bytes become numbers in Arrow batches; nothing is shuffled.
    """
    keep = [f for f in df.schema.fields if f.name != "data"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep]
                       + ["r array<double>", "g array<double>", "b array<double>"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {f.name: batch.column(f.name) for f in keep}
            out = {"r": [], "g": [], "b": []}
            for data, n in zip(batch.column("data"), batch.column("channels")):
                n = n.as_py()
                raw = None if n is None or n <= 0 or not data.is_valid else np.frombuffer(data.as_py(), np.uint8).reshape(-1, n)
                for name, i in (("b", 0), ("g", 1), ("r", 2)):      # decoded bytes are blue first
                    out[name].append(None if raw is None else raw[:, i if n >= 3 else 0].astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                list(cols.values()) + [pa.array(v, pa.list_(pa.float64())) for v in out.values()],
                names=list(cols) + list(out))
    return df.mapInArrow(split, schema)


def scan_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Two-dimensional ``.npy`` arrays as ``(path, h, w, px)``; other, broken or pickled content gives nulls."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy") \
        .load(path).select("path", "content")

    def read(content: bytes) -> np.ndarray | None:
        try:
            found = np.load(io.BytesIO(content), allow_pickle=False)
            return found.astype(np.float32) if isinstance(found, np.ndarray) and found.ndim == 2 else None
        except (ValueError, EOFError, OSError, TypeError):
            return None

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [read(c.as_py()) for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([
                batch.column("path"), pa.array([None if a is None else a.shape[0] for a in arrays], pa.int32()),
                pa.array([None if a is None else a.shape[1] for a in arrays], pa.int32()),
                pa.array([None if a is None else a.ravel() for a in arrays], pa.list_(pa.float32()))],
                names=["path", "h", "w", "px"])
    return raw.mapInArrow(decode, ARRAY_SCHEMA)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Multi-line JSON documents with a fixed schema; an empty table where the path does not exist."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def valid_stage_docs(df: DataFrame, stage: Column) -> DataFrame:
    """Add ``is_valid``: required keys, the expected stage, completed, a readable time and data."""
    ok = (F.col("stage_name").isNotNull() & F.col("data").isNotNull() & (F.col("stage_name") == stage)
          & (F.col("status") == "completed") & F.try_to_timestamp(F.col("timestamp")).isNotNull())
    return df.withColumn("is_valid", F.coalesce(ok, F.lit(False)))


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a result table as Parquet, JSON lines or text holding one JSON object per row."""
    if fmt == "text":
        df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
    elif fmt in ("parquet", "json"):
        df.write.mode("overwrite").format(fmt).save(path)
    else:
        raise ValueError(f"unknown report format {fmt!r}")


def read_log(spark: SparkSession, path: str, stream: bool = False, schema: str = LOG_SCHEMA) -> DataFrame:
    """JSON-lines telemetry log, as a table or a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).json(path)


def save_stage(df: DataFrame, root: str, stage: str) -> None:
    """Write a stage's output; Spark leaves a ``_SUCCESS`` marker when all of it is there."""
    df.write.mode("overwrite").parquet(f"{root}/{stage}")


def completed_stages(spark: SparkSession, root: str) -> DataFrame:
    """Stages below ``root`` whose output is complete."""
    if not path_exists(spark, root):
        return spark.createDataFrame([], "stage string")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/_SUCCESS")
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder)
    return spark.createDataFrame([(f.getPath().getParent().getName(),) for f in found or []], "stage string")


def ready_batch(df: DataFrame) -> DataFrame:
    """Paths handed to the next stage: the valid inputs only."""
    return df.filter("valid").select("path")
