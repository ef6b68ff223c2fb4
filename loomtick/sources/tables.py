"""Readers of streams and tables, and writers that publish several outputs together."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv", "text", "binaryFile")


def read(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A table by format; text formats take a schema and are not scanned for one."""
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}; known: {', '.join(FORMATS)}")
    if form in ("json", "csv") and schema is None:
        raise ValueError(f"{form} needs a schema")
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def read_stream(spark: SparkSession, path: str, schema: str, form: str = "parquet", files: int = 1) -> DataFrame:
    """A streaming table over the files of a folder, ``files`` at a time."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files).load(path)


def with_durations(stream: DataFrame, default: int = 40_000) -> DataFrame:
    """Add ``duration``: the step to the next row; the last row takes its own if it has one (column
    ``tail``), else the upper median of the stream's steps, else the default."""
    w = W.partitionBy("stream_id").orderBy("pos")
    df = stream.withColumn("_d", F.lead("pts").over(w) - F.col("pts"))
    # the lower median of falling steps is the upper median
    usual = df.where("_d > 0").groupBy("stream_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _d DESC)").cast("long").alias("_usual"))
    own = [F.col("tail")] if "tail" in stream.columns else []
    return df.join(usual, "stream_id", "left").withColumn("duration", F.coalesce("_d", *own, "_usual", F.lit(default))).drop("_d", "_usual")


def manifest_check(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(path, status) of a manifest (path, sha256) against the files below a folder: ok, changed or missing."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.substring(F.regexp_replace("path", r"^file:/+", "file:/"), len(base.replace("file:///", "file:/")) + 1, 1 << 20)
    found = files.select(name.alias("path"), F.sha2("content", 256).alias("now"))
    status = F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.lower("sha256"), "ok").otherwise("changed")
    return manifest.join(found, "path", "left").select("path", status.alias("status"))


def publish(outputs: Mapping[str, DataFrame], form: str = "parquet") -> None:
    """Write every output aside, then move them all into place; on failure all old ones are back.

    Paths must differ and must not lie in one another.  A reader sees the old or the new
    table of a path, never a part of one.
    """
    paths = [p.rstrip("/") for p in outputs]
    for a in paths:
        for b in paths:
            if a != b and f"{b}/".startswith(f"{a}/"):
                raise ValueError(f"{b} lies in {a}")
    if len(set(paths)) < len(paths):
        raise ValueError("two outputs have the same path")
    if not outputs:
        return
    spark = next(iter(outputs.values())).sparkSession
    hadoop = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    system = lambda p: hadoop(p).getFileSystem(spark._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    moved: list[tuple[str, str]] = []

    def move(a: str, b: str) -> None:
        if not system(a).rename(hadoop(a), hadoop(b)):
            raise OSError(f"{a} cannot be moved to {b}")
        moved.append((a, b))

    try:
        for path, df in zip(paths, outputs.values(), strict=True):
            df.write.format(form).save(f"{path}.new-{mark}")
        for path in paths:
            if system(path).exists(hadoop(path)):
                move(path, f"{path}.old-{mark}")
            move(f"{path}.new-{mark}", path)
    except Exception:
        for a, b in reversed(moved):
            system(a).rename(hadoop(b), hadoop(a))
        raise
    finally:
        for path in paths:
            for rest in (f"{path}.new-{mark}", f"{path}.old-{mark}"):
                if rest.endswith(f"new-{mark}") or system(path).exists(hadoop(path)):
                    system(rest).delete(hadoop(rest), True)
