"""Line rules over a stream of modules: the rules that need no other line run unchanged on a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import audit


def batch(modules: DataFrame) -> DataFrame:
    """path, line_no, rule_id, text: secrets, deprecated calls and selections, statelessly."""
    columns = ["path", "line_no", "rule_id", "text"]
    selected = T.lines(modules).filter(F.col("text").contains("Выбрать()")).select("path", "line_no", F.lit("full_selection").alias("rule_id"), T.strip(F.col("text")).alias("text"))
    return audit.security(modules).select(*columns).unionByName(audit.deprecated_api(modules).select(*columns)).unionByName(selected)


def read_modules(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of modules(path, content): one row per new file."""
    return spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.bsl").option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("content"))


def start(modules: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append findings as Parquet; every file is scanned once."""
    return batch(modules).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def counts(findings: DataFrame, times: str = "seen_at", delay: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Findings per rule and time window, with late rows up to the delay."""
    return findings.withWatermark(times, delay).groupBy(F.window(times, window), "rule_id").agg(F.count("*").alias("cnt"))
