"""Metrics text and log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayflow import fixed_values as V


def parse_offsets(lines: DataFrame, column: str = "value") -> DataFrame:
    """Topic and offset of the offset lines; all other lines are skipped.

    A line is a metric name, labels in braces and a floating-point value, as in `name{topic="a"} 1.5e+06`. The topic is
    the label of exactly that name; a line without it, or with a value that is not a number, is no offset line.
    """
    # One pass of the long pattern per offset line; a line that is none keeps no second part.
    sample = rf'(?s)^{V.OFFSET_METRIC}\{{(.*)\}}\s+(\S+).*$'
    parts = F.split(F.regexp_replace(column, sample, "$1\u0001$2"), "\u0001")
    topic = F.regexp_extract(F.get(parts, F.lit(0)), r'(?:^|,)\s*topic="((?:[^"\\]|\\.)*)"', 1)
    offset = F.get(parts, F.lit(1)).try_cast("decimal(38,6)").try_cast("long")
    lines = lines.where(F.col(column).startswith(f"{V.OFFSET_METRIC}{{"))
    return lines.select(topic.alias("topic"), offset.alias("offset")).where("topic <> '' and offset is not null")


def topic_totals(offsets: DataFrame, topics: list[str]) -> DataFrame:
    """Offset sum of every listed topic, 0 when it has none, and the grand total over all topics.

    Few rows: one per topic.
    """
    spark = offsets.sparkSession
    sums = offsets.rollup("topic").agg(F.sum("offset").alias("n"))
    sums = sums.select(F.coalesce("topic", F.lit("TOTAL")).alias("topic"), "n")
    wanted = spark.createDataFrame([(t,) for t in [*topics, "TOTAL"]], "topic string")
    return wanted.join(sums, "topic", "left").select("topic", F.coalesce("n", F.lit(0)).cast("long").alias("offset_total"))


def metric_line(name: str, label: str, label_value: Column, value: Column) -> Column:
    return F.format_string(f'{name}{{{label}="%s"}} %s', label_value, value.cast("string"))


def in_order(lines: DataFrame) -> DataFrame:
    """Lines of a metrics text as a reader expects them: per metric its header lines, HELP before TYPE, then its samples.

    A sort over ranges, so that the files of the result, one after the other, are in order.
    """
    head = F.col("value").startswith("#")
    metric = F.regexp_extract("value", r"^(?:# \w+ )?(\w+)", 1)
    return lines.orderBy(metric, F.when(head, 0).otherwise(1), "value").select("value")


def log_stream(spark: SparkSession, path: str, job: str, glob: str = "*.log", files_per_trigger: int = 2000) -> DataFrame:
    """Lines of growing log files, with the file they come from and a fixed job label; so many files to a batch."""
    lines = (
        spark.readStream.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger)
        .option("lineSep", "\n").text(path)
    )
    return lines.select(F.lit(job).alias("job"), F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("line"))
