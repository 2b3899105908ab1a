"""JSON sources and sinks: training pairs and evaluation reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.evaluate import Report
from ..operators.pairs import PAIR_SCHEMA

RESULT_FIELDS = (
    "question string, signal_type string, generated_code string, passed boolean, "
    "signal_detected boolean, error string"
)
_STRUCT_FIELDS = re.sub(r"(\w+) (\w+)", r"\1: \2", RESULT_FIELDS)
REPORT_SCHEMA = (
    "model_variant string, model_name string, eval_set string, eval_set_size bigint, "
    "library_version string, signal_type_filter array<string>, timestamp string, "
    "elapsed_seconds double, pass_at_1 double, signal_detection_accuracy double, "
    f"scope_refusal_accuracy double, notes string, results array<struct<{_STRUCT_FIELDS}>>"
)


def _renamed(schema: str, version_field: str) -> str:
    return schema.replace("library_version", f"`{version_field}`")


def read_pairs(spark: SparkSession, path: str, version_field: str = "library_version") -> DataFrame:
    """Pairs, one JSON object per line; blank lines are skipped.  `version_field`
    is the name of the version in the file."""
    d = spark.read.schema(_renamed(PAIR_SCHEMA, version_field)).json(path)
    return d.withColumnRenamed(version_field, "library_version")


def write_pairs(pairs: DataFrame, path: str, mode: str = "append") -> None:
    pairs.where("verified").write.mode(mode).json(path)


def report_name(model_variant: str, timestamp: str) -> str:
    return f"{model_variant.replace('/', '-')}-{re.sub(r'[^0-9A-Za-z]+', '-', timestamp).strip('-')}"


def write_report(report: Report, folder: str) -> str:
    """`<folder>/<variant>-<timestamp>.json` with the header; the results, of any
    number, are lines under `results/` in it."""
    head = report.header.select("model_variant", "timestamp").first()
    target = f"{folder.rstrip('/')}/{report_name(head.model_variant, head.timestamp)}.json"
    report.header.write.mode("overwrite").json(target)
    report.results.write.mode("overwrite").json(f"{target}/results")
    return target


def read_reports(spark: SparkSession, path: str, version_field: str = "library_version") -> DataFrame:
    """All reports under a path or glob, with the name they were found under."""
    d = spark.read.schema(_renamed(REPORT_SCHEMA, version_field)).option("multiLine", True).json(path)
    return d.withColumnRenamed(version_field, "library_version").withColumn("source", F.col("_metadata.file_path"))


def latest_report(spark: SparkSession, path: str, version_field: str = "library_version") -> Report:
    """The report with the lexicographically last name.  Names come from the listing, only its file is opened; one
    from elsewhere may hold its results inside.  Results have the `position` they were reported at."""
    last = spark.read.format("binaryFile").load(path).agg(F.max("path").alias("name")).first().name
    if last is None:
        raise FileNotFoundError(f"no report matches {path!r}")
    d = read_reports(spark, last, version_field)
    header = d.drop("results", "source")
    if d.where("results IS NULL").limit(1).count():
        return Report(header, spark.read.schema(f"{RESULT_FIELDS}, position bigint").json(
            f"{last.rpartition('/')[0]}/results"))
    return Report(header, d.select(F.posexplode("results").alias("position", "r")).select(
        "r.*", F.col("position").cast("bigint").alias("position")))
