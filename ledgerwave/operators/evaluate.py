"""Scoring of answers, metrics and the comparison of two reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import attach
from .pairs import passes_as_refusal
from .signals import SIGNALS

# Refusal indicators and the functions a real answer would call.
REFUSAL_PATTERN = "(?i)out.of.scope|outside.*scope|cannot|not.*support"
PUBLIC_FUNCTIONS = (
    "load_sales", "decompose_trend", "growth_metrics", "detect_anomalies", "compare_segments",
    "plot_annotated", "narrate", "forecast", "cohort_analysis",
)
REFUSAL = "scope_refusal"
NOT_REFUSED = "Model did not refuse out-of-scope question"
NOT_DETECTED = "Code ran cleanly but planted signal was not detected"
HEADER_FIELDS = (
    "model_variant", "eval_set_size", "pass_at_1", "signal_detection_accuracy",
    "scope_refusal_accuracy", "library_version", "timestamp",
)


@dataclass(frozen=True)
class Report:
    header: DataFrame  # one row
    results: DataFrame  # question, signal_type, generated_code, passed, signal_detected, error


def of_types(pairs: DataFrame, types: list[str] | None) -> DataFrame:
    return pairs.where(F.col("signal_type").isin(list(types))) if types else pairs


def is_refusal(code: Column) -> Column:
    """A refusal indicator and no call of a public function."""
    calls = "|".join(PUBLIC_FUNCTIONS)
    return code.rlike(REFUSAL_PATTERN) & ~code.rlike(rf"({calls})\(")


def score_answers(answers: DataFrame, mode: str = "reference") -> DataFrame:
    """Scored results from `(question, signal_type, code, ran_ok, detected_ok)`.

    In "reference" mode a refusal comment given to an in-scope question passes
    both checks; "strict" fails it."""
    if mode not in ("reference", "strict"):
        raise ValueError(f"mode must be 'reference' or 'strict', not {mode!r}")
    code, kind = F.col("code"), F.col("signal_type")
    asked_refusal = kind == REFUSAL
    known = F.coalesce(kind.isin([t for t in SIGNALS if t != REFUSAL]), F.lit(False))
    refused = F.coalesce(is_refusal(code), F.lit(False))
    shortcut = F.coalesce(passes_as_refusal(code), F.lit(False))
    ran, detected = F.coalesce("ran_ok", F.lit(False)), F.coalesce("detected_ok", F.lit(False))
    if mode == "reference":
        ran, detected = shortcut | ran, shortcut | (ran & detected)
    else:
        ran, detected = ~shortcut & ran, ~shortcut & ran & detected
    passed = F.when(asked_refusal, refused).when(known, ran).otherwise(F.lit(False))
    seen = F.when(asked_refusal, refused).when(known, detected).otherwise(F.lit(False))
    given = F.coalesce(F.col("error"), F.lit("")) if "error" in answers.columns else F.lit("")
    error = (
        F.when(asked_refusal, F.when(refused, F.lit("")).otherwise(F.lit(NOT_REFUSED)))
        .when(~known, F.concat(F.lit("Unknown signal_type: "), F.coalesce(kind, F.lit(""))))
        .when(ran & ~detected, F.lit(NOT_DETECTED))
        .when(~ran, given)
        .otherwise(F.lit(""))
    )
    return answers.select(
        "question", "signal_type", code.alias("generated_code"),
        passed.alias("passed"), seen.alias("signal_detected"), error.alias("error"),
    )


def metrics(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """Set size, pass@1, detection and refusal accuracy, rounded to 4 digits."""
    refusal = F.coalesce(F.col("signal_type") == REFUSAL, F.lit(False))
    rest = F.count_if(~refusal)

    def share(ok: str) -> Column:
        return F.round(F.coalesce(F.try_divide(F.count_if(~refusal & F.col(ok)), rest), F.lit(0.0)), 4)

    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("eval_set_size"),
        share("passed").alias("pass_at_1"),
        share("signal_detected").alias("signal_detection_accuracy"),
        F.round(F.try_divide(F.count_if(refusal & F.col("passed")), F.count_if(refusal)), 4).alias("scope_refusal_accuracy"),
    )


def build_report(
    results: DataFrame, model_variant: str, eval_set: str, library_version: str, timestamp: str,
    elapsed_seconds: float = 0.0, signal_type_filter: list[str] | None = None,
) -> Report:
    """Header of one row next to the results, which stay a distributed table.  A `position` keeps their order, from
    one partition to the next, unless they have one."""
    if "position" not in results.columns:
        results = results.withColumn("position", F.monotonically_increasing_id())
    kinds = F.array(*[F.lit(t) for t in signal_type_filter]) if signal_type_filter else F.lit(None)
    header = metrics(results).select(
        F.lit(model_variant).alias("model_variant"), F.lit(eval_set).alias("eval_set"), "eval_set_size",
        F.lit(library_version).alias("library_version"), kinds.cast("array<string>").alias("signal_type_filter"),
        F.lit(timestamp).alias("timestamp"), F.lit(round(elapsed_seconds, 1)).alias("elapsed_seconds"),
        "pass_at_1", "signal_detection_accuracy", "scope_refusal_accuracy",
    )
    return Report(header, results)


def compare_headers(a: DataFrame, b: DataFrame) -> DataFrame:
    """`(pos, metric, a, b, delta)`: the header fields side by side, and B − A of
    pass@1 and detection."""
    def fields(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.struct(*[
            (F.col(f) if f in df.columns else F.lit(None)).alias(f) for f in HEADER_FIELDS
        ]).alias(side))

    both = attach(fields(a, "a"), fields(b, "b"), [], ["b"])

    def text(side: str, f: str) -> Column:
        return F.col(f"{side}.{f}").cast("string")

    def delta(f: str) -> Column:
        if f not in ("pass_at_1", "signal_detection_accuracy"):
            return F.lit(None).cast("double")
        return F.round(F.col(f"b.{f}").cast("double") - F.col(f"a.{f}").cast("double"), 4)

    rows = [
        F.struct(F.lit(i).alias("pos"), F.lit(f).alias("metric"), text("a", f).alias("a"), text("b", f).alias("b"), delta(f).alias("delta"))
        for i, f in enumerate(HEADER_FIELDS)
    ]
    return both.select(F.inline(F.array(*rows)))


def compare_by_type(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pass rates per signal type of two result tables; types of either side."""
    def rates(df: DataFrame, side: str) -> DataFrame:
        kind = F.coalesce(F.col("signal_type"), F.lit("unknown")).alias("signal_type")
        return df.groupBy(kind).agg(
            F.count_if(F.col("passed")).alias(f"passed_{side}"), F.count(F.lit(1)).alias(f"total_{side}")
        )

    d = rates(a, "a").join(rates(b, "b"), "signal_type", "full_outer")
    zero = F.lit(0).cast("bigint")
    for c in ("passed_a", "total_a", "passed_b", "total_b"):
        d = d.withColumn(c, F.coalesce(c, zero))
    d = d.withColumns({f"rate_{s}": F.try_divide(F.col(f"passed_{s}"), F.col(f"total_{s}")) for s in "ab"})
    return d.select(
        "signal_type", "passed_a", "total_a", F.round("rate_a", 4).alias("rate_a"),
        "passed_b", "total_b", F.round("rate_b", 4).alias("rate_b"),
        F.round(F.col("rate_b") - F.col("rate_a"), 4).alias("delta"),
    )
