"""Question/answer pairs about claims on series: candidates, their verification, the contract check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import signals as sig

PAIR_SCHEMA = (
    "question string, code string, signal_type string, library_version string, "
    "dataset_seed bigint, paraphrase_id int, verified boolean, id string"
)
REFUSAL_TEXT = "# This question is outside the scope of sales analysis."
MAX_CODE_LINES = 15
#: Bits of a seed that one count of `first_pairs` looks at.
RADIX_BITS = 16
TRAIN_SEEDS, HELD_OUT_SEEDS = (0, 8999), (9000, 9999)
SPLITS = {"train": TRAIN_SEEDS, "held_out": HELD_OUT_SEEDS}

# The questions of each type with the operator (and options) that
# answers them.
QUESTIONS: dict[str, list[tuple[str, dict]]] = {
    "trend_up": [
        ("Is my overall sales trend going up?", {"op": "trend"}),
        ("Has my revenue been increasing over time?", {"op": "trend"}),
        ("What direction is my sales trend heading?", {"op": "growth"}),
        ("Show me whether sales are growing.", {"op": "trend", "chart": True}),
        ("Is there a positive trend in my data?", {"op": "growth"}),
    ],
    "trend_down": [
        ("Is my overall sales trend going down?", {"op": "trend"}),
        ("Has revenue been declining?", {"op": "growth"}),
        ("Are sales falling over time?", {"op": "trend"}),
        ("What's the sales trajectory — is it negative?", {"op": "growth"}),
        ("Show me if there's a downward trend.", {"op": "trend", "chart": True}),
    ],
    "anomaly_spike": [
        ("Which weeks had unusually high sales?", {"op": "anomaly_auto", "chart": True}),
        ("Were there any sales spikes in my data?", {"op": "anomaly_auto", "chart": True}),
        ("Show me any periods of abnormally high revenue.", {"op": "anomaly_zscore", "chart": True}),
        ("Identify weeks where sales were far above normal.", {"op": "anomaly_auto"}),
        ("Were there any surprising jumps in my sales figures?", {"op": "anomaly_auto", "chart": True}),
    ],
    "anomaly_drop": [
        ("Which weeks had unusually low sales?", {"op": "anomaly_auto", "chart": True}),
        ("Were there any sales dips I should know about?", {"op": "anomaly_auto", "chart": True}),
        ("Show me periods where revenue dropped unexpectedly.", {"op": "anomaly_zscore", "chart": True}),
        ("Highlight any weeks where sales were far below average.", {"op": "anomaly_auto"}),
        ("Flag any unusual downturns in my sales data.", {"op": "anomaly_auto", "chart": True}),
    ],
    "anomaly_contextual": [
        ("Are there any days that are unusual for their day of week?", {"op": "anomaly_contextual", "chart": True}),
        ("Find anomalies that are odd compared to similar days.", {"op": "anomaly_contextual", "chart": True}),
        ("Which days stand out compared to the same weekday historically?", {"op": "anomaly_contextual"}),
        ("Show me contextual anomalies in my daily sales.", {"op": "anomaly_contextual", "chart": True}),
        ("Are there any Mondays (or other weekdays) that performed unexpectedly?", {"op": "anomaly_contextual", "chart": True}),
    ],
    "segment_drag": [
        ("Which product is dragging my overall sales down?", {"op": "segments"}),
        ("Which segment has the worst growth trend?", {"op": "segments"}),
        ("Compare my products by sales growth and identify the laggard.", {"op": "segments"}),
        ("Show me which product or region is underperforming.", {"op": "segments"}),
        ("Rank my segments from best to worst growth.", {"op": "segments"}),
    ],
    "scope_refusal": [
        ("Write me a web scraper for competitor prices.", {"op": "refusal"}),
        ("Can you help me write a SQL query?", {"op": "refusal"}),
        ("Predict tomorrow's stock price.", {"op": "refusal"}),
        ("Build a recommendation engine for my products.", {"op": "refusal"}),
        ("What's the weather forecast for next week?", {"op": "refusal"}),
    ],
    "forecast_up": [
        ("What will my sales look like over the next 12 months?", {"op": "forecast", "horizon": 12}),
        ("Can you forecast my revenue for the next quarter?", {"op": "forecast", "horizon": 3}),
        ("Project my sales trend forward for the next 6 periods.", {"op": "forecast", "horizon": 6}),
        ("Show me a sales forecast with confidence intervals.", {"op": "forecast", "horizon": 12}),
        ("What does the model predict for my future sales?", {"op": "forecast", "horizon": 12}),
    ],
    "cohort_question": [
        ("How is customer retention trending across cohorts?", {"op": "cohort"}),
        ("Show me a cohort retention analysis.", {"op": "cohort"}),
        ("Which customer cohort has the best retention?", {"op": "cohort"}),
        ("Are later cohorts retaining customers better than earlier ones?", {"op": "cohort"}),
        ("Build a cohort analysis heatmap for my sales data.", {"op": "cohort"}),
    ],
}

# operator → (segment column to load, result name, call, plot argument)
_CALLS = {
    "trend": (None, "result", "decompose_trend(sf)", "trend"),
    "growth": (None, "gm", "growth_metrics(sf)", None),
    "anomaly_auto": (None, "anomalies", "detect_anomalies(sf)", "anomalies"),
    "anomaly_zscore": (None, "anomalies", "detect_anomalies(sf, method='zscore')", "anomalies"),
    "anomaly_contextual": (None, "anomalies", "detect_anomalies(sf, method='contextual')", "anomalies"),
    "segments": ("product", "ranking", "compare_segments(sf)", None),
    "forecast": (None, "result", "forecast(sf, horizon={horizon})", None),
    "cohort": ("cohort", "table", "cohort_analysis(sf, cohort_col='cohort')", None),
}


def script(op: str, horizon: int | None = None, chart: bool = False) -> str:
    """The script that answers a question by an operator."""
    if op == "refusal":
        return REFUSAL_TEXT
    segment, name, call, plot = _CALLS[op]
    options = f", segment_col='{segment}'" if segment else ""
    lines = [f"sf = load_sales('data.csv'{options})", f"{name} = {call.format(horizon=horizon)}"]
    if chart:
        lines.append(f"fig = plot_annotated(sf, {plot}={name})")
    return "\n".join([*lines, f"narrate({name})"])


def question_bank(types: list[str] | None = None) -> list[dict]:
    rows = []
    for t in sig.signal_types(types):
        for i, (question, spec) in enumerate(QUESTIONS[t]):
            rows.append({
                "signal_type": t, "type_pos": list(sig.SIGNALS).index(t), "paraphrase_id": i,
                "question": question, "code": script(**spec), "op": spec["op"],
            })
    return rows


def candidates(claims: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Every question of its kind for every claim: the bank is a map literal whose entry is exploded per claim, so
    nothing is shuffled.  Claims of other kinds have none."""
    by_type: dict[str, list[Column]] = {}
    for row in question_bank(types):
        fields = [F.lit(v).alias(k) for k, v in row.items() if k != "signal_type"]
        by_type.setdefault(row["signal_type"], []).append(F.struct(*fields))
    bank = F.create_map(*[x for t, rows in by_type.items() for x in (F.lit(t), F.array(*rows))])
    return claims.where(F.col("signal_type").isin(list(by_type))).select(*claims.columns, F.inline(bank[F.col("signal_type")]))


def passes_as_refusal(code: Column) -> Column:
    """A comment that mentions being outside or the scope, whatever was asked."""
    text = F.trim(F.regexp_replace(code, r"^\s+|\s+$", ""))
    low = F.lower(text)
    return text.startswith("#") & (low.contains("outside") | low.contains("scope"))


def verify_pairs(pairs: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with `ran`, `detected`, `verified`.  `flags` has a row for each (keys…, signal_type, op).  A refusal
    comment passes both checks for any type."""
    d = pairs.join(flags.select(*keys, "signal_type", "op", "ran", "detected"), [*keys, "signal_type", "op"], "left")
    refused = passes_as_refusal(F.col("code"))
    ran = refused | F.coalesce("ran", F.lit(False))
    detected = refused | F.coalesce("detected", F.lit(False))
    return d.withColumns({"ran": ran, "detected": detected}).withColumn("verified", F.col("ran") & F.col("detected"))


def pair_id(*parts: Column) -> Column:
    """UUID-v4-shaped id derived from the natural key, so a retried task repeats it."""
    h = F.md5(F.concat_ws("|", *parts))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3),
        F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def in_split(seed: Column, split: str) -> Column:
    lo, hi = SPLITS[split]
    return seed.between(lo, hi)


def split_name(seed: Column) -> Column:
    return F.when(in_split(seed, "train"), F.lit("train")).when(in_split(seed, "held_out"), F.lit("held_out"))


def first_pairs(pairs: DataFrame, count: int) -> DataFrame:
    """The first `count` verified pairs by seed, type and paraphrase (seeds that are null come last).

    The seed at which the count is reached is found by counting, a group of `RADIX_BITS` bits of the seed at a time;
    all pairs of smaller seeds pass, and only the pairs of that seed are ranked.  Rows keep their partitions."""
    done = pairs.where("verified")
    # The order of signed numbers as an order of bit groups: the sign bit is turned.
    turned = F.col("seed").bitwiseXOR(F.lit(-(1 << 63)))
    left, prefix = count, 0
    inside = F.col("seed").isNotNull()
    for shift in range(64 - RADIX_BITS, -1, -RADIX_BITS):
        part = F.shiftrightunsigned(turned, shift).bitwiseAND(F.lit((1 << RADIX_BITS) - 1))
        sizes = done.where(inside).groupBy(part.alias("part")).count().orderBy("part").collect()
        for size in sizes:
            if size["count"] >= left:
                break
            left -= size["count"]
        else:
            # There are no more pairs than asked for among those with a seed.
            without = done.where("seed IS NULL").orderBy("type_pos", "paraphrase_id").limit(left)
            return done.where("seed IS NOT NULL").union(without)
        prefix = prefix << RADIX_BITS | size.part
        inside = F.shiftrightunsigned(turned, shift) == F.lit(prefix - (1 << 64) if prefix >> 63 else prefix)
    last = prefix - (1 << 63)
    rank = F.row_number().over(Window.partitionBy("seed").orderBy("type_pos", "paraphrase_id"))
    edge = done.where(F.col("seed") == last).withColumn("__rank", rank).where(F.col("__rank") <= left).drop("__rank")
    return done.where(F.col("seed") < last).union(edge)


def generate_pairs(
    claims: DataFrame, flags: DataFrame, library_version: str, seed: str, split: str = "train", count: int | None = None,
    types: list[str] | None = None, delta_from: str | None = None,
) -> DataFrame:
    """Verified pairs of a split in the pair schema.  `claims` has one row per series (its number is the column `seed`)
    and kind, `flags` is what `verify_claims` says of them."""
    chosen = sig.signal_types(types, delta_from)
    usable = claims.where(in_split(F.col(seed), split)).select(F.col(seed).cast("bigint").alias("seed"), "signal_type")
    if not chosen:
        return usable.sparkSession.createDataFrame([], PAIR_SCHEMA)
    known = flags.withColumn("seed", F.col(seed).cast("bigint"))
    done = verify_pairs(candidates(usable, chosen), known, ["seed"]).where("verified")
    if count is not None:
        done = first_pairs(done, count)
    key = [F.col("signal_type"), F.col("seed").cast("string"), F.col("paraphrase_id").cast("string"), F.lit(library_version)]
    return done.select(
        "question", "code", "signal_type", F.lit(library_version).alias("library_version"),
        F.col("seed").alias("dataset_seed"), "paraphrase_id", "verified", pair_id(*key).alias("id"),
    )


def check_contract(pairs: DataFrame) -> DataFrame:
    """One boolean per rule of the pair contract, and how many are broken."""
    uuid4 = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    rules = {
        "ok_question": F.col("question").rlike(r"\?$"),
        "ok_code": (F.length("code") > 0) & (F.size(F.split("code", "\n")) <= MAX_CODE_LINES),
        "ok_type": F.col("signal_type").isin(list(sig.SIGNALS)),
        "ok_verified": F.col("verified"),
        "ok_version": F.col("library_version").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"),
        "ok_seed": F.col("dataset_seed") >= 0,
        "ok_paraphrase": F.col("paraphrase_id") >= 0,
        "ok_id": F.lower("id").rlike(uuid4),
    }
    checked = pairs.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in rules.items()})
    broken = reduce(lambda a, b: a + b, [(~F.col(k)).cast("int") for k in rules])
    return checked.withColumn("violations", broken)
