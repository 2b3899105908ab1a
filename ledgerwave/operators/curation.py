"""Training-set curation: verified filter, replay sample, mixing, chat format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ordering import rank_rows

# Fixed value: the three-part chat template.
CHAT_OPEN, CHAT_CLOSE = "<|im_start|>", "<|im_end|>"
#: Groups of types whose highest hash prefix in a sample is known to every task.
TYPE_GROUPS = 1024
DEFAULT_SYSTEM_PROMPT = (
    "You are a sales data analyst. Answer each question with a Python script of at most 15 lines that "
    "uses only load_sales, decompose_trend, growth_metrics, detect_anomalies, compare_segments, "
    "plot_annotated, narrate, forecast and cohort_analysis, and ends with a summary in plain English. "
    "If a question is outside the scope of sales analysis, answer with one comment line that says so."
)


def verified_only(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("verified"))


def seeded_key(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(id_col.cast("string"), F.lit(str(seed))))


def replay_sample(pairs: DataFrame, per_type: int = 30, seed: int = 42, type_col: str = "signal_type", id_col: str = "id") -> DataFrame:
    """Exactly min(per_type, size) verified rows of every type, by seeded hash.

    Counts per hash prefix tell which prefixes of a type are in the sample and which one is cut.  The highest of them
    by group of types is a number that every task knows, so nearly all rows outside never reach a shuffle; the others
    meet their own prefix, so that no task takes a whole type."""
    d = verified_only(pairs).withColumn("__k", seeded_key(F.col(id_col), seed))
    d = d.withColumn("__p", F.substring("__k", 1, 5))
    sizes = d.groupBy(F.col(type_col).alias("__type"), F.col("__p").alias("__prefix")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("__type").orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(upto), F.lit(0))
    parts = sizes.select("__type", "__prefix", (F.lit(per_type) - before).alias("__room")).where("__room > 0")
    group = F.pmod(F.xxhash64(F.col(type_col)), F.lit(TYPE_GROUPS)).cast("int")
    cuts = parts.groupBy(F.pmod(F.xxhash64("__type"), F.lit(TYPE_GROUPS)).cast("int").alias("g")).agg(
        F.max("__prefix").alias("cut"))
    highest = cuts.select(F.map_from_entries(F.collect_list(F.struct("g", "cut")))).scalar()
    near = d.where(F.col("__p") <= F.element_at(highest, group))
    kept = near.join(parts, F.col(type_col).eqNullSafe(F.col("__type")) & (F.col("__p") == F.col("__prefix")))
    w = Window.partitionBy(type_col, "__p").orderBy("__k", id_col)
    kept = kept.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= F.col("__room"))
    return kept.select(*pairs.columns)


def mix(delta: DataFrame, replay: DataFrame) -> DataFrame:
    return verified_only(delta).unionByName(verified_only(replay))


def seeded_shuffle(pairs: DataFrame, seed: int = 42, id_col: str = "id", out: str = "position") -> DataFrame:
    """A reproducible random order as a 1-based position column.  Hash prefixes
    are the blocks, so rows are ranked in 65 536 independent groups."""
    d = pairs.withColumn("__k", seeded_key(F.col(id_col), seed)).withColumn("__p", F.substring("__k", 1, 4))
    return rank_rows(d, [], ["__p"], ["__k", id_col], out=out).withColumn(out, F.col(out) + 1).drop("__k", "__p")


def chat_text(question: Column, code: Column, system: Column | str = DEFAULT_SYSTEM_PROMPT) -> Column:
    system = F.lit(system) if isinstance(system, str) else system
    parts = []
    for role, body in (("system", system), ("user", question), ("assistant", code)):
        parts += [F.lit(f"{CHAT_OPEN}{role}\n"), body, F.lit(CHAT_CLOSE + ("\n" if role != "assistant" else ""))]
    return F.concat(*parts)


def chat_messages(question: Column, code: Column, system: Column | str = DEFAULT_SYSTEM_PROMPT) -> Column:
    system = F.lit(system) if isinstance(system, str) else system
    return F.array(*[
        F.struct(F.lit(role).alias("role"), body.alias("content"))
        for role, body in (("system", system), ("user", question), ("assistant", code))
    ])


def turn_text(role: Column, text: Column) -> Column:
    """One turn in the chat template; a conversation is its turns in order, joined by line breaks."""
    return F.concat(F.lit(CHAT_OPEN), role, F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CHAT_CLOSE))


def chat_records(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 part_turns: int = 1000) -> DataFrame:
    """One row per conversation with its turns in order: `conv`, part, n_turns, messages (role, content).

    A long conversation comes in parts of `part_turns` turn numbers, in order by `part`, so that a record has a bounded
    length whatever share of the turns its conversation holds.  Turns without a number come first, in part 0; turns
    with one number are in order of role and text."""
    message = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))
    part = F.coalesce(F.floor(F.col(turn) / part_turns), F.lit(0)).cast("bigint")
    records = turns.groupBy(F.col(conv), part.alias("part")).agg(
        F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(message)).alias("messages"))
    return records.withColumn("messages", F.transform("messages", lambda m: F.struct(
        m["role"].alias("role"), m["content"].alias("content"))))


def pairs_from_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(user, next assistant) turns as question and code: an equi-join on
    conversation and turn number, so a very long conversation stays spread."""
    ask = turns.where(F.col(role) == "user").select(conv, turn, F.col(text).alias("question"))
    reply = turns.where(F.col(role) == "assistant").select(conv, (F.col(turn) - 1).alias(turn), F.col(text).alias("code"))
    return ask.join(reply, [conv, turn])


def breakdown(pairs: DataFrame, type_col: str = "signal_type") -> DataFrame:
    return pairs.groupBy(type_col).agg(F.count(F.lit(1)).alias("n"))
