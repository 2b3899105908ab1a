"""Claim, pair, curation and evaluation queries.

Claims are about the sales of the given suppliers and orders, so the work of every query grows with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stored import stored
from ..operators import curation as cur
from ..operators import evaluate as ev
from ..operators import pairs as pr
from ..operators import signals as sig
from ..operators.series import to_series
from ..operators.verify import verify_claims
from . import sqltext as sql
from .registry import query, table
from .series_queries import orders_series

# --- claims about suppliers ---------------------------------------------------
# A supplier in the black claims a rising trend, others a falling one; its dearest line is the claimed spike, its
# cheapest the claimed drop and the flag of that one the segment that drags; every supplier asks the other questions.

SUPPLIER_CLAIMS = """line AS (SELECT l_suppkey, max({'p': l_extendedprice, 'd': CAST(l_shipdate AS DATE)}) AS top,
  min({'p': l_extendedprice, 'd': CAST(l_shipdate AS DATE), 'f': l_returnflag}) AS low FROM lineitem GROUP BY 1),
claims AS (SELECT l_suppkey, CASE WHEN s_acctbal >= 0 THEN 'trend_up' ELSE 'trend_down' END AS signal_type, NULL::DATE AS claimed_ds,
    NULL::VARCHAR AS claimed_segment FROM line JOIN supplier ON s_suppkey = l_suppkey
  UNION ALL SELECT l_suppkey, 'anomaly_spike', top.d, NULL FROM line UNION ALL SELECT l_suppkey, 'anomaly_drop', low.d, NULL FROM line
  UNION ALL SELECT l_suppkey, 'segment_drag', NULL, low.f FROM line
  UNION ALL SELECT l_suppkey, unnest(['scope_refusal', 'forecast_up', 'cohort_question']), NULL, NULL FROM line)"""


def supplier_claims(spark, folder):
    day = F.col("l_shipdate").cast("date")
    line = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.max(F.struct(F.col("l_extendedprice").alias("p"), day.alias("d"))).alias("top"),
        F.min(F.struct(F.col("l_extendedprice").alias("p"), day.alias("d"), F.col("l_returnflag").alias("f"))).alias("low"))
    balance = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    no_day, no_segment = F.lit(None).cast("date"), F.lit(None).cast("string")

    def claim(kind, ds=no_day, segment=no_segment):
        return F.struct(F.lit(kind).alias("signal_type"), ds.alias("claimed_ds"), segment.alias("claimed_segment"))

    fixed = F.array(
        claim("anomaly_spike", F.col("top.d")), claim("anomaly_drop", F.col("low.d")),
        claim("segment_drag", no_day, F.col("low.f")), claim("scope_refusal"), claim("forecast_up"), claim("cohort_question"))
    rows = line.select("l_suppkey", F.inline(fixed))
    trend = F.when(F.col("s_acctbal") >= 0, F.lit("trend_up")).otherwise(F.lit("trend_down"))
    return rows.unionByName(line.join(balance, "l_suppkey").select(
        "l_suppkey", trend.alias("signal_type"), no_day.alias("claimed_ds"), no_segment.alias("claimed_segment")))


def supplier_frames(spark, folder):
    lines = table(spark, folder, "lineitem")

    def of(freq, segment=None):
        return to_series(lines, "l_shipdate", "l_quantity", keys=["l_suppkey"], segment_col=segment, freq=freq)

    flags, months = of("M", "l_returnflag"), of("M")
    return {"trend": months, "growth": months, "forecast": months, "anomaly": of("W-MON"), "segments": flags, "cohort": flags}


@query(f"WITH {SUPPLIER_CLAIMS} SELECT * FROM claims")
def signal_claims(spark, folder):
    return supplier_claims(spark, folder)


def _verified_sql(strict: bool) -> str:
    growth = sig.STRICT_GROWTH if strict else sig.GROWTH
    monthly = sql.prepared("lineitem", "l_shipdate", "sum(l_quantity)", ["l_suppkey"], "MS")
    weekly = f"""{sql.series('lineitem', 'l_shipdate', 'sum(l_quantity)', ['l_suppkey'], 'W-MON', name='ws')},
wf AS (WITH x AS (SELECT 1), {sql.filled(['l_suppkey'], 'W-MON', src='ws', name='inner_f').strip()} SELECT * FROM inner_f)"""
    flags = f"""{sql.series('lineitem', 'l_shipdate', 'sum(l_quantity)', ['l_suppkey', 'l_returnflag'], 'MS', name='fs')},
ff AS (WITH x AS (SELECT 1), {sql.filled(['l_suppkey', 'l_returnflag'], 'MS', src='fs', name='inner_f').strip()} SELECT * FROM inner_f)"""
    near = ("EXISTS (SELECT 1 FROM found WHERE found.l_suppkey = c.l_suppkey AND abs(found.ds - c.claimed_ds) <= 7 AND score > {t})"
            if strict else "EXISTS (SELECT 1 FROM found WHERE found.l_suppkey = c.l_suppkey AND score > {t})")
    return f"""WITH RECURSIVE {monthly}, {weekly}, {flags}, {sql.stl(['l_suppkey'], 'f', 12)}, {SUPPLIER_CLAIMS},
short AS (SELECT l_suppkey, ds, avg(y) OVER (PARTITION BY l_suppkey ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS trend
  FROM f WHERE y IS NOT NULL AND l_suppkey NOT IN (SELECT l_suppkey FROM a0)),
rise AS (SELECT l_suppkey, last(trend ORDER BY ds) - first(trend ORDER BY ds) AS rise FROM (
  SELECT l_suppkey, ds, trend FROM parts UNION ALL SELECT * FROM short) GROUP BY 1),
months AS (SELECT l_suppkey, count(*) AS n, CASE WHEN first(y ORDER BY ds) > 0 THEN
  pow(last(y ORDER BY ds) / first(y ORDER BY ds), 1 / greatest(count(*) / 12.0, 0.01)) - 1 END AS cagr FROM f WHERE y IS NOT NULL GROUP BY 1),
weeks AS (SELECT l_suppkey, count(*) AS n FROM wf WHERE y IS NOT NULL GROUP BY 1),
found AS (SELECT l_suppkey, ds, abs(y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0) AS score FROM wf WHERE y IS NOT NULL
  WINDOW w AS (PARTITION BY l_suppkey)),
worst AS (SELECT l_suppkey, l_returnflag FROM (SELECT l_suppkey, l_returnflag, CASE WHEN first(y ORDER BY ds) > 0 THEN
    pow(last(y ORDER BY ds) / first(y ORDER BY ds), 1 / (count(*) / 12.0)) - 1 END AS cagr FROM ff WHERE y IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)
  QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY cagr NULLS FIRST, l_returnflag DESC) = 1),
parts_n AS (SELECT l_suppkey, count(*) AS n FROM ff WHERE y IS NOT NULL GROUP BY 1),
j AS (SELECT c.*, m.n AS months, wk.n AS weeks, pn.n AS flag_rows, rise, cagr, l_returnflag,
    {near.format(t='3.0')} AS far_out, {near.format(t='2.5')} AS out FROM claims c LEFT JOIN months m USING (l_suppkey)
  LEFT JOIN weeks wk USING (l_suppkey) LEFT JOIN parts_n pn USING (l_suppkey) LEFT JOIN rise USING (l_suppkey) LEFT JOIN worst USING (l_suppkey)),
verdicts AS (
  SELECT *, 'trend' AS op, months >= 2 AS ran, CASE signal_type WHEN 'trend_up' THEN rise > 0 ELSE rise < 0 END AS seen FROM j WHERE signal_type LIKE 'trend%'
  UNION ALL SELECT *, 'growth', months >= 2, CASE signal_type WHEN 'trend_up' THEN cagr > {growth} ELSE cagr < -{growth} END FROM j WHERE signal_type LIKE 'trend%'
  UNION ALL SELECT *, 'anomaly_zscore', weeks >= 2, far_out FROM j WHERE signal_type LIKE 'anomaly%'
  UNION ALL SELECT *, 'anomaly_auto', weeks >= 2, out FROM j WHERE signal_type LIKE 'anomaly%'
  UNION ALL SELECT *, 'segments', flag_rows >= 2, l_returnflag = claimed_segment FROM j WHERE signal_type = 'segment_drag'
  UNION ALL SELECT *, 'refusal', true, true FROM j WHERE signal_type = 'scope_refusal'
  UNION ALL SELECT *, 'forecast', months >= 4, months >= 4 FROM j WHERE signal_type = 'forecast_up'
  UNION ALL SELECT *, 'cohort', flag_rows >= 2, flag_rows >= 1 FROM j WHERE signal_type = 'cohort_question'),
checked AS (SELECT l_suppkey, signal_type, claimed_ds, claimed_segment, op, coalesce(ran, false) AS ran, coalesce(ran AND seen, false) AS detected FROM verdicts)"""


@query(_verified_sql(False) + " SELECT * FROM checked")
def signal_verification(spark, folder):
    return verify_claims(stored(supplier_claims(spark, folder)), supplier_frames(spark, folder))


@query(_verified_sql(True) + " SELECT * FROM checked")
def signal_verification_strict(spark, folder):
    return verify_claims(stored(supplier_claims(spark, folder)), supplier_frames(spark, folder), strict=True)


# Was the day of an order, or the one beside it, unusual for its weekday?  Every order is a claim about the daily
# revenue of its priority, so a few series and days hold them all.
@query(f"""WITH {sql.prepared('orders', 'o_orderdate', 'sum(o_totalprice)', ['o_orderpriority'])},
z AS (SELECT o_orderpriority, ds, (y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0) AS score FROM f WHERE y IS NOT NULL
  WINDOW w AS (PARTITION BY o_orderpriority, isodow(ds))),
near AS (SELECT DISTINCT o_orderpriority, ds + CAST(d AS INTEGER) AS ds FROM z, range(-1, 2) r(d) WHERE abs(score) > 2.5),
n AS (SELECT o_orderpriority, count(y) AS n FROM f GROUP BY 1)
SELECT o_orderkey, n >= 2 AS ran, n >= 2 AND near.ds IS NOT NULL AS detected FROM orders o JOIN n USING (o_orderpriority)
LEFT JOIN near ON near.o_orderpriority = o.o_orderpriority AND near.ds = CAST(o.o_orderdate AS DATE)""")
def order_days_verified(spark, folder):
    claims = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderpriority", F.lit("anomaly_contextual").alias("signal_type"),
        F.col("o_orderdate").cast("date").alias("claimed_ds"), F.lit(None).cast("string").alias("claimed_segment"))
    daily = orders_series(spark, folder, keys=["o_orderpriority"])
    return verify_claims(claims, {"anomaly": daily}, strict=True).select("o_orderkey", "ran", "detected")


# --- pairs --------------------------------------------------------------------

_BANK_COLUMNS = ["signal_type", "type_pos", "paraphrase_id", "question", "code", "op"]


def _bank_sql(types=None) -> str:
    rows = [tuple(r[c] for c in _BANK_COLUMNS) for r in pr.question_bank(types)]
    return sql.values(rows, _BANK_COLUMNS, "bank")


_CANDIDATES = "SELECT l_suppkey AS seed, bank.* FROM claims JOIN bank USING (signal_type)"


def supplier_candidates(spark, folder, types=None):
    claims = supplier_claims(spark, folder).select(F.col("l_suppkey").alias("seed"), "signal_type")
    return pr.candidates(claims, types)


@query(f"WITH {SUPPLIER_CLAIMS}, {_bank_sql()} {_CANDIDATES}")
def pairs_candidates(spark, folder):
    return supplier_candidates(spark, folder)


@query(f"WITH {SUPPLIER_CLAIMS}, {_bank_sql(['forecast_up', 'cohort_question'])} {_CANDIDATES}")
def pairs_delta(spark, folder):
    return supplier_candidates(spark, folder, sig.signal_types(delta_from="1.0.0"))


@query(_verified_sql(False) + f""", {_bank_sql()},
p AS (SELECT bank.*, l_suppkey, md5(signal_type || '|' || l_suppkey || '|' || paraphrase_id || '|1.0.0') AS h
  FROM checked JOIN bank USING (signal_type, op) WHERE ran AND detected AND l_suppkey BETWEEN 0 AND 8999)
SELECT question, code, signal_type, '1.0.0' AS library_version, l_suppkey AS dataset_seed, paraphrase_id, true AS verified,
  h[1:8] || '-' || h[9:12] || '-4' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS id FROM p""")
def pairs_generated(spark, folder):
    claims = stored(supplier_claims(spark, folder))
    flags = verify_claims(claims, supplier_frames(spark, folder))
    return pr.generate_pairs(claims, flags, "1.0.0", seed="l_suppkey")


# Verified here by a rule SQL can state, to check the order of the cut.
def _first_sql(n: int) -> str:
    return f"""WITH {_bank_sql()} SELECT seed, signal_type, paraphrase_id FROM (
SELECT o_orderkey AS seed, bank.*, (o_orderkey + paraphrase_id) % 4 <> 0 AS verified FROM orders JOIN bank ON signal_type = CASE
  o_orderstatus WHEN 'F' THEN 'trend_up' WHEN 'O' THEN 'segment_drag' ELSE 'scope_refusal' END)
WHERE verified ORDER BY seed, type_pos, paraphrase_id LIMIT {n}"""


def _first(spark, folder, n):
    kind = F.when(F.col("o_orderstatus") == "F", F.lit("trend_up")).when(
        F.col("o_orderstatus") == "O", F.lit("segment_drag")).otherwise(F.lit("scope_refusal"))
    claims = table(spark, folder, "orders").select(F.col("o_orderkey").alias("seed"), kind.alias("signal_type"))
    d = pr.candidates(claims).withColumn("verified", (F.col("seed") + F.col("paraphrase_id")) % 4 != 0)
    return pr.first_pairs(d, n).select("seed", "signal_type", "paraphrase_id")


@query(_first_sql(100))
def pairs_first(spark, folder):
    return _first(spark, folder, 100)


# Far into the table, in the middle of one order's questions.
@query(_first_sql(50_001))
def pairs_first_many(spark, folder):
    return _first(spark, folder, 50_001)


@query("""SELECT o_orderkey AS seed, CASE WHEN o_orderkey BETWEEN 0 AND 8999 THEN 'train' WHEN o_orderkey BETWEEN 9000 AND 9999 THEN 'held_out' END AS split FROM orders""")
def split_by_seed(spark, folder):
    d = table(spark, folder, "orders").select(F.col("o_orderkey").alias("seed"))
    return d.withColumn("split", pr.split_name(F.col("seed")))


_DOC_PAIRS = """d AS (SELECT doc_id, lang, text, source, coalesce(quality, 0) = 1 AS verified, coalesce(toxic, 0) = 1 AS toxic, n_chars
  FROM documents LEFT JOIN labels USING (doc_id))"""
_TYPES = {"en": "trend_up", "fr": "segment_drag", "de": "forecast_up", "es": "scope_refusal"}
_TYPE_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " ELSE lang END"


def documents(spark, folder):
    """Documents with their labels: a table of texts of four kinds, partly verified."""
    kind = F.col("lang")
    for lang, name in _TYPES.items():
        kind = F.when(F.col("lang") == lang, F.lit(name)).otherwise(kind)
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("id"), "lang", "text", "source", "n_chars", kind.alias("signal_type"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("verified"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"),
    )


@query(f"""WITH {_DOC_PAIRS}, p AS (SELECT text AS question, source AS code, {_TYPE_SQL} AS signal_type, verified, lang || '.0.' || (doc_id % 7) AS v1,
  CASE WHEN doc_id % 5 = 0 THEN '1.0' ELSE '1.0.' || (doc_id % 7) END AS library_version, doc_id - 3 AS dataset_seed, doc_id % 5 AS paraphrase_id, doc_id FROM d),
c AS (SELECT doc_id, regexp_matches(question, '\\?$') AS ok_question, length(code) > 0 AND len(string_split(code, chr(10))) <= 15 AS ok_code,
  signal_type IN ({', '.join(f"'{t}'" for t in sig.SIGNALS)}) AS ok_type, verified AS ok_verified,
  regexp_matches(library_version, '^[0-9]+\\.[0-9]+\\.[0-9]+$') AS ok_version, dataset_seed >= 0 AS ok_seed, paraphrase_id >= 0 AS ok_paraphrase, true AS ok_id FROM p)
SELECT *, CAST(8 - (ok_question::INT + ok_code::INT + ok_type::INT + ok_verified::INT + ok_version::INT + ok_seed::INT + ok_paraphrase::INT + ok_id::INT) AS INTEGER) AS violations FROM c""")
def pair_contract(spark, folder):
    d = documents(spark, folder)
    version = F.when(F.col("id") % 5 == 0, F.lit("1.0")).otherwise(F.concat(F.lit("1.0."), (F.col("id") % 7).cast("string")))
    p = d.select(
        F.col("id").alias("doc_id"), F.col("text").alias("question"), F.col("source").alias("code"), "signal_type", "verified",
        version.alias("library_version"), (F.col("id") - 3).alias("dataset_seed"), (F.col("id") % 5).alias("paraphrase_id"),
        pr.pair_id(F.col("lang"), F.col("id").cast("string")).alias("id"),
    )
    return pr.check_contract(p).select(
        "doc_id", "ok_question", "ok_code", "ok_type", "ok_verified", "ok_version", "ok_seed", "ok_paraphrase", "ok_id", "violations"
    )


@query(f"""WITH {SUPPLIER_CLAIMS}, {_bank_sql()},
t AS (SELECT l_suppkey AS seed, signal_type, code FROM claims JOIN bank USING (signal_type) UNION ALL SELECT conv_id, role, text FROM conversations)
SELECT seed, signal_type, regexp_matches(code, '(?i)out.of.scope|outside.*scope|cannot|not.*support') AND NOT regexp_matches(code,
 '(load_sales|decompose_trend|growth_metrics|detect_anomalies|compare_segments|plot_annotated|narrate|forecast|cohort_analysis)\\(') AS refusal,
 starts_with(trim(code), '#') AND (contains(lower(code), 'outside') OR contains(lower(code), 'scope')) AS shortcut FROM t""")
def refusal_flag(spark, folder):
    answers = supplier_candidates(spark, folder).select("seed", "signal_type", "code")
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("seed"), F.col("role").alias("signal_type"), F.col("text").alias("code")
    )
    both = answers.unionByName(turns)
    return both.select(
        "seed", "signal_type", ev.is_refusal(F.col("code")).alias("refusal"), pr.passes_as_refusal(F.col("code")).alias("shortcut")
    )


# --- curation -----------------------------------------------------------------

@query(f"WITH {_DOC_PAIRS} SELECT {_TYPE_SQL} AS signal_type, count(*) AS n FROM d WHERE verified GROUP BY 1")
def type_breakdown(spark, folder):
    return cur.breakdown(cur.verified_only(documents(spark, folder)))


def _replay_sql(n: int) -> str:
    return f"""WITH {_DOC_PAIRS}, r AS (SELECT doc_id AS id, {_TYPE_SQL} AS signal_type, text,
  row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '42'), doc_id) AS k FROM d WHERE verified)
SELECT id, signal_type, text FROM r WHERE k <= {n}"""


@query(_replay_sql(30))
def replay_sample(spark, folder):
    return cur.replay_sample(documents(spark, folder), 30, 42).select("id", "signal_type", "text")


@query(_replay_sql(2000))
def replay_sample_large(spark, folder):
    return cur.replay_sample(documents(spark, folder), 2000, 42).select("id", "signal_type", "text")


# Every order counts here, so that a sample of 1,001 cuts into the hash prefixes.
@query("""WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS signal_type, o_totalprice AS y,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '5'), o_orderkey) AS k FROM orders)
SELECT id, signal_type, y FROM r WHERE k <= 1001""")
def replay_sample_orders(spark, folder):
    d = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("signal_type"), F.col("o_totalprice").alias("y"),
        F.lit(True).alias("verified"),
    )
    return cur.replay_sample(d, 1001, 5).select("id", "signal_type", "y")


@query(f"""WITH {_DOC_PAIRS}, r AS (SELECT doc_id AS id, lang, {_TYPE_SQL} AS signal_type,
  row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '42'), doc_id) AS k FROM d WHERE verified),
m AS (SELECT id, signal_type FROM r WHERE k <= 20 AND lang IN ('en', 'es') UNION ALL SELECT id, signal_type FROM r WHERE lang IN ('fr', 'de'))
SELECT id, signal_type, row_number() OVER (ORDER BY md5(id || '7'), id) AS position FROM m""")
def mix_shuffle(spark, folder):
    d = documents(spark, folder)
    old, new = d.where(F.col("lang").isin("en", "es")), d.where(F.col("lang").isin("fr", "de"))
    mixed = cur.mix(new, cur.replay_sample(old, 20, 42))
    return cur.seeded_shuffle(mixed, 7).select("id", "signal_type", "position")


# Whole conversations, one row per turn: any number of turns, each with its own system text.
@query("""SELECT conv_id, turn, '<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' AS text FROM conversations""")
def chat_text(spark, folder):
    turns = table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", cur.turn_text(F.col("role"), F.col("text")).alias("text"))


@query("SELECT conv_id, turn, role, text AS content FROM conversations")
def chat_messages(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


# Whole conversations as nested records, in parts of three turns; the messages as text, to be compared.
@query("""SELECT conv_id, turn // 3 AS part, count(*) AS n_turns,
  CAST(to_json(list({'role': role, 'content': text} ORDER BY turn, role, text)) AS VARCHAR) AS messages FROM conversations GROUP BY 1, 2""")
def chat_records(spark, folder):
    records = cur.chat_records(table(spark, folder, "conversations"), part_turns=3)
    return records.withColumn("messages", F.to_json("messages", {"ignoreNullFields": "false"}))


# The three-part template of the questions that a user asked and the assistant's next turn answered.
_TURNS = """p AS (SELECT a.conv_id, a.turn, a.text AS question, b.text AS code FROM conversations a JOIN conversations b
  ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant')"""
_SYSTEM_SQL = "'" + cur.DEFAULT_SYSTEM_PROMPT.replace("'", "''") + "'"


@query(f"""WITH {_TURNS} SELECT conv_id, turn, '<|im_start|>system' || chr(10) || {_SYSTEM_SQL} || '<|im_end|>' || chr(10) ||
'<|im_start|>user' || chr(10) || question || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || code || '<|im_end|>' AS text FROM p""")
def chat_answers(spark, folder):
    p = cur.pairs_from_turns(table(spark, folder, "conversations"))
    return p.select("conv_id", "turn", cur.chat_text(F.col("question"), F.col("code")).alias("text"))


# --- evaluation ---------------------------------------------------------------
# Two "models" answer every document's question.  A refuses the toxic ones; B is
# cut off on long texts.

_REFUSE = pr.REFUSAL_TEXT.replace("'", "''")
_ANSWERS = f"""{_DOC_PAIRS},
ans AS (SELECT doc_id, {_TYPE_SQL} AS signal_type, CASE WHEN toxic OR doc_id % 11 = 0 THEN '{_REFUSE}' ELSE text END AS code_a,
  CASE WHEN doc_id % 6 = 0 THEN '{_REFUSE}' ELSE text END AS code_b, verified AS ran_a, verified AND n_chars > 300 AS det_a,
  n_chars < 2000 AS ran_b, n_chars < 1500 AS det_b FROM d),"""


def _scored_sql(side: str, mode: str = "reference") -> str:
    cut = f"starts_with(code_{side}, '#')"  # only refusal comments start so
    ran, det = f"ran_{side}", f"ran_{side} AND det_{side}"
    ok, seen = (f"({cut} OR {ran})", f"({cut} OR ({det}))") if mode == "reference" else (f"(NOT {cut} AND {ran})", f"(NOT {cut} AND {det})")
    return f"""sc_{side} AS (SELECT doc_id, signal_type,
  CASE WHEN signal_type = 'scope_refusal' THEN {cut} WHEN signal_type IN ('trend_up', 'segment_drag', 'forecast_up') THEN {ok} ELSE false END AS passed,
  CASE WHEN signal_type = 'scope_refusal' THEN {cut} WHEN signal_type IN ('trend_up', 'segment_drag', 'forecast_up') THEN {seen} ELSE false END AS signal_detected FROM ans)"""


_METRICS = """count(*) AS eval_set_size,
  round(coalesce(count(*) FILTER (WHERE signal_type <> 'scope_refusal' AND passed) / nullif(count(*) FILTER (WHERE signal_type <> 'scope_refusal'), 0), 0), 4) AS pass_at_1,
  round(coalesce(count(*) FILTER (WHERE signal_type <> 'scope_refusal' AND signal_detected) / nullif(count(*) FILTER (WHERE signal_type <> 'scope_refusal'), 0), 0), 4) AS signal_detection_accuracy,
  round(count(*) FILTER (WHERE signal_type = 'scope_refusal' AND passed) / nullif(count(*) FILTER (WHERE signal_type = 'scope_refusal'), 0), 4) AS scope_refusal_accuracy"""


def answers(spark, folder, side: str):
    d = documents(spark, folder)
    refuse = F.lit(pr.REFUSAL_TEXT)
    if side == "a":
        code = F.when(F.col("toxic") | (F.col("id") % 11 == 0), refuse).otherwise(F.col("text"))
        ran, det = F.col("verified"), F.col("verified") & (F.col("n_chars") > 300)
    else:
        code = F.when(F.col("id") % 6 == 0, refuse).otherwise(F.col("text"))
        ran, det = F.col("n_chars") < 2000, F.col("n_chars") < 1500
    return d.select(
        F.col("id").cast("string").alias("question"), "signal_type", code.alias("code"), ran.alias("ran_ok"), det.alias("detected_ok")
    )


def scored(spark, folder, side, mode="reference"):
    return ev.score_answers(answers(spark, folder, side), mode)


@query(f"WITH {_ANSWERS} {_scored_sql('a')} SELECT doc_id, signal_type, passed, signal_detected FROM sc_a")
def eval_scoring(spark, folder):
    return scored(spark, folder, "a").select(
        F.col("question").cast("bigint").alias("doc_id"), "signal_type", "passed", "signal_detected"
    )


@query(f"WITH {_ANSWERS} {_scored_sql('a', 'strict')} SELECT doc_id, signal_type, passed, signal_detected FROM sc_a")
def eval_scoring_strict(spark, folder):
    return scored(spark, folder, "a", "strict").select(
        F.col("question").cast("bigint").alias("doc_id"), "signal_type", "passed", "signal_detected"
    )


@query(f"WITH {_ANSWERS} {_scored_sql('a')} SELECT {_METRICS} FROM sc_a")
def eval_metrics(spark, folder):
    return ev.metrics(scored(spark, folder, "a"))


@query(f"WITH {_ANSWERS} {_scored_sql('b')} SELECT {_METRICS} FROM sc_b WHERE signal_type IN ('trend_up', 'forecast_up')")
def eval_metrics_filtered(spark, folder):
    return ev.metrics(ev.of_types(scored(spark, folder, "b"), ["trend_up", "forecast_up"]))


_HEADERS = ", ".join(
    f"h{s} AS (SELECT 'model-{s}' AS model_variant, {_METRICS}, '1.0.0' AS library_version, '2026-01-0{i}T00:00:00' AS timestamp FROM sc_{s})"
    for i, s in ((1, "a"), (2, "b"))
)


@query(f"WITH {_ANSWERS} {_scored_sql('a')}, {_scored_sql('b')}, {_HEADERS} " + " UNION ALL ".join(
    f"SELECT {i}::INTEGER AS pos, '{f}' AS metric, CAST(ha.{f} AS VARCHAR) AS a, CAST(hb.{f} AS VARCHAR) AS b, "
    + (f"round(hb.{f} - ha.{f}, 4)" if f in ("pass_at_1", "signal_detection_accuracy") else "NULL::DOUBLE") + " AS delta FROM ha, hb"
    for i, f in enumerate(ev.HEADER_FIELDS)))
def ab_compare(spark, folder):
    reports = {
        s: ev.build_report(scored(spark, folder, s), f"model-{s}", "documents", "1.0.0", f"2026-01-0{i}T00:00:00")
        for i, s in ((1, "a"), (2, "b"))
    }
    return ev.compare_headers(reports["a"].header, reports["b"].header)


@query(f"""WITH {_ANSWERS} {_scored_sql('a')}, {_scored_sql('b')},
ra AS (SELECT signal_type, count(*) FILTER (WHERE passed) AS passed_a, count(*) AS total_a FROM sc_a GROUP BY 1),
rb AS (SELECT signal_type, count(*) FILTER (WHERE passed) AS passed_b, count(*) AS total_b FROM sc_b GROUP BY 1)
SELECT signal_type, coalesce(passed_a, 0) AS passed_a, coalesce(total_a, 0) AS total_a, round(passed_a / total_a, 4) AS rate_a,
  coalesce(passed_b, 0) AS passed_b, coalesce(total_b, 0) AS total_b, round(passed_b / total_b, 4) AS rate_b,
  round(passed_b / total_b - passed_a / total_a, 4) AS delta FROM ra FULL JOIN rb USING (signal_type)""")
def ab_by_type(spark, folder):
    return ev.compare_by_type(scored(spark, folder, "a"), scored(spark, folder, "b"))
