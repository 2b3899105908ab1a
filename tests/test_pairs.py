import contextlib
import io
from datetime import date, timedelta

import numpy as np
import pytest
from helpers import mondays
from pyspark.sql import functions as F

from ledgerwave import SalesFrame
from ledgerwave.operators import curation as cur
from ledgerwave.operators import evaluate as ev
from ledgerwave.operators import pairs as pr
from ledgerwave.operators import signals as sig
from ledgerwave.operators.verify import near_dates, verify_claims
from ledgerwave.sources import records


KINDS = ["trend_up", "trend_down", "anomaly_spike", "anomaly_drop", "segment_drag", "scope_refusal", "forecast_up", "cohort_question"]


@pytest.fixture(scope="module")
def claims(spark):
    rows = [(k, t) for k in (0, 1, 9000) for t in KINDS]
    return spark.createDataFrame(rows, "seed bigint, signal_type string").cache()


def all_true(claims):
    return claims.join(spread_ops(claims), "signal_type").withColumns({"ran": F.lit(True), "detected": F.lit(True)})


def spread_ops(claims):
    rows = [(t, op) for t, s in sig.SIGNALS.items() for op in s.ops]
    return claims.sparkSession.createDataFrame(rows, "signal_type string, op string")


def test_registry():
    assert list(sig.SIGNALS)[:2] == ["trend_up", "trend_down"] and len(sig.SIGNALS) == 9
    assert sig.signal_types(delta_from="1.0.0") == ["forecast_up", "cohort_question"]
    assert sig.signal_types(["trend_up"], delta_from="1.0.0") == []
    with pytest.raises(ValueError, match="Unknown signal_type"):
        sig.signal_types(["nope"])


def test_bank_and_candidates(claims):
    bank = pr.question_bank()
    assert len(bank) == 45 and all(len(r["code"].split("\n")) <= pr.MAX_CODE_LINES for r in bank)
    assert bank[0]["code"] == "sf = load_sales('data.csv')\nresult = decompose_trend(sf)\nnarrate(result)"
    assert pr.script("forecast", 6).split("\n")[1] == "result = forecast(sf, horizon=6)"
    assert pr.candidates(claims).count() == 3 * 5 * len(KINDS)
    assert pr.candidates(claims, ["trend_up"]).count() == 15
    assert pr.candidates(claims.withColumn("signal_type", F.lit(None).cast("string"))).count() == 0
    assert sum(not r["question"].endswith("?") for r in bank) == 19


def test_generation_respects_split_count_and_order(claims):
    flags = all_true(claims)
    types = ["trend_up", "segment_drag", "scope_refusal"]
    rows = pr.generate_pairs(claims, flags, "1.0.0", "seed", "train", count=10, types=types).collect()
    assert len(rows) == 10 and all(r.verified for r in rows) and {r.dataset_seed for r in rows} == {0}
    assert {r.signal_type for r in rows} == {"trend_up", "segment_drag"}
    held = pr.generate_pairs(claims, flags, "1.0.0", "seed", "held_out", types=["scope_refusal"])
    assert {r.dataset_seed for r in held.collect()} == {9000} and held.count() == 5
    assert pr.generate_pairs(claims, flags, "1.0.0", "seed", types=["trend_up"], delta_from="1.0.0").count() == 0


@pytest.mark.parametrize("count", [0, 1, 7, 100, 299, 300, 301, 5000])
def test_first_pairs(spark, count):
    rng = np.random.default_rng(1)
    seeds = [-(2 ** 63), -5, -1, 0, 1, 2 ** 40, 2 ** 40 + 1, 2 ** 63 - 1]
    rows = [(int(s), int(k // 5), int(k % 5), bool(rng.random() < 0.9)) for s in seeds for k in range(40)] + [
        (None, k, 0, True) for k in range(12)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    d = spark.createDataFrame(rows, "seed bigint, type_pos int, paraphrase_id int, verified boolean")
    want = sorted((r[:3] for r in rows if r[3]), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))[:count]
    got = sorted((tuple(r)[:3] for r in pr.first_pairs(d, count).collect()), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))
    assert got == want
    assert pr.first_pairs(d.where("false"), count).count() == 0


def test_undetected_and_refusal_pairs(claims):
    flags = all_true(claims).withColumn("detected", F.lit(False))
    d = pr.candidates(claims, ["segment_drag"])
    assert pr.verify_pairs(d, flags, ["seed"]).where("ran AND NOT detected AND NOT verified").count() == 15
    refused = d.withColumn("code", F.lit("  # Outside of what I do"))
    assert pr.verify_pairs(refused, flags, ["seed"]).where("verified").count() == 15
    assert pr.verify_pairs(d, flags.where("false"), ["seed"]).where("verified OR ran").count() == 0


# --- verification

WEEKS = mondays(104)


def keyed(spark, series, freq="W-MON", segment=None):
    """A frame of {key: values or {segment: values}} on weekly dates."""
    rows = []
    for k, values in series.items():
        for name, ys in (values.items() if segment else [(None, values)]):
            rows += [(k, *([name] if segment else []), d, None if y is None else float(y), y is None) for d, y in zip(WEEKS, ys)]
    extra = f"{segment} string, " if segment else ""
    return SalesFrame(spark.createDataFrame(rows, f"k string, {extra}ds date, y double, is_gap boolean"), freq, ("k",), segment,
                      one_row_per_date=True)


def verified(spark, claims, frames, strict=False):
    df = spark.createDataFrame(claims, "k string, signal_type string, claimed_ds date, claimed_segment string, note string")
    return {(r.k, r.signal_type, r.claimed_ds, r.op): (r.ran, r.detected) for r in verify_claims(df, frames, strict).collect()}


def test_claims_are_judged(spark):
    rng = np.random.default_rng(0)
    noise = rng.normal(0, 1, 104)
    up = 100 + np.arange(104) + noise
    spiky = 100 + noise
    spiky[50] += 80
    frames = {"anomaly": keyed(spark, {"up": up, "spiky": spiky, "one": [5.0]}),
              "segments": keyed(spark, {"up": {"a": up, "b": up[::-1]}}, segment="part"),
              "cohort": keyed(spark, {"up": {"a": up, "b": up[::-1]}}, segment="part")}
    frames |= {op: frames["anomaly"] for op in ("trend", "growth", "forecast")}
    day, far = WEEKS[50], WEEKS[80]
    claims = [("up", "trend_up", None, None, "x"), ("up", "trend_down", None, None, "x"), ("one", "trend_up", None, None, "x"),
              ("gone", "trend_up", None, None, "x"), ("spiky", "anomaly_spike", day, None, "x"), ("spiky", "anomaly_spike", far, None, "x"),
              ("spiky", "anomaly_spike", day + timedelta(days=7), None, "x"), ("spiky", "anomaly_spike", day - timedelta(days=8), None, "x"),
              ("spiky", "anomaly_spike", None, None, "x"), ("up", "segment_drag", None, "B", "x"), ("up", "segment_drag", None, None, "x"),
              ("up", "forecast_up", None, None, "x"), ("one", "forecast_up", None, None, "x"), ("up", "cohort_question", None, None, "x"),
              ("gone", "scope_refusal", None, None, "x"), ("up", "no such kind", None, None, "x"), (None, "trend_up", None, None, "x")]
    loose, strict = verified(spark, claims, frames), verified(spark, claims, frames, strict=True)
    for op in ("trend", "growth"):
        assert loose["up", "trend_up", None, op] == (True, True) and loose["up", "trend_down", None, op] == (True, False)
        assert loose["one", "trend_up", None, op] == loose["gone", "trend_up", None, op] == loose[None, "trend_up", None, op] == (False, False)
    for ds, hit in ((day, True), (far, False), (day + timedelta(days=7), True), (day - timedelta(days=8), False), (None, False)):
        assert loose["spiky", "anomaly_spike", ds, "anomaly_zscore"] == (True, True)
        assert strict["spiky", "anomaly_spike", ds, "anomaly_zscore"] == (True, hit)
    assert loose["up", "forecast_up", None, "forecast"] == (True, True) and loose["one", "forecast_up", None, "forecast"] == (False, False)
    assert loose["up", "cohort_question", None, "cohort"] == loose["gone", "scope_refusal", None, "refusal"] == (True, True)
    assert not any(kind == "no such kind" for _, kind, _, _ in loose)
    df = spark.createDataFrame([("up", "segment_drag", None, s) for s in ("b", "a", None)],
                               "k string, signal_type string, claimed_ds date, claimed_segment string")
    got = {r.claimed_segment: r.detected for r in verify_claims(df, frames).collect()}
    assert got == {"b": True, "a": False, None: False}
    assert verify_claims(df.where("false"), frames).count() == 0


@pytest.mark.parametrize("strict", [False, True])
def test_frames_are_computed_once(spark, tmp_path, strict):
    ys = [100.0 + i + (60 if i == 50 else 0) for i in range(104)]
    frame = keyed(spark, {"up": ys, "down": ys[::-1]})
    frame.df.write.parquet(f"{tmp_path}/source")
    read = frame.with_df(spark.read.parquet(f"{tmp_path}/source").distinct())
    claims = spark.createDataFrame(
        [(k, t, WEEKS[50], None) for k in ("up", "down") for t in ("trend_up", "anomaly_spike", "forecast_up")],
        "k string, signal_type string, claimed_ds date, claimed_segment string")
    ops = ("trend", "growth", "forecast", "anomaly")
    out = verify_claims(claims, dict.fromkeys(ops, read), strict)
    files = out.inputFiles()
    assert files and not any("/source/" in f for f in files)  # no operator goes back to the source
    assert len({f.rsplit("/", 1)[0] for f in files}) == 1  # one table for the frame that all share
    plain = verify_claims(claims, dict.fromkeys(ops, frame), strict)
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect())) and out.where("detected").count() >= 4


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dates_against_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    start = date(1969, 11, 1)
    day = lambda: start + timedelta(days=int(rng.integers(0, 150)))
    asked = [(str(rng.choice(["a", "b", "c"])), day(), int(rng.choice([0, 1, 7]))) for _ in range(120)] + [("a", None, 7)]
    found = [(str(rng.choice(["a", "b", "d"])), day()) for _ in range(40)]
    got = near_dates(spark.createDataFrame(asked * 3, "k string, claimed_ds date, tolerance int"),
                     spark.createDataFrame(found * 3, "k string, ds date"), ["k"]).collect()
    want = {(k, d, t) for k, d, t in asked if d and any(k == j and abs((d - e).days) <= t for j, e in found)}
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_contract(claims):
    pairs = pr.generate_pairs(claims, all_true(claims), "1.0.0", "seed", types=["scope_refusal", "trend_up"])
    checked = pr.check_contract(pairs)
    assert checked.where("NOT ok_id OR NOT ok_code OR NOT ok_version").count() == 0
    # questions that do not end in a question mark, per seed
    assert checked.where("NOT ok_question").count() == 2 * 4
    bad = pairs.withColumns({"id": F.lit("x"), "library_version": F.lit("1"), "signal_type": F.lit("nope")})
    assert {r.violations for r in pr.check_contract(bad.where("question like '%?'")).collect()} == {3}


def pair_table(spark, n=200):
    rows = [(f"id{i}", "big" if i % 3 else f"t{i % 9}", i % 10 != 0, f"q{i}?", f"c{i}") for i in range(n)]
    return spark.createDataFrame(rows, "id string, signal_type string, verified boolean, question string, code string")


def test_replay_sample_is_exact_and_seeded(spark):
    d = pair_table(spark)
    want = {r.signal_type: min(7, r["n"]) for r in cur.breakdown(cur.verified_only(d)).collect()}
    first = cur.replay_sample(d, 7, 42)
    assert {r.signal_type: r["n"] for r in cur.breakdown(first).collect()} == want
    assert first.where("NOT verified").count() == 0
    ids = {r.id for r in first.collect()}
    assert ids == {r.id for r in cur.replay_sample(d.repartition(5), 7, 42).collect()}
    assert ids != {r.id for r in cur.replay_sample(d, 7, 43).collect()}


def test_mix_and_shuffle(spark):
    d = pair_table(spark, 60)
    mixed = cur.mix(d.where("signal_type = 'big'"), d.where("signal_type <> 'big'"))
    got = cur.seeded_shuffle(mixed, 42).collect()
    assert sorted(r.position for r in got) == list(range(1, 55))
    assert [r.id for r in sorted(got, key=lambda r: r.position)] != sorted(r.id for r in got)


def test_chat_formats(spark):
    d = spark.createDataFrame([("Q?", "code")], "question string, code string")
    row = d.select(
        cur.chat_text(F.col("question"), F.col("code"), "sys").alias("t"),
        cur.chat_messages(F.col("question"), F.col("code"), "sys").alias("m"),
    ).first()
    assert row.t == "<|im_start|>system\nsys<|im_end|>\n<|im_start|>user\nQ?<|im_end|>\n<|im_start|>assistant\ncode<|im_end|>"
    assert [(m.role, m.content) for m in row.m] == [("system", "sys"), ("user", "Q?"), ("assistant", "code")]


def test_chat_records_come_in_parts(spark):
    rows = [("hot", k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in reversed(range(25))] + [
        ("one", 0, "user", None), ("odd", None, "system", "s"), ("odd", 3, "b", "x"), ("odd", 3, "a", "y")]
    d = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {(r.conv_id, r.part): [tuple(m) for m in r.messages] for r in cur.chat_records(d, part_turns=10).collect()}
    hot = [("user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(25)]
    assert got == {("hot", 0): hot[:10], ("hot", 1): hot[10:20], ("hot", 2): hot[20:], ("one", 0): [("user", None)],
                   ("odd", 0): [("system", "s"), ("a", "y"), ("b", "x")]}


REFUSALS = [
    ("# This question is outside the scope of sales analysis.", True),
    ("# Cannot answer this, not supported", True),
    ("# That is out of scope", True),
    ("# not something I support", True),
    ("sf = load_sales('data.csv')\nnarrate(growth_metrics(sf))", False),
    ("# outside the scope\nsf = load_sales('data.csv')", False),
    ("# outside\n# the scope", False),
]


def test_refusal_classifier(spark):
    d = spark.createDataFrame(REFUSALS, "code string, want boolean")
    assert d.where(ev.is_refusal(F.col("code")) != F.col("want")).count() == 0


def answers(spark):
    rows = [
        ("a", "trend_up", "narrate(x)", True, True), ("b", "trend_up", "narrate(x)", True, False),
        ("c", "trend_down", "oops", False, True), ("d", "trend_up", "# outside the scope", False, False),
        ("e", "scope_refusal", "# cannot do that", True, True), ("f", "scope_refusal", "narrate(x)", True, True),
        ("g", "mystery", "narrate(x)", True, True),
    ]
    return spark.createDataFrame(rows, "question string, signal_type string, code string, ran_ok boolean, detected_ok boolean")


def test_scoring_and_metrics(spark):
    got = {r.question: (r.passed, r.signal_detected, r.error) for r in ev.score_answers(answers(spark)).collect()}
    assert got == {
        "a": (True, True, ""), "b": (True, False, ev.NOT_DETECTED), "c": (False, False, ""), "d": (True, True, ""),
        "e": (True, True, ""), "f": (False, False, ev.NOT_REFUSED), "g": (False, False, "Unknown signal_type: mystery"),
    }
    m = ev.metrics(ev.score_answers(answers(spark))).first()
    assert (m.eval_set_size, m.pass_at_1, m.signal_detection_accuracy, m.scope_refusal_accuracy) == (7, 0.6, 0.4, 0.5)
    strict = ev.metrics(ev.score_answers(answers(spark), "strict")).first()
    assert (strict.pass_at_1, strict.signal_detection_accuracy) == (0.4, 0.2)
    only = ev.metrics(ev.of_types(ev.score_answers(answers(spark)), ["trend_up"])).first()
    assert only.eval_set_size == 3 and only.scope_refusal_accuracy is None
    none = ev.metrics(ev.of_types(ev.score_answers(answers(spark)), ["nope"])).first()
    assert (none.eval_set_size, none.pass_at_1, none.scope_refusal_accuracy) == (0, 0.0, None)


def test_report_round_trip_and_comparison(spark, tmp_path, monkeypatch):
    results = ev.score_answers(answers(spark))
    old = ev.build_report(results.where("question = 'a'"), "org/m", "set", "1.0.0", "2026-01-01T00:00:00", 1.26)
    new = ev.build_report(results, "org/m", "set", "1.0.0", "2026-02-01T00:00:00", 2.0, ["trend_up"])
    a, b = (records.write_report(r, str(tmp_path)) for r in (old, new))
    assert a.endswith("org-m-2026-01-01T00-00-00.json")
    got = records.latest_report(spark, f"{tmp_path}/org-m-*.json")
    head = got.header.first()
    assert head.timestamp == "2026-02-01T00:00:00" and head.signal_type_filter == ["trend_up"] and got.results.count() == 7
    first = records.latest_report(spark, a)
    rows = {r.metric: (r.a, r.b, r.delta) for r in ev.compare_headers(first.header, got.header).collect()}
    assert rows["eval_set_size"] == ("1", "7", None) and rows["pass_at_1"] == ("1.0", "0.6", -0.4)
    by_type = {r.signal_type: r for r in ev.compare_by_type(first.results, got.results).collect()}
    assert by_type["trend_up"].rate_a == 1.0 and by_type["trend_up"].delta == 0.0
    assert by_type["mystery"].rate_a is None and by_type["mystery"].total_b == 1
    many = spark.range(0, 400, 1, 7).select(
        F.concat(F.lit("q"), F.col("id")).alias("question"), F.lit("trend_up").alias("signal_type"), F.lit("").alias("code"),
        (F.col("id") % 2 == 0).alias("ran_ok"), F.lit(True).alias("detected_ok"))
    kept = records.write_report(ev.build_report(ev.score_answers(many), "order", "s", "1", "2026-03-02"), str(tmp_path))
    back = records.latest_report(spark, kept).results.orderBy("position").collect()
    assert [r.question for r in back] == [f"q{k}" for k in range(400)]
    split = records.write_report(ev.build_report(results, "z", "s", "1", "2026-03-01"), str(tmp_path))
    assert records.latest_report(spark, split).results.count() == 7
    with pytest.raises(Exception):
        records.latest_report(spark, f"{tmp_path}/absent-*.json")


def test_pair_files(spark, claims, tmp_path):
    pairs = pr.generate_pairs(claims, all_true(claims), "1.0.0", "seed", types=["scope_refusal"])
    path = str(tmp_path / "pairs")
    records.write_pairs(pairs, path)
    assert sorted(records.read_pairs(spark, path).collect()) == sorted(pairs.collect())
    other = tmp_path / "x.jsonl"
    other.write_text('{"question": "Q?", "lib": "2.0.0", "dataset_seed": 3}\n\n{"question": "R?", "lib": "2.0.0"}\n')
    got = records.read_pairs(spark, str(other), version_field="lib").collect()
    assert [(r.question, r.library_version) for r in got] == [("Q?", "2.0.0"), ("R?", "2.0.0")]


def test_replay_rows_meet_their_own_prefix(spark):
    """Types in a sample do not gather all their rows: nearly all are left out before the join."""
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 1000 == 0, F.lit("rare")).otherwise(F.lit("common")).alias(
        "signal_type"), F.lit(True).alias("verified"))
    got = cur.replay_sample(rows, 25, 42)
    with contextlib.redirect_stdout(io.StringIO()) as out:
        got.explain()
    joins = [line for line in out.getvalue().splitlines() if "Join" in line]
    assert any("__p#" in line and "__prefix" in line for line in joins) and "Subquery" in out.getvalue()
    for kind in ("rare", "common"):
        want = rows.where(F.col("signal_type") == kind).orderBy(cur.seeded_key(F.col("id"), 42), "id").limit(25)
        assert {r.id for r in got.where(F.col("signal_type") == kind).collect()} == {r.id for r in want.collect()}
