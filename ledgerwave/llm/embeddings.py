"""Near-duplicate embeddings: binary codes by iterative quantisation, multi-index Hamming tables, exact reranking.

Rotations of the centred, normalised vectors are learnt on a bounded sample so that signs lose little.  Codes are cut
into substrings, one table each.  A vector joins the ball of a leader, the first vector of one of its buckets, if it
is within half of the linking angle: all of a ball are then linked without being paired.  Balls meet through the
buckets of all their members, where one side also looks some bits away; their centres' codes and then their vectors
decide: all linked, none linked, or members compared in blocks.  Longer substrings take more tables and more bits, so
that a pair at the linking angle meets with the same modelled chance at every size."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, stored

#: Rows of the sample that the rotations are fitted on.
SAMPLE = 4000
#: Tables at least, tables before another bit is looked away, tables of leaders.
TABLES, MOST_TABLES, BALL_TABLES = 8, 12, 4
#: Modelled chance at least (random planes) that two vectors at the linking angle meet in a table, and at most that
#: the codes of two linked balls differ in more bits than allowed.
RECALL, FAR_LOSS = 0.95, 1e-5
#: Bits in which the codes (64 bits) of a vector and its leader may differ.
NEAR_BITS = 16
#: Steps of the angle between centres for which the allowed bits are computed.
STEPS = 16
BLOCK = 256


def at_most(flips: int, bits: int, angle: float) -> float:
    """The chance that random planes give two vectors at this angle at most `flips` different ones of `bits` bits."""
    p = min(1.0, angle / math.pi)
    return sum(math.comb(bits, k) * p ** k * (1 - p) ** (bits - k) for k in range(flips + 1))


def search_plan(bits: int, theta: float) -> tuple[int, int]:
    """(tables, bits looked away) whose modelled chance at the angle theta is RECALL or more."""
    for flips in range(bits + 1):
        hit = at_most(flips, bits, theta)
        tables = 1 if hit >= 1 else math.ceil(math.log(1 - RECALL) / math.log1p(-hit)) if hit > 0 else math.inf
        if tables <= MOST_TABLES and flips:
            return max(TABLES, tables), flips
    return TABLES, bits


def far_bits(theta: float) -> list[int]:
    """Bits of 64 in which centres may differ whose angle is at most theta * (1 + k / STEPS), for k from 0 to STEPS."""
    return [next(f for f in range(65) if f == 64 or 1 - at_most(f, 64, theta * (1 + k / STEPS)) <= FAR_LOSS)
            for k in range(STEPS + 1)]


def fit_rotations(sample: np.ndarray, count: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotations): columns of each rotation are directions whose signs are the bits."""
    mean = sample.mean(0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    flat = centred @ axes
    out = []
    for k in range(count):
        turn = np.linalg.qr(np.random.default_rng(k).normal(size=(flat.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
            turn = (u @ vt).T
        out.append(axes @ turn)
    return mean, np.stack(out)


def unit(column: pa.Array) -> np.ndarray:
    values = np.array(column.flatten().to_pylist(), np.float64) if column.null_count else column.flatten().to_numpy(
        zero_copy_only=False).astype(np.float64)
    return directions(values.reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def directions(grid: np.ndarray) -> np.ndarray:
    """Rows of length 1.  A power of two, which is exact, first brings each row near 1: squares of very large or very
    small components would leave the range of a double."""
    _, exponent = np.frexp(np.abs(grid).max(1, keepdims=True))
    grid = np.ldexp(np.ldexp(grid, -(exponent // 2)), exponent // 2 - exponent)
    return grid / np.linalg.norm(grid, axis=1, keepdims=True)


def valid(vectors: str) -> "F.Column":
    """Not null, without null or non-finite components, not zero."""
    v = F.col(vectors)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def coded(rows: DataFrame, mean: np.ndarray, turns: np.ndarray, bits: int, tables: int) -> DataFrame:
    """rows (key, embedding) with code (first 64 bits) and the bucket of each table."""
    def run(batches):
        for batch in batches:
            u = unit(batch.column("embedding")) - mean
            signs = np.concatenate([u @ t >= 0 for t in turns], axis=1)
            head = np.zeros((len(signs), 64), bool)
            head[:, :min(64, signs.shape[1])] = signs[:, :64]
            code = np.packbits(head, axis=1).view(">i8").astype(np.int64).reshape(-1)
            weight = np.int64(1) << np.arange(bits)
            buckets = np.stack([signs[:, t * bits:(t + 1) * bits] @ weight for t in range(tables)], 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("embedding"), batch.column("n"), pa.array(code),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, tables * len(code) + 1, tables), pa.int32()),
                                          pa.array(buckets.reshape(-1).astype(np.int64)))],
                ["key", "embedding", "n", "code", "buckets"])

    return rows.select("key", "embedding", "n").mapInArrow(
        run, "key long, embedding array<double>, n long, code long, buckets array<long>")


def differing(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def with_cosine(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, va, vb, ...) with their vectors replaced by the cosine."""
    names = [c for c in pairs.columns if c not in ("va", "vb")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema if f.name in names)

    def run(batches):
        for batch in batches:
            cos = (unit(batch.column("va")) * unit(batch.column("vb"))).sum(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(cos)], [*names, "cos"])

    return pairs.mapInArrow(run, f"{kinds}, cos double")


def balls_of(codes: DataFrame, half: float) -> DataFrame:
    """key, ball (the leader's key), n, embedding, angle to the leader.  A vector that leads a bucket is its own
    leader; any other has the nearest of its buckets' leaders within the half angle, else itself."""
    places = codes.select("key", "code", F.posexplode(F.slice("buckets", 1, BALL_TABLES)).alias("t", "bucket"))
    lead = places.groupBy("t", "bucket").agg(F.min(F.struct("key", "code")).alias("l"))
    met = places.join(lead, ["t", "bucket"]).select("key", "code", F.col("l.key").alias("leader"),
                                                    F.col("l.code").alias("code2"))
    own = met.where("key = leader").select("key").distinct()
    near = met.where(differing("code", "code2") <= NEAR_BITS).select("key", "leader").distinct().join(
        own, "key", "left_anti")
    vectors = codes.select("key", "embedding")
    pairs = near.join(vectors.withColumnRenamed("embedding", "va"), "key").join(
        vectors.select(F.col("key").alias("leader"), F.col("embedding").alias("vb")), "leader")
    close = with_cosine(pairs).where(F.col("cos") >= math.cos(half - 1e-6))
    best = close.groupBy("key").agg(F.max_by("leader", F.struct("cos", "leader")).alias("ball"),
                                    F.max("cos").alias("cos"))
    angle = F.acos(F.least(F.lit(1.0), F.col("cos"))) + 1e-7
    return codes.join(best, "key", "left").select(
        "key", F.coalesce("ball", "key").alias("ball"), "n", "embedding", "code", "buckets",
        F.when(F.col("ball").isNull(), 0.0).otherwise(angle).alias("angle"))


def ball_pairs(members: DataFrame, centres: DataFrame, bits: int, flips: int, theta: float) -> DataFrame:
    """Pairs a < b of balls of which two members fall into one bucket of a table, or into two that differ in at most
    `flips` bits, with centres whose codes differ in no more bits than far_bits allows at the linking angle and both
    radii."""
    places = members.select("ball", F.posexplode("buckets").alias("t", "bucket")).distinct().join(
        centres.select("ball", "code", "radius"), "ball")
    masks = [sum(1 << k for k in c) for n in range(flips + 1) for c in combinations(range(bits), n)]
    # Whoever looks away is the smaller key of a pair.
    probes = places.select(F.col("ball").alias("a"), F.col("code").alias("code_a"), F.col("radius").alias("radius_a"), "t",
                           "bucket").withColumn("mask", F.explode(F.lit(masks).cast("array<bigint>"))).withColumn(
        "bucket", F.col("bucket").bitwiseXOR(F.col("mask"))).drop("mask")
    met = probes.join(places.select(F.col("ball").alias("b"), "code", "radius", "t", "bucket"), ["t", "bucket"])
    step = F.ceil((F.col("radius_a") + F.col("radius")) * (STEPS / theta) - 1e-9).cast("int")
    allowed = F.element_at(F.lit(far_bits(theta)), F.least(F.lit(STEPS), step) + 1)
    return met.where((F.col("a") < F.col("b")) & (differing("code_a", "code") <= allowed)).select("a", "b").distinct()


def compared(pairs: DataFrame, members: DataFrame, cosine: float) -> DataFrame:
    """key, other (ball), m: linked rows of the other ball for each member of the balls of pairs, block by block."""
    parts = members.groupBy("ball").agg(F.max("part").alias("parts"))
    blocks = pairs.join(parts.select(F.col("ball").alias("a"), F.col("parts").alias("pa")), "a").join(
        parts.select(F.col("ball").alias("b"), F.col("parts").alias("pb")), "b")
    blocks = blocks.withColumn("i", F.explode(F.sequence(F.lit(0), "pa"))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), "pb"))).select("a", "b", "i", "j")
    sides = blocks.select("a", "b", "i", "j", F.explode(F.array(
        F.struct(F.col("a").alias("ball"), F.col("i").alias("part"), F.lit(0).alias("side")),
        F.struct(F.col("b").alias("ball"), F.col("j").alias("part"), F.lit(1).alias("side")))).alias("s")).select(
        "a", "b", "i", "j", "s.*")

    def run(key, group):
        side = group.column("side").to_numpy()
        keys, n = group.column("key").to_numpy(), group.column("n").to_numpy()
        u = unit(group.column("embedding").combine_chunks())
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        hit = np.einsum("ik,jk->ij", u[one], u[two]) >= cosine
        a, b = key[0].as_py(), key[1].as_py()
        m = np.concatenate([hit @ n[two], hit.T @ n[one]])
        other = np.concatenate([np.full(len(one), b), np.full(len(two), a)])
        own = np.concatenate([np.full(len(one), a), np.full(len(two), b)])
        keep = m > 0
        return pa.table({"key": pa.array(np.concatenate([keys[one], keys[two]])[keep], pa.int64()),
                         "own": pa.array(own[keep], pa.int64()), "other": pa.array(other[keep], pa.int64()),
                         "m": pa.array(m[keep], pa.int64())})

    return sides.join(members.select("ball", "part", "key", "n", "embedding"), ["ball", "part"]).groupBy(
        "a", "b", "i", "j").applyInArrow(run, "key long, own long, other long, m long")


def near_vectors(vectors: DataFrame, cosine: float = 0.9, sample: int = SAMPLE,
                 bits: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors that are null, zero or hold null or non-finite components link with nothing; others link with vectors of
    their own length, each length in a search of its own.  Equal rows are linked like others.  A null vec_id links but
    names no component.  Other columns are not read.  `bits` of a table follow the number of rows unless given."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("embedding")).withColumn("ok", valid("embedding"))
    out = rows.where("NOT ok").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    good = rows.where("ok")
    for r in good.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("c")).orderBy("d").collect():
        same = good.where(F.size("embedding") == r.d)
        out = out.union(near_of_length(same, r.d, r.c, cosine, sample, bits))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def near_of_length(good: DataFrame, dim: int, total: int, cosine: float, sample: int, bits: int | None) -> DataFrame:
    """vec_id, n_links, component_id of `total` valid vectors of one length."""
    keyed = stored(good.groupBy("vec_id", "embedding").agg(
        F.count("*").alias("n")).withColumn("key", F.xxhash64("vec_id", "embedding")))
    share = min(1.0, 2 * sample / total)
    fit_rows = keyed.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(
        "embedding").limit(sample).collect()
    grid = np.array([r.embedding for r in fit_rows] or [[1.0] * dim])
    bits = bits or min(24, max(12, math.ceil(math.log2(total + 1))))
    theta = math.acos(cosine)
    tables, flips = search_plan(bits, theta)
    mean, turns = fit_rotations(directions(grid), -(-tables * bits // dim))
    codes = stored(coded(keyed, mean, turns, bits, tables))
    members = stored(balls_of(codes, theta / 2))
    centres = members.groupBy("ball").agg(F.sum("n").alias("size"), F.max("angle").alias("radius")).join(
        codes.select(F.col("key").alias("ball"), "embedding", "code"), "ball")
    centres = stored(centres)
    facts = centres.select("ball", "size", "radius", "embedding")
    pairs = ball_pairs(members, centres, bits, flips, theta).join(facts.toDF("a", "size_a", "radius_a", "va"), "a").join(
        facts.toDF("b", "size_b", "radius_b", "vb"), "b")
    seen = with_cosine(pairs)
    angle, reach = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cos")))), F.col("radius_a") + F.col("radius_b")
    single = reach == 0
    state = F.when(single, F.when(F.col("cos") >= cosine, "all").otherwise("none")).when(
        angle + reach <= theta - 1e-6, "all").when(angle - reach > theta + 1e-6, "none").otherwise("some")
    judged = stored(seen.withColumn("state", state).where("state <> 'none'").select("a", "b", "size_a", "size_b", "state"))
    whole = judged.where("state = 'all'")
    by_ball = whole.select(F.col("a").alias("ball"), F.col("size_b").alias("m")).union(
        whole.select("b", "size_a")).groupBy("ball").agg(F.sum("m").alias("from_balls"))
    part = F.pmod(F.xxhash64(F.lit(1), "key"), F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK))).cast("int")
    split = members.select("ball", "key", "n", "embedding").join(facts.select("ball", "size"), "ball").withColumn("part", part)
    partly = stored(compared(judged.where("state = 'some'").select("a", "b"), split, cosine))
    by_row = partly.groupBy("key").agg(F.sum("m").alias("from_rows"))
    edges = whole.select("a", "b").union(partly.select(F.col("own").alias("a"), F.col("other").alias("b")).distinct())
    linked = components(edges).withColumnRenamed("node", "ball")
    out = members.select("key", "ball").join(keyed.select("key", "vec_id", "n"), "key").join(
        facts.select("ball", "size"), "ball").join(by_ball, "ball", "left").join(by_row, "key", "left").join(
        linked, "ball", "left").withColumn("component", F.coalesce("component", "ball"))
    first = out.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return out.join(first, "component").select(
        "vec_id", (F.col("size") - 1 + F.coalesce("from_balls", F.lit(0)) + F.coalesce("from_rows", F.lit(0)))
        .cast("long").alias("n_links"), "component_id", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")).drop("copy")
