"""Exact Jaccard join of word shingle sets in their metric space.

Unrelated documents lie at distance 1 from one another, so pivots alone cannot part a corpus: all would be in each
other's windows.  A first cut parts it without loss.  The shingles of a set are put in one order for all sets, those
that many sets hold last.  Two sets that link differ in so few shingles that they have one in common among the first
of each, its prefix, so sets without a common prefix shingle never meet, and a frequent passage brings none together.
Sets that meet are then held against each other by sketches: one bit for each bucket of shingles, set where it holds an
odd number.  Two sets differ in at least as many shingles as their sketches in bits, so a pair whose sketches differ in
more than a link allows is none.  Sets connected by the pairs that are left form regions.

In a region that is larger than a cell, pivots create Voronoi cells.  A set goes to its nearest pivot's cell and, by
the triangle inequality, to each cell whose pivot is at most twice the radius farther; sets far from all pivots have
a cell of their own.  Cells are regions of the next round.  What rounds cannot part is joined in blocks: ordered by
size, each block with those whose sizes are within the radius.  Every region is joined exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import components, pieces_of, stored
from .shingles import mixed, shingle_hashes, word_hashes

#: A part of the shingle universe of which a set holds so many or less is compared as a whole.  It suits similarities
#: of LEAF / (LEAF + 1) and more.
LEAF = 9
#: Bits of the sketch of a set of up to SMALL shingles; SKETCH_STEP times as many of both for each larger class.
SKETCH, SMALL, SKETCH_STEP = 1024, 2_000, 32
#: Frequent shingles that are put last; sets of a prefix shingle that meet as pairs, and that one task holds together.
OFTEN, FEW, MEETING = 200_000, 16, 1024
#: Sets that one task joins at once, pivots of a larger region, rounds of cells.
CELL, PIVOTS, ROUNDS = 128, 8, 2


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct shingles of every text one after another, first of every text and the end).  A text with
    fewer than n words has its whole sequence as one shingle."""
    words, starts = word_hashes(texts)
    values, bounds = shingle_hashes(words, starts, n)
    sets = []
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b > a:
            own = np.sort(values[a:b])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            own = words[starts[k]:starts[k + 1]]
            value = np.full(min(1, len(own)), len(own), np.uint64)
            for j, w in enumerate(own):
                value = mixed(value + w, 100 + j)
            sets.append(value)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64),
            np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64))


def leaf_for(percent: int) -> int:
    """The largest leaf, at most LEAF, that suits a similarity of `percent`."""
    return LEAF if percent >= 100 else min(LEAF, percent // (100 - percent))


def leaf_signatures(values: np.ndarray, bounds: np.ndarray, most: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of the leaves of every set: a hash of the part and of what the set holds of it."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    content, owners, signatures, depth = mixed(values, 7), [], [], 0
    while len(values) and depth <= 64:
        prefix = values >> np.uint64(64 - depth) if depth else np.zeros(len(values), np.uint64)
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (prefix[1:] != prefix[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(values)))
        leaf = size <= most
        total = np.add.reduceat(content, first)
        owners.append(owner[first[leaf]])
        signatures.append(mixed(total[leaf] + mixed(prefix[first[leaf]], depth), 11))
        go = np.repeat(size >= most, size)  # with exactly that many both: a set of one more has no leaf here
        values, owner, content, depth = values[go], owner[go], content[go], depth + 1
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(signatures)


def set_numbers(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit number of each set's content, 0 for an empty set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values, 3), dtype=np.uint64)])
    size = np.diff(bounds)
    return np.where(size, mixed(sums[bounds[1:]] - sums[bounds[:-1]] + size.astype(np.uint64), 5), 0).view(np.int64)


def sketches(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The size of every set and the bits of its sketch, as 64-bit numbers."""
    content, out = mixed(values, 13), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        bits, most = SKETCH, SMALL
        while b - a > most:
            bits, most = bits * SKETCH_STEP, most * SKETCH_STEP
        odd = np.bincount((content[a:b] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.int64(b - a).tobytes() + np.packbits(odd.astype(np.uint8)).tobytes())
    return out


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) of the same sets with fewer buckets."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), 1)


def described(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, node (number of its set's content), n_shingles and sketch of every row.  The first row of a piece of
    a batch also has the shingles that two or more different sets of the piece hold."""
    def run(batches):
        for batch in batches:
            for rows in pieces_of(batch):
                values, bounds = shingle_sets(rows.column("text"), n)
                node, size = set_numbers(values, bounds), np.diff(bounds)
                first = np.zeros(len(node), bool)
                first[np.unique(node, return_index=True)[1]] = True
                shingle, held = np.unique(values[np.repeat(first, size)], return_counts=True)
                often = [shingle[held > 1].view(np.int64), *[None] * (len(node) - 1)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(node), pa.array(size), pa.array(sketches(values, bounds), pa.binary()),
                     pa.array(often, pa.list_(pa.int64()))], ["doc_id", "node", "n_shingles", "sketch", "often"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, node long, n_shingles long, sketch binary, often array<long>")


def frequent_shingles(seen: DataFrame, most: int = OFTEN) -> np.ndarray:
    """Up to `most` shingles that pieces of batches hold often, the most frequent last.  Any list gives the same links;
    a good one keeps frequent shingles out of prefixes."""
    counts = seen.select(F.explode("often").alias("s")).groupBy("s").agg(F.count("*").alias("c"))
    rows = counts.orderBy(F.desc("c"), "s").limit(most).toPandas()
    return rows["s"].to_numpy(np.int64).view(np.uint64)[::-1]


def prefixes(values: np.ndarray, bounds: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, shingle) of the prefix of every set: so many of its first shingles that any set which links with it has
    one of them in its own prefix.  The shingles of `often` come last, in their order."""
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    rank = np.zeros(len(values), np.int64)
    if len(often):
        by_value = np.argsort(often)
        at = np.searchsorted(often[by_value], values)
        at[at == len(often)] = 0
        rank = np.where(often[by_value][at] == values, by_value[at] + 1, 0)
    order = np.lexsort((rank, owner))
    length = np.where(size, size - (size * percent + 99) // 100 + 1, 0)
    chosen = order[np.arange(len(values)) - np.repeat(bounds[:-1], size) < np.repeat(length, size)]
    return owner[chosen], values[chosen]


def prefix_rows(docs: DataFrame, n: int, percent: int, often: np.ndarray) -> DataFrame:
    """region (a prefix shingle), node and n (size) of the prefixes of all sets, those of a piece of a batch once."""
    def run(batches):
        for batch in batches:
            for rows in pieces_of(batch):
                values, bounds = shingle_sets(rows.column("text"), n)
                node = set_numbers(values, bounds)
                owner, shingle = prefixes(values, bounds, often, percent)
                first = np.zeros(len(node), bool)
                first[np.unique(node, return_index=True)[1]] = True
                new = first[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingle[new].view(np.int64)), pa.array(node[owner[new]]),
                     pa.array(np.diff(bounds)[owner[new]])], ["region", "node", "n"])

    return docs.select("text").mapInArrow(run, "region long, node long, n long")


def may_link(size, others, apart, percent: int):
    """Whether sets of these sizes whose sketches differ in `apart` bits may link."""
    return ((100 * np.minimum(size, others) >= percent * np.maximum(size, others))
            & ((100 + percent) * apart <= (100 - percent) * (size + others)))


def sketched_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, one, two: their sketches) that may link."""
    def run(batches):
        for batch in batches:
            one, two = batch.column("one"), batch.column("two")
            lengths = np.stack([pc.binary_length(c).to_numpy() for c in (one, two)], 1)
            keep = np.zeros(batch.num_rows, bool)
            for pair in np.unique(lengths, axis=0):
                at = np.flatnonzero((lengths == pair).all(1))
                x, y = (np.frombuffer(b"".join(c.take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), -1)
                        for c in (one, two))
                words = int(pair.min()) // 8 - 1
                apart = np.bitwise_count(folded(x[:, 1:], words) ^ folded(y[:, 1:], words)).sum(1).astype(np.int64)
                keep[at] = may_link(x[:, 0].astype(np.int64), y[:, 0].astype(np.int64), apart, percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long")


def meeting_pairs(nodes, sets, sides, percent: int):
    """(a, b) that connect the sets, given by their sketches, as all pairs of them that may link do."""
    size = np.array([int(s[0]) for s in sets], np.int64)
    words = np.array([len(s) - 1 for s in sets])
    own = {w: np.flatnonzero(words == w) for w in np.unique(words).tolist()}
    bits = {(w, v): folded(np.stack([sets[k][1:] for k in at.tolist()]), v) for w, at in own.items() for v in own if v <= w}
    place = np.zeros(len(sets), np.int64)
    for at in own.values():
        place[at] = np.arange(len(at))
    a, b, new = [], [], np.ones(len(sets), bool)
    for k in range(len(sets)):
        todo, new[k] = [k] if new[k] else [], False
        while todo:
            one = todo.pop()
            for w, at in own.items():
                at = at[new[at]]
                if len(at):
                    v = min(w, int(words[one]))
                    apart = np.bitwise_count(bits[w, v][place[at]] ^ bits[int(words[one]), v][place[one]]).sum(1).astype(np.int64)
                    met = at[may_link(size[one], size[at], apart, percent)]
                    new[met] = False
                    todo += met.tolist()
                    a += [nodes[one]] * len(met)
                    b += nodes[met].tolist()
    return a, b


def region_edges(docs: DataFrame, nodes: DataFrame, n: int, percent: int, often: np.ndarray,
                 few: int = FEW, meeting: int = MEETING) -> DataFrame:
    """Edges (a, b) that connect the nodes as all pairs with a common prefix shingle whose sketches may link do.

    First every node of a prefix shingle meets the smallest one.  Only where this does not connect all nodes of a
    shingle do the others meet: where they are few as pairs, each once for all its shingles, else with their sketches
    at one place, in blocks where they are many."""
    key = Window.partitionBy("region")
    members = stored(prefix_rows(docs, n, percent, often).withColumns(
        {"low": F.min(F.struct("node", "n")).over(key), "high": F.max("node").over(key)}).where("low.node < high").select(
        "region", "node", "n", "low").distinct())
    near = "100 * least(n, {0}) >= {1} * greatest(n, {0})"  # sizes that may link, before any sketch is fetched
    sketch = nodes.select("node", F.col("n_shingles").alias("n"), F.col("sketch").alias("items"))

    def met(pairs):
        for side, name in (("a", "one"), ("b", "two")):
            pairs = pairs.join(sketch.select(F.col("node").alias(side), F.col("items").alias(name)), side)
        return stored(sketched_pairs(pairs.select("a", "b", "one", "two"), percent))

    stars = met(members.where("node <> low.node").where(near.format("low.n", percent)).select(
        F.col("low.node").alias("a"), F.col("node").alias("b")).distinct())
    parts = members.join(components(stars), "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = stored(parts.withColumns(
        {"first": F.min("component").over(key), "last": F.max("component").over(key), "m": F.count("*").over(key)}).where(
        "first < last AND m > 2").select("region", "node", "n", "low", "component", "m"))
    rest = apart.where(F.col("m") <= few).where("node <> low.node").select("region", "node", "n", "component")
    other = rest.select("region", F.col("node").alias("b"), F.col("n").alias("n2"), F.col("component").alias("c"))
    pairs = met(rest.join(other, "region").where("node < b AND component <> c").where(near.format("n2", percent)).select(
        F.col("node").alias("a"), "b").distinct())
    rows = stored(apart.where(F.col("m") > few).select("region", "node", "m").join(sketch, "node"))
    small = rows.where(F.col("m") <= meeting).select("region", "node", "items", F.lit(0).alias("side"))
    return stars.union(pairs).union(join_cells(small, ["region"], percent, meeting_pairs)).union(
        block_links(rows.where(F.col("m") > meeting).drop("m"), percent, meeting, meeting_pairs))


def sets_of(regions: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """region, node, its set (64-bit numbers, ascending) for the nodes of regions (region, node, doc_id)."""
    def run(batches):
        for batch in batches:
            for rows in pieces_of(batch):
                values, bounds = shingle_sets(rows.column("text"), n)
                same = np.flatnonzero(set_numbers(values, bounds) == rows.column("node").to_numpy())
                data = values.tobytes()
                cut = [(8 * bounds[k], 8 * bounds[k + 1]) for k in same.tolist()]
                at = pa.array(same)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("region").take(at), rows.column("node").take(at), pa.array(np.diff(bounds)[same]),
                     pa.array([data[a:b] for a, b in cut], pa.binary())], ["region", "node", "n", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return regions.join(texts, "doc_id").select("region", "node", "text").mapInArrow(
        run, "region long, node long, n long, items binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set with each right set."""
    common = np.intersect1d(np.unique(np.concatenate([*left, np.zeros(0, np.uint64)])),
                            np.unique(np.concatenate([*right, np.zeros(0, np.uint64)])), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)

    def grid(sets, own):
        rows = np.zeros((len(sets), len(own)), np.float32)
        for k, s in enumerate(sets):
            at = np.searchsorted(own, s)
            at[at == len(own)] = 0
            rows[k, at[own[at] == s]] = 1
        return rows

    for k in range(0, len(common), 16_384):
        own = common[k:k + 16_384]
        out += grid(left, own) @ grid(right, own).T
    return out.astype(np.int64)


def link_pairs(nodes, sets, sides, percent: int):
    """(a, b) of linked sets.  sides: 0 for sets joined with all, 1 or 2 for those joined with the other side only."""
    size = np.array([len(s) for s in sets])
    both = overlaps(sets, sets)
    union = size[:, None] + size[None, :] - both
    apart = (sides[:, None] != sides[None, :]) | (sides[:, None] == 0)
    a, b = np.nonzero(np.triu((100 * both >= percent * union) & apart, 1))
    return nodes[a], nodes[b]


def join_cells(rows: DataFrame, keys: list[str], percent: int, link=link_pairs) -> DataFrame:
    """Linked pairs (a, b) within each group of rows (keys, node, items, side); groups are at most two blocks."""
    def run(key, group):
        nodes = group.column("node").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("items").to_pylist()]
        a, b = link(nodes, sets, group.column("side").to_numpy(), percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy(*keys).applyInArrow(run, "a long, b long")


def voronoi(large: DataFrame, percent: int) -> DataFrame:
    """Rows (region, node, n, items) of large regions, each in the cells that it belongs to.

    Pivots are the sets first by a hash of their number; at most PIVOTS for each region, so that an array of them
    goes with every set of it."""
    order = F.xxhash64("node")
    rank = F.row_number().over(Window.partitionBy("region", "slot").orderBy(order, "node"))
    pivots = (large.withColumn("slot", F.pmod(order, F.lit(PIVOTS))).withColumn("rank", rank).where("rank = 1")
              .groupBy("region").agg(F.collect_list("items").alias("pivots")))

    def run(batches):
        radius = 1 - percent / 100 + 1e-9
        for batch in batches:
            pivots = [[np.frombuffer(x, np.uint64) for x in p] for p in batch.column("pivots").to_pylist()]
            cells = []
            for items, own in zip(batch.column("items").to_pylist(), pivots):
                s = np.frombuffer(items, np.uint64)
                both = np.array([len(np.intersect1d(s, p, assume_unique=True)) for p in own])
                d = 1 - both / (len(s) + np.array([len(p) for p in own]) - both)
                near = d.min()
                cell = np.flatnonzero(d <= near + 2 * radius).tolist() if near < 1 else []
                cells.append(cell + ([-1] if near >= 1 - radius else []))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("region", "node", "n", "items")), pa.array(cells, pa.list_(pa.int32()))],
                ["region", "node", "n", "items", "cells"])

    dealt = large.join(pivots, "region").mapInArrow(
        run, "region long, node long, n long, items binary, cells array<int>")
    return dealt.withColumn("cell", F.explode("cells")).select(
        F.xxhash64("region", "cell").alias("region"), "node", "n", "items")


def region_links(sets: DataFrame, percent: int, cell: int = CELL, rounds: int = ROUNDS) -> DataFrame:
    """Linked pairs (a, b) among the sets (region, node, n, items) of each region."""
    links = None
    for step in range(rounds + 1):
        sizes = sets.groupBy("region").agg(F.count("*").alias("m"))
        marked = sets.join(sizes, "region")
        small = marked.where(F.col("m").between(2, cell)).withColumn("side", F.lit(0))
        found = join_cells(small.select("region", "node", "items", "side"), ["region"], percent)
        links = found if links is None else links.union(found)
        large = marked.where(F.col("m") > cell)
        if step == rounds or not large.limit(1).count():
            break
        dealt = stored(voronoi(large.drop("m"), percent))
        # A region that its pivots do not part, whose cells hold more pairs than it, stays as it is.
        worth = dealt.groupBy("region").agg(F.count("*").alias("m"))
        if (worth.agg(F.sum(F.col("m") * F.col("m"))).first()[0] or 0) > (
                sizes.where(F.col("m") > cell).agg(F.sum(F.col("m") * F.col("m"))).first()[0] or 0):
            break
        sets = dealt
    return links.union(block_links(large.drop("m"), percent, cell))


def block_links(sets: DataFrame, percent: int, block: int = CELL, link=link_pairs) -> DataFrame:
    """Linked pairs of large regions: blocks in order of size, joined where their sizes are within the radius."""
    order = Window.partitionBy("region").orderBy("n", "node")
    ranked = sets.select("region", "node", "n").distinct().withColumn(
        "block", F.floor((F.row_number().over(order) - 1) / block).cast("int"))
    span = ranked.groupBy("region", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = span.select("region", F.col("block").alias("block2"), F.col("low").alias("low2"))
    pairs = span.join(other, "region").where(
        (F.col("block2") >= F.col("block")) & (100 * F.col("high") >= percent * F.col("low2"))).select(
        "region", "block", "block2")
    sides = pairs.select("region", "block", "block2", F.explode(F.when(
        F.col("block") == F.col("block2"), F.array(F.struct(F.col("block").alias("of"), F.lit(0).alias("side"))))
        .otherwise(F.array(F.struct(F.col("block").alias("of"), F.lit(1).alias("side")),
                           F.struct(F.col("block2").alias("of"), F.lit(2).alias("side"))))).alias("s"))
    members = sides.select("region", "block", "block2", F.col("s.of").alias("of"), F.col("s.side").alias("side")).join(
        ranked.select("region", F.col("block").alias("of"), "node"), ["region", "of"])
    items = sets.select("region", "node", "items").dropDuplicates(["region", "node"])
    return join_cells(members.join(items, ["region", "node"]).select(
        "region", "block", "block2", "node", "items", "side"), ["region", "block", "block2"], percent, link)


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; percent must suit the leaf (leaf_for): 90 or more for LEAF.
    Any such leaf gives the same result; sets meet by prefixes, not by leaves.

    A-Z are lower-cased, words cut at white space.  Documents link when 100 * intersection >= percent * union.  A
    document without words, or with null text, has no shingle and is alone.  Equal sets are joined once, by a 64-bit
    number of their content.  Rows with a null doc_id link by their text but name no component; rows with equal
    doc_id are joined each by its own text.  Other columns are not read."""
    if leaf < 1 or percent * (leaf + 1) < 100 * leaf:
        raise ValueError(f"percent must be at least {100 * max(1, leaf) / (max(1, leaf) + 1):g}")
    seen = stored(described(docs, n))
    nodes = stored(seen.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    edges = region_edges(docs, nodes, n, percent, frequent_shingles(seen))
    regions = components(edges).select("node", F.col("component").alias("region"))
    sets = stored(sets_of(regions.join(nodes.select("node", "doc_id"), "node"), docs, n))
    linked = components(region_links(sets, percent))
    own = nodes.select("node", "doc_id").join(linked, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    named = own.join(own.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select(
        "node", "component_id")
    return seen.select("doc_id", "node", "n_shingles").join(named, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(
            F.col("doc_id")).alias("component_id"))
