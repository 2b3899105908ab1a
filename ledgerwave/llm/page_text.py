"""Main text of web pages: flat text blocks judged by a decision tree.

A block is known by its words and link density, by those of its neighbours, and by the named place it stands in, if the
page names places.  The tree is grown on the small labelled table below, by Gini impurity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pieces_of, small_batches
from .page_blocks import blocks

FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "inside", "around",
            "heading", "best inside of the page")

#: Labelled blocks, a page each paragraph: words, linked words, inside (1 main part, 2 article), around (1: in a place
#: that is no article), heading, and the label: 1 for main text.
LABELLED = """
5 5 0 1 0 0
3 3 0 1 0 0
9 0 2 0 1 1
64 0 2 0 0 1
2 0 2 0 0 1
118 6 2 0 0 1
1 0 2 0 0 1
33 0 2 1 0 0
14 0 0 1 0 0

1 1 0 1 0 0
1 1 0 1 0 0
1 1 0 1 0 0
12 0 0 1 0 0
6 0 2 0 1 1
1 0 2 0 0 1
4 4 2 0 0 1
7 7 2 0 0 1
240 3 2 0 0 1
9 1 0 1 0 0

2 2 0 0 0 0
21 2 0 0 0 0
8 0 2 0 1 1
35 0 2 0 0 1
3 0 2 0 1 1
90 12 2 0 0 1
56 0 0 0 0 0
7 0 0 0 1 0
6 6 0 0 0 0
28 0 0 1 0 0

4 0 0 1 1 0
7 0 1 0 1 1
5 1 1 0 0 1
48 0 1 0 0 1
3 0 1 0 0 1
77 4 1 0 0 1
2 2 1 0 0 1
51 0 1 1 0 0
4 4 1 1 0 0
60 0 0 0 0 0
11 2 0 0 0 0

2 2 0 0 0 0
2 2 0 0 0 0
2 2 0 0 0 0
8 0 0 0 1 1
55 0 0 0 0 1
43 2 0 0 0 1
6 0 0 0 0 1
72 0 0 0 0 1
9 0 0 0 0 0

4 0 0 0 0 0
1 1 0 0 0 0
1 1 0 0 0 0
1 1 0 0 0 0
5 0 0 0 1 1
30 0 0 0 0 1
4 0 0 0 1 1
110 9 0 0 0 1
17 0 0 0 0 1
24 0 0 0 0 1
3 3 0 0 0 0
5 5 0 0 0 0
12 4 0 0 0 0
6 0 0 0 0 0

3 3 0 0 0 0
10 8 0 0 0 0
22 15 0 0 0 0
38 0 0 0 0 1
20 1 0 0 0 1
41 0 0 0 0 1
14 9 0 0 0 0
18 18 0 0 0 0
4 2 0 0 0 0

6 0 0 0 1 1
150 0 0 0 0 1

300 10 0 0 0 1

4 4 0 0 0 0
6 6 0 0 0 0
5 5 0 0 0 0
30 30 0 0 0 0

7 0 1 0 1 1
8 0 2 0 1 1
70 2 2 0 0 1
5 0 2 0 0 1
45 0 2 1 0 0
80 1 2 1 0 0
6 0 1 1 1 0
62 0 1 1 0 0
40 0 0 1 0 0
130 0 0 1 0 0

9 0 0 1 1 0
18 0 0 1 0 0
90 0 0 1 0 0
5 0 0 1 0 0

1 1 0 1 0 0
7 0 2 0 1 1
3 0 2 0 0 1
2 0 2 0 0 1
5 0 2 0 0 1
1 0 2 0 0 1
4 0 2 0 0 1
6 0 2 0 1 1
2 0 2 0 1 1
8 0 2 0 0 1
1 0 2 0 0 1
9 0 0 1 0 0

6 0 0 0 0 0
4 0 0 0 0 0
40 0 0 0 0 0
5 0 2 0 1 1
12 0 2 0 0 1
2 0 2 0 0 1
3 3 2 0 0 1
5 5 2 0 0 1
1 1 2 0 0 1
20 18 2 0 0 1
2 0 2 0 0 1
70 0 0 0 0 0
150 0 0 0 0 0
6 0 0 0 0 0

45 0 0 0 0 0
80 0 0 0 0 0
6 0 0 0 1 0
10 0 2 0 1 1
4 0 2 0 0 1
160 8 2 0 0 1
3 0 2 0 0 1
25 20 2 0 0 1
90 0 0 0 0 0
100 0 0 0 0 0
33 0 0 0 1 0
12 0 0 0 0 0

2 2 0 0 0 0
30 0 0 0 0 0
4 0 1 0 1 1
2 0 1 0 0 1
1 0 1 0 0 1
6 6 1 0 0 1
2 0 1 0 1 1
3 2 1 0 0 1
1 0 1 0 0 1
60 0 0 0 0 0
75 0 0 0 0 0
20 0 0 0 0 0

15 0 0 0 0 0
3 0 1 0 0 1
1 0 1 0 0 1
2 2 1 0 0 1
85 3 1 0 0 1
4 0 1 0 0 1
3 0 1 0 0 1
64 0 0 0 0 0
31 0 0 0 0 0

1 0 2 0 0 1

3 0 2 0 1 1
1 0 2 0 0 1
1 0 2 0 0 1
2 0 2 1 0 0
12 0 2 1 0 0
3 3 2 1 0 0
1 0 2 0 0 1
2 0 2 0 0 1
44 0 0 1 0 0

2 1 1 0 0 1
1 0 1 0 0 1
50 0 1 1 0 0
2 0 1 1 0 0
1 0 1 0 0 1
8 0 0 0 0 0

1 1 0 0 0 0
1 1 0 0 0 0
9 0 0 0 0 0
8 0 0 0 1 1
25 0 0 0 0 1
61 0 0 0 0 1

2 2 0 0 0 0
6 0 0 0 1 1
19 0 0 0 0 1
34 0 0 0 0 1
16 0 0 0 0 1
48 12 0 0 0 1

3 3 0 0 0 0
7 0 0 0 1 1
14 0 0 0 0 1
29 2 0 0 0 1
11 0 0 0 0 1
37 0 0 0 0 1
6 0 0 0 0 0
3 3 0 0 0 0

12 0 0 0 1 1
40 0 0 0 0 1
22 0 0 0 0 1
33 0 0 0 0 1

1 1 0 0 0 0
2 2 0 0 0 0
5 0 0 0 0 0
1 1 0 0 0 0
8 0 0 0 1 1
52 5 0 0 0 1
95 0 0 0 0 1
66 18 0 0 0 1
3 0 0 0 1 0
4 4 0 0 0 0
6 6 0 0 0 0
5 4 0 0 0 0
10 0 0 0 0 0
2 2 0 0 0 0

21 0 0 0 0 1
120 0 0 0 0 1
18 0 0 0 0 1
27 0 0 0 0 1
8 0 0 0 0 0

4 0 0 0 0 0
4 4 0 0 0 0
30 24 0 0 0 0
26 0 0 0 0 1
7 0 0 0 1 0
6 6 0 0 0 0
7 2 0 0 0 0
"""


def features(rows: np.ndarray) -> np.ndarray:
    """Features of the blocks of one page, from (words, linked words, inside, around, heading)."""
    if not len(rows):
        return np.zeros((0, len(FEATURES)))
    words, density = rows[:, 0].astype(float), rows[:, 1] / rows[:, 0]
    zero = np.zeros(1)
    return np.stack([words, density, np.append(zero, words[:-1]), np.append(zero, density[:-1]),
                     np.append(words[1:], zero), np.append(density[1:], zero), rows[:, 2], rows[:, 3], rows[:, 4],
                     np.full(len(rows), rows[:, 2][rows[:, 3] == 0].max(initial=0))], 1).astype(float)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    pages = [np.array([line.split() for line in page.splitlines()], int) for page in LABELLED.strip().split("\n\n")]
    return np.concatenate([features(p[:, :5]) for p in pages]), np.concatenate([p[:, 5] for p in pages])


def grow(x: np.ndarray, y: np.ndarray, least: int = 1) -> np.ndarray:
    """A tree as rows (feature, threshold, left, right, label); feature -1 is a leaf.  A node is parted where the Gini
    impurity falls most, first feature and lowest threshold at ties, until it is pure or cannot be parted."""
    nodes: list[list[float]] = []

    def gini(label):
        share = label.mean()
        return len(label) * share * (1 - share)

    def node(at: np.ndarray) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(2 * y[at].sum() >= len(at))])
        best = (gini(y[at]) - 1e-9, None, None)
        for f in range(x.shape[1] if best[0] > 0 else 0):
            values = np.unique(x[at, f])
            for threshold in (values[:-1] + values[1:]) / 2:
                low = x[at, f] <= threshold
                if min(low.sum(), (~low).sum()) >= least:
                    cost = gini(y[at][low]) + gini(y[at][~low])
                    if cost < best[0] - 1e-12:
                        best = (cost, f, threshold)
        if best[1] is not None:
            low = x[at, best[1]] <= best[2]
            nodes[me][:2] = best[1], best[2]
            nodes[me][2] = node(at[low])
            nodes[me][3] = node(at[~low])
        return me

    node(np.arange(len(y)))
    return np.array(nodes)


def judge(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The labels of the rows of x: all rows step down the tree together."""
    at = np.zeros(len(x), np.int64)
    while True:
        feature = tree[at, 0].astype(np.int64)
        inner = np.flatnonzero(feature >= 0)
        if not len(inner):
            return tree[at, 4] > 0
        here = at[inner]
        low = x[inner, feature[inner]] <= tree[here, 1]
        at[inner] = np.where(low, tree[here, 2], tree[here, 3]).astype(np.int64)


def main_texts(pages: list[str], tree: np.ndarray) -> list[str]:
    found = [blocks(page) for page in pages]
    table = [np.array([row[1:] for row in rows], np.int64).reshape(-1, 5) for rows in found]
    keep = judge(tree, np.concatenate([features(t) for t in table])) if table else []
    out, at = [], 0
    for rows in found:
        out.append("\n".join(row[0] for row, k in zip(rows, keep[at:at + len(rows)]) if k))
        at += len(rows)
    return out


def page_texts(pages: DataFrame, tree: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row.

    A null or empty page has an empty text.  Rows with a null or repeated page_id, and equal pages, are read like
    others; other columns are not read.  An empty table gives no rows.  A page is one row's work, in time linear in its
    length.  `tree` (see `grow`) is by default the one of the labelled table."""
    small_batches(pages.sparkSession)
    tree = grow(*labelled()) if tree is None else tree

    def run(batches):
        for batch in batches:
            for rows in pieces_of(batch, "html"):
                texts = main_texts([h or "" for h in rows.column("html").to_pylist()], tree)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
