"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts (shares of kinds of bytes, word and line repetition, lengths) go into trees that are grown on 64-bin
histograms with second-order logistic gains, then flattened into arrays; scoring walks all trees for a batch at once in numpy.

Learning: labels of at most SAMPLE rows (those with the smallest hashes of their ids), never of held-out rows
(crc32 of the id as text, mod 5, is 0). Labels, language, source and id are no inputs of a score.

Defined cases: null text is empty and gets a score; a null id is not held out and never learned from; a row without a label is
scored alike; repeated labels of one id count as their maximum; without both labels to learn from every score is the share of
label 1 (0.5 without any); an empty table gives an empty result; other columns are ignored.

Scale: learning collects SAMPLE rows of statistics; scoring is one narrow pass with the flattened trees (kilobytes) in the task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, ship, small_batches

SAMPLE = 20_000  # labelled rows learned from, at most
BINS, TREES, DEPTH, RATE, LAMBDA, LEAST = 64, 120, 4, 0.1, 1.0, 5.0


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    n = max(1, len(raw))
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits, high = int(h[65:91].sum()), int(h[97:123].sum()), int(h[48:58].sum()), int(h[128:].sum())
    spaces = int(h[32] + h[9:14].sum())
    words = raw.split()
    k = max(1, len(words))
    counts = Counter(words)
    top = max(counts.values(), default=0)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    same = sum(a == b for a, b in zip(words, words[1:]))
    short = sum(len(x) <= 3 for x in words)
    plain = sum(x.isalnum() or x[:-1].isalnum() for x in words)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / k, upper / n, lower / n, digits / n, high / n, spaces / n,
        (len(raw) - upper - lower - digits - high - spaces) / n, h[ord("|")] / n, h[ord("!")] / n, (h[ord(".")] + h[ord(",")]) / n, h[ord("\n")] / n,
        len(counts) / k, top / k, pairs / max(1, len(words) - 1), same / k, short / k, plain / k, len(set(lines)) / m, np.log1p(n / m), (h[ord("#")] + h[ord("$")] + h[ord("%")] + h[ord("&")] + h[ord("*")]) / n,
    ]


N_STATISTICS = len(statistics(""))


class Trees:
    """Flattened trees: node arrays, the roots, and the score before any tree."""

    def __init__(self, feature, bound, left, right, value, roots, start):
        self.feature, self.bound, self.left, self.right, self.value = (np.asarray(x) for x in (feature, bound, left, right, value))
        self.roots, self.start = np.asarray(roots, np.int64), start

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        if len(self.roots) and len(x):
            rows = np.arange(len(x))[:, None]
            at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[at]] <= self.bound[at], self.left[at], self.right[at])  # a leaf leads to itself
            out = out + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boosted trees for labels y in {0, 1}."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Trees([0], [0.0], [0], [0], [0.0], [], float(np.log(p / (1 - p))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # bin b: at most edges[b]
    start = float(np.log(share / (1 - share)))
    f = np.full(len(y), start)
    feature, bound, left, right, value, roots = [], [], [], [], [], []

    def leaf() -> int:
        k = len(feature)
        feature.append(0), bound.append(np.inf), left.append(k), right.append(k), value.append(0.0)
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        root = leaf()
        roots.append(root)
        node = np.full(len(y), root)
        level = [root]
        for depth in range(DEPTH + 1):
            place = {k: i for i, k in enumerate(level)}
            local = np.full(len(feature), -1)
            local[level] = range(len(level))
            own = local[node]
            live = own >= 0
            gs, hs = (np.bincount(own[live], w[live], minlength=len(level)) for w in (g, h))
            if depth == DEPTH:
                for k in level:
                    value[k] = -RATE * gs[place[k]] / (hs[place[k]] + LAMBDA)
                break
            best = [(1e-6, -1, -1)] * len(level)
            for j in range(x.shape[1]):
                key = own[live] * BINS + binned[live, j]
                gl, hl = (np.bincount(key, w[live], minlength=len(level) * BINS).reshape(-1, BINS).cumsum(axis=1)[:, :-1] for w in (g, h))
                gr, hr = gs[:, None] - gl, hs[:, None] - hl
                gain = gl**2 / (hl + LAMBDA) + gr**2 / (hr + LAMBDA) - (gs**2 / (hs + LAMBDA))[:, None]
                gain[(hl < LEAST) | (hr < LEAST)] = 0
                gain[:, len(edges[j]) :] = 0
                for i, b in enumerate(gain.argmax(axis=1)):
                    if gain[i, b] > best[i][0]:
                        best[i] = (gain[i, b], j, int(b))
            later = []
            for k in level:
                _, j, b = best[place[k]]
                if j < 0:
                    value[k] = -RATE * gs[place[k]] / (hs[place[k]] + LAMBDA)
                    continue
                feature[k], bound[k], left[k], right[k] = j, float(edges[j][b]), leaf(), leaf()
                mine = node == k
                node[mine] = np.where(binned[mine, j] <= b, left[k], right[k])
                later += [left[k], right[k]]
            level = later
            if not level:
                break
        f = f + np.asarray(value)[node]
    return Trees(feature, bound, left, right, value, roots, start)


def held_out(id_col: str | Column) -> Column:
    """True where crc32 of the id as text, mod 5, is 0; false for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most: int | None) -> DataFrame:
    """text, y, id of rows that may be learned from: the ``most`` rows with the smallest id hashes (all if None)."""
    y = labels.select(F.col(id_col).alias("id"), F.col(label).alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id")).groupBy("id").agg(F.max("y").cast("int").alias("y"))
    if most is not None:
        y = F.broadcast(y.orderBy(F.xxhash64("id"), "id").limit(most))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(y, "id")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Trees:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "x": [np.asarray(statistics(t)) for t in b["text"]]})

    rows = labelled(docs, labels, label, id_col, text_col, sample).select("id", "y", "text").mapInPandas(run, "id long, y int, x array<double>")
    rows = rows.orderBy("id", "x").limit(sample).toPandas()  # an id may be that of many rows: the bound holds for rows
    return grow(np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, N_STATISTICS)), rows["y"].to_numpy(float))


def scored(docs: DataFrame, trees: Trees, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column of scores in [0, 1]."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(trees.score(np.stack([statistics(t) for t in texts])) if len(texts) else [], dtype=float)

    return docs.withColumn(name, score(F.col(text_col)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    trees = learn(docs, read(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", "text"), trees)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


ship(__name__)
