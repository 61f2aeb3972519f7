"""Periodic run detection in the words of a document.

A run is a stretch of words with smallest period q that no neighbouring word extends. Every run of exponent two or more holds a
Lyndon root: under one of the two orders of the alphabet (an order and its reverse) the longest Lyndon word that begins somewhere in
the run is one period long (Bannai et al., "The runs theorem", 2017). So, for each order:

* a stack of Lyndon factors is scanned from right to left: a place takes over the factors on the stack as long as its own suffix is
  smaller than theirs; what is left on top is the end of the longest Lyndon word that begins there;
* two suffixes are compared, and a root is extended to both sides, by the longest common extension (LCE): a few words directly, then
  a binary search on rolling hashes (two moduli), whose end is verified on the words themselves;
* every run is verified word by word at last; a text in which a hash ever told a lie is scanned again by direct comparison alone.

No suffix array is built. Only runs of at least ``least`` words and ``exponent`` periods are kept, and the others are passed over
before their extension is searched: such a run repeats its root at least once on the left or on the right, which is one hash.

Defined cases: null text has no words and no runs; null and repeated ids (of any type) are rows like others; an empty table gives an
empty result; other columns are ignored; whole texts are scanned, however long (a text's memory is some 200 bytes a word).

Scale: one narrow pass without a shuffle; work per text is n log n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, lean, read, ship, small_batches

LEAST, EXPONENT = 6, 4
#: Moduli (the largest primes below 2^31) and bases of the rolling hashes.
MODULI, BASES = (2147483647, 2147483629), (1103515245, 747796405)
MIX = 1640531527
#: Words compared directly before hashes are asked.
DIRECT = 8
#: Up to so many roots of a text are compared and extended one by one, more of them all at once.
FEW = 48
RUN = "struct<start:long,length:long,period:long>"


class Powers:
    """Powers of the bases, as long as the longest text so far."""

    def __init__(self):
        self.arrays = [np.ones(1, np.int64) for _ in MODULI]

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self.arrays[0]) <= n:
            self.arrays = [np.concatenate([a, a * pow(b, len(a), m) % m]) for a, b, m in zip(self.arrays, BASES, MODULI)]
        return self.arrays


class Lce:
    """Longest common extensions of places of a list of word numbers; ``hashes`` off compares words alone."""

    def __init__(self, ids: list[int], powers: Powers, hashes: bool = True):
        self.ids, self.n, self.hashes, self.lied = ids, len(ids), hashes, False
        self.powers, self.sums, self.lists = powers, None, None

    def prepare(self) -> None:
        if self.sums is None:
            number = np.asarray(self.ids, np.int64) + 1  # times a constant: a code of its own for each word, far from its neighbours'
            self.pows = self.powers.upto(self.n)
            self.sums = [np.concatenate([[0], np.cumsum(number * MIX % m * p[: self.n] % m)]) % m for p, m in zip(self.pows, MODULI)]

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words from i and from j, i < j, are equal over these lengths, by hash."""
        out = np.ones(len(i), bool)
        for h, p, m in zip(self.sums, self.pows, MODULI):
            out &= (h[i + length] - h[i]) % m * p[j - i] % m == (h[j + length] - h[j]) % m
        return out

    def direct(self, i: int, j: int, k: int = 0) -> int:
        """Equal words from i and j on, k of them known."""
        ids, most = self.ids, self.n - j
        while k < most and ids[i + k] == ids[j + k]:
            k += 1
        return k

    def equal_ahead(self, i: int, j: int):
        """By hash: whether the next k words from i and from j are equal, for a k."""
        if self.lists is None:
            self.prepare()
            self.lists = [h.tolist() for h in self.sums]
        (h1, h2), (m1, m2), (p1, p2) = self.lists, MODULI, self.pows
        q1, q2, a1, a2, b1, b2 = int(p1[j - i]), int(p2[j - i]), h1[i], h2[i], h1[j], h2[j]
        return lambda k: ((h1[i + k] - a1) * q1 - h1[j + k] + b1) % m1 == 0 and ((h2[i + k] - a2) * q2 - h2[j + k] + b2) % m2 == 0

    def searched(self, known: int, most: int, equal) -> int:
        """The greatest k up to ``most`` with equal(k), by doubling and halving; ``known`` is one."""
        lo, step = known, 2 * known
        while lo + step <= most and equal(lo + step):
            lo, step = lo + step, 2 * step
        hi = min(most, lo + step)  # the first length that may differ, or all
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if equal(mid):
                lo = mid
            else:
                hi = mid - 1
        return lo

    def ahead(self, i: int, j: int) -> int:
        """Equal words from i and from j on, i < j."""
        ids, most = self.ids, self.n - j
        near = DIRECT if DIRECT < most else most
        k = 0
        while k < near and ids[i + k] == ids[j + k]:
            k += 1
        if k < near or k == most:
            return k
        if not self.hashes:
            return self.direct(i, j, k)
        k = self.searched(k, most, self.equal_ahead(i, j))
        if ids[i + k - 1] != ids[j + k - 1] or k < most and ids[i + k] == ids[j + k]:
            self.lied = True
        return k

    def behind(self, i: int, j: int) -> int:
        """Equal words before i and before j, i < j."""
        ids, k = self.ids, 0
        near = i if not self.hashes or i < DIRECT else DIRECT
        while k < near and ids[i - k - 1] == ids[j - k - 1]:
            k += 1
        if k < near or k == i:
            return k
        k = self.searched(k, i, lambda k: self.equal_ahead(i - k, j - k)(k))
        if ids[i - k] != ids[j - k] or k < i and ids[i - k - 1] == ids[j - k - 1]:
            self.lied = True
        return k

    def extensions(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """Equal words from i and j on, or (``back``) before them, for many pairs, i < j, at once."""
        lo, hi = np.zeros(len(i), np.int64), i.copy() if back else self.n - j
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            equal = self.same(i - mid, j - mid, mid) if back else self.same(i, j, mid)
            lo, hi = np.where(equal, mid, lo), np.where(equal, hi, mid - 1)
        return lo


def lyndon_ends(order: list[int], lce: Lce) -> list[int]:
    """For each place the end of the longest Lyndon word that begins there; a suffix that is a prefix of another is smaller.

    The stack of factors is kept as links: on top stands the next place, below each place its end.
    """
    n, ahead = len(order), lce.ahead
    rank, ends = [*order, min(order, default=0) - 1], [n] * (n + 1)  # the end of the text is smaller than any word
    for i in range(n - 1, -1, -1):
        a, j = rank[i], i + 1
        b = rank[j]
        while a <= b:
            if a == b:
                c, d = rank[i + 1], rank[j + 1]
                if c == d:
                    k = ahead(i, j)
                    c, d = rank[i + k], rank[j + k]
                if c > d:
                    break
            j = ends[j]
            b = rank[j]
        ends[i] = j
    return ends[:n]


def candidates(w: np.ndarray, ends: np.ndarray, lce: Lce) -> np.ndarray:
    """Places whose Lyndon word stands a second time right after or right before itself, and so may be the root of a long run.

    First the outer words of the two copies are compared, then, for what is left, all of them: directly if they are few, else by hash.
    """
    n = len(w)
    i = np.flatnonzero(ends < n)  # of a run of three periods or more, one root at least ends before the text does
    j = ends[i]
    p = j - i
    right = (w[j] == w[i]) & (w[np.minimum(j + p, n) - 1] == w[j - 1]) & (j + p <= n)
    left = (w[np.maximum(i - 1, 0)] == w[j - 1]) & (w[np.maximum(i - p, 0)] == w[i]) & (i >= p)
    near = right | left
    i, j, p, right, left = i[near], j[near], p[near], right[near], left[near]
    if not lce.hashes:
        return i
    if len(i) <= FEW:
        ids = lce.ids
        return np.array([a for a, b, r, s in zip(i.tolist(), j.tolist(), right.tolist(), left.tolist()) if r and ids[a:b] == ids[b : b + b - a] or s and ids[a:b] == ids[a - (b - a) : a]], np.int64)
    lce.prepare()
    here = lambda x, ok: np.where(ok, x, 0)
    return i[lce.same(here(i, right), here(j, right), here(p, right)) & right | lce.same(here(i - p, left), here(i, left), here(p, left)) & left]


def find_runs(ids: list[int], powers: Powers, least: int = LEAST, exponent: int = EXPONENT, hashes: bool = True) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``ids`` with at least ``least`` words and ``exponent`` (3 or more) periods, by start and period."""
    n = len(ids)
    if n < max(least, exponent):
        return []
    w, lce, found = np.asarray(ids, np.int64), Lce(ids, powers, hashes), set()
    for order in (ids, [-x for x in ids]):
        ends = np.asarray(lyndon_ends(order, lce), np.int64)
        i = candidates(w, ends, lce)
        j = ends[i]
        if hashes and len(i) > FEW:
            after, before = lce.extensions(i, j, False), lce.extensions(i, j, True)
        else:
            pairs = list(zip(i.tolist(), j.tolist()))
            after, before = (np.array([f(a, b) for a, b in pairs], np.int64) for f in (lce.ahead, lce.behind))
        length, period = j - i + after + before, j - i
        long = length >= np.maximum(least, exponent * period)
        found.update(zip((i - before)[long].tolist(), length[long].tolist(), period[long].tolist()))
    if hashes and (lce.lied or not all(is_run(ids, *r) for r in found)):
        return find_runs(ids, powers, least, exponent, hashes=False)
    return sorted(found, key=lambda r: (r[0], r[2]))


def is_run(ids: list[int], start: int, length: int, period: int) -> bool:
    """Word by word: equal at a period's distance, and not longer on either side."""
    end = start + length
    return ids[start : end - period] == ids[start + period : end] and (start == 0 or ids[start - 1] != ids[start - 1 + period]) and (end == len(ids) or ids[end] != ids[end - period])


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared as integers; of equal ones the first."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run repeats: what follows the first period of any run goes."""
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            drop[start + period] += 1
            drop[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, runs (by start, then period), best (the run of greatest exponent, or null), collapsed (text)."""
    if exponent < 3:
        raise ValueError("exponent must be 3 or more")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    run_type = pa.struct([(f, pa.int64()) for f in ("start", "length", "period")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        powers = Powers()
        for b in batches:
            n_words, runs, best, texts = [], [], [], []
            for text in b.column("text").cast(pa.large_binary()).to_pylist():
                words, numbers = (text or b"").split(), {}  # bytes are split at the six ASCII spaces alone
                own = find_runs([numbers.setdefault(x, len(numbers)) for x in words], powers, least, exponent)
                n_words.append(len(words))
                runs.append(own)
                best.append(strongest(own))
                texts.append(collapsed(words, own))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(run_type)), pa.array(best, run_type), pa.array(texts, pa.binary()).cast(pa.string())],
                ["id", "n_words", "runs", "best", "collapsed"],
            )

    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, runs array<{RUN}>, best {RUN}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """The query's texts: in a tenth of the documents, by a hash of the id, the words from some place on repeat a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, F.col("text")).alias("own"))
    # Others have null here, which costs nothing.
    words = F.regexp_extract_all("own", F.lit(WORD), F.lit(0))

    def edited(w: Column) -> Column:
        n, g = F.size(w), F.col("g")
        a = (g % F.nullif(n, F.lit(0))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        repeated = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), repeated), " ")

    # One element, so that the words are found once and not again for each use of them.
    text = F.get(F.transform(F.filter(F.array(words), lambda w: F.size(w) > 0), edited), F.lit(0))
    return chosen.select("doc_id", F.coalesce(text, F.col("text")).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(read(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("best")
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ship(__name__)
