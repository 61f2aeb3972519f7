"""Best-fit packing of documents into token sequences by minimum bin slack.

Texts are tokenised, an end id follows, documents longer than a sequence are cut into whole sequences and a rest. Minimum bin
slack: for each bin the longest piece still open goes in, and a subset-sum dynamic program over the available lengths (a bitset,
one shift and or per length and power of two of its multiplicity) finds the fullest completion, which is then removed.

The program works on the histogram of piece lengths, which has at most ``capacity`` entries whatever the corpus: a found pattern
of lengths is applied as often as the histogram allows, so the plan has a few thousand lines. Pieces then look up their place:
the r-th piece of length l belongs to the plan line that uses ranks around r.

Defined cases: null text is empty and gives the end id alone; null and repeated ids are documents of their own; an empty table
gives an empty result; other columns are ignored; whole texts are tokenised.

Scale: ranks come from counters kept while a task tokenises, and prefix sums over (task, length) counts; the driver sees the
histogram and, up to FEW of them, the first ranks by task and length, which go to the workers beside the plan so that pieces stay
where they are; beyond, pieces and first ranks are joined by a shuffle.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from array import array
from codecs import charmap_decode
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, read, ship, small_batches, stage

CAPACITY = 4096
END_ID = 1
CACHE = 150_000  # distinct parts whose ids a worker remembers

FEW = 4_000_000  # first ranks (16 bytes each) that may be sent to every worker

#: What a tokeniser must do with a text before its model for Parts to hold: compose, make white space one space, lower case, and
#: drop the spaces between runs of letters, single digits and runs of other signs.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def splittable(path: str) -> bool:
    """Whether the tokeniser in a file treats the parts of a text between white space by themselves, as :class:`Parts` needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    special = all(t["content"].startswith("<|") for t in spec.get("added_tokens", []))
    return normal.get("normalizers") == NORMAL and (pre.get("pretokenizers") or [None])[0] == SPLIT and special


def fill(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The fullest multiset of ``lengths`` (descending, as often as ``counts`` has them) within ``room``: [(length, times)]."""
    reach, steps, top = 1, [], 1 << room
    mask = (top << 1) - 1
    for n in lengths:
        if n > room:
            continue
        k, left = 1, min(counts[n], room // n)
        while left > 0:
            k_now = min(k, left)
            steps.append((n, k_now, reach))
            reach |= (reach << (n * k_now)) & mask
            left -= k_now
            k *= 2
        if reach & top:
            break
    best, taken = reach.bit_length() - 1, Counter()
    for n, k, before in reversed(steps):
        if not before >> best & 1:
            best -= n * k
            taken[n] += k
    return sorted(taken.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Lines (pattern, bins): pattern [(length, times)] fills each of that many bins."""
    counts, lines = {n: c for n, c in histogram.items() if c}, []
    if any(n > capacity or n < 1 for n in counts):
        raise ValueError("a piece is longer than a sequence")
    lengths = sorted(counts, reverse=True)
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        pattern = Counter({first: 1})
        pattern.update(dict(fill([n for n in lengths if counts[n]], counts, capacity - first)))
        counts[first] += 1
        bins = min(counts[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            counts[n] -= k * bins
        lines.append((sorted(pattern.items(), reverse=True), bins))
        lengths = [n for n in lengths if counts[n]]
    return lines


def lookup(lines: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, times in a bin, first bin, offset in the bin), in rank order."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used, bin_no = Counter(), 0
    for pattern, bins in lines:
        at = 0
        for n, k in pattern:
            out.setdefault(n, []).append((used[n], k, bin_no, at))
            used[n] += k * bins
            at += k * n
        bin_no += bins
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def byte_letters() -> str:
    """The letters that byte-level models have for bytes 0 to 255: printable ones stand for themselves, the others for what follows 255, in order."""
    own, rest = {*range(33, 127), *range(161, 173), *range(174, 256)}, itertools.count(256)
    return "".join(chr(b if b in own else next(rest)) for b in range(256))


class Parts(dict):
    """Token ids, as little-endian 32-bit bytes, of the parts of texts between white space; filled on demand, at most CACHE of them.

    For tokenisers that drop white space and lower case and never join what it parts, nor letters with the marks after them.
    """

    MARKS = ".,;:!?|*#$%&"

    def __init__(self, tokenizer):
        self.t, self.model, self.letters = tokenizer, tokenizer.model, byte_letters()
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # the model's own memory of words: those that are missing here are hardly ever in it

    @staticmethod
    def plain(part: str) -> bool:
        """One word of lower-case letters up to ÿ, which are composed already: nothing to normalise or part."""
        return part.isalpha() and part.islower() and (part.isascii() or max(part) <= "\xff")

    def __missing__(self, part: str) -> bytes:
        if self.plain(part):
            shown = part if part.isascii() else charmap_decode(part.encode(), "strict", self.letters)[0]
            ids = array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()
        elif (core := part.rstrip(self.MARKS)) and core != part and self.plain(core):
            known = core in self
            ids = self[core] + self[part[len(core) :]]
            if not known:  # most words are met once: their own ids are enough to remember
                return ids
        else:
            ids = array("I", self.t.encode(part, add_special_tokens=False).ids).tobytes()
        if len(self) >= CACHE:
            self.clear()
        if len(part) < 64:
            self[part] = ids
        return ids


def encoder(path: str):
    """A function from a text to its token ids as little-endian 32-bit bytes."""
    import tokenizers

    t = tokenizers.Tokenizer.from_file(path)
    if not splittable(path):
        return lambda text: array("I", t.encode(text, add_special_tokens=False).ids).tobytes()
    # On a module that outlives this task, so that a reused worker remembers.
    parts = tokenizers.__dict__.setdefault("_parts", {}).setdefault(path, None) or Parts(t)
    tokenizers.__dict__["_parts"][path] = parts
    split = re.compile(r"[ \t\n\r]+").split

    def encode(text: str) -> bytes:
        if "<|" not in text:  # lowering must not make a special token
            try:
                text.encode("latin-1")  # composed already, and lower case maps each character to one: no change of ids
                text = text.lower()
            except UnicodeEncodeError:
                pass
        # str.split knows the tokeniser's white space, and four separators that it does not know as such.
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        return b"".join(map(parts.__getitem__, split(text) if odd else text.split()))

    return encode


def cut(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int, with_ids: bool) -> DataFrame:
    """Pieces: row_id, id, piece, start, length, ids_crc32, task, nth (among the task's pieces of that length)[, ids]."""
    base = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean("tokenizers")
        encode, seen, task = encoder(tokenizer_path), Counter(), TaskContext.get().partitionId()
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            out = []
            for row, key, ids in zip(b["row_id"].tolist(), b["id"].astype("Int64"), map(encode, [t or "" for t in b["text"].tolist()])):
                raw = ids + end
                for k, lo in enumerate(range(0, len(raw), 4 * capacity)):
                    ids = raw[lo : lo + 4 * capacity]
                    n = len(ids) // 4
                    out.append((row, key, k, lo // 4, n, zlib.crc32(ids), task, seen[n], *[ids] * with_ids))
                    seen[n] += 1
            if out:
                yield pd.DataFrame(out, columns=["row_id", "id", "piece", "start", "length", "ids_crc32", "task", "nth", *["ids"] * with_ids]).astype({"id": "Int64"})

    kept = "row_id long, id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    return base.mapInPandas(run, kept + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row per piece: row_id, id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids (32-bit, little-endian)."""
    spark = docs.sparkSession
    pieces = stage(cut(docs, tokenizer_path, id_col, text_col, capacity, with_ids), "pack-pieces")
    counts = stage(pieces.groupBy("task", "length").agg((F.max("nth") + 1).alias("n")), "pack-counts")
    histogram = {n: c for n, c in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    upto = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)
    firsts = counts.withColumn("first", F.sum("n").over(upto) - F.col("n")).drop("n")
    few = counts.count() <= FEW
    key = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if few:  # each piece looks up its task's first rank of its length where it stands
        known = firsts.toPandas()
        keys = known["task"].to_numpy(np.int64) << 32 | known["length"].to_numpy(np.int64)
        order = np.argsort(keys)
        key = keys[order], known["first"].to_numpy(np.int64)[order]
    table = spark.sparkContext.broadcast((lookup(plan(histogram, capacity)), *key))

    @F.pandas_udf("sequence_id long, offset long")
    def place(task: pd.Series, length: pd.Series, nth: pd.Series) -> pd.DataFrame:
        lines, keys, first = table.value
        n, r = length.to_numpy(np.int64), nth.to_numpy(np.int64)
        if few:
            r = r + first[np.searchsorted(keys, task.to_numpy(np.int64) << 32 | n)]
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for x in np.unique(n):
            own, rows = n == x, lines[int(x)]
            at = rows[np.searchsorted(rows[:, 0], r[own], side="right") - 1]
            d = r[own] - at[:, 0]
            seq[own], off[own] = at[:, 2] + d // at[:, 1], at[:, 3] + d % at[:, 1] * x
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    if not few:  # beyond that, pieces and first ranks are shuffled to each other
        pieces = pieces.join(firsts.hint("merge"), ["task", "length"]).withColumn("nth", F.col("nth") + F.col("first"))
    ranked = pieces.withColumn("at", place("task", "length", "nth"))
    return ranked.select("row_id", "id", "piece", "start", "length", "ids_crc32", F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"), *["ids"] * with_ids)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark, sf_dir: str) -> DataFrame:
    out = pack(read(spark, sf_dir, "documents"), tokenizer_file(), with_ids=False)
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


ship(__name__)
