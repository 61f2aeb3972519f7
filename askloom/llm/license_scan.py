"""License scans: fuzzy search for short notices.

A text is reduced to its words (A-Z lowered) joined by single spaces. A notice of length n may be found with up to n // EDIT_SHARE
edits; by the pigeonhole principle one of (edits + 1) pieces of it then stands unchanged, so an Aho-Corasick automaton over all
pieces locates every candidate place, and the regex library's bounded-error matching verifies the place and finds its edits and
its bounds. Base phrases are found exactly, word for word, by the same automaton.

Defined cases: null text is empty: no words, no labels, score 0; null and repeated ids, of any type, are rows like others; an empty table gives
an empty result; other columns are ignored; whole texts are searched, however long.

Scale: one narrow pass without a shuffle. Candidate windows of one notice that touch are searched as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, ship, small_batches

EDIT_SHARE = 9  # characters of a notice for each edit allowed
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "all rights reserved": "reserved",
    "creative commons attribution": "cc-by",
    "gnu general public license": "gpl",
    "licensed under cc by": "cc-by",
    "licensed under the apache license": "apache",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "released under the mit license": "mit",
}
#: ASCII that is no word character becomes a space; bytes of other characters stay.
TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(TABLE).split()


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, edit_share: int = EDIT_SHARE):
        import ahocorasick
        import regex

        self.base, self.notices = base, notices
        self.edits = {x: len(x) // edit_share for x in notices}
        self.fuzzy = {x: regex.compile(f"(?e)(?:{regex.escape(x, literal_spaces=True)}){{e<={k}}}") for x, k in self.edits.items()}
        uses: dict[str, list[tuple[str | None, str, int]]] = {}
        for phrase in base:
            uses.setdefault(f" {phrase} ", []).append((None, phrase, 0))
        for notice, k in self.edits.items():
            for i in range(k + 1):
                lo, hi = len(notice) * i // (k + 1), len(notice) * (i + 1) // (k + 1)
                uses.setdefault(notice[lo:hi], []).append((notice, notice[lo:hi], lo))
        self.automaton = ahocorasick.Automaton()
        for piece, of in uses.items():
            self.automaton.add_word(piece, (len(piece), of))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int]], list[tuple[str, str, int, int, int, str]]]:
        """Words; base places (label, word); fuzzy matches (label, notice, first word, word after the last, edits, matched text)."""
        words = words_of(text)
        joined = f" {b' '.join(words).decode()} "
        base, windows = [], {}
        for end, (n, of) in self.automaton.iter(joined):
            start = end - n + 1
            for notice, phrase, at in of:
                if notice is None:
                    base.append((start, self.base[phrase]))
                    continue
                k = self.edits[notice]
                lo, hi = max(0, start - at - k), start - at + len(notice) + k
                own = windows.setdefault(notice, [])
                if own and lo <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], lo), max(own[-1][1], hi)
                else:
                    own.append([lo, hi])
        found = []
        for notice, own in windows.items():
            merged: list[list[int]] = []
            for lo, hi in sorted(own):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            for lo, hi in merged:
                for m in self.fuzzy[notice].finditer(joined, lo, min(hi, len(joined))):
                    found.append((m.start(), m.end(), self.notices[notice], notice, sum(m.fuzzy_counts), m.group()))
        marks = sorted({x for x, _ in base} | {x for f in found for x in f[:2]})
        word_at, seen, last = {}, 0, 0
        for x in marks:  # spaces before a place; the first one stands before word 0
            seen += joined.count(" ", last, x)
            word_at[x], last = seen, x
        places = sorted((word_at[x], label) for x, label in base)
        matches = [(label, notice, max(0, word_at[a] - (joined[a] != " ")), max(0, word_at[b] - (joined[b - 1] == " ")), e, s) for a, b, label, notice, e, s in sorted(found)]
        return len(words), [(label, w) for w, label in places], matches


MATCH = "struct<label:string,notice:string,first_word:long,end_word:long,edits:int,matched:string>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, base (array of label and word), matches (array of spans with edits)."""
    small_batches(docs.sparkSession)

    place = pa.struct([("label", pa.string()), ("word", pa.int64())])
    match = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32()), ("matched", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            out = [scanner.scan(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([n for n, _, _ in out], pa.int64()), pa.array([x for _, x, _ in out], pa.list_(place)), pa.array([x for _, _, x in out], pa.list_(match))],
                ["id", "n_words", "base", "matches"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, base array<struct<label:string,word:long>>, matches array<{MATCH}>")


def query(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents"))
    likeness = F.array_max(F.transform("matches", lambda m: 1 - m["edits"] / F.char_length(m["notice"])))
    names = lambda *arrays: F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        names(F.col("base.label")).alias("base_labels"),
        names(F.col("base.label"), F.col("matches.label")).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(likeness, F.lit(0.0))).alias("score"),
        "matches",
    )


ship(__name__)
