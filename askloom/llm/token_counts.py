"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links (Song et al., "Fast WordPiece Tokenization", 2021). A link knows how many pieces the
greedy longest match has settled when it is followed, so a word's piece count falls out of one pass over its characters: no
piece is built and no character is read twice. Words are the runs without ASCII white space; the marker that the vocabulary sets
before a word's first piece is put before each word. A word that the vocabulary cannot spell counts as one unknown piece.

Defined cases: null text counts as empty (all counts 0); null and repeated ids, of any type, are rows like others; an empty table gives an
empty result; other columns are ignored; whole texts are read.

Scale: one narrow pass, no shuffle; each task remembers the counts of at most CACHE distinct words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, read, ship, small_batches

MARK = "▁"
CACHE = 400_000


class Automaton:
    """goto: a dict of children per node; fail: node or -1; popped: pieces settled by following fail."""

    def __init__(self, vocabulary: Iterable[str]):
        self.goto: list[dict[str, int]] = [{}]
        is_piece = [False]
        for piece in vocabulary:
            u = 0
            for c in piece:
                if (v := self.goto[u].get(c)) is None:
                    v = self.goto[u][c] = len(self.goto)
                    self.goto.append({})
                    is_piece.append(False)
                u = v
            is_piece[u] = u > 0
        self.fail, self.popped = [-1] * len(self.goto), [0] * len(self.goto)
        row = [0]
        while row:
            later = []
            for u in row:
                for c, v in self.goto[u].items():
                    later.append(v)
                    if is_piece[v]:
                        self.fail[v], self.popped[v] = 0, 1
                        continue
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.goto[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.goto[z][c], n
            row = later

    def count(self, word: str) -> int:
        """Greedy longest-match pieces of a word, or -1 if they do not spell it."""
        goto, fail, popped, u, n = self.goto, self.fail, self.popped, 0, 0
        for c in word:
            while (v := goto[u].get(c)) is None:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return -1
            u = v
        while u > 0:
            n += popped[u]
            u = fail[u]
        return n if u == 0 else -1


def sentencepiece_vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


class Counts(dict):
    def __init__(self, automaton: Automaton, mark: str):
        self.automaton, self.mark = automaton, mark

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self.automaton.count(self.mark + word.decode())
        if len(word) < 64:
            self[word] = n
        return n


def counter(model_path: str, mark: str) -> Counts:
    """The counts by a model's vocabulary, on a module that outlives this task, so that a reused worker builds its automaton once."""
    import sentencepiece

    kept = sentencepiece.__dict__.setdefault("_counts", {})
    if (model_path, mark) not in kept:
        kept[model_path, mark] = Counts(Automaton(sentencepiece_vocabulary(model_path)), mark)
    return kept[model_path, mark]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", mark: str = MARK) -> DataFrame:
    """One row per input row: id, n_words, n_tokens (an unknown word is one), n_unknown (words)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean("sentencepiece")
        counts = counter(model_path, mark)
        for b in batches:
            words, tokens, unknown = [], [], []
            for text in b.column("text").cast(pa.large_binary()).to_pylist():
                ns = list(map(counts.__getitem__, (text or b"").split()))
                none = ns.count(-1)
                words.append(len(ns))
                tokens.append(sum(ns) + 2 * none)
                unknown.append(none)
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(x, pa.int64()) for x in (words, tokens, unknown)]], ["id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")


def query(spark, sf_dir: str) -> DataFrame:
    from .packing import tokenizer_file

    return count_tokens(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


ship(__name__)
