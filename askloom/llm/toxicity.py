"""Toxicity by class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has a model of word pairs that backs off to its words, and these to counts that both classes share:

    P_c(w | v) = max(N_c(v w) - D2, 0) / N_c(v .) + l_c(v) * P_c(w)
    P_c(w)     = max(N_c(w) - D1, 0) / N_c + l_c * P(w)
    P(w)       = N(w) / N

All counts are Kneser-Ney's continuation counts: N(w) is the number of distinct words that stand before w in the whole corpus, labelled
or not, N_c(w) the same within the class's documents, N_c(v w) the number of distinct words before the pair. So what is repeated in
one place, in a text or in near copies of it, is hardly evidence, and what a class uses in many places is. D1 and D2 are constant
discounts; l_c(v) and l_c are the mass that they free, so each level sums to 1. Words of at most D1 contexts in each class have no
more than the shared order, so they are one word, 0, of the model; pairs of at most D2 contexts have no more than their words. A
document is compared by its length-normalised log-likelihood ratio, each place less the ratio that a word unknown to both classes
has there (it tells how much was learned, not what the text says): over the whole text, and over its most toxic run of WINDOW words.
A logistic curve over both, fitted on cross-fitted scores of the labelled rows, turns them into a score.

Learning: labels of at most SAMPLE rows of each class (those with the smallest hashes of their ids), equal texts once, never of
held-out rows (crc32 of the id as text, mod 5, is 0). Labels, language, source and id are no inputs of a score.

Defined cases: null text is empty and gets the score of a text without evidence; a null id is not held out and never learned
from; repeated labels of one id count as their maximum; without both labels to learn from every score is the share of label 1
(0 without any); an empty table gives an empty result; other columns are ignored; whole texts are read.

Scale: documents are read three times: for the sample (which is staged), for the shared counts, for the scores. Words travel as
40-bit hashes (contexts as 20-bit ones, in the corpus as 31-bit ones) in sorted codes, combined in each task and dealt evenly over buckets, four a partition of the
documents; a task merges one bucket at a time. The model keeps what more than D1 or D2 contexts of the labelled documents show, so it is
bounded by the sample; the shared counts cover the corpus, and what is gathered for them grows with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, read, ship, small_batches, stage
from .quality import held_out

SAMPLE = (40_000, 10_000)  # labelled rows learned from, at most: ordinary, toxic
D1, D2, WINDOW = 5, 8, 3
HELD = 1_500_000  # codes that a task holds before it passes them on, or half as many before it merges them
BITS = 20  # of a word's number, and of a context's hash
CACHE = 200_000  # words whose codes a task remembers
#: ASCII that is no letter or digit parts words; bytes of other characters stay.
TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(TABLE).split()


def sample_of(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most: tuple[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """text, y, fold of distinct labelled texts to learn from, staged, and how many rows have each label."""
    y = labels.select(F.col(id_col).alias("id"), F.col(label).alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id")).groupBy("id").agg(F.max("y").cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    first = [y.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(most[k]) for k in (0, 1)]  # bounded by ``most``
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(first[0].union(first[1])), "id").withColumns({"h": F.xxhash64("text"), "row_id": F.monotonically_increasing_id()})
    rows = stage(rows, "toxicity-labelled")
    once = rows.groupBy("h", "y").agg(F.min("row_id").alias("row_id")).select("row_id")
    out = stage(rows.join(once, "row_id", "left_semi").select("text", "y", F.pmod("h", F.lit(2)).cast("int").alias("fold")), "toxicity-sample")
    discard(rows)
    return out, sizes


def packed(codes: np.ndarray) -> bytes:
    """Sorted codes as their low halves and the steps of their high halves, in as few bytes as the largest step needs."""
    step = np.diff(codes >> 32, prepend=0)
    kind = next(t for t in (np.uint8, np.uint16, np.uint32) if step.max(initial=0) <= np.iinfo(t).max)
    return step.astype(kind).tobytes() + (codes & 0xFFFFFFFF).astype(np.uint32).tobytes() + bytes([np.dtype(kind).itemsize])


def unpacked(raw: bytes) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[raw[-1]]
    n = (len(raw) - 1) // (4 + raw[-1])
    high, low = np.frombuffer(raw, kind, n).astype(np.int64), np.frombuffer(raw[n * raw[-1] : -1], np.uint32).astype(np.int64)
    return np.cumsum(high) << 32 | low


def dealt(codes: np.ndarray, buckets: int, low: int = 0) -> Iterator[pd.DataFrame]:
    """Sorted codes dealt over buckets by a hash of all but their ``low`` bits: a row a bucket, some of them at a time."""
    bucket = (((codes >> low).view(np.uint64) * MIX) >> np.uint64(40)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = [k for k in range(buckets) if at[k] < at[k + 1]]
    for lo in range(0, len(full), 32):
        yield pd.DataFrame([(k, packed(codes[order[at[k] : at[k + 1]]])) for k in full[lo : lo + 32]], columns=["bucket", "codes"])


DEALT = "bucket int, codes binary"


def bucket_wise(dealt_rows: DataFrame, of_bucket, schema: str) -> DataFrame:
    """``of_bucket(codes)``, a data frame, of the distinct codes of each bucket, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, codes, size, limit = None, [], 0, HELD // 2
        for b in batches:
            for bucket, raw in zip(b["bucket"].tolist(), b["codes"].tolist()):
                if bucket != now and codes:
                    yield of_bucket(np.unique(np.concatenate(codes)))
                    codes, size, limit = [], 0, HELD // 2
                now = bucket
                codes.append(unpacked(raw))
                size += len(codes[-1])
                if size > limit:
                    codes = [np.unique(np.concatenate(codes))]
                    size = len(codes[0])
                    limit = max(HELD // 2, 2 * size)
        if codes:
            yield of_bucket(np.unique(np.concatenate(codes)))

    return dealt_rows.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, schema)


def gathered(texts: DataFrame, codes_of, buckets: int, low: int = 0) -> DataFrame:
    """The distinct codes of texts, dealt over buckets; ``codes_of()`` makes a function from a batch to arrays of codes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        held, size, make = [], 0, codes_of()
        for b in batches:
            for x in make(b):
                held.append(x)
                size += len(x)
                if size > HELD:
                    held = [np.unique(np.concatenate(held))]
                    size = len(held[0])
                    if size > HELD // 2:
                        yield from dealt(held[0], buckets, low)
                        held, size = [], 0
        if held:
            yield from dealt(np.unique(np.concatenate(held)), buckets, low)

    return texts.mapInPandas(run, DEALT)


def n_buckets(df: DataFrame) -> int:
    return min(65_536, max(256, 4 * df.rdd.getNumPartitions()))


def key_of(word: bytes) -> int:
    """A 40-bit hash of a word."""
    import xxhash

    return xxhash.xxh3_64_intdigest(word) >> 24


class Codes(dict):
    """word -> its number << 40 | its key, filled on demand, at most CACHE of them."""

    def __init__(self, vocabulary: dict[int, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        key = key_of(word)
        code = self.vocabulary.get(key, 0) << 40 | key
        if len(self) >= CACHE:
            self.clear()
        if len(word) < 64:
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


LOW = (1 << BITS) - 1
COUNTS = ["n00", "n01", "n10", "n11", "u0", "u1"]  # contexts in fold 0 and 1, class 0 and 1; in either fold, class 0 and 1


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expressions of sorted codes (expression, context, fold, class), and their COUNTS."""
    unit, place = np.unique(codes >> BITS + 2, return_inverse=True)
    n = np.bincount(place * 4 + (codes & 3), minlength=4 * len(unit)).reshape(-1, 4)
    either = np.unique(codes >> 2 << 1 | codes & 1)
    u = np.bincount(np.searchsorted(unit, either >> BITS + 1) * 2 + (either & 1), minlength=2 * len(unit)).reshape(-1, 2)
    return unit, np.concatenate([n, u], axis=1)


def word_counts(sample: DataFrame, least: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Keys of words of more than ``least`` contexts in a class; their counts [word, fold or 2 for either, class]; all words' total counts."""

    def codes_of():
        codes = Codes({})

        def make(b: pd.DataFrame) -> Iterator[np.ndarray]:
            for text, y, f in zip(b["text"].tolist(), b["y"].tolist(), b["fold"].tolist()):
                k = codes.of(words_of(text))
                before = np.concatenate([[0], k[:-1] & LOW])[: len(k)]
                yield (k << BITS | before) << 2 | (2 * f + y)

        return make

    def of_bucket(codes: np.ndarray) -> pd.DataFrame:
        word, n = counted(codes)
        keep = (n[:, 4:] > least).any(axis=1)
        n = np.concatenate([n[keep], n.sum(axis=0, keepdims=True)])  # the last row, of no word, is the sum over all
        return pd.DataFrame({"word": np.append(word[keep], -1)} | {c: n[:, i] for i, c in enumerate(COUNTS)})

    rows = gathered(sample.select("text", "y", "fold"), codes_of, n_buckets(sample), BITS + 2)
    found = stage(bucket_wise(rows, of_bucket, "word long, " + ", ".join(f"{c} long" for c in COUNTS)), "toxicity-words")
    total = found.where("word = -1").agg(*[F.sum(c) for c in COUNTS]).first()
    kept = found.where("word >= 0").toPandas()  # bounded by the sample
    discard(found)
    # Numbers have BITS bits; were there more words, those of the most contexts would get one.
    most = kept[COUNTS].sum(axis=1).to_numpy()
    kept = kept.iloc[np.lexsort((kept["word"], -most))[: (1 << BITS) - 1]].sort_values("word")
    return kept["word"].tolist(), kept[COUNTS].to_numpy(float).reshape(-1, 3, 2), np.array([x or 0 for x in total], float).reshape(3, 2)


def pair_counts(sample: DataFrame, vocabulary: dict[int, int], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes v << BITS | w of pairs of more than ``least`` contexts in a class; their counts [pair, fold or 2, class]; N(v .) [word, fold or 2, class]."""

    def codes_of():
        codes = Codes(vocabulary)

        def make(b: pd.DataFrame) -> Iterator[np.ndarray]:
            for text, y, f in zip(b["text"].tolist(), b["y"].tolist(), b["fold"].tolist()):
                x = codes.of(words_of(text))
                w = x >> 40
                before = np.concatenate([[0], x[:-2] & LOW])[: max(0, len(x) - 1)]
                code = ((w[:-1] << BITS | w[1:]) << BITS | before) << 2 | (2 * f + y)
                yield code[w[:-1] > 0]

        return make

    def of_bucket(codes: np.ndarray) -> pd.DataFrame:
        pair, n = counted(codes)
        before, at = np.unique(pair >> BITS, return_inverse=True)
        after = np.stack([np.bincount(at, n[:, k], len(before)) for k in range(len(COUNTS))], axis=1).astype(np.int64)
        keep = (n[:, 4:] > least).any(axis=1) & (pair & LOW > 0)
        shown = np.concatenate([n[keep], after])
        # The second word of a sum over all of a word's pairs is 0.
        return pd.DataFrame({"code": np.concatenate([pair[keep], before << BITS])} | {c: shown[:, i] for i, c in enumerate(COUNTS)})

    rows = gathered(sample.select("text", "y", "fold"), codes_of, n_buckets(sample), BITS + 2)
    rows = bucket_wise(rows, of_bucket, "code long, " + ", ".join(f"{c} long" for c in COUNTS))
    found = stage(rows.groupBy("code").agg(*[F.sum(c).alias(c) for c in COUNTS]), "toxicity-pairs")  # staged: its shuffle's files go at once
    rows = found.toPandas().sort_values("code")  # bounded by the sample
    discard(found)
    code, n = rows["code"].to_numpy(np.int64), rows[COUNTS].to_numpy(float).reshape(-1, 3, 2)
    sums = code & LOW == 0
    after = np.zeros((len(vocabulary) + 1, 3, 2))
    after[code[sums] >> BITS] = n[sums]
    return code[~sums], n[~sums], after


def contexts(docs: DataFrame, vocabulary: dict[int, int], text_col: str) -> np.ndarray:
    """For each word number (0: any other word) the distinct previous words in the whole corpus (by 31-bit hashes)."""

    def codes_of():
        codes = Codes(vocabulary)

        def make(b: pd.DataFrame) -> Iterator[np.ndarray]:
            for text in b["text"].tolist():
                x = codes.of(words_of(text))
                yield x >> 40 << 31 | np.concatenate([[0], x[:-1] & 0x7FFFFFFF])[: len(x)]

        return make

    def of_bucket(codes: np.ndarray) -> pd.DataFrame:
        word, n = np.unique(codes >> 31, return_counts=True)
        return pd.DataFrame({"word": word, "n": n})

    rows = bucket_wise(gathered(docs.select(F.col(text_col).alias("text")), codes_of, n_buckets(docs)), of_bucket, "word long, n long")
    found = stage(rows.groupBy("word").agg(F.sum("n").alias("n")), "toxicity-contexts")
    out = np.zeros(len(vocabulary) + 1)
    for word, n in found.collect():  # a row per model word
        out[word] = n
    discard(found)
    return out


class ClassModel:
    """One class's probabilities, by word numbers: 0 is any word the model does not know, and as a previous word also a text's start."""

    def __init__(self, n: np.ndarray, total: float, codes: np.ndarray, pairs: np.ndarray, after: np.ndarray, shared: np.ndarray):
        """Counts of the words 1, 2, ..., of all words, of the pairs ``codes``, of the pairs that begin with each word; P(w) of 0, 1, ..."""
        kept = np.concatenate([[0.0], np.maximum(n - D1, 0)])
        self.free = 1 - kept.sum() / total
        self.word = kept / total + self.free * shared
        self.codes, before = codes, codes >> BITS
        kept = np.maximum(pairs - D2, 0)
        self.after_free = 1 - np.bincount(before, kept, len(after)) / np.maximum(after, 1)
        self.pair = kept / np.maximum(after[before], 1) + self.after_free[before] * self.word[codes & ((1 << BITS) - 1)]

    def p(self, w: int, v: int = 0) -> float:
        at = np.searchsorted(self.codes, code := v << BITS | w)
        return float(self.pair[at] if at < len(self.codes) and self.codes[at] == code else self.after_free[v] * self.word[w])


class Ratios:
    """Log-likelihood ratios by word and by pair, each less that of a word which neither class knows in its place."""

    def __init__(self, toxic: ClassModel | None = None, plain: ClassModel | None = None):
        self.word, self.codes, self.pair = np.zeros(1), np.zeros(0, np.int64), np.zeros(0)
        if toxic is not None:
            unknown = np.log(toxic.free / plain.free)
            self.word = np.log(toxic.word / plain.word) - unknown
            self.codes, v = toxic.codes, toxic.codes >> BITS
            self.pair = np.log(toxic.pair / plain.pair) - unknown - np.log(toxic.after_free[v] / plain.after_free[v])

    def of(self, w: np.ndarray) -> np.ndarray:
        """The ratio at each place of a text of word numbers."""
        x = self.word[w]
        if len(self.codes) and len(w) > 1:
            code = w[:-1] << BITS | w[1:]
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            x[1:] = np.where(self.codes[at] == code, self.pair[at], x[1:])
        return x


def learned(n: np.ndarray, total: np.ndarray, codes: np.ndarray, pairs: np.ndarray, after: np.ndarray, contexts_of: np.ndarray) -> Ratios:
    """The ratios of both classes; counts are [..., class], class 1 is the toxic one."""
    if not (total > 0).all():  # a class of which nothing was learned: no evidence for any word
        none = Ratios()
        none.word = np.zeros(len(n) + 1)
        return none
    shared = np.maximum(contexts_of, 1e-3) / np.maximum(contexts_of, 1e-3).sum()  # a word of the model that the corpus lacks is no impossible one
    plain, toxic = (ClassModel(n[:, c], total[c], codes, pairs[:, c], after[:, c], shared) for c in (0, 1))
    return Ratios(toxic, plain)


def features(words: list[bytes], codes: Codes, ratios: Ratios) -> tuple[float, float]:
    """Length-normalised log-likelihood ratios: of the whole text, and of its most toxic WINDOW words."""
    if not words:
        return 0.0, 0.0
    x = ratios.of(codes.of(words) >> 40)
    c = np.concatenate([[0.0], np.cumsum(x)])
    k = min(WINDOW, len(x))
    return float(x.mean()), float((c[k:] - c[:-k]).max() / WINDOW)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights (last: intercept) of a lightly regularised logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    keep = np.diag([*[0.1] * (x.shape[1] - 1), 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + keep, x.T @ (w * (p - y)) + keep @ b)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


class Model:
    def __init__(self, vocabulary: dict[int, int], ratios: Ratios, weights: np.ndarray):
        self.vocabulary, self.ratios, self.weights = vocabulary, ratios, weights

    def score(self, text: str | None, codes: Codes) -> float:
        whole, peak = features(words_of(text), codes, self.ratios)
        return float(1 / (1 + np.exp(-np.clip(self.weights @ [whole, peak, 1.0], -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: tuple[int, int] = SAMPLE) -> Model:
    small_batches(docs.sparkSession)
    rows, sizes = sample_of(docs, labels, label, id_col, text_col, sample)
    if len(sizes) < 2:
        p = float(np.clip(1.0 if 1 in sizes else 0.0, 1e-12, 1 - 1e-12))
        return Model({}, Ratios(), np.array([0.0, 0.0, np.log(p / (1 - p))]))
    words, n, total = word_counts(rows, D1)
    vocabulary = {w: i + 1 for i, w in enumerate(words)}
    codes, pairs, after = pair_counts(rows, vocabulary, D2)
    shared = contexts(docs, vocabulary, text_col)
    # Fold f is scored by what the other one taught.
    folds = [learned(n[:, 1 - f], total[1 - f], codes, pairs[:, 1 - f], after[:, 1 - f], shared) for f in (0, 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes(vocabulary)
        for b in batches:
            x = [features(words_of(t), codes, folds[f]) for t, f in zip(b["text"].tolist(), b["fold"].tolist())]
            yield pd.DataFrame({"y": b["y"], "whole": [a for a, _ in x], "peak": [p for _, p in x]})

    got = rows.select("text", "y", "fold").mapInPandas(run, "y int, whole double, peak double").toPandas().sort_values(["y", "whole", "peak"])
    discard(rows)
    y = got["y"].to_numpy(float)
    share = sizes[1] / (sizes[0] + sizes[1])
    if not len(y) or not 0 < y.mean() < 1:  # labels without documents of both classes
        return Model({}, Ratios(), np.array([0.0, 0.0, np.log(share / (1 - share))]))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(vocabulary, learned(n[:, 2], total[2], codes, pairs[:, 2], after[:, 2], shared), logistic(got[["whole", "peak"]].to_numpy(), y, weight))


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column of scores in [0, 1]."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codes = Codes(model.vocabulary)
        for texts in batches:
            yield pd.Series([model.score(t, codes) for t in texts], dtype=float)

    return docs.withColumn(name, score(F.col(text_col)))


def ordinary(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the limit, all columns unchanged."""
    model = learn(docs, labels, id_col=id_col, text_col=text_col)
    whole = docs.select(F.struct("*").alias("row"))  # one column: no name of its fields can clash
    kept = scored(whole.select("row", F.col(f"row.`{text_col}`").alias("text")), model).where(F.col("score") < limit)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs, read(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


ship(__name__)
