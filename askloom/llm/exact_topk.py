"""Exact top-k search by a vector-approximation file.

The range of every dimension is cut into at most CELLS cells, fitted on FIT vectors; the file has one byte a dimension for every vector
and is written once, where the vectors stand. The search scans the file only: a vector's cells bound its inner product with a
query from both sides, so a vector whose upper bound is below the k-th best lower bound cannot be among the k best. Exact vectors
are then read in the order of their bounds: first the k + 1 best bounded ones, whose exact scores make a cut that no vector bounded
below it can reach, then those that are left above it; with them the k-th result is certain.

Scores are inner products of integers, floor(SCALE * component). Equal vectors are searched once: of their ids only the k + 1
smallest can be among any k best, and a query whose vector others share gets the same search.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do rows with a null id; vectors of
fewer dimensions count as 0 in the rest; repeated rows (same id, same vector) count once; ties go to the smaller id; a query with
fewer candidates returns them all; an empty table gives an empty result; other columns are ignored. Scores must fit 64 bits.

Scale: a task holds one block of the file (BLOCK vectors) and lets blocks of queries pass by it, so what is shuffled is the file, a
byte a dimension, and the queries once for each block. An exact search of queries that grow with the table scans the file for each of
them: its work grows with the square. Exact vectors move only for what the bounds leave (in the test data, where a component has
fewer values than there are cells, the k best and their ties).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, read, ship, small_batches, stage, with_ids

SCALE, K, CELLS, FIT = 64, 20, 256, 20_000
BLOCK, WIDTH, QUERIES, STEP = 32_768, 128, 2048, 64  # vectors in a block of up to WIDTH dimensions, queries in a block, queries whose bounds are held at once


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (integers) of the rows that take part, each once."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull())
    rows = rows.where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # By Cauchy and Schwarz no product, sum or score leaves 64 bits if every vector's square does not leave 62.
    square = F.aggregate("x", F.lit(0.0), lambda a, x: a + F.floor(x * SCALE).cast("double") * F.floor(x * SCALE).cast("double"))
    fits = F.when(square < 2.0**62, F.transform("x", lambda x: F.floor(x * SCALE))).otherwise(F.raise_error(F.concat(F.lit("scores of this vector do not fit 64 bits: id "), F.col("id").cast("string"))))
    return rows.select("id", fits.alias("v")).distinct()


def matrix(vectors: list, width: int = 1) -> np.ndarray:
    """Integer vectors as rows, filled up with 0."""
    out = np.zeros((len(vectors), max([width, *map(len, vectors)])), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, max(0, width - m.shape[1]))))


def fitted(sample: np.ndarray, cells: int = CELLS) -> list[np.ndarray]:
    """For each dimension the least value of every cell but the first, which has no least one: quantiles of a sample."""
    at = np.linspace(0, 1, cells + 1)[1:-1]
    return [np.unique(np.quantile(sample[:, j], at, method="higher"))[-(cells - 1) :].astype(np.int64) for j in range(sample.shape[1])]


class Approximation:
    """A block of the file: one byte a dimension; the block's own least and greatest values close the outer cells."""

    def __init__(self, cells: np.ndarray, least: np.ndarray, most: np.ndarray, starts: list[np.ndarray]):
        self.cells = cells
        j = np.arange(cells.shape[1])
        lo, hi = (np.zeros((CELLS, len(j))) for _ in range(2))
        for d in j:
            x = starts[d] if d < len(starts) else np.zeros(0, np.int64)
            lo[: len(x) + 1, d] = np.clip(np.concatenate([least[d : d + 1], x]), least[d], most[d])
            hi[: len(x) + 1, d] = np.clip(np.concatenate([x - 1, most[d : d + 1]]), least[d], most[d])
        # The middle of every component's cell and how far its ends are.
        self.middle, self.reach = ((lo + hi) / 2)[cells, j], ((hi - lo) / 2)[cells, j]

    @staticmethod
    def of(m: np.ndarray, starts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, least and greatest values of a block of integer vectors."""
        cells = np.zeros(m.shape, np.uint8)
        for d in range(m.shape[1]):
            cells[:, d] = np.searchsorted(starts[d], m[:, d], side="right") if d < len(starts) else 0
        return cells, m.min(axis=0), m.max(axis=0)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds [query, vector] of the inner products."""
        s, r = q.astype(float) @ self.middle.T, np.abs(q).astype(float) @ self.reach.T
        r = r + 1e-9 * np.abs(s).max(initial=0) + 1e-6
        return s - r, s + r

    def candidates(self, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each query the places, lower and upper bounds of all vectors that can be among its k best of the block."""
        k = min(k, len(self.cells))
        for at in range(0, len(q), STEP):
            lower, upper = self.bounds(q[at : at + STEP])
            need = np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k]
            for i in range(len(lower)):
                c = np.flatnonzero(upper[i] >= need[i])
                yield at + i, c, lower[i, c], upper[i, c]


def rows_of(width: int) -> int:
    """Vectors of a block: BLOCK of them, or fewer wide ones, as each component takes 17 bytes where the block is held."""
    return max(256, min(BLOCK, BLOCK * WIDTH // max(1, width)))


def approximated(units: DataFrame, starts: list[np.ndarray]) -> DataFrame:
    """The file: width, cells, uids, least, most for each block of vectors, made where they stand."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vs, uids = [], []

        def block() -> pd.DataFrame:
            m = matrix(vs)
            cells, least, most = Approximation.of(m, starts)
            return pd.DataFrame({"width": [m.shape[1]], "body": [cells.tobytes()], "names": [np.array(uids, np.int64).tobytes()], "ends": [np.stack([least, most]).tobytes()]})

        for b in batches:
            vs += b["v"].tolist()
            uids += b["uid"].tolist()
            most = rows_of(max([1, *map(len, vs)]))
            while len(vs) >= most:
                rest = vs[most:], uids[most:]
                vs, uids = vs[:most], uids[:most]
                yield block()
                vs, uids = rest
        if vs:
            yield block()

    return units.select("uid", "v").mapInPandas(run, "width int, body binary, names binary, ends binary")


def packed(asked: DataFrame) -> DataFrame:
    """Blocks of queries: width, body (64-bit integers), names (their keys)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), QUERIES):
                part = b[lo : lo + QUERIES]
                m = matrix(part["v"].tolist())
                yield pd.DataFrame({"width": [m.shape[1]], "body": [m.tobytes()], "names": [part["key"].to_numpy(np.int64).tobytes()]})

    return asked.select("key", "v").mapInPandas(run, "width int, body binary, names binary")


def bounded(units: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """key, uid, upper: of every query all vectors whose bounds let them be among its k best; staged."""
    spark = units.sparkSession
    sample = units.orderBy(F.xxhash64("v")).limit(FIT).select("v").toPandas()["v"].tolist()  # FIT vectors
    starts = fitted(matrix(sample))
    file = stage(approximated(units, starts).withColumn("block", F.monotonically_increasing_id()), "va-file")
    numbers = file.select("block", (F.row_number().over(Window.orderBy("block")) - 1).cast("long").alias("slice"))  # a number for each block
    queries = stage(packed(asked), "va-questions")
    n_blocks, n_queries = file.count(), queries.count()
    # Where blocks are few, several tasks share one, each with a part of the queries.
    groups = max(1, min(n_queries, ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / n_blocks)))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = file.join(F.broadcast(numbers), "block").select("slice", upto(groups).alias("part"), F.lit(0).alias("kind"), "width", "body", "names", "ends")
    right = queries.withColumn("part", F.pmod(F.xxhash64("names"), F.lit(groups))).select(upto(n_blocks).alias("slice"), "part", F.lit(1).alias("kind"), "width", "body", "names", F.lit(None).cast("binary").alias("ends"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = uids = None
        for b in batches:
            for r in b.itertuples():
                names = np.frombuffer(r.names, np.int64)
                if r.kind == 0:  # the block that the next queries pass by
                    least, most = np.frombuffer(r.ends, np.int64).reshape(2, r.width)
                    block, uids = Approximation(np.frombuffer(r.body, np.uint8).reshape(-1, r.width), least, most, starts), names
                    continue
                q, width = np.frombuffer(r.body, np.int64).reshape(-1, r.width), block.cells.shape[1]
                q = widened(q, width)[:, :width]  # what a block's vectors do not have is 0
                out, size = [], 0
                for i, c, lower, upper in block.candidates(q, k):
                    out.append((np.full(len(c), names[i]), uids[c], lower, upper))
                    size += len(c)
                    if size > 100_000 or i == len(q) - 1:
                        yield pd.DataFrame({name: np.concatenate([x[n] for x in out]) for n, name in enumerate(("key", "uid", "lower", "upper"))})
                        out, size = [], 0

    met = left.unionByName(right).repartition("slice", "part").sortWithinPartitions("slice", "part", "kind")
    found = stage(met.mapInPandas(run, "key long, uid long, lower double, upper double"), "va-bounds")
    order = Window.partitionBy("key").orderBy(F.desc("lower"), "uid")
    kth = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).groupBy("key").agg(F.count("*").alias("n"), F.min("lower").alias("least"))
    out = stage(found.join(kth, "key").where((F.col("n") < k) | (F.col("upper") >= F.col("least"))).select("key", "uid", "upper"), "va-left")
    discard(file, queries, found)
    return out


def exact(pairs: DataFrame, units: DataFrame, asked: DataFrame) -> DataFrame:
    """key, uid, score of the pairs, whose exact vectors are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                a, q = matrix(b["v"].tolist()), matrix(b["q"].tolist())
                width = max(a.shape[1], q.shape[1])
                yield pd.DataFrame({"key": b["key"], "uid": b["uid"], "score": np.einsum("ij,ij->i", widened(a, width), widened(q, width))})

    wanted = with_ids(units.select("uid", "v"), pairs.select("uid"), "uid")
    met = pairs.select("key", "uid").join(wanted, "uid").join(asked.select("key", F.col("v").alias("q")), "key")
    return stage(met.select("key", "uid", "v", "q").mapInPandas(run, "key long, uid long, score long"), "va-scores")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id, score: for each query row its k best other rows. ``is_query`` is a condition on column ``id``."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = stage(usable(vectors, id_col, vec_col), "va-rows")
    few = F.row_number().over(Window.partitionBy("v").orderBy("id")) <= k + 1  # limited in each task before the shuffle
    units = rows.withColumn("few", few).where("few").groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    units = stage(units.withColumn("uid", F.monotonically_increasing_id()), "va-vectors")
    asked = stage(rows.where(is_query).groupBy("v").agg(F.min("id").alias("key")), "va-queries")
    if units.isEmpty() or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    left = bounded(units, asked, k + 1)
    # In the order of their bounds: the k + 1 best, then what their exact scores leave.
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("upper"), "uid"))
    placed = stage(left.withColumn("place", place), "va-order")
    first = exact(placed.where(F.col("place") <= k + 1), units, asked)
    cut = first.groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("cut"))
    rest = placed.where(F.col("place") > k + 1).join(cut, "key").where((F.col("n") <= k) | (F.col("upper") >= F.col("cut")))
    scores = first.unionByName(exact(stage(rest.select("key", "uid"), "va-rest"), units, asked))
    # Best vectors first: k + 1 of them hold k + 1 ids; all that tie with the last are kept, as ids decide.
    rank = F.rank().over(Window.partitionBy("key").orderBy(F.desc("score")))
    held = scores.withColumn("rank", rank).where(F.col("rank") <= k + 1).join(units.select("uid", F.explode("ids").alias("id")), "uid")
    found = held.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k + 1)
    best = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("best"))
    mine = rows.where(is_query).select("v", F.col("id").alias("query_id")).join(asked, "v").select("query_id", "key")
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    return mine.join(best, "key").select("query_id", F.posexplode(others).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.id", "x.score")


def query(spark, sf_dir: str) -> DataFrame:
    out = top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return out.withColumnRenamed("id", "vec_id")


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ship(__name__)
