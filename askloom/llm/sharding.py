"""Resharding by minimum-cost flow: equal bytes in every new shard, with the fewest bytes moved.

The old layout is a shard number per row (by default a hash of the text over ``OLD`` shards). Old shard sizes and new capacities
(the total split evenly) make a transport problem; bytes that stay under their shard number cost nothing, others one each.
The solution is a list of block transfers (old shard, byte range, new shard). Law: ``bytes``.

Groups of equal texts of one old shard stand together and follow the range in which the group starts, so a shard's size is off by
less than a group at each of its block ends. Groups of more than 1 / LARGE of a shard are placed whole before the flow, the
largest first (under their old number while it has room, else where most room is), so they cannot upset sizes; there are at most
LARGE * ``new`` of them. Only a group that is larger than a shard is split, row by row.

Defined cases: a null text has no bytes, and every row counts one more byte; null and repeated ids are rows like others; an
empty table gives an empty result; other columns are ignored. Places follow hashes of text and id alone, so neither splits nor
cores change them (rows alike in both are interchangeable).

Scale: places are prefix sums in three levels: rows within a lot (group and one of SUBS hash classes of ids, so a text that a third
of all rows have is SUBS lots), lots within one of BUCKETS hashed parts of an old shard, and parts. The driver sees one row per
old shard and part, the large groups and the flow network, all bounded whatever the input.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import running
from .common import ROW, ROW_ID, discard, field, numbered, read, stage, text_of

OLD, NEW, BUCKETS, SUBS = 6, 8, 256, 64
LARGE = 64  # a group of more than this part of a shard is placed by itself


def min_cost_flow(supply: list[int], capacity: list[int], cost: Callable[[int, int], int]) -> dict[tuple[int, int], int]:
    """Amounts (i, j) -> units of a transport plan of least cost; successive shortest paths with potentials.

    sum(capacity) must be at least sum(supply); cost(i, j) must not be negative.
    """
    a, b = len(supply), len(capacity)
    flow = np.zeros((a, b), dtype=object)
    left, room = list(supply), list(capacity)
    c = [[cost(i, j) for j in range(b)] for i in range(a)]
    pot = [0] * (a + b)
    while any(left):
        dist: list[float] = [0 if left[i] else float("inf") for i in range(a)] + [float("inf")] * b
        back = [-1] * (a + b)
        heap = [(0, i) for i in range(a) if left[i]]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            edges = [(a + j, c[u][j]) for j in range(b)] if u < a else [(i, -c[i][u - a]) for i in range(a) if flow[i][u - a]]
            for v, w in edges:
                if (new := d + w + pot[u] - pot[v]) < dist[v]:
                    dist[v], back[v] = new, u
                    heapq.heappush(heap, (new, v))
        end = min((j for j in range(b) if room[j] and dist[a + j] < float("inf")), key=lambda j: dist[a + j] + pot[a + j])
        for v in range(a + b):
            if dist[v] < float("inf"):
                pot[v] += dist[v]
        path, v = [], a + end
        while back[v] >= 0:
            path.append((back[v], v))
            v = back[v]
        most = min([left[v], room[end], *(flow[w][u - a] for u, w in path if u >= a)])
        for u, w in path:
            if u < a:
                flow[u][w - a] += most
            else:
                flow[w][u - a] -= most
        left[v] -= most
        room[end] -= most
    return {(i, j): int(flow[i][j]) for i in range(a) for j in range(b) if flow[i][j]}


def homes(groups: dict[tuple[int, int], dict[int, int]], room: list[int]) -> dict[tuple[int, int], int]:
    """A new shard for each large group (bytes by old shard), the largest first; ``room`` is lessened."""
    out = {}
    for g, own in sorted(groups.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        size = sum(own.values())
        first = max(own, key=lambda i: (own[i], -i))
        out[g] = first if first < len(room) and room[first] >= size else max(range(len(room)), key=lambda j: (room[j], -j))
        room[out[g]] -= size
    # What is overdrawn comes from the others' room.
    while (short := -min(room)) > 0:
        j, most = room.index(-short), room.index(max(room))
        part = min(short, room[most])
        room[j] += part
        room[most] -= part
    return out


def reshard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", old_shard: Column | None = None, old: int = OLD, new: int = NEW) -> DataFrame:
    """One row per input row: row_id, id, size, text_crc32, old_shard, shard, slot.

    ``old_shard`` is a column with the row's shard in the old layout, from 0 to ``old`` - 1.
    """
    where = F.pmod(F.xxhash64(text_of(text_col)), F.lit(old)) if old_shard is None else old_shard
    return placed(docs, F.monotonically_increasing_id(), F.col(id_col), F.col(text_col), where, old, new)


def placed(docs: DataFrame, row_id: Column, id_col: Column, text_col: Column, where: Column, old: int, new: int) -> DataFrame:
    spark, text = docs.sparkSession, text_of(text_col)
    base = docs.select(row_id.alias("row_id"), id_col.alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), where.cast("int").alias("old_shard"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.xxhash64(id_col, id_col.isNull()).alias("k"))
    rows = stage(base.withColumns({"bucket": F.pmod("t1", F.lit(BUCKETS)).cast("int"), "sub": F.pmod("k", F.lit(SUBS)).cast("int")}), "reshard-rows")
    lots = stage(rows.groupBy("old_shard", "bucket", "t1", "t2", "sub").agg(F.count("*").alias("n"), F.first("size").alias("size")), "reshard-lots")
    n_bytes = F.sum(F.col("n") * F.col("size"))
    total = lots.agg(n_bytes).first()[0] or 0
    capacity = [total * (j + 1) // new - total * j // new for j in range(new)]
    own = lots.groupBy("t1", "t2", "old_shard").agg(n_bytes.alias("bytes"))
    large = lots.groupBy("t1", "t2").agg(n_bytes.alias("whole")).where((F.col("whole") * LARGE * new > total) & (F.col("whole") * new <= total))  # fewer than LARGE * new
    groups: dict[tuple[int, int], dict[int, int]] = {}
    for t1, t2, i, size in own.join(F.broadcast(large), ["t1", "t2"]).select("t1", "t2", "old_shard", "bytes").collect():
        groups.setdefault((t1, t2), {})[i] = size
    target = homes(groups, capacity)
    # A large group is a lane of its own, beside those of the old shards.
    lanes = spark.createDataFrame([(*g, old + k) for k, g in enumerate(sorted(groups))], "t1 long, t2 long, own_lane int")
    laned = lambda t: t.join(F.broadcast(lanes), ["t1", "t2"], "left").withColumn("lane", F.coalesce("own_lane", "old_shard")).drop("own_lane")
    lots = laned(lots)
    parts = sorted(tuple(r) for r in lots.groupBy("lane", "bucket").agg(n_bytes, F.sum("n")).collect())  # at most old * BUCKETS and one a large group
    sizes, ranks, offsets = {}, {}, []
    for lane, bucket, size, n in parts:
        offsets.append((lane, bucket, sizes.get(lane, 0), ranks.get(lane, 0)))
        sizes[lane] = sizes.get(lane, 0) + size
        ranks[lane] = ranks.get(lane, 0) + n
    moves, at = [(old + k, 0, sizes[old + k], target[g]) for k, g in enumerate(sorted(groups))], [0] * old
    for (i, j), n in sorted(min_cost_flow([sizes.get(i, 0) for i in range(old)], capacity, lambda i, j: int(i != j)).items()):
        moves.append((i, at[i], at[i] + n, j))
        at[i] += n
    before = Window.partitionBy("lane", "bucket").orderBy("t1", "t2", "sub", "old_shard").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0)).cast("long")
    off = spark.createDataFrame(offsets, "lane int, bucket int, start0 long, rank0 long")
    lots = lots.withColumns({"start": so_far(F.col("n") * F.col("size")), "rank": so_far("n")}).join(F.broadcast(off), ["lane", "bucket"])
    lots = lots.select("lane", "bucket", "t1", "t2", "sub", "old_shard", "n", "size", (F.col("start") + F.col("start0")).alias("start"), (F.col("rank") + F.col("rank0")).alias("rank"))
    # Equal texts of a lane follow their first row, unless they are more than a shard.
    group = Window.partitionBy("lane", "bucket", "t1", "t2")
    together = F.sum(F.col("n") * F.col("size")).over(group) * new <= total
    lots = stage(lots.withColumn("lead", F.when(together, F.min("start").over(group))).drop("n", "size"), "reshard-lots")
    key = ["lane", "bucket", "t1", "t2", "sub", "old_shard"]
    # Numbers within a lot by ranges: a lot whose ids are all alike, or null, may be a third of all rows.
    each = running(laned(rows), key, ["k", "row_id"], {"nth": ("sum", F.lit(1).cast("long"))}).withColumn("nth", F.col("nth") - 1).join(lots.hint("merge"), key)
    each = each.select("row_id", "id", "size", "text_crc32", "old_shard", "lane", F.coalesce("lead", F.col("start") + F.col("nth") * F.col("size")).alias("start"), (F.col("rank") + F.col("nth")).alias("rank"))
    mv = spark.createDataFrame(moves, "from_lane int, lo long, hi long, shard int")
    there = (F.col("lane") == F.col("from_lane")) & (F.col("start") >= F.col("lo")) & (F.col("start") < F.col("hi"))
    each = stage(each.join(F.broadcast(mv), there).drop("from_lane", "hi", "start"), "reshard-moves")
    discard(rows)
    blocks = sorted(tuple(r) for r in each.groupBy("shard", "lane", "lo").agg(F.count("*"), F.min("rank")).collect())  # one per transfer
    bases, filled = [], [0] * new
    for shard, lane, lo, n, rank in blocks:
        bases.append((shard, lane, lo, filled[shard] - rank))
        filled[shard] += n
    base = spark.createDataFrame(bases, "shard int, lane int, lo long, base long")
    return each.join(F.broadcast(base), ["shard", "lane", "lo"]).select("row_id", "id", "size", "text_crc32", "old_shard", "shard", (F.col("rank") + F.col("base")).alias("slot"))


def rewrite(spark: SparkSession, path: str, target: str, id_col: str = "doc_id", text_col: str = "text", old: int = OLD, new: int = NEW) -> DataFrame:
    """Reshard a table laid out as shard=<n> folders: the shards that the transfers touch are written under ``target`` in slot order.

    Returns the touched shard numbers. Shards without a row that came or went keep their old files and are not written.
    """
    rows = numbered(spark.read.parquet(path), "reshard-table")
    to = stage(placed(rows, F.col(ROW_ID), field(id_col), field(text_col), field("shard"), old, new).select(F.col("row_id").alias(ROW_ID), F.col("old_shard").alias("from"), F.col("shard").alias("to"), "slot"), "reshard-places")
    changed = stage(to.where("from <> to").select(F.explode(F.array("from", "to")).alias("shard")).distinct(), "reshard-touched")
    moved = rows.join(to.join(F.broadcast(changed.withColumnRenamed("shard", "touched")), F.col("to") == F.col("touched"), "left_semi"), ROW_ID)
    names = [c for c in rows.schema[ROW].dataType.names if c != "shard"]
    ordered = moved.repartitionByRange("to", "slot").sortWithinPartitions("to", "slot")
    ordered.select(*[field(c).alias(c) for c in names], F.col("to").alias("shard")).write.mode("overwrite").partitionBy("shard").parquet(target)
    return changed


def query(spark, sf_dir: str) -> DataFrame:
    out = reshard(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
