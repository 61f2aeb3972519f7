"""MinHash near-dedup by a multi-index Hamming join, confirmed on full shingle sets.

A document's set is its distinct SHINGLE-word shingles, as 64-bit hashes. Documents with equal sets form one node. A node's
signature has CHUNKS chunks of CHUNK symbols, each the low BITS bits of a mixed minimum hash. Two signatures that differ in at
most CHUNKS * (ERRORS + 1) - 1 symbols agree in some chunk up to ERRORS = 1 symbol (pigeonhole), so every chunk is indexed once for
each symbol left out, and all pairs under that distance meet in a bucket. At a similarity of 0.75 a chunk meets with probability
0.53, so a pair misses all 12 with a probability of about 1e-4, and less above.

No bucket is expanded into all its pairs. First each bucket's nodes are compared with its smallest node; confirmed links are
contracted to components. Then only buckets that still hold several components are searched within tasks: blocks of the nodes
outside the bucket's main component meet slices of all its nodes; pairs of different components whose signatures are near enough
are compared on their sets where they stand, each in the first bucket that both share, and only links that join components leave
the task, to be confirmed as well. A pair that is skipped lies in one component already, so no link between components is lost.

Defined cases: null text or no words: an empty set, linked with nothing, its own component; fewer words than a shingle: the whole
sequence is the one shingle; a null id is no component's smallest unless all are null; repeated rows share a component; an empty
table gives an empty result; other columns are ignored; whole texts are read.

Scale: texts never travel: what is asked of them is picked in the scan by bitmaps of row numbers (``common.with_ids``), and only
the sets of candidate documents are shuffled. Index entries travel once, combined in each task before. Joins on nodes and hubs are
plain equi-joins that adaptive execution can split; components come from alternating large-star and small-star rounds with the
table written between rounds; tables that a later step replaces are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_ID, discard, field, lean, numbered, read, ship, small_batches, stage, unnumbered, with_ids

SHINGLE, PERCENT = 5, 75
CHUNKS, CHUNK = 12, 6
SYMBOLS = CHUNKS * CHUNK
FAR = SYMBOLS // 2  # pairs whose signatures differ in more symbols are not confirmed: five deviations from what 75 % gives
BLOCK, SLICE = 512, 4096
GATHER = 4096  # nodes whose index entries a task groups at once
FEW = 200_000  # rows of a table of two numbers that may be broadcast
PART_BYTES = 1 << 19
ERRORS = 1
CACHE = 200_000  # words whose hashes a worker remembers

_RANDOM = np.random.default_rng(9)
SALT = _RANDOM.integers(0, 2**64, SYMBOLS, dtype=np.uint64)
MULTIPLIER = _RANDOM.integers(0, 2**64, SYMBOLS, dtype=np.uint64) | np.uint64(1)
POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64)) for k in range(SHINGLE)]
MIX = np.uint64(0xD6E8FEB86659FD93)
KEY_MULTIPLIER = _RANDOM.integers(0, 2**64, SYMBOLS, dtype=np.uint64) | np.uint64(1)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, hashes: Hashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(w) < SHINGLE:
        h = w[:1] * np.uint64(2 * len(w) + 1)
        for k in range(1, len(w)):
            h = h * POWERS[1] + w[k : k + 1]
        return mixed(h + np.uint64(len(w)))
    n = len(w) - SHINGLE + 1
    return np.unique(mixed(reduce(np.add, (w[k : k + n] * POWERS[SHINGLE - 1 - k] for k in range(SHINGLE)))))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SYMBOLS 16-bit symbols for each (not empty) set."""
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    lo = 0
    while lo < len(sets):
        hi, size = lo, 0
        while hi < len(sets) and (hi == lo or size + len(sets[hi]) <= 65_536):
            size += len(sets[hi])
            hi += 1
        x = np.concatenate(sets[lo:hi])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[lo : hi - 1]])]).astype(np.int64)
        for i in range(SYMBOLS):
            out[lo:hi, i] = mixed(np.minimum.reduceat((x ^ SALT[i]) * MULTIPLIER[i], starts)) & np.uint64(0xFFFF)
        lo = hi
    return out


def sketch(texts: DataFrame) -> DataFrame:
    """row_id, id, n (set size), set_hash, signature; the last two are null for an empty set. ``texts``: row_id, id, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        lean()
        hashes = Hashes()
        for b in batches:
            sets = [shingles(t, hashes) for t in b["text"].tolist()]
            full = [s for s in sets if len(s)]
            rows = iter(signatures(full)) if full else iter(())
            yield pd.DataFrame(
                {
                    "row_id": b["row_id"],
                    "id": b["id"].astype("Int64"),
                    "n": [len(s) for s in sets],
                    "set_hash": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "signature": [next(rows).tobytes() if len(s) else None for s in sets],
                }
            )

    return texts.mapInPandas(run, "row_id long, id long, n long, set_hash binary, signature binary")


def base(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row_id, id, text of numbered rows."""
    return rows.select(F.col(ROW_ID).alias("row_id"), field(id_col).cast("long").alias("id"), field(text_col).alias("text"))


def index_keys(signature: np.ndarray) -> np.ndarray:
    """Every chunk of every signature with each of its symbols left out: a row of SYMBOLS keys for each."""
    s = signature.astype(np.uint64)
    part = (s + np.uint64(1)) * KEY_MULTIPLIER  # of each symbol at its place
    part = (part ^ (part >> np.uint64(31))) * MIX
    total = part.reshape(len(s), CHUNKS, CHUNK).sum(axis=2, dtype=np.uint64)
    keys = np.repeat(total, CHUNK, axis=1) - part + np.arange(1, SYMBOLS + 1, dtype=np.uint64) * POWERS[1]
    return ((mixed(keys) & ~np.uint64(127)) | np.arange(SYMBOLS, dtype=np.uint64)).view(np.int64)  # the low bits tell the slot


def buckets(nodes: DataFrame) -> DataFrame:
    """key, hub, node for every index entry that shares its key with another one; every node of a key is led to its smallest node.

    A task first groups its own entries, GATHER nodes at a time: of each key only the smallest node travels by the key, so a key
    that a third of all nodes have costs one row for each GATHER of them; the others know their local hub already and travel by
    a hash of their own. So a window holds at most one row for each GATHER nodes.
    """

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def grouped_here() -> Iterator[pd.DataFrame]:
            node = np.concatenate([b["node"].to_numpy() for b in held])
            s = np.frombuffer(b"".join(x for b in held for x in b["signature"]), np.uint16).reshape(len(node), SYMBOLS)
            order = np.argsort(node, kind="stable")
            node, keys = np.repeat(node[order], SYMBOLS), index_keys(s[order]).ravel()
            order = np.argsort(keys, kind="stable")  # by key, then node
            node, keys = node[order], keys[order]
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            n = np.diff(np.concatenate([start, [len(keys)]]))
            hub = np.repeat(node[start], n)
            led = np.ones(len(keys), bool)
            led[start] = False
            own = mixed((keys ^ (node * MIX.view(np.int64))).view(np.uint64)).view(np.int64)
            # told: 0 for the only node of a key here, 1 for the smallest of several, else the hub and 2. Runs of zeros compress.
            out = pd.DataFrame({"place": np.where(led, own, keys), "node": node, "key": np.where(led, keys, 0), "told": np.where(led, hub + 2, np.repeat(n > 1, n))})
            for at in range(0, len(out), 1 << 14):
                yield out[at : at + (1 << 14)]

        for b in batches:
            if len(b):
                held.append(b)
                size += len(b)
            if size >= GATHER:
                yield from grouped_here()
                held, size = [], 0
        if held:
            yield from grouped_here()

    rows = nodes.select("node", "signature").mapInPandas(gather, "place long, node long, key long, told long")
    travels, met = F.col("told") < 2, Window.partitionBy("place")
    rows = rows.withColumns({"least": F.min(F.when(travels, F.col("node"))).over(met), "n": F.count(F.when(travels, F.lit(1))).over(met)})
    key, hub = F.when(travels, F.col("place")).otherwise(F.col("key")), F.when(travels, F.col("least")).otherwise(F.col("told") - 2)
    return rows.where((F.col("told") > 0) | (F.col("n") > 1)).select(key.alias("key"), hub.alias("hub"), "node")


def near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those with like sizes and signatures at most FAR apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                x, y = (np.frombuffer(b"".join(p[c]), np.uint16).reshape(len(p), SYMBOLS) for c in ("sa", "sb"))
                yield p.loc[(x != y).sum(axis=1) <= FAR, ["a", "b"]]

    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("signature").alias(f"s{k}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a").where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT))
    return met.select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of nodes (row ids of ``texts``) those whose full sets are similar enough."""

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for b in batches:
            yield pd.DataFrame({"node": b["row_id"], "members": [shingles(t, hashes).tobytes() for t in b["text"].tolist()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            linked = []
            for x, y in zip(p["xa"].tolist(), p["xb"].tolist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield p.loc[np.array(linked, bool), ["a", "b"]]

    asked = pairs.select(F.explode(F.array("a", "b")).alias("row_id"))
    sets = stage(with_ids(texts, asked, "row_id").select("row_id", "text").mapInPandas(sets_of, "node long, members binary"), "near-sets")
    side = lambda k: sets.select(F.col("node").alias(k), F.col("members").alias(f"x{k}"))
    links = stage(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "xa", "xb").mapInPandas(run, "a long, b long"), "near-links")
    discard(sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for every linked node; alternating stars (Kiveris et al. 2014)."""
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    print_of = lambda e: tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
    before = None
    while (now := print_of(edges)) != before:
        before = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        old, edges = edges, stage(small.where("u <> v").distinct(), "stars")
        discard(old)
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select("root", "root").distinct())


def home(different: np.ndarray) -> np.ndarray:
    """For pairs (rows of SYMBOLS booleans: symbols that differ) the first index slot in which both stand, or -1."""
    d = different.reshape(len(different), CHUNKS, CHUNK)
    few = d.sum(axis=2)
    meets = few <= ERRORS
    chunk = meets.argmax(axis=1)
    rows = np.arange(len(d))
    return np.where(meets[rows, chunk], chunk * CHUNK + d[rows, chunk].argmax(axis=1), -1)


def bridges(slot: int, node: np.ndarray, comp: np.ndarray, other: np.ndarray, whole: np.ndarray, main: int, s: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between different components within a part of a bucket: enough of them to join what is linked.

    Rows marked ``other`` (none of component ``main``) are compared with the rows marked ``whole``. Every pair is looked at in one
    bucket, the first that both nodes share (its slot). Near pairs are compared on their sets, nearest first; once a link joins two
    components their other pairs need no look.
    """
    at, n, out = comp.copy(), np.array(list(map(len, sets))), []
    for r in np.flatnonzero(other):
        # Two of the others meet twice; the smaller node's turn counts.
        c = np.flatnonzero(whole & (at != at[r]) & ((comp == main) | (node > node[r])))
        c = c[np.minimum(n[c], n[r]) * 100 >= np.maximum(n[c], n[r]) * (PERCENT - 1)]
        if not len(c):
            continue
        different = s[c] != s[r]
        far = different.sum(axis=1)
        keep = (far <= FAR) & (home(different) == slot)
        for x in c[keep][np.argsort(far[keep], kind="stable")]:
            if at[x] == at[r]:
                continue
            both, total = len(np.intersect1d(sets[r], sets[x], assume_unique=True)), n[r] + n[x]
            # 32-bit hashes may collide: full sets decide, and only a link beyond that doubt joins components here.
            if 100 * (both + 2) >= PERCENT * (total - both - 2):
                out.append((int(min(node[r], node[x])), int(max(node[r], node[x]))))
                if 100 * (both - 2) >= PERCENT * (total - both + 2):
                    at[at == at[x]] = at[r]
    return out


def open_rows(entries: DataFrame) -> DataFrame:
    """main, key, i, j, node, comp, other, whole: what the parts (i, j) of buckets with several components hold; entries: key, node, comp.

    ``main`` is the component that most nodes of the bucket have. Only the others are compared with all: block i of the others meets
    slice j of all. So a bucket of m nodes, o of them in other components, makes about 2 * m * o / BLOCK rows, not m * m.
    """
    counts = entries.groupBy("key", "comp").agg(F.count("*").alias("c"))
    several = counts.groupBy("key").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("top"), F.sum("c").alias("size")).where("comps > 1")
    several = several.select("key", "main", F.ceil((F.col("size") - F.col("top")) / BLOCK).alias("blocks"), F.ceil(F.col("size") / SLICE).alias("slices"))
    rows = entries.join(several, "key").withColumn("own", F.when(F.col("comp") != F.col("main"), F.pmod(F.xxhash64("node", "key"), F.col("blocks")))).withColumn("slice", F.pmod(F.xxhash64("key", "node"), F.col("slices")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    cell = lambda i, j, other, whole: F.struct(i.alias("i"), j.alias("j"), other.alias("other"), whole.alias("whole"))
    across = F.transform(upto("blocks"), lambda i: cell(i, F.col("slice"), F.coalesce(i == F.col("own"), F.lit(False)), F.lit(True)))
    along = F.transform(F.filter(upto("slices"), lambda j: j != F.col("slice")), lambda j: cell(F.col("own"), j, F.lit(True), F.lit(False)))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("own").isNull(), across).otherwise(F.concat(across, along))))
    return rows.select("main", "key", "cell.i", "cell.j", "node", "comp", "cell.other", "cell.whole")


def cross_links(entries: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Likely links (a, b) between different components that share a bucket; entries: key, node, comp.

    A task gets parts of buckets that have their main component in common, and each of their nodes once, about PART_BYTES of sets:
    the buckets of one group of near copies hold much the same nodes.
    """
    rows = stage(open_rows(entries).join(nodes.select("node", "n"), "node"), "near-open")
    parts = stage(rows.groupBy("main").agg(F.ceil((F.sum("n") * 4 + F.count("*") * 200) / PART_BYTES).alias("parts")), "near-shares")
    # Staged and, beyond FEW, merged, so that the rows of one main component can be split.
    parts = F.broadcast(parts) if parts.count() <= FEW else parts.hint("merge")
    dealt = rows.join(parts, "main").select("main", F.pmod(F.xxhash64("key", "i", "j"), F.col("parts")).alias("part"), "key", "i", "j", "node", "comp", "other", "whole")
    dealt, opened = stage(dealt, "near-parts"), rows
    discard(opened)

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for b in batches:
            yield pd.DataFrame({"node": b["row_id"], "members": [np.unique((shingles(t, hashes) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in b["text"].tolist()]})

    asked = dealt.select(F.col("node").alias("row_id"))
    sets = with_ids(texts, asked, "row_id").select("row_id", "text").mapInPandas(sets_of, "node long, members binary")
    held = dealt.select(F.col("main").alias("in_main"), F.col("part").alias("in_part"), F.col("node").alias("held")).distinct()
    carried = held.join(sets, F.col("held") == F.col("node")).drop("node").join(nodes.select("node", "signature"), F.col("held") == F.col("node")).select("in_main", "in_part", "held", "signature", "members")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        place = pd.Series(np.arange(len(right)), index=right["held"].to_numpy())
        s = np.frombuffer(b"".join(right["signature"]), np.uint16).reshape(len(right), SYMBOLS)
        members = [np.frombuffer(x, np.uint32) for x in right["members"]]
        left = left.sort_values(["key", "i", "j", "node"], kind="stable", ignore_index=True)
        at = place[left["node"]].to_numpy()
        node, comp, other, whole, main = (left[c].to_numpy() for c in ("node", "comp", "other", "whole", "main"))
        found: list[tuple[int, int]] = []
        for (key, _, _), g in left.groupby(["key", "i", "j"], sort=False).indices.items():
            found += bridges(int(key) & 127, node[g], comp[g], other[g], whole[g], int(main[0]), s[at[g]], [members[x] for x in at[g]])
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    links = stage(dealt.groupBy("main", "part").cogroup(carried.groupBy("in_main", "in_part")).applyInPandas(run, "a long, b long").distinct(), "near-bridges")
    discard(dealt)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row_id, id, n_shingles, component_id (smallest id of the component), kept."""
    rows = numbered(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "near-rows")
    return grouped(base(rows, "id", "text")).drop("root").withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def grouped(texts: DataFrame) -> DataFrame:
    """row_id, id, n_shingles, root (a row number, one for each component), component_id of written ``texts``: row_id, id, text."""
    small_batches(texts.sparkSession)
    rows = stage(sketch(texts), "near-sketch")
    nodes = stage(rows.where("n > 0").groupBy("set_hash").agg(F.min("row_id").alias("node"), F.min("id").alias("least_id"), F.first("n").alias("n"), F.first("signature").alias("signature")), "near-nodes")
    entries = stage(buckets(nodes), "near-buckets")
    pairs = entries.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    tried = stage(near(pairs, nodes), "near-pairs")
    links = confirmed(tried, texts)
    comp = stage(components(links), "near-components")
    known = entries.select("key", "node").join(comp, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    more = stage(cross_links(known, nodes, texts).join(tried, ["a", "b"], "left_anti"), "near-pairs")
    more_links = confirmed(more, texts)
    discard(entries, tried, more, comp)
    comp = stage(components(links.union(more_links)), "near-components")
    discard(links, more_links)
    labelled = nodes.join(comp, "node", "left").select("set_hash", "least_id", F.coalesce("root", "node").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component"))
    named = labelled.join(least, "root").select("set_hash", "root", "component")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id")
    return rows.select("row_id", "id", "n", "set_hash").join(named, "set_hash", "left").select("row_id", "id", F.col("n").alias("n_shingles"), F.coalesce("root", "row_id").alias("root"), component)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", written: bool = False) -> DataFrame:
    """One document of each group, all columns unchanged: that of the smallest id (null last), of repeated ids the first row."""
    rows = numbered(docs, "near-rows", written)
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row_id")).alias("first")
    kept = grouped(base(rows, id_col, text_col)).groupBy("root").agg(first).select(F.col("first.row_id").alias(ROW_ID))
    return unnumbered(with_ids(rows, kept))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


ship(__name__)
