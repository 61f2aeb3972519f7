import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.llm import near_dup as N


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    s, root = [sets(t) for _, t, _ in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
            root[find(a)] = find(b)
    groups = {}
    for x in range(len(rows)):
        groups.setdefault(find(x), []).append(rows[x][0])
    return {rows[x][0]: (len(s[x]), min(groups[find(x)])) for x in range(len(rows))}


def corpus(seed, groups, copies, words, edits):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
            rows.append(text + " " + passage if g % 3 == 0 else text)
    rng.shuffle(rows)
    return [(i, t, "s") for i, t in enumerate(rows)]


def test_components_match_brute_force(docs):
    rows = corpus(1, 30, 6, 120, 9) + [(900, "One two", "s"), (901, "one TWO", "s"), (902, "one  two three", "s"), (903, "", "s"), (904, None, "s")]
    want = brute(rows)
    got = {r.id: r for r in N.near_duplicates(docs(rows)).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.id == r.component_id) for r in got.values())


def test_large_group_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 20)
    monkeypatch.setattr(N, "SLICE", 50)
    monkeypatch.setattr(N, "GATHER", 30)
    rows = corpus(2, 2, 120, 80, 4)
    assert {r.id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs(rows)).collect()} == brute(rows)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    s = N.signatures([x, x[:2400], x[2400:]])
    same = (s[0] == s[1]).mean()
    assert 0.6 < same < 0.95 and (s[1] == s[2]).mean() < 0.1


@pytest.mark.parametrize(("gather", "parts"), [(16_384, 1), (7, 1), (7, 4)])
def test_index_finds_all_pairs_under_the_distance(spark, monkeypatch, gather, parts):
    """Pigeonhole: any two signatures at most CHUNKS * 2 - 1 apart share a key."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**16, (1, N.SYMBOLS)).astype(np.uint16)
    rows = [(0, a.tobytes())]
    for k in range(1, 60):
        b = a.copy()
        b[0, rng.choice(N.SYMBOLS, N.CHUNKS * 2 - 1, replace=False)] += 1
        rows.append((k, b.tobytes()))
    monkeypatch.setattr(N, "GATHER", gather)
    met = N.buckets(spark.createDataFrame([(k, bytearray(x)) for k, x in rows], "node long, signature binary").repartition(parts))
    mine = met.where("node = 0").select("key")
    assert met.join(mine, "key", "left_semi").select("node").distinct().count() == 60
    assert met.where("hub > node").count() == 0 and met.groupBy("key", "node").count().where("count > 1").count() == 0
    # Every key's nodes are led to its smallest one, at once or by way of a task's own smallest one.
    assert met.groupBy("key").agg(F.min("hub").alias("h"), F.min("node").alias("n")).where("h <> n").count() == 0
    different = np.stack([np.frombuffer(x, np.uint16) for _, x in rows[1:]]) != a
    assert (N.home(different) >= 0).all()


def test_components(spark):
    path = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(5, 5)]
    got = {r.node: r.root for r in N.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}
    assert N.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(ugly, empty):
    rows = N.near_duplicates(ugly).collect()
    assert len(rows) == 10
    assert [r.component_id for r in rows if r.id == 1] == [1, 1] and {r.component_id for r in rows if r.id is None} == {1, None}
    assert N.dedup(ugly).columns == ugly.columns
    assert N.near_duplicates(empty).count() == 0
