import re
from collections import defaultdict

from pyspark.sql import functions as F

from askloom.llm import mixing as M


def shares(sizes, weights=(5, 2, 1)):
    """Targets by the rule as it is written: share by weight, cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        if not open_:
            return fixed
        level = (total - sum(fixed.values())) / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > 2 * sizes[s]]
        if not over:
            return fixed | {s: level * w[s] for s in open_}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def rows_of():
    return [(i, " ".join(f"w{i}_{k}" for k in range((i * 37) % 400)), ["b", "a", None, "c", "d"][min(i % 9, 4)]) for i in range(300)]


def test_targets_and_amounts(docs):
    rows = rows_of()
    d = docs(rows)
    got = M.mix(d).collect()
    size, source = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}, {i: s for i, _, s in rows}
    by = defaultdict(int)
    for i in size:
        by[source[i]] += size[i]
    want, taken = shares(by), defaultdict(int)
    for r in got:
        assert r.size == size[r.id] and r.source_size == by[source[r.id]] and abs(r.target - want[source[r.id]]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 2 * M.BLOCK for s in by)
    again = {r.id: r.taken for r in M.mix(d).collect()}
    assert again == {r.id: r.taken for r in got}


def test_mixed_texts_hold_the_words_taken(docs):
    d = docs(rows_of())
    taken = {r.id: r.taken for r in M.mix(d).collect()}
    words = defaultdict(int)
    for r in M.mixed(d).collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text) and all(w.startswith(f"w{r.doc_id}_") for w in r.text.split())
    assert dict(words) == {i: n for i, n in taken.items() if n}


def split(docs, rows, parts):
    return [sorted((r.id, r.size, r.taken) for r in M.mix(docs(rows, parts=p)).collect()) for p in parts]


def test_the_mix_does_not_follow_splits(docs):
    """The same rows in 1 split and in 7, repeated rows among them."""
    one, many = split(docs, rows_of() + rows_of()[100:130] * 5, (1, 7))
    assert one == many


def test_taken_matches_a_plain_mix(docs):
    """Every row's taken words, from the sources' streams, quotas and draws as the module defines them, computed row by row."""
    rows = rows_of() + [(500 + i, "x y z " * i, "e") for i in range(40)]
    d = docs(rows)
    units, offsets = M.sized(d, F.col("doc_id"), F.col("text"), F.col("source"), F.monotonically_increasing_id())
    starts = {r.id: (r.skey, r.size, r.start) for r in M.positions(units, offsets).collect()}
    for skey in {k for k, _, _ in starts.values()}:  # each source is one gapless stream
        at = 0
        for _, size, start in sorted((x for x in starts.values() if x[0] == skey), key=lambda x: (x[2], x[1])):
            assert start == at
            at += size
    quota = {r.skey: (r.quota, r.n) for r in M.targets(offsets).collect()}
    drawn = [(r.skey, r.i) for r in M.slots(M.targets(offsets)).collect()]
    assert all(sorted(i for k, i in drawn if k == skey) == list(range(q)) for skey, (q, _) in quota.items())
    blocks = {(r.skey, r.block): r.times for r in M.blocks_taken(M.targets(offsets)).collect()}
    for skey, (q, n) in quota.items():  # every pass over a source's blocks is whole but the last
        times = [blocks.get((skey, b), 0) for b in range(n)]
        assert sum(times) == q and (not n or {x for x in times} <= {q // n, q // n + 1})
    want = {i: sum(blocks.get((skey, w // M.BLOCK), 0) for w in range(start, start + size)) for i, (skey, size, start) in starts.items()}
    assert {r.id: r.taken for r in M.mix(d).collect()} == want


def test_many_sources(docs, monkeypatch):
    """Beyond FEW sources their tables are merged, with the same result."""
    rows = [(i, "w " * (i % 90), f"host{i % 60}") for i in range(600)]
    few = split(docs, rows, (3,))
    monkeypatch.setattr(M, "FEW", 10)
    assert split(docs, rows, (3,)) == few


def test_clashing_columns(spark, docs, tmp_path):
    names = ["pass", "__row_id", "__row", "n", "size", "spans", "split", "now", "skey", "bin", "total"]
    d = docs(rows_of()).select("doc_id", "text", "source", *[F.lit(7).alias(x) for x in names])
    got = M.mixed(d)
    assert got.columns == d.columns and {r[x] for r in got.select(*[f"`{x}`" for x in names]).distinct().collect() for x in names} == {7}


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(M.shuffled(F.col("id"), F.lit(n), F.lit("k")).alias("x"))
        assert sorted(r.x for r in got.collect()) == list(range(n))


def test_edges(ugly, empty):
    rows = M.mix(ugly).collect()
    assert len(rows) == 10 and all(r.taken == 0 for r in rows if r.size == 0)
    assert M.mixed(ugly).columns == ugly.columns
    assert M.mix(empty).count() == 0 and M.mixed(empty).count() == 0
