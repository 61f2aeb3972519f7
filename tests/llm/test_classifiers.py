import random
import zlib

import numpy as np
import pytest

from askloom.llm import quality as Q
from askloom.llm import toxicity as T

LABELS = "doc_id long, quality int, toxic int, text string"


def held_id(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def corpus(docs, spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(600)]
    rows, labels = [], []
    for i in range(500):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        bad, toxic = i % 6 == 0, i % 5 == 1
        if bad:
            words = [w + rng.choice(["###", "$$$"]) for w in words] if i % 12 else words[:1] * 80
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["Vile", "rotten!"]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(not bad), int(toxic), "clash"))
    labels += [(2, None, None, None), (None, 1, 1, None), (3, 7, 7, None), (9999, 1, 1, None)]
    return docs(rows), spark.createDataFrame(labels, LABELS), labels


def check(rows, labels, column, limit, least):
    y = {x[0]: x[column] for x in labels[:500]}
    test = [(r.doc_id, r.score) for r in rows if held_id(r.doc_id)]
    assert np.mean([(s >= limit) == (y[i] == 1) for i, s in test]) >= least
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality(corpus):
    docs, labels, rows = corpus
    out = Q.scored(docs, Q.learn(docs, labels)).collect()
    check(out, rows, 1, 0.3, 0.97)


def test_toxicity(corpus):
    docs, labels, rows = corpus
    out = T.scored(docs, T.learn(docs, labels)).collect()
    check(out, rows, 2, 0.5, 0.97)
    kept = T.ordinary(docs, labels)
    assert kept.columns == docs.columns and kept.count() < 450


def test_contexts_match_brute_force(docs, monkeypatch):
    monkeypatch.setattr(T, "HELD", 40)
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    vocabulary = {T.key_of(c): k for k, c in enumerate((b"a", b"b", b"c"), 1)}
    seen = {}
    for t in texts:
        w = t.split()
        for k, x in enumerate(w):
            seen.setdefault(vocabulary.get(T.key_of(x.encode()), 0), set()).add(w[k - 1] if k else None)
    got = T.contexts(docs([(i, t, "s") for i, t in enumerate(texts)]), vocabulary, "text")
    assert got.tolist() == [len(seen.get(k, ())) for k in range(4)]


@pytest.mark.parametrize("held", [40, 4_000_000])
def test_probabilities_match_brute_force(docs, spark, monkeypatch, held):
    """Every probability of both classes as the definition says, from plain counts; each level sums to 1."""
    monkeypatch.setattr(T, "HELD", held)
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choices("abcdefghijklmnopqrst", [9, 8, 7, 6, 5] + [1] * 15, k=rng.randint(1, 25))), i % 3 == 0) for i in range(240)]
    texts = [(i, t + " x" * (y and i % 2 == 0) + " zebra y" * (i == 3), y) for i, t, y in texts]
    d = docs([(i, t, "s") for i, t, _ in texts])
    labels = spark.createDataFrame([(i, 1, int(y), None) for i, _, y in texts], LABELS)
    rows, sizes = T.sample_of(d, labels, "toxic", "doc_id", "text", T.SAMPLE)
    words, n, total = T.word_counts(rows, T.D1)
    vocabulary = {w: i + 1 for i, w in enumerate(words)}
    codes, pairs, after = T.pair_counts(rows, vocabulary, T.D2)
    shared = T.contexts(d, vocabulary, "text")
    used = {(t, y) for i, t, y in texts if not held_id(i)}  # equal texts once
    assert sizes == {k: sum(y == k and not held_id(i) for i, _, y in texts) for k in (0, 1)}
    number = lambda w: vocabulary.get(T.key_of(w.encode()), 0)
    first = lambda w: zip([None, *w], w)  # noqa: E731: (word before, word)
    every = {x for _, t, _ in texts for x in first(t.split())}
    known = len({(v, number(w)) for v, w in every})
    lower = [len({v for v, x in every if number(x) == w}) / known for w in range(len(words) + 1)]
    models = {}
    for y in (0, 1):
        own = [t.split() for t, z in used if z == y]
        seen = {x for t in own for x in first(t)}
        count = [sum(number(w) == k for _, w in seen) for k in range(len(words) + 1)]
        m = models[y] = T.ClassModel(n[:, 2, y], total[2, y], codes, pairs[:, 2, y], after[:, 2, y], shared / shared.sum())
        assert total[2, y] == len(seen)
        free = 1 - sum(max(c - T.D1, 0) for c in count[1:]) / len(seen)
        p1 = [(max(count[w] - T.D1, 0) / len(seen) if w else 0) + free * lower[w] for w in range(len(words) + 1)]
        assert np.allclose([m.p(w) for w in range(len(p1))], p1) and abs(sum(p1) - 1) < 1e-9
        triples = {(u, number(a), number(b)) for t in own for u, a, b in zip([None, *t], t, t[1:])}
        for v in range(1, len(words) + 1):
            pair = [sum(x[1:] == (v, w) for x in triples) for w in range(len(words) + 1)]
            kept = [max(c - T.D2, 0) if w else 0 for w, c in enumerate(pair)]
            free2 = 1 - sum(kept) / max(1, sum(pair))
            p2 = [kept[w] / max(1, sum(pair)) + free2 * p1[w] for w in range(len(p1))]
            assert np.allclose([m.p(w, v) for w in range(len(p1))], p2) and abs(sum(p2) - 1) < 1e-9
    assert len(codes) > 3
    assert (n[:, 2] <= n[:, 0] + n[:, 1]).all() and (n[:, 2] >= n[:, :2].max(axis=1)).all()
    r = T.learned(n[:, 2], total[2], codes, pairs[:, 2], after[:, 2], shared)
    text = [number(w) for w in texts[0][1].split()]
    want = []
    for v, w in zip([0, *text], text):
        base = models[1].free / models[0].free * models[1].after_free[v] / models[0].after_free[v]
        want.append(np.log(models[1].p(w, v) / models[0].p(w, v) / base))
    assert np.allclose(r.of(np.array(text)), want)


def test_codes_are_packed_whole():
    rng = np.random.default_rng(2)
    for top in (2**33, 2**45, 2**62):
        x = np.unique(rng.integers(0, top, 1000))
        assert (T.unpacked(T.packed(x)) == x).all()
    assert len(T.unpacked(T.packed(np.zeros(0, np.int64)))) == 0


def test_ordinary_with_clashing_columns(corpus):
    docs, labels, _ = corpus
    from pyspark.sql import functions as F

    clash = docs.withColumns({"score": F.lit(3), "row": F.lit(4), "__toxicity": F.lit(5)})
    got = T.ordinary(clash, labels)
    assert got.columns == clash.columns and got.select("score", "row", "__toxicity").distinct().collect() == [(3, 4, 5)]


def test_tree_traversal_matches_walking():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = Q.grow(x, y, 30)

    def walk(row):
        total = t.start
        for k in t.roots:
            while t.left[k] != k:
                k = t.left[k] if row[t.feature[k]] <= t.bound[k] else t.right[k]
            total += t.value[k]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(t.score(x[:50]), [walk(r) for r in x[:50]])
    assert ((t.score(x) > 0.5) == (y == 1)).mean() > 0.95


def test_tree_growth_matches_brute_force():
    """Every split of the first two trees is the best of all features and bounds by the gain as defined, every leaf value the optimal step."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(260, 4)), 1)
    y = ((x[:, 1] > 0.2) ^ (x[:, 3] + rng.normal(0, 0.5, 260) > 0)).astype(float)
    t = Q.grow(x, y, 2)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, Q.BINS + 1)[1:-1])) for j in range(4)]
    score = np.full(260, t.start)
    assert np.isclose(t.start, np.log(y.mean() / (1 - y.mean())))

    def gain(rows, j, b, g, h):
        left, right = rows & (x[:, j] <= b), rows & (x[:, j] > b)
        if min(h[left].sum(), h[right].sum()) < Q.LEAST:
            return 0.0
        part = lambda r: g[r].sum() ** 2 / (h[r].sum() + Q.LAMBDA)
        return part(left) + part(right) - part(rows)

    for root in t.roots:
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        todo, step = [(root, np.ones(260, bool), 0)], np.zeros(260)
        while todo:
            k, rows, depth = todo.pop()
            best = max(gain(rows, j, b, g, h) for j in range(4) for b in edges[j]) if depth < Q.DEPTH else 0.0
            if t.left[k] == k:
                assert best <= 1e-6 + 1e-9
                step[rows] = -Q.RATE * g[rows].sum() / (h[rows].sum() + Q.LAMBDA)
                assert np.isclose(t.value[k], step[rows][0])
            else:
                assert np.isclose(gain(rows, t.feature[k], t.bound[k], g, h), best)
                todo += [(t.left[k], rows & (x[:, t.feature[k]] <= t.bound[k]), depth + 1), (t.right[k], rows & (x[:, t.feature[k]] > t.bound[k]), depth + 1)]
        score = score + step
    assert np.allclose(t.score(x), 1 / (1 + np.exp(-score)))


def test_nothing_to_learn(spark, ugly, empty):
    none = spark.createDataFrame([], LABELS)
    one = spark.createDataFrame([(1, 1, 0, None), (2, 1, 0, None)], LABELS)
    for labels in (none, one):
        for rows in (Q.scored(ugly, Q.learn(ugly, labels)).collect(), T.scored(ugly, T.learn(ugly, labels)).collect()):
            assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert Q.scored(empty, Q.learn(empty, one)).count() == 0 and T.scored(empty, T.learn(empty, one)).count() == 0


def test_held_out(spark):
    got = {r.id: r.h for r in spark.range(50).select("id", Q.held_out("id").alias("h")).collect()}
    assert got == {i: held_id(i) for i in range(50)}


def test_an_id_of_very_many_rows(spark, docs):
    """The bound of the sample holds for rows, not only for ids."""
    rows = [(1, f"good words here {i}", "s") for i in range(3000)] + [(2, f"zz {i}", "s") for i in range(300)] + [(i, f"text {i}", "s") for i in range(3, 60)]
    d, seen = docs(rows), []
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    grow, Q.grow = Q.grow, lambda x, y: seen.append(len(x)) or grow(x, y)
    try:
        trees = Q.learn(d, labels, sample=10)
    finally:
        Q.grow = grow
    assert seen == [10] and Q.scored(d, trees).where("score between 0 and 1").count() == len(rows)
