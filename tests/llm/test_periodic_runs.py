import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from askloom.llm import periodic_runs as X

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=6, exponent=4):
    """All runs by their definition: maximal stretches of each period, with no smaller period."""
    n, found = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            part = w[start : start + length]
            if length >= max(least, exponent * q) and not any(all(a == b for a, b in zip(part, part[r:])) for r in range(1, q)):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def words_like(rng):
    """Random words over few symbols with powers, powers of powers and Fibonacci words in them."""
    kind = rng.randrange(5)
    a = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 40))]
    if kind == 0:
        return a
    root = [rng.randrange(3) for _ in range(rng.randint(1, 12))]
    if kind == 1:
        return a + root * rng.randint(2, 9) + root[: rng.randint(0, len(root))] + a
    if kind == 2:
        return (root[:3] * 5 + a[:4]) * rng.randint(1, 6)
    if kind == 3:
        x, y = [0], [0, 1]
        for _ in range(8):
            x, y = y, y + x
        return y[: rng.randint(1, 80)] * rng.randint(1, 4)
    return root * 40 + [7] + root * 40


def test_runs_match_their_definition():
    rng, powers, seen = random.Random(5), X.Powers(), 0
    for _ in range(1500):
        w = words_like(rng)
        want = brute(w)
        seen += len(want)
        assert X.find_runs(w, powers) == want, w
        if rng.random() < 0.2:
            assert X.find_runs(w, powers, hashes=False) == want, w
        if rng.random() < 0.2:
            assert X.find_runs(w, powers, 2, 3) == brute(w, 2, 3), w
    assert seen > 1000


def test_long_texts():
    """Periods of thousands of words, one word alone, periods in periods; verified against direct comparison."""
    rng, powers = random.Random(8), X.Powers()
    page = [rng.randrange(400) for _ in range(3000)]
    assert X.find_runs([9999] + page * 5 + page[:17], powers) == [(1, 15017, 3000)]
    assert X.find_runs([3] * 30_000, powers) == [(0, 30_000, 1)]
    inner = ([1, 2] * 50 + [3]) * 40
    assert X.find_runs(inner, powers) == X.find_runs(inner, powers, hashes=False) and (0, 4040, 101) in X.find_runs(inner, powers)


def test_a_lie_is_found_out(monkeypatch):
    """With hashes that hold nothing, the words decide."""
    monkeypatch.setattr(X.Lce, "same", lambda self, i, j, length: X.np.ones(len(i), bool))
    w = [0, 1] * 5 + [2, 0, 1, 3, 4] * 6 + [5, 6, 7]
    assert X.find_runs(w, X.Powers()) == brute(w)


def expected(doc_id, text):
    w = WORDS.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *four, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_query_by_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["a", "b", "é", "word"]) for _ in range(rng.randint(0, 60))), "en", "s", 1) for i in range(400)]
    rows += [(1, "x\ty\nx y x  y x y", None, None, None), (None, "z " * 9, None, None, None), (500, None, None, None, None), (501, "", None, None, None), (1, "x\ty\nx y x  y x y", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = X.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(i, t) for i, t, *_ in rows), key=str)


def test_ugly_tables(spark, ugly, empty):
    found = {(r.id, r.n_words, len(r.runs)) for r in X.periodic_runs(ugly).collect()}
    assert {(2, 0, 0), (3, 0, 0), (6, 0, 0), (4, 120_000, 1), (5, 18, 1), (7, 3, 0)} <= found
    assert X.periodic_runs(ugly).count() == 10 and X.periodic_runs(empty).count() == 0
    named = X.periodic_runs(spark.createDataFrame([("k", "a b " * 5)], "doc_id string, text string")).first()
    assert (named.id, named.best.asDict(), named.collapsed) == ("k", {"start": 0, "length": 10, "period": 2}, "a b")
    with pytest.raises(ValueError):
        X.periodic_runs(empty, exponent=2)
    assert X.periodic_runs(empty).select(F.size("runs")).count() == 0
