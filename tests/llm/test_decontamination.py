import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from askloom.llm import decontamination as X

ASCII = str.maketrans(X.UPPER, X.LOWER)


def words(text):
    return re.findall(X.WORD, (text or "").translate(ASCII))


def brute(texts, items, window=10):
    """Per text: words, hit words, spans, items."""
    phrases = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[k : k + window]), set()).add("" if item is None else str(item))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for k in range(len(w)):
            for n in range(1, window + 1):
                if tuple(w[k : k + n]) in phrases and k + n <= len(w):
                    hit.update(range(k, k + n))
                    found |= phrases[tuple(w[k : k + n])]
        spans = []
        for x in sorted(hit):
            if spans and spans[-1][1] == x:
                spans[-1][1] = x + 1
            else:
                spans.append([x, x + 1])
        out.append((len(w), len(hit), tuple(map(tuple, spans)), tuple(sorted(found))))
    return out


def case(rng, n_items=14, n_docs=80):
    """Few words, so that phrases overlap, repeat, nest and break."""
    vocabulary = [f"w{k}" for k in range(rng.choice([2, 5, 40]))] + ["É", "it"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k % 9, say(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for k in range(n_items)]
    items = [(k, t) for k, t in items if len(words(t)) != 1 or rng.random() < 0.2]
    docs = []
    for _ in range(n_docs):
        parts = [say(rng.randint(0, 12)) for _ in range(rng.randint(0, 3))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(items)[1].upper() if items else "")
        docs.append(rng.choice([" ", ", ", " zebra\n"]).join(parts))
    return docs, [*items, items[0], (None, say(12))] if items else []


def rows_of(found):
    return sorted(((r.id, r.n_words, r.n_hit, tuple((s.start, s.end) for s in r.spans), tuple(r.items)) for r in found.collect()), key=str)


@pytest.mark.parametrize("seed", range(40))
def test_index_against_plain_search(seed):
    rng = np.random.default_rng(seed)
    n, symbols = int(rng.integers(1, 400)), int(rng.choice([2, 3, 9, 300]))
    s = np.append(rng.integers(0, symbols, n), 0)
    if seed % 3 == 0:
        s = np.append(np.tile(s[: 1 + n // 5], 6), 0)
    order = X.suffix_order(s).tolist()
    breaks = {int(p): k for k, p in enumerate(np.flatnonzero(s == 0))}

    def suffix(p):
        end = next(q for q in range(p, len(s)) if s[q] == 0)
        return [(int(x), 0) for x in s[p:end]] + [(0, breaks[end])]

    assert order == sorted(range(len(s)), key=suffix)
    index = X.FMIndex(s, symbols, sample=int(rng.integers(1, 9)))
    assert index.locate(np.arange(len(s))).tolist() == order
    patterns = [p for p in ([int(x) for x in s[k : k + int(rng.integers(1, 7))]] for k in rng.integers(0, len(s), 30)) if 0 not in p and p]
    if patterns:
        rows = np.array([[-1] * (6 - len(p)) + p for p in patterns])
        lo, hi = index.search(rows)
        for p, a, b in zip(patterns, lo, hi):
            assert sorted(order[a:b]) == [k for k in range(len(s)) if s[k : k + len(p)].tolist() == p]


@pytest.mark.parametrize("seed", range(6))
def test_scan_by_brute_force(spark, docs, seed):
    """In one pass and many, in shards of all documents and of few."""
    rng = random.Random(seed)
    texts, items = case(rng)
    texts[3] = None
    table, bench = docs([(k, t, "s") for k, t in enumerate(texts)]), spark.createDataFrame(items or [], "item_id long, text string")
    want = sorted(((k, *row) for k, row in enumerate(brute(texts, items))), key=str)
    assert rows_of(X.contaminated(table, bench)) == want
    assert rows_of(X.contaminated(table, bench, shard=25)) == want
    assert rows_of(X.contaminated(table, bench, most=30)) == want


def test_long_items_are_cut_into_overlapping_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(X, "PART", 12)
    w = [f"x{k}" for k in range(61)]
    bench = spark.createDataFrame([("long", " ".join(w))], "item_id string, text string")
    table = docs([(k, " ".join(w[k : k + 10]), "s") for k in range(52)])
    assert all(r.n_hit == 10 and r["items"] == ["long"] for r in X.contaminated(table, bench).collect())


def test_cleaned_texts(spark, docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "red, fox")], "item_id long, text string")
    texts = ["Start ONE two three four five six, seven eight nine ten. End", "É red FOX!", "nothing here", None, "red fox red fox"]
    for most in (X.PASS_WORDS, 4):
        got = {r.id: r.cleaned for r in X.contaminated(docs([(k, t, "s") for k, t in enumerate(texts)]), bench, cleaned=True, most=most).collect()}
        assert got == {0: "Start . End", 1: "É !", 2: None, 3: None, 4: ""}


def test_odd_tables(spark, ugly, empty):
    bench = spark.createDataFrame([(1, "idiot idiot idiot"), (2, None), (3, " . ")], "item_id long, text string")
    found = {(r.id, r.n_words, r.n_hit) for r in X.contaminated(ugly, bench).collect()}
    assert {(7, 3, 3), (2, 0, 0), (3, 0, 0), (6, 0, 0), (4, 120_000, 0), (None, 7, 0), (5, 18, 0)} <= found
    none = spark.createDataFrame([], "item_id long, text string")
    assert X.contaminated(ugly, none).where("n_hit = 0 and size(items) = 0").count() == 10
    assert X.contaminated(empty, bench).count() == 0
    named = spark.createDataFrame([("a", "idiot idiot idiot now")], "doc_id string, text string")
    assert X.contaminated(named, bench).first().asDict()["id"] == "a"


def test_query_and_sql(spark, tmp_path):
    texts, items = case(random.Random(77), 30, 150)
    rows = [(k // 2, t, None, None, None) for k, t in enumerate(texts)] + [(None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = []
    for (doc_id, *_), (n, n_hit, _, found) in zip(rows, brute([r[1] for r in rows], items)):
        want.append((doc_id, n, n_hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), n_hit > 0))
    got = sorted(map(tuple, X.query(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(want, key=str)
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(db.sql(X.SQL).fetchall(), key=str) == got
