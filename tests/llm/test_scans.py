import random
import re

import pytest

from askloom.llm import license_scan as L
from askloom.llm import token_counts as C


def greedy(vocabulary, word):
    n = at = 0
    while at < len(word):
        k = next((k for k in range(len(word), at, -1) if word[at:k] in vocabulary), None)
        if k is None:
            return -1
        n, at = n + 1, k
    return n


@pytest.mark.parametrize("seed", range(5))
def test_counts_match_greedy_search(seed):
    rng = random.Random(seed)
    vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(25)}
    a = C.Automaton(vocabulary)
    for _ in range(600):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))
        assert a.count(w) == greedy(vocabulary, w), w


def test_counts_over_documents(docs, ugly, empty):
    from askloom.llm.packing import tokenizer_file

    path = tokenizer_file("piece_bpe_32k.model")
    vocabulary = set(C.sentencepiece_vocabulary(path))
    texts = ["The quick brown fox", "", None, "naïve ☃ 漢字", "tabs\tand\nlines"]
    got = {r.id: r for r in C.count_tokens(docs([(i, t, "s") for i, t in enumerate(texts)]), path).collect()}
    for i, t in enumerate(texts):
        ns = [greedy(vocabulary, C.MARK + w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        assert (got[i].n_words, got[i].n_tokens, got[i].n_unknown) == (len(ns), sum(max(n, 1) for n in ns), ns.count(-1))
    assert C.count_tokens(ugly, path).count() == 10 and C.count_tokens(empty, path).count() == 0


def test_scanner():
    s = L.Scanner()
    n, base, found = s.scan("x CC-BY cc by. All rights\nreserved")
    assert n == 8 and base == [("cc-by", 1), ("cc-by", 3), ("reserved", 5)]
    assert [m[:5] for m in found] == [("reserved", "all rights reserved", 5, 8, 0)]
    fuzzy = s.scan("foo Relased under the MIT Licence, bar")[2]
    assert [(m[0], m[2], m[3], m[4]) for m in fuzzy] == [("mit", 1, 6, fuzzy[0][4])] and 0 < fuzzy[0][4] <= 3
    assert s.scan(None) == (0, [], []) and s.scan("the cat sat on licensed ground")[2] == []


def test_base_places_match_brute_force():
    rng, s = random.Random(9), L.Scanner()
    for _ in range(80):
        words = [rng.choice(["cc", "by", "all", "rights", "reserved", "general", "public", "license", "é", "x1"]) for _ in range(60)]
        want = sorted((k, label) for phrase, label in L.BASE.items() for k in range(60) if words[k : k + len(phrase.split())] == phrase.split())
        n, base, _ = s.scan("  ".join(words))
        assert n == 60 and sorted((w, label) for label, w in base) == want


def test_fuzzy_finds_every_notice_within_its_edits():
    import regex

    rng, s = random.Random(4), L.Scanner()
    for _ in range(120):
        notice = rng.choice(list(L.NOTICES))
        t = list(notice)
        for _ in range(rng.randint(0, s.edits[notice])):
            t[rng.randrange(len(t))] = rng.choice("abcdefgh")
        text = "some words before " + "".join(t) + " and after"
        joined = f" {' '.join(w.decode() for w in L.words_of(text))} "
        if regex.search(f"(?:{notice}){{e<={s.edits[notice]}}}", joined):
            assert any(m[1] == notice for m in s.scan(text)[2]), text


def distance(a, b):
    """Edits between two strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def ends(notice, text):
    """For each end place in the text the least edits of any stretch that ends there."""
    last = [0] * (len(text) + 1)
    for i, x in enumerate(notice, 1):
        row = [i]
        for j, y in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last


def test_spans_and_edits_match_a_search_of_whole_texts():
    """Both ways: every place a plain search over the whole text finds is found, and what is found is such a place, its edits counted right."""
    rng, s, hits, misses = random.Random(12), L.Scanner(), 0, 0
    for _ in range(60):
        words = [rng.choice(["license", "rights", "the", "public", "granted", "free", "source", "house", "mit", "all", "by"]) for _ in range(30)]
        planted = rng.choice(list(L.NOTICES))
        t = list(planted)
        for _ in range(rng.randint(0, s.edits[planted] + 3)):
            k, c = rng.randrange(len(t)), rng.choice("abcdefgh")
            t[k : k + rng.choice([0, 1, 1])] = rng.choice([[], [c], [c]])
        words[15:15] = "".join(t).split()
        joined = f" {' '.join(words)} "
        found = s.scan(" ".join(words))[2]
        for notice, k in s.edits.items():
            own = [m for m in found if m[1] == notice]
            least = ends(notice, joined)
            assert bool(own) == (min(least) <= k), (notice, joined)
            hits, misses = hits + len(own), misses + (not own)
            for label, _, first, last, edits, matched in own:
                assert label == L.NOTICES[notice] and edits == distance(notice, matched) <= k and matched in joined
                shown = " ".join(words[first:last])
                assert matched.strip() in shown and len(words[first:last]) <= len(matched.split()) + 1
            # Every place that is near enough lies at a span that was found.
            spans = [(x.start(), x.end()) for m in own for x in re.finditer(re.escape(m[5]), joined)]
            assert all(any(a - k <= e <= b + k for a, b in spans) for e, d in enumerate(least) if d <= k), notice
    assert hits > 30 and misses > 300


def test_scan_edges(spark, ugly, empty, docs, tmp_path):
    assert L.scan_licenses(ugly).count() == 10 and L.scan_licenses(empty).count() == 0
    d = docs([(1, "All rights reserved. cc by", "s"), (2, None, "s")])
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in L.query(spark, str(tmp_path)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels, got[1].score) == (2, 0, 3, "cc-by,reserved", "cc-by,reserved", 1.0)
    assert (got[2].n_base, got[2].first_word, got[2].base_labels, got[2].labels, got[2].score) == (0, None, "", "", 0.0)


def test_ids_of_any_type(spark):
    from askloom.llm.packing import tokenizer_file

    d = spark.createDataFrame([("id-1", "all rights reserved"), (None, None), ("id-1", "")], "doc_id string, text string")
    assert sorted(((r.id, len(r.base)) for r in L.scan_licenses(d).collect()), key=str) == sorted([("id-1", 1), (None, 0), ("id-1", 0)], key=str)
    assert {r.id for r in C.count_tokens(d, tokenizer_file("piece_bpe_32k.model")).collect()} == {"id-1", None}
    big = spark.createDataFrame([(2**60 + 1, "a"), (None, "b")], "doc_id long, text string").coalesce(1)
    assert {r.id for r in C.count_tokens(big, tokenizer_file("piece_bpe_32k.model")).collect()} == {2**60 + 1, None}
