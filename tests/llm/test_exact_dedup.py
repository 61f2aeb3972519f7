import hashlib
import re

from askloom.llm import exact_dedup as D


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_groups_match_brute_force(docs):
    base = ["same text", "same  text", "same\ttext", "Same text", "", None, " ", "x" * 5000, "x" * 4999 + "y"]
    rows = [(i, base[i % len(base)], "s") for i in range(40)]
    got = {r.id: r for r in D.duplicates(docs(rows)).collect()}
    left = sorted(r.doc_id for r in D.dedup(docs(rows)).collect())
    for i, t, _ in rows:
        group = [j for j, u, _ in rows if norm(u) == norm(t)]
        g = got[i]
        assert (g.keep_id, g.group_size, g.kept) == (min(group), len(group), i == min(group))
        assert bytes(got[i].digest) == hashlib.sha256(norm(t).encode()).digest() and (i in left) == g.kept


def test_edges(ugly, empty):
    rows = D.duplicates(ugly).collect()
    assert len(rows) == 10
    same = [r for r in rows if r.group_size == 3 and r.keep_id == 1]
    assert len(same) == 3 and sum(r.kept for r in same) == 1  # two repeated rows and one with a null id
    nothing = [r for r in rows if r.keep_id == 2]
    assert [r.group_size for r in nothing] == [3, 3, 3] and sum(r.kept for r in nothing) == 1
    kept = D.dedup(ugly)
    assert kept.columns == ugly.columns and kept.count() == sum(r.kept for r in rows)
    assert D.duplicates(empty).count() == 0 and D.dedup(empty).columns == empty.columns
