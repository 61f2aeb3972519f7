"""Row numbers hold when splits of the scan change between two jobs, as they do when executors come or go."""

import re

import pytest
from pyspark.sql import functions as F
from test_mixing import rows_of
from test_near_dup import brute, corpus

from askloom.llm import common
from askloom.llm import exact_dedup as D
from askloom.llm import mixing as M
from askloom.llm import near_dup as N


@pytest.fixture
def restless(spark, monkeypatch):
    """After every written table a scan has other splits."""
    conf, settings = spark.conf, ("spark.sql.files.openCostInBytes", "spark.sql.leafNodeDefaultParallelism")
    before = {k: conf.get(k, None) for k in settings}
    conf.set(settings[0], 1)
    conf.set(settings[1], 2)
    stage = common.stage

    def restaged(df, name):
        out = stage(df, name)
        conf.set(settings[1], {"2": 5, "5": 9, "9": 2}[conf.get(settings[1])])
        return out

    for m in (common, D, M, N):
        monkeypatch.setattr(m, "stage", restaged)
    yield
    for k, v in before.items():
        conf.unset(k) if v is None else conf.set(k, v)


def test_near_copies(docs, restless):
    rows = corpus(1, 30, 6, 120, 9)
    want, d = brute(rows), docs(rows, parts=11)
    assert {r.id: (r.n_shingles, r.component_id) for r in N.near_duplicates(d).collect()} == want
    assert sorted(r.doc_id for r in N.dedup(d).collect()) == sorted({c for _, c in want.values()})


def test_exact_copies(docs, restless):
    rows = [(i, f"{i % 40} " * (1 + i % 40), "s") for i in range(160)]
    d = docs(rows, parts=11)
    assert {r.id: r.keep_id for r in D.duplicates(d).collect()} == {i: i % 40 for i in range(160)}
    assert sorted(r.doc_id for r in D.dedup(d).collect()) == list(range(40))


def test_numbers_by_file_and_place(spark, docs, restless):
    """Without a copy: the same results, and other tables are copied as before."""
    rows = [(i, f"{i % 40} " * (1 + i % 40), "s") for i in range(160)]
    d = docs(rows, parts=11).withColumn("_metadata", F.lit("own"))
    with common.collecting() as left:
        numbers = common.numbered(d, "rows", written=True)
        assert [t.columns for t in left] == [["__file", "__nth"]]
    twice = [{r[0]: r[1] for r in numbers.select("__row_id", common.field("doc_id")).collect()} for _ in range(2)]
    assert twice[0] == twice[1] and sorted(twice[0].values()) == sorted(i for i, *_ in rows) and len(twice[0]) == 160
    assert sorted(r.doc_id for r in D.dedup(d, written=True).collect()) == list(range(40))
    assert D.dedup(d, written=True).columns == d.columns
    made = spark.range(50).selectExpr("id as doc_id", "concat('t', id % 7) as text").repartition(3)
    assert D.dedup(made, written=True).count() == 7
    near = corpus(1, 30, 6, 120, 9)
    want = brute(near)
    assert sorted(r.doc_id for r in N.dedup(docs(near, parts=11), written=True).collect()) == sorted({c for _, c in want.values()})


@pytest.mark.parametrize("written", [False, True])
def test_mixed(docs, restless, written):
    rows = rows_of()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    got = M.mixed(docs(rows, parts=11), written=written).collect()
    assert got and all(len(r.text.split()) <= size[r.doc_id] and all(w.startswith(f"w{r.doc_id}_") for w in r.text.split()) for r in got)
    total = sum(size.values())
    assert abs(sum(len(r.text.split()) for r in got) - 1.5 * total) <= 10 * M.BLOCK
