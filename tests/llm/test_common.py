import pytest

from askloom.llm import common


@pytest.mark.parametrize("most", [16_384, 0])
def test_with_ids(spark, monkeypatch, most):
    """Rows by number, through bitmaps and through the join beyond their bound."""
    monkeypatch.setattr(common, "BITMAPS", most)
    rows = common.numbered(spark.range(5000).withColumnRenamed("id", "__bucket0").repartition(7), "t")
    asked = rows.where("__row.__bucket0 % 3 = 0").select(common.ROW_ID)
    got = common.with_ids(rows, asked.union(asked))
    assert got.columns == rows.columns and sorted(r[common.ROW]["__bucket0"] for r in got.collect()) == list(range(0, 5000, 3))
    left = common.with_ids(rows, asked, keep=False)
    assert left.columns == rows.columns and sorted(r[common.ROW]["__bucket0"] for r in left.collect()) == [i for i in range(5000) if i % 3]
    assert common.with_ids(rows, asked.limit(0)).count() == 0 and common.with_ids(rows, asked.limit(0), keep=False).count() == 5000


def test_stage_and_discard(spark):
    t = common.stage(spark.range(10), "t")
    assert t.count() == 10
    common.discard(t)
    with pytest.raises(Exception, match="(?i)not.exist|no such file"):
        t.collect()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")
