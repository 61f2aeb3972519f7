import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from askloom.llm.common import work_dir


def test_registered():
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in q) == 1
    assert "pipeline" in q and set(sql) <= set(q)


@pytest.mark.parametrize("table", ["ugly", "empty"])
def test_odd_tables(spark, request, tmp_path, table):
    """Nulls in every column, empty and very long texts, repeated rows, clashing columns; and no rows at all."""
    d = request.getfixturevalue(table).withColumns({"pass": F.lit(1), "__row_id": F.lit(2), "score": F.lit(3)})
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*((i, 1, 0) for i in range(1, 7)), (7, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert k == 4 or now.columns == d.columns
    assert (now.count() > 0) == (table == "ugly")


def test_stages(spark, docs, tmp_path):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(1500)}" for _ in range(60)) for _ in range(180)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts[:120])]
    rows += [(500 + i, texts[i], "s0") for i in range(5)] + [(600 + i, texts[i] + " tail", "s1") for i in range(5)]
    rows += [(700 + i, texts[120 + i] + " vile", "s1") for i in range(60)]
    d = docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(120)] + [(700 + i, 1, 1) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert now.columns == d.columns
        seen.append({r.doc_id for r in now.select("doc_id").collect()})
    clean = seen[0] & set(range(120))
    assert len(clean) >= 114 and len(seen[0] & set(range(700, 760))) <= 3
    assert seen[1] & set(range(120)) == clean and not {i for i in range(5) if i in seen[1] and 500 + i in seen[1]}
    assert not {i for i in range(5) if i in seen[2] and 600 + i in seen[2]}
    assert seen[3] <= seen[2] and seen[4] == seen[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_stages_leave_nothing_behind(spark, docs, tmp_path):
    """What a stage staged is gone once the next one has begun; of the corpus no stage but the packing keeps a copy."""
    rows = [(i, " ".join(f"w{(i * 7 + k) % 900}" for k in range(50)), f"s{i % 3}") for i in range(60)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 3)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = work_dir(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        f(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        here = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
        assert not here & {"exact-rows", "near-rows", "mix-rows"}
        assert all(x.split("-")[0] in {"toxicity": ["toxicity"], "exact_dedup": ["exact", "files", "bitmaps"], "near_dedup": ["near", "stars", "files", "bitmaps"], "mixing": ["mix", "files"], "packing": ["pack"]}[name] for x in here), (name, here)


