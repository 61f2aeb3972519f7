import hashlib
import re

import pytest
from pyspark.sql import functions as F

from askloom.llm import fill_in_middle as X


def brute(doc_id, text, unit="(?s)."):
    """Output, form and parts, one unit after another."""
    text = text or ""
    units = re.findall(unit, text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if text == "" or any(x in text for x in X.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows_of(found):
    return sorted(((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found.collect()), key=str)


def test_documents_of_every_kind(docs, ugly, empty):
    odd = ["😀a" * 700, "x" * X.BLOCK, "y" * (2 * X.BLOCK), "z" * (X.BLOCK + 1), "ab<P>cd", "ends with <", "<S", "a\r\nb\n", "é", "<", "<M", "tail<M>"]
    table = docs([(i, odd[i % len(odd)], "s") for i in range(120)])
    for rows in (table, ugly):
        want = sorted(((r.doc_id, *brute(r.doc_id, r.text)) for r in rows.collect()), key=str)
        assert rows_of(X.fill_in_middle(rows)) == want
    assert {"plain", "psm", "spm"} <= {f for _, _, f, *_ in rows_of(X.fill_in_middle(table))}
    assert X.fill_in_middle(empty).count() == 0


@pytest.mark.parametrize("unit", [r"\S+\s*", r"[^\n]*\n", "[a-z]{1,3}"])
def test_other_units(docs, unit):
    """What a pattern leaves out is a unit a code point."""
    texts = [" lead and  words " * 60, "a\nbb\n\nccc", "ABC def\n" * 300, "", "ñ"]
    table = docs([(i, texts[i % 5], "s") for i in range(40)])
    want = sorted(((r.doc_id, *brute(r.doc_id, r.text, f"(?s)(?:{unit})|.")) for r in table.collect()), key=str)
    assert rows_of(X.fill_in_middle(table, unit)) == want


def test_round_trip_and_types(spark, ugly):
    done = X.fill_in_middle(ugly, plain_percent=0, spm_percent=50)
    assert done.select(X.restored(F.col("output"), F.col("form")).alias("t")).exceptAll(ugly.select(F.coalesce("text", F.lit("")).alias("t"))).count() == 0
    names = spark.createDataFrame([("id-1", "some text", 1)], "doc_id string, text string, n int")
    assert X.fill_in_middle(names).schema["id"].dataType.typeName() == "string" and X.fill_in_middle(names).count() == 1


def test_texts_are_exchanged_once(ugly):
    plan = X.fill_in_middle(ugly)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    written = [line for line in text.splitlines() if re.search(r"[- ]Exchange ", line) and "ReusedExchange" not in line]
    assert len(written) == 1, written
