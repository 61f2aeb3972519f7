from askloom.llm import near_dup as N


def test_one_of_each_group_where_ids_repeat_or_are_null(docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a + " p", "s"), (1, a + " q", "s"), (2, a + " r", "s"), (None, a + " t", "s"), (None, b + " p", "s"), (None, b + " q", "s"), (1, c, "s"), (1, "", "s"), (1, None, "s")]
    got = [(r.doc_id, (r.text or "-")[0]) for r in N.dedup(docs(rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, "a"), (None, "b"), (1, "c"), (1, "-"), (1, "-")], key=str)
