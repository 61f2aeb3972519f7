import json

from askloom.functions import extract as X
from askloom.streaming.loop import Loop


def test_last_object():
    assert X.last_object('x {"a": 1} y {"b": {"c": 2}}') == {"b": {"c": 2}}
    assert X.last_object('```json\n{"a": "} {"}\n``` {broken') == {"a": "} {"}
    assert X.last_object(r'{"tex": "$\alpha$ \n"}') == {"tex": "$\\alpha$ \n"}
    assert X.last_object("[1]") is None and X.last_object(None) is None


def test_first_object_and_judgments():
    good = {"criteria": [{"index": 2, "satisfied": False, "evidence": "b"}, {"index": 1, "satisfied": True, "evidence": "a"}]}
    assert X.judged("Sure: " + json.dumps(good) + ' {"x": 1}', 2) == {"satisfied": [True, False], "evidence": ["a", "b"], "error": None}
    bad = [{"criteria": []}, {"criteria": [1, 2]}, {"criteria": [{"index": 1, "satisfied": 1, "evidence": ""}] * 2}, {}]
    assert all(X.judged(json.dumps(b), 2)["error"] for b in bad) and X.judged("", 1)["error"]


def test_repair():
    assert X.repaired(r"\alpha \\beta \n é \\") == r"\\alpha \\beta \n é \\"


VERDICT = "- **CHECK_1_VERDICT:** NO_LEAKAGE\n2) CHECK_2_VERDICT: GOOD\nCHECK_3_VERDICT: PASS\n__CHECK_4_VERDICT__: CONSISTENT\nOVERALL: PASS\nFEEDBACK: fine\nmore"


def test_verdicts(spark):
    texts = [VERDICT, VERDICT.replace("GOOD", "BAD"), VERDICT.replace("OVERALL: PASS", "OVERALL: PASS | FAIL"), VERDICT.replace("OVERALL: PASS", "Overall -> fail"), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.qv_lines("t").alias("l"))
    got = {r.i: (r.v.overall, r.v.contradiction, len(r.v.missing_checks), r.l.feedback) for r in df.select("i", "l", X.qv_verdict(df.l).alias("v")).collect()}
    assert got[0] == (True, False, 0, "fine\nmore") and got[1][:2] == (False, True)
    assert got[2][0] is None and got[3][0] is False and got[4] == got[5] == (None, False, 0, None)  # nothing said: nothing missing


def test_verdict_lines():
    """Lines made from parts: every mark, emphasis and spacing reads as the same verdict; what is no verdict line reads as none."""
    for mark in ("", "- ", "* ", "+\t", "12. ", "3) ", "  "):
        for left, right in (("", ""), ("**", "**"), ("__", "__"), ("** ", "")):
            for colon in (":", " : ", ":\t"):
                for value in ("FAIL", "**FAIL", "** __ FAIL", "FAIL, because", "FAIL or so"):
                    assert X.verdict_line(f"{mark}{left}OVERALL{right}{colon}{value}") == ("OVERALL", "FAIL"), (mark, left, colon, value)
    for echo in ("PASS | FAIL", "PASS/FAIL", "PASS or FAIL", "PASS** | **FAIL**", "PASS or *fail*"):
        assert X.verdict_line(f"OVERALL: {echo}") == ("OVERALL", None), echo
    for other in ("OVERALL PASS", "-OVERALL: PASS", "x OVERALL: PASS", "CHECK_5_VERDICT: GOOD", "OVERALL: pass", "", ":", "1 OVERALL: PASS"):
        assert X.verdict_line(other) is None, other
    assert X.last_overall("so overall - pass") is True and X.last_overall("overall result: pass") is None and X.last_overall("Overall: pass; overall fail!") is False
    assert X.last_overall("overall good, pass") is None and X.last_overall("noverall pass") is None and X.last_overall("overall pass/fail") is None
    assert X.last_overall("overall passed") is None
    assert X.verdicts("FEEDBACK : a\n b ")["feedback"] == "a\n b" and X.verdicts("FEEDBACK none")["feedback"] is None


def test_identity_ignores_layout():
    d = {"context": "a \r\nb", "question": "q", "rubric": [{"criterion": "c", "weight": "3"}]}
    e = {"rubric": [{"weight": 3, "criterion": "c", "category": "positive"}], "question": "q", "context": "a\nb  ", "extra": 1}
    assert X.identity(json.dumps(d)) == X.identity(json.dumps(e)) != X.identity(json.dumps(d | {"question": "r"}))


def test_unbound_parts(spark):
    c = json.dumps({"context": "some context", "question": "Why?", "rubric": [{"criterion": "names it", "weight": -3}, {"criterion": "cites", "weight": 2}]})
    p = "some context ... why? 1. [-3] names it. 2. [+2 x] cites"
    df = spark.createDataFrame([(p, c), (p.replace("-3", "+3"), c), ("", c)], "p string, c string")
    assert [r.x for r in df.select(X.unbound_parts("p", "c").alias("x")).collect()] == [[], ["weight of criterion 1"], ["question", "context head", "criterion 1", "criterion 2"]]


def test_loop():
    s = Loop(max_rounds=2)
    say = lambda *a: s.step(*a)
    assert say("challenger", "q1", None) == "round" and say("both", "other", True) == "refused: foreign question"
    assert say("both", "q1", True) == "refused: no passing verification"
    assert say("challenger", "q2", None) == "round" and say("challenger", "q3", None) == "refused: round budget"
    assert say("quality_verifier", "q2", True) == "verified" and say("quality_verifier", "q2", True) == "refused: repeated verification"
    assert say("weak-only", "q2", False) == "evaluated" and say("weak-only", "q2", True) == "cached"
    assert say("both", "q2", True) == "accepted" and say("challenger", "q4", None) == "refused: after acceptance"
