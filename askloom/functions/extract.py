"""Records out of model text. Scanning nested braces is beyond SQL, so the scanners are Arrow-batched UDFs; the rest is Columns."""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lazy import arrow_udf, ship

JSON_ESCAPE = re.compile(r'\\(?:["\\/bfnrtu])|\\', re.S)
# Fixed value: a fenced object.
FENCED = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.S)
#: What matters for nesting: strings (with escapes) as a whole, and braces.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}]', re.S)


def repaired(raw: str) -> str:
    """Every backslash that starts no JSON escape is doubled, from left to right."""
    return JSON_ESCAPE.sub(lambda m: m.group() if len(m.group()) == 2 else "\\\\", raw)


def decoded(raw: str):
    for text in (raw, repaired(raw)):
        try:
            return json.loads(text)
        except ValueError:
            continue
    return None


def groups(text: str) -> set[tuple[int, int]]:
    """(start, end) of every brace group, each read from its own brace on, which begins outside of strings.

    A brace that another one's reading meets outside of strings is read alike from there, so one reading settles all braces that it
    meets, also those that never close; only braces within its strings are read anew.
    """
    ends: dict[int, int | None] = {}
    for brace in re.finditer(r"\{", text):
        if brace.start() in ends:
            continue
        waiting = []
        for m in TOKEN.finditer(text, brace.start()):
            if m.group() == "{":
                waiting.append(m.start())
                ends.setdefault(m.start(), None)
            elif m.group() == "}":
                ends[waiting.pop()] = m.end()
                if not waiting:
                    break
    return {(start, end) for start, end in ends.items() if end}


def last_object(text: str | None) -> dict | None:
    """The last valid JSON object of a text that lies in no other valid one, fenced or not."""
    spans = {m.span(1) for m in FENCED.finditer(text or "")} | groups(text or "")
    best: tuple[int, int, dict] | None = None
    reach = -1
    # By start, longest first: a span within an earlier valid one is nested.
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        if e <= reach:
            continue
        if isinstance(got := decoded(text[s:e]), dict):
            best, reach = (s, e, got), e
    return best[2] if best else None


def first_object(text: str | None) -> dict | None:
    """The first JSON object of a text; of the repaired text if it has none."""
    decoder = json.JSONDecoder()
    for raw in (text or "", repaired(text or "")):
        for m in re.finditer(r"\{", raw):
            try:
                got, _ = decoder.raw_decode(raw, m.start())
            except ValueError:
                continue
            return got
    return None


def dumped(x) -> str | None:
    return None if x is None else json.dumps(x, ensure_ascii=False, separators=(",", ":"))


@arrow_udf("string")
def extract_json(texts: pd.Series) -> pd.Series:
    """The last top-level JSON object of each text, as JSON; null if there is none."""
    return texts.map(lambda t: dumped(last_object(t)))


@arrow_udf("string")
def repair_escapes(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else repaired(t))


@arrow_udf("string")
def extract_first_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: dumped(first_object(t)))


CANDIDATE = "STRUCT<question_type STRING, reasoning_skills ARRAY<STRING>, context STRING, question STRING, reference_answer STRING>"


def parse_candidate(text: Column) -> Column:
    """A candidate out of a challenger's text: STRUCT<candidate, rubric (JSON)>; null without context, question and rubric."""
    raw = extract_json(text)
    keys = F.json_object_keys(raw)
    complete = F.array_contains(keys, "context") & F.array_contains(keys, "question") & F.array_contains(keys, "rubric")
    return F.when(complete, F.struct(F.from_json(raw, CANDIDATE).alias("candidate"), F.get_json_object(raw, "$.rubric").alias("rubric")))


def defect(entries, n: int) -> str | None:
    """What is wrong with a judge's list of n marks, if anything."""
    if not isinstance(entries, list):
        return "there is no list of criteria"
    if not all(isinstance(e, dict) for e in entries):
        return "a criterion is no object"
    kinds = {"index": int, "satisfied": bool, "evidence": str}
    wrong = [k for k, kind in kinds.items() if any(type(e.get(k)) is not kind for e in entries)]
    if wrong:
        return f"{', '.join(wrong)}: missing or of another type"
    if sorted(e["index"] for e in entries) != list(range(1, n + 1)):
        return f"the indexes are not 1 to {n}, each once"
    return None


def judged(text: str | None, n: int | None) -> dict:
    """satisfied and evidence in criterion order, or an error."""
    found = first_object(text)
    if n is None:
        error = "how many criteria there are is not known"
    elif not isinstance(found, dict):
        error = "the judge wrote no JSON object"
    else:
        error = defect(found.get("criteria"), n)
    marks = [] if error else sorted(found["criteria"], key=lambda e: e["index"])
    return {"satisfied": None if error else [e["satisfied"] for e in marks], "evidence": None if error else [e["evidence"] for e in marks], "error": error}


@arrow_udf("satisfied array<boolean>, evidence array<string>, error string")
def parse_judgments(texts: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([judged(t, None if pd.isna(k) else int(k)) for t, k in zip(texts, n)], columns=["satisfied", "evidence", "error"])


# The verifier's checks with their passing values.
PASSING = {"CHECK_1_VERDICT": "NO_LEAKAGE", "CHECK_2_VERDICT": "GOOD", "CHECK_3_VERDICT": "PASS", "CHECK_4_VERDICT": "CONSISTENT"}

# The words that a verdict line may offer as a choice.
CHOICES = {"PASS", "FAIL", "NO_LEAKAGE", "LEAKAGE", "LEAKS_ANSWER", "GOOD", "BAD", "TOO_EASY", "RECALL", "CONSISTENT", "INCONSISTENT"}
BLANK, CAPITALS = " \t", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def leading(text: str, allowed) -> str:
    """The longest beginning of a text whose characters are all allowed."""
    n = next((i for i, c in enumerate(text) if c not in allowed), len(text))
    return text[:n]


def without_emphasis(text: str) -> str:
    """A text without one mark of emphasis, and blanks, at its start."""
    text = text.lstrip(BLANK)
    return text[2:].lstrip(BLANK) if text[:2] in ("**", "__") else text


def offers_choice(rest: str) -> bool:
    """Whether what follows a verdict names another one to choose: the line is an echo of the question."""
    rest = rest.lstrip(" \t*_")
    if rest[:1] in ("|", "/"):
        rest = rest[1:]
    elif rest[:2].lower() == "or" and rest[2:3] and rest[2] in " \t*_":
        rest = rest[2:]
    else:
        return False
    rest = rest.lstrip(" \t*_")
    word = rest[: next((i for i, c in enumerate(rest) if not (c.isalnum() or c == "_")), len(rest))]
    return word.upper() in CHOICES


def verdict_line(line: str) -> tuple[str, str | None] | None:
    """(key, verdict) of a line ``key: verdict``, which may be a list item and carry emphasis; a verdict of None is an echoed choice."""
    line = line.lstrip(BLANK)
    mark = line.split(" ", 1)[0].split("\t", 1)[0]
    if mark != line and (mark in ("-", "+", "*") or (mark[:-1].isdecimal() and mark[-1] in ".)")):
        line = line[len(mark) :]
    key, colon, said = without_emphasis(line).partition(":")
    key = key.rstrip(BLANK)
    key = key[:-2] if key[-2:] in ("**", "__") else key
    if not colon or key not in (*PASSING, "OVERALL"):
        return None
    while (plain := without_emphasis(said)) != said:
        said = plain
    verdict = leading(said, CAPITALS | {"_"})
    return (key, None if offers_choice(said[len(verdict) :]) else verdict) if verdict else None


def last_overall(text: str) -> bool | None:
    """The last PASS or FAIL that is the first word of capitals after OVERALL; None if there is none, or it is an echoed choice."""
    shown, at, found = text.upper(), 0, None
    inside = lambda c: c.isalnum() or c == "_"
    while (at := shown.find("OVERALL", at)) >= 0:
        begin, at = at, at + len("OVERALL")
        word = next((i for i in range(at, len(shown)) if shown[i] in CAPITALS), len(shown))
        end = word + 4
        if (begin == 0 or not inside(shown[begin - 1])) and shown[word:end] in ("PASS", "FAIL") and not inside(shown[end : end + 1] or " "):
            found, at = (shown[word:end] == "PASS", end), end
    if found is None or offers_choice(text[found[1] :].split("\n", 1)[0]):
        return None
    return found[0]


def verdicts(text: str | None) -> dict:
    """What a quality verifier wrote: its stated overall verdict, each check, feedback. A later line replaces an earlier one."""
    lines = (text or "").split("\n")
    # Most lines of a long text name no key: they are passed over before they are read.
    got = dict(filter(None, map(verdict_line, (x for x in lines if ":" in x and ("OVERALL" in x or "_VERDICT" in x)))))
    stated = {"PASS": True, "FAIL": False}.get(got.get("OVERALL") or "")
    if stated is None:
        stated = last_overall(text or "")
    heads = [(i, x.lstrip().removeprefix("FEEDBACK").lstrip()) for i, x in enumerate(lines) if "FEEDBACK" in x and x.lstrip().startswith("FEEDBACK")]
    note = next(("\n".join([x[1:], *lines[i + 1 :]]).strip()[:4000] for i, x in heads if x.startswith(":")), None)
    return {"said": bool(text), "stated": stated, **{f"check_{i}": got.get(k) for i, k in enumerate(PASSING, 1)}, "feedback": note}


@arrow_udf("said boolean, stated boolean, check_1 string, check_2 string, check_3 string, check_4 string, feedback string")
def qv_lines(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([verdicts(t) for t in texts], columns=["said", "stated", "check_1", "check_2", "check_3", "check_4", "feedback"]).astype({"stated": "boolean"})


def qv_verdict(lines: Column) -> Column:
    """overall (three-valued), contradiction and missing_checks from the verifier's lines; nothing said, nothing missing."""
    checks = [(k, lines[f"check_{i}"], v) for i, (k, v) in enumerate(PASSING.items(), 1)]
    ok = F.forall(F.array(*[c.eqNullSafe(v) for _, c, v in checks]), lambda x: x)
    missing = F.array_compact(F.array(*[F.when(c.isNull(), k) for k, c, _ in checks]))
    return F.struct(
        F.when(lines["stated"], ok).when(~lines["stated"], F.lit(False)).alias("overall"),
        F.coalesce(lines["stated"] & ~ok, F.lit(False)).alias("contradiction"),
        F.when(lines["said"], missing).otherwise(F.array().cast("array<string>")).alias("missing_checks"),
    )


@arrow_udf("string")
def text_norm(texts: pd.Series) -> pd.Series:
    """NFC, line feeds, white-space runs as one space."""
    return texts.map(lambda t: " ".join(unicodedata.normalize("NFC", t or "").split()))


def unescaped(s: str) -> str:
    return re.sub(r'(?:\\u[0-9a-fA-F]{4}){1,2}|\\["\\/bfnrt]', lambda m: json.loads(f'"{m.group()}"'), s)


@arrow_udf("string")
def bind_norm(texts: pd.Series, is_prompt: pd.Series) -> pd.Series:
    """For matching a candidate within a prompt: escapes decoded (prompts only), NFC, lower case, runs beyond [a-z0-9-] one space."""
    return pd.Series([bound(unescaped(t or "") if p else t or "") for t, p in zip(texts, is_prompt)])


INTEGER = re.compile(r"[+-]?[0-9]+")


def scored_items(rubric) -> list[dict] | None:
    """criterion, weight and category of each item of a rubric that can be scored; None for any other."""
    items = []
    for item in rubric if isinstance(rubric, list) else []:
        criterion, weight = (item.get("criterion"), item.get("weight")) if isinstance(item, dict) else (None, None)
        if isinstance(weight, str) and INTEGER.fullmatch(weight.strip()):
            weight = int(weight)
        if not isinstance(criterion, str) or not criterion.strip() or type(weight) is not int or weight == 0:
            return None
        sign = "positive" if weight > 0 else "negative"
        if item.get("category", sign) != sign:
            return None
        items.append({"criterion": criterion, "weight": weight, "category": sign})
    return items if any(i["weight"] > 0 for i in items) else None


def parsed(raw: str | None) -> dict | None:
    """A JSON object, or None: model text may be anything."""
    try:
        got = json.loads(raw) if raw is not None else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def encoded(text: str) -> bytes:
    """UTF-8; half a surrogate pair, which JSON may hold, as its escape."""
    return text.encode("utf-8", "backslashreplace")


def identity(raw: str | None) -> str | None:
    """Canonical hash of a candidate in JSON (context, question, rubric); null unless it has both texts and a rubric that can be scored."""
    d = parsed(raw)
    if d is None or not isinstance(d.get("context"), str) or not isinstance(d.get("question"), str) or (items := scored_items(d.get("rubric"))) is None:
        return None
    tidy = lambda t: "\n".join(line.rstrip() for line in unicodedata.normalize("NFC", t).replace("\r\n", "\n").split("\n"))
    whole = {"context": tidy(d["context"]), "question": tidy(d["question"]), "rubric": [{**i, "criterion": tidy(i["criterion"])} for i in items]}
    return hashlib.sha1(encoded(json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False))).hexdigest()


def older_identity(raw: str | None) -> str | None:
    """The older identity: the default rendering of the three fields, keys as they came; null where one is missing."""
    d = parsed(raw)
    if d is None or not {"context", "question", "rubric"} <= d.keys():
        return None
    return hashlib.sha1(json.dumps({k: d[k] for k in ("context", "question", "rubric")}).encode()).hexdigest()


@arrow_udf("string")
def question_hash(texts: pd.Series) -> pd.Series:
    return texts.map(identity)


@arrow_udf("string")
def legacy_question_hash(texts: pd.Series) -> pd.Series:
    return texts.map(older_identity)


#: How far from a criterion its weight may stand, and how much of a long criterion must be quoted.
NEAR, QUOTED, HEAD = 60, 80, 200


def whole_number(x) -> int | None:
    """An integer as a rubric may give it: a number, cut to an integer, or the text of one."""
    try:
        return int(x)
    except (TypeError, ValueError, OverflowError):
        return None


class Shown:
    """A verifier's prompt, normalised once, with the places of its signed numbers by value."""

    def __init__(self, prompt: str | None):
        decoded_ = unescaped(prompt or "")
        self.plain, self.text = " ".join(unicodedata.normalize("NFC", decoded_).split()), bound(decoded_)
        self.numbers: dict[str, list[tuple[int, int]]] = {}
        for m in re.finditer(r"(?<![0-9-])-?[0-9]+(?![0-9])", self.text):
            self.numbers.setdefault(m.group(), []).append(m.span())

    def has_question(self, question) -> bool:
        plain = " ".join(unicodedata.normalize("NFC", question if isinstance(question, str) else "").split())
        return bool(plain) and (plain in self.plain or bound(question) in self.text)

    def places(self, part: str) -> list[int]:
        found, at = [], self.text.find(part)
        while at >= 0:
            found.append(at)
            at = self.text.find(part, at + 1)
        return found

    def weight_near(self, weight: int, part: str) -> bool:
        """Whether the weight stands whole within NEAR characters before or after the part, by a range search from each place of it."""
        spans = self.numbers.get(str(weight), [])
        for at in self.places(part):
            k = bisect.bisect_left(spans, (max(0, at - NEAR), 0))
            if k < len(spans) and spans[k][1] <= at:
                return True
            after = at + len(part)
            k = bisect.bisect_left(spans, (after, 0))
            if k < len(spans) and spans[k][1] <= after + NEAR:
                return True
        return False


def bound(text) -> str:
    """For matching: NFC, lower case, runs beyond [a-z0-9-] one space."""
    return re.sub("[^a-z0-9-]+", " ", unicodedata.normalize("NFC", text).lower()).strip() if isinstance(text, str) else ""


def lacking(prompt: str | None, raw: str | None) -> list[str] | None:
    """What of a candidate a prompt does not show; None where the candidate is no JSON object."""
    d = parsed(raw)
    if d is None:
        return None
    shown, out = Shown(prompt), []
    if not shown.has_question(d.get("question")):
        out.append("question")
    if bound(d.get("context"))[:HEAD] not in shown.text:
        out.append("context head")
    rubric = d.get("rubric")
    for i, item in enumerate(rubric if isinstance(rubric, list) else [], 1):
        part = bound(item.get("criterion")) if isinstance(item, dict) else ""
        part = part if part in shown.text else part[:QUOTED]
        if not part or part not in shown.text:
            out.append(f"criterion {i}")
        elif (weight := whole_number(item.get("weight"))) is None or not shown.weight_near(weight, part):
            out.append(f"weight of criterion {i}")
    return out


@arrow_udf("array<string>")
def unbound_parts(prompts: pd.Series, candidates: pd.Series) -> pd.Series:
    """What of a candidate (JSON) a verifier's prompt does not show: question, context head, criteria, weights of criteria."""
    return pd.Series([lacking(p, c) for p, c in zip(prompts, candidates)], dtype=object)


ship(__name__)
