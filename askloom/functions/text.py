"""Text expressions: plain Columns, no Python workers. Lengths count code points; white space and letters are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that are nearly exclusive to English, and to other European languages.
ENGLISH_WORDS = "the of and to is for that with on are by this be from which we our these was were has have been it its an or can".split()
OTHER_WORDS = "de la le les des el los las en que del da das dos para um uma não une est dans pour sur und ist mit zu nicht het een il di che della".split()

SPACES = r"[\s\p{Z}\x{85}\x{1C}-\x{1F}]"  # what Python's \s matches


def one_line(s: Column) -> Column:
    """White-space runs become one space; the ends are stripped."""
    return F.trim(F.regexp_replace(s, f"{SPACES}+", " "))


def squash(s: Column) -> Column:
    return F.lower(one_line(s))


def strip(s: Column) -> Column:
    return F.regexp_replace(s, f"^{SPACES}+|{SPACES}+$", "")


def norm_title(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+", " "))


def alnum(s: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]", "")


#: A maximal run of word characters that are not all digits.
WORD = r"(?<![\p{L}\p{N}_\p{M}])\p{Nd}*+[\p{L}\p{N}_\p{M}&&[^\p{Nd}]][\p{L}\p{N}_\p{M}]*"


def words(s: Column, most: int | None = None) -> Column:
    """Word tokens of the lower-cased text (its first ``most`` characters) that are not all digits."""
    return F.regexp_extract_all(F.lower(s if most is None else F.substring(s, 1, most)), F.lit(WORD), F.lit(0))


def word_hits(tokens: Column, listed: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(*listed)))  # a set of literals


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), F.nullif(whole.cast("double"), F.lit(0.0))), F.lit(0.0))


def letters(s: Column) -> Column:
    return F.char_length(F.regexp_replace(s, r"[^\p{L}]", ""))


def ascii_letters(s: Column) -> Column:
    return F.char_length(F.regexp_replace(s, "[^A-Za-z]", ""))


def ascii_letter_share(s: Column, most: int | None = None) -> Column:
    head = s if most is None else F.substring(s, 1, most)
    return share(ascii_letters(head), letters(head))


def alpha_share(s: Column) -> Column:
    return share(letters(s), F.char_length(s))


def starts_lowercase(s: Column) -> Column:
    return s.rlike(rf"^{SPACES}*\p{{Ll}}")


def looks_non_english(english: Column, other: Column, ascii_share: Column, strict: bool = True) -> Column:
    """Other-language function words dominate; ``strict`` also flags few English ones or many letters beyond ASCII."""
    dominated = other > english
    return dominated | (english < 0.12) | (ascii_share < 0.9) if strict else dominated


def truncated(s: Column, n: int) -> Column:
    """The first n characters and a note of how many were dropped."""
    return F.when(F.char_length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n), F.format_string("\n[truncated %d chars]", F.char_length(s) - n)))


def strip_reasoning(s: Column) -> Column:
    """Without <think> blocks, also one that never closes."""
    return F.regexp_replace(s, THINK, "")


def reasoning_blocks(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(THINK), F.lit(1))


# Fixed value: a block of reasoning.
THINK = r"(?is)<think\b[^>]*>(.*?)(?:</think\s*>|\z)"


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x.cast("double") * 100)


def exact_percent(part: Column, whole: Column) -> Column:
    """part / whole of integers in percent with one decimal, half to even, without a double; null where the whole is 0 or null."""
    whole = F.nullif(whole.cast("long"), F.lit(0).cast("long"))
    scaled = part.cast("long") * 1000
    rest = F.pmod(scaled, whole)
    down = F.floor((scaled - rest) / whole).cast("long")
    up = (2 * rest > whole) | ((2 * rest == whole) & (F.pmod(down, F.lit(2)) == 1))
    tenths = down + F.when(up, 1).otherwise(0)
    sign = F.when(tenths < 0, "-").otherwise("")
    return F.concat(sign, F.floor(F.abs(tenths) / 10).cast("string"), F.lit("."), (F.abs(tenths) % 10).cast("string"), F.lit("%"))


def rate(part: Column, whole: Column) -> Column:
    """part / whole; null where the whole is 0."""
    return F.try_divide(part.cast("double"), F.nullif(whole.cast("double"), F.lit(0.0)))


def url_basename(u: Column) -> Column:
    """The last segment of a URL's path, without query or fragment."""
    return F.regexp_extract(F.regexp_replace(u, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(?:/.*?)?([^/]*)$", 1)


#: An ISO date, or date and time with or without an offset.
ISO_TIME = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.]\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"


def epoch_seconds(x: Column, is_number: Column | None = None) -> Column:
    """A number or an ISO time (UTC unless it says otherwise) as seconds; minus infinity for anything else.

    ``x`` is text; ``is_number`` tells which of it was a number where it was read. Text that merely looks like one is no time.
    """
    at = F.when(x.rlike(ISO_TIME), F.unix_micros(F.try_to_timestamp(x)) / 1e6)
    number = F.when(F.coalesce(is_number, F.lit(False)), x.try_cast("double")) if is_number is not None else F.lit(None).cast("double")
    return F.coalesce(number, at, F.lit(float("-inf")))


def safe_id(raw: Column) -> Column:
    """Letters, digits and ._- only, at most 120 characters; ``paper`` if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(raw, "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.substring(F.coalesce(F.nullif(clean, F.lit("")), F.lit("paper")), 1, 120)


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, where f uses it several times inside higher-order functions."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def word_runs(w: Column, n: int) -> Column:
    """All runs of n words of an array, joined by spaces: shifted copies zipped, so the array is not indexed word by word."""
    runs = w
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(w, k + 1, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.slice(runs, 1, F.greatest(F.size(w) - n + 1, F.lit(0)))


def distinct_ngram_ratio(s: Column, n: int = 4, least: int = 20) -> Column:
    """Distinct share of a text's word n-grams; null for fewer than ``least``."""
    share_of = lambda grams: F.when(F.size(grams) >= least, F.size(F.array_distinct(grams)) / F.size(grams))
    return let(F.filter(F.split(s, f"{SPACES}+"), lambda x: x != ""), lambda w: let(word_runs(w, n), share_of))


def attempt_seed(base: Column, question_hash: Column, role: Column, attempt: Column) -> Column:
    """A reproducible seed per attempt: 31 bits of a hash; null for a null base."""
    key = F.concat_ws("|", base.cast("string"), question_hash, role, attempt.cast("string"))
    seed = F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(2147483647))
    return F.when(base.isNotNull(), seed)


def fingerprint(s: Column, n: int = 16) -> Column:
    return F.substring(F.sha1(s), 1, n)


def lower_effort(s: Column) -> Column:
    """The next lower effort; anything unknown counts as the highest."""
    low = F.lower(F.coalesce(s, F.lit("max")))
    return F.when(low.isin("high", "low"), "low").otherwise("high")


def retryable(status: Column, transport_error: Column) -> Column:
    """Whether a failed model request is worth another try."""
    return F.coalesce(transport_error, F.lit(False)) | F.coalesce(status.isin(408, 409, 429) | (status >= 500), F.lit(False))


def message_chars(content: Column, reasoning: Column, tool_arguments: Column) -> Column:
    """Characters of a message: content, reasoning (once if both are equal) and tool arguments."""
    n = lambda c: F.coalesce(F.char_length(c), F.lit(0))
    return n(content) + F.when(content.eqNullSafe(reasoning), 0).otherwise(n(reasoning)) + n(tool_arguments)


def backoff(attempt: Column, jitter: Column, cap: float = 60.0) -> Column:
    """Seconds to wait after failed try ``attempt`` of a model request: powers of two and a jitter in [0, 1), at most ``cap``."""
    return F.least(F.lit(cap), F.pow(F.lit(2.0), F.least(attempt, F.lit(6))) + jitter)


# The seconds between tries of the metadata service, the share of jitter, and the longest wait it may ask for.
SCHEDULE, JITTER, LONGEST = [5.0, 10.0, 20.0, 40.0, 80.0, 160.0], 0.2, 160.0


def service_delay(attempt: Column, jitter: Column, retry_after: Column) -> Column:
    """Seconds to wait after failed try ``attempt`` (from 1) of the metadata service; what it asks for counts if it is longer."""
    base = F.element_at(F.array(*map(F.lit, SCHEDULE)), F.least(attempt, F.lit(len(SCHEDULE))).cast("int"))
    asked = F.when(F.trim(retry_after).rlike(r"^([0-9]+[.]?[0-9]*|[.][0-9]+)$"), F.trim(retry_after).try_cast("double"))
    return F.greatest(base + jitter * JITTER * base, F.when(asked.isNotNull(), F.least(asked, F.lit(LONGEST))))


def evaluator_deadline(mode: Column, solver_timeout: Column, solver_retries: Column, judge_timeout: Column, judge_retries: Column, spare: float = 300.0) -> Column:
    """Seconds an evaluation may take: every try of solver and judge, for each of its stages, and something to spare."""
    stage = solver_timeout * (solver_retries + 1) + judge_timeout * (judge_retries + 1)
    return stage * F.when(mode == "both", 2).otherwise(1) + spare


def error_text(kind: Column, status: Column) -> Column:
    """What a report may say of a failed request: never the answer's body or an address."""
    request = F.concat(F.lit("API request failed ("), F.when(status.isNotNull(), F.concat(F.lit("HTTP "), status.cast("string"))).otherwise(kind), F.lit(")"))
    return F.when(status.isNotNull() | kind.isin("APIConnectionError", "APITimeoutError"), request).otherwise(F.concat(F.lit("invalid API response ("), kind, F.lit(")")))
