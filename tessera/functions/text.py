"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V

TOKEN = r"([a-z0-9]+|[一-鿿])"
BLANKS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f\x85]"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def tokens(text: Column) -> Column:
    """Lower-cased ASCII letter and digit runs, and single CJK characters; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def strip(text: Column) -> Column:
    """Without blanks at both ends, the wide blanks of other scripts included."""
    return F.regexp_replace(text, rf"^{BLANKS}+|{BLANKS}+$", "")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a fixed word."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / F.lit(len(word))).cast("int")


def half_width(text: Column) -> Column:
    """Full-width signs and the wide blank become their half-width forms."""
    full = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    half = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
    return F.translate(text, full, half)


def arabic_numerals(text: Column) -> Column:
    """Chinese numerals from 0 to 99 become digits: a ten takes the digits next to it."""
    digits = "一二三四五六七八九"
    marked = F.regexp_replace(text, f"([{digits}])?十([{digits}])?", "\u0002$1\u0003$2\u0004")
    for a, b in (("\u0002\u0003\u0004", "10"), ("\u0002\u0003", "1"), ("\u0003\u0004", "0"), ("\u0002", ""), ("\u0003", ""), ("\u0004", "")):
        marked = F.replace(marked, F.lit(a), F.lit(b))
    return F.translate(marked, "".join(V.NUMERALS), "".join(V.NUMERALS.values()))


def comparable(text: Column) -> Column:
    """The form in which two spellings of one statement are equal."""
    out = F.regexp_replace(arabic_numerals(half_width(F.coalesce(text, F.lit("")))), BLANKS, "")
    for a, b in V.UNIT_ALIASES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.lower(out)


def says_literally(text: Column, keyword: Column) -> Column:
    """``keyword`` occurs in ``text``; one that begins with a digit isn't the tail of a longer number."""
    starts_digit = keyword.rlike(r"^[0-9]")
    quoted = F.concat(F.lit(r"(?<![0-9])\Q"), keyword, F.lit(r"\E"))
    return F.when(F.length(keyword) == 0, False).when(starts_digit, F.regexp_like(text, quoted)).otherwise(F.contains(text, keyword))


def says(text: Column, keyword: Column) -> Column:
    """Literally, or in comparable form."""
    return says_literally(text, keyword) | says_literally(comparable(text), comparable(keyword))


def answer_body(answer: Column) -> Column:
    """An answer without its section heads and without its section of relation paths."""
    paths = V.SECTIONS["paths"]
    kept = F.regexp_replace(answer, rf"{paths}(?s:.*?)(?=【[^】]{{2,8}}】|$(?!\n))", "")
    return strip(F.regexp_replace(kept, r"【[^】]{2,8}】", "\n"))


def without_question(text: Column) -> Column:
    """What follows the question mark if one stands in the first 40 characters."""
    t = strip(F.coalesce(text, F.lit("")))
    at = F.instr(t, "？")
    rest = strip(F.substring(t, at + 1, F.length(t)))
    return F.when((at > 0) & (at <= 40) & (F.length(rest) > 0), rest).otherwise(t)


def question_key(text: Column) -> Column:
    """A question without punctuation and blanks, for grouping equal ones."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\p{P}\p{S}\s]+", "")


def masked(secret: Column, head: int = 4, tail: int = 4) -> Column:
    """The ends of a secret with dots between; a short one is hidden whole."""
    return F.when(F.length(secret) > head + tail, F.concat(F.substring(secret, 1, head), F.lit("..."), F.right(secret, F.lit(tail)))).otherwise(F.lit("***"))


def int_or(text: Column, default: int, least: int | None = None) -> Column:
    """``text`` as an int, or the default where it isn't one, and not under ``least``."""
    out = F.coalesce(text.try_cast("int"), F.lit(default))
    return F.greatest(out, F.lit(least)) if least is not None else out


def intent(text: Column) -> Column:
    """The first action whose words occur, or null."""
    t = F.coalesce(text, F.lit(""))
    out = F.lit(None).cast("string")
    for name, words in reversed(V.INTENTS):
        out = F.when(contains_any(t, words), F.lit(name)).otherwise(out)
    return out


def order_id(text: Column, given: Column | None = None) -> Column:
    """The given order id, or the first one in the text, or ''."""
    found = F.regexp_extract(F.upper(F.coalesce(text, F.lit(""))), V.ORDER_ID, 1)
    return F.coalesce(F.nullif(given, F.lit("")), found) if given is not None else found


def refund_amount(text: Column) -> Column:
    """The amount a text asks for: a number with a currency, or else the first number, with
    order ids taken out first; null if there is none."""
    bare = F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), V.ORDER_ID, " ")
    named = F.regexp_extract(bare, r"(\d+(?:\.\d+)?)\s*(?:元|块钱|块|RMB)", 1)
    first = F.regexp_extract(bare, r"(\d+(?:\.\d+)?)", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(first, F.lit(""))).try_cast("double")


def ticket_priority(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    up = F.upper(t)
    named = F.when(up.contains("P0"), "P0").when(up.contains("P1"), "P1").otherwise("P2")
    return F.when(contains_any(t, V.URGENT_WORDS), "P0").when(contains_any(t, V.SERIOUS_WORDS), "P1").otherwise(named)


def order_field(text: Column) -> Column:
    return F.when(contains_any(F.coalesce(text, F.lit("")), V.DATE_WORDS), "delivery_date").otherwise("address")


def retryable(status: Column) -> Column:
    """Whether a failed call may be tried again: all but the definite 4xx answers."""
    definite = status.between(400, 499) & ~status.isin(*V.RETRYABLE_4XX)
    return ~F.coalesce(definite, F.lit(False))


def backoff(attempt: Column, base: float = 0.5, cap: float = 8.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(cap))
