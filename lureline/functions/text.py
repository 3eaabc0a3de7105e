"""Text features of mails as Column -> Column functions; everything stays in the JVM."""

from __future__ import annotations

import html.entities
import json
import sys
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lureline import fixed_values as V
from lureline.shared import let

# Unicode white space as a character class body; needs the (?U) flag, Java's plain \s is ASCII.
SPACE = r"\s\x1c-\x1f"
MAIL_URL = V.MAIL_URL
# A whole white-space delimited word with an @ inside. Starting at word starts and never giving
# characters back keeps the search linear on long words without an @.
MAIL_ADDRESS = rf"(?U)(^|[{SPACE}])[^{SPACE}][^{SPACE}@]*+@[^{SPACE}]+"
TEXT_URL = rf"(?U)https?://[^{SPACE}<>\"{{}}|\\^`\[\]]+"

TEXT_FEATURES = [
    "urgency_score", "authority_score", "financial_score", "action_score", "threat_score",
    "sentiment_compound", "sentiment_negative", "sentiment_positive", "exclamation_count",
    "question_count", "caps_ratio", "special_char_ratio", "misspelling_score",
]


@lru_cache(maxsize=1)
def digit_class() -> str:
    """Decimal digits plus the super-, subscript and circled digits, as a class body."""
    extra = [cp for cp in range(sys.maxunicode + 1)
             if chr(cp).isdigit() and unicodedata.category(chr(cp)) != "Nd"]
    starts = [cp for cp in extra if cp - 1 not in extra]
    ends = [cp for cp in extra if cp + 1 not in extra]
    ranges = [f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends)]
    return r"\p{Nd}" + "".join(ranges)


def strip(c: Column) -> Column:
    # most texts begin and end with a plain character, which needs no search over the whole text
    plain = c.rlike(r"(?s)\A[!-~](?:.*[!-~])?\z")
    return F.when(plain, c).otherwise(F.regexp_replace(c, rf"(?U)^[{SPACE}]+|[{SPACE}]+$", ""))


def occurrences(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    gone = F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))
    return gone if len(needle) == 1 else (gone / len(needle)).cast("int")


def matched_chars(c: Column, class_body: str) -> Column:
    """Number of characters inside a character class."""
    return F.length(F.regexp_replace(c, f"[^{class_body}]+", ""))


def digit_count(c: Column) -> Column:
    """Digits of any script; ASCII text goes first because its class test is the cheap one."""
    return matched_chars(F.regexp_replace(c, r"[\x00-/:-\x7f]+", ""), digit_class())


def contains_any(c: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in needles])


def distinct_hits(c: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(n)).cast("int") for n in needles])


@lru_cache(maxsize=1)
def _entity_tables() -> tuple[dict[str, str], str]:
    """Named character references of HTML5, and a pattern of those that need no semicolon."""
    names = html.entities.html5
    legacy = sorted((n for n in names if not n.endswith(";")), key=len, reverse=True)
    return names, "^(?:" + "|".join(legacy) + ")"


def _replaced_code_points() -> dict[int, str]:
    """Numeric references that stand for other characters: those of code page 1252, zero and carriage return."""
    out = {0: "\ufffd", 13: "\r"}
    for code in range(0x80, 0xA0):
        try:
            out[code] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:  # five places of the code page are empty
            out[code] = chr(code)
    return out


def unescape_entities(c: Column) -> Column:
    """Decode named and numeric character references.

    The text is cut at each reference and put together again with the decoded pieces, so no
    decoded character is decoded a second time.
    """
    names, legacy = _entity_tables()
    table = F.from_json(F.lit(json.dumps(names)), "map<string,string>")  # folded once
    ref = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"

    special = F.create_map(*[F.lit(x) for pair in sorted(_replaced_code_points().items()) for x in pair])

    def decode(r: Column) -> Column:
        body = F.substring(r, F.lit(2), F.length(r))
        hexadecimal = body.rlike("^#[xX]")
        digits = F.regexp_extract(body, r"^#[xX]?0*([0-9a-fA-F]*);?$", 1)  # of any length, without leading zeros
        code = F.when(F.length(digits) > 7, F.lit(0x110000)).otherwise(
            F.coalesce(F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).try_cast("int"), F.lit(0)))
        prefix = F.regexp_extract(body, legacy, 0)
        tail = F.substring(body, F.length(prefix) + 1, F.length(body))
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        dropped = (code.between(1, 8) | (code == 11) | code.between(14, 31) | code.between(127, 159)
                   | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE))
        found = F.transform(F.array(body, prefix), lambda k: F.try_element_at(table, k))
        named = F.coalesce(F.get(found, F.lit(0)), F.concat(F.get(found, F.lit(1)), tail), r)
        numeric = F.coalesce(F.try_element_at(special, code), F.when(~valid, "\ufffd").when(dropped, "")
                             .otherwise(_code_point(code)))
        return F.when(body.startswith("#"), numeric).otherwise(named)

    pieces = F.split(c, ref, -1)
    refs = F.transform(F.regexp_extract_all(c, F.lit(ref), F.lit(0)), decode)
    joined = F.zip_with(pieces, refs, lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
    return F.array_join(joined, "")


def _code_point(code: Column) -> Column:
    """Character of a code point, by its UTF-8 bytes."""
    def hex_byte(b: Column) -> Column:
        return F.lpad(F.hex(b.cast("bigint")), 2, "0")

    def tail(shift: int) -> Column:
        return hex_byte(F.lit(0x80) + F.shiftright(code, shift).bitwiseAND(0x3F))

    utf8 = (
        F.when(code < 0x80, hex_byte(code))
        .when(code < 0x800, F.concat(hex_byte(F.lit(0xC0) + F.shiftright(code, 6)), tail(0)))
        .when(code < 0x10000, F.concat(
            hex_byte(F.lit(0xE0) + F.shiftright(code, 12)), tail(6), tail(0)))
        .otherwise(F.concat(
            hex_byte(F.lit(0xF0) + F.shiftright(code, 18)), tail(12), tail(6), tail(0)))
    )
    return F.decode(F.unhex(utf8), "UTF-8")


def clean_text(c: Column) -> Column:
    """Entities, tags, links and addresses replaced, then only lower-case words and digits."""
    steps = [("<", r"<[^>]+>", " "), ("http", MAIL_URL, " URL "), ("@", MAIL_ADDRESS, "$1 EMAIL ")]
    c = F.coalesce(c, F.lit(""))
    decoded, plain = unescape_entities(c), c
    for marker, pattern, text in steps:
        decoded = F.regexp_replace(decoded, pattern, text)
        # without references a pattern can only match where its marker occurs
        plain = F.when(F.contains(c, F.lit(marker)), F.regexp_replace(plain, pattern, text)
                       ).otherwise(plain)
    t = F.when(F.contains(c, F.lit("&")), decoded).otherwise(plain)
    return F.lower(F.trim(F.regexp_replace(t, r"[^a-zA-Z0-9]+", " ")))


def words(cleaned: Column) -> Column:
    """Words of a cleaned text; none for the empty text."""
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def has_subject(c: Column) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lit("subject:")).cast("int"), F.lit(0))


def first_line(cleaned: Column) -> Column:
    return F.substring(cleaned, 1, 100)


def average_word_length(cleaned: Column) -> Column:
    """Mean word length; words of a cleaned text are separated by exactly one blank."""
    n = F.size(words(cleaned))
    letters = F.length(F.replace(cleaned, F.lit(" "), F.lit("")))
    return F.when(n > 0, letters / n).otherwise(0.0)


def keyword_score(lowered: Column, keywords: list[str]) -> Column:
    return F.least(distinct_hits(lowered, keywords) / F.lit(max(len(keywords), 1)), F.lit(1.0))


def caps_ratio(c: Column) -> Column:
    return matched_chars(c, r"\p{IsUppercase}") / F.greatest(F.length(c), F.lit(1))


def special_char_ratio(c: Column) -> Column:
    odd = F.regexp_replace(c, r"[a-zA-Z0-9 ]+", "")
    special = F.length(F.regexp_replace(odd, rf"(?U)[\p{{L}}\p{{N}}{SPACE}]+", ""))
    return special / F.greatest(F.length(c), F.lit(1))


def sensitive_words(c: Column) -> Column:
    return let({"low": F.lower(c)}, lambda v: reduce(lambda a, b: a + b, [occurrences(v["low"], t) for t in V.SENSITIVE_TERMS]))


def text_features(
    c: Column,
    sentiment: tuple[Column, Column, Column] | None = None,
    misspelled: Column | None = None,
    keywords: dict[str, list[str]] | None = None,
    lowered: Column | None = None,
) -> Column:
    """The 13 text features of the mail tagger as a struct; all 0 for empty or null text.

    ``lowered`` names a column that holds the text in lower case already; else each keyword may lower it again.

    ``sentiment`` is (compound, negative, positive) and ``misspelled`` a 0/1 column, both from
    the operators in ``lureline.operators.lexicon``; they count as 0 when left out.
    """
    lists = {
        "urgency_score": V.URGENCY_KEYWORDS, "authority_score": V.AUTHORITY_KEYWORDS,
        "financial_score": V.FINANCIAL_KEYWORDS, "action_score": V.ACTION_KEYWORDS,
        "threat_score": V.THREAT_KEYWORDS, **(keywords or {}),
    }
    t = F.coalesce(c, F.lit(""))
    low = F.lower(t) if lowered is None else F.coalesce(lowered, F.lit(""))
    compound, negative, positive = sentiment or (F.lit(0.0), F.lit(0.0), F.lit(0.0))
    values = {name: keyword_score(low, kw) for name, kw in lists.items()}
    values["sentiment_compound"] = F.coalesce(compound, F.lit(0.0))
    values["sentiment_negative"] = F.coalesce(negative, F.lit(0.0))
    values["sentiment_positive"] = F.coalesce(positive, F.lit(0.0))
    values["exclamation_count"] = occurrences(t, "!")
    values["question_count"] = occurrences(t, "?")
    values["caps_ratio"] = caps_ratio(t)
    values["special_char_ratio"] = special_char_ratio(t)
    values["misspelling_score"] = F.coalesce(
        misspelled if misspelled is not None else F.lit(0), F.lit(0))
    return F.struct(*[values[n].alias(n) for n in TEXT_FEATURES])


def urls_in_text(c: Column) -> Column:
    """All http(s) links in order of appearance, repeats kept."""
    return F.regexp_extract_all(c, F.lit(TEXT_URL), F.lit(0))


def text_vector(c: Column) -> Column:
    """48-slot vector of a mail without links: length, %, digits and sensitive words only."""
    t = F.coalesce(c, F.lit(""))
    slots = {
        3: F.least(F.length(t), F.lit(1000)),
        9: occurrences(t, "%"),
        13: digit_count(t),
        25: sensitive_words(t),
    }
    return F.array(*[slots.get(i, F.lit(0)).cast("float") for i in range(len(V.FEATURE_NAMES))])
