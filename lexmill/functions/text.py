"""Text expressions: normalization, counts, quality flags, shingles. All of it runs in the JVM but for NFC."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space beyond ASCII, and all white space, as regex classes that Java and RE2 both read.
WIDE_SPACE = r"\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}" + WIDE_SPACE
# The patterns of normalization and of the quality flags.
CONTROL = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}]"
MARKUP = r"<[A-Za-z/][^>]{0,200}>"
URL = r"(?i)https?://|www\."
MOJIBAKE = r"(?:[РС][А-Яа-я]|[ДЖГЙ][™±јњ])"
LETTERLIKE = r"[\p{L}\p{Nl}\p{No}]"
WORD = LETTERLIKE + "+(?:-" + LETTERLIKE + "+)*"
FLAGS = (
    "unicode_replacement", "null_byte", "control_character", "unusual_whitespace", "html_xml_like_markup",
    "url_heavy", "repeated_character", "high_line_break_density", "extremely_long", "mojibake_signature",
)
LONG, WIDTH = 100_000, 5


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


# declared so that no filter on what follows is moved below it, which would normalize every text twice
nfc = nfc.asNondeterministic()


def normalized(text: Column) -> dict[str, Column]:
    """Steps of normalization by name, each on the one before: n1 NFC, n2 line feeds, n3 no controls, n4 single spaces and
    stripped lines, n5 at most one blank line, text without outer space. Null is taken as empty. Chain them with withColumn."""
    # a pattern runs only where what it looks for is there, which a search for a plain string tells sooner, and matches only what changes
    after = lambda name, pattern, to, *there: F.when(reduce(or_, there), F.regexp_replace(name, pattern, to)).otherwise(F.col(name))
    has = lambda name, s: F.col(name).contains(s)
    blank = rf"\x{{9}}\x{{20}}{WIDE_SPACE}"
    edges = [F.col("n4a").startswith(" "), F.col("n4a").endswith(" "), has("n4a", "\n "), has("n4a", " \n")]
    return {
        "n1": F.coalesce(nfc(text), F.lit("")),
        "n2": after("n1", r"\r\n?", "\n", has("n1", "\r")),
        "n3": F.regexp_replace("n2", CONTROL, ""),
        "n4a": F.regexp_replace("n3", rf"[\x{{9}}{WIDE_SPACE}][{blank}]*|\x{{20}}[{blank}]+", " "),  # not a single space, which stays
        "n4": after("n4a", r"(?dm)^ +| +$", "", *edges),
        "n5": after("n4", "\n{3,}", "\n\n", has("n4", "\n\n\n")),
        "clean": F.btrim("n5", F.lit(" \n")),  # no other white space is left
    }


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))


def word_count(text: Column) -> Column:
    """Runs of anything but white space: one more than the single spaces that compacting leaves. (Counting the runs' matches would make a string of each.)"""
    words = compact(text)
    return F.when(words == "", 0).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1)


def quality_flags(text: Column) -> Column:
    """The names of the flags that hold, in the order of FLAGS."""
    n = F.greatest(F.length(text), F.lit(1))
    urls = F.regexp_count(text, F.lit(URL))
    holds = (
        text.contains("�"),
        text.contains("\0"),
        text.rlike(CONTROL),
        text.rlike(rf"[\x{{b}}\x{{c}}\x{{1c}}-\x{{1f}}\x{{85}}{WIDE_SPACE}]"),
        text.rlike(MARKUP),
        (urls > 0) & (urls * 30 > n),
        text.rlike(rf"(?iu)({LETTERLIKE})\1{{5,}}"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))) / n > 0.05,
        F.length(text) >= LONG,
        text.rlike(MOJIBAKE),
    )
    return F.array_compact(F.array(*[F.when(h, name) for name, h in zip(FLAGS, holds)]))


def compact(text: Column) -> Column:
    """Words joined by single spaces."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def shingles(text: Column, width: int = WIDTH) -> Column:
    """The distinct strings of ``width`` characters of the compacted text; a shorter text is its own one, an empty one has none."""
    c = compact(text)
    # the search goes on by one UTF-16 unit, so starts inside a surrogate pair are left out
    many = F.array_distinct(F.regexp_extract_all(c, F.lit(rf"(?s)(?=([^\x{{dc00}}-\x{{dfff}}].{{{width - 1}}}))"), F.lit(1)))
    return F.when(c == "", F.array().cast("array<string>")).when(F.length(c) <= width, F.array(c)).otherwise(many)


def one_line(text: Column) -> Column:
    """Line breaks of all kinds as spaces, none for one at the end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?:\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}])\z", ""), r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]", " ")


def excerpt(text: Column) -> Column:
    return F.replace(F.substring(text, 1, 240), F.lit("\n"), F.lit(" "))


def latin_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]", ""))


def source_key(c: Column) -> Column:
    """A source in one spelling: no outer blanks, lower case, hyphens."""
    return F.regexp_replace(F.lower(F.trim(c)), "[ _]", "-")
