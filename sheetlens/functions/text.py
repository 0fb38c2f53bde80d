"""Column expressions on words and indicators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"[^\p{L}\p{N}_]"
#: The characters that count as white space at either end of a text.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """``c`` without white space at either end: not spaces only, but tabs, line breaks and the rest too."""
    return F.btrim(c, F.lit(WHITE))


def alnum_lower(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^0-9a-zA-Z]", ""))


def confusable(c: Column) -> Column:
    """Without spaces, letters that readers of images confuse with digits as these digits, lower case."""
    return F.lower(F.translate(F.regexp_replace(c, r"\s+", ""), "OoIlBS", "001185"))


def plain_spaces(c: Column) -> Column:
    return F.lower(stripped(F.regexp_replace(c, r"[-\s]+", " ")))


def upper_no_signs(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", ""))


def keyword_pattern(keyword: str) -> str:
    """The whole word or phrase with an optional s, es or ing, in lower-case text; same meaning in Java and RE2."""
    return rf"(^|{_EDGE})" + re.sub(r"([^\w\s])", r"\\\1", keyword.lower()) + rf"(?:s|es|ing)?($|{_EDGE})"


def has_keyword(text: Column, keyword: str) -> Column:
    return F.lower(text).rlike(keyword_pattern(keyword))


def dotted(c: Column) -> Column:
    """Each dotted part that starts with a digit without its leading zeros, one digit at least."""
    part = lambda p: F.when(
        p.rlike("^[0-9]"), F.when(p.rlike("^0+$"), F.lit("0")).otherwise(F.regexp_replace(p, "^0+", ""))
    ).otherwise(p)
    return F.array_join(F.transform(F.split(c, r"\."), part), ".")


def bare(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"^[()\[\] ]+|[()\[\] ]+$", "")


def letters(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda x: x != ""))


def similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.8 if one holds the other, else the Jaccard index of their letters."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    union = F.size(F.array_union(letters(x), letters(y)))
    jaccard = F.size(F.array_intersect(letters(x), letters(y))) / F.greatest(union, F.lit(1))
    return (
        F.when((x == "") | (y == ""), 0.0)
        .when(x == y, 1.0)
        .when(F.contains(x, y) | F.contains(y, x), 0.8)
        .otherwise(jaccard)
    )


def letter_similarity(a: Column, b: Column) -> Column:
    """Common letters over the larger letter set."""
    most = F.greatest(F.size(letters(a)), F.size(letters(b)), F.lit(1))
    return F.size(F.array_intersect(letters(a), letters(b))) / most


def spellings(keyword: Column) -> Column:
    """The ways to write a phrase, as an array in order: with spaces or hyphens between its words; of several words also with
    the last one in the other number (with or without an s); of two words also as one word. Case doesn't count."""
    base = F.lower(stripped(F.coalesce(keyword, F.lit(""))))
    words = F.filter(F.split(base, r"\s+"), lambda w: w != "")
    last = F.element_at(words, -1)
    turned = F.when(F.endswith(last, F.lit("s")), F.left(last, F.length(last) - 1)).otherwise(F.concat(last, F.lit("s")))
    turned = F.concat_ws(" ", F.slice(words, F.lit(1), F.size(words) - 1), turned)
    hyphened = lambda c: F.replace(c, F.lit(" "), F.lit("-"))
    one, two = F.array(base, F.replace(base, F.lit("-"), F.lit(" ")), hyphened(base)), F.array(turned, hyphened(turned))
    several = F.when(F.size(words) >= 2, two).otherwise(F.array().cast("array<string>"))
    joined = F.when(F.size(words) == 2, F.array(F.array_join(words, ""))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(one, several, joined), lambda k: k != "")))


#: How codes in a legend begin, and the highest number behind.
CODE_STARTS, CODE_NUMBERS = ("f", "fn", "fe"), 19


def code_spellings(starts: tuple[str, ...] = CODE_STARTS, most: int = CODE_NUMBERS) -> Column:
    """Codes of a legend, each written with a hyphen, with nothing and with a space between letters and number."""
    def numbered(start: str) -> Column:
        gaps = lambda n: F.array(*[F.concat(F.lit(start + gap), n.cast("string")) for gap in ("-", "", " ")])
        return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), gaps))

    return F.concat(*[numbered(s) for s in starts])


def snippet(text: Column, keyword: str, around: int = 50) -> Column:
    """``around`` characters on both sides of the first occurrence; null if there is none."""
    at = F.instr(F.lower(text), keyword.lower())
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substr(text, start, at - start + F.lit(len(keyword) + around)))
