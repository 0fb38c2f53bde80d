"""Drawing scales from text: real inches per drawing inch.

A notation is a paper side and a real side around a sign: a number or fraction of inches, ``=``, ``:`` or ``/``, a number
and its unit mark, maybe after the word SCALE. One pattern finds all notations of a text; what each means follows from its
parts, and the surest meaning wins, then the first in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = ("anchor", "paper", "below", "sign", "real", "unit", "dash")
#: SCALE, paper number, its denominator, sign, real number, unit mark, and a dash after it; on upper-case text.
NOTATION = r"""(SCALE[:\s]*)?(\d+)(?:\s*/\s*(\d+))?\s*["']?\s*([=:/])\s*(\d+)\b\s*(['′"]?)(\s*-)?"""
FOOT_MARKS, INCH_MARKS = ("'", "′"), ('"', "'")
LARGEST = 100_000.0


def notations(text: Column) -> Column:
    """All notations of ``text`` in order: structs of the parts, texts but for the numbers, and matched."""
    up = F.upper(text)
    groups = {n: F.regexp_extract_all(up, F.lit(NOTATION), F.lit(i + 1)) for i, n in enumerate(_PARTS)}
    groups["matched"] = F.regexp_extract_all(up, F.lit(NOTATION), F.lit(0))
    number = lambda c: c.try_cast("double")
    zipped = F.arrays_zip(*[c.alias(n) for n, c in groups.items()])
    return F.transform(
        zipped,
        lambda x, i: F.struct(
            i.alias("at"), (x["anchor"] != "").alias("anchored"), number(x["paper"]).alias("paper"), number(x["below"]).alias("below"),
            x["sign"].alias("sign"), number(x["real"]).alias("real"), x["unit"].alias("unit"), (x["dash"] != "").alias("dashed"),
            x["matched"].alias("matched"),
        ),
    )


def _first(found: Column, rank, value) -> Column:
    """The ``value`` of the notation of least rank, then place, that has one."""
    ranked = F.transform(found, lambda x: F.struct(rank(x).alias("rank"), x["at"].alias("at"), value(x).alias("v")))
    return F.array_min(F.filter(ranked, lambda x: x["rank"].isNotNull() & x["v"].isNotNull()))["v"]


def scale_from_text(text: Column) -> Column:
    """Struct (scale, kind, confidence, matched) of the surest notation with a sound value; null if none.

    From the surest: SCALE 1 inch in feet, a fraction of an inch to one foot, 1 inch in feet, SCALE and a ratio.
    """

    def kind(x: Column) -> Column:
        equals, feet, whole = x["sign"] == "=", x["unit"].isin(*FOOT_MARKS), x["below"].isNull()
        return (
            F.when(equals & feet & whole & (x["paper"] == 1), F.when(x["anchored"], "feet").otherwise("bare feet"))
            .when(equals & feet & (x["real"] == 1) & ~whole, "fraction")
            .when(~equals & whole & (x["paper"] == 1) & x["anchored"], "ratio")
        )

    def value(x: Column) -> Column:
        k = kind(x)
        n = F.when(k == "fraction", F.try_divide(x["below"], x["paper"]) * 12).when(k == "ratio", x["real"]).otherwise(x["real"] * 12)
        said = F.when(k == "fraction", F.regexp_replace(x["matched"], r"^SCALE[:\s]*", "")).otherwise(x["matched"])
        said = F.trim(F.regexp_replace(said, r"\s*-$", ""))
        sure = F.when(k == "bare feet", "medium").otherwise("high")
        return F.when((n > 0) & (n <= LARGEST), F.struct(n.alias("scale"), k.alias("kind"), sure.alias("confidence"), said.alias("matched")))

    def rank(x: Column) -> Column:
        return F.nullif(F.array_position(F.array(*[F.lit(n) for n in ("feet", "fraction", "bare feet", "ratio")]), kind(x)), F.lit(0))

    return _first(notations(text), rank, value)


def scale_in_old_order(text: Column) -> Column:
    """Feet, then ratio, then inches, with or without SCALE; kept for results made that way. A fraction of an inch counts as
    the ratio that it looks like."""
    one = lambda x: x["paper"] == 1

    def rank(x: Column) -> Column:
        whole = x["below"].isNull() & one(x)
        feet = x["unit"].isin(*FOOT_MARKS) | ((x["unit"] == "") & x["dashed"])
        return (
            F.when(whole & (x["sign"] == "=") & feet, 1)
            .when((whole & (x["sign"] != "=")) | (~x["below"].isNull() & one(x)), 2)
            .when(whole & (x["sign"] == "=") & x["unit"].isin(*INCH_MARKS) & ~x["dashed"], 3)
        )

    value = lambda x: F.when(rank(x) == 1, x["real"] * 12).when(rank(x) == 2, F.coalesce(x["below"], x["real"])).otherwise(x["real"])
    return _first(notations(text), rank, value)


def scale_of_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys`` the first text line (ord, text, x0..y1) with a scale: scale, kind, confidence, matched and the line's box."""
    s = lines.withColumn("_s", scale_from_text(F.col("text"))).where("_s is not null")
    best = s.groupBy(*keys).agg(F.min_by(F.struct("ord", "_s.*", "x0", "y0", "x1", "y1"), "ord").alias("m"))
    return best.select(*keys, "m.*")
