"""Deterministic views of the given tables in the shape of drawing data, so that every operator runs over whole tables.

Each view has the same definition as SQL in ``fixtures_sql``. Coordinates are whole numbers where lengths are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: keyword, whether it alone decides a page, order.
KEYWORDS = (("license", True), ("with", False), ("for", False), ("was", False), ("that", False), ("fence", True))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _d(c):
    return c.cast("double")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.floor(F.col("doc_id") / 8).alias("doc_id"),
        (F.col("doc_id") % 8).cast("int").alias("page_idx"),
        F.col("doc_id").alias("page_key"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(612.0).alias("width"),
        F.lit(792.0).alias("height"),
        (90 * (F.col("doc_id") % 4)).cast("int").alias("rotation"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select("doc_id", "page_idx", F.posexplode(F.split("text", "\n")).alias("ord", "raw"))
    t = p.withColumn("text", F.trim("raw")).where("text <> ''")
    return t.select(
        "doc_id", "page_idx", F.col("ord").cast("long").alias("ord"), "text",
        F.lit(36.0).alias("x0"), _d(36 + 12 * F.col("ord")).alias("y0"),
        _d(36 + 5 * F.length("text")).alias("x1"), _d(46 + 12 * F.col("ord")).alias("y1"),
        F.lit("pdf_native").alias("source"),
    )


def keywords(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(h).alias("high"), F.lit(i).alias("kw_ord")) for i, (k, h) in enumerate(KEYWORDS)])
    return spark.range(1).select(F.explode(rows).alias("k")).select("k.*")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "labels")
    return s.select(
        F.floor(F.col("doc_id") / 8).alias("doc_id"), (F.col("doc_id") % 8).cast("int").alias("page_idx"),
        (F.col("quality") == 1).alias("is_relevant"), (0.3 + 0.4 * F.col("toxic")).cast("double").alias("confidence"),
    )


#: How a usual row's columns share two numbers: name, number, lowest bit, bits, units per one.
_FIELDS = (
    ("l_extendedprice", "_a", 30, 27, 100), ("l_discount", "_a", 23, 7, 100), ("l_tax", "_a", 16, 7, 100), ("l_shipdate", "_a", 0, 16, 1),
    ("l_linenumber", "_b", 22, 4, 1), ("l_quantity", "_b", 14, 8, 1), ("l_returnflag", "_b", 7, 7, 1), ("l_linestatus", "_b", 0, 7, 1),
)


def by_supplier(li: DataFrame) -> DataFrame:
    """``li`` as it is, dealt out by supplier. The columns beside the keys travel as two numbers where these give back the very
    same values (one letter, whole days, whole hundredths), else as they are: half the bytes."""
    kinds, names = dict(li.dtypes), [f[0] for f in _FIELDS]
    keys = [c for c in li.columns if c not in names]
    packed, same = {"_a": F.lit(0).cast("long"), "_b": F.lit(0).cast("long")}, F.lit(True)
    for name, into, low, bits, units in _FIELDS:
        c = F.col(name)
        if kinds[name] == "string":
            n = F.when(F.length(c) == 1, F.ascii(c))
        elif kinds[name].startswith(("timestamp", "date")):
            n = F.date_diff(F.to_date(c), F.lit("1970-01-01").cast("date"))
        else:
            n = F.when(c.between(0, 2**bits // units), F.round(c * units))
        n = F.when(n.between(0, 2**bits - 1), n.cast("long"))
        same = same & (_unpacked(n, kinds[name], units) == c)
        packed[into] = packed[into] + F.shiftleft(n, low)
    same = F.coalesce(same, F.lit(False))
    dealt = li.select(*keys, *[F.when(same, c).alias(n) for n, c in packed.items()], F.when(~same, F.struct(*names)).alias("_odd"))
    dealt = dealt.repartition("l_suppkey")
    back = {n: F.coalesce(F.col("_odd")[n], _unpacked(F.shiftright(F.col(i), low).bitwiseAND(F.lit(2**bits - 1).cast("long")), kinds[n], u)) for n, i, low, bits, u in _FIELDS}
    return dealt.select(*keys, *[c.alias(n) for n, c in back.items()]).select(*li.columns)


def _unpacked(n: Column, kind: str, units: int) -> Column:
    if kind == "string":
        return F.chr(n)
    if kind.startswith(("timestamp", "date")):
        return F.date_add(F.lit("1970-01-01").cast("date"), n.cast("int")).cast(kind)
    return (n / units if units > 1 else n).cast(kind)


def vlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = by_supplier(read(spark, sf_dir, "lineitem"))
    order = [F.col(c) for c in li.columns]
    ord_ = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order)) - 1
    x0, y0 = F.col("l_partkey") % 612, F.col("l_orderkey") % 792
    odd = F.col("l_linenumber") % 2 == 1
    four = 4 * F.col("l_quantity")
    return li.select(
        F.col("l_suppkey").alias("page"), ord_.cast("long").alias("line_idx"), _d(x0).alias("x0"), _d(y0).alias("y0"),
        F.when(odd, x0 + four).otherwise(_d(x0)).alias("x1"), F.when(odd, _d(y0)).otherwise(y0 + four).alias("y1"),
        _d(four).alias("length_pts"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("layer"),
    )


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "supplier").count()
    k = F.col("c_custkey")
    x, y = _d(37 * k % 592), _d(53 * k % 782)
    return read(spark, sf_dir, "customer").select(
        (k % n).alias("page"), k.alias("inst_ord"), F.concat(F.lit("F-"), F.col("c_nationkey").cast("string")).alias("indicator"),
        x.alias("ix0"), y.alias("iy0"), (x + 20).alias("ix1"), (y + 10).alias("iy1"),
    )


def legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(
        F.concat(F.lit("F-"), k.cast("string")).alias("indicator"), F.col("n_name").alias("keyword"), k.cast("long").alias("leg_ord")
    )


def page_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's own legend: the indicators on it, whose meaning differs from page to page."""
    own = instances(spark, sf_dir).select("page", "indicator").distinct()
    k = F.substring("indicator", 3, F.lit(9)).cast("long")
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), F.col("n_name").alias("keyword"))
    own = own.select("page", "indicator", k.alias("leg_ord"), ((k + F.col("page")) % 25).alias("nation"))
    return own.join(n, "nation").select("page", "indicator", "keyword", "leg_ord")


def named_vlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vlines`` on layers of which some are named after a nation, whether or not it's in the page's legend."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), F.col("n_name").alias("name"))
    v = vlines(spark, sf_dir).withColumn("nation", (F.col("length_pts") / 4 + F.col("page")).cast("long") % 60)
    v = v.join(n, "nation", "left").withColumn("layer", F.concat_ws(" ", "layer", F.replace("name", F.lit("_"), F.lit(""))))
    return v.select("page", "line_idx", "x0", "y0", "x1", "y1", "length_pts", "layer")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legend(spark, sf_dir).select(F.concat_ws(": ", "indicator", "keyword").alias("category"), "leg_ord")


def layer_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's own layer names to its categories: exact ones, parts of layer names, and names that hold them; every
    seventh page has no map."""
    c = page_legend(spark, sf_dir).where("page % 7 <> 0")
    k = F.col("leg_ord") % 5
    name = F.when(k == 0, "A-F").when(k == 1, "N").when(k == 2, "the R-F layer").when(k == 3, "N-O").otherwise("none of them")
    return c.select("page", name.alias("map_layer"), F.concat_ws(": ", "indicator", "keyword").alias("category"), F.col("leg_ord").alias("map_ord"))


def telling_vlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vlines`` with words in some layers' names, none on every third page."""
    word = F.when(F.col("layer") == "A-F", "C-FENCE-").when((F.col("layer") == "R-F") & (F.col("page") % 2 == 0), "x-Wall-").otherwise("")
    return vlines(spark, sf_dir).withColumn("layer", F.concat(F.when(F.col("page") % 3 == 0, "").otherwise(word), F.col("layer")))


def scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        k.alias("page"), F.floor(k / 8).alias("document"), F.when(k % 5 != 0, _d(120 * (1 + k % 4))).alias("verified_scale")
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q"))
    x, y = _d(306 * (F.col("q") % 2)), _d(396 * F.floor(F.col("q") / 2))
    return s.select(
        "page", F.col("q").cast("long").alias("chunk_ord"), F.when(F.col("q") % 2 == 0, "figure").otherwise("text").alias("chunk_type"),
        F.when(((F.col("page") + F.col("q")) % 4) == 0, "LEGEND of symbols").otherwise("plan view").alias("chunk_text"),
        x.alias("cx0"), y.alias("cy0"), (x + 306).alias("cx1"), (y + 396).alias("cy1"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instances(spark, sf_dir).select(
        "page", F.col("inst_ord").alias("gold_id"), F.col("ix0").alias("gx0"), F.col("iy0").alias("gy0"), F.col("ix1").alias("gx1"), F.col("iy1").alias("gy1")
    )


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = instances(spark, sf_dir).where(F.col("inst_ord") % 11 != 0)
    dx, dy = F.col("inst_ord") % 7, F.col("inst_ord") % 5
    return i.select(
        "page", F.col("inst_ord").alias("pred_id"), (F.col("ix0") + dx).alias("px0"), (F.col("iy0") + dy).alias("py0"), (F.col("ix1") + dx).alias("px1"), (F.col("iy1") + dy).alias("py1")
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"), F.floor(F.col("o_orderkey") / 3).alias("document"),
        F.when(s == "F", "completed").when(s == "O", "queued").otherwise("running").alias("status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("trade"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, e = F.col("event_id") % 3, F.col("event_id")
    return read(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("event_type").alias("label"), F.col("value").alias("wall_s"), F.col("user_id").alias("session"),
        F.when(k == 0, "timed").when(k == 1, "checkpoint").otherwise("event").alias("kind"),
        _d(e % 97).alias("cpu_s"), F.when(e % 5 != 0, _d(e % 89 - 40)).alias("rss_delta_mb"), _d(1000 + e % 7001).alias("peak_rss_mb"),
        F.when(e % 4 != 0, _d(500 + e % 6500)).alias("rss_mb"),
    )


def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", F.col("event_type").alias("provider"), (F.col("event_id") % 1000).alias("tokens_in"), F.col("value").alias("cost_usd"),
        F.when(F.col("event_id") % 6 != 0, F.col("event_id") * 7 % 500).alias("tokens_out"),
    )


def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select(
        F.floor(F.col("doc_id") / 8).alias("document"), (F.col("doc_id") % 8).cast("int").alias("page_idx"),
        (F.col("quality") == 1).alias("is_gt"), (F.col("toxic") == 1).alias("is_pred"),
    )
