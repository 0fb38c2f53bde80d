"""Page text: lines, keywords, which pages matter, which need reading as images, model input and noisy model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetlens.functions import text as t

PAGE = ("doc_id", "page_idx")
MIN_NATIVE_CHARS, CONFIDENT = 50, 0.5


def text_lines(pages: DataFrame, source: str) -> DataFrame:
    """The lines of plain text that aren't blank, as they are, with an empty box."""
    p = pages.select(*PAGE, F.posexplode(F.split("text", "\n")).alias("ord", "raw"))
    zero = F.lit(0.0)
    return p.select(
        *PAGE, "ord", F.col("raw").alias("text"), zero.alias("x0"), zero.alias("y0"), zero.alias("x1"), zero.alias("y1"), F.lit(source).alias("source")
    ).where(t.stripped(F.col("text")) != "")


def keyword_lines(lines: DataFrame, keywords: list[str]) -> DataFrame:
    """Lines with each keyword that they hold as a whole word, s, es or ing allowed. One pass over the text: keywords are
    few and become constant patterns."""
    hits = F.array_compact(F.array(*[F.when(t.has_keyword(F.col("text"), k), F.lit(k)) for k in keywords]))
    return lines.withColumn("keyword", F.explode(hits))


def keyword_forms(keywords: DataFrame, codes: bool = False) -> DataFrame:
    """``keywords`` (keyword) with each of their spellings: keyword, form; with ``codes`` also the codes of a legend, which are
    their own keywords."""
    out = keywords.select("keyword", F.explode(t.spellings(F.col("keyword"))).alias("form"))
    if codes:
        own = keywords.sparkSession.range(1).select(F.explode(t.code_spellings()).alias("form"))
        out = out.unionByName(own.select(F.col("form").alias("keyword"), "form"))
    return out.distinct()


#: Endings that a keyword's last word may have beside its own.
ENDINGS = ("s", "es", "ing")


def _with_runs(lines: DataFrame, most: int) -> DataFrame:
    """``lines`` with _runs: all runs of one to ``most`` words of the text, in lower case, with what stands between the words,
    and each run without an ending of ENDINGS too. Arrays that lambdas look into are columns of their own."""
    word = r"[\p{L}\p{N}_]+"
    none = F.array().cast("array<string>")
    df = lines.withColumn("_low", F.lower(F.coalesce("text", F.lit(""))))
    df = df.withColumns({"_words": F.regexp_extract_all("_low", F.lit(f"({word})"), F.lit(1)), "_gaps": F.split("_low", word)})

    def runs(n: int) -> Column:
        one = lambda i: F.concat(F.get("_words", i), *[x for k in range(1, n) for x in (F.get("_gaps", i + k), F.get("_words", i + k))])
        count = F.size("_words") - (n - 1)
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(none)

    df = df.withColumn("_every", F.concat(*[runs(n) for n in range(1, most + 1)]))
    bare = lambda end: F.transform(F.filter("_every", lambda r: F.endswith(r, F.lit(end))), lambda r: F.left(r, F.length(r) - len(end)))
    return df.withColumn("_runs", F.array_distinct(F.concat("_every", *[bare(e) for e in ENDINGS]))).drop("_low", "_words", "_gaps", "_every")


def dictionary_hits(lines: DataFrame, forms: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Lines with each keyword of ``forms`` (keyword, form) that they hold in one of its forms as whole words, s, es or ing
    allowed: the columns of ``lines``, or those to ``keep``, and keyword, each pair once. Every hit carries these columns, so a
    line's text is best left out where it isn't needed.

    A line's runs of words meet the forms by equality, so a keyword more costs no further pass. Runs have as many words as
    the longest form, which begins and ends with a letter, digit or underscore; the few forms with other signs at an end
    are looked for as patterns.
    """
    edge = r"^[\p{L}\p{N}_](.*[\p{L}\p{N}_])?$"
    low = forms.select("keyword", F.lower("form").alias("_form")).where("_form <> ''").distinct()
    most = low.where(F.col("_form").rlike(edge)).agg(F.max(F.size(F.regexp_extract_all("_form", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))))).first()[0] or 1
    names = lines.columns if keep is None else keep
    # The outer form: for the other, Spark would put a filter on the arrays below all that makes them, and make them there.
    met = _with_runs(lines, most).select(*names, F.explode_outer("_runs").alias("_form")).join(low, "_form").select(*names, "keyword")
    odd = [r for r in low.where(~F.col("_form").rlike(edge)).select("keyword", "_form").collect()]  # forms with signs at an end
    for r in odd:
        met = met.unionByName(lines.where(t.has_keyword(F.col("text"), r["_form"])).select(*names, F.lit(r["keyword"]).alias("keyword")))
    return met.distinct()


def page_text(lines: DataFrame) -> DataFrame:
    """A page's lines in order, joined by one space, so that phrases may span lines."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"])
    return lines.groupBy(*PAGE).agg(F.array_join(ordered, " ").alias("text"))


def page_keywords(lines: DataFrame, keywords: list[str]) -> DataFrame:
    """Per page with text: has_keywords, keywords (in the given order), text_length."""
    hits = F.array_compact(F.array(*[F.when(t.has_keyword(F.col("text"), k), F.lit(k)) for k in keywords]))
    out = page_text(lines).withColumn("keywords", hits)
    return out.select(*PAGE, (F.size("keywords") > 0).alias("has_keywords"), "keywords", F.length("text").alias("text_length"))


def decide(pages: DataFrame, scores: DataFrame, high: list[str], policy: str = "cascade") -> DataFrame:
    """Relevance per page from its keywords and an external score (is_relevant, confidence; may be missing).

    ``cascade``: no keyword, no; a telling keyword, yes; a confident score decides; else yes by keyword.
    ``any_keyword``: any keyword, yes; else the score; else no.
    """
    s = scores.groupBy(*PAGE).agg(F.max(F.struct("confidence", "is_relevant")).alias("s"))
    j = pages.join(s, list(PAGE), "left")
    none, telling = F.size("keywords") == 0, F.arrays_overlap("keywords", F.lit(list(high)))
    sure, answer = F.coalesce(F.col("s.confidence") >= CONFIDENT, F.lit(False)), F.coalesce("s.is_relevant", F.lit(False))
    if policy == "cascade":
        yes = F.when(none, False).when(telling, True).when(sure, answer).otherwise(True)
        how = F.when(none, "no_keywords").when(telling, "high_signal").when(sure, "score").otherwise("keyword_only")
    elif policy == "any_keyword":
        yes = F.when(~none, True).otherwise(answer)
        how = F.when(~none, "keyword").when(F.col("s").isNotNull(), "score").otherwise("none")
    else:
        raise ValueError(f"no policy {policy!r}")
    return j.select(*PAGE, yes.alias("relevant"), how.alias("method"), F.size("keywords").alias("keyword_count"))


#: What an earlier rule took for too little text, and for too much image.
FEW_MATCHES, FEW_TOKENS, IMAGE_SHARE = 5, 40, 0.05


def needs_reading(pages: DataFrame, policy: str = "short_text") -> DataFrame:
    """Pages to read as images: fewer than 50 native characters (``short_text``), every page (``all``), or by an earlier
    rule (``sparse``) few keyword matches, few tokens or much image (columns matches, tokens, image_share; a missing share
    is none)."""
    if policy == "all":
        return pages
    if policy == "sparse":
        image = F.coalesce("image_share", F.lit(0.0)) >= IMAGE_SHARE
        return pages.where((F.col("matches") < FEW_MATCHES) | (F.col("tokens") < FEW_TOKENS) | image)
    if policy != "short_text":
        raise ValueError(f"no policy {policy!r}")
    return pages.where(F.length(t.stripped(F.coalesce("text", F.lit("")))) < MIN_NATIVE_CHARS)


def merged_text(native: DataFrame, read: DataFrame) -> DataFrame:
    """Native text and, where there is some, the text read from the image, joined by a line break and without white space
    around the whole. A page without read text keeps its native text as it is."""
    j = native.join(read.select(*PAGE, F.col("text").alias("_r")), list(PAGE), "left")
    both = F.when(F.coalesce("_r", F.lit("")) != "", t.stripped(F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), "_r"))).otherwise(F.col("text"))
    return j.withColumn("text", both).drop("_r")


def health(pages: DataFrame) -> DataFrame:
    """``pages`` (page_idx, width, height, contents) with ok and reason. ``contents`` tells whether the page has any, null
    counts as none; a scanned page has contents but no text, and is healthy. Null sizes count as none."""
    reason = (
        F.when(F.col("page_idx") < 0, "page index out of range")
        .when((F.coalesce("width", F.lit(0.0)) <= 0) | (F.coalesce("height", F.lit(0.0)) <= 0), "no size")
        .when(~F.coalesce("contents", F.lit(False)), "no contents")
    )
    return pages.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def split_broken(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    return pages.where("ok"), pages.where("not ok").withColumn("reason", F.coalesce("reason", F.lit("extraction failed")))


def first_keyword(tokens: DataFrame, keywords: list[str]) -> DataFrame:
    """Tokens that hold a keyword, with the first one."""
    low = F.lower("text")
    first = F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in keywords])
    return tokens.withColumn("keyword", first).where("keyword is not null")


def keyword_mentions(chunks: DataFrame, keywords: list[str]) -> DataFrame:
    """Chunks (id and more, text) with each keyword that their text holds, a chunk and keyword once."""
    low = F.lower("text")
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k.lower())), F.lit(k)) for k in dict.fromkeys(keywords)]))
    return chunks.withColumn("keyword", F.explode(hits)).dropDuplicates(["id", "keyword"])


def keyword_first(lines: DataFrame, keywords: list[str], others: int = 50) -> DataFrame:
    """Of each page all lines with a keyword and the first ``others`` without."""
    has = F.lower("text").rlike("|".join(t.keyword_pattern(k) for k in keywords))
    rank = F.row_number().over(Window.partitionBy(*PAGE, "has_kw").orderBy("ord"))
    return lines.withColumn("has_kw", has).withColumn("rank", rank).where(F.col("has_kw") | (F.col("rank") <= others)).drop("rank")


def model_batches(pages: DataFrame, chars: int = 1200, keywords: int = 8, per_batch: int = 10) -> DataFrame:
    """Excerpts of pages for a model: per document batches of ``per_batch`` pages in order."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_idx"))
    return pages.select(
        *PAGE, F.floor((rank - 1) / per_batch).alias("batch"), F.substring("text", 1, chars).alias("excerpt"), F.slice("keywords", 1, keywords).alias("keywords")
    )


def chunk_batches(chunks: DataFrame, chars: int = 4000, per_batch: int = 6) -> DataFrame:
    """Layout chunks (page, chunk_ord, chunk_text) for a model: per page batches of ``per_batch`` chunks with a text, in order,
    each text cut: page, chunk_ord, batch, excerpt."""
    told = chunks.where(t.stripped(F.coalesce("chunk_text", F.lit(""))) != "")
    rank = F.row_number().over(Window.partitionBy("page").orderBy("chunk_ord"))
    return told.select("page", "chunk_ord", F.floor((rank - 1) / per_batch).alias("batch"), F.substring("chunk_text", 1, chars).alias("excerpt"))


def spec_corpus(pages: DataFrame, per_page: int = 6000, total: int = 20000) -> DataFrame:
    """Per document the pages' texts in order, each cut, together cut."""
    item = F.collect_list(F.struct("page_idx", F.substring("text", 1, per_page).alias("t")))
    joined = F.array_join(F.transform(F.array_sort(item), lambda s: s["t"]), "\n")
    return pages.groupBy("doc_id").agg(F.substring(joined, 1, total).alias("corpus"))


def model_rows(responses: DataFrame, schema: str, inside: str = "results") -> DataFrame:
    """Rows with a non-empty id in a model's noisy answer: the columns of ``schema``.

    The answer's JSON is its outermost object, whose field ``inside`` holds the rows, or else its outermost array; whichever
    begins first. Text around it is ignored; answers without sound JSON give no rows.
    """
    rest = [c for c in responses.columns if c != "response"]
    a, o = F.instr("response", "["), F.instr("response", "{")
    array = (a > 0) & ((o == 0) | (a < o))
    raw = F.when(array, F.regexp_extract("response", r"(?s)\[.*\]", 0)).otherwise(F.regexp_extract("response", r"(?s)\{.*\}", 0))
    rows = F.when(array, F.from_json(raw, f"array<struct<{schema}>>")).otherwise(F.from_json(raw, f"struct<`{inside}`:array<struct<{schema}>>>")[inside])
    out = responses.select(*rest, F.explode(rows).alias("r")).select(*rest, "r.*")
    return out.where(F.coalesce(F.trim(F.col("id").cast("string")), F.lit("")) != "")


def model_object(responses: DataFrame, schema: str) -> DataFrame:
    """The outermost JSON object in a model's noisy answer: the columns of ``schema``, null without sound JSON."""
    rest = [c for c in responses.columns if c != "response"]
    raw = F.regexp_extract("response", r"(?s)\{.*\}", 0)
    return responses.select(*rest, F.from_json(raw, schema).alias("r")).select(*rest, "r.*")


def fill_missing(requested: DataFrame, answers: DataFrame, key: str, column: str, default: Column) -> DataFrame:
    return requested.join(answers, key, "left").withColumn(column, F.coalesce(column, default))


def page_counts(decided: DataFrame, broken: DataFrame) -> DataFrame:
    """Per document: relevant, other and broken pages."""
    a = decided.groupBy("doc_id").agg(F.count_if("relevant").alias("relevant"), F.count_if(~F.col("relevant")).alias("other"))
    b = broken.groupBy("doc_id").agg(F.count("*").alias("broken"))
    return a.join(b, "doc_id", "full").na.fill(0)


def agreement(repeats: DataFrame) -> DataFrame:
    """Per page over repeated runs (text, vote): runs, different texts, different votes, whether all agree."""
    out = repeats.groupBy(*PAGE).agg(
        F.count("*").alias("runs"), F.countDistinct(F.sha2("text", 256)).alias("texts"), F.countDistinct("vote").alias("votes")
    )
    return out.withColumn("agree", (F.col("texts") == 1) & (F.col("votes") == 1))


def snippets(pages: DataFrame, keywords: list[str]) -> DataFrame:
    found = F.coalesce(*[t.snippet(F.col("text"), k) for k in keywords])
    return pages.select(*PAGE, found.alias("snippet")).where("snippet is not null")
