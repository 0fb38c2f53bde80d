"""Chat formatting in budgeted windows.

A turn is written as ``<s>role[INST]text[/INST]</s>``. These four control strings are escaped inside roles and texts by a
backslash after their first character, and a backslash by another one, so that every text can be read back.

Prefix sums of the turns' tokens put turns into windows. With S new tokens to a window, a turn that starts at p and ends
at q belongs to cell floor(p/S); those that end within the cell share one window, the one that runs over its end has the
next to itself. So a window holds at most S new tokens, but for a single turn that is longer. Each window repeats the
conversation's system turn and as many whole turns before its first new one as fit the history. The loss mask covers the
texts of new assistant turns only: each assistant text is a target once, repeated ones never.

Windows follow from sums alone, without a loop over turns, and the sums are taken in two steps, so that one very long
conversation is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetlens.llm.common import materialize, safe_join

BUDGET, HISTORY, CHUNK_TURNS = 1024, 192, 128
OPEN, TEXT, END_TEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"(<|\[)(?=/?(?:s>|INST\]))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _tokens(body: Column) -> Column:
    return F.ceil(F.octet_length(body) / 4).cast("long")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """Windows of ``turns`` (conv_id, turn, role, text): conv_id, window, n_repeated, tokens, formatted, loss_spans.

    ``n_repeated`` leading turns of ``formatted`` repeat what earlier windows introduce; ``loss_spans`` are [start, end)
    in code points. Tokens are estimated as a quarter of the UTF-8 bytes with the template. The system turn is the first
    turn of a conversation if its role is system; later ones are turns like others. New turns get the budget less history
    and system turn, a quarter of the budget at least.

    Turns are ordered by turn (a number), role and text, null turns first; null roles and texts are empty; a null conv_id is
    a conversation of its own; repeated rows are turns of their own; more columns are ignored; an empty table gives an empty
    result.
    """
    history = min(history, budget // 4)
    t = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.floor(F.col("turn") / chunk_turns).alias("chunk"),
    )
    t = t.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(TEXT))).withColumn("esc", escape(F.col("text")))
    t = t.withColumn("body", F.concat("head", "esc", F.lit(END_TEXT + CLOSE))).withColumn("tok", _tokens(F.col("body")))
    order = ["turn", "role", "text"]
    within = Window.partitionBy("conv_id", "chunk").orderBy(*order)
    t = t.withColumn("p_in", F.sum("tok").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tok"))
    t = t.withColumn("n_in", F.row_number().over(within) - 1)
    t = materialize(
        t.select(
            "conv_id", "chunk", "p_in", "n_in", "tok", "body", (F.col("role") == "system").alias("system"),
            (F.col("role") == "assistant").alias("target"), F.length("head").alias("head_chars"),
            F.length("esc").alias("text_chars"), F.length("body").alias("chars"),
        )
    )
    chunks = t.groupBy("conv_id", "chunk").agg(F.sum("tok").alias("tok"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(
        "conv_id",
        "chunk",
        F.coalesce(F.sum("tok").over(before), F.lit(0)).alias("p0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
    )
    chunks = materialize(chunks)
    joined = safe_join(t, chunks, ["conv_id", "chunk"]).select(
        "conv_id", (F.col("p0") + F.col("p_in")).alias("p"), (F.col("n0") + F.col("n_in")).alias("n"), "tok", "body",
        "system", "target", "head_chars", "text_chars", "chars",
    )
    joined = materialize(joined.withColumn("system", F.col("system") & (F.col("n") == 0)))
    heads = materialize(joined.where("system").select("conv_id", F.col("tok").alias("sys_tok"), F.col("body").alias("sys_body"), F.col("chars").alias("sys_chars")))
    sizes = heads.select("conv_id", "sys_tok")
    rows = safe_join(joined, sizes, ["conv_id"], "left")
    room = F.greatest(F.lit(budget - history) - F.coalesce("sys_tok", F.lit(0)), F.lit(budget // 4))
    rows = rows.withColumn("room", room).withColumn("p", F.greatest(F.col("p") - F.coalesce("sys_tok", F.lit(0)), F.lit(0)))
    cell = F.floor(F.col("p") / F.col("room"))
    last = F.floor((F.col("p") + F.greatest("tok", F.lit(1)) - 1) / F.col("room"))
    over = (last > cell) & (F.col("p") > cell * F.col("room")) & ~F.col("system")
    rows = materialize(rows.withColumn("cell", cell).withColumn("window", 2 * cell + over.cast("long")).drop("sys_tok"))
    started = rows.groupBy("conv_id", "window").agg(F.min("p").alias("start"), F.first("room").alias("room"))
    started = materialize(started.withColumn("cell", F.floor(F.col("window") / 2)))
    # A turn is history of the windows that start after it, at most ``history`` tokens from its own start.
    lo, hi = F.col("cell"), F.floor((F.col("p") + history) / F.col("room"))
    past = rows.where("not system").select("conv_id", "p", "n", "body", "chars", F.explode(F.sequence(lo, hi)).alias("cell"))
    to = started.select("conv_id", "window", "start", "cell")
    past = safe_join(past, to, ["conv_id", "cell"]).where((F.col("p") < F.col("start")) & (F.col("start") <= F.col("p") + history))
    item = lambda kind, n, new, target, head, text, chars, body: F.struct(
        F.lit(kind).alias("kind"), n.cast("long").alias("n"), F.lit(new).alias("new"), target.alias("target"),
        head.cast("int").alias("head"), text.cast("int").alias("text"), chars.cast("int").alias("chars"), body.alias("body"),
    )
    zero, no = F.lit(0), F.lit(False)
    new = rows.select(
        "conv_id", "window", item(2, F.col("n"), True, F.col("target"), F.col("head_chars"), F.col("text_chars"), F.col("chars"), F.col("body")).alias("i")
    )
    seen = past.select("conv_id", "window", item(1, F.col("n"), False, no, zero, zero, F.col("chars"), F.col("body")).alias("i"))
    later = started.where("window > 0")
    fixed = safe_join(later, heads, ["conv_id"]).select(
        "conv_id", "window", item(0, zero, False, no, zero, zero, F.col("sys_chars"), F.col("sys_body")).alias("i")
    )
    # A window's turns are bounded by the budget, so they are put together in one row.
    met = new.unionByName(seen).unionByName(fixed).groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("i")).alias("i"))
    spans = F.aggregate(
        "i",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["chars"]).alias("at"),
            F.when(
                x["new"] & x["target"],
                F.array_append(
                    acc["spans"],
                    F.struct((acc["at"] + x["head"]).alias("start"), (acc["at"] + x["head"] + x["text"]).alias("end")),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    formatted = F.array_join(F.transform("i", lambda x: x["body"]), "")
    return met.select(
        "conv_id",
        "window",
        F.size(F.filter("i", lambda x: ~x["new"])).alias("n_repeated"),
        _tokens(formatted).alias("tokens"),
        formatted.alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per row of ``windows``: conv_id, window, turns (role and text of the new ones), loss_text, formatted_chars. Null texts and
    roles were written as empty and come back as that; repeated turns come back as often; no rows give none."""
    raw = F.split("formatted", r"</s>")
    raw = F.slice(raw, F.col("n_repeated") + 1, F.size(raw) - 1 - F.col("n_repeated"))

    def turn(s: Column) -> Column:
        inner = F.substr(s, F.lit(len(OPEN) + 1), F.length(s) - len(OPEN) - len(END_TEXT))
        at = F.locate(TEXT, inner)
        return F.struct(
            unescape(F.substr(inner, F.lit(1), at - 1)).alias("role"), unescape(F.substr(inner, at + len(TEXT))).alias("text")
        )

    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select(
        "conv_id",
        "window",
        F.transform(raw, turn).alias("turns"),
        F.array_join(loss, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from ``windows``: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest is over all text of a conversation, so here, and only here, a conversation's text meets in one row. A null conv_id
    is a conversation like any other; one without assistant turns has the digest of the empty text; no rows give none.
    """
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read_back(formatted).select(
        "conv_id", F.struct("window", said.alias("said"), "loss_text").alias("w"), F.size("turns").alias("n"), "formatted_chars"
    )
    met = parts.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list("w")).alias("w"), F.sum("formatted_chars").alias("formatted_chars")
    )
    loss = F.array_join(F.transform("w", lambda x: x["loss_text"]), "")
    return met.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("w", lambda x: x["said"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
