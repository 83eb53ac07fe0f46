r"""Chat formatting with budgeted windows, with built-in functions only.

A turn is written as ``### role: text</turn>`` and a line end. Inside roles and texts the
characters ``\ # < :`` (the colon in roles only) become ``\b \h \l \c``, so control strings
occur nowhere but in the template, and unescaping is exact. Windows hold at most `budget`
tokens: prefix sums of the turns' token counts choose turn-aligned spans; every window
begins with the conversation's leading system turns, then repeats up to `history` tokens of
the turns before its span. Only a span's own assistant texts are targets, so each assistant
text is a target once, and repeated targets are masked. A turn that is larger than the
budget makes a window of its own, which then exceeds it; no turn is ever cut. System turns
that leave less than LEAST tokens of the budget count with it only up to there, so that they
are still in every window, which then exceeds the budget by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
#: Tokens that a window has besides the system turns at least; starts of windows held in a part.
LEAST, PART = 64, 256


def escape(c: Column, role: bool = False) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\b"))
    for plain, code in (("#", "\\h"), ("<", "\\l"), *([(":", "\\c")] if role else [])):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(c: Column) -> Column:
    out = c
    for plain, code in ((":", "\\c"), ("<", "\\l"), ("#", "\\h"), ("\\", "\\b")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def turn_tokens(text: Column) -> Column:
    """Words and single signs, and four tokens for the template."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")).cast("long") + 4


def chat_windows(df: DataFrame, budget: int = 512, history: int = 128) -> DataFrame:
    """conv_id, window_id, text, n_tokens and turns of every window.

    df has conv_id, turn, role, text; other columns are ignored. turns: an array of
    (turn, role, text, repeated, target, text_start, text_chars), where text_start and
    text_chars are code points of the escaped text inside the window; targets make the loss
    mask. Turns are ordered by (turn, role, text), nulls first; a null role or text is
    empty; rows with a null conv_id make one conversation; repeated rows are repeated turns.
    An empty table has no windows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    turns = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), turn_tokens(text).alias("n")).withColumn("end", F.sum("n").over(by))
    conv = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "n", "end"))).alias("u"))
    # Leading system turns, and the rest with prefix sums of their tokens.
    lead = F.aggregate("u", F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")), lambda a, x: F.struct((a["k"] + F.when(a["on"] & (x["role"] == "system"), 1).otherwise(0)).alias("k"), (a["on"] & (x["role"] == "system")).alias("on")), lambda a: a["k"])
    conv = conv.withColumn("k", lead).select(
        "conv_id",
        F.slice("u", F.lit(1), F.col("k")).alias("sys"),
        F.slice("u", F.col("k") + 1, F.greatest(F.size("u") - F.col("k"), F.lit(0))).alias("u"),
    )
    said = F.coalesce(F.try_element_at(F.col("sys"), F.lit(-1))["end"], F.lit(0))
    conv = conv.withColumns({"room": F.greatest(F.lit(budget) - said, F.lit(min(LEAST, budget))), "ends": F.transform("u", lambda x: x["end"] - said)})
    # A span ends before the turn whose prefix sum passes the room that history leaves. Starts
    # are gathered in parts, so that a long conversation doesn't copy all of them at every step.
    none = F.array().cast("array<int>")
    state = lambda parts, part, base, limit: F.struct(parts.alias("parts"), part.alias("part"), base.cast("long").alias("base"), limit.cast("long").alias("limit"))
    later = F.greatest(F.col("room") - history, F.lit(1))
    step = F.aggregate(
        F.sequence(F.lit(2), F.greatest(F.size("u"), F.lit(2))),
        state(F.array().cast("array<array<int>>"), F.array(F.lit(1)), F.lit(0), F.col("room")),
        lambda a, i: F.when(
            F.try_element_at(F.col("ends"), i) - a["base"] > a["limit"],
            F.when(
                F.size(a["part"]) < PART,
                state(a["parts"], F.concat(a["part"], F.array(i)), F.try_element_at(F.col("ends"), i - 1), later),
            ).otherwise(state(F.concat(a["parts"], F.array(a["part"])), F.array(i), F.try_element_at(F.col("ends"), i - 1), later)),
        ).otherwise(a),
        lambda a: F.concat(F.flatten(a["parts"]), F.coalesce(a["part"], none)),
    )
    conv = conv.withColumn("starts", F.when(F.size("u") == 0, F.array(F.lit(1))).otherwise(step))
    # Windows are cut out of the conversation before they become rows; a row holds its window only.
    one = F.lit(1)
    bounds = F.transform("starts", lambda first, w: F.struct(w.alias("w"), first.alias("first"), F.coalesce(F.try_element_at(F.col("starts"), w + 2) - 1, F.size("u")).alias("last")))
    sums = F.transform(
        "bounds",
        lambda b: F.struct(
            b["w"].alias("w"), b["first"].alias("first"), b["last"].alias("last"),
            F.coalesce(F.try_element_at(F.col("ends"), F.greatest(b["first"] - 1, one)), F.lit(0)).alias("before"),
            F.coalesce(F.try_element_at(F.col("ends"), F.greatest(b["last"], one)), F.lit(0)).alias("through"),
        ),
    )
    # Turns have four tokens or more, so so many are all that history can hold.
    most = history // 4 + 1
    spare = lambda b: F.least(F.lit(history), F.col("room") - (b["through"] - b["before"]))
    # Turn j is repeated if the tokens from j to the span fit; when all before fit, turn 1 is too.
    held = lambda b: F.size(F.filter(F.slice("ends", F.greatest(b["first"] - 1 - most, one), F.least(b["first"] - 1, F.lit(most + 1))), lambda e: (e < b["before"]) & (b["before"] - e <= spare(b))))
    back = lambda b: F.when(b["first"] == 1, 0).when(b["before"] <= spare(b), b["first"] - 1).otherwise(held(b))
    mark = lambda c, repeated, target: F.transform(c, lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text"), x["n"].alias("n"), repeated.alias("repeated"), (F.lit(target) & (x["role"] == "assistant")).alias("target")))
    cut = F.transform(
        "backs",
        lambda b: F.struct(
            b["w"].cast("long").alias("window_id"),
            F.concat(
                mark(F.col("sys"), b["w"] > 0, False),
                mark(F.slice("u", F.greatest(b["first"] - b["back"], one), b["back"]), F.lit(True), False),
                mark(F.slice("u", b["first"], F.greatest(b["last"] - b["first"] + 1, F.lit(0))), F.lit(False), True),
            ).alias("all"),
        ),
    )
    conv = conv.withColumn("bounds", bounds).withColumn("bounds", sums)
    conv = conv.withColumn("backs", F.transform("bounds", lambda b: F.struct(b["w"].alias("w"), b["first"].alias("first"), b["last"].alias("last"), back(b).cast("int").alias("back"))))
    win = conv.select("conv_id", F.explode(cut).alias("c")).select("conv_id", "c.*")
    head = lambda x: F.concat(F.lit("### "), escape(x["role"], True), F.lit(": "))
    placed = F.aggregate(
        "all",
        F.struct(F.array().cast("array<struct<turn:bigint,role:string,repeated:boolean,target:boolean,text_start:bigint,text_chars:bigint>>").alias("t"), F.lit(0).cast("long").alias("at")),
        lambda a, x: F.struct(
            F.concat(a["t"], F.array(F.struct(x["turn"].cast("long").alias("turn"), x["role"].alias("role"), x["repeated"].alias("repeated"), x["target"].alias("target"), (a["at"] + F.char_length(head(x))).alias("text_start"), F.char_length(escape(x["text"])).cast("long").alias("text_chars")))).alias("t"),
            (a["at"] + F.char_length(head(x)) + F.char_length(escape(x["text"])) + len(END)).alias("at"),
        ),
        lambda a: a["t"],
    )
    return win.select(
        "conv_id",
        "window_id",
        F.array_join(F.transform("all", lambda x: F.concat(head(x), escape(x["text"]), F.lit(END))), "").alias("text"),
        F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_tokens"),
        placed.alias("turns"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """The conversations, parsed back from the windows' texts and masks alone.

    conv_id, turns (role and text of each turn once, in order), loss (the unescaped texts
    under the loss mask, in order) and formatted_chars.
    """
    part = F.split("text", END, -1)
    parts = F.slice(part, 1, F.greatest(F.size(part) - 1, F.lit(0)))
    turn = lambda s: F.struct(unescape(F.regexp_extract(s, r"(?s)^### ([^:]*): ", 1)).alias("role"), unescape(F.regexp_replace(s, r"(?s)^### [^:]*: ", "")).alias("text"))
    fresh = F.filter(F.arrays_zip(parts.alias("s"), F.col("turns").alias("m")), lambda x: ~x["m"]["repeated"])
    loss = F.transform(F.filter("turns", lambda m: m["target"]), lambda m: unescape(F.substring(F.col("text"), (m["text_start"] + 1).cast("int"), m["text_chars"].cast("int"))))
    each = windows.select("conv_id", F.struct("window_id", F.transform(fresh, lambda x: turn(x["s"])).alias("turns"), loss.alias("loss"), F.char_length("text").cast("long").alias("chars")).alias("w"))
    conv = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    return conv.select(
        "conv_id",
        F.flatten(F.transform("w", lambda w: w["turns"])).alias("turns"),
        F.flatten(F.transform("w", lambda w: w["loss"])).alias("loss"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + w["chars"]).alias("formatted_chars"),
    )
