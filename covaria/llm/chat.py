"""Chat formatting into budgeted windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Control strings of the template.
BEGIN, END, ROLE, BODY = "<s>", "</s>", "[INST]", "[/INST]"
#: Matches each control string, with any number of escapes after its first character.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    """Put one backslash after the first character of every control string, escaped or not; unescape() takes it out."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def windows(conversations: DataFrame, budget: int = 2048, history: int = 512, overhead: int = 4) -> DataFrame:
    """Training windows of conversations: conv_id, window, text, repeated, loss (array of start and length).

    Rows of a conversation are ordered by turn, then role and text. A turn's tokens are its words, or a quarter of its UTF-8
    bytes where that is more, plus `overhead`. A leading system turn of up to half of the budget is repeated in every window,
    and what it leaves is the room: history is `history` or a quarter of the room, and the stride half of the rest. Prefix sums
    of the other turns' tokens cut the conversation into strides: a window's own turns are those that begin in its stride, so
    no turn is split and each is in one window as its own. A window repeats the last turns before it whose tokens fit into
    history. Repeated turns come first (`repeated` of them) and are masked: `loss` holds the code point spans of the window's
    own assistant texts only. Where turns are no longer than a stride, every window keeps within the budget; a longer turn is
    the last of its window, whole. A system turn of more than half of the budget is in the first window only, like any turn.

    Null role or text counts as empty, null conv_id is one conversation, null turns come first; repeated rows are
    turns of their own. Empty texts are kept. Columns beside conv_id, turn, role, text aren't read. A conversation is
    ordered in one task: its digests (summary) take it in order anyway.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    every = Window.partitionBy("conv_id")
    tokens = F.greatest(F.regexp_count("text", F.lit(r"\S+")), F.ceil(F.octet_length("text") / 4)) + overhead
    first = (F.col("n") == 1) & (F.col("role") == "system") & (F.col("tokens") * 2 <= budget)
    room = budget - F.coalesce("system", F.lit(0))
    turns = (
        rows.withColumn("n", F.row_number().over(every.orderBy("turn", "role", "text")))
        .withColumn("tokens", tokens.cast("long"))
        .withColumn("leading", first)
        .withColumn("system", F.max(F.when(F.col("leading"), F.col("tokens"))).over(every))
        .withColumn("history", F.least(F.lit(history), F.floor(room / 4)))
        .withColumn("stride", F.greatest(F.lit(1), F.floor((room - F.col("history")) / 2)))
        .withColumn("tokens", F.when(F.col("leading"), 0).otherwise(F.col("tokens")))
        .withColumn("begin", F.coalesce(F.sum("tokens").over(every.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("window", F.floor(F.col("begin") / F.col("stride")))
    )
    # the next window begins where this one's last turn ends
    turns = turns.withColumn("next", F.max(F.col("begin") + F.col("tokens")).over(Window.partitionBy("conv_id", "window")))
    turns = turns.withColumn("last", F.col("next") == F.max("next").over(every))
    again = ~F.col("last") & ~F.col("leading") & (F.col("next") - F.col("begin") <= F.col("history"))
    own = F.struct(F.col("window").alias("window"), F.lit(1).alias("own"))
    repeat = F.struct(F.floor(F.col("next") / F.col("stride")).alias("window"), F.lit(0).alias("own"))
    placed = turns.select("conv_id", "n", "role", "text", F.explode(F.when(again, F.array(own, repeat)).otherwise(F.array(own))).alias("p"))
    placed = placed.select("conv_id", F.col("p.window").alias("window"), F.col("p.own").alias("own"), "n", "role", "text")
    system = turns.where("leading").select(F.col("conv_id").alias("_c"), "role", "text")
    later = turns.where("window > 0").select("conv_id", "window").distinct()
    placed = placed.unionByName(
        later.join(system, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "window", F.lit(0).alias("own"), F.lit(1).alias("n"), "role", "text")
    )
    head = F.concat(F.lit(BEGIN + ROLE), escape(F.col("role")), F.lit(BODY))
    part = placed.select("conv_id", "window", F.struct("own", "n", F.concat(head, escape(F.col("text")), F.lit(END)).alias("said"),
                         F.char_length(head).alias("skip"), (F.col("own").cast("boolean") & (F.col("role") == "assistant")).alias("learn")).alias("part"))
    grouped = part.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    kind = "array<struct<start:int,length:int>>"
    spans = F.aggregate(
        "parts", F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("loss")),
        lambda s, p: F.struct(
            (s["at"] + F.char_length(p["said"])).alias("at"),
            F.when(p["learn"], F.concat(s["loss"], F.array(F.struct((s["at"] + p["skip"]).alias("start"), (F.char_length(p["said"]) - p["skip"] - len(END)).alias("length")))))
            .otherwise(s["loss"]).alias("loss"),
        ),
        lambda s: s["loss"],
    )
    return grouped.select(
        "conv_id", "window", F.array_join(F.transform("parts", lambda p: p["said"]), "").alias("text"),
        F.size(F.filter("parts", lambda p: p["own"] == 0)).alias("repeated"), spans.alias("loss"),
    )


def parsed(formatted: DataFrame) -> DataFrame:
    """Turns read back from windows, each once: conv_id, window, i (place in the window), role, text."""
    said = F.slice(F.split("text", F.lit(END)), F.col("repeated") + 1, F.greatest(F.size(F.split("text", F.lit(END))) - 1 - F.col("repeated"), F.lit(0)))
    rows = formatted.select("conv_id", "window", F.posexplode(said).alias("i", "said"))
    body = F.substring_index("said", BODY, 1)
    role = unescape(F.substring(body, len(BEGIN + ROLE) + 1, 1 << 30))
    return rows.select("conv_id", "window", "i", role.alias("role"), unescape(F.expr(f"substring(said, char_length(substring_index(said, '{BODY}', 1)) + {len(BODY) + 1})")).alias("text"))


def summary(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the windows: turn count, digests of turns and of text under the loss mask.

    A digest covers a whole conversation, so that conversation's text meets in one row.
    """
    spoken = parsed(formatted).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "i", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("t")))).alias("t"))
    learnt = formatted.select(
        "conv_id", "window", F.char_length("text").alias("chars"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"]))), "").alias("learnt"),
    ).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "learnt"))).alias("l"), F.sum("chars").alias("formatted_chars"))
    text = F.array_join(F.transform("l", lambda x: x["learnt"]), "")
    left, right = spoken.withColumnRenamed("conv_id", "_c"), learnt
    return right.join(left, F.col("conv_id").eqNullSafe(F.col("_c"))).select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("t", lambda x: x["t"]), ""), 256).alias("turns_sha256"),
        F.char_length(text).cast("long").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"),
    )
