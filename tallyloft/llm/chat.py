"""Chat formatting into budgeted windows, in DataFrame operations only.

A conversation's turns are laid end to end by the prefix sums of their tokens, and cut at turns into
windows. A turn of over a quarter of the budget is a window of its own and cuts the sum; between such turns, a
turn belongs to the window in whose stride of the sum it starts. Each window repeats the system turn (the first
turn, if its role is system and it takes at most half of the budget), then as many turns before the window as fit
the ``history`` budget, then its own turns. The loss mask covers the texts of its own assistant turns only, so
what is repeated is never a target twice. The stride is what ``budget`` leaves beside the system turn, the history
and the longest turn that is not a window of its own, and at least a quarter of the budget: a window keeps the
budget unless a single turn or system turn is too long, and no conversation falls apart into a window a turn.

Sums are taken in stretches of turn numbers, then over the stretches, so no task holds the sum of a long
conversation; texts move to their stretch (once for its sums, once beside them) and once to the windows that show them.

Control strings inside texts are escaped by a backslash after their first character; if backslashes
already stand there, by one more. That is undone exactly. In roles, backslashes and line ends are
escaped too. Null texts and roles are empty. Turns of one number are ordered by role, then text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of common chat templates, each without its first character.
CONTROL = r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)"
TURNS_PER_BUCKET = 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, r"$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # Cut at doubled backslashes first, so that none of them is read as the start of a line end.
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def tokens(text: Column, per_token: int = 4, template: int = 5) -> Column:
    """An estimate of a turn's tokens: its characters by ``per_token``, rounded up, and the template's."""
    return F.ceil(F.char_length(text) / per_token).cast("long") + template


def windows(conversations: DataFrame, budget: int = 2048, history: int = 256) -> DataFrame:
    """Formatted windows of conversations (conv_id, turn, role, text): a row for each window.

    Returns conv_id, window (the place of its first own turn in the conversation, from 0), formatted, n_context
    (turns at its start that are repeated), n_turns (its own), tokens, over_budget and loss_spans (start and end,
    in code points of ``formatted``). An empty table gives none; other columns are not read; rows of a null conv_id
    are one conversation; repeated rows are turns; turns of a null number come first. ``history`` is at most a
    quarter of ``budget``.
    """
    large, half, history = budget // 4, budget // 2, min(history, budget // 4)
    key = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("c", key).withColumn("stretch", F.coalesce(F.floor(F.col("turn") / TURNS_PER_BUCKET), F.lit(-(1 << 62))))
    rows = rows.withColumn("length", tokens(F.col("text"))).withColumn("large", F.col("length") > large)
    inside = Window.partitionBy("c", "stretch").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before, after = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(1, Window.unboundedFollowing)
    small = F.when(~F.col("large"), F.col("length"))
    rows = rows.withColumns(
        {
            "in_n": F.row_number().over(inside) - 1,
            "in_sum": F.coalesce(F.sum("length").over(before), F.lit(0)),
            "in_small": F.coalesce(F.sum(small).over(before), F.lit(0)),
            "in_large": F.coalesce(F.sum(F.col("large").cast("long")).over(before), F.lit(0)),
            "last_length": F.lag("length").over(inside),
            "last_large": F.lag("large").over(inside),
        }
    )
    rows = rows.withColumn("in_next", F.first(F.when(F.col("large"), F.col("in_sum")), ignorenulls=True).over(after))

    # A row for each stretch, with what the stretches before and after it add.
    opening = F.col("in_n") == 0
    stretches = rows.groupBy("c", "stretch").agg(
        F.count("*").alias("n"),
        F.sum("length").alias("sum"),
        F.coalesce(F.sum(small), F.lit(0)).alias("small"),
        F.sum(F.col("large").cast("long")).alias("larges"),
        F.min(F.when(F.col("large"), F.col("in_sum"))).alias("first_large"),
        F.max(small).alias("longest"),
        F.max(F.when(opening, F.struct("role", "length", "large", F.when((F.col("role") == "system") & (F.col("length") <= half), F.col("text")).alias("text")))).alias("head"),
    )
    upto = Window.partitionBy("c").orderBy("stretch")
    past, rest = upto.rowsBetween(Window.unboundedPreceding, -1), upto.rowsBetween(1, Window.unboundedFollowing)
    stretches = stretches.withColumns({f"base_{k}": F.coalesce(F.sum(k).over(past), F.lit(0)) for k in ("n", "sum", "small", "larges")})
    stretches = stretches.withColumns(
        {
            "next_large": F.min(F.col("base_sum") + F.col("first_large")).over(rest),
            "longest": F.coalesce(F.max("longest").over(Window.partitionBy("c")), F.lit(0)),
            "head": F.first("head").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        }
    )
    system = F.when(F.col("head.role") == "system", F.col("head.length"))
    repeated = F.when(system <= half, system).otherwise(0)
    stretches = stretches.select(
        "c",
        "stretch",
        *(f"base_{k}" for k in ("n", "sum", "small", "larges")),
        "next_large",
        system.alias("system"),
        F.coalesce(F.col("head.large") & system.isNotNull(), F.lit(False)).alias("system_large"),
        repeated.alias("repeated"),
        F.col("head.text").alias("system_text"),
        F.greatest(F.lit(large), budget - history - repeated - F.least("longest", F.lit(large))).alias("stride"),
    )
    rows = rows.join(stretches, ["c", "stretch"])
    # The system turn takes no part in the sums.
    rows = rows.withColumn("number", (F.col("base_n") + F.col("in_n")).cast("long")).withColumn("leads", (F.col("number") == 0) & F.col("system").isNotNull())
    off = F.when(F.col("number") > 0, F.coalesce("system", F.lit(0))).otherwise(0)
    rows = rows.withColumns(
        {
            "before": F.col("base_sum") + F.col("in_sum") - off,
            "small_before": F.col("base_small") + F.col("in_small") - F.when(F.col("system_large"), 0).otherwise(off),
            "larges": F.col("base_larges") + F.col("in_large") - F.when(F.col("system_large") & (F.col("number") > 0), 1).otherwise(0),
            "next": F.coalesce(F.col("base_sum") + F.col("in_next"), "next_large") - F.coalesce("system", F.lit(0)),
            "alone": F.col("large") & ~F.col("leads"),
        }
    )
    step = lambda at: F.floor(at / F.col("stride")).cast("long")
    rows = rows.withColumn("stride_no", F.when(F.col("alone"), 0).otherwise(step(F.col("small_before"))))
    opens = opening | F.col("alone") | F.col("last_large") | (F.col("stride_no") != step(F.col("small_before") - F.col("last_length")))
    at = lambda alone, number, own: F.struct("larges", alone.alias("alone"), number.cast("long").alias("stride_no"), F.lit(own).alias("own"))
    serves = (F.col("length") <= history) & ~F.col("leads")
    shows = F.array_compact(
        F.array(
            at(F.col("alone"), F.col("stride_no"), True),
            F.when(serves & ((F.col("stride_no") + 1) * F.col("stride") - F.col("small_before") <= history), at(F.lit(False), F.col("stride_no") + 1, False)),
            F.when(serves & (F.col("next") - F.col("before") <= history), at(F.lit(True), F.lit(0), False)),
        )
    )
    role = escape_role(F.col("role"))
    piece = F.concat(F.lit(START), role, F.lit("\n"), escape(F.col("text")), F.lit(f"{END}\n"))
    length = F.when(F.col("leads"), 0).otherwise(F.col("length"))
    turn = F.struct("number", "before", length.alias("length"), piece.alias("piece"), (F.col("role") == "assistant").alias("target"), (F.char_length(role) + len(START) + 1).alias("head"))
    dealt = rows.select("c", "conv_id", turn.alias("t"), F.col("system").alias("system_tokens"), "repeated", F.when(opens, F.col("system_text")).alias("system_text"), F.explode(shows).alias("w"))
    own = F.col("w.own")
    grouped = dealt.groupBy("c", "w.larges", "w.alone", "w.stride_no").agg(
        F.first("conv_id").alias("conv_id"),
        F.array_sort(F.collect_list(F.when(own, F.col("t")))).alias("own"),
        F.array_sort(F.collect_list(F.when(~own, F.col("t")))).alias("past"),
        F.max(F.when(own, F.col("system_text"))).alias("system_text"),
        F.max("repeated").alias("repeated"),
        F.max("system_tokens").alias("system_tokens"),
    )
    grouped = grouped.filter(F.size("own") > 0).withColumn("window", F.col("own")[0]["number"]).withColumn("opens", F.col("own")[0]["before"])
    grouped = grouped.withColumn("past", F.filter("past", lambda t: F.col("opens") - t["before"] <= history))
    repeats = (F.col("window") > 0) & F.col("system_text").isNotNull()
    lead = F.when(repeats, F.array(F.concat(F.lit(f"{START}system\n"), escape(F.col("system_text")), F.lit(f"{END}\n")))).otherwise(F.array().cast("array<string>"))
    grouped = grouped.withColumn("context", F.concat(lead, F.transform("past", lambda t: t["piece"])))
    formatted = F.array_join(F.concat("context", F.transform("own", lambda t: t["piece"])), "")
    grouped = grouped.withColumn("formatted", formatted).withColumn("skip", F.char_length(F.array_join("context", "")))
    spans = F.aggregate(
        "own",
        F.struct(F.col("skip").cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.char_length(t["piece"])).cast("int").alias("at"),
            F.when(t["target"], F.concat(a["spans"], F.array(F.struct((a["at"] + t["head"]).cast("int").alias("start"), (a["at"] + F.char_length(t["piece"]) - (len(END) + 1)).cast("int").alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    shown = F.when(F.col("window") > 0, F.col("repeated")).otherwise(F.coalesce("system_tokens", F.lit(0)))
    total = shown + F.aggregate(F.concat("past", "own"), F.lit(0).cast("long"), lambda a, t: a + t["length"])
    return grouped.select(
        "conv_id",
        "window",
        "formatted",
        F.size("context").alias("n_context"),
        F.size("own").alias("n_turns"),
        total.alias("tokens"),
        (total > budget).alias("over_budget"),
        spans.alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Of each window: conv_id, window, its own ``turns`` (role, text), unescaped, and the unescaped texts under its mask."""
    parts = F.split("formatted", r"<\|im_end\|>\n")
    own = F.expr("slice(parts, n_context + 1, n_turns)")
    body = F.transform(own, lambda p: F.substr(p, F.lit(len(START) + 1)))
    role = lambda p: F.substring_index(p, "\n", 1)
    turns = F.transform(body, lambda p: F.struct(unescape_role(role(p)).alias("role"), unescape(F.substr(p, F.char_length(role(p)) + 2)).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumn("parts", parts).select("conv_id", "window", "formatted", turns.alias("turns"), loss.alias("loss"))


def digests(formatted: DataFrame) -> DataFrame:
    """Of each conversation, read back from its windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    back = read_back(formatted).select(
        "conv_id",
        F.struct(
            "window",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join("loss", "").alias("loss"),
        ).alias("part"),
        F.size("turns").alias("n"),
        F.char_length("formatted").alias("chars"),
    )
    whole = back.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.col("parts.loss"), "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join(F.col("parts.turns"), ""), 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
