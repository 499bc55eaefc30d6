"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens choose spans of whole turns. Each window holds the
conversation's system turn, a limited history repeated from before the span,
and the span's own turns; the loss mask covers the texts of the span's
assistant turns, so every assistant text is a target exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
SLICE_TURNS = 256     # turn numbers numbered together by one window group
BLOCK_TURNS = 4096    # turns whose spans one row chooses
NULL_KEY = "\x00null"


def escape(text: Column) -> Column:
    """One backslash more in every ``<|``, ``<\\|``, ...: no control string is left, and it can be undone."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    """Percent signs, line breaks and ``<`` of a role as percent codes."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def default_tokens(role: Column, text: Column) -> Column:
    """Estimated tokens of a formatted turn: four UTF-8 bytes each, and four for the template."""
    return F.ceil(F.octet_length(F.concat(role, text)) / 4).cast("long") + 4


def numbered_turns(df: DataFrame, tokens: Column | None = None) -> DataFrame:
    """conv, conv_id, role, text, tokens, i (place from 0), p (tokens before).

    Places and prefix sums are taken inside slices of turn numbers and offset
    by the totals of the slices before, so a conversation of any length is
    spread over many tasks.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(NULL_KEY)).alias("conv"), "conv_id",
        F.coalesce(F.floor(F.col("turn") / SLICE_TURNS), F.lit(-(1 << 62))).alias("slice"), "turn",
        role.alias("role"), text.alias("text"),
        (default_tokens(role, text) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))).alias("tokens"))
    inside = Window.partitionBy("conv", "slice").orderBy("turn", "role", "text").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"at": F.row_number().over(inside.orderBy("turn", "role", "text")) - 1,
                             "upto": F.sum("tokens").over(inside) - F.col("tokens")})
    before = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(NULL_KEY)).alias("conv"),
        F.coalesce(F.floor(F.col("turn") / SLICE_TURNS), F.lit(-(1 << 62))).alias("slice"),
        (default_tokens(role, text) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))).alias("tokens"))
    totals = totals.groupBy("conv", "slice").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).select(
        "conv", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    return rows.join(totals, ["conv", "slice"]).select(
        "conv", "conv_id", "role", "text", "tokens", (F.col("n0") + F.col("at")).alias("i"),
        (F.col("t0") + F.col("upto")).alias("p"))


def spans(turns: DataFrame, budget: int, history_tokens: int) -> DataFrame:
    """conv, conv_id, system (1 if the first turn is one), first, last, p_first of every span.

    A span takes turns while its tokens, the system turn's and the history
    allowance fit the budget, at least one turn each. Spans are chosen from
    prefix sums over blocks of ``BLOCK_TURNS`` turns; a block starts a span.
    """
    heads = turns.where("i = 0").select(
        "conv", (F.col("role") == "system").cast("long").alias("system"),
        F.when(F.col("role") == "system", F.col("tokens")).otherwise(F.lit(0)).alias("system_tokens"))
    blocks = turns.groupBy("conv", "conv_id", F.floor(F.col("i") / BLOCK_TURNS).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("i", "p", "tokens"))).alias("t")).join(heads, "conv")
    room = F.greatest(F.lit(budget) - history_tokens - F.col("system_tokens"), F.lit(1))
    own = F.filter(F.col("t"), lambda x: x["i"] >= F.col("system"))
    none = F.expr("cast(array() as array<struct<i:bigint,p:bigint>>)")
    state = F.struct(F.lit(0).cast("long").alias("base"), none.alias("starts"))

    def place(s, x):
        new = (F.size(s["starts"]) == 0) | (x["p"] + x["tokens"] - s["base"] > room)
        return F.when(new, F.struct(
            x["p"].alias("base"),
            F.concat(s["starts"], F.array(F.struct(x["i"].alias("i"), x["p"].alias("p")))).alias("starts"))).otherwise(s)

    last = F.element_at("t", -1)["i"]
    starts = blocks.select("conv", "conv_id", "system", last.alias("end"), F.aggregate(own, state, place)["starts"].alias("s"))
    # A conversation of nothing but a system turn is one span without turns.
    alone = F.array(F.struct(F.col("system").alias("i"), F.lit(0).cast("long").alias("p")))
    starts = starts.withColumn("s", F.when(F.size("s") == 0, alone).otherwise(F.col("s")))
    each = F.transform("s", lambda x, k: F.struct(
        x["i"].alias("first"), F.coalesce(F.get(F.col("s"), k + 1)["i"] - 1, F.col("end")).alias("last"), x["p"].alias("p_first")))
    return starts.select("conv", "conv_id", "system", F.inline(each))


def format_windows(df: DataFrame, budget: int = 2048, history_tokens: int = 512, history_turns: int = 8,
                   tokens: Column | None = None) -> DataFrame:
    """One row per window: conv_id, first (place of the span's first turn,
    which identifies the window), n_repeated, n_turns, n_tokens, over_budget,
    formatted, loss_spans.

    ``df`` has conv_id, turn, role, text; rows are ordered by turn (ties by
    role and text). ``formatted`` is the template text, its first
    ``n_repeated`` turns are the system turn and the history, ``loss_spans``
    are code point ranges of the span's assistant texts. A turn larger than
    the budget is a window of its own, whole, marked ``over_budget``.

    Nulls: null role and text are empty, a null turn comes first, a null
    conv_id is one conversation. Repeated rows are turns of their own. An
    empty table gives no rows. Other columns are not read.
    """
    turns = numbered_turns(df, tokens)
    refs = spans(turns, budget, history_tokens).withColumn("ref", F.concat(
        F.when((F.col("system") == 1) & (F.col("first") <= F.col("last")),
               F.array(F.struct(F.lit(0).cast("long").alias("i"), F.when(F.col("first") > 1, 0).otherwise(2).alias("kind"))))
        .when(F.col("system") == 1, F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(2).alias("kind"))))
        .otherwise(F.expr("cast(array() as array<struct<i:bigint,kind:int>>)")),
        F.transform(F.expr(f"if(greatest(system, first - {history_turns}) < first, "
                           f"sequence(greatest(system, first - {history_turns}), first - 1), cast(array() as array<bigint>))"),
                    lambda i: F.struct(i.alias("i"), F.lit(1).alias("kind"))),
        F.transform(F.expr("if(first <= last, sequence(first, last), cast(array() as array<bigint>))"),
                    lambda i: F.struct(i.alias("i"), F.lit(2).alias("kind")))))
    refs = refs.select("conv", "conv_id", "first", "p_first", F.inline("ref"))
    parts = refs.join(turns.drop("conv_id"), ["conv", "i"]) \
        .where((F.col("kind") != 1) | (F.col("p_first") - F.col("p") <= history_tokens))
    windows = parts.groupBy("conv", "conv_id", "first").agg(
        F.array_sort(F.collect_list(F.struct("i", "kind", "role", "text", "tokens"))).alias("t"))
    head = lambda x: F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n"))
    shown = F.transform("t", lambda x: F.struct(
        head(x).alias("head"), escape(x["text"]).alias("body"), ((x["kind"] == 2) & (x["role"] == "assistant")).alias("loss")))
    windows = windows.withColumn("shown", shown)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("s"))

    def mark(s, x):
        a = s["at"] + F.length(x["head"])
        b = a + F.length(x["body"])
        return F.struct((b + len(END) + 1).alias("at"), F.when(x["loss"], F.concat(
            s["s"], F.array(F.struct(a.alias("start"), b.alias("end"))))).otherwise(s["s"]).alias("s"))

    n_tokens = F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x["tokens"])
    return windows.select(
        "conv_id", "first", F.size(F.filter("t", lambda x: x["kind"] != 2)).alias("n_repeated"),
        F.size("t").alias("n_turns"), n_tokens.alias("n_tokens"), (n_tokens > budget).alias("over_budget"),
        F.array_join(F.transform("shown", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "").alias("formatted"),
        F.aggregate("shown", start, mark)["s"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) of a formatted window, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(
        unescape_role(F.substring_index(F.substr(x, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(x, F.instr(x, F.lit("\n")) + 1)).alias("text")))


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """Texts under the loss mask, unescaped, joined with nothing between."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(
        F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from the windows: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    A digest over a whole conversation needs its text in one row; nothing
    else in this module does.
    """
    own = F.expr("slice(turns, n_repeated + 1, greatest(size(turns) - n_repeated, 0))")
    rows = windows.withColumn("turns", read_turns(F.col("formatted"))).select(
        "conv_id", "first", own.alias("own"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("long").alias("chars"))
    rows = rows.select("conv_id", "first", F.size("own").cast("long").alias("n"), F.array_join(F.transform(
        "own", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("said"), "loss", "chars")
    whole = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("first", "said", "loss"))).alias("w"), F.sum("n").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x["said"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows")
