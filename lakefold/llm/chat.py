r"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is written as `<|im_start|>role`, a line feed, the text, `<|im_end|>` and a line feed. In roles
and texts a `<`, any number of backslashes and a `|` are written with one backslash more, so no text
can hold a mark and the writing can be undone. Roles also write `%` as `%25` and line feeds as `%0A`.

Windows: a conversation's turns are ordered by (turn, role, text), nulls first. Prefix sums of their
tokens (words, and one per turn) divide it into stretches of `step` tokens. The turns wholly inside a
stretch are one window's span, opened by the turn that crosses into the stretch if it has at most an
eighth of the budget; a longer crossing turn is a span of its own. Each window begins with the
conversation's system turn, if its first turn is one, and with the up to `history` turns before its
span that hold at most a quarter of the budget; step is what is left of the budget beside them and a
crossing turn (an eighth of it at least). So a window keeps the budget unless a single turn, or the
system turn, is too long for that: turns are never cut.

The loss mask covers the texts of assistant turns of the span itself; repeated turns have none, so
each target counts once.

Null texts and roles are written as empty ones. Rows with a null conv_id form one conversation.
Repeated rows are repeated turns. Extra columns are ignored. An empty table gives no windows.
A conversation's turns are sorted and summed in one task, which spills and streams; what is gathered
into one row is a window, bounded by the budget. Only read_windows, whose digests are over whole
conversations, gathers a conversation's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 512, 2


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def tokens(text: Column) -> Column:
    """The unit of the budget: words, and one for the turn's marks."""
    return (F.regexp_count(text, F.lit(r"[^ \t\n\r\x0B\f]+")) + 1).cast("long")


def spans(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Turns with their number k, tokens n, written form, window, and the later windows that repeat them."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n", tokens(F.col("text")))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumns({"k": F.row_number().over(w) - 1, "after": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "system": F.first(F.when(F.col("role") == "system", F.col("n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    past = budget // 4
    step = F.greatest(F.lit(budget - past - budget // 8) - F.coalesce("system", F.lit(0)), F.lit(max(1, budget // 8)))
    rows = rows.withColumn("before", F.col("after") - F.col("n"))
    begin, end = F.floor(F.col("before") / step), F.floor((F.col("after") - 1) / step)
    crossing = end > begin
    # even numbers are stretches, odd ones the long turns between them
    rows = rows.withColumn("window", F.when(crossing & (F.col("n") <= budget // 8), 2 * end).otherwise(2 * begin + crossing.cast("long")))
    rows = rows.withColumn("opens", F.coalesce(F.lag("window").over(w) != F.col("window"), F.lit(True)))
    ahead = [F.when(F.lead("opens", d).over(w) & (F.lead("before", d).over(w) - F.col("before") <= past), F.lead("window", d).over(w)) for d in range(1, history + 1)]
    later = F.filter(F.array(*ahead), lambda x: x.isNotNull()) if ahead else F.array().cast("array<bigint>")
    is_system = (F.col("k") == 0) & (F.col("role") == "system")
    rows = rows.withColumn("later", F.when(is_system, F.array().cast("array<bigint>")).otherwise(later))
    role, text = escape_role(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    return rows.select("conv_id", "window", "k", "n", "later", is_system.alias("is_system"), (F.col("role") == "assistant").alias("target"), F.concat(head, text, F.lit(END + "\n")).alias("p"), F.char_length(head).cast("long").alias("head"), F.char_length(text).cast("long").alias("size"))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Rows (conv_id, window, first, n_new, n_tokens, text, masked), one per window, ordered by window.

    first is its first new turn, n_new the number of new turns, which come last, and masked the spans
    under the loss mask as (start, length) in code points of text.
    """
    rows = spans(turns, budget, history)
    cols = ["k", "n", "target", "p", "head", "size"]
    new = rows.select("conv_id", "window", *cols, F.lit(True).alias("own"))
    old = rows.select("conv_id", F.explode("later").alias("window"), *cols, F.lit(False).alias("own"))
    system = rows.where("is_system").select(F.col("conv_id").alias("c"), F.col("window").alias("sw"), *cols)
    opened = rows.select("conv_id", "window").distinct()
    first = opened.join(system, opened["conv_id"].eqNullSafe(system["c"]) & (F.col("window") != F.col("sw"))).select("conv_id", "window", *cols, F.lit(False).alias("own"))
    every = new.unionByName(old).unionByName(first)
    w = Window.partitionBy("conv_id", "window").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("start", F.sum(F.char_length("p")).over(w) - F.char_length("p") + F.col("head"))
    packed = every.groupBy("conv_id", "window").agg(
        F.min(F.when(F.col("own"), F.col("k"))).cast("long").alias("first"),
        F.count_if(F.col("own")).alias("n_new"),
        F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("k", "own", "p", "target", "start", "size"))).alias("t"),
    )
    masked = F.transform(F.filter("t", lambda x: x["own"] & x["target"]), lambda x: F.struct(x["start"].alias("start"), x["size"].alias("length")))
    return packed.select("conv_id", "window", "first", "n_new", "n_tokens", F.array_join("t.p", "").alias("text"), masked.alias("masked"))


def read_windows(windows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted texts and masks alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    parts = F.filter(F.split("text", r"<\|im_end\|>\n"), lambda x: x != "")
    new = F.slice(parts, F.size(parts) - F.col("n_new").cast("int") + 1, F.col("n_new").cast("int"))

    def turn(x: Column) -> Column:
        cut = F.instr(x, F.lit("\n"))
        role = F.substring(x, F.lit(len(START) + 1), cut - len(START) - 1)
        return F.concat(unescape_role(role), F.lit("\n"), unescape(F.substring(x, cut + 1, F.char_length(x))), F.lit("\n"))

    body = F.array_join(F.transform(new, turn), "")
    loss = F.array_join(F.transform("masked", lambda m: unescape(F.substring(F.col("text"), m["start"].cast("int") + 1, m["length"].cast("int")))), "")
    read = windows.select("conv_id", "window", "n_new", body.alias("body"), loss.alias("loss"), F.char_length("text").cast("long").alias("chars"))
    packed = read.groupBy("conv_id").agg(F.sum("n_new").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "body", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    body, loss = F.array_join("w.body", ""), F.array_join("w.loss", "")
    return packed.select("conv_id", "n_turns", F.sha2(body, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
