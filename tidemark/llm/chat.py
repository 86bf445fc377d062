"""Chat formatting into budgeted windows (DataFrame functions only).

Prefix sums of turn tokens, without the conversation's system turn, lay its turns on a line that
is cut into cells of ``budget`` tokens. The turns that start in a cell are one span if they
fit the budget; else the last, which reaches past the cell's end, is a span of its own (so
only one turn longer than the budget passes it). A window is the conversation's system turn, up
to ``history`` tokens of the turns before its span, and the span. Repeated turns carry no
loss, so over all windows each assistant text is a target exactly once.

Work is linear in the turns and no conversation is one task's: sums go by (conversation, block
of TURNS turn numbers) first, a window over those few rows gives each block its offset, and
every turn is sent to its own cell and to the one or two next ones whose history it may be, the system turn to all: texts are shuffled twice, by block and by cell. A cell's turns are few, as each has TURN_TOKENS at least.

Template: ``<|role|>`` newline text, then the end mark and a newline. Control strings inside texts and
roles, the template's and the common public ones, become U+241B and a digit, and back; the end
mark is ``<|`` U+241B ``|>``, in which no digit follows, so no role or text can spell it.

Defined results: a null text or role is empty; null turns come first; equal turn numbers
are ordered by role, then text; repeated rows are repeated turns; a null conversation id is
a conversation of its own; an empty table gives no window; long texts are one turn each, whole.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import word_count

MARK = "␛"
#: Control strings of this template and of common public ones.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
END = f"<|{MARK}|>\n"
#: Tokens that the template adds to a turn.
TURN_TOKENS = 4
BUDGET, HISTORY = 512, 128
#: Turn numbers in a block of the prefix sums.
TURNS = 256


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit(MARK), F.lit(MARK + "0"))
    for i, c in enumerate(CONTROL, 1):
        out = F.replace(out, F.lit(c), F.lit(f"{MARK}{i}"))
    return out


def unescape(text: Column) -> Column:
    for i, c in enumerate(CONTROL, 1):
        text = F.replace(text, F.lit(f"{MARK}{i}"), F.lit(c))
    return F.replace(text, F.lit(MARK + "0"), F.lit(MARK))


def _sent(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """Every turn once for each cell that shows it: (c, conv_id, cell, room, kind, t), kind being new, old or lead."""
    named = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))  # a key that joins nulls too
    t = rows.select(
        named.alias("c"), "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(1 << 62))).cast("long").alias("block"),
    ).withColumn("tokens", word_count(F.col("text")) + TURN_TOKENS)
    opening = F.min(F.when(F.col("role") == "system", F.struct("turn", "role", "text"))).alias("lead")
    sums = t.groupBy("c", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"), F.min(F.struct("turn", "role")).alias("first"), opening)
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    blocks = sums.select("c", "block", earlier("n").alias("n_before"), earlier("sum").alias("sum_before"))
    whole = sums.groupBy("c").agg(F.sum("n").alias("n"), F.sum("sum").alias("all_tokens"), F.min("first").alias("first"), F.min("lead").alias("lead"))
    led = (F.col("first.role") == "system") & (F.col("n") > 1)
    whole = whole.select("c", "all_tokens", F.when(led, word_count(F.col("lead.text")) + TURN_TOKENS).otherwise(0).alias("lead_tokens"))
    by = Window.partitionBy("c", "block").orderBy("turn", "role", "text")
    t = t.withColumn("i", F.row_number().over(by)).withColumn("upto", F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.join(blocks.join(whole, "c"), ["c", "block"]).withColumn("i", F.col("i") + F.col("n_before"))
    t = t.withColumn("upto", F.col("upto") + F.col("sum_before") - F.col("lead_tokens")).withColumn("from", F.col("upto") - F.col("tokens"))
    lead, room = (F.col("i") == 1) & (F.col("lead_tokens") > 0), F.greatest(F.lit(budget - history) - F.col("lead_tokens"), F.lit(max(history, 1)))
    own = F.floor(F.col("from") / room)
    last = F.when(lead, F.floor((F.col("all_tokens") - F.col("lead_tokens") - 1) / room)).otherwise(F.floor((F.col("from") + history) / room))
    part = F.struct(
        "i", "upto", "from", F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n")).alias("head"), escape(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("target"),
    )
    out = t.select("c", "conv_id", room.alias("room"), lead.alias("lead"), own.alias("own"), part.alias("t"), F.explode(F.sequence(F.when(lead, 0).otherwise(own), last)).alias("cell"))
    kind = F.when(F.col("lead"), "lead").when(F.col("own") == F.col("cell"), "new").otherwise("old")
    return out.select("c", "conv_id", "cell", "room", kind.alias("kind"), "t")


def windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window (rising within a conversation), n_repeated (leading turns repeated from before), formatted, loss (code point spans, end exclusive)."""
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("t")))).alias(kind)
    cells = _sent(rows, budget, history).groupBy("c", "cell").agg(F.first("conv_id").alias("conv_id"), F.first("room").alias("room"), *map(of, ("new", "old", "lead"))).where("size(new) > 0")
    # all of the cell's turns, or those before the last and the last alone
    last = "new[size(new) - 1]"
    spans = F.expr(f"""
        if(size(new) = 1 or {last}.upto - new[0].from <= room,
           array(named_struct('k', 0, 'at', 1, 'n', size(new))),
           array(named_struct('k', 0, 'at', 1, 'n', size(new) - 1), named_struct('k', 1, 'at', size(new), 'n', 1)))""")  # fmt: skip
    w = cells.select("conv_id", "cell", "new", "old", "lead", F.explode(spans).alias("s"))
    w = w.select("conv_id", (F.col("cell") * 2 + F.col("s.k")).alias("window"), "lead", F.expr("slice(new, s.at, s.n)").alias("new"), F.expr(f"""
        filter(concat(old, slice(new, 1, s.at - 1)), t -> new[s.at - 1].from - t.from <= {history})""").alias("repeated"))  # fmt: skip
    plain = lambda t, target: F.struct(t["head"].alias("head"), t["body"].alias("body"), target.alias("target"))
    shown = lambda turns: F.transform(turns, lambda t: plain(t, F.lit(False)))
    w = w.withColumn("parts", F.concat(shown("lead"), shown("repeated"), F.transform("new", lambda t: plain(t, t["target"]))))
    opens = F.col("new")[0]["i"] == F.size("lead") + 1  # the first window holds the system turn as a new one
    loss = F.expr(f"""
        aggregate(parts, named_struct('at', 0, 'spans', cast(array() as array<struct<start: int, end: int>>)),
            (s, p) -> named_struct(
                'at', s.at + length(p.head) + length(p.body) + {len(END)},
                'spans', if(p.target, concat(s.spans, array(named_struct('start', s.at + length(p.head), 'end', s.at + length(p.head) + length(p.body)))), s.spans)),
            s -> s.spans)""")  # fmt: skip
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    n_repeated = F.when(opens, 0).otherwise(F.size("lead")) + F.size("repeated")
    return w.select("conv_id", "window", n_repeated.cast("int").alias("n_repeated"), text.alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame, *carry: str) -> DataFrame:
    """conv_id, window, turns (role, text) that are new in the window, targets (texts under the loss mask), from the text alone."""
    sep = "|>\n"
    pieces = F.split("formatted", rf"<\|{MARK}\|>\n")
    new = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))

    def turn(x: Column) -> Column:
        head = F.substring_index(x, sep, 1)
        body = F.substring(x, F.length(head) + len(sep) + 1, F.length(x))
        return F.struct(unescape(F.substring(head, F.lit(3), F.length(head))).alias("role"), unescape(body).alias("text"))

    under = F.transform("loss", lambda z: unescape(F.substring(F.col("formatted"), z["start"] + 1, z["end"] - z["start"])))
    return formatted.select("conv_id", "window", *carry, F.transform(new, turn).alias("turns"), under.alias("targets"))
