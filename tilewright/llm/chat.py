"""Chat formatting, in Spark expressions only: turns of a conversation become one training text with a loss mask.

Template: a block is ``<|im_start|>ROLE\\n`` + its texts joined by ``<|im_sep|>`` + ``<|im_end|>\\n``. Adjacent turns of one role share a block.
Inside texts each ``<``, backslashes, ``|`` gets one more backslash, so that no ``<|`` is left, and the loss of one backslash undoes it. In roles
``%``, ``<`` and line feeds are percent-encoded.

The mask is a list of spans of code points, [start, end), one for each assistant text (control strings aren't under it).

Defined results: turns are ordered by turn, then role, then text, nulls first; repeated rows are turns of their own; a null text or role is
empty; null conv_ids are one conversation; an empty table gives no rows. A text of any length is formatted whole; turns that tie in turn, role and text are alike. Other columns, whatever
their names, don't matter and aren't returned. Turns meet by partial aggregation into one array a conversation, whose
size is that of the row returned for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns whose spans are summed up one after the other.
RUN = 256
START, END, SEP = "<|im_start|>", "<|im_end|>", "<|im_sep|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: (conv_col, formatted string, loss_spans array<struct<start, end>>)."""
    one = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("raw"),
    )
    sorted_turns = turns.select(F.col(conv_col).alias("conv"), one.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    # Each turn's own piece of the output: what precedes its text depends on the role before it, what follows on the role after it.
    t = F.col("t")
    n = F.size("t")

    def piece(x: Column, i: Column) -> Column:
        opens = (i == 0) | (x["role"] != F.get(t, i - 1)["role"])
        closes = (i == n - 1) | (x["role"] != F.get(t, i + 1)["role"])
        head = F.when(opens, F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n"))).otherwise(F.lit(SEP))
        tail = F.when(closes, F.lit(END + "\n")).otherwise(F.lit(""))
        return F.struct(head.alias("head"), escape(x["raw"]).alias("text"), tail.alias("tail"), (x["role"] == loss_role).alias("loss"))

    pieces = sorted_turns.select("conv", F.transform(t, piece).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["text"], x["tail"])), "")
    # Spans, by a running sum over the pieces' lengths: within runs of RUN pieces, behind what the runs before add up to.
    sizes = F.transform("p", lambda x: F.struct(F.length(x["head"]).alias("head"), F.length(x["text"]).alias("text"), F.length(x["tail"]).alias("tail"), x["loss"].alias("loss")))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / RUN).cast("int")), lambda r: F.slice("s", r * RUN + 1, F.lit(RUN)))
    whole_run = F.transform("r", lambda run: F.aggregate(run, F.lit(0), lambda n, x: n + x["head"] + x["text"] + x["tail"]))
    begins = F.aggregate("n", F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def walk(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["head"]
        end = start + x["text"]
        spans = F.when(x["loss"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct((end + x["tail"]).alias("at"), spans.alias("spans"))

    none = F.expr("array_repeat(named_struct('start', 0, 'end', 0), 0)")
    spans = F.flatten(F.zip_with("r", F.slice("b", F.lit(1), F.size("r")), lambda run, at: F.aggregate(run, F.struct(at.alias("at"), none.alias("spans")), walk, lambda acc: acc["spans"])))
    pieces = pieces.select("conv", whole.alias("formatted"), sizes.alias("s")).withColumn("r", runs).withColumn("n", whole_run).withColumn("b", begins)
    return pieces.select(F.col("conv").alias(conv_col), "formatted", spans.alias("loss_spans"))


def turns_column(formatted: Column) -> Column:
    """The turns read back from a formatted text: array<struct<role, text>>."""
    # After the first start mark, every block ends with an end mark and a line feed.
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x, i: i > 0)

    def turns_of(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(role) + 2)
        texts = F.split(F.substring_index(body, END, 1), r"<\|im_sep\|>")
        return F.transform(texts, lambda x: F.struct(unescape_role(role).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def masked_text(formatted: Column, spans: Column) -> Column:
    """What stands under the mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
