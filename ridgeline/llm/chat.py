"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, adjacent turns of one role merged into a block, and blocks
concatenated:

    ### role:⏎text</turn>text</turn>⏎

Texts and roles are escaped so that no control string can occur in them: \\ as \\b, # as \\h, < as \\l, and in roles a
line feed as \\e. Escaped text holds no # and no <, so splitting at the control strings reads the output back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, END, TAIL = "### ", "</turn>", "\n"


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("\n", "\\e"), ("<", "\\l"), ("#", "\\h"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv id, formatted, loss_spans array<struct<start, length>> (code points, from 1).

    Turns are ordered by turn (null first), then role, then text, so ties have a defined order; repeated rows are repeated
    turns. Null roles and texts count as empty; rows with a null conversation form one conversation. loss_spans covers
    the escaped texts of learn_role in formatted, without marks. A conversation must fit in a row, as formatted does.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), escape(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    lists = turns.select(F.col(conv_col).alias("conv"), row.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # A turn that starts a block is one whose predecessor has another role; blocks are slices between such turns.
    starts = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    lists = lists.withColumn("starts", starts)
    block = lambda s, k: F.slice("turns", s, F.coalesce(F.get("starts", k + 1), F.size("turns") + 1) - s)
    lists = lists.withColumn("blocks", F.transform("starts", lambda s, k: F.struct(F.element_at("turns", s)["role"].alias("role"), F.transform(block(s, k), lambda t: t["text"]).alias("texts"))))
    head = lambda b: F.concat(F.lit(HEAD), F.replace(escape(b["role"]), F.lit("\n"), F.lit("\\e")), F.lit(":\n"))
    written = lambda b: F.concat(head(b), F.array_join(F.transform(b["texts"], lambda t: F.concat(t, F.lit(END))), ""), F.lit(TAIL))
    lists = lists.withColumn("formatted", F.array_join(F.transform("blocks", written), ""))
    # Gaps between texts are marks of known length, so places are running sums over the turns.
    gap = lambda b, first: F.when(first, F.length(head(b))).otherwise(F.lit(len(END)))
    pieces = F.flatten(
        F.transform("blocks", lambda b: F.transform(b["texts"], lambda t, k: F.struct((b["role"] == learn_role).alias("learn"), gap(b, k == 0).cast("long").alias("before"), F.length(t).cast("long").alias("length"), F.when(k == F.size(b["texts"]) - 1, len(END) + len(TAIL)).otherwise(0).cast("long").alias("after"))))
    )
    start = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + p["before"]
        own = F.array(F.struct(at.alias("start"), p["length"].alias("length")))
        return F.struct((at + p["length"] + p["after"]).alias("at"), F.when(p["learn"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(pieces, start, step, lambda acc: acc["spans"])
    return lists.select(F.col("conv").alias(conv_col), "formatted", spans.alias("loss_spans"))


def read_back(formatted: DataFrame, *, formatted_col: str = "formatted", conv_col: str = "conv_id", spans_col: str = "loss_spans") -> DataFrame:
    """conv id, turns array<struct<role, text>> and loss array<string>, all taken from the formatted text."""
    blocks = F.filter(F.split(F.col(formatted_col), HEAD, -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        top = F.substring_index(b, "\n", 1)
        role = unescape(F.left(top, F.length(top) - 1))
        texts = F.split(F.substring(b, F.length(top) + 2, F.length(b)), END, -1)
        return F.transform(F.slice(texts, 1, F.size(texts) - 1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    loss = F.transform(F.col(spans_col), lambda s: unescape(F.substring(F.col(formatted_col), s["start"].cast("int"), s["length"].cast("int"))))
    return formatted.select(F.col(conv_col), F.flatten(F.transform(blocks, turns)).alias("turns"), loss.alias("loss"))
