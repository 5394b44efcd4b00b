"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log holds events (conv_id, msg, seq, kind, role, text). Kinds: ``message`` begins a message with a text,
``delta`` appends, ``edit`` replaces the text so far, ``regenerate`` empties it for new deltas, ``delete``
removes the message. Events are partitioned by conversation once, sorted by sequence and folded: what counts
is the last generation, the events from the last message, edit or regenerate on.

Rendered form of a turn: ``<|im_start|>role`` newline ``text<|im_end|>`` newline. Escapes keep ``<`` and ``[``,
with which all control strings begin, out of the texts: a backslash becomes ``\\0``, ``<`` becomes ``\\1``,
``[`` becomes ``\\2``, and in a role a newline becomes ``\\3``. Every backslash in the output therefore
begins an escape, so reading it back is exact.

Null texts and roles are empty. Rows with equal turn are ordered by role and text; repeated rows are turns
of their own. A null conv_id is a conversation. An empty table gives no rows. Texts of any length are kept whole; columns beyond
the four are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
ESCAPES = [("\\", "\\0"), ("<", "\\1"), ("[", "\\2")]


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in ESCAPES + [("\n", "\\3")] * role:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for plain, code in reversed(ESCAPES + [("\n", "\\3")] * role):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def to_events(conversations: DataFrame, piece: int = 512) -> DataFrame:
    """The log that streaming these rows would leave: a message event per row, then its text in deltas."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("msg", F.row_number().over(w))
    text = F.coalesce("text", F.lit(""))
    cut = lambda i: F.struct(F.lit("delta").alias("kind"), F.substr(F.col("text"), i * piece + 1, F.lit(piece)).alias("text"))
    deltas = F.transform(F.sequence(F.lit(0), F.expr(f"(char_length(text) - 1) div {piece}")), cut)
    events = F.when(F.col("text") == "", F.array().cast("array<struct<kind:string,text:string>>")).otherwise(deltas)
    rows = rows.withColumn("text", text).withColumn("role", F.coalesce("role", F.lit("")))
    start = F.array(F.struct(F.lit("message").alias("kind"), F.lit("").alias("text")))
    return rows.select("conv_id", "msg", "role", F.posexplode(F.concat(start, events)).alias("seq", "e")).select("conv_id", "msg", "seq", "e.kind", "role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, msg, role, text): the final messages; deleted ones are gone."""
    one = Window.partitionBy("conv_id", "msg")
    anew = F.col("kind").isin("message", "edit", "regenerate").cast("int")
    last = events.withColumn("_gen", F.sum(anew).over(one.orderBy("seq"))).withColumn("_last", F.sum(anew).over(one)).withColumn("_gone", F.max((F.col("kind") == "delete").cast("int")).over(one))
    last = last.withColumn("_role", F.first("role", ignorenulls=True).over(one.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    last = last.where((F.col("_gen") == F.col("_last")) & (F.col("_gone") == 0))
    said = F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("seq", said.alias("text"))))
    return last.groupBy("conv_id", "msg").agg(F.first("_role").alias("role"), parts.alias("p")).select("conv_id", "msg", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask): the text and the spans (start, chars) that carry a loss."""
    head = F.concat(F.lit(BEGIN), escape(F.col("role"), True), F.lit("\n"))
    turn = messages.select("conv_id", "msg", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    turn = turn.withColumn("piece", F.concat("head", "body", F.lit(END)))
    w = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.sum(F.length("piece")).over(w) - F.length("piece") + F.length("head")
    turn = turn.select("conv_id", "msg", "role", "piece", begin.alias("start"), F.length("body").alias("chars"))
    got = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg", "role", "piece", "start", "chars"))).alias("t"))
    mask = F.transform(F.filter("t", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["start"].alias("start"), x["chars"].alias("chars")))
    return got.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), mask.alias("loss_mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns array of (role, text), loss): parsed from the formatted text and the mask alone."""
    pieces = F.array_remove(F.split("formatted", r"<\|im_start\|>"), "")

    def parsed(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(END))
        return F.struct(unescape(role, True).alias("role"), unescape(body).alias("text"))

    loss = F.transform("loss_mask", lambda m: unescape(F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), m["chars"].cast("int"))))
    return rendered.select("conv_id", "formatted", F.transform(pieces, parsed).alias("turns"), F.array_join(loss, "").alias("loss"))
