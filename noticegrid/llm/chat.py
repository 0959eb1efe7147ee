"""Conversations rebuilt from event logs and rendered with a chat template (operator 5).

In DataFrame functions only. A log row is an event of a message: conv_id, message (its place
in the conversation), seq (its place in the log), kind, role, text. Folding a message's
events in the order of seq: ``delta`` appends its text; ``edit`` and ``regenerate`` start the
text anew with theirs; any other kind counts as ``delta``. The role is the last one given.
So the final text is what stands from the last edit or regeneration on. Events
are folded by message first, so a hot conversation is spread over its messages, and only finished
messages meet, in the one row that a conversation is.

Rendered, a turn is ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>``. Inside roles and texts
each control string gets a backslash after its first character, and one that has
backslashes there already gets one more, so unescaping is exact and the markers stand
for turns only. The loss mask lists spans of assistant text: turn (from 1), within (code points
into the turn's rendering, from 1), start (into the whole, from 1) and length.

Null texts and roles count as empty; a null conv_id is a conversation of its own; ties in seq
follow kind, role and text. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticegrid.llm.common import whole

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings by first character and the rest; no rest holds a first character.
RESTS = r"(/?s>|/?INST\]|\|im_start\|>|\|im_sep\|>|\|im_end\|>)"
ESCAPE = r"([<\[])(\\*)" + RESTS
UNESCAPE = r"([<\[])\\(\\*)" + RESTS
LEARNT = "assistant"


def escaped(text) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescaped(text) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def fold(events: DataFrame) -> DataFrame:
    """One row per message: conv_id, message, role, text."""
    parts = F.sort_array(F.collect_list(F.struct("seq", "kind", "role", F.col("text").alias("body"))))
    last = F.array_max(F.transform("parts", lambda p, i: F.when(p["kind"].isin("edit", "regenerate"), i + 1).otherwise(F.lit(1))))
    roles = F.filter(F.transform("parts", lambda p: p["role"]), lambda r: r.isNotNull())
    kept = F.slice("parts", F.col("first"), F.size("parts"))
    return (events.groupBy("conv_id", "message").agg(parts.alias("parts")).withColumn("first", last)
            .select("conv_id", "message", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
                    F.array_join(F.transform(kept, lambda p: whole(p["body"])), "").alias("text")))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted and loss_spans."""
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP))
    body = escaped(F.col("text"))
    pieces = messages.select("conv_id", "message", "role", head.alias("head"), body.alias("body"))
    turn = pieces.withColumn("piece", F.concat("head", "body", F.lit(END))).withColumn("size", F.length("piece"))
    by = Window.partitionBy("conv_id").orderBy("message")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turn.withColumn("turn", F.row_number().over(by)).withColumn("before", F.sum("size").over(upto) - F.col("size"))
    span = F.when(F.col("role") == LEARNT, F.struct(
        F.col("turn"), (F.length("head") + 1).alias("within"),
        (F.col("before") + F.length("head") + 1).alias("start"), F.length("body").alias("length")))
    rows = placed.select("conv_id", F.struct("turn", "piece", span.alias("span")).alias("one"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("all", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("all", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (role and text, unescaped) and learnt (the texts under the mask, unescaped), from the output alone."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>"), lambda p: p != "")
    halves = F.transform(F.col("pieces"), lambda p: F.split(F.substring(p, F.lit(len(START) + 1), F.length(p)), r"<\|im_sep\|>"))
    turns = F.transform(halves, lambda h: F.struct(unescaped(h[0]).alias("role"), unescaped(h[1]).alias("text")))
    learnt = F.transform("loss_spans", lambda s: unescaped(F.substring(F.element_at("pieces", s["turn"]), s["within"], s["length"])))
    return rendered.withColumn("pieces", pieces).select("conv_id", "formatted", turns.alias("turns"), learnt.alias("learnt"))


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """Turn rows as a log: a message is opened with its role, then streamed line by line.

    Rows that repeat a turn with other content are messages of their own, ordered by role and
    the text's digest; wholly repeated rows are as many messages.
    """
    rows = conversations.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    keyed = copies.select("conv_id", F.struct(
        "turn", "role", F.sha2(whole(F.col("text")).cast("binary"), 256).alias("digest"), "copy").alias("message"), "role", "text")
    streamed = F.filter(F.split(whole(F.col("text")), r"(?<=\n)"), lambda x: x != "")
    log = F.concat(
        F.array(F.struct(F.lit("open").alias("kind"), F.col("role"), F.lit("").alias("text"))),
        F.transform(streamed, lambda x: F.struct(F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), x.alias("text"))))
    return keyed.select("conv_id", "message", F.posexplode(log).alias("seq", "event")).select(
        "conv_id", "message", "seq", "event.kind", "event.role", "event.text")


def format_chats(conversations: DataFrame) -> DataFrame:
    return render(fold(events_of_turns(conversations)))
