"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log row is an event of a conversation: ``message`` opens a message, ``delta`` appends to one, ``edit`` replaces its
text and ``regenerate`` empties it for the deltas that follow. The log is dealt by conversation once, sorted by
sequence, folded into final messages and rendered:

    ### <role>:\\n<text></turn>\\n        for each message

Inside roles and texts a backslash becomes ``\\\\``, ``###`` becomes ``\\h`` and ``</turn>`` becomes ``\\e`` (in roles a
line feed becomes ``\\n``), so that no text can hold a control string and each is got back exactly.

Defined results: a null text or role is empty; a null kind is a message; events that precede every message of their
conversation open one; equal sequence numbers are ordered by kind, role and text, and repeated message rows are messages
of their own; rows with a null conversation id form one conversation with a null id; an unknown kind changes nothing; an
empty log gives no conversation; texts of any length are rendered whole, and a conversation's messages are one row, as
its rendering is; other columns of the log don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, ESCAPE = "### ", "</turn>", "\\"
LEARNED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit(ESCAPE), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("###"), F.lit("\\h")), F.lit(CLOSE), F.lit("\\e"))


def unescaped(text: Column) -> Column:
    """Between doubled backslashes, which split() finds from the left, a backslash only stands before h, e or n."""

    def part(x: Column) -> Column:
        return F.replace(F.replace(F.replace(x, F.lit("\\h"), F.lit("###")), F.lit("\\e"), F.lit(CLOSE)), F.lit("\\n"), F.lit("\n"))

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def final_messages(log: DataFrame, conv_id: str = "conv_id", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text", target: str | None = None) -> DataFrame:
    """conv_id, message (from 1), role, text: what the events leave. target: a column with the number of the message
    that an event refers to; where null, and without it, the last one opened."""
    events = log.select(
        F.col(conv_id).alias("conv_id"),
        F.col(seq).alias("seq"),
        F.coalesce(F.col(kind), F.lit("message")).alias("kind"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        (F.col(target).cast("long") if target else F.lit(None).cast("long")).alias("target"),
    ).repartition("conv_id")
    order = [F.col("seq").asc_nulls_first(), F.expr("array_position(array('message', 'regenerate', 'edit', 'delta'), kind)"), "role", "text"]
    running = Window.partitionBy("conv_id").orderBy(*order)
    place = F.row_number().over(running)
    opened = F.sum((F.col("kind") == "message").cast("long")).over(running.rowsBetween(Window.unboundedPreceding, 0))
    placed = events.select("*", place.alias("place"), opened.alias("opened"))
    number = F.when(F.col("kind") == "message", F.col("opened")).otherwise(F.greatest(F.lit(1), F.coalesce("target", "opened")))
    # partitioned by conversation already, so neither this nor the next grouping moves rows
    grouped = placed.groupBy("conv_id", number.alias("message")).agg(
        F.min_by("role", "place").alias("role"), F.array_sort(F.collect_list(F.struct("place", "kind", "text"))).alias("events")
    )
    reset = F.coalesce(F.array_max(F.transform(F.filter("events", lambda e: e["kind"].isin("message", "edit", "regenerate")), lambda e: e["place"])), F.lit(0))
    told = F.filter("events", lambda e: (e["place"] >= F.col("reset")) & e["kind"].isin("message", "edit", "delta"))
    return grouped.withColumn("reset", reset).select("conv_id", "message", "role", F.array_join(F.transform(told, lambda e: e["text"]), "").alias("text"))


def rendered(messages: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """conv_id, formatted, loss_spans: the text of each conversation and, as start (from 0) and length in code points,
    the spans of it that the loss covers: the escaped texts of the learned role."""
    turn = F.struct(
        "message",
        F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit(":\n")).alias("head"),
        escaped(F.col("text")).alias("body"),
        (F.col("role") == learned_role).alias("learned"),
    )
    close = f"{CLOSE}\n"
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(close))), "")
    step = lambda t: F.length(t["head"]) + F.length(t["body"]) + len(close)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("CAST(array() AS array<struct<start: bigint, length: bigint>>)").alias("spans"))
    span = lambda acc, t: F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).cast("long").alias("length"))
    spans = F.aggregate(
        "turns",
        start,
        lambda acc, t: F.struct((acc["at"] + step(t)).alias("at"), F.when(t["learned"], F.concat(acc["spans"], F.array(span(acc, t)))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"],
    )
    return turns.select("conv_id", whole.alias("formatted"), spans.alias("loss_spans"))


def format_chats(log: DataFrame, learned_role: str = LEARNED_ROLE, **columns: str) -> DataFrame:
    """conv_id, formatted, loss_spans from a log of events."""
    return rendered(final_messages(log, **columns), learned_role)


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted conversation."""
    turns = F.filter(F.split(formatted, "</turn>\n"), lambda t: t != "")
    return F.transform(
        turns,
        lambda t: F.struct(
            unescaped(F.substring(t, F.lit(len(OPEN) + 1), F.instr(t, F.lit("\n")) - (len(OPEN) + 2))).alias("role"),
            unescaped(F.substring(t, F.instr(t, F.lit("\n")) + 1, F.length(t))).alias("text"),
        ),
    )


def under_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
