"""Chat formatting from event logs: fold deltas, edits and regenerations into messages, then render."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The template.
HEAD, HEAD_END, TURN_END = "### ", ":\n", "</turn>\n"
CONTROL = "</turn>"


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one inside every control string, so that none is left."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit(CONTROL), F.lit("<\\/turn>"))
    return F.replace(text, F.lit(HEAD), F.lit("#\\## "))


def unescape(text: Column) -> Column:
    """What `escape` was given: a backslash stands for the character behind it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def fold(events: DataFrame) -> DataFrame:
    """The messages an event log ends with: `conv_id`, `turn`, `role`, `text`.

    Events have `conv_id`, `seq` (their order), `turn`, `op`, `role` and `text`. `message` and `delta` append text to
    their turn, `edit` replaces what the turn says, `regenerate` discards the turn and all later ones and starts the
    turn anew with its text. A turn's role is that of its last event that has one. Null ops append; null texts are empty;
    null conversations form one of their own; null turns and sequence numbers come before others. Events of one sequence
    number take their order from turn, op, role and text, repeated ones count again. No events give no messages.

    Events are numbered within a conversation, and two running minima and maxima from its end say which were
    overruled: no log is gathered in an array, just the parts of one final message are.
    """
    log = Window.partitionBy("conv_id").orderBy("seq", "turn", "op", "role", "text")
    events = events.select("conv_id", "seq", "turn", F.coalesce("op", F.lit("delta")).alias("op"), "role", F.coalesce("text", F.lit("")).alias("text"))
    events = events.withColumn("_at", F.row_number().over(log))
    later = Window.partitionBy("conv_id").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    redone = F.min(F.when(F.col("op") == "regenerate", F.coalesce("turn", F.lit(-(2**62))))).over(later)
    events = events.withColumn("_redone", redone)
    alive = events.filter("_redone is null or (turn is not null and turn < _redone)")
    turn = Window.partitionBy("conv_id", "turn")
    edited = F.max(F.when(F.col("op") == "edit", F.col("_at"))).over(turn)
    role = F.max_by("role", F.when(F.col("role").isNotNull(), F.col("_at"))).over(turn)
    alive = alive.withColumns({"_edited": edited, "role": role}).filter("_edited is null or _at >= _edited")
    parts = F.sort_array(F.collect_list(F.struct("_at", "text")))
    return alive.groupBy("conv_id", "turn").agg(
        F.max("role").alias("role"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One row a conversation: `formatted`, and `loss_spans`, where the mask is on (start, length in code points).

    Turns are written in order as ``### role:``, a line break, the text and ``</turn>``; control strings inside texts
    and roles are escaped, so that reading is the exact inverse. The mask covers the texts of assistants. A null role is
    empty. A conversation is one row of the result and so must fit into memory; nothing else has to.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.concat(F.lit(HEAD), _escape_role(F.coalesce("role", F.lit(""))), F.lit(HEAD_END))
    body = escape(F.coalesce("text", F.lit("")))
    piece = messages.select("conv_id", "turn", "role", "text", head.alias("_head"), body.alias("_body"))
    piece = piece.withColumns(
        {
            "_no": F.row_number().over(order),
            "_before": F.sum(F.char_length("_head") + F.char_length("_body") + len(TURN_END)).over(
                order.rowsBetween(Window.unboundedPreceding, -1)
            ),
        }
    )
    start = F.coalesce("_before", F.lit(0)) + F.char_length("_head")
    span = F.struct("_no", start.cast("long").alias("start"), F.char_length("_body").cast("long").alias("length"))
    text = F.struct("_no", F.concat("_head", "_body", F.lit(TURN_END)).alias("piece"))
    grouped = piece.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(text)).alias("_pieces"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("_spans"),
    )
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("_pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    parts = F.split(formatted, TURN_END)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    pattern = r"(?s)\A### ((?:[^\\:]|\\.)*+):\n(.*)\z"
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, pattern, 1)).alias("role"),
            unescape(F.regexp_extract(p, pattern, 2)).alias("text"),
        ),
    )


def masked_texts(formatted: Column, loss_spans: Column) -> Column:
    """The unescaped texts below the mask, in order."""
    return F.transform(loss_spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))


def digests(rendered: DataFrame) -> DataFrame:
    """What the formatted text says, read back from it."""
    turns = read_turns(F.col("formatted"))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(masked_texts(F.col("formatted"), F.col("loss_spans")), "")
    return rendered.withColumn("_turns", turns).select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
