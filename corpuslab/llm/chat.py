"""Chat formatting from event-sourced conversation logs (DataFrame functions only).

Events are (conv_id, seq, message, kind, role, text). ``kind`` is one of
``message`` (the message with its text so far), ``delta`` (text streamed to its
end), ``edit`` (its text replaced), ``regenerate`` (its text dropped; the deltas
that follow build it anew) and ``delete``. Folding sorts a message's events by
seq and keeps what follows the last event that replaced its text. The final
messages of a conversation, in the order of their first events, are rendered as

    <s>role[INST]text</s>      not trained on
    <s>role[/INST]text</s>     trained on: the assistant's turns

Inside roles and texts ``\\``, ``<`` and ``[`` are written as ``\\s``, ``\\l`` and
``\\b``. So no text, whatever it says, contains a control string, and reading
back is exact: a backslash is always followed by its letter.

Events are folded per message, spread over the cluster however long a
conversation is; only its final segments meet, as the one row they form.

Defined cases: null text or role reads as empty; events with null seq come
first; a message without a replacing event is the join of its deltas; an
unknown kind is treated as ``delta``; equal seqs are ordered by kind and text;
null conv_id is one conversation; an empty log gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, END, UNTRAINED, TRAINED = "<s>", "</s>", "[INST]", "[/INST]"
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"))
REPLACING = ("message", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, at, message, role, text): final messages; ``at`` is the seq of
    a message's first event."""
    log = events.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role"))).alias("log"))
    last = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin(*REPLACING), i + 1).otherwise(1)))
    log = log.withColumn("rest", F.slice("log", last, F.size("log")))
    text = F.array_join(F.transform("rest", lambda e: F.when(e["kind"] == "regenerate", "").otherwise(e["text"])), "")
    role = F.get(F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull()), F.lit(0))
    return (log.filter(~F.coalesce(F.get("rest", F.lit(0))["kind"] == "delete", F.lit(False)))
            .select("conv_id", F.get("log", F.lit(0))["seq"].alias("at"), "message",
                    F.coalesce(role, F.lit("")).alias("role"), text.alias("text")))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask): the training text and, for every trained
    turn, the turn's number and the code points (start, length) of its text
    within the turn."""
    trained = F.col("role") == "assistant"
    body = escape(F.col("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.when(trained, TRAINED).otherwise(UNTRAINED))
    turns = messages.select("conv_id", F.struct(
        "at", "message", F.concat(head, body, F.lit(END)).alias("segment"),
        F.length(head).alias("start"), F.when(trained, F.length(body)).alias("length")).alias("turn"))
    return (turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
            .select("conv_id", F.array_join(F.col("turns.segment"), "").alias("formatted"),
                    F.filter(F.transform("turns", lambda t, i: F.struct(
                        i.alias("turn"), t["start"].alias("start"), t["length"].alias("length"))),
                        lambda m: m["length"].isNotNull()).alias("loss_mask")))


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted): role and text of every turn, and the
    unescaped text under the loss mask, from the rendered text alone."""
    segments = F.split("formatted", END)
    cut = rendered.withColumn("segments", F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))))

    def turn(s: Column) -> Column:
        mark = F.instr(s, F.lit("["))
        skip = F.when(F.substr(s, mark, F.lit(len(TRAINED))) == TRAINED, len(TRAINED)).otherwise(len(UNTRAINED))
        return F.struct(unescape(F.substr(s, F.lit(len(OPEN) + 1), mark - F.lit(len(OPEN) + 1))).alias("role"),
                        unescape(F.substr(s, mark + skip)).alias("text"))

    def masked(m: Column) -> Column:
        return unescape(F.substr(F.get("segments", m["turn"]), m["start"] + 1, m["length"]))

    return cut.select("conv_id", F.transform("segments", turn).alias("turns"),
                      F.array_join(F.transform("loss_mask", masked), "").alias("loss"), "formatted")


def digests(read: DataFrame) -> DataFrame:
    """The query's columns, from what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
