"""Chat formatting from event logs, with DataFrame functions only.

``reconstruct`` folds a log of events (conv, message, seq, kind, role, text) into final messages: by ``seq``, a ``delta``
adds its text, an ``edit`` replaces the message's text by its own, a ``regenerate`` throws it away and starts with its
own.  Equal events count once (logs deliver at least once); ties in ``seq`` go by kind, role, text.  A message has the
role of its first event that has one.  ``render`` writes a conversation's messages in order of ``message``:

    <|turn|>ROLE<|text|>
    TEXT<|end|>

Control strings of common templates inside roles and texts lose their first character to an entity, and ``&`` becomes
``&amp;``, so that ``unescaped`` gives back every text.  The loss mask is the span of each assistant text.

Null texts and roles are empty; null conversations, messages or sequence numbers are values like others and sort first;
an empty log gives no rows.  Messages are folded before conversations are gathered, so that a conversation with a
third of all events is folded by many tasks; its rendering is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>\n", "<|end|>\n"
# Control strings that templates in use know.
ANGLED = r"<(\||/?s>|</?SYS>>)"
SQUARE = r"\[(/?INST\])"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.regexp_replace(F.regexp_replace(text, ANGLED, "&lt;$1"), SQUARE, "&lsqb;$1")


def unescaped(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&lsqb;", "["), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages (conv, message, role, text) of an event log."""
    event = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = events.groupBy("conv", "message").agg(F.array_sort(F.collect_set(event)).alias("log"))
    fold = F.aggregate("log", F.lit(""), lambda text, e: F.when(e["kind"].isin("edit", "regenerate"), e["text"]).otherwise(F.concat(text, e["text"])))
    role = F.coalesce(F.try_element_at(F.filter("log", lambda e: e["role"] != ""), F.lit(1))["role"], F.lit(""))
    return log.select("conv", "message", role.alias("role"), fold.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv, formatted, loss_spans (start, length in code points, from 0)."""
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    turns = messages.select("conv", "message", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv").orderBy("message", "role", "piece").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0).cast("long"))
    placed = turns.select("conv", start.alias("at"), "piece", (F.col("role") == "assistant").alias("learnt"), F.length("head").alias("skip"), F.length("body").cast("long").alias("size"))
    gathered = placed.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "piece", "learnt", "skip", "size"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: F.struct((t["at"] + t["skip"]).alias("start"), t["size"].alias("length")))
    return gathered.select("conv", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parsed(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text)."""
    parts = F.split(formatted, r"<\|end\|>\n", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part):
        role = F.substring_index(F.substr(part, F.lit(len(TURN) + 1)), TEXT, 1)
        text = F.substr(part, F.length(role) + F.lit(len(TURN) + len(TEXT) + 1))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(parts, turn)


def learnt(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
