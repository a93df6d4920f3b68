"""Chat formatting from event logs, with DataFrame operations only.

A log row is (conv_id, seq, msg, op, role, text).  Folding a message takes its events in
sequence: ``open`` starts it and names the role, ``delta`` appends streamed text,
``regenerate`` throws away what was streamed, ``edit`` replaces it.  Final messages are
then rendered with a template whose control strings cannot occur in escaped texts, with
the assistant texts as loss spans.

Escapes (reversible, because every backslash in an escaped text starts a code):
``\\`` is ``\\0``, ``###`` is ``\\1``, ``</turn>`` is ``\\2``, and in roles ``: `` is ``\\3``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed template strings.
HEAD, SEP, TAIL = "### ", ": ", "</turn>\n"
CODES = (("\\", "\\0"), ("###", "\\1"), ("</turn>", "\\2"))
ROLE_CODES = (*CODES, (": ", "\\3"))


def escape(text: Column, codes: tuple = CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes: tuple = CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def event_log(turns: DataFrame, chunk: int = 160) -> DataFrame:
    """The event log of finished conversations: conv_id, seq, msg, op, role, text.

    Texts are streamed in chunks; by turns, a message is streamed plainly, streamed
    wrongly and regenerated, or streamed wrongly and edited.  Null roles and texts count
    as empty.  Rows with equal conv_id and turn stay separate messages, ordered by role
    and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("msg", F.row_number().over(order).cast("long"))

    def event(op: str, text: Column, role: Column | None = None) -> Column:
        return F.struct(F.lit(op).alias("op"), (role if role is not None else F.lit(None).cast("string")).alias("role"), text.alias("text"))

    text = F.col("text")
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / chunk).cast("int"))
    deltas = F.transform(starts, lambda i: event("delta", F.substring(text, i * chunk + 1, F.lit(chunk))))
    wrong = F.array(event("delta", F.concat(F.lit("\\draft "), F.reverse(text))))
    events = F.concat(
        F.array(event("open", F.lit(""), F.col("role"))),
        F.when(F.col("msg") % 3 == 0, F.concat(wrong, F.array(event("regenerate", F.lit(""))), deltas))
        .when(F.col("msg") % 3 == 1, deltas)
        .otherwise(F.concat(wrong, F.array(event("edit", text)))),
    )
    return (
        rows.select("conv_id", "msg", F.posexplode(events).alias("step", "event"))
        .select("conv_id", (F.col("msg") * (1 << 32) + F.col("step")).alias("seq"), "msg", "event.op", "event.role", "event.text")
    )


def fold_events(log: DataFrame) -> DataFrame:
    """Final messages of a log: conv_id, msg, role, text.

    Messages that were never opened have an empty role; null texts count as empty.
    Repeated log rows (equal conv_id, msg, seq, op and text) count once, as redelivered.
    """
    event = F.struct("seq", "op", F.coalesce("text", F.lit("")).alias("text"))
    grouped = log.groupBy("conv_id", "msg").agg(
        F.coalesce(F.max_by("role", F.when(F.col("op") == "open", F.col("seq"))), F.lit("")).alias("role"),
        F.sort_array(F.collect_set(event)).alias("events"),
        F.max(F.when(F.col("op").isin("open", "regenerate", "edit"), F.col("seq"))).alias("reset"),
    )
    live = F.filter("events", lambda e: e["seq"] >= F.coalesce(F.col("reset"), e["seq"]))
    return grouped.select("conv_id", "msg", "role", F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def render_chats(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Render final messages: conv_id, formatted, loss_spans (start and length in code points)."""
    lead = F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_CODES), F.lit(SEP))
    body = escape(F.col("text"))
    before = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        messages.select("conv_id", "msg", "role", lead.alias("lead"), body.alias("body"))
        .withColumn("piece", F.concat("lead", "body", F.lit(TAIL)))
        .withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    )
    span = F.when(F.col("role") == loss_role, F.struct((F.col("start") + F.length("lead")).cast("int").alias("start"), F.length("body").alias("length")))
    return (
        parts.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("msg", "piece", span.alias("span")))).alias("parts"))
        .select(
            "conv_id",
            F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"),
            F.filter(F.transform("parts", lambda p: p["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        )
    )


def parse_chats(rendered: DataFrame) -> DataFrame:
    """Read rendered conversations back: conv_id, turns (role, text), loss_text, formatted_chars."""
    pieces = F.slice(F.split("formatted", TAIL, -1), 1, F.size(F.split("formatted", TAIL, -1)) - 1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, SEP, 1)
        return F.struct(
            unescape(F.substring(role, F.lit(len(HEAD) + 1), F.length(role)), ROLE_CODES).alias("role"),
            unescape(F.substring(piece, F.length(role) + len(SEP) + 1, F.length(piece))).alias("text"),
        )

    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return rendered.select("conv_id", F.transform(pieces, turn).alias("turns"), F.array_join(masked, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def chat_digests(parsed: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
