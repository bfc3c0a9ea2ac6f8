"""Chat logs as events, folded into messages and rendered with a reversible template.

All steps are DataFrame functions.  An event has a conversation, a sequence number, the message
it belongs to, a kind, a role and a text:

* ``message``     the whole text of a message
* ``delta``       more text for it, as streamed
* ``edit``        a new text in place of all before
* ``regenerate``  the message starts again with this text, and messages that began between its
  first event and now are dropped with the branch they belonged to

A turn is rendered as START role SEPARATOR text END.  Control strings inside roles and texts get
a backslash after their first character and backslashes are doubled, so a rendered conversation
can be split at the markers and read back exactly.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (
    START, SEPARATOR, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
TRAINED = ("assistant",)


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def messages(events: DataFrame) -> DataFrame:
    """Final messages (conversation, place, role, text) of events
    (conversation, seq, message, kind, role, text).

    Events are taken by seq (nulls first; ties by kind, role, text).  A null or unknown kind is
    a whole message, a null text is empty, the role is the first that is not null, else empty.
    Deltas before any other event are text as well.  ``place`` numbers the messages of a
    conversation from 0 by their first event; a null conversation is one like any other.
    """
    kind = F.coalesce("kind", F.lit("message"))
    event = F.struct("seq", kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    folded = events.groupBy("conversation", "message").agg(
        F.sort_array(F.collect_list(event)).alias("e"),
        F.min("seq").alias("first"),
        F.max(F.when(kind == "regenerate", F.col("seq"))).alias("again"),
    )
    whole = F.transform("e", lambda x, i: F.when(x["kind"] != "delta", i).otherwise(0))
    roles = F.filter(F.transform("e", lambda x: x["role"]), lambda r: r.isNotNull())
    alive = F.slice("e", F.array_max(whole) + 1, F.size("e"))
    folded = folded.select(
        "conversation", "message", "first", "again",
        F.coalesce(F.try_element_at(roles, F.lit(1)), F.lit("")).alias("role"),
        F.array_join(F.transform(alive, lambda x: x["text"]), "").alias("text"),
    )
    order = Window.partitionBy("conversation").orderBy("first", "message")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cut = F.max("again").over(before)
    kept = folded.withColumn("cut", cut).where("cut IS NULL OR first IS NULL OR first >= cut")
    return kept.select("conversation", (F.row_number().over(order) - 1).alias("place"), "role", "text")


def rendered(turns: DataFrame) -> DataFrame:
    """(conversation, formatted, loss_spans) of messages (conversation, place, role, text).

    ``loss_spans`` lists [start, stop) in code points of ``formatted``: the text of every
    assistant message, without markers.
    """
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEPARATOR))
    marked = turns.withColumn("head", head).withColumn("body", escaped(F.col("text")))
    size = F.length("head") + F.length("body") + len(END)
    order = Window.partitionBy("conversation").orderBy("place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")
    placed = marked.withColumn("start", start).withColumn("stop", F.col("start") + F.length("body"))
    span = F.when(F.col("role").isin(*TRAINED), F.struct("start", "stop"))
    return (
        placed.groupBy("conversation")
        .agg(F.sort_array(F.collect_list(
            F.struct("place", F.concat("head", "body", F.lit(END)).alias("turn"), span.alias("span"))
        )).alias("t"))
        .select(
            "conversation",
            F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"),
            F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        )
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conversation, place, role, text, in_loss) parsed from ``rendered`` rows.

    Turns come from the formatted string, the loss flag from the spans alone.
    """
    parts = F.split("formatted", END.replace("|", "\\|"))
    rows = formatted.select("conversation", F.posexplode(parts).alias("place", "part"))
    rows = rows.where(F.col("part") != "")
    order = Window.partitionBy("conversation").orderBy("place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cut = F.instr("part", SEPARATOR)
    placed = rows.select(
        "conversation", "place",
        F.col("part").substr(F.lit(len(START) + 1), cut - 1 - len(START)).alias("role"),
        F.col("part").substr(cut + len(SEPARATOR), F.length("part")).alias("body"),
        (F.coalesce(F.sum(F.length("part") + len(END)).over(before), F.lit(0))
         + cut - 1 + len(SEPARATOR)).alias("start"),
    ).withColumn("stop", F.col("start") + F.length("body"))
    spans = formatted.select("conversation", F.inline("loss_spans")).withColumn("in_loss", F.lit(True))
    same = [placed[c].eqNullSafe(spans[c]) for c in ("conversation", "start", "stop")]
    return placed.join(spans, same, "left").select(
        placed["conversation"], "place", unescaped(F.col("role")).alias("role"),
        unescaped(F.col("body")).alias("text"), F.coalesce("in_loss", F.lit(False)).alias("in_loss"),
    )


def formatted(logs: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Rendered conversations of a log of whole messages, one row per message.

    Messages are ordered by turn (nulls first; ties by role, text); repeated rows are messages
    of their own.
    """
    order = Window.partitionBy("conversation").orderBy("seq", "role", "text")
    events = logs.select(
        F.col(conversation).alias("conversation"), F.col(turn).alias("seq"),
        F.col(role).alias("role"), F.col(text).alias("text"),
    ).withColumns({"message": F.row_number().over(order), "kind": F.lit("message")})
    return rendered(messages(events))
