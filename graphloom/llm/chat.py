"""Chat formatting: conversations rebuilt from event logs and rendered with a loss mask. DataFrame functions only.

An event log has conv_id, seq, turn, op, role, text; events are folded in the order of seq:

- message: begins a message at its turn; each such event is a message of its own,
- delta: appends its text to the turn's last message,
- edit: replaces that message's text,
- regenerate: discards it; its own text and the deltas that follow are the new one.

A delta, edit or regenerate at a turn without a message begins one. Nulls: a null text or role is empty, a null seq or
turn sorts first, a null op is a message, and a null conv_id is a conversation like any other. Ties of seq are ordered by
op (message first), role and text, so repeated rows give repeated messages and any input order gives the same result.
Columns other than these are ignored. No events give no conversations.

A formatted conversation is one value, so it must fit a row (2 GB); turns are folded before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: What is written for a backslash, the opening of a control string, and a line end in a role.
ESCAPES = (("\\", "\\b"), ("<|", "<\\p"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))


def escape(c: Column, pairs: tuple = ESCAPES) -> Column:
    """No control string is left in the result; unescape() gives back every text."""
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column, pairs: tuple = ESCAPES) -> Column:
    # each backslash begins an escape, and its own comes last, so no replacement makes another
    for a, b in pairs[::-1]:
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def fold(events: DataFrame) -> DataFrame:
    """conv_id, messages: array of (role, text), in order."""
    kind = F.lower(F.coalesce(F.col("op"), F.lit("message")))
    e = events.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.struct(
            F.col("seq").cast("long").alias("seq"),
            F.when(kind == "message", 0).otherwise(1).alias("later"),
            kind.alias("op"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("e"),
    )
    # a turn's events are folded first, so that the turns of a long conversation are dealt out
    turns = e.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("e")).alias("es"))
    begins = lambda x: x["op"] == "message"
    plain = F.forall("es", begins)
    out_type = "array<struct<seq:bigint,role:string,text:string>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        new = F.array(F.struct(x["seq"].alias("seq"), x["role"].alias("role"), x["text"].alias("text")))
        text = F.when(x["op"] == "delta", F.concat(last["text"], x["text"])).otherwise(x["text"])
        put = F.array(F.struct(last["seq"].alias("seq"), last["role"].alias("role"), text.alias("text")))
        return F.when(begins(x) | (F.size(acc) == 0), F.concat(acc, new)).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), put))

    plainly = F.transform("es", lambda x: F.struct(x["seq"].alias("seq"), x["role"].alias("role"), x["text"].alias("text")))
    turns = turns.select("conv_id", "turn", F.when(plain, plainly).otherwise(F.aggregate("es", F.array().cast(out_type), step)).alias("ms"))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("ms")[0]["seq"], F.lit(-(2**63))).alias("at"), "turn", "ms")))
    return turns.groupBy("conv_id").agg(F.transform(F.flatten(F.transform(ordered, lambda t: t["ms"])), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, and loss: array of (start, length) of the assistant texts in formatted, in code points."""
    piece = lambda m: F.concat(F.lit(OPEN), escape(m["role"], ROLE_ESCAPES), F.lit("\n"), escape(m["text"]), F.lit(CLOSE + "\n"))
    made = conversations.select("conv_id", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), piece(m).alias("piece"), F.length(escape(m["text"])).alias("n"))).alias("ps"))
    spans = F.aggregate(
        "ps",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["piece"])).alias("at"),
            F.when(
                p["role"] == "assistant",
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["piece"]) - len(CLOSE) - 1 - p["n"]).alias("start"), p["n"].cast("long").alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return made.select("conv_id", F.array_join(F.transform("ps", lambda p: p["piece"]), "").alias("formatted"), spans.alias("loss"))


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold(events))


def parse(formatted: Column) -> Column:
    """The messages of a formatted conversation: array of (role, text)."""
    turns = F.split(formatted, r"<\|im_end\|>\n", -1)
    turns = F.slice(turns, 1, F.size(turns) - 1)
    body = lambda t: F.substr(t, F.lit(len(OPEN) + 1))
    cut = lambda t: F.instr(t, "\n")
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substr(body(t), F.lit(1), cut(body(t)) - 1), ROLE_ESCAPES).alias("role"),
            unescape(F.substr(body(t), cut(body(t)) + 1)).alias("text"),
        ),
    )


def masked(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def digest(chats: DataFrame) -> DataFrame:
    """What a reader of the formatted text gets back."""
    told = F.array_join(F.transform("ms", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return chats.withColumn("ms", parse(F.col("formatted"))).withColumn("told", masked(F.col("formatted"), F.col("loss"))).select(
        "conv_id",
        F.size("ms").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("told").cast("long").alias("loss_chars"),
        F.sha2(F.col("told").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def events_of(conversations: DataFrame) -> DataFrame:
    """Finished messages as a log: a row is a message whose turn is its place."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("op"), "role", "text")


def streamed(conversations: DataFrame) -> DataFrame:
    """Finished messages as the log that a service writes while they come about: each begins with a draft, which an assistant's
    regenerate discards and another's edit empties, and then comes in two deltas. seq counts inside a turn; messages of one turn
    follow each other by role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    half = F.floor(F.length("text") / 2).cast("int")
    before = 4 * (F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text")) - 1)
    event = lambda k, op, who, what: F.struct((F.col("before") + k).cast("long").alias("seq"), op.alias("op"), who.alias("role"), what.alias("text"))
    first, second, none = F.substr("text", F.lit(1), half), F.substr("text", half + 1), F.lit("")
    redo = F.when(F.col("role") == "assistant", "regenerate").otherwise("edit")
    log = F.array(event(0, F.lit("message"), F.col("role"), second), event(1, redo, none, none), event(2, F.lit("delta"), none, first), event(3, F.lit("delta"), none, second))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("before", before)
    return rows.select("conv_id", "turn", F.explode(log).alias("e")).select("conv_id", "e.seq", "turn", "e.op", "e.role", "e.text")
