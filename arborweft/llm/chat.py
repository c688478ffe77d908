"""Chat formatting by event sourcing, in DataFrame expressions only.

A log holds events (conv_id, msg, seq, kind, role, payload): 'start' opens a message, 'delta' appends, 'edit' replaces the
text so far, 'regenerate' empties it. Events are folded message by message first, so one huge conversation is spread
over many tasks; only finished messages meet by conversation, in order of seq, and are rendered.

The template marks a turn ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside roles and texts get a backslash after
their first character and backslashes are doubled, so the output never holds a control string that is not markup, and dropping
one backslash before any character gives the text back. The loss mask is a list of runs, one for each turn: skip so many
characters from the turn's marker, then so many under loss (0 for turns that are not trained on).

Defined cases: null text or role is empty; turns are ordered by (turn, role, text), null turn first; repeated rows are turns of
their own; of ties (equal turn, role and text) either is first; a null conv_id is a conversation; very long texts are escaped and digested
whole; an empty table gives no rows; other columns, whatever their names, are ignored. A conversation is one output row and so must fit in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: What a text may not contain unescaped: template markers of common chat formats.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>"]


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _head(role: Column) -> Column:
    """A turn's role as written: a line, so its own line ends are escaped."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def to_events(rows: DataFrame) -> DataFrame:
    """An event log of finished conversations: assistant texts stream in two deltas after a discarded draft, other texts are
    a draft that an edit replaces. Folding it gives the rows back."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    event = lambda i, kind, payload: F.struct(F.lit(i).alias("seq"), F.lit(kind).alias("kind"), payload.alias("payload"))
    first, rest = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    streamed = F.array(
        event(0, "start", F.lit("")), event(1, "delta", F.substring(text, 1, 16)), event(2, "regenerate", F.lit("")), event(3, "delta", first), event(4, "delta", rest)
    )
    edited = F.array(event(0, "start", F.lit("")), event(1, "delta", F.lit("draft")), event(2, "edit", text))
    role = F.coalesce("role", F.lit(""))
    log = rows.select("conv_id", F.col("turn").alias("_turn"), F.monotonically_increasing_id().alias("msg"), role.alias("role"), F.when(role == "assistant", streamed).otherwise(edited).alias("_e"))
    return log.select("conv_id", "_turn", "msg", "role", F.explode("_e").alias("e")).select("conv_id", "_turn", "msg", F.col("e.seq").alias("seq"), F.col("e.kind").alias("kind"), "role", F.col("e.payload").alias("payload"))


def fold(log: DataFrame) -> DataFrame:
    """conv_id, _turn, role, text: the final messages. What stands before the last edit or regeneration is gone."""
    events = log.groupBy("conv_id", "_turn", "msg").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "payload"))).alias("e"))
    resets = F.filter(F.col("e"), lambda x: x["kind"].isin("edit", "regenerate"))
    events = events.withColumn("_from", F.coalesce(F.try_element_at(resets, F.lit(-1))["seq"], F.lit(-1)))
    live = F.filter(F.col("e"), lambda x: (x["seq"] >= F.col("_from")) & x["kind"].isin("delta", "edit"))
    return events.select("conv_id", "_turn", F.col("e")[0]["role"].alias("role"), F.array_join(F.transform(live, lambda x: x["payload"]), "").alias("text"))


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_runs: one row for each conversation."""
    role, text = _head(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    written = messages.select(
        "conv_id",
        F.struct(
            F.col("_turn").alias("turn"),
            F.col("role").alias("role"),
            F.concat(head, text, F.lit(END + "\n")).alias("piece"),
            F.length(head).alias("skip"),
            F.when(F.col("role").isin(*loss_roles), F.length(text)).otherwise(0).alias("take"),
        ).alias("t"),
    )
    turns = written.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["skip"].alias("skip"), x["take"].alias("take"))).alias("loss_runs"),
    )


def parse(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text) and loss (the unescaped text under each run), read from the output alone."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), F.lit(2), F.size("loss_runs") + 1)
    body = lambda p: F.substring(p, F.lit(1), F.length(p) - len(END) - 1)
    head = lambda p: F.regexp_extract(p, r"(?s)^((?:[^\\\n]|\\.)*+)\n", 1)
    turn = lambda p: F.struct(unescape(head(p)).alias("role"), unescape(F.substring(body(p), F.length(head(p)) + 2, F.length(p))).alias("text"))
    read = formatted.withColumn("_p", pieces)
    loss = F.zip_with("_p", "loss_runs", lambda p, r: F.when(r["take"] > 0, unescape(F.substring(p, r["skip"] - len(START) + 1, r["take"]))).otherwise(""))
    return read.select("conv_id", "formatted", F.transform("_p", turn).alias("turns"), loss.alias("loss"))


def digests(parsed: DataFrame) -> DataFrame:
    """The columns that tell whether a format keeps what it was given."""
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
