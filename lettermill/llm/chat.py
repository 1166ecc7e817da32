"""Chat formatting with column expressions only.

Turns are collected per conversation, sorted, and merged where the same role speaks again.
Every control string starts with ``<|``. Inside texts a backslash is doubled and ``<|`` becomes
``<\\|``, so no text can hold a control string and the escape can be undone.

    <|im_start|>role            first turn of a run of turns by one role
    text<|im_sep|>text<|im_end|>

Defined results: a null text or role is empty; null turns sort first; equal turn numbers are
ordered by role, then text, and repeated rows stay; rows with a null conversation form one
conversation; an empty table gives an empty result; other columns are ignored.
One conversation becomes one string and so must fit into a row; its rows reach that row through
a map-side collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    """As :func:`escape`; a role also gives up its line ends, which close the role line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\N"))


def unescape(text: Column) -> Column:
    def plain(part: Column) -> Column:
        return F.replace(F.replace(part, F.lit("\\N"), F.lit("\n")), F.lit("\\|"), F.lit("|"))

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def format_chats(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conversation``, ``formatted`` and ``segments``.

    ``segments`` is ``formatted`` cut into (text, loss) in order; ``loss`` marks the texts of
    ``loss_role``, without separators or control strings.
    """
    rows = df.select(
        F.col(conversation).alias(conversation),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                 F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_t"))
    turns = F.col("_turns")

    def segments(t: Column, i: Column) -> Column:
        opens = (i == 0) | (t["role"] != F.get(turns, i - 1)["role"])
        closes = (i == F.size(turns) - 1) | (t["role"] != F.get(turns, i + 1)["role"])
        head = F.when(opens, F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))).otherwise(F.lit(SEP))
        tail = F.when(closes, F.lit(END + "\n")).otherwise(F.lit(""))
        return F.array(_segment(head, F.lit(False)), _segment(escape(t["text"]), t["role"] == loss_role),
                       _segment(tail, F.lit(False)))

    sorted_turns = rows.groupBy(conversation).agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    cut = sorted_turns.select(conversation, F.flatten(F.transform(turns, segments)).alias("segments"))
    return cut.select(conversation, F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, merged runs taken apart again."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda block: block != "")

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(block, "\n", 1))
        body = F.substring_index(F.substring(block, F.instr(block, "\n") + 1, F.length(block)), END, 1)
        return F.transform(F.split(body, r"<\|im_sep\|>"),
                           lambda text: F.struct(role.alias("role"), unescape(text).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(segments: Column) -> Column:
    """The text under the loss mask, escapes undone."""
    masked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(masked, lambda s: unescape(s["text"])), "")


def chat_digests(chats: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Counts and digests, read back from the output of :func:`format_chats`."""
    back = chats.select(conversation, "formatted", read_turns(F.col("formatted")).alias("_turns"),
                        read_loss(F.col("segments")).alias("_loss"))
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        conversation,
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
