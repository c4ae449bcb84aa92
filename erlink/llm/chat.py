"""Chat formatting by a grammar round trip, in DataFrame functions only.

Grammar: conversation := turn*; turn := ``<|im_start|>`` role newline text ``<|im_end|>`` newline. A text that does not come
back identical from the parser is escaped: each ``<``, backslashes, ``|`` gets one more backslash, and the parser takes one
out, so the escaped text holds no control string and no two texts have one escape. Roles escape ``%``, newline and ``|``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of a turn.
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """One more backslash between ``<`` and ``|``, however many there are."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """One backslash less; texts without an escape stay as they are."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("|"), F.lit("%7C"))


def _role_back(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%7C"), F.lit("|")), F.lit("%25"), F.lit("%"))


def _head(role: Column) -> Column:
    return F.concat(F.lit(START), _role(role), F.lit("\n"))


def segments(formatted: Column) -> Column:
    """The formatted turns of a text, each without its start mark."""
    return F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 2_000_000_000)


def parse_segment(segment: Column) -> Column:
    """struct(role, text) of a formatted turn; a turn that does not end as the grammar says has a null text."""
    at = F.instr(segment, "\n")
    body = F.substr(segment, at + 1)
    end = F.instr(body, END)
    whole = (end > 0) & (F.char_length(body) == end + len(END))
    return F.struct(_role_back(F.substr(segment, F.lit(1), at - 1)).alias("role"), F.when(whole, unescape(F.substr(body, F.lit(1), end - 1))).alias("text"))


def parse(formatted: Column) -> Column:
    """array<struct(role, text)> of a formatted conversation."""
    return F.transform(segments(formatted), parse_segment)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv, turns, formatted, mask) for each conversation.

    Turns stand in order of their number, null numbers first, ties by role and text; repeated rows are repeated turns. Null
    roles and texts are empty. ``turns`` is the source as array<struct(role, text)>, ``formatted`` the rendered text, and ``mask``
    has for each turn how many of its characters to skip and how many then count for the loss. A conversation is one value, so
    it must fit into a task; rows of one conversation are gathered once, after a partial collection.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    one = _head(F.col("role"))
    plain = F.concat(one, F.col("text"), F.lit(END + "\n"))
    raw = turns.select(F.col(conv_col).alias("_conv"), row.alias("r")).select("_conv", "r.turn", "r.role", "r.text")
    back = parse(plain)
    source = F.struct("role", "text")
    alone = (F.size(back) == 1) & F.coalesce(F.element_at(back, 1).eqNullSafe(source), F.lit(False))
    may = F.col("text").contains("<")  # else there is nothing to conflict with
    safe = raw.withColumn("safe", F.when(may & ~F.when(may, alone).otherwise(F.lit(True)), escape(F.col("text"))).otherwise(F.col("text")))
    lists = safe.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "safe"))).alias("rows"))

    def render(field: str, hard: bool) -> Column:
        return F.array_join(F.transform("rows", lambda x: F.concat(_head(x["role"]), escape(x[field]) if hard else x[field], F.lit(END + "\n"))), "")

    origin = F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    tried = lists.select("_conv", "rows", origin.alias("turns"), render("safe", False).alias("formatted"))
    again = F.when(parse(F.col("formatted")) == F.col("turns"), F.col("formatted")).otherwise(render("text", True))
    done = tried.select("_conv", "turns", again.alias("formatted"))
    mask = F.transform(segments(F.col("formatted")), lambda s: F.struct(F.instr(s, "\n").alias("skip"), F.when(F.substr(s, F.lit(1), F.instr(s, "\n") - 1) == F.lit(loss_role), F.char_length(s) - F.instr(s, "\n") - len(END) - 1).otherwise(F.lit(0)).alias("take")))
    return done.select(F.col("_conv").alias(conv_col), "turns", "formatted", mask.alias("mask"))


def digest(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What is read back from ``formatted`` and ``mask`` alone: counts, hashes of turns and of the text under the loss mask."""
    zipped = F.zip_with(segments(F.col("formatted")), F.col("mask"), lambda s, m: unescape(F.substr(s, m["skip"] + 1, m["take"])))
    read = formatted.select(conv_col, "formatted", parse(F.col("formatted")).alias("_turns"), F.array_join(zipped, "").alias("_loss"))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(conv_col, F.size("_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))
