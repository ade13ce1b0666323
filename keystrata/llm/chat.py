"""Chat formatting by a declarative template and a role automaton (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A role's text between its marks, and whether the text bears loss.
TEMPLATE = {
    "system": {"open": "[SYS] ", "close": " [/SYS]", "loss": False},
    "user": {"open": "[INST] ", "close": " [/INST]", "loss": False},
    "assistant": {"open": "[OUT] ", "close": "</s>", "loss": True},
}
#: Any other role is named in its opening mark, in hexadecimal.
OTHER_OPEN, OTHER_CLOSE = "[TURN ", " [/TURN]"
#: Transitions of the automaton; what is missing leads to "invalid" and stays there.
TRANSITIONS = {
    "start|system": "system",
    "start|user": "user",
    "system|user": "user",
    "user|assistant": "assistant",
    "assistant|user": "user",
}
_CONTROL = r"(/?INST\]|/?SYS\]|OUT\]|/?TURN|/?s>)"


def escape(text: Column) -> Column:
    """Put a backslash behind the first character of every control string, and of every such
    string that already has backslashes there, so that ``unescape`` is exact."""
    return F.regexp_replace(text, r"([\[<])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])\\(\\*)" + _CONTROL, r"$1$2$3")


def _by_role(role: Column, what: str, other: Column) -> Column:
    out = other
    for name, marks in TEMPLATE.items():
        out = F.when(role == name, F.lit(marks[what])).otherwise(out)
    return out


def final_state(turns: Column) -> Column:
    """The automaton's state after all turns: the last role, "start" or "invalid"."""
    table = F.create_map(*[F.lit(x) for pair in TRANSITIONS.items() for x in pair])
    return F.aggregate(
        turns,
        F.lit("start"),
        lambda state, turn: F.coalesce(
            F.try_element_at(table, F.concat_ws("|", state, F.coalesce(turn["role"], F.lit("")))), F.lit("invalid")
        ),
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row a conversation: its text segments with loss flags, and their concatenation.

    Turns are sorted by turn, then role, then text (nulls first); repeated rows are repeated
    turns.  Null text is empty, null role is the empty role.  Roles outside the template are
    kept under a mark that names them.  A conversation whose roles the automaton rejects is
    formatted all the same and has ``valid`` false.  A null conv_id is a conversation of its
    own.  Other columns are ignored, and an empty table gives an empty result.  A conversation is one string by definition, so its turns
    must fit a row (2 GB).

    Returns conv_id, valid, segments (array of text, loss), formatted.
    """
    turns = F.array_sort(
        F.collect_list(
            F.struct(
                "turn",
                F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text"),
            )
        )
    )

    def emit(turn: Column) -> Column:
        role = turn["role"]
        mark = F.concat(F.lit(OTHER_OPEN), F.hex(F.encode(role, "UTF-8")), F.lit("] "))
        return F.array(
            F.struct(_by_role(role, "open", mark).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"]).alias("text"), _by_role(role, "loss", F.lit(False)).alias("loss")),
            F.struct(_by_role(role, "close", F.lit(OTHER_CLOSE)).alias("text"), F.lit(False).alias("loss")),
        )

    state = final_state(F.col("turns"))
    return (
        conversations.groupBy("conv_id")
        .agg(turns.alias("turns"))
        .select(
            "conv_id",
            (state != "invalid").alias("valid"),
            F.flatten(F.transform("turns", emit)).alias("segments"),
        )
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def parse_turns(formatted: Column) -> Column:
    """Turns (role, text) read back from a formatted conversation."""
    pieces = F.split(formatted, r"(?<=\[/SYS\]|\[/INST\]|\[/TURN\]|</s>)")

    def read(piece: Column) -> Column:
        head = F.regexp_extract(piece, r"^\[TURN ([0-9A-F]*)\] ", 1)
        role = F.decode(F.unhex(head), "UTF-8")
        width = F.length(head) + len(OTHER_OPEN) + 2
        tail = F.lit(len(OTHER_CLOSE))
        for name, marks in TEMPLATE.items():
            here = F.startswith(piece, F.lit(marks["open"]))
            role = F.when(here, F.lit(name)).otherwise(role)
            width = F.when(here, F.lit(len(marks["open"]))).otherwise(width)
            tail = F.when(here, F.lit(len(marks["close"]))).otherwise(tail)
        body = F.substr(piece, width + 1, F.length(piece) - width - tail)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(F.filter(pieces, lambda p: p != ""), read)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])),
        "",
    )
