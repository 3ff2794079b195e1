"""Chat formatting with a grammar round trip.

Grammar of the output::

    chat := turn*
    turn := "<s>[ROLE]" role "[/ROLE]" text "</s>"

A text or role must hold no control string. A control string is an opening ``<`` or ``[``
and a tail such as ``/s>`` or ``/ROLE]``; escaping puts one backslash between the two, and
in front of any already there, so that unescaping removes exactly one. Opening characters
never occur in a tail, so matches cannot overlap and the two steps are inverse on any text.

Each turn is first rendered as it is and parsed again; only where the parser refuses it or
gives back something else is the next level, the escaped rendering, used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.shared import plain

_OPEN_ROLE, _CLOSE_ROLE, _END = "<s>[ROLE]", "[/ROLE]", "</s>"
_TAIL = r"(/?s>|/?(?:ROLE|INST|SYS)\])"
_CONTROL = r"[<\[]" + _TAIL


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, "$1$2$3")


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(_OPEN_ROLE), role, F.lit(_CLOSE_ROLE), text, F.lit(_END))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text, sound>> of a rendered chat; ``sound`` is false where a turn
    does not follow the grammar."""
    pieces = F.split(formatted, _END, -1)
    whole = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(_OPEN_ROLE) + 1))
        role = F.substring_index(body, _CLOSE_ROLE, 1)
        text = F.substr(body, F.length(role) + len(_CLOSE_ROLE) + 1)
        return F.struct(
            unescape(role).alias("role"),
            unescape(text).alias("text"),
            (
                F.startswith(piece, F.lit(_OPEN_ROLE))
                & F.contains(body, F.lit(_CLOSE_ROLE))
                & ~role.rlike(_CONTROL)
                & ~text.rlike(_CONTROL)
            ).alias("sound"),
        )

    return F.transform(whole, turn)


def _same(rendered: Column, role: Column, text: Column) -> Column:
    turns = parse_turns(rendered)
    return (F.size(turns) == 1) & F.coalesce(
        (turns[0]["role"] == role) & (turns[0]["text"] == text) & turns[0]["sound"], F.lit(False)
    )


def format_chats(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, n_turns, mask_runs, n_escaped``.

    ``mask_runs`` holds lengths in characters, by turns without and with loss; only the
    text of ``loss_role`` turns carries loss. Turns are ordered by turn, a null turn first;
    equal turn numbers by role and text, and repeated rows all stay. A null text or role is
    the empty one; null conversation ids form one conversation. No rows give no rows. Other
    columns are not read.

    Rendering and checking happen per turn, before the one shuffle by conversation, whose
    lists are first built inside each map task. A conversation is one output value, so
    memory of a task grows with its longest conversation and with nothing else.
    """
    rows = plain(
        df, {"conv_id": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    ).select(
        "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    role, text = F.col("role"), F.col("text")
    as_is = _rendered(role, text)
    fits = rows.select("*", _same(as_is, role, text).alias("as_is"))
    used_role = F.when(F.col("as_is"), role).otherwise(escape(role))
    used_text = F.when(F.col("as_is"), text).otherwise(escape(text))
    used = fits.select(
        "conv_id", "turn", "role", "text", "as_is",
        used_role.alias("used_role"), used_text.alias("used_text"),
    )
    checked = used.select(
        "conv_id", "turn", "role", "text", "as_is",
        F.when(
            F.col("as_is") | _same(_rendered(F.col("used_role"), F.col("used_text")), role, text),
            _rendered(F.col("used_role"), F.col("used_text")),
        ).otherwise(
            F.raise_error(F.lit("a turn cannot be rendered reversibly")).cast("string")
        ).alias("rendered"),
        F.length("used_role").alias("role_chars"),
        F.length("used_text").alias("text_chars"),
    )
    fixed = len(_OPEN_ROLE) + len(_CLOSE_ROLE)
    loss = F.col("role") == loss_role
    # role and text take part in the order only; their values are read from `rendered`
    turns = checked.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "turn", "role", "rendered",
            F.when(loss, F.col("role_chars") + fixed)
             .otherwise(F.col("role_chars") + fixed + F.col("text_chars") + len(_END))
             .alias("out"),
            F.when(loss, F.col("text_chars")).otherwise(0).alias("lossy"),
            F.when(loss, len(_END)).otherwise(0).alias("after"),
        ))).alias("turns"),
        F.sum(F.when(F.col("as_is"), 0).otherwise(1)).alias("n_escaped"),
    )
    return turns.select(
        "conv_id",
        F.array_join(F.col("turns.rendered"), "").alias("formatted"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.flatten(F.transform(
            "turns", lambda t: F.array(t["out"], t["lossy"], t["after"], F.lit(0))
        )).alias("mask_runs"),
        "n_escaped",
    )


def masked_text(turns: Column, loss_role: str = "assistant") -> Column:
    """The text under the loss mask, unescaped and joined, from parsed turns."""
    kept = F.filter(turns, lambda t: t["role"] == loss_role)
    return F.array_join(F.transform(kept, lambda t: t["text"]), "")


def chat_digest(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """What can be read back from ``format_chats`` output, as counts and digests."""
    parsed = formatted.select(
        "conv_id", "formatted", "n_escaped", parse_turns(F.col("formatted")).alias("turns")
    )
    joined = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    loss = parsed.select("*", masked_text(F.col("turns"), loss_role).alias("loss"))
    return loss.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.col("n_escaped").cast("bigint").alias("n_escaped"),
    )
