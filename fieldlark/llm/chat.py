"""Chat formatting with Spark expressions only.

A conversation's turn structs are collected and sorted, adjacent turns of one
role are merged into a block, and the blocks concatenated:

    ### user: first text</turn>second text</turn>
    ### assistant: an answer</turn>

Inside roles and texts a backslash and the two control strings are written as
backslash and a digit, so that the output holds the control strings only where
the template put them, and reading it back gives every text as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

HEAD, MIND, END = "### ", ": ", "</turn>"
#: What is escaped, in this order; undone in the reverse one.
ESCAPES = [("\\", "\\0"), (END, "\\1"), (HEAD, "\\2"), (MIND, "\\3")]
#: The role whose texts bear the loss.
TRAINED = "assistant"


def escape(c: Column, role: bool = False) -> Column:
    for plain, code in ESCAPES if role else ESCAPES[:3]:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (code-point ranges [at, at + len) of trained texts).

    Turns go by ``turn`` (a null one first), ties by role, then text; rows that
    repeat are turns that repeat. A null role or text is the empty one; a null
    conv_id is a conversation. An output row holds a whole conversation, so one
    has to fit a row. Other columns are not read; an empty table gives an empty
    result.
    """
    rows = turns.select(
        turns[conv].cast("long").alias("conv_id"),
        F.struct(
            turns[turn].cast("long").alias("turn"),
            F.coalesce(turns[role].cast("string"), F.lit("")).alias("role"),
            F.coalesce(turns[text].cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    got = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return got.select("conv_id", common.let(common.let(F.col("turns"), _pieces), _joined).alias("f")).select("conv_id", "f.formatted", "f.loss")


def _pieces(turns: Column) -> Column:
    """The parts of a conversation in their order: of each block its header, then each text and its end."""
    begins = F.transform(turns, lambda t, i: F.when((i > 0) & (F.get(turns, F.greatest(i - 1, F.lit(0)))["role"] == t["role"]), -1).otherwise(i))
    plain = lambda s: F.struct(s.alias("s"), F.lit(False).alias("loss"))

    def block(b: Column) -> Column:
        said = F.transform(b, lambda t: F.array(F.struct(escape(t["text"]).alias("s"), (t["role"] == TRAINED).alias("loss")), plain(F.lit(END))))
        return F.concat(F.array(plain(F.concat(F.lit(HEAD), escape(b[0]["role"], True), F.lit(MIND)))), F.flatten(said))

    def merged(heads: Column) -> Column:
        blocks = F.transform(heads, lambda h, k: F.slice(turns, h + 1, F.coalesce(F.get(heads, k + 1), F.size(turns)) - h))
        return F.flatten(F.transform(blocks, lambda b, k: F.when(k == 0, block(b)).otherwise(F.concat(F.array(plain(F.lit("\n"))), block(b)))))

    return common.let(F.filter(begins, lambda i: i >= 0), merged)


def _joined(pieces: Column) -> Column:
    """The pieces' text, and the places of those that bear the loss."""

    def placed(at: Column) -> Column:
        ranges = F.transform(pieces, lambda p, i: F.struct(F.get(at, i).alias("at"), F.length(p["s"]).cast("long").alias("len"), p["loss"].alias("loss")))
        return F.transform(F.filter(ranges, lambda r: r["loss"]), lambda r: F.struct(r["at"].alias("at"), r["len"].alias("len")))

    lengths = F.transform(pieces, lambda p: F.length(p["s"]))
    return F.struct(F.array_join(F.transform(pieces, lambda p: p["s"]), "").alias("formatted"), common.let(common.running(lengths), placed).alias("loss"))


def _read(text: Column) -> Column:
    """(role, text) of each turn of a formatted conversation."""

    def block(b: Column) -> Column:
        head = F.substring_index(b, MIND, 1)
        parts = F.split(F.substr(b, F.length(head) + len(MIND) + 1), END)
        return common.let(
            F.struct(unescape(head).alias("role"), parts.alias("parts")),
            lambda x: F.transform(F.slice(x["parts"], F.lit(1), F.size(x["parts"]) - 1), lambda t: F.struct(x["role"].alias("role"), unescape(t).alias("text"))),
        )

    blocks = lambda b: F.flatten(F.transform(F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0))), block))
    return common.let(F.split(text, HEAD), blocks)


def read_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns (role, text), trained texts), all read from the formatted text and its loss ranges."""
    trained = F.transform(common.cut(F.col("formatted"), F.col("loss")), unescape)
    return chats.select("conv_id", "formatted", _read(F.col("formatted")).alias("turns"), trained.alias("trained"))


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from what is read back."""
    loss = F.array_join("trained", "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_chats(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
