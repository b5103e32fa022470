"""Chat formatting in Spark expressions.

Template: each block of adjacent turns of one role is
``<turn ROLE>\\n`` + its texts, joined by ``<part/>``, + ``</turn>\\n``.
Inside roles and texts, control strings are escaped reversibly with a
backslash, so that none of them occurs unescaped but as markup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD_END, PART, CLOSE = "<turn ", ">\n", "<part/>", "</turn>\n"
#: Each of these starts a control string; a backslash escape breaks it up.
_CONTROL = ("<turn", "</turn", "<part")


def escape(text: Column) -> Column:
    """Escape backslashes, then every start of a control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\s"))
    for control in _CONTROL:
        out = F.replace(out, F.lit(control), F.lit("\\l" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    """Exact inverse of ``escape``: every backslash is followed by s, l or g."""
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(out, F.lit("\\s"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, pieces, loss_mask, n_blocks.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Null
    texts and roles count as empty, null turns come first, rows that tie on
    turn are ordered by role and text, repeated rows are kept, and rows with
    a null conv_id form one conversation. ``pieces`` concatenates to
    ``formatted``; ``loss_mask`` has a boolean for each piece, true exactly on
    the texts of ``trained_role``.
    """
    clean = turns.select(
        F.col("conv_id"),
        F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    chats = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # the places where the role changes; each run between two of them is a block
    chats = chats.withColumn(
        "starts",
        F.filter(
            F.sequence(F.lit(1), F.size("turns")),
            lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]),
        ),
    )
    chats = chats.withColumn("ends", F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("turns") + 1)))
    blocks = F.zip_with(
        "starts",
        "ends",
        lambda a, b: F.struct(F.element_at("turns", a)["role"].alias("role"), F.transform(F.slice("turns", a, b - a), lambda t: escape(t["text"])).alias("texts")),
    )
    chats = chats.withColumn("blocks", blocks)

    def block_pieces(block: Column) -> Column:
        trained = block["role"] == trained_role
        head = F.struct(F.concat(F.lit(OPEN), _escape_role(block["role"]), F.lit(HEAD_END)).alias("s"), F.lit(False).alias("loss"))
        last = F.size(block["texts"]) - 1
        body = F.flatten(
            F.transform(
                block["texts"],
                lambda text, i: F.array(
                    F.struct(text.alias("s"), trained.alias("loss")),
                    F.struct(F.when(i < last, PART).otherwise(CLOSE).alias("s"), F.lit(False).alias("loss")),
                ),
            )
        )
        return F.concat(F.array(head), body)

    chats = chats.select("conv_id", F.size("blocks").cast("long").alias("n_blocks"), F.flatten(F.transform("blocks", block_pieces)).alias("marked"))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("marked", lambda p: p["s"]), "").alias("formatted"),
        F.transform("marked", lambda p: p["s"]).alias("pieces"),
        F.transform("marked", lambda p: p["loss"]).alias("loss_mask"),
        "n_blocks",
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, in order."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(_after_head(b), PART),
                lambda text: F.struct(_role(b).alias("role"), unescape(text).alias("text")),
            ),
        )
    )


def _role(block: Column) -> Column:
    return unescape(F.substring_index(F.substr(block, F.lit(len(OPEN) + 1)), HEAD_END, 1))


def _after_head(block: Column) -> Column:
    return F.substr(block, F.position(F.lit(HEAD_END), block) + len(HEAD_END))


def read_loss(pieces: Column, loss_mask: Column) -> Column:
    """The text under the loss mask, unescaped, with nothing between."""
    masked = F.filter(F.arrays_zip(pieces.alias("s"), loss_mask.alias("loss")), lambda p: p["loss"])
    return F.array_join(F.transform(masked, lambda p: unescape(p["s"])), "")
