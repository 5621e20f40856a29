"""Chat formatting as a relation: one formatted text and one loss mask for each conversation.

Turns are collected as structs, sorted by turn, and neighbours of the same role are merged into one block. The
template is

    <|im_start|>role NEWLINE text<|im_next|>text<|im_end|> NEWLINE

where ``<|im_next|>`` stands between merged turns, so that every turn can be read back. Inside texts and roles a
backslash is doubled and ``<|`` becomes ``<\\|``; in roles a line break becomes ``\\n``. No control string can then
come from a text, and reading back undoes it.

Defined cases: a NULL or empty text is an empty turn; a NULL role is the empty role; NULL ``conv_id`` is one
conversation; turns with equal numbers (ties, repeated rows) are ordered by role and text, NULL turn first; an
empty table gives no rows; extra columns are ignored. A conversation is one output row, so its turns meet in one
task by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\([\\|])", "$1")).otherwise(text)


def unescape_role(role: Column) -> Column:
    # A line break is a backslash that no pair of backslashes takes up, before an n.
    broken = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(broken)


def format_chats(rows: DataFrame) -> DataFrame:
    """``conv_id, formatted, mask`` from rows (conv_id, turn, role, text).

    ``mask`` cuts the formatted text into runs of ``chars`` code points; training looks at runs with ``loss``.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    t, s = F.col("turns"), F.col("starts")
    changed = lambda i: (i == 0) | (t[i]["role"] != t[F.greatest(i - 1, F.lit(0))]["role"])
    turns = turns.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size(t) - 1), changed))

    def block(start: Column, j: Column) -> Column:
        stop = F.coalesce(F.get(s, j + 1), F.size(t))
        texts = F.transform(F.slice(t, start + 1, stop - start), lambda x: escape(x["text"]))
        return F.struct(t[start]["role"].alias("role"), texts.alias("texts"))

    merged = turns.select("conv_id", F.transform(s, block).alias("blocks"))
    whole = lambda b: F.concat(F.lit(START), escape_role(b["role"]), F.lit("\n"), F.array_join(b["texts"], NEXT), F.lit(END))
    run = lambda n, loss: F.struct(n.cast("int").alias("chars"), loss.alias("loss"))

    def runs(b: Column) -> Column:
        head = F.length(escape_role(b["role"])) + len(START) + 1
        learned = b["role"] == LOSS_ROLE
        before = lambda i: F.when(i == 0, head).otherwise(len(NEXT))
        pairs = F.transform(b["texts"], lambda x, i: F.array(run(before(i), F.lit(False)), run(F.length(x), learned)))
        return F.concat(F.flatten(pairs), F.array(run(F.lit(len(END)), F.lit(False))))

    blocks = F.col("blocks")
    return merged.select(
        "conv_id",
        F.array_join(F.transform(blocks, whole), "").alias("formatted"),
        F.flatten(F.transform(blocks, runs)).alias("mask"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """The turns (role, text) back from formatted texts, as the array ``turns``; all other columns stay."""
    pieces = F.split(F.col("formatted"), r"<\|im_start\|>", -1)

    def turns_of(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(END))
        return F.transform(
            F.split(body, r"<\|im_next\|>", -1),
            lambda x: F.struct(unescape_role(role).alias("role"), unescape(x).alias("text")),
        )

    # The first piece is what stands before the first marker: nothing.
    return formatted.withColumn("turns", F.flatten(F.transform(F.slice(pieces, 2, F.size(pieces)), turns_of)))


def masked_texts(text: Column, mask: Column) -> Column:
    """The pieces of ``text`` under the runs of ``mask`` with loss, as they stand in it."""
    none = F.array().cast("array<struct<at:int,chars:int>>")
    cuts = F.aggregate(
        mask,
        F.struct(F.lit(0).alias("at"), none.alias("cuts")),
        lambda acc, x: F.struct(
            (acc["at"] + x["chars"]).alias("at"),
            F.when(x["loss"], F.array_append(acc["cuts"], F.struct(acc["at"].alias("at"), x["chars"].alias("chars")))).otherwise(acc["cuts"]).alias("cuts"),
        ),
        lambda acc: acc["cuts"],
    )
    return F.transform(cuts, lambda c: F.substring(text, c["at"] + 1, c["chars"]))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What a formatted text says when read back: turns, the texts under the loss mask and lengths."""
    back = read_chats(formatted)
    turns = F.col("turns")
    learned = F.array_join(F.transform(masked_texts(F.col("formatted"), F.col("mask")), unescape), "")
    told = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
