"""Preference formatting: a chosen and a rejected conversation with their common turns rendered once.

Only DataFrame functions. Turns are rows (pair_id, turn, role, text). The two
conversations of a pair are joined turn by turn, so the longest common turn
prefix is a minimum per pair (pre-aggregated), however long a conversation is.
The common turns make the prompt; the rest of each side makes its completion,
in segments with a loss mask: the text of assistant turns counts, turn headers
and other roles do not.

:func:`segments` keeps one row per segment and needs no row as long as a
conversation; :func:`preference_pairs` puts each pair in one row.

Defined results: a null role or text is empty; a null turn comes first; rows
that repeat a turn stand in order of role and text, and a turn is common when
all of its rows are. Equal conversations are all prompt, with empty
completions. A pair with one side only has an empty prompt and an empty
completion on the other side. A null pair_id is a pair. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The chat template.
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"

_NO_TURN = -(1 << 62)


def _turns(table: DataFrame) -> DataFrame:
    row = F.struct(F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return (table.select(F.col("pair_id").cast("long").alias("pair_id"), F.coalesce(F.col("turn").cast("long"), F.lit(_NO_TURN)).alias("turn"), row.alias("row"))
            .groupBy("pair_id", "turn").agg(F.array_sort(F.collect_list("row")).alias("rows")))


def segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, part (prompt, chosen, rejected), turn, place, text, loss: what each turn adds to each part."""
    a, b = _turns(chosen).withColumnRenamed("rows", "mine"), _turns(rejected).withColumnRenamed("rows", "theirs")
    key = [F.col("a.pair_id").eqNullSafe(F.col("b.pair_id")), F.col("a.turn") == F.col("b.turn")]
    both = (a.alias("a").join(b.alias("b"), key[0] & key[1], "full")
            .select(F.coalesce("a.pair_id", "b.pair_id").alias("pair_id"), F.coalesce("a.turn", "b.turn").alias("turn"), "mine", "theirs"))
    differs = ~F.col("mine").eqNullSafe(F.col("theirs"))
    first = both.where(differs).groupBy(F.col("pair_id").alias("pair")).agg(F.min("turn").alias("split"))
    both = both.join(first, F.col("pair_id").eqNullSafe(F.col("pair")), "left")
    common = F.col("split").isNull() | (F.col("turn") < F.col("split"))

    def sides(part: str, rows: Column) -> Column:
        return F.transform(F.coalesce(rows, F.array()), lambda r, i: F.struct(F.lit(part).alias("part"), i.alias("place"), r["role"].alias("role"), r["text"].alias("text")))

    rows = F.when(common, sides("prompt", F.col("mine"))).otherwise(F.concat(sides("chosen", F.col("mine")), sides("rejected", F.col("theirs"))))
    flat = both.select("pair_id", "turn", F.explode(rows).alias("s")).select("pair_id", "turn", "s.*")
    opening, closing = OPEN.split("{}")
    pieces = F.array(
        F.struct((F.col("place") * 2).alias("place"), F.concat(F.lit(opening), "role", F.lit(closing)).alias("text"), F.lit(False).alias("loss")),
        F.struct((F.col("place") * 2 + 1).alias("place"), F.concat("text", F.lit(CLOSE)).alias("text"),
                 ((F.col("role") == "assistant") & (F.col("part") != "prompt")).alias("loss")))
    return flat.select("pair_id", "part", "turn", F.explode(pieces).alias("p")).select("pair_id", "part", "turn", "p.place", "p.text", "p.loss")


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, prompt_turns, prompt, and for each side its segments: array of (text, loss)."""
    rows = segments(chosen, rejected)
    piece = F.struct("turn", "place", "text", "loss")

    def of(part: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(F.col("part") == part, piece)))
        return F.transform(ordered, lambda s: F.struct(s["text"].alias("text"), s["loss"].alias("loss"))).alias(part)

    turns = F.countDistinct(F.when(F.col("part") == "prompt", F.col("turn"))).alias("prompt_turns")
    grouped = rows.groupBy("pair_id").agg(turns, of("prompt"), of("chosen"), of("rejected"))
    return grouped.withColumn("prompt", F.array_join(F.transform("prompt", lambda s: s["text"]), ""))


def completion(side: str) -> Column:
    """The text of a side's completion."""
    return F.array_join(F.transform(side, lambda s: s["text"]), "")


def mask(side: str) -> Column:
    """Its loss mask as runs of characters: ``length:0`` or ``length:1`` of each segment, with commas."""
    return F.array_join(F.transform(side, lambda s: F.concat(F.length(s["text"]).cast("string"), F.lit(":"), s["loss"].cast("int").cast("string"))), ",")


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs from a table of conversations (conv_id, turn, role, text).

    Chosen: each conversation as it is. Rejected: the same with its last
    assistant reply replaced by that of the neighbouring conversation (conv_id
    with its last bit flipped; empty where there is none). Turns after that
    reply belong to both completions.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    last = rows.where("role = 'assistant' and turn is not null").groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("reply"))
    ends = last.select(F.col("pair_id").alias("id"), F.col("reply.turn").alias("last"))
    others = last.select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("id"), F.col("reply.text").alias("other"))
    ends = ends.join(others, "id", "left")
    known = rows.join(ends, F.col("pair_id").eqNullSafe(F.col("id")), "left")
    reply = (F.col("role") == "assistant") & F.col("turn").eqNullSafe(F.col("last")) & F.col("last").isNotNull()
    swapped = F.when(reply, F.coalesce("other", F.lit(""))).otherwise(F.col("text"))
    return known.select("pair_id", "turn", "role", "text"), known.select("pair_id", "turn", "role", swapped.alias("text"))
