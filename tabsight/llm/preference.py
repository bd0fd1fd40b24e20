"""Preference formatting: one shared prompt and two masked completions for each pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Null turns come before all others.
FIRST_TURN = -(2**63)


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def preference_segments(turns: DataFrame) -> DataFrame:
    """Render pairs of conversations as prompt, chosen and rejected segments.

    ``turns`` has a row per message: pair_id, side ('chosen' or 'rejected'), turn, role,
    text. The prompt is the longest common prefix of both sides: all turns before the
    first one whose messages differ. It is rendered once; what follows is rendered for
    each side. Every message is a row (pair_id, part, turn, role, rendered, loss_from,
    loss_to): reading the rows of a part by turn, role and text gives its string, and
    characters from ``loss_from`` to before ``loss_to`` of an assistant message in a
    completion are trained on; both are 0 where nothing is.

    No pair is ever gathered: messages are grouped singly, and only the first differing
    turn is found for each pair (combined on the map side), so a conversation may hold
    any share of the rows.

    Equal messages of a side at the same turn count once; different ones at the same
    turn are all kept, by role and text. Null text is empty, a null role is 'user', a
    null turn comes first. Rows with a null pair_id or another side belong to no pair.
    Equal sides give a prompt alone.
    """
    named = turns.select(
        turns["pair_id"],
        turns["side"],
        F.coalesce(turns["turn"].cast("long"), F.lit(FIRST_TURN)).alias("turn"),
        F.coalesce(turns["role"], F.lit("user")).alias("role"),
        F.coalesce(turns["text"], F.lit("")).alias("text"),
    ).where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected"))
    messages = named.groupBy("pair_id", "turn", "role", "text").agg(
        F.max(F.col("side") == "chosen").alias("in_chosen"), F.max(F.col("side") == "rejected").alias("in_rejected")
    )
    # The turn is null where the sides agree, so the minimum is the first difference.
    ends = messages.groupBy("pair_id").agg(F.min(F.when(F.col("in_chosen") != F.col("in_rejected"), F.col("turn"))).alias("fork"))
    parts = F.when(F.col("fork").isNull() | (F.col("turn") < F.col("fork")), F.array(F.lit("prompt"))).otherwise(
        F.array_compact(F.array(F.when(F.col("in_chosen"), "chosen"), F.when(F.col("in_rejected"), "rejected")))
    )
    cut = messages.join(ends, "pair_id").select("pair_id", F.explode(parts).alias("part"), "turn", "role", "text")
    trained = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    rendered = F.concat(header(F.col("role")), F.col("text"), F.lit("<|end|>\n"))
    return cut.select(
        "pair_id",
        "part",
        F.when(F.col("turn") != FIRST_TURN, F.col("turn")).alias("turn"),
        "role",
        rendered.alias("rendered"),
        F.when(trained, F.length(header(F.col("role")))).otherwise(0).cast("long").alias("loss_from"),
        F.when(trained, F.length(rendered)).otherwise(0).cast("long").alias("loss_to"),
    )


def preference_examples(segments: DataFrame) -> DataFrame:
    """One row per pair: prompt, chosen and rejected strings, and the loss spans in both.

    For conversations that fit a row; ``preference_segments`` has no such bound.
    """
    piece = F.struct(F.coalesce("turn", F.lit(FIRST_TURN)).alias("turn"), "role", "rendered", "loss_from", "loss_to")

    def of(part: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("part") == part, piece)))

    def string(c: Column) -> Column:
        return F.array_join(F.transform(c, lambda x: x["rendered"]), "")

    def spans(c: Column) -> Column:
        empty = F.array().cast("array<struct<start:long,end:long>>")
        start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))
        span = lambda a, x: F.array(F.struct((a["at"] + x["loss_from"]).alias("start"), (a["at"] + x["loss_to"]).alias("end")))
        step = lambda a, x: F.struct(
            (a["at"] + F.length(x["rendered"])).alias("at"),
            F.when(x["loss_to"] > 0, F.concat(a["spans"], span(a, x))).otherwise(a["spans"]).alias("spans"),
        )
        return F.aggregate(c, start, step, lambda a: a["spans"])

    got = segments.groupBy("pair_id").agg(of("prompt").alias("p"), of("chosen").alias("c"), of("rejected").alias("r"))
    return got.select(
        "pair_id",
        string(F.col("p")).alias("prompt"),
        string(F.col("c")).alias("chosen"),
        spans(F.col("c")).alias("chosen_loss"),
        string(F.col("r")).alias("rejected"),
        spans(F.col("r")).alias("rejected_loss"),
    )


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """Pairs for a table without preferences: the chosen side is a conversation, the
    rejected side is the same up to its last assistant turn, with the last reply of the
    partner conversation (ids 2k and 2k+1 are partners) in its place.

    A conversation without assistant turn has two equal sides; without a replying
    partner the rejected side just ends early. Null conv_ids belong to no pair.
    """
    own = conversations.select(
        conversations["conv_id"].cast("long").alias("pair_id"),
        F.coalesce(conversations["turn"].cast("long"), F.lit(FIRST_TURN)).alias("turn"),
        F.coalesce(conversations["role"], F.lit("user")).alias("role"),
        conversations["text"].alias("text"),
    ).where(F.col("pair_id").isNotNull())
    last = own.where(F.col("role") == "assistant").groupBy("pair_id").agg(F.max("turn").alias("last"))
    sided = own.join(last, "pair_id", "left")
    kept = F.when(F.col("last").isNull() | (F.col("turn") < F.col("last")), F.array(F.lit("chosen"), F.lit("rejected")))
    straight = sided.select("pair_id", F.explode(kept.otherwise(F.array(F.lit("chosen")))).alias("side"), "turn", "role", "text")
    replies = sided.where((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"))
    # The partner's reply stands at this conversation's last assistant turn.
    lent = (
        replies.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), "role", "text")
        .join(last, "pair_id")
        .select("pair_id", F.lit("rejected").alias("side"), F.col("last").alias("turn"), "role", "text")
    )
    both = straight.unionByName(lent)
    return both.withColumn("turn", F.when(F.col("turn") != FIRST_TURN, F.col("turn")))
