"""Mix sources to target weights: block quotas by Sainte-Lague, then a seeded selection of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areaflow.llm.common import body_key, keep_copies, table, whole_text, with_prefix_sums, word_count
from areaflow.session import cut_lineage

BLOCK = 64
SHARDS = 8
SEED = 17
MOST = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """Target words of each source: its weight's share, held to `most` times its size.

    `sizes` has one row per source (source, source_size).  Sources in code point
    order, null last, take the weights in turn.  What a held source leaves is shared
    again by weight until none is above; each round adds two numbers over the
    sources, so only those reach the driver.
    """
    one = sizes.select("source", "source_size", F.lit(1).cast("bigint").alias("one"),
                       F.col("source").isNull().alias("last"))
    ranked = with_prefix_sums(one, ["last", "source"], ["one", "source_size"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          ((F.col("before_one") % len(weights)) + 1).cast("int"))
    rows = cut_lineage(ranked.select(
        "source", "source_size", F.col("before_one").alias("source_rank"), weight.cast("bigint").alias("weight"),
        (F.col("source_size") * most).alias("cap"), F.col("total_source_size").alias("all_words"),
        F.col("total_one").alias("n_sources")))
    level = 0.0
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        got = rows.agg(F.max("all_words").alias("words"), F.sum(F.when(above, F.col("cap"))).alias("held"),
                       F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        if not got["free"]:
            break
        new = (got["words"] - (got["held"] or 0)) / got["free"]
        if new == level:
            break
        level = new
    return rows.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double")))


def block_quotas(targets: DataFrame, block: int = BLOCK, shards: int = SHARDS, most: int = MOST) -> DataFrame:
    """Seats (blocks) of each source in the first 1, 2, ... `shards` shards, by highest quotients target / (2i + 1).

    Every divisor that gives the wanted number of seats lies between words / (seats
    + sources / 2) and words / (seats - sources / 2).  Seats below the one bound are
    certain, those above the other are out, and of the rest (about two a source) the
    highest quotients are taken.  Quotas of more seats never take one back, so the
    differences are the quotas of single shards.
    """
    rows = targets.where("target > 0").withColumns({
        "blocks": F.expr(f"(source_size + {block - 1}) div {block}"),
        "all_seats": F.expr(f"(all_words + {block // 2}) div {block}"),
        "shard": F.explode(F.sequence(F.lit(1), F.lit(shards)))}).withColumn(
        "seats", F.expr(f"all_seats * shard div {shards}"))
    low = F.when(F.col("seats") * 2 > F.col("n_sources"), F.floor(
        F.col("target") * (F.col("seats") - F.col("n_sources") / 2) / F.col("all_words") + 0.5)).otherwise(0)
    high = F.floor(F.col("target") * (F.col("seats") + F.col("n_sources")) / F.col("all_words") + 0.5) + 2
    bound = rows.withColumns({"sure": F.least(low, F.col("blocks") * most).cast("bigint"),
                              "end": F.least(high, F.col("blocks") * most).cast("bigint")})
    left = bound.groupBy(F.col("shard").alias("_s")).agg((F.max("seats") - F.sum("sure")).alias("open"))
    asked = bound.where("end > sure").select(
        "source_rank", "shard", "target", F.explode(F.expr("sequence(sure, end - 1)")).alias("seat"))
    by_quotient = Window.partitionBy("shard").orderBy(
        (F.col("target") / (F.col("seat") * 2 + 1)).desc(), "source_rank")
    won = asked.withColumn("place", F.row_number().over(by_quotient)).join(
        F.broadcast(left), F.col("shard") == F.col("_s")).where("place <= open").groupBy(
        F.col("source_rank").alias("_r"), F.col("shard").alias("_h")).agg(F.count("*").alias("more"))
    return bound.join(won, (F.col("source_rank") == F.col("_r")) & (F.col("shard") == F.col("_h")), "left").select(
        "source", "source_rank", "shard", "blocks", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("quota"))


def taken_before(x: Column, block: int) -> Column:
    """Words the mix takes from the first x words of a source.

    Blocks are taken in a circle from `start` on, `quota` of them in all: every block
    `full` times and `rest` blocks once more.
    """
    m, over = F.floor(x / block).cast("bigint"), x % block
    first = F.least(F.greatest(F.least(m, F.col("blocks")) - F.col("start"), F.lit(0)), F.col("rest"))
    wrapped = F.least(m, F.greatest(F.col("start") + F.col("rest") - F.col("blocks"), F.lit(0)))
    inside = (F.pmod(m - F.col("start"), F.col("blocks")) < F.col("rest")).cast("bigint")
    return (F.col("full") * m + first + wrapped) * block + over * (F.col("full") + inside)


def mix(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED,
        weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """Words that the mix takes of each document: doc_id, body, source, size, source_size, target, taken.

    A source is one stream of words, its documents in seeded order, cut into blocks of
    `block` words.  Each source gives as many blocks as its quota says, from a seeded
    block on and round again, so at most two documents a pass are cut.  A null text
    or one of white space has size 0 and takes 0; a null source is a source of its
    own; repeated rows are documents of their own; sources without words have target
    0; an empty table gives no rows.  Reads doc_id, text and source only.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"),
                         F.coalesce("source", F.lit(""))).cast("binary"))
    facts = cut_lineage(docs.select("doc_id", "source", word_count(whole_text()).alias("size"), key.alias("key"),
                                    body_key().alias("body")).withColumn("bucket", F.substring("key", 1, 3)))
    targets = cut_lineage(source_targets(facts.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    quotas = block_quotas(targets, block, shards, most).where(F.col("shard") == shards)
    seeded = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8),
                    16, 10).cast("bigint")
    plan = targets.join(quotas.select(F.col("source_rank").alias("_q"), "quota", "blocks"),
                        F.col("source_rank") == F.col("_q"), "left").select(
        F.col("source").alias("_source"), "source_size", "target", seeded.alias("seeded"),
        F.coalesce("blocks", F.lit(1)).alias("blocks"), F.coalesce("quota", F.lit(0)).alias("quota")).withColumns({
            "full": F.expr("quota div blocks"), "rest": F.col("quota") % F.col("blocks"),
            "start": F.col("seeded") % F.col("blocks")})
    # The stream of a source in (bucket, key) order: bucket totals first, then rows inside a bucket.
    parts = facts.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"),
                           F.coalesce(F.sum("part").over(ahead), F.lit(0)).alias("_ahead")).join(
        plan, F.col("_s").eqNullSafe(F.col("_source")))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    rows = facts.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    begin = F.col("_ahead") + F.col("_in")
    return rows.select("doc_id", "body", "source", "size", "source_size", "target",
                       (taken_before(begin + F.col("size"), block) - taken_before(begin, block)).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs as often as the mix takes them, all columns.

    A document whose words are taken in part counts as whole when half of them or more
    are; that concerns the first and last document of each pass over a source.
    """
    taken = mix(docs, **options)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    return keep_copies(docs, taken.select("doc_id", "body", copies.alias("copies")))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
