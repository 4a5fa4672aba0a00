"""Benchmark decontamination: a positional inverted index of the corpus answers phrase and proximity searches."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areaflow.llm.common import ascii_lower, remove_folder, table, whole_text
from areaflow.session import checkpoint_dir, cut_lineage

#: Words of the contract after A-Z have become a-z: digits, a-z and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW_WORDS = 10
#: Rows (of some tens to hundreds of bytes) up to which a table made from the test items is broadcast.
BROADCAST_ROWS = 200_000
#: Term of the posting behind a document's last word; its position is the number of words.
END = -1


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most `rows` rows; else Spark chooses, and splits skewed keys."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@dataclass
class PhraseIndex:
    """Postings of the corpus for the terms of the test items, and the windows to search for."""

    postings: DataFrame  # row_id, doc_id, term, pos: a row for each place of a test term, and one END posting a document
    windows: DataFrame   # window, n_words, lists: (n, term, offset) of its words, rarest first; only windows all of whose terms stand
    holders: DataFrame   # window, item_id: the items that hold the window
    folder: str          # of the stored postings
    broadcast_rows: int

    def drop(self) -> None:
        remove_folder(self.postings.sparkSession, self.folder)


def _terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), ascii_lower)


def item_windows(items: DataFrame, words: int = WINDOW_WORDS) -> DataFrame:
    """item_id, terms: every `words` consecutive words of an item, or all words of one that has fewer but some."""
    split = items.select("item_id", _terms(whole_text()).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - words + 1, F.lit(1)))
    return split.withColumn("at", F.explode(starts)).select("item_id", F.slice("all", F.col("at"), words).alias("terms")).distinct()


def build_index(docs: DataFrame, items: DataFrame, words: int = WINDOW_WORDS, broadcast_rows: int = BROADCAST_ROWS) -> PhraseIndex:
    """Read the corpus once and store the postings of all terms that the items hold.

    A document gets a row number, which stays because the postings are written at
    once; null and repeated ids are documents of their own.  Equal windows of several
    items are searched for once.
    """
    spark = docs.sparkSession
    held = cut_lineage(item_windows(items, words))
    windows = cut_lineage(held.select("terms").distinct().withColumn("window", F.monotonically_increasing_id()))
    vocabulary = cut_lineage(windows.select(F.explode("terms").alias("word")).distinct().select(
        "word", F.monotonically_increasing_id().alias("term")))
    known = vocabulary.union(spark.range(1).select(F.lit("").alias("word"), F.lit(END).cast("bigint").alias("term")))
    numbered = docs.select("doc_id", whole_text().alias("text"), F.monotonically_increasing_id().alias("row_id"))
    placed = numbered.select("doc_id", "row_id", F.posexplode(F.array_append(
        F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lit(""))).alias("pos", "raw"))
    postings = placed.withColumn("word", ascii_lower(F.col("raw"))).join(_small(known, broadcast_rows), "word").select(
        "row_id", "doc_id", "term", "pos")
    folder = f"{checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}"
    postings.write.parquet(folder)
    stored = spark.read.parquet(folder)
    counts = stored.groupBy("term").agg(F.count("*").alias("n"))
    spread = windows.select("window", F.size("terms").alias("n_words"), F.posexplode("terms").alias("offset", "word"))
    # Counted terms are joined by word at once: a frequent word of the items is no key of a shuffle then.
    counted = cut_lineage(vocabulary.join(counts, "term"))
    lists = spread.join(_small(counted, broadcast_rows), "word").groupBy("window", "n_words").agg(
        F.sort_array(F.collect_list(F.struct("n", "term", "offset"))).alias("lists")).where(F.size("lists") == F.col("n_words"))
    holders = held.join(windows, "terms").select("window", "item_id")
    return PhraseIndex(stored, cut_lineage(lists), cut_lineage(holders), folder, broadcast_rows)


def _standing(wanted: DataFrame, postings: DataFrame, reach: int) -> DataFrame:
    """Rows of wanted (row_id, term, at, ...) whose document has the term at most `reach` words from `at`."""
    p = postings.select(F.col("row_id").alias("_row"), F.col("term").alias("_term"), F.col("pos").alias("_pos"))
    same = (F.col("row_id") == F.col("_row")) & (F.col("term") == F.col("_term"))
    if reach == 0:
        return wanted.join(p, same & (F.col("at") == F.col("_pos")), "left_semi")
    width = 2 * reach + 1
    cells = F.array_distinct(F.array(F.floor((F.col("at") - reach) / width), F.floor((F.col("at") + reach) / width)))
    near = wanted.withColumn("cell", F.explode(cells)).join(
        p.withColumn("_cell", F.floor(F.col("_pos") / width)),
        same & (F.col("cell") == F.col("_cell")) & (F.abs(F.col("at") - F.col("_pos")) <= reach), "left_semi")
    return near.drop("cell").distinct()


def matches(index: PhraseIndex, reach: int | None = None) -> DataFrame:
    """row_id, window, at, n_words: where windows stand in documents.

    Without `reach`, exact phrases: at is the first word's number.  With it, places of
    the window's rarest term (at) with every other term of the window at most `reach`
    words away, in any order.

    The list of the rarest term gives the candidates, moved back by the term's offset.
    They are intersected with the moved list of the second rarest term, and what is
    left with all other lists at once.  Joins are keyed by document, place and term,
    so a frequent term is spread over all tasks.
    """
    exact = reach is None
    lists = F.col("lists") if exact else F.expr(
        "filter(lists, (x, i) -> i = 0 or not exists(slice(lists, 1, i), y -> y.term = x.term))")
    probes = index.windows.select("window", "n_words", lists.alias("lists")).select(
        "window", "n_words", F.col("lists")[0]["term"].alias("term"), (F.col("lists")[0]["offset"] if exact else F.lit(0)).alias("back"),
        F.expr("transform(slice(lists, 2, size(lists)), x -> struct(x.term as term, %s as shift))" % (
            "x.offset" if exact else "0")).alias("rest"))
    places = index.postings.select("row_id", "term", "pos")
    first = places.join(_small(probes, index.broadcast_rows), "term").select(
        "row_id", "window", "n_words", (F.col("pos") - F.col("back")).alias("at"), "rest")

    def at_shift(k: Column) -> Column:
        return F.struct((F.col("at") + k["shift"]).alias("at"), k["term"].alias("term"))

    seconds = probes.where(F.size("rest") > 0).select(F.col("rest")[0]["term"].alias("term")).distinct()
    second_places = places.join(_small(seconds, index.broadcast_rows), "term", "left_semi")
    key = ["row_id", "window", "n_words", "base", "rest"]
    wanted = first.where(F.size("rest") > 0).withColumnRenamed("at", "base").select(
        *key, (F.col("base") + F.col("rest")[0]["shift"]).alias("at"), F.col("rest")[0]["term"].alias("term"))
    two = cut_lineage(_standing(wanted, second_places, reach or 0).select(*key))
    alive = two.where(F.size("rest") > 1)
    rows = cut_lineage(alive.select("row_id").distinct())
    alive_places = places.join(_small(rows, 10 * index.broadcast_rows), "row_id", "left_semi")
    spread = alive.select("row_id", "window", "n_words", "base", (F.size("rest") - 1).alias("need"),
                          F.explode(F.slice("rest", F.lit(2), F.size("rest"))).alias("k")).select(
        "row_id", "window", "n_words", "base", "need", (F.col("base") + F.col("k.shift")).alias("at"), F.col("k.term").alias("term"))
    full = _standing(spread, alive_places, reach or 0).groupBy("row_id", "window", "n_words", "base", "need").agg(
        F.count("*").alias("got")).where("got = need")
    columns = ["row_id", "window", "base as at", "n_words"]
    return full.selectExpr(*columns).union(two.where(F.size("rest") == 1).selectExpr(*columns)).union(
        first.where(F.size("rest") == 0).select("row_id", "window", "at", "n_words"))


def contamination(docs: DataFrame, items: DataFrame, words: int = WINDOW_WORDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit words stand inside an occurrence of an item's window, n_items items have such
    a window.  Items are told apart by item_id (as text; a null one is an empty text),
    and those of repeated rows and equal ids count once.  A null text has no words, an
    item without words no window.  Repeated document rows and null ids give a row each;
    empty tables give no rows or no hits.  Only doc_id and text, and item_id and text,
    are read.
    """
    index = build_index(docs, items, words, broadcast_rows)
    found = cut_lineage(matches(index))
    spans = found.groupBy("row_id", "at").agg(F.max(F.col("at") + F.col("n_words")).alias("upto"))
    earlier = Window.partitionBy("row_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("upto") - F.greatest(F.col("at"), F.coalesce(F.max("upto").over(earlier), F.lit(0))))
    hits = spans.withColumn("fresh", fresh).groupBy("row_id").agg(F.sum("fresh").alias("n_hit"))
    name = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    holders = found.select("row_id", "window").join(_small(index.holders, broadcast_rows), "window").select(
        "row_id", name.alias("item")).distinct().groupBy("row_id").agg(
        F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    ends = index.postings.where(F.col("term") == END).select("row_id", "doc_id", F.col("pos").cast("bigint").alias("n_words"))
    zero = F.lit(0).cast("bigint")
    result = cut_lineage(ends.join(hits, "row_id", "left").join(holders, "row_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated")))
    index.drop()
    return result


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
