"""Quality rules: counts of a document, and its distance from the character and word habits of its language."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaflow.llm.common import SPACES, table, whole_text
from areaflow.session import cut_lineage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Jensen-Shannon distances (0 to 1) above which a document is rejected, and the words below which they are not judged.
MAX_CLASS_DISTANCE = 0.25
MAX_COMMON_DISTANCE = 0.275
MIN_JUDGED_WORDS = 100
MIN_REFERENCE_DOCS = 20  # of a language without a list; below, its documents are judged by the base alone
BROADCAST_LANGS = 100_000

# Frequent short words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "was", "it"],
    "de": ["der", "die", "und", "in", "zu", "den", "das", "nicht", "von", "ist"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las"],
}
N_COMMON = 10
CLASSES = ["upper", "digit", "mark", "space", "letter"]


def squeeze(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, text)


def repeated_words(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: words inside a 3-word window that occurs twice or more in the text.

    Windows are hashed to 64 bits; only texts in which two hashes are equal sort them
    to find which words they cover.
    """
    hashed = df.withColumn("_h", F.when(F.col("n_words") >= 3, F.transform(
        F.slice("words", F.lit(1), F.col("n_words").cast("int") - 2),
        lambda w, i: F.xxhash64(w, F.col("words")[i + 1], F.col("words")[i + 2]))))
    placed = hashed.withColumn("_s", F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(F.transform("_s", lambda x, j: F.when(
        ((j > 0) & (F.get("_s", j - 1)["h"] == x["h"])) | (F.get("_s", j + 1)["h"] == x["h"]), x["i"])),
        lambda p: p.isNotNull())
    covered = F.aggregate(
        F.sort_array(twice), F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    return placed.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_s").isNotNull(), covered), F.lit(0)).cast(
        "bigint")).drop("_h", "_s")


def common_counts(spread: Column, lang: Column) -> Column:
    """How often each common word of the language stands in the text; null for a language without a list.

    `spread` is the text in lower case with two blanks at every gap, so that each
    word has blanks of its own.
    """
    listed = F.when(F.lit(False), F.lit(None).cast("array<string>"))
    for code, words in COMMON_WORDS.items():
        listed = listed.when(lang == code, F.array(*[F.lit(f" {w} ") for w in words]))
    return F.transform(listed, lambda w: (
        (F.length(spread) - F.length(F.replace(spread, w, F.lit("")))) / F.length(w)).cast("bigint"))


def profile(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of each text beside `doc`, the listed columns of its row: word and class counts, common words.

    A null text is an empty one.  Everything is computed from the whole text.
    """
    text = F.col("_text")
    rows = docs.select(F.struct(*columns).alias("doc"), whole_text().alias("_text"), F.col("lang").alias("_lang"))
    trimmed = F.btrim(text, F.lit(SPACES))
    rows = rows.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+")))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    spread = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", "  "), F.lit(" "))
    rows = rows.select(
        "doc", "words", "_lang", F.size("words").cast("bigint").alias("n_words"),
        F.length(squeeze(text)).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"), spread.alias("_spread"), F.length(text).cast("bigint").alias("_length"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
        F.regexp_count(text, F.lit(r"[0-9]")).cast("bigint").alias("n_digit"),
        F.regexp_count(text, F.lit(r"[^\p{L}\p{M}0-9\x20\x09-\x0D]")).cast("bigint").alias("n_mark"))
    rows = rows.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "common": common_counts(F.col("_spread"), F.col("_lang")),
        "n_space": F.col("_length") - F.col("word_chars"),
        "n_letter": F.col("word_chars") - F.col("n_upper") - F.col("n_digit") - F.col("n_mark")}).drop("_lines", "_spread")
    return rows


def class_shares() -> Column:
    return F.array(*[F.col(f"n_{c}") / F.greatest("_length", F.lit(1)) for c in CLASSES])


def common_shares() -> Column:
    """Share of each common word, then of all other words; null for a language without a list."""
    total = F.greatest("n_words", F.lit(1))
    others = F.col("n_words") - F.aggregate("common", F.lit(0).cast("bigint"), lambda a, c: a + c)
    return F.concat(F.transform("common", lambda c: c / total), F.array(others / total))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def references(profiles: DataFrame, min_words: int = MIN_JUDGED_WORDS) -> DataFrame:
    """_ref, ref_classes, ref_common: mean shares over the documents of each language, one row a language.

    Listed languages take all their documents of `min_words` words, as the checking SQL
    does; others only those that the base keeps, and MIN_REFERENCE_DOCS of them at
    least.  Rows without a language have no reference.  Means are rounded, so that they
    do not depend on the order of additions.
    """
    listed = F.col("_lang").isin(list(COMMON_WORDS))
    # Rows are left out inside the sums: a filter would be moved below the counts and repeat them.
    counts = (F.col("n_words") >= min_words) & (listed | ~base_failed())
    shares = profiles.select(F.col("_lang").alias("_ref"), counts.alias("counts"), class_shares().alias("c"),
                             common_shares().alias("w"))
    rows = shares.groupBy("_ref").agg(
        F.array(*[F.round(F.avg(F.when(F.col("counts"), F.col("c")[i])), 6) for i in range(len(CLASSES))]).alias("ref_classes"),
        F.array(*[F.round(F.avg(F.when(F.col("counts"), F.col("w")[i])), 6) for i in range(N_COMMON + 1)]).alias("ref_common"),
        F.count_if("counts").alias("n"))
    least = F.when(F.col("_ref").isin(list(COMMON_WORDS)), 1).otherwise(MIN_REFERENCE_DOCS)
    return cut_lineage(rows.where(F.col("n") >= least).drop("n"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, with logarithms to base 2."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2, F.lit(0.0)))


def judge(docs: DataFrame, columns: list[str] | None = None, max_class: float = MAX_CLASS_DISTANCE, max_common: float = MAX_COMMON_DISTANCE,
          min_words: int = MIN_JUDGED_WORDS) -> DataFrame:
    """Counts and verdict of every document beside `doc`, its row or the listed `columns` of it.

    base_failed: under 50 words, or over half of the words in repeated 3-word
    windows.  Else a document is rejected when its character classes are further
    than `max_class` from the mean of its language, or its common words further than
    `max_common`; texts under `min_words` words are judged by the base alone, and
    those of a language without a list by character classes against its own mean only.
    Without a language, or with too few documents of it, the base alone decides.
    Null and empty texts have no words and fail.  Columns of `docs` stay inside
    `doc`, so none can clash; text and lang must be there.  Without the text among
    `columns` the counts are written once; with it they are taken twice, first for the
    means, so that no text is written.
    """
    rows = repeated_words(profile(docs, columns or docs.columns)).drop("words")
    if columns and "text" not in columns:
        rows = cut_lineage(rows)
    known = references(rows, min_words)
    # So few rows are sent to all tasks, as a language can have most documents.
    known = F.broadcast(known) if known.count() <= BROADCAST_LANGS else known
    rows = rows.join(known, F.col("_lang") == F.col("_ref"), "left")
    by_class = F.when(F.col("_ref").isNotNull(), distance(class_shares(), F.col("ref_classes")))
    by_common = F.when(F.col("_ref").isNotNull() & F.col("common").isNotNull(), distance(common_shares(), F.col("ref_common")))
    judged = rows.withColumns({
        "class_distance": F.when(F.col("n_words") >= min_words, F.round(by_class, 6)),
        "common_distance": F.when(F.col("n_words") >= min_words, F.round(by_common, 6)), "base_failed": base_failed()})
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class) | (F.coalesce("common_distance", F.lit(0.0)) > max_common)
    return judged.withColumn("kept", ~F.col("base_failed") & ~far).select(
        "doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "common_distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of docs that the rules keep, all columns."""
    # A row number that the result needs keeps the optimizer from moving the filter, and a copy of all counts in
    # each place that uses them, below the projections.
    judged = judge(docs).withColumn("_row", F.monotonically_increasing_id()).where("kept")
    return judged.select(F.when(F.col("_row") >= 0, F.col("doc")).alias("doc")).select("doc.*")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents"), ["doc_id"]).select("doc.doc_id", *[
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "common_distance"])
