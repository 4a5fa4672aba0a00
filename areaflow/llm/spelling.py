"""Spelling variants: the vocabulary acceptor composed with a one-edit transducer and itself."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaflow.llm.common import ascii_lower, ship_package, table, whole_text
from areaflow.session import cut_lineage

#: Runs of letters of the contract.
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: An initial state whose languages hold more words is split into later initial states.
SHARD_WORDS = 20_000


# --- words ---

def spelled_words(docs: DataFrame, one_in: int = 97) -> DataFrame:
    """doc_id, word, times: the words of each text, with a letter deleted where one_in divides h.

    h is the CRC-32 of "<doc_id>:<word>"; the letter at h % length goes.  A null id is
    an empty one, a null text has no words.
    """
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(whole_text(), F.lit(LETTERS), F.lit(0))).alias("run")).select(
        "doc_id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.expr("cast(h % char_length(run) as int)")
    hit = F.when(F.col("h") % one_in == 0, F.concat(F.substring("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return found.withColumn("h", h).select("doc_id", hit.alias("word"))


def vocabulary(words: DataFrame, least_letters: int = 5, least_times: int = 3) -> DataFrame:
    """word, n: words of enough code points that stand often enough, each with its count."""
    return words.where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(
        F.col("n") >= least_times)


# --- minimised acceptors ---

class Acceptor:
    """Minimal deterministic acceptor of sorted distinct strings.

    A state is a tuple of (letter, target) arcs in letter order; `final` holds whether
    it accepts, `below` how many strings it accepts, and `ranks` for each arc how many
    of these come before, so that a path adds up to the rank of its string.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.ranks: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.below: list[int] = []
        self._known: dict[tuple, int] = {}
        # Arcs of the states on the path of the last word; the part that the next word shares stays open.
        path: list[tuple[list[tuple[str, int]], bool]] = [([], False)]
        letters: list[str] = []
        for word in words:
            shared = 0
            for x, y in zip(letters, word):
                if x != y:
                    break
                shared += 1
            self._close(path, letters, shared)
            letters = list(word)
            path += [([], False) for _ in letters[shared:]]
            path[-1] = (path[-1][0], True)
        self._close(path, letters, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list, letters: list[str], upto: int) -> None:
        while len(path) > upto + 1:
            state = self._state(*path.pop())
            path[-1][0].append((letters[len(path) - 1], state))

    def _state(self, arcs: list[tuple[str, int]], final: bool) -> int:
        key = (final, *arcs)
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.arcs)
            ranks, count = {}, int(final)
            for letter, target in arcs:
                ranks[letter] = count
                count += self.below[target]
            self.arcs.append(dict(arcs))
            self.ranks.append(ranks)
            self.final.append(final)
            self.below.append(count)
        return state


def _equal_paths(left: Acceptor, p: int, r: int, right: Acceptor, q: int, s: int, barred: str | None) -> Iterator[tuple[int, int]]:
    """Ranks of the strings that both states accept; the first letter is not `barred`."""
    stack = [(p, r, q, s, barred)]
    while stack:
        p, r, q, s, barred = stack.pop()
        if left.final[p] and right.final[q]:
            yield r, s
        others = right.arcs[q]
        for letter, target in left.arcs[p].items():
            if letter in others and letter != barred:
                stack.append((target, r + left.ranks[p][letter], others[letter], s + right.ranks[q][letter], None))


def replaced(words: Acceptor, depth: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranks (smaller, larger) of accepted strings that differ by one replaced letter before `depth`.

    The composition acceptor - one replacement - acceptor starts in (start, no edit, start).
    Without an edit both sides are in one state, so only one is kept.
    """
    stack = [(words.start, 0, 0)]
    while stack:
        state, rank, at = stack.pop()
        if depth is not None and at >= depth:
            continue
        arcs, ranks = list(words.arcs[state].items()), words.ranks[state]
        for k, (a, p) in enumerate(arcs):
            stack.append((p, rank + ranks[a], at + 1))
            for b, q in arcs[k + 1:]:
                yield from _equal_paths(words, p, rank + ranks[a], words, q, rank + ranks[b], None)


def deleted(long: Acceptor, short: Acceptor, depth: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranks (in long, in short) of strings where one deleted letter before `depth` turns the first into the second.

    Of equal neighbours the last one is deleted, so that each pair has one path.
    """
    stack = [(long.start, 0, short.start, 0, 0)]
    while stack:
        p, r, q, s, at = stack.pop()
        if depth is not None and at >= depth:
            continue
        others = short.arcs[q]
        for letter, target in long.arcs[p].items():
            rank = r + long.ranks[p][letter]
            yield from _equal_paths(long, target, rank, short, q, s, letter)
            if letter in others:
                stack.append((target, rank, others[letter], s + short.ranks[q][letter], at + 1))


# --- initial states as shards ---

def first_states(words: DataFrame) -> DataFrame:
    """Shards (m, head, tail) of each word: pairs whose shorter word has m letters meet in one shard.

    With c = m div 2, near words either share their first c letters, which is the state
    (head, no edit, head) of the composition, or their last m - c.  A word of n letters
    is the shorter one in m = n and the longer one in m = n - 1.  Pairs of the second
    kind have their edit before letter c, those of the first kind not, so no pair is in
    two shards.
    """
    n = F.char_length("word")
    both = words.withColumn("m", F.explode(F.array(n, n - 1)))
    return _split(both.withColumns({"head": F.lit(""), "tail": F.lit(""), "upto": F.lit(None).cast("int")}))


def _split(shards: DataFrame) -> DataFrame:
    """Each shard as two: the next half of the free letters shared in front, or the other half behind.

    `upto` is the number of letters before which the edit is; null where any place will do.
    """
    a, b = F.char_length("head"), F.char_length("tail")
    c = F.floor((F.col("m") - a - b) / 2).cast("int")
    rest = F.col("m") - a - b - c
    front = F.struct(F.substring("word", F.lit(1), a + c).alias("head"), F.col("tail").alias("tail"), F.col("upto").alias("upto"))
    behind = F.struct(F.col("head").alias("head"), F.expr("right(word, n_tail)").alias("tail"), (a + c).alias("upto"))
    kept = [x for x in shards.columns if x not in ("head", "tail", "upto")]
    return shards.withColumn("n_tail", b + rest).withColumn("part", F.explode(F.array(front, behind))).select(*kept, "part.*")


def _free(word: Column) -> Column:
    a, b = F.char_length("head"), F.char_length("tail")
    return F.substring(word, a + 1, F.char_length(word) - a - b)


def shards_of(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, n, m, head, tail, upto: shards of at most `shard_words` words, or with a single free letter.

    Larger shards are split again and again, which halves their free letters, so an
    initial state that many words share is no single task's burden.
    """
    key = ["m", "head", "tail", "upto"]
    done, open_ = None, first_states(words)
    while True:
        sizes = open_.groupBy(*key).agg(F.count("*").alias("size")).where(
            (F.col("size") > shard_words) & (F.col("m") - F.char_length("head") - F.char_length("tail") > 1))
        large = cut_lineage(sizes.drop("size"))
        if large.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        same = [open_[k].eqNullSafe(large[k]) for k in key]
        stay = open_.join(large, same, "left_anti")
        done = stay if done is None else done.unionByName(stay)
        open_ = cut_lineage(_split(open_.join(large, same, "left_semi")))


def _near_in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each word inside its shard: how many, and the one of largest n (then first in order).

    Rows come sorted by shard and word, so a shard is held at a time; a shard's rows may
    go over a batch's end.
    """
    out: list[list] = [[], [], [], []]

    def close(m: int, upto: int | None, cut: int, words: list[str], frees: list[str], counts: list[int]) -> None:
        if len(words) < 2:
            return
        depth = None if upto is None else upto - cut
        short = [k for k in range(len(words)) if len(words[k]) == m]
        long = [k for k in range(len(words)) if len(words[k]) > m]
        if not short:
            return
        near, best = {}, {}

        def meet(x: int, y: int) -> None:
            for w, v in ((x, y), (y, x)):
                near[w] = near.get(w, 0) + 1
                old = best.get(w)
                if old is None or counts[v] > counts[old] or (counts[v] == counts[old] and words[v] < words[old]):
                    best[w] = v

        shorter = Acceptor([frees[k] for k in short])
        for x, y in replaced(shorter, depth):
            meet(short[x], short[y])
        if long:
            for x, y in deleted(Acceptor([frees[k] for k in long]), shorter, depth):
                meet(long[x], short[y])
        for w, v in best.items():
            for column, value in zip(out, (words[w], near[w], counts[v], words[v])):
                column.append(value)

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                                            pa.array(out[3], pa.string())], ["word", "n_near", "near_n", "near"])
        for column in out:
            column.clear()
        return batch

    key, words, frees, counts = None, [], [], []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("m", "head", "tail", "upto", "word", "free", "n")]
        for m, head, tail, upto, word, free, n in zip(*columns):
            if (m, head, tail, upto) != key:
                if key:
                    close(key[0], key[3], len(key[1]), words, frees, counts)
                key, words, frees, counts = (m, head, tail, upto), [], [], []
            words.append(word)
            frees.append(free)
            counts.append(n)
        if len(out[0]) > 50_000:
            yield flush()
    if key:
        close(key[0], key[3], len(key[1]), words, frees, counts)
    yield flush()


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, n_near, near, near_n: how many words of `words` (word, n; distinct) are one edit away, and the most frequent.

    Of equally frequent ones the first in code-point order.  Words without a near word
    are left out.  A pair is found in one shard only, so the counts add up.
    """
    ship_package(words.sparkSession)
    key = ["m", "head", "tail", "upto"]
    ordered = shards_of(words, shard_words).select(*key, "word", _free(F.col("word")).alias("free"), "n").repartition(
        *key).sortWithinPartitions(*key, "free")
    found = ordered.mapInArrow(_near_in_shards, "word string, n_near bigint, near_n bigint, near string")
    # max of (n, words backwards in order): the first word of the largest n.
    rank = F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(rank).alias("best")).select(
        "word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


# --- forms and roots ---

def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that the forms (word, form; no cycles) lead to, by doubling the steps in each round."""
    step = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = step.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        step = step.join(onward, F.col("root") == F.col("_word"), "left").select(
            "word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved"))
        step = cut_lineage(step)
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        step = step.select("word", "root")


def variant_groups(words: DataFrame, factor: int = 2, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n; words distinct and not null).

    Words are near if one inserted, deleted or replaced code point turns one into the
    other.  form is the near word of largest n (ties: first in code-point order) if that
    n is at least `factor` times the word's (2 or more, so that forms form no cycle),
    else null; root is the last word that forms lead to, the word itself without one.
    Words without near words have n_near 0.  An empty vocabulary gives no rows.
    """
    known = cut_lineage(words.select("word", "n"))
    best = known.join(near_words(known, shard_words).withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"), "left")
    has = F.col("near_n") >= factor * F.col("n")
    formed = cut_lineage(best.select(
        "word", F.when(has, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(has, F.col("near_n")).alias("form_n")))
    ends = roots(formed.where("form is not null").select("word", "form")).withColumnRenamed("word", "_word")
    return formed.join(ends, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variant_groups(vocabulary(spelled_words(table(spark, folder, "documents"))))
