"""Periodic runs of words: a recompression grammar answers the extensions of candidates on harmonic grids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaflow.llm.common import WORD, ship_package, small_batches, table, whole_text

LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Words that are compared before the grammar is asked.
FIRST_LOOK = 8
#: Odd multiplier; its high bit after a product deals the symbols of a level to two sides.
MIX = 0x9E3779B97F4A7C15


class Grammar:
    """Run-length grammar of a sequence: level 0 is the sequence, blocks and pairs of a level are symbols of the next.

    Levels alternate: every maximal block of one symbol becomes a symbol, then every
    symbol of the left side with a right-sided neighbour.  Equal stretches get equal
    symbols but for a bounded number at their ends, which is what `common` walks by.
    The first and last symbol of the sequence must occur once.
    """

    def __init__(self, sequence: np.ndarray, stop: int = 4):
        self.symbols = [sequence.astype(np.int64)]
        self.widths = [np.ones(len(sequence), np.int64)]
        self.parents: list[np.ndarray] = []    # of each node of a level, its node one level up
        self.children: list[np.ndarray] = []   # of each node one level up, its first child; then the end
        self.blocks: list[bool] = []           # whether the next level joins blocks
        names, rounds, still = int(sequence.max()) + 1 if len(sequence) else 0, 0, 0
        while len(self.symbols[-1]) > stop and still < 64:
            before, rounds = len(self.symbols[-1]), rounds + 1
            names = self._join_pairs(self._join_blocks(names), rounds)
            still = still + 1 if len(self.symbols[-1]) == before else 0

    def _add(self, heads: np.ndarray, symbols: np.ndarray, blocks: bool) -> None:
        starts = np.flatnonzero(heads)
        self.parents.append(np.cumsum(heads) - 1)
        self.children.append(np.append(starts, len(heads)))
        self.blocks.append(blocks)
        self.widths.append(np.add.reduceat(self.widths[-1], starts))
        self.symbols.append(symbols)

    def _join_blocks(self, names: int) -> int:
        old = self.symbols[-1]
        heads = np.append(True, old[1:] != old[:-1])
        starts = np.flatnonzero(heads)
        counts = np.diff(np.append(starts, len(old)))
        new = old[starts]
        many = np.flatnonzero(counts > 1)
        if not len(many):
            return names
        codes, kinds = pd.factorize(new[many] * (int(counts.max()) + 1) + counts[many])
        new[many] = names + codes
        self._add(heads, new, True)
        return names + len(kinds)

    def _join_pairs(self, names: int, rounds: int) -> int:
        old = self.symbols[-1]
        salt = np.uint64((2 * rounds + 1) * MIX & (1 << 64) - 1)  # odd; other sides in every round
        right = (old.astype(np.uint64) * salt) >> np.uint64(63) == 1
        firsts = np.flatnonzero(~right[:-1] & right[1:])
        if not len(firsts):
            return names
        codes, kinds = pd.factorize(old[firsts] * names + old[firsts + 1])
        heads = np.ones(len(old), bool)
        heads[firsts + 1] = False
        new = old.copy()
        new[firsts] = names + codes
        self._add(heads, new[heads], False)
        return names + len(kinds)

    def _steps(self, level: int, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray | int:
        """How many nodes may be passed at once where a and b hold the same symbol."""
        if level == len(self.parents) or not self.blocks[level]:
            return 1
        up, first = self.parents[level], self.children[level]
        if forward:
            return np.minimum(first[up[a] + 1] - a, first[up[b] + 1] - b)
        return np.minimum(a - first[up[a]], b - first[up[b]]) + 1

    def _at_edge(self, level: int, a: np.ndarray, forward: bool) -> np.ndarray:
        up, first = self.parents[level], self.children[level]
        return first[up[a]] == a if forward else first[up[a] + 1] - 1 == a

    def common(self, i: np.ndarray, j: np.ndarray, forward: bool = True) -> np.ndarray:
        """Longest common extensions of positions i and j (i <> j), forward or backward, both included."""
        a, b, total = i.astype(np.int64), j.astype(np.int64), np.zeros(len(i), np.int64)
        sign, top = 1 if forward else -1, len(self.parents)
        turned: list[np.ndarray] = []

        def advance(level: int, live: np.ndarray) -> None:
            n = self._steps(level, a[live], b[live], forward)
            total[live] += n * self.widths[level][a[live]]
            a[live] += sign * n
            b[live] += sign * n

        rising = np.arange(len(i))
        for level in range(top + 1):
            live, away, up = rising, [], []
            while len(live):
                same = self.symbols[level][a[live]] == self.symbols[level][b[live]]
                away.append(live[~same])
                live = live[same]
                if level < top and len(live):
                    pa_, pb_ = self.parents[level][a[live]], self.parents[level][b[live]]
                    rise = self._at_edge(level, a[live], forward) & self._at_edge(level, b[live], forward) & (
                        self.symbols[level + 1][pa_] == self.symbols[level + 1][pb_])
                    risen = live[rise]
                    a[risen], b[risen] = pa_[rise], pb_[rise]
                    up.append(risen)
                    live = live[~rise]
                if len(live):
                    advance(level, live)
            turned.append(np.concatenate(away) if away else np.zeros(0, np.int64))
            rising = np.concatenate(up) if up else np.zeros(0, np.int64)
        falling = np.zeros(0, np.int64)
        for level in range(top, 0, -1):
            falling = np.concatenate([falling, turned[level]])
            first = self.children[level - 1]
            for at in (a, b):
                at[falling] = first[at[falling]] if forward else first[at[falling] + 1] - 1
            live = falling
            while len(live):
                live = live[self.symbols[level - 1][a[live]] == self.symbols[level - 1][b[live]]]
                if len(live):
                    advance(level - 1, live)
        return total


def grid_candidates(ids: np.ndarray, lengths: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of every multiple of a period q whose word and next words stand q further on again.

    ids holds sequences of `lengths` (falling), each with a separator behind it and one
    before the first.  A run of q with `times` periods covers a multiple i of q with
    i + q in the run, and at least max(least, times * q) - 2 * q + 1 words from i on
    stand again from i + q on.
    """
    ends = 1 + np.cumsum(lengths + 1)
    found_i, found_q = [], []
    for q in range(1, (int(lengths[0]) if len(lengths) else 0) // times + 1):
        fit = int(np.searchsorted(-lengths, -max(times * q, least), side="right"))
        if not fit:
            break
        part = ids[:ends[fit - 1]]
        grid = part[::q]
        i = np.flatnonzero(grid[:-1] == grid[1:]) * q
        for d in range(1, min(FIRST_LOOK, max(least, times * q) - 2 * q + 1)):
            if not len(i):
                break
            i = i[i + q + d < len(part)]
            i = i[part[i + d] == part[i + q + d]]
        if len(i):
            found_i.append(i)
            found_q.append(np.full(len(i), q, np.int64))
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_q)


def runs_of(texts: list[list], least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each list of words, by start, then period.

    All lists go into one sequence with separators that occur once, so one grammar
    serves them and no extension leaves its list.
    """
    result: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    long = sorted((k for k in range(len(texts)) if len(texts[k]) >= least), key=lambda k: -len(texts[k]))
    if not long:
        return result
    lengths = np.array([len(texts[k]) for k in long])
    codes, kinds = pd.factorize(np.array([w for k in long for w in texts[k]], object))
    ids = np.empty(len(codes) + len(long) + 1, np.int64)
    borders = np.append(0, np.cumsum(lengths + 1))
    inside = np.ones(len(ids), bool)
    inside[borders] = False
    ids[inside] = codes
    ids[borders] = len(kinds) + np.arange(len(borders))
    i, q = grid_candidates(ids, lengths, least, times)
    if not len(i):
        return result
    # Only sequences with a candidate are needed in the grammar.
    use = np.unique(np.searchsorted(borders, i, side="right") - 1)
    kept = np.zeros(len(ids), bool)
    kept[0] = True
    for s in use:
        kept[borders[s] + 1:borders[s + 1] + 1] = True
    moved = np.cumsum(kept) - 1
    grammar = Grammar(ids[kept], stop=4 * len(use))
    back = np.flatnonzero(kept)
    ahead = grammar.common(moved[i], moved[i + q])
    behind = grammar.common(moved[i] - 1, moved[i + q] - 1, forward=False)
    start, length = back[moved[i] - behind], behind + q + ahead
    good = length >= np.maximum(least, times * q)
    start, length, q = start[good], length[good], q[good]
    # One stretch is found by its smallest period and by multiples of it.
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    first = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])) if len(start) else np.zeros(0, bool)
    start, length, q = start[first], length[first], q[first]
    where = np.searchsorted(borders, start, side="right") - 1
    for s, a, n, p in zip(where.tolist(), (start - borders[where] - 1).tolist(), length.tolist(), q.tolist()):
        result[long[s]].append((a, n, p))
    for runs in result:
        runs.sort(key=lambda r: (r[0], r[2]))
    return result


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period; the smallest start, then period, of equal ones."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """Words that no run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for a, n, p in runs:
        depth[a + p] += 1
        depth[a + n] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(depth)[:-1] == 0)]


def _runs(least: int, times: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # bytes.split() cuts at exactly the white space of the contract.
            texts = [(t or b"").split() for t in batch.column("text").to_pylist()]
            rows = []
            for words, runs in zip(texts, runs_of(texts, least, times)):
                best = strongest(runs) or (None, None, None)
                rows.append((len(words), len(runs), *best, [dict(zip(("start", "length", "period"), r)) for r in runs],
                             b" ".join(kept_words(words, runs))))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:])] if rows else [
                pa.array([], f.type) for f in list(schema)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=schema.names)
    return run


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> DataFrame:
    """One row per document: doc_id, n_words, n_runs, start, length, period, runs, collapsed.

    A run is a stretch of words with smallest period q of at least max(least, times * q)
    words (times >= 2) that neither neighbour extends.  `runs` holds all of them
    (start, length, period; by start, then period), start, length and period are those
    of the run with the greatest length / period (nulls without a run), and collapsed
    is the text (bytes) of the words that no run holds after its first period, joined
    by one space.  Words are [^\\x20\\x09-\\x0D]+.

    Documents are worked on in the batches in which they are read, without a shuffle;
    a batch is bounded in rows and bytes, and a longer text is a batch of its own.
    A null or empty text has no words, no runs and an empty collapsed text.  Repeated
    rows and null ids give a row each.  Only doc_id and text are read, so other
    columns may have any names.
    """
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark, 400, "4m")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("doc_id", pa.null()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()),
                        ("length", pa.int64()), ("period", pa.int64()),
                        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                        ("collapsed", pa.binary())])
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        _runs(least, times, schema),
        f"doc_id {kind}, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, "
        "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: every document with h % 10 = 0, h the CRC-32 of its decimal id, made periodic from word a on.

    With g = h div 10 and n words, word i >= a = g % n becomes word a + (i - a) % p of the
    original, p = 1 + (n - a) div (3 + g % 8).  A null id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", whole_text().alias("text"), h.alias("h"), F.expr("0L").alias("g")).withColumn(
        "g", F.expr("h div 10")).withColumn(
        "words", F.when(F.expr("h % 10 = 0"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    sized = chosen.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)"))).withColumn(
        "p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    copies = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.expr("cast((n - a + p - 1) div p as int)")))
    whole: Column = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(copies, F.lit(1), F.col("n") - F.col("a")))
    return sized.select("doc_id", F.when(F.col("n") > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    lines = F.concat(F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n"),
                     F.when(F.col("n_runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return periodic_runs(planted(table(spark, folder, "documents"))).select(
        "doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
