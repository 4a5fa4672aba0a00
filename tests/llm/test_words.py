"""Operators on words (phrase index, periodic runs, spelling variants) against plain versions."""

import os
import random
import re
import sys
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from areaflow.llm import periodic_runs, phrase_index, spelling  # noqa: E402
from areaflow.llm.common import first_by_hash  # noqa: E402

SCHEMA = "doc_id bigint, text string, word string, n string, term string, pos string, runs string, window string, m string, row_id string"
EXTRA = ["x"] * 8
TERM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows(texts):
    return [(i, t, *EXTRA) for i, t in texts]


# --- periodic runs ---

def plain_runs(words, least, times):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, times * q):
                found.setdefault((start, i + q - start), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_kept(words, runs):
    gone = {k for a, n, p in runs for k in range(a + p, a + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def periodic_texts():
    rnd, texts = random.Random(4), [None, "", " \t\n\x0b\x0c\r", "a", "a " * 23, "a " * 24, "a b " * 12, "a b c\n" * 30 + "a", "é x " * 40]
    for _ in range(60):
        words = [str(rnd.randrange(rnd.choice([1, 2, 3, 40]))) for _ in range(rnd.choice([3, 24, 80, 300]))]
        for _ in range(rnd.randrange(4)):
            a, p = rnd.randrange(len(words)), rnd.randrange(1, 30)
            for i in range(a, min(len(words), a + rnd.randrange(20, 150))):
                words[i] = words[a + (i - a) % p]
        texts.append(" ".join(words))
    texts += [("u v w x y z t " * 9000), " ".join(str(rnd.randrange(5000)) for _ in range(40_000))]
    return texts


@pytest.mark.parametrize("least, times", [(24, 3), (2, 2), (6, 3)])
def test_runs_equal_plain_search(least, times):
    texts = [(t or "").encode().split() for t in periodic_texts()[:-2]]
    for words, runs in zip(texts, periodic_runs.runs_of(texts, least, times)):
        assert runs == plain_runs(words, least, times)


def test_extensions_of_the_grammar_are_exact():
    rnd = random.Random(5)
    body = [rnd.randrange(3) for _ in range(60)] * 3 + [0] * 50 + [rnd.randrange(2) for _ in range(120)]
    sequence = [98, *body, 99]
    grammar = periodic_runs.Grammar(periodic_runs.np.array(sequence))
    assert len(grammar.symbols[-1]) <= 4
    pairs = [(i, j) for i in range(1, len(sequence) - 1, 3) for j in range(1, len(sequence) - 1) if i != j]
    i, j = (periodic_runs.np.array(x) for x in zip(*pairs))
    for forward, sign in ((True, 1), (False, -1)):
        for (a, b), got in zip(pairs, grammar.common(i, j, forward).tolist()):
            want = 0
            while sequence[a] == sequence[b]:
                a, b, want = a + sign, b + sign, want + 1
            assert got == want


def test_periodic_runs_of_documents(spark):
    texts = list(enumerate(periodic_texts())) + [(None, "a b " * 20), (3, "a"), (3, "a")]
    got = periodic_runs.periodic_runs(spark.createDataFrame(rows(texts), SCHEMA).repartition(3)).collect()
    by_text = Counter()
    for r in got:
        by_text[(r.doc_id, r.n_words, r.n_runs, r.start, r.length, r.period, tuple(map(tuple, r.runs)), r.collapsed.decode())] += 1
    want = Counter()
    for i, t in texts:
        words = brute.WORD.findall(t or "")
        runs = plain_runs(words, 24, 3) if len(words) < 20_000 else [(0, 63_000, 7)] if words[0] == "u" else []
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
        want[(i, len(words), len(runs), *best, tuple(runs), plain_kept(words, runs))] += 1
    assert by_text == want


def test_planting_follows_the_ids(spark):
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0][:20] + [1, 2, None]
    text = " ".join(f"w{k}" for k in range(37))
    got = {r.doc_id: r.text for r in periodic_runs.planted(spark.createDataFrame(rows([(i, text) for i in ids] + [(-5, None)]), SCHEMA)).collect()}
    for i in ids:
        words, h = text.split(" "), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0:
            a, g = h // 10 % 37, h // 10
            p = 1 + (37 - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(37)]
        assert got[i] == " ".join(words)
    assert got[-5] == ""


# --- phrase index ---

def plain_hits(texts, items, size=10):
    windows = []
    for i, t in items:
        words = TERM.findall((t or "").translate(brute.LOWER))
        windows += [("" if i is None else str(i), words[k:k + size]) for k in range(max(1, len(words) - size + 1)) if words]
    for i, t in texts:
        words = TERM.findall((t or "").translate(brute.LOWER))
        hit, held = set(), set()
        for item, w in windows:
            for k in range(len(words) - len(w) + 1):
                if words[k:k + len(w)] == w:
                    hit.update(range(k, k + len(w)))
                    held.add(item)
        yield i, len(words), len(hit), len(held), brute.sha(",".join(sorted(held)).encode()), bool(hit)


def phrase_tables():
    rnd = random.Random(6)
    vocabulary = ["The", "of", "a", "ÉTÉ", "été", "über", *[f"t{k}" for k in range(12)]]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 9, 10, 11, 30])))) for i in range(12)]
    items += [(3, items[3][1]), (40, items[4][1].upper()), (41, None), (42, "?!"), (None, "only here once"), (43, "a a a a a a a a a a a")]
    texts = []
    for i in range(40):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 5, 40, 200]))]
        if i % 3 == 0:
            words[len(words) // 2:len(words) // 2] = re.split(" ", items[i % 12][1])
        texts.append((i, ", ".join(words)))
    texts += [(None, items[5][1]), (None, None), (7, ""), (7, ""), (50, "a-" * 30_000), (51, "ONLY, here (once)!")]
    return texts, items


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_phrases_equal_plain_search(spark, broadcast_rows):
    texts, items = phrase_tables()
    docs, tests = spark.createDataFrame(rows(texts), SCHEMA).repartition(4), spark.createDataFrame(
        [(i, t, "x", 1) for i, t in items], "item_id bigint, text string, term string, window int")
    got = phrase_index.contamination(docs, tests, broadcast_rows=broadcast_rows).collect()
    assert Counter(map(tuple, got)) == Counter(plain_hits(texts, items))


def test_proximity_of_terms(spark):
    texts, items = phrase_tables()
    texts = texts[:30]
    index = phrase_index.build_index(spark.createDataFrame(rows(texts), SCHEMA).coalesce(1), spark.createDataFrame(
        items, "item_id bigint, text string"))
    reach = 12
    got = {(r.row_id, r.window, r["at"]) for r in phrase_index.matches(index, reach).collect()}
    rows_of = {r.row_id: r.doc_id for r in index.postings.select("row_id", "doc_id").distinct().collect()}
    places = {}
    for r in index.postings.collect():
        places.setdefault((r.row_id, r.term), []).append(r.pos)
    want = set()
    for w in index.windows.collect():
        terms = [x.term for x in w.lists]
        for row in rows_of:
            for at in places.get((row, terms[0]), []):
                if all(any(abs(p - at) <= reach for p in places.get((row, t), [])) for t in set(terms)):
                    want.add((row, w.window, at))
    assert got == want and want
    # Every exact phrase is also found by proximity.
    exact = {(r.row_id, r.window) for r in phrase_index.matches(index).collect()}
    assert exact and exact <= {(a, b) for a, b, _ in got}
    index.drop()


def test_phrases_of_empty_tables(spark):
    docs = spark.createDataFrame(rows([(1, "a b")]), SCHEMA)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r) for r in phrase_index.contamination(docs, none).collect()] == [(1, 2, 0, 0, brute.sha(b""), False)]
    assert phrase_index.contamination(docs.limit(0), none).collect() == []


# --- spelling variants ---

def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(counts):
    out, forms = {}, {}
    for w, n in counts.items():
        close = [v for v in counts if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v)) if close else None
        forms[w] = best if best and counts[best] >= 2 * n else None
        out[w] = (n, len(close), counts[best] if forms[w] else None)
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        yield (w, forms[w], root, *out[w])


def vocabulary():
    rnd = random.Random(8)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.choice([5, 6, 7]))): rnd.randrange(3, 400) for _ in range(500)}
    words.update({"cat" + c + "s": 2 ** k + 3 for k, c in enumerate("abcdefgh")})
    words.update({"x" * k: 7 * k for k in range(5, 30)})
    return words


@pytest.mark.parametrize("shard_words", [1, 6, 20_000])
def test_groups_equal_plain_search(spark, shard_words):
    words = vocabulary()
    df = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(3)
    got = spelling.variant_groups(df, shard_words=shard_words).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_groups(words), key=repr)


def test_acceptor_is_minimal_and_ranks_paths():
    words = sorted({a + b for a in ("tap", "top", "map") for b in ("", "s", "ping")})
    acceptor = spelling.Acceptor(words)
    assert len(acceptor.arcs) < sum(len(w) for w in words)
    for k, word in enumerate(words):
        state, rank = acceptor.start, 0
        for letter in word:
            rank += acceptor.ranks[state][letter]
            state = acceptor.arcs[state][letter]
        assert rank == k and acceptor.final[state]


def test_spelled_words_of_documents(spark):
    texts = [(i, "Kühlhaus ÉTÉ abcde x2y Straße × " * 3) for i in range(60)] + [(None, "kühlhaus"), (4, None), (4, ""), (5, "ß" * 20_000)]
    got = Counter(r.word for r in spelling.spelled_words(spark.createDataFrame(rows(texts), SCHEMA)).collect())
    want = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            want[word if h % 97 else word[:h % len(word)] + word[h % len(word) + 1:]] += 1
    assert got == want and any(h not in ("kühlhaus", "ÉtÉ") for h in got)
    counted = {r.word: r.n for r in spelling.vocabulary(spelling.spelled_words(spark.createDataFrame(rows(texts), SCHEMA))).collect()}
    assert counted == {w: n for w, n in want.items() if n >= 3 and len(w) >= 5}


def test_no_words_no_groups(spark):
    assert spelling.variant_groups(spark.createDataFrame([], "word string, n bigint")).collect() == []


def test_first_by_hash_equals_a_sort(spark):
    rows = spark.range(5000).selectExpr("id", "id % 40 as again").repartition(9)
    key = F.xxhash64("again", F.lit(1))
    want = sorted(rows.select(key.alias("h"), "id").collect())
    for n in (0, 1, 30, 4000, 6000):
        assert [r.id for r in first_by_hash(rows, key, ["id"], n).collect()] == [r.id for r in want[:n]]
