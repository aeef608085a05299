"""Prefix trie, importance resampling and substring dedup against brute force; odd, empty and skewed tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import prefix_trie, queries, resample, substring_dedup

BLANKS = re.compile("[^\x20\x09-\x0d]+")
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, word string, score int, key string, part int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- prefix trie ---------------------------------------------------------------------------


def trie_by_hand(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(ts, key=lambda v: v[:2])] for c, ts in own.items()}
    new = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = {}
    for c, v in new.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in members.items():
        words = (len(m) - 1) * (len(BLANKS.findall(p[-1][1])) if p else 0)
        for d in range(len(p) + 1):
            saved[p[:d]] += words
            leaves[p[:d]] += not kids.get(p)
    found = [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], sha(",".join(str(c) for c in sorted(m) if new[c] == p)))
        for p, m in members.items()
    ]
    return sorted(found, key=str)


def talks(seed):
    g, rows = random.Random(seed), []
    for c in range(150):
        if g.random() < 0.1:
            continue
        ts = list(range(g.randint(1, 9)))
        ts[0] = None if g.random() < 0.3 else 0
        for t in ts:
            role, text = g.choice(["u", "a", None]) if g.random() < 0.3 else "u", g.choice(["hi there", "a  b c", "", "ü x"]) if g.random() < 0.95 else None
            rows.append((c if g.random() < 0.99 else None, t, role, text))
    rows += [(c, t, "u", f"same text {t}") for c in range(300, 400) for t in range(6)]  # copies, over a third of all rows
    rows += [(999, t, "u", str(t)) for t in range(300)]
    g.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions, sequences", [("1", 1000), ("4", 50), ("4", 3), ("23", 7)])
def test_trie_whatever_the_partitions(spark, partitions, sequences):
    rows = talks(int(partitions))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = rows_of(prefix_trie.trie(spark.createDataFrame(rows, TURNS).repartition(3), sequences=sequences))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == trie_by_hand(rows)


def test_trie_of_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op11_conversation_trie(spark, sf)) == trie_by_hand(rows)


def test_trie_of_odd_tables(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).collect() == []
    # one that loses all its turns to a base that is absent is a member of the root; ties of turn are ordered whatever the order of rows
    lost = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lost, 1, "u", "x"), (lost, 2, "u", "y"), (None, 1, "u", "no conversation")]
    assert rows_of(prefix_trie.trie(spark.createDataFrame(rows, TURNS))) == [(lost, 0, None, 1, 0, 1, 0, sha(str(lost)))]
    ties = [(5, 1, "u", "b"), (5, 1, "u", "a"), (5, None, None, None), (5, 1, "u", "a")]
    either = [rows_of(prefix_trie.trie(spark.createDataFrame(r, TURNS + ", path string, n int").select("*"))) for r in ([(*x, "p", 1) for x in ties], [(*x, "p", 1) for x in ties[::-1]])]
    assert either[0] == either[1] and either[0]


# ---- importance resampling -----------------------------------------------------------------


def buckets(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def drawn_by_hand(docs, target, percent, least):
    found = [(d, *buckets(t)) for d, t in docs]
    s, t = [0] * 10000, [0] * 10000
    for _, _, bs in found:
        for b in bs:
            s[b] += 1
    for x in target:
        for b in buckets(x)[1]:
            t[b] += 1
    of_s, of_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((y + 1) * (of_s + 10000) / ((x + 1) * (of_t + 10000)))) for x, y in zip(s, t)]
    rows = []
    for d, n, bs in found:
        h = int(sha(f"42:{'' if d is None else d}")[:8], 16)
        weight = sum(gain[b] for b in bs)
        rows.append((d, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank, out = percent * len(order) // 100, [(*r[:4], None) for r in rows if r[4] < least]
    return sorted(out + [(*r[:4], k + 1 if k < rank else None) for k, r in enumerate(order)], key=str)


def test_resampling_of_the_tables(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows_of(queries.op12_importance_resampling(spark, sf)) == drawn_by_hand(docs, target, 5, 20)


def test_resampling_of_odd_tables(spark):
    g = random.Random(3)
    docs = [(i, " ".join(g.choice(["a", "B", "ü", "x1", "a,b"]) for _ in range(g.randint(0, 40)))) for i in range(60)]
    docs += [(None, "a b c " * 10), (7, None), (8, ""), (9, "-- !"), (10, "same " * 30), (10, "same " * 30), (11, "z" * 3000 + " end " + "y" * 255 + " " + "y" * 256 + " q" * 30)]
    target = ["a b", None, "", "x1 ü"]
    frame = lambda rows: spark.createDataFrame([(*r, "w", 1, "k", 2) for r in rows], DOCS).repartition(4)
    bench = spark.createDataFrame([(x,) for x in target], "text string")
    got = rows_of(resample.resample(frame(docs), bench, percent=30, min_words=5))
    assert got == drawn_by_hand(docs, target, 30, 5)
    assert resample.resample(frame([]), bench).collect() == []
    assert rows_of(resample.resample(frame(docs), bench.limit(0), percent=30, min_words=5)) == drawn_by_hand(docs, [], 30, 5)


@pytest.mark.parametrize("length", [0, 1, 255, 256, 257, 511, 512, 513, 5000, 300_000])
def test_checksums_of_long_runs(length):
    data = np.random.default_rng(length).integers(0, 256, length, dtype=np.uint8)
    assert resample.long_crc(data) == zlib.crc32(data.tobytes())


# ---- substring dedup -----------------------------------------------------------------------


def cut_by_hand(rows, window):
    order = lambda d: (d is None, d or 0)
    texts, first = [BLANKS.findall(t or "") for _, t in rows], {}
    for (d, _), w in zip(rows, texts):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, (True, 1 << 63)), order(d))
    out = []
    for (d, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < order(d):
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, seed", [(4, 1), (7, 2), (50, 3)])
def test_substring_dedup(spark, window, seed):
    g = random.Random(seed)
    vocabulary = [g.choice(["a", "bb", "日本", "x,y", "Q"]) + str(i) for i in range(6 if window < 50 else 30)]
    some = lambda n: [g.choice(vocabulary) for _ in range(n)]
    passages, rows = [some(window + g.randint(0, window)) for _ in range(5)], []
    for _ in range(120):
        words = some(g.randint(0, window))
        for _ in range(g.randint(0, 3)):
            words += g.choice(passages)[g.randint(0, 2) :] + some(g.randint(0, window))
        rows.append((g.randint(0, 80) if g.random() < 0.9 else None, g.choice([" ", "\n", "\t "]).join(words)))
    # a group of copies that holds a third, odd texts and rows that repeat
    rows += [(i, rows[0][1]) for i in range(100, 170)] + [(5, "x"), (6, None), (7, ""), (8, " \n ")] + [rows[3]] * 5
    docs = spark.createDataFrame([(*r, "w", 1, "k", 2) for r in rows], DOCS).repartition(5)
    assert rows_of(substring_dedup.dedup(docs, window=window, shard_words=100, block_words=300)) == cut_by_hand(rows, window)


def test_substring_dedup_of_the_table_and_of_none(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(queries.op13_substring_dedup(spark, sf)) == cut_by_hand(rows, 50)
    assert substring_dedup.dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_automaton_knows_the_least_owner_of_every_run():
    g = random.Random(9)
    texts = [([g.randint(0, 2) for _ in range(g.randint(1, 30))], g.randint(0, 5)) for _ in range(12)]
    automaton = substring_dedup.SuffixAutomaton()
    for text, owner in texts:
        automaton.add(text, owner)
    for least in (1, 3, 6):
        for before in range(7):
            text = [g.randint(0, 2) for _ in range(40)]
            gone = [False] * 40
            for i in range(40 - least + 1):
                if any(t[j : j + least] == text[i : i + least] for t, o in texts if o < before for j in range(len(t))):
                    gone[i : i + least] = [True] * least
            got = [False] * 40
            for low, high in automaton.matched(text, least, before):
                got[low:high] = [True] * (high - low)
            assert got == gone


def test_very_long_texts_and_words(spark):
    long = " ".join(str(i * 7919 % 10007) for i in range(300_000))
    rows = [(1, long), (2, "before " + long + " behind"), (3, "ha" * 3_000_000), (4, "ha" * 3_000_000)]
    got = rows_of(substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed"))
    assert got == [(1, 300_000, 0), (2, 300_002, 300_000), (3, 1, 0), (4, 1, 0)]
    assert resample.weigh(spark.createDataFrame(rows, "doc_id long, text string"), np.ones(10_000, np.int64)).select(F.sum("weight")).first()[0] == 3 * 300_000 - 3 + 3 * 300_002 - 3 + 2
