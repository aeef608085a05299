"""Removal of repeated passages by winnowing over hashes of words, in DataFrame operations only.

Words are what blanks and line ends part. A fingerprint is a run of f = ``min_words`` // 5 words.
Of the ``min_words`` - f + 1 words of a window that a fingerprint can start at, the one with the
least hash is kept (the leftmost of equals), and the fingerprint from there on is hashed. Any two
equal windows of ``min_words`` words hold the same fingerprint at the same place: none is missed,
whatever lines or punctuation they hold.

Fingerprints found once are left. A place of a repeated one is extended both ways: its context
of all words in windows over it, from the first that keeps it on, is hashed too. Where the
context equals an earlier place's, all its windows are repeats. The places that remain (the first with their
context, so one for each different context) are compared window by window, if another one also
holds the twenty words before or behind that such windows need. A window that equals
an earlier one (by doc_id, then place) is deleted; windows that overlap make one run, so every
run of ``min_words`` words or more that repeats is cut to its full length. The first one stays,
also within a document: a window that overlaps its own first place is no repeat. Equality is
that of 64-bit hashes.

Copies of a passage are each matched with the first, not with one another, so the work is
linear in their number. Counts and first places are aggregated before the shuffle, and what
they are joined with has a plain exchange on either side, so a fingerprint that very many
documents share is split. What is gathered into one row are places of one document, never
texts. Texts without a match are not shuffled, as far as the slots of their keys tell (a
broadcast of SLOTS rows at most; a full one costs a shuffle, not a result).

Nulls: a null text stays null. A document that is all repeats keeps its row, with an empty
text. Rows that repeat both doc_id and text are one document: each keeps the same text. A
null doc_id comes last in order. An empty table gives an empty result. A very long text is
one row like any other; its arrays are as long as its words. All other columns pass through;
the columns that are added (``added``) replace those of the same name, and no other name clashes.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.state import settings
from .common import written

MIN_WORDS = 50
SLOTS = 1 << 20
ADDED = ("n_chars", "n_runs", "n_removed_words")
MARK = "\x01"
#: Joins hash the smaller side where all of its parts are small, instead of sorting both.
HASHED = {"spark__sql__adaptive__maxShuffledHashJoinLocalMapThreshold": "64m"}

#: Working columns, named so that they meet no column of the input.
KEY, SLOT, RUNS, N_RUNS, N_WORDS = "__key", "__slot", "__runs", "__n_runs", "__n_words"


def hashes(text: Column) -> Column:
    """Of the text's words, in order."""
    words = F.array_remove(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ", -1), "")
    return F.transform(words, lambda word: F.xxhash64(word))


def pieces(text: Column) -> Column:
    """The text cut behind each blank and line end; the pieces joined are the text."""
    marked = F.replace(F.replace(text, F.lit(" "), F.lit(" " + MARK)), F.lit("\n"), F.lit("\n" + MARK))
    return F.when(text.contains(MARK), F.split(text, "(?<=[ \n])", -1)).otherwise(F.split(marked, MARK, -1))


def part(array: Column | str, start: Column, n: Column | int) -> Column:
    return F.slice(array, start + 1, F.lit(n) if isinstance(n, int) else n)


def marks(keyed: DataFrame, min_words: int) -> DataFrame:
    """keyed (key, ord, text) -> (key, ord, p, a, n, g, h): each fingerprint g and its place p, the n windows from a on that hold it, and the hash h of their words."""
    length = fingerprint_words(min_words)
    cells = min_words - length + 1
    rows = keyed.select("key", "ord", hashes(F.col("text")).alias("t"))
    last = F.size("t") - min_words
    # the outer explode has no filter inferred, which would be pushed down into the arrays
    rows = rows.select("key", "ord", "t", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("i"))
    # a window's choice differs from that of the window before it if the word that left was that one's, or the word that entered is its own
    left, entered = F.get("t", F.col("i") - 1), F.get("t", F.col("i") + (cells - 1))
    rest = F.array_min(part("t", F.col("i"), cells - 1)) if cells > 1 else F.lit(None).cast("long")
    # a few neighbours settle most places before the least of all is looked for
    near = range(min(4, cells - 1))
    left_may = reduce(and_, [left <= F.get("t", F.col("i") + k) for k in near], F.lit(True))
    entered_may = reduce(and_, [entered < F.get("t", F.col("i") + (cells - 2 - k)) for k in near], F.lit(True))
    changed = (left_may & (left <= rest)) | (entered_may & (entered < rest)) if cells > 1 else F.col("i").isNotNull()
    chosen = rows.where((F.col("i") == 0) | changed)
    p = (F.col("i") + F.array_position(part("t", F.col("i"), cells), F.least(rest, entered)) - 1).cast("int")
    # the windows before i have another place, so those from i on are all that this one answers for
    placed = chosen.select("key", "ord", "t", p.alias("p"), F.col("i").alias("a"))
    placed = placed.select("*", (F.least("p", F.size("t") - min_words) - F.col("a") + 1).alias("n"))
    # of the windows, those that begin half of the reach or more before p all hold the words before it, the others those behind it
    reach = reach_before(min_words)
    placed = placed.select("*", F.xxhash64(part("t", F.col("p"), length)).alias("g"))
    # each word is hashed once: a hash takes in those of the words that it holds
    low, high, end = F.greatest(F.col("p") - reach, "a"), F.col("p") + (min_words - reach + 1), F.col("a") + F.col("n") + (min_words - 1)
    before = F.xxhash64(part("t", low, F.col("p") - low), F.col("g")).alias("before")
    behind = F.xxhash64(part("t", F.col("p") + length, min_words - reach + 1 - length), F.col("g")).alias("behind")
    placed = placed.select("*", before, behind)
    return placed.select(
        "key", "ord", "p", "a", "n", "g",
        F.xxhash64(part("t", F.col("a"), low - F.col("a")), part("t", high, F.greatest(end - high, F.lit(0))), F.col("p") - F.col("a"), "before", "behind").alias("h"),
        "before", "behind",
    )


def fingerprint_words(min_words: int) -> int:
    """Of a window; the fewer they are, the fewer places there are."""
    return max(min_words // 5, 1)


def reach_before(min_words: int) -> int:
    return max((min_words - fingerprint_words(min_words) + 1) // 2, 1)


def halves(places: DataFrame, min_words: int) -> DataFrame:
    """places (key, p, a, n, before, behind) -> (key, a, n): their windows that another place can hold, told by the words that half of them share."""
    last, middle = F.col("a") + F.col("n") - 1, F.col("p") - reach_before(min_words)
    first_half = F.struct(F.col("before").alias("s"), F.col("a"), (F.least(last, middle) - F.col("a") + 1).alias("n"))
    second_half = F.struct(F.col("behind").alias("s"), F.greatest("a", middle + 1).alias("a"), (last - F.greatest("a", middle + 1) + 1).alias("n"))
    each = written(places.select("key", F.explode(F.array(first_half, second_half)).alias("half")).select("key", "half.*").where("n > 0"))
    return each.join(written(each.groupBy("s").agg(F.count("*").alias("many")).where("many > 1").select("s")), "s").drop("s")


def firsts(places: DataFrame, *by: str) -> DataFrame:
    """The first place of each group of more than one: (by..., first)."""
    found = places.groupBy(*by).agg(F.min(F.struct("ord", "key", "p")).alias("first"), F.count("*").alias("many"))
    return written(found.where("many > 1").drop("many"))


def later(min_words: int) -> Column:
    """Not the first place itself, nor one that overlaps it."""
    return (F.col("key") != F.col("first.key")) | (F.col("p") - F.col("first.p") >= min_words)


def windows(asked: DataFrame, min_words: int) -> DataFrame:
    """asked (key, ord, text, groups array<struct<a, n>>) -> (key, ord, p, w): place and hash of each window of the groups."""
    rows = asked.select("key", "ord", hashes(F.col("text")).alias("t"), "groups")
    # groups of neighbours overlap, and each window is hashed once
    places = F.array_distinct(F.flatten(F.transform("groups", lambda at: F.sequence(at["a"], at["a"] + at["n"] - 1))))
    rows = rows.select("key", "ord", "t", F.explode_outer(places).alias("p"))
    return rows.select("key", "ord", "p", F.xxhash64(part("t", F.col("p"), min_words)).alias("w"))


def runs(found: DataFrame, min_words: int) -> DataFrame:
    """found (key, a, n), n windows from word a on -> (key, runs array<struct<low, high>>): their union, in order."""
    by = Window.partitionBy("key").orderBy("low", "high")
    before = F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.select("key", F.col("a").alias("low"), (F.col("a") + F.col("n") + (min_words - 1)).alias("high"))
    spans = spans.withColumn("opens", F.coalesce(F.col("low") > before, F.lit(True)).cast("int"))
    spans = spans.withColumn("run", F.sum("opens").over(by)).groupBy("key", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("runs"))


def repeats(keyed: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """keyed (key, ord, text) -> (key, runs array<struct<low, high>>): the words that equal earlier ones."""
    placed = written(marks(keyed, min_words))
    shared = placed.groupBy("g").agg(F.count("*").alias("many"), (F.min("h") == F.max("h")).alias("same")).where("many > 1")
    hits = written(placed.join(written(shared.drop("many")), "g"))
    whole = hits.join(firsts(hits, "g", "h"), ["g", "h"], "left")
    whole = written(whole.withColumn("later", F.coalesce(later(min_words), F.lit(False))).where("later or not same"))
    asked = written(halves(whole.where("not later"), min_words).groupBy("key").agg(F.collect_set(F.struct("a", "n")).alias("groups")))
    near = keyed.withColumn("slot", slot(F.col("key"))).join(slots(asked, "key"), "slot", "left_semi").drop("slot")
    single = written(windows(near.join(asked, "key"), min_words))
    single = single.join(firsts(single, "w"), "w").where(later(min_words)).select("key", F.col("p").alias("a"), F.lit(1).alias("n"))
    return written(runs(whole.where("later").select("key", "a", "n").unionByName(single), min_words))


def cut(rows: DataFrame) -> DataFrame:
    """rows (..., text, RUNS) -> (..., text, N_RUNS, N_WORDS): the text less its runs of words."""
    own = [c for c in rows.columns if c not in ("text", RUNS)]
    split, at, spans = "__pieces", "__at", F.col(RUNS)
    rows = rows.withColumn(split, F.when(spans.isNotNull(), pieces(F.col("text"))))
    # the piece of each word, where two blanks in a row or one ahead leave pieces without one; else words and pieces have the same numbers
    odd = F.array_contains(split, " ") | F.array_contains(split, "\n")
    places = F.filter(F.transform(split, lambda x, i: F.when(~x.isin("", " ", "\n"), i)), lambda i: i.isNotNull())
    rows = rows.withColumn(at, F.when(odd, places))
    begin = lambda r: F.when(r["low"] == 0, 0).otherwise(F.coalesce(F.get(at, r["low"]), r["low"]))
    end = lambda r: F.coalesce(F.get(at, r["high"]), F.when(F.col(at).isNull(), r["high"]), F.size(split))
    rows = rows.withColumn(RUNS, F.transform(spans, lambda r: F.struct((r["high"] - r["low"]).alias("n"), begin(r).alias("low"), end(r).alias("high"))))
    joined = lambda low, high: F.array_join(part(split, low, high - low), "")
    ahead = F.transform(spans, lambda r, i: joined(F.coalesce(F.get(spans, i - 1)["high"], F.lit(0)), r["low"]))
    text = F.concat(F.array_join(ahead, ""), joined(F.element_at(spans, -1)["high"], F.size(split)))
    removed = F.aggregate(spans, F.lit(0), lambda n, r: n + r["n"])
    return rows.select(
        *own, F.when(spans.isNull(), F.col("text")).otherwise(text).alias("text"),
        F.coalesce(F.size(spans), F.lit(0)).alias(N_RUNS), F.coalesce(removed, F.lit(0)).alias(N_WORDS),
    )


def slots(keys: DataFrame, name: str) -> DataFrame:
    """The slots that the keys fall into: SLOTS rows at most, whatever the data, to be sent to every task."""
    return F.broadcast(keys.select(slot(F.col(name)).alias("slot")).distinct())


def slot(key: Column) -> Column:
    return F.pmod(key, F.lit(SLOTS))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, added: tuple[str, str, str] = ADDED) -> DataFrame:
    """docs with ``text`` less its repeated passages, and (named ``added``) its characters, runs cut and words cut."""
    own = [c for c in docs.columns if c not in added and c != "text"]
    key = F.xxhash64("doc_id", "text")
    keyed = docs.where("text is not null").select(key.alias("key"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("ord"), "text")
    with settings(docs.sparkSession, **HASHED):
        found = repeats(keyed, min_words).withColumnsRenamed({"key": KEY, "runs": RUNS})
    # only texts whose slot has a match are shuffled
    rows = docs.select(*own, "text").withColumns({KEY: F.when(F.col("text").isNotNull(), key)}).withColumn(SLOT, slot(F.col(KEY)))
    full = slots(found, KEY).withColumnRenamed("slot", SLOT)
    clear = rows.join(full, SLOT, "left_anti").select(*own, "text")
    hit = cut(rows.join(full, SLOT, "left_semi").join(found, KEY, "left").select(*own, "text", RUNS))
    done = hit.unionByName(clear.withColumns({N_RUNS: F.lit(0), N_WORDS: F.lit(0)}))
    return done.withColumn(added[0], F.length("text")).withColumnsRenamed({N_RUNS: added[1], N_WORDS: added[2]})
