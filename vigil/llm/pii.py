"""Personal data by weak supervision, with DataFrame functions only.

Base spans are the matches of four fixed patterns that pass their checks; they always stay.
Further spans are proposed by wider patterns (credentials, national ids, bank accounts,
phone numbers without a country code, disguised addresses). Five labelers vote on every
proposal, yes, no or not at all: its strict pattern, its checks, a gazetteer, the words
before it, and its borders. Expectation-maximisation over the counts of vote patterns (at
most 3**5 for each kind, whatever the data) estimates how reliable each labeler is, without
labels. The posteriors train the final classifier, naive Bayes over votes and the span's
shape, from sums over all proposals; spans it gives ``ACCEPT`` or more are added, unless
they overlap a base span.

Positions are code points, ends exclusive. A span runs to the end of what it names, however long
that is: keys, tokens and account numbers have no upper length but their own form's. Very
long texts are rows like others. Nulls: a null text is an empty one, without spans. Repeated rows give repeated results. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

ACCEPT = 0.9
BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "account", "national_id", "phone_loose", "email_loose")
KINDS = BASE + ADDED

# The four base patterns. Runs are possessive and start at their first
# character, which finds the same matches without going back over long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# Proposals: the kind, a pattern whose match is the span, and the strict form of the span.
PROPOSALS = (
    ("secret", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{12,20}(?![A-Za-z0-9])", r"^(?:AKIA|ASIA)[0-9A-Z]{16}$"),
    ("secret", r"(?<=password[=:]|passwd[=:]|secret[=:]|token[=:])[^\s\"',;]{6,}+", r"^[0-9A-Za-z+/_=.-]{8,}$"),
    ("secret", r"(?<![0-9A-Za-z])(?=[0-9a-f]*+(?<=[0-9a-f]{32})(?![0-9A-Za-z]))(?=[a-f]*+[0-9])[0-9a-f]++", r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"),
    ("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9][0-9A-Z]{0,3})?(?![A-Za-z0-9])", r"^[A-Z]{2}[0-9]{2}(?: ?[0-9]{4}){2,7}(?: ?[0-9]{1,4})?$"),
    ("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"),
    ("phone_loose", r"(?<![0-9+-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])", r"^\(?[2-9][0-9]{2}\)?[-. ]?[2-9][0-9]{2}[-. ][0-9]{4}$"),
    ("email_loose", r"[A-Za-z0-9._%+-]{2,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{2,64}(?: ?[\[(]dot[\])] ?|\.)[A-Za-z]{2,24}", r"^[A-Za-z0-9._%+-]+ ?[\[(]at[\])]"),
)

# What the gazetteer knows, by the part of a span that it looks up.
GAZETTEER = {
    "secret": "AKIA ASIA ghp_ gho_ ghu_ ghs_ xoxb xoxp xoxa xoxr AIza".split(),
    "account": (
        "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV "
        "MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK".split()
    ),
    "phone_loose": (
        "201 202 203 205 206 207 208 209 210 212 213 214 215 216 217 218 219 224 225 228 229 231 234 239 240 248 251 252 253 254 256 260 262 267 269 270 "
        "276 281 301 302 303 304 305 307 308 309 310 312 313 314 315 316 317 318 319 320 321 323 330 334 336 337 339 347 351 352 360 361 386 401 402 404 "
        "405 406 407 408 409 410 412 413 414 415 417 419 423 425 432 434 440 443 469 478 479 480 484 501 502 503 504 505 507 508 509 510 512 513 515 516 "
        "517 518 520 530 540 541 551 559 561 562 563 567 570 571 573 574 580 585 586 601 602 603 605 606 607 608 609 610 612 614 615 616 617 618 619 620 "
        "623 626 630 631 636 641 646 650 651 660 661 662 678 682 701 702 703 704 706 707 708 712 713 714 715 716 717 718 719 720 724 727 731 732 734 740"
    ).split(),
    "email_loose": "com net org edu gov mil int info biz io ai app dev me tv co de fr es it pt nl be at ch uk ie se no dk fi pl cz eu us ca au nz jp cn in br mx".split(),
}


def entry(kind: str, value: Column) -> Column:
    """The part of a span that the gazetteer looks up."""
    return {
        "secret": F.substring(value, 1, 4),
        "account": F.substring(value, 1, 2),
        "phone_loose": F.substring(digits(value), 1, 3),
        "email_loose": F.lower(F.substring_index(F.regexp_replace(value, r"[\])\[( ]", "."), ".", -1)),
    }[kind]


def listed(kind: str, value: Column) -> Column:
    """Whether the gazetteer has the span; of national ids it has the areas that are given out, by rule."""
    if kind == "national_id":
        area = F.substring(value, 1, 3).cast("int")
        return area.between(1, 899) & (area != 666)
    return entry(kind, value).isin(GAZETTEER[kind])


# The words that the context labeler looks for.
CUES = {
    "secret": "(?i)key|token|secret|passw|pwd|auth|credential",
    "account": "(?i)iban|account|konto|cuenta|compte|bank",
    "national_id": "(?i)ssn|social|security|insurance",
    "phone_loose": "(?i)phone|tel|call|fax|mobile|cell",
    "email_loose": "(?i)mail|contact|write|reach",
}
VOTERS = ("strict", "checks", "gazetteer", "context", "borders")
YES, NO, NONE = 1, 0, 2

SPAN = "array<struct<s:int,e:int,v:string>>"
VOTED = "array<struct<kind:string,s:int,e:int,votes:array<int>,shape:array<string>>>"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once for each row."""
    return F.get(F.transform(F.array(value), body), 0)


def located(text: Column, pattern: str) -> Column:
    """All matches with their places: array<struct<s, e, v>>."""
    parts = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def places(p: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(p["between"], i))
            value = F.get(p["found"], i)
            span = F.struct(start.alias("s"), (start + F.length(value)).alias("e"), value.alias("v"))
            return F.struct((start + F.length(value)).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        nothing = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
        return F.when(F.size(p["found"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(p["found"]) - 1), nothing, step)["out"]).otherwise(nothing["out"])

    return let(parts, places)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    doubled = F.transform(
        F.regexp_extract_all(F.reverse(number), F.lit("[0-9]"), F.lit(0)),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$")
    if kind == "card":
        return let(digits(value), lambda n: F.length(n).between(16, 19) & luhn(n))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(located(text, PATTERNS[kind]), lambda m: passes(kind, m["v"]))
    return F.when(text.contains(NEEDS[kind]), found).otherwise(F.array().cast(SPAN))


def votes(kind: str, strict: str, text: Column, m: Column) -> Column:
    before, after = F.substring(text, F.greatest(m["s"] - 29, F.lit(1)), F.least(m["s"], F.lit(30))), F.substring(text, m["e"] + 1, 1)
    value, number = m["v"], digits(m["v"])
    yes = lambda c, otherwise=NO: F.when(c, YES).otherwise(otherwise)
    checks = {
        "secret": yes((F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")),
        "account": yes(F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34)),
        "national_id": yes(F.length(number) == 9),
        "phone_loose": yes(~number.rlike("^(.)\\1+$")),
        "email_loose": yes(value.rlike("[A-Za-z]")),
    }[kind]
    return F.array(
        yes(value.rlike(strict)),
        checks,
        yes(listed(kind, value), NONE),
        yes(before.rlike(CUES[kind]), NONE),
        yes(((before == "") | before.rlike(r"[\s\"'(=:]$")) & ((after == "") | after.rlike(r"[\s\"').,;]"))),
    )


def shape(kind: str, value: Column) -> Column:
    share = lambda cls: F.floor(4 * F.length(F.regexp_replace(value, f"[^{cls}]", "")) / F.length(value)).cast("string")
    return F.array(
        F.concat(F.lit("length:"), F.floor(F.log2(F.length(value).cast("double"))).cast("string")),
        F.concat(F.lit("digits:"), share("0-9")),
        F.concat(F.lit("capitals:"), share("A-Z")),
        F.concat(F.lit("first:"), F.regexp_replace(F.regexp_replace(F.substring(value, 1, 1), "[A-Za-z]", "a"), "[0-9]", "0")),
    )


def proposed(text: Column, kind: str, pattern: str, strict: str) -> Column:
    def voted(m: Column) -> Column:
        ballot, form = votes(kind, strict, text, m).alias("votes"), shape(kind, m["v"]).alias("shape")
        return F.struct(F.lit(kind).alias("kind"), m["s"].alias("s"), m["e"].alias("e"), ballot, form)

    return F.transform(located(text, pattern), voted)


def proposals(text: Column) -> Column:
    return F.concat(*(proposed(text, *p) for p in PROPOSALS)).cast(VOTED)


def named(kind: str) -> Column:
    """The base spans of a kind with its name."""
    return F.transform(kind, lambda m: F.struct(F.lit(kind).alias("kind"), m["s"].alias("s"), m["e"].alias("e")))


def of_kind(spans: str, kind: str) -> Column:
    return F.array_sort(F.filter(spans, lambda p: p["kind"] == kind), lambda a, b: a["s"] - b["s"])


def reliabilities(counts: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[dict]]:
    """Expectation-maximisation for one kind: the share of true spans, and P(vote | true or not) of each labeler."""
    total = sum(n for _, n in counts)
    prior = 0.5
    given = [{(v, y): (0.8 if v == y else 0.2) if v != NONE else 0.5 for v in (YES, NO, NONE) for y in (0, 1)} for _ in VOTERS]
    for _ in range(rounds):
        sums = [defaultdict(float) for _ in VOTERS]
        weight = [0.0, 0.0]
        for pattern, n in counts:
            p = posterior(pattern, prior, given)
            for y, share in ((1, p), (0, 1 - p)):
                weight[y] += n * share
                for k, v in enumerate(pattern):
                    sums[k][v, y] += n * share
        prior = (weight[1] + 1) / (total + 2)
        # a little of the first beliefs keeps the two classes from changing places
        given = [
            {(v, y): (s[v, y] + 4 * (0.6 if v == y else 0.2)) / (weight[y] + 4) for v in (YES, NO, NONE) for y in (0, 1)}
            for s in sums
        ]
    return prior, given


def posterior(pattern: tuple[int, ...], prior: float, given: list[dict]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(g[v, 1] / g[v, 0]) for g, v in zip(given, pattern))
    return 1 / (1 + math.exp(-odds))


def train(rows: DataFrame) -> dict[str, dict[str, float]]:
    """rows (proposed) -> for each kind the log-odds of its features; 'prior' is one of them."""
    spans = rows.select(F.explode("proposed").alias("p")).select("p.*")
    by_pattern = spans.groupBy("kind", "votes").count().collect()  # at most 3**5 rows for each kind
    soft, model = {}, {}
    for kind in ADDED:
        counts = [(tuple(r["votes"]), r["count"]) for r in by_pattern if r["kind"] == kind]
        if counts:
            prior, given = reliabilities(counts)
            soft |= {(kind, pattern): posterior(pattern, prior, given) for pattern, _ in counts}
    if not soft:
        return model
    spark = rows.sparkSession
    table = spark.createDataFrame([(k, list(p), y) for (k, p), y in soft.items()], "kind string, votes array<int>, y double")
    named = F.transform("votes", lambda v, i: F.concat(F.lit("vote:"), i.cast("string"), F.lit("="), v.cast("string")))
    sums = (
        spans.join(F.broadcast(table), ["kind", "votes"])
        .select("kind", "y", F.explode(F.concat(F.array(F.lit("prior")), named, "shape")).alias("feature"))
        .groupBy("kind", "feature")
        .agg(F.sum("y").alias("yes"), F.sum(1 - F.col("y")).alias("no"))
        .collect()  # kinds times features, both fixed
    )
    base = {r["kind"]: (r["yes"], r["no"]) for r in sums if r["feature"] == "prior"}
    for r in sums:
        yes, no = base[r["kind"]]
        odds = math.log((yes + 1) / (no + 1)) if r["feature"] == "prior" else math.log((r["yes"] + 1) / (yes + 2)) - math.log((r["no"] + 1) / (no + 2))
        model.setdefault(r["kind"], {})[r["feature"]] = odds
    return model


def accepted(p: Column, model: dict[str, dict[str, float]]) -> Column:
    weights = {f"{k}|{f}": w for k, fs in model.items() for f, w in fs.items()}
    if not weights:
        return F.lit(False)
    table = F.create_map(*(F.lit(x) for kv in sorted(weights.items()) for x in kv))
    named = F.transform(p["votes"], lambda v, i: F.concat(F.lit("vote:"), i.cast("string"), F.lit("="), v.cast("string")))
    features = F.concat(F.array(F.lit("prior")), named, p["shape"])
    odds = F.aggregate(features, F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(table, F.concat(p["kind"], F.lit("|"), f)), F.lit(0.0)))
    return odds >= math.log(ACCEPT / (1 - ACCEPT))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base spans and added spans as array<struct<kind, s, e>>, in the order of KINDS."""
    text = F.coalesce("text", F.lit(""))
    busy = text.rlike("[0-9@]|\\((?:at|AT)\\)|\\[(?:at|AT)\\]|passw|secret|token|AKIA|ASIA")
    none, no_votes = F.array().cast(SPAN), F.array().cast(VOTED)
    found = checkpoint(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            *(F.when(busy, base_spans(text, k)).otherwise(none).alias(k) for k in BASE),
            F.when(busy, proposals(text)).otherwise(no_votes).alias("proposed"),
        )
    )
    found = found.withColumn("base", F.concat(*map(named, BASE)))
    model = train(found)
    free = F.filter("proposed", lambda p: accepted(p, model) & ~F.exists("base", lambda b: (b["s"] < p["e"]) & (p["s"] < b["e"])))
    # of overlapping proposals the first kind, then the first place, stays
    ordered = F.concat(*(of_kind("free", k) for k in ADDED))
    kept = F.aggregate(
        "ordered", F.array().cast("array<struct<kind:string,s:int,e:int>>"),
        lambda acc, p: F.when(F.exists(acc, lambda o: (o["s"] < p["e"]) & (p["s"] < o["e"])), acc)
        .otherwise(F.concat(acc, F.array(F.struct(p["kind"].alias("kind"), p["s"].alias("s"), p["e"].alias("e"))))),
    )
    return (
        found.withColumn("free", free).withColumn("ordered", ordered)
        .select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), "base", kept.alias("added"))
    )


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["s"], m["e"])), ",")
