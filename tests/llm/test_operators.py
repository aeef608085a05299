"""Each corpus operator on odd tables, and against brute force."""

import hashlib
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vigil.llm import ann, decontam, html_extract, license_scan, line_dedup, packing, pii, queries, sharding, simhash, toxicity
from vigil.llm.graph import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, key string, slot int, found string"
ODD = [
    (1, None, "en", "s", 0, "x", 1, "y"), (2, "", "en", "s", 0, "x", 1, "y"), (3, " \n ", "en", "s", 3, "x", 1, "y"), (None, "no id here", "en", "s", 10, None, None, None),
    (4, "same words here again, twice over.", "en", "s", 1, "x", 1, "y"), (4, "same words here again, twice over.", "en", "s", 1, "x", 1, "y"),
    (5, "same words here again, twice over.", None, None, None, "x", 1, "y"), (6, "long " * 60_000, "en", "s", 1, "x", 1, "y"), (7, "Ünïcode ñandú 日本語 \U0001f600 text", "es", "s", 1, "x", 1, "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


LABELS = "doc_id long, quality int, toxic int"
BENCH = "item_id long, text string"


def apply(name, spark, d):
    labels = spark.createDataFrame([(4, 1, 1), (7, 1, 0), (5, None, None), (99, 1, 1), (None, 1, 1)], LABELS)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "same words here"), (3, "same words here"), (4, "absent item of words")], BENCH)
    return {
        "license": lambda: license_scan.scan(d), "toxicity": lambda: toxicity.score(d, toxicity.fit(d, labels)), "simhash": lambda: simhash.near_duplicates(d),
        "one_of_each": lambda: simhash.one_of_each(d), "pii": lambda: pii.scan(d), "line_dedup": lambda: line_dedup.dedup(d),
        "decontam": lambda: decontam.scan(d, bench), "shard": lambda: sharding.shard(d, shards=4), "pack": lambda: packing.pack(d, length=64),
    }[name]()


@pytest.mark.parametrize("name", ["license", "toxicity", "simhash", "one_of_each", "pii", "line_dedup", "decontam", "shard", "pack"])
def test_odd_and_empty_tables(spark, odd, none, name):
    rows = apply(name, spark, odd).collect()
    if name == "pack":
        assert sum(r["length"] for r in rows) == sum({(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]): r["length"] for r in rows}.values())
    elif name == "one_of_each":
        # null, empty and blank texts are one class; the three copies another
        assert sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 4, 6, 7]
    else:
        assert len(rows) == len(ODD)
    assert apply(name, spark, none).collect() == []


def test_toxicity_learns_held_out_documents(spark, sf):
    g = np.random.default_rng(0)
    words = ["".join(g.choice(list("abdeghiklmnoprstu"), g.integers(2, 8))) for _ in range(400)]
    rows = []
    for i in range(700):
        text = list(g.choice(words, g.integers(20, 120)))
        bad = i % 4 == 0
        if bad:
            text.insert(int(g.integers(len(text))), str(g.choice(["zzqrude", "vvcurse"])))
        rows.append((i, " ".join(text), int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score(d, toxicity.fit(d, d.select("doc_id", F.lit(1).alias("quality"), "toxic"))).where(toxicity.held_out()).collect()
    score, bad = np.array([r["score"] for r in got]), np.array([r["toxic"] == 1 for r in got])
    assert (score[bad][:, None] > score[~bad][None, :]).mean() > 0.95


def plain_score(net, text):
    """The network's score of a text, word by word and window by window."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    H, p = toxicity.HIDDEN, net.p
    tokens = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text)
    gates = []
    for token in tokens:
        word = re.sub("[A-Z]", lambda m: m.group().lower(), token).encode()
        power, code = 1, 0
        for b in word:
            power = power * 0x9E3779B97F4A7C15 % 2**64
            code = (code + (b + 1) * power) % 2**64
        bucket = (code * 0xD6E8FEB86659FD93 % 2**64) >> 49
        marked = b"\x01" + word + b"\x02\x00\x00\x00"
        grams = [int.from_bytes(marked[i : i + 4], "little") * 0x9E3779B1 % 2**32 >> 17 for i in range(len(word))]
        x = np.concatenate([net.word[bucket], net.gram[grams].mean(axis=0), [net.word_odds[bucket], net.gram_odds[grams].max()]])
        gates.append(x @ p["W"] + p["b"])
    worst = -np.inf
    for first in [*range(0, max(len(tokens) - toxicity.WINDOW, 0), toxicity.STEP), max(len(tokens) - toxicity.WINDOW, 0)]:
        own = gates[first : first + toxicity.WINDOW]
        states = [np.zeros((len(own), H)) for _ in range(2)]
        for way in (0, 1):
            h = np.zeros(H)
            for t in range(len(own)) if way == 0 else reversed(range(len(own))):
                a, u = own[t][way * 3 * H : (way + 1) * 3 * H], h @ p["U"][way]
                r, z = sig(a[:H] + u[:H]), sig(a[H : 2 * H] + u[H : 2 * H])
                h = states[way][t] = (1 - z) * np.tanh(a[2 * H :] + r * u[2 * H :]) + z * h
        s = np.concatenate(states, axis=1)
        weight = np.exp(np.tanh(s @ p["A"] + p["a"]) @ p["v"])
        worst = max(worst, (weight / weight.sum()) @ s @ p["o"] + p["c"][0] if own else p["c"][0])
    return sig(worst)


def test_toxicity_against_a_plain_network():
    g = np.random.default_rng(6)
    net = toxicity.Network(3)
    net.word_odds, net.gram_odds = (g.normal(size=toxicity.BUCKETS).astype(np.float32) for _ in range(2))
    words = ["Straße", "a", "Quite", "x1", "日本語", "longerword", "don", "t", "ÄB"]
    texts = [" ".join(g.choice(words, n)) + "." for n in (1, 2, 16, 31, 32, 33, 48, 49, 64, 65, 200)]
    got = net.score([t.encode() for t in [*texts, ""]])
    assert np.allclose(got[:-1], [plain_score(net, t) for t in texts], atol=1e-4)
    assert abs(got[-1] - plain_score(net, "")) < 1e-4


def test_toxicity_windows_hold_every_short_run():
    for n in range(1, 200):
        first, size, doc = toxicity.windows(np.array([0, n]))
        assert first[-1] + size[-1] == n and all(b <= a + toxicity.WINDOW // 2 for a, b in zip(first, first[1:])) and (size == min(n, toxicity.WINDOW)).all()


def test_toxicity_sample_asks_one_text_of_an_id(spark):
    rows = [(i % 7, f"text {i}", int(i % 7 > 3)) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    texts, toxic = toxicity.training_rows(d, d.select("doc_id", "toxic"))
    assert 0 < len(texts) <= 7 and len(set(texts)) == len(texts)


def test_toxicity_sample_does_not_follow_the_file(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_CHARS", 4000)
    rows = [(0, "x" * 5000, 0), *((i, f"plain {i} " + "word " * 20, 0) for i in range(1, 100)), *((i, f"bad {i} " + "word " * 20, 1) for i in range(100, 200))]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int").coalesce(1)
    texts, toxic = toxicity.training_rows(d, d.select("doc_id", "toxic"))
    assert 10 < toxic.sum() < 20 and 20 < (~toxic).sum() < 30 and sum(map(len, texts)) <= 4000
    again = toxicity.training_rows(d.orderBy(F.desc("doc_id")).coalesce(1), d.select("doc_id", "toxic"))
    assert again[0] == texts


def test_gradients_match_differences():
    g = np.random.default_rng(1)
    net = toxicity.Network()
    for k, v in net.p.items():
        net.p[k] = v.astype(np.float64)
    gates, index = g.normal(size=(9, 6 * toxicity.HIDDEN)), g.integers(0, 8, (3, 5))
    live = np.ones((3, 5))
    live[2, 3:] = 0
    toxic = np.array([1.0, 0.0, 1.0])

    def loss():
        logit, memory = net.forward(gates, index, live, keep=True)
        return float(np.log1p(np.exp(-np.where(toxic == 1, logit, -logit))).sum()), logit, memory

    _, logit, memory = loss()
    grad, d_gates = net.backward(1 / (1 + np.exp(-logit)) - toxic, index, live, memory)
    for name in ("U", "A", "a", "v", "o", "c"):
        at = tuple(0 for _ in net.p[name].shape)
        keep, step = net.p[name][at], 1e-3
        net.p[name][at] = keep + step
        up = loss()[0]
        net.p[name][at] = keep - step
        down = loss()[0]
        net.p[name][at] = keep
        assert abs((up - down) / (2 * step) - grad[name][at]) < 2e-2 * max(1, abs(grad[name][at])), name


def test_html():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class='cookie-notice'>We, use, cookies</div><header>Site</header>"
        "<script>var t='</p>';</script><article><h1>Head &amp; line</h1><p>First,\n para<br>graph&nbsp;one.<p>Second <b>bold<form>Name</form><aside>Side</aside></article>"
        "<section id=comments><p>Nice, nice, nice</p></section><footer>&copy;</footer></body></html>"
    )
    assert html_extract.main_text(page) == "Head & line\nFirst, para graph one.\nSecond bold"
    assert html_extract.main_text(None) == html_extract.main_text("") == ""
    assert html_extract.main_text("<div><div class=sidebar><ul><li><a>x</a></ul></div><div class=content><p>a, b, c, d</p><p>e</p></div></div>") == "a, b, c, d\ne"


def test_benchmark_windows_are_arrays_of_bounded_size():
    import pickle

    g = np.random.default_rng(8)
    items = [(i, " ".join(f"w{x}" for x in g.integers(0, 50_000, n))) for i, n in enumerate([0, 1, 5, 12, 13, 14, *[1000] * 100])] + [(7, "one two"), ("8", "one two"), (9, None)]
    windows = decontam.Windows(items)
    want: dict[tuple, set] = {}
    for item, text in items:
        w = decontam.words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            want.setdefault(tuple(w[i : i + 13]), set()).add(item)
    name = {v: k for k, v in windows.code.items()}
    got = {tuple(name[c] for c in row if c): windows.items(k) for k, row in enumerate(windows.patterns.tolist())}
    assert got == want and windows.shortest == 1 and [len(k) for k in got] == windows.lengths.tolist()
    assert len(pickle.dumps(windows)) < 80 * 100_000
    assert decontam.Windows([]).shortest == 0 and len(decontam.Windows([(1, None), (2, "")]).patterns) == 0


def test_decontamination_in_parts_and_removal(spark):
    long = " ".join(f"W{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"a b, {long}! c d", 5, "x"), (2, "nothing here", 6, "y"), (3, None, 7, "z")], "doc_id long, text string, n_hit int, spans string")
    bench = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 20))) for i in range(0, 20, 5)] + [(99, "d")], BENCH).coalesce(1)
    whole, parts = (
        {r["doc_id"]: r.asDict(True) for r in decontam.scan(docs, bench, keep=tuple(docs.columns), prefix="f_", max_words=n).collect()} for n in (5_000_000, 20)
    )
    assert whole == parts and whole[1]["f_n_hit"] == 36 and whole[1]["f_n_items"] == 5 and whole[1]["n_hit"] == 5
    got = {r["doc_id"]: r for r in decontam.removed(docs, bench).collect()}
    assert got[1]["text"] == "a b, ! c d".replace("! c d", f" {' '.join(f'W{i}' for i in range(35, 40))}! c ") and got[2]["text"] == "nothing here" and got[3]["text"] is None


def test_html_broken_pages_take_linear_time():
    for piece in ("<a", '<a "', "<!--", "</", "<a ='", "<button>", '<a b="', "<div>x"):
        page = piece * (1_000_000 // len(piece))
        start = time.process_time()
        html_extract.main_text(page)
        html_extract.main_text(page + ">")
        assert time.process_time() - start < 8, piece


def test_html_keeps_what_the_article_holds():
    get = html_extract.main_text
    for tag in ("button", "svg", "select", "video", "object", "math"):
        assert get(f"<article><p>one<{tag}>b<p>two</article>").endswith("\ntwo"), tag
        assert get(f"<article><p>one</p><{tag}/></{tag}><p>two</article>") == "one\ntwo"
    assert get("<article><p>one<button>b</button> more<p>two</article>") == "one more\ntwo"
    assert get("<article><p id='related-work'>Related work in science.<p class='popup-note'>A note.</article>") == "Related work in science.\nA note."
    assert get("<article><p>One, two.</p><div class=related><a href=x>Read this</a></div><div class=newsletter>Sign up</div></article>") == "One, two."
    assert get("<div><div class=content><p>Long, text.<p>And, more.</div><div class=share-story>Share</div></div>") == "Long, text.\nAnd, more."
    assert get("<p>a < b</p><p>tail <b") == "a < b\ntail <b"


def plain_scores(page):
    """By brute force: each div's score, by walking up from every paragraph of a page of div and p elements."""
    divs, stack, text = [], [], {}
    for end, tag, body in re.findall(r"<(/?)(div|p)>([^<]*)", page):
        if tag == "div":
            if end:
                stack.pop()
            else:
                divs.append({"up": stack[-1] if stack else None, "score": 0.0})
                stack.append(len(divs) - 1)
        elif not end:
            text.setdefault(stack[-1], []).append(body)
            at, share = stack[-1], 1 + body.count(",") + min(len(body) / 100, 3)
            while at is not None:
                divs[at]["score"] += share
                at, share = divs[at]["up"], share * html_extract.PASSED_ON
    best = max(range(len(divs)), key=lambda k: divs[k]["score"])
    kept = {best} | {k for k, d in enumerate(divs) if d["up"] is not None and d["up"] == divs[best]["up"] and d["score"] >= 0.2 * divs[best]["score"]}
    for k, d in enumerate(divs):  # parents come first
        if d["up"] in kept:
            kept.add(k)
    return sorted(x for k in kept for x in text.get(k, []))


def test_html_against_a_plain_tree_scorer():
    g = np.random.default_rng(4)

    def grow(depth):
        inner = [f"<p>{'w, ' * int(g.integers(0, 12))}{g.integers(1 << 40)}</p>" for _ in range(g.integers(0, 4))]
        inner += [grow(depth - 1) for _ in range(g.integers(0, 4) if depth else 0)]
        return f"<div>{''.join(inner[i] for i in g.permutation(len(inner)))}</div>"

    for _ in range(200):
        page = f"<div>{grow(4)}<p>x{g.integers(1 << 40)}</p></div>"
        assert sorted(html_extract.main_text(page).split("\n")) == plain_scores(page)


def test_html_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, None, None, "x", 1), (2, "u", "", "x", 1), (None, "u", "<p>a", "x", 1), (3, "u", "<p>b", "x", 1), (3, "u", "<p>b", "x", 1)]
    got = html_extract.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "a", 1), (1, "", 0), (2, "", 0), (3, "b", 1), (3, "b", 1)]
    assert html_extract.extract(spark.createDataFrame([], schema)).collect() == []


def test_html_pages(spark, sf):
    rows = queries.QUERIES["op3_html_extraction"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) > 0 and "<" not in r["text"] for r in rows)


def test_patience_and_licenses():
    a, b = "a b c d e".split(), "x a y b d z e".split()
    assert license_scan.patience(a, b) == [(0, 1), (1, 3), (3, 4), (4, 6)]
    scanner = license_scan.Scanner()
    mit = license_scan.TEMPLATES[2][1]
    found = scanner.find("Intro. " + mit.upper().replace("SUBLICENSE,", "") + " Outro. Licensed under CC BY-NC 4.0.")
    assert [scanner.names[f[0]] for f in found] == ["MIT", "CC-BY-NC-4.0"] and 0.95 < found[0][1] < 1
    assert scanner.find("the software is free and the word license is here") == []


def test_coverage_never_exceeds_the_longest_common_subsequence():
    g = np.random.default_rng(2)
    for _ in range(200):
        a, b = (list(g.integers(0, 6, g.integers(0, 14))) for _ in range(2))
        pairs = license_scan.patience(a, b)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) <= table[-1, -1]
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def common_words(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, above = [0], row
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
    return row[-1]


def brute_licenses(scanner, text):
    """Every window of every template, none passed over."""
    spans = [m.span() for m in license_scan.WORD.finditer(text.lower())]
    words, found = [text.lower()[a:b] for a, b in spans], []
    for k, template in enumerate(scanner.words):
        width, best, end = len(template) + len(template) // 4 + 2, 0, -1
        for start in range(len(words)):
            window = words[start : start + width]
            need = max(scanner.least[k], best + 1) if start <= end else scanner.least[k]
            if words[start] not in template or common_words(template, window) < need:
                continue
            pairs = license_scan.patience(template, window)
            if len(pairs) >= need:
                best, end = len(pairs), start + pairs[-1][1]
                found.append((k, best / len(template), best, spans[start + pairs[0][1]][0], spans[end][1]))
    kept = []
    for f in sorted(found, key=lambda f: (-f[2], -f[1], f[0], f[3])):
        if all(f[4] <= g[3] or g[4] <= f[3] for g in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f[3])


def test_licenses_against_all_windows():
    g = np.random.default_rng(4)
    templates = (("A", "to any person who may use the work as is"), ("B", "the work may be used by any one"), ("C", "a b a c a b"))
    scanner = license_scan.Scanner(templates)
    vocabulary = sorted(set(" ".join(t for _, t in templates).split())) + ["other", "words"]
    hits = 0
    for _ in range(300):
        text = list(g.choice(vocabulary, g.integers(0, 25)))
        for _ in range(g.integers(0, 4)):
            copy = templates[g.integers(3)][1].split()
            if g.random() < 0.6:
                copy.insert(g.integers(len(copy)), "new")
            if g.random() < 0.4:
                copy.pop(g.integers(len(copy)))
            at = g.integers(len(text) + 1)
            text[at:at] = copy
        found = scanner.find(" ".join(text))
        assert found == brute_licenses(scanner, " ".join(text))
        hits += len(found)
    assert hits > 200


def test_license_words_take_little_time():
    scanner = license_scan.Scanner()
    salad = np.random.default_rng(5).choice(sorted(scanner.vocabulary), 100_000)
    mit = license_scan.TEMPLATES[2][1].split()
    start = time.perf_counter()
    assert not any(scanner.names[f[0]] == "MIT" and f[2] > 100 for f in scanner.find(" ".join(salad)))
    found = scanner.find(" ".join(" ".join(w for i, w in enumerate(mit) if i != n % len(mit)) for n in range(100)))
    assert sum(f[0] == 2 for f in found) == 100
    assert time.perf_counter() - start < 30


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    base = max(texts.values(), key=len)
    near = spark.createDataFrame([(100_000 + i, base.replace(" ", f" w{i} ", 1)) for i in range(6)] + [(200_000, base)], "doc_id long, text string")
    rows = simhash.near_duplicates(docs.select("doc_id", "text").union(near)).collect()
    texts |= {r["doc_id"]: r["text"] for r in near.collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    ids = sorted(texts)
    low = {i: i for i in ids}
    for _ in ids:
        new = {i: min(low[j] for j in ids if bin(prints[i] ^ prints[j]).count("1") <= 2) for i in ids}
        if new == low:
            break
        low = new
    assert {r["doc_id"]: r["component_id"] for r in rows} == low


def test_tiles_find_all_links(spark):
    g = np.random.default_rng(3)
    base = g.integers(0, 2**63, 40)
    values = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in g.integers(0, 63, (12, 2))})
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.tile_links(frame, 2, block=16)).collect()}
    a = np.array(values, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 2
    label = np.arange(len(a))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    assert [roots.get(v, v) for v in values] == [values[k] for k in label]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101 + i) for i in range(50)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(51)} | {200: 200, 201: 200}


def test_pii_base_spans(spark, docs):
    extra = [(900, "a@b.c_d@e.f a@b x@@y.z mail: q.w+e%r@x-y.co.uk."), (901, "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 0010.1.1.255"), (902, "4111 1111 1111 1111 4111-1111-1111-1112 411111111111111111111"),
             (903, "+1 (988) 555-2485, +1 2 +1234567 + 12345678 +49.30.1234567)"), (904, "a" * 200_000 + "@"), (905, "é 1.2.3.4 \U0001f600 +1 555 555 5555")]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(n):
        return sum(d - 9 * (d > 9) for d in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(n)))) % 10 == 0

    def fine(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in v.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()

    got = {r["doc_id"]: r["base"] for r in pii.scan(rows).collect()}
    for doc, text in rows.collect():
        if doc == 904:
            assert got[doc] == []
            continue
        want = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text) if fine(k, m.group())]
        assert [tuple(s) for s in got[doc]] == want, doc


def test_pii_adds_secrets_by_votes(spark):
    rows = [(i, f"plain words then token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" and more") for i in range(40)] + [(100 + i, f"number {i} in plain text") for i in range(40)]
    got = {r["doc_id"]: r["added"] for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([tuple(s) for s in got[i]] == [("secret", 26, 66)] for i in range(40))
    assert not any(got[100 + i] for i in range(40))


def test_em_separates_good_labelers():
    g, counts = np.random.default_rng(4), {}
    for _ in range(4000):
        y = int(g.random() < 0.3)
        votes = tuple(int(v) for v in [y if g.random() < a else 1 - y for a in (0.95, 0.9, 0.85, 0.55, 0.8)])
        counts[votes] = counts.get(votes, 0) + 1
    prior, given = pii.reliabilities(list(counts.items()))
    assert abs(prior - 0.3) < 0.06 and given[0][1, 1] > 0.9 > given[3][1, 1]


def sentence(g, n):
    return " ".join("".join(g.choice(list("abcdefghij"), 5)) for _ in range(n)).capitalize() + ". "


def test_line_dedup(spark):
    g = np.random.default_rng(5)
    passage = "".join(sentence(g, 9) for _ in range(7)).strip()
    own = ["".join(sentence(g, 8) for _ in range(10)).strip() for _ in range(6)]
    short = sentence(g, 6)
    texts = [own[0] + " " + passage + " tail words here.", "start " + passage + " " + own[1], own[2] + "\n" + passage, own[3], own[4] + " " + short, short + own[5], own[3]]
    got = {r["doc_id"]: r for r in line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0]["text"] == texts[0]
    assert got[1]["text"].split() == ["start", *own[1].split()]
    assert got[2]["text"].split() == own[2].split()
    assert [got[i]["text"] for i in (3, 4, 5)] == [texts[i] for i in (3, 4, 5)]
    assert got[6]["text"] == "" and got[6]["n_removed_words"] == len(own[3].split())


def repeated_words(texts, n=50):
    """By brute force: the words of each text that lie in a window of n words that an earlier place holds."""
    first, cut = {}, {}
    for doc in sorted(texts):
        words = re.findall(r"[^ \n]+", texts[doc] or "")
        cut[doc] = set()
        for i in range(len(words) - n + 1):
            at = first.setdefault(tuple(words[i : i + n]), (doc, i))
            if at[0] != doc or i - at[1] >= n:
                cut[doc].update(range(i, i + n))
    return cut


def test_line_dedup_against_all_windows(spark, docs):
    g = np.random.default_rng(12)
    word = lambda n: ["".join(g.choice(list("abcdefghij"), 6)) for _ in range(n)]
    bare, clause = word(50), [" ".join(word(30)) + ", ", " ".join(word(30)) + ". "]
    part = word(60)
    extra = {
        # 50 words without punctuation, in other surroundings, one of them broken by line ends
        1000: [*word(40), *bare, *word(33)], 1001: [*word(7), *bare, *word(90)], 1002: [*word(90), "\n".join(bare)],
        # two clauses of 30 words, and 49 words that repeat
        1010: [*word(20), "".join(clause), *word(9)], 1011: [*word(3), "".join(clause), *word(70)], 1012: [*word(10), *bare[:49], *word(10)],
        # the first places of the runs' halves are in documents that hold no more of them
        1020: [*word(10), *part[:35], *word(10), *part[20:56], *word(5)], 1021: [*word(11), *part, *word(4)], 1022: [*word(60), *part, *word(60)],
        # repeats within a document, and with a short period
        1030: [*(own := word(70)), *word(5), *own], 1031: ["ha"] * 500, 1032: ["ha"] * 80,
    }
    extra |= {1100 + n: word(n) * 3 for n in range(45, 75)}
    extra |= {1200 + n: [*(few := word(n)) * (150 // n), "end"] for n in range(1, 30)} | {1250: [*word(9), *few * 5]}
    extra |= {1300 + n: [*extra[1200 + n][:52], *word(5)] for n in range(1, 30)} | {1350 + n: [*word(3), *extra[1200 + n]] for n in range(1, 30)}
    extra |= {990 + n: [*word(3), *extra[1200 + n][2:52], *word(5)] for n in range(2, 9)}
    rows = docs.select("doc_id", "text").where("doc_id < 990").union(spark.createDataFrame([(i, " ".join(t)) for i, t in extra.items()], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    cut = repeated_words(texts)
    assert all(cut[i] for i in (1001, 1002, 1011, 1022, 1030, 1031, 1032)) and not any(cut[i] for i in (1000, 1010, 1012, 1020, 1021))
    got = {r["doc_id"]: r for r in line_dedup.dedup(rows).collect()}
    for doc, text in texts.items():
        words = re.findall(r"[^ \n]+", text or "")
        assert re.findall(r"[^ \n]+", got[doc]["text"] or "") == [w for i, w in enumerate(words) if i not in cut[doc]], doc
        assert got[doc]["n_removed_words"] == len(cut[doc])
        assert got[doc]["n_runs"] == sum(i - 1 not in cut[doc] for i in cut[doc])


def test_line_dedup_hashes_each_window_once(spark):
    """Places are few, and windows in several groups of a document are one row each."""
    words = [f"w{i}" for i in range(6000)]
    rows = spark.createDataFrame([(1, 1, " ".join(words))], "key long, ord long, text string")
    places = line_dedup.marks(rows, 50).collect()
    assert len(places) < len(words) / 17
    # all windows have a place, and those of neighbours meet on one side only
    covered = [i for r in places for i in range(r["a"], r["a"] + r["n"])]
    assert set(covered) == set(range(len(words) - 49)) and len(covered) < 2 * len(words)
    asked = rows.withColumn("groups", F.expr("array(struct(3 as a, 20 as n), struct(10 as a, 26 as n), struct(40 as a, 1 as n))"))
    assert sorted(r["p"] for r in line_dedup.windows(asked, 50).collect()) == [*range(3, 36), 40]


@pytest.mark.parametrize("n", [1, 2, 3, 6, 11, 25])
def test_line_dedup_of_any_length(spark, n):
    """Few different words, so that passages meet, overlap themselves and differ in single words; odd blanks."""
    g = np.random.default_rng(n)
    base = [g.choice(list("abc"), 60) for _ in range(3)]
    texts = {}
    for doc in range(60):
        words = np.concatenate([base[g.integers(3)][(low := g.integers(40)) : low + g.integers(8, 60)] for _ in range(g.integers(1, 4))])
        words[g.integers(len(words), size=2)] = f"x{doc}"
        texts[doc] = "".join(g.choice(["", "", " ", "\n \n"]) + w + g.choice([" ", " ", "\n"]) for w in words)
    cut = repeated_words(texts, n)
    for r in line_dedup.dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), n).collect():
        words = re.findall(r"[^ \n]+", texts[r["doc_id"]])
        kept = "".join(w + gap for i, (w, gap) in enumerate(re.findall(r"([^ \n]+)([ \n]*)", texts[r["doc_id"]])) if i not in cut[r["doc_id"]])
        lead = "" if 0 in cut[r["doc_id"]] else re.match(r"[ \n]*", texts[r["doc_id"]]).group()
        assert r["text"] == lead + kept, r["doc_id"]
        assert (r["n_removed_words"], r["n_runs"]) == (len(cut[r["doc_id"]]), sum(i - 1 not in cut[r["doc_id"]] for i in cut[r["doc_id"]]))


def test_line_dedup_gathers_by_document_only(spark, monkeypatch):
    """No row holds what many documents share with a first one: lists are of one document's own places."""
    plans = []
    written = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or written(df))
    text = " ".join(f"w{i}" for i in range(300))
    rows = spark.createDataFrame([(i, text) for i in range(200)] + [(900, "own words " + text[:600])], "doc_id long, text string")
    done = line_dedup.dedup(rows)
    plans.append(done._jdf.queryExecution().optimizedPlan().toString())
    lists = [re.search(r"Aggregate \[([^\]]*)\]", line).group(1) for p in plans for line in p.splitlines() if "collect_" in line]
    assert lists and all(re.fullmatch(r"key#\d+L?", keys) for keys in lists)
    assert {r["doc_id"]: r["text"] for r in done.collect()} == {0: text, **{i: "" for i in range(1, 200)}, 900: "own words "}


def test_pieces_join_to_the_text(spark):
    rows = spark.createDataFrame([("a. b,  c\nd \n e",), ("",), (" ",), ("x\x01y. z ",)], "t string").coalesce(1)
    for text, got in rows.select("t", line_dedup.pieces(F.col("t"))).collect():
        assert got == re.split("(?<=[ \n])", text)


def test_suffix_array_and_index():
    g = np.random.default_rng(6)
    for _ in range(20):
        text = np.concatenate([np.append(g.integers(1, 4, g.integers(1, 40)), 0) for _ in range(g.integers(1, 6))]).astype(np.int32)
        ends = np.cumsum(text == 0)
        key = [[(0, int(e)) if c == 0 else (1, int(c)) for c, e in zip(text[i:], ends[i:])] for i in range(len(text))]
        assert decontam.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: key[i])
        index = decontam.FMIndex(text, 4)
        for m in (1, 2, 4):
            pattern = g.integers(1, 4, (1, m))
            low, high = index.search(pattern, np.array([m]))
            want = [i for i in range(len(text) - m + 1) if text[i : i + m].tolist() == pattern[0].tolist()]
            assert sorted(index.locate(np.arange(low[0], max(low[0], high[0]))).tolist()) == want


def test_decontamination(spark, docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    one = next(iter(items.values()))
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(5000, f"Before {one.upper()} after"), (5001, one[: len(one) // 8])], "doc_id long, text string"))
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = {}
    for i, t in items.items():
        w = words(t)
        for k in range(max(1, len(w) - 12)):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    got = {r["doc_id"]: r for r in decontam.scan(rows, bench).collect()}
    for doc, text in rows.collect():
        w, hit, found = words(text), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                own = windows.get(tuple(w[k : k + n]))
                if own and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    found |= own
        r = got[doc]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(map(str, found)))
        assert {x for s in r["spans"] for x in range(s["start"], s["stop"])} == hit


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_sharding(spark, docs, law):
    copies = spark.createDataFrame([(10_000 + i, "the same text") for i in range(300)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(copies)
    got = sharding.shard(rows, shards=8, law=law).toPandas()
    text = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert len(got) == len(text) and all(len(text[i].encode()) + 16 == s and zlib.crc32(text[i].encode()) == c for i, s, c in zip(got.doc_id, got["size"], got.text_crc32))
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard").slot)
    if law == "rows":
        n = got.groupby("shard").size()
        assert n.max() - n.min() <= 1
    else:
        total = got.groupby("shard")["size"].sum()
        assert total.max() - total.min() <= 2 * got["size"].max()


def test_neighbours(spark):
    g = np.random.default_rng(7)
    center = g.normal(size=(30, 16))
    x = (center[g.integers(0, 30, 800)] + 0.4 * g.normal(size=(800, 16))).astype(np.float32)
    x[100:160] = x[100]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1050, [1.0, None] + [0.0] * 14), (1100, [1.0] * 3), (None, x[0].tolist())]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    x = x.astype(np.float64)
    unit, hit = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    assert sorted(got.query_id.unique()) == list(range(0, 800, 50))
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert list(own["rank"]) == [1, 2, 3, 4, 5] and q not in set(own.vec_id)
        near = np.round(unit @ unit[q], 12)
        near[q] = -9
        assert np.allclose(near[own.vec_id], own.score, atol=1e-9)
        hit += len(set(np.lexsort((np.arange(800), -near))[:5]) & set(own.vec_id))
    assert hit >= 0.9 * 16 * 5
    assert list(got[got.query_id == 100].sort_values("rank").vec_id) == [101, 102, 103, 104, 105]
    few = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.1]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["rank"], r["vec_id"]) for r in few] == [(1, 2), (2, 1)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_best_cuts_are_optimal():
    g = np.random.default_rng(8)
    for _ in range(200):
        steps = g.integers(1, 9, g.integers(1, 9))
        at, cost = [0, *np.cumsum(steps).tolist()], [0, *g.integers(0, 6, len(steps)).tolist()]

        def price(cuts):
            ends = [0, *cuts]
            return sum(10 - (b - a) + cost[at.index(b)] for a, b in zip(ends, ends[1:]))

        def all_ways(i):
            return [[]] if i == len(at) - 1 else [[at[j], *rest] for j in range(i + 1, len(at)) if at[j] - at[i] <= 10 for rest in all_ways(j)]

        assert price(packing.best_cuts(at, cost, 10)) == min(map(price, all_ways(0)))


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    extra = spark.createDataFrame([(9000, None), (9001, "<|endoftext|> tab\there  two"), (9002, "a" * 9000), (9003, "日本語 ñ \U0001f600 x" * 50), (9004, "a  b \n\n c   \n1,2 ..  it's  "), (9005, "one \n"), (9006, "x<|endoftext|>y")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(extra)
    pieces = packing.pack(rows, with_ids=True).collect()
    plain = Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and len(p["ids"]) == p["length"] > 0
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for doc, text in rows.collect():
        own = sorted(by_doc[doc], key=lambda p: p["start"])
        ids = [i for p in own for i in p["ids"]]
        assert ids == [*plain.encode(text or "", add_special_tokens=False).ids, 0] and {p["doc_tokens"] for p in own} == {len(ids)}
        assert [p["start"] for p in own] == np.cumsum([0, *(p["length"] for p in own)])[:-1].tolist()
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == np.cumsum([0, *(p["length"] for p in own)])[:-1].tolist()
        assert sum(p["length"] for p in own) <= 1024
    assert sum(p["length"] for p in pieces) > 0.95 * 1024 * (len(by_sequence) - 1)
