"""Operators in SQL for a second engine, where SQL can say what they return."""

from __future__ import annotations


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return table


def crc32(text: str) -> str:
    """The checksum of an expression's UTF-8 bytes."""
    h = f"hex(encode({text}))"
    byte = f"list_transform(range(length({h}) // 2), lambda i: CAST(('0x' || substr({h}, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))"
    step = f"xor(c >> 8, ({_crc_table()})[CAST(xor(c, b) & 255 AS BIGINT) + 1])"
    return f"CASE WHEN {text} = '' THEN 0 ELSE xor(list_reduce({byte}, lambda c, b: {step}, 4294967295), 4294967295) END"


LETTERS = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN = rf"regexp_extract_all({LETTERS}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
PARTED = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0d]+')"

TRIE = f"""
WITH own AS (
SELECT conv_id, list(struct_pack(k := md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), w := len({PARTED.format('text')})) ORDER BY turn NULLS FIRST) AS ts
FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
kept AS (SELECT *, CAST({crc32('CAST(conv_id AS VARCHAR)')} AS BIGINT) % 4 AS h FROM own),
made AS (SELECT o.conv_id, list_concat(coalesce(b.ts[1:o.h], []), o.ts[o.h + 1:]) AS p FROM kept o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
keyed AS (SELECT conv_id, p, list_transform(p, lambda t: t.k) AS k FROM made),
pre AS (SELECT conv_id, d, md5(array_to_string(k[1:d], ',')) AS id, CASE WHEN d > 0 THEN md5(array_to_string(k[1:d - 1], ',')) END AS parent,
        CASE WHEN d > 0 THEN p[d].w END AS w, d = len(p) AS ends FROM keyed, unnest(range(0, len(p) + 1)) u(d)),
node AS (SELECT id, d, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n, min(w) AS w,
         coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends FROM pre GROUP BY id, d),
kids AS (SELECT parent, count(*) AS n FROM node GROUP BY parent),
below AS (SELECT a.id, sum((x.n - 1) * coalesce(x.w, 0)) AS saved, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves
          FROM node x JOIN pre a ON a.conv_id = x.conv_id AND a.d <= x.d LEFT JOIN kids k ON k.parent = x.id GROUP BY a.id)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(k.n, 0) AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM node v LEFT JOIN node u ON u.id = v.parent LEFT JOIN kids k ON k.parent = v.id JOIN below b ON b.id = v.id"""


def _runs(table: str, key: str) -> str:
    more = " UNION ALL ".join(
        f"SELECT {key}, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS g FROM {table}" for k in (1, 2, 3)
    )
    return more


RESAMPLE = f"""
WITH d AS (SELECT doc_id, {PLAIN} AS w FROM documents), b AS (SELECT item_id, {PLAIN} AS w FROM benchmark),
df AS (SELECT doc_id, g, count(*) AS n FROM ({_runs('d', 'doc_id')}) GROUP BY doc_id, g),
bf AS (SELECT g, count(*) AS n FROM ({_runs('b', 'item_id')}) GROUP BY g),
placed AS (SELECT g, CAST({crc32('g')} AS BIGINT) % 10000 AS bucket FROM (SELECT g FROM df UNION SELECT g FROM bf)),
s AS (SELECT bucket, sum(n) AS n FROM df JOIN placed USING (g) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS n FROM bf JOIN placed USING (g) GROUP BY bucket),
gain AS (SELECT r.bucket, floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM s) + 10000 AS DOUBLE)
         / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM t) + 10000 AS DOUBLE)))) AS gain
         FROM (SELECT bucket FROM s UNION SELECT bucket FROM t) r LEFT JOIN s ON s.bucket = r.bucket LEFT JOIN t ON t.bucket = r.bucket),
weights AS (SELECT doc_id, sum(df.n) AS n, sum(df.n * gain) AS weight FROM df JOIN placed USING (g) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, len(d.w) AS n_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_features, CAST(coalesce(x.weight, 0) AS BIGINT) AS weight,
           CAST(coalesce(x.weight, 0) + floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('42:' || d.doc_id), 1, 8)) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
           FROM d LEFT JOIN weights x ON x.doc_id = d.doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN r.rank <= 5 * r.n // 100 THEN r.rank END AS rank FROM scored s LEFT JOIN ranked r ON r.doc_id = s.doc_id"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {PARTED.format('text')} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) u(i)),
first AS (SELECT h, min(doc_id) AS doc_id FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT x.doc_id, unnest(range(x.i, x.i + 50)) AS i FROM win x JOIN first f ON f.h = x.h AND f.doc_id < x.doc_id),
words AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) u(i)),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM words x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i WHERE g.i IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id"""

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {PLAIN} AS w FROM documents), b AS (SELECT item_id, {PLAIN} AS w FROM benchmark WHERE item_id IS NOT NULL),
item AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS k FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM item),
win AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS k FROM d, sizes, unnest(range(1, len(w) - size + 2)) u(i)),
hit AS (SELECT DISTINCT x.doc_id, x.i, x.size, t.item_id FROM win x JOIN item t ON t.size = x.size AND t.k = x.k),
words AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS word FROM hit) GROUP BY doc_id),
spans AS (SELECT doc_id, string_agg(s, ',' ORDER BY low) AS s FROM (
  SELECT doc_id, min(word) AS low, CAST(min(word) - 1 AS VARCHAR) || ':' || CAST(max(word) AS VARCHAR) AS s FROM (
    SELECT doc_id, word, word - row_number() OVER (PARTITION BY doc_id ORDER BY word) AS run FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS word FROM hit)) GROUP BY doc_id, run) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(i.s, '')) AS items_sha256,
       coalesce(h.n > 0 AND 20 * h.n >= len(d.w), false) AS contaminated, coalesce(s.s, '') AS hit_spans
FROM d LEFT JOIN words h ON h.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id LEFT JOIN spans s ON s.doc_id = d.doc_id"""

PASSAGES = r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \n]+') AS w, regexp_extract_all(text, '[^ \n]+[ \n]*') AS k, regexp_extract(text, '^[ \n]*') AS lead FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) u(i)),
first AS (SELECT h, min(struct_pack(doc_id := doc_id, i := i)) AS f FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT x.doc_id, unnest(range(x.i, x.i + 50)) AS i FROM win x JOIN first f ON f.h = x.h AND (f.f.doc_id <> x.doc_id OR x.i - f.f.i >= 50)),
cuts AS (SELECT doc_id, count(*) AS n, min(i) AS low, sum(CASE WHEN i - before = 1 THEN 0 ELSE 1 END) AS runs
         FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone) GROUP BY doc_id),
words AS (SELECT doc_id, i, k[i] AS piece FROM d, unnest(range(1, len(k) + 1)) u(i) WHERE doc_id IN (SELECT doc_id FROM cuts)),
kept AS (SELECT x.doc_id, string_agg(piece, '' ORDER BY x.i) AS text FROM words x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i WHERE g.i IS NULL GROUP BY x.doc_id),
done AS (SELECT d.doc_id, c.runs, c.n, CASE WHEN c.n IS NULL THEN d.text ELSE (CASE WHEN c.low = 1 THEN '' ELSE d.lead END) || coalesce(k.text, '') END AS text
         FROM d LEFT JOIN cuts c ON c.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id)
SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, CAST(coalesce(runs, 0) AS INTEGER) AS n_runs, CAST(coalesce(n, 0) AS INTEGER) AS n_removed_words, text FROM done"""


def _order_key(text: str) -> str:
    """The first half of a checksum as a signed number."""
    half = f"CAST(CAST(('0x' || substr(md5({text}), 1, 16)) AS UBIGINT) AS HUGEINT)"
    return f"CAST(CASE WHEN {half} >= 9223372036854775808 THEN {half} - 18446744073709551616 ELSE {half} END AS BIGINT)"


SHARDS = f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, CAST({crc32("coalesce(text, '')")} AS BIGINT) AS text_crc32,
           {_order_key("coalesce(text, '')")} AS key, {_order_key("CAST(doc_id AS VARCHAR)")} AS tie FROM documents),
placed AS (SELECT *, coalesce(sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER o AS rank, sum(size) OVER () AS total
           FROM d WINDOW o AS (ORDER BY key, tie, doc_id)),
dealt AS (SELECT *, least(CAST((2 * b + size) * 40 AS BIGINT) // CAST(2 * total AS BIGINT), 39) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(rank - min(rank) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM dealt"""

SQL = {
    "op6_line_dedup": PASSAGES,
    "op8_sharding": SHARDS,
    "op7_benchmark_decontamination": CONTAMINATION,
    "op11_conversation_trie": TRIE,
    "op12_importance_resampling": RESAMPLE,
    "op13_substring_dedup": SUBSTRINGS,
}
