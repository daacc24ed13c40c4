"""DuckDB SQL for the queries of this subpackage that SQL can express, over whole tables."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_BIN = "((v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0))"
_SPREAD = "CASE measure WHEN 'word_len' THEN 60 WHEN 'symbols' THEN 40 WHEN 'dup_lines' THEN 100 ELSE 60 END"


def _fence(keys: str) -> str:
    by = f"{keys}, " if keys else ""
    return f"""SELECT {by}measure, max(total) AS rows_n,
      min(CASE WHEN 4 * cum >= total THEN bin END) - 3 * greatest(min(CASE WHEN 4 * cum >= 3 * total THEN bin END) - min(CASE WHEN 4 * cum >= total THEN bin END), {_SPREAD}) AS lo,
      min(CASE WHEN 4 * cum >= 3 * total THEN bin END) + 3 * greatest(min(CASE WHEN 4 * cum >= 3 * total THEN bin END) - min(CASE WHEN 4 * cum >= total THEN bin END), {_SPREAD}) AS hi
    FROM (SELECT {by}measure, bin, sum(n) OVER (PARTITION BY {by}measure ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY {by}measure) AS total
          FROM (SELECT {by}measure, bin, sum(n) AS n FROM sk GROUP BY {by}measure, bin))
    GROUP BY {by}measure"""


OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
win AS (SELECT rid, i, w[i:i+4] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(0, 5) AS r(k) GROUP BY rid),
b AS (SELECT d.*, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN l USING (rid) LEFT JOIN cov USING (rid)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        coalesce('=' || lang, '-') AS lk, coalesce('=' || source, '-') AS sk_,
        (100 * word_chars) // greatest(n_words, 1) AS m_word_len, (1000 * n_symbols) // greatest(n_words, 1) AS m_symbols,
        (1000 * n_dup_lines) // greatest(n_lines, 1) AS m_dup_lines, (1000 * n_repeat_words) // greatest(n_words, 1) AS m_repeats FROM b),
long AS (SELECT rid, lk, sk_, base_failed, 'word_len' AS measure, m_word_len AS v FROM m UNION ALL SELECT rid, lk, sk_, base_failed, 'symbols', m_symbols FROM m
         UNION ALL SELECT rid, lk, sk_, base_failed, 'dup_lines', m_dup_lines FROM m UNION ALL SELECT rid, lk, sk_, base_failed, 'repeats', m_repeats FROM m),
sk AS (SELECT lk, sk_, measure, {_BIN} AS bin, count(*) AS n FROM long WHERE NOT base_failed GROUP BY ALL),
f2 AS ({_fence('lk, sk_')}), f1 AS ({_fence('lk')}), f0 AS ({_fence('')}),
out AS (SELECT rid, bool_or((measure = 'word_len' AND v < CASE WHEN f2.rows_n >= 200 THEN f2.lo WHEN f1.rows_n >= 200 THEN f1.lo ELSE f0.lo END)
                      OR v > CASE WHEN f2.rows_n >= 200 THEN f2.hi WHEN f1.rows_n >= 200 THEN f1.hi ELSE f0.hi END) AS outside
        FROM long JOIN f2 USING (lk, sk_, measure) JOIN f1 USING (lk, measure) JOIN f0 USING (measure) GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(outside, false) AS kept, m_word_len, m_symbols, m_dup_lines, m_repeats
FROM m LEFT JOIN out USING (rid)
"""

# CRC-32 of bytes, by a table of 256 entries that the polynomial gives.
_POLY = "poly AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab)"


def _bytes(of: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({of})), '..'), lambda h: ('0x' || h)::BIGINT)"


def _crc(listed: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {listed}), lambda s, x: xor(s >> 8, tab[(xor(s, x) & 255) + 1])))"


OP2 = rf"""
WITH {_POLY},
d AS (SELECT doc_id, source, (octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS size, {_bytes("coalesce(text, '')")} AS b FROM documents),
c AS (SELECT doc_id, source, size, {_crc("b")} AS text_crc32 FROM d, poly),
h AS (SELECT *, ('0x' || substr(md5('29:' || coalesce(doc_id::VARCHAR, '') || ':' || text_crc32), 1, 15))::BIGINT AS h FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) - 1 AS rk, count(*) OVER (PARTITION BY source) AS n FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * rk + 1)::DOUBLE / (2 * n), source NULLS LAST, rk) - 1 AS pos, count(*) OVER () AS total FROM r),
s AS (SELECT *, (pos * 40) // total AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, pos - (shard * total + 39) // 40 AS slot, NULL::INT AS grown_shard, source FROM s
"""

OP7 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(text, '')) AS seal FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS total FROM s),
o AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
        (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open FROM w),
c AS (SELECT *, rest * weight >= cap::DOUBLE * open AS clamped FROM o),
t AS (SELECT c.source, source_size, CASE WHEN clamped THEN cap::DOUBLE ELSE (SELECT arg_max(rest, open) FROM c WHERE NOT clamped) * weight / (SELECT max(open) FROM c WHERE NOT clamped) END AS target FROM c),
x AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.source, d.size, seal, source_size, target, whole, CASE WHEN source_size > 0 THEN target - whole * source_size ELSE 0 END AS extra,
        ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, '') || ':' || seal), 1, 15))::BIGINT AS h
      FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source),
a AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT <= extra AS early FROM r),
g AS (SELECT *, extra - (sum(CASE WHEN early THEN size ELSE 0 END) OVER (PARTITION BY source))::BIGINT AS gap FROM a),
f AS (SELECT *, coalesce((sum(size) OVER (PARTITION BY source, early, size > 0 ORDER BY size, h, doc_id, seal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS run FROM g)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies
FROM (SELECT *, (whole + CASE WHEN extra > 0 AND (early OR (size > 0 AND run + size / 2 < gap)) THEN 1 ELSE 0 END)::BIGINT AS copies FROM f)
"""

OP9 = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(regexp_extract(rest, '(?s)^[^/?#]*'), '') AS raw, coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
u AS (SELECT row_number() OVER () AS rid, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
r(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT rid, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
      FROM u, r WHERE (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM u LEFT JOIN f USING (rid)
"""

OP10 = r"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256 FROM d
"""

OP12 = rf"""
WITH {_POLY},
s AS (SELECT sale_id, CASE WHEN sold_at IS NOT NULL THEN floor(epoch(sold_at) / 86400)::BIGINT END AS slot, floor(floor(100 * total + 0.5) / 1000)::BIGINT AS level,
             1 + {_crc(_bytes("coalesce(sale_id::VARCHAR, '')"))} % 3 AS w FROM sales, poly),
c AS (SELECT slot, level, count(*) AS n, sum(w) AS w FROM s WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY slot, level),
a AS (SELECT x.slot, x.level, sum(y.n) AS n, sum(y.w) AS w FROM c x JOIN c y ON y.slot < x.slot AND y.level > x.level GROUP BY x.slot, x.level)
SELECT sale_id, s.slot, s.level, CASE WHEN s.slot + s.level IS NOT NULL THEN coalesce(a.n, 0)::BIGINT END AS n_sales, CASE WHEN s.slot + s.level IS NOT NULL THEN coalesce(a.w, 0)::BIGINT END AS n_rows
FROM s LEFT JOIN a ON s.slot = a.slot AND s.level = a.level
"""

_TOKENS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13 = rf"""
WITH {_POLY},
d AS (SELECT row_number() OVER () AS rid, doc_id, {_TOKENS} AS w FROM documents),
dw AS (SELECT rid, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_TOKENS}) AS word FROM benchmark),
v AS (SELECT word, {_crc(_bytes("word"))} % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), poly),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN v USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN v USING (word) GROUP BY bucket),
g AS (SELECT b AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS gain
      FROM range(10000) AS r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
m AS (SELECT rid, count(*) AS n, sum(gain)::BIGINT AS g FROM dw JOIN v USING (word) JOIN g USING (bucket) GROUP BY rid),
x AS (SELECT rid, doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END::BIGINT AS weight,
             ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (rid)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, n_words >= 20 AS fit FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER (PARTITION BY fit) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND r <= 10 * n // 100 THEN r END AS rank FROM z
"""

ORACLES = {"op1_quality_rules": OP1, "op2_sharding": OP2, "op7_mixing": OP7, "op9_url_filter": OP9, "op10_exact_dedup": OP10,
           "op12_dominance": OP12, "op13_resampling": OP13}
