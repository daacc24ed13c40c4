"""DuckDB SQL that each query of this package must equal, over the same whole tables."""

from __future__ import annotations

import html
from html.entities import html5

from ..functions import terms as T
from ..functions import text as X
from . import queries as Q

_Q = Q.QUESTION.replace("'", "''")
_TERMS = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(Q.TERMS)) + ") AS asked(pos, term)"
_LIST = "[" + ", ".join(f"'{t}'" for t in Q.TERMS) + "]"
_LOW = "[" + ", ".join(f"'{t}'" for t in T.LOW_SIGNAL) + "]"
_TOK = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9_+#-]+'), lambda t: lower(t))"
_WS = "regexp_replace({0}, '\\s+', ' ', 'g')"


def _trim(x: str) -> str:
    return f"trim({_WS.format(x)})"


SOURCES = """sources AS (SELECT doc_id AS id, 'https://' || source || '.example/' || doc_id AS url, 'blog' AS kind, 'Document ' || doc_id AS title, source, lang, text AS raw_text,
  CASE WHEN lang = 'es' THEN 'test1' ELSE 'public' END AS owner,
  CASE WHEN min(doc_id) OVER (PARTITION BY md5(text)) < doc_id THEN min(doc_id) OVER (PARTITION BY md5(text)) END AS duplicate_of FROM documents)"""
CHUNKS = SOURCES + """, chunks AS (SELECT id AS chunk_id, source AS source_id, title, url, raw_text AS content, owner, duplicate_of, embedding FROM sources LEFT JOIN embeddings ON vec_id = id)"""
SEEN = CHUNKS + ", seen AS (SELECT * FROM chunks WHERE owner IN ('public', 'test1') AND duplicate_of IS NULL)"
POSTS = SEEN + f", posts AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({_TOK.format('content')}) AS term FROM seen) GROUP BY ALL)"
KEPT = POSTS + f""", terms AS (SELECT pos, asked.term, coalesce(df, 0) AS df, (SELECT greatest(count(*), 1) FROM seen) AS total
  FROM {_TERMS} LEFT JOIN (SELECT term, count(*) AS df FROM posts GROUP BY term) f ON f.term = asked.term),
 analysed AS (SELECT *, df > 0 AND df / total <= 0.10 AS kept FROM terms)"""
LEX = KEPT + """, lex AS (SELECT chunk_id, source_id, count(*) AS matched_terms, 0.1::DOUBLE * sum(tf) * count(*) AS score FROM posts JOIN seen USING (chunk_id) WHERE term IN (SELECT term FROM analysed WHERE kept) GROUP BY ALL)"""
_CAP = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY {0} DESC, chunk_id) AS rn FROM {1}) WHERE rn <= {2}"
LEXPOOL = LEX + f", lexpool AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS lexical_rank FROM ({_CAP.format('score', 'lex', 4)}) QUALIFY lexical_rank <= 32)"
_SIM = "round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9)"
_SEM = f", sem AS (SELECT chunk_id, source_id, {_SIM} AS similarity FROM seen WHERE embedding IS NOT NULL)"
_VECPOOL = f""", win AS (SELECT * FROM sem ORDER BY similarity DESC, chunk_id LIMIT 256),
 vecpool AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, chunk_id) AS vector_rank FROM ({_CAP.format('similarity', 'win', 4)}) QUALIFY vector_rank <= 32)"""
FUSED = LEXPOOL + _SEM + _VECPOOL + """, fused AS (SELECT coalesce(l.chunk_id, v.chunk_id) AS chunk_id, coalesce(l.source_id, v.source_id) AS source_id, coalesce(matched_terms, 0) AS matched_terms, similarity,
  lexical_rank, vector_rank, round(coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0), 12) AS rrf,
  CASE WHEN lexical_rank IS NOT NULL AND vector_rank IS NOT NULL THEN 'both' WHEN lexical_rank IS NOT NULL THEN 'words' ELSE 'meaning' END AS found_by
  FROM lexpool l FULL JOIN vecpool v ON l.chunk_id = v.chunk_id)"""
HITS = FUSED + f", hits AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, chunk_id) AS marker FROM ({_CAP.format('rrf', 'fused', 2)}) QUALIFY marker <= 8)"

_NORM = "trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_H = "('0x' || substr(md5({0}), 1, 15))::BIGINT"
SKETCH = f"""norm AS (SELECT doc_id AS id, {_NORM} AS t FROM documents), w AS (SELECT id, t, string_split(t, ' ') AS w FROM norm),
 sh AS (SELECT id, CASE WHEN len(w) < 8 THEN [{_H.format('t')}] ELSE list_distinct(list_transform(range(1, len(w) - 6), lambda i: {_H.format("array_to_string(w[i:i+7], ' ')")})) END AS h FROM w),
 sk AS (SELECT id, list_sort(h)[1:128] AS sketch, len(h) AS n FROM sh)"""
PAIRS = SKETCH + """, own AS (SELECT doc_id, CASE WHEN lang = 'es' THEN 'test1' ELSE 'public' END AS owner FROM documents), one AS (SELECT id, owner, unnest(sketch) AS h FROM sk JOIN own ON doc_id = id),
 met AS (SELECT DISTINCT x.id AS a, y.id AS b FROM one x JOIN one y ON x.h = y.h AND x.id < y.id AND (x.owner = 'public' OR x.owner = y.owner)),
 j AS (SELECT a, b, s.n AS na, t.n AS nb, list_sort(list_distinct(list_concat(s.sketch, t.sketch)))[1:128] AS u, list_intersect(s.sketch, t.sketch) AS c FROM met JOIN sk s ON s.id = a JOIN sk t ON t.id = b),
 q AS (SELECT a, b, na, nb, len(list_intersect(u, c)) / len(u) AS jaccard FROM j),
 pairs AS (SELECT a, b, jaccard, CASE WHEN jaccard = 0 THEN 0 ELSE greatest(least(1.0::DOUBLE, jaccard * (na + nb) / (1 + jaccard) / na), least(1.0::DOUBLE, jaccard * (na + nb) / (1 + jaccard) / nb)) END AS score FROM q)"""

_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
_BARE = f"regexp_replace({_PATH}, '/+$', '')"
_PARAMS = f"array_to_string(list_sort(list_transform(list_filter(string_split({_QUERY}, '&'), lambda p: lower(string_split(p, '=')[1]) IN ('v', 't', 'id', 'p', 'page', 'q')), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)), '&')"
CANON = f"'https://' || {_HOST} || CASE WHEN {_BARE} = '' THEN '/' ELSE {_BARE} END || CASE WHEN {_PARAMS} = '' THEN '' ELSE '?' || {_PARAMS} END"
_KIND = f"CASE WHEN {_HOST} LIKE '%youtube.com%' OR {_HOST} LIKE '%youtu.be%' THEN 'talk' WHEN {_HOST} LIKE '%github.com%' OR {_HOST} LIKE '%gitlab.com%' OR {_HOST} LIKE '%sourceforge.net%' THEN 'repo' ELSE 'blog' END"


def _stripped(col: str = "html") -> str:
    x = col
    for tag in ("script", "style", "noscript", "svg", "form", "select"):
        x = f"regexp_replace({x}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    for tag in ("nav", "footer", "aside"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?is)<br\\s*/?>|</p>|</div>|</li>|</h[1-6]>', chr(10), 'g')"
    return f"regexp_replace({x}, '(?s)<[^>]+>', ' ', 'g')"


def _lines(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '\\r\\n|\\r|\\n'), lambda l: {_trim('l')}), lambda l: l <> ''), chr(10))"


#: Every character reference of the standard: a number, or the longest name of its list that the reference begins with.
_REF = "'&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)'"
_SPECIAL = [(n, t) for n in (*range(0xA0), *range(0xFDD0, 0xFDF0), *((p << 16) | low for p in range(17) for low in (0xFFFE, 0xFFFF))) if (t := html.unescape(f"&#{n};")) != chr(n)]
_TEXTS = f"""names(name, chars) AS (VALUES {", ".join(f"('{n}', {'||'.join(f'chr({ord(c)})' for c in t)})" for n, t in html5.items())}),
 special(code, chars) AS (VALUES {", ".join(f"({n}, {'||'.join(f'chr({ord(c)})' for c in t) or chr(39) * 2})" for n, t in _SPECIAL)}),
 bare AS (SELECT page_id, url, {_stripped()} AS b FROM pages),
 refs AS (SELECT DISTINCT unnest(regexp_extract_all(b, {_REF})) AS ref FROM bare),
 coded AS (SELECT ref, CASE WHEN ref ~ '&#[xX].*' THEN CASE WHEN length(h) > 12 THEN NULL ELSE ('0x0' || h)::BIGINT END ELSE try_cast(regexp_extract(ref, '[0-9]+') AS BIGINT) END AS code
  FROM (SELECT ref, ltrim(regexp_extract(ref, '^&#[xX]([0-9a-fA-F]+)', 1), '0') AS h FROM refs WHERE ref LIKE '&#%')),
 known AS (SELECT ref, max_by(chars || substr(ref, 2 + length(name)), length(name)) AS chars FROM refs JOIN names ON starts_with(substr(ref, 2), name) GROUP BY ref
  UNION ALL SELECT ref, CASE WHEN special.code IS NOT NULL THEN chars WHEN c.code IS NULL OR c.code > 1114111 OR c.code BETWEEN 55296 AND 57343 THEN chr(65533) ELSE chr(c.code::INT) END FROM coded c LEFT JOIN special ON special.code = c.code),
 texts AS (SELECT page_id, url, CASE WHEN b IS NOT NULL THEN {_lines(f"""translate(array_to_string(list_transform(list_zip(regexp_split_to_array(b, {_REF}), regexp_extract_all(b, {_REF})),
  lambda z: z[1] || coalesce(m[z[2]], z[2], '')), ''), chr(160), ' ')""")} END AS t FROM bare, (SELECT map(list(ref), list(chars)) AS m FROM known))"""


def _clean(x: str) -> str:
    return _trim(f"regexp_replace({x}, '\\[[^\\]]{{1,20}}\\]', ' ', 'g')")


_SENT = "string_split(regexp_replace(l, '([.!?])\\s+([A-Z(\"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
_CUES = f"flatten(list_transform(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda l: {_clean('l')}), lambda l: l <> ''), lambda l: CASE WHEN length(l) <= 400 THEN [l] ELSE {_SENT} END))"
_CUETABLE = """cues AS (SELECT conv_id AS source_id, turn AS pos, turn * 4.0::DOUBLE + CASE WHEN role = 'system' THEN 20.0::DOUBLE ELSE 0 END AS start, 6.4::DOUBLE AS duration FROM conversations),
 cl AS (SELECT *, greatest(least(start + duration, coalesce(lead(start) OVER w, 'inf'::DOUBLE)), start) AS e FROM cues WINDOW w AS (PARTITION BY source_id ORDER BY pos)),
 gaps AS (SELECT *, start - lag(e) OVER (PARTITION BY source_id ORDER BY pos) AS gap FROM cl)"""
_TALK = _CUETABLE.replace("SELECT conv_id AS source_id, turn AS pos, ", "SELECT conv_id AS source_id, turn AS pos, text, ") + ", every_cue AS (SELECT * FROM gaps)"
_PROSE = f"prose AS (SELECT doc_id AS source_id, {_CUES} AS pieces FROM documents), every_cue AS (SELECT source_id, unnest(pieces) AS text, unnest(range(len(pieces))) AS pos, 0.0::DOUBLE AS start, 0.0::DOUBLE AS e, 0.0::DOUBLE AS gap FROM prose)"
_VERSIONS = """c AS (SELECT conv_id AS source_id, turn AS chunk_index, role, text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
 o AS (SELECT source_id, chunk_index, sha256(text) AS h FROM c),
 n AS (SELECT source_id, chunk_index, sha256(CASE WHEN role = 'assistant' THEN text || ' (revised)' ELSE text END) AS h FROM c WHERE chunk_index < last OR last = 0
   UNION ALL SELECT DISTINCT source_id, last + 1, sha256('more of ' || source_id) FROM c WHERE source_id % 3 = 0 AND last > 0),
 m AS (SELECT source_id, chunk_index, CASE WHEN o.h IS NULL THEN 'insert' WHEN n.h IS NULL THEN 'delete' WHEN o.h = n.h THEN 'keep' ELSE 'update' END AS action,
   CASE WHEN o.h IS NOT NULL AND (n.h IS NULL OR o.h = n.h) THEN 'm' END AS embedding_model, CASE WHEN n.h IS NULL THEN o.h ELSE n.h END AS content_hash FROM o FULL JOIN n USING (source_id, chunk_index))"""


def _passages(cues: str, target: int, overlap: int, across: bool, timed: bool) -> str:
    """Greedy passages as a recursion over each source's lists of running sums, silences and ends of sentences."""
    reached = "(r.upto[e + 1] - r.upto[{0} + 1] >= {1} OR (r.upto[e + 1] - r.upto[{0} + 1] >= {2} AND r.sentence[e]))"

    def end(first: str) -> str:
        full = reached.format(first, int(target * 1.25), target)
        return f"list_min(list_filter(range({first} + 1, r.n + 1), lambda e: e = r.n OR r.silent[e + 1] OR {full}))"

    full = reached.format("r.first", int(target * 1.25), target).replace("[e + 1]", "[r.last + 1]").replace("[e]", "[r.last]")
    back = f"greatest(r.first + 1, coalesce(list_max(list_filter(range(r.first + 1, r.last + 1), lambda b: r.upto[r.last + 1] - r.upto[b + 1] >= {overlap})), 0))"
    after = back if across else f"CASE WHEN r.silent[r.last + 1] AND NOT {full} THEN r.last ELSE {back} END"
    times = ("round(starts[first + 1], 3)::DECIMAL(10, 3)", "round(ends[last], 3)::DECIMAL(10, 3)") if timed else ("NULL::DECIMAL(10, 3)",) * 2
    return f"""WITH RECURSIVE {cues},
 counted AS (SELECT *, CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+')) END AS k FROM every_cue),
 s AS (SELECT source_id, count(*) AS n, list_prepend(0::BIGINT, list(total ORDER BY pos)) AS upto, list(text ORDER BY pos) AS texts, list(start ORDER BY pos) AS starts, list(e ORDER BY pos) AS ends,
   list(coalesce(gap > 8.0, false) ORDER BY pos) AS silent, list(regexp_matches(text, '[.!?]["'')\\]]*$') ORDER BY pos) AS sentence
   FROM (SELECT *, (sum(k) OVER (PARTITION BY source_id ORDER BY pos))::BIGINT AS total FROM counted) GROUP BY source_id),
 walk AS (SELECT r.*, 0 AS i, 0::BIGINT AS first, {end("0")} AS last FROM s r
   UNION ALL SELECT * EXCLUDE (first, last), first, {end("r.first")} AS last FROM (SELECT * EXCLUDE (i, first, last, after), i + 1 AS i, after AS first, last FROM (SELECT r.*, {after} AS after FROM walk r WHERE r.last < r.n)) r)
SELECT source_id, i::INT AS chunk_index, array_to_string(texts[first + 1:last], ' ') AS content, sha256(array_to_string(texts[first + 1:last], ' ')) AS content_hash,
  (upto[last + 1] - upto[first + 1])::INT AS token_count, {times[0]} AS start_ts, {times[1]} AS end_ts, (last - first)::INT AS cues, 'words' AS tokenizer FROM walk"""


_NOW = "(SELECT max(ts) FROM events)"
_PRICES = "(VALUES ('click', 5.0::DOUBLE, 25.0::DOUBLE), ('view', 3.0, 15.0), ('error', 1.0, 5.0)) AS p(model, pi, po)"
_COST = "(user_id * pi + user_id * 2 * po) / 1000000"
_FAKE = f"CASE WHEN page_id < 100 THEN 'https://www.github.com' || {_PATH} ELSE 'https://github.com/owner/repo/blob/main' || {_PATH} END"
_SEG = "list_filter(string_split(regexp_extract(f, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')"
_MARKED = "CASE WHEN contains(url, '/fr/') THEN 'Just a moment... ' || html WHEN contains(url, '/de/') THEN 'VERIFY you are human. ' || html ELSE html END"


def _marker(x: str, markers, window: int) -> str:
    return "CASE " + " ".join("WHEN contains(lower(substr({0}, 1, {1})), '{2}') THEN '{2}'".format(x, window, m.replace("'", "''")) for m in markers) + " END"


_STAMP = "CASE WHEN {0} IS NULL THEN '-' ELSE (floor({0})::BIGINT // 60)::VARCHAR || ':' || lpad((floor({0})::BIGINT % 60)::VARCHAR, 2, '0') END"
_LINK = "CASE WHEN contains(url, '/en/') THEN 'https://youtube.com/watch?v=' || page_id WHEN contains(url, '/fr/') THEN 'https://youtu.be/x' ELSE url END"
_KEY = "regexp_replace(lower(trim({0})), '\\s+', ' ', 'g')"
_OUT = f"CASE WHEN {_HOST} IN ('spam-farm.example.org', 'casino-win.example.com') THEN 'denied' WHEN ({_marker('t', X.CHALLENGE_MARKERS, 600)}) IS NOT NULL THEN 'skipped' WHEN t = '' THEN 'no content' ELSE 'ingested' END"

ORACLES = {
    "tenancy_filter": f"WITH {SOURCES} SELECT owner, lang, count(*) AS n FROM sources WHERE owner = 'public' GROUP BY ALL",
    "visible_total": f"WITH {SEEN} SELECT greatest(count(*), 1) AS total FROM seen",
    "query_terms": f"""WITH t AS (SELECT item_id, list_filter({_TOK.format('text')}, lambda t: length(t) >= 3 AND NOT list_contains({_LOW}, t)) AS l FROM benchmark),
      f AS (SELECT item_id, term, min(i) AS i FROM (SELECT item_id, unnest(l) AS term, unnest(range(len(l))) AS i FROM t) GROUP BY ALL)
      SELECT t.item_id, coalesce(string_agg(term, ' ' ORDER BY i), '') AS terms FROM t LEFT JOIN f USING (item_id) GROUP BY t.item_id""",
    "df_all_terms": f"WITH {POSTS} SELECT term, count(*) AS df FROM posts GROUP BY term",
    "df_terms": f"WITH {POSTS} SELECT term, count(*) AS df FROM posts GROUP BY term ORDER BY df DESC, term LIMIT 50",
    "analyse_terms": f"WITH {KEPT} SELECT pos, term, df, total, kept FROM analysed",
    "fulltext_or_match": f"WITH {SEEN} SELECT chunk_id, source_id FROM seen WHERE list_has_any({_TOK.format('content')}, {_LIST})",
    "lexical_topk": f"WITH {LEX} SELECT chunk_id, source_id, matched_terms, round(score, 6) AS score FROM lex ORDER BY lex.score DESC, chunk_id LIMIT 24",
    "lexical_capped": f"WITH {LEXPOOL} SELECT chunk_id, source_id, lexical_rank FROM lexpool",
    "semantic_topk": f"WITH {SEEN}{_SEM} SELECT chunk_id, source_id, round(similarity, 6) AS similarity FROM sem ORDER BY sem.similarity DESC, chunk_id LIMIT 24",
    "semantic_pruned": f"WITH {SEEN}{_SEM} SELECT chunk_id, source_id, round(similarity, 6) AS similarity FROM sem ORDER BY sem.similarity DESC, chunk_id LIMIT 24",
    "semantic_capped": f"WITH {SEEN}{_SEM}{_VECPOOL} SELECT chunk_id, source_id, vector_rank FROM vecpool",
    "semantic_all": "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings",
    "rrf_fused": f"WITH {FUSED} SELECT chunk_id, source_id, matched_terms, lexical_rank, vector_rank, round(rrf, 9) AS rrf FROM fused",
    "hybrid_search": f"WITH {HITS} SELECT marker, chunk_id, hits.source_id, matched_terms, round(similarity, 6) AS similarity, round(rrf, 9) AS rrf, found_by, title FROM hits JOIN seen USING (chunk_id)",
    "found_by": f"WITH {FUSED} SELECT found_by, count(*) AS n FROM fused GROUP BY found_by",
    "abstain_decision": f"""WITH {HITS}, f AS (SELECT count(*) AS hits, coalesce(max(matched_terms), 0) AS best_matched, max(similarity) AS s FROM hits)
      SELECT hits, best_matched, round(s, 6) AS best_similarity, hits < 1 OR NOT (best_matched >= 2 OR coalesce(s >= 0.45, false)) AS abstained FROM f""",
    "prompt_build": f"WITH {HITS} SELECT 'Question: {_Q}' || chr(10) || chr(10) || 'Excerpts:' || chr(10) || chr(10) || string_agg('[' || marker || '] ' || title || ' (at -)' || chr(10) || content, chr(10) || chr(10) ORDER BY marker) AS prompt FROM hits JOIN seen USING (chunk_id)",
    "citation_markers": "SELECT item_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text || ' [' || length(text) % 100 || '] [3] [3]', '\\[(\\d{1,2})\\]', 1), lambda m: m::INT))), ',') AS cited FROM benchmark",
    "norm_text_hash": f"SELECT doc_id, md5({_NORM}) AS hash FROM documents",
    "shingle_sketch": f"WITH {SKETCH} SELECT id, n, len(sketch) AS k, md5(array_to_string(sketch, ',')) AS sketch_md5 FROM sk",
    "near_dup_pairs": f"WITH {PAIRS} SELECT a, b, round(jaccard, 6) AS jaccard, round(score, 6) AS score FROM pairs WHERE pairs.score >= 0.60",
    "best_duplicate": f"WITH {PAIRS} SELECT b AS id, a AS duplicate_of, round(score, 6) AS score FROM pairs WHERE pairs.score >= 0.60 QUALIFY row_number() OVER (PARTITION BY b ORDER BY pairs.score DESC, a) = 1",
    "content_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "clean_text": f"SELECT doc_id, md5({_clean('text')}) AS clean_md5 FROM documents",
    "token_counts": "SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text), '\\s+')) END AS tokens FROM documents",
    "pseudo_cues": f"SELECT doc_id, len({_CUES}) AS n, md5(array_to_string({_CUES}, chr(10))) AS cues_md5 FROM documents",
    "html_to_text": f"WITH {_TEXTS} SELECT page_id, md5(t) AS text_md5 FROM texts",
    "canonical_url": f"""SELECT page_id, {CANON} AS url, CASE WHEN contains(url, '/en/') THEN 'https://youtube.com/watch?v=' || lpad(page_id::VARCHAR, 11, 'a') || '&t=1m'
      WHEN contains(url, '/fr/') THEN 'https://youtube.com/watch?v=' || lpad(page_id::VARCHAR, 11, 'a') WHEN contains(url, '/de/') THEN 'https://youtube.com/channel/abc' ELSE {CANON} END AS video_url FROM pages""",
    "index_pages": f"""SELECT page_id, CASE WHEN contains(url, '/en/') OR contains(url, '/fr/') THEN lpad(page_id::VARCHAR, 11, 'a') END AS video, contains(url, '/de/') AND NOT contains(url, '/en/') AND NOT contains(url, '/fr/') AS index_page,
      CASE WHEN contains(url, '/en/') OR contains(url, '/fr/') OR contains(url, '/de/') THEN 'talk' ELSE {_KIND} END AS kind FROM pages""",
    "url_parts": f"SELECT page_id, {_HOST} AS host, {_KIND} AS kind, CASE {_KIND} WHEN 'talk' THEN 'gdc-youtube-free' WHEN 'repo' THEN 'public-source' ELSE 'public-web' END AS license, {_KIND} = 'talk' AS index_page, substr(sha256(url), 1, 16) AS cache_key FROM pages",
    "domain_filter": f"""SELECT page_id, CASE WHEN contains(url, '/fr/') THEN 'https://notgdcvault.com' || {_PATH} ELSE url END AS url FROM pages
      WHERE NOT contains(url, '/de/') AND {_HOST} NOT IN ('gdcvault.com', 'vault.gdconf.com')""",
    "github_raw_urls": f"""WITH f AS (SELECT page_id, {_FAKE} AS f FROM pages), s AS (SELECT page_id, {_SEG} AS s FROM f)
      SELECT page_id, CASE WHEN len(s) > 4 AND s[3] = 'blob' THEN 'https://raw.githubusercontent.com/' || s[1] || '/' || s[2] || '/' || s[4] || '/' || array_to_string(s[5:], '/')
        WHEN len(s) = 2 THEN array_to_string(flatten(list_transform(['HEAD', 'main', 'master'], lambda b: list_transform(['README.md', 'readme.md', 'README.rst', 'README'], lambda n: 'https://raw.githubusercontent.com/' || s[1] || '/' || s[2] || '/' || b || '/' || n))), ' ')
        ELSE '' END AS raw_urls FROM s""",
    "challenge_filter": f"""SELECT page_id, {_marker('t', X.CHALLENGE_MARKERS, 600)} AS marker, CASE WHEN ({_marker('t', X.WALL_MARKERS, 20000)}) IS NOT NULL THEN 'wall' WHEN length(t) < 6000 THEN 'thin' ELSE 'ok' END AS status
      FROM (SELECT page_id, {_MARKED} AS t FROM pages)""",
    "cue_clamp": f"WITH {_CUETABLE} SELECT source_id, pos, round(e, 3) AS \"end\", round(gap, 3) AS gap FROM gaps",
    "cue_gaps": f"WITH {_CUETABLE} SELECT source_id, count(*) FILTER (gap > 8.0) AS breaks, count(*) AS cues FROM gaps GROUP BY source_id",
    "merge_actions": f"WITH {_VERSIONS} SELECT action, count(*) AS n, count(embedding_model) AS embedded FROM m GROUP BY action",
    "stale_tail": f"WITH {_VERSIONS} SELECT source_id, chunk_index FROM m WHERE action = 'delete'",
    "merged_table": f"WITH {_VERSIONS} SELECT source_id, chunk_index, content_hash, embedding_model FROM m WHERE action <> 'delete'",
    "upsert_sources": f"""WITH {SOURCES} SELECT CASE WHEN lang = 'fr' THEN -id ELSE id END AS id, owner, url, CASE WHEN owner = 'public' THEN 'docs' ELSE kind END AS kind, CASE WHEN owner = 'public' THEN upper(title) ELSE title END AS title,
      CASE WHEN lang <> 'fr' THEN duplicate_of END AS duplicate_of, CASE WHEN lang = 'fr' THEN 'insert' WHEN owner = 'public' THEN 'update' ELSE 'keep' END AS action FROM sources""",
    "embedding_writeback": f"WITH {CHUNKS} SELECT CASE WHEN embedding IS NULL THEN 'new' ELSE 'stored' END AS embedding_model, count(*) AS n, sum(coalesce(len(embedding), 1))::BIGINT AS dims FROM chunks GROUP BY ALL",
    "duplicate_titles": f"WITH {SOURCES} SELECT s.id, s.duplicate_of, o.title AS original FROM sources s JOIN sources o ON o.id = s.duplicate_of",
    "cascade_delete": f"WITH {SOURCES}, l AS (SELECT * FROM sources WHERE lang <> 'fr') SELECT count(*) AS sources, count(*) FILTER (duplicate_of IN (SELECT id FROM l)) AS flagged, count(*) AS chunks FROM l",
    "corpus_stats": f"WITH {CHUNKS} SELECT (SELECT count(*) FROM sources) AS sources, count(*) AS chunks, count(*) FILTER (embedding IS NULL) AS pending, sum(CASE WHEN trim(content) = '' THEN 0 ELSE len(regexp_split_to_array(trim(content), '\\s+')) END)::BIGINT AS tokens FROM chunks",
    "pending_embeddings": f"WITH {CHUNKS} SELECT count(*) FILTER (embedding IS NULL) AS pending FROM chunks",
    "spend_today": f"SELECT round(coalesce(sum({_COST}), 0), 6) AS spend_usd FROM events LEFT JOIN {_PRICES} ON model = event_type WHERE ts >= date_trunc('day', {_NOW})",
    "cost_join": f"SELECT event_type AS model, round(sum({_COST}), 6) AS cost_usd, count(*) AS calls FROM events LEFT JOIN {_PRICES} ON model = event_type GROUP BY event_type",
    "latency_percentiles": f"SELECT round(coalesce(quantile_cont(value, 0.5), 0), 6) AS p50_ms, round(coalesce(quantile_cont(value, 0.95), 0), 6) AS p95_ms FROM events WHERE ts >= {_NOW} - INTERVAL 24 HOURS",
    "latency_of_operation": f"SELECT round(coalesce(quantile_cont(value, 0.5), 0), 6) AS p50_ms, round(coalesce(quantile_cont(value, 0.95), 0), 6) AS p95_ms FROM events WHERE ts >= {_NOW} - INTERVAL 24 HOURS AND event_type = 'view'",
    "latency_by_operation": "SELECT event_type AS operation, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms FROM events GROUP BY event_type",
    "dq_violations": f"""WITH {_CUETABLE} SELECT 'chunk_index' AS rule, source_id || ':' || pos AS row_key FROM gaps WHERE pos < 0 UNION ALL SELECT 'span_order', source_id || ':' || pos FROM gaps WHERE e > start
      UNION ALL SELECT 'unique_chunk', source_id || ':' || pos FROM gaps GROUP BY source_id, pos HAVING count(*) > 1""",
    "source_violations": f"WITH {SOURCES} SELECT 'kind' AS rule, id::VARCHAR AS row_key FROM sources WHERE lang = 'de' UNION ALL SELECT 'self_duplicate', id::VARCHAR FROM sources WHERE duplicate_of = id UNION ALL SELECT 'unique_owner_url', owner || ' ' || url FROM sources GROUP BY owner, url HAVING count(*) > 1",
    "deep_link": f"SELECT page_id, CASE WHEN contains(u, 'youtube.com') OR contains(u, 'youtu.be') THEN u || CASE WHEN contains(u, '?') THEN '&' ELSE '?' END || 't=' || floor(page_id * 1.75)::BIGINT || 's' ELSE u END AS link FROM (SELECT page_id, {_LINK} AS u FROM pages)",
    "timestamp_fmt": f"WITH {_CUETABLE} SELECT source_id, pos, {_STAMP.format('s')} AS label FROM (SELECT source_id, pos, CASE WHEN start > 0 THEN start * 13.7::DOUBLE END AS s FROM cues)",
    "provenance": "SELECT CASE role WHEN 'user' THEN 'human-verified' WHEN 'assistant' THEN 'auto-caption' ELSE '' END AS provenance, count(*) AS n FROM conversations GROUP BY 1",
    "sample_lookup": f"""WITH r AS (SELECT item_id AS recorded_item, {_KEY.format('text')} AS key FROM benchmark), a AS (SELECT item_id, {_KEY.format("'  ' || replace(text, ' ', '  ')")} AS key, length(text) > 200 AS private FROM benchmark)
      SELECT item_id, min(recorded_item) AS recorded_item FROM a LEFT JOIN r ON a.key = r.key AND NOT private GROUP BY item_id""",
    "manifest_dedupe": f"SELECT c AS url, url AS title, 'a' AS manifest FROM (SELECT page_id, url, {CANON} AS c FROM pages) QUALIFY row_number() OVER (PARTITION BY c ORDER BY page_id) = 1",
    "ingest_report": f"WITH {_TEXTS} SELECT {_OUT} AS outcome, count(*) AS n FROM texts GROUP BY 1",
    "kinds_count": f"SELECT {_KIND} AS kind, {_HOST} AS host, count(*) AS n FROM pages GROUP BY ALL",
    "sources_per_owner": f"WITH {SEEN}{_SEM} SELECT source_id, chunk_id, round(similarity, 6) AS similarity FROM ({_CAP.format('similarity', 'sem', 1)})",
}
# Markdown made of a page's url comes back as the canonical urls of the link and of the reference.
_MORE = "url || '/more'"
ORACLES["markdown_links"] = f"""WITH p AS (SELECT page_id, 0 AS pass, url, 'Page ' || page_id AS title, 'first' AS note FROM pages UNION ALL SELECT page_id, 1, {_MORE}, 'ref', 'second' FROM pages),
  c AS (SELECT page_id, pass, {CANON} AS u, title, note, {_KIND} AS kind FROM p)
  SELECT page_id::VARCHAR AS manifest, u AS url, title, note, kind, 'public-web' AS license FROM c QUALIFY row_number() OVER (PARTITION BY page_id, u ORDER BY pass) = 1"""
ORACLES["chunk_segments"] = _passages(_TALK, 120, 30, False, True)
ORACLES["chunk_segments_across"] = _passages(_TALK, 120, 30, True, True)
ORACLES["chunk_prose"] = _passages(_PROSE, 400, 50, False, False)
ORACLES["chunk_texts"] = f"SELECT source_id, md5(string_agg(content, chr(10) ORDER BY chunk_index)) AS text_md5 FROM ({ORACLES['chunk_segments']}) GROUP BY source_id"
ORACLES["recording_parity"] = """SELECT item_id, '(missing)' AS "column" FROM benchmark WHERE item_id % 7 = 0 UNION ALL SELECT item_id, 'answer' FROM benchmark WHERE item_id % 7 <> 0 AND item_id % 5 = 0 AND length(text) <> 0"""
ORACLES["citation_checks"] = f"""WITH {_CUETABLE}, a AS (SELECT *, source_id || ':' || pos AS own, pos % 11 = 10 AS lost, start + pos % 5 AS t FROM gaps)
  SELECT 'no_passage' AS rule, own || ':none' AS row_key FROM a WHERE lost UNION ALL SELECT 'outside_span', own || ':' || own FROM a WHERE NOT lost AND t > e
  UNION ALL SELECT 'cites_duplicate', own || ':' || own FROM a WHERE NOT lost AND source_id % 9 = 0"""
_CHECKED = f"""checked AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'repo' ELSE 'blog' END AS kind, CASE WHEN contains(url, '/de/') THEN 'not fetched' WHEN contains(url, '/fr/') THEN 'error' WHEN contains(url, '/es/') THEN 'error'
  WHEN ({_marker('html', X.WALL_MARKERS, 20000)}) IS NOT NULL THEN 'wall' WHEN length(html) < 6000 AND page_id % 2 <> 0 THEN 'thin' ELSE 'ok' END AS status,
  CASE WHEN contains(url, '/de/') THEN NULL WHEN contains(url, '/fr/') THEN 'timeout' WHEN contains(url, '/es/') THEN '404' ELSE '200' END AS detail FROM pages)"""
ORACLES["verified_sources"] = f"WITH {_CHECKED} SELECT page_id, status = 'ok' AS ok, status, detail FROM checked"
ORACLES["verified_by_kind"] = f"WITH {_CHECKED} SELECT row_number() OVER (ORDER BY n DESC, kind) AS place, kind, n FROM (SELECT kind, count(*) AS n FROM checked WHERE status = 'ok' GROUP BY kind)"
ORACLES["ingest_outcomes"] = f"""WITH {_TEXTS} SELECT page_id AS id, CASE WHEN page_id % 10 = 0 THEN 'denied' WHEN contains(url, '/fr/') THEN 'failed' WHEN page_id % 13 <> 0 AND contains(url, '/de/') THEN 'bot wall' WHEN ({_marker('t', X.CHALLENGE_MARKERS, 600)}) IS NOT NULL AND page_id % 13 <> 0 THEN 'bot wall'
  WHEN contains(url, '/es/') THEN 'talk without cues' WHEN page_id % 13 = 0 OR t = '' THEN 'no content' ELSE 'ingested' END AS outcome FROM texts"""
ORACLES["citation_join"] = f"""WITH {HITS}, a AS (SELECT item_id, length(text) % 10 AS m FROM benchmark UNION SELECT item_id, 3 FROM benchmark)
  SELECT item_id, marker::INT AS marker, chunk_id FROM a JOIN hits ON marker = m"""
ORACLES["search_report"] = ORACLES["analyse_terms"]
_JSON = f"""j AS (SELECT page_id::VARCHAR AS manifest, page_id, {CANON} AS url, CASE WHEN page_id % 3 = 0 THEN 'docs' ELSE 'blog' END AS kind, CASE WHEN page_id % 4 > 0 THEN 'Page ' || page_id ELSE url END AS title,
  CASE WHEN page_id % 5 = 0 THEN 'cc-by' ELSE 'public-web' END AS license FROM pages)"""
ORACLES["manifest_json"] = f"WITH {_JSON} SELECT manifest, url, kind, title, license FROM j"
ORACLES["manifest_select"] = f"WITH {_JSON} SELECT manifest, url FROM j WHERE kind = 'docs' ORDER BY page_id LIMIT 10"
ORACLES["cache_missing"] = "SELECT page_id, substr(sha256(url), 1, 16) AS cache_key FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)"
ORACLES["cache_rejects"] = "SELECT substr(sha256(url), 1, 16) AS cache_key, CASE WHEN page_id % 7 = 0 THEN 'timeout' END AS reason FROM pages"
ORACLES["pending_batches"] = f"WITH {CHUNKS} SELECT chunk_id, length(content) AS length, 'len' AS embedding_model FROM chunks WHERE embedding IS NULL ORDER BY chunk_id LIMIT 128"
ORACLES["mark_duplicates"] = f"WITH {SOURCES} SELECT id, duplicate_of FROM sources"
ORACLES["clean_segments"] = f"SELECT conv_id AS source_id, turn AS pos, md5({_clean('text')}) AS text_md5, CASE WHEN turn > 0 THEN turn * 4.0::DOUBLE ELSE 0 END AS start FROM conversations WHERE role <> 'system' AND {_clean('text')} <> ''"

_STORED = f"""stored AS (SELECT p.*, owner, title, ('0x' || substr(md5(p.source_id || ':' || chunk_index), 1, 15))::BIGINT AS chunk_id FROM ({ORACLES['chunk_prose']}) p JOIN sources ON id = p.source_id),
 sposts AS (SELECT chunk_id, source_id, owner, term, count(*) AS tf FROM (SELECT chunk_id, source_id, owner, unnest({_TOK.format('content')}) AS term FROM stored) GROUP BY ALL)"""
ORACLES["stored_passages"] = f"SELECT source_id, chunk_index, content_hash, token_count FROM ({ORACLES['chunk_prose']})"
ORACLES["stored_terms"] = f"WITH {SOURCES}, {_STORED} SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM sposts GROUP BY term"
ORACLES["stored_search"] = f"""WITH {SOURCES}, {_STORED}, mine AS (SELECT * FROM sposts WHERE owner IN ('public', 'test1')),
 kept AS (SELECT term FROM mine WHERE list_contains({_LIST}, term) GROUP BY term HAVING count(*) / (SELECT count(*) FROM stored WHERE owner IN ('public', 'test1')) <= 0.10),
 lex AS (SELECT chunk_id, source_id, count(*) AS matched_terms, 0.1::DOUBLE * sum(tf) * count(*) AS score FROM mine JOIN kept USING (term) GROUP BY ALL),
 pool AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS lexical_rank FROM ({_CAP.format('score', 'lex', 4)}) QUALIFY lexical_rank <= 32),
 hits AS (SELECT *, row_number() OVER (ORDER BY lexical_rank) AS marker FROM (SELECT * EXCLUDE (rn) FROM ({_CAP.format('score', 'pool', 2)})) QUALIFY marker <= 8)
SELECT marker, source_id, chunk_index, matched_terms, round(score, 6) AS score, content_hash, title FROM hits JOIN stored USING (chunk_id, source_id)"""

_EACH = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, source_id ORDER BY {0} DESC, chunk_id) AS rn FROM {1}) WHERE rn <= {2}"
_MANY = POSTS + f""", asked AS (SELECT DISTINCT item_id AS qid, term FROM (SELECT item_id, unnest({_TOK.format('text')}) AS term FROM benchmark) WHERE length(term) >= 3 AND NOT list_contains({_LOW}, term)),
 kept AS (SELECT term FROM posts GROUP BY term HAVING count(*) / (SELECT greatest(count(*), 1) FROM seen) <= 0.10),
 lex AS (SELECT qid, chunk_id, source_id, count(*) AS matched_terms, 0.1::DOUBLE * sum(tf) * count(*) AS score FROM posts JOIN seen USING (chunk_id) JOIN kept USING (term) JOIN asked USING (term) GROUP BY ALL),
 lexpool AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS lexical_rank FROM ({_EACH.format('score', 'lex', 4)}) QUALIFY lexical_rank <= 32),
 sem AS (SELECT item_id AS qid, chunk_id, source_id, round(list_cosine_similarity(s.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS similarity FROM benchmark JOIN embeddings e ON vec_id = item_id, seen s WHERE s.embedding IS NOT NULL),
 win AS (SELECT * FROM sem QUALIFY row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, chunk_id) <= 256),
 vecpool AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, chunk_id) AS vector_rank FROM ({_EACH.format('similarity', 'win', 4)}) QUALIFY vector_rank <= 32),
 fused AS (SELECT coalesce(l.qid, v.qid) AS qid, coalesce(l.chunk_id, v.chunk_id) AS chunk_id, coalesce(l.source_id, v.source_id) AS source_id, coalesce(matched_terms, 0) AS matched_terms, similarity,
   round(coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0), 12) AS rrf,
   CASE WHEN lexical_rank IS NOT NULL AND vector_rank IS NOT NULL THEN 'both' WHEN lexical_rank IS NOT NULL THEN 'words' ELSE 'meaning' END AS found_by
   FROM lexpool l FULL JOIN vecpool v ON l.qid = v.qid AND l.chunk_id = v.chunk_id),
 hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, chunk_id) AS marker FROM ({_EACH.format('rrf', 'fused', 2)}) QUALIFY marker <= 8)"""
ORACLES["search_many"] = f"WITH {_MANY} SELECT qid, marker, chunk_id, source_id, matched_terms, round(similarity, 6) AS similarity, round(rrf, 9) AS rrf, found_by FROM hits"
ORACLES["abstain_many"] = f"""WITH {_MANY}, f AS (SELECT item_id AS qid, count(chunk_id) AS hits, coalesce(max(matched_terms), 0) AS best_matched, max(similarity) AS s FROM benchmark LEFT JOIN hits ON qid = item_id GROUP BY item_id)
 SELECT qid, hits, best_matched, round(s, 6) AS best_similarity, hits < 1 OR NOT (best_matched >= 2 OR coalesce(s >= 0.45, false)) AS abstained FROM f"""
