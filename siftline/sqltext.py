"""SQL for DuckDB, part by part, for the same results as the library's columns and operators."""

from __future__ import annotations

from .functions import lexicon as lx
from .functions.html import LINE_END, PARAGRAPH_END
from .functions.text import NAMED, REFERENCE, RENUMBERED, TERM
from .plans import corpus as cp

PATH = "regexp_extract({0}, '^https?://[^/?#]+([^?#]*)', 1)"
HOST = "regexp_extract({0}, '^https?://([^/?#]+)', 1)"


def path(u: str) -> str:
    return PATH.format(u)


def host(u: str) -> str:
    return HOST.format(u)


def slug(u: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(lower({path(u)}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'home')"


def page_type(u: str) -> str:
    return lx.sql_case(f"lower({path(u)})", lx.PAGE_TYPES, f"CASE WHEN len(string_split({path(u)}, '/')) > 2 THEN 'general' ELSE 'home' END", True, quote=False)


def page_key(u: str) -> str:
    return f"'page_' || substr(md5({u}), 1, 8)"


def words(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '\\S+')) AS BIGINT)"


def cleaned(q: str) -> str:
    return f"trim(regexp_replace(regexp_replace({q}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z]{{2,}}')"


def without(values: str, stop: list[str]) -> str:
    return f"list_filter({values}, lambda x: NOT list_contains({lx.sql_list(stop)}, x))"


def distinct(values: str) -> str:
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


def section_type(name: str) -> str:
    return lx.sql_case(f"lower({name})", lx.SECTION_TYPES, "general")


def rounded_exactly(x: str) -> str:
    """Two places by the exact binary value; see functions.text."""
    up = "(floor(v * 67108864) / 67108864 * 200 - (floor(v * 100) * 2 + 1)) + (v - floor(v * 67108864) / 67108864) * 200"
    return f"list_transform([{x}], lambda v: (floor(v * 100) + CASE WHEN {up} > 0 OR ({up} = 0 AND floor(v * 100) % 2 = 1) THEN 1 ELSE 0 END) / CAST(100 AS DOUBLE))[1]"


def priority(kind: str, n: str) -> str:
    boost = "CASE " + " ".join(f"WHEN {kind} = '{k}' THEN CAST({v} AS DOUBLE)" for k, v in lx.TYPE_BOOSTS.items()) + " ELSE CAST(0 AS DOUBLE) END"
    return rounded_exactly(f"least(CAST(0.5 AS DOUBLE) + {boost} + least({n} / CAST(700 AS DOUBLE), CAST(1 AS DOUBLE)) * CAST(0.15 AS DOUBLE) + CAST(0 AS DOUBLE), CAST(1 AS DOUBLE))")


def display(key: str) -> str:
    """Words of a key with first letters raised; a word ends at a blank."""
    return f"array_to_string(list_transform(string_split(replace({key}, '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"


def chunk_id(page: str, n: str) -> str:
    return f"{page} || '_chunk_' || CASE WHEN {n} < 1000 THEN lpad(CAST({n} AS VARCHAR), 3, '0') ELSE CAST({n} AS VARCHAR) END"


def unescaped(x: str) -> str:
    known = lambda pairs: "MAP {" + ", ".join(f"{lx.quoted(k) if isinstance(k, str) else k}: {lx.quoted(v)}" for k, v in pairs.items()) + "}"
    code = "CAST(CASE WHEN regexp_matches(p[2], '^&#[xX]') THEN '0x' || p[2][4:-2] ELSE p[2][3:-2] END AS INTEGER)"
    by_number = f"list_transform([{code}], lambda n: coalesce({known(RENUMBERED)}[n], CASE WHEN n > 1114111 OR n BETWEEN 55296 AND 57343 THEN chr(65533) ELSE chr(n) END))[1]"
    char = f"CASE WHEN p[2] IS NULL THEN '' WHEN starts_with(p[2], '&#') THEN {by_number} ELSE coalesce({known(NAMED)}[p[2]], p[2]) END"
    whole = f"array_to_string(list_transform(list_zip(string_split_regex(t, '{REFERENCE}'), regexp_extract_all(t, '{REFERENCE}')), lambda p: p[1] || {char}), '')"
    return f"list_transform([{x}], lambda t: CASE WHEN contains(t, '&') THEN {whole} ELSE t END)[1]"


def tag_text(x: str) -> str:
    made = unescaped(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')")
    return f"trim(regexp_replace({made}, '\\s+', ' ', 'g'))"


def stripped(x: str) -> str:
    for t in ("script", "style", "noscript", "iframe", "nav", "footer"):
        x = f"regexp_replace({x}, '(?is)<{t}\\b.*?</{t}>', '', 'g')"
    return x


def visible(x: str) -> str:
    return tag_text(f"regexp_replace(regexp_replace({stripped(x)}, '(?is)<head\\b.*?</head>', '', 'g'), '(?s)<!--.*?-->', '', 'g')")


def title(x: str) -> str:
    return tag_text(f"regexp_extract({x}, '(?is)<title[^>]*>(.*?)</title>', 1)")


def h1(x: str) -> str:
    inner = tag_text(f"regexp_extract({x}, '(?is)<h1[^>]*>(.*?)</h1>', 1)")
    return f"coalesce(nullif({inner}, ''), {title(x)})"


def whole(text: str, ts: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_]){t}([^\\p{{L}}\\p{{N}}_]|$)')" for t in ts) + ")"


def base_key(x: str) -> str:
    made = f"regexp_replace(substr(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '_', 'g'), 1, 70), '^_+|_+$', '', 'g')"
    return f"coalesce(nullif({made}, ''), 'section')"


def entities(x: str) -> str:
    runs = f"regexp_extract_all(regexp_replace({x}, '[À-ÖØ-öø-ɏ]', '_', 'g'), '\\b[A-Z][a-z]+(?:\\s[A-Z][a-z]+)*\\b')"
    acronyms = f"list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda e: regexp_matches(e, '^[A-Z]{{2,6}}$'))"
    every = f"list_concat({runs}, {acronyms})"
    return f"list_filter({every}, lambda e, i: list_position({every}, e) = i)[1:20]"


def keyword_rows(source: str, key: str, text: str, stop: list[str], most: int) -> str:
    """key, keywords (list) of the rows of source."""
    return f"""SELECT {key}, list(w ORDER BY n DESC, idx) AS keywords FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, idx) AS r FROM (
    SELECT {key}, w, count(*) AS n, min(idx) AS idx FROM (
      SELECT {key}, unnest(l) AS w, generate_subscripts(l, 1) AS idx FROM (SELECT {key}, {without(f"regexp_extract_all(lower({text}), '[a-z]{{3,}}')", stop)} AS l FROM {source})
    ) GROUP BY ALL)
) WHERE r <= {most} GROUP BY {key}"""


SECTION_OF = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in cp.SECTIONS.items()) + f" ELSE '{cp.OTHER_SECTION}' END"
PAGE_URL = f"'https://corpus.example/' || source || '-' || {lx.sql_list(cp.SLUGS)}[1 + coalesce(TRY_CAST(substr(source, 4, 9) AS BIGINT), 0) % {len(cp.SLUGS)}]"

CHUNKS = f"""base AS (
  SELECT doc_id AS chunk_id, source AS page_id, {PAGE_URL} AS url, {SECTION_OF} AS section, text, {words('text')} AS wc FROM documents
), typed AS (SELECT *, {section_type('section')} AS section_type FROM base
), kw AS ({keyword_rows('base', 'chunk_id', 'text', lx.CHUNK_STOP_WORDS, 15)}
), chunks AS (
  SELECT t.chunk_id, page_id, url, section, section_type, text, {priority('section_type', 'wc')} AS priority_score, coalesce(kw.keywords, CAST([] AS VARCHAR[])) AS keywords
  FROM typed t LEFT JOIN kw USING (chunk_id))"""

DOC_PAGES = f"""doc_pages AS (
  SELECT source AS page_id, {PAGE_URL} AS url, source AS title, text FROM (SELECT source, arg_min(text, doc_id) AS text FROM documents GROUP BY source)
), sluggish AS (SELECT *, {slug('url')} AS slug FROM doc_pages)"""

QUESTIONS = "questions AS (SELECT 'b' || item_id AS query_id, text FROM benchmark UNION ALL SELECT 'c' || conv_id || '_' || turn, text FROM conversations WHERE role = 'user')"


def intent_list(text: str, toks: str, topics: list) -> str:
    items = ", ".join(f"CASE WHEN {whole(f'lower({text})', ts)} OR list_has_any({toks}, {lx.sql_list(ts)}) THEN '{n}' END" for n, ts in topics)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def processed(topics: list) -> str:
    first = "MAP {" + ", ".join(f"'{n}': {lx.sql_list(ts[:2])}" for n, ts in topics) + "}"
    return f"""{QUESTIONS}, q1 AS (SELECT *, {cleaned('text')} AS clean FROM questions WHERE length(text) BETWEEN 1 AND 2000 AND trim(text) <> ''
), q2 AS (SELECT *, {tokens('clean')} AS original FROM q1
), q3 AS (SELECT *, list_transform({without('original', lx.STOP_WORDS)}, lambda x: coalesce({lx.sql_map(lx.SYNONYMS)}[x], x)) AS tokens FROM q2
), q4 AS (SELECT *, {distinct('tokens')} AS keywords, {intent_list('text', 'tokens', topics)} AS matched FROM q3
), q5 AS (SELECT *, CASE WHEN len(matched) > 0 THEN matched ELSE ['general'] END AS intents FROM q4
), q6 AS (SELECT *, list_concat(keywords, flatten(list_transform(intents, lambda m: coalesce({first}[m], CAST([] AS VARCHAR[]))))) AS both_lists, list_filter(keywords[1:8], lambda t: length(t) > 2) AS long8 FROM q5
), processed AS (SELECT query_id, text, clean, original, tokens, keywords, intents, {distinct('both_lists')} AS routing_keywords,
  CASE WHEN len(long8) > 0 THEN long8 ELSE list_filter(original[1:5], lambda t: length(t) > 2) END AS match_terms,
  regexp_matches(clean, '(?i)^\\s*({lx.FAQ_OPENERS})') AS faq_like,
  CASE WHEN len(keywords) > 0 THEN array_to_string(list_transform(keywords[1:6], lambda k: '"' || k || '"'), ' OR ') ELSE clean END AS phrase FROM q6)"""


KEYWORD_INDEX = "keyword_index AS (SELECT DISTINCT keyword, chunk_id, page_id, priority_score AS weight FROM (SELECT unnest(keywords) AS keyword, chunk_id, page_id, priority_score FROM chunks))"
URL_INDEX = f"""url_index AS (SELECT DISTINCT slug, page_id FROM (SELECT page_id, unnest(list_concat([slug], string_split_regex(slug, '[-/]'), string_split(lower({path('url')}), '/'))) AS slug FROM sluggish) WHERE slug <> '')"""


def intent_index(topics: list) -> str:
    seen = "lower(slug || ' ' || title || ' ' || substr(text, 1, 500))"
    items = ", ".join(f"CASE WHEN {whole('seen', ts)} THEN '{n}' END" for n, ts in topics)
    return f"intent_index AS (SELECT DISTINCT intent, page_id FROM (SELECT page_id, unnest([{items}]) AS intent FROM (SELECT page_id, {seen} AS seen FROM sluggish)) WHERE intent IS NOT NULL)"


FAQ_INDEX = """faq_index AS (SELECT question_hash, question, chunk_id, page_id FROM (
  SELECT *, row_number() OVER (PARTITION BY question_hash ORDER BY chunk_id) AS r FROM (
    SELECT md5(lower(question)) AS question_hash, question, chunk_id, page_id FROM (
      SELECT trim(replace(string_split(text, chr(10))[1], 'Q:', '')) AS question, chunk_id, page_id FROM chunks WHERE section_type = 'faq') WHERE question <> '')) WHERE r = 1)"""

ASCII = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS = "regexp_extract_all({0}, '" + TERM + "')"
POSTINGS = f"""postings AS (SELECT term, chunk_id, count(*) AS tf FROM (
  SELECT chunk_id, unnest({TERMS.format(ASCII.format("section || ' ' || page_id || ' ' || text || ' ' || array_to_string(keywords, ' ')"))}) AS term FROM chunks) GROUP BY ALL)"""

SCORED = """len AS (SELECT chunk_id, sum(tf) AS len FROM postings GROUP BY 1), stat AS (SELECT count(*) AS n, avg(len) AS avgdl FROM len
), df AS (SELECT term, count(*) AS df FROM postings GROUP BY 1
), wanted AS (SELECT query_id, unnest(match_terms) AS term, len(match_terms) AS n_terms FROM processed
), idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf, avgdl FROM df, stat
), scored AS (
  SELECT query_id, chunk_id, page_id, floor(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) * 1000000 + 0.5) / 1000000 AS score, count(*) AS n_match, max(n_terms) AS n_terms
  FROM wanted JOIN postings USING (term) JOIN idf USING (term) JOIN len USING (chunk_id) JOIN chunks USING (chunk_id) GROUP BY ALL)"""

ROUTED = """kw_hits AS (SELECT query_id, keyword, idx, k.chunk_id, k.page_id FROM (SELECT query_id, unnest(keywords) AS keyword, generate_subscripts(keywords, 1) AS idx FROM processed) JOIN keyword_index k USING (keyword)
), routed AS (SELECT query_id, page_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY page_id) AS r FROM (
  SELECT query_id, page_id FROM (SELECT query_id, unnest(intents) AS intent FROM processed) JOIN intent_index USING (intent) WHERE intent <> 'general'
  UNION SELECT query_id, page_id FROM (SELECT query_id, unnest(routing_keywords[1:5]) AS slug FROM processed) JOIN url_index USING (slug)
  UNION SELECT query_id, page_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, keyword ORDER BY chunk_id) AS r FROM kw_hits WHERE idx <= 8) WHERE r <= 50)) WHERE r <= 800)"""

TIERED = """flagged AS (SELECT s.*, n_match = n_terms AS whole, h.query_id IS NOT NULL AS has_route, r.page_id IS NOT NULL OR h.query_id IS NULL AS inside
  FROM scored s LEFT JOIN routed r USING (query_id, page_id) LEFT JOIN (SELECT DISTINCT query_id FROM routed) h USING (query_id)
), counted AS (SELECT *, count(*) FILTER (whole AND inside) OVER q AS n1, count(*) FILTER (whole) OVER q AS n_whole, count(*) FILTER (inside) OVER q AS n_inside FROM flagged WINDOW q AS (PARTITION BY query_id)
), c2 AS (SELECT *, has_route AND n1 < 3 AS second, CASE WHEN has_route AND n1 < 3 THEN n_whole ELSE n1 END AS after FROM counted
), c3 AS (SELECT *, after < 3 AND n_terms > 1 AS third, CASE WHEN after < 3 AND n_terms > 1 THEN after + n_inside - n1 ELSE after END AS total FROM c2
), c4 AS (SELECT *, CASE WHEN whole AND inside THEN 1 WHEN whole AND second THEN 2 WHEN inside AND third THEN 3
    WHEN has_route AND total < 3 AND (whole OR (n_whole < 3 AND n_terms > 1)) THEN 4 END AS tier FROM c3
), c5 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, chunk_id) AS place, row_number() OVER (PARTITION BY query_id ORDER BY whole DESC, score DESC, chunk_id) AS broad FROM c4 WHERE tier IS NOT NULL
), tiered AS (SELECT query_id, chunk_id, score, CAST(tier AS BIGINT) AS tier FROM c5 WHERE (tier < 4 AND place <= 25) OR (tier = 4 AND broad <= 20))"""


def question_words(x: str) -> str:
    return f"list_distinct({without(tokens(x), lx.STOP_WORDS)})"


def likeness(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


def faq_match(queries: str, faq: str, name: str = "faq_match") -> str:
    return f"""{name} AS (SELECT query_id, chunk_id, likeness FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY likeness DESC, chunk_id) AS r FROM (
  SELECT query_id, chunk_id, round({likeness('q', 'f')}, 6) AS likeness FROM (SELECT query_id, {question_words('text')} AS q FROM {queries}), (SELECT chunk_id, {question_words('question')} AS f FROM {faq})
) WHERE likeness >= 0.4) WHERE r = 1)"""


SUPPLEMENT = """supplement AS (SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY idx, chunk_id) AS r FROM (
  SELECT query_id, chunk_id, min(idx) AS idx FROM kw_hits WHERE idx <= 10 GROUP BY ALL)) WHERE r <= 50)"""

GATHERED = """more AS (SELECT query_id, chunk_id, CAST(0.2 AS DOUBLE) AS score, CAST(5 AS BIGINT) AS tier FROM supplement s WHERE NOT EXISTS (FROM tiered t WHERE t.query_id = s.query_id AND t.chunk_id = s.chunk_id)
), both_kinds AS (SELECT * FROM tiered UNION ALL SELECT * FROM more
), gathered AS (SELECT * FROM both_kinds UNION ALL
  SELECT query_id, chunk_id, CAST(1.0 AS DOUBLE), CAST(6 AS BIGINT) FROM faq_match f WHERE NOT EXISTS (FROM both_kinds t WHERE t.query_id = f.query_id AND t.chunk_id = f.chunk_id))"""

RERANKED = """joined AS (SELECT g.*, c.page_id, c.url, c.section, c.section_type, c.text, c.priority_score, c.keywords,
    len(list_intersect(p.keywords, c.keywords)) / CAST(greatest(len(list_distinct(p.keywords)), 1) AS DOUBLE) AS overlap
  FROM gathered g JOIN chunks c USING (chunk_id) JOIN processed p USING (query_id)
), boosted AS (SELECT *, floor(score * ((CASE WHEN section_type = 'faq' THEN 2.0 ELSE 1.0 END * CASE WHEN contains(lower(section), 'title') OR contains(lower(section), 'overview') THEN 2.5 ELSE 1.0 END
    * CASE WHEN section_type IN ('requirements', 'process', 'pricing') THEN 1.5 ELSE 1.0 END)::DOUBLE + overlap * 0.5::DOUBLE) * (0.5::DOUBLE + CASE WHEN priority_score = 0 THEN 0.5 ELSE priority_score END) * 1000000 + 0.5) / 1000000 AS final_score FROM joined
), reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, tier, chunk_id) AS place FROM boosted)"""

TOP = """deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(substr(text, 1, 80)) ORDER BY place) AS dup FROM reranked) WHERE dup = 1
), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM deduped) WHERE rank <= 5)"""

CONFIDENCE = """confidence AS (SELECT p.query_id, coalesce(n_chunks, 0) AS n_chunks,
   coalesce(@@, CAST(0 AS DOUBLE)) AS confidence
  FROM processed p LEFT JOIN (SELECT query_id, count(*) AS n_chunks, max(CASE WHEN rank = 1 THEN overlap END) AS o, max(CASE WHEN rank = 1 THEN priority_score END) AS pr FROM top GROUP BY 1) USING (query_id))""".replace("@@", rounded_exactly("least(n_chunks / CAST(5 AS DOUBLE), CAST(1 AS DOUBLE)) * 0.3::DOUBLE + least(o, CAST(1 AS DOUBLE)) * 0.4::DOUBLE + pr * 0.3::DOUBLE"))

CONTEXT = """context AS (SELECT query_id, string_agg('[Source ' || rank || ']' || CASE WHEN url <> '' THEN ' | Page: ' || url ELSE '' END || CASE WHEN section <> '' THEN ' | Section: ' || section ELSE '' END || chr(10) || trim(text) || chr(10), chr(10) || '---' || chr(10) ORDER BY rank) AS context,
   list(url ORDER BY rank) AS every_url, arg_min(text, rank) AS first_text FROM top GROUP BY 1
), contexts AS (SELECT *, list_filter(every_url, lambda u, i: list_position(every_url, u) = i) AS urls FROM context)"""

AFTER_CHUNKS = [processed(lx.SAMPLE_INTENTS), KEYWORD_INDEX, URL_INDEX, intent_index(lx.SAMPLE_INTENTS), FAQ_INDEX, POSTINGS, SCORED, ROUTED, TIERED, faq_match("(SELECT * FROM processed WHERE faq_like)", "faq_index"), SUPPLEMENT, GATHERED, RERANKED, TOP, CONFIDENCE, CONTEXT]
RETRIEVAL = ", ".join([CHUNKS, DOC_PAGES, *AFTER_CHUNKS])


def retrieval(select: str) -> str:
    return f"WITH {RETRIEVAL} {select}"


PACKED = f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM line_sections
), packing(doc_id, i, pos, key, text, wc, pack, held) AS (
  SELECT doc_id, i, pos, key, text, wc, 1, CASE WHEN wc < 50 THEN wc ELSE 0 END FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.doc_id, o.i, o.pos, o.key, o.text, o.wc, p.pack + CASE WHEN o.wc >= 50 OR p.held = 0 THEN 1 ELSE 0 END, CASE WHEN o.wc >= 50 OR p.held + o.wc >= 50 THEN 0 ELSE p.held + o.wc END
  FROM packing p JOIN ordered o ON o.doc_id = p.doc_id AND o.i = p.i + 1
), ends AS (SELECT doc_id, max(pack) AS last FROM packing GROUP BY 1
), small AS (SELECT doc_id, min(pos) AS pos, 0 AS part, arg_max(key, pos) AS key, trim(string_agg(text, ' ' ORDER BY pos)) AS text, sum(wc) AS wc FROM packing JOIN ends USING (doc_id) WHERE wc <= 700 GROUP BY doc_id, pack, last HAVING pack < last OR sum(wc) >= 15
), pieces AS (SELECT doc_id, pos, key, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, pos, key, string_split(regexp_replace(text, '([.!?])\\s+', '\\1␞', 'g'), '␞') AS l FROM packing WHERE wc > 700)
), sized AS (SELECT *, {words('line')} AS wc FROM pieces
), cutting(doc_id, pos, key, i, line, wc, part, held) AS (
  SELECT doc_id, pos, key, i, line, wc, 0, wc FROM sized WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.pos, s.key, s.i, s.line, s.wc, c.part + CASE WHEN c.held > 0 AND c.held + s.wc > 700 THEN 1 ELSE 0 END, CASE WHEN c.held > 0 AND c.held + s.wc > 700 THEN s.wc ELSE c.held + s.wc END
  FROM cutting c JOIN sized s ON s.doc_id = c.doc_id AND s.pos = c.pos AND s.i = c.i + 1
), large AS (SELECT doc_id, pos, part, key, trim(string_agg(line, ' ' ORDER BY i)) AS text, sum(wc) AS wc FROM cutting GROUP BY ALL
), packed AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) AS n, key, text, CAST(wc AS BIGINT) AS wc FROM (SELECT * FROM small UNION ALL SELECT * FROM large WHERE text <> ''))"""

DESCRIBED = f"""described AS (SELECT doc_id || '_chunk_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS chunk_id, doc_id, {section_type('key')} AS section_type, text, wc AS word_count,
  {entities('text')} AS entities, {priority(section_type('key'), 'wc')} AS priority_score, sha256(text) AS content_hash FROM packed)"""


def visible_lines(x: str) -> str:
    kept = f"regexp_replace(regexp_replace({stripped(x)}, '(?is)<head\\b.*?</head>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
    broken = f"regexp_replace(regexp_replace(regexp_replace({kept}, '\\s+', ' ', 'g'), '{PARAGRAPH_END}', chr(10) || chr(10), 'g'), '{LINE_END}', chr(10), 'g')"
    text = f"regexp_replace({unescaped(f"regexp_replace({broken}, '<[^>]*>', '', 'g')")}, '[ \\t]*\\n[ \\t]*', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({text}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


def visible_sections(source: str) -> str:
    """visible_sections (id, pos, key, text) of the rows of source (id, text, title; title null: none)."""
    return f"""vlines AS (SELECT id, trim(title) AS title, trim(line) AS line, idx - 1 AS pos FROM (SELECT id, title, unnest(l) AS line, generate_subscripts(l, 1) AS idx FROM (SELECT id, title, string_split(text, chr(10)) AS l FROM {source}))
), vmarked AS (SELECT *, sum(CAST(heading AS INT)) OVER (PARTITION BY id ORDER BY pos) AS sid, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS bid FROM (
  SELECT id, line, pos, regexp_matches(line, {lx.quoted(lx.HEADING_PATTERN)}) AND length(line) < 120 AS heading FROM vlines
  WHERE NOT list_contains({lx.sql_list(lx.NOISE_LINES)}, lower(line)) AND NOT regexp_matches(line, {lx.quoted(lx.NOISE_PATTERN)}) AND (title IS NULL OR line <> title OR line = ''))
), vheaded AS (SELECT id, sid, min(pos) AS pos, coalesce(max(CASE WHEN heading THEN line END), 'introduction') AS name, trim(string_agg(CASE WHEN NOT heading THEN line END, ' ' ORDER BY pos)) AS text FROM vmarked GROUP BY ALL
), vnamed AS (SELECT * FROM vheaded WHERE text <> ''), vseveral AS (SELECT id FROM vnamed GROUP BY 1 HAVING count(*) > 1 AND max(sid) > 0
), vparts AS (SELECT id, bid, min(pos) AS pos, string_agg(line, ' ' ORDER BY pos) AS text FROM vmarked WHERE line <> '' GROUP BY ALL
), vfirst AS (SELECT *, coalesce(nullif(substr(trim(regexp_extract(text, '^([^.!?]*)', 1)), 1, 60), ''), substr(text, 1, 40)) AS name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rank FROM vparts WHERE length(text) > 40) WHERE rank <= 80
), vboth AS (SELECT id, pos, name, text FROM vnamed WHERE id IN (FROM vseveral) UNION ALL SELECT id, pos, name, text FROM vfirst WHERE id NOT IN (FROM vseveral)
), visible_sections AS (SELECT id, pos, CASE WHEN r = 1 THEN base ELSE base || '_' || r END AS key, text FROM (SELECT *, row_number() OVER (PARTITION BY id, base ORDER BY pos) AS r FROM (SELECT *, {base_key('name')} AS base FROM vboth)))"""


DESCRIPTION = """trim(regexp_extract(regexp_extract(html, '(?is)<meta\\b[^>]*?\\bname\\s*=\\s*["'']description["''][^>]*>'), '(?is)\\bcontent\\s*=\\s*"([^"]*)"', 1))"""
PAGE_CHUNKS = f"""ptexts AS (SELECT page_id, url, {slug('url')} AS slug, {title('html')} AS title, {h1('html')} AS h1, {DESCRIPTION} AS description, {visible_lines('html')} AS text FROM pages
), {visible_sections('(SELECT page_id AS id, text, title FROM ptexts)')}
, line_sections AS (SELECT id AS doc_id, CAST(pos AS BIGINT) AS pos, key, text, {words('text')} AS wc FROM visible_sections WHERE {words('text')} >= 10), {PACKED}, {DESCRIBED}
, ptitles AS (SELECT page_id || '_title' AS chunk_id, page_id, 'Title / Overview' AS section, 'intro' AS section_type, trim(h1 || '. ' || description) AS text, CAST(0.8 AS DOUBLE) AS priority_score FROM ptexts WHERE title <> '' OR description <> ''
), pkw AS ({keyword_rows("(SELECT page_id, title || ' ' || text AS t FROM ptexts)", 'page_id', 't', lx.PAGE_STOP_WORDS, 40)}
), psaid AS (SELECT t.*, t.text || ' ' || coalesce(array_to_string(pkw.keywords, ' '), '') AS said FROM ptitles t LEFT JOIN pkw USING (page_id)
  UNION ALL SELECT d.chunk_id, d.doc_id, {display('p.key')}, d.section_type, d.text, d.priority_score, d.text FROM described d JOIN packed p ON p.doc_id = d.doc_id AND d.chunk_id = {chunk_id('p.doc_id', 'p.n')}
), ckw AS ({keyword_rows('psaid', 'chunk_id', 'said', lx.CHUNK_STOP_WORDS, 15)}
), all_page_chunks AS (SELECT chunk_id, page_id, title AS page_title, url, section, section_type, p.text, {words('p.text')} AS word_count, coalesce(ckw.keywords, CAST([] AS VARCHAR[])) AS keywords, {entities('p.text')} AS entities, priority_score, sha256(p.text) AS content_hash
  FROM psaid p JOIN ptexts USING (page_id) LEFT JOIN ckw USING (chunk_id))"""


def on_pages(select: str, retrieval: bool = False) -> str:
    """A query over the chunks of raw pages, or over retrieval from them."""
    own = PAGE_CHUNKS
    if retrieval:
        own += ", chunks AS (SELECT * FROM all_page_chunks), sluggish AS (SELECT page_id, url, slug, title, text FROM ptexts), doc_pages AS (FROM sluggish), " + ", ".join(AFTER_CHUNKS).replace("section || ' ' || page_id || ' ' || text", "section || ' ' || page_title || ' ' || text")
    return f"WITH RECURSIVE {own} {select}"
