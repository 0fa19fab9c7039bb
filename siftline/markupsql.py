"""SQL for DuckDB for the parts of pages, step by step as in operators.markup."""

from __future__ import annotations

from .functions import lexicon as lx
from .operators import markup as m
from .sqltext import unescaped


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def among(column: str, values) -> str:
    return f"{column} IN (" + ", ".join(quoted(v) for v in values) + ")"


def attribute(raw: str, name: str) -> str:
    """Null where the tag has no such attribute."""
    own = f"list_filter(regexp_extract_all({raw}, {quoted(m.ATTRIBUTE)}), lambda x: lower(regexp_extract(x, '^[^\\s=]+')) = '{name}')[1]"
    made = f"regexp_replace(regexp_replace({own}, '^[^\\s=]+\\s*=\\s*', ''), {quoted(r'''^["']|["']$''')}, '', 'g')"
    return unescaped(made)


def text_of(raw: str) -> str:
    return f"trim(regexp_replace({unescaped(raw)}, '\\s+', ' ', 'g'))"


UPTO, AFTER = "PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "PARTITION BY page_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"

def _stop(any_of, closed) -> str:
    return f"(step <> 0 AND {among('tag', any_of)}" + (f" OR step < 0 AND {among('tag', closed)})" if closed else ")")


STOPS = ", ".join(f"min(CASE WHEN {_stop(a, c)} THEN {x} END) OVER ({AFTER}) AS stop_{t[0]}_{x}" for t, (_, a, c) in m.ENDED.items() for x in ("pos", "n"))
ENDS = " ".join(f"WHEN {among('tag', t)} AND ({always} OR balance <> 0) THEN CASE WHEN stop_{t[0]}_pos IS NOT NULL THEN {{'pos': stop_{t[0]}_pos, 'n': stop_{t[0]}_n}} END" for t, (always, _, _) in m.ENDED.items())

BOUNDED = f"""cut AS (SELECT page_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), {quoted(m.TOKEN)}) AS l FROM pages)
), tagged AS (SELECT *, lower(regexp_extract(raw, {quoted(m.TAG_NAME)}, 1)) AS tag FROM cut
), kinds AS (SELECT *, CASE WHEN NOT starts_with(raw, '<') OR raw = '<' THEN 'text' WHEN tag = '' OR ({among('tag', m.RAW)} AND NOT starts_with(raw, '</')) THEN 'other'
   WHEN starts_with(raw, '</') THEN 'close' WHEN {among('tag', m.VOID)} THEN 'void' ELSE 'open' END AS kind FROM tagged
), said AS (SELECT *, CASE WHEN kind = 'text' THEN {text_of('raw')} ELSE '' END AS text, CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END AS step FROM kinds
), numbered AS (SELECT *, CAST(sum(CASE WHEN text <> '' THEN 1 ELSE 0 END) OVER ({UPTO}) AS BIGINT) AS n,
   sum(step) OVER (PARTITION BY page_id, tag ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + CASE WHEN step < 0 THEN 1 ELSE 0 END AS level, sum(step) OVER (PARTITION BY page_id, tag) AS balance FROM said
), paired AS (SELECT *, lead({{'pos': pos, 'n': n}}) OVER (PARTITION BY page_id, tag, level, step <> 0 ORDER BY pos) AS matched, {STOPS},
   max(pos) OVER (PARTITION BY page_id) + 1 AS last_pos, max(n) OVER (PARTITION BY page_id) AS last_n FROM numbered
), ended AS (SELECT *, CASE WHEN kind <> 'open' THEN NULL {ENDS} ELSE matched END AS e FROM paired
), bounded AS (SELECT page_id, pos, raw, tag, kind, text, n, CASE WHEN kind = 'open' THEN coalesce(e.pos, last_pos) END AS "end", CASE WHEN kind = 'open' THEN coalesce(e.n, last_n) END AS n_end FROM ended)"""


def is_noise(tags, classes, ids) -> str:
    own = f"regexp_split_to_array(coalesce({attribute('raw', 'class')}, ''), '\\s+')"
    listed = "[" + ", ".join(quoted(c) for c in classes) + "]"
    named = " OR ".join([among("tag", tags), f"list_has_any({own}, {listed})", f"coalesce({among(attribute('raw', 'id'), ids)}, false)", "regexp_matches(raw, '(?i)\\sdata-ad[\\s=>]')"])
    return f"(kind = 'open' AND ({named}))"


def within(condition: str) -> str:
    return f"""coalesce(max(CASE WHEN {condition} THEN "end" END) OVER ({UPTO}) > pos, false)"""


def elements(wanted: str) -> str:
    """CTEs up to `own`: page_id, pos, end, tag, raw, noise, text, tight, clean, tight_clean of the openings that are wanted."""
    said = lambda x, glue: f"coalesce(array_to_string(list_transform({x}, lambda t: t.text), '{glue}'), '')"
    part = "coalesce(texts[n + 1:coalesce(n_end, n)], [])"
    clean = f"list_filter({part}, lambda t: NOT t.noise)"
    return f"""{BOUNDED}, noisy AS (SELECT *, {within(is_noise(lx.NOISE_TAGS, lx.NOISE_CLASSES, lx.NOISE_IDS))} AS noise FROM bounded
), page_texts AS (SELECT page_id, list({{'text': text, 'noise': noise}} ORDER BY pos) AS texts FROM noisy WHERE text <> '' GROUP BY page_id
), own AS (SELECT page_id, pos, "end", tag, raw, noise, {said(part, ' ')} AS text, {said(part, '')} AS tight, {said(clean, ' ')} AS clean, {said(clean, '')} AS tight_clean
  FROM noisy LEFT JOIN page_texts USING (page_id) WHERE kind IN ('open', 'void') AND ({wanted}))"""


ANY_ITEM = "regexp_matches(raw, '(?i)itemprop|itemtype')"

META = f"""WITH {elements("tag = 'meta'")}, named AS (
  SELECT page_id, pos, lower(coalesce(nullif({attribute('raw', 'name')}, ''), {attribute('raw', 'property')})) AS name, {attribute('raw', 'content')} AS content FROM own
), once AS (SELECT page_id, name, arg_max(content, pos) AS content, min(pos) AS pos FROM named WHERE name <> '' AND content <> '' GROUP BY page_id, name)
SELECT page_id, coalesce(array_to_string(list(name || '=' || content ORDER BY pos) FILTER (WHERE name IS NOT NULL), '|'), '') AS meta_map FROM pages LEFT JOIN once USING (page_id) GROUP BY page_id"""

BREADCRUMBS = f"""WITH {elements(f"tag IN ('nav', 'ol', 'ul', 'a', 'span', 'li') OR {ANY_ITEM}")}, firsts AS (
  SELECT *, min(CASE WHEN coalesce(contains({attribute('raw', 'itemtype')}, 'BreadcrumbList'), false) THEN {{'pos': pos, 'end': "end"}} END) OVER (PARTITION BY page_id) AS s,
    min(CASE WHEN tag IN ('nav', 'ol', 'ul') AND coalesce(contains(lower({attribute('raw', 'aria-label')}), 'breadcrumb'), false) THEN {{'pos': pos, 'end': "end"}} END) OVER (PARTITION BY page_id) AS nav,
    min(CASE WHEN tag IN ('a', 'span') THEN pos END) OVER ({AFTER}) AS following FROM own
), crumbs AS (
  SELECT page_id, pos, text FROM firsts WHERE pos > s.pos AND pos < s."end" AND text <> '' AND {attribute('raw', 'itemprop')} = 'name'
  UNION ALL SELECT page_id, pos, text FROM firsts WHERE s IS NULL AND pos > nav.pos AND pos < nav."end" AND text <> '' AND tag IN ('a', 'span', 'li') AND NOT coalesce(following < "end", false))
SELECT page_id, coalesce(array_to_string(list(text ORDER BY pos) FILTER (WHERE text IS NOT NULL), '|'), '') AS breadcrumbs FROM pages LEFT JOIN crumbs USING (page_id) GROUP BY page_id"""


def _pairs(begins: str, question: str, answer: str) -> str:
    return f"""SELECT page_id, q.pos AS pos, q.text AS whole, arg_min(text, pos) FILTER (WHERE {question}) AS question, arg_min(text, pos) FILTER (WHERE {answer}) AS answer FROM (
    SELECT *, last_value(CASE WHEN {begins} THEN {{'pos': pos, 'end': "end", 'text': text}} END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM typed) WHERE pos < q."end" GROUP BY page_id, q"""


FAQ = f"""WITH {elements(f"tag IN ('details', 'summary') OR {ANY_ITEM}")}, typed AS (
  SELECT *, coalesce({attribute('raw', 'itemtype')}, '') AS type, coalesce({attribute('raw', 'itemprop')}, '') AS prop FROM own
), micro AS (SELECT page_id, pos, question, answer FROM ({_pairs("ends_with(type, '/Question')", "prop = 'name'", "prop = 'text' OR ends_with(type, '/Answer')")}) WHERE question <> '' AND answer <> ''
), folded AS (SELECT page_id, pos, question, trim(CASE WHEN starts_with(whole, question) THEN substr(whole, length(question) + 1) ELSE whole END) AS answer FROM ({_pairs("tag = 'details'", "tag = 'summary'", "false")}) WHERE question <> ''
), pairs AS (SELECT * FROM micro UNION ALL SELECT * FROM folded WHERE answer <> '' AND page_id NOT IN (SELECT page_id FROM micro))
SELECT page_id, n, question, substr(answer, 1, 500) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS n FROM pairs) WHERE n < 20"""

TABLES = f"""WITH {elements("tag IN ('table', 'tr', 'td', 'th')")}, placed AS (
  SELECT *, last_value(CASE WHEN tag = 'table' THEN {{'pos': pos, 'end': "end"}} END IGNORE NULLS) OVER ({UPTO}) AS t, last_value(CASE WHEN tag = 'tr' THEN {{'pos': pos, 'end': "end"}} END IGNORE NULLS) OVER ({UPTO}) AS r FROM own
), cells AS (SELECT page_id, pos, tag, text, tight, t.pos AS t, r FROM placed WHERE tag IN ('td', 'th') AND pos < t."end"
), heads AS (SELECT page_id, t, coalesce(list(tight ORDER BY pos) FILTER (WHERE tag = 'th'), []) AS headers FROM cells GROUP BY page_id, t
), rows_of AS (SELECT page_id, t, r.pos AS r, list(text ORDER BY pos) AS cells FROM cells WHERE pos < r."end" AND r.pos > t GROUP BY page_id, t, r.pos
), ranked_rows AS (SELECT *, dense_rank() OVER (PARTITION BY page_id ORDER BY t) - 1 AS n, row_number() OVER (PARTITION BY page_id, t ORDER BY r) - 1 AS nr FROM rows_of WHERE len(list_filter(cells, lambda x: x <> '')) > 0)
SELECT page_id, n, array_to_string(headers, '|') AS headers, nr AS "row", array_to_string(cells, '|') AS cells FROM ranked_rows JOIN heads USING (page_id, t) WHERE n < 5 AND nr < 30"""

SECTIONS = f"""WITH {elements("tag IN ('h2', 'h3', 'p', 'li', 'td')")}, counted AS (
  SELECT *, tag IN ('h2', 'h3') AS heading, sum(CASE WHEN tag IN ('h2', 'h3') THEN 1 ELSE 0 END) OVER ({UPTO}) AS sid FROM own WHERE NOT noise
), each_one AS (SELECT page_id, sid, max(CASE WHEN heading THEN substr(regexp_replace(trim(lower(tight_clean)), '\\s+', '_', 'g'), 1, 40) END) AS name, array_to_string(list(clean ORDER BY pos) FILTER (WHERE NOT heading AND clean <> ''), ' ') AS text
  FROM counted GROUP BY page_id, sid)
SELECT page_id, coalesce(name, 'introduction') AS key, CAST(min(sid) AS BIGINT) AS pos, arg_max(text, sid) AS text FROM each_one WHERE text <> '' GROUP BY page_id, 2"""


def _inside(*tags: str) -> str:
    return within(f"kind = 'open' AND {among('tag', tags)}")


MAIN_TEXT = f"""WITH {BOUNDED}, flagged AS (
  SELECT *, {within(is_noise((*lx.NOISE_TAGS, *m.ASIDE_TAGS), (*lx.NOISE_CLASSES, *m.ASIDE_NAMES), (*lx.NOISE_IDS, *m.ASIDE_NAMES)))} AS aside, {_inside('a')} AS linked, {_inside('h1', 'h2', 'h3', 'h4', 'h5', 'h6')} AS heading, {_inside('td', 'th')} AS cell,
    sum(CASE WHEN kind IN ('open', 'close') AND {among('tag', m.BLOCKS)} THEN 1 ELSE 0 END) OVER ({UPTO}) AS block, len(regexp_extract_all(text, '\\S+')) AS words FROM bounded
), blocks AS (SELECT page_id, block AS pos, array_to_string(list(text ORDER BY pos), ' ') AS text, sum(words) AS words, sum(CASE WHEN linked THEN words ELSE 0 END) AS links, max(heading) AS heading, max(cell) AS cell FROM flagged WHERE text <> '' AND NOT aside GROUP BY page_id, block
), shares AS (SELECT *, links / words AS share FROM blocks
), beside AS (SELECT *, coalesce(lag(words) OVER o, 0) AS w0, coalesce(lead(words) OVER o, 0) AS w2, coalesce(lag(share) OVER o, 0) AS s0 FROM shares WINDOW o AS (PARTITION BY page_id ORDER BY pos)
), judged AS (SELECT *, share <= 1.0::DOUBLE / 3 AS low FROM beside
), bodies AS (SELECT *, CASE WHEN cell THEN low ELSE low AND CASE WHEN s0 <= 0.555556::DOUBLE THEN words > 16 OR w2 > 15 OR w0 > 4 ELSE words > 40 OR w2 > 17 END END AS body FROM judged
), told AS (SELECT *, CASE WHEN heading THEN low AND coalesce(first_value(CASE WHEN NOT heading THEN body END IGNORE NULLS) OVER ({AFTER}), false) ELSE body END AS content FROM bodies
), chosen AS (SELECT page_id, pos, text FROM (SELECT *, CASE WHEN max(content) OVER (PARTITION BY page_id) THEN content ELSE low END AS kept FROM told) WHERE kept)
SELECT page_id, sha256(coalesce(array_to_string(list(text ORDER BY pos) FILTER (WHERE text IS NOT NULL), chr(10)), '')) AS text_hash, length(coalesce(array_to_string(list(text ORDER BY pos) FILTER (WHERE text IS NOT NULL), chr(10)), '')) AS n_chars
FROM pages LEFT JOIN chosen USING (page_id) GROUP BY page_id"""
