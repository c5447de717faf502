"""The queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from assayer.llm import audit, chat, decontaminate, hardneg, phrases, secrets, urls, warc
from assayer.llm.text import WORD


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_MEASURED = f"""
texts AS (SELECT row_number() OVER () AS rid, * FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
tokens AS (SELECT *, regexp_extract_all(t, {_text(WORD)}) AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_text(WORD)})) AS ls FROM texts),
grams AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM tokens)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
repeated AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, range(0, 5) r(j) GROUP BY rid),
measured AS (SELECT tokens.*, len(ws) AS n_words,
    length(t) - length(regexp_replace(t, '[^\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    length(regexp_replace(t, '[^!]', '', 'g')) AS n_shouts,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower
    FROM tokens LEFT JOIN repeated USING (rid)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_symbols * 10 > n_words OR n_shouts * 5 > n_words OR n_upper > n_lower OR n_dup_lines * 10 > n_lines * 3
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS failed FROM measured)"""

QUALITY = f"""
WITH {_MEASURED}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT failed AS kept
FROM judged"""

_K = f"1 / least({urls.MOST_RHO}, greatest({urls.LEAST_RHO}, rho)) - 1"


def _strength(level: str) -> str:
    return f"""(SELECT CASE WHEN k = 0 OR n <= k OR spread <= 0 THEN 1 / {urls.MOST_RHO} - 1 ELSE {_K} END FROM (
        SELECT *, (s / spread - k) / (n - k) AS rho FROM (SELECT sum(c.n * pow(c.bad / c.n - p, 2)) AS s, count(*) AS k, sum(c.n) AS n, any_value(p * (1 - p)) AS spread
        FROM {level} c, overall WHERE c.n > 0)))"""


def _rule_sql(column: str) -> str:
    cases = []
    for rule in sorted(urls.RULES, key=lambda r: -len(r.pattern)):
        host, _, path = rule.pattern.partition("/")
        value = rule.pattern if column == "rule" else rule.verdict
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{value}'")
    return f"CASE {' '.join(cases)} ELSE {'NULL' if column == 'rule' else 'own'} END"


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
URLS = f"""
WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_AZ}) AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
known AS (SELECT doc_id AS page_id, max((toxic = 1 OR quality = 0)::INT) AS bad FROM labels GROUP BY doc_id),
hosts AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad,
    array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix
    FROM parts LEFT JOIN known USING (page_id) GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
overall AS (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2.0::DOUBLE) AS p FROM hosts),
k AS (SELECT {_strength('suffixes')} AS ks, {_strength('domains')} AS kd, {_strength('hosts')} AS kh),
by_suffix AS (SELECT suffix, (bad + ks * p) / (n + ks) AS r FROM suffixes, k, overall),
by_domain AS (SELECT domain, (bad + kd * r) / (n + kd) AS r FROM domains JOIN by_suffix USING (suffix), k),
by_host AS (SELECT host, (bad + kh * r) / (n + kh) AS m, n + kh AS both_ FROM hosts JOIN by_domain USING (domain), k),
verdicts AS (SELECT host, CASE WHEN m - {urls.SIGMAS} * sqrt(m * (1 - m) / (both_ + 1)) > {urls.LIMIT} THEN 'block' ELSE 'allow' END AS own FROM by_host)
SELECT page_id, host, path, {_rule_sql('rule')} AS rule, {_rule_sql('verdict')} AS verdict FROM parts JOIN verdicts USING (host)"""


def _spans(rank: int, pattern: str, name: str, keep: str = "TRUE", source: str = "texts") -> str:
    """Spans of a pattern from the lengths of what stands between its matches."""
    return f"""{name} AS (SELECT rid, {rank} AS rank, hit, extra, start, start + length(hit) AS stop FROM (
    SELECT rid, hit, extra, sum(length(piece) + coalesce(length(before), 0)) OVER (PARTITION BY rid ORDER BY i) AS start FROM (
    SELECT rid, i, pieces[i] AS piece, hits[i] AS hit, extras[i] AS extra, hits[i - 1] AS before FROM (
    SELECT rid, regexp_split_to_array(t, {_text(pattern)}) AS pieces, regexp_extract_all(t, {_text(pattern)}) AS hits,
        regexp_extract_all(t, {_text(pattern)}, {2 if rank == 0 else 0}) AS extras FROM {source} WHERE regexp_matches(t, {_text(pattern)})),
    generate_series(1, len(hits)) g(i))) WHERE {keep})"""


def _fits(*patterns: str) -> str:
    """Whether a pattern fits; possessive ones are written plainly, which fits the same here."""
    return "(" + " OR ".join(f"regexp_matches(hit, {_text(p.replace('++', '+'))})" for p in patterns) + ")"


def _blanked() -> str:
    out = "hit"
    for pattern, length in secrets.MARKS.items():
        out = f"regexp_replace({out}, {_text(pattern)}, '{' ' * length}', 'g')"
    return out


_WHOLE, _BESIDE = secrets.ALLOWED[: secrets.WHOLE], secrets.ALLOWED[secrets.WHOLE :]
SECRETS = f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{_spans(0, secrets.ASSIGN, 'assign', 'length(extra) >= 6')},
{_spans(1, secrets.ACCESS, 'access_')},
{_spans(2, secrets.HEX, 'hexes')},
{_spans(3, secrets.CANDIDATE, 'candidates')},
blanked AS (SELECT row_number() OVER () AS rid, rid AS doc, start AS origin, {_blanked()} AS t
    FROM candidates WHERE NOT {_fits(*_WHOLE, secrets.MARKED)} AND {_fits(*_BESIDE)}),
{_spans(3, secrets.CANDIDATE, 'runs', source='blanked')},
rests AS (SELECT doc, origin + start + head AS start, substr(hit, head + 1) AS hit
    FROM (SELECT *, length(regexp_extract(hit, {_text(secrets.HEAD.replace('++', '+'))})) AS head FROM runs JOIN blanked USING (rid))),
suspects AS (SELECT row_number() OVER () AS sid, *, CASE WHEN regexp_full_match(hit, '[0-9a-fA-F]+') THEN {secrets.LIMITS['hex']}
    WHEN regexp_full_match(hit, '[A-Z0-9]+') THEN {secrets.LIMITS['upper']} ELSE {secrets.LIMITS['mixed']} END::DOUBLE AS bits
    FROM (SELECT rid, start, hit FROM candidates WHERE NOT {_fits(*secrets.ALLOWED)}
        UNION ALL SELECT doc, start, hit FROM rests WHERE length(hit) >= {secrets.WINDOW} AND NOT {_fits(*_WHOLE)})),
slides AS (SELECT sid, i, substr(hit, i + 1, {secrets.WINDOW}) AS part FROM suspects, generate_series(0, length(hit) - {secrets.WINDOW}) g(i)),
counted AS (SELECT sid, i, ch, count(*) AS c FROM (SELECT sid, i, unnest(string_split(part, '')) AS ch FROM slides) GROUP BY ALL),
sums AS (SELECT sid, i, sum(c * log2(c)) AS s FROM counted GROUP BY ALL),
random_ AS (SELECT sid, min(i) AS first_, max(i) AS last_ FROM sums JOIN suspects USING (sid)
    WHERE round(s, 9) <= round((log2({secrets.WINDOW}.0) - bits) * {secrets.WINDOW}, 9) GROUP BY sid),
entropy AS (SELECT rid, 3 AS rank, start + first_ AS start, start + last_ + {secrets.WINDOW} AS stop FROM random_ JOIN suspects USING (sid)),
every AS (SELECT rid, rank, start, stop FROM assign UNION ALL SELECT rid, rank, start, stop FROM access_
    UNION ALL SELECT rid, rank, start, stop FROM hexes UNION ALL SELECT * FROM entropy),
named AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][rank + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS span FROM every),
joined AS (SELECT rid, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM named GROUP BY rid)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN joined USING (rid)"""

_N = decontaminate.WINDOW
CONTAMINATION = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_text(decontaminate.WORD)}) AS ws FROM documents),
items AS (SELECT item_id::VARCHAR AS item, ws, least(len(ws), {_N}) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_text(decontaminate.WORD)}) AS ws FROM benchmark) WHERE len(ws) > 0),
grams AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM items, generate_series(1, len(ws) - n + 1) s(i)),
windows AS (SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM docs, (SELECT DISTINCT n FROM items), generate_series(1, len(ws) - n + 1) s(i)),
found AS (SELECT rid, i, n, item FROM windows JOIN grams USING (n, g)),
hit AS (SELECT rid, count(DISTINCT i + j) AS n_hit FROM found, generate_series(0, {_N - 1}) s(j) WHERE j < n GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)"""


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in chat.CONTROL:
        out = f"replace({out}, '{control}', '\\{control}')"
    return out


_MARKED = sum(map(len, chat.MARKS))
CHATS = f"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
    UNION ALL SELECT -7, i, r, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r))
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
    coalesce(sum(length(t)) FILTER (role = '{chat.TRAINED}'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = '{chat.TRAINED}'), '')) AS loss_sha256,
    sum({_MARKED} + length(replace({_escaped('role')}, ':', '\\:')) + length({_escaped('t')}))::BIGINT AS formatted_chars
FROM rows_ GROUP BY conv_id"""

ARCHIVE = f"""
WITH payloads AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT digest, min(page_id) AS first_ FROM payloads WHERE bytes >= {warc.MIN_REVISIT} GROUP BY digest)
SELECT page_id, bytes::BIGINT AS payload_bytes, payloads.digest AS payload_digest, CASE WHEN coalesce(page_id, 9223372036854775807) > first_ THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN coalesce(page_id, 9223372036854775807) > first_ THEN first_ END AS refers_to FROM payloads LEFT JOIN firsts USING (digest)"""

_S = phrases.SIZE
PHRASES = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_text(WORD)}) AS ws FROM documents),
windows AS (SELECT rid, doc_id, i, array_to_string(ws[i:i + {_S - 1}], ' ') AS g FROM docs, generate_series(1, len(ws) - {_S - 1}) s(i)),
late AS (SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS first_ FROM windows) WHERE first_ < doc_id),
gone AS (SELECT DISTINCT rid, i + j AS p FROM late, generate_series(0, {_S - 1}) s(j)),
each AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM docs),
left_ AS (SELECT rid, string_agg(w, ' ' ORDER BY p) AS kept FROM each ANTI JOIN gone USING (rid, p) GROUP BY rid),
removed AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN left_ USING (rid) LEFT JOIN removed USING (rid)"""

#: Filters by the position of their letter in an order; a document falls at the first letter it fails.
AUDIT = f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_text(WORD)}) AS ws FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_ FROM texts GROUP BY t),
known AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(ws) < {audit.LEAST_WORDS} THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(ws)) < {audit.LEAST_DISTINCT} * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {audit.MOST_UPPER} * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[{audit.SYMBOLS}]') THEN 'D' ELSE '' END
    || CASE WHEN texts.doc_id > first_ THEN 'E' ELSE '' END AS fails
    FROM texts JOIN firsts USING (t) LEFT JOIN known ON texts.doc_id = known.doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
falls AS (SELECT *, coalesce(list_min(list_transform(string_split(fails, ''), lambda x: CASE WHEN x = '' THEN 9 ELSE strpos(o, x) END)), 9) AS falls_at FROM cells, orders),
steps AS (SELECT part, o, step, substr(o, step::INT, 1) AS own, coalesce(sum(n) FILTER (falls_at > step), 0) AS kept, coalesce(sum(n) FILTER (falls_at = step), 0) AS removed,
    coalesce(sum(n) FILTER (falls_at < step AND contains(fails, substr(o, step::INT, 1))), 0) AS redundant, coalesce(sum(n) FILTER (fails = substr(o, step::INT, 1)), 0) AS unique_fails,
    coalesce(sum(good) FILTER (falls_at = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (falls_at = step), 0) AS toxic_lost
    FROM falls, generate_series(1, 5) s(step) GROUP BY part, o, step)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM steps"""

_H = hardneg
HARD_NEGATIVES = f"""
WITH sound AS (SELECT row_number() OVER () AS rid, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({_H.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.rid AS anchor, a.id AS anchor_id, r.rid AS other, r.id AS other_id, a.label = r.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.v, r.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0)::BIGINT AS score
    FROM sound a JOIN sound r ON a.rid <> r.rid WHERE a.id % 100 = 0),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id NULLS LAST, other) AS k FROM scored WHERE same) WHERE k <= {_H.POSITIVES}),
ranked AS (SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, n.other_id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY n.score DESC, n.other_id NULLS LAST, n.other) AS rank
    FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same AND {_H.LOW} * p.score <= 100 * n.score AND 100 * n.score <= {_H.HIGH} * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= {_H.NEGATIVES}"""
