"""The SQL that says the same as a registered query, where SQL can."""

from __future__ import annotations

from parlance.llm import chat, quality

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_PLAIN = r"list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"


def _runs(words: str, least: int) -> str:
    """Five-word shingles of a list; with least = 1 a shorter text is one shingle."""
    short = f"CASE WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE [] END" if least == 1 else "[]"
    return f"CASE WHEN len({words}) < 5 THEN {short} ELSE [array_to_string({words}[i:i + 4], ' ') FOR i IN range(1, len({words}) - 3)] END"


DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_runs('w', 5)} AS g FROM (SELECT doc_id, {_PLAIN} AS w FROM documents)),
b AS (SELECT item_id, g, len(g) AS m FROM (SELECT DISTINCT item_id, {_runs('w', 5)} AS g FROM (SELECT item_id, {_PLAIN} AS w FROM benchmark)) WHERE len(g) > 0),
bs AS (SELECT item_id, m, h, count(*) AS c FROM (SELECT item_id, m, unnest(g) AS h FROM b) GROUP BY ALL),
hits AS (SELECT doc_id, n, item_id, m, p, h, c FROM (SELECT doc_id, len(g) AS n, unnest(g) AS h, generate_subscripts(g, 1) - 1 AS p FROM d) JOIN bs USING (h)),
starts AS (SELECT DISTINCT doc_id, item_id, greatest(0, least(p, n - m)) AS s FROM hits),
per AS (SELECT doc_id, item_id, s, least(n, m) + m AS whole, h, least(count(*), any_value(c)) AS k FROM starts JOIN hits USING (doc_id, item_id) WHERE p >= s AND p < s + m GROUP BY ALL),
shared AS (SELECT doc_id, item_id, s, whole, sum(k)::BIGINT AS k FROM per GROUP BY ALL),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items, max(k / (whole - k)) AS similarity FROM shared WHERE 9 * k >= 4 * whole GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items, round(coalesce(similarity, 0), 6) AS similarity FROM documents LEFT JOIN found USING (doc_id)"""

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_found = lambda pattern, group, least: f"len(list_filter(regexp_extract_all(coalesce(text, ''), '{pattern}', {group}), lambda x: length(x) >= {least}))"
SECRET_COUNTS = f"SELECT doc_id, {_found(_ASSIGN, 1, 12)}::BIGINT AS n_assign, {_found('AKIA[A-Z0-9]+', 0, 18)}::BIGINT AS n_access, {_found('[0-9a-f]+', 0, 16)}::BIGINT AS n_hex FROM documents"

NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, list_distinct({_runs('w', 1)}) AS g FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
sh AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM d), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 5 * c >= 4 * (na + nb - c)), e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.b FROM reach r JOIN e ON r.y = e.a),
cls AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x), deg AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a),
cp AS (SELECT doc_id, CASE WHEN len(g) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY list_sort(g)) END AS n_copies FROM d)
SELECT doc_id, class_id, n_copies, coalesce(n_links, 0) AS n_links FROM cls JOIN cp USING (doc_id) LEFT JOIN deg USING (doc_id)"""

REPEATED_PASSAGES = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
dup AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, s + unnest(range(20)) AS p FROM dup) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id)"""

_quoted = "|".join("".join("\\" + c if not c.isalnum() and c not in "<>/_" else c for c in x) for x in chat.CONTROLS)
_escaped = lambda c: f"length({c}) + length({c}) - length(replace({c}, '\\', '')) + len(regexp_extract_all({c}, '{_quoted}'))"
CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum({len(chat.TURN + chat.BODY + chat.END)} + {_escaped('role')} + {_escaped('text')})::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""

_listed = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
_ends = "right(rtrim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) IN (" + _listed(quality.ENDS) + ")"
QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
ln AS (SELECT doc_id, i, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
f AS (SELECT *, len(ws) AS n, len(ws) < {quality.SHORT_LINE} AND NOT ({_ends}) AS frag, count(*) OVER (PARTITION BY doc_id) = 1 AS lone FROM ln WHERE len(ws) > 0),
nb AS (SELECT *, coalesce(lag(frag) OVER o, false) OR coalesce(lead(frag) OVER o, false) AS near FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, n, line, CASE WHEN NOT regexp_matches(line, '[\p{{L}}\p{{N}}]') OR (n >= 3 AND 2 * len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&|<>!?~^=_]{{2,}}'))) >= n) THEN 'p'
  WHEN NOT lone AND n >= 3 AND 3 * len(list_filter(ws, lambda x: x IN ({_listed(sorted(quality.SEPARATORS))}))) >= n THEN 'n' WHEN NOT lone AND n < {quality.SHORT_LINE} AND lower(trim(line, ' ' || chr(9) || chr(13) || '.:|»›>')) IN ({_listed(sorted(quality.MENU))}) THEN 'n'
  WHEN NOT lone AND frag AND near THEN 'p' WHEN regexp_matches(line, '\b({'|'.join(quality.PHRASES)})\b', 'i') THEN 'b' END AS rule FROM nb),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(rule) AS n_lines_removed, coalesce(sum(n) FILTER (rule IS NOT NULL), 0)::BIGINT AS n_words_removed, count_if(rule = 'p') AS by_punctuation, count_if(rule = 'n') AS by_navigation, count_if(rule = 'b') AS by_boilerplate FROM r GROUP BY doc_id),
win AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, w[s:s + 4]) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS s FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, s + unnest(range(5)) AS p FROM win WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(n_words_removed, 0) AS n_words_removed, coalesce(by_punctuation, 0) AS by_punctuation, coalesce(by_navigation, 0) AS by_navigation, coalesce(by_boilerplate, 0) AS by_boilerplate FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed, NOT (n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words) AND n_words_removed <= {quality.MOST_LOST} * n_words AS kept FROM m"""

FILTER_AUDIT = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents), l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (d.doc_id > min(d.doc_id) OVER (PARTITION BY t))::INT AS mask FROM d LEFT JOIN l USING (doc_id)),
f AS (SELECT unnest(range(5)) AS f), orders AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT array_to_string([chr((65 + x)::INT) FOR x IN o], '') AS filter_order, k::INT AS step, o[k] AS f, 1 << o[k]::INT AS bit, coalesce(list_sum([1 << x::INT FOR x IN o[1:k - 1]]), 0)::INT AS before FROM orders, (SELECT unnest(range(1, 6)) AS k)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS removed, coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""

_crc = "xor(4294967295, list_reduce(list_prepend(4294967295, [ascii(x) FOR x IN string_split(conv_id::VARCHAR, '')]), lambda c, b: xor(c >> 8, list_reduce(list_prepend(xor(c, b) & 255, range(8)), lambda t, _: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END))))"
TRIE = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY pos) AS own, {_crc} % 9 AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS path FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, d, md5(path[1:d]::VARCHAR) || d AS node, md5(path[1:d - 1]::VARCHAR) || (d - 1) AS above, CASE WHEN d > 0 THEN strlen(path[d].t) ELSE 0 END AS bytes, d = len(path) AS last FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM r)),
n AS (SELECT node, d, min(conv_id) AS conv_id, any_value(above) AS above, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM p GROUP BY node, d),
kids AS (SELECT above AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY above),
below AS (SELECT up.node, sum(n.saved) AS saved_tokens, count(*) FILTER (kids.node IS NULL) AS n_leaves FROM n JOIN p up ON up.conv_id = n.conv_id AND up.d <= n.d LEFT JOIN kids ON kids.node = n.node GROUP BY up.node)
SELECT n.conv_id, n.d AS depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256 FROM n JOIN below USING (node) LEFT JOIN kids USING (node) LEFT JOIN n a ON n.above = a.node AND n.d > 0"""
