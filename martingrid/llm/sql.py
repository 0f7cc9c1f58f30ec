"""DuckDB SQL for the operators that SQL can express."""

from martingrid.llm import chat, jaccard, quality

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Documents are told apart by row, for texts and ids may repeat.
QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
each AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
win AS (SELECT r, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS s
        FROM each WINDOW o AS (PARTITION BY r ORDER BY i)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win WHERE s IS NOT NULL) WHERE c > 1),
rep AS (SELECT r, sum(least({quality.WINDOW}, coalesce(nxt - i, {quality.WINDOW})))::BIGINT AS n
        FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM dup) GROUP BY r),
c AS (SELECT r, doc_id, text, len(w)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
n AS (SELECT c.*, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM c LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words * {quality.MAX_SYMBOLS_PER_TEN}
       OR (n_dup_lines >= {quality.MIN_DUP_LINES} AND n_dup_lines * 10 > len(lines) * {quality.MAX_DUP_LINES_PER_TEN})
       OR word_chars < n_words * {quality.MIN_WORD_CHARS} OR (strlen(text) * 2 < length(text) * 3 AND word_chars > n_words * {quality.MAX_WORD_CHARS})) AS kept
FROM b"""

_ESC = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
CHAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
m AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = role, false) AS same FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = '{chat.LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{chat.LOSS_ROLE}'), '')) AS loss_sha256,
  sum(length({_ESC.format('text')}) + CASE WHEN same THEN {len(chat.SEPARATOR)}
      ELSE {len(chat.START) + 1 + len(chat.END)} + length(replace({_ESC.format('role')}, chr(10), '{chat.NEWLINE}')) END)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id"""

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Different sets are compared once; documents come back by their set.
JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("text", _LOW)} AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {jaccard.WORDS} THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {jaccard.WORDS - 2}), lambda i: array_to_string(w[i:i + {jaccard.WORDS - 1}], ' ')))) END AS s FROM d),
k AS (SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, chr(10))) AS k, s FROM g),
one AS (SELECT k, any_value(n) AS n, any_value(s) AS s, min(doc_id) AS low FROM k WHERE n > 0 GROUP BY k),
item AS (SELECT k, n, unnest(s) AS x FROM one),
link AS (SELECT a.k AS a, b.k AS b FROM item a JOIN item b ON a.x = b.x AND a.k < b.k AND 100 * least(a.n, b.n) >= {jaccard.PERCENT} * greatest(a.n, b.n)
         GROUP BY a.k, b.k HAVING 100 * count(*) >= {jaccard.PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT k AS a, k AS b FROM one UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
comp AS (SELECT a AS k, min(low) AS component_id FROM reach JOIN one ON reach.b = one.k GROUP BY a)
SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id FROM k LEFT JOIN comp USING (k)"""
