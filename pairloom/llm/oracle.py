"""SQL of the queries that DuckDB can express, over the same tables."""

from __future__ import annotations

from pairloom.llm.decontaminate import COVER, LITERALS, MARKS, NAME, NUMBER, RUN, UNIT, UNITS, WINDOW
from pairloom.llm.quality import BOILERPLATE, MAX_LOSS, MENU_LINE, MIN_WORDS, SENTENCE_ENDS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


BLANKS = r"'[\x20\x09-\x0D]'"

OP7 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped AS (
  SELECT *, regexp_replace(role, '<(~*)\|', '<\1~|', 'g') AS r, regexp_replace(text, '<(~*)\|', '<\1~|', 'g') AS t FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + length(t) + length('<|turn|><|text|><|end|>')) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

_PHRASES = " OR ".join(f"contains(lower(line), {_text(p)})" for p in BOILERPLATE)
_ENDS = ", ".join(map(_text, SENTENCE_ENDS))
OP8 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, {BLANKS}, '', 'g') <> '') AS lines
  FROM docs
),
places AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM split WHERE len(w) >= 3),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM places),
repeated AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM windows, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY r
),
one_line AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS at_line FROM split),
judged AS (
  SELECT r, line, at_line,
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) * 10 > length(line)
    OR length(regexp_replace(line, '[^!]', '', 'g')) * 10 > length(line)
    OR NOT (right(rtrim(regexp_replace(line, {BLANKS}, ' ', 'g')), 1) IN ({_ENDS})
      OR contains(line, '. ') OR contains(line, '! ') OR contains(line, '? '))
    OR length(regexp_replace(line, '[^|»›•·]', '', 'g')) * 4 > length(regexp_replace(line, '[^ \t]', '', 'g')) + 1
    OR (length(line) <= 60 AND regexp_matches(line, {_text(MENU_LINE)}))
    OR {_PHRASES} AS bad
  FROM one_line
),
lines_of AS (
  SELECT r, count(*) FILTER (WHERE bad) AS n_removed,
    coalesce(sum(length(regexp_replace(line, {BLANKS}, '', 'g'))) FILTER (WHERE NOT bad), 0) AS left_chars
  FROM judged GROUP BY r
),
counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, {BLANKS}, '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(left_chars, 0) AS left_chars
  FROM split LEFT JOIN repeated USING (r) LEFT JOIN lines_of USING (r)
),
based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND CASE WHEN word_chars > 0 THEN 1 - CAST(left_chars AS DOUBLE) / word_chars ELSE 0 END <= {MAX_LOSS} AS kept,
  n_lines, n_removed
FROM based
"""

_MARKS = NUMBER + UNIT + NAME
# Digits with single dots or commas between them.
NUMBER_RUN = r"\p{N}+(?:[.,]\p{N}+)*"
# Without look-behind a name is found with the character before it, so names side by side
# need a second pass.
_NAMES = rf"'([\p{{L}}\p{{N}},] )(\p{{Lu}}\p{{Ll}}[\p{{L}}\p{{M}}]*)', '\1{NAME}\2', 'g'"


def _marked(text: str) -> str:
    """SQL of the marked text, see ``decontaminate.marked``; a unit ends where letters end."""
    plain = f"regexp_replace(coalesce({text}, ''), '[{MARKS}]', ' ', 'g')"
    names = f"regexp_replace(regexp_replace({plain}, {_NAMES}), {_NAMES})"
    units = rf"regexp_replace({names}, '({NUMBER_RUN}) ?({UNITS})([^\p{{L}}\p{{M}}]|$)', '\1 {UNIT}\2 \3', 'g')"
    return rf"regexp_replace({units}, '({NUMBER_RUN})', ' {NUMBER}\1 ', 'g')"


def _tokens(table: str, key: str) -> str:
    literal = r"[\p{L}\p{M}]+"
    return rf"""
  SELECT {key}, text, regexp_extract_all({_marked("text")}, '[{_MARKS}](?:{literal}|{NUMBER_RUN})|{literal}') AS v FROM {table}"""


OP9 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
distinct_items AS (SELECT row_number() OVER () AS item, text, list_sort(list_distinct(list(item_id))) AS ids FROM benchmark WHERE text IS NOT NULL GROUP BY text),
doc_values AS ({_tokens("docs", "r")}), item_values AS ({_tokens("distinct_items", "item")}),
doc_tokens AS (SELECT r, v, list_transform(v, lambda x: CASE WHEN x[1] IN ('{NUMBER}', '{UNIT}', '{NAME}') THEN x[1] ELSE lower(x) END) AS t FROM doc_values),
item_tokens AS (SELECT item, v, list_transform(v, lambda x: CASE WHEN x[1] IN ('{NUMBER}', '{UNIT}', '{NAME}') THEN x[1] ELSE lower(x) END) AS t FROM item_values),
doc_windows AS (SELECT r, v, i, array_to_string(t[i:i + {WINDOW - 1}], ' ') AS w
  FROM (SELECT *, unnest(range(1, len(t) - {WINDOW - 2})) AS i FROM doc_tokens)),
item_windows AS (SELECT * FROM (SELECT item, v, i, t[i:i + {WINDOW - 1}] AS part, array_to_string(t[i:i + {WINDOW - 1}], ' ') AS w
  FROM (SELECT *, unnest(range(1, len(t) - {WINDOW - 2})) AS i FROM item_tokens))
  WHERE len(list_filter(part, lambda x: x NOT IN ('{NUMBER}', '{UNIT}', '{NAME}'))) >= {LITERALS}),
totals AS (SELECT item, count(*) AS total FROM item_windows GROUP BY item),
hits AS (SELECT r, item, b.i AS at_item, d.i - b.i AS alignment, d.v[d.i:d.i + {WINDOW - 1}] AS dv, b.v[b.i:b.i + {WINDOW - 1}] AS bv
  FROM doc_windows d JOIN item_windows b USING (w)),
slots AS (SELECT r, item, alignment, at_item, lower(unnest(bv)) AS item_value, lower(unnest(dv)) AS doc_value FROM hits),
counted AS (SELECT r, item, alignment, item_value, doc_value, count(*) AS n FROM slots WHERE item_value[1] IN ('{NUMBER}', '{UNIT}', '{NAME}') GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY r, item, alignment, item_value ORDER BY n DESC, doc_value) AS place FROM counted),
broken AS (SELECT DISTINCT s.r, s.item, s.alignment, s.at_item FROM slots s JOIN placed p USING (r, item, alignment, item_value, doc_value) WHERE place > 1),
covered AS (SELECT r, item, count(DISTINCT at_item) AS n FROM hits ANTI JOIN broken USING (r, item, alignment, at_item) GROUP BY r, item),
contained AS (SELECT r, ids, n, total FROM covered JOIN totals USING (item) JOIN distinct_items USING (item)
  WHERE n >= least({RUN}, greatest(least(2, total), ceil(total * {COVER}::DOUBLE)))),
found AS (SELECT r, list_sort(list_distinct(flatten(list(ids)))) AS item_ids, CAST(sum(n) AS BIGINT) AS n_windows, max(n / total) AS cover FROM contained GROUP BY r)
SELECT doc_id, n_windows IS NOT NULL AS contaminated, coalesce(item_ids, []) AS item_ids, coalesce(n_windows, 0) AS n_windows, coalesce(cover, 0.0::DOUBLE) AS cover
FROM docs LEFT JOIN found USING (r)
"""

# Deleting one code point tells all pairs one edit apart: a hole is what is left of a word and where.
OP11 = r"""
WITH RECURSIVE
bits AS (SELECT i, i::BIGINT AS v, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(v ORDER BY i) AS entries FROM bits WHERE step = 8),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
counted AS (SELECT doc, run, count(*) AS n, hex(encode(doc || ':' || run)) AS digits FROM runs GROUP BY doc, run),
hashed AS (SELECT run, n, length(run) AS size, xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(range(1, length(digits), 2), lambda i: ('0x' || substr(digits, i, 2))::BIGINT)),
  lambda state, byte: xor(state >> 8, entries[(xor(state, byte) & 255) + 1]))) AS h FROM counted, crc),
damaged AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % size)::BIGINT) || substr(run, (h % size)::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n, length(word) AS size FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS (SELECT word, n, i AS at, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT *, unnest(range(1, size + 1)) AS i FROM words)),
pairs AS (
  SELECT DISTINCT a.word AS word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT DISTINCT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.head || h.tail
  UNION SELECT DISTINCT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.head || h.tail),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -near_n, near := encode(near))) AS best FROM pairs GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.best.less >= 2 * w.n THEN decode(b.best.near) END AS form,
  CASE WHEN -b.best.less >= 2 * w.n THEN -b.best.less END AS form_n FROM words w LEFT JOIN best b USING (word)),
walk AS (SELECT word, word AS root FROM formed UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.root WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN formed f ON f.word = walk.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""

OP12 = r"""
WITH RECURSIVE
split AS (SELECT doc_id, list_filter(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
shingled AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [list_aggregate(words, 'string_agg', ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3])) END AS own FROM split),
sized AS (SELECT doc_id, own, len(own) AS n FROM shingled),
exploded AS (SELECT DISTINCT doc_id, n, unnest(own) AS shingle FROM sized),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS a_n, b.n AS b_n, count(*) AS shared FROM exploded a JOIN exploded b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * shared >= 80 * (a_n + b_n - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS to_id FROM sized UNION SELECT r.doc_id, w.b FROM reached r JOIN ways w ON w.a = r.to_id),
least AS (SELECT doc_id, min(to_id) AS component_id FROM reached GROUP BY doc_id)
SELECT s.doc_id, s.n AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM sized s JOIN least l USING (doc_id)
"""

ORACLE = {
    "op7_chat_format": OP7, "op8_quality_rules": OP8, "op9_decontamination": OP9, "op11_spelling_variants": OP11, "op12_minhash_dedup": OP12,
}
