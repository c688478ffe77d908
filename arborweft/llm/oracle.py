"""SQL for DuckDB that gives the rows of the operators' queries, where SQL can."""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
STRIP = r"regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
#: In the order of chat.CONTROL.
_MARKS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>"]


def _escaped(x: str) -> str:
    out = rf"replace({x}, '\', '\\')"
    for m in _MARKS:
        out = rf"replace({out}, '{m}', '{m[0]}\{m[1:]}')"
    return out


OP3 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(array_slice(b, i, i + 199)) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 198)) AS i FROM d WHERE n >= 200)),
s AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
k AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM s),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM k),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 199 AS z FROM g GROUP BY doc_id, run),
t AS (SELECT doc_id, sum(z - a + 1) AS gone, count(*) AS spans FROM r GROUP BY doc_id),
cuts AS (
  SELECT doc_id, 1 + coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a - 1 AS l FROM r
  UNION ALL SELECT d.doc_id, coalesce(max(z), 0) + 1, any_value(n) FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(hex(b), CAST(2 * f - 1 AS BIGINT), CAST(2 * greatest(0, l - f + 1) AS BIGINT)), '' ORDER BY f) AS x FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(x)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) JOIN kept USING (doc_id)
"""

OP4 = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE
    WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: list_extract(w, i) || ' ' || list_extract(w, i + 1) || ' ' || list_extract(w, i + 2))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t)),
n AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.c + b.c - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS s, doc_id AS z FROM t UNION SELECT r.s, e.y FROM r JOIN e ON e.x = r.z)
SELECT t.doc_id, coalesce(any_value(n.c), 0) AS n_shingles, min(r.z) AS component_id FROM t JOIN r ON r.s = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id GROUP BY t.doc_id
"""

OP6 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, translate({STRIP}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
flagged AS (SELECT keyed.*, common.k IS NOT NULL AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""

OP7 = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS s FROM pages),
best AS (SELECT s, max(page_id) AS m FROM d GROUP BY s),
bits AS (SELECT page_id, n, m, (SELECT string_agg(b, '' ORDER BY i) FROM (
    SELECT i, right('0000' || bin(strpos('0123456789abcdef', substr(s, i, 1)) - 1), 4) AS b FROM range(1, 41) t(i))) AS bits
  FROM d JOIN best USING (s))
SELECT page_id, n AS payload_bytes, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1), '' ORDER BY i) FROM (
    SELECT i, CAST(list_sum([CAST(substr(bits, i * 5 + j + 1, 1) AS INT) * CAST(pow(2, 4 - j) AS INT) for j in range(5)]) AS BIGINT) AS v FROM range(32) t(i))) AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = m THEN NULL ELSE m END AS refers_to
FROM bits
"""

OP8 = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(replace({_escaped('role')}, chr(10), '\' || chr(10))) + 1 + length({_escaped('text')}) + 11) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

OP10 = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
n AS (SELECT *, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(list_filter(w, lambda x: x = '|')) AS bars FROM base),
grams AS (SELECT doc_id, i, list_extract(w, i) || ' ' || list_extract(w, i + 1) || ' ' || list_extract(w, i + 2) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM n WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS r FROM twice, range(3) t(j) GROUP BY doc_id),
s AS (SELECT n.*, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words FROM n LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR (n_symbols - bars) * 10 > n_words - bars OR word_chars - bars < (n_words - bars) * 2 OR word_chars > n_words * 15
    OR n_dup_lines * 2 > len(ls) OR length(regexp_replace(t, '[^A-Z]', '', 'g')) * 2 > word_chars
    OR len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|…)\s*$'))) * 10 > len(ls) * 3
    OR len(list_filter(ls, lambda l: regexp_matches(l, '^\s*[-•*]'))) * 10 > len(ls) * 9
    OR len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) * 10 < (n_words - bars) * 7) AS kept
FROM f
"""


_SIZES = rf"""
t AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src, CAST(len({WORDS}) AS BIGINT) AS size, coalesce(CAST(doc_id AS VARCHAR), '') AS own FROM documents),
w AS (SELECT *, CAST('0x' || substr(md5('20/' || own), 1, 15) AS BIGINT) AS k, md5('21/' || own) AS h FROM t),
src AS (SELECT src, CAST(sum(size) AS BIGINT) AS n, CAST(ceil(count(*) / 2000) AS BIGINT) AS shards, row_number() OVER (ORDER BY src = 'n', src) AS i FROM w GROUP BY src),
weighed AS (SELECT *, list_extract([5.0, 2.0, 1.0], CAST((i - 1) % 3 + 1 AS BIGINT))::DOUBLE AS weight FROM src)"""
#: The targets: sources in the order in which they reach three times their size; the first that does not, and all after it, share what is left.
_TARGETS = """
line AS (SELECT *, sum(n) OVER () AS total, row_number() OVER (ORDER BY 3 * n / weight, i) AS place FROM weighed WHERE n > 0),
units AS (SELECT *, (total - coalesce(sum(3 * n) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM line),
first AS (SELECT place, unit FROM units WHERE unit * weight <= 3 * n ORDER BY place LIMIT 1),
targets AS (SELECT weighed.*, CASE WHEN weighed.n = 0 THEN 0.0 WHEN units.place < first.place THEN (3 * weighed.n)::DOUBLE ELSE first.unit * weighed.weight END AS target
    FROM weighed LEFT JOIN units USING (src) LEFT JOIN first ON true)"""


def _seats(name: str, rows: str, votes: str, order: str, seats: str, within: str) -> str:
    """Sainte-Laguë by the whole list of quotients: the highest ``seats`` of each partition win."""
    return f"""
{name}_all AS (SELECT *, unnest(range({seats})) AS s FROM {rows} WHERE {votes} > 0),
{name}_won AS (SELECT *, row_number() OVER ({within} ORDER BY {votes} / (2 * s + 1) DESC, {order}, s) AS place FROM {name}_all),
{name} AS (SELECT {rows}.*, coalesce(g.seats, 0) AS seats FROM {rows} LEFT JOIN (SELECT src, {order} AS at, count(*) AS seats FROM {name}_won WHERE place <= {seats} GROUP BY ALL) g ON g.src = {rows}.src AND g.at = {rows}.{order})"""


#: A source has one group of shards here, as it has up to 8 million rows.
OP2 = f"""
WITH {_SIZES}, {_TARGETS}, voted AS (SELECT *, CAST((sum(n) OVER () + 64) // 128 AS BIGINT) AS all_seats FROM targets),{_seats("quota", "voted", "target", "i", "all_seats", "")},
placed AS (SELECT w.*, k % shards AS shard, i, n, target, seats AS quota FROM w JOIN quota USING (src)),
cells AS (SELECT src, shard, any_value(quota) AS q, sum(size)::BIGINT AS cell FROM placed GROUP BY src, shard),{_seats("dealt", "cells", "cell", "shard", "q", "PARTITION BY src")},
taken AS (SELECT *, least(seats * 128, cell * 3)::BIGINT AS take FROM dealt),
plan AS (SELECT src, shard, cell, CASE WHEN cell > 0 THEN take // cell ELSE 0 END AS pass, CASE WHEN cell > 0 THEN take % cell ELSE take END AS run,
    CAST('0x' || substr(md5('20/' || src || '/' || shard), 1, 8) AS BIGINT) % greatest(1, ceil(cell / 128)::BIGINT) * 128 AS start FROM taken),
line2 AS (SELECT placed.*, pass, run, start, cell, sum(size) OVER (PARTITION BY src, shard ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS off
    FROM placed JOIN plan USING (src, shard))
SELECT doc_id, size, n AS source_size, target, CAST(pass * size + greatest(0, least(off + size, start + run, cell) - greatest(off, start)) + greatest(0, least(off + size, start + run - cell) - off) AS BIGINT) AS taken
FROM line2
"""


def _crc_table() -> list[int]:
    """The table of the reflected CRC-32 polynomial, by its rule."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return table


OP9 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size FROM documents),
c AS (SELECT *, substr(md5(text), 1, 16) || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS key,
    CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS UBIGINT))),
      lambda a, b: xor(a >> 8, list_extract({_crc_table()}::UBIGINT[], CAST((xor(a, b) & 255) + 1 AS BIGINT)))), 4294967295::UBIGINT) AS BIGINT) AS text_crc32 FROM t),
line AS (SELECT *, sum(size) OVER (ORDER BY key, doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS off,
    row_number() OVER (ORDER BY key, doc_id NULLS FIRST, size, text_crc32) AS row, sum(size) OVER () AS total FROM c),
s AS (SELECT *, CAST(least(39, (2 * off + size) * 40 // (2 * total)) AS INT) AS shard FROM line)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row - min(row) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INT) AS grown_shard FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": OP2, "op9_sharding": OP9, "op3_suffix_array_dedup": OP3, "op4_ngram_jaccard_join": OP4, "op6_line_dedup": OP6, "op7_warc": OP7, "op8_chat_format": OP8, "op10_quality_rules": OP10}
