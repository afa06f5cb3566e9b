"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from memspark.llm import byte_bpe, conversation_repair, decontaminate, line_dedup, quality, secret_scan, simhash_dedup, source_mix, substring_dedup, suffix_dedup, topk_search, toxicity, whitening
from memspark.llm.common import read_table

ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_copies(read_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, benchmark).drop("spans", "items")


OP3_SQL = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM bw WHERE len(w) > 0),
bwin AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM bs),
lens AS (SELECT DISTINCT n FROM bwin),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, lens WHERE len(w) >= n),
hits AS (SELECT doc_id, item_id, ds.n, s FROM ds JOIN bwin ON ds.n = bwin.n AND array_to_string(w[s:s + ds.n - 1], ' ') = k),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.exact_top_k(read_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5).drop("read_share")


OP6_SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.n, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.n <> v.n AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.suffix_dedup(docs, keep_first=False)
    return out.selectExpr("doc_id", "n_bytes", "n_removed", "cast(size(spans) as bigint) as n_spans", "kept_sha256", "n_later", "text")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.source_mix(read_table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH d AS (SELECT doc_id, source, md5('0:' || CAST(doc_id AS VARCHAR)) AS o,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST(r % 3 AS INTEGER) + 1] AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
t AS (SELECT *, total - coalesce(CAST(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS free,
    CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS onward
  FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, r)),
l AS (SELECT free AS f, onward AS n FROM t WHERE free * weight <= 3 * source_size * onward ORDER BY 3 * source_size / weight, r LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN 3 * source_size * n < weight * f THEN CAST(3 * source_size AS DOUBLE) ELSE weight * f / n END AS target FROM t, l),
a AS (SELECT *, CAST(floor(target) AS BIGINT) AS whole FROM g),
p AS (SELECT doc_id, size, source_size, target, whole AS take, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
  FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE
  (take // source_size) * size + greatest(least(start + size, take % source_size) - start, 0) END AS taken FROM p
"""

def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(read_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.passage_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP10_SQL = """
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
h AS (SELECT *, list_transform(l, lambda x: md5(x)) AS m FROM d),
b AS (SELECT doc_id, l, m, list_concat([0], list_filter(range(1, len(l)), lambda i: md5(m[i] || m[i + 1])[1] < '4'), [len(l)]) AS e FROM h),
c AS (SELECT doc_id, l, m, unnest(list_transform(range(1, len(e)), lambda i: {'f': e[i], 'n': e[i + 1] - e[i]})) AS s FROM b),
k AS (SELECT doc_id, s.f AS f, s.n AS n, array_to_string(l[s.f + 1:s.f + s.n], chr(10)) AS t FROM c WHERE s.n >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, f) AS copy FROM k),
g AS (SELECT doc_id, sum(n) AS gone, count(*) AS chunks, flatten(list(range(f + 1, f + n + 1))) AS lines FROM r WHERE copy > 1 GROUP BY doc_id)
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(lines, i)), lambda i: l[i]), chr(10)), '') END AS text,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(chunks, 0) AS BIGINT) AS n_chunks
FROM d LEFT JOIN g USING (doc_id)
"""

def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


_PIECES = """
d AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?][ \\t\\n\\r\\f\\v]+|\\n+)', '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
e AS (SELECT doc_id, i - 1 AS i, p[i] AS raw, trim(p[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s
  FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM d))
"""

OP2_SQL = f"""
WITH {_PIECES},
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r, len(regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+')) AS n FROM e WHERE s <> ''),
c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS cum FROM f),
t AS (SELECT a.doc_id, a.r, min(b.r) AS z FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.r BETWEEN a.r + 1 AND a.r + 20 AND b.cum - a.cum + a.n >= 20 GROUP BY ALL
  UNION SELECT a.doc_id, max(b.r), a.r FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.r BETWEEN a.r - 20 AND a.r - 1 AND a.cum - b.cum + b.n >= 20 GROUP BY a.doc_id, a.r),
k AS (SELECT t.doc_id, t.r, t.z AS y, min(c.i) AS i, max(c.i) AS z, string_agg(c.s, chr(10) ORDER BY c.i) AS h FROM t JOIN c ON c.doc_id = t.doc_id AND c.r BETWEEN t.r AND t.z GROUP BY t.doc_id, t.r, t.z),
q AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS copy FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, z + 1)) AS i FROM q WHERE copy > 1),
m AS (SELECT e.doc_id, e.i, raw, s, g.i IS NOT NULL AS gone FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.i = g.i),
w AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id, s <> '' ORDER BY i), FALSE) AS begins FROM m),
o AS (SELECT doc_id, string_agg(raw, '' ORDER BY i) FILTER (NOT gone) AS kept, count(*) FILTER (s <> '') AS n_sentences,
  count(*) FILTER (s <> '' AND gone) AS n_removed, count(*) FILTER (s <> '' AND begins) AS n_spans FROM w GROUP BY doc_id)
SELECT doc_id, CASE WHEN n_removed = 0 THEN text ELSE coalesce(kept, '') END AS text, n_sentences, n_removed, n_spans FROM documents JOIN o USING (doc_id)
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.toxicity_scores(docs, labels)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality.importance_resample(docs, labels)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), k=16)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damaged_and_repaired(read_table(spark, sf_dir, "conversations"))


def _insert(best: str, role: str) -> str:
    return f"{{'c': {best}.c + 2, 'a': 'I' || {best}.a, 't': chr(10) || '{role}:' || {best}.t}}"


def _edit(best: str, cost: str, letter: str, line: str, allowed: str = "TRUE") -> str:
    return f"{{'c': CASE WHEN {allowed} THEN {best}.c + {cost} ELSE 1000000000 END, 'a': '{letter}' || {best}.a, 't': {line} || {best}.t}}"


def _options(state: str, keeps: dict[str, str], to: str, role: str) -> str:
    """The edits of a row in a state, least first: ``keeps`` gives the state after a kept row of an initial."""
    every = [_edit(f"r.{state}", "3", "D", "''"), _edit(f"r.{to}", "2 + late", "R", f"chr(10) || '{role}:' || f.text", "NOT forced")]
    every += [_edit(f"r.{after}", "late", "K", "chr(10) || f.role || ':' || f.text", f"NOT forced AND left(f.role, 1) = '{initial}'") for initial, after in keeps.items()]
    return f"list_sort([{', '.join(every)}])[1] AS {state}"


# Bit by bit the same cyclic redundancy check as Spark's crc32; then costs, audits and texts from the end, for the four
# states that may come before a row: x nothing, y a system row, u a user row, w an assistant row.
OP12_SQL = f"""
WITH RECURSIVE p AS (SELECT list(list_reduce(CAST(range(8) AS BIGINT[]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END, CAST(n AS BIGINT)) ORDER BY n) AS t FROM range(256) AS q(n)),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(CAST(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)) AS BIGINT[]),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM conversations, p),
e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM d WHERE kind <> 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM e),
g AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS late, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, i, pair, blank, NOT blank AND again AS again, blank OR again AS forced, CASE WHEN NOT blank AND NOT again AND late THEN 1 ELSE 0 END AS late FROM g),
n AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, CAST(sum(late) AS BIGINT) AS truncated,
  count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
r AS (SELECT conv_id, rows + 1 AS i, {{'c': 0, 'a': '', 't': ''}} AS x, {{'c': 4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS y, {{'c': 2, 'a': 'I', 't': chr(10) || 'assistant:'}} AS u, {{'c': 0, 'a': '', 't': ''}} AS w FROM n
  UNION ALL SELECT conv_id, i, list_sort([x, {_insert('k', 'user')}])[1], list_sort([y, {_insert('k', 'user')}])[1], k, list_sort([w, {_insert('u', 'user')}])[1]
  FROM (SELECT *, list_sort([u, {_insert('w', 'assistant')}])[1] AS k FROM (SELECT f.conv_id, f.i, {_options('x', {'s': 'y', 'u': 'u'}, 'u', 'user')}, {_options('y', {'u': 'u'}, 'u', 'user')},
    {_options('u', {'a': 'w'}, 'w', 'assistant')}, {_options('w', {'u': 'u'}, 'u', 'user')} FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i - 1))),
z AS (SELECT n.*, x FROM n JOIN r ON r.conv_id IS NOT DISTINCT FROM n.conv_id AND r.i = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(x.c, 0) AS BIGINT) AS cost, coalesce(x.a, '') AS audit,
  sha256(coalesce(substr(x.t, 2), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.token_digests(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_topk_search": op6_topk_search,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_secret_scan": op9_secret_scan,
    "op10_line_dedup": op10_line_dedup,
    "op10_passage_dedup": op10_passage_dedup,
    "op11_whitening": op11_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op3_decontaminate": OP3_SQL,
    "op6_topk_search": OP6_SQL,
    "op8_source_mix": OP8_SQL,
    "op10_line_dedup": OP10_SQL,
    "op12_conversation_repair": OP12_SQL,
}
