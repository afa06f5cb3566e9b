"""Queries over search and embedding operators, with their SQL. The benchmark's items are the table of search texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from memspark.functions.checkpoints import cut, shared_folder
from memspark.operators import embed, search, upkeep
from memspark.plans.bridge import NOW, Bridge, with_views

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = lambda spark, sf_dir: f(Bridge(spark, sf_dir))
        if sql:
            S[name] = with_views(sql)
        return f

    return add


def asked(b):
    return b.table("benchmark").selectExpr("item_id as query_id", "text")


def terms(b):
    return search.query_terms(asked(b), "text")


_TOKENS = "list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^\\pL\\pN\\pM]+'), lambda t: t <> '')"
TERMS = f"""
asked AS (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN_]+'), lambda t: t <> '')) AS word FROM benchmark),
terms AS (SELECT DISTINCT query_id, unnest({_TOKENS.format("word")}) AS term FROM (SELECT DISTINCT query_id, word FROM asked))
"""


def _index(key: str, table: str, text: str) -> str:
    return f"""
words AS (SELECT {key}, unnest({_TOKENS.format(text)}) AS term FROM {table}),
counted AS (SELECT term, {key}, count(*) AS tf FROM words GROUP BY ALL),
postings AS (SELECT *, CAST(sum(tf) OVER (PARTITION BY {key}) AS BIGINT) AS dl FROM counted)"""


def _bm25(key: str, seen: str = "scores", table: str | None = None) -> str:
    table = table or {"id": "mem_entities", "event_id": "mem_events"}[key]
    return f"""
stats AS (SELECT count(*) AS n, avg(coalesce(dl, 0)) AS avgdl FROM {table} AS every LEFT JOIN (SELECT DISTINCT {key}, dl FROM postings) AS filled ON every.{key} = filled.{key}),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scores AS (SELECT query_id, {key}, count(*) AS matched, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))), 6) AS bm25
  FROM postings JOIN terms USING (term) JOIN freq USING (term), stats GROUP BY query_id, {key}),
wanted AS (SELECT query_id, count(*) AS wanted FROM terms GROUP BY query_id),
matched AS (SELECT * FROM (SELECT *, max(matched) OVER (PARTITION BY query_id) AS best FROM {seen} JOIN wanted USING (query_id)) WHERE best < wanted OR matched = wanted)"""


ENTITY_INDEX = _index("id", "mem_entities", "coalesce(title, '') || ' ' || content")
EVENT_INDEX = _index("event_id", "mem_events", "content")


@query("d1_query_tokens", TERMS + "SELECT query_id, term FROM terms")
def _(b):
    return terms(b)


def entity_index(b):
    return search.build_index(b.entities, "id", ["title", "content"])


@query("d2_build_index", ENTITY_INDEX + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf, CAST(max(dl) AS BIGINT) AS longest FROM postings GROUP BY term")
def _(b):
    return entity_index(b).filter("term is not null").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.max("dl").alias("longest"))


@query("d3_boolean_match", f"{TERMS}, {ENTITY_INDEX}, {_bm25('id')} SELECT query_id, id, matched FROM matched")
def _(b):
    return search.boolean_match(entity_index(b), terms(b), "id")


_RANKED = f"""{TERMS}, {ENTITY_INDEX}, {_bm25('id', '(SELECT scores.* FROM scores JOIN mem_entities USING (id) WHERE NOT archived)')},
ranked AS (SELECT query_id, m.id, type, bm25, pinned, stale, updated_s, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, updated_s DESC, m.id) AS rank
  FROM matched m JOIN mem_entities e ON m.id = e.id WHERE NOT archived)"""


@query("d4_bm25_rank", f"{_RANKED} SELECT query_id, id, bm25, rank FROM ranked WHERE rank <= 10")
def _(b):
    return search.rank_entities(entity_index(b), b.entities, terms(b), 10).select("query_id", "id", "bm25", "rank")


def scoped(b):
    """What every search text may see: two projects each."""
    return asked(b).select("query_id", F.explode(F.array(*[F.concat(F.lit("src"), ((F.col("query_id") + i) % 20).cast("string")) for i in (0, 7)])).alias("project_id"))


_SCOPED = f"""{TERMS}, {ENTITY_INDEX}, {_bm25('id', '(SELECT scores.* FROM scores JOIN mem_entities USING (id) WHERE NOT archived AND NOT stale AND project_id IN (' + "'src' || CAST(query_id % 20 AS VARCHAR), 'src' || CAST((query_id + 7) % 20 AS VARCHAR)" + '))')}
SELECT query_id, id, bm25, rank FROM (SELECT query_id, m.id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, updated_s DESC, m.id) AS rank
  FROM matched m JOIN mem_entities e ON m.id = e.id) WHERE rank <= 10"""


@query("d4_bm25_rank_scoped", _SCOPED)
def _(b):
    return search.rank_entities(entity_index(b), b.entities, terms(b), 10, scope=scoped(b), stale=False).select("query_id", "id", "bm25", "rank")


_RECENCY = "coalesce(exp(-0.693 * greatest((%d - {0}) / 86400.0, 0.0) / 7.0), 1.0)" % NOW
_EVENTS = f"""{EVENT_INDEX.replace('words', 'ewords').replace('counted', 'ecounted').replace('postings', 'epostings')},
{_bm25('event_id').replace('postings', 'epostings').replace('stats', 'estats').replace('freq', 'efreq').replace('scores', 'escores').replace('wanted AS (', 'ewanted AS (').replace('JOIN wanted', 'JOIN ewanted').replace('matched AS (SELECT *', 'ematched AS (SELECT *')},
eranked AS (SELECT query_id, m.event_id, type, ts_s, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, ts_s DESC, m.event_id) AS rank,
  round({_RECENCY.format('ts_s')}, 6) AS score FROM ematched m JOIN mem_events e ON m.event_id = e.event_id)"""


def event_index(b):
    return search.build_index(b.events, "event_id", ["content"])


@query("d5_event_hits", f"{TERMS}, {_EVENTS} SELECT query_id, event_id, type, score, rank FROM eranked WHERE rank <= 10")
def _(b):
    return search.rank_events(event_index(b), b.events, terms(b), 10, NOW).select("query_id", "event_id", "type", "score", "rank")


@query("d5_event_hits_scoped", f"""{TERMS}, {EVENT_INDEX}, {_bm25('event_id', '(SELECT scores.* FROM scores JOIN mem_events USING (event_id) WHERE project_id = query_id % 5)')}
SELECT * FROM (SELECT query_id, m.event_id, type, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, ts_s DESC, m.event_id) AS rank FROM matched m JOIN mem_events e ON m.event_id = e.event_id) WHERE rank <= 10""")
def _(b):
    scope = asked(b).selectExpr("query_id", "query_id % 5 as project_id", "cast(null as bigint) as session_id")
    return search.rank_events(event_index(b), b.events, terms(b), 10, NOW, scope=scope).select("query_id", "event_id", "type", "rank")


@query("d6_recency", f"SELECT event_id, round({_RECENCY.format('ts_s')}, 6) AS recency FROM mem_events")
def _(b):
    return b.events.select("event_id", F.round(search.recency(F.col("ts_s"), NOW), 6).alias("recency"))


_VECTOR = """
v AS (SELECT *, sqrt(list_dot_product(vector, vector)) AS norm FROM mem_embeddings),
q AS (SELECT *, sqrt(list_dot_product(query_vector, query_vector)) AS qnorm FROM query_vectors),
sims AS (SELECT query_id, entity_id, round(list_dot_product(vector, query_vector) / (norm * qnorm), 6) AS similarity FROM v JOIN q ON v.model = q.model AND v.dim = q.dim AND entity_id <> query_id AND norm > 0 AND qnorm > 0),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entity_id) AS rank FROM sims WHERE similarity >= 0.1)"""


@query("d7_vector_rank", f"{_VECTOR} SELECT query_id, entity_id, similarity, rank FROM near WHERE rank <= 10")
def _(b):
    return search.vector_rank(b.embeddings, b.query_vectors, 10, 0.1)


@query("d8_rank_fusion", f"""{_VECTOR}, {_RANKED.strip()},
vq AS (SELECT query_id // 20 AS query_id, entity_id AS id, rank FROM near WHERE rank <= 10),
f AS (SELECT query_id, id, sum(1.0 / (59 + rank)) AS fused FROM (SELECT query_id, id, rank FROM ranked WHERE rank <= 10 UNION ALL SELECT * FROM vq) GROUP BY ALL)
SELECT query_id, id, round(fused / max(fused) OVER (PARTITION BY query_id), 6) AS relevance FROM f""")
def _(b):
    near = search.vector_rank(b.embeddings, b.query_vectors, 10, 0.1).selectExpr("query_id div 20 as query_id", "entity_id as id", "rank")
    return search.rrf([search.rank_entities(entity_index(b), b.entities, terms(b), 10), near], "id")


_SCORE = "round(0.8 * ({0}) * CASE WHEN pinned THEN 1.5 ELSE 1.0 END * CASE WHEN stale THEN 0.3 ELSE 1.0 END, 6)"


@query("d9_entity_score", f"SELECT id, {_SCORE.format(_RECENCY.format('updated_s'))} AS score FROM mem_entities")
def _(b):
    return b.entities.select("id", search.entity_score(None, F.col("updated_s"), F.col("pinned"), F.col("stale"), NOW).alias("score"))


_FUSED = """lex AS (SELECT query_id, id, 1.0 / (59 + rank) AS fused FROM ranked WHERE rank <= 10),
rel AS (SELECT query_id, id, round(fused / max(fused) OVER (PARTITION BY query_id), 6) AS relevance FROM lex)"""


@query("d10_search", f"""{_RANKED}, {_FUSED}, {_EVENTS},
u AS (SELECT rel.query_id, 'entity' AS kind, rel.id, type, {_SCORE.format('relevance + 0.001 * ' + _RECENCY.format('updated_s'))} AS score FROM rel JOIN mem_entities e ON rel.id = e.id
  UNION ALL SELECT query_id, 'event', event_id, type, score FROM eranked WHERE rank <= 10)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, id) AS rank FROM u) WHERE rank <= 10""")
def _(b):
    return search.search(b.events, event_index(b), b.entities, entity_index(b), terms(b), 10, NOW)


@query("d11_recent_events", f"""SELECT project_id, event_id, score, rank FROM (SELECT *, round({_RECENCY.format('ts_s')}, 6) AS score,
 row_number() OVER (PARTITION BY project_id ORDER BY ts_s DESC, event_id DESC) AS rank FROM mem_events) WHERE rank <= 20""")
def _(b):
    return search.recent_events(b.events, 20, NOW).select("project_id", "event_id", "score", "rank")


@query("d12_browse", """SELECT project_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY pinned DESC, updated_s DESC, id) AS rank
 FROM mem_entities WHERE type IN ('todo', 'failure') AND status IN ('open', 'unresolved') AND NOT stale) WHERE rank <= 20""")
def _(b):
    return search.browse(b.entities, 20, ["todo", "failure"], ["open", "unresolved"], False).select("project_id", "id", "rank")


@query("d13_compact_index", """
n AS (SELECT entity_id AS id, list_transform(list_sort(list(file_path)), lambda p: split_part(p, '/', 3)) AS f FROM mem_files GROUP BY entity_id)
SELECT e.id, type, substr(title, 1, 40) AS title, strftime(make_timestamp(updated_s * 1000000), '%Y-%m-%d') AS day, coalesce(array_to_string(f[1:3], ', '), '') AS files FROM mem_entities e LEFT JOIN n ON e.id = n.id""")
def _(b):
    return search.compact_index(b.entities, b.files)


_FULL = "lpad(cast(id % 150 as {0}), 8, '0') || 'X' || lpad(cast(id % 700 as {0}), 8, '0')"


@query("d14_resolve_short_ids", f"""
e AS (SELECT project_id, {_FULL.format('VARCHAR')} AS full_id FROM mem_entities),
a AS (SELECT DISTINCT project_id, lpad(CAST(id % 300 AS VARCHAR), 8, '0') AS short FROM mem_entities),
f AS (SELECT a.project_id, a.short, count(DISTINCT full_id) AS n, min(full_id) AS id FROM a LEFT JOIN e ON a.project_id = e.project_id AND (left(full_id, 8) = short OR right(full_id, 8) = short) GROUP BY ALL)
SELECT project_id, short, CASE WHEN n = 1 THEN 'found' WHEN n > 1 THEN 'ambiguous' ELSE 'not found' END AS outcome, CASE WHEN n = 1 THEN id END AS id FROM f""")
def _(b):
    named = b.entities.selectExpr("project_id", f"{_FULL.format('string')} as full_id")
    short = b.entities.selectExpr("project_id", "lpad(cast(id % 300 as string), 8, '0') as short").distinct()
    return search.resolve_short_ids(named, short)


@query("e1_embedding_text", """SELECT id, 'doc: ' || substr(concat_ws(chr(10), nullif(trim(title), ''), nullif(trim(content), '')), 1, 2000) AS text FROM mem_entities""")
def _(b):
    return b.entities.select("id", embed.embedding_text(["title", "content"], "doc: ").alias("text"))


@query("e3_missing_embeddings", "SELECT id, updated_s FROM mem_entities WHERE NOT archived AND NOT stale AND id NOT IN (SELECT entity_id FROM mem_embeddings WHERE model = 'm|')")
def _(b):
    return embed.missing_embeddings(b.entities, b.embeddings, "m|").select("id", "updated_s")


@query("e5_coverage", """SELECT project_id, count(*) AS entities, count(v.entity_id) AS embedded, count(v.entity_id) > 0 AS any_embedded FROM mem_entities e
 LEFT JOIN (SELECT DISTINCT entity_id FROM mem_embeddings) v ON e.id = v.entity_id GROUP BY project_id""")
def _(b):
    return embed.coverage(b.entities, b.embeddings)


@query("e6_block_cosine", """
v AS (SELECT entity_id AS id, type, vector FROM mem_embeddings)
SELECT a.type, a.id AS left_id, b.id AS right_id, round(list_dot_product(a.vector, b.vector) / (sqrt(list_dot_product(a.vector, a.vector)) * sqrt(list_dot_product(b.vector, b.vector))), 6) AS similarity
FROM v a JOIN v b ON a.type = b.type AND a.id <> b.id AND a.id % 20 = 0""")
def _(b):
    v = b.embeddings.selectExpr("entity_id as id", "type", "vector")
    return embed.block_cosine(v.filter("id % 20 = 0"), v, ["type"])


# Three batches of changes, then a search: it must be one over the entities as they are at the end.
_KEPT = """kept AS (SELECT id, CASE WHEN id % 5 = 0 THEN title ELSE coalesce(title, '') || ' ' || content END AS t FROM mem_entities WHERE id % 7 <> 0)"""


@query("d2_index_upkeep", f"{TERMS}, {_KEPT}, {_index('id', 'kept', 't')}, {_bm25('id', table='kept')} SELECT query_id, id, matched, bm25 FROM scores")
def _(b):
    index = upkeep.KeptIndex(b.spark, f"{shared_folder(b.spark)}/index-{uuid.uuid4().hex}", "id", ["title", "content"])
    whole = b.entities.select("id", "title", "content", F.lit(False).alias("deleted"))
    index.apply(0, whole.filter("id % 3 <> 0"))
    index.apply(1, whole.filter("id % 3 = 0 or id % 5 = 0").withColumn("content", F.when(F.col("id") % 5 != 0, F.col("content"))))
    index.apply(2, whole.filter("id % 7 = 0").withColumn("deleted", F.lit(True)))
    wanted = cut(terms(b))
    return search.bm25(index.postings(wanted), wanted, "id", stats=index.stats()).select("query_id", "id", "matched", "bm25")


@query("m6_vector_upkeep", """SELECT entity_id, round(list_sum(vector) * CASE WHEN entity_id % 5 = 0 THEN 2 ELSE 1 END, 6) AS total FROM mem_embeddings WHERE entity_id % 7 <> 0""")
def _(b):
    vectors = upkeep.Segments(b.spark, f"{shared_folder(b.spark)}/vectors-{uuid.uuid4().hex}", "entity_id", most=2)
    whole = b.embeddings.select("entity_id", "vector")
    changes = [whole.withColumn("deleted", F.lit(False)), whole.filter("entity_id % 5 = 0").withColumn("deleted", F.lit(False)), whole.filter("entity_id % 7 = 0").withColumn("deleted", F.lit(True))]
    for number, (batch, factor) in enumerate(zip(changes, (1, 2, 1), strict=True)):
        upkeep.keep_vectors(vectors, number, batch, lambda df, f=factor: df.select("entity_id", F.transform("vector", lambda x: x.cast("double") * f).alias("vector")))
    return vectors.alive().select("entity_id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


# Names that the queries over whole search texts had while others cut them.
for _name in ("d1_query_tokens", "d3_boolean_match", "d4_bm25_rank", "d5_event_hits", "d10_search"):
    Q[f"{_name}_whole"], S[f"{_name}_whole"] = Q[_name], S[_name]
