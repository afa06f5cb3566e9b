"""Queries over sensitive-data, consolidation, inference, briefing, retention and corpus operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memspark.functions.checkpoints import cut
from memspark.operators import briefing, consolidate, corpus, dedupe, infer, retention, search, sensitive
from memspark.plans.bridge import E0, NOW, Bridge, with_views

Q, S = {}, {}


def query(name: str, sql: str | None = None, recursive: bool = False):
    def add(f):
        Q[name] = lambda spark, sf_dir: f(Bridge(spark, sf_dir))
        if sql:
            S[name] = with_views(sql, recursive)
        return f

    return add


# ---- sensitive data
_LUHN = """list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN (length(digits) - i) % 2 = 1
  THEN CASE WHEN CAST(digits[i] AS INTEGER) * 2 > 9 THEN CAST(digits[i] AS INTEGER) * 2 - 9 ELSE CAST(digits[i] AS INTEGER) * 2 END ELSE CAST(digits[i] AS INTEGER) END)) % 10 = 0"""
_COUNTS = " UNION ALL ".join(
    f"SELECT id, '{n}' AS pattern, '{c}' AS category, CAST(len(regexp_extract_all(content, '{p}')) AS BIGINT) AS n FROM mem_entities" for n, p, c in sensitive.PATTERNS if n != "credit_card"
)

_CARDS = next(p for n, p, _ in sensitive.PATTERNS if n == "credit_card")
_COUNTS += f" UNION ALL SELECT id, 'credit_card', 'financial', CAST(len(list_filter(regexp_extract_all(content, '{_CARDS}'), lambda digits: {_LUHN})) AS BIGINT) FROM mem_entities"


@query("c1_pattern_counts", f"SELECT * FROM ({_COUNTS}) WHERE n > 0")
def _(b):
    return sensitive.pattern_counts(b.entities, "id", "content")


@query("c1_scan_sensitive")
def _(b):
    out = sensitive.scan_sensitive(b.entities.select("id", "content"), "content")
    return out.select("id", F.explode("spans").alias("s")).select("id", "s.start", "s.end", "s.category", "s.detector", "s.pattern", "s.value")


@query("c2_card_numbers", f"""
r AS (SELECT id, unnest(regexp_extract_all(content, '\\d{{13,19}}')) AS digits FROM mem_entities)
SELECT id, count(*) AS cards, count(*) FILTER ({_LUHN}) AS valid FROM r GROUP BY id""")
def _(b):
    return sensitive.card_numbers(b.entities, "id", "content")


@query("c3_token_entropy", """
t AS (SELECT DISTINCT id, unnest(regexp_extract_all(content, '[A-Za-z0-9_\\-+/=.]{20,}')) AS token FROM mem_entities),
c AS (SELECT id, token, c, count(*) AS n FROM (SELECT id, token, unnest(string_split(token, '')) AS c FROM t) WHERE c <> '' GROUP BY ALL)
SELECT id, token, round(sum(-(n / length(token)) * log2(n / length(token))), 6) AS entropy FROM c GROUP BY ALL""")
def _(b):
    return sensitive.token_entropy(b.entities, "id", "content")


@query("c5_redact")
def _(b):
    out = sensitive.redact(sensitive.scan_sensitive(b.entities.select("id", "content"), "content"), "content", "id", "0123456789abcdef")
    return out.filter(F.size("spans") > 0).select("id", "redacted", F.size("spans").alias("n_spans"))


@query("c6_findings_to_spans", """
f AS (SELECT id, substr(content, 11, 7) AS value, CAST(id % 10 AS DOUBLE) / 10 AS confidence, content FROM mem_entities),
p AS (SELECT id, strpos(content, value) - 1 AS s, value, confidence FROM f WHERE confidence >= 0.7 AND value <> '')
SELECT id, s AS start, s + length(value) AS "end", 'pii' AS category, confidence FROM p WHERE s >= 0""")
def _(b):
    findings = b.entities.selectExpr("id", "substring(content, 11, 7) as value", "(id % 10) / 10.0D as confidence", "'pii' as category")
    return sensitive.findings_to_spans(b.entities, findings, "id", "content")


@query("c7_vault_rows")
def _(b):
    out = sensitive.redact(sensitive.scan_sensitive(b.entities.select("id", "content"), "content"), "content", "id", "0123456789abcdef")
    return sensitive.vault_rows(out, "id", "0123456789abcdef").select("vault_id", "id", "category", "detector", "pattern", "false_positive")


@query("c8_restore_false_positives", "SELECT id, content FROM mem_entities")
def _(b):
    out = sensitive.redact(sensitive.scan_sensitive(b.entities.select("id", "content"), "content"), "content", "id", "0123456789abcdef")
    vault = sensitive.vault_rows(out, "id", "0123456789abcdef")
    return sensitive.restore_false_positives(out.select("id", F.col("redacted").alias("content")), vault, vault.select("vault_id"), "id", "content", "0123456789abcdef")[0]


# ---- near-duplicates and consolidation
_SIG = "trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_DIGITS = "array_to_string(regexp_extract_all(sig, '\\d+'), '-')"
_PAIRS = f"""
s AS (SELECT *, {_DIGITS} AS digits, substr(sig, 1, 24) AS head FROM (SELECT id, project_id, type, created_s, {_SIG} AS sig FROM mem_entities WHERE NOT stale AND NOT archived) WHERE sig <> ''),
h AS (SELECT project_id, type, head, digits, sig, min(id) AS rep FROM s GROUP BY ALL),
pairs AS (SELECT a.rep AS a, b.rep AS b, round(1 - CAST(levenshtein(a.sig, b.sig) AS DOUBLE) / greatest(length(a.sig), length(b.sig)), 6) AS similarity
  FROM h a JOIN h b ON a.project_id = b.project_id AND a.type = b.type AND a.head = b.head AND a.digits = b.digits AND a.rep < b.rep WHERE 1 - CAST(levenshtein(a.sig, b.sig) AS DOUBLE) / greatest(length(a.sig), length(b.sig)) >= 0.82
  UNION ALL SELECT rep, id, 1.0 FROM s JOIN h USING (project_id, type, head, digits, sig) WHERE id <> rep)"""
_BLOCK = ["project_id", "type"]


def titled(b):
    """Entities of one project, so that more of their whole titles agree."""
    return b.entities.withColumn("project_id", F.lit("all"))


_TITLED = _PAIRS.replace("FROM mem_entities WHERE", "FROM (SELECT * REPLACE ('all' AS project_id) FROM mem_entities) WHERE")


@query("f1_signatures", f"SELECT id, sig, {_DIGITS} AS digits FROM (SELECT id, {_SIG} AS sig FROM mem_entities WHERE NOT stale AND NOT archived) WHERE sig <> ''")
def _(b):
    return dedupe.signatures(b.entities, []).select("id", "sig", "digits")


@query("f2_duplicate_pairs", f"{_PAIRS} SELECT * FROM pairs")
def _(b):
    return dedupe.duplicate_pairs(b.entities, _BLOCK, sim="levenshtein")


@query("f2_duplicate_pairs_ratio")
def _(b):
    return dedupe.duplicate_pairs(b.entities, _BLOCK)


_CLUSTERS = """und AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT DISTINCT a AS id, a AS r FROM und UNION SELECT reach.id, und.b FROM reach JOIN und ON reach.r = und.a),
clusters AS (SELECT id, min(r) AS cluster FROM reach GROUP BY id)"""


@query("f3_clusters", f"{_TITLED}, {_CLUSTERS} SELECT * FROM clusters", recursive=True)
def _(b):
    return dedupe.clusters(dedupe.duplicate_pairs(titled(b), _BLOCK, sim="levenshtein"))


@query("f4_merge_duplicates", f"""{_TITLED}, {_CLUSTERS},
v AS (SELECT cluster, arg_min(c.id, created_s * 1000000 + c.id) AS survivor FROM clusters c JOIN mem_entities e ON c.id = e.id GROUP BY cluster)
SELECT id, survivor AS superseded_by, TRUE AS stale, 'duplicate' AS staleness_reason FROM clusters JOIN v USING (cluster) WHERE id <> survivor""", recursive=True)
def _(b):
    members = dedupe.clusters(dedupe.duplicate_pairs(titled(b), _BLOCK, sim="levenshtein"))
    return dedupe.merge_duplicates(b.entities, members)


_SIMILAR = """
n AS (SELECT * FROM mem_embeddings WHERE entity_id % 5 = 0), o AS (SELECT * FROM mem_embeddings WHERE entity_id % 5 <> 0),
p AS (SELECT n.entity_id AS id, o.entity_id AS existing_id, round(list_dot_product(n.vector, o.vector) / (sqrt(list_dot_product(n.vector, n.vector)) * sqrt(list_dot_product(o.vector, o.vector))), 6) AS similarity FROM n JOIN o ON n.type = o.type),
sim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, existing_id) AS rank FROM p) WHERE rank <= 5)"""


def similar(b):
    v = b.embeddings.selectExpr("entity_id as id", "type", "vector")
    return consolidate.similar_entities(v.filter("id % 5 = 0"), v, ["type"])


@query("f5_similar_entities", f"{_SIMILAR} SELECT * FROM sim")
def _(b):
    return similar(b)


@query("f6_similar_by_text")
def _(b):
    new = b.entities.filter("id % 7 = 1")
    hits = consolidate.lexical_candidates(new, b.entities, search.build_index(b.entities, "id", ["title", "content"]))
    return consolidate.similar_by_text(new, hits, b.entities)


@query("f7_gate", f"{_SIMILAR} SELECT n.entity_id AS id, max(similarity) AS best, coalesce(max(similarity) >= 0.3, FALSE) AS judged FROM n LEFT JOIN sim ON n.entity_id = sim.id GROUP BY 1")
def _(b):
    return consolidate.gate(b.embeddings.filter("entity_id % 5 = 0").selectExpr("entity_id as id"), similar(b), 0.3)


@query("f8_validate_verdicts", """
v AS (SELECT batch, id, existing_id, CASE WHEN id % 24 = 3 THEN 'MAYBE' ELSE verdict END AS verdict FROM verdicts WHERE id % 33 <> 0),
a AS (SELECT q.batch, q.id, v.verdict, v.existing_id, coalesce(v.verdict IN ('ADD', 'UPDATE', 'NOOP', 'CONTRADICTS') AND (v.verdict = 'ADD' OR v.existing_id % 36 <> 1), FALSE) AS ok FROM verdicts q LEFT JOIN v ON q.id = v.id),
f AS (SELECT *, bool_and(ok) OVER (PARTITION BY batch) AS fine FROM a)
SELECT batch, id, CASE WHEN fine THEN verdict ELSE 'ADD' END AS verdict, CASE WHEN fine AND verdict <> 'ADD' THEN existing_id END AS existing_id FROM f""")
def _(b):
    said = b.verdicts.filter("id % 33 <> 0").selectExpr("batch", "id", "existing_id", "if(id % 24 = 3, 'MAYBE', verdict) as verdict")
    return consolidate.validate_verdicts(b.verdicts.select("batch", "id"), b.verdicts.filter("existing_id % 36 <> 1").select("id", "existing_id"), said)


@query("f9_apply_verdicts", """
dead AS (SELECT id FROM mem_entities WHERE id % 5 = 0),
c AS (SELECT *, row_number() OVER (PARTITION BY existing_id ORDER BY position, id) = 1 AND existing_id NOT IN (SELECT id FROM dead) AS wins FROM verdicts WHERE verdict IN ('UPDATE', 'CONTRADICTS')),
s AS (SELECT existing_id, id AS survivor FROM c WHERE wins),
m AS (SELECT v.batch, v.id, coalesce(survivor, v.existing_id) AS t, coalesce(survivor, v.existing_id) NOT IN (SELECT id FROM dead) AS alive FROM verdicts v LEFT JOIN s ON v.existing_id = s.existing_id WHERE verdict = 'NOOP')
SELECT batch, id, CASE WHEN wins THEN verdict ELSE 'ADD' END AS outcome, CASE WHEN wins THEN existing_id END AS target FROM c
UNION ALL SELECT batch, id, CASE WHEN alive AND t <> id THEN 'NOOP' ELSE 'ADD' END, CASE WHEN alive AND t <> id THEN t END FROM m
UNION ALL SELECT batch, id, 'ADD', NULL FROM verdicts WHERE verdict = 'ADD'""")
def _(b):
    return consolidate.apply_verdicts(b.verdicts, b.entities.filter("id % 5 = 0"))


# no entity of the view is both superseded and a successor, so its chains have one link
@query("f9_consolidated_entities", f"""
dead AS (SELECT id FROM mem_entities WHERE stale OR archived),
c AS (SELECT *, row_number() OVER (PARTITION BY existing_id ORDER BY position, id) = 1 AND existing_id NOT IN (SELECT id FROM dead) AS wins FROM verdicts WHERE verdict IN ('UPDATE', 'CONTRADICTS')),
t AS (SELECT existing_id AS old, id AS taker, verdict AS how FROM c WHERE wins),
m AS (SELECT v.id AS copy, coalesce(t.taker, v.existing_id) AS survivor FROM verdicts v LEFT JOIN t ON v.existing_id = t.old WHERE v.verdict = 'NOOP'),
n AS (SELECT m.* FROM m JOIN mem_entities e ON m.copy = e.id WHERE NOT archived AND survivor NOT IN (SELECT id FROM dead) AND survivor <> copy),
l AS (SELECT old AS src, taker AS dst FROM t UNION ALL SELECT copy, survivor FROM n WHERE copy NOT IN (SELECT old FROM t)),
p AS (SELECT dst, CAST(sum(cited_count) AS BIGINT) AS credit FROM l JOIN mem_entities e ON l.src = e.id GROUP BY dst)
SELECT e.id, stale OR old IS NOT NULL AS stale, archived OR copy IS NOT NULL AS archived, coalesce(t.taker, n.survivor) AS superseded_by,
  CASE how WHEN 'UPDATE' THEN 'consolidated' WHEN 'CONTRADICTS' THEN 'contradicted' END AS staleness_reason, CASE WHEN how = 'CONTRADICTS' THEN {NOW} END AS invalidated_s,
  CASE WHEN e.id IN (SELECT src FROM l) THEN 0 ELSE cited_count END + coalesce(credit, 0) AS cited_count, CASE WHEN e.id IN (SELECT survivor FROM n) THEN {NOW} ELSE updated_s END AS updated_s
FROM mem_entities e LEFT JOIN t ON e.id = t.old LEFT JOIN n ON e.id = n.copy LEFT JOIN p ON e.id = p.dst""")
def _(b):
    outcomes = cut(consolidate.apply_verdicts(b.verdicts, b.entities.filter("stale or archived")))
    out = consolidate.consolidate_entities(b.entities, outcomes, NOW)
    return out.select("id", "stale", "archived", "superseded_by", "staleness_reason", "invalidated_s", "cited_count", "updated_s")


@query("f10_decision_report", """
d AS (SELECT CASE WHEN verdict <> 'ADD' THEN verdict WHEN id % 5 = 0 THEN 'ADD judge failed' WHEN id % 2 = 0 THEN 'ADD judged' ELSE 'ADD never asked' END AS bucket, similarity FROM verdicts)
SELECT bucket, count(*) AS n, round(min(similarity), 6) AS least, round(median(similarity), 6) AS median, round(max(similarity), 6) AS most FROM d GROUP BY bucket""")
def _(b):
    return consolidate.decision_report(b.verdicts.withColumn("failed", F.expr("id % 5 = 0")).withColumn("judged", F.expr("id % 2 = 0")))


@query("f11_collapse_estimate", """pairs AS (SELECT id AS a, existing_id AS b FROM verdicts WHERE verdict IN ('UPDATE', 'NOOP') AND id <> existing_id),
und AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT DISTINCT a AS id, a AS r FROM und UNION SELECT reach.id, und.b FROM reach JOIN und ON reach.r = und.a),
k AS (SELECT id, min(r) AS cluster FROM reach GROUP BY id)
SELECT cluster, count(*) AS members FROM k GROUP BY cluster""", recursive=True)
def _(b):
    edges = b.verdicts.filter("verdict in ('UPDATE', 'NOOP') and id <> existing_id").selectExpr("id as a", "existing_id as b")
    return dedupe.clusters(edges).groupBy("cluster").agg(F.count("*").alias("members"))


_QT = "list_filter(list_distinct(regexp_split_to_array(lower(concat_ws(' ', title, content)), '[^\\pL\\pN_]+')), lambda t: length(t) >= 1)"


@query("f12_staleness_candidates", f"""
lv AS (SELECT *, regexp_split_to_array(lower(concat_ws(' ', title, content)), '[^\\pL\\pN_]+') AS w FROM mem_entities WHERE NOT stale AND NOT archived AND type IN ('decision', 'fact', 'feature', 'bugfix', 'todo')),
nt AS (SELECT id, t, min(i) AS i FROM (SELECT id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM lv WHERE created_s >= {E0 + 600 * 600}) WHERE length(t) >= 4 GROUP BY id, t),
nw AS (SELECT id, t FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM nt) WHERE r <= 6),
ow AS (SELECT DISTINCT id, unnest(w) AS t FROM lv),
p AS (SELECT DISTINCT n.id, o.id AS older_id, o.created_s AS older_s FROM nw JOIN lv n ON n.id = nw.id JOIN ow USING (t) JOIN lv o ON o.id = ow.id AND o.project_id = n.project_id AND o.type = n.type AND o.created_s < n.created_s)
SELECT id, older_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY older_s DESC, older_id) AS rank FROM p) WHERE rank <= 5""")
def _(b):
    return consolidate.staleness_candidates(b.entities, E0 + 600 * 600 + 3600)


@query("f13_mark_stale", "SELECT id, stale OR id % 3 = 0 AS stale, CASE WHEN id % 3 = 0 AND NOT stale THEN id + 1 END AS superseded_by, id % 3 = 0 AND NOT stale AS changed FROM mem_entities")
def _(b):
    marks = b.entities.filter("id % 3 = 0").selectExpr("id", "id + 1 as by", "'superseded' as reason")
    return consolidate.mark_stale(b.entities, marks).select("id", "stale", "superseded_by", "changed")


@query("f13_mark_current", "SELECT id, stale AND id % 2 = 1 AS stale FROM mem_entities")
def _(b):
    return consolidate.mark_current(b.entities, b.entities.filter("id % 2 = 0").select("id")).select("id", "stale")


@query("f14_transfer_citations", """
m AS (SELECT id AS src, id - 1 AS dst FROM mem_entities WHERE id % 4 = 3),
p AS (SELECT dst, sum(cited_count) AS n FROM m JOIN mem_entities ON id = src GROUP BY dst)
SELECT id, CAST((CASE WHEN id % 4 = 3 THEN 0 ELSE cited_count END) + coalesce(n, 0) AS BIGINT) AS cited_count FROM mem_entities LEFT JOIN p ON id = dst""")
def _(b):
    moves = b.entities.filter("id % 4 = 3").selectExpr("id as src", "id - 1 as dst")
    return consolidate.transfer_citations(b.entities.withColumn("last_cited_s", F.col("updated_s")), moves).select("id", "cited_count")


# ---- inference
_BATCHES = """
n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY session_id, ts_s, event_id) - 1 AS number FROM mem_events),
k AS (SELECT session_id, string_agg('- ' || title, chr(10) ORDER BY r) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_s DESC, id DESC) AS r FROM mem_entities) WHERE r <= 40 GROUP BY session_id),
g AS (SELECT project_id, number // 50 AS batch, string_agg('[' || type || '] ' || content, chr(10) ORDER BY number) AS body, arg_min(session_id, number) AS session_id FROM n GROUP BY ALL)"""


@query("h1_extraction_prompts", f"""{_BATCHES} SELECT project_id, batch, 'Known:' || chr(10) || coalesce(titles, '(none yet)') || chr(10) || 'Events:' || chr(10) || body AS prompt FROM g LEFT JOIN k USING (session_id)""")
def _(b):
    return infer.extraction_prompts(b.events, b.entities)


def _answers(prompts: list[str]) -> list[str]:
    """A stand-in for a model: a reply that names the prompt's length."""
    return ["Sure [1].\n```json\n" + '{"todos": [{"title": "length %d", "key_points": ["a", "b"]}], "facts": [{"title": " "}]}' % len(p) + "\n```" for p in prompts]


@query("h2_infer", f"{_BATCHES} SELECT project_id, batch, length('Known:' || chr(10) || coalesce(titles, '(none yet)') || chr(10) || 'Events:' || chr(10) || body) AS n FROM g LEFT JOIN k USING (session_id)")
def _(b):
    out = infer.infer(infer.extraction_prompts(b.events, b.entities), "prompt", _answers)
    return out.select("project_id", "batch", F.regexp_extract("response", r"length (\d+)", 1).cast("long").alias("n"))


@query("h3_parse_extractions", f"""{_BATCHES}
SELECT project_id || '-' || batch AS key, 'todo' AS type, 'length ' || length('Known:' || chr(10) || coalesce(titles, '(none yet)') || chr(10) || 'Events:' || chr(10) || body) AS title, '- a' || chr(10) || '- b' AS content, 'open' AS status FROM g LEFT JOIN k USING (session_id)""")
def _(b):
    return infer.reextract(b.events, b.entities, _answers)[0].select("key", "type", "title", "content", "status")


@query("h4_salvage_report", """SELECT project_id, count(*) AS responses, count(*) FILTER (session_id % 3 <> 0) AS parsed, round(CAST(count(*) FILTER (session_id % 3 <> 0) AS DOUBLE) / count(*), 6) AS rate FROM mem_events GROUP BY project_id""")
def _(b):
    said = b.events.selectExpr("project_id", """case session_id % 3 when 0 then concat('{ no ', regexp_replace(content, '[^a-z ]', '')) when 1 then concat(regexp_replace(content, '[^a-z ]', ''), ' {"a": [1]}') else '```json\\n[1]\\n``` [2' end as response""")
    return infer.salvage_report(infer.salvage(said), "project_id")


@query("h5_file_anchors")
def _(b):
    said = b.files.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "file_path", "line_number"))), " and ").alias("text"))
    return infer.file_anchors(said, "entity_id", "text")


@query("h6_anchor_validity", """
m AS (SELECT DISTINCT file_path FROM mem_files WHERE entity_id % 2 = 0),
f AS (SELECT entity_id, CASE WHEN entity_id % 10 = 0 THEN '/abs/' || file_path WHEN entity_id % 10 = 1 THEN 'x/../../' || file_path ELSE file_path || CASE WHEN entity_id % 3 = 0 THEN 'x' ELSE '' END END AS file_path FROM mem_files)
SELECT entity_id, f.file_path, CASE WHEN NOT (starts_with(f.file_path, '/') OR contains(f.file_path, '/../')) THEN m.file_path IS NOT NULL END AS valid FROM f LEFT JOIN m ON f.file_path = m.file_path""")
def _(b):
    files = b.files.withColumn("file_path", F.expr("case when entity_id % 10 = 0 then concat('/abs/', file_path) when entity_id % 10 = 1 then concat('x/../../', file_path) else concat(file_path, if(entity_id % 3 = 0, 'x', '')) end"))
    return infer.anchor_validity(files, b.files.filter("entity_id % 2 = 0")).select("entity_id", "file_path", "valid")


@query("h7_chunk_summaries", """
c AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY ts_s, event_id) - 1) // 20 AS chunk FROM mem_activity)
SELECT source AS session_id, chunk, min(ts_s) AS start_s, max(ts_s) AS end_s, CAST(sum(length(content) // 4) AS BIGINT) AS tokens, string_agg('[' || type || '] ' || content, chr(10) ORDER BY ts_s, event_id) AS prompt FROM c GROUP BY ALL HAVING count(*) = 20""")
def _(b):
    return infer.chunk_summaries(b.activity.withColumnRenamed("source", "session_id"))


_CHUNKS = "ch AS (SELECT session_id, start_s, end_s FROM mem_summaries WHERE level = 'chunk' AND session_id % 3 = 0 AND events = 4)"


@query("h8_session_summary_inputs", f"""{_CHUNKS},
r AS (SELECT session_id, string_agg(content, chr(10) ORDER BY ts_s, event_id) AS rest FROM mem_events e WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.session_id = e.session_id AND e.ts_s BETWEEN start_s AND end_s) GROUP BY session_id),
n AS (SELECT session_id, count(*) AS chunks FROM ch GROUP BY session_id)
SELECT coalesce(n.session_id, r.session_id) AS session_id, coalesce(chunks, 0) AS chunks, coalesce(rest, '') AS rest FROM n FULL JOIN r ON n.session_id = r.session_id""")
def _(b):
    return infer.session_summary_inputs(b.events, b.summaries.filter("level = 'chunk' and session_id % 3 = 0 and events = 4"))


@query("h9_cross_session_inputs", """
r AS (SELECT m.project_id, m.id, ended_s, row_number() OVER (PARTITION BY m.project_id ORDER BY ended_s DESC, m.id DESC) AS n FROM mem_summaries m JOIN mem_sessions s ON m.session_id = s.session_id WHERE level = 'session')
SELECT project_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY ended_s, id) AS summary_ids FROM r WHERE n <= 10 GROUP BY project_id""")
def _(b):
    return infer.cross_session_inputs(b.summaries, b.sessions)


@query("h10_judge_prompts", """
p AS (SELECT a.project_id, a.id AS driver, b.id AS target, a.title AS dt, a.content AS dc, b.title AS tt, b.content AS tc FROM mem_entities a JOIN mem_entities b ON b.id = a.id + 20 AND a.project_id = b.project_id),
n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY driver, target) - 1 AS i FROM p),
l AS (SELECT project_id, i, i // 10 AS chunk, (i % 10 + 1) || '. DRIVER [' || driver || '] ' || dt || chr(10) || '   ' || CASE WHEN length(dc) > 400 THEN substr(dc, 1, 400) || '...' ELSE dc END || chr(10) || '   TARGET [' || target || '] ' || tt || chr(10) || '   ' || CASE WHEN length(tc) > 400 THEN substr(tc, 1, 400) || '...' ELSE tc END AS line FROM n)
SELECT project_id, chunk, string_agg(line, chr(10) || chr(10) ORDER BY i) AS prompt FROM l GROUP BY ALL""")
def _(b):
    e = b.entities
    other = e.select("project_id", (F.col("id") - 20).alias("driver"), F.col("id").alias("target"), F.col("title").alias("target_title"), F.col("content").alias("target_content"))
    pairs = e.select("project_id", F.col("id").alias("driver"), F.col("title").alias("driver_title"), F.col("content").alias("driver_content")).join(other, ["project_id", "driver"])
    return infer.judge_prompts(pairs)


@query("h12_reextraction_report", f"{_BATCHES} SELECT project_id, count(*) AS batches, count(*) AS parsed FROM g GROUP BY project_id")
def _(b):
    return infer.reextract(b.events, b.entities, _answers)[2]


# ---- briefing
_WEIGHT = "CASE WHEN type IN ('decision', 'discovery', 'failure', 'fact') THEN 3.0 WHEN type IN ('bugfix', 'feature', 'research') THEN 2.0 WHEN type = 'todo' THEN 1.0 ELSE 0.0 END"
_AGE = f"greatest(({NOW} - created_s) / 86400.0, 0.0)"
_IMPORTANCE = f"round(CASE WHEN pinned THEN 8.0 ELSE 0.0 END + {_WEIGHT} + 4.0 * pow(0.5, {_AGE} / 14.0) + 4.0 * ln(1 + cited_count) * pow(0.5, {_AGE} / 30.0), 6)"
_OPEN = "(status IS NOT NULL AND status NOT IN ('done', 'cancelled', 'resolved'))"
_BRIEF = f"""
p1 AS (SELECT *, count(*) FILTER (stale) OVER (PARTITION BY project_id) AS suppressed FROM mem_entities WHERE NOT archived),
p2 AS (SELECT *, {_IMPORTANCE} AS score FROM p1 WHERE NOT stale),
p3 AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, id) AS rank, last_value(session_id) OVER (PARTITION BY project_id ORDER BY created_s, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ls, type IN ('todo', 'failure') AND {_OPEN} AS o FROM p2),
p4 AS (SELECT *, CASE WHEN o THEN row_number() OVER (PARTITION BY project_id, o ORDER BY CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, rank) END AS orank FROM p3),
sel AS (SELECT * FROM p4 WHERE rank <= 12 OR session_id = ls OR coalesce(orank <= 2, FALSE))"""


@query("j1_importance", f"SELECT id, {_IMPORTANCE} AS score FROM mem_entities")
def _(b):
    return b.entities.select("id", F.round(briefing.importance(NOW), 6).alias("score"))


def selected(b):
    return briefing.briefing_entities(b.entities, NOW, 12, 2)


@query("j2_briefing_entities", f"{_BRIEF} SELECT project_id, id, score, rank, suppressed FROM sel")
def _(b):
    return selected(b).select("project_id", "id", "score", "rank", "suppressed")


@query("j3_grouped", f"""{_BRIEF} SELECT project_id, strftime(make_timestamp(created_s * 1000000), '%Y-%m-%d') AS day, s.session_id, list_sort(list(id)) AS ids FROM sel LEFT JOIN (SELECT DISTINCT session_id FROM mem_sessions WHERE session_id % 2 = 0) s ON sel.session_id = s.session_id GROUP BY ALL""")
def _(b):
    return briefing.grouped(selected(b), b.sessions.filter("session_id % 2 = 0"))


@query("j4_latest_session", """
l AS (SELECT *, last_value(session_id) OVER (PARTITION BY project_id ORDER BY created_s, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ls FROM mem_entities WHERE NOT archived),
s AS (SELECT *, CASE WHEN type IN ('research', 'discovery', 'failure') THEN 'Investigated' WHEN type IN ('fact', 'decision') THEN 'Learned' WHEN type = 'todo' THEN 'Next' ELSE 'Completed' END AS section FROM l WHERE session_id = ls),
r AS (SELECT project_id, section, id, row_number() OVER (PARTITION BY project_id, section ORDER BY created_s DESC, id) AS number, greatest(count(*) OVER (PARTITION BY project_id, section) - 5, 0) AS overflow FROM s)
SELECT * FROM r WHERE number <= 5""")
def _(b):
    return briefing.latest_session(b.entities)


@query("j5_suggested_next", f"""
r AS (SELECT project_id, id, updated_s, CASE WHEN type = 'failure' THEN 0 WHEN type = 'todo' AND priority = 'high' THEN 1 WHEN type = 'todo' AND priority = 'medium' THEN 2 END AS r FROM mem_entities WHERE NOT archived AND NOT stale AND {_OPEN})
SELECT project_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY r, updated_s DESC, id) AS place FROM r WHERE r IS NOT NULL) WHERE place <= 5""")
def _(b):
    return briefing.suggested_next(b.entities)


@query("j6_briefing_text", f"""{_BRIEF},
u AS (SELECT project_id, rank, '- [' || type || '] ' || title AS line FROM sel),
w AS (SELECT *, sum(length(line) // 4 + 1) OVER (PARTITION BY project_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM u)
SELECT project_id, count(*) AS lines, string_agg(line, chr(10) ORDER BY rank) || chr(10) || 'end of briefing' AS text FROM w WHERE used <= 300 - 3 GROUP BY project_id""")
def _(b):
    return briefing.briefing_text(selected(b), 300, "end of briefing")


_SECTION = "CASE section WHEN 'Investigated' THEN 10 WHEN 'Learned' THEN 20 WHEN 'Completed' THEN 30 ELSE 40 END"


def _packed(by: str, budget: int, mark: str) -> str:
    """SQL of packed_text over parts (by, role, section, place, text) that are ordered by o."""
    most = budget * 4
    return f"""
texts AS (SELECT {by}, string_agg(text, chr(10) ORDER BY o) FILTER (role = 'top') AS top, coalesce(string_agg(text, chr(10) ORDER BY o) FILTER (role = 'body'), '') AS body,
  coalesce(chr(10) || string_agg(text, chr(10) ORDER BY o) FILTER (role = 'tail'), '') AS tail FROM parts GROUP BY {by}),
rooms AS (SELECT *, greatest({most} - length(tail), 0) AS room FROM texts),
packed AS (SELECT {by}, coalesce(top || chr(10) || chr(10), '') || CASE WHEN length(body) > room THEN substr(body, 1, greatest(room - {len(mark)}, 0)) || {mark.join("''").replace(chr(10), "' || chr(10) || '")} ELSE body END || tail AS text,
  length(body) > room AS truncated FROM rooms)"""


@query("j6_briefing_document", f"""{_BRIEF},
l AS (SELECT *, last_value(session_id) OVER (PARTITION BY project_id ORDER BY created_s, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ls FROM mem_entities WHERE NOT archived),
s AS (SELECT *, CASE WHEN type IN ('research', 'discovery', 'failure') THEN 'Investigated' WHEN type IN ('fact', 'decision') THEN 'Learned' WHEN type = 'todo' THEN 'Next' ELSE 'Completed' END AS section FROM l WHERE session_id = ls),
r AS (SELECT project_id, {_SECTION} AS section, section AS name, title, row_number() OVER (PARTITION BY project_id, section ORDER BY created_s DESC, id) AS number, count(*) OVER (PARTITION BY project_id, section) - 5 AS overflow FROM s),
nx AS (SELECT project_id, title, row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN type = 'failure' THEN 0 WHEN priority = 'high' THEN 1 ELSE 2 END, updated_s DESC, id) AS place FROM mem_entities
  WHERE NOT archived AND NOT stale AND status IN ('open', 'unresolved') AND (type = 'failure' OR type = 'todo' AND priority IN ('high', 'medium'))),
f AS (SELECT project_id, count(*) AS n, count(*) FILTER (stale) AS stale, CAST(sum(length(content) // 4) AS BIGINT) AS work FROM mem_entities WHERE NOT archived GROUP BY project_id),
h AS (SELECT project_id, count(*) AS open FROM mem_entities WHERE type = 'failure' AND status = 'unresolved' GROUP BY project_id),
n AS (SELECT project_id, arg_max(content, id) AS note FROM mem_entities WHERE pinned GROUP BY project_id),
parts AS (
 SELECT project_id, 'top' AS role, [0, 0] AS o, '! ' || open || ' failures are open' AS text FROM h
 UNION ALL SELECT project_id, 'top', [1, 0], substr(note, 1, 2000) FROM n
 UNION ALL SELECT project_id, 'body', [0, 0], '# ' || project_id || ', 2024-02-10' FROM f
 UNION ALL SELECT DISTINCT project_id, 'body', [section, 0], '## ' || name FROM r
 UNION ALL SELECT project_id, 'body', [section, number], '- ' || title FROM r WHERE number <= 5
 UNION ALL SELECT DISTINCT project_id, 'body', [section, 1000000], '  and ' || overflow || ' more' FROM r WHERE overflow > 0
 UNION ALL SELECT project_id, 'body', [80, 0], '## Memory' FROM f WHERE n > stale
 UNION ALL SELECT project_id, 'body', [80, rank], '- [' || type || '] ' || title FROM sel
 UNION ALL SELECT DISTINCT project_id, 'tail', [0, 0], '## Suggested next' FROM nx
 UNION ALL SELECT project_id, 'tail', [0, place], place || '. ' || title FROM nx WHERE place <= 5
 UNION ALL SELECT f.project_id, 'tail', [99, 0], coalesce(c, 0) || ' of ' || n || ' entities, ' || stale || ' stale; ' || work || ' tokens of work' FROM f LEFT JOIN (SELECT project_id, count(*) AS c FROM sel GROUP BY project_id) g ON f.project_id = g.project_id),
{_packed('project_id', 400, briefing.CUT_BODY)}
SELECT project_id, text, length(text) // 4 AS tokens, truncated FROM packed""")
def _(b):
    notes = b.entities.filter("pinned").groupBy("project_id").agg(F.max_by("content", "id").alias("note"))
    health = b.entities.filter("type = 'failure' and status = 'unresolved'").groupBy("project_id").agg(F.format_string("%d failures are open", F.count("*")).alias("banner"))
    return briefing.packed_text(briefing.briefing_parts(b.entities, cut(selected(b)), NOW, notes, health), 400)


# a context for every benchmark item: what the search finds for it, open tasks of its segment, and the line of a file
@query("j7_compiled_contexts", f"""
asks AS (SELECT item_id AS context_id, substr(text, 1, 40) AS focus, (SELECT min(file_path) FROM mem_files) AS file_path FROM benchmark),
hits AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY updated_s DESC, id) AS place FROM (SELECT item_id AS context_id, id, type, title, updated_s FROM benchmark JOIN mem_entities ON project_id = 'src' || (item_id % 20) WHERE NOT archived)),
tk AS (SELECT item_id AS context_id, id, task_type, 'task of ' || model AS title, row_number() OVER (PARTITION BY item_id ORDER BY created_s DESC, id) AS place FROM benchmark JOIN mem_tasks ON status = 'pending' AND id % 50 = item_id % 50),
fl AS (SELECT context_id, a.file_path, row_number() OVER (PARTITION BY context_id ORDER BY created_s, e.id) AS number, strftime(make_timestamp(created_s * 1000000), '%Y-%m-%d') AS day, type, title FROM asks a JOIN mem_files f ON a.file_path = f.file_path JOIN mem_entities e ON e.id = f.entity_id),
parts AS (
 SELECT context_id, 'body' AS role, [0, 0] AS o, '## Context for: ' || focus || chr(10) AS text FROM asks WHERE context_id IN (SELECT context_id FROM hits)
 UNION ALL SELECT context_id, 'body', [1, place], '- [' || left(CAST(id AS VARCHAR), 8) || '] ' || type || ': ' || title FROM hits WHERE place <= 10
 UNION ALL SELECT DISTINCT context_id, 'body', [2, 0], chr(10) || chr(10) || '## Open Tasks' || chr(10) FROM tk
 UNION ALL SELECT context_id, 'body', [2, place], '- [' || left(CAST(id AS VARCHAR), 8) || '] (' || task_type || ') ' || title FROM tk WHERE place <= 20
 UNION ALL SELECT DISTINCT context_id, 'body', [3, 0], chr(10) || chr(10) || '## File: ' || file_path || chr(10) FROM fl
 UNION ALL SELECT context_id, 'body', [3, number], '  - ' || day || ' ' || type || ': ' || title FROM fl),
{_packed('context_id', 300, briefing.CUT_CONTEXT)}
SELECT context_id, text, length(text) // 4 AS tokens, 4 * (length(text) // 4) AS tokens_saved, truncated FROM packed""")
def _(b):
    items = b.table("benchmark").select(F.col("item_id").alias("context_id"), F.substring("text", 1, 40).alias("focus"))
    live = b.entities.filter("not archived").select("project_id", "id", "type", F.col("title").alias("detail"), "updated_s")
    hits = items.withColumn("project_id", F.concat(F.lit("src"), F.col("context_id") % 20)).join(live, "project_id")
    hits = hits.withColumn("place", F.row_number().over(Window.partitionBy("context_id").orderBy(F.col("updated_s").desc(), "id"))).filter("place <= 10")
    tasks = items.withColumn("_k", F.col("context_id") % 50).join(b.tasks.filter("status = 'pending'").withColumn("_k", F.col("id") % 50), "_k")
    tasks = tasks.select("context_id", "id", "task_type", F.concat(F.lit("task of "), F.col("model")).alias("title"), "created_s")
    path = b.files.agg(F.min("file_path").alias("asked"))
    line = b.files.join(F.broadcast(path), F.col("file_path") == F.col("asked")).join(b.entities.select(F.col("id").alias("entity_id"), "type", "title", "created_s"), "entity_id")
    line = line.select("file_path", F.row_number().over(Window.partitionBy("file_path").orderBy("created_s", "entity_id")).alias("number"), F.date_format(F.timestamp_seconds("created_s"), "yyyy-MM-dd").alias("day"), "type", "title")
    timelines = items.select("context_id").join(F.broadcast(line))
    return briefing.compiled(briefing.context_parts(items, hits, tasks, timelines), 300)


@query("j7_compile_context", f"""{_BRIEF},
w AS (SELECT project_id, string_agg(title, chr(10) || chr(10) ORDER BY rank) AS t FROM sel GROUP BY project_id)
SELECT project_id, substr(t, 1, 800) AS text, length(substr(t, 1, 800)) // 4 AS tokens, 4 * (length(substr(t, 1, 800)) // 4) AS tokens_saved FROM w""")
def _(b):
    return briefing.compile_context(selected(b).selectExpr("project_id", "rank as number", "title as text"), 800)


@query("a12_usage_calls", f"""{_BRIEF},
w AS (SELECT project_id, string_agg(title, chr(10) || chr(10) ORDER BY rank) AS t FROM sel GROUP BY project_id)
SELECT project_id, 'compile_context' AS tool_name, 4 * (length(substr(t, 1, 800)) // 4) AS tokens_saved, {NOW} AS called_s FROM w""")
def _(b):
    contexts = briefing.compile_context(selected(b).selectExpr("project_id", "rank as number", "title as text"), 800)
    return briefing.usage_calls(contexts, "compile_context", NOW)


@query("j8_overview", """
n AS (SELECT project_id, arg_max(content, id) AS note FROM mem_entities WHERE pinned GROUP BY project_id)
SELECT p.project_id, substr(coalesce(note, ''), 1, 2000) AS overview FROM (SELECT DISTINCT project_id FROM mem_entities) p LEFT JOIN n ON p.project_id = n.project_id""")
def _(b):
    notes = b.entities.filter("pinned").groupBy("project_id").agg(F.max_by("content", "id").alias("note"))
    return briefing.overview(b.entities.select("project_id").distinct(), notes)


# ---- retention and corpora
_PROTECTED = "prot AS (SELECT DISTINCT unnest([(id % 90) * 100, (id % 90) * 100 + 1]) AS event_id FROM mem_entities WHERE pinned OR (type = 'todo' AND status = 'open'))"


def sourced(b):
    return b.entities.withColumn("source_event_ids", F.expr("array((id % 90) * 100, (id % 90) * 100 + 1)")).withColumn("source_event_id", F.lit(None).cast("bigint"))


@query("k1_archivable_events", f"""{_PROTECTED}
SELECT event_id, session_id FROM mem_events e WHERE ts_s < {NOW} - 86400 AND EXISTS (SELECT 1 FROM mem_summaries s WHERE s.session_id = e.session_id AND e.ts_s BETWEEN start_s AND end_s) AND event_id NOT IN (SELECT event_id FROM prot)""")
def _(b):
    return retention.archivable_events(b.events, b.summaries, retention.protected_events(sourced(b)), NOW).select("event_id", "session_id")


@query("k2_protected_events", f"{_PROTECTED} SELECT event_id FROM prot")
def _(b):
    return retention.protected_events(sourced(b))


@query("k3_archivable_summaries", f"SELECT id FROM mem_summaries WHERE level = 'chunk' AND end_s < {NOW} - 604800 AND session_id IN (SELECT session_id FROM mem_summaries WHERE level = 'session')")
def _(b):
    return retention.archivable_summaries(b.summaries, NOW).select("id")


@query("k4_archivable_entities", f"SELECT id FROM mem_entities WHERE NOT archived AND updated_s < {NOW} - 36 * 86400 AND NOT pinned AND NOT {_OPEN}")
def _(b):
    return retention.archivable_entities(b.entities, NOW, 36).select("id")


@query("k6_compact", f"""{_PROTECTED}
SELECT {NOW} AS run_s, (SELECT count(*) FROM mem_events e WHERE ts_s < {NOW} - 86400 AND EXISTS (SELECT 1 FROM mem_summaries s WHERE s.session_id = e.session_id AND e.ts_s BETWEEN start_s AND end_s) AND event_id NOT IN (SELECT event_id FROM prot)) AS events_archived,
 (SELECT count(*) FROM mem_summaries WHERE level = 'chunk' AND end_s < {NOW} - 604800 AND session_id IN (SELECT session_id FROM mem_summaries WHERE level = 'session')) AS summaries_archived,
 (SELECT count(*) FROM mem_entities WHERE NOT archived AND updated_s < {NOW} - 30 * 86400 AND NOT pinned AND NOT {_OPEN}) AS entities_archived""")
def _(b):
    return retention.compact(b.events, b.summaries, sourced(b), NOW)


_CORPORA = """
flt AS (SELECT project_id AS corpus_id, project_id, CASE WHEN project_id < 'src5' THEN ['todo', 'fact', 'decision'] END AS types, CASE WHEN project_id > 'src3' THEN 1704067200 + 60000 END AS since_s, CASE WHEN project_id > 'src2' THEN 'THE' END AS query, file FROM (SELECT DISTINCT project_id FROM mem_entities)
  LEFT JOIN (SELECT project_id, min(file_path) AS file FROM mem_files JOIN mem_entities ON id = entity_id WHERE project_id > 'src7' OR project_id = 'src10' GROUP BY project_id) USING (project_id)),
ck AS (SELECT corpus_id, query, file, e.*, row_number() OVER (PARTITION BY corpus_id ORDER BY created_s DESC, id DESC) AS n FROM mem_entities e JOIN flt ON e.project_id = flt.project_id WHERE NOT archived AND (types IS NULL OR list_contains(types, type)) AND (since_s IS NULL OR created_s >= since_s)),
mem AS (SELECT corpus_id, id, title, content, created_s, type FROM ck WHERE n <= 200 AND (query IS NULL OR contains(lower(concat_ws(' ', title, content)), lower(query))) AND (file IS NULL OR EXISTS (SELECT 1 FROM mem_files AS m WHERE m.entity_id = ck.id AND m.file_path = ck.file)))"""


def members(b):
    own = b.files.join(b.entities.selectExpr("id as entity_id", "project_id"), "entity_id").filter("project_id > 'src7' or project_id = 'src10'").groupBy("project_id").agg(F.min("file_path").alias("file"))
    filters = b.entities.select("project_id").distinct().selectExpr("project_id as corpus_id", "project_id", "if(project_id < 'src5', array('todo', 'fact', 'decision'), null) as types", "if(project_id > 'src3', 1704067200L + 60000, null) as since_s", "if(project_id > 'src2', 'THE', null) as query").join(own, "project_id", "left")
    return corpus.build_corpora(filters, b.entities, b.files), filters


@query("l1_build_corpora", f"{_CORPORA} SELECT corpus_id, id FROM mem")
def _(b):
    return members(b)[0]


@query("l1_corpus_sizes", f"{_CORPORA} SELECT corpus_id, count(*) AS entities, CAST(sum(length(content) // 4) AS BIGINT) AS tokens, sum(length(content) // 4) > 30000 AS warn FROM mem GROUP BY corpus_id")
def _(b):
    return corpus.corpus_sizes(members(b)[0], b.entities)


@query("l2_corpus_text", f"{_CORPORA} SELECT corpus_id, string_agg('[' || type || '] ' || title, chr(10) ORDER BY created_s, id) AS text FROM mem GROUP BY corpus_id")
def _(b):
    return corpus.corpus_text(members(b)[0], b.entities)


@query("l3_rebuild", f"{_CORPORA} SELECT corpus_id, id FROM mem")
def _(b):
    found, filters = members(b)
    ids = filters.filter("corpus_id < 'src3'").select("corpus_id")
    return corpus.rebuild(found, filters, b.entities, b.files, ids)


@query("l4_ask", f"{_CORPORA} SELECT corpus_id, 'What?' AS question, length(string_agg('[' || type || '] ' || title, chr(10) ORDER BY created_s, id)) + 17 AS n FROM mem GROUP BY corpus_id")
def _(b):
    texts = corpus.corpus_text(members(b)[0], b.entities)
    out = corpus.ask(texts, texts.selectExpr("corpus_id", "'What?' as question"), _answers)
    return out.select("corpus_id", "question", F.regexp_extract("response", r"length (\d+)", 1).cast("long").alias("n"))
