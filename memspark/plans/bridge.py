"""Bridge views: the driver's tables in the shapes of an agent memory, for Spark and, as SQL text, for DuckDB.

Every view is a deterministic projection. Times are whole seconds (``*_s``).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

E0 = 1704067200
NOW = E0 + 40 * 86400
TYPES = ("decision", "todo", "fact", "failure", "discovery", "feature", "bugfix", "research", "change")


def epoch(c: Column | str) -> Column:
    return F.timestamp_seconds(c)


class Bridge:
    """Lazy bridge views over the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        """event_id, session_id, project_id, type, content, ts_s, token_count."""
        return self.table("conversations").filter("role in ('user', 'assistant')").selectExpr(
            "conv_id * 100 + turn as event_id", "conv_id as session_id", "conv_id % 5 as project_id",
            "if(role = 'user', 'prompt', 'response') as type", "text as content",
            f"{E0} + conv_id * 3600 + turn * 60 as ts_s", "cast(null as bigint) as token_count",
        )

    @cached_property
    def sessions(self) -> DataFrame:
        """session_id, project_id, started_s, ended_s, event_count, status."""
        return self.events.groupBy("session_id", "project_id").agg(
            F.min("ts_s").alias("started_s"), F.max("ts_s").alias("ended_s"), F.count("*").alias("event_count")
        ).withColumn("status", F.lit("ended"))

    @cached_property
    def activity(self) -> DataFrame:
        """event_id, source, ts_s, type, content."""
        return self.table("events").select("event_id", F.col("user_id").alias("source"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts_s"), F.col("event_type").alias("type"), F.col("props").alias("content"))

    @cached_property
    def entities(self) -> DataFrame:
        """The memory's entities, from documents and their labels."""
        docs, labels = self.table("documents"), self.table("labels")
        names = ", ".join(f"'{t}'" for t in TYPES)
        return docs.join(labels, "doc_id", "left").selectExpr(
            "doc_id as id", "lpad(cast(doc_id as string), 8, '0') as short_id", "source as project_id",
            f"element_at(array({names}), cast(doc_id % 9 as int) + 1) as type",
            "trim(substring_index(substring(text, 1, 120), '\\n', 1)) as title", "text as content",
            "case doc_id % 9 when 1 then if(coalesce(quality, 0) = 1, 'done', 'open') when 3 then if(coalesce(quality, 0) = 1, 'resolved', 'unresolved') end as status",
            "element_at(array('high', 'medium', 'low'), cast(doc_id % 3 as int) + 1) as priority",
            "doc_id % 50 = 0 as pinned", "coalesce(toxic, 0) = 1 as stale",
            f"{E0} + doc_id * 600 as created_s", f"{E0} + doc_id * 600 + n_chars as updated_s",
            "doc_id % 4 as cited_count", "doc_id % 40 = 39 as archived", "doc_id % 100 as session_id",
        )

    @cached_property
    def embeddings(self) -> DataFrame:
        """entity_id, type, model, dim, vector."""
        return self.table("embeddings").selectExpr("vec_id as entity_id", "label as type", "if(vec_id % 10 < 9, 'm|', 'old|') as model", "size(embedding) as dim", "embedding as vector")

    @cached_property
    def query_vectors(self) -> DataFrame:
        return self.embeddings.filter("entity_id % 20 = 0").selectExpr("entity_id as query_id", "model", "dim", "vector as query_vector")

    @cached_property
    def summaries(self) -> DataFrame:
        """id, session_id, project_id, level, start_s, end_s, events; chunks of four events and session summaries."""
        order = "row_number() over (partition by session_id order by ts_s, event_id) - 1"
        chunks = self.events.selectExpr("*", f"floor(({order}) / 4) as chunk").groupBy("session_id", "project_id", "chunk").agg(F.min("ts_s").alias("start_s"), F.max("ts_s").alias("end_s"), F.count("*").alias("events"))
        chunks = chunks.selectExpr("session_id * 1000 + chunk as id", "session_id", "project_id", "'chunk' as level", "start_s", "end_s", "events")
        whole = self.sessions.filter("session_id % 2 = 0").selectExpr("session_id * 1000 + 999 as id", "session_id", "project_id", "'session' as level", "cast(null as bigint) as start_s", "cast(null as bigint) as end_s", "event_count as events")
        return chunks.unionByName(whole)

    @cached_property
    def files(self) -> DataFrame:
        """entity_id, file_path, line_number: first anchor of a path."""
        joined = self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        return joined.groupBy(F.col("l_orderkey").alias("entity_id"), self._path.alias("file_path")).agg(F.min("l_linenumber").cast("long").alias("line_number"))

    @property
    def _path(self) -> Column:
        return F.expr("concat('src/', replace(p_brand, 'Brand#', ''), '/', replace(p_type, ' ', '_'), '.py')")

    @cached_property
    def file_paths(self) -> DataFrame:
        """file_path: the different paths of ``files``."""
        used = self.table("lineitem").select("l_partkey").distinct()
        return self.table("part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select(self._path.alias("file_path")).distinct()

    @cached_property
    def tasks(self) -> DataFrame:
        """id, parent_id, model, task_type, status, cost, created_s, eval_score."""
        joined = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return joined.selectExpr(
            "o_orderkey as id", "if(o_orderkey = 0, null, (o_orderkey - 1) div 8) as parent_id", "c_mktsegment as model", "o_orderpriority as task_type",
            "case o_orderstatus when 'F' then 'completed' when 'P' then 'failed' else 'pending' end as status",
            "cast(o_totalprice as double) as cost", "unix_seconds(cast(o_orderdate as timestamp)) as created_s", "(o_orderkey % 101) / 100.0D as eval_score",
        )

    @cached_property
    def models(self) -> DataFrame:
        """model_name, provider, price, quality_tier, tools, regions, blocked, context_window."""
        return self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
            "s_name as model_name", "n_name as provider", "abs(cast(s_acctbal as double)) / 1000 as price",
            "element_at(array('frontier', 'strong', 'standard', 'budget', 'legacy'), cast(s_suppkey % 5 as int) + 1) as quality_tier",
            "s_suppkey % 2 = 0 as tools", "if(s_suppkey % 7 = 0, array('*'), array(cast(s_nationkey % 5 as string), cast(s_nationkey % 3 as string))) as regions",
            "array(cast((s_nationkey + 1) % 5 as string)) as blocked", "(s_suppkey % 8 + 1) * 16000 as context_window",
        )

    @cached_property
    def supersede_edges(self) -> DataFrame:
        """src, dst: an entity and the one that superseded it."""
        return self.entities.filter("id % 7 <> 0").selectExpr("id as src", "id + 1 as dst")

    @cached_property
    def verdicts(self) -> DataFrame:
        """batch, position, id, existing_id, verdict, similarity."""
        return self.entities.filter("id % 3 = 0").selectExpr("id div 12 as batch", "id as position", "id", "(id div 12) * 12 + 1 as existing_id", "element_at(array('UPDATE', 'NOOP', 'CONTRADICTS', 'ADD'), cast(id % 4 as int) + 1) as verdict", "(id % 97) / 97.0D as similarity")


_TYPE_LIST = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"

VIEWS: dict[str, str] = {
    "mem_events": f"""SELECT conv_id * 100 + turn AS event_id, conv_id AS session_id, conv_id % 5 AS project_id,
        CASE WHEN role = 'user' THEN 'prompt' ELSE 'response' END AS type, text AS content,
        {E0} + conv_id * 3600 + turn * 60 AS ts_s, CAST(NULL AS BIGINT) AS token_count FROM conversations WHERE role IN ('user', 'assistant')""",
    "mem_sessions": """SELECT session_id, project_id, min(ts_s) AS started_s, max(ts_s) AS ended_s, count(*) AS event_count, 'ended' AS status
        FROM mem_events GROUP BY session_id, project_id""",
    "mem_activity": "SELECT event_id, user_id AS source, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, event_type AS type, props AS content FROM events",
    "mem_entities": f"""SELECT doc_id AS id, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS short_id, source AS project_id, {_TYPE_LIST}[CAST(doc_id % 9 AS INTEGER) + 1] AS type,
        trim(split_part(substr(text, 1, 120), chr(10), 1)) AS title, text AS content,
        CASE doc_id % 9 WHEN 1 THEN CASE WHEN coalesce(quality, 0) = 1 THEN 'done' ELSE 'open' END WHEN 3 THEN CASE WHEN coalesce(quality, 0) = 1 THEN 'resolved' ELSE 'unresolved' END END AS status,
        ['high', 'medium', 'low'][CAST(doc_id % 3 AS INTEGER) + 1] AS priority, doc_id % 50 = 0 AS pinned, coalesce(toxic, 0) = 1 AS stale,
        {E0} + doc_id * 600 AS created_s, {E0} + doc_id * 600 + n_chars AS updated_s, doc_id % 4 AS cited_count, doc_id % 40 = 39 AS archived, doc_id % 100 AS session_id
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "mem_embeddings": "SELECT vec_id AS entity_id, label AS type, CASE WHEN vec_id % 10 < 9 THEN 'm|' ELSE 'old|' END AS model, len(embedding) AS dim, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings",
    "query_vectors": "SELECT entity_id AS query_id, model, dim, vector AS query_vector FROM mem_embeddings WHERE entity_id % 20 = 0",
    "mem_summaries": """SELECT session_id * 1000 + chunk AS id, session_id, project_id, 'chunk' AS level, min(ts_s) AS start_s, max(ts_s) AS end_s, count(*) AS events
        FROM (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY ts_s, event_id) - 1) // 4 AS chunk FROM mem_events) GROUP BY session_id, project_id, chunk
        UNION ALL SELECT session_id * 1000 + 999, session_id, project_id, 'session', NULL, NULL, event_count FROM mem_sessions WHERE session_id % 2 = 0""",
    "mem_files": """SELECT l_orderkey AS entity_id, 'src/' || replace(p_brand, 'Brand#', '') || '/' || replace(p_type, ' ', '_') || '.py' AS file_path, CAST(min(l_linenumber) AS BIGINT) AS line_number
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "mem_tasks": """SELECT o_orderkey AS id, CASE WHEN o_orderkey = 0 THEN NULL ELSE (o_orderkey - 1) // 8 END AS parent_id, c_mktsegment AS model, o_orderpriority AS task_type,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status, CAST(o_totalprice AS DOUBLE) AS cost,
        CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) AS created_s, CAST(o_orderkey % 101 AS DOUBLE) / 100 AS eval_score FROM orders JOIN customer ON o_custkey = c_custkey""",
    "mem_models": """SELECT s_name AS model_name, n_name AS provider, abs(CAST(s_acctbal AS DOUBLE)) / 1000 AS price, ['frontier', 'strong', 'standard', 'budget', 'legacy'][CAST(s_suppkey % 5 AS INTEGER) + 1] AS quality_tier,
        s_suppkey % 2 = 0 AS tools, CASE WHEN s_suppkey % 7 = 0 THEN ['*'] ELSE [CAST(s_nationkey % 5 AS VARCHAR), CAST(s_nationkey % 3 AS VARCHAR)] END AS regions,
        [CAST((s_nationkey + 1) % 5 AS VARCHAR)] AS blocked, (s_suppkey % 8 + 1) * 16000 AS context_window FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "supersede_edges": "SELECT id AS src, id + 1 AS dst FROM mem_entities WHERE id % 7 <> 0",
    "verdicts": """SELECT id // 12 AS batch, id AS position, id, (id // 12) * 12 + 1 AS existing_id, ['UPDATE', 'NOOP', 'CONTRADICTS', 'ADD'][CAST(id % 4 AS INTEGER) + 1] AS verdict,
        CAST(id % 97 AS DOUBLE) / 97 AS similarity FROM mem_entities WHERE id % 3 = 0""",
}


def with_views(body: str, recursive: bool = False) -> str:
    """The SQL ``body`` with the bridge views it names, and those they name, before it.

    ``body`` may begin with further common table expressions, written as ``name AS (...), ... SELECT``.
    """
    used: set[str] = set()

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in used and name in text.replace("(", " ").replace(")", " ").replace(",", " ").split():
                used.add(name)
                need(VIEWS[name])

    need(body)
    parts = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in used]
    own = body.strip()
    if own[:6].upper() != "SELECT":
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([*parts, own])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + own
