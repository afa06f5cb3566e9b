"""Transcripts: JSON lines from files or a stream of files, mapped to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.operators.ingest import TOOL_ARGS, truncate, truncate_head_tail

# Record types that carry no event.
SKIPPED = ("summary", "file-history-snapshot", "queue-operation", "progress")


def parsed(lines: DataFrame) -> DataFrame:
    """source, line and record of lines that are JSON objects."""
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    out = lines.select(name.alias("source"), "line_no", F.expr("try_parse_json(value)").alias("record"))
    return out.filter("record is not null and schema_of_variant(record) like 'OBJECT%'")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_no, record): one row for each valid line, source being the file's stem; malformed lines are skipped.

    Lines are numbered by their place in the file's blocks, in order within each file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("_at"))
    number = F.row_number().over(Window.partitionBy("path").orderBy("_at")) - 1
    return parsed(lines.filter("trim(value) <> ''").withColumn("line_no", number))


def stream_transcripts(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The same as a stream: new files of a folder. A file must not change once it is there, so a growing transcript is to be
    rotated into files; the checkpoint keeps what has been read."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).select("value", F.col("_metadata.file_path").alias("path"), F.lit(None).cast("int").alias("line_no"))
    return parsed(lines.filter("trim(value) <> ''"))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def map_transcript(records: DataFrame) -> DataFrame:
    """Events of records: (source, line_no, number, ts, type, content, tool_use_id, tool_name).

    A user's text is a prompt, its tool results results; an assistant's text is a response and its tool uses calls,
    ``name(arguments)``. Meta and system records and thinking blocks give nothing.
    """
    r = F.col("record")
    kind = _text(r, "$.type")
    known = records.select("source", "line_no", kind.alias("kind"), _text(r, "$.timestamp").alias("ts"), F.coalesce(F.try_variant_get(r, "$.isMeta", "boolean"), F.lit(False)).alias("meta"), F.try_variant_get(r, "$.message.content", "variant").alias("content"))
    known = known.filter(F.col("kind").isin("user", "assistant") & ~((F.col("kind") == "user") & F.col("meta")))
    shape = F.schema_of_variant("content")
    plain = known.filter(shape == "STRING").withColumn("text", F.trim(F.try_variant_get("content", "$", "string"))).filter("text <> ''")
    first = plain.select("source", "line_no", F.lit(0).alias("number"), "ts", F.when(F.col("kind") == "user", "prompt").otherwise("response").alias("type"), F.col("text").alias("content"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("string").alias("tool_name"))
    blocks = known.filter(shape.startswith("ARRAY")).select("source", "line_no", "kind", "ts", F.posexplode(F.try_variant_get("content", "$", "array<variant>")).alias("number", "block"))
    b = F.col("block")
    inner = F.try_variant_get(b, "$.content", "array<variant>")
    joined = F.array_join(F.filter(F.transform(inner, lambda x: F.when(F.try_variant_get(x, "$.type", "string") == "text", F.try_variant_get(x, "$.text", "string"))), lambda t: t.isNotNull() & (t != "")), "\n")
    is_text = F.schema_of_variant(F.try_variant_get(b, "$.content", "variant")) == "STRING"
    result = F.when(is_text, _text(b, "$.content")).otherwise(joined)
    args = F.to_json(F.coalesce(F.try_variant_get(b, "$.input", "variant"), F.parse_json(F.lit("{}"))))
    name = F.coalesce(_text(b, "$.name"), F.lit("unknown"))
    shown = (
        F.when((F.col("kind") == "user") & (_text(b, "$.type") == "tool_result"), F.struct(F.lit("tool_result").alias("type"), truncate_head_tail(result).alias("content"), _text(b, "$.tool_use_id").alias("id"), F.lit(None).cast("string").alias("name")))
        .when((F.col("kind") == "assistant") & (_text(b, "$.type") == "text"), F.struct(F.lit("response").alias("type"), _text(b, "$.text").alias("content"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name")))
        .when((F.col("kind") == "assistant") & (_text(b, "$.type") == "tool_use"), F.struct(F.lit("tool_call").alias("type"), F.concat(name, F.lit("("), truncate(args, TOOL_ARGS), F.lit(")")).alias("content"), _text(b, "$.id").alias("id"), name.alias("name")))
    )
    rest = blocks.withColumn("e", shown).filter("e is not null and trim(coalesce(e.content, '')) <> ''")
    return first.union(rest.select("source", "line_no", "number", "ts", "e.type", "e.content", F.col("e.id").alias("tool_use_id"), F.col("e.name").alias("tool_name")))


def resolve_tool_names(events: DataFrame) -> DataFrame:
    """Events with tool_name of results filled in from the call with the same id before them; the first result takes it."""
    order = F.struct("line_no", "number")
    calls = events.filter("type = 'tool_call' and tool_use_id is not null").select("source", "tool_use_id", F.col("tool_name").alias("_name"), order.alias("_use"))
    results = events.filter("type = 'tool_result' and tool_use_id is not null").select("source", "tool_use_id", "line_no", "number")
    met = results.join(calls, ["source", "tool_use_id"]).filter(F.struct("line_no", "number") > F.col("_use"))
    met = met.withColumn("_n", F.row_number().over(Window.partitionBy("source", "tool_use_id").orderBy("line_no", "number", F.col("_use").desc()))).filter("_n = 1").select("source", "line_no", "number", "_name")
    return events.join(met, ["source", "line_no", "number"], "left").withColumn("tool_name", F.coalesce("_name", "tool_name")).drop("_name")


def transcript_models(records: DataFrame) -> DataFrame:
    """(source, model): the first model that an assistant record names."""
    r = F.col("record")
    rows = records.filter(_text(r, "$.type") == "assistant").select("source", "line_no", _text(r, "$.message.model").alias("model")).filter("model is not null")
    return rows.groupBy("source").agg(F.min_by("model", "line_no").alias("model"))


def tool_call_counts(events: DataFrame, name: str) -> DataFrame:
    """(source, calls) of one tool."""
    return events.groupBy("source").agg(F.count_if((F.col("type") == "tool_call") & (F.col("tool_name") == name)).alias("calls"))
