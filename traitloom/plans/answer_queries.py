"""Responses, merge, gaps, tables and provenance, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx, values as vl
from ..operators import merge, planning, provenance as prov, responses as rs, runs, schema as sc, table as tb
from ..session import scratch, settle, tidy
from ..sources import scans, sinks
from . import inputs as src
from .registry import DELIVERY_DESC, over, query

LONG_COLUMNS = "run_no, line_id, group_name, trait_name"
BLOCK = dict(
    provider="alpha", model="m-1", schema_name="m", schema_version="v1", tool_version="1", created="2024-01-01T00:00:00Z")


# -- classify and reject ------------------------------------------------------


@query("split_status", over("delivery", """
SELECT CASE WHEN failed THEN error_text ELSE 'ok' END AS detail, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(input_tokens) AS BIGINT) AS tokens FROM delivery GROUP BY 1"""))
def split_status(spark: SparkSession, sf: str) -> DataFrame:
    ok, bad = rs.split_status(src.deliveries(spark, sf))
    both = ok.select(F.lit("ok").alias("detail"), "input_tokens").unionByName(bad.select("detail", "input_tokens"))
    return both.groupBy("detail").agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("tokens"))


def _output_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Batch output lines: refusals, HTTP errors, reasoning items and split text occur."""
    raw = src.deliveries(spark, sf)
    part = F.col("l_partkey")

    def piece(kind: str, text, refusal=None):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"),
                        (refusal if refusal is not None else F.lit(None).cast("string")).alias("refusal"))
    message = F.struct(F.lit("message").alias("type"), F.when(
        part % 53 == 0, F.array(piece("refusal", F.lit(None).cast("string"), F.lit("no"))))
        .when(part % 59 == 0, F.array().cast("array<struct<type:string,text:string,refusal:string>>"))
        .otherwise(F.array(piece("output_text", F.lit("half ")), piece("output_text", F.col("custom_id")))).alias("content"))
    thought = F.struct(F.lit("reasoning").alias("type"), F.array(piece("output_text", F.lit("hidden"))).alias("content"))
    code = F.when(part % 61 == 0, 500).when(part % 67 == 0, 400).otherwise(200)
    inner = F.when(part % 67 == 0, F.struct(F.lit("bad_request").alias("code"), F.lit("schema").alias("message")))
    usage = F.struct("input_tokens", "output_tokens", F.struct("cached_tokens").alias("input_tokens_details"))
    response = F.when(part % 71 != 0, F.struct(
        code.alias("status_code"),
        F.struct(F.array(thought, message).alias("output"), usage.alias("usage"), inner.alias("error")).alias("body")))
    failed = F.col("result_type") != "succeeded"
    return raw.select(
        F.concat("custom_id", F.lit("@"), F.col("run_no").cast("string")).alias("custom_id"), *src.DELIVERY,
        F.when(failed, F.struct(F.col("error_type").alias("code"), F.col("error_message").alias("message"))).alias("error"),
        F.when(~failed, response).alias("response"))


_CLASSIFIED = """+ outcome AS (SELECT *,
  CASE WHEN failed THEN CASE WHEN l_suppkey % 2 = 0 THEN 'overloaded_error' ELSE 'error' END || ': try later ' || shard_no
    WHEN l_partkey % 71 = 0 THEN 'HTTP no-response'
    WHEN l_partkey % 61 = 0 AND l_partkey % 67 = 0 THEN 'bad_request: schema'
    WHEN l_partkey % 61 = 0 THEN 'HTTP 500'
    WHEN l_partkey % 67 = 0 THEN 'bad_request: schema'
    WHEN l_partkey % 53 = 0 THEN 'refusal: no'
    WHEN l_partkey % 59 = 0 THEN 'no output_text in response' END AS detail
  FROM delivery)"""
_COUNTED = """, counted AS (SELECT *, NOT failed AND l_partkey % 71 <> 0
    AND NOT (l_partkey % 61 = 0 AND l_partkey % 67 <> 0) AS has_usage FROM outcome) """


@query("classify_response", over("delivery", _CLASSIFIED + _COUNTED + """
SELECT coalesce(detail, 'ok') AS detail, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CASE WHEN detail IS NULL THEN length('half ' || custom_id) ELSE 0 END) AS BIGINT) AS chars,
  CAST(sum(CASE WHEN has_usage THEN input_tokens ELSE 0 END) AS BIGINT) AS input_tokens,
  CAST(sum(CASE WHEN has_usage THEN coalesce(cached_tokens, 0) ELSE 0 END) AS BIGINT) AS cached_tokens
FROM counted GROUP BY 1"""))
def classify_response(spark: SparkSession, sf: str) -> DataFrame:
    done = rs.classify_response(_output_lines(spark, sf))
    return done.groupBy(F.coalesce("detail", F.lit("ok")).alias("detail")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("cached_tokens").alias("cached_tokens"))


@query("scan_results", over("delivery", _CLASSIFIED + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY custom_id, run_no ORDER BY {DELIVERY_DESC}) AS rn FROM outcome),
ok AS (SELECT * FROM outcome WHERE NOT failed QUALIFY row_number() OVER (PARTITION BY custom_id, run_no ORDER BY {DELIVERY_DESC}) = 1),
bad AS (SELECT * FROM outcome WHERE failed QUALIFY row_number() OVER (PARTITION BY custom_id, run_no ORDER BY {DELIVERY_DESC}) = 1),
kept AS (SELECT custom_id, run_no, detail FROM ok UNION ALL
  SELECT custom_id, run_no, detail FROM bad b WHERE NOT EXISTS (
    SELECT 1 FROM ok WHERE ok.custom_id = b.custom_id AND ok.run_no = b.run_no))
SELECT custom_id || '@' || run_no AS custom_id, coalesce(detail, 'ok') AS detail FROM kept"""))
def scan_results(spark: SparkSession, sf: str) -> DataFrame:
    """Written as output and error files of JSON lines, then read back."""
    lines = rs.latest(
        _output_lines(spark, sf).withColumn("failed", F.col("error").isNotNull()),
        ["custom_id", "failed"], src.DELIVERY, ["error", "response"])
    ok, err = scratch(spark, "ok"), scratch(spark, "err")
    with tidy(spark):
        lines.where(~F.col("failed")).drop("failed").write.option("compression", "gzip").json(ok)
        lines.where("failed").drop("failed").write.option("compression", "gzip").json(err)
    done = rs.classify_response(scans.read_results(spark, ok, err))
    return done.select("custom_id", F.coalesce("detail", F.lit("ok")).alias("detail"))


@query("text_parts", """
SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS answer,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS chars
FROM conversations GROUP BY 1""")
def text_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as content blocks; assistant turns are the text blocks.

    Blocks are joined per piece of a conversation, and the pieces put together
    in order, so a very long conversation is never gathered as one block list.
    """
    from ..operators.reports import assemble_text
    turns = src.table(spark, sf, "conversations")
    block = F.array(F.struct(F.when(F.col("role") == "assistant", "text").otherwise("thinking").alias("type"), F.col("text")))
    one = turns.withColumn("part_text", tx.text_parts(block)).withColumn("kept", F.col("role") == "assistant")
    joined = assemble_text(one.where("kept"), ["conv_id"], ["turn"], "part_text", "\n")
    chars = one.groupBy("conv_id").agg(F.sum(F.length("part_text")).alias("chars"))
    return chars.join(joined, "conv_id", "left").select(
        "conv_id", F.coalesce("text", F.lit("")).alias("answer"), "chars")


@query("reserved_keys", over("newest", """
SELECT run_no, CAST(count(*) AS BIGINT) AS answers, CAST(count(*) FILTER (shard_no = 2 AND l_partkey % 11 = 0) AS BIGINT) AS reserved
FROM newest GROUP BY 1"""))
def reserved_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.explode(F.map_keys(F.try_variant_get("obj", "$", "map<string,variant>"))).alias("key")
    top = src.answers(spark, sf).select("run_no", keys)
    hit = vl.is_reserved(F.col("key"))
    return top.groupBy("run_no").agg(F.count_if(~hit).alias("answers"), F.count_if(hit).alias("reserved"))


@query("reject_reason", over("delivery", """
SELECT CASE WHEN l_suppkey % 19 = 0 THEN 'length' WHEN l_suppkey % 23 = 0 THEN 'reasoning leak' ELSE 'usable' END AS reason,
  CAST(count(*) AS BIGINT) AS n FROM delivery WHERE NOT failed GROUP BY 1"""))
def reject_reason(spark: SparkSession, sf: str) -> DataFrame:
    ok, _ = rs.split_status(src.deliveries(spark, sf))
    reason = rs.reject_reason(F.col("finish_reason"), F.col("reasoning"), F.lit(None).cast("string"))
    return ok.groupBy(F.coalesce(reason, F.lit("usable")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("is_transient", """
SELECT event_type, 400 + CAST(event_id % 130 AS INTEGER) AS status,
  (400 + event_id % 130) IN (408, 409, 425, 429, 500, 502, 503, 504, 529) OR event_type = 'signup' AS transient,
  CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2, 3""")
def is_transient(spark: SparkSession, sf: str) -> DataFrame:
    from ..constants import OVERLOADED_STATUS
    status = (F.lit(400) + F.col("event_id") % 130).cast("int")
    kind = F.when(F.col("event_type") == "signup", "connection")
    flagged = src.table(spark, sf, "events").select(
        "event_type", status.alias("status"), vl.is_transient(status, kind, (OVERLOADED_STATUS,)).alias("transient"))
    return flagged.groupBy("event_type", "status", "transient").agg(F.count(F.lit(1)).alias("n"))


@query("is_size_limit", """
SELECT event_type, event_id % 5 IN (0, 1, 3) AS size_limit, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2""")
def is_size_limit(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array(F.lit("Schema EXCEEDS LIMIT OF 100"), F.lit("too complex here"), F.lit("additionalProperties is required"),
                    F.lit("Too Many enum values"), F.lit("to many"))
    message = F.concat(F.get(words, (F.col("event_id") % 5).cast("int")), F.lit(" "), F.col("event_type"))
    return src.table(spark, sf, "events").groupBy(
        "event_type", vl.is_size_limit(message).alias("size_limit")).agg(F.count(F.lit(1)).alias("n"))


@query("split_rejects", over("delivery", """
SELECT CASE WHEN failed THEN 'api error' WHEN cut THEN 'parse error' ELSE 'ok' END AS status, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CASE WHEN failed THEN length('[ERROR ' || error_text || ']') ELSE 0 END) AS BIGINT) AS error_chars
FROM delivery GROUP BY 1"""))
def split_rejects(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = rs.split_rejects(src.parsed(spark, sf))
    both = good.select("status", F.lit(None).cast("string").alias("kept")).unionByName(bad.select("status", "kept"))
    return both.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("status") == "api error", F.length("kept")).otherwise(0)).alias("error_chars"))


# -- text and id functions on answers ----------------------------------------


@query("strip_code_fence", over("delivery", """
SELECT run_no, l_suppkey % 5 = 0 AS fenced, CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (NOT cut) AS BIGINT) AS whole
FROM delivery WHERE NOT failed GROUP BY 1, 2"""))
def strip_code_fence(spark: SparkSession, sf: str) -> DataFrame:
    ok, _ = rs.split_status(src.deliveries(spark, sf))
    bare = tx.strip_code_fence(F.col("text"))
    return ok.groupBy("run_no", F.col("text").startswith("```").alias("fenced")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bare.startswith("{") & bare.endswith("}}}")).alias("whole"))


@query("split_custom_id", over("delivery", """
SELECT line_id, shard_id, CAST(count(*) AS BIGINT) AS n FROM delivery GROUP BY 1, 2"""))
def split_custom_id(spark: SparkSession, sf: str) -> DataFrame:
    ids = src.deliveries(spark, sf).select(vl.split_custom_id(F.col("custom_id")).alias("id"))
    return ids.groupBy("id.line_id", "id.shard_id").agg(F.count(F.lit(1)).alias("n"))


@query("parse_value", over("merged", """
SELECT run_no, group_name, trait_name, CAST(count(*) AS BIGINT) AS cells, CAST(count(num) AS BIGINT) AS numbers,
  round(sum(num), 6) AS total FROM merged GROUP BY 1, 2, 3"""))
def parse_value(spark: SparkSession, sf: str) -> DataFrame:
    return src.records(spark, sf).groupBy("run_no", "group_name", "trait_name").agg(
        F.count(F.lit(1)).alias("cells"), F.count("num").alias("numbers"), F.round(F.sum("num"), 6).alias("total"))


# -- keep the newest, merge, gaps ------------------------------------------


@query("latest", over("delivery", f"""
SELECT run_no, custom_id, source, input_tokens, output_tokens FROM delivery
QUALIFY row_number() OVER (PARTITION BY run_no, custom_id ORDER BY (source = 'fresh') DESC, {DELIVERY_DESC}) = 1"""))
def latest(spark: SparkSession, sf: str) -> DataFrame:
    raw = src.deliveries(spark, sf).withColumn("is_fresh", F.col("source") == "fresh")
    return rs.latest(raw, ["run_no", "custom_id"], ["is_fresh", *src.DELIVERY], ["source", "input_tokens", "output_tokens"])


@query("union_latest", over("delivery newest", """+ known AS (
  SELECT run_no, line_id, shard_id, bool_or(source = 'partial') AS adopted FROM delivery WHERE NOT failed AND NOT cut GROUP BY 1, 2, 3)
SELECT n.run_no, n.line_id, n.shard_id, n.source = 'fresh' AS is_fresh, k.adopted, n.l_partkey, n.l_extendedprice
FROM newest n JOIN known k USING (run_no, line_id, shard_id)"""))
def union_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Prior answers and those of this run as two tables."""
    key = ["run_no", "line_id", "shard_id"]
    good, _ = rs.split_rejects(src.parsed(spark, sf))
    old, new = (good.where(F.col("source") == s).select(*key, *src.DELIVERY) for s in ("partial", "fresh"))
    return rs.union_latest(old, new, key, src.DELIVERY).select(
        "run_no", "line_id", "shard_id", "is_fresh", "adopted", "l_partkey", "l_extendedprice")


@query("merge_records", over("merged", """
SELECT run_no, line_id, group_ord, trait_ord, group_name, trait_name, scale_type, rationale, raw, num FROM merged"""))
def merge_records(spark: SparkSession, sf: str) -> DataFrame:
    return src.records(spark, sf).select(
        "run_no", "line_id", "group_ord", "trait_ord", "group_name", "trait_name", "scale_type", "rationale", "raw", "num")


def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    return src.missing(spark, sf)


@query("gaps", over("gap", "SELECT * FROM gap"))
def gaps(spark: SparkSession, sf: str) -> DataFrame:
    return _gaps(spark, sf)


@query("gap_errors", over("gap err", """
SELECT * FROM err e WHERE EXISTS (SELECT 1 FROM gap g WHERE g.run_no = e.run_no AND g.line_id = e.line_id)"""))
def gap_errors(spark: SparkSession, sf: str) -> DataFrame:
    return merge.gap_errors(src.errors(spark, sf), _gaps(spark, sf), src.RUN_LINE)


_REPORT = over("gap err", """+ m AS (
  SELECT run_no, line_id, string_agg(group_name || '.' || trait_name, ',' ORDER BY group_ord, trait_ord) AS missing,
    CAST(count(*) AS BIGINT) AS n FROM gap GROUP BY 1, 2),
e AS (SELECT run_no, line_id, string_agg(error, ' | ' ORDER BY error) AS errors FROM err GROUP BY 1, 2)
SELECT m.run_no, m.line_id, missing, n, coalesce(errors, '') AS errors FROM m LEFT JOIN e USING (run_no, line_id)""")


def _report_rows(report: DataFrame) -> DataFrame:
    names = F.transform("missing_traits", lambda t: F.concat(t["group"], F.lit("."), t["trait"]))
    return report.select(
        "run_no", "line_id", F.array_join(names, ",").alias("missing"), F.size("missing_traits").cast("long").alias("n"),
        F.array_join("shard_errors", " | ").alias("errors"))


@query("gap_report", _REPORT)
def gap_report(spark: SparkSession, sf: str) -> DataFrame:
    missing = _gaps(spark, sf)
    return _report_rows(merge.gap_report(missing, src.errors(spark, sf), src.RUN_LINE))


@query("write_gaps", _REPORT)
def write_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Gap reports written as JSON lines and read back."""
    path = scratch(spark, "gaps")
    report = merge.gap_report(_gaps(spark, sf), src.errors(spark, sf), src.RUN_LINE)
    sinks.write_gaps(report, path)
    return _report_rows(spark.read.schema(report.schema).json(path))


@query("merge_totals", over("run_line gap", """
SELECT (SELECT count(*) FROM run_line) AS written,
  (SELECT count(*) FROM (SELECT DISTINCT run_no, line_id FROM gap)) AS plants_with_gaps, (SELECT count(*) FROM gap) AS total_gaps"""))
def merge_totals(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merged_totals(src.merged(spark, sf)[0])


# -- record documents, partial store, requests -----------------------------------


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return merge.record_documents(src.run_lines(spark, sf), src.merged(spark, sf), src.RUN_LINE, merge.provenance_block(**BLOCK))


def _unnested(documents: DataFrame, keys: list[str]) -> DataFrame:
    leaves = tb.flatten_leaves(documents.withColumn("obj", F.try_parse_json("body")), keys, max_depth=2)
    return leaves.select(*keys, F.array_join("path", ".").alias("path"), F.try_variant_get("value", "$", "string").alias("raw"))


@query("write_records", over("merged", """
SELECT run_no, line_id, group_name || '.' || trait_name AS path,
  CASE WHEN scale_type = 'quantitative' THEN CAST(CAST(num AS BIGINT) AS VARCHAR) ELSE raw END AS raw FROM merged"""))
def write_records(spark: SparkSession, sf: str) -> DataFrame:
    """Merged records written as documents, read back and flattened."""
    path = scratch(spark, "records")
    with tidy(spark):
        sinks.write_records(_documents(spark, sf), path)
    back = _unnested(spark.read.parquet(path), src.RUN_LINE)
    return back.withColumn("raw", F.regexp_replace("raw", r"\.0$", ""))


@query("stamp", over("run_line newest", """+ has AS (SELECT DISTINCT run_no, line_id FROM newest)
SELECT r.run_no, r.line_id, 'gamma' AS provider, 'v9' AS schema_version, TRUE AS first_key, 1 AS blocks
FROM run_line r"""))
def stamp(spark: SparkSession, sf: str) -> DataFrame:
    """Documents stamped again by a later run: one block, in front."""
    later = merge.provenance_block(provider="gamma", model="m-9", schema_version="v9")
    again = merge.stamp(_documents(spark, sf), later)
    keys = F.json_object_keys("body")
    return again.select(
        *src.RUN_LINE, F.get_json_object("body", "$._provenance.provider").alias("provider"),
        F.get_json_object("body", "$._provenance.schema_version").alias("schema_version"),
        (F.get(keys, F.lit(0)) == "_provenance").alias("first_key"),
        F.size(F.filter(keys, lambda k: k == "_provenance")).alias("blocks"))


def _supplier_records(spark: SparkSession, sf: str) -> DataFrame:
    """A record per supplier, as the file a scorer would leave."""
    s = src.table(spark, sf, "supplier")
    body = F.concat(F.lit('{"_provenance":{"provider":"alpha"},"firm":{"name":{"rationale":"é","value":"'), F.col("s_name"),
                    F.lit('"},"nation":{"value":'), F.col("s_nationkey").cast("string"), F.lit("}}}"))
    return s.select(src.line_of(F.col("s_suppkey")).alias("line_id"), body.alias("body"), "s_suppkey")


@query("scan_records", """
SELECT 's' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS line_id, x.path,
  CASE x.path WHEN 'firm.name' THEN s_name ELSE CAST(s_nationkey AS VARCHAR) END AS raw
FROM supplier, (VALUES ('firm.name'), ('firm.nation')) x(path)""")
def scan_records(spark: SparkSession, sf: str) -> DataFrame:
    """A directory of record files with gap reports beside them, written and scanned."""
    records = _supplier_records(spark, sf)
    root = scratch(spark, "record_files")
    gap = records.where(F.col("s_suppkey") % 3 == 0).select(
        F.concat("line_id", F.lit(".gaps.json")).alias("name"), F.lit('{"x":{"value":1}}').alias("content"))
    files = records.select(F.concat("line_id", F.lit(".json")).alias("name"), F.col("body").alias("content"))
    sinks.export_files(files.unionByName(gap), root)
    return _unnested(scans.read_records(spark, root), ["line_id"])


@query("scan_partials", """
SELECT 's' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS line_id, 'shard_0' || s.shard_no AS shard_id,
  CAST(s_nationkey AS VARCHAR) AS nation
FROM supplier, (VALUES (1), (2)) s(shard_no) WHERE (s_suppkey + s.shard_no) % 7 <> 0""")
def scan_partials(spark: SparkSession, sf: str) -> DataFrame:
    """A partial store with its run stamp and half-written files."""
    root = scratch(spark, "partial_files")
    parts = _supplier_records(spark, sf).withColumn("shard_no", F.explode(F.array(F.lit(1), F.lit(2))))
    whole = F.when((F.col("s_suppkey") + F.col("shard_no")) % 7 == 0, F.expr("left(body, 20)")).otherwise(F.col("body"))
    name = F.concat(vl.custom_id(F.col("line_id"), F.concat(F.lit("shard_0"), F.col("shard_no").cast("string"))), F.lit(".json"))
    stamp_file = spark.createDataFrame([(".run.json", '{"provider":"alpha"}')], "name string, content string")
    sinks.export_files(parts.select(name.alias("name"), whole.alias("content")).unionByName(stamp_file), root)
    return scans.read_partials(spark, root).select(
        "line_id", "shard_id", F.try_variant_get("obj", "$.firm.nation.value", "string").alias("nation"))


@query("append_partials", over("newest", """
SELECT run_no, line_id, shard_id, source, l_partkey FROM newest"""))
def append_partials(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends to the partial store; reading keeps the newest per key."""
    store = scratch(spark, "partials")
    good, _ = rs.split_rejects(src.parsed(spark, sf))
    rows = good.select("run_no", "line_id", "shard_id", "source", (F.col("source") == "fresh").alias("is_fresh"), *src.DELIVERY)
    sinks.append_partials(rows.where(~F.col("is_fresh")), store)
    sinks.append_partials(rows.where("is_fresh"), store)
    return rs.latest(spark.read.parquet(store), ["run_no", "line_id", "shard_id"], ["is_fresh", *src.DELIVERY], ["source", "l_partkey"])


@query("write_requests", """
SELECT CAST(sum(octet_length(encode('{"custom_id":"c' || conv_id || '__' || turn || '","body":{"role":"' || role || '","n":'
  || length(text) || ',"text":' || CAST(to_json(text) AS VARCHAR) || ',"mark":"é²"}}'))) AS BIGINT) AS bytes, CAST(count(*) AS BIGINT) AS lines FROM conversations""")
def write_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests written as JSON lines in UTF-8 and measured."""
    turns = src.table(spark, sf, "conversations")
    cid = vl.custom_id(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.col("turn").cast("string"))
    rows = turns.select(cid.alias("custom_id"), F.struct(
        "role", F.length("text").alias("n"), "text", F.lit("é²").alias("mark")).alias("body"))
    path = scratch(spark, "requests")
    sinks.write_requests(rows, path, ["custom_id", "body"])
    return spark.read.text(path).agg(F.sum(F.octet_length("value")).alias("bytes"), F.count(F.lit(1)).alias("lines"))


# -- planning ---------------------------------------------------------------


@query("plan_requests", """
SELECT 's' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS line_id, s.n AS shard_ord, 'shard_0' || s.n AS shard_id,
  's' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '__shard_0' || s.n AS custom_id
FROM orders, (VALUES (1), (2), (3)) s(n)""")
def plan_requests(spark: SparkSession, sf: str) -> DataFrame:
    return planning.plan_requests(src.lines(spark, sf), src.shards(spark))


@query("pending", over("newest", """
SELECT r.line_id, r.shard_id FROM (SELECT 's' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS line_id, 'shard_0' || s.n AS shard_id
  FROM orders, (VALUES (1), (2), (3)) s(n)) r
WHERE NOT EXISTS (SELECT 1 FROM newest n WHERE n.line_id = r.line_id AND n.shard_id = r.shard_id)"""))
def pending(spark: SparkSession, sf: str) -> DataFrame:
    requests = planning.plan_requests(src.lines(spark, sf), src.shards(spark))
    good, _ = rs.split_rejects(src.parsed(spark, sf))
    return planning.pending(requests, good.select("custom_id")).select("line_id", "shard_id")


@query("plant_major", """
SELECT CAST(count(*) AS BIGINT) AS requests, 0 AS split_lines, 0 AS out_of_order FROM orders, (VALUES (1), (2), (3)) s(n)""")
def plant_major(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of a line that are not side by side, or not in shard order, in their partition."""
    placed = planning.plant_major(planning.plan_requests(src.lines(spark, sf), src.shards(spark))).withColumn(
        "at", F.monotonically_increasing_id())
    per_line = placed.groupBy("line_id").agg(
        F.max("at").alias("hi"), F.min("at").alias("lo"), F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("at", "shard_ord"))).alias("seq"))
    in_order = F.transform("seq", lambda s: s["shard_ord"]) == F.array_sort(F.transform("seq", lambda s: s["shard_ord"]))
    return per_line.agg(
        F.sum("n").alias("requests"), F.count_if(F.col("hi") - F.col("lo") != F.col("n") - 1).cast("int").alias("split_lines"),
        F.count_if(~in_order).cast("int").alias("out_of_order"))


@query("first_plants", over("run_line", """
SELECT custom_id FROM (SELECT DISTINCT line_id, line_id || '__shard_0' || s.n AS custom_id FROM run_line, (VALUES (1), (2), (3)) s(n))
WHERE line_id IN (SELECT DISTINCT line_id FROM run_line ORDER BY line_id LIMIT 25)"""))
def first_plants(spark: SparkSession, sf: str) -> DataFrame:
    every = src.run_lines(spark, sf).select("line_id").distinct()
    return planning.first_plants(planning.plan_requests(every, src.shards(spark)), 25).select("custom_id")


@query("manifest_order", over("newest", """
SELECT line_id, shard_id, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos, CAST(count(*) AS BIGINT) AS runs
FROM (SELECT row_number() OVER (ORDER BY line_id, shard_no) AS pos, line_id, shard_id FROM newest) GROUP BY 1, 2"""))
def manifest_order(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in manifest order; positions number the rows as the operator put them.

    Runs of one request stand side by side in no fixed order, so they count as one.
    """
    got = src.answers(spark, sf).select("line_id", "shard_id", "run_no")
    from ..operators.ordered import row_numbers
    path = scratch(spark, "ordered")
    planning.manifest_order(got, src.shards(spark)).select(
        F.lit(0).alias("_all"), F.monotonically_increasing_id().alias("at"), "line_id", "shard_id", "run_no").write.parquet(path)
    numbered = row_numbers(spark.read.parquet(path), ["_all"], ["at"], "pos")
    return numbered.groupBy("line_id", "shard_id").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("runs"))


@query("largest", over("delivery", """
SELECT run_no, shard_id, bytes FROM (SELECT run_no, shard_id, CAST(sum(input_tokens) AS BIGINT) AS bytes
  FROM delivery GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY run_no ORDER BY bytes DESC, shard_id) = 1"""))
def largest(spark: SparkSession, sf: str) -> DataFrame:
    sized = src.deliveries(spark, sf).select(
        "run_no", vl.split_custom_id(F.col("custom_id"))["shard_id"].alias("shard_id"), F.col("input_tokens").alias("bytes"))
    return planning.largest(sized, ["run_no"], "bytes", "shard_id")


# -- tables -----------------------------------------------------------------


def _leaves(spark: SparkSession, sf: str) -> DataFrame:
    return tb.flatten_leaves(src.answers(spark, sf), ["run_no", "line_id", "shard_id"], max_depth=3)


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    return tb.type_leaves(_leaves(spark, sf), src.traits(spark))


@query("flatten_leaves", over("leaf", """
SELECT run_no, line_id, shard_id, group_name || '.' || trait_name AS path, raw FROM leaf"""))
def flatten_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return _leaves(spark, sf).select(
        "run_no", "line_id", "shard_id", F.array_join("path", ".").alias("path"),
        F.try_variant_get("value", "$", "string").alias("raw"))


@query("type_leaves", over("typed", """
SELECT run_no, line_id, group_name, trait_name, scale_type, declared, raw, num, text FROM typed"""))
def type_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf).select(
        "run_no", "line_id", "group_name", "trait_name", "scale_type", "declared", "raw", "num", "text")


@query("convert_value", over("typed", """
SELECT group_name, trait_name, coalesce(text, CAST(CAST(num AS BIGINT) AS VARCHAR), '(empty)') AS cell,
  CAST(count(*) AS BIGINT) AS n FROM typed GROUP BY 1, 2, 3"""))
def convert_value(spark: SparkSession, sf: str) -> DataFrame:
    cell = F.coalesce("text", F.col("num").cast("long").cast("string"), F.lit("(empty)"))
    return _typed(spark, sf).groupBy("group_name", "trait_name", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query("decode_ordinal", over("typed", """
SELECT run_no, line_id, raw, text AS label FROM typed WHERE scale_type = 'ordinal'"""))
def decode_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return tb.decode_ordinal(_leaves(spark, sf), src.traits(spark)).select("run_no", "line_id", "raw", "label")


@query("conversion_warnings", over("typed", """
SELECT run_no, line_id, trait_name AS trait, raw,
  CASE scale_type WHEN 'ordinal' THEN 'unknown ordinal code' ELSE 'non-numeric value' END AS kind
FROM typed WHERE raw <> 'not_assessable' AND num IS NULL AND text IS NULL"""))
def conversion_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return tb.conversion_warnings(_typed(spark, sf), src.RUN_LINE)


_WIDE = over("typed run_line", """
SELECT r.run_no, r.line_id,
  max(num) FILTER (trait_name = 'quantity') AS quantity_cm,
  max(text) FILTER (trait_name = 'flag') AS flag, max(text) FILTER (trait_name = 'status') AS status,
  max(num) FILTER (group_name = 'leaf' AND trait_name = 'length') AS leaf_length_mm,
  max(text) FILTER (trait_name = 'discount') AS discount,
  max(num) FILTER (group_name = 'stem' AND trait_name = 'length') AS stem_length_mm,
  max(text) FILTER (trait_name = 'extra') AS extra
FROM run_line r LEFT JOIN typed t USING (run_no, line_id) GROUP BY 1, 2""")


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "leaves")  # read for the columns and again for the cells, each time in part
    tb.line_leaves(src.answered_lines(spark, sf), len(src.SHARDS), src.traits(spark), src.RUN_LINE, max_depth=3).write.parquet(path)
    lines = spark.read.parquet(path)
    return tb.wide_lines(lines, tb.line_columns(lines, src.traits(spark), "prefix_collided"), src.RUN_LINE)


@query("wide_table", _WIDE)
def wide_table(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(spark, sf)


@query("write_table", _WIDE)
def write_table(spark: SparkSession, sf: str) -> DataFrame:
    """The wide table written as Parquet and CSV, read back from Parquet."""
    path = scratch(spark, "wide")
    sinks.write_table(_wide(spark, sf), path, [{"provider": "alpha"}])
    return spark.read.parquet(f"{path}/parquet")


# -- provenance ---------------------------------------------------------------


def _run_records(spark: SparkSession, sf: str) -> DataFrame:
    stamp_row = spark.createDataFrame([("old", "m-0", None)], "provider string, model string, schema_version string")
    return prov.resolve_provenance(src.with_run(src.run_lines(spark, sf)), stamp_row)


@query("resolve_provenance", over("run_info", """
SELECT run_no, line_id, CASE WHEN run_no = 7 THEN 'old' ELSE provider END AS provider,
  CASE WHEN run_no = 7 THEN 'm-0' ELSE model END AS model, schema_version, run_no = 7 AS from_stamp FROM run_info"""))
def resolve_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return _run_records(spark, sf).drop("block")


@query("run_identities", over("run_info", """+ r AS (SELECT line_id || '/' || run_no AS id,
  CASE WHEN run_no = 7 THEN 'old' ELSE provider END AS provider, CASE WHEN run_no = 7 THEN 'm-0' ELSE model END AS model, schema_version
  FROM run_info)
SELECT provider, model, schema_version, CAST(count(*) AS BIGINT) AS records,
  array_to_string((list(id ORDER BY id))[1:4], ',') AS first_ids FROM r GROUP BY 1, 2, 3"""))
def run_identities(spark: SparkSession, sf: str) -> DataFrame:
    named = _run_records(spark, sf).withColumn("id", F.concat_ws("/", "line_id", F.col("run_no").cast("string")))
    return prov.run_identities(named, "id").withColumn("first_ids", F.array_join("first_ids", ","))


@query("provenance_blocks", over("run_info", """+ r AS (SELECT CASE WHEN run_no = 7 THEN '{}' ELSE
  '{"model":"' || model || '","provider":"' || provider || '","schema_version":' || coalesce('"' || schema_version || '"', 'null') || '}' END AS block
  FROM run_info)
SELECT block, CAST(count(*) AS BIGINT) AS records, (SELECT count(DISTINCT block) > 1 FROM r) AS mixed FROM r GROUP BY 1"""))
def provenance_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return prov.provenance_blocks(src.with_run(src.run_lines(spark, sf)))


# -- constraints, tokens, cost ---------------------------------------------------


@query("violations", over("long", """
SELECT run_no, line_id, group_name, trait_name, raw FROM long
WHERE raw IS NOT NULL AND raw <> 'not_assessable' AND (
  trait_name = 'flag' AND raw NOT IN ('A', 'N', 'R') OR trait_name = 'status' AND raw <> 'F'
  OR trait_name = 'discount' AND raw NOT IN ('0', '1', '2', '3', '4', '5', '6', '7', '8', '9', '10'))"""))
def violations(spark: SparkSession, sf: str) -> DataFrame:
    allowed = sc.allowed_values(src.traits(spark))
    return sc.violations(src.records(spark, sf), allowed).select("run_no", "line_id", "group_name", "trait_name", "raw")


@query("token_totals", over("delivery", """
SELECT run_no, shard_id, CAST(count(*) AS BIGINT) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(coalesce(cached_tokens, 0)) AS BIGINT) AS cached_tokens
FROM delivery WHERE source = 'fresh' AND NOT failed GROUP BY 1, 2"""))
def token_totals(spark: SparkSession, sf: str) -> DataFrame:
    ok, _ = rs.split_status(src.deliveries(spark, sf))
    own = ok.where(F.col("source") == "fresh").withColumn("shard_id", vl.split_custom_id(F.col("custom_id"))["shard_id"])
    return runs.token_totals(own, ["run_no", "shard_id"])


@query("cost", over("delivery", """+ t AS (
  SELECT CASE WHEN run_no IN (3, 4) THEN 'm-2' ELSE 'm-1' END AS model, sum(input_tokens) AS i, sum(output_tokens) AS o,
    count(DISTINCT line_id) AS lines FROM delivery WHERE NOT failed GROUP BY 1),
u AS (SELECT *, CASE model WHEN 'm-2' THEN (i * 0.5 + o * 2.0) / 1e6 ELSE (i * 0.2 + o * 1.2) / 1e6 END AS usd FROM t)
SELECT model, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, CAST(lines AS BIGINT) AS lines,
  round(CAST(usd AS DOUBLE), 6) AS usd, round(CAST(usd AS DOUBLE) * 0.5, 6) AS usd_batch,
  round(CAST(usd AS DOUBLE) / lines * 142, 6) AS usd_scaled FROM u"""))
def cost(spark: SparkSession, sf: str) -> DataFrame:
    ok, _ = rs.split_status(src.deliveries(spark, sf))
    model = F.when(F.col("run_no").isin(3, 4), "m-2").otherwise("m-1")
    named = ok.withColumns({"model": model, "line_id": vl.split_custom_id(F.col("custom_id"))["line_id"]})
    lines = named.groupBy("model").agg(F.countDistinct("line_id").alias("lines"))
    tokens = runs.token_totals(named, ["model"]).join(lines, "model").drop("calls", "cached_tokens")
    prices = spark.createDataFrame([("m-1", 0.2, 1.2), ("m-2", 0.5, 2.0)], "model string, usd_in double, usd_out double")
    out = runs.cost(tokens, prices, 142, "lines")
    return out.withColumns({c: F.round(c, 6) for c in ("usd", "usd_batch", "usd_scaled")})
