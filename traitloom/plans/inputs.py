"""Views that give the driver tables the shapes of an extraction run.

Every view is derived from the whole of one table, so it grows with it:

* ``deliveries``: one raw response per line item and shard.  The order is the
  subject (line), the line number is the run, and line items that repeat both
  are re-deliveries of the same answer;
* ``progress`` and ``samples``: events as calls and as metric samples;
* ``master_docs``, ``shard_docs``: one trait schema per part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from ..constants import SENTINEL
from ..functions.values import custom_id, error_text
from ..operators.merge import line_answers, merged_lines, missing_traits, present_traits
from ..operators.responses import newest_answers, parse_answers, split_rejects
from ..session import configure

RUNS = [1, 2, 3, 4, 5, 6, 7]
CONFIG_A, CONFIG_B = [1, 2], [3, 4]
RUN_LINE = ["run_no", "line_id"]
SHARDS = ["shard_01", "shard_02", "shard_03"]
#: What makes one delivery later than another.
DELIVERY = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
SCORED = [*DELIVERY, "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
TRAIT_ROWS = [
    # group_ord, group_name, trait_ord, trait_name, scale_type, unit, shard_no
    (1, "whole", 1, "quantity", "quantitative", "cm", 1),
    (2, "leaf", 1, "flag", "nominal", None, 2),
    (2, "leaf", 2, "status", "nominal", None, 2),
    (2, "leaf", 3, "length", "quantitative", "mm", 2),
    (3, "stem", 1, "discount", "ordinal", None, 3),
    (3, "stem", 2, "length", "quantitative", "mm", 3),
]
CATEGORIES = {"flag": ["A", "N", "R"], "status": ["F"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows over all cores when the files give fewer partitions than there are.

    Data of any size comes in more partitions than that and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *columns) if df.rdd.getNumPartitions() < cores else df


def traits(spark: SparkSession) -> DataFrame:
    """The trait schema the answers are scored against."""
    levels = [(i, f"d{i:02d}", f"level {i}") for i in range(11)]
    rows = [
        (*r, levels if r[4] == "ordinal" else None,
         [(v, f"looks {v}") for v in CATEGORIES[r[3]]] if r[4] == "nominal" else None)
        for r in TRAIT_ROWS
    ]
    return spark.createDataFrame(
        rows,
        "group_ord int, group_name string, trait_ord int, trait_name string, scale_type string, unit string, "
        "shard_no int, levels array<struct<level:int,label:string,definition:string>>, "
        "categories array<struct<value:string,definition:string>>")


def shards(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SHARDS, 1)), "shard_ord int, shard_id string")


def line_of(key: Column) -> Column:
    return F.concat(F.lit("s"), F.lpad(key.cast("string"), 12, "0"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested subjects: every order."""
    return table(spark, sf_dir, "orders").select(line_of(F.col("o_orderkey")).alias("line_id"))


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested (run, line) pairs: those of which anything was delivered."""
    return delivered_lines(spark, sf_dir).distinct()


def delivered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (run, line) pair of each delivered item; pairs may repeat."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.col("l_linenumber").alias("run_no"), line_of(F.col("l_orderkey")).alias("line_id"))


# -- raw responses ----------------------------------------------------------


def _whole(c: Column) -> Column:
    return c.cast("int").cast("string")


def _sentinel(group: int, trait: int) -> Column:
    return (F.col("l_suppkey") + 3 * group + trait) % 17 == 0


def _answer(group: int, trait: int, name: str, value: Column, has_value: Column | None = None) -> Column:
    na = F.lit(f'"{SENTINEL}"')
    tail = F.concat(F.lit(',"value":'), F.when(_sentinel(group, trait), na).otherwise(value))
    if has_value is not None:
        tail = F.when(has_value, tail).otherwise("")
    return F.concat(F.lit(f'"{name}":{{"rationale":"'), F.col("rationale"), F.lit('"'), tail, F.lit("}"))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _answer_texts() -> Column:
    """The JSON a model returned for each of the three shards."""
    part = F.col("l_partkey")
    quantity = F.when(part % 31 == 0, F.lit('"about 5"')).otherwise(_quoted(_whole(F.col("l_quantity"))))
    leaf_length = F.when(part % 47 == 0, F.lit("null")).otherwise(_quoted(_whole(F.round(F.col("l_tax") * 100))))
    discount = F.when(part % 29 == 0, F.lit("99")).otherwise(_whole(F.round(F.col("l_discount") * 100)))
    one = F.concat(F.lit('{"whole":{'), _answer(1, 1, "quantity", quantity), F.lit("}}"))
    extra = F.when(part % 13 == 0, ',"extra":{"rationale":"new","value":"seen"}').otherwise("")
    note = F.when(part % 11 == 0, '"_note":{"by":{"value":1}},').otherwise("")
    two = F.concat(
        F.lit("{"), note, F.lit('"leaf":{'), _answer(2, 1, "flag", _quoted(F.col("l_returnflag"))), F.lit(","),
        _answer(2, 2, "status", _quoted(F.col("l_linestatus")), part % 37 != 0), F.lit(","),
        _answer(2, 3, "length", leaf_length), extra, F.lit("}}"))
    three = F.concat(
        F.lit('{"stem":{'), _answer(3, 1, "discount", discount), F.lit(","),
        _answer(3, 2, "length", _quoted(_whole(F.col("l_quantity") % 7))), F.lit("}}"))
    return F.array(one, two, three)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw responses of all runs, re-deliveries included."""
    items = spread(
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *SCORED), "l_orderkey", "l_partkey")
    rationale = F.concat(F.lit("view "), F.expr("repeat('a', cast(l_quantity as int) % 20)"))
    answered = items.withColumn("rationale", rationale).select(
        "l_orderkey", "l_linenumber", *SCORED, F.posexplode(_answer_texts()).alias("_pos", "_text"))
    rows = answered.withColumns({
        "shard_no": F.col("_pos") + 1,
        "line_id": line_of(F.col("l_orderkey")),
        "run_no": F.col("l_linenumber"),
    }).withColumns({
        "failed": (F.col("l_partkey") + F.col("shard_no")) % 41 == 0,
        "cut": (F.col("l_partkey") + F.col("shard_no")) % 43 == 0,
    })
    whole = F.expr("if(cut, left(_text, length(_text) - 4), _text)")
    fenced = F.when(F.col("l_suppkey") % 5 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(whole)
    failed = F.col("failed")
    return rows.select(
        "run_no", custom_id(F.col("line_id"), F.concat(F.lit("shard_0"), F.col("shard_no").cast("string"))).alias("custom_id"),
        F.when(failed, "errored").otherwise("succeeded").alias("result_type"),
        F.when(failed, F.when(F.col("l_suppkey") % 2 == 0, "overloaded_error")).alias("error_type"),
        F.when(failed, "error").alias("outer_type"),
        F.when(failed, F.concat(F.lit("try later "), F.col("shard_no").cast("string"))).alias("error_message"),
        F.when(~failed, fenced).alias("text"),
        (F.lit(30000) + F.col("l_partkey") % 1000).alias("input_tokens"),
        (F.lit(100) + F.col("l_quantity")).cast("long").alias("output_tokens"),
        F.when(F.col("l_partkey") % 4 != 0, F.col("l_suppkey") * 10).alias("cached_tokens"),
        F.when(F.col("l_partkey") % 3 == 0, "partial").otherwise("fresh").alias("source"),
        F.when(F.col("l_suppkey") % 19 == 0, "length").otherwise("stop").alias("finish_reason"),
        F.when(F.col("l_suppkey") % 23 == 0, "let me see").when(F.col("l_suppkey") % 3 == 0, "").alias("reasoning"),
        *SCORED,
    )


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries with ids, status, detail and the parsed object."""
    raw = deliveries(spark, sf_dir)
    detail = error_text(F.coalesce("error_type", "outer_type"), F.col("error_message"))
    ok = F.col("result_type") == "succeeded"
    return parse_answers(
        raw.withColumn("status", F.when(ok, "ok").otherwise("api error")).withColumn("detail", F.when(~ok, detail)))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest usable answer per run, line and shard, prior ones adopted."""
    return newest_answers(_usable(spark, sf_dir), ["run_no", "line_id", "shard_id"], DELIVERY, ["obj"])


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last failure of this run per run, line and shard, as ``shard: detail``."""
    _, rejects = split_rejects(parsed(spark, sf_dir))
    fresh = rejects.where(F.col("source") == "fresh")
    last = fresh.groupBy("run_no", "line_id", "shard_id").agg(
        F.max_by("detail", F.struct(*DELIVERY)).alias("detail"))
    return last.select("run_no", "line_id", F.concat("shard_id", F.lit(": "), "detail").alias("error"))


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = split_rejects(parsed(spark, sf_dir))
    return good.select("run_no", "line_id", "shard_id", "obj", (F.col("source") == "fresh").alias("is_fresh"), *DELIVERY)


def merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[Row]]:
    """The merged lines of all runs, with their schema and its rows."""
    return merged_lines(delivered_lines(spark, sf_dir), _usable(spark, sf_dir), traits(spark), SHARDS, RUN_LINE, DELIVERY)


def answered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest answers of each line of all runs."""
    return line_answers(delivered_lines(spark, sf_dir), _usable(spark, sf_dir), SHARDS, RUN_LINE, DELIVERY)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged records of all runs, one row per trait present."""
    return present_traits(*merged(spark, sf_dir), RUN_LINE)


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared traits without a value, of all runs."""
    return missing_traits(*merged(spark, sf_dir), RUN_LINE)


def with_run(df: DataFrame) -> DataFrame:
    """The run that made each record; the last runs are an older format without a block."""
    run = F.col("run_no")
    block = F.struct(
        F.when(run == 5, "beta").otherwise("alpha").alias("provider"),
        F.when(run.isin(3, 4), "m-2").otherwise("m-1").alias("model"),
        F.when(run == 6, F.lit(None).cast("string")).otherwise("v1").alias("schema_version"))
    return df.withColumn("block", F.when(run <= 6, block))


# -- events -------------------------------------------------------------------


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a run: one per event, the user being the line."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        line_of(F.col("user_id")).alias("line_id"), F.col("event_id").alias("i"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("shard_0"), (F.col("event_id") % 3 + 1).cast("string")).alias("shard_id"),
        F.when(kind == "error", "api error").when(kind == "view", "skip (cached)").otherwise("ok").alias("status"),
        F.col("value").alias("wall_seconds"),
        F.lit(1000).cast("long").alias("prompt_tokens"),
        (F.get_json_object("props", "$.k").cast("long") * 10).alias("cached_tokens"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric samples: one per event, with a counter that starts over now and then."""
    return table(spark, sf_dir, "events").select(
        line_of(F.col("user_id")).alias("host"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("gauge"),
        (F.col("event_id") % 997).alias("errors_total"))


# -- pages ------------------------------------------------------------------


def page_host() -> Column:
    return F.regexp_extract("url", "^https?://([^/]+)", 1)


# -- schema documents ----------------------------------------------------------


def _join(items: Column) -> Column:
    return F.array_join(items, ",")


def _text_list(n: Column, each) -> Column:
    return F.concat(F.lit("["), _join(F.transform(F.sequence(F.lit(1), n), each)), F.lit("]"))


def _part_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"), "p_partkey")
    return part.withColumns({
        "doc_id": F.col("p_partkey"),
        "k": (F.lit(2) + F.col("p_size") % 8).cast("int"),
        "m": (F.lit(3) + F.col("p_size") % 6).cast("int"),
    })


def _category(i: Column) -> Column:
    first = F.when(F.col("p_partkey") % 4 == 0, "absent").otherwise("c1")
    return F.concat(F.lit('"'), F.when(i == 1, first).otherwise(F.concat(F.lit("c"), i.cast("string"))), F.lit('"'))


def master_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One master schema per part, in either of the two shapes; some are broken."""
    p = F.col("p_partkey")
    unit = (F.when(F.col("p_size") % 5 == 0, '"cm"').when(F.col("p_size") % 5 == 1, '"m²"')
            .when(F.col("p_size") % 5 == 2, '"%"').when(F.col("p_size") % 5 == 3, '" mm / Day "').otherwise("null"))
    spread = F.concat(F.lit('{"trait_name":"spread","scale_type":"quantitative","values":null,"unit":'), unit,
                      F.lit(',"support":'), F.col("p_size").cast("string"), F.lit("}"))
    form = F.concat(F.lit('{"trait_name":"form","scale_type":"nominal","values":'),
                    _text_list(F.col("k"), _category), F.lit("}"))

    def hue_value(i: Column) -> Column:
        text = F.concat(F.lit(',"definition":"hue '), i.cast("string"), F.lit(" of "), F.col("p_name"), F.lit('"'))
        return F.concat(F.lit('{"value":"h'), i.cast("string"), F.lit('"'),
                        F.when((i == 3) & (p % 6 == 0), "").otherwise(text), F.lit("}"))
    hue = F.concat(F.lit('{"trait_name":"hue","scale_type":"nominal","values":'), _text_list(F.lit(3), hue_value), F.lit("}"))
    length = F.lit('{"trait_name":"length","scale_type":"quantitative","values":null,"unit":"cm"}')

    def level(i: Column) -> Column:
        n = (i - 1).cast("string")
        label = F.when((i == 1) & (p % 5 == 0), "none").otherwise(F.concat(F.lit("v"), n))
        text = F.when(p % 7 == 0, "").otherwise(F.concat(F.lit("seen v"), n))
        return F.concat(F.lit('{"level":'), n, F.lit(',"label":"'), label, F.lit('","definition":"'), text, F.lit('"}'))
    vigor = F.concat(F.lit('{"trait_name":"vigor","scale_type":"ordinal","values":'), _text_list(F.col("m"), level),
                     F.lit(',"design_note":"'), F.when(p % 2 == 0, "because").otherwise(""), F.lit('"}'))
    last = (F.when(p % 3 == 0, '{"trait_name":"length","scale_type":"quantitative","unit":"mm"}')
            .when(p % 3 == 1, '{"trait_name":"length","scale_type":"quantitative","unit":"cm"}')
            .otherwise('{"trait_name":"Girth Size","scale_type":"quantitative","unit":"cm"}'))
    whole = F.concat(F.lit("["), spread, F.lit(","), form, F.lit("]"))
    leaf = F.concat(F.lit("["), hue, F.lit(","), length, F.lit("]"))
    stem = F.concat(F.lit("["), vigor, F.lit(","), last, F.lit("]"))
    keyed = F.concat(
        F.lit('{"schema_name":"m","trait_groups":{"whole":{"description":"","traits":'), whole,
        F.lit('},"leaf":{"traits":'), leaf, F.lit('},"stem":{"traits":'), stem, F.lit("}}}"))
    name_key = F.when(p % 3 == 0, "group").when(p % 3 == 1, "group_name").otherwise("name")

    def entry(name: Column, items: Column) -> Column:
        return F.concat(F.lit('{"'), name_key, F.lit('":"'), name, F.lit('","traits":'), items, F.lit("}"))
    second = F.when(p % 50 == 1, "whole").when(p % 50 == 2, "").otherwise("leaf")
    listed = F.concat(F.lit('{"groups":['), entry(F.lit("whole"), whole), F.lit(","), entry(second, leaf), F.lit(","),
                      entry(F.lit("stem"), stem), F.lit("]}"))
    body = (F.when(p % 50 == 0, '{"things":[]}').when(p % 50 <= 2, listed)
            .when(p % 2 == 0, keyed).otherwise(listed))
    return _part_facts(spark, sf_dir).select("doc_id", body.alias("body"))


def shard_docs(spark: SparkSession, sf_dir: str, version: str = "raw") -> DataFrame:
    """Two constrained-output schemas per part, with some broken rules.

    Version ``typed`` adds a type to every enum, which changes nothing; version
    ``edited`` reorders members and has real differences in some documents.
    """
    p = F.col("p_partkey")
    edited = version == "edited"

    def answer(name, value: Column, swapped=F.lit(False), required=None, closed=F.lit("false")) -> Column:
        first = F.when(swapped, F.concat(F.lit('"value":'), value, F.lit(',"rationale":{"type":"string"}'))).otherwise(
            F.concat(F.lit('"rationale":{"type":"string"},"value":'), value))
        need = F.lit('["rationale","value"]') if required is None else required
        title = F.lit(name) if isinstance(name, str) else name
        return F.concat(F.lit('"'), title, F.lit('":{"type":"object","properties":{'), first, F.lit('},"required":'),
                        need, F.lit(',"additionalProperties":'), closed, F.lit("}"))

    def enum(members: Column) -> Column:
        head = '{"type":"string","enum":[' if version == "typed" else '{"enum":['
        return F.concat(F.lit(head), _join(members), F.lit("]}"))
    limit = F.when(p % 12 == 0, ',"minLength":1').otherwise("")
    alt = F.when(p % 13 == 0, ',"anyOf":[{"pattern":"x"},{"type":"null"}]').otherwise("")
    kind = F.when(F.lit(edited) & (p % 17 == 0), "number").otherwise("string")
    spread_value = F.concat(F.lit('{"type":"'), kind, F.lit('"'), limit, alt, F.lit("}"))
    forms = F.transform(F.sequence(F.lit(1), F.col("k")), _category)
    if edited:
        forms = F.reverse(F.when(p % 16 == 0, F.slice(forms, F.lit(1), F.col("k") - 1)).otherwise(forms))
    forms = F.array_append(forms, F.lit(f'"{SENTINEL}"'))
    hues = F.array(*[F.lit(f'"{h}"') for h in ("h1", "h2", "h3", SENTINEL)])
    extras = F.when(p % 8 == 0, F.concat(
        F.lit(","), answer("extra_code", F.lit('{"enum":[3,1,2,"not_assessable"]}')),
        F.lit(","), answer("extra_name", F.lit('{"enum":["b","a","not_assessable"]}')))).otherwise("")
    spread = answer("spread", spread_value)
    short = F.when(p % 10 == 0, '["value"]').otherwise('["rationale","value"]')
    hue_name = F.when(F.lit(edited) & (p % 18 == 0), "hues").otherwise("hue")
    plain = F.lit('{"type":"string"}')
    whole = F.concat(F.lit('"whole":{"properties":{'), spread, F.lit(","),
                     answer("form", enum(forms), swapped=p % 9 == 0), F.lit("}}"))
    leaf = F.concat(F.lit('"leaf":{"properties":{'), answer(hue_name, enum(hues), required=short), F.lit(","),
                    answer("length", plain), extras, F.lit("}}"))
    levels = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: i.cast("string"))
    vigor = F.when(p % 14 == 0, "").otherwise(F.concat(
        answer("vigor", enum(F.array_append(levels, F.lit(f'"{SENTINEL}"'))),
               closed=F.when(p % 11 == 0, "true").otherwise("false")), F.lit(",")))
    last = F.when(p % 3 == 2, "Girth Size").otherwise("length")
    stem = F.concat(F.lit('"stem":{"properties":{'), vigor, answer(last, plain), F.lit("}}"))
    again = F.when(p % 15 == 0, F.concat(F.lit(',"whole":{"properties":{'), spread, F.lit("}}"))).otherwise("")
    one = F.concat(F.lit('{"type":"object","properties":{'), whole, F.lit(","), leaf, F.lit("}}"))
    two = F.concat(F.lit('{"type":"object","properties":{'), stem, again, F.lit("}}"))
    both = _part_facts(spark, sf_dir).select("doc_id", F.posexplode(F.array(one, two)).alias("pos", "body"))
    return both.select("doc_id", (F.col("pos") + 1).alias("shard_no"), "body")


def manifest_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shard manifest per part, listing its traits; groups may come back later."""
    p = F.col("p_partkey")

    def item(group, trait: str, scale: str, unit: str = "null") -> Column:
        return F.concat(F.lit('{"group":"'), group if isinstance(group, Column) else F.lit(group),
                        F.lit(f'","trait":"{trait}","scale_type":"{scale}","unit":{unit}}}'))
    early = F.when(p % 2 == 0, "stem").otherwise("whole")
    listed = F.array(
        item(early, "first", "quantitative", '"cm"'), item("whole", "form", "nominal"), item("leaf", "hue", "nominal"),
        item(early, "again", "ordinal"))
    body = F.concat(F.lit('{"version":1,"shard_budget":40,"all_traits":['), _join(listed), F.lit("]}"))
    return _part_facts(spark, sf_dir).select("doc_id", body.alias("body"))
