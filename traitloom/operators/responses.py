"""Raw responses: classify, reject, parse, keep the newest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import STATUS_API, STATUS_LEAK, STATUS_LENGTH, STATUS_OK, STATUS_PARSE
from ..functions.text import strip, strip_code_fence
from ..functions.values import error_text, split_custom_id
from ..session import once


def split_status(resp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(succeeded, failed)``; failed rows carry ``detail`` = ``type: message``."""
    ok = F.col("result_type") == "succeeded"
    detail = error_text(F.coalesce("error_type", "outer_type"), F.col("error_message"))
    return resp.where(ok), resp.where(~F.coalesce(ok, F.lit(False))).withColumn("detail", detail)


def classify_response(lines: DataFrame) -> DataFrame:
    """Text, usage and failure text of batch output lines.

    The checks run in a fixed order: a top-level error (any object that is not
    empty; it stands for its message where it has none), a missing or non-200
    response, a refusal part, no text part at all.  Text parts are joined
    without a separator; reasoning items are skipped.
    """
    body = F.col("response.body")
    code = F.col("response.status_code")
    top = F.col("error")
    top_present = F.coalesce(top["code"].isNotNull() | top["message"].isNotNull(), F.lit(False))
    said = top["message"]
    if "raw" in lines.schema["error"].dataType.names:  # an error may be any object that is not empty
        whole = strip(top["raw"])
        top_present = top_present | F.coalesce(~whole.isin("", "{}", "null", "[]", '""', "false", "0"), F.lit(False))
        said = F.coalesce(said, whole)
    inner = body["error"]
    inner_present = inner["code"].isNotNull() | inner["message"].isNotNull()
    inner_text = F.btrim(
        F.concat(F.coalesce(inner["code"], F.lit("")), F.lit(": "), F.coalesce(inner["message"], F.lit(""))),
        F.lit(": "),
    )
    messages = F.filter(F.coalesce(body["output"], F.array()), lambda i: i["type"] == "message")
    parts = F.flatten(F.transform(messages, lambda i: F.coalesce(i["content"], F.array())))
    refusals = F.filter(parts, lambda p: p["type"] == "refusal")
    texts = F.filter(parts, lambda p: p["type"] == "output_text")
    not_ok = code.isNull() | (code != 200)
    failure = (
        F.when(top_present, error_text(F.coalesce(top["code"], F.lit("error")), said))
        .when(not_ok & inner_present, inner_text)
        .when(F.col("response").isNull(), "HTTP no-response")
        .when(not_ok, F.concat(F.lit("HTTP "), F.coalesce(code.cast("string"), F.lit("None"))))
        .when(F.size(refusals) > 0, F.concat(
            F.lit("refusal: "), F.coalesce(F.get(refusals, F.lit(0))["refusal"], F.lit("None"))))
        .when(F.size(texts) == 0, "no output_text in response")
    )
    text = F.array_join(F.transform(texts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    # Usage of an errored response still counts; a top-level error has none.
    usage = F.when(~F.coalesce(top_present, F.lit(False)) & (~not_ok | inner_present), body["usage"])
    plain = [c for c in lines.columns if c not in ("error", "response")]
    return lines.select(
        *plain,
        F.when(failure.isNull(), STATUS_OK).otherwise(STATUS_API).alias("status"),
        failure.alias("detail"),
        F.when(failure.isNull(), text).alias("text"),
        F.coalesce(usage["input_tokens"], F.lit(0)).alias("input_tokens"),
        F.coalesce(usage["output_tokens"], F.lit(0)).alias("output_tokens"),
        F.coalesce(usage["input_tokens_details"]["cached_tokens"], F.lit(0)).alias("cached_tokens"),
    )


def reject_reason(finish: Column, *reasoning: Column) -> Column:
    """Why an answer that came back must not be used, or NULL.

    A truncated answer is a failure, never a partial result; reasoning text is
    one while reasoning is switched off.
    """
    leaked = F.lit(False)
    for field in reasoning:
        leaked = leaked | (F.coalesce(field, F.lit("")) != "")
    return F.when(finish == "length", STATUS_LENGTH).when(leaked, STATUS_LEAK)


def parse_answers(resp: DataFrame, text: str = "text") -> DataFrame:
    """Add ids, the parsed ``obj`` (VARIANT) and the final ``status`` and ``detail``.

    Input rows have ``custom_id``, *text*, ``status`` and ``detail``; a text that
    is not JSON turns the row into a parse error.
    """
    ids = split_custom_id(F.col("custom_id"))
    obj = F.when(F.col("status") == STATUS_OK, F.try_parse_json(strip_code_fence(F.col(text))))
    bad = (F.col("status") == STATUS_OK) & F.col("obj").isNull()
    return (
        once(resp, "obj", obj)
        .withColumn("line_id", ids["line_id"]).withColumn("shard_id", ids["shard_id"])
        .withColumn("detail", F.when(bad, "JSON parse failed").otherwise(F.col("detail")))
        .withColumn("status", F.when(bad, STATUS_PARSE).otherwise(F.col("status")))
    )


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)``; together they are the input.

    A reject keeps its raw text when it could not be parsed and
    ``[ERROR type: message]`` when the request itself failed.
    """
    good = F.col("status") == STATUS_OK
    kept = F.when(F.col("status") == STATUS_PARSE, strip_code_fence(F.col("text"))).otherwise(
        F.concat(F.lit("[ERROR "), F.coalesce("detail", F.lit("unknown")), F.lit("]"))
    )
    return parsed.where(good), parsed.where(~good).withColumn("kept", kept)


def _place(key: list[str]) -> Column:
    """A number that tells most keys apart, so rows sort without looking at the keys."""
    return F.xxhash64(*key).alias("_place")


def latest(df: DataFrame, key: list[str], order: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per key: the one that is last in *order*.

    An aggregate, not a window: each map task reduces its own rows first, so a
    key with very many deliveries costs one row per task in the shuffle.
    """
    keep = keep or [c for c in df.columns if c not in key]
    newest = F.max_by(F.struct(*keep), F.struct(*order))
    return df.groupBy(_place(key), *key).agg(newest.alias("_row")).select(*key, "_row.*")


def union_latest(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Prior results and this run; for one key this run wins, then the newest.

    ``position`` keeps the merge order: results known from earlier come first by
    shard, new ones follow in order of arrival, and a newer result for a known
    key stays where the known one was.
    """
    both = old.withColumn("is_fresh", F.lit(False)).unionByName(new.withColumn("is_fresh", F.lit(True)))
    return newest_answers(both, key, order)


def newest_answers(
    both: DataFrame, key: list[str], order: list[str], keep: list[str] | None = None
) -> DataFrame:
    """:func:`union_latest` of rows that say themselves whether they are ``is_fresh``."""
    rank = F.struct("is_fresh", *order)
    keep = keep or [c for c in both.columns if c not in key and c != "is_fresh"]
    adopted = F.bool_or(~F.col("is_fresh"))
    arrival = F.min(F.when(F.col("is_fresh"), F.struct(*order)))
    merged = both.groupBy(_place(key), *key).agg(
        F.max_by(F.struct(*keep, "is_fresh"), rank).alias("_row"),
        adopted.alias("adopted"), arrival.alias("_arrival"),
    )
    position = F.struct(
        (~F.col("adopted")).alias("new"),
        F.when(~F.col("adopted"), F.col("_arrival")).alias("arrival"),
    )
    return merged.select(*key, "_row.*", "adopted", position.alias("position"))
