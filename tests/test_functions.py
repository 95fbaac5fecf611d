import math

import pytest
from pyspark.sql import functions as F

from traitloom.constants import SNAKE_CASE_PATTERN
from traitloom.functions import sql as sql_names, stats, text as tx, values as vl


def one(spark, text, f, kind="string"):
    return spark.createDataFrame([(text,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,want", [
    ("12.5", 12.5), (" 12.5 ", 12.5), ("1e5", 1e5), ("+3", 3.0), (".5", 0.5), ("5.", 5.0), ("", None), ("12,5", None),
    ("1_000", 1000.0), ("1__0", None), ("1d", None), ("1.0f", None), ("0x10", None), ("inf", math.inf), ("-Infinity", -math.inf),
    ("NOT_ASSESSABLE", None), (" 7\t", 7.0), ("1e400", math.inf), (None, None),
])
def test_parse_value(spark, text, want):
    assert one(spark, text, lambda c: vl.parse_value(F.lit("quantitative"), c)) == want


def test_parse_value_nan_and_other_scales(spark):
    assert math.isnan(one(spark, "nan", lambda c: vl.parse_value(F.lit("quantitative"), c)))
    assert one(spark, "3", lambda c: vl.parse_value(F.lit("nominal"), c)) is None


@pytest.mark.parametrize("text,want", [
    ("{}", "{}"), ("  {} \n", "{}"), ("```\n{}\n```", "{}"), ("```json\n{}\n```", "{}"), ("```json\n{}\n```  \n", "{}"),
    ("```json\n{}", "{}"), ("```{}```", ""), ("```json\n{}\n  ```", "{}"), ("```json\n{}```", "{}```"), ("```\n```", ""),
    ("```\n{\n \"a\": 1\n}\n```", "{\n \"a\": 1\n}"), ("x ```\n{}\n```", "x ```\n{}\n```"), ("```", ""),
])
def test_strip_code_fence(spark, text, want):
    assert one(spark, text, tx.strip_code_fence) == want


@pytest.mark.parametrize("cid,want", [
    ("s1__shard_01", ("s1", "shard_01")), ("a__b__c", ("a__b", "c")), ("plain", ("", "plain")), ("__x", ("", "x")), ("a___b", ("a_", "b")),
])
def test_split_custom_id(spark, cid, want):
    assert tuple(one(spark, cid, vl.split_custom_id)) == want


@pytest.mark.parametrize("unit,want", [
    ("cm", "cm"), ("m²", "m2"), ("%", ""), ("µm", "m"), ("cm/day", "cm_day"), ("  ", ""), (None, ""), ("Leaf Count", "leaf_count"), ("cm³", "cm3"),
])
def test_sanitize_unit(spark, unit, want):
    assert one(spark, unit, vl.sanitize_unit) == want


def ordinal(spark, value):
    labels = {0.0: "none", 1.0: "weak", 2.0: "strong"}
    df = spark.createDataFrame([(f'{{"v":{value}}}', labels)], "j string, labels map<double,string>")
    v = F.try_variant_get(F.try_parse_json("j"), "$.v", "variant")
    raw, kind = F.try_variant_get(v, "$", "string"), vl.json_kind(v)
    none = F.lit(None).cast("map<double,string>")
    text = vl.convert_text(F.lit("ordinal"), raw, kind, F.col("labels"))
    return df.select(
        text.alias("t"), vl.conversion_problem(F.lit("ordinal"), raw, F.col("labels"), F.lit(None).cast("double"), text).alias("p"),
        vl.convert_text(F.lit("ordinal"), raw, kind, none).alias("bare")).first()


@pytest.mark.parametrize("value,label,problem", [
    ("1", "weak", None), ("1.0", "weak", None), ("true", "weak", None), ("0", "none", None), ('"1"', None, "unknown ordinal code"),
    ("99", None, "unknown ordinal code"), ("null", None, None), ('"not_assessable"', None, None),
])
def test_ordinal_codes(spark, value, label, problem):
    got = ordinal(spark, value)
    assert (got.t, got.p) == (label, problem)


def test_ordinal_without_levels_keeps_the_code(spark):
    assert ordinal(spark, "7").bare == "7"


def test_sentinel_is_exact_in_the_table_but_not_at_merge(spark):
    df = spark.createDataFrame([("NOT_ASSESSABLE",)], "x string")
    no_levels = F.lit(None).cast("map<double,string>")
    got = df.select(vl.convert_text(F.lit("nominal"), F.col("x"), F.lit("string"), no_levels).alias("t")).first()
    assert got.t == "NOT_ASSESSABLE"


def test_tags(spark):
    assert one(spark, "a<report> x\ny </report><report>z</report>", lambda c: tx.parse_tag_content(c, "report")) == "x\ny"
    assert one(spark, "none", lambda c: tx.parse_tag_content(c, "report")) == ""
    assert one(spark, "<b><a><b>x</a>", tx.ensure_all_tags_closed) == "<b><a><b>x</a></b>"
    assert one(spark, "<think>t</think><report>half", tx.extract_report) == "half"


def test_clean_text(spark):
    raw = "﻿a\r\nb\rc\n \t\n\nd\n"
    assert one(spark, raw, tx.clean_text) == "a\nb\nc\nd"
    assert one(spark, raw, lambda c: tx.clean_text(c, trim=False)) == "a\nb\nc\nd\n"


@pytest.mark.parametrize("text,want", [
    ("Most plants; the MAJORITY, near universal", ["majority", "most"]), ("near-universal nearuniversal", ["near-universal", "nearuniversal"]),
    ("petals support a common inflorescence", []), ("support: 12 and support count", ["support count", "support: 12"]),
    ("3 of the plants, 4 of specimens", ["3 of the plants", "4 of specimens"]), ("utmost almost rarely", []), (None, []),
    ("frequently seen, does not occur", ["does not occur", "frequently"]), ("étmost", []),
])
def test_find_leakage(spark, text, want):
    assert one(spark, text, tx.find_leakage) == want


def test_text_parts(spark):
    blocks = [("thinking", "t"), ("text", "a"), ("text", "b")]
    kind = "array<struct<type:string,text:string>>"
    assert one(spark, blocks, tx.text_parts, kind) == "a\nb"
    assert one(spark, blocks, lambda c: tx.text_parts(c, ""), kind) == "ab"


def test_media_type_and_size_limit(spark):
    assert [one(spark, p, vl.media_type) for p in ("a/b.JPG", "x.jpeg", "x.png", "x.gif", "x")] == [
        "image/jpeg", "image/jpeg", "image/png", None, None]
    assert one(spark, "Enum TOO LARGE", vl.is_size_limit) and not one(spark, None, vl.is_size_limit)


def test_sql_functions(spark):
    sql_names.register_functions(spark)
    assert spark.sql("SELECT find_leakage('a rare cultivar') AS x").first().x == ["cultivar", "rare"]
    rows = spark.sql("SELECT * FROM split_sections('### a\n\nx\n### b \ny')").collect()
    assert [(r.pos, r.section_id, r.body.strip()) for r in rows] == [(0, "a", "x"), (1, "b", "y")]


def test_student_t():
    assert stats.t_two_sided(3.03, 9) == pytest.approx(0.0143, abs=1e-4)
    assert stats.t_two_sided(0.0, 9) == pytest.approx(1.0)
    assert stats.t_quantile(0.95, 9) == pytest.approx(2.262157, abs=1e-5)
    assert stats.t_two_sided(1.959964, 10**6) == pytest.approx(0.05, abs=1e-5)
    assert math.isnan(stats.t_two_sided(1.0, 0))


def test_a_long_fenced_answer(spark):
    body = "{" + " x\n" * 400_000 + "}"
    assert one(spark, "```json\n" + body + "\n```", tx.strip_code_fence) == body


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r", "\u2028"])
def test_fences_with_any_line_end(spark, end):
    assert one(spark, f'```json{end}{{"a":1}}{end}```', tx.strip_code_fence) == '{"a":1}'


def test_student_t_for_any_size():
    from traitloom.functions.stats import t_quantile, t_two_sided
    assert abs(t_two_sided(2.0, 10) - 0.07338803477074025) < 1e-12
    assert abs(t_two_sided(1.0, 1) - 0.5) < 1e-12
    near, far = t_two_sided(2.0, 99_999), t_two_sided(2.0, 100_001)
    assert 0 < near - far < 1e-9 and abs(t_two_sided(1.96, 1e9) - 0.04999579) < 1e-7
    assert abs(t_quantile(0.95, 9) - 2.2621571628) < 1e-8


LONG = 1_000_000


@pytest.mark.parametrize("text,f,length", [
    ("1" + "_1" * (LONG // 2), lambda c: vl.number(c).isNotNull().cast("string"), 4),
    ("1" * LONG + "x", lambda c: vl.number(c).isNull().cast("string"), 4),
    ("1." + "1_" * (LONG // 2), lambda c: vl.number(c).isNull().cast("string"), 4),
    ("a" + "_a" * (LONG // 2), lambda c: c.rlike(SNAKE_CASE_PATTERN).cast("string"), 4),
    ("support" + " " * LONG, lambda c: F.size(tx.find_leakage(c)).cast("string"), 1),
    ("1" * LONG, lambda c: F.size(tx.find_leakage(c)).cast("string"), 1),
    ("".join(f"<a{i}>" for i in range(LONG // 8)), lambda c: F.substring(tx.ensure_all_tags_closed(c), -9, 9), 9),
    ("<report>" * (LONG // 8), lambda c: tx.parse_tag_content(c, "report"), 0),
    ("\n " * (LONG // 2) + "x", tx.clean_text, 1),
    ("```\n" + ("\n" + " " * 50) * (LONG // 50) + "x", tx.strip_code_fence, 1),
])
def test_long_texts_of_the_worst_kind(spark, text, f, length):
    # no pattern recurses once for each repeat, or tries a run again from each of its places
    assert len(one(spark, text, f)) == length


def test_parse_tag_content_takes_the_first(spark):
    for text, want in [("<t>a</t><t>b</t>", "a"), ("</t><t> a\n</t>", "a"), ("<t>a<t>b</t>", "a<t>b"), ("<t>a", ""), ("", ""), (None, None)]:
        assert one(spark, text, lambda c: tx.parse_tag_content(c, "t")) == want


def test_find_leakage_takes_digits_as_before(spark):
    got = one(spark, "x12 of the plants, 3  of  cases; support: 12, Support =  7, support count", tx.find_leakage, "string")
    assert got == ["12 of the plants", "3  of  cases", "support =  7", "support count", "support: 12"]
