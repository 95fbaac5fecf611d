import json

import pytest
from pyspark.sql import functions as F

from traitloom.operators import merge, planning, provenance as prov, responses as rs, table as tb
from traitloom.session import once

TRAITS = "group_ord int, group_name string, trait_ord int, trait_name string, scale_type string, unit string, levels array<struct<level:int,label:string,definition:string>>"


@pytest.fixture(scope="module")
def traits(spark):
    return spark.createDataFrame([
        (1, "g2", 1, "size", "quantitative", "cm", None), (1, "g2", 2, "hue", "nominal", None, None),
        (2, "g1", 1, "rank", "ordinal", None, [(0, "low", ""), (1, "high", "")])], TRAITS)


def parts(spark, rows):
    """(line, shard, position, json) as usable answers."""
    df = spark.createDataFrame(rows, "line_id string, shard_id string, position int, j string")
    return df.withColumn("obj", F.try_parse_json("j")).drop("j")


def lines(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "line_id string")


def as_dict(records):
    return {(r.line_id, r.group_name, r.trait_name): (r.raw, r.num) for r in records.collect()}


def test_merge_rules(spark, traits):
    got = as_dict(merge.merge_records(lines(spark, "a", "b"), parts(spark, [
        ("a", "s1", 1, '{"g2":{"size":{"rationale":"r","value":" 12.5 "},"hue":{"value":null}},"_note":{"size":{"value":"9"}},"x":3}'),
        ("a", "s2", 2, '{"g1":{"rank":{"value":0}},"g9":{"size":{"value":"1"}}}'),
        ("b", "s1", 1, '[1,2]'), ("b", "s2", 2, '{"g1":{"rank":7,"hue":{"rationale":"r"}},"g2":"text"}'),
        ("c", "s1", 1, '{"g1":{"rank":{"value":1}}}')]), traits, ["line_id"]))
    assert got == {("a", "g2", "size"): (" 12.5 ", 12.5), ("a", "g2", "hue"): (None, None), ("a", "g1", "rank"): ("0", None)}


def test_last_shard_counts_even_without_a_value(spark, traits):
    rows = [("a", "s1", 1, '{"g1":{"rank":{"value":0}}}'), ("a", "s2", 2, '{"g1":{"rank":{"rationale":"r"}}}')]
    assert as_dict(merge.merge_records(lines(spark, "a"), parts(spark, rows), traits, ["line_id"])) == {}
    rows = [("a", "s1", 2, '{"g1":{"rank":{"value":0}}}'), ("a", "s2", 1, '{"g1":{"rank":{"value":1}}}')]
    assert as_dict(merge.merge_records(lines(spark, "a"), parts(spark, rows), traits, ["line_id"])) == {("a", "g1", "rank"): ("0", None)}


def test_repeated_keys_keep_the_last(spark, traits):
    rows = [("a", "s1", 1, '{"g1":{"rank":{"value":0},"rank":{"value":1}}}')]
    assert as_dict(merge.merge_records(lines(spark, "a"), parts(spark, rows), traits, ["line_id"])) == {("a", "g1", "rank"): ("1", None)}


def test_a_known_key_keeps_its_position(spark):
    schema = "k string, at int, v string"
    old = spark.createDataFrame([("s2", 1, "old"), ("s9", 2, "old9")], schema)
    new = spark.createDataFrame([("s2", 5, "new"), ("s1", 3, "one"), ("s1", 4, "two")], schema)
    rows = rs.union_latest(old, new, ["k"], ["at"]).orderBy("position", "k").collect()
    assert [(r.k, r.v, r.adopted) for r in rows] == [("s2", "new", True), ("s9", "old9", True), ("s1", "two", False)]


@pytest.mark.parametrize("limit", [5_000, 1])
def test_gaps_in_both_forms(spark, traits, monkeypatch, limit):
    monkeypatch.setattr(merge, "small_rows", lambda df, n=limit: planning.small_rows(df, limit))
    records = merge.merge_records(lines(spark, "a", "b"), parts(spark, [
        ("a", "s1", 1, '{"g2":{"size":{"value":"1"},"hue":{"value":null}}}')]), traits, ["line_id"])
    got = merge.gaps(lines(spark, "a", "b"), records, traits, ["line_id"]).collect()
    assert sorted((r.line_id, r.group_name, r.trait_name) for r in got) == [
        ("a", "g1", "rank"), ("b", "g1", "rank"), ("b", "g2", "hue"), ("b", "g2", "size")]


def test_gap_report_and_totals(spark, traits):
    asked = lines(spark, "a", "b")
    records = merge.merge_records(asked, parts(spark, [
        ("a", "s1", 1, '{"g2":{"size":{"value":"1"},"hue":{"value":"x"}},"g1":{"rank":{"value":0}}}'),
        ("b", "s1", 1, '{"g1":{"rank":{"value":0}}}')]), traits, ["line_id"])
    missing = merge.gaps(asked, records, traits, ["line_id"])
    errors = spark.createDataFrame([("a", "s3: x"), ("b", "s2: y")], "line_id string, error string")
    report = merge.gap_report(missing, errors, ["line_id"]).collect()
    assert [(r.line_id, [(m.group, m.trait) for m in r.missing_traits], r.shard_errors) for r in report] == [
        ("b", [("g2", "size"), ("g2", "hue")], ["s2: y"])]
    assert tuple(merge.merge_totals(asked, missing, ["line_id"]).first()) == (2, 1, 2)


def test_documents_round_trip_and_restamp(spark, traits):
    asked = lines(spark, "a", "b")
    records = merge.merge_records(asked, parts(spark, [
        ("a", "s1", 1, '{"g2":{"size":{"rationale":"q\\"é","value":"2"},"hue":{"value":null}},"g1":{"rank":{"value":1}}}')]),
        traits, ["line_id"])
    block = merge.provenance_block(provider="p", model="m", created="t")
    docs = merge.record_documents(asked, records, ["line_id"], block)
    got = {r.line_id: json.loads(r.body) for r in docs.collect()}
    assert list(got["a"]) == ["_provenance", "g2", "g1"] and list(got["a"]["g2"]) == ["size", "hue"]
    assert got["a"]["g2"] == {"size": {"rationale": 'q"é', "value": 2.0}, "hue": {"rationale": None, "value": None}}
    assert got["a"]["g1"]["rank"]["value"] == 1 and list(got["b"]) == ["_provenance"]
    assert list(got["a"]["_provenance"]) == [
        "provider", "model", "schema_name", "schema_version", "tool_version", "created", "run_id"]
    again = merge.stamp(docs, merge.provenance_block(provider="q"))
    twice = {r.line_id: json.loads(r.body) for r in again.collect()}
    assert twice["a"]["_provenance"]["provider"] == "q" and twice["a"]["g2"] == got["a"]["g2"]
    # Merging the same answers again changes nothing.
    assert {r.line_id: json.loads(r.body) for r in merge.record_documents(asked, records, ["line_id"], block).collect()} == got


def test_good_and_rejects_are_the_input(spark):
    df = spark.createDataFrame([
        ("a__1", "ok", None, "{}"), ("a__2", "ok", None, "```\n{bad\n```"), ("a__3", "api error", "t: m", None)],
        "custom_id string, status string, detail string, text string")
    good, bad = rs.split_rejects(rs.parse_answers(df))
    assert [r.custom_id for r in good.collect()] == ["a__1"]
    assert sorted((r.custom_id, r.status, r.kept) for r in bad.collect()) == [
        ("a__2", "parse error", "{bad"), ("a__3", "api error", "[ERROR t: m]")]


# -- tables -----------------------------------------------------------------


def test_leaves(spark):
    docs = parts(spark, [("a", "s", 1, json.dumps({
        "g": {"t": {"value": 1}, "sub": {"deep": {"value": [1]}}, "no": {"x": 1}, "s": 3}, "h": {"value": None, "z": {"value": 1}},
        "_p": {"t": {"value": 1}}, "l": [1], "n": 5}))])
    got = {tuple(r.path): r.raw for r in tb.flatten_leaves(docs, ["line_id"]).withColumn(
        "raw", F.try_variant_get("value", "$", "string")).collect()}
    assert got == {("g", "t"): "1", ("g", "sub", "deep"): "[1]", ("h",): None}


def test_too_deep_is_an_error(spark):
    docs = parts(spark, [("a", "s", 1, '{"a":{"b":{"c":{"value":1}}}}')])
    assert len(tb.flatten_leaves(docs, ["line_id"], max_depth=3).collect()) == 1
    with pytest.raises(Exception, match="raise max_depth"):
        tb.flatten_leaves(docs, ["line_id"], max_depth=2).collect()


def test_depth_comes_from_the_records(spark):
    deep = {"value": "x{[\"\\"}
    for i in range(20):
        deep = {f"k{i}": deep, "empty": {}}
    docs = parts(spark, [("a", "s", 1, json.dumps(deep)), ("b", "s", 1, '{"g":{"t":{"value":1}},"e":{}}')])
    got = {(r.line_id, len(r.path)) for r in tb.flatten_leaves(docs, ["line_id"]).collect()}
    assert got == {("a", 20), ("b", 2)}
    # an object without leaves does not count as too deep
    assert tb.flatten_leaves(docs.where("line_id = 'b'"), ["line_id"], max_depth=2).count() == 1


def test_a_later_shard_wins_in_record_and_table(spark, traits):
    docs = spark.createDataFrame([("l1", "s1", 1, '{"g2":{"size":{"value":9},"hue":{"value":"zeta"}}}'), ("l1", "s2", 2, '{"g2":{"size":{"value":2},"hue":{"value":"alpha"}}}')],
                                 "line_id string, shard_id string, position int, body string").withColumn("obj", F.try_parse_json("body"))
    merged = {r.trait_name: r.raw for r in merge.merge_records(docs, docs, traits, ["line_id"]).collect()}
    typed = tb.type_leaves(tb.flatten_leaves(docs, ["line_id", "position", "shard_id"]), traits)
    row = tb.wide_table(typed, tb.table_columns(typed), ["line_id"], docs, ["position", "shard_id"]).first()
    assert (merged["size"], merged["hue"]) == ("2", "alpha") and (row.size_cm, row.hue) == (2.0, "alpha")


def test_wide_tables_of_many_blocks(spark, monkeypatch):
    typed = spark.createDataFrame([("l1", f"t{i}", float(i)) for i in range(7)] + [("l2", "t3", 1.0), (None, "t6", 2.0)], "line_id string, t string, num double")
    typed = typed.select("line_id", F.array(F.lit("g"), "t").alias("path"), "num", F.lit(None).cast("string").alias("text"))
    columns = [{"name": f"t{i}", "path": ["g", f"t{i}"], "scale_type": "quantitative", "levels": None} for i in range(7)]
    want = sorted(map(str, tb.wide_table(typed, columns, ["line_id"]).collect()))
    monkeypatch.setattr(tb, "COLUMN_BLOCK", 2)
    assert sorted(map(str, tb.wide_table(typed, columns, ["line_id"]).collect())) == want and len(want) == 3


def test_shard_only_traits_follow_the_master(spark):
    rows = [("z_first", 1, 1, True), ("shard", None, None, True), ("a_second", 1, 2, True), ("unknown", None, None, False)]
    typed = spark.createDataFrame(rows, "trait_name string, group_ord int, trait_ord int, declared boolean").selectExpr(
        "array('g', trait_name) path", "'g' group_name", "trait_name", "'nominal' scale_type", "cast(null as string) unit", "declared", "group_ord", "trait_ord",
        "cast(null as array<struct<level:int,label:string,definition:string>>) levels")
    assert [c["name"] for c in tb.table_columns(typed)] == ["z_first", "a_second", "shard", "unknown"]


def names(spark, rows, mode, rename=None):
    df = spark.createDataFrame([(p.split("."), s, u) for p, s, u in rows], "path array<string>, scale_type string, unit string")
    return {".".join(r.path): (r.name, r.problem) for r in tb.resolve_names(df, mode, rename).collect()}


Q = "quantitative"
CLASH = [("leaf.length", Q, "cm"), ("petal.length", Q, "cm"), ("leaf.hue", "nominal", None)]


def test_name_modes(spark):
    assert {v[1] for v in names(spark, CLASH, "error").values()} == {"collision", None}
    assert names(spark, CLASH, "prefix_collided") == {
        "leaf.length": ("leaf_length_cm", None), "petal.length": ("petal_length_cm", None), "leaf.hue": ("hue", None)}
    assert names(spark, CLASH, "prefix_all")["leaf.hue"] == ("leaf_hue", None)
    assert names(spark, CLASH, "error", {"leaf.length": "ll"}) == {
        "leaf.length": ("ll", None), "petal.length": ("length_cm", None), "leaf.hue": ("hue", None)}
    with pytest.raises(ValueError):
        names(spark, CLASH, "other")


def test_names_deepen_only_as_far_as_needed(spark):
    deep = [("sepal.tip.angle", "nominal", None), ("bract.tip.angle", "nominal", None), ("leaf.angle", "nominal", None)]
    assert {k: v[0] for k, v in names(spark, deep, "prefix_collided").items()} == {
        "sepal.tip.angle": "sepal_tip_angle", "bract.tip.angle": "bract_tip_angle", "leaf.angle": "leaf_angle"}
    units = [("leaf.length", Q, "cm"), ("petal.length", Q, "mm")]
    assert {v[0] for v in names(spark, units, "error").values()} == {"length_cm", "length_mm"}


def test_reserved_and_duplicate_names(spark):
    for mode in ("error", "prefix_collided"):
        assert names(spark, [("g.model", "nominal", None)], mode)["g.model"] == ("model", "reserved")
    assert {v[1] for v in names(spark, CLASH, "prefix_collided", {"leaf.hue": "leaf_length_cm"}).values()} == {"duplicate", None}
    df = spark.createDataFrame([(["g", "model"], "nominal", None)], "path array<string>, scale_type string, unit string")
    with pytest.raises(tb.ColumnNameError, match="reserved"):
        tb.checked_names(tb.resolve_names(df))


def test_wide_table(spark, traits, tmp_path):
    from traitloom.sources import sinks
    docs = parts(spark, [
        ("a", "s", 1, '{"g2":{"size":{"value":2.5},"hue":{"value":"x"}},"g1":{"rank":{"value":1}},"z":{"new":{"value":true}}}'),
        ("b", "s", 1, '{"g2":{"size":{"value":"not_assessable"}},"g1":{"rank":{"value":9}}}'), ("c", "s", 1, "{}")])
    typed = tb.type_leaves(tb.flatten_leaves(docs, ["line_id"]), traits)
    wide = tb.wide_table(typed, tb.table_columns(typed), ["line_id"], docs)
    assert wide.columns == ["line_id", "size_cm", "hue", "rank", "new"]
    assert sorted(tuple(r) for r in wide.collect()) == [
        ("a", 2.5, "x", "high", "True"), ("b", None, None, None, None), ("c", None, None, None, None)]
    assert [tuple(r) for r in tb.conversion_warnings(typed, ["line_id"]).collect()] == [("b", "rank", "9", "unknown ordinal code")]
    assert [r.trait_name for r in tb.unknown_traits(typed).collect()] == ["new"]
    sinks.write_table(wide, f"file://{tmp_path}/w", [{"provider": "p"}])
    back = spark.read.parquet(f"file://{tmp_path}/w/parquet")
    assert back.schema["rank"].metadata == {"ordered": True, "levels": ["low", "high"]}
    assert json.loads(back.schema["line_id"].metadata["provenance"]) == {"provider": "p"}
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/w/csv").where("line_id = 'a'").first().rank == "high"


# -- provenance ---------------------------------------------------------------


def test_stamp_counts_as_a_whole(spark):
    block = "struct<provider:string,model:string,schema_version:string>"
    df = spark.createDataFrame([("a", ("p", None, None)), ("b", None)], f"line_id string, block {block}")
    stamp = spark.createDataFrame([("q", "m", "v")], "provider string, model string, schema_version string")
    got = {r.line_id: (r.provider, r.model, r.schema_version) for r in prov.resolve_provenance(df, stamp).collect()}
    assert got == {"a": ("p", None, None), "b": ("q", "m", "v")}
    bare = {r.line_id: r.provider for r in prov.resolve_provenance(df, None).collect()}
    assert bare == {"a": "p", "b": None}
    with pytest.raises(prov.MixedRunsError, match="q/m/v"):
        prov.assert_single_run(prov.resolve_provenance(df, stamp))
    assert prov.assert_single_run(prov.resolve_provenance(df, stamp), allow_mixed=True).count() == 2


def test_two_merges_of_one_run_are_not_mixed(spark):
    df = spark.createDataFrame(
        [("a", ("p", "m", "v", "t1")), ("b", ("p", "m", "v", "t2"))],
        "line_id string, block struct<provider:string,model:string,schema_version:string,created:string>")
    assert prov.assert_single_run(prov.resolve_provenance(df, None)).count() == 2
    assert {r.mixed for r in prov.provenance_blocks(df).collect()} == {True}


def test_store_identity():
    check = prov.assert_store_identity
    assert check(None, "p", "m", "v") == {"provider": "p", "model": "m", "schema_version": "v"}
    mine = {"provider": "p", "model": "m", "schema_version": "v"}
    assert check(mine, "p", "m", "v") == mine and check(mine, "p", "m", None) == mine
    assert check({"provider": "p", "model": "m"}, "p", "m", "v") == mine
    for other in (("q", "m", "v"), ("p", "n", "v"), ("p", "m", "w")):
        with pytest.raises(prov.ForeignStoreError):
            check(mine, *other)


def test_record_block(spark):
    df = spark.createDataFrame([('{"_provenance":{"provider":"p"}}',), ('{"_provenance":3}',), ("{}",)], "body string")
    assert [r.block and r.block.provider for r in prov.record_block(df).collect()] == ["p", None, None]


def test_once_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["a.b", "c d", "e`f", "g"])
    got = once(df, "h", F.col("g") + 1)
    assert got.columns == ["a.b", "c d", "e`f", "g", "h"] and tuple(got.first()) == (1, 2, 3, 4, 5)


def test_gaps_over_many_bitmaps(spark):
    names = [("g", f"t{i:03d}") for i in range(150)]
    declared = spark.createDataFrame([(1, g, i, t, "nominal", None, None) for i, (g, t) in enumerate(names)], TRAITS)
    has = [(line, *n) for line, step in (("a", 1), ("b", 2), ("c", 63), ("x", 5)) for n in names[::step]] + [("b", "g", "unknown")]
    records = spark.createDataFrame(has * 2, "line_id string, group_name string, trait_name string")
    got = merge.gaps(lines(spark, "a", "b", "c", "d", "d"), records, declared, ["line_id"]).collect()
    assert sorted((r.line_id, r.trait_name) for r in got) == sorted((line, t) for line in "abcd" for g, t in names if (line, g, t) not in has)
    assert {r.trait_name: r.trait_ord for r in got if r.line_id == "d"} == {t: i for i, (_, t) in enumerate(names)}


def test_few_plain_traits_merge_as_many_do(spark, monkeypatch):
    from traitloom.operators import merge
    traits = spark.createDataFrame(
        [(1, "g", 1, "a", "nominal", None), (1, "g", 2, "n", "quantitative", "cm"), (2, "_h", 1, "a", "nominal", None)],
        "group_ord int, group_name string, trait_ord int, trait_name string, scale_type string, unit string")
    texts = [
        ("x", "s1", 1, '{"g":{"a":{"value":"old","rationale":"r"},"n":{"value":"1_000"}},"_h":{"a":{"value":"no"}}}'),
        ("x", "s2", 2, '{"g":{"a":{"rationale":"no value"},"other":{"value":1}}}'), ("y", "s1", 1, '{"g":[{"a":{"value":1}}]}'),
        ("y", "s2", 2, '{"g":{"a":{"value":null},"n":"bare"}}'), ("z", "s1", 1, '{"g":{"a":{"value":[1,{"k":2}],"rationale":3}}}'),
        ("gone", "s1", 1, '{"g":{"a":{"value":"v"}}}'), (None, "s1", 1, '{"g":{"a":{"value":"v"}}}'), ("w", "s1", 1, '[]')]
    answers = spark.createDataFrame(texts, "line_id string, shard_id string, position int, text string").withColumn("obj", F.try_parse_json("text"))
    lines = spark.createDataFrame([(v,) for v in ("x", "y", "z", "w", "x", None)], "line_id string")

    def rows():
        df = merge.merge_records(lines, answers, traits, ["line_id"])
        return df, sorted(map(str, df.withColumn("value", F.to_json("value")).collect()))
    few, got = rows()
    monkeypatch.setattr(merge, "FEW_TRAITS", 0)
    many, want = rows()
    assert got == want and len(got) == 3 and few.columns == many.columns
    assert few._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


def test_merged_lines_take_one_grouping(spark):
    kind = "group_ord int, group_name string, trait_ord int, trait_name string, scale_type string, unit string"
    traits = spark.createDataFrame(
        [(1, "g", 1, "a", "nominal", None), (1, "g", 2, "n", "quantitative", "cm"), (2, "_h", 1, "a", "nominal", None)], kind)
    texts = [  # line, shard, fresh, at, answer
        ("x", "s1", True, 1, '{"g":{"a":{"value":"first","rationale":"r"},"n":{"value":"1_000"}},"_h":{"a":{"value":"no"}}}'),
        ("x", "s1", True, 4, '{"g":{"a":{"value":"newest","rationale":3},"n":{"value":"2"}}}'),
        ("x", "s2", False, 9, '{"g":{"a":{"value":"adopted comes first"}}}'), ("x", "s3", True, 2, '{"g":{"n":"bare"}}'),
        ("y", "s1", False, 8, '{"g":{"a":{"value":"old"}}}'), ("y", "s1", True, 1, '{"g":{"a":{"value":null},"n":[1]}}'),
        ("z", "s2", True, 1, '{"g":{"a":{"value":[1,{"k":2}]},"n":{"value":"about 5"}}}'), ("z", "s1", True, 3, '{"g":{"n":{"value":7}}}'),
        ("gone", "s1", True, 1, '{"g":{"a":{"value":"v"}}}'), (None, "s1", True, 1, '{"g":{"a":{"value":"v"}}}'), ("w", "s1", True, 1, '[]')]
    given = spark.createDataFrame(texts, "line_id string, shard_id string, is_fresh boolean, at int, text string").withColumn(
        "obj", F.try_parse_json("text")).drop("text")
    asked = lines(spark, "x", "y", "z", "w", "x", "v")
    merged = merge.merged_lines(asked, given, traits, ["s1", "s2", "s3"], ["line_id"], ["at"])
    shown = lambda df: sorted(map(str, df.withColumn("value", F.to_json("value")).collect()))
    answers = rs.newest_answers(given, ["line_id", "shard_id"], ["at"], ["obj"])
    plain = merge.merge_records(asked, answers, traits, ["line_id"])
    got = merge.present_traits(*merged, ["line_id"])
    assert shown(got) == shown(plain) and len(shown(got)) == 4
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    missing = merge.missing_traits(*merged, ["line_id"])
    want = merge.gaps(asked, plain, traits, ["line_id"])
    assert sorted(map(tuple, missing.collect())) == sorted(map(tuple, want.select(*missing.columns).collect()))
    assert merge.merged_totals(merged[0]).collect() == merge.merge_totals(asked, want, ["line_id"]).collect()


def test_answers_of_undeclared_shards_are_not_lost_silently(spark, traits):
    given = spark.createDataFrame([("a", "s9", True, 1)], "line_id string, shard_id string, is_fresh boolean, at int").withColumn(
        "obj", F.try_parse_json(F.lit("{}")))
    with pytest.raises(Exception, match="not declared"):
        merge.merged_lines(lines(spark, "a"), given, traits, ["s1"], ["line_id"], ["at"])[0].collect()


def test_methods_too_long_to_compile_are_split(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000


def test_leaves_are_gathered_where_the_line_lies(spark, traits):
    """One shuffle brings the answers of a line together; its leaves, wide row and columns need no other."""
    from traitloom.operators.merge import line_answers
    texts = [
        ("a", "s1", False, 1, '{"g":{"x":{"value":"old"},"y":{"value":"kept"}}}'), ("a", "s2", True, 3, '{"g":{"x":{"value":"new"},"n":{"value":null}}}'),
        ("a", "s2", True, 2, '{"g":{"x":{"value":"early"},"z":{"value":"gone"}}}'), ("b", "s1", True, 1, '{"g":{"x":{"rationale":"r"}}}')]
    given = spark.createDataFrame(texts, "line_id string, shard_id string, is_fresh boolean, at int, body string").withColumn(
        "obj", F.try_parse_json("body")).drop("body")
    lines = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "line_id string")
    answers = line_answers(lines, given, ["s1", "s2"], ["line_id"], ["at"])
    found = tb.line_leaves(answers, 2, traits, ["line_id"])
    columns = tb.line_columns(found, traits)
    wide = tb.wide_lines(found, columns, ["line_id"])
    assert [c["name"] for c in columns] == ["n", "x", "y"]
    planned = wide._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert planned.count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, wide.collect()), key=str) == [("a", None, "new", "kept"), ("b", None, None, None), ("c", None, None, None)]


@pytest.mark.parametrize("few", [64, 0])
def test_streamed_records_equal_the_batch_merge(spark, tmp_path, monkeypatch, few):
    """Both shards answer one trait: as in the batch merge the later arrival counts."""
    from traitloom.streaming import live
    kind = "line_id string, shard_id string, status string, is_fresh boolean, at int, text string, ts timestamp"
    answer = '```json\n{{"whole":{{"rank":{{"value":{}}}}}}}\n```'
    slices = [
        [("a", "s1", "ok", True, 5, answer.format(1)), ("a", "s2", "ok", True, 2, answer.format(2)), ("b", "s1", "ok", True, 1, answer.format(3))],
        [("b", "s2", "api error", True, 1, None), ("a", "s2", "ok", True, 9, answer.format(4)), ("b", "s1", "ok", True, 7, answer.format(5))]]
    info = spark.createDataFrame(
        [(1, "whole", 1, "rank", "nominal", None)], "group_ord int, group_name string, trait_ord int, trait_name string, scale_type string, unit string")
    path, store, out, state = (str(tmp_path / n) for n in ("calls", "store", "out", "state"))
    monkeypatch.setattr(merge, "FEW_TRAITS", few)
    for rows in slices:
        made = spark.createDataFrame(rows, kind.rsplit(",", 1)[0]).withColumn("ts", F.timestamp_seconds("at"))
        made.write.mode("append").parquet(path)
        made.where("status = 'ok'").write.mode("append").parquet(store)
        live.drain(live.hand_out_records(
            live.finalize(spark.readStream.schema(kind).parquet(path), 2), lambda: spark.read.parquet(store), info, ["s1", "s2"],
            ["line_id"], ["at"], out, state))
    monkeypatch.undo()
    got = {r.line_id: r.raw for r in live.handed_out(spark, out, ["line_id"]).collect()}
    usable = spark.read.parquet(store).withColumn("obj", F.try_parse_json(F.regexp_extract("text", "[{].*[}]", 0)))
    want = merge.present_traits(*merge.merged_lines(lines(spark, "a", "b"), usable, info, ["s1", "s2"], ["line_id"], ["at"]), ["line_id"])
    assert got == {r.line_id: r.raw for r in want.collect()} == {"a": "1", "b": "5"}


def _merged_for_documents(spark, group_of_last):
    kind = "group_ord int, group_name string, trait_ord int, trait_name string, scale_type string, unit string"
    info = spark.createDataFrame(
        [(2, "b", 1, "n", "quantitative", "cm"), (1, "z", 2, "a b", "nominal", None), (1, "z", 2, "a", "nominal", None),
         (None, "b" if group_of_last else "y", None, "first", "ordinal", None)], kind)
    rows = [("x", "s1", '{"b":{"n":{"value":" 1_0.5 ","rationale":"q\\"é"},"first":{"value":3}},"z":{"a":{"value":null},"a b":{"value":[1,{"k":2}]}}}'),
            ("x", "s2", '{"y":{"first":{"value":true}},"_provenance":{"old":1}}'), ("y", "s1", '{"b":{"n":{"value":"about"}}}'),
            ("w", "s1", "[]"), ("gone", "s1", '{"b":{"n":{"value":1}}}')]
    given = spark.createDataFrame(rows, "line_id string, shard_id string, t string").withColumns(
        {"obj": F.try_parse_json("t"), "is_fresh": F.lit(True), "at": F.lit(1)}).drop("t")
    asked = lines(spark, "x", "y", "w", None, "x", None)
    return asked, merge.merged_lines(asked, given, info, ["s1", "s2"], ["line_id"], ["at"])


@pytest.mark.parametrize("group_of_last", [False, True])
def test_documents_of_merged_lines_need_no_other_grouping(spark, group_of_last):
    """a line's document is written where the line was merged; also with a group that comes back later."""
    asked, merged = _merged_for_documents(spark, group_of_last)
    block = merge.provenance_block(provider="p")
    got = merge.record_documents(asked, merged, ["line_id"], block)
    want = merge.record_documents(asked, merge.present_traits(*merged, ["line_id"]), ["line_id"], block)
    if not group_of_last:  # one shuffle for the merge, one for lines without an id
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    shown = lambda df: sorted(map(str, df.collect()))
    assert shown(got) == shown(want) and len(shown(got)) == 4


def test_stamped_documents_of_merged_lines(spark):
    """F8: the stamp of a later run meets documents that were written in place."""
    asked, merged = _merged_for_documents(spark, False)
    later = merge.provenance_block(provider="q")
    again = merge.stamp(merge.record_documents(asked, merged, ["line_id"], merge.provenance_block(provider="p")), later)
    found = {r.line_id: json.loads(r.body) for r in again.collect()}
    assert {d["_provenance"]["provider"] for d in found.values()} == {"q"} and set(found) == {"x", "y", "w", None}
    assert list(found["x"]) == ["_provenance", "y", "z", "b"] and list(found["x"]["z"]) == ["a b", "a"]
    assert found["x"]["b"]["n"] == {"rationale": 'q"é', "value": 10.5} and found["y"]["b"]["n"]["value"] is None
    assert "Join" not in again._jdf.queryExecution().executedPlan().toString()
