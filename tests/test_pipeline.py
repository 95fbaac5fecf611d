"""Comparison, schema documents, sources, streams and plan shapes."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from traitloom.operators import compare as cp, planning, responses as rs, runs, schema as sc
from traitloom.sources import scans, sinks
from traitloom.streaming import live

LONG = "line_id string, group_name string, trait_name string, scale_type string, run_no int, raw string, num double"


@pytest.fixture(scope="module")
def table(spark):
    values = {  # trait: scale, runs 1..4 (1, 2 = one config; 3, 4 = the other)
        "p": {"a": ("nominal", "x", "x", "y", "y"), "b": ("nominal", "x", "not_assessable", "not_assessable", "x"),
              "c": ("quantitative", "1.0", "1.5", "2.0", "2.0")},
        "q": {"a": ("nominal", "x", "x", "x", "x"), "b": ("nominal", "x", "y", "x", "y"), "c": ("quantitative", "1.0", "1.0", "1.0", "3.0")},
    }
    rows = [
        (line, "g", trait, scale, i + 1, v, float(v) if scale == "quantitative" else None)
        for line, traits in values.items() for trait, (scale, *vs) in traits.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, LONG)


@pytest.fixture(scope="module")
def cells(table):
    return cp.run_cells(table, [1, 2, 3, 4], F.col("raw"), ["scale_type"])


def test_agreement(cells):
    got = {(r.run_a, r.run_b): (r.compared, r.agreeing) for r in cp.agreement(cells, [1, 2, 3, 4]).collect()}
    assert got == {(1, 2): (6, 3), (1, 3): (6, 3), (1, 4): (6, 2), (2, 3): (6, 3), (2, 4): (6, 2), (3, 4): (6, 3)}


def test_many_pairs_take_several_passes(cells, monkeypatch):
    whole = sorted(map(tuple, cp.agreement(cells, [1, 2, 3, 4]).collect()))
    monkeypatch.setattr(cp, "PAIRS_PER_PASS", 2)
    assert sorted(map(tuple, cp.agreement(cells, [1, 2, 3, 4]).collect())) == whole


def test_noise_shift_and_drift(cells, table):
    noise = {r.line_id: (r.noise_a, r.noise_b, r.cross_mean, r.excess) for r in cp.noise_excess(cells, [1, 2], [3, 4]).collect()}
    assert noise == {"p": (2.0, 1.0, 2.5, 1.0), "q": (1.0, 2.0, 1.0, -0.5)}
    shifted = {r.trait_name: (r.cells, r.shifted) for r in cp.shifted_cells(cells, [1, 2], [3, 4]).collect()}
    assert shifted == {"a": (2, 1), "b": (2, 0), "c": (2, 1)}
    numbers = cp.run_cells(table.where("scale_type = 'quantitative'"), [1, 2, 3, 4], F.col("num"))
    d = cp.drift(numbers, [1, 2], [3, 4]).first()
    assert (d.mean_within, d.mean_cross) == (0.25, (1 + 1 + 0.5 + 0.5 + 0 + 2 + 0 + 2) / 8)


def test_paired_stats(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (-0.5, 4.0), (1.5, 1.0)], "x double, y double")
    r = cp.with_p_value(cp.paired_stats(df, "x", "x", "y")).first()
    assert (r.n, r.df, r.positive) == (4, 3, 3)
    assert r.mean == pytest.approx(1.0) and r.sd == pytest.approx(1.080123, abs=1e-6) and r.t == pytest.approx(1.851640, abs=1e-6)
    assert r.p == pytest.approx(0.16116, abs=1e-4) and r.ci_low < 0 < r.ci_high


def test_published_statistics(spark):
    # A published table of 10 paired differences and its summary.
    excess = [-0.25, -0.5, 4.0, 4.0, 1.25, 3.25, 1.75, 2.5, 1.25, -0.5]
    df = spark.createDataFrame([(x,) for x in excess], "x double")
    r = cp.with_p_value(cp.paired_stats(df, "x")).first()
    assert [round(v, 2) for v in (r.sd, r.se, r.t, r.ci_low, r.ci_high)] == [1.75, 0.55, 3.03, 0.42, 2.93]
    assert (r.positive, round(r.p, 4)) == (7, 0.0143)


def test_support_of_growing_runs(spark):
    def run(n, lines):
        return spark.range(*lines).select(
            F.lit(n).alias("run_no"), F.concat(F.lit("l"), "id").alias("line_id"), F.lit("g").alias("group_name"),
            F.lit("t").alias("trait_name"), F.lit("nominal").alias("scale_type"),
            F.when(F.col("id") % 10 == 0, "not_assessable").when(F.col("id") % 3 == 0, "a").when(F.col("id") % 7 == 0, F.lit(None)).otherwise("b").alias("raw"))
    first, second = run(1, (0, 40_000)), run(2, (20_000, 70_000))
    exact = {r.value: r.support for r in cp.support(first.unionByName(second)).collect()}
    coarse = cp.support_sketches(second, ["run_no"], lg_k=10)
    for later, error in ((cp.support_sketches(second, ["run_no"]), 1.04 / 64), (coarse, 1.04 / 32)):
        found = cp.merged_support(cp.support_sketches(first, ["run_no"]).unionByName(later)).collect()
        assert {r.value for r in found} == set(exact) == {"a", "b"}
        for r in found:
            assert r.error == pytest.approx(error) and abs(r.support - exact[r.value]) <= 4 * error * exact[r.value]
    by_run = cp.merged_support(cp.support_sketches(first.unionByName(second), ["run_no"]), ["run_no"])
    assert by_run.count() == 4
    assert cp.support(first, approx=True).columns == cp.support(first).columns
    assert cp.merged_support(cp.support_sketches(first.limit(0))).count() == 0


def docs(spark, *bodies):
    return spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "doc_id int, body string")


def test_schema_documents(spark):
    trait = {"trait_name": "t", "scale_type": "ordinal", "values": [{"level": 0, "label": "none", "definition": "d"}]}
    found = sc.read_traits(docs(spark, {"trait_groups": {"z": {"traits": [trait]}, "a": {"traits": [trait]}}},
                                {"groups": [{"name": "only", "traits": [trait]}]}, {"x": 1})).orderBy("doc_id", "group_ord").collect()
    assert [(r.doc_id, r.group_ord, r.group_name, r.n_values) for r in found] == [(0, 1, "z", 1), (0, 2, "a", 1), (1, 1, "only", 1)]
    for bad in ({"x": 1}, {"groups": [{"traits": []}]}, {"groups": [{"name": "g", "traits": []}, {"group": "g", "traits": []}]}):
        with pytest.raises(sc.SchemaDocumentError):
            sc.read_traits(docs(spark, bad), strict=True)


def test_versions_stop_below_a_difference(spark):
    def version(v, *bodies):
        return docs(spark, *bodies).withColumn("version", F.lit(v))
    base = {"properties": {"a": {"properties": {"x": {"enum": ["p", "q"]}}}, "l": {"items": {"type": "string"}}}}
    same = {"properties": {"a": {"properties": {"x": {"type": "string", "enum": ["q", "p"]}}}, "l": {"items": {"type": "string"}}}}
    other = {"properties": {"a": {"properties": {"y": {"enum": ["p"]}}}, "l": {"items": {"type": "number"}}}}
    assert sc.schema_diff(version("1", base).unionByName(version("2", same)), ["1", "2"]).collect() == []
    found = sc.schema_diff(version("1", base).unionByName(version("2", other)), ["1", "2"]).collect()
    assert sorted(("/".join(r.path), r.problem) for r in found) == [("a", "names or order differ"), ("l/[]", "type differs")]


def test_enums_are_sets_over_all_versions(spark):
    def version(v, **enums):
        return docs(spark, {"properties": {k: {"enum": e} for k, e in enums.items()}}).withColumn("version", F.lit(v))
    three = version("1", a=["p", "q", "p"], b=[1, 2], c=[], gone=["x"]).unionByName(
        version("2", a=["q", "p"], b=[1, 2], c=[])).unionByName(version("3", a=["p", "q"], b=[1, "2"], c=[], new=["y"]))
    found = {r.path[0]: (r.same, r.members) for r in sc.enum_sets(three, ["1", "2", "3"]).collect()}
    assert found == {"a": (True, 2), "b": (False, 2), "c": (True, 0), "gone": (False, 1), "new": (False, None)}


def test_definitions_are_cut_at_sentence_ends(spark):
    note = "semi_erect = leans, 5.5 deg. Next. erect = upright (e.g. a stake); flat = on the ground."
    df = spark.createDataFrame([(note, ["erect", "semi_erect", "flat", "gone"])], "note string, categories array<string>")
    assert {r.category: r.definition for r in sc.extract_defs(df).collect()} == {
        "erect": "upright (e.g. a stake)", "semi_erect": "leans, 5.5 deg", "flat": "on the ground"}


# -- sources ------------------------------------------------------------------


def test_a_missing_counter_fails(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("epoch\tmem_available_kb\tother\n1.5\tNA\t3\n")
    with pytest.raises(Exception):
        scans.read_samples(spark, str(tmp_path / "m.tsv"), scans.MEMORY_SCHEMA).collect()
    (tmp_path / "ok.tsv").write_text("epoch\tmem_available_kb\tcommitted_as_kb\n1.5\tNA\t3\n")
    assert tuple(scans.read_samples(spark, str(tmp_path / "ok.tsv"), scans.MEMORY_SCHEMA).first()) == (1.5, None, 3.0)


def test_image_tree(spark, tmp_path):
    (tmp_path / "l1").mkdir()
    (tmp_path / "l2").mkdir()
    (tmp_path / "l1" / "note.txt").write_text("x")
    with pytest.raises(scans.NoImagesError):
        scans.require_images(scans.read_images(spark, str(tmp_path)))
    (tmp_path / "l1" / "b.JPG").write_bytes(b"123")
    images = scans.require_images(scans.read_images(spark, str(tmp_path)))
    assert [(r.line_id, r.file_name, r.length, r.media_type) for r in images.collect()] == [("l1", "b.JPG", 3, "image/jpeg")]
    lines = spark.createDataFrame([("l1",), ("l2",)], "line_id string")
    assert [r.line_id for r in scans.lines_without_images(lines, images).collect()] == ["l2"]


def test_files_and_manifests(spark, tmp_path):
    files = spark.createDataFrame([("a.json", '{"g":{"t":{"value":1}}}'), ("a.gaps.json", "{}"), ("b.json", "{")], "name string, content string")
    assert sinks.export_files(files, f"file://{tmp_path}/r") == 3
    assert sorted((r.line_id, r.obj is None) for r in scans.read_records(spark, f"file://{tmp_path}/r").collect()) == [("a", False), ("b", True)]
    (tmp_path / "m.json").write_text('{"version": 1,\n "files": {"/x/l1/a.jpg": "f1"}}')
    assert [tuple(r) for r in scans.read_manifest(spark, str(tmp_path / "m.json")).collect()] == [
        ("l1", "a.jpg", "/x/l1/a.jpg", "f1")]
    (tmp_path / "n.json").write_text('{"files": {"/x/l1/a.jpg": "f1"}}\n{"files": {"/x/l2/b.jpg"\n{"files": {"/x/l2/b.jpg": "f2"}}\n')
    assert sorted(r.file_id for r in scans.read_manifest(spark, str(tmp_path / "n.json")).collect()) == ["f1", "f2"]
    assert scans.read_manifest(spark, str(tmp_path / "none.json")).count() == 0


def test_results_with_repeats_and_broken_lines(spark, tmp_path):
    good = '{"custom_id":"%s","response":{"status_code":200,"body":{"output":[{"type":"message","content":[{"type":"output_text","text":"%s"}]}]}}}'
    bad = '{"custom_id":"%s","error":%s,"response":{"status_code":200}}'
    (tmp_path / "ok.jsonl").write_text("\n".join([good % ("a", "old"), good % ("b", "one"), '{"custom_id":"c", "resp', good % ("a", "new"), "", '{"x":1}']) + "\n")
    (tmp_path / "err.jsonl").write_text("\n".join([
        bad % ("x", '{"message":"one"}'), bad % ("x", '{"message":"two"}'), bad % ("a", '{"code":"late"}'), bad % ("y", '{"type":"server_error"}'),
        bad % ("z", "{}")]) + "\n")
    ok, err = str(tmp_path / "ok.jsonl"), str(tmp_path / "err.jsonl")
    done = {r.custom_id: r for r in rs.classify_response(scans.read_results(spark, ok, err)).collect()}
    assert {k: r.text for k, r in done.items() if r.status == "ok"} == {"a": "new", "b": "one"}
    assert done["x"].detail == "error: one" and done["y"].detail == 'error: {"type":"server_error"}' and done["z"].detail == "no output_text in response"
    assert sorted(r.value for r in scans.broken_results(spark, ok, err).collect()) == ['{"custom_id":"c", "resp', '{"x":1}']


def test_sections_of_lines_without_answer(spark, tmp_path):
    lines = spark.createDataFrame([(i, f"l{i}") for i in range(4)], "n int, section_id string")
    answers = spark.createDataFrame([("l1", "one"), ("l3", "three")], "section_id string, text string")
    sinks.write_sections(sinks.complete_sections(lines, answers), str(tmp_path / "s"), ["n"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "s").glob("part-*")))
    assert text.split("\n\n---\n\n")[:4] == ["### l0\n\n[NOT FOUND IN RESULTS]", "### l1\n\none", "### l2\n\n[NOT FOUND IN RESULTS]", "### l3\n\nthree"]


# -- runs ---------------------------------------------------------------------


def test_cold_is_the_first_call_sent(spark):
    df = spark.createDataFrame([("a", 1, "skip (cached)"), ("a", 2, "api error"), ("a", 3, "ok")], "line_id string, i int, status string")
    got = runs.mark_cold(df.withColumn("ts", F.timestamp_seconds("i"))).orderBy("i").collect()
    assert [r.call_class for r in got] == [None, "cold", "warm"]


def test_a_failing_scorer_becomes_rows(spark):
    requests = planning.plan_requests(
        spark.createDataFrame([("a",), ("b",)], "line_id string"), spark.createDataFrame([(1, "s1"), (2, "s2")], "shard_ord int, shard_id string"))

    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        raise RuntimeError("down")
    rows = planning.apply_scorer(requests, scorer).collect()
    assert len(rows) == 4 and {(r.status, r.detail) for r in rows} == {("api error", "RuntimeError: down")}


def test_shards_of_a_line_arrive_in_order(spark):
    requests = planning.plan_requests(
        spark.createDataFrame([(f"l{i}",) for i in range(40)], "line_id string"),
        spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "shard_ord int, shard_id string"))

    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        in_order = batch.groupby("line_id").shard_ord.apply(lambda s: list(s) == [1, 2, 3])
        assert in_order.all()
        return pd.DataFrame({"custom_id": batch.custom_id, "status": "ok", "detail": None, "text": "{}", "input_tokens": 1, "output_tokens": 1})
    assert {r.status for r in planning.apply_scorer(requests, scorer).collect()} == {"ok"}


# -- streams ------------------------------------------------------------------


def feed(spark, path, slices, schema):
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


CALL = "line_id string, shard_id string, status string, t int"


def test_late_delivery_finalizes_again(spark, tmp_path):
    slices = [[("a", "1", "ok", 1), ("b", "1", "ok", 2)], [("a", "2", "api error", 3)], [("a", "2", "ok", 4)]]
    stream = feed(spark, f"{tmp_path}/in", slices, CALL).withColumn("ts", F.timestamp_seconds("t"))
    live.drain(live.upsert(live.finalize(stream, 2), f"{tmp_path}/out", f"{tmp_path}/state"))
    finals = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.line_id, r.version, r.answered) for r in finals.collect()) == [("a", 2, 1), ("a", 3, 2)]
    every = spark.createDataFrame([("a",), ("b",)], "line_id string")
    assert [r.line_id for r in live.finalize_rest(every, finals).collect()] == ["b"]


def test_hand_out_removes_the_state_of_a_line(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    try:
        def run(slices):
            stream = feed(spark, f"{tmp_path}/in", slices, CALL).withColumn("ts", F.timestamp_seconds("t"))
            query = live.append(live.hand_out(stream, 2, ["line_id"], "10 minutes", "1 second"), f"{tmp_path}/out", f"{tmp_path}/state")
            live.drain(query)
            rows = spark.read.parquet(f"{tmp_path}/out").collect()
            return sorted(((r.line_id, r.attempted, r.answered, r.complete) for r in rows), key=str), query.lastProgress["stateOperators"][0]["numRowsTotal"]

        a = ("a", 2, 1, True)
        given, _ = run([[("a", "1", "ok", 10), ("b", "1", "ok", 20), (None, "1", "ok", 25)], [("a", "2", "api error", 30)]])
        assert given == [a]
        # started again from its checkpoint: a re-delivery changes nothing, the lines left open come when they were idle
        given, _ = run([[("a", "2", "ok", 40), ("c", None, "ok", 40)], [("z", "1", "ok", 5000)]])
        assert [g for g in given if g[0] == "a"] == [a]
        given, rows = run([[("z", "2", "ok", 9000)], [("y", "1", "ok", 20000)], [("y", "1", "ok", 20001)]])
        assert given == sorted([a, ("b", 1, 1, False), (None, 1, 1, False), ("z", 2, 2, True)], key=str)
        few, many = rows, run([[(f"l{i}", s, "ok", 30000 + i) for i in range(50) for s in "12"], [("y", "1", "ok", 90000)], [("y", "1", "ok", 90001)]])[1]
        assert many == few  # one open line, whatever was given out before
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_first_delivery_wins_within_the_watermark(spark, tmp_path):
    slices = [[("a", "1", "ok", 100)], [("a", "1", "api error", 101), ("a", "2", "ok", 102)]]
    stream = feed(spark, f"{tmp_path}/in", slices, CALL).withColumn("ts", F.timestamp_seconds("t"))
    first = live.first_deliveries(stream, ["line_id", "shard_id"], "ts", "1 minute")
    live.drain(live.intake(first, f"{tmp_path}/store", f"{tmp_path}/state"))
    got = spark.read.parquet(f"{tmp_path}/store").collect()
    assert sorted((r.shard_id, r.status) for r in got) == [("1", "ok"), ("2", "ok")]


def test_sliding_monitor(spark, tmp_path):
    schema = "t int, gauge double"
    stream = feed(spark, f"{tmp_path}/in", [[(0, 5.0), (70, 1.0)], [(1000, 9.0)], [(2000, 9.0)]], schema).withColumn("ts", F.timestamp_seconds("t"))
    watched = live.monitor(stream, "gauge", 2.0, "2 minutes", "1 minute", late="1 minute")
    live.drain(live.append(watched, f"{tmp_path}/out", f"{tmp_path}/state"))
    got = spark.read.parquet(f"{tmp_path}/out").where("w_start < timestamp_seconds(900)").orderBy("w_start").collect()
    assert [(r.low, r.samples, r.alarm) for r in got] == [(5.0, 1, False), (1.0, 2, True), (1.0, 1, True)]


# -- plans ------------------------------------------------------------------


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


SF = "/root/testdata/sf0.001"


def test_plan_shapes(spark):
    from traitloom.operators import merge, table as tb
    from traitloom.plans import inputs as src
    planned = plan_of(planning.plan_requests(src.lines(spark, SF), src.shards(spark)))
    assert "Join" not in planned and "Exchange" not in planned and "ReadSchema: struct<o_orderkey:bigint>" in planned
    typed = plan_of(tb.type_leaves(tb.flatten_leaves(src.answers(spark, SF), src.RUN_LINE), src.traits(spark)))
    assert "BroadcastHashJoin" in typed and "SortMergeJoin" not in typed
    records = src.records(spark, SF)
    missing = plan_of(merge.gaps(src.run_lines(spark, SF), records, src.traits(spark), src.RUN_LINE))
    assert "CartesianProduct" not in missing and "BroadcastNestedLoopJoin" not in missing
    pairs = plan_of(cp.agreement(cp.run_cells(records, src.RUNS, F.col("raw")), src.RUNS))
    assert pairs.count("Scan parquet") <= 4 and "CartesianProduct" not in pairs


def test_only_needed_columns_are_read(spark):
    from traitloom.plans import inputs as src
    from traitloom.operators import runs as ops
    text = plan_of(ops.status_counts(src.progress(spark, SF), ["line_id"]))
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in text


# -- size -----------------------------------------------------------------------


def test_estimates_broadcast_nothing(spark):
    """The rows that unfolding gives are no part of an estimate, so only sizes measured at run time count."""
    from traitloom.operators import table as tb
    doc = docs(spark, {"trait_groups": {"g": {"traits": [{"trait_name": "t", "scale_type": "nominal", "values": ["a"]}]}}})
    traits = sc.read_traits(doc)
    paths = traits.select("doc_id", F.array("group_name", "trait_name").alias("path"), "scale_type", "unit")
    frames = [sc.trait_diff(traits, traits.withColumn("trait_name", F.lit("u")))]
    frames += [tb.resolve_names(paths, mode, table=["doc_id"]) for mode in ("prefix_collided", "prefix_all", "error")]
    for df in frames:
        assert "BroadcastExchange" not in df._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r.trait_name, r.side) for r in frames[0].collect()) == [("t", "missing"), ("u", "extra")]


def test_pages_of_one_address_are_images_of_their_own(spark, tmp_path):
    from traitloom.plans import run_queries
    pages = [(1, "http://h/a"), (2, "http://h/a"), (9, "http://h/a"), (9, "http://h/b#3")]
    spark.createDataFrame(pages, "page_id bigint, url string").withColumn("html", F.lit("")).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in run_queries.split_uploads(spark, str(tmp_path)).select("path", "is_cached", "file_id").collect())
    assert got == [("http://h/a", False, None), ("http://h/a", True, "file-1"), ("http://h/a", True, "file-2"), ("http://h/b#3", False, None)]


def test_constraint_nodes_of_odd_schemas(spark):
    texts = ['{"properties":{"b":{"enum":[2,1,2]},"a":null,"c":{"items":{"type":["string","null"]}}}}', '[1]', '"x"', '{"type":"object","enum":[1', '{"enum":[1],"type":']
    one = spark.createDataFrame(list(enumerate(texts)), "doc_id int, body string").withColumn("version", F.lit("1"))
    found = {(r.doc_id, *r.path): (r.kind, r.payload) for r in sc.constraint_nodes(one).collect()}
    assert found == {
        (0,): ("properties", ["b", "a", "c"]), (0, "b"): ("enum", ["1", "2"]), (0, "a"): ("type", [None]), (0, "c"): ("items", []),
        (0, "c", "[]"): ("type", ['["string","null"]']), (1,): ("type", [None]), (2,): ("type", [None]),
        (3,): ("type", [None]), (4,): ("type", [None])}
    assert "get_json_object(body" not in sc.constraint_nodes(one, max_depth=1)._jdf.queryExecution().analyzed().toString()


def test_result_files_are_compressed(spark, monkeypatch):
    from pathlib import Path

    from traitloom.plans import answer_queries
    made, plain = [], answer_queries.scratch
    monkeypatch.setattr(answer_queries, "scratch", lambda s, name: made.append(plain(s, name)) or made[-1])
    answer_queries.scan_results(spark, "/root/testdata/sf0.001")
    files = [f.name for path in made for f in Path(path).glob("part-*")]
    assert files and all(f.endswith(".json.gz") for f in files)


def test_cells_are_not_moved(spark):
    """The runs of a line meet as one row each: cells unfold after it, and grouping by line needs no shuffle of its own."""
    from traitloom.plans import inputs as src
    from traitloom.plans.catalog import QUERIES
    merged, _, rows = src.merged(spark, SF)
    moved = plan_of(merged).count("Arguments: hashpartitioning")
    assert plan_of(QUERIES["noise_excess"](spark, SF)).count("Arguments: hashpartitioning") == moved + 1
    whole = cp.line_cells(merged, rows, src.RUNS, lambda scale, raw: raw)
    plain = cp.run_cells(src.records(spark, SF), src.RUNS, F.col("raw"), ["scale_type"])
    columns = [*cp.CELL, "scale_type", "vals"]
    got, want = (sorted((tuple(r[:4]), sorted(r[4].items())) for r in df.select(columns).collect()) for df in (whole, plain))
    assert got == want and len(got) > 1000
    numbers = cp.line_cells(merged, rows, [1, 2], lambda scale, raw: raw, "quantitative")
    assert {r.scale_type for r in numbers.collect()} == {"quantitative"}


ODD_SCHEMAS = [
    '{"properties":{"b":{"enum":[2,1,"2","é/\u2028"]},"a":{"type":["string","null"]},"c":{"items":{"type":"string"}},"":{}}}',
    '{ "properties" : {\n"p": {"items": {"properties": {}}}, "q": {"enum": []}, "r": {"minimum": 12345678901234567890123}}}',
    '{"enum":["x"],"properties":{"a":{"type":"string"}},"type":"string"}', "{}", '{"type":["a"]}', None,
    '{"properties":{"a":null}}', '{"properties":{"a":{"type":""}}}', '{"properties":{"a":{"enum":[1.0,true,null,[1]]}}}',
    '{"properties":{"a":{"type":"x"},"a":{"type":"y"}}}', '{"enum":"[1]"}', '{"properties":"{}"}', '{"type":"a\\u0041"}', "[1]", '{"type":"x"', "NaN",
    '{"properties":{"a":{"items":[{"type":"x"}]}},"x":1e999}', '{"type":"x"} tail', "{'type':'x'}", '{"type":null}', '{"items":{"enum":[100000000000000000000]}}']


def _odd_versions(spark):
    texts = [(i, v, t) for i, t in enumerate(ODD_SCHEMAS) for v in ("1", "2")]
    texts += [(100, "1", ODD_SCHEMAS[0]), (100, "2", ODD_SCHEMAS[0].replace('"2",', "")), (101, "1", ODD_SCHEMAS[1]), (102, None, "{}"), (102, "2", "{}"),
              (103, "1", '{"properties":{"a":{"properties":{"x":{}}}}}'), (103, "2", '{"properties":{"a":{"items":{}},"z":{}}}'),
              (104, "1", '{"properties":{"a":{}}}'), (104, "2", '{"properties":{"b":{"enum":[1.5]}}}'), (105, "1", "{}"), (105, "1", '{"type":"x"}'),
              (None, "1", '{"properties":{"a":{"type":"x"}}}'), (None, "2", '{"properties":{"a":{"type":"y"},"b":{}}}'), (None, "2", "{}")]
    return spark.createDataFrame(texts, "doc_id int, version string, body string")


def test_plain_schemas_are_read_as_a_whole(spark, monkeypatch):
    """plain documents are read once, however deep; before, each level of all was opened."""
    plain = spark.createDataFrame(
        [(1, "1", ODD_SCHEMAS[0]), (1, "2", ODD_SCHEMAS[0].replace('"string"}', '"number"}')), (2, "1", "{}"), (2, "2", "{}")],
        "doc_id int, version string, body string")
    monkeypatch.setattr(sc, "_described", lambda rows: pytest.fail("a plain document was opened level by level"))
    found = sc.schema_diff(plain, ["1", "2"]).collect()
    assert [(r.doc_id, r.path, r.problem) for r in found] == [(1, ["c", "[]"], "type differs")]


def test_odd_schemas_differ_as_before(spark):
    """whole texts and levels give the same nodes and differences."""
    docs_ = _odd_versions(spark)
    seen = lambda df: sorted(map(repr, df.collect()))
    assert seen(sc.constraint_nodes(docs_)) == seen(sc._opened_nodes(docs_, 8))
    whole = seen(sc.schema_diff(docs_, ["1", "2"]))
    assert whole == seen(sc._placed_differences(docs_, ["1", "2"], None)) and len(whole) > 8
    assert seen(sc.schema_diff(docs_.withColumn("doc_id", F.col("doc_id").cast("double")), ["1", "2"])) == [
        r.replace("doc_id=", "doc_id=").replace(",", ".0,", 1) if "doc_id=None" not in r else r for r in whole]
    with pytest.raises(Exception, match="nested too deep"):
        sc.constraint_nodes(docs_, max_depth=1).collect()


def test_enums_of_plain_schemas_are_read_as_a_whole(spark, monkeypatch):
    """enums come from whole texts, and no other node leaves the reading."""
    docs_ = _odd_versions(spark)
    want = sorted(map(repr, sc._opened_nodes(docs_, 8).where("kind = 'enum'").collect()))
    assert sorted(map(repr, sc.constraint_nodes(docs_, kinds=["enum"]).collect())) == want and len(want) > 4
    monkeypatch.setattr(sc, "_described", lambda rows: pytest.fail("a plain document was opened level by level"))
    plain = docs_.where("doc_id in (0, 100)")
    found = {(r.doc_id, r.path[0]): (r.same, r.members) for r in sc.enum_sets(plain, ["1", "2"]).collect()}
    assert found == {(0, "b"): (True, 4), (100, "b"): (False, 4)}


def test_lines_are_merged_once_for_both_supports(spark):
    """exact counts and sketches read the same moved lines; before, each parsed all answers of its own."""
    from traitloom.plans import inputs as src
    from traitloom.plans.catalog import QUERIES
    merged, info, rows = src.merged(spark, SF)
    shown = lambda df: sorted(map(repr, df.collect()))
    usable, _ = cp._shown(src.records(spark, SF))
    columns = ["run_no", "line_id", "group_name", "trait_name", "scale_type", "raw"]
    got = cp.shown_lines(merged, rows)
    assert got.schema["run_no"].dataType == usable.schema["run_no"].dataType
    assert shown(got.where("raw != 'not_assessable'").select(columns)) == shown(usable.select(columns))
    done = QUERIES["support_merged"](spark, SF)
    done.collect()
    assert "ReusedExchange" in done._jdf.queryExecution().executedPlan().toString()


def test_files_of_a_finished_step_go(spark, tmp_path):
    """shuffle files of a write are gone when the next step begins."""
    import time
    from pathlib import Path

    from traitloom.session import CLEANUP, tidy
    before = spark.conf.get(CLEANUP, None)
    local = lambda: {f for top in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
                     for f in Path(top).rglob("shuffle_*.data")}
    held = local()
    with tidy(spark):
        spark.range(1000).repartition("id").write.parquet(str(tmp_path / "rows"))
    for _ in range(100):
        if not local() - held:
            break
        time.sleep(0.1)
    assert not local() - held and spark.read.parquet(str(tmp_path / "rows")).count() == 1000
    assert spark.conf.get(CLEANUP, None) == before
