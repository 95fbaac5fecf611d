"""Transcript parsing against exhaustive search and known roles."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from traitloom.llm import chat, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return chat.fit(queries.table(spark, SF, "conversations"))


@pytest.mark.parametrize("text", [
    "User: hi there\nAssistant: hello, this is a long reply that goes on\nand on\nQ: why?\nA: because", "no marker at all\n\nanother\nthird line",
    "### System\nbe kind\n[user] go\n\nAnswer: 4\nAnswer: 5", "**Human:** a\n**AI:** b\n\nc?\nd", "A: first\nA: second\nUser - third"])
def test_viterbi_finds_the_best_path(model, text):
    lines = chat.observed(text)

    def score(path):
        total = 0.0
        for k, (seen, state) in enumerate(zip(lines, path)):
            total += chat.transition(model, path[k - 1] if k else None, state) + chat.emission(model, seen, state)
        return total

    best = max(map(score, itertools.product(range(6), repeat=len(lines))))
    assert math.isclose(score(chat.viterbi(model, lines)), best)


def test_roles_are_recovered(spark):
    got = queries.op6_chat(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    assert sum(r.as_given for r in got) >= 0.9 * len(got)


def test_marked_transcripts_come_back_whole(spark, model):
    turns = [("system", "Be brief."), ("user", "Is it?\nReally?"), ("assistant", "It is.\nAnd so on,\nfor some lines."), ("user", "Good.")]
    text = "\n".join(f"{r.title()}: {t}" for r, t in turns)
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", "z"), (4, " \n\n", "q"), (1, text, "x")], "conv_id long, text string, turns string")
    out = chat.parse(docs, model)
    assert out.columns == ["conv_id", "text", "turns", "turns_"]
    got = [(r.conv_id, [(t.role, t.text) for t in r.turns_]) for r in out.orderBy("conv_id").collect()]
    assert got == [(1, turns), (1, turns), (2, []), (3, []), (4, [])]
    shown = out.where("conv_id = 1").select(chat.rendered(F.col("turns_")).alias("s")).first().s
    assert shown.startswith("<|system|>\nBe brief.\n<|end|>\n<|user|>\nIs it?\nReally?\n<|end|>\n")


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "what"), (None, 0, "user", "a"), (None, None, "bot", "b"), (2, 0, "assistant", "x" * 5000), (2, 0, "assistant", "x" * 5000), (3, 0, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.transcripts(turns)
    assert made.count() == 4 and chat.parse(made, chat.fit(turns)).count() == 4
    empty = turns.limit(0)
    assert chat.parse(chat.transcripts(empty), chat.fit(empty)).count() == 0
