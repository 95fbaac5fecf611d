"""Roles of transcript lines by a hidden Markov model, and canonical turns.

Every line of a transcript has a hidden state: a role (system, user, assistant)
and whether the line begins a turn or goes on with one.  What is seen of a line
is its speaker marker, if any, whether a blank line stands before it, how long
it is, and whether it asks something.  Viterbi's algorithm finds the most
probable states, so a missing marker is made up for by its neighbours, and a
word such as "Answer:" inside a reply does not begin a turn by itself.

Probabilities of transitions, turn lengths and line lengths are counted over
all turns of a labelled table (``fit``); those of markers are fixed values.

Null and empty transcripts have no turns.  Turns are ordered by turn number,
then role and text, so ties and repeated rows have one order; a null role has no
marker, a null text is empty, and rows without conversation id are one
conversation.  Other columns pass through ``parse``; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import free_name, steps, texts, through_arrow

ROLES = ("system", "user", "assistant")

#: Names that stand for a role in front of a line.
SPEAKERS = {
    "system": "system", "instruction": "system", "instructions": "system", "context": "system",
    "user": "user", "human": "user", "customer": "user", "question": "user", "q": "user", "prompter": "user", "me": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "agent": "assistant", "answer": "assistant", "a": "assistant", "model": "assistant", "reply": "assistant",
}
_NAME = "(" + "|".join(sorted(SPEAKERS, key=len, reverse=True)) + ")"
MARKER = re.compile(rf"\s*(?:\*\*{_NAME}:?\*\*:?|#+[ \t]*{_NAME}:?[ \t]*$|\[{_NAME}\]:?|<\|?{_NAME}\|?>:?|{_NAME}[ \t]*(?::|>|-(?=\s)))[ \t]*", re.IGNORECASE)

#: Chances of markers and blank lines in lines that begin a turn, or go on.
OWN_MARK, OTHER_MARK, MARK_INSIDE = 0.9, 0.005, 0.01
BLANK_BEFORE_TURN, BLANK_INSIDE = 0.4, 0.08
#: Upper ends of the classes of line length, in characters.
LENGTHS = (20, 60, 120, 240, 480)

TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


@dataclass
class Model:
    """Logarithms: first role, next role, one more line in a turn, and what lines look like."""

    first: list[float]
    following: list[list[float]]
    more: list[tuple[float, float]]
    length: list[list[float]]
    question: list[tuple[float, float]]


def length_class(n: int) -> int:
    return sum(n > limit for limit in LENGTHS)


def fit(turns: DataFrame) -> Model:
    """Counts over all rows of ``conv_id, turn, role, text``; only totals reach the driver."""
    rows = turns.select("conv_id", "turn", "role", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines")).where(F.col("role").isin(*ROLES))
    size = F.char_length("line")
    kind = sum((F.when(size > limit, 1).otherwise(0) for limit in LENGTHS), F.lit(0))
    lines = rows.select("role", F.explode("lines").alias("line")).groupBy(
        "role", kind.alias("kind"), F.col("line").endswith("?").alias("asks")).count().collect()
    sizes = {r.role: (r.turns, r.lines) for r in rows.groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.size("lines")).alias("lines")).collect()}
    # neighbours meet by their number, so no conversation is gathered
    after = rows.select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("t"), F.col("role").alias("next"))
    pairs = rows.join(after, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t"))).groupBy("role", "next").count().collect()
    starts = {r.role: r["count"] for r in rows.where("turn = 0").groupBy("role").count().collect()}
    share = lambda n, total, kinds: math.log((n + 1) / (total + kinds))
    first = [share(starts.get(r, 0), sum(starts.values()), len(ROLES)) for r in ROLES]
    count = {(p.role, p.next): p["count"] for p in pairs}
    following = [[share(count.get((r, s), 0), sum(count.get((r, x), 0) for x in ROLES), len(ROLES)) for s in ROLES] for r in ROLES]
    more, length, question = [], [], []
    for r in ROLES:
        n_turns, n_lines = sizes.get(r, (0, 0))
        more.append((share(n_turns, n_lines, 2), share(n_lines - n_turns, n_lines, 2)))
        by = [sum(x["count"] for x in lines if x.role == r and x.kind == k) for k in range(len(LENGTHS) + 1)]
        length.append([share(n, sum(by), len(by)) for n in by])
        asks = sum(x["count"] for x in lines if x.role == r and x.asks)
        question.append((share(sum(by) - asks, sum(by), 2), share(asks, sum(by), 2)))
    return Model(first, following, more, length, question)


def observed(text: str) -> list[tuple[str, str | None, str, bool]]:
    """Line, role of its marker, rest of the line, and whether a blank line stands before it."""
    out, blank = [], False
    for line in text.split("\n"):
        if not line.strip():
            blank = True
            continue
        hit = MARKER.match(line)
        role = SPEAKERS[next(g for g in hit.groups() if g).lower()] if hit else None
        out.append((line, role, line[hit.end():] if hit else line, blank))
        blank = False
    return out


def emission(model: Model, seen: tuple[str, str | None, str, bool], state: int) -> float:
    """State 2 * role begins a turn of that role, 2 * role + 1 goes on with it."""
    line, mark, rest, blank = seen
    role, inside = divmod(state, 2)
    if inside:
        p = math.log(MARK_INSIDE if mark else 1 - MARK_INSIDE) + math.log(BLANK_INSIDE if blank else 1 - BLANK_INSIDE)
    else:
        p = math.log(OWN_MARK if mark == ROLES[role] else OTHER_MARK if mark else 1 - OWN_MARK - 2 * OTHER_MARK)
        p += math.log(BLANK_BEFORE_TURN if blank else 1 - BLANK_BEFORE_TURN)
    said = line if inside else rest
    return p + model.length[role][length_class(len(said))] + model.question[role][said.rstrip().endswith("?")]


def transition(model: Model, before: int | None, after: int) -> float:
    role, inside = divmod(after, 2)
    if before is None:
        return -math.inf if inside else model.first[role]
    old = before // 2
    if inside:
        return model.more[old][1] if old == role else -math.inf
    return model.more[old][0] + model.following[old][role]


def viterbi(model: Model, lines: list[tuple[str, str | None, str, bool]]) -> list[int]:
    """The most probable states; of equal paths the one with the smaller states."""
    if not lines:
        return []
    n = 2 * len(ROLES)
    step = [[transition(model, i, j) for i in range(n)] for j in range(n)]
    best = [transition(model, None, j) + emission(model, lines[0], j) for j in range(n)]
    back: list[list[int]] = []
    for seen in lines[1:]:
        origin, now = [], []
        for j in range(n):
            score, i = max((best[i] + step[j][i], -i) for i in range(n))
            origin.append(-i)
            now.append(score + emission(model, seen, j))
        back.append(origin)
        best = now
    state = max(range(n), key=lambda j: (best[j], -j))
    path = [state]
    for origin in reversed(back):
        state = origin[state]
        path.append(state)
    return path[::-1]


def turns_of(model: Model, text: str) -> list[dict[str, str]]:
    lines = observed(text)
    out: list[dict[str, str]] = []
    for (line, mark, rest, _), state in zip(lines, viterbi(model, lines)):
        role, inside = divmod(state, 2)
        if inside:
            out[-1]["text"] += "\n" + line
        else:
            out.append({"role": ROLES[role], "text": rest if mark else line})
    for turn in out:  # a marker on a line of its own leaves an empty first line
        turn["text"] = turn["text"].strip("\n")
    return out


def parse(transcripts: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``turns``: ``array<struct<role,text>>`` of each transcript."""
    shared = transcripts.sparkSession.sparkContext.broadcast(model)  # a few dozen numbers
    name = free_name(transcripts, "turns")
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            found = [turns_of(shared.value, t) for t in texts(batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, name])

    return through_arrow(transcripts, run, [T.StructField(name, TURNS)])


def rendered(turns: Column) -> Column:
    """Canonical text: every turn between its role's sign and an end sign."""
    one = lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n<|end|>\n"))
    return F.array_join(F.transform(turns, one), "")


def transcripts(turns: DataFrame) -> DataFrame:
    """``conv_id, text, roles`` of conversations written down as people do.

    The style of markers depends on the conversation; about one turn in ten has
    no marker and only a blank line before it.  A transcript is one cell, so a
    conversation must fit into one.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(5))
    title, lower = F.initcap("role"), F.col("role")
    short = F.when(lower == "user", "Q").when(lower == "assistant", "A").otherwise("Context")
    other = F.when(lower == "user", "Human").when(lower == "assistant", "AI").otherwise("System")
    mark = F.when(style == 0, F.concat(title, F.lit(": "))).when(style == 1, F.concat(F.lit("### "), title, F.lit("\n"))).when(
        style == 2, F.concat(F.lit("["), lower, F.lit("] "))).when(style == 3, F.concat(short, F.lit(": "))).otherwise(F.concat(F.lit("**"), other, F.lit(":** ")))
    bare = (F.pmod(F.xxhash64("conv_id", "turn", F.lit(1)), F.lit(10)) == 0) | lower.isNull()
    block = F.concat(F.when(bare, "\n").otherwise(mark), F.coalesce("text", F.lit("")))
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), block.alias("block"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return rows.select("conv_id", F.array_join(F.transform("all", lambda b: b["block"]), "\n").alias("text"), F.transform("all", lambda b: b["role"]).alias("roles"))
