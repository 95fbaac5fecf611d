"""Personal data in texts: strict patterns, and boosted trees over loose candidates.

Everything runs inside DataFrame functions, row by row, without a shuffle.

* Base spans come from strict patterns with their checks (address parts, Luhn,
  number of digits).  They are always kept.
* High-recall generators propose more, partly overlapping, spans: from every
  digit group on, the runs of one to five neighbouring groups and the longest
  run of 41 signs at most; values after ``=`` or ``:``; and mail addresses
  written out.  Boosted trees look at format, at the words before a span and at
  the numbers beside it; a threshold for each kind, calibrated on candidates
  that did not train the trees, selects what is added.  Candidates that
  themselves touch a base span add nothing and are left out.

The trees are fitted anew in every session from a fixed list of made-up example
lines (``examples``), whose features are computed by the same expressions.

Offsets are code points, ends exclusive.  Null and empty texts have no spans.
Other columns pass through, whatever their names; repeated rows give repeated
results; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import boosting
from .common import col, free_name

#: Order of kinds in results: base kinds first, then what the trees add.
KINDS = ("email", "ip", "card", "phone", "secret", "number", "contact")
BASE = KINDS[:4]

# Each pattern matches what its plain form in the contract does; possessive
# parts and the looks behind only keep long runs from being tried again and again.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"[=:][\x20]{0,3}[\"']?[A-Za-z0-9+/_-]{8,}+",
    "contact": r"[A-Za-z0-9._%+-]{1,64}\x20?[(\[]\x20?(?:at|AT)\x20?[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[(\[]\x20?(?:dot|DOT)\x20?[)\]]\x20?[A-Za-z0-9-]{2,63}|\.[A-Za-z]{2,24})++",
}
#: A digit group that begins a number, and the same with what follows it captured: enough for the longest run and the signs after it.
GROUP = r"(?<![A-Za-z0-9])[0-9]++"
WINDOW = r"(?<![A-Za-z0-9])(?=([0-9().\x20/-]{1,41}+[\x00-\x{10FFFF}]{0,4}))[0-9]++"
#: Runs of one to five neighbouring groups, and the longest run, at the beginning of a window.
RUNS = (*(rf"^[0-9]++(?:[().\x20/-]++[0-9]++){{{n}}}(?![A-Za-z0-9])" for n in range(5)), r"^[0-9][0-9().\x20/-]{5,40}(?<=[0-9])(?![A-Za-z0-9])")
RUN_SIGNS = (6, 41)
#: Numbers beside a candidate: written as one with it, or only near.
TIED = r"(?:[-.]|\)[\x20-]?)"
NEAR = r"[().\x20/-]+"
BESIDE = ("tied_before", "near_before", "tied_after", "near_after")
#: Characters before a candidate that the trees may look at.
CONTEXT = 28
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
WORDS_BEFORE = {
    "secret_word": r"(?i)(?:token|secret|passw|passphrase|pwd|key|auth|credential|bearer)[\"'\x20_a-z]{0,8}$",
    "call_word": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|whatsapp|dial)\b",
    "id_word": r"(?i)\b(?:ssn|social|passport|iban|account|acct|card|driver|tax|licen[cs]e)\b",
    "other_word": r"(?i)\b(?:version|order|page|pages|chapter|isbn|total|price|from|between|year|date|on|section|ratio|score)\b",
}
SPAN = "struct<start:bigint,stop:bigint,found:string,close:string>"
#: Items of an array that grow together, and signs of a text that are cut out together.
CHUNK, BLOCK = 128, 4096
PRECISION = 0.98


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(found: Column) -> Column:
    """Whether the check digit is right: every second digit from the right counts double."""
    back = F.reverse(_digits(found))
    doubled = F.translate(F.regexp_replace(back, "[0-9]([0-9]?)", "$1"), "0123456789", "0246813579")
    plain = F.regexp_replace(back, "([0-9])[0-9]?", "$1")
    add = lambda s: F.aggregate(F.split(s, ""), F.lit(0), lambda a, d: a + F.coalesce(d.try_cast("int"), F.lit(0)))
    return (add(doubled) + add(plain)) % 10 == 0


CHECKS = {
    "email": lambda found: F.lit(True),
    "ip": lambda found: found.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
    "card": lambda found: F.when(F.length(_digits(found)).between(14, 19), _luhn(found)).otherwise(False),
    "phone": lambda found: F.length(_digits(found)).between(10, 15),
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(items: Column, kind: str, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column]) -> Column:
    """``emit(state before, item)`` of every item of an array (as ``array<kind>``), where ``step(state, item)`` carries the state on.

    Growing one array copies it for every item, so chunks of bounded size grow
    on their own: a first walk finds the state at the head of each chunk.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")

    def head(state: Column, chunk: Column) -> Column:
        now = F.aggregate(chunk, F.element_at(state, -1), step)
        return F.concat(state, F.array(now))

    def grown(chunk: Column, start: Column) -> Column:
        begin = F.struct(start.alias("now"), none.alias("out"))
        add = lambda a, x: F.struct(step(a["now"], x).alias("now"), F.concat(a["out"], F.array(emit(a["now"], x))).alias("out"))
        return F.aggregate(chunk, begin, add, lambda a: a["out"])

    def cut(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda i: F.slice(all_, i * CHUNK + 1, F.lit(CHUNK)))

    def walked(chunks: Column) -> Column:
        # the last chunk has no follower
        starts = F.aggregate(F.slice(chunks, F.lit(1), F.size(chunks) - 1), F.array(zero), head)
        return F.flatten(F.zip_with(chunks, starts, grown))

    return let(items, lambda all_: F.when(F.size(all_) > 0, let(cut(all_), walked)).otherwise(none))


def _with_spans(df: DataFrame, text: str, kind: str, possible: Column) -> tuple[DataFrame, str]:
    """Adds all matches of a kind with their places and the signs before; an empty list where *possible* is false."""
    pairs, spans = (free_name(df, f"_{kind}_{x}") for x in ("pairs", "spans"))
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    met = F.zip_with(found, F.split(F.col(text), pattern, -1), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    df = df.withColumn(pairs, F.when(possible, F.filter(met, lambda x: x["hit"].isNotNull())))  # the last gap has no match
    base = kind in BASE

    def after(state: Column, x: Column) -> Column:
        at = state["at"] + F.char_length(x["gap"]) + F.char_length(x["hit"])
        return F.struct(at.alias("at"), (F.lit("") if base else F.right(F.concat(state["tail"], x["gap"], x["hit"]), F.lit(CONTEXT))).alias("tail"))

    def span(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["gap"])
        close = F.lit("") if base else F.right(F.concat(state["tail"], x["gap"]), F.lit(CONTEXT))
        return F.struct(start.alias("start"), (start + F.char_length(x["hit"])).alias("stop"), x["hit"].alias("found"), close.alias("close"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("tail"))
    placed = scan(F.coalesce(pairs, F.expr("cast(array() as array<struct<hit:string,gap:string>>)")), SPAN, zero, after, span)
    return df.withColumn(spans, placed).drop(pairs), spans


def _with_numbers(df: DataFrame, text: str, possible: Column) -> tuple[DataFrame, str]:
    """Adds all runs of digit groups, overlapping ones too, each with the signs before and after it."""
    items, spans = (free_name(df, f"_number_{x}") for x in ("items", "spans"))
    every = lambda pattern, group: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))
    met = F.zip_with(every(GROUP, 0), every(WINDOW, 1), lambda g, w: F.struct(g.alias("group"), w.alias("window")))
    met = F.zip_with(met, F.split(F.col(text), GROUP, -1), lambda x, g: F.struct(x["group"].alias("group"), x["window"].alias("window"), g.alias("gap")))
    df = df.withColumn(items, F.when(possible, F.filter(met, lambda x: x["group"].isNotNull())))
    close = lambda state, x: F.right(F.concat(state["tail"], x["gap"]), F.lit(CONTEXT))

    def before(state: Column, x: Column) -> Column:
        # the words before the first number of a list are those of its other numbers too
        return F.when((state["at"] > 0) & x["gap"].rlike(f"^{NEAR}$"), state["before"]).otherwise(close(state, x))

    def after(state: Column, x: Column) -> Column:
        return F.struct(
            (state["at"] + F.char_length(x["gap"]) + F.char_length(x["group"])).alias("at"),
            F.right(F.concat(close(state, x), x["group"]), F.lit(CONTEXT)).alias("tail"), before(state, x).alias("before"))

    def head(state: Column, x: Column) -> Column:
        return F.struct(
            (state["at"] + F.char_length(x["gap"])).alias("start"), before(state, x).alias("before"), close(state, x).alias("close"), x["window"].alias("window"))

    def runs(x: Column) -> Column:
        hits = F.array_distinct(F.array(*(F.regexp_extract(x["window"], pattern, 0) for pattern in RUNS)))
        return F.transform(F.filter(hits, lambda h: F.char_length(h).between(*RUN_SIGNS)), lambda h: F.struct(
            x["start"].alias("start"), (x["start"] + F.char_length(h)).alias("stop"), h.alias("found"), x["before"].alias("before"), x["close"].alias("close"),
            F.substr(x["window"], F.char_length(h) + 1, F.lit(4)).alias("after")))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("tail"), F.lit("").alias("before"))
    kind = "struct<start:bigint,before:string,close:string,window:string>"
    placed = scan(F.coalesce(items, F.expr("cast(array() as array<struct<group:string,window:string,gap:string>>)")), kind, zero, after, head)
    return df.withColumn(spans, F.flatten(F.transform(placed, runs))).drop(items), spans


def _free(spans: Column, base: Column) -> Column:
    """Those *spans* that touch none of *base*, in one walk over the sorted ends of both.

    A base span lies over a span if it begins before the span's end and does not
    end by its start; so the base starts before the one, less the base stops by
    the other, are the base spans over it.
    """
    mark = lambda at, turn, place: F.struct(at.cast("long").alias("at"), F.lit(turn).alias("turn"), place.cast("int").alias("place"))
    nowhere = F.lit(-1)
    ends = F.concat(
        # of marks at one place: stops, questions by start, questions by stop, starts
        F.transform(base, lambda b: mark(b["stop"], 0, nowhere)), F.transform(spans, lambda s, i: mark(s["start"], 1, i)),
        F.transform(spans, lambda s, i: mark(s["stop"], 2, i)), F.transform(base, lambda b: mark(b["start"], 3, nowhere)))
    step = lambda n, x: F.struct((n["ended"] + (x["turn"] == 0).cast("long")).alias("ended"), (n["begun"] + (x["turn"] == 3).cast("long")).alias("begun"))
    told = lambda n, x: F.struct(x["place"].alias("place"), x["turn"].alias("turn"), F.when(x["turn"] == 1, n["ended"]).otherwise(n["begun"]).alias("n"))
    zero = F.struct(F.lit(0).cast("long").alias("ended"), F.lit(0).cast("long").alias("begun"))
    counts = scan(F.sort_array(ends), "struct<place:int,turn:int,n:bigint>", zero, step, told)
    # by place: what has ended by the start, then what has begun before the stop
    def untouched(answers: Column) -> Column:
        ended, begun = (F.filter(answers, lambda c: c["turn"] == turn) for turn in (1, 2))  # noqa: B023 - applied at once
        touched = F.zip_with(ended, begun, lambda e, b: b["n"] > e["n"])
        kept = F.filter(F.zip_with(spans, touched, lambda s, t: F.struct(s.alias("span"), t.alias("touched"))), lambda x: ~x["touched"])
        return F.transform(kept, lambda x: x["span"])

    answers = F.sort_array(F.filter(counts, lambda c: c["place"] >= 0))
    return F.when((F.size(base) == 0) | (F.size(spans) == 0), spans).otherwise(let(answers, untouched))


def _features(kind: str, span: Column) -> Column:
    """Format and context of a candidate."""
    hit = span["found"]
    if kind == "number":
        before = span["before"]
        beside = [span["close"].rlike(f"[0-9]{TIED}$"), span["close"].rlike(f"[0-9]{NEAR}$"), span["after"].rlike(f"^{TIED}[0-9]"), span["after"].rlike(f"^{NEAR}[0-9]")]
    else:
        before = span["close"]
        beside = [F.lit(False)] * len(BESIDE)
    n = F.char_length(hit)
    n_digits, n_letters = F.length(_digits(hit)), F.length(F.regexp_replace(hit, "[^A-Za-z]", ""))
    made = {
        "kind": F.lit(KINDS.index(kind)), "length": n, "digits": n_digits, "letters": n_letters, "signs": n - n_digits - n_letters,
        "groups": F.size(F.split(hit, "[^A-Za-z0-9]+")), "upper": F.length(F.regexp_replace(hit, "[^A-Z]", "")),
        "hex": hit.rlike("^[0-9a-fA-F]+$").cast("int"), "turns": F.size(F.regexp_extract_all(hit, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]"), F.lit(0))),
        "dotted": F.instr(hit, "."), "slashed": F.instr(hit, "/"), "bracket": F.instr(hit, "("),
        **{name: before.rlike(pattern).cast("int") for name, pattern in WORDS_BEFORE.items()},
        **{name: there.cast("int") for name, there in zip(BESIDE, beside)},
    }
    return F.struct(span["start"].alias("start"), span["stop"].alias("stop"), *(F.coalesce(v, F.lit(0)).cast("double").alias(k) for k, v in made.items()))


FEATURES = ["kind", "length", "digits", "letters", "signs", "groups", "upper", "hex", "turns", "dotted", "slashed", "bracket", *WORDS_BEFORE, *BESIDE]


def with_candidates(df: DataFrame, text: str) -> tuple[DataFrame, dict[str, str], str]:
    """Adds checked base spans by kind, and the features of all other candidates."""
    source = F.col(text)
    digit, at, plus = source.rlike("[0-9]"), F.instr(source, "@") > 0, F.instr(source, "+") > 0
    possible = {
        "email": at, "ip": digit, "card": digit, "phone": plus,
        "secret": (F.instr(source, "=") > 0) | (F.instr(source, ":") > 0), "contact": source.rlike(r"(?i)[(\[] ?at ?[)\]]"),
    }
    names = {}
    for kind in KINDS:
        df, names[kind] = _with_numbers(df, text, digit) if kind == "number" else _with_spans(df, text, kind, possible[kind])
    for kind in BASE:
        check = CHECKS[kind]
        df = df.withColumn(names[kind], F.filter(names[kind], lambda s: check(s["found"])))  # noqa: B023 - applied at once
    base, more = free_name(df, "_base"), free_name(df, "_more")
    df = df.withColumn(base, F.concat(*(F.col(names[k]) for k in BASE)))
    # the value alone, without the sign before it
    value = lambda s: F.regexp_extract(s["found"], "[A-Za-z0-9+/_-]+$", 0)
    signs = lambda s: F.left(s["found"], F.char_length(s["found"]) - F.char_length(value(s)))
    bare = lambda s: F.struct(
        (s["stop"] - F.char_length(value(s))).alias("start"), s["stop"].alias("stop"), value(s).alias("found"),
        F.right(F.concat(s["close"], signs(s)), F.lit(CONTEXT)).alias("close"))
    lists = []
    for kind in KINDS[4:]:
        if kind == "secret":
            df = df.withColumn(names[kind], F.transform(names[kind], bare))
        df = df.withColumn(names[kind], _free(F.col(names[kind]), F.col(base)))
        lists.append(F.transform(names[kind], lambda s: _features(kind, s)))  # noqa: B023 - applied at once
    df = df.withColumn(more, F.concat(*lists)).drop(base, *(names[k] for k in KINDS[4:]))
    return df, {k: names[k] for k in BASE}, more


def examples(seed: int = 5, each: int = 120) -> list[tuple[int, str]]:
    """Made-up lines: 1 where they hold something personal or secret, 0 where not.

    Numbers that are personal as a whole stand between ``<`` and ``>``; other
    runs of groups in such a line are parts of them, or more than them.
    """
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(r.choice("abcdefghkmnpqrstuvwxyzABCDEFGHKMNPQRSTUVWXYZ0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(("an", "er", "the", "on", "ti", "re", "st", "ou", "is", "le")) for _ in range(r.randint(2, 4)))
    some = lambda: " ".join(word() for _ in range(r.randint(2, 5)))
    phone, social = lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"
    day, address = lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))
    call, id_ = lambda: r.choice(("call", "tel", "phone", "fax", "mobile", "cell")), lambda: r.choice(("ssn", "social security number"))
    many = lambda one: r.choice((" / ", " ", "/", " - ")).join(f"<{one()}>" for _ in range(r.randint(2, 5)))
    yes = [
        lambda: f"{some()} {r.choice(['token', 'api_key', 'secret', 'auth token', 'access_key'])} = \"{hexes(r.randint(16, 40))}\"",
        lambda: f"{some()} {r.choice(['password', 'passwd', 'pwd', 'secret'])}={r.choice([hexes, mixed])(r.randint(10, 32))}",
        lambda: f"{some()} {r.choice(['key', 'token', 'bearer'])}: {mixed(r.randint(16, 40))}",
        lambda: f"{some()} {r.choice(['call', 'tel', 'phone', 'fax', 'mobile'])} {r.choice(['', 'me on ', 'at '])}(<{digits(3)}) {digits(3)}-{digits(4)}>",
        lambda: f"{some()} {r.choice(['phone', 'tel', 'cell'])}: <{digits(3)}-{digits(3)}-{digits(4)}> {some()}",
        lambda: f"{some()} {r.choice(['ssn', 'social security number'])} <{digits(3)}-{digits(2)}-{digits(4)}> {some()}",
        lambda: f"{some()} {r.choice(['passport', 'account', 'iban', 'tax id'])} <{digits(r.randint(8, 12))}> {some()}",
        lambda: f"{some()} {word()}{digits(2)} (at) {word()} (dot) {r.choice(['com', 'org', 'net'])} {some()}",
        lambda: f"{some()} {word()}.{word()} [at] {word()}.{r.choice(['com', 'org', 'net'])} {some()}",
        lambda: f"{some()} {call()} {r.choice([day, address])()} (<{digits(3)}) {digits(3)}-{digits(4)}>",
        lambda: f"{some()} {call()} {r.choice([day, address])()} <{phone()}> {some()}",
        lambda: f"{some()} {id_()} {r.choice([day, address])()} <{social()}> {some()}",
        lambda: f"{some()} {call()}: {many(phone)} {some()}",
        lambda: f"{some()} {id_()} {many(social)} {some()}",
    ]
    no = [
        lambda: f"{some()} on {r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)} {some()}",
        lambda: f"{some()} version {r.randint(1, 20)}.{r.randint(10, 99)}.{r.randint(100, 999)} {some()}",
        lambda: f"{some()} between {r.randint(1000, 2030)} - {r.randint(1000, 2030)} {some()}",
        lambda: f"{some()} total {digits(r.randint(4, 7))}.{digits(2)} {some()}",
        lambda: f"{some()} {digits(r.randint(7, 18))} {some()}",
        lambda: f"{some()} {digits(4)} {digits(4)} {digits(r.randint(2, 4))} {some()}",
        lambda: f"{some()} order {digits(r.randint(7, 12))}-{digits(2)} {some()}",
        lambda: f"{some()} {digits(r.randint(2, 5))}{r.choice([' ', '.', ' .', '. ', '(', ')', '/'])}{digits(r.randint(2, 5))} {some()}",
        lambda: f"{some()} {digits(r.randint(1, 3))}{r.choice([' ', '-'])}{digits(r.randint(4, 8))}{r.choice(['', ' ', '-'])}{digits(r.randint(1, 4))} {some()}",
        lambda: f"{some()} {digits(3)}-{digits(3)}-{digits(4)} {some()}",
        lambda: f"{some()} {day()} {r.choice([day, address, phone])()} {some()}",
        lambda: f"{some()} {call()} {r.choice([day, address])()} {day()} {some()}",
        lambda: f"{some()} " + " ".join(digits(r.randint(1, 6)) for _ in range(r.randint(3, 9))) + f" {some()}",
        lambda: f"{some()} {word()}: {word()}{word()}{word()}",
        lambda: f"{some()} {word()}={word()}{word()}{word()} {some()}",
        lambda: f"{some()} key: {word()}{word()}{word()} {some()}",
        lambda: f"{some()} page {digits(3)}/{digits(3)}/{digits(2)}",
        lambda: f"http://{word()}{word()}/{word()}-{word()} {some()}",
        lambda: f"{some()} {word()} ({word()}) at {word()} [at] home",
    ]
    return [(label, make()) for label, makers in ((1, yes), (0, no)) for make in makers for _ in range(each)]


def train(spark: SparkSession) -> tuple[list[boosting.Tree], dict[str, float]]:
    """Trees and the threshold of each added kind."""
    lines = "\n".join(f"{label}\t{line}" for label, line in examples())
    made = spark.range(1).select(F.explode(F.split(F.lit(lines), "\n")).alias("line"))
    marked = F.substring_index("line", "\t", -1)
    whole = F.regexp_extract_all(marked, F.lit("<([^>]*)>"), F.lit(1))
    made = made.select(F.substring_index("line", "\t", 1).cast("int").alias("label"), F.translate(marked, "<>", "").alias("text"), whole.alias("whole"))
    made, _, more = with_candidates(made, "text")
    rows = made.select("label", "text", "whole", F.explode(more).alias("c")).select("label", "text", "whole", "c.*").collect()  # a few thousand
    rows.sort(key=lambda r: (r.text, r.kind, r.start, r.stop))
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    number = KINDS.index("number")
    y = np.array([int(r.text[r.start:r.stop] in r.whole) if r.whole and r.kind == number else r.label for r in rows])
    aside = np.arange(len(rows)) % 4 == 0
    trees = boosting.fit(x[~aside], y[~aside], FEATURES)
    p, truth, kind = boosting.predict(trees, x[aside], FEATURES), y[aside], x[aside, 0]
    limits = {}
    for k in KINDS[4:]:
        own = kind == KINDS.index(k)
        good = [t for t in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95) if (chosen := own & (p >= t)).any() and truth[chosen].mean() >= PRECISION]
        limits[k] = good[0] if good else 2.0
    return trees, limits


_MODELS: dict[str, tuple[list[boosting.Tree], dict[str, float]]] = {}


def model(spark: SparkSession) -> tuple[list[boosting.Tree], dict[str, float]]:
    """The trees and thresholds, fitted once in an application."""
    app = spark.sparkContext.applicationId
    if app not in _MODELS:
        _MODELS[app] = train(spark)
    return _MODELS[app]


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``spans``: ``array<struct<start,rank,stop,kind,base>>`` by start, then kind."""
    trees, limits = model(docs.sparkSession)
    name = free_name(docs, "spans")
    df, base, more = with_candidates(docs, text)
    span = lambda s, kind, is_base: F.struct(
        s["start"].alias("start"), kind.cast("int").alias("rank"), s["stop"].alias("stop"),
        F.element_at(F.array(*map(F.lit, KINDS)), kind.cast("int") + 1).alias("kind"), F.lit(is_base).alias("base"))
    limit = lambda c: reduce(lambda a, k: a.when(c["kind"] == KINDS.index(k), limits[k]), KINDS[5:], F.when(c["kind"] == 4, limits["secret"]))
    chosen = F.filter(more, lambda c: boosting.expression(trees, lambda f: c[f]) >= limit(c))
    # of overlapping additions of one kind none is dropped: redaction joins them
    lists = [F.transform(base[k], lambda s: span(s, F.lit(KINDS.index(k)), True)) for k in BASE]  # noqa: B023 - applied at once
    df = df.withColumn(name, F.sort_array(F.concat(*lists, F.transform(chosen, lambda c: span(c, c["kind"], False)))))
    return df.select(*map(col, docs.columns), name)


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by its first kind."""
    # cutting out of a long text walks it from its beginning, so pieces are cut out of blocks
    last = F.floor(F.greatest(F.char_length(text) - 1, F.lit(0)) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * BLOCK + 1, F.lit(BLOCK)))

    def piece(all_: Column, start: Column, stop: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        some = F.slice(all_, first + 1, F.greatest(F.floor((stop - 1) / BLOCK).cast("int") - first + 1, F.lit(0)))
        return F.when(stop > start, F.substr(F.array_join(some, ""), (start - first * BLOCK + 1).cast("int"), (stop - start).cast("int"))).otherwise("")

    def whole(all_: Column) -> Column:
        mark = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        emit = lambda at, s: F.when(s["start"] >= at, F.concat(piece(all_, at, s["start"]), mark(s))).otherwise("")
        pieces = scan(spans, "string", F.lit(0).cast("long"), lambda at, s: F.greatest(at, s["stop"]), emit)
        return F.concat(F.array_join(pieces, ""), piece(all_, F.array_max(F.transform(spans, lambda s: s["stop"])), F.char_length(text).cast("long")))

    return F.when(F.size(spans) > 0, let(blocks, whole)).otherwise(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with personal data replaced in *text*; ``n_chars`` follows."""
    found = find(docs, text)
    spans = [c for c in found.columns if c not in docs.columns][0]
    out = found.withColumn(text, redacted(F.col(text), F.col(spans)))
    if "n_chars" in docs.columns and text != "n_chars":
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*map(col, docs.columns))
