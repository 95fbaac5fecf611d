"""Quality rules as a ledger of failure bits, in DataFrame functions alone.

Every rule is evaluated once for a text.  The ledger keeps the measurements and
one long with a bit for each rule that failed.  Policies are versioned masks
over those bits, so a policy can change, be compared or be taken apart rule by
rule without reading a text again; counts come from bitwise aggregation.

Everything happens inside a row but for texts with repeated 8-word windows,
whose windows are compared as sorted arrays in the row as well: no shuffle.

Null and empty texts have no words and fail the base rules.  Other columns pass
through, whatever their names; repeated rows get equal rows; an empty table
gives an empty one.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, free_name

#: Words in a window whose repetition within a text counts.
WINDOW = 8

#: Rules in the order of their bits: name, and what fails, in terms of the measurements.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 20"),
    ("repeats_itself", "100 * n_repeat_words > 30 * n_words"),
    ("too_many_symbols", "5 * n_symbols > n_words"),
    ("repeats_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("words_too_long", "word_chars > 40 * n_words"),
    ("words_too_short", "word_chars < 2 * n_words"),
    ("no_letters", "10 * n_letters < 3 * word_chars"),
    ("shouts", "n_letters >= 40 and 10 * n_capitals > 8 * n_letters"),
    ("too_many_marks", "10 * n_marks > 5 * n_words and n_marks >= 10"),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules that each of them applies.
POLICIES: dict[str, list[str]] = {
    "base": ["too_few_words", "repeats_itself"],
    "v1": ["too_few_words", "repeats_itself", "too_many_symbols", "repeats_lines", "words_too_long", "words_too_short", "no_letters"],
    "v2": [name for name, _ in RULES],
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_marks"]


def mask(policy: str) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words inside windows found twice or more in the list *words*.

    Windows are compared by a 64-bit hash, sorted with their places inside the
    row; the words covered follow from the distances of marked places.
    """
    windows, pairs, marked = (free_name(df, x) for x in ("_windows", "_pairs", "_marked"))
    n = F.size(words)
    made = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    df = df.withColumn(windows, F.when(n > WINDOW, made))
    unlike = F.size(F.array_distinct(F.col(windows))) == F.size(windows)
    # most texts repeat no window and need no sorting
    df = df.withColumn(pairs, F.when(~unlike, F.sort_array(F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.get(F.col(pairs), j)["h"] == x["h"]
    twice = F.filter(F.col(pairs), lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
    df = df.withColumn(marked, F.when(F.col(pairs).isNotNull(), F.array_sort(F.transform(twice, lambda x: x["i"]))))
    covered = F.aggregate(
        F.col(marked), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), p + WINDOW - a["upto"])).cast("long").alias("n"), (p + WINDOW).cast("long").alias("upto")),
        lambda a: a["n"])
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop(windows, pairs, marked)


def measured(docs: DataFrame, text: str = "text", names: dict[str, str] | None = None) -> DataFrame:
    """Adds all measurements; *names* gives other column names for them."""
    names = names or {m: free_name(docs, m) for m in MEASURES}
    words, lines, source = free_name(docs, "_words"), free_name(docs, "_lines"), F.coalesce(F.col(text), F.lit(""))
    length = lambda s: F.char_length(s).cast("long")
    df = docs.withColumn(words, F.regexp_extract_all(source, F.lit(WORD), F.lit(0)))
    df = df.withColumn(lines, F.filter(F.split(source, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = repeated_words(df, words, names["n_repeat_words"])
    space = length(F.regexp_replace(source, WORD, ""))
    removed = lambda pattern: length(source) - length(F.regexp_replace(source, pattern, ""))
    df = df.withColumns({
        names["n_words"]: F.size(words).cast("long"), names["word_chars"]: length(source) - space,
        names["n_symbols"]: length(source) - length(F.translate(source, "#*$%&|<>", "")),
        names["n_lines"]: F.size(lines).cast("long"), names["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        names["n_letters"]: removed(r"\p{L}+"), names["n_capitals"]: removed(r"\p{Lu}+"),
        names["n_marks"]: length(source) - length(F.translate(source, "!?", "")),
    })
    return df.drop(words, lines)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds every measurement and ``failures``, one bit for each failed rule.

    A name that the table already has gets underscores.
    """
    names = {m: free_name(docs, m) for m in MEASURES}
    df = measured(docs, text, names)

    def failed(rule: str) -> Column:
        return F.expr(re.sub(r"\b[a-z_]+\b", lambda m: f"`{names[m[0]]}`" if m[0] in names else m[0], rule))

    bits = [F.when(failed(rule), F.lit(BITS[name]).cast("long")).otherwise(F.lit(0).cast("long")) for name, rule in RULES]
    return df.withColumn(free_name(docs, "failures"), reduce(lambda a, b: a.bitwiseOR(b), bits))


def passes(failures: Column, policy: str = "v1") -> Column:
    """Whether a text stays under a policy."""
    return failures.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(rows: DataFrame, policy: str = "v1", failures: str = "failures") -> DataFrame:
    """``rule, failed, only`` for each rule of a policy, by aggregation over the bits.

    ``only`` counts the texts that the policy would keep without that rule.
    """
    whole = mask(policy)
    bits = F.col(failures).bitwiseAND(F.lit(whole).cast("long"))
    counts = rows.agg(*[F.count_if(bits.bitwiseAND(F.lit(BITS[r]).cast("long")) != 0).alias(f"f_{r}") for r in POLICIES[policy]],
                      *[F.count_if(bits == BITS[r]).alias(f"o_{r}") for r in POLICIES[policy]])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("failed"), F.col(f"o_{r}").alias("only")) for r in POLICIES[policy]])).alias("x")).select("x.*")


def summary(rows: DataFrame, by: list[str], failures: str = "failures") -> DataFrame:
    """For each group: rows, the bits that any row failed, and those that all failed."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.bit_or(failures).alias("any_failed"), F.bit_and(failures).alias("all_failed"))
