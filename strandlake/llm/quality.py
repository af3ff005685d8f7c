"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows on which costs and selectivities are estimated, and runs of partitions that they are taken from, from the front of
#: each; they set the order of the rules only, never a verdict.
SAMPLE_ROWS = 2000
SAMPLE_SHARE = 0.05
SAMPLE_TASKS = 4
#: Runs of each rule on the sample; the least time counts, less that of counting its rows.
RUNS = 2
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: White space between words, and the symbols that are counted.
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"
SYMBOL_CLASS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A document is rejected where `rejects` is true; `needs` names the measures that it reads."""

    name: str
    rejects: str
    needs: tuple[str, ...]


#: All ratios are compared in whole numbers. Each rule rejects junk only: plain prose of any language passes.
RULES = (
    Rule("symbols", "n_symbols * 10 > n_words", ("n_symbols", "n_words")),
    Rule("repeated_lines", "n_dup_lines * 2 > n_lines", ("n_dup_lines", "n_lines")),
    Rule("repeated_words", "n_repeat_words * 5 > n_words * 2", ("n_repeat_words", "n_words")),
    Rule("word_length", "word_chars < n_words * 2 or word_chars > n_words * 20", ("word_chars", "n_words")),
    Rule("digits", "n_digits * 10 > word_chars * 3", ("n_digits", "word_chars")),
    Rule("shouting", "n_marks * 2 > n_words", ("n_marks", "n_words")),
)

_STEPS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    # name, SQL over earlier names, names it needs
    ("words", f"filter(split(body, '{SPACE_CLASS}'), w -> w != '')".replace("\\", "\\\\"), ()),
    ("lines", "filter(split(body, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')", ()),
    ("hashes", "transform(words, w -> xxhash64(w))", ("words",)),
    ("windows", "case when size(hashes) >= 3 then transform(sequence(0, size(hashes) - 3), i -> xxhash64(get(hashes, i), get(hashes, i + 1), get(hashes, i + 2))) else cast(array() as array<bigint>) end", ("hashes",)),
    ("repeats", "size(array_distinct(windows)) < size(windows)", ("windows",)),
    # The low bits of each hash give way to its place, so that an array of longs is sorted: equal hashes become neighbours.
    ("low", "shiftleft(1L, cast(length(bin(size(windows))) as int)) - 1", ("windows",)),
    ("placed", "case when repeats then sort_array(transform(windows, (h, i) -> (h & ~low) | i)) end", ("repeats", "low", "windows")),
    ("twice", "filter(placed, (x, j) -> (j > 0 and ((x ^ get(placed, j - 1)) & ~low) = 0) or (j < size(placed) - 1 and ((x ^ get(placed, j + 1)) & ~low) = 0))", ("placed", "low")),
    # Neighbours with unlike full hashes: the shortened hashes fell together, so compare the full ones.
    ("clash", "exists(transform(placed, (x, j) -> j > 0 and ((x ^ get(placed, j - 1)) & ~low) = 0 and get(windows, cast(x & low as int)) != get(windows, cast(get(placed, j - 1) & low as int))), y -> y)", ("placed", "low", "windows")),
    ("places", "case when clash then filter(transform(windows, (h, i) -> case when size(filter(windows, y -> y = h)) > 1 then cast(i as bigint) end), p -> p is not null) else sort_array(transform(twice, x -> x & low)) end", ("twice", "clash", "windows", "low")),
    ("n_words", "cast(size(words) as bigint)", ("words",)),
    ("word_chars", "cast(length(array_join(words, '')) as bigint)", ("words",)),
    ("n_symbols", f"cast(length(body) - length(regexp_replace(body, '{SYMBOL_CLASS}', '')) as bigint)", ()),
    ("n_digits", "cast(length(body) - length(regexp_replace(body, '[0-9]', '')) as bigint)", ()),
    ("n_marks", "cast(length(body) - length(regexp_replace(body, '[!?]', '')) as bigint)", ()),
    ("n_lines", "cast(size(lines) as bigint)", ("lines",)),
    ("n_dup_lines", "cast(size(lines) - size(array_distinct(lines)) as bigint)", ("lines",)),
    ("n_repeat_words", "cast(coalesce(aggregate(transform(places, (p, j) -> least(3L, coalesce(get(places, j + 1) - p, 3L))), 0L, (a, b) -> a + b), 0L) as bigint)", ("places",)),
)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: What base_failed stands for, as rules of the cascade where the base measures themselves aren't asked for.
BASE_RULES = (
    Rule("few_words", f"n_words < {MIN_WORDS}", ("n_words",)),
    Rule("mostly_repeated", f"n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT}", ("n_repeat_words", "n_words")),
)


def _closure(names: Sequence[str], given: Sequence[str] = ()) -> list[tuple[str, str]]:
    """The steps that lead to the names, in order, without those given and what only these need."""
    needed = set(names) - set(given)
    for name, _, needs in reversed(_STEPS):
        if name in needed:
            needed |= set(needs) - set(given)
    return [(name, sql) for name, sql, _ in _STEPS if name in needed]


def measured(docs: DataFrame, text: str, names: Sequence[str]) -> DataFrame:
    """`row` (all columns of docs), `body`, and the named measures.

    Words are runs of [^\\x20\\x09-\\x0D]; a null text has none. n_repeat_words counts words covered by 3-word windows that
    occur twice or more in the text; windows are compared by a 64-bit hash of three 64-bit word hashes.
    """
    out = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    for name, sql in _closure(names):
        out = out.withColumn(name, F.expr(sql))
    return out.select("row", "body", *names)


def lazy(rule: Rule, given: Sequence[str]) -> Column:
    """Whether the rule rejects, over `body` and the given columns: an expression that computes what else it needs where it stands.

    Each step is bound to its name by a function over an array of one, so it is computed once, and only if a CASE gets there.
    """
    out = rule.rejects
    for name, sql in reversed(_closure(rule.needs, given)):
        out = f"element_at(transform(array({sql}), {name} -> {out}), 1)"
    return F.expr(out)


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT}")


def sampled(docs: DataFrame, text: str) -> DataFrame:
    """At most SAMPLE_ROWS rows of a few partitions: no task reads or gets more than a bounded number, however large docs is."""
    return docs.select(F.col(f"`{text}`").alias("text")).sample(SAMPLE_SHARE, 7).coalesce(SAMPLE_TASKS).limit(SAMPLE_ROWS)


def estimates(docs: DataFrame, text: str, rules: Sequence[Rule] = RULES, given: Sequence[str] = BASE) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) of each rule on a sample whose given measures are there already."""
    sample = measured(sampled(docs, text), "text", given).drop("row").persist()
    try:
        rows = sample.count()

        def seconds(column: Column) -> tuple[float, int]:
            times = []
            for _ in range(RUNS):
                began = time.perf_counter()
                hit = sample.agg(F.count_if(column)).first()[0]
                times.append(time.perf_counter() - began)
            return min(times), hit

        least, _ = seconds(F.expr("body is null"))
        out = []
        for rule in rules:
            took, hit = seconds(lazy(rule, given)) if rows else (least, 0)
            out.append((rule, max(took - least, 1e-4), hit / max(rows, 1)))
        return out
    finally:
        sample.unpersist()


def cascade(docs: DataFrame, text: str, rules: Sequence[Rule] = RULES, given: Sequence[str] = BASE) -> list[Rule]:
    """The rules by falling rejection per cost; the given order breaks ties."""
    return [r for r, _, _ in sorted(estimates(docs, text, rules, given), key=lambda x: -(x[2] / x[1]))]


def merged(rules: Sequence[Rule]) -> list[Rule]:
    """Rules that need the same measures as one, so that these are computed once."""
    by: dict[frozenset[str], list[Rule]] = {}
    for rule in rules:
        by.setdefault(frozenset(rule.needs), []).append(rule)
    return [same[0] if len(same) == 1 else Rule("+".join(r.name for r in same), " or ".join(f"({r.rejects})" for r in same), same[0].needs) for same in by.values()]


def verdict(rules: Sequence[Rule], given: Sequence[str]) -> Column:
    """False from the first rule that rejects on; what later rules need is not computed then."""
    out = F.when(F.lit(False), False)
    for rule in rules:
        out = out.when(lazy(rule, given), False)
    return out.otherwise(True)


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, ordered: bool = False) -> DataFrame:
    """`row` (all columns of docs), the base measures, base_failed and kept.

    The base measures are results and computed for all rows; what else the rules need is computed rule by rule, in the
    order of the cascade (or as given, if `ordered`), until one rejects. Verdicts depend on a row's text alone: null, empty
    and blank texts have no words and fail; equal rows get equal verdicts; an empty table gives an empty one; columns of
    docs that share a measure's name stay apart in `row`.
    """
    rules = list(rules) if ordered else cascade(docs, text, rules)
    out = measured(docs, text, BASE).withColumn("base_failed", base_failed())
    kept = F.when(F.col("base_failed"), False).otherwise(verdict(rules, BASE))
    return out.withColumn("kept", kept).select("row", *BASE, "base_failed", "kept")


def keep(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, ordered: bool = False) -> DataFrame:
    """The rows of docs that pass, with their columns; the same rows as `judge` keeps, but no measure is computed for a row that an earlier rule rejects.

    Null, empty and blank texts don't pass; equal rows pass or go together; an empty table gives an empty one.
    """
    given = ("words", "n_words")
    rules = merged([*BASE_RULES, *rules])
    rules = rules if ordered else cascade(docs, text, rules, given)
    judged = measured(docs, text, given).withColumn("kept", verdict(rules, given))
    # A generator, not a filter: a filter would be pushed below the measures and evaluate them again.
    passed = judged.select("row", F.explode(F.when(F.col("kept"), F.array(F.lit(True)))).alias("_"))
    return passed.select("row.*")
