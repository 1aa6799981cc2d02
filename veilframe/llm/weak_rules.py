"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule calls a text good or bad where it is sure, and else says nothing. No label is read: how often a rule is right on
good texts, and on bad texts of each kind (noise, repetition), is estimated from how the rules agree, under the usual
assumption that they err independently once the kind of a text is known. What the estimate needs of a corpus is one
table: how many texts have each combination of votes, at most three to the power of the number of rules. A text is kept if its
votes make good likelier than bad. Everything is DataFrame expressions; texts are read once.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, materialize, q, text_or_empty

SPACES = " \t\n\x0b\f\r"
SYMBOLS, UPPER, STOPS = "#*$%&|<>", "A-Z", ".!?"   # character classes
MARKS = r"##|[*][*]|[$][$]|%%|&&|[|][|]|!!|[?][?]"  # a mark twice in a row
WINDOW = 5
ROUNDS = 12


class Rule(NamedTuple):
    """Conditions in SQL over the counts of a text, ``bad`` is asked first; the kind of bad texts it is made for."""
    name: str
    kind: int
    bad: str
    good: str


RULES = (
    Rule("symbols", 0, "10 * n_symbols > n_words", "n_symbols = 0"),
    Rule("marks", 0, "10 * n_marks > n_words", "n_marks = 0"),
    Rule("word_length", 0, "word_chars > 7 * n_words OR word_chars < 3 * n_words", "word_chars >= 4 * n_words AND word_chars <= 6 * n_words"),
    Rule("upper", 0, "10 * n_upper > 3 * word_chars", "10 * n_upper < word_chars"),
    Rule("stops", 0, "10 * n_stops > 6 * n_words OR (n_stops = 0 AND n_words >= 40)", "50 * n_stops >= n_words AND 10 * n_stops <= 3 * n_words"),
    Rule("repeats", 1, "100 * n_repeat_words > 10 * n_words", "n_repeat_words = 0"),
    Rule("dup_lines", 1, "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 AND n_lines >= 3"),
    Rule("distinct", 1, "100 * n_distinct < 40 * n_words", "100 * n_distinct >= 55 * n_words"),
    Rule("stutter", 1, "10 * n_stutter > n_words", "50 * n_stutter <= n_words"),
)
KINDS = 2
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct", "n_stutter", "n_stops",
          "n_marks")
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"

# Where the estimate starts, and what weight that has, as a share of all texts.
PRIOR_WEIGHT = 0.02
SHARES = (0.8, *[0.2 / KINDS] * KINDS)      # of good texts, and of each kind of bad ones
ON_GOOD, ON_KIND, ON_OTHER = 0.01, 0.6, 0.05    # share of bad votes on good texts, on bad texts of the rule's kind, of another
# Assumed of every rule, so that the kinds keep their meaning: at most one bad vote in a hundred on good texts, at least one in
# five on the texts that the rule is made for; and nothing is certain.
MOST_ON_GOOD, LEAST_ON_KIND, CERTAIN = 0.01, 0.2, 0.001


class Estimate(NamedTuple):
    shares: tuple[float, ...]                   # of good texts and of each kind of bad ones
    bad_votes: tuple[tuple[float, ...], ...]    # for each of these, of each rule: share of bad ones among its votes


def _count(chars: str) -> Column:
    """How many characters of the text are of a class."""
    return F.length(F.regexp_replace("text", f"[^{chars}]+", ""))


def _covered(windows: Column) -> Column:
    """Positions in windows that occur more than once: each repeated window reaches ``WINDOW`` on, or to the next one."""

    def marked(sorted_windows: Column) -> Column:
        def repeated(x: Column, i: Column) -> Column:
            h = x["h"]
            return F.coalesce(h == F.get(sorted_windows, i - 1)["h"], F.lit(False)) | F.coalesce(
                h == F.get(sorted_windows, i + 1)["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(sorted_windows, repeated), lambda x: x["i"]))

    def summed(places: Column) -> Column:
        reach = F.transform(places, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda total, x: total + x)

    # an array of one item stands for a variable: it is computed once
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    paired = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = once(once(paired, marked), summed)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(repeats)


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the ``COUNTS`` of each text.

    Words are compared by their 64-bit hashes within a text: two different words or windows of one text of a million words
    collide with a chance of about 1e-7.
    """
    trimmed = F.btrim(F.col("text"), F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    read = docs.select(q(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).select(
        "doc_id", F.transform(words, lambda w: F.xxhash64(w)).alias("words"), lines.alias("lines"),
        F.length(F.regexp_replace("text", f"{SPACE}+", "")).alias("word_chars"), _count(SYMBOLS).alias("n_symbols"),
        _count(UPPER).alias("n_upper"), _count(STOPS).alias("n_stops"),
        F.regexp_count("text", F.lit(MARKS)).alias("n_marks"))
    words = F.col("words")
    windows = F.when(F.size(words) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    )).otherwise(F.array().cast("array<long>"))
    counted = read.select(
        "doc_id", F.size(words).alias("n_words"), "word_chars", "n_symbols", "n_upper", "n_stops", "n_marks", F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.size(F.array_distinct(words)).alias("n_distinct"),
        F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))).alias("n_stutter"), windows.alias("windows"))
    return counted.withColumn("n_repeat_words", _covered(F.col("windows"))).select(
        "doc_id", *[F.col(c).cast("long").alias(c) for c in COUNTS])


def votes(counts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``counts`` with ``v0, v1, …``: 1 good, 0 bad, null for a rule that abstains."""
    return counts.withColumns({f"v{k}": F.when(F.expr(r.bad), 0).when(F.expr(r.good), 1) for k, r in enumerate(rules)})


def with_posteriors(voted: DataFrame, found: Estimate, weight: str = "1D") -> DataFrame:
    """Adds ``p0, p1, …``: the probabilities that a text is good, or bad of each kind, times ``weight``."""
    # values looked up in an array are data to the generated code, which is then the same in each round and compiled once
    def log_weight(share: float, bad_votes: tuple[float, ...]) -> str:
        first = [math.log(share), *[0.0] * (len(bad_votes) - 1)]
        return " + ".join(f"get(array({c + math.log(x)!r}D, {c + math.log(1 - x)!r}D, {c!r}D), coalesce(v{j}, 2))"
                          for j, (c, x) in enumerate(zip(first, bad_votes)))

    logs = [log_weight(*x) for x in zip(found.shares, found.bad_votes)]
    kinds = range(len(logs))
    return (voted.selectExpr("*", *[f"{x} AS l{k}" for k, x in enumerate(logs)])
            .selectExpr("*", *[f"{weight} / ({' + '.join(f'exp(l{o} - l{k})' for o in kinds)}) AS p{k}" for k in kinds])
            .drop(*[f"l{k}" for k in kinds]))


def _start(rules: tuple[Rule, ...]) -> Estimate:
    return Estimate(SHARES, ((ON_GOOD,) * len(rules), *[tuple(ON_KIND if r.kind == k else ON_OTHER for r in rules) for k in range(KINDS)]))


def estimate(voted: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> Estimate:
    """Expectation-maximisation over the table of vote combinations; without rows, where it starts.

    A round is one aggregate over that table; between rounds the driver holds the estimate only.
    """
    names = [f"v{k}" for k in range(len(rules))]
    table = materialize(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "votes")
    found = start = _start(rules)

    def bounded(share: float, kind: int, rule: Rule) -> float:
        low, high = (CERTAIN, MOST_ON_GOOD) if kind == 0 else (LEAST_ON_KIND if rule.kind == kind - 1 else CERTAIN, 1 - CERTAIN)
        return min(high, max(low, share))

    for _ in range(rounds):
        weighed = with_posteriors(table, found, "n")
        kinds = range(KINDS + 1)
        sums = weighed.selectExpr("sum(n) AS n", *[f"sum(p{k}) AS p{k}" for k in kinds],
                                  *[f"sum(IF({c} = 0, p{k}, 0D)) AS bad{k}{c}" for k in kinds for c in names],
                                  *[f"sum(IF({c} IS NULL, 0D, p{k})) AS all{k}{c}" for k in kinds for c in names]).first()
        if not sums["n"]:
            break
        prior = PRIOR_WEIGHT * sums["n"]
        found = Estimate(
            tuple((sums[f"p{k}"] + prior * start.shares[k]) / (sums["n"] + prior) for k in range(KINDS + 1)),
            tuple(tuple(bounded((sums[f"bad{k}{c}"] + prior * x) / (sums[f"all{k}{c}"] + prior), k, r)
                        for c, x, r in zip(names, start.bad_votes[k], rules)) for k in range(KINDS + 1)))
    return found


def weak_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5,
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its id, the ``COUNTS``, the votes, ``base_failed``, ``posterior`` (of good) and ``kept``.

    A text is kept unless it fails the base conditions or its posterior is below ``threshold``. Null and empty texts have no
    words: they fail. Repeated rows and null ids each get their row and count as often as they occur; ties do not arise; an
    empty table gives an empty result; other columns, whatever their names, are not read.
    """
    voted = materialize(votes(text_counts(docs, id_col, text_col), rules), "counts")
    judged = with_posteriors(voted, estimate(voted, rules)).withColumnRenamed("p0", "posterior").withColumn("base_failed", F.expr(BASE_FAILED))
    return (judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
            .drop(*[f"p{k}" for k in range(1, KINDS + 1)]))
