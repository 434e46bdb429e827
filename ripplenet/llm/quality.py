"""Document quality by weak supervision.

Each rule votes good, bad or abstains on plain text measures. Expectation-maximisation estimates from the counts of vote
patterns (at most 3 to the number of rules, whatever the corpus) how often each rule is right, and the posterior
probability of good quality replaces a demand that all rules pass.

The measures stay inside the row: words and three-word windows are arrays, and windows found again are recognised by
sorting 64-bit hashes with their positions, so no word is ever shuffled.

Nulls and edge cases: a null text has no words. Rows are judged one by one, so repeated rows get equal verdicts; a null
``doc_id`` is passed through. An empty table gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplenet.llm.common import SPACES, WORD, let, positions, whole_text
from ripplenet.storage import materialize

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
EM_ROUNDS = 50
# Each rule has two accuracies: how often its vote is right on good documents and on bad ones. Start values and bounds:
# a rule seldom accuses a good document, may well overlook a bad one (it looks at one defect only), and most of a corpus
# is usable. The bounds keep the two classes from swapping their meaning.
START_SHARE, START_ON_GOOD, START_ON_BAD = 0.85, 0.97, 0.3
GOOD_SHARE, ON_GOOD, ON_BAD = (0.5, 0.98), (0.9, 0.995), (0.02, 0.98)
PRIOR_VOTES = 10.0

# name -> (measure, good from, good to, bad below, bad above); a value in none of the ranges abstains.
RULES: dict[str, tuple[str, float, float, float, float]] = {
    "word_length": ("mean_word", 3.0, 9.0, 2.0, 14.0),
    "symbols": ("symbol_share", 0.0, 0.01, -1.0, 0.05),
    "symbol_runs": ("run_share", 0.0, 0.02, -1.0, 0.15),
    "repeated_lines": ("dup_line_share", 0.0, 0.1, -1.0, 0.5),
    "repeated_words": ("repeat_share", 0.0, 0.15, -1.0, 0.4),
    "length": ("n_words", 50.0, 1e18, 20.0, 1e18),
    "variety": ("distinct_share", 0.3, 1.0, 0.1, 2.0),
}


def _repeated_words(words: Column) -> Column:
    """Words inside three-word windows that are found at least twice."""

    def covered(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(ordered, i)["h"] == x["h"], F.lit(False))
        again = F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1))
        starts = F.sort_array(F.transform(again, lambda x: x["p"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")),
            lambda a: a["n"],
        )

    windows = F.transform(
        positions(F.size(words) - 2),
        lambda i: F.struct(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")
        ),
    )
    return let(F.sort_array(windows), covered)


def text_measures(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts that the rules look at."""
    text = F.col("_text")
    rows = docs.select("doc_id", whole_text().alias("_text"))
    rows = rows.select("doc_id", "_text", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    long = lambda c: c.cast("bigint")
    return rows.select(
        "doc_id",
        long(F.size("_words")).alias("n_words"),
        long(F.char_length(F.translate(text, SPACES, ""))).alias("word_chars"),
        long(F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        let(lines, lambda x: long(F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
        long(_repeated_words(F.col("_words"))).alias("n_repeat_words"),
        long(F.regexp_count(text, F.lit(f"[{SYMBOLS}]+"))).alias("_n_runs"),
        long(F.size(lines)).alias("_n_lines"),
        long(F.size(F.array_distinct("_words"))).alias("_n_distinct"),
    )


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def with_votes(measures: DataFrame, rules: Mapping[str, tuple] = RULES) -> DataFrame:
    """Adds ``_votes``: for each rule 1 (good), -1 (bad) or 0 (abstains), in the rules' order."""
    known = {
        "mean_word": _share("word_chars", "n_words"),
        "symbol_share": _share("n_symbols", "word_chars"),
        "run_share": _share("_n_runs", "n_words"),
        "dup_line_share": _share("n_dup_lines", "_n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "n_words": F.col("n_words").cast("double"),
        "distinct_share": _share("_n_distinct", "n_words"),
    }

    def vote(measure: str, good_from: float, good_to: float, bad_below: float, bad_above: float) -> Column:
        x = known[measure]
        bad = (x < bad_below) | (x > bad_above)
        return F.when(bad, -1).when((x >= good_from) & (x <= good_to), 1).otherwise(0)

    return measures.withColumn("_votes", F.array(*[vote(*rule) for rule in rules.values()]))


def _clip(x: float, bounds: tuple[float, float]) -> float:
    return min(max(x, bounds[0]), bounds[1])


@dataclass(frozen=True)
class Accuracies:
    """Share of good documents, and per rule the chance of a right vote on good and on bad documents."""

    share: float
    on_good: Sequence[float]
    on_bad: Sequence[float]

    def base(self) -> float:
        return math.log(self.share / (1 - self.share))

    def weight(self, rule: int, vote: int) -> float:
        """Log-odds of good that a vote adds; an abstention adds nothing."""
        good, bad = self.on_good[rule], self.on_bad[rule]
        return {1: math.log(good / (1 - bad)), 0: 0.0, -1: math.log((1 - good) / bad)}[vote]

    def p_good(self, votes: Sequence[int]) -> float:
        odds = self.base() + sum(self.weight(j, v) for j, v in enumerate(votes))
        return 1 / (1 + math.exp(-odds))


def estimate(patterns: Sequence[tuple[Sequence[int], int]], n_rules: int, rounds: int = EM_ROUNDS) -> Accuracies:
    """Expectation-maximisation over counted vote patterns, without any label.

    A rule that always abstains keeps its starting accuracies, as does every rule of an empty corpus.
    """
    model = Accuracies(START_SHARE, [START_ON_GOOD] * n_rules, [START_ON_BAD] * n_rules)
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        right = {True: [PRIOR_VOTES * START_ON_GOOD] * n_rules, False: [PRIOR_VOTES * START_ON_BAD] * n_rules}
        cast, good = {True: [PRIOR_VOTES] * n_rules, False: [PRIOR_VOTES] * n_rules}, 0.0
        for votes, n in patterns:
            p = model.p_good(votes)
            good += n * p
            for j, v in enumerate(votes):
                if v:
                    for side, mass in ((True, n * p), (False, n * (1 - p))):
                        cast[side][j] += mass
                        right[side][j] += mass * (v > 0 if side else v < 0)
        ratio = lambda side, bounds: [_clip(r / c, bounds) for r, c in zip(right[side], cast[side], strict=True)]  # noqa: E731, B023
        model = Accuracies(_clip(good / total, GOOD_SHARE), ratio(True, ON_GOOD), ratio(False, ON_BAD))
    return model


def quality(docs: DataFrame, rules: Mapping[str, tuple] = RULES, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: the measures, the hard base verdict, the posterior and whether the text is kept."""
    voted = materialize(with_votes(text_measures(docs), rules), "quality-votes")
    counted = voted.groupBy("_votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** len(rules) rows
    model = estimate(sorted((tuple(r[0]), r[1]) for r in counted), len(rules))
    odds = F.lit(model.base())
    for j in range(len(rules)):
        vote = F.get("_votes", F.lit(j))
        odds = odds + F.when(vote > 0, model.weight(j, 1)).when(vote < 0, model.weight(j, -1)).otherwise(0.0)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    posterior = 1 / (1 + F.exp(-odds))
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (posterior >= 0.5)).alias("kept"), posterior.alias("p_good"),
        *[F.get("_votes", F.lit(j)).alias(f"vote_{name}") for j, name in enumerate(rules)],
    )
