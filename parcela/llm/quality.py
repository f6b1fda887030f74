"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1), very bad (-2) or abstains (0). Bad documents are bad in different ways, so there is a
kind of junk for each rule, or group of rules that depend on each other, beside the good documents. Expectation-maximisation over the
counts of vote patterns estimates how many documents are of each kind, and how often each rule objects to it. A document's
posterior probability of being good replaces the all-must-pass filter: a mild objection that comes alone is outvoted by
the other rules, however often the rule makes it; a strong one, or one that comes with a kind of junk, isn't.
Abstentions say nothing.

START is where the estimation begins, and counts as WEIGHT documents, whatever the table's size: from some hundred
documents on, rates are what the documents say. Votes alone can't tell a rule that objects to many good documents from
junk that only this rule finds; strength does. STRONG says what strong means and isn't estimated: few objections to good documents,
and most of those to a rule's own kind of junk, lie so far beyond the bound.

A null text is an empty one: no words, which fails the base rules. Equal texts get equal verdicts, so ties
and repeated rows need no care. An empty table gives an empty result and leaves the rates where they start. Columns
whose names begin with _pq_ are the operator's; others are carried.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.llm.common import SPACE, SPACE_CHARS, documents, materialize

SYMBOLS = "#*$%&|<>"
#: The least number of words, and the greatest share of words in repeated three-word windows.
MIN_WORDS, MAX_REPEATED = 50, 0.5
#: Up to so many repeated windows are looked for one by one; more are found by sorting.
FEW = 16
P = "_pq_"


def count_of(text: Column, chars: str) -> Column:
    """How many characters of the text are among chars."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts that the rules read, in columns that start with P. Each step is a column of its
    own so that none is worked out twice."""
    at = lambda a, i: F.get(a, i)
    c = lambda name: F.col(P + name)
    df = df.withColumn(P + "t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(P + "w", F.filter(F.split(c("t"), rf"[{SPACE}]+"), lambda w: w != ""))
    df = df.withColumn(P + "n_words", F.size(c("w")).cast("long"))
    df = df.withColumn(P + "word_chars", F.length(F.translate(c("t"), SPACE_CHARS, "")).cast("long"))
    df = df.withColumn(P + "n_symbols", count_of(c("t"), SYMBOLS))
    df = df.withColumn(P + "lines", F.filter(F.split(c("t"), "\n", -1), lambda x: x.rlike(rf"[^{SPACE}]")))
    df = df.withColumn(P + "n_lines", F.size(c("lines")).cast("long"))
    df = df.withColumn(P + "n_dup_lines", (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"))
    df = df.withColumn(P + "n_ended", F.size(F.filter(c("lines"), lambda x: x.rlike(rf"[.?!\"…。][{SPACE}]*$"))).cast("long"))
    df = df.withColumn(P + "n_upper", (F.length(c("t")) - F.length(F.regexp_replace(c("t"), r"\p{Lu}", ""))).cast("long"))
    df = df.withColumn(P + "n_shouts", count_of(c("t"), "!"))
    # three-word windows, by their hashes; those of a text are too few for two to collide
    three = F.transform(F.sequence(F.lit(0), F.size(c("w")) - 3), lambda i: F.xxhash64(at(c("w"), i), at(c("w"), i + 1), at(c("w"), i + 2)))
    df = df.withColumn(P + "h", F.when(F.size(c("w")) >= 3, three).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(P + "s", F.sort_array(c("h")))
    df = df.withColumn(P + "r", F.array_distinct(F.filter(c("s"), lambda x, i: (i > 0) & (x == at(c("s"), i - 1)))))
    pairs = F.sort_array(F.transform(c("h"), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn(P + "p", F.when(F.size(c("r")) > FEW, pairs))
    few = F.filter(F.transform(c("h"), lambda x, i: F.when(F.array_contains(c("r"), x), i)), lambda i: i.isNotNull())
    near = lambda x, i: F.coalesce((i > 0) & (at(c("p"), i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(at(c("p"), i + 1)["h"] == x["h"], F.lit(False))
    many = F.sort_array(F.transform(F.filter(c("p"), near), lambda x: x["i"]))
    df = df.withColumn(P + "at", F.when(F.size(c("r")) == 0, F.array().cast("array<int>")).when(F.size(c("r")) <= FEW, few).otherwise(many))
    covered = F.transform(c("at"), lambda p, i: F.least(F.lit(3), F.coalesce(at(c("at"), i + 1) - p, F.lit(3))).cast("long"))
    df = df.withColumn(P + "n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))
    return df.drop(*[P + x for x in ("t", "w", "lines", "h", "s", "r", "p", "at")])


def base_failed() -> Column:
    n, repeated = F.col(P + "n_words"), F.col(P + "n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeated > int(100 * MAX_REPEATED) * n)


def votes() -> dict[str, Column]:
    """The rules, over the columns of with_counts(). A rule has bounds for good, bad and very bad, and abstains
    between the first two."""
    c = lambda name: F.col(P + name).cast("double")
    share = lambda a, b: a / F.greatest(b, F.lit(1.0))
    low_is_good = lambda x, good, bad, worst: F.when(x <= good, 1).when(x > worst, -2).when(x > bad, -1).otherwise(0)
    mean = share(c("word_chars"), c("n_words"))
    return {
        "repeats": low_is_good(share(c("n_repeat_words"), c("n_words")), 0.12, 0.35, 0.50),
        "symbols": low_is_good(share(c("n_symbols"), c("n_words")), 0.02, 0.10, 0.20),
        "dup_lines": F.when(c("n_lines") < 2, 0).otherwise(low_is_good(share(c("n_dup_lines"), c("n_lines")), 0.10, 0.34, 0.50)),
        "word_length": F.when(mean.between(2.5, 11.0), 1).when(mean.between(1.5, 15.0), 0).when(mean.between(1.0, 30.0), -1).otherwise(-2),
        "upper_case": low_is_good(share(c("n_upper"), c("word_chars")), 0.12, 0.40, 0.60),
        "shouts": low_is_good(share(c("n_shouts"), c("n_words")), 0.03, 0.15, 0.30),
        "line_ends": F.when(c("n_lines") < 1, 0).otherwise(low_is_good(1 - share(c("n_ended"), c("n_lines")), 0.40, 0.90, 1.0)),
    }


#: Rules that object to the same kind of junk.
KINDS = (("repeats", "dup_lines"), ("symbols",), ("word_length",), ("upper_case", "shouts"), ("line_ends",))
#: Share of good documents; how often a rule objects to good documents, to junk of its own kind and to other junk.
START = {"good": 0.85, "alarm": 0.02, "own": 0.8, "other": 0.1}
#: How many of the objections to each of these are strong.
STRONG = {"alarm": 0.05, "own": 0.8, "other": 0.3}
#: Documents that START counts as: for the shares of the kinds, for the objections to good documents, and for those to a kind of junk.
WEIGHT = {"share": 20.0, "good": 50.0, "junk": 20.0}
#: Rounds of estimation, at most, and the change of rates at which they end.
ROUNDS, CLOSE = 200, 1e-7
#: Up to so many vote patterns come to the driver; more are summed by Spark in each round.
PATTERNS = 100_000


@dataclass(frozen=True)
class LabelModel:
    """rules: their columns. kinds: of junk, the rules (by place) made for each. share: of good documents, then of each kind of
    junk. objects: a row for each of these, how often the vote that each rule casts is an objection; strong: how
    many of the objections are strong; 0 in all rows for a rule that has no strong ones."""

    rules: tuple[str, ...]
    kinds: tuple[tuple[int, ...], ...]
    share: tuple[float, ...]
    objects: tuple[tuple[float, ...], ...]
    graded: bool = True

    @classmethod
    def start(cls, rules: Sequence[str], kinds: Sequence[Sequence[int]] | None = None, graded: bool = True) -> LabelModel:
        """kinds: one a rule unless told."""
        kinds = tuple(map(tuple, kinds or [[i] for i in range(len(rules))]))
        share = (START["good"], *[(1 - START["good"]) / len(kinds)] * len(kinds))
        return cls(tuple(rules), kinds, share, tuple(tuple(START[x] for x in row) for row in cls.sorts(len(rules), kinds)), graded)

    @staticmethod
    def sorts(n: int, kinds: Sequence[Sequence[int]]) -> list[list[str]]:
        """What an objection of each rule is to good documents, and to each kind of junk."""
        return [["alarm"] * n, *(["own" if i in k else "other" for i in range(n)] for k in kinds)]

    def logs(self) -> np.ndarray:
        """(kind, rule, vote): the log of how often a vote cast is good, bad, very bad."""
        x = np.array(self.objects)
        z = np.array([[STRONG[s] for s in row] for row in self.sorts(len(self.rules), self.kinds)])
        return np.log(np.stack([1 - x, x * (1 - z), x * z] if self.graded else [1 - x, x, x], axis=-1))

    def odds(self, votes: Mapping[str, Column]) -> list[Column]:
        """Of each kind of junk, the log odds against good."""
        logs, out = self.logs(), []
        for kind in range(1, len(self.share)):
            total = F.lit(math.log(self.share[kind] / self.share[0]))
            for i, rule in enumerate(self.rules):
                good, bad, worst = (float(x) for x in logs[kind, i] - logs[0, i])
                total = total + F.when(votes[rule] > 0, good).when(votes[rule] == -1, bad).when(votes[rule] < -1, worst).otherwise(0.0)
            out.append(total)
        return out

    def posterior(self, votes: Mapping[str, Column]) -> Column:
        """The probability of being good."""
        return 1 / (1 + sum((F.exp(x) for x in self.odds(votes)), F.lit(0.0)))

    def refitted(self, kinds: np.ndarray, cast: np.ndarray, bad: np.ndarray) -> LabelModel:
        """The next round's model: documents of each kind, and of each kind and rule the votes cast and the objections."""
        first = LabelModel.start(self.rules, self.kinds)
        share = (kinds + WEIGHT["share"] * np.array(first.share)) / (kinds.sum() + WEIGHT["share"])
        known = np.array([WEIGHT["junk" if k else "good"] for k in range(len(share))])[:, None]
        objects = (bad + known * np.array(first.objects)) / (cast + known)
        return replace(self, share=tuple(share.tolist()), objects=tuple(map(tuple, objects.tolist())))

    def far(self, other: LabelModel) -> float:
        """The greatest change of a rate."""
        own, others = (np.concatenate([np.ravel(m.share), np.ravel(m.objects)]) for m in (self, other))
        return float(np.abs(own - others).max())


def expected(counts: DataFrame, model: LabelModel) -> tuple[np.ndarray, ...]:
    """Documents of each kind, votes cast and objections, summed by Spark over patterns (rules, count)."""
    n, r = len(model.share), len(model.rules)
    df = counts.withColumns({f"{P}o{k}": o for k, o in enumerate([F.lit(0.0), *model.odds({c: F.col(c) for c in model.rules})])})
    df = df.withColumn(P + "top", F.greatest(*[f"{P}o{k}" for k in range(n)]))
    df = df.withColumns({f"{P}e{k}": F.exp(F.col(f"{P}o{k}") - F.col(P + "top")) for k in range(n)})
    part = [F.col("count") * F.col(f"{P}e{k}") / sum((F.col(f"{P}e{j}") for j in range(n)), F.lit(0.0)) for k in range(n)]
    tests = [lambda c: c != 0, lambda c: c < 0]
    sums = part + [F.when(test(F.col(c)), p) for test in tests for p in part for c in model.rules]
    got = np.array([x or 0.0 for x in df.agg(*[F.sum(x).alias(str(i)) for i, x in enumerate(sums)]).first()])
    return got[:n], *got[n:].reshape(2, n, r)


def expected_here(votes: np.ndarray, counts: np.ndarray, model: LabelModel) -> tuple[np.ndarray, ...]:
    """The same for patterns that are on the driver."""
    logs, tests = model.logs(), [votes > 0, votes == -1, votes < -1]
    odds = np.log(model.share) + sum(t @ logs[:, :, i].T for i, t in enumerate(tests))
    part = np.exp(odds - odds.max(axis=1, keepdims=True))
    part *= (counts / part.sum(axis=1))[:, None]
    return part.sum(axis=0), *(part.T @ t for t in (votes != 0, votes < 0))


def fit_labels(df: DataFrame, columns: Sequence[str], kinds: Sequence[Sequence[int]] | None = None, graded: bool = True, rounds: int = ROUNDS, most: int = PATTERNS) -> LabelModel:
    """Expectation-maximisation over all rows of df, by counts of vote patterns, until the rates stay."""
    counts = df.groupBy(*columns).count()
    if 4 ** len(columns) > most:
        counts = materialize(counts, "patterns")
    rows = counts.limit(most + 1).collect()  # more than that are not read here
    here = len(rows) <= most
    votes, sizes = np.array([[r[c] for c in columns] for r in rows]).reshape(-1, len(columns)), np.array([r["count"] for r in rows], float)
    model = LabelModel.start(columns, kinds, graded)
    for _ in range(rounds if rows else 0):
        last, model = model, model.refitted(*(expected_here(votes, sizes, model) if here else expected(counts, model)))
        if model.far(last) < CLOSE:
            break
    return model


def judged(df: DataFrame, columns: list[str], text: str = "text", keep: float = 0.5) -> DataFrame:
    """columns of df with the counts, P + 'posterior' and P + 'kept'. The counts of all rows are worked out
    and written once, then read for the fit and for the verdicts."""
    rules = votes()
    names = [P + "v_" + k for k in rules]
    df = with_counts(df.select(*columns, *([] if text in columns else [text])), text).withColumns(dict(zip(names, rules.values(), strict=True)))
    df = materialize(df if text in columns else df.drop(text), "quality")
    places = {rule: i for i, rule in enumerate(rules)}
    model = fit_labels(df, names, [[places[x] for x in kind] for kind in KINDS])
    df = df.withColumn(P + "posterior", model.posterior({c: F.col(c) for c in names}))
    return df.withColumn(P + "kept", ~base_failed() & (F.col(P + "posterior") >= keep))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass, with their columns."""
    return judged(docs, docs.columns).filter(F.col(P + "kept")).select(*docs.columns)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the posterior, of every document."""
    kept = judged(documents(spark, sf_dir), ["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return kept.select("doc_id", *[F.col(P + x).alias(x) for x in names], base_failed().alias("base_failed"), F.col(P + "kept").alias("kept"), F.round(P + "posterior", 6).alias("posterior"))
