"""Answer-quality scores as Column -> Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .text import let, normalize_text, runs, tokens

# Answers that count only when both sides agree completely.
CLOSED_ANSWERS = ("yes", "no", "noanswer")


Metric = Callable[[Column, Column], Column]


def on_normalised(score: Metric) -> Metric:
    """A metric of prediction and answers from one of their normalised forms; ``normalised`` keeps that one for callers who have these."""
    def of_texts(prediction: Column, answers: Column) -> Column:
        sides = F.struct(normalize_text(prediction).alias("said"), F.transform(answers, normalize_text).alias("truths"))
        return let(sides, lambda side: score(side["said"], side["truths"]))

    of_texts.__doc__ = score.__doc__
    of_texts.normalised = score
    return of_texts


@on_normalised
def accuracy(said: Column, truths: Column) -> Column:
    """1.0 if any normalised answer lies inside the normalised prediction."""
    return let(said, lambda own: F.exists(truths, lambda a: own.contains(a))).cast("double")


@on_normalised
def exact_match(said: Column, truths: Column) -> Column:
    """1.0 if any normalised answer equals the normalised prediction."""
    return let(said, lambda own: F.exists(truths, lambda a: own == a)).cast("double")


@on_normalised
def token_f1(said: Column, truths: Column) -> Column:
    """Harmonic mean of token precision and recall against the first answer; 0.0 without answers."""
    first = F.coalesce(F.get(truths, F.lit(0)), F.lit(""))
    sides = F.struct(said.alias("said"), first.alias("truth"))

    def overlap(both: Column) -> Column:
        """Both sides' words with their counts, sorted: a word that both have stands twice in a row."""
        def pair(n: Column, word: Column, i: Column) -> Column:
            after = F.get(both, i + 1)
            return n + F.when(after["item"] == word["item"], F.least(word["n"], after["n"])).otherwise(F.lit(0).cast("long"))

        places = F.transform(both, lambda word, i: F.struct(word.alias("word"), i.alias("i")))
        return F.aggregate(places, F.lit(0).cast("long"), lambda n, at: pair(n, at["word"], at["i"]))

    def score(side: Column) -> Column:
        said, truth = side["said_tokens"], side["truth_tokens"]
        shared = let(F.array_sort(F.concat(runs(said), runs(truth))), overlap)
        # 2PR / (P + R) with P = shared / said and R = shared / truth
        return let(shared, lambda n: F.when(n == 0, F.lit(0.0)).otherwise(2.0 * n / (F.size(said) + F.size(truth))))

    def judged(side: Column) -> Column:
        said, truth = side["said"], side["truth"]
        disagree = (said.isin(*CLOSED_ANSWERS) | truth.isin(*CLOSED_ANSWERS)) & (said != truth)
        words = F.struct(tokens(said).alias("said_tokens"), tokens(truth).alias("truth_tokens"))
        return F.when(disagree, F.lit(0.0)).otherwise(let(words, score))

    return let(sides, judged)


METRICS: dict[str, Metric] = {
    "accuracy": accuracy,
    "em": exact_match,
    "f1": token_f1,
}


def register_metric(name: str, function: Metric, override: bool = False) -> None:
    """Adds a metric under a name; a taken name is an error unless ``override``."""
    if name in METRICS and not override:
        raise ValueError(f"metric {name!r} is already registered")
    METRICS[name] = function


def metric(name: str) -> Metric:
    if name not in METRICS:
        raise KeyError(f"unknown metric {name!r}; known: {sorted(METRICS)}")
    return METRICS[name]


def scored(rows, names: list[str] | None = None, prediction: str = "generation", answers: str = "answers"):
    """Adds the named metrics to rows with a prediction and answers; both are normalised once for all metrics that are made from that."""
    names = names or list(METRICS)
    kept = rows.columns
    sides = rows.withColumns({"_said": normalize_text(F.col(prediction)), "_truths": F.transform(answers, normalize_text)})

    def value(name: str) -> Column:
        function = metric(name)
        short = getattr(function, "normalised", None)
        return short(F.col("_said"), F.col("_truths")) if short else function(F.col(prediction), F.col(answers))

    return sides.select(*[c for c in kept if c not in names], *[value(n).alias(n) for n in names])
