"""How someone writes: a card for each group of utterances, and how a holdout's card compares with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import word_count
from skein.operators import percentiles

# Where a band of a card ends, and what a holdout must meet.
BRIEF, DETAILED = 15, 55
FEW_QUESTIONS, MANY_QUESTIONS = 0.15, 0.45
LEAST_ROWS, LEAST_OVERLAP, MOST_DRIFT = 20, 0.4, 0.2
#: The quartiles of nothing.
NO_LENGTHS = {"low": 8, "middle": 20, "high": 40}


def cards(rows: DataFrame, group: str, text: str, direct: str, formal: str, informal: str) -> DataFrame:
    """(group, n, n_words, low, high, directness, form, detail, questions, manner), a row for each group of utterances.

    low and high are the words of the quartiles at the half-even rounded index, low at least 5. directness is the share of
    utterances that match ``direct``; form is the side, formal or informal, that has over 1.5 times the other's matches, else
    mixed. Blank and null texts take no part; a group of none but these has no card.
    """
    said = rows.where(F.trim(text) != "").select(
        F.col(group), word_count(F.col(text)).alias("words"), F.contains(text, F.lit("?")).alias("asks"),
        *[F.col(text).rlike(p).alias(name) for name, p in (("direct", direct), ("formal", formal), ("informal", informal))])
    sums = said.groupBy(group).agg(F.count("*").alias("n"), F.sum("words").alias("n_words"), F.avg(F.col("asks").cast("double")).alias("asked"), F.avg(F.col("direct").cast("double")).alias("directness"), F.count_if("formal").alias("formal"), F.count_if("informal").alias("informal"))
    at = percentiles.rounded(said, group, "words", {"low": 0.25, "middle": 0.5, "high": 0.75}).drop("n")
    low = F.greatest(F.lit(5), "low")
    form = F.when(F.col("formal") > 1.5 * F.col("informal"), "formal").when(F.col("informal") > 1.5 * F.col("formal"), "informal").otherwise("mixed")
    banded = lambda x, few, many, names: F.when(few, names[0]).when(many, names[1]).otherwise(names[2])
    detail = banded("middle", F.col("middle") <= BRIEF, F.col("middle") >= DETAILED, ("low", "high", "medium"))
    questions = banded("asked", F.col("asked") < FEW_QUESTIONS, F.col("asked") > MANY_QUESTIONS, ("few", "many", "clarifying"))
    manner = banded("middle", detail == "low", detail == "high", ("concise", "thorough", "default"))
    return sums.join(at, group).select(group, "n", "n_words", low.cast("long").alias("low"), F.greatest(low, "high").cast("long").alias("high"), "directness", form.alias("form"), detail.alias("detail"), questions.alias("questions"), manner.alias("manner"))


def compare(known: DataFrame, held: DataFrame, group: str) -> DataFrame:
    """(group, n_held, overlap, drift, same_form, passes): each known card beside the card of the same group in the holdout.

    overlap: of the ranges low to high, what both cover by what either does, 1 if both are one point. A group without
    holdout is compared with the card of nothing and never passes.
    """
    seen = held.select(group, F.col("n").alias("n_held"), *[F.col(c).alias(f"held_{c}") for c in ("low", "high", "directness", "form")])
    both = known.join(seen, group, "left").fillna({"n_held": 0, "held_low": NO_LENGTHS["low"], "held_high": NO_LENGTHS["high"], "held_directness": 0.0, "held_form": "mixed"})
    common = F.greatest(F.lit(0), F.least("high", "held_high") - F.greatest("low", "held_low"))
    overlap = F.coalesce(F.try_divide(common, F.greatest("high", "held_high") - F.least("low", "held_low")), F.lit(1.0))
    drift, same = F.abs(F.col("directness") - F.col("held_directness")), F.col("form") == F.col("held_form")
    passes = (F.col("n_held") >= LEAST_ROWS) & (overlap >= LEAST_OVERLAP) & (drift <= MOST_DRIFT) & same
    return both.select(group, "n_held", overlap.alias("overlap"), drift.alias("drift"), same.alias("same_form"), passes.alias("passes"))
