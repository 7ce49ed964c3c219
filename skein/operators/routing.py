"""Commands in text: tokens, sub-tasks, resolution against a catalog, plans.

Every lexicon is a parameter: a small table of markers, never data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_SUBTASKS = 12


def _lookup(token: Column, table: dict[str, str]) -> Column:
    """The value whose key the token begins with; the longest key wins."""
    found = F.lit(None).cast("string")
    for key in sorted(table, key=lambda k: (len(k), k)):
        found = F.when(F.startswith(token, F.lit(key)), F.lit(table[key])).otherwise(found)
    return found


def tokens(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, token, start): the words of each text in lower case, and where they start (in characters, from 0)."""
    pattern = r"([^\p{L}\p{N}]*)([\p{L}\p{N}]+)"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("word"))
    placed = rows.select(key, F.posexplode(both).alias("at", "x"))
    upto = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("x.gap") + F.length("x.word")).over(upto)
    return placed.select(key, "at", F.lower("x.word").alias("token"), (end - F.length("x.word")).cast("long").alias("start"))


def segment(rows: DataFrame, key: str, text: str, operations: dict[str, str], connectors: set[str], ambiguous: set[str], most: int = MOST_SUBTASKS) -> DataFrame:
    """(key, decision, reason, subtasks): how a command falls into sub-tasks.

    A token that begins like an operation's marker is an anchor; a new sub-task begins at an
    anchor that a connector precedes, or at the first one. An ambiguous connector, or
    more than ``most`` sub-tasks, makes the whole ambiguous; without an anchor it is no command.
    subtasks: structs of number, operation and words, in order.
    """
    t = tokens(rows, key, text).withColumn("operation", _lookup(F.col("token"), operations))
    t = t.withColumn("joins", F.col("token").isin(sorted(connectors)))
    order = Window.partitionBy(key).orderBy("at")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.max(F.col("operation").isNotNull()).over(earlier), F.lit(False))
    begins = F.col("operation").isNotNull() & (~first | F.coalesce(F.lag("joins").over(order), F.lit(False)))
    t = t.withColumn("begins", begins).withColumn("number", F.sum(F.col("begins").cast("int")).over(order))
    part = t.groupBy(key, "number").agg(
        F.min_by(F.when(F.col("begins"), F.col("operation")), "at").alias("operation"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("joins"), F.struct("at", "token")))), lambda x: x.token), " ").alias("words"),
        F.min(F.when(F.col("token").isin(sorted(ambiguous)), F.col("token"))).alias("unclear"),
    )
    whole = part.groupBy(key).agg(F.min("unclear").alias("unclear"), F.array_sort(F.collect_list(F.when(F.col("number") > 0, F.struct("number", "operation", "words")))).alias("subtasks"))
    all_rows = rows.select(key).join(whole, key, "left")
    n = F.coalesce(F.size("subtasks"), F.lit(0))
    empty = F.col("subtasks").isNull()
    decision = F.when(empty, F.lit("non_command")).when(F.col("unclear").isNotNull() | (n > most), F.lit("ambiguous")).when(n == 0, F.lit("non_command")).when(n == 1, F.lit("simple")).otherwise(F.lit("compound"))
    reason = F.when(empty, F.lit("empty_text")).when(F.col("unclear").isNotNull(), F.concat(F.lit("ambiguous_connector:"), "unclear")).when(n > most, F.lit("too_many_subtasks")).when(n == 0, F.lit("no_command_operation"))
    return all_rows.select(key, decision.alias("decision"), reason.alias("reason"), F.when(decision.isin("simple", "compound"), F.col("subtasks")).otherwise(F.lit(None)).alias("subtasks"))


def expand_targets(rows: DataFrame, key: str, text: str, operations: dict[str, str], connectors: set[str], targets: dict[str, str], most: int = MOST_SUBTASKS) -> DataFrame:
    """(key, number, part, operation, target, start, end): a row for each target of each sub-task, with where it stands in the text.

    Sub-tasks begin as :func:`segment` has them. A word that begins like a target's marker names that target; further
    targets take over the sub-task's operation. A sub-task that names none has one row without target, which spans its words. Offsets
    are in characters, from 0, the end exclusive. A text of over ``most`` rows has none at all.
    """
    t = tokens(rows, key, text).withColumn("operation", _lookup(F.col("token"), operations)).withColumn("target", _lookup(F.col("token"), targets))
    order = Window.partitionBy(key).orderBy("at")
    first = F.coalesce(F.max(F.col("operation").isNotNull()).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    joined = F.coalesce(F.lag(F.col("token").isin(sorted(connectors))).over(order), F.lit(False))
    begins = F.col("operation").isNotNull() & (~first | joined)
    t = t.withColumn("begins", begins).withColumn("number", F.sum(F.col("begins").cast("long")).over(order)).where("number > 0").withColumn("end", F.col("start") + F.length("token"))
    # The anchor's own word names no target.
    named = F.array_sort(F.collect_list(F.when(F.col("target").isNotNull() & ~F.col("begins"), F.struct("at", "target", "start", "end"))))
    tasks = t.groupBy(key, "number").agg(F.max(F.when(F.col("begins"), F.col("operation"))).alias("operation"), named.alias("named"), F.min("start").alias("start"), F.max("end").alias("end"))
    alone = F.array(F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("target"), "start", "end"))
    each = tasks.select(key, "number", "operation", F.posexplode(F.when(F.size("named") > 0, F.col("named")).otherwise(alone)).alias("part", "x"))
    counted = each.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where(F.col("_n") <= most)
    return counted.select(key, "number", (F.col("part") + 1).cast("long").alias("part"), "operation", "x.target", "x.start", "x.end")


def lexical_score(operation_matches: Column, target_matches: Column, token_overlap: Column) -> Column:
    """Half for the operation, 0.3 for the target (half of it if unknown), 0.2 for the best word overlap."""
    return 0.5 * operation_matches.cast("double") + 0.3 * F.coalesce(target_matches.cast("double"), F.lit(0.5)) + 0.2 * token_overlap


def combined_score(cosines: Column, spaces: int, lexical: Column, arguments: Column) -> Column:
    """0.60 of the mean positive cosine times the share of spaces that answered, 0.35 lexical, 0.05 arguments."""
    positive = F.aggregate(F.transform(cosines, lambda c: F.greatest(F.lit(0.0), c)), F.lit(0.0), lambda s, x: s + x)
    coverage = F.size(cosines) / spaces
    return 0.60 * F.coalesce(F.try_divide(positive, F.size(cosines)), F.lit(0.0)) * coverage + 0.35 * lexical + 0.05 * arguments


def resolve(candidates: DataFrame, key: str, least_score: float = 0.55, least_margin: float = 0.05, least_confidence: float = 0.6) -> DataFrame:
    """The decision for each request from its scored candidates (key, candidate_id, score, rejected, confidence).

    In this order: transcript too uncertain, nothing found, the best is rejected, its
    score is low, it is alone, its lead is small, resolved. A rejected candidate scores 0.
    """
    scored = candidates.withColumn("score", F.when(F.col("rejected"), F.lit(0.0)).otherwise(F.col("score")))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "candidate_id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    at = lambda c, n: F.max(F.when(F.col("rank") == n, F.col(c)))
    best = ranked.groupBy(key).agg(F.min("confidence").alias("confidence"), at("candidate_id", 1).alias("candidate_id"), at("score", 1).alias("score"), at("rejected", 1).alias("rejected"), at("score", 2).alias("second"))
    ladder = [(F.col("confidence") < least_confidence, "low_transcript_confidence"), (F.col("candidate_id").isNull(), "no_candidate"), (F.col("rejected"), "ineligible"), (F.col("score") < least_score, "low_score"), (F.col("second").isNull(), "resolved_single"), (F.col("score") - F.col("second") < least_margin, "low_margin")]
    decision = reduce(lambda otherwise, rung: F.when(rung[0], F.lit(rung[1])).otherwise(otherwise), reversed(ladder), F.lit("resolved"))
    return best.select(key, "candidate_id", "score", (F.col("score") - F.col("second")).alias("margin"), decision.alias("decision"))


def assemble(steps: DataFrame, key: str) -> DataFrame:
    """One plan for each request from its resolved sub-tasks (key, number, action, target, signature, risk, decision).

    Refused if a sub-task isn't resolved, two have one signature, or one opens what another closes;
    else the ordered actions, each depending on the one before, and the highest risk.
    """
    opened, closed = (F.collect_set(F.when(F.col("action") == a, F.col("target"))) for a in ("open", "close"))
    plan = steps.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("number", "action"))), lambda x: x.action).alias("actions"),
        F.bool_and(F.startswith("decision", F.lit("resolved"))).alias("all_resolved"),
        (F.count_distinct("signature") == F.count("*")).alias("all_differ"),
        F.arrays_overlap(opened, closed).alias("conflict"),
        F.max("risk").alias("risk"),
    )
    refused = F.when(~F.col("all_resolved"), F.lit("unresolved")).when(~F.col("all_differ"), F.lit("repeated_step")).when(F.coalesce("conflict", F.lit(False)), F.lit("conflicting_steps"))
    return plan.select(key, F.when(refused.isNull(), F.col("actions")).alias("actions"), F.when(refused.isNull(), F.col("risk")).alias("risk"), refused.alias("refused"))


def plan_from_answer(text: Column) -> Column:
    """A JSON object out of a model's answer: fenced, else from the first to the last brace, else null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(F.nullif(braces, F.lit(""))))
