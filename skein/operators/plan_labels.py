"""Labels of predicted plans, score cards of routing results, and what they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gates of the two reports: (name of a failure, metric, least).
GATES_V1 = (("top1_below_0_80", "top1_accuracy", 0.80), ("topk_below_0_95", "topk_recall", 0.95), ("ambiguity_recall_below_0_80", "ambiguity_recall", 0.80), ("stt_gate_recall_below_0_90", "stt_gate_recall", 0.90))
GATES_V2 = (("resolved_accuracy_below_0_80", "resolved_accuracy", 0.80), ("topk_recall_below_0_95", "topk_recall", 0.95), ("safe_abstention_below_0_95", "safe_abstention_recall", 0.95))


def plan_labels(predicted: Column, predicted_args: Column, expected: Column, expected_args: Column, abstain: Column, complete: Column) -> Column:
    """A struct of sequence_correct, exact_correct and safety.

    predicted and expected are arrays of actions in order, the args arrays of one value for each step. Three-valued:
    exact_correct is null where the arguments aren't complete; and then safety is null too if the actions are right,
    since nobody can tell. Null arrays are empty ones; a null flag is false.
    """
    some = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    predicted, predicted_args, expected, expected_args = (some(x) for x in (predicted, predicted_args, expected, expected_args))
    abstain, complete = (F.coalesce(x, F.lit(False)) for x in (abstain, complete))
    silent = F.size(predicted) == 0
    sequence = F.when(abstain, silent).otherwise(predicted == expected)
    exact = F.when(complete, sequence & (predicted_args == expected_args))
    safety = (
        F.when(abstain, F.when(silent, F.lit("safe_abstain")).otherwise(F.lit("unsafe_resolution")))
        .when(silent, F.lit("missed_action"))
        .when(~sequence | ~F.coalesce(exact, F.lit(True)), F.lit("unsafe_resolution"))
        .when(exact.isNotNull(), F.lit("safe_execute_correct"))
    )
    return F.struct(sequence.alias("sequence_correct"), exact.alias("exact_correct"), safety.alias("safety"))


def labelled(observations: DataFrame, labels: DataFrame, group: str = "split_group_override") -> DataFrame:
    """Observations with what their labels say: joined on request_id, subtask_index and snapshot_sha256.

    A label of another snapshot is stale and ignored; the label's group comes before the observation's. A row of a key
    that has several labels comes with each; a null in a key joins nothing.
    """
    keys = ["request_id", "subtask_index", "snapshot_sha256"]
    told = labels.select(*keys, *[F.col(c).alias(f"label_{c}") for c in labels.columns if c not in keys])
    return observations.join(told, keys, "left").withColumn(group, F.coalesce(f"label_{group}", group)).drop(f"label_{group}")


def score_cards(rows: DataFrame, least_score: float, least_margin: float, least_confidence: float) -> DataFrame:
    """rows with the columns of a score card; rows: matches (an array of action and score, best first), expected, ambiguous, confidence.

    No match at all is under the least score and uncertain; so is a single match, which has no margin.
    """
    first, second = F.get("matches", F.lit(0)), F.get("matches", F.lit(1))
    margin = first.score - second.score
    under = F.coalesce(first.score < least_score, F.lit(True))
    actions = F.transform("matches", lambda m: m.action)
    hit = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(
        "*", first.action.alias("top1"), margin.alias("margin_top2"), hit(first.action == F.col("expected")).alias("hit_at_1"), hit(F.array_contains(actions, F.col("expected"))).alias("hit_at_k"),
        F.coalesce(F.lit(1.0) / F.nullif(F.array_position(actions, F.col("expected")), F.lit(0)), F.lit(0.0)).alias("reciprocal_rank"), under.alias("below_least"),
        F.coalesce(F.col("confidence") < least_confidence, F.lit(False)).alias("gate_blocked"), (under | F.coalesce(margin < least_margin, F.lit(True))).alias("predicted_ambiguous"),
    )


def _ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(empty))


def _coverage(cards: DataFrame, by: str, catalog: DataFrame | None) -> DataFrame:
    """by, n_actions, n_bases, least_bases, n_expected, n_covered: the actions that examples ask for, and how many bases each has."""
    asked = cards.where("expected is not null").select(by, F.col("expected").alias("action"), F.coalesce("base_id", "example_id").alias("base"))
    per_action = asked.distinct().groupBy(by, "action").agg(F.count("*").alias("n"))
    bases = asked.select(by, "base").distinct().groupBy(by).agg(F.count("*").alias("n_bases"))
    known = per_action.select(by, "action") if catalog is None else cards.select(by).distinct().join(F.broadcast(catalog.select("action").distinct()), F.lit(True))
    met = known.join(per_action, [by, "action"], "left").groupBy(by).agg(F.count("*").alias("n_expected"), F.count("n").alias("n_covered"), F.min(F.coalesce("n", F.lit(0))).alias("least_expected_bases"))
    own = per_action.groupBy(by).agg(F.count("*").alias("n_actions"), F.min("n").alias("least_bases"))
    return own.join(bases, by).join(met, by, "full")


def _failures(gates, *more: tuple[str, Column]) -> Column:
    named = [F.when(c, F.lit(name)) for name, c in more] + [F.when(F.col(metric) < least, F.lit(name)) for name, metric, least in gates]
    return F.array_compact(F.array(*named))


def routing_metrics(cards: DataFrame, by: str, catalog: DataFrame | None = None) -> DataFrame:
    """One row for each value of ``by``: accuracy, recalls, margins, coverage, and the gates that fail.

    cards: what :func:`score_cards` gives, with example_id and base_id (null: the example itself). catalog: the actions that
    should be asked for; without it, those that are. A bounded table: it is broadcast. Ratios of nothing are 0.
    """
    hits = lambda c: F.sum(c.cast("long"))
    expected, predicted, blocked = F.col("ambiguous"), F.col("predicted_ambiguous"), F.col("gate_blocked")
    sums = cards.groupBy(by).agg(
        F.count("*").alias("n"), _ratio(hits(F.col("hit_at_1")), F.count("*")).alias("top1_accuracy"), _ratio(hits(F.col("hit_at_k")), F.count("*")).alias("topk_recall"), F.avg("reciprocal_rank").alias("mrr"),
        F.avg("margin_top2").alias("mean_margin"), F.min("margin_top2").alias("least_margin"), hits(F.col("below_least")).alias("n_below_least"),
        _ratio(hits(expected & predicted), hits(predicted)).alias("ambiguity_precision"), _ratio(hits(expected & predicted), hits(expected)).alias("ambiguity_recall"),
        _ratio(hits(expected & blocked), hits(blocked)).alias("stt_gate_precision"), _ratio(hits(expected & blocked), hits(expected)).alias("stt_gate_recall"),
    )
    whole = sums.join(_coverage(cards, by, catalog), by, "left").withColumn("catalog_coverage", _ratio(F.col("n_covered"), F.col("n_expected")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    failed = _failures(GATES_V1, ("base_example_count_below_6", zero("n_bases") < 6), ("action_count_below_3", zero("n_actions") < 3), ("per_action_coverage_below_2", F.col("least_bases") < 2), ("catalog_action_coverage_incomplete", zero("n_covered") < zero("n_expected")))
    return whole.select(*sums.columns, zero("n_bases").alias("n_bases"), zero("n_actions").alias("n_actions"), "catalog_coverage", failed.alias("failures"))


def routing_metrics_v2(cards: DataFrame, by: str, bins: int = 10, catalog: DataFrame | None = None) -> DataFrame:
    """One row for each value of ``by``: accuracy of what was resolved, recall of safe silence, unsafe resolutions, calibration, and the gates that fail.

    cards also have resolved (was an action chosen), abstain (should none be) and combined (its score, 0 to 1, or null). A row is unsafe if it
    resolved what it should not, or resolved to another action than expected.
    """
    hits = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    resolved, abstain, right = F.col("resolved"), F.col("abstain"), F.col("hit_at_1")
    sums = cards.groupBy(by).agg(
        F.count("*").alias("n"), hits(resolved).alias("n_resolved"), _ratio(hits(~abstain & right), hits(~abstain)).alias("resolved_accuracy"),
        _ratio(hits(~abstain & F.col("hit_at_k")), hits(~abstain)).alias("topk_recall"), _ratio(hits(abstain & ~resolved), hits(abstain), 1.0).alias("safe_abstention_recall"),
        hits(resolved & (abstain | ~right)).alias("unsafe_count"), F.coalesce(F.avg(F.when(~abstain & F.col("expected").isNotNull(), F.col("reciprocal_rank"))), F.lit(0.0)).alias("mrr"), F.coalesce(F.avg("margin_top2"), F.lit(0.0)).alias("mean_margin"),
    )
    bin_of = F.least(F.floor(F.col("combined") * bins), F.lit(bins - 1))
    each = cards.where("combined is not null and not abstain").groupBy(by, bin_of.alias("bin")).agg(F.count("*").alias("m"), F.avg(right.cast("double")).alias("acc"), F.avg("combined").alias("conf"))
    ece = each.groupBy(by).agg((F.sum(F.col("m") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("m")).alias("ece"))
    whole = sums.join(ece, by, "left").join(_coverage(cards, by, catalog), by, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    failed = _failures(GATES_V2, ("catalog_action_coverage_incomplete", zero("n_covered") < zero("n_expected")), ("per_action_coverage_below_2", zero("least_expected_bases") < 2), ("unsafe_resolution_detected", F.col("unsafe_count") > 0))
    return whole.select(*sums.columns, "ece", failed.alias("failures"))
