"""May it run: quality reports against an ordered ladder, plans against an allow-list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a report must reach.
LEAST_ACCURACY, LEAST_RECALL, LEAST_ABSTENTION = 0.80, 0.95, 0.95
SCHEMA_VERSION = 2


#: What a ladder reads of a report, and as what.
_FIELDS = {
    **dict.fromkeys(("schema_version", "catalog_coverage", "action_count", "expected_action_count", "sample_count", "base_example_count", "resolved_accuracy", "topk_recall", "safe_abstention_recall", "unsafe_resolution_count"), "double"),
    "quality_gate_passed": "boolean", "catalog_hash": "string", "runtime_fingerprint": "string", "runtime_config": "variant", "quality_gate_failures": "variant",
}
_DEFAULTS = {"double": 0.0, "boolean": False, "string": ""}


def _is_object(x: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), F.lit(False))


def report_verdicts(rows: DataFrame, report: str, actions: int, catalog_hash: str) -> DataFrame:
    """rows with verdict: the first check that a quality report (JSON text) fails, or ``passed``.

    A report may stand under the key metrics. Null is a missing report; what isn't a JSON object is an invalid one. Numbers that
    are missing or don't convert count as 0. The fingerprint is the SHA-256 of runtime_config's
    JSON with sorted keys and no blanks. Each report is parsed once.
    """
    parsed = rows.withColumn("_parsed", F.try_parse_json(report))
    inner = F.try_variant_get("_parsed", "$.metrics", "variant")
    body = parsed.withColumn("_body", F.when(_is_object(inner), inner).otherwise(F.col("_parsed")))

    def one(name: str, kind: str) -> Column:
        value = F.try_variant_get("_body", f"$.{name}", kind)
        return F.coalesce(value, F.lit(_DEFAULTS[kind])) if kind in _DEFAULTS else value

    read = body.withColumn("_r", F.struct(*[one(name, kind).alias(name) for name, kind in _FIELDS.items()]))
    r = F.col("_r")
    config = r.runtime_config
    of_config = F.when(_is_object(config), F.try_variant_get(config, "$.catalog_hash", "string"))
    least = [("resolved_accuracy", LEAST_ACCURACY, "resolved_accuracy_below_0_80"), ("topk_recall", LEAST_RECALL, "topk_below_0_95"), ("safe_abstention_recall", LEAST_ABSTENTION, "safe_abstention_below_0_95")]
    ladder = [
        (F.col(report).isNull(), "missing_report"),
        (~_is_object(F.col("_parsed")), "invalid_report"),
        (r.schema_version != SCHEMA_VERSION, "unsupported_report_schema"),
        (~r.quality_gate_passed, "quality_gate_failed"),
        (r.catalog_coverage < 1.0, "catalog_coverage_incomplete"),
        (r.action_count != actions, "catalog_action_count_mismatch"),
        (r.expected_action_count != actions, "expected_action_count_mismatch"),
        (r.catalog_hash == "", "catalog_hash_missing"),
        (r.catalog_hash != catalog_hash, "catalog_hash_mismatch"),
        (of_config.isNull(), "runtime_config_invalid"),
        (of_config != r.catalog_hash, "runtime_config_catalog_mismatch"),
        (F.sha2(F.to_json(config), 256) != r.runtime_fingerprint, "runtime_fingerprint_invalid"),
        ((r.sample_count < r.base_example_count) | (r.base_example_count < 2 * actions), "evaluation_sample_incomplete"),
        *[(r[name] < bound, reason) for name, bound, reason in least],
        (r.unsafe_resolution_count != 0, "unsafe_resolution_detected"),
        (~F.coalesce(F.to_json(r.quality_gate_failures) == "[]", F.lit(False)), "quality_gate_failures_present"),
    ]
    verdict = reduce(lambda otherwise, rung: F.when(rung[0], F.lit(rung[1])).otherwise(otherwise), reversed(ladder), F.lit("passed"))
    return read.withColumn("verdict", verdict).drop("_parsed", "_body", "_r")


def allowed_plans(plans: DataFrame, steps: DataFrame, definitions: DataFrame, plan: str, enabled: bool = True, canary: Column | None = None) -> DataFrame:
    """(plan, allowed) for each row of plans: whether all its steps may run unseen.

    steps: plan, action_id, asks (it wants a confirmation). definitions: action_id, unique, risk, asks. canary: a condition on action_id, the
    allow-list; without one every plan that has steps may run. A step outside of it, without a definition, of another risk than low, or that
    its definition or itself wants confirmed, keeps the plan from running; so does having no steps, or ``enabled`` being off. Nulls count as no.
    """
    no = F.lit(False)
    if canary is None:
        fine = steps.groupBy(plan).agg(F.lit(True).alias("fine"))
    else:
        known = definitions.select("action_id", (F.col("risk") == "low").alias("_low"), F.coalesce("asks", no).alias("_asks"))
        may = F.coalesce(canary, no) & F.coalesce("_low", no) & ~F.coalesce("_asks", F.lit(True)) & ~F.coalesce("asks", no)
        fine = steps.join(known, "action_id", "left").groupBy(plan).agg(F.bool_and(may).alias("fine"))
    return plans.select(plan).join(fine, plan, "left").select(plan, (F.lit(enabled) & F.coalesce("fine", no)).alias("allowed"))
