"""Checks that rows must pass: schemas, guards, states, and splits of an exact size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def schema_errors(value: Column, rules: dict[str, dict]) -> Column:
    """Ordered distinct error codes of a JSON object against rules by key.

    A rule may say required, type (integer, number, string, boolean), minimum, maximum, pattern (of
    the whole string), enum, and min_length / max_length. Keys without a rule are errors too.
    """
    keys = F.json_object_keys(value)
    found = [F.when(keys.isNull(), F.lit("not_an_object"))]
    found.append(F.when(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in rules]))) > 0, F.lit("unknown_key")))
    for key, rule in rules.items():
        raw = F.get_json_object(value, f"$.{key}")
        present = F.array_contains(keys, key)
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(value), f"$.{key}", "variant"))
        if rule.get("required"):
            found.append(F.when(~present, F.lit(f"{key}:missing")))
        if "type" in rule:
            allowed = {"integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "string": "STRING", "boolean": "BOOLEAN"}[rule["type"]]
            found.append(F.when(present & ~F.coalesce(kind.rlike(f"^({allowed})$"), F.lit(False)), F.lit(f"{key}:type")))
        number = raw.try_cast("double")
        if "minimum" in rule:
            found.append(F.when(number < rule["minimum"], F.lit(f"{key}:minimum")))
        if "maximum" in rule:
            found.append(F.when(number > rule["maximum"], F.lit(f"{key}:maximum")))
        if "pattern" in rule:
            found.append(F.when(present & ~raw.rlike(f"^(?:{rule['pattern']})$"), F.lit(f"{key}:pattern")))
        if "enum" in rule:
            found.append(F.when(present & ~raw.isin(list(rule["enum"])), F.lit(f"{key}:enum")))
        if "min_length" in rule:
            found.append(F.when(F.length(raw) < rule["min_length"], F.lit(f"{key}:min_length")))
        if "max_length" in rule:
            found.append(F.when(F.length(raw) > rule["max_length"], F.lit(f"{key}:max_length")))
    return F.array_distinct(F.array_compact(F.array(*found)))


def require_none(rows: DataFrame, forbidden: Column, message: str) -> DataFrame:
    """rows, or an error when Spark meets a forbidden one."""
    return rows.where(F.when(F.coalesce(forbidden, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def require_one_context(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the context that all rows share; an error if there is none or more than one."""
    found = rows.select(*columns).distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError("no rows" if not found else f"several contexts: {found[0]} and {found[1]}")
    return rows.select(*columns).limit(1)


def decide_candidates(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """(candidate_id, state): pending until decided; a decision counts for the content hash it was made for.

    Approved for another scope is blocked; approved for other content stays pending; the last decision by at wins.
    """
    last = decisions.groupBy("candidate_id").agg(F.max_by(F.struct("verdict", "content_hash", "scope"), "at").alias("d"))
    both = candidates.join(last, "candidate_id", "left")
    stale = F.col("d.content_hash") != F.col("content_hash")
    state = F.when(F.col("d").isNull() | stale, F.lit("pending")).when((F.col("d.verdict") == "approve") & (F.col("d.scope") != F.col("scope")), F.lit("blocked")).when(F.col("d.verdict") == "approve", F.lit("approved")).otherwise(F.lit("rejected"))
    return both.select("candidate_id", state.alias("state"))


def recent_and_summary(turns: DataFrame, key: str, order: str, text: str, keep: int, most: int) -> DataFrame:
    """(key, recent, summary): the last ``keep`` texts joined, and the end of what came before, at most ``most`` characters.

    Null texts don't count. Each older text and the line break before it add at least one character, so the last
    ``keep + most + 1`` rows of a key settle both; Spark drops the others before the shuffle.
    """
    placed = turns.where(F.col(text).isNotNull()).select(key, F.col(order).alias("_o"), F.col(text).alias("_t"))
    placed = placed.withColumn("_back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_o")))).where(F.col("_back") <= keep + most + 1)
    old = F.col("_back") > keep
    placed = placed.withColumn("_t", F.when(old, F.expr(f"right(_t, {int(most)})")).otherwise(F.col("_t")))
    joined = lambda taken: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(taken, F.struct("_o", "_t")))), lambda x: x["_t"]), "\n")
    both = placed.groupBy(key).agg(joined(~old).alias("recent"), joined(old).alias("older"))
    every = turns.select(key).distinct()  # keys whose texts are all null
    both = every.join(both.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left")
    return both.select(key, F.coalesce("recent", F.lit("")).alias("recent"), F.coalesce(F.expr(f"right(older, {int(most)})"), F.lit("")).alias("summary"))


def exact_holdout(groups: DataFrame, size: int) -> DataFrame:
    """(group, held_out): whole groups of together exactly ``size`` rows; nobody if no choice of groups gives it.

    groups: (group, n), one row for each group of a frozen evaluation set, which is small by
    its nature. Groups are tried in the order of a hash of their name, and the first way found is kept.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "group"])
        reach: dict[int, tuple[str, ...]] = {0: ()}
        for name, n in zip(pdf["group"], pdf["n"]):
            for total, names in sorted(reach.items()):
                if total + n <= size:
                    reach.setdefault(int(total + n), (*names, name))
        held = set(reach.get(size, ()))
        return pd.DataFrame({"group": pdf["group"], "held_out": pdf["group"].isin(held)})

    named = groups.select(F.col("group").cast("string").alias("group"), F.col("n").cast("long").alias("n"), F.sha2(F.col("group").cast("string"), 256).alias("h"), F.lit(1).alias("all"))
    return named.groupBy("all").applyInPandas(choose, "group string, held_out boolean")
