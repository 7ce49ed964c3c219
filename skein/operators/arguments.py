"""Arguments of actions out of text: a table of rules, typed results, error codes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One argument of an action: the first match of a pattern (its group), cleaned, as a type.

    kind: string, integer, double, boolean or choice. strip: what goes from both ends of the match. choices: what a choice may
    be, each with the value it stands for (compared in lower case). default: the value where nothing matches, as text of that kind.
    """

    action: str
    name: str
    pattern: str
    group: int = 1
    kind: str = "string"
    required: bool = True
    default: str | None = None
    strip: str = " \t\r\n"
    choices: tuple[tuple[str, str], ...] = ()


def _typed(rule: Rule, found: Column) -> Column:
    if rule.kind == "choice":
        value = F.lit(None).cast("string")
        for word, meaning in reversed(rule.choices):
            value = F.when(F.lower(found) == word.lower(), F.lit(meaning)).otherwise(value)
        return value
    kind = {"string": "string", "integer": "bigint", "double": "double", "boolean": "boolean"}[rule.kind]
    return found.try_cast(kind)


def _one(rule: Rule, text: Column) -> tuple[Column, Column]:
    """The typed value, and an error or null."""
    found = F.nullif(F.btrim(F.regexp_extract(text, rule.pattern, rule.group), F.lit(rule.strip)), F.lit(""))
    value = _typed(rule, found)
    told = value if rule.default is None else F.when(found.isNull(), _typed(rule, F.lit(rule.default))).otherwise(value)
    missing = F.when(found.isNull(), F.lit(f"missing:{rule.name}")) if rule.required and rule.default is None else F.lit(None).cast("string")
    return told, F.when(found.isNotNull() & value.isNull(), F.lit(f"invalid:{rule.name}")).otherwise(missing)


def extract(rows: DataFrame, action: str, text: str, rules: Sequence[Rule]) -> DataFrame:
    """rows with arguments (VARIANT, an object) and errors (array<string>).

    An argument that isn't found, or doesn't convert, is not in the object; its error is missing:name (if it is required and has no
    default) or invalid:name, in the order of the rules. An action without rules has an empty object; a null or unknown action
    has null and unknown_action. A null text is an empty one. All of it is one projection: nothing is shuffled.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    told, failed = F.lit(None).cast("string"), F.array(F.lit("unknown_action"))
    for name in dict.fromkeys(r.action for r in rules):
        own = [(r, *_one(r, body)) for r in rules if r.action == name and r.pattern]
        fields = [value.alias(r.name) for r, value, _ in own]
        told = F.when(F.col(action) == name, F.to_json(F.struct(*fields)) if fields else F.lit("{}")).otherwise(told)
        failed = F.when(F.col(action) == name, F.array_compact(F.array(*[e for *_, e in own])) if own else F.array().cast("array<string>")).otherwise(failed)
    return rows.select("*", F.parse_json(told).alias("arguments"), failed.alias("errors"))
