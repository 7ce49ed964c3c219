"""What is embedded for a capability and for a request: three short texts, of meaning, intent and context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Phrases:
    """The words around the values; a deployment gives those of its language."""

    examples: str = "For example: "
    allowed: str = "Allowed operation: "
    action: str = "Action: "
    context: str = "Target and context: "
    argument: str = "argument "
    native: str = "done here"
    shared: str = "also offered elsewhere"
    operation: str = "Operation wanted: "
    wish: str = "Wish: "
    target: str = "Target wanted: "
    arguments: str = "Arguments: "
    request: str = "Request: "
    unknown: str = "unknown"
    none: str = "none"


PHRASES = Phrases()


def _filled(x: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(x, F.lit(""))), F.lit(""))


def _three(semantic: Column, intent: Column, context: Column) -> Column:
    return F.struct(semantic.alias("semantic"), intent.alias("intent"), context.alias("target_context"))


def of_capability(id: Column, label: Column, description: Column, examples: Column, argument_names: Column, operation: Column, targets: Column, shared: Column, p: Phrases = PHRASES) -> Column:
    """Of a capability: its label (else description, else id), description and distinct examples; its operation; its targets, argument names by name and where it is offered."""
    description, label = F.coalesce(_filled(description), F.lit("")), F.coalesce(_filled(label), _filled(description), _filled(id), F.lit(""))
    distinct = F.array_distinct(F.filter(F.transform(F.coalesce(examples, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    shown = F.when(F.size(distinct) > 0, F.concat(F.lit(p.examples), F.array_join(distinct, "; ")))
    named = F.transform(F.array_sort(F.coalesce(argument_names, F.array().cast("array<string>"))), lambda x: F.concat(F.lit(p.argument), x))
    aims = F.concat(F.coalesce(targets, F.array().cast("array<string>")), named)
    semantic = F.array_join(F.filter(F.array(label, description, shown), lambda x: x.isNotNull() & (x != "")), ". ")
    intent = F.concat(F.lit(p.allowed), F.coalesce(operation, F.lit(p.unknown)), F.lit(f". {p.action}"), label, F.lit("."))
    where = F.when(F.coalesce(shared, F.lit(False)), F.lit(p.shared)).otherwise(F.lit(p.native))
    about = F.when(F.size(aims) > 0, F.array_join(aims, ", ")).otherwise(label)
    return _three(semantic, intent, F.concat(F.lit(p.context), F.concat_ws("; ", about, shown, where), F.lit(".")))


def of_request(text: Column, operations: Column, targets: Column, p: Phrases = PHRASES) -> Column:
    """Of a whole request: its words, the operations and targets found in it, or its words where none is."""
    clean = F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))
    listed = lambda head, found: F.concat(F.lit(head), F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise(F.concat(F.lit(p.request), clean)), F.lit("."))
    return _three(clean, listed(p.operation, operations), listed(p.target, targets))


def of_subtask(text: Column, operation: Column, operation_label: Column, target: Column, target_label: Column, arguments: Column, p: Phrases = PHRASES) -> Column:
    """Of one sub-task: its words, its operation and target with their labels, its arguments (a map) by name."""
    clean = F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))
    labelled = lambda x, label: F.coalesce(F.when(_filled(label).isNotNull() & (label != x), F.concat(_filled(x), F.lit(" ("), label, F.lit(")"))).otherwise(_filled(x)), F.lit(p.unknown))
    pairs = F.transform(F.array_sort(F.map_entries(arguments)), lambda e: F.concat(e.key, F.lit("="), e.value))
    told = F.coalesce(F.nullif(F.array_join(pairs, ", "), F.lit("")), F.lit(p.none))
    end = F.concat(F.lit(f". {p.request}"), clean, F.lit("."))
    return _three(clean, F.concat(F.lit(p.operation), labelled(operation, operation_label), end), F.concat(F.lit(p.target), labelled(target, target_label), F.lit(f". {p.arguments}"), told, end))
