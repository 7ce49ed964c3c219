"""Walks over nested values of any depth, a row at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _opened(path: Column, node: Column) -> Column:
    return F.struct(path.alias("path"), node.alias("node"), F.try_variant_get(node, "$", "map<string,variant>").alias("named"), F.try_variant_get(node, "$", "array<variant>").alias("listed"))


def _holders(nodes: Column) -> Column:
    return F.filter(nodes, lambda x: x.named.isNotNull() | x.listed.isNotNull())


def walk(rows: DataFrame, id: str, value: str) -> DataFrame:
    """(id, depth, path, node): every object in a VARIANT column, wherever it stands in lists and other objects.

    path tells where, as keys and places joined by dots. A row's levels are opened one after another where the row is;
    it has no more of them than its text has opening brackets. A null value has no nodes.
    """
    object_ = "struct<depth: int, path: string, node: variant>"
    at = lambda path, step: F.concat_ws(".", F.nullif(path, F.lit("")), step)

    def inside(x: Column) -> Column:
        named = F.transform(F.map_entries(x.named), lambda e: _opened(at(x.path, e.key), e.value))
        listed = F.transform(x.listed, lambda v, i: _opened(at(x.path, i.cast("string")), v))
        return _holders(F.coalesce(named, listed))

    def deeper(so_far: Column, depth: Column) -> Column:
        objects = F.transform(F.filter(so_far.level, lambda x: x.named.isNotNull()), lambda x: F.struct((depth - 1).alias("depth"), x.path.alias("path"), x.node.alias("node")))
        further = F.struct(F.concat(so_far.found, objects).alias("found"), F.flatten(F.transform(so_far.level, inside)).alias("level"))
        return F.when(F.size(so_far.level) > 0, further).otherwise(so_far)

    def of_row(v: Column) -> Column:
        start = F.struct(F.array().cast(f"array<{object_}>").alias("found"), _holders(F.array(_opened(F.lit(""), v))).alias("level"))
        brackets = F.length(F.regexp_replace(F.to_json(v), r"[^{\[]+", ""))
        levels = F.when(brackets > 0, F.sequence(F.lit(1), brackets)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(levels, start, deeper, lambda x: x.found)

    # The array around the value binds it, so that it is made once; without an outer generator a filter would walk every row again.
    found = F.flatten(F.transform(F.array(value), of_row))
    return rows.select(F.col(id), F.inline_outer(found)).where("depth is not null")


def _number(node: Column, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(node, p, "double") for p in paths])


def score_windows(nodes: DataFrame, id: str, top: int = 5) -> DataFrame:
    """(id, path, begin, end, kind, name, score, place): the named scores of every node that has some, the first ``top`` of each.

    nodes: what :func:`walk` gives. Scores stand in models.prosody.scores or prosody.scores (name to number), or in
    emotions (a list of name or label and score); both make windows of their own. They are held between 0 and 1; what
    isn't a number is left out; a listed one without a score has 0. Times are the node's begin or start and end, or those in its time. Ties go by name.
    """
    v = F.col("node")
    begin = _number(v, "$.begin", "$.start", "$.time.begin", "$.time.start")
    end = _number(v, "$.end", "$.time.end")
    one = lambda kind, name, score: F.struct(F.lit(kind).alias("kind"), F.trim(name).alias("name"), score.alias("score"))
    scores = F.coalesce(F.try_variant_get(v, "$.models.prosody.scores", "map<string,variant>"), F.try_variant_get(v, "$.prosody.scores", "map<string,variant>"))
    emotions = F.try_variant_get(v, "$.emotions", "array<variant>")
    named = F.transform(F.map_entries(scores), lambda e: one("scores", e.key, F.try_variant_get(e.value, "$", "double")))

    def of_listed(e: Column) -> Column:
        label = F.coalesce(F.nullif(F.try_variant_get(e, "$.name", "string"), F.lit("")), F.try_variant_get(e, "$.label", "string"), F.lit(""))
        return one("emotions", label, F.when(F.try_variant_get(e, "$.score", "variant").isNull(), F.lit(0.0)).otherwise(F.try_variant_get(e, "$.score", "double")))

    def first(scored: Column) -> Column:
        held = F.transform(F.filter(scored, lambda x: (x["name"] != "") & x.score.isNotNull()), lambda x: F.struct((-F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.score))).alias("less"), x["name"].alias("name"), x.kind.alias("kind")))
        return F.transform(F.slice(F.array_sort(held), 1, top), lambda x, i: F.struct(x.kind.alias("kind"), x["name"].alias("name"), (0.0 - x.less).alias("score"), (i + 1).alias("place")))

    both = F.concat(*[F.coalesce(first(x), F.array().cast("array<struct<kind: string, name: string, score: double, place: int>>")) for x in (named, F.transform(emotions, of_listed))])
    return nodes.where(scores.isNotNull() | emotions.isNotNull()).select(id, "path", begin.alias("begin"), end.alias("end"), F.inline_outer(both)).where("kind is not null")
