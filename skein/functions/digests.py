"""Loosely shaped answers brought into one shape: a digest of themes, goals, decisions, people and remarks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Which keys stand for a field, in the order they are tried, and which keys of an object are read as text.
KEYS = {
    "themes": ("themes", "theme"),
    "goals": ("goals", "goal", "objective"),
    "decisions": ("decisions", "decision", "action_items"),
    "relations": ("relations", "person_context", "entities"),
    "observations": ("observations", "events"),
    "summary": ("summary", "overview"),
}
SPOKEN = ("name", "title", "summary", "description", "text", "content", "goal", "decision", "relation")
TIMES = ("timestamp", "time")
#: The most characters of each field, and the most entries of a list.
LENGTHS = {"summary": 4000, "topic": 1000, "intent": 1500, "decision": 2000, "person_context": 2000, "person": 300, "observation": 1000}
PEOPLE, OBSERVATIONS, IN_SUMMARY = 30, 10, 8

_TEXT = ("summary", "topic", "intent", "decision", "person_context")
DIGEST = T.StructType([*[T.StructField(c, T.StringType()) for c in _TEXT], *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("people", "observations")], T.StructField("confidence", T.DoubleType())])


def spoken(value) -> str:
    """A nested value as text: strings as they are, lists joined, of objects what is named, each once, after its time. Numbers say nothing."""
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, list):
        return "; ".join(filter(None, map(spoken, value)))
    if isinstance(value, dict):
        said = " — ".join(dict.fromkeys(filter(None, [spoken(value[k]) for k in SPOKEN if k in value])))
        when = spoken(next((value[k] for k in TIMES if value.get(k)), None))
        return f"[{when}] {said}" if when and said else said
    return ""


def _entries(value) -> list[str]:
    """The distinct texts of a list, or of one value, in order."""
    return list(dict.fromkeys(filter(None, map(spoken, value if isinstance(value, list) else [value]))))


def _numbers(value):
    """What stands under confidence in an object and in the lists it holds, at any depth; objects directly inside of objects aren't looked into."""
    stack = [value]
    while stack:
        here = stack.pop()
        if isinstance(here, list):
            stack.extend(here)
        elif isinstance(here, dict):
            sure = here.get("confidence")
            if isinstance(sure, int | float) and not isinstance(sure, bool):
                yield float(sure)
            stack.extend(x for x in here.values() if isinstance(x, list))


def _digest(answer: dict, title: str, content: str) -> tuple:
    got = {field: next((answer[k] for k in keys if answer.get(k)), None) for field, keys in KEYS.items()}
    themes, goals, decisions, relations, seen = (_entries(got[f]) for f in ("themes", "goals", "decisions", "relations", "observations"))
    summary = spoken(got["summary"]) or "; ".join((themes + goals + decisions + seen)[:IN_SUMMARY]) or content.strip() or title.strip()
    first = lambda key, others: spoken(answer.get(key)) or next(iter(others), "")
    cut = lambda name, x: x[: LENGTHS[name]]
    people = [cut("person", p) for p in _entries(answer.get("people"))]
    sure = list(_numbers(answer))
    confidence = min(1.0, max(0.0, sum(sure) / len(sure))) if sure else 0.5
    return cut("summary", summary), cut("topic", first("topic", themes)), cut("intent", first("intent", goals)), cut("decision", "; ".join(decisions)), cut("person_context", "; ".join(relations)), people[:PEOPLE], [cut("observation", x) for x in seen[:OBSERVATIONS]], confidence


@F.pandas_udf(DIGEST)
def digest(answers: pd.Series, titles: pd.Series, contents: pd.Series) -> pd.DataFrame:
    """A digest out of a JSON object; null fields if it is none. What the answer doesn't say is taken from the content, then the title."""

    def one(text, title, content):
        try:
            answer = json.loads(text or "")
        except (ValueError, RecursionError):
            answer = None
        return _digest(answer, title or "", content or "") if isinstance(answer, dict) else (None,) * len(DIGEST)

    rows = [one(*x) for x in zip(answers.tolist(), titles.tolist(), contents.tolist())]
    return pd.DataFrame({c: [r[i] for r in rows] for i, c in enumerate(DIGEST.names)}, dtype=object)


# A filter on a digest's fields would be moved below it, and run it again.
digest = digest.asNondeterministic()


@F.pandas_udf(T.StringType())
def nested_text(values: pd.Series) -> pd.Series:
    """A JSON value as text; null if it isn't JSON."""

    def one(text):
        try:
            return spoken(json.loads(text))
        except (ValueError, TypeError, RecursionError):
            return None

    return values.map(one).astype(object)
