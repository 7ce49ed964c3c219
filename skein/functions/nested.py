"""Values of unknown depth: redaction of every string, means of every number under a key."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import privacy

#: The kinds of redaction in their order, as :func:`privacy.redacted` has them.
_STEPS = (("secret", privacy.SECRET, "[SECRET]"), ("checksum_id", privacy.LONG_ID, "[ID]"), ("email", privacy.EMAIL, "[EMAIL]"), ("phone", privacy.PHONE, "[PHONE]"), ("url", privacy.URL, "[URL]"))
REDACTED = T.StructType([T.StructField("value", T.StringType()), T.StructField("flags", T.ArrayType(T.StringType()))])


def _closes(digits: str) -> bool:
    """Eleven digits whose last one closes the weighted sum of the others."""
    return len(digits) == 11 and (10 - sum(int(d) * w for d, w in zip(digits, privacy.CHECK_WEIGHTS)) % 10) % 10 == int(digits[10])


def _walk(value, change):
    if isinstance(value, dict):
        return {k: _walk(v, change) for k, v in value.items()}
    if isinstance(value, list):
        return [_walk(v, change) for v in value]
    return change(value)


@F.pandas_udf(REDACTED)
def redact_json(values: pd.Series) -> pd.DataFrame:
    """Every string inside a JSON value redacted, and the kinds and topics found, each once; what isn't JSON becomes null."""
    patterns = [(flag, re.compile(p), token) for flag, p, token in _STEPS]

    def one(text: str | None):
        found: list[str] = []

        def change(x):
            if not isinstance(x, str):
                return x
            for flag, pattern, token in patterns:
                before = x
                x = pattern.sub((lambda m: token if _closes(m[0]) else m[0]) if flag == "checksum_id" else token, x)  # noqa: B023
                if x != before and flag not in found:
                    found.append(flag)
            for topic, marks in privacy.TOPICS.items():
                if topic not in found and any(mark in x.lower() for mark in marks):
                    found.append(topic)
            return x

        try:
            return json.dumps(_walk(json.loads(text or ""), change), ensure_ascii=False, sort_keys=True), found
        except ValueError:
            return None, []

    return pd.DataFrame([one(x) for x in values], columns=["value", "flags"])


@F.pandas_udf(T.DoubleType())
def mean_confidence(values: pd.Series) -> pd.Series:
    """The mean of all numbers under a key named confidence, at any depth; null if there is none."""

    def collect(value, out: list[float]) -> list[float]:
        for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
            if k == "confidence" and isinstance(v, int | float) and not isinstance(v, bool):
                out.append(float(v))
            collect(v, out)
        return out

    def one(text: str | None) -> float | None:
        try:
            found = collect(json.loads(text or ""), [])
        except ValueError:
            return None
        return sum(found) / len(found) if found else None

    return pd.Series([one(x) for x in values], dtype="float64")
