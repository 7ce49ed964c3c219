"""Likeness of strings that no built-in function has; Arrow batches, one small helper for each."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


@F.pandas_udf(T.DoubleType())
def echo_score(heard: pd.Series, spoken: pd.Series) -> pd.Series:
    """How much of what was heard is an echo of what was spoken: the largest of four shares.

    1 if it is a part of it; the longest common run of words; the share of longer words
    (four letters or more) that were spoken; the longest common run of characters.
    """

    def score(x: str | None, y: str | None) -> float:
        x, y = (x or "").lower().strip(), (y or "").lower().strip()
        if not x or not y:
            return 0.0
        if x in y:
            return 1.0
        a, b = x.split(), y.split()
        run = SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size / len(a)
        long_words = {w for w in a if len(w) >= 4}
        share = len(long_words & set(b)) / len(long_words) if long_words else 0.0
        return max(run, share, SequenceMatcher(None, x, y, autojunk=False).find_longest_match().size / len(x))

    return pd.Series([score(x, y) for x, y in zip(heard, spoken)], dtype="float64")


@F.pandas_udf(T.StructType([T.StructField("phrase", T.StringType()), T.StructField("ratio", T.DoubleType())]))
def closest_phrase(text: pd.Series, wanted: pd.Series) -> pd.DataFrame:
    """The run of as many words as the wanted phrase has, or one more or fewer, that is most like it; null under 0.45."""

    def best(t: str | None, p: str | None) -> tuple[str | None, float | None]:
        words, n = (t or "").split(), len((p or "").split())
        runs = (" ".join(words[i : i + size]) for size in (n - 1, n, n + 1) if size > 0 for i in range(len(words) - size + 1))
        ratio, phrase = max(((_ratio(r.lower(), p.lower()), r) for r in runs), key=lambda x: x[0], default=(0.0, None))
        return (phrase, ratio) if ratio >= 0.45 else (None, None)

    return pd.DataFrame([best(t, p) for t, p in zip(text, wanted)], columns=["phrase", "ratio"])


def lexicon_replace(text: Column, lexicon: dict[str, str]) -> Column:
    """Whole words replaced by their approved form, longest variant first, whatever their case.

    A fold of built-in replacements; the lexicon is a small parameter.
    """
    for variant in sorted(lexicon, key=lambda v: (-len(v), v)):
        quoted = "".join(c if c.isalnum() or c == " " else "\\" + c for c in variant)
        text = F.regexp_replace(text, rf"(?iU)\b{quoted}\b", lexicon[variant].replace("\\", "\\\\").replace("$", "\\$"))
    return text
