"""License scans: phrases word by word, and templates by an exact set-similarity join."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import body, slices, texts

CONTAINMENT = 0.8
# The phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Our own statements of licenses and rights, the labels they give, and the words that tell
# them from others, without which nothing is a match.
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3", "gnu general public 3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", "gnu general public free software"),
    ("licensed under the apache license version 2 0", "apache-2", "apache license 2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2", "applicable law writing software distributed license"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc by nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc", "creative commons attribution noncommercial"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by", "creative commons attribution"),
    ("released under the mit license", "mit-notice", "mit license"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-notice", "permission granted software"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", "redistribution source binary"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved", "rights reserved reproduced"),
)


#: On UTF-8 bytes: all that aren't ASCII belong to words.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(data: bytes) -> list[bytes]:
    return _WORDS.findall(data.lower())  # bytes.lower() changes A-Z only


def block_length(tokens: int) -> int:
    """Consecutive words in a block for a template of so many distinct tokens: half as many again, so other words may stand between."""
    return (3 * tokens + 1) // 2


def _counts(vocabulary: frozenset[bytes]):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for data in texts(batch.column("text")):
                seen.update(vocabulary.intersection(words_of(data)))
        yield pa.RecordBatch.from_pydict({"token": pa.array([w.decode() for w in seen], pa.string()), "n": pa.array(seen.values(), pa.int64())})

    return emit


def token_order(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """The templates' tokens, ranked by the number of all documents that hold them, rarest first."""
    vocabulary = frozenset(w for text, _, _ in templates for w in words_of(text.encode()))
    counted = docs.select(body().alias("text")).mapInArrow(_counts(vocabulary), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    n = {r.token.encode(): r.n for r in counted.collect()}  # no more rows than the templates have tokens
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (n.get(w, 0), w)))}


class TemplateIndex:
    """The templates' side of the join: sets in the global order, and which of them have a token in their prefix."""

    def __init__(self, templates, order: dict[bytes, int], containment: float):
        self.order, self.sets, self.prefixes = order, [], {}
        for text, label, must in templates:
            tokens = sorted(set(words_of(text.encode())), key=order.__getitem__)
            least = ceil(containment * len(tokens) - 1e-9)
            at = len(self.sets)
            self.sets.append((tokens, frozenset(tokens), least, frozenset(words_of(must.encode())), label))
            # A block that holds ``least`` of the tokens can't miss all of the first n - least + 1.
            for i, token in enumerate(tokens[: len(tokens) - least + 1]):
                self.prefixes.setdefault(token, []).append((at, i))
        self.any_prefix = frozenset(self.prefixes)

    def _candidates(self, known: set[bytes]) -> set[int]:
        """The templates of which some block of a text with these words may hold enough."""
        common = sorted(known & self.order.keys(), key=self.order.__getitem__)
        found, done = set(), set()
        for j, token in enumerate(common):
            for at, i in self.prefixes.get(token, ()):
                if at in done:
                    continue
                done.add(at)
                tokens, whole, least, must, _ = self.sets[at]
                # Length, and position: no token before i or j is shared, so at most these are.
                if len(known) < least or 1 + min(len(tokens) - i - 1, len(common) - j - 1) < least:
                    continue
                if must <= known and len(whole & known) >= least:
                    found.add(at)
        return found

    def matches(self, words: list[bytes], known: set[bytes]) -> dict[str, float]:
        """The labels of the templates that some block of the text contains, and to what part at best."""
        best: dict[str, float] = {}
        for at in self._candidates(known):
            tokens, whole, least, must, label = self.sets[at]
            places = [(i, w) for i, w in enumerate(words) if w in whole]
            reach, first, held = block_length(len(tokens)), 0, Counter()
            for i, w in places:
                held[w] += 1
                while i - places[first][0] >= reach:
                    gone = places[first][1]
                    held[gone] -= 1
                    if not held[gone]:
                        del held[gone]
                    first += 1
                if len(held) >= least and must <= held.keys():
                    best[label] = max(best.get(label, 0.0), len(held) / len(tokens))
        return best


def _places(words: list[bytes], phrases) -> Iterator[tuple[int, str]]:
    for phrase, label in phrases:
        at = -1
        try:
            while True:
                at = words.index(phrase[0], at + 1)
                if words[at : at + len(phrase)] == phrase:
                    yield at, label
        except ValueError:
            pass


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def _scan(index: TemplateIndex, phrases):
    heads = frozenset(p[0] for p, _ in phrases)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
                words = words_of(data)
                known = set(words)
                places = list(_places(words, phrases)) if known & heads else []
                base = {label for _, label in places}
                found = index.matches(words, known) if known & index.any_prefix else {}
                starts = [at for at, _ in places]
                score = 1.0 if places else max(found.values(), default=0.0)
                rows.append((doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found.keys())), score))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return emit


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row for each document.

    Base: the places where a phrase's words stand one after another in the whole text,
    lines aside. Join: every block of consecutive words of the whole text, lines aside, half as
    long again as the template, is compared as a set of words with the template, and gives its
    label if it holds at least ``containment`` of its tokens, among them those that tell it
    from other licenses; rare tokens first, by counts over all documents, prefix, length and
    position rule pairs out before the exact check. score: 1 if there is a base place,
    else the best containment that met the threshold, else 0.

    Null and empty texts: no words, no labels, score 0. Repeated rows give repeated rows.
    No rows: no rows. The broadcast templates are a parameter, not data. Other columns are ignored.
    """
    split = [([w.encode() for w in p.split()], label) for p, label in phrases.items()]
    index = TemplateIndex(templates, token_order(docs, templates), containment)
    return docs.select(F.col("doc_id").cast("long"), body().alias("text")).mapInArrow(_scan(index, split), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    lower = "translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    phrases = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in PHRASES.items())
    rows = [(sorted(set(t.split())), label, must.split()) for t, label, must in TEMPLATES]
    templates = ", ".join(f"({quoted(w)}, '{label}', {quoted(must)}, {ceil(CONTAINMENT * len(w) - 1e-9)}, {block_length(len(w))})" for w, label, must in rows)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, {lower % "coalesce(text, '')"} AS t FROM documents),
w AS (SELECT doc_id, row_id, t, regexp_extract_all(t, {word}) AS words FROM d),
phrases(p, label) AS (VALUES {phrases}),
starts AS (SELECT row_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
places AS (SELECT s.row_id, s.i - 1 AS place, p.label FROM starts s, phrases p WHERE s.words[s.i : s.i + len(p.p) - 1] = p.p),
base AS (
  SELECT row_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list_distinct(list(label))) AS labels
  FROM places GROUP BY row_id),
templates(tokens, label, must, least, reach) AS (VALUES {templates}),
candidates AS (
  SELECT w.row_id, w.words, t.* FROM (SELECT *, list_distinct(words) AS own FROM w) w, templates t WHERE len(list_intersect(t.tokens, w.own)) >= t.least),
blocks AS (
  SELECT row_id, label, tokens, must, least, words[i : i + reach - 1] AS block
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM candidates) WHERE list_contains(tokens, words[i])),
met AS (
  SELECT row_id, label, CAST(len(list_intersect(tokens, block)) AS DOUBLE) / len(tokens) AS part
  FROM blocks WHERE list_has_all(block, must) AND len(list_intersect(tokens, block)) >= least),
joined AS (SELECT row_id, list_distinct(list(label)) AS labels, max(part) AS part FROM met GROUP BY row_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(b.n_base, 0) AS BIGINT) AS n_base,
       CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
       array_to_string(coalesce(b.labels, []), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(j.labels, [])))), ',') AS labels,
       CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(j.part, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN base b ON w.row_id = b.row_id LEFT JOIN joined j ON w.row_id = j.row_id
"""


SQL = _sql()
