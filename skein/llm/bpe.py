"""BPE encoding and decoding: merges by a priority queue over a doubly linked list of symbols.

A text is cut as the tokenizer cuts it; every piece's bytes become a linked list of
symbols, and a heap of (rank, position) says which neighbours merge next. Entries whose
symbols have changed since are stale and skipped. Decoding concatenates the vocabulary's
byte strings.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import body, slices
from skein.llm.packing import _BYTE_LEVEL, _ODD, _byte_letters, default_tokenizer

#: Pieces and words that a worker remembers, at most twice as many each, and the longest of them; what is not remembered is merged again.
_MOST_KNOWN, _LONGEST_KNOWN = 300_000, 64
#: A space with white space, or nothing, on both sides: there the pieces of a text are not those of what single spaces separate.
_WIDE_GAP = re.compile(r" (?<=\s )(?=\s|\Z)").search
_loaded: dict[str, Bpe] = {}


class _Known(dict):
    """Ids by text, four bytes each; what is not there is made. Of two generations the older one goes when the younger is full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.make(text)
        if len(text) <= _LONGEST_KNOWN:
            if len(self) >= _MOST_KNOWN:
                self.older = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Bpe:
    """A byte-level BPE vocabulary: a tokenizer file (.json) or byte strings with their ranks (.tiktoken).

    A tokenizer file may have added tokens; it must have no normalizer and cut texts by the
    byte-level pattern. Truncation, padding and the post-processor are not used. Anything
    else raises ValueError.
    """

    def __init__(self, path: str):
        self.strings: dict[int, bytes] = {}
        self.added: dict[str, int] = {}
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        if path.endswith(".tiktoken"):
            with open(path, "rb") as file:
                ids = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in file if line.strip())}
            for word, i in ids.items():
                for cut in range(1, len(word)):
                    a, b = ids.get(word[:cut]), ids.get(word[cut:])
                    if a is not None and b is not None:
                        pairs[a, b] = (i, i)
        else:
            with open(path, encoding="utf-8") as file:
                spec = json.load(file)
            ids, merges = self._read(spec)
            for rank, (a, b) in enumerate(merges):
                pairs[ids[a], ids[b]] = (rank, ids[a + b])
            for x in spec.get("added_tokens") or ():
                if x.get("single_word") or x.get("lstrip") or x.get("rstrip"):
                    raise ValueError(f"{path}: the added token {x['content']!r} takes in its surroundings")
                self.added[x["content"]] = x["id"]
        if missing := [b for b in range(256) if bytes([b]) not in ids]:
            raise ValueError(f"{path}: no symbol for the bytes {missing}")
        self.strings = {i: word for word, i in ids.items()} | {i: word.encode() for word, i in self.added.items()}
        self.symbols = [ids[bytes([b])] for b in range(256)]
        #: Ranks of a symbol's merges by the symbol behind it; what a merge makes, by rank.
        none: dict[int, int] = {}
        self.ranks = [none] * (max(self.strings) + 1)
        for (a, b), (rank, _) in pairs.items():
            if self.ranks[a] is none:
                self.ranks[a] = {}
            self.ranks[a][b] = rank
        self.made = dict(pairs.values())
        #: Ranks of two bytes' merges, None where there is none, by byte and byte behind it.
        self.first = [list(map(self.ranks[a].get, self.symbols)) for a in self.symbols]
        self.pieces = _Known(lambda piece: array("i", self.merged(piece.encode())).tobytes())
        self.words = _Known(lambda word: self._cut(" " + word))
        self.cut = regex.compile(_BYTE_LEVEL).findall
        self.split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None

    @staticmethod
    def _read(spec: dict) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        if not plain or spec.get("normalizer") or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("only plain byte-level BPE is known")
        letters = _byte_letters()
        known = lambda word: all(c in letters for c in word)
        of = lambda word: bytes(map(letters.__getitem__, word))
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        return {of(word): i for word, i in model["vocab"].items() if known(word)}, [(of(a), of(b)) for a, b in merges]

    @cached_property
    def library_cut(self):
        """Cuts texts with characters on whose class two Unicode tables could differ."""
        from tokenizers import pre_tokenizers

        own = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return lambda text: [text[start:end] for _, (start, end) in own.pre_tokenize_str(text)]

    def merged(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        symbol = list(map(self.symbols.__getitem__, data))
        n, ranks, made, first = len(symbol), self.ranks, self.made, self.first
        bits = n.bit_length()
        last = (1 << bits) - 1
        heap = [rank << bits | i for i, (a, b) in enumerate(pairwise(data)) if (rank := first[a][b]) is not None]
        if not heap:
            return symbol
        heapify(heap)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while heap:
            top = heappop(heap)
            rank, i = top >> bits, top & last
            j = after[i]
            if j >= n or (a := symbol[i]) < 0 or ranks[a].get(symbol[j]) != rank:
                continue  # stale
            symbol[i], symbol[j] = own, _ = made[rank], -1
            h, k = before[i], after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (rank := ranks[own].get(symbol[k])) is not None:
                    heappush(heap, rank << bits | i)
            if h >= 0 and (rank := ranks[symbol[h]].get(own)) is not None:
                heappush(heap, rank << bits | h)
        return [x for x in symbol if x >= 0]

    def _cut(self, text: str) -> bytes:
        cut = self.library_cut if _ODD.search(text) else self.cut
        return b"".join(map(self.pieces.__getitem__, cut(text)))

    def _plain(self, text: str) -> bytes:
        # A piece begins before every single space, so words are cut and remembered alone.
        first, *words = text.split(" ")
        if not words or _WIDE_GAP(text):
            return self._cut(text)
        return self._cut(first) + b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str) -> np.ndarray:
        """The text's ids, as 32 bits each."""
        if self.split is None or not any(x in text for x in self.added):
            return np.frombuffer(self._plain(text), np.int32)
        parts = (np.array([self.added[x]], np.int32).tobytes() if x in self.added else self._plain(x) for x in self.split(text))
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; an id that the vocabulary lacks is left out, bytes that aren't UTF-8 become U+FFFD."""
        own = self.strings
        try:
            data = b"".join(map(own.__getitem__, ids))
        except KeyError:
            data = b"".join(own[i] for i in ids if i in own)
        return data.decode("utf-8", "replace")


def load(path: str) -> Bpe:
    """One vocabulary a worker, whatever the number of tasks."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _adds(column: pa.Array, batch: pa.RecordBatch, name: str) -> pa.RecordBatch:
    at = batch.schema.get_field_index(name)
    columns = [column if i == at else x for i, x in enumerate(batch.columns)] + [column] * (at < 0)
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names + [name] * (at < 0))


def _encode(path: str, text: str, ids: str):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(path).encode
        for batch in slices(batches, 128):
            rows = [encode(x or "") for x in batch.column(text).to_pylist()]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            yield _adds(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows))), batch, ids)

    return emit


def _decode(path: str, ids: str, text: str):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = load(path).decode
        for batch in slices(batches, 128):
            column = batch.column(ids)
            ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)))
            flat = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False).tolist()
            yield _adds(pa.array([decode(flat[a:b]) for a, b in pairwise(ends.tolist())], pa.string()), batch, text)

    return emit


def _with(docs: DataFrame, name: str, kind: str) -> str:
    others = [f"`{f.name}` {f.dataType.simpleString()}" if f.name != name else f"`{name}` {kind}" for f in docs.schema]
    return ", ".join(others + [f"`{name}` {kind}"] * (name not in docs.columns))


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column ``ids`` (array<int>): the text's tokens, added tokens in it as such, none added around it.

    Null and empty texts have no ids. Repeated rows are encoded each. Other columns stay; one
    that is called ``ids`` is replaced. No rows: no rows. Nothing is shuffled.
    """
    return docs.mapInArrow(_encode(tokenizer, text, ids), _with(docs, ids, "array<int>"))


def decode(docs: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with a column ``decoded``: the ids' vocabulary strings, one after another, special tokens included.

    Null and empty ids are an empty text; a null id, or one the vocabulary lacks, is left out. Other
    columns stay; one that is called ``decoded`` is replaced. Nothing is shuffled.
    """
    return docs.mapInArrow(_decode(tokenizer, ids, text), _with(docs, text, "string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", body().alias("text"))
    both = decode(encode(docs, default_tokenizer()).select("doc_id", "ids"), default_tokenizer())
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
