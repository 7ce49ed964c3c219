"""Phrase collocations: level-wise candidates in broadcast double-array tries, counted in numpy.

A first pass counts words, a second writes the texts as numbers of frequent words. Then each
level broadcasts tries of the last one's phrases, walks them from all positions of a stretch of
text at once, and where a walk ends one word further on may be a candidate (a phrase whose parts are
all frequent). Those are counted by a hash first; each that may be frequent is sent by one task, then
all tasks count it in arrays, which are summed at the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import _powers, mix, numbered, slices, spread_join, texts, write_table

LEAST, LONGEST, TOP, SHARE = 30, 4, 2000, 80
SCALE = 2_000_000
NO_LANG = "und"
#: Words whose hashes one broadcast holds (20 bytes each), and phrases in one trie; of more, there are several, one after another.
MOST_WORDS, MOST_PHRASES = 1 << 21, 1 << 18
#: Text that is hashed at a time, and that makes one row of the written numbers.
_BLOCK, _BLOB = 1 << 18, 1 << 22
#: Word numbers up to which a task holds a table of them; beyond it searches.
_DIRECT = 1 << 24
#: Positions that a task gathers before it reduces them to distinct phrases.
_HELD = 1 << 19
#: Rows of a batch that a task sends.
_ROWS_SENT = 1 << 16
#: Buckets of longer phrases: about one for each eight words of the corpus, as bits, at most; and those in a part that is sent.
_MOST_BITS, _PART_BITS = 25, 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What a byte is: of a word 0, blank 1, end of a piece 2.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LENGTH = np.uint64(0xB5297A4D3F84D5B5)


# Words of a stretch of text.


def _spans(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool, bool]:
    """Starts, ends, hashes of the words; is there an end of a piece before each, and behind the last."""
    kind = _KIND[a]
    gap = kind > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    ends = np.flatnonzero(kind == 2)
    if not len(start):
        return start, end, np.zeros(0, np.uint64), np.zeros(0, bool), bool(len(ends))
    up, down = _powers("byte", len(a))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _LENGTH)
    before = np.searchsorted(ends, start)
    return start, end, hashes, np.diff(before, prepend=0) > 0, bool(before[-1] < len(ends))


@dataclass
class Words:
    """A stretch's distinct words, and for every position which one it is; -1 where a piece ends."""

    codes: np.ndarray
    hashes: np.ndarray
    words: list[bytes]

    def counts(self) -> np.ndarray:
        return np.bincount(self.codes[self.codes >= 0], minlength=len(self.words))


def words_of(blob: bytes) -> Words:
    low = _LOWER[np.frombuffer(blob, np.uint8)]
    starts, ends, hashes, breaks, at, carried = [], [], [], [], 0, True
    while at < len(low):
        end = min(len(low), at + _BLOCK)
        while end < len(low):  # cut behind a byte that is of no word
            gaps = np.flatnonzero(_KIND[low[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(len(low), 2 * end - at)
        start, stop, hashed, broken, behind = _spans(low[at:end])
        if len(start):
            broken[0] |= carried
            carried = behind
        else:
            carried |= behind
        for rows, x in zip((starts, ends, hashes, breaks), (start + at, stop + at, hashed, broken)):
            rows.append(x)
        at = end
    if not hashes or not sum(map(len, hashes)):
        return Words(np.zeros(0, np.int32), np.zeros(0, np.uint64), [])
    start, stop, broken = np.concatenate(starts), np.concatenate(ends), np.concatenate(breaks)
    codes, distinct = pd.factorize(np.concatenate(hashes))
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    data = low.tobytes()
    words = [data[i:j] for i, j in zip(start[first].tolist(), stop[first].tolist())]
    return Words(np.insert(codes.astype(np.int32), np.flatnonzero(broken), -1), distinct, words)


def _again(words: list[bytes]) -> np.ndarray:
    """64 more bits for each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _of_lang(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Whole texts of a language, one after another, some megabytes at a time; a line break, which ends a piece, stands between."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in slices(batches):
        for lang, data in zip(batch.column("lang").to_pylist(), texts(batch.column("text"))):
            held.setdefault(lang, []).append(data)
            size += len(data)
            if size >= _BLOB:
                yield from ((lang, b"\n".join(x)) for lang, x in held.items())
                held, size = {}, 0
    yield from ((lang, b"\n".join(x)) for lang, x in held.items())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, blob in _blobs(batches):
        found = words_of(blob)
        counts = found.counts()
        if len(counts):  # the last row has all words, and no word
            whole = pa.RecordBatch.from_pydict({"lang": pa.array([lang] * (len(counts) + 1), pa.string()), "word": pa.array([*found.words, None], pa.binary()).cast(pa.string()), "n": pa.array(np.append(counts, counts.sum()))})
            yield from slices([whole], _ROWS_SENT)


# Texts as numbers of frequent words.


def _hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 65536):
        words = texts(batch.column("word"))
        own = np.array([_of_lang(x) for x in batch.column("lang").to_pylist()], np.uint64)
        found = words_of(b"\n".join(words))  # none of them holds a byte that ends words
        h = found.hashes[found.codes[found.codes >= 0]]
        yield pa.RecordBatch.from_pydict({"h": (h ^ own).view(np.int64), "g": (_again(words) ^ own).view(np.int64), "number": batch.column("number")})


def _resolved(h: np.ndarray, g: np.ndarray, ids: np.ndarray, known: tuple[np.ndarray, ...]) -> np.ndarray:
    """ids, with the numbers of the words that are known; both hashes must agree."""
    own_h, own_g, numbers = known
    if not len(own_h):
        return ids
    at = np.minimum(np.searchsorted(own_h, h), len(own_h) - 1)
    return np.where((own_h[at] == h) & (own_g[at] == g), numbers[at], ids)


def _row(codes: np.ndarray, h: np.ndarray, g: np.ndarray, ids: np.ndarray, last: bool) -> pa.RecordBatch:
    if not last:
        return pa.RecordBatch.from_pydict({k: pa.array([x.tobytes()], pa.binary()) for k, x in (("codes", codes), ("h", h), ("g", g), ("ids", ids))})
    out = np.append(ids, np.int32(-1))[codes]
    out = out[(out >= 0) | np.append(True, out[:-1] >= 0)]  # one mark is enough where several pieces end
    return pa.RecordBatch.from_pydict({"ids": pa.array([out.astype(np.int32).tobytes()], pa.binary())})


def _number(known, last: bool, again: bool):
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, blob in _blobs(batches):
            found, own = words_of(blob), _of_lang(lang)
            if len(found.words):
                h, g = found.hashes ^ own, _again(found.words) ^ own
                yield _row(found.codes, h, g, _resolved(h, g, np.full(len(h), -1, np.int32), known.value), last)

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in zip(*(batch.column(c).to_pylist() for c in ("codes", "h", "g", "ids"))):
                codes, h, g, ids = (np.frombuffer(x, kind) for x, kind in zip(values, (np.int32, np.uint64, np.uint64, np.int32)))
                yield _row(codes, h, g, _resolved(h, g, ids, known.value), last)

    return more if again else first


def numbers_of(docs: DataFrame, vocabulary: DataFrame, size: int, most_words: int) -> DataFrame:
    """(ids): the texts as int32 numbers of the vocabulary's words, -1 where a piece ends or a word is none of them.

    The vocabulary is broadcast in shards of bounded size; if there are several, the words' hashes are
    kept with the texts and each shard resolves its own.
    """
    sc = docs.sparkSession.sparkContext
    hashed = write_table(vocabulary.select("lang", "word", F.col("number").cast("int").alias("number")).mapInArrow(_hash_words, "h long, g long, number int"), "hashes")
    rows = docs
    for at in range(0, size, most_words):
        shard = hashed.where(F.col("number").between(at, at + most_words - 1)).toArrow()
        h, g, number = (shard.column(c).to_numpy() for c in ("h", "g", "number"))
        order = np.argsort(h.view(np.uint64))
        known, last = sc.broadcast((h.view(np.uint64)[order], g.view(np.uint64)[order], number[order])), at + most_words >= size
        columns = "ids binary" if last else "codes binary, h binary, g binary, ids binary"
        rows = write_table(rows.mapInArrow(_number(known, last, at > 0), columns), "numbers", instead_of=rows if at else None)
    return rows


# Tries.


def _placed(parent: np.ndarray, letter: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A free slot for every child; those of one parent stand as far apart as their letters. Large families first, only children in what is left."""
    grouped = np.argsort(parent, kind="stable")
    _, begin, many = np.unique(parent[grouped], return_index=True, return_counts=True)
    slot = np.empty(len(parent), np.int64)
    end = int(np.flatnonzero(used)[-1]) + 1
    families = np.argsort(-many, kind="stable")[: int((many > 1).sum())]
    free = low = 0
    for turn, node in enumerate(families):
        own = grouped[begin[node] : begin[node] + many[node]]
        shift = letter[own] - letter[own].min()
        if end + int(shift.max()) >= len(used):
            used = np.append(used, np.zeros(len(used) + int(shift.max()), bool))
            free = 0
        if turn % 512 == 0 or isinstance(free, int):
            free, low = np.flatnonzero(~used[: end + 1]), 0  # from the last on, all fits
        at, step = low, max(4, min(256, (1 << 16) // len(own)))
        while True:
            tried = free[at : at + step, None] + shift
            fits = np.flatnonzero(~used[tried].any(1))
            if len(fits):
                place = tried[fits[0]]
                break
            at, step = at + step, min(2 * step, max(4, (1 << 18) // len(own)))
            if at >= len(free):
                place = end + shift
                break
        low = min(max(low, at - 1024), len(free))  # it is crowded before
        end = max(end, int(place.max()) + 1)
        used[place] = True
        slot[own] = place
    alone = grouped[begin[many == 1]]
    if (lack := len(alone) - int((~used).sum())) > 0:
        used = np.append(used, np.zeros(lack, bool))
    free = np.flatnonzero(~used)[: len(alone)]
    slot[alone] = free
    used[free] = True
    return used, slot


@dataclass
class Trie:
    """A double-array trie: from state s, word w leads to base[s] + w, if check is s there. State 0 is the root."""

    alphabet: np.ndarray  # word numbers, sorted
    letters: np.ndarray  # small numbers for them
    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray  # the phrase that ends in a state, or -1
    phrases: np.ndarray

    @classmethod
    def of(cls, phrases: np.ndarray) -> Trie:
        """phrases: word numbers, a row for each phrase, all distinct and of one length."""
        phrases = phrases[np.lexsort(phrases.T[::-1])]
        alphabet, inside, uses = np.unique(phrases, return_inverse=True, return_counts=True)
        letters = np.empty(len(alphabet), np.int32)
        letters[np.argsort(-uses, kind="stable")] = np.arange(len(alphabet), dtype=np.int32)  # frequent words get small letters
        rows = letters[inside.reshape(phrases.shape)]
        used = np.ones(1, bool)
        base, check = np.zeros(0, np.int32), np.zeros(0, np.int32)
        state, child = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)  # of each phrase so far; is its part so far a new one
        child[:1] = True
        for level in range(phrases.shape[1]):
            child[1:] |= phrases[1:, level] != phrases[:-1, level]
            first = np.flatnonzero(child)
            parent, letter = state[first], rows[first, level].astype(np.int64)
            used, slot = _placed(parent, letter, used)
            used = used[: max(int(np.flatnonzero(used)[-1]) + 1, len(base))]
            base, check = (np.append(x, np.full(len(used) - len(x), -1, np.int32)) for x in (base, check))
            base[parent] = slot - letter
            check[slot] = parent
            state = slot[np.cumsum(child) - 1]
        accept = np.full(len(base), -1, np.int32)
        accept[state] = np.arange(len(phrases))
        return cls(alphabet.astype(np.int32), letters, base, check, accept, phrases.astype(np.int32))

    def letters_of(self, ids: np.ndarray, size: int) -> np.ndarray:
        """The letter at each position, -1 for what the trie lacks."""
        if size <= _DIRECT:
            if not hasattr(self, "_table"):
                self._table = np.full(size + 1, -1, np.int32)
                self._table[self.alphabet] = self.letters
            return self._table[ids]  # -1 is the last place
        at = np.minimum(np.searchsorted(self.alphabet, ids), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == ids, self.letters[at], -1)

    def walk(self, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a phrase begins, rising, and which: all positions' states move a word at a time."""
        letter = self.letters_of(ids, size)
        place = np.flatnonzero(letter >= 0)
        state = np.zeros(len(place), np.int32)
        for step in range(self.phrases.shape[1]):
            if step:
                inside = place + step < len(ids)
                place, state = place[inside], state[inside]
            moved = letter[place + step]
            target = self.base[state] + moved
            there = (moved >= 0) & (target >= 0) & (target < len(self.check))
            there[there] = self.check[target[there]] == state[there]
            place, state = place[there], target[there]
        return place, self.accept[state]


class _Gathered:
    """Distinct phrases of a task with how often each came, reduced now and then."""

    def __init__(self, width: int):
        self.width, self.rows, self.keys, self.size = width, [], [], 0

    def add(self, keys: np.ndarray, places: np.ndarray, ids: np.ndarray) -> None:
        """keys: a long for each, alike for alike phrases; places: where they begin in ids."""
        codes, distinct = pd.factorize(keys)
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = places[::-1]
        self.rows.append(np.stack([ids[first + i] for i in range(self.width)]))
        self.keys.append((distinct, np.bincount(codes, minlength=len(distinct))))
        self.size += len(distinct)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            rows = np.concatenate(self.rows, axis=1)
            codes, distinct = pd.factorize(np.concatenate([k for k, _ in self.keys]))
            first = np.empty(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            counts = np.bincount(codes, np.concatenate([n for _, n in self.keys]), len(distinct)).astype(np.int64)
            self.rows, self.keys, self.size = [], [], 0
            yield from _phrases(rows[:, first], counts, distinct)


def _phrases(words: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(counts), _ROWS_SENT):
        n, k = counts[at : at + _ROWS_SENT], keys[at : at + _ROWS_SENT]
        columns = [pa.array(words[i, at : at + len(n)] if i < len(words) else np.full(len(n), -1, np.int32)) for i in range(LONGEST)]
        yield pa.RecordBatch.from_arrays([pa.array(k), *columns, pa.array(n)], names=["key", *_WORDS, "n"])


_WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
_ROWS = "key long, " + ", ".join(f"{w} int" for w in _WORDS) + ", n long"
_TALLY = "part int, counts binary, " + _ROWS


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in slices(batches, 1):
        yield np.frombuffer(batch.column("ids")[0].as_buffer(), np.int32)


def _hashes(words: list[np.ndarray]) -> np.ndarray:
    """64 bits for each phrase, given as its words' numbers, place by place."""
    out = np.zeros(len(words[0]), np.uint64)
    for w in words:
        out = mix(out ^ ((w.astype(np.uint64) + np.uint64(1)) * _LENGTH))
    return out


def _marked(hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - (8 * len(marks)).bit_length() + 1)).astype(np.int64)
    return (marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _longer(ids: np.ndarray, trie: Trie | None, size: int, marks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Where a phrase of one word more than the trie's may begin, and a number for each, alike for alike phrases.

    Its first part is in the trie. So is its last part, if the trie holds all phrases; if it doesn't, that one's hash is among
    the marks of all. Without a trie: two frequent words.
    """
    if trie is None:
        place = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        return place, ids[place].astype(np.int64) << 32 | ids[place + 1]
    width = trie.phrases.shape[1]
    place, which = trie.walk(ids, size)
    if marks is None:
        there = np.append(place[1:] == place[:-1] + 1, False)[: len(place)]
    else:
        there = place + width < len(ids)
        there[there] = ids[place[there] + width] >= 0
        there[there] = _marked(_hashes([ids[place[there] + i] for i in range(1, width + 1)]), marks)
    place, which = place[there], which[there]
    return place, which.astype(np.int64) << 32 | ids[place + width]


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _own() -> int:
    """A task's mark, 1 to 255."""
    return 1 + TaskContext.get().partitionId() % 255


def _bucket_counts(trie, marks, size: int, bits: int, least: int):
    """A task's counts of longer phrases by a hash of theirs, capped at ``least``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, counts = trie and trie.value, marks and marks.value, np.zeros(1 << bits, np.uint8)
        for ids in _stretches(batches):
            at, n = np.unique(_bucket(_longer(ids, own, size, known)[1], bits), return_counts=True)
            counts[at] = np.minimum(counts[at] + n, least)
        for part in range(1 << max(0, bits - _PART_BITS)):
            some = counts[part << _PART_BITS : (part + 1) << _PART_BITS]
            if some.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "task": pa.array([_own()], pa.int32()), "counts": pa.array([zlib.compress(some.tobytes(), 1)], pa.binary())})

    return emit


def _summed(bits: int, least: int):
    """Adds the tasks' counts as they stream by, a part after another; a byte for each bucket names a task that has most of it, 0 where the sum is below ``least``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << min(bits, _PART_BITS)
        part = None
        done = lambda: pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "hot": pa.array([zlib.compress(np.where(total >= least, task, 0).astype(np.uint8).tobytes(), 1)], pa.binary())})
        for batch in slices(batches, 64):
            for now, own, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "task", "counts"))):
                if now != part:
                    if part is not None:
                        yield done()
                    part, total, most, task = now, np.zeros(size, np.int32), np.zeros(size, np.uint8), np.zeros(size, np.uint8)
                some = np.frombuffer(zlib.decompress(counts), np.uint8)
                task[some > most] = own
                np.maximum(most, some, out=most)
                total += some
                np.minimum(total, least, out=total)
        if part is not None:
            yield done()

    return emit


def _candidates(trie, marks, hot, size: int, bits: int, width: int):
    """Longer phrases in the hot buckets that name this task."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, full, found = trie and trie.value, marks and marks.value, hot.value, _Gathered(width)
        for ids in _stretches(batches):
            place, keys = _longer(ids, own, size, known)
            there = full[_bucket(keys, bits)] == _own()
            found.add(keys[there], place[there], ids)
            if found.size > _HELD:
                yield from found.flush()
        yield from found.flush()

    return emit


def _tally(trie, marks, hot, candidates, wave: tuple[int, int], size: int, bits: int, width: int):
    """A task's counts of a wave's candidates, as arrays; phrases in its hot buckets that are no candidates as rows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, full, found = trie and trie.value, marks and marks.value, hot.value, _Gathered(width)
        wanted, _ = candidates.value
        counts, (turn, turns) = np.zeros(len(wanted), np.int32), wave
        for ids in _stretches(batches):
            place, keys = _longer(ids, own, size, known)
            bucket = _bucket(keys, bits)
            there = (full[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8) & 1).astype(bool) & (bucket * turns >> bits == turn)
            place, keys = place[there], keys[there]
            if len(wanted):
                at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                is_one = wanted[at] == keys
                counts += np.bincount(at[is_one], minlength=len(wanted)).astype(np.int32)
                place, keys = place[~is_one], keys[~is_one]
            found.add(keys, place, ids)
            if found.size > _HELD:
                yield from map(_as_tally, found.flush())
        yield from map(_as_tally, found.flush())
        for part in range(-(-len(counts) >> _PART_BITS)):
            some = counts[part << _PART_BITS : (part + 1) << _PART_BITS]
            if some.any():
                nulls = [pa.nulls(1, kind) for kind in (pa.int64(), *[pa.int32()] * LONGEST, pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(some.tobytes(), 1)], pa.binary()), *nulls], names=["part", "counts", "key", *_WORDS, "n"])

    return emit


def _as_tally(rows: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(rows.num_rows, pa.int32()), pa.nulls(rows.num_rows, pa.binary()), *rows.columns], names=["part", "counts", *rows.schema.names])


def _totals(candidates, least: int):
    """Adds the tasks' counts of candidates, a part after another; those that reach ``least``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words = candidates.value
        part = total = None

        def done() -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(total >= least)
            yield from _phrases(words[:, at + (part << _PART_BITS)], total[at], keys[at + (part << _PART_BITS)])

        for batch in slices(batches, 64):
            for now, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                some = np.frombuffer(zlib.decompress(counts), np.int32)
                if now != part:
                    if part is not None:
                        yield from done()
                    part, total = now, np.zeros(len(some), np.int64)
                total += some
        if part is not None:
            yield from done()

    return emit


def _longer_counts(numbers: DataFrame, trie, marks, size: int, width: int, bits: int, least: int, most_phrases: int) -> list[DataFrame]:
    """Phrases of ``width`` words that come ``least`` times, with their counts.

    A first pass counts by a hash, in a table of fixed size. For each bucket that reaches ``least``, a second one takes the phrases of the task that
    has most of it, so that a phrase is sent about once. The last counts these in arrays; what is in such buckets and isn't among them,
    which is little, is sent as rows. None that is frequent is lost.
    """
    sc, own, capped = numbers.sparkSession.sparkContext, _WORDS[:width], min(least, 255)
    counts = numbers.mapInArrow(_bucket_counts(trie, marks, size, bits, capped), "part int, task int, counts binary")
    parts = counts.repartition("part").sortWithinPartitions("part").mapInArrow(_summed(bits, capped), "part int, hot binary")
    full = np.zeros(1 << bits, np.uint8)
    step = 1 << min(bits, _PART_BITS)
    for r in parts.toLocalIterator():  # 32 MB at most
        full[r.part * step : (r.part + 1) * step] = np.frombuffer(zlib.decompress(r.hot), np.uint8)
    if not full.any():
        return []
    hot = sc.broadcast(full)
    some = numbers.mapInArrow(_candidates(trie, marks, hot, size, bits, width), _ROWS).groupBy("key").agg(*[F.first(w).alias(w) for w in own])
    candidates = write_table(some, f"candidates-{width}")
    waves, out, flags = max(1, -(-candidates.count() // (4 * most_phrases))), [], sc.broadcast(np.packbits(full > 0))
    hot.unpersist()
    for turn, (keys, words) in enumerate(_key_waves(candidates, own, waves, bits)):
        known = sc.broadcast((keys, words))
        sent = write_table(numbers.mapInArrow(_tally(trie, marks, flags, known, (turn, waves), size, bits, width), _TALLY), f"tally-{width}")
        summed = sent.where("part is not null").select("part", "counts").repartition("part").sortWithinPartitions("part").mapInArrow(_totals(known, least), _ROWS)
        others = sent.where("part is null").groupBy(*own).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        out += [summed.select(*own, "n"), others]
    return out


def _key_waves(candidates: DataFrame, own: list[str], waves: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys, rising, and words of the candidates, wave after wave; a bucket's are in one."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wave = (_bucket(batch.column("key").to_numpy(), bits) * waves >> bits).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(wave)], names=[*batch.schema.names, "wave"])

    if waves > 1:
        candidates = write_table(candidates.mapInArrow(places, "key long, " + ", ".join(f"{w} int" for w in own) + ", wave int"), "waves", instead_of=candidates)
    for i in range(waves):
        some = (candidates.where(F.col("wave") == i) if waves > 1 else candidates).toArrow()
        keys = some.column("key").to_numpy()
        order = np.argsort(keys)
        yield keys[order], np.stack([some.column(w).to_numpy()[order] for w in own])


def _waves(phrases: DataFrame, width: int, most_phrases: int) -> Iterator[np.ndarray]:
    """The phrases, a row for each, in tables of bounded size, one after another."""
    waves = -(-phrases.count() // most_phrases)
    wave = F.pmod(F.xxhash64(*_WORDS[:width]), F.lit(waves)) if waves > 1 else F.lit(0)
    for i in range(waves):
        some = phrases.where(wave == i).select(*_WORDS[:width]).toArrow()
        if some.num_rows:
            yield np.stack([some.column(c).to_numpy() for c in _WORDS[:width]], axis=1)


def _marks(phrases: DataFrame, width: int, most_phrases: int) -> np.ndarray | None:
    """A bit for the hash of each, some sixteen bits a phrase and 32 MB at most; None if one trie holds them all."""
    n = phrases.count()
    if n <= most_phrases:
        return None
    bits = min(28, (16 * n).bit_length())
    marks = np.zeros(1 << bits >> 3, np.uint8)
    for some in _waves(phrases, width, most_phrases):
        at = (_hashes(list(some.T)) >> np.uint64(64 - bits)).astype(np.int64)
        np.bitwise_or.at(marks, at >> 3, (128 >> (at & 7)).astype(np.uint8))
    return marks


def _all_of(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionAll(x)
    return rows


def frequent_phrases(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, most_phrases: int = MOST_PHRASES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(p, size, a, lang): phrases of 1 to 4 words as word numbers, lang for single words only; (lang, word, number, n); and (lang, n) with all words."""
    texts_ = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text"))
    counted = texts_.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = write_table(counted.where(F.col("word").isNull() | (F.col("n") >= least)), "words")
    vocabulary = write_table(numbered(words.where("word is not null"), "vocabulary"), "vocabulary")
    size = vocabulary.count()
    found = vocabulary.select(F.array(F.col("number").cast("int")).alias("p"), F.lit(1).alias("size"), F.col("n").alias("a"), "lang")
    if size:
        numbers, sc = numbers_of(texts_, vocabulary, size, most_words), docs.sparkSession.sparkContext
        total = words.where("word is null").agg(F.sum("n")).first()[0]
        bits = max(8, min(_MOST_BITS, (total // 8).bit_length()))
        before = None
        for width in range(2, LONGEST + 1):
            own = _WORDS[:width]
            marks = None if before is None else _marks(before, width - 1, most_phrases)
            marks = None if marks is None else sc.broadcast(marks)
            tries = [None] if before is None else (sc.broadcast(Trie.of(x)) for x in _waves(before, width - 1, most_phrases))
            counts = [rows for trie in tries for rows in _longer_counts(numbers, trie, marks, size, width, bits, least, most_phrases)]
            if not counts:
                break
            before = write_table(_all_of(counts), f"phrases-{width}")
            if before.isEmpty():
                break
            found = found.unionAll(before.select(F.array(*own).alias("p"), F.lit(width).alias("size"), F.col("n").alias("a"), F.lit(None).cast("string").alias("lang")))
    return write_table(found, "phrases"), vocabulary, words.where("word is null").select("lang", F.col("n"))


def _scored(phrases: DataFrame) -> DataFrame:
    """p, lang, a, l, r, score: by the lowest-scoring cut, the earliest of those."""
    cuts = phrases.where("size > 1").select("p", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("p", 1, F.col("k")).alias("first"), F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")).alias("rest"))
    cuts = write_table(cuts, "cuts")
    rows = cuts.count()
    placed = cuts.withColumn("_at", F.monotonically_increasing_id())
    both = spread_join(placed, phrases.select(F.col("p").alias("first"), F.col("a").alias("l"), "lang"), ["first"], rows=rows, counted=cuts)
    both = spread_join(both, phrases.select(F.col("p").alias("rest"), F.col("a").alias("r")), ["rest"], rows=rows, counted=cuts, place=F.col("_at"))
    score = F.expr(f"cast(a as decimal(20,0)) * {SCALE} div (cast(l as decimal(20,0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x")
    return both.groupBy("p", "a").agg(lowest, F.max("lang").alias("lang")).select("p", "a", "lang", "x.score", "x.l", "x.r")


def _inside(phrases: DataFrame) -> DataFrame:
    """(p, longer): the count of the most frequent longer phrase that holds p."""
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.slice("p", i, k))))
    return phrases.where("size > 2").select(F.explode(parts).alias("p"), "a").groupBy("p").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, most_words: int = MOST_WORDS, most_phrases: int = MOST_PHRASES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to 4 words.

    Texts are lower-cased (A to Z), cut into pieces at ``.,;:!?`` and line ends, and these into words at blanks. A
    phrase counts wherever its words stand side by side in a piece. Of its cuts in two the one of the lowest
    score 2000000 a / (l + r), floored, holds, the earliest if several. Phrases that stand within a longer one at
    least 0.8 times as frequent go.

    Words are told apart by 64 bits within a stretch of 4 MB and by 128 bits against the frequent ones. Null texts
    are empty, a null lang is ``und``. Repeated rows count each. No frequent phrase: no rows. Other
    columns, doc_id among them, are ignored.
    """
    phrases, vocabulary, totals = frequent_phrases(docs, least, most_words, most_phrases)
    scored = _scored(phrases).join(_inside(phrases), "p", "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < SHARE * F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    # Ties stay until their words can tell them apart.
    first = write_table(scored.withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place"), "first")
    spelt = first.select("p", F.posexplode("p").alias("i", "number")).join(vocabulary.select("number", "word"), "number")
    spelt = spelt.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("x")).select("p", F.array_join("x.word", " ").alias("phrase"))  # four words at most
    ranked = first.join(spelt, "p").withColumn("rank", F.row_number().over(best.orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) AS sizes(k))
  GROUP BY ALL
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang
), kept AS (
  SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE a >= {LEAST}
), cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, x.a AS l, y.a AS r, ({SCALE}::HUGEINT * c.a) // (x.a + y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept WHERE k > 1) c
  JOIN kept x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN kept y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), parts AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM kept, (VALUES (2), (3)) AS shorter(m) WHERE m < k)
  GROUP BY ALL
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN parts p ON p.lang = s.lang AND p.phrase = s.phrase
  WHERE p.longer IS NULL OR 100 * p.longer::HUGEINT < {SHARE} * s.a
)
SELECT lang, rank::INT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
