"""Collocations against brute force: small bounds, odd texts, many waves."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from skein.llm import phrases

CUT, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_brute_force(rows, least, top):
    """rows: (lang, text)."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in CUT.split((text or "").translate(LOWER)):
            words = tuple(WORD.findall(piece))
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(words[i : i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        kept = {p: a for p, a in own.items() if a >= least}
        longer = Counter()
        for p, a in kept.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        ranked = []
        for p, a in kept.items():
            if len(p) > 1 and not (longer[p] and 100 * longer[p] >= 80 * a):
                score, _, l, r = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made_texts(seed, docs=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "日本", "A b", "x" * 400, "naïve"]
    for _ in range(docs):
        parts = [rng.choice(words) if rng.random() < 0.7 else "New york City hall" for _ in range(rng.randrange(40))]
        yield rng.choice(["en", "en", "fr", None, "und"]), "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", ": "]) for p in parts)


@pytest.mark.parametrize("most", [(1 << 21, 1 << 19), (5, 7)])
def test_equals_brute_force(spark, most):
    rows = [*made_texts(1), (None, None), ("en", ""), ("de", " \n . ")]
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "lang string, text string, number int, word string, n long").repartition(5)
    want = by_brute_force(rows, 6, 40)
    assert len(want) > 60
    assert rows_of(phrases.collocations(df, 6, 40, *most)) == want


def test_hard_rows(spark, hard, hard_rows, none):
    assert phrases.collocations(none).isEmpty() and phrases.collocations(hard, least=10**6).isEmpty()
    assert rows_of(phrases.collocations(hard, 3, 50)) == by_brute_force([(x[2], x[1]) for x in hard_rows], 3, 50)


def test_blocks_do_not_show(monkeypatch):
    text = ". ".join(" ".join(f"w{i * j % 17}" for i in range(j % 9)) for j in range(400)).encode() + b" ,end"
    whole = phrases.words_of(text)
    for block in (1, 7, 64):
        monkeypatch.setattr(phrases, "_BLOCK", block)
        cut = phrases.words_of(text)
        assert cut.words == whole.words and (cut.codes == whole.codes).all()
    spelt = [None if c < 0 else whole.words[c].decode() for c in whole.codes]
    pieces = [WORD.findall(p) for p in CUT.split(text.decode())]
    flat = [x for p in pieces if p for x in [None, *p]]
    assert spelt == flat
    assert phrases.words_of(b"").words == phrases.words_of(b" .\n").words == []


def test_trie_holds_what_it_was_given():
    rng = np.random.default_rng(5)
    for width, size in ((2, 40), (3, 12), (4, 300)):
        some = np.unique((rng.random((3000, width)) ** 3 * size).astype(np.int32) * 7, axis=0)
        trie = phrases.Trie.of(some)
        ids = (rng.random(20_000) ** 3 * size).astype(np.int32) * 7
        ids[rng.random(len(ids)) < 0.05] = -1
        known = {tuple(p) for p in some.tolist()}
        want = [(i, tuple(ids[i : i + width].tolist())) for i in range(len(ids) - width + 1) if tuple(ids[i : i + width].tolist()) in known]
        for direct in (1 << 24, 1):
            phrases._DIRECT = direct
            place, which = trie.walk(ids, 7 * size)
            assert list(zip(place.tolist(), map(tuple, trie.phrases[which].tolist()))) == want
        phrases._DIRECT = 1 << 24


def test_a_phrase_is_sent_about_once(spark, monkeypatch):
    rng, made = random.Random(9), []
    word = lambda: rng.choice("abcdefgh") + rng.choice("123")
    text = lambda: ". ".join(f"{word()} {word()}" for _ in range(200))
    df = spark.createDataFrame([("en", text()) for _ in range(80)], "lang string, text string").repartition(16)
    as_it_was = type(df).mapInArrow

    def kept(self, f, schema, *rest):
        out = as_it_was(self, f, schema, *rest)
        if "w1 int, w2 int, w3 int, w4 int" in str(schema):
            made.append(out)
        return out

    monkeypatch.setattr(type(df), "mapInArrow", kept)
    frequent = phrases.frequent_phrases(df, 12)[0].where("size > 1").count()
    assert frequent > 500 and made
    assert sum(x.count() for x in made) < 3 * frequent  # each of the tasks sent all of them, twice, before
