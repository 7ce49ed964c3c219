"""BPE against the tokenizer libraries on the same vocabularies."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter

import pytest

from skein.llm import bpe

PATH = bpe.default_tokenizer()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    own.no_truncation()
    own.no_padding()
    return own


def odd_texts():
    rng = random.Random(3)
    kinds = ["abcdefgh ", "aAbB'st \n", "0123456789 ,.", "éèêçà ñ ", "日本語 漢字", "    \t\r\n", "\x00\x1c\x1f\x85᠎ a", "👩‍👩‍👧 🏽a", "́ͅa1², Ⅷ½"]
    yield from ("a  b", "a   b", "a \n b", "a\n b", "a b ", "a b  ", " a", "  a", "a \u00a0 b", "a\u2003 b \u2003c", "\x1c a \x1c b", "", " ", "  ", "a", "'ll we'LL don't", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "x" * 5000, " " * 3000 + "a", "ab" * 4000)
    for _ in range(400):
        kind = rng.choice(kinds) + rng.choice(kinds)
        yield "".join(rng.choice(kind) for _ in range(rng.randrange(1, 120)))


def test_ids_and_texts_are_the_librarys(library):
    own = bpe.load(PATH)
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_any_ids_decode_as_the_library_does(library):
    rng, own = random.Random(4), bpe.load(PATH)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(50257), rng.randrange(256), 60_000]) for _ in range(rng.randrange(12))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_rank_files(name):
    import public_tokenizers as P
    import tiktoken

    with open(P.path(name), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library, own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.load(P.path(name))
    for text in odd_texts():
        if not bpe._ODD.search(text):  # its Unicode table is another one
            assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_other_tokenizers_are_refused():
    import public_tokenizers as P

    with pytest.raises(ValueError):
        bpe.Bpe(P.path("word_bpe_49k.json"))


def test_forgetting_pieces_changes_nothing(monkeypatch):
    text = " ".join(f"word{i % 37}" for i in range(500))
    whole = bpe.Bpe(PATH).encode(text).tolist()
    monkeypatch.setattr(bpe, "_MOST_KNOWN", 5)
    assert bpe.Bpe(PATH).encode(text).tolist() == whole


def test_hard_rows(spark, hard, hard_rows, none, library):
    there = bpe.decode(bpe.encode(hard, PATH), PATH)
    assert set(there.columns) == {*hard.columns, "ids", "decoded"}
    got = Counter((r.doc_id, r.text, r.tag, tuple(r.ids), r.decoded) for r in there.collect())
    assert got == Counter((x[0], x[1], x[8], tuple(library.encode(x[1] or "", add_special_tokens=False).ids), x[1] or "") for x in hard_rows)
    assert bpe.decode(bpe.encode(none, PATH), PATH).isEmpty()
    clash = bpe.encode(hard.withColumnRenamed("slot", "ids").withColumnRenamed("k", "decoded"), PATH)
    assert sorted(bpe.decode(clash, PATH).columns) == sorted({*hard.columns, "ids", "decoded"} - {"slot", "k"})
    assert [r.decoded for r in bpe.decode(spark.createDataFrame([(None,), ([None, 72, 99999999],)], "ids array<int>"), PATH).collect()] == ["", "i"]


def test_query_is_the_librarys(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = bpe.query(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
