"""Operators against brute force on small tables, edge cases among them."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import audio, common, licenses, lines, mixing, neardup, packing, quality, quotes, substrings, topk

SPACE = " \t\n\x0b\x0c\r"
split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


def bag(df):
    return Counter(tuple(r) for r in df.collect())


# Hashing

def test_word_hashes_follow_words():
    a = common.word_hashes(b"  one two\tone\n")
    assert len(a) == 3 and a[0] == a[2] != a[1]
    long = ("word " * 200_000 + "y" * 600_000 + " end").encode()
    h = common.word_hashes(long)
    assert len(h) == 200_002 and len(set(h.tolist())) == 3
    assert common.word_hashes(b"") .size == 0


def test_rolling_is_the_same_everywhere():
    w = common.word_hashes(" ".join(f"w{i % 91}" for i in range(600_000)).encode())
    r = common.rolling(w, 50)
    assert len(r) == len(w) - 49 and (r[:91 * 1000] == r[91:91 * 1001]).all() and len(set(r[:91].tolist())) == 91
    assert len(common.rolling(w[:49], 50)) == 0


# 1

def test_quality_learns_and_holds_out(spark, sf_dir):
    out = quality.query(spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert len(out) == docs and out.score.between(0, 1).all()
    assert (out.predicted == (out.score >= 0.7)).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    both = labels.merge(out, on="doc_id")
    assert (both[both.held_out].quality == both[both.held_out].predicted).mean() >= 0.85


def test_quality_ignores_held_out_labels_and_other_columns(spark, hard, none):
    rows = [(i, "good plain words here" if i % 2 else "JUNK!! JUNK!! $$$") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wrong = spark.createDataFrame([(i, int(i % 2 == 1) ^ int(zlib.crc32(str(i).encode()) % 4 == 2)) for i, _ in rows], "doc_id long, quality int")
    model = quality.fit(docs, wrong)
    for r in quality.score(docs, model).collect():
        assert (r.score >= 0.5) == (r.doc_id % 2 == 1)
    scored = quality.score(hard, model)
    assert scored.count() == hard.count() and set(scored.columns) == {*hard.columns, "score"}
    assert scored.where("score is null or score < 0 or score > 1").isEmpty()
    assert scored.groupBy("text").agg(F.count_distinct("score").alias("n")).where("n > 1").isEmpty()
    assert quality.score(none, model).isEmpty()
    unlabelled = quality.fit(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    assert {round(r.score, 1) for r in quality.score(docs, unlabelled).collect()} == {0.5}


# 2

def classes_by_brute_force(rows):
    """rows: (id, text), ids unique."""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = []
    for i, t in rows:
        w = split(t)
        sets.append((i, tuple(w), {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()))
    for n, (i, wi, si) in enumerate(sets):
        for j, wj, sj in sets[:n]:
            if wi == wj or (si and sj and len(si & sj) >= 0.8 * len(si | sj)):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def test_near_duplicates_as_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.class_id for r in neardup.query(spark, sf_dir).collect()}
    assert got == classes_by_brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_near_duplicate_groups_around_the_threshold(spark):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(160):  # one family, with links, near misses and chains
        own = list(base)
        for at in rng.choice(150, int(rng.integers(0, 14)), replace=False):
            own[at] = f"r{i}x{at}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(docs).collect()} == classes_by_brute_force(rows)


def test_near_duplicates_of_hard_rows(hard, none):
    got = neardup.near_duplicate_classes(hard).collect()
    assert len(got) == hard.count()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.class_id)
    assert by[1] == by[2] == by[3] == {1}
    assert by[4] == by[5] == by[6] == {4}
    assert by[13] == {13} and by[10] == {10}
    assert neardup.near_duplicate_classes(none).isEmpty()
    assert neardup.keep_one(hard, ["doc_id", "text"]).where("doc_id in (2, 3, 5, 6)").isEmpty()


@pytest.mark.parametrize("weigh", [False, True])
def test_dart_minhash_estimates_jaccard(weigh):
    rng = np.random.default_rng(1)
    x, y = np.arange(300, dtype=np.uint64), np.arange(100, 400, dtype=np.uint64)
    wx, wy = (rng.uniform(0.2, 3, 400), rng.uniform(0.2, 3, 400)) if weigh else (np.ones(400), np.ones(400))
    a, b = np.where(np.arange(400) < 300, wx, 0), np.where(np.arange(400) >= 100, wy, 0)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    spread = common.mix(np.arange(400, dtype=np.uint64))
    k = 4096
    one = neardup.dart_minhash(spread[x], wx[:300] if weigh else None, k)
    two = neardup.dart_minhash(spread[y], wy[100:] if weigh else None, k)
    assert abs((one == two).mean() - want) < 0.03
    assert (one == neardup.dart_minhash(spread[x][::-1], wx[:300][::-1] if weigh else None, k)).all()
    whole = neardup.dart_minhash(spread[x], np.ones(300), 256)
    assert (whole == neardup.dart_minhash(spread[x], None, 256)).all()


# 3

def test_audio_round_trip(hard, none):
    media = audio.as_media(hard.select("doc_id", "text"))
    out = audio.audio_features(media, ["doc_id", "n_bytes"])
    want = Counter()
    for r in hard.select("doc_id", "text").collect():
        data = (r.text or "").encode()
        full = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        want[r.doc_id, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), len(full) + 44] += 1
    assert bag(out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes")) == want
    for r in out.collect():
        table = audio.read_tensors(r.tensors)
        assert table.column("log_mel").type.shape == [audio.TENSOR_FRAMES, audio.MELS]
        assert sum(table.column("frames").to_pylist()) == r.n_frames
        assert all(a < b for a, b in zip(table.column("start_s").to_pylist(), table.column("end_s").to_pylist()))
    assert out.groupBy("media_sha256").agg(F.count_distinct("tensors").alias("n")).where("n > 1").isEmpty()
    assert audio.audio_features(audio.as_media(none), ["doc_id"]).isEmpty()


def test_resampling_keeps_tones():
    t = np.arange(16_000) / 16_000
    tone = np.round(128 + 100 * np.sin(2 * np.pi * 440 * t)).astype(np.uint8)
    for up, down in ((1, 2), (2, 3), (3, 2)):
        n = 16_000 * up // down
        y = audio.resample(tone, 0, n, up, down)
        peak = np.argmax(np.abs(np.fft.rfft(y))) * (16_000 * up / down) / n
        assert abs(peak - 440) < 2 and abs(np.abs(y).max() - 100 / 128) < 0.08
        assert np.allclose(y[1000:1200], audio.resample(tone, 1000, 200, up, down), atol=1e-6)
    high = np.round(128 + 100 * np.sin(2 * np.pi * 7000 * t)).astype(np.uint8)
    assert np.abs(audio.resample(high, 0, 8000, 1, 2)[200:-200]).max() < 0.05


def test_segments_have_hysteresis():
    energy = np.array([-60] * 20 + [-50] * 5 + [-56] * 5 + [-60] * 20 + [-56] * 5 + [-60] * 5, float)
    found = audio.segments(energy)
    assert len(found) == 1 and abs(found[0][0] - 20 * audio.HOP / audio.RATE_OUT) < 1e-9
    assert abs(found[0][1] - (29 * audio.HOP + audio.WINDOW) / audio.RATE_OUT) < 1e-9


# 4

def test_mix_meets_budgets(hard, none):
    rows = mixing.mix_sources(hard).collect()
    assert len(rows) == hard.count()
    sources = defaultdict(list)
    for r in rows:
        sources[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    total = sum(r.size for r in rows)
    assert sum(own[0].target for own in sources.values()) == pytest.approx(total)
    for own in sources.values():
        size = sum(r.size for r in own)
        assert {r.source_size for r in own} == {size} and own[0].target <= 3 * size + 1e-9
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5
        epochs = {r.taken // r.size for r in own if r.size}
        assert not epochs or max(epochs) - min(epochs) <= 1
    assert bag(mixing.mix_sources(hard)) == bag(mixing.mix_sources(hard.repartition(7)))
    assert mixing.mix_sources(none).isEmpty()


def test_repeat_taken_has_the_words(hard):
    words = hard.select("doc_id", "text", "source", "n_chars")
    took = Counter()
    for r in mixing.mix_sources(words).collect():
        took[r.source] += r.taken
    got = Counter()
    for r in mixing.repeat_taken(words, words.columns).collect():
        got[r.source] += len(split(r.text))
        assert r.n_chars == len(r.text)
    assert +got == +took


# 5

def test_top_k_as_brute_force(spark):
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(size=(700, 6)), 1)
    v[100:400] = v[100]  # a very common vector, so ties decide
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (950, [1.0, None]), (1000, [float("nan")] * 6), (None, [0.0] * 6), (1050, [1.0, 2.0]), (1100, [3.0, 4.0]), (1150, [9e4] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.floored(F.col("embedding")).alias("v"))
    fine = [(i, np.floor(256 * np.array(e)).astype(int)) for i, e in rows if i is not None and e is not None and None not in e and np.isfinite(e).all()]
    want = set()
    for i, a in fine:
        if i % 50 == 0:
            best = sorted((-int(a @ b), j) for j, b in fine if j != i and len(a) == len(b))[:5]
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    got = topk.exact_top_k(df.where("vec_id % 50 = 0"), df)
    assert {tuple(r) for r in got.collect()} == want
    assert topk.exact_top_k(df.where("false"), df).isEmpty() and topk.exact_top_k(df, df.where("false")).isEmpty()


# 6

def lines_by_brute_force(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(SPACE))
    low = lambda i: -1 if i is None else i
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(low(i))
    out = Counter()
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (len(held.get(key(x), ())) >= 3 and max(held[key(x)]) != low(i))]
        out[i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_lines_as_brute_force(hard, none):
    rows = [(r.doc_id, r.text) for r in hard.select("doc_id", "text").collect()]
    marked = lines.line_keep_bitmaps(hard).collect()
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, lines.kept_text(r.text.encode(), r.n_lines, r.n_dropped, r.keep_bitmap).decode()) for r in marked)
    assert got == lines_by_brute_force(rows)
    assert sum(r.n_dropped for r in marked) > 2
    assert lines.line_keep_bitmaps(none).isEmpty()
    kept = lines.drop_lines(hard, ["doc_id", "text", "lang", "source", "n_chars"])
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == hard.count()


def test_a_hot_line_over_many_partitions(spark):
    rows = [(i, "a line that everyone has in common\n" + (f"the own line of document {i}" if i % 3 else "another that a third has")) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(11)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = lines.line_keep_bitmaps(df).where("n_dropped > 0").select("doc_id", "n_dropped").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {i: (i != 899) + (i % 3 == 0 and i != 897) for i in range(900)}
    assert {r.doc_id: r.n_dropped for r in got} == {i: n for i, n in want.items() if n}


# 7

def test_packing_as_the_tokenizer(hard, none):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(hard, path, with_ids=True).collect()
    docs = defaultdict(list)
    for r in hard.select("doc_id", "text").collect():
        docs[r.doc_id].append(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0])
    pieces = defaultdict(list)
    for r in rows:
        assert r.offset == 0 and r.length == len(r.ids) <= 1024 and r.length & (r.length - 1) == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert 1 << (r.sequence_id % 16) == r.length
        pieces[r.doc_id].append(r)
    assert len({r.sequence_id for r in rows}) == len(rows)
    for doc_id, texts in docs.items():
        own = Counter((r.start, r.length, tuple(r.ids), r.doc_tokens) for r in pieces[doc_id])
        want = Counter((s, n, tuple(t[s : s + n]), len(t)) for t in texts for s, n in packing.binary_pieces(len(t)))
        assert own == want
    assert packing.pack(none, path).isEmpty()
    assert bag(packing.pack(hard, path)) == bag(packing.pack(hard.repartition(5), path))


def test_binary_pieces_cover_every_length():
    for n in range(1, 3000):
        cut = packing.binary_pieces(n)
        assert cut[0][0] == 0 and sum(size for _, size in cut) == n
        assert all(a + s == b for (a, s), (b, _) in zip(cut, cut[1:]))


def test_tokens_of_odd_texts():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    odd = ["", " ", "a  b", " a", "a ", "a\nb", "a\n\nb", "a \nb", "\n", "a\tb", "it's 3rd 've 's", "x!'s", "<|endoftext|>", "a<|endoftext|> b", "é ñ ß", "日本 語", "😀 x", "a b", "a b", "a\r\nb"]
    for got, text in zip(packing.token_bytes(odd, path), odd):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


# 8

def passages_by_brute_force(rows, width=50):
    low = lambda i: -1 if i is None else i
    first = {}
    for i, t in rows:
        w = split(t)
        for j in range(len(w) - width + 1):
            g = tuple(w[j : j + width])
            first[g] = min(first.get(g, low(i)), low(i))
    out = Counter()
    for i, t in rows:
        w = split(t)
        gone = set()
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < low(i):
                gone.update(range(j, j + width))
        out[i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    return out


@pytest.mark.parametrize("bits", [29, 11])
def test_passages_as_brute_force(hard, none, bits):
    small = hard.where("length(text) < 100000 or text is null")  # brute force is slow on the longest
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    got = substrings.remove_repeated_passages(small, most_bits=bits)
    assert bag(got.select("doc_id", "n_words", "n_removed", "kept")) == passages_by_brute_force(rows)
    assert substrings.remove_repeated_passages(none, most_bits=bits).isEmpty()
    assert substrings.remove_repeated_passages(hard, most_bits=bits).count() == hard.count()


# 9

def licenses_by_brute_force(rows):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    out = Counter()
    for i, t in rows:
        w = word.findall(low(t))
        places = [(j, label) for p, label in licenses.PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        met = {}
        for text, label, must in licenses.TEMPLATES:
            tokens = set(text.split())
            for at in range(len(w)):
                own = set(w[at : at + (3 * len(tokens) + 1) // 2])
                part = len(tokens & own) / len(tokens)
                if part >= 0.8 - 1e-9 and set(must.split()) <= own:
                    met[label] = max(part, met.get(label, 0))
        base = {x for _, x in places}
        starts = [j for j, _ in places]
        out[i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | met.keys())), 1.0 if places else max(met.values(), default=0.0)] += 1
    return out


def test_licenses_as_brute_force(spark, hard, none, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(hard.select("doc_id", "text"))
    docs = docs.where("length(text) < 100000 or text is null")  # brute force is slow on the longest
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert bag(licenses.scan_licenses(docs)) == licenses_by_brute_force(rows)
    assert licenses.scan_licenses(none).isEmpty() and licenses.scan_licenses(hard).count() == hard.count()


WRAPPED = [
    (1, "Some words.\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files", "mit-notice"),
    (2, "Released under the Apache License", ""), (3, "The album was released under a license from the label", ""),
    (4, "Licensed under CC BY 4.0", ""), (5, "This work is licensed under the GNU General Public License, version 2", ""),
    (6, "this work is\nlicensed under the\nGNU General Public\nLicense version 3", "gpl-3"), (7, "licensed under CC BY NC 4 0", "cc-by-nc"),
]


def test_wrapped_licenses_and_near_misses(spark):
    df = spark.createDataFrame([x[:2] for x in WRAPPED], "doc_id long, text string")
    got = {r.doc_id: ",".join(sorted(set(r.labels.split(",")) - set(r.base_labels.split(",")))) for r in licenses.scan_licenses(df).collect()}
    assert got == {i: label for i, _, label in WRAPPED}


def test_filters_lose_no_template():
    rng = np.random.default_rng(2)
    templates = []
    for i in range(30):
        tokens = [f"t{x}" for x in rng.choice(40, rng.integers(1, 12), replace=False)]
        templates.append((" ".join(tokens), f"l{i}", tokens[0]))
    order = {f"t{x}".encode(): i for i, x in enumerate(rng.permutation(40))}
    for limit in (0.5, 0.8, 1.0):
        index = licenses.TemplateIndex(templates, order, limit)
        for _ in range(300):
            words = [f"t{x}" for x in rng.choice(60, rng.integers(0, 40))]
            want = {}
            for text, label, must in templates:
                tokens = set(text.split())
                for at in range(len(words)):
                    own = set(words[at : at + licenses.block_length(len(tokens))])
                    if len(own & tokens) >= limit * len(tokens) - 1e-9 and must in own:
                        want[label] = max(want.get(label, 0), len(own & tokens) / len(tokens))
            coded = [w.encode() for w in words]
            assert index.matches(coded, set(coded)) == want


# 10

QUOTED = [
    (1, 0, "user", "Shall we meet on Monday?\nOr rather later"),
    (1, 1, "assistant", "> Shall we  MEET on monday?\nMonday is fine"),
    (1, 2, "user", "> > Shall we meet on Monday?\n> Monday is fine\nGood.\n>unknown words"),
    (1, 3, "user", ">\nOr rather later"),
    (2, 5, "user", "> Shall we meet on Monday?\nanother conversation"),
    (2, 6, "user", None), (2, 7, None, ""), (None, 1, "user", "> x"), (3, None, "user", "y"),
    (2, 6, "user", "> another conversation\ntwice"),
]


def test_quotations(spark):
    df = spark.createDataFrame([(*r, "x") for r in QUOTED], "conv_id long, turn long, role string, text string, level string")
    got = {(r.conv_id, r.turn, r.text): (r.n_quoted, r.n_linked, r.reply_to, r.thread_turn, r.depth) for r in quotes.link_quotations(df).collect()}
    assert got[1, 1, "Monday is fine"] == (1, 1, 0, 0, 1)
    assert got[1, 2, "Good."] == (3, 2, 1, 0, 2)
    assert got[1, 3, "Or rather later"] == (1, 0, None, 3, 0)
    assert got[2, 5, "another conversation"] == (1, 0, None, 5, 0)
    assert got[2, 6, "twice"] == (1, 1, 5, 5, 1)
    assert got[None, 1, ""] == (1, 0, None, 1, 0) and got[3, None, "y"] == (0, 0, None, None, 0)
    assert len(got) == len(QUOTED)
    assert quotes.link_quotations(df.where("false")).isEmpty()


def test_long_threads(spark):
    rows = [(7, i, "user", f"> say {i - 1}\nsay {i}") for i in range(70)]
    got = quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: (r.thread_turn, r.depth) for r in got} == {i: (0, i) for i in range(70)}


def test_wrapped_passages_and_single_lines(spark):
    rows = [
        (1, 0, "a", "The first paragraph\nruns over two lines\n\nand a second one"),
        (1, 1, "b", "> The first\n> paragraph runs\n> over two lines\nanswer"),
        (1, 2, "a", "> runs over two lines\n> no such line\n> and a second one\n>> answer\nwell"),
    ]
    got = {r.turn: (r.n_quoted, r.n_linked, r.reply_to) for r in quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (0, 0, None), 1: (3, 3, 0), 2: (4, 3, 0)}


def _quotes_by_sql(df):
    import duckdb

    con = duckdb.connect()
    con.register("given", df.toPandas())
    con.sql("CREATE TABLE conversations AS SELECT CAST(conv_id AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, text FROM given")
    return con.sql(quotes.SQL).df()


def test_random_quotes_as_sql(spark, same_rows):
    rng = np.random.default_rng(4)
    rows, said = [], {}
    for conv in range(12):
        for turn in range(30):
            own = ["\n".join(f"say {rng.integers(60)}" for _ in range(rng.integers(1, 4))) for _ in range(rng.integers(1, 3))]
            quoted = []
            for text in rng.choice(said.get(conv, ["nothing"]), rng.integers(0, 3)):
                mark = ">" * int(rng.integers(1, 4)) + " " * int(rng.integers(0, 2))
                lines = text.upper().split("\n") if rng.random() < 0.7 else text.replace("\n", " ").split("\n")
                quoted += [mark + x for x in (lines if rng.random() < 0.7 else lines[:1] + ["something else"])]
            said.setdefault(conv, []).extend(own)
            rows += [(conv, turn, "user", "\n".join([*quoted, "\n\n".join(own)]))] * (2 if rng.random() < 0.1 else 1)
    rows += [(None, 1, "user", "> x"), (5, None, "user", "> say 1"), (5, 50, None, None), (None, None, None, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotes.link_quotations(df.repartition(3)).toPandas()
    assert (got.n_linked > 0).sum() > 100 and got.depth.max() >= 3
    same_rows(got, _quotes_by_sql(df))


def test_blank_lines_of_all_kinds_as_sql(spark, same_rows):
    rng = np.random.default_rng(9)
    plain = ["", " ", "\t", "\r", " \f\v", "a b", " A  b ", "\tc\r", "c", "1 < 2", "d"]
    rows = []
    for conv in range(20):
        for turn in range(12):
            lines = plain if rng.random() < 0.5 else [*plain, "> a b", ">c", "> ", ">> d", " > > a B\r", "x > y"]
            rows.append((conv, turn, "user", "\n".join(rng.choice(lines, rng.integers(0, 9)))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotes.link_quotations(df.repartition(3)).toPandas()
    assert (got.n_linked > 0).sum() > 30
    same_rows(got, _quotes_by_sql(df))


def test_top_k_of_large_components_and_repeated_ids(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** int(rng.integers(0, 12))]) for i in range(120)]
    rows += [(50, [1e8, 1.0, 0.0]), (50, [1e8, 1.0, 0.0]), (7, [3.0, 2.0, 1.0]), (8, [2.0**60, 0.0, 0.0]), (150, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").select("vec_id", "score", topk.floored(F.col("embedding")).alias("v"))
    edge = lambda x: max(-(2**63), min(2**63 - 1, x))
    fine = [(i, [max(-(2**63), min(2**63 - 1024, math.floor(256 * x))) for x in e]) for i, e in rows]
    want = Counter()
    for i, a in {(i, tuple(a)) for i, a in fine if i % 50 == 0}:
        best = sorted((-edge(sum(x * y for x, y in zip(a, b))), j) for j, b in fine if j != i and len(a) == len(b))[:5]
        want.update((i, n + 1, j, -s) for n, (s, j) in enumerate(best))
    assert bag(topk.exact_top_k(df.where("vec_id % 50 = 0"), df)) == want


def test_tokens_of_other_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.Encoder(path).fast is None and packing.Encoder(packing.default_tokenizer()).fast
    for got, text in zip(packing.token_bytes(["Some words, it's 3rd", "", "x" * 500], path), ["Some words, it's 3rd", "", "x" * 500]):
        assert np.frombuffer(got, "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_scores_as_plain_python():
    rng = np.random.default_rng(2)
    model = (np.round(rng.normal(size=quality._END + 1) * quality._UNIT), 0.25)
    mask = (1 << 64) - 1

    def mixed(x):
        for _ in range(2):
            x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & mask
        return x ^ (x >> 32)

    def plain(text):
        words = split(text)
        hashes = [int(h) for h in common.word_hashes(text.encode())]
        ids = [h >> 47 for h in hashes] + [(mixed((b - a) & mask) >> 47) + quality._PART for a, b in zip(hashes, hashes[1:])] + [quality._END]
        for w in words:
            c = [32, *map(ord, w), 32]
            for x, y, z in zip(c, c[1:], c[2:]):
                h = (x * 0x9E3779B1 + y * 0x85EBCA6B + z * 0xC2B2AE35) & 0xFFFFFFFF
                h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
                ids.append((h >> 15) + 2 * quality._PART)
        return 1 / (1 + math.exp(-(sum(model[0][i] for i in ids) / quality._UNIT / len(ids) + model[1])))

    texts = ["", " \n", "one", "one one one two", "naïve ’quote’ 日本 語", "a b", "long " * 300_000 + "end"]
    assert quality.scores([t.encode() for t in texts], model) == pytest.approx([plain(t) for t in texts], rel=1e-12)


def test_log_mel_as_a_direct_transform():
    rng = np.random.default_rng(6)
    samples = rng.integers(0, 256, 1600).astype(np.uint8)
    up, down, taps = 1, 2, audio.TAPS * 2
    t = np.arange(-taps, taps + 1)
    h = np.sinc(t / 2) * np.hanning(len(t) + 2)[1:-1]
    x = (samples.astype(float) - 128) / 128
    y = np.convolve(x, h / h.sum())[taps : taps + len(x)][::2]
    assert np.allclose(audio.resample(samples, 0, 800, up, down), y, atol=1e-5)
    mel, energy = audio.log_mel(samples, audio.RATE_IN)
    y = np.append(y, np.convolve(np.append(x, np.zeros(600)), h / h.sum())[taps:][::2][800:1100])
    k, n = np.arange(audio.WINDOW // 2 + 1)[:, None], np.arange(audio.WINDOW)[None]
    dft = np.exp(-2j * np.pi * k * n / audio.WINDOW)
    for i in range(len(mel)):
        frame = y[i * audio.HOP : i * audio.HOP + audio.WINDOW]
        power = np.abs(dft @ (frame * np.hanning(audio.WINDOW))) ** 2
        assert np.allclose(mel[i], np.log(power @ audio._mel_bank(audio.RATE_OUT, audio.WINDOW, audio.MELS) + 1e-6), atol=5e-3)
        assert abs(energy[i] - 10 * np.log10(np.mean(frame**2) + 1e-10)) < 5e-3


def test_payloads_with_the_operators_own_names(spark):
    rows = [(i, "a line that everyone has in common\nown", "s", 5, "k", 2, "p") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, key string, n_lines long, _doc string")
    names = docs.columns
    assert {(r["size"], r["key"], r["n_lines"], r["_doc"]) for r in mixing.repeat_taken(docs, names).collect()} == {(5, "k", 2, "p")}
    assert {(r["size"], r["key"], r["n_lines"], r["_doc"]) for r in lines.drop_lines(docs, names).collect()} == {(5, "k", 2, "p")}
    assert mixing.mix_sources(docs, ["key", "size"]).columns == ["doc_id", "source", "key", "size", "source_size", "target", "taken"]
    assert lines.line_keep_bitmaps(docs, ["_doc", "n_lines"]).columns == ["doc_id", "_doc", "text", "n_lines", "n_dropped", "keep_bitmap"]
