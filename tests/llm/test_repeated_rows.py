"""Many rows of one doc_id or none, and equal rows, against brute force."""

from __future__ import annotations

from collections import Counter

from skein.llm import lines, neardup, substrings
from tests.llm.test_llm_brute import lines_by_brute_force, passages_by_brute_force


def test_equal_rows_that_share_a_hot_line(spark):
    hot = "a line that more than three documents hold"
    rows = [(1, f"{hot}\nown"), (1, f"{hot}\nown"), (1, f"{hot}\nown"), (2, hot), (3, hot), (None, hot), (None, hot)]
    marked = lines.line_keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, lines.kept_text(r.text.encode(), r.n_lines, r.n_dropped, r.keep_bitmap).decode()) for r in marked)
    assert got == lines_by_brute_force(rows)
    assert got[1, 2, 1, "own"] == 3


def test_many_texts_of_one_id_keep_their_own_lines(spark):
    hot = "a line that more than three documents hold"
    rows = [(i, hot) for i in range(4)]
    for i in range(3000):  # some 69 pairs of them have the same 16 bits of hash
        own = [f"the own line of row {i}, number {j}" for j in range(1 + i % 3)]
        own.insert(i % (len(own) + 1), hot)
        rows.append((None if i % 2 else 0, "\n".join(own)))
    marked = lines.line_keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, lines.kept_text(r.text.encode(), r.n_lines, r.n_dropped, r.keep_bitmap).decode()) for r in marked)
    assert got == lines_by_brute_force(rows)


def test_many_texts_of_one_id_keep_their_own_words(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(1, passage)]
    for i in range(3000):
        own = [f"r{i}w{j}" for j in range(i % 7)]
        rows.append((2, " ".join([*own, passage] if i % 2 else [passage, *own, f"r{i}"])))
    got = substrings.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert Counter(tuple(r) for r in got) == passages_by_brute_force(rows)


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, prose(k)) for k in range(40)] + [(None, prose(3)), (None, prose(90)), (None, prose(90)), (2, prose(90) + " tail"), (None, prose(91)), (7, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.class_id) for r in neardup.near_duplicate_classes(docs).collect())
    alone = [k for k in got if k[0] is None and k[1] < 0]
    assert got[1, 1] == 40 and got[None, 1] == 1 and got[2, 2] == 1 and got[None, 2] == 2 and got[7, 7] == 1 and got[None, 7] == 1 and len(alone) == 1
    kept = Counter(tuple(r) for r in neardup.keep_one(docs, ["doc_id", "text"]).collect())
    assert kept == Counter([(1, prose(k)) for k in range(40)] + [(2, prose(90) + " tail"), (None, prose(91)), (7, None)])


def test_many_exact_copies_and_a_hot_text(spark):
    rows = [(i, "the same words in every one of these documents") for i in range(4000)] + [(i, f"document {i} has words of its own") for i in range(4000, 6000)]
    got = neardup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert len(got) == 6000 and all(r.class_id == (0 if r.doc_id < 4000 else r.doc_id) for r in got)
