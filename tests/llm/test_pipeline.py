"""The pipeline against its stages by brute force."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from skein.llm import packing, quality

from .test_llm_brute import classes_by_brute_force, lines_by_brute_force, split


def test_every_stage(spark, sf_dir):
    from skein.llm.common import write_table

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "near-duplicates", "source mix", "packing"]
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = write_table(stage(spark, docs, sf_dir), "test")
        outs.append(docs)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    good, cut, unlike, mix, packed = outs
    scored = quality.query(spark, sf_dir).where("predicted = 1").select("doc_id")
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scored.collect()}
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert Counter((r.doc_id, r.text) for r in cut.collect()) == Counter({(k[0], k[3]): n for k, n in lines_by_brute_force(rows).items()})
    rows = [(r.doc_id, r.text) for r in cut.collect()]
    classes = classes_by_brute_force(rows)
    assert {r.doc_id for r in unlike.collect()} == set(classes.values())
    sizes = {r.doc_id: len(split(r.text)) for r in unlike.collect()}
    taken = Counter()
    for r in mix.collect():
        taken[r.doc_id] += len(split(r.text))
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), abs=len({r.source for r in unlike.collect()}))
    assert all(n <= 3 * sizes[i] for i, n in taken.items())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in mix.collect())
    assert sum(r.length for r in packed.collect()) == want
    ids = np.concatenate([r.ids for r in packed.collect()])
    assert (ids == 0).sum() >= mix.count()


def test_run_is_what_the_stages_give(spark, sf_dir):
    one = corpus_pipeline.run(spark, sf_dir).toPandas()
    two = corpus_pipeline.run(spark, sf_dir).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "sequence_id"]
    assert len(one) and sorted(map(tuple, one[key].values.tolist())) == sorted(map(tuple, two[key].values.tolist()))
