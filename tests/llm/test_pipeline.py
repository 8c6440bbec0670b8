from __future__ import annotations

import pyarrow as pa

import corpus_pipeline
from rangeweave.llm import mixing

from .helpers import documents, noise, saved, words
from .test_near_duplicates import brute as near
from .test_rules_and_classifier import brute as measured
from .test_substrings import brute as cut


def test_stages_equal_a_brute_force_pipeline(spark, tmp_path):
    texts = [t for t in noise(31, 120, vocabulary=400)]
    docs = documents(spark, texts)
    stage = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    kept = stage["quality_rules"](spark, docs, "").cache()
    ids = sorted(r.doc_id for r in kept.collect())
    assert kept.columns == columns and 0 < len(ids) < len(texts)
    base = {i for i, t in enumerate(texts) if measured(t)[0] < 20 or 100 * measured(t)[4] > 30 * measured(t)[0]}
    assert not base & set(ids)

    one = stage["near_duplicates"](spark, kept, "").cache()
    groups = near([texts[i] for i in ids])
    assert sorted(r.doc_id for r in one.collect()) == sorted(ids[i] for i, c in groups.items() if i == c) and one.columns == columns

    less = stage["substring_dedup"](spark, one, "").cache()
    rows = sorted((r.doc_id, r.text) for r in one.collect())
    want = {i: (t if not gone else text) for (i, t), (_, gone, text) in zip(rows, cut(rows)) if words(text)}
    assert {r.doc_id: r.text for r in less.collect()} == want and all(r.n_chars == len(r.text) for r in less.collect())

    mixed = stage["source_mixing"](spark, less, "")
    chosen = {r.doc_id for r in mixing.weighed(less).filter("mix_kept").collect()}
    assert {r.doc_id for r in mixed.collect()} == chosen and mixed.columns == columns

    done = corpus_pipeline.run(spark, saved(docs, tmp_path))
    assert {r.doc_id for r in done.select("doc_id", "matches_library").collect() if r.matches_library} == chosen
    assert done.columns[: len(columns)] == columns


def test_null_ids_and_empty_tables(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, good, "en", "s", 1), (1, good, "en", "s", 1), (None, good + " x", None, None, None), (2, None, None, None, None)], documents(spark, ["a"]).schema)
    got = corpus_pipeline.STAGES[1][1](spark, corpus_pipeline.STAGES[0][1](spark, docs, ""), "").collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "None"]
    assert corpus_pipeline.run(spark, saved(docs.limit(0), tmp_path)).count() == 0


def test_stages_send_few_texts_at_once(spark):
    kind, key = documents(spark, ["a"]).schema, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for name in ("quality_rules", "near_duplicates", "substring_dedup", "sentencepiece"):
            spark.conf.set(key, "10000")
            dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame([], kind), "")
            sizes = spark.range(0, 2500, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
            assert max(r.n for r in sizes) <= 1000 and sum(r.n for r in sizes) == 2500, name
    finally:
        spark.conf.set(key, before)
