from __future__ import annotations

import collections
import zlib

import numpy as np
import pyarrow as pa

from rangeweave.llm import quality_classifier as qc
from rangeweave.llm import quality_rules as qr
from rangeweave.llm._text import Texts, chunks

from .helpers import by_id, documents, noise, saved, words


def brute(text):
    text = text or ""
    w = words(text)
    wins = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_ledger_equals_brute_force(spark, tmp_path):
    texts = noise(3, 120, vocabulary=6)
    got = by_id(qr.op9_quality_rules(spark, saved(documents(spark, texts), tmp_path)))
    for i, t in enumerate(texts):
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_policies_and_ablation(spark):
    good = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, good), (2, "short"), (3, " ".join(["aa#", "b*b", "c$c"] * 30)), (4, None), (5, good + " 1"), (5, good + " 1")], "doc_id long, text string")
    rows = qr.ledger(docs)
    bits = {r.doc_id: r.failed for r in rows.collect()}
    assert bits[1] == 0 and bits[2] == qr.BIT["too_few_words"] and bits[3] & qr.BIT["symbols"] and bits[3] & qr.BIT["repeated_windows"]
    got = {r.rule: (r.failing, r.only_this) for r in qr.ablation(rows).collect()}
    assert got["too_few_words"] == (2, 2) and got["symbols"] == (1, 0)
    assert sorted(r.doc_id for r in qr.rejecting(docs).collect()) == [1, 5, 5]
    kept = {r.doc_id for r in rows.filter(qr.passes("v1")).collect()}
    assert kept == {1, 5}
    assert qr.ablation(rows.limit(0)).count() > 0 and qr.rejecting(docs.limit(0)).count() == 0


def test_rejecting_carries_clashing_columns(spark):
    docs = spark.createDataFrame([(" ".join(f"word{i}" for i in range(30)), 7, "x", [1])], "text string, n_words int, whole string, c0 array<int>")
    r = qr.rejecting(docs).first()
    assert (r.n_words, r.whole, r.c0) == (7, "x", [1])


def test_identity_equals_all_pairs():
    r = np.random.default_rng(0)
    model = qc.Machine.blank()
    model.bias, model.w, model.v = 0.1, r.normal(size=model.w.shape).astype(np.float32) / 9, r.normal(size=model.v.shape).astype(np.float32) / 9
    batch = next(chunks(pa.RecordBatch.from_arrays([pa.array([x or "" for x in noise(5, 8)][:14])], ["text"])))
    off, index, values, stats = qc.features(Texts(batch.column("text")))
    got = model.score(off, index, values, stats)
    x = np.zeros((len(off) - 1, len(model.w)))
    for d in range(len(off) - 1):
        x[d, index[off[d] : off[d + 1]]] = values[off[d] : off[d + 1]]
    x[:, qc.BUCKETS :] = model.standard(stats)
    for d, row in enumerate(x):
        on = np.flatnonzero(row)
        z = model.bias + row @ model.w + sum(model.v[i] @ model.v[j] * row[i] * row[j] for a, i in enumerate(on) for j in on[:a])
        assert abs(got[d] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-4


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = by_id(qc.op10_quality_classifier(spark, sf))
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(got[i].score, q) for i, q in labels.items() if got[i].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.9


def test_classifier_without_labels_or_rows(spark):
    docs = documents(spark, ["a b", None, "", "x" * 100])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in qc.with_scores(docs, qc.train(docs, none)).collect()} == {0.5}
    some = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (3, 0)], "doc_id long, quality int")
    model = qc.train(docs, some)
    assert qc.with_scores(docs, model).count() == 4 and qc.with_scores(docs.limit(0), model).count() == 0
