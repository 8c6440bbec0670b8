from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from rangeweave.llm import substrings as ss

from .helpers import by_id, documents, noise, saved, words


def brute(rows):
    """(n_words, n_removed, kept words) of each (doc_id, text)."""
    starts = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - 12):
            key = tuple(w[a : a + 13])
            starts[key] = min(starts.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for a in range(len(w) - 12):
            if starts[tuple(w[a : a + 13])] < i:
                gone.update(range(a, a + 13))
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_query_equals_brute_force(spark, tmp_path):
    texts = noise(7, 160)
    got = by_id(ss.op3_substrings(spark, saved(documents(spark, texts), tmp_path)))
    for i, (n, gone, kept) in enumerate(brute(list(enumerate(texts)))):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
    assert sum(r.n_removed for r in got.values()) > 1000


def test_text_keeps_its_columns(spark):
    long = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, long, "x", 1), (2, f"before\n{long} after", "y", 2), (3, "  odd   spacing ", "z", 3), (4, None, None, None)], "doc_id long, text string, places string, tie int")
    got = {r.doc_id: r for r in ss.without_repeats(docs).collect()}
    assert got[1].text == long and got[2].text == "before after" and got[3].text == "  odd   spacing " and got[4].text is None
    assert (got[2].places, got[2].tie) == ("y", 2)


def test_nulls_repeats_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(5, long), (5, long), (5, "x " + long), (None, long), (9, long), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in ss.without_repeats(docs, digests=True).collect())
    assert got == sorted([("5", 20, 0), ("5", 20, 0), ("5", 21, 0), ("None", 20, 0), ("9", 20, 20), ("None", 0, 0)])
    assert ss.without_repeats(docs.limit(0), digests=True).count() == 0


def test_index_is_incremental(spark):
    texts = noise(11, 90)
    docs = documents(spark, texts).select("doc_id", "text")
    index, found = ss.FingerprintIndex(spark, fan=3), {}
    for low, high in ((0, 30), (30, 60), (60, 1000)):
        for r in index.add(docs.filter(F.col("doc_id").between(low, high - 1))).collect():
            found[r.doc_id] = r.places
        assert len(index.runs) in (1, 2)
    assert len(index.runs) == 1
    run = spark.table(index.runs[0][0])
    assert run.groupBy("anchor").count().filter("count > 1").isEmpty()
    index.close()
    for i, (_, gone, _) in enumerate(brute(list(enumerate(texts)))):
        covered = {p + k for p in found.get(i, []) for k in range(13)}
        assert len(covered) == gone


def test_an_earlier_batch_wins_whatever_the_ids(spark):
    long = " ".join(f"w{i}" for i in range(15))
    index = ss.FingerprintIndex(spark)
    assert index.add(spark.createDataFrame([(10, long)], "doc_id long, text string")).count() == 0
    assert [r.doc_id for r in index.add(spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")).collect()] == [1]
    index.close()


def test_runs_join_without_a_shuffle(spark):
    index = ss.FingerprintIndex(spark, fan=9)
    docs = documents(spark, noise(2, 30)).select("doc_id", "text")
    index.add(docs.filter("doc_id < 20"))
    index.add(docs.filter("doc_id >= 20"))
    new, old = (spark.table(n) for n, _ in index.runs)
    plan = new.select("anchor").join(old.select("anchor").hint("merge"), "anchor", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.close()


def test_index_goes_on_in_another_job(spark):
    texts = noise(23, 90)
    docs = documents(spark, texts).select("doc_id", "text")
    index, found = ss.FingerprintIndex(spark, fan=2), {}
    for low, high in ((0, 25), (25, 50)):
        found |= {r.doc_id: r.places for r in index.add(docs.filter(F.col("doc_id").between(low, high - 1))).collect()}
    assert len(index.runs) == 1  # compacted, and read again from here on
    again = ss.FingerprintIndex.open(spark, index.manifest(), docs.filter("doc_id < 50"))
    found |= {r.doc_id: r.places for r in again.add(docs.filter("doc_id >= 50")).collect()}
    for i, (_, gone, _) in enumerate(brute(list(enumerate(texts)))):
        assert len({p + k for p in found.get(i, []) for k in range(13)}) == gone
    again.close()


def test_words_have_two_hashes_of_their_bytes():
    t = ss.Texts(ss.pa.array(["a b ab ba " + "x" * 100 + " " + "y" * 100, "a", ""]))
    one, two = t.word_hashes(), t.other_hashes()
    assert len(set(one.tolist())) == len(set(two.tolist())) == 6 and one[0] == one[6] and two[0] == two[6]


def test_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(200_000))  # over a slice's bytes
    docs = spark.createDataFrame([(1, long), (2, "before " + long)], "doc_id long, text string")
    got = by_id(ss.without_repeats(docs, digests=True))
    assert (got[1].n_removed, got[2].n_words, got[2].n_removed) == (0, 200_001, 200_000)
