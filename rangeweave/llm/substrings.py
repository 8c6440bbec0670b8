"""Substring dedup with a log-structured index of window hashes.

A window is ``WINDOW`` consecutive words of one document.  Its anchor is the least hash of the ``INNER``-word windows in it,
so equal windows have equal anchors and neighbouring windows mostly share one; about a quarter as many anchors as windows
need to be kept.  The index holds them in sorted immutable runs, bucketed tables of (anchor, least and greatest doc_id).

A new batch's anchors become a run.  It is merge-joined with the runs before it, bucket by bucket and without a shuffle,
which leaves the anchors that more than one document holds.  Windows under those anchors are then verified: every such
window of the batch, and of the earlier documents, is compared by a 96-bit fingerprint of its whole word sequence, 64 bits of
it from one hash of the words' bytes and 32 from another that shares nothing with it.  A bitmap of bounded size keeps other
windows out of that shuffle; it can pass too many, never too few.  Earlier texts are read again for that, but only windows
under a shared anchor are fingerprinted.  Runs are compacted into one when there are ``FAN`` of them, and later batches are
joined with the compacted run.  ``manifest`` and ``FingerprintIndex.open`` carry an index from one job to another.

A window of a batch goes if it also starts in an earlier batch, or in a document of the batch with a smaller doc_id; each
word that such a window covers is removed.  Windows are judged on the input.  Null and empty texts have no words.  Rows
with a null doc_id are neither indexed nor changed.  Rows that repeat a doc_id count as one document for the comparison and
are each cut by their own words.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import _bitmap
from ._store import drop_tables, free_shuffles, fresh, remove, written
from ._text import U64, Texts, chunks, mix, windows

WINDOW = 13
INNER = 7
EARLIER = -(2**63)  # stands for the documents of earlier batches
FAN = 2
BATCHES = 3


def _anchors(hashes: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window and the window's first word."""
    inner, at = windows(hashes, woff, INNER, seed=3)
    least = np.full(len(hashes) + WINDOW, ~U64(0), U64)
    least[at] = inner
    span = 1
    while span < WINDOW - INNER + 1:  # running minima over doubling spans
        step = min(span, WINDOW - INNER + 1 - span)
        least[:-step] = np.minimum(least[:-step], least[step:])
        span += step
    count = np.maximum(np.diff(woff) - WINDOW + 1, 0)
    first = np.repeat(woff[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return least[first], first


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, doc_id), once where consecutive windows share it."""
    for batch in batches:
        for part in chunks(batch):
            t = Texts(part.column("text"))
            anchor, first = _anchors(t.word_hashes(), t.woff)
            doc = t.doc_of_words()[first]
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64)), part.column("doc_id").take(pa.array(doc[new]))], ["anchor", "doc_id"])


def _suspects(bitmap: str):
    """(h1, h2, doc_id, tie, place) of the windows whose anchor may be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                t = Texts(part.column("text"))
                hashes = t.word_hashes()
                anchor, first = _anchors(hashes, t.woff)
                if not len(first):
                    continue
                new = np.ones(len(anchor), bool)
                new[1:] = anchor[1:] != anchor[:-1]
                first = first[_bitmap.test(bitmap, anchor[new])[np.cumsum(new) - 1]]
                sides = []
                for words, base, seed in ((hashes, 0xA0761D6478BD642F, 0), (t.other_hashes(), 0xE7037ED1A0B428DB, 9)):
                    own, h = mix(words, seed), np.zeros(len(first), U64)
                    for j in range(WINDOW):
                        h = h * U64(base) + own[first + j]
                    sides.append(mix(h, seed + 1))
                doc = t.doc_of_words()[first]
                pick = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sides[0].view(np.int64)), pa.array((sides[1] >> U64(32)).astype(np.uint32).view(np.int32)), part.column("doc_id").take(pick), part.column("tie").take(pick), pa.array((first - t.woff[doc]).astype(np.int32))],
                    ["h1", "h2", "doc_id", "tie", "place"],
                )

    return run


def _plain(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.filter("doc_id is not null").withColumn("tie", F.xxhash64("text"))


class FingerprintIndex:
    """``add`` takes the next batch of documents and returns the windows to remove from it."""

    def __init__(self, spark: SparkSession, fan: int = FAN, earlier: DataFrame | None = None):
        self.spark, self.fan = spark, fan
        self.runs: list[tuple[str, str]] = []  # (table, folder)
        self.earlier = earlier  # the documents (doc_id, text) that the runs stand for, one plan over their source
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def manifest(self) -> str:
        """What ``open`` needs, as JSON: keep it, and don't ``close`` the index, to go on in another job."""
        return json.dumps({"buckets": self.buckets, "fan": self.fan, "runs": [folder for _, folder in self.runs]})

    @classmethod
    def open(cls, spark: SparkSession, manifest: str, earlier: DataFrame) -> FingerprintIndex:
        """An index of an earlier job; ``earlier`` holds the documents that it has taken in, all of them."""
        kept = json.loads(manifest)
        index = cls(spark, kept["fan"], _plain(earlier))
        index.buckets = kept["buckets"]
        for folder in kept["runs"]:
            name = f"fingerprints_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {name} (anchor BIGINT, lo BIGINT, hi BIGINT) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor) INTO {index.buckets} BUCKETS LOCATION '{folder}'")
            index.runs.append((name, folder))
        return index

    def _write_run(self, rows: DataFrame) -> tuple[str, str]:
        name, folder = f"fingerprints_{uuid.uuid4().hex}", fresh(self.spark, "run")
        rows = rows.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        # the sum leaves each bucket in one task, so a bucket is one sorted file
        rows.write.bucketBy(self.buckets, "anchor").sortBy("anchor").option("path", folder).option("compression", "zstd").format("parquet").saveAsTable(name)
        return name, folder

    def _shared(self, run: str) -> DataFrame:
        """Anchors of a run that two of its documents hold, or that a run before has."""
        new = self.spark.table(run)
        found = new.filter("lo <> hi").select("anchor")
        for old, _ in self.runs:
            found = found.unionByName(new.select("anchor").join(self.spark.table(old).select("anchor").hint("merge"), "anchor", "left_semi"))
        return found

    def add(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """(doc_id, tie, places): first words of the windows that go, for each document that has any.

        ``last``: the index ends with this batch, so its runs go once they have been joined.
        """
        docs = _plain(docs)
        run = self._write_run(docs.select("doc_id", "text").mapInArrow(_listed, "anchor long, doc_id long").select("anchor", F.col("doc_id").alias("lo"), F.col("doc_id").alias("hi")))
        free_shuffles(self.spark)
        shared = written(self._shared(run[0]), "shared")
        self.runs.append(run)
        if last:
            self.close()
        if shared.isEmpty():
            places = None
        else:
            bitmap = _bitmap.build(shared, "anchor")
            free_shuffles(self.spark)
            places = self._verified(docs, bitmap)
        drop_tables(shared)
        self.earlier = docs if self.earlier is None else self.earlier.unionByName(docs)
        if len(self.runs) >= self.fan:
            self.compact()
        free_shuffles(self.spark)
        return places if places is not None else self.spark.createDataFrame([], "doc_id long, tie long, places array<int>")

    def _verified(self, docs: DataFrame, bitmap: str) -> DataFrame:
        kind = "h1 long, h2 int, doc_id long, tie long, place int"
        rows = docs.mapInArrow(_suspects(bitmap), kind).withColumn("fresh", F.lit(True))
        if self.earlier is not None:
            rows = rows.unionByName(self.earlier.mapInArrow(_suspects(bitmap), kind).withColumn("fresh", F.lit(False)))
        rows = written(rows, "suspects", "zstd")
        own = F.when(F.col("fresh"), F.col("doc_id")).otherwise(F.lit(EARLIER))
        same = rows.groupBy("h1", "h2").agg(F.min(own).alias("lo"), F.max(own).alias("hi"))
        # one row a window, evenly dealt and so hashed; written, so that Spark can split the join where a window is hot
        same = written(same.filter("lo < hi").select("h1", "h2", "lo"), "same")
        free_shuffles(self.spark)
        gone = rows.filter("fresh").drop("fresh").join(same.hint("shuffle_hash"), ["h1", "h2"]).filter("doc_id > lo")
        places = written(gone.groupBy("doc_id", "tie").agg(F.collect_list("place").alias("places")), "places", "zstd")
        drop_tables(rows, same)
        free_shuffles(self.spark)
        return places

    def compact(self) -> None:
        """Merge all runs into one; an anchor keeps its least and greatest doc_id."""
        if len(self.runs) > 1:
            # read as plain files: a union of bucketed tables may be taken for bucketed itself when it is not
            merged = self._write_run(self.spark.read.parquet(*[folder for _, folder in self.runs]))
            self._drop(self.runs)
            self.runs = [merged]

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, folder in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, folder)

    def close(self) -> None:
        self._drop(self.runs)
        self.runs = []


def cut_places(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Index ``docs`` in ``batches`` ascending ranges of doc_id; returns (doc_id, tie, places)."""
    index = FingerprintIndex(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    bounds = sorted(set(ids.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or [])) if batches > 1 else []
    out, low = None, None
    for high in [*bounds, None]:
        part = docs if low is None else docs.filter(F.col("doc_id") > low)
        found = index.add(part if high is None else part.filter(F.col("doc_id") <= high), last=high is None)
        # one filter over the source stands for all batches so far
        index.earlier = _plain(docs if high is None else docs.filter(F.col("doc_id") <= high))
        out, low = found if out is None else out.unionByName(found), high
    index.close()
    return out


def without_repeats(docs: DataFrame, digests: bool = False) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text`` (kept words joined by one space where any is removed).

    With ``digests``: doc_id, n_words, n_removed, kept_sha256 instead of the columns of ``docs``.
    """
    places = cut_places(docs).toDF("rw_doc", "rw_tie", "rw_places")
    columns = docs.columns
    text_at = columns.index("text")
    # the caller's columns go by place, so that they may have any name
    own_id, own_text = (F.col(f"c{columns.index(c)}").cast(k) for c, k in (("doc_id", "long"), ("text", "string")))
    rows = docs.toDF(*[f"c{i}" for i in range(len(columns))]).withColumn("rw_text", F.coalesce(own_text, F.lit("")))
    rows = rows.join(places, (own_id == F.col("rw_doc")) & (F.xxhash64(own_text) == F.col("rw_tie")), "left").drop("rw_doc", "rw_tie")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.rename_columns([f"c{i}" for i in range(len(columns))] + ["whole", "places"])
            for part in chunks(batch, "whole"):
                t = Texts(part.column("whole"))
                n_removed, kept = [], []
                for d, (text, own) in enumerate(zip(part.column("whole").to_pylist(), part.column("places").to_pylist())):
                    a, b = int(t.woff[d]), int(t.woff[d + 1])
                    step = np.zeros(b - a + 1, np.int64)
                    if own:
                        np.add.at(step, np.array(own), 1)
                        np.add.at(step, np.array(own) + WINDOW, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    n_removed.append(int(gone.sum()))
                    if n_removed[-1] or digests:
                        data = text.encode()
                        words = data.split()
                        kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if own else words))
                    else:
                        kept.append(text.encode())
                if digests:
                    arrays = [part.columns[0].cast(pa.int64()), pa.array(t.n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, [f"x{i}" for i in range(4)])
                else:
                    texts = pa.array([None if old is None else k.decode() for old, k in zip(part.column(text_at).to_pylist(), kept)], part.schema.field(text_at).type)
                    arrays = [texts if i == text_at else x for i, x in enumerate(part.columns[: len(columns)])]
                    yield pa.RecordBatch.from_arrays(arrays, part.schema.names[: len(columns)])

    if digests:
        rows = rows.select(own_id, *[F.lit(None).cast("string")] * (len(columns) - 1), "rw_text", "rw_places")
        kinds = StructType([StructField(f"x{i}", k) for i, k in enumerate((LongType(), LongType(), LongType(), StringType()))])
        return rows.mapInArrow(cut, kinds).toDF("doc_id", "n_words", "n_removed", "kept_sha256")
    return rows.mapInArrow(cut, StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])).toDF(*columns)


def op3_substrings(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digests=True)
