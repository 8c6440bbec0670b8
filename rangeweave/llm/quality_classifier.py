"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of the text.

    score(x) = sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The second sum is over all pairs of features, at a cost linear in the features that a document has.  Words are hashed into
``BUCKETS`` features, log(1 + count) scaled to unit length; the statistics (words, characters, lines, symbols, repeats and
the like) are standardised.  Labels, lang, source and doc_id are never inputs.

Fitting takes at most about ``SAMPLE`` labelled rows, chosen by a hash of doc_id, in one task; scoring covers every row.
Null and empty texts are scored from their statistics.  Rows with a null doc_id are scored and count as not held out.
Repeated labels of a document count as their largest; without any label all scores are 0.5.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import U64, Texts, chunks
from .quality_rules import _measure

BUCKETS = 4096
FACTORS = 8
SAMPLE = 8000
THRESHOLD = 0.3
EPOCHS, BATCH, RATE, DECAY = 8, 128, 0.02, 1e-5
STATS = ("log_words", "chars_a_word", "words_a_line", "symbols", "digits", "capitals", "marks", "duplicate_lines", "repeated_words", "stutters", "distinct", "short_words")


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse hashed words as (offsets of documents, features, values), and the dense statistics."""
    n, m = texts.n_docs, _measure(texts)
    hashes = texts.word_hashes()
    keys = texts.doc_of_words().astype(np.int64) * BUCKETS + (hashes >> U64(33)).astype(np.int64) % BUCKETS
    keys, counts = np.unique(keys, return_counts=True)
    off = np.searchsorted(keys, np.arange(n + 1) * BUCKETS)
    values = np.log1p(counts).astype(np.float32)
    norm = np.sqrt(np.bincount(keys // BUCKETS, values.astype(float) ** 2, minlength=n))
    values /= np.repeat(np.maximum(norm, 1e-9), np.diff(off)).astype(np.float32)

    words, data = np.maximum(m["n_words"], 1), texts.data
    lengths = texts.ends - texts.starts
    capital, mark = (data >= 65) & (data <= 90), np.isin(data, np.frombuffer(b".,;:!?", np.uint8))
    per = lambda k: m[k] / words
    short = np.bincount(texts.doc_of_words()[lengths <= 2], minlength=n)
    stats = np.stack(
        [np.log1p(m["n_words"]), per("word_chars"), np.log1p(m["n_words"] / np.maximum(m["n_lines"], 1)), per("n_symbols"), per("n_digits"), texts.sums(capital) / words, texts.sums(mark) / words, m["n_dup_lines"] / np.maximum(m["n_lines"], 1), per("n_repeat_words"), per("n_stutters"), np.diff(off) / words, short / words],
        1,
    )
    return off, keys % BUCKETS, values, stats.astype(np.float32)


@dataclass
class Machine:
    """A fitted model; ``w`` and ``v`` have a row for each bucket, then one for each statistic."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def blank(cls) -> Machine:
        k = len(STATS)
        return cls(0.0, np.zeros(BUCKETS + k, np.float32), np.zeros((BUCKETS + k, FACTORS), np.float32), np.zeros(k, np.float32), np.ones(k, np.float32))

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -5, 5)

    def score(self, off: np.ndarray, index: np.ndarray, values: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """The sum-of-squares identity, sparse over words and dense over statistics."""
        x, n, k = self.standard(stats), len(off) - 1, BUCKETS
        terms = self.v[index] * values[:, None]
        rows = np.concatenate([(self.w[index] * values)[:, None], terms, terms * terms], 1).astype(np.float64)
        sums = np.add.reduceat(np.concatenate([rows, np.zeros((1, rows.shape[1]))]), np.minimum(off[:-1], len(rows)), axis=0) * (np.diff(off) > 0)[:, None] if n else np.zeros((0, rows.shape[1]))
        linear, first, second = sums[:, 0], sums[:, 1 : 1 + FACTORS], sums[:, 1 + FACTORS :]
        z = self.bias + linear + x @ self.w[k:] + 0.5 * ((first + x @ self.v[k:]) ** 2 - second - (x * x) @ (self.v[k:] ** 2)).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(words: np.ndarray, stats: np.ndarray, labels: np.ndarray, seed: int = 1) -> Machine:
    """Adam over log loss; ``words`` has a dense row of hashed words for each document."""
    model = Machine.blank()
    if not len(labels):
        return model
    model.mean, model.scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)
    x = np.concatenate([words, model.standard(stats)], 1).astype(np.float32)
    rng = np.random.default_rng(seed)
    params = [np.zeros(1, np.float32), model.w, rng.normal(0, 0.02, model.v.shape).astype(np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(x)), -(-len(x) // BATCH)):
            b, w, v = params
            xb = x[part]
            inner = xb @ v
            z = b[0] + xb @ w + 0.5 * (inner**2 - (xb * xb) @ (v * v)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            grads = [g.sum(keepdims=True), xb.T @ g + DECAY * w, xb.T @ (g[:, None] * inner) - v * ((xb * xb).T @ g)[:, None] + DECAY * v]
            step += 1
            rate = RATE / (1 + epoch)
            for p, q, m1, m2 in zip(params, grads, first, second):
                m1 += 0.1 * (q - m1)
                m2 += 0.001 * (q * q - m2)
                p -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    model.bias, model.w, model.v = float(params[0][0]), params[1], params[2]
    return model


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            off, index, values, stats = features(Texts(part.column("text")))
            cut = lambda x: [x[a:b].tolist() for a, b in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(cut(index), pa.list_(pa.int32())), pa.array(cut(values), pa.list_(pa.float32())), pa.array(stats.tolist(), pa.list_(pa.float32()))], ["doc_id", "quality", "index", "value", "stats"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["doc_id"], r["quality"], r["stats"]))
    words = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        words[i, r["index"]] = r["value"]
    model = fit(words, np.array([r["stats"] for r in rows], np.float32).reshape(-1, len(STATS)), np.array([r["quality"] for r in rows], np.float32))
    yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """``labels`` (doc_id, quality) are those to learn from.  The sampled ids are broadcast; their number is bounded."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total = labels.count()
    share = min(1.0, sample / max(total, 1))
    labels = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(labels), "doc_id")
    # one text a doc_id, so that the sample is bounded in rows too
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = rows.mapInArrow(_sampled, "doc_id long, quality int, index array<int>, value array<float>, stats array<float>")
    return pickle.loads(rows.repartition(1).mapInArrow(_fitted, "model binary").first()[0])


def with_scores(docs: DataFrame, model: Machine) -> DataFrame:
    """(doc_id, score) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(*features(Texts(part.column("text")))), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = train(docs, labels.filter(~held_out))
    return with_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
