"""Quality rules as a ledger: every rule is evaluated once, its failure kept as a bit and its measurement as a
column.  A policy is a versioned mask over those bits, applied (or ablated) later without touching a text again.

Null and empty texts have no words: all counts are 0 and only ``too_few_words`` fails.  Repeated rows are judged one by
one; a null doc_id is carried.  Rows are independent, so partitions, hot sources and retries need no care.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._text import Texts, U64, chunks, mix, windows

WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_digits", "n_stutters")
SCHEMA = ", ".join(["doc_id long", *(f"{m} long" for m in MEASURES)])


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: Callable[[Mapping[str, Column]], Column]  # over the measurements


#: Bits never change their meaning; a changed threshold is a new rule with a new bit.
RULES = (
    Rule("too_few_words", 0, lambda m: m["n_words"] < 20),
    Rule("repeated_windows", 1, lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule("symbols", 2, lambda m: (5 * m["n_symbols"] > m["n_words"]) & (m["n_symbols"] >= 10)),
    Rule("duplicate_lines", 3, lambda m: (10 * m["n_dup_lines"] > 3 * m["n_lines"]) & (m["n_dup_lines"] >= 3)),
    Rule("short_words", 4, lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", 5, lambda m: m["word_chars"] > 20 * m["n_words"]),
    Rule("digits", 6, lambda m: 2 * m["n_digits"] > m["word_chars"]),
    Rule("stutters", 7, lambda m: 2 * m["n_stutters"] > m["n_words"]),
)
BIT = {r.name: 1 << r.bit for r in RULES}
BASE = BIT["too_few_words"] | BIT["repeated_windows"]
#: version -> mask of the rules that reject
POLICIES = {"base": BASE, "v1": BASE | BIT["symbols"] | BIT["duplicate_lines"] | BIT["short_words"] | BIT["long_words"] | BIT["digits"] | BIT["stutters"]}


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _measure(texts: Texts) -> dict[str, np.ndarray]:
    data, salt = texts.data, mix(np.arange(texts.n_docs, dtype=U64), 5)
    chars = (data & 0xC0) != 0x80
    m = {"n_words": texts.n_words, "word_chars": texts.sums(chars & ~texts.gap), "n_symbols": texts.sums(SYMBOLS[data]), "n_digits": texts.sums((data >= 48) & (data <= 57))}

    # lines that hold a word, and those of them that an earlier one equals
    newline = np.flatnonzero(data == 10)
    starts, ends = np.sort(np.concatenate([texts.off[:-1], newline + 1])), np.sort(np.concatenate([newline, texts.off[1:]]))
    full = np.searchsorted(texts.starts, ends) > np.searchsorted(texts.starts, starts)
    starts, ends = starts[full], ends[full]
    doc = np.searchsorted(texts.off, starts, "right") - 1
    keys = mix(texts.spans(starts, ends) ^ salt[doc])
    _, first = np.unique(keys, return_index=True)
    m["n_lines"] = np.bincount(doc, minlength=texts.n_docs)
    m["n_dup_lines"] = m["n_lines"] - np.bincount(doc[first], minlength=texts.n_docs)

    # words in windows that occur again in the same text
    of = texts.doc_of_words()
    words = texts.word_hashes()
    stutters = np.zeros(len(of), bool)
    stutters[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    m["n_stutters"] = np.bincount(of[stutters], minlength=texts.n_docs)
    keys, first = windows(words, texts.woff, WINDOW)
    again = first[_repeats(keys ^ salt[of[first]])]
    step = np.zeros(len(of) + 1, np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + WINDOW, -1)
    m["n_repeat_words"] = np.bincount(of[np.cumsum(step[:-1]) > 0], minlength=texts.n_docs)
    return m


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            m = _measure(Texts(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(m[k], pa.int64()) for k in MEASURES)], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, the measurements, and ``failed``, the bits of all rules that it fails."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measured, SCHEMA)
    return rows.withColumn("failed", failure_bits({k: F.col(k) for k in MEASURES}))


def failure_bits(measured: Mapping[str, Column]) -> Column:
    """All rules' bits, from columns that hold the measurements."""
    bits = [F.when(r.fails(measured), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    return reduce(Column.bitwiseOR, bits).cast("long")


def passes(policy: str = "v1", failed: str = "failed") -> Column:
    """Whether a policy keeps a row of the ledger."""
    return F.col(failed).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that only it rejects (kept if it were taken out).

    One pass over the ledger: rows are counted by their bit pattern, of which there are at most 2 ** rules.
    """
    mask = POLICIES[policy]
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    return patterns.agg(
        *[
            F.struct(
                F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(1 << r.bit)) != 0, F.col("n"))), F.lit(0)).alias("failing"),
                F.coalesce(F.sum(F.when(F.col("bits") == (1 << r.bit), F.col("n"))), F.lit(0)).alias("only_this"),
            ).alias(r.name)
            for r in RULES
            if mask >> r.bit & 1
        ]
    ).select(F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"{r.name}.failing"), F.col(f"{r.name}.only_this")) for r in RULES if mask >> r.bit & 1])).alias("r")).select("r.*")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes("v1")).alias("kept"), "n_lines", "n_digits", "n_stutters", "failed")


def rejecting(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs``, all columns, that a policy keeps.  Judged in place: no join on doc_id, so repeated ids are safe."""
    columns = docs.columns

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.rename_columns([f"c{i}" for i in range(len(columns))])
            for part in chunks(batch.append_column("whole", batch.column(columns.index("text")).cast(pa.string())), "whole"):
                m = _measure(Texts(part.column("whole")))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(m[k], pa.int64()) for k in MEASURES)], [*part.schema.names[:-1], *MEASURES])

    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)] + [StructField(k, LongType()) for k in MEASURES])
    rows = docs.mapInArrow(judged, schema)
    return rows.filter(failure_bits({k: F.col(k) for k in MEASURES}).bitwiseAND(F.lit(POLICIES[policy])) == 0).select([F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
