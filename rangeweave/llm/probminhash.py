"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A document is its weighted set of ``SHINGLE``-word shingles.  A shingle's weight is its own, in whichever text it stands:
the root of its length in bytes, rounded down, so long shingles say more and a long word does not say all.  Each shingle
sends arrivals of a Poisson process at the rate of its weight, and each arrival falls on one of ``REGISTERS`` registers; a
register keeps the shingle that reaches it first.  Two documents agree in a register with their probability Jaccard
similarity, which for such weights is the weight of the shingles in both over the weight of those in either.  How often a
text repeats a passage changes nothing.  Time goes on in slices, and a document stops as soon as all its registers are
filled, which leaves most later arrivals of a long document unmade.

Registers are cut into bands; texts that share a band are candidates.  Two candidates are linked if that same similarity,
worked out exactly, is ``THRESHOLD`` (t) or more: the registers estimate what is verified, so a linked pair is missed with
the probability (1 - t ** ROWS) ** BANDS at most, 3e-5.

A bucket's pairs are never all made.  Each member x is first compared with the bucket's leader L, the least node, which
leaves c(x), the weight of what x and L share, and the shingles of x that L lacks.  Say W(x) is the weight of x.  A pair x, y
that is then in different components can only be linked if it shares t / (1 + t) (W(x) + W(y)) or more, and that is at most
the lesser of c(x) and c(y) and what x and y share beyond L.  So either

* x and y share shingles that L lacks, at least t W(x) - c(x) of them; a member that has less in common with all others is
  done, and the rest meet in cells (L, shingle), on their rarest ones;
* or W(x) + W(y) <= (1 + t) / t min(c(x), c(y)), which near copies of L in different components rarely meet: they are
  joined by weight, in narrow bands.

Members outside of L's component are first compared with ``HEADS`` members of each of their cells, at most that many pairs for
each row of a cell; near copies that are linked by way of others mostly are in one component after that.  Only members that
still are outside meet all of their cells, so that no link between components is lost.  The pairs of this last step grow
with the texts that are alike in part and linked to nothing, times those that share their rarest shingles beyond L: of many
texts of one template that miss the threshold narrowly they can be near the square (a fifth of all pairs in the tests).

Two that meet under several leaders are looked at under one: that which has the most members, where it is the same for both.

Texts with the same words are one node, whatever their number.  Texts of 1 to 4
words are a single shingle.  Null and empty texts are classes of their own.  Rows that repeat a doc_id are in one class,
with all that any of their texts is linked to.  A null doc_id has a null class.  A task holds a text whole, at some 60 bytes
of arrays a byte of text.  Only doc_id and text are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _bitmap
from ._graph import components, merged
from ._store import drop_tables, free_shuffles, written
from ._text import U64, Texts, chunks, mix, windows

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
HEADS = 4  # members of a cell that others are compared with at first


def shingles(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, weight) of every shingle, in the order of the text."""
    hashes = t.word_hashes()
    h, first = windows(hashes, t.woff, SHINGLE, seed=21)
    doc = t.doc_of_words()[first]
    letters = np.concatenate([[0], np.cumsum(t.ends - t.starts)])
    size = letters[first + SHINGLE] - letters[first] + SHINGLE - 1 if len(first) else np.zeros(0, np.int64)
    few = np.flatnonzero((t.n_words > 0) & (t.n_words < SHINGLE))
    if len(few):
        own = t.n_words[few].astype(U64)
        for j in range(SHINGLE - 1):
            more = t.n_words[few] > j
            own[more] = mix(own[more] * U64(0x9E3779B97F4A7C15) + hashes[t.woff[few[more]] + j], 22)
        doc, h = np.concatenate([doc, few]), np.concatenate([h, own])
        size = np.concatenate([size, letters[t.woff[few + 1]] - letters[t.woff[few]] + t.n_words[few] - 1])
        order = np.argsort(doc, kind="stable")
        doc, h, size = doc[order], h[order], size[order]
    return doc, h, np.sqrt(size).astype(np.int64)


def weighted(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles as (document, hash, weight), sorted."""
    doc, h, weight = shingles(t)
    order = np.lexsort((h, doc))
    doc, h, weight = doc[order], h[order], weight[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new], weight[new]


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """The shingle that reaches each register first: n_docs rows of m hashes, 0 for documents without shingles."""
    out = np.zeros((n_docs, m), U64)
    count = np.bincount(doc, minlength=n_docs)
    single = count[doc] == 1  # one shingle fills every register
    out[doc[single]] = h[single, None]
    doc, h, weight = doc[~single], h[~single], weight[~single].astype(float)
    empty = np.zeros((n_docs, m), bool)
    empty[np.unique(doc)] = True
    total = np.bincount(doc, weight, minlength=n_docs)
    unit = m / np.maximum(total, 1e-9)  # the time in which a document gets m arrivals, on average

    def gap(which: np.ndarray, nth: np.ndarray) -> np.ndarray:
        u = (mix(h[which] + nth * U64(0xC2B2AE3D27D4EB4F), 31) >> U64(11)).astype(float) * 2.0**-53
        return -np.log1p(-u) / weight[which]

    live = np.arange(len(h))
    nth = np.zeros(len(h), U64)
    time = gap(live, nth)
    bound = 0.0
    while len(live):
        bound += 3.0 if bound == 0 else 2.0
        came, own = [], live[time[live] <= bound * unit[doc[live]]]
        while len(own):
            register = (mix(h[own] ^ (nth[own] * U64(0x165667B19E3779F9)), 32) % U64(m)).astype(np.int64)
            came.append((doc[own] * m + register, time[own].copy(), own))
            nth[own] += U64(1)
            time[own] += gap(own, nth[own])
            own = own[time[own] <= bound * unit[doc[own]]]
        if came:
            place, when, which = (np.concatenate(x) for x in zip(*came))
            open_ = empty.reshape(-1)[place]  # registers that no earlier slice has filled
            place, when, which = place[open_], when[open_], which[open_]
            order = np.lexsort((when, place))
            place, which = place[order], which[order]
            first = np.ones(len(place), bool)
            first[1:] = place[1:] != place[:-1]
            out.reshape(-1)[place[first]] = h[which[first]]
            empty.reshape(-1)[place[first]] = False
        live = live[empty.any(1)[doc[live]]]
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    own = signature.reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=U64), own.shape[:2]).copy()
    for j in range(ROWS):
        out = mix(out * U64(0x9E3779B97F4A7C15) + own[:, :, j], 33)
    return out


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The exact similarity that registers estimate; hashes are sorted and distinct."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    w, v = wa[i].astype(float), wb[j].astype(float)
    order = np.argsort(w / v)
    w, v = w[order], v[order]
    low = np.searchsorted(w / v, w / v, "left")
    v_below = np.concatenate([[0], np.cumsum(v)])[low] + (wb.sum() - v.sum())
    w_above = w.sum() - np.concatenate([[0], np.cumsum(w)])[low] + (wa.sum() - w.sum())
    return float((1 / (w_above / w + v_below / v)).sum())


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            t = Texts(part.column("text"))
            doc, h, weight = weighted(t)
            rows = bands(signatures(doc, h, weight, t.n_docs)).view(np.int64)
            c1, c2 = _content(t)
            off = np.concatenate([[0], np.cumsum(np.where(t.n_words > 0, BANDS, 0))]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(off), pa.array(rows[t.n_words > 0].reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(c1), pa.array(c2), keys], ["doc_id", "c1", "c2", "bands"])


def _content(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text's word sequence."""
    hashes, out = t.word_hashes(), []
    place = np.arange(len(hashes)) - np.repeat(t.woff[:-1], t.n_words)
    for seed in (41, 42):
        each = mix(mix(hashes, seed) + place.astype(U64) * U64(0xD6E8FEB86659FD93), seed)
        total = np.concatenate([np.zeros(1, U64), np.cumsum(each, dtype=U64)])
        out.append(mix(total[t.woff[1:]] - total[t.woff[:-1]] + t.n_words.astype(U64), seed).view(np.int64))
    return out[0], out[1]


def _sets(bitmap: str):
    """The weighted shingle sets of documents whose doc_id may be in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_bitmap.test(bitmap, batch.column("doc_id").to_numpy().view(U64))))
            for part in chunks(batch) if batch.num_rows else ():
                t = Texts(part.column("text"))
                doc, h, weight = weighted(t)
                off = pa.array(np.searchsorted(doc, np.arange(t.n_docs + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (h.view(np.int64), weight.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, _content(t)), *lists], ["doc_id", "c1", "c2", "h", "w"])

    return run


COMPARED = "a long, b long, na long, nb long, common long, more array<long>, mw array<int>"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights, what is shared, and the shingles of b that a lacks."""
    for batch in batches:
        sides = [(batch.column(f"h{x}").offsets.to_numpy(), batch.column(f"h{x}").values.to_numpy().view(U64), batch.column(f"w{x}").values.to_numpy()) for x in "ab"]
        found: list[tuple[int, int, int]] = []
        more, heavy, off = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [0]
        for i in range(batch.num_rows):
            (a, wa), (b, wb) = ((v[o[i] : o[i + 1]], w[o[i] : o[i + 1]]) for o, v, w in sides)
            shared = a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b
            found.append((int(wa.sum()), int(wb.sum()), int(wb[shared].sum())))
            more.append(b[~shared].view(np.int64))
            heavy.append(wb[~shared])
            off.append(off[-1] + len(more[-1]))
        numbers = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
        lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(x))) for x in (more, heavy)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *numbers, *lists], ["a", "b", "na", "nb", "common", "more", "mw"])


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` (a, b) with what ``_compared`` finds and whether they are linked.

    Each side is joined by itself, so a hub's pairs can be split.
    """
    side = lambda x: sets.select(F.col("node").alias(x), F.col("h").alias(f"h{x}"), F.col("w").alias(f"w{x}"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(_compared, COMPARED)
    return written(rows.withColumn("linked", F.col("common") >= threshold * (F.col("na") + F.col("nb") - F.col("common")) - 1e-9), "compared", "zstd")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) for every row; class_id is the least doc_id of the class."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(docs.filter("doc_id is not null").mapInArrow(_signed, "doc_id long, c1 long, c2 long, bands array<long>"), "signed")

    # texts with the same words become one node, named by its least doc_id, or by its hash if that names another text's
    # already; written, so that a hot text's join can be split
    full = signed.filter("size(bands) > 0")
    nodes = written(full.groupBy("c1", "c2").agg(F.min("doc_id").alias("shown")), "nodes")
    first = nodes.groupBy("shown").agg(F.min(F.struct("c1", "c2")).alias("first"))
    nodes = written(nodes.join(first, "shown").select("c1", "c2", "shown", F.when(F.col("first") == F.struct("c1", "c2"), F.col("shown")).otherwise(F.col("c1")).alias("node")), "nodes")
    member = full.join(nodes, ["c1", "c2"])
    keys = written(member.filter("doc_id = shown").select("node", F.explode("bands").alias("key")).distinct(), "keys", "zstd")
    buckets = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).filter("n > 1").select("key", "least"), "buckets")
    tried = written(_pairs(keys.join(buckets, "key").select(F.col("least").alias("x"), F.col("node").alias("y"))), "pairs")
    drop_tables(keys)

    involved = written(nodes.join(tried.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"), "involved")
    of = None
    if not involved.isEmpty():
        found = docs.filter("doc_id is not null").mapInArrow(_sets(_bitmap.build(involved, "shown")), "doc_id long, c1 long, c2 long, h array<long>, w array<int>")
        found = found.join(involved.withColumnRenamed("shown", "doc_id"), ["doc_id", "c1", "c2"]).select("node", "h", "w")
        sets = written(found.dropDuplicates(["node"]), "sets")
        free_shuffles(docs.sparkSession)
        links = lambda compared: compared.filter("linked").select("a", "b")
        stars = _verified(tried, sets, threshold)
        of = components(links(stars))
        for heads in (HEADS, None):
            met, used = _left_over(stars, of, threshold, heads)
            more = written(met.join(tried, ["a", "b"], "left_anti"), "pairs")
            drop_tables(*used)
            tried = tried.unionByName(more)
            compared = _verified(more, sets, threshold)
            of = merged(of, links(compared))
            drop_tables(compared)
        drop_tables(sets, stars)
        free_shuffles(docs.sparkSession)
    copies = full.select("doc_id", "c1", "c2").join(nodes.drop("shown"), ["c1", "c2"]).select("doc_id", "node")
    if of is not None:
        copies = copies.join(of, "node", "left").select("doc_id", F.coalesce("class", "node").alias("node"))
    named = written(copies.distinct(), "named")
    drop_tables(signed, nodes, buckets, tried, involved)
    free_shuffles(docs.sparkSession)
    return docs.select("doc_id").join(_named(named), "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def _named(copies: DataFrame) -> DataFrame:
    """(doc_id, class_id) of (doc_id, class): equal doc_ids are one document, whose texts' classes meet."""
    several = copies.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("doc_id", "a")
    meeting = written(copies.join(several, "doc_id").filter("a <> node").select("a", F.col("node").alias("b")).distinct(), "meeting")
    if not meeting.isEmpty():
        copies = copies.join(components(meeting), "node", "left").select("doc_id", F.coalesce("class", "node").alias("node")).distinct()
    least = written(copies.groupBy("node").agg(F.min("doc_id").alias("class_id")), "classes")  # written, so that a hot class's join can be split
    return copies.join(least, "node").select("doc_id", "class_id")


def _left_over(stars: DataFrame, of: DataFrame, t: float, heads: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b) of members of one leader in different components that may be linked, and the tables that they read.

    With ``heads``, only those with that many members of each cell, members of the leader's component first.
    """
    leaders, members = (of.select(F.col("node").alias(x), F.col("class").alias(f"c{x}")) for x in "ab")
    own = stars.join(members, "b", "left").join(leaders, "a", "left").select(F.col("a").alias("lead"), F.col("b").alias("x"), F.coalesce("cb", "b").alias("cx"), F.coalesce("ca", "a").alias("cl"), F.col("nb").alias("n"), "common", F.arrays_zip("more", "mw").alias("more"))
    own = own.withColumn("least", F.greatest(F.lit(1), F.ceil(t * F.col("n") - 1e-9) - F.col("common")).cast("long"))
    own = own.withColumn("most", F.floor(F.col("common") * (1 + t) / t + 1e-9) - F.col("n"))  # a partner's size, if nothing beyond the leader is shared
    own = written(own, "members", "zstd")
    crowd = written(own.groupBy("lead").agg(F.count(F.lit(1)).alias("crowd")), "crowd")  # written, so that a hot leader's join can be split
    main = own.select("lead", "x").join(crowd, "lead").groupBy("x").agg(F.max(F.struct("crowd", "lead")).alias("m")).select("x", F.col("m.lead").alias("main"))
    main, before = written(main, "main"), own
    own = written(own.join(main, "x"), "members", "zstd")
    drop_tables(before, main, crowd)
    out = own.filter("cx <> cl")
    groups = written(out.select("lead").distinct(), "leads")
    whole, own = own, own.join(groups, "lead", "left_semi")

    each = own.select("lead", "x", "cx", "cl", "main", "least", F.explode("more").alias("m"))
    each = written(each.select("lead", "x", "cx", "cl", "main", "least", F.col("m.more").alias("h"), F.col("m.mw").alias("w")), "lacking", "zstd")
    often = written(each.groupBy("lead", "h").agg(F.count(F.lit(1)).alias("n"), F.min("cx").alias("lo"), F.max("cx").alias("hi")).filter("lo <> hi").select("lead", "h", "n"), "often")
    some = each.filter("cx <> cl").join(often, ["lead", "h"]).groupBy("lead", "x", "cx", "main", "least").agg(F.sort_array(F.collect_list(F.struct("n", "h", "w"))).alias("met"), F.sum("w").alias("sum"))
    # the rarest ones, until what is left weighs too little to be all that a linked pair shares
    prefix = "aggregate(met, struct(sum as rest, cast(array() as array<bigint>) as out), (s, m) -> struct(s.rest - m.w as rest, if(s.rest >= least, concat(s.out, array(m.h)), s.out) as out), s -> s.out)"
    some = written(some.filter(F.col("sum") >= F.col("least")).select("lead", "x", "cx", "main", F.explode(F.expr(prefix)).alias("h")), "meeting", "zstd")
    drop_tables(often)
    if heads is not None:
        # each task keeps the first members of its part of a cell before they meet, so a hot cell is no burden
        lacking = each
        each = each.join(some.select("lead", "h").distinct(), ["lead", "h"], "left_semi")
        first = F.row_number().over(Window.partitionBy("lead", "h").orderBy(F.col("cx") != F.col("cl"), "x"))
        each = written(each.withColumn("nth", first).filter(F.col("nth") <= heads).drop("nth"), "heads")
        drop_tables(lacking)
    here = lambda a, b: (F.col("lead") == F.col(a)) | (F.col(a) != F.col(b))
    other = each.select(F.col("lead").alias("lead_y"), F.col("h").alias("hy"), F.col("x").alias("y"), F.col("cx").alias("cy"), F.col("main").alias("main_y"))
    met = some.join(other, (F.col("lead") == F.col("lead_y")) & (F.col("h") == F.col("hy")) & (F.col("cx") != F.col("cy")) & here("main", "main_y")).select("x", "y")

    band = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(1.03)))
    small = own.filter(F.col("most") >= F.ceil(t * F.col("n") - 1e-9))
    there = small.select(F.col("lead").alias("lead_y"), F.col("x").alias("y"), F.col("cx").alias("cy"), F.col("n").alias("ny"), F.col("most").alias("my"), F.col("main").alias("main_y"), band(F.col("n")).alias("band_y"))
    asked = small.filter("cx <> cl").select("lead", "x", "cx", "main", F.col("n").alias("nx"), F.col("most").alias("mx"), F.explode(F.sequence(band(F.ceil(t * F.col("n") - 1e-9)), band(F.col("most")))).alias("band"))
    fits = (F.col("ny") <= F.col("mx")) & (F.col("nx") <= F.col("my"))
    alike = asked.join(there, (F.col("lead") == F.col("lead_y")) & (F.col("band") == F.col("band_y")) & (F.col("cx") != F.col("cy")) & fits & here("main", "main_y")).select("x", "y")
    return _pairs(met if heads is not None else met.unionByName(alike)), [whole, groups, each, some]


def op1_probminhash(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
