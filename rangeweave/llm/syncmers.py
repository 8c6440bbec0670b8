"""Document fingerprints from closed syncmers, with DataFrame and SQL functions only.

A k-mer is ``K`` consecutive bytes of the UTF-8 text; it is an anchor if the least hash among its ``S``-byte substrings is
that of its first or its last one.  That depends on the k-mer alone, so equal passages have equal anchors wherever they
stand.  What is compared are steps: an anchor, the next one, and how many bytes lie between their places.  Alike texts have
anchors in common at the same distances from one another, whatever comes before; the same anchors elsewhere don't count.  A
text's first anchor is a step by itself.  A fingerprint is the least ``SKETCH`` distinct hashes of steps; two are compared by
the share of common ones among the least ``SKETCH`` of both, which estimates the Jaccard similarity of all steps and is exact
for short texts.

Each text is gone through once.  Its steps give three sketches: of the whole text, of the part that its own edited text
keeps, and of the beginning that the edited text of the document before it takes.  An edited text's sketch is the least of
two such parts and of the few steps across its seam.

Texts shorter than ``K`` bytes have one anchor, the text itself; null and empty texts have none, and two of them are alike
(1.0).  Texts are taken apart in blocks, so that a very long one needs little memory at once.  Documents follow one another
by descending doc_id, nulls last, then by descending hash of the text; after the last comes the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._ranges import range_of

K, S = 12, 6
SKETCH = 64
BLOCK = 8192  # k-mers that are looked at together
ROWS_A_BUCKET = 500


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def anchors_sql(data: str) -> str:
    """SQL for the anchors of a binary value: an array of place << 32 | hash, by ascending place."""
    w = K - S + 1
    first = " and ".join(f"h[i] < h[i + {j}]" for j in range(1, w - 1))
    last = " and ".join(f"h[i + {w - 1}] < h[i + {j}]" for j in range(w - 2, 0, -1))
    hashes = f"transform(sequence(0, length(part) - {S}), i -> xxhash64(substring(part, i + 1, {S})))"
    chosen = f"filter(sequence(0, size(h) - {w}), i -> if(h[i] <= h[i + {w - 1}], {first}, {last}))"
    packed = f"transform({_let(hashes, 'h', chosen)}, i -> shiftleft(i + block * {BLOCK}L, 32) + (xxhash64(substring(part, i + 1, {K})) & 4294967295))"
    block = _let(f"substring(whole, int(block * {BLOCK} + 1), {BLOCK + K - 1})", "part", packed)
    blocks = f"flatten(transform(sequence(0L, cast((length(whole) - {K}) div {BLOCK} as bigint)), block -> {block}))"
    short = "if(length(whole) = 0, cast(array() as array<bigint>), array(xxhash64(whole) & 4294967295))"
    return _let(data, "whole", f"if(length(whole) < {K}, {short}, {blocks})")


def steps_sql(anchors: str) -> str:
    """SQL for the steps of anchors, as many as there are anchors: the first by itself, then each with the one before."""
    step = "xxhash64(p[i - 1] & 4294967295, p[i] & 4294967295, shiftright(p[i], 32) - shiftright(p[i - 1], 32)) & 4294967295"
    every = f"transform(sequence(0, size(p) - 1), i -> if(i = 0, xxhash64(p[0] & 4294967295) & 4294967295, {step}))"
    return _let(anchors, "p", f"if(size(p) = 0, cast(array() as array<bigint>), {every})")


def sketch_sql(steps: str) -> str:
    """SQL for the least hashes of steps."""
    return f"slice(sort_array(array_distinct({steps})), 1, {SKETCH})"


def likeness(a: str, b: str) -> Column:
    """Of two sketches, from 0 to 1."""
    both = f"slice(sort_array(array_union({a}, {b})), 1, {SKETCH})"
    return F.expr(_let(both, "u", f"if(size(u) = 0, 1D, size(array_intersect(array_intersect(u, {a}), {b})) / cast(size(u) as double))"))


def spelt(sketch: str) -> Column:
    return F.expr(f"array_join(transform({sketch}, a -> lpad(lower(hex(a)), 8, '0')), '')")


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, place, anchor): every anchor with the byte at which it begins."""
    return docs.select("doc_id", F.explode(F.expr(anchors_sql("cast(coalesce(cast(text as string), '') as binary)"))).alias("a")).select("doc_id", F.shiftright("a", 32).alias("place"), F.col("a").bitwiseAND(0xFFFFFFFF).alias("anchor"))


def positional_matches(left: DataFrame, right: DataFrame, least: int = 3) -> DataFrame:
    """Where documents of ``left`` and ``right`` run alike: (left_id, right_id, shift, matches, first_place, last_place).

    Anchors that occur once in a document are joined; matches with the same shift lie on one alignment.
    """
    once = lambda x: anchors(x).groupBy("doc_id", "anchor").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    a, b = (once(x).select(F.col("doc_id").alias(f"{s}_id"), "anchor", F.col("place").alias(f"{s}_place")) for x, s in ((left, "left"), (right, "right")))
    return (
        a.join(b, "anchor")
        .groupBy("left_id", "right_id", (F.col("right_place") - F.col("left_place")).alias("shift"))
        .agg(F.count(F.lit(1)).alias("matches"), F.min("left_place").alias("first_place"), F.max("left_place").alias("last_place"))
        .filter(F.col("matches") >= least)
    )


def in_sequence(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a bucket of descending ranges of doc_id, and each bucket's neighbour rows as guests.

    A guest stands at an edge of the bucket next to its own.
    """
    rows = docs.withColumn("bucket", range_of(docs.select("doc_id"), "doc_id", ROWS_A_BUCKET, F.col("tie")))

    # each bucket's first and last row; as many rows as ranges, whose number is bounded, so small enough to broadcast
    ends = rows.groupBy("bucket").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("real"), "doc_id", "tie")).alias("top"), F.min(F.struct(F.col("doc_id").isNotNull().alias("real"), "doc_id", "tie")).alias("low"))
    down = Window.orderBy(F.desc("bucket"))
    ends = ends.select("bucket", "top", "low", F.lag("bucket").over(down).alias("above"), F.lead("bucket").over(down).alias("below"), F.max("bucket").over(Window.partitionBy()).alias("highest"), F.min("bucket").over(Window.partitionBy()).alias("lowest"))
    guests = ends.select(F.col("bucket").alias("own"), F.explode(F.array(F.struct("top.doc_id", "top.tie", F.coalesce("above", "lowest").alias("to"), F.lit(1).alias("side")), F.struct("low.doc_id", "low.tie", F.coalesce("below", "highest").alias("to"), F.lit(-1).alias("side")))).alias("g")).select("own", F.col("g.doc_id").alias("gid"), F.col("g.tie").alias("gtie"), "g.to", "g.side")
    moved = rows.join(F.broadcast(guests), (rows["bucket"] == guests["own"]) & rows["doc_id"].eqNullSafe(guests["gid"]) & rows["tie"].eqNullSafe(guests["gtie"])).select("doc_id", "text", "tie", F.col("to").alias("bucket"), "side")
    return rows.withColumn("side", F.lit(0)).unionByName(moved)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text replaces the last half of the code points by as many first ones (or all) of the next document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = in_sequence(rows.withColumn("tie", F.xxhash64("text"))).withColumn("n_chars", F.char_length("text"))
    order = Window.partitionBy("bucket").orderBy("side", F.desc_nulls_last("doc_id"), F.desc("tie"))
    rows = rows.withColumn("asked", F.coalesce(F.floor(F.lag("n_chars").over(order) / 2), F.lit(0))).withColumn("next_text", F.lead("text").over(order))

    cut = "cast(n_chars - n_chars div 2 as int)"
    rows = rows.withColumn("own_part", F.expr(f"left(text, {cut})")).withColumn("given", F.expr("left(text, cast(asked as int))")).withColumn("taken", F.expr("left(next_text, cast(n_chars div 2 as int))"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.concat("own_part", "taken"), 256))
    # the seam: k-mers that hold bytes of both parts; or all of an edited text too short for k-mers in either
    seam = f"concat(right_bytes, substring(cast(taken as binary), 1, {K - 1}))"
    rows = rows.withColumn("right_bytes", F.expr(f"substring(cast(own_part as binary), greatest(1, octet_length(own_part) - {K - 2}), {K - 1})"))
    rows = rows.withColumn("seam", F.expr(f"if(octet_length(own_part) + octet_length(taken) < {K} or octet_length(own_part) >= 1 and octet_length(taken) >= 1 and length({seam}) >= {K}, {seam}, cast('' as binary))"))
    none, within = "cast(null as bigint)", "size(filter(a, x -> shiftright(x, 32) <= {0} - " + str(K) + "))"
    parts = f"struct({sketch_sql('e')} as full, {sketch_sql('slice(e, 1, m)')} as own, {sketch_sql('slice(e, 2, greatest(n - 1, 0))')} as given, if(m > 0, a[m - 1], {none}) as last, if(n > 0, a[0], {none}) as first)"
    parts = _let(within.format("own_last"), "m", _let(within.format("given_last"), "n", _let(steps_sql("a"), "e", parts)))
    rows = rows.withColumn("own_last", F.octet_length("own_part")).withColumn("given_last", F.octet_length("given"))
    rows = rows.withColumn("s", F.expr(_let(anchors_sql("cast(text as binary)"), "a", parts)))
    # the seam's anchors, at their places in the edited text
    rows = rows.withColumn("across", F.expr(f"transform({anchors_sql('seam')}, x -> x + shiftleft(cast(own_last - length(right_bytes) as bigint), 32))"))
    rows = rows.select("bucket", "side", "doc_id", "tie", "n_chars", "edited_sha256", "own_last", "across", "s.full", "s.own", "s.given", "s.last", "s.first")

    rows = rows.withColumn("next", F.lead(F.struct("full", "given", "first")).over(order)).filter("side = 0")
    edge = "concat(if(last is null, cast(array() as array<bigint>), array(last)), across, if(next.first is null, cast(array() as array<bigint>), array(next.first + shiftleft(cast(own_last as bigint), 32))))"
    # steps from the kept part's last anchor on; that one's own step is not the text's first but for a text that keeps none
    rows = rows.withColumn("edge", F.expr(_let(steps_sql(edge), "e", "if(last is null, e, slice(e, 2, greatest(size(e) - 1, 0)))")))
    rows = rows.withColumn("edited", F.expr(sketch_sql("concat(own, edge, next.given)")))
    return rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", spelt("full").alias("fingerprint"), spelt("edited").alias("edited_fingerprint"), likeness("full", "edited").alias("near_edited"), likeness("full", "next.full").alias("near_next"))


def op8_syncmers(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
