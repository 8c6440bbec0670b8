"""Token ids in binary shards: frequency-ranked ids in a byte-aligned variable-length code.

Ids are replaced by their rank in the corpus (0 the most frequent).  A rank takes 1 to 4 bytes; the lengths stand apart in
control bytes, two bits for each of four ids, so that numpy decodes whole documents by table lookup and no loop.

A shard file: magic ``RWID1\\n``, then for each document its control bytes and its data bytes, then the footer, a JSON
object with each document's (doc_id, start, ids, control bytes, data bytes, offset) and the CRC-32 of the rank-to-id table,
then the footer's length (8 bytes) and the magic again.  The table stands beside the shards in ``ranks``, the id of each
rank as a little-endian unsigned 32-bit integer.  Shards hold ascending ranges of doc_id.

Null and empty texts hold the end id alone.  Repeated doc_ids are written in turn, in the order of their text's hash.  An
empty table gives no shards and no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._ranges import range_of
from ._store import WholeFile, drop_tables, fresh, open_file, written
from ._text import Flat, Numbers, chunks, ragged

MAGIC = b"RWID1\n"
END_ID = 2
PIECES_KEPT = 1_500_000
_MARK, _LETTER, _RARE = (np.isin(np.arange(256), list(x)) for x in (b",.;:!?", bytes(range(65, 91)) + bytes(range(97, 123)), b"\t\v\f\r"))

# ---------------------------------------------------------------- the code


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes)."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    extra = np.concatenate([extra, np.zeros(-len(extra) % 4, np.uint8)]).reshape(-1, 4)
    return (extra << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes(), data.tobytes()


#: For each control byte, the lengths of its four ids.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1
#: For each length, the bits of a four-byte word that belong to the id.
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths)
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    at = ends - lengths
    words = padded[at].astype(np.uint32)
    for j in (1, 2, 3):
        more = lengths > j
        if not more.any():
            break
        words[more] |= padded[at[more] + j].astype(np.uint32) << np.uint32(8 * j)
    return words & MASKS[lengths]


# ---------------------------------------------------------------- tokenizing

#: Texts around every kind of cut; a tokenizer that gives them other ids when they are cut gets whole texts only.
PROBE = ["", "a", " a", "a b", "A B c", "a. B, c; d: e! f?", "a.b,c", "a\nb", "a\n\nb", "\na\n", "a\n b", "x1 22 3,456.78", "it's I'll we've don't", "'s ll", "(a) [b] {c} \"d\"", "a-b a_b a/b", "#a *b $c", "éa bé, 漢字。 ß", "— a —b", "The end.\nOf it, then", ", a .b ;", "aaaa " * 9]


def rare_space(data: np.ndarray) -> np.ndarray:
    """Where a character of Unicode's White_Space begins, but for space and newline."""
    out = _RARE[data]
    for lead, seconds, thirds in ((0xC2, (0x85, 0xA0), None), (0xE1, (0x9A,), (0x80,)), (0xE2, (0x80,), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, (0x81,), (0x9F,)), (0xE3, (0x80,), (0x80,))):
        at = np.flatnonzero(data == lead)
        at = at[np.isin(data[at + 1], seconds)]
        out[at if thirds is None else at[np.isin(data[at + 2], thirds)]] = True
    return out


class PieceEncoder:
    """Encodes whole texts with a byte-level BPE of the ``tokenizers`` library.

    Its pre-tokenizer breaks before a space between other characters, around up to two newlines, and between letters and
    the marks that end a word.  Texts are cut there; the library encodes each distinct piece once, and pieces already seen
    are looked up by hash, whole arrays at a time.  Texts with other white space or special tokens go to the library whole,
    and so do all texts where the loaded tokenizer breaks otherwise, which ``PROBE`` shows.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.opens = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        newline = self._library(["\n"])[0]
        self.newline, self.cuts = (newline or [-1])[0], len(newline) == 1
        self.forget()
        if self.cuts:
            ids, sizes = self(pa.array(PROBE))
            self.cuts = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == self._library(PROBE)
            self.forget()

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        self.numbers = Numbers()
        self.pool, self.at, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Those after a space and the others are each encoded in one go, and told apart by the token that begins them."""
        for spaced in (True, False):
            which = [i for i, p in enumerate(pieces) if (p[0] == " ") == spaced]
            own = [pieces[i] for i in which]
            if not own:
                continue
            ids = np.array(self._library(["".join(own) if spaced else "".join([p + "\n" for p in own])])[0], np.uint32)
            if spaced:
                ends = np.append(np.flatnonzero(self.opens[ids])[1:], len(ids))
            else:
                glue = ids == self.newline
                ends, ids = np.cumsum(~glue)[glue], ids[~glue]
            if len(ends) != len(own):
                alone = self._library(own)
                ends, ids = np.cumsum([len(x) for x in alone]), np.array([i for x in alone for i in x], np.uint32)
            new = self.numbers.add(hashes[which])
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            while self.numbers.count > len(self.at):
                self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
            self.pool[self.used : self.used + len(ids)] = ids
            sizes = np.diff(ends, prepend=0)
            self.at[new], self.size[new] = self.used + ends - sizes, sizes
            self.used += len(ids)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of them in each text."""
        if self.numbers.count > PIECES_KEPT:
            self.forget()
        t = Flat(column)
        data, n = t.data, len(t.data)
        space, line = data == 32, data == 10
        begins = t.off[:-1][t.off[:-1] < n]
        bad = rare_space(data) if n else np.zeros(0, bool)
        if n:
            gap = space | line
            bad[1:] |= gap[1:] & gap[:-1] & (space[1:] | space[:-1])  # runs of spaces and newlines, but for newlines alone
            bad[2:] |= line[2:] & line[1:-1] & line[:-2]
            last = t.off[1:][t.off[1:] > 1] - 1
            bad[last] |= line[last] & line[last - 1]
        whole = (t.sums(bad) > 0) | (not self.cuts)
        raw = data.tobytes() if any(s[:2] in data.tobytes() for s in self.special) else b""
        if raw:
            whole |= np.array([any(s in raw[a:b] for s in self.special) for a, b in zip(t.off, t.off[1:])], bool)

        first = space | line
        first[1:] |= line[:-1]
        first[begins] = True
        ends_word = _MARK[data]
        ends_word[1:] &= _LETTER[data[:-1]]
        ends_word[:-1] &= first[1:]
        ends_word[begins] = False
        first |= ends_word
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], n)
        off = np.searchsorted(starts, t.off)
        if whole.any():
            keep = np.repeat(~whole, np.diff(off))
            off = np.concatenate([[0], np.cumsum(np.where(whole, 0, np.diff(off)))])
            starts, ends = starts[keep], ends[keep]
        h = t.spans(starts, ends)
        which = self.numbers.find(h)
        new = np.flatnonzero(which < 0)
        if len(new):
            hashes, at = np.unique(h[new], return_index=True)
            at = new[at]
            raw = data.tobytes()
            self._learn(hashes, [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            which[new] = self.numbers.find(h[new])
        sizes = self.size[which]
        ids = self.pool[ragged(self.at[which], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[off]
        n_ids = np.diff(ends)
        if whole.any():
            parts = [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]
            these = np.flatnonzero(whole).tolist()
            for i, own in zip(these, self._library([column[i].as_py() for i in these])):
                parts[i] = np.array(own, np.uint32)
            ids, n_ids = np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, n_ids


@lru_cache(1)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


# ---------------------------------------------------------------- the operator

PLAIN = "doc_id long, tie long, n long, ids binary, counts array<long>"


def _tokenized(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.list_(pa.int64()))])
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for part in chunks(batch):
                ids, sizes = encoder(path)(part.column("text"))
                ends = np.cumsum(sizes)
                parts = [ids[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
                blobs = [np.append(x, np.uint32(end_id)).astype("<u4") for x in parts]
                more = np.bincount(ids, minlength=end_id + 1)
                more[end_id] += len(parts)
                counts, more = (np.concatenate([x, np.zeros(max(len(counts), len(more)) - len(x), np.int64)]) for x in (counts, more))
                counts = counts + more
                small = [x.astype("<u2") if x.max() < 1 << 16 else x for x in blobs]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), pa.array(sizes + 1), pa.array([x.tobytes() for x in small], pa.binary()), pa.nulls(len(parts), pa.list_(pa.int64()))], schema=schema)
        yield pa.RecordBatch.from_pylist([{"counts": counts.tolist()}], schema=schema)

    return run


def _raw(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4")


def _ranked(rank_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [encode_ranks(rank_of[_raw(b, n)]) for b, n in zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("doc_id"), batch.column("tie"), batch.column("n"), *(pa.array(x, pa.binary()) for x in (list(zip(*coded)) or [[], []]))], ["shard", "doc_id", "tie", "n", "control", "data"])

    return run


def _shards(folder: str, before: dict[int, int], ranks: int):
    """Write runs of equal ``shard``; rows come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, docs, start = None, None, [], 0

        def close() -> pa.RecordBatch:
            footer = json.dumps({"ranks": ranks, "docs": docs}).encode()
            out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
            out.close()
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": [f"{folder}/shard-{shard}.ids"], "docs": pa.array([len(docs)], pa.int64()), "bytes": pa.array([out.size], pa.int64())})

        for batch in batches:
            for s, doc_id, n, control, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n", "control", "data"))):
                if s != shard:
                    if out:
                        yield close()
                    shard, docs, start = s, [], before[s]
                    out = WholeFile(f"{folder}/shard-{s}.ids")
                    out.write(MAGIC)
                docs.append([doc_id, start, n, len(control), len(data), out.write(control + data)])
                start += n
        if out:
            yield close()

    return run


@lru_cache(1)
def _ranks(path: str, crc: int) -> np.ndarray:
    with open_file(path) as file:
        data = file.read()
    if zlib.crc32(data) != crc:
        raise ValueError(f"{path} is not the table of these shards")
    return np.frombuffer(data, "<u4")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with open_file(path) as file:
                size = file.size()
                tail = file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
                length = int.from_bytes(tail[:8], "little")
                footer = json.loads(file.read_at(length, size - 8 - len(MAGIC) - length))
                if tail[8:] != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
                    raise ValueError(f"{path} is not a shard of ids")
                id_of, rows = _ranks(path.rsplit("/", 1)[0] + "/ranks", footer["ranks"]), []
                for doc_id, start, n, control, data, at in footer["docs"]:
                    body = file.read_at(control + data, at)
                    rows.append((doc_id, start, n, id_of[decode_ranks(body[:control], body[control:], n)].tobytes()))
                    if len(rows) == 256:
                        yield _out(rows)
                        rows = []
                yield _out(rows)


def _out(rows: list) -> pa.RecordBatch:
    ids, starts, sizes, blobs = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, docs_a_shard: int = 2000) -> DataFrame:
    """Tokenize ``docs`` and write shards under ``folder``; returns the manifest (shard, path, docs, bytes).

    Texts are read and tokenized once where they lie.  Only coded ids are shuffled, into ranges of doc_id cut at
    quantiles and then evenly; the driver sees a count for each id of the vocabulary and a sum for each shard.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    raw = written(plain.mapInArrow(_tokenized(path, end_id), PLAIN), "token-ids", "zstd")
    counts = raw.filter("counts is not null").select(F.posexplode("counts").alias("id", "n")).filter("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
    seen = counts.orderBy(F.desc("n"), "id").toPandas()  # as many rows as the vocabulary at most
    id_of = seen["id"].tolist()
    rank_of = np.zeros(max(id_of, default=0) + 1, np.uint32)
    rank_of[id_of] = np.arange(len(id_of))

    rows = raw.filter("ids is not null")
    rows = rows.withColumn("shard", range_of(rows.select("doc_id"), "doc_id", docs_a_shard))
    before, total = {}, 0
    for shard, n in sorted(map(tuple, rows.groupBy("shard").agg(F.sum("n")).collect())):  # a row a shard, whose number is bounded
        before[shard], total = total, total + n
    n_parts = max(1, min(len(before), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    coded = rows.select("shard", "doc_id", "tie", "n", "ids").mapInArrow(_ranked(rank_of), "shard long, doc_id long, tie long, n long, control binary, data binary")
    coded = coded.repartition(n_parts, "shard").sortWithinPartitions("shard", "doc_id", "tie")
    table = np.array(id_of, "<u4").tobytes()
    out = WholeFile(f"{folder}/ranks")
    out.write(table)
    out.close()
    manifest = written(coded.mapInArrow(_shards(folder, before, zlib.crc32(table)), "shard long, path string, docs long, bytes long"), "token-shards")
    drop_tables(raw)
    return manifest


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the ids of each document as little-endian unsigned 32-bit integers."""
    spark = manifest.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n, "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")


def op7_token_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), fresh(spark, "id-shards"))
    return read_ids(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
