"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes symbols, one a character, and an agenda of adjacent pairs that are pieces: the best score first, the leftmost
among equals.  The best pair is merged and its neighbours enter the agenda, until none is left; characters outside the
vocabulary fall back to their bytes.  No piece of such a vocabulary goes on past a word's end into the next ``▁``, so texts
are cut there, each distinct word is merged once, and many words' agendas advance together as numpy rows.  Longer chunks
use a heap.  In every Arrow batch the words not met before are checked against the ``sentencepiece`` library, which also
decodes the ids.

Null texts count as empty; empty texts have no ids.  Rows are independent: repeats, ties and hot sources need no care.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ._text import U64, Flat, Numbers, chunks, mix, ragged, settle

ROW = 24  # characters of the words that are merged as rows
GROUPS = (5, 8, 12, ROW)  # words of like length share a matrix
WORDS_KEPT = 1_500_000
MARKS = ",.;:!?"
_MARK, _LETTER = (np.isin(np.arange(256), list(x)) for x in (MARKS.encode(), bytes(range(65, 91)) + bytes(range(97, 123))))
NEVER = np.int64(1 << 40)
_CHUNKS = re.compile("▁*[^▁]+|▁+$")


class Agenda:
    """The merges of one model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        sp, n = self.library, self.library.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        names = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(names) if not special[i]}
        if any("▁" in p.lstrip("▁") for p in self.ids):
            raise ValueError("a piece goes on past the end of a word; texts can't be cut at words")
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.rank = np.array([NEVER if special[i] else order[sp.get_score(i)] for i in range(n)], np.int64)
        pairs = sorted((self.ids[p[:k]] * n + self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.n, self.keys, self.merged = n, np.array([k for k, _ in pairs] + [1 << 62]), np.array([i for _, i in pairs] + [0])
        self.decimal = list(map(str, range(n)))
        #: no piece holds a mark after a letter, or a newline beside anything: texts can be cut there
        self.marks_apart = not any(b in MARKS and a.isalpha() for p in self.ids for a, b in zip(p, p[1:]))
        self.lines_apart = not any("\n" in p for p in self.ids if len(p) > 1)
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        self.pool, self.at, self.size, self.wrong = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, bool)
        self.used = 0

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each pair makes, and its place in the agenda (NEVER: none)."""
        keys = np.where((left >= 0) & (right >= 0), left * self.n + right, -1)
        at = np.searchsorted(self.keys, keys)
        piece = self.merged[at]
        return piece, np.where(self.keys[at] == keys, self.rank[piece], NEVER)

    def _bytes(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()]

    def merge_long(self, chunk: str) -> list[int]:
        """One chunk's agenda as a heap of (rank, position); entries whose symbols have changed are skipped."""
        symbols = [self.ids.get(c, -1 - ord(c)) for c in chunk]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def enter(i: int, j: int) -> None:
            if symbols[i] >= 0 and symbols[j] >= 0:
                key = symbols[i] * self.n + symbols[j]
                at = int(np.searchsorted(self.keys, key))
                if self.keys[at] == key:
                    heapq.heappush(heap, (int(self.rank[self.merged[at]]), i, j, key, int(self.merged[at])))

        for i in range(n - 1):
            enter(i, i + 1)
        gone = [False] * n
        while heap:
            _, i, j, key, piece = heapq.heappop(heap)
            if gone[i] or gone[j] or after[i] != j or symbols[i] * self.n + symbols[j] != key:
                continue
            symbols[i], gone[j], after[i] = piece, True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                enter(i, after[j])
            if before[i] >= 0:
                enter(before[i], i)
        return list(chain.from_iterable([s] if s >= 0 else self._bytes(chr(-1 - s)) for s, x in zip(symbols, gone) if not x))

    def merge_rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many short words: in each round every row takes the head of its agenda."""
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        points = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), width)
        distinct, at = np.unique(points, return_inverse=True)
        symbols = np.array([self.ids.get(chr(c), -2 - c) for c in distinct.tolist()], np.int64)[at].reshape(points.shape)
        symbols[np.arange(width) >= sizes[:, None]] = -1
        done, left = symbols.copy(), sizes.copy()
        rows = np.flatnonzero(sizes > 1)
        live = symbols[rows]
        piece, rank = self._pairs(live[:, :-1], live[:, 1:])
        column = np.arange(width)
        while len(rows):
            best = rank.argmin(1)
            row = np.arange(len(rows))
            more = rank[row, best] < NEVER
            if not more.all():
                done[rows[~more]], rows, live, piece, rank, best = live[~more], rows[more], live[more], piece[more], rank[more], best[more]
                row = np.arange(len(rows))
                if not len(rows):
                    break
            live[row, best] = piece[row, best]
            shift = np.minimum(column + (column > best[:, None]), width - 1)
            live = np.take_along_axis(live, shift, 1)
            live[:, -1] = -1
            shift = np.minimum(shift[:, :-1], width - 2)
            piece, rank = np.take_along_axis(piece, shift, 1), np.take_along_axis(rank, shift, 1)
            rank[:, -1] = NEVER
            left[rows] -= 1
            for place in (best - 1, best):
                ok = np.flatnonzero((place >= 0) & (place < width - 1))
                p, r = self._pairs(live[ok, place[ok]], live[ok, place[ok] + 1])
                piece[ok, place[ok]], rank[ok, place[ok]] = p, r
        real = np.arange(width) < left[:, None]
        flat = done[real]
        if (flat < 0).any():  # characters outside the vocabulary, as bytes
            parts = [[s] if s >= 0 else self._bytes(chr(-2 - s)) for s in flat.tolist()]
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[np.concatenate([[0], np.cumsum(left)])]
            return np.array(list(chain.from_iterable(parts)), np.int64), np.diff(ends)
        return flat, left

    def learn(self, hashes: np.ndarray, spelt: list[str], asked: list[tuple[str, int]]) -> None:
        """Merge ``spelt`` and number them.  ``asked``: a text whose ids the library must end alike, and how many come before."""
        length, low = np.array([len(w) for w in spelt], np.int64), 0
        for high in (*GROUPS, None):
            own = np.flatnonzero((length > low) & (length <= (high or length.max(initial=0)))).tolist()
            low = high
            if not own:
                continue
            if high:
                flat, sizes = self.merge_rows([spelt[i] for i in own])
            else:
                heaps = [self.merge_long(spelt[i]) for i in own]
                flat, sizes = np.array(list(chain.from_iterable(heaps)), np.int64), np.array([len(x) for x in heaps], np.int64)
            new, ends = self.numbers.add(hashes[own]), np.cumsum(sizes)
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            while self.numbers.count > len(self.at):
                self.at, self.size, self.wrong = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.wrong))
            self.pool[self.used : self.used + len(flat)] = flat
            self.at[new], self.size[new] = self.used + ends - sizes, sizes
            self.used += len(flat)
            flat, ends = flat.tolist(), ends.tolist()
            theirs = self.library.encode([asked[i][0] for i in own], num_threads=1)
            self.wrong[new] = [x[asked[i][1] :] != flat[a:b] for i, x, a, b in zip(own, theirs, [0, *ends], ends)]

    def _cut(self, t: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, bare, offsets of texts) of words, each with the space before it; ``bare`` ones follow something else.

        A text's first word counts as after a space.  Texts with runs of spaces or ``▁`` are left out; see ``encode``.
        """
        data, n = t.data, len(t.data)
        space, begins = data == 32, t.off[:-1][t.off[:-1] < n]
        first, bare = space.copy(), np.zeros(n, bool)
        if self.lines_apart:
            line = data == 10
            bare |= line
            bare[1:] |= line[:-1]
        if self.marks_apart:
            mark = _MARK[data]
            mark[1:] &= _LETTER[data[:-1]]
            after = np.ones(n, bool)
            after[:-1] = (space | bare)[1:]
            after[t.off[1:][t.off[1:] > 0] - 1] = True
            bare |= mark & after
        bare &= ~space
        bare[begins] = False
        first |= bare
        first[begins] = True
        starts = np.flatnonzero(first)
        return starts, np.append(starts[1:], n), bare[starts], np.searchsorted(starts, t.off)

    def encode(self, column: pa.Array) -> tuple[list[list[int]], list[str], list[bool]]:
        """The ids of each text, the same as decimals joined by commas, and whether the library agrees on all its words."""
        if self.numbers.count > WORDS_KEPT:
            self.forget()
        t = Flat(column)
        data, n, raw = t.data, len(t.data), t.data.tobytes()
        run = np.zeros(n, bool)
        if n:
            space = data == 32
            run[1:] = space[1:] & space[:-1]
            run[t.off[:-1][t.off[:-1] < n]] = space[t.off[:-1][t.off[:-1] < n]]
            edge = t.off[1:][t.off[1:] > 0] - 1
            run[edge] |= space[edge]
        odd = t.sums(run) > 0
        if (at := np.flatnonzero(data == 0xE2)).size:
            at = at[(data[at + 1] == 0x96) & (data[at + 2] == 0x81)]
            odd[np.searchsorted(t.off, at, "right") - 1] = True
        starts, ends, bare, off = self._cut(t)
        h = t.spans(starts, ends)
        # a first word and the same one after a space are spelt alike
        lead = (data[starts] != 32) & ~bare
        h = np.where(bare, mix(h, 71), h)
        h[lead] = mix(h[lead], 72)
        if odd.any():
            keep = np.repeat(~odd, np.diff(off))
            off = np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(off)))])
            starts, ends, bare, lead, h = (x[keep] for x in (starts, ends, bare, lead, h))
        which = self.numbers.find(h)
        new = np.flatnonzero(which < 0)
        if len(new):
            hashes, at = np.unique(h[new], return_index=True)
            at = new[at]
            text = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            kinds = list(zip(text, bare[at].tolist()))
            spelt = [w if b else "▁" + w.removeprefix(" ") for w, b in kinds]
            self.learn(hashes, spelt, [("\n" + w, 2) if b else _asked(w.removeprefix(" ")) for w, b in kinds])
            which[new] = self.numbers.find(h[new])
        sizes = self.size[which].astype(np.int64)
        flat = self.pool[ragged(self.at[which], sizes)].tolist()
        ends = np.concatenate([[0], np.cumsum(sizes)])[off].tolist()
        same = np.diff(np.concatenate([[0], np.cumsum(self.wrong[which])])[off]) == 0
        ids = [flat[a:b] for a, b in zip(ends, ends[1:])]
        for i in np.flatnonzero(odd).tolist():
            ids[i], same[i] = self._encode_odd(column[i].as_py())
        return ids, [",".join([self.decimal[x] for x in own]) for own in ids], same.tolist()

    def _encode_odd(self, text: str) -> tuple[list[int], bool]:
        """A text with runs of spaces or ``▁``: each run goes with the word after it."""
        chunks_ = _CHUNKS.findall("▁" + text.replace(" ", "▁"))
        h = mix(np.fromiter((xxhash.xxh3_64_intdigest(c) for c in chunks_), U64, len(chunks_)), 73)
        new, at = np.unique(h[self.numbers.find(h) < 0], return_index=True)
        if len(new):
            missing = [chunks_[i] for i in np.flatnonzero(self.numbers.find(h) < 0)[at].tolist()]
            self.learn(new, missing, [_asked(c[1:]) for c in missing])
        which = self.numbers.find(h)
        return self.pool[ragged(self.at[which], self.size[which].astype(np.int64))].tolist(), not self.wrong[which].any()


def _asked(word: str) -> tuple[str, int]:
    """What to give the library for a word after ``▁``, which it puts first itself; it gives nothing for an empty text."""
    return (word, 0) if word else ("\n▁", 2)


@lru_cache(1)
def agenda(path: str) -> Agenda:
    return Agenda(path)


ADDED = [("n_tokens", LongType()), ("ids_sha256", StringType()), ("decoded_sha256", StringType()), ("matches_library", BooleanType())]


def with_pieces(docs: DataFrame, path: str, keep_ids: bool = False, whole_check: bool = False, keep_words: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256, matches_library, and with ``keep_ids`` piece_ids (array<int>).

    Each word is checked against the library when it is first met; ``whole_check`` also gives it every whole text, which
    takes about as long again.  Without ``keep_words`` a worker forgets its words with each task, for jobs that go on with
    something else.  Columns of ``docs`` that have one of these names are replaced; all others are carried by place.
    """
    kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_()] + [pa.list_(pa.int32())] * keep_ids
    names = [c for c, _ in ADDED] + ["piece_ids"] * keep_ids
    docs = docs.drop(*names)
    columns, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.rename_columns([f"c{i}" for i in range(len(columns))]).append_column("whole", batch.column(at).cast(pa.string()))
            for part in chunks(batch, "whole"):
                model = agenda(path)
                ids, joined, same = model.encode(part.column("whole"))
                if whole_check:
                    same = [a == b for a, b in zip(ids, model.library.encode(part.column("whole").to_pylist(), num_threads=1))]
                decoded = [model.library.decode(x) if x else "" for x in ids]
                sha = [[hashlib.sha256(x.encode()).hexdigest() for x in v] for v in (joined, decoded)]
                more = [[len(x) for x in ids], *sha, same] + [ids] * keep_ids
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(v, k) for v, k in zip(more, kinds))], [*part.schema.names[:-1], *(f"x{i}" for i in range(len(kinds)))])
        if not keep_words and agenda.cache_info().currsize:
            agenda(path).forget()
            settle()

    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)] + [StructField(f"x{i}", k) for i, (_, k) in enumerate(ADDED)])
    if keep_ids:
        schema = schema.add("x4", ArrayType(IntegerType()))
    return docs.mapInArrow(run, schema).toDF(*columns, *names)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("string").alias("text"))
    return with_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), whole_check=True).drop("text")
