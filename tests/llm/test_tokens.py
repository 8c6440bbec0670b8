from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from rangeweave.llm import pieces, token_ids
from rangeweave.llm._text import Numbers

from .helpers import ODD, by_id, documents, noise, saved

BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def library_ids(texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(BPE).encode_batch_fast(texts, add_special_tokens=False)]


def test_ids_query_equals_the_library(spark, tmp_path):
    texts = noise(6, 100)
    got = by_id(token_ids.op7_token_ids(spark, saved(documents(spark, texts, 10), tmp_path)))
    start = 0
    for i, own in enumerate(library_ids([t or "" for t in texts])):
        own = np.array([*own, 2], "<u4")
        r = got[10 + i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)


def test_encoder_on_random_joins_of_odd_parts():
    r = random.Random(1)
    parts = ["a", "b", "é", "漢", "1", "23", " ", "  ", "\n", "\n\n", "\t", "\xa0", " ", "　", "\x85", "'s", "I'll", ".", ",", "x,", "!", "—", "<|endoftext|>", "\x1c", "\x01"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)] + ODD
    ids, sizes = token_ids.PieceEncoder(BPE)(pa.array(texts))
    ends = np.cumsum(sizes)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes)] == library_ids(texts)


def test_encoder_of_a_tokenizer_that_breaks_otherwise():
    from tokenizers import Tokenizer

    path, texts = public_tokenizers.path("word_bpe_49k.json"), [t or "" for t in noise(9, 60)] + ODD
    encoder = token_ids.PieceEncoder(path)
    ids, sizes = encoder(pa.array(texts))
    assert not encoder.cuts and token_ids.PieceEncoder(BPE).cuts
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [x.ids for x in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_variable_length_code_round_trip(n):
    r = np.random.default_rng(n)
    ranks = (r.integers(0, 256, n).astype(np.uint64) << (8 * r.integers(0, 4, n).astype(np.uint64))).astype(np.uint32)
    ranks[: n // 8] = 2**32 - 1
    control, data = token_ids.encode_ranks(ranks)
    assert len(control) == -(-n // 4) and (token_ids.decode_ranks(control, data, n) == ranks).all()


def test_repeated_ids_nulls_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(3, "b"), (3, "a"), (1, None), (None, "x")], "doc_id long, text string")
    manifest = token_ids.write_ids(docs, BPE, (tmp_path / "a").as_uri())
    got = sorted(((r.doc_id, r.start, r.n_tokens) for r in token_ids.read_ids(manifest).collect()), key=lambda r: r[1])
    assert [(d, n) for d, _, n in got] == [(None, 2), (1, 1), (3, 2), (3, 2)] and [s for _, s, _ in got] == [0, 2, 3, 5]
    empty = token_ids.write_ids(docs.limit(0), BPE, (tmp_path / "b").as_uri())
    assert token_ids.read_ids(empty).count() == 0


def test_damaged_shards_are_refused(spark, tmp_path):
    manifest = token_ids.write_ids(documents(spark, ["a b c"]), BPE, tmp_path.as_uri())
    path = manifest.first().path.removeprefix("file://")
    with open(path, "r+b") as f:
        f.write(b"XX")
    with pytest.raises(Exception, match="is not a shard"):
        token_ids.read_ids(manifest).collect()
    manifest = token_ids.write_ids(documents(spark, ["a b c"]), BPE, (tmp_path / "other").as_uri())
    (tmp_path / "other" / "ranks").write_bytes(b"")
    with pytest.raises(Exception, match="is not the table"):
        token_ids.read_ids(manifest).collect()


def test_numbers():
    n = Numbers(8)
    h = np.random.default_rng(0).integers(1, 1 << 63, 150, dtype=np.uint64)
    assert (n.find(h) == -1).all()
    assert (n.add(h) == np.arange(150)).all() and (n.find(h[::-1]) == np.arange(150)[::-1]).all()
    assert (n.find(h + np.uint64(1)) == -1).all()


def test_pieces_query_equals_the_library(spark, tmp_path):
    from sentencepiece import SentencePieceProcessor

    sp, texts = SentencePieceProcessor(model_file=MODEL), noise(8, 100)
    got = by_id(pieces.op2_sentencepiece(spark, saved(documents(spark, texts), tmp_path)))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
        assert got[i].matches_library


def test_agenda_on_random_joins_of_odd_parts():
    r = random.Random(2)
    parts = ["a", "th", "er", "ing", "é", "漢", "😀", "1", " ", "  ", "▁", "▁▁", "\n", "\t", "\x00", "\x01", ".", ",", "aaaaaaaa"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ODD
    model = pieces.Agenda(MODEL)
    ids, joined, same = model.encode(pa.array(texts))
    assert ids == model.library.encode(texts) and all(same)
    assert joined == [",".join(map(str, x)) for x in ids]
    rows = ["th", "thing", "aéa", "1漢ing", "erereraath", "x"]
    for w in rows:
        flat, _ = model.merge_rows(["▁" + w])
        assert flat.tolist() == model.merge_long("▁" + w)


def test_pieces_keep_columns(spark):
    docs = spark.createDataFrame([("a b", 1, None), (None, 2, "y")], "text string, n_tokens int, x0 string")
    out = pieces.with_pieces(docs, MODEL, keep_ids=True, whole_check=True)
    # a column with an added one's name is replaced, since a table cannot hold both
    assert out.columns[:3] == ["text", "x0", "n_tokens"] and len(set(out.columns)) == len(out.columns)
    rows = {r.x0: r for r in out.collect()}
    assert (rows[None].text, rows[None].n_tokens, len(rows[None].piece_ids)) == ("a b", 2, 2) and rows[None].matches_library
    assert (rows["y"].text, rows["y"].n_tokens, rows["y"].piece_ids) == (None, 0, [])
    assert pieces.with_pieces(docs.limit(0), MODEL).count() == 0
