import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lagscope.llm.token_store import Encoder, read_tokens, token_store, write_tokens
from lagscope.llm.wavelet import Shard, write_shard

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(rows):
    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_against_one_by_one(spark, texts):
    rows = [r for r in dict.fromkeys(texts) if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as part")
    assert sorted(map(tuple, token_store(docs, PATH).collect())) == plain(rows)


def test_nulls_and_repeated_rows(spark, texts):
    got = token_store(spark.createDataFrame(texts, "doc_id long, text string"), PATH).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id) == sorted((d, n, c) for d, _, n, c in plain(texts) if d)
    spans = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert len(got) == len(texts) and spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_many_files(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(300)]
    manifest = write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH, str(tmp_path), shard_tokens=50).cache()
    assert sorted(map(tuple, read_tokens(manifest, str(tmp_path)).collect())) == plain(rows)


def test_empty(spark):
    assert token_store(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_encoder_on_odd_texts():
    rng = random.Random(0)
    texts = ["", " ", "  ", " x", "x ", "a  b   c", "\n\n a\tb ", "it's don'tx 's", "a\x1cb", "<|endoftext|> a b<|endoftext|>", "x 　 y", "a  b", "a \xa0 b", "é, ñ. ü!"]
    texts += ["".join(rng.choice("ab 1'\n\t!\x1cé,.  stß\U0001f600") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    encoder, tokenizer = Encoder(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):  # the second time from what is kept
        ids, n = encoder.encode(pa.array(texts))
        ends = np.cumsum(n)
        assert [ids[a:b].tolist() for a, b in zip(ends - n, ends, strict=True)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("kind", ["skewed", "constant", "wide", "none"])
def test_wavelet_matrix(kind):
    rng = np.random.default_rng(3)
    ids = {"skewed": rng.zipf(1.3, 5000) % 50257, "constant": np.full(1500, 7), "wide": rng.integers(0, 1 << 20, 2000), "none": np.zeros(0, np.int64)}[kind]
    shard = Shard(write_shard([3, None], np.array([len(ids), 0]), ids))
    assert (shard.tokens() == ids).all() and shard.doc_ids == [3, None] and shard.n == len(ids)
    assert [shard.access(i) for i in range(0, len(ids), 97)] == ids[::97].tolist()
    for token in {*ids[:20].tolist(), 0, 50256, 1 << 25}:
        where = np.flatnonzero(ids == token)
        assert shard.count(token) == len(where) and shard.occurrences(token)[:60] == where[:60].tolist()
        assert shard.rank(token, len(ids) // 2) == (where < len(ids) // 2).sum()
