import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from lagscope.llm.sentencepiece_fst import Transducer, decode_ids, encode_documents, with_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def machine():
    return Transducer(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts(n=1500):
    rng = random.Random(0)
    parts = ["the", "ing", " ", "  ", "\n", "é", "日", "\U0001f600", "1", "a", "b", "▁", "er", "on", "ñ", ".", "<s>", "<0x41>", "\x00"]
    fixed = ["", " ", "  ", "  a   b ", "\n\t x", "▁a ▁▁ b", "a▁ b", "a ▁b", "日本語テキスト", "</s> <unk>", "12345 67", "ß" * 50, "a" * 60]
    return fixed + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_same_ids_and_texts_as_the_library(machine, library):
    texts = odd_texts()
    assert [machine.encode(t) for t in texts] == [library.encode(t) for t in texts]
    assert [machine.decode(machine.encode(t)) for t in texts] == [library.decode(library.encode(t)) for t in texts]
    ids, n = machine.encode_batch(pa.array(texts))
    ends = np.cumsum(n)
    assert [ids[a:b].tolist() for a, b in zip(ends - n, ends, strict=True)] == [library.encode(t) for t in texts]
    assert machine.decode_batch(ids, n).to_pylist() == [library.decode(library.encode(t)) for t in texts]


def test_decoding_of_any_ids(machine, library):
    rng = random.Random(1)
    rows = [[rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(1, 259) for _ in range(rng.randint(0, 12))] for _ in range(1000)]
    rows = [[i for i in r if i] for r in rows]
    assert [machine.decode(r) for r in rows] == [library.decode(r) for r in rows]


def test_unigram_weights(machine):
    """With summed scores the search finds the cheapest of all paths."""
    rng = random.Random(2)
    small = Transducer.__new__(Transducer)
    small.ids = {p: i for i, p in enumerate(["a", "b", "ab", "ba", "aba", "bab", "bb"])}
    small.scores, small.bytes, small.unknown = [-3.0, -2.5, -4.0, -3.9, -6.5, -6.0, -4.2], {}, 99
    small.trie = {}
    for p, i in small.ids.items():
        state = small.trie
        for c in p:
            state = state.setdefault(c, {})
        state[""] = i

    def cheapest(text):
        if not text:
            return 0.0
        return min(cheapest(text[len(p) :]) - small.scores[i] for p, i in small.ids.items() if text.startswith(p))

    for _ in range(50):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        assert -sum(small.scores[i] for i in small._viterbi(text)) == pytest.approx(cheapest(text))
    assert small._viterbi("acb") == [0, 99, 1]


def test_rows(spark, library, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as decoded")
    got = sorted((tuple(r) for r in encode_documents(docs, PATH).collect()), key=str)
    want = [(d, None if t is None else library.encode(t), None if t is None else len(library.encode(t)), None if t is None else True) for d, t in texts]
    assert got == sorted(want, key=str)
    whole = with_pieces(docs.drop("decoded"), PATH)
    again = decode_ids(whole.withColumnRenamed("decoded", "first"), PATH).collect()
    assert all(r.first == r.decoded == r.text for r in again)


def test_empty(spark):
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
