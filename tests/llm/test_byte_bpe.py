import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lectern.llm import byte_bpe


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "\n\n \n", "don't stop, we're 12,345 tall!!", "é" * 700, "x" * 3000, " " * 900, "a  b   c \n\n d " * 200,
    "word's 've 'r 're" * 90, "日本語テキスト。" * 60, "!?" * 500, "1234567890" * 80, "<|endoftext|> mixed\tçà 😀 ️" * 40,
]


def test_stitching_equals_one_pass():
    c = byte_bpe.codec()
    rng = np.random.default_rng(3)
    alphabet = list("ab's' ré1\n \t!,")
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet, rng.integers(1, 400))) for _ in range(300)]
    for text in texts:
        for chunk, overlap in ((16, 4), (7, 1), (40, 40)):
            rows = list(byte_bpe._chunk_rows(1, text, chunk, overlap))
            chunks = [(s, t, byte_bpe.boundaries(t, c.pattern, last)) for _, _, _, last, s, t in rows]
            assert list(byte_bpe.stitch(chunks, c.pattern)) == c.pattern.findall(text)


def test_equals_the_library(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(7, TEXTS[8], "y"), (7, TEXTS[8], "y"), (None, "null id " * 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    got = byte_bpe.encode_documents(docs, chunk=100, overlap=16).collect()

    def want(key, text):
        ids = library.encode_ordinary(text or "")
        return (key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())

    assert sorted(map(str, map(tuple, got))) == sorted(str(want(k, t)) for k, t, _ in rows)


def test_empty_table(spark):
    assert byte_bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decode_column(spark):
    docs = spark.createDataFrame([(1, "héllo  wörld"), (2, None)], "doc_id long, text string")
    rows = byte_bpe.encode_documents(docs, ids=True).withColumn("raw", byte_bpe.decode_column("token_ids")).collect()
    assert {r.doc_id: bytes(r.raw) for r in rows} == {1: "héllo  wörld".encode(), 2: b""}
