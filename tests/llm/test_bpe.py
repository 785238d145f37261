import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitchweave.llm.bpe import Encoder, PairTable, encode_corpus, encode_pieces, load_ranks

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def pair():
    ranks = load_ranks(P.path("byte_bpe_50k.tiktoken"))
    return Encoder(PairTable.build(ranks, P.PATTERN)), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(pair, text):
    ours, theirs = pair
    assert ours.encode([text]) == [theirs.encode_ordinary(text)]


def test_spaces_marks_and_long_runs(pair):
    ours, theirs = pair
    rnd = random.Random(0)
    texts = ["".join(rnd.choice("ab é\n\t  '’s'll12½—汉🙂　\x1c\x85\xa0ZQ.!<|endoftext|>") for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    texts += ["a" * n for n in (1, 255, 256, 257, 3000)] + ["".join(rnd.choice("abcdefgh") for _ in range(20_000)), "<|endoftext|>"]
    assert ours.encode(texts) == [theirs.encode_ordinary(t) for t in texts]


def test_a_small_vocabulary_of_many_lengths():
    vocabulary = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abab": 257, b"ba": 258, b"aa": 259}
    table = PairTable.build(vocabulary, r"\S+|\s+")
    pieces = [b"", b"a", b"abab", b"aabab", b"bababa", b"ab" * 400]
    enc = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=vocabulary, special_tokens={})
    assert encode_pieces(pieces, table) == [enc.encode_ordinary(p.decode()) for p in pieces]


def test_whole_table_with_nulls_and_repeats(spark, pair):
    _, theirs = pair
    rows = [(1, "Hello  world", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello  world", "x"), (None, "ſmall ¬", "x"), (5, "word " * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode_corpus(df, batch_chars=1000).collect()
    assert sorted((r.doc_id or 0, list(r.ids)) for r in out) == sorted((d or 0, theirs.encode_ordinary(t or "")) for d, t, _ in rows)
    assert encode_corpus(df.limit(0)).count() == 0
    assert base64.b64decode("YQ==") == b"a"
