"""Byte-level BPE against the library, and chunks against whole texts."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loanloom.llm.byte_bpe import ByteBPE, encode_report, encoded, long_pieces
from loanloom.llm.pieces import read_model

RANKS = read_model(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
LIBRARY = tiktoken.Encoding(
    "test", pat_str=PATTERN, special_tokens={},
    mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())},
)
OWN = ByteBPE(RANKS, PATTERN)
SCHEMA = "doc_id bigint, text string, ids string, part int, row int"
ODD = ["'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "1", "23", "é", "ß", "中文", "ไทย", "😀", "!", "...", "the"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.characters(exclude_categories=["Cs"])), max_size=50).map("".join))
def test_ids_equal_the_library_and_bytes_come_back(text):
    ids = np.frombuffer(OWN.encode(text), OWN.kind)
    assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode()


def test_long_pieces_merge_as_in_the_library():
    for piece in ["ha" * 24, "ha" * 25, "zq" * 23 + "é", "ha" * 3000, "a" * 5001, "=" * 4000, "日本" * 900]:
        assert OWN.merge(piece.encode()) == LIBRARY.encode_ordinary(piece)


def texts_of(seed, n, size):
    rng = random.Random(seed)
    return ["".join(rng.choice([*ODD, "word", " another", " 'll", "x"]) for _ in range(rng.randrange(size))) for _ in range(n)]


def digests(text):
    ids = LIBRARY.encode_ordinary(text or "")
    listed = ",".join(map(str, ids))
    return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize(("stride", "overlap"), [(64, 24), (100, 64), (16_384, 1_024)])
def test_report_equals_the_library_at_any_chunk_size(spark, stride, overlap):
    texts = [
        None, "", " ", "a", *texts_of(3, 60, 400), "x" * 1000, " " * 700, "no blanks" * 50, "!" * 333, "'" * 500,
        " " * 63 + "word", "a" * 64, "a" * 65, "a b" * 6000, "日" * 40_000, "end " * 16, "last " * 13, "<|endoftext|>" * 9,
    ]
    docs = [*enumerate(texts), (None, texts[9]), (3, texts[20]), (3, texts[20])]
    rows = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], SCHEMA).repartition(3)
    got = encode_report(rows, RANKS, PATTERN, stride, overlap)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(d, *digests(t)) for d, t in docs], key=repr)


def test_chunks_stitch_and_only_a_giant_piece_joins_them(spark):
    plain, giant = "some words and 12 numbers, " * 40, "start " + "x" * 500 + " end of it " * 20
    rows = spark.createDataFrame([(1, plain), (2, giant)], "doc_id bigint, text string")
    got = long_pieces(rows, RANKS, PATTERN, 100, 40).collect()
    assert sorted(r["part"] for r in got if r["doc_id"] == 1) == list(range(11))
    assert [r["part"] for r in got if r["doc_id"] == 2] == [0]


def test_encoded_gives_ids(spark):
    texts = [None, "", "some text", *texts_of(5, 10, 300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in encoded(rows, RANKS, PATTERN, 64, 24).collect()}
    assert got == {i: LIBRARY.encode_ordinary(text or "") for i, text in enumerate(texts)}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert encode_report(none, RANKS, PATTERN).collect() == []
    assert encoded(none, RANKS, PATTERN).collect() == []
