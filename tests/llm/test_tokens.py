"""Encoding, decoding and counts against the tokenizer library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from loanloom.llm.pieces import encode_report, encoded, pieces, read_model
from loanloom.llm.token_counts import token_counts

MODEL = read_model(public_tokenizers.path("piece_bpe_32k.model"))
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
SCHEMA = "doc_id bigint, text string"
TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "two  blanks", "▁ own ▁▁mark", "line\nline\ttab", "日本語のテキスト😀", "é́ ß", "<s> </s> <unk> <0x41>",
    "x" * 5000, "=" * 900 + " " * 700 + "_" * 90, "The quick brown fox " * 3000, "nul \x00 char", "1234567890", "ha" * 301,
]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" ▁aeiouthnrs.,\n<>0")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_and_text_equal_the_library(text):
    own, theirs = pieces(MODEL).encode(text), LIBRARY.encode(text)
    assert own.tolist() == theirs
    assert pieces(MODEL).decode(own) == LIBRARY.decode(theirs)


def test_pairs_stay_when_merging_gives_them_again():
    vocabulary, rng = pieces(MODEL), random.Random(2)
    words = list(vocabulary.ids)
    for _ in range(4000):
        left, right = rng.choice(words), rng.choice(words)
        assert vocabulary.stays(left, right) == (vocabulary.merge(left + right)[0] == [left, right])


@pytest.mark.parametrize("ids", [[], [35, 40], [15, 33, 200, 201], [259, 259, 260], [1, 300, 2], [0, 5, 0]])
def test_decode_of_any_ids(ids):
    import numpy as np

    assert pieces(MODEL).decode(np.array(ids, np.int32)) == LIBRARY.decode(ids)


def test_report_on_edge_cases(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (3, "   "), (3, "   ")]
    got = sorted(map(tuple, encode_report(spark.createDataFrame(rows, SCHEMA), MODEL).collect()), key=str)
    want = []
    for doc_id, text in rows:
        ids = LIBRARY.encode(text or "")
        want.append((doc_id, len(ids), digest(",".join(map(str, ids))), digest(LIBRARY.decode(ids))))
    assert got == sorted(want, key=str)


def test_encoded_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", [1]), (2, None, None, None)], "doc_id bigint, text string, n_tokens string, extra array<int>")
    got = {r["doc_id"]: r for r in encoded(docs, MODEL).collect()}
    assert got[1]["ids"] == LIBRARY.encode("a b") and got[1]["n_tokens"] == "x" and got[2]["ids"] == []


def test_counts_equal_the_library(spark):
    rng = random.Random(4)
    many = [" ".join(rng.choice(["the", "of", f"w{rng.randrange(300)}", "", "ünd"]) for _ in range(rng.randrange(80))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(TEXTS + many)] + [(None, "no id"), (3, "   "), (3, "   "), (5, None)]
    got = sorted(map(tuple, token_counts(spark.createDataFrame(rows, SCHEMA), MODEL, limit=50).collect()), key=str)
    want = [(d, len((t or "").encode()), n := len(LIBRARY.encode(t or "")), n > 50) for d, t in rows]
    assert got == sorted(want, key=str)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_counts(empty, MODEL).collect() == [] and encode_report(empty, MODEL).collect() == []


def test_slices_of_token_counts_are_small(spark):
    """Twenty million characters in one task are packed in parts, not as one slice."""
    import public_tokenizers

    from loanloom.llm import token_counts as C

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    docs = spark.range(40, numPartitions=1).selectExpr("id as doc_id", "repeat('some words here ', 33333) as text")
    assert C.frequencies(docs, model, 3).select("slice").distinct().count() >= 3
