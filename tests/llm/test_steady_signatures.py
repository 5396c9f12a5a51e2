"""Spot signatures change in proportion to an edit at any number of anchors."""

import random

from test_spotsigs import chains, signatures

from loanloom.llm import queries
from loanloom.llm.spotsigs import near_pairs

SCHEMA = "doc_id bigint, text string"


def text_with_anchors(n, words=600):
    """Distinct words, ``n`` of which follow an anchor."""
    return " ".join(f"the word{k}" if k < n else f"word{k}" for k in range(words))


def test_one_word_keeps_pairs_near(spark):
    for n in (0, 7, 8, 60):
        texts = [text_with_anchors(n + 1), text_with_anchors(n)]
        (link,) = near_pairs(spark.createDataFrame(list(enumerate(texts)), SCHEMA), 0.8)[1].collect()
        assert (link["left_id"], link["right_id"]) == (0, 1) and link["likeness"] > 0.9


def test_registered_query_is_steady_at_every_number_of_anchors(spark, tmp_path):
    # each text is followed by one with one anchor less
    rows = [(n, text_with_anchors(16 - n)) for n in range(17)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op1_spot_signatures(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for n in range(16):
        assert got[n]["near_next"] > 0.9, n
        assert got[n]["near_edited"] > 0.5, n


def test_chains_are_most_signatures_of_prose():
    """One word in eight is an anchor, as in English."""
    rng = random.Random(5)
    words = ["the"] * 6 + ["was"] * 3 + ["of", "and"] * 2 + [f"w{i}" for i in range(59)]
    text = " ".join(rng.choice(words) for _ in range(2000))
    assert len(chains(text)[1]) > 0.6 * len(signatures(text))
