"""Spot signatures against a plain version."""

import hashlib
import random
import re

import pytest
import xxhash

from loanloom.llm.spotsigs import ANCHORS, SAMPLE, STOP_WORDS, compare_with_next, near_pairs

SCHEMA = "doc_id bigint, text string"


def hashed(*words):
    """Spark's hash of several strings: each seeds the next."""
    seed = 42
    for word in words:
        seed = xxhash.xxh64_intdigest(word.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def chains(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    content = [(k, w) for k, w in enumerate(words) if w not in STOP_WORDS]
    out = set()
    for k, w in enumerate(words):
        chain = [c for at, c in content if at > k][:2]
        if w in ANCHORS and chain:
            out.add(hashed(w, *chain, *[""] * (2 - len(chain))))
    return words, out


def signatures(text):
    words, out = chains(text)
    pairs = [hashed("*", a, b) for a, b in zip(words, words[1:] + [""], strict=False)]
    return out | {h for h in pairs if h % SAMPLE == 0} | ({min(pairs)} if pairs else set())


def printed(found):
    return "".join(f"{h & (1 << 64) - 1:016x}" for h in sorted(found))


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def corpus(n=40):
    rng = random.Random(3)
    words = ["the", "was", "la", "of", "and"] * 12 + [f"w{i}" for i in range(60)] + ["É", "don't", "X.Y"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([2, 9, 60, 200]))) for _ in range(n)]
    for k in range(0, n - 5, 5):
        copy = texts[k].split()
        copy[-1] = "changed"
        texts[k + 1] = " ".join(copy)
        texts[k + 2] = texts[k]
    return texts


def test_edited_texts_and_likeness(spark):
    texts = [None, "", "a", "the", "the the cat", *corpus(), "the long w1 text is w2 " * 9000]
    rows = [(3 * k, t) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in compare_with_next(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for (doc_id, text), (next_id, following) in zip(rows, rows[1:] + rows[:1]):
        text, following, r = text or "", following or "", got[doc_id]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        assert (r["n_chars"], r["next_id"]) == (len(text), next_id)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own = signatures(text)
        assert r["near_edited"] == pytest.approx(jaccard(own, signatures(edited)))
        assert r["near_next"] == pytest.approx(jaccard(own, signatures(following)))
        assert r["fingerprint"] == printed(own) and r["edited_fingerprint"] == printed(signatures(edited))


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "the cat sat", 1), (1, "the cat sat", 1), (None, "the dog ran", 2), (1, "another", 3), (2, None, 4)]
    got = compare_with_next(spark.createDataFrame(rows, SCHEMA + ", own int")).collect()
    assert len(got) == len(rows)
    same = [tuple(r) for r in got if r["doc_id"] == 1 and r["n_chars"] == 11]
    assert len(same) == 2 and same[0] == same[1]
    assert [r["next_id"] for r in got if r["doc_id"] is None] == [1] and [r["next_id"] for r in got if r["doc_id"] == 2] == [None]


def test_empty_and_single(spark):
    assert compare_with_next(spark.createDataFrame([], SCHEMA)).collect() == []
    one = compare_with_next(spark.createDataFrame([(7, "the red cat the blue")], SCHEMA)).collect()
    assert one[0]["next_id"] == 7 and one[0]["near_next"] == 1.0


def test_near_pairs_equal_brute_force(spark):
    texts = ["", *corpus(60)]
    members, links = near_pairs(spark.createDataFrame(list(enumerate(texts)), SCHEMA), 0.8)
    sets = [signatures(t) for t in texts]
    first = {}
    classes = {k: k if not s else first.setdefault(frozenset(s), k) for k, s in enumerate(sets)}
    assert {r["doc_id"]: r["class_id"] for r in members.collect()} == classes
    reps = sorted(set(k for k, c in classes.items() if k == c and sets[k]))
    want = {(a, b) for a in reps for b in reps if a < b and jaccard(sets[a], sets[b]) >= 0.8}
    assert want and {(r["left_id"], r["right_id"]) for r in links.collect()} == want
