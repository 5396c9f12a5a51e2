"""Document statistics, boosted trees and the subword classifier."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loanloom.llm.quality_classifier import classify, fit, scores
from loanloom.llm.quality_rules import COUNTS, counts_of, features, filtered, fit_trees, held_out, judge

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string"
TEXTS = [
    None, "", "  \n\t", "one", "a b c a b c a", "x y x y x y", "the same line\nthe same line\n\n \nother", "\n\n", "é😀 #*$ % & | < > !",
    "a\x1cb c d", "w " * 60, "UPPER lower", "a b a b c a b", "no newline no newline no", "last\nlast", "1 2 3 4 1 2 3 5 1 2 3",
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + d for i in range(len(words) - 2) for d in range(3) if windows[tuple(words[i : i + 3])] > 1}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_counts_equal_a_plain_reading():
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab  \n#é") for _ in range(rng.randrange(60))) for _ in range(600)]
    for text in texts:
        assert counts_of(text)[:5] == plain(text), repr(text)


def test_scores_fall_with_monotone_features():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 8))
    y = ((x[:, 2] + 0.3 * rng.random(3000) < 0.7) ^ (rng.random(3000) < 0.05)).astype(float)
    trees = fit_trees(x, y)
    assert ((trees.score(x) >= 0.5) == (y == 1)).mean() > 0.85
    base = rng.random((200, 8))
    for k in (2, 3, 4, 5, 6):
        last = np.full(200, np.inf)
        for value in np.linspace(0, 1, 21):
            base[:, k] = value
            now = trees.margin(base)
            assert (now <= last + 1e-9).all()
            last = now


def test_flat_trees_equal_a_walk_down_each_tree():
    rng = np.random.default_rng(1)
    x, y = rng.random((500, 8)), (rng.random(500) < 0.5).astype(float)
    trees = fit_trees(x, y, trees=5, depth=3)

    def walk(row):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        return total

    assert np.allclose(trees.margin(x), [walk(row) for row in x])


def test_rules_on_edge_cases(spark):
    rows = list(enumerate(TEXTS)) + [(None, "w " * 60), (3, "one")]
    docs = spark.createDataFrame([(d, t, 5, 6) for d, t in rows], SCHEMA + ", n_words int, score int")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = judge(docs, none).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r["doc_id"]]
        want = plain(text)
        assert tuple(r[c] for c in COUNTS[:5]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r["kept"] == (not r["base_failed"])
    assert judge(spark.createDataFrame([], SCHEMA), none).collect() == []
    clean = " ".join(f"w{k}" for k in range(80))
    kept = filtered(spark.createDataFrame([(1, clean, 1), (2, None, 2), (2, "short", 3)], SCHEMA + ", kept int"), none)
    assert [tuple(r) for r in kept.collect()] == [(1, clean, 1)]


def test_rules_and_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    known = {r["doc_id"]: r["quality"] for r in labels.where(held_out()).collect()}
    for frame in (judge(docs, labels), classify(docs, labels)):
        rows = [r for r in frame.collect() if r["doc_id"] in known]
        assert len(rows) == len(known)
        assert np.mean([(r["score"] >= 0.5) == (known[r["doc_id"]] == 1) for r in rows]) >= 0.95
        assert min(r["score"] for r in rows) >= 0 and max(r["score"] for r in rows) <= 1


def test_held_out_labels_never_train(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    for operator in (judge, classify):
        rows = [{(r["doc_id"], r["score"]) for r in operator(docs, known).collect()} for known in (labels, flipped)]
        assert rows[0] == rows[1]


def test_classifier_edge_cases(spark):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (3, "one")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA + ", held_out string")
    for labelled in ([], [(3, 1), (4, 1)]):
        labels = spark.createDataFrame(labelled, "doc_id bigint, quality int")
        got = classify(docs, labels).collect()
        assert len(got) == len(rows) and len({r["score"] for r in got}) == 1
        assert all(r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert classify(spark.createDataFrame([], SCHEMA), labels).collect() == []


def test_scores_do_not_depend_on_the_slice():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["good", "bad!!", "ok", "###"]) for _ in range(rng.randrange(30))) for _ in range(80)]
    model = fit(texts, np.array([float("###" not in t) for t in texts]))
    assert np.allclose(scores(model, texts), [scores(model, [t])[0] for t in texts])


def test_features_are_finite():
    assert np.isfinite(features(np.array([counts_of(t) for t in TEXTS]))).all()
