"""Shards are a permutation; mixes meet their targets."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from loanloom.llm.mixing import mix, mix_report
from loanloom.llm.sharding import assign_shards, feistel, half_bits, permute

SCHEMA = "doc_id bigint, text string, source string"


@pytest.mark.parametrize("rows", [1, 2, 3, 4, 5, 17, 1000, 4096, 4097])
def test_permutation(rows):
    got = permute(np.arange(rows), rows, 9)
    assert sorted(got.tolist()) == list(range(rows))
    assert rows < 100 or (got != permute(np.arange(rows), rows, 10)).any()


def test_network_is_a_bijection_of_its_domain():
    bits = half_bits(200)
    assert sorted(feistel(np.arange(1 << 2 * bits, dtype=np.uint64), bits, 3).tolist()) == list(range(1 << 2 * bits))


def test_shards(spark):
    rows = [(k * 3, f"text {k % 7} é", 1) for k in range(500)] + [(None, None, 2), (6, "", 3), (6, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row int")
    got = assign_shards(docs).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(
        ((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows), key=str
    )
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = assign_shards(docs.repartition(5)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)
    assert assign_shards(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def water(sizes, weights=(5, 2, 1), limit=3):
    """Targets by sharing and resharing, as the rule is told."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        left = 0.0
        for s, words in share.items():
            target[s] += words
            if target[s] > limit * sizes[s]:
                left += target[s] - limit * sizes[s]
                target[s] = float(limit * sizes[s])
        open_ = {s for s in open_ if target[s] < limit * sizes[s]}
    return target


def corpus():
    rng = random.Random(8)
    rows = []
    for source, n in (("hot", 900), ("a", 60), ("b", 200), ("é", 300), (None, 40), ("one", 1), ("blank", 3)):
        for _ in range(n):
            words = 0 if source == "blank" else rng.randrange(1, 60)
            rows.append((len(rows), "\t".join(f"w{k}" for k in range(words)), source))
    return rows + [(None, None, "hot"), (99999, "x y", "a"), (99999, "x y", "a")]


def test_mix_meets_targets(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", copies int")
    source = {r[0]: r[2] for r in rows}
    got = mix_report(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for doc_id, text, s in rows:
        sizes[s] += len((text or "").split())
    for r in got:
        s = "a" if r["doc_id"] == 99999 else "hot" if r["doc_id"] is None else source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["source_size"] == sizes[s] and 0 <= r["taken"] <= 3 * r["size"]
        assert r["size"] == 0 or r["taken"] % r["size"] == 0
    want = water(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 120, s
    assert sorted(map(tuple, mix_report(docs.repartition(7)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_every_copy_number_is_the_rate_rounded(spark):
    rows = corpus()
    got = mix_report(spark.createDataFrame(rows, SCHEMA)).collect()
    ups = defaultdict(list)
    for r in got:
        if r["size"]:
            rate = r["target"] / r["source_size"]
            copies = r["taken"] // r["size"]
            assert copies in (math.floor(rate + 1e-9), math.ceil(rate - 1e-9))
            ups[rate].append(copies - math.floor(rate))
    for rate, rounded in ups.items():
        # mass is only moved: the number of units rounded up is the sum of the fractions, rounded
        assert abs(sum(rounded) - (rate - math.floor(rate)) * len(rounded)) <= 3


def lots(sizes, source):
    return [(f"{source}{k}", " ".join("w" for _ in range(n)), source) for k, n in enumerate(sizes)]


def test_small_documents_make_up_for_large_ones(spark):
    rng = random.Random(3)
    sizes = {
        "one": [4000, *[rng.randrange(1, 40) for _ in range(300)]],
        "two": [900, 900, 700, *[rng.randrange(5, 90) for _ in range(120)]],
        "wide": [rng.randrange(1, 3000) for _ in range(250)],
        "flat": [rng.randrange(20, 30) for _ in range(2000)],
    }
    rows = [(k, text, s) for k, (_, text, s) in enumerate(x for s in sizes for x in lots(sizes[s], s))]
    docs = spark.createDataFrame(rows, SCHEMA)
    source = {r[0]: r[2] for r in rows}
    for seed in (11, 12):
        taken, target = defaultdict(int), {}
        got = mix_report(docs, seed).collect()
        for r in got:
            taken[source[r["doc_id"]]] += r["taken"]
            target[source[r["doc_id"]]] = r["target"]
        want = water({s: sum(n) for s, n in sizes.items()})
        for s in sizes:
            assert target[s] == pytest.approx(want[s])
            assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 40), (s, seed)
    assert sorted(map(tuple, mix_report(docs.repartition(5), seed).collect())) == sorted(map(tuple, got))


def test_a_document_too_large_for_the_others_takes_the_nearer_outcome(spark):
    # source a: target 5/7 of all words, below 3 times its size; its large document outweighs all others
    rows = [(k, text, s) for k, (_, text, s) in enumerate(lots([1000, 3, 2, 1], "a") + lots([400] * 3 + [7], "b"))]
    taken, target = defaultdict(int), {}
    for r in mix_report(spark.createDataFrame(rows, SCHEMA)).collect():
        s = "a" if r["doc_id"] < 4 else "b"
        taken[s] += r["taken"]
        target[s] = r["target"]
    rate = target["a"] / 1006
    # all sums that the two allowed numbers of copies of each document can give
    sums = {0}
    for n in (1000, 3, 2, 1):
        sums = {x + n * c for x in sums for c in (math.floor(rate), math.ceil(rate))}
    assert abs(taken["a"] - target["a"]) == pytest.approx(min(abs(x - target["a"]) for x in sums), abs=2)


def test_mix_repeats_rows(spark):
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(corpus())], SCHEMA + ", size int")
    words = {(r["doc_id"], r["size"]): r["taken"] for r in mix_report(docs).collect()}
    out = mix(docs)
    assert out.columns == docs.columns
    copies = defaultdict(int)
    for r in out.collect():
        copies[r["size"]] += 1
    for r in docs.collect():
        n = len((r["text"] or "").split())
        assert copies[r["size"]] * n == words[(r["doc_id"], n)]


def test_mix_without_words_or_rows(spark):
    assert mix_report(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mix_report(spark.createDataFrame([(1, None, "a"), (2, " ", None)], SCHEMA)).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in got] == [(0, 0, 0.0)] * 2
