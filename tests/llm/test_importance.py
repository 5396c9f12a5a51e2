"""Importance resampling against plain counting with the library's checksum."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loanloom.llm.importance import features, resample
from loanloom.llm.position_crc import WIDTH, crc32_spans

SCHEMA = "doc_id bigint, text string, rank string, bucket int"


def test_checksums_of_spans_of_any_length():
    rng = random.Random(1)
    data = np.frombuffer(rng.randbytes(400_000), np.uint8)
    spans = [(0, len(data)), (5, 5), (len(data), len(data))]
    for length in [0, 1, 2, WIDTH - 1, WIDTH, WIDTH + 1, 2 * WIDTH, 2 * WIDTH + 1, 5 * WIDTH, 1000, 70_000]:
        spans += [(a, a + length) for a in (rng.randrange(len(data) - length) for _ in range(20))]
    starts, ends = map(np.array, zip(*spans, strict=True))
    assert crc32_spans(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in spans]
    assert crc32_spans(data, np.zeros(0), np.zeros(0)).tolist() == []


def plain_features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, longest, buckets, percent, least_words):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    s = Counter(bucket(f) for _, text in docs for f in plain_features(text, longest)[1])
    t = Counter(bucket(f) for text in target for f in plain_features(text, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in docs:
        words, found = plain_features(text, longest)
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, found)
        )
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(found), weight, score, len(words) >= least_words))
    able = sorted((row for row in out if row[4]), key=lambda row: (-row[3], row[0] is not None, row[0] or 0))
    drawn = len(able) * percent // 100
    ranked = [(*row[:4], place + 1 if place < drawn else None) for place, row in enumerate(able)]
    return sorted([*ranked, *((*row[:4], None) for row in out if not row[4])], key=repr)


def corpus(rng, n):
    vocabulary = ["Alpha", "beta", "gamma7", "naïve", "日本語", "x" * 63, "y" * 64, "z" * 65, "q" * 1000, "the", "of", "42"]
    joints = [" ", "  ", "-", "\n", ", ", "_", "'", "\x00", "\x7f"]
    return ["".join(rng.choice(vocabulary) + rng.choice(joints) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("longest", [1, 3])
def test_equal_to_plain_counting(spark, longest):
    rng = random.Random(7)
    texts = [*corpus(rng, 120), None, "", "   ", "É only", "word " * 40_000, "no-blank" * 30_000, "日" * 100_000]
    docs = [*enumerate(texts), (None, texts[3]), (5, texts[5]), (5, texts[5]), (6, "another text of a used id")]
    target = [*corpus(rng, 20), None, "", texts[0]]
    rows = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA).repartition(5)
    wanted = spark.createDataFrame([(i, text, 0) for i, text in enumerate(target)], "item_id int, text string, n int")
    got = resample(rows, wanted, longest, 97, 30, 8)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, target, longest, 97, 30, 8)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id bigint, text string")
    assert resample(none, some).collect() == []
    got = {r["doc_id"]: tuple(r)[1:3] for r in resample(some, none, least_words=1).collect()}
    assert got == {1: (3, 3 * math.floor(1000 * math.log(10003 / (2 * 10000)))), 2: (0, 0)}


def test_a_word_may_lie_at_the_edges_of_texts():
    import pyarrow as pa

    texts = pa.array(["skipped", "ab", None, "cd", "", "ef gh"]).slice(1)
    row, _, n_words = features(texts, 2, 10_000)
    assert n_words.tolist() == [1, 0, 1, 0, 2]
    assert sorted(row.tolist()) == [0, 2, 4, 4, 4]
