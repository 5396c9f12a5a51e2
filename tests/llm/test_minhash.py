"""Near duplicates against brute force."""

import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loanloom.llm import minhash
from loanloom.llm.components import components
from loanloom.llm.minhash import deduplicated, near_duplicates
from loanloom.session import ensure_checkpoint_dir

SCHEMA = "doc_id bigint, text string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def split(text):
    out, word = [], ""
    for c in text + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def brute(rows, width, numerator, denominator):
    sets = []
    for _, text in rows:
        words = split(lower(text or ""))
        span = min(width, len(words))
        sets.append({tuple(words[i : i + span]) for i in range(len(words) - span + 1)} if words else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and denominator * len(a & b) >= numerator * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for k, (doc_id, _) in enumerate(rows):
        component = None if doc_id is None else min(rows[m][0] for m in range(len(rows)) if group[m] == group[k])
        out.append((doc_id, len(sets[k]), component, doc_id == component))
    return out


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Ünder", "THE", "the", "of x"]
    rows = []
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 90]))]
        for copy in range(rng.choice([1, 2, 5, 14])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((family * 100 + copy, rng.choice([" ", "\t", "\n", "  "]).join(text)))
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "one"), (5004, "ONE"), (5005, "one one"), (None, rows[0][1]), (5006, "x\x1cy z"), (5007, "x\x1cy Z")]
    rows += [rows[0], rows[0]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,numerator,denominator", [(2, 80, 100), (5, 8, 10)])
def test_equals_brute_force(spark, width, numerator, denominator):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("component", F.lit(1)).withColumn("u", F.lit("x"))
    got = near_duplicates(docs, width, numerator, denominator).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, width, numerator, denominator), key=key)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"a{i}" for i in range(120)]
    rows = []
    for k in range(300):
        text = list(base)
        for _ in range(rng.randrange(1, 8)):
            text[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), 2, 80, 100).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 2, 80, 100))


def test_deduplicated_keeps_columns_and_one_of_each_group(spark):
    docs = spark.createDataFrame([(3, "a b c", 1), (1, "A b c", 2), (2, None, 3)], "doc_id bigint, text string, kept int")
    out = deduplicated(docs, 2)
    assert out.columns == ["doc_id", "text", "kept"]
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (95, 100), (7, 7), (None, 4), (200, 150), (150, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 90: 90, 95: 90, 100: 90, 150: 150, 200: 150}


def chance_meetings(pairs):
    """Pairs of texts that share about 0.4 of their words' pairs and so, often, a bucket; and one near copy."""
    rng = random.Random(3)
    rows = []
    for k in range(pairs):
        common = [f"c{k}x{i}" for i in range(60)]
        rows += [(10 * k + side, " ".join(common + [f"s{k}x{side}x{i}" for i in range(45)])) for side in (0, 1)]
    words = rows[6][1].split()
    words[rng.randrange(len(words))] = "other"
    return [*rows, (10**6, " ".join(words))]


def test_sets_are_made_of_what_signatures_tie_alone(spark, monkeypatch):
    seen = []
    made = minhash.shingle_sets
    monkeypatch.setattr(minhash, "shingle_sets", lambda docs, width: seen.append(docs.select("doc_id").collect()) or made(docs, width))
    rows = chance_meetings(150)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), 2, 80, 100).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 2, 80, 100))
    assert {r["doc_id"] for r in seen[0]} <= {30, 31, 10**6} and len(seen) == 1


def test_stored_rows_and_shuffles_go_when_read(spark):
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in blocks.getAllFiles().mkString("\n").split("\n") if Path(f).name.startswith("shuffle_")}
    stored = lambda: {f for f in folder.rglob("*") if f.is_file()}
    rows = chance_meetings(250)
    docs = spark.createDataFrame(rows, SCHEMA)
    files, shuffles = stored(), shuffled()
    out = near_duplicates(docs, 2, 80, 100)
    for _ in range(50):  # shuffle files go a little later
        left = shuffled() - shuffles
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert sum(f.stat().st_size for f in stored() - files) < 250 * len(rows)  # a row's signature alone has 512 bytes
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, out.collect())) == sorted(brute(rows, 2, 80, 100))


@pytest.mark.parametrize("rows_of_a_batch", [1, 7, 10_000])
def test_ties_reach_what_likely_pairs_reach(rows_of_a_batch):
    rng = np.random.default_rng(2)
    rows = []
    for bucket in range(-3, 40):
        base = rng.integers(0, 256, (3, 128), np.uint8)
        for member in range(rng.integers(2, 12)):
            sketch = base[rng.integers(3)].copy()
            sketch[rng.random(128) < rng.choice([0.05, 0.3, 0.5])] = rng.integers(256)
            rows.append((bucket, bucket * 100 + member, sketch.tobytes()))
    schema = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("sketch", pa.binary())])
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    got = [p for b in minhash._tied(iter(table.to_batches(rows_of_a_batch))) for p in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True)]

    def reached(pairs):
        group = {r[1]: r[1] for r in rows}
        for u, v in pairs:
            old, new = max(group[u], group[v]), min(group[u], group[v])
            group = {k: new if g == old else g for k, g in group.items()}
        return group

    alike = lambda a, b: np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) >= minhash.LEAST_AGREEMENT
    likely = [(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] > b[1] and alike(a[2], b[2])]
    assert set(got) <= set(likely) and len(got) == len(set(got))
    assert reached(got) == reached(likely) and len(got) < len(likely)


def test_common_buckets_tie_all_to_the_smallest(spark, monkeypatch):
    monkeypatch.setattr(minhash, "COMMON", 3)
    rows = corpus()
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), 2, 80, 100).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 2, 80, 100), key=key)
