"""Bracketed quantiles against a plain sort, also where every step of the search is needed."""

import math
import random

import pytest

from loanloom.operators.brackets import column_quantiles, exact_quantiles

PROBS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


def plain(values, prob):
    known = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), 0 if math.isnan(v) else v))
    position = prob * (len(known) - 1)
    low, high = known[math.floor(position)], known[math.ceil(position)]
    return low if low == high else low + (high - low) * (position - math.floor(position))


def same(a, b):
    return a == b or (math.isnan(a) and math.isnan(b))


def columns_of(rng, n):
    return {
        "spread": [rng.gauss(0, 1000) for _ in range(n)],
        "few": [float(rng.choice([1, 1, 1, 2, 7])) for _ in range(n)],
        "two": [float(i % 2) for i in range(n)],
        "one": [5.0] * n,
        "heavy": [rng.random() if rng.random() < 0.4 else 0.5 for _ in range(n)],
        "holes": [rng.choice([None, rng.random()]) for _ in range(n)],
        "nan": [rng.choice([math.nan, rng.random(), math.inf, -math.inf]) for _ in range(n)],
        "all_nan": [math.nan] * n,
        "none": [None] * n,
        "steps": [float(i // 7) for i in range(n)],
    }


@pytest.mark.parametrize(("rows", "accuracy", "gather"), [(1, 10_000, 20_000), (2, 10_000, 20_000), (997, 10_000, 20_000),
                                                          (3000, 50, 20), (3000, 20, 1), (4000, 1000, 3)])
def test_equal_to_a_sort(spark, rows, accuracy, gather):
    data = columns_of(random.Random(rows + accuracy), rows)
    names = list(data)
    df = spark.createDataFrame(list(zip(*data.values(), strict=True)), ", ".join(f"{n} double" for n in names)).repartition(5)
    found = exact_quantiles(df, names, PROBS, accuracy=accuracy, gather=gather)
    assert "none" not in found
    for name in names[:-2] + ["steps"]:
        known = [v for v in data[name] if v is not None]
        if not known:
            assert name not in found
            continue
        assert found[name][0] == len(known)
        for prob, value in zip(PROBS, found[name][1], strict=True):
            assert same(value, plain(data[name], prob)), (name, prob, value)


def test_frame_of_columns_and_empty_input(spark):
    df = spark.createDataFrame([(1, 4.0, None), (2, 8.0, None)], "id int, value double, `odd name` double")
    assert [tuple(r) for r in column_quantiles(df, ["value", "odd name"], (0.25, 0.5)).collect()] == [("value", 2, 5.0, 6.0)]
    assert column_quantiles(df.limit(0), ["value"], (0.5,)).collect() == []
    assert exact_quantiles(df, [], (0.5,)) == {}


def test_rows_are_neither_exploded_nor_shuffled_nor_stored(spark):
    from loanloom.operators import brackets

    df = spark.range(1000).select(F_double("id"), (F_double("id") * 2).alias("b")).toDF("a", "b")
    target = brackets._sketches(df, ["a", "b"], (0.5,), 100)
    assert all(t.low <= 499.5 * (1 if t.column == "a" else 2) <= t.high for t in target)
    plan = df.agg({"a": "max"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def F_double(name):
    from pyspark.sql import functions as F

    return F.col(name).cast("double")
