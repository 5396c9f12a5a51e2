"""Sums of long arrays over all rows in two steps, so that neither the driver nor one task sees a row a task.

Tasks add up their rows first; their arrays meet in ``FAN_IN`` groups an id, and the driver adds up those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

FAN_IN = 32
DDL = "id int, part int, total binary"
NAMES = ["id", "part", "total"]


def _table(totals: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    ids, parts = [i for i, _ in totals], [p for _, p in totals]
    values = [v.astype(float).tobytes() for v in totals.values()]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(parts, pa.int32()), pa.array(values, pa.binary())], names=NAMES)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for i, part, raw in zip(*(batch[c].to_pylist() for c in NAMES), strict=True):
            value = np.frombuffer(raw)
            totals[i, part] = totals[i, part] + value if (i, part) in totals else value
    yield _table(totals)


def array_sums(
    df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]], tasks: int | None = None
) -> dict[int, np.ndarray]:
    """The sum of the arrays that ``work`` gives for each id over all batches of ``df``.

    ``tasks`` is the number of partitions, where it is known; few tasks need no second step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, totals = TaskContext.get().partitionId() % FAN_IN, {}
        for batch in batches:
            for i, value in work(batch):
                totals[i, part] = totals[i, part] + value if (i, part) in totals else np.asarray(value, float)
        yield _table(totals)

    found = df.mapInArrow(run, DDL)
    if tasks is None or tasks > FAN_IN:
        found = found.repartition("id", "part").mapInArrow(_added, DDL)
    out: dict[int, np.ndarray] = {}
    for row in found.collect():  # at most FAN_IN arrays an id
        value = np.frombuffer(row["total"])
        out[row["id"]] = out[row["id"]] + value if row["id"] in out else value
    return out
