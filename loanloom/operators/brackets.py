"""Exact quantiles of many columns by brackets: no sort, no explode, no shuffle of rows.

One aggregate over all columns gives sketches, and from them a bracket of two values around each wanted rank.  A
second aggregate counts the rows below and at both ends of every bracket and gathers the few values strictly inside;
the wanted value is an end or one of those.  Where a bracket may hold more than ``GATHER`` values, it is only
counted, and sketched again from the inside, which makes it thousands of times narrower; a bracket that turns out to
miss its rank is widened.  The driver sees a few numbers per column and quantile, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Relative accuracy of a sketch is one over this; values that one bracket may gather.
ACCURACY = 10_000
GATHER = 20_000


@dataclass
class _Target:
    """The ranks of one quantile of one column and what is known of where they are."""

    column: str
    prob: float
    rows: int
    low: float
    high: float
    #: Values that may lie strictly inside, by the sketch's bound; ``width`` is how far beside the ranks the ends were
    #: asked for, as a share.  It only grows, so a bracket ends at the least and the greatest value at last.
    inside: float
    width: float
    ranks: list[int] = field(default_factory=list)
    found: dict[int, float] = field(default_factory=dict)
    #: Whether the rows at the ends are to be counted too, which ties and missed brackets need.
    ends: bool = False

    @property
    def open(self) -> list[int]:
        return [r for r in self.ranks if r not in self.found]

    def value(self) -> float:
        position = self.prob * (self.rows - 1)
        low, high = (self.found[r] for r in (math.floor(position), math.ceil(position)))
        return low if low == high else low + (high - low) * (position - math.floor(position))


def _number(column: str) -> Column:
    return F.col(f"`{column}`").cast("double")


def _asked(ranks: list[int], rows: int, width: float) -> list[float]:
    """Shares at which a sketch is asked for the ends of a bracket around ``ranks`` of ``rows`` values."""
    return [min(max((ranks[0] - 1) / rows - width, 0.0), 1.0), min(max((ranks[-1] + 2) / rows + width, 0.0), 1.0)]


def _set_ends(target: _Target, ranks: list[int], rows: int, row: Row, i: int) -> None:
    """Ends from a sketch of ``rows`` values; the least and the greatest value where the share asked for is beyond."""
    at_low, at_high = _asked(ranks, rows, target.width)
    target.low = row[f"s{i}"][0] if at_low > 0 else row[f"a{i}"]
    target.high = row[f"s{i}"][1] if at_high < 1 else row[f"b{i}"]
    target.inside = 4 * target.width * rows + 8


def _sketches(df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int) -> list[_Target]:
    """First brackets; a column without values has none.  NaN counts as a value above all others."""
    shares = [min(max(p + side * 2 / accuracy, 0.0), 1.0) for p in probs for side in (-1, 1)]
    stats = []
    for i, c in enumerate(columns):
        number = F.nanvl(_number(c), F.lit(None).cast("double"))
        stats += [F.count(_number(c)).alias(f"n{i}"), F.count(number).alias(f"k{i}"), F.min(number).alias(f"a{i}"),
                  F.max(number).alias(f"b{i}"), F.percentile_approx(number, shares, accuracy).alias(f"s{i}")]
    row, targets = df.agg(*stats).first(), []
    for i, c in enumerate(columns):
        rows, numbers = row[f"n{i}"], row[f"k{i}"]
        for j, p in enumerate(probs if rows else ()):
            position = p * (rows - 1)
            ranks = sorted({math.floor(position), math.ceil(position)})
            found = {r: math.nan for r in ranks if r >= numbers}
            # ranks between two shares, or beside the least and the greatest value
            low = row[f"s{i}"][2 * j] if numbers and ranks[0] > 3 * rows / accuracy else row[f"a{i}"]
            high = row[f"s{i}"][2 * j + 1] if numbers and ranks[-1] < numbers - 3 * rows / accuracy else row[f"b{i}"]
            targets.append(_Target(c, p, rows, low, high, 8 * rows / accuracy + 8, 2 / accuracy, ranks, found))
    return targets


def _counts(df: DataFrame, targets: Sequence[_Target], gather: int) -> list[dict]:
    """For each target: rows below ``low``, up to ``low``, below ``high``, up to ``high``; values of gathered ranks.

    At first only the rows up to ``low`` are counted beside the gathered values, which decides most ranks.
    """
    tests: dict[tuple[str, str, float], Column] = {}

    def rows(target: _Target, kind: str, end: float) -> Column:
        number = _number(target.column)
        test = number < F.lit(end) if kind == "below" else number <= F.lit(end)
        return F.col(tests.setdefault((target.column, kind, end), (f"t{len(tests)}", F.count_if(test)))[0])

    gathered, out = [], []
    for i, target in enumerate(targets):
        low, high, number = target.low, target.high, _number(target.column)
        until, gathers = rows(target, "until", low), target.inside <= gather and low < high
        out.append(until.alias(f"ul{i}"))
        if target.ends or not gathers:
            out += [rows(target, "below", low).alias(f"bl{i}"), rows(target, "below", high).alias(f"bh{i}"),
                    rows(target, "until", high).alias(f"uh{i}")]
        if gathers:
            inside = F.when((number > F.lit(low)) & (number < F.lit(high)), number)
            gathered.append(F.sort_array(F.collect_list(inside)).alias(f"g{i}"))
            picks = [F.get(F.col(f"g{i}"), (F.lit(r) - until).cast("int")) for r in target.open]
            out.append(F.array(*picks).alias(f"v{i}"))
    totals = df.agg(*[column.alias(name) for name, column in tests.values()], *gathered)
    row = totals.select(*out).first().asDict()
    return [{k: row.get(f"{k}{i}") for k in ("bl", "ul", "bh", "uh", "v")} for i in range(len(targets))]


def _narrowed(df: DataFrame, targets: Sequence[tuple[_Target, dict]], accuracy: int) -> None:
    """Sketches of the values strictly inside brackets that hold too many to gather."""
    stats = []
    for i, (target, counts) in enumerate(targets):
        number = _number(target.column)
        inside = F.when((number > F.lit(target.low)) & (number < F.lit(target.high)), number)
        ranks, held = [r - counts["ul"] for r in target.open], counts["bh"] - counts["ul"]
        stats += [F.percentile_approx(inside, _asked(ranks, held, target.width), accuracy).alias(f"s{i}"),
                  F.min(inside).alias(f"a{i}"), F.max(inside).alias(f"b{i}")]
    row = df.agg(*stats).first()
    for i, (target, counts) in enumerate(targets):
        ranks, held = [r - counts["ul"] for r in target.open], counts["bh"] - counts["ul"]
        _set_ends(target, ranks, held, row, i)


def _widened(df: DataFrame, targets: Sequence[_Target], accuracy: int) -> None:
    """Brackets that missed their rank, from the sketch again with ends eight times as far apart."""
    stats = []
    for i, target in enumerate(targets):
        target.width *= 8
        number = F.nanvl(_number(target.column), F.lit(None).cast("double"))
        stats += [F.min(number).alias(f"a{i}"), F.max(number).alias(f"b{i}"),
                  F.percentile_approx(number, _asked(target.ranks, target.rows, target.width), accuracy).alias(f"s{i}")]
    row = df.agg(*stats).first()
    for i, target in enumerate(targets):
        _set_ends(target, target.ranks, target.rows, row, i)


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], *, accuracy: int = ACCURACY, gather: int = GATHER
) -> dict[str, tuple[int, list[float]]]:
    """Known rows and linearly interpolated quantiles per column; columns without a known value are left out.

    Nulls are not counted; NaN is above all numbers.
    """
    if not columns:
        return {}
    targets = _sketches(df, columns, probs, accuracy)
    while True:
        left = [t for t in targets if t.open]
        if not left:
            break
        crowded, missed = [], []
        for target, counts in zip(left, _counts(df, left, gather), strict=True):
            picks = dict(zip(target.open, counts["v"] or [], strict=False))
            if counts["bl"] is None:
                target.found.update({r: v for r, v in picks.items() if r >= counts["ul"] and v is not None})
                target.ends = True
                continue
            for rank in target.open:
                if counts["bl"] <= rank < counts["ul"]:
                    target.found[rank] = target.low
                elif counts["bh"] <= rank < counts["uh"]:
                    target.found[rank] = target.high
                elif counts["ul"] <= rank < counts["bh"] and rank in picks:
                    target.found[rank] = picks[rank]
            if any(not counts["bl"] <= rank < counts["uh"] for rank in target.open):
                missed.append(target)
            elif target.open and counts["bh"] - counts["ul"] <= gather:
                target.inside = counts["bh"] - counts["ul"]  # counted: few enough to gather after all
            elif target.open:
                crowded.append((target, counts))
        if crowded:
            _narrowed(df, crowded, accuracy)
        if missed:
            _widened(df, missed, accuracy)
    out: dict[str, tuple[int, list[float]]] = {}
    for target in targets:
        out.setdefault(target.column, (target.rows, []))[1].append(target.value())
    return out


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``(column, known_rows, q0..qk)``, one row for each column with a known value."""
    found = exact_quantiles(df, columns, probs)
    schema = T.StructType([T.StructField("column", T.StringType()), T.StructField("known_rows", T.LongType())]
                          + [T.StructField(f"q{i}", T.DoubleType()) for i in range(len(probs))])
    return df.sparkSession.createDataFrame([(c, rows, *values) for c, (rows, values) in found.items()], schema)


def edges_by_column(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    return {c: values for c, (_, values) in exact_quantiles(df, columns, probs).items()}
