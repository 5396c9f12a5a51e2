"""Spans of regular expressions in code points, as array functions on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,hit:string>>"


def with_matches(df: DataFrame, text: str, name: str, pattern: str, hint: str) -> DataFrame:
    """``df`` with the leftmost non-overlapping matches of ``pattern`` in a non-null text column.

    ``pattern`` has no groups of its own.  Only texts in which ``hint`` is found are searched; it must be found in every
    text that has a match.  Each step continues where the last match ended: the text passed over and the match give
    the positions, so a text is read once, however many matches it has.
    """
    step = rf"\G(?s:(.*?))({pattern})"
    gaps, hits = f"_{name}_gaps", f"_{name}_hits"
    nothing = F.array().cast("array<string>")
    has = F.col(text).rlike(hint)
    found = df.withColumn(gaps, F.when(has, F.regexp_extract_all(text, F.lit(step), F.lit(1))).otherwise(nothing))
    found = found.withColumn(hits, F.when(F.size(gaps) > 0, F.regexp_extract_all(text, F.lit(step), F.lit(2))).otherwise(nothing))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def place(state: Column, part: Column) -> Column:
        begin = state["at"] + F.char_length(part["gap"])
        end = begin + F.char_length(part["hit"])
        span = F.struct(begin.alias("start"), end.alias("end"), part["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    parts = F.arrays_zip(F.col(gaps).alias("gap"), F.col(hits).alias("hit"))
    placed = F.aggregate(parts, start, place, lambda state: state["out"])
    spans = F.when(F.size(gaps) > 0, placed).otherwise(F.array().cast(SPAN))
    return found.withColumn(name, spans).drop(gaps, hits)


def kept(spans: str, passes) -> Column:
    """Spans whose matched text passes."""
    return F.filter(spans, lambda s: passes(s["hit"]))


def of_kind(spans: Column, kind: str, order: int) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["hit"].alias("hit"))
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
