"""Verdicts on bursts of event copies: from stream state as from a table."""

from collections import defaultdict
from datetime import datetime, timedelta

from loanloom.streaming.payments import read_settled, settled, settled_sink, without_identity

ROW = "event_ref string, amount double, note string, ts timestamp, extra int"
START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def plain(rows):
    """Bursts by reading each id's copies in order of time."""
    by_id = defaultdict(list)
    for ref, amount, note, ts, _ in rows:
        if ref is not None and ts is not None:
            by_id[ref].append((ts, (amount, note)))
    out = set()
    for ref, seen in by_id.items():
        bursts = []
        for ts, payload in sorted(seen, key=lambda x: x[0]):
            if bursts and ts - bursts[-1][-1][0] <= timedelta(hours=1):
                bursts[-1].append((ts, payload))
            else:
                bursts.append([(ts, payload)])
        out |= {(ref, b[0][0], b[-1][0], len(b), len({p for _, p in b}) > 1) for b in bursts}
    return out


def verdicts(rows):
    return {(r.event_ref, r.first_seen, r.last_seen, r.copies, r.conflicting) for r in rows}


FIRST = [("a", 1.0, None, at(0), 1), ("a", 1.0, None, at(5), 2), ("b", 5.0, "x", at(1), 1), ("null", None, None, at(2), 1)]
SECOND = [
    ("a", 1.0, None, at(40), 3), ("b", 6.0, "x", at(30), 1), ("null", None, "", at(3), 1), ("c", 2.0, "", at(50), 1), ("edge", 1.0, "", at(10), 1),
    ("edge", 2.0, "", at(70), 1), (None, 1.0, "", at(4), 1), ("timeless", 1.0, "", None, 1),
]
THIRD = [("a", 9.0, None, at(400), 1), ("d", 1.0, "", at(401), 1)]
LATE = [("b", 5.0, "x", at(2), 1), ("end", 0.0, "", at(1000), 1)]


def test_table_against_plain_reading(spark):
    rows = FIRST + SECOND + THIRD + LATE
    df = spark.createDataFrame(rows, ROW)
    got = settled(df, "ts", ["amount", "note"])
    assert got.columns == ["event_ref", "amount", "note", "first_seen", "last_seen", "copies", "conflicting"]
    assert verdicts(got.collect()) == plain(rows) and got.count() == len(plain(rows))
    assert {r.event_ref for r in without_identity(df, "ts").collect()} == {None, "timeless"}
    assert settled(df.limit(0), "ts", ["amount"]).collect() == []


def test_hot_id_is_merged_before_the_shuffle(spark):
    local = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    rows = [("hot", 1.0, "", at(k % 50), k) for k in range(3000)] + [(f"e{k}", 1.0, "", at(k % 7), k) for k in range(300)]
    spark.conf.set(local, "true")
    try:
        assert verdicts(settled(spark.createDataFrame(rows, ROW), "ts", ["amount", "note"]).collect()) == plain(rows)
    finally:
        spark.conf.unset(local)


def test_stream_gives_each_verdict_once_without_reading_back(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (FIRST, SECOND, THIRD, LATE):
        spark.createDataFrame(part, ROW).coalesce(1).write.mode("append").parquet(source)
        stream = settled(spark.readStream.schema(ROW).parquet(source), "ts", ["amount", "note"])
        query = (
            stream.writeStream.outputMode("append").trigger(availableNow=True)
            .option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(settled_sink(out)).start()
        )
        assert query.awaitTermination(120)
    found = read_settled(spark, out).collect()
    # the late copy of b came after its verdict and is dropped; the last event is still open
    want = {v for v in plain(FIRST + SECOND + THIRD) if v[0] != "end"}
    assert verdicts(found) == want and len(found) == len(want)
    assert {r.event_ref for r in found if r.conflicting} == {"b", "null", "edge"}


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    rows = settled(spark.createDataFrame(FIRST + SECOND, ROW), "ts", ["amount", "note"])
    sink = settled_sink(str(tmp_path / "out"))
    for _ in range(2):
        sink(rows, 4)
    assert verdicts(read_settled(spark, str(tmp_path / "out")).collect()) == verdicts(rows.collect())
