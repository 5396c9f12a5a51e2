"""Numbers written in groups after a confident pattern."""

from loanloom.llm.pii import redacted, report

SCHEMA = "doc_id bigint, text string"
SEEDS = [(k, f"word{k} please write to agent user{k}@mail.example.com today and more") for k in range(40)]
NUMBERS = ["030 555 1234", "12 34 56", "(030) 555 1234", "030 555-12.34 a1"]


def test_grouped_numbers_are_one_span(spark):
    texts = [f"word please write to agent {number} today and more" for number in NUMBERS]
    rows = [*SEEDS, *[(100 + k, t) for k, t in enumerate(texts)], (200, "rooms 7 8 9 are free"), (201, "1 " * 20000 + "x2")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in report(docs).collect()}
    masked = {r["doc_id"]: r["text"] for r in redacted(docs).collect()}
    for k, (number, text) in enumerate(zip(NUMBERS, texts)):
        start = text.index(number)
        assert got[100 + k]["spans"] == f"context:{start}:{start + len(number)}" and got[100 + k]["n_context"] == 1
        assert masked[100 + k] == "word please write to agent [CONTEXT] today and more"
    assert got[200]["spans"] == got[201]["spans"] == ""
