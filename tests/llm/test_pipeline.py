"""The corpus pipeline on a small planted table."""

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from loanloom.llm.mixing import mix_report
from loanloom.llm.quality_rules import counts_of

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def planted():
    rng = random.Random(6)
    words = [f"word{k}" for k in range(900)]
    clean = [" ".join(rng.choice(words) for _ in range(rng.randrange(60, 200))) for _ in range(60)]
    texts = dict(enumerate(clean))
    texts[100] = clean[7]  # an exact copy
    texts[101] = clean[8] + " and one more"  # a near copy
    texts[102] = " ".join(clean[9].split()[:20])  # too short
    texts[103] = "again and again " * 60  # too repetitive
    texts[104] = clean[10].replace(" ", " a.user@mail.example.com ", 1) + " " + " ".join(words[:100])
    texts[105] = None
    texts[106] = ""
    return [(k, t, "en", ["a", "b", None][k % 3], len(t or "")) for k, t in texts.items()]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(planted(), COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        out.append((name, docs))
    return str(folder), out


def test_stages_follow_from_each_other(spark, stages):
    folder, out = stages
    rows = {r[0]: r for r in planted()}
    frames = [frame for _, frame in out]
    assert all(f.columns == ["doc_id", "text", "lang", "source", "n_chars"] for f in frames[:4])
    ids = [sorted(r["doc_id"] for r in f.collect()) for f in frames]

    good = [d for d, r in rows.items() if (c := counts_of(r[1]))[0] >= 50 and 2 * c[4] <= c[0]]
    assert ids[0] == sorted(good) and 102 not in good and 103 not in good and 105 not in good
    assert ids[1] == sorted(set(good) - {100, 101})
    assert ids[2] == ids[1]
    masked = {r["doc_id"]: r for r in frames[2].collect()}
    for d, r in masked.items():
        want = rows[d][1].replace("a.user@mail.example.com", "[EMAIL]")
        assert (r["text"], r["n_chars"], r["source"]) == (want, len(want), rows[d][3])
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mix_report(frames[2]).collect()}
    assert ids[3] == sorted(d for d, n in taken.items() for _ in range(n))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in frames[4].collect():
        assert r["ids"] == library.encode(masked[r["doc_id"]]["text"]) and r["n_tokens"] == len(r["ids"])
    assert ids[4] == ids[3]


def test_run_gives_the_last_stage(spark, stages):
    folder, out = stages
    last = out[-1][1]
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == last.columns
    key = F.concat_ws(",", F.col("ids").cast("array<string>"))
    assert sorted(map(tuple, got.select("doc_id", key).collect())) == sorted(map(tuple, last.select("doc_id", key).collect()))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
