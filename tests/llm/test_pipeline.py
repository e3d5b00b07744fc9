"""The corpus pipeline stage by stage: odd rows, repeated rows, clashing columns, an empty table, and what each stage must take out."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"
BASE = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables whose documents hold odd rows and columns of names that stages use themselves."""
    where = tmp_path_factory.mktemp("tables")
    given = spark.read.parquet(f"{SF}/documents.parquet").select(*BASE)
    some = given.where("length(text) > 200").orderBy("doc_id").first()
    rows = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "word " * 30_000, "en", "s", 150_000), (None, "a text without an id that is long enough to be one of several", "en", None, None), (9004, some.text, "en", "t", len(some.text)), (9004, some.text, "en", "t", len(some.text)), (9005, "\n\n \n", None, "s", 4), (9006, "x", "en", "s", 1)]
    more = spark.createDataFrame(rows, given.schema)
    both = given.unionByName(more)
    for name in ("n_lines", "n_dropped", "kept", "row", "class_id", "score", "found", "salt"):
        both = both.withColumn(name, F.lit(name))
    both.write.parquet(f"{where}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{where}/{t}.parquet")
    return str(where)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_keeps_columns_of_odd_rows(spark, odd, name, stage):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = stage(spark, docs, odd)
    assert out.columns == docs.columns
    rows = out.collect()
    assert 0 < len(rows) <= docs.count()
    assert all(r[c] == c for r in rows for c in ("n_lines", "n_dropped", "kept", "row", "class_id", "score", "found", "salt"))
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_of_an_empty_table(spark, odd, name, stage):
    docs = spark.read.parquet(f"{odd}/documents.parquet").select(*BASE).where("doc_id < -5")
    assert stage(spark, docs, odd).count() == 0


def test_stages_take_out_what_they_should(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*BASE)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    prose = " ".join(f"w{i * 7919 % 997} v{i}" for i in range(120))
    own = "\n".join(f"line {i} of its own with words {i * 31} {i * 57} {i * 91}" for i in range(6))
    again = "the passage that many documents share stands on a line by itself and is long enough to count"
    rows = [(8001, prose, "en", "s", 1), (8002, prose + " tail", "en", "s", 1), (8003, f"before it {item} after it", "en", "s", 1), (8004, own + "\n" + again, "en", "s", 1), (8005, again, "en", "s", 1), (8006, again + "\n" + own.replace("line", "row").replace("words", "terms"), "en", "s", 1)]
    planted = spark.createDataFrame(rows, docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(stages["jaccard join"](spark, planted, odd)) == {8001, 8003, 8004, 8005, 8006}
    assert ids(stages["decontamination"](spark, planted, odd)) == {8001, 8002, 8004, 8005, 8006}
    kept = {r.doc_id: r.text for r in stages["line dedup"](spark, planted, odd).collect()}
    assert sum(again in (t or "") for t in kept.values()) == 1 and own in kept[8004]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = ids(stages["quality classifier"](spark, docs, odd))
    scored = labels.join(docs.select("doc_id"), "doc_id").collect()
    hits = sum((r.doc_id in good) == (r.quality == 1) for r in scored)
    assert hits >= 0.95 * len(scored)
    coded = stages["sentencepiece"](spark, planted, odd).collect()
    assert len(coded) == 6 and all(r.round_trip and r.n_tokens == len(r.ids) for r in coded)
