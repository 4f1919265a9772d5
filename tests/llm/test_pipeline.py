"""Stages of the pipeline: what they keep, that each text is passed on unchanged, and the whole run on the smallest table."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_language_stage_keeps_rows_and_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.unionByName(spark.createDataFrame([(None, None, "en", "s", 0), (900001, "12 34 ..", "en", "s", 8)], docs.schema)).withColumn("lang_pred", F.lit("mine")).withColumn(
        "score", F.lit(3))
    kept = corpus_pipeline.identify_language(spark, extra, SF)
    assert kept.columns == extra.columns and kept.schema == extra.schema or dict(kept.dtypes) == dict(extra.dtypes)
    rows = kept.select("doc_id", "text", "source", "n_chars", "lang_pred", "score").collect()
    given = {r.doc_id: r for r in extra.select("doc_id", "text", "source", "n_chars", "lang_pred", "score").collect()}
    assert rows and all(given[r.doc_id] == r for r in rows)
    gone = set(given) - {r.doc_id for r in rows}
    assert {None, 900001} <= gone and len(gone) < 0.1 * len(given)
    langs = {r.lang for r in docs.select("lang").distinct().collect()}
    assert {r.lang for r in kept.select("lang").distinct().collect()} <= langs


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, SF)
    pieces = out.collect()
    assert len(corpus_pipeline.STAGES) == 5 and pieces
    assert {r.doc_id for r in pieces} <= {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    ends = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024


def test_one_string_is_not_two_parts(spark):
    """A weak candidate is reported only beside a part that does not overlap it."""
    from tidewatch.llm import secrets
    alone = "login: Zx9Kq2Lm8Pn4Rt6Vw1Ys3"
    rows = [(1, alone), (2, f"{alone} " + "x " * 150 + "Qw8Er2Ty6Ui4Op1As9Df3"), (3, f"{alone} " + "x " * 300 + "Qw8Er2Ty6Ui4Op1As9Df3"),
            (4, f"https://a.example.org/in {alone}"), (5, "https://a.example.org/in user=bob Zx9Kq2Lm8Pn4Rt6Vw1Ys3"), (6, "user=bob " + "A" * 0 + "password=hunter2222"),
            (7, "user=bob"), (8, "Zx9Kq2Lm8Pn4Rt6Vw1Ys3"), (9, None), (10, "")]
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in (1, 3, 4, 7, 8, 9, 10)] == [""] * 7
    # the login is completed by the string further on, and so is that string by the login; its own value lies inside it
    assert got[2].startswith("identifier:0:28") and got[2].endswith(f"opaque:{len(rows[1][1]) - 21}:{len(rows[1][1])}")
    assert [x.split(":")[0] for x in got[5].split(",")] == ["endpoint", "identifier", "opaque"]
    assert got[6] == "identifier:0:8,assign:9:28"


def test_masking_with_clashing_columns(spark):
    from tidewatch.llm import secrets
    df = spark.createDataFrame([(1, "password: hunter2hunter2 x", 26, 7, "s")], "doc_id long, text string, n_chars long, _row int, _spans string")
    (r,) = secrets.masked(df, "[secret]").collect()
    assert tuple(r) == (1, "[secret] x", 10, 7, "s")
