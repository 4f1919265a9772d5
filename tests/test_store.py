import json

import pytest

from tidewatch.operators.alarms import Rule
from tidewatch.sources import store


def test_documents_many_files_and_provenance(spark, tmp_path):
    for i in range(3):
        rows = [{"c": 0.5, "arm": "mnar", "rep": r, "seed": 10 * i + r, "t_lead": None if r else 7, "extra": {"x": 1}} for r in range(4)]
        (tmp_path / f"cell{i}.json").write_text(json.dumps({"design": {"n": 1}, "per_run_rows": rows}, indent=1))
    df = store.read_rows(spark, f"{tmp_path}/cell*.json")
    assert df.count() == 12 and df.select("seed").distinct().count() == 12 and df.select("source_file").distinct().count() == 3
    assert df.where("t_lead IS NULL").count() == 9
    p = store.provenance(spark, f"{tmp_path}/cell*.json").collect()
    assert len(p) == 3 and all(len(r["sha256"]) == 64 for r in p)


def test_write_once_and_cache(spark, tmp_path):
    df = spark.range(5)
    store.write_once(df, f"{tmp_path}/t")
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        store.write_once(df, f"{tmp_path}/t")
    store.write_table(spark.range(7), f"{tmp_path}/t2")
    store.write_table(spark.range(8), f"{tmp_path}/t2")
    assert spark.read.parquet(f"{tmp_path}/t2").count() == 8


def test_kept_tables_follow_query_and_input(spark, tmp_path):
    read = lambda: spark.read.schema("id long").parquet(f"{tmp_path}/in")
    keep = lambda df, **kw: store.materialised(df, f"{tmp_path}/kept", **kw)
    folders = lambda: len(list((tmp_path / "kept").iterdir()))
    spark.range(5).write.parquet(f"{tmp_path}/in")
    doubled = lambda by: read().selectExpr(f"id * {by} AS x")
    assert keep(doubled(2)).agg({"x": "sum"}).first()[0] == 20 and folders() == 1
    assert keep(doubled(2)).agg({"x": "sum"}).first()[0] == 20 and folders() == 1
    assert keep(doubled(3)).agg({"x": "sum"}).first()[0] == 30 and folders() == 2
    assert keep(doubled(2).withColumnRenamed("x", "y")).columns == ["y"] and folders() == 3
    assert keep(doubled(2), version="2").count() == 5 and folders() == 4
    spark.range(5, 7).write.mode("append").parquet(f"{tmp_path}/in")
    assert keep(doubled(2)).agg({"x": "sum"}).first()[0] == 42 and folders() == 5
    many = [f"id + {i} AS c{i}" for i in range(60)]
    other = many[:50] + ["id + 999 AS c50"] + many[51:]
    assert keep(read().selectExpr(*many)).where("c0 = 0").first()["c50"] == 50
    assert keep(read().selectExpr(*other)).where("c0 = 0").first()["c50"] == 999
    for p in (tmp_path / "kept").rglob("_SUCCESS"):  # a write that did not end is not taken for a result
        p.unlink()
    assert keep(doubled(2)).agg({"x": "sum"}).first()[0] == 42
    with pytest.raises(ValueError):
        keep(spark.range(3))
    with pytest.raises(ValueError):
        keep(read().join(spark.createDataFrame([(1, 2)], "id long, z long"), "id"))


def test_rule_files(spark, tmp_path):
    f = tmp_path / "rule.json"
    f.write_text(json.dumps({"leading": {"k": 6.5, "window": 30, "classes": ["form"], "unknown": 1}, "lagging": {"k_sd": 3.5}}))
    assert store.load_rule(spark) == Rule()
    rule = store.load_rule(spark, str(f))
    assert (rule.leading.k, rule.leading.classes, rule.lagging.k_sd) == (6.5, ("form",), 3.5)
    spark.conf.set(store.RULE_SETTING, str(f))
    assert store.load_rule(spark) == rule
    spark.conf.unset(store.RULE_SETTING)
