from statuta.operators import records
from statuta.streaming.incremental import new_records, store


def test_only_new_keys_are_stored(spark, tmp_path):
    folder, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for ids in ([1, 2], [2, 3]):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(folder)
        store(new_records(spark, folder, "id long"), target, state, "id").awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_save_by_category(spark, tmp_path):
    rows = spark.createDataFrame([("가", 1), ("나", 2)], "`카테고리` string, n int")
    records.save(rows, str(tmp_path / "o"), "카테고리")
    assert spark.read.json(str(tmp_path / "o")).where("`카테고리` = '나'").first()["n"] == 2
