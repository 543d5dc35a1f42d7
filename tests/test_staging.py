from cuewright import staging


def test_tables_lie_in_the_shared_folder_until_released(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "_STAGED", [])
    monkeypatch.setattr(staging, "shared_folder", lambda _: f"file://{tmp_path}")
    held = staging.stage(spark.range(10), "ten")
    assert held.count() == 10 and held.columns == ["id"]
    assert len(list((tmp_path / "cuewright").glob("ten-*/*.parquet"))) > 0
    assert staging.release(spark) == 1 and not list((tmp_path / "cuewright").glob("ten-*"))
    assert staging.stage(spark.range(3).where("id > 5"), "none").count() == 0


def test_there_is_a_folder(spark):
    assert staging.shared_folder(spark) == staging.shared_folder(spark) != ""
