import os

from shellsieve.llm.naming import exact_duplicates
from shellsieve.llm.storage import scratch, spare
from shellsieve.session import work_folder


def test_tables_between_jobs_go_with_their_scope(spark, tmp_path):
    folder = f"{work_folder(spark)}/steps"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    frame = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    with scratch(spark):
        exact_duplicates(frame).write.parquet(str(tmp_path / "groups"))
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before
    assert spark.read.parquet(str(tmp_path / "groups")).count() == 2


def test_spare_names_clash_with_none():
    assert spare(["x", "_A", "__b"], "a", "b") == ["___a", "___b"]
