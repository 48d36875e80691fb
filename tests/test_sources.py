from pathlib import Path

import pytest

from lexloom.session import new_stage_path, shared_folder, write_and_read
from lexloom.sources import readers, stages


def test_lines_of_several_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n\n")
    (tmp_path / "b.txt").write_text("three")
    got = readers.read_lines(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]).collect()
    assert sorted(r.text for r in got) == ["", "one", "three", "two"]


def test_recursive_scan_skips_junk(spark, tmp_path):
    for sub, n in (("x", 3), ("x/y", 4)):
        spark.range(n).coalesce(1).write.mode("append").parquet(str(tmp_path / sub))
    (tmp_path / "x" / "y" / ".DS_Store").write_bytes(b"junk")
    found = readers.read_recursive(spark, str(tmp_path))
    assert found.count() == 7
    assert found.select("file_name").distinct().count() == 2


def test_subset_of_tables_that_are_files_or_folders(spark, tmp_path):
    for name, n in (("docs_a", 3), ("docs_b", 4), ("other", 5)):
        spark.range(n).repartition(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    one = next((tmp_path / "docs_b.parquet").glob("part-*.parquet"))
    (tmp_path / "docs_c.parquet").write_bytes(one.read_bytes())
    in_c = spark.read.parquet(str(one)).count()
    assert readers.read_subset(spark, str(tmp_path), "doc*.parquet").count() == 7 + in_c


def test_table_from_columns(spark):
    df = readers.table_from_columns(spark, {"input_ids": [[1, 2], [3]], "n": [2, 1]})
    assert [tuple(r) for r in df.orderBy("n").collect()] == [([3], 1), ([1, 2], 2)]
    with pytest.raises(ValueError):
        readers.table_from_columns(spark, {"a": [1], "b": []})


def folders(path):
    return sorted(p.name for p in Path(path).iterdir() if p.is_dir())


def test_stage_is_written_once(spark, tmp_path):
    path, build = str(tmp_path / "stage"), lambda: spark.range(5)
    assert stages.cached_stage(spark, path, build).count() == 5
    before = folders(path)
    assert stages.cached_stage(spark, path, build).count() == 5 and folders(path) == before and len(before) == 1


def test_stage_is_built_again_when_something_changed(spark, tmp_path):
    given, path = str(tmp_path / "given"), str(tmp_path / "stage")
    spark.range(5).write.parquet(given)
    seen = []

    def stage(build, version=""):
        rows = sorted(r.id for r in stages.cached_stage(spark, path, build, version).collect())
        seen.append(folders(path))
        assert len(seen[-1]) == 1
        return rows, len(seen) < 2 or seen[-1] != seen[-2]

    build = lambda: spark.read.parquet(given)
    assert stage(build) == ([0, 1, 2, 3, 4], True) and stage(build) == ([0, 1, 2, 3, 4], False)
    spark.range(5, 7).write.mode("append").parquet(given)
    assert stage(build) == (list(range(7)), True) and stage(build)[1] is False
    spark.range(7).write.mode("overwrite").parquet(given)  # the same rows in other files
    assert stage(build)[1] is True
    other = lambda: spark.read.parquet(given).filter("id > 2")
    assert stage(other) == ([3, 4, 5, 6], True) and stage(other)[1] is False
    assert stage(other, "2")[1] is True and stage(other, "2")[1] is False

    def in_tasks(add):
        def plus(parts):
            for part in parts:
                yield part.assign(id=part["id"] + add)

        return plus

    one = lambda: spark.read.parquet(given).mapInPandas(in_tasks(10), "id long")
    two = lambda: spark.read.parquet(given).mapInPandas(in_tasks(20), "id long")
    assert stage(one)[0] == list(range(10, 17)) and stage(one)[1] is False and stage(two)[0] == list(range(20, 27))


def test_half_written_stage_is_not_read(spark, tmp_path):
    path = tmp_path / "stage"
    (path / "rows-of-a-lost-run").mkdir(parents=True)
    spark.range(3).write.mode("overwrite").parquet(str(path / "rows-of-a-lost-run"))
    (path / stages.MANIFEST).write_text('{"fingerprint": "x", "ro')
    build = lambda: spark.range(4)
    assert stages.cached_stage(spark, str(path), build).count() == 4
    assert stages.cached_stage(spark, str(path), build).count() == 4


def test_shared_folder_is_the_one_of_the_session(spark):
    folder = shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    assert new_stage_path(spark, "x").startswith(folder)
    assert write_and_read(spark.range(3), "r").count() == 3


def test_split_filter_reaches_the_scan(spark, small, capsys):
    readers.pick_split(spark.read.parquet(f"{small}/labels.parquet"), "quality", 1).explain()
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,1)]" in capsys.readouterr().out
