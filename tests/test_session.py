"""Intermediate tables and their removal."""

from pathlib import Path

from pyspark.sql import functions as F

from wardlight.session import remove, scratch, shared_folder, stored


def _files(spark):
    return {p for p in Path(shared_folder(spark)).rglob("*.parquet")}


def test_scope_removes_what_is_not_kept(spark):
    before = _files(spark)
    with scratch(spark):
        inner = stored(spark.range(10))
        assert inner.count() == 10 and _files(spark) > before
        with scratch(spark):
            deep = stored(inner.where("id > 3"), keep=True)
        out = stored(deep.where("id > 5"), keep=True)
    assert sorted(r.id for r in out.collect()) == [6, 7, 8, 9]
    left = {p.parent for p in _files(spark) - before}
    assert len(left) == 1
    remove(str(left.pop()))
    remove(f"{shared_folder(spark)}/never-there")


def test_stored_drops_shuffle_files_and_keeps_the_setting(spark):
    local = Path(spark.sparkContext.getConf().get("spark.local.dir"))
    count = lambda: len(list(local.rglob("shuffle_*.data")))
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = count(), spark.conf.get(name, None)
    stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).collect()
    assert count() <= before and spark.conf.get(name, None) == setting
