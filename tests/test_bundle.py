"""Published versions of fitted statistics."""

import pytest

from cardwatch.session import scratch_path
from cardwatch.sources import tables


def test_readers_see_whole_versions_only(spark, monkeypatch):
    root = scratch_path(spark, "published")
    one = {"counts": spark.range(3).withColumnRenamed("id", "n")}
    two = {"counts": spark.range(5).withColumnRenamed("id", "n"), "more": spark.range(1)}
    with pytest.raises(FileNotFoundError):
        tables.load_published(spark, root)
    first = tables.publish_fitted_stats(one, {"threshold": 0.4}, root)
    real = tables.save_fitted_stats

    def stopped(fitted, metadata, path):
        real({"counts": fitted["counts"]}, metadata, path)
        raise InterruptedError("stopped before the last table")

    monkeypatch.setattr(tables, "save_fitted_stats", stopped)
    with pytest.raises(InterruptedError):
        tables.publish_fitted_stats(two, {"threshold": 0.5}, root)
    monkeypatch.undo()
    loaded, meta = tables.load_published(spark, root)
    assert loaded["counts"].count() == 3 and meta["threshold"] == 0.4
    second = tables.publish_fitted_stats(two, {"threshold": 0.5}, root)
    assert tables.published_versions(spark, root) == [first, second]
    loaded, meta = tables.load_published(spark, root, config_threshold=0.1)
    assert loaded["counts"].count() == 5 and loaded["more"].count() == 1
    assert meta["threshold"] == 0.5 and meta["threshold_mismatch"]
    assert tables.load_published(spark, root, first)[0]["counts"].count() == 3
    with pytest.raises(FileNotFoundError):
        tables.load_published(spark, root, "another")
