import pytest

from lodestone.operators import snapshots


def test_readers_see_whole_versions_only(spark, tmp_path):
    path = str(tmp_path / "s")
    for version, n in (("1", 3), ("2", 5)):
        snapshots.write_snapshot(spark.range(n), path, version)
        snapshots.publish(spark, path, version)
        assert snapshots.current(spark, path).count() == n
    with pytest.raises(ValueError, match="empty"):
        snapshots.write_snapshot(spark.range(0), path, "3")
    (tmp_path / "s" / "version=4").mkdir()
    for version in ("3", "4"):  # never written, and not to its end
        with pytest.raises(ValueError, match="whole"):
            snapshots.publish(spark, path, version)
    assert snapshots.current(spark, path).count() == 5
    snapshots.publish(spark, path, "1")
    assert snapshots.current(spark, path).count() == 3 and sorted(f.name for f in (tmp_path / "s").glob("pin*")) == ["pin.json"]
