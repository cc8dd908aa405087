import os
import shutil

import pytest

from lithoscan.sources import snapshot


def test_snapshot(spark, tmp_path):
    mark = snapshot.fingerprint(["/b", "/A", "/a/"], [])
    assert mark == snapshot.fingerprint(["/a", "/B"], []) != snapshot.fingerprint([], ["/a", "/b"])
    path = str(tmp_path / "s")
    with pytest.raises(snapshot.Rejected, match="manifest missing"):
        snapshot.load(spark, path, mark)
    tables = {"types": spark.range(3), "defs": spark.range(0).selectExpr("id", "'x' AS name")}
    snapshot.save(spark, tables, path, mark)
    snapshot.save(spark, tables, path, mark)
    got = snapshot.load(spark, path, mark)
    assert {k: v.count() for k, v in got.items()} == {"types": 3, "defs": 0} and got["defs"].columns == ["id", "name"]
    with pytest.raises(snapshot.Rejected, match="fingerprint"):
        snapshot.load(spark, path, "other")
    assert spark.read.parquet(f"{path}/digests/*").where("length(sha256) = 64 AND size > 0").count() >= 4
    stored = got["types"].inputFiles()
    folder = os.path.dirname(stored[0].removeprefix("file://"))
    spark.range(5).write.mode("append").parquet(folder)
    with pytest.raises(snapshot.Rejected, match="row count mismatch: types"):
        snapshot.load(spark, path, mark)
    assert snapshot.load(spark, path, mark, whole=False)["types"].count() == 8


def _damaged(spark, tmp_path, damage):
    """The reason why a snapshot is rejected after ``damage(a stored file of types)``."""
    path = str(tmp_path / "s")
    snapshot.save(spark, {"types": spark.range(100), "defs": spark.range(2)}, path, "m")
    first = snapshot.load(spark, path, "m")["types"].inputFiles()[0].removeprefix("file://")
    for crc in (tmp_path / "s").rglob(".*.crc"):  # the local file system's own check
        crc.unlink()
    damage(first)
    spark.catalog.clearCache()
    with pytest.raises(snapshot.Rejected) as found:
        snapshot.load(spark, path, "m")
    return str(found.value)


def test_stored_files_are_checked_before_tables(spark, tmp_path):
    def swap(file):
        data = open(file, "rb").read()
        open(file, "wb").write(data[:40] + bytes([data[40] ^ 1]) + data[41:])

    assert _damaged(spark, tmp_path / "a", swap) == "hash mismatch: types"
    assert _damaged(spark, tmp_path / "b", lambda file: open(file, "ab").write(b"x")) == "size mismatch: types"
    assert _damaged(spark, tmp_path / "c", os.unlink) == "file missing: types"
    assert _damaged(spark, tmp_path / "d", lambda file: shutil.rmtree(os.path.dirname(file))) == "file missing: a table's folder"
    digests = lambda file: os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(file))), "digests")
    assert _damaged(spark, tmp_path / "e", lambda file: shutil.rmtree(digests(file))) == "digests missing"


@pytest.mark.parametrize("told, reason", [("{", "manifest unreadable"), ('{"version": 1, "folder": "x", "relations": {}}', "version mismatch")])
def test_manifests_that_cannot_be_used(spark, tmp_path, told, reason):
    (tmp_path / "manifest").mkdir()
    (tmp_path / "manifest/part.json").write_text(told)
    with pytest.raises(snapshot.Rejected, match=reason):
        snapshot.load(spark, str(tmp_path), "m")
