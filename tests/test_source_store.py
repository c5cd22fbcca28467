"""Sources replaced as a whole, and what is there when a step fails."""

import pytest
from pyspark.sql import functions as F

from scholia.operators import source_store as S

SCHEMA = "source string, chunk_index int, text string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def there(store):
    return sorted((r.source, r.chunk_index, r.text) for r in store.rows().collect())


OLD = [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "three"), ("c", 0, "four")]


@pytest.fixture
def store(spark, tmp_path):
    s = S.created(spark, str(tmp_path / "t"), SCHEMA, buckets=3)
    s.replace(frame(spark, *OLD))
    return s


def test_replaced_and_removed(spark, store):
    calls = []
    store.replace(frame(spark, ("a", 0, "new"), ("d", 0, "five")), on_commit=lambda: calls.append(there(S.SourceStore(spark, store.folder, store.number, store.manifest))))
    want = [("a", 0, "new"), ("b", 0, "three"), ("c", 0, "four"), ("d", 0, "five")]
    assert there(store) == want == calls[0] == there(S.opened(spark, store.folder.path))
    store.remove(spark.createDataFrame([("b",), ("zzz",)], "source string"))
    assert there(store) == [r for r in want if r[0] != "b"]
    assert sorted(r.text for r in store.rows(["a", "d"]).collect()) == ["five", "new"]
    store.cleaned()
    assert there(S.opened(spark, store.folder.path)) == [r for r in want if r[0] != "b"] and len([n for n in store.folder.names() if n.startswith("manifest")]) == 1


def test_old_rows_are_there_when_the_hook_fails(spark, store):
    def hook():
        raise OSError("no ledger")

    with pytest.raises(OSError, match="no ledger"):
        store.replace(frame(spark, ("a", 0, "new"), ("d", 0, "five")), on_commit=hook)
    assert there(store) == OLD == there(S.opened(spark, store.folder.path))
    assert len([n for n in store.folder.names() if n.startswith("change-")]) == 1  # that of the first rows


def test_old_rows_are_there_when_writing_fails(spark, store):
    bad = frame(spark, ("a", 0, "new")).withColumn("text", F.when(F.length("text") > 0, F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        store.replace(bad)
    assert there(store) == OLD == there(S.opened(spark, store.folder.path))


def test_a_change_broken_off_is_taken_back_by_the_next_one(spark, store):
    class Died(BaseException):
        pass

    def hook():
        raise Died

    with pytest.raises(Died):  # nothing is restored in this process
        store.replace(frame(spark, ("a", 0, "new")), on_commit=hook)
    assert there(store) != OLD
    again = S.opened(spark, store.folder.path)
    assert there(again) == OLD and again.manifest["before"] is None
    again.replace(frame(spark, ("a", 0, "new")))
    assert there(again) == [("a", 0, "new"), *OLD[2:]]


def test_what_cannot_be_put_back_is_said(spark, store, monkeypatch):
    def hook():
        monkeypatch.setattr(store.folder, "put", lambda *a: False)
        raise OSError("no ledger")

    with pytest.raises(S.RestoreFailed, match="no ledger"):
        store.replace(frame(spark, ("a", 0, "new")), on_commit=hook)
    assert there(S.opened(spark, store.folder.path)) == OLD


def test_rows_of_other_sources_and_lost_races_are_refused(spark, store):
    with pytest.raises(ValueError, match="aren't among"):
        names = [f"x{i}" for i in range(40)]
        store.replace(frame(spark, *[(n, 0, "t") for n in names]), spark.createDataFrame([("a",)], "source string"))
    assert there(store) == OLD
    other = S.opened(spark, store.folder.path)
    other.replace(frame(spark, ("b", 0, "theirs")))
    with pytest.raises((RuntimeError, S.RestoreFailed)):
        store.replace(frame(spark, ("b", 0, "mine")))
    assert there(S.opened(spark, store.folder.path)) == sorted([*OLD[:2], ("b", 0, "theirs"), OLD[3]])
    with pytest.raises(ValueError, match="there is a table"):
        S.created(spark, store.folder.path, SCHEMA)
