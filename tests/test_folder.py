"""A folder kept in a table: two runs rewrite only what changed, failures leave what was, files that go are forgotten."""

import os

import pytest

from scholia.operators import source_store as S
from scholia.streaming.folder import FolderTable


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "files"
    (d / "deep").mkdir(parents=True)
    (d / "a.md").write_text("---\ntitle: Rules\npermissions: hr\n---\n# Rules\n\nFirst rule. Second rule.\n\n## Leave\n\nFive days of leave.\n")
    (d / "b.txt").write_text("Plain text of b. It has two sentences.")
    (d / "deep" / "b.txt").write_text("Another b. In a folder below.")
    (d / "c.csv").write_text("name,days\nAnn,5\nBob,7\n")
    (d / "picture.png").write_bytes(b"\x89PNG")
    return d


def texts(table):
    out = {}
    for r in table.chunks.rows().orderBy("source", "page", "chunk_index").collect():
        out.setdefault(r.source, []).append(r.text)
    return out


def ledger(table):
    return {r.source: (r.fingerprint, r.chunks) for r in table.ledger.rows().collect()}


def test_two_runs_rewrite_only_what_changed(spark, folder, tmp_path):
    table = FolderTable(spark, str(folder), str(tmp_path / "t"), buckets=4)
    assert table.follow(files_per_batch=2) == ["a.md", "b.txt", "c.csv", "deep/b.txt"]
    first, marks = texts(table), ledger(table)
    assert set(first) == set(marks) == {"a.md", "b.txt", "c.csv", "deep/b.txt"} and all(len(first[s]) == n for s, (_, n) in marks.items())
    assert any("Five days" in t for t in first["a.md"]) and {r.acl for r in table.chunks.rows(["a.md"]).collect()} == {"hr"} and {r.title for r in table.chunks.rows(["a.md"]).collect()} == {"Rules"}

    (folder / "b.txt").write_text("Plain text of b, changed. It has two sentences.")
    os.utime(folder / "c.csv", (1, 1))  # another time, the same contents
    (folder / "d.txt").write_text("Quite new.")
    again = FolderTable(spark, str(folder), str(tmp_path / "t"))
    generations = dict(again.chunks.manifest["generations"])
    assert again.refresh() == ["b.txt"]
    touched = {b for b, g in again.chunks.manifest["generations"].items() if generations.get(b) != g}
    assert len(touched) == 1  # the bucket of the one source that changed
    second = texts(again)
    assert "changed" in second["b.txt"][0] and {k: v for k, v in second.items() if k != "b.txt"} == {k: v for k, v in first.items() if k != "b.txt"}
    assert again.refresh() == [] and again.changed().count() == 0
    assert again.follow() == ["d.txt"] and texts(again)["d.txt"] == ["Quite new."]

    os.remove(folder / "deep" / "b.txt")
    assert again.forget() == ["deep/b.txt"] and "deep/b.txt" not in texts(again) and "deep/b.txt" not in ledger(again) and again.forget() == []


def test_a_ledger_that_fails_leaves_chunks_and_ledger_as_they_were(spark, folder, tmp_path, monkeypatch):
    table = FolderTable(spark, str(folder), str(tmp_path / "t"))
    table.follow()
    first, marks = texts(table), ledger(table)
    (folder / "b.txt").write_text("Changed, but the ledger fails.")

    def broken(*a, **k):
        raise OSError("no space")

    monkeypatch.setattr(table.ledger, "replace", broken)
    with pytest.raises(OSError, match="no space"):
        table.refresh()
    monkeypatch.undo()
    again = FolderTable(spark, str(folder), str(tmp_path / "t"))
    assert texts(again) == first and ledger(again) == marks
    assert again.refresh() == ["b.txt"] and texts(again)["b.txt"] == ["Changed, but the ledger fails."]


def test_a_file_that_no_longer_says_anything(spark, folder, tmp_path):
    table = FolderTable(spark, str(folder), str(tmp_path / "t"))
    table.follow()
    (folder / "b.txt").write_text(" \n")
    assert table.refresh() == ["b.txt"] and "b.txt" not in texts(table) and ledger(table)["b.txt"][1] == 0
    assert S.opened(spark, str(tmp_path / "t" / "chunks")).manifest["before"] is None


def test_a_process_that_dies_between_ledger_and_chunks(spark, folder, tmp_path, monkeypatch):
    table = FolderTable(spark, str(folder), str(tmp_path / "t"))
    table.follow()
    first = texts(table)
    (folder / "b.txt").write_text("Changed, and the process dies.")

    class Died(BaseException):
        pass

    real = table.ledger.replace

    def dies(*a, **k):
        real(*a, **k)
        raise Died

    monkeypatch.setattr(table.ledger, "replace", dies)
    with pytest.raises(Died):
        table.refresh()
    again = FolderTable(spark, str(folder), str(tmp_path / "t"))
    assert texts(again) == first
    assert "b.txt" in again.refresh() and texts(again)["b.txt"] == ["Changed, and the process dies."]
    assert again.refresh() == []
