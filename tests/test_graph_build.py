"""A graph built in one batch, in several, again, with changed outputs, and after a process died."""

import json

import pytest

from scholia.operators.graph_build import GraphTable


def output(entities, relations, garbage=""):
    body = json.dumps({"entities": [dict(zip(("name", "type", "description", "aliases"), e)) for e in entities], "relations": [dict(zip(("source", "target", "type", "description"), r)) for r in relations]}, ensure_ascii=False)
    return f"Here:\n```json\n{body}\n```" if garbage == "fence" else garbage or body


ROWS = [
    ("a.md", 0, output([("Alice", "Person", "", ["Al"]), ("MIT", "", "a school")], [("Alice", "MIT", "WORKS_FOR", "old")], "fence")),
    ("a.md", 1, output([("Alice", "", "a researcher", ["Lis"])], [("Alice", "China", "LIVES_IN", "")])),
    ("b.md", 0, output([("MIT", "Organization", "later"), (" ", "x", "y")], [("Alice", "MIT", "WORKS_FOR", "new"), ("", "MIT", "T", ""), ("MIT", "", "T", "")])),
    ("b.md", 1, output([], [], "nothing to read here")),
    ("c.md", 0, output([(f"n{i}", "T", "") for i in range(30)], [])),
    ("d.md", 0, None),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "source string, seq bigint, raw string")


def graph(g):
    return sorted(tuple(r) for r in g.entities().select("name", "type", "description").collect()), sorted(tuple(r) for r in g.relations().select("source", "target", "type", "description", "weight").collect())


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    g = GraphTable(spark, str(tmp_path_factory.mktemp("g") / "one"), 4)
    assert g.add(frame(spark, ROWS)) == ["a.md", "b.md", "c.md", "d.md"]
    return graph(g)


def test_one_build(whole):
    entities, relations = whole
    assert ("Alice", "Person", "a researcher") in entities and ("MIT", "Organization", "a school") in entities and ("China", "Other", "") in entities
    assert sum(n.startswith("n") for n, _, _ in entities) == 20 and not any(n.strip() == "" for n, _, _ in entities)
    assert relations == [("Alice", "China", "LIVES_IN", "", 1.0), ("Alice", "MIT", "WORKS_FOR", "new", 1.0)]


def test_batches_changes_and_a_death_lead_to_the_same(spark, tmp_path, whole, monkeypatch):
    path = str(tmp_path / "g")
    g = GraphTable(spark, path, 4)
    assert g.add(frame(spark, [r for r in ROWS if r[0] in ("b.md", "d.md")])) == ["b.md", "d.md"]
    assert g.add(frame(spark, ROWS)) == ["a.md", "c.md"]  # what is in is skipped
    assert graph(g) == whole and g.add(frame(spark, ROWS)) == []
    other = [("a.md", 0, output([("Bob", "Person", "")], [("Bob", "MIT", "KNOWS", "")]))]

    class Died(BaseException):
        pass

    real = g.progress.replace

    def dies(*a, **k):
        real(*a, **k)
        raise Died

    monkeypatch.setattr(g.progress, "replace", dies)
    with pytest.raises(Died):
        g.add(frame(spark, other))
    again = GraphTable(spark, path, 4)
    assert graph(again) == whole
    assert again.add(frame(spark, other)) == ["a.md"]
    entities, relations = graph(again)
    assert [n for n, _, _ in entities if not n.startswith("n")] == ["Alice", "Bob", "MIT"] and relations == [("Alice", "MIT", "WORKS_FOR", "new", 1.0), ("Bob", "MIT", "KNOWS", "", 1.0)]
    assert again.add(frame(spark, [r for r in ROWS if r[0] == "a.md"])) == ["a.md"] and graph(again) == whole
