"""Questions from templates, and faults of tool calls, on odd rows."""

from scholia.operators import synthesis as Y

SCHEMA = {"t": {"required": ["a", "b c"], "properties": {"a": {"type": "integer"}, "b c": {"type": "string"}, "n": {"type": "number"}, "f": {"type": "boolean"}, "l": {"type": "array"}, "o": {"type": "object"}, "any": {}, "odd": {"type": "other"}, "none": None}}}
CALLS = [
    (1, "t", '{"a": 1, "b c": "x", "n": 1.5, "f": false, "l": [], "o": {}, "any": 3, "odd": [1], "more": null}', []),
    (2, "t", '{"a": true, "b c": 5, "n": true, "f": 0, "l": {}, "o": []}', ["参数 a 应为 integer", "参数 b c 应为 string", "参数 n 应为 number", "参数 f 应为 boolean", "参数 l 应为 array", "参数 o 应为 object"]),
    (3, "t", '{"a": null, "n": 3}', ["缺少必填参数：b c", "参数 a 应为 integer"]),
    (4, "t", '{"a": 5.0, "b c": "", "n": 1e3}', ["参数 a 应为 integer"]),
    (5, "t", '{"a": 123456789012345678901234567890, "b c": "big"}', []),
    (6, "t", "[1, 2]", [Y.NO_OBJECT]),
    (7, "t", "not json", [Y.NO_OBJECT]),
    (8, "t", None, [Y.NO_OBJECT]),
    (9, "t", '"text"', [Y.NO_OBJECT]),
    (10, "other", "{}", []),
    (11, None, '{"a": "x"}', []),
    (12, "t", "{}", ["缺少必填参数：a", "缺少必填参数：b c"]),
]


def test_a_row_for_each_fault(spark):
    calls = spark.createDataFrame([c[:3] for c in CALLS], "call_id bigint, tool string, params string")
    got = {}
    for r in Y.violations(calls, SCHEMA).orderBy("call_id", "place").collect():
        got.setdefault(r.call_id, []).append(r.violation)
    assert got == {i: want for i, _, _, want in CALLS if want}


SECTIONS = [("s1", "T1", ["alpha", "beta", "alpha", " ", "gamma"]), ("s1", "T2", ["alpha"]), ("s2", "T1", []), ("s2", "T2", None), (None, "T3", ["delta", "epsilon"])]


def drawn(spark, seed, existing=(), **options):
    s = spark.createDataFrame(SECTIONS, "source string, section_title string, entities array<string>")
    old = spark.createDataFrame([(q,) for q in existing], "question string") if existing else None
    return sorted(((r.source or "", r.section_title, r.difficulty, r.question) for r in Y.questions(s, seed=seed, existing=old, **options).collect()))


def test_draws_without_replacement(spark):
    one = drawn(spark, 1)
    assert one == drawn(spark, 1) != drawn(spark, 2)
    assert len({q for *_, q in one}) == len(one) and not any("{" in q for *_, q in one)
    sizes = {}
    for source, title, difficulty, _ in one:
        sizes[source, title, difficulty] = sizes.get((source, title, difficulty), 0) + 1
    assert sizes == {("", "T3", "easy"): 2, ("", "T3", "medium"): 2, ("s1", "T1", "easy"): 2, ("s1", "T1", "medium"): 2, ("s1", "T2", "medium"): 2}  # T2's easy ones could all be T1's
    rest = drawn(spark, 1, [q for *_, q in one])
    assert rest and not {q for *_, q in rest} & {q for *_, q in one}
    whole = drawn(spark, 1, easy=10**6, medium=10**6)
    # by entity: four easy ones, of which T2's are asked by T1 already; by pairs and single ones the medium ones, those with a title in each section
    assert sum(d == "easy" for _, _, d, _ in whole) == 4 * 3 + 4 * 2
    assert {q for s, t, _, q in whole if (s, t) == ("s1", "T2")} == {"在 T2 场景下，alpha 是如何工作的？", "alpha 在 T2 中的地位/作用是什么？"}
