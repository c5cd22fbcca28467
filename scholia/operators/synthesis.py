"""Questions made from templates and entities, and calls of tools checked against their schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Templates of questions about one entity and about two, by difficulty.
TEMPLATES = (
    ("tmpl_1", "easy", "{entity} 是什么？"),
    ("tmpl_2", "easy", "{entity} 有哪些特点？"),
    ("tmpl_3", "easy", "请简述 {entity} 的作用。"),
    ("tmpl_4", "easy", "{entity} 的核心原理是什么？"),
    ("tmpl_5", "medium", "{entity1} 和 {entity2} 有什么区别？"),
    ("tmpl_6", "medium", "相比 {entity2}，{entity1} 有什么优势？"),
    ("tmpl_7", "medium", "在 {section_title} 场景下，{entity} 是如何工作的？"),
    ("tmpl_8", "medium", "如果 {entity} 失效，可能的原因有哪些？"),
    ("tmpl_9", "medium", "{entity} 的核心要点是什么？"),
    ("tmpl_10", "medium", "{entity} 在 {section_title} 中的地位/作用是什么？"),
)
#: How a call's faults are told.
NO_OBJECT, MISSING, WRONG = "参数必须是 JSON object / dict", "缺少必填参数：", ("参数 ", " 应为 ")


def questions(sections: DataFrame, easy: int = 2, medium: int = 2, seed: int = 0, existing: DataFrame | None = None, most_entities: int = 8) -> DataFrame:
    """(source, section_title, template_id, difficulty, question): for each section (source, section_title, entities) so many questions of either difficulty, drawn without replacement from its templates filled with its
    entities (the first ``most_entities``, each once). The draw is by a hash of seed, section and question, so a rerun draws alike. Questions that are in ``existing`` (question), or that another section asks too, aren't asked again: of
    equal ones the first by source and title stays."""
    rows = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(d).alias("difficulty"), F.lit(t).alias("form")) for i, d, t in TEMPLATES])
    s = sections.select("source", "section_title", F.slice(F.array_distinct(F.filter("entities", lambda e: F.trim(e) != "")), 1, most_entities).alias("entities"))
    s = s.select("source", "section_title", "entities", F.explode("entities").alias("one"), F.lit(0).alias("x")).withColumn("t", F.explode(rows))
    pairs = F.col("t.form").contains("{entity1}")
    s = s.withColumn("two", F.explode(F.when(pairs, F.filter("entities", lambda e: e != F.col("one"))).otherwise(F.array(F.lit("")))))
    text = F.col("t.form")
    for name, value in (("{section_title}", F.col("section_title")), ("{entity1}", F.col("one")), ("{entity2}", F.col("two")), ("{entity}", F.col("one"))):
        text = F.replace(text, F.lit(name), value)
    made = s.select("source", "section_title", F.col("t.id").alias("template_id"), F.col("t.difficulty").alias("difficulty"), text.alias("question"))
    if existing is not None:
        made = made.join(existing.select("question"), "question", "left_anti")
    first = W.partitionBy("question").orderBy("source", "section_title", "template_id")
    made = made.withColumn("n", F.row_number().over(first)).where("n = 1")
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), "source", "section_title", "question"))
    place = F.row_number().over(W.partitionBy("source", "section_title", "difficulty").orderBy(draw, "question"))
    wanted = F.when(F.col("difficulty") == "easy", easy).otherwise(medium)
    return made.withColumn("n", place).where(F.col("n") <= wanted).select("source", "section_title", "template_id", "difficulty", "question")


def _fits(kind: str, told: Column) -> Column:
    """Whether a value of the type that Spark tells of a variant is one of a schema's type."""
    whole = told.isin("BIGINT") | told.rlike(r"^DECIMAL\((19|[23]\d),0\)$")  # what fits 64 bits and is told as a decimal was written with a point
    forms = {
        "integer": whole,
        "number": whole | told.isin("DOUBLE", "FLOAT") | told.startswith("DECIMAL"),
        "boolean": told == "BOOLEAN",
        "string": told == "STRING",
        "array": told.startswith("ARRAY"),
        "object": told.startswith("OBJECT"),
    }
    return forms.get(kind, F.lit(True))


def faults(params: Column, schema: dict) -> Column:
    """The faults of a call's parameters (a JSON text) under a schema, in order: an array of texts, empty where there are none. Of the schema what is required, and the types of properties, count; a property of an unknown type, or that
    the schema doesn't name, may be anything. What is no JSON object has that one fault."""
    v = F.try_parse_json(params)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    found = []
    for key in schema.get("required") or []:
        found.append(F.when(F.try_variant_get(v, _path(key), "variant").isNull(), F.lit(f"{MISSING}{key}")))
    for key, own in (schema.get("properties") or {}).items():
        value, kind = F.try_variant_get(v, _path(key), "variant"), (own or {}).get("type")
        if kind is not None:
            found.append(F.when(value.isNotNull() & ~_fits(kind, F.schema_of_variant(value)), F.lit(f"{WRONG[0]}{key}{WRONG[1]}{kind}")))
    some = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")
    return F.when(is_object, some).otherwise(F.array(F.lit(NO_OBJECT)))


def _path(key: str) -> str:
    return f"$['{key}']"


def violations(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(call_id, place, violation): a row for each fault of each call (call_id, tool, params). A tool without a schema takes any object."""
    told = faults(F.col("params"), {})
    for tool, schema in schemas.items():
        told = F.when(F.col("tool") == tool, faults(F.col("params"), schema)).otherwise(told)
    return calls.select("call_id", F.posexplode(told).alias("place", "violation"))
