"""Functions over records: citations, prompts, model output, addresses, secrets, positions in sources, outlines. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .text import let, strip

#: Names of fields whose values are never shown.
SECRET_FIELDS = "password passwd pwd secret token api_key apikey access_token refresh_token authorization cookie credential private_key".split()


def citation(index: Column, title: Column, source: Column, page: Column, extension: Column) -> Column:
    """[1] title（来源：source，第 3 页）; pages of PDF files, sections of others."""
    unit = F.when(F.lower(F.coalesce(extension, F.lit(""))) == ".pdf", " 页").otherwise(" 节")
    return F.concat(F.lit("["), index.cast("string"), F.lit("] "), title, F.lit("（来源："), F.coalesce(source, F.lit("未知")), F.lit("，第 "), F.coalesce(page.cast("string"), F.lit("—")), unit, F.lit("）"))


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """A template with its known {names} put in; others stay as they are."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def memory_block(memories: Column, most: int = 10) -> Column:
    """Lines of an array of (key, value), under a heading; nothing without any."""
    lines = F.array_join(F.transform(F.slice(memories, 1, most), lambda m: F.concat(F.lit("- "), m["key"], F.lit("："), m["value"])), "\n")
    return F.when(F.size(memories) <= 0, "").otherwise(F.concat(F.lit("【用户长期记忆】\n"), lines))


def count_answer(counting: Column, entries: Column, prefix: Column) -> Column:
    """The answer to how many entries a list has, from its recorded count; null for other questions or without a count."""
    section = strip(F.element_at(F.split(F.element_at(F.split(F.coalesce(prefix, F.lit("")), "｜"), 1), " > "), -1))
    name = F.when(section == "", "编号条目列表").otherwise(section)
    return F.when(counting & (entries > 0), F.concat(F.lit("根据知识库检索结果，「"), name, F.lit("」部分为编号条目列表，共 "), entries.cast("string"), F.lit(" 条。 [1]")))


def salvaged(raw: Column, schema: str) -> Column:
    """A JSON object in a model's output: fences and prose around it go, commas before closing brackets too; null where it still can't be read."""
    body = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)(\{.*\})", 1)
    return F.from_json(F.regexp_replace(body, r",\s*([\]}])", "$1"), schema, {"mode": "PERMISSIVE"})


def react_step(raw: Column) -> Column:
    """Thought, action, its input as JSON text, and final answer of an agent's output; none, null and 无 are no action."""
    get = lambda p: F.nullif(strip(F.regexp_extract(F.coalesce(raw, F.lit("")), p, 1)), F.lit(""))
    action = F.regexp_replace(get(r"(?m)^\s*Action\s*[:：]\s*(.*)$"), r"[,.; ]+$", "")
    return F.struct(
        get(r"(?s)Thought\s*[:：]\s*(.*?)(?=\n\s*(?:Action|Final)|\z)").alias("thought"), F.when(~F.lower(action).isin("none", "null", "", "无", "不需要"), action).alias("action"),
        F.regexp_replace(get(r"(?s)Action\s*Input\s*[:：]\s*(\{.*?\})\s*(?:\n|\z)"), r",\s*([\]}])", "$1").alias("action_input"), get(r"(?s)Final\s*Answer\s*[:：]\s*(.*)\z").alias("final_answer"),
    )


def masked(fields: Column) -> Column:
    """A map with secret values hidden and long ones cut."""
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).isin(SECRET_FIELDS), "[REDACTED]").when(F.length(v) > 100, F.concat(F.substring(v, 1, 50), F.lit("...[TRUNCATED]"))).otherwise(v))


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for other text."""
    parts = F.transform(F.split(ip, r"\."), lambda p: p.try_cast("long"))
    ok = ip.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") & F.forall(parts, lambda p: p <= 255)
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p))


def in_network(ip: Column, cidr: str) -> Column:
    base, bits = cidr.split("/")
    low = 0
    for p in base.split("."):
        low = low * 256 + int(p)
    size = 1 << (32 - int(bits))
    low -= low % size
    return F.coalesce(ip_number(ip).between(low, low + size - 1), F.lit(False))


def client_ip(direct: Column, forwarded: Column, real: Column, trusted: list[str]) -> Column:
    """The first forwarded address, or the real one, where a trusted proxy asks; else who asks."""
    proxy = F.lit(False)
    for cidr in trusted:
        proxy = proxy | in_network(direct, cidr)
    first = F.nullif(strip(F.element_at(F.split(forwarded, ","), 1)), F.lit(""))
    return F.coalesce(F.when(proxy, F.coalesce(first, F.nullif(strip(real), F.lit("")))), direct, F.lit("unknown"))


def located(body: Column, source: Column) -> Column:
    """Where a chunk begins in its source, both without white space: by its first 48, 32, 20 or 12 characters; null where none is found."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    return let(bare(body), lambda b: let(bare(source), lambda s: F.coalesce(*[F.when((F.length(b) >= 8) & (F.instr(s, F.substring(b, 1, n)) > 0), F.instr(s, F.substring(b, 1, n)) - 1) for n in (48, 32, 20, 12)])))


def outline_paths(pages: DataFrame, outline: DataFrame, levels: int = 6) -> DataFrame:
    """(doc, page, path): for each page the headings in force, from outline rows (doc, page, seq, level, title). A heading of a level ends those of its level and below."""
    marks = outline.withColumn("__n", F.row_number().over(W.partitionBy("doc").orderBy("page", "seq")))
    w = W.partitionBy("doc").orderBy("__n").rowsBetween(W.unboundedPreceding, 0)
    for k in range(1, levels + 1):
        at = F.last(F.when(F.col("level") == k, F.struct("__n", "title")), ignorenulls=True).over(w)
        above = F.last(F.when(F.col("level") < k, F.col("__n")), ignorenulls=True).over(w)
        same = F.last(F.when(F.col("level") <= k, F.struct("__n", "level")), ignorenulls=True).over(w)
        marks = marks.withColumn(f"__t{k}", F.when((at["__n"] > F.coalesce(above, F.lit(0))) & (same["level"] == k) | (at["__n"] == F.col("__n")), at["title"]))
    path = F.filter(F.array(*[F.when(F.col("level") >= k, F.col(f"__t{k}")) for k in range(1, levels + 1)]), lambda t: t.isNotNull())
    last = marks.withColumn("path", path).groupBy("doc", "page").agg(F.max_by("path", "__n").alias("path"))
    filled = pages.join(last, ["doc", "page"], "left")
    return filled.withColumn("path", F.last("path", ignorenulls=True).over(W.partitionBy("doc").orderBy("page").rowsBetween(W.unboundedPreceding, 0))).where("path is not null").select("doc", "page", "path")
