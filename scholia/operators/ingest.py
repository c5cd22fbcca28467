"""From sections to chunks that know where they come from: parents, breadcrumbs, prefixes, groups and summaries; what users ask to be remembered; graph facts for a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scholia.functions import splitting as X
from scholia.functions import text as T
from scholia.sources.tables import spread, written

#: The wordings of a list's note, of questions about a section and about a whole text, and of the graph's piece of context.
NOTE = ("本节为编号条目列表，共", "条（[", "]-[", "]）")
ABOUT = ("请用一句话介绍「", "」的内容。", "请用一句话介绍本文的主题。")
GRAPH_TITLE, GRAPH_HEAD = "知识图谱", "以下是知识图谱中与问题相关的实体关系（供参考；与文档片段冲突时以文档片段为准）：\n"


def breadcrumb(title: Column, path: Column) -> Column:
    """Title and headings down to a section, the title once where the first heading repeats it."""
    whole = F.when(F.get(path, 0) == title, path).otherwise(F.concat(F.array(title), F.coalesce(path, F.array().cast("array<string>"))))
    return F.array_join(whole, " > ")


def prefixed(text: Column, prefix: Column, fallback: Column) -> Column:
    """The text under 【prefix】, or under the fallback where there is no prefix; as it is without either."""
    p = F.coalesce(F.when(prefix != "", prefix), F.when(fallback != "", fallback))
    return F.when(p.isNull(), text).otherwise(F.concat(F.lit("【"), p, F.lit("】\n"), text))


def without_breadcrumb(text: Column) -> Column:
    """The text without a leading 【…】."""
    s = T.strip(F.coalesce(text, F.lit("")))
    return F.when(s.rlike("(?s)^【.*】"), F.regexp_replace(s, r"(?s)^【[^】]*】\s*", "")).otherwise(s)


def entry_note(c: Column, least: int = 5) -> Column:
    """For a section that lists entries numbered [n] without a gap: how many there are and from which to which; else empty."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?m)^\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int"))
    n, text = T.entry_count(c, least), lambda x: x.cast("string")
    return F.when(n.isNull(), "").otherwise(F.concat(F.lit(NOTE[0]), text(n), F.lit(NOTE[1]), text(F.array_min(numbers)), F.lit(NOTE[2]), text(F.array_max(numbers)), F.lit(NOTE[3])))


def enriched(files: DataFrame, default_acl: str = "*", default_status: str = "active") -> DataFrame:
    """Sections of Markdown files (source, raw, updated_at) with what the gate and the index ask for: title, groups, status, department and dates from the block of metadata at the top, else from the first
    heading or the file's name; heading path, breadcrumb and chunk prefix; the number of entries of a list. Sections are numbered from 1 as pages; blank ones are left out."""
    f = files.withColumn("__f", T.frontmatter(F.coalesce("raw", F.lit(""))))
    get = lambda *names: F.coalesce(*[F.try_element_at("__f.meta", F.lit(n)) for n in names])
    named = F.regexp_replace("source", r"\.[^.]+$", "")
    groups = T.acl(get("permissions", "access", "acl"))
    status = F.when(get("status").isNull(), T.status(F.lit(default_status))).otherwise(T.status(get("status")))
    f = f.withColumns({"__s": X.section_column(F.col("__f.body")), "acl": F.when(groups == "*", T.acl(F.lit(default_acl))).otherwise(groups), "doc_status": status, "department": F.nullif(F.coalesce(get("department"), F.lit("")), F.lit("")), "valid_until": T.any_date(get("valid_until", "expires_at"))})
    first = F.when(F.size(F.get("__s", 0)["path"]) > 0, F.get("__s", 0)["title"])
    f = f.withColumn("title", F.coalesce(F.nullif(F.coalesce(get("title"), F.lit("")), F.lit("")), first, named))
    out = f.select("source", "title", "acl", "doc_status", "department", "valid_until", "updated_at", F.posexplode("__s").alias("__i", "s")).where(T.strip(F.col("s.text")) != "")
    out = out.withColumns({"page": F.col("__i") + 1, "content": F.col("s.text"), "path": F.col("s.path"), "note": entry_note(F.col("s.text"))})
    note = F.when(F.col("note") != "", F.concat(F.lit("｜"), "note")).otherwise("")
    last = F.when(F.size("path") > 0, F.element_at("path", -1)).otherwise("")
    return out.withColumns({"breadcrumb": F.concat(breadcrumb(F.col("title"), F.col("path")), note), "chunk_prefix": F.concat(last, note)}).drop("__i", "s")


def demo_questions(sections: DataFrame, keywords: int = 4) -> DataFrame:
    """(source, page, question, reference_answer, expected_sources, expected_keywords): an evaluation item for each section (source, page, title, content): its first paragraph answers, and runs of two to six
    CJK characters of it, or the title, are expected."""
    first = F.substring_index("content", "\n\n", 1)
    words = F.array_distinct(F.regexp_extract_all(first, F.lit("[一-鿿]{2,6}"), F.lit(0)))
    question = F.when(F.col("page") > 1, F.concat(F.lit(ABOUT[0]), "title", F.lit(ABOUT[1]))).otherwise(ABOUT[2])
    expected = F.when(F.size(words) > 0, F.slice(words, 1, keywords)).otherwise(F.array("title"))
    return sections.select("source", "page", question.alias("question"), F.substring(first, 1, 200).alias("reference_answer"), F.array("source").alias("expected_sources"), expected.alias("expected_keywords"))


def archive_index(reports: DataFrame, by: str, order: str, most: int = 50) -> DataFrame:
    """The last ``most`` reports of each archive, newest first by ``place``, without the answers they quote."""
    w = W.partitionBy(by).orderBy(F.desc(order))
    return reports.drop("answer").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def version_list(summaries: DataFrame) -> DataFrame:
    """(doc, versions, latest): versions of each document in order."""
    g = summaries.groupBy("doc").agg(F.array_sort(F.collect_set("version")).alias("versions"))
    return g.withColumn("latest", F.element_at("versions", -1))


def section_key(source: Column, page: Column) -> Column:
    """The id that the chunks of one section share."""
    return F.substring(F.md5(F.concat_ws("|", source, page.cast("string"))), 1, 16)


def with_parents(sections: DataFrame, chunk_texts: Column, parent_characters: int = 2000) -> DataFrame:
    """Chunks of sections (source, page, content, title, path, note): small texts to search, each with its section's id and beginning to answer from, and the breadcrumb. The parent is carried along
    as the chunks are cut, so that nothing is joined or shuffled."""
    crumb = breadcrumb(F.col("title"), F.col("path"))
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("｜"), F.col("note"))).otherwise("")
    last = F.when(F.size("path") > 0, F.concat(F.element_at("path", -1), note)).otherwise(note)
    cut = sections.select("source", "page", section_key(F.col("source"), F.col("page")).alias("parent_id"), F.substring("content", 1, parent_characters).alias("parent_text"), F.concat(crumb, note).alias("breadcrumb"), last.alias("chunk_prefix"), F.posexplode(chunk_texts).alias("chunk_index", "text"))
    return cut.withColumn("id", F.md5(F.concat_ws("|", "source", F.col("page").cast("string"), F.col("chunk_index").cast("string"))))


def attach_parents(hits: DataFrame, sections: DataFrame, parent_characters: int = 2000) -> DataFrame:
    """``hits`` (source, page) with parent_id and parent_text of their section, for chunks cut without them."""
    parents = sections.select("source", "page", section_key(F.col("source"), F.col("page")).alias("parent_id"), F.substring("content", 1, parent_characters).alias("parent_text"))
    return hits.join(parents, ["source", "page"], "left")


def packed(context: DataFrame, group_characters: int = 3000, most_groups: int = 6) -> DataFrame:
    """(query_id, group, position) from 1: the chunks of each query (query_id, position, content) in groups of at most ``group_characters``, a longer chunk by itself; what comes after ``most_groups`` is left
    out, and a query whose chunks fit in one group has none. A context is of bounded size; it is folded in order."""
    items = context.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", F.length("content").alias("size")))).alias("c"))
    kind = "array<struct<group:int,position:bigint>>"
    start = F.struct(F.lit(1).alias("g"), F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = (a["used"] > 0) & (a["used"] + x["size"] > group_characters)
        g = F.when(new, a["g"] + 1).otherwise(a["g"])
        return F.struct(g.alias("g"), F.when(new, x["size"].cast("long")).otherwise(a["used"] + x["size"]).alias("used"), F.concat(a["out"], F.array(F.struct(g.alias("group"), x["position"].cast("long").alias("position")))).cast(kind).alias("out"))

    folded = items.select("query_id", F.aggregate("c", start, step, lambda a: a["out"]).alias("out")).where(F.element_at("out", -1)["group"] > 1)
    return folded.select("query_id", F.explode("out").alias("o")).select("query_id", "o.group", "o.position").where(F.col("group") <= most_groups)


def group_summaries(context: DataFrame, groups: DataFrame, summary: Column | None = None, characters: int = 300) -> DataFrame:
    """(query_id, group, text): a summary of each group where there is one, else the beginning of its own text, marked as such."""
    both = context.join(groups, ["query_id", "position"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "content"))), lambda x: x["content"]), "")
    per = both.groupBy("query_id", "group").agg(joined.alias("text")).withColumn("__n", F.max("group").over(W.partitionBy("query_id")))
    made = T.strip(summary) if summary is not None else F.lit("")
    head = T.strip(F.substring("text", 1, characters))
    place = F.concat(F.lit("（第"), F.col("group").cast("string"), F.lit("/"), F.col("__n").cast("string"), F.lit("部分"))
    text = F.when(made != "", F.concat(place, F.lit("）"), made)).when(head != "", F.concat(place, F.lit("·原文摘录）"), head, F.lit("…")))
    return per.select("query_id", "group", text.alias("text")).where("text is not null")


def remembered(old: DataFrame, facts: DataFrame, order: str = "ts") -> DataFrame:
    """Long-term memory (user_id, key, value, ts) after ``facts`` of the same columns: the last value of each user and key, keys cut to 200 characters and values to 2000; empty ones are no facts."""
    key, value = F.substring(F.trim("key"), 1, 200), F.substring(F.trim("value"), 1, 2000)
    new = facts.select("user_id", key.alias("key"), value.alias("value"), F.col(order)).where("user_id is not null and key <> '' and value <> ''")
    both = old.select("user_id", "key", "value", order).unionByName(new)
    return both.groupBy("user_id", "key").agg(F.max_by("value", F.struct(order, "value")).alias("value"), F.max(order).alias(order))


def forgotten(memory: DataFrame, gone: DataFrame) -> DataFrame:
    """``memory`` without the (user_id, key) of ``gone``."""
    return memory.join(gone.select("user_id", "key").distinct(), ["user_id", "key"], "left_anti")


def recalled(memory: DataFrame, most: int = 20, order: str = "ts") -> DataFrame:
    """The last ``most`` facts of each user."""
    w = W.partitionBy("user_id").orderBy(F.desc(order), "key")
    return memory.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


#: Runs of characters that lead from a query to names: as long as the query, within these bounds.
SHORTEST, LONGEST = 3, 6


def _grams(text: Column, width: int) -> Column:
    """The distinct runs of ``width`` characters; none of a shorter text."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - (width - 1)), lambda i: F.substr(text, i, F.lit(width)))
    return F.array_distinct(F.when(F.length(text) >= width, runs).otherwise(F.array().cast("array<string>")))


def seeds(queries: DataFrame, entities: DataFrame, most: int = 5, shortest: int = SHORTEST) -> DataFrame:
    """(query_id, name, place): for each query (query_id, text) the entities whose name or description holds it, shortest names first. Runs of characters lead from a query to names: the query itself, or where it is
    longer than ``LONGEST``, that of its runs of this length that the fewest entities have. The runs that queries have are written first; of all entities' runs only these go any further, with the text that is then compared. So
    what a query meets follows the entities that hold it (or its rarest run), not all that share three characters with it. Queries under ``shortest`` characters meet nothing. Names are distinct."""
    asked = queries.select("query_id", F.lower("text").alias("text")).where(F.length("text") >= shortest)
    own = F.when(F.length("text") <= LONGEST, F.array("text")).otherwise(_grams(F.col("text"), LONGEST))
    runs = written(asked.select("query_id", "text", F.explode(own).alias("gram")), "runs")
    wanted = written(runs.select("gram").distinct(), "wanted")
    widths = [r.n for r in wanted.select(F.length("gram").alias("n")).distinct().collect()]  # few: LONGEST at most
    low = spread(entities.select("name", F.lower(F.concat_ws("\n", "name", F.coalesce("description", F.lit("")))).alias("all")))
    every = F.flatten(F.array(*[_grams(F.col("all"), n) for n in sorted(widths)])) if widths else F.array().cast("array<string>")
    listed = written(low.select("name", "all", F.explode(every).alias("gram")).join(wanted, "gram", "left_semi"), "listed")
    counts = listed.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = runs.join(counts, "gram", "left").groupBy("query_id", "text").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    found = rarest.join(listed, "gram").where(F.contains("all", F.col("text"))).select("query_id", "name")
    w = W.partitionBy("query_id").orderBy(F.length("name"), "name")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def graph_context(queries: DataFrame, entities: DataFrame, relations: DataFrame, most_entities: int = 5, most_triples: int = 10) -> DataFrame:
    """(query_id, title, content): one more piece of context for each query that names entities, with the relations they stand in, one a line."""
    s = seeds(queries, entities, most_entities)
    line = F.concat("source", F.lit(" -["), "type", F.lit("]-> "), "target").alias("line")
    ends = relations.select(F.col("source").alias("name"), line).union(relations.select(F.col("target").alias("name"), line))
    lines = s.join(ends, "name").groupBy("query_id", "line").agg(F.min("place").alias("place"))
    w = W.partitionBy("query_id").orderBy("place", "line")
    top = lines.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most_triples)
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return top.groupBy("query_id").agg(F.concat(F.lit(GRAPH_HEAD), content).alias("content")).select("query_id", F.lit(GRAPH_TITLE).alias("title"), "content")


def version_summary(chunks: DataFrame) -> DataFrame:
    """Chunks and characters of each (doc, version)."""
    return chunks.groupBy("doc", "version").agg(F.count("*").alias("num_chunks"), F.sum(F.length("text")).cast("long").alias("total_chars"))


def merged_maps(base: Column, override: Column) -> Column:
    """Both maps, the second over the first."""
    return F.map_zip_with(base, override, lambda _, a, b: F.coalesce(b, a))


def local_time(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    """Date, time and weekday (1 is Monday) of an instant in UTC as clocks show it in ``zone``."""
    there = F.from_utc_timestamp(ts, zone)
    return F.struct(F.date_format(there, "yyyy-MM-dd").alias("date"), F.date_format(there, "HH:mm:ss").alias("time"), (F.weekday(there) + 1).alias("weekday"))


def call_rates(df: DataFrame, by: str, failed: Column) -> DataFrame:
    """Calls, failures, and the shares of failed and good ones."""
    g = df.groupBy(by).agg(F.count("*").alias("calls"), F.count_if(failed).alias("failures"))
    rate = F.coalesce(F.try_divide("failures", "calls"), F.lit(0.0))
    return g.select(by, "calls", "failures", F.round(rate, 6).alias("failure_rate"), F.round(1 - rate, 6).alias("success_rate"))
