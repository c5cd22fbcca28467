"""Text functions over columns. All are built-in expressions that stay in the JVM.

White space is Unicode's where text is stripped or compared, and ASCII's in the other patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without weight that the tokenizer leaves out.
STOP_WORDS = (
    "的 了 和 是 就 都 而 及 与 或 在 有 对 从 被 把 让 向 往 于 到 给 为 "
    "以 之 其 这 那 一个 一些 我们 你们 他们 她们 它们 什么 怎么 怎样 如何 "
    "以及 通过 对于 由于 因此 但是 可以 可能 进行 已经 关于 根据 按照 同时 "
    "另外 然后 所以 如果 虽然 并且 还是 只是 还有 等等 以上 以下 这些 那些 "
    "没有 是不是 为什么 多少 哪里 哪个 哪些"
).split()

#: Bigrams of questions that carry no content.
QUESTION_BIGRAMS = "什么 怎么 如何 多少 哪些 哪个 是否 可以 请问 一下 这个 那个".split()

#: A line that is only a page number; a line of ornament.
PAGE_NUMBER = r"(?i)^\s*(?:[-–—•·]?\s*\d{1,4}\s*[-–—•·]?|第\s*\d+\s*页(\s*[,，/共].*)?|Page\s+\d+(\s*of\s*\d+)?)\s*$"
ORNAMENT = r"^[\s\-—=_*~·•#.]{6,}$"


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also where ``use`` has it inside a loop over an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Outer white space off, runs of blanks to one, at most one empty line in a row."""
    return F.regexp_replace(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"[ \t]+", " "), r"\n{3,}", "\n\n")


def deep_clean(c: Column, least_repeat: int = 3) -> Column:
    """Before ``clean``: odd spaces to blanks; lines that stand on ``least_repeat`` pages or more (pages are parted by empty lines; short lines stay), page numbers and ornaments go."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), "[ 　  ]", " ")
    pages = F.transform(F.split(text, "\n{2,}"), lambda p: F.split(p, "\n"))
    distinct = F.flatten(F.transform(pages, lambda p: F.array_distinct(F.filter(F.transform(p, strip), lambda k: (F.length(k) >= 4) & ~k.rlike(PAGE_NUMBER)))))
    # sorted, a line that comes so often equals the one so many places before
    often = let(F.array_sort(distinct), lambda d: F.array_distinct(F.filter(d, lambda k, i: (i >= least_repeat - 1) & (F.get(d, i - (least_repeat - 1)) == k))))
    repeated = F.when(F.size(pages) >= least_repeat, often).otherwise(F.array().cast("array<string>"))
    stays = lambda line: ~F.array_contains(repeated, strip(line)) & ~strip(line).rlike(PAGE_NUMBER) & ~strip(line).rlike(ORNAMENT)
    joined = F.array_join(F.transform(pages, lambda p: F.array_join(F.filter(p, stays), "\n")), "\n\n")
    return clean(joined)


#: Small letters whose capital in full is several characters, and their single capitals.
WIDE = "ß" + "".join(c for c in map(chr, range(0x1F80, 0x2000)) if len(c.upper()) > 1 and len(c.title()) == 1 and c.title() != c)
WIDE_CAPITALS = "ẞ" + "".join(c.title() for c in WIDE[1:])


def upper(c: Column) -> Column:
    """Capitals, one character for one, as ß would become SS. Letters without a single capital (ligatures) take more."""
    return F.upper(F.translate(c, WIDE, WIDE_CAPITALS))


def without_space(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def content_hash(c: Column) -> Column:
    """SHA-256 of the text without white space."""
    return F.sha2(without_space(c), 256)


def shingles(c: Column, k: int = 8) -> Column:
    """The set of ``k``-character runs of the text without white space; a shorter text is one run."""
    runs = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1)))
    cut = lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) <= k, F.array(t)).otherwise(runs(t))
    return let(without_space(c), cut)


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _grams(run: Column, n: int) -> Column:
    return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substr(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def tokens(c: Column) -> Column:
    """Distinct search tokens: ASCII words in lower case, then characters and bigrams of CJK runs but for stop words. Texts without CJK are spared its part."""
    t = F.coalesce(c, F.lit(""))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    cjk = lambda r: F.filter(F.concat(_grams(r, 1), _grams(r, 2)), lambda x: ~F.array_contains(stop, x))
    words = F.transform(F.array_distinct(F.regexp_extract_all(t, F.lit("[A-Za-z0-9]+"), F.lit(0))), F.lower)
    runs = F.flatten(F.transform(F.regexp_extract_all(t, F.lit("[一-鿿]+"), F.lit(0)), cjk))
    return F.array_distinct(F.when(t.rlike("[一-鿿]"), F.concat(words, runs)).otherwise(words))


def query_terms(c: Column) -> Column:
    """Terms of a question: ASCII words of two letters or more (or digits) in lower case; CJK bigrams but for question words."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z0-9_+.-]+|[一-鿿]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in QUESTION_BIGRAMS])
    cjk = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.filter(_grams(r, 2), lambda t: ~F.array_contains(stop, t)))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[A-Za-z0-9_+.-]"), F.when((F.length(r) >= 2) | r.rlike("^[0-9]+$"), F.array(F.lower(r))).otherwise(none)).otherwise(cjk(r)))))


def term_hits(terms: Column, c: Column) -> Column:
    """How many of ``terms`` stand in the text."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.size(F.filter(terms, lambda t: F.contains(low, t)))


def strip_markers(c: Column) -> Column:
    """Up to three rounds of list and heading marks off the front."""
    for _ in range(3):
        c = F.regexp_replace(c, r"^\s*[（(][^）)]{0,24}[）)]\s*", "")
        c = F.regexp_replace(c, r"^\s*(?:[-•·*]\s*)+", "")
        c = F.regexp_replace(c, r"^\s*\d{1,2}[.、．)]\s*", "")
    return strip(c)


def answer_sentences(c: Column) -> Column:
    """Sentences of a passage for quoting: source marks out, white space to one blank, eight characters at least."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\[\d{1,3}\]\s*[-–—]\s*\[\d{1,3}\]", "编号")
    t = strip(F.regexp_replace(F.regexp_replace(t, r"\[\d{1,3}\]", ""), r"\s+", " "))
    found = F.regexp_extract_all(t, F.lit(r"[^。！？!?；;\n]+[。！？!?；;]?"), F.lit(0))
    return F.filter(F.transform(found, strip_markers), lambda s: F.length(s) >= 8)


def check_sentences(c: Column) -> Column:
    """Sentences of an answer for checking: cut after 。！？!?；; and at line ends, four characters at least."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[^。！？!?；;\n]*[。！？!?；;]|[^。！？!?；;\n]+"), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: F.length(s) >= 4)


def split_sentences(c: Column) -> Column:
    """Sentences for chunking: cut after 。！？；.!? but not inside decimals; single line ends are blanks."""
    t = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(\d)\.(?=\d)", "$1\u0001")
    found = F.regexp_extract_all(F.regexp_replace(t, "\n", " "), F.lit(r"[^。！？；.!?]*[。！？；.!?]|[^。！？；.!?]+"), F.lit(0))
    return F.filter(F.transform(found, lambda s: strip(F.regexp_replace(s, "\u0001", "."))), lambda s: F.length(s) > 0)


def fixed_chunks(c: Column, width: int) -> Column:
    """Pieces of ``width`` characters."""
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(c) - 1) / width).cast("int")), lambda i: F.substr(c, i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def entry_count(c: Column, least: int = 5) -> Column:
    """For a list of entries numbered [n] at line starts without a gap: how many; else null."""
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?m)^\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int")))
    n = F.size(numbers)
    return F.when((n >= least) & (F.array_max(numbers) - F.array_min(numbers) + 1 == n), n)


def entry_number(line: Column) -> Column:
    """The number of a line that is an entry [n]; else null."""
    return F.nullif(F.regexp_extract(line, r"^\[(\d{1,3})\]", 1), F.lit("")).cast("int")


def entries_of_lines(number: Column, least: int = 5) -> Column:
    """``entry_count`` as an aggregate over the entry numbers of lines."""
    n = F.count_distinct(number)
    return F.when((n >= least) & (F.max(number) - F.min(number) + 1 == n), n)


def markdown_to_text(c: Column) -> Column:
    """Links become their text, tags and code marks go, code keeps its lines, headings stay."""
    for pattern, to in ((r"(?s)```[^\n]*\n(.*?)```", "\n$1\n"), (r"`([^`]+)`", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"<[^>]+>", "")):
        c = F.regexp_replace(c, pattern, to)
    return clean(c)


def acl(c: Column) -> Column:
    """Groups parted by commas, each once; nothing, * and all mean everybody (*)."""
    groups = F.array_distinct(F.filter(F.transform(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("，"), F.lit(",")), ","), strip), lambda g: F.length(g) > 0))
    joined = F.array_join(groups, ",")
    return F.when(joined.isin("", "*", "all"), "*").otherwise(joined)


def status(c: Column) -> Column:
    v = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(v.isin("draft", "草稿", "wip", "pending"), "draft").when(v.isin("expired", "过期", "archived", "作废", "deprecated"), "expired").otherwise("active")


def any_date(c: Column) -> Column:
    """A date in one of four forms; other text is null."""
    s = strip(c)
    return F.coalesce(*[F.when(s.rlike(p), F.try_to_timestamp(s, F.lit(f)).cast("date")) for p, f in ((r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"), (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "y.M.d"), (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "y-M-d H:m:s"))])


def frontmatter(c: Column) -> Column:
    """(meta, body) of a text that opens with a block of ``key: value`` lines between --- lines; without one the map is empty."""
    block = r"(?s)^---\s*\n(.*?)\n---[ \t]*(?:\n|$)"
    raw = F.regexp_extract(c, block, 1)
    lines = F.filter(F.split(raw, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), F.regexp_replace(strip(F.substr(x, F.instr(x, ":") + 1)), "^[\"']+|[\"']+$", "").alias("value")))
    return F.struct(F.map_from_entries(F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))).alias("meta"), F.regexp_replace(c, block, "").alias("body"))


def snippet(c: Column, most: int = 200) -> Column:
    """A readable excerpt: leading 【…】 off, white space to one blank, cut at ``most`` characters and back to the last sentence end."""
    s = strip(F.regexp_replace(strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"^【[^】]*】", "")), r"\s+", " "))
    cut = F.substring(s, 1, most)
    whole = F.regexp_extract(cut, r"(?s)^(.*[。！？!?；;])", 1)
    return F.when(F.length(s) <= most, s).when(F.length(whole) > 1, whole).otherwise(cut)


def estimate_answer_tokens(c: Column) -> Column:
    """Tokens of an answer without a tokenizer at hand: two for three CJK characters, one for four others (one at least); none for an empty text."""
    cjk = F.length(F.regexp_replace(c, "[^一-鿿]", ""))
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0).otherwise(F.floor(cjk / 1.5 + F.greatest(F.lit(1), F.floor((F.length(c) - cjk) / 4))))


def estimate_tokens(c: Column) -> Column:
    """One token per CJK, kana or hangul character, and one for four others (one at least)."""
    wide = F.length(c) - F.length(F.regexp_replace(c, "[一-鿿㐀-䶿぀-ヿ가-힯]", ""))
    return F.when(F.length(F.coalesce(c, F.lit(""))) == 0, 0).otherwise(wide + F.greatest(F.lit(1), F.floor((F.length(c) - wide) / 4).cast("int")))


def text_stats(c: Column) -> Column:
    """Characters, CJK characters, ASCII words and lines."""
    t = F.coalesce(c, F.lit(""))
    return F.struct(F.length(t).alias("chars"), F.regexp_count(t, F.lit("[一-鿿]")).alias("cjk_chars"), F.regexp_count(t, F.lit("[A-Za-z0-9]+")).alias("words"), F.when(F.length(t) == 0, 0).otherwise(F.size(F.split(t, "\n", -1))).alias("lines"))


def bigram_counts(c: Column) -> Column:
    """Each pair of neighbouring characters of the stripped text, as often as it stands there."""
    pairs = lambda t: F.when(F.size(t) >= 2, F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.concat(F.element_at(t, i), F.element_at(t, i + 1)))).otherwise(F.array().cast("array<string>"))
    return let(F.regexp_extract_all(strip(F.coalesce(c, F.lit(""))), F.lit("(?s)."), F.lit(0)), pairs)  # characters once, as taking each by its place would read a long text over and over


def preview(c: Column, n: int = 80) -> Column:
    return F.substring(c, 1, n)


def auto_title(c: Column, most: int = 200, default: str = "新会话") -> Column:
    t = F.substring(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), 1, most)
    return F.when(F.length(t) > 0, t).otherwise(F.lit(default))
