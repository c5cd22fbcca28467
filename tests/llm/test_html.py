"""Main text by wrapper induction: pages whose build alone tells the content, alignment against brute force, odd markup."""

import random
from functools import cache

from pyspark.sql import functions as F

from scholia.llm.html_extract import ALONE, Shape, _matched, aligned, blocks_of, main_text, slots_of

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">We use cookies</div><div class=ad>Buy {i}</div>
<article><h1>Title&nbsp;{i} &amp; more</h1><p>First  {i}
 para<br>goes on<p>Second <b>bold</b> {i}<form><p>Mail</p></form><p>Share this story with friends</p><aside>Side</aside><section class="comments"><p>Reader {i}</p></section></article>
<div id="sidebar">Links</div><footer>&copy; Site</footer></body></html>"""


def texts(spark, rows, **options):
    return {r.page_id: r["__text"] for r in main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"), **options).collect()}


def alone(page):
    return [t for _, t, marks, _ in blocks_of(page)[1] if marks & ALONE]


def test_blocks_of_a_page():
    assert alone(PAGE.format(i=7)) == ["Title 7 & more", "First 7 para goes on", "Second bold 7", "Share this story with friends"]


def test_what_stands_in_an_article_stays_on_hosts_with_many_pages(spark, none):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i=i)) for i in range(12)] + [(20, "http://one.example/", PAGE.format(i=20)), (21, None, None), (22, "http://h.example/x", ""), (23, "bad", "plain <b>text</b>")]
    out = texts(spark, rows)
    assert out[3] == "Title 3 & more\n\nFirst 3 para goes on\n\nSecond bold 3\n\nShare this story with friends"
    assert out[20].endswith("Share this story with friends")
    assert (out[21], out[22], out[23]) == ("", "", "plain text")
    empty = none.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"))
    assert main_text(empty).count() == 0


def plain_page(rng, i):
    """Only divs and paragraphs: constant menu, a changing teaser, the text with a constant line in it, a changing foot."""
    words = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    body = [words(rng.randint(12, 40)) for _ in range(rng.randint(2, 6))]
    lines = "".join(f"<p>{x}</p>" for x in body)
    page = f"<html><body><div><div>Home</div><div>About this place</div></div><div><div>{words(6)}</div></div><div><div><h1>Head {i} {words(2)}</h1>{lines}<p>You have read all of it</p></div></div><div>Host of pages</div><div>Seen {i} times, {words(3)}</div></body></html>"
    return page, f"Head {i} " + page.split(f"Head {i} ")[1].split("<")[0] + "\n\n" + "\n\n".join(body)


WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "ll", "m")]


def test_the_wrapper_alone_finds_the_text(spark):
    """No element, role or name says what the content is."""
    rng = random.Random(5)
    made = [plain_page(rng, i) for i in range(40)]
    rows = [(i, f"https://plain.example/{i}", p) for i, (p, _) in enumerate(made)]
    got = texts(spark, rows)
    assert sum(got[i] == want for i, (_, want) in enumerate(made)) == 40
    without = texts(spark, rows, induce=False)  # what is cut away is cut away by the induction
    assert sum(without[i] == want for i, (_, want) in enumerate(made)) == 0


def test_headings_bylines_and_closing_lines_of_articles_stay(spark):
    """Texts that stand in one slot on every page of a host, inside its article."""
    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows, want = [], {}
    for i in range(12):
        a, b, c = words(20), words(25), words(12)
        rows.append((i, f"http://sections.example/{i}", f"<body><nav>Home</nav><article><p>By Jane Doe</p><h1>Of {i} {words(2)}</h1><h2>Background</h2><p>{a}</p><p>{b}</p><h2>References</h2><p>{c}</p><p>All rights are yours</p></article><footer>Foot</footer></body>"))
        want[i] = f"By Jane Doe\n\n{rows[-1][2].split('<h1>')[1].split('</h1>')[0]}\n\nBackground\n\n{a}\n\n{b}\n\nReferences\n\n{c}\n\nAll rights are yours"
    assert texts(spark, rows) == want


def test_headings_between_varying_texts_stay_without_any_name(spark):
    rng = random.Random(9)
    words = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows, want = [], {}
    for i in range(12):
        head, a, b = f"Head {i} {words(2)}", words(30), words(25)
        rows.append((i, f"http://bare.example/{i}", f"<body><div>Home</div><div><div>Seen {i}</div></div><div><h1>{head}</h1><h2>Background</h2><p>{a}</p><h2>Sources</h2><p>{b}</p><p>You have read all of it</p></div><div>Host</div></body>"))
        want[i] = "\n\n".join([head, "Background", a, "Sources", b])
    assert texts(spark, rows) == want


def test_a_column_beside_the_story_as_long_as_it(spark):
    """Neither holds half of the letters; the title tells which is the story."""
    rng = random.Random(10)
    words = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows, want = [], {}
    for i in range(12):
        head, story, side = f"Head {i} {words(2)}", [words(20), words(22)], [words(24), words(14), words(16)]
        lines = lambda xs: "".join(f"<p>{x}</p>" for x in xs)
        rows.append((i, f"http://beside.example/{i}", f"<body><div>Home</div><div><div>{lines(side)}</div><div><h1>{head}</h1>{lines(story)}</div><div>{words(9)}</div></div><div>Host</div></body>"))
        want[i] = "\n\n".join([head, *story])
    assert texts(spark, rows) == want


def test_induction_needs_no_article_element(spark):
    """The given pages with their articles turned into divs, and all names away, lose no block and gain none."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("url like '%tionsh%' or url like '%thther%'")
    bare = F.regexp_replace(F.regexp_replace("html", "<(/?)(?:article|nav|footer)>", "<$1div>"), ' class="[^"]*"', "")
    want = {r.page_id: r["__text"] for r in main_text(pages).collect()}
    got = {r.page_id: r["__text"] for r in main_text(pages.withColumn("html", bare)).collect()}
    assert len(want) > 40 and sum(got[k] == want[k] for k in want) >= 0.95 * len(want)


def test_copies_of_an_article_are_no_template(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    paras = [words(30) for _ in range(5)]
    page = lambda ps: f"<body><div>{words(4)}</div><div><h1>Same head</h1>{''.join(f'<p>{p}</p>' for p in ps)}</div></body>"
    rows = [(i, "http://copies.example/", page(paras[:4] + [words(30)])) for i in range(3)]
    for text in texts(spark, rows).values():
        assert text.startswith("Same head\n\n" + "\n\n".join(paras[:4]))


def test_nothing_of_an_article_is_dropped_for_its_look(spark):
    inner = '<header><h1>Head</h1><p>The lead</p></header><p class="foot-note">A note</p><div class="discussion">We discuss</div><p class="social-history">Of old</p><p><label>Labelled</label> <math>x+y</math></p><ul><li><a href=a>Source one</a></li><li><a href=b>Source two</a></li><li><a href=c>Source three</a></li></ul>'
    page = f"<body><nav>Menu</nav><article>{inner}<form>Sign up</form><div class='comment-list'>Nice</div></article><footer>Foot</footer></body>"
    assert texts(spark, [(1, "http://a.example/", page)])[1].split("\n\n") == ["Head", "The lead", "A note", "We discuss", "Of old", "Labelled x+y", "Source one", "Source two", "Source three"]


def test_names_of_columns_and_repeated_rows(spark):
    rows = [(i % 4, f"http://h.example/{i % 4}", PAGE.format(i=i % 4)) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for name in ("slots", "template", "n", "h", "slot", "shape", "wrapper", "part", "pages"):
        df = df.withColumn(name, F.lit(name))
    out = main_text(df)
    assert out.count() == 8 and set(out.columns) == set(df.columns) - {"html"} | {"__text"}
    assert all(r.slots == "slots" and r.template == "template" for r in out.collect())


def random_tree(rng, depth=0):
    return rng.choice("abc"), [random_tree(rng, depth + 1) for _ in range(rng.randint(0, 3) if depth < 3 else 0)]


def written(tree, depth=0):
    return [f"{depth} {tree[0] if depth else 'r'}"] + [line for k in tree[1] for line in written(k, depth + 1)]


def test_alignment_has_the_most_matches():
    """Against simple tree matching as it is defined, without tables or shortcuts."""

    def most(a, b, top=False):
        if a[0] != b[0] and not top:
            return 0

        @cache
        def best(i, j):
            return max(best(i - 1, j), best(i, j - 1), best(i - 1, j - 1) + most(a[1][i - 1], b[1][j - 1])) if i and j else 0

        return 1 + best(len(a[1]), len(b[1]))

    rng = random.Random(1)
    for _ in range(300):
        a, b = random_tree(rng), random_tree(rng)
        ta, tb = "\n".join(written(a)), "\n".join(written(b))
        got = aligned(ta, tb)
        assert sum(x >= 0 for x in got) == most(a, b, True)
        sa, sb = Shape.read(ta), Shape.read(tb)
        assert all(sa.labels[i] == sb.labels[j] and (i == 0 or got[sa.parents[i]] == sb.parents[j]) for i, j in enumerate(got) if j >= 0)
        assert len({j for j in got if j >= 0}) == sum(j >= 0 for j in got) and sa.write() == ta


def test_halving_finds_as_many_matches():
    rng = random.Random(2)
    for _ in range(100):
        xs, ys = list(range(rng.randint(1, 12))), list(range(rng.randint(1, 12)))
        table = {(x, y): rng.choice([0, 0, 1, 3]) for x in xs for y in ys}
        score = lambda x, y: table[x, y]
        sums = {sum(table[p] for p in _matched(xs, ys, score, cells)) for cells in (4, 10**6)}
        assert len(sums) == 1


def test_slots_of_added_nodes_are_those_around_them():
    a, b = "0 r\n1 a\n2 x\n3 y\n1 b", "0 r\n1 a\n1 b"
    assert slots_of(a, b) == [0, 1, -3, -3, 2]


def test_deep_and_broken_markup(spark):
    for t in ["<", "<p", "</p>", "<a href='x", "<!-- never", "<script>x", "<b><i></b>", "&#x;&amp", "<p>" * 2000, "<div>" * 3000 + "x"]:
        blocks_of(t)
    deep = lambda end: "<div>" * 3000 + f"<{end}>text of {end}"
    out = texts(spark, [(1, "http://d.example/", deep("p")), (2, "http://d.example/", deep("h2")), (3, "http://d.example/", deep("td"))])
    assert all("text of" in t for t in out.values())
