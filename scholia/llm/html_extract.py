"""Main text of web pages by wrapper induction over the pages of a host.

Each page is parsed into its DOM tree. The tree of its block elements is the page's shape; inline elements belong to their block, and like leaf blocks
of one parent (paragraphs, headings, items, cells) are one repeated node, as their number follows the content. The most frequent shape of a host is its wrapper; the other shapes are
aligned with it by simple tree matching, so that each block gets a slot of the wrapper (a node that the wrapper lacks: the slot of what is around it).

1. A text that stands in one slot on at least ``constant_share`` of a host's distinct pages, two at least, is constant: template. Pages that would lose over
   half of their letters in slots that hold varying texts too, or over four fifths of all outside links, are copies of one another rather than pages of one template; they count as no evidence. Nor is a text constant
   that stands on pages of other hosts too, so that chance explains its number here (with more than ``most_chance``): it belongs to what is written.
2. The other texts vary. From the wrapper's root the way leads down to the part that holds more than half of the varying letters outside links, or all of the varying main headings, while such a part exists, no
   varying main heading stands outside it, and it isn't itself named as something else. The slots below are the content; varying menus, adverts and footers stand outside.
3. Inside the content what can't belong to an article by its element, role or name goes: menus, forms, footers, asides, notices, adverts, reader comments. Constant texts inside an article or main element stay, whatever their number, and
   so do those between texts that vary (headings, bylines); before the first and after the last of these they are the template's.

Where this leaves it open (one page on a host, a page of another build, no part with most of the letters), a page decides for itself: by its article or main element, else by step 2 over its own
letters, with element, role and name lists and lists of links as the tie-break.

Blocks end at block elements; white space inside a block becomes one space; blocks are joined by two line feeds.

Defined cases: null and empty html give ''; a null or odd url is the host ''; unclosed and stray tags are repaired; any depth of nesting; very long pages are
kept whole; copies of a page count once for the template; repeated rows each give a row; of shapes equally frequent the longest, then the one of the largest hash is the wrapper; of alignments
equally good the one that matches later siblings; an empty table gives an empty result. Columns of the input besides the html are returned as they are; names that start with two underscores are the operator's own.
"""

from __future__ import annotations

import html as entities
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)", re.S)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Blocks of text and of rows: like ones of a parent are one repeated node.
LEAVES = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 legend li p pre summary td th tr".split())
LISTS = frozenset("ul ol dl div section p table nav".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "option": {"select"}}
#: Elements whose text is never shown as text.
NEVER = frozenset("head title script style noscript template iframe button select option input textarea svg canvas object embed audio video noframes xmp map".split())
#: Elements, roles and words of class and id names that stand for something other than an article.
APART = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMED = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner menu nav navbar navigation sidebar rail footer header masthead topbar cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login comment comments commentlist respond reply replies share sharing breadcrumb breadcrumbs pagination pager toolbar skip".split())
FILLERS = frozenset("box area wrapper container bar block section list slot unit site page global top bottom left right main primary secondary inner outer col column links buttons form widget container thread body item".split())
PARTS = re.compile(r"[-_\d]+")
HEADER, IN_APART, LINKED, TITLE, ALONE, ARTICLE = 1, 2, 4, 8, 16, 32  # marks of a block


class Node:
    __slots__ = ("tag", "name", "role", "hidden", "children", "parent")

    def __init__(self, tag: str, parent: Node | None, name: str = "", role: str = "", hidden: bool = False):
        self.tag, self.parent, self.name, self.role, self.hidden = tag, parent, name, role, hidden
        self.children: list[Node | str] = []


def parsed(page: str) -> Node:
    root = now = Node("#page", None)
    at, end = 0, len(page)
    match = TOKEN.match
    while at < end:
        m = match(page, at)
        if m is None:  # a tag that never ends
            break
        at = m.end()
        tag = m["tag"]
        if tag is None:
            text = m["text"] or m["cdata"]
            if text:
                now.children.append(text)
            continue
        tag = tag.lower()
        if m["close"]:
            up = now
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                now = up.parent
            continue
        if tag in BLOCKS:
            up = now
            while up is not root and (up.tag == "p" or up.tag not in BLOCKS):
                if up.tag == "p":
                    now = up.parent
                    break
                up = up.parent
        if tag in CLOSES:
            up = now
            while up is not root and up.tag not in SCOPES.get(tag, ()):
                if up.tag in CLOSES[tag]:
                    now = up.parent
                up = up.parent
        name = role = ""
        hidden = False
        if m["attrs"].strip(" /"):
            attrs = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(m["attrs"])}
            name = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
            role = attrs.get("role", "").lower()
            hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        node = Node(tag, now, name, role, hidden)
        now.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            body_end = close.start() if close else end
            if tag in ("title", "textarea"):
                node.children.append(page[at:body_end])
            at = close.end() if close else end
        elif tag not in VOID and not (m["attrs"].endswith("/") and tag in ("svg", "path")):
            now = node  # in HTML a slash closes no element
    return root


def named_apart(n: Node) -> bool:
    """Whether element, role or name say that this is no part of an article. A class or id counts only as a whole: each of its words must be a known one."""
    if n.tag in APART or n.role in ROLES:
        return True
    if not n.name or n.tag in ("html", "body", "article", "main"):
        return False
    for token in n.name.lower().split():
        words = [w for w in PARTS.split(token) if w]
        if words and any(w in NAMED for w in words) and all(w in NAMED or w in FILLERS for w in words):
            return True
    return False


class Shape:
    """The tree of a page's block elements: labels, parents and children by number, in preorder."""

    def __init__(self, labels: list[str], parents: list[int]):
        self.labels, self.parents = labels, parents
        self.kids: list[list[int]] = [[] for _ in labels]
        for i, p in enumerate(parents):
            if p >= 0:
                self.kids[p].append(i)

    @classmethod
    def read(cls, text: str) -> Shape:
        labels, parents, path = [], [], []
        for i, line in enumerate(text.split("\n")):
            depth, label = line.split(" ", 1)
            del path[int(depth) :]
            parents.append(path[-1] if path else -1)
            labels.append(label)
            path.append(i)
        return cls(labels, parents)

    def write(self) -> str:
        depth, lines = [0] * len(self.labels), []
        for i, (label, p) in enumerate(zip(self.labels, self.parents)):
            depth[i] = depth[p] + 1 if p >= 0 else 0
            lines.append(f"{depth[i]} {label}")
        return "\n".join(lines)

    def apart(self, i: int) -> bool:
        return self.labels[i].endswith("!")


def main_part(shape: Shape, letters: list[float], titles: list[float], share: float = 0.5) -> int:
    """The node that holds what varies: down from the root to the child with more than ``share`` of its parent's letters, or where none has so many, to the one with all of its titles; but not if a title stands outside
    the child, or if it is named as something else. 0 where there is no such way."""
    mass, held = list(letters), list(titles)
    for i in range(len(mass) - 1, 0, -1):
        mass[shape.parents[i]] += mass[i]
        held[shape.parents[i]] += held[i]
    now = 0
    while shape.kids[now]:
        best = max(shape.kids[now], key=mass.__getitem__)
        if mass[best] <= share * mass[now] and held[now] > 0:  # beside something as long, the title tells
            best = max(shape.kids[now], key=held.__getitem__)
        elif mass[best] <= share * mass[now]:
            break
        if held[best] < held[now] or shape.apart(best) or shape.labels[best].split(".")[0].rstrip("!") in LEAVES:
            break
        now = best
    return now if shape.labels[now].split(".")[0] not in ("#page", "html", "body") else 0


def blocks_of(page: str) -> tuple[str, list[tuple[int, str, int, int]]]:
    """The page's shape, and its blocks in order: node of the shape, text, marks, letters in links."""
    root = parsed(page)
    labels, parents = ["#page"], [-1]
    found: list[list] = []  # node, pieces, marks, letters in links, element
    leaves: dict[tuple[int, str], int] = {}
    order, order_of, stack = [root], [root], []  # all blocks, the open ones, and what is around them
    counts = {id(root): [0, 0, 0]}  # of each block: letters, those in links, links
    held: list[str] = []
    linked = 0
    owner, marks, element = 0, 0, root

    def flush() -> None:
        nonlocal held, linked
        text = " ".join(entities.unescape("".join(held)).split()) if held else ""
        if text:
            found.append([owner, text, marks, min(linked, len(text)), element])
        held, linked = [], 0

    work: list = [(c, 0, 0, False) for c in reversed(root.children)]
    while work:
        item, node, flags, in_link = work.pop()
        if isinstance(item, str):
            held.append(item)
            k = len(item.strip())
            c = counts[id(order_of[-1])]
            c[0] += k
            if in_link:
                linked += k
                c[1] += k
            continue
        if item is None:  # the end of a block: what follows belongs to the block around it
            flush()
            order_of.pop()
            owner, marks, element = stack.pop()
            continue
        if item.hidden or item.tag in NEVER:
            if item.tag in BLOCKS:
                flush()
            continue
        if item.tag == "br":
            held.append(" ")
            continue
        in_link = in_link or item.tag == "a"
        if item.tag == "a":
            counts[id(order_of[-1])][2] += 1
        apart = named_apart(item)
        flags |= (IN_APART if apart else 0) | (HEADER if item.tag == "header" else 0) | (TITLE if item.tag == "h1" else 0)
        if apart or item.tag in BLOCKS:
            flush()
            label = (f"{item.tag}.{item.name.split()[0]}" if item.name else item.tag).rstrip("!") + ("!" if apart else "")
            leaf = (node, label) if item.tag in LEAVES else None
            if leaf in leaves:
                node = leaves[leaf]
            else:
                labels.append(label)
                parents.append(node)
                node = len(labels) - 1
                if leaf:
                    leaves[leaf] = node
            stack.append((owner, marks, element))
            owner, marks, element = node, flags, item
            order_of.append(item)
            order.append(item)
            counts[id(item)] = [0, 0, 0]
            work.append((None, 0, 0, False))
        work += [(c, node, flags, in_link) for c in reversed(item.children)]
    flush()
    # a node that repeats may get children late: number the shape in preorder
    shape, number = _in_preorder(labels, parents)
    for n in reversed(order):  # sums over all below
        up = n.parent
        while up is not None and id(up) not in counts:
            up = up.parent
        if up is not None:
            for j in range(3):
                counts[id(up)][j] += counts[id(n)][j]
    lists = {id(n) for n in order if n.tag in LISTS and counts[id(n)][2] >= 3 and counts[id(n)][1] >= 0.8 * counts[id(n)][0]}
    within: dict[int, tuple[bool, bool]] = {}  # of each element: in a list of links, in an article
    for n in order:
        up = n.parent
        while up is not None and id(up) not in within:
            up = up.parent
        a, b = within[id(up)] if up is not None else (False, False)
        within[id(n)] = (a or id(n) in lists, b or n.tag in ("article", "main") or n.role in ("article", "main"))
    for b in found:
        b[0] = number[b[0]]
        b[2] |= (LINKED if within[id(b[4])][0] else 0) | (ARTICLE if within[id(b[4])][1] else 0)
    _decided_alone(shape, found, [within[id(b[4])][1] for b in found])
    return shape.write(), [(n, t, m, k) for n, t, m, k, _ in found]


def _in_preorder(labels: list[str], parents: list[int]) -> tuple[Shape, list[int]]:
    kids: list[list[int]] = [[] for _ in labels]
    for i, p in enumerate(parents[1:], 1):
        kids[p].append(i)
    number, out, ups, todo = [0] * len(labels), [], [], [(0, -1)]
    while todo:
        i, up = todo.pop()
        number[i] = len(out)
        out.append(labels[i])
        ups.append(up)
        todo += [(k, number[i]) for k in reversed(kids[i])]
    return Shape(out, ups), number


def _decided_alone(shape: Shape, found: list[list], in_article: list[bool]) -> None:
    """Marks the blocks that the page would keep by itself."""
    fits = [not b[2] & IN_APART for b in found]
    if any(a and f for a, f in zip(in_article, fits)):
        keep = [a and f for a, f in zip(in_article, fits)]
    else:
        letters, titles = [0.0] * len(shape.labels), [0.0] * len(shape.labels)
        for b, f in zip(found, fits):
            if f and not b[2] & LINKED:
                letters[b[0]] += len(b[1]) - b[3]
                titles[b[0]] += bool(b[2] & TITLE)
        part = inside(shape, main_part(shape, letters, titles))
        deep = not all(part)
        keep = [f and part[b[0]] and (deep or not b[2] & (LINKED | HEADER)) for b, f in zip(found, fits)]
    for b, k in zip(found, keep):
        b[2] |= ALONE if k else 0


def inside(shape: Shape, top: int) -> list[bool]:
    """For each node whether it is ``top`` or below it."""
    out = [False] * len(shape.labels)
    for i, p in enumerate(shape.parents):
        out[i] = i == top or (p >= 0 and out[p])
    return out


def aligned(page: str, wrapper: str) -> list[int]:
    """For each node of the shape ``page`` its slot in ``wrapper`` or -1, by simple tree matching: the most nodes matched in order, parents with parents."""
    if page == wrapper:
        return list(range(page.count("\n") + 1))
    a, b = Shape.read(page), Shape.read(wrapper)
    known: dict[tuple[int, int], int] = {}
    kinds: dict[tuple, int] = {}

    def kinds_of(t: Shape) -> list[int]:
        """Equal numbers for equal subtrees."""
        out = [0] * len(t.labels)
        for i in range(len(out) - 1, -1, -1):
            out[i] = kinds.setdefault((t.labels[i], *[out[k] for k in t.kids[i]]), len(kinds))
        return out

    ka, kb = kinds_of(a), kinds_of(b)
    sizes = [1] * len(a.labels)
    for i in range(len(sizes) - 1, 0, -1):
        sizes[a.parents[i]] += sizes[i]

    def score(x: int, y: int) -> int | None:
        if a.labels[x] != b.labels[y]:
            return 0
        return sizes[x] if ka[x] == kb[y] else known.get((ka[x], kb[y]))

    out = [-1] * len(a.labels)
    todo = [(0, 0)]
    while todo:  # scores of all pairs that can meet, children before parents, without recursion
        x, y = todo[-1]
        if score(x, y) is not None:
            todo.pop()
            continue
        need = [(p, q) for p in a.kids[x] for q in b.kids[y] if score(p, q) is None]
        if need:
            todo += need
            continue
        known[ka[x], kb[y]] = 1 + sum(score(p, q) for p, q in _matched(a.kids[x], b.kids[y], score))
        todo.pop()
    todo = [(0, 0)] if score(0, 0) else []
    while todo:
        x, y = todo.pop()
        out[x] = y
        todo += _matched(a.kids[x], b.kids[y], score)
    return out


def _matched(xs: list[int], ys: list[int], score, most_cells: int = 1_000_000) -> list[tuple[int, int]]:
    """Pairs of the best matching in order. With more than ``most_cells`` cells the first list is halved at the best cut of the second (as Hirschberg does), so that only rows are held."""
    if not xs or not ys:
        return []
    if len(xs) > 1 and len(xs) * len(ys) > most_cells:
        half = len(xs) // 2
        left = _rows(xs[:half], ys, score)[-1]
        right = _rows(xs[half:][::-1], ys[::-1], score)[-1][::-1]
        cut = int(np.argmax(left + right))
        return _matched(xs[:half], ys[:cut], score, most_cells) + _matched(xs[half:], ys[cut:], score, most_cells)
    rows = list(_rows(xs, ys, score, True))
    pairs, i, j = [], len(xs), len(ys)
    while i and j:
        w = score(xs[i - 1], ys[j - 1])
        if w and rows[i][j] == rows[i - 1][j - 1] + w:
            pairs.append((xs[i - 1], ys[j - 1]))
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def _rows(xs: list[int], ys: list[int], score, every: bool = False) -> list[np.ndarray]:
    """Rows of the best sums over prefixes: all of them, or the last."""
    row = np.zeros(len(ys) + 1, np.int64)
    out = [row]
    for x in xs:
        w = np.fromiter((score(x, y) for y in ys), np.int64, len(ys))
        row = np.concatenate([[0], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w))])
        if every:
            out.append(row)
        else:
            out = [row]
    return out


def slots_of(page: str, wrapper: str) -> list[int]:
    """As ``aligned``, but a node without a partner has -2 minus the slot of the nearest one around it that has one (the root always has)."""
    out, parents = aligned(page, wrapper), Shape.read(page).parents
    for i, p in enumerate(parents):
        if out[i] < 0:
            out[i] = out[p] if p >= 0 and out[p] <= -2 else -2 - (out[p] if p >= 0 else 0)
    return out


def _blocks_column():
    block = pa.struct([("node", pa.int32()), ("text", pa.string()), ("marks", pa.int32()), ("linked", pa.int32())])
    kind = pa.struct([("shape", pa.string()), ("content", pa.int64()), ("blocks", pa.list_(block))])

    @F.arrow_udf("struct<shape:string,content:bigint,blocks:array<struct<node:int,text:string,marks:int,linked:int>>>")
    def udf(pages: pa.Array) -> pa.Array:
        out = []
        for page in pages.to_pylist():
            shape, blocks = blocks_of(page or "")
            h = xxhash.xxh3_64_intdigest("\n".join(b[1] for b in blocks))
            out.append({"shape": shape, "content": h - (1 << 63), "blocks": [dict(zip(("node", "text", "marks", "linked"), b)) for b in blocks]})
        return pa.array(out, kind)

    return udf


def _slots_column():
    @F.arrow_udf("array<int>")
    def udf(pages: pa.Array, wrappers: pa.Array) -> pa.Array:
        return pa.array([slots_of(p, w) for p, w in zip(pages.to_pylist(), wrappers.to_pylist())], pa.list_(pa.int32()))

    return udf


def _part_column():
    """The slots of the wrapper's main part; none where it has none."""

    @F.arrow_udf("array<int>")
    def udf(wrappers: pa.Array, masses: pa.Array) -> pa.Array:
        out = []
        for w, ms in zip(wrappers.to_pylist(), masses.to_pylist()):
            shape = Shape.read(w)
            letters, titles = [0.0] * len(shape.labels), [0.0] * len(shape.labels)
            for m in ms or ():
                letters[m["slot"]] += m["letters"]
                titles[m["slot"]] += m["titles"]
            top = main_part(shape, letters, titles)
            out.append([i for i, k in enumerate(inside(shape, top)) if k] if top else [])
        return pa.array(out, pa.list_(pa.int32()))

    return udf


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", constant_share: float = 0.5, most_chance: float = 1e-4, induce: bool = True) -> DataFrame:
    """``pages`` without the html, with ``__text``. Without ``induce`` every page decides for itself."""
    rest = [c for c in pages.columns if c != html_col]
    marked = pages.withColumns({"__host": F.xxhash64(host_of(F.col(url_col))), "__p": _blocks_column()(html_col)}).drop(html_col)
    marked = stored(marked.withColumns({"__shape": F.col("__p.shape"), "__kind": F.xxhash64("__p.shape"), "__content": F.col("__p.content"), "__blocks": F.col("__p.blocks")}).drop("__p"), "blocks")
    alone = F.filter("__blocks", lambda b: b["marks"].bitwiseAND(ALONE) > 0)
    joined = lambda blocks: F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")
    if not induce:
        return marked.select(*rest, joined(alone).alias("__text"))
    shapes = stored(marked.groupBy("__host", "__kind").agg(F.count("*").alias("n"), F.min("__shape").alias("shape")), "shapes")
    wrappers = stored(shapes.groupBy("__host").agg(F.max_by("shape", F.struct("n", F.length("shape"), "__kind")).alias("wrapper")), "wrappers")
    slots = stored(shapes.join(wrappers, "__host").select("__host", "__kind", _slots_column()("shape", "wrapper").alias("__slots")), "slots")
    slot_at = lambda node: F.element_at("__slots", node + 1)
    around = lambda slot: F.when(slot >= 0, slot).otherwise(-2 - slot)
    cell = lambda b: F.struct(b["node"].alias("node"), F.xxhash64(b["text"]).alias("h"), F.length(b["text"]).alias("letters"), b["linked"].alias("linked"), (b["marks"].bitwiseAND(TITLE) > 0).cast("int").alias("title"))
    placed = lambda c: F.struct(around(slot_at(c["node"])).alias("slot"), c["h"].alias("h"), c["letters"].alias("letters"), c["linked"].alias("linked"), c["title"].alias("title"))
    # one row for each distinct page of a host, with hashes and lengths of its blocks; texts stay where they are
    digests = marked.select("__host", "__kind", "__content", F.transform("__blocks", cell).alias("cells")).join(slots, ["__host", "__kind"])
    digests = digests.select("__host", "__content", F.array_distinct(F.transform("cells", placed)).alias("cells")).groupBy("__host", "__content").agg(F.first("cells").alias("cells"))
    digests = stored(digests, "digests")
    cells = digests.select("__host", "__content", F.explode("cells").alias("c")).select("__host", "__content", "c.*")
    keys = ["__host", "slot", "h"]
    pages_of = lambda rows: rows.groupBy("__host").agg(F.count("*").alias("pages"))
    texts_of = lambda rows: rows.groupBy(*keys).agg(F.count("*").alias("n"))
    many = stored(pages_of(digests), "pages")
    whole = many.agg(F.sum("pages")).first()[0] or 0
    often = (F.col("n") > 1) & (F.col("n") >= constant_share * F.col("pages"))
    first = stored(texts_of(cells).where("n > 1").join(many, "__host").where(often), "constant")
    own = F.greatest(F.col("letters") - F.col("linked"), F.lit(0))
    same = F.sum(F.when(F.col("same"), own).otherwise(0))
    weighed = cells.join(first.select(*keys, F.lit(True).alias("same")), keys, "left").groupBy("__host", "__content", "slot").agg(F.sum(own).alias("all"), same.alias("same"))
    both = F.when((F.col("same") > 0) & (F.col("same") < F.col("all")), F.lit(1)).otherwise(0)
    weighed = weighed.groupBy("__host", "__content").agg(*[F.sum(x).alias(n) for n, x in (("all", F.col("all")), ("same", F.col("same")), ("mixed", F.col("all") * both), ("same_mixed", F.col("same") * both))])
    copies = stored(weighed.where("2 * same_mixed > mixed or 5 * same > 4 * all").select("__host", "__content"), "copies")
    # a text of other hosts too belongs to what is written, unless it stands on far more of this host's pages than chance from its rate elsewhere allows (Chernoff's bound on the log of the chance)
    elsewhere = cells.join(first.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.count("*").alias("anywhere"))
    rate = (F.col("anywhere") - F.col("here") + 0.5) / (F.lit(float(whole)) - F.col("all_pages") + 50)
    by_chance = F.col("n") * (1 + F.log(F.col("pages") * rate / F.col("n")))
    others = digests.join(copies, ["__host", "__content"], "left_anti")
    recount = texts_of(cells.join(copies, ["__host", "__content"], "left_anti").join(first.select(*keys), keys, "left_semi"))
    told = recount.join(first.select(*keys, F.col("n").alias("here"), F.col("pages").alias("all_pages")), keys).join(pages_of(others), "__host").join(elsewhere, "h")
    template = stored(told.where(often & ((by_chance < math.log(most_chance)) | (rate >= constant_share))).select(*keys), "template")
    varying = cells.join(template, keys, "left_anti").groupBy("__host", "slot").agg(F.sum(own).cast("double").alias("letters"), F.sum("title").cast("double").alias("titles"))
    several = many.where("pages > 1").select("__host")
    # a wrapper has no more slots than a page has nodes
    masses = varying.groupBy("__host").agg(F.collect_list(F.struct("slot", "letters", "titles")).alias("masses")).join(several, "__host")
    parts = stored(wrappers.join(masses, "__host").select("__host", _part_column()("wrapper", "masses").alias("__part")).where(F.size("__part") > 0), "parts")
    # a host's template holds no more texts than 1 / constant_share pages do
    known = stored(template.groupBy("__host").agg(F.collect_list(F.struct("slot", "h")).alias("__template")).join(parts, "__host", "full"), "known")
    out = marked.join(slots, ["__host", "__kind"], "left").join(known, "__host", "left")
    # the main part is on the page if a node of it has a partner in it
    on_page = F.coalesce(F.arrays_overlap("__slots", "__part"), F.lit(False))
    slot = lambda b: around(slot_at(b["node"]))
    varies = lambda b: F.col("__template").isNull() | ~F.array_contains("__template", F.struct(slot(b).alias("slot"), F.xxhash64(b["text"]).alias("h")))
    is_content = lambda b: F.array_contains("__part", slot(b)) & (b["marks"].bitwiseAND(IN_APART) == 0)
    shown = out.withColumn("__shown", F.when(on_page, F.filter("__blocks", is_content)).otherwise(alone))
    shown = shown.withColumn("__varies", F.transform("__shown", varies))
    first, last = F.array_position("__varies", True), F.size("__varies") + 1 - F.array_position(F.reverse("__varies"), True)
    inner = lambda b, i: (b["marks"].bitwiseAND(ARTICLE) > 0) | ((i + 1 >= F.col("__first")) & (i + 1 <= F.col("__last")))
    shown = shown.withColumns({"__first": F.when(first > 0, first).otherwise(F.lit(1 << 30)), "__last": F.when(first > 0, last).otherwise(0)})
    return shown.select(*rest, joined(F.filter("__shown", inner)).alias("__text"))
