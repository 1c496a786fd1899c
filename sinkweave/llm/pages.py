"""HTML main text by wrapper induction.

Pages become DOM trees in which siblings of one label (tag and class words) are one slot; containers
without names are told apart by what stands in them, so a menu, an advert and an article that are all
plain ``div`` are three slots. Slots are
aligned over all pages of a host, label by label from the root, and counted in Spark: on how many
pages, with how much text, and how often the most frequent text. That gives a host's template: nodes
with the same text on most pages are constant, slots that vary are content. Each page is then aligned
with the template by simple tree matching, in which containers meet others of their tag by what their
children match. Its content is the slot with most of the host's varying
text, with varying headings beside the way to it; constant nodes are taken out, and so is what markup
says is no article: menus, headers, footers, sidebars, notices, adverts, forms, comments.

Exact copies of one page tell nothing about a template and are counted out. A host with fewer than
LEAST_PAGES other pages is read by its markup, or, where that names no article, by the template of all
hosts of its site (the last two names of the host). Counts don't depend on the order or partition of
pages. Slots on fewer than one of RARE pages are left out of a template, which so holds a bounded
number of nodes; templates are broadcast while they are under BROADCAST_BYTES in all, and beyond,
pages are joined by host, where Spark splits skewed hosts.

Defined results: a null html is an empty page with an empty text; a url without a host belongs to the
host ''; repeated rows get the same result; text at any depth is kept, elements beyond MAX_DEPTH count
as part of the one at that depth; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinkweave.llm.common import cut, lower_ascii

BROADCAST_BYTES = 16 << 20
#: Pages of a host from which on a constant text counts as template, and the share of pages with it.
LEAST_PAGES = 5
CONSTANT_SHARE = 0.6
#: A slot on fewer than one of so many pages is no part of the template.
RARE = 50
#: Deeper nodes are read as if they were at this depth.
MAX_DEPTH = 60

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_DROPPED = frozenset("head title script style noscript template nav aside footer form button select option textarea iframe svg object canvas menu dialog input audio video".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAMED = re.compile("[a-z]+")
_BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies notice notices consent alert popup modal "
    "newsletter subscribe signup login social share sharing related recommended comment comments disqus respond reply replies widget toolbar pagination pager copyright".split()
)
#: Words that say what a page has or lacks, not what a node is: has-comments, no-sidebar.
_SAYS_OF = frozenset("has have no not non with without show hide is".split())
#: Stands among a node's names if they drop it.
_MARK = "!"
#: Never dropped by their names; nor is a node with this share of the page's text.
_KEPT = frozenset("html body main article".split())
MOST = 0.8
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: What an implied end tag does not reach beyond.
_WALLS = frozenset("article aside body div footer form header html main nav ol section table td th ul dl blockquote".split())


class Node:
    __slots__ = ("tag", "label", "named", "kids")

    def __init__(self, tag: str, label: str, named: frozenset):
        self.tag, self.label, self.named = tag, label, named
        self.kids: list[Node | str] = []

    @property
    def is_dropped(self) -> bool:
        return self.tag in _DROPPED or _MARK in self.named

    @property
    def is_header(self) -> bool:
        return self.tag == "header" or "header" in self.named or "masthead" in self.named

    @property
    def is_article(self) -> bool:
        return (self.tag in ("article", "main") or "articlebody" in self.named or "main" in self.named) and not self.is_dropped


def _label(tag: str, names: frozenset | set) -> str:
    return tag + "".join(f".{w}" for w in sorted(names))


def _names_boilerplate(token: str) -> bool:
    """A whole name (ad), or its last word (site-footer), but not one that says what a page has."""
    runs = _NAMED.findall(token)
    return bool(runs) and runs[-1] in _BOILERPLATE and _SAYS_OF.isdisjoint(runs)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", "#root", frozenset())
        self.open = [self.root]
        self.deep: list[Node] = []  # open elements beyond MAX_DEPTH

    def updatepos(self, i, j):
        return j  # line numbers, which nobody asks for

    def handle_starttag(self, tag, attrs):
        if tag not in _INLINE and tag not in _CLOSES:
            self._end(("p",))
        for k in (_CLOSES[tag],) if tag in _CLOSES else ():
            self._end(k)
        words: set[str] = set()
        drops = False
        for name, value in attrs:
            if value and name in ("class", "id", "role", "itemprop"):
                words.update(_NAMED.findall(value.lower()))
                drops = drops or any(map(_names_boilerplate, value.lower().split()))
        is_main = tag in _KEPT or any(pair in attrs for pair in (("role", "main"), ("itemprop", "articleBody")))
        if drops and not is_main:
            words.add(_MARK)
        node = Node(tag, _label(tag, words), frozenset(words))
        self._inside().kids.append(node)
        if tag not in _VOID:
            (self.open if len(self.open) < MAX_DEPTH else self.deep).append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _inside(self) -> Node:
        """Where text goes: beyond MAX_DEPTH into what is dropped there, else into the last node above."""
        return next((n for n in self.deep if n.is_dropped), self.open[-1])

    def _close(self, tags, walls) -> None:
        """Closes the nearest open element of these, and all in it, unless a wall is nearer."""
        for opened in (self.deep, self.open):
            for k in range(len(opened) - 1, 0 if opened is self.open else -1, -1):
                if opened[k].tag in tags:
                    if opened is self.open:
                        self.deep.clear()
                    elif any(n.tag not in _INLINE for n in opened[k:]):
                        self.open[-1].kids.append(Node("p", "p", frozenset()))  # its end is the end of a block
                    del opened[k:]
                    return
                if opened[k].tag in walls:
                    return

    def _end(self, tags):
        """The implied end of the nearest open element of these, inside the same container."""
        self._close(tags, _WALLS)

    def handle_endtag(self, tag):
        self._close((tag,), ())

    def handle_data(self, data):
        self._inside().kids.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    _unmark(builder.root)
    return builder.root


def _unmark(root: Node) -> None:
    """Names don't drop a node that holds most of the page's text."""

    def weigh(node: Node) -> int:
        if node.tag in _DROPPED:
            return 0
        own = sum(weigh(k) if isinstance(k, Node) else len("".join(k.split())) for k in node.kids)
        if _MARK in node.named:
            marked.append((node, own))
        return own

    marked: list[tuple[Node, int]] = []
    whole = weigh(root)
    for node, own in marked:
        if own and own >= MOST * whole:
            node.named -= {_MARK}
            node.label = _label(node.tag, node.named)


def _texts(node: Node) -> Iterator[str]:
    """All text below a node that markup doesn't drop; every block starts and ends with a line break."""
    stack: list = [iter((node,))]
    while stack:
        item = next(stack[-1], None)
        if item is None:
            stack.pop()
        elif isinstance(item, str):
            yield item
        elif item.tag == "br":
            yield " "
        elif not item.is_dropped:
            block = item.tag not in _INLINE
            kids: list = item.kids
            if item.is_header:  # of a header only headings belong to the article
                kids = [k for k in _below(item) if k.tag in _HEADINGS]
            stack.append(iter(["\0", *kids, "\0"] if block else kids))


def _below(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        at = stack.pop()
        if at is not node:
            yield at
        if at is node or at.tag not in _HEADINGS:
            stack.extend(k for k in reversed(at.kids) if isinstance(k, Node))


def blocks(nodes: list[Node]) -> list[str]:
    out = []
    for node in nodes:
        for part in "".join(_texts(node)).split("\0"):
            text = " ".join(part.split())
            if text:
                out.append(text)
    return out


# ---- slots and templates


_SILENT = ("script", "style", "head", "noscript", "template")
ROOT = "#root"


class Slot:
    """Siblings of one label, all of a page's or of a host's: text is that of the blocks themselves."""

    __slots__ = ("label", "nodes", "text", "kids", "constant", "mass", "way")

    def __init__(self, label: str):
        self.label, self.nodes, self.text, self.kids = label, [], [], {}
        self.constant: int | None = None  # the hash of the constant text
        self.mass = 0  # length of varying text
        self.way: list[Slot] = []  # of a template's root: the path to its content


def slots_of(root: Node) -> Slot:
    """A page's tree of slots; inline elements belong to the block around them."""
    top = Slot(ROOT)
    top.nodes.append(root)
    stack = [(root, top)]
    while stack:
        node, slot = stack.pop()
        own, inner = [], list(reversed(node.kids))
        while inner:
            kid = inner.pop()
            if isinstance(kid, str):
                own.append(kid)
            elif kid.tag in _INLINE:
                inner.extend(reversed(kid.kids))
            elif kid.tag not in _SILENT:
                label = _shaped(kid)
                under = slot.kids.setdefault(label, Slot(label))
                under.nodes.append(kid)
                stack.append((kid, under))
        slot.text.append(" ".join("".join(own).split()))
    return top


#: Tags of containers that say nothing of what they hold.
_PLAIN = frozenset("div section td".split())


def base(label: str) -> str:
    return label.partition("[")[0]


def _shaped(node: Node) -> str:
    """The label; of a plain container without names also the tags of the blocks in it, lists once."""
    if node.label not in _PLAIN:
        return node.label
    tags, inner = set(), list(node.kids)
    while inner:
        kid = inner.pop()
        if isinstance(kid, Node):
            if kid.tag in _INLINE:
                inner.extend(kid.kids)
            elif kid.tag not in _SILENT and kid.tag not in _VOID:
                tags.add(kid.tag)
    return f"{node.label}[{'+'.join(sorted(tags))}]"


def hash_of(slot: Slot) -> int:
    """Of a slot's text, whatever the order in which its nodes were reached."""
    return xxhash.xxh64_intdigest("\0".join(sorted(t for t in slot.text if t))) - (1 << 63)


def slot_rows(html: str | None) -> list[dict]:
    """(path, at, length, hash) of a page's slots; the root's hash is that of the whole page."""
    out, stack = [], [(slots_of(parse(html)), "")]
    while stack:
        slot, above = stack.pop()
        path = f"{above}/{slot.label}" if above else slot.label
        is_root = slot.label == ROOT
        out.append({"path": path, "at": len(out), "length": 0 if is_root else sum(map(len, slot.text)), "hash": xxhash.xxh64_intdigest(html or "") - (1 << 63) if is_root else hash_of(slot)})
        stack.extend((kid, path) for kid in reversed(slot.kids.values()))
    return out


def template_of(rows: list[dict]) -> Slot | None:
    """A host's slots (path, at, pages, length, top, hash) as a tree; None if it has too few pages."""
    by_path = {r["path"]: r for r in rows}
    root = by_path.get(ROOT)
    if root is None:
        return None
    copies = root["top"] if root["top"] > 1 else 0
    if root["pages"] - copies < LEAST_PAGES - (copies > 0):
        return None
    top = Slot(ROOT)
    made = {ROOT: top}
    for path in sorted((p for p in by_path if p != ROOT), key=lambda p: (p.count("/"), by_path[p]["at"], p)):
        above, _, label = path.rpartition("/")
        if above not in made:
            continue
        r, slot = by_path[path], Slot(label)
        made[path] = made[above].kids[label] = slot
        less = copies if r["top"] >= copies else 0
        if r["length"] and r["top"] - less >= CONSTANT_SHARE * (r["pages"] - less) and r["pages"] > less:
            slot.constant = r["hash"]
        else:
            slot.mass = r["length"]
    top.way = content_path(top)
    return top


def _drops(label: str) -> bool:
    tag, *named = base(label).split(".")
    return tag in _DROPPED or _MARK in named


def mass_of(t: Slot) -> int:
    """Varying text in and below a slot, but for what markup drops."""
    return 0 if _drops(t.label) else t.mass + sum(map(mass_of, t.kids.values()))


def content_path(template: Slot) -> list[Slot]:
    """Slots from the root to the deepest that holds most of the varying text, paragraphs aside."""
    path = [template]
    while path[-1].kids:
        best = max(path[-1].kids.values(), key=mass_of)
        if _drops(best.label) or mass_of(best) < MOST * mass_of(path[-1]) or base(best.label).split(".")[0] in ("p", "li", *_HEADINGS):
            break
        path.append(best)
    return path


def match(a: Slot, b: Slot) -> int:
    """Simple tree matching: the most slots that can be paired, keeping order and parents."""
    if base(a.label) != base(b.label):
        return 0
    return 1 + (_align(list(a.kids.values()), list(b.kids.values()))[-1][-1] if a.kids and b.kids else 0)


def _align(xs: list[Slot], ys: list[Slot]) -> list[list[int]]:
    table = [[0] * (len(ys) + 1)]
    for x in xs:
        above, row = table[-1], [0]
        for k, y in enumerate(ys):
            row.append(max(above[k + 1], row[k], above[k] + match(x, y) if base(x.label) == base(y.label) else 0))
        table.append(row)
    return table


def pairs(a: Slot, b: Slot) -> list[tuple[Slot, Slot]]:
    """The children of two slots that the matching pairs, in order."""
    xs, ys = list(a.kids.values()), list(b.kids.values())
    common = [y for y in ys if y.label in a.kids]
    left, unmet = {base(x.label) for x in xs if x.label not in b.kids}, {base(y.label) for y in ys if y.label not in a.kids}
    if left.isdisjoint(unmet) and [x.label for x in xs if x.label in b.kids] == [y.label for y in common]:
        return [(a.kids[y.label], y) for y in common]  # labels are unique: in one order, all are paired
    table, out = _align(xs, ys), []
    i, j = len(xs), len(ys)
    while i and j:
        if base(xs[i - 1].label) == base(ys[j - 1].label) and table[i][j] == table[i - 1][j - 1] + match(xs[i - 1], ys[j - 1]):
            i, j = i - 1, j - 1
            out.append((xs[i], ys[j]))
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def extract(html: str | None, template: Slot | None, wider: Slot | None = None) -> str:
    """By the host's template, else by an article that the markup names, else by the site's template."""
    root = parse(html)
    found = (_by_template(root, template) if template else []) or _articles(root)
    return "\n".join(blocks(found or (_by_template(root, wider) if wider else []) or [root]))


def _by_template(root: Node, template: Slot) -> list[Node]:
    """The nodes of the content slot and varying headings beside the way to it, in page order; what is
    constant loses its text."""
    page = slots_of(root)
    way = template.way
    found: set[int] = set()
    stack = [(page, template)]
    while stack:
        own, t = stack.pop()
        if t is way[-1]:
            found.update(map(id, own.nodes))
        if t.constant is not None and hash_of(own) == t.constant:
            for node in own.nodes:
                node.kids = [k for k in node.kids if isinstance(k, Node) and k.tag not in _INLINE]
        for a, b in pairs(own, t):
            stack.append((a, b))
            if t in way[:-1] and base(b.label).split(".")[0] in _HEADINGS and b.constant is None:
                found.update(map(id, a.nodes))
    out, walk = [], [root]
    while walk:
        node = walk.pop()
        if id(node) in found:
            out.append(node)
        else:
            walk.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    return out


def _articles(root: Node) -> list[Node]:
    """Outermost nodes that the markup names as the article."""
    out, stack = [], [root]
    while stack:
        at = stack.pop()
        if at.is_article:
            out.append(at)
        elif not at.is_dropped:
            stack.extend(k for k in reversed(at.kids) if isinstance(k, Node))
    mains = [n for n in out if n.tag == "main" or "main" in n.named]
    inner = [x for m in mains for k in m.kids if isinstance(k, Node) for x in _articles(k)]
    return inner if mains and inner else out


# ---- Spark


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))


def site_of(host: Column) -> Column:
    """``*.`` and the last two names of a host, so no host is called so."""
    return F.concat(F.lit("*."), F.regexp_extract(host, r"[^.]*(?:\.[^.]*)?$", 0))


def templates(pages: DataFrame) -> DataFrame:
    """(host, slots): the slots of each host's pages, counted, and of each site's, from the counts of its
    hosts. Texts are counted before they are told apart from each other, so a host that stands in every
    partition is spread over its texts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            yield pd.Series([slot_rows(h) for h in htmls], dtype="object")

    rows = F.pandas_udf(run, "array<struct<path:string,at:int,length:long,hash:long>>")
    each = pages.select(host_of(F.col("url")).alias("host"), F.explode(rows("html")).alias("x")).select("host", "x.*")
    texts = cut(each.groupBy("host", "path", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"), F.sum("at").alias("at")), "page-texts")
    few = texts.filter(F.col("path") == ROOT).groupBy("host").agg(F.sum("n").alias("n")).filter(F.col("n") <= LEAST_PAGES).select(site_of(F.col("host")).alias("host")).distinct()
    sites = texts.withColumn("host", site_of(F.col("host"))).join(few, "host", "left_semi")
    texts = texts.unionByName(sites.groupBy("host", "path", "hash").agg(*[F.sum(c).alias(c) for c in ("n", "length", "at")]))
    slots = cut(texts.groupBy("host", "path").agg(
        F.sum("n").alias("pages"), F.sum("length").alias("length"), (F.sum("at") / F.sum("n")).alias("at"), F.max(F.struct("n", "hash")).alias("top")), "page-slots")
    whole = slots.filter(F.col("path") == ROOT).select("host", F.col("pages").alias("all"))
    usual = slots.join(whole, "host").filter((F.col("all") >= LEAST_PAGES) & (F.col("pages") * RARE >= F.col("all")))
    return usual.groupBy("host").agg(F.to_json(F.collect_list(F.struct("path", "at", "pages", "length", F.col("top.n").alias("top"), F.col("top.hash").alias("hash")))).alias("slots"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    known = cut(templates(pages), "page-templates")
    size = known.agg(F.sum(F.length("slots")).alias("n")).first()["n"] or 0

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        read: dict[str, Slot | None] = {}

        def of(t: str | None) -> Slot | None:
            if t and t not in read:
                if len(read) > 2000:
                    read.clear()
                read[t] = template_of(json.loads(t))
            return read[t] if t else None

        for htmls, own, wider in batches:
            yield pd.Series([extract(h, of(t), of(w)) for h, t, w in zip(htmls, own, wider)], dtype="object")

    keyed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    text = F.pandas_udf(run, "string")("html", "slots", "wider")
    wider = known.withColumnsRenamed({"host": "site", "slots": "wider"})
    small = size <= BROADCAST_BYTES
    return (
        keyed.withColumn("site", site_of(F.col("host"))).join(F.broadcast(known) if small else known, "host", "left")
        .join(F.broadcast(wider) if small else wider, "site", "left")
        .select("page_id", "url", text.alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
