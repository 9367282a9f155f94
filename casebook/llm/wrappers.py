"""Main text of web pages by wrapper induction: same-host DOM trees aligned by simple tree matching.

A page's tree is folded (neighbouring siblings of one label become one repeated node) and merged into the template of
its host by simple tree matching. A template node counts its pages and the text and link characters under it, and
keeps its text as long as all pages agree. Templates merge like pages do, so each task folds its own pages, Spark
merges the parts in two salted rounds, and pages meet their host's template in one join. On extraction a page is
aligned with the template: constant nodes and link lists are boilerplate, varying slots are content, and so is what
aligns with nothing; elements whose role is stated (menus, footers, adverts, forms, comments ...) are left out."""

from __future__ import annotations

import html as html_entities
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names as HTML defines them, and words that name the role of an element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title plaintext".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table
    tbody td tfoot th thead title tr ul""".split()
)
LEFT_OUT = frozenset(
    """aside audio button canvas datalist dialog embed footer form head header iframe input link menu meta nav noembed noframes noscript
    object script search select style svg template textarea title video""".split()
)
ROLES = frozenset(
    """ad ads adbox adslot advert advertisement advertising adverts banner breadcrumb breadcrumbs byline-share comment comments
    complementary consent contentinfo cookie cookies disqus footer form gdpr header hidden login masthead menu modal nav navbar navigation
    newsletter notice notices notification overlay pager pagination paywall popup promo promotion related reply replies respond search
    share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget""".split()
)
#: Words that may stand beside a role in a name such as site-header without changing what it says.
PLACES = frozenset("site global top bottom left right box bar container wrapper wrap inner block area list item items button buttons panel".split())
#: Elements nested deeper than this become siblings, as in browsers.
DEEPEST = 200
#: Start tags that close an open element: name to the elements it closes and those that stop the search.
CLOSES = {name: ({"p"}, {"button", "table", "td", "th", "caption", "object"}) for name in BLOCK if name not in ("body", "html", "head", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "title", "legend", "summary")}
CLOSES |= {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"body"}),
}

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VALUE, _HIDDEN = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""), re.compile(r"(?:^|[\s=])hidden(?:[\s=]|$)", re.I)
#: A constant slot is boilerplate from so many pages on; inside an article or main element from more.
CONSTANT, CONSTANT_INSIDE, LINKS = 3, 20, 0.6
#: Templates that a task keeps read, so that hosts in turn are not read again for every page.
KEPT = 64


class Node:
    """An element: tag, label (tag and class), children (nodes and texts), and whether its stated role leaves it out."""

    __slots__ = ("children", "label", "out", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children = tag, []
        named = {}
        if "=" in attributes:
            named = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(attributes)}
        self.label = f"{tag}.{named['class']}" if named.get("class") else tag
        self.out = tag in LEFT_OUT
        if named and not self.out and tag not in ("html", "body", "article", "main"):
            said = [name for k in ("class", "id", "role") for name in named.get(k, "").split()]
            self.out = any(map(states_role, said)) or "display:none" in named.get("style", "").replace(" ", "")
        if not self.out and attributes and _HIDDEN.search(_VALUE.sub("=", attributes)):
            self.out = True


def states_role(name: str) -> bool:
    """A class, id or role that says nothing but a role, in one word or several; `post-header` says more."""
    words = [w.lower() for w in _WORDS.findall(name)]
    roles = [w in ROLES for w in words]
    return any(roles) and all(role or w in PLACES for w, role in zip(words, roles, strict=True))


def parse(page: str) -> Node:
    """The element tree; end tags that were left out are supplied, raw text elements hold no markup."""
    root = Node("#page")
    stack, at, end, beyond = [root], 0, len(page), 0
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if beyond and name not in VOID:
                beyond -= 1
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "body", "table", "td", "section", "div") and name not in BLOCK:
                    break
            continue
        closes = CLOSES.get(name)
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes[0]:
                    del stack[k:]
                    break
                if stack[k].tag in closes[1]:
                    break
        node = Node(name, m.group(3))
        stack[-1].children.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            node.children.append(page[at : close.start() if close else end])
            at = page.find(">", close.end() - 1) + 1 if close else end
            at = at or end
        elif name not in VOID and (name in BLOCK or not m.group(3).endswith("/")):  # the slash means nothing on an HTML element
            if len(stack) > DEEPEST:
                beyond += 1
            else:
                stack.append(node)
    return root


class Slot:
    """A template node: pages it is on, its own text while constant (a hash, 0 for none, None once it varies), characters
    of text and of links under it."""

    __slots__ = ("children", "label", "links", "pages", "same", "text")

    def __init__(self, label: str, pages: int, same: int | None, text: int, links: int, children: list):
        self.label, self.pages, self.same, self.text, self.links, self.children = label, pages, same, text, links, children

    def pack(self) -> list:
        return [self.label, self.pages, self.same, self.text, self.links, [c.pack() for c in self.children]]

    @classmethod
    def unpack(cls, row: list) -> Slot:
        return cls(*row[:5], [cls.unpack(c) for c in row[5]])


def fold(node: Node, linked: bool = False) -> Slot:
    """A page's tree as a template of one page; neighbouring siblings of one label become one slot."""
    linked = linked or node.tag == "a"
    own = " ".join(" ".join(c.split()) for c in node.children if isinstance(c, str) and not c.isspace())
    children: list[Slot] = []
    if node.tag not in RAW:
        for child in node.children:
            if isinstance(child, Node):
                slot = fold(child, linked)
                if children and children[-1].label == slot.label:
                    children[-1] = unite(children[-1], slot, False)
                else:
                    children.append(slot)
    text = len(own) + sum(c.text for c in children)
    links = (len(own) if linked else 0) + sum(c.links for c in children)
    return Slot(node.label, 1, zlib.crc32(own.encode("utf-8", "replace")) if own else 0, text, links, children)


#: Scores of pairs of trees whose children had to be compared, by identity, while both trees are held.
Known = dict[tuple[int, int], int]


def _scores(left: list, right: list, known: Known) -> list[array]:
    """Most matched nodes of every pair of prefixes, in order, by simple tree matching."""
    best = [array("i", bytes(4 * (len(right) + 1)))]
    for a in left:
        above, row = best[-1], array("i", [0])
        for j, b in enumerate(right):
            most = max(above[j + 1], row[j])
            row.append(max(most, above[j] + match(a, b, known)) if a.label == b.label else most)
        best.append(row)
    return best


def _shared(left: list, right: list) -> tuple[list[int], list[int]]:
    """Places of the children whose label the other side has too; the others match nothing and change no score."""
    one, two = {c.label for c in left}, {c.label for c in right}
    return [i for i, c in enumerate(left) if c.label in two], [j for j, c in enumerate(right) if c.label in one]


def align(left: list, right: list, known: Known | None = None) -> list[tuple[int, int]]:
    """Pairs of children matched in order by simple tree matching: the most matched nodes in all."""
    if [c.label for c in left] == [c.label for c in right]:
        return [(i, i) for i in range(len(left))]
    rows, columns = _shared(left, right)
    best = _scores([left[i] for i in rows], [right[j] for j in columns], {} if known is None else known)
    pairs, i, j = [], len(rows), len(columns)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((rows[i], columns[j]))
    return pairs[::-1]


def match(a: Slot, b: Slot, known: Known | None = None) -> int:
    """Nodes in the largest matching of two trees that keeps roots, order and levels; 0 if the labels differ.

    Every pair of nodes is scored once, so a pair of trees takes their sizes' product at most; ``known`` keeps scores
    for the alignment of the levels below."""
    if a.label != b.label:
        return 0
    known = {} if known is None else known
    if [c.label for c in a.children] == [c.label for c in b.children]:
        total = 1
        for x, y in zip(a.children, b.children, strict=True):
            total += match(x, y, known)
        return total
    pair = (id(a), id(b))
    if pair not in known:
        rows, columns = _shared(a.children, b.children)
        known[pair] = 1 + _scores([a.children[i] for i in rows], [b.children[j] for j in columns], known)[-1][-1]
    return known[pair]


def unite(a: Slot, b: Slot, pages: bool = True, known: Known | None = None) -> Slot:
    """Two trees of one label as one; of the same page (repeated siblings) or of different pages. No node is left off."""
    children, i, j = [], 0, 0
    known = {} if known is None else known
    for x, y in [*align(a.children, b.children, known), (len(a.children), len(b.children))]:
        children += a.children[i:x] + b.children[j:y]
        if x < len(a.children):
            children.append(unite(a.children[x], b.children[y], pages, known))
        i, j = x + 1, y + 1
    if pages:
        same = a.same if a.same == b.same else None
    else:
        same = None if a.same is None or b.same is None else zlib.crc32(b"%d %d" % (a.same, b.same))
    return Slot(a.label, a.pages + b.pages if pages else max(a.pages, b.pages), same, a.text + b.text, a.links + b.links, children)


def main_text(page: str | None, template: Slot | None) -> str:
    """The content blocks of a page, in page order, white space folded, joined by newlines."""
    if not page:
        return ""
    blocks: list[str] = []
    current: list[str] = []

    def close() -> None:
        text = " ".join(html_entities.unescape("".join(current)).split())
        if text:
            blocks.append(text)
        current.clear()

    varies = template is not None and _varies(template)

    def walk(node: Node, slot: Slot | None, inside: bool) -> None:
        if node.out and not (inside and node.tag == "header") and not (node.tag == "form" and _holds_article(node)):
            if node.tag in BLOCK:
                close()
            return
        block = node.tag in BLOCK
        if block:
            close()
        inside = inside or node.tag in ("article", "main")
        own = True
        if slot is not None:
            if varies and slot.same and slot.pages >= (CONSTANT_INSIDE if inside else CONSTANT):
                own = False
            if not inside and slot.text and slot.links > LINKS * slot.text and node.tag not in ("#page", "html", "body"):
                return
        slots = _slots(node, slot)
        for at, child in enumerate(node.children):
            if isinstance(child, str):
                if own:
                    current.append(child)
            elif child.tag == "br":
                current.append(" ")
            else:
                walk(child, slots.get(at), inside)
        if block:
            close()

    walk(parse(page), template, False)
    close()
    return "\n".join(blocks)


def _holds_article(node: Node) -> bool:
    """Some pages stand in one form as a whole."""
    waiting = [node]
    while waiting:
        for child in waiting.pop().children:
            if isinstance(child, Node):
                if child.tag in ("article", "main", "h1"):
                    return True
                waiting.append(child)
    return False


def _varies(slot: Slot) -> bool:
    return slot.same is None or any(map(_varies, slot.children))


def _slots(node: Node, slot: Slot | None) -> dict[int, Slot]:
    """The slot of each child element, runs of one label aligned as one node."""
    if slot is None or not slot.children:
        return {}
    runs: list[tuple[Slot, list[int]]] = []
    for at, child in enumerate(node.children):
        if isinstance(child, Node):
            if runs and runs[-1][0].label == child.label:
                runs[-1][1].append(at)
            else:
                runs.append((_shape(child), [at]))
    pairs = align([r[0] for r in runs], slot.children)
    return {at: slot.children[j] for i, j in pairs for at in runs[i][1]}


def _shape(node: Node) -> Slot:
    children: list[Slot] = []
    if node.tag not in RAW:
        for child in node.children:
            if isinstance(child, Node) and (not children or children[-1].label != child.label):
                children.append(_shape(child))
    return Slot(node.label, 1, None, 0, 0, children)


def _merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Templates of rows sorted by (host, salt), one per key."""
    key = template = None
    out: list[tuple] = []
    for batch in batches:
        for host, salt, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            part = Slot.unpack(json.loads(packed))
            if key == (host, salt):
                template = unite(template, part)
            else:
                if template is not None:
                    out.append((*key, json.dumps(template.pack())))
                key, template = (host, salt), part
        yield _rows(out)
        out = []
    if template is not None:
        yield _rows([(*key, json.dumps(template.pack()))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 3
    kinds = [pa.string(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "salt", "template"])


_TEMPLATES = "host string, salt int, template string"


def with_host(pages: DataFrame) -> DataFrame:
    """The host of each url in lower case; pages without one share the empty host."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.withColumn("host", F.coalesce(host, F.lit("")))


def induce(pages: DataFrame, salts: int = 1024) -> DataFrame:
    """host, template of every host in `pages` (host, html)."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % salts
        for batch in batches:
            templates: dict[str, Slot] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if page:
                    slot = fold(parse(page))
                    templates[host] = unite(templates[host], slot) if host in templates else slot
            yield _rows([(host, salt, json.dumps(slot.pack())) for host, slot in templates.items()])

    parts = pages.select("host", "html").mapInArrow(folded, _TEMPLATES)
    for key in (("host", "salt"), ("host",)):
        parts = parts.repartition(*key).sortWithinPartitions("host", "salt").mapInArrow(_merge_sorted, _TEMPLATES)
        parts = parts.withColumn("salt", F.lit(0))
    return parts.select("host", "template")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html).

    Null and empty html gives the empty text. Repeated rows give repeated rows; null ids and urls stay. A host of few
    pages has no constant slots: its pages are decided by stated roles alone. Other columns are not read."""
    rows = with_host(pages.select("page_id", "url", "html"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates: dict[str, Slot | None] = {}
        for batch in batches:
            found = []
            for at, (name, page) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if name not in templates:
                    if len(templates) >= KEPT:
                        templates.clear()
                    packed = batch.column(4)[at].as_py()
                    templates[name] = Slot.unpack(json.loads(packed)) if packed else None
                found.append(main_text(page, templates[name]))
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    joined = rows.join(induce(rows), "host", "left").select("page_id", "url", "host", "html", "template")
    return joined.mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long")
