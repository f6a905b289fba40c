"""HTML extraction by tree scoring.

The page is cut into tags and texts and built into a tree that mends unclosed tags. Scripts,
styles, embedded media, buttons and what a page hides are left out. Parts that are no article
text are marked: by tag (menus, headers outside an article, footers, sidebars, forms), by role,
and by class and id names, word by word: a name counts if its words name such a part
(``ad-box``, ``comment-body``), not if one of them says what a page has or allows
(``with-ads``, ``comments-open``) or if the part's word merely occurs (``market-share``).

Every paragraph that isn't marked passes points to its ancestors: one, one for each comma, and
one for each hundred characters up to three; the parent gets all of them, the next ancestor
half, and each further one less. A container's points are raised for ``article``, ``main`` and
names of content, and discounted by its link density. The best one, or the article that it lies
in with articles beside it that score half as much, and its siblings that score well or are headings or plain paragraphs, make up the text.
Outside of an article, lists that consist of links are left out; inside, only marked parts are.

Inside an article a heading's words may be an element's id, so a name such as ``comments`` or ``search`` marks a part there only
with a second sign: that it is mostly links, or holds a form, or several elements of that kind, or times.

Marks by forms, page headers, hiding and ambiguous names are taken back if they leave little: if what isn't
marked holds less than a quarter of the text of the best of these parts, that part counts as
unmarked and the page is scored again.

Blocks are the texts of block elements in page order, with character references decoded and
white space (``br`` too) turned into one space and trimmed, joined by one newline; empty blocks
go. A null or empty page, or one without text, gives an empty string. Parsing never fails: a
tag that the page's end cuts off is dropped, a quote that is never closed is none. Time grows in
proportion to the page: tags are found by one pass, and closing one looks up where it was
opened. Repeated rows give repeated results, an empty table an empty one. Other columns pass
through unchanged; input columns ``text`` and ``n_chars`` are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import named

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[\"'>]")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

#: Element names of HTML by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = frozenset("table ul ol dl select body html article section div".split())
NEVER = frozenset("script style noscript template head button select textarea iframe svg canvas object audio video input title".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd".split())
#: Tags and roles of parts that are no article text; the second of each may turn out to hold the article.
PARTS, MAYBE_PARTS = frozenset("nav footer aside dialog menu".split()), frozenset("form header".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar".split())
MAYBE_ROLES = frozenset("form note alert".split())
#: Words of class and id names, for parts that are no article text, and for such that may be.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos comment comments commentlist disqus replies "
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer cookie cookies consent gdpr newsletter popup modal pagination pager sidebar toolbar masthead "
    "outbrain taboola login signup".split()
)
MAYBE_NAMES = frozenset(
    "header banner notice notices alert warning disclaimer related recommended popular trending search tags teaser widget rail side social share sharing "
    "subscribe subscription skip reply promotion overlay".split()
)
#: Words that may stand beside them, and words that make a name say something else.
BESIDE = frozenset(
    "section list area box block wrapper wrap container bar top bottom left right inner outer item items content body text main title heading links link group "
    "panel unit slot zone region row col column module component primary secondary site page post article entry story global local mobile desktop sticky fixed "
    "small large form thread respond div id".split()
)
SAYS = frozenset(
    "with has have no not without is are open opened closed enabled disabled show shown hide active off on free layout type format status category theme "
    "template supports allow allows allowed loaded ready default".split()
)
GOOD = frozenset("article content main post entry story".split())
#: Words that headings have as well, so that inside an article a name of them needs a second sign; and asides that are text.
HEADLIKE = frozenset(
    "comment comments replies reply nav navigation menu menus search tags header banner warning alert related recommended popular trending login signup "
    "share sharing social side rail skip promotion subscription subscribe footer sidebar toolbar pagination".split()
)
QUOTES = frozenset("pullquote quote".split())
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: How surely a part is no article text.
NO, MAYBE, SURE = 0, 1, 2


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "mark", "good", "points", "length", "links", "anchors", "commas", "doubt")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.items: list[Node | str] = []
        self.mark, self.good, self.doubt = NO, False, frozenset()


def _name_mark(tag: str, name: str, inside: bool) -> int:
    """What one class or id name says of a part."""
    words = [w.lower() for w in _WORDS.findall(name)]
    found = {w for w in words if w in NAMES or w in MAYBE_NAMES and not (inside and w == "header")}
    if not found or any(w in SAYS for w in words):
        return NO
    others = [w for w in words if w not in found]
    if others and (tag in PARAGRAPHS or tag in HEADINGS or tag not in BLOCK):
        return NO  # a paragraph or inline element has to be named just so
    if all(w in BESIDE for w in others):
        return SURE if found & NAMES else MAYBE
    return SURE if words[-1] in NAMES else NO


def _names(node: Node) -> list[str]:
    """Words of an element's class and id names."""
    return [w.lower() for name, value in _ATTR.findall(node.attrs) if name.lower() in ("class", "id") for w in _WORDS.findall(value)]


def judge(node: Node, inside: bool) -> None:
    """Marks a part by its tag, role, names and hiding; ``inside`` an article or main element."""
    _judge(node, inside)
    if node.mark and inside and node.attrs:
        words = _names(node)
        if node.tag == "aside" and not QUOTES.isdisjoint(words):
            node.mark = NO
        elif node.tag not in PARTS | MAYBE_PARTS and (found := {w for w in words if w in NAMES | MAYBE_NAMES}) and found <= HEADLIKE and not _by_role(node):
            node.doubt = frozenset(found)


def _by_role(node: Node) -> bool:
    return any(name.lower() in ("role", "hidden", "aria-hidden", "style") for name, _ in _ATTR.findall(node.attrs))


def _second_sign(node: Node) -> bool:
    """Whether a part that a name alone marks looks like one: mostly links, a form, or several elements of its kind or times."""
    _measure(node)
    if _density(node) >= 0.5:
        return True
    kind = {w.removesuffix("s").replace("replie", "reply") for w in node.doubt} | {"comment", "reply"}
    alike = times = 0
    stack: list[Node | str] = [*node.items]
    while stack:
        x = stack.pop()
        if isinstance(x, Node):
            if x.tag in ("form", "input"):
                return True
            times += x.tag == "time"
            alike += x.tag in BLOCK and not kind.isdisjoint(w.removesuffix("s") for w in _names(x))
            stack.extend(x.items)
    return alike >= 2 or times >= 2


def _settle(root: Node) -> None:
    """Takes back the marks that a name alone gave inside an article, where there is no second sign."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.doubt:
            node.mark = node.mark if _second_sign(node) else NO
        if not (node.doubt and node.mark):
            stack.extend(x for x in node.items if isinstance(x, Node))


def _judge(node: Node, inside: bool) -> None:
    tag = node.tag
    mark = SURE if tag in PARTS else MAYBE if tag == "form" or tag == "header" and not inside else NO
    if node.attrs and tag not in ("html", "body"):
        for name, value in _ATTR.findall(node.attrs):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                for x in value.split():
                    if tag != "main":
                        mark = max(mark, _name_mark(tag, x, inside))
                    node.good |= not GOOD.isdisjoint(w.lower() for w in _WORDS.findall(x))
            elif name == "role" and value.lower() in ROLES:
                mark = SURE
            elif name == "role" and value.lower() in MAYBE_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
                mark = max(mark, MAYBE)
    node.mark = mark


class _Open:
    """The open elements, with the places of each tag, of blocks and of fences among them."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.of: dict[str, list[int]] = {root.tag: [0]}
        self.blocks, self.fences, self.drop = [0], [0], 0
        self.inside = 0

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.of.setdefault(node.tag, []).append(at)
        if node.tag in BLOCK:
            self.blocks.append(at)
        if node.tag in FENCE:
            self.fences.append(at)
        self.inside += node.tag in ("article", "main")

    def close(self, to: int) -> None:
        """Close all from place ``to`` on."""
        while len(self.nodes) > to:
            node = self.nodes.pop()
            self.of[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()
            if node.tag in FENCE:
                self.fences.pop()
            self.inside -= node.tag in ("article", "main")
        if self.drop > to:
            self.drop = 0

    def last(self, tag: str) -> int:
        places = self.of.get(tag)
        return places[-1] if places else -1


def tags(page: str) -> Iterator[tuple[str, str, str]]:
    """(text, name of an opening tag or / and the name of a closing one, attributes); a last text has no name."""
    size, at, text = len(page), 0, 0
    gone: set[str] = set()  # characters that don't come any more
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            after = end + 3 if end >= 0 else size
            name = ""
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            after, name = (end + 1 if end >= 0 else size), ""
        elif m := _NAME.match(page, at + 1):
            from_ = stop = m.end()
            behind = from_  # of the last quote or the name
            while True:
                found = _STOP.search(page, stop) if ">" not in gone else None
                if not found:
                    after = size  # the page's end cuts the tag off
                    name = ""
                    gone.add(">")
                    break
                stop = found.end()
                if found[0] == ">":
                    after, name = stop, m[1] + m[2].lower()
                    break
                if found[0] not in gone:  # a quote opens a value only after an equals sign
                    before = page[behind : stop - 1].rstrip()
                    behind = stop
                    if before.endswith("="):
                        end = page.find(found[0], stop)
                        if end >= 0:
                            behind = stop = end + 1
                        else:
                            gone.add(found[0])
        else:
            at += 1
            continue
        yield page[text:at], name, page[m.end() : after - 1] if name and name[0] != "/" else ""
        at = text = after
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = text = end.end() if end else size
    yield page[text:], "", ""


def parse(page: str) -> Node:
    """The tree, its parts marked."""
    root = Node("html", "", None)
    opened = _Open(root)
    for text, name, attrs in tags(page):
        if text and not opened.drop:
            opened.nodes[-1].items.append(text)
        if not name or name in RAW:
            continue
        fence = opened.fences[-1]
        if name[0] == "/":
            name = name[1:]
            at = opened.last(name)
            if at > 0 and (name in BLOCK or at >= fence):
                opened.close(at)
            elif name == "p" and at < 0 and not opened.drop:
                opened.nodes[-1].items.append(Node("p", "", opened.nodes[-1]))
            continue
        if name == "html" or name == "body" and opened.last("body") > 0:
            continue
        if name == "body":
            opened.close(1)
        elif name in BLOCK and opened.nodes[opened.blocks[-1]].tag == "p":  # ends an open paragraph
            opened.close(opened.blocks[-1])
        if name in CLOSES:
            while (at := max(opened.last(t) for t in CLOSES[name])) > opened.fences[-1]:
                opened.close(at)
                if name != "tr":
                    break
        node = Node(name, attrs, opened.nodes[-1])
        if name in VOID:
            if not opened.drop:
                opened.nodes[-1].items.append(node)
            continue
        if not opened.drop:
            if name in NEVER:
                opened.drop = len(opened.nodes) + 1
            else:
                judge(node, opened.inside > 0)
                opened.nodes[-1].items.append(node)
        opened.push(node)
    return root


def _walk(root: Node) -> list[Node]:
    """The nodes from ``root`` down that aren't marked, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(x for x in reversed(node.items) if isinstance(x, Node) and not x.mark)
    return out


def _measure(root: Node) -> list[Node]:
    """Characters, commas, linked characters and links of every unmarked node, from the leaves up; then points."""
    nodes = _walk(root)
    for node in nodes:
        node.points = 0.0
        node.length = node.links = node.anchors = node.commas = 0
    for node in reversed(nodes):
        own = [x for x in node.items if isinstance(x, str)]
        node.length += sum(len(" ".join(x.split())) for x in own)
        node.commas += sum(x.count(",") + x.count("，") + x.count("、") for x in own)
        if node.tag == "a":
            node.links = node.length
            node.anchors += 1
        if node is not root and node.parent:
            node.parent.length += node.length
            node.parent.commas += node.commas
            node.parent.links += node.links
            node.parent.anchors += node.anchors
    for node in nodes:
        plain = node.tag in PARAGRAPHS or node.tag in BLOCK and any(isinstance(x, str) and len(x.strip()) >= 25 for x in node.items)
        if plain and node.length >= 25:
            points = 1 + node.commas + min(node.length // 100, 3)
            above, level = node, 0
            while above is not root and level < 5:
                above = above.parent
                above.points += points / (1, 2, 6, 9, 12)[level]
                level += 1
    return nodes


def _density(node: Node) -> float:
    return node.links / node.length if node.length else 0.0


def _score(node: Node) -> float:
    raised = (1.5 if node.tag in ("article", "main") else 1.0) * (1.25 if node.good else 1.0)
    return node.points * raised * (1 - _density(node))


def _link_list(node: Node) -> bool:
    return node.tag in ("ul", "ol", "dl", "div", "section", "table") and node.anchors >= 3 and _density(node) >= 0.8


def blocks(parts: list[Node], link_lists: bool) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    stack: list[Node | str | None] = [*reversed(parts)]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(html.unescape(x))  # by itself: a reference doesn't go on in another element
        elif x.tag == "br":
            run.append(" ")
        elif not x.mark and (link_lists or not _link_list(x) if x.tag not in VOID else True):
            if x.tag in BLOCK:
                end()
                stack.append(None)
            stack.extend(reversed(x.items))
    end()
    return out


def _restored(root: Node) -> bool:
    """Takes back the mark of the best part that may be the article, if little is left without it."""
    stack, marked = [root], []
    while stack:
        for x in stack.pop().items:
            if isinstance(x, Node) and x.mark != SURE:
                stack.append(x)
                if x.mark:
                    marked.append(x)
    left = root.length
    for node in marked:  # without the marked parts in it, so that each node is measured once
        _measure(node)
    best = max(marked, key=_score, default=None)
    if best is None or best.points < 1 or 4 * left >= best.length:
        return False
    while best is not None:  # and of what it lies in
        best.mark = NO
        best = best.parent
    return True


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    root = parse(page.replace("\r\n", "\n").replace("\0", ""))
    _settle(root)
    nodes = _measure(root)
    while _restored(root):
        nodes = _measure(root)
    scored = [n for n in nodes if n.points > 0 and n.tag in BLOCK]
    if not scored:
        article = [n for n in nodes if n.tag in ("article", "main") and n.length]
        return "\n".join(blocks(article[:1] or [root], bool(article)))
    best = max(scored, key=_score)
    above = best
    while above is not None and above.tag not in ("article", "main"):
        above = above.parent
    if above is not None:
        # articles beside it that score half of it or more are parts of the same text
        beside = above.parent.items if above.tag == "article" and above.parent is not None else [above]
        least = max(1.0, 0.5 * _score(above))
        return "\n".join(blocks([x for x in beside if x is above or isinstance(x, Node) and x.tag == "article" and not x.mark and _score(x) >= least], True))
    while best.tag in PARAGRAPHS | {"ul", "ol", "dl", "table", "tbody", "tr"} and best.parent is not None:
        best = best.parent
    if best.parent is None or best.tag == "body":
        return "\n".join(blocks([best], False))
    least = max(10.0, 0.2 * _score(best))
    kept = []
    for x in best.parent.items:
        if x is best or isinstance(x, Node) and not x.mark and x.tag not in VOID and (
            _score(x) >= least
            or x.tag in HEADINGS
            or x.tag in ("p", "blockquote", "pre", "ul", "ol", "table", "figure") and _density(x) < 0.25
        ):
            kept.append(x)
    return "\n".join(blocks(kept, False))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=[*batch.schema.names[:-1], "text", "n_chars"],
        )


def html_extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Every column of ``pages`` but the html, then ``text`` and ``n_chars`` (code points)."""
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = T.StructType([*(pages.schema[c] for c in rest), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*(named(c) for c in rest), named(html_col).cast("string").alias("html")).mapInArrow(_run, schema)
