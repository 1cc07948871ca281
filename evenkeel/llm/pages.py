"""Main text of web pages by belief propagation on the tree of block elements.

A page becomes a tree of block elements; inline markup is part of the block it
stands in. Every node is content or not. Its own signs (tag, hints in class and
id, text length, share of link text) give a potential, and parent-child
potentials say how often a child of a content node is content itself. Messages
passed from the leaves to the root and back (sum-product) give each node's
marginal; the text of nodes at one half or more is the page's text.

Potentials are counted on labelled pages: the marked pages below, and a bounded
sample (``SAMPLE_PAGES``) of the table's own pages that name their article in
the markup. All pages are then read whole, each where it lies, so nothing is
shuffled.

Cases: a null or empty page gives an empty text; markup that is never closed
ends with its page or its container, and a tag without its ``>`` is text;
nesting of any depth is handled without recursion, broken markup of any length
in linear time; repeated rows get the same text; pages without an article are judged
by their other signs; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Generator, Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.session import ship_package

#: Pages of the table that are read to fit the potentials.
SAMPLE_PAGES = 300

# Element kinds of HTML.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr nobr math mi mn mo ms mtext mrow mfrac msqrt "
    "mroot msub msup msubsup munder mover munderover mtable mtr mtd mspace mstyle mpadded semantics".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; one that is never closed reaches to the end of the page.
RAW = set("script style iframe textarea title xmp noembed noframes".split())
#: Elements whose content is not shown; one that is never closed hides nothing.
UNSHOWN = set("template noscript svg select object canvas audio video annotation annotation-xml".split())
#: A new element of the first kind ends an open one of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that such an end does not reach beyond.
WALLS = set("ul ol dl table tbody thead tfoot div section article aside nav main form body html".split())

#: Parts of class, id and role names and the sign they give.
HINTS = {
    "menu": "menu nav breadcrumb toolbar pagination pager tabs",
    "edge": "header footer masthead banner copyright colophon",
    "side": "sidebar aside widget related recommend popular rail",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promoted outbrain taboola",
    "notice": "notice cookie consent gdpr popup modal alert overlay newsletter subscribe signup paywall",
    "comment": "comment comments reply replies discussion disqus respond",
    "share": "share social follow tags byline meta",
    "form": "form search login register contact",
    "main": "article content main post entry story body text prose",
}
_HINT_OF = {word: hint for hint, words in HINTS.items() for word in words.split()}

_HEAD = re.compile(r"<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)|(?P<note><!--|<!|<\?)")
_ATTRS = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+>")
_EDGES = {tag: re.compile(rf"<(?P<close>/?){tag}(?=[\s/>])", re.I) for tag in RAW | UNSHOWN}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-zA-Z][a-z]*|[A-Z]+")
_SPACES = re.compile(r"\s+")


class Node:
    """A block element with its place in the tree and its own text."""

    __slots__ = ("tag", "parent", "hints", "chars", "links", "label")

    def __init__(self, tag: str, parent: int, hints: tuple[str, ...] = ()):
        self.tag, self.parent, self.hints = tag, parent, hints
        self.chars = self.links = 0
        self.label: bool | None = None


def _hints(attrs: str) -> tuple[str, ...]:
    found = set()
    if attrs:
        for groups in _NAMED.findall(attrs):
            for word in _WORDS.findall("".join(groups)):
                hint = _HINT_OF.get(word.lower())
                if hint:
                    found.add(hint)
    return tuple(sorted(found))


def _tokens(html: str) -> Generator[tuple[str, bool, str, int, int], int | None, None]:
    """Tags of a page as ``(name, closing, attributes, start, end)``; name "" for comments.

    A quoted value may hold ``>``. When a tag's quotes would reach the end of the page, tags end at
    their first ``>`` from there on, so every character is looked at a bounded number of times. The
    reader may send the place to go on from.
    """
    at, quoted = 0, True
    while (start := html.find("<", at)) >= 0:
        at = start + 1
        head = _HEAD.match(html, start)
        if head is None:
            continue
        if head["tag"] is None:
            if head["note"] == "<!--":
                close = html.find("-->", start + 2)
                at = close + 3 if close >= 0 else len(html)
            else:
                close = html.find(">", at)
                if close < 0:
                    return
                at = close + 1
            yield "", False, "", start, at
            continue
        rest = _ATTRS.match(html, head.end()) if quoted else None
        if rest is None:
            quoted = False
            close = html.find(">", head.end())
            if close < 0:
                return
            at = close + 1
        else:
            at = rest.end()
        go_on = yield head["tag"].lower(), bool(head["close"]), html[head.end():at - 1], start, at
        if go_on is not None:
            at = go_on
            yield "", False, "", at, at


class _Hidden:
    """Where elements whose content is not shown end."""

    def __init__(self, html: str):
        self.html = html
        self.open_ended: set[str] = set()

    def end(self, tag: str, at: int) -> int | None:
        """End of the element that starts before ``at``; None for one that is never closed."""
        if tag in self.open_ended:
            return None
        depth, close = 1, at
        for m in _EDGES[tag].finditer(self.html, at):
            if close < m.end():
                close = self.html.find(">", m.end())
                if close < 0:
                    break
            if m["close"]:
                depth -= 1
            elif tag not in RAW and self.html[close - 1] != "/":
                depth += 1
            if not depth:
                return close + 1
        self.open_ended.add(tag)
        return None


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements, parents first, and the text blocks in page order with their node."""
    nodes = [Node("#page", -1)]
    stack = [0]
    places: dict[str, list[int]] = {}  # depths at which a tag is open
    walls: list[int] = []
    inline: Counter = Counter()
    blocks: list[tuple[int, str]] = []
    pending: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pending:
            text = _SPACES.sub(" ", "".join(pending)).strip()
            if text:
                node = nodes[stack[-1]]
                node.chars += len(text)
                node.links += min(linked, len(text))
                blocks.append((stack[-1], text))
            pending.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = unescape(text) if "&" in text else text
            pending.append(text)
            if inline["a"] > 0:
                linked += len(text.strip())

    def leave(depth: int) -> None:
        flush()
        for place in stack[depth:]:
            places[nodes[place].tag].pop()
        while walls and walls[-1] >= depth:
            walls.pop()
        del stack[depth:]
        inline.clear()

    def innermost(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    hidden = _Hidden(html)
    tokens = _tokens(html)
    done = 0
    for tag, closing, attrs, start, at in tokens:
        add(html[done:start])
        done = at
        if not tag:
            continue
        if closing:
            if tag in INLINE:
                if inline[tag] > 0:
                    inline[tag] -= 1
            elif places.get(tag):
                leave(places[tag][-1])
            continue
        if tag in RAW or tag in UNSHOWN:
            if not attrs.rstrip().endswith("/"):
                end = hidden.end(tag, at)
                if end is None and tag in RAW:
                    end = len(html)
                if end is not None:
                    done = end
                    tokens.send(end)
            continue
        if tag in INLINE:
            if tag == "br":
                pending.append(" ")
            elif tag not in VOID:
                inline[tag] += 1
            continue
        flush()
        if tag in VOID:
            continue
        ended = ENDS.get(tag, set())
        while True:
            depth = innermost({"p"} | ended)
            if depth <= (walls[-1] if walls else 0):
                break
            was = nodes[stack[depth]].tag
            leave(depth)
            if was != "p":
                break
        inline.clear()
        nodes.append(Node(tag, stack[-1], _hints(attrs)))
        places.setdefault(tag, []).append(len(stack))
        if tag in WALLS:
            walls.append(len(stack))
        stack.append(len(nodes) - 1)
    add(html[done:])
    flush()
    return nodes, blocks


#: Steps of text size that are told apart.
LARGEST = 6


def _step(value: int) -> int:
    return min(LARGEST, value.bit_length() // 2)


def signs(node: Node) -> tuple[str, ...]:
    """What a node shows of itself."""
    share = 0 if not node.chars else 1 + (4 * node.links) // (node.chars + 1)
    return (f"tag:{node.tag}", f"size:{_step(node.chars)}", f"links:{share}",
            *(f"hint:{h}" for h in node.hints))


class TreeModel:
    """Potentials of nodes and of parent-child pairs, as log-odds and log-probabilities."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.pair = [[math.log(0.5)] * 2 for _ in range(2)]

    @classmethod
    def fit(cls, pages: Iterable[list[Node]]) -> TreeModel:
        """Count signs and pairs on pages whose nodes carry labels."""
        seen = (Counter(), Counter())
        totals, pairs = [0, 0], [[1.0, 1.0], [1.0, 1.0]]
        for nodes in pages:
            for node in nodes:
                label = int(bool(node.label))
                totals[label] += 1
                seen[label].update(signs(node))
                if node.parent >= 0:
                    pairs[int(bool(nodes[node.parent].label))][label] += 1
        model = cls()
        for sign in seen[0].keys() | seen[1].keys():
            yes = (seen[1][sign] + 0.5) / (totals[1] + 1)
            no = (seen[0][sign] + 0.5) / (totals[0] + 1)
            model.weight[sign] = math.log(yes / no)
        for step in range(1, LARGEST + 1):  # a size that no page shows counts like the next smaller one
            model.weight.setdefault(f"size:{step}", model.weight.get(f"size:{step - 1}", 0.0))
        model.pair = [[math.log(c / sum(row)) for c in row] for row in pairs]
        return model

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability that each node is content: messages to the root, then back."""
        weight, (from_no, from_yes) = self.weight, self.pair
        # log of the upward messages' product, for not content and content
        no = [0.0] * len(nodes)
        yes = [sum(weight.get(s, 0.0) for s in signs(n)) for n in nodes]
        up = [(0.0, 0.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            parent = nodes[i].parent
            up[i] = (_log_sum(from_no[0] + no[i], from_no[1] + yes[i]),
                     _log_sum(from_yes[0] + no[i], from_yes[1] + yes[i]))
            no[parent] += up[i][0]
            yes[parent] += up[i][1]
        for i in range(1, len(nodes)):
            parent = nodes[i].parent
            a, b = no[parent] - up[i][0], yes[parent] - up[i][1]
            no[i] += _log_sum(a + from_no[0], b + from_yes[0])
            yes[i] += _log_sum(a + from_no[1], b + from_yes[1])
        return [1 / (1 + math.exp(min(700.0, max(-700.0, n - y)))) for n, y in zip(no, yes, strict=True)]

    def extract(self, html: str | None) -> str:
        nodes, blocks = parse(html or "")
        if not blocks:
            return ""
        chance = self.marginals(nodes)
        return "\n".join(text for node, text in blocks if chance[node] >= 0.5)


def _log_sum(a: float, b: float) -> float:
    high = a if a > b else b
    return high + math.log1p(math.exp(-abs(a - b)))


# ---- labelled pages -------------------------------------------------------------------

_SENTENCE = "The river rose in the night and fell again before anyone had seen how far it went. "

#: Pages with their content inside ``<mark-content>``; the marks are not part of the tree.
MARKED_PAGES = [
    """<html><body><header class="masthead"><h2>Daily Site</h2><nav class="menu"><ul><li><a>Home</a></li>
    <li><a>World</a></li></ul></nav></header><div class="cookie-notice"><p>We use cookies on this site to
    give you the best experience.</p><button>Accept</button></div><main><mark-content><article><h1>A
    headline of the story</h1><p>The first paragraph tells the story in several words, with a point.</p>
    <p>Another paragraph goes on, and on, until all has been said that there is to say.</p><ul><li>An item
    of a list in the story.</li><li>One more item.</li></ul><blockquote><p>Someone said something worth a
    quote.</p></blockquote></article></mark-content><aside class="sidebar"><h3>Related</h3><ul>
    <li><a>Other story</a></li><li><a>One more story</a></li></ul><p>Short words about the site.</p></aside>
    </main><section class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with the story
    at all, because it is too short.</p></div><div class="comment"><p>Nice.</p></div><form><label>Name
    </label><p>Write a reply</p></form></section><footer><p>&copy; Daily Site</p><ul><li><a>Imprint</a></li>
    </ul></footer></body></html>""",
    """<html><body><div id="header"><p>My blog</p></div><div class="nav"><ul><li><a>Start</a></li><li>
    <a>About</a></li></ul></div><div class="ad"><p>Buy two, get one for free, only today in our shop.</p>
    </div><mark-content><div class="post"><h1>What I did</h1><div class="entry-content"><p>I went to the
    shore and looked at the waves for an hour or two.</p><h2>Later</h2><p>Then I went home again. It was
    late, and the train was full of people.</p><p>Good.</p><table><tr><td>Waves</td><td>12</td></tr></table>
    <pre>a line of code</pre></div></div></mark-content><div class="share"><p>Share this post with your
    friends</p></div><div id="comments"><h3>Two comments</h3><ul><li class="comment"><p>Great text, thank
    you for it.</p></li><li class="comment"><p>Where was that?</p></li></ul></div><div class="newsletter">
    <form><p>Subscribe to our letter and get mail each week.</p></form></div><div id="footer"><p>All rights
    reserved.</p></div></body></html>""",
    """<html><body><nav><a>One</a><a>Two</a></nav><div class="alert notice"><p>Our service will be closed on
    Monday, please come back on Tuesday.</p></div><div><mark-content><div><h1>Plain page</h1><p>This page
    has no class names at all, only text in paragraphs of some length.</p><p>It has a second paragraph, so
    that there is more to read for everyone.</p><p>And a third one, a short one.</p></div></mark-content>
    <div class="widget"><h4>Popular</h4><ul><li><a>First</a></li><li><a>Second</a></li></ul></div></div>
    <form class="search"><p>Search the site</p></form><footer>Made by hand. <a>Contact</a></footer></body>
    </html>""",
    """<html><body><header><h1>Site name</h1><p>The line below the name of the site</p></header><mark-content><article>
    <section><h2>A part</h2><p>Words of the part, as many as it takes to say what is meant.</p>
    </section><section><h2>Next part</h2><p>More words, in the next part, about the same things.</p><figure>
    <figcaption>What the picture shows</figcaption></figure></section><div class="promo">
    <p>Read our other articles about this, they are good.</p></div><aside><p>A box with facts that stands
    beside the text.</p></aside></article></mark-content><div class="sponsored"><p>An offer by our partner, for you and
    your family.</p></div><footer><div><p>Address of the publisher</p></div></footer></body></html>""",
    """<html><body><nav id="menu"><ul><li><a>Top</a></li><li><a>Sports</a></li><li><a>Arts</a></li></ul></nav>
    <mark-content><article><h1>Short news</h1><p>Rain fell.</p><p>Then the sun came out, and all went for a
    walk along the river until the evening.</p><ul><li>Umbrellas were put away.</li><li>Ice was sold.</li></ul>
    <p>The end.</p></article></mark-content><div class="related"><h3>More</h3><p>Snow in the hills</p></div>
    <div class="comments"><p>Lovely day.</p><p>I stayed in and read, which was lovely as well, I must say.</p>
    </div><footer><p>Terms and imprint of this site.</p></footer></body></html>""",
    """<html><body><div class="header"><h1>Shop</h1></div><div class="main"><mark-content><div class="content">
    <h1>How to bake bread</h1><p>Mix flour, water, salt and yeast, and let the dough rest for a night.</p>
    <ol><li>Heat the oven as hot as it gets.</li><li>Bake for half an hour.</li></ol><h3>Tips</h3><p>Use less
    yeast.</p><table><tr><td>Flour</td><td>500 g</td></tr><tr><td>Water</td><td>350 g</td></tr></table></div>
    </mark-content><div class="sidebar"><p>Our new oven gloves are here, come and look at them.</p><form><p>Your
    address</p></form></div></div><div class="cookie banner"><p>This shop uses cookies to remember your
    basket.</p></div><div class="footer"><p>Shop, Main street 1</p></div></body></html>""",
    """<html><body><aside class="ad"><p>The best price for your old car, call us now.</p></aside><main>
    <mark-content><article><header><h1>On rivers</h1></header><section><p>Rivers run from the hills to the
    sea, and they take sand with them on the way.</p><blockquote>All things flow.</blockquote></section>
    <section><h2>Lakes</h2><p>Lakes hold the water for a while.</p><p>Some dry out.</p></section></article>
    </mark-content></main><section id="comments"><h2>Replies</h2><article class="comment"><p>I live at a lake
    and can say that this is so.</p></article></section><footer>About us</footer></body></html>""",
    f"""<html><body><nav><ul><li><a>News</a></li><li><a>Weather</a></li></ul></nav><div class="ad">Cheap boats.</div>
    <mark-content><div><h1>A long report</h1><p>{_SENTENCE * 5}</p><p>{_SENTENCE * 14}</p><p>{_SENTENCE * 3}</p>
    <p>{_SENTENCE * 60}</p></div></mark-content><footer>&copy; The report, all rights reserved.</footer></body></html>""",
    f"""<html><body><header>Letters of a town</header><div class="menu"><a>Start</a> <a>Archive</a></div><mark-content>
    <div><h2>On floods</h2><p>{_SENTENCE * 20}</p><p>{_SENTENCE}</p><ul><li>{_SENTENCE}</li><li>{_SENTENCE * 4}</li>
    </ul><p>{_SENTENCE * 8}</p><blockquote>{_SENTENCE * 5}</blockquote></div></mark-content><div class="comments">
    <div class="comment"><p>{_SENTENCE * 4}</p></div><div class="comment"><p>{_SENTENCE * 13}</p></div></div>
    <aside>{_SENTENCE * 4}</aside><form><p>Write to us</p></form><footer><p>{_SENTENCE * 4}</p></footer></body></html>""",
    f"""<html><body><div id="nav"><a>One</a><a>Two</a></div><div id="page"><mark-content><div><h1>Notes</h1>
    {_SENTENCE * 16}<br>{_SENTENCE * 50}</div></mark-content></div><div class="cookie-notice">{_SENTENCE * 4}</div>
    <div class="sidebar"><p>{_SENTENCE * 3}</p></div><div id="footer">Printed in the town.</div></body></html>""",
    f"""<html><body><nav><ul><li><a>Home</a></li><li><a>Boats</a></li></ul></nav><mark-content><div><h1>A short report</h1>
    <p>{_SENTENCE * 4}</p></div></mark-content><footer>The report, made by hand.</footer></body></html>""",
    """<html><body><header><a>Start</a></header><mark-content><div><h1>A note</h1><p>The bridge is open again since
    this morning.</p></div></mark-content><footer>All rights reserved.</footer></body></html>""",
]


def _labelled(html: str, is_content) -> list[Node]:
    """Nodes with labels; ``is_content(node)`` starts content, and what is inside follows."""
    nodes, _ = parse(html)
    for node in nodes:
        above = nodes[node.parent] if node.parent >= 0 else None
        node.label = bool(above and above.label) and not is_content(node, False) or is_content(node, True)
    return nodes


_OUT = {"nav", "footer", "header", "aside", "form", "button"}


def _marked(node: Node, start: bool) -> bool:
    """Content starts at the mark; it ends at elements that are never content."""
    return node.tag == "mark-content" if start else node.tag in _OUT or bool(
        {"advert", "comment", "notice", "side", "share", "form", "menu"} & set(node.hints))


def _article(node: Node, start: bool) -> bool:
    return node.tag in ("article", "main") if start else _marked(node, False)


def _without_marks(nodes: list[Node]) -> list[Node]:
    """Take the marks out of the tree and hand their children to the parent."""
    place, kept = {}, []
    for i, node in enumerate(nodes):
        parent = node.parent
        while parent >= 0 and nodes[parent].tag == "mark-content":
            parent = nodes[parent].parent
        if node.tag != "mark-content":
            place[i] = len(kept)
            node.parent = place[parent] if parent >= 0 else -1
            kept.append(node)
    return kept


def fit_pages(pages: DataFrame, sample: int = SAMPLE_PAGES) -> TreeModel:
    """Count potentials on the marked pages and on pages that name their article."""
    named = pages.filter(F.lower("html").contains("<article")).select("page_id", "html").orderBy(
        "page_id", "html").limit(sample).collect()
    # the marked pages together count as much as the sample, so that it does not drown them
    times = max(1, len(named) // len(MARKED_PAGES))
    labelled = [_without_marks(_labelled(p, _marked)) for p in MARKED_PAGES] * times
    return TreeModel.fit(labelled + [_labelled(r["html"], _article) for r in named])


def extract_text(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every page."""
    ship_package(pages.sparkSession)
    model = fit_pages(pages, sample)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                texts = [model.extract(h) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                    names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        work, "page_id long, url string, text string")
