"""Main-text extraction with a tree-structured graphical model over the DOM.

Every element and every run of text is a node with two states, content or not. A node's own potential comes from
features of its tag, attributes, length, links and punctuation; the potential between parent and child depends on
the child's tag. Sum-product messages pass upward and downward once, which is exact on a tree, and give each
node's marginal. The potentials are log-odds of counts over labelled pages: `labelled_pages` makes such pages
from layout rules, with the article's nodes labelled, and more can be given to `train`.

Defined cases: a null or empty page has no text; broken markup is parsed as browsers do for the cases that matter
(unclosed paragraphs and list items, stray end tags, text after the end of the body, tags inside scripts); a page
without any content node gives an empty text; repeated rows are extracted each; other columns are ignored. Nothing
is dropped or capped within content.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

_ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
#: Comments, raw-text elements (to the end of the page without an end tag, as browsers do), closed templates and menus, tags, or text.
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|(<(script|style|noscript|textarea|iframe|title)(?![^\s/>]){_ATTRIBUTES}>).*?(?:</\2\s*>|\Z)|<(template|select)(?![^\s/>]){_ATTRIBUTES}>.*?</\3\s*>" r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S | re.I)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
SPACE = re.compile(r"[ \t\n\r\f\v\xa0 -     　 \x1c-\x1f\x85]+")
#: Elements without an end, elements inside a line, and elements that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Node:
    __slots__ = ("tag", "names", "parent", "children", "text", "chars", "link_chars", "score", "up", "content", "inside")

    def __init__(self, tag, names, parent):
        self.tag, self.names, self.parent = tag, names, parent
        self.children: list[Node] = []
        self.text, self.chars, self.link_chars, self.score, self.up, self.content = None, 0, 0, 0.0, 0.0, 0.0
        self.inside: tuple[str, ...] = ()


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents before children; the first is the root. Text nodes have the tag #text."""
    root = Node("#root", (), None)
    nodes, at, stack = [root], root, [root]
    tokens = TOKEN.finditer(page)
    while m := next(tokens, None):
        tag = m.group(5)
        if tag is None:
            start = m.group(1)
            if start and start.endswith("/>") and any(n.tag in ("svg", "math") for n in stack):
                # closes itself there: the text goes on behind it
                tokens = TOKEN.finditer(page, m.end(1))
                continue
            s = m.group()
            if s[0] != "<" or s == "<":
                if not s.isspace() or at.tag in INLINE or (at.children and at.children[-1].tag in INLINE):
                    node = Node("#text", (), at)
                    node.text = s
                    nodes.append(node)
                    at.children.append(node)
            continue
        tag = tag.lower()
        if m.group(4):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            at = stack[-1]
            continue
        if tag in ENDS_P or tag in SAME_ENDS:
            ends = SAME_ENDS.get(tag, ("p",)) if tag not in ENDS_P else ("p",)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
            at = stack[-1]
        attrs = m.group(6)
        names: list[str] = []
        if attrs and len(attrs) > 3:
            for a in ATTRIBUTE.finditer(attrs):
                value = a.group(2) or a.group(3) or a.group(4) or a.group(1)
                names += [p.lower() for p in NAME_PART.findall(value)]
        node = Node(tag, tuple(names), at)
        nodes.append(node)
        at.children.append(node)
        if tag not in VOID and not attrs.rstrip().endswith("/"):
            stack.append(node)
            at = node
    settle(nodes)
    for node in reversed(nodes):
        if node.text is not None:
            node.chars = len(node.text.strip())
        if node.tag == "a":
            node.link_chars = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
    return nodes


def settle(nodes: list[Node]) -> None:
    """Note for every element the tags and names of those it lies in, each once."""
    for node in nodes:
        up = node.parent
        if node.text is None and up is not None:
            own = [] if up.tag in ("#root", "html", "body", "div", "p") or up.tag in INLINE else ["in:" + up.tag]
            own += ["in:" + x for x in up.names]
            node.inside = tuple(dict.fromkeys([*up.inside, *own])) if own else up.inside


def features(node: Node) -> list[str]:
    """Names of what is seen of one node and of the elements around it. Inline elements have none: they follow
    their parents."""
    if node.tag in INLINE:
        return []
    if node.text is not None:
        return [] if node.parent.tag in INLINE else ["stop" if node.text.rstrip()[-1:] in ".!?…" else "open"]
    out = ["tag:" + node.tag, *("name:" + x for x in node.names), *node.inside]
    out.append(f"links:{min(4, int(5 * node.link_chars / node.chars)) if node.chars else 'none'}")
    if node.tag != "p":
        out.append(f"size:{min(8, node.chars.bit_length())}")
    return out


class TreeModel:
    """unary: feature -> log-odds of content. pair: child's tag -> 2 x 2 log potentials [parent][child]."""

    def __init__(self, unary: dict[str, float], pair: dict[str, tuple]):
        self.unary, self.pair = unary, pair
        self.default = pair["*"]

    def marginals(self, nodes: list[Node]) -> None:
        """Set each node's `content` to its marginal: messages upward in reverse order, then downward."""
        get, pair, exp, log1p = self.unary.get, self.pair, math.exp, math.log1p
        for n in nodes:
            s = sum([get(f, 0.0) for f in features(n)])
            n.score = max(-12.0, min(12.0, s))

        def soft(x):
            return x + log1p(exp(-x)) if x > 0 else log1p(exp(x))

        belief = {id(n): n.score for n in nodes}
        for n in reversed(nodes):
            if n.parent is None:
                continue
            # message: log-odds that the child's subtree gives its parent
            b, (t0, t1) = belief[id(n)], pair.get(n.tag, self.default)
            n.up = (t1[0] + soft(b + t1[1] - t1[0])) - (t0[0] + soft(b + t0[1] - t0[0]))
            belief[id(n.parent)] += n.up
        for n in nodes:
            if n.parent is not None:
                # what the parent believes without this child
                b, (t0, t1) = belief[id(n.parent)] - n.up, pair.get(n.tag, self.default)
                down = (t0[1] + soft(b + t1[1] - t0[1])) - (t0[0] + soft(b + t1[0] - t0[0]))
                belief[id(n)] += down
            n.content = belief[id(n)]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        self.marginals(nodes)
        return text_of(nodes[0])


def text_of(root: Node) -> str:
    """Content text by blocks: white space within a block becomes one space, blocks are joined by one space."""
    blocks: list[list[str]] = [[]]
    todo: list = [root]
    while todo:
        n = todo.pop()
        if n is None:
            blocks.append([])
        elif n.text is not None:
            if n.content > 0:
                blocks[-1].append(n.text)
        elif n.tag in INLINE:
            todo += n.children[::-1]
        else:
            # a block's start and end, and a line break, part what stands around them
            todo += [None, *n.children[::-1]]
            blocks.append([])
    done = (SPACE.sub(" ", entities.unescape("".join(b))).strip() for b in blocks if b)
    return " ".join(x for x in done if x)


def train(pages: list[tuple[str, str]], smooth: float = 0.5) -> TreeModel:
    """Fit on (html, mark) pairs: content is the text of elements that carry the attribute `mark`, and the
    elements that hold nothing but content."""
    seen = defaultdict(lambda: [0, 0])
    total = [0, 0]
    pairs = defaultdict(lambda: [[smooth, smooth], [smooth, smooth]])
    for page, mark in pages:
        nodes = parse(page)
        label: dict[int, int] = {}
        for n in nodes:
            if mark in n.names:
                label[id(n)] = 1
                n.names = tuple(x for x in n.names if x != mark)
            elif n.text is not None or n.tag in INLINE or n.tag in VOID or (n.parent is not None and label[id(n.parent)] and n.tag not in ("aside", "form", "nav", "section", "div", "ul", "footer", "header")):
                label[id(n)] = label[id(n.parent)]
            else:
                label[id(n)] = 0
        settle(nodes)
        for n in nodes:
            y = label[id(n)]
            total[y] += 1
            for f in features(n):
                seen[f][y] += 1
            if n.parent is not None:
                for tag in (n.tag, "*"):
                    pairs[tag][label[id(n.parent)]][y] += 1
    unary = {f: math.log((k[1] + smooth) / (total[1] + 2 * smooth)) - math.log((k[0] + smooth) / (total[0] + 2 * smooth)) for f, k in seen.items() if sum(k) >= 3}
    part = lambda row: tuple(math.log(v / sum(row)) for v in row)
    return TreeModel(unary, {t: (part(p[0]), part(p[1])) for t, p in pairs.items()})


def labelled_pages(n: int = 600, seed: int = 11) -> list[tuple[str, str]]:
    """Pages made from layout rules, their content elements carrying the class `gold`."""
    r = random.Random(seed)
    words = lambda a, b: " ".join("".join(r.choice("aeioulnrstdmc") for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b)))
    sent = lambda a=3, b=18: words(a, b).capitalize() + r.choice("...?!")
    para = lambda: " ".join(sent() for _ in range(r.randint(1, 5)))
    links = lambda k: "".join(f'<li><a href="/{words(1, 1)}">{words(1, 2)}</a></li>' for _ in range(k))

    def body_blocks() -> str:
        out = [f'<h1 class="gold">{words(3, 10).capitalize()}</h1>'] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 8)):
            k = r.random()
            if k < 0.62:
                out.append(f'<p class="gold">{para()}' + r.choice(["</p>", "</p>", "</p>", "", "<br>"]))
            elif k < 0.7:
                out.append(f'<p class="gold">{sent()} <a href="/x">{words(1, 3)}</a> <b>{words(1, 2)}</b> {sent()}</p>')
            elif k < 0.76:
                out.append(f'<{(h := r.choice(["h2", "h3"]))} class="gold">{words(1, 6).capitalize()}</{h}>')
            elif k < 0.82:
                out.append('<ul class="gold">' + "".join(f'<li class="gold">{sent()}</li>' for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.87:
                out.append(f'<blockquote class="gold"><p class="gold">{para()}</p></blockquote>')
            elif k < 0.9:
                out.append('<table class="gold"><tr class="gold">' + "".join(f'<td class="gold">{words(1, 4)}</td>' for _ in range(3)) + "</tr></table>")
            elif k < 0.93:
                out.append(f'<pre class="gold">{words(3, 20)}</pre>')
            elif k < 0.96:
                out.append(f'<aside class="{r.choice(["related", "pullout", "promo", "sidebar"])}"><p>{sent()}</p><ul>{links(3)}</ul></aside>')
            else:
                out.append(f'<div class="{r.choice(["ad", "advert", "ads banner", "sponsored", "share social", "newsletter"])}"><p>{sent()}</p></div>')
        return "".join(out)

    def comments() -> str:
        kind = r.choice(["comments", "comment list", "discussion", "responses", "reader comments"])
        tag = r.choice(["div", "section", "ol"])
        inner = "".join(f'<{(t := r.choice(["div", "article", "li"]))} class="comment"><p>{para()}</p></{t}>' for _ in range(r.randint(1, 4)))
        return f'<{tag} {r.choice(["class", "id"])}="{kind}"><h3>{words(1, 2)}</h3>{inner}</{tag}>'

    def page() -> str:
        out = [f'<html><head><title>{words(3, 8)}</title></head><body>']
        if r.random() < 0.4:
            out.append(f'<div class="{r.choice(["cookie notice", "cookie", "notice", "consent banner", "alert", "gdpr popup"])}">{sent()}' + r.choice(["<button>ok</button>", ""]) + "</div>")
        if r.random() < 0.5:
            out.append(f'<header{r.choice(["", " class=header", " id=masthead"])}><a href="/">{words(1, 2)}</a><p>{sent(2, 7)}</p></header>')
        out.append(r.choice([f"<nav><ul>{links(r.randint(3, 8))}</ul></nav>", f'<div class="{r.choice(["nav", "menu", "navbar", "breadcrumb"])}"><ul>{links(r.randint(3, 8))}</ul></div>', ""]))
        side = f'<{r.choice(["aside", "div class=sidebar", "div id=sidebar", "div class=widget"])}><h3>{words(1, 2)}</h3><p>{sent()}</p><ul>{links(4)}</ul>'
        side += "</aside>" if side.startswith("<aside") else "</div>"
        ad = f'<div class="{r.choice(["ad", "ads", "advert", "banner", "promo", "sponsor"])}">{para()}</div>'
        if r.random() < 0.4:
            out.append(ad)
        if r.random() < 0.3:
            out.append(side)
        tag, name = r.choice([("article", ""), ("article", ""), ("main", ""), ("div", "content"), ("div", "article body"), ("div", "post entry"), ("div", "main"), ("section", "story"), ("td", "")])
        inner = body_blocks()
        if r.random() < 0.3:
            inner += r.choice([comments(), side, ad, f'<footer><p>{sent()}</p></footer>'])
        out.append(f'<{tag} class="{name} gold">{inner}</{tag}>')
        if r.random() < 0.3:
            out.append(comments())
        if r.random() < 0.3:
            out.append(side)
        if r.random() < 0.25:
            out.append(f'<form class="{r.choice(["search", "subscribe", "login", "contact"])}"><p>{sent(2, 8)}</p><label>{words(1, 2)}</label><input><button>{words(1, 1)}</button></form>')
        out.append(r.choice([f"<footer>&copy; {words(1, 2)} &middot; {para()}</footer>", f'<div class="footer"><p>&copy; {words(2, 5)}</p></div>', f'<div id="footer legal"><p>{para()}</p></div>', ""]))
        return "".join(out) + r.choice(["</body></html>", ""])

    return [(page(), "gold") for _ in range(n)]


def extract(pages: DataFrame, model: TreeModel | None = None, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns `keep`, text, and n_chars (its code points)."""
    spark = pages.sparkSession
    small_batches(spark)
    fitted = model or train(labelled_pages())
    shared = spark.sparkContext.broadcast((fitted.unary, fitted.pair))
    src = pages.select(*[pages[c] for c in keep], pages[html].alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = TreeModel(*shared.value)
        for b in batches:
            got = [m.extract(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], [*b.schema.names[:-1], "text", "n_chars"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{head}, text string, n_chars bigint")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
