"""Main-text extraction by wrapper induction (operator 7).

Each page is parsed into a tree and reduced to its skeleton: a node per tag
path, siblings of one label merged, with a hash of the text.  A host's pages
are grouped by layout, the labels at the first level with several elements.
A layout with its share of the host's pages has a reference page of its own,
all others take that of the host's most frequent layout, and the pages are
aligned to their reference by simple tree matching.  Counted over all pages
that differ from the reference, near copies with equal main texts once, nodes whose text stays the
same become template, unless they lie in the main slot: the smallest container
of all other text.  A page's text is read from its article (or main) element,
else from its body, without the elements that markup itself declares to be
something else (menus, headers, footers, asides, forms, adverts, notices,
comments, scripts), and, outside an article element, without the blocks whose
text on this page is the template's.  A form or a class word declares that only
where the structure agrees: not on what holds the main element or, without one,
the title or most of the prose, not on headings, and within the main element
only where the whole class name says so.

The reference of a layout is a grouped minimum and the counts are grouped sums,
so both are combined before the shuffle; the joins by host are plain equi-joins
whose hot partitions adaptive execution splits.

Defined cases: null or empty html gives an empty text; a null or odd url, or a
host with a single page, has no wrapper and is read by markup alone; repeated
rows give the same text and are no evidence for a template; an empty table
gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import stored

EVIDENCE = 4       # differing pages that must hold a node before it counts as template
CONSTANT = 0.9     # share of them with the same text
SHARE = 20         # a layout of its own has at least one of so many of its host's pages
HEAVY = 0.5        # of a page's longest text: what its other main texts have at least
ROWS = 256

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
                   r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")

# Fixed values of HTML: elements without content, with raw text, that start a
# block, and those that an opening tag closes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg xmp noembed noframes".split())
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td
tfoot th thead tr ul caption""".split())
# Elements that may be the main slot (a cell if it holds blocks), and those it may lie in.
HOLDS = set("html body main article section div center".split())
CELLS = set("table tbody tr td".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"},
         "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}}
# Elements, roles and class words that are never the article.
ASIDE = RAW | set("nav footer aside button select menu dialog head input label".split())
ROLES = set("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar".split())
WORDS = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar menu nav navbar navigation
breadcrumb breadcrumbs footer cookie cookies consent notice popup modal newsletter subscribe share sharing social
comment comments disqus respond related recommended pagination pager""".split())
LAYOUT = set("sidebar menu nav navbar navigation footer related recommended".split())   # words that wrappers carry too
READERS = set("comment comments disqus respond".split())
# Words that say nothing beside those in a class name.
HELPERS = set("""area bar banner block body bottom box btn button buttons col column container content count desktop
fixed form global group header heading icon icons inner item items left link links list local main meta mobile outer
page panel post posts primary reply replies right row secondary section signup site slot sticky sub text thread title
toggle top unit widget widgets wrap wrapper""".split())
CONTAINERS = set("div section ul ol dl table tbody tr td span figure li a center details p form".split())
TEASERS = set("teaser teasers card preview excerpt".split())
HEADS = set("h1 h2 h3 h4 h5 h6".split())
PAGE_HEADER = {"header", "site-header", "page-header", "masthead", "topbar"}


class Node:
    """An element: its label, its children (elements and text) and what markup says of it."""

    __slots__ = ("tag", "label", "kids", "aside", "soft", "words", "main", "header", "banner", "other")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.kids = tag, []
        name = role = ident = ""
        hidden, main = False, tag in ("article", "main")
        for k, a, b, c, flag in ATTR.findall(attrs):
            k, v = (k or flag).lower(), a or b or c
            if k == "class":
                name = v.lower()
            elif k == "id":
                ident = v.lower()
            elif k == "role":
                role = v.lower()
            elif k == "itemprop":
                main = main or v.lower() == "articlebody"
            elif k == "hidden" or k == "aria-hidden" and v.lower() == "true":
                hidden = True
        names = [_words(n) for n in name.split()]
        told = [n for n in names if _says(n, WORDS)]
        self.header = tag == "header" or bool(PAGE_HEADER & {*name.split(), ident}) or role == "banner"
        self.banner = role == "banner"
        self.main = main or role in ("main", "article")
        # of an article: a comment or teaser
        self.other = any(_says(n, WORDS | TEASERS) for n in [*names, _words(ident)])
        self.aside = tag not in ("html", "body") and (tag in ASIDE or hidden or role in ROLES)
        # what the structure must agree with: "name", "id", "part" of a name, "form", from strong to weak
        self.soft, self.words = "", set().union(*told)
        if tag in CONTAINERS and not self.main and not self.aside:
            if told and (tag != "p" or len(names) == 1):
                self.soft = "name"
            elif tag != "p" and _says(_words(ident), WORDS):
                self.soft, self.words = "id", _words(ident)
            elif tag == "form" or role == "form":
                self.soft = "form"
            elif tag != "p" and any(WORDS & n for n in names):
                self.soft = "part"
        kind = re.sub(r"\d+", "", " ".join(sorted(name.split())[:2]) + ("#" + ident if ident else ""))
        self.label = f"{tag} {kind}".strip()


def _words(name: str) -> set[str]:
    return {w for w in re.split(r"[\s_\d-]+", name) if w}


def _says(words: set[str], known: set[str]) -> bool:
    """Whether a name says one of the known words and nothing else."""
    return bool(words & known) and words <= known | HELPERS


def parse(html: str) -> Node:
    """A forgiving parse: raw elements, void elements and implied end tags are known."""
    root = Node("html")
    stack, at = [root], 0
    while m := TOKEN.match(html, at):
        at, word = m.end(), m[0]
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if word[0] != "<" or word == "<":
                stack[-1].kids.append(entities.unescape(word))
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag == "html":
            continue
        if tag in BLOCK:
            _close(stack, {"p"}, {"button", "td", "th", "table", "li", "div", "article", "section", "blockquote"})
        if tag in CLOSES:
            _close(stack, CLOSES[tag], SCOPE[tag])
        node = Node(tag, m[3] or m[6] or "")
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not word.endswith("/>"):
            stack.append(node)
    _settle(root)
    return root


def _settle(root: Node) -> None:
    """Decides by structure which forms and class words make asides, and which headers are the content's."""
    order, up, todo = [], {}, [root]
    while todo:                                  # page order, without what is an aside anyway
        node = todo.pop()
        order.append(node)
        for k in reversed(node.kids):
            if isinstance(k, Node) and not k.aside:
                up[id(k)] = node
                todo.append(k)
    prose, title, blocks = {}, {}, {}            # characters outside links; holds an h1; holds a paragraph or heading
    for node in reversed(order):
        inner = [k for k in node.kids if isinstance(k, Node) and not k.aside]
        own = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        prose[id(node)] = 0 if node.tag == "a" else own + sum(prose[id(k)] for k in inner)
        title[id(node)] = node.tag == "h1" or any(title[id(k)] for k in inner)
        blocks[id(node)] = node.tag == "p" and own > 0 or node.tag in HEADS or any(blocks[id(k)] for k in inner)

    def softs(node):
        out = []
        while node is not None:
            if node.soft:
                out.append(node)
            node = up.get(id(node))
        return out

    def within(node):
        while (node := up.get(id(node))) is not None:
            if node.main and not node.other:
                return True
        return False

    mains = sorted((n for n in order if n.main and not n.other and prose[id(n)]), key=lambda n: -prose[id(n)])
    if mains:                                    # open what holds them, from outside, until one stands free
        while all(softs(m) for m in mains):
            softs(mains[0])[-1].soft = ""
    for node in order:
        if not node.soft:
            continue
        node.aside = True
        if within(node):
            node.aside = node.soft in ("name", "form") or node.soft == "id" and bool(node.words & READERS)
        elif not mains and 2 * prose[id(node)] >= prose[id(root)] and blocks[id(node)]:
            node.aside = node.soft in ("name", "id") and not node.words & LAYOUT and not title[id(node)]

    heads = {id(n): n for n in order if n.header and not n.banner and n is not root}
    free = any(n.tag == "h1" and not _below(n, heads, up) for n in order)
    for node in heads.values():
        beside = [k for k in up[id(node)].kids if isinstance(k, Node) and k is not node]
        held, todo = {node.tag}, [node]
        while todo:
            for k in todo.pop().kids:
                if isinstance(k, Node):
                    held.add(k.tag)
                    todo.append(k)
        text = any(k.tag == "p" for k in beside) or up[id(node)].tag not in ("html", "body") and not any(
            k.tag in ("nav", "footer", "aside") or k.header for k in beside) and any(
            isinstance(x, Node) and x.tag == "p" for k in beside for x in k.kids)
        if held & HEADS and "nav" not in held and text and not free:
            node.header = False


def _below(node: Node, heads: dict[int, Node], up: dict[int, Node]) -> bool:
    while node is not None:
        if id(node) in heads:
            return True
        node = up.get(id(node))
    return False


def _close(stack: list[Node], tags: set[str], scope: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in scope:
            return


# --------------------------------------------------------------- skeletons

class Bone:
    """A skeleton node: own text and link text lengths, its text's hash, children by label."""

    __slots__ = ("label", "kids", "text", "links", "aside")

    def __init__(self, label: str, aside: bool = False):
        self.label, self.kids, self.text, self.links, self.aside = label, {}, [], 0, aside


def skeleton(root: Node) -> Bone:
    """Same-label siblings merged, so its size follows the markup and not the page's length."""
    top = Bone(root.label)
    todo = [(root, top, False)]
    while todo:
        node, bone, link = todo.pop()
        for kid in node.kids:
            if isinstance(kid, str):
                text = " ".join(kid.split())
                if text:
                    bone.text.append(text)
                    bone.links += len(text) if link else 0
            elif kid.tag not in RAW:
                sub = bone.kids.get(kid.label)
                if sub is None:
                    sub = bone.kids[kid.label] = Bone(kid.label, bone.aside or kid.aside or kid.header)
                todo.append((kid, sub, link or kid.tag == "a"))
    return top


def flat(bone: Bone) -> list[list]:
    """Preorder rows [depth, label, text hash, text length, link length, aside]."""
    out, todo = [], [(0, bone)]
    while todo:
        depth, b = todo.pop()
        text = "\n".join(b.text)
        mark = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() if text else ""
        out.append([depth, b.label, mark, len(text), b.links, int(b.aside)])
        todo += [(depth + 1, k) for k in reversed(b.kids.values())]
    return out


def tree(rows: list[list]) -> list[list[int]]:
    """Children's places of each row of :func:`flat`."""
    kids, path = [[] for _ in rows], []
    for i, r in enumerate(rows):
        del path[r[0]:]
        if path:
            kids[path[-1]].append(i)
        path.append(i)
    return kids


def match(a: list[list], b: list[list]) -> dict[int, int]:
    """Simple tree matching of two skeletons: places of ``a`` to places of ``b``.

    A pair of equal labels scores one plus the best order-keeping matching of
    its children, found by dynamic programming over both child lists.
    """
    ka, kb = tree(a), tree(b)
    best: dict[tuple[int, int], tuple[int, list]] = {}
    todo = [(0, 0, False)]
    while todo:
        i, j, ready = todo.pop()
        if (i, j) in best:
            continue
        pairs = [(x, y) for x in ka[i] for y in kb[j] if a[x][1] == b[y][1]]
        if not ready:
            todo.append((i, j, True))
            todo += [(x, y, False) for x, y in pairs]
            continue
        score = [[0] * (len(kb[j]) + 1) for _ in range(len(ka[i]) + 1)]
        for p, x in enumerate(ka[i]):
            for q, y in enumerate(kb[j]):
                take = score[p][q] + best[(x, y)][0] if a[x][1] == b[y][1] else 0
                score[p + 1][q + 1] = max(score[p][q + 1], score[p + 1][q], take)
        p, q, chosen = len(ka[i]), len(kb[j]), []
        while p and q:
            if score[p][q] == score[p - 1][q]:
                p -= 1
            elif score[p][q] == score[p][q - 1]:
                q -= 1
            else:
                p, q = p - 1, q - 1
                chosen.append((ka[i][p], kb[j][q]))
        best[(i, j)] = 1 + score[-1][-1], chosen
    out, todo2 = {}, [(0, 0)] if a and b and a[0][1] == b[0][1] else []
    while todo2:
        i, j = todo2.pop()
        out[i] = j
        todo2 += best[(i, j)][1]
    return out


def frame(rows: list[list]) -> str:
    """The page's layout: a mark of the labels at the first level with several elements, ids left out."""
    kids, at = tree(rows), 0
    while len(kids[at]) == 1:
        at = kids[at][0]
    told = [rows[at][1], *[rows[k][1] for k in kids[at]]]
    return hashlib.blake2b("\n".join(t.split("#")[0].strip() for t in told).encode("utf-8", "surrogatepass"),
                           digest_size=8).hexdigest()


def strange(page: list[list], found: dict[int, int]) -> dict[int, int]:
    """Length of the page's text outside asides that no reference node matches, by the place of what holds it."""
    out, path = {}, []
    for j, r in enumerate(page):
        del path[r[0]:]
        path.append(found.get(j, path[-1] if path else None))
        if j not in found and r[3] and not r[5] and path[-1] is not None:
            out[path[-1]] = out.get(path[-1], 0) + r[3]
    return out


def main_text(page: list[list]) -> str:
    """A mark of the page's long texts that are no links, equal for near copies."""
    size = [0 if r[5] else r[3] - 2 * r[4] for r in page]
    top = max(size)
    return " ".join(r[2] for r, n in zip(page, size) if n > 0 and n >= HEAVY * top)


def template_places(rows: list[list], kids: list[list[int]], votes: dict) -> list[int]:
    """Places of the reference whose text is template.

    The main slot is the smallest container of all text that is neither
    constant nor aside.  Constant text in it is the content's own (headings
    that all articles share).  Where it holds all the constant text too, it is
    the page as a whole, and what is constant is template in blocks before the
    first or after the last part with other text, and in inner containers
    without such text.
    """
    constant = {i for i, v in votes.items() if rows[i][2] and v["n"] >= EVIDENCE and v["same"] >= CONSTANT * v["n"]}
    own = [bool(i in votes and votes[i]["other"] or i not in constant and (
        r[3] and not r[5] or i in votes and votes[i]["varying"])) for i, r in enumerate(rows)]
    live = list(own)
    for i in range(len(rows) - 1, -1, -1):
        live[i] = live[i] or any(live[k] for k in kids[i])
    if not live[0]:
        return []

    def tag(i):
        return rows[i][1].split(" ")[0]

    at = main = 0
    while not own[at]:
        inner = [k for k in kids[at] if live[k]]
        if len(inner) != 1 or tag(inner[0]) not in HOLDS | CELLS:
            break
        at = inner[0]
        if tag(at) in HOLDS or tag(at) == "td" and any(tag(k) in BLOCK for k in kids[at]):
            main = at

    def below(i):
        end = i + 1
        while end < len(rows) and rows[end][0] > rows[i][0]:
            end += 1
        return set(range(i, end))

    slot = below(main)
    if not any(not rows[i][5] for i in constant - slot):
        order = [k for k in kids[main] if live[k]]
        edge = [k for k in kids[main] if order and not order[0] <= k <= order[-1] and tag(k) in BLOCK]
        for i in edge + [i for i in slot if not live[i] and tag(i) in HOLDS]:
            slot -= below(i)
    return sorted(constant - slot)


# ----------------------------------------------------------------- reading

def read_text(root: Node, layouts: dict) -> str:
    """The page's text without its template's; ``layouts`` as :func:`induce` makes them."""
    drop, top = set(), skeleton(root)
    if layouts:
        rows, order, todo = flat(top), [], [top]
        template, constant = layouts.get(frame(rows)) or layouts.get("") or ([], [])
        while todo:
            b = todo.pop()
            order.append(b)
            todo += reversed(b.kids.values())
        found = match(template, rows) if constant else {}
        drop = _equal_blocks(top, {id(order[found[i]]) for i in constant
                                   if i in found and rows[found[i]][2] == template[i][2]})
    # the markup's own article, in all its parts
    found, todo = [], [(root, top, None, None, None)]     # in page order: node, bone, parent, main element, article
    while todo:
        node, bone, _, within, owner = item = todo.pop()
        found.append(item)
        if node.tag == "article":
            owner = node
        elif node.main:
            within = node
        todo += [(k, bone.kids[k.label], node, within, owner) for k in reversed(node.kids)
                 if isinstance(k, Node) and k.tag not in RAW and not k.aside]
    mains = [x for x in found if x[0].main]
    if mains:
        inner = [m for m in mains if m[0].tag == "article"]
        inner = [m for m in inner if not m[0].other] or inner or mains
        best = max(inner, key=lambda m: _length(m[0]))
        start = [best[:2]]
        if best[0].tag == "article" and not best[0].other:
            parts = [m for m in inner if m is best or m[2] is best[2] and not m[0].other and not _linked(m[0])]
            first = next(i for i, x in enumerate(found) if x is parts[0])
            start = [x[:2] for x in found[:first] if best[3] is not None and x[3] is best[3] and x[4] is best[4]
                     and x[0].tag in HEADS] + [m[:2] for m in parts]
    else:
        start = [(root, top)]
    blocks: list[str] = []
    for node, bone in start:
        _blocks(node, bone, drop if node.tag in ("main", "html") else set(), bool(mains), blocks)
    return "\n".join(blocks)


def _linked(article: Node) -> bool:
    """Whether the article's first heading is a link: a teaser of another page."""
    todo = [(article, False)]
    while todo:
        node, link = todo.pop()
        if node.tag in HEADS:
            inner = [k for k in node.kids if not isinstance(k, str) or k.strip()]
            return link or bool(inner) and all(isinstance(k, Node) and k.tag == "a" for k in inner)
        todo += [(k, link or k.tag == "a") for k in reversed(node.kids) if isinstance(k, Node)]
    return False


def _equal_blocks(top: Bone, equal: set[int]) -> set[int]:
    """The bones of blocks whose text, with that of their inline elements, all is in ``equal``."""
    blocks, todo = {}, [(top, top)]
    while todo:
        bone, block = todo.pop()
        blocks.setdefault(id(block), []).append(bone)
        todo += [(k, k if k.label.split(" ")[0] in BLOCK else block) for k in bone.kids.values()]
    return {id(b) for part in blocks.values() if all(id(b) in equal or not b.text or b.aside for b in part)
            for b in part}


def _length(node: Node) -> int:
    n, todo = 0, [node]
    while todo:
        for k in todo.pop().kids:
            if isinstance(k, str):
                n += len(k)
            elif not k.aside:
                todo.append(k)
    return n


def _blocks(start: Node, bone: Bone, drop: set[int], inside: bool, out: list[str]) -> None:
    """Blocks in page order: references decoded, white space made one blank, trimmed."""
    held: list[str] = []

    def flush():
        text = " ".join("".join(held).split())
        if text:
            out.append(text)
        held.clear()

    todo: list = [(start, bone)]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
            continue
        node, b = item
        if isinstance(node, str):
            held.append(node)
            continue
        if node is not start and (node.aside or node.header and not inside):
            if node.tag in BLOCK:
                flush()
            continue
        if node.tag == "br":
            held.append("\n")
            continue
        block = node.tag in BLOCK
        if block:
            flush()
            todo.append(None)
        for k in reversed(node.kids):
            if isinstance(k, str):
                if id(b) not in drop:
                    todo.append((k, None))
            elif k.tag not in RAW:
                todo.append((k, b.kids[k.label]))
    flush()


# --------------------------------------------------------------- operators

def _host(col: str):
    host = F.lower(F.regexp_extract(F.col(col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    return F.when(host != "", host)


def induce(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): by layout, the reference skeleton and its template nodes, as compressed JSON.

    The layout "" is for pages whose own layout has no reference.  A host has at
    most ``SHARE`` layouts besides.
    """
    src = pages.where(_host(url_col).isNotNull()).select(
        _host(url_col).alias("host"), F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    kind = src.schema["id"].dataType.simpleString()

    def bones(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                rows = [flat(skeleton(parse(h or ""))) for h in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array([frame(r) for r in rows]),
                                       pa.array([main_text(r) for r in rows]),
                                       pa.array([json.dumps(r) for r in rows])], ["host", "id", "frame", "main", "skel"])

    skels = stored(src.mapInArrow(bones, f"host string, id {kind}, frame string, main string, skel string"),
                   "skeletons")
    # copies count once, here and as voters
    sizes = skels.groupBy("host", "frame", "main").agg(F.count("*").alias("rows")).groupBy("host", "frame").agg(
        F.count("*").alias("n"), F.sum("rows").alias("rows"))
    hosts = sizes.groupBy("host").agg(F.sum("n").alias("all"), F.sum("rows").alias("rows"),
                                      F.max(F.struct("n", "frame")).alias("top")).where("rows > 1")
    layouts = stored(sizes.drop("rows").join(hosts, "host").select(
        "host", "frame", (F.col("n") * 2 >= F.col("all")).alias("most"),
        F.when((F.col("n") > EVIDENCE) & (F.col("n") * SHARE >= F.col("all")), F.col("frame"))
        .otherwise(F.col("top.frame")).alias("layout"), F.col("top.frame").alias("common"), "n", "all"), "layouts")
    # a layout that most pages have is judged by its own pages, else a host's other pages help the common one
    big = layouts.where("frame = common").select("host", (F.col("most") & (F.col("n") > EVIDENCE)).alias("alone"))
    placed = skels.join(layouts.select("host", "frame", "layout", "common"), ["host", "frame"])
    refs = placed.where("frame = layout").groupBy("host", "layout").agg(F.min(F.struct("id", "skel")).alias("r"),
                                                                        F.first("common").alias("common")) \
        .select("host", "layout", F.col("r.skel").alias("ref"), (F.col("common") == F.col("layout")).alias("common"))
    voters = (placed.join(big, "host").where("frame = layout or not alone")
              .groupBy("host", "layout", "main").agg(F.min(F.struct("id", "skel")).alias("r"))
              .select("host", "layout", F.col("r.skel").alias("skel")))

    def align(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                cols: list[list] = [[] for _ in range(6)]
                for host, layout, skel, ref in zip(*[batch.slice(k, ROWS).column(c).to_pylist() for c in range(4)]):
                    a, b = json.loads(ref), json.loads(skel)
                    if [r[2] for r in a] == [r[2] for r in b]:
                        continue                      # the same page again says nothing
                    found = match(a, b)
                    other = strange(b, {j: i for i, j in found.items()})
                    for i, j in found.items():
                        same = a[i][2] == b[j][2]
                        for c, v in zip(cols, (host, layout, i, int(same), 0 if same or b[j][5] else b[j][3],
                                               other.get(i, 0))):
                            c.append(v)
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)],
                                      ["host", "layout", "place", "same", "varying", "other"])

    votes = (voters.join(refs, ["host", "layout"]).select("host", "layout", "skel", "ref")
             .mapInArrow(align, "host string, layout string, place int, same long, varying long, other long")
             .groupBy("host", "layout", "place").agg(
                 F.count("*").alias("n"), F.sum("same").alias("same"), F.sum("varying").alias("varying"),
                 F.sum("other").alias("other"))
             .groupBy("host", "layout").agg(
                 F.collect_list(F.struct("place", "n", "same", "varying", "other")).alias("votes")))

    def settle(batches):
        for batch in batches:
            out = []
            for layout, ref, common, votes in zip(*[batch.column(c).to_pylist() for c in range(1, 5)]):
                rows = json.loads(ref)
                places = template_places(rows, tree(rows), {v["place"]: v for v in votes})
                slim = [[r[0], r[1], r[2] if i in places else ""] for i, r in enumerate(rows)]
                out.append(json.dumps([layout, common, slim, places]))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], ["host", "part"])

    def gather(batches):
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                told = {}
                for layout, common, rows, places in sorted(json.loads(p) for p in parts):
                    told[layout] = rows, places
                    if common:
                        told[""] = rows, places
                out.append(zlib.compress(json.dumps(told).encode()))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["host", "wrapper"])

    return (refs.join(votes, ["host", "layout"]).select("host", "layout", "ref", "common", "votes")
            .mapInArrow(settle, "host string, part string")
            .groupBy("host").agg(F.collect_list("part").alias("parts"))      # at most SHARE + 1
            .mapInArrow(gather, "host string, wrapper binary"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page."""
    wrappers = stored(induce(pages, id_col, url_col, html_col), "wrappers")
    src = pages.select(_host(url_col).alias("host"), F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                       F.col(html_col).alias("html"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        memo: dict = {}
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part, texts = batch.slice(k, ROWS), []
                for page, wrapper in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if wrapper not in memo:
                        memo.clear()
                        memo[wrapper] = json.loads(zlib.decompress(wrapper)) if wrapper else {}
                    texts.append(read_text(parse(page), memo[wrapper]) if page else "")
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string())],
                                      ["id", "url", "text"])

    return (src.join(wrappers, "host", "left").select("id", "url", "html", "wrapper")
            .mapInArrow(run, f"id {kind}, url string, text string"))
