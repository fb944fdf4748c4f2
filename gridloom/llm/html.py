"""Operator 2: main text of web pages by consensus host paths.

Each page's containers are scored (their paragraphs' text, less what stands in links); every page casts
votes for the generalised tag-class paths of the articles around its containers; Spark adds the votes up
by host and picks each host's path; then every page is extracted again, at its host's path. A page
without that path, or with much less of its prose there than at its own best one, keeps its own. Pages
also vote on what belongs to the template: a block that stands in the same place with the same text on
most different articles of a host counts nothing when a page's best path is chosen. Nothing inside the
chosen container goes for that.

Text rules: blocks end at block-level tags; character references are decoded, white space in a block
becomes one space, empty blocks go, blocks are joined in page order by a line feed. Left out: scripts,
styles, forms, menus, footers, sidebars, adverts, notices and comments, by tag, role, class or id; a
header goes too, unless it stands in the article. A form that holds half of the page's prose is a
container like others.

Defined cases: a null or empty html gives an empty text; a null url, or one without `://`, has the
empty host, where pages vote too; pages that repeat are extracted alike and count as one article; markup
that isn't closed ends with the page, but a button, list of choices, drawing, title or the like that
isn't closed ends with the next block; a quote that isn't closed belongs to its tag; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small, tune
from .urls import host_of

#: A page keeps its host's path only if that holds this share of the prose at the page's own best path, at least.
COVER = 0.5
#: Other parts of a container count as the article's if they hold this share of its best part's prose.
NOTABLE = 0.25
#: A block of the template stands on this share of a host's different articles, and on so many, at least.
TEMPLATE_SHARE, TEMPLATE_LEAST = 0.5, 4
#: A form with this share of the page's prose is no form to fill in.
FORM_SHARE = 0.5
#: Tags that hold blocks and stay on the path; those that end a block, besides; those without content.
CONTAINERS = frozenset("html body main article section div aside nav header footer form table tbody thead tfoot tr td th ul ol dl figure fieldset details center".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre address figcaption caption summary legend hr".split())
IMPLIED = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "tbody": ("tbody", "thead"), "tfoot": ("tbody", "thead")}
#: Longer paths go by their digest.
PATH = 2000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP_TAGS = frozenset("nav aside footer form head menu dialog fieldset".split())
#: Tags whose text never counts: up to their end, which the next block brings at the latest; and those that hold no markup.
MUTE_TAGS = frozenset("button select svg object canvas audio video noscript template datalist label textarea title iframe".split())
RAW_TAGS = frozenset("script style textarea title iframe noembed noframes xmp".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of a class or id that mark what isn't the article, and words that may stand beside them.
SKIP_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer masthead sidebar aside widgets related recommended recommendations share sharing social comment comments disqus reply replies respond cookie cookies consent gdpr notice notices notification alert popup modal overlay subscribe subscription newsletter signup login toolbar pagination pager form copyright".split())
BESIDE_WORDS = frozenset("a area article bar block body bottom box btn button buttons center col column container content count desktop entry feed fixed floating footnote global group header icon icons id inline inner item items js large left legal link links list main mobile module more of on outer page pages panel placement post posts primary right row secondary section site slot small sticky the thread title tools top unit us widget wp wrap wrapper zone".split())
GOOD_WORDS = frozenset("article content post entry story main body text".split())
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^\"'>]*")
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role|style|aria-hidden|hidden)(?=[\s=>/]|\Z)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s\"'>]+))?", re.I)
_CLOSER = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW_TAGS}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = " \t\n\r\f"


class Node:
    __slots__ = ("tag", "path", "skip", "article", "own", "parent", "good", "form")

    def __init__(self, tag: str, path: str, skip: bool, article: bool, good: bool, parent, form=None):
        self.tag, self.path, self.skip, self.article, self.good, self.parent = tag, path, skip, article, good, parent
        self.form = form  # the outermost form around it, unless it is left out for other reasons
        self.own = 0.0


class _Page:
    """A reader of one page's markup. Every search goes on from where the last one ended, and one that found nothing is
    not tried again, so reading takes time in proportion to the page."""

    def __init__(self, page: str):
        self.page, self.n, self.lost = page, len(page), set()

    def find(self, what: str, at: int) -> int:
        """The place of what from at on, or -1."""
        if what in self.lost:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.lost.add(what)
        return k

    def tag_end(self, at: int) -> int:
        """The place of the `>` that ends a tag, outside quoted values; the page's end without one."""
        page = self.page
        while True:
            at = _PLAIN.match(page, at).end()
            if at >= self.n or page[at] == ">":
                return at
            before = at - 1
            while page[before] in _SPACE:
                before -= 1
            end = self.find(page[at], at + 1) if page[before] == "=" else -1
            at = end + 1 if end > 0 else at + 1

    def tags(self):
        """Yields (text before, tag name or None, whether it closes, its attributes)."""
        page, at = self.page, 0
        while True:
            lt = page.find("<", at)
            if lt < 0:
                yield page[at:], None, False, ""
                return
            m = _NAME.match(page, lt)
            if m is None:
                if page.startswith("<!--", lt):
                    end = self.find("-->", lt + 4)
                    end = end + 2 if end >= 0 else self.n
                elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
                    end = self.find(">", lt + 1)
                    end = end if end >= 0 else self.n
                else:  # a sign of the text
                    yield page[at : lt + 1], None, False, ""
                    at = lt + 1
                    continue
                yield page[at:lt], None, False, ""
                at = end + 1
                continue
            end = self.tag_end(m.end())
            name, closing = m.group(1).lower(), page[lt + 1] == "/"
            yield page[at:lt], name, closing, page[m.end() : end]
            at = end + 1
            if not closing and name in RAW_TAGS and not page[m.end() : end].endswith("/"):
                m = None if name in self.lost else _CLOSER[name].search(page, at)
                if m is not None:
                    at = m.start()
                else:
                    self.lost.add(name)
                    if name not in MUTE_TAGS:
                        return  # the rest is a script


def blocks(page: str):
    """(blocks, nodes): each block is (text, characters in links, its container), in page order."""
    root = Node("", "", False, False, False, None)
    stack, nodes, out = [root], [root], []
    text: list[str] = []
    linked: list[str] = []
    link = False
    mute, depth, mute_at = "", 0, root  # a tag within a container whose text is left out

    def flush():
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                out.append((whole, len(" ".join(entities.unescape("".join(linked)).split())) if linked else 0, stack[-1]))
            text.clear()
            linked.clear()

    for said, tag, closing, attributes in _Page(page).tags():
        if said and not mute:
            text.append(said)
            if link:
                linked.append(said)
        if tag is None:
            continue
        container, block = tag in CONTAINERS or tag in SKIP_TAGS, tag in BLOCKS
        if mute:
            if closing and tag == mute:
                depth -= 1
                mute = mute if depth else ""
            elif not closing and ((container or block) if mute not in BLOCKS or mute == "p" else tag == mute):
                mute = ""
            elif not closing and tag == mute and not attributes.endswith("/"):
                depth += 1
        if container:
            flush()
            link = False
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                if mute and mute_at not in stack:
                    mute = ""
            elif not attributes.rstrip().endswith("/") or tag in ("div", "section", "article"):
                for k in range(len(stack) - 1, 0, -1) if tag in IMPLIED else ():  # a cell or row ends the one before
                    if stack[k].tag in IMPLIED[tag]:
                        del stack[k:]
                        break
                    if stack[k].tag == "table":
                        break
                stack.append(_node(tag, attributes, stack[-1]))
                nodes.append(stack[-1])
        elif block:
            flush()
            link = False
        elif tag == "a":
            link = not closing
        elif tag == "br" and not mute:
            text.append(" ")
        if not mute and not closing and not container and tag not in VOID and not attributes.endswith("/") and (tag in MUTE_TAGS or (attributes and _marks(attributes)[0])):
            mute, depth, mute_at = tag, 1, stack[-1]
    flush()
    _open_forms(out, nodes)
    return out, nodes


def _open_forms(found, nodes) -> None:
    """Leaves out what stands in forms, unless a form holds most of the page's prose."""
    prose: dict[Node | None, float] = defaultdict(float)
    for text, linked, node in found:
        prose[node.form] += _gain(text, linked, node)
    if len(prose) > (None in prose):
        total = sum(prose.values())
        for n in nodes:
            n.skip = n.skip or (n.form is not None and not (prose[n.form] > 0 and prose[n.form] >= FORM_SHARE * total))


def skip_word(token: str) -> bool:
    """Whether a class or id is made of words that mark other things than the article, and of words that stand beside them."""
    parts = {w for p in _PARTS.findall(token) for w in _compound(p.lower())}
    whole = re.sub(r"[^a-z]+", "", token.lower())
    return whole in SKIP_WORDS or bool(parts & SKIP_WORDS and parts <= SKIP_WORDS | BESIDE_WORDS)


def _compound(word: str) -> tuple[str, ...]:
    """A word made of a marking word and one that stands beside it, such as commentlist, as both; others as they are."""
    for k in range(5, len(word) - 1):
        if word[:k] in SKIP_WORDS and word[k:] in BESIDE_WORDS:
            return word[:k], word[k:]
    return (word,)


def _marks(attributes: str) -> tuple[bool, bool, bool, list[str]]:
    """(skip, header, good, classes) by role, style, class and id."""
    skip = header = good = False
    classes: list[str] = []
    for name, value in _ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            tokens = value.split()
            skip = skip or any(map(skip_word, tokens))
            words = {w for t in tokens for w in re.split(r"[^a-z]+", t.lower())}
            header, good = header or "header" in words, good or bool(words & GOOD_WORDS)
            if name == "class":
                classes += [t.lower() for t in tokens]
        elif name == "role":
            skip = skip or value.lower() in SKIP_ROLES
        elif name == "style":
            style = value.lower().replace(" ", "")
            skip = skip or "display:none" in style or "visibility:hidden" in style
        else:
            skip = skip or name == "hidden" or value.lower() == "true"
    return skip, header, good, classes


def _node(tag: str, attributes: str, parent: Node) -> Node:
    skip, header, good, classes = _marks(attributes) if attributes else (False, False, False, [])
    article = parent.article or tag in ("article", "main")
    if tag in ("html", "body", "article", "main"):
        skip = False
    if tag == "form":  # ids such as form1 say nothing of it
        skip = skip and _marks(re.sub(r"(?i)form", "", attributes))[0]
    skip = skip or parent.skip or (tag in SKIP_TAGS and tag != "form") or ((tag == "header" or header) and not article)
    kinds = sorted({re.sub(r"\d+", "", c) for c in classes} - {""})
    path = f"{parent.path}>{'.'.join([tag, *kinds])}"
    if len(path) > PATH:
        path = "#" + hashlib.blake2b(path.encode("utf-8", "replace"), digest_size=16).hexdigest()
    node = Node(tag, path, skip, article, tag in ("article", "main") or good, parent)
    node.form = None if skip else parent.form or (node if tag == "form" else None)
    return node


def container_scores(page: str) -> dict[str, float]:
    """Score of each generalised path: a container's own text less its links' counts whole, and half for the container around it."""
    return _scores(blocks(page)[0])


def _gain(text: str, linked: int, node: Node) -> float:
    return 0.0 if node.skip else max(0.0, len(text) - 2.0 * linked)


def _scores(found) -> dict[str, float]:
    score: dict[Node, float] = defaultdict(float)
    for text, linked, node in found:
        if not node.skip:
            gain = _gain(text, linked, node)
            score[node] += gain
            if node.parent is not None:
                score[node.parent] += gain / 2
    paths: dict[str, float] = defaultdict(float)
    for node, s in score.items():
        if s > 0:
            paths[node.path] += s * (1.5 if node.good else 1.0)
    return paths


def _prose(found, nodes) -> tuple[dict[Node, float], dict[Node, float]]:
    """Unskipped prose of each container: its own, and with all that stands below it."""
    own = dict.fromkeys(nodes, 0.0)
    for text, linked, node in found:
        own[node] += _gain(text, linked, node)
    whole = dict(own)
    for n in reversed(nodes):  # a parent stands before its children
        if n.parent is not None:
            whole[n.parent] += whole[n]
    return own, whole


def article_paths(found, nodes, most: int | None = None) -> dict[str, float]:
    """The page's best paths, at most so many (all by default), each climbed to the article around it, with their shares of the page's score.

    That is the enclosing article or main; without one, the outermost container below the body that adds prose
    as a good container, by blocks of its own (a heading, a lead), or by other parts of a notable size.
    """
    scores = _scores(found)
    own, whole = _prose(found, nodes)
    total = sum(scores.values())
    largest: dict[str, Node] = {}
    for n in nodes:
        if not n.skip and (n.path not in largest or whole[n] > whole[largest[n.path]]):
            largest[n.path] = n
    out: dict[str, float] = defaultdict(float)
    tops: dict[Node, Node] = {}
    for path, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:most]:
        out[_top(largest[path], own, whole, tops).path] += s / total
    return out


def _top(node: Node, own: dict[Node, float], whole: dict[Node, float], known: dict[Node, Node]) -> Node:
    """The article around a container; known: those found before, by container."""
    passed = [node]
    if node.article:
        top = node
        while top.tag not in ("article", "main"):
            top = top.parent
            if top in known:
                top = known[top]
                break
            passed.append(top)
    else:
        top, at = node, node.parent
        while top not in known and at is not None and at.tag not in ("", "html", "body"):
            more = whole[at] - whole[top]
            if more > 0 and (at.good or own[at] > 0 or more >= NOTABLE * whole[top]):
                top = at
                passed.append(top)
            at = at.parent
        top = known.get(top, top)
    for n in passed:
        known[n] = top
    return top


def block_digest(text: str, node: Node) -> int:
    """Of a block and where it stands, in 63 bits."""
    return int.from_bytes(hashlib.blake2b(f"{node.path}\n{text}".encode("utf-8", "replace"), digest_size=8).digest(), "big") >> 1


def article_digest(found) -> int:
    """Of the page's longest block, by which different articles of a host are told apart; 0 without blocks."""
    longest = max((t for t, _, n in found if not n.skip), key=lambda t: (len(t), t), default="")
    return int.from_bytes(hashlib.blake2b(longest.encode("utf-8", "replace"), digest_size=8).digest(), "big") >> 1 if longest else 0


def extract(page: str, path: str | None, template: frozenset[int] = frozenset()) -> str:
    """The text at the path, or at the page's own best one if the path is absent or holds much less of the page's prose.

    template: digests of blocks that count nothing in this choice; where all blocks are such, they count.
    """
    found, nodes = blocks(page)

    def inside(p: str) -> set[Node]:
        out: set[Node] = set()
        for n in nodes:
            if n.path == p or n.parent in out:
                out.add(n)
        return out

    counted = [f for f in found if block_digest(f[0], f[2]) not in template] or found if template else found
    prose = lambda held: sum(_gain(*f) for f in counted if f[2] in held)
    mine = article_paths(counted, nodes, 1) or article_paths(found, nodes, 1)
    own = inside(next(iter(mine))) if mine else set()
    given = inside(path) if path is not None and any(n.path == path and not n.skip for n in nodes) else set()
    held = given if given and prose(given) >= COVER * prose(own) else own
    return "\n".join(t for t, _, n in found if n in held and not n.skip)


def host_votes(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((host, path), (host, template)): the winning path of each host (of most votes, then the first in code-point order),
    and the digests of its template's blocks. Both come from one reading of the pages, which is cut."""
    tune(pages.sparkSession)

    def vote(batches):
        for batch in batches:
            votes: dict[tuple[str, str], float] = defaultdict(float)
            rows = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, nodes = blocks(page or "")
                for p, share in article_paths(found, nodes).items():
                    votes[host, p] += share
                article = article_digest(found)
                if article:
                    rows.append((host, None, None, -1, article))
                    rows += [(host, None, None, d, article) for d in {block_digest(t, n) for t, _, n in found if not n.skip}]
            rows += [(host, p, v, None, None) for (host, p), v in votes.items()]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["host", "path", "share", "block", "article"])

    cast = cut(pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path string, share double, block long, article long").groupBy("host", "path", "block").agg(F.sum("share").alias("share"), F.approx_count_distinct("article", 0.02).alias("articles"), F.min("article").alias("low"), F.max("article").alias("high")))
    paths = cast.where("path IS NOT NULL").select("host", "path", F.round("share", 6).alias("votes")).groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("path"))
    all_ = cast.where("block = -1").select("host", F.col("articles").alias("of"))
    often = cast.where((F.col("block") >= 0) & (F.col("articles") >= TEMPLATE_LEAST) & (F.col("low") < F.col("high"))).join(all_, "host").where(F.col("articles") >= TEMPLATE_SHARE * F.col("of"))
    return paths, often.groupBy("host").agg(F.sort_array(F.collect_set("block")).alias("template"))


def main_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) to (page_id, url, text, n_chars, path)."""
    paths, templates = host_votes(pages)
    winners = cut(paths.join(templates, "host", "left"))
    placed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(small(winners), "host", "left").select("page_id", "url", "html", "path", "template")

    def run(batches):
        for batch in batches:
            texts = [extract(h or "", p, frozenset(t or ())) for h, p, t in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(3)], names=["page_id", "url", "text", "n_chars", "path"])

    return placed.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, path string")
