"""Main text of web pages, with removal of subtrees that a site repeats.

Pages are parsed twice. The first pass hashes the element subtrees left after structural
removal (menus, forms, adverts, scripts, comments and the like) and Spark counts, for each
host, the pages that hold each subtree. The second pass also deletes subtrees found on at
least ``SHARE`` of the host's pages (and on ``LEAST`` pages), then joins the blocks. A
template surrounds different texts: a subtree whose pages hold fewer than ``TEXTS`` different
main texts belongs to copies of an article and stays, whatever share of a page it is.

Per host at most 1 / SHARE subtrees a page's worth qualify, so a host's list is small; the
join on host is left to the planner (broadcast by measured size, else a skew-split join).

Defined results: a null html has empty text; a null or unreadable url belongs to the host
''; a null id is carried; repeated rows give repeated results; an empty table gives an empty result;
long pages are worked on whole; unclosed and crossed tags are closed as browsers close them; only id,
url and html are read, so no other column can clash.
"""

from __future__ import annotations

import functools
import html as _html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

SHARE, LEAST, TEXTS = 0.5, 8, 4

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never hold the article: parts beside it, controls, what is shown only where an element does not work, and a formula's or drawing's notes.
DROPPED = frozenset(
    "head script style noscript template nav footer aside form dialog menu iframe noembed noframes object embed audio video canvas select "
    "textarea input button title search annotation annotation-xml desc metadata defs".split()
)
#: Words of class and id that mark parts beside the article, if all the name's other words are among PLAIN.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus "
    "footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification paywall popup promo promotion "
    "recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
#: Words of layout, which leave a name's meaning to its other words ("share-price" is not about sharing, "share-buttons" is).
PLAIN = frozenset(
    "a and area article articles bar block body bottom box btn button buttons center col column container content desktop entry fixed float form global group "
    "holder icon icons inline inner item items js left link links list main media message mobile module new news of outer overlay page pages panel part policy post "
    "posts pre primary reader readers region right row secondary section site slot social square sticky stories story strip tags text the thread title to top "
    "unit up user users view wrap wrapper zone".split()
)
#: The article's own head and foot, and what names them its own.
OWN, OWNERS = frozenset({"header", "masthead"}), frozenset({"article", "post", "entry", "story", "content"})
#: Words that are also about what a text says, or how it looks.
SOFT = frozenset("banner share sharing social widget toolbar topbar masthead".split())
#: Words that mark an article as a pointer to another page.
TEASER = frozenset("card cards preview previews teaser teasers".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: An element that starts closes these if they are open (up to the nearest of their containers).
_closes = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"}),
}

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?", re.S
)
_mark = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_words = re.compile(r"[a-z]+")
_sentence = re.compile(r"\S+\s+\S+\s+\S*\w[.!?…。][\"'”’)\]]*(?:\s|\Z)")


class Node:
    __slots__ = ("tag", "marks", "kids", "dropped", "hash")

    def __init__(self, tag: str, marks: dict[str, str]):
        self.tag, self.marks, self.kids, self.dropped, self.hash = tag, marks, [], False, 0


#: Open elements at most; what would lie deeper becomes a sibling, as in browsers. It bounds the search for what an end tag closes.
DEPTH = 512


def parse(page: str) -> Node:
    """The element tree: kids are nodes and decoded strings."""
    root = Node("#root", {})
    stack = [root]
    opened: Counter[str] = Counter()  # open elements by tag
    beyond: Counter[str] = Counter()  # elements past DEPTH whose end tags are still to come

    def close(i: int) -> None:
        opened.subtract(x.tag for x in stack[i:])
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        m = _token.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            stack[-1].kids.append(_html.unescape(text))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if beyond[tag]:
                beyond[tag] -= 1
            elif opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if stack[i].tag in ("article", "main", "body", "table") and tag not in BLOCK:
                        break  # an inline end tag does not close a section
            elif tag == "br":
                stack[-1].kids.append(" ")
            continue
        if tag == "br":
            stack[-1].kids.append(" ")
            continue
        if tag in BLOCK and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in _closes:
            shut, walls = _closes[tag]
            for i in range(len(stack) - 1, 0, -1) if any(opened[x] for x in shut) else ():
                if stack[i].tag in shut:
                    close(i)
                    break
                if stack[i].tag in walls:
                    break
        attrs = m[3] or ""
        if len(stack) > DEPTH and tag not in VOID and tag not in RAW:
            beyond[tag] += 1
            if tag in BLOCK:
                stack[-1].kids.append(Node("hr", {}))  # its text begins a block, in the element that is open
            continue
        node = Node(tag, {k.lower(): (v or "").strip("\"'").lower() for k, v in _mark.findall(attrs)} if attrs.strip(" /") else {})
        stack[-1].kids.append(node)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            shut = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            if tag == "title":
                node.kids.append(_html.unescape(page[at : shut.start() if shut else n]))
            at = shut.end() if shut else n
            continue
        stack.append(node)
        opened[tag] += 1
    return root


def _prose(node: Node) -> bool:
    """Whether a sentence lies in the part outside of links and buttons."""
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if _sentence.search(x):
                return True
        elif x.tag not in ("a", "button"):
            todo.extend(x.kids)
    return False


def _beside(node: Node, inside: bool = False) -> bool:
    """Whether the element is beside the article. Within it (``inside``) a name that may be about the text itself counts only for parts without a sentence, and never for a paragraph or heading."""
    if node.tag in DROPPED:
        return True
    if not node.marks:
        return node.tag == "header"
    if node.tag in ("html", "body", "main", "#root"):
        return False
    m = node.marks
    if "hidden" in m or m.get("aria-hidden") == "true" or m.get("role") in ROLES or node.tag == "header":
        return True
    told = frozenset().union(*(_names_beside(name) for key in ("class", "id") for name in m.get(key, "").split()))
    if inside and told <= SOFT and (node.tag == "p" or node.tag in HEADINGS or told and _prose(node)):
        return False
    return bool(told)


@functools.lru_cache(10_000)
def _names_beside(name: str) -> frozenset[str]:
    """The words of a name that mark a part beside the article; none if its other words say something else."""
    words = set(_words.findall(name))
    told = words & BESIDE
    if told and told <= OWN and words & OWNERS:
        return frozenset()
    return frozenset(told if words <= BESIDE | PLAIN else ())


def prune(node: Node, inside: bool = False, beside: bool = False) -> None:
    """Mark what is not the article. Headings in an article's own header stay."""
    todo = [(node, inside, beside)]
    while todo:
        node, inside, beside = todo.pop()
        inside = inside or node.tag in ("article", "main")
        for k in node.kids:
            if not isinstance(k, str):
                out = _beside(k, inside)
                if out and k.tag == "header" and inside and not beside:
                    k.kids = [x for x in k.kids if not isinstance(x, str) and (x.tag in HEADINGS or x.tag in ("hgroup", "div"))]
                    out = False
                k.dropped = out
                if not out:
                    todo.append((k, inside, beside))


def _order(node: Node) -> list[Node]:
    """Live nodes, parents first."""
    out = [node]
    for x in out:
        out.extend(k for k in x.kids if not isinstance(k, str) and not k.dropped)
    return out


def _size(node: Node) -> int:
    return sum(len(k) for x in _order(node) for k in x.kids if isinstance(k, str) and not k.isspace())


def _articles(root: Node) -> list[Node]:
    """Articles that are not inside another one, in page order, without teasers unless there is nothing else (then the largest)."""
    found, teasers = [], []
    todo = [(root, False)]
    while todo:
        x, teaser = todo.pop()
        if x.tag not in ("html", "body", "main", "#root"):
            teaser = teaser or bool(TEASER & set(_words.findall(f"{x.marks.get('class', '')} {x.marks.get('id', '')}")))
        if x.tag == "article" or x.marks.get("role") == "article":
            (teasers if teaser else found).append(x)
        else:
            todo.extend((k, teaser) for k in reversed(x.kids) if not isinstance(k, str) and not k.dropped)
    return found or [max(teasers, key=_size)] if found or teasers else []


def _outermost(root: Node, is_it: Callable[[Node], bool]) -> list[Node]:
    """Live nodes that are it and not inside another one, in page order."""
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if is_it(x):
            found.append(x)
        else:
            todo.extend(k for k in reversed(x.kids) if not isinstance(k, str) and not k.dropped)
    return found


def _paragraph_outside(part: Node, articles: list[Node]) -> bool:
    """Whether the part has a paragraph that is in none of the articles, nor in a list or table."""
    own, todo = {id(a) for a in articles}, [part]
    while todo:
        x = todo.pop()
        if x.tag == "p" and any(blocks(x)):
            return True
        todo.extend(k for k in x.kids if not isinstance(k, str) and not k.dropped and id(k) not in own and k.tag not in ("ul", "ol", "dl", "table", "article"))
    return False


def _joined(parts: list[Node]) -> Node:
    if len(parts) == 1:
        return parts[0]
    whole = Node("#parts", {})
    whole.kids = parts
    return whole


def _content(node: Node) -> bool:
    words = set(_words.findall(f"{node.marks.get('class', '')} {node.marks.get('id', '')}"))
    return node.tag in ("div", "section", "td") and bool(words & {"content", "article", "post", "entry", "story"}) and not words & TEASER


def main_part(root: Node) -> Node:
    """The articles, or the main elements if these have paragraphs around their articles; else the main elements, else the content parts, else the body.

    Of each kind all that are not inside another one are joined in page order.
    """
    mains = _outermost(root, lambda x: x.tag == "main" or x.marks.get("role") == "main")
    if articles := _articles(root):
        around = [m for m in mains if _paragraph_outside(m, articles)]
        if not around:
            return _joined(articles)
        for x in _outermost(root, lambda x: x.tag == "article" or x.marks.get("role") == "article"):
            x.dropped = all(x is not a for a in articles)  # teasers
        inside = {id(x) for m in around for x in _order(m)}
        whole = _outermost(root, lambda x: any(x is m for m in around) or any(x is a for a in articles))
        return _joined([x for x in whole if id(x) in inside or any(x is a for a in articles)])
    if parts := mains or _outermost(root, _content):
        return _joined(parts)
    return next((x for x in _order(root) if x.tag == "body"), root)


def digest(part: Node) -> list[int]:
    """Hash every live block subtree of the part (tag, class, id, text and subtrees); those with text are returned."""
    out = []
    for x in reversed(_order(part)):
        kids = [" ".join(k.split()) if isinstance(k, str) else f"\x01{k.hash}" for k in x.kids if isinstance(k, str) or not k.dropped]
        kids = [k for k in kids if k]
        x.hash = xxhash.xxh64_intdigest("\x00".join([x.tag, x.marks.get("class", ""), x.marks.get("id", ""), *kids])) >> 1
        if x is not part and kids and x.tag in BLOCK and x.tag not in HEADINGS:
            out.append(x.hash)
    return out


def blocks(part: Node) -> list[str]:
    """The part's text by block: white space becomes one space, empty blocks go."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    todo: list = [part]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif not x.dropped:
            if x.tag in BLOCK:
                end()
                todo.append(None)
            todo.extend(reversed(x.kids))
    end()
    return out


def extract(page: str | None, template: frozenset[int] = frozenset()) -> str:
    """Main text of one page, without the subtrees whose hashes the site's template holds."""
    root = parse(page or "")
    prune(root)
    part = main_part(root)
    if template:
        digest(part)
        for x in [x for x in _order(part) if x is not part and x.hash in template]:
            x.dropped = True
    return "\n".join(blocks(part))


def _text(value) -> str:
    return "" if (v := value.as_py()) is None else v.decode("utf-8", "replace")


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, texts, hashes = [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            root = parse(_text(page))
            prune(root)
            part = main_part(root)
            found = {-1, *digest(part)}  # -1 counts the page
            hosts += [host] * len(found)
            texts += [xxhash.xxh64_intdigest("\n".join(blocks(part))) >> 1] * len(found)
            hashes += found
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(texts, pa.int64()), pa.array(hashes, pa.int64())], ["host", "text", "subtree"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(_text(p), frozenset(t.as_py() or ())) for p, t in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def pages_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE, least: int = LEAST, texts: int = TEXTS) -> DataFrame:
    """page_id, url, text: one row for each page."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).cast("binary").alias("html"))
    found = rows.select("host", "html").mapInArrow(_subtrees, "host string, text long, subtree long")
    by_text = found.groupBy("host", "subtree", "text").agg(F.count("*").alias("n"))  # a busy host's subtrees add up by text first
    counts = by_text.groupBy("host", "subtree").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    counts = written(counts.where((F.col("n") >= least)), "subtrees")
    totals = counts.where("subtree = -1").select("host", F.col("n").alias("pages"))
    often = counts.where((F.col("subtree") != -1) & (F.col("texts") >= texts)).join(totals, "host").where(F.col("n") >= share * F.col("pages"))
    template = written(often.groupBy("host").agg(F.collect_list("subtree").alias("template")), "templates")
    joined = rows.join(template, "host", "left").select("page_id", "url", "html", "template")
    kind = dict(pages.dtypes)[id_col]
    return joined.mapInArrow(_extracted, f"page_id {kind}, url string, text string")
