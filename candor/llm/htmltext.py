"""Main text of web pages: site template removal and page structure.

1. Each page is parsed and the subtrees of its elements hashed (tag, class, id, text and
   children). Spark counts for each host on how many pages a subtree occurs; a task sends
   one sum for each host and subtree, so a large host isn't gathered anywhere.
2. Subtrees on at least MIN_PAGES pages and SHARE of their host's pages are its template.
   A host has at most (elements of a page) / SHARE of them, so the list is short. It is
   joined to the pages by host. Subtrees within an article or `main` are counted apart:
   once for each different article of the host, and of its different articles they must
   be in as many. Copies of an article are one, so they keep their text.
3. Each page loses its host's template subtrees and elements that are never main text by
   their tag, and gives the blocks of its article, else of `main`, else of its body. Of several articles those count that
   have at least half the text of the longest. Reader comments always go. Forms, and elements that a class, id or role names as
   something else, go from an article, and from a page that has an article outside of them. On other pages one stays that has more
   than half of the page's text and an article in it, or is a form with paragraphs. Where all text would go, what has paragraphs and more
   than half of it stays: a word never costs the whole text. The article itself and what is around it is never template. Within it
   items and cells go only with their list or table, and elements amid a line of text only
   with the line. An article that would lose more than half of its blocks and of its text
   is taken for a near copy and stays whole.

Blocks are joined by two line feeds; white space in a block, <br> included, becomes one
space. Character references are decoded once.

Nulls: a null html gives an empty text; a null url or one without a host counts as the
host ''. Broken markup is read as far as it goes, whole pages at any length and in time in proportion to it: a tag
that never ends is text, elements deeper than DEEPEST hang on the one there, and of a textarea
or the like that is left open only the tag is ignored. Repeated
rows each give a result and count as pages. An empty table gives an empty result.
Ids are cast to long: an id that is no number is an error under ANSI.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter, defaultdict
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, small_batches, stored

MIN_PAGES = 5
SHARE = 0.2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe svg template object canvas xmp noembed noframes".split())
DROP = frozenset("nav header footer aside script style noscript iframe svg template object canvas button select textarea input label dialog menu title head audio video map".split()) | RAW
WRAPS = frozenset(("form", "fieldset"))
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 article main blockquote pre".split())
DEEPEST = 512
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption head".split()
)
#: Words of a class, id or role that name something other than main text
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion popup modal overlay cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup menu navbar nav navigation breadcrumb breadcrumbs sidebar widget widgets footer header masthead topbar toolbar social share sharing related recommended recommendations teaser teasers cta comment comments commentlist disqus respond replies login search searchbox pagination pager skip contentinfo complementary".split()
)
#: Words that may stand beside them in a name; any other word says that the name means something else
BESIDE = frozenset(
    "site page main top bottom left right primary secondary global area box block wrapper wrap container inner outer list item items link links bar panel group holder slot unit icon icons button buttons sticky fixed mobile desktop post posts article articles story stories reader user form wp google js id".split()
)
#: Those of reader comments, which always go
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
#: Words that name a list of other pages if one of the second line stands beside them
OTHERS = frozenset("more latest popular trending recent".split())
PAGES = frozenset("story stories article articles post posts link links item items".split())
#: In an article these name parts of it
_OF_ARTICLES = frozenset(("header", "masthead"))
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=\"']++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)>")
_MARKUP = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[a-z0-9]+")
_CLOSES_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
_SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Parts that say nothing without the rest: they are template only with their list or table
_PARTS = frozenset("li dt dd tr td th tbody thead tfoot caption legend".split())
_HOLDS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}


class Node:
    """An element: `never` is main text by its tag, `named` something else by a word; `drop` is what settle() makes of that, `kept` the
    size of the text that stays, `article` whether an article is in it."""

    __slots__ = ("article", "children", "drop", "hash", "kept", "mark", "named", "never", "paragraph", "size", "tag")

    def __init__(self, tag: str, mark: str = "", never: bool = False, named: str = ""):
        self.tag, self.mark, self.never, self.named, self.children = tag, mark, never, named, []
        self.hash, self.drop, self.size, self.paragraph = None, never, 0, False
        self.kept, self.article = 0, False


def _named(names: str) -> str:
    """Of the names in a class, id or role: 'yes' if one consists of MARKS and words that stand beside them, 'comments' if these are
    COMMENTS, 'outside' if it is that only outside of articles."""
    found = ""
    for name in names.split():
        words = _WORD.findall(_CAMEL.sub("-", name).lower())
        others = OTHERS if not PAGES.isdisjoint(words) else frozenset()
        marks = [w for w in words if w in MARKS or w in others]
        if marks and all(w in marks or w in BESIDE or w[0].isdigit() for w in words):
            if not COMMENTS.isdisjoint(marks):
                return "comments"
            if not _OF_ARTICLES.issuperset(marks):
                found = "yes"
            found = found or "outside"
    return found


@lru_cache(maxsize=64)
def _end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def parse(page: str) -> Node:
    """The page's elements and texts as a tree; unknown and unclosed tags are taken as browsers mostly do."""
    root = Node("#root")
    stack, at, open_raw = [root], 0, set()
    while True:
        m = _MARKUP.search(page, at)
        start = len(page) if m is None else m.start()
        if start > at:
            stack[-1].children.append(page[at:start])
        if m is None:
            break
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            if end < 0:
                break
            at = end + 3
            continue
        if m[0] in ("<!", "<?"):
            end = page.find(">", m.end())
            at = len(page) if end < 0 else end + 1
            continue
        m = _TAG.match(page, start)
        if m is None:  # it never ends
            stack[-1].children.append(page[start:])
            break
        at = m.end()
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            _close(stack, tag)
            continue
        mark, never, named = "", tag in DROP, "yes" if tag in WRAPS else ""
        if attrs and any(k in attrs.lower() for k in ("class", "id", "role", "hidden")):
            found = {k.lower(): v.strip("\"'") for k, v in reversed(_ATTR.findall(attrs))}  # the first of equal names counts
            mark = " ".join(f"{k}={found[k]}" for k in ("class", "id") if k in found)
            by_name = _named(" ".join(found.get(k, "") for k in ("class", "id", "role")))
            named = by_name if by_name == "comments" else named or by_name
            never = never or ("hidden" in found and found["hidden"].lower() != "until-found") or found.get("aria-hidden", "").lower() == "true"
        if tag in _CLOSES_P and stack[-1].tag != "#root":
            _close_p(stack)
        if tag in _SAME:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _SAME[tag]:
                    del stack[k:]
                    if tag != "tr":
                        break
                elif stack[k].tag in _HOLDS[tag]:
                    break
        node = Node(tag, mark, never, named)
        stack[-1].children.append(node)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            if tag in open_raw:
                continue
            end = _end(tag).search(page, at)
            if end is None:
                if tag in ("script", "style"):
                    break
                open_raw.add(tag)
                continue
            node.children.append(page[at : end.start()])
            at = end.end()
            continue
        if len(stack) < DEEPEST:
            stack.append(node)
    return settle(root)


def settle(root: Node) -> Node:
    """Decides which elements go: those that are never main text, and those that are named something else, by the rules above."""
    order = _walk(root, set())
    for n in order:
        n.paragraph = n.tag in PARAGRAPH
        for c in n.children:
            if type(c) is str:
                n.size += len(c.strip())
            elif not c.never:
                n.size += c.size
                n.paragraph |= c.paragraph
                n.article |= c.article or c.tag in ("article", "main") and c.named != "comments"
    free, open_ = False, {id(root)}  # an article outside of named elements; the elements outside of them
    for n in reversed(order):
        if id(n) in open_ and not n.never and n.named not in ("yes", "outside", "comments"):
            free = free or n.tag in ("article", "main") and n.size > 0
            open_.update(id(c) for c in n.children if type(c) is not str)
    inside = {id(root): None}  # the article that an element is in
    for n in reversed(order):
        article = inside[id(n)]
        if n.never or n.named == "comments":
            n.drop = n.never or n.tag not in ("html", "body", "main")
        elif n.named == "yes" or n.named == "outside" and article is None:
            large = n.paragraph and 2 * n.size > root.size
            n.drop = article is not None or free or not (large and (n.article or n.tag in WRAPS or n.tag in ("html", "body", "main", "article")))
        if n.tag in ("article", "main") and not n.drop:
            article = n
        for c in n.children:
            if type(c) is not str:
                inside[id(c)] = article
    _sum_kept(order)
    bare = {id(n) for n in order if n.size and not n.kept and (n is root or n.tag in ("article", "main") and not n.drop)}
    if bare:
        for n in reversed(order):
            around = inside[id(n)] or root
            if n.drop and not n.never and n.named != "comments" and id(around) in bare and n.paragraph and 2 * n.size > around.size:
                n.drop = False
        _sum_kept(order)
    return root


def _sum_kept(order: list[Node]) -> None:
    for n in order:
        n.kept = sum(len(c.strip()) if type(c) is str else 0 if c.drop else c.kept for c in n.children)


def _close_p(stack: list[Node]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == "p":
            del stack[k:]
            return
        if stack[k].tag in BLOCK:
            return


def _close(stack: list[Node], tag: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in BLOCK and tag not in BLOCK:
            return


def _walk(root: Node, closed: set[int]) -> list[Node]:
    """All nodes, each after its descendants, but those within `closed` ones. No recursion, as pages can be nested deeply."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        if id(n) not in closed:
            todo += [c for c in n.children if type(c) is not str]
    return out[::-1]


def _kept(n: Node) -> bool:
    return not n.drop or n.tag in ("body", "html", "article", "main")


def _has_text(start: Node) -> bool:
    """Whether blocks() of it are any."""
    todo: list = [start]
    while todo:
        n = todo.pop()
        if type(n) is str:
            if htmllib.unescape(n).strip():
                return True
        elif n is start or not n.drop:
            todo += n.children
    return False


def mains(root: Node) -> list[Node]:
    """Outermost articles that hold text, without those with less than half of the longest one's; else `main` elements, else the body or the root."""
    for want in ("article", "main", "body"):
        found, todo = [], [root]
        while todo:
            n = todo.pop()
            if n.tag == want and not (n.drop and want == "article"):
                found.append(n)
            else:
                todo += [c for c in reversed(n.children) if type(c) is not str and _kept(c)]
        if any(_has_text(n) for n in found):
            return [n for n in found if 2 * n.kept >= max(f.kept for f in found)] if want == "article" else found
    return [root]


_SKIP = frozenset(("#root", "body", "html", "br", "hr", "head", "meta"))


def _hash(n: Node, salt: bytes) -> bytes:
    h = blake2b(salt + f"{n.tag} {n.mark}".encode(), digest_size=8)
    for c in n.children:
        h.update(" ".join(c.split()).encode("utf-8", "replace") if type(c) is str else b"\0" + c.hash)
    return h.digest()


def _content(n: Node) -> list:
    return [c for c in n.children if (c.strip() if type(c) is str else c.children)]


def _within(main: Node) -> tuple[bytes, set[bytes]]:
    """Hash of a main element, and of the subtrees in it that may be template. Other nodes in it have no hash."""
    order = _walk(main, set())
    for n in order:
        n.hash = _hash(n, b"within ")
    own, main.hash = main.hash, None
    for n in reversed(order):  # each before its descendants
        content = _content(n)
        line = [c for c in content if type(c) is str or c.tag not in BLOCK]
        fixed = n is not main and n.hash is None
        for c in n.children:
            if type(c) is str:
                continue
            part, amid = c.tag in _PARTS, c.tag not in BLOCK and (len(line) > 1 or fixed and n.tag not in BLOCK)
            if part or amid or fixed and len(content) == 1:
                c.hash = None
    return own, {n.hash for n in order if n.hash and n.tag not in _SKIP and n.children}


def hashes(root: Node, main: list[Node]) -> tuple[set[bytes], dict[bytes, set[bytes]]]:
    """Hashes of the subtrees outside the main elements, and of those within each different one."""
    main = [n for n in main if n.tag not in ("body", "#root")]
    protected = {id(n) for n in main}
    holds = set()
    order = _walk(root, protected)
    for n in order:
        n.hash = None
        if id(n) in protected or any(type(c) is not str and id(c) in holds for c in n.children):
            holds.add(id(n))  # a main element or one around it
        else:
            n.hash = _hash(n, b"")
    out = {n.hash for n in order if n.hash and n.tag not in _SKIP and n.children}
    return out, dict(_within(n) for n in main)


def blocks(start: Node, template: frozenset = frozenset()) -> list[str]:
    out, text = [], []

    def flush():
        if text:
            # references first: a decoded space is white space too
            s = " ".join(htmllib.unescape("".join(text)).split())
            text.clear()
            if s:
                out.append(s)

    todo: list = [start]
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif type(n) is str:
            text.append(n)
        elif n is not start and (n.drop or (n.hash is not None and n.hash in template)):
            if n.tag in BLOCK:
                flush()
        elif n.tag == "br":
            text.append(" ")
        else:
            if n.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(n.children)
    flush()
    return out


def _rest(n: Node, template: frozenset) -> list[str]:
    """Blocks of a main element without template, or all if little would be left: near copies share most of theirs."""
    rest = blocks(n, template)
    if template and n.tag not in ("body", "#root"):
        whole = blocks(n)
        if 2 * len(rest) < len(whole) and 2 * sum(map(len, rest)) < sum(map(len, whole)):
            return whole
    return rest


def main_text(page: str | None, template: frozenset = frozenset()) -> str:
    if not page:
        return ""
    root = parse(page)
    main = mains(root)
    if template:
        _, within = hashes(root, main)
        if not any(n.tag in ("body", "#root") for n in main) and all(template.isdisjoint(h) for h in within.values()):
            template = frozenset()  # none of it is in this page's article
    return "\n\n".join(b for n in main for b in _rest(n, template))


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _signed(h: bytes) -> int:
    return int.from_bytes(h, "little", signed=True) or 1


@lean
def _count(batches):
    for batch in batches:
        found: dict[str, Counter] = defaultdict(Counter)
        articles: dict[tuple[str, int], set[bytes]] = {}
        for where, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            c = found[where]
            c[0] += 1
            if page.is_valid:
                root = parse(page.as_py())
                out, within = hashes(root, mains(root))
                c.update(map(_signed, out))
                articles.update(((where, _signed(h)), some) for h, some in within.items())
        rows = [(where, None, h, n) for where, c in found.items() for h, n in c.items()]
        rows += [(where, article, h, 1) for (where, article), some in articles.items() for h in (0, *map(_signed, some))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["host", "article", "subtree", "n"])


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """host, subtrees: hashes of the subtrees that recur across many pages, or many different articles, of the host.
    The rows of subtree 0 count pages and articles."""
    counts = pages.select("host", "html").mapInArrow(_count, "host string, article long, subtree long, n long").groupBy("host", "article", "subtree").agg(F.sum("n").alias("n"))
    within = F.col("article").isNotNull()
    counts = counts.groupBy("host", within.alias("within"), "subtree").agg(F.sum(F.when(within, 1).otherwise(F.col("n"))).alias("n"))
    counts = stored(counts.where(F.col("n") >= min_pages), "subtrees")
    total = counts.where("subtree = 0").select("host", "within", F.col("n").alias("pages"))
    many = counts.where("subtree <> 0").join(total, ["host", "within"]).where(F.col("n") >= F.col("pages") * share)
    return many.groupBy("host").agg(F.collect_list("subtree").alias("subtrees"))


@lean
def _extract(batches):
    cache: dict[str, frozenset] = {}
    for batch in batches:
        out = []
        for where, page, subtrees in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("subtrees"), strict=True):
            if where not in cache:
                if len(cache) > 1000:
                    cache.clear()
                cache[where] = frozenset(int(h).to_bytes(8, "little", signed=True) for h in (subtrees.as_py() or ()))
            out.append(main_text(page.as_py(), cache[where]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Of each page: page_id, url, text, n_chars."""
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    small_batches(pages.sparkSession)
    pages = pages.withColumn("host", host(F.col("url")))
    found = stored(templates(pages, min_pages, share), "templates")
    return pages.join(found, "host", "left").select("page_id", "url", "html", "host", "subtrees").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
