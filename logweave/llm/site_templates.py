"""Main text of web pages by site template removal.

Every page is read into a compact form: its elements (parent, hash of the subtree) and its text blocks (owner
element, text). Spark counts, per host, on how many pages each subtree occurs that differ outside of it; a subtree that recurs on
``least_pages`` of them is template, however large the host is, and all blocks below a template go. Pages are told apart in three ways, of which two have
to agree: by the longest block outside of the subtree, by the second, and by all of them; and pages of which it holds most
of the running text count once. So copies and near copies of a page do not make their own text template, and one long notice
does not make all pages of a site look alike.

The kinds of elements only assist: what is no text or no article by its kind (scripts, forms, navigation, footers and the like,
comments and adverts that are named so) goes also on the first page of a site. Of what remains, only the blocks of
articles are kept if the longest article holds at least as much running text (blocks of five words or more) as all that stands
outside of articles (in the main element, if there is one); else articles are teasers, and all of it is kept. Paragraphs,
headings and list items of articles and main elements never count as template, but boxes in them do.

Templates meet pages by host and subtree, so their number is not bounded by anything. Every page is read once and written as its blocks
and elements, or as its text where no subtree could be template; the others meet their own templates by host and content.

Defined results: null or empty html gives the empty text; a null or broken url has no host and takes no part in the
counting; unclosed, misnested and very deep markup is read to its end; repeated rows count as one page and get a row each; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, staged

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset(
    "aside button canvas datalist footer form head iframe input menu nav noembed noframes noscript optgroup option script select "
    "style svg template textarea title audio video".split()
)
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
CLOSES_P = BLOCK - {"option", "optgroup", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "head", "li", "dd", "dt"} | {"dl"}
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table select menu".split())
#: Blocks within these do not end the paragraph that they stand in.
BOUNDS = frozenset("button noscript object select svg template".split())
# fixed values: first words of names in class, id and role that tell comments and adverts, anywhere; and what is no article, outside of one
ALIEN = frozenset("ad ads advert advertisement adverts comment comments commentlist consent cookie cookies disqus gdpr newsletter sponsored".split())
NAMES = ALIEN | frozenset(
    "banner breadcrumb breadcrumbs footer menu nav navbar navigation notice popup promo related respond share sharing sidebar social sponsor subscribe widget "
    "complementary contentinfo search toolbar".split()
)
WORDS = re.compile(r"(?<!\S)[^a-z0-9\s]*([a-z0-9]+)")
#: Blocks of fewer words are labels: they do not count when articles are weighed against what stands outside of them.
RUNNING_WORDS = 5


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without user and port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@\[\]\s]+)", 1)), F.lit(""))


def _signed(number: int) -> int:
    return number - (1 << 64) if number >= 1 << 63 else number


class _Frame:
    __slots__ = ("tag", "number", "hasher", "gone", "inside", "p_at", "item_at")

    def __init__(self, tag: str, number: int, gone: bool, inside: bool, p_at: int, item_at: int):
        self.tag, self.number, self.gone, self.inside = tag, number, gone, inside
        self.hasher = xxhash.xxh64(tag)
        #: Places in the stack of the open paragraph that a block closes, and of the innermost list item, row or cell of this list or table (0: none).
        self.p_at, self.item_at = p_at, item_at


def _unwanted(tag: str, attributes: str, inside: bool) -> bool:
    if tag in NEVER:
        return True
    if tag == "header" and not inside:
        return True
    open_dialog = tag != "dialog"
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id", "role"):
                words = WORDS.findall(value)
                if tag not in ("body", "html", "article", "main") and not (ALIEN if inside else NAMES).isdisjoint(words):
                    return True
                if tag == "article" and not {"comment", "comments"}.isdisjoint(words):
                    return True
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                return True
            open_dialog |= name == "open"
    return not open_dialog


class Page(NamedTuple):
    """Parents and subtree hashes of elements (0: never template); owners, outermost articles (0: none) and texts of blocks.

    Blocks are those of main and article elements if there is a main element, or of the whole body.
    """

    parents: list[int]
    hashes: list[int]
    owners: list[int]
    articles: list[int]
    texts: list[str]


def read_page(html: str) -> Page:
    parents, hashes = [-1], [0]
    blocks: list[tuple[int, str, bool]] = []
    root = _Frame("", 0, False, False, 0, 0)
    stack = [root]
    parts: list[str] = []
    has_main = False
    kinds: list[str] = [""]

    def flush() -> None:
        """A block ends, unless that is within something unwanted: then the text around it goes on."""
        top = stack[-1]
        if parts and not top.gone:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                blocks.append((top.number, text, top.inside))

    def pop() -> None:
        if stack[-1].tag in BLOCK:
            flush()
        frame = stack.pop()
        open_tags[frame.tag] -= 1
        below = frame.hasher.intdigest()
        above = stack[-1]
        above.hasher.update(below.to_bytes(8, "little"))
        protected = frame.inside and frame.tag in FLOW
        if not protected and frame.tag in BLOCK and frame.tag not in ("html", "body", "article", "main"):
            hashes[frame.number] = _signed(below)

    def cut_to(place: int) -> None:
        while len(stack) > place:
            pop()

    def close(tag: str) -> None:
        if open_tags.get(tag):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    return cut_to(k)

    def words(text: str) -> None:
        if "&" in text:
            text = entities.unescape(text)
        if not stack[-1].gone:  # what is unwanted can stand within a paragraph too
            parts.append(text)
        if bare := " ".join(text.split()):
            stack[-1].hasher.update(bare)

    open_tags: dict[str, int] = {}
    at = 0
    while True:
        found = TOKEN.search(html, at)
        if found is None:
            words(html[at:])
            break
        if found.start() > at:
            words(html[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if tag == "br":
                parts.append(" ")
            elif tag in ("html", "body"):
                continue
            else:
                close_from = stack[-1].tag
                if close_from == tag:
                    pop()
                else:
                    close(tag)
            continue
        attributes = found[3]
        if tag in VOID or (attributes.endswith("/") and tag not in BLOCK and tag not in RAW):
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                if stack[-1].p_at:
                    cut_to(stack[-1].p_at)
            elif tag in SIBLINGS:
                k, last = stack[-1].item_at, 0
                while k and (stack[k].tag in SIBLINGS[tag] or not last):  # a row ends its cell and the row of that
                    last = k if stack[k].tag in SIBLINGS[tag] else last
                    k = stack[k - 1].item_at
                if last:
                    cut_to(last)
        top = stack[-1]
        gone = top.gone or _unwanted(tag, attributes, top.inside)
        inside = top.inside
        if not gone and tag in ("article", "main"):
            inside = True
            has_main |= tag == "main"
        number = len(parents)
        parents.append(top.number)
        hashes.append(0)
        kinds.append(tag)
        here = len(stack)
        p_at = here if tag == "p" else 0 if tag in BLOCK or tag in BOUNDS else top.p_at
        item_at = here if tag in SIBLINGS else 0 if tag in SCOPES else top.item_at
        stack.append(_Frame(tag, number, gone, inside, p_at, item_at))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            body = html[at : end.start()] if end else html[at:]
            stack[-1].hasher.update(body)
            pop()
            at = html.find(">", end.start()) + 1 or len(html) if end else len(html)
    flush()
    while len(stack) > 1:
        pop()
    if has_main:
        blocks = [b for b in blocks if b[2]]
    article = [0] * len(parents)
    for n in range(1, len(parents)):
        article[n] = article[parents[n]] or (n if kinds[n] == "article" else 0)
    page = Page(parents, hashes, [b[0] for b in blocks], [article[b[0]] for b in blocks], [b[1] for b in blocks])
    # what is outside can only become less; where articles cannot, the page is theirs whatever is template
    if all(not own for own, a in zip(may_go(page), page.articles) if a):
        page = of_articles(page)
    return page


def of_articles(page: Page) -> Page:
    """Only the blocks in articles, if the longest article holds as much running text as all blocks outside of articles."""
    sizes = [0] * len(page.parents)
    for a, text in zip(page.articles, page.texts):
        if running(text):
            sizes[a] += len(text)
    if not any(page.articles) or max(sizes[1:]) < sizes[0]:
        return page
    kept = [k for k, a in enumerate(page.articles) if a]
    return page._replace(owners=[page.owners[k] for k in kept], articles=[page.articles[k] for k in kept], texts=[page.texts[k] for k in kept])


def may_go(page: Page) -> list[bool]:
    """Per block, whether it lies below a subtree that could be template."""
    open_ = [False] * len(page.parents)
    for n in range(1, len(page.parents)):
        open_[n] = open_[page.parents[n]] or page.hashes[n] != 0
    return [open_[o] for o in page.owners]


def own_subtrees(page: Page) -> set[int]:
    """The subtrees that could be template and have a block below them."""
    seen: set[int] = set()
    for n in set(page.owners):
        while n > 0 and n not in seen:
            seen.add(n)
            n = page.parents[n]
    return {page.hashes[n] for n in seen} - {0}


def _key(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text))


def running(text: str) -> bool:
    return text.count(" ") >= RUNNING_WORDS - 1


def subtree_keys(page: Page) -> dict[int, tuple[int, int, int]]:
    """By subtree hash what stands outside of it: hashes of the longest block, of the second, and of all blocks.

    A subtree with most of the running text of a page is what the page is about, not what stands around it: all pages of it count
    as one.
    """
    n_elements = len(page.parents)
    ends, size, blocks = list(range(1, n_elements + 1)), [0] * n_elements, [0] * n_elements
    hashes = [_key(t) for t in page.texts]
    for owner, text, h in zip(page.owners, page.texts, hashes):
        size[owner] += len(text) if running(text) else 0
        blocks[owner] += h
    for n in range(n_elements - 1, 0, -1):  # numbers below an element follow its own
        parent = page.parents[n]
        ends[parent] = max(ends[parent], ends[n])
        size[parent] += size[n]
        blocks[parent] += blocks[n]
    longest = sorted(range(len(page.texts)), key=lambda k: (-len(page.texts[k]), page.texts[k]))
    out: dict[int, tuple[int, int, int]] = {}
    for n in range(1, n_elements):
        own = page.hashes[n]
        if not own or own in out:
            continue
        beyond: list[int] = []
        for k in longest:
            if not n <= page.owners[k] < ends[n]:
                beyond.append(hashes[k])
                if len(beyond) == 2:
                    break
        if not beyond or 2 * size[n] > size[0]:
            out[own] = (own, own, own)
        else:
            out[own] = (beyond[0], beyond[-1], _signed((blocks[0] - blocks[n]) % (1 << 64)))
    return out


def kept_text(page: Page, template: set[int]) -> str:
    """The blocks that lie below no template subtree, of articles or of all."""
    if template:
        gone = [False] * len(page.parents)
        for n in range(1, len(page.parents)):
            gone[n] = gone[page.parents[n]] or (page.hashes[n] != 0 and page.hashes[n] in template)
        left = [k for k, o in enumerate(page.owners) if not gone[o]]
        page = page._replace(owners=[page.owners[k] for k in left], articles=[page.articles[k] for k in left], texts=[page.texts[k] for k in left])
    return "\n\n".join(of_articles(page).texts)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 4) -> DataFrame:
    """Main text of every page: ``id_col, url_col, text, n_chars``.

    A subtree is template when it is on at least ``least_pages`` pages of its host that differ outside of it.
    """
    spark = pages.sparkSession
    prepare(spark)
    kind = pages.schema[id_col].dataType.simpleString()
    longs = pa.list_(pa.int64())
    subtree = pa.struct([("hash", pa.int64()), ("own", pa.bool_()), ("first", pa.int64()), ("second", pa.int64()), ("rest", pa.int64())])
    kinds = (pa.string(), longs, longs, longs, longs, pa.list_(pa.string()), pa.list_(subtree))
    names = ["text", *Page._fields, "subtrees"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every page read once: its text where no template can change it, else what it takes to remove some; and its subtrees."""
        for batch in batches:
            rows = []
            for html, host in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                page = read_page(html or "")
                own = own_subtrees(page) if host is not None else ()
                found = [{"hash": h, "own": h in own, "first": a, "second": b, "rest": c} for h, (a, b, c) in subtree_keys(page).items()] if host is not None else []
                rows.append((None, *page, found) if own else (kept_text(page, set()), *[None] * len(Page._fields), found))
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), *columns], ["id", "url", "host", "content", *names])

    source = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html")).withColumns({"host": host_of(F.col("url")), "content": F.xxhash64("html")})
    schema = (
        f"id {kind}, url string, host string, content bigint, text string, parents array<bigint>, hashes array<bigint>, owners array<bigint>, articles array<bigint>, texts array<string>, "
        "subtrees array<struct<hash: bigint, own: boolean, first: bigint, second: bigint, rest: bigint>>"
    )
    known = staged(source.mapInArrow(read, schema), "site-pages")
    found = known.select("host", "content", F.explode("subtrees").alias("s")).select("host", "content", "s.*")
    ways = found.select("host", "hash", F.posexplode(F.array("first", "second", "rest")).alias("way", "page"))
    agreed = ways.groupBy("host", "hash", "way").agg(F.count_distinct("page").alias("pages")).filter(F.col("pages") >= least_pages)
    templates = agreed.groupBy("host", "hash").agg(F.count("*").alias("ways")).filter("ways >= 2").select("host", "hash")
    lists = found.filter("own").select("host", "content", "hash").distinct().join(templates, ["host", "hash"]).groupBy("host", "content").agg(F.collect_list("hash").alias("template"))
    # written, so that its true size decides how it is joined
    lists = staged(lists, "site-templates")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (*Page._fields, "template"))
            texts = [kept_text(Page(*page), set(template or ())) for *page, template in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    left = known.filter("text is null").join(lists, ["host", "content"], "left").select("id", "url", *Page._fields, "template")
    out = known.filter("text is not null").select("id", "url", "text").union(left.mapInArrow(remove, f"id {kind}, url string, text string"))
    return out.select("id", "url", "text", F.length("text").cast("bigint")).toDF(id_col, url_col, "text", "n_chars")
