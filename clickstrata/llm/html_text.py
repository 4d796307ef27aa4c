"""Main text of HTML pages by differencing pages that are near in URL, and by tags.

Method: each page is cut into lines, its text blocks. Pages of a host are ordered by URL path, and each page is paired
with the neighbour that shares the longer path prefix. The lines of both are aligned by longest common subsequence, and
lines that both share are deleted: they belong to the site, not to the page.

Tags say of each line whether it lies in an article or main part, in an element that never holds main text (menus, forms,
adverts, reader comments and so on), or neither. What is unique to a page but no main text, as an advert, no
differencing can find: it goes by its tags. What pages share but is main text, as a quotation or a copy under another
URL, must stay: a shared line inside an article goes only if it stands on a share ``SITE`` of the host's differing
pages, at least ``SITE_PAGES``, which neither does. Where a page has a main part, only that is text.

A neighbour whose lines, but for those left out by tags, all equal the page's is a copy, which says nothing about the
site: the next one that is none is taken. Where the nearest shares nearly all lines, it may be an edited copy or the
site's frame may be large: then only lines that the nearest page on the other side shares too are deleted, if the host
has one there.

Null html and html without text give the empty string. Null URLs form a host of their own; null ids are kept. Ties in
URL order are broken by the rows' places in the table. Empty tables give no rows. Repeated rows are extracted each.
Columns besides id, url and html are ignored. Broken markup is read as browsers do in so far as it decides where blocks
end; tags, comments and quotes that never end take the rest of the page with them, and a page is read in time that grows
with its length. A very long page is one row of a batch of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickstrata.llm.common import small_batches, unlike_neighbours, written

#: Fixed values, from HTML: elements whose content is raw, elements that hold no content, elements that are blocks.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements left out with all they hold.
OUTSIDE = {"aside", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "map", "menu", "nav", "object", "search", "select", "svg", "template"}
#: Elements that a new block of the same kind ends.
SELF_ENDING = {"p", "li", "dd", "dt", "tr", "td", "th", "option"}
#: Words in class, id or role that mark page furniture and reader comments.
FURNITURE = re.compile(r"(?:^|[\s_-])(?:ads?|advert(?:isement|s|ising)?|banner|breadcrumbs?|comments?|complementary|contentinfo|cookies?|consent|disqus|footer|masthead|menu|modal|nav(?:bar|igation)?|newsletter|notice|pagination|popup|promo|related|replies|reply|respond|share|sharing|sidebar|social|sponsor(?:ed)?|subscribe|toolbar|widget)(?:$|[\s_-])", re.IGNORECASE)
#: Site headers; inside the main part a header is the article's own.
HEADER = re.compile(r"(?:^|[\s_-])(?:site|page|top|global)?[_-]?header(?:$|[\s_-])", re.IGNORECASE)
#: Elements, and words in class, id, role or itemprop, that mark the main part.
MAIN = {"article", "main"}
MAIN_PART = re.compile(r"(?:^|\s)(?:main|(?:main|page)[_-]?content|content|article|post|story|(?:article|post|entry|story)[_-]?(?:body|content|text)|articleBody)(?:$|\s)", re.IGNORECASE)
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: One attribute: name, then its value in double quotes, in single quotes, or bare. A quote that never ends takes the rest.
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?""")
BETWEEN = re.compile(r"[\s/=]*")
RAW_ENDS = {name: re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE) for name in RAW}
BLANK = re.compile(r"\s+")
NAMED = {"class", "id", "role", "hidden", "style", "itemprop", "aria-hidden"}
#: With a larger share of shared lines, the neighbour on the other side is asked too.
COPY = 0.8
#: Share of a host's differing pages, and pages at least, on which a line of an article must stand to be the site's.
SITE, SITE_PAGES = 0.5, 4
#: Pages with lines to take out of their articles, some 100 bytes each, that are broadcast at most; more are joined by shuffle.
BROADCAST_PAGES = 50_000
#: Kinds of lines.
OTHER, MAIN_LINE, LEFT_OUT = 0, 1, 2


def _left_out(name: str, attrs: dict[str, str], inside: bool) -> bool:
    if name in OUTSIDE or (name == "header" and not inside):
        return True
    for key, value in attrs.items():
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return True
        if key in ("class", "id", "role") and name not in ("html", "body", "main") and (FURNITURE.search(value) or not inside and HEADER.search(value)):
            return True
    return False


def _is_main(name: str, attrs: dict[str, str]) -> bool:
    if name in MAIN:
        return True
    return name in ("div", "section", "td") and any(key in ("class", "id", "role", "itemprop") and MAIN_PART.search(value) for key, value in attrs.items())


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str], bool]]:
    """("text", text, ...), ("open", name, named attributes, whether it ends itself) and ("close", name, ...), in order."""
    at, size = 0, len(html)
    while at < size:
        if html[at] != "<":
            end = html.find("<", at)
            end = size if end < 0 else end
            yield "text", html[at:end], {}, False
            at = end
        elif html.startswith("<!--", at):
            end = html.find("-->", at + 2)
            at = size if end < 0 else end + 3
        elif m := TAG.match(html, at):
            name, closing, attrs = m[1].lower(), html[at + 1] == "/", {}
            at = m.end()
            while True:
                between = BETWEEN.match(html, at)
                at = between.end()
                if at >= size or html[at] == ">":
                    break
                m = ATTRIBUTE.match(html, at)
                at = m.end()
                if (key := m[1].lower()) in NAMED and key not in attrs:
                    attrs[key] = unescape(m[2] or m[3] or m[4] or "")
            if at < size:  # a tag that never ends is none
                yield "close" if closing else "open", name, attrs, between[0].endswith("/")
            at += 1
            if name in RAW and not closing:
                end = RAW_ENDS[name].search(html, at)
                at = end.start() if end else size
        elif at + 1 < size and html[at + 1] in "!?/":
            end = html.find(">", at)
            at = size if end < 0 else end + 1
        else:
            yield "text", "<", {}, False
            at += 1


def blocks(html: str) -> list[tuple[str, int]]:
    """The page's text blocks in order, and the kind of each."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # elements that are open, where they decide anything: name, left out, main
    open_: Counter[str] = Counter()
    flow: list[str] = []
    aside: list[str] = []
    skip = main = 0

    def flush(held: list[str], kind: int) -> None:
        text = BLANK.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            out.append((text, kind))

    def end_block() -> None:
        if skip:
            flush(aside, LEFT_OUT)
        else:
            flush(flow, MAIN_LINE if main else OTHER)

    def push(name: str, is_out: bool, is_main: bool) -> None:
        nonlocal skip, main
        stack.append((name, is_out, is_main))
        open_[name] += 1
        skip += is_out
        main += is_main

    def pop() -> str:
        nonlocal skip, main
        name, was_out, was_main = stack.pop()
        open_[name] -= 1
        if was_out:
            flush(aside, LEFT_OUT)
        skip -= was_out
        main -= was_main
        return name

    for what, name, attrs, ended in tokens(html):
        if what == "text":
            (aside if skip else flow).append(unescape(name))
            continue
        block = name in BLOCKS or name in OUTSIDE
        if what == "close":
            if block:
                end_block()
            if open_[name]:
                while pop() != name:
                    pass
            continue
        if name in RAW or name in VOID:
            if name == "hr":
                end_block()
            elif name == "br":
                (aside if skip else flow).append(" ")
            continue
        is_out = not skip and _left_out(name, attrs, main > 0)
        if not block and not is_out:
            if skip and stack[-1][0] == name:  # its end must not be taken for that of the element left out
                push(name, False, False)
            continue
        if block:
            end_block()
            if name in SELF_ENDING and stack and stack[-1][0] == name or name != "p" and name in BLOCKS and stack and stack[-1][0] == "p":
                pop()
                is_out = not skip and _left_out(name, attrs, main > 0)
        if not (ended and name in OUTSIDE):
            push(name, is_out, _is_main(name, attrs))
    while stack:
        end_block()
        pop()
    end_block()
    return out


def common_lines(a: list, b: list) -> list[int]:
    """Places in a of a longest common subsequence with b: bit-parallel rows, then traced back."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            out.append(i - 1)
            i -= 1
            j -= 1
    return out[::-1]


def shared_lines(hashes: list[int], near: list[int], other: list[int] | None) -> set[int]:
    """Places of the lines that the near page shares, or if that is nearly all, that the other shares too."""
    gone = set(common_lines(hashes, near))
    if other is not None and len(gone) > COPY * max(len(hashes), len(near)):
        gone &= set(common_lines(hashes, other))
    return gone


def _hash(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


PARSED = "row long, page_id long, url string, lines array<string>, kinds array<tinyint>, hashes array<long>, lines_hash long"


def parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Each page's lines (empty strings for those left out by tags), their kinds and hashes, and a hash of all lines not left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for html in batch.column("html"):
                found = blocks(html.as_py() or "")
                hashes = [_hash(x) for x, _ in found]
                own = [h for h, (_, kind) in zip(hashes, found, strict=True) if kind != LEFT_OUT]
                for c, v in zip(cols, ([x if kind != LEFT_OUT else "" for x, kind in found], [kind for _, kind in found], hashes, _hash(repr(own))), strict=True):
                    c.append(v)
            kinds = (pa.list_(pa.string()), pa.list_(pa.int8()), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("page_id"), batch.column("url"), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["row", "page_id", "url", "lines", "kinds", "hashes", "lines_hash"])

    narrow = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return written(narrow.mapInArrow(run, PARSED), "pages")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), "//([^/?#]*)", 1), "^www\\.", ""))


def nearest(pages: DataFrame) -> DataFrame:
    """row, the row of the neighbour in URL order on the same host that shares the longer path prefix (near), and that of the
    neighbour on the other side (other). Pages with equal lines_hash are copies: neighbours are the next that are none.
    """
    path = F.regexp_extract(F.coalesce("url", F.lit("")), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    keys = pages.select("row", F.xxhash64(host_of(F.col("url"))).alias("host"), path.alias("path"), "lines_hash")
    keys = keys.select("row", "host", "path", F.struct("host", "lines_hash").alias("lines"), F.struct("host", "path", "row").alias("at"))
    both = unlike_neighbours(keys, [F.asc("host"), F.asc("path"), F.asc("row")], "at", "lines")
    steps = lambda p: F.split(p, "/")

    def shared(other: str):
        same = F.zip_with(steps(F.col("path")), steps(F.col(f"{other}.path")), lambda a, b: F.coalesce(a == b, F.lit(False)))
        return F.when(F.col(f"{other}.host") == F.col("host"), F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same))).otherwise(-1)

    score = both.withColumns({"s_ahead": F.coalesce(shared("ahead"), F.lit(-1)), "s_behind": F.coalesce(shared("behind"), F.lit(-1))})
    on_host = lambda side: F.when(F.col(f"s_{side}") >= 0, F.col(f"{side}.row"))
    first = F.col("s_ahead") >= F.col("s_behind")
    return score.select("row", F.when(first, on_host("ahead")).otherwise(on_host("behind")).alias("near"), F.when(first, on_host("behind")).otherwise(on_host("ahead")).alias("other"))


def site_lines(table: DataFrame, doubtful: DataFrame) -> DataFrame:
    """Of the lines (host, hash) in doubtful, those that stand on a share SITE of the host's differing pages."""
    pages = table.select(host_of(F.col("url")).alias("host"), "hashes", "lines_hash")
    asked = doubtful.select("host", "hash").distinct()
    # a line counts once for each differing page: the counts are of distinct pairs, aggregated before the shuffle
    stands = pages.select("host", "lines_hash", F.explode(F.array_distinct("hashes")).alias("hash")).join(asked, ["host", "hash"], "left_semi").distinct().groupBy("host", "hash").agg(F.count("*").alias("on"))
    sizes = pages.select("host", "lines_hash").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    return stands.join(sizes, "host").where((F.col("on") >= SITE * F.col("pages")) & (F.col("on") >= SITE_PAGES)).select("host", "hash")


def differenced(table: DataFrame) -> DataFrame:
    """row, gone (places of the lines that the nearest page shares) and doubtful (those of them inside an article) of each page."""
    pairs = nearest(table.select("row", "url", "lines_hash"))
    lines = table.select("row", "kinds", "hashes")  # the same for all three joins, so that it is dealt once
    near, other = (lines.select(F.col("row").alias(x), F.col("hashes").alias(f"{x}_hashes")) for x in ("near", "other"))
    met = pairs.join(near, "near", "left").join(other, "other", "left").join(lines, "row").select("row", "kinds", "hashes", "near_hashes", "other_hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, doubtful = [], []
            for kinds, hashes, near, other in zip(*(batch.column(c).to_pylist() for c in ("kinds", "hashes", "near_hashes", "other_hashes")), strict=True):
                shared = sorted(shared_lines(hashes, near or [], other))
                gone.append(shared)
                doubtful.append([k for k in shared if kinds[k] == MAIN_LINE])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(gone, pa.list_(pa.int32())), pa.array(doubtful, pa.list_(pa.int32()))], ["row", "gone", "doubtful"])

    return written(met.mapInArrow(run, "row long, gone array<int>, doubtful array<int>"), "shared-lines")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession)
    table = parsed(pages, id_col, url_col, html_col)
    shared = differenced(table)
    asked = shared.where(F.size("doubtful") > 0).select("row", F.explode("doubtful").alias("k")).join(table.select("row", "url", "hashes"), "row")
    asked = written(asked.select("row", "k", host_of(F.col("url")).alias("host"), F.col("hashes")[F.col("k")].alias("hash")), "doubtful-lines")
    of_site = written(asked.join(site_lines(table, asked), ["host", "hash"]).groupBy("row").agg(F.collect_set("k").alias("gone")), "lines-of-sites")
    if of_site.count() <= BROADCAST_PAGES:
        of_site = F.broadcast(of_site)
    marked = F.array_contains("kinds", F.lit(MAIN_LINE).cast("byte"))
    columns = ["page_id", "url", "lines", "kinds", "gone"]
    articles = table.where(marked).join(of_site, "row", "left").select(*columns, F.lit(MAIN_LINE).alias("kind"))
    others = table.where(~marked).join(shared.select("row", "gone"), "row", "left").select(*columns, F.lit(OTHER).alias("kind"))
    held = articles.unionByName(others).withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    stays = F.filter("lines", lambda x, k: (F.get("kinds", k) == F.col("kind")) & ~F.array_contains("gone", k))
    held = held.withColumn("text", F.array_join(stays, "\n\n"))
    return held.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
