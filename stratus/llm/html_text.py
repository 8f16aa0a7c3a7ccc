"""HTML main-text extraction with host-wide consensus on content containers.

Pass one names the best container of every page, the least one that holds all
of the main text (or the article or main around it), by its generalised
tag-class path. Spark counts these votes per host; paths with at least
``min_share`` of a host's votes win, so a host keeps a bounded number of them.
Pass two re-extracts every page from the first winning path that holds all of
its main text; a page with none uses its own best container. Main text is
every unskipped block of which at most half is links.

Navigation, notices, comments and the like are skipped by tag, role, class or
id. A skipped element is read after all when it holds a main, when it holds an
article and no article or main with text is left outside the skipped elements,
or when most of the page's text that is no link is in it (not counted: comments;
not for nav, header, footer and aside). Skipped elements inside it are judged
in the same way.

A host's vote never takes main text from a page.

Defined cases: null, empty or text-free html gives an empty text; a null or
odd url votes under the empty host; repeated rows keep their own rows; markup
that is never closed ends with the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import staged

#: A path wins when it has this share of its host's votes (so at most 20 win).
MIN_SHARE = 0.05
#: Winning paths are broadcast up to this many characters, else joined by host.
MAX_BROADCAST_CHARS = 16_000_000

# Element kinds of the HTML vocabulary.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template".split())
SKIPPED = set("nav header footer aside form button select menu dialog svg math object canvas audio video head".split())
EMBEDDED = set("button select svg math object canvas audio video".split())  # never read after all
NOT_MAIN = set("nav header footer aside menu dialog".split())  # never read after all for their share of the text
CONTAINERS = set("article main section div td body center".split())
ARTICLES = {"article", "main"}
BLOCKS = CONTAINERS | set("html p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption "
                          "blockquote pre figure figcaption address fieldset details summary hr hgroup".split())
CLOSES = {  # an element that ends an open one of these kinds
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
# Words of class names and ids that mark what is not the article.
BOILERPLATE = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription paywall login signup "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side rail widget toolbar footer masthead topbar "
    "comment comments respond disqus replies share sharing social related recommended pagination pager".split())
COMMENTS = set("comment comments respond disqus replies".split())
#: Last words of a name that say what a thing is laid out as, not what it is.
LAYOUT = set("container wrapper wrap box area block section region panel slot unit list item items inner outer body "
             "content left right top bottom main primary secondary bar text links buttons icons posts articles".split())
#: First words of a name that tell of a state of the page, not of what is inside.
STATES = set("has no with without is not show hide".split())
HEADERS = {"header", "site-header", "page-header", "top-header", "global-header"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*|[^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z]+")


class _Open:
    """An element that is open while the page is read."""
    __slots__ = ("tag", "container", "zone", "link")

    def __init__(self, tag: str, container: int, zone: int, link: bool):
        self.tag, self.container, self.zone, self.link = tag, container, zone, link


class _Zone:
    """A skipped element outside EMBEDDED, with the zone around it."""
    __slots__ = ("parent", "container", "tag", "comments", "weight", "has_main", "has_article")

    def __init__(self, parent: int, container: int, tag: str, comments: bool):
        self.parent, self.container, self.tag, self.comments = parent, container, tag, comments
        self.weight, self.has_main, self.has_article = 0, False, False


class Page:
    """Blocks of text, each in a container; containers by generalised path."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, int, int]] = []  # text, container, characters in links
        self.paths: list[str] = ["html"]
        self.tags: list[str] = ["html"]
        self.parents: list[int] = [-1]


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def _head_word(name: str) -> str:
    """The word of a class or id that says what is inside; empty when it tells of a state."""
    words = _WORDS.findall(name)
    if len(words) > 1 and words[0] in STATES:
        return ""
    while len(words) > 1 and words[-1] in LAYOUT:
        words.pop()
    return words[-1] if words else ""


def _head_words(attrs: dict[str, str]) -> set[str]:
    return {_head_word(name) for name in (attrs.get("class", "") + " " + attrs.get("id", "")).lower().split()}


def _is_boilerplate(tag: str, attrs: dict[str, str]) -> bool:
    if tag in SKIPPED:
        return True
    if not attrs or tag in ("body", "html", "article", "main"):
        return False
    if "hidden" in attrs or attrs.get("role", "").lower() in ROLES or "display:none" in attrs.get("style", "").replace(" ", ""):
        return True
    if not HEADERS.isdisjoint((attrs.get("class", "") + " " + attrs.get("id", "")).lower().split()):
        return True
    return not BOILERPLATE.isdisjoint(_head_words(attrs))


def _step(tag: str, attrs: dict[str, str]) -> str:
    """A container's generalised name: its tag and classes, numbers masked."""
    names = sorted({re.sub(r"[0-9]+", "#", c) for c in attrs.get("class", "").lower().split()})
    return ".".join([tag, *names])


def parse(html: str) -> Page:
    page = Page()
    stack = [_Open("html", 0, 0, False)]
    zones = [_Zone(-1, 0, "html", False)]  # the first is what is not skipped; -1 is in EMBEDDED
    rows: list[tuple[list[tuple[str, int, bool]], int]] = []  # pieces of a block with zone and link, container
    article = {0: (-1, "")}  # the zone and tag of the article or main around a container
    parts: list[tuple[str, int, bool]] = []
    at = 0

    def end_block() -> None:
        if parts:
            rows.append((parts.copy(), stack[-1].container))
            parts.clear()

    def add(raw: str) -> None:
        top = stack[-1]
        if raw and top.zone >= 0:
            parts.append((unescape(raw) if "&" in raw else raw, top.zone, top.link))

    def close(kinds: set[str], stop: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in kinds:
                end_block()
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    # Behind the last closing bracket there is no tag; what opens a comment there hides the rest.
    last = html.rfind(">") + 1
    hidden = html.find("<!--", last)
    if hidden >= 0:
        html = html[:hidden]
    while True:
        m = _TOKEN.search(html, at, last) if at < last else None
        if m is None:
            add(html[at:])
            break
        add(html[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS or tag in SKIPPED:
                close({tag}, set())
            elif any(o.tag == tag for o in stack[1:]):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k]  # an inline element: what is inside it stays open
                        break
                    if stack[k].tag in BLOCKS:
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS or tag in SKIPPED:
            end_block()
            close({"p"}, CONTAINERS | {"table", "li", "blockquote"})
            if tag in CLOSES:
                close(CLOSES[tag], {"ul", "ol", "dl", "table"} if tag != "tr" else {"table"})
        if tag in VOID:
            continue
        attrs = _attributes(m[3])
        top = stack[-1]
        container = top.container
        zone = top.zone
        if zone >= 0 and _is_boilerplate(tag, attrs):
            if tag in EMBEDDED:
                zone = -1
            else:
                zones.append(_Zone(zone, container, tag, zones[zone].comments or not COMMENTS.isdisjoint(_head_words(attrs))))
                zone = len(zones) - 1
        if tag in CONTAINERS and zone >= 0:
            step, path = _step(tag, attrs), page.paths[container]
            if path.rpartition(">")[2] != step:  # the same element nested again is one step
                path = f"{path}>{step}"
            page.paths.append(path)
            page.tags.append(tag)
            page.parents.append(container)
            container = len(page.paths) - 1
            marked = tag in ARTICLES and COMMENTS.isdisjoint(_head_words(attrs))
            article[container] = (zone, tag) if marked else article[top.container]
        stack.append(_Open(tag, container, zone, top.link or tag == "a"))
    end_block()
    read = _read_zones(rows, zones, article)
    for pieces, container in rows:
        kept = [(raw, link) for raw, zone, link in pieces if read[zone]]
        text = " ".join("".join(raw for raw, _ in kept).split())
        if text:
            page.blocks.append((text, container, sum(len(raw) for raw, link in kept if link)))
    return page


def _read_zones(rows: list[tuple[list[tuple[str, int, bool]], int]], zones: list[_Zone],
                article: dict[int, tuple[int, str]]) -> list[bool]:
    """Of every zone whether it is read: the first, and those that hold the page's article."""
    if len(zones) == 1:
        return [True]
    total, outside = 0, False
    for pieces, container in rows:
        around, tag = article[container]
        for raw, zone, link in pieces:
            weight = len(" ".join(raw.split()))
            if weight and zone == around:
                outside = outside or zone == 0
                zones[zone].has_article = True
                zones[zone].has_main |= tag == "main"
            if not link and not zones[zone].comments:
                total += weight
                zones[zone].weight += weight
    for zone in reversed(zones[1:]):  # children come after their parents
        parent = zones[zone.parent]
        parent.weight += zone.weight
        parent.has_main |= zone.has_main
        parent.has_article |= zone.has_article
    read = [True]
    for zone in zones[1:]:
        mostly = (2 * zone.weight > total and zone.tag not in NOT_MAIN
                  and (not outside or article[zone.container][0] >= 0))
        read.append(read[zone.parent] and (zone.has_main or mostly or (zone.has_article and not outside)))
    return read


def _main_containers(page: Page) -> list[int]:
    """The container of every block of main text; of every block when all are links."""
    return ([container for text, container, linked in page.blocks if 2 * linked <= len(text)]
            or [container for _, container, _ in page.blocks])


def best_container(page: Page) -> int:
    """The least container with all main text, or the outermost article or main around it."""
    holds = [0] * len(page.paths)
    for k in _main_containers(page):
        holds[k] += 1
    for k in range(len(holds) - 1, 0, -1):  # children come after their parents
        holds[page.parents[k]] += holds[k]
    best = max((k for k in range(len(holds)) if holds[k] == holds[0] > 0), default=0)
    up = best
    while up >= 0:
        if page.tags[up] in ARTICLES:
            best = up
        up = page.parents[up]
    return best


def _inside(page: Page, roots: set[int]) -> list[bool]:
    """Of every container whether it is one of ``roots`` or in one."""
    inside = [False] * len(page.paths)
    for k in range(len(page.paths)):
        inside[k] = k in roots or (page.parents[k] >= 0 and inside[page.parents[k]])
    return inside


def extract(html: str, winners: list[str]) -> str:
    """The main text: in the first of ``winners`` that holds all of it, else in the page's own container."""
    page = parse(html)
    main = set(_main_containers(page))
    best = best_container(page)
    chosen = None
    for path in winners:
        inside = _inside(page, {k for k, p in enumerate(page.paths) if p == path})
        if main and all(inside[k] for k in main):
            chosen = inside
            break
    if chosen is None:
        chosen = _inside(page, {best})
    return "\n\n".join(text for text, container, _ in page.blocks if chosen[container])


def best_path(html: Column) -> Column:
    """The path of a page's best container; null for a page without text."""
    def compute(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            for value in column.to_pylist():
                page = parse(value or "")
                out.append(page.paths[best_container(page)] if page.blocks else None)
            yield pa.array(out, pa.string())
    return F.arrow_udf(compute, "string").asNondeterministic()(html.cast("string"))


def text_of(html: Column, winners: Column) -> Column:
    def compute(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for rows in columns:
            yield pa.array([extract(h or "", p or []) for h, p in zip(*(c.to_pylist() for c in rows))], pa.string())
    return F.arrow_udf(compute, "string").asNondeterministic()(html.cast("string"), winners)


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url.cast("string")), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def winning_paths(pages: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """``(host, paths)``: the paths that win a host, most votes first."""
    votes = (pages.select(host_of(F.col("url")).alias("host"), best_path(F.col("html")).alias("path"))
             .where(F.col("path").isNotNull()).groupBy("host", "path").agg(F.count("*").alias("votes")))
    votes = staged(votes, "html-votes")
    all_votes = votes.groupBy("host").agg(F.sum("votes").alias("all_votes"))
    won = votes.join(all_votes, "host").where(F.col("votes") >= min_share * F.col("all_votes"))
    ranked = won.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("order"), "path"))).alias("r"))
    return ranked.select("host", F.transform("r", lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame, min_share: float = MIN_SHARE,
                  max_broadcast_chars: int = MAX_BROADCAST_CHARS) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    winners = staged(winning_paths(pages, min_share), "html-paths").withColumnRenamed("host", "__host")
    size = winners.agg(F.sum(F.length("__host") + F.length(F.concat_ws(",", "paths")) + 32)).first()[0] or 0
    small = F.broadcast(winners) if size <= max_broadcast_chars else winners
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("__host"))
    texts = rows.join(small, "__host", "left").select(
        "page_id", "url", text_of(F.col("html"), F.col("paths")).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))
