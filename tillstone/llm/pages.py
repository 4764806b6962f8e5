"""Main text of web pages by consensus paths of their hosts.

A page is read into blocks of text, each with the path of the containers around it: tag names with generalised classes
(digits dropped). Every page has a body, whether or not its tags are there, so a block outside all containers has the path
``body/``. Blocks inside menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments
are left out by tag or role; a header inside an article is the article's own and stays. Words of a class or id only raise a suspicion, since layout wrappers bear them too: such an
element is left out if it holds at most half of the page's text, unless less than a quarter of the text is then left; the
text of one that stays counts less in the scores. Every container path of a page is scored by the share of the page's text below it,
less its links, and by what its tag and classes promise. The pages of a host vote with these scores, summed in Spark; the
winning path is then used on every page of the host. A page without that path uses its own best one.

Inside a block character references are decoded and white space becomes one space; blocks are joined by a line feed.

Defined cases: null and empty html give an empty text, as do pages without text. A null url, or one without a host, votes
under the empty host. Repeated pages vote and are extracted one by one. Broken markup is read as it comes: unclosed
elements end with their container, unknown end tags are ignored, an unclosed script or comment takes the rest.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstone.llm.arrow import steps
from tillstone.llm.skew import with_totals
from tillstone.llm.url_filter import host_of
from tillstone.operators.storage import WorkTables

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s>/]*)[^>]*>|<([a-zA-Z][^\s>/]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Element names by what they are.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINERS = {"html", "body", "div", "article", "main", "section", "td", "center", "content"}
BREAKS = CONTAINERS | {
    "p", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody",
    "tfoot", "tr", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "nav",
    "header", "footer", "aside", "form", "fieldset", "menu", "dialog", "head", "button", "label", "option", "hgroup",
}
ENDED_BY_BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
DROPPED = RAW | {
    "head", "nav", "header", "footer", "aside", "form", "fieldset", "menu", "dialog", "button", "label", "option",
    "object", "audio", "video", "canvas", "map", "datalist",
}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
SUSPECT_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo",
    "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "topbar", "footer",
    "sidebar", "side", "aside", "widget", "widgets", "cookie", "cookies", "consent", "gdpr", "notice", "notification",
    "popup", "modal", "overlay", "comment", "comments", "commentlist", "disqus", "replies", "reply", "respond", "related",
    "recommended", "teaser", "teasers", "share", "sharing", "social", "newsletter", "subscribe", "signup", "login", "search",
    "pagination", "pager", "copyright", "disclaimer", "toolbar", "skip",
}
PROMISING_WORDS = {"content", "post", "entry", "story", "body", "text", "article", "main"}
_WORDS = re.compile(r"[a-z]+")
# says what the layout has or lacks, not what the element is
_LAYOUT = re.compile(r"(?:no|has|with|without|not)[-_]")
#: Weight in the scores of text inside a suspect element that stays.
SUSPECTED = 0.3


class Element:
    """One open element: the numbers of the container and of the innermost suspect element it is or lies in."""

    __slots__ = ("container", "dropped", "name", "suspect")

    def __init__(self, name: str, container: int, dropped: bool, suspect: int):
        self.name, self.container, self.dropped, self.suspect = name, container, dropped, suspect


def described(name: str, attributes: str) -> tuple[str, bool, bool]:
    """The element's step in a path, whether it holds no main text, and whether its words say so."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    classes = [re.sub(r"\d+", "", part) for part in entities.unescape(found.get("class", "")).lower().split()]
    tokens = [*classes, *found.get("id", "").lower().split()]
    words = set(_WORDS.findall(" ".join(token for token in tokens if not _LAYOUT.match(token))))
    dropped = name in DROPPED or found.get("role", "").lower() in DROPPED_ROLES
    # the outermost elements often carry words about the whole layout
    suspect = name not in ("html", "body", "article", "main") and bool(words & SUSPECT_WORDS)
    return ".".join([name, *sorted(filter(None, classes))]).replace("/", ""), dropped, suspect


class Page:
    """Reads one page into ``blocks`` of text, in one pass whose work grows with the page, however broken it is.

    Containers are numbered as they open. Of each ``parents`` has the one around it, ``steps`` its step in a path, ``paths`` a
    digest of its whole path, and ``spans`` its first block and the one after its last. ``weights`` and ``linked`` (characters in
    links) belong to the blocks.
    """

    def __init__(self, source: str):
        self.blocks: list[str] = []
        self.linked: list[int] = []
        self.homes: list[tuple[int, int]] = []
        self.parents, self.steps, self.paths, self.spans = [-1], ["body"], [xxhash.xxh3_128_digest(b"body")], [[0, 0]]
        self.suspects: list[int] = []
        self.open = [Element("", 0, False, -1)]
        self.named: Counter[str] = Counter()
        self.breaks: list[int] = []
        self.parts: list[str] = []
        self.in_links = 0
        at, last = 0, source.rfind(">")
        while at <= last:
            token = _TOKEN.search(source, at)
            self.text(source[at : token.start() if token else len(source)])
            if not token:
                at = len(source)
                break
            at = token.end()
            if token[1]:
                self.end(token[1].lower())
            elif token[2]:
                name = token[2].lower()
                if name in RAW and not token[3].endswith("/"):
                    close = re.compile(f"</{re.escape(name)}\\b[^>]*>", re.I).search(source, at)
                    self.break_block(name)
                    at = close.end() if close else len(source)
                else:
                    self.start(name, token[3])
        rest = source[at:]
        comment = rest.find("<!--")  # an unclosed one takes the rest
        self.text(rest if comment < 0 else rest[:comment])
        self.flush()
        self.close(1)
        self.spans[0][1] = len(self.blocks)
        self.weights = [1.0] * len(self.blocks)
        if self.suspects:
            self.judge()

    def judge(self) -> None:
        """Leave out the blocks inside suspect elements with a minor share of the page's text."""
        sizes = [len(text) for text in self.blocks]
        held, total = [0] * len(self.suspects), sum(sizes)
        for (_, suspect), size in zip(self.homes, sizes, strict=True):
            if suspect >= 0:
                held[suspect] += size
        for suspect in range(len(held) - 1, -1, -1):  # those around an element have smaller numbers
            if self.suspects[suspect] >= 0:
                held[self.suspects[suspect]] += held[suspect]
        cleared = [2 * size > total for size in held]

        def stays() -> list[bool]:
            whole = []  # whether an element and all suspects around it are cleared
            for suspect, around in enumerate(self.suspects):
                whole.append(cleared[suspect] and (around < 0 or whole[around]))
            return [suspect < 0 or whole[suspect] for _, suspect in self.homes]

        kept = stays()
        if 4 * sum(size for size, one in zip(sizes, kept, strict=True) if one) < total:
            largest = max((suspect for suspect, clear in enumerate(cleared) if not clear), key=held.__getitem__)
            while largest >= 0:
                cleared[largest], largest = True, self.suspects[largest]
            kept = stays()
        places = [0, *itertools.accumulate(map(int, kept))]
        self.spans = [[places[first], places[end]] for first, end in self.spans]
        self.weights = [1.0 if suspect < 0 else SUSPECTED for (_, suspect), one in zip(self.homes, kept, strict=True) if one]
        self.blocks, self.linked, self.homes = (
            list(itertools.compress(column, kept)) for column in (self.blocks, self.linked, self.homes)
        )

    def text(self, raw: str) -> None:
        if raw and not self.open[-1].dropped:
            decoded = entities.unescape(raw) if "&" in raw else raw
            self.parts.append(decoded)
            if self.named["a"]:
                self.in_links += len(decoded)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(text)
                self.linked.append(self.in_links)
                self.homes.append((self.open[-1].container, self.open[-1].suspect))
            self.parts, self.in_links = [], 0

    def break_block(self, name: str) -> None:
        if name in BREAKS:
            self.flush()

    def start(self, name: str, attributes: str) -> None:
        self.break_block(name)
        if name in BREAKS and name != "br" and self.breaks and self.open[self.breaks[-1]].name in ENDED_BY_BLOCK:
            self.close(self.breaks[-1])
        if name in VOID:
            return
        inside = self.open[-1]
        step, dropped, suspect = described(name, attributes)
        if name == "header" and (self.named["article"] or self.named["main"]):
            dropped = False  # that of the article, not of the page
        if (dropped or suspect) and not inside.dropped:
            self.flush()
        element = Element(name, inside.container, inside.dropped or dropped, inside.suspect)
        if suspect and not element.dropped:
            self.suspects.append(inside.suspect)
            element.suspect = len(self.suspects) - 1
        if name in CONTAINERS - {"html", "body"}:
            self.parents.append(inside.container)
            self.steps.append(step)
            self.paths.append(xxhash.xxh3_128_digest(self.paths[inside.container] + step.encode()))
            element.container = len(self.parents) - 1
            self.spans.append([len(self.blocks), len(self.blocks)])
        if name in BREAKS:
            self.breaks.append(len(self.open))
        self.named[name] += 1
        self.open.append(element)

    def close(self, at: int) -> None:
        """Close the open elements from that place on."""
        while len(self.open) > at:
            element = self.open.pop()
            self.named[element.name] -= 1
            if element.container != self.open[-1].container:
                self.spans[element.container][1] = len(self.blocks)
        while self.breaks and self.breaks[-1] >= at:
            self.breaks.pop()

    def end(self, name: str) -> None:
        self.break_block(name)
        if not self.named[name]:
            return
        at = len(self.open) - 1
        while self.open[at].name != name:
            at -= 1
        if any(element.dropped for element in self.open[at:]) or self.open[-1].suspect != self.open[at - 1].suspect:
            self.flush()
        self.close(at)


def promise(step: str) -> float:
    """What the last step of a path says about the text below it."""
    name, *classes = step.split(".")
    if name == "article":
        return 2.0
    if name == "main":
        return 1.6
    if PROMISING_WORDS & set(_WORDS.findall(" ".join(classes))):
        return 1.5
    return 1.0


def scores(page: Page) -> dict[bytes, tuple[float, list[list[int]]]]:
    """Score and spans of every container path of a page, by the path's digest."""
    held, depths = [0.0] * len(page.parents), [1] * len(page.parents)
    for (container, _), text, linked, weight in zip(page.homes, page.blocks, page.linked, page.weights, strict=True):
        held[container] += max(len(text) - linked, 0) * weight
    total = sum(held) or 1
    for container in range(len(held) - 1, 0, -1):  # those around a container have smaller numbers
        held[page.parents[container]] += held[container]
    found: dict[bytes, tuple[float, list[list[int]]]] = {}
    for container, (path, span) in enumerate(zip(page.paths, page.spans, strict=True)):
        if container:
            depths[container] = depths[page.parents[container]] + 1
        if span[0] < span[1]:
            share = held[container] / total * (promise(page.steps[container]) + 0.01 * depths[container])
            score, spans = found.get(path, (0.0, []))
            spans.append(span)
            found[path] = (score + share, spans)
    return found


_SCORES = pa.list_(pa.struct([("path", pa.binary()), ("score", pa.float64()), ("spans", pa.list_(pa.list_(pa.int32())))]))
READ = "blocks array<string>, scores array<struct<path:binary,score:double,spans:array<array<int>>>>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        found = [Page(source or "") for source in batch.column("html").to_pylist()]
        columns = {name: batch.column(name) for name in ("page_id", "url", "host")}
        columns["blocks"] = pa.array([page.blocks for page in found], pa.list_(pa.string()))
        voted = [
            [{"path": path, "score": score, "spans": spans} for path, (score, spans) in scores(page).items()] for page in found
        ]
        columns["scores"] = pa.array(voted, _SCORES)
        yield pa.RecordBatch.from_pydict(columns)


def extracted(pages: DataFrame, tables: WorkTables) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    source = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    kind = source.schema["page_id"].dataType.simpleString()
    read = tables.save(source.mapInArrow(_read, schema=f"page_id {kind}, url string, host string, {READ}"), "read")
    votes = read.select("host", F.explode("scores").alias("s")).groupBy("host", "s.path").agg(F.sum("s.score").alias("votes"))
    best = F.max_by("path", F.struct(F.round("votes", 6), "path")).alias("winner")
    winners = votes.groupBy("host").agg(best).withColumnRenamed("host", "voted")
    hosts = read.groupBy("host").agg(F.count("*").alias("n"))
    hosts = tables.save(hosts.join(winners, F.col("host").eqNullSafe(F.col("voted")), "left").drop("voted"), "winners")
    joined = with_totals(read, hosts, "host", "n")
    chosen = F.filter("scores", lambda s: s["path"] == F.col("winner"))
    own = F.array_max(F.transform("scores", lambda s: F.struct(s["score"].alias("score"), s["path"].alias("path"), s["spans"].alias("spans"))))
    spans = F.coalesce(F.get(chosen, F.lit(0))["spans"], own["spans"], F.array().cast("array<array<int>>"))
    parts = F.transform(spans, lambda span: F.slice("blocks", span[0] + 1, span[1] - span[0]))
    text = F.array_join(F.flatten(parts), "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
