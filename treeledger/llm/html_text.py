"""Main text of web pages: containers scored per page, tag-class paths voted on per host, and text taken by the winning path."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Share of a container's paragraphs that its parent gets as well.
PARENT_SHARE = 0.5
# A character inside a link counts against a container by this much.
LINK_PRICE = 2.0

# Elements without content, elements whose content is not markup, and elements that begin a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
# Elements that an equal or related start tag closes.
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
# An element that stops the search for one to close.
SCOPE = frozenset("table ul ol dl article main section body html".split())
# Elements, and words in classes, ids and roles, that are not part of the main text.
ASIDE_TAGS = frozenset("head nav footer aside form button select svg canvas object audio video dialog menu".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices "
    "pagination paywall popup promo promotion related search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe toolbar widget".split()
)
# A page header, unlike the header of an article, is not part of the main text.
HEADER_WORDS = frozenset(["header", "topbar"])
MAIN_TAGS = ("article", "main")
# Elements that are text themselves: only a class that names an advertisement takes them out.
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising promo promotion sponsor sponsored".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    """A run of text between block boundaries: its text, how much of it is links, and the path of the element around it, as
    steps and as numbers of the page's elements."""

    text: str
    links: int
    path: tuple[str, ...]
    numbers: tuple[int, ...] = ()


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    steps: list[str] = field(default_factory=list)
    numbers: list[int] = field(default_factory=list)
    opened: int = 0
    outside: int = -1  # depth of the element that is not main text, if one is open
    linked: int = 0
    held: list[str] = field(default_factory=list)
    held_links: int = 0

    def flush(self) -> None:
        if self.held:
            text = " ".join(html.unescape("".join(self.held)).split())
            if text:
                around = [k for k, t in enumerate(self.tags) if t in BLOCK]
                path = tuple(self.steps[k] for k in around)
                self.blocks.append(Block(text, self.held_links, path, tuple(self.numbers[k] for k in around)))
            self.held = []
        self.held_links = 0

    def text(self, piece: str) -> None:
        if self.outside < 0 and piece:
            self.held.append(piece)
            if self.linked:
                self.held_links += len(piece)

    def close_to(self, depth: int) -> None:
        """Close the elements from this depth on."""
        if any(tag in BLOCK for tag in self.tags[depth:]):
            self.flush()
        self.linked -= self.tags[depth:].count("a")
        del self.tags[depth:], self.steps[depth:], self.numbers[depth:]
        if self.outside >= depth:
            self.outside = -1

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.flush()
            if "p" in self.tags:
                self.close_to(len(self.tags) - 1 - self.tags[::-1].index("p"))
            if tag in MAIN_TAGS and self.outside >= 0 and self.tags[self.outside] in ASIDE_TAGS | {"header"}:
                self.close_to(self.outside)
            for depth in range(len(self.tags) - 1, -1, -1):
                if self.tags[depth] in CLOSED_BY.get(tag, ()):
                    self.close_to(depth)
                    break
                if self.tags[depth] in SCOPE:
                    break
        elif tag == "br":
            self.text(" ")
        if tag in VOID:
            return
        inside_main = any(t in self.tags for t in MAIN_TAGS)
        step, words = tag, set()
        if attributes:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            classes = sorted({re.sub(r"\d+", "", c.lower()) for c in found.get("class", "").split()} - {""})
            step = ".".join([tag, *classes])
            if tag in TEXT_TAGS:
                words = ADVERT_WORDS.intersection(classes)
            elif inside_main:
                # Ids are made from headings here, and classes of several words may be about the subject.
                words = {*classes, *found.get("role", "").lower().split()}
            else:
                words = set(_NAME.findall(_CAMEL.sub(" ", " ".join(found.values())).lower()))
        is_aside = tag in ASIDE_TAGS or (tag not in ("html", "body", *MAIN_TAGS) and bool(words & ASIDE_WORDS))
        is_aside |= not inside_main and (tag == "header" or (tag not in ("html", "body") and bool(words & HEADER_WORDS)))
        is_aside |= tag in MAIN_TAGS and bool(words & {"comment", "comments"})
        is_aside |= tag not in ("html", "body") and bool(attributes) and _HIDDEN.search(attributes) is not None
        if is_aside and self.outside < 0:
            self.flush()
            self.outside = len(self.tags)
        self.tags.append(tag)
        self.steps.append(step)
        self.numbers.append(self.opened)
        self.opened += 1
        self.linked += tag == "a"

    def end(self, tag: str) -> None:
        if tag in self.tags:
            depth = len(self.tags) - 1 - self.tags[::-1].index(tag)
            # An inline end tag does not close blocks; one inside an aside does not end it.
            if tag in BLOCK or tag in ASIDE_TAGS or not any(t in BLOCK for t in self.tags[depth:]):
                self.close_to(depth)
        elif tag == "p":
            self.flush()


def read_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, without anything outside the main text. Broken markup is read as browsers do, roughly."""
    reader = _Reader()
    at = 0
    while True:
        match = _TOKEN.search(page, at)
        if match is None:
            reader.text(page[at:])
            break
        reader.text(page[at : match.start()])
        at = match.end()
        tag = (match[2] or match[5] or "").lower()
        if not tag:
            continue
        if match[1] or match[4]:
            reader.end(tag)
        elif tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = closing.end() if closing else len(page)
        else:
            attributes = match[3] or match[6] or ""
            reader.start(tag, attributes)
            if attributes.endswith("/") and tag not in VOID and tag not in BLOCK:
                reader.end(tag)
    reader.flush()
    return reader.blocks


def _container(path: tuple[str, ...]) -> tuple[str, ...]:
    """The container that a block's path stands for: its article or main element, or the parent of a paragraph-like element."""
    for name in MAIN_TAGS:
        for depth, step in enumerate(path):
            if step.split(".")[0] == name:
                return path[: depth + 1]
    tag = path[-1].split(".")[0] if path else ""
    return path if tag in ("div", "section", "td", "body", "center") or len(path) < 2 else path[:-1]


def _repeated(blocks: list[Block]) -> set[int]:
    """Numbers of the elements beside which their parent has another one of the same step that holds text."""
    seen: dict[tuple[int, str], int] = {}
    known: set[int] = set()
    out: set[int] = set()
    for block in blocks:
        for depth in range(len(block.numbers) - 1, 0, -1):
            number = block.numbers[depth]
            if number in known:
                break
            known.add(number)
            first = seen.setdefault((block.numbers[depth - 1], block.path[depth]), number)
            if first != number:
                out.update((first, number))
    return out


def score_containers(blocks: list[Block]) -> dict[str, float]:
    """How much text, less links, every container of a page holds; a parent gets a share of what its children hold.

    Containers of which a parent has several are pieces of the text, like paragraphs, and stand for the parent.
    """
    scores: dict[str, float] = defaultdict(float)
    repeated = _repeated(blocks)
    for block in blocks:
        value = len(block.text) - LINK_PRICE * block.links
        path = _container(block.path)
        size = len(path)
        while size > 1 and path[-1].split(".")[0] not in MAIN_TAGS and block.numbers[size - 1] in repeated:
            size -= 1
        if path:
            scores[">".join(path[:size])] += value
        if len(path) > 1 and size < len(path):
            scores[">".join(path[:size])] += PARENT_SHARE * value
        elif len(block.path) > 1:
            scores[">".join(block.path[:-1])] += PARENT_SHARE * value
    return {path: score for path, score in scores.items() if score > 0}


def extract(blocks: list[Block], path: str | None) -> str:
    """The blocks below a path, joined by blank lines; below the page's own best container where the path has none."""
    own = score_containers(blocks)
    best = min(own, key=lambda p: (-own[p], p)) if own else None
    for chosen in (path, best):
        if chosen is not None:
            steps = tuple(chosen.split(">"))
            taken = [b.text for b in blocks if b.path[: len(steps)] == steps]
            if taken:
                return "\n\n".join(taken)
    return "\n\n".join(b.text for b in blocks)


def host_of(url: Column) -> Column:
    """The host of an address in lower case, null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]+)", 1))
    return F.when(found != "", found)


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page.

    Every page scores its containers; shares of a page's score are votes for generalised tag-class paths (digits dropped from
    classes), added up per host; every page of a host is then read by the winning path, ties to the first by name. A page
    without a host, or without anything below the path, is read by its own best container. A null page is an empty one and gives an
    empty text. Rows are independent but for the votes: repeated rows vote repeatedly and get equal texts, null ids and
    addresses stay null, an empty table gives no row; other columns are not read.

    Votes are added up before they meet, a few rows per host; the winners are joined to the pages by host and broadcast only
    while Spark measures them to be small.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            votes: dict[tuple[str, str], float] = defaultdict(float)
            for host, page in zip(batch["host"], batch["html"], strict=True):
                scores = score_containers(read_blocks(page))
                total = sum(scores.values())
                for path, score in scores.items():
                    votes[host, path] += score / total
            yield pd.DataFrame([(h, p, v) for (h, p), v in votes.items()], columns=["host", "path", "votes"])

    votes = rows.where(F.col("host").isNotNull()).select("host", "html").mapInPandas(vote, "host string, path string, votes double")
    # Sums are rounded, so that their order cannot turn a tie.
    totals = votes.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    winners = totals.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("order"), "path")).alias("best"))
    winners = winners.select("host", F.col("best.path").alias("path"))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(read_blocks(page), path) for page, path in zip(batch["html"], batch["path"], strict=True)]
            made = batch[["page_id", "url"]].copy()
            made["text"] = texts
            made["n_chars"] = [len(text) for text in texts]
            yield made

    kind = pages.schema["page_id"].dataType.simpleString()
    told = rows.join(winners, "host", "left").select("page_id", "url", "html", "path")
    return told.mapInPandas(take, f"page_id {kind}, url string, text string, n_chars long")
