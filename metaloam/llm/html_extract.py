"""Main text of web pages by template deduction over equivalence classes of tokens.

Pages of one host are dealt into blocks of bounded size. In a block, tokens (tags and words, each with the path of
elements around it) with the same vector of occurrences over the pages form an equivalence class. A class is valid if its
tokens stand in the same order in each page that has it, and classes nest: a class lies in one gap of another, or isn't
used. Its tokens occur in half of the pages, and three, at least: fewer pages may share a passage of main text. Classes are
deduced from the whole block, and again from its pages of each layout (equal containers), so that a layout of few pages has
a template too. The template is the tree of valid classes, each in its gap of the class around it; the stretches of a page
between its template tokens are the slots, and the text is what stands in slots. A block (paragraph, heading, cell) that a
slot reaches into is taken whole; one of template words alone has no slot and is left out, inside an article too.

Slots are read by where they lie: those inside elements that hold menus, headers, footers, sidebars, notices, adverts,
forms or comments are left out, by element, role or name; an article or main element, where there is one, holds the main
text, and inside it fewer names count. Without one, runs of two blocks or more that are links alone are a menu.

Defined results: a null or empty html has an empty text; a null url, and one without ``://``, belongs to the host ''.
Repeated rows each get a row; equal pages count once in a template and each gets its text; pages whose host has too few
others go by their own structure alone; so do rows of one page_id and url beyond a block's size, which are dealt to blocks
of their own. Pages of any length are taken whole, one at a time beside their tokens. Extra columns are ignored. An empty
table gives none.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloam.llm.common import ascii_lower, bounded_batches, stored, table

#: Pages of a host that one template is deduced from, in the mean.
BLOCK_PAGES = 48
#: Hosts with more pages than a block whose list is broadcast at most.
BROADCAST_HOSTS = 200_000
#: Pages that a class must occur in (and half of those it is deduced from), and tokens that it must have.
SUPPORT, CLASS_SIZE = 3, 3

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark math object q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
RAW = frozenset("script style noscript template textarea iframe title".split())
#: Elements that hold no main text, and names of classes and ids that say so.
ASIDE = frozenset("nav aside footer form button select option dialog menu head fieldset datalist".split())
MAIN = frozenset(("article", "main"))
SAYS_ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices popup modal overlay newsletter sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus masthead topbar toolbar".split()
)
#: Names that say so only outside an article, and only if all parts of the name are such or structural.
MAY_ASIDE = frozenset("subscribe subscription signup login alert alerts reply replies respond discussion share sharing social related recommended recommendations widget widgets search pagination pager copyright skip feedback rating".split())
STRUCTURAL = frozenset("bar bars box boxes list lists link links button buttons container wrapper section block area icons items content inner main post page".split())
SAYS_HEADER = frozenset("header head masthead".split())
SAYS_MAIN = frozenset("main article content body container wrapper layout page post entry story text".split())
ROLES_ASIDE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_TAG = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([A-Za-z:_-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_END = re.compile(r"</([A-Za-z][^\s/>]*)\s*>")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Text:
    """A run of text: its block, where its words begin among the page's tokens, and what the elements around it are."""

    block: int
    first: int
    text: str
    aside: bool
    main: bool
    link: bool


@dataclass
class Page:
    """``tokens``: the path of elements (as a number) and a tag or word each. ``containers``: those that make a layout."""

    texts: list[Text] = field(default_factory=list)
    tokens: list[tuple[int, str]] = field(default_factory=list)
    containers: set[tuple[int, str]] = field(default_factory=set)


def _aside(name: str, attributes: str, in_main: bool) -> bool:
    if name in ASIDE or name == "header" and not in_main:
        return True
    if name in ("html", "body", "main", "article") and not attributes:
        return False
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if found.get("role", "").lower() in ROLES_ASIDE or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    if name in ("html", "body", "main"):
        return False
    for value in (found.get("class", ""), found.get("id", "")):
        for one in value.split():
            names = {x.lower() for x in _NAME.findall(one)}
            if names & SAYS_ASIDE and not names & {"has", "with", "no", "without"} and not (names & SAYS_MAIN and names & SAYS_ASIDE <= {"sidebar", "widget", "nav", "menu"}):
                return True
            if not in_main and (names & MAY_ASIDE and names <= MAY_ASIDE | STRUCTURAL or names & SAYS_HEADER and name not in ("h1", "h2", "h3")):
                return True
    return False


def parse(page: str | None) -> Page:
    """Texts and tokens of a whole page in order; tolerates elements that are not closed. Time grows with its length."""
    out, page = Page(), page or ""
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in _END.finditer(page):
        ends.setdefault(m[1].lower(), []).append(m.span())
    # stack of (name, path, aside, main, link)
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    at, block = 0, 0

    def text(end: int) -> None:
        if end > at:
            _, path, aside, main, link = stack[-1]
            run = entities.unescape(page[at:end])
            out.texts.append(Text(block, len(out.tokens), run, aside, main, link))
            out.tokens.extend((path, w) for w in run.split())

    while got := _TAG.search(page, at):
        text(got.start())
        at = got.end()
        name = (got[2] or got[5] or "").lower()
        if not name:
            continue
        if name == "br":  # white space within the block
            _, path, aside, main, link = stack[-1]
            out.texts.append(Text(block, len(out.tokens), " ", aside, main, link))
        elif name not in INLINE and name not in RAW:
            block += 1
        if got[1] or got[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    out.tokens.append((stack[i][1], f"</{name}>"))
                    del stack[i:]
                    break
            continue
        attributes = got[3] or got[6] or ""
        if name == "p" or name in ("li", "tr", "td", "th", "dd", "dt"):  # these end a like element that was left open
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                if i >= len(stack) or stack[i][0] not in INLINE:
                    break
        _, path, aside, main, link = stack[-1]
        path = hash((path, name))
        holds = name in ("div", "section", "ul", "table")
        out.tokens.append((path, f"<{name}{' ' + attributes.strip() if holds else ''}>"))
        if name in ("div", "section"):
            out.containers.add(out.tokens[-1])
        own = ends.get(name, [])
        if name in RAW:
            i = bisect_left(own, (at, 0))
            if i < len(own):
                at = own[i][1]
            elif name in ("script", "style"):
                at = len(page)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if not aside and _aside(name, attributes, main):
            aside = bool(own) and own[-1][0] >= at  # one that is never closed would hold the whole rest
        stack.append((name, path, aside, main or name in MAIN, link or name == "a"))
    text(len(page))
    return out


@dataclass
class EquivalenceClass:
    """Tokens in their order, how often each page has them, and the class and gap (after its token of that number) around
    this one; None for a class that no other one holds.
    """

    vector: tuple[int, ...]
    tokens: list[tuple[int, str]]
    parent: int | None = None
    gap: int | None = None


def classes(pages: list[Page], support: int = SUPPORT, least: int = CLASS_SIZE) -> list[EquivalenceClass]:
    """Valid, nested equivalence classes of a block of pages, the most frequent first."""
    counts = [Counter(p.tokens) for p in pages]
    spread = Counter(itertools.chain.from_iterable(counts))
    groups: dict[tuple[int, ...], list[tuple[int, str]]] = {}
    for token, n in spread.items():
        if n >= max(support, len(pages) // 2):
            groups.setdefault(tuple(c.get(token, 0) for c in counts), []).append(token)
    groups = {v: t for v, t in groups.items() if len(t) >= least}
    wanted = set(itertools.chain.from_iterable(groups.values()))
    places: list[dict[tuple[int, str], list[int]]] = []
    for p in pages:
        own: dict[tuple[int, str], list[int]] = {}
        for i, t in enumerate(p.tokens):
            if t in wanted:
                own.setdefault(t, []).append(i)
        places.append(own)
    # a valid class and, per page, the places of all its tokens, ascending
    valid: list[tuple[EquivalenceClass, list[list[int]]]] = []
    for vector, tokens in groups.items():
        order, spans = None, []
        for p, has, times in zip(pages, places, vector, strict=True):
            where = sorted(itertools.chain.from_iterable(has[t] for t in tokens)) if times else []
            seen = [p.tokens[i] for i in where]
            order = order or seen[: len(tokens)]
            if seen != order * times:
                break
            spans.append(where)
        else:
            valid.append((EquivalenceClass(vector, order or []), spans))
    valid.sort(key=lambda v: (-sum(map(bool, v[0].vector)), sum(v[0].vector), -len(v[0].tokens)))
    kept: list[tuple[EquivalenceClass, list[list[int]]]] = []
    for c, spans in valid:
        fits = True
        for k, (other, outer) in enumerate(kept):
            gaps = set()
            for a, b in zip(spans, outer, strict=True):
                if a and b and not (a[-1] < b[0] or a[0] > b[-1]):  # meets the other: each repeat must lie in one gap
                    for lo, hi in zip(a[:: len(c.tokens)], a[len(c.tokens) - 1 :: len(c.tokens)], strict=True):
                        before = bisect_left(b, lo)
                        if before != bisect_right(b, hi):
                            fits = False
                        if 0 < before < len(b):
                            gaps.add((before - 1) % len(other.tokens))
            if not fits or len(gaps) > 1:
                fits = False
                break
            if gaps:  # the last one found is the innermost: classes come from the most frequent to the least
                c.parent, c.gap = k, gaps.pop()
        if fits:
            kept.append((c, spans))
    return [c for c, _ in kept]


@dataclass
class Template:
    """The tree of classes, as the number and place of each of its tokens."""

    classes: list[EquivalenceClass] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.place = {t: (k, i) for k, c in enumerate(self.classes) for i, t in enumerate(c.tokens)}

    def slot_words(self, page: Page) -> list[bool]:
        """For each token of a page whether it stands in a slot: not a template token."""
        return [t not in self.place for t in page.tokens]

    def __or__(self, other: Template) -> Template:
        return Template([*self.classes, *other.classes])


def slots(page: Page, template: Template) -> Iterator[Text]:
    """The runs of text of the blocks that a slot of main text reaches into."""
    has_main = any(t.main and not t.aside and t.text.strip() for t in page.texts)
    free = template.slot_words(page)
    words: Counter[int] = Counter()
    linked: Counter[int] = Counter()
    filled: Counter[int] = Counter()
    for t in page.texts:
        n = len(t.text.split())
        words[t.block] += n
        linked[t.block] += n * t.link
        filled[t.block] += sum(free[t.first : t.first + n])
    shown = [t for t in page.texts if not t.aside and (t.main or not has_main)]
    with_words = [b for b in dict.fromkeys(t.block for t in shown) if words[b]]
    menu: set[int] = set()
    if not has_main:
        for alone, run in itertools.groupby(with_words, key=lambda b: linked[b] == words[b]):
            own = list(run)
            if alone and len(own) > 1:
                menu.update(own)
    for t in shown:
        if t.block not in menu and (filled[t.block] or not words[t.block]):
            yield t


def main_text(page: Page, template: Template) -> str:
    blocks: dict[int, list[str]] = {}
    for t in slots(page, template):
        blocks.setdefault(t.block, []).append(t.text)
    joined = (" ".join("".join(runs).split()) for runs in blocks.values())
    return " ".join(x for x in joined if x)


def deduce(pages: list[Page]) -> Template:
    """The template of pages; none of fewer than SUPPORT."""
    return Template(classes(pages) if len(pages) >= SUPPORT else [])


def extract_block(pages: list[str | None]) -> list[str]:
    """The main texts of a block of pages of one host."""
    parsed = {p: parse(p) for p in dict.fromkeys(pages)}
    distinct = list({tuple(p.tokens): p for p in parsed.values()}.values())
    alike: dict[frozenset, list[Page]] = {}
    for p in distinct:
        alike.setdefault(frozenset(p.containers), []).append(p)
    common = deduce(distinct)
    own = {k: common | deduce(v) if len(v) < len(distinct) else common for k, v in alike.items()}
    made = {k: main_text(p, own[frozenset(p.containers)]) for k, p in parsed.items()}
    return [made[p] for p in pages]


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1))


def extract(pages: DataFrame, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """page_id, url and text of each row of ``pages`` (page_id, url, html). One shuffle of the pages, by block."""
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html"), host_of(F.col("url")).alias("_host"), F.monotonically_increasing_id().alias("_place"))
    large = rows.groupBy("_host").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block_pages)
    large = large.select("_host", F.ceil(F.col("_n") / block_pages).cast("long").alias("_salts"))
    large = stored(large, "large-hosts")
    few = large.count() <= BROADCAST_HOSTS
    salted = rows.join(F.broadcast(large) if few else large, "_host", "left")
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("_salts", F.lit(1))))
    # rows of one page_id and url would all have one salt: beyond a block's size they are dealt by their place in the table
    often = rows.groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block_pages)
    often = stored(often.select(F.col("page_id").alias("_page"), F.col("url").alias("_url"), F.ceil(F.col("_n") / block_pages).cast("long").alias("_parts")), "repeated-pages")
    same = F.col("page_id").eqNullSafe(F.col("_page")) & F.col("url").eqNullSafe(F.col("_url"))
    salted = salted.join(F.broadcast(often) if often.count() <= BROADCAST_HOSTS else often, same, "left")
    salted = salted.withColumn("_part", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("_place"), "_parts")).otherwise(F.lit(-1).cast("long")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = ((*r[:3], r[3:]) for b in batches for r in zip(*(b[c] for c in ("_host", "_salt", "_part", "page_id", "url", "html")), strict=True))
        for _, group in itertools.groupby(each, key=lambda r: r[:3]):
            while part := list(itertools.islice(group, 4 * block_pages)):
                own = [r[3] for r in part]
                yield pd.DataFrame({"page_id": pd.array([None if pd.isna(r[0]) else int(r[0]) for r in own], "Int64"), "url": [r[1] for r in own], "text": extract_block([r[2] for r in own])})

    dealt = salted.select("_host", "_salt", "_part", "page_id", "url", "html").repartition("_host", "_salt", "_part").sortWithinPartitions("_host", "_salt", "_part", "page_id", "url")
    return dealt.mapInPandas(run, "page_id long, url string, text string")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
