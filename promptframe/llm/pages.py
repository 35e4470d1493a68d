"""Main text of web pages by block rules in two passes.

A page is cut into blocks of text at block elements. The first pass classifies each block by its
length, its density of stop words and the share of its text inside links: good, bad, near good or
short. Blocks inside elements that never hold an article (menus, headers, footers, forms, and
elements whose class, id or role names a sidebar, an advert, a notice or comments) are bad. In the
second pass short and near-good blocks inherit the label of the nearest decided blocks on both
sides, within their own article where there is one: good between two good ones; where the sides
differ, near-good blocks and headings right before a good block are good. An article without any
good block keeps its undecided ones, since a short article has nothing to inherit from. A page in a
language without a list of stop words is judged by length and links.

A null page counts as empty. A page without blocks has the empty text. Broken markup (missing end
tags, a lone ``<``) is read as browsers would in simple cases; comments, scripts and styles never
reach a block. Very long pages are read whole, and an empty table has no results. Inside an article a block of links or of signs alone is undecided, never bad by itself.
Repeated rows each get their own result; extra columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptframe.llm.quality import STOP_WORDS
from promptframe.llm.registry import query, table, text_or_empty

# Elements by their role in a page.
BLOCKS = frozenset("""
address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead
tr ul br option head title template
""".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Their content is not text.
RAW = frozenset("script style noscript template iframe object svg math textarea select button title head".split())
#: Never part of an article.
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLES = frozenset("article main".split())
#: A start tag of the key ends an open element of the values.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
#: Parts of names in class, id or role of what is not the article.
UNWANTED = re.compile(
    r"ads?|advert\w*|banners?|breadcrumbs?|comments?|contentinfo|cookies?|consent|disqus|footer|masthead|menus?|modal|"
    r"nav\w*|newsletters?|notices?|pagination|popups?|promo\w*|related|repl(?:y|ies)|share|sharing|sidebar|social|"
    r"sponsor\w*|subscribe|subscription|toolbar|widgets?", re.IGNORECASE)
#: Parts that say nothing by themselves, as in ``comment-list``.
NEUTRAL = re.compile(
    r"the|a|js|is|has|site|page|main|post|article|block|box|bar|area|list|item|items|wrap|wrapper|container|section|content|"
    r"inner|outer|top|bottom|left|right|links?|buttons?|icons?|form|signup|slot|unit|panel|holder|region|group|row|col|"
    r"thread|reader|user|media|network|sticky|overlay|dialog|inline|\d+|", re.IGNORECASE)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: A slash that ends a tag, not an attribute without quotes.
_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""")
#: Elements of other languages, which a slash does end.
FOREIGN = frozenset("svg math".split())
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    """Thresholds of the first pass."""

    short: int = 70
    long: int = 200
    many_links: float = 0.2
    stop_low: float = 0.08
    stop_high: float = 0.12
    #: A page with fewer stop words than this is judged by length and links alone.
    unknown: float = 0.02
    stop_words: frozenset = frozenset(STOP_WORDS)


@dataclass
class Block:
    """Text between two block tags, with what the rules need to know of it."""

    text: str
    linked: int
    heading: bool
    outside: bool
    article: int


def attributes_of(rest: str) -> dict[str, str]:
    """The attributes of a start tag; of repeated ones the first counts."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return found


def unwanted_names(element: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether class, id or role name something that is not the article.

    Outside an article one part of a name is enough. Inside, a whole name must consist of such parts
    (and neutral ones), headings are never unwanted, and sections not by their id, which may be a topic.
    """
    if inside and element in HEADINGS:
        return False
    kinds = ("class", "role") if inside and element in ("section", "article") else ("class", "id", "role")
    for name in " ".join(attributes.get(k, "") for k in kinds).split():
        parts = re.split("[_-]+", name)
        named = [bool(UNWANTED.fullmatch(p)) for p in parts]
        if any(named) and (not inside or all(n or NEUTRAL.fullmatch(p) for n, p in zip(named, parts, strict=True))):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order."""
    out: list[Block] = []
    parts: list[str] = []
    links: list[str] = []
    open_tags: list[tuple[str, bool, int, bool]] = []  # name, outside, article, heading
    state = (False, 0, False)
    in_link, articles, at = 0, 0, 0

    def end_block() -> None:
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            linked = len(_SPACE.sub(" ", "".join(links)).strip())
            out.append(Block(text, linked, state[2], state[0], state[1]))
        parts.clear()
        links.clear()

    def add(raw: str) -> None:
        if raw:
            text = unescape(raw)
            parts.append(text)
            if in_link:
                links.append(text)

    while True:
        m = _TOKEN.search(page, at)
        add(page[at:m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            if name in BLOCKS:
                end_block()
            if name == "a":
                in_link = max(0, in_link - 1)
            names = [t[0] for t in open_tags]
            if name in names:
                del open_tags[len(names) - 1 - names[::-1].index(name):]
        else:
            if name in RAW and not (name in FOREIGN and _CLOSED.search(rest)):
                if name in BLOCKS:
                    end_block()
                stop = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                if name == "head":  # an unclosed head ends where the body starts
                    body = re.compile(r"<body\b", re.IGNORECASE).search(page, at)
                    at = min([x for x in (stop.end() if stop else None, body.start() if body else None) if x is not None],
                             default=at)
                else:
                    at = stop.end() if stop else len(page)
                continue
            if name in BLOCKS:
                end_block()
            if name == "a":
                in_link += 1
            if name in VOID or _CLOSED.search(rest):
                continue
            while open_tags and open_tags[-1][0] in ENDS.get(name, ()):
                open_tags.pop()
            attributes = attributes_of(rest)
            outside, article, heading = (open_tags[-1][1], open_tags[-1][2], open_tags[-1][3]) if open_tags else state
            unwanted = name in OUTSIDE or "hidden" in attributes or attributes.get("aria-hidden") == "true"
            unwanted |= name == "header" and not article
            unwanted |= name not in ("html", "body", "article", "main") and unwanted_names(name, attributes, bool(article))
            if name in ARTICLES and not outside and not article:
                articles += 1
                article = articles
            if name != "p" or not open_tags or open_tags[-1][0] != "p":
                open_tags.append((name, outside or unwanted, article, heading or name in HEADINGS))
        top = open_tags[-1] if open_tags else ("", False, 0, False)
        state = (top[1], top[2], top[3])
    end_block()
    return out


def first_pass(block: Block, settings: Settings) -> str:
    """good, bad, near or short by the block alone."""
    words = [w.lower() for w in _WORD.findall(block.text)]
    if block.outside:
        return "bad"
    if not words or block.linked / len(block.text) > settings.many_links:
        # inside an article it may be a reference line or a break: its neighbours decide
        return "bad" if not block.article else "short" if len(block.text) < settings.short else "near"
    dense = sum(w in settings.stop_words for w in words) / len(words)
    if len(block.text) < settings.short:
        return "short"
    if dense >= settings.stop_high:
        return "good" if len(block.text) > settings.long else "near"
    if dense >= settings.stop_low:
        return "near"
    # inside an article a block without stop words may be a table or code: its neighbours decide
    return "near" if block.article else "bad"


def without_list(found: list[Block], settings: Settings) -> bool:
    """Whether a page's language has no stop words here: hardly any word of its long blocks is one."""
    words = [w.lower() for b in found if not b.outside and len(b.text) > settings.short
             and b.linked <= settings.many_links * len(b.text) for w in _WORD.findall(b.text)]
    return sum(w in settings.stop_words for w in words) < settings.unknown * len(words)


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Whether each block is part of the main text, after the undecided inherit."""
    keep = [label == "good" for label in labels]
    decided = [k for k, label in enumerate(labels) if label in ("good", "bad")]
    with_good = {b.article for b, good in zip(found, keep, strict=True) if good}
    before, after, last = [], [], None
    for k, label in enumerate(labels):
        before.append(last)
        last = k if label in ("good", "bad") else last
    last = None
    for k in range(len(labels) - 1, -1, -1):
        after.append(last)
        last = k if labels[k] in ("good", "bad") else last
    after.reverse()
    for k, label in enumerate(labels):
        if label in ("good", "bad"):
            continue
        block = found[k]
        if block.article and block.article not in with_good:
            keep[k] = True
            continue
        # neighbours outside an article say nothing about a block inside it
        sides = [labels[n] for n in (before[k], after[k])
                 if n is not None and (not block.article or found[n].article == block.article and not found[n].outside)]
        good = sum(s == "good" for s in sides)
        if good == len(sides) and good:
            keep[k] = True
        elif good:
            near = after[k] is not None and labels[after[k]] == "good"
            keep[k] = label == "near" or block.heading and near or bool(block.article)
        elif not sides:
            keep[k] = label == "near" or bool(block.article)
    return keep if decided or any(keep) else [b.article > 0 or label == "near" for b, label in zip(found, labels, strict=True)]


def main_text(page: str, settings: Settings = Settings()) -> str:
    """The article of a page, its blocks joined by one space.

    Where a page has articles, blocks outside them are not part of the main text.
    """
    found = blocks(page)
    if without_list(found, settings):
        settings = replace(settings, stop_low=0.0, stop_high=0.0)
    labels = [first_pass(b, settings) for b in found]
    keep = second_pass(found, labels)
    inside = any(k and b.article for b, k in zip(found, keep, strict=True))
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k and (b.article or not inside))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"),
            settings: Settings = Settings()) -> DataFrame:
    """The columns of ``keep`` and ``text`` of every page."""
    rows = pages.select(*[pages[c].alias(c) for c in keep], text_or_empty(html_col).alias("_html"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, settings) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


#: The given pages mark their article, which SQL can cut out; other pages need the rules.
SQL = r"""
SELECT page_id, url, text, length(text) AS n_chars FROM (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(
    regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(h1|p|br)>', ' ', 'g'), '<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text
  FROM pages)
"""


@query(SQL)
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    texts = extract(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
