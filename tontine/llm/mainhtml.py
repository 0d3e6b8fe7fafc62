"""Main text of web pages as the maximum-scoring subsequence of words and tags.

A page is read as a sequence of words and tags. A word scores +1; a tag scores a negative weight, or none, that depends
on its name. The contiguous region with the largest sum (one linear scan) holds the article; ties go to the earlier and
longer region. Text inside elements that never belong to an article (menus, forms, scripts, adverts by class, ...) is no
candidate: such an element enters the scan as one tag. Inside of an article only whole class, role or id tokens mark such
elements; a form that holds an article or most words of the page is a plain container.

Weights are learned. A page with exactly one ``article`` (or ``main``) element labels itself: what lies inside that
element is content. For each tag, ``log((outside + a) / (inside + a))`` counts how much more often it stands outside,
per page there and here; the cost is that ratio, scaled. Inside of an article element tags cost nothing, and leaving one
costs more than the words around it are worth: pages that label themselves have no article text elsewhere. Training reads a bounded sample of such pages, at most
``most_pages``, chosen by a hash of the url; without labelled pages the default costs hold.

Defined results
* null or empty html: empty text; markup that is never closed ends with the page;
* character references are decoded, white space inside a block becomes one space, blocks are joined by one space;
* a page without any word gives an empty text; repeated rows are answered each; extra columns are not read.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MOST_PAGES = 2000
#: Scale and bounds of the learned costs, in words.
SCALE, LEAST_COST, MOST_COST, SMOOTH = 4.0, 0.0, 40.0, 0.05
#: Cost of a tag never seen in training.
UNSEEN_COST = 1.0
#: Score of a word outside of the article element on a page that has one.
OUTER_WORD = 0.05
#: Cost of crossing the edge of an article element.
EDGE_COST = 1000.0

# Element names of the markup language by their use.
SKIPPED = frozenset(
    "script style noscript template svg math canvas iframe object audio video select button textarea form nav aside"
    " footer menu dialog head title".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Words in class, id or role that mark parts which are not the article (not after has-, with-, no-).
MARKED = re.compile(
    r"(?<![a-z0-9])(?<!has-)(?<!with-)(?<!no-)(?<!without-)(?:ads?|advert(?:s|isements?|ising)?|banners?|sponsor(?:s|ed)?"
    r"|promo(?:s|tions?|ted)?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlays?|newsletters?|subscri(?:be|bers?|ptions?)"
    r"|signup|login|paywall|sidebars?|side|widgets?|related|recommend(?:ed|ations?)?|shar(?:e|es|ed|ing)|social|comments?"
    r"|repl(?:y|ies)|respond|disqus|discussions?|nav|navigation|menus?|breadcrumbs?|pagination|pager|toolbars?|masthead|footer"
    r"|copyright|search|complementary|contentinfo|dialog|disclaimer|toc|form)"
    r"(?:area|bar|box|buttons?|container|content|form|icons?|links?|list|media|posts?|section|thread|wrap(?:per)?)?(?-i:(?![a-z]))",
    re.IGNORECASE,
)
#: Whole class, id or role tokens that mark such parts inside of an article too; whole classes and roles only.
PARTS = re.compile(
    r"(?:ads?|advert|banner|promo|sponsor|cookies?|consent|gdpr|newsletter|subscribe|signup|login|share|sharing|social|related"
    r"|recommended|comments?|search|widgets?)[-_]{1,2}(?:area|banner|bar|block|box|buttons?|container|form|icons?|label|links?|list|media|notice"
    r"|articles|posts?|stories|section|slot|thread|unit|widgets?|wrap(?:per)?)"
    r"|comments|respond|disqus[-_]thread|newsletter|paywall|sidebar|breadcrumbs?|pagination|navbar|toolbar|cookie-?banner",
    re.IGNORECASE,
)
TOKENS = re.compile(
    r"ads?|advert(?:s|isements?|ising)?|banners?|sponsor(?:s|ed)?|promo(?:s|tions?|ted)?|cookies?|gdpr|popup|modal|overlay|subscribe"
    r"|subscription|signup|login|widgets?|related|recommended|recommendations|share|sharing|social|comment|repl(?:y|ies)|disqus"
    r"|nav|navigation|menu|pager|masthead|footer|copyright|search|complementary|contentinfo|dialog|alert|toc|form",
    re.IGNORECASE,
)
MARKED_HEADER = re.compile(r"(?<![a-z0-9])(?<!has-)(?<!with-)(?<!no-)header", re.IGNORECASE)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+(?=>|\Z)|[^>]*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Parts of a page whose words nobody reads, and other tags.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|iframe|template)\b.*?(?:</\1[^>]*(?:>|\Z)|\Z)|<[^>]*(?:>|\Z)", re.DOTALL | re.IGNORECASE
)
FORM_END = re.compile(r"</?form[\s>]|\Z", re.IGNORECASE)
#: Elements whose id may name what their prose is about.
TITLED = frozenset("section h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset(("article", "main"))
#: Elements that a new one of the same name closes.
SELF_CLOSED = frozenset("p li dt dd tr td th option".split())


def count_words(markup: str) -> int:
    return len(MARKUP.sub(" ", markup).split())


def unwanted(name: str, attributes: str, in_article: bool, by_class: bool, container: bool = False) -> bool:
    """Whether an element's whole content is left out; a ``container`` is a form around the article."""
    if not container and (name in SKIPPED or name == "header" and not in_article):
        return True
    if not attributes or not by_class or name in ("html", "body", "article", "main"):
        return False
    found = [(key.lower(), "".join(values)) for key, *values in ATTRIBUTE.findall(attributes)]
    for key, value in found:
        if key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and HIDING.search(value):
            return True
    if container:
        return False
    for key, value in found:
        if key not in ("class", "id", "role", "aria-label"):
            continue
        if in_article or key == "id" and name in TITLED:
            # Prose may be about comments or related work: only whole tokens count here, and no id of a heading.
            if key == "aria-label" or key == "id" and name in TITLED - {"section"}:
                continue
            if any(PARTS.fullmatch(t) or key != "id" and TOKENS.fullmatch(t) for t in value.split()):
                return True
        elif MARKED.search(value) or MARKED_HEADER.search(value):
            return True
    return False


def sequence(page: str, by_class: bool = True) -> list[tuple[str, str, bool]]:
    """``(tag, text, in_article)`` in page order: a tag with empty text, or text with an empty tag.

    An unwanted element gives one tag ``-name``; comments, declarations and processing instructions give none.
    """
    article = "article" if re.search(r"<article[\s>]", page, re.IGNORECASE) else "main"
    out: list[tuple[str, str, bool]] = []
    at, inside = 0, 0
    skipping, depth, words = "", 0, -1
    while match := TOKEN.search(page, at):
        if match.start() > at and not skipping:
            out.append(("", page[at : match.start()], inside > 0))
        at = match.end()
        closing, name, attributes = match.group(1), (match.group(2) or "").lower(), match.group(3) or ""
        if not name:
            if match.group().startswith("<![CDATA[") and not skipping:
                out.append(("", match.group()[9:].removesuffix("]]>"), inside > 0))
            continue
        if skipping:
            if name == skipping and (closing or name not in SELF_CLOSED):
                depth += -1 if closing else 1
                skipping = skipping if depth else ""
                continue
            # An element that is never closed ends with the next of its kind, or with what surrounds it.
            ends = name == skipping or closing and (name in (article, "body", "html") or skipping == "p" and name not in INLINE)
            if not ends:
                continue
            skipping = ""
        if closing:
            out.append((f"/{name}", "", inside > 0))
            inside = max(0, inside - (name == article))
            continue
        container = False
        if name == "form":
            body = page[at : FORM_END.search(page, at).start()]
            words = count_words(page) if words < 0 else words
            container = bool(re.search(r"<(?:article|main)[\s>]", body, re.IGNORECASE)) or 2 * count_words(body) > words
        if unwanted(name, attributes, inside > 0, by_class, container):
            out.append((f"-{name}", "", inside > 0))
            if name in VOID or attributes.endswith("/"):
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
                continue
            skipping, depth = name, 1
            continue
        inside += name == article
        out.append((name, "", inside > 0))
    if at < len(page) and not skipping:
        out.append(("", page[at:], inside > 0))
    return out


def count_tags(page: str) -> tuple[Counter, Counter, int, int] | None:
    """Tags inside and outside the only article of a page that labels itself, and the words of both; else None."""
    items = sequence(page)
    opened = sum(within and tag in ARTICLE for tag, _, within in items)
    if opened != 1:
        return None
    inside, outside, words = Counter(), Counter(), [0, 0]
    for tag, text, within in items:
        if not tag:
            words[within] += len(text.split())
        elif tag.strip("/") not in ARTICLE:
            (inside if within else outside)[tag] += 1
    return inside, outside, words[1], words[0]


def learned_costs(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Cost of each tag from its counts inside and outside of articles."""
    pages = max(1, max((n for pair in counts.values() for n in pair), default=1))
    costs = {}
    for tag, (inside, outside) in counts.items():
        ratio = math.log((outside / pages + SMOOTH) / (inside / pages + SMOOTH))
        costs[tag] = min(MOST_COST, max(LEAST_COST, SCALE * ratio + 1.0))
    return costs


#: Costs where no page labels itself; inline elements other than links cost nothing.
DEFAULT_COSTS = {"a": 2.0, "/a": 0.0, "li": 1.0, "/li": 0.0, "td": 0.5, "p": 0.0, "/p": 0.0, "br": 0.0, "-nav": 5.0, "-footer": 8.0, "-header": 5.0, "-head": 8.0, "-form": 1.0, "-aside": 1.0, "-script": 0.0, "-style": 0.0}


def cost(tag: str, in_article: bool, costs: dict[str, float]) -> float:
    bare = tag.strip("-/")
    if bare in ARTICLE:
        return EDGE_COST
    if in_article or bare in INLINE and bare != "a":
        return 0.0
    if tag.startswith("-") and bare not in ("nav", "footer", "header", "head"):
        return min(1.0, costs.get(tag, 1.0))  # what is left out already need not part the text around it
    return costs.get(tag, UNSEEN_COST if not tag.startswith("/") else 0.0)


def best_region(items: list[tuple[str, str, bool]], costs: dict[str, float]) -> tuple[int, int]:
    """Bounds of the contiguous run of items with the largest score; (0, 0) if no word scores."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    marked = any(within for _, _, within in items)
    for i, (tag, text, within) in enumerate(items):
        gain = -cost(tag, within, costs) if tag else len(text.split()) * (1.0 if within or not marked else OUTER_WORD)
        if total <= 0.0 and gain > 0.0:
            total, start = 0.0, i
        total += gain
        if total > best or total == best and best and start == best_at[0]:
            best, best_at = total, (start, i + 1)
    return best_at


def main_text(page: str | None, costs: dict[str, float]) -> str:
    """The article of one page."""
    if not page:
        return ""
    items = sequence(page)
    start, end = best_region(items, costs)
    if start == end:  # nothing but marked parts: go by element names alone
        items = sequence(page, by_class=False)
        start, end = best_region(items, costs)
    blocks, run = [], []
    for tag, text, _ in items[start:end]:
        if not tag:
            run.append(text)
        elif tag.strip("-/") not in INLINE:
            blocks.append("".join(run))
            run = []
    blocks.append("".join(run))
    return " ".join(joined for block in blocks if (joined := " ".join(references.unescape(block).split())))


COUNTS = "tag string, inside long, outside long, words_inside long"


def learn(pages: DataFrame, html: str = "html", url: str = "url", most_pages: int = MOST_PAGES) -> dict[str, float]:
    """Costs from a bounded sample of pages that label themselves; one row per tag name reaches the driver."""
    drawn = pages.select(
        F.col(html).cast("string").alias("html"), F.xxhash64(F.col(url).cast("string"), F.length(html)).alias("draw")
    ).filter(F.lower("html").rlike("<(article|main)[\\s>]"))
    # Only the draws travel: the last one that belongs to the sample cuts the others off in the scan.
    last = drawn.select("draw").distinct().orderBy("draw").limit(most_pages).agg(F.max("draw")).first()[0]
    if last is None:
        return dict(DEFAULT_COSTS)
    sample = drawn.filter(F.col("draw") <= last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside, words = Counter(), Counter(), 0
        for batch in batches:
            for page in batch.column(0).to_pylist():
                if found := count_tags(page):
                    inside.update(found[0])
                    outside.update(found[1])
                    words += found[2]
        tags = sorted({*inside, *outside})
        if tags:
            yield pa.RecordBatch.from_arrays(
                [pa.array(tags), pa.array([inside[t] for t in tags], pa.int64()), pa.array([outside[t] for t in tags], pa.int64()),
                 pa.array([words] + [0] * (len(tags) - 1), pa.int64())],
                names=["tag", "inside", "outside", "words_inside"],
            )

    totals = (
        sample.select("html").mapInArrow(run, COUNTS).groupBy("tag")
        .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"), F.sum("words_inside").alias("words"))
        .orderBy(F.desc(F.col("inside") + F.col("outside")), "tag").limit(1000).collect()
    )
    if not totals:
        return dict(DEFAULT_COSTS)
    return DEFAULT_COSTS | learned_costs({r["tag"]: (r["inside"], r["outside"]) for r in totals})


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, costs: dict[str, float], key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, costs) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")
    )
    return rows.mapInArrow(run, EXTRACTED)
