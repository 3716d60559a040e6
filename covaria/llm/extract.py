"""HTML extraction by site style trees: same-host pages are merged, low-importance branches are removed from each page."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.llm.common import broadcast_if_small, materialize, slices

# Element names by their role in a page.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp")
FOREIGN = ("svg", "math")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCK = (
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
NOISE = ("nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "svg", "canvas", "object", "head", *RAW)
# Words in class, id and role names that mark boilerplate, those of other people's text, those that mark the article or its
# headline, and first words by which a name only tells how a page is laid out.
NOISE_WORDS = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|newsletter|subscri\w+|sidebar|side|widgets?"
    r"|nav\w*|menus?|breadcrumbs?|pagination|pager|foot\w*|copyright|masthead|toolbar|topbar|share|sharing|social|login|signup|search|form|hidden|header|complementary"
    r"|contentinfo|navigation|teasers?|outbrain|taboola)",
)
OTHERS_WORDS = re.compile(r"(?:comments?|disqus|repl(?:y|ies)|respond|related|recommend\w*)")
MAIN_NAME = re.compile(r"(?:article|post|entry|story)(?:[-_]?(?:body|content|text))?|content|main(?:[-_]?content)?|body[-_]?text", re.IGNORECASE)
HEADLINE = re.compile(r"(?:article|post|entry|story)[-_]?(?:header|head|heading|title)", re.IGNORECASE)
LAYOUT = ("has", "no", "with", "without", "is", "not", "layout", "page", "template", "single", "col", "js", "wp")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.DOTALL)
NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Elements that an opening tag closes, beside an open paragraph, and those that it doesn't look beyond.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = ("html", "body", "ul", "ol", "dl", "table", "div", "article", "section", "main", "td", "th", "blockquote", "li", "dd", "aside", "form", "nav", "header", "footer")

#: Importance below which a branch is removed, the weight of content against a branch's own styles (to the power of their number),
#: and pages needed to judge.
LEAST, GAMMA, PAGES = 0.3, 0.9, 4
#: Levels of a site's tree; a branch that lies deeper is judged with its ancestor there, but read by its own names.
DEPTH = 64


@lru_cache(100_000)
def mark(step: str, inside: bool = False) -> str:
    """What an element's own tag and names say: "others" (comments, related pages), "noise", "header" (of a page or of an
    article), "main", or nothing.

    Whole names count, by their words: one that begins with a word of LAYOUT ("has-sidebar") says nothing of the element,
    and nothing is said of html and body. Inside an article an id ("#related-work") is mostly a heading's anchor, so it
    counts only where it is such a word as a whole.
    """
    tag, _, names = step.partition(".")
    said = ""
    if tag not in ("html", "body"):
        for name in names.split():
            anchor, name = name.startswith("#"), name.removeprefix("#")
            words = [name.lower()] if anchor and inside else [w.lower() for w in PART.findall(name)]
            if not words or words[0] in LAYOUT or HEADLINE.fullmatch(name):
                continue
            if any(OTHERS_WORDS.fullmatch(w) for w in words):
                return "others"
            if any(NOISE_WORDS.fullmatch(w) for w in words):
                said = "noise"
    if tag in NOISE:
        return "noise" if tag == "form" else "others"
    if tag in ("article", "main") or "articlebody" in names.lower().replace("-", ""):
        return "main"
    if said or tag == "header":
        return said or "header"
    return "main" if any(MAIN_NAME.fullmatch(n.removeprefix("#")) for n in names.split()) else ""


@dataclass
class Page:
    """A page's tree of block and marked elements, each of siblings with equal names once, and its texts and breaks in order.

    For each node: its parent, its step (tag with class, id and role names, ids after "#"), its level, the node that it is
    judged with (itself, or its ancestor at DEPTH), that one's path's hash and the tags of its children in order. `events` are (node, text) and (-1, "") for a break between blocks.
    """

    parent: list[int] = field(default_factory=lambda: [-1])
    step: list[str] = field(default_factory=lambda: [""])
    level: list[int] = field(default_factory=lambda: [0])
    judged: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [0])
    children: list[list[str]] = field(default_factory=lambda: [[]])
    events: list[tuple[int, str]] = field(default_factory=list)

    @classmethod
    def of(cls, page: str) -> Page:
        import xxhash

        out, stack, opened, known = cls(), [("", 0)], Counter(), {}

        def close(to: int) -> None:
            while len(stack) > to:
                tag, _ = stack.pop()
                opened[tag] -= 1
                if tag in BLOCK:
                    out.events.append((-1, ""))

        at, end = 0, len(page)
        while at < end:
            m = TOKEN.search(page, at)
            if m is None or m.start() > at:
                out.events.append((stack[-1][1], page[at : m.start() if m else end]))
            if m is None:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if opened[tag]:
                    close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
                elif tag in BLOCK:
                    out.events.append((-1, ""))
                continue
            if tag in RAW:  # up to its own end tag, whatever is in it
                found = _end_tag(tag).search(page, at)
                at = found.end() if found else end
                continue
            if tag == "br":
                out.events.append((stack[-1][1], " "))
                continue
            if tag in VOID or tag in FOREIGN and m[3].endswith("/"):  # a slash ends no other element
                if tag in BLOCK:
                    out.events.append((-1, ""))
                continue
            named = (("#" * (g[0].lower() == "id") + n) for g in NAMED.findall(m[3]) for n in "".join(g[1:]).split())
            names = " ".join(dict.fromkeys(named))
            step = tag + ("." + names if names else "")
            if tag not in BLOCK and not (tag in NOISE or names and mark(step)):
                continue  # inline elements are part of the block that holds them
            if tag in BLOCK:
                if opened["head"] and tag not in ("head", "html"):
                    close(next(i for i, x in enumerate(stack) if x[0] == "head"))
                # a block ends an open paragraph, and items end their like, up to the box that holds them
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p" or stack[i][0] in CLOSES.get(tag, ()):
                        close(i)
                    elif stack[i][0] in SCOPE:
                        break
                out.events.append((-1, ""))
            up = stack[-1][1]
            out.children[up].append(tag)
            if (node := known.get((up, step))) is None:
                node = known[up, step] = len(out.parent)
                deep = out.level[up] >= DEPTH
                out.parent.append(up)
                out.step.append(step)
                out.level.append(out.level[up] + 1)
                out.judged.append(out.judged[up] if deep else node)
                out.path.append(out.path[up] if deep else xxhash.xxh64_intdigest(f"{out.path[up]}>{step}") >> 1)
                out.children.append([])
            stack.append((tag, node))
            opened[tag] += 1
        return out


@lru_cache
def _end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|</{tag}\Z", re.IGNORECASE)


def _features(page: str) -> list[tuple[int, list[int], str, int, int]]:
    """(path, paths above and its own, kind, value, weight) of a page's nodes: the run of its child tags, and its own text."""
    import xxhash

    tree = Page.of(page)
    texts: dict[int, list[str]] = {}
    for node, text in tree.events:
        if node >= 0 and (words := text.split()):
            texts.setdefault(tree.judged[node], []).extend(words)
    rows = []
    for i in (i for i in range(1, len(tree.parent)) if tree.judged[i] == i):
        rows.append((tree.path[i], [], "style", xxhash.xxh64_intdigest(" ".join(tree.children[i])) >> 1, 0))
    for i, words in texts.items():
        above, at = [], i
        while at > 0:
            above.append(tree.path[at])
            at = tree.parent[at]
        text = " ".join(words)
        rows.append((tree.path[i], above, "text", xxhash.xxh64_intdigest(text) >> 1, len(text)))
    return rows


def site_trees(pages: DataFrame, host: str = "host", least_pages: int = PAGES) -> DataFrame:
    """Importance of the nodes of each host's style tree: host, path (a hash of tags, classes, ids and roles), pages, importance.

    Pages of a host are merged by path; all branches take part, whatever their names. A node's own part is the entropy of
    its presentation styles (the tags of its children) over pages; a content node's is the entropy-based novelty of its
    texts: 1 less the mean over texts of how evenly each recurs. Both are to the base of the number of pages with the node,
    where pages with equal content count once (copies of an article don't make it boilerplate). Of a branch with l styles the
    content, weighted by text length, counts GAMMA ** l and its own part the rest. With fewer than `least_pages` distinct
    pages nothing can be told and importance is 1. Null html is an empty page; an empty table has no trees.
    """
    names, kinds = ("host", "page", "path", "above", "kind", "value", "weight"), (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in slices(batches, "html"):
            out: list[tuple] = []
            for name, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                rows = _features(page or "")
                own = xxhash.xxh64_intdigest(repr([r[3] for r in rows if r[2] == "text"])) >> 1
                out += [(name, own, *r) for r in rows]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=list(names))

    seen = pages.select(F.col(host).alias("host"), "html").mapInArrow(run, "host string, page long, path long, above array<long>, kind string, value long, weight long")
    # a third of the pages may be one host's: rows are summed by (host, path, value, page) before anything gathers by path
    each = seen.groupBy("host", "path", "kind", "value", "page").agg(F.max("weight").alias("weight"), F.first("above").alias("above"))
    each = materialize(each, "tree-values")
    held = each.groupBy("host", "path").agg(F.count_distinct("page").alias("pages"))
    values = each.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"), F.max("weight").alias("weight"), F.first("above").alias("above"))
    style, text = F.col("kind") == "style", F.col("kind") == "text"
    stats = values.groupBy("host", "path").agg(
        F.count_if(style).alias("styles"), F.sum(F.when(style, F.col("n"))).alias("styled"), F.sum(F.when(style, F.col("n") * F.log("n"))).alias("n_log_n"),
        F.avg(F.when(text, F.log("n"))).alias("even"), F.sum(F.when(text, F.col("weight"))).alias("weight"), F.first(F.when(text, F.col("above")), ignorenulls=True).alias("above"),
    )
    m = F.col("pages")
    # shares of styles are of the pages with the node: sum(-p ln p) = ln(m) styled / m - sum(n ln n) / m
    entropy = F.coalesce(F.col("styled") / m - F.col("n_log_n") / (m * F.log(m)), F.lit(0.0))
    node = materialize(
        stats.join(held, ["host", "path"]).select(
            "host", "path", "pages", "styles", "above", "weight", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(m > 1, entropy))).alias("own"),
            F.when(m > 1, 1 - F.coalesce("even", F.lit(0.0)) / F.log(m)).otherwise(1.0).alias("novel"),
        ), "tree-nodes",
    )
    content = node.where("weight > 0").select("host", F.explode("above").alias("path"), "novel", "weight")
    content = content.groupBy("host", "path").agg((F.sum(F.col("novel") * F.col("weight")) / F.sum("weight")).alias("content"))
    rest = F.pow(F.lit(GAMMA), F.greatest("styles", F.lit(1)))
    return node.join(content, ["host", "path"], "left").select(
        "host", "path", "pages", F.when(m < least_pages, 1.0).otherwise((1 - rest) * F.col("own") + rest * F.coalesce("content", "own")).alias("importance")
    )


def _text(page: str, low: set[int]) -> str:
    """Blocks of the branches that are kept, each with single spaces, joined by one space in page order.

    low: paths of low importance in the page's site tree. Such branches go, but the article's own paragraphs and headings,
    where the tree judges boxes with names only. Branches with boilerplate's names go, except those that hold more than half of
    the article's text that the tree finds new (a form or a box around the whole page).
    """
    tree = Page.of(page)
    many = len(tree.parent)
    new = [0] * many
    for node, text in tree.events:
        if node >= 0 and tree.path[node] not in low:
            new[node] += len(text) - text.count(" ")
    # parents come before their children
    gone, inside, said = [False] * many, [False] * many, [""] * many
    for i in range(1, many):
        up = tree.parent[i]
        said[i] = mark(tree.step[i], inside[up])
        gone[i], inside[i] = gone[up] or said[i] == "others", inside[up] or said[i] == "main"
    body = [n if a and not g else 0 for n, a, g in zip(new, inside, gone, strict=True)]
    whole = sum(body)
    for i in range(many - 1, 0, -1):
        body[tree.parent[i]] += body[i]
    cut, main = [False] * many, [False] * many
    for i in range(1, many):
        up = tree.parent[i]
        noise = said[i] == "others" or said[i] == "header" and not main[up] or said[i] == "noise" and 2 * body[i] <= whole
        main[i] = main[up] or said[i] == "main"
        cut[i] = cut[up] or noise or tree.path[i] in low and (not main[i] or main[up] and "." in tree.step[i])
    # an article is read alone; a page without one keeps all that wasn't removed
    alone = any(node >= 0 and main[node] and not cut[node] and text.strip() for node, text in tree.events)
    blocks, now = [], []
    for node, text in tree.events:
        if node < 0:
            blocks.append("".join(now))
            now = []
        elif not cut[node] and (main[node] or not alone):
            now.append(html.unescape(text))
    blocks.append("".join(now))
    return " ".join(" ".join(b.split()) for b in blocks if b.strip())


def extract(pages: DataFrame, **options) -> DataFrame:
    """Main text of each page: page_id, url, text, n_chars.

    Branches of menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments go by their names,
    and any branch whose importance in its host's style tree is below LEAST, whatever its name; see _text() for what is kept
    where the two disagree. Null html counts as empty and gives an empty text; a null or odd url is a host of its own kind.
    Repeated rows stay and count once in a tree; an empty table gives no rows; columns beside page_id, url and html aren't
    read. Broken markup is read as far as it goes; nothing is capped.
    """
    hosted = pages.select("page_id", "url", "html", F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit("")).alias("host"))
    trees = site_trees(hosted, **options)
    low = materialize(trees.where(F.col("importance") < LEAST).groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("low")), "low-branches")
    joined = hosted.join(broadcast_if_small(low, 5_000), "host", "left").select("page_id", "url", "html", "low")
    schema = pages.select("page_id", "url").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [_text(page or "", set(low or ())) for page, low in zip(part.column("html").to_pylist(), part.column("low").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, schema)
