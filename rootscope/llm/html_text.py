"""HTML main-text extraction by a maximum-scoring subsequence.

A page becomes a sequence of tags and text runs. A text run scores a positive weight per word, a tag a
negative one, and the contiguous stretch that scores best, found in one linear scan, is the content
region. Weights come from labelled pages, those with one article element: a tag found as often
outside the article as inside (for its share of words) costs most, one found only inside least, and the
article's own bounds count as outside. For the weights only scripts, styles and the like are left out of a page.

Elements that are never content wherever they stand (scripts, styles, forms, menus, headers and footers
of a page, asides, and blocks whose class, id or role says advert, notice, comments, sidebar, ...) are taken
out before the scan; their words score nothing and each costs as a tag that only articles hold.

Null or empty page: empty. Broken markup: unclosed elements end with their parent, stray end tags are only tags, unclosed
quotes do not hide what follows. A page of any length is scanned in a time proportional to it. Pages are independent, so
repeated rows give repeated results, and an empty table none; ties go to the first stretch. Columns that are kept must
not be named text or n_chars.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unique_name

#: A word; a tag that only articles hold; times that, at most, by doublings of its count elsewhere; a tag that no labelled page has.
FIT_PAGES, WORD, TAG, SPREAD, NOTHING_KNOWN = 4000, 1.0, 0.05, 60.0, 0.25
#: Element names of HTML, by what they mean for text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp template svg math object canvas audio video select".split())
OPAQUE = RAW - set("svg math object select audio video canvas template".split())
NEVER = set("head nav footer aside form button menu dialog label fieldset option datalist".split()) | RAW
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
OTHERS = set(
    "html body article main section header div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address hgroup details summary center hr".split()
)
#: Words in class, id or role that mark a block as no content.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|banner|nav|navbar|navigation|menu|menubar|"
    r"breadcrumb|breadcrumbs|sidebar|side-bar|footer|masthead|comment|comments|disqus|respond|reply|replies|cookie|cookies|consent|"
    r"gdpr|notice|notification|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|"
    r"widget|pagination|pager|toolbar|search|skip|contentinfo|complementary|site-header|page-header|hidden)(?:$|[\s_-]|\d)",
    re.I,
)
_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[\"'>]")
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
#: A tag that an open element of these names does not outlive.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BOUND = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body"}


def marked(name: str, attributes: str, inside: int) -> bool:
    """Whether an element is no content by its name or attributes. inside: open article or main elements."""
    if name in NEVER or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body"):
        return False
    for m in _ATTR.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key == "role" and value.strip().lower() in _ROLE or key in ("class", "id") and MARKS.search(value):
            return True
    return False


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Start, end, kind (tag, end, raw, data or none), name and attributes of each piece of markup, in one pass.

    raw: an element whose content is no markup, to its end tag.

    A `>` in quotes does not end a tag. If a quote is never closed, tags that start before it end at the next `>`, so that
    no part of a page is looked at more than a few times. What is never ended reaches to the page's end.
    """
    at, plain = 0, -1
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "none", "", ""
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at + 9)
            text = page[at + 9 : len(page) if end < 0 else end]
            end = len(page) if end < 0 else end + 3
            yield at, end, "data", "", text
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1 or len(page)
            yield at, end, "none", "", ""
        elif m := _NAME.match(page, at):
            end = m.end()
            while at > plain and (stop := _STOP.search(page, end)) and stop[0] != ">":
                close = page.find(stop[0], stop.end())
                if close < 0:
                    plain = stop.start()
                else:
                    end = close + 1
            close = page.find(">", m.end() if at <= plain else end)
            end = len(page) if close < 0 else close + 1
            name, rest = m[2].lower(), page[m.end() : len(page) if close < 0 else close]
            if not m[1] and name in OPAQUE:
                shut = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, end)
                end = shut.end() if shut else len(page)
                yield at, end, "raw", name, rest
            else:
                yield at, end, "end" if m[1] else "tag", name, rest
        else:
            end = at + 1
        at = end


def parts(page: str, bare: bool = False) -> list[tuple[str, str]]:
    """(tag name, "") or ("", text), with "-" for an element taken out; end tags have a slash.

    bare: only what holds no text for readers (scripts, styles, ...) is taken out.
    """
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether each takes its content out
    names: dict[str, int] = {}  # how many of each are open
    hidden = inside = at = 0

    def shut(upto: int) -> None:
        nonlocal hidden, inside
        while len(stack) > upto:
            n, h = stack.pop()
            names[n] -= 1
            hidden -= h
            inside -= n in ("article", "main")

    for start, end, kind, name, rest in tags(page):
        if start > at and not hidden:
            out.append(("", page[at:start]))
        at = end
        if kind == "data" and not hidden:
            out.append(("", html.escape(rest)))
        elif kind == "end":
            was = hidden
            if names.get(name):
                shut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            if not was:
                out.append((f"/{name}", ""))
            elif not hidden:
                out.append(("-", ""))
        elif kind == "raw" and not hidden:
            out.append(("-", ""))
        elif kind == "tag":
            if any(names.get(n) for n in _ENDS.get(name, ())):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in _ENDS[name]:
                        shut(i)
                        break
                    if stack[i][0] in _BOUND:
                        break
            drop = name in RAW if bare else marked(name, rest, inside)
            if not hidden:
                out.append(("-" if drop else name, ""))
            if name not in VOID and (name in _ENDS or not rest.endswith("/")):
                stack.append((name, drop))
                names[name] = names.get(name, 0) + 1
                hidden += drop
                inside += name in ("article", "main")
    if at < len(page) and not hidden:
        out.append(("", page[at:]))
    return out


def known(tag: str) -> str:
    name = tag.removeprefix("/")
    return tag if name in OTHERS or name in INLINE or tag == "-" else "?"


def region(items: list[tuple[str, str]], weights: dict[str, float]) -> tuple[int, int]:
    """First and past-last item of the best-scoring stretch; (0, 0) if nothing scores."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    default = weights.get("?", -NOTHING_KNOWN)
    for i, (tag, text) in enumerate(items):
        total += weights.get(known(tag), default) if tag else WORD * len(text.split())
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, where = total, (start, i + 1)
    return where


def blocks(items: list[tuple[str, str]]) -> list[str]:
    out, held = [], []
    for tag, text in items:
        if not tag:
            held.append(html.unescape(text))
        elif tag == "br":
            held.append(" ")
        elif tag.removeprefix("/") not in INLINE:
            out.append(held)
            held = []
    out.append(held)
    joined = (" ".join("".join(h).split()) for h in out if h)
    return [x for x in joined if x]


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    items = parts(page)
    a, b = region(items, weights)
    return "\n".join(blocks(items[a:b]))


def tag_counts(page: str) -> dict[str, list[float]] | None:
    """Of a labelled page: tags inside and outside its article, per word there; None if it has not just one."""
    items = parts(page, bare=True)
    if sum(t == "article" for t, _ in items) != 1 or sum(t == "/article" for t, _ in items) != 1:
        return None
    a, b = (next(i for i, (t, _) in enumerate(items) if t == x) for x in ("article", "/article"))
    if b < a:
        return None
    found: dict[str, list[float]] = {}
    for i, (t, _) in enumerate(items):
        if t:
            found.setdefault(known(t), [0.0, 0.0])[not a < i < b] += 1
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, list[float]] = {}
    for batch in batches:
        for page in batch.column(0).to_pylist():
            for tag, (i, o) in (tag_counts(page) or {}).items():
                t = total.setdefault(tag, [0.0, 0.0])
                t[0] += i
                t[1] += o
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.string()), *(pa.array([v[k] for v in total.values()], pa.float64()) for k in (0, 1))],
        names=["tag", "inside", "outside"],
    )


def fit(pages: DataFrame, row_id: str, page: str = "html", most: int = FIT_PAGES) -> dict[str, float]:
    """Tag weights from a sample, by a hash of the row's id, of about `most` pages."""
    n = pages.count()
    share = int(min(1, most / max(1, n)) * (1 << 30))
    sample = pages.filter(F.col(page).isNotNull() & (F.pmod(F.xxhash64(F.col(row_id).cast("string")), F.lit(1 << 30)) < share))
    rows = sample.select(page).mapInArrow(_counted, "tag string, inside double, outside double")
    rows = rows.groupBy("tag").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()  # tag names of HTML
    weights = {"?": -NOTHING_KNOWN}
    for r in rows:
        outside = (r.outside + 0.5) / (r.inside + r.outside + 1)
        weights[r.tag] = -TAG * (1 + SPREAD * outside**4 * np.log2(1 + r.outside))
    return {k: float(v) for k, v in weights.items()} | {"-": -TAG}


def _extracted(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, page = batch.columns
            text = [main_text(x, weights) for x in page.to_pylist()]
            own = [pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
            yield pa.RecordBatch.from_arrays([*others, *own], names=[*batch.schema.names[:-1], "text", "n_chars"])

    return run


def extract(df: DataFrame, weights: dict[str, float], keep: list[str], page: str = "html") -> DataFrame:
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.select(*keep, F.col(page).alias(unique_name(df.select(*keep), "page"))).mapInArrow(_extracted(weights), f"{own}, text string, n_chars long")


def op2(spark, sf_dir):
    from .common import table

    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages, "page_id"), ["page_id", "url"])
