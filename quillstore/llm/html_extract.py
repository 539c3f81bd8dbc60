"""Main text of web pages.

A page is cut into flat text blocks.  Each is described by its word count and
link density, those of its neighbours, and what encloses it; a decision tree
that is trained on a small labelled table decides which blocks are main text.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches

#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol "
    "option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements of which nothing is text.
SKIPPED = frozenset("script style noscript template svg math iframe object head title textarea select button canvas audio video datalist".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, and words of class, id or role, that say what is not main text.
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog header".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies discussion disqus footer form gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion recommended related replies reply respond search share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription teaser toolbar topbar warning widget widgets".split()
)
#: Of these, words that say nothing inside main text.
PART_WORDS = frozenset("header masthead teaser".split())
#: Of these, words that inside main text count only if nothing but such words and CONTAINERS is said.
SOFT_WORDS = frozenset("discussion notice notices promotion recommended related replies reply respond search share sharing social warning".split())
CONTAINERS = frozenset("area articles bar box block buttons container content icons inner items links list module panel posts reading section stories topics wrap wrapper".split())
RELATIONS = frozenset("has with no without".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article articlebody content entry main post story".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

FEATURES = ("boilerplate", "main", "heading", "words", "links", "words_before", "links_before", "words_after", "links_after", "page_has_main")


def _tells(name: set, own: bool) -> bool:
    """Whether one name of an element inside main text says that it is boilerplate; own: another says it is main text."""
    hard = (name & BOILERPLATE_WORDS) - PART_WORDS - SOFT_WORDS
    return bool(hard) or (not own and bool(name & SOFT_WORDS) and name <= SOFT_WORDS | PART_WORDS | CONTAINERS)


def _marks(tag: str, attributes: str, inside: bool = False) -> tuple[bool, bool]:
    """Whether an element says by name, class, id or role that it is boilerplate, or main text; inside: of main text."""
    bad, good = tag in BOILERPLATE_TAGS, tag in MAIN_TAGS
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                bad = True
            elif name in ("class", "id", "role"):
                names = [{w.lower() for w in WORDS.findall(v)} for v in value.split()]
                said = set().union(*(n for n in names if n.isdisjoint(RELATIONS)))  # "has-sidebar" is about something inside
                own = not said.isdisjoint(MAIN_WORDS)
                if inside:
                    bad |= any(_tells(n, own) for n in names if n.isdisjoint(RELATIONS))
                else:
                    bad |= not said.isdisjoint(BOILERPLATE_WORDS)
                good |= own
    return bad, good


def blocks(page: str) -> list[tuple[str, int, float, bool, bool, bool]]:
    """(text, words, share of them in links, inside boilerplate, inside main, heading) of each block with text."""
    out: list = []
    stack: list[list] = []  # [tag, boilerplate, main] of open elements
    text: list[str] = []
    linked: list[str] = []
    links, heading = 0, False
    bad = good = False

    def close():
        nonlocal heading
        said = " ".join(html.unescape("".join(text)).split())
        if said:
            n = said.count(" ") + 1
            of = len(" ".join(html.unescape("".join(linked)).split()).split())
            out.append((said, n, min(1.0, of / n), bad, good, heading))
        text.clear()
        linked.clear()

    def look():
        nonlocal bad, good
        bad, good = (stack[-1][1], stack[-1][2]) if stack else (False, False)

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        said = page[at : m.start() if m else size]
        if said:
            text.append(said)
            if links:
                linked.append(said)
        if not m:
            break
        at = m.end()
        if m[0].startswith("<![CDATA["):
            text.append(html.escape(m[0][9:-3]))
            continue
        ends, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if not ends and tag in SKIPPED and not (attributes or "").rstrip().endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if tag in ("head", "title") and stop is None:
                continue
            at = stop.end() if stop else size
            if tag in BLOCK:
                close()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag == "a":
            links = 0 if ends else 1
            continue
        if tag not in BLOCK:
            if tag in VOID:
                continue
            # Inline elements matter only if they mark something.
            if ends:
                if stack and stack[-1][0] == tag:
                    close()
                    stack.pop()
                    look()
            elif attributes and not attributes.isspace():
                b, _ = _marks(tag, attributes, good)
                if b:
                    close()
                    stack.append([tag, True, good])
                    look()
            continue
        close()
        links = 0
        heading = tag in HEADINGS and not ends
        if tag in VOID:
            continue
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "main", "body"):
                    break
        else:
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th") or tag in HEADINGS:
                alike = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "li": ("li", "p")}.get(tag, (tag, "p"))
                while stack and stack[-1][0] in alike:
                    stack.pop()
            elif stack and stack[-1][0] == "p":
                stack.pop()
            look()
            b, g = _marks(tag, attributes, good)
            if tag == "header" and good:
                b = _marks("div", attributes, good)[0]  # the head of the article itself
            if tag in ("body", "html"):
                b = False
            stack.append([tag, bad or b, (good or g) and not b])
        look()
    close()
    return out


def features(found: list[tuple]) -> np.ndarray:
    """One row of FEATURES per block."""
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if n:
        x[:, 0] = [b[3] for b in found]
        x[:, 1] = [b[4] for b in found]
        x[:, 2] = [b[5] for b in found]
        x[:, 3] = [b[1] for b in found]
        x[:, 4] = [b[2] for b in found]
        x[1:, 5:7] = x[:-1, 3:5]
        x[:-1, 7:9] = x[1:, 3:5]
        x[:, 9] = x[:, 1].any()
    return x


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """The small labelled table: blocks of pages made by rule from typical layouts, with and without telling markup.

    In these pages the word ``keep`` marks main text and ``drop`` the rest.
    """

    def words(kind, n):
        return " ".join([kind] * n)

    def menu(n):
        return "<ul>" + "".join(f"<li><a href='/x'>{words('drop', 1 + i % 3)}</a></li>" for i in range(n)) + "</ul>"

    def body(lengths):
        return "".join(f"<p>{words('keep', n)}</p>" for n in lengths)

    mixed = f"<p>{words('keep', 20)} <a href='/y'>{words('keep', 3)}</a> {words('keep', 15)}</p>"
    one = f"<p>{words('keep', 8)}</p><p><a href='/z'>{words('keep', 3)}</a></p><p>{words('keep', 30)}</p>"  # a link among text
    run = lambda n: "<ul>" + "".join(f"<li><a href='/z'>{words('drop', 1 + 2 * i)}</a></li>" for i in range(n)) + "</ul>"  # noqa: E731  a list of links
    listed = f"<ul><li>{words('keep', 2)}</li><li>{words('keep', 5)} <a href='/z'>{words('keep', 1)}</a></li></ul>{one}{run(3)}<p>{words('keep', 12)}</p>{run(2)}<p>{words('keep', 60)}</p>{run(4)}<h2>{words('keep', 3)}</h2><p>{words('keep', 9)}</p><p><a href='/z'>{words('keep', 6)}</a></p><p>{words('keep', 7)}</p>"
    byline = f"<p><a href='/w'>{words('drop', 2)}</a></p>"
    pages = [menu(3) + f"<div>{body([n])}</div>" + menu(2) for n in (25, 60, 120, 200)]  # a paragraph alone between menus
    for before in (2, 7, 24, 70):  # links in an article: one among text belongs to it, a list of them does not
        for after in (2, 7, 24, 70):
            for size in (1, 4, 9):
                one = f"<p><a href='/z'>{words('keep', size)}</a></p>"
                several = f"<p><a href='/z'>{words('drop', size)}</a></p>" * (2 + before % 2)
                pages += [f"<article><p>{words('keep', before)}</p>{links}<p>{words('keep', after)}</p></article>" for links in (one, several)]
                pages.append(f"<article><p>{words('keep', 30)}</p>{several}<p>{words('keep', after)}</p>{several}<p>{words('keep', before)}</p></article>")
                pages.append(f"<div><a href='/z'>{words('drop', size)}</a></div><div><p>{words('keep', after + 18)}</p></div><div><a href='/z'>{words('drop', size)}</a></div>")
                pages.append(f"<div><p>{words('keep', before + 18)}</p></div><div><a href='/z'>{words('drop', size)}</a></div><div><p>{words('keep', after + 18)}</p></div>")
    for n in (20, 28, 45, 90, 150):  # a foot of links, or of text and links, after a paragraph
        for size in (1, 2, 3, 6):
            foot = f"<div>{words('drop', size)} <a href='/f'>{words('drop', size)}</a> <a href='/f'>{words('drop', 1)}</a></div>" if size % 2 else f"<div><a href='/f'>{words('drop', size)}</a></div>"
            pages.append(f"{menu(3)}<div><h1>{words('keep', size)}</h1>{body([n, n])}</div>{foot}")
    for ad, size, lengths in zip((9, 2, 1, 3, 5, 12, 4), (7, 2, 3, 4, 1, 9, 5), ([40, 60, 25, 90], [1, 30, 2, 45, 1], [120, 3, 80], [15, 22, 18], [1], [4, 2], [300, 5, 1, 60]), strict=True):
        title = f"<h1>{words('keep', size)}</h1>"
        for marked, head in ((True, title), (False, title), (True, ""), (False, "")):
            part = (lambda tag, name, inner: f"<{tag} class='{name}'>{inner}</{tag}>") if marked else (lambda tag, name, inner: f"<div>{inner}</div>")
            main = f"<article>{head}{body(lengths)}{mixed}{listed}{run(2 + size % 4)}</article>" if marked else f"<div>{head}{byline if head else ''}{body(lengths)}{mixed}</div>"
            pages.append(
                part("nav", "menu", menu(6))
                + part("header", "site", words("drop", 10 - size))
                + part("div", "ad", f"<p>{words('drop', ad)}</p>" if marked else f"<a>{words('drop', ad)}</a>")
                + main
                + part("div", "related", menu(4))
                + (part("section", "comments", f"<p>{words('drop', 35)}</p><p>{words('drop', 6)}</p><p>{words('drop', 140)}</p><p>{words('drop', 60)}</p>") if marked else "")
                + (part("aside", "sidebar", f"<p>{words('drop', 28)}</p><p>{words('drop', 80)}</p>" + menu(2)) if marked else part("aside", "", menu(3)))
                + (part("form", "newsletter", words("drop", 12)) if marked else "")
                + (part("div", "notice", f"<p>{words('drop', 55)}</p><p>{words('drop', 200)}</p>") if marked else "")
                + part("footer", "footer", words("drop", 8) if marked else f"{words('drop', 3)} <a>{words('drop', 4)}</a>")
            )
            if marked:  # boilerplate says what it is, main text does not
                pages.append(pages[-1].replace(listed, "").replace("<article>", "<div>").replace("</article>", "</div>"))
    x, y = [], []
    for page in pages:
        found = blocks(page)
        x.append(features(found))
        y += [b[0].startswith("keep") for b in found]
    return np.concatenate(x), np.array(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2):
    """A binary decision tree by Gini impurity: a verdict, or (feature, threshold, tree if <=, tree if >)."""
    if depth == 0 or y.all() or not y.any() or len(y) < 2 * least:
        return bool(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        left = np.cumsum(t)[:-1]
        n = np.arange(1, len(t))
        right, m = t.sum() - left, len(t) - n
        impurity = left * (1 - left / n) + right * (1 - right / m)
        impurity[(v[1:] == v[:-1]) | (n < least) | (m < least)] = np.inf
        i = int(impurity.argmin())
        if np.isfinite(impurity[i]) and (best is None or impurity[i] < best[0] - 1e-12):
            best = (impurity[i], f, (v[i] + v[i + 1]) / 2)
    if best is None:
        return bool(y.mean() >= 0.5)
    _, f, at = best
    low = x[:, f] <= at
    a, b = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return a if a == b and isinstance(a, bool) else (f, float(at), a, b)


def judge(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    f, at, a, b = tree
    low = x[:, f] <= at
    out = np.zeros(len(x), bool)
    out[low], out[~low] = judge(a, x[low]), judge(b, x[~low])
    return out


def main_text(page: str | None, tree) -> str:
    """The kept blocks.  If the tree keeps none, all that lies outside boilerplate and is not mostly links is kept."""
    found = blocks(page or "")
    keep = judge(tree, features(found))
    if not keep.any():
        keep = [not b[3] and b[2] < 0.5 for b in found]
    return "\n\n".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, tree=None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.  Narrow; a null or empty page gives an empty text; repeated
    rows are handled each; pages of any length are one row; an empty table gives none; other columns are not looked at.
    A block that ties in a leaf of the tree is kept."""
    tree = grow(*labelled_table()) if tree is None else tree
    bounded_batches(pages.sparkSession)
    slim = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    kinds = dict(slim.dtypes)

    def run(batches):
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return slim.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
