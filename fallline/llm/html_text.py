"""HTML extraction: the best contiguous run of words and tags.

A page is a sequence of words and tags. Each has a weight for what it is and where it stands: words
of running text score positive, tags and the words of menus and the like negative. One linear scan finds
the run of the largest sum, which is the content; words inside it that stand in adverts, forms and
the like are left out. Elements that are menus, footers, asides, comments and the like by their own tag or by a whole
class name or id are never content, however much they hold; a form is not, unless it holds the article, or paragraphs and
the page has no text outside. Elements whose
names only contain such a word, as wrappers' do, are left out where they hold less than half of the words.

The weights are log odds learned from labelled pages: pages that mark their text with one
``article`` or ``main`` element say themselves which tokens are inside. Each such page is counted twice, once
as it is and once with that element read as a plain one, so pages without the mark are served
too. Kinds of tokens that no labelled page has fall back to fixed weights by place.

Character references are decoded, white space becomes one space, blocks are joined in page order by
one space. A null or empty page, or one without words, gives an empty text. One row gives one row.
"""

import html
import re
from collections import Counter
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Pages that weights are learned from, by least hash of their id: a bounded sample.
SAMPLE = 400
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>",
    re.S | re.I,
)
_RAW_END = re.compile(r"</[A-Za-z]+\s*>\Z")
_INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_MAIN = frozenset(("article", "main"))
_BOILER = frozenset("head nav footer aside form button menu dialog label fieldset title".split())
_NAMES = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar side widget widgets related "
    "recommended share sharing social footer header masthead banner notice notices cookie cookies consent gdpr "
    "newsletter subscribe signup login popup modal alert ad ads advert adverts advertisement sponsor sponsored "
    "promo promotion comment comments reply replies respond disqus copyright skip hidden".split()
)
#: Tags, and whole class names or ids, of elements that are never content.
_NEVER = frozenset("nav footer aside menu dialog".split())
_NEVER_NAMES = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar related recommended share sharing "
    "footer cookie cookies consent newsletter ad ads advert adverts advertisement sponsor sponsored comment comments "
    "reply replies respond disqus copyright".split()
)
#: Tags that show that a form is the page's own, around its content.
_CONTENT = frozenset(("article", "main", "h1"))
#: Of those, names that an article's own head has as well.
_HEADS = frozenset("header masthead banner".split())
_CLASS = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_CLOSES_P = frozenset("p div ul ol table h1 h2 h3 h4 h5 h6 section article main nav footer header aside form blockquote pre hr".split())


def _boiler(tag: str, attr: str, in_main: bool) -> bool:
    if tag in _BOILER or tag == "header" and not in_main:
        return True
    if not attr or tag in ("body", "html") or tag in _MAIN:
        return False
    known = _NAMES - _HEADS if in_main else _NAMES
    names = (x for m in _CLASS.findall(attr) for x in re.split(r"[^a-z0-9]+", "".join(m).lower()))
    return any(x in known for x in names) or bool(_HIDDEN.search(attr))


def _never(tag: str, attr: str) -> bool:
    """Whether an element is no content by its tag or a whole class name, id or role."""
    if tag in _NEVER:
        return True
    return any(x in _NEVER_NAMES for m in _CLASS.findall(attr) for x in "".join(m).lower().split())


def tokens(page: str, blind: bool = False) -> list[tuple[str, str, bool]]:
    """(kind, text, inside): words carry their text; ``inside`` tells a marked element's tokens.

    ``blind`` reads a marked element as a plain one, though ``inside`` still tells it. The page is scanned
    once, and the work for a tag does not grow with the tags that are open.
    """
    out: list[tuple] = []  # of words: kind, text, inside, innermost boiler element, zone without it, whether glued
    stack: list[tuple[str, int, bool, int]] = []  # tag, boiler element, main, boiler element around
    opened: Counter = Counter()  # open elements by tag
    blocks: list[str] = []  # open elements that are no inline ones
    # of each boiler element: the one around it, words before it and in it, whether its own tag closes it
    above: list[int] = []
    before: list[int] = []
    held: list[int] = []
    closed: list[bool] = []
    never: list[bool] = []
    forms: list[int] = []  # open forms that have not shown to hold content
    wrappers: set[int] = set()  # outermost forms with paragraphs
    total = main = link = 0
    zone_at = -1  # innermost boiler element since the last article or main
    block = "none"
    marked = not blind and bool(re.search(r"<(?:article|main)\b", page, re.I))

    def pop(own: bool) -> None:
        nonlocal main, link, zone_at
        tag, b, m, zone_at = stack.pop()
        opened[tag] -= 1
        if tag not in _INLINE:
            blocks.pop()
        if b >= 0:
            closed[b], held[b] = own, total - before[b]
            if forms and forms[-1] == b:
                forms.pop()
        main, link = main - m, link - (tag == "a")

    def text(piece: str) -> None:
        nonlocal total
        zone = "main" if main and marked else "outside" if marked else "plain"
        glued = not piece[:1].isspace()
        words = html.unescape(piece).split()
        for k, word in enumerate(words):
            out.append(("a" if link else block, word, main > 0, zone_at, zone, glued and not k))
        if not link:
            total += len(words)

    at = 0
    last = page.rfind(">") + 1  # nothing behind it is a tag
    for m in _TOKEN.finditer(page, 0, last):
        if m.start() > at:
            text(page[at : m.start()])
        trailing = m.start() > at and page[m.start() - 1].isspace()
        at = m.end()
        whole = m[0].endswith("-->") if m[0].startswith("<!--") else not m["raw"] or _RAW_END.search(m[0])
        if at == last and not whole:
            at = len(page)  # an open script or comment takes the rest
        if trailing:
            out.append(("space", "", main > 0))
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop(False)
                pop(True)
        else:
            if tag in _CLOSES_P and stack and stack[-1][0] == "p":
                pop(True)
            if tag in _CONTENT:
                for b in forms:
                    never[b] = False
                forms.clear()
            if tag == "p":
                wrappers.update(forms[:1])
            if tag not in _VOID and not m["attr"].endswith("/"):
                b, is_main, around = -1, tag in _MAIN, zone_at
                if is_main and not blind:
                    zone_at = -1
                if _boiler(tag, m["attr"], main > 0):
                    b = len(closed)
                    above.append(zone_at)
                    before.append(total)
                    held.append(0)
                    closed.append(False)
                    never.append(tag == "form" or _never(tag, m["attr"]))
                    if tag == "form":
                        forms.append(b)
                    zone_at = b
                stack.append((tag, b, is_main, around))
                opened[tag] += 1
                if tag not in _INLINE:
                    blocks.append(tag)
                main, link = main + is_main, link + (tag == "a")
        if tag not in _INLINE:
            block = blocks[-1] if blocks else "none"
            kind = "main" if tag in _MAIN and not blind else tag
            out.append((f"tag:{kind}", "", main > 0))
    if at < len(page):
        text(page[at:].partition("<!--")[0])

    def cuts() -> list[bool]:
        cut: list[bool] = []
        for b, own in enumerate(closed):  # an element stands behind the one around it
            cut.append((above[b] >= 0 and cut[above[b]]) or own and (never[b] or 2 * held[b] < total))
        return cut

    cut = cuts()
    if wrappers and not any(len(x) > 3 and x[0] != "a" and (x[3] < 0 or not cut[x[3]]) for x in out):
        for b in wrappers:  # the page has no other text
            never[b] = False
        cut = cuts()
    for k, token in enumerate(out):
        if len(token) > 3:
            place, word, inside, b, zone, glued = token
            zone = "boiler" if b >= 0 and cut[b] else zone
            out[k] = (f"{'+' * glued}word:{zone}:{place}", word, inside)
    return out


def fallback(kind: str) -> float:
    """The weight of a kind that no labelled page has."""
    what, zone, *place = (kind.split(":") + [""])[:3]
    if what == "tag":
        return -1.0
    return {"main": 2.0, "plain": 1.0, "outside": -1.0, "boiler": -2.0}[zone] - 1.5 * (place == ["a"])


def learn(pages: list[str]) -> dict[str, float]:
    """Weights of token kinds by their odds inside against outside the marked element."""
    inside, outside = Counter(), Counter()
    for page in pages:
        if len(re.findall(r"<(?:article|main)\b", page, re.I)) == 1:
            for blind in (False, True):
                for kind, _, is_in in tokens(page, blind):
                    if kind != "space":
                        (inside if is_in else outside)[kind.lstrip("+")] += 1
    out = {}
    for kind in inside | outside:
        odds = log((inside[kind] + 0.5) / (outside[kind] + 0.5))
        if kind.startswith("tag:"):
            out[kind] = min(-0.1, max(-3.0, odds))
        elif ":boiler:" in kind:
            out[kind] = min(-0.1, max(-3.0, odds))
        else:
            out[kind] = max(-3.0, min(3.0, odds))
    return out


def extract(page: str, weights: dict[str, float]) -> str:
    """The words of the best run, joined; an element's own adverts and forms cost it nothing."""
    found = tokens(page)
    best = (0.0, 0, 0)
    total, begin = 0.0, 0
    for k, (kind, _, is_in) in enumerate(found):
        if kind == "space":
            continue
        kind = kind.lstrip("+")
        weight = weights.get(kind)
        if weight is None:
            weight = fallback(kind)
        if is_in and weight < 0:
            weight = 0.0
        if total <= 0:
            total, begin = 0.0, k
        total += weight
        if total > best[0]:
            best = (total, begin, k + 1)
    out: list[str] = []
    gap = True
    for kind, word, _ in found[best[1] : best[2]]:
        plain = kind.lstrip("+")
        if not word:
            gap = True
        elif ":boiler:" not in plain:
            if out and kind[0] == "+" and not gap:
                out[-1] += word
            else:
                out.append(word)
            gap = False
        else:
            gap = True
    return " ".join(out)


SCHEMA = "page_id bigint, url string, text string, n_chars bigint"


def main_text(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", sample: int = SAMPLE
) -> DataFrame:
    """The main text of every row."""
    picked = pages.select(T.ids(page_id, "page_id").cast("bigint"), T.ids(url, "url"), T.ids(page, "html"))
    marked = picked.filter(F.lower("html").rlike("<(article|main)[ >]"))
    shown = marked.select("html", "page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        learned = learn([x.decode() for x in T.bytes_of(batch.column(0))])
        return pa.RecordBatch.from_arrays(
            [pa.array(list(learned), pa.string()), pa.array(list(learned.values()), pa.float64())],
            ["kind", "weight"],
        )

    rows = T.map_batches(shown.select("html").coalesce(1), count, "kind string, weight double")
    weights = {r.kind: r.weight for r in rows.groupBy("kind").agg(F.avg("weight").alias("weight")).collect()}
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(x.decode(), shared.value) for x in T.bytes_of(batch.column(2))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array(list(map(len, texts)), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    return T.map_batches(picked, work, SCHEMA)
