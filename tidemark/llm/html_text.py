"""Main text of web pages by two-pass block rules.

A page is cut into text blocks at block-level tags. Pass one decides blocks: those inside menus, headers, footers, sidebars,
notices, adverts, forms or reader comments (by tag, role, class or id) and those made mostly of links are boilerplate;
long blocks with few links and enough stop words are content; the rest stay open. In pass two each open block takes the label
of its nearest decided neighbours: if the two agree, theirs; otherwise that of the nearer one, content winning ties inside an
article. Headings look at what follows them. Where a page has an article or main element, blocks outside all such elements
are boilerplate, and open blocks inside have their neighbours inside. Inside, class names that articles use for their own parts
too (search, legal, share, ...) only cast suspicion: suspect paragraphs and headings, and long suspect blocks, go by their
densities like all others; other short suspect blocks are boilerplate.

Tags are read as browsers read them: quotes matter only where a value begins. A quoted value that would run over other tags
ends at its tag's end instead. The work is linear in the page, however deep its tags nest.

Defined results: null and empty html give an empty text; cut tags at the end are dropped, cut character references stay as
text; nothing is capped; repeated rows give a row each; only the id, url and html columns are read; an empty table gives an
empty table.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

# Common function words of the four languages.
STOP_WORDS = frozenset(
    """the of and to a in that is was for it with as his he on be at by this had not are but from or have an they which one you were
    her all she there would their we him been has when who will more no if out so said what its about into than them can only other
    de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux cette ses ou mais comme
    on lui nous elle der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie
    nach wird bei einer um am noch wie einem über so zum el los las y a del por con no su para al lo más pero sus le ya o este sí
    porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante""".split()
)
# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROP = frozenset("head script style noscript template svg math canvas object iframe select button textarea title datalist".split())
CHROME = frozenset("nav header footer aside form menu dialog fieldset".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
CONTENT = frozenset("article main".split())
# Parts of class names that mark boilerplate anywhere, and those that do so outside articles.
ALWAYS = """ad ads advert adverts advertisement advertising sponsor sponsored promo promos promotion promotions sidebar sidebars side-bar navbar nav navigation breadcrumb
breadcrumbs pagination pager cookie cookies consent gdpr popup popups modal overlay newsletter subscribe signup login comment comments commentlist respond disqus replies reply
skip-link skip-links skiplink skiplinks teaser teasers""".split()
OUTSIDE = """banner widget menu menus notice notices alert alerts footer header masthead topbar toolbar share sharing social related recommended copyright legal disclaimer search form""".split()
CHROME_NAME = re.compile(rf"(?:^|[\s_-])(?:{'|'.join(ALWAYS + OUTSIDE)})(?:$|[\s_-])", re.I)
ALWAYS_NAME = re.compile(rf"(?:^|[\s_-])(?:{'|'.join(ALWAYS)})(?:$|[\s_-])", re.I)
CHROME_ROLE = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
#: An attribute's value: quoted without tags in it; quoted with tags in it, if a space or the tag's end follows; up to a space.
VALUE = r"""(?:"([^"<]*+)"|'([^'<]*+)'|"([^"]*+)(?<!=)"(?=[\s/>])|'([^']*+)(?<!=)'(?=[\s/>])|["']?([^\s>]*+))"""
ATTR = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+{VALUE})?")
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|(?>[^\s/>][^\s/>=]*+(?:\s*+=\s*+{re.sub(r'[(](?![?])', '(?:', VALUE)})?))*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
# Start tags that end an open p, and items that end an open item of their kind.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


@dataclass
class Block:
    text: str
    linked: int
    chrome: bool
    inside: bool
    heading: bool
    suspect: bool = False
    prose: bool = False  # a heading's or paragraph's own text
    label: int = 0  # 1 content, -1 boilerplate, 0 open


@dataclass(slots=True)
class Element:
    tag: str
    drop: bool = False
    chrome: bool = False
    inside: bool = False
    suspect: bool = False


def verdict(tag: str, attrs: str, in_content: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it is suspect, by its tag and attributes."""
    if tag in CHROME and not (tag == "header" and in_content):
        return True, False
    if not attrs or tag in ("html", "body"):
        return False, False
    suspect = False
    for name, *values in ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id") and tag not in CONTENT and not (tag == "header" and in_content) and CHROME_NAME.search(value):
            if not in_content or ALWAYS_NAME.search(value):
                return True, False
            suspect = True
        if name == "role" and value.strip().lower() in CHROME_ROLE:
            return True, False
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True, False
    return False, suspect


class Page:
    """Reads a page tag by tag. Where elements of each name, and the blocks, are open is kept, so that no step searches the stack."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[Element] = []
        self.where: dict[str, list[int]] = {}  # by tag, depths of open elements
        self.frames: list[int] = []  # depths of open elements that are not inline
        self.text: list[str] = []
        self.linked = self.headings = self.links = 0

    def flush(self) -> None:
        if self.text:
            body = " ".join(html_lib.unescape("".join(self.text)).split())
            if body:
                top = self.stack[-1] if self.stack else Element("")
                holder = self.stack[self.frames[-1]].tag if self.frames else ""
                self.blocks.append(Block(body, self.linked, top.chrome, top.inside, self.headings > 0, top.suspect, holder in HEADINGS or holder == "p"))
            self.text.clear()
        self.linked = 0

    def add(self, piece: str) -> None:
        if piece and not (self.stack and self.stack[-1].drop):
            self.text.append(piece)
            if self.links:
                self.linked += len(" ".join(html_lib.unescape(piece).split()))

    def forget(self, depth: int) -> None:
        """The element at this depth is open no more."""
        tag = self.stack[depth].tag
        places = self.where[tag]
        places.pop() if places[-1] == depth else places.remove(depth)
        self.headings -= tag in HEADINGS
        self.links -= tag == "a"

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            depth = len(self.stack) - 1
            tag = self.stack[-1].tag
            if tag and tag not in INLINE:
                self.flush()
                self.frames.pop()
            if tag:
                self.forget(depth)
            self.stack.pop()

    def deepest(self, *tags: str) -> int:
        """Depth of the innermost open element of these names, -1 if none."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def end(self, tag: str) -> None:
        depth = self.deepest(tag)
        if depth < 0:
            if tag not in INLINE:
                self.flush()
        elif tag not in INLINE or not self.frames or self.frames[-1] < depth:
            self.pop(depth)
        else:  # an inline end tag across blocks ends only that element
            self.forget(depth)
            self.stack[depth].tag = ""

    def start(self, tag: str, attrs: str) -> None:
        if tag in ENDS_P:
            depth = self.deepest("p")
            if depth >= 0 and self.frames[-1] == depth:
                self.pop(depth)
        if tag in SAME:
            depth = self.deepest(*SAME[tag], "ul", "ol", "dl", "table")
            if depth >= 0 and self.stack[depth].tag in SAME[tag]:
                self.pop(depth)
        if tag not in INLINE:
            self.flush()
        elif tag == "br":
            self.add(" ")
        if tag in VOID:
            return
        up = self.stack[-1] if self.stack else Element("")
        chrome, suspect = verdict(tag, attrs, up.inside)
        inside = up.inside or (tag in CONTENT and not up.chrome)
        self.where.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.frames.append(len(self.stack))
        self.stack.append(Element(tag, up.drop or tag in DROP, up.chrome or chrome, inside, up.suspect or suspect))
        self.headings += tag in HEADINGS
        self.links += tag == "a"


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, with what encloses them."""
    out, at = Page(), 0
    ends: dict[str, re.Pattern] = {}
    while True:
        m = TAG.search(page, at)
        if not m:
            out.add(page[at:])
            break
        out.add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[0][-1] != ">":  # cut within the tag
            break
        if m[1]:
            out.end(tag)
            continue
        out.start(tag, m[3] or "")
        if tag in RAW:
            end = ends.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)).search(page, at)
            if not end:
                break
            at = end.end()
            out.pop(len(out.stack) - 1)
    out.pop(0)
    out.flush()
    return out.blocks


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def classify(found: list[Block], long_chars: int = 80, max_link: float = 0.33, min_stop: float = 0.12) -> None:
    """Pass one labels what it can; pass two gives open blocks their nearest decided neighbours' label."""
    has_content = any(b.inside and not b.chrome for b in found)
    for b in found:
        link = b.linked / max(1, len(b.text))
        words = b.text.lower().split()
        stop = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)
        if b.chrome or (has_content and not b.inside):
            b.label = -1
        elif link > max_link:
            b.label = -1 if not b.inside or b.suspect or link > 0.9 and len(b.text) < long_chars else 0
        elif len(b.text) >= long_chars and stop >= min_stop:
            b.label = 1
        elif b.suspect and not b.prose:
            b.label = -1
        elif len(b.text) < 15 and not b.inside and re.search(r"©|\(c\)\s*\d", b.text, re.I):
            b.label = -1
    decided = [b.label for b in found]
    n = len(found)
    before: list[int] = []
    last = -1
    for i in range(n):
        before.append(last)
        if decided[i]:
            last = i
    after = [n] * n
    nxt = n
    for i in range(n - 1, -1, -1):
        after[i] = nxt
        if decided[i]:
            nxt = i
    for i, b in enumerate(found):
        if decided[i]:
            continue
        p, q = before[i], after[i]
        left, right = (decided[p] if p >= 0 else 0), (decided[q] if q < n else 0)
        if b.inside:  # neighbours outside the article say nothing about what is in it
            left = left if p >= 0 and found[p].inside else 0
            right = right if q < n and found[q].inside else 0
        if not left and not right:
            b.label = 1 if b.inside or not has_content and len(b.text.split()) >= 5 else -1
        elif left == right or not right or not left:
            b.label = left or right
            if b.inside and b.label < 0 and b.linked <= max_link * len(b.text):
                b.label = 1
        elif b.heading:
            b.label = right
        else:
            b.label = 1 if b.inside or i - p == q - i and left > 0 else (left if i - p < q - i else right)


def main_text(page: str | None) -> str:
    """Content blocks in page order, joined by two line feeds."""
    found = blocks(page or "")
    classify(found)
    return "\n\n".join(b.text for b in found if b.label > 0)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    cols = (f"cast(`{id_col}` as long) page_id", f"cast(`{url_col}` as string) url", f"cast(`{html_col}` as string) html")
    return pages.selectExpr(*cols).mapInArrow(work, "page_id long, url string, text string, n_chars long")
