"""Main text of web pages: text-to-tag ratios of lines, smoothed and clustered, pick content regions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.llm.words import slices

#: Lines that the Gaussian reaches to either side, and its width in lines.
RADIUS, SIGMA = 2, 1.0
# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("aside audio button canvas dialog footer head iframe input label legend menu nav noscript object option script select style svg template textarea title video".split())
REGION = frozenset("article main section div td body html".split())
ENDS_P = BLOCK - {"option", "select", "html", "body", "head"}
#: Words of class and id, and roles, of what isn't an article's own text.
ASIDE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar sidenav footer header masthead comment comments reply replies respond disqus share sharing social related recommended newsletter subscribe subscription signup login search widget toolbar pagination pager".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
COMMENT_WORDS = frozenset("comment comments reply replies".split())
#: From these words on a class says what a page or its layout has; with one of the others at its end, a state.
MODIFIERS = frozenset("has have no not with without hide hides hidden show shows is".split())
STATES = frozenset("open opened closed enabled disabled allowed active visible on off".split())
#: Share of the page's content that an element must hold to be none of what its name or tag says: of one named so
#: alone, and of one where the name is but a part or the tag a form.
SURELY, MAYBE = 0.9, 0.5


class Lines(HTMLParser):
    """The page's blocks in order: (text, tags met since the block before, dropped, path of regions, doubtful elements).

    An element is doubtful if its class, id, role or tag says that it isn't the article's own; what it holds
    decides. need has the share of the content from which on it is kept.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, tuple[int, ...], tuple[int, ...]]] = []
        self.stack: list[tuple[str, bool, int, int]] = []  # name, dropped, its region's number or 0, its number among the doubtful or 0
        self.kinds: dict[int, str] = {}
        self.need: dict[int, float] = {}
        self.sound: set[int] = set()  # doubtful elements around a main
        self.text: list[str] = []
        self.tags = 0
        self.dropped = 0

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata[i : i + 3] == "<![":  # marked sections are comments in HTML
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self.lines.append((text, self.tags, self.dropped > 0, tuple(n for _, _, n, _ in self.stack if n), tuple(n for _, _, _, n in self.stack if n)))
            self.tags = 0

    def handle_data(self, data: str) -> None:
        self.text.append(data)

    def _pop(self) -> None:
        _, dropped, _, _ = self.stack.pop()
        self.dropped -= dropped

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK or tag in DROPPED:
            self.flush()
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "hr"):
                self.text.append(" ")
            return
        if tag in ENDS_P:
            self._end_of("p", {"article", "div", "section", "td", "button"})
        if tag == "li":
            self._end_of("li", {"ul", "ol", "menu"})
        doubt = self._doubt(tag, attrs)
        dropped = tag in DROPPED or doubt == 1
        region = number = 0
        if tag in REGION:
            region = len(self.kinds) + 1
            self.kinds[region] = tag
        if tag == "main" and not dropped:
            self.sound.update(n for _, _, _, n in self.stack if n)
        if doubt and not dropped:
            number = len(self.need) + 1
            self.need[number] = doubt
        self.stack.append((tag, dropped, region, number))
        self.dropped += dropped

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash before > means nothing in HTML

    def _end_of(self, tag: str, bounds: set[str]) -> None:
        """Closes an open tag that the next one ends by itself, unless a bound lies between."""
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name == tag:
                while len(self.stack) > k:
                    self._pop()
                return
            if name in bounds:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK or tag in DROPPED:
            self.flush()
        self.tags += 1
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self._pop()
                return

    def _doubt(self, tag: str, attrs: list) -> float:
        """0 if nothing says that an element isn't the article's own, 1 if it is hidden, else the share it must hold."""
        if tag in ("html", "body"):
            return 0
        inside = any(name in ("article", "main") for name, _, _, _ in self.stack)
        doubt = MAYBE if tag == "form" else SURELY if tag == "header" and not inside else 0
        if not attrs:
            return doubt
        of = dict(attrs)
        if "hidden" in of or of.get("aria-hidden") == "true" or "display:none" in (of.get("style") or "").replace(" ", "").lower():
            return 1
        if (of.get("role") or "").lower() in ASIDE_ROLES:
            doubt = SURELY
        named = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{of.get('class') or ''} {of.get('id') or ''}").lower().split()
        for name in named:
            words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
            words = words[: next((i for i, w in enumerate(words) if w in MODIFIERS), len(words))]
            if not words or words[-1] in STATES:
                continue
            if COMMENT_WORDS.intersection(words) or len(words) == 1 and words[0] in ASIDE_WORDS and tag not in ("article", "main"):
                doubt = SURELY
            elif ASIDE_WORDS.intersection(words) and tag not in ("article", "main"):
                doubt = max(doubt, MAYBE)
        return doubt


def smooth(x: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    return np.convolve(np.pad(x, RADIUS), kernel / kernel.sum(), "valid")


def _content(lines: list[tuple], dropped: list[bool]) -> np.ndarray:
    """Which lines are content: their smoothed ratio of characters to tags reaches the ratios' standard deviation."""
    ratio = np.array([0.0 if out else len(line[0]) / max(line[1], 1) for line, out in zip(lines, dropped, strict=True)])
    if not ratio.any():
        return ratio > 0
    level = smooth(ratio)
    return (level >= min(float(ratio.std()), float(level.max()))) & (ratio > 0)


def main_text(page: str | None) -> str:
    """The article's blocks in page order, one to a line.

    Each block is a line with its ratio of characters to tags; menus and the like count as 0. Lines whose
    smoothed ratio reaches the ratios' standard deviation are content. A doubtful element that holds the
    share of the content that it needs, or a main, is kept. Where a content line lies in an article or main
    element, all such elements are regions; else the smallest element that holds all of the content is. All
    lines of the regions and all content lines are returned but those of menus and the like.
    """
    if not page:
        return ""
    p = Lines()
    p.feed(page)
    p.close()
    p.flush()
    lines = p.lines
    dropped = [line[2] for line in lines]
    if p.need:
        mass: dict[int, int] = {}
        total = 0
        for (text, _, _, _, doubts), hit in zip(lines, _content(lines, dropped), strict=True):
            if hit:
                total += len(text)
                for n in doubts:
                    mass[n] = mass.get(n, 0) + len(text)
        sound = p.sound | {n for n, m in mass.items() if m > p.need[n] * total}
        dropped = [line[2] or not sound.issuperset(line[4]) for line in lines]
    content = _content(lines, dropped)
    if not content.any():
        return ""
    paths = [path for (_, _, _, path, _), hit in zip(lines, content, strict=True) if hit]
    own = {n for n, kind in p.kinds.items() if kind in ("article", "main")}
    regions = own if any(own.intersection(path) for path in paths) else set(sorted(set(paths[0]).intersection(*paths))[-1:])
    return "\n".join(line[0] for line, hit, out in zip(lines, content, dropped, strict=True) if not out and (hit or not regions.isdisjoint(line[3])))


def extract(pages: DataFrame) -> DataFrame:
    """pages with text (empty if none) and n_chars (its code points) instead of html.

    A null or empty page, or one without content, has an empty text. A page of any length is read whole.
    Equal rows are returned one by one; further columns are passed on, those named as a result are replaced. Any markup is read as
    far as it goes. An empty table gives no rows.
    """
    kept = pages.drop("text", "n_chars")
    schema = kept.drop("html").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                columns = [c for n, c in zip(part.schema.names, part.columns, strict=True) if n != "html"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=schema.names)

    return kept.mapInArrow(run, schema)
