"""Main text of web pages by line-block distribution.

Markup is stripped in one pass: block elements end lines, inline ones don't; end tags that
HTML lets authors leave out are implied. Lines in menus, headers, footers, sidebars, notices,
adverts, forms and reader comments keep their place but lose their text. Text lengths are
summed over a sliding window of lines; a run of lines goes from where text begins to where
the sum dives to nothing, and it surges if a sum in it rises to the threshold, or to the
page's highest one where that is lower. The run with the most text is the core of the page.

Elements only weigh: the run with the most text outside links is the core. If it stands in an
article or main, a line of that element weighs as much as a surge at least, and lines outside
of such elements nothing. If not, a paragraph or heading weighs as much as a surge, lines of
such elements nothing, and other lines that are mostly link text nothing. The sums of these
weights decide: runs that surge are the text, and outside of articles short runs within two
windows of one.

Noise by class, id, role or form is a guess. A class or id is noise if all its words are noise
words or neutral ones, so `related-work` is not. The guess is taken back for an element with more than
half of the page's text outside links, if it holds an article or main and is not one of
reader comments, or if no article or main has text outside of all noise.

Hidden elements (hidden, display:none) have no text.

Defined results: a null, blank or text-free page gives an empty text and n_chars 0; of runs
with equally much text the first is the core; very long and malformed pages take linear
time; an empty table gives no rows; other columns are ignored; repeated rows are computed
each.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import released

#: Lines of a window, and characters in it that make a surge.
WINDOW = 3
SURGE = 40

# Element names and the words in class, id and role that mark boilerplate.
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
SKIPPED = frozenset("nav footer aside dialog menu button header head fieldset select template noscript object canvas audio video svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset("td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
ARTICLES = frozenset("article main".split())
FOREIGN = frozenset("svg math".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
NOISE_WORDS = COMMENT_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login related recommended share sharing social pagination pager widget toolbar search".split()
)
#: Words that may stand beside one of these in a class or id; another word makes it a name of its own.
NEUTRAL_WORDS = frozenset(
    "site page main global top bottom left right inner outer wrapper wrap container box block area section list item items row col column columns group panel bar strip zone slot unit content body inside link links button buttons btn icon icons boxes blocks areas bars text title header head foot primary secondary tertiary post posts article articles entry story user users reader readers form field input view module component el js css id first last small large mini sm md lg xl desktop mobile fixed sticky active".split()
)
#: A class or id with one of these says what its page has, not what the element is.
STATE_WORDS = frozenset("has with without no".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote pre".split())
#: Elements that a start tag ends, if one of them is the innermost open one.
ENDS = {name: frozenset("p".split()) for name in BLOCKS | CELLS} | {
    "li": frozenset("p li".split()),
    "dt": frozenset("p dt dd".split()),
    "dd": frozenset("p dt dd".split()),
    "td": frozenset("p td th".split()),
    "th": frozenset("p td th".split()),
    "tr": frozenset("p td th tr caption".split()),
    **{name: frozenset("p td th tr thead tbody tfoot caption".split()) for name in ("thead", "tbody", "tfoot")},
    **{name: HEADINGS | {"p"} for name in HEADINGS},
}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
# possessive, so that a tag without an end is given up after one look at the rest of the page
_TO_END = re.compile(r"(?:[^>\"'=]++|=\s*+\"[^\"]*\"|=\s*+'[^']*'|[\"'=])*+>")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?<![^\s\"'/])(?:hidden(?![^\s/=>])(?!\s*=\s*[\"']?until-found)|style\s*=\s*(?:\"[^\"]*|'[^']*|[^\s>\"']*)display\s*:\s*none)", re.I)
_PARTS = re.compile(r"[a-z]+").findall


def tags(html: str) -> Iterator[tuple[str, str, str, bool]]:
    """(text before the tag, name, attributes, whether it is an end tag); the last name is empty.

    Comments, declarations and the content of raw elements are left out.
    """
    at, quoted, before = 0, True, []
    while True:
        begin = html.find("<", at)
        if begin < 0:
            break
        before.append(html[at:begin])
        sign = html[begin + 1 : begin + 2]
        closing = sign == "/"
        name = _NAME.match(html, begin + 1 + closing)
        if name is None:
            if sign not in ("!", "?", "/"):
                before.append("<")
                at = begin + 1
                continue
            if html.startswith("<!--", begin):
                found = _COMMENT_END.search(html, begin + 2)
                end = found.end() if found else 0
            else:
                end = html.find(">", begin) + 1
            if not end:
                at = len(html)
                break
            at = end
            continue
        match = _TO_END.match(html, name.end()) if quoted else None
        if match is None:
            quoted = False  # the rest has no end by quotes: from here on, any > ends a tag
            end = html.find(">", name.end()) + 1
            if not end:
                at = len(html)
                break
        else:
            end = match.end()
        word = name[0].lower()
        yield "".join(before), word, html[name.end() : end - 1], closing
        before, at = [], end
        if word in RAW and not closing:
            found = re.compile(rf"</{word}(?=[\s/>])", re.I).search(html, at)
            at = found.start() if found else len(html)
    before.append(html[at:])
    yield "".join(before), "", "", False


def noise_of(name: str, attributes: str) -> str:
    """"comments", "noise" or "" by the element's role, class and id, or for a form."""
    found = "noise" if name == "form" else ""
    if name in ("body", "html", "article", "main") or not attributes.strip():
        return found
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        for word in (a or b or c).lower().split():
            if key.lower() == "role":
                found = "noise" if word in NOISE_ROLES else found
                continue
            parts = set(_PARTS(word))
            if parts & NOISE_WORDS and parts <= NOISE_WORDS | NEUTRAL_WORDS and not parts & STATE_WORDS:
                if parts & COMMENT_WORDS:
                    return "comments"
                found = "noise"
    return found


class Page:
    """Lines of pieces (text, noise element or 0, whether in a link), each line with the
    number of its outermost article or main and whether it is of prose, and the noise elements: parent, kind, characters
    of text, whether they hold an article or main."""

    def __init__(self, html: str):
        self.lines: list[tuple[list[tuple[str, int, bool]], int, bool]] = []
        self.parent, self.kind, self.size, self.holds = [0], [""], [0], [False]
        self.pieces: list[tuple[str, int, bool]] = []
        self.stack: list[tuple[str, bool, bool]] = []  # name, skipped, starts a noise element
        self.opened: dict[str, int] = defaultdict(int)
        self.noise = [0]
        self.skipped = self.articles = self.foreign = self.region = self.regions = 0
        self.article_text = 0  # outside of all noise
        self.link = False
        for text, name, attributes, closing in tags(html):
            self._text(text)
            if closing:
                self._end(name)
            elif name:
                self._start(name, attributes)
        self._end_line()
        for i in range(len(self.parent) - 1, 0, -1):
            self.size[self.parent[i]] += self.size[i]
            self.holds[self.parent[i]] |= self.holds[i]

    def _text(self, text: str) -> None:
        if not text or text.isspace():
            if text and not self.skipped:
                self.pieces.append((text, self.noise[-1], self.link))
            return
        if self.stack and self.stack[-1][0] == "head":
            self._pop()
        if self.skipped:
            return
        n = 0 if self.link else len("".join(text.split()))
        self.size[self.noise[-1]] += n
        if self.articles and len(self.noise) == 1:
            self.article_text += n
        self.pieces.append((text, self.noise[-1], self.link))

    def _end_line(self) -> None:
        self.lines.append((self.pieces, self.region, bool(self.stack) and self.stack[-1][0] in PROSE))
        self.pieces = []

    def _pop(self) -> str:
        name, skipped, noise = self.stack.pop()
        self.opened[name] -= 1
        self.skipped -= skipped
        self.foreign -= name in FOREIGN
        if noise:
            self.noise.pop()
        if name in ARTICLES:
            self.articles -= 1
            if not self.articles:
                self.region = 0
        return name

    def _start(self, name: str, attributes: str) -> None:
        if name == "br" or name in CELLS:
            if not self.skipped:
                self.pieces.append((" ", self.noise[-1], False))
        elif name in BLOCKS:
            self._end_line()
        if self.stack and self.stack[-1][0] == "head" and name not in IN_HEAD:
            self._pop()
        if self.foreign and name in BLOCKS:  # text elements end a picture or formula
            while self.foreign:
                self._pop()
        while self.stack and self.stack[-1][0] in ENDS.get(name, ()):
            self._pop()
        if name == "a":
            self.link = True
        if name in VOID or name in RAW or attributes.endswith("/") and (self.foreign or name in FOREIGN):
            return
        skipped = name in SKIPPED and not (name == "header" and self.articles) or bool(_HIDDEN.search(attributes))
        kind = "" if skipped else noise_of(name, attributes)
        if not (skipped or kind or name in BLOCKS or name in CELLS):
            return
        self.stack.append((name, skipped, bool(kind)))
        self.opened[name] += 1
        self.skipped += skipped
        self.foreign += name in FOREIGN
        if kind:
            self.parent.append(self.noise[-1])
            self.kind.append(kind)
            self.size.append(0)
            self.holds.append(False)
            self.noise.append(len(self.parent) - 1)
        if name in ARTICLES:
            self.holds[self.noise[-1]] = True
            if not self.articles:
                self.regions += 1
                self.region = self.regions
            self.articles += 1

    def _end(self, name: str) -> None:
        if name in BLOCKS:
            self._end_line()
        if name == "a":
            self.link = False
        elif name in CELLS and not self.skipped:
            self.pieces.append((" ", self.noise[-1], False))
        if self.opened[name] > 0:
            while self._pop() != name:
                pass

    def texts(self) -> list[tuple[str, int, int, bool]]:
        """(text without noise, characters of it in links, article or main, prose) of each line."""
        spared = lambda i: 2 * self.size[i] > self.size[0] and (not self.article_text or self.holds[i] and self.kind[i] != "comments")
        noisy = [False]
        for i in range(1, len(self.parent)):
            noisy.append(noisy[self.parent[i]] or not spared(i))
        out = []
        for pieces, region, prose in self.lines:
            kept = [p for p in pieces if not noisy[p[1]]]
            raw = "".join(p[0] for p in kept)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            out.append((text, sum(len(p[0]) for p in kept if p[2]), region, prose))
        return out


def runs_of(lengths: list[int], regions: list[int], window: int, surge: int) -> list[tuple[int, int, int, bool]]:
    """(first line, last line with text, characters, surged) of each run. Runs end where the
    window's sum dives to nothing, and where an article or main begins or ends."""
    out: list[tuple[int, int, int, bool]] = []
    total = peak = size = 0
    start = last = None
    sums, tops = [], []
    for i, n in enumerate(lengths):
        total += n - (lengths[i - window] if i >= window else 0)
        sums.append(total)  # of the window that ends at line i
        if start is not None and (total == 0 or n and regions[i] != regions[last]):
            out.append((start, last, size, False))
            tops.append(peak)
            start = None
        if n:
            if start is None:
                start, peak, size = i, 0, 0
            last = i
            size += n
        if start is not None:
            peak = max(peak, total)
    if start is not None:
        out.append((start, last, size, False))
        tops.append(peak)
    least = min(surge, max(sums, default=0))
    return [(a, b, n, top >= least) for (a, b, n, _), top in zip(out, tops)]


def main_text(html: str, window: int = WINDOW, surge: int = SURGE) -> str:
    lines = Page(html).texts()
    regions = [region for _, _, region, _ in lines]
    # a line that is mostly link text has no text of its own, but for the choice among prose
    own = [0 if 2 * linked > len(text) else len(text) for text, linked, _, _ in lines]
    favoured = [max(len(text), SURGE) if text and prose else n for (text, _, _, prose), n in zip(lines, own)]
    runs = runs_of(own, regions, window, surge) or runs_of(favoured, regions, window, surge) or runs_of([len(x[0]) for x in lines], regions, window, surge)
    if not runs:
        return ""
    home = regions[max(runs, key=lambda r: r[2])[0]]
    if home:
        weights = [max(len(text), SURGE) if text and region == home else len(text) if region else 0 for text, _, region, _ in lines]
        near = 0
    else:
        weights = [0 if region else n for n, region in zip(favoured, regions)]
        near = 2 * window
    runs = runs_of(weights, regions, window, surge)
    kept: list[str] = []
    for j, (first, last, _, surged) in enumerate(runs):
        after = j > 0 and runs[j - 1][3] and first - runs[j - 1][1] <= near
        before = j + 1 < len(runs) and runs[j + 1][3] and runs[j + 1][0] - last <= near
        if surged or after or before:
            kept += [x[0] for x, n in zip(lines[first : last + 1], weights[first : last + 1]) if n]
    return "\n\n".join(kept)


def extract(pages: DataFrame, id_column: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per row of pages: its id, the kept columns, text, n_chars."""
    fields = [f"`{n}` {pages.schema[n].dataType.simpleString()}" for n in (id_column, *keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in (id_column, *keep)), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[id_column, *keep, "text", "n_chars"],
            )
        released()

    return pages.select(id_column, *keep, html).mapInArrow(run, ", ".join([*fields, "text string", "n_chars long"]))
