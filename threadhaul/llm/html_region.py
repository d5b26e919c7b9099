"""Main text of raw pages by the maximum-scoring subsequence of their tokens.

A page is a row of words and tags. Words score positive, by the element they stand in; tags
score negative, by their name. The contiguous stretch with the highest sum, found in one
scan, is the content. The weights are log odds of standing inside the content, counted on
labelled pages: those that mark their content themselves, with exactly one `article` element. That
element's own tags get no weight, so that pages without it are judged alike. Counts start from a few
fixed ones, which also serve where no page is labelled.

Elements that are no running text (scripts, styles, forms, navigation, hidden parts) score nothing and
are left out of the text; they are known by name, role or attribute. Notices, adverts, sidebars and reader
comments are hinted at by a whole class or id: their words score strongly negative, and are left out of the text
wherever they stand, between two paragraphs too. A hint says nothing on headings, on what contains an `article` or `main` element, and on what
contains most of the paragraph words of the article around it, or of a page without one.
If the stretch lies inside an `article` or `main` element, all of that element is taken. Several articles on
a page are one content if the stretch spans them, else the one with the stretch counts.

Defined results: a NULL or empty page has an empty text, and so has a page whose scores are never
positive; of equally good stretches the first is taken; repeated rows are extracted each. Elements that
are left open end with the page; `br` is white space inside a block.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash

# Fixed names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary"
    " table tbody td tfoot th thead tr ul xmp".split()
)
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Names whose inside is no running text; `annotation` is what a formula is written in, beside the formula.
RAW = frozenset("script style textarea title iframe noembed noframes noscript template svg annotation annotation-xml object canvas audio video select".split())
# Its inside is shown as it stands, tags and all.
LITERAL = "xmp"
LEFT_OUT = frozenset("nav aside footer form menu button dialog head fieldset search".split())
# Whole classes and ids only: "no-sidebar" or "has-comments" say something else.
_HINTS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner sidebar side nav navbar navigation menu breadcrumb breadcrumbs"
    " footer masthead cookie cookies consent gdpr notice alert newsletter subscribe subscription related recommended share sharing social"
    " comment comments disqus replies widget popup modal overlay login signup pagination pager toolbar skip".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_ROLE = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|alert|dialog|menu|menubar|form)$", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^>]*>)|<[!?/][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+))")
_CONTENT = frozenset(("article", "main"))

# Counts to begin with: (inside, outside) the content, for words in an element and for tags.
_WORDS_FIRST = {"p": (8, 1), "h1": (4, 2), "a": (1, 4), "li": (2, 3), "blockquote": (4, 1), "pre": (4, 1)}
_TAGS_FIRST = {"p": (8, 1), "br": (4, 1), "a": (1, 6), "li": (1, 4), "ul": (1, 4), "div": (1, 3), "span": (1, 2)}


@dataclass(frozen=True)
class Settings:
    """Weights come from at most `train_pages` labelled pages; they are kept between fixed bounds."""

    train_pages: int = 2_000
    word_bounds: tuple[float, float] = (0.2, 3.0)
    tag_bounds: tuple[float, float] = (0.3, 8.0)
    hinted_word: float = 3.0  # what a word under a hint costs


@dataclass
class Token:
    """A tag (`name`, `opens`) or a run of text (`name` is its element); `left_out` where it is no running text.

    `paragraph` where it stands in a `p` element, `hinted` where a class or id says that it is none of the content.
    """

    tag: bool
    name: str
    opens: bool
    text: str
    left_out: bool
    paragraph: bool = False
    hinted: bool = False


def _attributes(attributes: str) -> dict[str, str]:
    if "=" not in attributes:
        return {}
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}


def _hidden(attributes: str, found: dict[str, str]) -> bool:
    if not found and "hidden" not in attributes:
        return False
    if re.search(r"(?:^|\s)hidden(?:\s|$|/)", re.sub(_ATTRIBUTE, " ", attributes.rstrip(">"))) or found.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    return bool(_ROLE.match(found.get("role", "")))


def _hint(found: dict[str, str]) -> bool:
    return not _HINTS.isdisjoint(f"{found.get('class', '')} {found.get('id', '')}".lower().split())


def _mark_hinted(page: list[Token], hints: list[tuple[int, int]], ends: dict[int, int]) -> None:
    """Marks the tokens of the elements at `hints`, (element, content element around it or -1), that hold no content."""
    contents = [i for i, t in enumerate(page) if t.tag and t.opens and t.name in _CONTENT and not t.left_out]
    total = []  # by token: paragraph words before it, and all words before it
    paragraphs = words = 0
    for token in page:
        total.append((paragraphs, words))
        if not token.tag and not token.left_out:
            n = len(token.text.split())
            words += n
            paragraphs += n * token.paragraph
    total.append((paragraphs, words))

    def inside(start: int, end: int) -> tuple[int, int]:
        return tuple(b - a for a, b in zip(total[start], total[end]))

    for i, around in hints:
        end = ends.get(i, len(page))
        if any(i < c < end for c in contents):
            continue
        if around >= 0 or not contents:
            whole = inside(around, ends.get(around, len(page))) if around >= 0 else total[-1]
            kind = 0 if whole[0] else 1
            if 2 * inside(i, end)[kind] > whole[kind]:
                continue
        for token in page[i:end]:
            token.hinted = True


def tokens(page: str) -> list[Token]:
    """The tags and text runs of a page in order; comments and raw elements are gone."""
    out: list[Token] = []
    stack: list[str] = []  # open elements
    opened: list[int] = []  # and where they were opened
    contents: list[int] = []  # open article and main elements
    hints: list[tuple[int, int]] = []
    ends: dict[int, int] = {}  # by where an element was opened
    skipped, depth = "", 0  # the element that is left out, and how often its name is open inside
    at, end = 0, len(page)

    def words(a: int, b: int) -> None:
        if a < b:
            out.append(Token(False, stack[-1] if stack else "", False, page[a:b], bool(skipped), "p" in stack))

    def pop(end: int) -> str:
        name, start = stack.pop(), opened.pop()
        if contents and contents[-1] == start:
            contents.pop()
        ends[start] = end
        return name

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            words(at, end)
            break
        words(at, m.start())
        at = m.end()
        if not m[2]:
            continue
        name, closes, attributes = m[2].lower(), bool(m[1]), m[3] or ""
        if name in RAW and not closes:
            if not attributes.endswith("/>"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if name == LITERAL and not closes:
            close = re.compile(rf"</{LITERAL}\b[^>]*>", re.I).search(page, at)
            inside = html.escape(page[at : close.start() if close else end])
            block = [Token(True, name, True, "", bool(skipped)), Token(False, name, False, inside, bool(skipped)), Token(True, name, False, "", bool(skipped))]
            out.extend(block)
            at = close.end() if close else end
            continue
        out.append(Token(True, name, not closes, "", bool(skipped)))
        if name in VOID:
            continue
        if closes:
            if skipped == name:
                depth -= 1
                if not depth:
                    skipped = ""
            if name in stack:
                while pop(len(out)) != name:
                    pass
            continue
        if skipped:
            depth += name == skipped
        elif name not in ("html", "body", *_CONTENT):
            found = _attributes(attributes) if attributes != ">" else {}
            if name in LEFT_OUT or (name == "header" and not contents) or (attributes != ">" and _hidden(attributes, found)):
                skipped, depth = name, 1
                out[-1].left_out = True
            elif found and name not in _HEADINGS and _hint(found):
                hints.append((len(out) - 1, contents[-1] if contents else -1))
        # A new block ends an open paragraph; a new item ends the one before.
        if stack and (stack[-1] == "p" and name in BLOCKS or stack[-1] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
            pop(len(out) - 1)
        stack.append(name)
        opened.append(len(out) - 1)
        if name in _CONTENT:
            contents.append(len(out) - 1)
    if hints:
        _mark_hinted(out, hints, ends)
    return out


def _class(token: Token) -> str:
    name = token.name if token.name in BLOCKS or token.name in INLINE else "other"
    return f"{'tag' if token.tag else 'word'}:{name}"


def _article(page: list[Token]) -> tuple[int, int] | None:
    """The tokens between the tags of the only article; None if there is not exactly one."""
    opens = [i for i, t in enumerate(page) if t.tag and t.opens and t.name == "article"]
    closes = [i for i, t in enumerate(page) if t.tag and not t.opens and t.name == "article"]
    if len(opens) != 1 or len(closes) != 1 or closes[0] < opens[0]:
        return None
    return opens[0] + 1, closes[0]


def label_counts(page: str) -> Counter:
    """How often each class of token stands inside (True) and outside (False) the content of a labelled page."""
    found, seen = tokens(page), Counter()
    span = _article(found)
    if span is None:
        return seen
    for i, token in enumerate(found):
        if token.tag and token.name in _CONTENT:
            continue
        n = 1 if token.tag else len(token.text.split())
        if n:
            seen[_class(token), span[0] <= i < span[1]] += n
    return seen


class Weights:
    def __init__(self, counts: dict[tuple[str, bool], int], settings: Settings = Settings()):
        self.settings, self.odds = settings, {}
        firsts = {f"word:{k}": v for k, v in _WORDS_FIRST.items()} | {f"tag:{k}": v for k, v in _TAGS_FIRST.items()}
        for name in {*firsts, *(k for k, _ in counts)}:
            inside, outside = firsts.get(name, (1, 1))
            inside, outside = inside + counts.get((name, True), 0), outside + counts.get((name, False), 0)
            self.odds[name] = math.log(inside / outside)

    def of(self, token: Token) -> float:
        if token.left_out or token.tag and token.name in _CONTENT:
            return 0.0
        odds = self.odds.get(_class(token), 0.0)
        if token.tag:
            low, high = self.settings.tag_bounds
            return -min(high, max(low, low - odds))
        if token.hinted:
            return -self.settings.hinted_word * len(token.text.split())
        low, high = self.settings.word_bounds
        return min(high, max(low, odds)) * len(token.text.split())


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """The first contiguous stretch with the highest sum; empty if no sum is positive."""
    best, span, now, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if now <= 0:
            now, start = 0.0, i
        now += score
        if now > best:
            best, span = now, (start, i + 1)
    return span


def _whole_element(page: list[Token], span: tuple[int, int]) -> tuple[int, int]:
    """The innermost article or main element around a stretch, or the stretch."""
    open_at: list[int] = []
    for i, token in enumerate(page):
        if token.tag and token.name in _CONTENT:
            if token.opens:
                open_at.append(i)
            elif open_at:
                start = open_at.pop()
                if start <= span[0] and span[1] <= i + 1:
                    return start, i
    around = [i for i in open_at if i <= span[0]]
    return (around[-1], len(page)) if around else span


def text_of(page: list[Token], span: tuple[int, int]) -> str:
    """The text of a span, without what is left out or hinted at."""
    blocks, parts = [], []

    def flush() -> None:
        if block := " ".join(html.unescape("".join(parts)).split()):
            blocks.append(block)
        parts.clear()

    for i in range(*span):
        token = page[i]
        if token.tag:
            if token.name in BLOCKS:
                flush()
            elif token.name == "br":
                parts.append(" ")
        elif not token.left_out and not token.hinted:
            parts.append(token.text)
    flush()
    return "\n".join(blocks)


def extract(page: str | None, weights: Weights) -> str:
    found = tokens(page or "")
    span = best_stretch([weights.of(t) for t in found])
    return text_of(found, _whole_element(found, span)) if span[0] < span[1] else ""


def learn(pages: DataFrame, settings: Settings = Settings()) -> Weights:
    """Weights from a bounded sample of labelled pages; only the counts of each class come to the driver."""
    labelled = pages.select("page_id", F.col("html").cast("string").alias("html")).where(
        F.lower("html").contains("<article") & F.lower("html").contains("</article")
    )
    sample = first_by_hash(labelled, settings.train_pages, "page_id", "html").select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                seen.update(label_counts(page))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in seen], pa.string()), pa.array([i for _, i in seen], pa.bool_()), pa.array(seen.values(), pa.int64())],
            ["class", "inside", "n"],
        )

    counted = sample.mapInArrow(run, "class string, inside boolean, n long").groupBy("class", "inside").agg(F.sum("n").alias("n"))
    return Weights({(r["class"], r["inside"]): r["n"] for r in counted.collect()}, settings)


def main_texts(pages: DataFrame, weights: Weights) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(page, weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(found, pa.string()),
                    pa.array([len(x) for x in found], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    given = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    return given.mapInArrow(run, "page_id long, url string, text string, n_chars long")
