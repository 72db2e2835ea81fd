"""Main text of raw HTML pages by two-pass block rules.

A tolerant parser cuts a page into blocks (text between block-level tags), each with its length in words, its
share of stop words, the share of its letters inside links, and where it stands.

Pass 1 decides the clear cases. Bad: inside menus, page headers, footers, sidebars, forms, notices, adverts
and reader comments (by tag, role, or a class or id that says so), or mostly links. Good: enough words
with enough stop words. The rest (short, or few stop words) stays open.
A name says so if all its parts do, apart from words of place ("site-footer", "ad_box2", but not "has-sidebar" or
"category-promotion"). Names never decide against ``main`` or an outermost ``article``, nor against a container with
most of the link-poor words of a page without ``main`` or ``article`` (comments excepted). A form is bad if it has few words for its controls. ``main`` and ``article``
end a menu left open. If all blocks end bad, those that are bad by a name alone are decided again by density.
In a section without any good block (another language, say) open blocks that are long and poor in links are good.
Pass 2 gives an open block the label of its nearest decided neighbours, those in its own section (article)
first (blocks in menus and the like decide for no other); if both sides are equally near and differ, that of the following one for a heading, else bad. With no decided
neighbour at all it is good, as in a page of one short line.

A head without end tag ends at the first tag that cannot stand in it. Scripts, styles, the head, comments in the markup and hidden elements are no blocks. Character references
are decoded, white space inside a block becomes one space (``br`` included, two of them end a block), good blocks are joined in
page order by one newline. Nothing is cut.

Defined results: null or empty html gives the empty text; text outside any tag is a block; broken or
unclosed markup is read as far as it goes; an empty table gives an empty table; columns named like an output
are replaced."""
from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_arrow, quoted, slices, with_fields, without

# Frequent function words of the languages read, names that mark boilerplate.
STOP_WORDS = frozenset("""
the of and to in a is it that for on with as was at by be this are or from not have an they which
le la les de des du et un une en que qui dans pour pas sur au aux avec est il elle ce se plus par ne
der die das und ist von zu mit den dem ein eine nicht auf für sich im des als auch es an werden
el los las y un una que en se del por con para al lo como más su no es
""".split())
BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre
section summary table tbody td tfoot th thead tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("""script style noscript template head title svg math iframe object canvas audio video select
textarea button datalist map""".split())
BAD_TAGS = frozenset("nav footer aside menu dialog".split())
CONTROLS = frozenset("input select textarea button".split())
BAD_ROLES = frozenset("""navigation banner contentinfo complementary search form alert alertdialog dialog
menu menubar""".split())
COMMENT_NAMES = frozenset("""comment comments commentlist reply replies respond disqus discussion related
recommended""".split())
BAD_NAMES = frozenset("""ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo
promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe
subscription signup login register paywall sidebar menu navbar nav navigation breadcrumb breadcrumbs footer
masthead topbar share sharing social widget toolbar pagination pager search skip""".split())
HEADER_NAMES = frozenset("header pageheader siteheader".split())
#: Words of place and shape that may stand in a name beside those above.
PLACES = frozenset("""site page main global left right top bottom upper lower sticky fixed primary secondary box bar block area section
container wrapper wrap inner outer content list item items link links button buttons icon icons slot unit zone banner form text body
post posts article articles entry footer header panel column col row the id div""".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MIN_WORDS, MIN_STOP, MAX_LINKS = 8, 0.12, 0.5
MIN_CHARS = 5 * MIN_WORDS
#: Words that a form needs, once and per control, to count as a part of the page.
FORM_WORDS = 20

_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_LETTERS = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("words", "linked", "chars", "bad", "section", "heading", "marks", "form")

    def __init__(self, words, linked, chars, bad, section, heading, marks=(), form=0):
        self.words, self.linked, self.chars = words, linked, chars
        self.bad, self.section, self.heading = bad, section, heading
        self.marks, self.form = marks, form  # containers with a bad name, form


class BlockParser(HTMLParser):
    """Cuts a page into blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple] = []  # tag, and what held before it: bad, section, silent, link, marks, form
        self.bad, self.section, self.silent, self.link = False, 0, False, False
        self.marks, self.form = (), 0
        self.n_marks, self.controls = 0, [0]
        self.sections = 0
        self.heading = False
        self.breaks = 0
        self.text: list[str] = []
        self.linked = 0
        self.chars = 0

    def flush(self):
        if self.text:
            words = "".join(self.text).split()
            if words:
                self.blocks.append(Block(words, self.linked, max(self.chars, 1), self.bad, self.section, self.heading, self.marks, self.form))
            self.text, self.linked, self.chars = [], 0, 0
        self.breaks = 0

    def handle_starttag(self, tag, attrs):
        if self.open and self.open[-1][0] == "head" and tag not in IN_HEAD:
            self.restore(len(self.open) - 1)  # a head left open
        if tag == "br":
            self.breaks += 1
            if self.breaks > 1:
                self.flush()
            elif not self.silent:
                self.text.append(" ")
            return
        if tag in BLOCK_TAGS:
            self.flush()
        if tag in CONTROLS:
            self.controls[self.form] += 1
        if tag in VOID_TAGS:
            return
        if tag in ("main", "article"):
            self.end_menu(tag)
        if tag == "p" or tag == "li" or tag == "a":
            self.close_open(tag)
        self.open.append((tag, self.bad, self.section, self.silent, self.link, self.marks, self.form))
        if self.silent:
            return
        if tag in HEADINGS:
            self.heading = True
        elif tag in BLOCK_TAGS:
            self.heading = False
        if tag == "a":
            self.link = True
        if tag in NO_TEXT:
            self.silent = True
            return
        names, role, hidden = self.names(attrs)
        if hidden:
            self.silent = True
        elif tag in ("article", "main"):
            inner = any(o[0] == "article" for o in self.open[:-1])
            if inner and says(names, COMMENT_NAMES):
                self.bad = True
            elif not self.bad:
                self.marks, self.form = (), 0
            self.sections += 1
            self.section = self.sections
        elif tag in ("html", "body"):
            pass
        elif tag in BAD_TAGS or role in BAD_ROLES or says(names, COMMENT_NAMES):
            self.bad = True
        elif tag == "form":
            self.controls.append(0)
            self.form = len(self.controls) - 1
        elif says(names, BAD_NAMES) or (tag == "header" or says(names, HEADER_NAMES)) and not self.section:
            self.n_marks += 1
            self.marks = (*self.marks, self.n_marks if tag != "header" else -self.n_marks)

    def end_menu(self, tag):
        """``main`` and ``article`` end a nav left open before them, ``main`` an aside too."""
        for i, o in enumerate(self.open):
            if o[0] == "nav" or o[0] == "aside" and tag == "main":
                self.flush()
                self.restore(i)
                return

    @staticmethod
    def names(attrs):
        found, role, hidden = set(), "", False
        for k, v in attrs:
            if k in ("class", "id") and v:
                found.update(tuple(_NAME.findall(_CAMEL.sub("-", name).lower())) for name in v.split())
            elif k == "role":
                role = (v or "").lower()
            elif k == "hidden" or k == "aria-hidden" and v == "true":
                hidden = True
            elif k == "style" and v and "display:none" in v.replace(" ", "").lower():
                hidden = True
        return found, role, hidden

    def close_open(self, tag):
        """A new p, li or a ends an open one, unless a container stands between."""
        for i in range(len(self.open) - 1, max(-1, len(self.open) - 8), -1):
            t = self.open[i][0]
            if t == tag:
                self.restore(i)
                return
            if t in BLOCK_TAGS and t not in ("p",):
                return

    def restore(self, i):
        _, self.bad, self.section, self.silent, self.link, self.marks, self.form = self.open[i]
        del self.open[i:]

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.restore(i)
                break
        if tag in HEADINGS:
            self.heading = False

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and tag not in ("p", "div"):
            self.handle_endtag(tag)

    def handle_data(self, data):
        if self.silent:
            return
        if not data.isspace():
            self.breaks = 0
            n = len(data) - data.count(" ")
            self.chars += n
            if self.link:
                self.linked += n
        self.text.append(data)


def says(names: set[tuple[str, ...]], words: frozenset) -> bool:
    """Whether a class or id says one of ``words`` and nothing else but boilerplate and words of place."""
    return any(any(p in words for p in parts) and all(p in words or p in PLACES or p in BAD_NAMES for p in parts) for parts in names)


def blocks_of(html: str) -> list[Block]:
    parser = BlockParser()
    parser.feed(html)
    parser.close()
    parser.flush()
    blocks = parser.blocks
    words: dict[tuple[str, int], int] = {}
    total = 0
    for b in blocks:
        if not b.bad:
            poor = len(b.words) if b.linked / b.chars < MAX_LINKS else 0
            total += poor
            for key in [("mark", m) for m in b.marks]:
                words[key] = words.get(key, 0) + poor
            if b.form:
                words["form", b.form] = words.get(("form", b.form), 0) + len(b.words)
    marked = any(b.section and not b.bad for b in blocks)
    for b in blocks:
        if b.form and words.get(("form", b.form), 0) < FORM_WORDS * (1 + parser.controls[b.form]):
            b.bad = True
        # a named container that holds most of a page without article is no side matter (page headers are)
        b.marks = tuple(m for m in b.marks if m < 0 or marked or 2 * words.get(("mark", m), 0) <= total)
    return blocks


def _first_pass(b: Block) -> bool | None:
    if b.bad or b.marks:
        return False
    links = b.linked / b.chars
    words = _LETTERS.findall(" ".join(b.words).lower())
    stop = sum(map(STOP_WORDS.__contains__, words)) / max(len(words), 1)
    if links >= MAX_LINKS:
        return None if b.heading or len(words) >= MIN_WORDS and stop >= MIN_STOP else False
    return True if len(words) >= MIN_WORDS and stop >= MIN_STOP else None


def _long(b: Block) -> bool:
    """Enough words, or as much text without blanks between words."""
    return len(b.words) >= MIN_WORDS or b.chars >= MIN_CHARS


def labels(blocks: list[Block]) -> list[bool]:
    """Good or not, after both passes; once more without names if nothing is left."""
    good = _both_passes(blocks)
    if not any(good) and any(b.marks and not b.bad for b in blocks):
        for b in blocks:
            b.marks = ()
        good = _both_passes(blocks)
    return good


def _both_passes(blocks: list[Block]) -> list[bool]:
    first = [_first_pass(b) for b in blocks]
    n = len(blocks)
    known = {b.section for b, good in zip(blocks, first) if good}
    for i, b in enumerate(blocks):
        if first[i] is None and b.section not in known and _long(b) and b.linked / b.chars < MAX_LINKS:
            first[i] = True

    def neighbours(within: bool):
        """Label and distance of the nearest decided block on each side; ``within``: of the same section."""
        def sweep(order):
            last: dict[int, int] = {}
            out: list[tuple[bool, int] | None] = [None] * n
            for i in order:
                key = blocks[i].section if within else 0
                if first[i] is not None and not blocks[i].bad and not blocks[i].marks:
                    last[key] = i
                elif first[i] is None and key in last:
                    out[i] = (first[last[key]], abs(i - last[key]))
            return out
        return sweep(range(n)), sweep(range(n - 1, -1, -1))

    same, whole = neighbours(True), neighbours(False)
    out = []
    for i, b in enumerate(blocks):
        if first[i] is not None:
            out.append(first[i])
            continue
        before, after = same[0][i], same[1][i]
        if before is None and after is None:
            if b.section:  # an article of short blocks only
                out.append(True)
                continue
            before, after = whole[0][i], whole[1][i]
        if before is None or after is None:
            near = before or after
            out.append(near[0] if near else True)
        elif before[0] == after[0]:
            out.append(before[0])
        elif b.heading:
            out.append(after[0])
        else:
            out.append(before[0] if before[1] < after[1] else after[0] if after[1] < before[1] else False)
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    blocks = blocks_of(html)
    return "\n".join(" ".join(b.words) for b, good in zip(blocks, labels(blocks)) if good)


def extract(pages: DataFrame, html_col: str = "html", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` (default: all columns of ``pages``) with text and n_chars (code points)."""
    keep = keep if keep is not None else without(pages, "text", "n_chars")
    kept = pages.select(*keep)
    columns = kept.columns
    (work,) = fresh(kept, "_html")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [main_text(h) for h in part.column(len(columns)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*columns, "text", "n_chars"])

    return map_arrow(pages.select(*keep, quoted(html_col).alias(work)), run,
                     with_fields(kept.schema, ("text", "string"), ("n_chars", "long")))


def op8(spark, sf_dir):
    from .common import table
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"), keep=[F.col("page_id"), F.col("url")])
