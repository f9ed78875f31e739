"""Main text of web pages: differencing against the page with the nearest URL on the same host, checked by structure.

Each page is parsed to blocks, in the order of host and URL path, and aligned as a whole, by longest common subsequence
of lines, with the nearer of its two neighbours; shared lines are template. The rest is checked by the page's elements: blocks
that these mark as menus, headers, footers, sidebars, notices, adverts, forms, comments or code go, since such template
varies from page to page, and where the page has a main element, or else articles that are not marked as comments,
teasers or the like, so does what stands outside. Shared lines are checked too, since neighbours also share mirrored
articles and licence lines: of a marked article only those go that all articles around it have, however unlike; elsewhere,
where they are over half of the text, only those that the other neighbour has too, or on the edge of a host the next
page but one.
"""

from __future__ import annotations

import bisect
import dataclasses
import functools
import html
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.llm._shared import modest_batches, partitions_for, read_table, slices
from lumenq.llm.url_filter import host_of, path_of

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARK = re.compile("[\"'>]")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")}
_ATTRIBUTE = re.compile(r"""([a-zA-Z:_\-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
#: Elements that begin or end a block, that are left out, and words that mark leaving out.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
LEFT_OUT = frozenset("nav footer aside form menu dialog button select datalist svg math canvas object embed audio video map head search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WORDS = "ad|ads|adv|advert|advertisement|adverts|adsense|adbox|banner|breadcrumb|breadcrumbs|comment|comments|consent|cookie|cookies|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|popup|promo|promoted|related|replies|respond|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|topbar|widget|contentinfo|complementary|alert|alertdialog"
#: Words of a class, id or role token that say where or how something stands: a token of nothing but these and marks is left out.
PLACING = frozenset(
    "area article aside bar bars block body bottom box button buttons card center col column container element entry first fixed float floating footer form frame global grid group head holder icon icons inline inner item items label last layer layout left line link links list lists main "
    "message middle outer overlay page pane panel post posts primary right row secondary section side site slot small sticky sub text title tools top unit unordered wide wrap wrapper x y".split()
)
#: A header of these is the page's own, with its title.
OWN_HEADERS = frozenset("article chapter content entry hero intro page post section story title".split())
MARKS = frozenset(_WORDS.split("|"))
HEADERS = frozenset(("header", "masthead", "banner"))
#: Whole tokens of class, id or role that mark an article as not the page's own.
OTHERS = re.compile(r"(?:^|\s)(?:(?:ad|ads|advert|comment|comments|promo|promoted|related|replies|reply|response|sidebar|sponsor|sponsored|teaser|teasers|widget)(?:[_-](?:article|body|box|card|entry|item|list|post|[0-9]+))*|[a-z0-9]+[_-](?:comment|reply|teaser))(?:$|\s)", re.I)
_ARTICLE = re.compile(r"<article[\s/>]", re.I)
_FORM = re.compile(r"<form[\s/>]", re.I)
_CLOSERS = ("article", "main", "body", "html")


def _of_others(attributes: str) -> bool:
    return any(name.lower() in ("class", "id", "role") and OTHERS.search(" ".join(values)) for name, *values in _ATTRIBUTE.findall(attributes))


def _marks(value: str, in_article: bool) -> bool:
    """Whether a token of the value marks what is left out: its words are marks, and else only tell a place.

    So related-posts and site-footer are, related-work, notice-period and has-sidebar are not. A header within an
    article, or of one, holds its title.
    """
    for token in value.lower().split():
        words = [w for w in re.split("[-_]+", token) if w and not w.isdigit()]
        marks = MARKS.intersection(words)
        if marks and (marks - HEADERS or not (in_article or OWN_HEADERS.intersection(words))) and all(w in marks or w in PLACING for w in words):
            return True
    return False


def _is_left_out(tag: str, attributes: str, in_article: bool, forms: bool = False) -> bool:
    """forms: whether a form is a wrapper of the page; then its labels go, and its controls as ever."""
    if tag == "form" and forms:
        return False
    if tag in LEFT_OUT or (tag == "header" and not in_article) or (forms and tag in ("label", "legend")):
        return True
    if tag == "article":
        return _of_others(attributes)
    if not attributes.strip() or tag in ("body", "html", "main"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id", "role") and _marks(value, in_article) and not (in_article and tag in ("h1", "h2", "h3")):
            return True
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True
    return False


class _Tags:
    """The tags of a page in order, found in time linear in its length however it is broken.

    A tag ends at the first > outside quotes. Where no such > follows, quotes are taken as text and it ends at the first
    >; where none follows at all, the < is text. The end that follows from a quote is remembered, so that no stretch is
    read twice.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.ends: dict[int, int] = {}  # by the place of a quote outside quotes: the end of the tag around it, -1 for none
        self.run = (0, -1, -1)  # from, to: no quote and no > before to, where there is one; to is -1 before the first look

    def _mark(self, at: int) -> int:
        begin, end, found = self.run
        if not begin <= at <= end:
            m = _MARK.search(self.page, at)
            found = m.start() if m else -1
            self.run = (at, found if m else len(self.page), found)
        return found

    def _end(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes begin at at."""
        passed, end = [], -1
        while True:
            mark = self._mark(at)
            if mark < 0 or self.page[mark] == ">":
                end = mark
                break
            if mark in self.ends:
                end = self.ends[mark]
                break
            passed.append(mark)
            close = self.page.find(self.page[mark], mark + 1)
            if close < 0:
                break
            at = close + 1
        self.ends.update(dict.fromkeys(passed, end))
        return end if end >= 0 else self.page.find(">", at) if not passed else self.page.find(">", passed[0])

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it closes, name, attributes) of the next tag from at; the name is empty for comments and the like."""
        page = self.page
        while True:
            start = page.find("<", at)
            if start < 0:
                return None
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, False, "", ""
            if start > self.last:  # nothing can end here but a comment
                start = page.find("<!--", start)
                if start < 0:
                    return None
                at = start
                continue
            if page.startswith(("<!", "<?"), start):
                return start, page.find(">", start) + 1, False, "", ""
            name = _NAME.match(page, start)
            end = self._end(name.end()) if name else -1
            if end >= 0:
                return start, end + 1, page[start + 1] == "/", name[1].lower(), page[name.end() : end]
            at = start + 1


def blocks_of(page: str, release: bool = False, forms: bool = False) -> list[tuple[int, str]]:
    """(mark, text) of the blocks of a page in order; mark is 2 within main, 1 within an article alone, -1 where left out, else 0.

    What is left out ends where it turns out to hold the page's main element or, with release, an article, unless it
    is marked as comments, teasers or the like. Within an article, what a class word alone leaves out ends with the first
    h1: it is the title's. forms: forms wrap the page and are not left out.
    """
    out: list[tuple[int, str]] = []
    run: list[str] = []
    left: list[str] = []  # text of what is left out
    inside: list[str] = []  # open article and main elements
    count = {"article": 0, "main": 0}
    article = 0
    skip, depth, at, others, by_word, titled = "", 0, 0, False, False, False

    def end_of(parts: list[str], mark: int) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip() if parts else ""
        parts.clear()
        if text:
            out.append((mark, text))

    def flush() -> None:
        end_of(left, -1)
        end_of(run, article)

    tags = _Tags(page)
    while True:
        found = tags.after(at)
        if not found:
            break
        start, end, closing, tag, attributes = found
        (left if skip else run).append(page[at:start])
        at = end
        if not tag:
            continue
        if not closing and tag in _RAW_END:
            over = _RAW_END[tag].search(page, at)
            at = over.end() if over else len(page)
            if not skip and tag in BLOCKS:
                flush()
            continue
        if skip:
            if tag in BLOCKS or tag == skip:
                end_of(left, -1)
            if tag == skip and not (tag in VOID or attributes.endswith("/")):
                depth += -1 if closing else 1
            if depth == 0:
                skip = ""
                continue
            if not closing and (tag == "main" or (tag == "article" and release and not others and not _is_left_out(tag, attributes, False, forms))) and not inside:
                skip = ""
            elif not closing and tag == "h1" and by_word and inside and not titled:
                skip = ""
            elif not closing or tag not in _CLOSERS or tag == skip or (not count.get(tag) and tag not in ("body", "html")):
                continue
            skip = ""
        elif not closing and tag not in VOID and _is_left_out(tag, attributes, bool(article), forms):
            if tag in BLOCKS:
                flush()
            if not attributes.endswith("/"):
                by_word = tag not in LEFT_OUT and tag != "article"
                skip, depth, others = tag, 1, tag == "article" or _of_others(attributes)
            continue
        titled = titled or (tag == "h1" and bool(inside))
        if tag == "br":
            run.append(" ")
        elif tag in BLOCKS:
            flush()
            if tag in ("article", "main"):
                if not closing:
                    inside.append(tag)
                    count[tag] += 1
                elif count[tag]:
                    ended = ""
                    while ended != tag:
                        ended = inside.pop()
                        count[ended] -= 1
                article = 2 if count["main"] else int(bool(inside))
    (left if skip else run).append(page[at:])
    flush()
    return out


def judged_blocks(page: str) -> tuple[bool, list[str], list[bool]]:
    """Whether the page marks an article, all its blocks in order, and for each whether the elements count it to the main text.

    That is the page's main element, or else all its articles; where it marks neither, whatever is not left out. Where
    forms hold more than half of the text that would be found, but for labels and controls, they are wrappers of the page
    or of its article, and their blocks count.
    """

    def found(forms: bool) -> tuple[list[tuple[int, str]], int]:
        blocks = blocks_of(page, False, forms)
        best = max((mark for mark, _ in blocks if mark > 0), default=0)
        if not best and _ARTICLE.search(page):
            blocks = blocks_of(page, True, forms)
            best = max((mark for mark, _ in blocks if mark > 0), default=0)
        return blocks, best

    blocks, best = found(False)
    if _FORM.search(page):
        wrapped, top = found(True)
        if top >= best and sum(len(t) for mark, t in wrapped if mark == top) > 2 * sum(len(t) for mark, t in blocks if mark == best):
            blocks, best = wrapped, top
    return best > 0, [t for _, t in blocks], [mark == best for mark, _ in blocks]


def split_page(page: str) -> tuple[list[str] | None, list[str]]:
    """The blocks of the page's main element, or else of all its articles, None if it marks neither, and what else counts to its text then."""
    marked, lines, own = judged_blocks(page)
    text = list(itertools.compress(lines, own))
    return (text, []) if marked else (None, text)


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence of lines with b.

    By Hunt and Szymanski's method where few pairs of lines are equal; where lines repeat, a is halved as by Hirschberg,
    with the rows of the length table as bits of whole numbers, so that memory stays linear in the lines.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    shared = {*range(start), *range(len(a) - end, len(a))}
    parts = [(start, len(a) - end, start, len(b) - end)]
    while parts:
        begin, stop, low, high = parts.pop()
        places: dict[str, list[int]] = defaultdict(list)
        for j in range(low, high):
            places[b[j]].append(j)
        if sum(len(places.get(a[i], ())) for i in range(begin, stop)) <= 8 * (stop - begin + high - low):
            shared |= _by_pairs(a, begin, stop, places)
            continue
        middle = (begin + stop) // 2
        first = _lengths((a[i] for i in range(begin, middle)), places, low, high - low)
        mirrored = {line: [low + high - 1 - j for j in at] for line, at in places.items()}
        last = _lengths((a[i] for i in range(stop - 1, middle - 1, -1)), mirrored, low, high - low)
        cut = low + max(range(high - low + 1), key=lambda k: first[k] + last[high - low - k])
        parts += [(begin, middle, low, cut), (middle, stop, cut, high)]
    return shared


def _by_pairs(a: list[str], begin: int, stop: int, places: dict[str, list[int]]) -> set[int]:
    """Positions in a, from begin to stop, of a longest common subsequence with lines that stand at places."""
    tails: list[int] = []
    chain: list[tuple | None] = []
    for i in range(begin, stop):
        for j in reversed(places.get(a[i], ())):
            k = bisect.bisect_left(tails, j)
            link = (i, chain[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chain.append(link)
            else:
                tails[k], chain[k] = j, link
    out = set()
    link = chain[-1] if chain else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def _lengths(lines: Iterator[str], places: dict[str, list[int]], low: int, n: int) -> list[int]:
    """For each k up to n, the length of a longest common subsequence of lines with those that stand at the k places from low."""
    full = (1 << n) - 1
    bits: dict[str, int] = {}
    row = full  # a bit is 0 where the length grows
    for line in lines:
        if line not in places:
            continue
        if line not in bits:
            at = bytearray(n // 8 + 1)
            for j in places[line]:
                at[(j - low) >> 3] |= 1 << ((j - low) & 7)
            bits[line] = int.from_bytes(at, "little")
        met = row & bits[line]
        row = ((row + met) | (row - met)) & full
    return [0, *itertools.accumulate(1 - int(bit) for bit in reversed(f"{row:0{n}b}"))] if n else [0]


@dataclasses.dataclass
class Page:
    """A page in the order of host and path; a guest is there for its neighbours only. lines and own as judged_blocks gives them."""

    page_id: int | None
    url: str | None
    host: str
    path: str
    guest: bool
    marked: bool
    lines: list[str]
    own: list[bool]

    @functools.cached_property
    def article(self) -> frozenset[str]:
        """The lines of the article that the page marks."""
        return frozenset(itertools.compress(self.lines, self.own)) if self.marked else frozenset()


def main_lines(page: Page, before: list[Page], after: list[Page]) -> list[str]:
    """The lines of the page's main text, by the pages next to it, the nearest first.

    Lines shared with the page of the nearest URL on the host are template, unless a check says otherwise; what is not
    shared counts if the elements say so. The check of a marked article is every_article; elsewhere, where shared
    lines are over half of the text, those that the next page lacks are a mirrored text and stay. A page all of whose
    lines remain to be deleted is a mirror as a whole, and stays.
    """
    own = {i for i, counts in enumerate(page.own) if counts}
    before, after = ([p for p in some if page.host and p.host == page.host] for some in (before, after))
    near = sorted((*before[:1], *after[:1]), key=lambda p: -_nearness(p.path, page.path))
    near = (near if len(near) > 1 else [*near, *before[1:2], *after[1:2]])[:2]
    gone = common_lines(page.lines, near[0].lines) & own if near else set()
    if gone and page.marked:
        gone = every_article(page, gone, [*before, *after])
    elif len(near) > 1 and 2 * sum(len(page.lines[i]) for i in gone) > sum(len(page.lines[i]) for i in own):
        gone &= common_lines(page.lines, near[1].lines)
    return [page.lines[i] for i in sorted(own if gone == own else own - gone)]


def every_article(page: Page, shared: set[int], around: list[Page]) -> set[int]:
    """Those shared lines that all marked articles around have, WITNESSES at least that are unlike the page's and each other.

    Such lines are the site's; a mirrored article's lines, and a licence line that some articles have, are the article's.
    Articles are unlike if, without these lines, at most half of the shorter is shared.
    """
    articles = [p.article for p in around if p.article]
    if len(articles) < WITNESSES:
        return set()
    for article in articles:
        shared = {i for i in shared if page.lines[i] in article}
        if not shared:
            return shared
    gone = {page.lines[i] for i in shared}
    unlike: list[tuple[int, frozenset[str]]] = []
    for article in (page.article, *articles):
        rest = article - gone
        size = sum(map(len, rest))
        if rest and all(2 * sum(map(len, rest & other)) <= min(size, n) for n, other in unlike):
            unlike.append((size, rest))
    return shared if page.article - gone and len(unlike) > WITNESSES else set()


def _nearness(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of host and path; each is held until its next REACH are known. Guests are neighbours only."""

    def rows() -> Iterator[Page]:
        for batch in batches:
            for part in slices(batch, "html", 2_000_000):
                for *key, page in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "host", "path", "guest", "html")), strict=True):
                    yield Page(*key, *judged_blocks(page))

    out: list[list] = [[], [], []]
    size = 0

    def emit() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["page_id", "url", "text"])
        for column in out:
            column.clear()
        return batch

    window: list[Page | None] = [None] * (2 * REACH + 1)
    for last in itertools.chain(rows(), [None] * REACH):
        window = [*window[1:], last]
        page = window[REACH]
        if page is not None and not page.guest:
            before, after = ([p for p in some if p is not None] for some in (window[REACH - 1 :: -1], window[REACH + 1 :]))
            found = "\n\n".join(main_lines(page, before, after))
            size += len(found)
            for column, value in zip(out, (page.page_id, page.url, found), strict=True):
                column.append(value)
            if size > 4_000_000:
                yield emit()
                size = 0
    if out[0]:
        yield emit()


#: Pages that a range of URLs is cut by.
SAMPLED = 50
#: Pages on each side of a page that are looked at, and unlike articles among them that must have a line for it to be the site's.
REACH, WITNESSES = 8, 8


def _dealt(asked: DataFrame, n: int) -> DataFrame:
    """asked in at most n ranges of host, path and page_id, a partition each; guest marks copies of the pages next to a range.

    Ranges are cut by a sample, and the driver gets it and each range's first and last REACH keys.
    """
    key = F.struct("host", "path", F.coalesce("page_id", F.lit(-(2**63)).cast("bigint")).alias("id"))
    keys = asked.select(key.alias("key"))
    share = min(1.0, SAMPLED * n / max(1, keys.count()))
    found = keys.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).collect() if n > 1 else []
    found = sorted(tuple(r.key) for r in found)
    cuts = sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []
    literal = lambda k: F.struct(F.lit(k[0]).alias("host"), F.lit(k[1]).alias("path"), F.lit(k[2]).cast("bigint").alias("id"))
    place = lambda k: F.size(F.filter(F.array(*map(literal, cuts)), lambda c: c <= k)) if cuts else F.lit(0)
    ends: list = []
    if cuts:
        edge = F.array_sort(F.collect_set("key"))
        for r in keys.groupBy(place(F.col("key")).alias("at")).agg(edge.alias("all")).select("at", F.array_union(F.slice("all", 1, REACH), F.slice("all", -F.least(F.size("all"), F.lit(REACH)), REACH)).alias("keys")).collect():
            ends += [(r["at"], tuple(k)) for k in r["keys"]]
    ends.sort()
    guests = [(*k, at) for i, (at, _) in enumerate(ends) for own, k in ends[max(0, i - REACH) : i + REACH + 1] if own != at]
    to = F.array(place(key))
    if guests:
        given = asked.sparkSession.createDataFrame(guests, "h string, p string, i bigint, to int").groupBy("h", "p", "i").agg(F.collect_set("to").alias("more"))
        asked = asked.join(F.broadcast(given), (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")) & (key["id"] == F.col("i")), "left")
        to = F.concat(to, F.coalesce("more", F.array().cast("array<int>")))
    out = asked.select("page_id", "url", "host", "path", "html", F.posexplode(to).alias("turn", "to"))
    out = out.select("page_id", "url", "host", "path", (F.col("turn") > 0).alias("guest"), "html", "to")
    return out.repartitionById(n, "to").drop("to").sortWithinPartitions("host", "path", "page_id")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", partitions: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    Null and empty html gives an empty text; very long pages are read whole, in time linear in their length, and aligned in
    memory linear in their lines; where very many lines of both pages are equal, the time of this grows with the product of
    their numbers, in steps of many pairs. A page without a host has no neighbours. Pages at the edge of a range of
    URLs that one task holds are dealt to the next range too, so neighbours are the same however many ranges there are. Repeated rows are pages
    of their own. partitions: ranges, the session's shuffle partitions if None. Other columns are ignored; an empty table gives an empty result.
    """
    modest_batches(pages.sparkSession)
    asked = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    ordered = _dealt(asked, partitions or partitions_for(pages.sparkSession))
    return ordered.mapInArrow(_differenced, "page_id bigint, url string, text string").select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(read_table(spark, sf_dir, "pages"))
