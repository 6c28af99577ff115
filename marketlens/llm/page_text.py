"""Main text of web pages: host-wise suffix arrays over page token streams.

A page is cut into blocks of text at block-level tags, with character references decoded.
Blocks carry a region: main (inside an article or main element), chrome (inside navigation,
header, footer, sidebar, advert, form or comment elements, by tag, role or class), or body.
Scripts, styles and the like hold no text.  An article or main element inside a form or a
wrapper with a telling class is main again, but not inside navigation, aside, footer or comment
elements or hidden ones.

All blocks form the page's token stream: first those outside main regions in a row, then each
block of the main regions for itself.  The streams of a host's distinct pages (by HTML) are
concatenated and a suffix array of depth ``DEPTH`` (a power of two) is built by prefix doubling.
Suffixes that agree in ``DEPTH`` tokens are repeated substrings if they lie in ``SHARE`` of the
host's distinct pages, or inside main regions in ``MAIN_SHARE`` of its distinct articles (copies of
an article are one), and in ``LEAST_PAGES`` at least.  A run that they cover is boilerplate if it
has ``RUN_WORDS`` words or is made of whole blocks; other runs stay.  A shorter block counts as
one string; it goes if ``MOST`` of the pages (articles) hold it, or if enough of them do and it
borders on text that goes.  So common phrases, subheadings and copies of a few pages stay on a
host of any size, and a host of two pages loses nothing here.  Text in chrome regions goes even
where it is unique.

A host is cut into groups of pages by hash, each of about ``GROUP_BYTES`` of HTML and at least
``GROUP_PAGES`` pages, with an array of its own.  What has a share of a host's pages has that
share in one of its groups at least, so each group names its candidates, all groups of the host
count them, and a group gets back those repeated substrings that it holds.  A group has at most
(words of a page / share) candidates, however large the host.  The result is that of one array
per host, and a host with a third of all pages is many small tasks.

Defined cases: null and empty pages give the empty text; a page cut off inside a tag, comment
or script loses that unfinished piece; a null URL, or one without a host, is the host "";
repeated rows are extracted alike (and are one page); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.shared import cut
from marketlens.llm.tokens import hashed, mix

DEPTH = 8
RUN_WORDS = 12  # a shorter repeated run goes only if it is made of whole blocks
LEAST_PAGES = 3
SHARE = 0.2  # of the host's distinct pages, for runs and for short blocks beside them
MOST = 0.5  # of the host's distinct pages, for short blocks alone
MAIN_SHARE = 0.5  # of the host's distinct articles, for text inside main regions
GROUP_BYTES = 512 << 10
GROUP_PAGES = 16

# HTML elements by their role in the page.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video select datalist textarea title".split())
CHROME = frozenset("nav header footer aside form menu dialog button fieldset".split())
MAIN = frozenset("article main".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
CHROME_NAMES = frozenset("""
ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs
header masthead footer sidebar aside widget related recommended share sharing social cookie cookies consent notice notices
gdpr popup modal newsletter subscribe signup login form search comment comments disqus replies reply pagination pager
""".split())

# A main element opens a main region again in any chrome but these.
CLOSED = frozenset("nav aside footer".split())
COMMENT_NAMES = frozenset("comment comments disqus replies reply".split())
NEGATIONS = frozenset("has with no without hide".split())
# Inside an article a class names chrome if it has no words but chrome names and these.
PLACES = frozenset("""
area bar block bottom box button buttons card container content footer form frame head header icon icons inline inner input
item items left link links list main outer page panel post posts right row section site slot small text title top unit wrap wrapper
""".split())

# Start tags that end an open paragraph, and the elements an open sibling is ended by.
ENDS_P = frozenset("""
address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr li main menu nav ol p pre search section summary table ul
""".split())
ENDS = {
    "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "option": frozenset(["option"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tr": frozenset(["td", "th", "tr"]),
}
CELLS = frozenset("td th tr".split())
BOUNDS = frozenset("table caption td th button html body template".split())

_PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))?)*)(>|\Z)|</[^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=\s|/|\Z)""", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
_SPACES = re.compile(r"\s+")

_ROLE_MAIN = re.compile(r"""(?:^|\s)role\s*=\s*(["']?)\s*main\s*\1(?=\s|/|\Z)""", re.I)

# CLOSED_CHROME is used inside blocks() only: chrome in which no main region opens.
BODY, IN_MAIN, IN_CHROME, CLOSED_CHROME = 0, 1, 2, 3


def _closed(name: str, attributes: str) -> bool:
    """Whether a chrome element holds no main region: navigation, aside, footer and comments, and what is hidden."""
    if name in CLOSED:
        return True
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ("navigation", "complementary", "contentinfo"):
            return True
        if key in ("class", "id"):
            words = re.split(r"[\s_-]+", value)
            if any(w in COMMENT_NAMES and (not k or words[k - 1] not in NEGATIONS) for k, w in enumerate(words)):
                return True
    return False


def _chrome(name: str, attributes: str, in_main: bool) -> bool:
    # A header inside the article holds its title and byline; elsewhere it is the site's.
    if name in CHROME and not (in_main and name == "header"):
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in CHROME_ROLES:
            return True
        if key in ("class", "id") and name not in ("body", "html"):
            words = re.split(r"[\s_-]+", value)
            # a main element is chrome only as a reader's comment; "has-sidebar" names no sidebar
            names = COMMENT_NAMES if name in MAIN else CHROME_NAMES - {"header"} if in_main else CHROME_NAMES
            if in_main and name not in MAIN:
                # "search-results-study" is no search
                tokens = [re.split(r"[_-]+", token) for token in value.split()]
                words = [w for token in tokens if all(w in names or w in PLACES or w in NEGATIONS for w in token) for w in token]
            if any(w in names and (not k or words[k - 1] not in NEGATIONS) for k, w in enumerate(words)):
                return True
    return False


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, region) of the page's blocks in order; white space made single and trimmed, empty blocks left out."""
    out: list[tuple[str, int]] = []
    if not page:
        return out
    text: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # open elements: name, region, skipped
    region, skipped = BODY, False

    def ended_from(name: str) -> int:
        """Place in the stack from which the start tag ``name`` ends open elements (the stack's size: none)."""
        ends, last = ENDS.get(name, ()), len(stack)
        for k in range(len(stack) - 1, -1, -1):
            above = stack[k][0]
            if above in ends or above == "p" and name in ENDS_P:
                last = k
            elif above == "table" or name not in CELLS and (above in BOUNDS or above in ENDS_P and above not in ("p", "div", "address")):
                break
            elif above == "div" and not ends:
                break
        return last

    def close_block():
        if text:
            joined = _SPACES.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                out.append((joined, min(region, IN_CHROME)))
            text.clear()

    at = 0
    while True:
        m = _PIECE.search(page, at)
        end = m.start() if m else len(page)
        if end > at and not skipped:
            text.append(page[at:end])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[4] != ">":
            break  # cut off inside a tag
        if name not in INLINE:
            close_block()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name in INLINE and any(s[0] not in INLINE for s in stack[k + 1 :]):
                        break
                    if stack[k][1:] != (region, skipped) or k < len(stack) - 1:
                        close_block()
                    del stack[k:]
                    region, skipped = (stack[-1][1], stack[-1][2]) if stack else (BODY, False)
                    break
            continue
        if name in ENDS_P or name in ENDS:
            k = ended_from(name)
            if k < len(stack):
                del stack[k:]
                region, skipped = (stack[-1][1], stack[-1][2]) if stack else (BODY, False)
        if name in VOID or m[3].rstrip().endswith("/") and name not in _RAW:
            continue
        if name in _RAW:
            close = _RAW[name].search(page, at)
            at = close.end() if close else len(page)
            continue
        was = (region, skipped)
        if name in SKIPPED or name == "head":
            now = (region, True)
        elif region == CLOSED_CHROME:
            now = was
        elif _chrome(name, m[3], region == IN_MAIN):
            now = (CLOSED_CHROME if _closed(name, m[3]) else IN_CHROME, skipped)
        elif name in MAIN or _ROLE_MAIN.search(m[3]):
            now = (IN_MAIN, skipped)
        else:
            now = was
        if name == "body":
            now = (now[0], False)
        if now != was:
            close_block()
        stack.append((name, *now))
        region, skipped = now
    close_block()
    return out


def host(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; "" if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of the suffix at each position, by its first ``depth`` tokens (prefix doubling).

    Equal ranks mean equal prefixes; ranks order the suffixes as a suffix array of that depth does.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    reach = 1
    while reach < depth:
        ahead = np.zeros_like(rank)
        ahead[:-reach] = rank[reach:] if reach < len(rank) else 0
        rank = np.unique(rank * (rank.max() + 1) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        reach *= 2
    return rank


def _prefix_hash(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Hash of the ``depth`` tokens from each position (equal strings have equal hashes in all groups)."""
    out = np.full(len(tokens), depth, np.uint64)
    for k in range(depth):
        ahead = np.zeros_like(tokens)
        ahead[: max(0, len(tokens) - k)] = tokens[k:]
        out = out * np.uint64(0x9FB21C651E98DF25) + ahead
    return mix(out)


class _Group:
    """The distinct pages of one group: all words in stream order, and where blocks and pages lie."""

    def __init__(self, table: pa.Table):
        numbers = table["page"].to_numpy()
        _, self.rows = np.unique(numbers, return_index=True)
        self.page_of = {p: n for n, p in enumerate(numbers[self.rows].tolist())}
        self.blocks, buf, at, page, main = [], [], [], [], []
        articles: dict[int, int] = {}
        counts = []  # whether the page's article is the first of its kind
        total = 0
        for n, i in enumerate(self.rows.tolist()):
            raw = _unpacked(table["packed"][i].as_py())
            regions = table["regions"][i].as_py()
            self.blocks.append((raw, regions))
            article = table["article"][i].as_py()
            counts.append(article is not None and articles.setdefault(article, n) == n)
            for b, region in zip(raw, regions, strict=True):
                buf.append(b)
                at.append(total)
                total += len(b) + 1
                page.append(n)
                main.append(region == IN_MAIN)
        self.pages, self.articles = len(self.rows), sum(counts)
        h, starts, _ = hashed(b"\n".join(buf))
        self.page, self.main = np.array(page, np.int64), np.array(main, bool)
        first = np.append(np.searchsorted(starts, np.array(at, np.int64)), len(h)).astype(np.int64)
        self.size = np.diff(first)
        # stream order: the words outside main regions of a page, then its main blocks
        order = np.lexsort((np.arange(len(self.page)), self.main, self.page))
        self.order, self.first = order, np.zeros(len(order), np.int64)
        self.first[order] = np.cumsum(self.size[order]) - self.size[order]
        block = np.repeat(order, self.size[order])
        self.words = h[np.arange(len(h)) - self.first[block] + first[:-1][block]] if len(h) else h
        self.block = block
        # no substring spans two pages, or two blocks of an article
        self.segment = np.where(self.main[block], block, -1 - self.page[block])
        self.counted = ~self.main | np.array(counts, bool)[self.page] if len(page) else np.zeros(0, bool)

    def valid(self, depth: int) -> np.ndarray:
        """Positions with ``depth`` words of one segment."""
        n = len(self.words) - depth + 1
        return np.flatnonzero(self.segment[:n] == self.segment[depth - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def signatures(self, depth: int) -> np.ndarray:
        """Hash of the substring from each position; main regions have hashes of their own."""
        return mix(_prefix_hash(self.words, depth) + self.main[self.block].astype(np.uint64))

    def short(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The blocks of fewer than ``depth`` words, and their hashes."""
        found = np.flatnonzero((self.size > 0) & (self.size < depth))
        sig = self.size[found].astype(np.uint64)
        for k in range(depth - 1):
            more = self.size[found] > k
            sig[more] = sig[more] * np.uint64(0x9FB21C651E98DF25) + self.words[self.first[found[more]] + k]
        return found, mix(mix(sig) + self.main[found].astype(np.uint64))

    def held(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The group's substrings, whether they lie in main regions, and how many distinct pages (articles) hold them."""
        at = self.valid(depth)
        at = at[self.counted[self.block[at]]]
        sigs, mains, counts = [], [], []
        if len(at):
            rank, sig = suffix_ranks(self.words, depth), self.signatures(depth)
            main, page = self.main[self.block], self.page[self.block]
            # the suffix array: positions sorted by rank; neighbours of equal rank share the string
            at = at[np.lexsort((page[at], rank[at], main[at]))]
            string = (np.diff(rank[at], prepend=-1) != 0) | (np.diff(main[at].astype(np.int8), prepend=-1) != 0)
            owner = string | (np.diff(page[at], prepend=-1) != 0)
            heads = np.flatnonzero(string)
            sigs.append(sig[at[heads]])
            mains.append(main[at[heads]])
            counts.append(np.add.reduceat(owner.astype(np.int64), heads))
        found, sig = self.short(depth)
        use = self.counted[found]
        found, sig = found[use], sig[use]
        if len(found):
            order = np.lexsort((self.page[found], sig))
            found, sig = found[order], sig[order]
            string = np.append(True, sig[1:] != sig[:-1])
            owner = string | np.append(True, self.page[found][1:] != self.page[found][:-1])
            heads = np.flatnonzero(string)
            sigs.append(sig[heads])
            mains.append(self.main[found[heads]])
            counts.append(np.add.reduceat(owner.astype(np.int64), heads))
        if not sigs:
            return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
        return np.concatenate(sigs), np.concatenate(mains), np.concatenate(counts)


def _unpacked(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw.split(b"\n") if raw else []


def _share(main: np.ndarray) -> np.ndarray:
    return np.where(main, MAIN_SHARE, SHARE)


_FOUND = pa.schema([("host", pa.string()), ("part", pa.int32()), ("main", pa.bool_()), ("sig", pa.int64()), ("n", pa.int64()), ("of", pa.int64())])


def _rows(key: tuple, main, sig, n, of) -> pa.Table:
    size = len(sig)
    return pa.table([pa.array([key[0].as_py()] * size, pa.string()), pa.array([key[1].as_py()] * size, pa.int32()), pa.array(main, pa.bool_()),
                     pa.array(sig, pa.int64()), pa.array(n, pa.int64()), pa.array(of, pa.int64())], schema=_FOUND)


def _candidates(depth: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """The group's pages and articles (null ``sig``), and the substrings in so large a share of them.

        What has a share of a host's pages has it in one of the groups at least.
        """
        group = _Group(table)
        sig, main, n = group.held(depth)
        of = np.where(main, group.articles, group.pages)
        often = n >= _share(main) * of - 1e-9
        if table["parts"][0].as_py() == 1:
            often &= n >= LEAST_PAGES
        sig, main, n, of = sig[often], main[often], n[often], of[often]
        head = [None, None], [False, True], [group.pages, group.articles]
        return _rows(key, [*head[1], *main.tolist()], [*head[0], *sig.view(np.int64).tolist()], [*head[2], *n.tolist()], [*head[2], *of.tolist()])
    return run


def _counts(depth: int):
    def run(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        """The candidates that the group holds, with its number of distinct pages, and the host's."""
        total = {m: n for m, s, n in zip(known["main"].to_pylist(), known["sig"].to_pylist(), known["n"].to_pylist(), strict=True) if s is None}
        known = known.filter(pa.compute.is_valid(known["sig"]))
        if not len(table) or not len(known):
            return _FOUND.empty_table()
        main, sig, n = known["main"].to_numpy(), known["sig"].to_numpy(), known["n"].to_numpy()
        if table["parts"][0].as_py() > 1:
            has, where, count = _Group(table).held(depth)
            mine = np.isin(has.view(np.int64), sig)
            sig, main, n = has.view(np.int64)[mine], where[mine], count[mine]
        return _rows(key, main, sig, n, np.where(main, total.get(True, 0), total.get(False, 0)))
    return run


def _removed(group: _Group, known: np.ndarray, wide: np.ndarray, depth: int) -> np.ndarray:
    """Flags of the words that go: long or whole-block runs of repeated substrings, and repeated short blocks."""
    size = len(group.words)
    covered = np.zeros(size + 1, np.int64)
    at = group.valid(depth)
    if len(at):
        hit = at[np.isin(group.signatures(depth)[at], known)]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + depth, -1)
    gone = np.cumsum(covered)[:-1] > 0
    # runs end with their segment
    new = np.append(True, group.segment[1:] != group.segment[:-1]) if size else np.zeros(0, bool)
    heads = np.flatnonzero(gone & (new | ~np.append(False, gone[:-1])))
    tails = np.flatnonzero(gone & np.append(new[1:] | ~gone[1:], True)) + 1 if size else heads
    firsts, lasts = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
    firsts[group.first], lasts[group.first + group.size] = True, True
    for a, b in zip(heads.tolist(), tails.tolist(), strict=True):
        if b - a < RUN_WORDS and not (firsts[a] and lasts[b]):
            gone[a:b] = False
    found, sig = group.short(depth)
    for i in found[np.isin(sig, wide)]:
        gone[group.first[i] : group.first[i] + group.size[i]] = True
    beside = found[np.isin(sig, known)]
    beside = beside[np.argsort(group.first[beside])].tolist()
    # stretches of one page's outside text, or of its article
    part = (group.page * 2 + group.main)[group.block]
    for i in [*beside, *beside[::-1]]:  # runs grow by short blocks in both directions
        a, b = int(group.first[i]), int(group.first[i] + group.size[i])
        if a and gone[a - 1] and part[a - 1] == part[a] or b < size and gone[b] and part[b] == part[a]:
            gone[a:b] = True
    return gone


def _kept(depth: int):
    def run(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        """The text of each page without chrome and without the words that go."""
        group = None
        if len(known) and len(table):
            group = _Group(table)
            sig = known["sig"].to_numpy().view(np.uint64)
            gone = _removed(group, sig, sig[known["wide"].to_numpy()], depth)
            first_block = np.searchsorted(group.page, np.arange(group.pages + 1))
        texts = []
        for page, packed, regions in zip(table["page"].to_pylist(), table["packed"].to_pylist(), table["regions"].to_pylist(), strict=True):
            out = []
            for k, (block, region) in enumerate(zip(_unpacked(packed), regions, strict=True)):
                if region == IN_CHROME:
                    continue
                if group:
                    i = first_block[group.page_of[page]] + k
                    cut_out = gone[group.first[i] : group.first[i] + group.size[i]]
                    if cut_out.any():
                        block = b" ".join(w for w, x in zip(block.split(), cut_out, strict=True) if not x)
                if block:
                    out.append(block)
            texts.append(b" ".join(out).decode("utf-8", "replace"))
        return pa.table([table["ids"], pa.array(texts, pa.string())], names=["ids", "text"])
    return run


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per distinct page of a batch: the rows that have it, its blocks and their regions."""
    coder = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        rows: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(batch["host"].to_pylist(), batch["page"].to_pylist(), strict=True)):
            rows.setdefault(key, []).append(i)
        firsts = pa.array([x[0] for x in rows.values()], pa.int64())
        ids = pa.StructArray.from_arrays([batch["page_id"], batch["url"]], names=["page_id", "url"]).take(pa.array([i for x in rows.values() for i in x], pa.int64()))
        ends = np.cumsum([0, *(len(x) for x in rows.values())])
        head = batch.take(firsts)
        packed, regions, articles, parts = [], [], [], []
        for page, of, html_text in zip(head["page"].to_pylist(), head["parts"].to_pylist(), head["html"].to_pylist(), strict=True):
            found = blocks(html_text)
            packed.append(coder.compress("\n".join(b for b, _ in found).encode("utf-8", "surrogatepass")))
            regions.append(bytes(r for _, r in found))
            main = "\n".join(b for b, r in found if r == IN_MAIN)
            articles.append(int.from_bytes(hashlib.blake2b(main.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) if main else None)
            # copies of an article are counted in one group
            parts.append((page if articles[-1] is None else articles[-1]) % of)
        yield pa.RecordBatch.from_arrays(
            [head["host"], pa.array(parts, pa.int32()), head["parts"], head["page"], pa.array(articles, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids), pa.array(packed, pa.binary()), pa.array(regions, pa.binary())],
            names=["host", "part", "parts", "page", "article", "ids", "packed", "regions"])


def extract(pages: DataFrame, id_col: str, url_col: str, html_col: str, depth: int = DEPTH, group_bytes: int = GROUP_BYTES, group_pages: int = GROUP_PAGES) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every page.

    Pages are parsed once and their blocks dealt once by host and group; the three steps over
    the groups (candidates, counts, texts) read that one exchange.
    """
    if depth & (depth - 1):
        raise ValueError("depth must be a power of two")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), F.xxhash64(F.col(html_col)).alias("page"), F.col(html_col).alias("html"))
    id_type = f"array<struct<page_id:{dict(rows.dtypes)['page_id']},url:string>>"
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("bigint")
    groups = F.least(F.ceil(F.sum(size) / F.lit(group_bytes)), F.floor(F.count(F.lit(1)) / F.lit(group_pages)))
    parts = cut(rows.groupBy(F.col("host").alias("p_host")).agg(F.greatest(F.lit(1), groups).cast("int").alias("parts")), "page-parts")
    large = parts.filter("parts > 1")
    sized = rows.join(large, rows["host"] == large["p_host"], "left").select("page_id", "url", "host", F.coalesce("parts", F.lit(1)).alias("parts"), "page", "html")
    dealt = sized.mapInArrow(_parsed, f"host string, part int, parts int, page bigint, article bigint, ids {id_type}, packed binary, regions binary")
    found = "host string, part int, main boolean, sig bigint, n bigint, of bigint"
    often = dealt.groupBy("host", "part").applyInArrow(_candidates(depth), found).groupBy("host", "main", "sig").agg(F.sum("n").alias("n"))
    asked = often.join(parts, often["host"] == F.col("p_host")).select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "main", "sig", "n")
    held = dealt.groupBy("host", "part").cogroup(asked.groupBy("host", "part")).applyInArrow(_counts(depth), found)
    known = _repeated(held)
    texts = dealt.groupBy("host", "part").cogroup(known.groupBy("host", "part")).applyInArrow(_kept(depth), f"ids {id_type}, text string")
    return texts.select(F.explode("ids").alias("id"), "text").select("id.page_id", "id.url", "text")


def _repeated(held: DataFrame) -> DataFrame:
    """``host``, ``part``, ``sig`` and ``wide``: to each group only those repeated substrings that it holds."""
    every = held.withColumn("n", F.sum("n").over(Window.partitionBy("host", "main", "sig")))
    share = F.when(F.col("main"), MAIN_SHARE).otherwise(SHARE)
    enough = (F.col("n") >= LEAST_PAGES) & (F.col("n") >= share * F.col("of"))
    return every.filter(enough).select("host", "part", "sig", (F.col("n") >= F.lit(MOST) * F.col("of")).alias("wide"))
