"""Main text of web pages, with removal of each site's templates.

1. Tasks parse the whole html once and store what they found: text fragments, and
   for every element a hash of its subtree (tag, class, text and the hashes of its
   children). Spark counts, for each host, the different pages that hold a subtree;
   pages of equal main prose count once.
2. A subtree that recurs on at least ``MIN_PAGES`` different pages of a host, and
   on ``MIN_SHARE`` of them or on ``ENOUGH_PAGES``, is the site's template. With
   prose in it (paragraphs, headings, lists, quotes, cells, or a text of
   ``PROSE_WORDS`` words or more outside links), it must be on more than
   ``PROSE_SHARE`` of the host's pages, and inside an article or main element on
   ``ARTICLE_PAGES`` at least. The keys are kept as sorted hash arrays.
3. The stored fragments are read again without the template subtrees, and the main
   text is written out.

Recurrence alone must not eat content: a paragraph that many pages of a host
quote is still text of each of them, unless most pages hold it. An article or main
element as such, and what stands around it, is never a template, and no page loses
most of its prose: where templates hold more than half, as on near copies of a page,
those with prose stay. On a page without prose that holds for all its text.

What is main follows from the prose (its words outside links). It is that of the
articles, if the largest of them has as much as its main element has outside
articles, and if they have a quarter of what the rest of the page has; else that of
the main element with all in it, on the same condition; else that of the body. So
a teaser article does not replace the story beside it.

Counting sees only what recurs: a menu that few pages share is still a menu, and
comments differ from page to page. So elements that declare themselves not to be
main text are left out as well (``declared``): by tag (nav, footer, aside, form,
script), or by a class, id or role, as a whole or by a hyphenated part, unless a
part negates it ("no-sidebar"). Names never hide the html, the body or an outermost
article or main element. If all articles and main elements lie in hidden
elements, they are the text. A form, or an element hidden by a part of its name
(other than comments), that holds an article or main element, or most of the page's
prose, is the page itself.

Blocks are cut at block elements and line breaks. Character references are
decoded, white space inside a block becomes one space, blocks are trimmed and
joined by one line feed; nothing else is dropped.

Defined cases: null and empty html give the empty text. Pages without a host
have no template. Unclosed, misnested and cut-off markup is closed where the
next element or the end of the page implies it. Repeated rows are one page for
the counts and give one row each; null ids are kept. Other columns are ignored.
"""

from __future__ import annotations

import functools
import html as markup
import marshal
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkline.llm import store as S
from hunkline.llm.runtime import arrow_map, fields, stored, take, workdir
from hunkline.llm.textscan import U64

MIN_PAGES = 3
MIN_SHARE = 0.01
ENOUGH_PAGES = 10
PROSE_SHARE = 0.5
PROSE_WORDS = 15
ARTICLE_PAGES = 5
REST = 4        # the rest of a page may have this many times the prose of its articles

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|</?[a-zA-Z][^>]*\Z""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*@)?([^/?#:]*)")

RAW = frozenset("script style noscript template textarea title iframe object svg math canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small
    span strike strong sub sup time tt u var""".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split())
NOT_MAIN = frozenset("nav footer aside button select option dialog menu head".split())
FORMS = frozenset(("form", "fieldset"))
NOT_MAIN_NAMES = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo sidebar
    nav navbar navigation menu breadcrumb breadcrumbs footer comment comments reply replies cookie cookies consent
    notice alert popup modal newsletter subscribe subscription share sharing social related pagination
    complementary contentinfo search toolbar widget disclaimer disqus""".split())
COMMENT_NAMES = frozenset("comment comments reply replies disqus".split())
HEADER_NAMES = frozenset(("header", "masthead"))
#: "no-sidebar" and the like tell of the page, not of the element
STATES = frozenset("no not has with without is hide show".split())
#: a start tag closes these open elements
CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
          "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
          "option": frozenset(["option"])}
SCOPES = frozenset("html body article main section div table ul ol dl td th li blockquote aside nav footer header form".split())

BREAK = None


class _Element:
    __slots__ = ("tag", "name", "start", "parts", "hidden", "level", "prose", "root", "link", "words", "long", "outer", "form", "top")

    def __init__(self, tag: str, name: str, start: int, hidden: bool, level: int) -> None:
        self.tag, self.name, self.start, self.hidden, self.level = tag, name, start, hidden, level
        self.parts: list[str] = []
        self.prose = tag in PROSE
        self.root = self.link = self.long = self.top = False
        self.words = self.form = 0
        self.outer = False


@functools.lru_cache(maxsize=1 << 14)
def _said(kind: str) -> tuple[bool, bool, bool]:
    """What class, id and role values say: (surely not main text, perhaps not,
    a header). Whole names and comments are sure, parts of a name are not."""
    sure = perhaps = header = False
    for name in kind.split():
        parts = [x for x in re.split(r"[-_]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", name).lower()) if x]
        name = name.lower()
        if name in NOT_MAIN_NAMES:
            sure = True
        header = header or name in HEADER_NAMES
        if len(parts) > 1 and STATES.isdisjoint(parts):
            sure = sure or not COMMENT_NAMES.isdisjoint(parts)
            perhaps = perhaps or not NOT_MAIN_NAMES.isdisjoint(parts)
            header = header or parts[-1] in HEADER_NAMES
    return sure, perhaps, header


def host(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[2].lower() if found else ""


def _covered(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of ``n`` places the spans (first, end) cover."""
    open_ = np.zeros(n + 1, np.int32)
    for first, last in spans:
        open_[first] += 1
        open_[last] -= 1
    return np.cumsum(open_[:-1]) > 0


class Page:
    """A parsed page: ``out`` holds text fragments and breaks (with their level:
    2 in an article, 1 in a main element, 0 elsewhere, -1 never main text) and
    ``subtrees`` the candidates for templates as (hash, first, end, kind) over
    ``out`` (kind 0 without prose, 1 with prose, 2 with prose in an article or main
    element). ``words`` counts the words outside links of each fragment, ``prose``
    tells which fragments are prose; ``level`` is the least level of main text.
    ``declared=False`` leaves everything to the counted templates."""

    def __init__(self, source: str, declared: bool = True) -> None:
        self.declared = declared
        self.out: list[tuple[str | None, int]] = []
        self.words: dict[int, int] = {}
        self.subtrees: list[tuple[int, int, int, int]] = []
        self._articles: list[tuple[int, int]] = []
        self._candidates: list[tuple[int, int, int, bool, bool, int]] = []
        self._prose: list[tuple[int, int]] = []
        self._veiled: list[tuple[int, bool, int]] = []  # place, in an article in a hidden element, form
        self._forms, self._pages = 0, set()  # forms, and those that hold an article or main element
        self.stack = [_Element("", "", 0, False, 0)]
        at, end = 0, len(source)
        while at < end:
            token = _TOKEN.search(source, at)
            if token is None:
                self._text(source[at:])
                break
            if token.start() > at:
                self._text(source[at:token.start()])
            at = token.end()
            closing, tag, attributes = token.group(1, 2, 3) if token[2] else token.group(4, 5, 6)
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                self._end(tag)
            elif tag in RAW:
                if not attributes.endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                    at = close.end() if close else end
            elif tag in VOID:
                if tag in ("br", "hr"):
                    self.out.append((BREAK, 0))
            else:
                self._start(tag, attributes)
        while len(self.stack) > 1:
            self._pop()
        self.prose = _covered(len(self.out), self._prose)
        self._unveil()
        self.level = self._main_level()
        self.subtrees = [(key, first, last, (2 if level > 0 else 1) if prose or long else 0)
                         for key, first, last, prose, long, level in self._candidates]

    def _main_level(self) -> int:
        """The level from which text is main text, by the words of prose."""
        here = np.zeros(len(self.out), np.int64)
        for i, n in self.words.items():
            if self.prose[i] and self.out[i][1] >= 0:
                here[i] = n
        if not here.any():
            return max(max((level for text, level in self.out if text is not BREAK and text.strip()), default=0), 0)
        levels = np.array([level for _, level in self.out])
        rest, main, article = (int(here[levels == x].sum()) for x in (0, 1, 2))
        largest = max((int(here[a:b][levels[a:b] == 2].sum()) for a, b in self._articles), default=0)
        if article and largest >= main and REST * article >= rest:
            return 2
        return 1 if main + article and REST * (main + article) >= rest else 0

    def _unveil(self) -> None:
        """Hide what lies in forms and, if there are others, articles in hidden elements."""
        if not self._veiled:
            return
        of: dict[int, int] = {}
        for i, _, form in self._veiled:
            if self.prose[i]:
                of[form] = of.get(form, 0) + self.words.get(i, 0)
        total = sum(n for i, n in self.words.items() if self.prose[i] and self.out[i][1] >= 0)
        shown = {0} | self._pages | {form for form, n in of.items() if 2 * n > total}
        outer = set()
        for i, inside, form in self._veiled:
            if form not in shown:
                self.out[i] = (self.out[i][0], -1)
            elif inside:
                outer.add(i)
        if any(level > 0 and i not in outer and text.strip() for i, (text, level) in enumerate(self.out) if text is not BREAK):
            for i in outer:
                self.out[i] = (self.out[i][0], -1)

    def _text(self, source: str) -> None:
        text = markup.unescape(source) if "&" in source else source
        top = self.stack[-1]
        words = text.split()
        if not top.link:
            self.words[len(self.out)] = len(words)
            top.words += len(words)
        if (top.outer or top.form) and not top.hidden:
            self._veiled.append((len(self.out), top.outer, top.form))
        self.out.append((text, -1 if top.hidden else top.level))
        top.parts.append(" ".join(words))

    def _start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self._imply(tag)
            self.out.append((BREAK, 0))
        names = _NAMED.findall(attributes) if attributes else ()
        kind = " ".join(a or b or c for _, a, b, c in names)
        parent = self.stack[-1]
        level = 2 if tag == "article" else max(parent.level, 1) if tag == "main" or "main" in kind.split() and "role" in attributes else parent.level
        root = level > parent.level
        sure = perhaps = header = False
        if self.declared and tag not in ("html", "body"):
            sure, perhaps, header = _said(kind) if kind else (False, False, False)
            if not root:
                sure = sure or tag in NOT_MAIN or level < 1 and (tag == "header" or header)
            perhaps = perhaps or tag in FORMS
        element = _Element(tag, kind.lower(), len(self.out), not root and sure or parent.hidden and not root, level)
        element.outer = parent.outer or root and (parent.hidden or sure)
        element.form = parent.form
        if perhaps and not root and (not element.form or element.form in self._pages):
            self._forms += 1
            element.form = self._forms
        if root:
            self._pages.add(element.form)
        element.root = root
        element.top = root and level == 2
        element.link = parent.link or tag == "a"
        self.stack.append(element)

    def _imply(self, tag: str) -> None:
        """Close what the start of a block element closes."""
        closes = CLOSES.get(tag, ())
        for i in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[i].tag
            if open_tag == "p" or open_tag in closes:
                while len(self.stack) > i:
                    self._pop()
                if open_tag == "p" and not closes:
                    return
            elif open_tag in SCOPES and not (closes and open_tag not in ("table", "ul", "ol", "dl", "article", "main", "body")):
                return

    def _end(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                while len(self.stack) > i:
                    self._pop()
                return
            if tag in INLINE and self.stack[i].tag not in INLINE:
                return
        if tag not in INLINE:
            self.out.append((BREAK, 0))

    def _pop(self) -> None:
        import xxhash

        e = self.stack.pop()
        parent = self.stack[-1]
        digest = xxhash.xxh64_intdigest("\x1f".join((e.tag, e.name, *[p for p in e.parts if p])))
        parent.parts.append(f"{digest:016x}")
        parent.prose = parent.prose or e.prose
        if e.tag in INLINE:
            parent.words += e.words
        else:
            own = e.words >= PROSE_WORDS
            e.long = e.long or own
            if own or e.tag in PROSE:
                self._prose.append((e.start, len(self.out)))
        parent.long = parent.long or e.long
        if e.top:
            self._articles.append((e.start, len(self.out)))
        if e.root:  # an article or main element and all around it are no candidates
            for outer in self.stack:
                outer.root = True
        elif e.tag not in INLINE and any(e.parts):
            self._candidates.append((digest, e.start, len(self.out), e.prose, e.long, e.level))
        if e.tag not in INLINE:
            self.out.append((BREAK, 0))

    def content(self) -> int:
        """Hash of the page's prose, or of all its text if it has none: pages that
        agree in it are one page, whatever stands around."""
        import xxhash

        own = [" ".join(t.split()) for i, (t, level) in enumerate(self.out)
               if t is not BREAK and level >= self.level and self.prose[i] and i in self.words]
        return xxhash.xxh64_intdigest("\x1f".join([t for t in own if t] or [t for t, _ in self.out if t is not BREAK]))

    def main_text(self, templates: set[int]) -> str:
        """The main text without the subtrees whose hash is in ``templates``."""
        known = [x for x in self.subtrees if x[0] in templates]
        deleted = _covered(len(self.out), [x[1:3] for x in known])
        if known:
            # what templates without prose hold is no prose of the page's own
            plain = _covered(len(self.out), [x[1:3] for x in known if not x[3]])
            main = [i for i, n in self.words.items() if n and self.out[i][1] >= self.level]
            content = [i for i in main if self.prose[i] and not plain[i]]
            if content and 2 * sum(self.words[i] for i in content if deleted[i]) > sum(self.words[i] for i in content):
                deleted = plain
            elif not self.prose[main].any() and 2 * sum(self.words[i] for i in main if deleted[i]) > sum(self.words[i] for i in main):
                deleted[:] = False
        # the level is that of the whole page, also if templates empty it
        blocks, block = [], []
        for (text, level), dead in zip(self.out, deleted.tolist()):
            if text is BREAK:
                if block and (words := " ".join("".join(block).split())):
                    blocks.append(words)
                block = []
            elif level >= self.level and not dead:
                block.append(text)
        if block and (words := " ".join("".join(block).split())):
            blocks.append(words)
        return "\n".join(blocks)


    def dump(self) -> bytes:
        """What ``main_text`` needs, but for the subtrees' keys: texts that are no main
        text are left out."""
        out = [(text if text is BREAK or level >= self.level else "", level) for text, level in self.out]
        return marshal.dumps((out, self.words, np.packbits(self.prose).tobytes(), [x[1:] for x in self.subtrees], self.level))

    @classmethod
    def load(cls, raw: bytes, keys: list[int]) -> Page:
        """A stored page, with ``keys`` for its subtrees."""
        page = cls.__new__(cls)
        page.out, page.words, prose, spans, page.level = marshal.loads(raw)
        page.prose = np.unpackbits(np.frombuffer(prose, np.uint8), count=len(page.out)).astype(bool)
        page.subtrees = [(key, *span) for key, span in zip(keys, spans)]
        return page


def _key(site: str, digest: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{site}\x1f{digest:016x}")


def parse(pages: DataFrame, id_col: str, url: str, html: str, declared: bool = True) -> DataFrame:
    """(id, url, site, page, parsed, trees): each page's parsed form, the hash of its
    host (null without one) and of its main prose, and (key, kind) of its subtrees."""
    rows = take(pages, id_col, url, html).toDF("id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    tree = T.StructType([T.StructField("key", T.LongType()), T.StructField("kind", T.IntegerType())])
    schema = fields(("id", rows.schema["id"].dataType), ("url", rows.schema["url"].dataType), ("site", "long"), ("page", "long"),
                    ("parsed", "binary"), ("trees", T.ArrayType(tree)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        from hunkline.llm import pages as own

        def signed(x: int) -> int:
            return x - (1 << 64) if x >> 63 else x

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sites, keys, parsed, start, key, kind = [], [], [], [0], [], []
                for address, source in zip(batch.column(1).to_pylist(), batch.column(2)):
                    page = own.Page(source.as_py(), declared)
                    site = own.host(address)
                    trees = [own._key(site, d) for d, *_ in page.subtrees]
                    sites.append(signed(xxhash.xxh64_intdigest(site)) if site else None)
                    keys.append(signed(page.content()))
                    parsed.append(page.dump())
                    key += trees
                    kind += [x[3] for x in page.subtrees]
                    start.append(len(key))
                trees = pa.StructArray.from_arrays([pa.array(np.array(key, U64).view(np.int64)), pa.array(kind, pa.int32())], names=["key", "kind"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(sites, pa.int64()), pa.array(keys, pa.int64()), pa.array(parsed, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(start, pa.int32()), trees)], names=schema.names)

    return arrow_map(rows, task, schema)


def templates(parsed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> S.Store:
    """The keys (host and subtree) of all templates, as a store."""
    pages = parsed.filter(F.col("site").isNotNull())
    # a page's own count of its host is one more key, so hot hosts are counted like subtrees
    held = pages.select("site", "page", F.inline("trees")).unionByName(
        pages.select("site", "page", F.col("site").alias("key"), F.lit(-1).alias("kind")))
    often = held.distinct().groupBy("site", "key", "kind").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    sites = often.filter(F.col("kind") == -1).select("site", F.col("n").alias("pages"))
    most = F.col("n") > F.col("pages") * PROSE_SHARE
    recurring = (often.filter(F.col("kind") >= 0).join(sites, "site")
                 .filter(F.when(F.col("kind") == 0, F.col("n") >= F.least(F.col("pages") * min_share, F.lit(max(ENOUGH_PAGES, min_pages))))
                         .when(F.col("kind") == 1, most).otherwise(most & (F.col("n") >= max(ARTICLE_PAGES, min_pages)))).select("key"))
    return S.save_keys(recurring, workdir(parsed.sparkSession, "templates"))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html",
            min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, declared: bool = True) -> DataFrame:
    """One row per page: id, url, text, n_chars. ``declared=False`` ignores what
    elements say of themselves: counted templates alone decide."""
    parsed = stored(parse(pages, id_col, url, html, declared), "parsed-pages", "zstd")
    known = templates(parsed, min_pages, min_share)
    schema = fields((id_col, parsed.schema["id"].dataType), (url, parsed.schema["url"].dataType),
                    ("text", T.StringType()), ("n_chars", T.LongType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hunkline.llm import pages as own

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                trees = batch.column(3).flatten().field(0).to_numpy().view(U64)
                asked = np.unique(trees)
                found = set(asked[known.lookup(asked)["id"] >= 0].tolist())
                texts = []
                for address, raw, keys in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                    page = own.Page.load(raw, keys.values.field(0).to_numpy().view(U64).tolist())
                    texts.append(page.main_text(found if found and own.host(address) else set()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=schema.names)

    return arrow_map(parsed.select("id", "url", "parsed", "trees"), task, schema)
