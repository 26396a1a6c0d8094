"""Main text of web pages by deducing each host's template from equivalence classes of tokens.

A page is a sequence of tokens: opening and closing tags, each told apart by the path of containers it stands in, and blocks
of text. Tokens of a host that occur equally often in each of its pages have the same occurrence vector and form an equivalence
class. Vectors aren't gathered: each is summed up as the 64-bit sum, over pages, of a hash of page and count, so that a
host of any size is an ordinary aggregation with partial sums. A second reading of the pages judges the classes, again in sums:
a class is valid if it has at least two tokens, stands in enough pages, its tokens come in the same order wherever they
occur, and each of its occurrences lies within the same slot of the same other class. So valid classes nest
and make the host's template; what stands between two neighbouring tokens of a class is one of its slots.

Text that is itself a template token is fixed. It isn't content at the edges of an article or of the page's content, where hosts put notices; between varying blocks
of the same article it is the article's (headings that every page has). The varying text is in slots. A slot whose
varying text is mostly links, or stands almost all in asides (menus, adverts, comments and the like, told by elements and by whole names in class
and id) is an aside as a whole, also where a page's names don't tell; one whose text stands mostly in article elements is a
content slot. A page's content is the text of its articles, else that of the content slots, else that of all slots that aren't asides.
Names don't make an aside of what holds most of a page's text, nor of figures and formulas; within an article an aside element, or a name that may as well stand for a part of the text
(related, banner, contents and the like), makes one only where most of what it holds is links.

Defined results: a null or empty page, or one without content, has empty text; hosts with too few distinct pages for a template
go by elements and names alone, and ``slots`` is 0; copies of a page count once for the template, and repeated rows give repeated rows;
paths are kept as 64-bit hashes, so that very deep pages need memory in proportion to their length; columns other than
id, url and html aren't read, so their names can't clash.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, settle, slices

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:_-]*)([^>]*)(?:>|\Z)""",
    re.S,
)
NAMES = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")
#: White space of HTML, and the blanks that references such as &nbsp; stand for.
BLANKS = re.compile(r"\s+")

RAW = {"script", "style", "textarea", "title", "noscript", "template", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr img".split()
)
#: Elements that are never content.
ASIDE = {"nav", "footer", "aside", "head", "svg", "button", "select", "option", "dialog", "menu"}
#: Elements that names don't tell of.
SHOWN = {"figure", "figcaption", "picture", "math", "table"}
#: Words of names that within an article need links to tell of an aside.
UNSURE = set("banner breadcrumb breadcrumbs disclaimer notice notices pagination promo promoted recommended related search sidebar sidenav toc topbar widget widgets announcement menu nav navbar navigation".split())
#: Words in class or id of what is never content.
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus disclaimer dropdown footer gdpr masthead menu modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing "
    "sidebar sidenav signup skip social sponsor sponsored subscribe subscription toc toolbar topbar widget widgets "
    "announcement reactions".split()
)
#: Words that may stand beside these in one name: ``sidebar-left`` is a sidebar, ``has-sidebar`` and ``related-work`` aren't.
BESIDE = set(
    "area articles bar block body bottom box buttons center container form global inner item items left link links list main "
    "menu page post posts primary right secondary section site slot text thread top unit wrap wrapper".split()
)
REMARKS = {"comment", "comments", "disqus", "replies", "reply", "respond"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTENT = {"article", "main"}
CONTENT_WORDS = {"article", "articlebody", "main"}
ENDS_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
SAME = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "p": set(), "option": {"select"}}


def _names(attributes: str) -> tuple[set[str], set[str], str]:
    """Words of the names, words of those names that are known for asides as a whole, and the label of the classes."""
    words, known, label = set(), set(), ""
    for kind, a, b, c in NAMES.findall(attributes):
        value = (a or b or c).lower()
        words.update(WORDS.findall(value))
        for name in value.split():
            parts = set(WORDS.findall(name))
            if parts & ASIDE_WORDS and parts <= ASIDE_WORDS | BESIDE:
                known |= parts & ASIDE_WORDS
        if kind.lower() == "class":
            label = "." + ".".join(sorted(value.split()))
    return words, known, label


CLOSING, TEXT = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Page:
    """``tokens``, the hashes of tags and blocks in page order, and ``blocks`` as (text, its place among the tokens, aside, article), the number of the article that it is in, or 0; ``links`` has
    the characters of each block that are links."""

    def __init__(self, source: str | None):
        self.tokens: list[int] = []
        self.blocks: list[tuple[str, int, bool, int]] = []
        self.links: list[int] = []
        # name, hash of the path, in an element that is never content, last container whose names (or being a form) tell of an aside, number of the article
        self._open: list[tuple[str, int, bool, int, int]] = [("", 0, False, -1, 0)]
        #: Where the elements of a name stand among the open ones.
        self._places: dict[str, list[int]] = defaultdict(list)
        self._read_blocks: list[tuple[str, int, bool, int, int]] = []
        #: Of each container that names tell of: the one around it, and whether it is one for remarks.
        self._around: list[int] = []
        self._remarks: list[bool] = []
        self._unsure: list[bool] = []
        self._articles = 0
        self._text: list[str] = []
        self._in_link, self._linked = False, 0
        if source:
            self._read(source)
            self._judge()
            self.tokens = np.array(self.tokens, dtype=np.uint64).view(np.int64).tolist()

    def _judge(self):
        """Names don't make an aside of what holds most of a page's text, unless content stands elsewhere."""
        count = len(self._around)
        void = [False] * count
        blocks = [b for b in self._read_blocks if not b[2]]
        if count and not any(inside and named < 0 for _, _, _, named, inside in blocks):
            held = [0] * count
            for text, _, _, named, _ in blocks:
                if named >= 0:
                    held[named] += len(text)
            total = sum(len(b[0]) for b in blocks)
            for k in range(count - 1, -1, -1):  # inner ones come later
                void[k] = 2 * held[k] > total and not self._remarks[k]
                if self._around[k] >= 0:
                    held[self._around[k]] += held[k]
        if any(self._unsure):
            self._weigh(void)
        aside = []
        for k in range(count):
            aside.append(not void[k] or self._around[k] >= 0 and aside[self._around[k]])
        for text, at, never, named, inside in self._read_blocks:
            away = never or named >= 0 and aside[named]
            self.blocks.append((text, at, away, 0 if away else inside))

    def _weigh(self, void: list[bool]):
        """Containers that names leave unsure are asides if most of their text is links."""
        held, linked = [0] * len(void), [0] * len(void)
        for (text, _, _, named, _), links in zip(self._read_blocks, self.links, strict=True):
            if named >= 0:
                held[named] += len(text)
                linked[named] += links
        for k in range(len(void) - 1, -1, -1):
            if self._unsure[k]:
                void[k] = void[k] or 2 * linked[k] < held[k]
            if self._around[k] >= 0:
                held[self._around[k]] += held[k]
                linked[self._around[k]] += linked[k]

    def _flush(self):
        if self._text:
            text = BLANKS.sub(" ", references.unescape("".join(self._text))).strip()
            self._text.clear()
            if text:
                _, path, *rest = self._open[-1]
                self._read_blocks.append((text, len(self.tokens), *rest))
                self.links.append(min(len(text), self._linked))
                self.tokens.append(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), path ^ TEXT))
        self._linked = 0

    def _close(self, index: int):
        while len(self._open) > index:
            name, path, *_ = self._open.pop()
            self._places[name].pop()
            self.tokens.append(path ^ CLOSING)

    def _read(self, source: str):
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() < at:
                continue
            self._text.append(source[at : m.start()])
            if self._in_link:
                self._linked += m.start() - at
            at = m.end()
            closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                if m[0].startswith("<![CDATA["):
                    self._text.append(references.escape(m[0][9:].removesuffix("]]>")))
                continue
            name = name.lower()
            if name in RAW and not closing:
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
                self._tag(name, attributes, raw=True)
                continue
            if name in INLINE:
                if name == "a":
                    self._in_link = not closing
                continue
            self._flush()
            if closing:
                if found := self._places.get(name):
                    self._close(found[-1])
            else:
                self._tag(name, attributes)
        self._text.append(source[at:])
        self._flush()
        self._close(1)

    def _tag(self, name: str, attributes: str, raw: bool = False):
        if not raw and name in ENDS_P and self._open[-1][0] == "p":
            self._close(len(self._open) - 1)
        if name in SAME and name != "p" and (found := self._places.get(name)):
            if all(not (p := self._places.get(outer)) or p[-1] < found[-1] for outer in SAME[name]):
                self._close(found[-1])
        words, known, label = _names(attributes) if "=" in attributes else (set(), set(), "")
        _, path, never, named, content = self._open[-1]
        path = xxhash.xxh3_64_intdigest(f"{name}{label}".encode("utf-8", "surrogatepass"), path)
        self.tokens.append(path)
        if raw or name in VOID or attributes.rstrip().endswith("/") and name not in ENDS_P:
            return
        body = name in ("html", "body")
        inset = name == "aside" and content > 0
        never = never or name in ASIDE and not inset or name == "header" and not content
        if name in CONTENT or name in SHOWN:
            known &= REMARKS
        if name == "form" or inset or known and not body and name not in HEADINGS:
            self._around.append(named)
            self._remarks.append(bool(known & REMARKS))
            self._unsure.append(content > 0 and name != "form" and known <= UNSURE)
            named = len(self._around) - 1
        if not content and not never and (name in CONTENT or bool(words & CONTENT_WORDS) and not body):
            self._articles += 1
            content = self._articles
        self._places[name].append(len(self._open))
        self._open.append((name, path, never, named, content))


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)))


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >= 1 << 63 else x


def slot_of(class_: int, gap: int) -> int:
    return _signed((class_ + gap * CLOSING) * TEXT)


class Structure:
    """Where a page's tokens stand among classes: ``slots`` has, for each block, the slot that it is in, or 0; ``classes``, for
    each class that occurs, a hash of its tokens' order (0 if it isn't always the same) and one of the slot around it (0 if
    there are several, or if it began in a slot of another class and goes on beyond that)."""

    def __init__(self, page: Page, class_of: dict[int, int], sizes: dict[int, int]):
        found: dict[int, list[int]] = defaultdict(list)
        members = [class_of.get(t) for t in page.tokens]
        for token, c in zip(page.tokens, members, strict=True):
            if c is not None:
                found[c].append(token)
        order = {}
        for c, tokens in found.items():
            once = tokens[: sizes[c]]
            good = len(tokens) % sizes[c] == 0 and len(set(once)) == sizes[c] and tokens == once * (len(tokens) // sizes[c])
            order[c] = _signed(_hash(*once)) or 1 if good else 0
        around: dict[int, int] = {}
        open_: list[list[int]] = []  # class, tokens seen
        is_open: set[int] = set()
        self.slots: list[int] = []
        at_block = iter([b[1] for b in page.blocks])
        next_block = next(at_block, -1)
        slot = 0
        for at, c in enumerate(members):
            if at == next_block:
                self.slots.append(slot)
                next_block = next(at_block, -1)
            if c is None or not order[c]:
                continue
            if c in is_open:
                while open_[-1][0] != c:  # what began later isn't within one slot of this class
                    crossed, _ = open_.pop()
                    is_open.discard(crossed)
                    around[crossed] = order[crossed] = 0
            else:
                around[c] = (slot or 1) if around.get(c, slot or 1) == (slot or 1) else 0
                open_.append([c, 0])
                is_open.add(c)
            open_[-1][1] += 1
            if open_[-1][1] == sizes[c]:
                open_.pop()
                is_open.discard(c)
            slot = slot_of(*open_[-1]) if open_ else 0
        self.classes = {c: (o, around.get(c, 0)) for c, o in order.items()}


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: What rows of the two readings stand for.
PAGE, TAG, BLOCK = 0, 1, 2
CLASS, SLOT = 3, 4


def occurrences(pages: DataFrame) -> DataFrame:
    """Partial sums, from rows of (page key, host, html): for each host and token the sum that stands for its
    occurrence vector, and the number of pages."""

    def run(batches):
        for batch in slices(batches, 2048):
            sums: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for key, host, source in rows:
                page = Page(source)
                texts = {page.tokens[b[1]] for b in page.blocks}
                sums[host, PAGE, 0][1] += 1
                seed = key & 0xFFFFFFFFFFFFFFFF
                for token, n in Counter(page.tokens).items():
                    s = sums[host, BLOCK if token in texts else TAG, token]
                    s[0] += xxhash.xxh3_64_intdigest(n.to_bytes(8, "little"), seed)
                    s[1] += 1
            columns = [*zip(*sums, strict=True)] or [()] * 3
            values = list(sums.values())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.string()),
                    pa.array(columns[1], pa.int32()),
                    pa.array(columns[2], pa.int64()),
                    pa.array([_signed(v[0]) for v in values], pa.int64()),
                    pa.array([v[1] for v in values], pa.int64()),
                ],
                names=["host", "kind", "token", "vector", "pages"],
            )

    return pages.mapInArrow(run, "host string, kind int, token long, vector long, pages long")


def distinct_pages(pages: DataFrame, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """Rows of (digest, host, html), one for each distinct html of a host. Only pages that have copies are shuffled."""
    keyed = pages.select(F.xxhash64("html").alias("digest"), "host", "html")
    copies = settle(keyed.groupBy("host", "digest").count().filter("count > 1").select("host", "digest"), "page-copies")
    size = copies.agg(F.sum(F.length("host") + 16)).first()[0] or 0
    few = F.broadcast(copies) if size <= broadcast_bytes else copies
    single = keyed.join(few, ["host", "digest"], "left_anti")
    once = keyed.join(few, ["host", "digest"], "left_semi").dropDuplicates(["host", "digest"])
    return single.select("digest", "host", "html").union(once.select("digest", "host", "html"))


def with_templates(rows: DataFrame, templates: DataFrame, spread_by: str, broadcast_bytes: int, salts: int) -> DataFrame:
    """Each row with its host's template. Templates up to ``broadcast_bytes`` in all are broadcast; beyond that they are
    repeated for ``salts`` parts of each host, so that a large host is dealt over as many tasks."""
    listed = [F.coalesce(F.size(f.name), F.lit(0)) * 8 for f in templates.schema if isinstance(f.dataType, T.ArrayType)]
    size = templates.agg(F.sum(sum(listed, F.length("host") + 64))).first()[0]
    if (size or 0) <= broadcast_bytes:
        return rows.join(F.broadcast(templates), "host", "left")
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).alias("salt")
    spread = templates.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.withColumn("salt", salt).join(spread, ["host", "salt"], "left").drop("salt")


class Templates:
    """Templates by host, as a worker meets them."""

    def __init__(self, columns: tuple[str, ...], kept: int = 256):
        self.columns, self.kept, self.known = columns, kept, {}

    def of(self, batch: pa.RecordBatch, host: str, row: int):
        if host not in self.known:
            if len(self.known) >= self.kept:
                self.known.clear()
            tokens, classes, *rest = (batch.column(c)[row].as_py() or [] for c in self.columns)
            class_of = dict(zip(tokens, classes, strict=True))
            self.known[host] = (class_of, Counter(classes), *(set(r) for r in rest))
        return self.known[host]


def judged(pages: DataFrame) -> DataFrame:
    """Partial sums, from rows of (digest, host, html, tokens, classes): for each host and class whether its order and the slot
    around it are the same everywhere, as least and greatest hash; for each slot the characters of varying text, of
    those in asides, in content, and in links outside content."""

    def run(batches):
        templates = Templates(("tokens", "classes"))
        for batch in slices(batches, 2048):
            classes: dict[tuple, list[int]] = {}
            slots: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
            hosts = batch.column("host").to_pylist()
            for row, (host, source) in enumerate(zip(hosts, batch.column("html").to_pylist(), strict=True)):
                class_of, sizes = templates.of(batch, host, row)
                if not class_of:
                    continue
                page = Page(source)
                structure = Structure(page, class_of, sizes)
                for c, (order, around) in structure.classes.items():
                    s = classes.setdefault((host, c), [order, order, around, around])
                    s[:] = min(s[0], order), max(s[1], order), min(s[2], around), max(s[3], around)
                    if not order or not around:
                        s[:2] = 0, 1
                for (text, at, aside, article), links, slot in zip(page.blocks, page.links, structure.slots, strict=True):
                    if page.tokens[at] not in class_of:
                        s = slots[host, slot]
                        s[0] += len(text)
                        s[1] += len(text) * aside
                        s[2] += len(text) * (article > 0)
                        s[3] += links * (not article)
            out = [(host, CLASS, c, *s) for (host, c), s in classes.items()]
            out += [(host, SLOT, slot, *s) for (host, slot), s in slots.items()]
            columns = [*zip(*out, strict=True)] or [()] * 7
            types = (pa.string(), pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "kind", "name", "a", "b", "c", "d"])

    return pages.select("host", "html", "tokens", "classes").mapInArrow(run, "host string, kind int, name long, a long, b long, c long, d long")


def deduce_templates(
    pages: DataFrame, least_pages: int = 3, least_share: float = 0.5, broadcast_bytes: int = 16 << 20, salts: int = 64
) -> DataFrame:
    """One row for each host that has a template: ``tokens`` and their ``classes``, ``fixed``, the text tokens among them, ``dead``,
    the slots that are asides, and ``live``, those of content. ``pages`` has a host and html; copies of a page count once."""
    distinct = distinct_pages(pages)
    partial = occurrences(distinct)
    # wrapping 64-bit sums: a plain sum may overflow, so the two halves are added apart
    low, high = F.col("vector").bitwiseAND(0xFFFFFFFF), F.shiftright("vector", 32)
    stats = partial.groupBy("host", "kind", "token").agg(F.sum(low).alias("low"), F.sum(high).alias("high"), F.sum("pages").alias("pages"))
    stats = settle(stats.filter((F.col("pages") >= least_pages) | (F.col("kind") == PAGE)), "page-tokens")
    hosts = stats.filter(F.col("kind") == PAGE).select("host", F.col("pages").alias("of"))
    tokens = stats.filter(F.col("kind") != PAGE).join(hosts, "host").filter(F.col("pages") >= F.col("of") * least_share)
    high = F.pmod(F.col("high") + F.floor(F.col("low") / (1 << 32)), F.lit(1 << 32))
    tokens = tokens.withColumn("class", F.xxhash64(F.pmod("low", F.lit(1 << 32)), high, "pages"))
    classes = tokens.groupBy("host", "class").agg(F.collect_list(F.struct("token", "kind")).alias("members")).filter(F.size("members") >= 2)
    classes = settle(classes, "page-classes")
    listed = classes.select("host", "class", F.inline("members")).groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("all"))
    first = settle(listed.select("host", F.col("all.token").alias("tokens"), F.col("all.class").alias("classes")), "page-templates")
    met = with_templates(distinct, first, "digest", broadcast_bytes, salts)
    sums = settle(judged(met.filter("tokens is not null")), "page-judgements")
    valid = sums.filter(F.col("kind") == CLASS).groupBy("host", F.col("name").alias("class")).agg(
        F.min("a").alias("a"), F.max("b").alias("b"), F.min("c").alias("c"), F.max("d").alias("d")
    )
    valid = classes.join(valid.filter("a = b and c = d").select("host", "class"), ["host", "class"], "left_semi")
    members = valid.select("host", "class", F.inline("members")).groupBy("host").agg(F.collect_list(F.struct("token", "class", "kind")).alias("all"))
    members = members.select(
        "host",
        F.col("all.token").alias("tokens"),
        F.col("all.class").alias("classes"),
        F.transform(F.filter("all", lambda m: m["kind"] == BLOCK), lambda m: m["token"]).alias("fixed"),
    )
    slots = sums.filter(F.col("kind") == SLOT).groupBy("host", F.col("name").alias("slot")).agg(
        F.sum("a").alias("chars"), F.sum("b").alias("aside"), F.sum("c").alias("content"), F.sum("d").alias("links")
    )
    role = lambda held: F.filter(F.collect_list(F.when(held, F.col("slot"))), lambda x: x.isNotNull())
    # most of what isn't content is links, and little is content
    away = (F.col("aside") >= 0.9 * F.col("chars")) | ((2 * F.col("links") >= F.col("chars")) & (4 * F.col("content") < F.col("chars")))
    roles = slots.groupBy("host").agg(
        role(away).alias("dead"),
        role(~away & (2 * F.col("content") >= F.col("chars") - F.col("aside"))).alias("live"),
    )
    templates = settle(members.join(roles, "host", "left"), "page-templates")
    release(stats, classes, first, sums)
    return templates


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    broadcast_bytes: int = 16 << 20,
    salts: int = 64,
) -> DataFrame:
    """Rows of ``id_col``, ``url_col``, ``text``, ``n_chars`` and ``slots``, in how many of its host's slots the page has text."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), HOST, 1), F.lit(""))).alias("host")
    templates = deduce_templates(pages.select(host, F.col(html_col).alias("html")), broadcast_bytes=broadcast_bytes, salts=salts)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host)
    joined = with_templates(rows, templates, "id", broadcast_bytes, salts)
    schema = T.StructType(
        [
            pages.schema[id_col],
            pages.schema[url_col],
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
            T.StructField("slots", T.LongType()),
        ]
    )

    def run(batches):
        known = Templates(("tokens", "classes", "fixed", "dead", "live"))
        for batch in slices(batches):
            texts, used = [], []
            hosts = batch.column("host").to_pylist()
            for row, (host_, source) in enumerate(zip(hosts, batch.column("html").to_pylist(), strict=True)):
                text, slots = content(Page(source), *known.of(batch, host_, row))
                texts.append(text)
                used.append(slots)
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths, pa.array(used, pa.int64())], names=schema.names
            )

    return joined.select("id", "url", "html", "host", "tokens", "classes", "fixed", "dead", "live").mapInArrow(run, schema)


def content(page: Page, class_of: dict, sizes: dict, fixed: set[int], dead: set[int], live: set[int]) -> tuple[str, int]:
    """The page's content, and in how many slots of the template it has text."""
    slots = Structure(page, class_of, sizes).slots if class_of else [0] * len(page.blocks)
    used = len(set(slots)) if class_of else 0
    own = [(text, page.tokens[at] in fixed, article, slot) for (text, at, aside, article), slot in zip(page.blocks, slots, strict=True) if not aside]
    chosen = [b for b in own if b[2]]
    if not chosen:
        own = [b for b in own if b[1] or b[3] not in dead] or own
        chosen = [b for b in own if b[3] in live] or [(text, still, -1, slot) for text, still, _, slot in own]
    # near copies make the whole text fixed; it is content all the same
    return "\n".join(_within(chosen) or [text for text, *_ in chosen]), used


def _within(blocks: list[tuple[str, bool, int, int]]) -> list[str]:
    """The texts from the first to the last varying block of each article; outside articles and content slots (article -1) the varying ones alone."""
    ends: dict[int, list[int]] = {}
    for k, (_, still, article, _) in enumerate(blocks):
        if not still:
            ends.setdefault(article, [k, k])[1] = k
    return [text for k, (text, still, article, _) in enumerate(blocks) if not still or article >= 0 and article in ends and ends[article][0] < k < ends[article][1]]
