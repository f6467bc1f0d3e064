"""HTML extraction by union-free wrapper inference.

Pages of one host share a template. Their token streams (tags with class or id,
and text) are aligned one after another: equal tokens stay, adjacent repeats
become repeated groups, tokens that only some pages have become optional
groups, and text becomes a text slot. The result is the
host's wrapper: a regular expression without unions plus its text slots (element
paths, on how many pages they have text and on how many mostly links).

A page's texts are matched to the slots by their element path. A text that at
least three different pages of the host and half of the pages with that slot
have in the same slot is template, in ``article`` elements too; equal copies of a
page count once. Pages that agree in the three longest texts beside the one in
question may be copies with small changes: a text that only such pages share
stays on a page that would have less than a tenth left. A repeated group of
links in an element that holds no other text is a menu. Both go. What is left is the article; if ``article`` / ``main`` elements hold at
least half of it, only what is inside them. Nothing else decides by place, so
pages of another layout than most of their host keep their text.

Names are a first hint: elements whose tag, role, or whole class or id token
names them as menu, header, footer, sidebar, notice, advert, form or reader
comments are dropped, unless such a class or id stands around the page's only
article, main or h1.

Known limits: text outside the article that differs from page to page and has
no telling name stays on pages without article / main; hosts with fewer than
three different pages have no template texts; where most pages of a host are
rewritten copies of one article, the paragraphs they share count as template.

Wrappers are built per input partition, reduced to the distinct ones of a host
by a partial aggregate and merged by host (hosts with many wrappers in two
steps), so a host with a third of all pages costs as many rows as it has
different wrappers. They reach the extraction by broadcast while they are
small (size checked), else by a join on the host.

Defined results: null html is empty; a page without main text gives an empty
text; unclosed, truncated and wrongly nested markup is read leniently; a null
url is a host of its own; repeated rows give equal results; other columns are
carried through.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tokenflow.llm.common import cut, table
from tokenflow.llm.url_filter import split_url

#: bytes of all wrappers up to which they are broadcast
BROADCAST_BYTES = 32_000_000
#: different pages that must have a text for it to be template
TEMPLATE_PAGES = 3

# fixed values: elements and names
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "br", "wbr", "img"}
DROP_TAGS = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset", "input"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert",
              "alertdialog", "menu", "menubar", "status"}
DROP_NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adslot", "sponsor",
              "sponsored", "promo", "promotion", "banner", "sidebar", "aside", "nav", "navbar", "navigation", "menu",
              "breadcrumb", "breadcrumbs", "footer", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
              "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
              "comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "discussion", "share",
              "sharing", "social", "related", "recommended", "recommendations", "widget", "widgets", "toolbar",
              "pagination", "pager", "copyright", "masthead", "topbar", "skip"}
#: words that may stand beside a name in one class or id token
PLAIN_NAMES = {"area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "footer", "form",
               "global", "group", "header", "holder", "icons", "inner", "item", "items", "left", "link", "links", "list",
               "main", "media", "page", "panel", "posts", "primary", "right", "secondary", "section", "side", "site",
               "slot", "stories", "the", "title", "top", "unit", "wrap", "wrapper"}
HEADER_NAMES = {"header", "head", "site-header", "pageheader"}
MAIN_TAGS = {"article", "main"}
CLOSED_BY_BLOCK = {"p"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_SIGNS = re.compile(r"[()+?#/]")  # the wrapper's own signs
_DIGITS = re.compile(r"(?<=[-_])[0-9]+|[0-9]{3,}")  # post-17: the number of a page


def _named(value: str, names: set[str]) -> bool:
    """Whether a whole class or id token is such a name, with nothing but plain
    words beside it: share-buttons and ad-1 are, has-sidebar is not."""
    for token in value.split():
        if token.lower() in names:
            return True
        words = {n.lower() for n in _NAME.findall(token)}
        if words & names and all(n in names or n in PLAIN_NAMES or n.isdigit() for n in words):
            return True
    return False


class Element:
    __slots__ = ("tag", "label", "drop", "named", "holds", "main", "header")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.label = tag, tag
        # named: dropped by class or id alone; holds: has an article, main or h1 inside
        self.drop, self.main, self.header = tag in DROP_TAGS, tag in MAIN_TAGS, tag == "header"
        self.named = self.holds = False
        if not attrs or attrs.isspace():
            return
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), next((g for g in m.groups()[1:] if g is not None), "")
            if key in ("class", "id"):
                # one word without the signs of groups
                self.label += "." + _SIGNS.sub("_", _DIGITS.sub("0", ".".join(value.split())))
                if tag not in ("html", "body"):
                    self.named |= _named(value, DROP_NAMES)
                    self.header |= _named(value, HEADER_NAMES) and tag not in MAIN_TAGS
            elif key == "role":
                self.drop |= value.lower() in DROP_ROLES
                self.main |= value.lower() == "main"
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                self.drop = True
            elif key == "style":
                self.drop |= "display:none" in value.replace(" ", "").lower()


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    link: int  # characters in links
    main: bool  # in article or main
    title: bool  # in h1
    drop: bool
    hard: bool  # dropped by more than the names of elements around it
    named: tuple[Element, ...]


def read(page: str):
    """(tokens, blocks): the structure tokens of a page, and its text blocks."""
    tokens: list[str] = []
    blocks: list[Block] = []
    stack: list[Element] = []
    buffer: list[str] = []
    links, in_link, at, end = 0, False, 0, len(page)

    def flush() -> None:
        nonlocal links
        if buffer:
            text = _SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
            if text:
                path = tuple(e.label for e in stack if e.tag not in ("html", "body"))
                main = any(e.main for e in stack)
                head, inside = False, False
                for e in stack:
                    inside |= e.main
                    head |= e.header and not inside
                named = tuple(e for e in stack if e.named)
                hard = head or any(e.drop for e in stack) or any(e.main for e in named)
                blocks.append(Block(path, text, min(links, len(text)), main, any(e.tag == "h1" for e in stack),
                                    hard or bool(named), hard, named))
                tokens.append("#")
        buffer.clear()
        links = 0

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            piece = page[at:]
            buffer.append(piece)
            links += len(piece) if in_link else 0
            break
        if m.start() > at:
            piece = page[at:m.start()]
            buffer.append(piece)
            links += len(piece) if in_link else 0
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing = _SIGNS.sub("_", tag.lower()), bool(m[1] or m[4])
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            elif tag == "br":
                buffer.append(" ")
            continue
        if tag in RAW and not closing:
            if tag == "head" and not re.compile(r"</head", re.I).search(page, at):
                continue  # an unclosed head must not swallow the page
            flush()
            if not (m[3] or m[6] or "").rstrip().endswith("/"):
                stop = re.compile(rf"</{tag}\s*>?", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        flush()
        in_link = False
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    tokens.append(f"/{tag}")
                    break
                if stack[k].tag in ("article", "main", "body", "table") and tag not in ("html", "body", "article", "main"):
                    break
            continue
        while stack and (stack[-1].tag in CLOSED_BY_BLOCK or stack[-1].tag in SIBLINGS.get(tag, ())):
            tokens.append(f"/{stack.pop().tag}")
        e = Element(tag, m[3] or m[6] or "")
        if e.main or tag == "h1":
            for x in stack:
                x.holds = True
        tokens.append(e.label)
        if tag not in VOID:
            stack.append(e)
    flush()
    return tokens, blocks


# ------------------------------------------------------------------- wrappers

def collapse(tokens: list[str], longest: int = 12) -> list[str]:
    """Adjacent repeats as repeated groups ``(a b)+``, inner ones first."""
    tokens = list(tokens)
    changed = True
    while changed:
        changed = False
        for n in range(1, longest + 1):
            out: list[str] = []
            k = 0
            while k < len(tokens):
                unit = tokens[k:k + n]
                to = k + n
                while len(unit) == n and tokens[to:to + n] == unit:
                    to += n
                group = unit[0] if n == 1 and unit[0].endswith(")+") else f"({' '.join(unit)})+"
                if to > k + n:
                    out.append(group)
                    k, changed = to, True
                else:
                    out.append(tokens[k])
                    k += 1
            tokens = out
    return tokens


def _grouped(tokens: list[str], other: list[str]) -> list[str]:
    """Single occurrences of what ``other`` has as a repeated group."""
    for group in {t.rstrip("?") for t in other if t.rstrip("?").endswith(")+")}:
        unit = _split(group[1:-2])
        k, out = 0, []
        while k < len(tokens):
            if tokens[k:k + len(unit)] == unit:
                if not out or out[-1] != group:
                    out.append(group)
                k += len(unit)
            else:
                out.append(tokens[k])
                k += 1
        tokens = out
    return tokens


def _split(text: str) -> list[str]:
    """Top-level tokens of a group's inside."""
    out, depth, now = [], 0, ""
    for part in text.split(" "):
        now = f"{now} {part}" if now else part
        depth += part.count("(") - part.count(")")
        if depth <= 0:
            out.append(now)
            now, depth = "", 0
    return out + ([now] if now else [])


def align(wrapper: list[str], page: list[str]) -> list[str]:
    """Wrapper of both: common tokens, everything else optional."""
    if wrapper == page:
        return wrapper
    bare = [t.rstrip("?") for t in wrapper]
    page = _grouped(page, bare)
    bare2 = _grouped(bare, page)
    if bare2 != bare:
        wrapper, bare = list(bare2), bare2
    plain = [t.rstrip("?") for t in page]
    out: list[str] = []
    for op, a, b, c, d in SequenceMatcher(None, bare, plain, autojunk=False).get_opcodes():
        if op == "equal":
            out += [w if w.endswith("?") else (w + "?" if p.endswith("?") else w)
                    for w, p in zip(wrapper[a:b], page[c:d])]
        else:
            out += [t if t.endswith("?") else t + "?" for t in wrapper[a:b]]
            out += [t if t.endswith("?") else t + "?" for t in page[c:d]]
    return out


class Wrapper:
    """Regular expression and slots of the pages seen so far."""

    def __init__(self, data: dict | None = None):
        self.tokens: list[str] = data["tokens"] if data else []
        self.pages: int = data["pages"] if data else 0
        # path -> [pages that have text there, pages where it is mostly links]
        self.slots: dict[str, list[int]] = data["slots"] if data else {}
        self._seen: set[tuple[str, ...]] = set()

    def add_page(self, tokens: list[str], blocks) -> None:
        key = tuple(tokens)
        if key not in self._seen:
            self._seen.add(key)
            shape = collapse(tokens)
            self.tokens = align(self.tokens, shape) if self.pages else shape
        self.pages += 1
        found: dict[str, list[int]] = {}
        for b in blocks:
            if not b.drop:
                s = found.setdefault(" ".join(b.path), [0, 0])
                s[0] += len(b.text)
                s[1] += b.link
        self._merge({p: [1, int(2 * link > size)] for p, (size, link) in found.items()})

    def _merge(self, slots: dict[str, list[int]]) -> None:
        for path, (pages, links) in slots.items():
            old = self.slots.setdefault(path, [0, 0])
            old[0] += pages
            old[1] += links

    def add(self, other: "Wrapper") -> None:
        self.tokens = align(self.tokens, other.tokens) if self.pages else other.tokens
        self.pages += other.pages
        self._merge(other.slots)

    def dump(self) -> str:
        return json.dumps({"tokens": self.tokens, "pages": self.pages, "slots": self.slots}, sort_keys=True)

    def repeated(self) -> set[str]:
        """Paths of the text slots that lie in a repeated group."""
        out: set[str] = set()
        stack: list[str] = []
        opened: list[int] = []  # depths of "(" marks; every "(" is a group's
        for part in " ".join(self.tokens).split(" "):
            bare = part.lstrip("(")
            opened += [len(stack)] * (len(part) - len(bare))
            token = re.sub(r"[)+?]+$", "", bare)
            if token == "#":
                if opened:
                    out.add(" ".join(e for e in stack if _tag(e) not in ("html", "body")))
            elif token.startswith("/"):
                for k in range(len(stack) - 1, -1, -1):
                    if _tag(stack[k]) == token[1:]:
                        del stack[k:]
                        break
            elif token and _tag(token) not in VOID:
                stack.append(token)
            for _ in range(bare.count(")")):
                if opened:
                    opened.pop()
        return out

    def rules(self, texts=()) -> dict:
        """What the extraction needs: keys of template texts, and the slots of
        menus (repeated groups of links in an element without other text).
        ``texts``: (slot key, text key, sure) of the host's template texts."""
        fixed, repeated = {g for g, _, _ in texts}, self.repeated()
        plain: set[str] = set()  # elements that hold text other than links and template
        for p, (pages, links) in self.slots.items():
            if 2 * links <= pages and (p in repeated or _key(p) not in fixed):
                parts = p.split(" ") if p else []
                plain |= {" ".join(parts[:k]) for k in range(len(parts) + 1)}
        return {"texts": {t: bool(sure) for _, t, sure in texts}, "menus": {
            p for p, (pages, links) in self.slots.items()
            if 2 * links > pages and p in repeated and _holder(p) not in plain}}


def _tag(label: str) -> str:
    return label.split(".")[0]


def _holder(path: str) -> str:
    """The element that a list or paragraph of this path stands in."""
    parts = path.split(" ") if path else []
    while parts and _tag(parts[-1]) in ("p", "li", "dt", "dd", "td", "th", "tr", "tbody", "table", "ul", "ol", "dl"):
        parts.pop()
    return " ".join(parts)


def _key(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(),
                          "little", signed=True)


def _weight(blocks) -> int:
    return sum(len(b.text) - b.link for b in blocks)


def _kept(blocks) -> list:
    """Blocks outside dropped elements. An element dropped by its name alone
    that holds an article, main or h1 is taken back if nothing of the kind is
    left and the rest of the page has less text."""
    kept = [b for b in blocks if not b.drop]
    if any(b.main or b.title for b in kept):
        return kept
    back = [b for b in blocks if b.drop and not b.hard and all(e.holds for e in b.named)]
    if _weight(back) <= _weight(kept):
        return kept
    ids = {id(b) for b in back}
    return [b for b in blocks if not b.drop or id(b) in ids]


def main_text(page: str | None, rules: dict | None) -> str:
    """The article of a page as blocks joined by newlines: what its host's
    wrapper has neither as template text nor as menu; inside article / main
    elements if these hold at least half of it."""
    _, blocks = read(page or "")
    rules = rules or _EMPTY
    texts, menus = rules["texts"], rules["menus"]
    out, doubtful = [], set()
    for b in _kept(blocks):
        p = " ".join(b.path)
        sure = texts.get(_key(p, b.text)) if texts else None
        if sure or p in menus and 2 * b.link > len(b.text):
            continue
        if sure is not None:
            doubtful.add(id(b))
        out.append(b)
    own = [b for b in out if id(b) not in doubtful]
    if 10 * _weight(own) >= _weight(out):  # else the page is a copy with small changes
        out = own
    inside = [b for b in out if b.main]
    if inside and 2 * _weight(inside) >= _weight(out):
        out = inside
    return "\n".join(b.text for b in out)


_EMPTY: dict = {"texts": {}, "menus": frozenset()}


# ------------------------------------------------------------------- operator

_LEARNED = "host string, wrapper string, slot bigint, txt bigint, page bigint, rest bigint"


def _seen_texts(blocks) -> Iterator[tuple[int, int | None, int, int]]:
    """(slot, text, page, rest) of a page's kept texts, text null once per slot.
    ``page`` tells pages apart by the three longest texts beside the one in
    question, ``rest`` by all of them."""
    kept = _kept(blocks)
    texts = {b.text: _key(b.text) for b in kept}
    longest = sorted(texts, key=lambda t: (-len(t), t))[:4]
    whole, total = _key(*longest[:3]), sum(texts.values())
    beside = {t: _key(*[x for x in longest if x != t][:3]) for t in longest}
    slots: dict[str, set[str]] = {}
    for b in kept:
        slots.setdefault(" ".join(b.path), set()).add(b.text)
    for p, found in slots.items():
        g = _key(p)
        yield g, None, whole, _long(total)
        for t in found:
            yield g, _key(p, t), beside.get(t, whole), _long(total - texts[t])


def _long(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("slot", pa.int64()), ("txt", pa.int64()),
                        ("page", pa.int64()), ("rest", pa.int64())])
    found: dict[str, Wrapper] = {}
    for b in batches:
        rows: list[list] = [[] for _ in schema]
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            tokens, blocks = read(page or "")
            found.setdefault(host, Wrapper()).add_page(tokens, blocks)
            for seen in _seen_texts(blocks):
                for column, value in zip(rows, (host, None, *seen)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
    if found:
        none = pa.nulls(len(found), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()),
                                          pa.array([w.dump() for w in found.values()]), none, none, none, none],
                                         schema=schema)


def _merged(t: pa.Table) -> pa.Table:
    total = Wrapper()
    for text, times in sorted(zip(t.column("wrapper").to_pylist(), t.column("times").to_pylist())):
        w = Wrapper(json.loads(text))
        w.pages *= times
        for s in w.slots.values():
            s[:] = [x * times for x in s]
        total.add(w)
    return pa.table({"host": [t.column("host")[0].as_py()], "wrapper": [total.dump()]})


def _template_texts(seen: DataFrame) -> DataFrame:
    """(host, texts): per host the (slot, text) that at least three different
    pages and half of the pages with that slot have; ``sure`` if the pages
    differ in their three longest other texts."""
    counts = cut(seen.groupBy("host", "slot", "txt").agg(
        F.count_distinct("page").alias("n"), F.count_distinct("rest").alias("m")).where(f"m >= {TEMPLATE_PAGES}"))
    slots = counts.where("txt is null").select(F.col("host").alias("h"), F.col("slot").alias("g"),
                                               F.col("n").alias("ns"), F.col("m").alias("ms"))
    found = counts.where("txt is not null").join(
        slots, F.col("host").eqNullSafe(F.col("h")) & (F.col("slot") == F.col("g"))).where("2 * m >= ms")
    sure = F.expr(f"int(n >= {TEMPLATE_PAGES} and 2 * n >= ns)").alias("sure")
    return found.select(F.col("host").alias("th"), F.struct("slot", "txt", sure).alias("x")).groupBy("th").agg(
        F.collect_list("x").alias("texts"))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper, texts): one wrapper per host, from all its pages, and
    the host's template texts."""
    host, _ = split_url(F.col(url))
    learned = cut(pages.select(host.alias("host"), F.col(html).alias("html")).mapInArrow(_learn, _LEARNED))
    parts = learned.where("wrapper is not null").select("host", "wrapper")
    for salt in (64, 1):  # distinct wrappers of a host, merged in two steps
        distinct = parts.groupBy("host", "wrapper").agg(F.count("*").alias("times")).withColumn(
            "salt", F.pmod(F.xxhash64("wrapper"), F.lit(salt)))
        parts = distinct.groupby("host", "salt").applyInArrow(_merged, "host string, wrapper string")
    texts = _template_texts(learned.where("wrapper is null"))
    return parts.join(texts, F.col("host").eqNullSafe(F.col("th")), "left").select(
        "host", "wrapper",
        F.coalesce("texts", F.expr("cast(array() as array<struct<slot: bigint, txt: bigint, sure: int>>)")).alias("texts"))


def extract(pages: DataFrame, url: str = "url", html: str = "html",
            broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` plus column ``main_text``."""
    spark = pages.sparkSession
    known = cut(wrappers(pages, url, html))
    host, _ = split_url(F.col(url))
    size = known.agg(F.coalesce(F.sum(F.length("wrapper") + 20 * F.size("texts")), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        rules = {r[0]: Wrapper(json.loads(r[1])).rules(r[2]) for r in known.toLocalIterator()}
        shared = spark.sparkContext.broadcast(rules)

        @F.pandas_udf("string")
        def by_host(h: pd.Series, page: pd.Series) -> pd.Series:
            return pd.Series([main_text(p, shared.value.get(x)) for x, p in zip(h, page)], dtype=object)

        return pages.withColumn("main_text", by_host(host, F.col(html)))

    @F.pandas_udf("string")
    def by_wrapper(w: pd.Series, t: pd.Series, page: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], dict] = {}
        out = []
        for x, texts, p in zip(w, t, page):
            if not isinstance(x, str):
                out.append(main_text(p, None))
                continue
            if (x, texts) not in seen:
                seen[x, texts] = Wrapper(json.loads(x)).rules([tuple(v) for v in json.loads(texts)])
            out.append(main_text(p, seen[x, texts]))
        return pd.Series(out, dtype=object)

    cols = [F.col(f"_row.`{c}`").alias(c) for c in pages.columns]
    held = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"), host.alias("_host"))
    pairs = F.expr("concat('[', array_join(transform(array_sort(texts), x -> concat('[', x.slot, ',', x.txt, ',', x.sure, ']')), ','), ']')")
    known = known.select(F.col("host").alias("_h"), "wrapper", pairs.alias("texts"))
    return held.join(known, F.col("_host").eqNullSafe(F.col("_h")), "left").select(
        *cols, by_wrapper(F.col("wrapper"), F.col("texts"), F.col(f"_row.`{html}`")).alias("main_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"),
                      F.length("main_text").cast("long").alias("n_chars"))
