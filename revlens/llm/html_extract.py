"""Main text of web pages by template deduction over the pages of a host.

A page is a sequence of tokens: element paths (tags with class and id names) and texts at
a path.  Tokens of one host that share an occurrence vector - the same count on every page
- form an equivalence class.  Vectors are compared by a digest that is combined page by
page (exclusive or of hashed page and count), so no vector is ever held.  Pages of one host
with the same html are one page.  A class is valid if it occurs on most pages of its host,
its tokens come once a page, and it holds structure (a path, or the page itself) and not
only text; it nests in the class that holds the paths its tokens stand under, which must be
one.  Valid classes that reach outside of the article are the host's template; what they do
not cover are the slots.  A text in an article or main part is always a slot.

The text slots of the article region are the result.  Which slots hold menus, notices,
adverts, forms or comments is told by the element they stand in.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import cut, released, small_side

MIN_PAGES = 10            # pages of a host below which its repeated texts prove nothing
MIN_SHARE = 0.8           # share of a host's pages on which a template class occurs
MOST_BROADCAST_ROWS = 200_000
HELD_TOKENS = 400_000

# HTML's void and raw-text elements, block elements, and implied end tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr option optgroup legend summary figcaption li dd dt".split()) | {"li", "dd", "dt"}
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"),
          "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
# Elements, roles and class or id words that mark what is not the article.
DROP_TAGS = frozenset("nav aside footer form script style noscript template iframe svg canvas button select textarea dialog menu object audio "
                      "video head title fieldset input label datalist math map search".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice "
    "notices notification notifications alert alerts popup popover modal overlay newsletter subscribe subscription signup signin login paywall "
    "sidebar aside menu menus nav navbar navigation topbar breadcrumb breadcrumbs footer footnav masthead comment comments commentlist "
    "discussion disqus replies respond share sharing social related recommended recommendations teaser teasers pagination pager widget widgets "
    "toolbar skip skiplink search form feedback copyright legal disclaimer hidden".split())
HEAD_WORDS = frozenset("header masthead banner topbar".split())
# parts of a class name that say nothing of its own: "comment-list" is comments, "legal-history" is not legal
PLAIN_WORDS = frozenset("list box section container area wrapper wrap block bar unit slot inner outer content link links button buttons item items group panel "
                        "row col left right top bottom main site page post article js el".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+))|(?<![^\s\"'])(hidden)(?=[\s/]|$)", re.S)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")


def _attributes(raw: str) -> tuple[frozenset[str], frozenset[str], str, bool, bool]:
    """(words of class and id, those of names that hold no word of their own besides
    ``DROP_WORDS``, role, hidden, marks an article body)."""
    words, plain, role, hidden, body = set(), set(), "", False, False
    for m in _ATTRIBUTE.finditer(raw):
        name = (m[1] or m[5]).lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for one in value.split():
                parts = {w.lower() for w in _NAME_PART.findall(one)}
                words |= parts
                if all(w in DROP_WORDS or w in PLAIN_WORDS or w.isdigit() for w in parts):
                    plain |= parts
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
        elif name == "itemprop" and value.lower() == "articlebody":
            body = True
    return frozenset(words), frozenset(plain), role, hidden, body


class Page:
    """Blocks of one page, in order: (path digest, text, region, dropped).

    region is 2 inside an article, 1 inside a main part, 0 elsewhere.
    """

    def __init__(self, source: str | None):
        self.blocks: list[tuple[int, str, int, bool]] = []
        self.paths: dict[int, int] = {}          # path digest -> how often it opens
        self.parent: dict[int, int] = {}         # path digest -> digest of the path around it
        self.within: dict[int, int] = {}         # path digest -> region around it
        self._read(source or "")

    def _read(self, s: str) -> None:
        # an open element: (tag, path, dropped, region)
        stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]
        open_tags: dict[str, int] = {}
        text: list[str] = []
        at, n = 0, len(s)

        def pop_to(k: int) -> None:
            for tag, *_ in stack[k:]:
                open_tags[tag] -= 1
            del stack[k:]

        def end_block() -> None:
            if text:
                whole = _SPACE.sub(" ", "".join(text)).strip()
                text.clear()
                if whole:
                    _, path, dropped, region = stack[-1]
                    for tag, p, d, r in reversed(stack):     # the block element that holds it
                        if tag in BLOCK or not tag:
                            path = p
                            break
                    self.blocks.append((path, whole, region, dropped))

        for m in _TOKEN.finditer(s):
            if m.start() < at:
                continue
            if m.start() > at:
                self._text(s[at:m.start()], stack, text)
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                if m[0].startswith("<![CDATA["):
                    continue
                continue
            closing, raw = (m[1], m[3]) if m[2] else (m[4], m[6])
            if tag == "br":
                text.append(" ")
                continue
            if closing:
                if tag in BLOCK:
                    end_block()
                if open_tags.get(tag):
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    if any(x[0] in BLOCK for x in stack[k:]):
                        end_block()
                    self._leave(stack[k:], text, end_block)
                    pop_to(k)
                continue
            if tag in BLOCK:
                end_block()
            if tag in CLOSES_P and open_tags.get("p"):
                k = len(stack) - 1
                while stack[k][0] not in ("p", "td", "th", "button", "caption"):
                    k -= 1
                if stack[k][0] == "p":
                    pop_to(k)
            if tag in CLOSES:
                ends, bounds = CLOSES[tag]
                k = len(stack) - 1
                while k and stack[k][0] not in ends and stack[k][0] not in bounds:
                    k -= 1
                if k and stack[k][0] in ends:
                    pop_to(k)
            _, path, dropped, region = stack[-1]
            words, plain, role, hidden, body = _attributes(raw) if raw and not raw.isspace() else (frozenset(), frozenset(), "", False, False)
            here = xxhash.xxh64_intdigest(f"{path} {tag} {' '.join(sorted(words))}") >> 1
            self.paths[here] = self.paths.get(here, 0) + 1
            self.parent[here] = path
            self.within[here] = max(region, self.within.get(here, 0))
            if not dropped:
                # within the article a name must say it outright
                dropped = self._drops(tag, plain if region else words, role, hidden, region)
                if not dropped:
                    if tag == "article" or role == "article" or body:
                        region = 2
                    elif (tag == "main" or role == "main") and region < 1:
                        region = 1
            elif tag in ("article", "main") and not any(x[0] in ("article", "main", "aside", "dialog", "form") or x[3] for x in stack) and not self._drops(tag, words, role, hidden, 0):
                # an unclosed menu or header does not swallow the article
                dropped, region = False, 2 if tag == "article" else 1
            if tag in VOID or raw and raw.rstrip().endswith("/") and tag in ("path", "circle", "rect", "use", "g"):
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(s, at)
                at = end.end() if end else n
                continue
            if dropped != stack[-1][2] or tag in BLOCK:
                end_block()
            stack.append((tag, here, dropped, region))
            open_tags[tag] = open_tags.get(tag, 0) + 1
        if at < n:
            self._text(s[at:], stack, text)
        end_block()

    @staticmethod
    def _leave(left, text, end_block) -> None:
        """The text of a dropped inline element must not run into what follows it."""
        if left and left[0][2]:
            end_block()

    @staticmethod
    def _text(raw: str, stack, text: list[str]) -> None:
        if not (stack[-1][2] and not raw.strip()):
            text.append(html.unescape(raw))

    @staticmethod
    def _drops(tag: str, words: frozenset[str], role: str, hidden: bool, region: int) -> bool:
        if hidden or tag in DROP_TAGS or role in DROP_ROLES:
            return True
        if tag in ("html", "body", "main", "h1"):
            return False
        if tag == "header" or words & HEAD_WORDS:
            return region == 0 and tag not in ("article",)
        if tag == "article":
            return bool(words & {"comment", "comments", "teaser", "related", "recommended", "promo", "sponsored", "ad", "advert"})
        return bool(words & DROP_WORDS)

    def tokens(self) -> dict[int, tuple[int, int, bool, bool]]:
        """Token digest -> (count, path around it, is a path, in an article or main part):
        paths, and texts at a path."""
        out = {p: (n, self.parent[p], True, self.within[p] > 0) for p, n in self.paths.items()}
        for path, text, region, _ in self.blocks:
            t = text_token(path, text)
            n, _, _, inside = out.get(t, (0, path, False, False))
            out[t] = (n + 1, path, False, inside or region > 0)
        return out

    def main_text(self, template: frozenset[int] | set[int] = frozenset()) -> str:
        """Slots of the article region, joined; without an article those of the main part,
        without that those of the page.  Only text outside of both can be template."""
        slots = [(region, text) for path, text, region, dropped in self.blocks if not dropped and (region or text_token(path, text) not in template)]
        best = max((r for r, _ in slots), default=0)
        return "\n\n".join(t for r, t in slots if r == best)


def text_token(path: int, text: str) -> int:
    return (xxhash.xxh64_intdigest(text, seed=path & 0xFFFFFFFF) ^ path) >> 1


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))


def _different(rows: DataFrame) -> DataFrame:
    """``(host, html)``: every html of a host once.  Only pages that have a copy are shuffled."""
    marked = rows.select("host", "html", F.md5("html").alias("digest"))
    copied = cut(marked.groupBy("host", "digest").agg(F.count("*").alias("n")).where("n > 1").select("host", "digest"), "html-copies")
    n = copied.count()
    if not n:
        return marked.select("host", "html")
    copied = small_side(copied, n, MOST_BROADCAST_ROWS)
    once = marked.join(copied, ["host", "digest"], "left_anti")
    again = marked.join(copied, ["host", "digest"], "left_semi").dropDuplicates(["host", "digest"])
    return once.select("host", "html").unionAll(again.select("host", "html"))


def classes(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, token, parent, path, inside, pages, most, vector)`` of every token that
    occurs on at least ``MIN_PAGES`` different pages; ``vector`` names the equivalence class,
    ``path`` tells paths from texts, ``inside`` whether it stands in an article or main part
    on some page.  Counts are combined in the tasks before the one shuffle; token 0 stands
    for the page itself."""
    names = ["host", "token", "parent", "path", "inside", "pages", "most", "vector"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}

        def flush():
            keys, values = list(held), list(held.values())
            held.clear()
            for at in range(0, len(keys), 20_000):
                k, v = keys[at:at + 20_000], values[at:at + 20_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[0] for x in k], pa.string()), pa.array([x[1] for x in k], pa.int64()), *(
                        pa.array([x[c] for x in v], pa.int64()) for c in range(6))], names=names)

        for batch in released(batches):
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                source = source.as_py()
                name = xxhash.xxh64_intdigest(source.encode("utf-8", "surrogatepass"))
                for token, (count, parent, path, inside) in [(0, (1, 0, True, False)), *Page(source).tokens().items()]:
                    bit = xxhash.xxh64_intdigest(f"{name} {count}") >> 1
                    old = held.get((host, token))
                    if old is None:
                        held[host, token] = [parent, int(path), int(inside), 1, count, bit]
                    else:
                        old[2] |= inside
                        old[3] += 1
                        old[4] = max(old[4], count)
                        old[5] ^= bit
                if len(held) >= HELD_TOKENS:
                    yield from flush()
        if held:
            yield from flush()

    found = _different(_rows(pages, id_col, url_col, html_col)).mapInArrow(work, ", ".join(f"{n} {'string' if n == 'host' else 'long'}" for n in names))
    return (found.groupBy("host", "token").agg(F.max("parent").alias("parent"), F.max("path").alias("path"), F.max("inside").alias("inside"),
                                               F.sum("pages").alias("pages"), F.max("most").alias("most"), F.bit_xor("vector").alias("vector"))
            .where(F.col("pages") >= MIN_PAGES))


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, token, vector, outer)``: the texts of the template, their class and the one
    it nests in (null for the class of the page itself, or under a path that repeats)."""
    every = cut(classes(pages, id_col, url_col, html_col), "html-classes")
    sizes = every.where("token = 0").select("host", F.col("pages").alias("size"))
    valid = every.where("most = 1").join(sizes, "host").where(F.col("pages") >= MIN_SHARE * F.col("size"))
    around = valid.where("path = 1").select(F.col("host").alias("h"), F.col("token").alias("t"), F.col("vector").alias("around"))
    placed = valid.join(around, (F.col("host") == F.col("h")) & (F.col("parent") == F.col("t")), "left")
    outer = F.when(F.col("around") != F.col("vector"), F.col("around"))
    grouped = (placed.groupBy("host", "vector").agg(F.max("path").alias("paths"), F.min("inside").alias("enclosed"),
                                                    F.min(outer).alias("outer"), F.max(outer).alias("last"))
               .where("paths = 1 AND enclosed = 0 AND (outer IS NULL OR outer = last)"))
    return valid.where("path = 0 AND inside = 0").join(grouped, ["host", "vector"]).select("host", "token", "vector", "outer")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text)``: the main text of every page.

    Blocks are joined by an empty line, white space inside a block becomes one space.  A
    null or empty page, and a page without text outside of menus and the like, give the
    empty text.  Pages without a host share the empty one.  Rows are neither lost nor
    merged; pages of one html count once for the template.
    """
    template = cut(templates(pages, id_col, url_col, html_col), "html-template")
    by_host = template.groupBy("host").agg(F.collect_set("token").alias("known"))
    # a host's tokens are bounded by the length of its pages / MIN_SHARE; the table is broadcast only when counted small
    few = template.count() <= MOST_BROADCAST_ROWS
    joined = _rows(pages, id_col, url_col, html_col).join(F.broadcast(by_host) if few else by_host, "host", "left").select("page_id", "url", "html", "known")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[object, frozenset[int]] = (None, frozenset())
        for batch in released(batches):
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = []
                for source, known in zip(part.column(2), part.column(3)):
                    known = known.as_py()
                    if known != last[0]:
                        last = (known, frozenset(known or ()))
                    texts.append(Page(source.as_py()).main_text(last[1]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(work, "page_id long, url string, text string")
