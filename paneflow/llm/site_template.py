"""Main text of web pages by site template removal.

1. Every page is parsed in its task; each element subtree that holds text gets a hash of its
   tag, text and children.  A page sends each of its hashes once.
2. Spark counts, per host, the distinct page bodies (the text of the article, or of the
   containers with most paragraphs) that a subtree stands with, so copies of a page count
   once.  Subtrees with many bodies of their host are its template.
3. The template hashes of each page are joined back to it, the page is parsed again, and these
   subtrees are deleted, along with elements that are never article text by their tag, role or
   class (menus, forms, scripts, notices, adverts, reader comments ...).
4. What is left of the article becomes blocks: text between block boundaries, character
   references decoded, white space folded to one blank, joined by an empty line.

A subtree is never deleted as template when it holds half of the page's text or more, or is a
paragraph or heading of the article itself; copies of an article are one body and no evidence
of a template: they stay whole.

Defined results: a null or empty page has the empty text; a page without a host (null or
relative address) belongs to the host ''; repeated rows count as one page and get the
same text; an unclosed tag, comment or script reaches to the end of its parent or of the page.
"""

from __future__ import annotations

import re
from html import unescape
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.llm.common import blocks, durable, ship, texts_of

MIN_PAGES = 5       # a template subtree stands with so many bodies of its host at least ...
MIN_SHARE = 0.1     # ... and with this share of them,
ENOUGH_PAGES = 50   # or with so many, however large the host

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp
small span strike strong sub sup time tt u var wbr input button""".split())
JUNK_TAGS = frozenset("""head script style noscript template nav footer aside button select textarea input iframe
svg canvas object embed dialog menu audio video map""".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
JUNK_WORDS = frozenset("""ad ads advert adverts advertisement advertising adbox adsense banner promo promotion promoted sponsor
sponsored nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar aside
widget widgets related recommended recommendations share sharing social comment comments commentlist reply replies respond
discussion disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription
signup login signin search searchbox form pagination pager paging skip toolbar legal copyright teaser teasers""".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond discussion disqus".split())
TITLE_WORDS = frozenset(("header", "banner", "masthead"))  # fine inside an article: its own head
#: An open <p> ends where one of these begins.
ENDS_P = frozenset("""address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5
h6 header hgroup hr main menu nav ol p pre section table ul""".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = frozenset(("article", "main", "section", "body", "html", "table", "ul", "ol", "dl", "div", "td", "nav", "footer", "aside", "form"))
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr article main body html".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6".split())
CONTENT_IDS = frozenset(("content", "main-content", "maincontent", "main", "article", "post", "entry", "story"))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Page:
    """Elements in document order (``parent[i] < i``) and texts with their block number."""

    def __init__(self, html: str):
        self.tag, self.parent, self.attrs, self.digest, self.size = ["#page"], [-1], [{}], [0], [0]
        self.texts: list[tuple[int, int, str]] = []  # (element, block number, text)
        parts: list[list[bytes]] = [[]]
        stack, block, at = [0], 0, 0

        def add(raw: str) -> None:
            if raw.isspace():
                self.texts.append((stack[-1], block, " "))
            elif raw:
                t = unescape(raw) if "&" in raw else raw
                self.texts.append((stack[-1], block, t))
                flat = " ".join(t.split())
                self.size[stack[-1]] += len(flat)
                parts[stack[-1]].append(b"t" + flat.encode("utf-8", "surrogatepass"))

        def pop() -> None:
            i = stack.pop()
            x = xxhash.xxh3_64_intdigest(self.tag[i].encode("utf-8", "surrogatepass") + b"\0" + b"\0".join(parts[i]))
            self.digest[i] = signed(x)
            parts[i] = []
            p = self.parent[i]
            self.size[p] += self.size[i]
            parts[p].append(b"e" + x.to_bytes(8, "little"))

        def close(names: set[str] | frozenset[str], scope: frozenset[str]) -> bool:
            for k in range(len(stack) - 1, 0, -1):
                name = self.tag[stack[k]]
                if name in names:
                    while len(stack) > k:
                        pop()
                    return True
                if name in scope:
                    return False
            return False

        pos, n = 0, len(html)
        while pos < n:
            m = TOKEN.search(html, pos)
            if m is None:
                add(html[at:])
                at = n
                break
            if m.start() > at:
                add(html[at:m.start()])
            at = pos = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            inline = name in INLINE
            if m[1]:
                if name in VOID:
                    continue
                block += not inline
                close({name}, SCOPE - {name} if inline or name in ("p", "li") else frozenset())
                continue
            block += not inline and name != "br"
            if name == "br":
                self.texts.append((stack[-1], block, " "))
                continue
            if name in ENDS_P:
                close({"p"}, SCOPE)
            if name in SIBLINGS:
                close(SIBLINGS[name], SCOPE - SIBLINGS[name])
            raw = m[3]
            i = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.attrs.append({k.lower(): (a or b or c) for k, a, b, c in ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {})
            self.digest.append(0)
            self.size.append(0)
            parts.append([])
            if name in VOID or raw.endswith("/") and name in ("svg", "path"):
                continue
            stack.append(i)
            if name in RAW:  # its content is text, whatever it looks like
                end = RAW[name].search(html, pos)
                if name == "title":
                    add(html[pos:end.start()])
                pop()
                at = pos = end.end()
        if at < n:
            add(html[at:])
        while len(stack) > 1:
            pop()

    def subtrees(self) -> tuple[int, set[tuple[int, int]]]:
        """Hash of the page's body, and (hash of a subtree, hash of the body as seen from it) of the
        subtrees that hold text and may be template: what is never article text, or always,
        need not be counted."""
        n = len(self.tag)
        in_article, gone = self._zones()
        bodies = self._bodies(gone)
        holds: dict[int, set[int]] = {}  # the containers in a subtree
        for c in bodies:
            i = c
            while i >= 0:
                holds.setdefault(i, set()).add(c)
                i = self.parent[i]
        seen = {of: signed(xxhash.xxh3_64_intdigest("\0".join(bodies[c] for c in of).encode("utf-8", "surrogatepass")))
                for of in {tuple(bodies)} | {(c,) for c in bodies}}
        found, inside = set(), [0] * n  # the nearest container around the element
        for i in range(1, n):
            p = self.parent[i]
            inside[i] = p if p in bodies else inside[p]
            if not self.size[i] or gone[i] or not self._deletable(i, in_article[i]):
                continue
            # a part of a container is seen with it, other subtrees with the containers they do not hold
            of = (inside[i],) if inside[i] else tuple(c for c in bodies if c not in holds.get(i, ())) or tuple(bodies)
            if of not in seen:
                seen[of] = signed(xxhash.xxh3_64_intdigest("\0".join(bodies[c] for c in of).encode("utf-8", "surrogatepass")))
            found.add((self.digest[i], seen[of]))
        return seen[tuple(bodies)], found

    def _bodies(self, gone: list[bool]) -> dict[int, str]:
        """The containers that tell a page's content from that of other pages, and their text: its
        articles, else the parents of a quarter of the text in paragraphs, else the page.  Only
        paragraphs and headings count, if there are any: copies stay equal whatever else changes."""
        n = len(self.tag)
        live = [i for i in range(1, n) if not gone[i] and self.size[i]]
        roots: list[int] = []
        for fits in CONTAINERS:
            if roots := self._outermost([i for i in live if fits(self, i)]):
                break
        marked = bool(roots)
        if not marked:
            own: dict[int, int] = {}
            for i in live:
                if self.tag[i] in PARAGRAPHS:
                    own[self.parent[i]] = own.get(self.parent[i], 0) + self.size[i]
            roots = sorted(i for i, x in own.items() if 4 * x >= sum(own.values())) or [0]
        known = set(roots)
        around, prose = [0 if 0 in known else -1] * n, [False] * n
        for i in range(1, n):
            p = self.parent[i]
            heads = self.tag[i] in PARAGRAPHS and (marked or p in known)
            prose[i] = prose[p] or heads
            around[i] = i if marked and i in known else p if heads and not marked else around[p]
        texts: dict[int, list[str]] = {c: [] for c in roots}
        rest: dict[int, list[str]] = {c: [] for c in roots}
        for e, _, t in self.texts:
            if not gone[e] and around[e] in known:
                (texts if prose[e] else rest)[around[e]].append(t)
        return {c: " ".join("".join(texts[c] or rest[c]).split()) for c in roots}

    def _outermost(self, found: list[int]) -> list[int]:
        """The elements of ``found`` that lie in no other one of it."""
        known, out = set(found), []
        for i in found:
            p = self.parent[i]
            while p >= 0 and p not in known:
                p = self.parent[p]
            if p < 0:
                out.append(i)
        return out

    def _zones(self) -> tuple[list[bool], list[bool]]:
        """For each element: lies it in an article; is it, or lies it in, an element that is never article text."""
        n = len(self.tag)
        in_article, gone, named, nested = [False] * n, [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            p = self.parent[i]
            in_article[i] = in_article[p] or self.tag[p] in ("article", "main") and not gone[p]
            comment = self.tag[i] == "article" and self._is_comment(i)
            nested[i] = nested[p] or self.tag[p] == "article"
            gone[i] = gone[p] or self._junk(i, in_article[i]) or nested[i] and comment
            named[i] = not gone[i] and (comment or self._named_junk(i, in_article[i]))
        if any(named):
            wrapper = self._wrappers(gone, named)
            for i in range(1, n):
                gone[i] = gone[i] or gone[self.parent[i]] or named[i] and not wrapper[i]
        return in_article, gone

    def _wrappers(self, gone: list[bool], named: list[bool]) -> list[bool]:
        """Elements that hold the article or half of the page's text: their class or role, or being
        a form, says nothing about the text in them."""
        n = len(self.tag)
        size, article, main = [0] * n, [0] * n, [False] * n
        for e, _, t in self.texts:
            if not gone[e]:
                size[e] += len(t.strip())
        for i in range(n - 1, 0, -1):
            if size[i] and not gone[i]:
                p = self.parent[i]
                size[p] += size[i]
                main[i] = main[i] or self.tag[i] == "main" or self.attrs[i].get("role") == "main"
                main[p] = main[p] or main[i]
                article[i] = max(article[i], size[i] if self.tag[i] == "article" and not self._is_comment(i) else 0)
                article[p] = max(article[p], article[i])
        # what stands in no element that its name condemns, or only in such as hold half of the text
        comments = [named[i] and bool(self._words(i) & COMMENT_WORDS) for i in range(n)]
        large = [named[i] and 2 * size[i] >= size[0] for i in range(n)]
        outside, likely, paragraphs, others = [True] * n, [True] * n, 0, set()
        for i in range(1, n):
            outside[i] = outside[self.parent[i]] and not gone[i] and not named[i]
            likely[i] = likely[self.parent[i]] and not gone[i] and (not named[i] or large[i] and not comments[i])
            if outside[i] and size[i] and self.tag[i] in ("article", "main"):
                others.add(i)
            paragraphs += size[i] if likely[i] and self.tag[i] in PARAGRAPHS else 0
        # teasers and comments hold articles too, or much text: they go beside more text in paragraphs
        return [named[i] and (main[i] or article[i] > 0 and article[i] == article[0] and 2 * article[i] >= paragraphs
                              or large[i] and not others - self._above(i) and not (paragraphs and comments[i] and self.tag[i] != "article"))
                for i in range(n)]

    def _above(self, i: int) -> set[int]:
        """The elements around an element."""
        out = set()
        while i > 0:
            i = self.parent[i]
            out.add(i)
        return out

    def _deletable(self, i: int, in_article: bool) -> bool:
        """May the subtree go as template?  Paragraphs and headings of the article stay."""
        return self.tag[i] not in INLINE and self.tag[i] not in ("article", "main") and not (in_article and self.tag[i] in TEXT_BLOCKS)

    def _junk(self, i: int, in_article: bool) -> bool:
        tag, attrs = self.tag[i], self.attrs[i]
        if tag in JUNK_TAGS or tag == "header" and not in_article:
            return True
        if not attrs or tag in ("html", "body", "article", "main"):
            return False
        return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()

    def _named_junk(self, i: int, in_article: bool) -> bool:
        """Do the element's role, class or id, or its being a form, make it no article text, unless it is a wrapper?"""
        tag, attrs = self.tag[i], self.attrs[i]
        if tag == "form":
            return True
        if not attrs or tag in ("html", "body", "article", "main"):
            return False
        if attrs.get("role", "").lower() in JUNK_ROLES:
            return True
        return bool(self._words(i) & (JUNK_WORDS - TITLE_WORDS if in_article else JUNK_WORDS))

    def _words(self, i: int) -> set[str]:
        """The words of class and id."""
        attrs = self.attrs[i]
        return set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower()))

    def text(self, template: set[int]) -> str:
        """The main text, without the subtrees in ``template``."""
        n = len(self.tag)
        in_article, gone = self._zones()
        left = [0] * n
        for e, _, t in self.texts:
            if not gone[e]:
                left[e] += len(t.strip())
        for i in range(n - 1, 0, -1):
            left[self.parent[i]] += left[i]
        if template:
            half = left[0] / 2
            for i in range(1, n):
                gone[i] = gone[i] or gone[self.parent[i]] or (
                    self.digest[i] in template and left[i] < half and self._deletable(i, in_article[i]))
        inside = [False] * n
        for root in self._container(left, gone):
            inside[root] = True
        for i in range(1, n):
            inside[i] = inside[i] or inside[self.parent[i]]
        found: dict[int, list[str]] = {}
        for e, b, t in self.texts:
            if inside[e] and not gone[e]:
                found.setdefault(b, []).append(t)
        return "\n\n".join(x for x in (" ".join("".join(p).split()) for p in found.values()) if x)

    def _is_comment(self, i: int) -> bool:
        words = f"{self.attrs[i].get('class', '')} {self.attrs[i].get('id', '')}".lower()
        return "comment" in words or "reply" in words

    def _container(self, left: list[int], gone: list[bool]) -> list[int]:
        """The article: every outermost <article>, else <main> or elements named so, else the
        smallest element that holds all paragraphs, headings and text outside links."""
        n = len(self.tag)
        live = [i for i in range(1, n) if not gone[i] and left[i]]
        for fits in CONTAINERS:
            if found := self._outermost([i for i in live if fits(self, i)]):
                return found
        link, wanted = [False] * n, {i for i in live if self.tag[i] in PARAGRAPHS}
        for i in range(1, n):
            link[i] = link[self.parent[i]] or self.tag[i] == "a"
        wanted |= {e for e, _, t in self.texts if not gone[e] and not link[e] and any(map(str.isalnum, t))}
        count = [int(i in wanted) for i in range(n)]  # how many of them lie at or below the element
        for i in range(n - 1, 0, -1):
            count[self.parent[i]] += count[i]
        # such elements lie in one another: the last is the smallest
        root = max((i for i in range(n) if wanted and count[i] == len(wanted)), default=0)
        while root and self.tag[root] in INLINE | PARAGRAPHS:
            root = self.parent[root]
        return [root]


#: What marks the article, the best mark first.
CONTAINERS = (lambda page, i: page.tag[i] == "article",
              lambda page, i: page.attrs[i].get("itemprop") == "articleBody",
              lambda page, i: page.tag[i] == "main" or page.attrs[i].get("role") == "main",
              lambda page, i: page.attrs[i].get("id", "").lower() in CONTENT_IDS)


def subtree_rows(pages: DataFrame) -> DataFrame:
    """(row_key, host, body, subtrees, bodies), a row for each page: the hash of its body, those of
    its subtrees and of the body as each of them sees it; ``pages`` has row_key, host, html."""
    ship(pages.sparkSession)

    def run(batches):
        for batch in batches:
            for part in blocks(batch, 2):
                body, found = zip(*[Page(x).subtrees() for x in texts_of(part.column(2))], strict=True)
                ends = pa.array([0, *accumulate(map(len, found))], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array([x[k] for f in found for x in f], pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(body, pa.int64()), *lists],
                                                 names=["row_key", "host", "body", "subtrees", "bodies"])

    return pages.select("row_key", "host", "html").mapInArrow(run, "row_key long, host long, body long, subtrees array<long>, bodies array<long>")


def templates(rows: DataFrame, hosts: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
              enough: int = ENOUGH_PAGES) -> DataFrame:
    """(host, subtree) that recur with many bodies; ``rows`` has (host, subtree, body) and
    ``hosts`` (host, pages), the distinct bodies of the host.  Copies of a page count once."""
    counts = (rows.select("host", "subtree", "body").distinct()
              .groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages))
    return counts.join(hosts, "host").where((F.col("n") >= min_share * F.col("pages")) | (F.col("n") >= enough)).select("host", "subtree")


def extract(pages: DataFrame, html: str = "html", url: str = "url", out: str = "text") -> DataFrame:
    """All columns of ``pages`` but ``html``, plus ``out``: the main text."""
    ship(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html, out)]
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    keyed = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"),
                         F.xxhash64(url, html, *[F.col(f"`{c}`") for c in keep]).alias("row_key"), F.xxhash64(host).alias("host"))
    seen = durable(subtree_rows(keyed))
    rows = (seen.select("row_key", "host", F.explode(F.arrays_zip("subtrees", "bodies")).alias("x"))
            .select("row_key", "host", F.col("x.subtrees").alias("subtree"), F.col("x.bodies").alias("body")))
    hosts = seen.select("host", "body").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    hits = (rows.select("row_key", "host", "subtree").join(templates(rows, hosts), ["host", "subtree"])
            .groupBy(F.col("row_key").alias("hit_key")).agg(F.collect_set("subtree").alias("template")))
    joined = keyed.join(hits.hint("shuffle_hash"), F.col("row_key") == F.col("hit_key"), "left").select("row", "html", "template")

    def run(batches):
        for batch in batches:
            for part in blocks(batch, 1):
                texts = [Page(x).text(set(t or ())) for x, t in zip(texts_of(part.column(1)), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["row", out])

    schema = joined.select("row").schema.add(out, "string")
    done = joined.mapInArrow(run, schema)
    return done.select(*[F.col("row").getField(c).alias(c) for c in keep], F.col(out))


def digest(pages: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
