"""Main text of web pages by site template removal.

Element subtrees are hashed and counted per host; subtrees that recur on many pages of their host are its template
and are deleted.  What is left of the page's body, without boilerplate elements, is the main text.  The body's articles
and mains are its content roots, save those marked as comments, related pages or sidebars.  A paragraph, heading,
quotation or table that recurs inside one is content that pages share and stays; roots themselves and what encloses
them are never template.  What lies outside them goes where it recurs, like any other part of a page.

Subtrees are counted on distinct pages only: inside an article or main, pages whose roots have the same text are one
page, and elsewhere pages that have the same text, so that copies of an article or of a whole body never make their
own parts template.  Nor do near copies of an article: one of the sketches of the roots' texts, their least hashes of
five words, must take enough different values too, and at least a third as many as there are distinct texts, since
texts that share most of their words mostly share their sketches.

With ``slots`` the host decides what goes, and names no longer do.  Outside the content roots a part of the page is
also told by its skeleton: its tags, its class, id and role names, and the skeletons of its children, without any
text.  A menu, a footer or an advert differs from page to page in its words and keeps its skeleton; one that at least
``slot_share`` of the host's distinct pages have is a slot of the template.  Pages without a content root have no slots,
as their text may lie in any part.  What is boilerplate by its tag or name alone is added to the template only where
neither its hash nor its skeleton recurs, as on hosts of a few pages.  The text is then what the template leaves; scripts
and styles go as markup.

Text: character references decoded, white space inside a block turned into one space, blocks trimmed and joined by
newlines in page order, empty blocks left out, nothing cut short.  ``br`` is white space.

Defined results: null or empty html gives the empty text; pages whose url has no host form one host of their own;
rows that repeat are each extracted; html cut off anywhere is read as far as it goes; an empty table gives an empty
result; extra columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cached_property
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import cut
from lattica.llm.tokens import U64, mix, rolling, words

#: Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("li dd dt td th tr tbody thead tfoot body html summary figcaption".split())
BOILERPLATE = frozenset("nav header footer aside form button select dialog menu head".split()) | RAW
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table thead tbody tr td th li dd dt br b i em strong span a code sub sup img figcaption".split())
INLINE = frozenset("br b i em strong span a code sub sup img".split())
ASIDE = RAW | frozenset("nav footer aside select button dialog menu head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words that, with neutral ones beside them, make a class, id or role name that marks boilerplate: a name with any other word in it does not.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies share sharing social related recommended newsletter subscribe signup login search pagination pager widget toolbar skip complementary contentinfo".split())
#: Words that set an article aside, and those that may stand beside words of either kind in a name.
SET_ASIDE = frozenset("comment comments disqus reply replies related recommended sidebar complementary ad ads advert adverts advertisement".split())
NEUTRAL = frozenset("list lists item items post posts article articles entry section area box block card thread body content container wrapper wrap user reader teaser story stories reading site page top bottom left right main primary secondary global inner outer bar link links button buttons icon icons group row col column unit slot panel module".split())
#: What an element with an optional end tag closes when it begins.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

#: Sketches of a text, and distinct texts for each different sketch, at most, among those that hold a template subtree.
SKETCHES, UNLIKE = 4, 3

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_MARKED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD, _DIGITS = re.compile(r"[A-Za-z]+"), re.compile(r"[0-9]+")
#: Bytes of template rows that are sent to every task at most, and of one row, about.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 128


class Page:
    """A page as elements in document order: tag, attributes, parent, and the span of source each covers."""

    def __init__(self, html: str):
        self.html, self._with_heading = html, None
        self.tag, self.attrs, self.parent, self.begin, self.end = ["#page"], [""], [-1], [0], [len(html)]
        self.texts: list[tuple[int, int, int]] = []  # element, begin and end of a run of text
        self.breaks: list[tuple[int, int, int]] = []  # place, element and end of void elements
        stack, at, n, self._open = [0], 0, len(html), Counter()
        while at < n:
            m = _TAG.search(html, at)
            if m is None:
                break
            if m.start() > at:
                self.texts.append((stack[-1], at, m.start()))
            at = m.end()
            name = m.group(2) or m.group(5)
            if name is None:
                continue
            name, closing, attrs = name.lower(), m.group(1) or m.group(4), m.group(3) or m.group(6) or ""
            if closing:
                self._close(stack, name, at, m.start())
                continue
            self._imply(stack, name, m.start())
            if name in VOID:
                self.breaks.append((m.start(), stack[-1], at))
                continue
            self.tag.append(name)
            self.attrs.append(attrs)
            self.parent.append(stack[-1])
            self.begin.append(m.start())
            self.end.append(n)
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
                stop = close.start() if close else n
                self.texts.append((len(self.tag) - 1, at, stop))
                at = html.find(">", stop) + 1 if close else n
                at = at or n
                self.end[-1] = at
            elif not attrs.endswith("/"):
                stack.append(len(self.tag) - 1)
                self._open[name] += 1
            else:
                self.end[-1] = at
        if at < n and html[at:].strip() and not html.startswith("<", at):
            self.texts.append((stack[-1], at, n))

    def _pop(self, stack: list[int], i: int) -> None:
        for e in stack[i:]:
            self._open[self.tag[e]] -= 1
        del stack[i:]

    def _close(self, stack: list[int], name: str, end: int, begin: int) -> None:
        for i in range(len(stack) - 1, 0, -1) if self._open[name] > 0 else ():
            if self.tag[stack[i]] == name:
                for e in stack[i + 1 :]:
                    self.end[e] = begin
                self.end[stack[i]] = end
                self._pop(stack, i)
                return

    def _imply(self, stack: list[int], name: str, at: int) -> None:
        closed = {"p"} if name in CLOSES_P else SIBLINGS.get(name, set())
        if not any(self._open[x] > 0 for x in closed):
            return
        scope = SCOPES.get(name, BLOCK - {"p"})
        for i in range(len(stack) - 1, 0, -1):
            own = self.tag[stack[i]]
            if own in closed:
                for e in stack[i:]:
                    self.end[e] = at
                self._pop(stack, i)
                return
            if own in scope:
                return

    @cached_property
    def roots(self) -> tuple[list[int], list[int]]:
        """The content roots, and for each element the root it lies in or is, else 0.

        Roots are the articles and mains that lie in no other one and are not set aside as comments, related pages
        or sidebars, nor lie in what is.  A page may have none: then its body is its content.
        """
        roots, within, aside = [], [0] * len(self.tag), [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            p, tag = self.parent[e], self.tag[e]
            within[e] = within[p]
            aside[e] = aside[p] or tag in ASIDE or tag not in ("html", "body") and _named(self.attrs[e], SET_ASIDE)
            if not within[e] and not aside[e] and (tag in ("article", "main") or _main(self.attrs[e])):
                within[e] = e
                roots.append(e)
        return roots, within

    def body(self) -> int:
        return next((e for e, t in enumerate(self.tag) if t == "body"), 0)

    def _above(self, roots: list[int]) -> set[int]:
        """The content roots, the body, and what encloses them."""
        above = {0}
        for e in (*roots, self.body()):
            while e not in above:
                above.add(e)
                e = self.parent[e]
        return above

    def _kept(self, drop: set[int], outside: bool, names: bool = True) -> list[bool]:
        """Of each element, whether its text is main text: that of the roots, and with ``outside`` of the whole body.

        Without ``names`` nothing goes by its tag or name but markup that holds no text.
        """
        roots, within = self.roots
        base, above = self.body(), self._above(roots)
        outside = outside or not roots
        kept = [outside and base == 0] + [False] * (len(self.tag) - 1)
        for e in range(1, len(self.tag)):
            p = self.parent[e]
            if e in above:
                kept[e] = within[e] == e or outside and (e == base or kept[p])
            else:
                kept[e] = kept[p] and e not in drop and not (self._boilerplate(e, within[e]) if names else self.tag[e] in RAW or self.tag[e] == "head")
        return kept

    @cached_property
    def _whole(self) -> list[bool]:
        """Of each element, whether its text would be main text if nothing were template."""
        return self._kept(set(), True)

    def subtrees(self) -> dict[int, int]:
        """Hashes of the elements that may be template: all but roots, what encloses them, and content inside them.

        Inline markup within a paragraph or other content is part of it, and so are the elements of boilerplate.
        """
        roots, within = self.roots
        above, kept, hashes = self._above(roots), self._whole, self.hashes
        out = {}
        for e in range(1, len(self.tag)):
            p, tag = self.parent[e], self.tag[e]
            if e in above or tag == "head" or self.tag[p] == "head":
                continue
            if tag in CONTENT and (not kept[e] or self.tag[within[e]] in ("article", "main") or tag in INLINE and self.tag[p] in CONTENT):
                continue
            out[e] = hashes[e]
        return out

    def slots(self) -> dict[int, int]:
        """Skeletons of the elements outside the content roots of a page that has any; content elements have none."""
        roots, within = self.roots
        above, skeletons = self._above(roots), self.skeletons
        able = range(1, len(self.tag)) if roots else ()
        return {e: skeletons[e] for e in able if not within[e] and e not in above and self.tag[e] not in CONTENT | RAW and "head" not in (self.tag[e], self.tag[self.parent[e]])}

    def named(self) -> set[int]:
        """Elements that are boilerplate by their tag or name and lie in no such one."""
        _, within = self.roots
        kept = self._whole
        return {e for e in range(1, len(self.tag)) if not kept[e] and kept[self.parent[e]] and self.tag[e] not in RAW and self.tag[e] != "head"}

    @cached_property
    def skeletons(self) -> list[int]:
        """A hash of each element without its text: tag, names without digits, and children's skeletons, repetitions of one collapsed."""
        children: list[list[int]] = [[] for _ in self.tag]
        out = [0] * len(self.tag)
        for e in range(len(self.tag) - 1, -1, -1):  # children come after their parents, later ones first here
            own = [x for k, x in enumerate(children[e]) if k == 0 or children[e][k - 1] != x]
            names = sorted({_DIGITS.sub("", n) for m in _MARKED.finditer(self.attrs[e]) for n in _names(m)}) if "=" in self.attrs[e] else []
            out[e] = _hash("\0".join(["#slot", self.tag[e], *names, *map(str, own)]))
            if self.tag[e] not in INLINE | RAW:
                children[self.parent[e]].append(out[e])
        return out

    @cached_property
    def hashes(self) -> list[int]:
        """A hash of each element's subtree, from the leaves up: its tag, its own runs of text, and its children's hashes."""
        parts: list[list] = [[] for _ in self.tag]
        runs = [(b, e, self.html[b:t]) for e, b, t in self.texts] + [(b, e, self.html[b:t]) for b, e, t in self.breaks]
        runs += [(self.begin[e], self.parent[e], e) for e in range(1, len(self.tag))]
        for _, e, part in sorted(runs, key=lambda r: r[0]):
            parts[e].append(part)
        out = [0] * len(self.tag)
        for e in range(len(self.tag) - 1, -1, -1):  # children come after their parents
            own = (f"#{out[x]}" if isinstance(x, int) else " ".join(x.split()) for x in parts[e])
            out[e] = _hash("\0".join([self.tag[e], " ".join(self.attrs[e].split()), *(x for x in own if x)]))
        return out

    def contents(self, found: dict[int, int]) -> tuple[tuple, dict[int, tuple]]:
        """A hash and sketches of the page's text, and for each of the subtrees found those of the text it is counted by.

        That is the root's text inside an article or main, so that copies of an article count as one page whatever
        surrounds them, and else the page's: the body's text without boilerplate.
        """
        _, within = self.roots
        kept = self._whole
        runs: dict[int, list[str]] = {}
        for e, b, t in self.texts:
            if kept[e]:
                runs.setdefault(within[e], []).append(self.html[b:t])
        texts = {r: " ".join(" ".join(x).split()) for r, x in runs.items()}
        page = _hash("\n".join(texts[r] for r in sorted(texts) if texts[r]) or self.html)
        page = page, (page,)
        own = {r: (_hash(x), _sketch(x)) for r, x in texts.items() if r and x}
        return page, {e: own.get(within[e], page) for e in found}

    def text(self, template: set[int], outside: bool = False, names: bool = True) -> str:
        """The main text without template subtrees and boilerplate.

        ``outside`` tells that ``template`` is what recurs on the page's host, which then decides what goes of the
        text outside the content roots.  A page read by itself has no host to tell, and keeps its roots only.  Without
        ``names`` the template alone decides, by slots too.
        """
        return self.without(self.found(template, set() if names else template)[0], outside, names)

    def found(self, subtrees: set[int], slots: set[int]) -> tuple[set[int], int]:
        """The elements that these subtrees and slots are, and how many different ones of them the page has."""
        of = {e: h for e, h in self.subtrees().items() if h in subtrees} if subtrees else {}
        more = {e: h for e, h in self.slots().items() if h in slots} if slots else {}
        return of.keys() | more.keys(), len({*of.values(), *more.values()})

    def without(self, drop: set[int], outside: bool, names: bool = True) -> str:
        """``text`` without these elements."""
        kept = self._kept(drop, outside, names)
        blocks: list[tuple[int, list[str]]] = []
        # a block's text ends where another block begins or ends, so runs join while nothing but inline markup lies between
        edges = sorted({b for e in range(1, len(self.tag)) if self.tag[e] in BLOCK for b in (self.begin[e], self.end[e])})
        marks = [(at, None) for at, _, _ in self.breaks] + [((b), (e, b, t)) for e, b, t in self.texts]
        marks.sort(key=lambda m: m[0])
        k = 0
        for at, run in marks:
            while k < len(edges) and edges[k] <= at:
                blocks.append((edges[k], []))
                k += 1
            if not blocks:
                blocks.append((0, []))
            if run is None:
                blocks[-1][1].append(" ")
            elif kept[run[0]]:
                blocks[-1][1].append(self.html[run[1] : run[2]])
        lines = (" ".join(unescape("".join(parts)).split()) for _, parts in blocks)
        return "\n".join(x for x in lines if x)

    def _boilerplate(self, e: int, root: int) -> bool:
        tag = self.tag[e]
        if tag == "header" and self.tag[root] in ("article", "main"):
            return e not in self._headed()
        return tag in BOILERPLATE or tag not in CONTENT and _named(self.attrs[e], MARKS)

    def _headed(self) -> set[int]:
        """Elements that hold a heading."""
        if self._with_heading is None:
            self._with_heading = set()
            for e, tag in enumerate(self.tag):
                e = self.parent[e] if tag in HEADINGS else -1
                while e >= 0 and e not in self._with_heading:
                    self._with_heading.add(e)
                    e = self.parent[e]
        return self._with_heading


def _hash(source: str) -> int:
    return xxhash.xxh3_64_intdigest(source.encode("utf-8", "surrogatepass")) - (1 << 63)


def _sketch(text: str) -> tuple[int, ...]:
    """Least hashes, by several functions, of the text's runs of five words: texts that share most runs mostly share each."""
    w = words(pa.array([text], pa.large_string()))
    if not len(w.hash):
        return (0,) * SKETCHES
    h = rolling(w.hash, min(5, len(w.hash)))
    return tuple(int(mix(h + U64(k)).min().view(np.int64)) for k in range(SKETCHES))


def _main(attrs: str) -> bool:
    """Whether the role is main."""
    return "=" in attrs and any(m.group(0)[:4].lower() == "role" and "main" in _names(m) for m in _MARKED.finditer(attrs))


def _names(m: re.Match) -> list[str]:
    return (m.group(1) or m.group(2) or m.group(3) or "").lower().split()


def _named(attrs: str, marks: frozenset[str]) -> bool:
    """Whether one whole class, id or role name is made of such marks and neutral words alone."""
    if "=" not in attrs:
        return False
    for m in _MARKED.finditer(attrs):
        for name in _names(m):
            words = set(_WORD.findall(name))
            if words & marks and words <= marks | NEUTRAL:
                return True
    return False


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))


class TemplateRemoval:
    """Main text of pages; a subtree is template from ``min_pages`` pages and ``min_share`` of its host's pages on.

    ``slots`` lets the host's template alone make the text, with slots from ``slot_share`` of the host's pages on.
    """

    def __init__(self, min_pages: int = 5, min_share: float = 0.02, slots: bool = False, slot_share: float = 0.25, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"):
        if min_pages < 2 or not 0 <= min_share <= 1 or not 0 <= slot_share <= 1:
            raise ValueError("min_pages is at least 2, min_share and slot_share lie in [0, 1]")
        self.broadcast_bytes, self.slots, self.slot_share, self.min_pages, self.min_share, self.id_col, self.url_col, self.html_col = broadcast_bytes, slots, slot_share, min_pages, min_share, id_col, url_col, html_col

    def _keyed(self, pages: DataFrame) -> DataFrame:
        own = pages.select(F.col(self.id_col).alias("page_id"), F.col(self.url_col).alias("url"), F.col(self.html_col).alias("html"))
        return own.withColumn("_key", F.xxhash64("page_id", "url", "html")).withColumn("_host", host_of("url"))

    def template(self, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(_key, _host, _content, _sketches, hash, kind) of every candidate, and the (_host, hash, n, kind) that are template.

        ``_content`` is the text that a subtree is counted by; a row without a hash has that of the page.  Kinds:
        ``subtree`` and ``slot``, which recur, and ``name``, whose row also tells the ``slot`` that might decide first.
        """
        slots = self.slots

        def subtrees(batches):
            for b in batches:
                keys, hosts, contents, sketches, hashes, kinds, places = [], [], [], [], [], [], []
                for key, host, html in zip(b.column("_key").to_pylist(), b.column("_host").to_pylist(), b.column("html").to_pylist(), strict=True):
                    page = Page(html or "")
                    found = page.subtrees()
                    whole, by = page.contents(found)
                    own = [(whole, None, "page", None), *{(by[e], h, "subtree", None) for e, h in found.items()}]
                    if slots:
                        of = page.slots()
                        own += {(whole, h, "slot", None) for h in of.values()}
                        own += {(by[e], found[e], "name", of.get(e)) for e in page.named() & found.keys()}
                    keys += [key] * len(own)
                    hosts += [host] * len(own)
                    contents += [c for (c, _), *_ in own]
                    sketches += [k for (_, k), *_ in own]
                    hashes += [h for _, h, *_ in own]
                    kinds += [x for _, _, x, _ in own]
                    places += [p for *_, p in own]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array(hashes, pa.int64()), pa.array(kinds, pa.string()), pa.array(places, pa.int64())], names=["_key", "_host", "_content", "_sketches", "hash", "kind", "slot"])

        keyed = self._keyed(pages)
        found = cut(keyed.select("_key", "_host", "html").mapInArrow(subtrees, "_key long, _host string, _content long, _sketches array<long>, hash long, kind string, slot long"), "subtrees")
        distinct = found.where("kind <> 'name'").select("_host", "_content", "_sketches", "hash", "kind").distinct()
        kinds = distinct.where("hash IS NOT NULL").select("_host", "hash", "kind", F.posexplode("_sketches").alias("k", "sketch")).groupBy("_host", "hash", "kind", "k", "sketch").agg(F.count(F.lit(1)).alias("n"))
        kinds = kinds.groupBy("_host", "hash", "kind", "k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
        counted = kinds.groupBy("_host", "hash", "kind").agg(F.max("n").alias("n"), F.max("kinds").alias("kinds")).where((F.col("kinds") >= self.min_pages) & (UNLIKE * F.col("kinds") >= F.col("n")))
        hosts = distinct.where("hash IS NULL").groupBy("_host").agg(F.count(F.lit(1)).alias("pages"))
        least = F.when(F.col("kind") == "slot", F.lit(self.slot_share)).otherwise(F.lit(self.min_share))
        recurs = cut(counted.join(hosts, "_host").where(F.col("n") >= least * F.col("pages")).select("_host", "hash", "n", "kind"), "template")
        if not slots:
            return found, recurs
        named = found.where("kind = 'name'").groupBy("_host", "hash", "slot").agg(F.count(F.lit(1)).alias("n"))
        seen = recurs.select("_host", "hash").distinct()
        named = named.join(seen.withColumnRenamed("hash", "slot"), ["_host", "slot"], "left_anti").join(seen, ["_host", "hash"], "left_anti")
        names = named.groupBy("_host", "hash").agg(F.sum("n").alias("n")).withColumn("kind", F.lit("name"))
        return found, cut(recurs.unionByName(names), "template")

    def transform(self, pages: DataFrame) -> DataFrame:
        """(page_id, url, text, n_chars, n_template) of every row; n_template is the number of template subtrees on the page."""
        found, template = self.template(pages)
        if template.count() * ROW_BYTES <= self.broadcast_bytes:
            return self._by_host(pages, template)
        slots, known = self.slots, template.select("_host", "hash").distinct()
        of_page = found.where("hash IS NOT NULL").join(known, ["_host", "hash"]).groupBy("_key").agg(F.collect_set("hash").alias("_drop"))

        def extract(batches):
            for b in batches:
                drop = [set(x or ()) for x in b.column("_drop").to_pylist()]
                texts = [Page(h).text(d, outside=True, names=not slots) if h else "" for h, d in zip(b.column("html").to_pylist(), drop, strict=True)]
                sizes = [pa.array([len(x) for x in v], pa.int64()) for v in (texts, drop)]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), *sizes], names=["page_id", "url", "text", "n_chars", "n_template"])

        joined = self._keyed(pages).join(of_page, "_key", "left").select("page_id", "url", "html", "_drop")
        kind = joined.schema["page_id"].dataType.simpleString()
        return joined.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long, n_template long")

    def _by_host(self, pages: DataFrame, template: DataFrame) -> DataFrame:
        """``transform`` with the template in every task, so that no page moves; for one of at most ``broadcast_bytes``."""
        slot = F.col("kind") == "slot"
        rows = template.groupBy("_host").agg(F.collect_set(F.when(~slot, F.col("hash"))).alias("subtrees"), F.collect_set(F.when(slot, F.col("hash"))).alias("slots")).collect()
        held, names = pages.sparkSession.sparkContext.broadcast({r["_host"]: (set(r.subtrees), set(r.slots)) for r in rows}), not self.slots

        def extract(batches):
            for b in batches:
                texts, found = [], []
                for host, html in zip(b.column("_host").to_pylist(), b.column("html").to_pylist(), strict=True):
                    page = Page(html or "")
                    drop, n = page.found(*held.value.get(host, (set(), set())))
                    texts.append(page.without(drop, True, names) if html else "")
                    found.append(n)
                sizes = [pa.array(v, pa.int64()) for v in ([len(x) for x in texts], found)]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), *sizes], names=["page_id", "url", "text", "n_chars", "n_template"])

        own = self._keyed(pages).select("page_id", "url", "html", "_host")
        return own.mapInArrow(extract, f"page_id {own.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, n_template long")
