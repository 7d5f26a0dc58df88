"""Main text of web pages by a site style tree.

The DOMs of a host are merged: an element is named by its path of tags and classes and, for classes that a build tool makes
anew for every page, by its path of tags alone. For each path the entropy over the host's pages of its presentation (the
sequence of its child elements) and of its content is computed, relative to the entropy of all pages differing; hosts with
few pages lean on the tree of all hosts together. Branches of low composite importance are the site's template and are
removed from each page. The tree also learns, per path, how often its text is links, and how often it stands in a row of
like elements behind the main branch of the page, as readers' comments and teasers do: such branches go as well.

What HTML itself marks goes in any case: scripts, forms, navigation, hidden elements, articles inside an article; where a
page has an article, all that stands beside it (but an h1 before it). Names of classes are a hint for what varies from page to
page and has no shape of its own, such as an advert.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.llm.common import stage

#: Importance below which a branch is template, inside and outside of an article; pages that the tree of all hosts weighs.
LOW, LOW_IN_ARTICLE, PRIOR_PAGES = 0.7, 0.1, 200
#: Weight of what lies below an element in its composite importance, for each child.
GAMMA = 0.9
SALTS = 16
# Fixed values of the HTML standard: raw-text and void elements, inline elements, and elements that an opening tag closes.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "body": {"head"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
ENDS_P = set("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp".split())
BREAKS = ENDS_P | set("body caption col colgroup head html legend optgroup option tbody td tfoot th thead tr".split())
MUTE = {"audio", "button", "canvas", "object", "select", "svg", "template", "video"}  # no content, but no break either
NO_CONTENT = set("head script style noscript template iframe object svg canvas audio video nav footer aside form button select input textarea dialog menu".split())
NAMED = set("ad ads advert adverts advertisement banner cookie cookies consent notice notices sidebar comment comments reply replies respond menu nav navbar navigation breadcrumb breadcrumbs footer masthead promo sponsored sponsor share sharing social related recommended newsletter subscribe signup popup modal login search widget disclaimer".split())

ARTICLE = ("article", "main")
# What a block is: content, no content by the name of an element around it, no content by its kind.
CONTENT, BY_NAME, BY_KIND = 0, 1, 2
#: no content because the page has an article elsewhere
BESIDE = 3
#: Pages of a host on which a path with classes must stand to be judged by itself; the share of them that decides on links
#: and rows of like elements, the least pages for that, and the share of a block that links make up.
OWN_PAGES, MOST, FEW, LINKS = 3, 0.6, 3, 0.6
#: Elements that readers' comments and teasers stand in, in a row.
ROWS = {"div", "li", "section", "article", "dd", "tr", "blockquote"}
#: Kinds of what the tree counts: presentation, content, links, place in a row behind the main branch.
STYLE, TEXT, LINKED, LATE = 0, 1, 2, 3
#: Verdicts of all hosts together are broadcast up to so many bytes; beyond, pages are joined with them.
BROADCAST_BYTES = 32_000_000
#: Characters of an element's path; deeper elements begin a new root of the tree, named by a hash of the path so far.
LONGEST_PATH = 2_000

_start = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_stop = re.compile("[>\"']")
_attr = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_digits = re.compile(r"\d+")
_in_article = re.compile(r"/(article|main)\b")
_classes = re.compile(r"[.#][^/]*")


def _name(tag: str, attrs: str) -> tuple[str, bool, int]:
    """(tag, classes and id for the style tree, digits as 0; whether the element is no content by its kind; by its name: 2 if
    a whole class or id says so, 1 if a word in one does, which is a hint only).

    Attributes are read one after another under their full names. html, body, main and article are content whatever theirs.
    """
    found, words, out, seen = "", [], tag in NO_CONTENT, set()
    for m in _attr.finditer(attrs) if attrs and not attrs.isspace() else ():
        key = m[1].lower()
        if key not in ("class", "id", "role", "hidden") or key in seen:
            continue
        seen.add(key)
        value = (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            words += value.split()
            found += ("." if key == "class" else "#") + _digits.sub("0", ".".join(value.split()).replace("/", "_"))
        elif key == "hidden" or value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog"):
            out = True
    by_name = 0
    if tag not in ("html", "body", *ARTICLE):
        by_name = 2 if any(w in NAMED for w in words) else int(any(p in NAMED for w in words for p in re.split("[-_]", w)))
    return tag + found, out, by_name


def bare(path: str) -> str:
    """A path of tags alone."""
    return "~" + _classes.sub("", path)


class Element:
    """What is known of an open element. named: numbers of the named elements around; article: the outermost article."""

    __slots__ = ("tag", "path", "out", "named", "number", "parent", "article")

    def __init__(self, tag="", path="", out=False, named=(), number=0, parent=0, article=0):
        self.tag, self.path, self.out, self.named, self.number, self.parent, self.article = tag, path, out, named, number, parent, article


NOWHERE = Element()


class Page:
    """The blocks (path, text, what it is) of a page in order, and the child elements of each path that are content.

    An element that holds every article or main of the page is content whatever its name; so is one that only a hint
    speaks against, where the page has no article and most of its text stands in it. Both are known once the page is read.
    """

    def __init__(self, html: str):
        self.found: list[tuple[Element, str, float]] = []  # where a block stands, its text, the share of links
        self.held: list[tuple[Element, str, Element]] = []  # element, name of a child, the child
        self.stack: list[Element] = []
        self.numbers = self.named = 0
        self.hints: set[int] = set()
        self.scopes: list[tuple[int, ...]] = []  # the named elements around each article or main
        self.articles: dict[int, str] = {}  # bare paths of articles that are in no other
        self.pieces: list[str] = []
        self.linked, self.in_link = 0, False
        self.open: Counter = Counter()  # how often each tag is in the stack
        self.muted: list[tuple[int, list[str]]] = []  # place in the stack and pieces of the block around a mute element
        at, last = 0, {c: html.rfind(c) for c in ">\"'"}
        while at < len(html):
            begin = html.find("<", at)
            if begin < 0:
                self._text(html[at:])
                break
            self._text(html[at:begin])
            m = _start.match(html, begin + 1)
            if m is None:
                at = self._skip(html, begin, last)
                continue
            end = self._tag_end(html, m.end(), last)
            if end < 0:
                break  # a tag that does not end, ends the page
            tag, at = m[2].lower(), end + 1
            if m[1]:
                self._close(tag)
            elif tag in RAW:
                if not html[m.end() : end].rstrip().endswith("/"):
                    found = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                    at = found.end() if found else len(html)
            else:
                self._open(tag, html[m.end() : end])
        self._cut(0)
        self._flush()
        cleared = set.intersection(*map(set, self.scopes)) if self.scopes else self._hints_that_hold_most()
        # the first article that says something, and those at the same place of other branches
        first = next((self.articles[e.article] for e, *_ in self.found if e.article and not e.out and cleared.issuperset(e.named)), None)
        begun = False

        def what(e: Element) -> int:
            if e.out:
                return BY_KIND
            if not cleared.issuperset(e.named):
                return BY_NAME
            if first is None or (e.article and self.articles[e.article] == first) or (e.tag == "h1" and not begun):
                return CONTENT
            return BESIDE

        self.blocks, self.links = [], []
        for e, text, linked in self.found:
            kind = what(e)
            begun = begun or bool(e.article and kind == CONTENT)
            self.blocks.append((e.path, text, kind))
            if kind == CONTENT:
                self.links.append((e.path, linked >= LINKS))
        self.children: dict[str, list[str]] = {}
        for e, name, child in self.held:
            if what(child) == CONTENT:
                self.children.setdefault(e.path, []).append(name)
        self.late = [False] * len(self.found) if first is not None else self._late(what)

    def _hints_that_hold_most(self) -> set[int]:
        sizes: Counter = Counter()
        total = 0
        for e, text, _ in self.found:
            if not e.out and self.hints.issuperset(e.named):
                total += len(text)
                sizes.update(dict.fromkeys(e.named, len(text)))
        return {n for n, size in sizes.items() if 2 * size > total}

    def _late(self, what) -> list[bool]:
        """Of each block, whether it stands in a row of like elements behind the main branch: the container whose own blocks
        have the most text."""
        none = [False] * len(self.found)
        sizes, ends = Counter(), {}
        for i, (e, text, _) in enumerate(self.found):
            holder = e.number if e.tag in ROWS or e.tag in ("body", "html", "main", "") else e.parent
            if what(e) == CONTENT:
                sizes[holder] += len(text)
                ends[holder] = i
        main = max(sizes, key=lambda n: (sizes[n], -n), default=0)
        if not main:
            return none
        children = {child.number: child for _, _, child in self.held}
        inside = {main: True, 0: False}

        def walk(number: int, known: dict[int, bool], own=lambda n: False) -> list[int]:
            """Numbers from an element up that were not known, which they are afterwards: true from where own is."""
            chain = []
            while number not in known:
                chain.append(number)
                number = children[number].parent
            state = known[number]
            for n in reversed(chain):
                state = state or own(n)
                known[n] = state
            return chain

        rows: dict[tuple[int, str], list[int]] = {}
        for i in range(ends[main] + 1, len(self.found)):
            for n in walk(self.found[i][0].number, inside):
                if not inside[n] and children[n].tag in ROWS:
                    rows.setdefault((children[n].parent, _classes.sub("", children[n].path.rsplit("/", 1)[-1])), []).append(n)
        like = {n for some in rows.values() if len(some) > 1 for n in some}
        late = {0: False}
        for e, *_ in self.found:
            walk(e.number, late, like.__contains__)
        return [late[e.number] for e, *_ in self.found]

    def _skip(self, html: str, begin: int, last: dict[str, int]) -> int:
        """Past a comment, a declaration or a lone `<`, which is text."""
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            return len(html) if end < 0 else end + 3
        if html.startswith(("<!", "<?", "</"), begin) and begin < last[">"]:
            return html.find(">", begin) + 1
        self._text("<")
        return begin + 1

    def _text(self, text: str) -> None:
        self.pieces.append(text)
        if self.in_link:
            self.linked += len(text)

    @staticmethod
    def _tag_end(html: str, at: int, last: dict[str, int]) -> int:
        """The place of the `>` that ends a tag; one inside a quoted value does not. -1 if there is none."""
        while at <= last[">"]:
            m = _stop.search(html, at)
            if m is None or m[0] == ">":
                break
            before = m.start() - 1
            while before > at and html[before].isspace():
                before -= 1
            quoted = html[before] == "=" and m.start() < last[m[0]]
            at = html.index(m[0], m.end()) + 1 if quoted else m.end()
        return html.find(">", at)

    def _cut(self, at: int) -> None:
        """Close the elements from a place in the stack on. Text inside a mute one is no content; the block around it goes on."""
        self._flush()
        while self.muted and self.muted[-1][0] >= at:
            place, around = self.muted.pop()
            self._drop(place)
            self.pieces = around
            if place > at:
                self._flush()
        self._drop(at)

    def _drop(self, at: int) -> None:
        for e in self.stack[at:]:
            self.open[e.tag] -= 1
        del self.stack[at:]

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join(unescape("".join(self.pieces)).split())
            if text:
                self.found.append((self.stack[-1] if self.stack else NOWHERE, text, self.linked / len(text)))
            self.pieces, self.linked = [], 0

    def _open(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.pieces.append("\n")
            return
        name, out, by_name = _name(tag, attrs)
        if tag == "a":
            self.in_link = True
        if (tag in INLINE or (tag not in BREAKS and self.stack and self.stack[-1].tag == "p")) and not (out or by_name == 2):
            return
        mute = tag in MUTE
        if not mute:
            self._flush()
        closes = any(self.open[t] for t in CLOSES.get(tag, ())) or (tag in ENDS_P and self.open["p"])
        for i in range(len(self.stack) - 1, -1, -1) if closes else ():
            open_tag = self.stack[i].tag
            if open_tag in CLOSES.get(tag, ()) or (open_tag == "p" and tag in ENDS_P):
                self._cut(i)
                break
            if open_tag in SCOPES.get(tag, ()) or open_tag in ("table", "td", "th", "button", "object"):
                break
        around = self.stack[-1] if self.stack else NOWHERE
        named, path, article = around.named, around.path, around.article
        if (tag == "header" and not any(self.open[t] for t in ARTICLE)) or (tag == "article" and article):
            out = True
        if by_name:
            self.named += 1
            named = (*named, self.named)
            if by_name == 1:
                self.hints.add(self.named)
        out = out or around.out
        if tag in ARTICLE and not out:
            self.scopes.append(named)
        self.numbers += 1
        if len(path) > LONGEST_PATH:
            inside = "/article" if _in_article.search(path) else ""
            path = f"{inside}/{hashlib.blake2b(path.encode(), digest_size=8).hexdigest()}"
        new = Element(tag, f"{path}/{name}", out, named, self.numbers, around.number, article)
        if tag == "article" and not article:
            new.article = self.numbers
            self.articles[self.numbers] = bare(new.path)
        self.held.append((around, name, new))
        if mute:
            self.muted.append((len(self.stack), self.pieces))
            self.pieces = []
        if tag not in VOID:
            self.stack.append(new)
            self.open[tag] += 1

    def _close(self, tag: str) -> None:
        if tag == "br":
            self.pieces.append("\n")
            return
        if tag == "a":
            self.in_link = False
        for i in range(len(self.stack) - 1, -1, -1) if self.open[tag] else ():
            if self.stack[i].tag == tag:
                self._cut(i)
                return
        if tag == "p":
            self._flush()

    def features(self) -> list[tuple[str, int, str]]:
        """(path, kind, feature) under the path with classes and the one without. What is no content shows none: it goes in
        any case and must not make the elements that hold it important."""
        texts: dict[str, list[str]] = {}
        behind: dict[str, bool] = {}
        for (path, text, out), late in zip(self.blocks, self.late, strict=True):
            if not out:
                texts.setdefault(path, []).append(text)
                behind[path] = behind.get(path, True) and late
        links: dict[str, list[bool]] = {}
        for path, linked in self.links:
            links.setdefault(path, []).append(linked)
        out = []
        for fold in (lambda p: p, bare):
            styles, words, linked, late = {}, {}, {}, {}
            for path, names in self.children.items():
                styles.setdefault(fold(path), []).extend(names if fold is not bare else [_classes.sub("", n) for n in names])
            for path, t in texts.items():
                words.setdefault(fold(path), []).extend(t)
                linked.setdefault(fold(path), []).extend(links[path])
                late[fold(path)] = late.get(fold(path), True) and behind[path]
            out += [(path, STYLE, " ".join(x for i, x in enumerate(names) if i == 0 or names[i - 1] != x)) for path, names in styles.items()]
            out += [(path, TEXT, "\n".join(t)) for path, t in words.items()]
            out += [(path, LINKED, str(2 * sum(x) > len(x))) for path, x in linked.items()] + [(path, LATE, str(x)) for path, x in late.items()]
        return out


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return m[1].lower() if m else ""


def _feature_rows(pages: DataFrame) -> DataFrame:
    """(host, path, kind, feature, pages): pages of a host that show a feature; each task counts its own first."""

    def count(batches):
        seen: dict[tuple[str, str, int, int], int] = {}
        for batch in batches:
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                host = host_of(url)
                for path, kind, feature in Page(html or "").features():
                    told = feature == "True" if kind in (LINKED, LATE) else int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little", signed=True)
                    key = (host, path, kind, int(told))
                    seen[key] = seen.get(key, 0) + 1
                if len(seen) > 100_000:
                    yield out(seen)
                    seen = {}
        yield out(seen)

    def out(seen):
        keys = list(zip(*seen, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.string()), pa.array(keys[2], pa.int32()), pa.array(keys[3], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["host", "path", "kind", "feature", "pages"])

    return pages.mapInArrow(count, "host string, path string, kind int, feature long, pages long")


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, kind, pages, importance): relative entropy of each element's presentation and content, blended with that
    over all hosts by PRIOR_PAGES; for links and rows, the share of pages that show them. Paths with classes that stand on
    fewer than OWN_PAGES pages of a host are left to their path without: so a host's tree grows with its templates."""
    rows = stage(_feature_rows(pages).groupBy("host", "path", "kind", "feature").agg(F.sum("pages").alias("pages")), "html-features")
    sizes = rows.groupBy("host", "path", "kind").agg(F.sum("pages").alias("all")).where(F.col("path").startswith("~") | (F.col("all") >= OWN_PAGES))
    known = sizes.select("host", "path", "kind")
    shapes = F.col("kind").isin(STYLE, TEXT)

    def entropy(grouped: DataFrame, keys: list[str]) -> DataFrame:
        sums = grouped.groupBy(*keys).agg(F.sum("pages").alias("pages"), F.sum(F.col("pages") * F.log("pages")).alias("plogp"))
        relative = (F.log("pages") - F.col("plogp") / F.col("pages")) / F.log("pages")
        return sums.select(*keys, "pages", F.when(F.col("pages") > 1, relative).otherwise(1.0).alias("importance"))

    own = rows.join(known, ["host", "path", "kind"])
    per_host = entropy(own.where(shapes), ["host", "path", "kind"])
    overall = entropy(rows.where(shapes).groupBy("path", "kind", "feature").agg(F.sum("pages").alias("pages")), ["path", "kind"])
    overall = overall.select("path", "kind", F.col("importance").alias("prior"), F.least("pages", F.lit(PRIOR_PAGES)).alias("weight"))
    blend = (F.col("pages") * F.col("importance") + F.col("weight") * F.col("prior")) / (F.col("pages") + F.col("weight"))
    varied = per_host.join(overall, ["path", "kind"]).select("host", "path", "kind", "pages", blend.alias("importance"))
    told = own.where(~shapes).groupBy("host", "path", "kind").agg(F.sum("pages").alias("pages"), (F.sum(F.when(F.col("feature") == 1, F.col("pages")).otherwise(0)) / F.sum("pages")).alias("importance"))
    return varied.unionByName(told)


def composite_importance(content: dict[str, float], style: dict[str, float]) -> dict[str, float]:
    """Of each path of one tree, from the importance of texts and of presentation: an element is as important as its own
    variety in presentation, weighed down the more children it has, and the best of what it holds."""
    below: dict[str, list[str]] = {}
    for p in {*content, *style}:
        if "/" in p:
            below.setdefault(p.rsplit("/", 1)[0], []).append(p)
    out: dict[str, float] = {}
    for p in sorted({*content, *style, *below}, key=lambda p: -p.count("/")):
        parts = [out[c] for c in below.get(p, ())] + ([content[p]] if p in content else [])
        most, g = max(parts, default=0.0), GAMMA ** len(parts)
        out[p] = max(most, (1 - g) * style.get(p, 0.0) + g * most) if parts else style.get(p, 0.0)
    return out


def low_branches(tree: DataFrame) -> DataFrame:
    """(host, paths, others): of each host, the paths without classes that are template, and the paths with classes whose
    verdict is not that of their path without. Text that stands directly in an element whose composite importance is high
    stays, even if it repeats.

    The group of a host holds a few rows for each path of its templates, whatever the number of its pages.
    """

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        by = {k: {} for k in (STYLE, TEXT, LINKED, LATE)}
        for p, k, i, n in zip(pdf.path, pdf.kind, pdf.importance, pdf.pages, strict=True):
            by[k][p] = (i, n)
        composite = composite_importance({p: i for p, (i, _) in by[TEXT].items()}, {p: i for p, (i, _) in by[STYLE].items()})

        def low(p: str) -> bool:
            inside = _in_article.search(p) is not None
            if composite[p] < (LOW_IN_ARTICLE if inside else LOW):
                return True
            return not inside and any(n >= FEW and i >= MOST for i, n in (by[k].get(p, (0.0, 0)) for k in (LINKED, LATE)))

        verdict = {p: low(p) for p in by[TEXT]}
        paths = sorted(p for p, x in verdict.items() if x and p.startswith("~"))
        others = sorted(p for p, x in verdict.items() if not p.startswith("~") and x != verdict.get(bare(p), False))
        return pd.DataFrame({"host": [pdf.host.iloc[0]], "paths": [paths], "others": [others]})

    return tree.groupBy("host").applyInPandas(judge, "host string, paths array<string>, others array<string>")


def _main_text(html: str | None, paths: frozenset[str], others: frozenset[str]) -> str:
    found = Page(html or "").blocks
    for kind in (CONTENT, BESIDE, BY_NAME):
        blocks = [(p, t) for p, t, what in found if what == kind]
        if blocks:
            low = {p: (bare(p) in paths) != (p in others) for p in {p for p, _ in blocks}}
            return "\n".join([t for p, t in blocks if not low[p]] or [t for _, t in blocks])
    return ""


NOTHING = (frozenset(), frozenset())


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages.

    Blocks stand in page order, parted by one newline; white space inside a block is one space; references are decoded. A
    null or empty page gives an empty text; a null url counts as the host with the empty name; repeated rows are kept; an
    empty table gives no rows. Very long and deep pages take time and memory in proportion to their length. Columns of pages
    are selected by name; others, whatever their names, are ignored. If the tree would leave nothing of a page, all its
    content blocks stay; if it has none, those beside its article, or else those that only a name marks as no content, go by
    the tree in the same way. The verdicts on all hosts are broadcast if their size is at most BROADCAST_BYTES; else pages are
    joined with them, those of a host that holds most rows being dealt over SALTS copies.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    tree = stage(low_branches(style_tree(rows.select("url", "html"))), "html-tree")
    texts = F.aggregate(F.concat("paths", "others"), F.lit(0).cast("long"), lambda n, p: n + F.length(p) + 16)
    size = tree.agg(F.sum(texts + F.length("host") + 64)).first()[0] or 0
    kind = rows.schema["page_id"].dataType.simpleString()
    out = f"page_id {kind}, url string, text string, n_chars long"

    def batch_of(batch, texts):
        n = pa.array(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), n], ["page_id", "url", "text", "n_chars"])

    if size <= BROADCAST_BYTES:
        hosts = pages.sparkSession.sparkContext.broadcast({r["host"]: (frozenset(r["paths"]), frozenset(r["others"])) for r in tree.collect()})

        def read_here(batches):
            for batch in batches:
                urls, htmls = batch.column("url").to_pylist(), batch.column("html").to_pylist()
                yield batch_of(batch, [_main_text(h, *hosts.value.get(host_of(u), NOTHING)) for u, h in zip(urls, htmls, strict=True)])

        return rows.mapInArrow(read_here, out)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    keyed = rows.withColumn("host", host).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    salted = tree.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = keyed.join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "paths", "others")

    def read(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("html", "paths", "others"))
            yield batch_of(batch, [_main_text(h, frozenset(p or ()), frozenset(o or ())) for h, p, o in zip(*columns, strict=True)])

    return joined.mapInArrow(read, out)
