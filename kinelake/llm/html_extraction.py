"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of tags and words. Words score positive and tags negative,
how much being learned from labelled pages: the log-odds of each kind of token
(a tag by name, a word by the block and by whether it is linked) to stand in
main text. One linear scan finds the contiguous region with the largest sum.

Elements that hold no text of an article whatever they are called (menus,
scripts, forms' fields; by name) cost a little as wholes and are left out where
they lie inside the region. Elements whose class, id or role has a telling word
are suspects: the rest of the page is scanned without them, at that same cost,
and each is scanned as a sequence of its own. A suspect's sum is weighed by how
often text under its words is main text, as learned from the labelled pages, and
by its part of the page: if its region wins all the same, it was the article's
frame after all, and the page is scanned again with it as an ordinary element.

The region may miss the ends of an article, where lines are short or linked. So it
is extended to the ends of an element that encloses most of it, if that is an
article by name, or if it holds a few words more than the region.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import common
from kinelake.llm.labelled_pages import PAGES

_VALUE = r"""=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+|)"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|{_VALUE})*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))""", re.I)
#: Elements whose content is not markup; it ends at their end tag.
RAW = {"script", "style", "noscript", "textarea", "title", "template", "iframe", "xmp"}
#: Elements that hold no main text.
OUTSIDE = RAW | {"head", "nav", "footer", "aside", "button", "select", "option", "svg", "canvas", "object", "menu", "dialog", "label", "input"}
#: Words in class, id or role that make an element a suspect, as does the name of a form or of a page's header.
SUSPECT = {*"ad ads adbox adsense adslot adunit advert adverts advertisement advertising sponsored sponsor promo promotion banner breadcrumb breadcrumbs masthead cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup signin login related recommended share sharing social toolbar topbar pagination pager copyright skip contentinfo search complementary menu nav navbar navigation sidebar aside footer header form".split()}
COMMENT = {*"comment comments commentlist disqus replies respond".split()}
#: Words beside those that speak of a page's layout or state, not of what the element holds.
STATE = {*"no has with without open closed wrap wrapper layout page".split()}
VOID = {*"area base br col embed hr img input link meta param source track wbr".split()}
#: Elements inside a line; every other tag parts blocks.
INLINE = {*"a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()}
#: Start tags that end an open element of the same kind.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that are an article by name, and those that are the page itself.
ARTICLES, PAGE = {"article", "main"}, {"", "html", "body"}
#: Never a suspect.
FRAMES = {"html", "body", "main"}


def telling_words(name: str, attributes: str, in_article: bool) -> frozenset[str]:
    """The words that make an element a suspect: from its class, id and role (capitals part words, too) or its name."""
    if name in FRAMES:
        return frozenset()
    found = {name} & {"form", "header"}
    for m in _ATTRIBUTE.finditer(attributes):
        for part in (m[1] or m[2] or m[3] or "").split():
            words = {w.lower() for w in re.split(r"[_\-:]+|(?<=[a-z])(?=[A-Z])", part)}
            if not words & STATE:
                found |= words & (SUSPECT | COMMENT)
    if name == "article":
        found &= COMMENT
    if in_article:  # an article's own header holds its heading
        found -= {"header"}
    return frozenset(found)


class Element:
    """An open element of the page, but inline ones."""

    __slots__ = ("name", "parent", "depth")

    def __init__(self, name: str, parent: Element | None):
        self.name, self.parent, self.depth = name, parent, parent.depth + 1 if parent else 0


class Suspect:
    """An element that the page is scanned without; ``words`` is empty if it can't hold main text at all.

    ``all_words``: with those of the suspects around it; ``hopeless``: if it or one of those can't hold main text.
    """

    def __init__(self, at: int, name: str, words: frozenset[str], parent: Suspect | None):
        self.at, self.name, self.words, self.parent = at, name, words, parent
        self.all_words = words if parent is None else parent.all_words if words <= parent.all_words else words | parent.all_words
        self.hopeless = not words or (parent is not None and parent.hopeless)

    def chain(self) -> Iterator[Suspect]:
        s = self
        while s:
            yield s
            s = s.parent


def tokens(page: str, cleared: frozenset[int] = frozenset()) -> Iterator[tuple[str, str, Suspect | None, Element]]:
    """(kind, text, innermost suspect, innermost element): kind names a tag, or a text's block, with ``+a`` if linked.

    ``cleared``: where elements start that aren't suspects. The state of the
    element that is open is kept on the stack, so a token costs the same at any depth.
    """
    # Name, block, whether linked, whether in an article, suspect, element.
    stack: list[tuple[str, str, bool, bool, Suspect | None, Element]] = [("", "body", False, False, None, Element("", None))]
    open_names: Counter[str] = Counter()
    at, n = 0, len(page)

    def text(s: str):
        _, block, linked, _, suspect, element = stack[-1]
        return f"w:{block}" + "+a" * linked, html.unescape(s), suspect, element

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            yield text(page[at:])
            return
        if m.start() > at:
            yield text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if open_names[name]:
                while True:
                    shut = stack.pop()[0]
                    open_names[shut] -= 1
                    if shut == name:
                        break
            yield f"t:{name}", "", stack[-1][4], stack[-1][5]
            continue
        while stack[-1][0] in CLOSES.get(name, ()):
            open_names[stack.pop()[0]] -= 1
        _, block, linked, in_article, suspect, element = stack[-1]
        if name in OUTSIDE:
            suspect = Suspect(m.start(), name, frozenset(), suspect)
        elif m.start() not in cleared and (words := telling_words(name, m[3], in_article)):
            suspect = Suspect(m.start(), name, words, suspect)
        yield f"t:{name}", "", suspect, element
        if name in RAW:  # to its end tag, or to the end of the page
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            stack.append((name, block if name in INLINE else name, linked or name == "a", in_article or name in ("article", "main"), suspect, element if name in INLINE else Element(name, element)))
            open_names[name] += 1


@cache
def weights() -> tuple[dict[str, float], dict[str, float]]:
    """From the labelled pages: log-odds of each kind of token to be main text, and the share of main text under each telling word.

    Words stay positive, tags negative.
    """
    inside, other, under, main_under = Counter(), Counter(), Counter(), Counter()
    for page in PAGES:
        mark = None
        for kind, s, suspect, _ in tokens(page):
            if kind == "t:main-":
                mark = page.index("<main->") if mark is None else -1
                continue
            is_main = mark is not None and mark >= 0 and (suspect is None or suspect.at < mark)
            n = len(s.split()) if kind[0] == "w" else 1
            if is_main or suspect is None:  # what is under a suspect isn't in the page's own sequence
                (inside if is_main else other)[kind] += n
            if kind[0] == "w" and suspect:
                for w in suspect.all_words:
                    under[w] += n
                    main_under[w] += n * is_main
    n1, n0 = sum(inside.values()), sum(other.values())
    learned = {k: math.log((inside[k] + 0.5) / (n1 + 1)) - math.log((other[k] + 0.5) / (n0 + 1)) for k in inside | other}
    kinds = {k: max(0.05, v) if k[0] == "w" else min(-0.05, v) for k, v in learned.items()}
    return kinds, {w: (main_under[w] + 0.5) / (under[w] + UNSEEN) for w in SUSPECT | COMMENT}


#: Of words and tags that the labelled pages lack; of a whole element that is left out.
WORD, TAG, LEFT_OUT = 0.5, -0.5, -1.0
#: An element that encloses so much of the region's words may extend it; one that isn't an article by name, by so many words.
ENCLOSED, MORE = 0.8, 8
#: Words that count beside those seen under a telling word; the weighed sums that a suspect and a reader's comment need.
UNSEEN, LEAST, LEAST_COMMENT = 50, 0.15, 1.0


class Scan:
    """The best region of one sequence so far."""

    def __init__(self):
        self.found, self.run, self.start, self.sum, self.best = [], 0.0, 0, 0.0, (0, 0)

    def add(self, score: float, kind: str, s: str, element: Element) -> None:
        self.found.append((kind, s, element))
        self.run += score
        if self.run <= 0:
            self.run, self.start = 0.0, len(self.found)
        elif self.run > self.sum:
            self.sum, self.best = self.run, (self.start, len(self.found))

    def extended(self) -> tuple[int, int]:
        """The best region, to the ends of what it is the main part of.

        Of the elements around most of the region, the innermost article by name
        gives its ends; without one, every element that adds a few words, most of
        them not linked.
        """
        start, end = self.best
        inside, all_words, linked = Counter(), Counter(), Counter()
        for i, (kind, s, element) in enumerate(self.found):
            if kind[0] == "w" and (n := len(s.split())):
                all_words[element] += n
                linked[element] += n * kind.endswith("+a")
                inside[element] += n * (start <= i < end)
        words = sum(inside.values())
        if not words:
            return start, end
        parents, todo = set(), list(all_words)
        while todo:
            element = todo.pop()
            if element not in parents:
                parents.add(element)
                if element.parent:
                    todo.append(element.parent)
        for element in sorted(parents, key=lambda e: -e.depth):
            if element.parent:
                for sums in (inside, all_words, linked):
                    sums[element.parent] += sums[element]
        around = max((e for e in parents if inside[e] >= ENCLOSED * words), key=lambda e: e.depth)
        whole = None
        while around and around.name not in PAGE:
            if around.name in ARTICLES:
                whole = around
                break
            if all_words[around] - inside[around] <= MORE and 2 * linked[around] <= all_words[around]:
                whole = around
            around = around.parent
        if whole is None:
            return start, end
        own = {whole: True}
        for i, (kind, _, element) in enumerate(self.found):
            path = []
            while element and element not in own and element.depth > whole.depth:
                path.append(element)
                element = element.parent
            is_own = bool(element) and own.get(element, False)
            own.update(dict.fromkeys(path, is_own))
            if is_own and kind[0] == "w":
                start, end = min(start, i), max(end, i + 1)
        return start, end

    def text(self) -> str:
        parts = []
        start, end = self.extended()
        for kind, s, _ in self.found[start:end]:
            if kind[0] == "w":
                parts.append(s)
            elif kind[2:] not in INLINE:
                parts.append("\n")
        return " ".join("".join(parts).split())


def scans(page: str, cleared: frozenset[int]) -> dict[Suspect | None, Scan]:
    """A scan of the page and of each suspect, without the suspects inside."""
    known, _ = weights()
    found: dict[Suspect | None, Scan] = {None: Scan()}
    for kind, s, suspect, element in tokens(page, cleared):
        scan = found.get(suspect)
        if scan is None:
            scan = found[suspect] = Scan()
            found.setdefault(suspect.parent, Scan()).add(LEFT_OUT, f"t:{suspect.name}", "", element)  # so that an advert doesn't part an article
        if suspect is None or suspect.words:
            scan.add(len(s.split()) * known.get(kind, WORD) if kind[0] == "w" else known.get(kind, TAG), kind, s, element)
    return found


def winner(found: dict[Suspect | None, Scan]) -> Suspect | None:
    """The sequence whose region counts most; none is the page itself. Readers' comments come last."""
    _, share = weights()
    words = {x: x.all_words for x in found if x and not x.hopeless}
    total = found[None].sum + sum(found[x].sum for x, w in words.items() if not w & COMMENT)
    best, most = None, found[None].sum
    for suspect, own in sorted(words.items(), key=lambda x: bool(x[1] & COMMENT)):
        if own & COMMENT and best:
            break
        rho, scan = min(share[w] for w in own), found[suspect]
        value = scan.sum * rho
        if value < (LEAST_COMMENT if own & COMMENT else LEAST):
            continue
        part = scan.sum / total if total else 0.0
        if part > 0.5 and not own & COMMENT:  # at a half this is the learned share, at the whole page it is one
            value = scan.sum * rho ** (2 * (1 - part))
        if value > most:
            best, most = suspect, value
    return best


def main_text(page: str) -> str:
    found = scans(page, frozenset())
    if (frame := winner(found)) is not None:
        cleared = frozenset(x.at for x in frame.chain())
        found = scans(page, cleared)
    return found[None].text()


def extract_text(df: DataFrame, *, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """One row a page: ``page_id, url, text``.

    Null and empty pages, and pages without words, give an empty text. Broken
    markup is read as far as it goes: unclosed elements end with their parent,
    an unclosed script or comment with the page; nesting may be of any depth. Repeated rows give repeated
    rows, an empty table none; other columns are not read.
    """
    common.prepare(df.sparkSession)

    @F.pandas_udf("string")
    def extract(pages):
        return pages.map(main_text)

    url = df[url_col] if url_col else F.lit(None).cast("string")
    return df.select(df[id_col].alias("page_id"), url.alias("url"), extract(F.coalesce(df[html_col].cast("string"), F.lit(""))).alias("text"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(common.read(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


#: Holds for pages whose main text is their one article element, with nothing to leave out inside, as in the test tables.
OP9_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS h FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?b>', '', 'g'), '<[^>]*>', chr(10), 'g') AS t FROM a),
d AS (SELECT page_id, url, regexp_replace(replace(t, '&quot;', '"'), '&amp;?', '&', 'g') AS t FROM t),
s AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM s
"""
