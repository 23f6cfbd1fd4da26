"""Main text of web pages by the maximum-scoring subsequence of tokens.

A page is a sequence of words and tags. Words score positive and tags negative, with weights learned from labelled
pages: the log-odds of a token between the labelled articles and the rest of the pages. Words and tags of headers and
footers are kinds of their own, which score as they occur: strongly negative. One linear scan finds the contiguous
region with the largest sum; menus, headers, footers and whatever else stands around the article fall outside it, as
they do not pay for their tags. The region is widened to whole blocks at its ends.

What interrupts an article without ending it (adverts, sidebars, menus, forms, reader comments) is one token, an
insert, however long it is; it has a learned weight too, and none of its words are text, as the contract wants the
article without them. Scripts, styles and the like hold no text at all (``NEVER``).

Defined results: a null or empty page, or one without words, gives an empty text; unclosed elements end with the
element around them; an unclosed script, style or comment runs to the end of the page; of equal sums the first region
counts; repeated rows each give a row. Parsing and scan are linear in the length of the page, however elements nest.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

# Names of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data dfn em font i img ins del kbd label mark q ruby rp rt s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: Elements that close an open paragraph.
CLOSE_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol "
    "p pre section table ul".split()
)
#: Elements that an opening tag closes, up to the element that holds them.
ITEMS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Kinds of tags: those of one group share a weight; other names are of the kind ``<tag>``.
GROUPS = {
    "<text>": "p h1 h2 h3 h4 h5 h6 blockquote pre b strong i em u s q cite code br hr figure figcaption sub sup",
    "<list>": "ul ol li dl dt dd",
    "<table>": "table caption thead tbody tfoot tr td th",
    "<box>": "html body div section main article span font center img",
    "<a>": "a",
}
_KIND = {name: kind for kind, names in GROUPS.items() for name in names.split()}
#: Hold no text that a reader sees as such.
NEVER = frozenset(
    "head script style noscript template title textarea select option button svg canvas object embed iframe audio "
    "video map math noembed noframes".split()
)
#: Stand around an article: they are tokens like others, and the scan decides.
AROUND = frozenset("header footer".split())
#: Interrupt an article.
INSERTS = frozenset("nav aside form dialog menu".split())
_WORD = r"(?i)(?:^|[\s_-])(?:{})(?=$|[\s_-])"
#: The same, by class or id.
MARKED_AROUND = re.compile(_WORD.format("header|masthead|footer"))
MARKED_INSERT = re.compile(
    _WORD.format(
        "ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|sidebar|side-bar|"
        "menu|nav|navbar|navigation|breadcrumb|breadcrumbs|cookie|cookies|consent|notice|popup|modal|overlay|comment|"
        "comments|disqus|respond|replies|share|sharing|social|related|recommended|newsletter|subscribe|signup|widget|"
        "pagination|pager|toolbar|skip"
    )
)
ROLES_AROUND = frozenset("banner contentinfo".split())
ROLES_INSERT = frozenset("navigation complementary search form dialog alert menu menubar toolbar".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'<]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}

START, END, TEXT = 0, 1, 2


#: The kind of all ends of elements; it scores nothing.
END_TAG = "</>"
#: What an element is to an article.
PLAIN, BESIDE, INSERT, HIDDEN = 0, 1, 2, 3


def _role(name: str, said: str) -> int:
    """What an element is to an article, by its name and attributes."""
    if name in NEVER:
        return HIDDEN
    role = INSERT if name in INSERTS else BESIDE if name in AROUND else PLAIN
    if not said or name in ("html", "body", "article", "main"):
        return role
    for m in _ATTRIBUTE.finditer(said):
        key = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return HIDDEN
        if key in ("class", "id") and MARKED_INSERT.search(value) or key == "role" and value.lower() in ROLES_INSERT:
            role = INSERT
        elif key in ("class", "id") and MARKED_AROUND.search(value) or key == "role" and value.lower() in ROLES_AROUND:
            role = max(role, BESIDE)
    return role


class _Open:
    """The open elements; where each name was opened last, and the last that is not inline, are known at once."""

    def __init__(self):
        self.names: list[str] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str) -> None:
        k = len(self.names)
        self.names.append(name)
        self.at.setdefault(name, []).append(k)
        if name not in INLINE:
            self.blocks.append(k)

    def last(self, *names: str) -> int:
        """The place of the last open element of one of the names; -1 if there is none."""
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=-1)

    def pop_to(self, k: int):
        """End events of all elements from place ``k`` on."""
        while len(self.names) > k:
            name = self.names.pop()
            self.at[name].pop()
            if name not in INLINE:
                self.blocks.pop()
            yield END, name, ""


def events(page: str):
    """(START, name, attributes), (END, name, "") and (TEXT, text, "") of a page, each element ended in its turn."""
    stack = _Open()
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield TEXT, page[at:], ""
            break
        if lt > at:
            yield TEXT, page[at:lt], ""
        m = _TAG.match(page, lt)
        if not m:
            if o := _OTHER.match(page, lt):
                at = o.end()
            elif lt + 1 < n and page[lt + 1].isascii() and page[lt + 1].isalpha():  # a tag that the page's end cuts off
                at = n
            else:  # a lone sign
                yield TEXT, "<", ""
                at = lt + 1
            continue
        at = m.end()
        ends, name, said = (m[1], m[2].lower(), m[3]) if m[2] else (m[4], m[5].lower(), m[6])
        if ends:
            k = stack.last(name)
            # An inline end does not close blocks around it.
            if k >= 0 and not (name in INLINE and stack.blocks and stack.blocks[-1] > k):
                yield from stack.pop_to(k)
            continue
        if name in CLOSE_P and stack.blocks and stack.names[stack.blocks[-1]] == "p":
            yield from stack.pop_to(stack.blocks[-1])
        if name in ITEMS:
            ended, bound = ITEMS[name]
            least = stack.last(*bound)
            inside = [k for k in map(stack.last, ended) if k > least]
            if inside:
                yield from stack.pop_to(min(inside))
        yield START, name, said
        if name in VOID or said.endswith("/") and name in ("svg", "path", "g"):
            yield END, name, ""
        elif name in RAW:
            end = _RAW_END[name].search(page, at)
            inner = page[at : end.start() if end else n]
            if inner:
                yield TEXT, inner, ""
            at = end.end() if end else n
            yield END, name, ""
        else:
            stack.push(name)
    yield from stack.pop_to(0)


def tokens(page: str) -> list[tuple[str, int, str]]:
    """(kind, words, text) of each token: tags with no words, and pieces of text with theirs.

    A piece counts as so many words. An element's tag scores where it opens, as not all are closed; its end only ends
    a block. An insert is one token; hidden elements give none.
    """
    out: list[tuple[str, int, str]] = []
    around: list[int] = []  # roles of the open elements, each at least that of the element around it
    for what, value, said in events(page):
        if what == START:
            outer = around[-1] if around else PLAIN
            role = max(outer, _role(value, said)) if outer < INSERT else outer
            around.append(role)
            if role < INSERT:
                out.append((_KIND.get(value, "<tag>") if role == PLAIN else "<beside>", 0, value))
            elif role == INSERT and outer < INSERT:
                out.append(("<insert>", 0, value))
        elif what == END:
            role = around.pop()
            if role < INSERT:
                out.append((END_TAG, 0, value))
        elif not around or around[-1] < INSERT:
            text = html.unescape(value)
            out.append(("beside" if around and around[-1] else "word", len(text.split()), text))
    return out


def region(page_tokens: list[tuple[str, int, str]], weights: dict[str, float]) -> tuple[int, int]:
    """The tokens (start, end) with the largest sum of weights, by one scan."""
    best, best_at, now, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, words, _) in enumerate(page_tokens):
        if now <= 0:
            now, start = 0.0, i
        now += weights[kind] * (words if kind[0] != "<" else 1)
        if now > best:
            best, best_at = now, (start, i + 1)
    return best_at


def _widened(page_tokens: list[tuple[str, int, str]], a: int, b: int) -> tuple[int, int]:
    """The region from the start of the block it begins in to the end of that it ends in."""
    inside = lambda token: token[2] in INLINE if token[0][0] == "<" else token[0] == "word"
    while 0 < a and inside(page_tokens[a - 1]):
        a -= 1
    while b < len(page_tokens) and inside(page_tokens[b]):
        b += 1
    return a, b


def text_of(page: str | None, weights: dict[str, float]) -> str:
    """The main text: blocks in page order, one a line."""
    if not page:
        return ""
    every = tokens(page)
    a, b = region(every, weights)
    if a == b:
        return ""
    a, b = _widened(every, a, b)
    blocks, block = [], []
    for kind, _, text in every[a:b]:
        if kind[0] != "<":
            block.append(text)
        elif text not in INLINE:
            blocks.append(block)
            block = []
        elif text == "br":
            block.append(" ")
    blocks.append(block)
    return "\n".join(x for x in (" ".join("".join(p).split()) for p in blocks) if x)


def fit(labelled: Iterable[tuple[str, str, str]]) -> dict[str, float]:
    """Weights from labelled pages, given as (before, article, after): the log-odds of each kind of token.

    All tokens, words and tags, share one distribution within articles and one outside; half a token is added to each.
    """
    inside, outside = Counter(), Counter()
    mark = "\ue000"  # no page holds it
    for before, article, after in labelled:
        state = False
        for kind, _, text in tokens(before + mark + article + mark + after):
            for i, part in enumerate(text.split(mark) if kind[0] != "<" else [text]):
                state ^= i > 0
                (inside if state else outside)[kind] += len(part.split()) if kind[0] != "<" else kind != END_TAG
    n, m = inside.total() or 1, outside.total() or 1
    kinds = ("word", "beside", "<beside>", "<insert>", "<tag>", *GROUPS)
    return {k: math.log((inside[k] + 0.5) / n) - math.log((outside[k] + 0.5) / m) for k in kinds} | {END_TAG: 0.0}


def labelled_pages(n: int = 200, seed: int = 5) -> Iterator[tuple[str, str, str]]:
    """Labelled pages made by rule: what stands before the article, the article, what stands after it.

    Layouts vary in what holds the article, in whether menus, headers, footers and adverts say what they are, and in
    what interrupts the article. What words say does not matter here, only how many there are.
    """
    rnd = random.Random(seed)
    often = lambda share: rnd.random() < share

    def some(low, high):
        return " ".join(["word"] * rnd.randint(low, high))

    def wrapped(text):
        return rnd.choice(["{}", "{}", "<span>{}</span>", "<div>{}</div>", "<img src=x>{}"]).format(text)

    def link():
        return f"<a href=/x>{wrapped(some(1, 3))}</a>"

    def paragraph():
        parts = [some(1, 30)]
        while often(0.3):
            styled = rnd.choice(["<b>{}</b>", "<em>{}</em>", "{}<br>", "<a href=/y>{}</a>"])
            parts += [styled.format(some(1, 4)), some(1, 20)]
        return f"<p>{' '.join(parts)}</p>"

    def insert():
        inner = rnd.choice([f"<p>{some(3, 40)}</p>", "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(2, 8)))])
        kind = rnd.choice(["<div class=ad>{}</div>", "<aside>{}</aside>", "<div class=related>{}</div>", "<form>{}</form>"])
        return kind.format(inner)

    def block():
        x = rnd.random()
        if x < 0.08:
            return f"<h2>{some(1, 6)}</h2>"
        if x < 0.18:
            return "<ul>" + "".join(f"<li>{some(1, 12)}</li>" for _ in range(rnd.randint(2, 8))) + "</ul>"
        if x < 0.21:
            return f"<blockquote>{paragraph()}</blockquote>"
        if x < 0.24:
            rows = rnd.randint(2, 5)
            return "<table>" + f"<tr><td>{some(1, 5)}</td><td>{some(1, 9)}</td></tr>" * rows + "</table>"
        if x < 0.28:
            return f"<div>{some(1, 50)}</div>"
        return insert() if x < 0.36 else paragraph()

    def menu():
        links = [wrapped(link()) for _ in range(rnd.randint(3, 12))]
        rows = "".join(f"<td>{x}</td>" for x in links)
        items = "".join(f"<li>{x}</li>" for x in links)
        inner = rnd.choice([f"<ul>{items}</ul>", f"<ul>{items}</ul>", "<br>".join(links), " | ".join(links), f"<table><tr>{rows}</tr></table>"])
        return rnd.choice(["<nav>{}</nav>", "<div class=menu>{}</div>", "<div>{}</div>", "<div class=top-links>{}</div>", "<div><div>{}</div></div>"]).format(inner)

    def teasers():
        each = ["<h2>{}</h2><p>{}</p>", "<p><b>{}</b> {}</p>", "<h3>{}</h3><p>{}</p>", "<p>{}<br>{}</p>"]
        return "".join(f"<div>{rnd.choice(each).format(link(), some(1, 3))}</div>" for _ in range(rnd.randint(1, 3)))

    def head():
        return rnd.choice(["<header><h1>{0}</h1><p>{1}</p></header>", "<div class=masthead><b>{0}</b> {1}</div>", "<div id=header>{0}</div>"]).format(some(1, 4), some(2, 8))

    def foot():
        return rnd.choice(["<footer>{0} {1}</footer>", "<footer><p>{0}</p><p>{1}</p></footer>", "<div class=footer>{0}<br>{1}</div>"]).format(some(4, 20), link())

    holders = [("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>"), ("<div id=x><div>", "</div></div>"), ("<section>", "</section>"), ("<table><tr><td>", "</td></tr></table>")]
    for _ in range(n):
        opens, closes = rnd.choice(holders)
        before = "".join([head() if often(0.6) else "", menu() if often(0.9) else "", teasers() if often(0.3) else "", insert() if often(0.6) else ""])
        after = "".join([insert() if often(0.5) else "", teasers() if often(0.3) else "", menu() if often(0.6) else "", foot() if often(0.8) else ""])
        article = f"<h1>{some(3, 9)}</h1>" * often(0.9) + "".join(block() for _ in range(rnd.randint(3, 15)))
        yield f"<html><head><title>{some(2, 8)}</title></head><body>{before}{opens}", article, f"{closes}{after}</body></html>"


@cache
def default_weights() -> dict[str, float]:
    """Those learned from ``labelled_pages``."""
    return fit(labelled_pages())


def extract(pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each row."""
    weights = weights or default_weights()
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches):
        for whole in batches:
            for i in range(0, max(whole.num_rows, 1), 1024):
                b = whole.slice(i, 1024)
                texts = [text_of(x.as_py(), weights) for x in b.column(2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars bigint")
