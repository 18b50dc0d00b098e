"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags. The first pass classifies each block by its length,
link density and stop-word density and by the element that holds it: menus, footers and the like are
out; a form or a class word is a doubt that gives way where the prose of the page is in it; an
article is in but for its lists of links. Blocks too short to tell stay open; the second pass gives
them the label of the nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotcredit.llm.common import column, fresh, without

# Frequent function words of the languages of the pages.
STOP_WORDS = frozenset(
    """
    the of and to in a is that for it as was with be by on not he his but at are this have from or
    had an they which one you were all her she there would their we him been has when who will no
    more if out so what up its about than them can only other
    de la le et les des en un une du que est pour qui dans par sur au il pas plus ce avec ne se sont
    son cette mais ou elle nous aux ses
    der die das und den von mit sich auf ist im dem nicht ein eine als auch es an werden aus er hat
    dass sie nach wird bei einer um am sind noch wie einem
    el los las por con para una su al lo como del sus pero este entre cuando muy sin sobre
    """.split()
)
# Elements of markup. Text of the first kind ends only at its own end tag.
RAW = ("script", "style", "noscript", "title", "textarea", "iframe", "template")
HIDDEN = ("head", "svg", "math", "object", "select", "canvas", "audio", "video", "datalist")
OUTSIDE = frozenset({"nav", "header", "footer", "aside", "button", "menu", "dialog",
                     "label", "legend"})
DOUBTED = frozenset({"form", "fieldset"})
INSIDE = frozenset({"article", "main"})
BLOCKS = frozenset(
    """
    address article aside blockquote body button caption center col colgroup dd details dialog dir
    div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr
    html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th
    thead tr ul
    """.split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that a start tag of the same kind ends if it was left open.
ENDS = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}),
        "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}),
        "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}),
        "option": frozenset({"option"})}
# Words in class, id and role that name a part beside the article.
BESIDE = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advert\w*|adbox|banner|sponsor\w*|promo\w*|cookie\w*|consent|"
    r"notice\w*|alert|popup|modal|newsletter|subscribe\w*|comments?|comment-?\w*|disqus|replies|"
    r"respond|sidebar\w*|side-?bar|nav|navbar|navigation|menu\w*|breadcrumbs?|pagination|pager|"
    r"footer\w*|header|masthead|share\w*|sharing|social\w*|related\w*|recommend\w*|widget\w*|"
    r"toolbar|login|signup|search\w*|complementary|contentinfo|skip-?link\w*)(?:$|[^a-z])"
)
SECRET_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
HIDDEN_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    rf"<({'|'.join(RAW)})\b{ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|"
    rf"<({'|'.join(HIDDEN)})\b{ATTRIBUTES}>.*?</\2\s*>",
    re.S | re.I,
)
TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})>")
CUT_TAG = re.compile(r"</?[a-zA-Z][^<>]*\Z")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
WORDS = re.compile(r"\w+")
HEADER = re.compile(r"[\w-]*(?:header|masthead)\b")
NEGATED = re.compile(r"\b(?:has|no|with|without|hide|show)-[\w-]+")

GOOD, BAD, OPEN, UNSEEN, DOUBT = 1, -1, 0, -2, 2


def _beside(name: str, attributes: str, inside: bool) -> int:
    """How an element stands beside the article: BAD by its kind, UNSEEN if hidden, DOUBT by its
    name or if it is a form, else OPEN. Within an article headers belong to it."""
    kind = DOUBT if name in DOUBTED else OPEN
    if name in OUTSIDE and not (inside and name == "header"):
        kind = BAD
    if not attributes.strip():
        return kind
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes):
        return UNSEEN
    for key, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        key = key.lower()
        if key == "style" and SECRET_STYLE.search(value) or key == "aria-hidden" and value == "true":
            return UNSEEN
        if kind == OPEN and key in ("class", "id", "role") and name not in ("html", "body", "main"):
            value = NEGATED.sub("", value)
            if BESIDE.search(HEADER.sub("", value) if inside else value):
                kind = DOUBT
    return kind


def _held(name: str, kind: int, label: int, doubts: tuple[int, ...], new: int) -> tuple[
        int, tuple[int, ...]]:
    """Label and doubts of an element in one of the given label and doubts."""
    if UNSEEN in (kind, label):
        return UNSEEN, ()
    if kind == BAD:
        return BAD, doubts
    if name == "main":
        return GOOD, ()
    if name in INSIDE:
        return GOOD, (*doubts, new) if kind == DOUBT or label == BAD else doubts
    return label, (*doubts, new) if kind == DOUBT and label != BAD else doubts


def blocks(page: str) -> list[tuple[str, int, str, int, tuple[int, ...]]]:
    """Blocks of a page in order: (text, label by container, tag, characters in links, numbers of
    the doubted elements that hold it)."""
    page = HIDDEN_PART.sub(lambda m: "" if m[0].startswith("<!--") else " ", page)
    page = CUT_TAG.sub("", page)
    found: list[tuple[str, int, str, int, tuple[int, ...]]] = []
    stack: list[tuple[str, tuple[int, tuple[int, ...]]]] = []
    opened: Counter[str] = Counter()
    label: tuple[int, tuple[int, ...]] = (OPEN, ())
    links, tag, at, linked = 0, "", 0, 0
    parts: list[str] = []

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            found.append((text, label[0], tag, linked, label[1]))
        parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        if links:
            linked += len(piece)

    def pop(to: int) -> None:
        nonlocal label
        held = stack[to - 1][1] if to else (OPEN, ())
        if held != label:
            close()
        opened.subtract(x for x, _ in stack[to:])
        del stack[to:]
        label = held

    for m in TAG.finditer(page):
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        name = m[2].lower()
        if name == "a":
            links = 0 if m[1] else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        block = name in BLOCKS
        if block:
            close()
            links = 0
        if m[1]:
            if opened[name] > 0:
                pop(max(i for i in range(len(stack)) if stack[i][0] == name))
            if block:
                tag = ""
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if name in ENDS:
            top = len(stack) - 1
            while top >= 0 and stack[top][0] not in BLOCKS:
                top -= 1
            if top >= 0 and stack[top][0] in ENDS[name]:
                pop(top)
        held = _held(name, _beside(name, m[3], label[0] == GOOD), *label, m.start())
        if held != label:
            close()
        stack.append((name, held))
        opened[name] += 1
        label = held
        if block:
            tag = name
    if at < len(page):
        add(page[at:])
    close()
    return found


def _cleared(found: list[tuple[str, int, str, int, tuple[int, ...]]], weights: list[int],
             running: list[int]) -> set[int]:
    """Doubted elements that hold half of the page's weight or more while no article beside them
    holds any, or running text; for elements without a part of an article, any text."""
    total, cleared = sum(weights), set()
    share: Counter[int] = Counter()
    for (*_, doubts), weight in zip(found, weights, strict=True):
        share.update(dict.fromkeys(doubts, weight))
    inside = {new for _, held, _, _, doubts in found if held == GOOD for new in doubts}
    for new in sorted(share):
        if share[new] and 2 * share[new] >= total and not any(
            (w or new not in inside or r and tag[:1] != "h") and held == GOOD and new not in doubts
            and cleared.issuperset(doubts)
            for (_, held, tag, _, doubts), w, r in zip(found, weights, running, strict=True)
        ):
            cleared.add(new)
    return cleared


def labels(found: list[tuple[str, int, str, int, tuple[int, ...]]], short: int, link: float,
           stop: float) -> list[bool]:
    """Whether each block belongs to the main text, by the two passes."""
    dense, sizes, heavy = [], [], []
    for text, _, _, linked, _ in found:
        words = WORDS.findall(text.lower())
        sizes.append(len(words))
        heavy.append(linked > link * len(text))
        dense.append(sum(w in STOP_WORDS for w in words) >= stop * len(words))
    cleared: set[int] = set()
    if any(doubts for *_, doubts in found):
        seen = [held not in (BAD, UNSEEN) and not h for (_, held, *_), h in
                zip(found, heavy, strict=True)]
        running = [n * (y and n >= short) for n, y in zip(sizes, seen, strict=True)]
        for weights in ([n * d for n, d in zip(running, dense, strict=True)], running,
                        [n * (y and x[1] == GOOD) for n, y, x in zip(sizes, seen, found, strict=True)]):
            if any(weights):
                cleared = _cleared(found, weights, running)
                break
    listed = [h and n < short and x[1] == GOOD and not x[2][:1] == "h" for h, n, x in
              zip(heavy, sizes, found, strict=True)]
    first = []
    for k, (_, held, _, _, doubts) in enumerate(found):
        if held in (BAD, UNSEEN) or not cleared.issuperset(doubts):
            first.append(BAD)
        elif held == GOOD:
            first.append(BAD if any(len(part) == 3 and all(part) for part in (
                listed[max(0, k - 2) : k + 1], listed[max(0, k - 1) : k + 2], listed[k : k + 3]))
                else GOOD)
        elif heavy[k]:
            first.append(BAD)
        elif sizes[k] < short:
            first.append(OPEN)
        else:
            first.append(GOOD if dense[k] else BAD if sizes[k] < 3 * short else OPEN)
    before, last = [], OPEN
    for x in first:
        last = x or last
        before.append(last)
    after, last = [], OPEN
    for x in reversed(first):
        last = x or last
        after.append(last)
    after.reverse()
    keep = []
    for x, a, b, (_, _, tag, _, _) in zip(first, before, after, found, strict=True):
        heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        sides = (b or a,) if heading else (a or b, b or a)
        keep.append(x == GOOD or x == OPEN and all(s == GOOD for s in sides))
    if not any(x == GOOD for x in first):  # no block tells: what is not named as beside is the text
        keep = [x == OPEN for x in first]
    return keep


def main_text(page: str, short: int = 10, link: float = 0.3, stop: float = 0.2) -> str:
    """The main text of one page: its blocks joined by newlines, empty if there is none."""
    found = blocks(page)
    keep = labels(found, short, link, stop)
    return "\n".join(text for (text, *_), kept in zip(found, keep, strict=True) if kept)


def extract_text(
    pages: DataFrame,
    html_column: str = "html",
    short_words: int = 10,
    link_density: float = 0.3,
    stop_density: float = 0.2,
) -> DataFrame:
    """``pages`` with text (the main text) and n_chars (its code points).

    Blocks in menus, headers, footers, asides and hidden parts are out. Forms and parts whose class,
    id or role names an advert, notice, comment or the like are out, also within the article, unless
    they hold half of the page's prose or more and no article or main element beside them holds text.
    An article or main element is in, but for runs of three or more short blocks of links. Elsewhere
    a block is out if more than ``link_density`` of it is links, in if it has ``short_words`` words
    and ``stop_density`` stop words; open blocks are in if the nearest decided blocks on both sides
    are (a heading asks the one that follows).
    Character references are decoded, white space becomes one space, blocks are joined by newlines.
    A page on which nothing is decided to be text gives all blocks that are not out.

    Missing or empty pages give an empty text; every row stays; text and n_chars replace input
    columns of these names. An empty table gives none.
    """

    @F.arrow_udf("string")
    def texts(values: pa.Array) -> pa.Array:
        return pa.array([main_text(v or "", short_words, link_density, stop_density)
                         for v in values.to_pylist()], pa.string())

    kept = [c for c in without(pages, ["text", "n_chars"]).columns]
    name = fresh(pages.columns, "main_text_")
    result = pages.withColumn(name, texts(column(pages, html_column)))
    return result.select(*[column(result, c) for c in kept], F.col(name).alias("text"),
                         F.char_length(name).cast("long").alias("n_chars"))
