"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped to lines, one per block element.  The text lengths of a sliding window of lines
are summed; a surge is a window that reaches ``threshold``, the dive after it the next window
without text, and the lines between them are kept.  Elements that are never part of an article
(menus, headers of the page, forms, notices, adverts, comments, ...) leave empty lines, a window
wide, so text on both sides of them stays apart.  Link text does not count towards a window, but is
kept with its line.

A marked article (``article``, ``main``) is a border for blocks and a weight: its text, short lines
and all, stands for one block of ``MARKED`` times its length.  It is believed if that reaches the
largest block outside and the largest other article; then blocks outside stay only if they hold as
much text as it.  Any other article is read like the rest of the page, by surge and dive.

An element whose class, id or role names such a part in a whole token is left out too, but no
heading, and not if a window of its text is a surge and it weighs at least as much as the rest.

Null and empty pages, and pages without such text, have the empty text.  White space inside a block
is one space, also at a line break element; blocks are joined by one newline.  An element that is
never closed ends where an article begins, or with the page.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML, by their role.
RAW = frozenset("script style textarea title noscript template iframe svg math canvas object xmp noembed noframes".split())
DROPPED = frozenset("nav footer aside form button select menu dialog fieldset datalist audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(("address article blockquote body caption center dd details div dl dt figcaption figure footer form h1 h2 h3 "
                    "h4 h5 h6 head header hgroup hr html legend li main nav ol option p pre section summary table tbody td "
                    "tfoot th thead tr ul aside fieldset menu dialog").split())
#: Never judged by their class, id or role.
PLAIN = frozenset("html body main h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words whose tokens in class, id or role name a part outside the article.
HINTS = frozenset(("ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion sidebar "
                   "side menu navbar nav navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup "
                   "modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
                   "comment comments commentlist reply replies respond disqus footer masthead header topbar toolbar pager "
                   "pagination widget complementary contentinfo search").split())
#: Weight of text in a marked article beside other text.
MARKED = 4
OPEN = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])([^\s=>"'/]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
QUOTED = re.compile(r"""=\s*(["'])""")
BORDER = re.compile(r"[\W\d_]+")


def _tag_end(page: str, at: int) -> int:
    """The place after the tag that begins at ``at``; a > inside a quoted value does not end it."""
    while True:
        end = page.find(">", at)
        if end < 0:
            return len(page)
        value = QUOTED.search(page, at, end)
        close = page.find(value[1], value.end()) if value else -1
        if close < 0:
            return end + 1
        at = close + 1


def hinted(tag: str) -> bool:
    """Whether all words of one token of class, id or role are hints; ``tag`` is in lower case."""
    for name, value in ATTRIBUTE.findall(tag):
        if name in ("class", "id", "role"):
            for token in value.strip("\"'").split():
                words = [w for w in BORDER.split(token) if w]
                if words and HINTS.issuperset(words):
                    return True
    return False


def lines(page: str, window: int) -> tuple[list[tuple[str, int, int, int]], list[int], list[int]]:
    """Text, length outside links, innermost marked article and innermost hinted element (0: none) of each line.

    Then the article around each article and the hinted element around each hinted element.  The gap
    before a hinted element has its number below zero.
    """
    low = page.lower()
    if len(low) != len(page):  # a letter whose lower case is longer
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), page)
    out: list[tuple[str, int, int, int]] = []
    text: list[str] = []
    linked = [0, 0]  # open links, length of their text
    around, inside, marks = [0], [0], [("", 0)]  # marks: name of each open article, hinted elements open around it
    above, hints, named = [0], [("", 0)], {}  # hints: name and number of the open ones; named: place and depth by name
    drop, depth = "", 0
    at, n = 0, len(page)

    def close():
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                out.append((line, max(0, len(line) - linked[1]), inside[-1], hints[-1][1]))
            text.clear()
            linked[1] = 0

    def leave(count):
        close()
        while len(hints) > count:
            name, _ = hints.pop()
            if name:
                named[name].pop()

    def enter(name):
        close()
        above.append(hints[-1][1])
        hints.append((name, len(above) - 1))
        if name:
            named.setdefault(name, []).append([len(hints) - 1, 1])
        out.extend([("", 0, inside[-1], 1 - len(above))] * window)

    while at < n:
        lt = page.find("<", at)
        lt = n if lt < 0 else lt
        if lt > at and not drop:
            text.append(page[at:lt])
            if linked[0]:
                linked[1] += lt - at
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1:lt + 2] in ("!", "?"):
            at = _tag_end(page, lt)
            continue
        closing = page[lt + 1:lt + 2] == "/"
        m = OPEN.match(low, lt + 1 + closing)
        if not m:
            if not drop:
                text.append("<")
            at = lt + 1
            continue
        name, at = m[0], _tag_end(page, lt)
        if not closing and name in RAW:
            end = low.find(f"</{name}", at)
            at = n if end < 0 else _tag_end(page, end)
            continue
        if drop:
            if name == drop:
                depth += -1 if closing else 1
                if not depth:
                    drop = ""
            if name in ("article", "main") and not closing:
                drop, depth = "", 0
            else:
                continue
        if hints[-1][0] == "p" and name in BLOCKS and not closing:
            leave(len(hints) - 1)  # a paragraph ends where the next block begins
        if named.get(name):
            own = named[name][-1]
            own[1] += -1 if closing else 1
            if not own[1]:
                leave(own[0])
        if name in BLOCKS or name == "main":
            close()
        elif name == "br":
            text.append(" ")
        elif name == "a":
            linked[0] = max(0, linked[0] + (-1 if closing else 1))
        if name in ("article", "main"):
            if not closing:
                if name == "main" or all(m != "article" for m, _ in marks[-2:]):
                    leave(1)  # never closed, or a frame around the article
                marks.append((name, len(hints)))
                around.append(inside[-1])
                inside.append(len(around) - 1)
            elif len(inside) > 1:
                leave(marks.pop()[1])
                inside.pop()
            out += [("", 0, inside[-1], hints[-1][1])] * window
        if closing or name in VOID or page[at - 2:at] == "/>":
            continue
        if name in DROPPED or name == "header" and not inside[-1] or name == "head":
            drop, depth = name, 1
            close()
            out += [("", 0, inside[-1], hints[-1][1])] * window
        elif name not in PLAIN and "=" in page[lt:at] and hinted(low[lt:at]):
            enter("" if name == "article" else name)
    close()
    return out, around, above


def left_in(found: list[tuple[str, int, int, int]], above: list[int], window: int, threshold: int) -> list[tuple[str, int, int]]:
    """Lines without those of hinted elements, which stay if they have a surge and weigh no less than the rest."""
    sizes: dict[int, list[int]] = {}
    weight = [0] * len(above)
    for text, n, r, g in found:
        if text:
            sizes.setdefault(g, []).append(n)
            weight[g] += n * MARKED if r else n
    rest, stay = weight[0], {0}
    for g in sorted(sizes.keys() - {0}, key=lambda g: (-weight[g], g)):
        if weight[g] < rest or np.convolve(sizes[g], np.ones(window, np.int64)).max() < threshold:
            continue
        while g not in stay:
            stay.add(g)
            rest += weight[g]
            g = above[g]
    return [(text, n, r) for text, n, r, g in found if (g in stay if text else g >= 0 or -g not in stay)]


def blocks(size: np.ndarray, text: list[bool], window: int, threshold: int) -> list[list[int]]:
    """The lines with text from each surge to its dive."""
    sums = np.convolve(np.concatenate([size, np.zeros(window, np.int64)]), np.ones(window, np.int64))[window - 1:][:len(size) + 1]
    out, k = [], 0
    while k < len(size):
        if sums[k] >= threshold and size[k]:
            out.append([])
            while k < len(size) and sums[k]:
                if text[k]:
                    out[-1].append(k)
                k += 1
        k += 1
    return out


def believed(size: np.ndarray, region: list[int], around: list[int], outside: int) -> dict[int, int]:
    """Length of the text of each marked article that is as heavy as ``outside`` and as the other articles."""
    own = [0] * len(around)
    for n, r in zip(size.tolist(), region):
        own[r] += n
    whole = list(own)
    for r in range(len(around) - 1, 0, -1):  # the article around another one comes first
        whole[around[r]] += whole[r]
    least = max([outside, *own[1:]])
    return {r: whole[r] for r in range(1, len(around)) if whole[r] * MARKED >= least}


def main_text(page: str | None, window: int = 3, threshold: int = 86) -> str:
    if not page:
        return ""
    found, around, above = lines(page, window)
    found = left_in(found, above, window, threshold)
    if not found:
        return ""
    text, size, region = [bool(t) for t, _, _ in found], np.array([n for _, n, _ in found], np.int64), [r for _, _, r in found]
    marked = any(t and r for t, r in zip(text, region))
    # Without an article the largest window counts as a surge, however short it is.
    largest = int(np.convolve(size, np.ones(window, np.int64)).max())
    surges = blocks(size, text, window, threshold if marked else max(1, min(threshold, largest)))
    length = [int(size[b].sum()) for b in surges]
    trusted = believed(size, region, around, max([0, *(n for b, n in zip(surges, length) if not region[b[0]])])) if marked else {}
    kept = {k for k, r in enumerate(region) if text[k] and r in trusted}
    least = max([0, *trusted.values()])
    for b, n in zip(surges, length):
        if region[b[0]] or n >= least:
            kept.update(b)
    return "\n".join(found[k][0] for k in sorted(kept))


def extract(pages: DataFrame, window: int = 3, threshold: int = 86) -> DataFrame:
    """page_id, url, the main text and its length, for every row of ``pages`` (page_id, url, html)."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            got = [main_text(h.as_py(), window, threshold) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()),
                                              pa.array([len(t) for t in got], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
