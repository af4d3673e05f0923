"""Main-text extraction by minimum-cut labelling.

A page is read into blocks of text and the elements around them.  A classifier gives each block the log-odds that it is
content, a sum of graded evidence: its length, closing punctuation, share of linked text and heading; how strong a sign of
an article encloses it, against the strongest on the page; and the signs of boilerplate in the names of the elements
around it (firm where a name says nothing else, faint where it says more).  Log-odds are the capacities to the two terminals.  Neighbouring blocks are tied
by an edge that weakens with their distance in the tree, neighbours under one parent by another (both weaker where a firm
sign of boilerplate stands between); a block of middling
log-odds thus goes with its surroundings.  The minimum cut, found by maximum flow, separates content from boilerplate.
Blocks whose own log-odds outweigh all their ties are decided first, which shortens the rest to small graphs without
changing the cut's value.

Weights are log-odds by judgement, not fitted: a clear paragraph or a clear list of links is worth about 3, a sign of an
article 3.5 either way, a firm sign of boilerplate 10, a faint one 3; a block's edges add up to 3 at most.  A firm sign thus
decides alone, whatever the text is.  Length counts words, or letters of scripts without spaces by two.  Work grows about
as the page, however deep it is nested and however many blocks are in doubt (40,000 of them take seconds).

Cases: null html is empty; a page without content has an empty text.  Markup errors (unclosed or stray tags, unclosed
comments, stray angle brackets) are read as browsers do where that is cheap.  A tie in the cut goes to boilerplate.  Every
row is judged alone, so repeated rows give repeated results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import pick

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = "script|style|textarea|iframe"
SKIPPED = "noscript|template|svg|math|object|head|select|canvas|audio|video"
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body div article section main table td th ul ol dl nav aside footer header form blockquote figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role: firm and faint signs of boilerplate, and signs of the article.
FIRM = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar dropdown "
    "sidebar widget widgets related recommended recommendations complementary masthead topbar colophon copyright contentinfo "
    "cookie cookies consent gdpr alertdialog modal popup overlay toast dialog paywall newsletter subscribe subscription "
    "comment comments commentlist commentary disqus respond".split()
)
FAINT = frozenset(
    "header footer banner aside trending popular rail skip legal notice notices alert reply replies discussion feedback reviews "
    "form search login signup signin register share sharing social follow".split()
)
# Of these, where one is the whole name of an element, the sign is firm.
ALONE = frozenset("header footer banner aside notice alert replies discussion reviews search login signup share social".split())
HOME_WORDS = frozenset("article main content story post entry body text maincontent articlebody".split())
# Words that say where or how a part is shown: a firm word beside others than these (related-work) is a faint sign.
PLACING_WORDS = frozenset(
    "area bar block body bottom box button card cell center col column component content fixed footer global group head header heading holder icon inner "
    "item items left link links list lists mobile module nav outer panel primary right row secondary section segment site slot small sticky "
    "tab table tertiary text thread title top unit view zone form field user reader posts articles stories news products videos images topics pages tags count".split()
)
WRAPPER_WORDS = frozenset("has with without no page wrapper wrap layout container content main article post entry body is".split())
AWAY_TAGS = {"nav": 10.0, "footer": 10.0, "aside": 10.0, "button": 10.0, "menu": 10.0, "dialog": 10.0, "legend": 10.0, "fieldset": 10.0, "form": 10.0, "header": 5.0}
# Headings that open a part of readers' or of the site, in the languages of the corpus.
OPENS = re.compile(r"(?i)^\W*\d*\s*(?:(?:reader |user )?comments?|replies|responses|leave a (?:reply|comment)|related (?:articles|stories|posts)|read (?:more|next)|more (?:stories|news)|you may also like|kommentare?|commentaires?|comentarios?)\W*\d*\W*$")
REMARK = re.compile(r"(?i)(?:^|\s)(?:reply|report|permalink|antworten|répondre|responder)\W*$|\b\d+ (?:minutes?|hours?|days?|weeks?) ago\b|^[\w .-]{2,30} (?:says|said|wrote|writes|schreibt|dit|dice)\s*:")

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?:svg|math)(?=[\s/>])(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+(?<=/)>"
    # Without an end tag raw text runs to the page's end; any other element is read as an open one.
    rf"|<({RAW}|{SKIPPED})(?=[\s/>])(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|(?=<body\b))"
    rf"|<(?:{RAW})(?=[\s/>])(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*\Z"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
ATTR = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
NAMES = re.compile(r"[a-z]+")
# Letters of scripts that put no spaces between words, of which two make about one.
UNSPACED = re.compile(r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF]")
ENDS = re.compile(r"[.!?…。！？:;][\"'”’)]*$")
LONG = 50
STRAY = 200  # open elements that an end tag, or what it implies, looks back over


class Page:
    """Elements by number (0 is the page): parent, name, signs away and home; blocks: text, element, linked characters,
    distance from the block before, parent by blocks, and whether a heading that opens another part precedes them."""

    def __init__(self, source: str) -> None:
        self.parent, self.depth, self.name, self.away, self.home = [0], [0], [""], [0.0], [0.0]
        self.block_of, self.heading = [0], [False]  # the nearest element that is not inline; whether in a heading
        self.text: list[str] = []
        self.at: list[int] = []
        self.linked: list[int] = []
        self.distance: list[int] = []
        self.read(source)

    def open(self, up: int, name: str, attrs: str) -> int:
        away, home = signs(name, attrs)
        inline = name in INLINE
        n = len(self.parent)
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1)
        self.name.append(name)
        self.away.append(away)
        self.home.append(home)
        self.block_of.append(self.block_of[up] if inline else n)
        self.heading.append(self.heading[up] or name in HEADINGS)
        return n

    def read(self, source: str) -> None:
        stack: list[int] = []
        parts: list[str] = []
        state = {"links": 0, "linked": 0, "low": 0, "last": 0}
        name_of = self.name

        def flush() -> None:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                self.text.append(text)
                self.at.append(stack[-1] if stack else 0)
                self.linked.append(state["linked"])
                self.distance.append(state["last"] + len(stack) - 2 * state["low"])
                state["low"] = state["last"] = len(stack)
            parts.clear()
            state["linked"] = 0

        def say(piece: str) -> None:
            if piece:
                parts.append(piece)
                if state["links"]:
                    state["linked"] += len(piece)

        def close(upto: int) -> None:
            flush()
            for n in stack[upto:]:
                if name_of[n] == "a":
                    state["links"] -= 1
            del stack[upto:]
            state["low"] = min(state["low"], upto)

        at = 0
        for m in TOKEN.finditer(source):
            say(source[at : m.start()])
            at = m.end()
            name = (m[3] or m[6] or "").lower()
            if not name:
                if m[0][1].isalpha():
                    parts.append(" ")
                continue
            ends, attrs = bool(m[2] or m[5]), m[4] or m[7] or ""
            if name in ("br", "hr") or (name not in INLINE and name in VOID):
                parts.append(" ")
                continue
            if ends:
                for i in range(len(stack) - 1, -1, -1):
                    if name_of[stack[i]] == name:
                        if name in INLINE:
                            state["links"] -= name == "a"
                            del stack[i]
                            state["low"] = min(state["low"], len(stack))
                        else:
                            close(i)
                        break
                    if name in INLINE and name_of[stack[i]] in SCOPE:
                        break
                    if len(stack) - i > STRAY:  # an end tag that closes nothing near is a stray one
                        break
                else:
                    if name not in INLINE:
                        flush()
                continue
            if name in VOID or attrs.endswith("/") and name in INLINE:
                continue
            if name not in INLINE:
                flush()
                for i in range(len(stack) - 1, max(-1, len(stack) - STRAY), -1):  # what a new block ends by itself
                    open_name = name_of[stack[i]]
                    if open_name == "p" or open_name in IMPLIED.get(name, ()):
                        close(i)
                        break
                    if open_name in SCOPE and open_name not in ("td", "th") or (open_name in ("td", "th") and name not in IMPLIED):
                        break
            state["links"] += name == "a"
            stack.append(self.open(stack[-1] if stack else 0, name, attrs))
        say(source[at:])
        flush()


def signs(name: str, attrs: str) -> tuple[float, float]:
    """How strong a sign of boilerplate, and of the article, an element's name and attributes are."""
    away = AWAY_TAGS.get(name, 0.0)
    home = 3.5 if name == "article" else 1.5 if name == "main" else 0.0
    if attrs and name not in ("html", "body"):
        for key, value in ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value)):
                away = max(away, 10.0)
            elif key != "style":
                for part in value.split():
                    words = NAMES.findall(part)
                    if not WRAPPER_WORDS.intersection(words):
                        others = [w for w in words if w not in FIRM and w not in FAINT and w not in PLACING_WORDS and len(w) > 1]
                        firm = FIRM.intersection(words) or (len(words) == 1 and ALONE.intersection(words))
                        if firm and not others:
                            away = max(away, 10.0)
                        elif firm or FAINT.intersection(words):
                            away = max(away, 3.0)
                    if len(words) <= 2 and HOME_WORDS.intersection(words) and not FIRM.intersection(words):
                        home = max(home, 1.5)
    return away, 0.0 if away >= 10 else home


def costs(page: Page) -> list[float]:
    """For each block the capacity to the content side less that to the boilerplate side: the classifier's log-odds."""
    n = len(page.parent)
    mass = [0] * n
    for e, t in zip(page.at, page.text, strict=True):
        mass[e] += len(t)
    holds = [False] * n  # whether an element encloses a sign of the article
    for e in range(n - 1, 0, -1):
        up = page.parent[e]
        mass[up] += mass[e]
        holds[up] |= holds[e] or page.home[e] >= 1.5
    away, home = [0.0] * n, [0.0] * n
    for e in range(1, n):
        up, own = page.parent[e], page.away[e]
        if own and (holds[e] or mass[e] >= 0.7 * mass[0]) and page.name[e] not in ("nav", "footer", "aside", "dialog"):
            own = min(own, 1.0)  # what encloses the article, or most of the text, is a wrapper
        if page.name[e] == "header" and home[up] > 0:
            own = min(own, 4.0)
        away[e] = min(13.0, away[up] + own)
        home[e] = max(home[up], page.home[e] if away[e] < 10 else 0.0)
    most = max((home[e] for e in page.at), default=0.0)
    page.away = away
    opened: dict[int, bool] = {}
    out = []
    for text, e, linked in zip(page.text, page.at, page.linked, strict=True):
        words = text.count(" ") + 1 + len(UNSPACED.findall(text)) / 2
        share = min(1.0, linked / max(1, len(text)))
        heading = page.heading[e]
        length = max(-2.5, min(2.5, 1.5 * math.log(words / 8)))
        score = (max(-0.5, length) if heading else length) + (0.6 if ENDS.search(text) else -0.3) - 4 * max(0.0, share - 0.25)
        if heading:
            score += 0.8 + (1.5 if home[e] else 0.0)
        if "©" in text and words < 40:
            score -= 3
        remark = bool(REMARK.search(text))
        if remark:
            score -= 2
        score = max(-3.0, min(3.0, score))
        # A heading that opens another part counts for what follows it under the same parent, until the next heading.
        around = page.block_of[page.parent[page.block_of[e]]]
        if heading:
            opened[around] = bool(OPENS.match(text))
        part = 0.0
        if opened.get(around) or opened.get(page.block_of[page.parent[around]]) and not heading:
            part = 3.0 if words >= LONG and not remark and not heading else 6.0  # what is as long as an essay is hardly a reply
        out.append(score + 2 * home[e] - most - away[e] - part)
    return out


def max_flow(net: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of a minimum cut; net: capacity from the source if positive, else to the sink.

    Blocking flows: each round finds the distances to the sink and then sends all that paths of that length can take, every
    edge being left for good once it can take no more.  The graphs here tie blocks to their neighbours, so the ways from
    what is surplus to what is short are short, and so are the rounds few."""
    n = len(net)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    adj: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, c: float, back: float) -> None:
        adj[a].append(len(to))
        to.append(b)
        cap.append(c)
        adj[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, v in enumerate(net):
        if v > 0:
            add(s, i, v, 0.0)
        else:
            add(i, t, -v, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    while True:
        away = {t: 0}  # distance to the sink
        queue = [t]
        for a in queue:
            for e in adj[a]:
                if to[e] not in away and cap[e ^ 1] > 1e-12:
                    away[to[e]] = away[a] + 1
                    queue.append(to[e])
        if s not in away:
            reached, queue = {s}, [s]
            for a in queue:
                for e in adj[a]:
                    if cap[e] > 1e-12 and to[e] not in reached:
                        reached.add(to[e])
                        queue.append(to[e])
            return [i in reached for i in range(n)]
        left = [0] * (n + 2)
        path: list[int] = []
        at = s
        while True:
            if at == t:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                first = next(k for k, e in enumerate(path) if cap[e] <= 1e-12)
                at = to[path[first] ^ 1]
                del path[first:]
            elif left[at] < len(adj[at]):
                e = adj[at][left[at]]
                if cap[e] > 1e-12 and away.get(to[e], -1) == away[at] - 1:
                    path.append(e)
                    at = to[e]
                else:
                    left[at] += 1
            elif at == s:
                break
            else:
                at = to[path.pop() ^ 1]
                left[at] += 1


def min_cut(net: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The same, after deciding every node whose own capacity outweighs all its edges."""
    net = list(net)
    ties: list[dict[int, float]] = [{} for _ in net]
    for a, b, w in edges:
        ties[a][b] = ties[a].get(b, 0.0) + w
        ties[b][a] = ties[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * len(net)
    todo = list(range(len(net)))
    while todo:
        i = todo.pop()
        if label[i] is not None or abs(net[i]) < sum(ties[i].values()):
            continue
        label[i] = net[i] > 0
        for j, w in ties[i].items():
            net[j] += w if label[i] else -w
            del ties[j][i]
            todo.append(j)
        ties[i] = {}
    for i in range(len(net)):
        if label[i] is None:
            part, index = [i], {i: 0}
            for a in part:
                for b in ties[a]:
                    if b not in index:
                        index[b] = len(part)
                        part.append(b)
            cut = max_flow([net[a] for a in part], [(index[a], index[b], w) for a in part for b, w in ties[a].items() if a < b])
            for a, side in zip(part, cut, strict=True):
                label[a] = side
    return [bool(x) for x in label]


def graph(page: Page, adjacency: float, kinship: float) -> list[tuple[int, int, float]]:
    """Smoothness edges; a firm sign that stands on one side only weakens a tie."""
    edges, last = [], {}
    for i, e in enumerate(page.at):
        near = [(i - 1, adjacency / (1 + 0.25 * max(0, page.distance[i] - 2)))] if i else []
        parent = page.block_of[page.parent[page.block_of[e]]]
        if parent in last:
            near.append((last[parent], kinship))
        last[parent] = i
        edges += [(j, i, w if abs(page.away[page.at[j]] - page.away[e]) < 10 else w / 4) for j, w in near]
    return edges


def extract(source: str | None, adjacency: float = 0.8, kinship: float = 0.7) -> str:
    page = Page(source or "")
    own = costs(page)
    keep = min_cut(own, graph(page, adjacency, kinship))
    return " ".join(t for t, k in zip(page.text, keep, strict=True) if k)


def main_text(pages: DataFrame, adjacency: float = 0.8, kinship: float = 0.7) -> DataFrame:
    """page_id, url, text and n_chars (its code points) of every page."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [extract(h, adjacency, kinship) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pick(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
