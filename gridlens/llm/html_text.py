"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks, runs of text that no block-level
tag divides.  Each has features of its ancestor tags, of their class, id and role
words and of its text; neighbours are linked by transition weights.  The labels,
article or not, are decoded by Viterbi.  Training takes a bounded sample of pages
that mark their article by a landmark element, and pages composed from their
blocks in which the article stands in other containers among menus, sidebars,
notices, forms and comments.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.shared import spare, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORDS = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template textarea select svg iframe object head title canvas audio video annotation annotation-xml".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br button cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " math semantics mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd annotation annotation-xml".split()
)
# what a head may hold; it ends at any other element and at text
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
# an open element of the first kind ends where one of the second begins
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = frozenset("ul ol dl table body article section div main aside nav header footer form blockquote".split())


@dataclass(eq=False)
class Element:
    """An open element.  `path` leads to the nearest element, itself included, that gives features; those are linked by `above`."""

    tag: str
    marks: tuple[str, ...]
    silent: bool
    above: Element | None = None
    depth: int = 0

    @property
    def path(self) -> Element | None:
        return self if self.tag not in INLINE or self.marks else self.above


def ancestors(path: Element | None) -> Iterator[Element]:
    """From the nearest to the outermost."""
    while path is not None:
        yield path
        path = path.above


def _marks(attributes: str) -> tuple[tuple[str, ...], bool]:
    """Words of class, id and role; whether the element is hidden."""
    marks, hidden = [], False
    for found in ATTRIBUTE.finditer(attributes):
        name, value = found[1].lower(), found[2] or found[3] or found[4] or ""
        if name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name in ("hidden", "aria-hidden"):
            hidden |= name == "hidden" or value.lower() == "true"
        else:
            marks += WORDS.findall(value.lower())
    return tuple(marks), hidden


def blocks_of(page: str | None) -> list[tuple[str, Element | None, int]]:
    """Leaf blocks in page order: text (references decoded, white space single), path of ancestors, characters in links.

    Works on any text: open tags end with the page, stray end tags are ignored, tags
    of head and body may be left out.  Blocks share their paths, so memory grows with
    the page and not with its depth.
    """
    page = page or ""
    out: list = []
    stack: list[Element] = []
    opened: Counter[str] = Counter()  # open elements by tag
    parts: list[str] = []
    state = {"link": 0, "links": 0, "plain": False}

    def flush() -> None:
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text and state["plain"]:  # buttons alone are controls, inside a sentence they are text
                out.append((text, stack[-1].path if stack else None, state["link"]))
            parts.clear()
        state["link"], state["plain"] = 0, False

    def cut(depth: int) -> None:
        for e in stack[depth:]:
            opened[e.tag] -= 1
            state["links"] -= e.tag == "a"
        del stack[depth:]

    def add(raw: str) -> None:
        if stack and stack[-1].tag == "head" and raw.strip():
            cut(len(stack) - 1)
        if raw and not (stack and stack[-1].silent):
            parts.append(raw)
            state["plain"] |= not opened["button"] and not raw.isspace()
            if state["links"]:
                state["link"] += len(raw.strip())

    at, size = 0, len(page)
    while at < size:
        found = TOKEN.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br" or (tag in VOID and tag in INLINE):
            add(" ")
            continue
        if closing:
            if not opened[tag]:
                continue
            depth = next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag)
            if tag in INLINE and any(e.tag in BARRIER for e in stack[depth + 1 :]):
                continue
            if any(e.tag not in INLINE for e in stack[depth:]):
                flush()
            cut(depth)
            continue
        if tag == "head" and any(opened[x] for x in opened if x != "html"):
            continue
        if stack and stack[-1].tag == "head" and tag not in HEAD:
            cut(len(stack) - 1)
        if tag not in INLINE:
            flush()
            ends = CLOSES.get(tag, frozenset()) | ({"p"} if tag not in VOID else frozenset())
            for k in range(len(stack) - 1, -1, -1) if any(opened[x] for x in ends) else ():
                if stack[k].tag in ends:
                    cut(k)
                    break
                if stack[k].tag in BARRIER:
                    break
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
            continue
        marks, hidden = _marks(attributes) if attributes.strip() else ((), False)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        above = stack[-1].path if stack else None
        stack.append(Element(tag, marks, tag in SILENT or hidden or bool(stack and stack[-1].silent), above, above.depth + 1 if above else 0))
        opened[tag] += 1
        state["links"] += tag == "a"
    flush()
    return out


LANDMARKS = ("article", "main")
ENDINGS = tuple('.!?…"”»')


def own_names(element: Element, landmarks: bool = True) -> list[str]:
    """Features that every block inside the element has."""
    if element.tag in LANDMARKS and not landmarks:
        return []
    return [f"in {element.tag}", *(f"mark {m}" for m in element.marks if landmarks or m not in LANDMARKS)]


def text_names(block: tuple, first: bool, last: bool, landmarks: bool = True) -> list[str]:
    """Features of a block's text, place and nearest element."""
    text, path, in_links = block
    names = ["any", f"words {min((text.count(' ') + 1).bit_length(), 8)}"]
    if path is not None and (landmarks or path.tag not in LANDMARKS):
        names.append(f"at {path.tag}")
    share = in_links / max(1, len(text))
    names.append("links all" if share > 0.8 else "links some" if share > 0.2 else "links few")
    names.append("ends" if text.endswith(ENDINGS) else "open")
    if "©" in text or "(c)" in text.lower():
        names.append("copyright")
    if first or last:
        names.append("first" if first else "last")
    return names


def features(blocks: list, landmarks: bool = True) -> list[list[str]]:
    """Names of the features of each block; without `landmarks`, article and main elements are not seen."""
    out = []
    for k, block in enumerate(blocks):
        names = {x for e in ancestors(block[1]) for x in own_names(e, landmarks)}
        out.append(sorted(names.union(text_names(block, k == 0, k == len(blocks) - 1, landmarks))))
    return out


@dataclass
class Field:
    """Weights of a feature for the label article (against other), and of the transitions."""

    weights: dict[str, float]
    transition: np.ndarray

    def gains(self, blocks: list) -> Iterator[float]:
        """Weight of each block's features; each name counts once.

        Blocks stand in page order, so stepping from one path to the next enters and
        leaves every element once.  Weights are multiples of 2**-20 and add up exactly.
        """
        weights, names = self.weights, Counter()
        path: list[tuple[Element, list[str]]] = []
        inside = 0.0
        for k, block in enumerate(blocks):
            fresh = []
            for e in ancestors(block[1]):
                if e.depth < len(path) and path[e.depth][0] is e:
                    break
                fresh.append(e)
            keep = fresh[-1].depth if fresh else block[1].depth + 1 if block[1] else 0
            while len(path) > keep:
                for x in path.pop()[1]:
                    names[x] -= 1
                    inside -= 0.0 if names[x] else weights[x]
            for e in reversed(fresh):
                known = [x for x in own_names(e) if x in weights]
                path.append((e, known))
                for x in known:
                    inside += 0.0 if names[x] else weights[x]
                    names[x] += 1
            yield inside + sum(weights.get(x, 0.0) for x in text_names(block, k == 0, k == len(blocks) - 1))

    def decode(self, blocks: list) -> list[bool]:
        """Most likely labels by Viterbi."""
        if not blocks:
            return []
        (t00, t01), (t10, t11) = self.transition.tolist()
        s0 = s1 = 0.0
        back = []
        for k, gain in enumerate(self.gains(blocks)):
            if k:
                from0, from1 = s0 + t00 >= s1 + t10, s0 + t01 > s1 + t11
                s0, s1 = max(s0 + t00, s1 + t10), max(s0 + t01, s1 + t11) + gain
                back.append((0 if from0 else 1, 0 if from1 else 1))
            else:
                s1 = gain
        label = int(s1 > s0)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return [bool(x) for x in reversed(labels)]


def fit(sequences: list[tuple[list[list[str]], list[bool]]], steps: int = 120, penalty: float = 0.02) -> Field:
    """Maximum likelihood by gradient steps; forward and backward sums run over all sequences at once."""
    sequences = [(f, y) for f, y in sequences if f]
    names = sorted({n for f, _ in sequences for block in f for n in block})
    place = {n: k for k, n in enumerate(names)}
    if not sequences:
        return Field({}, np.zeros((2, 2)))
    longest = max(len(f) for f, _ in sequences)
    n = len(sequences)
    truth, here = np.zeros((n, longest), dtype=int), np.zeros((n, longest), dtype=bool)
    rows, columns = [], []
    for k, (f, y) in enumerate(sequences):
        here[k, : len(f)] = True
        truth[k, : len(f)] = y
        for t, block in enumerate(f):
            rows += [k * longest + t] * len(block)
            columns += [place[x] for x in block]
    rows, columns = np.array(rows), np.array(columns)
    w, transition = np.zeros(len(names)), np.zeros((2, 2))
    sums = [np.full(len(names), 1e-6), np.full((2, 2), 1e-6)]
    pairs = here[:, 1:] & here[:, :-1]
    seen = np.array([[((truth[:, :-1] == a) & (truth[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], dtype=float)
    blocks = here.sum()
    for _ in range(steps):
        gain = np.bincount(rows, w[columns], minlength=n * longest).reshape(n, longest)
        unary = np.stack([np.zeros_like(gain), gain], axis=2)
        forward, backward = np.zeros_like(unary), np.zeros_like(unary)
        forward[:, 0] = unary[:, 0]
        for t in range(1, longest):
            moved = np.logaddexp(forward[:, t - 1, :1] + transition[0], forward[:, t - 1, 1:] + transition[1])
            forward[:, t] = np.where(here[:, t, None], moved + unary[:, t], forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = unary[:, t + 1] + backward[:, t + 1]
            moved = np.logaddexp(ahead[:, :1] + transition[:, 0], ahead[:, 1:] + transition[:, 1])
            backward[:, t] = np.where(here[:, t + 1, None], moved, 0.0)
        whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        marginal = np.exp(forward[:, :, 1] + backward[:, :, 1] - whole[:, None])
        error = np.where(here, truth - marginal, 0.0).ravel()
        slope = np.bincount(columns, error[rows], minlength=len(names)) / blocks - penalty * w / len(names)
        ahead = unary[:, 1:] + backward[:, 1:]
        expected = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                expected[a, b] = np.where(pairs, np.exp(np.minimum(0.0, forward[:, :-1, a] + transition[a, b] + ahead[:, :, b] - whole[:, None])), 0.0).sum()
        turn = (seen - expected) / blocks - penalty * transition / 4
        for total, d in zip(sums, (slope, turn)):
            total += d * d
        w += 0.5 * slope / np.sqrt(sums[0])
        transition += 0.5 * turn / np.sqrt(sums[1])
    return Field({x: round(float(v) * 2**20) / 2**20 for x, v in zip(names, w) if abs(v) > 1e-3}, transition)


# words by which pages commonly name their parts
ARTICLE_BOXES = ("<main>|</main>", '<div class="post-content">|</div>', '<div id="content"><div class="entry">|</div></div>', '<section class="story body">|</section>', '<div class="article-body text">|</div>', "<div>|</div>", '<div role="main">|</div>')
OTHER_BOXES = (
    '<div id="menu"><ul><li>|</li></ul></div>', '<div class="navbar menu"><a href="/">|</a></div>', "<header><p>|</p></header>", '<div class="header banner"><p>|</p></div>',
    '<div class="breadcrumb"><a href="/">|</a></div>', "<footer><p>|</p></footer>", '<div id="footer"><p>|</p></div>', '<aside class="sidebar"><p>|</p></aside>', "<aside><p>|</p></aside>",
    '<div class="sidebar widget"><p>|</p></div>', '<div class="related"><ul><li><a href="/">|</a></li></ul></div>', '<div class="cookie-notice"><p>|</p></div>', '<div class="notice alert"><p>|</p></div>',
    '<div class="popup modal" role="dialog"><p>|</p></div>', '<div class="ad">|</div>', '<div class="ads sponsored"><p>|</p></div>', '<div class="advert advertisement"><p>|</p></div>', '<div class="promo"><p>|</p></div>',
    "<form><label>|</label></form>", '<form class="newsletter subscribe"><p>|</p></form>', '<div class="share social"><a href="/">|</a></div>', '<div class="comments"><div class="comment"><p>|</p></div></div>',
    '<div class="user-remarks"><div class="remark"><p>|</p></div></div>', '<div id="discussion"><div class="thread"><p>|</p></div></div>', '<section class="responses feedback"><p>|</p></section>', '<div class="guestbook opinions"><p>|</p></div>',
    '<section id="comments"><h3>|</h3></section>', '<ol class="commentlist"><li class="comment"><p>|</p></li></ol>', '<div class="reply response"><p>|</p></div>', '<div class="copyright legal"><p>|</p></div>', '<nav class="pagination"><a href="/">|</a></nav>',
)


# class and id words of parts that do not belong to an article although they stand in it
OUTSIDE = frozenset("ad comment comments related remark remarks share sidebar".split())


def labelled(pages: list[str], seed: int = 5) -> list[tuple[list[list[str]], list[bool]]]:
    """Training sequences from pages with a landmark element, as they are, without it, and recomposed."""
    rng = np.random.default_rng(seed)
    parsed, articles, others = [], [], []
    for page in pages:
        blocks = blocks_of(page)
        outside = lambda e: e.tag in ("nav", "aside", "footer", "form") or bool(OUTSIDE.intersection(e.marks))
        truth = [any(e.tag in LANDMARKS for e in ancestors(path)) and not any(map(outside, ancestors(path))) for _, path, _ in blocks]
        if any(truth):
            parsed.append((blocks, truth))
            articles.append([(text, path.tag if path else "p") for (text, path, _), y in zip(blocks, truth) if y])
            others += [text for (text, _, _), y in zip(blocks, truth) if not y]
    out = [(features(blocks, landmarks), truth) for blocks, truth in parsed for landmarks in (True, False)]
    others = others or ["Menu"]
    pick = lambda values: values[int(rng.integers(len(values)))]
    for article in articles:
        pieces, kinds = [], []

        def put(text: str, box: str, kind: bool) -> None:
            before, after = box.split("|")
            pieces.append(before + html.escape(text, quote=False) + after)
            kinds.append(kind)

        noise = lambda: pick(pick(articles))[0] if rng.random() < 0.4 else pick(others)
        for _ in range(int(rng.integers(1, 5))):
            put(noise(), pick(OTHER_BOXES[:11] + OTHER_BOXES[11:18]), False)
        opening, ending = pick(ARTICLE_BOXES).split("|")
        pieces.append(opening)
        for text, tag in article:
            tag = tag if tag in ("p", "h1", "h2", "h3", "li", "blockquote", "pre", "td") else "p"
            put(text, f"<{tag}>|</{tag}>", True)
            if rng.random() < 0.08:
                put(noise(), pick(OTHER_BOXES[14:22]), False)
        pieces.append(ending)
        for _ in range(int(rng.integers(1, 6))):
            put(noise(), pick(OTHER_BOXES), False)
        blocks = blocks_of("<body>" + "".join(pieces) + "</body>")
        if len(blocks) == len(kinds):
            out.append((features(blocks), kinds))
    return out


# labelled texts for tables without a labelled page; only their lengths, ends and places tell anything
STANDARD_TITLES = ("A walk by the river", "Bread at home", "How bridges are built", "Notes from the workshop", "The night train", "Winter gardens")
STANDARD_SENTENCES = (
    "The path follows the water for two hours and then climbs to the old mill.", "Nobody had opened the door for years.", "Mix flour, water and salt, and let the dough rest until it has doubled.",
    "A long span needs either a deep beam or a cable that hangs between two towers.", "We measured the table twice before the first cut, and it still came out short.", "It rained.",
    "The conductor told us that the line would close in spring, since few people used it after the new road was built.", "Some plants keep their leaves under snow.", "What did the builders know of wind?",
    "Later the town bought the house and made it a library with a reading room for children.",
)
STANDARD_OTHERS = ("Home", "About us", "Contact", "News", "Log in", "Read more", "Share this page", "We use cookies to improve this site.", "Subscribe to our newsletter", "All rights reserved.", "© 2024 Example", "Related articles", "Great post, thank you!", "I do not agree with the second part.", "Search", "Privacy policy", "Next page", "Sponsored")


def standard_pages(count: int = 120, seed: int = 6) -> list[str]:
    """Pages that mark their article, made of the texts above."""
    rng = np.random.default_rng(seed)
    pick = lambda values, n: [html.escape(values[int(k)], quote=False) for k in rng.integers(0, len(values), n)]
    out = []
    for _ in range(count):
        body = "".join(f"<p>{' '.join(pick(STANDARD_SENTENCES, int(rng.integers(1, 5))))}</p>" for _ in range(int(rng.integers(2, 8))))
        menu = "".join(f'<li><a href="/">{x}</a></li>' for x in pick(STANDARD_OTHERS, 5))
        end = "".join(f"<p>{x}</p>" for x in pick(STANDARD_OTHERS, 2))
        out.append(f"<body><nav><ul>{menu}</ul></nav><article><h1>{pick(STANDARD_TITLES, 1)[0]}</h1>{body}</article><footer>{end}</footer></body>")
    return out


def train(pages: DataFrame, column: str = "html", max_pages: int = 250, max_chars: int = 40_000) -> Field:
    """Fits on at most max_pages pages (by hash) of at most max_chars characters that have a landmark element.

    A table without such a page gives no labels; the field then learns from `standard_pages` and their recomposed forms.
    """
    rows = pages.select(F.col(column).alias("html")).where(F.length("html") <= max_chars).where(F.lower("html").rlike("<(article|main)[ >]"))
    rows = rows.orderBy(F.xxhash64("html"), "html").limit(max_pages)
    return fit(labelled([r["html"] for r in rows.collect()]) or labelled(standard_pages()))


def extract(pages: DataFrame, field: Field, column: str = "html") -> DataFrame:
    """All rows and columns plus `text` and `n_chars` (replaced if there): the article's blocks, one per line.

    A null or empty page, or one without article blocks, has an empty text; an empty
    table gives no rows.  Every row is extracted on its own, so repeated rows give
    equal texts.  Time and memory of a page grow with its length, however deep it
    nests.  A tie between the labels of a block goes to "other".  Other columns,
    whatever their names, are kept.
    """
    own = [c for c in pages.columns if c not in ("text", "n_chars")]
    shared = pages.sparkSession.sparkContext.broadcast((field.weights, field.transition))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(*shared.value)
        for batch in batches:
            texts = []
            for page in batch.column(len(own)).to_pylist():
                blocks = blocks_of(page)
                texts.append("\n".join(b[0] for b, keep in zip(blocks, model.decode(blocks)) if keep))
            kept = [batch.column(k) for k in range(len(own))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*own, "text", "n_chars"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in own), "text string, n_chars long"])
    return pages.select(*own, F.col(column).alias(spare(own, "_html"))).mapInArrow(run, schema)


def op4_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return extract(pages, train(pages), "html").select("page_id", "url", "text", "n_chars")
