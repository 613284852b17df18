"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, each with its path of tags, classes and ids.  A
bidirectional LSTM in numpy reads the blocks of a page in order, as hashed vectors of
path and words with a few measures, and says of each whether it belongs to the article;
every decision so sees the whole page from both ends.

The network is trained here, once per process, on pages that ``make_page`` composes
from a seed: layouts of semantic tags, classed divisions and tables around invented
prose, with every kind of boilerplate, so what is the article is known.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import bounded_batches

PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 96, 32, 8, 16
INPUT = PATH_DIM + WORD_DIM + MEASURES
#: Pages, passes and seed of the training; parameters of ``train``.
TRAIN_PAGES, EPOCHS, SEED = 360, 16, 11
#: Cells (pages x blocks) that one pass of the network holds at most, a single page apart.
MAX_CELLS = 24_000

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title select option datalist".split())
FOREIGN = frozenset("svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr svg math noscript object iframe template".split()
)
# Blocks that end open graphics and formulas.
BREAKING = frozenset(
    "article aside blockquote body center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tbody td "
    "th thead tr ul".split()
)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>?")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PART = re.compile(r"[A-Za-z]+")


class Block:
    __slots__ = ("text", "path", "names", "link")

    def __init__(self, text: str, path: tuple[str, ...], names: tuple[str, ...], link: float):
        self.text, self.path, self.names, self.link = text, path, names, link


def slot_of(kind: str, word: str, dim: int) -> int:
    return zlib.crc32(f"{kind}:{word}".encode()) % dim


class Bag:
    """Words that are open, as one of each hash slot: all that the features see of them, however many there are."""

    def __init__(self, kind: str):
        self.kind, self.open = kind, {}

    def add(self, word: str) -> None:
        own = self.open.setdefault(slot_of(self.kind, word, PATH_DIM), {})
        own[word] = own.get(word, 0) + 1

    def remove(self, word: str) -> None:
        slot = slot_of(self.kind, word, PATH_DIM)
        own = self.open[slot]
        if own[word] > 1:
            own[word] -= 1
        else:
            del own[word]
            if not own:
                del self.open[slot]

    def words(self) -> tuple[str, ...]:
        return tuple(next(iter(own)) for own in self.open.values())


class Open:
    """The open elements of a page; where the last of a tag stands is known without a search."""

    def __init__(self):
        self.entries: list[tuple[str, tuple[str, ...]] | None] = []  # None: ended out of order
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.foreign: list[int] = []
        self.tags, self.names = Bag("tag"), Bag("name")
        self.seen: tuple[tuple[str, ...], tuple[str, ...]] | None = None

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def tag(self, k: int) -> str:
        return self.entries[k][0]

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        k = len(self.entries)
        self.entries.append((tag, names))
        self.places.setdefault(tag, []).append(k)
        if tag in FOREIGN:
            self.foreign.append(k)
        if tag not in INLINE:
            self.blocks.append(k)
            self.tags.add(tag)
            self.seen = None
        for n in names:
            self.names.add(n)
            self.seen = None

    def end(self, k: int) -> None:
        """Ends the one element at ``k``, the last of its tag."""
        tag, names = self.entries[k]
        self.entries[k] = None
        self.places[tag].pop()
        if tag in FOREIGN:
            self.foreign.pop()
        if tag not in INLINE:
            self.blocks.pop()
            self.tags.remove(tag)
            self.seen = None
        for n in names:
            self.names.remove(n)
            self.seen = None
        while self.entries and self.entries[-1] is None:
            self.entries.pop()

    def cut(self, k: int) -> None:
        """Ends the element at ``k`` and all in it."""
        while len(self.entries) > k:
            self.end(len(self.entries) - 1)

    def path(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """The open tags but inline ones, the innermost last, and the open names; one of each slot."""
        if self.seen is None:
            inner = (self.tag(self.blocks[-1]),) if self.blocks else ()
            self.seen = (*self.tags.words(), *inner), self.names.words()
        return self.seen


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks with text, in page order, in time that grows with the page only.

    Scripts, styles, titles, form controls and comments are none.  Parts of graphics and
    formulas stay in the line they stand in, a space between them.
    """
    out: list[Block] = []
    stack = Open()
    pieces: list[str] = []
    linked = [0]
    unclosed: set[str] = set()

    def flush() -> None:
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            out.append(Block(text, *stack.path(), min(1.0, linked[0] / len(text))))
        pieces.clear()
        linked[0] = 0

    def keep(piece: str) -> None:
        pieces.append(piece)
        if stack.last("a") >= 0:
            linked[0] += len(piece.strip())

    page = page or ""
    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            keep(page[at:])
            break
        if lt > at:
            keep(page[at:lt])
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            keep("<")
            at = lt + 1
            continue
        at = m.end()
        closing, tag, rest = m[1], m[2].lower(), m[3]
        foreign = stack.foreign[0] if stack.foreign else None
        if foreign is not None and tag in BREAKING:
            stack.cut(foreign)
        elif foreign is not None and tag not in RAW and tag not in INLINE:
            pieces.append(" ")
            if closing:
                if stack.last(tag) > foreign:
                    stack.cut(stack.last(tag))
            elif not rest.endswith("/"):
                stack.push(tag, ())
            continue
        if closing:
            k = stack.last(tag)
            if tag in FOREIGN:  # its open parts end with it
                if k >= 0:
                    stack.cut(k)
            elif tag in INLINE:
                if k > (stack.blocks[-1] if stack.blocks else -1):
                    stack.end(k)
            else:
                flush()
                if k >= 0:
                    stack.cut(k)
            continue
        if tag in RAW and foreign is not None and rest.endswith("/"):
            continue
        if tag in RAW:
            stop = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            if stop is None:  # nor is there one further on
                unclosed.add(tag)
            at = end if stop is None and tag in ("script", "style", "title", "textarea") else at if stop is None else stop.end()
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        names = tuple(p.lower() for x in _NAMED.findall(rest) for p in _PART.findall("".join(x))) if "=" in rest else ()
        if _HIDDEN.search(rest):
            names += ("hidden",)
        if tag not in INLINE:
            flush()
            # A block start ends an open paragraph; list items, cells and options end their like.
            like = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(tag, ())
            if stack.blocks and (inner := stack.tag(stack.blocks[-1])) and (inner == "p" or inner in like):
                stack.cut(stack.blocks[-1])
        if not rest.endswith("/"):
            stack.push(tag, names)
    flush()
    return out


# -- features --------------------------------------------------------------------------


class Slots(dict):
    """Remembered hash slots of words and paths, emptied when there are many."""

    def slot(self, kind: str, word: str, dim: int) -> int:
        key = (kind, word)
        if key not in self:
            if len(self) > 200_000:
                self.clear()
            self[key] = slot_of(kind, word, dim)
        return self[key]

    def path(self, path: tuple[str, ...], names: tuple[str, ...]) -> list[int]:
        key = (path, names)
        if key not in self:
            found = {self.slot("tag", t, PATH_DIM) for t in path} | {self.slot("name", n, PATH_DIM) for n in names}
            found |= {self.slot("last", t, PATH_DIM) for t in path[-1:]}
            self[key] = sorted(found)
        return self[key]


def features(blocks: list[Block], slots: Slots) -> np.ndarray:
    """A row per block."""
    x = np.zeros((len(blocks), INPUT), np.float32)
    n = len(blocks)
    for i, b in enumerate(blocks):
        x[i, slots.path(b.path, b.names)] = 1
        words = b.text.split()
        for w in words:
            x[i, PATH_DIM + slots.slot("word", w.lower().strip(".,:;!?"), WORD_DIM)] += 1 / len(words)
        x[i, PATH_DIM + WORD_DIM :] = (
            min(1.0, np.log1p(len(words)) / 6),
            b.link,
            i / n,
            b.text[-1] in ".!?…\"”»",
            sum(map(b.text.count, ".,;")) / len(words),
            b.text[:1].isupper(),
            bool(b.path) and b.path[-1] in ("h1", "h2", "h3", "h4"),
            1,
        )
    return x


# -- network ---------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(w: np.ndarray, u: np.ndarray, b: np.ndarray, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states of an LSTM over x (pages, blocks, input); masked steps leave the state as it is."""
    pages, steps, _ = x.shape
    h = np.zeros((pages, HIDDEN), np.float32)
    c = np.zeros_like(h)
    out = np.zeros((pages, steps, HIDDEN), np.float32)
    into = x @ w + b
    for t in range(steps):
        z = into[:, t] + h @ u
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[:, t, None]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        if keep is not None:
            keep.append((h, c, i, f, o, g, tc))
        h = np.where(m, o * tc, h)
        c = np.where(m, c_new, c)
        out[:, t] = h
    return out


def _back(w, u, x, mask, kept, d_out):
    """Gradients of ``_run``."""
    dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN, np.float32)
    dh = np.zeros((x.shape[0], HIDDEN), np.float32)
    dc = np.zeros_like(dh)
    for t in range(x.shape[1] - 1, -1, -1):
        h, c, i, f, o, g, tc = kept[t]
        m = mask[:, t, None]
        dh = dh + d_out[:, t]
        live_h, live_c = np.where(m, dh, 0), np.where(m, dc, 0)
        dcn = live_c + live_h * o * (1 - tc**2)
        dz = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), live_h * tc * o * (1 - o), dcn * i * (1 - g**2)], 1)
        dw += x[:, t].T @ dz
        du += h.T @ dz
        db += dz.sum(0)
        dh = np.where(m, 0, dh) + dz @ u.T
        dc = np.where(m, 0, dc) + dcn * f
    return dw, du, db


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, rows))
    x = np.zeros((len(rows), steps, INPUT), np.float32)
    mask = np.zeros((len(rows), steps), bool)
    for k, r in enumerate(rows):
        x[k, : len(r)] = r
        mask[k, : len(r)] = True
    return x, mask


def probabilities(weights: list[np.ndarray], rows: list[np.ndarray]) -> list[np.ndarray]:
    """For each page the probability of each block; pages of like length run together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(rows)
    order = [k for k in sorted(range(len(rows)), key=lambda k: len(rows[k])) if len(rows[k])]
    w1, u1, b1, w2, u2, b2, v, c = weights
    at = 0
    while at < len(order):
        take = [order[at]]
        while at + len(take) < len(order) and (len(take) + 1) * len(rows[order[at + len(take)]]) <= MAX_CELLS:
            take.append(order[at + len(take)])
        x, mask = _padded([rows[k] for k in take])
        h = np.concatenate([_run(w1, u1, b1, x, mask), _run(w2, u2, b2, x[:, ::-1], mask[:, ::-1])[:, ::-1]], 2)
        p = _sigmoid(h @ v + c)
        for k, of in zip(take, p):
            out[k] = of[: len(rows[k])]
        at += len(take)
    return out


@functools.lru_cache(maxsize=4)
def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> list[np.ndarray]:
    """The weights, from composed pages; the same for the same arguments."""
    made = [labelled_blocks(make_page(random.Random(seed * 100_003 + k))) for k in range(pages)]
    slots = Slots()
    data = [(features(b, slots), np.array(y, np.float32)) for b, y in made if b]
    rng = np.random.default_rng(seed)
    shape = [(INPUT, 4 * HIDDEN), (HIDDEN, 4 * HIDDEN), (4 * HIDDEN,)] * 2 + [(2 * HIDDEN,), ()]
    weights = [np.asarray(rng.normal(0, 0.15, s) if len(s) else 0.0, np.float32) for s in shape]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), 24):
            part = [data[k] for k in order[at : at + 24]]
            x, mask = _padded([r for r, _ in part])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, labels) in enumerate(part):
                y[k, : len(labels)] = labels
            w1, u1, b1, w2, u2, b2, v, c = weights
            k1: list = []
            k2: list = []
            xb, mb = x[:, ::-1], mask[:, ::-1]
            h = np.concatenate([_run(w1, u1, b1, x, mask, k1), _run(w2, u2, b2, xb, mb, k2)[:, ::-1]], 2)
            d = np.where(mask, _sigmoid(h @ v + c) - y, 0) / mask.sum()
            dh = d[..., None] * v
            grads = [
                *_back(w1, u1, x, mask, k1, dh[..., :HIDDEN]),
                *_back(w2, u2, xb, mb, k2, dh[:, ::-1, HIDDEN:]),
                np.einsum("ps,psh->h", d, h),
                d.sum(),
            ]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = (weights[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return weights


# -- composed pages --------------------------------------------------------------------

ARTICLE, OTHER = "\ue000", "\ue001"

# Parts of words, and the usual names of parts of pages.
SYLLABLES = "an ber ca dor el fi gra hon in jo kel lu mer no or pa qui ra sen ti un ver wo xi yor za ch th st é ñ ü ß".split()
GOOD_NAMES = ["article", "post", "entry content", "main content", "story body", "post body", "text", "article body", "page content", "single post", "blog post", "content"]
BAD = {
    "menu": (["nav", "ul", "div"], ["nav", "menu", "main menu", "navbar", "top nav", "navigation", "breadcrumb", "pagination", "site nav"]),
    "header": (["header", "div"], ["header", "site header", "masthead", "topbar", "logo", "branding", "page header"]),
    "footer": (["footer", "div"], ["footer", "site footer", "copyright", "bottom", "colophon", "legal"]),
    "sidebar": (["aside", "div", "section"], ["sidebar", "widget", "related", "related posts", "recent", "popular", "tags", "rail", "secondary"]),
    "notice": (["div", "section", "p"], ["notice", "cookie", "cookie banner", "alert", "consent", "gdpr", "message", "popup", "modal", "disclaimer"]),
    "ad": (["div", "aside", "section", "p"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad slot"]),
    "form": (["form", "div"], ["form", "search", "newsletter", "subscribe", "login", "signup", "contact form"]),
    "comments": (["section", "div", "ol", "ul"], ["comments", "comment", "comment list", "reply", "respond", "discussion", "user comments", "responses"]),
    "share": (["div", "ul"], ["share", "social", "sharing", "follow", "social links"]),
}
SHORT = "home about contact login search menu news archive privacy terms help subscribe share reply next previous more tags shop cart sign up register".split()


#: Words that tell other parts of pages from articles where names do not, and words that are common in both.
TELLING = {
    "notice": "cookies cookie consent accept privacy policy settings browser website experience agree partners preferences".split(),
    "ad": "buy offer sale discount price free shipping order deal limited shop exclusive advertisement sponsored".split(),
    "comments": "thanks thank great post reply comment agree nice please lol".split(),
    "sidebar": "related popular recent posts read articles latest categories archives follow newsletter subscribe tags".split(),
    "footer": "copyright rights reserved terms privacy policy contact inc ltd site powered".split(),
}
COMMON = (
    "the of and to in a is that for it was on with as be at by this from are or an we you your our i not have they he she his her their which but "
    "all been has had were will one more can about said so what when who out up people time new now my first two some other after there than then"
).split()


def _prose(r: random.Random, n: int, telling: list[str] | None = None) -> str:
    def word() -> str:
        if telling and r.random() < 0.4:
            return r.choice(telling)
        return r.choice(COMMON) if r.random() < 0.4 else "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))

    words = [word() for _ in range(n)]
    for k in range(len(words)):
        if k == 0 or words[k - 1].endswith("."):
            words[k] = words[k].capitalize()
        if r.random() < 0.12:
            words[k] += r.choice([",", ".", "."])
    return " ".join(words) + r.choice([".", ".", ".", ""])


def _attr(r: random.Random, names: list[str]) -> str:
    name = r.choice(names)
    return f' {r.choice(["class", "class", "id"])}="{name.replace(" ", r.choice([" ", "-", "_"]))}"'


def _plain(r: random.Random) -> str:
    """Another part of a page without names, which only its words tell."""
    tag, telling = r.choice(["p", "div"]), TELLING[r.choice(sorted(TELLING))]
    return "".join(f"<{tag}>{OTHER}{_prose(r, r.randint(8, 60), telling)}</{tag}>" for _ in range(r.randint(1, 2)))


def _bad(r: random.Random, kind: str) -> str:
    tags, names = BAD[kind]
    tag = r.choice(tags)
    plain = tag in ("nav", "aside", "footer", "header", "form") and r.random() < 0.5
    attr = "" if plain else _attr(r, names)
    if kind in ("menu", "share"):
        words = [r.choice(SHORT) if r.random() < 0.5 else _prose(r, 1) for _ in range(r.randint(2, 9))]
        items = "".join(f'<li><a href="/{k}">{OTHER}{w}</a></li>' if r.random() < 0.95 else f"<li>{OTHER}{w}</li>" for k, w in enumerate(words))
        return f"<{tag}{attr}>{items}</{tag}>" if tag == "ul" else f"<{tag}{attr}><ul>{items}</ul></{tag}>"
    if kind == "form":
        return f'<{tag}{attr}><label>{OTHER}{r.choice(SHORT)}</label><input name="q"><button>{OTHER}{r.choice(SHORT)}</button><p>{OTHER}{_prose(r, r.randint(2, 12))}</p></{tag}>'
    if kind == "comments":
        inner = "".join(
            f'<div class="{r.choice(["comment", "comment-body", "reply"])}"><p>{OTHER}{_prose(r, r.randint(2, 60))}</p></div>' if tag in ("section", "div") else f"<li><p>{OTHER}{_prose(r, r.randint(2, 60))}</p></li>"
            for _ in range(r.randint(1, 6))
        )
        head = f"<h3>{OTHER}{_prose(r, 2)}</h3>" if tag in ("section", "div") and r.random() < 0.7 else ""
        return f"<{tag}{attr}>{head}{inner}</{tag}>"
    if kind == "sidebar":
        inner = f"<h3>{OTHER}{_prose(r, 2)}</h3>" + "".join(f'<p>{OTHER}{_prose(r, r.randint(3, 40))}</p>' if r.random() < 0.5 else f'<li><a href="#">{OTHER}{_prose(r, r.randint(2, 8))}</a></li>' for _ in range(r.randint(1, 5)))
        return f"<{tag}{attr}>{inner}</{tag}>"
    if kind == "header":
        return f'<{tag}{attr}><{r.choice(["h1", "h2", "div", "p"])}>{OTHER}{_prose(r, r.randint(1, 5))}</div><p>{OTHER}{_prose(r, r.randint(2, 10))}</p></{tag}>'
    text = ("&copy; " if kind == "footer" else "") + _prose(r, r.randint(2, 45))
    if tag == "p" or r.random() < 0.5:
        return f"<{tag}{attr}>{OTHER}{text}</{tag}>"
    return f"<{tag}{attr}><p>{OTHER}{text}</p><p>{OTHER}{_prose(r, r.randint(2, 20))}</p></{tag}>"


def make_page(r: random.Random) -> str:
    """A page whose blocks start with a mark for article or other."""
    body = [f"<h1>{ARTICLE}{_prose(r, r.randint(2, 10))}</h1>"] if r.random() < 0.85 else []
    for _ in range(r.randint(1, 14)):
        kind, text = r.random(), ARTICLE + _prose(r, r.choice([1, 3, 8, 20, 40, 80, 150]))
        if kind < 0.72:
            body.append(f"<p>{text}" + ("</p>" if r.random() < 0.85 else ""))
        elif kind < 0.80:
            body.append(f"<p><b>{text}<br>")
        elif kind < 0.86:
            body.append(f"<h{r.randint(2, 4)}>{ARTICLE}{_prose(r, r.randint(1, 8))}</h2>".replace("</h2>", "") + "</h2></h3></h4>")
        elif kind < 0.90:
            body.append("<ul>" + "".join(f"<li>{ARTICLE}{_prose(r, r.randint(2, 20))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif kind < 0.94:
            body.append(f"<blockquote>{text}</blockquote>")
        elif kind < 0.97:
            body.append("<table>" + "".join(f"<tr><td>{ARTICLE}{_prose(r, 2)}</td><td>{ARTICLE}{_prose(r, 2)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
        else:
            body.append(_bad(r, r.choice(["ad", "sidebar", "share", "notice"])))
    style = r.random()
    inside = "".join(body) + (_bad(r, r.choice(["share", "comments", "form"])) if r.random() < 0.15 else "")
    if style < 0.55:
        main = f"<article{_attr(r, GOOD_NAMES) if r.random() < 0.3 else ''}>{inside}</article>"
    elif style < 0.7:
        main = f"<main{_attr(r, GOOD_NAMES) if r.random() < 0.3 else ''}>{inside}</main>"
    elif style < 0.95:
        main = f"<div{_attr(r, GOOD_NAMES)}>{inside}</div>"
    else:
        main = inside
    before = [_bad(r, k) for k in ("header", "menu", "notice", "ad", "form", "share") if r.random() < 0.45]
    after = [_bad(r, k) for k in ("comments", "sidebar", "ad", "share", "form", "menu", "notice") if r.random() < 0.35]
    if r.random() < 0.85:
        after.append(_bad(r, "footer"))
    for part in (before, after):
        if r.random() < 0.35:
            part.append(_plain(r))
    r.shuffle(before)
    wrap = r.random() < 0.3
    head = f"<html><head><title>{_prose(r, 5)}</title><style>p{{margin:0}}</style></head><body>"
    page = "".join(before) + ("<div id=\"wrapper\">" if wrap else "") + main + ("</div>" if wrap else "") + "".join(after)
    return head + page + ("</body></html>" if r.random() < 0.9 else "")


def labelled_blocks(page: str) -> tuple[list[Block], list[int]]:
    """Blocks of a composed page without their marks, and whether each is the article's."""
    blocks, labels = [], []
    for b in blocks_of(page):
        labels.append(int(ARTICLE in b.text))
        text = " ".join(b.text.replace(ARTICLE, "").replace(OTHER, "").split())
        blocks.append(Block(text or ".", b.path, b.names, b.link))
    return blocks, labels


# -- operator --------------------------------------------------------------------------


def main_texts(weights: list[np.ndarray], pages: list[str | None], slots: Slots | None = None) -> list[str]:
    """The main text of each page: the blocks that the network takes, by two line feeds."""
    slots = Slots() if slots is None else slots
    blocks = [blocks_of(p) for p in pages]
    chosen = probabilities(weights, [features(b, slots) for b in blocks])
    return ["\n\n".join(b.text for b, p in zip(bs, ps) if p >= 0.5) for bs, ps in zip(blocks, chosen)]


def extract_pages(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url", *, weights: list[np.ndarray] | None = None) -> DataFrame:
    """One row per row: id, url, text, n_chars.

    Null, empty and text-free pages give the empty text.  Pages are read whole; only the
    blocks that the network rejects, scripts, styles, comments and markup go.  Repeated
    rows give repeated results; nulls in the other columns stay; other columns are ignored.
    """
    bounded_batches(pages.sparkSession)
    weights = weights or train()
    id_type, url_type = (pages.select(F.col(c).alias("c")).schema["c"].dataType.simpleString() for c in (id_col, url_col))

    def run(batches):
        slots = Slots()
        for whole in batches:
            for at in range(0, whole.num_rows, 400):
                batch = whole.slice(at, 400)
                texts = main_texts(weights, batch.column(2).to_pylist(), slots)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    names=["id", "url", "text", "n_chars"],
                )

    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = source.mapInArrow(run, f"id {id_type}, url {url_type}, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
