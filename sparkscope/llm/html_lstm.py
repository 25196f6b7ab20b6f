"""A bidirectional LSTM in numpy that labels every block of a page, and the pages it is trained on."""

from __future__ import annotations

import hashlib
import io
import math
import pathlib
import random
import re
from functools import lru_cache
from zlib import crc32

import numpy as np
from pyarrow.fs import FileType

from . import html_blocks
from .files import committed, made_dir, opened, read_bytes
from .html_blocks import MARKER_SLOTS, TAGS, Block, Path, blocks

WORD_SLOTS, HIDDEN = 1024, 16
NUMBERS = 10
_PATH_WIDTH = 2 * len(TAGS) + MARKER_SLOTS + 2
WIDTH = _PATH_WIDTH + WORD_SLOTS + NUMBERS + 1
# Elements that tell what they hold.
_TELLING = frozenset(TAGS.index(t) for t in "nav header footer aside form fieldset article main address details dialog menu ul ol table".split())
_LETTERS = re.compile(r"[^\W\d_]+")
_RIGHTS = re.compile(r"©|\(c\)|\bcopyright\b", re.I)
# Frequent words of four languages.
COMMON = "the of and to in a is that for it was on are as with they at be this from have or by one had not but what all were when we there can your which their said if do will le la de et les des en un une est que dans pour qui sur der die das und in den von zu mit sich auf für ist nicht ein eine als el los las y que un una por con del se no su para es al lo como".split()
_FREQUENT = frozenset([*COMMON, *"you we us i my our me about after before been more most some such than them they these those who would could into over under will up out so".split()])


def path_vector(path: Path) -> np.ndarray:
    """Elements anywhere on the path, the last element, hashed markers, whether there are none, and whether no element tells anything either."""
    v = np.zeros(_PATH_WIDTH, dtype=np.float32)
    for k in path.slots:
        v[k if k < len(TAGS) else len(TAGS) + k] = 1
    if path.last >= 0:
        v[len(TAGS) + path.last] = 1
    if not any(k >= len(TAGS) for k in path.slots):
        v[-2:] = 1, not path.slots & _TELLING
    return v


@lru_cache(maxsize=1 << 16)
def word_slot(w: str) -> int | None:
    """None for words without letters and for frequent ones, which say nothing."""
    m = _LETTERS.search(w)
    return crc32(word.encode()) % WORD_SLOTS if m and (word := m.group().lower()) not in _FREQUENT else None


def text_numbers(b: Block, place: float) -> tuple[float, ...]:
    """Numbers of a block's text, and a constant."""
    n, k = len(b.text), b.text.count(" ") + 1
    return (
        math.log1p(k) / 4, math.log1p(n) / 6, min(1.0, b.linked / n), n / k / 10, b.text[-1] in ".?!:\"'", b.text[0].isupper(), _RIGHTS.search(b.text) is not None, sum(map(b.text.count, "0123456789")) / n, place,
        min(1.0, b.path.depth / 12), 1.0,
    )


def text_words(b: Block) -> tuple[list[int], list[float]]:
    """(slots, weights) of the hashed words of a block; never empty. Words are a hint, the path decides: the weights' length is a third."""
    found: dict[int, int] = {}
    for w in b.text.split(" "):
        if (slot := word_slot(w)) is not None:
            found[slot] = found.get(slot, 0) + 1
    if not found:
        return [0], [0.0]
    length = 3 * math.sqrt(sum(k * k for k in found.values()))
    return [*found], [k / length for k in found.values()]


class Texts:
    """The texts of some pages' blocks as inputs."""

    @classmethod
    def joined(cls, some: list[Texts]) -> Texts:
        out = cls.__new__(cls)
        out.numbers, out.slots, out.weights = (np.concatenate([getattr(t, k) for t in some]) for k in ("numbers", "slots", "weights"))
        blocks_before, words_before = (np.cumsum(n) - n for n in ([len(t.numbers) for t in some], [len(t.slots) for t in some]))
        out.block, out.starts = (np.concatenate([getattr(t, k) + n for t, n in zip(some, before)]) for k, before in (("block", blocks_before), ("starts", words_before)))
        return out

    def __init__(self, pages: list[list[Block]]):
        self.numbers = np.array([text_numbers(b, k / len(bs)) for bs in pages for k, b in enumerate(bs)], dtype=np.float32)
        words = [text_words(b) for bs in pages for b in bs]
        n = np.array([len(slots) for slots, _ in words])
        self.slots, self.weights, self.block = np.array([x for slots, _ in words for x in slots]), np.array([x for _, weights in words for x in weights], dtype=np.float32), np.repeat(np.arange(len(words)), n)
        self.starts = np.cumsum(n) - n

    def sums(self, w: np.ndarray) -> np.ndarray:
        """What the words of each block give, w having a row for each slot."""
        return np.add.reduceat(w[self.slots] * self.weights[:, None], self.starts)


class Layout:
    """Blocks of some pages by step, longest page first, for one direction."""

    def __init__(self, lengths: list[int], backward: bool):
        n = np.array(lengths, dtype=int)
        order = np.argsort(-n, kind="stable")
        first, n = np.concatenate(([0], np.cumsum(n)[:-1]))[order], n[order]
        self.rows = []
        for t in range(int(n.max()) if len(n) else 0):
            k = int((n > t).sum())
            self.rows.append(first[:k] + (n[:k] - 1 - t if backward else t))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(z: np.ndarray, recurrent: np.ndarray, layout: Layout, keep: bool) -> tuple[np.ndarray, list]:
    """(hidden states, what the way back needs) of one direction; z are the inputs' contributions to input, forget, cell and output gates."""
    n = HIDDEN
    h_all = np.zeros((len(z), n), dtype=np.float32)
    h = c = np.zeros((len(layout.rows[0]) if layout.rows else 0, n), dtype=np.float32)
    kept = []
    for rows in layout.rows:
        before_h, before_c = h[: len(rows)], c[: len(rows)]
        a = z[rows] + before_h @ recurrent
        i, f, o = _sigmoid(a[:, :n]), _sigmoid(a[:, n : 2 * n]), _sigmoid(a[:, 3 * n :])
        g = np.tanh(a[:, 2 * n : 3 * n])
        c = f * before_c + i * g
        tc = np.tanh(c)
        h = o * tc
        h_all[rows] = h
        if keep:
            kept.append((rows, before_h, before_c, i, f, g, o, tc))
    return h_all, kept


def _back(dh_all: np.ndarray, kept: list, recurrent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of z, gradient of the recurrent weights)."""
    dz, dr = np.zeros((len(dh_all), 4 * HIDDEN), dtype=np.float32), np.zeros_like(recurrent)
    dh = dc = np.zeros((0, HIDDEN), dtype=np.float32)
    for rows, before_h, before_c, i, f, g, o, tc in reversed(kept):
        dh_t, dc_t = dh_all[rows].copy(), np.zeros((len(rows), HIDDEN), dtype=np.float32)
        dh_t[: len(dh)] += dh
        dc_t[: len(dc)] += dc
        dc_t += dh_t * o * (1 - tc * tc)
        da = np.concatenate((dc_t * g * i * (1 - i), dc_t * before_c * f * (1 - f), dc_t * i * (1 - g * g), dh_t * tc * o * (1 - o)), axis=1)
        dz[rows] = da
        dr += before_h.T @ da
        dh, dc = da @ recurrent.T, dc_t * f
    return dz, dr


def _sums(rows: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each of n groups, all of which have some."""
    order = np.argsort(of, kind="stable")
    return np.add.reduceat(rows[order], np.searchsorted(of[order], np.arange(n)))


class Labeller:
    """probabilities(pages) gives, for each page's blocks, the probability of belonging to the main text.

    Weights: w leads from the inputs to the gates of both directions and to the block's own share of its score, rf and rb are
    recurrent, o leads from the hidden states to the page's share.
    """

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        w = draw(WIDTH, 8 * HIDDEN + 1)
        w[2 * len(TAGS) : _PATH_WIDTH + WORD_SLOTS] = 0  # markers and words never met say nothing
        w[:, -1] = 0
        w[-1, HIDDEN : 2 * HIDDEN] = w[-1, 5 * HIDDEN : 6 * HIDDEN] = 1  # remember at first
        self.p = {"w": w, "rf": draw(HIDDEN, 4 * HIDDEN), "rb": draw(HIDDEN, 4 * HIDDEN), "o": draw(2 * HIDDEN + 1, 1)}
        self.paths: dict[tuple[frozenset[int], int], np.ndarray] = {}

    def _forward(self, z: np.ndarray, lengths: list[int], keep: bool):
        """z: what the inputs give to all gates and to the score."""
        ran = [_run(z[:, i * 4 * HIDDEN : (i + 1) * 4 * HIDDEN], self.p[f"r{d}"], Layout(lengths, d == "b"), keep) for i, d in enumerate("fb")]
        h = np.concatenate([ran[0][0], ran[1][0], np.ones((len(z), 1), dtype=np.float32)], axis=1)
        return h, _sigmoid(h @ self.p["o"] + z[:, -1:])[:, 0], ran

    def fit(self, pages: list[tuple[list[Block], list[int]]], epochs: int = 8, size: int = 40, rate: float = 0.03, seed: int = 3) -> Labeller:
        r, step = np.random.default_rng(seed), 0
        number: dict[tuple[frozenset[int], int], int] = {}
        data = []
        for bs, y in pages:
            if bs:
                of = np.array([number.setdefault(b.path[:2], len(number)) for b in bs])
                own = sum(y)
                weights = np.where(y, min(12.0, max(1.0, (len(y) - own) / max(1, own))), 1.0)  # the main text of a page counts as much as the rest
                data.append((of, Texts([bs]), np.array(y, dtype=np.float32), weights))
        paths = np.array([path_vector(Path(*key, 0)) for key in number])
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            pace = rate * (1 - epoch / epochs)
            order = r.permutation(len(data))
            for at in range(0, len(order), size):
                some = [data[i] for i in order[at : at + size]]
                own, of = np.unique(np.concatenate([a for a, *_ in some]), return_inverse=True)
                lengths, y = [len(a) for a, *_ in some], np.concatenate([c for _, _, c, _ in some])
                texts = Texts.joined([b for _, b, *_ in some])
                # Inputs are dropped at random, words above all, so that no single marker or word decides.
                x = texts.numbers * (r.random(texts.numbers.shape, dtype=np.float32) > 0.05)
                x[:, -1] = 1
                texts.weights *= r.random(len(texts.weights), dtype=np.float32) > 0.4
                above = paths[own] * (r.random((len(own), _PATH_WIDTH), dtype=np.float32) > 0.01)
                w_path, w_words, w_numbers = np.split(self.p["w"], [_PATH_WIDTH, _PATH_WIDTH + WORD_SLOTS])
                z = (above @ w_path)[of] + texts.sums(w_words) + x @ w_numbers
                h, p, ran = self._forward(z, lengths, True)
                miss = ((p - y) * np.concatenate([c for *_, c in some]) / len(y))[:, None].astype(np.float32)
                g, dz = {"o": h.T @ miss}, [miss]
                dh = miss @ self.p["o"].T
                for d, part, (_, kept) in zip("bf", (dh[:, HIDDEN : 2 * HIDDEN], dh[:, :HIDDEN]), ran[::-1]):
                    back, g[f"r{d}"] = _back(part, kept, self.p[f"r{d}"])
                    dz.insert(0, back)
                dz = np.concatenate(dz, axis=1)
                g_words, used = np.zeros_like(w_words), np.unique(texts.slots, return_inverse=True)
                g_words[used[0]] = _sums(dz[texts.block] * texts.weights[:, None], used[1], len(used[0]))
                g["w"] = np.concatenate((above.T @ _sums(dz, of, len(own)), g_words, x.T @ dz))
                step += 1
                for k, v in self.p.items():
                    gk = g[k] + 1e-5 * v
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    s[k] = 0.99 * s[k] + 0.01 * gk * gk
                    v -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def _path(self, path: Path) -> np.ndarray:
        found = self.paths.get(path[:2])
        if found is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            found = self.paths[path[:2]] = path_vector(path) @ self.p["w"][:_PATH_WIDTH]
        return found

    def probabilities(self, pages: list[list[Block]]) -> list[np.ndarray]:
        some = [bs for bs in pages if bs]
        if not some:
            return [np.zeros(0, dtype=np.float32) for _ in pages]
        texts, (_, w_words, w_numbers) = Texts(some), np.split(self.p["w"], [_PATH_WIDTH, _PATH_WIDTH + WORD_SLOTS])
        z = np.array([self._path(b.path) for bs in some for b in bs]) + texts.sums(w_words) + texts.numbers @ w_numbers
        _, p, _ = self._forward(z, [len(bs) for bs in some], False)
        ends = iter(np.split(p, np.cumsum([len(bs) for bs in some])[:-1]))
        return [next(ends) if bs else np.zeros(0, dtype=np.float32) for bs in pages]


# --- training pages ---------------------------------------------------------------------------------------------------

# Markers of main text and of the rest as they are common on the web, and phrases of the rest.
MAIN = "article content post entry story main body text page blog news single hentry document reading prose post-content entry-content post-body article-body article-text richtext copy"
REST = {
    "menu": "nav menu navigation navbar topnav links breadcrumb breadcrumbs tabs pagination pager toc", "header": "header masthead topbar branding logo banner hero",
    "footer": "footer colophon bottom legal copyright credits", "side": "sidebar aside widget related recommended trending popular more teaser", "advert": "ad ads advert advertisement sponsor sponsored promo adsense banner partner outbrain",
    "notice": "cookie notice consent gdpr alert popup modal overlay banner message privacy", "form": "form search newsletter subscribe signup login contact", "comments": "comment comments reply replies responses discussion disqus respond reader commentlist thread", "share": "share social follow tags meta rating", "byline": "meta footer byline author info date posted published labels",
}
PHRASES = {
    "menu": ["Home", "About us", "Contact", "News", "Products", "Accueil", "Startseite", "Inicio", "Next", "Previous"], "header": ["Welcome", "The Daily", "Your source of news", "Skip to content"],
    "footer": ["© 2024 All rights reserved.", "Privacy policy", "Terms of use", "Impressum", "Tous droits réservés", "Aviso legal"], "side": ["Related articles", "Most read", "You may also like", "Read more"],
    "advert": ["Buy now", "Advertisement", "Sponsored", "Special offer: 50% off today", "Anzeige", "Publicité"], "notice": ["We use cookies to improve your experience.", "Accept all", "Your browser is out of date.", "This site uses cookies."],
    "form": ["Your email address", "Subscribe to our newsletter", "Search", "Name", "Password", "Send"], "comments": ["Comments (12)", "Great article!", "Reply", "I disagree with this.", "Leave a comment", "Anonymous says:"],
    "share": ["Share this", "Tweet", "Follow us", "Tags: news", "Like"], "byline": ["Posted by Ann at 10:00", "By Ann", "Published on 3 May 2024", "Labels: news, local", "0 comments", "Written by", "Von Anna", "Par Anne"],
}
ELEMENTS = {"menu": ["nav", "div", "ul", "nav"], "header": ["header", "div"], "footer": ["footer", "div", "footer"], "side": ["aside", "div", "section"], "advert": ["div", "div", "aside", "section"], "notice": ["div", "section", "dialog"], "form": ["form", "form", "div"], "comments": ["section", "div", "ol", "ul"], "share": ["div", "ul"], "byline": ["div", "div", "p", "footer"]}
LETTERS, ACCENTS = "etaoinshrdlucmfwypvbgkjqxz", "äöüßéèêçñáíóú"
PLAIN = ["", "", "", "", "", "", "container", "wrapper", "wrap", "row", "col", "page", "site", "outer", "inner", "layout", "grid", "block", "area", "primary", "box", "js", "top", "the", "content-area"]
#: Words drawn once, from which texts are put together; words of a text.
VOCABULARY, LONGEST = 6000, 60


class Pages:
    """Made-up pages: (html, blocks, labels), from many layouts; words are drawn alike for main text and the rest.

    What isn't main text shows it: by its element, a marker, its links or its phrases. Main text may have any container or none.
    """

    def __init__(self, seed: int = 11):
        self.r = r = random.Random(seed)
        self.made = ["".join(r.choices(LETTERS, k=r.randint(1, 12))) for _ in range(VOCABULARY)]
        self.made = [w[: len(w) // 2] + r.choice(ACCENTS) + w[len(w) // 2 :] if r.random() < 0.1 else w for w in self.made]
        self.style: str | None = None
        self.marks = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "<>&"] + ["&amp;", "&lt;", "&nbsp;", "&#8364;"]

    def pick(self, of):
        return self.r.choice(of)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def upto(self, *most: int) -> int:
        return self.r.randint(1, self.pick(most))

    def words(self, n: int) -> str:
        r = self.r
        found = r.choices(COMMON, k=n) if self.chance(0.2) else r.choices(self.made, k=n)
        if self.chance(0.5):
            found = [r.choice(COMMON) if r.random() < 0.45 else w for w in found]
        style = r.random()
        if style < 0.05:
            found = [w.upper() for w in found]
        elif style < 0.2:  # noise of any kind may stand in any text
            noise = ["".join(r.choices(self.marks, k=r.randint(1, 3))) for _ in range(4)]
            found = [w + r.choice(noise) if r.random() < 0.8 else w for w in found]
        elif style < 0.25:
            found = found[:1] * n
        elif style < 0.35:
            found[r.randrange(n)] = "".join(r.choices("0123456789-:./ ", k=r.randint(2, 16))) + "7"
        found[0] = found[0].capitalize()
        return " ".join(found) + (self.pick(".....?!:") if self.chance(0.8) else "")

    def wrap(self, tag: str, inner: str, markers: str = "") -> str:
        if self.chance(0.1):
            markers = f"{markers} {self.pick(self.made)}-{self.upto(99)}".strip()
        how = f' {self.pick(["class", "class", "id"])}="{markers}"' if markers else ""
        return f"<{tag}{how}>{inner}</{tag}>"

    def marker(self, words: list[str]) -> str:
        w = self.pick(words)
        return self.pick([w, w, f"{w}-{self.pick(['box', 'wrapper', 'area', 'inner', 'body', '1'])}", f"{self.pick(['site', 'page', 'js', 'top', 'the', 'block'])}-{w}", f"{w} {self.pick(words)}", f"{w}_{self.pick(words)}", w.capitalize()])

    def rest(self, kind: str) -> str:
        words = REST[kind].split()
        wordy = kind in ("advert", "comments", "notice", "footer", "side")
        linked = {"menu": 0.95, "side": 0.6, "footer": 0.4, "share": 0.7}.get(kind, 0.1)

        def leaf() -> str:
            t = self.pick(PHRASES[kind]) if self.chance(0.3) else self.words(self.upto(12, 25, LONGEST) if wordy else self.upto(3, 5, 12))
            if kind == "footer" and self.chance(0.5):
                t = f"&copy; {self.pick(['', str(self.r.randint(1995, 2030)), 'www.'])} {t}"
            return f'<a href="/x">{t}</a>' if self.chance(linked) else t

        tag, n = self.pick(ELEMENTS[kind]), self.upto({"menu": 7, "comments": 5, "side": 5}.get(kind, 3))
        marked = f"{self.pick(MAIN.split())}-{self.pick(words)}" if kind == "byline" and self.chance(0.5) else self.marker(words) if kind == "byline" or tag in ("div", "section", "ul", "ol", "aside") or self.chance(0.4) else ""
        if kind == "menu" and self.chance(0.15):  # links alone show what it is
            return self.wrap(self.pick(["div", "p", "ul"]), self.pick([" ", " | ", ""]).join(f'<a href="/x">{self.words(self.upto(3))}</a>' for _ in range(n + 1)))
        if tag in ("ul", "ol"):
            return self.wrap(tag, "".join(self.wrap("li", leaf()) for _ in range(n)), marked)
        if kind in ("menu", "side", "share", "footer") and self.chance(0.6):
            inner = self.wrap("ul", "".join(self.wrap("li", leaf()) for _ in range(n)))
        elif kind == "form":
            inner = "".join(f"<label>{leaf()}</label><input name=x>" + self.pick(["<br>", "", "<p>"]) for _ in range(n))
            if self.chance(0.3):
                inner = self.wrap(self.pick(["p", "h3", "div"]), self.words(self.upto(12, 25))) + inner
        elif n == 1 or self.chance(0.3):
            inner = leaf()
        else:
            inner = "".join(self.wrap(self.pick(["p", "div", "p"]), leaf(), self.pick(words) if self.chance(0.3) else "") for _ in range(n))
        if kind in ("side", "comments") and self.chance(0.5):
            inner = self.wrap(self.pick(["h2", "h3", "h4"]), self.pick(PHRASES[kind])) + inner
        return self.wrap(tag, inner, marked)

    def colophon(self) -> str:
        """The last line of a page, which only its words tell from a paragraph."""
        year = self.pick(["", "1998-", "2001, "]) + str(self.r.randint(1995, 2030))
        text = f"{self.pick(['Copyright', 'Copyright', '&copy;', 'Copyright &copy;', '(c)'])} {self.pick([year, year, ''])} {self.words(self.upto(4))}"
        return self.wrap(self.pick(["div", "div", "p", "center"]), text + self.pick(["", "", " All rights reserved."]))

    def main_part(self) -> str:
        tag = self.style if self.style and self.chance(0.85) else self.pick(["p"] * 12 + ["h2", "h3", "ul", "ul", "ul", "blockquote", "table", "pre", "figure", "open", "open", "div", "dl", "text", "text", "text"])
        if tag == "ul":
            return self.wrap(self.pick(["ul", "ol"]), "".join(self.wrap("li", self.words(self.upto(20))) for _ in range(self.upto(5))))
        if tag == "blockquote":
            return self.wrap(tag, self.wrap("p", self.words(self.upto(30))))
        if tag == "table":
            return self.wrap(tag, "".join("<tr>" + "".join(self.wrap(self.pick(["td", "td", "th"]), self.words(self.upto(6))) for _ in range(3)) + "</tr>" for _ in range(self.upto(3))))
        if tag == "dl":
            return "<dl>" + "".join(f"<dt>{self.words(self.upto(3))}<dd>{self.words(self.upto(20))}" for _ in range(self.upto(3))) + "</dl>"
        if tag == "figure":
            return f"<figure><img src=x>{self.wrap('figcaption', self.words(self.upto(12)))}</figure>"
        if tag in ("h2", "h3"):
            return self.wrap(tag, self.words(self.upto(9)))
        inner = self.words(self.upto(8, 30, LONGEST, LONGEST))
        if self.chance(0.2):
            inner = f"<b>{inner}" + ("</b>" if self.chance(0.6) else "")
        if self.chance(0.2):
            inner += f' <a href="/y">{self.words(self.upto(4))}</a> {self.words(3)}'
        if tag == "text":
            return f"{inner}<br><br>"
        return f"<p>{inner}" + self.pick(["", "<br>"]) if tag == "open" else self.wrap(tag, inner)

    def page(self) -> str:
        """A page's html, every part fenced by control characters that name its label."""
        fence = lambda label, s: f"\x01{label}{s}\x02"
        rest = lambda *kinds: "".join(fence(0, self.rest(k)) for k in kinds)
        some = lambda share, *kinds: rest(*(k for k in self.r.sample(kinds, len(kinds)) if self.chance(share)))
        # On many pages all paragraphs are written alike.
        self.style = self.pick(["p", "p", "div", "text", "text", "open"]) if self.chance(0.35) else None
        parts = [fence(1, self.main_part()) for _ in range(self.upto(1, 1, 2, 4, 8, 12))]
        if self.chance(0.5):
            title = self.words(self.upto(10))
            parts.insert(0, fence(1, f"<b>{title}</b><br><br>" if self.style == "text" and self.chance(0.6) else self.wrap(self.pick(["h1", "h1", "h2"]), title)))
        if self.chance(0.45):
            for _ in range(self.upto(4)):
                parts.insert(self.r.randint(0, len(parts)), rest(self.pick(["advert", "advert", "share", "side", "form", "notice"])))
        inner = "".join(parts)
        if self.chance(0.25):
            inner += some(0.6, "share", "comments")
        byline = rest("byline") if self.chance(0.25) else ""
        if byline and self.chance(0.5):
            inner, byline = inner + byline, ""
        main, kind, alone = MAIN.split(), self.r.random(), False
        if kind < 0.22:
            body, alone = self.wrap("article", inner, self.marker(main) if self.chance(0.4) else ""), True
        elif kind < 0.28:
            body, alone = self.wrap("main", inner), True
        elif kind < 0.5:
            body = self.wrap(self.pick(["div", "div", "section"]), inner, self.pick([self.pick(main), f"{self.pick(main)}-{self.pick(main)}", f"{self.pick(main)} {self.pick(main)}", self.marker(main), self.pick(self.made)]))
        elif kind < 0.75:
            body = self.wrap(self.pick(["div", "section", "center"]), inner)
            if self.chance(0.25):
                links = fence(0, "<br>".join(f'<a href="/x">{self.words(self.upto(3))}</a>' for _ in range(self.upto(5))))
                side = self.pick([self.wrap("td", links, self.marker(REST["menu"].split())), self.wrap("td", some(0.8, "menu"))])
                other = self.pick(["", "", self.wrap("td", some(0.8, "side", "advert")), self.wrap("td", fence(0, f'<a href="/x">{self.words(self.upto(3))}</a><br><a href="/x">{self.words(self.upto(3))}</a>'))])
                last = f"<tr><td colspan=3>{fence(0, self.pick([self.colophon, lambda: f'Copyright {self.words(self.upto(3))}'])())}</td></tr>" if self.chance(0.4) else ""
                body = f"<table><tr>{side}<td>{inner}</td>{other}</tr>{last}</table>"
        else:
            body = inner
        if byline:
            body = self.wrap("div", body + byline, self.pick(["", self.pick(main)]))
        if self.chance(0.35):
            body += some(0.7, "comments", "side", "share")
        for _ in range(self.pick([0, 0, 1, 2, 3])):
            body = self.wrap(self.pick(["div", "div", "div", "main", "section"]), body, f"{self.pick(PLAIN)} {self.pick(PLAIN)}".strip())
        before, after = some(0.6, "notice", "header", "menu", "advert", "side"), some(0.45, "comments", "side", "advert", "share", "form", "menu") + some(0.65, "footer") + some(0.2, "notice")
        if self.chance(0.15):
            after += fence(0, self.colophon())
        if alone and self.chance(0.05):
            before += fence(0, self.wrap(self.pick(["div", "span", "p"]), self.words(self.upto(5))))
        return f"<html><head><title>x</title></head><body>{before}{body}{after}</body></html>"


def training_pages(n: int, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of n made-up pages."""
    made, out = Pages(seed), []
    for _ in range(n):
        html = made.page()
        # Each text carries its label as a first word, taken off again once the blocks are there.
        label, parts = ["0"], []
        for piece in re.split(r"(\x01[01]|\x02|<[^>]*>)", html):
            if piece[:1] == "\x01":
                label.append(piece[1])
            elif piece == "\x02":
                label.pop()
            elif piece.strip():
                parts.append(piece if piece[0] == "<" else f"\x03{label[-1]}{piece}")
        found, labels = [], []
        for b in blocks("".join(parts)):
            text = re.sub(r"\x03[01]", "", b.text).strip()
            if text:
                found.append(Block(b.path, text, min(b.linked, len(text))))
                labels.append(int(b.text[b.text.index("\x03") + 1]))
        out.append((found, labels))
    return out


#: Pages the labeller is trained on.
TRAINING_PAGES = 4000

_trained: dict[int, Labeller] = {}


def trained(pages: int = TRAINING_PAGES, folder: str | None = None) -> Labeller:
    """The labeller, trained once in a process on that many made-up pages, and once in a shared folder if one is given: the weights lie there under a hash of this code."""
    if pages not in _trained:
        code = hashlib.sha256(b"".join(pathlib.Path(f).read_bytes() for f in (__file__, html_blocks.__file__))).hexdigest()[:16]
        name, store, path = f"labeller-{code}-{pages}.npz", *(opened(folder) if folder else (None, None))
        made = Labeller()
        if store is not None and store.get_file_info(f"{path}/{name}").type == FileType.File:
            with np.load(io.BytesIO(read_bytes(folder, name))) as kept:
                made.p = {k: kept[k] for k in made.p}
        else:
            made.fit(training_pages(pages))
            if store is not None:
                raw = io.BytesIO()
                np.savez(raw, **made.p)
                made_dir(folder)
                with committed(folder, name) as out:
                    out.write(raw.getvalue())
        _trained[pages] = made
    return _trained[pages]
