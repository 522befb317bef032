"""Main text of web pages: a recurrent labeller over a page's text blocks.

A page is cut into leaf blocks (text between block-level tags, with the open tags above it). Each
block becomes a vector: hashed tag-path tokens (tags, classes, ids), hashed words, and a few sizes.
A bidirectional LSTM, written in numpy, reads the sequence of a whole page in both directions and
classifies every block with the context of the document. Main blocks are joined in page order.

It is trained on the driver on a bounded sample of the pages. A teacher labels the blocks from
markup that says what it is (inside article or main, and inside nothing like navigation, asides,
forms or comments). So that the network doesn't lean on one template, each sample page is also read
in variants: other containers for the article, boilerplate blocks of other pages put in under
various containers, and path tokens dropped at random.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import hash_sample, read, text_chunks

#: Pages that the network is trained on (the first by hash of their html), variants of each, and characters read of each.
SAMPLE = 240
VARIANTS = 3
MAX_SAMPLE_CHARS = 60_000
PATH_SIZE, WORD_SIZE, SIZES = 96, 32, 8
HIDDEN = 16
EPOCHS = 14
SEED = 5

# HTML's block-level, void and textless elements; names that sites give to containers.
BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol
    optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template textarea svg math iframe object canvas button select".split())
#: Their text runs to the end tag whatever it holds, and to the end of the page without one.
RAW = frozenset("script style textarea".split())
MAIN_NAMES = frozenset("article main content post entry story body-text articlebody".split())
SIDE_NAMES = frozenset("""nav navigation menu menubar breadcrumb breadcrumbs header masthead topbar banner footer bottom
    aside sidebar side rail widget related recommended recommendations ad ads advert advertisement advertising sponsor
    sponsored promo promotion newsletter subscribe signup login search share sharing social cookie cookies consent gdpr
    notice notices alert popup modal overlay form comment comments commentlist reply replies respond discussion
    disqus copyright legal disclaimer pagination pager tags toolbar skip meta head title""".split())
MAIN_CONTAINERS = ("article", "main", "div content", "div post", "section entry", "div story", "main content article",
                   "div post content", "section article")
LEAVES = ("p", "h2", "h3", "li", "blockquote", "pre", "td", "dd", "figcaption")
SIDE_CONTAINERS = ("nav ul li", "nav menu ul li", "header", "header div masthead", "footer", "footer p", "div footer", "aside",
                   "aside p", "div sidebar", "div sidebar widget p", "div ad", "div advert", "section sponsored p", "div promo",
                   "form", "form p", "form div newsletter", "div cookie notice", "div notice", "div alert p", "div popup",
                   "section comments", "section comments div comment p", "ul commentlist li", "div reply", "div related ul li",
                   "div breadcrumb", "div share", "div social", "div login", "div search", "div pagination", "div consent")

KNOWN_NAMES = BLOCK_TAGS | MAIN_NAMES | SIDE_NAMES
#: Weight that a path's other names share, and names from which a path counts as deep.
OTHER_WEIGHT = 1.0
DEEP = 16

TOKEN = re.compile(
    r"(?P<note><!--)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>|<[!?/][^>]*+>")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    path: list[str]
    text: str
    link_chars: int = 0


@dataclass
class _Open:
    tag: str
    names: list[str] = field(default_factory=list)


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order: references decoded, white space made single spaces.

    What stands in a silent element is no text. Only its exact name counts (``svg-icon`` is another
    element); it ends at its end tag, at once if it is written as empty, and is an ordinary element if
    it has no end tag (scripts, styles and text areas then run to the end of the page). Quotes open
    a value only after an equals sign.
    """
    stack: list[_Open] = []
    out: list[Block] = []
    pieces: list[str] = []
    links = 0
    at = 0

    def close() -> None:
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block([n for o in stack for n in o.names], text, links))
            pieces.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            text = html.unescape(raw)
            pieces.append(text)
            if any(o.tag == "a" for o in stack[-4:]):
                links += len(text)

    last = page.rfind(">") + 1
    unclosed: set[str] = set()
    while m := TOKEN.search(page, at, last):
        add(page[at:m.start()])
        at = m.end()
        if m["note"]:
            at = page.find("-->", at) + 3
            if at < 3:
                at = len(page)
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in SILENT and not m["end"]:
            if tag not in RAW and m["rest"].endswith("/"):
                continue
            shut = None if tag in unclosed else re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
            if shut:
                at = shut.end()
                continue
            if tag in RAW:
                at = len(page)
                continue
            unclosed.add(tag)
        block = tag in BLOCK_TAGS
        if block:
            close()
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID_TAGS:
            continue
        if block:
            # a new block ends an open paragraph, a new item an open item beside it
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p" or stack[i].tag == tag == "li":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK_TAGS:
                    break
        names = [tag]
        for a, b, c in NAMED.findall(m["rest"]):
            names += [x for x in SPLIT.split((a or b or c).lower()) if x]
        stack.append(_Open(tag, names))
    rest = page[at:]
    add(rest[:rest.find("<!--")] if "<!--" in rest else rest)
    close()
    return out


def teach(page: list[Block]) -> list[int]:
    """Teacher labels. Pages without any main container: long blocks without links or side names."""
    any_main = any(MAIN_NAMES & set(b.path) for b in page)
    out = []
    for b in page:
        names = set(b.path)
        if names & SIDE_NAMES:
            out.append(0)
        elif any_main:
            out.append(int(bool(names & MAIN_NAMES)))
        else:
            out.append(int(len(b.text.split()) >= 8 and b.link_chars * 3 < len(b.text)))
    return out


def _bucket(name: str, size: int) -> int:
    return xxhash.xxh32_intdigest(name) % size


def features(page: list[Block]) -> np.ndarray:
    """One row per block: hashed tokens of the whole path, all words hashed, sizes."""
    x = np.zeros((len(page), PATH_SIZE + WORD_SIZE + SIZES), np.float32)
    for i, b in enumerate(page):
        row = x[i]
        names = set(b.path)
        other = names - KNOWN_NAMES
        # all names count; many that say nothing by themselves share a weight, so that they drown no other
        for name in names:
            weight = min(1.0, OTHER_WEIGHT / len(other)) if name in other else 1.0
            for at in (_bucket(name, PATH_SIZE), _bucket("2" + name, PATH_SIZE)):
                row[at] = max(row[at], weight)
        words = b.text.split()
        for w, times in Counter(w.lower() for w in words).items():
            row[PATH_SIZE + _bucket(w, WORD_SIZE)] += times / len(words)
        n = len(b.text)
        row[PATH_SIZE + WORD_SIZE:] = (
            min(len(words), 200) / 50, np.log1p(n) / 8, b.link_chars / n, i / len(page),
            min(sum(b.text.count(c) for c in ".,;:!?") / max(len(words), 1), 1), min(len(b.path), DEEP) / 10,
            float(b.text[:1].isupper()), 1.0)
    return x


# --- bidirectional LSTM ---

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    n = PATH_SIZE + WORD_SIZE + SIZES
    w = {}
    for side in "fb":
        w["x" + side] = rng.normal(0, 0.1, (n, 4 * HIDDEN)).astype(np.float32)
        w["h" + side] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        w["c" + side] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
    w["out"] = rng.normal(0, 0.1, 2 * HIDDEN).astype(np.float32)
    w["bias"] = np.zeros(1, np.float32)
    return w


def _read(w, side: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    """One direction over (time, batch, features); padding at the end leaves the state as it is."""
    time, batch, _ = x.shape
    given = x @ w["x" + side] + w["c" + side]
    h = np.zeros((batch, HIDDEN), np.float32)
    c = np.zeros_like(h)
    out, tape = np.zeros((time, batch, HIDDEN), np.float32), []
    for t in range(time) if side == "f" else range(time - 1, -1, -1):
        z = given[t] + h @ w["h" + side]
        i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN:])
        m = mask[t][:, None]
        c_new = m * (f * c + i * g) + (1 - m) * c
        tc = np.tanh(c_new)
        h_new = m * o * tc + (1 - m) * h
        tape.append((t, h, c, i, f, o, g, tc, m))
        h, c = h_new, c_new
        out[t] = h
    return out, tape


def _learn(w, side: str, x: np.ndarray, tape: list, d_out: np.ndarray, grad: dict[str, np.ndarray]) -> None:
    """Back-propagation through time of one direction."""
    dh = np.zeros_like(d_out[0])
    dc = np.zeros_like(dh)
    d_given = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
    for t, h, c, i, f, o, g, tc, m in reversed(tape):
        dh = dh + d_out[t]
        dc = dc + dh * m * o * (1 - tc * tc)
        dz = np.concatenate([dc * m * g * i * (1 - i), dc * m * c * f * (1 - f), dh * m * tc * o * (1 - o),
                             dc * m * i * (1 - g * g)], axis=1)
        grad["h" + side] += h.T @ dz
        d_given[t] = dz
        dh = dz @ w["h" + side].T + dh * (1 - m)
        dc = dc * (m * f + (1 - m))
    flat = d_given.reshape(-1, 4 * HIDDEN)
    grad["x" + side] += x.reshape(-1, x.shape[2]).T @ flat
    grad["c" + side] += flat.sum(axis=0)


def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    time = max(len(p) for p in pages)
    x = np.zeros((time, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((time, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[:len(p), j] = p
        mask[:len(p), j] = 1
    return x, mask


def predict(w: dict[str, np.ndarray], pages: list[np.ndarray]) -> list[np.ndarray]:
    """Probability of main text per block; pages of like length are read together."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        # padded blocks of one batch are bounded; the longest page is the last
        take = at + 1
        while take < len(order) and take - at < 256 and len(pages[order[take]]) * (take + 1 - at) <= 16384:
            take += 1
        part = order[at:take]
        x, mask = _pad([pages[i] for i in part])
        both = np.concatenate([_read(w, "f", x, mask)[0], _read(w, "b", x, mask)[0]], axis=2)
        p = _sigmoid(both @ w["out"] + w["bias"])
        for j, i in enumerate(part):
            out[i] = p[:len(pages[i]), j]
        at = take
    return out


def train(sample: list[str], seed: int = SEED, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Weights from html pages, labelled by the teacher."""
    rng, pick = np.random.default_rng(seed), random.Random(seed)
    pages = [p for p in map(blocks, sample) if p]
    pool = [b.text for p in pages for b in p] or ["text"]
    data = []
    for p in pages:
        label = teach(p)
        data.append((features(p), np.array(label, np.float32)))
        for _ in range(VARIANTS):
            v, y = _variant(p, label, pool, pick)
            data.append((features(v), np.array(y, np.float32)))
    w = new_weights(rng)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(data)).tolist(), key=lambda i: len(data[i][1]) // 8)
        groups = [order[i:i + 16] for i in range(0, len(order), 16)]
        pick.shuffle(groups)
        for group in groups:
            x, mask = _pad([data[i][0] for i in group])
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(group):
                y[:len(data[i][1]), j] = data[i][1]
            (of, tf), (ob, tb) = _read(w, "f", x, mask), _read(w, "b", x, mask)
            both = np.concatenate([of, ob], axis=2)
            d = (_sigmoid(both @ w["out"] + w["bias"]) - y) * mask / mask.sum()
            grad = {k: np.zeros_like(v) for k, v in w.items()}
            grad["out"] += np.einsum("tb,tbh->h", d, both)
            grad["bias"] += d.sum()
            d_both = d[:, :, None] * w["out"]
            _learn(w, "f", x, tf, d_both[:, :, :HIDDEN], grad)
            _learn(w, "b", x, tb, d_both[:, :, HIDDEN:], grad)
            step += 1
            rate = 0.01 * (1 - epoch / (epochs + 1))
            for k, g in grad.items():  # Adam
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-7)
    return w


def _variant(page: list[Block], label: list[int], pool: list[str], pick: random.Random) -> tuple[list[Block], list[int]]:
    """A page with other containers, more boilerplate and some path tokens dropped; labels stay true."""
    main = pick.choice(MAIN_CONTAINERS).split()
    new, y = [], []

    def side(inside: bool) -> None:
        path = ["html", "body", *(main if inside else []), *pick.choice(SIDE_CONTAINERS).split()]
        for _ in range(pick.randint(1, 3)):
            words = pick.choice(pool).split()
            at = pick.randrange(len(words))
            text = " ".join(words[at:at + pick.choice((2, 6, 20, 60))])
            new.append(Block(path, text, len(text) if path[-1] == "li" and pick.random() < 0.7 else 0))
            y.append(0)

    for _ in range(pick.randint(0, 2)):
        side(False)
    for i, (b, good) in enumerate(zip(page, label)):
        path = b.path
        if good:
            tail = [n for n in path if n not in MAIN_NAMES and n not in ("html", "body")]
            path = ["html", "body", *main, *tail]
            if tail and pick.random() < 0.15:
                path[-1] = pick.choice(LEAVES)
            if i and pick.random() < 0.12:
                side(True)
        elif pick.random() < 0.3:
            path = ["html", "body", *pick.choice(SIDE_CONTAINERS).split()]
        if pick.random() < 0.2:
            path = [n for n in path if n in MAIN_NAMES or n in SIDE_NAMES or pick.random() < 0.7]
        new.append(Block(path, b.text, b.link_chars))
        y.append(good)
    for _ in range(pick.randint(0, 3)):
        side(pick.random() < 0.4)
    return new, y


def fit(pages: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Train on at most ``sample`` pages, of each at most the first ``MAX_SAMPLE_CHARS`` (a bounded collect).

    The cut is for training only; extraction reads whole pages.
    """
    rows = pages.where(F.length("html") > 0).select(F.substring("html", 1, MAX_SAMPLE_CHARS).alias("html"))
    return train(hash_sample(rows, "html", sample, SEED))


def extract(pages: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main) of every row of ``pages`` (page_id, url, html).

    Null and empty html give an empty text. Repeated rows and null ids are extracted like others; an
    empty table gives an empty result; extra columns are ignored.
    """
    known = pages.sparkSession.sparkContext.broadcast(weights)
    d = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "html", 1 << 21):
            cut = [blocks(t.decode("utf-8", "replace")) for t in texts]
            chance = predict(known.value, [features(p) for p in cut])
            main = [[b.text for b, c in zip(p, q) if c >= 0.5] for p, q in zip(cut, chance)]
            text = ["\n".join(m) for m in main]
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64()),
                pa.array(list(map(len, cut)), pa.int64()), pa.array(list(map(len, main)), pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    return d.mapInArrow(run, f"page_id {d.schema['page_id'].dataType.simpleString()}, url string, text string, "
                             "n_chars bigint, n_blocks bigint, n_main bigint")


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
