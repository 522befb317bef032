"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from four fixed patterns. A random field then labels the tokens of the whole
document (outside, or one of the kinds) and adds spans the patterns miss:

* every token that carries a digit or an @, and every token spelled like one, is a node; all other
  tokens are fixed to *outside*, which cuts the chain into short pieces and leaves inference exact
  about them;
* a node's own potential is a softmax over hashed shape features of the token and its neighbours;
* neighbouring nodes share a chain potential; tokens of one document with the same letters and
  digits (case and a possessive ending aside), however far apart, share a skip potential through one
  hub node, so a token that comes a thousand times adds a thousand links, and each is two links from
  every other. Tokens with the same last seven digits share a second hub. Tokens of up to three
  characters have no hub: they say too little of what they stand for;
* nodes that base spans cover are clamped, and the hubs over them take their labels, so every repeat
  gets the same evidence. Sum-product messages are passed over all links at once until they stay
  (at most ``ROUNDS`` times, damped after ``FREE_ROUNDS``).

Weights are trained piecewise (own potentials by gradient steps; chain and skip potentials from the
log odds of the labels that meet) on a bounded sample of documents, labelled by their base spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import hash_sample, read, text_chunks

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)

#: Documents with a digit or an @ that the field is fitted on (the first by hash of their text), and characters read of each.
SAMPLE = 3000
MAX_SAMPLE_CHARS = 20_000
FEATURES = 1 << 12
FACTS = 10
ROUNDS = 200
FREE_ROUNDS = 30
#: Change of a log message below which it counts as unchanged.
STILL = 1e-6
#: Last digits that similar tokens share.
TAIL = 7
#: Marginal from which a token outside the base spans is added.
CERTAIN = 0.95
SEED = 7

# The patterns of the contract. Possessive repeats and look-behinds change no match,
# they keep long runs linear.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
POSSESSIVE = re.compile(r"['\u2019][sS]$")
TRIM = "\"'()[]{}<>.,;:!?*#$%&|"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i & 1:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each @ with the run of name characters before it, none used twice."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in EMAIL_NAME:
            start -= 1
        m = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns by start, then kind."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) < 4 and int(p or 0) < 256 for p in parts):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# --- the field ---

def link_key(key: str) -> str:
    """Letters and digits of a trimmed, case-folded token."""
    return "".join(c for c in key if c.isalnum())


def owned(word: str) -> str:
    """A word without its possessive ending."""
    bare = word.rstrip(TRIM)
    return POSSESSIVE.sub("", bare) if POSSESSIVE.search(bare) else word


class Nodes:
    """Candidate tokens of some documents with their features and links."""

    def __init__(self, texts: list[str], spans: list[list[tuple[int, int, int]]]):
        self.doc, self.start, self.end, self.gold, rows = [], [], [], [], []
        chain, skip, hub = [], [], []
        self.hubs = 0
        for i, text in enumerate(texts):
            if not DIGIT.search(text) and "@" not in text:
                continue
            tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
            words = [text[a:b] for a, b in tokens]
            keys = [owned(w).strip(TRIM).casefold() for w in words]
            same = [link_key(k) for k in keys]
            like = {k for k, w in zip(same, words) if k and (DIGIT.search(w) or "@" in w)}
            label = self._labels(tokens, spans[i])
            groups: dict[str, list[int]] = {}
            before = -2
            for j, (a, b) in enumerate(tokens):
                if same[j] not in like:
                    continue
                n = len(self.doc)
                lead = len(words[j]) - len(words[j].lstrip(TRIM))
                self.doc.append(i)
                self.start.append(a + lead)
                self.end.append(a + lead + len(keys[j]) if len(keys[j]) <= b - a - lead else b)
                self.gold.append(label[j])
                rows.append(self._features(words, keys, j))
                if before == j - 1:
                    chain.append((n - 1, n))
                before = j
                if len(keys[j]) > 3:
                    groups.setdefault(same[j], []).append(n)
            tails: dict[str, list[list[int]]] = {}
            for key, members in groups.items():
                skip += zip(members, members[1:])
                digits = "".join(DIGIT.findall(key))
                if len(digits) >= TAIL:
                    tails.setdefault(digits[-TAIL:], []).append(members)
            similar = [[n for members in g for n in members] for g in tails.values() if len(g) > 1]
            for members in [g for g in groups.values() if len(g) > 1] + similar:
                hub += [(n, self.hubs) for n in members]
                self.hubs += 1
        self.features = np.array(rows, np.int64).reshape(-1, FACTS)
        self.gold = np.array(self.gold, np.int64)
        self.chain = np.array(chain, np.int64).reshape(-1, 2)
        self.skip = np.array(skip, np.int64).reshape(-1, 2)
        self.hub = np.array(hub, np.int64).reshape(-1, 2)

    @staticmethod
    def _labels(tokens, spans) -> list[int]:
        label = [0] * len(tokens)
        j = 0
        for s, k, e in spans:
            while j and tokens[j - 1][1] > s:
                j -= 1
            while j < len(tokens) and tokens[j][1] <= s:
                j += 1
            i = j
            while i < len(tokens) and tokens[i][0] < e:
                label[i] = label[i] or k + 1
                i += 1
        return label

    @staticmethod
    def _features(words: list[str], keys: list[str], j: int) -> list[int]:
        def shape(w: str) -> str:
            w = w[:64]
            return "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in w)

        word = owned(words[j])
        full = shape(word.strip(TRIM + "+"))
        squeezed = re.sub(r"(.)\1+", r"\1", full)
        digits = sum(c.isdigit() for c in word)
        facts = ("bias", f"full {full}", f"squeezed {squeezed}", f"digits {min(digits, 20)}", f"length {min(len(word), 24)}",
                 f"dots {word.count('.')}", f"at {'@' in word} {word.count('.') > 1}",
                 f"all {digits == len(keys[j])}", f"before {shape(words[j - 1])[:12] if j else '^'}",
                 f"after {shape(words[j + 1])[:12] if j + 1 < len(words) else '$'}")
        return [xxhash.xxh32_intdigest(f) % FEATURES for f in facts]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(texts: list[str], steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict[str, np.ndarray]:
    """Piecewise weights from documents labelled by their base spans."""
    nodes = Nodes(texts, [base_spans(t) for t in texts])
    own = np.zeros((FEATURES, LABELS))
    own[:, 0] = 0.01
    if len(nodes.gold):
        want = np.eye(LABELS)[nodes.gold]
        grad2 = np.full_like(own, 1e-6)
        for _ in range(steps):
            off = (_softmax(own[nodes.features].sum(axis=1)) - want) / len(want)
            grad = np.zeros_like(own)
            for f in range(nodes.features.shape[1]):
                np.add.at(grad, nodes.features[:, f], off)
            grad += decay * own / len(want)
            grad2 += grad * grad
            own -= rate * grad / np.sqrt(grad2)

    def pair(links: np.ndarray, bound: float) -> np.ndarray:
        met = np.full((LABELS, LABELS), 0.5)
        np.add.at(met, (nodes.gold[links[:, 0]], nodes.gold[links[:, 1]]), 1.0)
        met = (met + met.T) / 2
        odds = np.log(met * met.sum() / np.outer(met.sum(1), met.sum(0)))
        return np.clip(odds, -bound, bound)

    return {"own": own, "chain": pair(nodes.chain, 2.0), "skip": pair(nodes.skip, 4.0)}


def marginals(nodes: Nodes, weights: dict[str, np.ndarray], clamped: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product beliefs of all nodes; ``clamped`` nodes are fixed to their base label.

    A hub over clamped nodes has the shares of their labels as its own potential.
    """
    own = weights["own"][nodes.features].sum(axis=1)
    own -= own.max(axis=1, keepdims=True)
    own[clamped] = np.where(np.eye(LABELS, dtype=bool)[nodes.gold[clamped]], 0.0, -50.0)
    links = np.concatenate([nodes.chain, nodes.hub + [0, len(own)]])
    if not len(links):
        return _softmax(own)
    psi = np.exp(np.concatenate([np.repeat(weights["chain"][None], len(nodes.chain), 0),
                                 np.repeat(weights["skip"][None], len(nodes.hub), 0)]))
    known = nodes.hub[clamped[nodes.hub[:, 0]]]
    share = np.zeros((nodes.hubs, LABELS))
    np.add.at(share, (known[:, 1], nodes.gold[known[:, 0]]), 1.0)
    total = share.sum(axis=1, keepdims=True)
    share = np.where(total > 0, np.log(np.maximum(share / np.maximum(total, 1), np.exp(-50.0))), 0.0)
    own = np.concatenate([own, share])
    src = np.concatenate([links[:, 0], links[:, 1]])
    dst = np.concatenate([links[:, 1], links[:, 0]])
    back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
    psi = np.concatenate([psi, psi.transpose(0, 2, 1)])
    log_message = np.zeros((len(src), LABELS))
    for turn in range(rounds):
        belief = own.copy()
        np.add.at(belief, dst, log_message)
        out = _softmax(belief[src] - log_message[back])
        message = np.einsum("ea,eab->eb", out, psi)
        new = np.log(np.maximum(message / message.sum(axis=1, keepdims=True), 1e-30))
        still = np.abs(new - log_message).max() < STILL
        log_message = new if turn < FREE_ROUNDS else (new + log_message) / 2
        if still:
            break
    belief = own.copy()
    np.add.at(belief, dst, log_message)
    return _softmax(belief[:len(nodes.gold)])


def find(texts: list[str], weights: dict[str, np.ndarray], certain: float = CERTAIN) -> list[tuple[list, list]]:
    """(base spans, all spans) per text; added spans touch no base span."""
    base = [base_spans(t) for t in texts]
    nodes = Nodes(texts, base)
    extra: list[list] = [[] for _ in texts]
    if len(nodes.gold):
        belief = marginals(nodes, weights, nodes.gold > 0)
        best = belief[:, 1:].argmax(axis=1)
        sure = (nodes.gold == 0) & (belief[np.arange(len(best)), best + 1] >= certain)
        for n in np.flatnonzero(sure).tolist():
            if nodes.end[n] > nodes.start[n]:
                extra[nodes.doc[n]].append((nodes.start[n], int(best[n]), nodes.end[n]))
    return [(b, sorted(b + x)) for b, x in zip(base, extra)]


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Weights fitted on at most ``sample`` documents of ``docs`` (text), the first by text hash.

    Of each the first ``MAX_SAMPLE_CHARS`` are read for it; the search reads whole texts.
    """
    rows = docs.select(F.substring("text", 1, MAX_SAMPLE_CHARS).alias("text")).where(F.col("text").rlike("[0-9@]"))
    return train(hash_sample(rows, "text", sample, SEED))


def find_personal_data(docs: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row.

    The counts and the digest are of the base spans; ``spans`` holds all of them with those that the
    field adds. Null texts are empty; null ids, repeated rows and empty tables need no special care.
    """
    known = docs.sparkSession.sparkContext.broadcast(weights)
    d = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "text", 1 << 20):
            found = find([t.decode("utf-8", "replace") for t in texts], known.value)
            counts = [[sum(k == kind for _, k, _ in b) for b, _ in found] for kind in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([
                part.column(0), *[pa.array(c, pa.int64()) for c in counts],
                pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found]),
                pa.array([listed(a) for _, a in found]),
                pa.array([len(a) - len(b) for b, a in found], pa.int64()),
            ], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_email bigint, n_ip bigint, "
                             "n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")


def mask(text: str, spans) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with personal data masked in ``text``, and ``n_chars`` (if there) counted again.

    Null texts stay null; other columns stay as they are.
    """
    known = docs.sparkSession.sparkContext.broadcast(weights)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "text", 1 << 20):
            plain = [t.decode("utf-8", "replace") for t in texts]
            clean = [mask(t, a) for t, (_, a) in zip(plain, find(plain, known.value))]
            null = part.column(names.index("text")).is_null().to_pylist()
            columns = part.columns
            columns[names.index("text")] = pa.array([None if n else c for n, c in zip(null, clean)], pa.string())
            if "n_chars" in names:
                kind = part.schema.field("n_chars").type
                columns[names.index("n_chars")] = pa.array([None if n else len(c) for n, c in zip(null, clean)], kind)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return find_personal_data(docs, fit(docs))
