"""Personal data by a skip-chain conditional random field.

Four exact patterns give the base spans. The field adds what they miss: its nodes are the tokens
of a document that hold a digit or an at sign, its labels the four kinds or none. Neighbouring
tokens share chain potentials; distant tokens that repeat or resemble each other (same letters and digits,
same or same last digits, same user name, same start of an address, one character apart) share skip
potentials, and loopy message passing carries a kind between them. Node weights (shapes and the words
around) come from softmax regression, chain weights from label counts, both on the patterns' own labels in a
bounded sample of documents and on ``labelled_texts``, written by rule with forms that no pattern knows.

Defined results: a null or empty text has no spans and the checksum of the empty string; a text is read
whole, at any length; of two kinds that are equally likely the earlier counts; spans that begin together are
ordered by kind; repeated rows are looked at row by row; an empty table gives no rows; other columns are
ignored. Equal tokens are linked in a chain, not in pairs, so a document of one repeated token costs as much as
any other of its length.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fixed_sample, table, text_rows

KINDS = ("email", "ip", "card", "phone")
#: Documents with a digit or an at sign that the weights are learned from at most.
TRAIN_DOCS = 400
ROUNDS = 6
#: Log potential of two tokens having one kind: of equal ones, and of similar ones.
SAME, SIMILAR = 8.0, 7.0
#: A token is added when the field is at least this sure of its kind.
SURE = 0.9
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[]at[)\]]", re.IGNORECASE)
_USER = re.compile(r"([A-Za-z0-9._%+-]{4,})(?:@|[(\[]at[)\]])", re.IGNORECASE)
_SUBNET = re.compile(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?=\.)")
_TOKEN = re.compile(r"\S+")
_DIGITS = re.compile(r"[0-9]")
_LENGTH = re.compile(r"9[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each at sign backwards, so that long runs of letters are read once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the patterns, in order."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


@dataclass(frozen=True)
class Weights:
    node: dict[str, tuple[float, ...]]
    chain: tuple[tuple[float, ...], ...]


@dataclass
class Nodes:
    """Candidate tokens of one document: where they are, what they look like, what a pattern says."""

    at: list[tuple[int, int]]
    shape: list[list[str]]
    label: np.ndarray  # -1: no pattern covers it
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int, float]]


def shape_of(token: str) -> str:
    """Digit runs by length, letter runs as one letter, anything else as it is."""
    kind = re.sub(r"[^\W\d_]+", "a", token[:64])
    return re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", kind)


def likenesses(token: str) -> dict[str, float]:
    """Keys that tokens share with their like, and how much that says."""
    plain = "".join(c for c in token.lower() if c.isalnum())
    digits = "".join(c for c in plain if c in "0123456789")
    keys: dict[str, float] = {}
    if len(plain) >= 6:
        keys[plain] = SAME
    if len(digits) >= 7:
        keys["#" + digits] = SAME
        keys["~" + digits[-7:]] = SIMILAR
    if len(plain) >= 8 and digits:  # one character apart: one half is the same
        half = len(plain) // 2
        keys[f"<{len(plain)}{plain[:half]}"] = keys[f">{len(plain)}{plain[half:]}"] = SIMILAR
    if m := _USER.search(token):
        keys["@" + m[1].lower()] = SIMILAR
    if m := _SUBNET.search(token):
        keys["." + m[0]] = SIMILAR
    return keys


def one_apart(a: str, b: str) -> bool:
    a, b = ("".join(c for c in x.lower() if c.isalnum()) for x in (a, b))
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= 1


def nodes_of(text: str, spans: list[tuple[int, int, int]]) -> Nodes:
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    own = [i for i, (a, b) in enumerate(tokens) if _ANY.search(text, a, b)]
    label, j = np.full(len(own), -1, np.int64), 0
    for n, i in enumerate(own):
        a, b = tokens[i]
        while j < len(spans) and spans[j][2] <= a:
            j += 1
        covering = [k for s, k, e in spans[j : j + 4] if s < b and e > a]
        if covering:
            label[n] = covering[0] + 1
    word = lambda i: text[slice(*tokens[i])][:32].lower().strip(".,:;!?()[]\"'") if 0 <= i < len(tokens) else ""
    shapes = []
    for i in own:
        digits = "".join(c for c in text[tokens[i][0] : min(tokens[i][1], tokens[i][0] + 64)] if c in "0123456789")
        check = f"l{luhn(digits)}" if 13 <= len(digits) <= 19 else "l"
        here = shape_of(text[slice(*tokens[i])])
        before = shape_of(text[slice(*tokens[i - 1])]) if i else "^"
        after = shape_of(text[slice(*tokens[i + 1])]) if i + 1 < len(tokens) else "$"
        shapes.append([f"0{here}", f"-{before}", f"+{after}", f"w{word(i - 1)}", f"v{word(i - 2)}", f"z{here} {word(i - 1)}", f"c{_LENGTH.sub('9', here)}", check, "bias"])
    chain = [(n - 1, n) for n in range(1, len(own)) if own[n] == own[n - 1] + 1]
    skip, seen = {}, {}
    for n, i in enumerate(own):
        for key, weight in likenesses(text[slice(*tokens[i])]).items():
            last = seen.get(key)
            if last is not None and (key[0] not in "<>" or one_apart(text[slice(*tokens[own[last]])], text[slice(*tokens[i])])):
                skip[last, n] = max(skip.get((last, n), 0.0), weight)
            seen[key] = n
    return Nodes([tokens[i] for i in own], shapes, label, chain, [(a, b, w) for (a, b), w in skip.items()])


def labelled_texts(n: int = 500, seed: int = 23) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Sentences with personal data in forms that patterns find and miss, and with numbers that are none."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    letters = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    octets = lambda k: ".".join(str(rng.randrange(256)) for _ in range(k))
    user = lambda: letters(3, 8) + rng.choice(["", ".", "_"]) + letters(2, 6) + rng.choice(["", digits(2)])
    site = lambda: f"{letters(3, 9)}.{rng.choice(['com', 'org', 'net'])}"
    forms = {
        0: (["mail", "email", "e-mail", "write to", "address", "contact", "from"], [lambda: f"{user()}@{site()}", lambda: f"{user()}@{letters(3, 8)}", lambda: f"{user()}(at){site()}", lambda: f"{user()}[at]{letters(3, 8)}[dot]com"]),
        1: (["ip", "host", "server", "ip address", "login from", "client"], [lambda: octets(4), lambda: octets(3) + ".x", lambda: octets(3) + ".*", lambda: octets(4) + ":" + digits(4)]),
        2: (["card", "card number", "visa", "credit card", "paid with"], [lambda: "4" + digits(15), lambda: "-".join(digits(4) for _ in range(4)), lambda: "xxxx-xxxx-xxxx-" + digits(4), lambda: "****" + digits(4)]),
        3: (["phone", "call", "tel", "mobile", "dial", "fax", "ring"], [lambda: f"+{digits(11)}", lambda: f"{digits(3)}-{digits(4)}", lambda: f"({digits(3)}){digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}"]),
    }
    clean = [lambda: digits(rng.randint(1, 6)), lambda: f"{rng.randint(1900, 2030)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{digits(1)}.{digits(2)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"${digits(3)}", lambda: f"{digits(2)}%", lambda: letters(1, 3) + digits(3), lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 32, 40]))), lambda: digits(rng.randint(7, 12)), lambda: digits(rng.randint(13, 19)), lambda: f"page {digits(2)}", lambda: "@" + letters(3, 9), lambda: f"{digits(4)}-{digits(4)}"]
    plain = ["token", "version", "order", "in", "about", "chapter", "room", "the", "of", "and", "total", "number", "="]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 5)):
            text += " ".join(letters(2, 9) for _ in range(rng.randint(1, 8))) + " "
            if rng.random() < 0.5:
                kind = rng.randrange(4)
                cue, form = rng.choice(forms[kind][0]), rng.choice(forms[kind][1])()
                text += cue + rng.choice([" ", ": ", " "])
                spans.append((len(text), kind, len(text) + len(form)))
                text += form + rng.choice([" ", ". ", ", "])
            else:
                text += f"{rng.choice([*plain, letters(2, 8)])} {rng.choice(clean)()} "
        out.append((text, spans))
    return out


def learn(texts: list[str], epochs: int = 150, rate: float = 1.0) -> Weights:
    """Softmax regression for the nodes, smoothed label counts for the chain."""
    k = len(KINDS) + 1
    index: dict[str, int] = {}
    rows, labels, pairs = [], [], np.ones((k, k))
    for text, spans in [*labelled_texts(), *((t, base_spans(t)) for t in texts)]:
        nodes = nodes_of(text, spans)
        y = np.maximum(nodes.label, 0)
        rows += [[index.setdefault(f, len(index)) for f in s] for s in nodes.shape]
        labels += y.tolist()
        for a, b in nodes.chain:
            pairs[y[a], y[b]] += 1
    chain = np.log(pairs * pairs.sum() / (pairs.sum(1, keepdims=True) * pairs.sum(0, keepdims=True)))
    x, y, w = np.array(rows), np.array(labels), np.zeros((len(index), k))
    target = np.eye(k)[y]
    often = np.bincount(x.ravel(), minlength=len(index))[:, None]
    flat = x.ravel()
    order = np.argsort(flat, kind="stable")
    first = np.searchsorted(flat[order], np.arange(len(index)))
    for _ in range(epochs):
        z = w[x].sum(1)
        p = np.exp(z - z.max(1, keepdims=True))
        error = target - p / p.sum(1, keepdims=True)
        step = np.add.reduceat(error[order // x.shape[1]], first)
        w += rate * (step / (often + 2) - 0.001 * w)
    return Weights({f: tuple(w[i]) for f, i in index.items()}, tuple(map(tuple, np.clip(chain, -2, 2))))


def marginals(nodes: Nodes, weights: Weights, rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product over the chain and skip edges; nodes a pattern covers are held."""
    k = len(KINDS) + 1
    unknown = (0.0,) * k
    unary = np.array([np.sum([weights.node.get(f, unknown) for f in s], axis=0) for s in nodes.shape]).reshape(-1, k)
    held = nodes.label >= 0
    unary[held] = -30.0
    unary[held, nodes.label[held]] = 30.0
    edges = np.array(nodes.chain + [(a, b) for a, b, _ in nodes.skip], np.int64).reshape(-1, 2)
    if not len(edges):
        belief = np.exp(unary - unary.max(1, keepdims=True))
        return belief / belief.sum(1, keepdims=True)
    pair = np.concatenate([np.repeat(np.array(weights.chain)[None], len(nodes.chain), 0), np.eye(k) * np.array([w for _, _, w in nodes.skip])[:, None, None]])
    source, target = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    potential = np.concatenate([pair, pair.transpose(0, 2, 1)])
    back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
    message = np.zeros((len(source), k))
    for _ in range(rounds):
        total = unary.copy()
        np.add.at(total, target, message)
        cavity = total[source] - message[back]
        joint = cavity[:, :, None] + potential
        top = joint.max(1)
        new = top + np.log(np.exp(joint - top[:, None, :]).sum(1))
        message = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
    total = unary.copy()
    np.add.at(total, target, message)
    belief = np.exp(total - total.max(1, keepdims=True))
    return belief / belief.sum(1, keepdims=True)


def spans_of(text: str, weights: Weights) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: those of the field are clear of the base ones."""
    base = base_spans(text)
    if not _ANY.search(text):
        return base, base
    nodes = nodes_of(text, base)
    belief = marginals(nodes, weights)
    best = belief.argmax(1)
    fine = (best > 0) & (belief.max(1) >= SURE) & (nodes.label < 0)
    together = set(nodes.chain)
    added: list[tuple[int, int, int]] = []
    last = -1
    for n in np.flatnonzero(fine).tolist():
        (a, b), kind = nodes.at[n], int(best[n]) - 1
        inner = [i for i in range(a, b) if text[i].isalnum()]
        a, b = (inner[0], inner[-1] + 1) if inner else (a, b)
        if last >= 0 and (last, n) in together and added[-1][1] == kind:
            added[-1] = (added[-1][0], kind, b)  # neighbours of one kind are one span
        else:
            added.append((a, kind, b))
        last = n
    return base, sorted(base + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def training_texts(docs: DataFrame, most: int = TRAIN_DOCS) -> list[str]:
    """At most ``most`` whole texts with a digit or an at sign, the same at any partitioning."""
    likely = docs.filter(F.col("text").rlike("[0-9@]")).select("doc_id", "text")
    return [r[0] for r in fixed_sample(likely, ["doc_id", "text"], most).select("text").collect()]


def find(docs: DataFrame, weights: Weights) -> DataFrame:
    """One row for each document: counts and digest of the base spans, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # shapes of TRAIN_DOCS texts
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def look(batches):
        own = shared.value
        for batch in batches:
            counts, digests, strings = [[] for _ in KINDS], [], []
            for text in batch.column("text").to_pylist():
                base, spans = spans_of(text, own)
                for k, column in enumerate(counts):
                    column.append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                strings.append(joined(spans))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(strings, pa.string())], names=names)

    return text_rows(docs).mapInArrow(look, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted_text(text: str, weights: Weights) -> str:
    out, last = [], 0
    for start, kind, end in spans_of(text, weights)[1]:
        if end <= last:
            continue
        out += [text[last : max(start, last)], f"[{KINDS[kind].upper()}]" if start >= last else ""]
        last = end
    return "".join([*out, text[last:]]) if out else text


def redaction(spark: SparkSession, weights: Weights, text: Column) -> Column:
    """The text with every span replaced by its kind; a text without spans as it is."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted_text(t, shared.value) for t in texts], dtype=object)

    return redact(text)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, learn(training_texts(docs)))
