"""Personal data by a skip-chain conditional random field over candidate tokens.

Candidates are the matches of the base patterns and tokens that look like parts or other
spellings of them. They are the nodes of one graph for each document: neighbours in the
text are linked, and so are occurrences, however distant, that share a key (the same
digits, the same address or its local part). Loopy belief propagation over both kinds of
links makes the labels of a document agree; base matches are evidence and keep theirs.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factdrift.llm.common import map_batches, strings
from factdrift.llm.spans import SPANS, span_column

# The kinds in the order in which ties are listed, and their patterns.
KINDS = ["email", "ip", "card", "phone"]
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBER = re.compile(r"(?<![\w.+-])\(?[0-9][\x20().0-9-]{5,}[0-9](?![\w-])")
_DIGITS = re.compile(r"[0-9]")
_ANY = re.compile(r"[0-9@]")
LABELS = ["none", *KINDS]

SAMPLE_DOCUMENTS = 2_000
MAX_GAP = 200
ROUNDS = 500
LEAST_LOCAL = 5


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))) % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the four patterns, leftmost and not overlapping within a kind."""
    if not _ANY.search(text):
        return []
    spans = [("email", *span) for span in _emails(text)]
    for kind, pattern, holds in (
        ("ip", _IP, lambda m: all(map(_octet, m.split(".")))),
        ("card", _CARD, lambda m: 14 <= len(d := "".join(_DIGITS.findall(m))) <= 19 and luhn(d)),
        ("phone", _PHONE, lambda m: 10 <= len(_DIGITS.findall(m)) <= 15),
    ):
        spans += [(kind, *m.span()) for m in pattern.finditer(text) if holds(m[0])]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """At each @: the run of local characters before it, then the domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


@dataclass
class Node:
    kind: str  # of the base match; of other candidates, "number" or "handle"
    start: int
    end: int
    base: bool
    keys: tuple[str, ...]
    features: tuple[int, ...]
    chain: int = -1  # the neighbour before, if near
    possible: tuple[str, ...] = ()  # kinds that a candidate's signs allow


# The features. The first four tell a base match, the others its looks.
FEATURES = [*KINDS, "few digits", "10 to 15 digits", "14 to 19 digits", "more digits", "luhn", "dots", "blanks", "brackets", "handle", "plus before", "always"]


def candidates(text: str) -> list[Node]:
    """The nodes of a document, by start."""
    base = base_spans(text)
    if not base:
        return []  # nothing that others could agree with
    nodes = [_node(text, kind, start, end, True) for kind, start, end in base]
    taken = np.array(sorted((s, e) for _, s, e in base))
    ends = np.maximum.accumulate(taken[:, 1])

    def free(start: int, end: int) -> bool:
        k = int(np.searchsorted(taken[:, 0], end))
        return k == 0 or int(ends[k - 1]) <= start

    other = [("number", *m.span()) for m in _NUMBER.finditer(text)]
    names = {text[s:e].split("@")[0] for kind, s, e in base if kind == "email"}
    for name in sorted(x for x in names if len(x) >= LEAST_LOCAL):
        for m in re.finditer(rf"(?<![\w.%+-]){re.escape(name)}(?![\w@%+-])", text):
            other.append(("handle", *m.span()))
    nodes += [_node(text, kind, s, e, False) for kind, s, e in sorted(set(other)) if free(s, e)]
    nodes.sort(key=lambda n: (n.start, n.end, n.kind))
    for k in range(1, len(nodes)):
        if nodes[k].start - nodes[k - 1].end <= MAX_GAP:
            nodes[k].chain = k - 1
    return nodes


def _node(text: str, kind: str, start: int, end: int, base: bool) -> Node:
    word = text[start:end]
    digits = "".join(_DIGITS.findall(word))
    keys = []
    if kind == "email":
        keys = ["@" + word.lower(), "name " + word.split("@")[0].lower()]
    elif kind == "handle":
        keys = ["name " + word.lower()]
    else:
        keys = ["digits " + digits]
        if kind in ("phone", "number") and len(digits) >= 9:
            keys.append("last nine " + digits[-9:])
    looks = {
        "few digits": len(digits) < 10, "10 to 15 digits": 10 <= len(digits) <= 15,
        "14 to 19 digits": 14 <= len(digits) <= 19, "more digits": len(digits) > 19,
        "luhn": bool(digits) and luhn(digits), "dots": word.count(".") == 3, "blanks": " " in word,
        "brackets": "(" in word, "handle": kind == "handle", "plus before": word.startswith("+"), "always": True,
    }
    on = [i for i, name in enumerate(FEATURES) if looks.get(name, name == kind)]
    return Node(kind, start, end, base, tuple(keys), tuple(on), possible=tuple(_possible(kind, word, digits)))


def _possible(kind: str, word: str, digits: str) -> Iterator[str]:
    """What a spelling can stand for: no card fails its checksum, no address lacks letters."""
    if kind == "handle":
        yield "email"
    elif kind == "number":
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card"
        # Without the code of its country.
        if 9 <= len(digits) <= 15:
            yield "phone"


def skip_links(nodes: list[Node]) -> list[tuple[int, int]]:
    """Consecutive occurrences of each key: as many links as occurrences, not as pairs."""
    last: dict[str, int] = {}
    links = set()
    for k, node in enumerate(nodes):
        for key in node.keys:
            if key in last:
                links.add((last[key], k))
            last[key] = k
    return sorted(links)


@dataclass
class Weights:
    node: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray


def fit(graphs: list[tuple[list[Node], list[tuple[int, int]]]], steps: int = 300) -> Weights:
    """Pseudo-likelihood weights from graphs whose labels are the base matches.

    A node is predicted from its looks and its neighbours' labels. Each comes twice: as it
    is, and as if it occurred once more with the evidence of a base match hidden, next to
    itself. So a skip link learns from every base match that its label holds for another
    spelling, and from every innocent candidate that none does. A candidate that is linked
    to a base match may be either and is left out.
    """
    n_f, n_l = len(FEATURES), len(LABELS)
    rows, labels = [], []
    for nodes, links in graphs:
        y = [LABELS.index(n.kind) if n.base else 0 for n in nodes]
        skips = defaultdict(list)
        for a, b in links:
            skips[a].append(b)
            skips[b].append(a)
        for k, node in enumerate(nodes):
            if not node.base and any(nodes[j].base for j in skips[k]):
                continue
            near = [node.chain] * (node.chain >= 0) + [k + 1] * (k + 1 < len(nodes) and nodes[k + 1].chain == k)
            partners = [j for j in skips[k] if nodes[j].base == node.base]
            row = np.zeros(n_f + 2 * n_l)
            row[list(node.features)] = 1
            np.add.at(row, [n_f + y[j] for j in near], 1)
            np.add.at(row, [n_f + n_l + y[j] for j in partners], 1)
            again = row.copy()
            again[: len(KINDS)] = 0
            again[n_f + n_l + y[k]] += 1
            rows += [row, again]
            labels += [y[k]] * 2
    if not rows:
        rows, labels = [np.zeros(n_f + 2 * n_l)], [0]
    x, y = np.array(rows), np.eye(n_l)[labels]
    w, speed = np.zeros((x.shape[1], n_l)), np.zeros((x.shape[1], n_l))
    for _ in range(steps):
        p = x @ w
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = x.T @ (p - y) / len(x) + 1e-4 * w
        speed = 0.9 * speed - 0.5 * slope
        w += speed
    chain = w[n_f : n_f + n_l]
    skip = w[n_f + n_l :]
    return Weights(w[:n_f], (chain + chain.T) / 2, (skip + skip.T) / 2)


def beliefs(nodes: list[Node], links: list[tuple[int, int]], weights: Weights) -> np.ndarray:
    """Label probabilities of each node, by sum-product messages until they settle."""
    n_l = len(LABELS)
    unary = np.array([weights.node[list(n.features)].sum(0) for n in nodes])
    for k, node in enumerate(nodes):
        if node.base:
            unary[k] = np.where(np.arange(n_l) == LABELS.index(node.kind), 0.0, -1e3)
        else:
            unary[k, [label not in ("none", *node.possible) for label in LABELS]] = -1e3
    linked = set(links)
    edges = [(a, b, weights.skip) for a, b in links]
    edges += [(n.chain, k, weights.chain) for k, n in enumerate(nodes) if n.chain >= 0 and (n.chain, k) not in linked]
    if not edges:
        return _softmax(unary)
    source = np.array([e[0] for e in edges] + [e[1] for e in edges])
    target = np.array([e[1] for e in edges] + [e[0] for e in edges])
    potential = np.array([e[2] for e in edges] * 2)
    back = np.concatenate([np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))])
    messages = np.zeros((2 * len(edges), n_l))
    for _ in range(ROUNDS):
        total = unary.copy()
        np.add.at(total, target, messages)
        outgoing = (total[source] - messages[back])[:, :, None] + potential
        top = outgoing.max(1)
        new = top + np.log(np.exp(outgoing - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        change = np.abs(new - messages).max()
        messages = 0.5 * messages + 0.5 * new
        if change < 1e-4:
            break
    total = unary.copy()
    np.add.at(total, target, messages)
    return _softmax(total)


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def find_personal(text: str, weights: Weights) -> list[tuple[str, int, int, bool]]:
    """Spans (kind, start, end, base), by start, then kind."""
    nodes = candidates(text)
    spans = [(n.kind, n.start, n.end, True) for n in nodes if n.base]
    if len(spans) < len(nodes):
        links = skip_links(nodes)
        # A label that nothing in the document shares has no one to agree with.
        shared = {k for link in links for k in link}
        p = beliefs(nodes, links, weights)
        for k, node in enumerate(nodes):
            best = int(p[k].argmax())
            if not node.base and k in shared and best and p[k, best] > 0.5:
                spans.append((LABELS[best], node.start, node.end, False))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def train(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> Weights:
    """Weights from at most ``sample_documents`` documents with a digit or an @.

    They are those whose doc_id and text hash lowest, so the sample does not depend on how the
    table is stored. Only their nodes reach the driver.
    """
    hashed = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h")).where(
        F.col("text").rlike("@|[0-9]{7}|[0-9]\\.[0-9]")
    )
    # Hashes alone are ordered; at most sample_documents of them are broadcast.
    chosen = hashed.select("h").distinct().orderBy("h").limit(sample_documents)
    sample = hashed.join(F.broadcast(chosen), "h", "left_semi").dropDuplicates(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [candidates(text) for text in strings(batch.column(0))]
            rows = [
                [{"kind": n.kind, "start": n.start, "end": n.end, "base": n.base, "keys": list(n.keys), "features": list(n.features), "chain": n.chain} for n in nodes]
                for nodes in found
                if nodes
            ]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("keys", pa.list_(pa.string())), ("features", pa.list_(pa.int64())), ("chain", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(rows, kind)], ["nodes"])

    schema = "nodes array<struct<kind:string,start:long,end:long,base:boolean,keys:array<string>,features:array<long>,chain:long>>"
    graphs = []
    for row in map_batches(sample.select("text"), run, schema).collect():
        nodes = [Node(n["kind"], n["start"], n["end"], n["base"], tuple(n["keys"]), tuple(n["features"]), n["chain"]) for n in row["nodes"]]
        graphs.append((nodes, skip_links(nodes)))
    return fit(graphs)


def find_pii(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """doc_id and the ``spans`` of personal data in each whole text of ``docs`` (doc_id, text).

    Without ``weights`` they are learned from ``docs`` first, see ``train``. A null text
    counts as empty and has no spans. Spans of one kind's base matches never overlap, those
    of different kinds may; added spans overlap no base match. Repeated rows stay, an empty
    table gives none, further columns are ignored. No shuffle: a document is one graph.
    """
    weights = weights or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_personal(text, weights) for text in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), span_column(found)], ["doc_id", "spans"])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(plain, run, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; the columns stay.

    Overlapping spans are one, named after the first. A null text stays null.
    """
    weights = weights or train(docs)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([None if t is None else redacted(t, weights) for t in batch.column(place).to_pylist()], pa.string())
            columns = [texts if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_batches(docs, run, docs.schema)


def redacted(text: str, weights: Weights) -> str:
    parts, done = [], 0
    for kind, start, end, _ in find_personal(text, weights):
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])
