"""Secret scans: fixed patterns, and a character network over every candidate in its surroundings.

The patterns' findings are always reported. Beyond them a candidate is a run of
16 or more characters of the kind secrets are made of, or what the patterns' findings leave of
one. A convolutional network reads it whole, in windows of ``INSIDE`` characters a ``STEP`` apart, each with ``BEFORE``
characters before it and ``AFTER`` behind it: characters are embedded,
convolved, pooled by their maximum, and weighed. A candidate's score is the
highest of its windows. Training, a few thousand
windows, runs on the driver; reading runs in the tasks, in batches.

Labels come from the patterns: windows that lie over what one of them found are findings,
others are not, but those that look like keys (``keylike``) are no examples of either. Of every other
assignment the keyword is left out, so that the value is known without it, and
each value is shown once more in another alphabet.
A bounded sample is taken: of documents a share by the hash of
their key, about ``DOCUMENTS`` in all, and of those ``EXAMPLES`` of either label.
A fifth is kept aside: there scores are calibrated (a logistic curve over the
network's output), and the threshold lies half-way between the highest one that still finds
``RECALL`` of the findings, however low, and the next other example. What no pattern describes has no labels:
for such secrets ``RECALL`` is not promised.

Defined results: a null text is an empty one and has no findings. Positions
count code points. Spans of the network never overlap one of a pattern. With too few labels of one kind there is no network, only the patterns.
Each row gives a row, repeated ones and null keys included.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.arrays import slices
from pageloom.llm.tables import bare, packed, unpacked

# Fixed patterns; what is found counts if it, or its second group, is long enough.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are found whole, so the length may stand in the pattern
KINDS = ("assign", "access", "hex")

LEAST = 16  # characters of a candidate
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
BEFORE, INSIDE, AFTER = 16, 32, 8
WINDOW = BEFORE + INSIDE + AFTER
STEP = 16
READ = 8192  # windows read together
EMBEDDED, WIDTH, FILTERS = 8, 5, 24

DOCUMENTS = 20_000
EXAMPLES = 3_000
EPOCHS = 12
RECALL = 0.98
LEAST_SURE = 0.0  # no floor: the threshold is the one that RECALL asks for

# Characters as the network sees them: printable ASCII, the line feed, any other, and none.
_OTHER, _NONE, _ALPHABET = 96, 97, 98


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """What the patterns find: (start, end, kind), by start, then kind as listed."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda f: (f[0], KINDS.index(f[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs that could be a secret."""
    return [m.span() for m in CANDIDATE.finditer(text)]


def places(start: int, end: int) -> list[tuple[int, int]]:
    """Where the windows of a candidate stand; together they cover it."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(at, at + INSIDE) for at in (*range(start, end - INSIDE, STEP), end - INSIDE)]


def beside(start: int, end: int, found: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What findings, by their start, leave of a candidate, in pieces long enough to be one."""
    out = []
    for s, e, _ in found:
        if s < end and start < e:
            out.append((start, s))
            start = max(start, e)
    return [(s, e) for s, e in [*out, (start, end)] if e - s >= LEAST]


def keylike(run: str) -> bool:
    """Could a run be a key that no pattern describes? Letters and digits, or capitals and small letters, change often in it."""
    kinds = ["0" if c.isdigit() else "A" if c.isupper() else "a" for c in run if c.isalnum()]
    return sum(a != b for a, b in zip(kinds, kinds[1:])) >= max(4, len(kinds) // 5)


def window(text: str, start: int, end: int) -> str:
    """A candidate in its surroundings, each part filled up with NUL."""
    before = text[max(0, start - BEFORE): start].rjust(BEFORE, "\0")
    return before + text[start: min(end, start + INSIDE)].ljust(INSIDE, "\0") + text[end: end + AFTER].ljust(AFTER, "\0")


def encode(windows: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(windows).encode("utf-32-le"), np.uint32).reshape(len(windows), WINDOW)
    out = np.full(codes.shape, _OTHER, np.uint8)
    plain = (codes >= 0x20) & (codes < 0x7F)
    out[plain] = codes[plain] - 0x20
    out[codes == 10] = 95
    out[codes == 0] = _NONE
    return out


@dataclass
class Network:
    embedding: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 1.0

    def _layers(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        read = self.embedding[x]
        parts = np.lib.stride_tricks.sliding_window_view(read, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WINDOW - WIDTH + 1, -1)
        seen = np.maximum(parts @ self.filters + self.shift, 0)
        return parts, seen, seen.max(axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = [self._layers(x[i: i + 1024])[2] @ self.weights + self.bias for i in range(0, len(x), 1024)]
        return np.concatenate(out) if out else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.offset, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """A network fitted to windows and labels by Adam, calibrated and with its threshold on a fifth kept aside."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    aside, used = order[: len(x) // 5], order[len(x) // 5:]
    net = Network(rng.normal(0, 0.5, (_ALPHABET, EMBEDDED)), rng.normal(0, 0.2, (WIDTH * EMBEDDED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, FILTERS), 0.0)
    values = {k: getattr(net, k) for k in ("embedding", "filters", "shift", "weights")} | {"bias": np.zeros(1)}
    first, second, step = {k: np.zeros_like(v) for k, v in values.items()}, {k: np.zeros_like(v) for k, v in values.items()}, 0
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            parts, seen, top = net._layers(x[at])
            error = (1 / (1 + np.exp(-np.clip(top @ net.weights + values["bias"][0], -30, 30))) - y[at]) * balance[at] / len(at)
            grad = {"bias": np.array([error.sum()]), "weights": top.T @ error}
            # The gradient goes to the place each filter's maximum came from.
            place, down = seen.argmax(axis=1), np.outer(error, net.weights) * (top > 0)
            chosen = parts[np.arange(len(at))[:, None], place]  # windows x filters x (width * embedded)
            grad["filters"], grad["shift"] = np.einsum("nf,nfd->df", down, chosen), down.sum(axis=0)
            back = np.einsum("nf,df->nfd", down, net.filters).reshape(len(at), FILTERS, WIDTH, EMBEDDED)
            grad["embedding"] = np.zeros_like(net.embedding)
            np.add.at(grad["embedding"], x[at][np.arange(len(at))[:, None, None], place[:, :, None] + np.arange(WIDTH)], back)
            step += 1
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                values[k] -= 0.01 * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
            net.bias = float(values["bias"][0])
    raw, label = net.raw(x[aside]), y[aside]
    for _ in range(500):  # a logistic curve over the network's output
        p = 1 / (1 + np.exp(-np.clip(net.slope * raw + net.offset, -30, 30)))
        net.slope -= 0.05 * float(((p - label) * raw).mean())
        net.offset -= 0.05 * float((p - label).mean())
    found = np.sort(net.probability(x[aside][label == 1]))
    net.threshold = float(found[int((1 - RECALL) * len(found))]) if len(found) else 1.0
    # Anything down to the next of the others finds no more of them: half-way there, for secrets unlike the labelled ones.
    below = [p for p in net.probability(x[aside][label == 0]) if p < net.threshold]
    if below:
        net.threshold = (net.threshold + float(max(below))) / 2
    return net


def examples(text: str) -> list[tuple[str, int]]:
    """Windows of a text and their labels."""
    out, found, hidden = [], base_findings(text), set()
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST and zlib.crc32(m[2].encode()) % 2:
            hidden.add(m.span())
            value = text[: m.start()][-BEFORE:] + m[2] + text[m.end(): m.end() + AFTER]
            low = min(BEFORE, m.start())
            out += [(window(value, s, e), 1) for s, e in places(low, low + len(m[2]))]
    # What keys of other kinds could look like: each value again in capitals or in the letters of base 64, without its keyword.
    values = [(m.start(), m[2], m.end()) for m in ASSIGN.finditer(text)] + [(s, text[s:e], e) for s, e, kind in found if kind != "assign"]
    for start, value, end in values:
        if len(value) >= LEAST:
            low, code = min(BEFORE, start), zlib.crc32(value.encode())
            other = value.upper() if code // 2 % 2 else (base64.b64encode(hashlib.sha512(value.encode()).digest()).decode() * (len(value) // 88 + 1))[: len(value)]
            around = text[:start][-BEFORE:] + other + text[end: end + AFTER]
            out += [(window(around, s, e), 1) for s, e in places(low, low + len(other))]
    for start, end in candidates(text):
        touched = [(s, e) for s, e, _ in found if s < end and start < e]
        for s, e in places(start, end):
            over = max([min(e, e2) - max(s, s2) for s2, e2 in touched], default=0)
            if over >= LEAST:
                if not any(s < e2 and s2 < e for s2, e2 in hidden):
                    out.append((window(text, s, e), 1))
            elif over <= 0 and not keylike(text[s:e]):
                out.append((window(text, s, e), 0))
    return out


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for batch in batches for part in slices(batch, "text")):
        rows = [row for text in batch.column("text").to_pylist() for row in examples(text)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.int32())], names=["window", "label"])


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Network | None:
    """The network for ``docs``; at most ``EXAMPLES`` windows of either label reach the driver."""
    read = bare(docs, key, text).toDF("key", "text").filter("text is not null")
    n, grain = read.count(), 1 << 30
    share = min(grain, grain * DOCUMENTS // max(1, n))
    seen = read.filter(F.pmod(F.xxhash64("key"), F.lit(grain)) < share).select("text").mapInArrow(_examples, "window string, label int")
    order = F.xxhash64("window")
    rows = [r for label in (0, 1) for r in seen.filter(F.col("label") == label).distinct().orderBy(order, "window").limit(EXAMPLES).collect()]
    y = np.array([r.label for r in rows], float)
    if min(y.sum(), len(y) - y.sum()) < 10:
        return None
    return train(encode([r.window for r in rows]), y)


def highest(net: Network, texts: list[str], spans: list[tuple[int, int, int]]) -> np.ndarray:
    """The highest probability of each span's windows; spans are (number of the text, start, end)."""
    best, waiting = np.zeros(len(spans)), []

    def read() -> None:
        np.maximum.at(best, np.array([k for k, _ in waiting], np.int64), net.probability(encode([w for _, w in waiting])))
        waiting.clear()

    for k, (i, start, end) in enumerate(spans):
        for s, e in places(start, end):
            waiting.append((k, window(texts[i], s, e)))
            if len(waiting) == READ:
                read()
    if waiting:
        read()
    return best


def _scanned(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    net: Network | None = unpacked(shared)
    for batch in (part for batch in batches for part in slices(batch, "text")):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        base = [base_findings(t) for t in texts]
        beyond: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if net is not None:
            spans = [(i, *span) for i, text in enumerate(texts) for run in candidates(text) for span in beside(*run, base[i])]
            for (i, start, end), p in zip(spans, highest(net, texts, spans)):
                if p >= net.threshold:
                    beyond[i].append((start, end, "network"))
        kinds = (*KINDS, "network")
        every = [sorted(a + b, key=lambda f: (f[0], kinds.index(f[2]))) for a, b in zip(base, beyond)]
        found = pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in fs] for fs in every],
                         pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column("key"), found], names=["key", "findings"])


def scan_secrets(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document its ``findings``: kind, start, end, by start and kind."""
    shared = packed(docs.sparkSession, net)
    read = bare(docs, key, text).toDF("key", "text")
    shape = f"key {docs.schema[key].dataType.simpleString()}, findings array<struct<kind: string, start: long, end: long>>"
    return read.mapInArrow(lambda it: _scanned(it, shared), shape).withColumnRenamed("key", key)
