"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages. Each passage is encoded by its signs and words, a gated
attention weighs the passages, and the weighted mean of their codes is scored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import map_rows

#: Bytes of a passage, which then goes on to the end of its word.
PASSAGE = 400
#: Bytes of texts worked on at a time.
BLOCK = 1 << 19
#: Classes of bytes whose shares describe a passage.
SIGNS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".,;:?'\"()-",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"$%&*#@^~+=<>_/\\[]{}`",
    "control": bytes([*range(9), *range(14, 32), 127]),
}
#: Besides the shares: others (beyond ASCII), doubled bytes, distinct words, mean word length, size.
N_FEATURES = len(SIGNS) + 5
#: Odd powers by place and codes by byte make a hash of a word; a blank counts nothing.
POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))
SIGN_CODES = np.append(np.uint64(0), np.arange(2, 257, dtype=np.uint64))


@dataclass
class Model:
    """Weights of the encoder (w1, b1), the gated attention (v, u, a) and the score (w2, b2)."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.w1, self.b1, self.v, self.u, self.a, self.w2, self.b2]


def passage_features(texts: list[bytes | None], size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and where the passages of each text start.

    Every text has a passage at least; that of an empty or null text is all zeros.
    """
    texts = [t or b"" for t in texts]
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    classes = np.full(256, len(SIGNS), np.uint8)
    for i, signs in enumerate(SIGNS.values()):
        classes[list(signs)] = i
    kind = classes[data]
    gap = (kind == 3) | (kind == 4)
    gaps = np.flatnonzero(gap)
    starts: list[np.ndarray] = []
    for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
        if end - begin <= size:
            starts.append(np.array([begin]))
            continue
        # The first blank from each multiple of the size on; a short rest joins the last passage.
        found = np.searchsorted(gaps, np.arange(begin + size, end, size))
        near = np.unique(gaps[found[found < len(gaps)]])
        near = near[near < end - size // 2]
        starts.append(np.concatenate(([begin], near)))
    firsts = np.concatenate(([0], np.cumsum([len(s) for s in starts])))
    at = np.concatenate(starts)
    stops = np.append(at[1:], len(data))
    for i, end in zip(firsts[1:], ends, strict=True):
        stops[i - 1] = end
    n = (stops - at).astype(np.float64)
    out = np.zeros((len(at), N_FEATURES))
    if not len(data):
        return out, firsts[:-1]

    def per_passage(marked: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(marked, dtype=np.int64)))
        return (sums[stops] - sums[at]).astype(np.float64)

    full = np.maximum(n, 1)
    for i in range(len(SIGNS) + 1):
        out[:, i] = per_passage(kind == i) / full
    doubled = np.append(False, (data[1:] == data[:-1]) & (kind[1:] != 3))
    doubled[begins[lengths > 0]] = False
    out[:, -4] = per_passage(doubled) / full
    # Words as hashes of their bytes: the sum of byte times power, mod 2^64, made position free.
    head = ~gap & np.append(True, gap[:-1])
    head[begins[lengths > 0]] = ~gap[begins[lengths > 0]]
    word_at = np.flatnonzero(head)
    n_words = per_passage(head)
    if len(word_at):
        step = np.arange(len(data)) - np.repeat(np.append(0, word_at), np.diff(np.concatenate(([0], word_at, [len(data)]))))
        hashed = np.add.reduceat(SIGN_CODES[np.where(gap, 0, data)] * POWERS[np.minimum(step, 255)], word_at)
        owner = np.searchsorted(at, word_at, "right") - 1
        # A zero-length passage may share its start with the next one; it has no words.
        order = np.lexsort((hashed, owner))
        fresh = np.append(True, (hashed[order][1:] != hashed[order][:-1]) | (owner[order][1:] != owner[order][:-1]))
        distinct = np.bincount(owner[order][fresh], minlength=len(at))
        some = np.maximum(n_words, 1)
        out[:, -3] = distinct / some
        out[:, -2] = np.minimum((n - per_passage(gap)) / some / 10, 3)
    out[:, -1] = np.log1p(n) / 10
    return out, firsts[:-1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def bag_scores(model: Model, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The score of each bag; bag i has the passages from starts[i] on."""
    return _forward(model, (x - model.mean) / model.scale, starts)["p"]


def _forward(m: Model, x: np.ndarray, starts: np.ndarray) -> dict:
    sizes = np.diff(np.append(starts, len(x)))
    bag = np.repeat(np.arange(len(starts)), sizes)
    h = np.tanh(x @ m.w1 + m.b1)
    t, g = np.tanh(h @ m.v), _sigmoid(h @ m.u)
    e = (t * g) @ m.a
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    att = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(att[:, None] * h, starts, axis=0)
    return {"bag": bag, "h": h, "t": t, "g": g, "att": att, "z": z, "p": _sigmoid(z @ m.w2 + m.b2)}


def _gradients(m: Model, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    f = _forward(m, x, starts)
    bag, h, t, g, att = f["bag"], f["h"], f["t"], f["g"], f["att"]
    d = (f["p"] - y) / len(y)
    dz = d[:, None] * m.w2
    datt = np.einsum("ij,ij->i", dz[bag], h)
    de = att * (datt - np.add.reduceat(att * datt, starts)[bag])
    dt, dg = de[:, None] * m.a * g * (1 - t**2), de[:, None] * m.a * t * g * (1 - g)
    dh = (att[:, None] * dz[bag] + dt @ m.v.T + dg @ m.u.T) * (1 - h**2)
    return [x.T @ dh, dh.sum(0), h.T @ dt, h.T @ dg, de @ (t * g), d @ f["z"], d.sum(keepdims=True)]


def fit(
    bags: list[np.ndarray], labels: np.ndarray, hidden: int = 16, gate: int = 8, epochs: int = 40, batch: int = 64,
    rate: float = 0.01, seed: int = 1,
) -> Model:
    """Train on bags of passage features with labels of the bags alone. Adam on the log loss."""
    rng = np.random.default_rng(seed)
    everything = np.concatenate(bags)
    d = everything.shape[1]
    shape = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    model = Model(
        everything.mean(0), np.maximum(everything.std(0), 1e-3), shape(d, hidden), np.zeros(hidden),
        shape(hidden, gate), shape(hidden, gate), shape(gate), shape(hidden), np.zeros(1),
    )
    scaled = [(b - model.mean) / model.scale for b in bags]
    sizes = np.array([len(b) for b in bags])
    first = [np.zeros_like(w) for w in model.weights()]
    second = [np.zeros_like(w) for w in model.weights()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        pace = rate * (1 - epoch / epochs)
        for low in range(0, len(order), batch):
            some = order[low : low + batch]
            starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
            step += 1
            grads = _gradients(model, np.concatenate([scaled[i] for i in some]), starts, labels[some])
            for w, grad, a, b in zip(model.weights(), grads, first, second, strict=True):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad**2 - b)
                w -= pace * ((a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8) + 1e-4 * w)
    return model


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    usable: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    max_rows: int = 4096,
    seed: int = 1,
) -> Model | None:
    """A model of the texts in ``docs`` whose row in ``labels`` meets ``usable``; None without any.

    Fitted on at most ``max_rows`` labelled rows (those of the smallest hashed doc_id), all passages
    of each: the only bounded sample here, and what reaches the driver, a few numbers a passage. Null labels and ids are not used; a document
    labelled twice counts twice, a label without a document not at all.
    """
    wanted = (
        labels.where(usable & F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .select(F.col(doc_id).alias("__id"), F.col(label).cast("double").alias("__label"))
        .orderBy(F.xxhash64("__id", F.lit(seed)), "__id", "__label")
        .limit(max_rows)
    )
    texts = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("text"))
    chosen = texts.join(F.broadcast(wanted), "__id")

    def start() -> Callable:
        def compute(values: list) -> dict:
            return {"bag": [passage_features([value])[0].astype(np.float32).tobytes() for value in values]}

        return compute

    rows = map_rows(chosen, "text", "bag binary", start, keep=["__id", "__label"]).collect()
    rows.sort(key=lambda r: (r["__id"], r["__label"], r["bag"]))
    if not rows:
        return None
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES).astype(np.float64) for r in rows]
    return fit(bags, np.array([r["__label"] for r in rows]), seed=seed)


def score(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all, if None) with ``score`` (0 to 1) and ``predicted`` (1 if it is at least 0.5).

    Every passage of every text is read; the text is the only input. A null or empty text
    is one empty passage. Without a model every score is 0.5. Columns named as the results
    are replaced. One pass, no shuffle.
    """

    def start() -> Callable:
        def compute(texts: list) -> dict:
            scores = np.full(len(texts), 0.5)
            low = 0
            while model is not None and low < len(texts):
                high, held = low, 0
                while high < len(texts) and (high == low or held + len(texts[high] or b"") < BLOCK):
                    held += len(texts[high] or b"")
                    high += 1
                scores[low:high] = bag_scores(model, *passage_features(texts[low:high]))
                low = high
            return {"score": scores, "predicted": (scores >= 0.5).astype(np.int32)}

        return compute

    return map_rows(docs, text, "score double, predicted int", start, keep)
