"""Operator 10: language identification by a byte convolutional network in numpy.

The network reads fixed windows of ``WINDOW`` bytes: filters of several widths over one-hot bytes, maximum over the
positions, rectifier, softmax over the languages. It is trained on the driver by Adam on a bounded sample
(``PER_LANG`` documents of each language, chosen by hash; parameters below) and applied by Spark to all windows of
every whole text; a document's prediction is the mean of its windows' probabilities, weighted by their bytes.

For speed a layer over one-hot bytes is a sum of table rows: two look-ups by byte pair give all filters at a position.

Training reads text and lang only, of rows whose crc32(doc_id as text) mod 4 is not ``HELD_OUT``; prediction reads text only.

Defined results: null text, or text without a letter, is ``und`` with score 0, as is every text if nothing is
labelled; languages tie to the first by code point; repeated rows repeat results; extra columns are ignored. Memory:
some windows of one piece of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

FOLDS, HELD_OUT = 4, 2
#: Bounds of the training sample: documents per language, characters of each, windows of each.
PER_LANG, SLICE, WINDOWS_EACH = 500, 3000, 5
WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 12
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.02, 7
UNKNOWN = "und"


def fold() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))


class ByteNet:
    """Filters ``w[k]`` of shape (width, 256, FILTERS), then a dense layer."""

    def __init__(self, classes: list[str], seed: int = SEED):
        self.classes = classes
        rng = np.random.default_rng(seed)
        self.params = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.params += [rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32), np.zeros(len(classes), np.float32)]
        self.tables: tuple[np.ndarray, np.ndarray] | None = None

    def _soft(self, z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients of one batch of windows."""
        n, rows, feats, best = len(x), np.arange(len(x))[:, None], [], []
        for w in self.params[:len(WIDTHS)]:
            k = len(w)
            conv = sum(w[j][x[:, j:WINDOW - k + 1 + j]] for j in range(k))
            at = conv.argmax(1)
            best.append(at)
            feats.append(np.take_along_axis(conv, at[:, None, :], 1)[:, 0])
        h = np.concatenate(feats, 1)
        a = np.maximum(h, 0)
        p = self._soft(a @ self.params[-2] + self.params[-1])
        loss = float(-np.log(p[np.arange(n), y] + 1e-9).mean())
        p[np.arange(n), y] -= 1
        p /= n
        grads: list[np.ndarray] = []
        back = (p @ self.params[-2].T) * (h > 0)
        cols = np.arange(FILTERS)[None, :]
        for i, w in enumerate(self.params[:len(WIDTHS)]):
            g = np.zeros_like(w)
            gi = back[:, i * FILTERS:(i + 1) * FILTERS]
            for j in range(len(w)):
                np.add.at(g[j], (x[rows, best[i] + j], np.broadcast_to(cols, gi.shape)), gi)
            g[:, 0] = 0
            grads.append(g)
        return loss, [*grads, a.T @ p, p.sum(0)]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> "ByteNet":
        rng = np.random.default_rng(seed)
        for w in self.params[:len(WIDTHS)]:
            w[:, 0] = 0  # padding says nothing
        m, v, t = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            rate = RATE * (0.5 ** (2 * epoch / epochs))
            for lo in range(0, len(x), BATCH):
                pick = order[lo:lo + BATCH]
                _, grads = self.step(x[pick], y[pick])
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.params[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-7)
        return self

    def compile(self) -> "ByteNet":
        """Look-up tables by byte pair: what the pair at a position adds, and what the pair two further on adds."""
        here, later = [], []
        zero = np.zeros((256, 256, FILTERS), np.float32)
        for w in self.params[:len(WIDTHS)]:
            here.append(w[0][:, None] + w[1][None] + zero)
            later.append((w[2][:, None] if len(w) > 2 else 0) + (w[3][None] if len(w) > 3 else 0) + zero)
        self.tables = tuple(np.ascontiguousarray(np.concatenate(t, 2).reshape(65536, -1).astype(np.float32)) for t in (here, later))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of windows (n, WINDOW)."""
        here, later = self.tables
        pad = np.zeros((len(x), WINDOW + 3), np.int32)
        pad[:, :WINDOW] = x
        pair = pad[:, :-1] * 256 + pad[:, 1:]
        conv = here[pair[:, :WINDOW - 1]]
        conv += later[pair[:, 2:WINDOW + 1]]
        return self._soft(np.maximum(conv.max(1), 0) @ self.params[-2] + self.params[-1])


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, bytes, text) of the windows that cover every text."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[text] + nth * WINDOW
    return start, np.minimum(WINDOW, offsets[text + 1] - start), text


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.arange(WINDOW)[None, :]
    return np.where(at < size[:, None], data[np.minimum(start[:, None] + at, len(data) - 1)], 0).astype(np.uint8)


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> list[tuple[str, str]]:
    """At most ``per_lang`` (lang, slice of text) of each language, by hash of doc_id, outside the held-out fold."""
    rows = docs.where((fold() != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    count = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not count:
        return []
    share = F.shiftrightunsigned(F.xxhash64(F.lit(11), F.col("doc_id")), 11) / float(1 << 53)
    least = F.coalesce(*[F.when(F.col("lang") == k, F.lit(1.5 * per_lang / n + 20 / n)) for k, n in sorted(count.items())])
    start = (F.pmod(F.xxhash64(F.lit(12), F.col("doc_id")), F.greatest(F.length("text") - SLICE, F.lit(1))) + 1).cast("int")
    got = rows.withColumn("_u", share).where(F.col("_u") < least).select("lang", "_u", F.substr("text", start, F.lit(SLICE)).alias("t")).collect()
    out, taken = [], dict.fromkeys(count, 0)
    for r in sorted(got, key=lambda r: (r["_u"], r["lang"], r["t"])):
        if taken[r["lang"]] < per_lang:
            taken[r["lang"]] += 1
            out.append((r["lang"], r["t"]))
    return out


def train(docs: DataFrame, per_lang: int = PER_LANG) -> ByteNet | None:
    """The network fitted to the bounded sample; None if nothing is labelled."""
    rows = sample(docs, per_lang)
    classes = sorted({k for k, _ in rows})
    if not classes:
        return None
    rng, xs, ys = np.random.default_rng(SEED), [], []
    for lang, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        if not len(data):
            continue
        for _ in range(min(WINDOWS_EACH, 1 + len(data) // 64)):
            size = min(len(data), WINDOW if rng.random() < 0.7 else int(rng.integers(24, WINDOW)))
            at = int(rng.integers(0, len(data) - size + 1))
            x = np.zeros(WINDOW, np.uint8)
            x[:size] = data[at:at + size]
            xs.append(x)
            ys.append(classes.index(lang))
    net = ByteNet(classes)
    return net.fit(np.stack(xs), np.array(ys)) if xs else None


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
SCHEMA = "doc_id long, lang_pred string, score double"


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    classes = net.classes if net else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if net:
            net.compile()
        for batch in batches:
            langs, scores = [], []
            for lo, hi, data, offsets in pieces(batch.column(1)):
                start, size, text = windows(data, offsets)
                mean = np.zeros((hi - lo, max(1, len(classes))))
                if net:
                    for k in range(0, len(start), 96):
                        part = slice(k, k + 96)
                        np.add.at(mean, text[part], net.predict(gather(data, start[part], size[part])) * size[part, None])
                total = np.diff(offsets)
                letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
                plain = letters[offsets[1:]] > letters[offsets[:-1]]
                for i in range(hi - lo):
                    has = plain[i] or total[i] and any(c.isalpha() for c in data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "ignore"))
                    if not has or not classes:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        best = int(mean[i].argmax())
                        langs.append(classes[best])
                        scores.append(float(min(1.0, mean[i, best] / total[i])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def label(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    return identify(docs, train(docs, per_lang))
