"""Language identification by a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._support import batch, buffers, fold, id_text, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DEPTH = 8
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class LanguageModel:
    """Byte vectors, a bank of filters of each width, and the weights of the classes."""

    langs: list[str]
    bytes_: np.ndarray  # 256 x DEPTH
    filters: list[np.ndarray]  # width * DEPTH x FILTERS
    biases: list[np.ndarray]
    dense: np.ndarray  # len(WIDTHS) * FILTERS x langs
    offset: np.ndarray

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        vectors = self.bytes_[windows]  # n x WINDOW x DEPTH
        out = []
        for width, f, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            flat = vectors.reshape(len(windows), -1)
            spans = sliding_window_view(flat, width * DEPTH, axis=1)[:, ::DEPTH]
            out.append(np.maximum((spans.reshape(-1, width * DEPTH) @ f).reshape(len(windows), -1, FILTERS).max(1) + b, 0))
        return np.concatenate(out, axis=1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        logits = self.pooled(windows) @ self.dense + self.offset
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit_cnn(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 4, size: int = 64, rate: float = 4e-3, seed: int = 0) -> LanguageModel:
    """Minimise cross-entropy with Adam; gradients go through the position of each maximum."""
    r = np.random.default_rng(seed)
    f4 = np.float32
    shapes = [(256, DEPTH), *((w * DEPTH, FILTERS) for w in WIDTHS), *((FILTERS,) for _ in WIDTHS), (len(WIDTHS) * FILTERS, len(langs)), (len(langs),)]
    scale = [0.5, *(1 / np.sqrt(w * DEPTH) for w in WIDTHS), *(0.0 for _ in WIDTHS), 1 / np.sqrt(len(WIDTHS) * FILTERS), 0.0]
    theta = [(r.standard_normal(s) * k).astype(f4) for s, k in zip(shapes, scale, strict=True)]
    first, second, t, k = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta], 0, len(WIDTHS)
    for _ in range(epochs):
        order = r.permutation(len(windows))
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            x, n = windows[pick], len(pick)
            vectors = theta[0][x]
            grads = [np.zeros_like(p) for p in theta]
            pooled, best = [], []
            for j, width in enumerate(WIDTHS):
                spans = sliding_window_view(vectors.reshape(n, -1), width * DEPTH, axis=1)[:, ::DEPTH]
                z = (spans.reshape(-1, width * DEPTH) @ theta[1 + j]).reshape(n, -1, FILTERS)
                best.append(z.argmax(1))
                pooled.append(np.maximum(np.take_along_axis(z, best[-1][:, None], 1)[:, 0] + theta[1 + k + j], 0))
            h = np.concatenate(pooled, axis=1)
            logits = h @ theta[-2] + theta[-1]
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), labels[pick]] -= 1
            p /= n
            grads[-2], grads[-1] = h.T @ p, p.sum(0)
            back = (p @ theta[-2].T) * (h > 0)
            for j, width in enumerate(WIDTHS):
                g = back[:, j * FILTERS : (j + 1) * FILTERS]
                grads[1 + k + j] = g.sum(0)
                places = best[j][:, :, None] + np.arange(width)  # n x FILTERS x width
                values = vectors[np.arange(n)[:, None, None], places].reshape(n, FILTERS, -1)
                grads[1 + j] = np.einsum("nf,nfd->df", g, values)
                into = (g[:, :, None] * theta[1 + j].T[None]).reshape(n, FILTERS, width, DEPTH)
                np.add.at(grads[0], x[np.arange(n)[:, None, None], places], into)
            t += 1
            for i, g in enumerate(grads):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                theta[i] = (theta[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-7)).astype(f4)
    return LanguageModel(langs, theta[0], theta[1 : 1 + k], theta[1 + k : 1 + 2 * k], theta[-2], theta[-1])


def _places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of each text's windows of fixed length; the last one of a text may be shorter."""
    counts = -(-np.diff(offsets) // WINDOW)
    rows = np.repeat(np.arange(len(counts)), counts)
    begin = offsets[:-1][rows] + (np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows]) * WINDOW
    return begin, np.minimum(begin + WINDOW, offsets[1:][rows]), rows


def _windows(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of windows, what is missing filled with zeros."""
    out = sliding_window_view(np.append(data, np.zeros(WINDOW, np.uint8)), WINDOW)[begin]
    short = np.flatnonzero(end - begin < WINDOW)
    out[short] = np.where(np.arange(WINDOW) < (end - begin)[short, None], out[short], 0)
    return out


def train(docs: DataFrame, per_lang: int = 600, windows_per_text: int = 4, hold_out: tuple[int, int] | None = None) -> LanguageModel:
    """Fit the network to texts with a ``lang``.

    The fit uses a bounded sample: of each language at most ``per_lang`` texts, those with the
    least hash of the id, and of each text at most ``windows_per_text`` windows, evenly spread, so that
    a few long texts don't make up the sample. With ``hold_out`` = (modulus, remainder) no text of
    such an id is seen. Null languages, and null and empty texts, teach nothing; without any
    other the model knows no language.
    """
    docs = docs.where("lang is not null and length(text) > 0")
    if hold_out:
        docs = docs.where(fold("doc_id", hold_out[0]) != hold_out[1])
    counts = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}  # a row for each language
    langs = sorted(counts)
    if not langs:
        return LanguageModel([], *[np.zeros(0)] * 5)
    # a language's share of the hash range holds about twice its sample; the exact cut follows
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, 2.0 * per_lang / counts[k] + 20 / counts[k]))))
    hashed = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30))
    chosen = docs.where(hashed < share[F.col("lang")] * (1 << 30)).select("lang", "text", hashed.alias("h"))
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("windows", pa.binary())])

    def cut(batches):
        for x in slices(batches):
            data, offsets = buffers(x.column("text"))
            begin, end, rows = _places(offsets)
            first = np.searchsorted(rows, np.arange(x.num_rows + 1))
            spread = (np.linspace(a, b - 1, windows_per_text) for a, b in zip(first[:-1], first[1:], strict=True))
            picks = [np.unique(p.astype(np.int64)) for p in spread]
            yield batch(schema, x.column("lang"), x.column("h"), [_windows(data, begin[p], end[p]).tobytes() for p in picks])

    seen = chosen.mapInArrow(cut, "lang string, h long, windows binary").collect()
    kept, labels = [], []
    for k, lang in enumerate(langs):
        for r in sorted((r for r in seen if r.lang == lang), key=lambda r: (r.h, r.windows))[:per_lang]:
            w = np.frombuffer(bytes(r.windows), np.uint8).reshape(-1, WINDOW)
            kept.append(w)
            labels += [k] * len(w)
    if not kept:
        return LanguageModel([], *[np.zeros(0)] * 5)
    return fit_cnn(np.concatenate(kept), np.array(labels), langs)


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, model: LanguageModel, windows_at_once: int = 512) -> DataFrame:
    """(doc_id, lang_pred, score) for each row.

    Every window of the whole text is classified; their probabilities are averaged, each by the
    letters it holds. A text that is null or has no letter is ``und`` with score 0, as is every
    text if the model knows no language. Ties go to the first language by name.
    """

    def run(batches):
        for x in slices(batches):
            data, offsets = buffers(x.column("text"))
            if not len(data) or not model.langs:
                yield batch(_OUT, x.column("doc_id"), [UNKNOWN] * x.num_rows, [0.0] * x.num_rows)
                continue
            begin, end, rows = _places(offsets)
            total, mass = np.zeros((x.num_rows, len(model.langs))), np.zeros(x.num_rows)
            for at in range(0, len(rows), windows_at_once):
                part = slice(at, at + windows_at_once)
                windows = _windows(data, begin[part], end[part])
                letters = _LETTER[windows].sum(1)
                np.add.at(total, rows[part], model.probabilities(windows) * letters[:, None])
                np.add.at(mass, rows[part], letters)
            best = total.argmax(1)
            score = total[np.arange(x.num_rows), best] / np.maximum(mass, 1)
            plain = np.add.reduceat(np.append(data < 128, True).astype(np.int64), offsets[:-1])
            has = mass > 0
            # bytes of characters beyond ASCII count as letters above: look at the characters where nothing else is one
            for k in np.flatnonzero(has & (plain < np.diff(offsets))):
                ascii_letter = _LETTER[:128][np.minimum(data[offsets[k] : offsets[k + 1]], 127)] & (data[offsets[k] : offsets[k + 1]] < 128)
                has[k] = bool(ascii_letter.any()) or any(map(str.isalpha, x.column("text")[k].as_py()))
            yield batch(_OUT, x.column("doc_id"), np.where(has, np.array(model.langs)[best], UNKNOWN).tolist(), np.where(has, np.clip(score, 0, 1), 0.0))

    return id_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
