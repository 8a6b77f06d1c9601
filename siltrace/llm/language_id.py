"""Language identification by a byte-level convolutional network.

Filters of several widths slide over the bytes of fixed-length windows, each filter keeps its largest answer in the window
(max pooling), and a softmax layer turns those into languages.  The network is trained here in numpy on a bounded sample of
labelled texts.  As the first layer sees one-hot bytes, a filter's answer is a sum of table rows, one for each byte pair:
that is how windows are scored in batches.  A text's logits are the mean over all its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltrace.llm.kernels import CHUNK, chunks, text_bytes, tidied

WINDOW = 256  # bytes
WIDTHS = (2, 3, 4)
DOCS_PER_LANGUAGE = 500  # the training bound: labelled texts of each language
WINDOWS_PER_DOC = 6  # and windows of each of them, spread over the whole text
MAX_LANGUAGES = 200  # at 1.5 KB a text, 150 MB of windows reach the driver at most
_BATCH = 512  # windows scored at once

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LETTER = regex.compile(r"\p{L}")


def windows_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, the last of each padded with zero bytes, and each window's text."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), count)
    out = np.zeros(len(text) * WINDOW, np.uint8)
    if len(size) == 1:
        out[: len(buf)] = buf
    else:
        out[np.arange(len(buf)) + np.repeat((np.cumsum(count) - count) * WINDOW - offsets[:-1], size)] = buf
    return out.reshape(-1, WINDOW), text


class ByteCnn:
    """Embedding, filters and softmax weights."""

    def __init__(self, languages: list[str], dim: int = 8, filters: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"E": rng.normal(0, 0.5, (256, dim)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, 1 / np.sqrt(w * dim), (w * dim, filters)).astype(np.float32)
        self.p["V"] = rng.normal(0, 0.1, (filters * len(WIDTHS), len(languages))).astype(np.float32)
        self.p["c"] = np.zeros(len(languages), np.float32)
        self.filters, self.dim = filters, dim

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on the cross-entropy; gradients pass only through the places that max pooling chose."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for lo in range(0, len(order), batch):
                x, y = windows[order[lo : lo + batch]], labels[order[lo : lo + batch]]
                g = self._gradients(x, y)
                step += 1
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.999 * s[k] + 0.001 * v * v
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n, p, f = len(x), self.p, self.filters
        emb = p["E"][x]
        pooled, chosen = [], []
        for w in WIDTHS:
            sliding = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1).transpose(0, 1, 3, 2).reshape(n, -1, w * self.dim)
            answers = sliding @ p[f"W{w}"]
            at = answers.argmax(1)
            chosen.append(at)
            pooled.append(np.take_along_axis(answers, at[:, None], 1)[:, 0])
        z = np.concatenate(pooled, 1)
        active = np.maximum(z, 0)
        logits = active @ p["V"] + p["c"]
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        d = prob
        d[np.arange(n), y] -= 1
        d /= n
        g = {"V": active.T @ d, "c": d.sum(0), "E": np.zeros_like(p["E"])}
        dz = (d @ p["V"].T) * (z > 0)
        rows = np.arange(n)[:, None]
        for i, w in enumerate(WIDTHS):
            dw = dz[:, i * f : (i + 1) * f]
            places = chosen[i][:, :, None] + np.arange(w)  # text x filter x w
            seen = x[rows[:, :, None], places]
            flat = p["E"][seen].reshape(n, f, w * self.dim)
            g[f"W{w}"] = np.einsum("nfk,nf->kf", flat, dw)
            back = np.einsum("nf,kf->nfk", dw, p[f"W{w}"]).reshape(n, f, w, self.dim)
            np.add.at(g["E"], seen.reshape(-1), back.reshape(-1, self.dim))
        return g

    def tables(self) -> list[tuple[int, list[tuple[int, np.ndarray]]]]:
        """For each width, (offset, table) of the lookups whose sum is the filters' answer."""
        e, d, out = self.p["E"], self.dim, []
        for w in WIDTHS:
            part = [e @ self.p[f"W{w}"][j * d : (j + 1) * d] for j in range(w)]
            looks = []
            for j in range(0, w - 1, 2):
                looks.append((j, (part[j][None, :, :] + part[j + 1][:, None, :]).reshape(65536, -1)))  # low byte first
            if w % 2:
                looks.append((w - 1, part[-1]))
            out.append((w, looks))
        return out

    def logits(self, windows: np.ndarray, tables: list) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for lo in range(0, len(windows), _BATCH):
            x = windows[lo : lo + _BATCH]
            pairs = x[:, :-1].astype(np.uint16) | (x[:, 1:].astype(np.uint16) << 8)
            pooled = []
            for w, looks in tables:
                n = WINDOW - w + 1
                total = None
                for j, table in looks:
                    rows = table.take((pairs if len(table) > 256 else x)[:, j : j + n], axis=0)
                    total = rows if total is None else np.add(total, rows, out=total)
                pooled.append(total.max(1))
            out[lo : lo + _BATCH] = np.maximum(np.concatenate(pooled, 1), 0) @ self.p["V"] + self.p["c"]
        return out


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string")) % folds == 0


def train_language_model(
    docs: DataFrame,
    *,
    text_col: str = "text",
    label_col: str = "lang",
    order_col: str = "doc_id",
    docs_per_language: int = DOCS_PER_LANGUAGE,
    windows_per_doc: int = WINDOWS_PER_DOC,
) -> ByteCnn | None:
    """A network fitted on at most ``docs_per_language`` texts of each language, chosen by a hash of ``order_col`` and the text.

    Rows with null label or null text teach nothing.  None if no labelled text is left; more than MAX_LANGUAGES labels are
    refused (ValueError).
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(text.alias("text"), F.col(label_col).cast("string").alias("label"), F.xxhash64(order_col, text).alias("h"))
    rows = rows.filter(F.col("label").isNotNull() & (F.length("text") > 0))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if not counts:
        return None
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # Thresholds on the hash leave about twice the bound of each language; the bound itself is applied below.
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2 * docs_per_language / n + 50 / n))])
    sampled = rows.filter(F.pmod("h", F.lit(1 << 30)) < F.element_at(share, F.col("label")) * (1 << 30)).select("h", "label", "text")
    first = F.row_number().over(Window.partitionBy("label").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column(2))
            blobs = []
            for i in range(batch.num_rows):
                own, _ = windows_of(buf[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                at = np.unique(np.linspace(0, len(own) - 1, windows_per_doc).astype(int))
                blobs.append(own[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["h", "label", "windows"])

    windows = sampled.mapInArrow(tidied(cut), "h long, label string, windows binary")
    found = windows.withColumn("place", first).filter(F.col("place") <= docs_per_language).drop("place").collect()
    languages = sorted(counts)
    xs, ys = [], []
    for k, lang in enumerate(languages):
        own = sorted((r for r in found if r["label"] == lang), key=lambda r: (r["h"], bytes(r["windows"])))
        for r in own:
            x = np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW)
            xs.append(x)
            ys.append(np.full(len(x), k))
    model = ByteCnn(languages)
    model.train(np.concatenate(xs), np.concatenate(ys))
    return model


def predict_language(docs: DataFrame, model: ByteCnn | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; ``und`` and 0 for texts without a letter or without a model.

    Null and empty texts are ``und``.  Every window of a long text counts.  Repeated rows are judged one by one; other
    columns, the label among them, are not read.
    """

    tables = model.tables() if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            n = batch.num_rows
            sums = np.concatenate(([0], np.cumsum(_ASCII_LETTER[buf])))
            letter = np.diff(sums[offsets]) > 0
            for i in np.flatnonzero(~letter & (np.diff(offsets) > 0)):
                letter[i] = _LETTER.search(bytes(buf[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace")) is not None
            names, scores = np.full(n, "und", object), np.zeros(n)
            if model:
                total = np.zeros((n, len(model.languages)))
                count = np.zeros(n)
                for lo, hi in chunks(offsets):
                    own = offsets[lo : hi + 1]
                    x, text = windows_of(buf[own[0] : own[-1]], own - own[0])
                    for at in range(0, len(x), CHUNK // WINDOW):
                        part, whose = x[at : at + CHUNK // WINDOW], text[at : at + CHUNK // WINDOW] + lo
                        np.add.at(total, whose, model.logits(part, tables))
                        count += np.bincount(whose, minlength=n)
                mean = total / np.maximum(count, 1)[:, None]
                prob = np.exp(mean - mean.max(1, keepdims=True))
                prob /= prob.sum(1, keepdims=True)
                best = prob.argmax(1)
                names = np.where(letter, np.array(model.languages, object)[best], "und")
                scores = np.where(letter, prob[np.arange(n), best], 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"]
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(tidied(run), "doc_id long, lang_pred string, score double")
