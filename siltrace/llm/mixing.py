"""Mixing documents to target weights with soft domain membership.

A softmax classifier over hashed words, fitted on a bounded sample of the labelled table, gives every document posteriors
over domains.  Non-negative document rates are then fitted so that the expected tokens of each domain, summed over documents
by rate x tokens x posterior, meet the targets: least squares in the domain residuals with a pull of the rates towards 1,
solved by accelerated projected gradient steps.

Only one number for each domain leaves the executors in a step.  A document's rate depends on its own posteriors and on the
residuals of the steps so far, so that a pass over the table of posteriors replays the steps instead of storing rates.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltrace.llm.kernels import _LOWER_CODES, Words, chunks, text_bytes, tidied
from siltrace.llm.storage import written

FEATURES = 1 << 14
SAMPLE = 4000  # the training bound: labelled documents
DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.90, "poor": 0.09, "toxic": 0.01}  # shares of the mixture's tokens
REFERENCE, PASSES = "good", 1.1  # the mixture holds the reference domain's tokens so many times
PULL = 1e-4  # weight of (rate - 1)**2
STEPS, TOLERANCE = 200, 5e-4
STALLED = 1e-6  # change of all expected shares in a step below which no further step helps


def _counts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature of each word, its text, words of each text)."""
    w = Words(buf, offsets, _LOWER_CODES)
    return (w.hash >> np.uint64(50)).astype(np.int64), w.text, w.count


def domain_of(quality, toxic):
    """Index into DOMAINS of a labelled row: toxic first, then by quality."""
    return F.when(toxic == 1, 2).when(quality == 1, 0).when(quality == 0, 1)


def train_domain_classifier(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: int = 11
) -> np.ndarray | None:
    """Weights (features + bias, domains), fitted on at most ``sample`` labelled documents chosen by a hash of their id.

    Labels with null quality and not toxic, or without a text, teach nothing; a document with several label rows teaches the
    largest domain, one with several texts the text of smallest hash.  None without any labelled text.
    """
    labelled = labels.select(F.col("doc_id").alias("id"), domain_of(F.col("quality"), F.col("toxic")).alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    chosen = labelled.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.length("text") > 0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column(2))
            blobs = []
            for i in range(batch.num_rows):
                own = offsets[i : i + 2]
                f, _, _ = _counts(buf[own[0] : own[1]], own - own[0])
                at, n = np.unique(f, return_counts=True)
                blobs.append(np.stack([at, n]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["id", "y", "f"])

    one = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.first("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.mapInArrow(features, "id long, y int, f binary").collect()
    rows = sorted((r for r in rows if len(r["f"])), key=lambda r: r["id"])
    if not rows:
        return None
    x = []
    total, squares = np.zeros(FEATURES), np.zeros(FEATURES)
    for r in rows:
        at, n = np.frombuffer(r["f"], np.int32).reshape(2, -1)
        x.append((at, (n / n.sum()).astype(np.float32)))
        total[at] += x[-1][1]
        squares[at] += x[-1][1] ** 2
    spread = np.sqrt(np.maximum(squares / len(rows) - (total / len(rows)) ** 2, 0))
    scale = np.append(1 / (spread + 1e-3), 1).astype(np.float32)
    return _softmax_fit(x, np.array([r["y"] for r in rows]), scale, seed) * scale[:, None]


def _softmax_fit(x: list, y: np.ndarray, scale: np.ndarray, seed: int, epochs: int = 6, batch: int = 64, rate: float = 0.02) -> np.ndarray:
    """Adam on the cross-entropy; one batch of rows is dense at a time."""
    rng = np.random.default_rng(seed)
    w = np.zeros((FEATURES + 1, len(DOMAINS)), np.float32)
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            dense = np.zeros((len(own), FEATURES + 1), np.float32)
            for i, k in enumerate(own):
                dense[i, x[k][0]] = x[k][1]
            dense[:, -1] = 1
            dense *= scale
            p = _softmax(dense @ w)
            p[np.arange(len(own)), y[own]] -= 1
            g = dense.T @ p / len(own) + 1e-4 * w
            step += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def domain_posteriors(docs: DataFrame, weights: np.ndarray | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, text_key, n_tokens, posteriors) of every whole text; equal posteriors without words or without a classifier.

    text_key: a hash of the text, which tells rows of one doc_id apart.
    """
    k = len(DOMAINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column(3))
            for lo, hi in chunks(offsets):
                own = offsets[lo : hi + 1]
                feature, text, n = _counts(buf[own[0] : own[-1]], own - own[0])
                p = np.full((len(n), k), 1 / k)
                if weights is not None and len(feature):
                    z = np.stack([np.bincount(text, weights[feature, j].astype(np.float64), len(n)) for j in range(k)], 1)
                    full = n > 0
                    p[full] = _softmax(z[full] / n[full, None] + weights[-1])
                posteriors = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), k).cast(pa.list_(pa.float64()))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n.astype(np.int64)), posteriors], ["rid", "doc_id", "text_key", "n_tokens", "posteriors"])

    source = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text")
    )
    return source.mapInArrow(tidied(run), f"{_DOCUMENT}, n_tokens long, posteriors array<double>")


_DOCUMENT = "rid long, doc_id long, text_key long"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(DOMAINS))


def _rates(p: np.ndarray, residuals: np.ndarray, pull: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(rates, point of the next step) after replaying the steps whose scaled residuals are given; rates lie in [0, most]."""
    r = y = np.ones(len(p))
    t = 1.0
    for e in residuals:
        new = np.clip(y - (p @ e + pull * (y - 1)) / (1 + pull), 0.0, most)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - r)
        r, t = new, t_new
    return r, y


def fit_rates(
    posteriors: DataFrame,
    targets: Mapping[str, float] = TARGETS,
    *,
    reference: str = REFERENCE,
    passes: float = PASSES,
    pull: float = PULL,
    most: float = np.inf,
    steps: int = STEPS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """The rows of ``posteriors`` with ``rate``, whose expected domain tokens match the targets, and ``residuals``.

    targets: each domain's share of the mixture's tokens.  The mixture is as large as its share of the reference domain, at
    ``passes`` times that domain's expected tokens, asks for.  Rates lie in [0, most].  Steps end when every domain's expected
    tokens are within ``tolerance`` of all tokens, or when a step no longer changes them: then the targets cannot be met better.
    residuals: by domain, what the expected tokens are above the target, as a share of all tokens; a warning names them when
    they exceed the tolerance.  Documents without tokens keep rate 1; so do all when no tokens or domains are there.
    """
    k = len(DOMAINS)
    share = np.array([targets[d] for d in DOMAINS], float)
    share /= share.sum()
    names = [f"e{i}" for i in range(k)]

    def totals(residuals: np.ndarray) -> np.ndarray:
        """Expected tokens of each domain at the next step's point, then at the rates."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((2, k))
            for batch in batches:
                p, n = _matrix(batch.column(1)), batch.column(0).to_numpy()
                r, y = _rates(p, residuals, pull, most)
                out += np.stack([(n * y) @ p, (n * r) @ p])
            yield pa.RecordBatch.from_arrays([pa.array(out[i : i + 1, j]) for i in range(2) for j in range(k)], [f"{a}{b}" for a in "yr" for b in names])

        schema = ", ".join(f"{a}{b} double" for a in "yr" for b in names)
        sums = posteriors.select("n_tokens", "posteriors").mapInArrow(run, schema).agg(*[F.sum(f"{a}{b}") for a in "yr" for b in names]).first()
        return np.array([x or 0.0 for x in sums]).reshape(2, k)

    residuals, missed = np.zeros((0, k)), np.zeros(k)
    now = totals(residuals)
    tokens = now[1].sum()
    if tokens > 0:
        have = np.maximum(now[1] / tokens, 1e-12)
        at = DOMAINS.index(reference)
        goal = share * passes * have[at] / max(share[at], 1e-12)
        missed = now[1] / tokens - goal
        for _ in range(steps):
            if np.abs(missed).max() <= tolerance:
                break
            residuals = np.vstack([residuals, (now[0] / tokens - goal) / have])
            before, now = now, totals(residuals)
            missed = now[1] / tokens - goal
            if np.abs(now - before).max() / tokens <= STALLED:
                break
        if np.abs(missed).max() > tolerance:
            warnings.warn(f"targets missed by {dict(zip(DOMAINS, missed.round(5).tolist(), strict=True))} of all tokens", stacklevel=2)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, _ = _rates(_matrix(batch.column(4)), residuals, pull, most)
            r = np.where(batch.column(3).to_numpy() > 0, r, 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r)], [*batch.schema.names, "rate"])

    rows = posteriors.select("rid", "doc_id", "text_key", "n_tokens", "posteriors")
    rated = rows.mapInArrow(final, f"{_DOCUMENT}, n_tokens long, posteriors array<double>, rate double")
    return rated.withColumn("residuals", F.array(*[F.lit(float(x)) for x in missed]))


def mix_to_targets(
    docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, *, id_col: str = "doc_id", text_col: str = "text", **fit
) -> DataFrame:
    """Posteriors and fitted rate of every row of ``docs``; ``fit`` are further arguments of :func:`fit_rates`.

    labels: (doc_id, quality, toxic).  Null and empty texts get equal posteriors and rate 1, repeated rows a rate each; an
    empty table gives an empty result; other columns are not read.
    """
    weights = train_domain_classifier(docs, labels, id_col=id_col, text_col=text_col)
    posteriors = written(domain_posteriors(docs, weights, id_col=id_col, text_col=text_col), "posteriors")
    return fit_rates(posteriors, targets, **fit)


def drawn(docs: DataFrame, rates: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: str = "mixing") -> DataFrame:
    """``docs`` drawn at their rates: the whole part of a rate is the number of copies, its fraction the probability of one more.

    The draw is a hash of id and text.  Rows of one id and text have one rate; repeats of such a row are drawn alike.
    """
    own = [rates["doc_id"], rates["text_key"]]
    chance = F.pmod(F.xxhash64(F.lit(seed), *own), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(rates["rate"]) + (chance < rates["rate"] - F.floor(rates["rate"])).cast("long")
    chosen = rates.select(*own, copies.alias("_copies")).dropDuplicates(["doc_id", "text_key"]).filter("_copies > 0")
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"))
    met = (row["text_key"] == chosen["text_key"]) & row["doc_id"].eqNullSafe(chosen["doc_id"])
    return row.join(chosen, met).select("row", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select("row.*")
