"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  Its features are those of the line itself and of its
neighbours; the chain adds how likely lines of either kind follow each other.  Forward-
backward gives each line's probability of being good, and the length-weighted mean of these,
calibrated, is the document's score.

Labels mark documents, not lines.  Training starts with each line taking its document's
label; then lines of bad documents that the model finds good are relabelled (never all
of a document) and it is trained again.  The model is fitted on at most ``SAMPLE_ROWS``
labelled documents, whole, in the order of a hash of their id; the corpus only gets scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import map_arrow, slices

SAMPLE_ROWS = 3000  # labelled documents a model is fitted on, at most
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
_CHAIN_LINES = 200  # lines of one training sequence; longer documents give several
_STEPS, _RATE, _L2 = 250, 0.08, 1e-3

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"*%$&#!|~^<>{}[]\\"
_PUNCTUATION = b".,;:?'\"()-"
_LINE_FEATURES = 13
FEATURES = 3 * _LINE_FEATURES


def line_features(lines: list[str]) -> np.ndarray:
    """One row per line of a document: shares of characters, word shapes, repetition."""
    out = np.zeros((len(lines), _LINE_FEATURES), dtype=np.float32)
    seen = Counter(lines)
    for i, line in enumerate(lines):
        raw = line.encode("utf-8", "surrogatepass")
        n = len(raw)
        if not n:
            out[i, 0] = 1
            continue
        words = raw.split()
        m = max(1, len(words))
        left = [n - len(raw.translate(None, kind)) for kind in (_UPPER, _LOWER, _DIGIT, _SYMBOL, _PUNCTUATION)]
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        out[i] = (0, left[0] / n, left[1] / n, left[2] / n, min(1.0, 3 * left[3] / n), left[3] > 0, left[4] / n,
                  len(set(words)) / m, again / m, min(2.0, n / m / 10), min(1.0, m / 40),
                  raw[-1:] in (b".", b"?", b'"'), seen[line] > 1)
    return out


def with_neighbours(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Features of the line, the line before and the line behind (zero beyond the document)."""
    before, behind = np.zeros_like(rows), np.zeros_like(rows)
    before[1:], behind[:-1] = rows[:-1], rows[1:]
    before[starts] = 0
    behind[np.append(starts[1:], len(rows)) - 1] = 0
    return np.hstack([rows, before, behind])


@dataclass
class Model:
    """weights and bias of "good" against "bad"; stay: log-odds of keeping the label, by label (bad, good);
    scale, shift: calibration of the log-odds of a document's mean."""
    weights: np.ndarray
    bias: float
    stay: tuple[float, float]
    scale: float
    shift: float


def _chains(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-lengths, kind="stable")
    return starts[order], lengths[order]


def marginals(unary: np.ndarray, starts: np.ndarray, lengths: np.ndarray, stay: tuple[float, float]):
    """P(good) of each line, and for training the log normaliser and expected kept labels of all chains.

    ``unary``: log-odds of good per line; chains of all documents advance together, the longest first.
    """
    s, n = _chains(starts, lengths)
    steps = int(n[0]) if len(n) else 0
    active = [int(np.searchsorted(-n, -t, side="right")) for t in range(1, steps + 1)]  # chains with at least t lines
    e_bad, e_good = np.exp(stay[0]), np.exp(stay[1])
    good = np.exp(np.clip(unary, -30, 30))
    forward = np.empty((len(unary), 2))
    log_z = 0.0
    for t in range(steps):
        k = active[t]
        at = s[:k] + t
        if t:
            p = forward[at - 1]
            bad_in, good_in = p[:, 0] * e_bad + p[:, 1], p[:, 0] + p[:, 1] * e_good
        else:
            bad_in, good_in = np.ones(k), np.ones(k)
        good_in = good_in * good[at]
        z = bad_in + good_in
        log_z += np.log(z).sum()
        forward[at, 0], forward[at, 1] = bad_in / z, good_in / z
    back = np.ones((len(unary), 2))
    kept = np.zeros(2)
    for t in range(steps - 2, -1, -1):
        k = active[t + 1]
        at = s[:k] + t
        bad_on, good_on = back[at + 1, 0], back[at + 1, 1] * good[at + 1]
        b, g = bad_on * e_bad + good_on, bad_on + good_on * e_good
        joint = forward[at, 0] * b + forward[at, 1] * g
        kept[0] += (forward[at, 0] * e_bad * bad_on / joint).sum()
        kept[1] += (forward[at, 1] * e_good * good_on / joint).sum()
        z = b + g
        back[at, 0], back[at, 1] = b / z, g / z
    both = forward * back
    return both[:, 1] / both.sum(axis=1), log_z, kept


def _fit_chain(x, labels, starts, lengths, weight):
    """Adam on the conditional likelihood of line labels; ``weight`` of each line evens out the classes."""
    theta = np.zeros(x.shape[1] + 3)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.ones(len(labels), dtype=bool)
    inner[starts] = False
    pairs = np.flatnonzero(inner)
    kept = np.array([((labels[pairs] == v) & (labels[pairs - 1] == v)).sum() for v in (0, 1)], dtype=float)
    for step in range(1, _STEPS + 1):
        p, _, expected = marginals(x @ theta[:-3] + theta[-3], starts, lengths, (theta[-2], theta[-1]))
        off = weight * (labels - p)
        grad = np.concatenate((x.T @ off, [off.sum()], kept - expected)) / len(labels) - _L2 * theta
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        theta += _RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        theta[-2:] = np.clip(theta[-2:], 0, 4)  # kept labels are never less likely than changes
    return theta


def _means(p, sizes, starts):
    return np.add.reduceat(p * sizes, starts) / np.add.reduceat(sizes, starts)


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(docs: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """A model from (label, line features, line lengths) of documents; one of no documents scores 0.5."""
    if not docs:
        return Model(np.zeros(FEATURES), 0.0, (0.0, 0.0), 0.0, 0.0)
    lengths = np.array([len(d[1]) for d in docs])
    starts = np.cumsum(lengths) - lengths
    x = with_neighbours(np.concatenate([d[1] for d in docs]), starts).astype(float)
    truth = np.array([d[0] for d in docs])
    labels = np.repeat(truth, lengths).astype(float)
    sizes = np.concatenate([d[2] for d in docs]).astype(float) + 1
    cuts = np.concatenate([np.arange(s, s + n, _CHAIN_LINES) for s, n in zip(starts, lengths, strict=True)])
    cut_lengths = np.diff(np.append(cuts, len(labels)))
    for _ in range(2):
        share = np.clip(labels.mean(), 0.01, 0.99)
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        theta = _fit_chain(x, labels, cuts, cut_lengths, weight)
        p = marginals(x @ theta[:-3] + theta[-3], starts, lengths, (theta[-2], theta[-1]))[0]
        worst = np.minimum.reduceat(p, starts)
        labels = np.where((np.repeat(truth, lengths) == 0) & ((p < 0.5) | (p <= np.repeat(worst, lengths))), 0.0, 1.0)
    mean = _logit(_means(p, sizes, starts))
    centre, spread = mean.mean(), mean.std() + 1e-6
    z, ab = (mean - centre) / spread, np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps of a two-parameter logistic curve
        q = 1 / (1 + np.exp(-np.clip(ab[0] * z + ab[1], -30, 30)))
        basis = np.stack([z, np.ones_like(z)])
        grad = basis @ (truth - q) - 1e-2 * len(z) * np.array([ab[0], 0]) / 100
        hess = (basis * (q * (1 - q))) @ basis.T + np.diag([1e-4 * len(z) + 1e-6, 1e-6])
        ab = ab + np.clip(np.linalg.solve(hess, grad), -2, 2)
    scale = max(1e-3, float(ab[0] / spread))  # a higher mean never gives a lower score
    shift = float(ab[1] - scale * centre)
    return Model(theta[:-3], float(theta[-3]), (float(theta[-2]), float(theta[-1])), scale, shift)


def _split(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _sizes(lines: list[str]) -> np.ndarray:
    return np.array([len(x) for x in lines], dtype=float)


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    """Score of each text; a null or empty text is one empty line."""
    cut = [_split(t) for t in texts]
    lengths = np.array([len(c) for c in cut])
    starts = np.cumsum(lengths) - lengths
    x = with_neighbours(np.concatenate([line_features(c) for c in cut]), starts)
    p = marginals(x @ model.weights + model.bias, starts, lengths, model.stay)[0]
    mean = _means(p, np.concatenate([_sizes(c) for c in cut]) + 1, starts)
    return 1 / (1 + np.exp(-np.clip(model.scale * _logit(mean) + model.shift, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2.  A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on up to ``sample_rows`` labelled documents outside the held-out part.

    Labels or texts that are null are left out; an id with several labels or rows may take part several times, within the bound.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(order, "doc_id", "quality").limit(sample_rows))
    # At most sample_rows narrow rows: bounded by the parameter, whatever the corpus.
    labelled = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            cut = [_split(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("quality"),
                 pa.array([line_features(c).tobytes() for c in cut], pa.binary()),
                 pa.array([_sizes(c).tobytes() for c in cut], pa.binary())], ["doc_id", "quality", "features", "sizes"])

    found = map_arrow(labelled, run, "doc_id string, quality int, features binary, sizes binary")
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", F.xxhash64("features")).limit(sample_rows).collect()
    return fit([(min(1, max(0, r.quality)), np.frombuffer(r.features, np.float32).reshape(-1, _LINE_FEATURES),
                 np.frombuffer(r.sizes)) for r in rows])


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (all columns, as they are, in the struct ``row``) with ``score``."""
    packed = docs.select(F.struct("*").alias("row"), F.col("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())])  # names of any kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            score = score_texts(model, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score)], ["row", "score"])

    return map_arrow(packed, run, schema)


def predicted(score: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(score >= threshold, 1).otherwise(0)
