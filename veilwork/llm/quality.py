"""Quality rules: exact base counts and a calibrated n-gram logistic regression.

Features are hashed word 1- and 2-grams and hashed character (byte) 3-grams of the whole lower-cased
text, each family as relative frequencies, so a text's score is the mean weight of its word grams plus
the mean weight of its character grams plus a bias: one gather a gram, no dictionary. The regression
is trained on a bounded, documented sample of labelled rows (at most `per_class` of each class, least
hashes of doc_id first); a fifth of the sample is held out to fit Platt's sigmoid, with rows weighted
back to the labels' class shares, so the result is a probability for rows as they come. A document is
kept if it passes the base rules and its probability of good quality reaches the fixed threshold.

Defined cases: a null text has no words (and fails the base rules); a text of any length is read whole; labels with a
null id or quality are not used, nor those of an id that has labels of both classes; equal labels of an id count
once, and of documents that share a labelled id the least text is trained on; without labels of both classes there is
no model and the base rules decide alone; rows are independent, so repeated ids give a row each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import LOWER, NON_SPACE, char_counts, keep_rows, mix64, run_ranks, span_hashes, span_ranks, sub_batches, text_buffers, word_bounds

SIZE = 1 << 15
PER_CLASS, THRESHOLD = 1500, 0.5
_U = np.uint64
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_good double"


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive entries of `at`."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _repeats(owner: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count of each entry's (owner, rank), whether an equal entry stands before it)."""
    if not len(ranks):
        return ranks, np.zeros(0, bool)
    _, first, back, count = np.unique(owner * (int(ranks.max()) + 1) + ranks, return_index=True, return_inverse=True, return_counts=True)
    return count[back], first[back] != np.arange(len(ranks))


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, off = text_buffers(column)
    docs = len(off) - 1
    starts, ends, at = word_bounds(data, off, NON_SPACE)
    chars = char_counts(data)
    ranks = span_ranks(data, starts, ends)

    cut = np.unique(np.concatenate([off[:-1], np.flatnonzero(data == 0x0A) + 1]))
    cut = cut[cut < len(data)]
    stop = np.append(cut[1:], len(data))
    doc = np.searchsorted(off, cut, "right") - 1
    stop = stop - (data[np.maximum(stop, 1) - 1] == 0x0A) if len(cut) else stop
    full = np.searchsorted(starts, stop) > np.searchsorted(starts, cut) if len(cut) else np.zeros(0, bool)
    _, again = _repeats(doc[full], span_ranks(data, cut[full], stop[full]))
    dup = np.bincount(doc[full][again], minlength=docs)

    owner = np.repeat(np.arange(docs), np.diff(at))
    covered = np.zeros(len(ranks), bool)
    if len(ranks) > 2:
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        often = inside[_repeats(owner[inside], run_ranks(ranks, 3)[inside])[0] >= 2]
        for k in range(3):
            covered[often + k] = True
    return {"n_words": np.diff(at), "word_chars": _sums(chars[ends] - chars[starts], at), "n_symbols": _sums(_SYMBOL[data], off), "n_dup_lines": dup, "n_repeat_words": _sums(covered, at)}


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word gram features, first of each text, character gram features, first of each text)."""
    data, off = text_buffers(column)
    low = LOWER[data]
    starts, ends, at = word_bounds(low, off, NON_SPACE)
    hashes = span_hashes(low, starts, ends)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(at))
    two = np.zeros(len(hashes), _U)
    if len(hashes) > 1:
        two[:-1] = np.where(owner[:-1] == owner[1:], mix64(hashes[:-1] * _U(7) + hashes[1:]), hashes[:-1])
        two[-1] = hashes[-1]
    words = np.stack([hashes, two], axis=1).ravel() >> _U(49)  # a text's last word stands for its missing pair
    code = low.astype(np.uint32)
    three = np.zeros(len(low), np.uint32)
    if len(low) > 2:
        three[:-2] = code[:-2] | code[1:-1] << np.uint32(8) | code[2:] << np.uint32(16)
        for edge in off[1:-1]:  # grams do not cross documents
            three[max(0, edge - 2) : edge] = 0
    return words.astype(np.int64), 2 * at, (three * np.uint32(0x9E3779B1) >> np.uint32(17)).astype(np.int64), off


class Model:
    """Weights of both families, bias, and the two numbers of the sigmoid."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0) -> None:
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float64), bias, slope, shift

    def scores(self, column: pa.Array) -> np.ndarray:
        words, at, chars, off = grams(column)
        out = np.full(len(off) - 1, self.bias)
        for features, edge, base in ((words, at, 0), (chars, off, SIZE)):
            out += _sums(self.weights[base + features], edge) / np.maximum(np.diff(edge), 1)
        return out

    def probabilities(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.scores(column) + self.shift, -40, 40)))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(quality, bucket, text) -> quality, bucket and the text's features with their shares."""
    for batch in sub_batches(batches, "text"):
        words, at, chars, off = grams(batch.column(2))
        index, value = [], []
        for k in range(len(batch)):
            parts = [(base, *np.unique(x[e[k] : e[k + 1]], return_counts=True)) for x, e, base in ((words, at, 0), (chars, off, SIZE))]
            index.append(np.concatenate([base + i for base, i, _ in parts]).astype(np.int32))
            value.append(np.concatenate([n / max(1, n.sum()) for _, _, n in parts]).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["quality", "bucket", "index", "value"])


def fit(index: list[np.ndarray], value: list[np.ndarray], y: np.ndarray, weight: np.ndarray, held: np.ndarray, rounds: int = 150, decay: float = 1e-6) -> Model:
    """Logistic regression by full-batch Adam on the rows that are not held; Platt's sigmoid on those that are."""
    sizes = np.array([len(x) for x in index])
    row, flat, v = np.repeat(np.arange(len(y)), sizes), np.concatenate(index), np.concatenate(value).astype(np.float64)
    train = ~held
    balance = np.where(y > 0, 0.5 / max(1, (y[train] > 0).sum()), 0.5 / max(1, (y[train] == 0).sum())) * train
    spread = np.sqrt(np.bincount(flat, v * v, 2 * SIZE) / len(y)) + 1e-5
    v = v / spread[flat] * 0.05  # every feature on the same footing
    w, bias = np.zeros(2 * SIZE), 0.0
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        score = np.bincount(row, w[flat] * v, len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - y) * balance
        g, gb = np.bincount(flat, error[row] * v, 2 * SIZE) + decay * w, error.sum()
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        fix, fix2 = 1 - 0.9**t, 1 - 0.99**t
        w = w - 0.05 * (m / fix) / (np.sqrt(s / fix2) + 1e-8)
        bias -= 0.05 * (mb / fix) / (np.sqrt(sb / fix2) + 1e-8)
    score = np.bincount(row, w[flat] * v, len(y)) + bias
    a, b = 1.0, 0.0
    x, t, k = score[held], y[held], weight[held]
    if 0 < t.sum() < len(t):
        pos, neg = (k * t).sum(), (k * (1 - t)).sum()
        t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))  # Platt's smoothed targets
        k = k / (pos + neg)
        loss = lambda a, b: float((k * (np.logaddexp(0, a * x + b) - t * (a * x + b))).sum())
        for _ in range(100):  # Newton steps, halved until the loss falls
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
            g = np.array([(k * (p - t) * x).sum(), (k * (p - t)).sum()])
            h = k * p * (1 - p)
            step = np.linalg.solve(np.array([[(h * x * x).sum(), (h * x).sum()], [(h * x).sum(), h.sum()]]) + 1e-6 * np.eye(2), g)
            now, size = loss(a, b), 1.0
            while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) >= now:
                size /= 2
            if size <= 1e-6:
                break
            a, b = a - size * float(step[0]), b - size * float(step[1])
    return Model(w / spread * 0.05, bias, max(a, 1e-3), b)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """The model from at most per_class labelled rows of each class; None if a class has none."""
    good = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("int").alias("quality"))
    good = good.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    total = {r[0]: r[1] for r in good.groupBy("quality").count().collect()}
    if set(total) != {0, 1}:
        return None
    hashed = good.withColumn("h", F.xxhash64("doc_id"))
    picked = [hashed.where(F.col("quality") == c).orderBy("h", "doc_id").limit(per_class) for c in (0, 1)]
    sample = picked[0].union(picked[1]).select(F.col("doc_id").alias("of"), "quality", F.pmod("h", F.lit(5)).cast("int").alias("bucket"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("of"))  # 2 * per_class rows at most
    rows = rows.groupBy("of", "quality", "bucket").agg(F.min("text").alias("text")).drop("of")
    found = rows.mapInArrow(_sparse, "quality int, bucket int, index array<int>, value array<float>").toArrow()
    y = found.column("quality").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    index, value = ([np.asarray(x.values) for x in found.column(c)] for c in ("index", "value"))
    order = sorted(range(len(y)), key=lambda i: (y[i], len(index[i]), index[i].tobytes(), value[i].tobytes()))  # rows come in any order
    index, value, y = [index[i] for i in order], [value[i] for i in order], y[order]
    weight = np.where(y > 0, total[1] / max(1, y.sum()), total[0] / max(1, (1 - y).sum()))
    return fit(index, value, y, weight, found.column("bucket").to_numpy()[order] == 0)


def _judged(column: pa.Array, model: Model | None, threshold: float, least_words: int, repeat_percent: int) -> dict[str, np.ndarray]:
    c = base_counts(column)
    c["base_failed"] = (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > repeat_percent * c["n_words"])
    c["p_good"] = model.probabilities(column) if model else np.full(len(column), np.nan)
    c["kept"] = ~c["base_failed"] & ((c["p_good"] >= threshold) if model else True)
    return c


def quality(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, least_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """docs (doc_id, text) -> base counts, base_failed, kept and p_good (NaN without a model); one row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            c = _judged(batch.column(1), shared.value, threshold, least_words, repeat_percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c[k] if c[k].dtype.kind in "bf" else c[k].astype(np.int64)) for k in names[1:])], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, least_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """The rows of docs that `quality` keeps, with all their columns, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda column: _judged(column, shared.value, threshold, least_words, repeat_percent)["kept"])
