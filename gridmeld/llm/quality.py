"""Quality classification by random-indexing word vectors and a small network.

Every word has a sparse random index vector that follows from its hash. A word's
vector is the sum of the index vectors of the words around it, over a training
sample; a document is the mean of its words' vectors, next to the mean of its
words' own index vectors (which stands for words not seen in training) and of the
index vectors of its words' shapes. A two-layer network maps that to a score whose
temperature is fitted on rows held back from training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shipped, written
from .textbytes import BYTE_VALUES, LOWER, Powers, chunks, mix, span_hashes, word_spans

DIMENSIONS, ENTRIES, SLOTS, NEAR = 64, 6, 1 << 15, 2

_SHAPE = np.full(256, 5, dtype=np.uint64)  # other signs
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 1, 2, 3, 4
_SHAPE[[*b".,;:!?"]] = 6
_INDEX: list[np.ndarray] = []


def _index_vectors() -> np.ndarray:
    """The index vector of each slot that word hashes fall into: ENTRIES of +1 or -1."""
    if not _INDEX:
        rng = np.random.default_rng(20)
        out = np.zeros((SLOTS, DIMENSIONS), dtype=np.float32)
        for _ in range(ENTRIES):
            out[np.arange(SLOTS), rng.integers(0, DIMENSIONS, SLOTS)] += rng.choice(np.array([-1, 1], np.float32), SLOTS)
        _INDEX.append(out / np.sqrt(ENTRIES))
    return _INDEX[0]


def _words(data: np.ndarray, offsets: np.ndarray, pw: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot of the word, slot of its shape and hash of each word of a chunk.

    A shape is the word's run-free sequence of byte kinds with its last sign, so
    THE!! and AND!! have one shape.
    """
    starts, ends, rows = word_spans(data, offsets)
    word = span_hashes(BYTE_VALUES[LOWER[data]], starts, ends, pw)
    kind = _SHAPE[data]
    change = np.r_[True, kind[1:] != kind[:-1]] if len(data) else np.zeros(0, bool)
    change[starts] = True
    step = np.where(change, BYTE_VALUES[kind.astype(np.int64)], np.uint64(0))
    nth = np.cumsum(change).astype(np.int64)
    depth = nth - nth[starts][np.searchsorted(starts, np.arange(len(data)), side="right") - 1] if len(starts) else nth
    weight = BYTE_VALUES[(np.clip(depth, 0, 7) + 100)]
    total = np.r_[np.uint64(0), np.cumsum(step * weight)]
    last = data[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    lengthy = np.minimum((ends - starts) // 6, 4).astype(np.uint64)
    shape = mix(total[ends] - total[starts] + np.where(_SHAPE[last.astype(np.int64)] >= 5, last, np.uint64(0)) * np.uint64(0x9E3779B1) + lengthy * np.uint64(0x85EBCA77))
    mask = np.uint64(SLOTS - 1)
    return rows, (word & mask).astype(np.int64), (shape & mask).astype(np.int64), word


def _sums(rows: np.ndarray, slots: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    """The sum per row of the table's vectors at the slots (rows in order)."""
    out = np.zeros((n, table.shape[1]))
    if len(rows):
        edge = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        for s in range(0, len(edge), 64):  # a few documents at a time, so that little is gathered at once
            first, end = edge[s], edge[s + 64] if s + 64 < len(edge) else len(rows)
            out[rows[edge[s : s + 64]]] = np.add.reduceat(table[slots[first:end]], edge[s : s + 64] - first, axis=0)
    return out


def features(data: np.ndarray, offsets: np.ndarray, context: np.ndarray, pw: Powers) -> np.ndarray:
    """The pooled vectors of a chunk's texts, and how much they repeat themselves."""
    n = len(offsets) - 1
    rows, slots, shapes, words = _words(data, offsets, pw)
    count = np.bincount(rows, minlength=n)
    pooled = np.concatenate([_sums(rows, slots, context, n), _sums(rows, slots, _index_vectors(), n), _sums(rows, shapes, _index_vectors(), n)], axis=1) / np.maximum(count, 1)[:, None]
    same = np.r_[False, (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])] if len(words) else np.zeros(0, bool)
    repeats = np.bincount(rows, weights=same, minlength=n) / np.maximum(count, 1)
    edge = np.searchsorted(rows, np.arange(n + 1))
    kinds = np.array([len(np.unique(slots[a:b])) for a, b in zip(edge[:-1], edge[1:])])
    variety = kinds / np.maximum(np.minimum(count, SLOTS), 1) ** 0.8
    lengths = np.log1p(count)
    return np.column_stack([pooled, repeats, variety, lengths / 10, count == 0])


@dataclass
class QualityModel:
    """Word vectors and the network; `temperature` divides its output, and `shift` makes
    up for labels that the sample holds in other shares than the table."""

    context: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    shift: float = 0.0

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Standardised features; the pooled ones of a text of few words lean to the mean."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        words = np.expm1(10 * x[:, -2])
        z[:, : 3 * DIMENSIONS] *= (words / (words + 3))[:, None]
        return z

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = self.inputs(x)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.shift, -500, 500)))


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task the sums of neighbours' index vectors for each word slot met."""
    index, pw = _index_vectors(), Powers()
    total = np.zeros((SLOTS, DIMENSIONS), dtype=np.float32)
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(0)):
            rows, slots, _, _ = _words(data, offsets, pw)
            for d in range(1, NEAR + 1):
                a, b = slots[:-d], slots[d:]
                ok = rows[:-d] == rows[d:]
                for x, y in ((a[ok], b[ok]), (b[ok], a[ok])):
                    order = np.argsort(x, kind="stable")
                    x, y = x[order], y[order]
                    for s in range(0, len(x), 1 << 18):
                        edge = np.flatnonzero(np.r_[True, x[s + 1 : s + (1 << 18)] != x[s : s + (1 << 18)][:-1]]) if len(x[s : s + (1 << 18)]) else []
                        if len(edge):
                            total[x[s : s + (1 << 18)][edge]] += np.add.reduceat(index[y[s : s + (1 << 18)]], edge, axis=0)
    used = np.flatnonzero(np.abs(total).sum(1) > 0)
    for s in range(0, len(used), 5000):
        part = used[s : s + 5000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(list(total[part].astype(np.float64)), pa.list_(pa.float64()))], names=["slot", "v"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 6000, hidden: int = 24, rounds: int = 400) -> QualityModel | None:
    """Fits the model to at most `most_rows` labelled rows, those with the smallest
    hash of the id, half of them from each label as far as there are as many. Every
    fifth row is held back to fit the temperature. Null when no row has a label.

    The rows are chosen from the labels alone, repeated ones once; only the chosen, a
    bounded number, go to where the texts are. Of rows that share an id one text is
    taken, that with the smallest hash.
    """
    label = F.col(label_col).cast("int")
    known = labels.where(label.isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), label.alias("y"), F.xxhash64(id_col).alias("h"))
    first = lambda y: known.where(F.col("y") == y).distinct().orderBy("h", "id").limit(most_rows // 2)
    chosen = written(first(0).unionByName(first(1)), "quality_rows")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id", "y", "h").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    back = F.pmod(F.xxhash64("h", F.lit(1)), F.lit(5)) == 0
    sample = written(sample.select("text", "y", "h", back.alias("back")).repartition(8, "h"), "quality_sample")
    summed = sample.where("not back").select("text").mapInArrow(_context_sums, "slot long, v array<double>")
    summed = summed.groupBy("slot").agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(DIMENSIONS)]).alias("v")).toArrow()  # at most SLOTS rows
    context = np.zeros((SLOTS, DIMENSIONS), dtype=np.float32)
    if summed.num_rows:
        v = np.asarray(summed.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, DIMENSIONS)
        context[summed.column("slot").to_numpy()] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    sent = sample.sparkSession.sparkContext.broadcast(context)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pw = Powers()
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(0)):
                x = features(data, offsets, sent.value, pw)
                yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], batch.column(2)[a:b], batch.column(3)[a:b], pa.array(list(x), pa.list_(pa.float64()))], names=["y", "back", "h", "x"])

    got = sample.select("text", "y", "back", "h").mapInArrow(measure, "y int, back boolean, h long, x array<double>").toArrow().to_pandas().sort_values(["h", "y"])
    if not len(got):
        return None
    x, y, back = np.stack(got["x"].to_numpy()), got["y"].to_numpy().astype(float), got["back"].to_numpy()
    if back.all() or not back.any():
        back = np.zeros(len(y), bool)
    model = _train(context, x, y, back, hidden, rounds)
    odds = lambda n: np.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1))
    whole = {r["y"]: r["count"] for r in labels.where(label.isin(0, 1)).groupBy(label.alias("y")).count().collect()}  # two rows
    model.shift = float(odds(whole) - odds({1: int(y.sum()), 0: int((1 - y).sum())}))
    return model


def _train(context: np.ndarray, x: np.ndarray, y: np.ndarray, back: np.ndarray, hidden: int, rounds: int) -> QualityModel:
    """Adam on the log loss with weight decay; then the temperature on the rows held back."""
    xt, yt = x[~back], y[~back]
    rng = np.random.default_rng(3)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    model = QualityModel(context, xt.mean(0), np.maximum(xt.std(0), 1e-3), p[0], p[1], p[2], 0.0, 1.0)
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    z, step = model.inputs(xt), 0
    batch = min(256, max(16, len(z) // 8))
    for _ in range(rounds // 8):
        for part in np.array_split(rng.permutation(len(z)), max(1, len(z) // batch)):
            step += 1
            a = np.tanh(z[part] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3][0], -50, 50))) - yt[part]) / len(part)
            back_a = np.outer(d, p[2]) * (1 - a**2)
            grads = [z[part].T @ back_a + 1e-3 * p[0], back_a.sum(0), a.T @ d + 1e-3 * p[2], np.array([d.sum()])]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= 0.005 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = p[0], p[1], p[2], float(p[3][0])
    xb, yb = (x[back], y[back]) if back.any() else (xt, yt)
    soft = 1 / (len(yb) + 2)  # a few rows held back can't show that the network is ever certain
    logits, target = model.logits(xb), yb * (1 - 2 * soft) + soft
    losses = [(np.mean(target * np.logaddexp(0, -logits / t) + (1 - target) * np.logaddexp(0, logits / t)), t) for t in np.geomspace(0.3, 10, 60)]
    model.temperature = float(min(losses)[1])
    return model


def score_quality(docs: DataFrame, model: QualityModel | None, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from `threshold` on) to docs, in place of
    columns of these names.

    Each row is scored by its whole text alone, so repeated rows agree; null is an
    empty text, which has a score too. Without a model (no labelled row) every score
    is 0.5. An empty table gives an empty table.
    """
    docs = docs.drop("score", "predicted")
    columns = docs.columns
    at = columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    sent = shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, pw = sent(), Powers()
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if m is not None:
                for a, b, data, offsets in chunks(batch.column(at)):
                    score[a:b] = m.score(features(data, offsets, m.context, pw))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*columns, "score", "predicted"])

    return docs.mapInArrow(run, schema)
