"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.tables import in_arrow, put_back, set_aside, stored
from waymark.llm.text import LOWER, SLICE_BYTES, SPACES, as_bytes, hash_spans, rolling, slices, split

#: Trusted positives that a fit takes at most, a documented bound. Unlabelled documents are not bounded: all of them count.
SAMPLE_ROWS = 8_000
#: Cells, in powers of two, that unlabelled documents are counted in.
CELL_BITS = 7
#: Documents that stand for a cell at most.
CELL_ROWS = 96
_TRIGRAMS, _WORDS = 48, 16
_EACH = np.zeros((256, 6), np.uint8)
_EACH[[*b"#*$%&|<>"], 0] = 1
_EACH[[*b"!?"], 1] = 1
_EACH[[*b".,;:'\"()-"], 2] = 1
_EACH[[*b"0123456789"], 3] = 1
_EACH[0x41:0x5B, 4] = 1
_EACH[[*b"{}[]=@\\^~_/+"], 5] = 1
_MEASURES = 14
N_FEATURES = _MEASURES + _TRIGRAMS + _WORDS
#: The hashed shares are many and each tells little.
_SCALE = np.where(np.arange(N_FEATURES) < _MEASURES, 1.0, 0.1)


def features(texts: pa.Array) -> np.ndarray:
    """Of each text: log words, mean word length, shares of six kinds of characters, of different words, of repeated word triples and lines, of short and long words, and of lines per word; then roots of the shares of hashed letter triples and of hashed words."""
    buf, offsets = as_bytes(texts)
    out = np.zeros((len(offsets) - 1, N_FEATURES))
    newline = np.zeros(256, bool)
    newline[10] = True
    for i, j in slices(offsets, SLICE_BYTES // 4):
        raw, at = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        w = split(raw, at, SPACES)
        h = hash_spans(LOWER[raw], w.start, w.end)
        triples = rolling(h, 3)
        lines = split(raw, at, newline)
        lh = lines.hashes()
        size = w.end - w.start
        kinds = np.concatenate((np.zeros((1, 6), np.int32), np.cumsum(_EACH[raw], axis=0, dtype=np.int32)))
        low = LOWER[raw].astype(np.uint32)
        gram = ((low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(0x9E3779B1) >> np.uint32(16)) % np.uint32(_TRIGRAMS) if len(raw) > 2 else low[:0]
        bucket = (h >> np.uint64(40)) % np.uint64(_WORDS)
        for d in range(j - i):
            a, b = int(w.first[d]), int(w.first[d + 1])
            n, row = b - a, out[i + d]
            if n:
                own = gram[at[d] : max(at[d], at[d + 1] - 2)]
                row[_MEASURES : _MEASURES + _TRIGRAMS] = np.sqrt(np.bincount(own, minlength=_TRIGRAMS) / max(1, len(own)))
                row[_MEASURES + _TRIGRAMS :] = np.sqrt(np.bincount(bucket[a:b].astype(np.int64), minlength=_WORDS) / n)
            row[0] = np.log1p(n)
            if not n:
                continue
            chars = int(size[a:b].sum())
            row[1] = np.log(chars / n)
            row[2:8] = (kinds[at[d + 1]] - kinds[at[d]]) / chars
            row[8] = len(np.unique(h[a:b])) / n
            t = triples[a : b - 2] if n > 2 else h[:0]
            row[9] = 1 - len(np.unique(t)) / len(t) if len(t) else 0
            own = lh[lines.first[d] : lines.first[d + 1]]
            row[10] = 1 - len(np.unique(own)) / len(own)
            row[11], row[12] = (size[a:b] <= 2).mean(), (size[a:b] >= 15).mean()
            row[13] = len(own) / n
    return out


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text is divisible by 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Model:
    """A small network on standardised features; score() is the chance that label 1 applies."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: list[np.ndarray]) -> None:
        self.mean, self.spread, self.weights = mean, spread, weights

    def margin(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(self.inputs(x) @ a + b) @ c + d

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6) * _SCALE[: x.shape[1]]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _adam(w: list[np.ndarray], steps: int, gradient) -> list[np.ndarray]:  # noqa: ANN001
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for t in range(1, steps + 1):
        for k, d in enumerate(gradient(t, w)):
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            w[k] = w[k] - 0.02 * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w


def fit_features(positive: np.ndarray, unlabelled: np.ndarray, weight: np.ndarray | None = None, prior: float | None = None, hidden: int = 16, steps: int = 700, batch: int = 1024, seed: int = 7) -> Model:
    """Minimise prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]) with the logistic loss l, by Adam over batches of positives.

    Where the estimated negative risk falls below zero, its gradient is
    reversed, so that the fit is undone instead of carried further. weight: of
    the unlabelled rows, 1 each by default. The prior is estimated from
    positives and unlabelled rows if it isn't given.
    """
    rng = np.random.default_rng(seed)
    weight = np.ones(len(unlabelled)) if weight is None else weight
    share = weight / weight.sum()
    mean = share @ unlabelled
    model = Model(mean, np.sqrt(share @ (unlabelled - mean) ** 2) + positive.std(0) + 1e-3, [])
    xp, xu = model.inputs(positive), model.inputs(unlabelled)
    prior = estimated_prior(xp, xu, share, rng) if prior is None else prior
    start = float(np.log(prior / (1 - prior)))
    w = [rng.normal(0, 1 / np.sqrt(xp.shape[1]), (xp.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), np.array(start)]

    def gradient(_: int, w: list[np.ndarray]) -> list[np.ndarray]:
        own = xp if len(xp) <= batch else xp[rng.integers(0, len(xp), batch)]
        x, is_p = np.concatenate((own, xu)), np.arange(len(own) + len(xu)) < len(own)
        part = np.concatenate((np.full(len(own), prior / len(own)), share))
        z = np.tanh(x @ w[0] + w[1])
        g = z @ w[2] + w[3]
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        soft = np.logaddexp(0, g)  # the loss of being called negative
        negative = (part * soft)[~is_p].sum() - (part * soft)[is_p].sum()
        up = np.where(is_p, -part, part) * s  # gradient of the negative risk
        grad = up + np.where(is_p, -part * (1 - s), 0) if negative >= 0 else -up
        dz = np.outer(grad, w[2]) * (1 - z * z)
        return [x.T @ dz + 1e-4 * w[0], dz.sum(0), z.T @ grad + 1e-4 * w[2], grad.sum()]

    model.weights = _adam(w, steps, gradient)
    return model


def estimated_prior(xp: np.ndarray, xu: np.ndarray, share: np.ndarray, rng: np.random.Generator, steps: int = 200) -> float:
    """The share of positives among unlabelled rows, from those and positives alone.

    A logistic score that tells the two kinds apart is fitted on half of the
    positives. Above any cut of the score, the share of all unlabelled rows is
    at least the prior times the share of positives; the least ratio over cuts,
    with an allowance for the few rows above a high one, is the estimate.
    """
    order = rng.permutation(len(xp))
    fitted, held = xp[order[::2]], xp[order[1::2]] if len(xp) > 1 else xp

    def gradient(_: int, w: list[np.ndarray]) -> list[np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(fitted @ w[0] + w[1], -30, 30)))
        u = 1 / (1 + np.exp(-np.clip(xu @ w[0] + w[1], -30, 30)))
        return [-(fitted.T @ (1 - p)) / len(fitted) + xu.T @ (share * u) + 1e-3 * w[0], np.array((share * u).sum() - (1 - p).mean())]

    a, b = _adam([np.zeros(xp.shape[1]), np.array(0.0)], steps, gradient)
    sp, su = held @ a + b, xu @ a + b
    cuts = np.quantile(sp, np.linspace(0.02, 0.98, 49))
    above_p = (sp[None] >= cuts[:, None]).mean(1)
    above_u = (su[None] >= cuts[:, None]) @ share
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(1 / (share**2).sum()))
    best = int(np.argmin((above_u + slack) / np.maximum(above_p, 1e-9)))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-9), 0.01, 0.99))


def _cells(docs: DataFrame, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of documents that stand for all of docs, and how many each stands for.

    A cell is a pattern of sides of fixed random planes through the positives'
    mean, so alike documents share one. Every document is counted in its cell;
    the different texts with the least hashes, CELL_ROWS of them, stand for it.
    Tasks merge their documents first.
    """
    mean, spread = positive.mean(0), positive.std(0) + 1e-2
    planes = np.random.default_rng(3).normal(0, 1, (N_FEATURES, CELL_BITS))
    planes[_MEASURES:] *= 0.25  # the measures tell more than the hashed ones
    shift = np.random.default_rng(4).normal(0, 1, CELL_BITS)
    shared = docs.sparkSession.sparkContext.broadcast((mean, spread, planes, shift))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, sd, r, c = shared.value
        n = np.zeros(1 << CELL_BITS, np.int64)
        cells, names, rows = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, N_FEATURES))
        for rb in batches:
            buf, offsets = as_bytes(rb.column(0))
            for i, j in slices(offsets):
                x = features(rb.column(0).slice(i, j - i))
                cell = ((np.clip((x - m) / sd, -6, 6) @ r + c > 0) << np.arange(CELL_BITS)).sum(1)
                n += np.bincount(cell, minlength=len(n))
                cells, names = np.concatenate((cells, cell)), np.concatenate((names, hash_spans(buf, offsets[i:j], offsets[i + 1 : j + 1])))
                rows = np.concatenate((rows, x))
                order = np.lexsort((names, cells))
                order = order[np.append(True, (np.diff(cells[order]) != 0) | (np.diff(names[order]) != 0))[: len(order)]]
                at = np.arange(len(order)) - np.searchsorted(cells[order], cells[order])
                cells, names, rows = (z[order[at < CELL_ROWS]] for z in (cells, names, rows))
        first = np.append(True, np.diff(cells) != 0)[: len(cells)]  # a cell's count goes with its first row
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(names.view(np.int64)), pa.array(np.where(first, n[cells], 0)), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["cell", "name", "n", "x"])

    held = stored(docs.select(F.col("text").cast("string").alias("text")).transform(in_arrow, add, "cell long, name long, n long, x array<double>"))
    counts = held.groupBy("cell").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("cell").orderBy("name")
    least = held.dropDuplicates(["cell", "name"]).withColumn("r", F.row_number().over(order)).where(F.col("r") <= CELL_ROWS)
    got = least.select("cell", "x").join(counts, "cell").orderBy("cell", "x").collect()  # CELL_ROWS * 2 ** CELL_BITS rows at most
    x = np.array([r["x"] for r in got], float).reshape(-1, N_FEATURES)
    cell = np.array([r["cell"] for r in got], np.int64)
    return x, np.array([r["n"] for r in got], float) / np.maximum(1, np.bincount(cell, minlength=1)[cell])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from trusted positives (quality 1) and unlabelled documents, none of them held out.

    At most `rows` positives are fitted, those with the least hash of their id.
    Unlabelled are all documents that are not held out, whatever their number:
    they are counted in cells of alike documents, a few of which stand for each
    cell with its weight. Labels of quality 0 are never read, and the class prior is
    estimated from positives and unlabelled documents. With no positives or no
    unlabelled documents the score is 0.5 everywhere. doc_id is cast to long
    (an error where it can't be); null doc_ids are no positives; labels and
    documents may repeat an id; null and empty texts have features of zero.
    """
    trusted = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("q")).where("q = 1").select("doc_id")
    learnt = docs.where(F.col("doc_id").isNull() | ~held_out(F.col("doc_id")))
    ids = learnt.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    chosen = ids.join(trusted, "doc_id", "left_semi").distinct().orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(rows)
    sample = learnt.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `rows` ids

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(features(rb.column(1)).tolist(), pa.list_(pa.float64()))], ["doc_id", "x"])

    got = sample.transform(in_arrow, measure, "doc_id long, x array<double>").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    positive = np.array([r["x"] for r in got], float).reshape(-1, N_FEATURES)
    means, n = _cells(learnt, positive) if len(positive) else (positive, np.zeros(0))
    if not len(positive) or not len(n):
        zero = np.zeros(N_FEATURES)
        return Model(zero, zero + 1, [np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), np.array(0.0)])
    return fit_features(positive, means, n)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, carry: list[str] | None = None) -> DataFrame:
    """doc_id and the columns to carry, with held_out, score and predicted (1 if score >= threshold). Only the whole text is scored; a null is empty; repeated rows are scored alike. Columns to carry must not be named as results are; accepted() renames them."""
    kept = ["doc_id", *[c for c in carry or [] if c != "doc_id"]]
    rows = docs.select(*kept, F.col("text").cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", score double"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            s = shared.value.score(features(rb.column(rb.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*rb.columns[:-1], pa.array(s, pa.float64())], [*rb.schema.names[:-1], "score"])

    out = rows.transform(in_arrow, measure, schema)
    return out.select(*kept, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs that the model predicts to be good, columns as they are."""
    plain, names = set_aside(docs)
    found = score(plain, model, threshold, carry=["text", *names]).where("predicted = 1")
    return put_back(found.select("doc_id", "text", *names), docs)
