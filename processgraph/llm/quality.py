"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of KERNEL bytes run over the whole text. The text is seen as chunks of CHUNK bytes
that overlap by half; each chunk keeps every filter's largest response, and a logistic layer gives the
chunk's log-odds. A document's probability is the logistic of its chunks' mean log-odds. Since a filter
is linear in byte embeddings, two tables over byte pairs hold all products, and a response is a sum of
two look-ups.

Training takes at most TRAIN_DOCS labelled documents, half of each class, chosen by a hash of their
ids, which is a parameter of fit(). Each epoch draws up to TRAIN_CHUNKS chunks of each anew, from the whole
text. Scoring has no bounds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from processgraph.llm.sample import bounded
from processgraph.llm.textnp import chunks, utf8

KERNEL, CHUNK, FILTERS, EMBED = 4, 64, 8, 8
TRAIN_DOCS, TRAIN_CHUNKS, EPOCHS, SEED = 3000, 24, 14, 7
HALF = CHUNK // 2
Model = dict[str, np.ndarray]


def layout(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows one after the other, each followed by at least KERNEL - 1 zero bytes up to a multiple of HALF; the blocks' bounds."""
    n = np.diff(off)
    blocks = np.concatenate([[0], np.cumsum(-(-(n + KERNEL - 1) // HALF))])
    flat = np.zeros(blocks[-1] * HALF + KERNEL, np.uint8)
    shift = np.repeat(blocks[:-1] * HALF - (off[:-1] - off[0]), n)
    flat[np.arange(off[-1] - off[0]) + shift] = data[off[0] : off[-1]]
    return flat, blocks


def tables(m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Responses to the byte pairs at offsets 0 and 2 (with the bias), by first * 256 + second."""
    each = [m["embed"] @ m["filters"][k] for k in range(KERNEL)]
    pair = [(each[k][:, None] + each[k + 1][None]).reshape(65536, -1) for k in (0, 2)]
    return pair[0].astype(np.float32), (pair[1] + m["bias"]).astype(np.float32)


def responses(flat: np.ndarray, pair: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    two = flat[:-1].astype(np.uint16) << 8
    two |= flat[1:]
    n = len(flat) - KERNEL
    out = np.take(pair[0], two[:n], axis=0)
    out += np.take(pair[1], two[2 : n + 2], axis=0)
    return out


def pooled(flat: np.ndarray, blocks: np.ndarray, pair: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks' largest responses, 0 at least, and the chunks' bounds by row. A row of one block is one chunk."""
    top = responses(flat, pair).reshape(-1, HALF, pair[0].shape[1]).max(1) if len(flat) > KERNEL else np.empty((0, FILTERS), np.float32)
    np.maximum(top, 0, out=top)
    n = np.diff(blocks)
    count = np.maximum(n - 1, np.minimum(n, 1))
    to = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(to[-1]) + np.repeat(blocks[:-1] - to[:-1], count)
    nxt = np.minimum(at + 1, np.repeat(blocks[1:] - 1, count))
    return np.maximum(top[at], top[nxt]), to


def score(data: np.ndarray, off: np.ndarray, m: Model) -> np.ndarray:
    """Each row's probability of being good."""
    pair, out = tables(m), np.empty(len(off) - 1)
    for i, j in chunks(off, 1 << 19):
        flat, blocks = layout(data, off[i : j + 1])
        top, to = pooled(flat, blocks, pair)
        logit = np.concatenate([[0], np.cumsum(top.astype(np.float64) @ m["out"] + m["out_bias"])])
        out[i:j] = (logit[to[1:]] - logit[to[:-1]]) / np.maximum(np.diff(to), 1)
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def fit_arrays(data: np.ndarray, off: np.ndarray, good: np.ndarray, n_chunks: int = TRAIN_CHUNKS, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Adam on the logistic loss of chunks, which carry the label of their document.

    Classes weigh the same. A quarter of the chunks is shortened at random, since short texts are common
    and make few chunks.
    """
    rng = np.random.default_rng(seed)
    m: Model = {"embed": rng.normal(0, 0.5, (256, EMBED)), "filters": rng.normal(0, 0.5, (KERNEL, EMBED, FILTERS)), "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.5, FILTERS), "out_bias": np.zeros(1)}
    flat, blocks = layout(data, off)
    n = np.maximum(1, np.diff(blocks) - 1)
    take = np.minimum(n, n_chunks)
    doc = np.repeat(np.arange(len(good)), take)
    nth, y = np.arange(len(doc)) - np.repeat(np.cumsum(take) - take, take), good[doc].astype(float)
    flat = np.concatenate([flat, np.zeros(CHUNK, np.uint8)])
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    mean = {k: np.zeros_like(v) for k, v in m.items()}
    var = {k: np.zeros_like(v) for k, v in m.items()}
    step, size, width = 0, 256, CHUNK + KERNEL - 1
    for _ in range(epochs):
        drawn = np.where(n[doc] > n_chunks, ((nth + rng.random(len(doc))) * n[doc] / take[doc]).astype(np.int64), nth)
        start = (blocks[doc] + np.minimum(drawn, n[doc] - 1)) * HALF
        order = rng.permutation(len(start))
        for b in range(0, len(order), size):
            at = order[b : b + size]
            x = flat[start[at][:, None] + np.arange(width)]
            short = np.where(rng.random(len(at)) < 0.25, rng.integers(6, CHUNK, len(at)), width)
            x[np.arange(width) >= short[:, None]] = 0
            each = [m["embed"] @ m["filters"][k] for k in range(KERNEL)]
            r = sum(each[k][x[:, k : k + CHUNK]] for k in range(KERNEL)) + m["bias"]
            where = r.argmax(1)
            top = np.take_along_axis(r, where[:, None], 1)[:, 0]
            hidden = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ m["out"] + m["out_bias"], -50, 50)))
            g = (p - y[at]) * weight[at] / len(at)
            gt = np.outer(g, m["out"]) * (top > 0)
            grad = {"out": hidden.T @ g + 1e-4 * m["out"], "out_bias": np.array([g.sum()]), "bias": gt.sum(0), "embed": np.zeros((256, EMBED)), "filters": np.zeros_like(m["filters"])}
            for k in range(KERNEL):
                byte = x[np.arange(len(at))[:, None], where + k]
                one = np.zeros((256, FILTERS))
                np.add.at(one, (byte, np.arange(FILTERS)), gt)
                grad["filters"][k] = m["embed"].T @ one
                grad["embed"] += one @ m["filters"][k].T
            step += 1
            for k, v in grad.items():
                mean[k] = 0.9 * mean[k] + 0.1 * v
                var[k] = 0.999 * var[k] + 0.001 * v * v
                m[k] = m[k] - 0.01 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    return m


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCS, n_chunks: int = TRAIN_CHUNKS) -> Model:
    """A model from at most `most` labelled documents. Null labels, ids and texts don't count; an id with both labels is not good.

    Without labels of both classes there is nothing to learn, and the model accepts everything.
    """
    tagged = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__good")).where("__id is not null and __good in (0, 1)").groupBy("__id").agg(F.min("__good").alias("__good"))
    sizes = {r["__good"]: r["count"] for r in tagged.groupBy("__good").count().collect()}
    own = [bounded(tagged.where(f"__good = {k}"), F.col("__id"), sizes.get(k, 0), most // 2) for k in (0, 1)]
    chosen = own[0].unionAll(own[1])
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).where("__text is not null")
    found = rows.join(F.broadcast(chosen), "__id").select("__id", "__text", "__good").toPandas().sort_values("__id", kind="stable")
    good = found["__good"].to_numpy()
    if len(set(good)) < 2:
        return {"embed": np.zeros((256, EMBED)), "filters": np.zeros((KERNEL, EMBED, FILTERS)), "bias": np.zeros(FILTERS), "out": np.zeros(FILTERS), "out_bias": np.ones(1)}
    data, off = utf8(pa.array(found["__text"].tolist(), pa.large_string()))
    return fit_arrays(data, off, good, n_chunks)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, prob), one row for each row of docs, in one pass without a shuffle.

    A text that is null or empty has the probability 0; a text of any length is read whole. Where responses
    tie, the maximum is the same. Repeated rows
    give repeated rows, null ids stay null, no rows give no rows, other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            p = np.where(np.diff(off) > 0, score(data, off, held.value), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "prob"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, prob double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose probability is `least` or more.

    Null and empty texts go. Repeated rows are kept or go alike; no rows give no rows; columns may have any names, none is
    added.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(at))
            yield batch.filter(pa.array((np.diff(off) > 0) & (score(data, off, held.value) >= least)))

    return docs.mapInArrow(run, docs.schema)
