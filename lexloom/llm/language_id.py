"""Language identification with a byte convolutional network.

A window of ``WINDOW`` bytes (the last one of a text padded with zero bytes) goes through filters of several widths over one-hot bytes,
a rectifier, max pooling over the window, and softmax. A text's probabilities are the mean over all its windows, weighted by their bytes. As a
filter over one-hot bytes is a sum of table entries, the tables of neighbouring bytes are added up beforehand for whole byte pairs.

The network is trained in numpy on the driver from a bounded sample: ``SAMPLE`` labelled rows in all, at most ``PER_LANGUAGE`` of each
language and at least one (those with the smallest hash of doc_id and text), ``WINDOWS`` windows of each. Everything is seeded.

Defined results: a null text and a text without a letter get ``und`` and score 0; without labelled documents every text does;
a null label is no label; rows are judged one by one; their own columns stay as they are, results have the prefix ``_lx_``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, texts

WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 8
SAMPLE, PER_LANGUAGE, WINDOWS = 20_000, 300, 4
EPOCHS, BATCH, RATE = 6, 64, 0.01
UNKNOWN = "und"


@dataclass
class Network:
    labels: list[str]
    tables: list[np.ndarray]  # for each width: width x 256 x filters
    shift: np.ndarray  # of all filters
    out: np.ndarray  # filters x languages
    bias: np.ndarray

    def pairs(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each width the sums for whole byte pairs (first byte + 256 * second), and the table of an odd last byte."""
        made = []
        for t in self.tables:
            two = [(t[k][None, :, :] + t[k + 1][:, None, :]).reshape(65536, -1) for k in range(0, len(t) - 1, 2)]
            made.append((two, t[-1] if len(t) % 2 else None))
        return made


def windows_of(text: bytes) -> np.ndarray:
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


def pooled(windows: np.ndarray, network: Network, pairs: list) -> np.ndarray:
    """Max-pooled filters of each window."""
    pair = windows[:, :-1].astype(np.uint16) + (windows[:, 1:].astype(np.uint16) << 8)
    parts = []
    for width, (two, one) in zip(WIDTHS, pairs, strict=True):
        n = WINDOW - width + 1
        total = two[0][pair[:, :n]]
        for k, more in enumerate(two[1:], 1):
            total += more[pair[:, 2 * k : 2 * k + n]]
        if one is not None:
            total += one[windows[:, width - 1 : width - 1 + n]]
        parts.append(total.max(axis=1))
    return np.maximum(np.concatenate(parts, axis=1) + network.shift, 0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(windows: np.ndarray, network: Network, pairs: list) -> np.ndarray:
    parts = [softmax(pooled(windows[a : a + 256], network, pairs) @ network.out + network.bias) for a in range(0, len(windows), 256)]
    return np.concatenate(parts)


def train(windows: np.ndarray, target: np.ndarray, labels: list[str], seed: int = 11) -> Network:
    """Adam on the cross-entropy; the gradient of max pooling reaches one place of each filter and window."""
    rng = np.random.default_rng(seed)
    sizes = [w * 256 * FILTERS for w in WIDTHS]
    features = FILTERS * len(WIDTHS)
    theta = np.concatenate([*(rng.normal(0, 0.1, s) for s in sizes), np.zeros(features), rng.normal(0, 0.2, features * len(labels)), np.zeros(len(labels))]).astype(np.float32)
    cuts = np.cumsum([*sizes, features, features * len(labels)])

    def parts(vector: np.ndarray) -> list[np.ndarray]:
        split = np.split(vector, cuts)
        return [*(p.reshape(w, 256, FILTERS) for p, w in zip(split, WIDTHS)), split[-3], split[-2].reshape(features, len(labels)), split[-1]]

    first, second = np.zeros_like(theta), np.zeros_like(theta)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            x = windows[rows].astype(np.int64)
            gradient = np.zeros_like(theta)
            *tables, shift, out, bias = parts(theta)
            *g_tables, g_shift, g_out, g_bias = parts(gradient)
            value, place = [], []
            for table, width in zip(tables, WIDTHS, strict=True):
                n = WINDOW - width + 1
                total = sum(table[k][x[:, k : k + n]] for k in range(width))
                at = total.argmax(axis=1)
                place.append(at)
                value.append(np.take_along_axis(total, at[:, None, :], axis=1)[:, 0])
            raw = np.concatenate(value, axis=1) + shift
            hidden = np.maximum(raw, 0)
            error = softmax(hidden @ out + bias)
            error[np.arange(len(rows)), target[rows]] -= 1
            error /= len(rows)
            g_out += hidden.T @ error
            g_bias += error.sum(axis=0)
            back = (error @ out.T) * (raw > 0)
            g_shift += back.sum(axis=0)
            for i, width in enumerate(WIDTHS):
                mine = back[:, i * FILTERS : (i + 1) * FILTERS]
                column = np.broadcast_to(np.arange(FILTERS), mine.shape)
                for k in range(width):
                    np.add.at(g_tables[i][k], (np.take_along_axis(x, place[i] + k, axis=1), column), mine)
            step += 1
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    *tables, shift, out, bias = parts(theta)
    return Network(labels, list(tables), shift, out, bias)


def has_letter(text):
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fitted(labelled: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Network | None:
    """Trains on a bounded sample of (doc_id, text, lang); every label that a text with a letter has is learned."""
    raw = F.col("text").cast("binary")
    usable = labelled.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    labels = sorted(r["lang"] for r in usable.groupBy("lang").count().select("lang").collect())  # one row a language
    if not labels:
        return None
    each = max(1, min(per_language, sample // len(labels)))
    count = F.greatest(F.ceil(F.octet_length("text") / WINDOW), F.lit(1))
    cuts = [F.substring(raw, (F.pmod(F.xxhash64("doc_id", F.lit(k)), count) * WINDOW + 1).cast("int"), F.lit(WINDOW)) for k in range(WINDOWS)]
    cut = usable.select("lang", F.xxhash64("doc_id").alias("_lx_a"), F.xxhash64("text").alias("_lx_b"), F.array_distinct(F.array(*cuts)).alias("parts"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_lx_a", "_lx_b", "parts"))  # only the first few of each task are sorted
    rows = cut.withColumn("_lx_rank", rank).where(F.col("_lx_rank") <= each).select("lang", "_lx_rank", "parts").collect()
    at = {name: i for i, name in enumerate(labels)}
    found = [(at[r["lang"]], bytes(p)) for r in sorted(rows, key=lambda r: (r["lang"], r["_lx_rank"])) for p in r["parts"] if len(p)]
    return train(np.concatenate([windows_of(p)[:1] for _, p in found]), np.array([k for k, _ in found]), labels)


def predicted(docs: DataFrame, network: Network | None) -> DataFrame:
    """The rows with _lx_lang and _lx_score behind their own columns; a prediction reads the text alone."""
    if network is None:
        return docs.withColumns({"_lx_lang": F.lit(UNKNOWN), "_lx_score": F.lit(0.0)})
    shipped = docs.sparkSession.sparkContext.broadcast(network)
    own = docs.schema.fields
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shipped.value
        pairs = net.pairs()
        for batch in slices(batches, 2000, "text", 4 << 20):
            raw = texts(batch.column(batch.schema.get_field_index("text")))
            letters = batch.column(batch.num_columns - 1).to_pylist()
            sums, weight = np.zeros((len(raw), len(net.labels))), np.zeros(len(raw))
            held, owner, size = [], [], 0

            def flush() -> None:
                nonlocal held, owner, size
                if held:
                    block = np.concatenate(held)
                    of = np.concatenate(owner)
                    p = probabilities(block, net, pairs) * (block != 0).sum(axis=1, keepdims=True)
                    for k in range(len(net.labels)):
                        sums[:, k] += np.bincount(of, weights=p[:, k], minlength=len(raw))
                held, owner, size = [], [], 0

            for i, (text, letter) in enumerate(zip(raw, letters, strict=True)):
                if letter:
                    for a in range(0, len(text), 1 << 20):  # a very long text in turns
                        part = windows_of(text[a : a + (1 << 20)])
                        held.append(part)
                        owner.append(np.full(len(part), i))
                        size += len(part)
                        if size >= 4096:
                            flush()
            flush()
            weight = sums.sum(axis=1)
            known = weight > 0
            best = sums.argmax(axis=1)
            score = np.where(known, sums[np.arange(len(raw)), best] / np.where(known, weight, 1), 0.0)
            label = [net.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            keep = [batch.column(batch.schema.get_field_index(f.name)) for f in own]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(label, pa.string()), pa.array(np.clip(score, 0, 1))], [*[f.name for f in own], "_lx_lang", "_lx_score"])

    return docs.select(*[F.col(f"`{f.name}`") for f in own], has_letter(F.col("text")).alias("_lx_letter")).mapInArrow(run, StructType([*own, StructField("_lx_lang", StringType()), StructField("_lx_score", DoubleType())]))
