"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's own metadata.

score = sigmoid(w0 + sum_f w_f x_f + sum_{f<g} <v_f, v_g> x_f x_g). The pairwise sum is computed in time linear in
the number of features: half of (sum_f v_f x_f)^2 - sum_f (v_f x_f)^2, summed over the factors.

Features of a text: its words, lower-cased (ASCII) and hashed into buckets, weighted by 1 + log of their count and
scaled to length one; structure statistics (shares of upper-case letters, digits, other ASCII signs, distinct words
and lines, most frequent word, mean word length, words a line) and metadata of the text itself (bytes, words, lines),
each as one-hot bins. Labels, language, source and id are never read for a score.

The model is fitted on the driver by Adagrad over at most ``sample`` labelled documents (a documented bound; features,
not texts, are gathered); every document is scored in full.

Null and empty texts have the features of an empty text. Documents without label are scored only. Without a label to
learn from, every score is 1 (nothing is known to be bad); with one class only, the score is that class's share. Empty
table: no rows. Repeated rows are scored each. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomledger.llm.common import bounded_sample, crc32_of, labelled, split_batches, text_bytes, words_of

#: Upper ends of the bins of each statistic; one more bin lies above the last.
BINS = {
    "upper": (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7),
    "digit": (0.001, 0.005, 0.02, 0.05, 0.2),
    "sign": (0.01, 0.02, 0.035, 0.05, 0.08, 0.12, 0.2, 0.35),
    "distinct_words": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "distinct_lines": (0.1, 0.3, 0.5, 0.7, 0.9, 0.99),
    "top_word": (0.02, 0.04, 0.06, 0.08, 0.12, 0.2, 0.3, 0.5),
    "word_length": (2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 9, 12),
    "line_words": (1, 2, 4, 8, 16, 32, 64, 128),
    "bytes": (1, 50, 100, 200, 400, 800, 1600, 3200, 6400, 12800, 25600),
    "words": (0, 1, 3, 10, 30, 100, 300, 1000, 3000),
    "lines": (1, 2, 3, 5, 10, 20, 50, 100),
}


def _distinct(rows: np.ndarray, index: np.ndarray, names: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, name and count of the distinct (row, name) pairs."""
    keys, counts = np.unique(rows * max(1, names) + index, return_counts=True)
    return keys // max(1, names), keys % max(1, names), counts


def features(column: pa.Array, hashed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of all features of a large_string column, ordered by row."""
    n = len(column)
    raw, offsets = text_bytes(column)
    size = np.diff(offsets)
    kind = _CLASS[raw]

    def of_class(c: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind == c)])
        return total[offsets[1:]] - total[offsets[:-1]]

    upper, digit, sign, newline = map(of_class, (1, 2, 3, 4))

    rows, index, names = words_of(pc.ascii_lower(column))
    lengths = np.asarray(pc.binary_length(names), dtype=np.int64)
    words = np.bincount(rows, minlength=n)
    letters = np.bincount(rows, weights=lengths[index] if len(index) else None, minlength=n)
    row, word, count = _distinct(rows, index, len(names), n)
    distinct = np.bincount(row, minlength=n)
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, row, count)

    lines = pc.split_pattern(column, "\n")
    line_counts = np.asarray(pc.list_value_length(lines), dtype=np.int64)
    coded = pc.list_flatten(lines).dictionary_encode()
    line_row, _, _ = _distinct(np.repeat(np.arange(n), line_counts), np.asarray(coded.indices, dtype=np.int64), len(coded.dictionary), n)
    distinct_lines = np.bincount(line_row, minlength=n)

    some, any_word = np.maximum(size, 1), np.maximum(words, 1)
    statistics = {
        "upper": upper / some,
        "digit": digit / some,
        "sign": sign / some,
        "distinct_words": distinct / any_word,
        "distinct_lines": distinct_lines / np.maximum(line_counts, 1),
        "top_word": top / any_word,
        "word_length": letters / any_word,
        "line_words": words / np.maximum(line_counts, 1),
        "bytes": size,
        "words": words,
        "lines": newline + 1,
    }
    at, parts_row, parts_feature, parts_value = hashed, [], [], []
    for name, ends in BINS.items():
        parts_row.append(np.arange(n))
        parts_feature.append(at + np.searchsorted(ends, statistics[name], side="left"))
        parts_value.append(np.full(n, 0.5))
        at += len(ends) + 1

    bucket = np.fromiter((zlib.crc32(w.encode()) % hashed for w in names.to_numpy(zero_copy_only=False)), dtype=np.int64, count=len(names))
    row, at_bucket, counts = _summed(row, bucket[word] if len(word) else word, count, hashed)
    value = 1 + np.log(counts)
    norm = np.sqrt(np.bincount(row, weights=value**2, minlength=n))
    parts_row.append(row)
    parts_feature.append(at_bucket)
    parts_value.append(value / norm[row] if len(row) else value)
    row, feature, value = (np.concatenate(x) for x in (parts_row, parts_feature, parts_value))
    order = np.argsort(row, kind="stable")
    return row[order], feature[order], value[order].astype(np.float32)


def _summed(row: np.ndarray, bucket: np.ndarray, count: np.ndarray, hashed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of words that share a bucket, added."""
    keys, inverse = np.unique(row * hashed + bucket, return_inverse=True)
    return keys // hashed, keys % hashed, np.bincount(inverse, weights=count, minlength=len(keys))


_CLASS = np.zeros(256, dtype=np.int8)
for _b in range(33, 127):
    _CLASS[_b] = 3
for _b in range(ord("A"), ord("Z") + 1):
    _CLASS[_b] = 1
for _b in range(ord("a"), ord("z") + 1):
    _CLASS[_b] = 0
for _b in range(ord("0"), ord("9") + 1):
    _CLASS[_b] = 2
_CLASS[ord("\n")] = 4


class FactorisationMachine:
    """Weights and factors of a fitted machine."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def scores(self, n: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Probabilities of n rows; row is sorted."""
        linear = np.bincount(row, weights=self.weights[feature] * value, minlength=n)
        pairs = np.zeros(n)
        for k in range(self.factors.shape[1]):
            part = self.factors[feature, k] * value
            pairs += np.bincount(row, weights=part, minlength=n) ** 2 - np.bincount(row, weights=part * part, minlength=n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs / 2, -30, 30)))

    @classmethod
    def fitted(cls, examples: list[tuple[int, np.ndarray, np.ndarray]], size: int, factors: int = 8, epochs: int = 8, rate: float = 0.08, decay: float = 1e-5, batch: int = 128) -> FactorisationMachine:
        """Adagrad on the logistic loss; examples: (label, features, values)."""
        if not examples:
            return cls(30.0, np.zeros(size, np.float32), np.zeros((size, factors), np.float32))
        share = float(np.mean([y for y, _, _ in examples]))
        if share in (0.0, 1.0):
            return cls(30.0 if share else -30.0, np.zeros(size, np.float32), np.zeros((size, factors), np.float32))
        rng = np.random.default_rng(7)
        w, v = np.zeros(size), rng.normal(0, 0.02, (size, factors))
        gw, gv, b, gb = np.full(size, 1e-3), np.full((size, factors), 1e-3), float(np.log(share / (1 - share))), 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(examples))
            for low in range(0, len(order), batch):
                part = [examples[i] for i in order[low : low + batch]]
                y = np.array([p[0] for p in part], dtype=float)
                counts = [len(p[1]) for p in part]
                row, f, x = np.repeat(np.arange(len(part)), counts), np.concatenate([p[1] for p in part]), np.concatenate([p[2] for p in part]).astype(float)
                vx = v[f] * x[:, None]
                sums = np.stack([np.bincount(row, weights=vx[:, k], minlength=len(part)) for k in range(factors)], axis=1)
                squares = np.bincount(row, weights=(vx**2).sum(axis=1), minlength=len(part))
                z = b + np.bincount(row, weights=w[f] * x, minlength=len(part)) + ((sums**2).sum(axis=1) - squares) / 2
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(part)
                step = error[row] * x
                used, inverse = np.unique(f, return_inverse=True)
                dw = np.bincount(inverse, weights=step, minlength=len(used)) + decay * w[used]
                dv = step[:, None] * (sums[row] - vx)
                dv = np.stack([np.bincount(inverse, weights=dv[:, k], minlength=len(used)) for k in range(factors)], axis=1) + decay * v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                w[used] -= rate * dw / np.sqrt(gw[used])
                v[used] -= rate * dv / np.sqrt(gv[used])
                db = error.sum()
                gb += db**2
                b -= rate * db / np.sqrt(gb)
        return cls(b, w.astype(np.float32), v.astype(np.float32))


def fit(docs: DataFrame, learnable: DataFrame, sample: int = 6000, hashed: int = 1 << 15) -> FactorisationMachine:
    """Fit on at most ``sample`` of the learnable rows (doc_id, label): those whose hashed id is smallest."""
    chosen = bounded_sample(learnable, sample)
    # At most ``sample`` rows of two numbers: safe to broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")

    def run(batches):
        for batch in split_batches(batches, "text", 4 << 20):
            row, feature, value = features(batch.column("text"), hashed)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), *(pa.array([a[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for a in (feature.astype(np.int32), value))],
                names=["label", "features", "values"],
            )

    rows = texts.mapInArrow(run, "label int, features binary, values binary").collect()
    rows.sort(key=lambda r: (bytes(r["features"]), r["label"]))
    examples = [(r["label"], np.frombuffer(r["features"], np.int32).astype(np.int64), np.frombuffer(r["values"], np.float32)) for r in rows]
    return FactorisationMachine.fitted(examples, hashed + sum(len(ends) + 1 for ends in BINS.values()))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 4, held_out: int = 2, threshold: float = 0.7, sample: int = 6000, hashed: int = 1 << 15) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least the threshold."""
    machine = docs.sparkSession.sparkContext.broadcast(fit(docs, labelled(labels, label, fold, held_out), sample, hashed))

    def run(batches):
        for whole in batches:
            at = 0
            for batch in split_batches(iter([whole]), "text", 4 << 20):
                score = machine.value.scores(batch.num_rows, *features(batch.column("text"), hashed))
                yield whole.slice(at, batch.num_rows).filter(pa.array(score >= threshold))
                at += batch.num_rows

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 4, held_out: int = 2, threshold: float = 0.7, sample: int = 6000, hashed: int = 1 << 15) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    machine = docs.sparkSession.sparkContext.broadcast(fit(docs, labelled(labels, label, fold, held_out), sample, hashed))

    def run(batches):
        for batch in split_batches(batches, "text", 4 << 20):
            score = machine.value.scores(batch.num_rows, *features(batch.column("text"), hashed))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(F.pmod(crc32_of("doc_id"), F.lit(fold)) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
