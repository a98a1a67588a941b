"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages (``PASSAGE`` words each, the whole text).
Each passage is encoded by its character and word statistics and one hidden
layer; a gated attention learned from document labels alone weighs the
passages, and the weighted mean representation is scored by a logistic
output (Ilse, Tomczak and Welling, 2018).

Fitting uses a bounded sample, ``SAMPLE`` labelled documents in hash order
and at most ``SAMPLE_PASSAGES`` passages of each, so what reaches the driver
is bounded; scoring covers every passage of every document where it is read,
without a shuffle. Only the text is an input of a score.

Defined results for odd input: a NULL or empty text is a bag of one empty
passage and gets a score like any other; NULL labels are not used; without
labels of both kinds the score is the share of label 1 (0.5 without any);
repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulare.llm.common import md5_key

PASSAGE = 64               # words
SAMPLE = 3000              # labelled documents to fit on
SAMPLE_PASSAGES = 64       # passages of each of them, evenly spread
THRESHOLD = 0.3
SEGMENT = 1 << 20          # bytes worked on at a time; longer texts are cut at a word
HIDDEN, ATTENTION = 24, 16

_PRINTABLE = 95            # 0x20..0x7E one feature each, then other ASCII, then bytes above
_CLASS_OF = np.full(256, _PRINTABLE + 1, np.int64)
_CLASS_OF[:128] = _PRINTABLE
_CLASS_OF[0x20:0x7F] = np.arange(_PRINTABLE)
_KIND_OF = np.full(256, 6, np.int64)                       # letters above ASCII
_KIND_OF[:128] = 5                                         # symbols
_KIND_OF[[9, 11, 12, 13, 32]] = 0
_KIND_OF[10] = 1
_KIND_OF[0x30:0x3A] = 2
_KIND_OF[0x41:0x5B] = 3
_KIND_OF[0x61:0x7B] = 4
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
FEATURES = _PRINTABLE + 2 + 49 + 5
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


def _segment_features(data: np.ndarray) -> np.ndarray:
    """One row of features per passage of the bytes ``data``."""
    space = _SPACE[data]
    before = np.r_[True, space[:-1]]
    starts = np.flatnonzero(~space & before)
    if not len(starts):
        return np.zeros((1, FEATURES), np.float32)
    n = len(starts)
    passages = (n + PASSAGE - 1) // PASSAGE
    first = np.r_[starts[::PASSAGE][1:], len(data)]
    of_byte = np.repeat(np.arange(passages), np.diff(np.r_[0, first]))
    chars = np.bincount(of_byte * (_PRINTABLE + 2) + _CLASS_OF[data], minlength=passages * (_PRINTABLE + 2))
    chars = chars.reshape(passages, -1)
    size = chars.sum(axis=1, keepdims=True)
    kind = _KIND_OF[data]
    pairs = np.bincount(of_byte[:-1] * 49 + kind[:-1] * 7 + kind[1:], minlength=passages * 49).reshape(passages, -1)
    # words: equal to the one before, to the one two before, distinct within the passage
    ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    length = ends - starts
    at = np.arange(len(data))[~space]
    power = _POWERS[np.minimum(at - np.repeat(starts, length), len(_POWERS) - 1)]
    marks = (data[~space].astype(np.uint64) + np.uint64(1)) * power
    word = np.add.reduceat(marks, np.r_[0, np.cumsum(length)[:-1]])
    of_word = np.arange(n) // PASSAGE
    words = np.bincount(of_word, minlength=passages)
    same1 = np.r_[False, word[1:] == word[:-1]]
    same2 = np.r_[False, False, word[2:] == word[:-2]][:n]
    order = np.lexsort((word, of_word))
    new = np.r_[True, (word[order][1:] != word[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])]
    distinct = np.bincount(of_word[order][new], minlength=passages)
    out = np.empty((passages, FEATURES), np.float32)
    k = _PRINTABLE + 2
    out[:, :k] = np.sqrt(chars / size)
    out[:, k:k + 49] = np.sqrt(pairs / size)
    out[:, k + 49] = np.bincount(of_word, same1, passages) / words
    out[:, k + 50] = np.bincount(of_word, same2, passages) / words
    out[:, k + 51] = distinct / words
    out[:, k + 52] = np.bincount(of_word, length, passages) / words / 10
    out[:, k + 53] = np.log1p(words) / 4
    return out


def passage_features(data: np.ndarray) -> np.ndarray:
    """Features of all passages of one text (its UTF-8 bytes); memory beyond the result is bounded."""
    out, lo = [], 0
    while len(data) - lo > SEGMENT:
        gaps = np.flatnonzero(_SPACE[data[lo + SEGMENT // 2:lo + SEGMENT]])
        hi = lo + SEGMENT // 2 + int(gaps[-1]) + 1 if len(gaps) else lo + SEGMENT
        out.append(_segment_features(data[lo:hi]))
        lo = hi
    out.append(_segment_features(data[lo:]))
    return np.concatenate(out)


def _bytes_of(texts: pa.Array):
    """UTF-8 bytes of each text without copying; NULL is empty."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    values = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    empty, valid = np.empty(0, np.uint8), texts.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(texts)):
        yield values[offsets[i]:offsets[i + 1]] if valid[i] else empty


class AttentionModel:
    """Encoder ``tanh(xW)``, gated attention ``softmax(a·(tanh(hV) * sigmoid(hU)))``, logistic output."""

    def __init__(self, mean, scale, params, constant=None):
        self.mean, self.scale, self.params, self.constant = mean, scale, params, constant

    @staticmethod
    def _forward(p, x, starts, sizes):
        h = np.tanh(x @ p["W"] + p["w0"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        att = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(att[:, None] * h, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["c0"], -30, 30)))
        return h, v, u, att, z, y

    @classmethod
    def fit(cls, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01,
            decay: float = 1e-4, seed: int = 0) -> AttentionModel:
        if not len(bags) or len(np.unique(labels)) < 2:
            return cls(None, None, None, float(labels.mean()) if len(bags) else 0.5)
        every = np.concatenate(bags)
        mean, scale = every.mean(axis=0), every.std(axis=0) + 0.02
        bags = [(b - mean) / scale for b in bags]
        rng = np.random.default_rng(seed)
        p = {"W": rng.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), "w0": np.zeros(HIDDEN),
             "V": rng.normal(0, 0.2, (HIDDEN, ATTENTION)), "U": rng.normal(0, 0.2, (HIDDEN, ATTENTION)),
             "a": rng.normal(0, 0.2, ATTENTION), "c": rng.normal(0, 0.2, HIDDEN), "c0": np.zeros(1)}
        m = {k: np.zeros_like(v) for k, v in p.items()}
        s = {k: np.zeros_like(v) for k, v in p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), batch):
                some = order[i:i + batch]
                sizes = np.array([len(bags[j]) for j in some])
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                x, t = np.concatenate([bags[j] for j in some]), labels[some]
                h, v, u, att, z, y = cls._forward(p, x, starts, sizes)
                dy = (y - t) / len(some)
                g = {"c": z.T @ dy, "c0": np.array([dy.sum()])}
                dz = np.repeat(dy[:, None] * p["c"], sizes, axis=0)
                datt = (dz * h).sum(axis=1)
                de = att * (datt - np.repeat(np.add.reduceat(att * datt, starts), sizes))
                g["a"] = (v * u).T @ de
                dg = de[:, None] * p["a"]
                dv, du = dg * u * (1 - v ** 2), dg * v * u * (1 - u)
                g["V"], g["U"] = h.T @ dv, h.T @ du
                dh = (att[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h ** 2)
                g["W"], g["w0"] = x.T @ dh, dh.sum(axis=0)
                step += 1
                lr = rate * (1 - epoch / epochs) ** 0.5
                for k in p:
                    d = g[k] + decay * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * d
                    s[k] = 0.999 * s[k] + 0.001 * d * d
                    p[k] -= lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
        return cls(mean, scale, p)

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, bags, held = [], [], 0
        for data in _bytes_of(texts):
            bags.append((passage_features(data) - self.mean) / self.scale)
            held += len(bags[-1])
            if held > 4096:
                out.append(self._score(bags))
                bags, held = [], 0
        if bags:
            out.append(self._score(bags))
        return np.concatenate(out) if out else np.empty(0)

    def _score(self, bags) -> np.ndarray:
        sizes = np.array([len(b) for b in bags])
        return self._forward(self.params, np.concatenate(bags), np.r_[0, np.cumsum(sizes)[:-1]], sizes)[-1]


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AttentionModel:
    """Model learned from a hash-ordered sample of the labelled documents that are not held out."""
    chosen = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
                    .select("doc_id", "quality").distinct().join(docs.select("doc_id"), "doc_id", "left_semi")
                    .orderBy(md5_key(F.col("doc_id"), "quality"), "doc_id", "quality").limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")

    def features(batches):
        for batch in batches:
            packed = []
            for data in _bytes_of(batch.column(1)):
                f = passage_features(data)
                if len(f) > SAMPLE_PASSAGES:
                    f = f[np.linspace(0, len(f) - 1, SAMPLE_PASSAGES).astype(int)]
                packed.append(f.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.float64()), pa.array(packed, pa.binary())],
                                             names=["doc_id", "quality", "bag"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality double, bag binary"
    # one bag per chosen label, whatever number of rows has its id
    got = rows.mapInArrow(features, schema).groupBy("doc_id", "quality").agg(F.min("bag").alias("bag")).limit(sample).toArrow()
    # the order of rows must not change the model
    got = sorted(zip(got["doc_id"].to_pylist(), got["quality"].to_pylist(), got["bag"].to_pylist()))
    bags = [np.frombuffer(b, "<f4").reshape(-1, FEATURES).astype(np.float64) for _, _, b in got]
    return AttentionModel.fit(bags, np.array([q for _, q, _ in got]))


def score(model: AttentionModel, text: Column, spark) -> Column:
    """Score of each text, 0 to 1, higher for label 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts), pa.float64())
    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``."""
    model = fit(docs, labels)
    return (docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), score(model, docs["text"], docs.sparkSession).alias("score"))
                .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def accept(docs: DataFrame, training: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows the classifier rejects; it learns from ``training`` and ``labels``."""
    model = fit(training, labels)
    return docs.where(score(model, docs["text"], docs.sparkSession) >= threshold)
