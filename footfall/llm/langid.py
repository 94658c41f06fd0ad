"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a blank, and the counts of 1-, 2- and 3-grams are hashed to
``DIMENSIONS`` features. Document frequencies come from all labelled documents. The weights are learnt on a bounded
sample by follow-the-regularised-leader (FTRL-Proximal) with elastic-net penalties, which leaves them sparse, and a
temperature is fitted on a part of the sample that the weights have not seen.

The sample is the one bounded thing: ``max_per_lang`` expected documents of each language (default 1,500), drawn by a
hash of doc_id; whole texts, no prefix. Everything else covers all rows.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where there is nothing to learn from;
null languages are never learnt; ties between languages go to the first by name; repeated rows count as often as they
are there; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm._common import documents, text_batches, tidy

DIMENSIONS = 1 << 15
ORDERS = (1, 2, 3)
MAX_PER_LANG = 1500
EPOCHS = 3
MOST_BROADCAST = 10_000
ALPHA, BETA, L1, L2 = 0.8, 1.0, 0.02, 0.05
BATCH = 2 << 20


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a blank; a letter whose lower case is several keeps the first."""
    table = np.full(0x110000, 32, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            table[point] = ord(c.lower()[0])
    return table


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(feature numbers ascending, counts) of the whole text; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letters()[points]
    if not (letters != 32).any():
        return None
    letters = np.concatenate([[32], letters, [32]]).astype(np.uint64)
    parts = []
    for n in ORDERS:
        acc = np.full(max(0, len(letters) - n + 1), np.uint64(n))
        for j in range(n):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + letters[j : j + len(acc)]
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        parts.append((acc >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.uint16))
    every = np.concatenate(parts)
    if len(every) > DIMENSIONS:
        counts = np.bincount(every, minlength=DIMENSIONS)
        index = np.flatnonzero(counts)
        return index, counts[index]
    every.sort()
    at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[at].astype(np.int64), np.diff(np.append(at, len(every)))


def weigh(index: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = (1 + np.log(count)) * idf[index]
    return value / max(1e-12, float(np.sqrt((value * value).sum())))


def document_frequencies(labelled: DataFrame) -> DataFrame:
    """feature, documents of all labelled texts; each batch sends a feature once."""
    import pyarrow as pa

    def count(batches):
        seen = np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                found = features(text.as_py())
                if found is not None:
                    seen[found[0]] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["feature", "documents"])

    counted = labelled.select("text").mapInArrow(tidy(count), "feature bigint, documents bigint")
    return counted.groupBy("feature").agg(F.sum("documents").alias("documents"))


class Ftrl:
    """FTRL-Proximal for softmax regression; one row of examples at a time."""

    def __init__(self, classes: int):
        self.z = np.zeros((DIMENSIONS, classes))
        self.n = np.zeros((DIMENSIONS, classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: int):
        w = self.weights(index)
        p = softmax(value @ w)
        p[label] -= 1
        g = value[:, None] * p[None, :]
        n = self.n[index]
        grown = n + g * g
        self.z[index] += g - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
        self.n[index] = grown


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(labels)), labels]).mean())

    low, high, g = np.log(0.25), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        if loss(a) < loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def train(sample: DataFrame, langs: list[str], idf: np.ndarray) -> DataFrame:
    """feature, class, weight (not zero) of the bounded sample, in one task; feature -1 holds the temperature."""
    import pyarrow as pa

    label_of = {x: i for i, x in enumerate(langs)}

    def fit(batches):
        rows = []
        for batch in batches:
            for lang, text, at in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "at")), strict=True):
                found = features(text)
                if found is not None:
                    value = weigh(*found, idf).astype(np.float32)
                    rows.append((at, label_of[lang], found[0].astype(np.uint16), value))
        rows.sort(key=lambda r: (r[0], r[1]))
        model = Ftrl(len(langs))
        learnt = [r for i, r in enumerate(rows) if i % 5] or rows
        for epoch in range(EPOCHS):
            order = np.random.default_rng(epoch).permutation(len(learnt))
            for i in order:
                _, label, index, value = learnt[i]
                model.learn(index, value.astype(float), label)
        w = model.weights(slice(None))
        rest = rows[::5] if len(rows) >= 5 else []
        logits = np.array([r[3] @ w[r[2]] for r in rest]).reshape(len(rest), len(langs))
        t = temperature(logits, np.array([r[1] for r in rest], np.int64))
        feature, cls = np.nonzero(w)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(feature, -1), pa.int64()),
                pa.array(np.append(cls, 0), pa.int64()),
                pa.array(np.append(w[feature, cls], t), pa.float64()),
            ],
            names=["feature", "class", "weight"],
        )

    return sample.repartition(1).mapInArrow(tidy(fit), "feature bigint, class bigint, weight double")


class Model:
    """Languages, inverse document frequencies, weights and temperature; a bounded size, whatever the input."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.temperature = langs, idf, weights, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features(text)
        if found is None or not self.langs:
            return "und", 0.0
        index, count = found
        p = softmax((weigh(index, count, self.idf) @ self.weights[index]) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def fit(labelled: DataFrame, max_per_lang: int = MAX_PER_LANG) -> Model:
    """Learn from doc_id, text and lang of labelled documents (lang not null)."""
    labelled = labelled.filter(F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    idf = np.zeros(DIMENSIONS)
    if not langs:
        return Model([], idf, np.zeros((DIMENSIONS, 0)), 1.0)
    total = sum(counts.values())
    for r in document_frequencies(labelled).collect():
        idf[r["feature"]] = np.log((1 + total) / (1 + r["documents"])) + 1
    idf[idf == 0] = np.log(1 + total) + 1
    share = labelled.sparkSession.createDataFrame(
        [(x, min(1.0, max_per_lang / n)) for x, n in counts.items()], "lang string, share double"
    )
    # A row for each language: broadcast while they are few, so that the texts stay where they are.
    share = F.broadcast(share) if len(langs) <= MOST_BROADCAST else share
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(1 << 31))
    sample = (
        labelled.select("doc_id", "text", "lang", place.alias("at"))
        .join(share, "lang")
        .filter(F.col("at") < F.col("share") * (1 << 31))
        .select("lang", "text", "at")
    )
    weights, t = np.zeros((DIMENSIONS, len(langs))), 1.0
    for r in train(sample, langs, idf).collect():
        if r["feature"] < 0:
            t = r["weight"]
        else:
            weights[r["feature"], r["class"]] = r["weight"]
    return Model(langs, idf, weights, t)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each whole text."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches):
        found = shared.value
        for batch in text_batches(batches, limit=BATCH):
            rows = [found.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(go), "doc_id bigint, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def langid_query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
