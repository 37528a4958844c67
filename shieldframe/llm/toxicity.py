"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams (2 to 5 code points) of its distinct lower-cased words with a blank on either
side, counted over those words and divided by the root of their number. A logistic regression is fitted to them after
each is multiplied by its log-count ratio. The model is a sum over n-grams, so a text's score is a sum over its words.

Only the fit works on a bounded sample: at most `SAMPLE_PER_CLASS` labelled rows of each class, in order of a hash of
the id. Both classes weigh the same in the fit; the bias is then moved by the log of the classes' frequencies among all
labelled rows. One rule comes after that: where the classes are apart on the sample (the clean rows' 99.9% quantile is
below the toxic rows' 2% quantile) and 0 isn't between the two, the bias is moved to the middle of that gap, so that a
rare class isn't lost to its frequency. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shieldframe.llm.scratch import small_batches, unused

SAMPLE_PER_CLASS = 2000
BITS = 18
ORDERS = (2, 3, 4, 5)
RIDGE = 3e-6
STEPS = 80
#: Word scores kept in a worker; longer words aren't kept.
CACHED_WORDS = 200_000
CACHED_CHARS = 40


def _hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each word (blanks around it), and the word's index for each."""
    chars = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    word = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    hashes, owners = [], []
    for n in ORDERS:
        m = len(chars) - n + 1
        if m <= 0:
            continue
        h = np.full(m, (n * 0x9E3779B1) & 0xFFFFFFFF, dtype=np.uint32)
        for k in range(n):
            h = (h ^ chars[k : k + m]) * np.uint32(0x01000193)
        inside = word[:m] == word[n - 1 :]
        h, own = h[inside], word[:m][inside]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        hashes.append(h & np.uint32((1 << BITS) - 1))
        owners.append(own)
    if not hashes:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def _distinct_words(text: str | None) -> list[str]:
    return sorted(set((text or "").lower().split()))


@dataclass(frozen=True)
class Model:
    """weights by hashed n-gram (float32), and the bias."""

    weights: bytes
    bias: float

    def scorer(self):
        """A function from texts to scores in [0, 1], with a bounded cache of word scores."""
        weights, bias, cache = np.frombuffer(self.weights, dtype="<f4"), self.bias, {}

        def add(words: list[str]) -> dict[str, int]:
            """Each word's score in millionths above bit 31 and its number of n-grams below: sums don't depend on order."""
            h, own = _hashes(words)
            sums, counts = np.rint(np.bincount(own, weights[h], len(words)) * 1e6).astype(np.int64), np.bincount(own, minlength=len(words))
            return dict(zip(words, ((sums << 32) + counts).tolist(), strict=True))

        def score(texts) -> np.ndarray:
            nonlocal cache
            split = [set((t or "").lower().split()) for t in texts]
            every = set().union(*split)
            if len(cache) > CACHED_WORDS:
                cache = {w: v for w, v in cache.items() if w in every}
            new = list(every - cache.keys())
            for i in range(0, len(new), 20_000):
                cache |= add(new[i : i + 20_000])
            sums = [sum(map(cache.__getitem__, ws)) for ws in split]
            out = np.array([bias + ((t >> 32) / 1e6 / (t & 0xFFFFFFFF) ** 0.5 if t else 0.0) for t in sums])
            for w in [w for w in new if len(w) > CACHED_CHARS]:
                del cache[w]
            return 1 / (1 + np.exp(-np.clip(out, -500, 500)))

        return score


def _fit(y: np.ndarray, rows: list[np.ndarray], counts: list[np.ndarray], positive: int, negative: int) -> Model:
    size = 1 << BITS
    n1 = int(y.sum())
    n0 = len(y) - n1
    if not n1 or not n0:
        return Model(np.zeros(size, dtype="<f4").tobytes(), float(np.log((positive + 0.5) / (negative + 1.5))))
    length = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(y)), length)
    idx = np.concatenate(rows).astype(np.int64)
    x = np.concatenate(counts).astype(np.float32)
    x /= np.sqrt(np.maximum(1, np.bincount(row, x, len(y))))[row].astype(np.float32)
    toxic = y[row] == 1
    p = np.bincount(idx[toxic], minlength=size) + 1.0
    q = np.bincount(idx[~toxic], minlength=size) + 1.0
    ratio = np.log((p / (n1 + 1)) / (q / (n0 + 1)))
    x *= ratio[idx].astype(np.float32)
    w, m, s = (np.zeros(size) for _ in range(3))
    b, mb = 0.0, 0.0
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, x * w[idx].astype(np.float32), len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weight
        gw = np.bincount(idx, x * g[row].astype(np.float32), size) + RIDGE * w
        m = 0.9 * m + 0.1 * gw
        s = 0.99 * s + 0.01 * gw * gw
        w -= 0.1 * min(1, 2 * (STEPS - step) / STEPS) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
        mb = 0.9 * mb + 0.1 * g.sum()
        b -= 0.5 * mb
    # both classes weigh the same above: by the classes' frequencies among all labelled rows
    b += float(np.log(max(positive, 1) / max(negative, 1))) if min(positive, negative) else 0.0
    # classes that are apart, on one side of 0: the middle of their gap becomes 0.5
    z = np.bincount(row, x * w[idx].astype(np.float32), len(y)) + b
    low, high = np.quantile(z[y == 0], 0.999), np.quantile(z[y == 1], 0.02)
    if low < high and not low < 0 < high:
        b -= (low + high) / 2
    return Model((w * ratio).astype("<f4").tobytes(), float(b))


def in_training(id_col: Column) -> Column:
    """Rows whose labels may be learned: crc32 of the id as text is not divisible by 5 (null ids never are used)."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 != 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learns from labelled rows outside the held-out fold. Of several labels of an id the largest counts; null ones are dropped.

    Where one class has no rows the model gives every text the same score, by the classes' frequencies.
    """
    known = labels.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("int").alias("y")).where(in_training(F.col("id")) & F.col("y").isin(0, 1))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    sample = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * per_class rows of an id and a label
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).join(sample, "id").select("id", "y", "text")

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [np.unique(_hashes(ws)[0], return_counts=True) if (ws := _distinct_words(t)) else (np.zeros(0, np.uint32), np.zeros(0, np.int64)) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "i": [a.astype("<u4").tobytes() for a, _ in found], "n": [b.astype("<u4").tobytes() for _, b in found]})

    positive, negative = counts.get(1, 0), counts.get(0, 0)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [b for b in batches if len(b)]
        if not every:
            model = _fit(np.zeros(0), [], [], positive, negative)
        else:
            pdf = pd.concat(every).sort_values(["id", "i", "n"], kind="stable")
            model = _fit(pdf["y"].to_numpy(), [np.frombuffer(a, "<u4") for a in pdf["i"]], [np.frombuffer(a, "<u4") for a in pdf["n"]], positive, negative)
        yield pd.DataFrame({"weights": [model.weights], "bias": [model.bias]})

    small_batches(docs.sparkSession)
    rows = texts.mapInPandas(featurize, "id string, y int, i binary, n binary").repartition(1)
    found = rows.mapInPandas(train, "weights binary, bias double").first()
    return Model(bytes(found["weights"]), found["bias"]) if found else _fit(np.zeros(0), [], [], positive, negative)


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxic_score") -> DataFrame:
    """`docs` with the score (0 to 1, higher: toxic likelier) of each whole text; null and empty texts get the bias's score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = shared.value.scorer()
        for texts in batches:
            yield pd.Series(run(texts))

    return docs.withColumn(name, score(F.col(text_col).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted (1 from a score of 0.5). Repeated rows stay."""
    rows = scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), fit(docs, labels, id_col, text_col), "text", "score")
    return rows.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` without the rows whose text is predicted toxic; the columns stay as they are."""
    score = unused("toxic_score", docs.columns)
    return scored(docs, fit(docs, labels), text_col, score).where(F.col(score) < 0.5).select(*docs.columns)
