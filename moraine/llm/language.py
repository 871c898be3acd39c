"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text is lower-cased and every character that is no letter becomes a space; its features are the hashed runs of 1 to 4
characters around which no second space falls. The embeddings of all features are averaged and go through a linear
layer. As both are linear, prediction adds one row of (embedding @ weights) per feature, or of the embedding where there are more
languages than dimensions. Probabilities are calibrated by a temperature fitted on labelled rows that the weights have not
seen; the rejection threshold is the level under which at most `reject_rate` of those rows fall. A text of fewer than
JUDGED features is too short to be called a mix or a language that was not learned, so it is not rejected by its score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moraine.llm.common import bounded_batches, materialize

BUCKETS, DIM, ORDERS, CHUNK, JUDGED = 1 << 16, 16, (1, 2, 3, 4), 1 << 19, 200
ADDED = ("lang_pred", "score", "rejected")
UNDETERMINED = "und"
_LETTERS: list[np.ndarray] = []
#: Odd multipliers of the rolling hash, one per place.
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def features(text: str) -> Iterator[np.ndarray]:
    """Hashed features of the whole text, in blocks of bounded size; none if it has no letter."""
    low = text.lower()
    for start in range(0, len(low), CHUNK):
        points = np.frombuffer(low[max(0, start - 3) : start + CHUNK].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        c = np.where(letters()[points], points, 32).astype(np.uint32)
        if not (c != 32).any():
            continue
        c = np.r_[np.uint32(32), c, np.uint32(32)]
        c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
        gap = c == 32
        for n in ORDERS:
            m = len(c) - n + 1
            if m <= 0:
                break
            h = np.full(m, n * 0x165667B1 & 0xFFFFFFFF, dtype=np.uint32)
            for k in range(n):
                h = (h ^ c[k : k + m]) * _MIX[k]
                h ^= h >> np.uint32(15)
            inner = np.zeros(m, dtype=bool)
            for k in range(1, n - 1):
                inner |= gap[k : k + m]
            if n <= 2:
                inner |= gap[:m] & gap[n - 1 : n - 1 + m]
            yield h[~inner] % np.uint32(BUCKETS)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    table: np.ndarray  # a row per bucket: logits, or the embedding
    head: np.ndarray | None  # from the embedding to logits
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, mean: np.ndarray) -> np.ndarray:
        return (mean if self.head is None else mean @ self.head) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected). Null or letterless texts: undetermined, 0, rejected."""
        total, n = np.zeros(self.table.shape[1]), 0
        for f in features(text or ""):
            total += np.bincount(f, minlength=BUCKETS) @ self.table if len(f) > 4 * BUCKETS else self.table[f].sum(axis=0)
            n += len(f)
        if not n or not self.langs:
            return UNDETERMINED, 0.0, True
        p = softmax(self.logits(total / n) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(n >= JUDGED and p[k] < self.threshold)


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, buckets, weights) of the averaged features of texts that have letters."""
    starts, idx, val = [], [], []
    at = 0
    for t in texts:
        f, n = np.unique(np.concatenate(list(features(t))), return_counts=True)
        starts.append(at)
        idx.append(f.astype(np.int64))
        val.append(n / n.sum())
        at += len(f)
    return np.array(starts), np.concatenate(idx), np.concatenate(val)


def train(rows: list[tuple[str, str]], reject_rate: float = 0.001, epochs: int = 4, rate: float = 20.0, seed: int = 7) -> LanguageModel:
    """Fit on (text, language) rows; every text also gives a few short windows of words, so that short texts are seen.

    A fifth of the rows of every language is kept apart for the temperature and the threshold. No rows give a model that rejects all.
    """
    rows = [(t, g) for t, g in rows if any(c.isalpha() for c in t)]
    if not rows:
        return LanguageModel((), np.zeros((BUCKETS, 0)), None, np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    langs = tuple(sorted({g for _, g in rows}))
    label = {g: k for k, g in enumerate(langs)}
    members: dict[str, list[int]] = {g: [] for g in langs}
    for i in rng.permutation(len(rows)).tolist():
        members[rows[i][1]].append(i)
    held = {i for of in members.values() for i in of[: len(of) // 5]}
    parts: dict[bool, list[tuple[str, int]]] = {False: [], True: []}
    for i, (t, g) in enumerate(rows):
        parts[i in held].append((t, label[g]))
        words = t.split()
        for n in rng.integers(1, 25, size=2):
            a = int(rng.integers(0, max(1, len(words) - n + 1)))
            window = " ".join(words[a : a + int(n)])
            if any(c.isalpha() for c in window):
                parts[i in held].append((window, label[g]))
    fit = parts[False]
    starts, idx, val = _bags([t for t, _ in fit])
    ends, y = np.r_[starts[1:], len(idx)], np.array([k for _, k in fit])
    weight = 1 / np.bincount(y, minlength=len(langs)).clip(1)
    weight = weight[y] / weight[y].mean()
    table_in = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(langs)), dtype=np.float32), np.zeros(len(langs), dtype=np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(len(fit)), max(1, len(fit) // 32)):
            ii = np.concatenate([np.arange(starts[b], ends[b]) for b in batch])
            sizes = ends[batch] - starts[batch]
            cut, row = np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.arange(len(batch)), sizes)
            f, w = idx[ii], val[ii].astype(np.float32)
            x = np.add.reduceat(table_in[f] * w[:, None], cut, axis=0)
            err = softmax(x @ out + bias)
            err[np.arange(len(batch)), y[batch]] -= 1
            err = (err * weight[batch, None] / len(batch)).astype(np.float32)
            back = err @ out.T
            out -= 0.05 * step * (x.T @ err)
            bias -= 0.05 * step * err.sum(axis=0)
            u, which = np.unique(f, return_inverse=True)
            g = np.stack([np.bincount(which, w * back[row, d], minlength=len(u)) for d in range(DIM)], axis=1)
            table_in[u] -= step * g.astype(np.float32)
    wide = len(langs) > DIM
    model = LanguageModel(langs, (table_in if wide else table_in @ out).astype(np.float64), out.astype(np.float64) if wide else None, bias.astype(np.float64), 1.0, 0.0)
    check = parts[True] or fit
    starts, idx, val = _bags([t for t, _ in check])
    logits = model.logits(np.add.reduceat(model.table[idx] * val[:, None], starts, axis=0))
    y = np.array([k for _, k in check])
    losses = {t: -np.log(softmax(logits / t)[np.arange(len(y)), y].clip(1e-12)).mean() for t in np.geomspace(0.05, 20, 60)}
    temperature = float(min(losses, key=losses.get))
    best = softmax(logits / temperature).max(axis=1)
    threshold = min(float(np.quantile(best, reject_rate, method="lower")), 1 / len(langs) + 0.25 * (1 - 1 / len(langs)))
    return replace(model, temperature=temperature, threshold=threshold)


def fit_language_model(docs: DataFrame, learnable: Column, sample_rows: int = 1600, sample_chars: int = 20_000, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Train on a documented sample: `sample_rows` labelled rows, as many of each language as there are, at least one of every language.

    Every language is learned, however many there are. The sample is the distinct texts with the smallest hashes within a language:
    a text that many rows repeat counts and is taken once, and only what a share by the language's number of distinct texts
    lets through is sorted, so a hot language costs no more than the others. Of a text of more than `sample_chars` characters the model is
    trained on that many at a place that the hash picks; so the sample is bounded in bytes too. Null and empty texts, null
    languages and other columns are not used; no labelled rows give a model that rejects all.
    """
    text = F.col(text_col)
    rows = docs.where(learnable & F.col(lang_col).isNotNull() & text.isNotNull() & (F.length(text_col) > 0)).select(text.alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.withColumn("h", F.xxhash64("text", "lang"))
    counts = materialize(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")), "languages")  # less than the model that the driver will hold
    n_langs = counts.count()
    if not n_langs:
        return train([])
    each = max(1, sample_rows // n_langs)
    rows = rows.withColumn("u", F.col("h").bitwiseAND((1 << 52) - 1) / float(1 << 52))
    # twice the share that is wanted, and all of a language that has few texts: the smallest hashes are then among them
    some = rows.join(F.broadcast(counts), "lang").where((F.col("texts") <= 50) | (F.col("u") < F.lit(2.0 * each + 20) / F.col("texts")))
    room = F.greatest(F.length("text") - sample_chars, F.lit(0))
    some = some.select("lang", "u", F.col("text").substr((F.col("u") * room).cast("int") + 1, F.lit(sample_chars)).alias("text")).dropDuplicates(["lang", "u"])
    first = Window.partitionBy("lang").orderBy("u")
    found = some.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each).orderBy("lang", "n").collect()
    return train([(r["text"], r["lang"]) for r in found])


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", names: tuple[str, str, str] = ADDED) -> DataFrame:
    """All columns of docs and, by `names`, the language, the score (0 to 1) and whether the model rejects the text.

    Texts are read whole. Null texts and texts without a letter are `und` with score 0 and rejected. Columns of docs that have one of
    the names are replaced: give others to keep them. Repeated rows give repeated rows, an empty table gives none. Rows never move
    between tasks; the model (bounded by BUCKETS times DIM and the number of languages) is broadcast.
    """
    spark = bounded_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predict
        for b in batches:
            got = [predict(t) for t in b.column(text_col).to_pylist()]
            added = [pa.array([x[i] for x in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], [*b.schema.names, *names])

    schema = StructType(list(rows.schema.fields))
    for name, kind in zip(names, ("string", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)
