"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text's features are the hashed character n-grams (bytes of UTF-8, sizes 2 to 4) of the lower-cased
text. Each feature has an embedding; a text is the mean of its features' embeddings, and a linear
softmax over that mean gives the languages' probabilities. Scores are calibrated by a temperature
fitted on texts that training did not see; texts below the rejection level are marked.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.frames import content_key, documents, map_texts
from corvane.llm.hashing import U, mix

SIZES = (2, 3, 4)
BUCKETS_BITS, WIDTH = 16, 16


def ngram_ids(buf: np.ndarray, size: int) -> np.ndarray:
    """Feature id of the n-gram that starts at each byte."""
    if len(buf) < size:
        return np.zeros(0, dtype=np.int64)
    n = len(buf) - size + 1
    key = np.zeros(n, dtype=U)
    for i in range(size):
        key = (key << U(8)) | buf[i : i + n].astype(U)
    return (mix(key + U(size * 0x9E3779B97F4A7C15 % (1 << 64))) >> U(64 - BUCKETS_BITS)).astype(np.int64)


def features(text: bytes) -> np.ndarray:
    buf = np.frombuffer(b" " + text.lower() + b" ", dtype=np.uint8)
    return np.concatenate([ngram_ids(buf, s) for s in SIZES])


@dataclass
class LanguageModel:
    labels: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def table(self) -> np.ndarray:
        """Each feature's logits: the softmax is linear in the mean, so embeddings and weights fold into one table."""
        return np.ascontiguousarray((self.embeddings @ self.weights).astype(np.float32))


def train(texts: list[bytes], langs: list[str], epochs: int = 6, seed: int = 7) -> LanguageModel:
    """SGD over the texts, one tenth set aside for the temperature. Equal input gives an equal model."""
    labels = sorted(set(langs))
    if not labels:
        return LanguageModel([], np.zeros((1 << BUCKETS_BITS, WIDTH)), np.zeros((WIDTH, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    y = np.array([labels.index(x) for x in langs])
    feats = [features(t) for t in texts]
    emb = rng.normal(0, 0.1, (1 << BUCKETS_BITS, WIDTH))
    w, b = rng.normal(0, 0.1, (WIDTH, len(labels))), np.zeros(len(labels))
    order = rng.permutation(len(texts))
    aside, used = order[: len(order) // 10], order[len(order) // 10 :]
    counted = {}
    for i in order:
        ids, n = np.unique(feats[i], return_counts=True)
        counted[i] = (ids, (n / max(1, n.sum()))[:, None])
    for epoch in range(epochs):
        rate = 2.0 * (1 - epoch / epochs)
        for i in rng.permutation(used):
            ids, share = counted[i]
            if not len(ids):
                continue
            mean = (emb[ids] * share).sum(0)
            z = mean @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = w @ p
            w -= rate * 0.5 * np.outer(mean, p)
            b -= rate * 0.05 * p
            emb[ids] -= rate * 10 * share * back
    model = LanguageModel(labels, emb, w, b)
    if len(aside):
        logits = np.stack([(emb[counted[i][0]] * counted[i][1]).sum(0) @ w + b for i in aside])

        def loss(t: float) -> float:
            z = logits / t
            z = z - z.max(1, keepdims=True)
            return float(-(z[np.arange(len(z)), y[aside]] - np.log(np.exp(z).sum(1))).mean())

        model.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    return model


def predict(texts: list[bytes], table: np.ndarray, bias: np.ndarray, temperature: float) -> np.ndarray:
    """Probabilities, a row per text; every n-gram of each whole text counts."""
    joined = b"".join(b" " + t + b" " for t in texts).lower()
    buf = np.frombuffer(joined, dtype=np.uint8)
    ends = np.cumsum([len(t) + 2 for t in texts])
    starts = np.concatenate(([0], ends[:-1]))
    sums = np.zeros((len(texts), table.shape[1]))
    total = np.zeros(len(texts))
    for size in SIZES:
        ids = ngram_ids(buf, size)
        # n-grams that run on into the next text count for none
        n = np.maximum(ends - starts - size + 1, 0)
        running = np.zeros(len(ids) + 1)
        for k in range(table.shape[1]):
            np.cumsum(table[:, k][ids], dtype=np.float64, out=running[1:])
            sums[:, k] += running[np.minimum(starts + n, len(ids))] - running[np.minimum(starts, len(ids))]
        total += n
    z = (sums / np.maximum(total, 1)[:, None] + bias) / temperature
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(1, keepdims=True)


def training_sample(docs: DataFrame, rows_per_language: int, bytes_per_language: int, most_languages: int, id_col: str, text_col: str, lang_col: str, held_out) -> tuple[list[bytes], list[str]]:
    """About `rows_per_language` labelled texts of each language, fewer where they are long, by a hash of id and text.

    Two passes, however many languages there are: one counts them and finds each one's level of the hash, below which
    about so many rows or bytes stand; the other takes the rows below it, and the least one in any case.
    """
    usable = docs.where(~held_out & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    usable = usable.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"), F.shiftrightunsigned(content_key(id_col, text_col), 1).alias("h"))
    sizes = usable.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("b"), F.min("h").alias("least")).orderBy(F.desc("n"), "l").limit(most_languages).collect()
    share = lambda r: min(Fraction(1), Fraction(rows_per_language, r["n"]), Fraction(bytes_per_language, max(r["b"], 1)))
    levels = [(r["l"], max(r["least"], int(share(r) * ((1 << 63) - 1)))) for r in sizes]
    if not levels:
        return [], []
    level = F.broadcast(docs.sparkSession.createDataFrame(levels, "__cv_l string, __cv_level long"))
    chosen = usable.join(level, (F.col("l") == F.col("__cv_l")) & (F.col("h") <= F.col("__cv_level"))).select("l", "h", "t").dropDuplicates(["l", "h"])
    got = sorted((r["l"], r["t"].encode("utf-8", "replace")) for r in chosen.limit(2 * rows_per_language * len(levels)).collect())
    return [t for _, t in got], [lang for lang, _ in got]


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 400, bytes_per_language: int = 8 << 20, most_languages: int = 1000, reject_below: float = 0.5) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, rejected.

    Learns from text and non-null lang of documents whose crc32(id as text) mod 3 is not 1, from a bounded
    sample of about `rows_per_language` whole texts of each language, chosen by a hash of id and text: fewer where
    they hold more than about `bytes_per_language`, one at least; rows with equal id and text count once. Of more than
    `most_languages` of them the commonest are learnt. Every whole text gets a prediction, of which lang, source and id are never
    inputs. `score` is the calibrated probability of lang_pred; `rejected` marks texts whose score is below `reject_below`.

    A null text or one without a letter gets `und` with score 0 and is rejected. A null id counts as
    empty text for the split. Repeated rows get equal results; ties go to the language first in
    alphabetical order. With no labelled row at all every prediction is `und`. An empty table gives an
    empty result; other columns are not read.
    """
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1
    texts, langs = training_sample(docs, rows_per_language, bytes_per_language, most_languages, id_col, text_col, lang_col, held_out)
    model = train(texts, langs)
    sent = docs.sparkSession.sparkContext.broadcast((model.labels, model.table(), model.bias, model.temperature))
    rows = docs.select(F.col(id_col).alias("__cv_id"), F.col(text_col).alias("__cv_text"), held_out.alias("held_out"))

    def guess(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        labels, table, bias, temperature = sent.value
        n = len(texts)
        preds, scores = ["und"] * n, np.zeros(n)
        if labels:
            p = predict(texts, table, bias, temperature)
            best = p.argmax(1)
            for i, t in enumerate(texts):
                if any(map(str.isalpha, t.decode("utf-8", "replace"))):
                    preds[i], scores[i] = labels[best[i]], p[i, best[i]]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(scores < reject_below, pa.bool_())],
            names=["__cv_id", "held_out", "lang_pred", "score", "rejected"],
        )

    kind = rows.schema[0].dataType.simpleString()
    return map_texts(rows, guess, f"__cv_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean").withColumnRenamed("__cv_id", id_col)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))
