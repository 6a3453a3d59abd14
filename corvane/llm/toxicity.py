"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other texts are unlabelled, toxic ones among them. The
classifier minimises the class-prior-corrected risk

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

whose second part is held at zero where it turns negative, so that it can't profit from learning
the positives by heart. Features are hashed words and byte n-grams of the lower-cased text, by presence.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.frames import documents, hash_sample, map_texts, table
from corvane.llm.hashing import LETTERS_ONLY, U, Words, mix

SPACE_BITS = 22
SIZES = (5, 6)
#: Deviations beyond chance that a feature of toxic texts must have: of four million places one or so passes by chance.
SURE = 5


def feature_hits(texts: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, in order; of features where `wanted` is set, if given.

    Features are the words, and the n-grams of the text and one blank after it. A text's do not depend on the others.
    """
    words = Words(texts, lower=True, letters=True)
    shift = U(64 - SPACE_BITS)
    ids = [(words.hashes >> shift).astype(np.int32)]
    texts_of = [words.text_of(np.arange(len(words)))]
    buf = np.frombuffer(b"\n".join([*texts, b""]).lower().translate(LETTERS_ONLY), dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    for size in SIZES:
        n = len(buf) - size + 1
        if n <= 0:
            continue
        key = np.zeros(n, dtype=U)
        for i in range(size):
            key = (key << U(8)) | buf[i : i + n]
        got = (mix(key + U(size)) >> shift).astype(np.int32)
        at = np.arange(n)
        if wanted is not None:
            at = np.flatnonzero(wanted[got])
            got = got[at]
        own = np.searchsorted(ends, at, side="right")
        within = at + size <= ends[own]  # what runs on into the next text is of neither
        ids.append(got[within])
        texts_of.append(own[within])
    if wanted is not None:
        hit = wanted[ids[0]]
        ids[0], texts_of[0] = ids[0][hit], texts_of[0][hit]
    pairs = np.unique(np.concatenate(texts_of).astype(np.int64) << SPACE_BITS | np.concatenate(ids))
    return pairs >> SPACE_BITS, pairs & ((1 << SPACE_BITS) - 1)


def _hits(texts: list[bytes], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [feature_hits(texts[i : i + 64], wanted) for i in range(0, len(texts), 64)]
    return (np.concatenate([t + 64 * i for i, (t, _) in enumerate(parts)]), np.concatenate([f for _, f in parts])) if parts else (np.zeros(0, np.int64),) * 2


def apart(texts: list[bytes]) -> list[bytes]:
    """The texts without near copies of earlier ones: those that share one of their four least five-word hashes.

    A text copied many times would make its own words look like signs.
    """
    seen: set[int | bytes] = set()
    out = []
    for t in texts:
        at, hashes = Words([t]).windows(5)
        least = set(np.sort(hashes)[:4].tolist()) if len(at) else {t}
        if not least & seen:
            out.append(t)
        seen |= least
    return out


@dataclass
class ToxicityModel:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        if len(self.features):
            wanted = np.zeros(1 << SPACE_BITS, dtype=bool)
            wanted[self.features] = True
            weight = np.zeros(1 << SPACE_BITS, dtype=np.float32)
            weight[self.features] = self.weights
            text, feature = feature_hits(texts, wanted)
            z += np.bincount(text, weight[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def select_features(pos: list[bytes], unl: list[bytes], prior: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features that positives have far more often than unlabelled texts do, by how sure that is.

    A feature of toxic texts only is 1 / prior times as frequent among the positives; half that excess, beyond
    chance, is asked for. Returns the features and the logarithm of each one's excess, by which they are scaled.
    """
    count = []
    for texts in (pos, unl):
        n = np.zeros(1 << SPACE_BITS, dtype=np.int32)
        for i in range(0, len(texts), 64):
            got, times = np.unique(feature_hits(texts[i : i + 64])[1], return_counts=True)
            n[got] += times.astype(np.int32)
        count.append(n)
    p, u = count[0] / max(1, len(pos)), (count[1] + 1) / max(1, len(unl))
    z = (p - u) / np.sqrt(u / max(1, len(pos)) + u / max(1, len(unl)))
    strong = np.flatnonzero((count[0] >= 4) & (p >= 0.005) & (p > 0.5 * u / prior) & (z > SURE))
    strong = np.sort(strong[np.argsort(-z[strong], kind="stable")[:most]])
    return strong, np.log(p[strong] / u[strong])


def cut_point(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """The cut with the least corrected 0-1 risk, prior * misses + max(0, share of unlabelled - prior * found).

    Two thirds up the cuts that are as good to within a five hundredth: clean texts stay.
    """
    cuts = np.unique(np.concatenate([zp, zu]))
    cuts = np.concatenate([cuts[:1] - 1, (cuts[1:] + cuts[:-1]) / 2])
    found = 1 - np.searchsorted(np.sort(zp), cuts) / max(1, len(zp))
    share = 1 - np.searchsorted(np.sort(zu), cuts) / max(1, len(zu))
    risk = prior * (1 - found) + np.maximum(0, share - prior * found)
    good = cuts[risk <= risk.min() + 0.002]
    return float((good[0] + 2 * good[-1]) / 3)


def nn_risk(xp: np.ndarray, xu: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[float, np.ndarray, float]:
    """The non-negative corrected risk under the logistic loss, with its gradient by the weights and by the bias."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    zp, zu = xp @ w + b, xu @ w + b
    plus = prior * np.logaddexp(0, -zp).mean()
    minus = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    # d loss(z) / dz = -sig(-z); d loss(-z) / dz = sig(z); a negative second part is held at zero
    held = minus < 0
    dp = -prior * sig(-zp) / len(zp) - (0 if held else prior * sig(zp) / len(zp))
    du = 0 * zu if held else sig(zu) / len(zu)
    return float(plus + max(0, minus)), xp.T @ dp + xu.T @ du, float(dp.sum() + du.sum())


def train_nnpu(pos: list[bytes], unl: list[bytes], prior: float, most: int = 1024, epochs: int = 30, l2: float = 1e-4, seed: int = 5) -> ToxicityModel:
    """Adam on the non-negative risk with the logistic loss; a quarter of the texts is set aside for the cut.

    Equal input gives an equal model.
    """
    prior = float(np.clip(prior, 1e-3, 0.9))
    pos, unl = apart(pos), apart(unl)
    features, scale = select_features(pos, unl, prior, most) if pos and unl else (np.zeros(0, np.int64), np.zeros(0))
    if not len(features):
        return ToxicityModel(features, np.zeros(0), float(np.log(prior / (1 - prior))))
    wanted = np.zeros(1 << SPACE_BITS, dtype=bool)
    wanted[features] = True

    def matrix(texts: list[bytes]) -> np.ndarray:
        x = np.zeros((len(texts), len(features)), dtype=np.float32)
        text, feature = _hits(texts, wanted)
        at = np.searchsorted(features, feature)
        x[text, at] = scale[at]
        return x

    xp, xu = matrix(pos), matrix(unl)
    kept = [x[: len(x) // 4] if len(x) >= 40 else x for x in (xp, xu)]
    xp, xu = (x[len(x) // 4 :] if len(x) >= 40 else x for x in (xp, xu))
    rng = np.random.default_rng(seed)
    w, b = np.zeros(len(features), dtype=np.float32), float(np.log(prior / (1 - prior)))
    m, v, t = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    batches = max(1, len(xu) // 512)
    for _ in range(epochs):
        parts = zip(np.array_split(rng.permutation(len(xp)), batches), np.array_split(rng.permutation(len(xu)), batches), strict=True)
        for ip, iu in parts:
            if not len(ip) or not len(iu):
                continue
            _, gw, gb = nn_risk(xp[ip], xu[iu], w, b, prior)
            g = np.append(gw + l2 * w, gb)
            t += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w = np.maximum(w - step[:-1], 0).astype(np.float32)  # a feature is chosen as a sign of toxic text and never speaks against it
            b -= step[-1]
    return ToxicityModel(features, w * scale, -cut_point(kept[0] @ w, kept[1] @ w, prior))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", class_prior: float | None = None, positives: int = 2000, unlabelled: int = 6000, most_bytes: int = 64 << 20) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Learns labels only from rows whose crc32(id as text) mod 5 is not 0: from about `positives` texts
    labelled 1 and `unlabelled` texts taken as unlabelled, chosen by a hash; never more than twice as many, and
    fewer of either where they would hold more than about `most_bytes`.
    `class_prior` is the share of toxic texts; without it, the share among the labelled training rows.
    Scores depend on the text alone.

    Null texts count as empty and get the score of a text without features. An id labelled twice is
    toxic if any of its rows says so; null labels and ids count for nothing in training. Repeated rows
    get equal scores. Without positives every text scores the prior. An empty table gives an empty result;
    other columns are not read.
    """
    spark = docs.sparkSession
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
    known = labels.where(~held_out & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__cv_id")).agg(F.max(label_col).alias("__cv_toxic"))
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("__cv_toxic") == 1).cast("long")).alias("toxic")).first()
    n_toxic = counts["toxic"] or 0
    if class_prior is None:
        class_prior = n_toxic / max(counts["n"], 1)
    chosen = hash_sample(known.where("__cv_toxic = 1").select(F.col("__cv_id").cast("string").alias("__cv_id")), positives, n_toxic, "__cv_id")
    texts = docs.where(~held_out & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    toxic = texts.join(F.broadcast(chosen), F.col("i") == F.col("__cv_id")).select("i", "t")

    def bounded(rows: DataFrame, most: int) -> list:
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("b")).first()
        share = min(1.0, most / max(size["n"], 1), most_bytes / max(size["b"] or 0, 1))
        return hash_sample(rows, int(share * size["n"]), size["n"], "i", "t").select("t").collect() if size["n"] else []

    pos, unl = bounded(toxic, 2 * positives), bounded(texts, unlabelled)
    pos, unl = (sorted((r["t"].encode("utf-8", "replace") for r in x), key=lambda t: (zlib.crc32(t), t)) for x in (pos, unl))
    sent = spark.sparkContext.broadcast(train_nnpu(pos, unl, class_prior))
    rows = docs.select(F.col(id_col).alias("__cv_id"), F.col(text_col).alias("__cv_text"), held_out.alias("held_out"))

    def judge(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        s = sent.value.score(texts)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["__cv_id", "held_out", "score", "predicted"])

    kind = rows.schema[0].dataType.simpleString()
    return map_texts(rows, judge, f"__cv_id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("__cv_id", id_col)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
