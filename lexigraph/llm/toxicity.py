"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier on hashed word and word-stem features is trained in numpy from confirmed toxic texts and
unlabelled texts, by the risk estimator corrected for the class prior: prior times the risk of calling a toxic text
clean, plus the risk of calling unlabelled texts toxic less the part of it that the toxic ones among them cause,
which is held at or above zero. Texts that are labelled clean aren't used. The class prior is estimated from how much
of the unlabelled texts scores as high as the best held-out toxic ones. Scoring is a map over whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm.common import stored, table
from lexigraph.llm.language import held_out

WORDS = re.compile(r"\w+")
BITS = 18
#: Confirmed toxic and unlabelled documents (about so many, chosen by a hash of their id) that the classifier is fitted on.
MAX_TOXIC, MAX_ROWS = 3_000, 6_000
#: Word stems that are features beside the word itself.
STEMS = (4, 5, 6, 7, 8)
#: Shares of a text's words from which a word or stem counts as frequent in it. (A level for the mere presence of a word
#: would find short passages in very long texts, but on the tables it cost a tenth of the precision.)
SHARES = (0.001, 0.003, 0.006, 0.015)
LEVELS = len(SHARES)
#: Number of features: each hash with its levels.
SIZE = LEVELS << BITS
#: Words whose weights a Python worker holds at a time.
CACHE = 400_000


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float


def word_features(word: str) -> list[int]:
    """Hashes of a lower-case word and of its stems."""
    raw = word.encode()
    return [zlib.crc32(raw) >> (32 - BITS)] + [zlib.crc32(b"%d:" % n + word[:n].encode()) >> (32 - BITS) for n in STEMS if len(word) >= n]


def text_words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if isinstance(text, str) else []


def text_features(text: str | None, known: dict[str, list[int]]) -> np.ndarray:
    """A text's features: for each word or stem in it, each of SHARES that its share of the words reaches."""
    words = text_words(text)
    hashes: list[int] = []
    for word in words:
        if (got := known.get(word)) is None:
            got = known[word] = word_features(word)
        hashes += got
    found, times = np.unique(np.asarray(hashes, dtype=np.int32), return_counts=True)
    return np.concatenate([found[times >= share * len(words)] * LEVELS + k for k, share in enumerate(SHARES)])


def telling_features(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> np.ndarray:
    """Features that toxic texts hold far more often than the prior explains.

    If a feature told nothing, each unlabelled text with it would be toxic with the prior's probability; a feature
    stays if the chance of as many toxic texts (Chernoff's bound) is under one in the number of features tested.
    """
    size = SIZE
    held_p = np.bincount(np.concatenate([np.unique(x) for x in toxic]), minlength=size)
    held_u = np.bincount(np.concatenate([np.unique(x) for x in unlabelled]), minlength=size) * (len(toxic) / max(prior * len(unlabelled), 1e-9))
    n = np.maximum(held_u, held_p)
    share = np.divide(held_p, n, out=np.zeros(size), where=n > 0)
    q = np.clip(share, 1e-12, 1 - 1e-12)
    gain = n * (q * np.log(q / prior) + (1 - q) * np.log((1 - q) / (1 - prior)))
    tested = held_p >= 3
    return np.flatnonzero(tested & (share > prior) & (gain > np.log(max(tested.sum(), 1))))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk(toxic: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Parts of the risk of the scores: of calling toxic texts clean, and of calling clean texts toxic (below zero if overfitted)."""
    loss = lambda z: np.logaddexp(0, z)
    return prior * loss(-toxic).mean(), loss(unlabelled).mean() - prior * loss(toxic).mean()


def risk_slopes(toxic: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """By each score, the slope of the risk; where its second part is below zero, of that part's negative instead, a step back from it."""
    toxic_part, clean_part = -prior * sigmoid(toxic) / len(toxic), sigmoid(unlabelled) / len(unlabelled)
    if risk(toxic, unlabelled, prior)[1] < 0:
        return -toxic_part, -clean_part
    return toxic_part - prior * sigmoid(-toxic) / len(toxic), clean_part


def train_nnpu(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 30, rate: float = 0.05, decay: float = 1e-4, seed: int = 1) -> ToxicityModel:
    """Adam on the non-negative risk with the logistic loss, over minibatches that hold both kinds in proportion."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(SIZE, dtype=np.float32), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not toxic or not unlabelled or not 0 < prior < 1:
        return ToxicityModel(w, b)
    used = telling_features(toxic, unlabelled, prior)  # all other weights stay 0
    place = np.full(SIZE, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    toxic, unlabelled = ([y[y >= 0] for y in (place[x] for x in rows)] for rows in (toxic, unlabelled))
    theta, m, v = np.zeros((3, len(used) + 1))
    theta[-1] = b
    steps = max(8, len(unlabelled) // 128)

    def scores(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        flat, who = np.concatenate([*rows, np.zeros(0, dtype=np.int32)]), np.repeat(np.arange(len(rows)), size)
        return np.bincount(who, weights=theta[flat], minlength=len(rows)) + theta[-1], flat, who

    def gradient(flat: np.ndarray, who: np.ndarray, slope: np.ndarray) -> np.ndarray:
        g = np.bincount(flat, weights=slope[who], minlength=len(theta)).astype(np.float64)
        g[-1] += slope.sum()
        return g

    t = 0
    for _ in range(epochs):
        p_order, u_order = (np.array_split(rng.permutation(len(x)), min(steps, len(x))) for x in (toxic, unlabelled))
        for k in range(steps):
            zp, fp, wp = scores([toxic[i] for i in p_order[k % len(p_order)]])
            zu, fu, wu = scores([unlabelled[i] for i in u_order[k % len(u_order)]])
            slope_p, slope_u = risk_slopes(zp, zu, prior)
            g = gradient(fp, wp, slope_p) + gradient(fu, wu, slope_u)
            g[:-1] += decay * theta[:-1]
            t += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            np.maximum(theta[:-1], 0, out=theta[:-1])  # all of them speak for toxic
    w[used] = theta[:-1]
    return ToxicityModel(w, float(theta[-1]))


def best_bin(toxic: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of toxic texts among the unlabelled ones, from scores of both that weren't trained on.

    The unlabelled texts above a threshold hold at least the prior's part of the toxic texts' share above it, so each
    threshold bounds the prior from above by the quotient of the shares; the one with the least bound, allowing for the
    sizes of the samples, gives the estimate.
    """
    if not len(toxic) or not len(unlabelled):
        return 0.0
    at = np.sort(toxic)[::-1]
    share_p = np.searchsorted(np.sort(toxic), at, side="left")
    share_p = 1 - share_p / len(toxic)
    share_u = 1 - np.searchsorted(np.sort(unlabelled), at, side="left") / len(unlabelled)
    slack = (1 + gamma) * sum(np.sqrt(np.log(4 / delta) / (2 * len(x))) for x in (toxic, unlabelled))
    best = np.argmin((share_u + slack) / share_p)
    return float(share_u[best] / share_p[best])


def estimate_prior(toxic: list[np.ndarray], unlabelled: list[np.ndarray], rounds: int = 2, guess: float = 0.1, seed: int = 5) -> float:
    """Share of toxic texts among the unlabelled ones: each half is scored by a classifier trained on the other half, in
    the first round with ``guess`` as prior, then with the estimate so far. Without evidence the guess stays."""
    rng, prior = np.random.default_rng(seed), guess
    halves = [[[rows[i] for i in order[k::2]] for k in (0, 1)] for rows in (toxic, unlabelled) for order in [rng.permutation(len(rows))]]
    for _ in range(rounds):
        found = []
        for k in (0, 1):
            model = train_nnpu(halves[0][k], halves[1][k], prior, epochs=8)
            scored = [np.array([model.weights[x].sum() + model.bias for x in rows[1 - k]]) for rows in halves]
            if model.weights.any():
                found.append(best_bin(*scored))
        prior = float(np.clip(np.mean(found or [prior]), 1e-4, 0.9))
    return prior


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_rows: int = MAX_ROWS) -> ToxicityModel:
    """Fits on ``docs`` (doc_id, text): those with toxic 1 in ``labels`` (doc_id, toxic) are the confirmed toxic texts, those
    without a row there the unlabelled ones; where every document has one, all are drawn on with their labels unseen.

    About ``max_toxic`` and ``max_rows`` documents are chosen by a hash of the id, one row an id, which bounds what the
    driver gets. Rows with a null id teach nothing. Without toxic or unlabelled texts the model has no evidence.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = stored(docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct(), "ids")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    toxic_ids = known.where("toxic = 1").join(ids, "doc_id", "left_semi")
    positive = toxic_ids.where(draw < max_toxic / max(toxic_ids.count(), 1)).select("doc_id", F.lit(True).alias("positive"))
    # Counted are the ids that can be drawn: labels may be of other documents, and ids may be repeated.
    free = ids.join(known, "doc_id", "left_anti")
    n_free = free.count()
    pool, n = (free, n_free) if n_free else (ids, ids.count())
    unlabelled = pool.where(draw >= 1 - max_rows / max(n, 1))
    chosen = stored(positive.unionByName(unlabelled.withColumn("positive", F.lit(False))), "toxicity_rows")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            yield pd.DataFrame({"doc_id": batch["doc_id"], "positive": batch["positive"], "f": [text_features(x, seen).astype(np.int32).tobytes() for x in batch["text"]]})

    # The chosen ids are bounded, so they are sent to the documents and not the texts to them.
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").mapInPandas(featured, "doc_id long, positive boolean, f binary")
    got = rows.groupBy("doc_id", "positive").agg(F.max("f").alias("f")).orderBy("doc_id").toPandas()
    toxic, other = ([np.frombuffer(x, dtype=np.int32) for x in got["f"][got["positive"].astype(bool) == kind]] for kind in (True, False))
    return train_nnpu(toxic, other, estimate_prior(toxic, other) if toxic and other else 0.0)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1, higher: toxic likelier) and predicted (1 from ``threshold`` on).

    A text's features are its words and their stems, of texts of any length all of them; a null or empty text gets the
    score of no evidence. An empty table gives an empty result.
    Repeated rows get the same result, other columns are kept, and columns named score or predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value.weights, shared.value.bias
        telling, seen = set((np.flatnonzero(weights) // LEVELS).tolist()), {}
        for batch in texts:
            out = np.empty(len(batch))
            for i, text in enumerate(batch):
                words, times = text_words(text), {}
                for word in words:
                    if (got := seen.get(word)) is None:
                        got = seen[word] = tuple(f for f in word_features(word) if f in telling)
                    for f in got:
                        times[f] = times.get(f, 0) + 1
                z = bias
                for f, n in times.items():
                    z += sum(weights[LEVELS * f + k] for k, share in enumerate(SHARES) if n >= share * len(words))
                out[i] = 1 / (1 + np.exp(-min(max(float(z), -40.0), 40.0)))
                if len(seen) > CACHE:
                    seen = {}
            yield pd.Series(out)

    return docs.withColumn("score", score(F.col("text"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))))
    return score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
