"""Quality classifier learned from positive and unlabelled documents.

A linear scorer over text statistics and hashed words minimises the
non-negative unbiased risk: with trusted positives P, unlabelled web text U and
the class prior pi,

    pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)),

under the logistic loss.  Where the second part turns negative, the step goes
up its gradient instead, which undoes over-fitting.  The prior is estimated from
the same two samples: U holds pi * P, so pi is at most the ratio of their masses
above any threshold of a score, and the least ratio is taken.  Labelled negatives
are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.arrays import LOWER, span_hashes, sums, text_parts, words

#: Documents at most that the positives and the unlabelled text of a fit are sampled from, by hash, and bytes of either sample.
POSITIVES, UNLABELLED, SAMPLE_BYTES = 1500, 3000, 16 << 20
#: Hash buckets of words; steps and rate of the descent; weight of the penalty on squares.
BUCKETS, STEPS, RATE, PENALTY = 512, 300, 0.05, 1e-3
#: Bounds on the estimated prior; parts that it is estimated on in turn; share of the positives that a threshold leaves at least.
PRIOR, FOLDS, LEAST_SHARE = (0.05, 0.95), 3, 0.8

_CLASSES = {
    "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "symbol": b"#*$%&|<>",
    "point": b".,;:", "shout": b"!?", "other": b"\"'()[]{}/\\-_=+~^`@", "newline": b"\n", "space": b"\x20\t", "beyond": range(0x80, 0x100),
}
_KIND = np.full(256, len(_CLASSES), np.uint8)
for _i, _chars in enumerate(_CLASSES.values()):
    _KIND[list(_chars)] = _i
N_DENSE = len(_CLASSES) + 8


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Dense statistics of each text of a part; text number, bucket and share of each of its words."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    kinds = len(_CLASSES) + 1
    byte_shares = np.bincount(rows * kinds + _KIND[data], minlength=n * kinds).reshape(n, kinds)[:, :-1] / size[:, None]
    starts, ends, owner = words(data, offsets)
    hashes = span_hashes(LOWER[data], starts, ends)
    count = np.bincount(owner, minlength=n)
    per = np.maximum(count, 1)
    same = owner[1:] == owner[:-1]
    twice = same & (hashes[1:] == hashes[:-1])
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    kinds_of_word = np.bincount(owner[order], weights=new, minlength=n)
    pair = hashes[1:] * np.uint64(31) + hashes[:-1]
    pairs, pair_owner = pair[same], owner[1:][same]
    order2 = np.lexsort((pairs, pair_owner))
    new2 = np.ones(len(order2), bool)
    new2[1:] = (pairs[order2][1:] != pairs[order2][:-1]) | (pair_owner[order2][1:] != pair_owner[order2][:-1])
    pair_kinds = np.bincount(pair_owner[order2], weights=new2, minlength=n)
    length = (ends - starts).astype(float)
    mean = sums(length, owner, n) / per
    dense = np.column_stack([
        np.sqrt(byte_shares), sums(ends - starts == 1, owner, n) / per,
        np.log1p(count), mean, np.sqrt(np.maximum(0, sums(length**2, owner, n) / per - mean**2)),
        kinds_of_word / per, pair_kinds / np.maximum(per - 1, 1), sums(twice, owner[1:], n) / per, count < 50,
    ])
    return dense, owner, (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), 1 / np.sqrt(per[owner])


@dataclass
class Model:
    prior: float
    centre: np.ndarray
    scale: np.ndarray
    dense: np.ndarray
    words: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, owner, bucket, share = features(data, offsets)
        z = np.clip((x - self.centre) / self.scale, -5, 5) @ self.dense + sums(self.words[bucket] * share, owner, len(x)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _design(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    dense, bags = [], []
    for _, data, offsets in text_parts(pa.array(texts, pa.large_string())):
        x, owner, bucket, share = features(data, offsets)
        dense.append(x)
        bags.append(np.bincount(owner * BUCKETS + bucket, weights=share, minlength=len(x) * BUCKETS).reshape(len(x), BUCKETS))
    return np.concatenate(dense), np.concatenate(bags)


def risk_and_step(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """Parts of the risk at ``w`` (of positives as such, of the rest as negatives) and the direction of the step: the gradient, or that of the negative part turned round where it is below zero."""
    narrow = w.astype(np.float32)
    zp, zu = (p @ narrow).astype(float), (u @ narrow).astype(float)
    sp, su = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zp, zu))
    up = -prior * (p.T @ (1 - sp).astype(np.float32)) / len(p)
    down = u.T @ su.astype(np.float32) / len(u) - prior * (p.T @ sp.astype(np.float32)) / len(p)
    positive, negative = prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return positive, negative, up + down if negative >= 0 else -down


def train(positive: list[str], unlabelled: list[str], prior: float) -> Model:
    """Adam on the non-negative risk, from zero; the same inputs give the same model."""
    flat = Model(prior, np.zeros(N_DENSE), np.ones(N_DENSE), np.zeros(N_DENSE), np.zeros(BUCKETS), 0.0)
    if not positive or not unlabelled:
        return flat
    (dp, bp), (du, bu) = _design(sorted(positive)), _design(sorted(unlabelled))
    centre, scale = du.mean(0), du.std(0) + 1e-6
    std = lambda d: np.clip((d - centre) / scale, -5, 5)
    p, u = (np.hstack([std(d), b, np.ones((len(d), 1))]).astype(np.float32) for d, b in ((dp, bp), (du, bu)))
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    for step in range(1, STEPS + 1):
        g = risk_and_step(w, p, u, prior)[2] + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(prior, centre, scale, w[:N_DENSE], w[N_DENSE:-1], float(w[-1]))


def estimated_prior(positive: list[str], unlabelled: list[str]) -> float:
    """Share of positives in the unlabelled text: least ratio of the two masses above a threshold, on parts that the scorer has not seen."""
    if min(len(positive), len(unlabelled)) < 2 * FOLDS:
        return 0.5
    of_p, of_u = [], []
    for k in range(FOLDS):
        part = lambda x, held: [t for i, t in enumerate(sorted(x)) if (i % FOLDS == k) == held]  # noqa: B023, E731
        model = train(part(positive, False), part(unlabelled, False), 0.5)
        for texts, out in ((part(positive, True), of_p), (part(unlabelled, True), of_u)):
            out += [s for _, data, offsets in text_parts(pa.array(texts, pa.large_string())) for s in model.score(data, offsets)]
    p, u = np.sort(of_p), np.sort(of_u)
    above = lambda held, t: 1 - np.searchsorted(held, t, "left") / len(held)
    thresholds = p[: max(1, int((1 - LEAST_SHARE) * len(p)) + 1)]
    return float(min(max((above(u, thresholds) / above(p, thresholds)).min(), PRIOR[0]), PRIOR[1]))


def _sampled(rows: DataFrame, slots: int) -> list[int]:
    """Id hashes of at most ``slots`` rows: the least in each slot."""
    h = F.xxhash64("doc_id")
    return sorted(r.h for r in rows.groupBy(F.pmod(h, F.lit(slots))).agg(F.min(h).alias("h")).collect() if r.h is not None)


def _within(hashes: list[int], sizes: dict[int, int]) -> list[int]:
    """Of ``hashes`` in order those that fit SAMPLE_BYTES together."""
    out, used = [], 0
    for h in hashes:
        if h in sizes and used + sizes[h] <= SAMPLE_BYTES:
            used += sizes[h]
            out.append(h)
    return out


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """Model from the documents and positive labels (doc_id, quality 1) of the rows for which ``learn`` (of doc_id) holds.

    Bounded: POSITIVES and UNLABELLED documents at most, and SAMPLE_BYTES of each;
    of rows that repeat an id the least text counts.  Without positives every
    score is 0.5.
    """
    free = docs.filter(learn & F.col("doc_id").isNotNull())
    ones = labels.filter(learn & (F.col("quality") == 1))
    chosen = {"p": _sampled(ones, POSITIVES), "u": _sampled(free.select("doc_id"), UNLABELLED)}
    h = F.xxhash64("doc_id")
    wanted = sorted({*chosen["p"], *chosen["u"]})
    one = free.filter(h.isin(wanted)).groupBy(h.alias("h")).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sizes = {r.h: r.n for r in one.select("h", F.octet_length("text").alias("n")).collect()}
    taken = {k: _within(v, sizes) for k, v in chosen.items()}
    texts = {r.h: r.text for r in one.filter(F.col("h").isin(sorted({*taken["p"], *taken["u"]}))).collect()}
    positive, unlabelled = ([texts[x] for x in taken[k]] for k in "pu")
    return train(positive, unlabelled, estimated_prior(positive, unlabelled))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every whole text.

    One row per input row, repeated and null ids included; a null text counts as
    empty and gets the score of the empty text; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_parts(batch.column(1)):
                score = shared.value.score(data, offsets)
                columns = [batch.column(0).slice(at, len(score)), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")
