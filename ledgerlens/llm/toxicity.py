"""Toxicity scores: embeddings of words' character runs, averaged, under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import texts

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
WIDTH = 4
GRAMS = (3, 4, 5, 6)
TRAIN_TOXIC = 2_000
TRAIN_CLEAN = 3_000
#: Code points of the longest text that is trained on: with the numbers of rows this bounds what comes to the driver.
TRAIN_CHARS = 1 << 13
EPOCHS = 12
#: Steps of Adagrad for embeddings and softmax: large, as a text's mean moves little with one of its runs.
RATE, HEAD_RATE = 3.0, 0.6
FOLDS = 5

#: Bytes that end a word: all ASCII but letters and digits.
_GAP = np.ones(256, bool)
_GAP[128:] = False
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[_GAP] = 32


def subwords(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the runs of 3, 4, 5 and 6 bytes inside words (a run may take in the gap on either side) and of whole
    words; for each of the five kinds also where each text (plus one) begins. Runs never leave their text."""
    folded = _FOLD[raw]
    n = len(folded)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words._VALUES[folded] * words.powers(n), out=sums[1:])
    back = words.powers(n + 1, True)
    gap = folded == 32
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    barred = np.concatenate([[0], np.cumsum(gap, dtype=np.int32)])
    crossed = np.cumsum(edge, dtype=np.int32)
    out = []

    def take(starts: np.ndarray, length) -> None:
        hashed = (sums[starts + length] - sums[starts]) * back[starts] * np.uint64(0xD6E8FEB86659FD93)
        out.append(((hashed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), np.searchsorted(starts, offsets)))

    for g in GRAMS:
        last = max(0, n - g + 1)
        inner = barred[g - 1 : n] != barred[1 : last + 1]  # a gap strictly inside the run
        take(np.flatnonzero(~inner & (crossed[g - 1 : n] == crossed[:last])), g)
    ink = ~gap
    opened, closed = ink.copy(), ink.copy()
    opened[1:] &= ~ink[:-1] | edge[1:n]
    closed[:-1] &= ~ink[1:] | edge[1:n]
    starts = np.flatnonzero(opened)
    take(starts, np.flatnonzero(closed) + 1 - starts)
    return out


def bags(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct buckets of each text and how often each occurs."""
    kinds = subwords(raw, offsets)
    return [np.unique(np.concatenate([b[at[k] : at[k + 1]] for b, at in kinds]), return_counts=True) for k in range(len(offsets) - 1)]


def train(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Fit embeddings and softmax together by Adagrad on batches of texts, then fold them: the weight of each bucket in
    the difference of the two classes' logits, and the difference's constant. A sample is a text's distinct buckets and
    how often each occurs. A text's vector is the mean of its embeddings."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0 if not len(labels) else (4.0 if labels[0] else -4.0)
    vectors = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    heads = rng.normal(0, 0.1, (2, WIDTH)).astype(np.float32)
    bias = np.log(np.bincount(labels, minlength=2) / len(labels)).astype(np.float32)
    seen_v, seen_h = np.full((BUCKETS, 1), 1e-8, np.float32), np.full((2, 1), 1e-8, np.float32)
    usable = np.array([k for k, (b, _) in enumerate(samples) if len(b)], np.int64)
    for _ in range(epochs):
        rng.shuffle(usable)
        for at in range(0, len(usable), 32):
            batch = usable[at : at + 32]
            sizes = np.array([len(samples[k][0]) for k in batch])
            owner = np.repeat(np.arange(len(batch)), sizes)
            ids = np.concatenate([samples[k][0] for k in batch])
            share = np.concatenate([samples[k][1] / samples[k][1].sum() for k in batch]).astype(np.float32)
            means = np.add.reduceat(vectors[ids] * share[:, None], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
            logits = means @ heads.T + bias
            wrong = np.exp(logits - logits.max(axis=1, keepdims=True))
            wrong /= wrong.sum(axis=1, keepdims=True)
            wrong[np.arange(len(batch)), labels[batch]] -= 1
            to_vectors, to_heads = wrong @ heads, wrong.T @ means
            one, where = np.unique(ids, return_inverse=True)
            step = np.stack([np.bincount(where, share * to_vectors[owner, d]) for d in range(WIDTH)], axis=1).astype(np.float32)
            seen_v[one] += (step**2).mean(axis=1, keepdims=True)
            vectors[one] -= RATE * step / np.sqrt(seen_v[one])
            seen_h += (to_heads**2).mean(axis=1, keepdims=True)
            heads -= HEAD_RATE * to_heads / np.sqrt(seen_h)
    return vectors @ (heads[1] - heads[0]), float(bias[1] - bias[0])


def score(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    for buckets, begins in subwords(raw, offsets):
        sums = np.concatenate([[0.0], np.cumsum(weights[buckets], dtype=np.float64)])
        total += np.diff(sums[begins])
        count += np.diff(begins)
    return 1 / (1 + np.exp(-(bias + total / np.maximum(count, 1))))


def held_out(doc_id):
    """True where crc32 of the id as text leaves 0 when divided by ``FOLDS``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TRAIN_TOXIC, clean_rows: int = TRAIN_CLEAN) -> tuple[np.ndarray, float]:
    """Train on about ``toxic_rows`` and ``clean_rows`` labelled documents of at most ``TRAIN_CHARS`` code points that are not held out, chosen by
    a hash of the id. Only distinct buckets and counts of that bounded sample come to the driver. The constant is then moved from
    the sample's odds to those of all labels."""
    known = (
        labels.select(labels["doc_id"].cast("long").alias("id"), labels["toxic"].cast("int").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
        .filter(~held_out(F.col("id")))
    )
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64(F.lit("toxic"), "id"), F.lit(1 << 30)) / float(1 << 30)
    wanted = {1: toxic_rows, 0: clean_rows}
    share = F.when(F.col("toxic") == 1, F.lit(wanted[1] / max(1, sizes.get(1, 0)))).otherwise(F.lit(wanted[0] / max(1, sizes.get(0, 0))))
    chosen = known.filter(place < share)
    sample = texts(docs).filter(F.char_length("text") <= TRAIN_CHARS).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))  # at most the two bounds, about

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, offsets in words.slices(batch.column("text")):
                found = bags(raw, offsets)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column("id").slice(first, len(found)),
                        "toxic": batch.column("toxic").slice(first, len(found)),
                        "buckets": [b.tobytes() for b, _ in found],
                        "counts": [c.astype(np.uint32).tobytes() for _, c in found],
                    }
                )

    rows = sorted(
        (r.id, bytes(r.buckets), bytes(r.counts), r.toxic)
        for r in sample.select("id", "toxic", "text").mapInArrow(read, "id long, toxic int, buckets binary, counts binary").toLocalIterator()
    )
    weights, bias = train([(np.frombuffer(b, np.int32), np.frombuffer(c, np.uint32)) for _, b, c, _ in rows], np.array([r[3] for r in rows], np.int64))
    taken = [sum(r[3] == k for r in rows) for k in (0, 1)]
    if min(taken) and min(sizes.get(0, 0), sizes.get(1, 0)):
        bias += np.log(sizes[1] / sizes[0]) - np.log(taken[1] / taken[0])
    return weights, bias


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document; the whole text is scored.

    Only the text enters a score. Null texts count as empty; a text without words gets the score of the constant
    alone. Without labels of both classes all scores are equal (0.5 without any label). Repeated rows are scored
    alike; a label given twice counts once (the higher); an empty table gives no rows.
    """
    weights, bias = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, offsets in words.slices(batch.column("text")):
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(first, len(offsets) - 1),
                        "held_out": batch.column("held_out").slice(first, len(offsets) - 1),
                        "score": score(raw, offsets, weights, bias),
                    }
                )

    asked = texts(docs).withColumn("held_out", held_out(F.col("doc_id")))
    scored = asked.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
