"""Near copies: improved consistent weighted sampling over TF-IDF shingles, banded and verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import components, texts, write_once

WIDTH = 5
LIKE = 0.8
BANDS, ROWS = 12, 4
SLOT_BITS = 16
DRAW_BITS = 16
BLOCK_TEXTS = 256
BLOCK_TERMS = 400_000


def _shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, firsts = words.bounds(raw, offsets)
    return words.bags(*words.shingles(words.word_hashes(raw, starts, ends), firsts, WIDTH))


def _slots(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """``1 + log10((1 + documents) / (1 + documents with the shingle))`` by hashed slot, counted over all documents.

    Shingles share ``2 ** SLOT_BITS`` slots: a slot's floor of rare shingles grows with the table as the number of
    documents does, so rare shingles weigh the same at every size, and those found in more than about a
    hundredth of the documents weigh less. What comes to the driver is bounded by the slots.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros(1 << SLOT_BITS, np.int64), 0
        for batch in batches:
            for _, raw, offsets in words.slices(batch.column("text")):
                terms, _, _ = _shingles(raw, offsets)
                sums += np.bincount(_slots(terms), minlength=len(sums))
                rows += len(offsets) - 1
        slot = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"slot": np.append(slot, -1), "n": np.append(sums[slot], rows)})

    found = docs.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = found["slot"].to_numpy(), found["n"].to_numpy()
    total = n[slot < 0].sum()
    seen = np.zeros(1 << SLOT_BITS)
    seen[slot[slot >= 0]] = np.minimum(n[slot >= 0], total)
    return (1 + np.log10((1 + total) / (1 + seen))).astype(np.float32)


class Sampler:
    """Draws of the consistent weighted samples, read from tables by hash of the shingle and number of the sample."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 11):
        rng = np.random.default_rng(seed)
        size = 1 << DRAW_BITS
        self.r = rng.gamma(2.0, 1.0, size).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, size)).astype(np.float32)
        self.beta = rng.random(size).astype(np.float32)
        self.turns = rng.integers(1, 1 << 62, (samples, 3)).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def sketch(self, terms: np.ndarray, weights: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """(texts with terms, samples): hashes of the sampled shingle and its rounded weight. ``begins`` are the starts of
        texts that have terms. With r, c ~ Gamma(2, 1) and beta ~ U(0, 1) of shingle and sample,
        t = floor(ln w / r + beta) and the shingle with least ln c - r (t - beta + 1) is sampled, together with t."""
        logs = np.log(weights).astype(np.float32)
        shift = np.uint64(64 - DRAW_BITS)
        out = np.empty((len(begins), len(self.turns)), np.uint64)
        place = np.arange(len(terms), dtype=np.uint64)
        for k, turn in enumerate(self.turns):
            r = self.r[(terms * turn[0]) >> shift]
            beta = self.beta[(terms * turn[1]) >> shift]
            t = np.floor(logs / r + beta)
            a = self.log_c[(terms * turn[2]) >> shift] - r * (t - beta + 1)
            bits = a.view(np.int32).astype(np.int64)
            bits = np.where(bits < 0, ~bits & 0xFFFFFFFF, bits | 0x80000000).astype(np.uint64)  # floats in ascending order
            least = np.minimum.reduceat(bits << np.uint64(32) | place, begins) & np.uint64(0xFFFFFFFF)
            least = least.astype(np.int64)
            out[:, k] = words.mix(terms[least] + t[least].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return out


def _node(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def sketches(docs: DataFrame, idf: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, mark, node, terms, keys``: two hashes of the text (``mark`` is Spark's), its number of shingles (with
    repeats), and one key per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(bands * rows)
        for batch in batches:
            for first, raw, offsets in words.slices(batch.column("text")):
                terms, counts, begins = _shingles(raw, offsets)
                full = np.flatnonzero(np.diff(begins))
                keys = np.zeros((len(offsets) - 1, bands), np.uint64)
                if len(full):
                    found = sampler.sketch(terms, counts * idf[_slots(terms)], begins[:-1][full])
                    for b in range(bands):
                        key = np.full(len(full), b, np.uint64)
                        for s in range(b * rows, (b + 1) * rows):
                            key = words.mix(key * np.uint64(31) + found[:, s])
                        keys[full, b] = key
                size = np.zeros(len(keys), np.int64)
                size[full] = np.add.reduceat(counts, begins[:-1][full]) if len(full) else 0
                ends = np.concatenate([[0], np.cumsum((size > 0) * bands)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(keys)),
                        batch.column("mark").slice(first, len(keys)),
                        pa.array([_node(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])], pa.binary()),
                        pa.array(size),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[full].ravel().view(np.int64))),
                    ],
                    ["doc_id", "mark", "node", "terms", "keys"],
                )

    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return marked.mapInArrow(run, "doc_id long, mark long, node binary, terms long, keys array<long>")


def vectors(members: DataFrame, idf: np.ndarray) -> DataFrame:
    """``members`` (any columns, ``node`` and ``text``) with ``features`` and ``weights`` instead of the text, without rows
    whose text is not the node's: a shingle's second, third, ... occurrence is a feature of its own, so that sums of common
    weights are those of the TF-IDF minima."""
    kept = [c for c in members.columns if c != "text"]
    schema = members.select(*kept).schema.add("features", "binary").add("weights", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, offsets in words.slices(batch.column("text")):
                terms, counts, begins = _shingles(raw, offsets)
                nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                features = np.repeat(terms, counts)
                weights = idf[_slots(features)]
                features = np.where(nth > 0, words.mix(features + nth.astype(np.uint64)), features)
                at = np.concatenate([[0], np.cumsum(counts)])[begins]
                found = pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(first, len(offsets) - 1) for c in kept],
                        pa.array([features[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
                        pa.array([weights[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
                    ],
                    [*kept, "features", "weights"],
                )
                own = [_node(raw[a:b].tobytes()) == n for a, b, n in zip(offsets[:-1], offsets[1:], found.column("node").to_pylist())]
                yield found.filter(pa.array(own, pa.bool_()))

    return members.mapInArrow(run, schema)


def likeness(features: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """Weighted Jaccard similarity of all pairs of a block of texts."""
    n = len(features)
    sums = np.array([w.sum(dtype=np.float64) for w in weights])
    owner = np.repeat(np.arange(n), [len(f) for f in features])
    one, column, times = np.unique(np.concatenate(features), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    owner, column, weight = owner[shared], number[column[shared]], np.sqrt(np.concatenate(weights)[shared])
    order = np.argsort(column, kind="stable")
    owner, column, weight = owner[order], column[order], weight[order]
    common = np.zeros((n, n))
    for a in range(0, int((times > 1).sum()), 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        dense = np.zeros((n, 4096), np.float32)
        dense[owner[lo:hi], column[lo:hi] - a] = weight[lo:hi]
        common += dense @ dense.T
    return common / np.maximum(sums[:, None] + sums[None, :] - common, 1e-9)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links: each node but the first of its component with an earlier one."""
    seen, out = np.zeros(len(linked), bool), []
    for root in range(len(linked)):
        if seen[root]:
            continue
        seen[root] = True
        stack = [root]
        while stack:
            at = stack.pop()
            new = np.flatnonzero(linked[at] & ~seen)
            seen[new] = True
            out += [(at, int(k)) for k in new]
            stack += new.tolist()
    return out


def verified_links(members: DataFrame, docs: DataFrame, idf: np.ndarray, like: float = LIKE) -> DataFrame:
    """Links ``a, b`` between texts (as nodes) that span the graph of all pairs of one candidate group that are at least
    ``like`` similar. ``members`` has ``node, terms, mark, least_id, label``.

    The text of a member is fetched from its row with the least id; the join always goes by shuffle, so it costs the
    same share of the input at every size. A group is dealt into blocks of about ``BLOCK_TEXTS`` texts or ``BLOCK_TERMS`` shingles, and every two blocks of it meet in
    one task, so no task holds more than two blocks however large the group; a task returns a spanning forest
    of the links it finds, fewer rows than it got texts, and never the pairs.
    """
    sizes = members.groupBy("label").agg(F.count("*").alias("texts"), F.sum("terms").alias("terms"))
    parts = F.greatest(F.ceil(F.col("texts") / BLOCK_TEXTS), F.ceil(F.col("terms") / BLOCK_TERMS)).cast("int")
    sizes = sizes.filter("texts > 1").select(F.col("label").alias("_label"), parts.alias("parts"))
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = members.join(sizes, F.col("label") == F.col("_label")).withColumn("part", mine)
    dealt = write_once(dealt.select("node", "mark", "least_id", "label", "parts", "part"))
    same = docs["doc_id"].eqNullSafe(F.col("least_id")) & (F.xxhash64("text") == F.col("mark"))
    texts_of = docs.join(dealt.hint("merge"), same).select("node", "label", "parts", "part", "text")
    own = vectors(texts_of, idf)
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumn("x", F.least("part", "other")).withColumn("y", F.greatest("part", "other"))

    def link(table: pa.Table) -> pa.Table:
        node, first = np.unique(np.array(table["node"].to_pylist(), object), return_index=True)
        if len(node) < 2:
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        features = [np.frombuffer(table["features"][int(k)].as_py(), np.uint64) for k in first]
        weights = [np.frombuffer(table["weights"][int(k)].as_py(), np.float32) for k in first]
        pairs = forest(likeness(features, weights) >= like - 1e-6)
        return pa.table({"a": pa.array([node[i] for i, _ in pairs], pa.binary()), "b": pa.array([node[j] for _, j in pairs], pa.binary())})

    return met.groupBy("label", "x", "y").applyInArrow(link, "a binary, b binary")


def classes(docs: DataFrame, like: float = LIKE) -> tuple[DataFrame, DataFrame]:
    """``doc_id, mark, node`` per document, and ``node, label, least_id, copies`` per distinct text, where equal labels
    are classes of near copies.

    Each distinct text is sketched with 48 consistent weighted samples in 12 bands of 4, which finds a pair of
    similarity 0.8 with probability 0.998. Texts that share a band form candidate groups, and only their shingles are
    shuffled, to be compared in blocks (``verified_links``).
    """
    own = texts(docs)
    idf = inverse_frequencies(own)
    rows = write_once(sketches(own, idf))
    nodes = rows.groupBy("node").agg(F.first("terms").alias("terms"), F.first("keys").alias("keys"))
    keyed = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    least = keyed.groupBy("band", "key").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(least, ["band", "key"]).select(F.col("node").alias("a"), "b")
    groups = write_once(components(met))
    ends = [F.first("terms").alias("terms"), F.first("mark").alias("mark"), F.min("doc_id").alias("least_id")]
    members = groups.join(rows.groupBy("node").agg(*ends), "node")
    linked = write_once(components(verified_links(members, own, idf, like)))
    label = F.coalesce(F.col("label"), F.col("node"))
    by_node = rows.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    by_node = by_node.join(linked, "node", "left").withColumn("label", label)
    return rows.select("doc_id", "mark", "node"), write_once(by_node)


def near_copies(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """``doc_id, class_id, class_size`` per document: documents linked by a chain of equal texts or of texts whose TF-IDF
    shingles of five words have a weighted Jaccard similarity of at least ``like`` share the least id of all of them.

    Null texts count as empty; equal texts, empty ones included, are one class; a text of fewer than five words is one
    shingle; words are split at white space, ASCII letters in lower case. Repeated rows are a class; null ids take no
    part in the class id, which is null if all ids of the class are; an empty table gives no rows.
    """
    rows, by_node = classes(docs, like)
    whole = by_node.groupBy("label").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"))
    found = write_once(by_node.join(whole, "label").select("node", "class_id", "class_size"))
    return rows.select("doc_id", "node").join(found, "node").select("doc_id", "class_id", "class_size")


def representatives(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay when one of each class of near copies does: the one with the least id
    (null ids last, of equal ids the first by hash of the text), once if the row repeats."""
    rows, by_node = classes(docs, like)
    labelled = write_once(rows.join(by_node.select("node", "label"), "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")
    kept = labelled.groupBy("label").agg(first).select(F.col("label").alias("_label"), F.col("first.doc_id").alias("_id"), F.col("first.node").alias("_node"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("node") == F.col("_node"))
    judged = labelled.join(kept, F.col("label") == F.col("_label")).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), same.alias("stays"))
    gone = write_once(judged.filter(~F.col("stays")).select("_id", "_mark").distinct())
    again = write_once(judged.filter("stays").groupBy("_id", "_mark").count().filter("count > 1").select("_id", "_mark"))
    mine = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col("_mark"))
    out = docs.join(gone.hint("merge"), mine, "left_anti")  # they grow with the documents, so never a broadcast
    if again.isEmpty():
        return out
    once = out.join(again, mine).dropDuplicates(["_id", "_mark"]).select(*docs.columns)
    return out.join(again, mine, "left_anti").unionByName(once)
