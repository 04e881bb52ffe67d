"""SimHash fingerprints and Hamming search by permuted block tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import bytes_per_batch, shuffle_partitions, texts, write_once

BITS = 128
RADIUS = 17  # the farthest of the pairs of sf0.1 with a five-word Jaccard similarity of 0.8 or more
BLOCKS = 6
TERM_WORDS = 2
ROWS = 512
BATCH_BYTES = 2 << 20  # of texts that go to Python and back at once
_LAST = (1 << 63) - 1


def fingerprints(column: pa.Array, term_words: int = TERM_WORDS) -> np.ndarray:
    """``(texts, 16)`` bytes. A term is a run of ``term_words`` words (a shorter text is one term); each of its 128
    hash bits votes with weight ``1 + ln(count)``, for or against. A text without words gets zeros."""
    out = np.zeros((len(column), BITS // 8), np.uint8)
    for first, raw, offsets in words.slices(column):
        starts, ends, firsts = words.bounds(raw, offsets)
        terms, begins = words.shingles(words.word_hashes(raw, starts, ends), firsts, term_words)
        terms, counts, begins = words.bags(terms, begins)
        weights = (1 + np.log(counts)).astype(np.float32)
        both = np.stack([terms, words.mix(terms + np.uint64(1))], axis=1).view(np.uint8)
        for k in np.flatnonzero(np.diff(begins)):
            votes = np.zeros(BITS, np.float64)
            for a in range(begins[k], begins[k + 1], 8192):
                b = min(a + 8192, begins[k + 1])
                votes += 2 * (weights[a:b] @ np.unpackbits(both[a:b], axis=1).astype(np.float32)) - weights[a:b].sum()
            out[first + k] = np.packbits(votes > 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.unpackbits(a ^ b, axis=1).sum(axis=1) / BITS


def _id_ranges(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the ranges of ids that have rows, the least id in each, and the cuts between ranges of about equal size.

    As many as there are shuffle partitions; found from the id column alone. Null ids come last."""
    ids = docs.select(F.coalesce(F.col("doc_id"), F.lit(_LAST)).alias("doc_id"))
    n = shuffle_partitions(docs)
    cuts = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 20 * n)).first()[0]
    cuts = np.unique(np.array(cuts or [], np.int64))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            where = np.searchsorted(cuts, at, "right")
            ranges = np.unique(where)
            yield pa.RecordBatch.from_pydict(
                {"r": pa.array(ranges, pa.int32()), "least": pa.array([at[where == r].min() for r in ranges], pa.int64())}
            )

    found = ids.mapInArrow(least, "r int, least long").groupBy("r").agg(F.min("least").alias("least")).orderBy("r").collect()
    return np.array([r.r for r in found], np.int64), np.array([r.least for r in found], np.int64), cuts


def with_next(docs: DataFrame, use, schema: str) -> DataFrame:
    """Run ``use(ids, texts, next_texts)`` (lists; Arrow arrays in a dict out) over all documents in ascending id, each
    with the text of the next one (after the last: the first). Rows with one id are ordered by text, null ids last.

    The whole text is shuffled once, to ranges of ids; the first document of each range also goes to the range before.
    """
    ranges, least, cuts = _id_ranges(docs)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False)
            at = np.searchsorted(ranges, np.searchsorted(cuts, ids, "right"))
            batch = pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(np.zeros(len(ids), bool)), batch.column("doc_id"), batch.column("text")],
                ["range", "guest", "doc_id", "text"],
            )
            yield batch
            guests = np.flatnonzero(least[at] == ids)
            if len(guests):
                copy = batch.take(pa.array(guests))
                before = pa.array((at[guests] - 1) % len(ranges), pa.int32())
                yield copy.set_column(0, "range", before).set_column(1, "guest", pa.array(np.ones(len(guests), bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last own row, still without its next text
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                own, following = [], []
                for r, guest, doc_id, text in zip(*[c.to_pylist() for c in part.columns]):
                    if held is not None:
                        own.append(held)
                        following.append(text)
                        held = None
                    if not guest:
                        held = (doc_id, text)
                if own:
                    ids, mine = zip(*own)
                    yield pa.RecordBatch.from_pydict(use(list(ids), list(mine), following))

    order = ["range", "guest", F.asc_nulls_last("doc_id"), "text"]
    dealt = docs.mapInArrow(deal, "range int, guest boolean, doc_id long, text string")
    return dealt.repartitionById(shuffle_partitions(docs), "range").sortWithinPartitions(*order).mapInArrow(run, schema)


def block_tables(df: DataFrame, blocks: int = BLOCKS, radius: int = RADIUS, probe: bool = False) -> DataFrame:
    """A row of ``df`` (``high``, ``low``: the two halves of a fingerprint) for each block of its bits: ``table`` and ``key``.
    With ``probe`` a row for each value of the block that differs from its own in few enough bits: two fingerprints that
    differ in at most ``radius`` bits have a block in which they differ in at most ``radius // blocks``, or, in all blocks
    beyond the first ``radius % blocks + 1``, in one less, so a probe of one meets the other."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]

    def block(k: int):
        lo, hi = edges[k], edges[k + 1]  # bits counted from the left
        value = F.lit(0).cast("long")
        for name, base in (("high", 0), ("low", 64)):
            a, b = max(lo, base) - base, min(hi, base + 64) - base
            if a < b:
                part = F.shiftrightunsigned(F.shiftleft(F.col(name), a), 64 - (b - a))
                value = F.shiftleft(value, b - a).bitwiseOR(part)
        return value

    def rows(t: int):
        loose = radius // blocks - (t > radius % blocks) if probe else 0
        width = edges[t + 1] - edges[t]
        flips = [sum(1 << bit for bit in bits) for n in range(loose + 1) for bits in combinations(range(width), n)]
        masks = F.from_json(F.lit(str(flips)), "array<bigint>")
        return F.transform(masks, lambda mask: F.struct(F.lit(t).alias("table"), block(t).bitwiseXOR(mask).alias("key")))

    tables = F.concat(*[rows(t) for t in range(blocks)])
    return df.select("*", F.explode(tables).alias("_t")).select(*df.columns, "_t.table", "_t.key")


def halves(fingerprint: str):
    return [F.conv(F.substring(fingerprint, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "high"), (17, "low"))]


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``fingerprint, near``: how many rows of ``prints`` lie within ``radius`` bits of each distinct fingerprint of
    ``queries`` (rows with the same fingerprint included). Equal fingerprints are counted once and carried as a number, so a
    group of copies is one row; a pair that meets in several tables is counted once."""
    mine = queries.select("fingerprint").distinct().select(*halves("fingerprint"))
    all_prints = prints.groupBy("fingerprint").agg(F.count("*").alias("rows")).select("rows", *halves("fingerprint"))
    left = block_tables(mine, blocks, radius, probe=True)
    right = block_tables(all_prints, blocks, radius).select("rows", F.col("high").alias("h2"), F.col("low").alias("l2"), F.col("table").alias("t2"), F.col("key").alias("k2"))
    apart = F.bit_count(F.col("high").bitwiseXOR(F.col("h2"))) + F.bit_count(F.col("low").bitwiseXOR(F.col("l2")))
    # merged: the probes look as small as the queries to the planner, which would broadcast them
    pairs = left.join(right.hint("merge"), (F.col("table") == F.col("t2")) & (F.col("key") == F.col("k2")) & (apart <= radius))
    pairs = pairs.groupBy("high", "low", "h2", "l2").agg(F.first("rows").alias("rows"))
    found = pairs.groupBy("high", "low").agg(F.sum("rows").alias("near"))
    return found.select(F.lower(F.concat(*[F.lpad(F.hex(half), 16, "0") for half in ("high", "low")])).alias("fingerprint"), "near")


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per document.

    The edited text is the text with its last ``n_chars // 2`` code points replaced by as many (or all) of the next
    document's. Null texts count as empty; an empty text has a fingerprint of zeros; repeated rows and rows with one
    id are ordered by text, null ids come last; one document is its own next; an empty table gives no rows.
    """

    def use(ids: list, mine: list, following: list) -> dict:
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(mine, following)]
        own, changed = (fingerprints(pa.array(x, pa.large_string())) for x in (mine, edited))
        other = [k for k in range(len(mine)) if k + 1 == len(mine) or following[k] is not mine[k + 1]]
        after = np.roll(own, -1, axis=0)
        after[other] = fingerprints(pa.array([following[k] for k in other], pa.large_string()))
        return {
            "doc_id": pa.array(ids, pa.int64()),
            "n_chars": pa.array([len(t) for t in mine], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": [x.tobytes().hex() for x in own],
            "edited_fingerprint": [x.tobytes().hex() for x in changed],
            "near_edited": likeness(own, changed),
            "near_next": likeness(own, after),
        }

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(texts(docs), use, schema)


def fingerprint_documents(docs: DataFrame, every: int = 100) -> DataFrame:
    """``fingerprint_table`` and, for documents whose id is divisible by ``every``, ``near_rows``: how many other rows
    of the whole table have a fingerprint within the radius (null for the rest)."""
    n = shuffle_partitions(docs)
    few = max(min(n, 8), n // 8)  # a fingerprint is less than a tenth of its text: not a file for each range of texts
    with bytes_per_batch(docs.sparkSession, BATCH_BYTES):
        table = write_once(fingerprint_table(docs).repartition(few))
    is_query = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    asked, rest = table.filter(is_query), table.filter(~is_query)
    near = within_radius(asked, table).select("fingerprint", (F.col("near") - 1).alias("near_rows"))
    asked = asked.join(near, "fingerprint", "left").select(*table.columns, "near_rows").coalesce(few)
    return asked.unionByName(rest.withColumn("near_rows", F.lit(None).cast("long")))
