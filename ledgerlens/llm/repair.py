"""Token-id files compressed by Re-Pair, with random access through expansion lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytebpe, words
from .common import scratch_path, shuffle_partitions, texts
from .pieces import model_path

MODEL = "byte_bpe_50k.json"
END = 0
SHARD_IDS = 1 << 20
#: Pairs that a round replaces at most, and how often a pair must occur. Rounds go on until no pair occurs so often.
PAIRS = 4096
LEAST = 8
SLOT_BITS = 18
SCHEMA = (
    "part int, shard int, before long, n_ids long, base int, doc_ids binary, doc_starts binary, rules binary, lengths binary, body binary"
)


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).view(np.int64)


def compress(ids: np.ndarray, base: int, pairs: int = PAIRS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(body, rules, lengths)``: ids with frequent pairs replaced by nonterminals ``base``, ``base + 1``, ...

    Each round counts all pairs of neighbours and takes the most frequent ones (at least ``least`` times, at most ``pairs`` of
    them) that cannot overlap: none ends with the symbol another one begins with. All their occurrences are replaced at once; of a
    run of one symbol every second pair. The last round is the one that finds no such pair. ``lengths`` says how many ids a nonterminal stands for.

    A round adds no pair of old symbols, so a pair that was too rare once stays so: a round looks only at the places whose pair was frequent in
    the round before or is new. Replaced symbols are unlinked from their neighbours and left out at the end.
    """
    n = len(ids)
    body = np.append(ids, 0).astype(np.int64)
    after, before = np.arange(1, n + 2), np.arange(-1, n)  # neighbours; ``n`` is the end
    rules, lengths = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    at = np.arange(n - 1)
    while len(at):
        keys = body.take(at) << 32 | body.take(after.take(at))
        ordered = np.sort(keys)
        edge = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
        starts = np.concatenate([[0], edge])
        counts = np.diff(np.append(starts, len(ordered)))
        many = counts >= least
        often, counts = ordered[starts[many]], counts[many]
        left, right, chosen = set(), set(), []
        for key in often[np.lexsort((often, -counts))[: 4 * pairs]].tolist():
            a, b = key >> 32, key & 0xFFFFFFFF
            if a in right or b in left:
                continue
            left.add(a)
            right.add(b)
            chosen.append(key)
            if len(chosen) == pairs:
                break
        if not chosen:
            break
        chosen = np.array(chosen, np.int64)
        slot = _slots(chosen)
        table = np.full(1 << SLOT_BITS, -2, np.int32)
        table[_slots(often)] = -1
        table[slot] = np.arange(len(chosen))
        chosen = chosen[table[slot] == np.arange(len(chosen))]  # of pairs with one slot the others wait for the next round
        table[_slots(chosen)] = np.arange(len(chosen))
        first = base + len(rules)
        new = np.stack([chosen >> 32, chosen & 0xFFFFFFFF], axis=1)
        spans = np.concatenate([np.ones(base, np.int64), lengths])
        rules, lengths = np.concatenate([rules, new]), np.concatenate([lengths, spans[new].sum(axis=1)])
        place = table.take(_slots(keys))
        live = np.zeros(n + 1, bool)
        live[at[place > -2]] = True
        hit = np.flatnonzero(place >= 0)
        hit = hit[chosen.take(place[hit]) == keys.take(hit)]
        at, place = at.take(hit), place.take(hit)
        doubled = np.flatnonzero((new[:, 0] == new[:, 1]).take(place))
        if len(doubled):
            # in a run of equal symbols the pairs overlap: take the first, third, ...
            own = at[doubled]
            run = np.ones(len(own), bool)
            run[1:] = own[1:] != after[own[:-1]]
            since = np.arange(len(own))
            since -= np.maximum.accumulate(np.where(run, since, 0))
            at, place = np.delete(at, doubled[since % 2 == 1]), np.delete(place, doubled[since % 2 == 1])
        second = after.take(at)
        third = after.take(second)
        body[at], body[second] = first + place, -1
        after[at], before[third] = third, at
        live[second] = False
        live[at] = live[before.take(at)] = True
        live[before[n]] = live[n] = False  # the last symbol begins no pair
        at = np.flatnonzero(live)
    return body[:n][body[:n] >= 0], rules, lengths


def _expansions(base: int, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All expansions one after another, and where each begins."""
    symbols, owner = base + np.arange(len(rules)), np.arange(len(rules))
    while True:
        deep = symbols >= base
        if not deep.any():
            return symbols, np.searchsorted(owner, np.arange(len(rules) + 1))
        at = np.repeat(np.arange(len(symbols)), np.where(deep, 2, 1))
        second = np.zeros(len(at), bool)
        second[1:] = at[1:] == at[:-1]
        wide, owner = symbols[at], owner[at]
        inner = deep[at]
        wide[inner] = rules[wide[inner] - base, second[inner].astype(np.int64)]
        symbols = wide


def expand(body: np.ndarray, base: int, rules: np.ndarray) -> np.ndarray:
    """The ids a body stands for."""
    if not len(rules):
        return body
    flat, starts = _expansions(base, rules)
    deep = body >= base
    size = np.ones(len(body), np.int64)
    size[deep] = np.diff(starts)[body[deep] - base]
    source = np.concatenate([flat, body[~deep]])
    begin = np.empty(len(body), np.int64)
    begin[deep] = starts[body[deep] - base]
    begin[~deep] = len(flat) + np.arange((~deep).sum())
    ends = np.cumsum(size)
    return source[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class Shard:
    """One shard as read from a file: ids of documents and ranges of ids, without expanding the rest."""

    def __init__(self, row):
        self.base = row["base"]
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.doc_starts = np.frombuffer(row["doc_starts"], "<i8")
        self.rules = np.frombuffer(row["rules"], "<u4").astype(np.int64).reshape(-1, 2)
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.body = np.frombuffer(row["body"], "<u4").astype(np.int64)
        size = np.ones(len(self.body), np.int64)
        deep = self.body >= self.base
        size[deep] = self.lengths[self.body[deep] - self.base]
        self.ends = np.cumsum(size)

    def all(self) -> np.ndarray:
        return expand(self.body, self.base, self.rules)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids ``a`` to ``b`` (excluded): only symbols that reach into the range are opened, and of those only the rules on
        the way to it."""
        if b <= a:
            return np.zeros(0, np.int64)
        first, last = np.searchsorted(self.ends, a, "right"), np.searchsorted(self.ends, b - 1, "right")
        at = int(self.ends[first - 1]) if first else 0
        stack, out = self.body[first : last + 1].tolist()[::-1], []
        while stack and at < b:
            symbol = stack.pop()
            size = 1 if symbol < self.base else int(self.lengths[symbol - self.base])
            if at + size <= a:
                at += size
            elif symbol < self.base:
                out.append(symbol)
                at += 1
            else:
                left, right = self.rules[symbol - self.base].tolist()
                stack += [right, left]
        return np.array(out, np.int64)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.doc_starts[k]), int(self.doc_starts[k + 1]))


def _shard_row(part: int, shard: int, before: int, doc_ids: list, pieces: list[np.ndarray], sizes: list[int], base: int) -> dict:
    ids = np.concatenate(pieces)
    body, rules, lengths = compress(ids, base)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return {
        "part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "before": pa.array([before], pa.int64()),
        "n_ids": pa.array([len(ids)], pa.int64()), "base": pa.array([base], pa.int32()),
        "doc_ids": [np.array(doc_ids, "<i8").tobytes()], "doc_starts": [starts.astype("<i8").tobytes()],
        "rules": [rules.astype("<u4").tobytes()], "lengths": [lengths.astype("<u4").tobytes()], "body": [body.astype("<u4").tobytes()],
    }


def write_ids(docs: DataFrame, path: str, model: str = MODEL, shard_ids: int = SHARD_IDS) -> None:
    """Encode all documents and write their ids, each document ended by id 0, to Parquet files of Re-Pair shards at ``path``.

    Documents are range-sorted by id (null ids last, of equal ids by text), one part per range, and cut into shards of
    about ``shard_ids`` ids, never inside a document. A row is a shard: part and number, the ids before it in its part,
    document ids (the largest long for null) and where each begins, rules as pairs, the length each rule expands to, and the compressed body, all as
    little-endian binary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bytebpe.load(model_path(model))
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        base = encoder.library.get_vocab_size()
        names, pieces, sizes, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, before, names, pieces, sizes, held
            row = pa.RecordBatch.from_pydict(_shard_row(part, shard, before, names, pieces, sizes, base))
            shard, before = shard + 1, before + held
            names, pieces, sizes, held = [], [], [], 0
            return row

        for batch in batches:
            doc_ids = batch.column("doc_id").fill_null((1 << 63) - 1).to_pylist()
            for first, raw, offsets in words.slices(batch.column("text")):
                ids, at = encoder.encode(raw, offsets)
                ended = np.insert(ids, at[1:], END)
                at = at + np.arange(len(at))
                for k in range(len(at) - 1):
                    size = int(at[k + 1] - at[k])
                    if held and held + size > shard_ids:
                        yield flush()
                    names.append(doc_ids[first + k])
                    pieces.append(ended[at[k] : at[k + 1]])
                    sizes.append(size)
                    held += size
        if names:
            yield flush()

    order = [F.asc_nulls_last("doc_id"), F.col("text")]
    ranged = texts(docs).repartitionByRange(shuffle_partitions(docs), order[0]).sortWithinPartitions(*order)
    ranged.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """``doc_id, start, ids`` of all documents from the files at ``path``; ``start`` counts the ids of all documents before."""

    def use(shard: Shard, offset: int) -> dict:
        return {"ids": pa.ListArray.from_arrays(pa.array(shard.doc_starts, pa.int32()), pa.array(shard.all().astype(np.int32)))}

    return _over_documents(spark, path, use, "ids array<int>")


def _over_documents(spark, path: str, use, more: str) -> DataFrame:
    shards = spark.read.schema(SCHEMA).parquet(path)
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = shards.join(F.broadcast(parts), "part")  # one row per range of ids, as many as shuffle partitions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                shard = Shard(one)
                ids = pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == (1 << 63) - 1)
                columns = {"doc_id": ids, "start": shard.doc_starts[:-1] + one["offset"] + one["before"], **use(shard, one["offset"])}
                yield pa.RecordBatch.from_pydict(columns)

    return placed.mapInArrow(run, f"doc_id long, start long, {more}")


def id_digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Write all ids, read the files back and return per document ``doc_id, start, n_tokens, ids_crc32``.

    Null texts count as empty and have the end id alone; null ids come last; repeated rows are written each; an
    empty table gives no rows.
    """

    def use(shard: Shard, offset: int) -> dict:
        flat = shard.all().astype("<u4")
        ends = shard.doc_starts
        crcs = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return {"n_tokens": np.diff(ends), "ids_crc32": pa.array(crcs, pa.int64())}

    path = scratch_path(docs.sparkSession, "ids")
    write_ids(docs, path, model)
    return _over_documents(docs.sparkSession, path, use, "n_tokens long, ids_crc32 long")
