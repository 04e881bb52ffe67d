"""Phrase collocations: frequent phrases counted with broadcast double-array tries, scored at their weakest cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import rows_per_batch, write_once

LEAST = 100
LONGEST = 5
TOP = 2000
#: Bytes of text of a slice, and slices of an Arrow batch.
SLICE_BYTES, SLICES_PER_BATCH = 1 << 20, 4
#: Digests or phrases of an Arrow batch, which are small rows.
SMALL_PER_BATCH = 1 << 13
#: Bits of the table that says which digests may be frequent: half a megabyte for any corpus.
FILTER_BITS = 22
#: Bits of the table that says which places slices keep behind a length: two megabytes for any corpus.
NARROW_BITS = 24
#: Different words of a task that are counted in Python before they go to the JVM.
HELD_WORDS = 1 << 19
#: Digests, and words of the phrases of one trie, that are broadcast at a time; more of them take more passes.
DIGEST_BLOCK, TRIE_BLOCK = 1 << 19, 1 << 19
#: Word numbers of narrowed slices that a task puts together into rows, one for each language.
MERGED = 1 << 20
#: Words of a corpus for each range of digests, bits of the least number of ranges, and places of which a task adds up digests at a time.
RANGE_WORDS, RANGE_BITS, HELD = 1 << 22, 6, 1 << 22
#: Bytes of packed digests of an Arrow batch, one range at least.
PACKED_BYTES = 1 << 20
#: Slices are rows of hundreds of kilobytes. Parquet's writer looks at a page's size every 100 rows at first, which made pages and row groups of a whole
#: file, and both are buffered whole by whoever writes or reads them (pages off the heap, where Snappy works).
LARGE_ROWS = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4, "parquet.block.size": 8 << 20}
#: Phrases of one vector of counts: a task's vectors of one range of phrases are added up in one place, 4 KB of each task.
COUNTERS = 512

_SPLIT = np.zeros(256, bool)
_SPLIT[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP = _SPLIT.copy()
_GAP[[9, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
SLICES = "lang string, n long, words array<string>, hashes binary, codes binary"
#: The same with the words in one value, a space behind each (no word has one): the JVM handles a value, not every string.
JOINED = SLICES.replace("array<string>", "binary")


def _renumbered(codes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers of ``codes`` in order, and the codes as places among them; -1 stays."""
    used = np.zeros(words + 1, bool)
    used[codes] = True
    used[-1] = False
    place = np.cumsum(used, dtype=np.int32) - np.int32(1)
    place[-1] = -1
    return np.flatnonzero(used), place[codes]


def _join(terms: pa.Array) -> bytes:
    closed = pa.concat_arrays([terms.cast(pa.string()), pa.array([""])])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(closed)], pa.int32()), closed), " ")[0].as_buffer().to_pybytes()


def _split(joined: pa.Buffer) -> pa.Array:
    """The words that ``_join`` joined."""
    raw = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(raw == 32)
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends - np.arange(len(ends))
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(raw[raw != 32]))


def slices_of(docs: DataFrame, joined: bool = False) -> DataFrame:
    """``SLICES`` (or ``JOINED``): of each stretch of texts that a task reads at a time and each of its languages the different words, their
    hashes, and the words in order as numbers (32 bits), -1 between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, offsets in words.slices(batch.column("text"), SLICE_BYTES):
                named = batch.column("lang").slice(first, len(offsets) - 1).dictionary_encode()
                starts, ends, firsts = words.bounds(raw, offsets, _GAP)
                if not len(starts):
                    continue
                codes, terms, hashes = words.distinct_words(raw, starts, ends, _GAP)
                opens = np.zeros(len(starts) + 1, bool)
                opens[np.searchsorted(starts, np.flatnonzero(_SPLIT[raw]))] = True  # the word behind each end of a piece
                opens[firsts[:-1][np.diff(firsts) > 0]] = True
                lang = np.repeat(named.indices.to_numpy(), np.diff(firsts))
                for k in np.unique(lang):
                    own = np.flatnonzero(lang == k)
                    kinds, numbers = _renumbered(codes[own], len(terms))
                    own_terms = terms.take(pa.array(kinds))
                    at = np.flatnonzero(opens[own])
                    row = [
                        pa.array([named.dictionary[int(k)].as_py()], pa.string()),
                        pa.array([len(own)], pa.int64()),
                        pa.array([_join(own_terms)], pa.binary()) if joined else pa.ListArray.from_arrays(pa.array([0, len(kinds)], pa.int32()), own_terms.cast(pa.string())),
                        pa.array([hashes[kinds].tobytes()], pa.binary()),
                        pa.array([np.insert(numbers.astype(np.int32), at, -1).tobytes()], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(row, ["lang", "n", "words", "hashes", "codes"])

    own = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(run, JOINED if joined else SLICES)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of ``SLICES`` or ``JOINED``, with numpy arrays for their binary columns and an Arrow array of words."""
    kinds = {"hashes": np.uint64, "codes": np.int32}
    for batch in batches:
        for row in range(batch.num_rows):
            out = {}
            for name in batch.schema.names:
                value = batch.column(name)[row]
                if name == "words":
                    out[name] = _split(value.as_buffer()) if pa.types.is_binary(value.type) else value.values
                else:
                    out[name] = np.frombuffer(value.as_buffer(), kinds[name]) if name in kinds else value.as_py()
            yield out


def _lang_seed(lang: str) -> np.uint64:
    raw = np.frombuffer(lang.encode() or b"\0", np.uint8)
    return words.word_hashes(raw, np.array([0]), np.array([len(raw)]), lower=False)[0]


def _digests(lang: str, hashes: np.ndarray, codes: np.ndarray, size: int) -> np.ndarray:
    """A digest for each place of ``codes`` of the phrase of ``size`` words that begins there; what it is across a break or the end has no meaning."""
    padded = np.concatenate([np.append(hashes, np.uint64(0))[codes], np.zeros(size, np.uint64)])
    out = np.full(len(codes), _lang_seed(lang) + np.uint64(size), np.uint64)
    for k in range(size):
        out = words.mix(out * _ODD + padded[k : k + len(codes)])
    return out


def _whole(codes: np.ndarray, size: int) -> np.ndarray:
    """True where a phrase of ``size`` words begins."""
    out = np.zeros(len(codes), bool)
    broken = np.concatenate([[0], np.cumsum(codes < 0)])
    out[: max(0, len(codes) - size + 1)] = broken[size:] == broken[: len(codes) - size + 1] if len(codes) >= size else False
    return out


def _candidates_at(one: dict, frequent: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and digests (``bits`` leading bits) of the phrases of ``size`` words both of whose parts of ``size - 1`` words may be frequent."""
    shorter = _digests(one["lang"], one["hashes"], one["codes"], size - 1) >> np.uint64(64 - FILTER_BITS)
    may = np.append(frequent[shorter], False)
    at = np.flatnonzero(_whole(one["codes"], size) & may[:-1] & may[1:])
    return at, _digests(one["lang"], one["hashes"], one["codes"], size)[at] >> np.uint64(64 - bits)


def _range_bits(slices: DataFrame) -> int:
    """Ranges of digests, as a power of two: as many as keep the digests of one range bounded, however long the corpus."""
    return min(31, max(RANGE_BITS, ((slices.agg(F.sum("n")).first()[0] or 0) // RANGE_WORDS).bit_length()))


def _packed(digests: list[np.ndarray], least: int) -> pa.RecordBatch:
    """``part, digests, counts``: of each range of digests the last 32 bits of the different ones in order, and how often each occurs, ``least`` at most."""
    found, n = np.unique(np.concatenate(digests), return_counts=True)
    parts = (found >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(parts, prepend=-1))
    cuts = np.append(first, len(found)).astype(np.int32)
    counts = np.minimum(n, least).astype(np.min_scalar_type(least))
    columns = [pa.array(parts[first], pa.int32())]
    for values in (found.astype(np.uint32), counts):
        columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts * np.int32(values.itemsize)), pa.py_buffer(values)]))
    return pa.RecordBatch.from_arrays(columns, ["part", "digests", "counts"])


def _in_batches(packed: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``PACKED_BYTES``, since the JVM holds a batch whole, off its heap."""
    rows = max(1, packed.num_rows * PACKED_BYTES // max(1, packed.nbytes))
    for first in range(0, packed.num_rows, rows):
        yield packed.slice(first, rows)


def _digest_adder(least: int):
    """The digests of one range whose counts sum to ``least``."""

    def add(rows: pa.Table) -> pa.Table:
        kinds = {"digests": np.uint32, "counts": np.min_scalar_type(least)}
        digests, counts = (np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in rows[name]]) for name, kind in kinds.items())
        both = np.sort(digests.astype(np.uint64) << np.uint64(32) | counts)
        first = np.flatnonzero(np.diff(both >> np.uint64(32), prepend=~both[:1] >> np.uint64(32)))
        often = np.add.reduceat(both & np.uint64(0xFFFFFFFF), first) >= least
        found = both[first[often]] >> np.uint64(32) | np.uint64(rows["part"][0].as_py()) << np.uint64(32)
        return pa.table({"digest": found.view(np.int64)})

    return add


def _spelled(slices: Iterator[dict], frequent: np.ndarray, wanted: np.ndarray, size: int, bits: int) -> Iterator[pa.RecordBatch]:
    """``lang, words`` of the phrases with a digest in ``wanted`` (ascending), each once for all ``slices``, not once a slice. Phrases are told apart by
    language and word hashes, so that of several with one digest none is lost; those may come again."""
    told = np.zeros((len(wanted), size + 1), np.uint64)
    for one in slices:
        at, digest = _candidates_at(one, frequent, size, bits)
        place = np.minimum(np.searchsorted(wanted, digest), len(wanted) - 1)
        hit = wanted[place] == digest
        at, place = at[hit], place[hit]
        spelling = one["codes"][at[:, None] + np.arange(size)]
        said = np.concatenate([np.full((len(at), 1), _lang_seed(one["lang"])), one["hashes"][spelling]], axis=1)
        new = np.flatnonzero((told[place] != said).any(axis=1))
        if not len(new):
            continue
        order = new[np.lexsort(said[new].T)]
        order = order[np.append(True, (said[order[1:]] != said[order[:-1]]).any(axis=1))]
        told[place[order]] = said[order]
        flat = one["words"].take(pa.array(spelling[order].ravel()))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1) * size, pa.int32()), flat.cast(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([one["lang"]] * len(order), pa.string()), lists], ["lang", "words"])


class DoubleArray:
    """Paths of symbols (0, 1, ...) as a double-array trie: from a state ``s`` symbol ``c`` leads to ``t = base[s] + c`` if ``check[t] == s``.

    A symbol is two digits, so a state has at most about the root of the number of symbols as children. The states of
    one depth are placed together: those with many children one behind the other, the others at random places of a
    free stretch, all of them at once, again and again until none is left.
    """

    DENSE = 12

    def __init__(self, paths: np.ndarray, symbols: int):
        self.radix = max(2, int(np.ceil(np.sqrt(symbols + 1))))
        digits = np.stack([paths // self.radix, paths % self.radix], axis=2).reshape(len(paths), -1)
        self.depth = digits.shape[1]
        self.base, self.check = np.zeros(1, np.int32), np.full(1, -1, np.int32)
        order = np.lexsort(digits.T[::-1])
        digits = digits[order]
        state = np.zeros(len(paths), np.int64)  # of each path, at the depth reached
        rng = np.random.default_rng(1)
        for d in range(self.depth):
            new = np.ones(len(paths), bool)
            new[1:] = (state[1:] != state[:-1]) | (digits[1:, d] != digits[:-1, d])
            child = np.cumsum(new) - 1
            state = self._place(state[new], digits[new, d], rng)[child] if len(paths) else state
        self.last = np.full(len(self.base), -1, np.int32)  # the path that ends in a state
        self.last[state] = order

    def _place(self, parents: np.ndarray, digits: np.ndarray, rng) -> np.ndarray:
        """Slots for the children ``digits`` of ``parents``; children of one parent lie together."""
        opened = np.ones(len(parents), bool)
        opened[1:] = parents[1:] != parents[:-1]
        first = np.flatnonzero(opened)
        owner, many = np.cumsum(opened) - 1, np.diff(np.append(first, len(parents)))
        base = np.zeros(len(first), np.int64)
        at = len(self.base)
        dense = many >= self.DENSE
        last = digits[np.append(first[1:], len(digits)) - 1]
        span = np.where(dense, last - digits[first] + 1, 0)
        starts = at + np.cumsum(span) - span
        base[dense] = (starts - digits[first])[dense]
        at += int(span.sum())
        room = 6 * int(many[~dense].sum()) + self.radix + 1
        used = np.zeros(room + self.radix, bool)
        left = np.flatnonzero(~dense[owner])
        while len(left):
            own, where = np.unique(owner[left], return_inverse=True)
            tried = rng.integers(0, room, len(own))
            slot = tried[where] + digits[left]
            clash = used[slot]
            seen = np.argsort(slot, kind="stable")
            again = np.zeros(len(slot), bool)
            again[seen[1:]] = slot[seen[1:]] == slot[seen[:-1]]
            clash |= again
            bad = np.bincount(where, clash, minlength=len(own)) > 0
            good = ~bad[where]
            used[slot[good]] = True
            base[own[~bad]] = at + tried[~bad]
            left = left[~good]
        size = at + (room + self.radix if (~dense).any() else 0)
        grown = size - len(self.base)
        self.base = np.concatenate([self.base, np.zeros(grown, np.int32)])
        self.check = np.concatenate([self.check, np.full(grown, -1, np.int32)])
        self.base[parents] = base[owner]
        slots = base[owner] + digits
        self.check[slots] = parents
        return slots

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states that symbols lead to, and the numbers of those places that have one."""
        alive = np.arange(len(states))
        for digit in (symbols // self.radix, symbols % self.radix):
            to = self.base[states] + digit[alive]
            to = np.where(to < len(self.check), to, 0)
            on = self.check[to] == states
            alive, states = alive[on], to[on].astype(np.int32)
        return states, alive


def _trie(candidates: pa.Table) -> tuple[DoubleArray, Symbols, np.ndarray]:
    """``(double array, languages and words by symbol, ids by path)`` of candidates ``id, lang, words``. A language is the first symbol of
    its phrases, spelled with a space in front, which no word has."""
    size = len(candidates["words"][0])
    flat = pc.list_flatten(candidates["words"].combine_chunks())
    langs = pc.binary_join_element_wise("", candidates["lang"].combine_chunks(), " ").cast(flat.type)
    coded = pa.concat_arrays([langs, flat]).dictionary_encode()
    numbers = coded.indices.to_numpy()
    paths = np.concatenate([numbers[: len(langs), None], numbers[len(langs) :].reshape(-1, size)], axis=1).astype(np.int64)
    return DoubleArray(paths, len(coded.dictionary)), Symbols(coded.dictionary, paths), candidates["id"].to_numpy()


class Symbols:
    """The symbols of a trie: found by the hashes that slices hold of their words, compared as strings."""

    def __init__(self, spelled: pa.Array, paths: np.ndarray):
        self.spelled = spelled
        self.opens = np.zeros(len(spelled) + 1, bool)  # the first words of phrases
        self.opens[paths[:, 1]] = True
        lang = np.zeros(len(spelled), bool)
        lang[paths[:, 0]] = True
        self.langs = dict(zip(spelled.filter(pa.array(lang)).to_pylist(), np.flatnonzero(lang).tolist(), strict=True))
        own = np.flatnonzero(~lang)
        raw = np.frombuffer(_join(spelled.take(pa.array(own))), np.uint8)
        ends = np.flatnonzero(raw == 32)
        hashes = words.word_hashes(raw, np.append(0, ends + 1)[: len(ends)], ends)
        order = np.argsort(hashes)
        self.hashes, self.of_hash = hashes[order], own[order]
        self.told = bool((self.hashes[1:] != self.hashes[:-1]).all())

    def of(self, one: dict) -> np.ndarray:
        """The symbol of each word of a slice, -1 where it has none."""
        if not self.told:  # two words of one hash
            return pc.index_in(one["words"], value_set=self.spelled).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        found = self.of_hash[np.minimum(np.searchsorted(self.hashes, one["hashes"]), len(self.hashes) - 1)]
        same = pc.equal(self.spelled.take(pa.array(found)), one["words"].cast(self.spelled.type))
        return np.where(same.to_numpy(zero_copy_only=False), found, -1)


def _add_counts(trie: DoubleArray, symbols: Symbols, one: dict, sums: np.ndarray) -> None:
    """Add to ``sums`` how often each path of the trie occurs in a slice: all places advance together, a word at a time."""
    lang = symbols.langs.get(" " + one["lang"])
    if lang is None:
        return
    sign = np.append(symbols.of(one), -1)[one["codes"]]
    at = np.flatnonzero(symbols.opens[sign])
    start, _ = trie.step(np.zeros(1, np.int32), np.array([lang]))
    states = np.repeat(start, len(at))
    for k in range(trie.depth // 2 - 1):
        inside = at + k < len(sign)
        at, states = at[inside], states[inside]
        known = sign[at + k] >= 0
        at, states = at[known], states[known]
        states, alive = trie.step(states, sign[at + k])
        at = at[alive]
    np.add(sums, np.bincount(trie.last[states], minlength=len(sums)), out=sums)


def _small_rows(df: DataFrame) -> pa.Table:
    """The small rows of ``df``, not in batches for slices."""
    with rows_per_batch(df.sparkSession, SMALL_PER_BATCH):
        return df.toArrow()


def _blocks(df: DataFrame, rows: int, *key: Column | str) -> Iterator[DataFrame]:
    """The rows of ``df``, a written table, in blocks of about ``rows`` at most, dealt by a hash of ``key``."""
    total = df.count()
    blocks = -(-total * 5 // (4 * rows)) if total > rows else 1
    for k in range(blocks if total else 0):
        yield df.filter(F.pmod(F.xxhash64(F.lit(11), *key), F.lit(blocks)) == k) if blocks > 1 else df


def _few_tasks(slices: DataFrame) -> DataFrame:
    """The same rows in as many tasks as there are cores: passes that return something per task and phrase return less of it."""
    return slices.coalesce(max(1, slices.sparkSession.sparkContext.defaultParallelism))


def _adder(shared):
    """Adds up the vectors of one range of phrases."""

    def add(rows):
        sums = sum(np.frombuffer(v.as_buffer(), np.int64) for v in rows["counts"])
        met = np.flatnonzero(sums)
        return pa.table({"id": shared.value[2][rows["part"][0].as_py() * COUNTERS + met], "f": sums[met]})

    return add


def count_candidates(slices: DataFrame, candidates: DataFrame, block: int = TRIE_BLOCK // LONGEST) -> DataFrame:
    """``id, f``: exact occurrences of the written ``candidates`` (``id, lang, words``) in ``slices``. A block of candidates at a time comes to
    the driver, becomes a trie and is broadcast; a task returns its counts as vectors of ``COUNTERS`` phrases, which are added up. Phrases of one first
    word share a block, so that a pass begins only at its own words; those of a word that has many are spread."""
    counted, first = None, F.get("words", F.lit(0))
    most = candidates.groupBy("lang", first).count().agg(F.max("count")).first()[0] or 0
    for part in _blocks(candidates, block, "lang", first, F.pmod(F.xxhash64("words"), F.lit(1 + 8 * most // block))):
        shared = candidates.sparkSession.sparkContext.broadcast(_trie(_small_rows(part.select("id", "lang", "words"))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie, symbols, ids = shared.value
            sums = np.zeros(-(-len(ids) // COUNTERS) * COUNTERS, np.int64)
            for one in _slices(batches):
                _add_counts(trie, symbols, one, sums)
            vectors = sums.reshape(-1, COUNTERS)
            met = np.flatnonzero(vectors.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array([v.tobytes() for v in vectors[met]], pa.binary())], ["part", "counts"])

        vectors = _few_tasks(slices).select("lang", "words", "hashes", "codes").mapInArrow(run, "part int, counts binary")
        found = vectors.groupBy("part").applyInArrow(_adder(shared), "id long, f long")
        counted = found if counted is None else counted.unionByName(found)
    return counted


def _summed(held: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(held).group_by(["lang", "word"]).aggregate([("f", "sum")]).rename_columns(["lang", "word", "f"])


def _word_counts(slices: DataFrame) -> DataFrame:
    """``lang, word, f``; a task adds up its slices' counts as long as the different words are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for one in _slices(batches):
            n = np.bincount(one["codes"][one["codes"] >= 0], minlength=len(one["words"]))
            held.append(pa.table([pa.array([one["lang"]] * len(n), pa.string()), one["words"].cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "f"]))
            rows += len(n)
            if rows >= HELD_WORDS:
                held = [_summed(held)]
                rows = len(held[0])
                if rows >= HELD_WORDS // 2:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from _summed(held).to_batches()

    found = slices.select("lang", "words", "codes").mapInArrow(run, "lang string, word string, f long")
    return found.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _frequent_table(phrases: DataFrame) -> np.ndarray:
    """A table of 2 ** ``FILTER_BITS`` flags, set where a digest of one of ``phrases`` (``lang, words``) falls: of one size, however many phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                lists = batch.column("words").filter(pc.equal(batch.column("lang"), lang))
                size = len(lists[0])
                flat = lists.flatten()
                joined = np.frombuffer("".join(x + " " for x in flat.to_pylist()).encode(), np.uint8)
                starts, ends, _ = words.bounds(joined, np.array([0, len(joined)]), _GAP)
                hashes = words.word_hashes(joined, starts, ends)
                digests = _digests(lang, hashes, np.arange(len(hashes), dtype=np.int32), size)[::size]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(digests >> np.uint64(64 - FILTER_BITS)).astype(np.int32))], ["at"])

    out = np.zeros(1 << FILTER_BITS, bool)
    out[_small_rows(phrases.select("lang", "words").mapInArrow(run, "at int").distinct())["at"].to_numpy()] = True
    return out


def _narrow(one: dict, at: np.ndarray, size: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """``(codes, words, hashes)`` of a slice without the words that no phrase of ``size`` words beginning at one of the places ``at`` holds."""
    codes = one["codes"]
    covered = np.zeros(len(codes) + 1, np.int32)
    covered[at] += 1
    covered[at + size] -= 1
    kept = np.cumsum(covered[:-1]) > 0
    opens = np.flatnonzero(kept[1:] & ~kept[:-1]) + 1
    kinds, numbers = _renumbered(codes[kept], len(one["words"]))
    before = np.cumsum(kept)[opens - 1]
    return np.insert(numbers, before, -1), one["words"].take(pa.array(kinds)), one["hashes"][kinds]


def _merged(lang: str, parts: list[tuple[np.ndarray, pa.Array, np.ndarray]]) -> pa.RecordBatch:
    """A row of ``JOINED`` of several parts of one language, with a break between them."""
    named = pa.concat_arrays([terms for _, terms, _ in parts]).dictionary_encode()
    place = named.indices.to_numpy()
    hashes = np.zeros(len(named.dictionary), np.uint64)
    hashes[place] = np.concatenate([x for _, _, x in parts])
    codes, first = [], 0
    for own, terms, _ in parts:
        codes.append(np.append(np.append(place[first : first + len(terms)], np.int32(-1))[own], np.int32(-1)))
        first += len(terms)
    codes = np.concatenate(codes)[:-1].astype(np.int32)
    row = [pa.array([lang], pa.string()), pa.array([int((codes >= 0).sum())], pa.int64())]
    row += [pa.array([value], pa.binary()) for value in (_join(named.dictionary), hashes.tobytes(), codes.tobytes())]
    return pa.RecordBatch.from_arrays(row, ["lang", "n", "words", "hashes", "codes"])


def _frequent_digests(slices: DataFrame, frequent, size: int, least: int, bits: int) -> DataFrame:
    """``digest``, written: the digests whose occurrences sum to ``least``, of phrases of ``size`` words whose parts may be ``frequent``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(frequent.value).astype(bool)
        held, places = [], 0
        for one in _slices(batches):
            held.append(_candidates_at(one, table, size, bits)[1])
            places += len(held[-1])
            if places >= HELD:
                yield from _in_batches(_packed(held, least))
                held, places = [], 0
        if places:
            yield from _in_batches(_packed(held, least))

    packed = slices.select("lang", "hashes", "codes").mapInArrow(sums, "part int, digests binary, counts binary")
    return write_once(packed.groupBy("part").applyInArrow(_digest_adder(least), "digest long"))


def _narrowed(slices: DataFrame, frequent, digests: DataFrame, size: int, bits: int) -> DataFrame:
    """``JOINED``, written: the slices without what no phrase of ``size`` words with one of the ``digests`` holds, told by a table of fixed size that errs on
    the safe side. Every such phrase, and every longer one made of them, stands there as often as before."""
    flags = np.zeros(1 << NARROW_BITS, bool)
    flags[_small_rows(digests.select(F.shiftrightunsigned("digest", bits - NARROW_BITS).cast("int").alias("at")).distinct())["at"].to_numpy()] = True
    wanted = slices.sparkSession.sparkContext.broadcast(np.packbits(flags))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, few = np.unpackbits(frequent.value).astype(bool), np.unpackbits(wanted.value).astype(bool)
        held, places = {}, 0
        for one in _slices(batches):
            at, digest = _candidates_at(one, table, size, bits)
            at = at[few[digest >> np.uint64(bits - NARROW_BITS)]]
            if not len(at):
                continue
            part = _narrow(one, at, size)
            held.setdefault(one["lang"], []).append(part)
            places += len(part[0])
            if places >= MERGED:
                yield from (_merged(*x) for x in held.items())
                held, places = {}, 0
        yield from (_merged(*x) for x in held.items())

    return write_once(slices.mapInArrow(run, JOINED), **LARGE_ROWS)


def _candidates(slices: DataFrame, shorter: DataFrame, size: int, least: int, block: int, range_bits: int) -> tuple[DataFrame, DataFrame]:
    """``(candidates, narrowed)``: as ``candidates_of``, and the slices narrowed to them."""
    context, bits = slices.sparkSession.sparkContext, 32 + range_bits
    frequent = context.broadcast(np.packbits(_frequent_table(shorter)))
    digests = _frequent_digests(slices, frequent, size, least, bits)
    slices = _narrowed(slices, frequent, digests, size, bits)
    found = None
    for part in _blocks(digests, block, "digest"):
        wanted = context.broadcast(np.sort(_small_rows(part)["digest"].to_numpy().view(np.uint64)))

        def spell(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            table = np.unpackbits(frequent.value).astype(bool)
            yield from _spelled(_slices(batches), table, wanted.value, size, bits)

        own = _few_tasks(slices).select("lang", "words", "hashes", "codes").mapInArrow(spell, "lang string, words array<string>").distinct()
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = shorter.select("lang", "words").limit(0)
    return write_once(found.withColumn("id", F.monotonically_increasing_id())), slices


def candidates_of(slices: DataFrame, shorter: DataFrame, size: int, least: int, block: int = DIGEST_BLOCK, range_bits: int = RANGE_BITS) -> DataFrame:
    """``id, lang, words``, written: phrases of ``size`` words that may occur ``least`` times.

    A phrase is no candidate if one of its two parts of ``size - 1`` words is not among ``shorter``, told by a table of fixed size
    that errs on the safe side, or if the occurrences of its digest don't sum to ``least``. Only digests are shuffled for that, in
    ``2 ** range_bits`` ranges of sorted 32-bit rests: equal digests of several phrases err on the safe side too. The words of those left are read off
    the slices, narrowed to them, a block of digests at a time.
    """
    return _candidates(slices, shorter, size, least, block, range_bits)[0]


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``(phrases, totals)``: ``lang, words, f`` of all phrases of up to ``longest`` words that occur ``least`` times, single words included, and
    ``lang, n`` with the number of all words."""
    slices = write_once(slices_of(docs, joined=True), **LARGE_ROWS)
    totals = slices.groupBy("lang").agg(F.sum("n").alias("n"))
    with rows_per_batch(docs.sparkSession, SLICES_PER_BATCH):
        return _levels(slices, least, longest), totals


def _levels(slices: DataFrame, least: int, longest: int) -> DataFrame:
    range_bits = _range_bits(slices)
    level = write_once(_word_counts(slices).filter(F.col("f") >= least).select("lang", F.array("word").alias("words"), "f"))
    levels = [level]
    for size in range(2, longest + 1):
        candidates, slices = _candidates(slices, levels[-1], size, least, DIGEST_BLOCK, range_bits)
        if candidates.isEmpty():
            break
        counted = count_candidates(slices, candidates, TRIE_BLOCK // size).filter(F.col("f") >= least)
        levels.append(write_once(candidates.join(counted.hint("merge"), "id").select("lang", "words", "f")))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def _decimal(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of two to ``longest`` words of each language by ``floor(1000 * a * n / (l * r))`` at their
    weakest cut (of equal scores the first), then by count and phrase.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends and into words at spaces and tabs. A candidate
    is left out if a longer one holds it and occurs as often. Since a longer phrase that occurs as often holds one of one word
    more that does, only those are looked at.

    The text is read once and becomes slices of word numbers; each length then takes passes over them: digests are
    summed to find what may be frequent, and tries of a bounded number of phrases are broadcast and counted in numpy, a row per
    task and phrase. Counts are exact; phrases of one digest are all counted. Scores are decimals of 38 digits.

    A null language is ``und``, a null text empty; repeated rows count as often as they occur; an empty table gives no rows.
    """
    phrases, totals = frequent_phrases(docs, least, longest)
    long = phrases.filter(F.size("words") >= 2)
    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = long.select("lang", "words", F.col("f").alias("a"), cut)
    cuts = cuts.withColumns({"first": F.slice("words", F.lit(1), F.col("k")), "rest": F.slice("words", F.col("k") + 1, F.size("words"))})
    firsts = phrases.select("lang", F.col("words").alias("first"), F.col("f").alias("l"))
    rests = phrases.select("lang", F.col("words").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"]).join(totals, "lang")
    over = F.call_function("div", (F.col("a") * 1000).cast("decimal(20,0)") * _decimal("n"), _decimal("l") * _decimal("r"))
    weakest = F.min(F.struct(over.alias("score"), "k", "l", "r", "n")).alias("weakest")
    scored = scored.groupBy("lang", "words", "a").agg(weakest).select("lang", "words", "a", "weakest.*").drop("k")
    size = F.size("words")
    parts = F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words")
    held = long.filter(size >= 3).select("lang", parts, F.col("f").alias("longer")).groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    kept = scored.join(held, ["lang", "words"], "left").filter("longer IS NULL OR longer < a")
    kept = kept.withColumn("phrase", F.array_join("words", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])


_UP, _DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sql(least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> str:
    """The same in DuckDB SQL, over the table ``documents``."""
    return rf"""
WITH own AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UP}', '{_DOWN}') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM own),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM lists GROUP BY lang),
grams AS (
  SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*)::HUGEINT AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, range(1, {longest + 1}) AS ks(k))
  GROUP BY ALL HAVING count(*) >= {least}),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE k >= 2),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, j, l.f AS l, r.f AS r, t.n, 1000 * c.f * t.n // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
  JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : j], ' ')
  JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1 :], ' ')
  JOIN totals t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, j) = 1),
inner_parts AS (
  SELECT lang, f, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM cand, range(2, {longest}) AS ms(m) WHERE m < k)),
held AS (SELECT lang, phrase, max(f) AS longer FROM inner_parts GROUP BY ALL)
SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank, c.phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
       n::BIGINT AS n, score::BIGINT AS score
FROM cuts c LEFT JOIN held h ON h.lang = c.lang AND h.phrase = c.phrase WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) <= {top}"""


SQL = sql()
