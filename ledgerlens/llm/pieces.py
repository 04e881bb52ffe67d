"""SentencePiece encoding by batched Viterbi, and exact decoding."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words
from .common import texts

MODEL = "piece_bpe_32k.model"
SLICE_BYTES = 1 << 18
#: A unit of more characters is segmented alone, in stretches of as many ends.
LONG = 1 << 16
#: The escaped space of the piece format, and a stand-in for that character in a text.
SPACE, LITERAL = 0x2581, 0x110000
LINE_END = 10
#: A character without a piece costs this much more than the worst ordinary piece.
UNKNOWN_PENALTY = 10.0
#: Units whose pieces a task remembers before it starts anew.
REMEMBERED = 1 << 17


def model_path(name: str = MODEL) -> str:
    """The path of a tokenizer file: ``name`` itself if it has a folder, else the public file of that name."""
    if os.path.dirname(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _code_value(codes: np.ndarray) -> np.ndarray:
    return words.mix(codes.astype(np.uint64) + np.uint64(0x9E37))


class Pieces:
    """The pieces of a model: per length the sorted hashes of their code points with ids and scores, and bytes by id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary, byte_ids, spelled = [], {}, []
        for k in range(model.vocab_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                byte_ids[int(piece[3:5], 16)] = k
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                spelled.append(b"")
            else:
                ordinary.append((piece, k, model.get_score(k)))
                spelled.append(piece.replace(chr(SPACE), " ").encode())
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], np.int32)
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])
        self.worst = min(s for p, _, s in ordinary if set(p) != {chr(SPACE)}) - UNKNOWN_PENALTY
        #: A line end is a unit of its own if no longer piece has it; other pieces begin a unit only at a space.
        self.splits_lines = not any("\n" in p and len(p) > 1 for p, _, _ in ordinary)
        if any(chr(SPACE) in p.lstrip(chr(SPACE)) for p, _, _ in ordinary):
            raise ValueError("a piece goes on after a space; words cannot be encoded one by one")
        self.longest = max(len(p) for p, _, _ in ordinary)
        self.by_length: list = [None] * (self.longest + 1)
        for n in range(1, self.longest + 1):
            own = [(p, k, s) for p, k, s in ordinary if len(p) == n]
            if own:
                codes = np.array([[ord(c) for c in p] for p, _, _ in own])
                keys = (_code_value(codes) * words.powers(n)).sum(axis=1, dtype=np.uint64)
                order = np.argsort(keys)
                self.by_length[n] = (keys[order], np.array([k for _, k, _ in own], np.int32)[order], np.array([s for _, _, s in own])[order])

        self.forget()

    def forget(self) -> None:
        self.units = np.zeros(0, np.uint64)  # hashes of remembered units, ascending
        self.unit_at, self.unit_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.unit_ids = np.zeros(0, np.int32)

    def remember(self, units: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Places of ``units`` (ascending hashes) among the remembered ones, after encoding those that are new."""
        if len(self.units) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.units, units)
        new = np.ones(len(units), bool)
        new[at < len(self.units)] = self.units[at[at < len(self.units)]] != units[at < len(self.units)]
        new = np.flatnonzero(new)
        where, size = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        chunks, total = [self.unit_ids], len(self.unit_ids)
        for n in np.unique(lengths[new]):
            own = np.flatnonzero(lengths[new] == n)
            per = max(1, (1 << 17) // int(n))
            for a in range(0, len(own), per):
                part = own[a : a + per]
                ids, counts = self.viterbi(codes[starts[new[part]][:, None] + np.arange(n)])
                where[part] = total + np.cumsum(counts) - counts
                size[part] = counts
                chunks.append(ids)
                total += len(ids)
        self.unit_ids = np.concatenate(chunks)
        self.units = np.insert(self.units, at[new], units[new])
        self.unit_at = np.insert(self.unit_at, at[new], where)
        self.unit_size = np.insert(self.unit_size, at[new], size)
        return np.searchsorted(self.units, units)

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best pieces of units of one length, ``codes`` being (units, length): ids in order and how many each has.

        All units advance together. The hashes of all substrings probe the sorted keys of their length; at each end the best
        sum of scores wins, of equal sums the longest last piece. A character without a piece becomes its UTF-8 bytes.
        """
        rows, length = codes.shape
        sums = np.zeros((length + 1, rows), np.uint64)
        np.cumsum((_code_value(codes) * words.powers(length)).T, axis=0, out=sums[1:])
        back = words.powers(length + 1, True)[:, None]
        # by end, length of the last piece (the longest first) and unit
        gain = np.full((length, self.longest, rows), -np.inf)
        named = np.full((length, self.longest, rows), -1, np.int32)
        gain[:, -1] = self.worst
        for n in range(1, min(self.longest, length) + 1):
            if self.by_length[n] is None:
                continue
            keys, ids, scores = self.by_length[n]
            asked = (sums[n:] - sums[:-n]) * back[:-n]
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            hit = keys[at] == asked
            gain[n - 1 :, -n][hit] = scores[at[hit]]
            named[n - 1 :, -n][hit] = ids[at[hit]]
        best = np.full((length + 1 + self.longest, rows), -np.inf)  # of each end, after as many rows for ends before the start
        best[self.longest] = 0
        step = np.zeros((length + 1, rows), np.int32)
        unit = np.arange(rows)
        for end in range(1, length + 1):
            reached = best[end : end + self.longest] + gain[end - 1]
            choice = reached.argmax(axis=0)
            best[end + self.longest] = reached[choice, unit]
            step[end] = self.longest - choice
        piece = np.zeros((length + 1, rows), np.int32)
        piece[1:] = np.take_along_axis(named, (self.longest - step[1:])[:, None], axis=1)[:, 0]
        at, live, found = np.full(rows, length), np.arange(rows), []
        while len(live):
            found.append((live, at[live], piece[at[live], live]))
            at[live] -= step[at[live], live]
            live = live[at[live] > 0]
        row, end, ids = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((end, row))
        row, end, ids = row[order], end[order], ids[order]
        ids, repeats = self._with_bytes(ids, codes[row, end - 1])
        return ids, np.bincount(np.repeat(row, repeats), minlength=rows)

    def viterbi_long(self, codes: np.ndarray) -> np.ndarray:
        """Ids of one long unit, as ``viterbi`` finds them. What is kept for the whole unit is a byte per character, the length of
        the last piece; sums of scores are kept for the ends of one stretch, whose substrings are hashed anew."""
        length, width = len(codes), self.longest
        step = np.zeros(length + 1, np.uint8)
        best = [-np.inf] * width  # of the last ends, the newest last
        best[-1] = 0.0
        for first in range(0, length, LONG):
            last = min(first + LONG, length)
            gain = np.full((last - first, width), -np.inf)
            gain[:, -1] = self.worst
            for n, at, scores, _ in self._found(codes, first, last):
                gain[at, -n] = scores
            for k, own in enumerate(row for a in range(0, last - first, 4096) for row in gain[a : a + 4096].tolist()):
                chosen, size = -np.inf, 1
                for back in range(width):  # the longest first
                    reached = best[k + back] + own[back]
                    if reached > chosen:
                        chosen, size = reached, width - back
                best.append(chosen)
                step[first + k + 1] = size
            best = best[-width:]
        ends = np.zeros(length + 1, np.uint8)
        at, sizes = length, step.tobytes()
        while at:
            ends[at] = sizes[at]
            at -= sizes[at]
        out = []
        for first in range(0, length, LONG):
            last = min(first + LONG, length)
            named = np.full(last - first, -1, np.int32)
            for n, at, _, ids in self._found(codes, first, last):
                own = ends[first + 1 : last + 1][at] == n
                named[at[own]] = ids[own]
            used = np.flatnonzero(ends[first + 1 : last + 1])
            out.append(self._with_bytes(named[used], codes[first + used])[0])
        return np.concatenate(out)

    def _found(self, codes: np.ndarray, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """``(length, places, scores, ids)`` of the pieces that end behind the characters ``first`` to ``last`` (excluded), for each length of pieces."""
        begin = max(0, first - self.longest + 1)
        own = codes[begin:last]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_code_value(own) * words.powers(len(own)), dtype=np.uint64)])
        back = words.powers(len(own) + 1, True)
        for n in range(1, min(self.longest, len(own)) + 1):
            if self.by_length[n] is None:
                continue
            keys, ids, scores = self.by_length[n]
            asked = (sums[n:] - sums[:-n]) * back[: len(sums) - n]
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == asked)
            place = hit + n - 1 + begin - first  # the last character of the piece
            hit, place = hit[place >= 0], place[place >= 0]
            yield n, place, scores[at[hit]], ids[at[hit]]

    def _with_bytes(self, ids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` with the byte pieces of their character (``codes``) for those below 0, and how often each was repeated for that."""
        unknown = np.flatnonzero(ids < 0)
        repeats = np.ones(len(ids), np.int64)
        if len(unknown):
            bytes_of = [chr(SPACE if c == LITERAL else c).encode("utf-8", "surrogatepass") for c in codes[unknown].tolist()]
            repeats[unknown] = [len(b) for b in bytes_of]
            starts = np.cumsum(repeats) - repeats
            ids = np.repeat(ids, repeats)
            for u, b in zip(starts[unknown], bytes_of):
                ids[u : u + len(b)] = self.byte_ids[list(b)]
        return ids, repeats

    def _units(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units that begin at ``starts``, one after another, and how many each has."""
        length = np.diff(np.append(starts, len(codes)))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_code_value(codes) * words.powers(len(codes)), out=sums[1:])
        hashed = words.mix((sums[starts + length] - sums[starts]) * words.powers(len(codes), True)[starts] + length.astype(np.uint64))
        units, first, unit = np.unique(hashed, return_index=True, return_inverse=True)
        place = self.remember(units, starts[first], length[first], codes)
        where, size = self.unit_at[place], self.unit_size[place]
        counts = size[unit]
        ends = np.cumsum(counts)
        return self.unit_ids[np.repeat(where[unit] - (ends - counts), counts) + np.arange(ends[-1])], counts

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text (plus one) begins."""
        codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32)])[offsets]
        full = np.flatnonzero(np.diff(chars))
        codes = np.where(codes == SPACE, np.uint32(LITERAL), np.where(codes == 32, np.uint32(SPACE), codes))
        codes = np.insert(codes, chars[:-1][full], SPACE)  # every text that is not empty begins with a space
        begins = chars[:-1][full] + np.arange(len(full))
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        opened = codes == SPACE
        opened[1:] &= codes[:-1] != SPACE
        if self.splits_lines:
            ends = codes == LINE_END
            opened |= ends
            opened[1:] |= ends[:-1]
        opened[begins] = True
        starts = np.flatnonzero(opened)
        length = np.diff(np.append(starts, len(codes)))
        out, counts, at = [], np.zeros(len(starts), np.int64), 0
        # stretches of whole units: a long unit alone, the others together
        while at < len(starts):
            if length[at] > LONG:
                until = at + 1
                out.append(self.viterbi_long(codes[starts[at] : starts[at] + length[at]]))
                counts[at] = len(out[-1])
            else:
                until = int(np.searchsorted(starts, starts[at] + 4 * LONG, "right"))
                long = np.flatnonzero(length[at:until] > LONG)
                until = at + int(long[0]) if len(long) else until
                end = starts[until] if until < len(starts) else len(codes)
                ids, counts[at:until] = self._units(codes[starts[at] : end], starts[at:until] - starts[at])
                out.append(ids)
            at = until
        ends = np.cumsum(counts)
        at_unit = np.concatenate([[0], ends])[np.searchsorted(starts, begins)]
        text_at = np.zeros(len(offsets), np.int64)
        sizes = np.zeros(len(offsets) - 1, np.int64)
        sizes[full] = np.diff(np.append(at_unit, ends[-1]))
        text_at[1:] = np.cumsum(sizes)
        return np.concatenate(out), text_at

    def decode(self, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of all texts one after another, and where each begins; the space put before a text is taken off."""
        size = np.diff(self.spelled_at)[ids]
        ends = np.cumsum(size)
        out = self.spelled[np.repeat(self.spelled_at[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        text_at = np.concatenate([[0], ends])[begins]
        full = np.flatnonzero(np.diff(text_at))
        out = np.delete(out, text_at[:-1][full])
        shift = np.zeros(len(text_at), np.int64)
        shift[full + 1] = 1
        return out, text_at - np.cumsum(shift)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, ids`` per document: the whole text in pieces, every word (with the spaces before it) segmented for the
    best sum of piece scores.

    A null text counts as empty and has no ids; characters without a piece become byte pieces; repeated rows are
    encoded alike; ``model`` is read on the executors from its path; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path(model))
        for batch in batches:
            for first, raw, offsets in words.slices(batch.column("text"), SLICE_BYTES):
                ids, begins = pieces.encode(raw, offsets)
                found = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(found)), found], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` (``doc_id, ids``) with ``text``, the text that was encoded; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path(model))
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                column = part.column("ids")
                begins = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                raw, text_at = pieces.decode(column.flatten().to_numpy(zero_copy_only=False), begins)
                found = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(text_at.astype(np.int64)), pa.py_buffer(raw))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), column, found.cast(pa.string())], ["doc_id", "ids", "text"])

    return encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def _encoded(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[tuple]:
    """``(doc ids, texts, where each begins, ids, where each begins, decoded texts, where each begins)`` of each slice."""
    pieces = load(model_path(model))
    for batch in batches:
        for first, raw, offsets in words.slices(batch.column("text"), SLICE_BYTES):
            ids, begins = pieces.encode(raw, offsets)
            yield batch.column("doc_id").slice(first, len(offsets) - 1), raw, offsets, ids, begins, *pieces.decode(ids, begins)


def token_digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Encode and decode all documents: ``doc_id, n_ids, ids_crc32`` (of the ids as little-endian 32-bit integers) and
    ``decoded_sha256`` of the decoded text."""
    import hashlib
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, _, _, ids, begins, back, text_at in _encoded(batches, model):
            flat = np.ascontiguousarray(ids, "<u4")
            crcs = pa.array([zlib.crc32(flat[a:b]) for a, b in zip(begins[:-1], begins[1:])], pa.int64())
            digests = pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(text_at[:-1], text_at[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(begins), pa.int64()), crcs, digests], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string")


def checked_ids(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, n_ids, ids, exact`` per document: its ids, and whether they decode to its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, raw, offsets, ids, begins, back, text_at in _encoded(batches, model):
            exact = [raw[a:b].tobytes() == back[c:d].tobytes() for a, b, c, d in zip(offsets, offsets[1:], text_at, text_at[1:])]
            found = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(begins), pa.int64()), found, pa.array(exact, pa.bool_())], ["doc_id", "n_ids", "ids", "exact"])

    return texts(docs).mapInArrow(run, "doc_id long, n_ids long, ids array<int>, exact boolean")
