"""Byte-level BPE ids of whole Arrow text columns with the tokenizers library, each distinct word encoded once per task.

The library cuts a text into words by a fixed pattern and merges inside words only, so a text's ids are those of its
words. Words are cut here by vectorised character classes; texts with characters outside the table of classes, or with
the string of a special token, go to the library whole.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np

from . import words

#: Code points with a class of their own here: ASCII to Latin Extended-B.
KNOWN = 0x250
GAP, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: The endings that the pattern keeps with their apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Words that a task remembers before it starts anew, and the size of the table that finds them.
REMEMBERED, TABLE_BITS = 1 << 20, 22

#: The characters that byte-level vocabularies write for the 256 bytes; the printable ones of Latin-1 stand for themselves.
_PRINTED = np.isin(np.arange(256), [*range(33, 127), *range(161, 173), *range(174, 256)])
_BYTE_CHARS = np.where(_PRINTED, np.arange(256), 255 + np.cumsum(~_PRINTED)).astype(np.uint32)
_KIND = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(KNOWN)], np.int8)
_KIND[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = GAP


def cuts(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Starts of the words of texts that begin at ``begins`` (ascending, none empty) in one array of code points."""
    kind = _KIND[codes]
    n = len(codes)
    first = np.zeros(n, bool)
    first[begins] = True
    last = np.zeros(n, bool)
    last[np.append(begins[1:], n) - 1] = True
    turn = first.copy()
    turn[1:] |= kind[1:] != kind[:-1]  # starts of runs of one class
    starts = turn.copy()
    gap = kind == GAP
    # the last gap before other characters leaves its run; if it is a space, it goes with what follows
    ends = np.zeros(n, bool)
    ends[:-1] = gap[:-1] & ~gap[1:]
    ends &= ~last
    starts |= ends
    led = np.flatnonzero(ends & (codes == 32)) + 1
    starts[led] = False
    # 's, 't, ... after anything but a space
    quote = np.flatnonzero((codes == 39) & starts)
    for ending in ENDINGS:
        at = quote[quote + len(ending) < n]
        for k, c in enumerate(ending, 1):
            at = at[(codes[at + k] == ord(c)) & ~first[at + k]]
        starts[at + 1] = False
        after = at + 1 + len(ending)
        after = after[after < n]
        starts[after[kind[after] == LETTER]] = True
        quote = np.setdiff1d(quote, at, assume_unique=True)
    return np.flatnonzero(starts)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _grown(values: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``values``, of which the first ``used`` count, with ``more`` behind them; room at least doubles when it is short."""
    if used + len(more) > len(values):
        room = np.zeros(max(used + len(more), 2 * len(values)), values.dtype)
        room[:used] = values[:used]
        values = room
    values[used : used + len(more)] = more
    return values


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        before = self.library.pre_tokenizer
        self.spelled = None
        if isinstance(before, pre_tokenizers.ByteLevel) and before.use_regex and not before.add_prefix_space and self.library.normalizer is None:
            # the same model for words whose bytes are written as its characters already: they need only be cut before each space
            self.spelled = Tokenizer(self.library.model)
            self.spelled.pre_tokenizer = pre_tokenizers.Metaspace(replacement=chr(_BYTE_CHARS[32]), prepend_scheme="never", split=True)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        spelled = self.library.get_vocab()
        self.bytes_of = np.zeros(max(spelled.values()) + 1, np.int64)
        for token, k in spelled.items():
            self.bytes_of[k] = len(token)  # a character of a token stands for a byte
        self.forget()

    def forget(self) -> None:
        """Remembered words: a table of places by bits of a word's hash, and for each place its hash and ids."""
        self.table = np.full(1 << TABLE_BITS, -1, np.int32)
        self.words = self.ids = 0
        self.known = np.zeros(1, np.uint64)
        self.unit_at, self.unit_size = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.unit_ids = np.zeros(1, np.int32)

    def _library_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]  # without offsets

    def _joined_ids(self, codes: np.ndarray) -> list[int]:
        """Ids of words of a space and letters, one after another."""
        text = codes.tobytes().decode("utf-32-le")
        if self.spelled is None:
            return self._library_ids([text])[0]
        spelled = _BYTE_CHARS[np.frombuffer(text.encode(), np.uint8)]
        return self.spelled.encode_batch_fast([spelled.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids

    def _new_ids(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given by their code points one after another, and how many each has.

        Words of a space and letters are cut at their spaces again when they are joined, so they go to the library as one
        text; the bytes that ids stand for tell which ids are whose.
        """
        starts = np.cumsum(sizes) - sizes
        letters = np.add.reduceat(_KIND[codes] == LETTER, starts, dtype=np.int64)
        joins = (codes[starts] == 32) & (letters == sizes - 1) & (sizes > 1)
        counts, ids, where = np.zeros(len(sizes), np.int64), [], np.zeros(len(sizes), np.int64)
        total = 0
        if joins.any():
            own = codes[np.repeat(joins, sizes)]
            found = np.array(self._joined_ids(own), np.int32)
            token_ends = np.cumsum(self.bytes_of[found])
            word_ends = np.cumsum(np.where(own < 0x80, 1, 2))[np.cumsum(sizes[joins]) - 1]
            last = np.searchsorted(token_ends, word_ends)
            if last[-1] >= len(found) or (token_ends[last] != word_ends).any():
                joins[:] = False  # not this vocabulary's way of cutting words
            else:
                counts[joins] = np.diff(np.concatenate([[-1], last]))
                where[joins] = last + 1 - counts[joins]
                ids, total = [found], len(found)
        text = codes.tobytes().decode("utf-32-le")
        alone = np.flatnonzero(~joins)
        found = self._library_ids([text[a : a + n] for a, n in zip(starts[alone].tolist(), sizes[alone].tolist())])
        counts[alone] = [len(x) for x in found]
        where[alone] = total + np.cumsum(counts[alone]) - counts[alone]
        ids.append(np.fromiter((i for x in found for i in x), np.int32, int(counts[alone].sum())))
        return np.concatenate(ids)[_ranges(where, counts)], counts

    def _places(self, hashed: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The remembered place of each word, after encoding those that are new. A word lies at one of two slots, at the second if the first was taken."""
        if self.words > REMEMBERED:
            self.forget()
        slots = (hashed >> np.uint64(64 - TABLE_BITS)).view(np.int64)
        place = self.table.take(slots).astype(np.int64)
        missed = np.flatnonzero((place < 0) | (self.known.take(place, mode="clip") != hashed))
        if len(missed):
            sought = hashed[missed]
            second = (sought >> np.uint64(64 - 2 * TABLE_BITS) & np.uint64((1 << TABLE_BITS) - 1)).view(np.int64)
            place[missed] = self.table.take(second)
            new = np.flatnonzero((place[missed] < 0) | (self.known.take(place[missed], mode="clip") != sought))
            missed, second = missed[new], second[new]
        if len(missed):
            new, first, which = np.unique(hashed[missed], return_index=True, return_inverse=True)
            second, first = second[first], missed[first]
            ids, counts = self._new_ids(codes[_ranges(starts[first], sizes[first])], sizes[first])
            place[missed] = self.words + which
            own, slot = self.words + np.arange(len(new)), slots[first]
            free = self.table[slot] < 0
            self.table[slot[free]] = own[free]
            taken = self.table[slot] != own
            self.table[second[taken]] = own[taken]
            self.unit_at = _grown(self.unit_at, self.words, self.ids + np.cumsum(counts) - counts)
            self.unit_size = _grown(self.unit_size, self.words, counts)
            self.known = _grown(self.known, self.words, new)
            self.unit_ids = _grown(self.unit_ids, self.ids, ids)
            self.words, self.ids = self.words + len(new), self.ids + len(ids)
        return place

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text (plus one) begins."""
        text = raw.tobytes().decode("utf-8")
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        chars = offsets - np.searchsorted(np.flatnonzero((raw & 0xC0) == 0x80), offsets)
        size = np.diff(chars)
        strange = np.searchsorted(np.flatnonzero(codes >= KNOWN), chars)
        whole = np.diff(strange) > 0
        for token in self.special:
            at = text.find(token)
            while at >= 0:
                whole[np.searchsorted(chars, at, "right") - 1] = True
                at = text.find(token, at + 1)
        plain = np.flatnonzero((size > 0) & ~whole)
        counts = np.zeros(len(size), np.int64)
        parts: dict[int, np.ndarray] = {}
        ids = np.zeros(0, np.int32)
        if len(plain):
            if whole.any():
                codes = codes[np.repeat(~whole, size)]
            begins = np.cumsum(size[plain]) - size[plain]
            starts = cuts(codes, begins)
            length = np.diff(np.append(starts, len(codes)))
            sums = np.add.reduceat(words._VALUES_WIDE.take(codes.astype(np.int64)) * words.powers(len(codes)), starts)
            hashed = words.mix(sums * words.powers(len(codes), True)[starts] + length.astype(np.uint64))
            place = self._places(hashed, codes, starts, length)
            many = self.unit_size[place]
            ids = self.unit_ids[_ranges(self.unit_at[place], many)]
            text_at = np.concatenate([[0], np.cumsum(many)])[np.searchsorted(starts, np.append(begins, len(codes)))]
            counts[plain] = np.diff(text_at)
        odd = np.flatnonzero(whole)
        if len(odd):
            for k, found in zip(odd, self._library_ids([text[chars[k] : chars[k + 1]] for k in odd])):
                parts[int(k)] = np.array(found, np.int32)
                counts[k] = len(found)
            out, at = [], 0
            for k, n in enumerate(counts.tolist()):
                out.append(parts[k] if k in parts else ids[at : at + n])
                at += 0 if k in parts else n
            ids = np.concatenate(out)
        return ids, np.concatenate([[0], np.cumsum(counts)])


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path)
