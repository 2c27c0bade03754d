"""Blocks of token ids, coded by an adaptive context-mixing range coder.

A block is cut into lanes of equal length that are coded side by side: at each step one id of every lane is coded
with the same model, which then learns all of them at once. So a step is a few array operations, whatever the
number of lanes, and a block can be read back without any other block.

The model of the next id mixes three predictions. Order 2 and order 1 remember the id that last followed the two ids
before, and the one id before, each with a confidence from 0 to 7; order 0 counts ids. The weights of the mixture are
learned for each pair of confidences. The coder is a 64 bit range coder that gives out 32 bit words; where an interval
becomes narrower than a word and crosses a word's border, it is cut there, so no carry can occur.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TGTK"
VERSION = 2
HEAD = "<4sHHIIIIQ"  # magic, version, lanes' bits, vocabulary, documents, words, steps, ids
MOST_LANES_BITS = 13
ROWS_A_LANE = 256
WORD = np.uint64(32)
LOW = np.uint64(0xFFFFFFFF)
CUT = np.uint64(1 << 32)
MIX_BITS = 16
ORDER2_BITS = 18


class Coder:
    """Interval state of all lanes."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, np.iinfo(np.uint64).max, np.uint64)

    def narrow(self, lanes, start, freq, unit) -> np.ndarray:
        """Shrink the intervals; the lanes that need a new word."""
        if lanes is None:
            self.low += unit * start
            self.range = unit * freq
            return np.flatnonzero(self.range < CUT)
        width = unit * freq
        self.low[lanes] += unit * start
        self.range[lanes] = width
        return lanes[width < CUT]

    def shift(self, lanes: np.ndarray) -> np.ndarray:
        """Give out the upper word of these lanes."""
        low, width = self.low.take(lanes), self.range.take(lanes)
        room = CUT - (low & LOW)
        width = np.minimum(width, room)
        self.low[lanes] = low << WORD
        self.range[lanes] = width << WORD
        return low >> WORD


class Model:
    """Order-0 to order-2 predictions of all lanes of one block, and their mixing weights.

    An entry of the order-1 and order-2 tables is an id times 8 plus its confidence.
    """

    def __init__(self, vocabulary: int, rows: np.ndarray):
        self.rows = rows
        self.vocabulary = vocabulary
        self.bits0 = max(19, vocabulary.bit_length() + 3)
        self.after1 = np.full(vocabulary + 1, vocabulary * 8, np.int32)
        self.after2 = np.full(1 << ORDER2_BITS, vocabulary * 8, np.int32)
        self.before1 = np.full(rows.shape[1], vocabulary, np.int32)
        self.before2 = self.before1
        self.hits = np.tile(np.array([2, 1, 4], np.int64), 128)
        self.counts = np.zeros(vocabulary, np.int64)
        self.step = self.counted = 0
        self._order0()
        self._weights()

    def _order0(self) -> None:
        self.counts += np.bincount(self.rows[self.counted : self.step].ravel(), minlength=self.vocabulary)
        self.counted = self.step
        room = (1 << self.bits0) - self.vocabulary
        freq = 1 + self.counts * room // max(1, int(self.counts.sum()))
        if not self.counts.any():
            freq[:] = (1 << self.bits0) // self.vocabulary
        # A start and its frequency lie in one number, so that an id is looked up once.
        self.interval0 = (np.cumsum(freq) - freq).astype(np.uint64) << WORD | freq.astype(np.uint64)
        self.inverse = None

    def symbol(self, place: np.ndarray) -> np.ndarray:
        """The ids whose order-0 intervals hold these places."""
        if self.inverse is None:
            kind = np.uint16 if self.vocabulary <= 1 << 16 else np.int32
            self.inverse = np.repeat(np.arange(self.vocabulary, dtype=kind), (self.interval0 & LOW).astype(np.int64))
        return self.inverse.take(place.view(np.int64), mode="clip").astype(np.int32)

    def _weights(self) -> None:
        """Frequencies of order 2, 1 and 0 for each pair of confidences; they sum to 2 ** MIX_BITS."""
        hits = self.hits.reshape(128, 3)
        room = (1 << MIX_BITS) - 3
        freq = 1 + hits * room // hits.sum(axis=1, keepdims=True)
        freq[:, 2] += (1 << MIX_BITS) - freq.sum(axis=1)
        start = np.cumsum(freq, axis=1) - freq
        self.freq_mix, self.start_mix = freq.ravel().astype(np.uint64), start.ravel().astype(np.uint64)
        self.start1, self.start2 = start[:, 1].astype(np.uint64), start[:, 2].astype(np.uint64)

    def predict(self) -> None:
        mixed = self.before1.view(np.uint32) * np.uint32(0x9E3779B1) + self.before2.view(np.uint32) * np.uint32(0x85EBCA6B)
        self.place2 = (mixed >> np.uint32(32 - ORDER2_BITS)).astype(np.int64)
        self.place1 = self.before1.astype(np.int64)
        self.entry2, self.entry1 = self.after2.take(self.place2), self.after1.take(self.place1)
        self.guess2, self.guess1 = self.entry2 >> 3, self.entry1 >> 3
        kind = ((self.entry2 & 7) << 4) + ((self.entry1 & 7) << 1) + (self.guess1 == self.guess2)
        self.kind = kind.astype(np.int64)

    def learn(self, ids: np.ndarray, chosen: np.ndarray) -> None:
        """chosen: kind times 3 plus 0 where order 2 was right, 1 where only order 1 was, 2 elsewhere."""
        if self.step < 64 or self.step % 4 == 0:
            self.hits += np.bincount(chosen, minlength=384)
        fresh = ids << 3
        for table, place, entry, guess in (
            (self.after2, self.place2, self.entry2, self.guess2), (self.after1, self.place1, self.entry1, self.guess1)
        ):
            sure = -(((entry & 7) + 5) >> 3)  # all bits where the confidence is 3 or more: such an entry loses 2
            missed = fresh ^ ((fresh ^ (entry - 2)) & sure)
            table[place] = np.where(guess == ids, np.minimum(entry + 1, entry | 7), missed)
        self.before2, self.before1 = self.before1, ids
        self.step += 1
        if self.step & (self.step - 1) == 0 or self.step % 128 == 0:
            self._order0()
        if self.step < 16 or self.step % 16 == 0:
            if self.hits.max() > 1 << 20:
                self.hits = self.hits // 2 + 1
            self._weights()


def _geometry(n: int) -> tuple[int, int]:
    bits = min(MOST_LANES_BITS, max(0, (n // ROWS_A_LANE).bit_length() - 1))
    return bits, -(-n >> bits) if n else 0


def encode_ids(ids: np.ndarray, vocabulary: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Lanes' bits, steps, number of words of each lane, words of all lanes one after the other."""
    bits, steps = _geometry(len(ids))
    lanes = 1 << bits
    rows = np.zeros(lanes * steps, np.int32)
    rows[: len(ids)] = ids
    rows = np.ascontiguousarray(rows.reshape(lanes, steps).T)
    coder, model = Coder(lanes), Model(vocabulary, rows)
    given: list[tuple[np.ndarray, np.ndarray]] = []

    def emit(need: np.ndarray) -> None:
        if len(need):
            given.append((need.astype(np.uint16), coder.shift(need).astype(np.uint32)))

    for now in rows:
        model.predict()
        order = np.where(model.guess2 == now, 0, 2 - (model.guess1 == now))
        chosen = model.kind * 3 + order
        emit(coder.narrow(None, model.start_mix.take(chosen), model.freq_mix.take(chosen), coder.range >> np.uint64(MIX_BITS)))
        rest = np.flatnonzero(order == 2)
        if len(rest):
            of = now.take(rest)
            interval = model.interval0.take(of)
            emit(coder.narrow(rest, interval >> WORD, interval & LOW, coder.range.take(rest) >> np.uint64(model.bits0)))
        model.learn(now, chosen)
    for word in (coder.low >> WORD, coder.low & LOW):
        given.append((np.arange(lanes, dtype=np.uint16), word.astype(np.uint32)))
    lane = np.concatenate([g[0] for g in given])
    words = np.concatenate([g[1] for g in given])[np.argsort(lane, kind="stable")]
    return bits, steps, np.bincount(lane, minlength=lanes).astype("<u4"), words.astype("<u4")


def decode_ids(n: int, vocabulary: int, bits: int, steps: int, per_lane: np.ndarray, words: np.ndarray) -> np.ndarray:
    lanes = 1 << bits
    rows = np.zeros((steps, lanes), np.int32)
    coder, model = Coder(lanes), Model(vocabulary, rows)
    words = np.concatenate([words, np.zeros(2, np.uint32)]).astype(np.uint64)
    at = np.cumsum(per_lane.astype(np.int64)) - per_lane
    code = words[at] << WORD | words[at + 1]
    at += 2

    def take(need: np.ndarray) -> None:
        if len(need):
            coder.shift(need)
            code[need] = code[need] << WORD | words[at[need]]
            at[need] += 1

    top = np.uint64((1 << MIX_BITS) - 1)
    for step in range(steps):
        model.predict()
        unit = coder.range >> np.uint64(MIX_BITS)
        place = np.minimum((code - coder.low) // unit, top)
        order = (place >= model.start1.take(model.kind)).astype(np.int32) + (place >= model.start2.take(model.kind))
        chosen = model.kind * 3 + order
        now = np.where(order == 0, model.guess2, model.guess1)
        take(coder.narrow(None, model.start_mix.take(chosen), model.freq_mix.take(chosen), unit))
        rest = np.flatnonzero(order == 2)
        if len(rest):
            unit = coder.range.take(rest) >> np.uint64(model.bits0)
            of = model.symbol((code.take(rest) - coder.low.take(rest)) // unit)
            now[rest] = of
            interval = model.interval0.take(of)
            take(coder.narrow(rest, interval >> WORD, interval & LOW, unit))
        rows[step] = now
        model.learn(now, chosen)
    return rows.T.reshape(-1)[:n]


def write_block(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One block: a head, the documents' ids and numbers of ids, the coded ids, and a checksum of it all."""
    vocabulary = int(ids.max()) + 1 if len(ids) else 1
    bits, steps, per_lane, words = encode_ids(ids, vocabulary)
    head = struct.pack(HEAD, MAGIC, VERSION, bits, vocabulary, len(counts), len(words), steps, len(ids))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    body = b"".join([head, known.tobytes(), numbers.tobytes(), counts.astype("<u8").tobytes(), per_lane.tobytes(), words.tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents, numbers of ids, and ids of a block; an error if a byte has changed."""
    if len(block) < struct.calcsize(HEAD) + 4 or zlib.crc32(memoryview(block)[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("a block of token ids does not match its checksum")
    magic, version, bits, vocabulary, docs, n_words, steps, n = struct.unpack_from(HEAD, block)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block of token ids")
    at = struct.calcsize(HEAD)

    def part(kind: str, many: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(block, kind, many, at)
        at += got.nbytes
        return got

    known, numbers, counts = part("u1", docs), part("<i8", docs), part("<u8", docs)
    per_lane, words = part("<u4", 1 << bits), part("<u4", n_words)
    doc_ids = [d if k else None for d, k in zip(numbers.tolist(), known.tolist())]
    return doc_ids, counts.astype(np.int64), decode_ids(n, vocabulary, bits, steps, per_lane, words)
