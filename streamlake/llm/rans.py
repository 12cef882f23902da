"""Static range asymmetric numeral system over a table of symbol frequencies, in numpy.

A block of symbols is dealt in turn to ``lanes`` interleaved coders, which advance together, one
array operation per step for all of them. Encoding runs from the last symbol to the first, decoding
forwards, so the state in front of any symbol is a place from which decoding can start: the block
records such checkpoints at a fixed distance, and any of them is an entry for a decoder of its own.

Block layout, little-endian: magic, version, lanes, symbols, steps between checkpoints, stream
words, CRC-32 of the symbols as unsigned 32-bit integers, CRC-32 of everything behind the header;
then per checkpoint the stream position and the lanes' states; then the stream of 32-bit words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RANS"
VERSION = 1
HEADER = struct.Struct("<4sHHQIQII")
SCALE_BITS = 20
LOWEST = np.uint64(1 << 31)  # states lie in [2^31, 2^63) and give or take 32 bits at a time
MAX_LANES = 2048
CHECKPOINT_STEPS = 256
_WORD = np.uint64(32)
_MASK = np.uint64(0xFFFFFFFF)


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that add up to ``2**bits``, at least one for each symbol that occurs."""
    counts = np.asarray(counts, dtype=np.float64)
    seen = counts > 0
    total = 1 << bits
    if not seen.any():
        return np.zeros(len(counts), dtype=np.int64)
    if seen.sum() > total:
        raise ValueError("more symbols than the scale has room for")
    freq = np.where(seen, np.maximum(1, np.floor(counts / counts.sum() * total)), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    excess, at = int(freq.sum()) - total, 0
    while excess > 0:  # rounding up rare symbols is paid for by the frequent ones
        give = min(excess, max(0, int(freq[order[at]]) // 2))
        freq[order[at]] -= give
        excess -= give
        at = (at + 1) % len(order)
    freq[order[0]] -= excess
    return freq


class Table:
    """Symbols (ascending) with their scaled frequencies, ready for coding."""

    def __init__(self, symbols, freq, bits: int = SCALE_BITS):
        self.symbols = np.asarray(symbols, dtype=np.uint32)
        freq = np.asarray(freq, dtype=np.uint64)
        if freq.sum() not in (0, 1 << bits):
            raise ValueError("the frequencies do not add up to the scale")
        self.bits = np.uint64(bits)
        self.freq = freq
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.limit = ((LOWEST >> self.bits) << _WORD) * freq
        self.place = np.full(int(self.symbols[-1]) + 1 if len(self.symbols) else 1, -1, np.int64)
        self.place[self.symbols] = np.arange(len(self.symbols))
        self.slots = None

    def opened(self) -> Table:
        """With the slot-to-symbol array that decoding needs."""
        if self.slots is None:
            self.slots = np.repeat(np.arange(len(self.freq), dtype=np.int32),
                                   self.freq.astype(np.int64))
        return self


def crc(symbols: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(symbols, dtype="<u4"))


def encode(symbols: np.ndarray, table: Table, max_lanes: int = MAX_LANES,
           every: int = CHECKPOINT_STEPS) -> bytes:
    symbols = np.asarray(symbols, dtype=np.uint32)
    n = len(symbols)
    lanes = int(min(max_lanes, max(1, n // 64)))
    if n and int(symbols.max()) >= len(table.place):
        raise ValueError("a symbol is not in the table")
    at = table.place[symbols]
    if n and int(at.min()) < 0:
        raise ValueError("a symbol is not in the table")
    states = np.full(lanes, LOWEST, dtype=np.uint64)
    steps = -(-n // lanes)
    words, given = [], 0
    marks = []
    for step in range(steps - 1, -1, -1):
        row = at[step * lanes:(step + 1) * lanes]
        x, f = states[:len(row)], table.freq[row]
        full = x >= table.limit[row]
        if full.any():
            out = (x[full] & _MASK).astype(np.uint32)
            words.append(out[::-1])  # the stream is turned round as a whole at the end
            given += len(out)
            x = np.where(full, x >> _WORD, x)
        q, r = np.divmod(x, f)
        states[:len(row)] = (q << table.bits) + r + table.start[row]
        if step % every == 0:
            marks.append((given, states.copy()))
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)
    body = b"".join(
        [struct.pack("<Q", given - position) + held.astype("<u8").tobytes()
         for position, held in reversed(marks)] + [stream.astype("<u4").tobytes()])
    return HEADER.pack(MAGIC, VERSION, lanes, n, every, given, crc(symbols),
                       zlib.crc32(body)) + body


def _opened(block: bytes):
    magic, version, lanes, n, every, given, told, body_crc = HEADER.unpack_from(block)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block of this format")
    if zlib.crc32(memoryview(block)[HEADER.size:]) != body_crc:
        raise ValueError("a block is damaged")
    return lanes, n, every, given, told


def checkpoints(block: bytes) -> int:
    lanes, n, every, *_ = _opened(block)
    return -(-(-(-n // lanes)) // every)


def decode(block: bytes, table: Table, first: int = 0, count: int | None = None) -> np.ndarray:
    """The symbols from checkpoint ``first`` on, up to ``count`` checkpoints of them; a whole block
    is also checked against the CRC of its symbols."""
    lanes, n, every, given, told = _opened(block)
    table = table.opened()
    steps = -(-n // lanes)
    entries = -(-steps // every)
    last = entries if count is None else min(entries, first + count)
    if first >= last:
        return np.zeros(0, np.uint32)
    entry = 8 + 8 * lanes
    base = HEADER.size + entry * first
    position = struct.unpack_from("<Q", block, base)[0]
    states = np.frombuffer(block, "<u8", lanes, base + 8).astype(np.uint64)
    stream = np.frombuffer(block, "<u4", given, HEADER.size + entry * entries)
    begin, end = first * every, min(steps, last * every)
    out = np.empty(min(n, end * lanes) - begin * lanes, np.uint32)
    slot_mask = np.uint64((1 << int(table.bits)) - 1)
    for step in range(begin, end):
        here = (step - begin) * lanes
        width = min(lanes, len(out) - here)
        x = states[:width]
        slot = x & slot_mask
        at = table.slots[slot]
        out[here:here + width] = table.symbols[at]
        x = table.freq[at] * (x >> table.bits) + slot - table.start[at]
        low = x < LOWEST
        wanted = int(np.count_nonzero(low))
        if wanted:
            x[low] = (x[low] << _WORD) | stream[position:position + wanted]
            position += wanted
        states[:width] = x
    if first == 0 and last == entries and crc(out) != told:
        raise ValueError("the decoded symbols differ from those encoded")
    return out
