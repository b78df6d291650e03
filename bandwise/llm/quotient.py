"""Counting quotient filters of packed n-grams: lossless, sorted, and merged like sorted lists."""

from __future__ import annotations

import struct

import numpy as np

# Odd constants of the rounds; any would do.
MULTIPLIERS = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
ROUNDS = 2
#: Counts of so many or more are kept behind the others, in full.
ESCAPE = 255

Parts = list[np.ndarray]


def widths(words: int, bits: int) -> list[int]:
    """Bits of the parts that `words` ids of `bits` bits are packed into: at least two parts, of at most 64 bits each."""
    parts = max(2, -(-words // (64 // bits)))
    return [bits * (words // parts + (i < words % parts)) for i in range(parts)]


def _mask(width: int) -> np.uint64:
    return np.uint64((1 << width) - 1)


def pack(ids: list[np.ndarray], bits: int) -> Parts:
    """n-grams, given as an array for each position, as parts."""
    parts, at = [], 0
    for width in widths(len(ids), bits):
        part = np.zeros(len(ids[0]), dtype=np.uint64)
        for _ in range(width // bits):
            part = part << np.uint64(bits) | ids[at].astype(np.uint64)
            at += 1
        parts.append(part)
    return parts


def unpack(parts: Parts, words: int, bits: int) -> list[np.ndarray]:
    ids = []
    for part, width in zip(parts, widths(words, bits)):
        count = width // bits
        ids += [(part >> np.uint64(bits * (count - 1 - i))) & _mask(bits) for i in range(count)]
    return ids


def _mixed(parts: Parts, skip: int, turn: int) -> np.ndarray:
    """A number from all parts but one."""
    total = np.zeros(len(parts[0]), dtype=np.uint64)
    for i, part in enumerate(parts):
        if i != skip:
            total = (total ^ part) * MULTIPLIERS[(turn + i) % len(MULTIPLIERS)]
            total ^= total >> np.uint64(32)
    total *= MULTIPLIERS[turn % len(MULTIPLIERS)]
    return total ^ (total >> np.uint64(29))


def _steps(count: int) -> list[tuple[int, int]]:
    """Part and number of each step; the first part, which gives the quotient, is last."""
    return [(part, 3 * turn + part) for turn in range(ROUNDS) for part in reversed(range(count))]


def permute(parts: Parts, words: int, bits: int, undo: bool = False) -> Parts:
    """Each part in turn is changed by the others, so the steps in reverse order undo it."""
    parts, sizes = list(parts), widths(words, bits)
    steps = _steps(len(parts))
    for part, turn in reversed(steps) if undo else steps:
        parts[part] = parts[part] ^ (_mixed(parts, part, turn) & _mask(sizes[part]))
    return parts


def counted(parts: Parts, counts: np.ndarray | None, sizes: list[int]) -> tuple[Parts, np.ndarray]:
    """Distinct keys in order, with the sum of their counts; without counts, each entry is one."""
    if not len(parts[0]):
        return parts, np.zeros(0, dtype=np.int64)
    if sum(sizes) <= 64:
        key = parts[0]
        for part, size in zip(parts[1:], sizes[1:]):
            key = key << np.uint64(size) | part
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort(parts[::-1])
    parts = [part[order] for part in parts]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([part[1:] != part[:-1] for part in parts])
    starts = np.flatnonzero(new)
    if counts is None:
        sums = np.diff(np.append(starts, len(order)))
    else:
        sums = np.add.reduceat(counts[order], starts)
    return [part[starts] for part in parts], sums.astype(np.int64)


def encode(parts: Parts, counts: np.ndarray, sizes: list[int], shard_bits: int = 0) -> bytes:
    """The filter of sorted distinct keys that agree in their first `shard_bits` bits.

    The next bits, about as many as number the keys, are the quotient: how many keys each one has is written in unary.
    The rest of a key is its remainder, in full, so the filter holds keys rather than hashes of them. Small counts take a byte.
    """
    n = len(counts)
    q = max(0, min(sizes[0] - shard_bits, n.bit_length() - 1))
    rest = sizes[0] - shard_bits - q
    quotient = (parts[0] >> np.uint64(rest)) & _mask(q) if rest < 64 else np.zeros(n, dtype=np.uint64)
    runs = np.zeros(n + (1 << q), dtype=bool)
    runs[np.arange(n) + quotient.astype(np.int64)] = True
    columns = [_low_bytes(parts[0] & _mask(rest), rest)] + [_low_bytes(part, size) for part, size in zip(parts[1:], sizes[1:])]
    large = counts >= ESCAPE
    return b"".join(
        [
            struct.pack("<QB", n, q),
            np.packbits(runs).tobytes(),
            np.concatenate(columns, axis=1).tobytes(),
            np.where(large, ESCAPE, counts).astype(np.uint8).tobytes(),
            counts[large].astype("<i8").tobytes(),
        ]
    )


def _low_bytes(values: np.ndarray, bits: int) -> np.ndarray:
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - -(-bits // 8) :]


def _from_bytes(columns: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(columns), 8), dtype=np.uint8)
    if columns.shape[1]:
        wide[:, 8 - columns.shape[1] :] = columns
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def decode(data: bytes, sizes: list[int], shard: int = 0, shard_bits: int = 0) -> tuple[Parts, np.ndarray]:
    n, q = struct.unpack_from("<QB", data)
    rest = sizes[0] - shard_bits - q
    at, length = 9, -(-(n + (1 << q)) // 8)
    runs = np.unpackbits(np.frombuffer(data, np.uint8, length, at), count=n + (1 << q))
    quotient = (np.flatnonzero(runs) - np.arange(n)).astype(np.uint64)
    at += length
    lengths = [-(-bits // 8) for bits in [rest, *sizes[1:]]]
    table = np.frombuffer(data, np.uint8, n * sum(lengths), at).reshape(n, sum(lengths))
    at += n * sum(lengths)
    ends = np.cumsum([0, *lengths])
    parts = [_from_bytes(table[:, low:high]) for low, high in zip(ends, ends[1:])]
    if rest < 64:
        parts[0] |= (quotient | np.uint64(shard << q)) << np.uint64(rest)
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    counts[counts == ESCAPE] = np.frombuffer(data, "<i8", -1, at + n)
    return parts, counts


def merged(filters: list[tuple[Parts, np.ndarray]], sizes: list[int]) -> tuple[Parts, np.ndarray]:
    """The filter of several: their sorted keys merged, counts added."""
    parts = [np.concatenate(columns) for columns in zip(*[f[0] for f in filters])]
    return counted(parts, np.concatenate([f[1] for f in filters]), sizes)
