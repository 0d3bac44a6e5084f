"""Words, shingles and rolling hashes over Arrow batches of texts, vectorised over the bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
CHUNK = 2 << 20
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random 64-bit value for each byte, and the base of the rolling hash with its inverse.
VALUES = _rng.integers(1, 2**64, 256, dtype=_U)
BASE = _U(0x9E3779B97F4A7C15 | 5)
INVERSE = _U(pow(int(BASE), -1, 2**64))
#: Words of more bytes are hashed one by one. The masks of a lane's first bytes.
SHORT = 64
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and INVERSE ** i for i up to n."""
    size = max(CHUNK + 2, int(n) + 1)
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (BASE, INVERSE):
            p = np.full(size, base, _U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=_U))
        _powers[size] = tuple(both)
    return _powers[size]


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which between() takes the hash of any substring."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(VALUES[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def between(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(((prefix[end] - prefix[start]) * powers(len(prefix))[1][start]) ^ ((end - start).astype(_U) << _U(40)))


def give_back() -> None:
    """What this worker holds and doesn't use goes back to the system, so that an idle worker stays small beside its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: eight bytes at a time go through a mixer that is one to one, long words through BLAKE2.

    No arithmetic relation between words carries over to their hashes, so two words agree by chance alone (2 ** -64).
    """
    length = ends - starts
    out = mix(length.astype(_U) * BASE + _U(1))
    eight, live = lanes(data), np.flatnonzero(length <= SHORT)
    for j in range(0, SHORT, 8):
        lane = eight[starts[live] + j] & _FIRST[np.minimum(length[live] - j, 8)]
        out[live] = mix(out[live] ^ lane) * BASE
        live = live[length[live] > j + 8]
        if not len(live):
            break
    for i in np.flatnonzero(length > SHORT).tolist():
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(an occurrence of each distinct word, which of these each word is, their hashes). Hashes group the words, bytes decide."""
    hashes = word_hashes(data, starts, ends)
    _, where, which = np.unique(hashes, return_index=True, return_inverse=True)
    twin = where[which]
    apart = np.flatnonzero(twin != np.arange(len(twin)))
    if not equal_words(data, starts[apart], ends[apart], data, starts[twin[apart]], ends[twin[apart]]).all():
        seen: dict[bytes, int] = {}
        raw = data.tobytes()
        which = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        where = np.unique(which, return_index=True)[1]
    return where, which, hashes[where]


def equal_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each word has the bytes of the other data's word beside it."""
    length, eight = ends - starts, lanes(data)
    same = length == other_ends - other_starts
    beside = eight if other is data else lanes(other)
    live = np.flatnonzero(same & (length <= SHORT))
    for j in range(0, SHORT, 8):
        if not len(live):
            break
        bad = ((eight[starts[live] + j] ^ beside[other_starts[live] + j]) & _FIRST[np.minimum(length[live] - j, 8)]) != 0
        same[live[bad]] = False
        live = live[~bad & (length[live] > j + 8)]
    for i in np.flatnonzero(same & (length > SHORT)).tolist():
        same[i] = np.array_equal(data[starts[i] : ends[i]], other[other_starts[i] : other_ends[i]])
    return same


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about limit bytes, null as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, data[at[row] : at[to]], at[row : to + 1] - at[row]
        row = to


def words(data: np.ndarray, offsets: np.ndarray, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of all words, and for each row the first of its words; one more at the end. also: where words begin besides."""
    solid = ~BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    if also is not None:
        first |= also
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles, A-Z lower-cased; with fewer words, of all its words."""
    odd = [mix(np.array([i + 1], _U))[0] | _U(1) for i in range(k)]
    for _, data, offsets in chunks(column):
        data = LOWER[data]
        starts, ends, first = words(data, offsets)
        h = word_hashes(data, starts, ends)
        n = max(0, len(h) - k + 1)
        s = np.zeros(n, _U)
        for i, c in enumerate(odd):
            s += h[i : i + n] * c
        s = mix(s)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= k:
                yield np.unique(s[a : b - k + 1])
            elif b > a:
                yield mix(np.array([sum(int(x) * int(c) for x, c in zip(h[a:b], odd, strict=False)) % 2**64], _U) ^ _U(b - a))
            else:
                yield np.zeros(0, _U)
