"""Vectorised hashing of bytes and words inside a task.

A text is handled as bytes with prefix sums of a polynomial modulo 2**64, so that
the hash of any stretch is one subtraction and one product. Hashes depend on
content alone, not on where a stretch lies, so long texts go through in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that are hashed at a time; a longer text is cut at a separator.
PART = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64 over all others (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_values(lower: bool, seed: int = 1) -> np.ndarray:
    """A 64-bit value per byte; A-Z have those of a-z where `lower` is set."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed))
    if lower:
        values[65:91] = values[97:123]
    return values


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n + 1:
        size = max(n, PART) + 1
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.full(size, np.uint64(base), dtype=np.uint64)
                p[0] = 1
                _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def prefix_sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """S with S[e] - S[s] proportional to the hash of data[s:e]."""
    _, down = _power_table(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * down[: len(data)], out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, _ = _power_table(len(sums) - 1)
    return mix((sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64))


def separators(extra: bytes = b"") -> np.ndarray:
    """Which bytes end a word: the blanks of every contract, and `extra`."""
    out = np.zeros(256, dtype=bool)
    out[[9, 10, 11, 12, 13, 32, *extra]] = True
    return out


def parts(texts: list[bytes], sep: np.ndarray) -> Iterator[tuple[list[int], bytes, np.ndarray]]:
    """Texts laid end to end in buffers of about PART bytes: (numbers of the texts, buffer, where each starts)."""
    held: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush():
        starts = np.zeros(len(held), dtype=np.int64)
        np.cumsum([len(x) + 1 for x in held[:-1]], out=starts[1:])
        return owners, b" ".join(held), starts

    for i, text in enumerate(texts):
        at = 0
        while True:
            end = min(at + PART, len(text))
            if end < len(text):  # back to a separator; a word longer than a part stays whole
                cut = np.flatnonzero(sep[np.frombuffer(text, np.uint8, end - at, at)])
                if len(cut):
                    end = at + int(cut[-1]) + 1
                else:
                    later = np.flatnonzero(sep[np.frombuffer(text, np.uint8, len(text) - end, end)])
                    end = end + int(later[0]) + 1 if len(later) else len(text)
            if held and size + end - at > PART:
                yield flush()
                held, owners, size = [], [], 0
            held.append(text[at:end])
            owners.append(i)
            size += end - at + 1
            at = end
            if at >= len(text):
                break
    if held:
        yield flush()


def word_bounds(data: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~sep[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(texts: list[bytes], sep: np.ndarray, lower: bool = True, prefixes: tuple[int, ...] = ()) -> list[list[np.ndarray]]:
    """For each text [hashes of its words in order, then of their first p bytes for each p]; shorter words have no prefix."""
    values = byte_values(lower)
    found: list[list[list[np.ndarray]]] = [[[] for _ in range(1 + len(prefixes))] for _ in texts]
    for owners, buffer, starts in parts(texts, sep):
        data = np.frombuffer(buffer, np.uint8)
        s, e = word_bounds(data, sep)
        if not len(s):
            continue
        sums = prefix_sums(data, values)
        cut = np.searchsorted(s, starts)
        kinds = [(s, stretch_hash(sums, s, e))]
        for p in prefixes:
            long = s[e - s > p]
            kinds.append((long, mix(stretch_hash(sums, long, long + p) + np.uint64(p))))
        for k, (at, h) in enumerate(kinds):
            cut = np.append(np.searchsorted(at, starts), len(at))
            for j, i in enumerate(owners):
                if cut[j + 1] > cut[j]:
                    found[i][k].append(h[cut[j] : cut[j + 1]])
    none = np.zeros(0, dtype=np.uint64)
    return [[np.concatenate(x) if len(x) > 1 else x[0] if x else none for x in kinds] for kinds in found]


#: Rows that a task works on at a time, whatever the size of an Arrow batch.
ROWS = 500


def sliced(batches, rows: int = ROWS):
    """The rows of Arrow batches in slices: what is derived from a slice is gone before the next."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
