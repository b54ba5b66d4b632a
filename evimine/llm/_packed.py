"""Several numpy arrays as one binary value."""

from __future__ import annotations

import numpy as np


def pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def unpack(payload: bytes, kinds: tuple) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(payload, np.int64, len(kinds)).tolist(), 8 * len(kinds), []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(payload, kind, size, at))
        at += out[-1].nbytes
    return out


def unpack_all(payloads: list[bytes], kinds: tuple) -> list[list[np.ndarray]]:
    return [unpack(p, kinds) for p in payloads]


def part_of(names: np.ndarray, parts: int) -> np.ndarray:
    """Rises with the name, so that sorted names come in runs."""
    return ((names >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def runs(names: np.ndarray, parts: int) -> list[tuple[int, slice]]:
    """The parts that sorted names fall into."""
    edges = np.searchsorted(part_of(names, parts), np.arange(parts + 1))
    return [(int(p), slice(edges[p], edges[p + 1])) for p in np.flatnonzero(np.diff(edges))]


def summed(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted names and the sums of their counts."""
    order = np.argsort(names, kind="stable")
    names, counts = names[order], counts[order]
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, np.int64)
    return names[first], np.add.reduceat(counts, first) if len(first) else counts.astype(np.int64)
