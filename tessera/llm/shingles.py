"""Sets of word shingles as sorted 64-bit hashes, for whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


def flat_sets(texts: list, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the sets of the texts one after the other, each sorted and distinct; set k
    is hashes[ends[k] : ends[k + 1]]. A-Z are lower-cased and words are what stands between white
    space of ASCII; a text with fewer than ``width`` words is one shingle, one without words
    (or null) an empty set."""
    raw = [(t or "").encode("utf-8", "replace").translate(_LOWER) for t in texts]
    split = pc.ascii_split_whitespace(pa.array(raw, pa.large_binary()).cast(pa.large_string(), safe=False))
    doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    flat = split.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    coded = flat.filter(pa.array(full)).dictionary_encode()
    n_words = np.bincount(doc[full], minlength=len(texts))
    _, cuts, data = coded.dictionary.buffers()
    cuts, data = np.frombuffer(cuts, np.int64, len(coded.dictionary) + 1).tolist(), data.to_pybytes() if data else b""
    one = xxhash.xxh3_64_intdigest
    table = np.fromiter((one(data[x:y]) for x, y in zip(cuts, cuts[1:])), np.uint64, len(coded.dictionary))
    words = table[coded.indices.to_numpy(zero_copy_only=False)] if len(table) else np.zeros(0, np.uint64)
    at = np.concatenate([[0], np.cumsum(n_words)])
    long = n_words >= width
    count = np.where(long, n_words - width + 1, np.minimum(n_words, 1))
    ends = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(int(ends[-1]), np.uint64)
    with np.errstate(over="ignore"):
        if long.any():
            n = len(words) - width + 1
            rolled = mix(words[:n].copy())
            for k in range(1, width):
                rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
            first = np.repeat(at[:-1][long] - ends[:-1][long], count[long])
            out[np.repeat(long, count)] = rolled[first + np.flatnonzero(np.repeat(long, count))]
        for i in np.flatnonzero(~long & (n_words > 0)).tolist():
            h = n_words[i : i + 1].astype(np.uint64)
            for w in words[at[i] : at[i + 1]]:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w)
            out[ends[i]] = h[0]
    for x, y in zip(ends[:-1].tolist(), ends[1:].tolist()):
        out[x:y].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[ends[:-1][count > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[ends]


def shingle_sets(texts: list, width: int = 5) -> list[np.ndarray]:
    """The sets of ``flat_sets``, one array each."""
    flat, ends = flat_sets(texts, width)
    return [flat[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]


def min_hashes(flat: np.ndarray, ends: np.ndarray, n: int) -> list[list[int]]:
    """``n`` minimum hashes of each set as signed 64-bit numbers; none for an empty set."""
    some = ends[1:] > ends[:-1]
    if not some.any():
        return [[] for _ in some]
    seeds = mix(np.arange(1, n + 1, dtype=np.uint64))
    least = np.stack([np.minimum.reduceat(mix(flat ^ seed), ends[:-1][some]) for seed in seeds], axis=1).view(np.int64).tolist()
    rows = iter(least)
    return [next(rows) if x else [] for x in some.tolist()]


def similar(a: int, b: int, shared: int, percent: int = 75) -> bool:
    return 100 * shared >= percent * (a + b - shared)


#: Bins of a histogram: a power of two, at least half of the set's size.
LEAST_BINS, MOST_BINS = 16, 8192


def histogram(s: np.ndarray) -> bytes | None:
    """Counts of a set's hashes by their lowest bits, a byte each; None if one doesn't fit."""
    bins = min(MOST_BINS, max(LEAST_BINS, 1 << max(0, (len(s) - 1) // 2).bit_length()))
    count = np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return count.astype(np.uint8).tobytes() if count.max() < 256 else None


class Histograms:
    """Histograms of many sets, by number of bins; ``most`` bounds what two sets share."""

    #: Bytes that one comparison step may hold.
    STEP = 8_000_000

    def __init__(self, column):
        blobs = column.to_pylist()
        self.bins = np.array([len(b) if b else 0 for b in blobs], np.int64)
        self.place = np.zeros(len(blobs), np.int64)
        self.tables = {}
        for b in np.unique(self.bins[self.bins > 0]).tolist():
            at = np.flatnonzero(self.bins == b)
            self.place[at] = np.arange(len(at))
            self.tables[b] = np.frombuffer(b"".join(blobs[k] for k in at.tolist()), np.uint8).reshape(len(at), b)

    def _folded(self, rows: np.ndarray, bins: int, to: int) -> np.ndarray:
        h = self.tables[bins][self.place[rows]]
        return h if bins == to else h.reshape(len(rows), bins // to, to).sum(axis=1, dtype=np.uint16)

    def most(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For rows x[k] and y[k]: the most that their sets can have in common; where a set has
        no histogram, a number above all sizes."""
        out = np.full(len(x), np.iinfo(np.int64).max)
        kind = self.bins[x] * (2 * MOST_BINS) + self.bins[y]
        for k in np.unique(kind).tolist():
            a, b = divmod(k, 2 * MOST_BINS)
            if not a or not b:
                continue
            to, at = min(a, b), np.flatnonzero(kind == k)
            step = max(1, self.STEP // max(a, b))
            for s in range(0, len(at), step):
                part = at[s : s + step]
                out[part] = np.minimum(self._folded(x[part], a, to), self._folded(y[part], b, to)).sum(axis=1, dtype=np.int64)
        return out
