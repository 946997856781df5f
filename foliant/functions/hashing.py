"""NumPy hashes of the two MinHash families and of the hashed embedders. All arithmetic wraps modulo 2^64."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import xxhash

# FNV-1a and splitmix64.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
ROWS, BANDS = 128, 32
SMALL_ROWS, SMALL_BANDS = 64, 8
U = np.uint64


def splitmix64(z: np.ndarray) -> np.ndarray:
    z = z + U(GOLDEN)
    z = (z ^ (z >> U(30))) * U(MIX_A)
    z = (z ^ (z >> U(27))) * U(MIX_B)
    return z ^ (z >> U(31))


def fold_fnv(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return (h ^ byte) * U(FNV_PRIME)


def fold_mix(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return splitmix64(h ^ byte)


def window_hashes(text: str, k: int, start: int, fold) -> np.ndarray:
    """Hash of the UTF-8 bytes of every run of k characters; of the whole text if it is shorter."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    n = len(at) - 1
    lo, hi = (at[:-k], at[k:]) if 0 < k <= n else (np.array([0]), np.array([len(raw)]))
    h = np.full(len(lo), start, U)
    for step in range(int((hi - lo).max(initial=0))):
        live = np.flatnonzero(lo + step < hi)
        h[live] = fold(h[live], raw[lo[live] + step].astype(U))
    return h


CHUNK = 1 << 15


def signed(sets: list[np.ndarray], rows: int, of_row: Callable[[np.ndarray], Callable[[int], np.ndarray]]) -> np.ndarray:
    """A signature a set: in each row the least of its members' hashes. Sets are hashed together, so many at a time as fit the cache."""
    out, at = np.empty((len(sets), rows), U), 0
    while at < len(sets):
        end, n = at, 0
        while end < len(sets) and (n == 0 or n + len(sets[end]) <= CHUNK):
            n += len(sets[end])
            end += 1
        part = sets[at:end]
        row, starts = of_row(np.concatenate(part)), np.concatenate([[0], np.cumsum([len(x) for x in part])[:-1]])
        for r in range(rows):
            out[at:end, r] = np.minimum.reduceat(row(r), starts)
        at = end
    return out


def near_signatures(texts: list[str], k: int = 5) -> np.ndarray:
    """128 rows over runs of k characters, white space dropped, lowered: the near-duplicate index's family."""
    sets = [np.maximum(np.unique(window_hashes("".join(t.split()).lower(), k, 0, fold_mix)), U(1)) for t in texts]

    def of_row(x: np.ndarray) -> Callable[[int], np.ndarray]:
        z, spare = np.empty_like(x), np.empty_like(x)

        def row(r: int) -> np.ndarray:
            np.bitwise_xor(x, U(r * GOLDEN & (2**64 - 1)), out=z)
            np.add(z, U(GOLDEN), out=z)
            for shift, factor in ((30, MIX_A), (27, MIX_B)):
                np.right_shift(z, U(shift), out=spare)
                np.bitwise_xor(z, spare, out=z)
                np.multiply(z, U(factor), out=z)
            np.right_shift(z, U(31), out=spare)
            return np.bitwise_xor(z, spare, out=z)

        return row

    return signed(sets, ROWS, of_row)


def near_signature(text: str, k: int = 5) -> np.ndarray:
    return near_signatures([text], k)[0]


def near_bands(sig: np.ndarray) -> np.ndarray:
    """Keys of 32 bands of 4 rows, for a matrix of signatures."""
    raw = np.ascontiguousarray(sig.astype("<u8")).view(np.uint8).reshape(len(sig), BANDS, -1).astype(U)
    h = np.zeros((len(sig), BANDS), U)
    for i in range(raw.shape[2]):
        h = fold_mix(h, raw[:, :, i])
    return h


def small_signatures(texts: list[str], k: int = 3) -> np.ndarray:
    """64 rows over runs of k lowered characters, white space kept: the organiser's family."""
    sets = [np.unique(window_hashes(t.lower(), k, FNV_BASIS, fold_fnv)) for t in texts]

    def of_row(x: np.ndarray) -> Callable[[int], np.ndarray]:
        raw = np.ascontiguousarray(np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(len(x), 8).T).astype(U)
        h = np.empty_like(x)

        def row(r: int) -> np.ndarray:
            h.fill(FNV_BASIS ^ (r + 1))
            for byte in raw:
                np.bitwise_xor(h, byte, out=h)
                np.multiply(h, U(FNV_PRIME), out=h)
            return h

        return row

    return signed(sets, SMALL_ROWS, of_row)


def small_signature(text: str, k: int = 3) -> np.ndarray:
    return small_signatures([text], k)[0]


def small_bands(sig: np.ndarray) -> np.ndarray:
    """Keys of 8 bands of 8 rows, for a matrix of signatures."""
    raw = np.ascontiguousarray(sig.astype("<u8")).view(np.uint8).reshape(len(sig), SMALL_BANDS, -1).astype(U)
    h = np.stack([np.full(len(sig), FNV_BASIS ^ (b + 1), U) for b in range(SMALL_BANDS)], 1)
    for i in range(raw.shape[2]):
        h = fold_fnv(h, raw[:, :, i])
    return h


@lru_cache(1_000_000)
def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def embedded_all(texts: list[str], dim: int = 256) -> np.ndarray:
    """Signed feature hashing of runs of 1 to 3 lowered characters and of words, a row of unit length for each text; zeros for an empty one."""
    out = np.zeros((len(texts), dim))
    for lo in range(0, len(texts), 256):
        part = [t.lower() for t in texts[lo : lo + 256]]
        out[lo : lo + len(part)] = _hashed(part, dim)
    n = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def _hashed(low: list[str], dim: int) -> np.ndarray:
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in low]
    c, of = np.concatenate([*raw, np.zeros(0, np.uint32)]).astype(U), np.repeat(np.arange(len(low)), [len(r) for r in raw])
    hashes, owners = [], []
    for n in (1, 2, 3):
        m = len(c) - n + 1
        if m > 0:
            at = np.flatnonzero(of[:m] == of[n - 1 :])
            h = np.full(len(at), n, U)
            for i in range(n):
                h = splitmix64(h ^ c[at + i])
            hashes.append(h)
            owners.append(of[at])
    words = [re.findall(r"[^\W_]+", t) for t in low]
    hashes.append(np.array([word_hash(w) for ws in words for w in ws], U))
    owners.append(np.repeat(np.arange(len(low)), [len(ws) for ws in words]))
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    return np.bincount(owner * dim + (h % U(dim)).astype(np.int64), np.where((h >> U(32)) & U(1), -1.0, 1.0), len(low) * dim).reshape(len(low), dim)


def embedded(text: str, dim: int = 256) -> np.ndarray:
    return embedded_all([text], dim)[0]


def unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum())
    return v / n if n else v


def token_vector(text: str, dim: int = 32) -> np.ndarray:
    """Signed hashing of whole words, each as often as it comes, of unit length; zeros for a text without words."""
    h = np.array([word_hash(w) for w in re.findall(r"[^\W_]+", text.lower())], U)
    return unit(np.bincount((h % U(dim)).astype(int), np.where((h >> U(32)) & U(1), -1.0, 1.0), dim) if len(h) else np.zeros(dim))


def trigram_vector(text: str, dim: int = 256) -> np.ndarray:
    """Every distinct run of three lowered characters in two buckets, the second at half weight, of unit length.

    A text too short for one has its words instead.
    """
    low = text.lower()
    grams = {low[i : i + 3] for i in range(len(low) - 2)} or set(re.findall(r"[^\W_]+", low))
    h = np.array([word_hash(g) for g in sorted(grams)], U)
    if not len(h):
        return np.zeros(dim)
    sign = np.where(h & U(1), -1.0, 1.0)
    return unit(np.bincount((h % U(dim)).astype(int), sign, dim) + np.bincount(((h >> U(8)) % U(dim)).astype(int), sign * 0.5, dim))
