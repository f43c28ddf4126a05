"""SimHash fingerprints of word shingles, and exact Hamming neighbours by pigeonring filtering."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 3
HASH_SEED = 42
BITS = 64
#: Shingle hashes whose bits are counted at once; bounds the memory of a very long text.
BIT_BLOCK = 1 << 15


#: Of a wide fingerprint: 64 bits from each of so many hashes of a shingle, made from its XXH64 by odd multipliers.
WORDS_WIDE = 8
_MIX = np.arange(1, 2 * WORDS_WIDE, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_BYTES_WIDE = 8 * WORDS_WIDE
_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1).astype(np.float64)


def shingle_hashes(text: bytes | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each shingle of a UTF-8 text; a text of fewer words is one shingle, one without words has none."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and splits at space and 09-0D only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, HASH_SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-size] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[s:e], HASH_SEED) for s, e in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(starts)
    )


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash: a bit is set if it is set in over half the shingle hashes. No words: 0."""
    hashes = shingle_hashes(text)
    if not hashes.size:
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, hashes.size, BIT_BLOCK):
        block = hashes[at : at + BIT_BLOCK].astype(">u8").view(np.uint8)
        counts += np.unpackbits(block).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > hashes.size).tobytes(), "big")


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The different shingles' hashes, in order."""
    return np.unique(shingle_hashes(text, size))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """SimHash of 512 bits over a set of shingle hashes, one at least: a bit is set if it is in over half of them."""
    counts = np.zeros(8 * _BYTES_WIDE)
    for at in range(0, hashes.size, BIT_BLOCK):
        mixed = hashes[at : at + BIT_BLOCK, None] * _MIX
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        each = mixed.view(np.uint8).reshape(-1, _BYTES_WIDE)
        if len(each) < 64:
            counts += np.unpackbits(each, axis=1).sum(axis=0)
        else:  # bytes are counted by value, and values have fixed bits
            kinds = np.bincount((each + 256 * np.arange(_BYTES_WIDE)).ravel(), minlength=256 * _BYTES_WIDE)
            counts += (kinds.reshape(_BYTES_WIDE, 256) @ _OF_BYTE).ravel()
    return np.packbits(counts * 2 > hashes.size).tobytes()
