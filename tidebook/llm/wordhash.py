"""Words and word shingles of texts as numbers: hashes, computed with numpy over the UTF-8 bytes of a whole batch, and exact numbers for the texts of one task.

A word is a run of bytes other than 0x20 and 0x09-0x0D; these bytes never occur inside a multi-byte character.
"""

from __future__ import annotations

import numpy as np

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = _FOLD[97:123]
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 18
#: Bits of a word's piece of 8 bytes that hold 0 to 8 bytes of it.
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other; different numbers stay different."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Keys of the two independent hashes, and the factors of a shingle's words by place, unrelated to each other, so that words in another order give another sum.
_KEYS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93))
_STEP = [mix((np.arange(1, 65, dtype=np.uint64) + k) * _GOLD) | np.uint64(1) for k in _KEYS]


def _word_hashes(data: np.ndarray, doc_start: np.ndarray, seeds: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes and first byte of every word of data; a text begins at each of doc_start.

    A word's bytes are taken eight at a time; each eight is mixed with a key of its place, and the mixed numbers are added up. Words of up to eight bytes so never
    share a hash but through their length's term, and longer ones only by chance.
    """
    n = len(data)
    inside = ~_WHITE[data]
    cuts = np.zeros(n + 1, bool)
    cuts[doc_start] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cuts[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cuts[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = e - s
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = _FOLD[data]
    eights = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    # Most words are one piece; the pieces of the others follow one another.
    h = [eights[s] & _MASK[np.minimum(size, 8)]] * seeds
    h = [mix(x ^ k) for x, k in zip(h, _KEYS, strict=False)]
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8
        start = np.concatenate(([0], np.cumsum(more)[:-1]))
        place = np.arange(int(more.sum())) - np.repeat(start, more) + 1
        at = np.repeat(s[long], more) + 8 * place
        piece = eights[at] & _MASK[np.minimum(np.repeat(e[long], more) - at, 8)]
        for x, k in zip(h, _KEYS, strict=False):
            x[long] += np.add.reduceat(mix(piece ^ mix(place.astype(np.uint64) * _GOLD + k)), start)
    return [mix(x + size.astype(np.uint64) * step[63]) for x, step in zip(h, _STEP, strict=False)], s


def _batches(raw: list[bytes]):
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) <= _CHUNK):
            size += len(raw[end])
            end += 1
        yield raw[at:end]
        at = end


def shingle_pairs(texts: list[str | None], k: int, seeds: int = 2):
    """Yield, for every text in turn, a tuple of seeds arrays: independent uint64 hashes of its k-word shingles in order (repeats included).

    A-Z count as a-z. A text of 1 to k-1 words has its whole sequence as one shingle; one without words, or null, has none.
    """
    none = tuple(np.empty(0, np.uint64) for _ in range(seeds))
    for part in _batches([b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]):
        starts = np.concatenate(([0], np.cumsum([len(x) for x in part])))
        data = np.frombuffer(b"".join(part), np.uint8)
        if not len(data):
            yield from (none for _ in part)
            continue
        words, s = _word_hashes(data, starts[:-1], seeds)
        edge = np.searchsorted(s, starts).tolist()
        many = max(0, len(s) - k + 1)
        found = []
        for w, step in zip(words, _STEP, strict=False):
            sh = np.zeros(many, np.uint64)
            for i in range(k):
                sh += w[i : i + many] * step[i]
            found.append(mix(sh))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b - a >= k:
                yield tuple(sh[a : b - k + 1] for sh in found)
            elif b > a:
                yield tuple(mix((w[a:b] * step[: b - a]).sum(keepdims=True) + np.uint64((b - a) * int(step[62]) & 0xFFFFFFFFFFFFFFFF)) for w, step in zip(words, _STEP, strict=False))
            else:
                yield none


def shingles(texts: list[str | None], k: int):
    """Yield, for every text in turn, the uint64 hashes of its k-word shingles in order; see shingle_pairs."""
    for (h,) in shingle_pairs(texts, k, 1):
        yield h


def exact_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The shingle sets of texts as sorted uint64 numbers, equal in two of them if and only if the words are.

    Words are numbered as they are met, then pairs of them, then threes, and so on: nothing is hashed. The numbers are mixed, one to one, so that their leading bits spread.
    """
    known: dict[bytes, int] = {}
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    ids = np.fromiter((known.setdefault(w, len(known)) for ws in words for w in ws), np.uint64)
    edge = np.concatenate(([0], np.cumsum([len(w) for w in words]))).tolist()
    grams = ids
    for j in range(1, k):
        if j > 1:
            grams = np.unique(grams, return_inverse=True)[1].astype(np.uint64)
        grams = (grams[:-1] << np.uint64(32)) | ids[j:]
    short: dict[tuple, int] = {}
    out = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        own = grams[a : b - k + 1] if b - a >= k else np.array([(1 << 63) | short.setdefault(tuple(ids[a:b].tolist()), len(short))][: b - a], np.uint64)
        out.append(np.unique(mix(own)))
    return out
