"""Word hashes of whole texts, computed over Arrow's byte buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; the arrays of one step take about 60 times as much.
STEP = 1 << 20

_rng = np.random.default_rng(5)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD = np.array([chr(i).isalnum() or i >= 128 for i in range(128)] + [True] * 128)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, STEP), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name][:n]


def _hash(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``data`` and where they start; a word never crosses a cut."""
    word = _WORD[data]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before[cuts[cuts < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    after[cuts[(cuts > 0) & (cuts <= len(data))] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", _BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", _INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, ends) for runs of rows: the words of row i end at ends[i - first].

    A word is a maximal run of ASCII letters and digits and non-ASCII characters, after lower-casing;
    null texts have none. A text of more than ``STEP`` bytes is handled in pieces cut between words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + STEP, "right")) - 1)
        j = min(j, len(texts))
        part, cuts = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        if not len(part):
            yield i, np.zeros(0, np.uint64), np.zeros(j - i, np.int64)
        elif j == i + 1 and len(part) > STEP:
            found, k = [], 0
            while k < len(part):
                end = min(k + STEP, len(part))
                while end < len(part) and _WORD[part[end - 1]] and _WORD[part[end]]:
                    gap = np.flatnonzero(~_WORD[part[end : end + STEP]])
                    end = end + int(gap[0]) if len(gap) else min(end + STEP, len(part))
                found.append(_hash(part[k:end], np.zeros(0, np.int64))[0])
                k = end
            words = np.concatenate(found)
            yield i, words, np.array([len(words)])
        else:
            words, starts = _hash(part, cuts)
            yield i, words, np.searchsorted(starts, cuts[1:], "left")
        i = j


def texts_to_words(texts: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text in turn."""
    for _, words, ends in word_hashes(texts):
        start = 0
        for end in ends:
            yield words[start:end]
            start = end


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; a text with fewer words, but any, is one run."""
    if not len(words):
        return words
    n_eff = min(n, len(words))
    out = np.full(len(words) - n_eff + 1, np.uint64(n_eff))
    for k in range(n_eff):
        out = out * _BASE + words[k : len(words) - n_eff + 1 + k]
    return mix(out)


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches ``least``; sizes that rule it out are seen first."""
    if min(len(x), len(y)) < least * max(len(x), len(y)) - 1e-9:
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    return both >= least * (len(x) + len(y) - both) - 1e-9
