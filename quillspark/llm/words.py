"""Words of many texts at once, in numpy: boundaries and 64-bit hashes without a Python object per word."""

from __future__ import annotations

import numpy as np

from .common import mix

#: Blank bytes: space, tab, LF, VT, FF, CR.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: The low 0 to 8 bytes of a 64-bit word.
LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Runs above so many bytes are hashed one by one.
LONG = 1024
SPARE = 8


def join_texts(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end, each followed by a space, plus SPARE bytes; and the offset at which each begins."""
    data = np.frombuffer(b" ".join(texts) + b" " + bytes(SPARE), np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return (LOWER[data] if lower else data), starts


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every run of non-blank bytes; the spare bytes at the end belong to none."""
    blank = BLANK[data[:-SPARE]]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(blank) and not blank[0]:
        edge = np.r_[0, edge]
    starts = edge[::2]
    return starts, edge[1::2] - starts


def byte_class(pattern: bytes) -> np.ndarray:
    """A table of 256 flags: the bytes in ``pattern``."""
    out = np.zeros(256, bool)
    out[list(pattern)] = True
    return out


def arrow_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array end to end (null as empty) plus SPARE bytes, and where each text begins.

    No text becomes a Python object; nothing stands between two texts, so :func:`runs` takes the offsets.
    """
    import pyarrow as pa

    arr = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8) if len(arr) else np.zeros(1, np.int64)
    data = np.zeros(int(offsets[-1] - offsets[0]) + SPARE, np.uint8)
    if offsets[-1] > offsets[0]:
        data[:-SPARE] = np.frombuffer(arr.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every maximal run of bytes in the class ``inside`` within one text, and bounds as in :func:`text_words`."""
    on = inside[data[: offsets[-1]]]
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    full = np.flatnonzero(np.diff(offsets))
    first[offsets[full]], last[offsets[full + 1] - 1] = on[offsets[full]], on[offsets[full + 1] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(starts, offsets)


def spans(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of texts, each of at most ``most`` bytes, or one text alone."""
    out, lo = [], 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def run_hashes(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each run of bytes: eight bytes at a time through :func:`mix`, the length first."""
    base = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (1 << 64) - 1)
    h = lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + base
    if not len(starts):
        return h
    raw = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    h = mix(h ^ (raw[starts] & LOW[np.minimum(lens, 8)]))
    at, done = np.flatnonzero((lens > 8) & (lens <= LONG)), 8
    while len(at):
        left = lens[at] - done
        h[at] = mix((h[at] + base) ^ (raw[starts[at] + done] & LOW[np.minimum(left, 8)]))
        at, done = at[left > 8], done + 8
    for i in np.flatnonzero(lens > LONG).tolist():
        from xxhash import xxh3_64_intdigest

        h[i] = xxh3_64_intdigest(data[starts[i] : starts[i] + lens[i]].tobytes(), seed + 1)
    return h


def text_words(texts: list[bytes], lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and bounds: words of text i are bounds[i] to bounds[i + 1]."""
    data, offsets = join_texts(texts, lower)
    starts, lens = word_bounds(data)
    return run_hashes(data, starts, lens, seed), np.searchsorted(starts, offsets)
