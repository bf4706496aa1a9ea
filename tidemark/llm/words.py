"""Words of an Arrow column of texts as numpy arrays, straight from their bytes.

Words are the runs of ASCII letters, digits and whatever is beyond ASCII, lower
case.  In UTF-8 that is a test of single bytes, so no regular expression is needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ship

ship(__name__)

_BASE = 0x9E3779B97F4A7C15
#: Bytes of text handled at once in a task; a longer text is handled alone.
PIECE = 1 << 20
_BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2^64."""
    def run(base: int) -> np.ndarray:
        return np.r_[np.uint64(1), np.cumprod(np.full(max(n - 1, 0), base, np.uint64))][:n].astype(np.uint64)

    return run(_BASE), run(pow(_BASE, -1, 2**64))


_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: For bytes.translate: whatever is not part of a word becomes a space.
BLANK = bytes(i if _INSIDE[i] else 32 for i in range(256))
_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_UP, _DOWN = powers(_BLOCK)


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the lower-cased texts; a null is empty."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    kind = np.int64 if pa.types.is_large_string(low.type) else np.int32
    offsets = np.frombuffer(low.buffers()[1], kind)[low.offset : low.offset + len(low) + 1].astype(np.int64) if len(low) else np.zeros(1, np.int64)
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, a = np.zeros(len(starts), np.uint64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _BLOCK, "right")))
        first, last = starts[a], ends[b - 1]
        up, down = (_UP, _DOWN) if last - first <= _BLOCK else powers(int(last - first))
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_OF_BYTE[data[first:last]] * up[: last - first], out=sums[1:])
        l, r = starts[a:b] - first, ends[a:b] - first
        out[a:b] = mix((sums[r] - sums[l]) * down[l] + (r - l).astype(np.uint64))
        a = b
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the 64-bit hash of every word, and the bounds of each text among them."""
    data, bounds = lowered(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = _INSIDE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    # A word does not go on into the next text.
    own = bounds[:-1][np.diff(bounds) > 0]
    before[own] = False
    after[own[1:] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return _hashes(data, starts, ends), np.searchsorted(starts, bounds)


def pieces(texts: pa.Array):
    """(begin, end) of runs of rows with about ``PIECE`` bytes of text."""
    sizes = np.cumsum(np.r_[0, pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)])
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(sizes, sizes[begin] + PIECE, "right")) - 1)
        yield begin, end
        begin = end


def words_of(texts: pa.Array):
    """The words of each text, as bytes."""
    for low in pc.utf8_lower(pc.fill_null(texts, "")):
        yield low.as_py().encode().translate(BLANK).split()
