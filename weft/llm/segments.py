"""Cut a text where byte-level tokenizers always cut, so that what lies between can be remembered.

Public byte-level BPE vocabularies split a text by a pattern in which a space or line end before a
non-space always starts a new piece: it either leads the next word or stands alone as the last of its
run. Tokens of the segments, encoded one by one and joined, are thus the tokens of the text. Arrow
cuts a batch of texts and numbers its distinct segments; only these are looked up, the unknown ones are
encoded in one call, and numpy lays out the ids of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space or line end after which no cut is certain: only characters that no library takes for white
#: space count as non-space. A text with such a spot is encoded whole.
UNSAFE = "[ \n](?:[^!-~À-ɏ]|\\z)"
SAFE = "^[!-~À-ɏ]"
#: Characters (bytes) of texts that are cut at once.
CHUNK = 3 << 20


def slices(texts: pa.Array, size: int = CHUNK) -> Iterator[pa.Array]:
    """Runs of rows whose texts hold about ``size`` bytes; a longer text is a run of its own."""
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts`` and have ``sizes``, one after the other."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def listed(segments: pa.Array) -> list[str]:
    """The segments, none of which holds a space, as Python strings."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(segments)], pa.int32()), segments)
    return pc.binary_join(whole, " ")[0].as_py().split(" ")


class SegmentCodes:
    """Ids of texts as ``dtype``; subclasses encode.

    The memory has two generations of up to ``limit`` segments each; what is met again moves to the
    younger, and the older is dropped when the younger is full. None is longer than ``longest``.
    """

    def __init__(self, dtype: str, limit: int = 250_000, longest: int = 64):
        self.dtype, self.limit, self.longest = np.dtype(dtype), limit, longest
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        raise NotImplementedError

    def learn(self, names: list[str]) -> list[bytes]:
        """Ids of segments; a name is a segment that starts with a line end, or lacks the space it starts with."""
        raise NotImplementedError

    def found(self, names: list[str]) -> list[bytes]:
        """Ids of distinct segments, from memory or learned."""
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        out = list(map(self.known.get, names))
        missing = [k for k, ids in enumerate(out) if ids is None]
        new, older = [], self.older
        for k in missing:
            if (ids := older.get(names[k])) is None:
                new.append(k)
            else:
                out[k] = ids
        if new:
            for k, ids in zip(new, self.learn([names[k] for k in new])):
                out[k] = ids
        self.known.update([(names[k], out[k]) for k in missing if len(names[k]) <= self.longest])
        return out

    def cut_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are safe to cut, and how many each has."""
        # the first segment is named as if a line end stood before it, whose id is left out again
        lines = pc.replace_substring(texts, "\n", " \n")
        parts = pc.split_pattern(pc.binary_join_element_wise("\n", lines, ""), " ")
        flat = parts.flatten().dictionary_encode()
        ids = self.found(listed(flat.dictionary))
        values = np.frombuffer(b"".join(ids), self.dtype)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        code = flat.indices.to_numpy()
        sizes, starts = size[code], (np.cumsum(size) - size)[code]
        first = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        sizes[first] -= 1
        starts[first] += 1
        return gather(values, starts, sizes), np.add.reduceat(sizes, first)

    def runs(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some texts in order, how many each of them has), until all are done; null is empty."""
        for some in slices(pc.fill_null(texts.cast(pa.string()), "")):
            safe = pc.and_(pc.match_substring_regex(some, SAFE), pc.invert(pc.match_substring_regex(some, UNSAFE)))
            inside, sizes = self.cut_texts(some.filter(safe)) if pc.any(safe).as_py() else (np.empty(0, self.dtype), np.empty(0, np.int64))
            if pc.all(safe).as_py():
                yield inside, sizes
                continue
            ends, rest = np.cumsum(sizes), iter(some.filter(pc.invert(safe)).to_pylist())
            out, k = [], 0
            for ok in safe.to_pylist():
                out.append(inside[ends[k] - sizes[k] : ends[k]] if ok else np.frombuffer(self.whole(next(rest)), self.dtype))
                k += ok
            yield np.concatenate(out), np.array([len(x) for x in out], np.int64)
        pa.default_memory_pool().release_unused()  # workers may outnumber tasks

    def of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes."""
        out: list[bytes] = []
        for ids, sizes in self.runs(pa.array(texts, pa.string())):
            ends = np.cumsum(sizes)
            out += [ids[e - n : e].tobytes() for n, e in zip(sizes.tolist(), ends.tolist())]
        return out
