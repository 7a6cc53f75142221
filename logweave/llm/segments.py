"""Cut a batch of texts at blanks and code the distinct segments, so that per-segment work is done once a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def coded_segments(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Per text its slice of the codes (offsets), the codes of its blank-separated segments, and the distinct segments.

    A null is an empty text; an empty text has one empty segment, as ``"".split(" ")`` has.
    """
    offsets, codes, segments = segment_arrays(texts)
    return offsets, codes, segments.to_pylist()


def segment_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``coded_segments`` with the distinct segments left in Arrow."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.split_pattern(filled, pattern=" ")
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def ragged_gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[s:s+n]`` over all pairs, without a Python loop."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    kind = np.int32 if max(len(flat), int(ends[-1])) < 2**31 else np.int64
    at = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    at += np.arange(ends[-1], dtype=kind)
    return flat[at]
