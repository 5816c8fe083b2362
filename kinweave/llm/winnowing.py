"""Winnowed anchors of sequences of bytes or words: equal windows have equal anchors at equal offsets."""

from __future__ import annotations

import numpy as np

from kinweave.llm.shared import mix, substring_hashes


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours of an array of distinct keys: prefix and suffix minima of blocks."""
    n = len(keys)
    pad = -n % width
    blocks = np.concatenate((keys, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def runs_of_anchors(sums: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, last window, anchor's place) of every anchor's run of windows in a sequence of at least ``length``."""
    at = np.arange(len(sums) - anchor)
    grams = substring_hashes(sums, at, at + anchor)
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    owner = (sliding_argmin(keys, length - anchor + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    last = np.concatenate((first[1:], [len(owner)])) - 1
    return grams[owner[first]], first, last, owner[first]


def block_hashes(sums: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the blocks of runs of windows, unlike those of anchors."""
    return mix(substring_hashes(sums, first, last + length) ^ np.uint64(0xA0761D6478BD642F))
