"""Local alignment of word sequences, a row at a time in the memory of two rows of the band."""

from __future__ import annotations

import numpy as np

_UNIT = 1 << 20  # a cell is its score times this, and the number of matched words


def _pass(a: np.ndarray, b: np.ndarray, centre: int | None, half: int, scores: tuple[int, int, int], anchored: bool):
    """The best cell (value, i, j). Anchored paths begin before the first words of both; others anywhere."""
    hit, miss, gap = scores[0] * _UNIT + 1, scores[1] * _UNIT, scores[2] * _UNIT
    n, m, nowhere = len(a), len(b), -(1 << 60) if anchored else 0
    slope = gap * np.arange(m + 1, dtype=np.int64)
    before, row = np.full(m + 2, nowhere, np.int64), np.full(m + 2, nowhere, np.int64)
    if anchored:
        end = m if centre is None else min(m, centre + half)
        before[: end + 1] = slope[: end + 1]
    best = (0, 0, 0)
    for i in range(1, n + 1):
        low, high = (1, m) if centre is None else (max(1, i + centre - half), min(m, i + centre + half))
        if low > high:
            if low > m:
                break
            before, row = row, before
            continue
        x = np.maximum(before[low - 1 : high] + np.where(b[low - 1 : high] == a[i - 1], hit, miss), before[low : high + 1] + gap)
        if not anchored:
            np.maximum(x, 0, out=x)
        elif low == 1:
            row[0] = i * gap if centre is None or abs(i + centre) <= half else nowhere
            x[0] = max(x[0], row[0] + gap)
        x = np.maximum.accumulate(x - slope[: len(x)]) + slope[: len(x)]
        row[low : high + 1] = x
        k = int(np.argmax(x))
        if x[k] > best[0]:
            best = (int(x[k]), i, low + k)
        before, row = row, before
    return best


def smith_waterman(a: np.ndarray, b: np.ndarray, centre: int | None = None, half: int = 0, match: int = 2, mismatch: int = -1, gap: int = -1):
    """Best local alignment of a and b: (score, matched words of a, a start, a end, b start, b end).

    Of equal scores, one with the most matched words. With `centre` and `half` only cells with |j - i - centre| <= half
    count, and only these are computed. A second pass, backwards from the end of the best alignment, finds its start.
    """
    scores = (match, mismatch, gap)
    value, i, j = _pass(a, b, centre, half, scores, False)
    if not value:
        return 0, 0, 0, 0, 0, 0
    back = None if centre is None else j - i - centre
    _, x, y = _pass(a[:i][::-1], b[:j][::-1], back, half, scores, True)
    return value // _UNIT, value % _UNIT, i - x, i, j - y, j
