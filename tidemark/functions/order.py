"""Order statistics of sliding windows over sorted runs."""

from __future__ import annotations

import numpy as np

RUN = 2_048  # rows of a run


def sliding_rank(times: np.ndarray, values: np.ndarray, age: float, first: int = 0, max_entries: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows in the window, rows in it with a smaller value) for every row from `first` on.

    times ascend; the window of a row holds the rows of the last `age`, those of its own time included, and the newest
    max_entries of them if given. Runs of RUN rows are sorted once by value. A window counts in the runs that it covers by
    binary search and compares rows one by one only in the runs at its ends, so memory is that of the rows and a run.
    """
    n = len(times)
    own = np.arange(first, n)
    stop = np.searchsorted(times, times[own], "right")
    start = np.searchsorted(times, times[own] - age, "left")
    if max_entries is not None:
        start = np.maximum(start, stop - max_entries)
    below = np.zeros(len(own), dtype=np.int64)
    runs = [np.sort(values[at:at + RUN]) for at in range(0, n, RUN)]
    for at in range(0, len(own), RUN):
        part = slice(at, min(at + RUN, len(own)))
        v, a, b = values[own[part]], start[part], stop[part]
        for k in range(int(a.min()) // RUN, -(-int(b.max()) // RUN)):
            low, high = k * RUN, min((k + 1) * RUN, n)
            whole = (a <= low) & (b >= high)
            if whole.any():
                below[part][whole] += np.searchsorted(runs[k], v[whole], "left")
            edge = ~whole & (a < high) & (b > low)
            if edge.any():
                place = np.arange(low, high)
                inside = (place >= a[edge][:, None]) & (place < b[edge][:, None])
                below[part][edge] += (inside & (values[low:high] < v[edge][:, None])).sum(axis=1)
    return stop - start, below


def sliding_median_score(values: np.ndarray, first: int, window: int, min_samples: int) -> np.ndarray:
    """Robust z of each value from `first` on against up to `window` values before it; NaN below min_samples."""
    out = np.full(len(values) - first, np.nan)
    for k in range(first, len(values)):
        past = values[max(0, k - window):k]
        if len(past) >= min_samples:
            med = np.median(past)
            mad = np.median(np.abs(past - med))
            out[k - first] = (values[k] - med) / (1.4826 * mad) if mad > 0 else 0.0
    return out
