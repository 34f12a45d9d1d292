"""Lower-cased letters of many texts in numpy: runs of anything else become one 0."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, begins): each text as 0, letters, with one 0 between words and after the last; and where each text begins."""
    lowered = ["\0" + t.lower() + "\0" for t in texts]
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    code[~letter_table()[code]] = 0
    ends = np.cumsum([len(t) for t in lowered])
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    if len(ends):
        keep[ends[:-1]] = True  # a text begins with its own 0
    kept = np.concatenate([[0], np.cumsum(keep)])
    return code[keep], kept[np.concatenate([[0], ends])].astype(np.int64)


def per_text(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; 0 for none."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[begins[1:]] - sums[begins[:-1]]
