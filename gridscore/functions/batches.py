"""Helpers for Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def grouped(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """For rows of these columns, a first row of each distinct one and every row's place among the distinct ones."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        coded = column.dictionary_encode(null_encoding="encode")
        # renumbered at each column, so that codes stay below rows times distinct values
        code = np.unique(code * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return first, code
