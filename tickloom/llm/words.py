"""Words of whole texts as codes and hashed features, a batch of texts at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Marks that are stripped from the ends of a word.
MARKS = ".,;:!?\"'()[]{}<>«»„“”‘’¿¡…*%&$#@|~^=+_/\\-"


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Code of each white-space separated word, first word of each text (and the end), and the words that codes name.

    Nulls count as empty; a text without words has none.
    """
    parts = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), "")))
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    coded = parts.flatten().dictionary_encode()
    names, codes = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
    starts = np.asarray(parts.offsets).astype(np.int64)
    starts = starts - starts[0]
    if len(names) and pc.any(pc.equal(names, "")).as_py():  # an empty text splits into one empty word
        empty = np.asarray(pc.equal(names, ""))[codes]
        kept = np.concatenate([[0], np.cumsum(~empty)])
        codes, starts = codes[~empty], kept[starts]
    return codes, starts, names


def hashed(strings: pa.Array, salt: str) -> np.ndarray:
    """Stable 64-bit hashes of strings; other salts give independent ones."""
    values = strings.to_pandas().to_numpy(object)
    return pd.util.hash_array(values, hash_key=salt.ljust(16, "0")[:16], categorize=False) if len(values) else np.zeros(0, np.uint64)


def totals(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; ``starts`` as from ``split``."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[starts[1:]] - sums[starts[:-1]]
