"""Words of texts as flat arrays, for a whole Arrow batch at once.

A word is a run of Latin letters, digits and underscores, or one Chinese character, in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

WORD = "[a-z0-9_ß-öø-ɏ]+|[㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f]"
#: The same for SQL engines, which take no flags here.
WORD_SQL = "[a-z0-9_ß-öø-ɏ]+|[㐀-䶿一-鿿豈-﫿]"
_SEP = "\x01"
_FIND = re.compile(f"{WORD}|{_SEP}")
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], texts: tuple[str, ...], chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about so many characters; a longer text is a piece of its own."""
    for batch in batches:
        size = np.zeros(batch.num_rows, dtype=np.int64)
        for t in texts:
            size += pa.compute.fill_null(pa.compute.utf8_length(batch.column(t)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if total and total + n > chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For all words in order: the number of the text, the number of the word in the list of different words."""
    texts = [t.replace(_SEP, " ") if _SEP in t else t for t in texts]
    found = _FIND.findall(_SEP.join(texts).lower())
    codes, different = pd.factorize(np.array(found, dtype=object)) if found else (np.zeros(0, np.int64), np.array([], object))
    different = different.tolist()
    if _SEP in different:
        ends = codes == different.index(_SEP)
        rows = np.cumsum(ends)[~ends]
        codes = codes[~ends]
    else:
        rows = np.zeros(len(codes), np.int64)
    return rows, codes, different


def hashes(words: list[str], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def ordered(rows: np.ndarray, codes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text by the place of the word, which is one to one: text, code, and how often it came before."""
    by_place = np.empty(len(place), np.int64)
    by_place[place] = np.arange(len(place))
    key = np.sort((rows.astype(np.int64) << 32) | place[codes])
    rows, codes = key >> 32, by_place[key & 0xFFFFFFFF]
    at = np.arange(len(key))
    nth = at - np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0))
    return rows, codes, nth


def hashed(h: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """A hash of (word, how often it came before). Within a text all differ, so the words that texts share, counted with
    repeats, are the intersection of their hashes."""
    return mix(h + nth.astype(np.uint64) * GOLD)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For all words, by text: the number of the text and the hash of (word, how often it came before)."""
    rows, codes, different = flat(texts)
    if not len(rows):
        return rows, np.zeros(0, np.uint64)
    rows, codes, nth = ordered(rows, codes, np.arange(len(different)))
    return rows, hashed(hashes(different)[codes], nth)


def starts(rows: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
