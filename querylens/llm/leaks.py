"""Problem 6: held-out passages inside documents.

Item windows, and document windows of the same length or, if uneven, up to as many words shorter or longer as edits are allowed, are embedded by the walk of Chakraborty, Goldenberg and Koucky: it reads a
window once, and at each of three times as many steps puts out the word it stands on and, by a random bit of step and
word, stays or moves on. Windows at a small edit distance get embeddings at a small Hamming distance, so sampled steps agree; equal windows
always agree. Each repetition hashes some sampled steps, windows that meet an item's hash are checked by
edit distance, many at once, and what is found word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.llm import words
from querylens.operators.shared import cut

WINDOW = 12
#: Steps sampled in a repetition, and the stretch of the walk that they are sampled from.
STEPS, SPAN = 5, 10
#: Characters of passages in one block, which bounds what is collected and broadcast; one longer passage is a block itself.
BLOCK_CHARS = 8_000_000
#: Pairs of windows that are compared at once.
CANDIDATES = 100_000


def _planted(window: int, kinds: tuple[str, ...], n: int, seed: int) -> tuple[np.ndarray, list[list[int]]]:
    """So many random windows and each with one edit of every kind in kinds, as hashes of words."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, (n, window), dtype=np.uint64)
    edited = []
    for row in a.tolist():
        for kind in kinds:
            at, word = int(rng.integers(0, len(row))), int(rng.integers(1, 2**63))
            row[at : at + (kind != "insert")] = [] if kind == "drop" else [word]
        edited.append(row)
    return a, edited


def measured_recall(window: int, kinds: tuple[str, ...], plan_: list[np.ndarray], n: int = 2000, seed: int = 5) -> float:
    """The part of planted windows that meet their originals in some repetition."""
    a, edited = _planted(window, kinds, n, seed)
    size = np.fromiter(map(len, edited), np.int64, n)
    h, codes = np.unique(np.r_[a.ravel(), np.fromiter((w for e in edited for w in e), np.uint64, int(size.sum()))], return_inverse=True)
    at, other = np.arange(n) * window, n * window + np.cumsum(size) - size
    met = np.zeros(n, bool)
    for r, steps in enumerate(plan_):
        mine = walks(h, codes, at, [window], steps, r)[0]
        for s in np.unique(size):
            of = size == s
            met[of] |= mine[of] == walks(h, codes, other[of], [int(s)], steps, r)[0]
    return float(met.mean())


def edits_of(edits: int, uneven: bool) -> list[tuple[str, ...]]:
    """The kinds of edits that windows within the distance may have."""
    kinds = [c for c in combinations_with_replacement(("replace", "insert", "drop"), edits)]
    return kinds if uneven else [k for k in kinds if k.count("insert") == k.count("drop")] or [("replace",) * edits]


@lru_cache(maxsize=16)
def _plan(window: int, edits: int, recall: float, seed: int, uneven: bool) -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(seed)
    if edits == 0:
        return (np.sort(rng.choice(3 * window, window, replace=False)),)
    span = min(SPAN, 2 * window)
    for n in range(2, 200):
        first = [round((2 * window - span) * i / (n - 1)) for i in range(n)]
        steps = tuple(np.sort(f + rng.choice(span, min(STEPS, span), replace=False)) for f in first)
        if all(measured_recall(window, k, steps) >= recall + 0.01 for k in edits_of(edits, uneven)):
            return steps
    raise ValueError(f"no plan reaches a recall of {recall} with {edits} edits in {window} words")


def plan(window: int, edits: int, recall: float, seed: int, uneven: bool = False) -> list[np.ndarray]:
    """The sampled steps of each repetition, in order. Equal windows agree on all steps, so without edits one repetition that
    samples as many steps as words finds all. With edits each repetition samples some steps of one stretch of the walk, and
    stretches lie evenly over the steps in which a window is walked: an edit disturbs those around it. There are as many
    repetitions as planted windows need that every kind of edit is found with the recall, measured each time."""
    return list(_plan(window, edits, recall, seed, uneven))


def walks(hashes: np.ndarray, codes: np.ndarray, at: np.ndarray, sizes: range | list[int], steps: np.ndarray, seed: int) -> list[np.ndarray]:
    """For each size a hash of the sampled steps of the walks over the windows of so many words that begin at these places of
    codes, which number the hashes. Windows of all sizes move alike; past its end a window has the word 0."""
    h, last = hashes[codes], len(codes) - 1
    place, keys = at.copy(), [np.zeros(len(at), np.uint64) for _ in sizes]
    sampled = set(steps.tolist())
    for j in range(int(steps[-1]) + 1):
        if j in sampled:
            on, moved = h[np.minimum(place, last)], place - at
            keys = [words.mix(k * words.GOLD + np.where(moved < size, on, np.uint64(0)) + np.uint64(1)) for k, size in zip(keys, sizes)]
        moves = ((words.mix(hashes ^ np.uint64((seed * 1_000_003 + j + 1) * 0x9E3779B9 & (2**64 - 1))) >> np.uint64(17)) & np.uint64(1)).astype(np.int8)
        place += np.append(moves[codes], np.int8(0))[np.minimum(place, last + 1)]
    return keys


def edit_distance(a: list[str], b: list[str], most: int) -> int:
    """Words inserted, dropped or replaced; most + 1 if more than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def distances(h: np.ndarray, at: np.ndarray, size: int, grams: np.ndarray, w: np.ndarray, most: int) -> np.ndarray:
    """The edit distances of the windows of size words from these places of h and the item windows w, all at once, by hashes
    of words; any number above most if more than most."""
    far = np.full(len(at), most + 1, np.int16)
    row = {j: np.full(len(at), j, np.int16) for j in range(min(size, most) + 1)}
    mine = {j: h[at + j - 1] for j in range(1, size + 1)}
    for i in range(1, grams.shape[1] + 1):
        word, new = grams[w, i - 1], {}
        for j in range(max(0, i - most), min(size, i + most) + 1):
            least = np.minimum(row.get(j, far), new.get(j - 1, far)) + np.int16(1)
            new[j] = least if j == 0 else np.minimum(least, row.get(j - 1, far) + (word != mine[j]))
        row = new
    return row.get(size, far)


def _items(ids: list[int], passages: list[str], window: int, steps: list[np.ndarray]) -> dict:
    rows, codes, different = words.flat(passages)
    hashes = words.hashes(different)
    h = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    at = np.arange(max(0, len(rows) - window + 1))
    at = at[rows[at] == rows[at + window - 1]] if len(at) else at
    keys = []
    for r, s in enumerate(steps):
        k = walks(hashes, codes, at, [window], s, r)[0] if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(k, kind="stable")
        keys.append((k[order], order))
    return {"keys": keys, "ids": np.array(ids, np.int64)[rows[at]] if len(at) else np.zeros(0, np.int64), "codes": codes[at[:, None] + np.arange(window)], "words": different, "grams": h[at[:, None] + np.arange(window)], "known": np.sort(words.hashes(different))}


def _scan(block, window: int, edits: int, steps: list[np.ndarray], slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value
        known = items["known"]
        for batch in words.slices(batches, ("text",)):
            rows, codes, different = words.flat([t or "" for t in batch.column("text").to_pylist()])
            if len(rows) < window - slack or not len(items["ids"]):
                continue
            hashes = words.hashes(different)
            strange = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] != hashes
            h, strange = hashes[codes], np.r_[0, np.cumsum(strange[codes])]
            sizes = range(max(1, window - slack), window + slack + 1)
            at = np.arange(len(rows) - sizes[0] + 1)
            fits = []
            for size in sizes:
                end = np.minimum(at + size, len(rows))
                # a word that no item holds costs an edit, so this loses nothing
                fits.append((at + size <= len(rows)) & (strange[end] - strange[at] <= edits) & (rows[at] == rows[end - 1]))
            begin = at[np.any(fits, axis=0)]
            fits = [f[begin] for f in fits]
            docs = batch.column("id").to_pylist()
            best: dict[tuple[int, int], int] = {}
            of_all = ((r, size, begin[fit], mine[fit]) for r, s in enumerate(steps) for size, fit, mine in zip(sizes, fits, walks(hashes, codes, begin, sizes, s, r)))
            for r, size, at, mine in of_all:
                keys, order = items["keys"][r]
                lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                met = np.flatnonzero(hi > lo)
                size_of = (hi - lo)[met]
                upto = np.cumsum(size_of)
                for part in np.split(met, np.searchsorted(upto, np.arange(CANDIDATES, int(upto[-1]) if len(met) else 0, CANDIDATES))):
                    n = (hi - lo)[part]
                    x = np.repeat(part, n)
                    w = order[np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[part], n)]
                    d = distances(h, at[x], size, items["grams"], w, edits)
                    near = np.flatnonzero(d <= edits)
                    near = near[np.argsort(d[near], kind="stable")]
                    for i, p, q in zip(d[near].tolist(), at[x[near]].tolist(), w[near].tolist()):
                        pair = (int(items["ids"][q]), docs[rows[p]])
                        if i < best.get(pair, edits + 1):
                            i = edit_distance([different[c] for c in codes[p : p + size].tolist()], [items["words"][c] for c in items["codes"][q].tolist()], edits)
                            if i < best.get(pair, edits + 1):
                                best[pair] = i
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in best], pa.int64()), pa.array([p[1] for p in best], pa.int64()), pa.array(list(best.values()), pa.int32())], ["item_id", "doc_id", "edits"])

    return run


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, edits: int = 0, recall: float = 0.95, seed: int = 1, uneven: bool = False) -> DataFrame:
    """Rows (item_id, doc_id, edits): some window of the document is at most so many word edits from a window of the item.
    Windows of the document have the item windows' length, so a word inserted or dropped costs two edits but at the ends;
    with uneven, also those up to edits words shorter or longer, so it costs one.

    With edits = 0 equal windows always meet, so recall is 1. Passages shorter than the window are in no case, nor are null
    texts and rows without an id; a repeated item_id or doc_id counts as one with all its texts. edits is the least number
    found. Items are taken in blocks of bounded size, one after the other, each against all documents.
    """
    sides = items.where("item_id is not null and passage is not null").select(F.col("item_id").cast("long").alias("item_id"), "passage")
    total = sides.agg(F.sum(F.length("passage"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_CHARS))
    steps = plan(window, edits, recall, seed, uneven)
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    found = None
    for b in range(blocks):
        part = sides.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == b).toArrow().to_pydict()
        block = documents.sparkSession.sparkContext.broadcast(_items(part["item_id"], part["passage"], window, steps))
        some = texts.mapInArrow(_scan(block, window, edits, steps, edits if uneven else 0), "item_id long, doc_id long, edits int")
        if blocks > 1:  # one block at a time is held by driver and executors
            some = cut(some)
            block.destroy()
        found = some if found is None else found.unionByName(some)
    return found.groupBy("item_id", "doc_id").agg(F.min("edits").alias("edits"))
