"""Problem 8: long exact spans that documents share.

A window of `least` characters is shared if another document holds it. The smallest hash of the k-mers in a window is its
seed; windows in a row with one seed make a run, and a run is all that travels: one row for some hundred characters. Runs
of equal text in two documents are matches at once. Where documents share a seed but their runs differ, only there, runs
are cut into blocks of windows by their distance from the seed, and a block whose core (what all its windows hold) is in no
other document is done with; where cores agree but blocks differ, only there, single windows are compared. No group is paired with itself: every occurrence is matched with one occurrence in another document
(the first or the last by document), which is enough for knowing what is shared. Matches of two documents are joined on
their diagonals; what is shared word for word is the union of these, which chains can neither add to nor take from. For
passages they are chained in order with gap costs through a Fenwick tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.llm import words
from querylens.llm.near import buckets
from querylens.operators.shared import cut, join_counted

LEAST, K = 300, 100
#: Blocks are of 2**SHIFT windows, fewer if windows are shorter than twice that.
SHIFT = 4
_B = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))


class Text:
    """Rolling hashes of all texts of a batch at once: prefix sums of characters times powers, modulo 2^64."""

    def __init__(self, texts: list[str]):
        self.n = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.r_[0, np.cumsum(self.n)]
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        power = np.cumprod(np.full(len(chars) + 1, _B))
        self.sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(words.mix(chars + np.uint64(0x632BE59BD9B4E019)) * power[:-1], out=self.sums[1:])
        self.inverse = np.cumprod(np.full(len(chars) + 1, _INVERSE))

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return words.mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo] + (hi - lo).astype(np.uint64) * words.GOLD)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def _runs(least: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, ("text",), 2_000_000):
            t = Text(batch.column("text").to_pylist())
            if len(t.sums) <= least:
                continue
            at = np.arange(len(t.sums) - k)
            seed = _least(t.hash(at, at + k), least - k + 1)
            at = at[: len(seed)]
            of = np.repeat(np.arange(len(t.n)), t.n)[: len(at)]
            inside = at + least <= t.begin[1:][of]
            first = inside & np.r_[True, ~inside[:-1] | (seed[1:] != seed[:-1]) | (of[1:] != of[:-1])]
            last = inside & np.r_[~inside[1:] | (seed[1:] != seed[:-1]) | (of[1:] != of[:-1]), True]
            lo, hi = at[first], at[last]
            if len(lo):
                o = of[lo]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(o)), pa.array(seed[lo].view(np.int64)), pa.array(t.hash(lo, hi + least).view(np.int64)), pa.array((lo - t.begin[o]).astype(np.int32)), pa.array((hi - t.begin[o]).astype(np.int32))],
                    ["doc", "seed", "content", "lo", "hi"],
                )

    return run


def _listed(batch: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Text]:
    """All windows of the runs of a batch: row, run, seed and place in the joined texts."""
    t = Text(batch.column("text").to_pylist())
    lists = batch.column("runs")
    of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    seed, lo, hi = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("seed", "lo", "hi"))
    hi = np.minimum(hi, t.n[of] - least)  # another text under the same id may be shorter
    n = np.maximum(hi - lo + 1, 0)
    run = np.repeat(np.arange(len(of)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return of[run], run, seed[run], place + t.begin[of[run]], t


def _blocks(least: int, k: int):
    """Rows (doc, seed, content, lo, hi) of blocks: seed is a hash of the run's seed, the block's distance and its core.

    A window's distance is to the first k-mer in it that is the seed, so equal windows have equal distances."""
    shift = max(0, min(SHIFT, (least // 2).bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, ("text",), 2_000_000):
            of, which, seed, at, t = _listed(batch, least)
            if not len(at):
                continue
            every = np.arange(len(t.sums) - k)
            grams = t.hash(every, every + k).view(np.int64)
            seeds = np.unique(seed)
            rank = np.minimum(np.searchsorted(seeds, grams), len(seeds) - 1)
            spots = np.flatnonzero(seeds[rank] == grams)
            ordered = np.sort(rank[spots] * len(grams) + spots)
            want = np.searchsorted(seeds, seed) * len(grams)
            first = ordered[np.minimum(np.searchsorted(ordered, want + at), max(0, len(ordered) - 1))] - want if len(ordered) else at - 1
            good = (first >= at) & (first <= at + least - k)
            of, which, seed, at, first = (x[good] for x in (of, which, seed, at, first))
            if not len(at):
                continue
            block = (first - at) >> shift
            begin = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1) | (first[1:] != first[:-1]) | (block[1:] != block[:-1])])
            lo, hi = at[begin], at[np.r_[begin[1:], len(at)] - 1]
            of, seed, first, block = of[begin], seed[begin], first[begin], block[begin]
            core = first - (block << shift)
            key = words.mix(seed.view(np.uint64) * words.GOLD + t.hash(core, core - (1 << shift) + 1 + least) + block.astype(np.uint64))
            content = words.mix(t.hash(lo, hi + least) + (first - lo).astype(np.uint64))
            start = t.begin[of]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(of)), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array((lo - start).astype(np.int32)), pa.array((hi - start).astype(np.int32))],
                ["doc", "seed", "content", "lo", "hi"],
            )

    return run


def _windows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, ("text",), 2_000_000):
            of, _, seed, at, t = _listed(batch, least)
            if len(at):
                place = pa.array((at - t.begin[of]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of)), pa.array(seed), pa.array(t.hash(at, at + least).view(np.int64)), place, place], ["doc", "seed", "content", "lo", "hi"])

    return run


def _matched(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row with one occurrence of the same content in another document."""
    other = F.when(F.col("first.doc") != F.col("doc"), F.col("first")).otherwise(F.col("last"))
    return join_counted(rows, groups, ["seed", "content"], "n").select("doc", "lo", "hi", other["doc"].alias("other"), other["lo"].alias("other_lo"))


def _grouped(rows: DataFrame) -> DataFrame:
    at = F.struct("doc", "lo", "hi")
    return rows.groupBy("seed", "content").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def _open(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (id, runs): by document what has to be compared in finer parts, which is where a seed is in several documents with
    several contents. Of contents in one document these are all occurrences, of contents in more the first and the last."""
    unlike = (
        groups.groupBy("seed").agg(F.count("*").alias("variants"), F.min("first.doc").alias("a"), F.max("last.doc").alias("b"))
        .where("variants > 1 and a != b").select("seed")
    )
    open_ = cut(groups.join(unlike, "seed", "left_semi"))
    within = rows.join(open_.where("first.doc = last.doc and n > 2").select("seed", "content"), ["seed", "content"], "left_semi").select("doc", "seed", "lo", "hi")
    ends = open_.select("seed", F.explode(F.array("first", "last")).alias("at")).select(F.col("at.doc").alias("doc"), "seed", F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"))
    return cut(ends.unionByName(within).distinct().groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("seed", "lo", "hi")).alias("runs")))


ROWS = "doc long, seed long, content long, lo int, hi int"


def matches(documents: DataFrame, least: int = LEAST, k: int = K) -> DataFrame:
    """Rows (doc, lo, hi, other, other_lo): the windows of doc that begin at lo to hi also stand in other, from other_lo on."""
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), "text").where(F.length("text") >= least)
    runs = cut(texts.mapInArrow(_runs(least, k), ROWS))
    groups = cut(_grouped(runs))
    found = _matched(runs, groups.where("first.doc != last.doc"))
    blocks = cut(texts.join(_open(runs, groups), "id").mapInArrow(_blocks(least, k), ROWS))
    groups = cut(_grouped(blocks))
    found = found.unionByName(_matched(blocks, groups.where("first.doc != last.doc")))
    windows = cut(texts.join(_open(blocks, groups), "id").mapInArrow(_windows(least), ROWS))
    return found.unionByName(_matched(windows, cut(_grouped(windows).where("first.doc != last.doc"))))


def chains(x: np.ndarray, y: np.ndarray, n: np.ndarray, gap: float = 0.05) -> np.ndarray:
    """The number of the chain of each segment (x, y, length), such that chains ascend in both texts.

    The best chain that ends in a segment is its length plus the best before it, less the cost of the gap between, which is
    a part of the characters skipped in both texts: that splits into a term for each end, so the best predecessor is a
    prefix maximum over y, held in a Fenwick tree while segments are taken by x. Chains are read off from the best down;
    each segment is in one chain, none is lost.
    """
    m = len(x)
    rank = {v: i + 1 for i, v in enumerate(sorted(set((y + n).tolist()) | set(y.tolist())))}
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(rank) + 1)
    score, before = [0.0] * m, [-1] * m
    events = sorted([(int(x[i]), 1, i) for i in range(m)] + [(int(x[i] + n[i]), 0, i) for i in range(m)])
    for _, begins, i in events:
        if begins:
            best, r = (0.0, -1), rank[int(y[i])]
            while r:
                if tree[r][1] >= 0 and (best[1] < 0 or tree[r][0] > best[0]):
                    best = tree[r]
                r -= r & -r
            gain = best[0] - gap * float(x[i] + y[i]) if best[1] >= 0 else 0.0
            score[i], before[i] = (float(n[i]) + gain, best[1]) if best[1] >= 0 and gain > 0 else (float(n[i]), -1)
        else:
            value, r = (score[i] + gap * float(x[i] + y[i] + 2 * n[i]), i), rank[int(y[i] + n[i])]
            while r < len(tree):
                if tree[r][1] < 0 or value[0] > tree[r][0]:
                    tree[r] = value
                r += r & -r
    chain = np.full(m, -1, np.int64)
    for c, i in enumerate(sorted(range(m), key=lambda j: -score[j])):
        while i >= 0 and chain[i] < 0:
            chain[i] = c
            i = before[i]
    return chain


def _segments(table: pa.Table, least: int, chained: bool = True):
    """Exact segments (doc, other, x, y, length, chain) of matches that are complete by doc; without chains all are 0."""
    doc, lo, hi, other, other_lo = (table.column(c).to_numpy() for c in ("doc", "lo", "hi", "other", "other_lo"))
    lo, end, shift = lo.astype(np.int64), hi.astype(np.int64) + least, other_lo.astype(np.int64) - lo
    order = np.lexsort((lo, shift, other, doc))
    doc, lo, end, other, shift = (v[order] for v in (doc, lo, end, other, shift))
    new = np.r_[True, (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]) | (shift[1:] != shift[:-1])]
    part = np.cumsum(new)
    far = np.int64(1) << 33
    reach = np.maximum.accumulate(end + part * far)  # parts are further apart than any position
    begin = new | np.r_[True, lo[1:] + part[1:] * far > reach[:-1]]
    s = np.flatnonzero(begin)
    stop = reach[np.r_[s[1:], len(doc)] - 1] - part[s] * far
    doc, other, x, y, n = doc[s], other[s], lo[s], lo[s] + shift[s], stop - lo[s]
    chain = np.zeros(len(s), np.int64)
    pair = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])]) if len(s) and chained else s[:0]
    for a, b in zip(pair, np.r_[pair[1:], len(s)][: len(pair)]):
        if b - a > 1:
            chain[a:b] = chains(x[a:b], y[a:b], n[a:b])
    return doc, other, x, y, n, chain


def _stretches(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in buckets(batches, ("doc",), 50_000):
            doc, _, x, _, n, _ = _segments(table, least, chained=False)
            order = np.lexsort((x, doc))
            doc, x, end = doc[order], x[order], (x + n)[order]
            new = np.r_[True, doc[1:] != doc[:-1]]
            far = np.cumsum(new) * (np.int64(1) << 33)
            reach = np.maximum.accumulate(end + far)
            s = np.flatnonzero(new | np.r_[True, x[1:] + far[1:] > reach[:-1]])
            stop = reach[np.r_[s[1:], len(doc)] - 1] - far[s]
            yield pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(x[s]), pa.array(stop)], ["doc_id", "span_start", "span_end"])

    return run


def _passages(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in buckets(batches, ("doc",), 50_000):
            doc, other, x, y, n, chain = _segments(table, least)
            order = np.lexsort((x, chain, other, doc))
            doc, other, x, y, n, chain = (v[order] for v in (doc, other, x, y, n, chain))
            s = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]) | (chain[1:] != chain[:-1])])
            e = np.r_[s[1:], len(doc)] - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (doc[s], other[s], x[s], np.maximum.reduceat(x + n, s), np.minimum.reduceat(y, s), np.maximum.reduceat(y + n, s), np.add.reduceat(n, s), (e - s + 1).astype(np.int64))],
                ["doc_id", "other_id", "span_start", "span_end", "other_start", "other_end", "exact_chars", "n_parts"],
            )

    return run


def _by_doc(found: DataFrame) -> DataFrame:
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "doc").sortWithinPartitions("doc")


def shared_spans(documents: DataFrame, least: int = LEAST, k: int = K) -> DataFrame:
    """Rows (doc_id, span_start, span_end): the longest stretches of characters that lie in some run of at least so many
    characters which another document holds exactly so. Touching stretches are one.

    Null and shorter texts have none. Rows with the same doc_id are one document: what only they share is not shared, and
    their stretches are merged by position.
    """
    return _by_doc(matches(documents, least, k)).mapInArrow(_stretches(least), "doc_id long, span_start long, span_end long")


def passages(documents: DataFrame, least: int = LEAST, k: int = K) -> DataFrame:
    """Rows for chains of exact parts in order, with changed text between them: fuzzy passages of two documents.

    Each document is compared with the documents that stand for all that hold the same text (the first or last by id)."""
    return _by_doc(matches(documents, least, k)).mapInArrow(_passages(least), "doc_id long, other_id long, span_start long, span_end long, other_start long, other_end long, exact_chars long, n_parts long")


def shares(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows (doc_id, n_chars, shared_chars) for every document; null texts count as empty."""
    spans = shared_spans(documents, least).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    return documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")).join(spans, "doc_id", "left").fillna({"shared_chars": 0})
