"""Problem 1: groups of near-duplicate records, by tiled exact comparison of bit sketches.

Two rows are alike if the words they share, counted with repeats, are at least 17/20 of the words of the longer one.
With I shared words of a and b ones that means a + b - 2 I <= radius(a, b), and the bits in which two parity sketches
differ are never more than a + b - 2 I. So comparing sketches by exclusive-or and bit count loses no pair, as little as
skipping tiles whose own bit counts are further apart than the radius. Rows are laid into buckets that any alike partner
must share (prefix filtering by a counted order): a rare word is a bucket, frequent words are buckets in pairs. So buckets
stay small however often the words of a fixed vocabulary come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.llm import words
from querylens.llm.graph import components
from querylens.operators.shared import cut, forget, join_counted

PART = (17, 20)  # 85 %
#: Words are counted in so many cells, which bounds what is broadcast to 2**CELLS * 4 bytes.
CELLS = 20
#: A word counted at most so often is a bucket by itself, so no such bucket is larger.
RARE = 1024
#: Rows of more words make no pairs of words, whose number grows with the square.
LONG = 256
#: Rows of one cell of a bucket, rows of a tile, and near pairs a row from which a cell is dense: its links are proven where they
#: are found, so that they give a spanning forest and not all pairs.
BLOCK, TILE, DENSE = 16384, 16, 8
_PAIRS_AT_ONCE = 1 << 20


def least_shared(longer: np.ndarray) -> np.ndarray:
    return -(-longer * PART[0] // PART[1])


def radius(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b - 2 * least_shared(np.maximum(a, b))


def widest(n: np.ndarray) -> np.ndarray:
    """The largest radius with any partner."""
    return 2 * n * (PART[1] - PART[0]) // PART[1]


def texts_of(batch: pa.RecordBatch) -> list[str]:
    return [f"{a or ''}\n{b or ''}" for a, b in zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist())]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(1 << CELLS, np.int64)
    for batch in words.slices(batches, ("_a", "_b")):
        _, codes, different = words.flat(texts_of(batch))
        cells = (words.hashes(different) >> np.uint64(64 - CELLS)).astype(np.int64)
        np.add.at(n, cells, np.bincount(codes, minlength=len(different)))
    cell = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n[cell])], ["cell", "n"])


def summed(counted: DataFrame) -> np.ndarray:
    """The sums of rows (cell, n) by cell, of 2**CELLS cells."""
    cells = counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(1 << CELLS, np.int64)
    count[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return np.minimum(count, 2**31 - 1).astype(np.int32)


def word_counts(texts: DataFrame) -> np.ndarray:
    """How often the words of all rows (_a, _b) fall into each of 2**CELLS cells."""
    return summed(texts.mapInArrow(_count, "cell int, n long"))


def in_order(texts: list[str], count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text by one order of all words, rare ones first: text, hash of (word, how often it came before), count and
    how often it came before."""
    rows, codes, different = words.flat(texts)
    h = words.hashes(different)
    often = count[(h >> np.uint64(64 - CELLS)).astype(np.int64)]
    place = np.empty(len(h), np.int64)
    place[np.lexsort((h, often))] = np.arange(len(h))
    rows, codes, nth = words.ordered(rows, codes, place) if len(rows) else (rows, codes, codes)
    return rows, words.hashed(h[codes], nth), often[codes], nth


def sketches(rows: np.ndarray, t: np.ndarray, m: int) -> dict[str, np.ndarray]:
    """By text the sums k1, k2 of its words' hashes and the parity sketch s1, s2, two times 64 bits."""
    out = {k: np.zeros(m, np.uint64) for k in ("k1", "k2", "s1", "s2")}
    if len(rows):
        begin = words.starts(rows)
        full = rows[begin]
        other = words.mix(t ^ np.uint64(0x5851F42D4C957F2D))
        out["k1"][full], out["k2"][full] = np.add.reduceat(t, begin), np.add.reduceat(other, begin)
        bit = np.uint64(1) << (other & np.uint64(63))
        side = (other >> np.uint64(6)) & np.uint64(1)
        out["s1"][full] = np.bitwise_xor.reduceat(np.where(side == 0, bit, np.uint64(0)), begin)
        out["s2"][full] = np.bitwise_xor.reduceat(np.where(side == 1, bit, np.uint64(0)), begin)
    return out


def _keys(rows: np.ndarray, t: np.ndarray, often: np.ndarray, n: np.ndarray, rare: int, long: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The buckets of each row: (row, key) of rare words, and of pairs of others, whose size nothing bounds.

    Alike rows share one of the first n - least_shared(n) + 1 words, and two of the first n - least_shared(n) + 2. If the
    first word they share is rare, they meet there; if not, the first two are both frequent, and they meet on these. Rows
    of up to `long` words meet on pairs, longer ones on single words, and rows from 17/20 of `long` on do both, so no
    pair falls between."""
    begin = words.starts(rows)
    at = np.arange(len(rows)) - np.repeat(begin, np.diff(np.r_[begin, len(rows)]))
    first = n - least_shared(n) + 1
    head = at < first[rows]
    few = head & (often <= rare)
    lone = head & (often > rare) & (n[rows] * PART[1] > long * PART[0])
    of, key = [rows[lone]], [words.mix(t[lone] ^ np.uint64(0x2545F4914F6CDD1D))]
    i = np.flatnonzero((at < first[rows] + 1) & (often > rare) & (n[rows] <= long))
    lag = 0
    while len(i):
        lag += 1
        i = i[i + lag < len(rows)]
        i = i[(rows[i + lag] == rows[i]) & (at[i + lag] <= first[rows[i]])]
        of.append(rows[i])
        key.append(words.mix(t[i] * words.GOLD + t[i + lag]))
    return (rows[few], t[few]), (np.concatenate(of), np.concatenate(key))


def _listed(of: np.ndarray, x: np.ndarray, m: int) -> pa.ListArray:
    order = np.argsort(of, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=m))].astype(np.int32)), pa.array(x[order].view(np.int64)))


def _describe(counts, rare: int, long: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counts.value
        for batch in words.slices(batches, ("_a", "_b")):
            m = batch.num_rows
            rows, t, often, _ = in_order(texts_of(batch), count)
            n = np.bincount(rows, minlength=m).astype(np.int64)
            out = sketches(rows, t, m)
            keys = _keys(rows, t, often, n, rare, long) if len(rows) else ((rows, t), (rows, t))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(out[k].view(np.int64)) for k in ("k1", "k2")), pa.array(n.astype(np.int32)), *(pa.array(out[k].view(np.int64)) for k in ("s1", "s2")), *(_listed(*k, m) for k in keys)],
                ["id", "k1", "k2", "n", "s1", "s2", "keys", "open_keys"],
            )

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches, ("_a", "_b")):
        rows, t = words.tokens(texts_of(batch))
        t = t[np.lexsort((t, rows))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), _listed(rows, t, batch.num_rows)], ["id", "tokens"])


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def buckets(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int) -> Iterator[pa.Table]:
    """Whole buckets of sorted batches, at least so many rows at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(table.num_rows, bool)
        for k in keys:
            c = table.column(k).to_numpy()
            same &= c == c[-1]
        end = table.num_rows - int(same.sum())
        if end:
            yield table.slice(0, end)
            held = table.slice(end).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def tiles(cell: np.ndarray, n: np.ndarray, s1: np.ndarray, s2: np.ndarray, tile: int, apart: np.ndarray | None = None, dense: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, full): pairs of rows of one cell whose sketches lie within the radius, and by cell whether it is dense.

    Rows are sorted by cell and bit count and cut into tiles of so many rows, whatever the cells. Each tile is compared with
    itself and those behind it, all tiles at once, by exclusive-or and bit count; a tile stops at the end of its last cell
    and where bit counts lie beyond the radius. Rows with one number in `apart` aren't compared. A cell with more than
    `dense` near pairs a row is dense; its pairs are left out."""
    size = np.bincount(cell)
    near, full = np.zeros(len(size), np.int64), np.zeros(len(size), bool)
    ones = np.bitwise_count(s1).astype(np.int32) + np.bitwise_count(s2)
    order = np.lexsort((ones, cell))
    order = order[size[cell[order]] > 1]
    if not len(order):
        return order, order, full
    pad = -len(order) % tile
    whole = np.r_[order, np.full(pad, order[-1])].reshape(-1, tile)
    real = np.r_[np.ones(len(order), bool), np.zeros(pad, bool)].reshape(-1, tile)
    c, o, most = cell[whole], ones[whole], widest(n[whole]).max(axis=1)
    a, b = s1[whole], s2[whole]
    live, lag, found = np.arange(len(whole)), 0, []
    upper = np.triu(np.ones((tile, tile), bool), 1)
    while len(live):
        other = live + lag
        if lag:
            live, other = live[other < len(whole)], other[other < len(whole)]
            keep = (c[live, -1] == c[other, 0]) & (o[other, 0] - o[live, -1] <= most[live]) & ~full[c[live, -1]]
            live, other = live[keep], other[keep]
        for lo in range(0, len(live), max(1, _PAIRS_AT_ONCE // (tile * tile))):
            p, q = (x[lo : lo + max(1, _PAIRS_AT_ONCE // (tile * tile))] for x in (live, other))
            differ = np.bitwise_count(a[p][:, :, None] ^ a[q][:, None, :]) + np.bitwise_count(b[p][:, :, None] ^ b[q][:, None, :])
            fits = (differ <= np.minimum(most[p], 255).astype(np.uint8)[:, None, None]) & (c[p][:, :, None] == c[q][:, None, :])
            i, u, v = np.nonzero(fits if lag else fits & upper)
            x, y = whole[p[i], u], whole[q[i], v]
            good = real[p[i], u] & real[q[i], v] & (differ[i, u, v] <= radius(n[x], n[y]))
            if apart is not None:
                good &= apart[x] != apart[y]
            if good.any():
                found.append(np.stack([x[good], y[good]]))
                if dense is not None:
                    near += np.bincount(cell[x[good]], minlength=len(near))
                    full |= near > dense * size
        lag += 1
    x, y = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    keep = ~full[cell[x]]
    return x[keep], y[keep], full


NEAR = "a long, b long, key long, cell long, n int, s1 long, s2 long, label long"


def _near(dense: int, tile: int):
    """Candidate pairs (a, b) within the cells of buckets; for dense cells their rows (a, key, cell, n, s1, s2, label) instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = lambda m, kind: pa.nulls(m, kind)
        for table in buckets(batches, ("key", "cell"), 100_000):
            key, part, ident, label, n, s1, s2 = _numbers(table, "key", "cell", "id", "label", "n", "s1", "s2")
            order = np.lexsort((part, key))
            key, part, ident, label, n, s1, s2 = (v[order] for v in (key, part, ident, label, n.astype(np.int32), s1.view(np.uint64), s2.view(np.uint64)))
            cell = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]) - 1
            x, y, full = tiles(cell, n, s1, s2, tile, label, dense)
            if len(x):
                both = np.unique(np.stack([np.minimum(ident[x], ident[y]), np.maximum(ident[x], ident[y])]), axis=1)
                m = both.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.int32()), *(none(m, pa.int64()) for _ in range(3))], [c.split()[0] for c in NEAR.split(", ")])
            rows = np.flatnonzero(full[cell])
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(ident[rows]), none(len(rows), pa.int64()), *(pa.array(v[rows]) for v in (key, part, n)), *(pa.array(v[rows].view(np.int64)) for v in (s1, s2)), pa.array(label[rows])], [c.split()[0] for c in NEAR.split(", ")])

    return run


class _Trees:
    """What a task has linked so far; rows of one tree need no further proof."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def top(self, x: int) -> int:
        root = self.root
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    def tops(self, x: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.top, x.tolist()), np.int64, len(x))


def _forest(tile: int):
    """Links of a spanning forest of each dense cell, whose rows carry their words: tiles are compared as in tiles(), pairs of
    rows of one tree are passed over, and all near ones of a row are proven at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _Trees()
        for table in buckets(batches, ("key", "cell"), 1):
            key, part, ident, label, n, s1, s2 = _numbers(table, "key", "cell", "id", "label", "n", "s1", "s2")
            lists = table.column("tokens").combine_chunks()
            flat, at = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            s = np.stack([s1.view(np.uint64), s2.view(np.uint64)])
            ones, n = np.bitwise_count(s).sum(axis=0).astype(np.int32), n.astype(np.int32)
            for x, t in zip(ident.tolist(), label.tolist()):  # rows that earlier links have joined
                p, q = trees.top(x), trees.top(t)
                trees.root[p] = q
            links: list[np.ndarray] = []
            order = np.lexsort((ones, part, key))
            begin = np.flatnonzero(np.r_[True, (key[order][1:] != key[order][:-1]) | (part[order][1:] != part[order][:-1])])
            for lo, hi in zip(begin, np.r_[begin[1:], len(key)]):
                rows = order[lo:hi]
                for p in range(0, len(rows), tile):
                    a = rows[p : p + tile]
                    ta = trees.tops(ident[a])
                    for q in range(p, len(rows), tile):
                        b = rows[q : q + tile]
                        if ones[b[0]] - ones[a[-1]] > widest(n[a]).max():
                            break
                        tb = trees.tops(ident[b])
                        other = ta[:, None] != tb
                        if not other.any():
                            continue
                        differ = np.bitwise_count(s[0, a][:, None] ^ s[0, b]).astype(np.int32) + np.bitwise_count(s[1, a][:, None] ^ s[1, b])
                        near = (differ <= radius(n[a][:, None], n[b])) & other
                        for u in np.flatnonzero(near.any(axis=1)).tolist():
                            x = int(a[u])
                            y = b[np.flatnonzero(near[u] & (tb != trees.top(int(ident[x]))))]
                            if not len(y):
                                continue
                            mine = flat[at[x] : at[x + 1]]
                            size = at[y + 1] - at[y]
                            theirs = flat[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[y], size)]
                            shared = np.add.reduceat(mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs, np.cumsum(size) - size)
                            y = y[PART[1] * shared >= PART[0] * np.maximum(n[x], n[y])]
                            for z in ident[y].tolist():
                                if (r := trees.top(z)) != (mine_top := trees.top(int(ident[x]))):
                                    trees.root[r] = mine_top
                                    links.append((int(ident[x]), z))
                            if len(y):
                                tb = trees.tops(ident[b])
                        ta = trees.tops(ident[a])
            if links:
                both = np.array(links, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(both.min(axis=0)), pa.array(both.max(axis=0))], ["a", "b"])

    return run


def near_groups(rows: DataFrame, ident: str, first: str, second: str, rare: int = RARE, long: int = LONG, dense: int = DENSE, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """Rows (group_id, id) for every row that is alike to another, closed over chains; group_id is the smallest id.

    Null texts count as empty; rows without any word and rows with a null id are in no group. An id that is repeated counts
    as one row, whose words are taken from either text. Columns other than the three are not read.

    1. Words are counted over all rows into a bounded table, which only sets the order of words: any order is exact.
    2. Rows with the same words are one class (128-bit key), so copies cost nothing from here on.
    3. Every class goes into its buckets, see _keys. Buckets of pairs of words are counted and cut into cells of about
       `block` rows. Cells are compared in tiles; dense ones once more, with their words at hand.
    4. Pairs within the radius are checked exactly on all words; links are contracted to groups.
    5. If buckets were cut, their rows are compared across cells as far as they aren't in one group by then: the largest
       group's cells with those of all others, and the others with each other. So near-alike rows by the million cost
       one comparison in their cell and none across.

    The five numbers change the work, never the result.
    """
    spark = rows.sparkSession
    texts = rows.where(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(first).alias("_a"), F.col(second).alias("_b"))
    shared = spark.sparkContext.broadcast(word_counts(texts))
    rows_ = cut(texts.mapInArrow(_describe(shared, rare, long), "id long, k1 long, k2 long, n int, s1 long, s2 long, keys array<long>, open_keys array<long>"))
    filled = rows_.where("n > 0")
    classes = filled.groupBy("k1", "k2").agg(F.min_by(F.struct("n", "s1", "s2", "keys", "open_keys"), "id").alias("of"), F.min("id").alias("id")).select("id", "of.*")
    classes = cut(classes)
    open_ = classes.select(F.explode("open_keys").alias("key"), "id", "n", "s1", "s2")
    sizes = cut(open_.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    cells = F.ceil(F.col("size") / block)
    counted = join_counted(open_, sizes, ["key"], "size").withColumn("cell", F.pmod(F.xxhash64("id"), cells).cast("long"))
    entries = classes.select(F.explode("keys").alias("key"), F.lit(0).cast("long").alias("cell"), "id", "n", "s1", "s2").unionByName(counted.select("key", "cell", "id", "n", "s1", "s2"))
    links = _links(entries.withColumn("label", F.col("id")), texts, dense, tile)
    wide = sizes.where(cells > 1)
    if wide.take(1):
        hot = cut(join_counted(open_, cut(wide), ["key"], "size"))
        links = cut(links.unionByName(_links(_across(hot, components(links), block), texts, dense, tile)))
        forget(hot)
    labels = components(links)
    copied = filled.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies")).where("copies > 1")
    groups = cut(copied.join(labels, copied.id == labels.node, "left").select("k1", "k2", F.coalesce("component", "id").alias("group_id"), "copies"))
    in_copies = join_counted(filled.select("k1", "k2", "id"), groups, ["k1", "k2"], "copies").select("group_id", "id")
    forget(classes, links)
    return in_copies.unionByName(labels.select(F.col("component").alias("group_id"), F.col("node").alias("id"))).distinct()


def _sorted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)


def _links(entries: DataFrame, texts: DataFrame, dense: int, tile: int) -> DataFrame:
    """Proven links (a, b) of the rows of each cell, as a written table."""
    near = cut(_sorted(entries, "key", "cell").mapInArrow(_near(dense, tile), NEAR))
    pairs = near.where("b is not null").select("a", "b").distinct()
    links = proven(cut(pairs), texts)
    full = near.where("b is null").select("key", "cell", F.col("a").alias("id"), "n", "s1", "s2", "label")
    if full.take(1):
        found = texts.join(full.select("id").distinct(), "id", "left_semi").mapInArrow(_tokens, "id long, tokens array<long>").dropDuplicates(["id"])
        links = links.unionByName(_sorted(full.join(found, "id"), "key", "cell").mapInArrow(_forest(tile * tile), "a long, b long"))
    links = cut(links.distinct())
    forget(near)
    return links


def proven(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are alike by all their words. Texts are joined by shuffle, and only those of pairs travel on."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    found = texts.join(nodes, "id", "left_semi").mapInArrow(_tokens, "id long, tokens array<long>").dropDuplicates(["id"])
    a, b = (found.select(F.col("id").alias(c), F.col("tokens").alias(f"t{c}")) for c in "ab")
    return (
        pairs.join(a, "a").join(b, "b")
        .where(F.size(F.array_intersect("ta", "tb")) * PART[1] >= F.greatest(F.size("ta"), F.size("tb")) * PART[0])
        .select("a", "b")
    )


def _across(hot: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """Cells in which rows of buckets that were cut meet the rows of other groups. hot: (key, id, n, s1, s2)."""
    placed = cut(hot.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", "s1", "s2", F.coalesce("component", "id").alias("label")))
    by_label = placed.groupBy("key", "label").agg(F.count("*").alias("c"))
    of = by_label.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("big"), F.max("c").alias("most"), F.sum("c").alias("all")).where("most < all")
    of = cut(of.select("key", "big", "all", F.ceil(F.col("most") / block).alias("m"), F.ceil((F.col("all") - F.col("most")) / block).alias("r")))
    there = join_counted(placed, of, ["key"], "all").withColumn("mine", F.pmod(F.xxhash64("id"), F.when(F.col("label") == F.col("big"), F.col("m")).otherwise(F.col("r"))))
    # cells 0 to m r - 1 are of the largest group and the others, the negative ones of two blocks of others
    own = F.expr("transform(sequence(0L, r - 1), j -> mine * r + j)")
    others = F.concat(F.expr("transform(sequence(0L, m - 1), g -> g * r + mine)"), F.expr("transform(sequence(0L, r - 1), j -> -1L - (least(mine, j) * r + greatest(mine, j)))"))
    return there.withColumn("cell", F.explode(F.when(F.col("label") == F.col("big"), own).otherwise(others))).select("key", "cell", "id", "n", "s1", "s2", "label")
