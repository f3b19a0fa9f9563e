"""Problem 8: fuzzy passages of all pairs of documents.

Equal texts are one class. The smallest k-mers of all windows are the seeds of a class; classes that share a seed meet on it,
every pair of them, in tiles so that no frequent seed is one task. Pairs are dealt to blocks of two buckets of texts, and there
each seed is extended to the longest exact match in both texts, matches are chained, and the text between two links of a
chain is aligned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.llm import words
from querylens.llm.near import buckets
from querylens.llm.spans import K, LEAST, Text, _least, chains
from querylens.operators.shared import cut, join_counted

#: Occurrences of a seed in one block of a tile, and characters of texts in one bucket.
TILE, BUCKET_CHARS = 1000, 1_000_000
FOUND = "doc_id long, other_id long, span_start long, span_end long, other_start long, other_end long, exact_chars long, n_parts long, edits long"


def _kept(spots: np.ndarray, k: int, step: int) -> np.ndarray:
    """All places of a seed but those inside a stretch where it overlaps itself at one distance (a text like aaaa): there its
    ends stay and one place a step, from each of which the whole stretch of the other text is found again."""
    gap = np.diff(spots)
    inner = np.r_[False, (gap[1:] == gap[:-1]) & (gap[1:] < k), False]
    return ~inner | np.r_[True, spots[1:] // step != spots[:-1] // step]


def _seeds(least: int, k: int):
    """Rows (cls, seed, at): all places of the smallest k-mers of windows, see _kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, ("text",), 2_000_000):
            t = Text(batch.column("text").to_pylist())
            if len(t.sums) <= least:
                continue
            at = np.arange(len(t.sums) - k)
            gram = t.hash(at, at + k)
            seed = _least(gram, least - k + 1)
            at = at[: len(seed)]
            of = np.repeat(np.arange(len(t.n)), t.n)[: len(at)]
            inside = at + least <= t.begin[1:][of]
            first = inside & np.r_[True, ~inside[:-1] | (seed[1:] != seed[:-1]) | (of[1:] != of[:-1])]
            last = inside & np.r_[~inside[1:] | (seed[1:] != seed[:-1]) | (of[1:] != of[:-1]), True]
            row, place, code = [], [], []
            for lo, hi in zip(np.flatnonzero(first).tolist(), np.flatnonzero(last).tolist()):
                spots = np.flatnonzero(gram[lo : hi + least - k + 1] == seed[lo]) + lo
                if len(spots) > 2:
                    spots = spots[_kept(spots, k, max(1, (least - k) // 2))]
                for p in spots.tolist():
                    row.append(int(of[lo]))
                    place.append(p - int(t.begin[of[lo]]))
                    code.append(seed[lo])
            if row:
                yield pa.RecordBatch.from_arrays([batch.column("cls").take(pa.array(row)), pa.array(np.array(code, np.uint64).view(np.int64)), pa.array(place, pa.int32())], ["cls", "seed", "at"])

    return run


def distance(a: str, b: str) -> int:
    """Characters inserted, dropped or replaced, by bit vectors over a (Myers, Hyyrö)."""
    n = min(len(a), len(b))
    i = next((p for p in range(n) if a[p] != b[p]), n)
    a, b = a[i:], b[i:]
    n -= i
    i = next((p for p in range(n) if a[-1 - p] != b[-1 - p]), n)
    a, b = a[: len(a) - i], b[: len(b) - i]
    if not a or not b:
        return max(len(a), len(b))
    where: dict[str, int] = {}
    for p, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << p
    mask, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = mask, 0
    for c in b:
        same = where.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = (down | ~(across | up)) & mask, up & across
        score += bool(more & top) - bool(less & top)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(same | down | more)) & mask, more & (same | down) & mask
    return score


def _pieces(parts: list[tuple[int, int, int]], a: str, b: str) -> list[tuple[list[int], int, int]]:
    """The chain (x, y, length) cut at gaps that cost what the alignment on one side of them has gained: (parts, equal
    characters, edits) of each piece. An equal character gains 1, an edit costs 1."""
    gaps = []
    for (x, y, n), (u, v, _) in zip(parts, parts[1:]):
        long = max(u - x - n, v - y - n)
        e = distance(a[x + n : u], b[y + n : v])
        gaps.append((long - e, e))
    todo, done = [list(range(len(parts)))], []
    while todo:
        piece = todo.pop()
        for order in (piece, piece[::-1]):
            gain, at = parts[order[0]][2], None
            for p, q in zip(order, order[1:]):
                equal, e = gaps[min(p, q)]
                gain += equal - e
                if gain <= 0:
                    at = max(p, q) - piece[0]
                    break
                gain += parts[q][2]
            if at is not None:
                todo += [piece[:at], piece[at:]]
                break
        else:
            between = [gaps[p] for p in piece[:-1]]
            done.append((piece, sum(parts[p][2] for p in piece) + sum(g[0] for g in between), sum(g[1] for g in between)))
    return done


def _extended(t: Text, x: np.ndarray, y: np.ndarray, room: np.ndarray, way: int) -> np.ndarray:
    """How far the texts are equal from x and y on (way 1) or before them (way -1), at most room."""
    reach = np.zeros(len(x), np.int64)
    for bit in reversed(range(int(room.max(initial=0)).bit_length())):
        more = reach + (1 << bit)
        fits = np.flatnonzero(more <= room)
        f, u, v = more[fits], x[fits], y[fits]
        same = t.hash(u, u + f) == t.hash(v, v + f) if way > 0 else t.hash(u - f, u) == t.hash(v - f, v)
        reach[fits[same]] = f[same]
    return reach


def _compared(table: pa.Table, least: int, k: int) -> list[tuple]:
    """Passages of the blocks of a table that holds their texts and seeds."""
    ba, bb, cls, other = (table.column(c).to_numpy() for c in ("ba", "bb", "cls", "other"))
    is_text = table.column("text").is_valid().to_numpy()
    rows = np.flatnonzero(is_text)
    texts = table.column("text").take(pa.array(rows)).to_pylist()
    place = {key: i for i, key in enumerate(zip(ba[rows].tolist(), bb[rows].tolist(), cls[rows].tolist()))}
    first, last = (table.column(c).take(pa.array(rows)).to_pylist() for c in ("first", "last"))
    s = np.flatnonzero(~is_text)
    if not len(s):
        return []
    blocks = list(zip(ba[s].tolist(), bb[s].tolist()))
    a, b = (np.array([place[(*at, c)] for at, c in zip(blocks, of[s].tolist())]) for of in (cls, other))
    x, y = (table.column(c).take(pa.array(s)).to_numpy().astype(np.int64) for c in ("x", "y"))
    t = Text(texts)
    gx, gy = t.begin[a] + x, t.begin[b] + y
    back = _extended(t, gx, gy, np.minimum(x, y), -1)
    ahead = _extended(t, gx, gy, np.minimum(t.n[a] - x, t.n[b] - y), 1)
    good = ahead >= k
    a, b, x, y, back, ahead = (v[good] for v in (a, b, x, y, back, ahead))
    order = np.lexsort((x, x - back, x - y, b, a))
    a, b, x, y, back, ahead = (v[order] for v in (a, b, x, y, back, ahead))
    lo = x - back
    begin = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (x[1:] - y[1:] != x[:-1] - y[:-1]) | (lo[1:] != lo[:-1])]) if len(a) else np.zeros(0, np.int64)
    end = np.r_[begin[1:], len(a)][: len(begin)] - 1
    # an exact match, and the stretch of it from its first seed to its last, by which matches are chained
    a, b, cx, cy, cn, mx, my, mn = a[begin], b[begin], x[begin], y[begin], x[end] + k - x[begin], lo[begin], (y - back)[begin], (back + ahead)[begin]
    out = []
    pair = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else []
    for p, q in zip(pair, np.r_[pair[1:], len(a)] if len(a) else []):
        i, j = int(a[p]), int(b[p])
        one, two = first[i], first[j] if first[j] != first[i] else last[j]
        one = last[i] if one == two else one
        if one == two:
            continue
        m = [tuple(map(int, v)) for v in zip(mx[p:q], my[p:q], mn[p:q])]
        if any(texts[i][u : u + n] != texts[j][v : v + n] for u, v, n in m):
            raise ValueError("two different texts have one hash")
        spans = []
        if len(m) == 1:
            spans.append((m[0][0], m[0][0] + m[0][2], m[0][1], m[0][1] + m[0][2], m[0][2], 1, 0))
        else:
            core = [tuple(map(int, v)) for v in zip(cx[p:q], cy[p:q], cn[p:q])]
            chain = chains(cx[p:q], cy[p:q], cn[p:q])
            for c in np.unique(chain):
                of = sorted(np.flatnonzero(chain == c).tolist(), key=lambda r: core[r])
                for piece, equal, edits in _pieces([core[r] for r in of], texts[i], texts[j]):
                    parts = [of[r] for r in piece]
                    f, g = parts[0], parts[-1]
                    before, after = core[f][0] - m[f][0], m[g][0] + m[g][2] - core[g][0] - core[g][2]
                    box = (m[f][0], m[g][0] + m[g][2], m[f][1], m[g][1] + m[g][2])
                    spans.append((*box, equal + before + after, len(parts), edits))
                    # a part that reaches beyond the ends of its chain is also a passage by itself
                    spans += [(u, u + n, v, v + n, n, 1, 0) for u, v, n in (m[r] for r in parts) if u < box[0] or u + n > box[1] or v < box[2] or v + n > box[3]]
        out += [(one, two, *s) for s in spans if s[1] - s[0] >= least and s[3] - s[2] >= least]
    return out


def _blocks(least: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in buckets(batches, ("ba", "bb"), 5_000):
            ba, bb = (table.column(c).to_numpy() for c in ("ba", "bb"))
            begin = np.flatnonzero(np.r_[True, (ba[1:] != ba[:-1]) | (bb[1:] != bb[:-1])])
            size = np.r_[0, np.cumsum(pa.compute.fill_null(pa.compute.utf8_length(table.column("text")), 0).to_numpy())]
            start = 0
            for end in [*begin[1:].tolist(), table.num_rows]:
                if end == table.num_rows or size[end] - size[start] > 2_000_000:
                    out = _compared(table.slice(start, end - start), least, k)
                    start = end
                    if out:
                        one = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], [c.split()[0] for c in FOUND.split(", ")])
                        mirrored = [one.column(c) for c in (1, 0, 4, 5, 2, 3, 6, 7, 8)]
                        yield one
                        yield pa.RecordBatch.from_arrays(mirrored, one.schema.names)

    return run


def _anchors(seeds: DataFrame, buckets: int) -> DataFrame:
    """Rows (ba, bb, cls, other, x, y): each pair of places in two classes that hold the same seed, once, and its block."""
    groups = cut(seeds.groupBy("seed").agg(F.count("*").alias("n"), F.min("cls").alias("a"), F.max("cls").alias("b")).where("a != b").select("seed", "n"))
    rows = cut(join_counted(seeds, groups, ["seed"], "n").withColumn("m", F.ceil(F.col("n") / TILE).cast("int")).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("m")).cast("int")))
    left = rows.select("seed", F.col("mine").alias("i"), F.explode(F.expr("sequence(mine, m - 1)")).alias("j"), F.col("cls").alias("p"), F.col("at").alias("u"))
    right = rows.select("seed", F.explode(F.expr("sequence(0, mine)")).alias("i"), F.col("mine").alias("j"), F.col("cls").alias("q"), F.col("at").alias("v"))
    met = left.join(right, ["seed", "i", "j"]).where("i < j or p < q")

    def bucket(c: str) -> Column:
        return F.pmod(F.col(c), F.lit(buckets))

    ahead = (bucket("p") < bucket("q")) | ((bucket("p") == bucket("q")) & (F.col("p") < F.col("q")))
    cls, other, x, y = (F.when(ahead, F.col(c)).otherwise(F.col(d)) for c, d in (("p", "q"), ("q", "p"), ("u", "v"), ("v", "u")))
    return met.select(cls.alias("cls"), other.alias("other"), x.alias("x"), y.alias("y")).select(bucket("cls").alias("ba"), bucket("other").alias("bb"), "cls", "other", "x", "y")


def all_passages(documents: DataFrame, least: int = LEAST, k: int = K) -> DataFrame:
    """Rows for fuzzy passages of two documents, each pair both ways: chains of exact parts in order, the text between aligned.

    Equal texts are one class: its first document by id stands for it, and a row over the whole text leads from every other
    to it, so what holds for the first holds for all. Any two classes that share a seed (the smallest k-mer of a window of
    least characters) are compared, so no exact stretch of least characters is missed; two texts without a common seed,
    such as with an edit in every k characters, have no passage. Exact parts are of k characters or more, passages of
    least or more in both documents. exact_chars counts the characters that the alignment matches, edits the others; a chain
    is cut where a gap costs as many edits as the alignment on one side gains. Null and shorter texts have none. Rows with
    the same doc_id are one document, which isn't compared with itself.
    """
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), "text").where(F.length("text") >= least).withColumn("cls", F.xxhash64("text"))
    members = cut(texts.select("id", "cls", F.length("text").alias("chars")).distinct())
    classes = cut(members.groupBy("cls").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"), F.max("chars").alias("chars")))
    buckets = max(1, -(-(classes.agg(F.sum("chars")).first()[0] or 0) // BUCKET_CHARS))
    anchors = cut(_anchors(cut(texts.select("cls", "text").mapInArrow(_seeds(least, k), "cls long, seed long, at int").distinct()), buckets))
    need = cut(anchors.select("ba", "bb", "cls").unionByName(anchors.select("ba", "bb", F.col("other").alias("cls"))).distinct())
    involved = classes.join(need.select("cls").distinct(), "cls", "left_semi").select("cls", "first", "last", F.col("first").alias("id"))
    held = cut(texts.join(involved, ["cls", "id"]).select("cls", "first", "last", "text"))
    none = [F.lit(0).cast(kind).alias(c) for c, kind in (("other", "long"), ("x", "int"), ("y", "int"))]
    rows = held.join(need, "cls").select("ba", "bb", "cls", *none, "first", "last", "text").unionByName(anchors, allowMissingColumns=True)
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(parts, "ba", "bb").sortWithinPartitions("ba", "bb").mapInArrow(_blocks(least, k), FOUND)
    copies = join_counted(members.select("id", "cls"), classes.where("n > 1"), ["cls"], "n").where("id != first")
    whole = [F.lit(0).cast("long"), F.col("chars").cast("long")] * 2 + [F.col("chars").cast("long"), F.lit(1).cast("long"), F.lit(0).cast("long")]
    pairs = copies.select("chars", F.explode(F.array(F.struct(F.col("id").alias("p"), F.col("first").alias("q")), F.struct(F.col("first").alias("p"), F.col("id").alias("q")))).alias("of"))
    return found.unionByName(pairs.select(*(c.alias(name.split()[0]) for c, name in zip([F.col("of.p"), F.col("of.q"), *whole], FOUND.split(", ")))))
