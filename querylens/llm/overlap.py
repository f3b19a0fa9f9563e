"""Problem 5: records of evaluation splits that also occur in training, found by Aho-Corasick automata over their pieces.

Words may be moved, so each record is its words in one order of all words: by octaves of their counts, rare ones first, in each
octave the first occurrences before the second ones, so that neighbours are different words. Two alike records differ in at
most widest(n) words, n being the words of either. A record is cut into one piece more than that: a word that only this
record has spoils the piece it is in, one that only the other has spoils the piece it falls into, so one piece at least
stands unbroken in the other record. Where a record's first words are rare, fewer pieces do: a piece of one word is spoiled
only by the record's own words, of which at most spare(n) are missing in the other, so the first spare(n) + 1 words hold one that is not.
Automata of the pieces scan all records and lose no pair; exact counts of words decide.

Groups are closed over chains through records of any split and data. So the pieces of evaluation records come first, then
those of the records they are alike to, until there are none left.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.llm import words
from querylens.llm.families import name_key, roots
from querylens.llm.graph import components
from querylens.llm.near import CELLS, RARE, in_order, least_shared, proven, radius, sketches, summed, texts_of, widest, word_counts
from querylens.operators.shared import cut, forget

TRAIN, EVALUATION = ["train"], ["dev", "test"]
SHINGLE = 5
#: Passages in one automaton and texts that it scans, which bound what a task holds.
SHARD, CHUNK = 200_000, 50_000
#: Words of a piece at most, words by which pieces are dealt, and how often a word may come that is a piece by itself. The last
#: is below a power of two, so such words come first.
PIECE, HEAD, ENOUGH = 24, 6, 15
#: Pieces in one automaton, and records with one head beyond which it is dealt to several automata.
PIECES, SUB = 50_000, 20_000
#: Heads of pieces are marked in 2**HEADS bits, which bounds what is broadcast to 16 MB; so many pieces are searched for at a time.
HEADS, AT_ONCE = 27, 16_000_000
#: Rounds through chains, after which all records left are searched for at once.
ROUNDS = 4


def _with_roots(samples: DataFrame, registry: DataFrame) -> DataFrame:
    of, _ = roots(registry)
    samples = samples.select("sample_id", "db_id", "split", "source", "question", "query")
    return samples.withColumn("_key", name_key(F.col("db_id"))).join(of.select(F.col("key").alias("_key"), "root_db"), "_key").where("root_db is not null")


def _ordered(batch: pa.RecordBatch, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each record in the order that pieces are cut from: row, hash and count."""
    rows, t, often, nth = in_order(texts_of(batch), count)
    order = np.lexsort((np.arange(len(rows)), nth, np.frexp(often)[1], rows))
    return rows, t[order], often[order]


def _after(t: np.ndarray) -> np.ndarray:
    """The cell of each word together with the one before it."""
    t = t.view(np.uint32).astype(np.uint64)
    return (words.mix(np.r_[np.uint64(0), t[:-1]] * words.GOLD + t) >> np.uint64(64 - CELLS)).astype(np.int64)


def _count_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(1 << CELLS, np.int64)
    for batch in batches:
        n += np.bincount(_after(_flat(batch.column("words"))[0]), minlength=len(n))
    cell = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n[cell])], ["cell", "n"])


def weights(rows: np.ndarray, often: np.ndarray, both: np.ndarray, total: int) -> np.ndarray:
    """How much each word tells, in bits: how rare it is, or how rare after the word before it if that is less, as it is in phrases."""
    alone = np.log2(max(total, 2) / np.maximum(often, 1))
    after = np.log2(np.r_[1, often[:-1]] / np.maximum(both, 1))
    return np.maximum(np.where(np.r_[True, rows[1:] != rows[:-1]][: len(rows)], alone, np.minimum(alone, after)), 0.05)


def pieces(begin: np.ndarray, n: np.ndarray, often: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end): widest(n) + 1 pieces of each row's words, which begin at `begin`.

    Words that came at most ENOUGH times are pieces by themselves, as far as pieces are needed. The pieces then missing are of the
    other words and tell about as much each by the sums of their weights, so none is held by many records by chance. Each has a word at least and PIECE words at most; what is then left is in none."""
    so_far, stop = np.r_[0.0, np.cumsum(weight)], begin + n
    alone = np.r_[0, np.cumsum(often <= ENOUGH)]
    left, at, live, out = widest(n), begin.copy(), np.flatnonzero(n > 0), []
    alone = np.minimum(alone[stop] - alone[begin], left + 1)
    each = (so_far[stop] - so_far[begin + alone]) / np.maximum(left + 1 - alone, 1)
    turn = 0
    while len(live):
        turn += 1
        p = at[live]
        end = np.searchsorted(so_far, so_far[(begin + alone)[live]] + (turn - alone[live]) * each[live] - 1e-6)
        end = np.where(turn <= alone[live], p + 1, np.clip(end, p + 1, p + PIECE))
        end = np.minimum(end, stop[live] - left[live])
        out.append(np.stack([live, p, end]))
        at[live] = end
        left[live] -= 1
        live = live[left[live] >= 0]
    row, start, end = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    order = np.lexsort((start, row))
    return row[order], start[order], end[order]


def spare(n: np.ndarray) -> np.ndarray:
    """How many words of a record an alike one lacks at most."""
    return n - least_shared(n)


def first_words(n: np.ndarray, often: np.ndarray, rare: int = RARE) -> tuple[np.ndarray, np.ndarray]:
    """By row how many first words are enough as pieces, and how often these come if that is more than `rare` times each, else 0."""
    begin, lone = np.cumsum(n) - n, np.where(n > 0, spare(n) + 1, 0)
    so_far = np.r_[0, np.cumsum(often.astype(np.int64))]
    met = so_far[begin + lone] - so_far[begin]
    return lone, np.where(met > rare * lone, met, 0)


def cheapest(n: np.ndarray, t: np.ndarray, often: np.ndarray, afters: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, end): the pieces of each row, which stand one behind the other from its first word on: its first words one by one, or
    those of pieces() if fewer records are expected to hold them. Either loses no pair, so each row may choose."""
    rows, begin = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    weight = weights(rows, often, afters[_after(t)], total)
    of, start, end = pieces(begin, n, often, weight)
    told = np.r_[0.0, np.cumsum(weight)]
    lone, met = first_words(n, often, 0)
    better = np.bincount(of, total * np.exp2(told[start] - told[end]), len(n)) < met
    of, end, lone = of[better[of]], (end - begin[of])[better[of]], np.where(better, 0, lone)
    row, place = _upto(lone)
    row, end = np.r_[row, of], np.r_[place + 1, end]
    order = np.lexsort((end, row))
    return row[order], end[order]


def _upto(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): the places 0 to n - 1 of each row."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


LAID = "id long, split string, root_db string, k1 long, k2 long, n int, s1 long, s2 long, words binary, often binary"


def _lay(counts, rare: int):
    """Words as 32-bit numbers; counts of words only for rows whose first words are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, ("_a", "_b")):
            m = batch.num_rows
            rows, t, often = _ordered(batch, counts.value)
            n = np.bincount(rows, minlength=m).astype(np.int64)
            dear = first_words(n, often, rare)[1] > 0
            out = sketches(rows, t, m)
            codes = (t >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("split"), batch.column("root_db"), *(pa.array(out[k].view(np.int64)) for k in ("k1", "k2")), pa.array(n.astype(np.int32)), *(pa.array(out[k].view(np.int64)) for k in ("s1", "s2")), _blobs(codes, n), _blobs(often[dear[rows]], np.where(dear, n, 0))],
                [c.split()[0] for c in LAID.split(", ")],
            )

    return run


def _blobs(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    """Lists of so many numbers as bytes, which the JVM moves without looking at each number."""
    at = np.r_[0, 4 * np.cumsum(size)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(flat.astype(np.int32).tobytes())])


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of lists, or of their bytes, and where each list begins, with the end of the last."""
    if not pa.types.is_binary(column.type):
        at = column.offsets.to_numpy().astype(np.int64)
        return column.values.to_numpy()[at[0] : at[-1]], at - at[0]
    if not len(column):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.int32) if at[-1] > at[0] else np.zeros(0, np.int32)
    return flat, (at - at[0]) // 4


def _heads(flat: np.ndarray, start: np.ndarray, alone: bool = False) -> Iterator[np.ndarray]:
    """By what pieces and places of texts are dealt to automata: one word from start on, two words, and so on up to HEAD. A record's
    first words that are pieces each by itself are dealt apart, for they are looked up only among a text's first words."""
    h = np.full(len(start), 0 if alone else 1, np.uint64)
    for k in range(1 if alone else HEAD):
        h = words.mix(h * words.GOLD + flat[np.minimum(start + k, len(flat) - 1)].view(np.uint32).astype(np.uint64) + np.uint64(1))
        yield h


DEALT = "head long, id long, n int, s1 long, s2 long, letters binary"


def _dealt(batch: pa.RecordBatch, head: np.ndarray, row: np.ndarray, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    size = end - start
    piece, place = _upto(size)
    letters = flat[start[piece] + place]
    return pa.RecordBatch.from_arrays([pa.array(head.view(np.int64)), *(batch.column(c).take(pa.array(row)) for c in ("id", "n", "s1", "s2")), _blobs(letters, size)], [c.split()[0] for c in DEALT.split(", ")])


def _patterns(afters, total: int):
    """The pieces, and by how many words each is dealt; 0 for one of the first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = _flat(batch.column("words"))
            often, of = _flat(batch.column("often"))
            n = np.diff(at)
            if not len(flat):
                continue
            dear = np.diff(of) > 0
            row, end = _upto(np.where(dear, 0, spare(n) + 1))
            end += 1
            if dear.any():
                r, e = cheapest(n[dear], flat[np.repeat(dear, n)], often, afters.value, total)
                row, end = np.r_[row, np.flatnonzero(dear)[r]], np.r_[end, e]
                order = np.lexsort((end, row))
                row, end = row[order], end[order]
            first = np.r_[True, row[1:] != row[:-1]]
            start = np.where(first, 0, np.r_[0, end[:-1]])
            nth = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
            kind = np.where(end == nth + 1, 0, np.minimum(end - start, HEAD))
            start, end = start + at[row], end + at[row]
            head = next(_heads(flat, start, alone=True))
            if kind.any():
                for k, h in enumerate(_heads(flat, start), 1):
                    head = np.where(kind == k, h, head)
            yield _dealt(batch, head, row, flat, start, end).append_column("kind", pa.array(kind.astype(np.int32)))

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of heads, 64 a word; the word behind the last has a bit for each kind of piece."""
    for batch in batches:
        bit = np.unique(batch.column("head").to_numpy().view(np.uint64) >> np.uint64(64 - HEADS)).astype(np.int64)
        bit = np.r_[bit, (1 << HEADS) + np.unique(batch.column("kind").to_numpy())]
        word = bit >> 6
        if batch.num_rows:
            begin = words.starts(word)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), begin)
            yield pa.RecordBatch.from_arrays([pa.array(word[begin].astype(np.int32)), pa.array(bits.view(np.int64))], ["word", "bits"])


def _fragments(marks):
    """The places of texts where a piece may begin, with the words from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = marks.value
        kinds = int(marked[-1])

        def hit(head: np.ndarray) -> np.ndarray:
            bit = head >> np.uint64(64 - HEADS)
            return (marked[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1

        for batch in batches:
            flat, at = _flat(batch.column("words"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            if not len(row):
                continue
            place, stop = np.arange(len(flat)), at[row + 1]
            if kinds & 1:  # the first word that two alike records share is among the first ones of either
                few = place[place - at[row] <= spare(np.diff(at))[row]]
                head = next(_heads(flat, few, alone=True))
                here, head = few[hit(head)], head[hit(head)]
                if len(here):
                    yield _dealt(batch, head, row[here], flat, here, here + 1)
            if not kinds >> 1:
                continue
            for k, head in enumerate(_heads(flat, place), 1):
                here = np.flatnonzero(hit(head) & (place + k <= stop)) if kinds >> k & 1 else []
                if len(here):
                    yield _dealt(batch, head[here], row[here], flat, here, here + k if k < HEAD else np.minimum(here + PIECE, stop[here]))

    return run


class _Machine:
    """The automaton of the pieces of one shard. Equal pieces are one; their records are listed beside it."""

    def __init__(self, parts: list[pa.RecordBatch]):
        kinds: dict[str, int] = {}
        which = [kinds.setdefault(x, len(kinds)) for p in parts for x in _spelled(p.column("letters"))]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for letters, i in kinds.items():
            self.machine.add_word(letters, i)
        self.machine.make_automaton()
        order = np.argsort(np.array(which), kind="stable")
        self.size = np.bincount(np.array(which), minlength=len(kinds))
        self.begin = np.cumsum(self.size) - self.size
        self.id, self.n, *s = (np.concatenate([p.column(c).to_numpy() for p in parts])[order] for c in ("id", "n", "s1", "s2"))
        self.s = [x.view(np.uint64) for x in s]

    def scan(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """Pairs (smaller id, larger id) of records whose sketches lie within the radius."""
        text, kind = [], []
        for r, letters in enumerate(_spelled(batch.column("letters"))):
            for end, i in self.machine.iter(letters):
                if end & 3 == 3:
                    text.append(r)
                    kind.append(i)
        if not text:
            return
        text, kind = np.array(text), np.array(kind)
        ident, n, *s = (batch.column(c).to_numpy() for c in ("id", "n", "s1", "s2"))
        upto = np.cumsum(self.size[kind])
        for part in np.split(np.arange(len(text)), np.searchsorted(upto, np.arange(2_000_000, int(upto[-1]), 2_000_000))):
            size = self.size[kind[part]]
            x = np.repeat(text[part], size)
            y = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.begin[kind[part]], size)
            apart = sum(np.bitwise_count(a[x].view(np.uint64) ^ b[y]).astype(np.int32) for a, b in zip(s, self.s))
            near = (apart <= radius(n[x], self.n[y])) & (ident[x] != self.id[y])
            if near.any():
                a, b = ident[x[near]], self.id[y[near]]
                yield np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)


def _spelled(column) -> list[str]:
    """Each list of word hashes as text, four letters below 256 a word: nodes of automata look their letters up one by one, so
    an alphabet of all words would make the root slow. Only matches that end with a word count."""
    flat, at = _flat(column)
    text, at = flat.astype(">i4").tobytes().decode("latin-1"), (4 * at).tolist()
    return [text[lo:hi] for lo, hi in zip(at, at[1:])]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b). Batches are sorted by shard, pieces before texts, so one automaton is held at a time and texts
    stream past it."""
    shard, parts, machine = None, [], None
    for batch in batches:
        of, text = batch.column("shard").to_numpy(), batch.column("text").to_numpy(zero_copy_only=False)
        runs = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (text[1:] != text[:-1])]) if len(of) else []
        for lo, hi in zip(runs, np.r_[runs[1:], len(of)].astype(int) if len(of) else []):
            run = batch.slice(lo, hi - lo)
            if of[lo] != shard:
                shard, parts, machine = of[lo], [], None
            if not text[lo]:
                parts.append(run)
                continue
            if machine is None and parts:
                machine, parts = _Machine(parts), []
            for both in machine.scan(run) if machine else ():
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


def _links(classes: DataFrame, searched: DataFrame, texts: DataFrame, afters, total: int) -> DataFrame:
    """Proven links (a, b) between the classes searched for, (id), and all classes, as a written table."""
    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    classes = classes.select("id", "n", "s1", "s2", "words", "often")
    pats = cut(classes.join(searched, "id", "left_semi").mapInArrow(_patterns(afters, total), DEALT + ", kind int"))
    n = pats.count()
    found = None
    for block in range(max(1, -(-n // AT_ONCE))):
        some = pats if n <= AT_ONCE else pats.where(F.pmod("head", F.lit(-(-n // AT_ONCE))) == block)
        marked = np.zeros((1 << (HEADS - 6)) + 1, np.uint64)
        marks = some.mapInArrow(_marks, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        marked[marks.column("word").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)
        shared, some = spark.sparkContext.broadcast(marked), some.drop("kind")
        frags = classes.drop("often").mapInArrow(_fragments(shared), DEALT)
        subs = F.lit(0)
        hot = cut(some.groupBy("head").agg(F.count("*").alias("c")).where(F.col("c") > SUB).select("head", F.ceil(F.col("c") / SUB).cast("int").alias("m")))
        if hot.take(1):  # at most AT_ONCE / SUB heads
            some = some.join(F.broadcast(hot), "head", "left").withColumn("sub", F.pmod(F.xxhash64("id"), F.coalesce("m", F.lit(1))).cast("int")).drop("m")
            frags = frags.join(F.broadcast(hot), "head", "left").withColumn("sub", F.explode(F.expr("sequence(0, coalesce(m, 1) - 1)"))).drop("m")
            subs = F.col("sub")
        shards = max(parts, -(-n // PIECES))
        both = some.withColumn("text", F.lit(False)).unionByName(frags.withColumn("text", F.lit(True)))
        both = both.select(F.pmod(F.xxhash64("head", subs), F.lit(shards)).cast("int").alias("shard"), "text", "id", "n", "s1", "s2", "letters")
        pairs = cut(both.repartition(parts, "shard").sortWithinPartitions("shard", "text").mapInArrow(_met, "a long, b long").distinct())
        found = pairs if found is None else found.unionByName(pairs)
        shared.unpersist()
    links = cut(proven(found.distinct(), texts))
    forget(pats)
    return links


def overlaps(samples: DataFrame, registry: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Rows (first_id, second_id, train_id, eval_id): every pair of a train row and a dev or test row in one group of problem 1
    whose written names belong to one family. Rows without a split, a known name or an id are in no pair, but chains may lead
    through them. Null texts count as empty; rows without any word are in no group.

    Rows with the same words are one class, so copies are searched for once. Round by round the classes that are new in
    links are searched for in turn; after the last round all others are at once. The number changes the work, never the result.
    """
    spark = samples.sparkSession
    of, _ = roots(registry)
    rows = samples.where("sample_id is not null").select(F.col("sample_id").cast("long").alias("id"), "split", name_key(F.col("db_id")).alias("_key"), F.col("question").alias("_a"), F.col("query").alias("_b"))
    rows = rows.join(of.select(F.col("key").alias("_key"), "root_db"), "_key", "left").select("id", "split", "root_db", "_a", "_b")
    texts = samples.where("sample_id is not null").select(F.col("sample_id").cast("long").alias("id"), F.col("question").alias("_a"), F.col("query").alias("_b"))
    shared = spark.sparkContext.broadcast(word_counts(texts))
    laid = cut(rows.mapInArrow(_lay(shared, RARE), LAID).where("n > 0"))
    afters, total = None, laid.count()
    if laid.where("length(often) > 0").take(1):
        afters = spark.sparkContext.broadcast(summed(laid.select("words").mapInArrow(_count_after, "cell int, n long")))
    held = F.max(F.col("split").isin(EVALUATION) & F.col("root_db").isNotNull()).alias("held")
    classes = cut(laid.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.min_by(F.struct("n", "s1", "s2", "words", "often"), "id").alias("of")).select("k1", "k2", "id", "held", "of.*"))
    full, laid = laid, cut(laid.select("id", "split", "root_db", "k1", "k2"))
    forget(full)
    used = new = cut(classes.where("held").select("id"))
    links = None
    for turn in range(rounds + 1):
        found = _links(classes, new, texts, afters, total)
        links = found if links is None else cut(links.unionByName(found).distinct())
        new = cut(found.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(used, "id", "left_anti"))
        if not new.take(1):
            break
        if turn == rounds - 1:
            new = cut(classes.select("id").join(used, "id", "left_anti"))
        used = cut(used.unionByName(new))
    labels = components(links)
    grouped = classes.select("k1", "k2", "id", "held").join(labels, classes.id == labels.node, "left").where("held or component is not null").select("k1", "k2", F.coalesce("component", "id").alias("group_id"))
    placed = cut(laid.where(F.col("root_db").isNotNull() & F.col("split").isin(TRAIN + EVALUATION)).join(grouped, ["k1", "k2"]))
    forget(classes, laid)
    train = placed.where(F.col("split").isin(TRAIN)).select("group_id", "root_db", F.col("id").alias("train_id"))
    held = placed.where(F.col("split").isin(EVALUATION)).select("group_id", "root_db", F.col("id").alias("eval_id"))
    return train.join(held, ["group_id", "root_db"]).select(F.least("train_id", "eval_id").alias("first_id"), F.greatest("train_id", "eval_id").alias("second_id"), "train_id", "eval_id").distinct()


def report(samples: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows (split, source, n_rows, n_overlapping, n_pairs) for the dev and test rows; a null source is a source of its own."""
    pairs = overlaps(samples, registry).groupBy(F.col("eval_id").alias("sample_id")).agg(F.count("*").alias("pairs"))
    return (
        samples.where(F.col("split").isin(EVALUATION)).select("sample_id", "split", "source").join(pairs, "sample_id", "left")
        .groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.count("pairs").alias("n_overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"))
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as lists of 32-bit word hashes, in order."""
    for batch in words.slices(batches, ("text",)):
        rows, codes, different = words.flat([t or "" for t in batch.column("text").to_pylist()])
        h = (words.hashes(different) >> np.uint64(32)).astype(np.uint32).view(np.int32)[codes] if len(codes) else np.zeros(0, np.int32)
        ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=batch.num_rows))].astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("family"), batch.column("held"), pa.ListArray.from_arrays(pa.array(ends), pa.array(h))], ["id", "family", "held", "words"])


def _scan(passages: pa.Table, texts: pa.Table) -> pa.Table:
    """The passages (id, place) that stand in one of the texts. One automaton of the different passages, one walk over each
    text, spelled by word hashes."""
    machine, kinds, which = ahocorasick.Automaton(ahocorasick.STORE_INTS), {}, []
    for chunk in passages.column("passage").chunks:
        which += [kinds.setdefault(x, len(kinds)) for x in _spelled(chunk)]
    for x, i in kinds.items():
        machine.add_word(x, i)
    hit = np.zeros(len(kinds), bool)
    if kinds:
        machine.make_automaton()
        for chunk in texts.column("words").chunks:
            for text in _spelled(chunk):
                for end, i in machine.iter(text):
                    if end & 3 == 3:
                        hit[i] = True
    return passages.select(["id", "place"]).filter(pa.array(hit[np.array(which, np.int64)]))


def coverage(samples: DataFrame, registry: DataFrame, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """Rows (sample_id, split, source, n_words, n_covered) for the dev and test rows of known families.

    n_covered counts the words of question and query that stand in five or more words in a row that a train row of the same
    family holds too: the union of the matched passages. Words are 32-bit hashes here, so passages of five words that differ count
    as equal only if each of their different words collides. Passages meet only texts of their family. A family with more
    passages than fit an automaton, or more texts than a task should scan, is cut into shards and chunks, so no task holds
    more than one shard and one chunk, however large a family is. Null texts count as empty; rows without an id are left out.
    """
    text = F.concat_ws("\n", F.coalesce("question", F.lit("")), F.coalesce("query", F.lit("")))
    rows = _with_roots(samples.where(F.col("split").isin(TRAIN + EVALUATION) & F.col("sample_id").isNotNull()), registry)
    rows = rows.select(F.col("sample_id").cast("long").alias("id"), F.xxhash64("root_db").alias("family"), F.col("split").isin(EVALUATION).alias("held"), text.alias("text"))
    hashed = cut(rows.mapInArrow(_hashed, "id long, family long, held boolean, words array<int>"))
    n_passages = F.sum(F.when(F.col("held"), F.greatest(F.size("words") - (SHINGLE - 1), F.lit(0))).otherwise(0))
    sizes = cut(hashed.groupBy("family").agg(F.greatest(F.lit(1), F.ceil(n_passages / shard)).cast("int").alias("shards"), F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("held")) / chunk)).cast("int").alias("chunks")))
    sized = hashed.join(sizes, "family")
    places = sized.where(F.col("held") & (F.size("words") >= SHINGLE)).select("id", "family", "shards", "chunks", "words", F.explode(F.expr(f"sequence(0, size(words) - {SHINGLE})")).alias("place")).withColumn("passage", F.expr(f"slice(words, place + 1, {SHINGLE})"))
    left = places.select("id", "place", "passage", "family", F.pmod(F.xxhash64("passage"), F.col("shards")).cast("int").alias("shard"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"))
    right = sized.where(~F.col("held")).select("words", F.col("family").alias("of_family"), F.explode(F.expr("sequence(0, shards - 1)")).alias("of_shard"), F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("of_chunk"))
    hits = left.groupBy("family", "shard", "chunk").cogroup(right.groupBy("of_family", "of_shard", "of_chunk")).applyInArrow(_scan, "id long, place int")
    covered = hits.select("id", F.explode(F.expr(f"sequence(place, place + {SHINGLE - 1})")).alias("word")).distinct().groupBy("id").agg(F.count("*").alias("n_covered"))
    held = samples.where(F.col("split").isin(EVALUATION)).select(F.col("sample_id").cast("long").alias("id"), "split", "source").distinct()
    n = hashed.where("held").select("id", F.size("words").cast("long").alias("n_words")).distinct()
    return n.join(held, "id").join(covered, "id", "left").select(F.col("id").alias("sample_id"), "split", "source", "n_words", F.coalesce("n_covered", F.lit(0)).alias("n_covered"))
