import random
from collections import Counter

import pytest

from querylens.operators.cells import CELLS, SHAPE, stage
from querylens.operators.compare import compare


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


def rule(pred, gold, n_pred, n_gold, ordered):
    """An own statement of the rules on plain lists."""
    pred, gold = ([[norm(v) for v in r] for r in x] for x in (pred, gold))
    columns = lambda rows, n: [[r[i] for r in rows] for i in range(n)]
    bag = lambda vectors: Counter(frozenset(Counter(v).items()) for v in vectors)

    def likeness(a, b):
        union = sum((a | b).values())
        return sum((a & b).values()) / union if union else 1.0

    rows, cols = (bag(pred), bag(gold)), (bag(columns(pred, n_pred)), bag(columns(gold, n_gold)))
    row, col = round(likeness(*rows), 4), round(likeness(*cols), 4)
    if len(pred) != len(gold) or n_pred != n_gold:
        match = False
    elif ordered:
        match = Counter(map(tuple, columns(pred, n_pred))) == Counter(map(tuple, columns(gold, n_gold)))
    else:
        match = rows[0] == rows[1] and cols[0] == cols[1]
    return match, row, col, round((row + col) / 2, 4)


def text(v):
    v = norm(v)
    if v is None:
        return "z"
    if isinstance(v, str):
        return "s" + v
    return "n" + (str(int(v)) if float(v).is_integer() else repr(v))


def run(spark, pairs):
    cells, shape, ordered = [], [], []
    for i, (pred, gold, n_pred, n_gold, o) in enumerate(pairs):
        ordered.append((i, o))
        for side, rows, n in (("pred", pred, n_pred), ("gold", gold, n_gold)):
            shape.append((i, side, True, len(rows), n, None))
            cells += [(i, side, r, c, text(v)) for r, row in enumerate(rows) for c, v in enumerate(row)]
    found = compare(spark.createDataFrame(cells, CELLS), spark.createDataFrame(shape, SHAPE), spark.createDataFrame(ordered, "sample_id long, ordered boolean"))
    return {r["sample_id"]: (r["match"], r["sim_row"], r["sim_col"], r["similarity"]) for r in found.collect()}


CASES = [
    ([[1, "a"], [2, "b"]], [[1, "a"], [2, "b"]], 2, 2, False), ([[1, "a"]], [[1, "b"]], 2, 2, False), ([[1]], [[1], [1]], 1, 1, False), ([[1]], [[1, 1]], 1, 2, False),
    ([[2, "b"], [1, "a"]], [[1, "a"], [2, "b"]], 2, 2, False), ([[2, "b"], [1, "a"]], [[1, "a"], [2, "b"]], 2, 2, True), ([["a", 1], ["b", 2]], [[1, "a"], [2, "b"]], 2, 2, True),
    ([[0.30000000000000004]], [[0.3]], 1, 1, False), ([], [], 1, 1, False), ([], [], 2, 1, False), ([[1], [2]], [[1], [3]], 1, 1, False), ([[1], [2], [3]], [[1], [2]], 1, 1, False),
    ([[1]], [[1.0]], 1, 1, False), ([[-1e-9]], [[0]], 1, 1, False), ([[None]], [[None]], 1, 1, True), ([["1"]], [[1]], 1, 1, False),
]


def test_known_pairs(spark):
    got = run(spark, CASES)
    assert got == {i: rule(*c) for i, c in enumerate(CASES)}
    assert [got[i][0] for i in range(9)] == [True, False, False, False, True, False, True, True, True]
    assert got[10][1] == 0.3333 and got[11][1:3] == (0.6667, 0.0) and got[9][1:3] == (1.0, 0.5)


def test_random_pairs(spark):
    r = random.Random(4)
    pairs = []
    for _ in range(150):
        n_rows, n_cols = r.randint(0, 5), r.randint(1, 4)
        gold = [[r.choice([None, 1, 2, 2.0, 0.1, 0.1 + 1e-9, "a", "b", 3]) for _ in range(n_cols)] for _ in range(n_rows)]
        pred, n = [list(x) for x in gold], n_cols
        if r.random() < 0.4:
            r.shuffle(pred)
        if r.random() < 0.3:
            order = r.sample(range(n_cols), n_cols)
            pred = [[x[i] for i in order] for x in pred]
        if pred and r.random() < 0.4:
            pred[r.randrange(len(pred))][r.randrange(n_cols)] = r.choice([None, 1, "a"])
        if r.random() < 0.15:
            pred, n = [[*x, 1] for x in pred], n + 1
        if pred and r.random() < 0.15:
            pred = pred[1:]
        pairs.append((pred, gold, n, n_cols, r.random() < 0.4))
    assert run(spark, pairs) == {i: rule(*c) for i, c in enumerate(pairs)}


def test_failed_sides(spark):
    shape = spark.createDataFrame([(0, "pred", False, None, 0, "x"), (0, "gold", True, 0, 1, None), (1, "pred", True, 0, 1, None)], SHAPE)
    ordered = spark.createDataFrame([(0, False), (1, False), (2, None)], "sample_id long, ordered boolean")
    got = {tuple(r) for r in compare(spark.createDataFrame([], CELLS), shape, ordered).collect()}
    assert got == {(i, False, 0.0, 0.0, 0.0) for i in range(3)}


def test_cells_of_all_types(spark):
    df = spark.sql("select cast(1 as tinyint) a, true b, 2.50D c, cast('NaN' as double) d, cast('-Infinity' as double) e, cast(1.10 as decimal(10,2)) f, 'x ' g, cast(null as int) h, date'2020-01-02' i, X'0aff' j, -0.0000000001D k, 1e20D l, array(1) m, null n, 3 c")
    cells = {r["col_idx"]: r["cell"] for r in stage(df, 7, "pred").collect()}
    assert [cells[i] for i in range(15)] == ["n1", "n1", "n2.5", "z", "n-inf", "n1.1", "sx ", "z", "s2020-01-02", "b0AFF", "n0", "n1.0E20", "s[1]", "z", "n3"]


@pytest.mark.parametrize("digits", [4, 6])
def test_rounding_is_pythons(spark, digits):
    from querylens.functions.labels import python_round

    r = random.Random(9)
    values = [r.uniform(-2, 2) for _ in range(2000)] + [i / 2**7 for i in range(-300, 300)] + [i * 10**-7 * 5 for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert all(r["r"] == round(r["v"], digits) for r in df.select("v", python_round(df.v, digits).alias("r")).collect())
