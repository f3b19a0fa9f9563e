import pytest

from querylens.functions.dialect import Unsupported, to_spark
from querylens.functions.prompts import CONVENTIONS, Template, conventions_block, fenced
from querylens.functions.sqltext import extract_sql, has_outermost_order_by, read


@pytest.mark.parametrize(
    "sql,want",
    [
        ("SELECT a FROM t ORDER BY a", True), ("SELECT a FROM t", False), ("SELECT * FROM (SELECT a FROM t ORDER BY a)", False), ("SELECT 'x order by y'", False),
        ("SELECT a FROM t UNION SELECT b FROM u ORDER  \n BY 1", True), ("SELECT row_number() OVER (ORDER BY a) FROM t", False), ("select 'it''s' order by 1", True), ("order (x) by", True),
        ("SELECT a -- order by\n", True), ('SELECT "order by"', False), ("SELECT `order` by", False), ("reorder by", False), ("", False), (None, False), ("select (a order by b", False), ("'open order by", False), ("select ') order by' from (t) order by 1", True), (") order by", False), ("order, by", True), ("order by1", False), ("a (b (c) order by) ((d)) ORDER\tBY e", True),
    ],
)
def test_outermost_order_by(spark, sql, want):
    df = spark.createDataFrame([(sql,)], "s string")
    assert df.select(has_outermost_order_by(df.s).alias("o")).first()["o"] is want


@pytest.mark.parametrize(
    "reply,want",
    [
        ("SELECT 1", "SELECT 1"), ("x\n```sql\nSELECT 1\n```\ny ```sql\nSELECT 2```", "SELECT 1"), ("```\n SELECT 1 ```", "SELECT 1"), ("``` ```", ""), ("  \n SELECT 1\t\n", "SELECT 1"), ("", ""), ("```SQL select 1```", "select 1"),
    ],
)
def test_extract(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "r string")
    assert df.select(extract_sql(df.r).alias("s")).first()["s"] == want == fenced(reply)


def test_facts():
    f = read("SELECT t.a, (b), count(*), -1, abs(x - y) AS d, \"q\" z FROM t JOIN u ON t.i = u.i WHERE n = 'it''s' AND 2 = m AND strftime('%Y', 'NOW') > 1.5 LIMIT 3")
    assert f["error"] is None and f["kinds"] == ["column", "derived", "derived", "derived", "derived", "column"]
    assert f["literals"] == ["1", "it's", "2", "%Y", "NOW", "1.5", "3"]
    assert list(zip(f["eq_columns"], f["eq_values"], f["eq_strings"])) == [("n", "it's", True), ("m", "2", False)]
    assert f["has_abs"] and f["has_now"] and f["select_has_sub"] and not f["has_div"]
    assert f["columns"] == ["a", "b", "i", "m", "n", "q", "x", "y"]


@pytest.mark.parametrize("sql", ["SELECT * FROM t", "SELECT t.* FROM t", "SELECT a, t.* FROM t"])
def test_stars(sql):
    assert "star" in read(sql)["kinds"]


@pytest.mark.parametrize(
    "sql",
    [
        "WITH a AS (SELECT 1 x UNION ALL SELECT 2) SELECT x FROM a WHERE x IN (SELECT y FROM b) AND EXISTS (SELECT 1) ORDER BY x DESC NULLS LAST LIMIT 2 OFFSET 1",
        "SELECT CASE WHEN a BETWEEN 1 AND 2 AND b IS NOT NULL THEN CAST(a AS DECIMAL(10, 2)) ELSE -b END FROM [my table] AS m, (SELECT 1) LEFT JOIN c USING (x, y)",
        "SELECT rank() OVER (PARTITION BY a ORDER BY b ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), sum(x) FILTER (WHERE y > 0) FROM t GROUP BY 1, 2 HAVING count(DISTINCT z) > 1;",
        "VALUES (1, 2), (3, 4)", "(SELECT 1) UNION SELECT 2", "SELECT a NOT LIKE 'x' ESCAPE '!' , b || c, a NOT IN (1), x ISNULL, NOT y FROM t NATURAL JOIN u", "SELECT 1 -- end", "DROP TABLE t", "SELECT 0x1F, .5, 1e3",
    ],
)
def test_reads(sql):
    assert read(sql)["error"] is None


@pytest.mark.parametrize("sql", ["", None, "hello there", "SELECT", "SELECT a FROM", "SELECT (a FROM t", "SELECT 'a", "SELECT a FROM t WHERE", "```sql SELECT 1```", "SELECT 1; SELECT 2", "select a b c from t"])
def test_does_not_read(sql):
    assert read(sql)["error"] is not None


@pytest.mark.parametrize(
    "sql,want",
    [
        ('SELECT "Name", "text" FROM [T]', "SELECT `Name` , 'text' FROM `T`"), ("SELECT a LIKE 'x' LIMIT 2, 3", "SELECT a ILIKE 'x' LIMIT 3 OFFSET 2"), ("SELECT a IS NOT 3", "SELECT a IS DISTINCT FROM 3"),
        ("SELECT CAST(a AS TEXT)", "SELECT cast(a as string)"), ("SELECT max(a), max(a, b)", "SELECT max(a) , CASE WHEN (a) IS NULL OR (b) IS NULL THEN NULL ELSE greatest(a, b) END"), ("SELECT t.a -- c", "SELECT t.a"),
        ("SELECT iif(a, 1.5, 2) ;", "SELECT if(a, 1.5D, 2)"),
    ],
)
def test_dialect(sql, want):
    assert to_spark(sql, frozenset({"name", "t"})) == want


@pytest.mark.parametrize("sql", ["SELECT typeof(a)", "SELECT strftime('%Q', a)", "SELECT ?", "SELECT 1; SELECT 2", "SELECT a GLOB b", "SELECT date('now', '-1 day')", "SELECT CAST(a AS thing)"])
def test_unsupported_is_an_error(sql):
    with pytest.raises(Unsupported):
        to_spark(sql)


def test_templates():
    t = Template('{question} is {"json": 1} {a} ', {"question", "a"})
    assert t.render(question="{a}", a="x") == 'x is {"json": 1} x '
    with pytest.raises(ValueError):
        t.render(question="q")
    with pytest.raises(ValueError):
        t.render(question="q", a="1", b="2")
    with pytest.raises(ValueError):
        Template("{other}", {"question"})
    assert len(CONVENTIONS) <= 12 and conventions_block("base\n").startswith("base\nK1. ")


def test_templates_of_a_folder(spark, tmp_path):
    from querylens.functions.prompts import composed, load_templates

    (tmp_path / "ask.user.txt").write_text('{question} as {"x": 1}\n', encoding="utf-8")
    found = load_templates(spark, str(tmp_path))
    assert found["ask.user"].render(question="q") == 'q as {"x": 1}\n' and set(found) == {"ask.user"}
    plain, ruled = (composed("declare", {"question": "q", "facts": "f", "schema": "s", "plan": "", "issues": "i"}, r) for r in (False, True))
    assert ruled[0]["content"].startswith(plain[0]["content"]) and "K11" in ruled[0]["content"] and plain[1] == ruled[1] and "Plan" not in plain[1]["content"]
    assert composed("plan", {"question": "q"}, True) == composed("plan", {"question": "q"})
