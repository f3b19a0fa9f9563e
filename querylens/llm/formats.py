"""Problem 3: records that differ in form only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.operators.shared import cut, join_counted

#: Full-width forms U+FF01 to U+FF5E stand for U+0021 to U+007E.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
#: Quote marks of any kind, square brackets and semicolons.
MARKS = "'\"`´‘’‚‛“”„‟‹›«»′″‴‵‶‷「」『』〝〞〟｢｣❛❜❝❞ʹʺʻʼʽˈˊˋ;；[]"
#: White space and invisible characters: separators, controls, formats and characters without a glyph.
UNSEEN = r"[\s\p{Z}\p{Cc}\p{Cf}͏ᅟᅠ឴឵ㅤﾠ︀-️]+"


_KEPT = [(w, n) for w, n in zip(WIDE, NARROW) if n not in MARKS]
#: All in one pass: characters that have a narrow form first, those that go away behind them.
_FROM = "".join(w for w, _ in _KEPT) + MARKS + "".join(w for w, n in zip(WIDE, NARROW) if n in MARKS and w not in MARKS)
_TO = "".join(n for _, n in _KEPT)


def canonical(text: Column) -> Column:
    """The text without what is form only; null gives the empty text."""
    return F.regexp_replace(F.lower(F.translate(F.coalesce(text, F.lit("")), _FROM, _TO)), UNSEEN, "")


def records(results: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows (result_id, gold_sql, pred_sql) of both tables; lines whose payload isn't one JSON object are no records."""
    fields = F.try_parse_json("payload").alias("v")
    parsed = lines.select("result_id", fields).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    return results.select("result_id", "gold_sql", "pred_sql").unionByName(
        parsed.select("result_id", *(F.try_variant_get("v", f"$.{c}", "string").alias(c) for c in ("gold_sql", "pred_sql")))
    )


def keyed(rows: DataFrame, ident: str, fields: list[str]) -> DataFrame:
    """Rows (id, h1, h2, h3): a 128-bit hash of the canonical fields and a third, independent hash as collision check.

    The third hash is part of the key, so two texts that collide in 128 bits still stay apart. Each field is closed by a
    character that canonical texts can't hold, so text can't move between fields.
    """
    text = F.concat(*(x for f in fields for x in (canonical(F.col(f)), F.lit("\x00"))))
    return rows.select(F.col(ident).alias("id"), text.alias("_t")).select("id", F.xxhash64("_t").alias("h1"), F.xxhash64(F.lit(7), "_t").alias("h2"), F.crc32("_t").cast("long").alias("h3"))


def collapse(rows: DataFrame, ident: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, groups): keyed rows as a written table, and one row (h1, h2, h3, first_id, copies) for each group of copies.

    Counted with map-side combining, so a group of any size costs one row a task. Null ids count as copies but are never
    first_id, unless all of a group are null.
    """
    keys = cut(keyed(rows, ident, fields))
    return keys, keys.groupBy("h1", "h2", "h3").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))


def collisions(groups: DataFrame) -> DataFrame:
    """Rows (h1, h2, n): 128-bit hashes that belong to n different texts, which the third hash tells apart. groups: of collapse()."""
    return groups.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")


def found(rows: DataFrame, ident: str, fields: list[str]) -> DataFrame:
    """Rows (first_id, copy_id) for every record but the smallest id of its copies."""
    keys, groups = collapse(rows, ident, fields)
    many = cut(groups.where("copies > 1"))
    return join_counted(keys, many, ["h1", "h2", "h3"], "copies").where("id != first_id").select("first_id", F.col("id").alias("copy_id"))
