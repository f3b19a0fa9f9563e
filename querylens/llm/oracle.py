"""SQL (DuckDB) that says what the llm queries say."""

from __future__ import annotations

from querylens.llm.formats import MARKS, NARROW, UNSEEN, WIDE
from querylens.llm.words import WORD_SQL


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {_q(WORD_SQL)})"


def _key(name: str) -> str:
    last = rf"regexp_extract(trim({name}), '([^/\\]*)[/\\]*$', 1)"
    return rf"nullif(regexp_replace(lower(regexp_replace({last}, '(?i)\.(sqlite|db)\s*$', '')), '[^\p{{L}}\p{{N}}]', '', 'g'), '')"


def _canonical(text: str) -> str:
    shown = f"regexp_replace(lower(translate(coalesce({text}, ''), {_q(WIDE)}, {_q(NARROW)})), {_q(UNSEEN)}, '', 'g')"
    return f"translate({shown}, {_q(MARKS)}, '')"


FAMILY = f"""
  reg AS (SELECT {_key('db_id')} AS k, min(db_id) AS db_id, arg_min({_key('derived_from')}, db_id) AS fk FROM db_registry GROUP BY 1),
  up AS (SELECT a.k, a.db_id, b.k AS parent FROM reg a LEFT JOIN reg b ON a.fk = b.k AND a.fk <> a.k),
  climb AS (SELECT k, k AS at, 0 AS depth FROM up UNION ALL SELECT c.k, u.parent, depth + 1 FROM climb c JOIN up u ON u.k = c.at WHERE u.parent IS NOT NULL AND depth < 200),
  fam AS (SELECT c.k, r.db_id AS root_db FROM climb c JOIN up u ON u.k = c.at AND u.parent IS NULL JOIN reg r ON r.k = c.at)"""

GROUPS = f"""
  tok AS (SELECT sample_id AS id, w, row_number() OVER (PARTITION BY sample_id, w) AS k FROM (SELECT sample_id, unnest({_words("coalesce(question, '') || chr(10) || coalesce(query, '')")}) AS w FROM samples)),
  len AS (SELECT id, count(*) AS n FROM tok GROUP BY id),
  t AS (SELECT tok.*, n FROM tok JOIN len USING (id)),
  alike AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.w = b.w AND a.k = b.k AND a.id < b.id AND 20 * least(a.n, b.n) >= 17 * greatest(a.n, b.n)
            GROUP BY a.id, b.id, a.n, b.n HAVING 20 * count(*) >= 17 * greatest(a.n, b.n)),
  both_ways AS (SELECT a, b FROM alike UNION SELECT b, a FROM alike),
  reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
  grp AS (SELECT a AS sample_id, min(least(a, b)) AS group_id FROM reach GROUP BY a)"""

RECORDS = f"""
  rec AS (SELECT result_id, gold_sql, pred_sql FROM sample_results UNION ALL
          SELECT result_id, payload ->> '$.gold_sql', payload ->> '$.pred_sql' FROM report_lines WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
  can AS (SELECT result_id, {_canonical('gold_sql')} AS g, {_canonical('pred_sql')} AS p FROM rec),
  grp AS (SELECT *, min(result_id) OVER (PARTITION BY g, p) AS first_id FROM can)"""

LEAK = 12
P6 = f"""
  dw AS (SELECT doc_id, {_words('text')} AS w FROM documents),
  iw AS (SELECT item_id, {_words('passage')} AS w FROM eval_items),
  dn AS (SELECT doc_id, md5(list_aggregate(w[i : i + {LEAK - 1}], 'string_agg', ' ')) AS h FROM dw, range(1, len(w) - {LEAK - 2}) r(i)),
  n AS (SELECT item_id, md5(list_aggregate(w[i : i + {LEAK - 1}], 'string_agg', ' ')) AS h FROM iw, range(1, len(w) - {LEAK - 2}) r(i))"""

P8 = """
  d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 300),
  w AS (SELECT doc_id, i, md5(substr(text, i + 1, 300)) AS h FROM d, range(0, length(text) - 299) r(i)),
  s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
  hit AS (SELECT DISTINCT doc_id, i FROM w JOIN s USING (h)),
  isle AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS part
           FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 300 THEN 0 ELSE 1 END AS fresh FROM hit)),
  span AS (SELECT doc_id, min(i)::BIGINT AS span_start, (max(i) + 300)::BIGINT AS span_end FROM isle GROUP BY doc_id, part)"""

PAIRS = f"""
  row_ AS (SELECT sample_id, split, source, root_db, group_id FROM samples JOIN fam ON {_key('samples.db_id')} = fam.k JOIN grp USING (sample_id)),
  pair AS (SELECT t.sample_id AS train_id, e.sample_id AS eval_id FROM row_ t JOIN row_ e USING (group_id, root_db) WHERE t.split = 'train' AND e.split IN ('dev', 'test'))"""

COVER = f"""
  tx AS (SELECT sample_id, split, source, root_db, {_words("coalesce(question, '') || chr(10) || coalesce(query, '')")} AS w FROM samples JOIN fam ON {_key('samples.db_id')} = fam.k),
  sh AS (SELECT sample_id, split, root_db, i, md5(list_aggregate(w[i : i + 4], 'string_agg', ' ')) AS h FROM tx, range(1, len(w) - 3) r(i)),
  tr AS (SELECT DISTINCT root_db, h FROM sh WHERE split = 'train'),
  cv AS (SELECT sample_id, count(DISTINCT i + j) AS n FROM sh JOIN tr USING (root_db, h), range(0, 5) q(j) WHERE split IN ('dev', 'test') GROUP BY sample_id)"""

OWN = f"""
  own AS (SELECT coalesce('r:' || root_db, 'n:' || {_key('samples.db_id')}, 'i:' || coalesce(sample_id::VARCHAR, '')) AS family FROM samples LEFT JOIN fam ON {_key('samples.db_id')} = fam.k)"""


def _source(name: str) -> str:
    return f"replace(lower(regexp_replace({name}, '^\\s+|\\s+$', '', 'g')), '-', '_')"


ORACLE = {
    "p1_found": f"WITH RECURSIVE {GROUPS} SELECT group_id, sample_id FROM grp WHERE group_id <> sample_id",
    "p1_groups": f"""WITH RECURSIVE {GROUPS}, size AS (SELECT group_id, count(*) AS n FROM grp GROUP BY 1)
        SELECT sample_id, coalesce(group_id, sample_id) AS group_id, coalesce(n, 1)::BIGINT AS group_size FROM samples LEFT JOIN grp USING (sample_id) LEFT JOIN size USING (group_id)""",
    "p2_forest": f"""WITH RECURSIVE {FAMILY}, day AS (SELECT {_key('db_id')} AS k, arg_min(registered_at::DATE, db_id) AS at FROM db_registry GROUP BY 1)
        SELECT DISTINCT least(up.k, parent) AS a, greatest(up.k, parent) AS b, coalesce(abs(x.at - y.at), 0)::DOUBLE AS weight FROM up JOIN day x ON x.k = up.k JOIN day y ON y.k = parent WHERE parent IS NOT NULL""",
    "p2_families": f"WITH RECURSIVE {FAMILY}, {OWN} SELECT family, count(*) AS n_rows, 1::BIGINT AS n_splits FROM own GROUP BY 1",
    "p2_balance": f"WITH RECURSIVE {FAMILY}, {OWN} SELECT sum(n)::BIGINT AS n_rows, max(n) AS largest, 0::BIGINT AS n_off FROM (SELECT count(*) AS n FROM own GROUP BY family)",
    "p2_found": f"WITH RECURSIVE {FAMILY} SELECT sample_id, root_db FROM samples JOIN fam ON {_key('samples.db_id')} = fam.k WHERE samples.db_id <> root_db",
    "p3_found": f"WITH {RECORDS} SELECT first_id, result_id AS copy_id FROM grp WHERE result_id <> first_id",
    "p3_collapsed": f"WITH {RECORDS} SELECT first_id, count(*) AS copies FROM grp GROUP BY first_id",
    "p3_summary": f"WITH {RECORDS} SELECT count(*) AS n_records, count(DISTINCT first_id) AS n_different, 0::BIGINT AS n_collisions FROM grp",
    "p5_found": f"WITH RECURSIVE {FAMILY}, {GROUPS}, {PAIRS} SELECT least(train_id, eval_id) AS first_id, greatest(train_id, eval_id) AS second_id FROM pair",
    "p5_report": f"""WITH RECURSIVE {FAMILY}, {GROUPS}, {PAIRS}, per AS (SELECT eval_id AS sample_id, count(*) AS n FROM pair GROUP BY 1)
        SELECT split, source, count(*) AS n_rows, count(n) AS n_overlapping, coalesce(sum(n), 0)::BIGINT AS n_pairs FROM samples LEFT JOIN per USING (sample_id) WHERE split IN ('dev', 'test') GROUP BY split, source""",
    "p5_coverage": f"WITH RECURSIVE {FAMILY}, {COVER} SELECT sample_id, split, source, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_covered FROM tx LEFT JOIN cv USING (sample_id) WHERE split IN ('dev', 'test')",
    "p6_found": f"WITH {P6} SELECT DISTINCT item_id, doc_id FROM dn JOIN n USING (h)",
    "p6_items": f"WITH {P6}, f AS (SELECT DISTINCT item_id, doc_id FROM dn JOIN n USING (h)) SELECT e.item_id, suite, kind, count(doc_id) AS n_docs FROM eval_items e LEFT JOIN f ON e.item_id = f.item_id GROUP BY ALL",
    "p7_limits": f"""WITH d AS (SELECT {_source('source')} AS source, count(*) AS n FROM documents WHERE doc_id IS NOT NULL AND text <> '' GROUP BY 1)
        SELECT t.source, t.max_repeats, coalesce(n, 0)::BIGINT AS n_docs, 0::BIGINT AS n_over, false AS off FROM (SELECT {_source('source')} AS source, max_repeats FROM mix_targets) t LEFT JOIN d USING (source)""",
    "p8_found": f"WITH {P8} SELECT doc_id, span_start, span_end FROM span",
    "p8_shares": f"""WITH {P8}, per AS (SELECT doc_id, sum(span_end - span_start)::BIGINT AS n FROM span GROUP BY 1)
        SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(n, 0)::BIGINT AS shared_chars FROM documents LEFT JOIN per USING (doc_id)""",
}
