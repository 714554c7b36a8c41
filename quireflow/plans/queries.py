"""The registered queries: each runs operators over whole tables, with the same in SQL beside it.

The tables have no scanned pages, so each query first renders its columns as
they would be read from one; the SQL says the same rendering and the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, numbers, scoring, similarity, text
from ..operators import cells, choose, compare, grid, images, records, review, windows
from ..sources import artefacts
from ..sources.articles import KNOWN_ARTICLES
from . import kernel_queries, page_queries  # noqa: F401  (they register theirs)
from .registry import QUERIES, SQL, registered  # noqa: F401
from .registry import case as _case
from .registry import spread_table as _spread
from .registry import table as _t

_BASIC = "trim(replace(replace(replace(replace(replace(trim(regexp_replace({0}, '\\s+', ' ', 'g')), 'Da.', 'Do.'), 'Da,', 'Do.'), 'Do,', 'Do.'), 'Vent.', 'Cent.'), 'Vent', 'Cent'))"


def _basic(expression: str) -> str:
    return _BASIC.format(expression)


@registered(f"SELECT doc_id, {_basic("'Da. ' || text || '  Vent. Do, '")} AS cleaned FROM documents")
def q01_text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic text normalisation of whole documents. [TXT1, TXT2]"""
    docs = _spread(spark, sf_dir, "documents")
    return docs.select("doc_id", text.basic(F.concat(F.lit("Da. "), "text", F.lit("  Vent. Do, "))).alias("cleaned"))


@registered(
    """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
v AS (SELECT CASE WHEN length(line) % 5 = 0 THEN regexp_replace(line, '[^\\s]', '.', 'g') ELSE line END AS v FROM l)
SELECT v = '' OR regexp_full_match(regexp_replace(v, '\\s+', '', 'g'), '[.\\-–—_:;|]{2,}') OR regexp_replace(v, '\\s+', '', 'g') = '' AS placeholder, count(*) AS n FROM v GROUP BY 1"""
)
def q02_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold nothing but leader dots. [PRD1]"""
    lines = _spread(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    value = F.when(F.length("line") % 5 == 0, F.regexp_replace("line", r"[^\s]", ".")).otherwise(F.col("line"))
    return lines.select(text.is_placeholder(value).alias("placeholder")).groupBy("placeholder").agg(F.count("*").alias("n"))


@registered(
    """WITH r AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS n FROM orders),
v AS (SELECT o_orderkey, CASE o_orderkey % 7
  WHEN 0 THEN (n // 1000) || ',' || lpad((n % 1000)::VARCHAR, 3, '0') WHEN 1 THEN (n // 1000) || '.' || lpad((n % 1000)::VARCHAR, 3, '0')
  WHEN 2 THEN '. . .' WHEN 3 THEN n || '.25' WHEN 4 THEN '| ' || n || ' ;' WHEN 5 THEN 'Rs. ' || n ELSE '— ' END AS raw FROM r),
c AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS clean FROM v),
b AS (SELECT *, clean = '' OR regexp_full_match(replace(clean, ' ', ''), '[.\\-–—_:;|]{2,}') AS blank,
  trim(replace(replace(replace(replace(replace(clean, ' ', ''), ',', ''), '—', '-'), '−', '-'), '|', ''), '.,;:') AS bare FROM c),
g AS (SELECT *, CASE WHEN regexp_full_match(bare, '-?\\d{1,3}(\\.\\d{3})+') OR regexp_full_match(bare, '-*\\d+\\.\\d{3}') THEN replace(bare, '.', '') ELSE bare END AS joined FROM b),
p AS (SELECT *, CASE WHEN regexp_full_match(joined, '-?\\d+(\\.\\d+)?') THEN TRY_CAST(joined AS DOUBLE) END AS number FROM g)
SELECT o_orderkey, raw, CASE WHEN NOT blank THEN number END AS value, NOT blank AND number IS NULL AS suspicious FROM p"""
)
def q03_numeric_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed numbers read back. [NUM1]"""
    n = F.floor("o_totalprice")
    thousands = lambda by: F.concat(F.floor(n / 1000).cast("string"), F.lit(by), F.lpad((n % 1000).cast("string"), 3, "0"))
    s = n.cast("string")
    raw = _case(F.col("o_orderkey"), thousands(","), thousands("."), F.lit(". . ."), F.concat(s, F.lit(".25")), F.concat(F.lit("| "), s, F.lit(" ;")), F.concat(F.lit("Rs. "), s), F.lit("— "))
    rows = _spread(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.select("o_orderkey", "raw", F.inline(F.array(numbers.clean_number(F.col("raw")))))


_EDGES = "'" + text.ARTICLE_EDGES.replace("'", "''") + "'"
_NOISE = ", ".join(f"'{t}'" for t in text.NOISE_TOKENS)


def _strip_edges_sql(column: str) -> str:
    """Noise dropped from both ends of a list of words, as SQL."""
    token = f"lower(trim({column}[i], {_EDGES}))"
    noise = f"({token} = '' OR regexp_full_match({token}, '\\d{{1,3}}') OR {token} IN ({_NOISE}) OR (length({token}) = 1 AND {token} <> 'a') OR NOT regexp_matches({token}, '[a-z0-9]'))"
    sound = f"list_filter(range(1, len({column}) + 1), lambda i: NOT {noise})"
    return f"CASE WHEN len({column}) < 2 THEN {column} WHEN len({sound}) = 0 THEN {column}[-1:] ELSE {column}[list_min({sound}):list_max({sound})] END"


@registered(
    f"""WITH r AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '12 ' || p_name || ' ve 9' WHEN 1 THEN '{{( ' || p_name || ' ...,' WHEN 2 THEN '1 2 3' WHEN 3 THEN '. . . .' ELSE 'a | ' || p_name || '. x' END AS raw FROM part),
b AS (SELECT *, {_basic("raw")} AS value FROM r),
w AS (SELECT *, list_filter(string_split(value, ' '), lambda x: x <> '') AS w FROM b),
s AS (SELECT *, array_to_string({_strip_edges_sql("w")}, ' ') AS inner_ FROM w),
h AS (SELECT *, rtrim(regexp_replace(inner_, '^(?:[{{}}\\[\\]\\\\("]\\s*)+', ''), ''',.; °') AS cut FROM s),
v AS (SELECT *, list_filter(string_split(cut, ' '), lambda x: x <> '') AS v FROM h),
z AS (SELECT *, array_to_string({_strip_edges_sql("v")}, ' ') AS name FROM v)
SELECT p_partkey, raw, CASE WHEN value = '' OR regexp_full_match(replace(value, ' ', ''), '[.\\-–—_:;|]{{2,}}') OR NOT regexp_matches(name, '[A-Za-z0-9]') THEN '' ELSE name END AS article FROM z"""
)
def q04_edge_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles without the noise at their ends. [PRD4, TXT6, TXT7, TXT8]"""
    name = F.col("p_name")
    raw = _case(F.col("p_partkey"), F.concat(F.lit("12 "), name, F.lit(" ve 9")), F.concat(F.lit("{( "), name, F.lit(" ...,")), F.lit("1 2 3"), F.lit(". . . ."), F.concat(F.lit("a | "), name, F.lit(". x")))
    return _spread(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), text.clean_article(raw).alias("article"))


@registered(
    """WITH r AS (SELECT CASE l_linenumber % 8 WHEN 0 THEN 'No' WHEN 1 THEN ' No] ' WHEN 2 THEN 'Cwtl' WHEN 3 THEN 'Ibs.' WHEN 4 THEN '“' WHEN 5 THEN '..' WHEN 6 THEN '-' ELSE l_returnflag || 'gs.' END AS raw FROM lineitem),
u AS (SELECT raw, CASE trim(raw) WHEN 'No' THEN 'No.' WHEN 'No]' THEN 'No.' WHEN 'Cwtl' THEN 'Cwt.' WHEN 'Ibs.' THEN 'lbs.' ELSE trim(raw) END AS u FROM r)
SELECT raw, CASE WHEN u IN ('"', '“', '”') THEN '"' WHEN regexp_matches(u, '[A-Za-z0-9"]') THEN u ELSE '' END AS unit, count(*) AS n FROM u GROUP BY ALL"""
)
def q05_unit_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units in their usual spelling. [TXT10]"""
    raw = _case(F.col("l_linenumber"), *map(F.lit, ("No", " No] ", "Cwtl", "Ibs.", "“", "..", "-")), F.concat("l_returnflag", F.lit("gs.")))
    return _t(spark, sf_dir, "lineitem").select(raw.alias("raw"), text.clean_unit(raw).alias("unit")).groupBy("raw", "unit").agg(F.count("*").alias("n"))


@registered(
    f"""WITH r AS (SELECT CASE o_orderkey % 8 WHEN 0 THEN 'at 3 per Vent.' WHEN 1 THEN 'Da.' WHEN 2 THEN 'per  do' WHEN 3 THEN '3 Rs. per In. Md.' WHEN 4 THEN 'at 5 per Cent.' WHEN 5 THEN '5 cent' WHEN 6 THEN '' ELSE o_orderpriority END AS raw FROM orders),
b AS (SELECT raw, {_basic("raw")} AS v FROM r),
p AS (SELECT *, trim(regexp_replace(lower(v), '[^a-z0-9.]+', ' ', 'g')) AS p FROM b),
n AS (SELECT *, len(list_filter(string_split(p, ' '), lambda x: x <> '')) AS n FROM p),
t AS (SELECT raw, v, p IN ('do', 'do.', 'per do', 'per do.') AS ditto, contains(p, 'cent') AND n <= 3 AS short,
  contains(p, '3') AND contains(p, 'cent') AND (contains(p, 'at') OR contains(p, 'per')) AND n <= 6 AS cent,
  contains(p, '3') AND contains(p, 'rs') AND (contains(p, 'md') OR contains(p, 'in')) AND n <= 8 AS rs FROM n)
SELECT raw, CASE WHEN ditto THEN 'Do.' WHEN short OR cent THEN 'at 3 per Cent.' WHEN rs THEN 'at 3 Rs. per In. Md.' ELSE v END AS foreign_rate,
  CASE WHEN ditto THEN 'Do.' WHEN cent THEN 'at 3 per Cent.' WHEN rs THEN 'at 3 Rs. per In. Md.' ELSE v END AS indian_rate, count(*) AS n FROM t GROUP BY ALL"""
)
def q06_rate_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duty rates in their usual forms. [TXT11]"""
    raw = _case(F.col("o_orderkey"), *map(F.lit, ("at 3 per Vent.", "Da.", "per  do", "3 Rs. per In. Md.", "at 5 per Cent.", "5 cent", "")), F.col("o_orderpriority"))
    rows = _spread(spark, sf_dir, "orders").select(raw.alias("raw"))
    rows = rows.select("raw", text.clean_rate(F.col("raw"), "foreign_duty_rate").alias("foreign_rate"), text.clean_rate(F.col("raw"), "indian_duty_rate").alias("indian_rate"))
    return rows.groupBy("raw", "foreign_rate", "indian_rate").agg(F.count("*").alias("n"))


_UNITS = text.UNIT_WORDS


@registered(
    f"""WITH r AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN p_name || ' No.' WHEN 2 THEN p_name || ', Bags' WHEN 4 THEN 'Cwt.' WHEN 5 THEN '' ELSE p_name END AS a,
  CASE p_partkey % 6 WHEN 2 THEN 'bags' WHEN 3 THEN 'Pieces' WHEN 0 THEN '"' WHEN 5 THEN 'No' ELSE '' END AS u FROM part),
v AS (SELECT p_partkey, a, CASE WHEN regexp_full_match(u, '(?i)(?:{_UNITS})') THEN u ELSE '' END AS u FROM r),
x AS (SELECT *, regexp_extract(a, '(?i)\\b(?:{_UNITS})$') AS i FROM v),
y AS (SELECT *, rtrim(left(a, length(a) - length(i)), ' ,;:-') AS before FROM x)
SELECT p_partkey, CASE WHEN a = '' THEN '' WHEN u <> '' AND ends_with(lower(a), lower(u)) THEN rtrim(left(a, length(a) - length(u)), ' ,;:-') WHEN i <> '' AND before <> '' THEN before ELSE a END AS article,
  CASE WHEN a <> '' AND u = '' AND i <> '' AND before <> '' THEN i ELSE u END AS unit FROM y"""
)
def q07_article_unit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units moved out of articles. [TXT12]"""
    key, name = F.col("p_partkey"), F.col("p_name")
    article = _case(key, name, F.concat(name, F.lit(" No.")), F.concat(name, F.lit(", Bags")), name, F.lit("Cwt."), F.lit(""))
    unit = _case(key, *map(F.lit, ('"', "", "bags", "Pieces", "", "No")))
    return _t(spark, sf_dir, "part").select("p_partkey", F.inline(F.array(text.split_article_and_unit(article, unit))))


@registered(
    """WITH v AS (SELECT *, CASE event_type WHEN 'error' THEN 'Do.' WHEN 'signup' THEN '' ELSE event_type END AS raw FROM events)
SELECT event_id, user_id, CASE WHEN raw = 'Do.' THEN coalesce(last_value(CASE WHEN raw NOT IN ('', 'Do.') THEN raw END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE raw END AS rate FROM v"""
)
def q08_ditto_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ditto marks filled from above. [WIN1]"""
    kind = F.col("event_type")
    rows = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(kind == "error", "Do.").when(kind == "signup", "").otherwise(kind).alias("rate"))
    return windows.fill_dittos(rows, ["rate"], ["user_id"], ["ts", "event_id"]).drop("ts")


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        (F.col("l_quantity") % 20).alias("foreign_duty_as"),
        F.col("l_linenumber").alias("foreign_duty_p"),
        (F.col("l_discount") * 10).alias("mean_confidence"),
        F.when(F.col("l_tax") == 0, "foreign_value_rs_non_numeric").alias("bad"),
    )
    issues = [*records.range_issues(fields=("foreign_duty_as", "foreign_duty_p")), F.when(F.col("mean_confidence") < 0.55, "low_ocr_confidence"), F.col("bad"), F.col("bad")]
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", records.issue_flag(issues).alias("confidence_flag"))


_FLAGGED = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN len(issues) = 0 THEN 'ok' ELSE 'review:' || array_to_string(issues, ';') END AS confidence_flag
FROM (SELECT *, list_sort(list_distinct(list_filter([CASE WHEN l_quantity % 20 > 15 THEN 'annas_out_of_range' END, CASE WHEN l_linenumber > 3 THEN 'pies_out_of_range' END,
  CASE WHEN l_discount * 10 < 0.55 THEN 'low_ocr_confidence' END, CASE WHEN l_tax = 0 THEN 'foreign_value_rs_non_numeric' END], lambda x: x IS NOT NULL))) AS issues FROM lineitem)"""


@registered(_FLAGGED)
def q09_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags for review. [PRD6, AGG16, FLG1]"""
    return _flagged(spark, sf_dir)


@registered(
    f"""SELECT p_partkey, article FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Spices' WHEN 1 THEN 'spices' WHEN 2 THEN 'Cotton Goods' ELSE p_name END AS article FROM part)
WHERE article NOT IN ({", ".join(f"'{c}'" for c in text.CATEGORIES)})"""
)
def q10_category_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that aren't category headings. [PRD5, JN11]"""
    article = _case(F.col("p_size"), F.lit("Spices"), F.lit("spices"), F.lit("Cotton Goods"), F.col("p_name"), F.col("p_name"))
    return records.without_categories(_t(spark, sf_dir, "part").select("p_partkey", article.alias("article")))


@registered(
    f"""WITH f AS ({_FLAGGED}) SELECT 'rows_total' AS metric, count(*) AS value FROM f UNION ALL SELECT 'rows_ok', count(*) FROM f WHERE confidence_flag = 'ok'
UNION ALL SELECT 'rows_review', count(*) FROM f WHERE starts_with(confidence_flag, 'review:')"""
)
def q11_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export's summary. [AGG14, PRD8]"""
    return records.summary(_flagged(spark, sf_dir))


def _golden(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = _t(spark, sf_dir, "orders")
    truth = orders.select(F.col("o_orderkey").alias("row_no"), F.col("o_orderstatus").alias("unit"), F.col("o_orderpriority").alias("article"), F.col("o_custkey").cast("string").alias("total_value"), F.lit("x").alias("only_here"))
    unit = F.when(F.col("row_no") % 7 == 0, F.lit(None)).otherwise(F.col("unit"))
    read = {"unit": unit, "article": F.concat(F.lit(" "), "article", F.when(F.col("row_no") % 11 == 0, ".").otherwise(" "))}
    return truth, truth.where("row_no % 13 <> 0").withColumns(read).drop("only_here")


_GOLDEN = """WITH j AS (SELECT o_orderkey AS row_no, o_orderstatus AS unit_t, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderstatus END AS unit_p, trim(o_orderpriority) AS article_t,
  CASE WHEN o_orderkey % 11 = 0 THEN trim(o_orderpriority || '.') ELSE trim(o_orderpriority) END AS article_p, o_custkey::VARCHAR AS total FROM orders WHERE o_orderkey % 13 <> 0)"""


@registered(
    _GOLDEN
    + """SELECT 'unit' AS field, count(*) FILTER (unit_t = unit_p) AS matches, count(*) AS joined FROM j UNION ALL SELECT 'article', count(*) FILTER (article_t = article_p), count(*) FROM j
UNION ALL SELECT 'total_value', count(*), count(*) FROM j UNION ALL SELECT '*', count(*) FILTER (unit_t = unit_p AND article_t = article_p), count(*) FROM j"""
)
def q12_eval_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with a golden table by field. [JN1, AGG15, SET4, TXT16]"""
    return compare.field_matches(*_golden(spark, sf_dir))


@registered(
    _GOLDEN
    + """SELECT row_no, 'unit' AS field, unit_t AS expected, unit_p AS actual FROM j WHERE unit_t <> unit_p UNION ALL SELECT row_no, 'article', article_t, article_p FROM j WHERE article_t <> article_p"""
)
def q13_eval_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences from a golden table. [DIF1]"""
    return compare.differences(*_golden(spark, sf_dir))


@registered("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)")
def q14_semi_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have a surviving record. [PRD13, JN10]"""
    kept = _t(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return cells.surviving(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), kept, ["o_custkey"])


@registered(
    """SELECT o_orderkey AS row_no, o_orderpriority AS article, o_totalprice AS total_value, NULL::VARCHAR AS col_03 FROM orders
UNION ALL SELECT l_orderkey, NULL, l_extendedprice, l_returnflag FROM lineitem"""
)
def q15_union_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of tables of different width. [SET1, SET2]"""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_no"), F.col("o_orderpriority").alias("article"), F.col("o_totalprice").alias("total_value"))
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_no"), F.col("l_extendedprice").alias("total_value"), F.col("l_returnflag").alias("col_03"))
    return records.union_all([orders, lines])


@registered(
    """WITH t AS (SELECT l_orderkey AS id, l_linenumber AS n, l_suppkey AS page, l_quantity * 20 + 5 AS xc, (l_partkey % 300) * 4 + 4 AS yc FROM lineitem),
b AS (SELECT p.page, r.row_no, c.field, c.left_, c.right_, r.row_no * 100 + 8 AS top, r.row_no * 100 + 92 AS bottom
  FROM (SELECT s_suppkey AS page FROM supplier) p, (SELECT unnest(range(12)) AS row_no) r, (VALUES ('article', 10, 300), ('total_value', 300, 600), ('remarks', 610, 990)) c(field, left_, right_))
SELECT b.page, row_no, field, count(*) AS n, sum(id)::BIGINT AS ids, min(n) AS first_line FROM t JOIN b ON t.page = b.page AND xc BETWEEN left_ AND right_ AND yc BETWEEN top AND bottom GROUP BY ALL"""
)
def q16_token_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in boxes, edges included. [JN2, JN3, GEO1]"""
    tokens = _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("page"), (F.col("l_quantity") * 20).alias("x"), (F.col("l_partkey") % 300 * 4).alias("y"), F.lit(10).alias("width"), F.lit(8).alias("height")
    )
    columns = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(a).alias("left"), F.lit(b).alias("right")) for f, a, b in (("article", 10, 300), ("total_value", 300, 600), ("remarks", 610, 990))])
    boxes = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.inline(columns)).select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("row_no"))
    boxes = boxes.withColumns({"top": F.col("row_no") * 100 + 8, "bottom": F.col("row_no") * 100 + 92})
    found = cells.tokens_in_boxes(tokens, boxes, ["page"])
    return found.groupBy("page", "row_no", "field").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.min("n").alias("first_line"))


@registered(
    """SELECT conv_id, string_agg(text, ' ' ORDER BY y, x, pos) AS joined FROM (SELECT conv_id, turn // 2 AS y, CASE role WHEN 'user' THEN 0 ELSE 1 END AS x, turn AS pos, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations) GROUP BY conv_id"""
)
def q17_cell_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens joined in reading order. [AGG2, SRT1]"""
    turns = _t(spark, sf_dir, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("y"), F.when(F.col("role") == "user", 0).otherwise(1).alias("x"), F.col("turn").alias("pos"), text.clean_spaces(F.col("text")).alias("text"))
    joined = turns.groupBy("conv_id").agg(cells.reading_order().alias("tokens"))
    return joined.select("conv_id", F.array_join(F.transform("tokens", lambda t: t["text"]), " ").alias("joined"))


@registered(
    """WITH p AS (SELECT DISTINCT user_id, floor(epoch(ts) / 3600)::INT - 473352 AS pos FROM events),
s AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 8 THEN 0 ELSE 1 END AS starts FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
i AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY pos) AS island FROM s)
SELECT user_id, island::BIGINT AS island, round_even(avg(pos), 0)::INT AS pos FROM i GROUP BY ALL"""
)
def q18_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near positions and their centres. [WIN2, AGG12]"""
    hours = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("int") - 473352
    positions = _t(spark, sf_dir, "events").select("user_id", hours.alias("pos")).distinct()
    return windows.group_centres(positions, ["user_id"], "pos", 8)


_PROFILE = """WITH h AS (SELECT l_linestatus AS page, date_diff('day', DATE '1995-01-01', l_shipdate::DATE)::INT AS position, count(*)::DOUBLE AS value FROM lineitem GROUP BY ALL),
m AS (SELECT page, greatest(quantile_cont(value, 0.9), max(value) * 0.12) AS least FROM h GROUP BY page),
k AS (SELECT h.page, position FROM h JOIN m ON h.page = m.page AND value >= least),
s1 AS (SELECT *, CASE WHEN position - lag(position) OVER (PARTITION BY page ORDER BY position) <= 8 THEN 0 ELSE 1 END AS starts FROM k),
i1 AS (SELECT *, sum(starts) OVER (PARTITION BY page ORDER BY position) AS island FROM s1),
p AS (SELECT page, island, round_even(avg(position), 0)::INT AS position FROM i1 GROUP BY ALL),
s2 AS (SELECT *, CASE WHEN position - lag(position) OVER (PARTITION BY page ORDER BY position) <= 25 THEN 0 ELSE 1 END AS starts FROM p),
i2 AS (SELECT *, sum(starts) OVER (PARTITION BY page ORDER BY position) AS island2 FROM s2),
b AS (SELECT page, island2, round_even(avg(position), 0)::INT AS position FROM i2 GROUP BY ALL),
n AS (SELECT page, position AS left_, lead(position) OVER (PARTITION BY page ORDER BY position) AS right_ FROM b)
SELECT page, 2500 AS page_width, left_ AS "left", right_ AS "right", (row_number() OVER (PARTITION BY page ORDER BY left_) - 1)::INT AS "index" FROM n WHERE right_ - left_ >= 18"""


@registered(_PROFILE)
def q19_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns between the peaks of a profile. [AGG10, AGG11, WIN2, WIN3, IMG19]"""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    profile = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("page"), day.alias("position")).agg(F.count("*").cast("double").alias("value"))
    widths = profile.select("page").distinct().withColumn("page_width", F.lit(2500))
    return grid.column_intervals(profile, widths, ["page"])


@registered(
    """WITH o AS (SELECT year(o_orderdate)::INT AS page, month(o_orderdate)::INT AS row_no FROM orders),
c AS (SELECT page, row_no, row_no * 30 + (count(*) % 7)::DOUBLE AS centre FROM o GROUP BY 1, 2),
g AS (SELECT *, lag(centre) OVER w AS above, lead(centre) OVER w AS below FROM c WINDOW w AS (PARTITION BY page ORDER BY row_no)),
m AS (SELECT *, median(below - centre) OVER (PARTITION BY page) AS gap FROM g)
SELECT page, row_no, greatest(0, trunc(CASE WHEN gap IS NULL THEN trunc(centre) - 10 WHEN above IS NULL THEN greatest(0, centre - gap / 2) ELSE (above + centre) / 2 END))::INT AS top,
  least(365, trunc(CASE WHEN gap IS NULL THEN trunc(centre) + 10 WHEN below IS NULL THEN least(365, centre + gap / 2) ELSE (centre + below) / 2 END))::INT AS bottom FROM m"""
)
def q20_row_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows' tops and bottoms from their centres. [GEO10, WIN4, WIN5, AGG9]"""
    day = F.col("o_orderdate")
    centres = _t(spark, sf_dir, "orders").groupBy(F.year(day).alias("page"), F.month(day).alias("row_no")).agg(F.count("*").alias("n"))
    centres = centres.select("page", "row_no", (F.col("row_no") * 30 + F.col("n") % 7).cast("double").alias("centre"), F.lit(365).alias("height"))
    return windows.row_bounds(centres, ["page"])


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers as a strip might read them: 48 a page, each page with its own step, and some misread."""
    supplier = _t(spark, sf_dir, "supplier")
    rows = supplier.select(F.floor(F.col("s_suppkey") / 8).alias("page"), F.col("s_suppkey").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    row_no = (F.col("key") % 8 * 6 + F.col("i")).cast("int") + 1
    off = F.when((F.col("key") + F.col("i")) % 9 == 0, 40).otherwise((F.col("key") * 7 + F.col("i") * 3) % 5)
    y = row_no * (30 + F.col("page") % 25) + 100 + off
    return rows.select("page", row_no.alias("row_no"), y.cast("double").alias("y"), (0.5 + F.col("i") / 16).alias("confidence"), row_no.alias("pos"))


_CANDIDATES = """c AS (SELECT page, row_no::INT AS row_no, (row_no * (30 + page % 25) + 100 + CASE WHEN (key + i) % 9 = 0 THEN 40 ELSE (key * 7 + i * 3) % 5 END)::DOUBLE AS y, 0.5 + i / 16 AS confidence
  FROM (SELECT s_suppkey // 8 AS page, s_suppkey AS key, i, (s_suppkey % 8) * 6 + i + 1 AS row_no FROM supplier, (SELECT unnest(range(6)) AS i)))"""


@registered(
    f"""WITH {_CANDIDATES},
l AS (SELECT a.page, a.row_no AS pa, b.row_no AS pb, (b.y - a.y) / (b.row_no - a.row_no) AS step, a.y - (b.y - a.y) / (b.row_no - a.row_no) * a.row_no AS icpt
  FROM c a JOIN c b ON a.page = b.page AND a.row_no < b.row_no AND b.y > a.y WHERE (b.y - a.y) / (b.row_no - a.row_no) BETWEEN 25 AND 65),
n AS (SELECT l.page, pa, pb, step, icpt, count(DISTINCT c.row_no) AS n_rows, sum(1 + confidence - abs(step * row_no + icpt - y) / greatest(8, step * 0.35) * 0.25) AS score
  FROM l JOIN c ON l.page = c.page AND abs(step * row_no + icpt - y) <= greatest(8, step * 0.35) GROUP BY ALL)
SELECT page, round(step, 6) AS step, round(icpt, 6) AS intercept, n_rows, round(score, 6) AS score FROM n WHERE n_rows >= 8 QUALIFY row_number() OVER (PARTITION BY page ORDER BY n_rows DESC, round(score, 9) DESC, pa, pb) = 1"""
)
def q21_pair_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that most row numbers lie near. [JN5, JN6, AGG7, TOP2, NUM10]"""
    found = grid.pair_models(_candidates(spark, sf_dir), ["page"])
    return found.select("page", *[F.round(c, 6).alias(c) for c in ("step", "intercept")], "n_rows", F.round("score", 6).alias("score"))


@registered(
    f"""WITH {_CANDIDATES},
m AS (SELECT DISTINCT page, (31 + page % 25)::DOUBLE AS step, 85.0::DOUBLE AS icpt, 7.5::DOUBLE AS score FROM c),
b AS (SELECT c.page, row_no, y, step, icpt, score FROM c JOIN m ON c.page = m.page WHERE abs(step * row_no + icpt - y) <= greatest(8, step * 0.35)
  QUALIFY row_number() OVER (PARTITION BY c.page, row_no ORDER BY confidence DESC, row_no) = 1),
f AS (SELECT page, CASE WHEN count(*) > 1 THEN regr_slope(y, row_no) ELSE min(step) END AS step, CASE WHEN count(*) > 1 THEN regr_intercept(y, row_no) ELSE min(icpt) END AS icpt, min(score) AS score FROM b GROUP BY page)
SELECT f.page, round(step, 6) AS step, round(icpt, 6) AS intercept, score, count(DISTINCT row_no) AS n_rows, min(row_no)::INT AS first_row
FROM f JOIN c ON f.page = c.page WHERE abs(step * row_no + icpt - y) <= greatest(8, step * 0.35) GROUP BY ALL"""
)
def q22_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line refined by least squares through the surest inlier of each row. [AGG5, AGG8, NUM10]"""
    candidates = _candidates(spark, sf_dir)
    models = candidates.select("page").distinct().withColumns({"step": (31 + F.col("page") % 25).cast("double"), "intercept": F.lit(85.0), "score": F.lit(7.5)})
    found = grid.refined_models(models, candidates, ["page"])
    return found.select("page", F.round("step", 6).alias("step"), F.round("intercept", 6).alias("intercept"), "score", "n_rows", "first_row")


@registered(
    """WITH a AS (SELECT s_nationkey AS page, (s_suppkey % 20 + 1)::INT AS row_no, min((s_suppkey % 20 + 1) * 22 + 40 + s_suppkey % 7)::DOUBLE AS y FROM supplier GROUP BY 1, 2),
e AS (SELECT page FROM a GROUP BY page HAVING count(*) >= 4),
g AS (SELECT greatest(12, 500.0::DOUBLE / 22 * 0.65) AS low, greatest(greatest(12, 500.0::DOUBLE / 22 * 0.65) + 0.5, 500.0::DOUBLE / 22 * 1.35) AS high),
st AS (SELECT low + i * 0.5::DOUBLE AS step FROM g, (SELECT unnest(range(100)) AS i) WHERE i < ceil((high + 0.1::DOUBLE - low) / 0.5)),
ic AS (SELECT 20::DOUBLE + i * 0.5::DOUBLE AS icpt FROM (SELECT unnest(range(300)) AS i) WHERE i < ceil((500 * 0.24::DOUBLE + 0.1::DOUBLE - 500 * 0.04::DOUBLE) / 0.5)),
s AS (SELECT a.page, step, icpt, sum(CASE abs(round_even((y - icpt) / step, 0) - row_no) WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END) AS score FROM a JOIN e ON a.page = e.page, st, ic GROUP BY ALL)
SELECT page, round(step, 6) AS step, round(icpt, 6) AS intercept, score::INT AS score FROM s QUALIFY row_number() OVER (PARTITION BY page ORDER BY score DESC, step, icpt) = 1"""
)
def q23_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row grid that most anchors fall on. [JN7, AGG6, TOP1, NUM9]"""
    key = F.col("s_suppkey")
    row_no = (key % 20 + 1).cast("int")
    anchors = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("page"), row_no.alias("row_no")).agg(F.min((key % 20 + 1) * 22 + 40 + key % 7).cast("double").alias("y"))
    pages = anchors.select("page").distinct().withColumns({"height": F.lit(500), "expected_rows": F.lit(20), "row_start": F.lit(1)})
    found = grid.grid_models(anchors, pages, ["page"])
    return found.select("page", F.round("step", 6).alias("step"), F.round("intercept", 6).alias("intercept"), F.col("score").cast("int").alias("score"))


@registered(
    """WITH o AS (SELECT user_id, event_id // 4 AS cell, CASE event_id % 4 WHEN 0 THEN 'tesseract' WHEN 1 THEN 'paddle' WHEN 2 THEN 'glm' ELSE 'other' END AS engine, CASE event_type WHEN 'error' THEN '—' ELSE ' ' || (value::INT % 3 + 1) || ',000. ' END AS value FROM events),
v AS (SELECT *, replace(replace(trim(trim(value), '.,;:'), ' ', ''), ',', '') AS vote, coalesce(nullif(list_position(['tesseract', 'paddle', 'glm'], engine), 0), 4) AS place FROM o),
w AS (SELECT cell, vote, count(*) AS n, min(place) AS place FROM v WHERE regexp_matches(vote, '\\d') GROUP BY 1, 2),
b AS (SELECT cell, vote, n, place, sum(n) OVER (PARTITION BY cell) AS total FROM w QUALIFY row_number() OVER (PARTITION BY cell ORDER BY n DESC, place) = 1)
SELECT c.cell, coalesce(vote, '') AS value, CASE place WHEN 1 THEN 'tesseract' WHEN 2 THEN 'paddle' WHEN 3 THEN 'glm' WHEN 4 THEN 'other' ELSE 'none' END AS engine, coalesce(n / total, 0)::DOUBLE AS confidence
FROM (SELECT DISTINCT cell FROM o) c LEFT JOIN b ON c.cell = b.cell"""
)
def q24_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading that most engines agree on. [AGG13, NUM2]"""
    key = F.col("event_id")
    value = F.when(F.col("event_type") == "error", "—").otherwise(F.concat(F.lit(" "), (F.bround("value").cast("int") % 3 + 1).cast("string"), F.lit(",000. ")))
    outputs = _t(spark, sf_dir, "events").select(F.floor(key / 4).alias("cell"), _case(key, *map(F.lit, ("tesseract", "paddle", "glm", "other"))).alias("engine"), value.alias("value"))
    return choose.voted_numbers(outputs, ["cell"])


@registered(
    """WITH w AS (SELECT doc_id, ord, word FROM (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x <> '')) AS word, generate_subscripts(list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x <> ''), 1) AS ord FROM documents)),
d AS (SELECT word, CASE WHEN regexp_full_match(word, '[.\\-–—_:;|]{2,}') THEN -10 ELSE 0.5::DOUBLE + CASE WHEN regexp_full_match(word, '[-0-9.,;:]+') THEN 1.5::DOUBLE ELSE 0 END - CASE WHEN regexp_matches(word, '\\pL') THEN 1.5::DOUBLE ELSE 0 END + least(len(regexp_extract_all(word, '\\p{Nd}')), 8) * 0.04::DOUBLE
  + CASE WHEN regexp_full_match(word, '-?\\d{1,3}(,\\d{3})+[.;:]?') THEN 0.8::DOUBLE ELSE 0 END - CASE WHEN regexp_full_match(word, '-?\\d{1,3}(\\.\\d{3})+[.;:]?') THEN 0.4::DOUBLE ELSE 0 END - CASE WHEN regexp_full_match(word, '-?0[,.]\\d{3}[.;:]?') THEN 1.2::DOUBLE ELSE 0 END END AS points
  FROM (SELECT DISTINCT word FROM w))
SELECT doc_id, w.word AS text, w.ord::INT AS ord FROM w JOIN d ON w.word = d.word WHERE NOT regexp_full_match(w.word, '[.\\-–—_:;|]{2,}') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(points, 9) DESC, w.ord) = 1"""
)
def q25_score_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word of each document that reads best as a number. [SCR1, TOP5, PRD14, AGG19]"""
    listed = text.words(text.clean_spaces(F.col("text")))
    found = _spread(spark, sf_dir, "documents").select("doc_id", F.posexplode(listed).alias("ord", "text"))
    found = found.select("doc_id", (F.col("ord") + 1).alias("ord"), "text", F.lit("total_value").alias("field"), F.lit(0.5).alias("confidence"), F.lit("table_tokens").alias("engine"))
    return choose.best_candidate(found, ["doc_id"]).select("doc_id", "text", "ord")


@registered(
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part), a AS (SELECT name, replace(replace(name, 'e', 'c'), 'b', 'h') AS misread FROM n),
d(ord, known) AS (VALUES (0, 'red widget'), (1, 'blue bolt'), (2, 'small ring'), (3, 'large gear'), (4, 'green plate')),
s AS (SELECT misread, known, ord, 1 - levenshtein(misread, known)::DOUBLE / greatest(length(misread), length(known)) AS likeness FROM (SELECT DISTINCT misread FROM a), d)
SELECT misread, CASE WHEN likeness >= 0.6 THEN known ELSE misread END AS snapped, round(likeness, 6) AS likeness FROM s QUALIFY row_number() OVER (PARTITION BY misread ORDER BY likeness DESC, ord) = 1"""
)
def q26_snap_lev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names matched with a small dictionary by edit distance, in built-in functions alone."""
    misread = F.replace(F.replace("p_name", F.lit("e"), F.lit("c")), F.lit("b"), F.lit("h"))
    asked = _t(spark, sf_dir, "part").select(misread.alias("misread")).distinct()
    known = F.array(*[F.struct(F.lit(-i).alias("back"), F.lit(n).alias("known")) for i, n in enumerate(("red widget", "blue bolt", "small ring", "large gear", "green plate"))])
    rows = asked.select("misread", F.inline(known))
    likeness = 1 - F.levenshtein("misread", "known") / F.greatest(F.length("misread"), F.length("known"))
    best = rows.withColumn("likeness", likeness).groupBy("misread").agg(F.max(F.struct("likeness", "back", "known")).alias("best"))
    return best.select("misread", F.when(F.col("best.likeness") >= 0.6, F.col("best.known")).otherwise(F.col("misread")).alias("snapped"), F.round("best.likeness", 6).alias("likeness"))


@registered(
    f"""WITH f AS ({_FLAGGED}), w AS (SELECT *, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1) // 6 AS batch FROM f WHERE confidence_flag <> 'ok')
SELECT l_suppkey, batch::INT AS batch, count(*) AS n_rows, '[' || string_agg('{{"row_no":' || l_orderkey || ',"article":"' || l_partkey || '","foreign_duty_rate":null,"indian_duty_rate":"","total_value":' || l_linenumber || '}}', ',' ORDER BY l_orderkey, l_linenumber, l_partkey) || ']' AS payload FROM w GROUP BY 1, 2"""
)
def q27_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak rows in requests of six. [PRD7, WIN9, JSN2]"""
    rows = _flagged(spark, sf_dir).withColumns(
        {"row_no": F.col("l_orderkey"), "article": F.col("l_partkey").cast("string"), "foreign_duty_rate": F.lit(None).cast("string"), "indian_duty_rate": F.lit(""), "total_value": F.col("l_linenumber")}
    )
    return review.payloads(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"])


@registered(
    """WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'ok' WHEN c_custkey % 3 = 1 THEN 'review:a;llm_flagged_duty_rate' ELSE '' END AS flag, c_mktsegment AS article FROM customer),
f AS (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN 'Fixed ' || event_id END AS suggestion, CASE event_type WHEN 'error' THEN FALSE WHEN 'view' THEN TRUE END AS ok, event_type AS notes FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
j AS (SELECT r.*, f.*, CASE WHEN suggestion IS NULL THEN flag WHEN flag = '' THEN 'llm_corrected_article' ELSE flag || ';llm_corrected_article' END AS flag2 FROM r LEFT JOIN f ON c_custkey = user_id)
SELECT c_custkey AS row_no, coalesce(suggestion, article) AS article, notes AS llm_notes, CASE WHEN ok IS DISTINCT FROM FALSE THEN flag2 WHEN flag2 = '' THEN 'llm_flagged_duty_rate' WHEN list_contains(string_split(flag2, ';'), 'llm_flagged_duty_rate') THEN flag2 ELSE flag2 || ';llm_flagged_duty_rate' END AS confidence_flag FROM j"""
)
def q28_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last feedback on each row applied. [JN9, JSN3, JSN4, WIN8]"""
    key = F.col("c_custkey")
    rows = _t(spark, sf_dir, "customer").select(key.alias("row_no"), F.col("c_mktsegment").alias("article"), F.lit(None).cast("string").alias("llm_notes"), _case(key, *map(F.lit, ("ok", "review:a;llm_flagged_duty_rate", ""))).alias("confidence_flag"))
    kind = F.col("event_type")
    feedback = _t(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"),
        F.col("user_id").cast("string").alias("row_no"),
        F.when(kind == "click", F.concat(F.lit("Fixed "), F.col("event_id").cast("string"))).alias("article_suggestion"),
        F.when(kind == "error", False).when(kind == "view", True).alias("duty_rate_ok"),
        kind.alias("notes"),
    )
    one = F.lit(1).alias("spread")
    return review.apply_feedback(rows.select("*", one), feedback.select("*", one), ["spread"]).drop("spread")


@registered("SELECT event_id, (props::JSON ->> '$.k')::INT AS k FROM events")
def q29_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON text. [D18]"""
    return _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@registered(
    """WITH v AS (SELECT user_id, event_id, CASE WHEN value > 20 THEN 1 ELSE 0 END AS v FROM events),
e AS (SELECT *, min(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS low FROM v)
SELECT user_id, event_id, v, max(low) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS opened FROM e"""
)
def q30_open1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three and more in a series of bits. [WIN10]"""
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") > 20, 1).otherwise(0).alias("v"))
    return windows.opened(rows, ["user_id"], "event_id", "v", 1)


@registered(
    """WITH t AS (SELECT page_id, (page_id % 9)::INT AS i, CASE page_id % 10 WHEN 0 THEN 'Rates of Duty' WHEN 1 THEN 'Remarks.' WHEN 2 THEN 'As.' WHEN 3 THEN 'Pies' WHEN 4 THEN 'Gross Amount of Duty' WHEN 5 THEN 'Names of Articles' WHEN 6 THEN 'Extemal Ports' WHEN 7 THEN 'Home  Ports' ELSE regexp_extract(html, '<title>([^<]*)', 1) END AS raw FROM pages),
h AS (SELECT *, trim(replace(trim(regexp_replace(raw, '\\s+', ' ', 'g')), 'Extemal', 'External')) AS h, lower(trim(replace(trim(regexp_replace(raw, '\\s+', ' ', 'g')), 'Extemal', 'External'))) AS l FROM t)
SELECT page_id, CASE WHEN i = 0 THEN 'row_no' WHEN i = 1 OR contains(l, 'article') THEN 'article' WHEN i = 2 THEN 'unit' WHEN contains(l, 'remark') THEN 'remarks' WHEN contains(l, 'rates of duty') OR contains(l, 'chargeable') THEN 'duty_rate' WHEN contains(l, 'gross amount of duty') THEN 'duty_amount' WHEN l IN ('a.', 'a', 'as.', 'annas') THEN 'duty_as' WHEN l IN ('p.', 'p', 'pies') THEN 'duty_p' ELSE 'column_0' || i END AS field,
  CASE WHEN i = 0 THEN 'numeric' WHEN i = 1 OR contains(l, 'article') OR i = 2 OR contains(l, 'remark') THEN 'text' WHEN contains(l, 'rates of duty') OR contains(l, 'chargeable') THEN 'rate' ELSE 'numeric' END AS kind,
  CASE WHEN contains(l, 'indian') OR contains(l, 'home ports') THEN 'indian' WHEN contains(l, 'foreign') OR contains(l, 'external ports') THEN 'foreign' ELSE 'unknown' END AS page_kind FROM h"""
)
def q31_header_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings told apart. [TXT4, TXT17, TXT18]"""
    key = F.col("page_id")
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    raw = _case(key, *map(F.lit, ("Rates of Duty", "Remarks.", "As.", "Pies", "Gross Amount of Duty", "Names of Articles", "Extemal Ports", "Home  Ports")), title, title)
    heading = text.header(raw)
    pages = _t(spark, sf_dir, "pages")
    kind = text.header_field(heading, (key % 9).cast("int"), F.lit(1), F.lit(2), F.lit(0))
    return pages.select("page_id", F.inline(F.array(kind)), text.page_kind(heading, F.lit("")).alias("page_kind"))


@registered(
    """WITH c AS (SELECT l_orderkey, l_returnflag, avg(CASE WHEN l_discount > 0.01 THEN l_discount END) AS c FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, round(avg(c), 9) AS mean_confidence FROM c GROUP BY 1"""
)
def q32_conf_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's confidence: the mean of its fields' means, nulls left out."""
    fields = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.avg(F.when(F.col("l_discount") > 0.01, F.col("l_discount"))).alias("c"))
    return fields.groupBy("l_orderkey").agg(F.round(F.avg("c"), 9).alias("mean_confidence"))


@registered(
    """WITH b AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'foreign_duty_rs' ELSE 'total_value' END AS field, (p_partkey % 90 * 10)::INT AS l0, (p_partkey % 90 * 10 + p_size * 4)::INT AS r0, (p_size * 8)::INT AS t0, (p_size * 8 + 30)::INT AS b0 FROM part),
p AS (SELECT *, greatest(1, trunc((r0 - l0) * CASE field WHEN 'foreign_duty_rs' THEN 0.03::DOUBLE ELSE 0.02 END))::INT AS px, greatest(1, trunc((b0 - t0) * CASE field WHEN 'foreign_duty_rs' THEN 0.08::DOUBLE ELSE 0.06 END))::INT AS py FROM b),
k AS (SELECT p_partkey, field, least(greatest(0, l0 + px), 899) AS l, greatest(least(greatest(0, l0 + px), 899) + 1, least(900, r0 - px)) AS r, least(greatest(0, t0 + py), 419) AS t, greatest(least(greatest(0, t0 + py), 419) + 1, least(420, b0 - py)) AS b FROM p),
d AS (SELECT *, greatest(2, trunc((r - l) * CASE field WHEN 'article' THEN 0.06::DOUBLE ELSE 0.04 END))::INT AS dx, greatest(2, trunc((b - t) * CASE field WHEN 'article' THEN 0.18::DOUBLE ELSE 0.12 END))::INT AS dy FROM k),
m(ord, variant, ml, mr, mt, mb) AS (VALUES (0, 'base', 0, 0, 0, 0), (1, 'wider', -1, 1, 0, 0), (2, 'taller', 0, 0, -1, 1), (3, 'wide_tall', -1, 1, -1, 1), (4, 'shift_left', -1, -1, 0, 0), (5, 'shift_right', 1, 1, 0, 0)),
v AS (SELECT p_partkey, field, ord, variant, least(greatest(0, l + ml * dx), 899) AS "left", greatest(least(greatest(0, l + ml * dx), 899) + 1, least(900, r + mr * dx)) AS "right", least(greatest(0, t + mt * dy), 419) AS top, greatest(least(greatest(0, t + mt * dy), 419) + 1, least(420, b + mb * dy)) AS bottom FROM d, m WHERE field <> 'foreign_duty_rs' OR ord IN (0, 1, 5))
SELECT p_partkey, field, ord, variant, "left", "right", top, bottom FROM v QUALIFY row_number() OVER (PARTITION BY p_partkey, "left", "right", top, bottom ORDER BY ord) = 1"""
)
def q33_candidate_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes that a cell is read in. [GEO5-GEO9, WIN7]"""
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = _t(spark, sf_dir, "part").select("p_partkey", _case(key, *map(F.lit, ("article", "foreign_duty_rs", "total_value"))).alias("field"), (key % 90 * 10).cast("int").alias("l"), (size * 4).alias("w"), (size * 8).alias("t"))
    width, height = F.lit(900), F.lit(420)
    rows = rows.withColumn("base", geometry.padded(F.col("field"), F.col("l"), F.col("l") + F.col("w"), F.col("t"), F.col("t") + 30, width, height))
    return rows.select("p_partkey", "field", F.inline(geometry.variants(F.col("field"), F.col("base"), width, height))).select("p_partkey", "field", "ord", "variant", "box.*")


@registered(
    """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents),
t AS (SELECT doc_id, pos, token, regexp_extract_all(token, '[0-9]+') AS runs FROM w WHERE regexp_matches(token, '[0-9]')),
n AS (SELECT doc_id, pos, TRY_CAST(runs[1] AS INT) AS v, length(runs[1]) AS len FROM t WHERE len(runs) = 1),
r AS (SELECT doc_id, pos, CASE WHEN v BETWEEN 95 AND 141 THEN v WHEN len <= 2 AND v BETWEEN 95 AND 141 THEN v WHEN len <= 2 AND v + 100 BETWEEN 95 AND 141 THEN v + 100 END AS row_no FROM n)
SELECT doc_id, row_no, max(pos)::INT AS pos FROM r WHERE row_no IS NOT NULL GROUP BY 1, 2"""
)
def q34_row_number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers found in documents, the last place of each. [NUM3]"""
    tokens = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "token"))
    found = tokens.withColumn("row_no", numbers.row_number_in(F.col("token"), F.lit(95), F.lit(141))).where("row_no is not null")
    return found.groupBy("doc_id", "row_no").agg((F.max("pos") + 1).alias("pos"))


@registered(
    """WITH s AS (SELECT n_nationkey AS page, unnest(generate_series(n_nationkey * 10 + 1, n_nationkey * 10 + 47)) AS row_no FROM nation),
l AS (SELECT c_nationkey AS page, c_custkey % 300 AS row_no, max(c_mktsegment) AS article FROM customer GROUP BY 1, 2), r AS (SELECT s_nationkey AS page, s_suppkey % 300 AS row_no, max(s_name) AS remarks FROM supplier GROUP BY 1, 2)
SELECT s.page, s.row_no::INT AS row_no, coalesce(article, '') AS article, coalesce(remarks, '') AS remarks FROM s LEFT JOIN l ON s.page = l.page AND s.row_no = l.row_no LEFT JOIN r ON s.page = r.page AND s.row_no = r.row_no"""
)
def q35_spine_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both pages of a spread on their row numbers. [JN4]"""
    spreads = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("page"), (F.col("n_nationkey") * 10 + 1).alias("row_start"), F.lit(47).alias("expected_rows"))
    left = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("page"), (F.col("c_custkey") % 300).cast("int").alias("row_no")).agg(F.max("c_mktsegment").alias("text"))
    right = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("page"), (F.col("s_suppkey") % 300).cast("int").alias("row_no")).agg(F.max("s_name").alias("text"))
    both = left.withColumn("field", F.lit("article")).unionByName(right.withColumn("field", F.lit("remarks"))).withColumn("confidence", F.lit(1.0))
    return cells.assembled(cells.row_spine(spreads, ["page"]), both, ["page"]).select("page", "row_no", "article", "remarks")


@registered()
def q36_image_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernels over rasters drawn from rows: each part is a small page with a rule and its number as ink. Ink, cell features and rule profiles only. [IMG5, IMG13, IMG19, IMG20]"""
    from ..operators.rasters import drawn

    return images.image_features_and_peaks(drawn(_spread(spark, sf_dir, "part").select("p_partkey", "p_size")))


@registered(
    """SELECT event_id, 0::BIGINT AS ord, event_id::VARCHAR AS row_no, NULL::VARCHAR AS article_suggestion, value > 20 AS duty_rate_ok, event_type AS notes FROM events WHERE event_id % 5 < 3"""
)
def q37_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays found in models' answers. [JSN1, TXT14]"""
    item = F.to_json(F.array(F.struct(F.col("event_id").cast("string").alias("row_no"), F.col("event_type").alias("notes"), (F.col("value") > 20).alias("duty_rate_ok"))))
    answer = _case(F.col("event_id"), item, F.concat(F.lit("```json\n"), item, F.lit("\n```")), F.concat(F.lit("Here it is: "), item, F.lit(" [end]")), F.lit("no array"), F.substring(item, F.lit(1), F.length(item) - 1))
    answers = _t(spark, sf_dir, "events").select("event_id", answer.alias("answer"), F.lit(0).alias("batch"))
    return review.parsed_feedback(answers, ["event_id"])


@registered()
def q38_wratio_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles snapped to the dictionary. [TXT9, TOP9, UDF13]"""
    known = F.array(*map(F.lit, KNOWN_ARTICLES))
    name = F.get(known, (F.col("p_partkey") % len(KNOWN_ARTICLES)).cast("int"))
    key = F.col("p_partkey")
    raw = _case(key, name, F.replace(name, F.lit("e"), F.lit("c")), F.concat(name, F.lit(" 7")), F.col("p_name"))
    return similarity.snap_articles(_t(spark, sf_dir, "part").select("p_partkey", raw.alias("article")), KNOWN_ARTICLES)


@registered(
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 3 WHEN 0 THEN l_extendedprice::BIGINT::VARCHAR WHEN 1 THEN '' ELSE l_partkey || ',' || lpad((l_suppkey % 1000)::VARCHAR, 3, '0') END AS token, CASE l_suppkey % 2 WHEN 0 THEN 'x' || l_partkey ELSE l_partkey || ',500' END AS cell FROM lineitem),
n AS (SELECT *, unnest([token, cell]) AS t, unnest(['token', 'cell']) AS which FROM v),
s AS (SELECT *, CASE WHEN t = '' THEN -10 ELSE 0.5::DOUBLE + CASE WHEN regexp_full_match(t, '[-0-9.,;:]+') THEN 1.5::DOUBLE ELSE 0 END - CASE WHEN regexp_matches(t, '\\pL') THEN 1.5::DOUBLE ELSE 0 END + least(len(regexp_extract_all(t, '[0-9]')), 8) * 0.04::DOUBLE + CASE WHEN regexp_full_match(t, '-?\\d{1,3}(,\\d{3})+[.;:]?') THEN 0.8::DOUBLE ELSE 0 END - CASE WHEN regexp_full_match(t, '-?0[,.]\\d{3}[.;:]?') THEN 1.2::DOUBLE ELSE 0 END END AS p FROM n),
w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, token, cell, max(p) FILTER (which = 'token') AS pt, max(p) FILTER (which = 'cell') AS pc FROM s GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN (token = '' OR pt < 2.5) AND NOT (token <> '' AND pt >= pc) THEN cell ELSE token END AS text, CASE WHEN (token = '' OR pt < 2.5) AND NOT (token <> '' AND pt >= pc) THEN 'tesseract@base' ELSE 'table_tokens' END AS engine FROM w"""
)
def q39_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens or a cell's own reading, whichever is to be trusted. [SCR1, SCR2, SCR5, SCR6, PRD9, PRD10]"""
    part, supplier = F.col("l_partkey").cast("string"), F.col("l_suppkey")
    token = _case(F.col("l_linenumber"), F.bround("l_extendedprice").cast("long").cast("string"), F.lit(""), F.concat(part, F.lit(","), F.lpad((supplier % 1000).cast("string"), 3, "0")))
    cell = F.when(supplier % 2 == 0, F.concat(F.lit("x"), part)).otherwise(F.concat(part, F.lit(",500")))
    rows = _spread(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("total_value").alias("field"), token.alias("token_text"), F.lit(0.5).alias("token_confidence"), cell.alias("cell_text"), F.lit(0.5).alias("cell_confidence"), F.lit("tesseract@base").alias("cell_engine")
    )
    return choose.resolved(rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "text", "engine").distinct()


@registered(
    """WITH p AS (SELECT n_nationkey AS page, (n_nationkey % 5) * 20 AS head, n_nationkey % 4 > 0 AS ruled FROM nation),
e AS (SELECT page, CASE WHEN ruled THEN 100.0::DOUBLE + head END AS head, CASE WHEN ruled THEN 900.0::DOUBLE END AS foot FROM p),
s AS (SELECT page, CASE WHEN head IS NOT NULL THEN (foot - head) / (47 + 3.1::DOUBLE) ELSE 1000 * 0.70::DOUBLE / 46 END AS step, head FROM e)
SELECT page, (48 + i)::INT AS row_no, round(CASE WHEN head IS NOT NULL THEN head + step * 2.5::DOUBLE ELSE 1000 * 0.21::DOUBLE END + step * i, 6) AS centre FROM s, (SELECT unnest(range(47)) AS i)"""
)
def q40_ruled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows between rules where no numbers could be read. [NUM8, NUM6]"""
    key = F.col("n_nationkey")
    nation = _t(spark, sf_dir, "nation").select(key.alias("page"))
    pages = nation.withColumns({"height": F.lit(1000), "row_start": F.lit(48)})
    peaks = nation.where("page % 4 > 0").select("page", F.explode(F.array(F.lit(50.0), F.lit(100.0) + F.col("page") % 5 * 20, F.lit(900.0), F.lit(980.0))).alias("position"))
    return grid.ruled_centres(peaks, pages, ["page"]).select("page", "row_no", F.round("centre", 6).alias("centre"))


@registered(
    """WITH t AS (SELECT p_partkey AS page, CASE WHEN p_partkey % 4 > 0 THEN p_size ELSE 7 END AS x, CASE WHEN p_partkey % 4 > 0 THEN 20 ELSE 9 END AS y,
  CASE WHEN p_partkey % 4 > 0 THEN 500 + p_size ELSE 600 END AS width, CASE WHEN p_partkey % 4 > 0 THEN 800 ELSE 700 END AS height FROM part),
h AS (SELECT page, 'row' AS kind, n::VARCHAR AS label, 0 AS x0, y + 15 * n + e AS y0, 1000 AS x1, y + 15 * n + e AS y1 FROM t, (SELECT unnest(range(1, 4)) AS n), (SELECT unnest([0, 14]) AS e)),
v AS (SELECT page, 'column' AS kind, label, x + floor(width * r)::INT AS x0, 0 AS y0, x + floor(width * r)::INT AS x1, 1200 AS y1
  FROM t, (VALUES ('article', 0.125::DOUBLE), ('article', 0.5::DOUBLE), ('unit', 0.5::DOUBLE), ('unit', 0.75::DOUBLE)) c(label, r)),
b AS (SELECT page, 'table' AS kind, 'table' AS label, x AS x0, y + height * e AS y0, x + width AS x1, y + height * e AS y1 FROM t, (SELECT unnest([0, 1]) AS e)
  UNION ALL SELECT page, 'table', 'table', x + width * e, y, x + width * e, y + height FROM t, (SELECT unnest([0, 1]) AS e))
SELECT page, kind, label, x0::INT AS x0, y0::INT AS y0, x1::INT AS x1, y1::INT AS y1 FROM (SELECT * FROM h UNION ALL SELECT * FROM v UNION ALL SELECT * FROM b)"""
)
def q41_grid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every page's table, rows and columns, moved from the table to the page. [SNK9, SNK10, GEO2, GEO3]"""
    box = lambda x, y, w, h: F.struct(F.lit(x).cast("int").alias("x"), F.lit(y).alias("y"), F.lit(w).cast("int").alias("width"), F.lit(h).alias("height"))
    ruled = box(7, 9, 600, 700)
    template = F.when(F.col("p_partkey") % 4 > 0, box(F.col("p_size"), 20, F.col("p_size") + 500, 800)).otherwise(box(0, 0, 0, 0))
    tables = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), geometry.chosen_table(template, ruled).alias("t")).select("page", "t.*")
    pages = tables.select("page", F.lit(1000).alias("width"), F.lit(1200).alias("height"))
    rows = tables.select("page", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("row_no")).selectExpr("page", "row_no", "15 * row_no AS top", "15 * row_no + 14 AS bottom")
    bounds = [F.struct(F.lit(f).alias("field"), *[geometry.share(F.col("width"), r).alias(n) for n, r in (("left", a), ("right", b))]) for f, a, b in (("article", 0.125, 0.5), ("unit", 0.5, 0.75))]
    columns = tables.select("page", F.inline(F.array(*bounds)))
    lines = artefacts.grid_lines(artefacts.on_page(rows, tables, ["page"]), artefacts.on_page(columns, tables, ["page"]), pages, ["page"])
    return lines.unionAll(artefacts.table_lines(tables, ["page"]))


@registered()
def q42_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages drawn from rows as PNG files with a line for each part's size over them, by their digests. [SNK8, SNK9, IMG16]"""
    from ..operators.rasters import drawn

    parts = _t(spark, sf_dir, "part").select("p_partkey", "p_size")
    at = F.col("p_size") % 48
    lines = parts.select(F.concat(F.lit("part-"), "p_partkey").alias("origin"), F.lit("row").alias("kind"), F.lit("").alias("label"), F.lit(0).alias("x0"), at.alias("y0"), F.lit(64).alias("x1"), at.alias("y1"))
    return artefacts.overlays(drawn(parts), lines).select("origin", F.sha2("png", 256).alias("png_sha256"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy rows cleaned, filled, flagged and counted: the way of a table from reading to review."""
    w = Window.partitionBy("spread").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    lines = _t(spark, sf_dir, "lineitem").withColumn("spread", F.col("l_suppkey")).withColumn("row_no", F.row_number().over(w))
    parts = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    quantity = F.format_number("l_extendedprice", 0)
    blank = {f: F.lit("") for f in ("unit", "foreign_duty_rs", "indian_quantity", "indian_value_rs", "indian_duty_rate", "indian_duty_rs", "indian_duty_as", "indian_duty_p", "remarks")}
    raw = lines.join(parts, "l_partkey", "left").withColumns(
        blank
        | {
            "source_file": F.lit("lineitem"),
            "page_number": F.col("spread").cast("string"),
            "article": F.concat(F.lit("1 "), F.coalesce("p_name", F.lit("")), F.lit(" ...")),
            "foreign_quantity": F.col("l_quantity").cast("string"),
            "foreign_value_rs": F.when(F.col("l_linenumber") == 7, "—x").otherwise(quantity),
            "foreign_duty_rate": F.when(F.col("l_linenumber") % 2 == 0, "Do,").otherwise("at 3 per Vent."),
            "foreign_duty_as": (F.col("l_quantity") % 20).cast("int").cast("string"),
            "foreign_duty_p": F.col("l_linenumber").cast("string"),
            "total_value": quantity,
            "raw_ocr_text": F.lit(""),
            "mean_confidence": F.col("l_discount") * 10,
        }
    )
    return records.summary(records.finalize(raw, ["spread"]))
