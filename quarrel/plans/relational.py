"""Queries over the relational surface, one or more per operator, each with the SQL that checks it.

A query is one text for both sides where both read it alike, else a pair. Sums of doubles go through decimals so that
the order of addition doesn't show; orders spell out where nulls go; divisions and casts are explicit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrel.functions import aliases
from quarrel.plans import sqltext
from quarrel.session import scoped, shared_folder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temporary views for the tables that a statement names, and no others."""
    words = {t.lower() for k, t in sqltext.tokens(sql) if k == "word"}
    for name in TABLES:
        if name in words:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement in the engine's SQL (other engines' function names included) over the tables of ``sf_dir``."""
    own = scoped(spark)
    text = aliases.rewrite(sql)
    views(own, sf_dir, text)
    return own.sql(text)


def _money(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18, 4))) AS DOUBLE)"


REVENUE = "l_extendedprice * (1 - l_discount)"

#: name -> SQL for both sides, or (engine's SQL, oracle's SQL)
SQL: dict[str, str | tuple[str, str]] = {
    # --- joins
    "j1_inner_join": f"SELECT n_name, COUNT(*) AS orders_n, {_money('o_totalprice')} AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "j2_left_join": "SELECT c_custkey, COUNT(o_orderkey) AS orders_n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    "j2_right_join": "SELECT c_custkey, MAX(o_orderkey) AS last_order FROM orders RIGHT JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey",
    "j2_full_join": "SELECT a.s_suppkey AS a, b.p_partkey AS b FROM supplier a FULL JOIN (SELECT * FROM part WHERE p_size > 25) b ON a.s_suppkey = b.p_partkey",
    "j3_cross_join": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "j4_theta_join": "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON a.n_nationkey > b.r_regionkey * 5 AND a.n_regionkey <> b.r_regionkey",
    "j5_semi_join": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 100000)"),
    "j5_anti_join": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)"),
    "j6_right_semi_join": ("SELECT s_suppkey FROM lineitem RIGHT SEMI JOIN supplier ON l_suppkey = s_suppkey AND l_returnflag = 'R'", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R')"),
    "j6_right_anti_join": ("SELECT p_partkey FROM lineitem RIGHT ANTI JOIN part ON l_partkey = p_partkey AND l_quantity > 45", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)"),
    "j7_using": "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y USING (k)",
    "j7_natural": "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y",
    "j8_lateral": "SELECT c_custkey, t.best FROM customer, LATERAL (SELECT MAX(o_totalprice) AS best FROM orders WHERE o_custkey = c_custkey) t",
    # --- aggregation
    "a1_group": f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, {_money('l_quantity')} AS qty, {_money(REVENUE)} AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "a2_basic": f"SELECT COUNT(*) AS n, COUNT(value) AS n_value, {_money('value')} AS total, {_money('value')} / COUNT(value) AS mean, MIN(value) AS lo, MAX(value) AS hi FROM events",
    "a3_distinct": "SELECT event_type, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY event_type",
    "a4_filter": "SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_totalprice > 150000) AS large, COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY o_orderstatus",
    "a5_grouping_sets": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(GROUPING(l_returnflag) AS INT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())",
    "a5_rollup": "SELECT n_regionkey, n_name, COUNT(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_name)",
    "a5_cube": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "a6_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1 HAVING COUNT(*) >= 15",
    "a7_statistics": "SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd, ROUND(VAR_POP(l_quantity), 6) AS vp, ROUND(CORR(l_quantity, l_extendedprice), 6) AS r, ROUND(COVAR_POP(l_quantity, l_discount), 6) AS cp, ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY l_returnflag",
    "a8_median": ("SELECT p_brand, MEDIAN(p_retailprice) AS med, PERCENTILE_CONT(0.25) WITHIN GROUP (ORDER BY p_retailprice) AS q1 FROM part GROUP BY p_brand", "SELECT p_brand, MEDIAN(p_retailprice) AS med, QUANTILE_CONT(p_retailprice, 0.25) AS q1 FROM part GROUP BY p_brand"),
    "a9_collect": ("SELECT n_regionkey, ARRAY_JOIN(TRANSFORM(ARRAY_SORT(COLLECT_LIST(STRUCT(n_nationkey, n_name))), x -> x.n_name), ',') AS names, MIN_BY(n_name, n_nationkey) AS first_name, MAX_BY(n_name, n_nationkey) AS last_name FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, STRING_AGG(n_name, ',' ORDER BY n_nationkey) AS names, ARG_MIN(n_name, n_nationkey) AS first_name, ARG_MAX(n_name, n_nationkey) AS last_name FROM nation GROUP BY n_regionkey"),
    "a9_string_agg": ("SELECT n_regionkey, LISTAGG(n_name, ';') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, STRING_AGG(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "a10_bits": "SELECT l_returnflag, BOOL_AND(l_quantity > 0) AS every_one, BOOL_OR(l_tax > 0.07) AS any_one, BIT_AND(l_linenumber) AS ba, BIT_OR(l_linenumber) AS bo, BIT_XOR(l_linenumber) AS bx FROM lineitem GROUP BY l_returnflag",
    "a11_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "a11_distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    # --- windows
    "w1_ranking": "SELECT o_orderkey, ROW_NUMBER() OVER w AS rn, RANK() OVER w AS rk, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr, NTILE(3) OVER w AS nt, ROUND(PERCENT_RANK() OVER w, 9) AS pr, ROUND(CUME_DIST() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "w2_values": "SELECT o_orderkey, LAG(o_totalprice) OVER w AS before, LEAD(o_totalprice, 2, 0.0) OVER w AS later, FIRST_VALUE(o_orderkey) OVER w AS f, LAST_VALUE(o_orderkey) OVER w AS l, NTH_VALUE(o_orderkey, 2) OVER w AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "w3_frames": "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS last4, MAX(value) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near, CAST(SUM(CAST(value AS DECIMAL(18, 4))) OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS running FROM events",
    "w5_qualify": "SELECT o_custkey, o_orderkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    # --- order, limit, sets
    "o2_limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100",
    "o3_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10",
    "u1_union": "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT n_name FROM nation",
    "u1_union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "u2_intersect": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
    "u2_intersect_all": "SELECT l_linenumber AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT ALL SELECT l_linenumber FROM lineitem WHERE l_returnflag = 'R'",
    "u2_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "u2_except_all": "SELECT l_linenumber AS k FROM lineitem WHERE l_returnflag = 'N' EXCEPT ALL SELECT l_linenumber FROM lineitem WHERE l_returnflag = 'R'",
    # --- queries
    "q1_cte": "WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE n > 12) SELECT c_name, n FROM top JOIN customer ON o_custkey = c_custkey",
    "q1_recursive": "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t",
    "q2_scalar_subquery": "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)",
    "q2_in_subquery": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)",
    "q2_exists": "SELECT n_name FROM nation n WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal < 0)",
    "q3_values": "SELECT a, b, n_name FROM (VALUES (1, 'x'), (2, 'y'), (30, 'z')) AS t(a, b) LEFT JOIN nation ON a = n_nationkey",
    "q4_unnest": ("SELECT r_regionkey, x FROM (SELECT r_regionkey, ARRAY(1, 2, r_regionkey) AS a FROM region) t, UNNEST(a) AS u(x)", "SELECT r_regionkey, UNNEST([1, 2, r_regionkey]) AS x FROM region"),
    "q5_case": "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS band, NULLIF(o_orderstatus, 'O') AS st, COALESCE(NULLIF(o_orderstatus, 'O'), 'open') AS st2, CAST(o_totalprice AS DECIMAL(18, 2))::STRING AS txt, TRY_CAST(o_orderpriority AS INT) AS bad FROM orders",
    # --- predicates, as the engine evaluates them
    "p1_equal": "SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F'",
    "p2_not_equal": "SELECT COUNT(*) AS n FROM events WHERE event_type <> 'click'",
    "p3_compare": "SELECT COUNT(*) FILTER (WHERE l_quantity < 10) AS a, COUNT(*) FILTER (WHERE l_quantity <= 10) AS b, COUNT(*) FILTER (WHERE l_quantity > 10) AS c, COUNT(*) FILTER (WHERE l_quantity >= 10) AS d FROM lineitem",
    "p4_flipped": "SELECT COUNT(*) AS n FROM lineitem WHERE 25 < l_quantity AND 0.05 >= l_discount",
    "p5_and": "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > 1000 AND o_orderkey % 7 = 3",
    "p6_or": "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > 300000 OR o_orderstatus = 'P'",
    "p7_not": "SELECT COUNT(*) AS n FROM orders WHERE NOT (o_totalprice > 100000 AND o_orderstatus = 'F')",
    "p8_is_null": "SELECT COUNT(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL",
    "p9_is_not_null": "SELECT COUNT(*) AS n FROM events WHERE value IS NOT NULL",
    "p10_is_true": "SELECT COUNT(*) AS n FROM orders WHERE (o_totalprice > 100000) IS TRUE",
    "p11_is_not_true": "SELECT COUNT(*) AS n FROM (SELECT NULLIF(o_orderstatus, 'P') = 'F' AS f FROM orders) t WHERE f IS NOT TRUE",
    "p11_is_not_false": "SELECT COUNT(*) AS n FROM (SELECT NULLIF(o_orderstatus, 'P') = 'F' AS f FROM orders) t WHERE f IS NOT FALSE",
    "p12_boolean": "SELECT COUNT(*) AS n FROM (SELECT quality = 1 AS good FROM labels) t WHERE good",
    "p13_between": "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 20",
    "p14_not_between": "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity NOT BETWEEN 10 AND 20",
    "p15_in": "SELECT COUNT(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "p16_not_in": "SELECT COUNT(*) AS n FROM (SELECT NULLIF(o_orderstatus, 'P') AS s FROM orders) t WHERE s NOT IN ('F')",
    "p17_like": "SELECT COUNT(*) FILTER (WHERE p_type LIKE 'S%') AS a, COUNT(*) FILTER (WHERE p_type LIKE '%EL') AS b, COUNT(*) FILTER (WHERE p_name LIKE '%a_b%') AS c FROM part",
    "p18_ilike": "SELECT COUNT(*) AS n FROM part WHERE p_type ILIKE '%steel%'",
    "p19_not_like": "SELECT COUNT(*) AS n FROM part WHERE p_type NOT LIKE 'S%'",
    "p20_escape": "SELECT COUNT(*) AS n FROM (SELECT '100%' AS x UNION ALL SELECT '1000' UNION ALL SELECT 'a_b' UNION ALL SELECT 'axb') t WHERE x LIKE '100!%' ESCAPE '!' OR x LIKE 'a!_b' ESCAPE '!'",
    "p21_similar_to": ("SELECT COUNT(*) AS n FROM orders WHERE o_orderpriority SIMILAR TO '(1|2)-%'", "SELECT COUNT(*) AS n FROM orders WHERE regexp_full_match(o_orderpriority, '(1|2)-.*')"),
    "p22_columns": "SELECT COUNT(*) AS n FROM lineitem WHERE l_tax > l_discount AND LENGTH(l_returnflag) = 1",
    "p28_distinct_from": "SELECT COUNT(*) AS n FROM (SELECT NULLIF(o_orderstatus, 'P') AS s FROM orders) t WHERE s IS DISTINCT FROM 'F'",
    "p28_any": ("SELECT COUNT(*) AS n FROM nation WHERE n_regionkey = ANY(ARRAY(1, 3))", "SELECT COUNT(*) AS n FROM nation WHERE n_regionkey = ANY([1, 3])"),
    "p28_regex": ("SELECT COUNT(*) AS n FROM orders WHERE o_orderpriority ~ '^[12]-'", "SELECT COUNT(*) AS n FROM orders WHERE regexp_matches(o_orderpriority, '^[12]-')"),
    # --- functions
    "f1_conditional": "SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'F'), 'x') AS a, GREATEST(o_orderkey, o_custkey) AS b, LEAST(o_orderkey, o_custkey) AS c, IFNULL(NULLIF(o_custkey, 1), -1) AS d FROM orders",
    "f2_math": ("SELECT l_linenumber, l_quantity, ABS(-l_quantity) AS a, CAST(CEIL(l_tax * 10) AS BIGINT) AS b, CAST(FLOOR(l_tax * 10) AS BIGINT) AS c, ROUND(SQRT(l_quantity), 6) AS d, ROUND(LN(l_quantity), 6) AS e, ROUND(POWER(l_quantity, 2), 3) AS f, SIGN(l_quantity - 25) AS g, TRUNC(l_quantity / 7, 1) AS h, GCD(l_linenumber, 6) AS i, LCM(l_linenumber, 4) AS j, ISZERO(l_tax) AS k FROM lineitem", "SELECT l_linenumber, l_quantity, ABS(-l_quantity) AS a, CAST(CEIL(l_tax * 10) AS BIGINT) AS b, CAST(FLOOR(l_tax * 10) AS BIGINT) AS c, ROUND(SQRT(l_quantity), 6) AS d, ROUND(LN(l_quantity), 6) AS e, ROUND(POWER(l_quantity, 2), 3) AS f, SIGN(l_quantity - 25)::DOUBLE AS g, (SIGN(l_quantity) * FLOOR(ABS(l_quantity / 7) * POWER(10, 1)) / POWER(10, 1)) AS h, GCD(l_linenumber, 6)::BIGINT AS i, LCM(l_linenumber, 4)::BIGINT AS j, l_tax = 0 AS k FROM lineitem"),
    "f3_strings": ("SELECT p_partkey, UPPER(p_name) AS a, LOWER(p_type) AS b, SUBSTR(p_brand, 2, 3) AS c, REPLACE(p_name, 'a', '_') AS d, LPAD(p_brand, 12, '*') AS e, REVERSE(p_brand) AS f, CAST(LENGTH(p_name) AS BIGINT) AS g, CAST(STRPOS(p_type, 'E') AS BIGINT) AS h, STARTS_WITH(p_type, 'S') AS i, ENDS_WITH(p_type, 'L') AS j, SPLIT_PART(p_type, ' ', 1) AS k, MD5(p_name) AS l, SHA256(p_name) AS m, p_brand || '-' || p_type AS n, CONCAT(p_brand, NULLIF(p_type, p_type), 'z') AS o, TO_HEX(p_size) AS q, CAST(LEVENSHTEIN(p_brand, 'Brand#1') AS BIGINT) AS r, INITCAP(LOWER(p_brand)) AS s FROM part", "SELECT p_partkey, UPPER(p_name) AS a, LOWER(p_type) AS b, SUBSTR(p_brand, 2, 3) AS c, REPLACE(p_name, 'a', '_') AS d, LPAD(p_brand, 12, '*') AS e, REVERSE(p_brand) AS f, CAST(LENGTH(p_name) AS BIGINT) AS g, CAST(STRPOS(p_type, 'E') AS BIGINT) AS h, STARTS_WITH(p_type, 'S') AS i, ENDS_WITH(p_type, 'L') AS j, SPLIT_PART(p_type, ' ', 1) AS k, MD5(p_name) AS l, SHA256(p_name) AS m, p_brand || '-' || p_type AS n, CONCAT(p_brand, NULLIF(p_type, p_type), 'z') AS o, LOWER(TO_HEX(p_size)) AS q, CAST(LEVENSHTEIN(p_brand, 'Brand#1') AS BIGINT) AS r, UPPER(p_brand[1]) || LOWER(p_brand[2:]) AS s FROM part"),
    "f4_regex": ("SELECT p_partkey, REGEXP_REPLACE(p_type, '[AEIOU]', '.') AS a, REGEXP_LIKE(p_type, 'EE') AS b, CAST(REGEXP_COUNT(p_type, 'E') AS BIGINT) AS c, ARRAY_JOIN(REGEXP_MATCH(p_brand, '[0-9]+'), ',') AS d FROM part", "SELECT p_partkey, REGEXP_REPLACE(p_type, '[AEIOU]', '.', 'g') AS a, REGEXP_MATCHES(p_type, 'EE') AS b, CAST(LENGTH(p_type) - LENGTH(REPLACE(p_type, 'E', '')) AS BIGINT) AS c, ARRAY_TO_STRING(REGEXP_EXTRACT_ALL(p_brand, '[0-9]+'), ',') AS d FROM part"),
    "f5_times": ("SELECT o_orderkey, CAST(CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS STRING) AS m, CAST(DATE_PART('year', o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(QUARTER FROM o_orderdate) AS BIGINT) AS q, CAST(DATE_PART('dow', o_orderdate) AS BIGINT) AS dow, CAST(DATE_BIN(INTERVAL '7 days', o_orderdate) AS DATE)::STRING AS bin, CAST(TO_UNIXTIME(o_orderdate) AS BIGINT) AS u, TO_CHAR(o_orderdate, '%Y/%m/%d') AS txt FROM orders", "SELECT o_orderkey, CAST(CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS STRING) AS m, CAST(DATE_PART('year', o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(QUARTER FROM o_orderdate) AS BIGINT) AS q, CAST(DATE_PART('dow', o_orderdate) AS BIGINT) AS dow, CAST(TIME_BUCKET(INTERVAL '7 days', o_orderdate, TIMESTAMP '1970-01-01') AS DATE)::STRING AS bin, CAST(FLOOR(EPOCH(o_orderdate)) AS BIGINT) AS u, STRFTIME(o_orderdate, '%Y/%m/%d') AS txt FROM orders"),
    "f6_arrays": ("SELECT n_nationkey, ARRAY_LENGTH(MAKE_ARRAY(1, 2, n_regionkey)) AS a, ARRAY_HAS(MAKE_ARRAY(1, 2), n_regionkey) AS b, ARRAY_TO_STRING(ARRAY_SORT(ARRAY_DISTINCT(ARRAY_CONCAT(MAKE_ARRAY(1, 2), MAKE_ARRAY(n_regionkey)))), '-') AS c, ARRAY_HAS_ALL(MAKE_ARRAY(0, 1, 2), MAKE_ARRAY(n_regionkey)) AS d, ARRAY_HAS_ANY(MAKE_ARRAY(3, 4), MAKE_ARRAY(n_regionkey)) AS e, ARRAY_TO_STRING(ARRAY_SLICE(GENERATE_SERIES(1, 9), 2, 4), ',') AS f, ARRAY_ELEMENT(MAKE_ARRAY(7, 8), n_regionkey + 1) AS g, EMPTY(ARRAY_REMOVE(MAKE_ARRAY(1), n_regionkey)) AS h FROM nation", "SELECT n_nationkey, 3 AS a, n_regionkey IN (1, 2) AS b, ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT([1, 2, n_regionkey])), '-') AS c, n_regionkey IN (0, 1, 2) AS d, n_regionkey IN (3, 4) AS e, '2,3,4' AS f, [7, 8][n_regionkey + 1] AS g, n_regionkey = 1 AS h FROM nation"),
    "f7_structs": ("SELECT n_nationkey, GET_FIELD(NAMED_STRUCT('k', n_name, 'r', n_regionkey), 'k') AS a, ELEMENT_AT(MAKE_MAP(ARRAY('x', 'y'), ARRAY(n_regionkey, 5)), 'x') AS b, CAST(SIZE(MAP_KEYS(MAP('a', 1, 'b', 2))) AS BIGINT) AS c FROM nation", "SELECT n_nationkey, {'k': n_name, 'r': n_regionkey}.k AS a, n_regionkey AS b, CAST(2 AS BIGINT) AS c FROM nation"),
    "f8_json": ("SELECT event_id, CAST(GET_JSON_OBJECT(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "f9_typeof": ("SELECT ARROW_TYPEOF(n_name) AS a FROM nation WHERE n_nationkey = 0", "SELECT 'string' AS a"),
    "f10_series": ("SELECT CAST(x AS BIGINT) AS x FROM EXPLODE(GENERATE_SERIES(1, 50, 7)) AS t(x)", "SELECT CAST(x AS BIGINT) AS x FROM GENERATE_SERIES(1, 50, 7) AS t(x)"),
    # --- the dashboard workload
    "d_total": "SELECT COUNT(*) AS total_messages FROM events",
    "d_filtered_total": "SELECT COUNT(*) AS total_users FROM labels WHERE toxic = 0",
    "d_volume": f"SELECT {_money('o_totalprice')} / 1073741824.0 AS total_gb FROM orders",
    "d_by_month": "SELECT CAST(CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS STRING) AS month, COUNT(*) AS messages FROM orders GROUP BY 1 ORDER BY 1 NULLS FIRST",
    "d_by_hour": "SELECT CAST(DATE_PART('hour', ts) AS INT) AS hour, COUNT(*) AS messages FROM events GROUP BY 1 ORDER BY 1 NULLS FIRST",
    "d_by_type": "SELECT COALESCE(event_type, 'unknown') AS type, COUNT(*) AS messages FROM events GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1",
    "d_mean_by_month": f"SELECT CAST(CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS STRING) AS month, {_money('o_totalprice')} / COUNT(o_totalprice) / 1024.0 AS avg_kb FROM orders GROUP BY 1",
    "d_top_senders": "SELECT c_name AS sender_name, COUNT(*) AS msg_count FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 10",
    "d_top_senders_of_type": "SELECT c_name AS sender_name, COUNT(*) AS msg_count FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 10",
    "d_top_recipients": "SELECT s_name AS recipient_name, COUNT(*) AS msg_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 10",
}


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, sql)


def numbered_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole table in order, and each row's number in it: sorted by ranges, numbered within each, and moved on by the ranges before. No task sees it all."""
    events = scoped(spark).read.parquet(f"{sf_dir}/events.parquet").select("user_id", "value", "event_id")
    path = f"{shared_folder(spark)}/sorted"
    ordered = events.orderBy(F.desc_nulls_last("value"), F.asc_nulls_first("event_id"))
    ordered.select("user_id", "value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")).write.parquet(path)
    rows = spark.read.parquet(path)
    # One row for each range: a window over these is small whatever the table's size.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    return rows.join(F.broadcast(moved), "part").select((F.col("before") + F.col("at") + 1).alias("rn"), "user_id", "value")


def groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GROUPS frame (one group of peers before to the current one): dense_rank is the group's number, a range over it the frame."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    numbered = orders.withColumn("g", F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderstatus")))
    frame = Window.partitionBy("o_custkey").orderBy("g").rangeBetween(-1, 0)
    return numbered.select("o_orderkey", F.count("*").over(frame).alias("n"), F.max("o_orderkey").over(frame).alias("hi"))


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement with bound parameters."""
    own = scoped(spark)
    sql = "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_totalprice > :least AND o_orderpriority = :priority GROUP BY o_orderstatus"
    views(own, sf_dir, sql)
    return own.sql(sql, args={"least": 50000.0, "priority": "5-LOW"})


def external_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as relations, by path."""
    return scoped(spark).sql(f"SELECT r_name, COUNT(*) AS n FROM parquet.`{sf_dir}/nation.parquet` JOIN parquet.`{sf_dir}/region.parquet` ON n_regionkey = r_regionkey GROUP BY r_name")


def approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, "SELECT event_type, APPROX_DISTINCT(user_id) AS users, APPROX_MEDIAN(value) AS median, APPROX_PERCENTILE_CONT(value, 0.9) AS p90 FROM events GROUP BY event_type")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _query(v if isinstance(v, str) else v[0]) for k, v in SQL.items()} | {
    "o1_sort": numbered_sort,
    "w4_groups_frame": groups_frame,
    "q7_parameters": parameters,
    "s22_external_files": external_files,
    "a8_approximate": approximate,
}

ORACLES: dict[str, str] = {k: v if isinstance(v, str) else v[1] for k, v in SQL.items()} | {
    "o1_sort": "SELECT ROW_NUMBER() OVER (ORDER BY value DESC NULLS LAST, event_id ASC NULLS FIRST) AS rn, user_id, value FROM events",
    "w4_groups_frame": "SELECT o_orderkey, COUNT(*) OVER w AS n, MAX(o_orderkey) OVER w AS hi FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW)",
    "q7_parameters": "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_totalprice > 50000 AND o_orderpriority = '5-LOW' GROUP BY o_orderstatus",
    "s22_external_files": "SELECT r_name, COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
}
