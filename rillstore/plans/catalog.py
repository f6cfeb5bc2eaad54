"""The relational queries over the driver's tables, as SQL text.

``SAME`` holds text that both engines read alike; ``PAIRS`` holds a Spark text and the text for the oracle
where the dialects differ. Sums of doubles go through decimals, so that the order of summation cannot
change a result; orders name the place of nulls.
"""

from __future__ import annotations

SAME: dict[str, str] = {}
PAIRS: dict[str, tuple[str, str]] = {}

# --- scan, project, filter ---------------------------------------------------------------------
SAME |= {
    "scan_region": "SELECT * FROM region",
    "project_expr": "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, l_extendedprice - l_tax AS less, -l_linenumber AS negated, 'x' AS literal FROM lineitem",
    "project_arith_bits": "SELECT l_orderkey, l_orderkey % 7 AS m, l_orderkey & 12 AS band, l_orderkey | 3 AS bor, l_linenumber * l_linenumber AS sq FROM lineitem",
    "project_concat": "SELECT c_custkey, c_name || '/' || c_mktsegment AS tag FROM customer",
    "filter_eq": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'",
    "filter_ne": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'",
    "filter_range": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000.0 AND o_totalprice <= 200000.0",
    "filter_between": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20",
    "filter_in": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%'",
    "filter_like_prefix": "SELECT c_custkey FROM customer WHERE c_name ILIKE 'customer#00000001%'",
    "filter_null": "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderkey % 7 = 0 WHERE o.o_orderkey IS NULL",
    "filter_not_null": "SELECT count(*) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_orderkey IS NOT NULL",
    "filter_not_or": "SELECT p_partkey FROM part WHERE NOT (p_size < 10 OR p_size > 40)",
    "filter_case_names": "SELECT C_CUSTKEY AS c_custkey, c_NAME AS c_name FROM CUSTOMER WHERE C_Nationkey = 3",
    "case_when": "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END AS band FROM orders",
    "coalesce_nullif": "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg FROM customer",
    "is_distinct": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey IS NOT DISTINCT FROM b.n_regionkey WHERE a.n_nationkey IS DISTINCT FROM b.n_nationkey",
}
PAIRS |= {
    "filter_like_escape": (
        "SELECT p_partkey FROM part WHERE concat(p_name, '_x%') LIKE '%!_x!%' ESCAPE '!'",
        "SELECT p_partkey FROM part WHERE concat(p_name, '_x%') LIKE '%!_x!%' ESCAPE '!'",
    ),
    "filter_glob": ("SELECT p_partkey, p_brand FROM part WHERE p_brand RLIKE '^Brand#[1-2].*$'", "SELECT p_partkey, p_brand FROM part WHERE p_brand GLOB 'Brand#[1-2]*'"),
    "cast_safe": (
        "SELECT p_partkey, try_cast(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS brand_no, try_cast(p_name AS INT) AS bad FROM part",
        "SELECT p_partkey, try_cast(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS brand_no, try_cast(p_name AS INT) AS bad FROM part",
    ),
    "div_int_safe": (
        "SELECT l_orderkey, l_linenumber, l_orderkey div 7 AS q, try_divide(l_orderkey, l_linenumber - 1) AS d, try_mod(l_orderkey, l_linenumber - 1) AS m FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS q, CASE WHEN l_linenumber <> 1 THEN l_orderkey / (l_linenumber - 1) END AS d, CASE WHEN l_linenumber <> 1 THEN l_orderkey % (l_linenumber - 1) END AS m FROM lineitem",
    ),
}

# --- joins -------------------------------------------------------------------------------------
SAME |= {
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_comma": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'",
    "join_right": "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000",
    "join_full": "SELECT a.s_suppkey AS x, b.c_custkey AS y FROM supplier a FULL OUTER JOIN customer b ON a.s_suppkey = b.c_custkey + 40",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_using": "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)",
    "join_natural": "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b",
    "join_theta_range": "SELECT p_partkey, lo FROM part JOIN (SELECT 1 AS lo, 10 AS hi UNION ALL SELECT 11, 30 UNION ALL SELECT 25, 50) b ON p_size BETWEEN lo AND hi",
    "join_semi_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)",
    "join_semi_in": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "join_anti_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderkey % 5 = 0)",
    "join_anti_not_in": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "join_self": "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_multiway": "SELECT r_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "join_asof": "SELECT event_id, prev_id FROM (SELECT event_id, max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_id FROM events) t",
}

# --- aggregates --------------------------------------------------------------------------------
SAME |= {
    "agg_count": "SELECT count(*) AS n, count(o_custkey) AS n_cust, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_f FROM orders",
    "agg_count_distinct": "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem",
    "agg_sum_avg_min_max": "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS total, CAST(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS DOUBLE) AS mean, min(l_quantity) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag",
    "agg_total_empty": "SELECT CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS total, sum(o_custkey) IS NULL AS none FROM orders WHERE o_orderkey < 0",
    "agg_group_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10",
    "agg_group_expr": "SELECT l_orderkey % 10 AS bucket, count(*) AS n FROM lineitem GROUP BY l_orderkey % 10",
    "agg_group_ordinal": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2",
    "agg_filter": "SELECT l_shipmode_like, n, n_r FROM (SELECT l_linestatus AS l_shipmode_like, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_r FROM lineitem GROUP BY l_linestatus) t",
    "agg_max_by": "SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS best, min_by(o_orderkey, o_totalprice) AS worst FROM orders GROUP BY o_custkey",
    "agg_median": "SELECT l_returnflag, median(l_quantity) AS med FROM lineitem GROUP BY l_returnflag",
    "agg_distinct": "SELECT DISTINCT p_brand, p_type FROM part",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "agg_bool": "SELECT o_orderpriority, bool_or(o_totalprice > 300000) AS some, bool_and(o_totalprice > 1000) AS every FROM orders GROUP BY o_orderpriority",
    "agg_type_tally": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
}
PAIRS |= {
    "agg_string": (
        "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "agg_string_distinct": (
        "SELECT p_brand, listagg(DISTINCT p_type, '|') WITHIN GROUP (ORDER BY p_type) AS types FROM part GROUP BY p_brand",
        "SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types FROM part GROUP BY p_brand",
    ),
    "agg_percentile": (
        "SELECT l_linestatus, percentile(l_quantity, 0.25) AS p25, percentile(l_quantity, 0.75) AS p75, percentile(l_quantity, 0.9) AS p90, percentile(l_quantity, 0.95) AS p95, percentile(l_quantity, 0.99) AS p99 FROM lineitem GROUP BY l_linestatus",
        "SELECT l_linestatus, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.75) AS p75, quantile_cont(l_quantity, 0.9) AS p90, quantile_cont(l_quantity, 0.95) AS p95, quantile_cont(l_quantity, 0.99) AS p99 FROM lineitem GROUP BY l_linestatus",
    ),
    "agg_stddev_var": (
        "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS ss, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS vs, round(var_pop(l_quantity), 6) AS vp FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS ss, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS vs, round(var_pop(l_quantity), 6) AS vp FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_json_array": (
        "SELECT n_regionkey, to_json(sort_array(collect_list(n_nationkey))) AS keys FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, CAST(to_json(list(n_nationkey ORDER BY n_nationkey)) AS VARCHAR) AS keys FROM nation GROUP BY n_regionkey",
    ),
    "agg_json_object": (
        "SELECT n_regionkey, to_json(map_from_entries(array_sort(collect_list(struct(n_name, n_nationkey))))) AS obj FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS obj FROM nation GROUP BY n_regionkey",
    ),
}

# --- windows -----------------------------------------------------------------------------------
_W = "(PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey)"
SAME |= {
    "win_row_number": f"SELECT o_orderkey, row_number() OVER {_W} AS rn FROM orders",
    "win_rank_dense": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part",
    "win_ntile": f"SELECT o_orderkey, ntile(4) OVER {_W} AS q FROM orders",
    "win_percent_cume": "SELECT p_partkey, percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS pr, cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size) AS cd FROM part",
    "win_lag_lead": f"SELECT o_orderkey, lag(o_orderkey) OVER {_W} AS before, lead(o_orderkey, 2, -1) OVER {_W} AS after FROM orders",
    "win_first_last_nth": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_running_sum": f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER {_W[:-1]} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS upto FROM orders",
    "win_moving_avg": f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER {_W[:-1]} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) / count(*) OVER {_W[:-1]} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean3 FROM orders",
    "win_range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM part",
    "win_groups_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS near FROM (SELECT p_partkey, p_brand, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS g FROM part) t",
    "win_filter": "SELECT o_orderkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) OVER (PARTITION BY o_custkey) AS n_f FROM orders",
    "win_named": "SELECT event_id, count(*) OVER w AS n, max(value) OVER w AS top FROM events WINDOW w AS (PARTITION BY user_id)",
}

# --- sort, limit, sets, subqueries -------------------------------------------------------------
SAME |= {
    "sort_multi": "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand ASC, p_size DESC, p_partkey",
    "sort_nulls": "SELECT c_custkey, o FROM (SELECT c_custkey, max(o_orderkey) AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) t ORDER BY o NULLS FIRST, c_custkey",
    "sort_nocase": "SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 10",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "topk_per_group": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3",
    "union_all": "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region",
    "union_distinct": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) * 0.9 FROM orders)",
    "correlated_subquery": "SELECT p_partkey FROM part p WHERE p_retailprice >= (SELECT max(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)",
    "from_subquery": "SELECT b, count(*) AS n FROM (SELECT c_nationkey % 5 AS b FROM customer WHERE c_acctbal > 0) t GROUP BY b",
    "cte": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE n > 8) SELECT c_name, n FROM top JOIN customer ON o_custkey = c_custkey",
    "cte_recursive": "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r",
    "values": "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)",
}
PAIRS |= {"lateral_series": ("SELECT n_nationkey, i FROM nation, LATERAL explode(sequence(1, n_regionkey + 1)) AS t(i)", "SELECT n_nationkey, unnest(generate_series(1, n_regionkey + 1)) AS i FROM nation")}

# --- scalar functions --------------------------------------------------------------------------
SAME |= {
    "fn_math": "SELECT p_partkey, abs(-p_size) AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round(sqrt(p_size), 9) AS s, round(ln(p_size), 9) AS l, round(log10(p_size), 9) AS l10, round(log2(p_size), 9) AS l2, round(exp(p_size / 50.0), 9) AS e, round(power(p_size, 1.5), 6) AS p, sign(p_size - 25) AS g FROM part",
    "fn_trig": "SELECT n_nationkey, round(sin(n_nationkey), 9) AS s, round(cos(n_nationkey), 9) AS c, round(tan(n_nationkey), 9) AS t, round(atan(n_nationkey), 9) AS a, round(atan2(n_nationkey, 3), 9) AS a2, round(asin(n_nationkey / 25.0), 9) AS i, round(acos(n_nationkey / 25.0), 9) AS o, round(degrees(n_nationkey), 9) AS d, round(radians(n_nationkey), 9) AS r, round(pi(), 9) AS pi FROM nation",
    "fn_hyperbolic": "SELECT n_nationkey, round(sinh(CAST(n_nationkey AS DOUBLE) / 10), 9) AS s, round(cosh(CAST(n_nationkey AS DOUBLE) / 10), 9) AS c, round(tanh(CAST(n_nationkey AS DOUBLE) / 10), 9) AS t, round(asinh(n_nationkey), 9) AS a, round(acosh(n_nationkey + 1), 9) AS o, round(atanh(CAST(n_nationkey AS DOUBLE) / 26), 9) AS h, round(cot(n_nationkey + 1), 9) AS k FROM nation",
    "fn_text_case": "SELECT p_partkey, upper(p_name) AS u, lower(p_name) AS l, length(p_name) AS n FROM part",
    "fn_text_slice": "SELECT p_partkey, substring(p_name, 2, 3) AS s, left(p_name, 4) AS a, right(p_name, 4) AS b, split_part(p_type, ' ', 2) AS w FROM part",
    "fn_text_trim_pad": "SELECT p_partkey, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, trim('  ' || p_brand || ' ') AS t, ltrim('  ' || p_brand) AS lt, rtrim(p_brand || '  ') AS rt FROM part",
    "fn_text_build": "SELECT p_partkey, concat(p_brand, '-', p_type) AS c, concat_ws('/', p_brand, NULL, p_type) AS w, repeat(p_brand, 2) AS r, replace(p_type, ' ', '_') AS x, reverse(p_name) AS v, translate(p_brand, 'Brd', 'bRD') AS tr FROM part",
    "fn_levenshtein": "SELECT a.n_name AS x, b.n_name AS y, levenshtein(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
    "fn_greatest_least": "SELECT l_orderkey, l_linenumber, greatest(l_quantity, l_discount * 100) AS g, least(l_quantity, l_tax * 100) AS s FROM lineitem",
    "fn_date": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS first_day FROM orders",
    "fn_hash": "SELECT c_custkey, md5(c_name) AS m FROM customer",
}
PAIRS |= {
    "fn_text_search": (
        "SELECT p_partkey, instr(p_name, 'e') AS i, contains(p_name, 'an') AS c, startswith(p_name, 'P') AS p FROM part",
        "SELECT p_partkey, instr(p_name, 'e') AS i, contains(p_name, 'an') AS c, starts_with(p_name, 'P') AS p FROM part",
    ),
    "fn_hex": ("SELECT c_custkey, hex(c_name) AS h, hex(c_custkey) AS k, decode(unhex(hex(c_name)), 'UTF-8') AS back FROM customer", "SELECT c_custkey, hex(c_name) AS h, hex(c_custkey) AS k, decode(unhex(hex(c_name))) AS back FROM customer"),
    "fn_sha256": ("SELECT c_custkey, sha2(c_name, 256) AS h FROM customer", "SELECT c_custkey, sha256(c_name) AS h FROM customer"),
    "fn_octets": ("SELECT doc_id, octet_length(text) AS o, bit_length(text) AS b, char_length(text) AS c FROM documents", "SELECT doc_id, strlen(text) AS o, bit_length(text) AS b, length(text) AS c FROM documents"),
    "fn_unicode": ("SELECT p_partkey, ascii(p_name) AS u, chr(65 + p_size % 26) AS c FROM part", "SELECT p_partkey, ascii(p_name) AS u, chr(65 + p_size % 26) AS c FROM part"),
    "fn_printf": ("SELECT p_partkey, format_string('%s-%05d', p_brand, p_size) AS f FROM part", "SELECT p_partkey, printf('%s-%05d', p_brand, p_size) AS f FROM part"),
    "fn_iif": ("SELECT p_partkey, if(p_size > 25, 'big', 'small') AS s, ifnull(nullif(p_size, 7), -1) AS z FROM part", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS s, ifnull(nullif(p_size, 7), -1) AS z FROM part"),
    "fn_text_last_index": ("SELECT p_partkey, CASE WHEN instr(reverse(p_name), 'e') = 0 THEN 0 ELSE length(p_name) - instr(reverse(p_name), 'e') + 1 END AS i, endswith(p_name, 'e') AS e, regexp_count(p_name, 'a') AS n FROM part", "SELECT p_partkey, CASE WHEN instr(reverse(p_name), 'e') = 0 THEN 0 ELSE length(p_name) - instr(reverse(p_name), 'e') + 1 END AS i, ends_with(p_name, 'e') AS e, length(p_name) - length(replace(p_name, 'a', '')) AS n FROM part"),
    "fn_date_arith": (
        "SELECT o_orderkey, date_add(CAST(o_orderdate AS DATE), 30) AS later, datediff(DATE'1998-12-31', CAST(o_orderdate AS DATE)) AS days, unix_timestamp(o_orderdate) AS epoch FROM orders",
        "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS later, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS days, CAST(epoch(o_orderdate) AS BIGINT) AS epoch FROM orders",
    ),
    "fn_julian": ("SELECT o_orderkey, unix_timestamp(o_orderdate) / 86400D + 2440587.5D AS jd, date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') AS s FROM orders", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) / 86400::DOUBLE + 2440587.5::DOUBLE AS jd, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS s FROM orders"),
    "fn_json_extract": ("SELECT event_id, get_json_object(props, '$.k') AS k, json_array_length('[1,2,3]') AS n FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_array_length('[1,2,3]') AS INT) AS n FROM events"),
    "fn_json_each": ("SELECT event_id, j.key AS key, j.val AS value FROM events LATERAL VIEW explode(from_json(props, 'map<string,string>')) j AS key, val", "SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) t"),
    "fn_sequence": ("SELECT explode(sequence(1, 100, 3)) AS i", "SELECT unnest(generate_series(1, 100, 3)) AS i"),
    "fn_casts": ("SELECT p_partkey, CAST(p_retailprice AS BIGINT) AS t, CAST(p_size AS STRING) AS s, CAST(CAST(p_size AS STRING) AS INT) AS back FROM part", "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS t, CAST(p_size AS VARCHAR) AS s, CAST(CAST(p_size AS VARCHAR) AS INT) AS back FROM part"),
}

# --- time windows, flagship --------------------------------------------------------------------
PAIRS |= {
    "win_tumbling": (
        "SELECT w.start AS start, event_type, n FROM (SELECT window(ts, '1 hour') AS w, event_type, count(*) AS n FROM events GROUP BY window(ts, '1 hour'), event_type) t",
        "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    ),
    "win_sliding": (
        "SELECT w.start AS start, n FROM (SELECT window(ts, '2 hours', '1 hour') AS w, count(*) AS n FROM events GROUP BY window(ts, '2 hours', '1 hour')) t",
        "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') - INTERVAL '1 hour']) AS start FROM events) t GROUP BY start",
    ),
    "win_session": (
        "SELECT user_id, s.start AS start, n FROM (SELECT user_id, session_window(ts, '30 minutes') AS s, count(*) AS n FROM events GROUP BY user_id, session_window(ts, '30 minutes')) t",
        "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 1 ELSE 0 END AS fresh FROM events) a) b GROUP BY user_id, g",
    ),
}
_MONEY = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))"
SAME |= {
    "pricing_summary": f"SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base, CAST(sum({_MONEY}) AS DOUBLE) AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "region_revenue": f"SELECT r_name, n_name, CAST(sum({_MONEY}) AS DOUBLE) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY r_name, n_name",
}
