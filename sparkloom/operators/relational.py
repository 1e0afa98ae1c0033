"""Filters, joins, aggregates, sorts and set operations that Spark SQL has."""

from sparkloom.plans.registry import sql_query

MONEY = "sum(cast({} as decimal(18,4)))"

# Projections and filters.
sql_query("project_prune", "SELECT o_orderkey, o_custkey FROM {orders}")
sql_query("filter_range", "SELECT l_orderkey, l_quantity FROM {lineitem} WHERE l_quantity >= 45 AND l_discount < 0.03 AND l_returnflag <> 'A'")
sql_query("project_except", "SELECT * EXCEPT (o_totalprice, o_orderdate) FROM {orders}", "SELECT * EXCLUDE (o_totalprice, o_orderdate) FROM orders")
sql_query("project_lateral_alias", "SELECT n_nationkey AS a, a + 1 AS b FROM {nation}")
sql_query("filter_null_safe", "SELECT n_nationkey, n_regionkey IS DISTINCT FROM 1 AS d, nullif(n_regionkey, 2) AS e, coalesce(nullif(n_regionkey, 2), -1) AS f, greatest(n_regionkey, 2) AS g FROM {nation}")
sql_query("filter_like", "SELECT n_name FROM {nation} WHERE n_name LIKE '%1%' OR n_name ILIKE 'nation_2'")
sql_query("project_try_cast", "SELECT n_nationkey, try_cast(n_name AS int) AS a, try_cast('12' AS int) AS b FROM {nation}")
sql_query("project_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM {orders}")
sql_query("pipe_syntax", "FROM {orders} |> WHERE o_orderstatus = 'F' |> AGGREGATE count(*) AS n GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")

# Joins.
sql_query("join_broadcast", "SELECT /*+ BROADCAST(n) */ c_custkey, n_name FROM {customer} c JOIN {nation} n ON c_nationkey = n_nationkey")
sql_query("join_sort_merge", "SELECT /*+ MERGE(o) */ l_orderkey, l_linenumber, l_quantity, o_custkey FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey WHERE l_quantity > 48")
sql_query("join_shuffle_hash", "SELECT /*+ SHUFFLE_HASH(c) */ o_orderkey, c_mktsegment FROM {orders} o JOIN {customer} c ON o_custkey = c_custkey")
sql_query("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey > b.n_regionkey")
sql_query("join_cross", "SELECT r_regionkey, n_nationkey FROM {region} CROSS JOIN {nation}")
sql_query("join_semi", "SELECT c_custkey FROM {customer} LEFT SEMI JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
sql_query("join_anti", "SELECT o_orderkey FROM {orders} LEFT ANTI JOIN {lineitem} ON o_orderkey = l_orderkey", "SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
sql_query("join_left", "SELECT o_orderkey, l_partkey FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey AND l_quantity > 49")
sql_query("join_full_outer", "SELECT n_nationkey, s_suppkey FROM {nation} FULL OUTER JOIN (SELECT * FROM {supplier} WHERE s_acctbal > 5000) ON n_nationkey = s_nationkey", "SELECT n_nationkey, s_suppkey FROM nation FULL OUTER JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON n_nationkey = s_nationkey")
sql_query("join_using", "SELECT conv_id, turn, b.role AS r FROM {conversations} a JOIN {conversations} b USING (conv_id, turn)")
sql_query("join_natural", "SELECT * FROM {documents} NATURAL JOIN {labels}", "SELECT * FROM documents NATURAL JOIN labels")
sql_query("exists", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
sql_query("scalar_subquery", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
sql_query("scalar_subquery_theta", "SELECT s_suppkey, (SELECT count(*) FROM {nation} n WHERE n.n_nationkey < s.s_nationkey) AS below FROM {supplier} s")
sql_query("join_lateral", "SELECT c_custkey, t.o_orderkey, t.o_totalprice FROM {customer} c, LATERAL (SELECT o_orderkey, o_totalprice FROM {orders} o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
sql_query("join_five_tables", "SELECT n_name, count(*) AS n, cast(sum(cast(l_extendedprice * (1 - l_discount) AS decimal(18,4))) AS double) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey WHERE c_nationkey = s_nationkey GROUP BY n_name")

# Aggregates.
sql_query("agg_hash", "SELECT l_returnflag, l_linestatus, count(*) AS n, cast(sum(cast(l_quantity AS decimal(18,2))) AS double) AS qty, cast(sum(cast(l_extendedprice AS decimal(18,4))) AS double) AS price FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
sql_query("agg_sort", "SELECT o_orderpriority, max(o_orderstatus) AS m, min(o_orderstatus) AS l FROM {orders} GROUP BY o_orderpriority")
sql_query("agg_object", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql_query("agg_multi_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p, count(l_orderkey) AS n FROM {lineitem} GROUP BY l_returnflag")
for kind in ("ROLLUP", "CUBE"):
    sql_query(f"agg_{kind.lower()}", f"SELECT l_returnflag, l_linestatus, cast(grouping(l_returnflag) AS int) AS g, cast(grouping_id(l_returnflag, l_linestatus) AS bigint) AS i, count(*) AS n FROM {{lineitem}} GROUP BY {kind} (l_returnflag, l_linestatus)", f"SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::INT AS g, grouping_id(l_returnflag, l_linestatus)::BIGINT AS i, count(*) AS n FROM lineitem GROUP BY {kind} (l_returnflag, l_linestatus)")
sql_query("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql_query("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS a, count_if(o_totalprice <= 100000) AS b FROM {orders} GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS a, count_if(o_totalprice <= 100000)::BIGINT AS b FROM orders GROUP BY o_orderstatus")
sql_query("agg_boolean_bits", "SELECT n_regionkey, bool_and(n_nationkey > 2) AS a, bool_or(n_nationkey > 20) AS b, cast(bit_and(n_nationkey) AS int) AS c, cast(bit_or(n_nationkey) AS int) AS d, cast(bit_xor(n_nationkey) AS int) AS e FROM {nation} GROUP BY n_regionkey")
sql_query("agg_statistics", "SELECT l_returnflag, round(stddev(l_quantity), 6) AS a, round(var_pop(l_quantity), 6) AS b, round(corr(l_quantity, l_extendedprice), 6) AS c, round(regr_slope(l_extendedprice, l_quantity), 4) AS d, round(covar_samp(l_quantity, l_tax), 6) AS e FROM {lineitem} GROUP BY l_returnflag")
sql_query("agg_quantiles", "SELECT o_orderpriority, median(o_totalprice) AS a, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice), 6) AS b, percentile_disc(0.9) WITHIN GROUP (ORDER BY o_totalprice) AS c FROM {orders} GROUP BY o_orderpriority")
sql_query("agg_mode_by", "SELECT c_mktsegment, max_by(c_custkey, struct(c_acctbal, c_custkey)) AS a, min_by(c_custkey, struct(c_acctbal, c_custkey)) AS b FROM {customer} GROUP BY c_mktsegment", "SELECT c_mktsegment, arg_max(c_custkey, (c_acctbal, c_custkey)) AS a, arg_min(c_custkey, (c_acctbal, c_custkey)) AS b FROM customer GROUP BY c_mktsegment")
sql_query("agg_kurtosis_skewness", "SELECT l_returnflag, round(kurtosis(l_quantity), 6) AS k, round(skewness(l_quantity), 6) AS s FROM {lineitem} GROUP BY l_returnflag", "WITH m AS (SELECT l_returnflag AS f, avg(l_quantity) AS u FROM lineitem GROUP BY 1) SELECT l_returnflag, round(kurtosis_pop(l_quantity), 6) AS k, round(avg((l_quantity - u) ** 3) / avg((l_quantity - u) ** 2) ** 1.5, 6) AS s FROM lineitem JOIN m ON l_returnflag = f GROUP BY l_returnflag")
sql_query("agg_listagg", "SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name DESC) AS l FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS l FROM nation GROUP BY n_regionkey")
sql_query("agg_group_by_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ALL")
sql_query("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 15")
sql_query("agg_pivot", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM {orders}) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
sql_query("agg_unpivot", "SELECT p_partkey, k, v FROM (SELECT p_partkey, cast(p_size AS double) AS size, p_retailprice AS price FROM {part}) UNPIVOT (v FOR k IN (size, price))", "SELECT p_partkey, k, v FROM (SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price FROM part) UNPIVOT (v FOR k IN (size, price))")
sql_query("agg_histogram_map", "SELECT o_orderstatus, array_join(transform(sort_array(map_entries(map_from_entries(collect_list(struct(o_orderpriority, n))))), e -> concat(e.key, ':', e.value)), ',') AS h FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ALL) GROUP BY o_orderstatus", "SELECT o_orderstatus, string_agg(o_orderpriority || ':' || n, ',' ORDER BY o_orderpriority) AS h FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
sql_query("agg_any_value", "SELECT n_regionkey, any_value(r) AS r, count(*) AS n FROM (SELECT n_regionkey, n_regionkey * 2 AS r FROM {nation}) GROUP BY n_regionkey")
sql_query("agg_mode", "SELECT c_nationkey, mode() WITHIN GROUP (ORDER BY c_mktsegment) AS m FROM {customer} GROUP BY c_nationkey", "SELECT c_nationkey, arg_min(c_mktsegment, (-n, c_mktsegment)) AS m FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey")
sql_query("agg_collect_set", "SELECT l_returnflag, array_join(sort_array(collect_set(l_linestatus)), ',') AS s FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS s FROM lineitem GROUP BY l_returnflag")

# Windows.
sql_query("window_ranks", "SELECT o_orderkey, cast(rank() OVER w AS int) AS r, cast(dense_rank() OVER w AS int) AS d, cast(ntile(4) OVER w AS int) AS t, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c FROM {orders} WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)")
sql_query("window_offsets", "SELECT o_orderkey, lag(o_orderkey, 2, -1) OVER w AS a, lead(o_orderkey) OVER w AS b, first_value(o_orderkey) OVER w AS c, nth_value(o_orderkey, 2) OVER w AS d FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
sql_query("window_ignore_nulls", "SELECT event_id, lag(x) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM (SELECT *, nullif(value, 0) AS x FROM {events})", "SELECT event_id, lag(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM (SELECT *, nullif(value, 0) AS x FROM events)")
sql_query("window_rows_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS n, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS m FROM {events}")
sql_query("window_range_frame", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS n FROM {events}")
sql_query("window_top_n", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders}) WHERE r <= 3")

# Sorts, limits, set operations, recursion.
sql_query("sort_top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql_query("sort_nulls_last", "SELECT n_nationkey, x FROM (SELECT n_nationkey, nullif(n_regionkey, 1) AS x FROM {nation}) ORDER BY x NULLS LAST, n_nationkey")
sql_query("limit_offset", "SELECT c_custkey FROM {customer} ORDER BY c_custkey LIMIT 10 OFFSET 20")
sql_query("set_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
sql_query("set_union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
sql_query("set_intersect", "SELECT l_partkey AS k FROM {lineitem} WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM {lineitem} WHERE l_quantity < 5")
sql_query("set_intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
sql_query("set_except", "SELECT p_partkey AS k FROM {part} EXCEPT SELECT l_partkey FROM {lineitem}")
sql_query("set_except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")
sql_query("recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, cast(1 AS bigint) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
