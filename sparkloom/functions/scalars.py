"""Scalar functions over the driver's columns. Where engines differ the oracle states what is meant."""

from sparkloom.plans.registry import sql_query

sql_query("fn_math", "SELECT o_orderkey, cast(o_custkey div 7 AS bigint) AS a, o_custkey % 7 AS b, round(cbrt(o_totalprice), 6) AS c, round(power(o_custkey, 0.5), 6) AS d, cast(ceil(o_totalprice) AS bigint) AS e, cast(sign(o_totalprice - 100000) AS int) AS f, round(log10(o_totalprice), 9) AS g, round(ln(o_totalprice), 9) AS h, cast(bit_count(o_custkey) AS int) AS i, abs(-o_custkey) AS j FROM {orders}", "SELECT o_orderkey, (o_custkey // 7)::BIGINT AS a, o_custkey % 7 AS b, round(cbrt(o_totalprice), 6) AS c, round(power(o_custkey, 0.5), 6) AS d, ceil(o_totalprice)::BIGINT AS e, sign(o_totalprice - 100000)::INT AS f, round(log10(o_totalprice), 9) AS g, round(ln(o_totalprice), 9) AS h, bit_count(o_custkey)::INT AS i, abs(-o_custkey) AS j FROM orders")
sql_query("fn_try_divide", "SELECT n_nationkey, try_divide(1.0D, n_regionkey) AS a FROM {nation}", "SELECT n_nationkey, 1.0::DOUBLE / nullif(n_regionkey, 0) AS a FROM nation")
sql_query("fn_string", "SELECT c_custkey, cast(length(c_name) AS int) AS a, reverse(c_name) AS b, lpad(c_mktsegment, 12, '*') AS c, cast(instr(c_name, '#') AS int) AS d, trim(concat_ws('-', c_mktsegment, ' x ')) AS e, split_part(c_name, '#', 2) AS f, cast(levenshtein(c_mktsegment, 'BUILDING') AS int) AS g, md5(c_name) AS h, sha2(c_name, 256) AS i, substring(c_name, -4) AS j, upper(c_mktsegment) AS k, repeat(substring(c_mktsegment, 1, 1), 3) AS l, replace(c_name, '0', 'o') AS m FROM {customer}", "SELECT c_custkey, length(c_name)::INT AS a, reverse(c_name) AS b, lpad(c_mktsegment, 12, '*') AS c, instr(c_name, '#')::INT AS d, trim(concat_ws('-', c_mktsegment, ' x ')) AS e, split_part(c_name, '#', 2) AS f, levenshtein(c_mktsegment, 'BUILDING')::INT AS g, md5(c_name) AS h, sha256(c_name) AS i, substring(c_name, -4) AS j, upper(c_mktsegment) AS k, repeat(substring(c_mktsegment, 1, 1), 3) AS l, replace(c_name, '0', 'o') AS m FROM customer")
sql_query("fn_regex", r"SELECT doc_id, cast(regexp_count(text, '[aeiou]+') AS bigint) AS a, regexp_extract(text, '([a-z]+)', 1) AS b, regexp_replace(text, '[0-9]+', '#') AS c FROM {documents}", r"SELECT doc_id, len(regexp_extract_all(text, '[aeiou]+')) AS a, regexp_extract(text, '([a-z]+)', 1) AS b, regexp_replace(text, '[0-9]+', '#', 'g') AS c FROM documents")
sql_query("fn_date", "SELECT o_orderkey, cast(datediff(o_orderdate, timestamp_ntz'1995-01-01') AS bigint) AS a, cast(extract(YEAR FROM o_orderdate) AS bigint) AS b, cast(weekofyear(o_orderdate) AS bigint) AS c, date_format(o_orderdate, 'yyyy-MM-dd') AS d, cast(dayofweek(o_orderdate) - 1 AS bigint) AS e, cast(date_trunc('MONTH', o_orderdate) AS timestamp_ntz) AS f, cast(last_day(o_orderdate) AS date) AS g FROM {orders}", "SELECT o_orderkey, datediff('day', TIMESTAMP '1995-01-01', o_orderdate) AS a, year(o_orderdate) AS b, weekofyear(o_orderdate) AS c, strftime(o_orderdate, '%Y-%m-%d') AS d, dayofweek(o_orderdate) AS e, date_trunc('month', o_orderdate)::TIMESTAMP AS f, last_day(o_orderdate) AS g FROM orders")
sql_query("fn_array", "SELECT vec_id, cast(size(embedding) AS bigint) AS a, element_at(embedding, 3) AS b, cast(size(filter(embedding, x -> x > 0)) AS bigint) AS c, array_max(embedding) AS d, array_contains(slice(embedding, 1, 5), embedding[2]) AS e, array_position(embedding, embedding[7]) AS f FROM {embeddings}", "SELECT vec_id, len(embedding) AS a, embedding[3] AS b, len(list_filter(embedding, lambda x: x > 0)) AS c, list_max(embedding) AS d, list_contains(embedding[1:5], embedding[3]) AS e, list_position(embedding, embedding[8])::BIGINT AS f FROM embeddings")
sql_query("fn_explode", "SELECT conv_id, turn, cast(p AS bigint) AS p, w FROM {conversations} LATERAL VIEW posexplode(split(text, ' ')) AS p, w", "SELECT conv_id, turn, p, w FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS p FROM conversations)")
sql_query("fn_json", "SELECT event_id, get_json_object(props, '$.k') AS a, from_json(props, 'k INT').k AS b, variant_get(parse_json(props), '$.k', 'int') AS c FROM {events}", "SELECT event_id, json_extract_string(props, '$.k') AS a, json_extract_string(props, '$.k')::INT AS b, json_extract_string(props, '$.k')::INT AS c FROM events")
sql_query("fn_map", "SELECT n_nationkey, m['a'] AS a, m['z'] AS z, array_join(map_keys(m), ',') AS k, cast(size(m) AS int) AS s FROM (SELECT n_nationkey, map('a', n_name, 'b', 'x') AS m FROM {nation})", "SELECT n_nationkey, n_name AS a, NULL::VARCHAR AS z, 'a,b' AS k, 2::INT AS s FROM nation")
sql_query("fn_conditional", "SELECT n_nationkey, if(n_regionkey > 2, 'hi', 'lo') AS a, nvl(nullif(n_regionkey, 0), 9) AS b, least(n_regionkey, 2) AS c FROM {nation}", "SELECT n_nationkey, CASE WHEN n_regionkey > 2 THEN 'hi' ELSE 'lo' END AS a, coalesce(nullif(n_regionkey, 0), 9) AS b, least(n_regionkey, 2) AS c FROM nation")
sql_query("fn_width_bucket", "SELECT o_orderkey, width_bucket(o_totalprice, 0, 500000, 10) AS b FROM {orders}", "SELECT o_orderkey, CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 11 ELSE floor(o_totalprice / 50000) + 1 END::BIGINT AS b FROM orders")
sql_query("vector_dot", "SELECT a.vec_id AS u, b.vec_id AS v, round(aggregate(zip_with(a.embedding, b.embedding, (x, y) -> cast(x AS double) * y), 0D, (s, x) -> s + x), 5) AS dot FROM {embeddings} a CROSS JOIN {embeddings} b WHERE a.vec_id % 20 = 0", "SELECT a.vec_id AS u, b.vec_id AS v, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS dot FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0")

sql_query("fn_rounding", "SELECT o_orderkey, bround(o_custkey / 2, 0) AS a, floor(o_totalprice / 7) AS b, pmod(-o_custkey, 5) AS c, cast(o_custkey ^ 3 AS bigint) AS d, shiftleft(1, 3) AS e, try_add(2147483647, n) AS f FROM (SELECT *, 1 AS n FROM {orders})", "SELECT o_orderkey, round_even(o_custkey / 2, 0) AS a, floor(o_totalprice / 7)::BIGINT AS b, (5 - o_custkey % 5) % 5 AS c, xor(o_custkey, 3)::BIGINT AS d, 8::INT AS e, NULL::INT AS f FROM orders")
sql_query("fn_array_build", "SELECT n_nationkey, array_join(transform(array_distinct(flatten(array(sequence(0, n_regionkey), array(n_regionkey, 1)))), x -> cast(x AS string)), ',') AS a, aggregate(sequence(0, n_nationkey), 0, (s, x) -> s + x) AS b, array_join(sort_array(array_union(array(n_name), array('z'))), ',') AS c, exists(sequence(0, n_regionkey), x -> x = 3) AS d FROM {nation}", "SELECT n_nationkey, array_to_string(list_sort(list_distinct(list_concat(range(n_regionkey + 1), [n_regionkey, 1]))), ',') AS a, (n_nationkey * (n_nationkey + 1) / 2)::INT AS b, n_name || ',z' AS c, n_regionkey >= 3 AS d FROM nation")
sql_query("fn_time", "SELECT event_id, unix_micros(cast(ts AS timestamp)) AS a, cast(ts + INTERVAL 90 MINUTES AS timestamp_ntz) AS b, cast(extract(HOUR FROM ts) AS bigint) AS c, cast(date_trunc('HOUR', ts) AS timestamp_ntz) AS d, cast(to_date(ts) AS date) AS e FROM {events}", "SELECT event_id, epoch_us(ts) AS a, ts + INTERVAL 90 MINUTES AS b, hour(ts) AS c, date_trunc('hour', ts)::TIMESTAMP AS d, ts::DATE AS e FROM events")
sql_query("fn_hash_encode", "SELECT c_custkey, base64(cast(c_mktsegment AS binary)) AS a, hex(c_custkey) AS b, cast(ascii(c_name) AS int) AS c, cast(octet_length(c_name) AS bigint) AS d, translate(c_mktsegment, 'AEIOU', 'aeiou') AS e, sha1(c_name) AS f FROM {customer}", "SELECT c_custkey, base64(encode(c_mktsegment)) AS a, hex(c_custkey) AS b, ascii(c_name)::INT AS c, octet_length(encode(c_name)) AS d, translate(c_mktsegment, 'AEIOU', 'aeiou') AS e, sha1(c_name) AS f FROM customer")
sql_query("fn_sqrt", "SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS a, isnan(sqrt(-1.0D * o_custkey)) AS b, round(exp(ln(o_totalprice)), 4) AS c, round(atan2(o_custkey, 100), 9) AS d FROM {orders}", "SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS a, o_custkey > 0 AS b, round(exp(ln(o_totalprice)), 4) AS c, round(atan2(o_custkey, 100), 9) AS d FROM orders")
