"""Queries over the driver's tables, one for each operator of the language, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators.write import Writer
from knotwork.plans.compiler import Compiler
from knotwork.schema import Catalog
from knotwork.session import parsed, query, run
from knotwork.sources import tables
from knotwork.sources.store import EdgeStore

#: The iid of the region with key 2: the number of the type in the catalog, then the key.
_REGION_2 = f"0x{list(tables.catalog().types).index('region'):04x}{2:016x}"

# name: (query, SQL). Sums are over whole numbers, so that no order of additions shows.
TEXTS: dict[str, tuple[str, str]] = {
    "flagship": (
        "match $c isa customer, has c_mktsegment $s; placement (order: $o, buyer: $c); $o has o_totalprice $p; $p > 100000.0; let $cents = round($p * 100.0); reduce $n = count, $rev = sum($cents) groupby $s; sort $rev desc;",
        "SELECT c_mktsegment AS s, count(*) AS n, sum(CAST(round_even(o_totalprice * 100.0, 0) AS BIGINT))::BIGINT AS rev FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000.0 GROUP BY 1",
    ),
    "isa_scan": ("match $r isa region, has r_name $n; select $n;", "SELECT r_name AS n FROM region"),
    "isa_exact": ("match $x isa! customer, has name $n; select $n;", "SELECT c_name AS n FROM customer"),
    "isa_polymorphic": ("match $p isa party, has name $n, has acctbal $b; select $n, $b;", "SELECT c_name AS n, c_acctbal AS b FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier"),
    "isa_type_variable": ("match $x isa $t; $t sub party; reduce $n = count groupby $t;", "SELECT 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'party', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)"),
    "isa_exact_type_variable": ("match $x isa! $t; $t sub party; reduce $n = count groupby $t;", "SELECT 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier"),
    "isa_count_all_entities": ("match $x isa! $t; entity $t; reduce $n = count groupby $t;", " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {f}" for t, f in (("region", "region"), ("nation", "nation"), ("customer", "customer"), ("supplier", "supplier"), ("part", "part"), ("order", "orders"), ("event", "events"), ("document", "documents"), ("page", "pages"), ("item", "benchmark"), ("utterance", "conversations"), ("vector", "embeddings")))),
    "isa_attribute": ("match $b isa p_brand; select $b;", "SELECT DISTINCT p_brand AS b FROM part"),
    "isa_value": ('match $s isa c_mktsegment "BUILDING"; $c has c_mktsegment $s, has c_custkey $k; select $k;', "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "has_forward": ("match $p isa part, has p_name $n, has p_size $s; select $n, $s;", "SELECT p_name AS n, p_size::BIGINT AS s FROM part"),
    "has_reverse": ('match $s == "BUILDING"; $c has c_mktsegment $s, has c_custkey $k; select $k;', "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "has_eq": ('match $e isa event, has event_type "click", has event_id $i; select $i;', "SELECT event_id AS i FROM events WHERE event_type = 'click'"),
    "has_range": ("match $o isa order, has o_totalprice >= 50000.0, has o_totalprice $p, has o_orderkey $k; $p < 60000.0; select $k, $p;", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice >= 50000.0 AND o_totalprice < 60000.0"),
    "has_between_dates": ("match $o isa order, has o_orderdate $d, has o_orderkey $k; $d >= 1996-01-01; $d < 1996-07-01T00:00:00; select $k;", "SELECT o_orderkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'"),
    "has_contains": ('match $p isa part, has p_name $n; $n contains "PART"; reduce $c = count;', "SELECT count(*) AS c FROM part WHERE contains(lower(p_name), 'part')"),
    "has_like": ('match $p isa part, has p_brand $b, has p_partkey $k; $b like "#[1-3]"; select $k, $b;', "SELECT p_partkey AS k, p_brand AS b FROM part WHERE regexp_matches(p_brand, '#[1-3]')"),
    "has_untyped": ("match $r isa region, has $a; $a isa! $t; $t label r_name; select $a;", "SELECT r_name AS a FROM region"),
    "has_type_variable": ("match $r isa region, has $t $a; $t label r_name; select $a, $t;", "SELECT r_name AS a, 'r_name' AS t FROM region"),
    "has_shared_value": ('match $a isa part, has p_size $z, has p_partkey 1; $b isa part, has p_size $z, has p_partkey $k; select $k, $z;', 'SELECT p_partkey AS k, p_size::BIGINT AS z FROM part WHERE p_size = (SELECT p_size FROM part WHERE p_partkey = 1)'),
    "links_binary": ("match placement (order: $o, buyer: $c); $o has o_orderkey $k; $c has name $n; select $k, $n;", "SELECT o_orderkey AS k, c_name AS n FROM orders JOIN customer ON c_custkey = o_custkey"),
    "links_reverse": ("match $c isa customer, has c_custkey $k; $r isa placement, links (buyer: $c); reduce $n = count groupby $k;", "SELECT c_custkey AS k, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "links_ternary": ("match $l isa line-item (order: $o, item: $p, vendor: $s), has l_quantity $q; $o has o_orderpriority $pr; $p has p_brand $b; let $w = round($q); reduce $n = count, $t = sum($w) groupby $pr, $b;", "SELECT o_orderpriority AS pr, p_brand AS b, count(*) AS n, sum(CAST(round_even(l_quantity, 0) AS BIGINT))::BIGINT AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL"),
    "links_anonymous_distinct": ("match line-item (order: $o, vendor: $s); $o has o_orderkey $k; $s has s_suppkey $v; select $k, $v;", "SELECT DISTINCT l_orderkey AS k, l_suppkey AS v FROM lineitem"),
    "links_untyped_role": ("match location ($a, $b); $a isa nation, has n_name $n; $b isa region, has r_name $r; select $n, $r;", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "links_role_variable": ("match $l isa location, links ($role: $x); $x isa region; reduce $n = count groupby $role;", "SELECT 'location:outer' AS role, count(*) AS n FROM nation"),
    "links_dedup": ('match $r isa reply, links ($x: $p, $y: $q); reduce $n = count groupby $x, $y;', "WITH r AS (SELECT count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT 'reply:prev' AS x, 'reply:next' AS y, n FROM r UNION ALL SELECT 'reply:next', 'reply:prev', n FROM r"),
    "links_polymorphic": ("match residence (resident: $p, place: $n); $n has n_name $x; reduce $c = count groupby $x;", "SELECT n_name AS x, count(*) AS c FROM nation JOIN (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) ON k = n_nationkey GROUP BY 1"),
    "links_two_hops": ("match placement (order: $a, buyer: $c); placement (order: $b, buyer: $c); $a has o_orderkey $x; $b has o_orderkey $y; $x < $y; reduce $n = count;", "SELECT count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey"),
    "links_chain": ("match residence (resident: $c, place: $n); $c isa customer; location (inner: $n, outer: $r); $r has r_name $name; reduce $k = count groupby $name;", "SELECT r_name AS name, count(*) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1"),
    "is_concept": ("match $x isa nation; $y isa nation; $x is $y; $x has n_name $a; $y has n_name $b; select $a, $b;", "SELECT n_name AS a, n_name AS b FROM nation"),
    "is_alias": ("match $x isa region, has r_name $a; $y is $x; $y has r_regionkey $k; select $a, $k;", "SELECT r_name AS a, r_regionkey::BIGINT AS k FROM region"),
    "iid_lookup": (f'match $x isa region, has r_name $n; let $i = iid($x); $x iid {_REGION_2}; select $n, $i;', f"SELECT r_name AS n, '{_REGION_2}' AS i FROM region WHERE r_regionkey = 2"),
    "theta_join": ("match $a isa nation, has n_nationkey $x; $b isa nation, has n_nationkey $y; $x < $y; reduce $n = count;", "SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey"),
    "compare_other_kind": ('match $r isa region, has r_name $n, has r_regionkey $k; not { $k == $n; }; select $n;', "SELECT r_name AS n FROM region"),
    "not_pattern": ('match $d isa document, has doc_id $k; not { labelling (subject: $d); }; select $k;', 'SELECT doc_id AS k FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)'),
    "not_correlated_cmp": ('match $c isa customer, has c_custkey $k, has acctbal $b; not { placement (order: $o, buyer: $c); $o has o_totalprice $p; $p < $b; }; select $k;', 'SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < c_acctbal)'),
    "not_not": ("match $c isa customer, has c_custkey $k; not { $o isa order; placement (order: $o, buyer: $c); not { $o has o_orderstatus \"O\"; }; }; select $k;", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'O')"),
    "or_pattern": ("match $p isa part, has p_partkey $k; { $p has p_size > 40; } or { $p has p_retailprice < 1000.0; }; reduce $n = count;", "SELECT (SELECT count(*) FROM part WHERE p_size > 40) + (SELECT count(*) FROM part WHERE p_retailprice < 1000.0) AS n"),
    "or_types": ("match { $x isa customer, has c_custkey $k; } or { $x isa supplier, has s_suppkey $k; }; select $k;", "SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier"),
    "or_nested": ('match $o isa order, has o_orderkey $k, has o_orderstatus $s; { $s == "F"; } or { $s == "O"; { $k < 100; } or { $k > 1000; }; }; reduce $n = count groupby $s;', "SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' AND (o_orderkey < 100 OR o_orderkey > 1000) GROUP BY 1"),
    "try_pattern": ("match $d isa document, has doc_id $i; try { $l isa labelling, links (subject: $d), has quality $q; }; select $i, $q;", "SELECT d.doc_id AS i, quality::BIGINT AS q FROM documents d LEFT JOIN labels USING (doc_id)"),
    "require": ("match $d isa document, has doc_id $i; try { $l isa labelling, links (subject: $d), has toxic $q; }; require $q; select $i, $q;", "SELECT doc_id AS i, toxic::BIGINT AS q FROM documents JOIN labels USING (doc_id)"),
    "select_bag": ("match $o isa order, has o_orderstatus $s; select $s;", "SELECT o_orderstatus AS s FROM orders"),
    "distinct": ("match $o isa order, has o_orderstatus $s, has o_orderpriority $p; select $s, $p; distinct;", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "sort_limit_offset": ("match $o isa order, has o_totalprice $p, has o_orderkey $k; sort $p desc, $k asc; offset 10; limit 20; select $k, $p;", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 20 OFFSET 10"),
    "top_k": ("match $c isa customer, has acctbal $b, has c_custkey $k; sort $b desc, $k; limit 10; select $k, $b;", "SELECT c_custkey AS k, c_acctbal AS b FROM customer ORDER BY b DESC, k LIMIT 10"),
    "reduce_count": ("match $l isa line-item; reduce $n = count;", "SELECT count(*) AS n FROM lineitem"),
    "reduce_count_var": ("match $d isa document, has lang $g; try { $l isa labelling, links (subject: $d), has quality $q; }; reduce $n = count, $m = count($q) groupby $g;", "SELECT lang AS g, count(*) AS n, count(quality) AS m FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"),
    "reduce_sum": ("match $p isa part, has p_size $s, has p_brand $b; reduce $t = sum($s) groupby $b;", "SELECT p_brand AS b, sum(p_size)::BIGINT AS t FROM part GROUP BY 1"),
    "reduce_min_max": ("match $o isa order, has o_totalprice $p, has o_orderdate $d, has o_orderstatus $s; reduce $lo = min($p), $hi = max($p), $first = min($d), $last = max($d) groupby $s;", 'SELECT o_orderstatus AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS "first", max(o_orderdate) AS "last" FROM orders GROUP BY 1'),
    "reduce_min_string": ("match $c isa customer, has name $n, has c_mktsegment $s; reduce $lo = min($n), $hi = max($n) groupby $s;", "SELECT c_mktsegment AS s, min(c_name) AS lo, max(c_name) AS hi FROM customer GROUP BY 1"),
    "reduce_mean": ("match $p isa part, has p_size $s, has p_brand $b; reduce $m = mean($s) groupby $b;", "SELECT p_brand AS b, avg(p_size)::DOUBLE AS m FROM part GROUP BY 1"),
    "reduce_median": ("match $p isa part, has p_retailprice $r, has p_brand $b; reduce $m = median($r) groupby $b;", "SELECT p_brand AS b, median(p_retailprice) AS m FROM part GROUP BY 1"),
    "reduce_std": ("match $p isa part, has p_size $s, has p_brand $b; reduce $d = std($s) groupby $b; match let $r = round($d * 1000000.0); select $b, $r;", "SELECT p_brand AS b, CAST(round_even(stddev_samp(p_size) * 1000000.0, 0) AS BIGINT) AS r FROM part GROUP BY 1"),
    "reduce_groupby_two": ("match $o isa order, has o_orderstatus $s, has o_orderpriority $p; reduce $n = count groupby $s, $p;", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL"),
    "reduce_empty": ("match $o isa order, has o_totalprice $p; $p < 0.0; reduce $n = count, $s = sum($p), $m = max($p), $a = mean($p);", "SELECT 0::BIGINT AS n, 0::DOUBLE AS s, NULL::DOUBLE AS m, NULL::DOUBLE AS a"),
    "reduce_empty_groups": ("match $o isa order, has o_totalprice $p, has o_orderstatus $t; $p < 0.0; reduce $n = count groupby $t;", "SELECT o_orderstatus AS t, count(*) AS n FROM orders WHERE o_totalprice < 0 GROUP BY 1"),
    "distinct_reduce": ("match $e isa event, has user_id $u, has event_type $t; select $u, $t; distinct; reduce $n = count groupby $t;", "SELECT event_type AS t, count(DISTINCT user_id) AS n FROM events GROUP BY 1"),
    "let_arith": ("match $p isa part, has p_size $s, has p_partkey $k; let $x = ($s + 3) * 2 - $k; select $k, $x;", "SELECT p_partkey AS k, (p_size::BIGINT + 3) * 2 - p_partkey AS x FROM part"),
    "let_int_div": ("match $p isa part, has p_size $s, has p_partkey $k; let $x = $s / 4; select $k, $x;", "SELECT p_partkey AS k, p_size / 4 AS x FROM part"),
    "let_mod": ("match $p isa part, has p_size $s, has p_partkey $k; let $m = $s - 25; let $x = $m % 7; select $k, $x;", "SELECT p_partkey AS k, (((p_size::BIGINT - 25) % 7) + 7) % 7 AS x FROM part"),
    "let_pow": ("match $p isa part, has p_size $s, has p_partkey $k; let $x = $s ^ 2; select $k, $x;", "SELECT p_partkey AS k, (p_size * p_size)::DOUBLE AS x FROM part"),
    "let_round_even": ("match $p isa part, has p_size $s, has p_partkey $k; let $h = $s / 2; let $x = round($h); let $u = ceil($h); let $d = floor($h); select $k, $x, $u, $d;", "SELECT p_partkey AS k, CAST(round_even(p_size / 2, 0) AS BIGINT) AS x, CAST(ceil(p_size / 2) AS BIGINT) AS u, CAST(floor(p_size / 2) AS BIGINT) AS d FROM part"),
    "let_len": ("match $d isa document, has doc_text $t, has doc_id $i; let $n = len($t); select $i, $n;", "SELECT doc_id AS i, length(text) AS n FROM documents"),
    "let_min_max": ("match $p isa part, has p_size $s, has p_partkey $k; let $a = min($s, 10); let $b = max($s, 40); let $c = abs($s - 25); select $k, $a, $b, $c;", "SELECT p_partkey AS k, least(p_size, 10)::BIGINT AS a, greatest(p_size, 40)::BIGINT AS b, abs(p_size::BIGINT - 25) AS c FROM part"),
    "let_concat": ('match $c isa customer, has name $n, has c_mktsegment $s; let $x = $n + "/" + $s; select $x;', "SELECT c_name || '/' || c_mktsegment AS x FROM customer"),
    "let_list": ("match $p isa part, has p_size $s, has p_partkey $k; let $x = [$s, $k, 7][1]; select $k, $x;", "SELECT p_partkey AS k, p_partkey AS x FROM part"),
    "let_date_shift": ("match $o isa order, has o_orderdate $d, has o_orderkey $k; let $e = $d + P1M2DT3H; select $k, $e;", "SELECT o_orderkey AS k, o_orderdate + INTERVAL 1 MONTH + INTERVAL 2 DAY + INTERVAL 3 HOUR AS e FROM orders"),
    "fun_inline": ("with fun prices($c: customer) -> { double }: match placement (order: $o, buyer: $c); $o has o_totalprice $p; return { $p }; match $c isa customer, has c_custkey $k; let $p in prices($c); select $k, $p;", "SELECT DISTINCT o_custkey AS k, o_totalprice AS p FROM orders"),
    "fun_agg": ("with fun orders($c: customer) -> integer: match $r isa placement, links (buyer: $c); return count($r); match $c isa customer, has c_custkey $k; let $n = orders($c); select $k, $n;", "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "fun_first": ("with fun dearest($c: customer) -> double: match placement (order: $o, buyer: $c); $o has o_totalprice $p; sort $p desc; return first $p; match $c isa customer, has c_custkey $k; let $p = dearest($c); select $k, $p;", "SELECT o_custkey AS k, max(o_totalprice) AS p FROM orders GROUP BY 1"),
    "fun_last": ("with fun cheapest($c: customer) -> double: match placement (order: $o, buyer: $c); $o has o_totalprice $p; sort $p desc; return last $p; match $c isa customer, has c_custkey $k; let $p = cheapest($c); select $k, $p;", "SELECT o_custkey AS k, min(o_totalprice) AS p FROM orders GROUP BY 1"),
    "fun_check": ("with fun bought($c: customer) -> boolean: match placement (buyer: $c); return check; match $c isa customer, has c_custkey $k; let $b = bought($c); select $k, $b;", "SELECT c_custkey AS k, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS b FROM customer"),
    "fun_value_argument": ("with fun twice($x: integer) -> integer: match let $y = $x * 2; return first $y; match $p isa part, has p_size $s, has p_partkey $k; let $d = twice($s) + 1; select $k, $d;", "SELECT p_partkey AS k, p_size::BIGINT * 2 + 1 AS d FROM part"),
    "fun_nested": ("with fun total($c: customer) -> integer: match placement (order: $o, buyer: $c); let $n = lines($o); return sum($n); with fun lines($o: order) -> integer: match $l isa line-item, links (order: $o); return count($l); match $c isa customer, has c_custkey $k; let $t = total($c); select $k, $t;", "SELECT c_custkey AS k, coalesce(sum(n), 0)::BIGINT AS t FROM customer LEFT JOIN (SELECT o_custkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey) ON o_custkey = c_custkey GROUP BY 1"),
    "fun_recursive": (
        "with fun after($u: utterance) -> { utterance }: match { reply (prev: $u, next: $v); } or { reply (prev: $u, next: $w); let $v in after($w); }; return { $v }; match $u isa utterance, has turn $t, has conv_id $c; $t == 0; let $v in after($u); reduce $n = count groupby $c;",
        "SELECT conv_id AS c, count(*) AS n FROM conversations WHERE turn > 0 GROUP BY 1",
    ),
    "fun_recursive_value": ("with fun fib($i: integer) -> { integer }: match { $i < 2; let $r = $i; } or { $i > 1; let $a = $i - 1; let $b = $i - 2; let $x in fib($a); let $y in fib($b); let $r = $x + $y; }; return { $r }; match let $f in fib(7);", "SELECT 13::BIGINT AS f"),
    "fetch_attrs": ('match $c isa customer, has c_custkey $k; fetch { "key": $k, "name": $c.name, "next": $k + 1, "type": customer };', "SELECT c_custkey AS \"key\", c_name AS name, c_custkey + 1 AS \"next\", 'customer' AS \"type\" FROM customer"),
    "fetch_function": ('with fun orders($c: customer) -> integer: match $r isa placement, links (buyer: $c); return count($r); match $c isa customer, has c_custkey $k; fetch { "key": $k, "n": orders($c) };', "SELECT c_custkey AS \"key\", count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "fetch_subquery_reduce": ('match $n isa nation, has n_name $x; fetch { "nation": $x, "people": ( match residence (resident: $p, place: $n); return count($p); ) };', "SELECT n_name AS nation, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS people FROM nation"),
    "fetch_subquery_first": ('match $c isa customer, has c_custkey $k; fetch { "key": $k, "best": ( match placement (order: $o, buyer: $c); $o has o_totalprice $p; sort $p desc; return first $p; ) };', "SELECT c_custkey AS \"key\", (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best FROM customer"),
    "schema_owns": ("match $t owns $a; $t label customer; select $t, $a;", "SELECT * FROM (VALUES ('customer', 'name'), ('customer', 'acctbal'), ('customer', 'c_custkey'), ('customer', 'c_mktsegment')) v(t, a)"),
    "schema_relates": ("match $t relates $r; $t label line-item; select $r;", "SELECT * FROM (VALUES ('line-item:order'), ('line-item:item'), ('line-item:vendor')) v(r)"),
    "schema_plays": ("match $t plays residence:resident; select $t;", "SELECT * FROM (VALUES ('party'), ('customer'), ('supplier')) v(t)"),
    "schema_sub": ("match $t sub party; select $t;", "SELECT * FROM (VALUES ('party'), ('customer'), ('supplier')) v(t)"),
    "schema_sub_exact": ("match $t sub! party; select $t;", "SELECT * FROM (VALUES ('customer'), ('supplier')) v(t)"),
    "schema_kind_value": ("match attribute $a; $a value datetime; select $a;", "SELECT * FROM (VALUES ('o_orderdate'), ('l_shipdate'), ('ts')) v(a)"),
    "schema_with_data": ("match $x isa! $t, has acctbal $b; $t plays placement:buyer; reduce $n = count groupby $t;", "SELECT 'customer' AS t, count(*) AS n FROM customer"),
    "meta_label": ("match $x isa! $t; $t sub party; let $l = label($t); reduce $n = count groupby $l;", "SELECT 'customer' AS l, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier"),
    "meta_doc": ("match $t label nation; let $d = get_doc($t); select $d;", "SELECT 'a country' AS d"),
    "meta_key": ('match $t label nation; let $d = get_meta("level", $t); select $d;', "SELECT '2' AS d"),
    "meta_owns_doc": ("match $t label customer; $a label c_mktsegment; let $d = get_owns_doc($t, $a); select $d;", "SELECT 'market segment' AS d"),
    "meta_plays_doc": ("match $t label region; $r label location:outer; let $d = get_plays_doc($t, $r); select $d;", "SELECT 'regions hold nations' AS d"),
    "meta_relates_sub": ("match $t label placement; $r label placement:buyer; let $d = get_relates_doc($t, $r); $s label customer; $u label party; let $e = get_sub_doc($s, $u); let $m = get_relates_meta(\"k\", $t, $r); select $d, $e, $m;", "SELECT '' AS d, 'a party that buys' AS e, 'v' AS m"),
    "meta_fun": ("with fun one() -> integer @doc(\"always one\") @meta(\"a\", \"b\"): match let $x = 1; return first $x; match let $d = get_fun_doc(\"one\"); let $k, $v in get_fun_all_meta(\"one\"); let $o = one(); select $d, $k, $v, $o;", "SELECT 'always one' AS d, 'a' AS k, 'b' AS v, 1::BIGINT AS o"),
    "meta_all": ("match $t label nation; let $k, $v in get_all_meta($t); select $k, $v;", "SELECT 'level' AS k, '2' AS v"),
    "match_match": ("match $c isa customer, has c_custkey $k; match placement (order: $o, buyer: $c); $o has o_totalprice $p; select $k, $p;", "SELECT o_custkey AS k, o_totalprice AS p FROM orders"),
    "reduce_match": ('match placement (buyer: $c); reduce $n = count groupby $c; match $c has name $x; $n == 1; select $x, $n;', 'SELECT c_name AS x, 1::BIGINT AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)'),
    "reduce_match_named": ("match $r isa placement, links (buyer: $c); reduce $n = count groupby $c; match $c has name $x; $n > 10; select $x, $n;", "SELECT c_name AS x, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey WHERE n > 10"),
    "unsatisfiable_branch": ("match $x isa party, has name $n; { $x isa customer; } or { $x isa region; }; reduce $k = count;", "SELECT count(*) AS k FROM customer"),
}


def _text(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, tables.catalog(), tables.store(spark, sf_dir), text)

    return run


def given_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input rows that the caller brings: here the segments with their shortest names."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_mktsegment").alias("s")).agg(F.max("c_custkey").alias("top"))
    return query(spark, tables.catalog(), tables.store(spark, sf_dir), "given $s: string, $top: integer; match $c isa customer, has c_mktsegment == $s, has c_custkey == $top, has name $n; select $s, $n;", rows)


def given_things(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("x"))
    return query(spark, tables.catalog(), tables.store(spark, sf_dir), "given $x: nation; match residence (resident: $p, place: $x); $x has n_name $n; reduce $k = count groupby $n;", rows)


def given_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of two types, each row with its type."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("x"), F.explode(F.array(F.lit("supplier"), F.lit("customer"))).alias("x#t"))
    return query(spark, tables.catalog(), tables.store(spark, sf_dir), "given $x: party; match $x isa! $t; $x has name $n; select $t, $n;", rows)


def given_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances with a key of two columns, as another query gives them."""
    catalog, store = tables.catalog(), tables.store(spark, sf_dir)
    rows = query(spark, catalog, store, "match $u isa utterance, has turn 1; select $u;").withColumnRenamed("u", "x")
    return query(spark, catalog, store, "given $x: utterance; match reply (prev: $y, next: $x); $y has said $s; $x has conv_id $c; select $c, $s;", rows)


def _then(text: str, *columns: str):
    """Columns of a query's result as SQL expressions: lists and decimals as what any comparison takes."""

    def run_then(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, tables.catalog(), tables.store(spark, sf_dir), text).selectExpr(*columns)

    return run_then


#: name: (query, SQL) of results that are put into another form first.
SHAPED = {
    "fetch_list": (
        _then('match $n isa nation, has n_name $x; fetch { "nation": $x, "names": [ $n.n_name ], "keys": [ match residence (resident: $p, place: $n); $p isa supplier, has s_suppkey $k; return { $k }; ] };', "nation", "array_join(names, '|') AS names", "array_join(sort_array(keys), '|') AS keys"),
        "SELECT n_name AS nation, n_name AS names, coalesce((SELECT string_agg(s_suppkey::VARCHAR, '|' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '') AS keys FROM nation",
    ),
    "fetch_documents": (
        _then('match $r isa region, has r_name $x; fetch { "region": $x, "nations": [ match location (inner: $n, outer: $r); $n has n_name $y; sort $y; fetch { "name": $y, "key": $n.n_nationkey }; ] };', "region", "array_join(transform(array_sort(transform(nations, d -> struct(d.name, d.key))), d -> concat(d.name, '=', d.key)), '|') AS nations"),
        "SELECT r_name AS region, (SELECT string_agg(n_name || '=' || n_nationkey, '|' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) AS nations FROM region",
    ),
    "fetch_nested": (_then('match $c isa customer, has c_custkey $k; fetch { "a": { "b": { "key": $k, "name": $c.name } }, "all": { $c.* } };', "a.b.key AS k", "a.b.name AS n", "all.c_mktsegment AS s"), "SELECT c_custkey AS k, c_name AS n, c_mktsegment AS s FROM customer"),
    "let_decimal": (_then("match $p isa part, has p_partkey $k, has p_size $s; let $x = $s * 1.25dec; let $y = $x + 0.05dec; let $z = $y - 3; select $k, $y, $z;", "k", "CAST(y * 100 AS BIGINT) AS y", "CAST(z * 100 AS BIGINT) AS z"), "SELECT p_partkey AS k, p_size::BIGINT * 125 + 5 AS y, p_size::BIGINT * 125 + 5 - 300 AS z FROM part"),
    "let_decimal_division": (_then("match $p isa part, has p_partkey $k, has p_size $s; let $x = ($s + 0.5dec) / 4; select $k, $x;", "k", "x"), "SELECT p_partkey AS k, (p_size + 0.5) / 4.0 AS x FROM part"),
    "reduce_decimal": (_then("match $p isa part, has p_brand $b, has p_size $s; let $x = $s * 0.5dec; reduce $t = sum($x), $m = max($x), $d = median($x) groupby $b;", "b", "CAST(t * 2 AS BIGINT) AS t", "CAST(m * 2 AS BIGINT) AS m", "CAST(d * 4 AS BIGINT) AS d"), "SELECT p_brand AS b, sum(p_size)::BIGINT AS t, max(p_size)::BIGINT AS m, CAST(median(p_size) * 2 AS BIGINT) AS d FROM part GROUP BY 1"),
    "let_between": (_then("match $o isa order, has o_orderkey $k, has o_orderdate $d; let $e = $d + P40D; let $x = $e - $d; select $k, $x;", "k", "x.months * 31L + x.days >= 39 AS ok"), "SELECT o_orderkey AS k, true AS ok FROM orders"),
    "let_duration_sum": (_then("match $o isa order, has o_orderkey $k, has o_orderdate $d; let $s = P1M + P2DT3H; let $e = $d + $s; let $f = $e - PT3H; select $k, $f;", "k", "f"), "SELECT o_orderkey AS k, o_orderdate + INTERVAL 1 MONTH + INTERVAL 2 DAY AS f FROM orders"),
    "let_list_slice": (_then("match $p isa part, has p_partkey $k, has p_size $s; let $l = [$s, $k, 7]; let $m = $l[1..3]; let $x = $m[0]; select $k, $x;", "k", "x"), "SELECT p_partkey AS k, p_partkey AS x FROM part"),
    "fun_tuple": (_then("with fun spread($n: nation) -> integer, double: match residence (resident: $p, place: $n); $p has acctbal $b; return count($p), max($b); match $n isa nation, has n_name $x; let $k, $m = spread($n); select $x, $k, $m;", "x", "k", "m"), "SELECT n_name AS x, count(*) AS k, max(b) AS m FROM nation JOIN (SELECT c_nationkey AS z, c_acctbal AS b FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) ON z = n_nationkey GROUP BY 1"),
    "iid_composite": (_then("match $u isa utterance, has conv_id $c, has turn $t; let $i = iid($u); select $c, $t, $i;", "c", "t", "substr(i, 7) AS h"), "SELECT conv_id AS c, turn AS t, md5('{' || conv_id || ', ' || turn || '}') AS h FROM conversations"),
    "meta_edges": (_then('match $t label supplier; $a label s_suppkey; $r label line-item:vendor; $u label party; let $x = get_owns_meta("unit", $t, $a); let $y = get_plays_meta("since", $t, $r); let $z = get_sub_meta("does", $t, $u); select $x, $y, $z;', "x", "y", "z"), "SELECT 'number' AS x, '1992' AS y, 'sells' AS z"),
    "meta_edges_all": (_then("match $t label supplier; $a label s_suppkey; $r label line-item:vendor; $u label party; let $k, $v in get_owns_all_meta($t, $a); let $l, $w in get_plays_all_meta($t, $r); let $m, $x in get_sub_all_meta($t, $u); select $k, $v, $l, $w, $m, $x;", "k", "v", "l", "w", "m", "x"), "SELECT 'unit' AS k, 'number' AS v, 'since' AS l, '1992' AS w, 'does' AS m, 'sells' AS x"),
    "meta_relates_all": (_then("match $t label placement; $r label placement:buyer; let $k, $v in get_relates_all_meta($t, $r); select $k, $v;", "k", "v"), "SELECT 'k' AS k, 'v' AS v"),
    "meta_fun_key": (_then('with fun one() -> integer @meta("a", "b"): match let $x = 1; return first $x; match let $m = get_fun_meta("a", "one"); let $o = one(); select $m, $o;', "m", "o"), "SELECT 'b' AS m, 1::BIGINT AS o"),
}


SALES = """define
attribute id value integer; attribute number value integer; attribute title value string; attribute state value string;
entity person, owns id @key, owns title, plays purchase:buyer; entity sale, owns number @key, owns state, plays purchase:thing;
relation purchase, relates buyer @card(0..1), relates thing @card(0..1);"""
_PEOPLE = "given $k: integer, $n: string; insert $p isa person, has id == $k, has title == $n;"
_BOUGHT = 'given $o: integer, $c: integer; match $p isa person, has id == $c; insert $s isa sale, has number == $o, has state "new"; purchase (buyer: $p, thing: $s);'


def _written(ask: str, *writes: str):
    """Customers and orders written to edge tables, then changed by `writes`, checked as a commit is, then asked."""

    def run_all(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = Catalog.of(SALES)
        store = EdgeStore(spark, catalog, {})
        writer = Writer(Compiler(spark, catalog, store), store)
        people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"))
        bought = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"))
        for text in (_PEOPLE, _BOUGHT, *writes):
            run(writer.c, parsed(text), people if "$n:" in text else bought, writer)
        writer.clean()
        writer.validate()
        return query(spark, catalog, store, ask)

    return run_all


WRITES = {
    "write_insert": (_written("match $p isa person, has id $k, has title $n; select $k, $n;"), "SELECT c_custkey AS k, c_name AS n FROM customer"),
    "write_links": (_written("match $r isa purchase, links (buyer: $p, thing: $s); $p has id $k; reduce $n = count groupby $k;"), "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1"),
    "write_put": (
        _written("match $p isa person, has id $k, has title $n; select $k, $n;", "match $p isa person, has id $k; let $m = $k % 2; $m == 0; delete $p;", "given $k: integer, $n: string; put $p isa person, has id == $k, has title == $n;"),
        "SELECT c_custkey AS k, c_name AS n FROM customer",
    ),
    "write_delete_links": (_written("match $r isa purchase; not { $r links (buyer: $p); }; reduce $n = count;", "match $r isa purchase, links (buyer: $p); $p has id $k; $k < 50; delete links ($p) of $r;"), "SELECT count(*) AS n FROM orders WHERE o_custkey < 50"),
    "write_update_links": (_written("match $r isa purchase, links (buyer: $p); $p has id $k; reduce $n = count groupby $k;", "match $p isa person, has id 1; $r isa purchase, links (buyer: $q, thing: $s); $s has number $o; let $m = $o % 4; $m == 0; update $r links (buyer: $p);"), "SELECT CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE o_custkey END AS k, count(*) AS n FROM orders GROUP BY 1"),
    "write_delete_try": (_written("match $s isa sale; try { $s has state $t; }; reduce $n = count, $m = count($t);", "match $s isa sale, has number $o; try { $s has state $t; $o < 90; }; delete try { has $t of $s; };"), "SELECT count(*) AS n, count(*) FILTER (o_orderkey >= 90) AS m FROM orders"),
    "write_update": (_written("match $s isa sale, has state $t; reduce $n = count groupby $t;", 'match $s isa sale, has number $o; let $m = $o % 3; $m == 0; update $s has state "done";'), "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'new' END AS t, count(*) AS n FROM orders GROUP BY 1"),
    "write_delete": (_written("match $r isa purchase; try { $r links (buyer: $p); $p has id $k; }; reduce $n = count, $m = count($k);", "match $p isa person, has id $k; let $m = $k % 2; $m == 0; delete $p;"), "SELECT count(*) AS n, count(*) FILTER (o_custkey % 2 = 1) AS m FROM orders"),
    "write_delete_orphans": (_written("match $r isa purchase; reduce $n = count;", "match $p isa person, has id $k; let $m = $k % 2; $m == 0; delete $p;", "match $s isa sale, has number $o; let $m = $o % 2; $m == 0; delete $s;"), "SELECT count(*) AS n FROM orders WHERE o_custkey % 2 = 1 OR o_orderkey % 2 = 1"),
    "write_delete_has": (_written("match $s isa sale, has number $o; not { $s has state $t; }; reduce $n = count;", 'match $s isa sale, has state $t, has number $o; $o < 100; delete has $t of $s;'), "SELECT count(*) AS n FROM orders WHERE o_orderkey < 100"),
}

QUERIES = {name: _text(text) for name, (text, _) in TEXTS.items()} | {name: f for name, (f, _) in SHAPED.items()} | {"given_rows": given_rows, "given_things": given_things, "given_party": given_party, "given_turns": given_turns} | {name: f for name, (f, _) in WRITES.items()}

SQL = {name: sql for name, (_, sql) in [*TEXTS.items(), *SHAPED.items()] if sql} | {
    "given_party": "SELECT 'supplier' AS t, s_name AS n FROM supplier UNION ALL SELECT 'customer', c_name FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)",
    "given_turns": "SELECT b.conv_id AS c, a.text AS s FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE b.turn = 1",
    "given_rows": "SELECT c_mktsegment AS s, c_name AS n FROM customer WHERE (c_mktsegment, c_custkey) IN (SELECT c_mktsegment, max(c_custkey) FROM customer GROUP BY 1)",
    "given_things": TEXTS["links_polymorphic"][1].replace("AS x", "AS n").replace("AS c FROM nation", "AS k FROM nation").replace("AS k FROM customer", "AS z FROM customer").replace("ON k =", "ON z ="),
} | {name: sql for name, (_, sql) in WRITES.items()}


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["flagship"](spark, "/root/testdata/sf0.001")
