"""The registered queries over the driver's tables, and the SQL that mirrors each.

``DIALECT`` holds pairs of a statement of this engine and of ANSI SQL;
``FRAMES`` those that use the operator layer directly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import sketches
from .operators import joins, relational
from .sources.catalog import scratch_root

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def engine(spark: SparkSession, sf_dir: str, stored: bool = False) -> Engine:
    made = Engine(spark, scratch_root(spark, "engine") if stored else None)
    for t in TABLES:
        made.attach(t, lambda t=t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    return made


_STAR = "lineitem, orders, customer, supplier, nation"
_STAR_ON = "l_orderkey = o_orderkey and o_custkey = c_custkey and l_suppkey = s_suppkey and s_nationkey = n_nationkey"

#: The whole of part as two polynomials by size, summed by power before they are multiplied.
_POLY_A = "(select p_size, sum(p_size) from part group by p_size) a(id, a0)"
_POLY_B = "(select p_size, count(*) from part group by p_size) b(id, a0)"

#: name: (statement of the dialect, ANSI SQL)
DIALECT: dict[str, tuple[str, str]] = {
    "scan_project": ("select o_orderkey, o_totalprice as price from orders;", "SELECT o_orderkey, o_totalprice AS price FROM orders"),
    "star_project": ("select * from nation;", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"),
    "filter_pred": ("select l_orderkey, l_linenumber from lineitem where l_quantity < 10 and l_discount > 0.05;", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_quantity < 10 AND l_discount > 0.05"),
    "filter_and_or": ("select o_orderkey from orders where o_custkey < 100 or o_orderkey > 500 and o_orderpriority = '1-URGENT';", "SELECT o_orderkey FROM orders WHERE (o_custkey < 100 OR o_orderkey > 500) AND o_orderpriority = '1-URGENT'"),
    "filter_not": ("select o_orderkey from orders where not (o_custkey < 700) and not 0;", "SELECT o_orderkey FROM orders WHERE NOT (o_custkey < 700)"),
    "filter_integer": ("select o_orderkey from orders where o_orderkey % 3;", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0"),
    "int_arith": ("select o_orderkey, o_orderkey * 3 - o_custkey / 7 as a, -o_orderkey + 5 as b from orders;", "SELECT o_orderkey, o_orderkey * 3 - o_custkey // 7 AS a, -o_orderkey + 5 AS b FROM orders"),
    "int_overflow": ("select n_nationkey, n_nationkey + 9223372036854775807 as a from nation where n_nationkey < 3;", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(CASE WHEN n_nationkey = 0 THEN 9223372036854775807 ELSE -9223372036854775808 + (n_nationkey - 1) END AS BIGINT) AS a FROM nation WHERE n_nationkey < 3"),
    "float_arith": ("select p_partkey, p_retailprice * 2 + 1 as a, p_retailprice / 4 as b from part;", "SELECT p_partkey, p_retailprice * 2 + 1 AS a, p_retailprice / 4 AS b FROM part"),
    "float_by_zero": ("select p_partkey, 1.0 / (p_size - p_size) as a from part;", "SELECT p_partkey, CAST('inf' AS DOUBLE) AS a FROM part"),
    "mixed_arith": ("select p_partkey, p_size + 0.5 as a, p_size > 10.5 as b from part;", "SELECT p_partkey, CAST(p_size AS DOUBLE) + 0.5 AS a, CAST(p_size > 10.5 AS BIGINT) AS b FROM part"),
    "bit_ops": ("select o_orderkey, o_orderkey & 12 as a, o_orderkey | 5 as b, o_orderkey ^ 9 as c from orders;", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 5 AS b, xor(o_orderkey, 9) AS c FROM orders"),
    "shift_ops": ("select o_orderkey, o_orderkey << 3 as a, o_orderkey >> 2 as b from orders;", "SELECT o_orderkey, o_orderkey * 8 AS a, o_orderkey // 4 AS b FROM orders"),
    "mod_signed": ("select o_orderkey, (500 - o_orderkey) % 7 as a, (500 - o_orderkey) / 7 as b from orders;", "SELECT o_orderkey, (500 - o_orderkey) % 7 AS a, CAST(trunc((500 - o_orderkey) / 7) AS BIGINT) AS b FROM orders"),
    "cmp_as_int": ("select o_orderkey, (o_custkey > 50) + (o_orderkey <> 3) as a, 1 = 2 < 3 as b from orders;", "SELECT o_orderkey, CAST(o_custkey > 50 AS BIGINT) + CAST(o_orderkey <> 3 AS BIGINT) AS a, CAST(1 AS BIGINT) AS b FROM orders"),
    "precedence": ("select n_nationkey, 1 or n_nationkey > 3 and 0 as a, n_nationkey | 1 ^ 3 & 2 as b, not 1 < 2 as c from nation;", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(0 AS BIGINT) AS a, CAST(n_nationkey | 3 AS BIGINT) AS b, CAST(1 AS BIGINT) AS c FROM nation"),
    "string_cmp": ("select c_custkey, c_mktsegment < 'C' as a from customer where c_mktsegment >= 'B';", "SELECT c_custkey, CAST(c_mktsegment < 'C' AS BIGINT) AS a FROM customer WHERE c_mktsegment >= 'B'"),
    "values_source": ("select t.x + 1 as a, y as b, z as c from (values (1, 'a', 1.), (2, 'b', 2)) t(x, y, z);", "SELECT CAST(x + 1 AS BIGINT) AS a, y AS b, CAST(z AS DOUBLE) AS c FROM (VALUES (1, 'a', 1.0), (2, 'b', 2.0)) t(x, y, z)"),
    "const_select": ("select 1 + 2 * 3 as a, 2 * 5 / -10 as b, -----5--6 as c, 'x' as d;", "SELECT CAST(7 AS BIGINT) AS a, CAST(-1 AS BIGINT) AS b, CAST(1 AS BIGINT) AS c, 'x' AS d"),
    "subquery_from": ("select a * 2 as b from (select o_orderkey + 1 as a from (select o_orderkey from orders where o_custkey < 500));", "SELECT (o_orderkey + 1) * 2 AS b FROM orders WHERE o_custkey < 500"),
    "alias_columns": ("select k, v from region r(k, v);", "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS v FROM region"),
    "cross_join": ("select n_name, r_name from nation, region;", "SELECT n_name, r_name FROM nation, region"),
    "theta_join": ("select s_suppkey, n_nationkey from supplier join nation on s_suppkey < n_nationkey and s_nationkey <> n_nationkey;", "SELECT s_suppkey, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM supplier JOIN nation ON s_suppkey < n_nationkey AND s_nationkey <> n_nationkey"),
    "equi_join": ("select o_orderkey, c_name from orders inner join customer on o_custkey = c_custkey;", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "multi_key_join": ("select count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber;", "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber"),
    "expr_key_join": ("select a.o_orderkey as x, b.o_orderkey as y from orders a, orders b where a.o_orderkey * 2 = b.o_orderkey - 1;", "SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM orders a, orders b WHERE a.o_orderkey * 2 = b.o_orderkey - 1"),
    "string_key_join": ("select p.p_partkey, q.n as n from part p, (select p_brand as brand, count(*) as n from part group by p_brand) q where p.p_brand = q.brand;", "SELECT p.p_partkey, q.n FROM part p JOIN (SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY p_brand) q ON p.p_brand = q.brand"),
    "int_float_join": ("select o_orderkey, v from orders, (values (1.), (2.5), (7.)) t(v) where o_orderkey = v;", "SELECT o_orderkey, v FROM orders JOIN (VALUES (1.0::DOUBLE), (2.5::DOUBLE), (7.0::DOUBLE)) t(v) ON CAST(o_orderkey AS DOUBLE) = v"),
    "join_alias": ("select t.x as x, t.region as y from (nation join region on n_regionkey = r_regionkey) t(x, name, k, rk, region) where t.k > 1;", "SELECT CAST(n_nationkey AS BIGINT) AS x, r_name AS y FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey > 1"),
    "self_join": ("select a.n_name as x, b.n_name as y from nation a, nation b where a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey;", "SELECT a.n_name AS x, b.n_name AS y FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "star_join5": (f"select n_name, count(*) as n, sum(l_linenumber) as s from {_STAR} where {_STAR_ON} group by n_name;", f"SELECT n_name, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM {_STAR} WHERE {_STAR_ON} GROUP BY n_name"),
    "paren_join": ("select count(*) as n from (orders join customer on o_custkey = c_custkey) join (nation join region on n_regionkey = r_regionkey) on c_nationkey = n_nationkey where r_name < 'B';", "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name < 'B'"),
    "global_agg": ("select count(*) as n, sum(o_orderkey) as s, min(o_totalprice) as lo, max(o_totalprice) as hi, avg(o_custkey) as m from orders;", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_custkey) AS m FROM orders"),
    "group_agg": ("select l_returnflag, l_linestatus, count(*) as n, sum(l_linenumber) as s, min(l_quantity) as lo, max(l_extendedprice) as hi from lineitem group by l_returnflag, l_linestatus;", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_quantity) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "group_expr": ("select o_orderkey % 7 as k, count(*) as n from orders group by o_orderkey % 7;", "SELECT o_orderkey % 7 AS k, count(*) AS n FROM orders GROUP BY 1"),
    "group_const": ("select count(*) as n, sum(o_custkey) as s from orders group by 1, 'x';", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders"),
    "group_no_agg": ("select c_mktsegment from customer group by c_mktsegment;", "SELECT DISTINCT c_mktsegment FROM customer"),
    "having": ("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12 and sum(o_orderkey) > 5;", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_orderkey) > 5"),
    "agg_expr": ("select p_brand, sum(p_size) + max(p_size) * 2 as a, max(p_retailprice) / (min(p_retailprice) + 1.) as b from part group by p_brand;", "SELECT p_brand, CAST(sum(p_size) + max(p_size) * 2 AS BIGINT) AS a, max(p_retailprice) / (min(p_retailprice) + 1.0) AS b FROM part GROUP BY p_brand"),
    "agg_bool_sum": ("select o_orderpriority, sum(o_totalprice > 100000) as n from orders group by o_orderpriority;", "SELECT o_orderpriority, CAST(sum(CAST(o_totalprice > 100000 AS BIGINT)) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority"),
    "bare_column_first": ("select n_regionkey as k, r_name as v, count(*) as n from nation, region where n_regionkey = r_regionkey group by n_regionkey;", "SELECT CAST(n_regionkey AS BIGINT) AS k, any_value(r_name) AS v, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey"),
    "order_multi": ("select o_orderpriority, o_orderkey from orders order by o_orderpriority asc, o_orderkey desc limit 50;", "SELECT o_orderpriority, o_orderkey FROM orders ORDER BY o_orderpriority ASC, o_orderkey DESC LIMIT 50"),
    "order_expr": ("select o_orderkey from orders order by (o_orderkey - 50) % 7 asc, o_orderkey ^ 5 desc limit 40;", "SELECT o_orderkey FROM orders ORDER BY (o_orderkey - 50) % 7 ASC, xor(o_orderkey, 5) DESC LIMIT 40"),
    "topk": ("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey asc limit 10;", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "limit_offset": ("select o_orderkey from orders order by o_orderkey asc limit 1+9 offset 15;", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 15"),
    "limit_past_end": ("select r_name from region order by r_name asc limit 3 offset 100;", "SELECT r_name FROM region LIMIT 0"),
    "limit_subquery": ("select count(*) as n from (select o_orderkey from orders order by o_orderkey asc limit 20) where o_orderkey > 10;", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20) WHERE o_orderkey > 10"),
    "order_by_agg": ("select o_custkey, count(*) as n from orders group by o_custkey order by count(*) desc, o_custkey asc limit 5;", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 5"),
    "distinct": ("select distinct l_returnflag, l_linestatus from lineitem;", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "distinct_order": ("select distinct c_mktsegment from customer order by c_mktsegment desc;", "SELECT DISTINCT c_mktsegment FROM customer"),
    "distinct_order_hidden": ("select distinct c_mktsegment from customer order by c_custkey asc limit 3;", "SELECT c_mktsegment FROM (SELECT c_mktsegment, min(c_custkey) AS k FROM customer GROUP BY 1) ORDER BY k LIMIT 3"),
    "poly_two_level": (f"select id2 as d, sum(val2) as s from (select c.id + b.id, c.val * b.a0 from {_POLY_B}, (select id, sum(val) from (select a.id + b.id, a.a0 * b.a0 from {_POLY_A}, {_POLY_B}) _(id, val) group by id) c(id, val)) _(id2, val2) group by id2;", "WITH a AS (SELECT p_size AS id, sum(p_size) AS v FROM part GROUP BY 1), b AS (SELECT p_size AS id, count(*) AS n FROM part GROUP BY 1) SELECT CAST(a.id + b.id + c.id AS BIGINT) AS d, CAST(sum(a.v * b.n * c.n) AS BIGINT) AS s FROM a, b, b c GROUP BY 1"),
    "job_like_q1": (f"select count(*) as n from {_STAR}, region, part where {_STAR_ON} and n_regionkey = r_regionkey and l_partkey = p_partkey and r_name < 'B' and p_size > 20;", f"SELECT count(*) AS n FROM {_STAR}, region, part WHERE {_STAR_ON} AND n_regionkey = r_regionkey AND l_partkey = p_partkey AND r_name < 'B' AND p_size > 20"),
    "job_like_q2": ("select count(*) as n from customer c, nation n1, supplier s, nation n2, region r where c.c_nationkey = n1.n_nationkey and s.s_nationkey = n2.n_nationkey and n1.n_regionkey = r.r_regionkey and n2.n_regionkey = r.r_regionkey and c.c_acctbal > 5000 and s.s_acctbal < 5000;", "SELECT count(*) AS n FROM customer c, nation n1, supplier s, nation n2, region r WHERE c.c_nationkey = n1.n_nationkey AND s.s_nationkey = n2.n_nationkey AND n1.n_regionkey = r.r_regionkey AND n2.n_regionkey = r.r_regionkey AND c.c_acctbal > 5000 AND s.s_acctbal < 5000"),
    "job_like_q3": ("select count(*) as n, min(e.value) as lo from events e, customer c, nation n where e.user_id = c.c_custkey and c.c_nationkey = n.n_nationkey and e.event_type = 'purchase' and n.n_regionkey < 3;", "SELECT count(*) AS n, min(e.value) AS lo FROM events e, customer c, nation n WHERE e.user_id = c.c_custkey AND c.c_nationkey = n.n_nationkey AND e.event_type = 'purchase' AND n.n_regionkey < 3"),
    "job_like_q4": ("select p_brand, count(*) as n from lineitem, part, supplier where l_partkey = p_partkey and l_suppkey = s_suppkey and s_acctbal > 0 and p_retailprice < 1500 group by p_brand;", "SELECT p_brand, count(*) AS n FROM lineitem, part, supplier WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND s_acctbal > 0 AND p_retailprice < 1500 GROUP BY p_brand"),
}
#: Statements run with the optimizer's options: joins reordered by cost, inputs reduced by predicate transfer.
ORDERED = {"join_reorder_dp": ("job_like_q1", True, False), "pred_transfer_star": ("job_like_q1", False, True), "pred_transfer_tree": ("job_like_q2", True, True)}


def _dialect(sql: str, cost_based: bool = False, transfer: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        e.options.cost_based, e.options.transfer = cost_based, transfer
        return e.frame(sql)

    return run


def flagship_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pricing summary: quantities and prices by flag and status, in exact cents."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return items.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), F.sum(cents).alias("sum_cents"), F.max("l_discount").alias("max_discount"), F.count(F.lit(1)).alias("n"))


def _strategy(strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nation, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "supplier"))
        joined = joins.join_with(supplier, nation, F.col("s_nationkey") == F.col("n_nationkey"), strategy)
        return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))

    return run


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")


def _changed(*statements: str, result: str = "select k, v, w from t;") -> Callable[[SparkSession, str], DataFrame]:
    """The state of a stored table after statements."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, stored=True)
        e.execute("create table t(k int64 primary key, v varchar(30), w int64);")
        e.execute("insert into t select c_custkey, c_mktsegment, c_nationkey from customer;")
        for s in statements:
            e.execute(s)
        return e.frame(result)

    return run


_T = "SELECT c_custkey AS k, c_mktsegment AS v, CAST(c_nationkey AS BIGINT) AS w FROM customer"


def pk_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether inserts keep a primary key: repeated in the new rows, repeating an old one, and neither."""
    e = engine(spark, sf_dir, stored=True)
    e.execute("create table t(k int64 primary key, v int64);")
    tried = {
        "repeats": "insert into t select l_orderkey, l_linenumber from lineitem;",
        "fits": "insert into t select o_orderkey, o_custkey from orders;",
        "meets": "insert into t select max(o_orderkey), 1 from orders;",
        "beside": "insert into t select max(o_orderkey) + 1, 1 from orders;",
    }
    done = [(name, e.attempt(sql).valid()) for name, sql in tried.items()]
    return spark.createDataFrame([(n, ok, k) for (n, ok) in done for k in [e.execute("select count(*) from t;").rows()[0][0]]], "name string, ok boolean, n long")


def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether changes keep a foreign key: events of all users, of the customers stored, and deletes of referenced and other customers."""
    e = engine(spark, sf_dir, stored=True)
    e.execute("create table c(k int64 primary key);")
    e.execute("insert into c select c_custkey from customer where c_acctbal > 0;")
    e.execute("create table ev(id int64, u int64 foreign key references c(k));")
    tried = {
        "all": "insert into ev select event_id, user_id from events;",
        "known": "insert into ev select event_id, user_id from events, c where user_id = k;",
        "used": "delete from c where 1;",
        "unused": "delete from c where k < 0;",
    }
    done = [(name, e.attempt(sql).valid()) for name, sql in tried.items()]
    n = e.execute("select count(*) from ev;").rows()[0][0]
    return spark.createDataFrame([(name, ok, n) for name, ok in done], "name string, ok boolean, n long")


def analyze_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every column of orders as text; whether the estimate of distinct values is within 10 % of the true number."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = sketches.analyze(orders)
    true = orders.agg(*[F.countDistinct(c).alias(c) for c in found.columns]).first()
    kinds = dict(orders.dtypes)
    rows = [(c, found.rows, str(s.low) if kinds[c] in ("bigint", "string") else None, str(s.high) if kinds[c] in ("bigint", "string") else None, abs(s.distinct - true[c]) <= max(1, 0.1 * true[c])) for c, s in found.columns.items()]
    return spark.createDataFrame(rows, "name string, n long, lo string, hi string, close boolean")


def contest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 customers with the greatest sums, and how many of all customers have at least that sum."""
    sums = engine(spark, sf_dir).frame("select o_custkey as id, sum(o_orderkey) as s from orders group by o_custkey;")
    return relational.rank_above(sums, "s", "above").orderBy("above", "id").limit(20)


def cms_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of every customer, whether the estimate is never below them, and whether it is within the error of all orders."""
    orders = _orders(spark, sf_dir)
    true = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    found = sketches.frequencies(orders, "o_custkey", true.select(F.col("o_custkey").alias("v")), error=0.001)
    all_of = orders.agg(F.count(F.lit(1)).alias("all"))
    both = true.join(found, F.col("o_custkey") == F.col("v")).join(all_of)
    return both.select("o_custkey", "n", (F.col("estimate") >= F.col("n")).alias("covers"), (F.col("estimate") <= F.col("n") + 0.01 * F.col("all")).alias("close"))


def hll_ndv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct customers of all orders, and whether the estimate is within 10 % of them."""
    orders = _orders(spark, sf_dir)
    true, found = orders.agg(F.countDistinct("o_custkey").alias("n")).first()["n"], sketches.distinct_sketch(orders, "o_custkey")
    return spark.createDataFrame([(true, abs(found - true) <= 0.1 * true)], "n long, close boolean")


def bloom_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a third of the customers by a semi-join, tested before by a Bloom filter that loses none of them."""
    events, customers = spark.read.parquet(f"{sf_dir}/events.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 6000")
    left = joins.predicate_transfer([customers.select("c_custkey"), events.select("event_id", "user_id")], [joins.Edge(0, "c_custkey", 1, "user_id")], [0, 1], rows=[float(customers.count()), 1.0])
    return left[1].join(left[0], F.col("user_id") == F.col("c_custkey"), "left_semi")


FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "flagship_pricing": (flagship_pricing, "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sum_cents, max(l_discount) AS max_discount, count(*) AS n FROM lineitem GROUP BY ALL"),
    **{f"{k}_hint": (_strategy(s), "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name") for k, s in (("smj", "merge"), ("shj", "shuffle_hash"), ("bhj", "broadcast"), ("nlj", "nested_loop"))},
    "range_scan_pk": (lambda s, d: relational.range_scan(_orders(s, d), "o_orderkey", 100, 900, high_closed=True), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 900"),
    "point_lookup": (lambda s, d: relational.point_lookup(_orders(s, d), "o_orderkey", 77), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77"),
    "insert_select": (_changed("insert into t select k + 1000000, v, w from t where k % 2 = 0;"), f"WITH t AS ({_T}) SELECT * FROM t UNION ALL SELECT k + 1000000, v, w FROM t WHERE k % 2 = 0"),
    "delete_where": (_changed("delete from t where w < 10;"), f"WITH t AS ({_T}) SELECT * FROM t WHERE NOT w < 10"),
    "update_where": (_changed("update t set w = w * 2 + 1, v = 'none' where k % 3 = 0;"), f"WITH t AS ({_T}) SELECT k, CASE WHEN k % 3 = 0 THEN 'none' ELSE v END AS v, CASE WHEN k % 3 = 0 THEN w * 2 + 1 ELSE w END AS w FROM t"),
    "update_from": (_changed("update t set v = n_name, w = n_regionkey from nation where t.w = n_nationkey and n_regionkey > 1;"), f"WITH t AS ({_T}) SELECT k, coalesce(n_name, v) AS v, coalesce(CAST(n_regionkey AS BIGINT), w) AS w FROM t LEFT JOIN nation ON w = n_nationkey AND n_regionkey > 1"),
    "pk_dup_check": (pk_duplicates, "SELECT name, ok, (SELECT CAST(count(*) + 1 AS BIGINT) FROM orders) AS n FROM (SELECT 'repeats' AS name, (SELECT count(*) = count(DISTINCT l_orderkey) FROM lineitem) AS ok UNION ALL SELECT 'fits', (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders) UNION ALL SELECT 'meets', false UNION ALL SELECT 'beside', true)"),
    "fk_violation_check": (fk_violations, "WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), s AS (SELECT count(*) AS every, count(*) FILTER (user_id IN (SELECT k FROM c)) AS known FROM events) SELECT name, ok, CAST(known + CASE WHEN every = known THEN every ELSE 0 END AS BIGINT) AS n FROM (SELECT 'all' AS name, every = known AS ok, s.* FROM s UNION ALL SELECT 'known', true, s.* FROM s UNION ALL SELECT 'used', known = 0, s.* FROM s UNION ALL SELECT 'unused', true, s.* FROM s)"),
    "analyze_stats": (analyze_stats, "WITH o AS (SELECT count(*) AS n FROM orders) SELECT 'o_orderkey' AS name, n, (SELECT CAST(min(o_orderkey) AS VARCHAR) FROM orders) AS lo, (SELECT CAST(max(o_orderkey) AS VARCHAR) FROM orders) AS hi, true AS close FROM o UNION ALL SELECT 'o_custkey', n, (SELECT CAST(min(o_custkey) AS VARCHAR) FROM orders), (SELECT CAST(max(o_custkey) AS VARCHAR) FROM orders), true FROM o UNION ALL SELECT 'o_orderstatus', n, (SELECT min(o_orderstatus) FROM orders), (SELECT max(o_orderstatus) FROM orders), true FROM o UNION ALL SELECT 'o_orderpriority', n, (SELECT min(o_orderpriority) FROM orders), (SELECT max(o_orderpriority) FROM orders), true FROM o UNION ALL SELECT unnest(['o_totalprice', 'o_orderdate']), n, NULL, NULL, true FROM o"),
    "contest_rank": (contest_rank, "WITH t AS (SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders GROUP BY 1), r AS (SELECT o_custkey AS id, s, CAST(count(*) OVER (ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS above FROM t) SELECT * FROM r ORDER BY above, id LIMIT 20"),
    "cms_freq": (cms_freq, "SELECT o_custkey, count(*) AS n, true AS covers, true AS close FROM orders GROUP BY o_custkey"),
    "hll_ndv": (hll_ndv, "SELECT count(DISTINCT o_custkey) AS n, true AS close FROM orders"),
    "bloom_semi": (bloom_semi, "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 6000)"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, (f, _) in FRAMES.items()}
    found |= {k: _dialect(sql) for k, (sql, _) in DIALECT.items()}
    return found | {k: _dialect(DIALECT[q][0], c, t) for k, (q, c, t) in ORDERED.items()}


def oracle_sql() -> dict[str, str]:
    found = {k: sql for k, (_, sql) in FRAMES.items() if sql}
    return found | {k: sql for k, (_, sql) in DIALECT.items()} | {k: DIALECT[q][1] for k, (q, _, _) in ORDERED.items()}
