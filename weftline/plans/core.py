"""The queries that apply the record operators to the test tables, each with its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import values as V
from weftline.operators import aggregate as A
from weftline.operators import filters, keyed, nested, order, shape, stats, text
from weftline.pipeline import Pipeline
from weftline.sources import formats

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        _QUERIES[key] = fn
        if sql:
            _SQL[key] = sql
        return fn

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- flagship -------------------------------------------------------------------------------------

FLAGSHIP = Pipeline().acceptIf("l_quantity > ${least : 30}").add(revenue="l_extendedprice * (1 - l_discount)").summarize("l_returnflag,l_linestatus", total=A.sum_of("revenue"), n=A.rec_count()).bind()


@query("select l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) as total, count(*) as n from lineitem where l_quantity > 30 group by 1, 2")
def flagship_revenue(spark, sf):
    return order.head(order.sort(FLAGSHIP.run(t(spark, sf, "lineitem")), "-n,l_returnflag"), 100).withColumn("total", F.round("total", 2))


# --- filters and conditionals ---------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 30")
def accept_if(spark, sf):
    return filters.accept_if(t(spark, sf, "lineitem"), "l_quantity > 30").select("l_orderkey", "l_linenumber", "l_quantity")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where not coalesce(nullif(l_returnflag, 'N') = 'A', false)")
def reject_if(spark, sf):
    return filters.reject_if(t(spark, sf, "lineitem"), "nullif(l_returnflag, 'N') = 'A'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("select o_orderkey, case when o_totalprice > 200000 then 'large' else 'small' end as size, case when o_totalprice > 200000 then o_orderpriority end as priority from orders")
def if_else(spark, sf):
    df = t(spark, sf, "orders")
    big = Pipeline().add(size="'large'", priority="o_orderpriority").keep("o_orderkey,size,priority")
    return filters.if_(df, "o_totalprice > 200000", big, Pipeline().add(size="'small'").keep("o_orderkey,size"))


@query("select o_orderkey, case when not coalesce(nullif(o_orderstatus, 'P') = 'F', false) then 'open' end as state from orders")
def if_not(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return filters.if_not(df, "nullif(o_orderstatus, 'P') = 'F'", Pipeline().add(state="'open'")).drop("o_orderstatus")


@query("select o_orderkey, case when o_totalprice > 100000 then 'a' else 'b' end as cls from orders")
def choose(spark, sf):
    return filters.choose(t(spark, sf, "orders"), "o_totalprice > 100000", {"cls": "'a'"}, {"cls": "'b'"}).select("o_orderkey", "cls")


@query("select c_custkey, nullif(c_mktsegment, 'BUILDING') is null as is_sub, nullif(c_mktsegment, 'BUILDING') is not null as is_super from customer")
def field_sets(spark, sf):
    df = t(spark, sf, "customer").selectExpr("c_custkey", "nullif(c_mktsegment, 'BUILDING') as seg")
    return df.select("c_custkey", filters.fields_subset_of(df, "c_custkey").alias("is_sub"), filters.fields_superset_of(df, "c_custkey,seg").alias("is_super"))


# --- shaping --------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as revenue, l_quantity / nullif(l_tax, 0) as per_tax from lineitem")
def add_fields(spark, sf):
    return shape.add(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"), revenue="round(l_extendedprice * (1 - l_discount), 4)", per_tax="try_divide(l_quantity, l_tax)").select("l_orderkey", "l_linenumber", "revenue", "per_tax")


@query("select c_custkey, array_to_string(list_filter([c_name, nullif(c_mktsegment, 'BUILDING')], lambda x: x is not null), '|') as names from customer")
def add_instances(spark, sf):
    df = shape.add(t(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("names"), "c_mktsegment"), names="nullif(c_mktsegment, 'BUILDING')")
    return df.select("c_custkey", F.array_join("names", "|").alias("names"))


@query("select o_orderkey, o_orderstatus, o_orderdate from orders")
def keep_wildcard(spark, sf):
    return shape.keep(t(spark, sf, "orders"), "o_order+").drop("o_orderpriority")


@query("select o_orderkey, o_custkey, o_orderdate, o_orderpriority from orders")
def rm_fields(spark, sf):
    return shape.rm(t(spark, sf, "orders"), "o_totalprice,o_orderstatus")


@query("select o_orderkey as id, o_custkey as customer from orders")
def mv_fields(spark, sf):
    return shape.mv(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), o_orderkey="id", o_custkey="customer")


@query("select event_id, case when event_id % 2 = 0 then event_type end as event_type, case when event_id % 2 = 0 then 'user_kind' else 'event_type' end as ref, case when event_id % 2 = 0 then concat('u', user_id) else event_type end as picked, case when event_id % 2 = 1 then concat('u', user_id) end as user_kind from events")
def mv_indirect(spark, sf):
    df = t(spark, sf, "events").select("event_id", "event_type", F.concat(F.lit("u"), "user_id").alias("user_kind"), F.when(F.col("event_id") % 2 == 0, "user_kind").otherwise("event_type").alias("ref"))
    return shape.mv_ref(df, "ref", "picked")


@query("select c_custkey, concat_ws(' ', c_name, c_mktsegment) as both from customer")
def merge_fields(spark, sf):
    df = t(spark, sf, "customer").select("c_custkey", F.array("c_name", "c_mktsegment").alias("both"))
    return shape.merge(df, "both")


@query("select s_suppkey, s_name, s_acctbal from supplier")
def flatten_sub(spark, sf):
    return shape.flatten(t(spark, sf, "supplier").select("s_suppkey", F.struct("s_name", "s_acctbal").alias("sub")), "sub")


@query("select p_partkey, cast(trunc(p_size / 10.0) as bigint) * 10 as p_size from part", "bin_long")
def bin_long(spark, sf):
    return shape.bin_value(t(spark, sf, "part").select("p_partkey", "p_size"), "p_size", 10)


@query("select c_custkey, cast(trunc(c_acctbal / 1000.0) as bigint) * 1000 as c_acctbal from customer")
def bin_negative(spark, sf):
    return shape.bin_value(t(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 1000)


@query("select l_orderkey, l_linenumber, l_partkey, round(trunc(l_discount / 0.02) * 0.02, 6) as l_discount from lineitem")
def bin_small(spark, sf):
    return shape.bin_value(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount"), "l_discount", 0.02).withColumn("l_discount", F.round("l_discount", 6))


@query()
def hash_fields(spark, sf):
    return shape.hash_fields(t(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "h", "c_name,c_mktsegment", mod=1000)


@query("select page_id, nullif(regexp_extract(url, '^https?://([^/]+)/', 1), '') as host from pages")
def regex_anchored(spark, sf):
    return shape.regex(t(spark, sf, "pages").select("page_id", "url"), "url", r"^https?://(?<host>[^/]+)/").select("page_id", "host")


@query("select page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1)) as tag from pages")
def regex_children(spark, sf):
    df = shape.regex(t(spark, sf, "pages").select("page_id", "html"), "html", r"<(?<tag>[a-z0-9]+)[ >]")
    return shape.denorm(df.select("page_id", "child"), "child")


@query("select * from region")
def no_op(spark, sf):
    return shape.no_op(t(spark, sf, "region"))


@query("select * from nation")
def throttle(spark, sf):
    return shape.throttle(t(spark, sf, "nation"), 100000)


# --- keyed joins and filters ----------------------------------------------------------------------



def _customers(spark, sf) -> keyed.Keyed:
    """All customers, by twice their key: odd keys of orders and the upper half of the customers miss."""
    return keyed.map_by(t(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("o_custkey"), "c_name", "c_nationkey"), "o_custkey")


def _orders(spark, sf) -> DataFrame:
    return t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


_LEFT = "(select o_orderkey, o_custkey, o_totalprice from orders) l"
_RIGHT = "(select c_custkey * 2 as c_custkey, c_name, c_nationkey from customer) r on l.o_custkey = r.c_custkey"
for _how, _kind in (("left", "left"), ("inner", "inner"), ("right", "right"), ("outer", "full")):
    query(f"select o_orderkey, coalesce(o_custkey, c_custkey) as o_custkey, o_totalprice, c_name, c_nationkey from {_LEFT} {_kind} join {_RIGHT}", f"join_{_how}")(lambda spark, sf, how=_how: keyed.join(_orders(spark, sf), _customers(spark, sf), how))
query(f"select o_orderkey, o_custkey, o_totalprice, c_custkey is not null as known from {_LEFT} left join {_RIGHT}", "join_flag")(lambda spark, sf: keyed.join(_orders(spark, sf), _customers(spark, sf), "known"))
query(f"select l.* from {_LEFT} join {_RIGHT}", "filter_in")(lambda spark, sf: keyed.filter_by(_orders(spark, sf), _customers(spark, sf), "+"))
query(f"select l.* from {_LEFT} left join {_RIGHT} where c_custkey is null", "filter_out")(lambda spark, sf: keyed.filter_by(_orders(spark, sf), _customers(spark, sf), "-"))
query(f"select o_orderkey, o_custkey, o_totalprice from {_LEFT} join {_RIGHT} qualify row_number() over (partition by o_custkey order by o_orderkey) = 1", "filter_once")(lambda spark, sf: keyed.filter_by(_orders(spark, sf), _customers(spark, sf), "once"))


# the same over all orders and all customers; customers without orders miss
_ALL = "(select o_orderkey, o_custkey, o_totalprice from orders) l"
_ALL_RIGHT = "(select c_custkey, c_name, c_nationkey from customer) r on l.o_custkey = r.c_custkey"


def _whole(spark, sf) -> tuple[DataFrame, keyed.Keyed]:
    right = t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    return t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), keyed.map_by(right, "o_custkey")


for _how, _kind in (("left", "left"), ("inner", "inner"), ("right", "right"), ("outer", "full")):
    query(f"select o_orderkey, coalesce(o_custkey, c_custkey) as o_custkey, o_totalprice, c_name, c_nationkey from {_ALL} {_kind} join {_ALL_RIGHT}", f"join_{_how}_whole")(lambda spark, sf, how=_how: keyed.join(*_whole(spark, sf), how))
query(f"select o_orderkey, o_custkey, o_totalprice from {_ALL} join {_ALL_RIGHT} qualify row_number() over (partition by o_custkey order by o_orderkey) = 1", "filter_once_whole")(lambda spark, sf: keyed.filter_by(*_whole(spark, sf), "once"))


@query("select c_custkey, case when l <> r then l end as left_segment, case when l <> r then r end as right_segment, case when b <> c then b end as left_bal, case when b <> c then c end as right_bal from (select c_custkey, c_mktsegment as l, case when c_custkey % 5 = 0 then 'OTHER' else c_mktsegment end as r, c_acctbal as b, case when c_custkey % 7 = 0 then c_acctbal + 1 else c_acctbal end as c from customer) where l <> r or b <> c")
def filter_diff(spark, sf):
    left = t(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    right = left.selectExpr("c_custkey", "case when c_custkey % 5 = 0 then 'OTHER' else c_mktsegment end as c_mktsegment", "case when c_custkey % 7 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal")
    d = keyed.filter_by(left, keyed.map_by(right, "c_custkey"), "+diff")
    return d.select("c_custkey", F.col("LEFT.c_mktsegment").alias("left_segment"), F.col("RIGHT.c_mktsegment").alias("right_segment"), F.col("LEFT.c_acctbal").alias("left_bal"), F.col("RIGHT.c_acctbal").alias("right_bal"))


@query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1")
def map_first(spark, sf):
    return keyed.map_by(t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey").df


@query("select o_custkey, o_orderkey, o_totalprice from orders")
def group_denorm(spark, sf):
    g = keyed.group_by(t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey")
    return shape.denorm(g.df, "child")


@query("select c.c_custkey, o.o_orderkey from customer c left join (select * from orders where o_totalprice > 300000) o on o.o_custkey = c.c_custkey")
def denorm_keep_empty(spark, sf):
    g = keyed.group_by(t(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey")
    return shape.denorm(keyed.join(t(spark, sf, "customer").select("c_custkey"), g, "left"), "child", keep_empty=True)


# --- reducers, groups, distinct -------------------------------------------------------------------


@query("select count(*) as n, round(sum(l_quantity), 4) as qty, bool_or(l_discount > 0.09) as any_high, bool_and(l_quantity > 0) as all_pos from lineitem")
def reduce_main(spark, sf):
    return A.reduce_all(t(spark, sf, "lineitem"), n=A.rec_count(), qty=A.sum_of("l_quantity"), any_high=A.any_of("l_discount > 0.09"), all_pos=A.all_of("l_quantity > 0")).withColumn("qty", F.round("qty", 4))


@query("select o_custkey, count(*) as n, round(sum(o_totalprice), 4) as total, cast(round(sum(o_totalprice)) as bigint) as whole, bool_or(o_orderstatus = 'F') as any_f, bool_and(o_orderstatus = 'F') as all_f, string_agg(o_orderpriority, ' ' order by o_orderpriority) as priorities from orders group by 1")
def summarize(spark, sf):
    out = A.summarize(t(spark, sf, "orders"), "o_custkey", n=A.rec_count(), total=A.sum_of("o_totalprice"), whole=A.sum_of("o_totalprice", as_long=True), any_f=A.any_of("o_orderstatus = 'F'"), all_f=A.all_of("o_orderstatus = 'F'"), priorities=A.txtcat("o_orderpriority"))
    return out.withColumn("total", F.round("total", 4))


@query("select o_custkey, count(*) as n, round(sum(o_totalprice), 4) as total, bool_or(o_totalprice > 300000) as any_large, bool_and(o_totalprice > 10000) as all_over from orders group by 1")
def foreach_reduce(spark, sf):
    g = keyed.group_by(t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey").df
    out = nested.foreach(g, "child", n=A.rec_count(), total=A.sum_of("o_totalprice"), any_large=A.any_of(lambda x: x["o_totalprice"] > 300000), all_over=A.all_of(lambda x: x["o_totalprice"] > 10000))
    return out.select("o_custkey", "n", F.round("total", 4).alias("total"), "any_large", "all_over")


@query("select o_custkey, o_orderkey, round(o_totalprice * 2, 4) as twice from orders where o_totalprice > 50000 qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3")
def foreach_top(spark, sf):
    g = keyed.group_by(t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey").df
    out = nested.foreach(g, "child", where=lambda x: x["o_totalprice"] > 50000, set_fields={"twice": lambda x: F.round(x["o_totalprice"] * 2, 4)}, sort=["-o_totalprice", "o_orderkey"], head=3)
    return shape.denorm(out, "child").select("o_custkey", "o_orderkey", "twice")


@query("select o.o_custkey, o.o_orderkey, c.c_mktsegment from orders o join customer c on c.c_custkey = o.o_custkey")
def foreach_join(spark, sf):
    g = keyed.group_by(t(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey").df
    names = keyed.map_by(t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    out = nested.foreach_pipe(g, "child", lambda rows: keyed.join(rows, names, "inner"), ["o_custkey"])
    return shape.denorm(out, "child")


@query("select event_id, event_type, value from events")
def inject_fields(spark, sf):
    out = nested.inject(t(spark, sf, "events").select("event_id", "event_type", "value"), only="event_type,value")
    return shape.denorm(out.select("event_id", "child"), "child")


@query("select distinct user_id, event_type from events")
def uniq_keys(spark, sf):
    return A.uniq(t(spark, sf, "events"), "user_id,event_type")


@query("select user_id, event_type, count(*) as n from events group by 1, 2")
def uniq_count(spark, sf):
    return A.uniq(t(spark, sf, "events"), "user_id,event_type", count="n")


@query("select user_id, event_id, event_type, value, count(*) over (partition by user_id) as n from events qualify row_number() over (partition by user_id order by event_id) = 1")
def uniq_retain(spark, sf):
    return A.uniq(t(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), "user_id", count="n", retain_others=True)


# --- order and sets -------------------------------------------------------------------------------


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def sort_head(spark, sf):
    return order.head(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 50, "-d.o_totalprice,o_orderkey")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey desc limit 50")
def sort_tail(spark, sf):
    return order.tail(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 50, "-d.o_totalprice,o_orderkey")


@query("select l_returnflag, l_orderkey, l_linenumber, l_extendedprice, l_partkey from lineitem qualify row_number() over (partition by l_returnflag order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) <= 5")
def sort_uniq_by(spark, sf):
    return order.sort(t(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey"), "l_returnflag,-l_extendedprice,l_orderkey,l_linenumber,l_partkey", "l_returnflag", 5)


@query("select * from orders order by md5('7|' || o_orderkey) limit 100")
def sample_exact(spark, sf):
    return order.sample(t(spark, sf, "orders"), 100, 7, by="o_orderkey")


@query("select * from orders where ('0x' || substr(md5('7|' || o_orderkey), 1, 8))::bigint < 0.1 * 4294967296")
def sample_share(spark, sf):
    return order.sample(t(spark, sf, "orders"), 0.1, 7, by="o_orderkey")


@query("select c_custkey as id, c_acctbal as bal, null as s_name from customer union all select s_suppkey, s_acctbal, s_name from supplier")
def cat_sources(spark, sf):
    return order.cat(t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal")), t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"), "s_name"))


@query("select n_nationkey, n_name from nation, range(3)")
def fanout(spark, sf):
    return order.fanout(t(spark, sf, "nation").select("n_nationkey", "n_name"), 3)


# --- text -----------------------------------------------------------------------------------------

_TOKENS = "list_filter(string_split_regex({}, '[ \\t\\n\\x0B\\f\\r\\x1C-\\x1F]+'), lambda x: x <> '')"


@query(f"select doc_id, len({_TOKENS.format('text')}) as n from documents")
def txtcount(spark, sf):
    return text.txtcount(t(spark, sf, "documents").select("doc_id", "text"), "n", "text").select("doc_id", "n")


@query(f"select conv_id, turn, x.w as text, x.f as field from (select conv_id, turn, unnest(list_concat(list_transform({_TOKENS.format('role')}, lambda w: {{'w': w, 'f': 'role'}}), list_transform({_TOKENS.format('text')}, lambda w: {{'w': w, 'f': 'text'}}))) as x from conversations)")
def txtsplit(spark, sf):
    df = text.txtsplit(t(spark, sf, "conversations"), "role,text", with_field=True)
    return shape.denorm(df.select("conv_id", "turn", "term"), "term")


def _pairs(spark, sf) -> DataFrame:
    """Every turn with the next one of its conversation, whole texts: the next one itself, the turn, or both are sought."""
    turns = t(spark, sf, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hay"))
    both = turns.select("conv_id", "turn", "text").join(after, ["conv_id", "turn"])
    return both.withColumn("needle", F.when(F.col("conv_id") % 3 == 0, F.col("hay")).when(F.col("conv_id") % 3 == 1, F.col("text")).otherwise(F.concat_ws(" ", "hay", "text"))).drop("text")


_PAIR = "(select a.conv_id, a.turn, b.text as hay, case when a.conv_id % 3 = 0 then b.text when a.conv_id % 3 = 1 then a.text else concat_ws(' ', b.text, a.text) end as needle from conversations a join conversations b on a.conv_id = b.conv_id and a.turn + 1 = b.turn)"
_HITS = f"(select *, {_TOKENS.format('needle')} as nt, {_TOKENS.format('hay')} as ht from {_PAIR})"
_HITS = f"(select *, len(list_filter(nt, lambda x: list_contains(ht, x))) as hits, len(nt) as size from {_HITS})"


@query(f"select conv_id, turn, case when size > 0 then hits >= size end as is_match, case when size > 0 then case when hits >= size and needle = hay then 'exact' when hits >= size and contains(hay, needle) then 'phrase' when hits >= size then 'broad' end end as kind from {_HITS}")
def txtmatch_type(spark, sf):
    return text.txtmatch(_pairs(spark, sf), "needle", "hay", add_type=True).select("conv_id", "turn", F.col("isMatch").alias("is_match"), F.col("matchedType").alias("kind"))


@query(f"select conv_id, turn, case when size > 0 then hits >= floor(size * 0.4) end as is_match from {_HITS}")
def txtmatch_share(spark, sf):
    return text.txtmatch(_pairs(spark, sf), "needle", "hay", "40%").select("conv_id", "turn", F.col("isMatch").alias("is_match"))


@query(f"select conv_id, turn, case when size > 0 then hits >= list_extract([1, 2, 2, 3], least(size, 4)) end as is_match from {_HITS}")
def txtmatch_list(spark, sf):
    return text.txtmatch(_pairs(spark, sf), "needle", "hay", "1,2,2,3").select("conv_id", "turn", F.col("isMatch").alias("is_match"))


# --- statistics -----------------------------------------------------------------------------------


def _stats_sql(table: str, field: str, v: str, name: str) -> str:
    at = ", ".join(f"list_extract(s, cast(floor({p} * n) as int) + 1)::double as {k}" for k, p in stats.PERCENTILES.items())
    return f"select '{name}' as field, n as num_recs, n as num_values, u as num_unique, round(total, 4) as sum, round(total / n, 6) as mean, hi as max, lo as min, round(sd, 6) as stdev, {at} from (select count(*) as n, count(distinct v) as u, sum(v)::double as total, max(v)::double as hi, min(v)::double as lo, stddev_pop(v) as sd, list_sort(list(v)) as s from (select {v} as v from {table}))"


def _rounded(df: DataFrame) -> DataFrame:
    return df.drop("points").withColumns({"sum": F.round("sum", 4), "mean": F.round("mean", 6), "stdev": F.round("stdev", 6)})


@query(_stats_sql("lineitem", "l_linenumber", "l_linenumber", "l_linenumber"))
def stats_long(spark, sf):
    return _rounded(stats.stats_of(t(spark, sf, "lineitem"), "l_linenumber"))


@query(_stats_sql("lineitem", "l_quantity", "cast(trunc(l_quantity / 5) as bigint) * 5", "l_quantity"))
def stats_binned(spark, sf):
    return _rounded(stats.stats_of(t(spark, sf, "lineitem"), "l_quantity", double_bin=5))


@query(_stats_sql("orders", "o_orderkey", "o_orderkey", "o_orderkey"))
def stats_many_values(spark, sf):
    return _rounded(stats.stats_of(t(spark, sf, "orders"), "o_orderkey"))


@query("select 'l_returnflag' as field, v as value, n from (select l_returnflag as v, count(*) as n from lineitem group by 1 order by 2 desc, 1 limit 2)")
def stats_points(spark, sf):
    s = stats.stats_of(t(spark, sf, "lineitem"), "l_returnflag", max_points=2)
    return shape.denorm(s.select("field", "points"), "points")


@query("select field, num_recs, num_unique from (select 'l_shipmode' as field, 0::bigint as num_recs, 0::bigint as num_unique where false union all select 'l_linestatus', count(*), count(distinct l_linestatus) from lineitem union all select 'l_linestatus_' || l_returnflag, count(*), count(distinct l_linestatus) from lineitem group by l_returnflag)")
def sub_stats(spark, sf):
    return stats.stats_of(t(spark, sf, "lineitem"), "l_linestatus", sub_stats_by="l_returnflag").select("field", "num_recs", "num_unique")


_H = "(select l_returnflag as value, count(*) as n from lineitem where l_linestatus = '{}' group by 1)"


@query(f"with l as (select value, n / sum(n) over () as p, sum(n) over () as tt from {_H.format('O')}), r as (select value, n / sum(n) over () as q from {_H.format('F')}), e as (select (select -sum(p * log2(p)) from l) as le, (select -sum(q * log2(q)) from r) as re, (select -sum(q * log2(coalesce(p, 1 / (select max(tt) from l)))) from r left join l using (value)) as ce) select round(le, 6) as left_entropy, round(re, 6) as right_entropy, round(ce, 6) as cross_entropy, round(ce - le, 6) as kl, round(ce - re, 6) as kl_right_left from e")
def divergence(spark, sf):
    df = t(spark, sf, "lineitem")
    side = lambda s: stats.histogram(df.filter(F.col("l_linestatus") == s), "l_returnflag")
    d = stats.divergence(side("O"), side("F"))
    return d.select(*[F.round(c, 6).alias(c) for c in d.columns])


# --- formats: a table is written to a fresh folder that all executors share, and read back -------------


def _shared_folder(spark) -> str:
    """A new folder below the cluster's checkpoint folder, or where that is unset below the warehouse."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top}/formats-{uuid.uuid4().hex}"


_NAMES = "select c_custkey, c_name, c_mktsegment from customer"


def _names(spark, sf) -> DataFrame:
    return t(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")


@query(_NAMES)
def format_tsv(spark, sf):
    formats.write_tsv(_names(spark, sf), path := _shared_folder(spark))
    return formats.read_tsv(spark, path)


@query(_NAMES)
def format_nv2(spark, sf):
    formats.write_nv2(_names(spark, sf), path := _shared_folder(spark))
    return formats.read_nv2(spark, path)


@query(_NAMES)
def format_json(spark, sf):
    formats.write_json(_names(spark, sf), path := _shared_folder(spark))
    return formats.read_json(spark, path, lines=True)


@query(_NAMES)
def format_nat(spark, sf):
    formats.write_nat(_names(spark, sf), path := _shared_folder(spark))
    return formats.read_nat(spark, path)


@query("select c_name as txt from customer")
def format_txt(spark, sf):
    formats.write_txt(t(spark, sf, "customer").select("c_name"), path := _shared_folder(spark))
    return formats.read_txt(spark, path)


@query("select o_orderkey, o_custkey, o_orderstatus from orders")
def format_by_name(spark, sf):
    formats.write(t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path := f"{_shared_folder(spark)}.tsv")
    return formats.read(spark, path)


@query("select c_custkey, c_nationkey, c_name from customer")
def json_retyped(spark, sf):
    """Keys written as texts in sub-records and in arrays of arrays come back as numbers and flat."""
    df = t(spark, sf, "customer").select(F.struct(F.col("c_custkey").cast("string").alias("key"), "c_name").alias("who"), F.array(F.array(F.col("c_nationkey").cast("string"))).alias("where"))
    formats.write_json(df, path := _shared_folder(spark))
    back = formats.read_json(spark, path, lines=True, retype=True)
    return back.select(F.col("who.key").alias("c_custkey"), F.element_at("where", 1).alias("c_nationkey"), F.col("who.c_name").alias("c_name"))


# --- results amid a pipeline, children of children ------------------------------------------------


@query("select 'all' as instance, count(*) as n, sum(l_quantity) as total, cast(null as boolean) as any_late from lineitem union all select 'returned', count(*), null, bool_or(l_shipdate > date '1998-01-01') from lineitem where l_returnflag = 'R'")
def reductions(spark, sf):
    seen = A.Reductions()
    formats.devnull(Pipeline().observe("all", seen, n=A.rec_count(), total=A.sum_of("l_quantity")).acceptIf("l_returnflag = 'R'").observe("returned", seen, n=A.rec_count(), any_late=A.any_of("l_shipdate > date'1998-01-01'")).run(t(spark, sf, "lineitem")))
    return seen.rows(spark, "all,returned")


@query("select l_orderkey, count(distinct l_returnflag) as flags, cast(sum(case when l_quantity > 10 then l_quantity else 0 end) as double) as large from lineitem group by 1")
def foreach_nested(spark, sf):
    """Orders hold flags, which hold lines: the lines of each flag are filtered and summed, then the flags."""
    lines = t(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(F.struct("l_quantity")).alias("lines"))
    df = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "lines")).alias("flag"))
    large = lambda x: F.aggregate(F.filter(x["lines"], lambda g: g["l_quantity"] > 10), F.lit(0.0), lambda a, g: a + g["l_quantity"].cast("double"))
    return nested.foreach(df, "flag", set_fields={"large": large}, flags=A.rec_count(), large=A.sum_of("large")).select("l_orderkey", "flags", "large")


# --- values and windows ---------------------------------------------------------------------------


@query("select event_id, cast(trunc(value) as bigint) as whole, printf('%.4f', value) as shown, cast(null as double) as not_a_number from events")
def accessors(spark, sf):
    df = t(spark, sf, "events")
    return df.select("event_id", V.as_long(df, "value").alias("whole"), V.as_text(df, "value", 4).alias("shown"), V.as_double(df, "event_type").alias("not_a_number"))


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def windowed_events(spark, sf):
    from weftline.streaming.stateless import windowed

    return windowed(t(spark, sf, "events"), "ts", "1 hour", ["event_type"], n=F.count(F.lit(1)), total=F.round(F.sum("value"), 4))
