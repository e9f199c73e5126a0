"""Registered plans on facts, cash and state: each query and its SQL twin side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cash, facts, state
from . import register, table

AS_OF = "2002-01-01"


def _flows(spark, sf):
    """Orders as cash flows: a customer's period from order to last shipment, an amount by return flag."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.to_date("l_shipdate").alias("ship"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
    # one pass over the lines: a sum for each kind beside the last shipment
    flags = {"operating": F.col("l_returnflag") == "A", "investing": F.col("l_returnflag") == "R"}
    flags["financing"] = ~(flags["operating"] | flags["investing"]) | F.col("l_returnflag").isNull()
    wide = lines.groupBy("l_orderkey").agg(F.max("ship").alias("to_date"), *[F.sum(F.when(f, F.col("amount"))).alias(k) for k, f in flags.items()])
    by_kind = wide.select("l_orderkey", "to_date", F.explode(F.create_map(*[x for k in flags for x in (F.lit(k), F.col(k))])).alias("kind", "amount")).where("amount is not null")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("company_id"), F.to_date("o_orderdate").alias("from_date"))
    met = by_kind.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    sign = F.when(F.col("kind") == "financing", 1).otherwise(-1)
    return met.groupBy("company_id", "kind", "from_date", "to_date").agg((F.sum(F.col("amount")) * F.max(sign)).alias("amount"))


_FLOWS = """
    lines as (select l_orderkey, l_returnflag, l_shipdate::date as ship, l_extendedprice * (1 - l_discount) as amount from lineitem),
    span as (select l_orderkey, max(ship) as to_date from lines group by 1),
    by_kind as (select l_orderkey, case l_returnflag when 'A' then 'operating' when 'R' then 'investing' else 'financing' end as kind, sum(amount) as amount from lines group by 1, 2),
    flows as (select o_custkey as company_id, kind, o_orderdate::date as from_date, to_date, sum(amount) * max(case when kind = 'financing' then 1 else -1 end) as amount
              from by_kind join span using (l_orderkey) join orders on l_orderkey = o_orderkey group by 1, 2, 3, 4),
    rated as (select *, case when to_date <> from_date then amount / datediff('day', from_date, to_date) end as rate from flows),
    wide as (select company_id, from_date, to_date, max(rate) filter (kind = 'operating') as burn_rate_operating, max(rate) filter (kind = 'financing') as burn_rate_financing,
                    max(rate) filter (kind = 'investing') as burn_rate_investing from rated group by 1, 2, 3),
    burn as (select *, coalesce(burn_rate_operating, 0) + coalesce(burn_rate_investing, 0) as burn_rate_total from wide
             qualify to_date = max(to_date) over (partition by company_id, from_date))
"""


def _burn(spark, sf):
    return cash.burn_rates(_flows(spark, sf), "company_id")


def _round(df, *columns):
    # 2 places: the sums of the two engines differ in the last bits
    return df.withColumns({c: F.round(c, 2) for c in columns})


@register("runway_summary", f"""
    with {_FLOWS},
    net as (select o_custkey as company_id, o_orderdate::date as instant, o_totalprice as amount from orders),
    n as (select * from net qualify row_number() over (partition by company_id order by instant desc nulls first, amount desc) = 1),
    b as (select * from burn qualify row_number() over (partition by company_id order by to_date desc nulls first, from_date desc) = 1)
    select company_id, round(burn_rate_total, 2) as burn_rate, strftime(to_date, '%Y-%m-%d') as burn_rate_date, amount as net_cash, strftime(instant, '%Y-%m-%d') as net_cash_date,
           case when burn_rate_total < 0 then round(abs(amount + burn_rate_total * datediff('day', instant, date '{AS_OF}')) / abs(burn_rate_total), 2) else 'infinity'::double end as days_of_cash,
           '{AS_OF}' as days_of_cash_date
    from n join b using (company_id)""")
def runway_summary(spark, sf):
    net = table(spark, sf, "orders").select(F.col("o_custkey").alias("company_id"), F.to_date("o_orderdate").alias("instant"), F.col("o_totalprice").alias("amount"))
    out = cash.runway(net, _burn(spark, sf), "company_id", AS_OF)
    return _round(out, "burn_rate").withColumns({c: F.col(c).cast("string") for c in ("burn_rate_date", "net_cash_date", "days_of_cash_date")})


@register("burn_rate", f"""
    with {_FLOWS} select company_id, strftime(from_date, '%Y-%m-%d') as from_date, strftime(to_date, '%Y-%m-%d') as to_date, round(burn_rate_operating, 2) as burn_rate_operating,
    round(burn_rate_financing, 2) as burn_rate_financing, round(burn_rate_investing, 2) as burn_rate_investing, round(burn_rate_total, 2) as burn_rate_total from burn""")
def burn_rate(spark, sf):
    out = _round(_burn(spark, sf), "burn_rate_operating", "burn_rate_financing", "burn_rate_investing", "burn_rate_total")
    return out.withColumns({c: F.col(c).cast("string") for c in ("from_date", "to_date")})


def _events(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", "user_id", F.col("event_type").alias("tag"), F.to_date("ts").cast("string").alias("end"), F.col("value").alias("val"), "ts")


_EVENTS = "e as (select event_id, user_id, event_type as tag, strftime(ts, '%Y-%m-%d') as \"end\", value as val, ts from events)"


@register("fact_select", f"with {_EVENTS} select event_id, user_id, tag, \"end\", val from e where regexp_matches(tag, '(?i)^(purchase|signup)$')")
def fact_select(spark, sf):
    return facts.select_facts(_events(spark, sf), "(?i)^(purchase|signup)$").drop("ts")


@register("fact_dedup_max", f"with {_EVENTS} select user_id, tag, \"end\", val, event_id from e qualify row_number() over (partition by user_id, tag, \"end\" order by val desc, event_id desc) = 1")
def fact_dedup_max(spark, sf):
    return facts.dedup_largest(_events(spark, sf), ["user_id", "tag", "end"], "val", "event_id")


@register("fact_dedup_latest", """
    select o_custkey, strftime(o_orderdate, '%Y-%m') as month, o_orderkey, o_totalprice from orders
    qualify row_number() over (partition by o_custkey, strftime(o_orderdate, '%Y-%m') order by o_orderdate desc, o_orderkey desc) = 1""")
def fact_dedup_latest(spark, sf):
    o = table(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return facts.dedup_by(o, ["o_custkey", "month"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "month", "o_orderkey", "o_totalprice")


@register("fact_keep_first", f"with {_EVENTS} select user_id, tag, \"end\", val, event_id from e qualify row_number() over (partition by user_id, tag, \"end\" order by event_id) = 1")
def fact_keep_first(spark, sf):
    return facts.dedup_by(_events(spark, sf), ["user_id", "tag", "end"], [F.col("event_id")]).select("user_id", "tag", "end", "val", "event_id")


_TAGS = ("purchase", "signup", "click", "view")


@register("net_cash_pivot", f"with {_EVENTS}, w as (select user_id, \"end\", " + ", ".join(f"max(val) filter (tag = '{t}') as {t}" for t in _TAGS) + f" from e where tag in {_TAGS} group by 1, 2) select *, greatest({', '.join(_TAGS)}) as val from w")
def net_cash_pivot(spark, sf):
    return facts.largest_of(facts.outer_by_tag(_events(spark, sf), ["user_id", "end"], "tag", _TAGS, "val"), _TAGS, "val")


@register("facts_union_distinct", f"with {_EVENTS} select user_id, tag, \"end\" from e where tag = 'purchase' union select user_id, tag, \"end\" from e where val > 50")
def facts_union_distinct(spark, sf):
    e = _events(spark, sf).select("user_id", "tag", "end", "val")
    return facts.union_distinct(e.where("tag = 'purchase'").drop("val"), e.where("val > 50").drop("val"))


@register("latest_per_company", "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc nulls first, o_orderkey desc) = 1")
def latest_per_company(spark, sf):
    return cash.latest(table(spark, sf, "orders"), "o_custkey", "o_orderdate", F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


_OLD = "old as (select o_custkey as k, max(o_orderkey) as v, max(o_orderdate) as d from orders where o_orderkey % 2 = 0 group by 1)"
_NEW = "new as (select o_custkey as k, o_orderkey as v, o_orderdate as d from orders where o_orderkey % 2 = 1)"


def _halves(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderdate").alias("d"))
    return o.where("v % 2 = 0").groupBy("k").agg(F.max("v").alias("v"), F.max("d").alias("d")), o.where("v % 2 = 1")


@register("insert_ignore", f"with {_OLD}, {_NEW} select k, v from old union all select k, v from new where k not in (select k from old) qualify row_number() over (partition by k order by v) = 1")
def insert_ignore(spark, sf):
    old, new = _halves(spark, sf)
    return state.insert_ignore(old, new, ["k"], [F.col("v")]).select("k", "v")


@register("upsert_newer", f"with {_OLD}, {_NEW}, u as (select *, 0 as n from old union all select *, 1 from new) select k, v from u qualify row_number() over (partition by k order by d desc nulls last, n, v desc) = 1")
def upsert_newer(spark, sf):
    old, new = _halves(spark, sf)
    new = facts.dedup_by(new, ["k"], [F.desc("d"), F.desc("v")])
    return state.upsert_newer(old, new, ["k"], "d").select("k", "v")


@register("upsert_guarded", f"""
    with {_OLD}, {_NEW}, n as (select * from new qualify row_number() over (partition by k order by d desc, v desc) = 1)
    select coalesce(o.k, n.k) as k, case when n.k is not null and (o.k is null or coalesce(o.d <= n.d and o.v <= n.v, false)) then n.v else o.v end as v from old o full join n on o.k = n.k""")
def upsert_guarded(spark, sf):
    old, new = _halves(spark, sf)
    new = facts.dedup_by(new, ["k"], [F.desc("d"), F.desc("v")])
    return state.upsert_if(old, new, ["k"], (F.col("o.d") <= F.col("n.d")) & (F.col("o.v") <= F.col("n.v"))).select("k", "v")


@register("upsert_last", f"with {_OLD}, {_NEW}, n as (select * from new qualify row_number() over (partition by k order by v desc) = 1) select k, v from old where k not in (select k from n) union all select k, v from n")
def upsert_last(spark, sf):
    old, new = _halves(spark, sf)
    return state.upsert_last(old, new, ["k"], [F.desc("v")]).select("k", "v")


@register("rebuild_companies", f"with {_OLD}, {_NEW}, f as (select k, min(v) as v from new group by 1) select k, v from old where k not in (select k from f) union all select k, v from f")
def rebuild_companies(spark, sf):
    old, new = _halves(spark, sf)
    return state.replace_keys(old, new.groupBy("k").agg(F.min("v").alias("v"), F.min("d").alias("d")), ["k"]).select("k", "v")


@register("update_stamps", "with t as (select c_custkey as k, 'x' as name, null::varchar as lud from customer where c_custkey % 3 = 0), u as (select o_custkey as k, max(strftime(o_orderdate, '%Y-%m-%d')) as s from orders group by 1) select k, t.name, coalesce(s, lud) as lud from t full join u using (k)")
def update_stamps(spark, sf):
    t = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit("x").alias("name"), F.lit(None).cast("string").alias("lud"))
    u = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("lud"))
    return state.stamp(t, ["k"], u, "lud")


@register("get_or_create", "with o as (select c_name as cik, c_custkey as id from customer where c_custkey % 2 = 0), n as (select c_name as cik, c_custkey as id from customer where length(c_name) >= 10) select * from o union all select * from n where cik not in (select cik from o)")
def get_or_create(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("cik"), F.col("c_custkey").alias("id"))
    return state.get_or_create(c.where("id % 2 = 0"), c)


@register("ensure_default_child", "with p as (select c_custkey as k from customer), c as (select o_custkey as k, o_orderpriority as name from orders), m as (select k from p where k not in (select k from c where name = '1-URGENT')) select k, name from c union all select k, 'common stock' from m")
def ensure_default_child(spark, sf):
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    c = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("name"))
    return state.ensure_child(c, p, "k", F.col("name") == "1-URGENT", name="common stock")


@register("effect_update", "with f as (select user_id, event_type as t from events qualify row_number() over (partition by user_id order by ts, event_id) = 1) select c_custkey, coalesce(t, c_mktsegment) as c_mktsegment from customer left join f on user_id = c_custkey")
def effect_update(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    e = table(spark, sf, "events").withColumnRenamed("user_id", "c_custkey")
    return state.copy_first_match(c, e, ["c_custkey"], "event_type", "c_mktsegment", [F.col("ts"), F.col("event_id")])


@register("fk_resolve", "with d as (select n_nationkey, n_name from nation where n_nationkey < 10) select * from d union all select distinct c_nationkey, 'unspecified' from customer where c_nationkey not in (select n_nationkey from d)")
def fk_resolve(spark, sf):
    d = table(spark, sf, "nation").where("n_nationkey < 10").select("n_nationkey", "n_name")
    return state.resolve_dimension(d, table(spark, sf, "customer"), "n_nationkey", "c_nationkey", n_name="unspecified")


@register("reference_resolution", "select c_custkey, n_nationkey as nation_id, true as found from customer join nation on n_name = 'NATION_' || c_nationkey union all select c_custkey, null, false from customer where 'NATION_' || c_nationkey not in (select n_name from nation)")
def reference_resolution(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("n_name"))
    good, bad = state.resolve_reference(rows, table(spark, sf, "nation"), "n_name", "n_nationkey", "nation_id")
    return good.select("c_custkey", "nation_id", F.lit(True).alias("found")).unionByName(bad.select("c_custkey", F.lit(None).cast("int").alias("nation_id"), F.lit(False).alias("found")))


@register("edges_within", "with s as (select s_suppkey as id from supplier where s_acctbal > 0) select distinct l_suppkey, l_partkey from lineitem where l_suppkey in (select id from s) and l_partkey in (select id from s)")
def edges_within(spark, sf):
    nodes = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    return state.edges_within(table(spark, sf, "lineitem").select("l_suppkey", "l_partkey"), nodes, "l_suppkey", "l_partkey", "id").distinct()


@register("attr_lookup", "select event_id from events where json_extract_string(props, '$.k') = '7'")
def attr_lookup(spark, sf):
    return state.find_by_attributes(table(spark, sf, "events"), "props", {"k": "7"}).select("event_id")


@register("command_fold", "with h as (select user_id as k, min(event_id) as s from events where event_type = 'signup' group by 1) select k, s from h where k % 5 <> 0 union all select distinct user_id, -1 from events where user_id % 5 = 0")
def command_fold(spark, sf):
    e = table(spark, sf, "events")
    old = e.where("user_id % 5 = 0").select(F.col("user_id").alias("k"), F.lit(-1).cast("long").alias("s")).distinct()
    commands = e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("op"), F.to_json(F.struct(F.col("user_id").alias("k"), F.col("event_id").alias("s"))).alias("payload"))
    return state.apply_commands(commands, {"signup": old}, {"signup": ["k"]})[0]["signup"]
