"""Registered plans on records: joins, filters, intervals, graphs, scalars."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph, intervals, joins, predicates
from . import register, table


@register("unparsed", "select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def unparsed(spark, sf):
    return predicates.absent(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels").select("doc_id"), ["doc_id"])


@register("present_rows", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F')")
def present_rows(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return predicates.present(table(spark, sf, "customer").select("c_custkey"), o, ["c_custkey"])


@register("form_filter", "select event_id, event_type from events where event_type in ('purchase', 'click')")
def form_filter(spark, sf):
    return predicates.of_forms(table(spark, sf, "events"), "event_type", ["purchase", "click"]).select("event_id", "event_type")


@register("default_class", "select d.doc_id, coalesce(l.quality, 9999)::int as quality from documents d left join (select doc_id, max(quality) as quality from labels group by 1) l using (doc_id)")
def default_class(spark, sf):
    q = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return table(spark, sf, "documents").select("doc_id").join(q, "doc_id", "left").select("doc_id", predicates.with_default(F.col("quality"), 9999).cast("int").alias("quality"))


@register("skip_long", "select doc_id, n_chars from documents where length(text) <= 2000")
def skip_long(spark, sf):
    return predicates.not_too_long(table(spark, sf, "documents"), "text", 2000).select("doc_id", "n_chars")


@register("age_predicate", "select user_id, datediff('second', max(ts), timestamp '2024-01-31 00:00:00') > 36 * 3600 as outdated from events group by 1")
def age_predicate(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("lud"))
    return last.select("user_id", S.is_outdated(F.col("lud"), 36, F.expr("timestamp_ntz'2024-01-31 00:00:00'")).alias("outdated"))


@register("seeded_sample", "select c_custkey from customer order by md5('7:' || c_custkey) limit 20")
def seeded_sample(spark, sf):
    return predicates.hash_sample(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 20, 7)


@register("cap_per_group", "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) <= 3")
def cap_per_group(spark, sf):
    return predicates.cap_per_group(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], 3).drop("o_orderdate")


@register("parser_route", "select doc_id, case when source = 'src1' and lang = 'en' then 's1en' when lang = 'en' then 'en' when lang = 'de' then 'de' end as handler from documents")
def parser_route(spark, sf):
    handlers = {("src1", "en"): "s1en", (None, "en"): "en", (None, "de"): "de"}
    return table(spark, sf, "documents").select("doc_id", predicates.route(F.col("source"), F.col("lang"), handlers).alias("handler"))


@register("company_children", "select c_custkey, (select count(*) from orders where o_custkey = c_custkey)::bigint as n, (select min(o_orderkey) from orders where o_custkey = c_custkey) as first from customer")
def company_children(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    full = joins.with_children(table(spark, sf, "customer").select("c_custkey"), "c_custkey", {"orders": (o, "o_custkey")})
    return full.select("c_custkey", F.size("orders").cast("long").alias("n"), F.get("orders", F.lit(0))["o_orderkey"].alias("first"))


@register("self_reference", "select a.p_partkey, b.p_name as underlying_p_name from part a left join part b on b.p_partkey = a.p_partkey // 2")
def self_reference(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.expr("p_partkey div 2").alias("under"))
    return joins.with_reference(p, "p_partkey", "under", ["p_name"], "underlying_").select("p_partkey", "underlying_p_name")


@register("or_join", "select s_suppkey, l_orderkey, l_linenumber from supplier join lineitem on s_suppkey = l_suppkey or s_suppkey = l_partkey")
def or_join(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return joins.join_either(table(spark, sf, "supplier").select("s_suppkey"), li, "s_suppkey", "l_suppkey", "l_partkey").select("s_suppkey", "l_orderkey", "l_linenumber")


@register("bridge_join", "select s_name, p_brand, count(*) as n from supplier join lineitem on s_suppkey = l_suppkey join part on p_partkey = l_partkey group by 1, 2")
def bridge_join(spark, sf):
    s, p, li = table(spark, sf, "supplier"), table(spark, sf, "part"), table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    return joins.through_bridge(s, li, p, F.col("s_suppkey") == F.col("l_suppkey"), F.col("p_partkey") == F.col("l_partkey")).groupBy("s_name", "p_brand").agg(F.count("*").alias("n"))


@register("item_counts", "select p_type, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1")
def item_counts(spark, sf):
    return joins.counted(table(spark, sf, "lineitem").select("l_partkey"), table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"), "p_type")


@register("identifying_attributes", "select o_orderkey, case when o_orderstatus = 'F' then 2 when o_totalprice > 100000 then 3 end::bigint as n from orders where o_orderstatus = 'F' or o_totalprice > 100000")
def identifying_attributes(spark, sf):
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "Warrant").otherwise("Option")
    known = F.when(F.col("o_totalprice") > 100000, F.lit("5"))
    attrs = F.when(kind == "Warrant", F.create_map(F.lit("name"), F.lit("w"), F.lit("exercise_price"), F.lit("1"), F.lit("right"), F.lit("Call"))).otherwise(F.create_map(F.lit("name"), F.lit("o"), F.lit("strike_price"), known, F.lit("right"), F.lit("Call")))
    found = S.identifying_attributes(kind, attrs)
    return o.select("o_orderkey", F.size(F.map_keys(found)).cast("long").alias("n")).where("n > 0")


_SPANS = "s as (select o_custkey as k, o_orderkey as id, o_orderdate::date as a, max(l_shipdate)::date as b from orders join lineitem on l_orderkey = o_orderkey group by 1, 2, 3)"
_GROUPS = f"""{_SPANS},
    i as (select *, case when max(b) over w < a or max(b) over w is null then 1 else 0 end as opens from s window w as (partition by k order by a, b, id rows between unbounded preceding and 1 preceding)),
    g as (select *, sum(opens) over (partition by k order by a, b, id rows unbounded preceding) as island from i),
    z as (select *, count(*) over (partition by k, island) as size from g),
    f as (select k, id, a, b, dense_rank() over (partition by k order by island) as group_no from z where size > 1)"""


def _spans(spark, sf):
    last = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.max("l_shipdate")).alias("b"))
    return table(spark, sf, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("a"), "b")


@register("overlap_groups", f"with {_GROUPS} select k, id, group_no::int as group_no from f")
def overlap_groups(spark, sf):
    return intervals.overlap_groups(_spans(spark, sf), ["k"], "a", "b", ["id"]).select("k", "id", "group_no")


@register("overlap_longest", f"with {_GROUPS} select k, max(b - a)::int as days, group_no::int as group_no from f group by k, group_no")
def overlap_longest(spark, sf):
    g = intervals.overlap_groups(_spans(spark, sf), ["k"], "a", "b", ["id"])
    return intervals.longest_per_group(g, ["k"], "a", "b").select("k", F.datediff("b", "a").alias("days"), "group_no")


@register("entity_pairs", "select a.user_id, a.event_id as a_pos, b.event_id as b_pos from events a join events b on a.user_id = b.user_id and a.event_id <> b.event_id and abs(a.event_id - b.event_id) <= 150")
def entity_pairs(spark, sf):
    return intervals.pairs_within(table(spark, sf, "events"), "user_id", "event_id", "event_type", 150).select("user_id", "a_pos", "b_pos")


@register("groups_with_both", "select user_id from events group by 1 having bool_or(event_type = 'error') and bool_or(event_type = 'purchase')")
def groups_with_both(spark, sf):
    return intervals.tokens_in_both(table(spark, sf, "events"), "user_id", "event_type", "error", "purchase")


@register("label_runs", "with i as (select *, event_id - row_number() over (partition by event_type order by event_id) as g from events) select event_type, min(event_id) as first, max(event_id) as last from i group by event_type, g")
def label_runs(spark, sf):
    return intervals.runs_of_equal(table(spark, sf, "events"), [], "event_id", "event_type", width=1024)


def _edges(spark, sf):
    n = table(spark, sf, "nation")
    a = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"))
    s = table(spark, sf, "supplier")
    return a.unionByName(s.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("child")))


_EDGES = "e as (select 'r' || n_regionkey as parent, 'n' || n_nationkey as child from nation union all select 'n' || s_nationkey, 's' || s_suppkey from supplier)"


@register("alias_paths", f"with recursive {_EDGES}, d(node, path) as (select distinct parent, parent from e where parent not in (select child from e) union all select e.child, d.path || '/' || e.child from d join e on e.parent = d.node) select node as leaf, path from d where node not in (select parent from e)")
def alias_paths(spark, sf):
    return graph.root_paths(_edges(spark, sf)).select("leaf", F.array_join("path", "/").alias("path"))


@register("ultimate_origin", f"with recursive {_EDGES}, u(child, ancestor) as (select child, parent from e union all select u.child, e.parent from u join e on e.child = u.ancestor) select distinct child, ancestor as origin from u where ancestor not in (select child from e)")
def ultimate_origin(spark, sf):
    return graph.ultimate_origins(_edges(spark, sf))


_PAIRS = "p as (select 's' || (s_suppkey) as a, 's' || (s_suppkey + 1) as b from supplier where s_suppkey + 1 in (select s_suppkey from supplier))"


def _pairs(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey")
    both = s.join(s.select((F.col("s_suppkey") - 1).alias("s_suppkey")), "s_suppkey", "left_semi")
    return both.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("a"), F.concat(F.lit("s"), (F.col("s_suppkey") + 1).cast("string")).alias("b"))


@register("tree_distance", f"""with recursive {_EDGES}, {_PAIRS}, u(child, anc, depth) as (select child, child, 0 from e union all select u.child, e.parent, u.depth + 1 from u join e on e.child = u.anc)
    select a, b, (min(x.depth + y.depth) + 1)::int as distance from p join u x on x.child = a join u y on y.child = b and x.anc = y.anc group by 1, 2""")
def tree_distance(spark, sf):
    return graph.tree_distance(_edges(spark, sf), _pairs(spark, sf)).select("a", "b", "distance")


@register("shortest_path", f"""with recursive {_EDGES}, {_PAIRS}, u(child, anc, depth, path) as (select child, child, 0, [child] from e union all select u.child, e.parent, u.depth + 1, u.path || [e.parent] from u join e on e.child = u.anc)
    select a, b, array_to_string(arg_min(x.path || list_reverse(y.path)[2:], x.depth + y.depth), '/') as path from p join u x on x.child = a join u y on y.child = b and x.anc = y.anc group by 1, 2""")
def shortest_path(spark, sf):
    return graph.shortest_paths(_edges(spark, sf), _pairs(spark, sf)).select("a", "b", F.array_join("path", "/").alias("path"))


_CHAINS = """c as (select 's' || s_suppkey as parent, 's' || lead(s_suppkey) over (partition by s_nationkey order by s_acctbal, s_suppkey) as child from supplier
    union all select 's' || s_suppkey, 's' || lead(s_suppkey) over (partition by floor(s_acctbal / 1500) order by s_suppkey) from supplier),
    g as (select parent as f, child as t from c where child is not null union select child, parent from c where child is not null)"""


@register("paths_in_any_graph", f"""with recursive {_CHAINS}, {_PAIRS},
    r(a, b, node, depth, path) using key (a, b, node) as (select a, b, a, 0, [a] from p
        union select r.a, r.b, g.t, r.depth + 1, min(r.path || [g.t]) from r join g on g.f = r.node left join recurring.r v on v.a = r.a and v.b = r.b and v.node = g.t where v.node is null group by r.a, r.b, g.t, r.depth)
    select a, b, array_to_string(path, '/') as path from r where node = b""")
def paths_in_any_graph(spark, sf):
    """Suppliers of a nation in order of balance, and those of a balance class in order of key, form chains that cross: cycles, and pairs without a path."""
    s = table(spark, sf, "supplier")
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    after = lambda *part: F.lead("s_suppkey").over(W.partitionBy(*part[:-1]).orderBy(*part[-1]))
    by_nation = s.select(name(F.col("s_suppkey")).alias("parent"), name(after("s_nationkey", ["s_acctbal", "s_suppkey"])).alias("child"))
    by_class = s.select(name(F.col("s_suppkey")).alias("parent"), name(after(F.floor(F.col("s_acctbal") / 1500), ["s_suppkey"])).alias("child"))
    return graph.paths_within(by_nation.unionByName(by_class), _pairs(spark, sf)).select("a", "b", F.array_join("path", "/").alias("path"))


_NUMBERS = "n as (select doc_id, i, x from (select doc_id, unnest(m) as x, generate_subscripts(m, 1) as i from (select doc_id, regexp_extract_all(text, '[0-9][0-9.,]*') as m from documents)))"


def _numbers(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[0-9][0-9.,]*"), F.lit(0))).alias("i", "x")).withColumn("i", F.col("i") + 1)


_AMERICAN = r"""case when length(regexp_replace(x, '[^.]', '', 'g')) > 1 or regexp_matches(x, '[.].*,') then null
    when not contains(x, '.') and length(regexp_replace(x, '[^,]', '', 'g')) = 1 and regexp_matches(x, ',[0-9]{1,2}$') then try_cast(replace(x, ',', '.') as double)
    else try_cast(replace(x, ',', '') as double) end"""


@register("american_number", f"with {_NUMBERS} select doc_id, i::int as i, {_AMERICAN} as value from n")
def american_number(spark, sf):
    return _numbers(spark, sf).select("doc_id", "i", S.american_number(F.col("x")).alias("value"))


@register("quantity_parse", f"with {_NUMBERS}, q as (select doc_id, i, regexp_replace(x, '[.,]+$', '') as x from n) select doc_id, i::int as i, ({_AMERICAN}) * 1e6 as value from q")
def quantity_parse(spark, sf):
    return _numbers(spark, sf).select("doc_id", "i", S.quantity(F.concat(F.lit("up to $ "), F.col("x"), F.lit(" million"))).alias("value"))


@register("text_normalise", r"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' *\r?\n[ \r\n]*', chr(10), 'g'), '^ +| +$', '', 'g')) as text from documents")
def text_normalise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.normalise_text(F.col("text")).alias("text"))


@register("date_parse", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def date_parse(spark, sf):
    written = F.date_format("o_orderdate", "MMMM d'th', yyyy")
    return table(spark, sf, "orders").select("o_orderkey", S.parse_date(written).cast("string").alias("day"))


@register("durations", "select p_partkey, p_size * 7.0 + 2 * 365.25 as days from part")
def durations(spark, sf):
    phrase = F.concat(F.lit("after "), F.col("p_size").cast("string"), F.lit(" weeks and two years"))
    return table(spark, sf, "part").select("p_partkey", F.aggregate(S.durations(phrase), F.lit(0.0), lambda a, x: a + x).alias("days"))


@register("set_difference", "select c_nationkey as k from customer except select s_nationkey from supplier where s_acctbal > 5000")
def set_difference(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, sf, "supplier").where("s_acctbal > 5000").select("s_nationkey"))
