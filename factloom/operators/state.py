"""State changes as DataFrame algebra: inserts, guarded upserts, key resolution, commands.

A table is a DataFrame; a change gives the new table. Writers put it beside the old one and swap, never over a
path being read. Each operation costs at most one shuffle per side, on the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .facts import dedup_by


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], arrival: Sequence[Column]) -> DataFrame:
    """old plus the new rows whose key it lacks; among new rows of one key the first to arrive."""
    fresh = dedup_by(new, keys, arrival).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def upsert_if(old: DataFrame, new: DataFrame, keys: Sequence[str], guard: Column) -> DataFrame:
    """New keys are inserted; a known key takes the new row where guard (over o.* and n.*) is true, and keeps the old one where it is false or null."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    is_old, is_new = F.col("o._here").isNotNull(), F.col("n._here").isNotNull()
    both = old.withColumn("_here", F.lit(1)).alias("o").join(new.withColumn("_here", F.lit(1)).alias("n"), on, "full_outer")
    take = is_new & (~is_old | F.coalesce(guard, F.lit(False)))
    return both.select(*[F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns])


def upsert_newer(old: DataFrame, new: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Per key the row with the largest `by`; the old one on ties. One shuffle: union and rank."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return dedup_by(both, keys, [F.col(by).desc_nulls_last(), F.col("_new")]).drop("_new")


def upsert_last(old: DataFrame, new: DataFrame, keys: Sequence[str], arrival: Sequence[Column]) -> DataFrame:
    """Per key the last new row to arrive, else the old one."""
    last = dedup_by(new, keys, arrival)
    return old.join(last.select(*keys), list(keys), "left_anti").unionByName(last.select(*old.columns))


def delete_keys(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(gone, list(keys), "left_anti")


def replace_keys(table: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deletes the keys that fresh rebuilds and adds its rows."""
    return delete_keys(table, fresh.select(*keys).distinct(), keys).unionByName(fresh.select(*table.columns))


def stamp(table: DataFrame, keys: Sequence[str], updates: DataFrame, column: str) -> DataFrame:
    """Sets last-update stamps: the newest stamp of each key; keys are added as needed."""
    newest = updates.groupBy(*keys).agg(F.max(column).alias("_stamp"))
    both = table.join(newest, list(keys), "full_outer")
    return both.select(*[F.coalesce("_stamp", column).alias(column) if c == column else F.col(c) for c in table.columns])


def resolve_dimension(dimension: DataFrame, facts: DataFrame, key: str, fact_key: str, **defaults: object) -> DataFrame:
    """The dimension with a default row for each key of facts it lacks."""
    missing = facts.select(F.col(fact_key).alias(key)).where(F.col(key).isNotNull()).distinct().join(dimension.select(key), key, "left_anti")
    filled = missing.select(*[F.col(key) if c == key else F.lit(defaults.get(c)).cast(dimension.schema[c].dataType).alias(c) for c in dimension.columns])
    return dimension.unionByName(filled)


def get_or_create(companies: DataFrame, new: DataFrame, cik: str = "cik") -> DataFrame:
    """companies plus the new ones; a cik has 10 characters at least."""
    return insert_ignore(companies, new.where(F.length(cik) >= 10), [cik], [F.col(c) for c in new.columns])


def ensure_child(children: DataFrame, parents: DataFrame, key: str, match: Column, **defaults: object) -> DataFrame:
    """Adds a default child to each parent that has none matching."""
    lacking = parents.select(key).distinct().join(children.where(match).select(key), key, "left_anti")
    row = lacking.select(*[F.col(key) if c == key else F.lit(defaults.get(c)).cast(children.schema[c].dataType).alias(c) for c in children.columns])
    return children.unionByName(row)


def copy_first_match(target: DataFrame, source: DataFrame, keys: Sequence[str], take: str, into: str, order: Sequence[Column]) -> DataFrame:
    """target with `into` overwritten by `take` of the first source row with equal keys, kept where there is none."""
    first = dedup_by(source, keys, order).select(*keys, F.col(take).alias("_take"))
    both = target.join(first, list(keys), "left")
    return both.select(*[F.coalesce("_take", into).alias(into) if c == into else F.col(c) for c in target.columns])


def resolve_reference(rows: DataFrame, targets: DataFrame, name: str, key: str, out: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the key of the target they name, rows that name none). Of several targets of a name the one with the least key counts."""
    by_name = targets.groupBy(name).agg(F.min(key).alias(out))
    return rows.join(by_name, name), rows.join(by_name, name, "left_anti")


def edges_within(edges: DataFrame, nodes: DataFrame, source: str, target: str, node: str) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select(node)
    return edges.join(ids, F.col(source) == ids[node], "left_semi").join(ids, F.col(target) == ids[node], "left_semi")


def find_by_attributes(rows: DataFrame, json: str, attributes: dict[str, str]) -> DataFrame:
    """Rows whose JSON holds every attribute with the given value."""
    for k, v in attributes.items():
        rows = rows.where(F.get_json_object(json, f"$.{k}") == v)
    return rows


def apply_commands(commands: DataFrame, state: dict[str, DataFrame], keys: dict[str, Sequence[str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Folds commands (seq, op, payload JSON) into the tables they name by op; (new state, rejected commands with a reason).

    An op adds its payload to the table of that name unless the key is present (first by seq wins). Unknown ops and payloads without a key are
    rejected and never stop the others.
    """
    out, known = {}, list(state)
    rejects = commands.where(~F.col("op").isin(known) | F.col("op").isNull()).withColumn("reason", F.lit("unknown op"))
    for op, table in state.items():
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
        rows = commands.where(F.col("op") == op).withColumn("_p", F.from_json("payload", schema))
        keyed = F.forall(F.array(*[F.col(f"_p.{k}").cast("string") for k in keys[op]]), lambda x: x.isNotNull())
        keyed = F.coalesce(keyed, F.lit(False))
        rejects = rejects.unionByName(rows.where(~keyed).drop("_p").withColumn("reason", F.lit("no key")))
        new = rows.where(keyed).select("seq", "_p.*")
        out[op] = insert_ignore(table, new, keys[op], [F.col("seq")])
    return out, rejects
