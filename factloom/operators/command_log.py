"""One queue of commands of all kinds, replayed in its order without a loop over commands.

A command may need a row that an earlier one made: an offering needs its shelf, a registration its offering. Rows are never
taken back and the first command of a key makes its row, so whether a need is met at a command's place in the queue depends on one number only, the place of
the first accepted command that makes the needed key. Kinds are settled along their dependency order; each costs a grouping by key and a join on it,
whatever the number of commands. First places are one row a key, pre-aggregated before they move; a hot key's uses are split by skew-join handling.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of command: the key of the row it adds, and the kind whose row it needs, found by these columns of its own."""

    op: str
    key: tuple[str, ...]
    needs: str | None = None
    by: tuple[str, ...] = ()
    missing: str = ""


#: Shelves and their kin need the company; offerings attach to a shelf of their own number, registrations to an accepted offering.
RULES = (
    Rule("company", ("company_id",)),
    Rule("shelf", ("company_id", "accn"), "company", ("company_id",), "no company"),
    Rule("resale", ("company_id", "accn"), "company", ("company_id",), "no company"),
    Rule("effect", ("company_id", "accn"), "company", ("company_id",), "no company"),
    Rule("offering", ("company_id", "accn"), "shelf", ("company_id", "accn"), "no shelf registration of this accn"),
    Rule("registration", ("company_id", "offering_accn", "security_id"), "offering", ("company_id", "offering_accn"), "error: no shelf offering of this accn"),
)


def replay(queue: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The history of the queue: its rows with `status` and `reason`.

    queue: (seq, op, key columns of the rules); seq is the place in the queue. A command is `applied` if it adds the row of its key, `present` if an earlier one
    did, and `rejected` with a reason if its key holds a null, its kind is unknown, or what it needs had not been made by an earlier accepted command. A failing command
    never stops the others. Commands of equal seq don't see each other. Columns beside these stay; an empty queue has an empty history.
    """
    done, since = [], {}
    verdict = lambda df, status, reason=None: df.withColumn("status", F.lit(status)).withColumn("reason", F.lit(reason).cast("string"))
    done.append(verdict(queue.where(F.coalesce(~F.col("op").isin([r.op for r in rules]), F.lit(True))), "rejected", "unknown op"))
    for rule in rules:
        rows = queue.where(F.col("op") == rule.op)
        whole = F.lit(True)
        for c in dict.fromkeys((*rule.key, *rule.by)):
            whole = whole & F.col(c).isNotNull()
        done.append(verdict(rows.where(~whole), "rejected", "no key"))
        rows = rows.where(whole)
        if rule.needs is not None:
            key, first = since[rule.needs]
            met = first.select(*[F.col(k).alias(f"_need_{c}") for k, c in zip(key, rule.by, strict=True)], F.col("_since").alias("_made"))
            rows = rows.join(met, [F.col(c) == F.col(f"_need_{c}") for c in rule.by], "left").drop(*[f"_need_{c}" for c in rule.by])
            known = F.coalesce(F.col("_made") < F.col("seq"), F.lit(False))
            done.append(verdict(rows.where(~known).drop("_made"), "rejected", rule.missing))
            rows = rows.where(known).drop("_made")
        first = rows.groupBy(*rule.key).agg(F.min("seq").alias("_since"))
        since[rule.op] = rule.key, first
        settled = rows.join(first, list(rule.key)).withColumn("status", F.when(F.col("seq") == F.col("_since"), "applied").otherwise("present"))
        done.append(settled.withColumn("reason", F.lit(None).cast("string")).drop("_since"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def made(history: DataFrame, op: str, columns: Sequence[str]) -> DataFrame:
    """The rows that commands of a kind added."""
    return history.where((F.col("op") == op) & (F.col("status") == "applied")).select(*columns)
