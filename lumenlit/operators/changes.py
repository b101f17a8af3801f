"""Change log, upserts and constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_log(old: DataFrame, new: DataFrame, key: str, tracked: list[str]) -> DataFrame:
    """key, operation and diff (map of column to 'from -> to') of rows that appeared, vanished or changed in a tracked column."""
    before = old.select(F.col(key).alias("k"), F.struct(*tracked).alias("o"))
    after = new.select(F.col(key).alias("k"), F.struct(*tracked).alias("n"))
    both = before.join(after, "k", "full_outer")
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    entries = F.filter(F.array(*(F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.struct(F.lit(c).alias("key"), F.concat(shown(F.col(f"o.{c}")), F.lit(" -> "), shown(F.col(f"n.{c}"))).alias("value"))) for c in tracked)), lambda e: e.isNotNull())
    operation = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").otherwise("update")
    logged = both.select(F.col("k").alias(key), operation.alias("operation"), F.map_from_entries(entries).alias("diff"))
    return logged.where((F.col("operation") != "update") | (F.size("diff") > 0))


def status_action(old: Column, new: Column, names: dict[str, str]) -> Column:
    """The name of a status change; 'edited' if the status stayed."""
    action = F.lit("status_changed")
    for status, name in names.items():
        action = F.when(new == status, name).otherwise(action)
    return F.when(old.eqNullSafe(new), F.lit("edited")).otherwise(action)


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], insert_only: list[str] | None = None) -> DataFrame:
    """current with incoming rows merged in: new keys are added, known ones take the incoming values except of insert-only columns. Incoming keys are unique."""
    kept_columns = set(insert_only or [])
    others = [c for c in current.columns if c not in key]
    a = current.select(*key, F.struct(*others).alias("a"))
    b = incoming.select(*key, F.struct(*others).alias("b"))
    pick = lambda c: F.when(F.col("b").isNull() | (F.col("a").isNotNull() & F.lit(c in kept_columns)), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return a.join(b, key, "full_outer").select(*key, *[pick(c) for c in others]).select(*current.columns)


def replace_members(current: DataFrame, requested: DataFrame, known: DataFrame, owner: str, member: str) -> DataFrame:
    """Membership after owners named their wanted members: those of a requesting owner become exactly the known ones requested, others stay. Columns owner, member, is_active."""
    wanted = requested.select(owner, member).join(known.select(member), member, "left_semi").distinct().withColumn("wanted", F.lit(True))
    asking = requested.select(owner).distinct().withColumn("asking", F.lit(True))
    merged = current.select(owner, member, "is_active").join(wanted, [owner, member], "full_outer").join(asking, owner, "left")
    return merged.select(owner, member, F.when(F.col("asking").isNotNull(), F.coalesce("wanted", F.lit(False))).otherwise(F.col("is_active")).alias("is_active"))


def violations(rows: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """(key, rule) of every row and rule that does not hold; a rule that is unknown for nulls holds, as in a check constraint."""
    broken = F.filter(F.array(*(F.when(F.expr(f"not ({condition})"), F.lit(name)) for name, condition in rules.items())), lambda x: x.isNotNull())
    return rows.select(F.col(key), F.explode(broken).alias("rule"))


def guarded(rows: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """The rows, or an error that names a violated rule; for use before a write."""
    first = violations(rows, key, rules).take(1)
    if first:
        raise ValueError(f"rule {first[0]['rule']} does not hold for {key} {first[0][key]}")
    return rows


def with_actor(log: DataFrame, *people: str) -> DataFrame:
    """The log with its actor: the first of the given columns that names somebody."""
    return log.withColumn("actor", F.coalesce(*people))


def correction_entries(corrections: DataFrame, subject: str, by: str, note: str, patched: list[str]) -> DataFrame:
    """Every correction as an entry of the log: subject, actor, action and a JSON diff of its note and the patched fields."""
    diff = F.to_json(F.struct(F.col(note).alias("note"), F.struct(*patched).alias("patched_fields")))
    return corrections.select(subject, F.col(by).alias("actor"), F.lit("corrected").alias("action"), diff.alias("diff"))


def linked(users: DataFrame, user: str, address: str, accounts: DataFrame, account: str, account_address: str) -> DataFrame:
    """Users with the account of their address, case aside; the least of several, null without one."""
    known = accounts.select(F.lower(account_address).alias("address_"), F.col(account).alias("account_")).groupBy("address_").agg(F.min("account_").alias(account))
    return users.withColumn("address_", F.lower(address)).join(known, "address_", "left").drop("address_")


def inserted_if_absent(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """current and the incoming rows whose key it does not have; one of each key."""
    return current.unionByName(incoming.dropDuplicates(key).join(current.select(*key), key, "left_anti"))


def subscriber_action(rows: DataFrame, action: Column, token: Column) -> DataFrame:
    """Subscribers after 'store' (the token is kept and mail turns to both ways), 'clear' (no token) or 'unsubscribe' (no longer verified); others stay."""
    did = F.coalesce(action, F.lit(""))
    return rows.withColumns({
        "delivery": F.when((did == "store") & (F.col("delivery") == "email"), "both").otherwise(F.col("delivery")),
        "push_token": F.when(did == "store", token).when(did != "clear", F.col("push_token")),
        "verified": F.when(did == "unsubscribe", False).otherwise(F.col("verified")),
    })


def touched(old: DataFrame, new: DataFrame, key: list[str], watched: list[str], stamp: str, now: Column) -> DataFrame:
    """key and stamp of all rows: ``now`` for those that are new or changed in a watched column, else the old stamp."""
    a = old.select(*key, F.struct(*watched).alias("a_"), F.col(stamp).alias("old_"))
    b = new.select(*key, F.struct(*watched).alias("b_"))
    changed = F.col("b_").isNotNull() & ~F.col("a_").eqNullSafe(F.col("b_"))
    return a.join(b, key, "full_outer").select(*key, F.when(changed, now).otherwise(F.col("old_")).alias(stamp))
