"""Queries over any log of attempts: latest, missing, expired, owners, ranges, liveness. They report, and schedule nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTEMPT = "struct<attempt_id:int,status:string,updated_at:double,worker_id:string,completed:array<string>,failed:array<string>>"


def flatten_ledger(df: DataFrame, document: str = "doc") -> DataFrame:
    """(task_id, attempt_id, record fields) of ledger documents: tasks with numbered attempts, or, in the old form,
    one flat record, which counts as attempt 1."""
    fields = ATTEMPT.removeprefix("struct<").removesuffix(">").split(",")
    body = f"struct<attempts:map<string,{ATTEMPT}>,{','.join(fields)}>"
    each = df.select(F.explode(F.from_json(F.col(document), f"struct<tasks:map<string,{body}>>")["tasks"]).alias("task_id", "_b"))
    names = [f.split(":")[0] for f in fields]
    old = F.create_map(F.lit("1"), F.struct(*[F.col(f"_b.{n}").alias(n) for n in names]))
    rows = each.select("task_id", F.explode(F.coalesce("_b.attempts", old)).alias("_k", "_r"))
    return rows.select("task_id", F.col("_k").cast("int").alias("attempt_id"), *[f"_r.{n}" for n in names if n != "attempt_id"])


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def distinct_items(df: DataFrame, items: str, order: str) -> DataFrame:
    """(item, first_at): items of all lists, once each, by where they are first seen."""
    return df.select(F.col(order), F.posexplode(items).alias("_i", "item")).groupBy("item").agg(F.min(F.struct(order, "_i")).alias("_f")).select("item", F.col(f"_f.{order}").alias("first_at"))


def any_completed(df: DataFrame, key: str, status: str = "status") -> DataFrame:
    return df.groupBy(key).agg(F.bool_or(F.col(status) == "COMPLETED").alias("completed"))


def missing_keys(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return expected.join(done.select(key).distinct(), key, "left_anti")


def id_ranges(df: DataFrame, group: str, id: str) -> DataFrame:
    """(group, start, n): runs of consecutive ids. Ids are bucketed first and runs are joined at bucket borders, so a
    group with very many ids isn't one task. Buckets are dealt into as many partitions as the rows need, and sorted there
    once; a repeated id has the rank of its first."""
    from sparkforest.operators.train import dealt

    cell = F.shiftright(F.col(id).cast("long"), 16)
    inner = Window.partitionBy(group, "_c").orderBy(id)
    ids = dealt(df.select(group, F.col(id).cast("long").alias(id), cell.alias("_c")), df.count(), group, "_c")
    runs = ids.withColumn("_g", F.col(id) - F.dense_rank().over(inner)).groupBy(group, "_c", "_g").agg(F.min(id).alias("start"), F.max(id).alias("last"))
    # Only runs that touch a border of their bucket may go on in another.
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFF))
    border = (low("start") == 0) | (low("last") == 0xFFFF)
    inside = runs.where(~border).select(group, "start", (F.col("last") - F.col("start") + 1).alias("n"))
    along = Window.partitionBy(group).orderBy("start")
    new = F.when(F.lag("last").over(along) == F.col("start") - 1, 0).otherwise(1)
    joined = runs.where(border).withColumn("_new", new).withColumn("_run", F.sum("_new").over(along))
    return joined.groupBy(group, "_run").agg(F.min("start").alias("start"), (F.max("last") - F.min("start") + 1).alias("n")).select(group, "start", "n").unionByName(inside)


def check_ids(df: DataFrame, prefix: str, id: str, n: int) -> DataFrame:
    """Adds ``index`` and ``valid``: the id has the prefix, a number below ``n``, and its canonical padding."""
    index = F.regexp_extract(id, r"^.*_tree_(\d+)$", 1).try_cast("int")
    valid = F.coalesce((F.col("index") >= 0) & (F.col("index") < n) & (F.col(id) == F.format_string(f"{prefix}_tree_%06d", F.col("index"))), F.lit(False))
    return df.withColumn("index", index).withColumn("valid", valid)


def range_label(experiment: Column, start: Column, count: Column) -> Column:
    return F.format_string("%s_trees_%06d_%06d", experiment, start, start + count - 1)


def expired(df: DataFrame, now) -> DataFrame:
    now = now if isinstance(now, Column) else F.lit(now)
    return df.where((F.col("status") == "RUNNING") & F.col("lease_expires_at").isNotNull() & (F.col("lease_expires_at") <= now))


def owner_per_item(df: DataFrame, items: str = "tree_ids") -> DataFrame:
    """(item, worker_id, lease_expires_at): of the running attempts on an item, the one updated last."""
    each = df.where("status = 'RUNNING'").select(F.explode(items).alias("item"), F.struct("updated_at", "attempt_id").alias("_o"), F.struct("worker_id", "lease_expires_at").alias("_r"))
    return each.groupBy("item").agg(F.max_by("_r", "_o").alias("_r")).select("item", "_r.*")


def liveness(df: DataFrame, key: str, ts: str, now, timeout: float) -> DataFrame:
    """(key, age, stale): seconds since a key's last event, and whether that is more than ``timeout``."""
    last = df.groupBy(key).agg(F.max(ts).alias("last_seen"))
    now = now if isinstance(now, Column) else F.lit(now)
    age = F.greatest(F.lit(0.0), (now - F.col("last_seen")).cast("double"))
    return last.select(key, age.alias("age"), (age > timeout).alias("stale"))


def abandoned_report(missing: DataFrame, owners: DataFrame, live: DataFrame, now, grace: float = 30.0) -> DataFrame:
    """(item, action, reason) of each missing item: whether its owner still works on it."""
    x = missing.join(owners, "item", "left").join(live.select("worker_id", "stale"), "worker_id", "left")
    gone = F.coalesce(F.col("stale"), F.lit(True))
    late = F.lit(now) - F.col("lease_expires_at")
    reason = (
        F.when(F.col("worker_id").isNull(), "no_owner").when(F.col("lease_expires_at").isNull() & gone, "no_lease_stale").when(F.col("lease_expires_at").isNull(), "no_lease_live")
        .when(late < 0, "lease_live").when(gone, "expired_stale").when(late <= grace, "expired_in_grace").otherwise("expired_over_grace")
    )
    recover = reason.isin("no_owner", "no_lease_stale", "expired_stale", "expired_over_grace")
    return x.select("item", F.when(recover, "recover_now").otherwise("defer").alias("action"), reason.alias("reason"))


#: Markers of an error's category, by falling priority of the categories.
TIMEOUT = ("timeout", "deadline exceeded", "timed out")
WORKER_FAILURE = ("unavailable", "connection refused", "connection reset", "broken pipe", "transport closed", "worker", "rpc")


def error_category(message: Column) -> Column:
    """``timeout`` or ``worker_failure`` where a marker is part of the message, whatever its case; else, and for
    null, ``unknown``."""
    m = F.lower(F.coalesce(message, F.lit("")))
    has = lambda words: F.greatest(*[m.contains(w) for w in words])
    return F.when(has(TIMEOUT), "timeout").when(has(WORKER_FAILURE), "worker_failure").otherwise("unknown")


def merge_ids(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def trees_per(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def evenly_distributed(df: DataFrame, by: str, workers: int | None = None) -> DataFrame:
    """(workers, trees, least, most, even): whether no worker has more than one tree more than another; ``workers``
    that hold nothing count as well."""
    each = trees_per(df, by).agg(F.count("*").alias("holding"), F.coalesce(F.sum("n"), F.lit(0)).alias("trees"), F.min("n").alias("least"), F.max("n").alias("most"))
    all_workers = F.greatest(F.col("holding"), F.lit(workers or 0))
    least = F.when(all_workers > F.col("holding"), 0).otherwise(F.coalesce("least", F.lit(0)))
    out = each.select(all_workers.alias("workers"), "trees", least.alias("least"), F.coalesce("most", F.lit(0)).alias("most"))
    return out.withColumn("even", F.col("most") - F.col("least") <= 1)


def claims_without_artifact(claims: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    return claims.join(artifacts.select(key).distinct(), key, "left_anti")


def progress(df: DataFrame, completed: str = "completed", total: str = "tree_ids") -> DataFrame:
    return df.where("status = 'RUNNING'").withColumn("progress", F.when(F.size(total) > 0, F.size(completed) / F.size(total)).otherwise(0.0))
