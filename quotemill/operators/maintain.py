"""Table maintenance as joins and unions: keyed upserts, children of changed rows, recomputed keys, overlays, memos.

Plain Parquet takes no MERGE, so each function returns the new table; `write_version` puts it in a folder of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], order: list | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """K-1, K-7: rows replace target rows of the same key; of several new rows the last by `order` wins; columns in `keep` stay
    as they were. Null keys are equal to null keys."""
    if order:
        last = Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order))
        rows = rows.withColumn("_i", F.row_number().over(last)).where("_i = 1").drop("_i")
    else:
        rows = rows.dropDuplicates(keys)
    same = None
    for k in keys:
        same = F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) if same is None else same & F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
    rows = rows.select(*target.columns)
    kept = target.alias("o").join(rows.select(*keys).alias("n"), same, "left_anti")
    if keep:
        rows = rows.alias("n").join(target.select(*keys, *keep).alias("o"), same, "left").select(*(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c in keep else F.col(f"n.{c}") for c in target.columns))
    return kept.unionByName(rows)


def replace_children(children: DataFrame, parent: str, changed: DataFrame, new: DataFrame) -> DataFrame:
    """K-2: all children of the changed parents give way to the new ones."""
    return children.join(changed.select(parent).distinct(), parent, "left_anti").select(*children.columns).unionByName(new.select(*children.columns))


def changed_keys(table: DataFrame, stored: str, recomputed: Column) -> DataFrame:
    """K-3: only the rows whose recomputed key differs from the stored one (null-safe), with it as `new_key`."""
    return table.withColumn("new_key", recomputed).where(~F.col("new_key").eqNullSafe(F.col(stored)))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """U-7: rows that only one of two tables has, with `side`."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def enrich(target: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """K-5, K-8: matched rows take the new values where these aren't null; the others keep theirs. Of several finds of a key
    the smallest value of each column holds."""
    found = found.groupBy(key).agg(*(F.min(c).alias(f"_{c}") for c in columns))
    return target.join(found, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else c for c in target.columns))


def overlay_grades(verses: DataFrame, links: DataFrame, key: list[str]) -> DataFrame:
    """K-5 inside the array: every grade takes the link of its record."""
    url = F.transform("grades", lambda g: g.withField("url", F.coalesce(F.col("_url"), g["url"])))
    return verses.join(links.withColumnRenamed("url", "_url"), key, "left").withColumn("grades", url).drop("_url").select(*verses.columns)


def memo(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """K-6: (hits with their payload, keys to fetch)."""
    asked = requests.select(key).distinct()
    return asked.join(cache, key), asked.join(cache.select(key), key, "left_anti")


def append(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """U-5: new keys come after the existing ones, with places that go on from theirs. Places of the new rows come from one
    window over new rows only, a curated addition by hand."""
    fresh = new.join(existing.select(key), key, "left_anti").dropDuplicates([key])
    top = existing.agg(F.max("position")).first()[0] or 0
    fresh = fresh.withColumn("position", (F.row_number().over(Window.orderBy(order)) + F.lit(top)).cast("long"))
    return existing.unionByName(fresh.select(*existing.columns))


#: Partitions of a stored table of keys and windows.
BUCKETS = 256


def bucketed(rows: DataFrame, id_: str, buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(id_), F.lit(buckets)).cast("int"))


def store(rows: DataFrame, path: str, id_: str, buckets: int = BUCKETS) -> None:
    """A table in folders by a hash of the id, for `restore`."""
    bucketed(rows, id_, buckets).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def restore(changed: DataFrame, path: str, id_: str, buckets: int = BUCKETS) -> None:
    """K-4: changed rows (all those of their ids) take the place of the stored table's rows of the same ids; only the folders of
    their buckets are written, the others keep their files. Without changed rows nothing is written.

    The new folders are written beside the table first, since they are made of the old ones.
    """
    spark = changed.sparkSession
    beside = f"{path}.next-{uuid.uuid4().hex}"
    new = bucketed(changed, id_, buckets)
    old = spark.read.parquet(path).join(new.select("bucket").distinct(), "bucket", "left_semi").join(new.select(id_).distinct(), id_, "left_anti")
    old.select(*new.columns).unionByName(new).repartition("bucket").write.partitionBy("bucket").parquet(beside)
    next_ = spark.read.schema(new.schema).parquet(beside)
    if not next_.isEmpty():
        next_.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def reembedded(records: DataFrame, id_: str, key: Column, windows) -> DataFrame:
    """K-4's rows: (id, key, at, window) of the records with a text, keys and windows made anew; windows: key to array."""
    rows = records.select(id_, key.alias("key")).where("key <> ''")
    return rows.select(id_, "key", F.posexplode(windows(F.col("key"))).alias("at", "window"))


def write_version(table: DataFrame, folder: str) -> str:
    path = f"{folder}/{uuid.uuid4().hex}"
    table.write.parquet(path)
    return path
