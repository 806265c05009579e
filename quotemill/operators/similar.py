"""Exact similarity joins of keys: by the best stretch of trigrams (C-4) and by the Indel ratio (C-1).

Pairs first meet on grams that a partner must share, and the rest is verified. Equal keys are one class each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import grams as G
from .work import work_table

#: Of a probe's rarest grams, so many must be shared before sets are compared.
FIRST_SHARED = 4
#: Probes that look at a window together, about.
TOGETHER = 64


def _spread(df: DataFrame) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _codes(key: Column) -> Column:
    @F.pandas_udf("array<long>")
    def udf(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: np.unique(G.grams(k)))

    return udf(key)


def _windows(classes: DataFrame, kinds: int) -> DataFrame:
    """class_id, at, row: the windows of each class's trigrams."""

    def work(batches):
        for batch in batches:
            for class_id, key in zip(batch.column("class_id"), batch.column("key").to_pylist()):
                found = G.windows(G.grams(key), kinds)
                yield pa.RecordBatch.from_pydict({"class_id": pa.array([class_id.as_py()] * len(found), batch.schema.field("class_id").type), "at": pa.array(range(len(found)), pa.int32()), "row": pa.array(found, pa.list_(pa.int64()))})

    kind = classes.schema["class_id"].dataType.simpleString()
    return classes.select("class_id", "key").mapInArrow(work, f"class_id {kind}, at int, row array<long>")


def classes_of(records: DataFrame, id_: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """Of records(id_, key): (class_id = smallest id, key) of equal keys, and members (class_id, id_). Null ids and null or empty keys take no part."""
    known = records.where(f"{id_} is not null and key <> ''").select(id_, "key").distinct().withColumn("digest", F.sha2("key", 256))
    classes = known.groupBy("digest").agg(F.min(id_).alias("class_id"), F.min("key").alias("key"))
    return classes.select("class_id", "key"), known.select(id_, "digest").join(classes.select("digest", "class_id"), "digest").select("class_id", id_)


def word_similar(probes: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(probe_id, class_id, similarity) of probes(probe_id, probe) and classes(class_id, key) whose word similarity is `least` or more.

    A stretch that reaches `least` has at most n / least kinds for a probe of n, and shares t = ceil(least * n) of them: it lies
    in one window of the class, and of the probe's n - t + s rarest trigrams that window has s (`FIRST_SHARED`). Nothing that
    reaches `least` is missed. Probes come in bands of n to its double, each with windows of its own size, so long ones don't
    widen the windows of the others. Probes without words have none.
    """
    wanted = probes.select("probe_id", _codes(F.col("probe")).alias("wanted")).withColumn("n", F.size("wanted")).where("n > 0")
    wanted = work_table(wanted.withColumn("band", F.length(F.bin("n"))))
    out = None
    for band in sorted(r.band for r in wanted.select("band").distinct().collect()):  # 31 at most
        found = _in_band(wanted.where(f"band = {band}"), classes, least, (1 << band) - 1)
        out = found if out is None else out.unionByName(found)
    return _in_band(wanted, classes, least, 1) if out is None else out


def _in_band(wanted: DataFrame, classes: DataFrame, least: float, most: int) -> DataFrame:
    """word_similar() of probes of `most` kinds at most."""
    kinds = int(most / least + 1e-9) + 1
    windows = _windows(classes, kinds)
    posts = windows.select("class_id", "at", F.explode(F.array_distinct("row")).alias("gram"))
    # a hair under the product: what rounding makes of it must not ask for one more
    shared = F.ceil(least * F.col("n") - 1e-9)
    rows = wanted.select("probe_id", "n", shared.alias("t"), F.least(shared, F.greatest(F.floor(shared / 3), F.lit(FIRST_SHARED))).alias("s"), F.explode("wanted").alias("gram"))
    df = posts.join(rows.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rarest = Window.partitionBy("probe_id").orderBy("df", "gram")
    first = rows.join(df, "gram", "left").na.fill(0, ["df"]).withColumn("i", F.row_number().over(rarest)).where(F.col("i") <= F.col("n") - F.col("t") + F.col("s")).where("df > 0")
    met = first.select("probe_id", "s", "gram").join(posts, "gram").groupBy("probe_id", "class_id", "at", "s").agg(F.count(F.lit(1)).alias("c")).where("c >= s")
    met = work_table(met.select("probe_id", "class_id", "at"))
    looked_at = _windows(classes.join(met.select("class_id").distinct(), "class_id", "left_semi"), kinds)
    # a window travels once for so many probes, however many meet it
    blocks = met.groupBy("class_id", "at").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("blocks"))
    asked = met.join(blocks, ["class_id", "at"]).join(wanted.select("probe_id", "wanted"), "probe_id")
    asked = asked.groupBy("class_id", "at", F.pmod(F.xxhash64("probe_id"), F.col("blocks"))).agg(F.collect_list(F.struct("probe_id", "wanted")).alias("probes"))

    @F.pandas_udf("array<double>")
    def best(probes: pd.Series, row: pd.Series) -> pd.Series:
        def all_of(wanted: np.ndarray, row: np.ndarray) -> list[float]:
            last = G.last_places(row)
            kinds = row[last == 0]
            # of the window's kinds enough must be wanted ones, before any stretch is looked at
            return [G.best_extent(a, row, least, last) if np.isin(a, kinds).sum() >= least * len(a) - 1e-9 else 0.0 for a in wanted]

        return pd.Series([all_of(a, np.asarray(b)) for a, b in zip(probes, row)], dtype=object)

    rows = _spread(asked.select("class_id", "at", "probes").join(looked_at, ["class_id", "at"]))
    rows = rows.select("class_id", "probes.probe_id", best("probes.wanted", "row").alias("similarity")).select("class_id", F.explode(F.arrays_zip("probe_id", "similarity")).alias("x"))
    found = rows.select("x.probe_id", "class_id", "x.similarity").where(F.col("similarity") >= least)
    return found.groupBy("probe_id", "class_id").agg(F.max("similarity").alias("similarity"))


#: Probes of one pack; characters of the keys that meet them together, about.
PROBES_TOGETHER, KEYS_TOGETHER = 256, 1 << 18


def _top_bounds(wanted: DataFrame, classes: DataFrame, least: float, k: int) -> DataFrame:
    """(probe_id, class_id, lower, upper): bounds of the similarity of wanted(probe_id, wanted, n) and classes(class_id, key), of all pairs that may
    reach `least` and be among a probe's k most similar ones.

    Packs of probes meet keys some hundred thousand characters together; the work is bounds by bits (`functions.grams.Queries`), no gram is a row. A task
    keeps the k largest lower bounds it saw of a probe: what can't reach the least of them is left out.
    """
    wide = wanted.withColumn("words", F.ceil(F.col("n") / 64))
    blocks = wide.groupBy("words").agg(F.ceil(F.count(F.lit(1)) / PROBES_TOGETHER).alias("blocks"))
    packs = wide.join(blocks, "words").groupBy("words", F.pmod(F.xxhash64("probe_id"), F.col("blocks")).alias("block"))
    packs = work_table(packs.agg(F.collect_list(F.struct("probe_id", "wanted")).alias("probes")))
    total = classes.agg(F.sum(F.length("key"))).first()[0] or 0
    chunks = classes.groupBy(F.pmod(F.xxhash64("class_id"), F.lit(-(-total // KEYS_TOGETHER) or 1))).agg(F.collect_list(F.struct("class_id", "key")).alias("classes"))
    kinds = {name: df.schema[name].dataType for df, name in ((wanted, "probe_id"), (classes, "class_id"))}

    def work(batches):
        seen, last, asked = {}, None, None
        for batch in batches:
            for i in range(len(batch)):
                probes, rows = batch.column("probes")[i].values, batch.column("classes")[i].values
                pack = batch.column("words")[i].as_py(), batch.column("block")[i].as_py()
                if pack != last:
                    last, asked = pack, G.Queries([np.array(x) for x in probes.field("wanted").to_pylist()])
                best = seen.setdefault(pack, np.full((len(asked.n), k), -1.0))
                at, by, low, high = [], [], [], []
                for c, key in enumerate(rows.field("key").to_pylist()):
                    row = G.grams(key)
                    some, lower, upper = G.candidates(asked, row, np.maximum(best.min(axis=1), least)) if len(row) else ([], [], [])
                    if len(some):
                        least_of = best[some].argmin(axis=1)
                        more = lower > best[some, least_of]
                        best[some[more], least_of[more]] = lower[more]
                        at += [c] * len(some)
                        by += some.tolist()
                        low += lower.tolist()
                        high += upper.tolist()
                if at:
                    ids = probes.field("probe_id").take(pa.array(by)), rows.field("class_id").take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(low, pa.float64()), pa.array(high, pa.float64())], ["probe_id", "class_id", "lower", "upper"])

    met = _spread(chunks).select("classes").crossJoin(packs)
    found = met.mapInArrow(work, f"probe_id {kinds['probe_id'].simpleString()}, class_id {kinds['class_id'].simpleString()}, lower double, upper double")
    found = work_table(found)
    nth = Window.partitionBy("probe_id").orderBy(F.desc("lower"))
    enough = found.withColumn("i", F.row_number().over(nth)).where(F.col("i") == k).select("probe_id", F.col("lower").alias("enough"))
    # bounds are four-byte numbers
    rows = found.join(enough, "probe_id", "left").withColumn("least", F.greatest(F.lit(least), F.coalesce(F.col("enough") - G.HAIR, F.lit(0.0))))
    return rows.where(F.col("upper") >= F.col("least") - G.HAIR).select("probe_id", "class_id", "least")


def top_similar(probes: DataFrame, records: DataFrame, least: float, k: int) -> DataFrame:
    """(probe_id, record_id, similarity, rank): of each probe the k records most similar to it, of equal ones the smaller ids first.

    Only classes whose bound reaches the probe's k-th largest lower bound are compared, by their best stretch; those are never fewer than k, and the
    others are less similar than all of them.
    """
    classes, members = classes_of(records)
    classes = work_table(classes)
    early = members.withColumn("i", F.row_number().over(Window.partitionBy("class_id").orderBy("record_id"))).where(F.col("i") <= k).drop("i")
    wanted = work_table(probes.select("probe_id", _codes(F.col("probe")).alias("wanted")).withColumn("n", F.size("wanted")).where("n > 0"))
    met = work_table(_top_bounds(wanted, classes, least, k))
    blocks = met.groupBy("class_id").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("blocks"))
    asked = met.join(blocks, "class_id").join(wanted.select("probe_id", "wanted"), "probe_id")
    asked = asked.groupBy("class_id", F.pmod(F.xxhash64("probe_id"), F.col("blocks"))).agg(F.collect_list(F.struct("probe_id", "wanted", "least")).alias("probes"))

    @F.pandas_udf("array<double>")
    def similar(keys: pd.Series, wanted: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series([G.best_extents(list(w), G.grams(key), np.asarray(x)) for key, w, x in zip(keys, wanted, least)], dtype=object)

    rows = _spread(asked.select("class_id", "probes").join(classes, "class_id"))
    rows = rows.select("class_id", "probes.probe_id", similar("key", "probes.wanted", "probes.least").alias("similarity"))
    found = rows.select("class_id", F.explode(F.arrays_zip("probe_id", "similarity")).alias("x")).select("x.probe_id", "class_id", "x.similarity")
    best = Window.partitionBy("probe_id").orderBy(F.desc("similarity"), "record_id")
    found = found.where(F.col("similarity") >= least).join(early, "class_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("probe_id", "record_id", "similarity", "rank")


# ---- Indel ratio ---------------------------------------------------------------------------------------------------

#: Seeds that meet inputs together, and input keys of one pack.
SEEDS_TOGETHER, INPUTS_TOGETHER = 1024, 4096


def _packs(asked: DataFrame, longest: float) -> DataFrame:
    """band, keys: the input keys of asked(key), some thousand together, beside each band (bits of the length) of seeds they can be near to."""

    def work(batches):
        for batch in batches:
            keys = batch.column(0)
            n = np.array([len(k) for k in keys.to_pylist()])
            low, high = (np.frexp(np.maximum(np.floor(x), 1))[1] for x in (np.ceil(n / longest - 1e-9), n * longest + 1e-9))
            for band in range(int(low.min(initial=99)), int(high.max(initial=0)) + 1):
                mine = np.flatnonzero((low <= band) & (band <= high))
                for i in range(0, len(mine), INPUTS_TOGETHER):
                    part = keys.take(pa.array(mine[i : i + INPUTS_TOGETHER])).to_pylist()
                    yield pa.RecordBatch.from_pydict({"band": pa.array([band], pa.int32()), "keys": pa.array([part], pa.list_(pa.string()))})

    return asked.mapInArrow(work, "band int, keys array<string>")


def near_equal(inputs: DataFrame, seed: DataFrame, least: int = 90) -> DataFrame:
    """J-14's pairs: (input_key, seed_key, ratio) of different keys of inputs(key) and seed(key) at an Indel ratio of `least` or more.

    Keys meet in packs: some thousand inputs beside the seeds of a band of lengths, in blocks of `SEEDS_TOGETHER`; no gram is a row. In a
    pack `functions.grams.near_pairs` counts shared trigrams by a product of matrices, drops what too few are shared of for the
    edits that the lengths allow, and works out the common lengths of the others side by side. Empty and null keys have no pairs.
    """
    known = lambda df: df.where("key <> ''").select("key").distinct()
    longest = (200 - least) / least
    given = work_table(known(seed).withColumn("band", F.length(F.bin(F.length("key"))).cast("int")))
    blocks = given.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / SEEDS_TOGETHER).alias("blocks"))
    dealt = given.join(blocks, "band").groupBy("band", F.pmod(F.xxhash64("key"), F.col("blocks")))
    seeds = work_table(dealt.agg(F.collect_list("key").alias("seeds")).select("band", "seeds"))

    def work(batches):
        for batch in batches:
            for keys, seeds in zip(batch.column("keys"), batch.column("seeds")):
                for found in G.near_pairs(keys.as_py(), seeds.as_py(), least):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.string(), pa.string(), pa.float64()))], ["input_key", "seed_key", "ratio"])

    met = _packs(known(inputs), longest).join(seeds, "band").select("keys", "seeds")
    return met.mapInArrow(work, "input_key string, seed_key string, ratio double")


def unseen(inputs: DataFrame, seed: DataFrame, least: int = 90) -> DataFrame:
    """J-14: the rows of inputs, all columns, whose `key` is at no ratio of `least` or more to a key of seed(key). Rows with a null or
    empty key stay."""
    near = near_equal(inputs, seed, least).select(F.col("input_key").alias("key")).distinct()
    return inputs.join(near, "key", "left_anti").select(*inputs.columns)
