import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from quotemill.llm import merkle


def table(n=700):
    rnd = random.Random(4)
    parts = ["Some words here", "and more, of them", "é🙂ü", ".", "!\n", "\n\n", "\n", "; ", "a", " long long words " * 4]
    ids = rnd.sample(range(-50, 10**12), n)
    return [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(30)))) for i in ids] + [(7, None), (9, ""), (7, "seven again")]


def test_against_plain_python_and_sql(spark):
    rows = table()
    df = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, fingerprint double")
    got = [tuple(r) for r in merkle.fingerprints(df).collect()]
    order = sorted((i, t or "") for i, t in rows)
    want = {}
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        want[i, t] = hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()
    assert sorted((r[0], r[2]) for r in got) == sorted((i, h) for (i, _), h in want.items())
    con = duckdb.connect()
    con.register("documents", df.drop("fingerprint").toPandas())
    assert sorted(con.sql(merkle.ORACLE_SQL).fetchall()) == sorted(got)


def test_no_python_in_the_plan(spark):
    plan = merkle.fingerprints(spark.createDataFrame(table(40), "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_edges(spark):
    one = merkle.fingerprints(spark.createDataFrame([(None, "x y"), (1, "abcd")], "doc_id long, text string"))
    got = {r.doc_id: r for r in one.collect()}
    assert got[None].near_edited == 1 and got[None].near_next == 0
    assert got[1].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and got[1].near_next == 1
    assert merkle.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_edits_are_located(spark):
    df = spark.createDataFrame([("a\nb\n\nc\nd", "a\nb\n\nc\nX")], "p string, q string")
    a, b = merkle.fingerprint(F.col("p")), merkle.fingerprint(F.col("q"))
    row = df.select(merkle.edits(a, b).alias("e"), merkle.edits(a, a).alias("none"), merkle.clauses_of(a).alias("c")).first()
    assert [(e.section, e.paragraphs) for e in row.e] == [(1, [1])] and row.none == [] and len(row.c) == 4
