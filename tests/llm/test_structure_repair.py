import hashlib
import itertools
import random
import zlib

import duckdb
import pytest

from quotemill.llm import structure_repair as sr

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
        row = (conv, turn, "user" if hit == 4 else role, text)
        yield from [row] * (0 if hit == 0 else 2 if hit == 3 else 1)


def faults(rows):
    seen = set()
    for _, _, role, text in rows:
        shown = text.rstrip(SPACE)
        yield "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))


def ways(rows, found):
    """Every way, as (cost, letters, roles and texts that stay): at most one row put in before each row and at the end."""
    options = []
    for (_, _, role, text), fault in zip(rows, found):
        cut = 5 if fault == "truncated" else 0
        one = [(2, "D", [])]
        if fault not in ("blank", "duplicate"):
            one += [(cut, "K", [(role, text)])] + [(1 + cut, "R", [(x, text)]) for x in ("user", "assistant")]
        put = [(0, "", [])] + [(5, "I", [(x, "")]) for x in ("user", "assistant")]
        options.append([(a + c, b + d, e + f) for a, b, e in put for c, d, f in one])
    options.append([(0, "", [])] + [(5, "I", [(x, "")]) for x in ("user", "assistant")])
    for way in itertools.product(*options):
        yield sum(w[0] for w in way), "".join(w[1] for w in way), [r for w in way for r in w[2]]


def allowed(roles):
    s = "".join(r[:1] for r in roles)
    if any(not r for r in roles):
        return False
    s = s[1:] if s.startswith("s") and len(s) > 1 else s
    return s == "ua" * (len(s) // 2)


def wanted(table):
    for conv in {r[0] for r in table}:
        rows = list(damage(r for r in table if r[0] == conv))
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(f"{r[2]}:{r[3]}".encode()).hexdigest()))
        found = list(faults(rows))
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, kept = min(w for w in ways(rows, found) if allowed([r for r, _ in w[2]]))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        yield conv, gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def made(n, longest=6):
    rnd = random.Random(n)
    for conv in range(n):
        for turn in range(rnd.randrange(1, longest)):
            if rnd.random() < 0.9:
                role = rnd.choice(["user", "assistant", "system", "tool", "", None, "umpire"]) if rnd.random() < 0.5 else ["user", "assistant"][turn % 2]
                yield conv, rnd.choice([turn, turn, turn, None, 2 * turn]), role, rnd.choice(["Yes. ", "no", "", None, " \n\t", "A?\n", "é🙂!", "same."])


@pytest.mark.parametrize("stretch", [1, 2, 256])
def test_against_every_way(spark, monkeypatch, stretch):
    monkeypatch.setattr(sr, "STRETCH", stretch)
    table = [*made(120), (None, 1, "user", "x."), (None, 1, "user", "x."), (-4, None, None, None), (-5, 3, "user", "twice."), (-5, 3, "user", "twice.")]
    df = spark.createDataFrame([(t, c, n, r, "") for c, n, r, t in table], "text string, conv_id long, turn long, role string, audit string")
    got = [tuple(r) for r in sr.repair(df).collect()]
    assert sorted(got, key=repr) == sorted(wanted(table), key=repr)


def test_long_conversations_against_sql(spark):
    """One conversation holds most rows; stretches of it and whole ones give the same."""
    rnd = random.Random(12)
    rows = [(7, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", "b", f"t{t}.", ""]) + "z" * (9000 * (t == 11)) + ".") for t in range(700)] + list(made(40, 12))
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    df = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    con.execute("CREATE VIEW conversations AS SELECT * FROM documents")
    got = sorted((tuple(r) for r in sr.repair(df).collect()), key=repr)
    assert sorted(con.sql(sr.ORACLE_SQL).fetchall(), key=repr) == got


def test_stretches_join_to_the_whole():
    rnd = random.Random(3)
    for _ in range(300):
        rows = [(rnd.choice("suaxt"), rnd.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rnd.randrange(1, 12))]
        whole = sr.least(rows, sr.weighed(sr.LAST, len(rows), True))
        cut = rnd.randrange(len(rows))
        a, b = rows[:cut], rows[cut:]
        behind = sr.least(b, sr.weighed(sr.LAST, len(b), True))
        costs = [sr.cost_of(w, len(b)) for w in behind]
        front = sr.least(a, sr.weighed(costs, len(a), False))
        for role in range(4):
            audit = sr.audit_of(front[role], len(a))
            end = sr.walked(audit, role, a)[0]
            assert audit + sr.audit_of(behind[end], len(b)) == sr.audit_of(whole[role], len(rows))
            assert sr.cost_of(front[role], len(a)) == sr.cost_of(whole[role], len(rows))


def test_empty(spark):
    assert sr.repair(spark.createDataFrame([], SCHEMA)).count() == 0
