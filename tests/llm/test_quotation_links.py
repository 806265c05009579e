import random
import re

import duckdb
import pytest

from quotemill.llm import quotation_links as ql

TALK = [
    (1, 0, "user", "Where is the  station?\nAnd when does it open?"),
    (1, 1, "assistant", "> Where is the station?\nNorth of here."),
    (1, 2, "user", "Thanks a lot."),
    (1, 3, "assistant", "On Monday Ann wrote:\n> > And when does it open?\n> North of here.\nAt nine."),
    (1, 4, "user", "> not in any message\nok"),
    (2, 0, "user", "North of here."),
    (2, 5, "assistant", None),
    (None, 1, "user", "> North of here."),
    (2, None, "user", "x"),
    (2, 5, "assistant", "> north OF here."),
]


def brute(rows):
    key = lambda s: " ".join(re.sub(r"^(?:[ \t]*>)+", "", s).lower().split())
    parsed = []
    for conv, turn, role, text in rows:
        lines = []
        for line in (text or "").split("\n"):
            marks = re.match(r"(?:[ \t]*>)*", line)[0]
            lines.append((marks.count(">"), key(line), line))
        parsed.append((conv, turn, role, lines))
    out = []
    heads = {}
    for conv, turn in sorted({(c, t) for c, t, _, _ in parsed if c is not None and t is not None}):
        before = max((t for c, t, _, _ in parsed if c == conv and t is not None and t < turn), default=None)
        own, linked, best = {}, 0, None
        for c, t, _, lines in parsed:
            if c == conv and t is not None and t < turn:
                for d, k, _ in lines:
                    if d == 0 and k:
                        own[k] = max(own.get(k, -1), t)
        for c, t, _, lines in parsed:
            if (c, t) == (conv, turn):
                for d, k, _ in lines:
                    if d and k in own:
                        linked += 1
                        best = max(best or (-99, 0), (-d, own[k]))
        reply = best[1] if best else before
        heads[conv, turn] = (linked, reply, turn if before is None or reply != before else heads[conv, before][2])
    for conv, turn, role, lines in parsed:
        deep = [d for d, k, _ in lines if k]
        kept = [x for i, (d, _, x) in enumerate(lines) if d == 0 and not (i + 1 < len(lines) and lines[i + 1][0] and re.search(r"(?i)^[^>]*\b(wrote|schrieb|a écrit|escribió)[ \t]*:[ \t]*$", x))]
        out.append((conv, turn, role, max(deep, default=0), sum(d > 0 for d in deep), *heads.get((conv, turn), (0, None, None)), "\n".join(kept).strip(" ")))
    return out


def made(n=300):
    rnd = random.Random(3)
    said = ["Good morning", "the answer is  two", "why?", "x wrote:", "", "café Noir"]
    rows = []
    for i in range(n):
        text = "\n".join(rnd.choice(["", "", "> ", ">>", " > > "]) + rnd.choice(said) for _ in range(rnd.randrange(4)))
        rows.append((rnd.randrange(8), rnd.randrange(0, 60), rnd.choice(["user", "assistant"]), text))
    return rows


@pytest.mark.parametrize("block", [1024, 7])
@pytest.mark.parametrize("rows", [TALK, made()], ids=["talk", "made"])
def test_against_brute_force_and_sql(spark, monkeypatch, rows, block):
    monkeypatch.setattr(ql, "BLOCK", block)
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    order = lambda found: sorted(found, key=repr)
    got = order(tuple(r) for r in ql.link_quotations(df).collect())
    assert got == order(brute(rows))
    con = duckdb.connect()
    con.register("conversations", df.drop("depth").toArrow())
    assert order(con.sql(ql.ORACLE_SQL).fetchall()) == got


def test_conversations(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.branch): [m.turn for m in r.messages] for r in ql.conversations(ql.link_quotations(df)).collect()}
    assert found[1, 0] == [0, 1, 2] and found[1, 3] == [3, 4]
    assert ql.link_quotations(df.limit(0)).count() == 0


def walked(rows):
    """conv_id -> turns in reply order with their branches, by walking up the parents."""
    parents = {(c, t): r for c, t, _, _, _, _, r, _, _ in brute(rows) if c is not None and t is not None}
    firsts = {}
    for c, t in sorted(parents):
        firsts.setdefault((c, parents[c, t]), t)

    def branch(c, t):
        p = parents[c, t]
        return t if p is None or firsts[c, p] != t else branch(c, p)

    return {(c, t): (branch(c, t), p) for (c, t), p in parents.items()}


THREADS = [(1, 0, "user", "alpha"), (1, 1, "assistant", "beta"), (1, 2, "user", "> alpha\ngamma"), (1, 3, "assistant", "> beta\ndelta"), (1, 4, "user", "> gamma\nx"), (1, 5, "user", "> delta\ny")]


@pytest.mark.parametrize("block", [1024, 7])
@pytest.mark.parametrize("rows", [THREADS, TALK, made()], ids=["threads", "talk", "made"])
def test_reply_order_walks_parents(spark, monkeypatch, rows, block):
    monkeypatch.setattr(ql, "BLOCK", block)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = ql.reply_ordered(ql.link_quotations(df)).collect()
    assert len(got) == len(rows)
    want = walked(rows)
    for r in got:
        assert (r.branch, r.reply_to) == want.get((r.conv_id, r.turn), (None, None))
    for conv in {c for c, *_ in rows if c is not None}:
        placed = sorted((r.position, r.branch, r.turn) for r in got if r.conv_id == conv and r.turn is not None)
        assert [p for p, _, _ in placed] == list(range(len(placed)))
        assert [(b, t) for _, b, t in placed] == sorted((b, t) for _, b, t in placed)
        seen = set()
        for _, _, t in placed:
            assert want[conv, t][1] is None or want[conv, t][1] in seen
            seen.add(t)
    if rows is THREADS:
        assert [t for _, t in sorted((r.position, r.turn) for r in got)] == [0, 1, 3, 5, 2, 4]


def test_reply_order_is_a_query(spark, tmp_path):
    from quotemill.llm import queries

    spark.createDataFrame(THREADS, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.queries()["op1_reply_ordered"](spark, str(tmp_path)).collect()
    assert [r.branch for r in sorted(found, key=lambda r: r.turn)] == [0, 0, 2, 0, 2, 0]
    assert ql.reply_ordered(ql.link_quotations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


@pytest.mark.parametrize("rows", [TALK, made()], ids=["talk", "made"])
def test_reply_order_against_sql(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[0] is not None], "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in ql.reply_ordered(ql.link_quotations(df)).collect()), key=repr)
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    assert sorted(con.sql(ql.ORDERED_SQL).fetchall(), key=repr) == got
