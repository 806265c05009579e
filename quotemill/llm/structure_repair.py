"""Repair of damaged conversations: the cheapest edits that make the roles `(s?(ua)+)?`, by one shortest path of whole numbers.

Nodes are (rows read, role of the last row kept or put in, whether something was put in before the next row); each edit is an
edge. The weight of a way is one whole number: its cost in the high digits, below it the letters of its edits from left to
right, `DIGIT` bits each in a fixed width, with zeros at the end. The least number is the cheapest way and, among those, the
one whose letters are ASCII-least; nothing else is compared. From a node each letter leads to one node only, so ways of one
stretch of rows are never one another's beginning, and the least way of a stretch doesn't depend on what follows but for the
costs of what follows from where it ends.

So a conversation is cut into stretches of `STRETCH` rows, whatever its length. First each stretch gives the least cost from
each role to each role (16 numbers), which are added up from the end; then each stretch finds its least ways, with those costs
behind it; then the stretches' ways are joined from the start. A task holds the rows of a few stretches, numbers of a stretch's width, and
of one conversation 16 numbers for each stretch. Two put-in rows between two rows never pay, so at most one is tried.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import columns, crc_sql, materialize, numbered, per_batch, tune

#: Rows that are decided together.
STRETCH = 256
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
DIGIT = 3
#: Letters in ASCII order, from 1: 0 is the end.
LETTERS = "DIKR"
D, I, K, R = range(1, 5)
#: Role of the last row: none yet, system, user, assistant; and what a new row would be after it.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLE = ["", "system", "user", "assistant"]
NEXT = [USER, USER, ASSISTANT, USER]
ENDS = (NONE, ASSISTANT)
NEVER = 1 << 50
SPACES = " \t\n\x0b\x0c\r"
#: Conversations end where roles may end; a missing answer may be put in.
LAST = [0, NEVER, INSERT, 0]


def kept(role: int, initial: str) -> int | None:
    """The role after a row is kept as it is; None if it can't be."""
    if initial == "s":
        return SYSTEM if role == NONE else None
    return {"u": USER, "a": ASSISTANT}.get(initial) if initial and NEXT[role] == {"u": USER, "a": ASSISTANT}.get(initial) else None


def edits(role: int, initial: str, fault: str) -> list[tuple[int, int, int]]:
    """(letter, cost, role after it) of what may become of a row."""
    out = [(D, DELETE, role)]
    if fault not in ("blank", "duplicate"):
        cut = CUT if fault == "truncated" else 0
        out.append((R, REROLE + cut, NEXT[role]))
        if (to := kept(role, initial)) is not None:
            out.append((K, KEEP + cut, to))
    return out


def least(rows: list[tuple[str, str]], behind: list[int]) -> list[int]:
    """For each role before rows of (initial, fault) the weight of the least way, given the weights of the roles behind them.

    Weights have a digit for each of 2 * len(rows) + 1 letters: `weighed` makes them of costs.
    """
    width = DIGIT * (2 * len(rows) + 1)
    high, low = 1 << width, (1 << width) - 1
    letter = [x << width - DIGIT for x in range(5)]

    def before(x: int, cost: int, weight: int) -> int:
        digits = weight & low
        return weight - digits + cost * high + letter[x] + (digits >> DIGIT)

    for initial, fault in reversed(rows):
        direct = [min(before(x, cost, behind[to]) for x, cost, to in edits(role, initial, fault)) for role in range(4)]
        behind = [min(direct[role], before(I, INSERT, direct[NEXT[role]])) for role in range(4)]
    return behind


def weighed(costs: list[int], n: int, last: bool) -> list[int]:
    """The weights behind n rows: costs, and at a conversation's end the letter of a row put in."""
    width = DIGIT * (2 * n + 1)
    return [(cost << width) + (I << width - DIGIT if last and role == USER else 0) for role, cost in enumerate(costs)]


def cost_of(weight: int, n: int) -> int:
    return weight >> DIGIT * (2 * n + 1)


def audit_of(weight: int, n: int) -> str:
    width = DIGIT * (2 * n + 1)
    out = []
    for at in range(width - DIGIT, -1, -DIGIT):
        x = weight >> at & (1 << DIGIT) - 1
        if not x:
            break
        out.append(LETTERS[x - 1])
    return "".join(out)


def least_costs(rows: list[tuple[str, str]]) -> list[int]:
    """The least cost of rows from each role (first) to each role, 16 numbers."""
    out = np.empty((4, 4), np.int64)
    for to in range(4):
        costs = [0 if role == to else NEVER for role in range(4)]
        out[:, to] = [min(cost_of(w, len(rows)), NEVER) for w in least(rows, weighed(costs, len(rows), False))]
    return out.ravel().tolist()


def walked(audit: str, role: int, rows: list[tuple[str, str]]) -> tuple[int, list[tuple[int | None, str]]]:
    """The role where the letters lead to, and the rows that stay: (number of the row or None if put in, new role or "")."""
    at, out = 0, []
    for x in audit:
        if x == "I":
            role = NEXT[role]
            out.append((None, ROLE[role]))
            continue
        if x == "K":
            role = kept(role, rows[at][0])
            out.append((at, ""))
        elif x == "R":
            role = NEXT[role]
            out.append((at, ROLE[role]))
        at += 1
    return role, out


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of conversations after damage, with their fault but for duplicates: conv, turn, role, text, digest, initial, fault."""
    rows = columns(conversations, conv_id="long", turn="long", role="string", text="string")
    hit = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    rows = rows.select(key().alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), hit.alias("hit")).where("hit <> 0")
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("_copy"))
    shown = F.rtrim("text", F.lit(SPACES))
    fault = F.when(shown == "", "blank").when(F.right(shown, F.lit(1)).isin(".", "!", "?"), "").otherwise("truncated")
    return rows.select("conv", "turn", "role", "text", F.unhex(F.sha2(F.concat_ws(":", "role", "text"), 256)).alias("digest"), F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def key():
    """A conversation's id as text; rows without one are one conversation."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(""))


def stretches(rows: DataFrame) -> DataFrame:
    """conv, stretch, last, items (array of place, role, digest, initial, fault, turn): written, one row for each stretch. Texts stay
    behind: their digests stand for them."""
    placed = numbered(rows.drop("text"), "conv", "turn", "role", "digest", written=False)
    again = placed.groupBy("conv", "digest", "role").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    known = placed.join(again, ["conv", "digest", "role"], "left")
    fault = F.when(F.col("fault") == "blank", "blank").when(F.col("place") > F.col("first"), "duplicate").otherwise(F.col("fault"))
    item = F.struct("place", "role", "digest", "initial", fault.alias("fault"), "turn")
    stretch = F.floor(F.col("place") / STRETCH).cast("long")
    packed = known.groupBy("conv", "total", stretch.alias("stretch")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return materialize(packed.select("conv", "stretch", (F.col("stretch") == F.floor((F.col("total") - 1) / STRETCH)).alias("last"), "items"))


def _counted(cut: DataFrame) -> DataFrame:
    """Of each stretch the least costs, and what the conversation's counts need."""

    def work(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("conv", "stretch", "costs", "blank", "duplicate", "truncated", "illegal", "first", "last_initial", "low", "high", "turns", "last_turn")}
            for conv, stretch, initials, faults, turns in zip(*(batch.column(c).to_pylist() for c in ("conv", "stretch", "initials", "faults", "turns"))):
                some = [t for t in turns if t is not None]
                pairs = zip(initials, initials[1:])
                row = (conv, stretch, least_costs(list(zip(initials, faults))), *(faults.count(f) for f in ("blank", "duplicate", "truncated")))
                row += (sum(a + b not in ("su", "ua", "au") for a, b in pairs), initials[0], initials[-1], min(some, default=None), max(some, default=None), len(set(some)), turns[-1])
                for name, x in zip(out, row):
                    out[name].append(x)
            yield out

    kind = "conv string, stretch long, costs array<long>, blank long, duplicate long, truncated long, illegal long, first string, last_initial string, low long, high long, turns long, last_turn long"
    return per_batch(_shape(cut), work, kind)


def _shape(cut: DataFrame) -> DataFrame:
    """Without texts."""
    return cut.select("conv", "stretch", "last", F.col("items.initial").alias("initials"), F.col("items.fault").alias("faults"), F.col("items.turn").alias("turns"))


def _behind(counted: DataFrame) -> DataFrame:
    """For each stretch the least cost of what follows it, by role; for a conversation's first also the conversation's counts."""
    fields = [c for c in counted.columns if c != "conv"]
    one = counted.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("all"))

    def work(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("conv", "stretch", "behind", "gaps", "blank", "duplicate", "truncated", "illegal")}
            for conv, all_ in zip(batch.column("conv").to_pylist(), batch.column("all")):
                rows = {name: all_.values.field(name).to_pylist() for name in fields}
                n, costs, found = len(rows["stretch"]), LAST, []
                for i in range(n - 1, -1, -1):
                    found.append(costs)
                    m = rows["costs"][i]
                    costs = [min(NEVER, min(m[4 * a + b] + costs[b] for b in range(4))) for a in range(4)]
                seam = sum(a + b not in ("su", "ua", "au") for a, b in zip(rows["last_initial"], rows["first"][1:]))
                # turns ascend: a stretch that begins with the turn that the one before ended with has it twice
                twice = sum(a is not None and a == b for a, b in zip(rows["last_turn"], rows["low"][1:]))
                low, high = ([x for x in rows[c] if x is not None] for c in ("low", "high"))
                gaps = max(high) - min(low) + 1 - sum(rows["turns"]) + twice if low else 0
                sums = [min(gaps, (1 << 63) - 1), *(sum(rows[c]) for c in ("blank", "duplicate", "truncated")), sum(rows["illegal"]) + seam]
                out["conv"] += [conv] * n
                out["stretch"] += rows["stretch"]
                out["behind"] += reversed(found)
                for name, x in zip(("gaps", "blank", "duplicate", "truncated", "illegal"), sums):
                    out[name] += [x] + [None] * (n - 1)
            yield out

    return per_batch(one, work, "conv string, stretch long, behind array<long>, gaps long, blank long, duplicate long, truncated long, illegal long")


def _ways(cut: DataFrame, behind: DataFrame) -> DataFrame:
    """For each stretch, from each role before it: the least way's letters, its cost with all behind it, and the role it ends in."""

    def work(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("conv", "stretch", "audits", "costs", "ends")}
            for conv, stretch, last, initials, faults, costs in zip(*(batch.column(c).to_pylist() for c in ("conv", "stretch", "last", "initials", "faults", "behind"))):
                rows = list(zip(initials, faults))
                weights = least(rows, weighed(costs, len(rows), last))
                audits = [audit_of(w, len(rows)) for w in weights]
                row = (conv, stretch, audits, [cost_of(w, len(rows)) for w in weights], [walked(a, role, rows)[0] for role, a in enumerate(audits)])
                for name, x in zip(out, row):
                    out[name].append(x)
            yield out

    return per_batch(_shape(cut).join(behind.select("conv", "stretch", "behind"), ["conv", "stretch"]), work, "conv string, stretch long, audits array<string>, costs array<long>, ends array<int>")


def _joined(ways: DataFrame) -> DataFrame:
    """For each stretch the role before it and its letters; for a conversation's first also the cost of all."""
    one = ways.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("stretch", "audits", "costs", "ends"))).alias("all"))

    def work(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("conv", "stretch", "role", "audit", "cost")}
            for conv, all_ in zip(batch.column("conv").to_pylist(), batch.column("all")):
                role = NONE
                for i, (stretch, audits, costs, ends) in enumerate(zip(*(all_.values.field(c).to_pylist() for c in ("stretch", "audits", "costs", "ends")))):
                    for name, x in zip(out, (conv, stretch, role, audits[role], None if i else costs[role])):
                        out[name].append(x)
                    role = ends[role]
            yield out

    return per_batch(one, work, "conv string, stretch long, role int, audit string, cost long")


def _lines(cut: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv, at (their order), role, digest (null if put in)."""
    rows = cut.join(joined.select("conv", "stretch", "role", "audit"), ["conv", "stretch"])
    rows = rows.select("conv", "stretch", "role", "audit", *(F.col(f"items.{c}").alias(f"{c}s") for c in ("role", "digest", "initial", "fault")))

    def work(batches):
        for batch in batches:
            out: dict[str, list] = {"conv": [], "at": [], "role": [], "digest": []}
            for conv, stretch, role, audit, roles, digests, initials, faults in zip(*(batch.column(c).to_pylist() for c in ("conv", "stretch", "role", "audit", "roles", "digests", "initials", "faults"))):
                for n, (at, new) in enumerate(walked(audit, role, list(zip(initials, faults)))[1]):
                    for name, x in zip(out, (conv, stretch << 32 | n, new if at is None else new or roles[at], None if at is None else digests[at])):
                        out[name].append(x)
            yield out

    return per_batch(rows, work, "conv string, at long, role string, digest binary")


def _hashed(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """conv, repaired_sha256: texts come back by their digests, and a conversation's lines pass in their order through one hash."""
    texts = rows.select("conv", "digest", "text").dropDuplicates(["conv", "digest"])
    with_text = lines.where("digest is not null").join(texts, ["conv", "digest"]).select("conv", "at", "role", "text")
    every = with_text.unionByName(lines.where("digest is null").select("conv", "at", "role", F.lit("").alias("text")))

    def work(batches):
        now, held, some = None, hashlib.sha256(), False
        for batch in batches:
            out: dict[str, list] = {"conv": [], "repaired_sha256": []}
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
                if conv != now:
                    if now is not None:
                        out["conv"].append(now)
                        out["repaired_sha256"].append(held.hexdigest())
                    now, held, some = conv, hashlib.sha256(), False
                held.update((("\n" if some else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                some = True
            yield out
        if now is not None:
            yield {"conv": [now], "repaired_sha256": [held.hexdigest()]}

    return per_batch(every.repartition("conv").sortWithinPartitions("conv", "at"), work, "conv string, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id of
    conversations(conv_id, turn, role, text), after the damage that `damaged` does.

    A null role or text is one space; rows without turn come first, rows that share a turn are ordered by role and by the SHA-256 of
    role and text, equal rows stay side by side. Rows without conv_id are one conversation, with a null id. A conversation
    that lost all its rows has zeros, an empty audit and the hash of nothing. An empty table gives an empty one; other
    columns play no part. The roles' initials are their first characters: other ones can't be kept.
    """
    tune(conversations.sparkSession)
    rows = damaged(conversations)
    cut = stretches(rows)
    behind = materialize(_behind(_counted(cut)))
    joined = materialize(_joined(_ways(cut, behind)))
    ids = columns(conversations, conv_id="long").distinct().withColumn("conv", key())
    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("stretch", "audit"))), lambda x: x["audit"]), "")
    whole = joined.groupBy("conv").agg(letters.alias("audit"), F.max("cost").alias("cost"))
    found = ids.join(behind.where("stretch = 0").drop("stretch", "behind"), "conv", "left").join(whole, "conv", "left").join(_hashed(_lines(cut, joined), rows), "conv", "left")
    counts = (F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    nothing = F.lit(hashlib.sha256().hexdigest())
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def _sql() -> str:
    def before(value, letter, cost, line):
        lines = f"list_prepend({line}, ({value}).t)" if line else f"({value}).t"
        return f"CASE WHEN ({value}) IS NULL THEN NULL ELSE {{'c': ({value}).c + {cost}, 'a': '{letter}' || ({value}).a, 't': {lines}}} END"

    steps = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    direct, put_in = [], []
    for role, (to, said) in steps.items():
        can = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[role]
        keeps = [f"CASE WHEN free AND initial = '{x}' THEN {before(f'v{t}', 'K', 'cut', 'role || chr(58) || text')} END" for x, t in can]
        options = [before(f"v{role}", "D", 2, ""), f"CASE WHEN free THEN {before(f'v{to}', 'R', '(1 + cut)', repr(said + ':') + ' || text')} END", *keeps]
        direct.append(f"list_min([{', '.join(options)}]) AS d{role}")
        put_in.append(f"list_min([d{role}, {before(f'd{to}', 'I', 5, repr(said + ':'))}]) AS v{role}")
    end = "{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}"
    blank = r"'[^\x20\x09-\x0D]'"
    crc = crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    return f"""
WITH RECURSIVE raw AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS hit FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw, LATERAL (SELECT unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy)),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(role || ':' || text)) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM damaged),
faulted AS MATERIALIZED (
  SELECT *, substr(role, 1, 1) AS initial, lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS following,
    CASE WHEN NOT regexp_matches(text, {blank}) THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
         WHEN list_last(regexp_extract_all(text, {blank})) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
usable AS MATERIALIZED (SELECT *, fault NOT IN ('blank', 'duplicate') AS free, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS cut FROM faulted),
ways AS (
  SELECT conv_id, max(n) AS place, {end} AS v0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS v1, {{'c': 5::BIGINT, 'a': 'I', 't': ['assistant:']}} AS v2, {end} AS v3 FROM placed GROUP BY conv_id
  UNION ALL SELECT conv_id, place, {', '.join(put_in)} FROM (
    SELECT w.conv_id, w.place - 1 AS place, {', '.join(direct)} FROM ways w JOIN usable r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.place = w.place)),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal FROM faulted GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce((w.v0).c, 0) AS cost, coalesce((w.v0).a, '') AS audit, sha256(coalesce(array_to_string((w.v0).t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ways w ON w.conv_id IS NOT DISTINCT FROM i.conv_id AND w.place = 0
"""


ORACLE_SQL = _sql()
