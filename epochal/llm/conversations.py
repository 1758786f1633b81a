"""Conversation structure repair: the cheapest edits that give system? (user assistant)+, by a fold.

Rows of a conversation are put in order of their turn (nulls first; ties by
role, then text).  Windows flag each row's first fault: blank (nothing but
white space), duplicate (role and text seen earlier), truncated (the last
character is no sentence end).  A conversation's rows are then collected and
sorted, and ``aggregate()`` walks them with four states (nothing yet, after
system, after user, after assistant), each the cheapest ``(cost, audit)`` that
leads there; ``least`` over structs picks the cheaper, and among equals the
audit that is first in ASCII.

Edits: Keep; Rerole to user or assistant; Delete (the only edit of a blank or
duplicate row); Insert an empty user or assistant row.  Costs are parameters.
A row's state follows from its edits alone, so the audit is enough to write
the repaired rows.  With the default costs an Insert is never cheapest:
deleting the row that would be its partner (and a system row left alone) costs
at most 4.  Where costs make Inserts cheap, equal costs are told apart by
audits as far as they go at each step.

Audits of a long conversation are not copied at every row: rows are walked in
chunks of ``CHUNK``; within a chunk a state holds its cost, the rank of the
audit before the chunk, the audit since, and where it came from, which orders
states as whole audits would.  The work is linear in rows but for one copy of
the audits a chunk.

A conversation is one row of one task from its collection on: its digest is a
hash over its whole repaired text, in order, so the contract needs it there.
Conversations themselves spread by their id; nothing else is grouped.

Defined cases: a null role or text is one space (its initial is a space, its
text blank); rows with a null conversation id are one conversation; a null
turn sorts first and counts in no gap; a conversation without rows has zeros,
an empty audit and the digest of an empty string; an empty table gives no
rows.  Other columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.llm.textstats import let

SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
CHUNK = 128
COSTS = {"keep": 0, "rerole": 1, "delete": 2, "insert": 5, "truncated": 5}
#: The states, and which a user or an assistant row may follow.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
BEFORE = {USER: (EMPTY, SYSTEM, ASSISTANT), ASSISTANT: (USER,), SYSTEM: (EMPTY,)}
UNREACHED = 1 << 60


def damaged(df: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``present``: rows harmed by the CRC-32 of ``conv_id:turn`` modulo 20.

    0: the row is gone (kept with ``present`` false, so that its conversation
    stays known); 1: its text is empty; 2: it has no sentence ends; 3: it comes
    twice; 4: its role is user.  Nulls are one space.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(harm == 1, "").when(harm == 2, F.translate(blank("text"), ENDS, "")).otherwise(blank("text"))
    copies = F.explode(F.array_repeat(harm != 0, F.when(harm == 3, 2).otherwise(1)))
    return df.select("conv_id", "turn", F.when(harm == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), copies.alias("present"))


def flagged(rows: DataFrame) -> DataFrame:
    """Adds ``fault``: 1 blank, 2 duplicate, 3 truncated, 0 none.  Rows of a conversation share one exchange."""
    bare = F.rtrim("text", F.lit(SPACES))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "present").orderBy("turn")) > 1
    dealt = rows.repartition("conv_id").withColumns({"again": again, "end": F.right(bare, F.lit(1))})
    fault = F.when(F.col("end") == "", 1).when(F.col("again"), 2).when(~F.col("end").isin(*ENDS), 3).otherwise(0)
    return dealt.withColumn("fault", fault).drop("again", "end")


def _state(cost: Column, rank: Column, audit: Column, origin: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), rank.cast("int").alias("rank"), audit.alias("audit"), origin.cast("int").alias("origin"))


def _plus(s: Column, cost: int | Column, initial: str) -> Column:
    return _state(s["cost"] + cost, s["rank"], F.concat(s["audit"], F.lit(initial)), s["origin"])


def _least(states: list[Column]) -> Column:
    return states[0] if len(states) == 1 else F.least(*states)


def _inserted(at: Column, costs: dict[str, int]) -> Column:
    """The four states, where up to two rows may have been inserted (no state is further from another)."""
    add = lambda s: _plus(s, costs["insert"], "I")

    def one(a: Column) -> Column:
        return F.array(a[EMPTY], a[SYSTEM], _least([a[USER], *(add(a[p]) for p in BEFORE[USER])]), _least([a[ASSISTANT], add(a[USER])]))

    return let(one(at), one)


def _step(at: Column, row: Column, costs: dict[str, int]) -> Column:
    """The four states after a row's edit."""
    must_go, late = row["fault"].isin(1, 2), F.when(row["fault"] == 3, costs["truncated"]).otherwise(0)
    never = F.lit(UNREACHED)
    initial = F.left(row["role"], F.lit(1))

    def to(state: int, letter: str) -> list[Column]:
        out = [_plus(at[state], costs["delete"], "D")]
        for p in BEFORE[state]:
            out.append(_plus(at[p], F.when(must_go | (initial != letter), never).otherwise(costs["keep"] + late), "K"))
            if state != SYSTEM:
                out.append(_plus(at[p], F.when(must_go, never).otherwise(costs["rerole"] + late), "R"))
        return out

    return F.array(_plus(at[EMPTY], costs["delete"], "D"), *(_least(to(s, x)) for s, x in ((SYSTEM, "s"), (USER, "u"), (ASSISTANT, "a"))))


def cheapest(rows: Column, costs: dict[str, int]) -> Column:
    """``(cost, audit)`` of the cheapest edits of ``rows`` (sorted structs of ``role``, ``text`` and ``fault``)."""
    start = F.array(*(F.struct(F.lit(0 if s == EMPTY else UNREACHED).cast("long").alias("cost"), F.lit("").alias("audit")) for s in range(4)))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(rows) - 1, F.lit(0)), F.lit(CHUNK)), lambda i: F.slice(rows, i + 1, F.lit(CHUNK)))

    def chunk(before: Column, part: Column) -> Column:
        order = F.array_sort(F.transform(before, lambda s: s["audit"]))
        ranked = F.transform(before, lambda s, i: _state(s["cost"], F.array_position(order, s["audit"]), F.lit(""), i))
        after = F.aggregate(part, ranked, lambda at, row: let(_inserted(at, costs), lambda a: _step(a, row, costs)))
        cap = F.lit(UNREACHED)
        return F.transform(after, lambda s: F.struct(F.least(s["cost"], cap).alias("cost"), F.concat(F.get(before, s["origin"])["audit"], s["audit"]).alias("audit")))

    def last(before: Column) -> Column:
        whole = F.transform(before, lambda s: _state(s["cost"], F.lit(0), s["audit"], F.lit(0)))
        return let(_inserted(whole, costs), lambda a: F.least(a[EMPTY], a[ASSISTANT]))

    return F.aggregate(chunks, start, chunk, last)


def repaired(rows: Column, audit: Column) -> Column:
    """The repaired rows as lines ``role:text``, from a conversation's rows and its audit."""
    letters = F.filter(F.split(audit, ""), lambda x: x != "")
    # of each letter the row that it is about: Inserts are about none, and shift what follows
    plain = F.zip_with(letters, rows, lambda x, r: F.struct(x.alias("edit"), r["role"].alias("role"), r["text"].alias("text")))
    shifted = F.transform(
        letters,
        lambda x, i: let(
            F.get(rows, i - F.size(F.filter(F.slice(letters, F.lit(1), i), lambda y: y == "I"))),
            lambda r: F.struct(x.alias("edit"), F.when(x != "I", r["role"]).alias("role"), F.when(x == "I", "").otherwise(r["text"]).alias("text")),
        ),
    )
    left = F.filter(F.when(F.contains(audit, F.lit("I")), shifted).otherwise(plain), lambda x: x["edit"] != "D")

    def lines(kept: Column) -> Column:
        system = (F.get(kept, F.lit(0))["edit"] == "K") & (F.left(F.get(kept, F.lit(0))["role"], F.lit(1)) == "s")
        ahead = F.when(system, 1).otherwise(0)
        made = lambda x, i: F.when(x["edit"] == "K", x["role"]).when((i - ahead) % 2 == 0, "user").otherwise("assistant")
        return F.transform(kept, lambda x, i: F.concat(made(x, i), F.lit(":"), x["text"]))

    return let(left, lines)


def repair(rows: DataFrame, costs: dict[str, int] | None = None) -> DataFrame:
    """Of each conversation its faults, cost, audit and repaired text.

    ``rows``: ``conv_id``, ``turn``, ``role``, ``text`` and, if there are rows
    that only name their conversation, ``present``.  Returns ``conv_id``,
    ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``,
    ``audit``, ``repaired`` (lines of ``role:text``) and ``repaired_sha256``.
    """
    costs = COSTS | (costs or {})
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    known = flagged(rows.select("conv_id", "turn", space("role"), space("text"), present.alias("present")))
    row, here = F.struct("turn", "role", "text", "fault"), F.col("present")
    count = lambda k: F.count_if(here & (F.col("fault") == k)).alias(("blank", "duplicate", "truncated")[k - 1])
    held = known.groupBy("conv_id").agg(count(1), count(2), count(3), F.array_sort(F.collect_list(F.when(here, row))).alias("rows"))
    turns = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    gaps = F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns)), F.lit(0)).cast("long")
    initials = F.transform("rows", lambda r: F.left(r["role"], F.lit(1)))
    pairs = let(initials, lambda x: F.zip_with(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: F.concat(a, b)))
    illegal = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")
    best = held.withColumns({"gaps": gaps, "illegal": illegal, "best": cheapest(F.col("rows"), costs)})
    best = best.withColumns({"cost": F.col("best.cost"), "audit": F.col("best.audit")})
    out = best.withColumn("repaired", repaired(F.col("rows"), F.col("audit")))
    digest = F.sha2(F.array_join("repaired", "\n"), 256)
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired", digest.alias("repaired_sha256"))


#: Costs written out; Inserts are left out, as with these costs none is ever cheapest.
SQL = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY n) AS tab FROM (
  SELECT n, list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS codes FROM conversations),
crc AS (SELECT raw.* EXCLUDE (codes), xor(list_reduce(list_concat([4294967295], codes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h FROM raw, tab),
dmg AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM dmg),
flt AS (SELECT conv_id, i, turn, role, text, left(role, 1) AS r, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM num),
cnt AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations),
-- the four states: nothing yet, after system, after user, after assistant
walk AS (SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': ''} AS e, {'c': 1000000000::BIGINT, 'a': ''} AS s, {'c': 1000000000::BIGINT, 'a': ''} AS u, {'c': 1000000000::BIGINT, 'a': ''} AS x FROM ids
  UNION ALL SELECT w.conv_id, f.i, {'c': w.e.c + 2, 'a': w.e.a || 'D'},
    list_sort([{'c': w.s.c + 2, 'a': w.s.a || 'D'}, {'c': w.e.c + CASE WHEN r = 's' AND fault IN (0, 3) THEN CASE fault WHEN 3 THEN 5 ELSE 0 END ELSE 1000000000 END, 'a': w.e.a || 'K'}])[1],
    list_sort(list_concat([{'c': w.u.c + 2, 'a': w.u.a || 'D'}], list_transform([w.e, w.s, w.x], lambda p: {'c': p.c + CASE WHEN fault IN (1, 2) THEN 1000000000 WHEN fault = 3 THEN 5 ELSE 0 END + CASE WHEN r = 'u' THEN 0 ELSE 1 END, 'a': p.a || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END})))[1],
    list_sort([{'c': w.x.c + 2, 'a': w.x.a || 'D'}, {'c': w.u.c + CASE WHEN fault IN (1, 2) THEN 1000000000 WHEN fault = 3 THEN 5 ELSE 0 END + CASE WHEN r = 'a' THEN 0 ELSE 1 END, 'a': w.u.a || CASE WHEN r = 'a' THEN 'K' ELSE 'R' END}])[1]
  FROM walk w JOIN flt f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1),
fin AS (SELECT conv_id, list_sort([e, x])[1] AS best FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS k FROM walk) WHERE k = 1),
kpt AS (SELECT f.conv_id, f.i, f.role, f.text, f.r, best.a[f.i] AS edit, row_number() OVER (PARTITION BY f.conv_id ORDER BY f.i) - 1 AS j FROM flt f JOIN fin ON f.conv_id IS NOT DISTINCT FROM fin.conv_id WHERE best.a[f.i] <> 'D'),
out AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - ahead) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS body
  FROM (SELECT *, max(CASE WHEN j = 0 AND edit = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS ahead FROM kpt) GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c AS cost, best.a AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids JOIN fin ON ids.conv_id IS NOT DISTINCT FROM fin.conv_id LEFT JOIN cnt ON ids.conv_id IS NOT DISTINCT FROM cnt.conv_id LEFT JOIN out ON ids.conv_id IS NOT DISTINCT FROM out.conv_id"""
