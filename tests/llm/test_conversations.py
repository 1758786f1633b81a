"""Conversation repair (12): every sequence of edits, a plain fold, damage by rows."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from epochal.llm import conversations

SPACE = "\x20\t\n\x0b\x0c\r"


def faults(rows):
    """Fault of each (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_edit(rows, found, costs):
    """The least (cost, audit, lines) over all edits of all rows, with up to two Inserts in every gap."""
    options = []
    for (role, text), fault in zip(rows, found, strict=True):
        late = costs["truncated"] if fault == "truncated" else 0
        some = [(costs["delete"], "D", [])]
        if fault not in ("blank", "duplicate"):
            some += [(costs["keep"] + late, "K", [(role, text)])] + [(costs["rerole"] + late, "R", [(r, text)]) for r in ("user", "assistant")]
        options.append(some)
    inserts = [(costs["insert"] * n, "I" * n, [(r, "") for r in p]) for n in range(3 if len(rows) < 3 else 2) for p in product(("user", "assistant"), repeat=n)]
    best = None
    for way in product(*[o for own in options for o in (inserts, own)], inserts):
        lines = [x for w in way for x in w[2]]
        if re.fullmatch("(s?(ua)+)?", "".join((r[:1] or "-") for r, _ in lines)):
            key = sum(w[0] for w in way), "".join(w[1] for w in way)
            if best is None or key < best[:2]:
                best = (*key, [f"{r}:{t}" for r, t in lines])
    return best


def plain_fold(rows, found):
    """The same without Inserts, a row at a time with whole audits."""
    none = (10**9, "")
    at = [(0, ""), none, none, none]
    for (role, _), fault in zip(rows, found, strict=True):
        must, late = fault in ("blank", "duplicate"), 5 * (fault == "truncated")
        new = [[(c + 2, a + "D")] for c, a in at]
        for state, letter, before in ((1, "s", (0,)), (2, "u", (0, 1, 3)), (3, "a", (2,))):
            for p in before:
                if not must and role[:1] == letter:
                    new[state].append((at[p][0] + late, at[p][1] + "K"))
                if not must and state > 1:
                    new[state].append((at[p][0] + late + 1, at[p][1] + "R"))
        at = [min(n) for n in new]
    return min(at[0], at[3])


def conversation(rng, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "umpire", "", " "]
    texts = ["Yes.", "No!", "and then", "", " \t", "Why?", "It is so.  ", "Or ."]
    return [(rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randint(0, 99)}" + rng.choice([".", "?", ""])) for _ in range(n)]


def repaired(spark, many, costs=None):
    rows = [(i, t, r, x, "x", 7) for i, own in enumerate(many) for t, (r, x) in enumerate(own)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault string, rows long")
    return {r.conv_id: r for r in conversations.repair(df, costs).collect()}


@pytest.mark.parametrize("costs", [conversations.COSTS, {"keep": 0, "rerole": 3, "delete": 4, "insert": 1, "truncated": 2}])
def test_no_sequence_of_edits_is_cheaper(spark, costs):
    rng = random.Random(3)
    many = [conversation(rng, n) for n in (1, 1, 2, 2, 2, 3, 3, 3, 3, 3, 4, 4)]
    got = repaired(spark, many, costs)
    for i, rows in enumerate(many):
        want = every_edit(rows, faults(rows), costs)
        assert got[i].cost == want[0]
        if costs == conversations.COSTS:
            assert (got[i].audit, got[i].repaired) == want[1:]
        else:
            lines = [tuple(x.split(":", 1)) for x in got[i].repaired]
            assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines))
            assert [t for _, t in lines if t] == [t for (_, t), e in zip(rows, got[i].audit.replace("I", ""), strict=True) if e != "D" and t]


def test_an_insert_is_written_where_it_is_cheap(spark):
    own = repaired(spark, [[("user", "One."), ("user", "Two."), ("assistant", "Three.")]], {"insert": 1, "rerole": 9, "delete": 9})[0]
    assert (own.cost, own.audit, own.repaired) == (1, "KIKK", ["user:One.", "assistant:", "user:Two.", "assistant:Three."])


def test_long_conversations_go_in_chunks(spark, monkeypatch):
    rng = random.Random(4)
    many = [conversation(rng, n) for n in (127, 128, 129, 300, 700)]
    many.append([("user" if i % 2 == 0 else "assistant", f"Row {i}.") for i in range(20_000)])
    for size in (conversations.CHUNK, 7):
        monkeypatch.setattr(conversations, "CHUNK", size)
        got = repaired(spark, many)
        assert {i: (r.cost, r.audit) for i, r in got.items()} == {i: plain_fold(rows, faults(rows)) for i, rows in enumerate(many)}
    assert got[5].audit == "K" * 20_000


def test_faults_gaps_and_pairs(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 2, "user", "Hi."), (1, 5, "assistant", " \n"), (1, 6, "assistant", "so"), (1, 6, "system", "x? \r\n"),
        (None, None, None, None), (None, None, "user", "a."), (3, 4, "user", "Long. " * 50_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in conversations.repair(df).collect()}
    a = got[1]
    assert (a.gaps, a.blank, a.duplicate, a.truncated, a.illegal) == (3, 1, 1, 1, 3)
    assert (got[None].gaps, got[None].blank, got[None].illegal) == (0, 1, 1)
    assert (got[3].cost, got[3].audit, got[3].repaired) == (2, "D", [])
    assert got[3].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    empty = conversations.repair(df.limit(0))
    assert empty.collect() == [] and empty.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired", "repaired_sha256"]


def test_damage_by_row(spark):
    rows = [(c, t, r, "One. Two! Three?") for c in [*range(40), None] for t in [0, 1, None] for r in ("system", None)]
    rows.append((99, 1, "user", None))
    out = conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, r, x in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if r is None else r, " " if x is None else x
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        want += [(c, t, "user" if h == 4 else role, text, h != 0)] * (2 if h == 3 else 1)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in out)
    assert {r.conv_id for r in conversations.repair(conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()} == {r[0] for r in rows}
