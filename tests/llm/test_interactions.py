"""Filter interaction audit (13) against a document-by-document replay."""

import re
from collections import Counter
from itertools import permutations

from epochal.llm import interactions


def replayed(docs, labels):
    """A row a part, order and step, document by document."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    flags = []
    for i, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        flags.append((source or "", fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {f[0] for f in flags}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in flags if f[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                removed = [f for f in left if f[1][x]]
                redundant = sum(f[1][x] for f in gone)
                left = [f for f in left if not f[1][x]]
                gone += removed
                unique = sum(f[1][x] and sum(f[1].values()) == 1 for f in flags if f[0] == part)
                out[part, order, step] = [len(left), len(removed), redundant, unique, sum(f[2] for f in removed), sum(f[3] for f in removed)]
                shapley[part, x] += len(removed)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    frame = spark.createDataFrame([(*d, True, "x") for d in docs], "doc_id long, text string, source string, A boolean, part string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = interactions.audit(frame, marks).collect()
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


LONG = " ".join(f"w{i}" for i in range(250))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (4, LONG, None), (5, None, ""), (6, "", "a"), (7, None, "b"), (8, "w " * 300, "a"), (9, "W " * 300, "a"),
    (10, LONG + " #", "a"), (11, LONG + " #", "b"), (None, LONG, "a"), (None, None, "é"), (2, LONG, "a"), (12, LONG.upper(), "hot"), (12, "one $", "hot"),
    (13, "x " * 100_000, "hot"), (14, " \n\t\x0b", "hot"), (1, LONG + " #", "a"), *((100 + i, LONG, "hot") for i in range(40)),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (9, 1, 1), (13, 0, 1), (None, 1, 1), (110, 1, 0), (777, 1, 1)]


def test_equals_a_plain_replay(spark):
    assert audited(spark, DOCS, LABELS) == replayed(DOCS, LABELS)


def test_no_labels_and_no_documents(spark):
    assert audited(spark, DOCS[:6], []) == replayed(DOCS[:6], [])
    assert audited(spark, [], LABELS) == {}


def test_every_part_order_and_step_has_a_row(spark):
    got = audited(spark, [(1, "An ordinary text.", "only")], [])
    assert len(got) == 600 and {k[0] for k in got} == {"only"}


def test_there_are_120_orders(spark):
    names = [r.filter_order for r in interactions.orders(spark.range(1)).collect()]
    assert len(set(names)) == 120 and all(sorted(n) == list("ABCDE") for n in names)
