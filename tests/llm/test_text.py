"""Line rules (6), line dedup (7), near-duplicates (8), classifier (10) and the pipeline."""

import contextlib
import io
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import database, same
from pyspark.sql import functions as F

from epochal.llm import components, cpsjoin, linejoin, linerules, qda, registry

SF_DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", 1) for i, t in rows], "doc_id long, text string, line string, sketch string, n long")


@tables
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    same(registry.queries()[name](spark, SF_DIR), database(SF_DIR), registry.oracle_sql()[name])


# -- 6 ------------------------------------------------------------------------
def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    again = {w for w in set(windows) if windows.count(w) > 1}
    inside = {p for i, w in enumerate(windows) if w in again for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_base_counts(spark):
    rng = random.Random(1)
    some = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rows = list(enumerate([None, "", " \n\t", "é #*$ ß\x0b\x0c|", "a\n\na\n a\nb\nb", "w " * 7, "w " * 8, "w " * 9, "a b c d e f g h " * 2, "x\u00a0y\u2003z", *some]))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in linerules.clean(frame(spark, rows)).collect()}
    assert got == {i: counts(t) for i, t in rows}
    assert linerules.clean(frame(spark, [])).count() == 0


def test_lines_fail_by_rule(spark):
    lines = ["A sentence that ends.", "no end", "Home | News | Sport | More.", "All rights reserved.", "WOW!! SO!! GOOD!! BUY!!", "One wow!! in a longer line of words is fine.", "He said “so”", "Cost | benefit."]
    df = spark.createDataFrame([(x,) for x in lines], "x string").select("x", linerules.bad_line(F.col("x")).alias("bad"))
    assert [r.x for r in df.collect() if r.bad] == ["no end", "Home | News | Sport | More.", "All rights reserved.", "WOW!! SO!! GOOD!! BUY!!"]


def test_a_phrase_spoils_short_lines_only(spark):
    story = "She baked a cookie while it rained, and nobody in the whole house asked what it was for or who would eat it. "
    long = story + " ".join(f"word{n}" for n in range(40)) + "."
    got = {r.doc_id: r.kept for r in linerules.clean(frame(spark, [(1, long), (2, "We use a cookie.\n" * 30)])).collect()}
    assert len(long) > linerules.PHRASE_LINE and got == {1: True, 2: False}


def test_documents_losing_too_much_go(spark):
    good, bad = "This is a line of plain words which ends as sentences do.", "home shop cart news help menu about jobs press blog more"
    rows = [(1, f"{good}\nAnother one follows it with words of its own.\n{bad}"), (2, f"{good}\n{bad}\nlogin search topics\nterms contact imprint sitemap\n"), (3, None), (4, "Short.")]
    got = {r.doc_id: (r.kept, r.base_failed, r.clean_text) for r in linerules.clean(frame(spark, rows)).collect()}
    assert got[1][0] and bad not in got[1][2] and not got[2][0] and not got[2][1]
    assert got[3][:2] == (False, True) and got[4][:2] == (False, True)


# -- 7 ------------------------------------------------------------------------
def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def varied(rng, text):
    out = list(text)
    for _ in range(rng.randint(0, 4)):
        at, kind = rng.randrange(len(out) + 1), rng.random()
        if kind < 0.4:
            out.insert(at, rng.choice("abé"))
        elif at < len(out):
            out[at : at + 1] = [] if kind < 0.7 else [rng.choice("abé")]
    return "".join(out)


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_banded_distance(spark, limit):
    rng = random.Random(limit)
    pairs = []
    while len(pairs) < 300:
        a = "".join(rng.choice("abé") for _ in range(rng.randint(limit + 1, 50)))
        b = varied(rng, a)
        a, b = max(a, b, key=len), min(a, b, key=len)
        if len(a) - len(b) <= limit and b:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "p string, q string")
    for r in df.select("p", "q", linejoin.within(F.col("p"), F.col("q"), limit).alias("w")).collect():
        assert r.w == (edits(r.p, r.q) <= limit), (r.p, r.q)


def close(a, b):
    """Within the edits, after two conditions that all such lines meet."""
    if abs(len(a) - len(b)) > linejoin.EDITS or min(len(a), len(b)) < linejoin.SHORTEST:
        return False
    one, two = Counter(a), Counter(b)
    return sum(((one - two) + (two - one)).values()) <= 2 * linejoin.EDITS and edits(a, b) <= linejoin.EDITS


def brute_lines(rows):
    lines = [(i, n, x) for i, t in rows if i is not None and t is not None for n, x in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    texts = sorted({x for _, _, x in lines})
    parent = {x: x for x in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and close(a, b):
                parent[root(a)] = root(b)
    first, gone = {}, {}
    for i, n, x in sorted(lines):
        if root(x) in first and first[root(x)] != (i, n):
            gone.setdefault(i, []).append((n, *first[root(x)]))
        first.setdefault(root(x), (i, n))
    return {i: sorted(set(g)) for i, g in gone.items()}


def line_rows():
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(15, 45))) + "x" for _ in range(12)]
    rows = [(i, "\n".join(rng.choice([lambda: rng.choice(base), lambda: varied(rng, rng.choice(base)), lambda: "x", lambda: ""])() for _ in range(rng.randint(0, 7)))) for i in range(40)]
    return [*rows, (-5, base[0]), (100, None), (None, base[0]), (7, rows[7][1]), (101, base[1] + "\n" + base[1])]


def test_different_texts_under_one_id_keep_their_own_lines(spark):
    line = "This sentence stands in the corpus more than once."
    own = "A wholly unrelated unique sentence lives here."
    rows = [(1, line), (7, line + "\nfirst text of seven"), (7, own + "\nsecond text of seven"), (7, own + "\nsecond text of seven"), (-3, own + " xyzzy"), (-9, own[:-1])]
    got = sorted(r.text for r in linejoin.dedup(frame(spark, rows)).collect())
    assert got == sorted([line, "first text of seven", "second text of seven", "second text of seven", own + " xyzzy", own[:-1]])
    lines = {(r.doc_id, r.n_lines, r.n_removed, tuple(map(tuple, r.removed or []))) for r in linejoin.decisions(frame(spark, rows)).collect()}
    assert lines == {(1, 1, 0, ()), (7, 2, 1, ((0, 1, 0),)), (7, 2, 1, ((0, -9, 0),)), (-3, 1, 0, ()), (-9, 1, 0, ())}


def test_line_decisions(spark):
    rows = line_rows()
    got = {r.doc_id: sorted(map(tuple, r.removed)) for r in linejoin.decisions(frame(spark, rows)).collect() if r.removed}
    assert got == brute_lines(rows) and len(got) > 10


@pytest.mark.parametrize("crowd", [1, 32])
def test_crowded_segments_lose_no_link(spark, monkeypatch, crowd):
    """Chains that no one line reaches, families with a common segment, and lone pairs among them."""
    monkeypatch.setattr(linejoin, "CROWD", crowd)
    rng = random.Random(crowd)
    head = "a common head, "
    lines = {head + "".join(rng.choice("01234") for _ in range(6)) + "-tail-" + rng.choice("xyz") for _ in range(90)}
    chain = head + "chain of lines"
    for _ in range(25):
        chain = varied(rng, chain)
        lines.add(chain)
    lines |= {"".join(rng.choice("abcd") for _ in range(24)) for _ in range(20)}
    rows = [(i, x) for i, x in enumerate(sorted(lines))] + [(1000 + i, t) for i, t in line_rows()[:10]]
    distinct = frame(spark, rows).select(F.xxhash64("text").alias("h"), F.col("text").alias("line")).where("text IS NOT NULL")
    assert linejoin.crowds(distinct.where(F.length("line") >= linejoin.SHORTEST), 2)[0].count() > 0
    got = {r.doc_id: sorted(map(tuple, r.removed)) for r in linejoin.decisions(frame(spark, rows)).collect() if r.removed}
    assert got == brute_lines(rows) and len(got) > 20


def test_lines_of_one_class_are_no_pairs(spark, monkeypatch):
    """A clique in a crowded key gives a link a line, not its square."""
    monkeypatch.setattr(linejoin, "CROWD", 32)
    text = "one sentence that stands in very many pages with another number: "
    rows = [(f"{text}{i:02d}",) for i in range(100)]
    lines = spark.createDataFrame(rows, "line string").select(F.xxhash64("line").alias("h"), "line")
    found = linejoin.links(lines, 2)
    assert found.count() < 300
    assert components.connected(found).select("component").distinct().count() == 1


def test_methods_of_keys_are_short_enough_to_be_compiled(spark):
    """The JVM compiles no method of more than 8,000 bytes; probes of all places in one array had 10,826."""
    lines = frame(spark, line_rows()).select(F.xxhash64("text").alias("h"), F.col("text").alias("line"), F.lit(0).cast("long").alias("bag"), F.length("text").alias("n"))
    index, probe = linejoin.keyed(lines, linejoin.EDITS)
    shown, before = io.StringIO(), spark.conf.get("spark.sql.adaptive.enabled")
    # an adaptive plan has no code before it runs
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(shown):
            index.explain("codegen")
            probe.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())]
    assert len(sizes) > 1 and max(sizes) <= 8000


def test_line_dedup_cuts_the_text_and_keeps_columns(spark):
    rows = line_rows()
    df = frame(spark, rows)
    out = linejoin.dedup(df)
    assert out.columns == df.columns and out.count() == len(rows)
    gone = brute_lines(rows)
    texts = {(r.doc_id, r.text) for r in out.collect()}
    for i, t in rows:
        cut = {g[0] for g in gone.get(i, [])}
        assert (i, t if not cut else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in cut)) in texts
    assert linejoin.decisions(frame(spark, [])).count() == 0


def test_a_document_of_very_many_lines(spark):
    line = "This sentence stands in one document very often."
    own = [f"Line number {n} of many lines, unlike all the others by its number {n * 7919}." for n in range(0, 3000, 30)]
    out = {r.doc_id: r.text for r in linejoin.dedup(frame(spark, [(1, "\n".join([line] * 50_000 + own)), (2, line)])).collect()}
    kept = out[1].split("\n")
    assert kept[0] == line and kept.count(line) == 1 and out[2] == ""


# -- 8 ------------------------------------------------------------------------
def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute_groups(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return {i: (len(sets[i]), group[i], group[i] == i) for i in sets}


def near_rows():
    rng = random.Random(6)
    words = [f"w{n}" for n in range(300)]
    rows, base = [], [[rng.choice(words) for _ in range(rng.randint(20, 150))] for _ in range(6)]
    for i in range(90):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i * 3 + 1, " ".join(own) if i % 2 else "\n".join(own).upper()))
    return [*rows, (500, None), (501, ""), (502, " \t"), (503, "one two"), (504, "ONE  two"), (505, "one"), (506, "É é x"), (507, "é é x"), (None, rows[0][1]), (0, rows[5][1])]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
@pytest.mark.parametrize("limits", [(2000, 1000), (3, 4)])
def test_near_duplicates(spark, monkeypatch, k, percent, limits):
    monkeypatch.setattr(cpsjoin, "NODE", limits[0])
    monkeypatch.setattr(cpsjoin, "FAMILY", limits[1])
    monkeypatch.setattr(cpsjoin, "DEPTH", 2)
    rows = near_rows()
    got = cpsjoin.near_duplicates(frame(spark, rows), k, percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == brute_groups(rows, k, percent)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    text = [" ".join(f"{c}{n}" for n in range(40)) for c in "abc"]
    rows = [(3, text[0]), (7, text[0] + " tail"), (7, text[1]), (7, text[1]), (9, text[1] + " end"), (9, text[2]), (12, None), (12, text[2])]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in cpsjoin.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(3, 36, 3, True), (7, 37, 3, False), (7, 36, 7, True), (9, 37, 7, False), (9, 36, 9, True), (12, 0, 12, True), (12, 36, 9, False)}


def test_trees_for_a_chance_of_a_miss():
    assert [cpsjoin.trees(p) for p in (80, 85)] == [10, 8]
    assert cpsjoin.trees(80, depth=0) == 9 and cpsjoin.trees(50) > 20


@pytest.mark.parametrize("depth", [1, 4])
def test_recall_where_nodes_branch(spark, monkeypatch, depth):
    """Pairs near the threshold among many documents of one template, which share most nodes, but aren't similar."""
    monkeypatch.setattr(cpsjoin, "NODE", 40)
    monkeypatch.setattr(cpsjoin, "FAMILY", 200)
    monkeypatch.setattr(cpsjoin, "DEPTH", depth)
    rng = random.Random(depth)
    rows = []
    for n in range(700):
        own = [f"t{i}" for i in range(60)] + [f"d{n}w{i}" for i in range(60)]
        rows.append((2 * n, " ".join(own)))
        if n < 350:
            for i in rng.sample(range(60, 120), 3):
                own[i] = f"e{n}w{i}"
            rows.append((2 * n + 1, " ".join(own)))
    want = {(i, i - i % 2) for i, _ in rows}
    sets = {i: shingles(t, 3) for i, t in rows}
    pairs = [100 * len(sets[i] & sets[i - 1]) >= 85 * len(sets[i] | sets[i - 1]) for i in sets if i % 2]
    got = {(r.doc_id, r.component_id) for r in cpsjoin.near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert sum(pairs) > 200 and {g for g in got if g[0] % 2 == 0} == {w for w in want if w[0] % 2 == 0}
    hit = [(i, i - 1) in got for i in sets if i % 2]
    assert [h for h, p in zip(hit, pairs, strict=True) if p] == [True] * sum(pairs)


def test_no_documents(spark):
    assert cpsjoin.near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, n) for n in range(4000, 4100)] + [(7, 7)]
    group = {v: v for p in pairs for v in p}
    for _ in range(100):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    got = components.connected(spark.createDataFrame([*pairs, (None, 3)], "a long, b long"))
    assert {r.vertex: r.component for r in got.collect()} == group


# -- 10 -----------------------------------------------------------------------
@tables
def test_held_out_accuracy(spark):
    sf = SF_DIR.replace("0.001", "0.01")
    out = registry.op10_quality_qda(spark, sf)
    rows = out.join(registry.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").where("held_out").collect()
    right = [r.predicted == r.quality for r in rows]
    assert len(right) > 50 and np.mean(right) > 0.95
    bad = [r.predicted == 0 for r in rows if r.quality == 0]
    assert np.mean(bad) > 0.9


def test_scores_of_odd_rows(spark):
    good = [(i, "a plain line of some words that goes on and ends. " * (1 + i % 4)) for i in range(30)]
    bad = [(i, "BUY!! NOW!! ### $$$ " * (2 + i % 5)) for i in range(30, 60)]
    docs = frame(spark, [*good, *bad, (60, None), (61, ""), (None, "x"), (5, "twice")])
    labels = spark.createDataFrame([(i, 1 if i < 30 else 0) for i in range(60)] + [(None, 1), (3, None), (999, 0), (4, 7)], "doc_id long, quality int")
    got = qda.score(docs, labels).collect()
    assert len(got) == 64 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    right = [r.predicted == (r.doc_id < 30) for r in got if r.doc_id is not None and r.doc_id < 60]
    assert np.mean(right) > 0.9
    assert {r.score for r in qda.score(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in qda.score(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert qda.score(docs.limit(0), labels).count() == 0


def twin_features(text):
    """The statistics of one text, in plain Python."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, chars = len(w), len(t)
    odds = lambda part, whole: np.log((part + 0.5) / (whole - part + 0.5))
    ends = len(re.findall(r"[.!?]", t))
    return [
        np.log1p(n), np.log1p(len("".join(w).encode()) / max(n, 1)), odds(sum(t.count(c) for c in "#*$%&|<>"), chars), odds(t.count("!"), chars),
        odds(len(re.findall("[A-Z]", t)), chars), odds(len(re.findall("[0-9]", t)), chars), odds(len(set(w)), n), np.log1p(n / (t.count("\n") + 1)),
        odds(min(ends, n), n), odds(sum(a == b for a, b in zip(w, w[1:], strict=False)), n),
    ]


def plain_scores(docs, labels):
    """Scores of (id, text) rows by a discriminant on whole covariance matrices."""
    x = np.array([twin_features(t) for _, t in docs])
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in docs])
    y = np.array([labels.get(i, -1) for i, _ in docs])
    use = ~held & (y >= 0)
    own = [x[use & (y == c)] for c in (0, 1)]
    n = np.array([len(o) for o in own])
    pooled = sum(len(o) * np.cov(o.T, bias=True) for o in own) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    log = []
    for o, k in zip(own, n, strict=True):
        cov = (0.8 * np.cov(o.T, bias=True) + 0.2 * pooled) / np.outer(scale, scale)
        cov = 0.98 * cov + 0.02 * np.trace(cov) / len(cov) * np.eye(len(cov)) + 1e-9 * np.eye(len(cov))
        z = (x - o.mean(0)) / scale
        log.append(np.log(k / n.sum()) - np.linalg.slogdet(cov)[1] / 2 - np.einsum("ni,ij,nj->n", z, np.linalg.inv(cov), z) / 2)
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


@tables
def test_scores_equal_a_plain_discriminant(spark):
    """The same shrinkage discriminant, fitted and applied by NumPy on whole covariance matrices."""
    docs = registry.table(spark, SF_DIR, "documents").select("doc_id", "text").collect()
    labels = {r.doc_id: r.quality for r in registry.table(spark, SF_DIR, "labels").collect()}
    want = plain_scores([(r.doc_id, r.text) for r in docs], labels)
    got = {r.doc_id: r.score for r in registry.op10_quality_qda(spark, SF_DIR).collect()}
    assert np.allclose([got[r.doc_id] for r in docs], want, atol=1e-6)


def test_rows_are_accepted_by_their_own_text(spark):
    good = [(i, "a plain line of some words that goes on and ends. " * (1 + i % 4)) for i in range(30)]
    bad = [(i, "BUY!! NOW!! ### $$$ " * (2 + i % 5)) for i in range(30, 60)]
    rows = [*good, *bad, (3, bad[0][1]), (40, good[0][1]), (None, good[1][1]), (None, bad[1][1])]
    labels = spark.createDataFrame([(i, 1 if i < 30 else 0) for i in range(60)], "doc_id long, quality int")
    docs = frame(spark, rows).withColumn("f_words", F.lit("clash"))
    out = qda.accepted(docs, labels)
    assert out.columns == docs.columns
    got = sorted((str(r.doc_id), r.text) for r in out.collect())
    assert got == sorted((str(i), t) for i, t in [*good, (40, good[0][1]), (None, good[1][1])])


# -- pipeline -------------------------------------------------------------------
@tables
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = registry.table(spark, SF_DIR, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name != "packing":
            assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
            n = out.count()
            assert 0.6 * before < n <= before
            before = n
            from epochal.llm import storage

            docs = storage.written(out, name)
    pieces = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert len(pieces) == before and all(p.n == p.m for p in pieces)


@tables
def test_pipeline_of_odd_documents(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    # too few words for the rules; only one row has a line; texts without words are nobody's copies; a piece for each end id
    want = {"quality_rules": 0, "line_dedup": 1, "near_dedup": 3, "packing": 3}
    for name, stage in corpus_pipeline.STAGES:
        n = stage(spark, docs, SF_DIR).count()
        assert n == want.get(name, n) and n <= 3, name
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_bags_never_part_lines_within_the_threshold(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice(linejoin.LETTERS + "xyzé.") for _ in range(rng.randint(20, 60)))
        rows.append((a, varied(rng, a)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", linejoin.bags_within(linejoin.bag(F.col("a")), linejoin.bag(F.col("b")), 2).alias("close")).collect()
    assert all(r.close for r in got if edits(r.a, r.b) <= 2)
    assert not all(r.close for r in got)
