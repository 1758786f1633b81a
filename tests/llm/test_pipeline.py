"""The whole pipeline over written tables against the same stages in plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from test_text import brute_groups, brute_lines, counts, plain_scores, twin_features
from test_tokens import library

from epochal.llm import linerules

SPACE = re.compile(r"[^\x20\x09-\x0D]")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9))) for _ in range(n)) + "."


def reworded(rng, line):
    """The line with one of its words made another, more than two edits away."""
    own = line.split(" ")
    own[rng.randrange(5, len(own) - 6)] = "qqqqzzzzxxxx"[: rng.randint(9, 12)]
    return " ".join(own)


def corpus():
    """Rows, labels, and ids by what was planted."""
    rng = random.Random(11)
    docs, labels, planted = {}, {}, {k: [] for k in ("good", "bad", "copy", "near", "short", "bar", "odd")}

    def add(kind, text, label=None):
        i = 3 * len(docs) + 1
        docs[i] = text
        planted[kind].append(i)
        if label is not None:
            labels[i] = label
        return i

    shared = sentence(rng, 12)
    for k in range(45):
        lines = [sentence(rng, rng.randint(55, 70)) for _ in range(rng.randint(1, 3))]
        add("good", "\n".join([*lines, shared] if k % 5 == 0 else lines), 1)
    for k in range(25):
        add("bad", " ".join(rng.choice(["BUY!!", "NOW!!", "###", "$$$", "WIN", "99%"]) for _ in range(30 + k)), 0)
    sources = planted["good"][:9]
    copied = [add("copy", docs[i]) for i in sources[:3]]
    near = {add("near", "\n".join(reworded(rng, x) if len(x) > 200 else x for x in docs[i].split("\n"))): i for i in sources[3:]}
    for _ in range(4):
        add("short", sentence(rng, 9))
        add("bar", sentence(rng, 30) + "\n" + " | ".join(["Home page", "News", "Sport", "About"] * 12))
    for text in (None, "", " \t\n", docs[planted["good"][9]] + "\n\nx"):
        add("odd", text)
    return docs, labels, planted, copied, near


def bad_line(line):
    last = line.rstrip(linerules.SPACES)[-1:]
    doubled = len(re.findall(r"[!?#*$%&]{2,}(?: |$)", line))
    bar = len(re.split(r" [|>»›·•] ", line)) > 3
    phrase = len(line) <= 200 and any(p in line.lower() for p in linerules.BOILERPLATE)
    return last not in linerules.SENTENCE_ENDS or last == "" or (doubled and 4 * doubled >= len(line.split(" "))) or bar or phrase


def plain_rules(text):
    """The text without failing lines, or None."""
    n_words, *_, repeated = counts(text)
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    left = "\n".join(x for x in lines if not bad_line(x))
    return left if n_words >= 20 and 100 * repeated <= 30 * n_words and len(left) >= 0.5 * len("\n".join(lines)) else None


def plain_stages(rows, labels):
    """Rows that each stage leaves, the last one's before packing."""
    accepted = [r for r, s in zip(rows, plain_scores(rows, labels), strict=True) if s >= 0.5]
    ruled = [(i, left) for i, t in accepted if (left := plain_rules(t)) is not None]
    gone = brute_lines(ruled)
    cut = []
    for i, t in ruled:
        out = {n for n, _, _ in gone.get(i, [])} if i is not None else set()
        own = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in out)
        if SPACE.search(own):
            cut.append((i, own))
    groups = brute_groups(cut, 5, 80)
    return accepted, ruled, cut, [(i, t) for i, t in cut if i is None or groups[i][2]]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    docs, labels, planted, copied, near = corpus()
    rows = [*docs.items(), (None, docs[1]), (None, docs[planted["bad"][0]]), (7, docs[7])]
    folder = tmp_path_factory.mktemp("corpus")
    frame = pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], "Int64"), "text": [t for _, t in rows], "lang": "en", "source": "s", "n_chars": [len(t or "") for _, t in rows], "line": "clash", "sketch": 1.5, "__row": None})
    frame.to_parquet(folder / "documents.parquet")
    pd.DataFrame({"doc_id": list(labels), "quality": list(labels.values()), "toxic": 0}).to_parquet(folder / "labels.parquet")
    return str(folder), rows, labels, planted, copied, near


def test_pipeline_equals_plain_stages(spark, tables):
    import corpus_pipeline

    folder, rows, labels, planted, copied, near = tables
    accepted, ruled, cut, left = plain_stages(rows, labels)
    # every stage has something to do, and what it should take is gone
    assert len(rows) > len(accepted) > len(ruled) > len(cut) > len(left)
    ids = lambda some: {i for i, _ in some}
    assert not ids(accepted) & set(planted["bad"]) and not ids(ruled) & {*planted["short"], *planted["bar"]}
    assert not ids(cut) & set(copied) and set(near) <= ids(cut) and not ids(left) & set(near)
    assert set(planted["good"]) <= ids(left)

    lib = library("word_bpe_49k.json")
    want = Counter((i, len(lib.encode(t, add_special_tokens=False).ids) + 1) for i, t in left)
    texts = {}
    for i, t in left:
        texts.setdefault(i, []).append([*lib.encode(t, add_special_tokens=False).ids, 2])
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == want
    assert sum(p.length for p in pieces) == sum(n * k for (_, n), k in want.items())
    for p in pieces:
        parts = [own[p.start : p.start + p.length] for own in texts[p.doc_id] if len(own) == p.doc_tokens]
        assert p.ids_crc32 in {zlib.crc32(np.array(x, "<u4").tobytes()) for x in parts}


def test_each_stage_leaves_the_plain_rows(spark, tables):
    import corpus_pipeline
    from epochal.llm import storage

    folder, rows, labels, *_ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], plain_stages(rows, labels), strict=True):
        docs = storage.written(stage(spark, docs, folder), name)
        assert docs.columns == columns
        got = docs.select("doc_id", "text", "n_chars", "line", "sketch").collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter(want), name
        assert all(r.n_chars == len(r.text or "") and (r.line, r.sketch) == ("clash", 1.5) for r in got)


def test_features_tell_the_planted_apart():
    docs, _, planted, *_ = corpus()
    bangs = lambda kind: np.mean([twin_features(docs[i])[3] for i in planted[kind]])
    assert bangs("bad") > bangs("good")
