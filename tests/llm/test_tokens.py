"""Token-id shards (1), packing (5) and byte-level BPE (9) against the tokenizers library."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.llm import bpe, packing, registry, repair, storage
from epochal.llm.wordcache import WordEncoder

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

ODD = [
    "", None, " ", "\n", "  a  b ", "a\n\n\nb  c\t d", "x<|endoftext|>y <|endoftext|>", "don't we'll  's 'S", "naïve ﬁ Ⅷ १२३ İstanbul ΑΣ Σ ", "🙂🙂 \u200d\u3000x y",
    "a" * 3000, " " * 50, "\r\n x \r\n\r\n", "é ñ", "\u0301abc x \u0301y", "<|startoftext|>A<|EndofText|>", "\x02 a\x02b \x00", "Hello, World. Hello; again!", "tail ", "e\u0301 \u1e9b\u0323", "100% of $5 & 3<4",
]


def texts(n=40):
    rng = random.Random(5)
    made = [" ".join("".join(rng.choice(["the", "ing", "on", "É", "ß", "x", "ñ"]) for _ in range(rng.randint(1, 5))) + rng.choice(["", ".", ",", "!\n", "?"]) for _ in range(rng.randint(1, 400))) for _ in range(n)]
    return ODD + made + made[:3]


def library(name):
    return tokenizers.Tokenizer.from_file(registry.tokenizer(name))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start long, block string, part int")


def rows_of(all_texts):
    return [(n, t, "clash", 7, "clash", 3) for n, t in enumerate(all_texts)]


def test_word_store_equals_the_library_through_both_generations(monkeypatch):
    from epochal.llm import wordcache

    monkeypatch.setattr(wordcache, "MAX_WORDS", 60)
    lib, own = library("word_bpe_49k.json"), WordEncoder(registry.tokenizer("word_bpe_49k.json"))
    all_texts = texts()
    want = [e.ids for e in lib.encode_batch([t or "" for t in all_texts], add_special_tokens=False)]
    for at in range(0, len(all_texts), 5):
        got = own.encode(all_texts[at : at + 5])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == want[at : at + 5]


def test_byte_codec_equals_the_library_both_ways():
    lib, own = library("byte_bpe_50k.json"), bpe.TextCodec(registry.tokenizer("byte_bpe_50k.json"))
    all_texts = texts()
    want = [e.ids for e in lib.encode_batch([t or "" for t in all_texts], add_special_tokens=False)]
    for _ in range(2):  # the second time from the store
        got = own.encode(all_texts)
        assert [np.frombuffer(g[0], "<u4").tolist() for g in got] == want
    assert [g[1].decode() for g in got] == ["".join(f"{i}," for i in w) for w in want]
    assert [own.decode(np.array(w, np.int64)).decode("utf-8", "replace") for w in want] == [lib.decode(w, skip_special_tokens=False) for w in want]
    assert 0 < own.bpe.stats["merged"] < own.bpe.stats["words"]


def test_partial_bytes_decode_like_the_library():
    lib, own = library("byte_bpe_50k.json"), bpe.codec(registry.tokenizer("byte_bpe_50k.json"))
    rng = random.Random(2)
    for _ in range(50):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert own.decode(np.array(ids, np.int64)).decode("utf-8", "replace") == lib.decode(ids, skip_special_tokens=False)


def test_columns_of_ids(spark):
    path = registry.tokenizer("byte_bpe_50k.json")
    df = frame(spark, rows_of(ODD)).withColumn("e", bpe.encode(F.col("text"), path)).withColumn("back", bpe.decode(F.col("e.ids"), path))
    for r in df.collect():
        assert r.back == (r.text or "") and r.e.n_tokens == len(r.e.ids) // 4


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    words = [rng.integers(3, 200, rng.integers(1, 9)) for _ in range(50)]
    docs = [np.concatenate([*(words[i] for i in rng.integers(0, 50, rng.integers(0, 300))), [2]]).astype("<u4") for _ in range(30)] + [np.array([2], "<u4"), np.array([5] * 999 + [2], "<u4")]
    raw = repair.pack_block([None, *range(1, len(docs))], np.array([len(d) for d in docs]), np.concatenate(docs))
    block = repair.Block(raw)
    assert block.doc_ids[:2] == [None, 1] and len(block.rules) > 10 and len(block.seq) < len(np.concatenate(docs)) / 2
    assert (block.all_ids() == np.concatenate(docs)).all()
    for n, d in enumerate(docs):
        assert (block.document(n) == d).all()
    for (a, b), size in zip(block.rules.tolist(), block.rule_lengths.tolist(), strict=True):
        assert 2 not in (a, b) and len(block.expand(np.array([a, b]))) == size


def test_runs_are_replaced_without_overlap():
    ids = np.array([7] * 101 + [2] + [7, 8] * 60 + [2], np.uint32)
    rules, seq, base = repair.build_grammar(ids)
    block = repair.Block(repair.pack_block([1, 2], np.array([102, 121]), ids))
    assert (block.all_ids() == ids).all() and len(rules)


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(repair, "SHARD_TOKENS", 500)
    all_texts = texts()
    rows = rows_of(all_texts) + [(None, "no id", None, None, None, None), (3, "again", None, None, None, None)]
    path = storage.new_path(spark, "shards")
    repair.write(frame(spark, rows).repartition(3), registry.tokenizer("word_bpe_49k.json"), path)
    lib = library("word_bpe_49k.json")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for r in order:
        ids = [*lib.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = repair.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert spark.read.parquet(path).count() > 3


def test_empty_tables(spark):
    empty = frame(spark, [])
    path = storage.new_path(spark, "shards")
    repair.write(empty, registry.tokenizer("word_bpe_49k.json"), path)
    assert repair.read(spark, path).count() == 0
    assert packing.pack_documents(empty, registry.tokenizer("word_bpe_49k.json")).count() == 0
    assert bpe.encode_digests(empty, registry.tokenizer("byte_bpe_50k.json")).count() == 0


def covered(lengths, windows):
    pieces = {}
    for _, window in windows:
        for doc, at, n in window:
            assert n > 0
            pieces.setdefault(doc, []).append((at, n))
    for doc, n in enumerate(lengths):
        at = 0
        for a, size in sorted(pieces.get(doc, [])):
            assert a == at
            at += size
        assert at == n


@pytest.mark.parametrize("seed", range(8))
def test_packing_covers_all_and_pads_nothing(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, rng.randint(1, 600), rng.randint(500, 5000), 512, 4096, 9000]) for _ in range(rng.randint(1, 120))]
    windows = packing.pack(lengths)
    covered(lengths, windows)
    for tier, window in windows:
        size = sum(p[2] for p in window)
        assert size == tier and tier & (tier - 1) == 0 and tier <= 4096
    groups = packing.step_groups(windows)
    totals = {}
    for (tier, _), g in zip(windows, groups, strict=True):
        totals.setdefault((tier, g), 0)
        totals[tier, g] += tier
    for tier in packing.TIERS:
        own = [v for (t, _), v in totals.items() if t == tier]
        assert not own or max(own) - min(own) <= tier
    assert packing.pack([]) == []


def test_packed_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUFFER_TOKENS", 4000)
    all_texts = texts()
    out = packing.pack_documents(frame(spark, rows_of(all_texts)).repartition(2), registry.tokenizer("word_bpe_49k.json")).collect()
    lib = library("word_bpe_49k.json")
    at, seqs = {}, {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        ids = [*lib.encode(all_texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids)
        assert list(struct.unpack(f"<{r.length}I", r.ids)) == ids[r.start : r.start + r.length]
        at[r.doc_id] = r.start + r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(at) == len(all_texts)
    for s in seqs.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end & (end - 1) == 0 and end <= 4096


def test_rounds_go_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(4)
    words = [rng.integers(3, 90, rng.integers(1, 9)) for _ in range(40)]
    ids = np.concatenate([np.append(words[i], 2) if rng.random() < 0.05 else words[i] for i in rng.zipf(1.5, 9000) % 40]).astype(np.uint32)
    rules, seq, base = repair.build_grammar(ids)
    pairs, times = np.unique(np.stack([seq[:-1], seq[1:]], 1)[(seq[:-1] != 2) & (seq[1:] != 2)], axis=0, return_counts=True)
    assert len(rules) > 100 and all(n < repair.MIN_COUNT or a == b for (a, b), n in zip(pairs.tolist(), times.tolist(), strict=True))
    assert (repair.Block(repair.pack_block([1], np.array([len(ids)]), ids)).all_ids() == ids).all()


def left_over(ids):
    """Pairs of different ids that are still frequent in the remaining sequence."""
    rules, seq, _ = repair.build_grammar(ids)
    inner = (seq[:-1] != 2) & (seq[1:] != 2)
    pairs, times = np.unique(np.stack([seq[:-1], seq[1:]], 1)[inner], axis=0, return_counts=True)
    return [(a, b, n) for (a, b), n in zip(pairs.tolist(), times.tolist(), strict=True) if n >= repair.MIN_COUNT and a != b], len(rules)


def test_frequent_pairs_of_one_bucket_all_get_rules():
    bucket = lambda a, b: int(repair._buckets(np.array([a], np.uint32), np.array([b], np.uint32), 0)[0])
    own = {}
    for a in range(3, 4000):
        own.setdefault(bucket(a, a + 5000), []).append((a, a + 5000))
    first, second = next(v[:2] for v in own.values() if len(v) > 1)
    rng = np.random.default_rng(6)
    parts = [first] * 100 + [second] * 60
    ids = np.concatenate([[*parts[i], 20_000 + k] for k, i in enumerate(rng.permutation(160))]).astype(np.uint32)
    assert left_over(ids) == ([], 2)
    zipf = np.minimum(rng.zipf(1.2, 1 << 18), 40_000).astype(np.uint32) + 3
    assert left_over(zipf)[0] == []
    assert (repair.Block(repair.pack_block([1], np.array([len(zipf)]), zipf)).all_ids() == zipf).all()


def test_rows_without_an_id_are_parted_by_their_texts(spark):
    rows = [(None, f"text {n % 700} of none", None, None, None, None) for n in range(900)] + [(n, "x", None, None, None, None) for n in range(30)]
    path = storage.new_path(spark, "shards")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    repair.write(frame(spark, rows).repartition(4), registry.tokenizer("word_bpe_49k.json"), path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(path).select("part").distinct().count() > 2
    lib, start, want = library("word_bpe_49k.json"), 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = [*lib.encode(r[1], add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = repair.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_digests_of_whole_rows(spark):
    """The registered path of byte-level encoding: digests of ids and of the decoded text, for repeated and missing keys too."""
    import hashlib

    lib = library("byte_bpe_50k.json")
    rows = [*rows_of(texts()), (3, "again", None, None, None, None), (None, "no id", None, None, None, None)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    got = bpe.encode_digests(frame(spark, rows).repartition(3), registry.tokenizer("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_words_merged_together_as_one_by_one():
    import numpy as np
    import public_tokenizers

    from epochal.llm import bpe

    own = bpe.codec(public_tokenizers.path("byte_bpe_50k.json")).bpe
    rng = np.random.default_rng(5)
    words = [b"", b"a", b" the", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", b"ab" * 40, bytes(range(200, 240)), b"\xff"]
    words += [bytes(rng.choice(list(b" etaoinshrdlu"), size=n)) for n in rng.integers(1, 60, 300).tolist()]
    assert own.merged(words) == [[own.id_of[p] for p in own.merge(w)] for w in words]
    assert own.merged([]) == [] and own.merged([b""]) == [[]]
