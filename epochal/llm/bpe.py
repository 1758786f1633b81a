"""Byte-level BPE by speculation and verification.

Each word is first cut greedily into the longest vocabulary tokens.  That cut
is the merge order's own answer exactly when every neighbouring pair of tokens
is *compatible*: merging the two tokens' bytes by rank leaves the boundary
between them standing.  All neighbouring pairs of a batch are tested together
against stored verdicts; only the words with a failing pair are merged step by
step.  Encoding equals the ``tokenizers`` library's for the same file, with
added tokens found in the text as the library finds them.

Nulls are empty texts, which have no ids.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The pre-tokenizer's pattern for byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_WORDS = 300_000
MAX_PAIRS = 1_000_000
MAX_KEPT_BYTES = 64
#: Words up to so many bytes are merged over a plain list.
SHORT = 48
#: Bits of an id, and a number above every rank and id.
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
NONE = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins for the 256 bytes: themselves if printable, else from U+0100 on."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens with stripping, word or normalising rules are not handled")
        self.added = added
        raw = {w: bytes(alphabet[c] for c in w) for w in vocab if w not in added}
        self.id_of = {raw[w]: i for w, i in vocab.items() if w in raw}
        size = max([*vocab.values(), *added.values()]) + 1
        self.bytes_of = [b""] * size
        for w, i in vocab.items():
            self.bytes_of[i] = raw.get(w, w.encode())
        for w, i in added.items():
            self.bytes_of[i] = w.encode()
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for n, (a, b) in enumerate(merges):
            self.rank.setdefault((raw[a], raw[b]), n)
        self.longest = max(map(len, self.id_of))
        # starts of tokens (their id, if they are tokens), so that a greedy search ends as soon as no token goes on
        self.starts = dict.fromkeys((t[:n] for t in self.id_of for n in range(1, len(t) + 1)), -1) | self.id_of
        # short words are merged by ids: a pair's rank, and the id that it makes, in one number
        self.byte_ids = np.array([self.id_of[bytes([b])] for b in range(256)], np.int64)
        joined = sorted((self.id_of[a] << ID_BITS | self.id_of[b], n << ID_BITS | self.id_of[a + b]) for (a, b), n in self.rank.items())
        self.pairs, self.made = np.array([*joined, (-1, NONE)] if not joined else joined, np.int64).T.copy()
        self.packed, self.decimals = [struct.pack("<I", i) for i in range(size)], [b"%d," % i for i in range(size)]
        self.find = regex.compile(PATTERN).findall
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.verdicts: dict[int, bool] = {}
        self.lens = np.array([len(b) for b in self.bytes_of], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.lens)[:-1]])
        self.stats = {"words": 0, "merged": 0}

    # -- speculation -----------------------------------------------------
    def greedy(self, word: bytes) -> list[int]:
        """Longest vocabulary token from the left, again and again."""
        out, at, n = [], 0, len(word)
        find = self.starts.get
        while at < n:
            stop = at + 1
            got = best = find(word[at:stop])
            end = stop
            while stop < n:
                stop += 1
                if (got := find(word[at:stop])) is None:
                    break
                if got >= 0:
                    best, end = got, stop
            out.append(best)
            at = end
        return out

    # -- exact merging ---------------------------------------------------
    def merge(self, word: bytes) -> list[bytes]:
        """Lowest rank first, leftmost first among equals; a heap keeps long words near-linear."""
        n = len(word)
        part = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if part[i] is a else n
            if j >= n or part[j] is not b:
                continue
            part[i], part[j] = a + b, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := rank.get((part[i], part[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[after[i]]))
            if (p := before[i]) >= 0 and (r := rank.get((part[p], part[i]))) is not None:
                heapq.heappush(heap, (r, p, part[p], part[i]))
        return [p for p in part if p is not None]

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """Ids of :meth:`merge` of each word; short words are merged together, one pair of each at a time."""
        out: list[list[int]] = [[self.id_of[p] for p in self.merge(w)] if len(w) > SHORT else [] for w in words]
        word = np.array([n for n, w in enumerate(words) if 0 < len(w) <= SHORT], np.int64)
        if not len(word):
            return out
        lens = np.array([len(words[n]) for n in word.tolist()], np.int64)
        flat = self.byte_ids[np.frombuffer(b"".join([words[n] for n in word.tolist()]), np.uint8)]
        starts = np.cumsum(lens) - lens
        # ranks of pairs, each at its left part; a word's last part has none
        ranks = np.append(self._ranks(flat[:-1], flat[1:]), NONE)
        ranks[starts + lens - 1] = NONE
        while True:
            low = np.minimum.reduceat(ranks, starts)
            going = low != NONE
            if not going.all():
                for n, at, k in zip(word[~going].tolist(), starts[~going].tolist(), lens[~going].tolist(), strict=True):
                    out[n] = flat[at : at + k].tolist()
                keep = np.repeat(going, lens)
                flat, ranks, word, lens, low = flat[keep], ranks[keep], word[going], lens[going], low[going]
                if not len(word):
                    return out
                starts = np.cumsum(lens) - lens
            found = np.flatnonzero(ranks == np.repeat(low, lens))
            # the leftmost of each word: the first one found from the word's start on
            at = found[np.searchsorted(found, starts)]
            flat[at] = low & ID_MASK
            stay = np.ones(len(flat), bool)
            stay[at + 1] = False
            last = at + 1 == starts + lens - 1
            flat, ranks = flat[stay], ranks[stay]
            shift = np.arange(len(word))
            at, starts, lens = at - shift, starts - shift, lens - 1
            ranks[at[last]] = NONE
            right, left = at[~last], at[at > starts]
            ranks[right] = self._ranks(flat[right], flat[right + 1])
            ranks[left - 1] = self._ranks(flat[left - 1], flat[left])

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pairs = a << ID_BITS | b
        place = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[place] == pairs, self.made[place], NONE)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the two tokens' joint bytes leaves exactly those two tokens."""
        return self.merged([self.bytes_of[a] + self.bytes_of[b]]) == [[a, b]]

    def reachable(self, a: int) -> bool:
        return self.merged([self.bytes_of[a]]) == [[a]]

    def _verdicts(self, pairs: np.ndarray) -> np.ndarray:
        uniq, back = np.unique(pairs, return_inverse=True)
        known = self.verdicts
        if len(known) > MAX_PAIRS:
            known.clear()
        keys = uniq.tolist()
        new = [(k, k >> 32, k & 0xFFFFFFFF) for k in keys if k not in known]
        for (k, x, y), got in zip(new, self.merged([self.bytes_of[x] + self.bytes_of[y] for _, x, y in new]), strict=True):
            known[k] = got == [x, y]
        return np.array([known[k] for k in keys], bool)[back]

    def _encode_new(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        proposed = [self.greedy(w) for w in raw]
        count = np.array([len(p) for p in proposed])
        flat = np.fromiter((i for p in proposed for i in p), np.int64, int(count.sum()))
        owner = np.repeat(np.arange(len(words)), count)
        same = owner[1:] == owner[:-1]
        pairs = ((flat[:-1] << 32) | flat[1:])[same]
        bad = np.zeros(len(words), bool)
        bad[owner[1:][same][~self._verdicts(pairs)]] = True
        # a token alone in its word is right if merging can make it
        alone = np.flatnonzero(count == 1).tolist()
        for n, got in zip(alone, self.merged([raw[n] for n in alone]), strict=True):
            bad[n] = got != proposed[n]
        self.stats["words"] += len(words)
        self.stats["merged"] += int(bad.sum())
        rest = np.flatnonzero(bad).tolist()
        for n, got in zip(rest, self.merged([raw[n] for n in rest]), strict=True):
            proposed[n] = got
        self.fresh = dict(zip(words, map(tuple, proposed), strict=True))

    # -- whole texts -----------------------------------------------------
    def pieces(self, text: str) -> list[str]:
        """Words of the pre-tokenizer; added tokens of the file stand alone."""
        if self.cut_added is None or not self.cut_added.search(text):
            return self.find(text)
        return [w for n, part in enumerate(self.cut_added.split(text)) for w in ([part] if n % 2 else self.find(part))]

    def chunks(self, text: str) -> tuple[list[str], list[str]]:
        """Parts of a text that encode on their own, and the text's words if it needs its own cut.

        A single space between two non-spaces always starts a word of the
        pattern, so ordinary prose is cut there; texts with other white space
        beside a space, or with added tokens, are cut by the pattern itself.
        """
        if _ODD(text) or (self.cut_added is not None and self.cut_added.search(text)):
            return [], self.pieces(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return [first, *[w if w[:1] == "\n" else " " + w for w in rest]], []


#: White space that is not a single space or newline between two other characters.
_ODD = regex.compile(r"\s\s|^\s|\s\z|[^\S \n]").search


class TextCodec:
    """Encodes texts through a store of chunk -> (ids, decimal ids)."""

    def __init__(self, path: str):
        self.bpe = ByteBpe(path)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.by_word: dict[str, tuple[int, ...]] = {}

    def _words(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each word of the pattern."""
        bpe = self.bpe
        if len(self.by_word) > MAX_WORDS:
            self.by_word.clear()
        out = {w: self.by_word[w] for w in words if w in self.by_word}
        new = sorted(w for w in words if w not in out)
        out |= {w: (bpe.added[w],) for w in new if w in bpe.added}
        if plain := [w for w in new if w not in bpe.added]:
            bpe._encode_new(plain)
            out |= bpe.fresh
            self.by_word.update((w, i) for w, i in bpe.fresh.items() if len(w) <= MAX_KEPT_BYTES)
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Of each text: ids as little-endian unsigned 32-bit, and as decimals each with a comma after."""
        cut = [self.bpe.chunks(t or "") for t in texts]
        new: set[str] = set()
        for chunk, _ in cut:
            new.update(chunk)
        new = new.difference(self.known)
        split = {c: self.bpe.find(c) for c in new}
        own = {w for _, words in cut for w in words}
        ids = self._words(own.union(*split.values()) if split else own)
        packed, decimals = self.bpe.packed, self.bpe.decimals

        def forms(words: list[str]) -> tuple[bytes, bytes]:
            own = ids[words[0]] if len(words) == 1 else [i for w in words for i in ids[w]]
            return b"".join([packed[i] for i in own]), b"".join([decimals[i] for i in own])

        made = {c: forms(words) for c, words in split.items()}
        if len(self.known) + len(made) > MAX_WORDS:
            used = {c for chunk, _ in cut for c in chunk}
            self.known = {c: self.known[c] for c in used if c in self.known}
        known = self.known
        known.update(made)
        out = []
        for chunk, words in cut:
            if words:
                out.append(forms(words))
            else:
                got = [known[c] for c in chunk]
                out.append((b"".join([g[0] for g in got]), b"".join([g[1] for g in got])))
        for c in made:
            if len(c) > MAX_KEPT_BYTES:
                del known[c]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' tokens, gathered in one go."""
        bpe = self.bpe
        lens = bpe.lens[ids]
        ends = np.cumsum(lens)
        if not len(ids) or not ends[-1]:
            return b""
        shift = np.repeat(bpe.offsets[ids] - (ends - lens), lens)
        return bpe.flat[shift + np.arange(ends[-1])].tobytes()


_CODECS: dict[str, TextCodec] = {}


def codec(path: str) -> TextCodec:
    if path not in _CODECS:
        _CODECS[path] = TextCodec(path)
    return _CODECS[path]


ENCODED = T.StructType(
    [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_text", T.StringType())]
)
STEP = 256


def encode(text: Column, path: str) -> Column:
    """Struct of ``ids`` (little-endian unsigned 32-bit), ``n_tokens`` and ``ids_text`` (decimals joined by commas)."""

    @F.pandas_udf(ENCODED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for texts in batches:
            got = []
            for at in range(0, len(texts), STEP):
                got += own.encode(texts.iloc[at : at + STEP].tolist())
            yield pd.DataFrame({"ids": [g[0] for g in got], "n_tokens": [len(g[0]) // 4 for g in got], "ids_text": [g[1][:-1].decode() for g in got]})

    return run(text)


def decode(ids: Column, path: str) -> Column:
    """The text of packed ids; bytes that are no UTF-8 become U+FFFD, as the library's decoder has it."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for packed in batches:
            yield pd.Series([own.decode(np.frombuffer(p or b"", "<u4")).decode("utf-8", "replace") for p in packed])

    return run(ids)


def encode_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id count and digests of its ids and of its decoded text, in one pass.

    The texts themselves stay in the worker that encodes them.  Rows with
    equal keys stay separate rows; a null text is an empty one.
    """
    import hashlib

    import pyarrow as pa

    kind = docs.schema[key].dataType
    out = T.StructType(
        [T.StructField(key, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )

    def run(batches):
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                got = own.encode(part.column(1).to_pylist())
                ids = [np.frombuffer(g[0], "<u4") for g in got]
                texts = [own.decode(i).decode("utf-8", "replace").encode() for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(g[1][:-1]).hexdigest() for g in got], pa.string()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    ],
                    [key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(key, text).mapInArrow(run, out)
