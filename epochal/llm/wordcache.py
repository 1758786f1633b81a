"""Token ids of whole texts by a ``tokenizers`` file, encoded once a word.

A tokenizer that drops white space (its normalizer makes each run one space,
its pre-tokenizer's pieces never hold any) gives a text the ids of its
space-separated words, one after another: normalisation, lower-casing, added
tokens and merges never look across a plain space.  So each distinct word is
encoded once, and texts are gathered from the stored ids.  Only plain spaces
and newlines cut; any other white space stays inside a "word" and is left to
the library.

A run of Latin letters is one piece of the pre-tokenizer, so the library's
merge model alone gives its ids, without normalizer and pattern; a mark after
it is a piece of its own.  Both are tried on samples when a file is opened,
and the whole library is used where they don't hold.

Texts are cut, told apart and joined in columns (Arrow and NumPy); only words
that are new to a worker are handled one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words and ids kept by a worker in each of two generations: at so many, the younger one takes the place of the older.
MAX_WORDS = 500_000
MAX_IDS = 8_000_000
#: Characters of the texts that are encoded together (a longer text is on its own).
SLICE_BYTES = 8 << 20
#: Stands between words that are encoded together; words that hold it are encoded alone.
MARK = "\x02"
JOINED = 2_000
#: Latin letters whose case and normal form are the same in every version of Unicode, perhaps with one mark after them.
MARKS = ".,!?;:"
SIMPLE = "^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+[" + MARKS + "]?$"


def byte_letters() -> dict[int, int]:
    """The character that stands for a byte in a byte-level vocabulary, where that is another one than its own."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 0x100 + n for n, b in enumerate(b for b in range(0x100) if b not in own)}


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat``, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class Store:
    """Ids of words, one stretch a word."""

    def __init__(self) -> None:
        self.places: dict[str, int] = {}
        self.starts, self.sizes, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.uint32)
        self.used = 0

    def add(self, words: list[str], sizes: np.ndarray, flat: np.ndarray) -> None:
        n, k = len(self.places), len(words)
        if n + k > len(self.starts):
            more = np.zeros(2 * (n + k), np.int64)
            self.starts, self.sizes = np.concatenate([self.starts[:n], more]), np.concatenate([self.sizes[:n], more])
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(2 * (self.used + len(flat)), np.uint32)])
        self.starts[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + k] = sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.places.update(zip(words, range(n, n + k), strict=True))

    def find(self, words: list[str]) -> np.ndarray:
        """Places of words; -1: not here."""
        return np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, len(words))

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[places]
        return sizes, gathered(self.flat, self.starts[places], sizes)


class WordEncoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.now, self.old = Store(), Store()

        got = self._ids([f"a {MARK} a {MARK} ab"])[0]
        alone = self._ids([MARK, "a", "ab"])
        self.mark = alone[0][0] if len(alone[0]) == 1 and got == [*alone[1], *alone[0], *alone[1], *alone[0], *alone[2]] else None
        self.tails = [np.asarray(self._ids([m])[0], np.uint32) for m in MARKS]
        probe = [("Abc", "."), ("Éà", ","), ("x", "!"), ("don", "?"), ("ÿþ", ";"), ("Q", ":"), ("Straße", "."), ("Ǆŉſ", "?"), ("ĀɎ" * 20, ",")]
        self.plain = all(self._ids([w + m])[0] == self._ids([w.lower()])[0] + self._ids([m])[0] for w, m in probe)
        runs = [w.lower() for w, _ in probe] + ["the", "wordsthataremorethanone" * 3, "ñandú"]
        self.bare = [self._merged(w) for w in runs] == self._ids(runs)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, run: str) -> list[int]:
        """Ids of a lower-case run of letters by the merge model."""
        return [t.id for t in self.model.tokenize(run if run.isascii() else run.encode().decode("latin-1").translate(self.letters))]

    def _learn(self, words: pa.Array) -> None:
        """Put new words into the store.

        A run of Latin letters, perhaps with one mark after it, is the ids of
        the lower-case run and those of the mark, where the tokenizer treats
        them so (``self.plain``); a run may be known from another word.
        """
        if self.plain:
            simple = pc.match_substring_regex(words, SIMPLE)
            own, words = words.filter(simple), words.filter(pc.invert(simple))
            lower = pc.utf8_lower(pc.utf8_rtrim(own, MARKS))
            runs = lower.dictionary_encode()
            places = self._known(_strings(runs.dictionary))[runs.indices.to_numpy()]
            # words that are runs themselves are there by now
            other = np.flatnonzero(pc.not_equal(own, lower).to_numpy(zero_copy_only=False))
            own = own.take(other)
            tail = pc.index_in(pc.utf8_slice_codeunits(own, -1), pa.array(list(MARKS))).fill_null(-1).to_numpy()
            self._join(_strings(own), places[other], tail)
        odd = _strings(words)
        self._add(odd, self._encode(odd))

    def _known(self, names: list[str]) -> np.ndarray:
        """Places of lower-case runs, which are put into the store where they aren't yet."""
        places = self.now.find(names)
        missing = np.flatnonzero(places < 0)
        new = self._copied([names[i] for i in missing])
        self._add(new, list(map(self._merged, new)) if self.bare else self._encode(new))
        places[missing] = self.now.find([names[i] for i in missing])
        return places

    def _copied(self, names: list[str]) -> list[str]:
        """Take over what the older generation has; returns the others."""
        if not self.old.places:
            return names
        places = self.old.find(names)
        here = np.flatnonzero(places >= 0)
        if not len(here):
            return names
        self.now.add([names[i] for i in here], *self.old.ids(places[here]))
        return [names[i] for i in np.flatnonzero(places < 0)]

    def _join(self, words: list[str], places: np.ndarray, tail: np.ndarray) -> None:
        """Words that are a known run, and a mark (-1: none)."""
        store = self.now
        marks = [np.zeros(0, np.uint32) if t < 0 else self.tails[t] for t in range(-1, len(MARKS))]
        first = np.cumsum([0, *map(len, marks)])[:-1] + store.used
        starts = np.stack([store.starts[places], first[tail + 1]], 1).ravel()
        sizes = np.stack([store.sizes[places], np.array([len(m) for m in marks])[tail + 1]], 1)
        flat = gathered(np.concatenate([store.flat[: store.used], *marks]), starts, sizes.ravel())
        store.add(words, sizes.sum(1), flat)

    def _add(self, words: list[str], ids: list[list[int]]) -> None:
        if words:
            self.now.add(words, np.fromiter(map(len, ids), np.int64, len(ids)), np.array([i for own in ids for i in own], np.uint32))

    def _encode(self, words: list[str]) -> list[list[int]]:
        """Many words go to the library as one text, a mark of one id between them."""
        if self.mark is None or any(MARK in w for w in words):
            return self._ids(words)
        out: list[list[int]] = []
        for at in range(0, len(words), JOINED):
            ids, start = self._ids([f" {MARK} ".join(words[at : at + JOINED])])[0], 0
            for stop in [*np.flatnonzero(np.asarray(ids) == self.mark).tolist(), len(ids)]:
                out.append(ids[start:stop])
                start = stop + 1
        return out

    def _places(self, unique: pa.Array) -> np.ndarray:
        names = _strings(unique)
        places = self.now.find(names)
        missing = np.flatnonzero(places < 0)
        if not len(missing):
            return places
        if len(self.now.places) + len(missing) > MAX_WORDS or self.now.used > MAX_IDS:
            self.now, self.old = Store(), self.now
            missing = np.arange(len(names))
            places = np.empty(len(names), np.int64)
        names = [names[i] for i in missing]
        if new := self._copied(names):
            self._learn(pa.array(new, pa.string()))
        places[missing] = self.now.find(names)
        return places

    def arrays(self, texts: pa.Array, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of one slice of the texts after another: ids of its texts, and where each text ends.

        A null is an empty text; ``end`` is appended to each text.
        """
        size = pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64)
        part = (np.cumsum(size) - size) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)] if len(size) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield self._slice(texts.slice(a, b - a), end)

    def _slice(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        index, stops = coded.indices.to_numpy(), split.value_lengths().to_numpy().cumsum()
        places = self._places(coded.dictionary)
        starts, sizes, flat = self.now.starts[places], self.now.sizes[places], self.now.flat
        if end is not None:
            starts, sizes = np.append(starts, self.now.used), np.append(sizes, 1)
            flat = np.append(flat[: self.now.used], np.uint32(end))
            index = np.insert(index, stops, len(places))
            stops = stops + np.arange(1, len(stops) + 1)
        sizes = sizes[index]
        ends = np.concatenate([[0], np.cumsum(sizes)])[stops]
        return gathered(flat, starts[index], sizes), ends

    def texts(self, texts: pa.Array, end: int | None = None) -> Iterator[np.ndarray]:
        """Unsigned 32-bit ids of each text, then ``end``; null: empty."""
        for flat, ends in self.arrays(texts, end):
            yield from np.split(flat, ends[:-1])

    def encode(self, texts: list[str | None], end: int | None = None) -> list[np.ndarray]:
        return list(self.texts(pa.array(texts, pa.string()), end))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
