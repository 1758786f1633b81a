"""URL verdicts by a bit-parallel wildcard automaton.

All glob rules are laid side by side in a row of bits, one bit a position of a
rule, packed into 64-bit words.  Reading one character moves every rule of
every URL of a batch at once (Shift-And)::

    state = ((state << 1) & takes[char]) | (state & stays[char])

``takes`` has the positions that the character leads into, ``stays`` those
that a wildcard before the position keeps alive.  The first bit of a rule is
never in ``takes``, so that a shift never carries from one rule into the next.

The automaton reads the canonical URL with a dot before it: ``.host/path``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rules (host with path) and their verdicts: the longest that fits wins.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Globs over ``.host/path`` that block where no rule fits: log-in, shop and advertising pages, programs and archives.
GLOBS = (
    "*/wp-login*",
    "*/wp-admin/*",
    "*/cgi-bin/*",
    "*/login*",
    "*/signin*",
    "*/cart/*",
    "*/checkout/*",
    "*/ads/*",
    "*/banner?/*",
    ".ads.*",
    "*.doubleclick.*",
    "*.exe",
    "*.zip",
    "*.tar.gz",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH = 4096


class Automaton:
    """``patterns``: lists of steps ``(kind, value)``; kinds are ``char``, ``any`` and ``run`` (value: characters it stops at)."""

    def __init__(self, patterns: Sequence[list[tuple[str, str]]]):
        literals = sorted({ord(c) for p in patterns for kind, value in p for c in value if kind != "any"})
        self.class_of = np.zeros(0x110000, np.uint16)  # 0: a character that no rule names
        for n, code in enumerate(literals):
            self.class_of[code] = n + 1
        classes = len(literals) + 1
        bits = sum(sum(kind != "run" for kind, _ in p) + 1 for p in patterns)
        self.words = -(-max(bits, 1) // 64)
        takes, stays = np.zeros((2, classes, self.words, 64), bool)
        first = np.zeros((self.words, 64), bool)
        self.accept: list[tuple[int, int]] = []
        at = 0
        for pattern in patterns:
            first[at // 64, at % 64] = True
            for kind, value in pattern:
                if kind == "run":
                    stays[:, at // 64, at % 64] = True
                    for c in value:
                        stays[self.class_of[ord(c)], at // 64, at % 64] = False
                    continue
                at += 1
                if kind == "any":
                    takes[:, at // 64, at % 64] = True
                else:
                    takes[self.class_of[ord(value)], at // 64, at % 64] = True
            self.accept.append(divmod(at, 64))
            at += 1
        weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
        self.takes, self.stays, self.first = (np.where(x, weights, np.uint64(0)).sum(-1, dtype=np.uint64) for x in (takes, stays, first))

    def matches(self, texts: Sequence[str]) -> np.ndarray:
        """Boolean matrix: texts by patterns that fit the whole text."""
        data = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        size = np.array([len(d) for d in data], np.int64)
        order = np.argsort(-size, kind="stable")
        flat = self.class_of[np.concatenate([data[i] for i in order])] if len(data) else np.zeros(0, np.uint16)
        size = size[order]
        start = np.cumsum(size) - size
        state = np.repeat(self.first[None], len(data), 0)
        for t in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -t, "left"))  # longer than t
            now = state[:live]
            char = flat[start[:live] + t]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.takes[char]) | (now & self.stays[char])
        out = np.empty((len(data), len(self.accept)), bool)
        for n, (word, bit) in enumerate(self.accept):
            out[order, n] = (state[:, word] >> np.uint64(bit)) & np.uint64(1) == 1
        return out


def glob_steps(glob: str) -> list[tuple[str, str]]:
    """``*``: any run of characters; ``?``: any one; all others stand for themselves."""
    return [("run", "") if c == "*" else ("any", "") if c == "?" else ("char", c) for c in glob]


def rule_steps(rule: str) -> list[tuple[str, str]]:
    """A rule fits its host and all subdomains, and every path that starts as its own."""
    host, slash, path = rule.partition("/")
    return [("run", "/"), *(("char", c) for c in f".{host}{slash or '/'}{path}"), ("run", "")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for a null or no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty for a null or no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, globs: Sequence[str] = GLOBS, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the longest that fits, ties to the first listed), ``glob`` and ``verdict``.

    Where no rule fits, a URL is blocked if a glob fits, else allowed; null and
    malformed URLs have an empty host and path and are allowed.  Columns of
    these names that the input has are replaced.  Nothing is shuffled; the
    rules are part of the plan.
    """
    ranked = sorted(range(len(rules)), key=lambda n: (-len(rules[n][0]), n))
    automaton = Automaton([rule_steps(rules[n][0]) for n in ranked] + [glob_steps(g) for g in globs])
    split = len(rules)

    @F.pandas_udf(T.StructType([T.StructField("rule", T.IntegerType()), T.StructField("glob", T.IntegerType())]))
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [automaton.matches(texts.iloc[at : at + BATCH].tolist()) for at in range(0, len(texts), BATCH)]
            hit = np.concatenate(parts) if parts else np.zeros((0, split + len(globs)), bool)
            found = []
            for part in (hit[:, :split], hit[:, split:]):
                found.append(np.where(part.any(1), part.argmax(1), -1) if part.shape[1] else np.full(len(hit), -1))
            yield pd.DataFrame({"rule": found[0].astype("int32"), "glob": found[1].astype("int32")})

    def pick(values: Sequence[str], index: Column) -> Column:
        return F.when(index >= 0, F.get(F.array(*map(F.lit, values)), index)) if values else F.lit(None).cast("string")

    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    out = out.withColumn("__hit", search(F.concat(F.lit("."), "host", "path")))
    hit = F.col("__hit")
    out = out.withColumns({"rule": pick([rules[n][0] for n in ranked], hit["rule"]), "glob": pick(globs, hit["glob"])})
    verdict = F.coalesce(pick([rules[n][1] for n in ranked], hit["rule"]), F.when(F.col("glob").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumn("verdict", verdict).drop("__hit")


def sql(rules: Sequence[tuple[str, str]] = RULES, globs: Sequence[str] = GLOBS) -> str:
    """The same verdicts in SQL (rules and globs without quotes or LIKE's own signs)."""
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        host, _, path = rule.partition("/")
        fits.append((f"('.' || host) LIKE '%.{host}' AND starts_with(path, '/{path}')", rule, verdict))
    hits = " OR ".join(f"('.' || host || path) LIKE '{g.replace('*', '%').replace('?', '_')}'" for g in globs) or "false"
    case = lambda n, other: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[n]}'" for f in fits) + f" {other} END"
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path, {case(1, "ELSE NULL")} AS rule,
       {case(2, f"WHEN {hits} THEN 'block' ELSE 'allow'")} AS verdict
FROM parts"""
