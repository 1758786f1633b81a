"""Line-first cleaning: rules judge each line, then documents by what is left.

A line fails that does not end like a sentence, that is full of doubled
punctuation, that reads like a navigation bar, or that is short and holds a
boilerplate phrase (in a long line the phrase is a small part of a text).  Failing lines go; a document goes if less than ``LEAST_LEFT`` of the
characters of its non-blank lines is left, or if a base rule rejects it (too
few words, or too many words in repeated passages).

Column expressions only; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochal.llm import textstats

LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
LEAST_LEFT = 0.5
#: What may follow a sentence on its line: ASCII white space (the CR of CRLF too) and no-break spaces.
SPACES = " \t\n\x0b\x0c\r\u00a0\u2007\u202f"
#: Last characters of a sentence, closing quotes and brackets included.
SENTENCE_ENDS = ".!?…:;\"'”’»)]。！？"
DOUBLED = r"[!?#*$%&]{2,}( |$)"
SEPARATORS = (" | ", " > ", " » ", " › ", " · ", " • ")
SEPARATOR = r" [|>»›·•] "
LEAST_SEPARATORS = 3
#: Characters of a line that a boilerplate phrase can spoil.
PHRASE_LINE = 200
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie",
    "javascript",
    "lorem ipsum",
    "sign up for",
    "subscribe to",
    "licensed under",
    "released under the",
    "skip to content",
    "click here",
)


def bad_line(line: Column) -> Column:
    """Whether a non-blank line fails."""
    last = F.right(F.rtrim(line, F.lit(SPACES)), F.lit(1))
    ends = F.instr(F.lit(SENTENCE_ENDS), last) > 0
    doubled = 4 * F.regexp_count(line, F.lit(DOUBLED)) >= F.size(F.split(line, " "))
    has_doubled = _any(line, [c + c for c in "!?#*$%&"])
    bar = F.size(F.split(line, SEPARATOR)) > LEAST_SEPARATORS
    phrase = F.when(F.length(line) <= PHRASE_LINE, _any(F.lower(line), BOILERPLATE)).otherwise(False)
    return ~ends | F.when(has_doubled, doubled).otherwise(False) | F.when(_any(line, SEPARATORS), bar).otherwise(False) | phrase


def _any(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def lines(text: Column) -> Column:
    """Lines that hold a word, i.e. anything but white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base statistics, ``clean_text``, ``n_lines``, ``n_removed_lines``, ``base_failed`` and ``kept``.

    A null or empty text has no words: it fails.  Columns of these names that
    the input has are replaced; ``__words`` and ``__lines`` are used inside.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({"__words": textstats.words(F.col(text)), "__lines": lines(F.col(text))})
    out = out.withColumn("__kept", F.filter("__lines", lambda x: ~bad_line(x)))
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": textstats.count_chars(source, textstats.SYMBOLS),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": textstats.repeated_words(F.col("__words")),
            "n_lines": F.size("__lines").cast("long"),
            "n_removed_lines": (F.size("__lines") - F.size("__kept")).cast("long"),
            "clean_text": F.array_join("__kept", "\n"),
        }
    )
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))
    left = F.length("clean_text") >= LEAST_LEFT * F.length(F.array_join("__lines", "\n"))
    return out.withColumn("kept", ~F.col("base_failed") & left).drop("__words", "__lines", "__kept")


def sql() -> str:
    """The same in SQL, windows as rows."""
    space = r"[^\x20\x09-\x0D]"
    quote = lambda s: s.replace("'", "''")
    has = lambda x, parts: "(" + " OR ".join(f"contains({x}, '{quote(p)}')" for p in parts) + ")"
    ends = quote(SENTENCE_ENDS)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{space}+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{space}')) AS l FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS v FROM (
    SELECT doc_id, w, unnest(generate_series(1, len(w)::BIGINT - 7)) AS i FROM d WHERE len(w) > 7)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM again) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         length(array_to_string(l, chr(10))) AS n_all,
         list_filter(l, lambda x: contains('{ends}', right(rtrim(x, ' '), 1)) AND right(rtrim(x, ' '), 1) <> ''
           AND NOT ({has("x", [c + c for c in "!?#*$%&"])} AND 4 * len(regexp_extract_all(x, '{DOUBLED}')) >= len(string_split(x, ' ')))
           AND NOT ({has("x", SEPARATORS)} AND len(regexp_split_to_array(x, '{SEPARATOR}')) > {LEAST_SEPARATORS})
           AND NOT (length(x) <= {PHRASE_LINE} AND {has("lower(x)", BOILERPLATE)})) AS k
  FROM d LEFT JOIN rep USING (doc_id)),
j AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND length(array_to_string(k, chr(10))) >= {LEAST_LEFT} * n_all AS kept,
       len(k)::BIGINT AS n_kept_lines
FROM j"""
