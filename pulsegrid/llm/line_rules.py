"""Line-first cleaning, by Spark's own functions only.

Rules judge each line by its punctuation, navigation signs and boilerplate: whole phrases that make up most of a short
line, so that prose which mentions one stays, and statements of rights where a line begins or ends. Lines that
fail are removed; then documents that lost too much of their text are rejected. Documents with
too few words, or mostly made of repeated three-word windows, fail beforehand.

Nulls count as empty texts, which have no words and are rejected. Lines without a word count as
kept. Rows are independent of one another; columns beside the text are left alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import once

BLANK = " \t\n\x0b\f\r"
SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Digits, and letters of scripts that part words by spaces: Latin, Greek, Cyrillic.
LETTERS = "0-9A-Za-zÀ-ÖØ-öø-ɏΆ-ώЀ-ԯ"
#: Phrases of site furniture in English, French, German and Spanish, lower case (fixed values).
PHRASES = (
    "all rights reserved", "privacy policy", "cookie policy", "accept cookies", "terms of use", "terms of service", "click here", "subscribe now", "sign up", "log in", "read more", "share this",
    "enable javascript", "copyright",
    "tous droits réservés", "politique de confidentialité", "accepter les cookies", "conditions d'utilisation", "mentions légales", "cliquez ici", "lire la suite",
    "alle rechte vorbehalten", "datenschutzerklärung", "cookies akzeptieren", "nutzungsbedingungen", "impressum", "hier klicken", "weiterlesen",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "aceptar cookies", "términos de uso", "haga clic aquí", "leer más", "iniciar sesión",
)
#: Statements of licences and rights, where a line begins or ends with them (fixed values).
STATEMENTS = (
    "^[^L]*permission is hereby granted[^L]", "^[^L]*(?:(?:this|the) [a-z]+ is )?licensed under[^L]", "^[^L]*(?:copyright|©|\\(c\\))(?: *(?:©|\\(c\\)))?[^L]*[12][0-9][0-9][0-9]",
    "(?:^|[^L])(?:all rights reserved|tous droits réservés|alle rechte vorbehalten|todos los derechos reservados)[^L]*$",
)
STATED = "|".join(f"(?:{x})" for x in STATEMENTS).replace("^L", f"^{LETTERS}")
#: A phrase as a whole, in a line whose every other character than letters and digits is doubled, so that a phrase and the
#: next can share what stands between them.
WHOLE = f"(?:^|[^{LETTERS}])(?:{'|'.join(re.sub(f'[^{LETTERS}]', lambda m: 2 * m[0], x) for x in PHRASES)})(?:$|[^{LETTERS}])"
ANY = "|".join(PHRASES)
#: What every line with a phrase or a statement holds.
HINT = "|".join((*PHRASES, "permission is hereby granted", "licensed under", "©", "\\(c\\)"))
#: Signs between the items of a navigation line: two are enough, or three of those that prose uses too.
RARE, COMMON = "»›•·→", "/>–"
#: Phrases make up so many hundredths of a line's letters at least.
MOSTLY = 40
#: A line without a mark at its end.
OPEN_END = f"[{LETTERS}][\\x20\\x09-\\x0D]*\\z"
MIN_WORDS, MAX_REPEAT, MAX_LOST = 50, 50, 30


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def count_of(text: Column, chars: str) -> Column:
    """Occurrences of some rare characters."""
    return F.regexp_count(text, F.lit(f"[\\Q{chars}\\E]"))


def signs(line: Column, chars: str) -> Column:
    """How many of these characters stand alone between blanks."""
    return F.regexp_count(line, F.lit(f"(?:^|[ \t])[{chars}](?:[ \t\r]|$)"))


def mostly_phrases(line: Column) -> Column:
    """Whether phrases make up most of a line's letters. Only whole words count: "catalog in" holds no "log in"."""
    other = f"[^{LETTERS}]"
    low = F.lower(line)
    left = F.regexp_replace(F.regexp_replace(low, f"({other})", "$1$1"), WHOLE, "")
    every, rest = (F.char_length(F.regexp_replace(x, other, "")) for x in (low, left))
    return 100 * (every - rest) >= MOSTLY * every


def bad_line(line: Column) -> Column:
    """Whether a line fails: symbols or !? above a tenth of its characters, bars or other navigation signs between
    every few words, a short line that phrases of site furniture make up for the most part, a statement of rights or
    licence at its begin or end, or one to three words that end in no mark at all.

    Each rule asks what is cheap first. Lines without a word meet none of them."""
    chars, gaps = F.char_length(without(line, BLANK)), F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    symbols, shouts, bars = count_of(line, SYMBOLS), count_of(line, "!?"), count_of(line, "|")
    marked = line.rlike(f"[{SYMBOLS}]") & ((10 * symbols > chars) | ((bars >= 1) & (4 * bars >= gaps)))
    shouted = (shouts >= 4) & (10 * shouts > chars)
    rare, common = signs(line, RARE), signs(line, COMMON)
    parted = line.rlike(f"[{RARE}{COMMON}]") & (((rare >= 2) & (4 * rare + 2 >= gaps) & ~line.contains("«")) | ((common >= 3) & (4 * common + 2 >= gaps)))
    short = (F.char_length(line) <= 200) | (chars <= 200)
    boilerplate = short & F.lower(line).rlike(HINT) & ((F.lower(line).rlike(ANY) & mostly_phrases(line)) | F.lower(line).rlike(STATED))
    few = F.octet_length(F.substring_index(line, " ", 3)) == F.octet_length(line)  # two gaps at most
    return marked | shouted | parted | boilerplate | (few & line.rlike(OPEN_END))


def repeat_words(grams: str) -> Column:
    """Words in three-word windows that occur twice or more. ``grams`` holds the windows' hashes; only texts in
    which two agree are sorted by (hash, place), where equal windows are neighbours."""
    distinct = F.size(F.array_distinct(grams))
    placed = F.sort_array(F.transform(F.col(grams), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # the sorted array is bound once, as the only element that the lambda sees
    places = F.element_at(F.transform(F.array(placed), _twice), 1)
    covered = F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.sequence(i, i + 2)))))
    return F.when(F.size(grams) == distinct, F.lit(0)).otherwise(covered)


def _twice(s: Column) -> Column:
    """The places whose hash stands next to an equal one in the sorted array ``s`` of two or more."""
    hashes, none = F.transform(s, lambda x: x["h"]), F.array(F.lit(None).cast("bigint"))
    before, after = F.concat(none, F.slice(hashes, 1, F.size(s) - 1)), F.slice(hashes, 2, F.size(s) - 1)
    around = F.arrays_zip(s.alias("x"), before.alias("b"), after.alias("a"))
    kept = F.filter(around, lambda z: (z["b"] == z["x"]["h"]) | (z["a"] == z["x"]["h"]))
    return F.transform(kept, lambda z: z["x"]["i"])


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept and cleaned text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")  # columns of any name stay out of the way
    rows = docs.select(own, text.alias("text")).select(
        "own", "text", F.array_remove(F.split("text", SPLIT), "").alias("words"), F.split("text", "\n").alias("lines")
    )
    third = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    grams = F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), third)).otherwise(F.array().cast("array<bigint>"))
    worded = F.filter("lines", lambda x: F.trim(x, F.lit(BLANK)) != "")
    good = F.filter("lines", lambda x: ~bad_line(x))
    rows = rows.select("own", "text", F.size("words").alias("n_words"), F.char_length(F.array_join("words", "")).alias("word_chars"), grams.alias("grams"), worded.alias("worded"), F.array_join(good, "\n").alias("cleaned"))
    rows = once(
        rows, ["own", "cleaned"],
        F.col("n_words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        repeat_words("grams").cast("long").alias("n_repeat_words"),
        # a cleaned text as long as the whole one is the whole one
        F.when(F.octet_length("cleaned") == F.octet_length("text"), F.col("word_chars")).otherwise(F.char_length(without(F.col("cleaned"), BLANK))).cast("long").alias("left_chars"),
    ).withColumn("lost_chars", F.col("word_chars") - F.col("left_chars"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST * F.col("word_chars")))


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measures and the verdict."""
    return measured(docs).select(F.col("own.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents, with the columns of ``docs``, their text without the lines that failed."""
    found = measured(docs).where("kept")
    fresh = {"text": F.col("cleaned"), "n_chars": F.char_length("cleaned").cast("long")}
    return found.select(*(fresh.get(c, F.col(f"own.`{c}`")).alias(c) for c in docs.columns))


def sql() -> str:
    """The verdicts in DuckDB's SQL."""
    blank, other = "[ \\x09-\\x0D]", f"[^{LETTERS}]"
    whole, stated, phrases = (x.replace("'", "''") for x in (WHOLE, STATED, ANY))
    signs = lambda chars: f"len(regexp_extract_all(line, '(?:^|[ \\t])[{chars}](?:[ \\t\\r]|$)'))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{blank}+'), lambda x: x <> '') AS words, string_split(text, chr(10)) AS lines FROM d),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM t, (VALUES (0), (1), (2)) v(k) GROUP BY r),
u AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM w),
m AS (SELECT r, line, length(regexp_replace(line, '{blank}', '', 'g')) AS chars, length(line) - length(regexp_replace(line, '[!?]', '', 'g')) AS shouts,
  length(line) - length(replace(line, '|', '')) AS bars, length(line) - length(replace(line, ' ', '')) AS gaps,
  length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols, {signs(RARE)} AS rare, {signs(COMMON)} AS common, length(regexp_replace(lower(line), '{other}', '', 'g')) AS letters,
  length(regexp_replace(regexp_replace(regexp_replace(lower(line), '({other})', '\\1\\1', 'g'), '{whole}', '', 'g'), '{other}', '', 'g')) AS other_letters FROM u),
b AS (SELECT r, line, chars, chars > 0 AND (10 * symbols > chars OR (shouts >= 4 AND 10 * shouts > chars) OR (bars >= 1 AND 4 * bars >= gaps)
  OR (rare >= 2 AND 4 * rare + 2 >= gaps AND NOT contains(line, '«')) OR (common >= 3 AND 4 * common + 2 >= gaps)
  OR (chars <= 200 AND 100 * (letters - other_letters) >= {MOSTLY} * letters AND regexp_matches(lower(line), '{phrases}')) OR (chars <= 200 AND regexp_matches(lower(line), '{stated}')) OR (gaps <= 2 AND regexp_matches(line, '{OPEN_END}'))) AS bad FROM m),
l AS (SELECT r, sum(CASE WHEN bad THEN chars ELSE 0 END) AS lost, sum(chars) AS word_chars, count(*) FILTER (chars > 0) - count(DISTINCT line) FILTER (chars > 0) AS dup FROM b GROUP BY r),
a AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, l.word_chars::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  l.dup::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, l.lost::BIGINT AS lost_chars FROM w JOIN l USING (r) LEFT JOIN p USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost_chars <= {MAX_LOST} * word_chars AS kept, lost_chars FROM f"""
