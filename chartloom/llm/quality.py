"""Line-first cleaning: rules on each line, then on what the document loses.

All of it is native columns.  A text is taken apart inside its row; nothing is
shuffled, and a long text costs its own length only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import let

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

# Fixed values of the line rules.
MARKS = r"[#*$%&|<>~^=_\\{}\[\]@+]"
SHOUTS = r"[!?][!?]+"
# Marks that end or part sentences: Latin, Greek and Cyrillic; Chinese and Japanese; Arabic, Persian and Urdu; Indic;
# Armenian; Ethiopic; Burmese; Tibetan; Khmer.
SENTENCE_MARKS = r"[.!?,;:…·。、，！？；：．؟،؛۔।॥։՞՝።፣፤፥፧၊။།༎។៕]"
SEPARATORS = r" [|»›•·>] | [|»›•·>]$|^[|»›•·>] "
BOILERPLATE = (
    r"(?i)all rights reserved|cookie|privacy policy|terms of (use|service)|licensed under|released under the"
    r"|click here|sign (in|up)\b|log ?in\b|subscribe|javascript|copyright|©"
    r"|alle rechte vorbehalten|datenschutzerkl[äÄ]rung|hier klicken"
    r"|tous droits r[éÉe]serv[éÉe]s|politique de confidentialit[éÉe]|cliquez ici"
    r"|todos los derechos reservados|pol[íÍi]tica de privacidad|haga clic"
)
MARK_SHARE = 15  # per cent of a line's characters
SHOUT_WORDS = 4  # at least one shout for so many words
NAV_WORDS = 4  # at most so many words between separators
LONG_LINE = 12  # words from which a line needs a sentence mark
NOTICE_WORDS = 20  # a notice has at most so many words
MIN_WORDS = 20
MAX_REPEAT = 30  # per cent of words in repeated windows
MAX_LOST = 50  # per cent of a text's characters that cleaning may take


def split_words(text: Column) -> Column:
    """Runs of characters that are no white space; an empty array for a null or blank text."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """How many words lie in a window of ``size`` words that the array holds twice or more.

    Windows are compared by 64-bit hashes.  Where all are different, which one
    hash set tells, nothing else is done.
    """

    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - size)
        found = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
        return F.when(F.size(hashes) >= size, found).otherwise(F.array().cast("array<bigint>"))

    def covered(wins: Column) -> Column:
        at = F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def doubles(ordered: Column) -> Column:
            same = F.filter(
                ordered,
                lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"]),
            )
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            let(F.sort_array(at), doubles),
            start,
            lambda a, p: F.struct((a["n"] + p + size - F.greatest(p, a["end"])).alias("n"), (p + size).alias("end")),
        )["n"]

    return let(
        let(F.transform(words, lambda w: F.xxhash64(w)), windows),
        lambda wins: F.when(F.size(F.array_distinct(wins)) == F.size(wins), F.lit(0)).otherwise(covered(wins)),
    )


def line_fails(line: Column) -> Column:
    """Whether a punctuation, navigation or boilerplate rule is against the line."""
    n_words = F.regexp_count(line, F.lit(r"[^ \t-\r]+"))
    marks = F.regexp_count(line, F.lit(MARKS))
    shouts = F.regexp_count(line, F.lit(SHOUTS))
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    punctuation = (
        (marks * 100 > F.char_length(line) * MARK_SHARE)
        | ((shouts >= 2) & (shouts * SHOUT_WORDS >= n_words))
        | ((n_words >= LONG_LINE) & ~line.rlike(SENTENCE_MARKS))
    )
    navigation = (separators >= 2) & (n_words - separators <= (separators + 1) * NAV_WORDS)
    notice = (n_words <= NOTICE_WORDS) & line.rlike(BOILERPLATE)
    return punctuation | navigation | notice


def measures(text: Column) -> Column:
    """One struct of all counts, the cleaned text and the verdict.

    ``text`` may be null: it counts as empty.  The text is split once.
    """
    whole = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        def cleaned(filled: Column) -> Column:
            chars = lambda a: F.char_length(F.array_join(a, ""))
            return let(
                F.filter(filled, lambda x: ~line_fails(x)),
                lambda good: F.struct(
                    F.array_join(good, "\n").alias("clean_text"),
                    (F.size(filled) - F.size(F.array_distinct(filled))).cast("long").alias("n_dup_lines"),
                    (F.size(filled) - F.size(good)).cast("long").alias("n_removed_lines"),
                    chars(filled).cast("long").alias("line_chars"),
                    (chars(filled) - chars(good)).cast("long").alias("lost_chars"),
                ),
            )

        return let(F.filter(lines, lambda x: x.rlike(r"[^ \t-\r]")), cleaned)

    return F.struct(
        let(split_words(text), of_words).alias("words"),
        let(F.split(whole, "\n"), of_lines).alias("lines"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )


def judge(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with one struct column ``quality`` (a column of that name is replaced).

    Its fields: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``n_removed_lines``, ``lost_chars``, ``base_failed``,
    ``kept`` and ``clean_text`` (the lines no rule is against, joined by \\n; lines
    without a word go).  A null or empty text has no words: all counts are 0,
    ``base_failed`` is true and ``kept`` false.  Every input row gives one row;
    repeated rows are judged alike, and other columns pass through.
    """
    return df.withColumn("quality", let(measures(df[text_col]), _verdict))


def keep_good(df: DataFrame, text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """The rows of ``judge`` that are kept, with its struct as ``out_col``.

    Not a filter on its column: that would be moved below it, and every text be judged
    twice.
    """
    good = F.filter(F.array(let(measures(df[text_col]), _verdict)), lambda q: q["kept"])
    return df.select(*[df[c] for c in df.columns if c != out_col], F.explode(good).alias(out_col))


def _verdict(m: Column) -> Column:
    words, lines = m["words"], m["lines"]
    base_failed = (words["n_words"] < MIN_WORDS) | (words["n_repeat_words"] * 100 > words["n_words"] * MAX_REPEAT)
    return F.struct(
        words["n_words"].alias("n_words"),
        words["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        lines["n_dup_lines"].alias("n_dup_lines"),
        words["n_repeat_words"].alias("n_repeat_words"),
        lines["n_removed_lines"].alias("n_removed_lines"),
        lines["lost_chars"].alias("lost_chars"),
        base_failed.alias("base_failed"),
        (~base_failed & (lines["lost_chars"] * 100 <= lines["line_chars"] * MAX_LOST)).alias("kept"),
        lines["clean_text"].alias("clean_text"),
    )
