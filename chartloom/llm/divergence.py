"""How far the sources of a language differ in the words they use.

Texts are cut by a table: ``bytes.translate`` lowers letters and blanks all else in one
pass, ``bytes.split`` gives the terms, and a ``Counter`` a document their frequencies.
A task adds up what its documents count before anything is shuffled.  All figures are
integers; a pair's sum over all kept terms is worked out from the terms that occur.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.common import cut

#: Documents of its language that a kept term is in, at least.
LEAST_DOCS = 10
#: Ranks of a source's own terms.
TOP = 10
#: A share of 1 in the integers that shares are counted in.
WHOLE = 1_000_000_000
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20
#: Terms that a task holds before it adds them up and passes them on.
HELD = 1 << 19


def _cutting_table() -> bytes:
    """A-Z to a-z; a-z and bytes beyond ASCII as they are; a blank for all else."""
    table = bytearray(b" " * 256)
    for low, high in ((0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = range(low, high + 1)
    table[0x41 : 0x5A + 1] = range(0x61, 0x7A + 1)
    return bytes(table)


TABLE = _cutting_table()


def term_counts(text: bytes) -> Counter[bytes]:
    """How often each term occurs in a text."""
    cut_text = text.translate(TABLE)
    if len(cut_text) <= PIECE:
        return Counter(cut_text.split())
    counts: Counter[bytes] = Counter()
    low = 0
    while low < len(cut_text):
        high = cut_text.find(b" ", low + PIECE)
        high = len(cut_text) if high < 0 else high
        counts.update(cut_text[low:high].split())
        low = high
    return counts


def counted_terms(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``docs`` (documents with the term); see ``audit``."""
    rows = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])

    def added_up(groups: list[tuple[str, str]], group: list[int], terms: list[bytes], counts: list[int]) -> pa.RecordBatch:
        table = pa.table({"g": pa.array(group, pa.int32()), "term": pa.array(terms, pa.binary()), "n": pa.array(counts, pa.int64())})
        table = table.group_by(["g", "term"]).aggregate([("n", "sum"), ("n", "count")])
        langs, sources = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
        at = table.column("g").combine_chunks()
        # Terms are whole runs of UTF-8 bytes, so they are text.
        columns = [langs.take(at), sources.take(at), table.column("term").combine_chunks().cast(pa.string()),
                   table.column("n_sum").combine_chunks(), table.column("n_count").combine_chunks()]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple[str, str], int] = {}
        group: list[int] = []
        terms: list[bytes] = []
        counts: list[int] = []
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lang_, source_, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                found = term_counts(held.as_py())
                group += [number.setdefault((lang_, source_), len(number))] * len(found)
                terms += found.keys()
                counts += found.values()
                if len(terms) >= HELD:
                    yield added_up(list(number), group, terms, counts)
                    number, group, terms, counts = {}, [], [], []
        if terms:
            yield added_up(list(number), group, terms, counts)

    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """The smoothed share of a term in ``WHOLE`` parts, and 1: 1 + floor(WHOLE (count + 2) / (total + 2 kept))."""
    count, total, kept = (x.cast("decimal(18,0)") for x in (count, total, kept))
    return F.lit(1).cast("long") + F.call_function("div", F.lit(WHOLE).cast("decimal(10,0)") * (count + 2), total + kept * 2)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most WHOLE + 1, so that the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(
    df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank`` for every occurring pair of language and source.

    Part ``pair``: each other source of the language and the sum of ``gap`` over all terms
    kept in the language.  Part ``term``: up to ``top`` terms the source uses more than the
    language, by ``gap``.  A language keeps the terms in ``least_docs`` of its documents or
    more; a share counts occurrences in the source (or the language) of kept terms.

    Null language, source and text count as empty ones.  A text without terms still makes
    its source occur.  Equal values are ranked by item, in the order of UTF-8 bytes.
    Repeated rows count as often as they occur.  A language that keeps no term has value 0
    for all pairs and no terms.  A language of one source has no pairs.  Other columns of
    ``df`` are ignored.  An empty table gives no rows.

    Tasks add up their documents before the one shuffle of terms, so that a hot source is
    as many rows as it has terms and tasks.  A pair needs a row for each term both sources
    have, added up before it is shuffled: all else comes from how many of a source's terms
    occur how often.
    """
    names = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
    by_term = Window.partitionBy("lang", "term")
    counts = counted_terms(df, lang, source, text)
    counts = counts.withColumn("in_docs", F.sum("docs").over(by_term)).withColumn("all", F.sum("n").over(by_term))
    counts = cut(counts.filter(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "all"))

    per_lang = counts.groupBy("lang", "term").agg(F.first("all").alias("all")).groupBy("lang").agg(
        F.sum("all").alias("lang_total"), F.count("*").alias("kept")
    )
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = df.select(*names).distinct().join(totals, ["lang", "source"], "left").join(per_lang, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "kept")])
    none = F.when(F.col("kept") > 0, share(zero, F.col("total"), F.col("kept")))
    groups = cut(groups.withColumn("p0", none))

    shares = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    q = share(F.col("all"), F.col("lang_total"), F.col("kept"))
    above = shares.withColumn("q", q).filter("p > q").withColumn("value", gap(F.col("p"), F.col("q")))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    terms = terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)

    pairs = _pairs(groups, shares.select("lang", "source", "term", "p", "p0"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(terms)


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value`` of all two sources of a language.

    With f00 for two terms that occur in neither source, the sum is f00 for each kept
    term, plus what each source's own terms change if the other lacks them, plus what is
    to mend where both have the term.
    """
    mine = groups.select("lang", "source", "kept", F.col("p0").alias("a0"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("b0"))
    ordered = mine.join(other, "lang").filter("source <> item")

    # Many terms of a source occur equally often: their share is looked at once.
    levels = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    apart = ordered.join(levels, ["lang", "source"]).groupBy("lang", "source", "item").agg(
        F.sum(F.col("terms") * (gap(F.col("p"), F.col("b0")) - gap(F.col("a0"), F.col("b0")))).alias("change")
    )

    left = shares.select("lang", "term", "source", F.col("p").alias("p"), F.col("p0").alias("a0"))
    right = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"), F.col("p0").alias("b0"))
    p, r, a0, b0 = (F.col(c) for c in ("p", "r", "a0", "b0"))
    shared = left.join(right, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(
        F.sum(gap(p, r) - gap(p, b0) - gap(a0, r) + gap(a0, b0)).alias("mend")
    )

    base = ordered.select("lang", "source", "item", F.when(F.col("kept") > 0, F.col("kept") * gap(F.col("a0"), F.col("b0"))).alias("part"))
    turned = lambda x, c: x.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col(c).alias("part"))
    straight = lambda x, c: x.select("lang", "source", "item", F.col(c).alias("part"))
    parts = [base, straight(apart, "change"), turned(apart, "change"), straight(shared, "mend"), turned(shared, "mend")]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole.groupBy("lang", "source", "item").agg(F.coalesce(F.sum("part"), F.lit(0)).cast("long").alias("value"))
