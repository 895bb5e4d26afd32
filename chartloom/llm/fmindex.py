"""Benchmark passages in training texts, found by an FM-index of each training shard.

A shard is a run of documents inside a task.  Words that no benchmark item has can't be
in a passage, so a shard's index holds the runs of the other words that are long enough
for a passage, with a mark between runs.  Its Burrows-Wheeler transform is kept as a
wavelet matrix; all passages are searched backwards through it at once, occurrences are
located by sampled suffix positions, and their spans are merged for each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.common import cut, fold, ship
from chartloom.llm.words import Scanner, Words

WINDOW = 10
#: Text bytes of a shard, at least; one longer text is a shard of its own.
SHARD_BYTES = 4 << 20
#: A suffix's position is kept if it is a multiple of this.
SAMPLE = 8
#: Benchmark words searched for in one pass; a larger benchmark takes more passes.
BLOCK_WORDS = 2_000_000
#: The words of a text, of bytes as they are in UTF-8.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END, MARK = 0, 1  # symbols of a shard that are no words


class WaveletMatrix:
    """Ranks of symbols in a sequence: a bit row for each binary digit."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.levels = max(1, int(symbols.max(initial=1)).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bits = symbols >> level & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bits, dtype=np.int64)]))
            self.zeros.append(len(bits) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``upto``."""
        start = np.zeros_like(upto)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one, ones, zeros = (symbol >> level & 1).astype(bool), self.ones[k], self.zeros[k]
            upto = np.where(one, zeros + ones[upto], upto - ones[upto])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return upto - start


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Where the suffixes of a sequence start, in order; the last symbol is the least and there once.

    Prefix doubling: suffixes ordered by 2**k symbols are ordered by twice as many
    through the ranks of what follows.  Only suffixes that are still equal are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    ordered = symbols[order]
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    step = 1
    tied = np.flatnonzero(np.repeat(np.diff(np.append(head, n)) > 1, np.diff(np.append(head, n))))
    while len(tied):
        suffixes = order[tied]
        # A suffix that ends within the step differs by the end symbol already.
        key = rank[suffixes] * (n + 1) + rank[np.minimum(suffixes + step, n - 1)]
        again = np.argsort(key, kind="stable")
        suffixes, key = suffixes[again], key[again]
        order[tied] = suffixes
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.flatnonzero(new)
        sizes = np.diff(np.append(at, len(key)))
        rank[suffixes] = tied[np.repeat(at, sizes)]
        tied = tied[np.repeat(sizes > 1, sizes)]
        step *= 2
    return order


class FMIndex:
    def __init__(self, symbols: np.ndarray) -> None:
        """``symbols`` ends with the only ``END``."""
        order = suffix_order(symbols)
        self.n = len(symbols)
        self.last = symbols[order - 1]
        counts = np.bincount(symbols)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.matrix = WaveletMatrix(self.last)
        self.sampled = order % SAMPLE == 0
        self.sample = np.concatenate([[0], np.cumsum(self.sampled)])
        self.positions = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the phrases (rows of equal length) that occur, and their ranges of suffixes."""
        alive = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        known = len(self.before) - 1
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, j]
            there = symbol < known
            alive, low, high, symbol = alive[there], low[there], high[there], symbol[there]
            low = self.before[symbol] + self.matrix.rank(symbol, low)
            high = self.before[symbol] + self.matrix.rank(symbol, high)
            found = low < high
            alive, low, high = alive[found], low[found], high[found]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows start: steps back to the nearest sampled one."""
        out, todo, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            hit = self.sampled[rows]
            out[todo[hit]] = self.positions[self.sample[rows[hit]]] + steps
            todo, rows = todo[~hit], rows[~hit]
            symbol = self.last[rows]
            rows = self.before[symbol] + self.matrix.rank(symbol, rows)
            steps += 1
        return out


@dataclass(frozen=True)
class Phrases:
    """Windows of benchmark items as rows of word numbers, by length, and the items of each."""

    numbers: dict[bytes, int]
    hashes: np.ndarray  # of the words, sorted
    by_length: list[tuple[np.ndarray, list[list[str]]]]
    least: int

    @staticmethod
    def of(items: list[tuple[str, list[str]]], window: int) -> Phrases:
        numbers: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = [numbers.setdefault(w.encode(), len(numbers) + 2) for w in words]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                rows.setdefault(tuple(ids[i : i + size]), set()).add(item)
        lengths = sorted({len(r) for r in rows if r})
        by_length = []
        for n in lengths:
            mine = [r for r in rows if len(r) == n]
            by_length.append((np.array(mine, dtype=np.int64), [sorted(rows[r]) for r in mine]))
        hashes = np.sort(Scanner().scan(list(numbers)).hashes) if numbers else np.zeros(0, np.uint64)
        return Phrases(numbers, hashes, by_length, lengths[0] if lengths else window)


def find(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """First words and lengths of all occurrences, and the items of each."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    if not len(words.hashes) or not len(phrases.hashes):
        return none
    at = np.searchsorted(phrases.hashes, words.hashes)
    shared = np.flatnonzero(phrases.hashes[np.minimum(at, len(phrases.hashes) - 1)] == words.hashes)
    places = runs(words, shared, phrases.least)
    if not len(places):
        return none
    # Which word it is is told by its bytes, not by its hash.
    data, get = words.data.tobytes(), phrases.numbers.get
    symbol = np.array([get(data[s:e], MARK) for s, e in zip(words.starts[places].tolist(), words.ends[places].tolist(), strict=True)])
    breaks = np.flatnonzero((np.diff(places) != 1) | (np.diff(words.owner[places]) != 0)) + 1
    text = np.append(np.insert(symbol, breaks, MARK), END)
    place = np.append(np.insert(places, breaks, -1), -1)
    index = FMIndex(text)
    starts, lengths, items = [], [], []
    for rows, names in phrases.by_length:
        found, low, high = index.search(rows)
        sizes = high - low
        suffixes = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes) + np.arange(sizes.sum())
        starts.append(place[index.locate(suffixes)])
        lengths.append(np.full(len(suffixes), rows.shape[1], np.int64))
        items += [names[f] for f in np.repeat(found, sizes)]
    return np.concatenate(starts), np.concatenate(lengths), items


def runs(words: Words, chosen: np.ndarray, least: int) -> np.ndarray:
    """Of the chosen words those that stand in a row of ``least`` or more in one text."""
    if not len(chosen):
        return chosen
    new = np.concatenate([[True], (np.diff(chosen) != 1) | (np.diff(words.owner[chosen]) != 0)])
    sizes = np.diff(np.append(np.flatnonzero(new), len(chosen)))
    return chosen[np.repeat(sizes >= least, sizes)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
LEAK = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", SPANS),
])


def _pass(df: DataFrame, phrases: Phrases, text_col: str, leak: str, clean_col: str | None) -> DataFrame:
    """Search for one block of phrases; adds to what earlier passes left in ``leak``."""
    first = leak not in df.columns
    fields = [f for f in df.schema.fields if f.name not in (leak, clean_col)]
    schema = T.StructType([*fields, T.StructField(leak, LEAK)] + ([T.StructField(clean_col, T.StringType())] if clean_col else []))
    kept = [f.name for f in fields]
    shared = ship(df.sparkSession, phrases)
    rows = df.select(*[df[c] for c in kept], *([] if first else [df[leak]]))
    place = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, known = Scanner(), shared()
        for batch in batches:
            texts = batch.column(place).cast(pa.binary())
            for low, high in _shards(texts):
                part = batch.slice(low, high - low)
                held = texts.slice(low, high - low).to_pylist()
                before = None if first else part.column(len(kept)).to_pylist()
                yield _answer(scanner, part, held, before, known, len(kept), schema, clean_col is not None)

    return rows.mapInArrow(run, schema)


def _shards(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with ``SHARD_BYTES`` of text each, or one row that has more."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    low = total = 0
    for k, size in enumerate(sizes.tolist()):
        total += size
        if total >= SHARD_BYTES:
            yield low, k + 1
            low, total = k + 1, 0
    if low < len(sizes):
        yield low, len(sizes)


def _answer(scanner, part, held, before, phrases, n_kept, schema, clean):  # noqa: ANN001, ANN202
    words = scanner.scan(held)
    starts, lengths, items = find(words, phrases)
    first = words.first()
    spans: dict[int, list[tuple[int, int]]] = {}
    names: dict[int, set[str]] = {}
    for s, n, owner, mine in zip(starts.tolist(), lengths.tolist(), words.owner[starts].tolist(), items, strict=True):
        at = s - int(first[owner])
        spans.setdefault(owner, []).append((at, at + n))
        names.setdefault(owner, set()).update(mine)
    out, texts = [], []
    for k in range(len(held)):
        old = before[k] if before is not None else None
        mine = spans.get(k, [])
        if old and old["spans"]:
            mine = mine + [(x["start"], x["end"]) for x in old["spans"]]
            names.setdefault(k, set()).update(old["items"])
        mine = merged(mine)
        out.append({
            "n_words": int(words.counts[k]),
            "n_hit": sum(b - a for a, b in mine),
            "items": sorted(names.get(k, ())),
            "spans": [{"start": a, "end": b} for a, b in mine],
        })
        if clean:
            texts.append(_without(held[k], words, k, mine))
    columns = [*part.columns[:n_kept], pa.array(out, pa.struct([
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]))]
    if clean:
        columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def _without(text: bytes | None, words: Words, k: int, spans: list[tuple[int, int]]) -> bytes | None:
    """The text without its spans of words; a line break stays where one was."""
    if not spans or text is None:
        return text
    first, offset = int(words.first()[k]), int(words.offsets[k])
    out, at = [], 0
    for low, high in spans:
        out.append(text[at : int(words.starts[first + low]) - offset])
        at = int(words.ends[first + high - 1]) - offset
    return b"\n".join([*out, text[at:]])


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    leak_col: str = "leak",
    clean_col: str | None = None,
) -> DataFrame:
    """``df`` with a struct ``leak``: n_words, n_hit, items and spans of benchmark passages in its text.

    A passage is any ``window`` consecutive words of an item, or all of an item with
    fewer.  ``items`` are the ids, as text and in order, of the items with a passage
    in the text; ``spans`` the merged ranges of hit words; ``n_hit`` the words in
    them.  ``clean_col`` gives the text without the spans.  Columns of these names are
    replaced.  A null or empty text has no words, as has a null item; a null item id
    counts as empty, and items with the same id as one.  Every input row gives one row.

    Nothing is shuffled: each pass reads every text whole, and carries a block of at
    most ``BLOCK_WORDS`` benchmark words (plus one item) to the tasks.
    """
    items = cut(
        benchmark.select(
            F.coalesce(benchmark[item_col].cast("string"), F.lit("")).alias("item"),
            F.regexp_extract_all(fold(benchmark[item_text_col]), F.lit(WORD), F.lit(0)).alias("words"),
        ).filter("size(words) > 0")
    )
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    out = df.drop(leak_col)
    for b in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b).collect()
        phrases = Phrases.of([(r["item"], r["words"]) for r in mine], window)
        out = _pass(out, phrases, text_col, leak_col, clean_col if b == blocks - 1 else None)
    return out
