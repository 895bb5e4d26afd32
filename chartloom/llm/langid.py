"""Language by hyperdimensional profiles of letter trigrams.

A letter has a random vector of +1 and -1; a trigram's is the product of its letters'
vectors, shifted by their places; a text's is the sum over its trigrams, and so is a
language's over its training texts.  A text gets the language whose vector has the
largest cosine with its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.common import ship

DIMS = 1024
SEED = 20_011
UNKNOWN = "und"
#: Learning stops with an error beyond; the profiles' size is bounded by it.
MAX_LANGUAGES = 2_000
#: Characters worked on at once; a longer text is cut between words and summed up.
CHARS = 400_000
#: Up to so many possible trigrams are counted in a table, more by sorting.
TABLE = 4_000_000


def letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each code point, always the same for the same one."""
    bits = np.stack([np.random.Generator(np.random.PCG64([SEED, int(c)])).integers(0, 2, DIMS, dtype=np.int8) for c in letters])
    return bits * 2 - 1


class Bundler:
    """Trigram sums of many texts at once."""

    def __init__(self) -> None:
        self.is_letter = letter_table()
        self.vectors: dict[int, np.ndarray] = {}

    def pieces(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
        """Lists of texts, and their places, of about ``CHARS`` characters.

        A longer text is cut where no letter is, so that no trigram is lost.
        """
        places, held, size = [], [], 0
        for k, text in enumerate(texts):
            start, text = 0, text or ""
            while start < len(text):
                end = start + CHARS
                while end < len(text) and text[end].isalpha():
                    end += 1
                places.append(k)
                held.append(text[start:end])
                size += len(held[-1])
                start = end
                if size >= CHARS:
                    yield places, held
                    places, held, size = [], [], 0
        if held:
            yield places, held

    def counted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every trigram the text it is in and its number; the letters of each number."""
        lower = [t.lower() for t in texts]
        points = np.frombuffer((" " + " ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(lower)), [len(t) + 1 for t in lower])
        owner = np.concatenate([[0], owner])
        letters = np.where(self.is_letter[points], points, 0)
        kept = np.ones(len(letters), dtype=bool)
        kept[1:] = (letters[1:] != 0) | (letters[:-1] != 0)  # one gap between words
        letters, owner = letters[kept], owner[kept]
        if len(letters) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
        present = np.zeros(0x110000, dtype=bool)
        present[letters] = True
        present[0] = True
        alphabet = np.flatnonzero(present)
        number = np.zeros(0x110000, dtype=np.int64)
        number[alphabet] = np.arange(len(alphabet))
        x, k = number[letters], len(alphabet)
        middle = x[1:-1] != 0
        code = ((x[:-2] * k + x[1:-1]) * k + x[2:])[middle]
        if k**3 <= TABLE:
            found = np.flatnonzero(np.bincount(code, minlength=k**3))
            place = np.zeros(k**3, dtype=np.int64)
            place[found] = np.arange(len(found))
            at = place[code]
        else:
            found, at = np.unique(code, return_inverse=True)
        spelled = alphabet[np.stack([found // (k * k), found // k % k, found % k], axis=1)] if len(found) else np.zeros((0, 3), np.int64)
        return owner[1:-1][middle], at, spelled

    def bound(self, spelled: np.ndarray) -> np.ndarray:
        """The vectors of trigrams: their letters' vectors, shifted by place and multiplied."""
        letters, at = np.unique(spelled, return_inverse=True)
        at = at.reshape(spelled.shape)
        if new := [int(c) for c in letters if int(c) not in self.vectors]:
            if len(self.vectors) > 20_000:
                self.vectors.clear()
                new = [int(c) for c in letters]
            self.vectors.update(zip(new, letter_vectors(np.array(new)), strict=True))
        base = np.stack([self.vectors[int(c)] for c in letters])
        out = base[at[:, 0]]
        out *= np.roll(base, 1, axis=1)[at[:, 1]]
        out *= np.roll(base, 2, axis=1)[at[:, 2]]
        return out.astype(np.float32)

    def bundles(self, texts: list[str | None], group: np.ndarray | None = None, groups: int = 0) -> np.ndarray:
        """The sum vector of each text, or of each group of texts; zero where there is no letter."""
        out = np.zeros((groups if group is not None else len(texts), DIMS))
        for places, held in self.pieces(texts):
            owner, at, spelled = self.counted(held)
            if not len(at):
                continue
            to = np.asarray(places) if group is None else group[np.asarray(places)]
            rows, to = np.unique(to, return_inverse=True)
            counts = np.bincount(to[owner] * len(spelled) + at, minlength=len(rows) * len(spelled)).reshape(len(rows), -1)
            # A block of trigrams at a time: their vectors take 4 KB each.
            total = np.zeros((len(rows), DIMS), dtype=np.float64)
            for s in range(0, len(spelled), 8192):
                total += counts[:, s : s + 8192].astype(np.float32) @ self.bound(spelled[s : s + 8192])
            out[rows] += total
        return out


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    vectors: np.ndarray  # one row of length 1 for each


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """A profile of each non-null language from all rows of ``df``.

    Tasks sum up what they read, then sums are added by language and dimension; the
    driver gets ``DIMS`` numbers a language.  Texts without a letter add nothing.
    """
    rows = df.select(df[lang_col].alias("lang"), df[text_col].alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums = Bundler(), {}
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                langs = batch.column(0).to_pylist()
                names = sorted(set(langs))
                group = np.array([names.index(x) for x in langs])
                for name, v in zip(names, bundler.bundles(batch.column(1).to_pylist(), group, len(names)), strict=True):
                    sums[name] = sums[name] + v if name in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "sums"]
            )

    parts = rows.mapInArrow(run, "lang string, sums array<double>")
    by_dim = parts.select("lang", F.posexplode("sums").alias("dim", "value")).groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    by_lang = by_dim.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v"))
    found = by_lang.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in {lang_col}")
    kept = [(r["lang"], np.array([x["value"] for x in r["v"]])) for r in found]
    kept = [(lang, v / np.linalg.norm(v)) for lang, v in kept if np.any(v)]
    return Profiles([lang for lang, _ in kept], np.array([v for _, v in kept]).reshape(len(kept), DIMS))


def identify(df: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (the cosine, 0 at least); such columns are replaced.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned.  Equal cosines go to the first language by name.  Whole texts count.
    """
    df = df.drop("lang_pred", "score")
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = ship(df.sparkSession, profiles)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, known = Bundler(), shared()
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                sums = bundler.bundles(batch.column(place).to_pylist())
                lengths = np.linalg.norm(sums, axis=1)
                langs, scores = [UNKNOWN] * len(sums), np.zeros(len(sums))
                if known.languages:
                    cosines = sums @ known.vectors.T / np.maximum(lengths, 1e-12)[:, None]
                    best = np.argmax(np.round(cosines, 12), axis=1)
                    langs = [known.languages[b] if n > 0 else UNKNOWN for b, n in zip(best, lengths, strict=True)]
                    scores = np.where(lengths > 0, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], names=schema.names)

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a document is in the fold that nothing is learned from; a null id counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold
