"""Byte-pair encoding by a contiguous array of ranks, and decoding.

The vocabulary is a public tokenizer's file, named by path and read by the driver;
tasks get it as a broadcast of a few megabytes.  Texts are encoded row by row inside
Arrow batches: nothing is shuffled, and a text is never cut.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chartloom.llm.common import ship

#: No pair of neighbours has this rank.
NONE = 1 << 60
#: Words of more bytes go by a heap of ranks, whose work doesn't grow with the square.
SHORT = 256
#: Encoded words a worker keeps; when there are as many, it starts anew.
KEPT_WORDS = 400_000
KEPT_CHARS = 48
#: Rows turned into Python strings at a time.
ROWS = 128

# Fixed values of the tokenizer's file format: how bytes are written as characters,
# and what counts as white space to it.
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: str.split() splits at these too; the tokenizer doesn't.
SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself, or one above 255 for the others."""
    out, above = [], 256
    for b in range(256):
        if b in PLAIN_BYTES:
            out.append(chr(b))
        else:
            out.append(chr(above))
            above += 1
    return out


@dataclass(frozen=True)
class Vocabulary:
    """What a tokenizer's JSON file says, as far as encoding needs it."""

    tokens: list[str]
    #: left id << 32 | right id: rank << 32 | merged id
    merges: dict[int, int]
    inner: list[int]  # id of each byte inside a word
    final: list[int]  # and at its end
    special: dict[str, int]
    words: str

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model = said["model"]
        ids, end = model["vocab"], model.get("end_of_word_suffix") or ""
        special = {t["content"]: t["id"] for t in said["added_tokens"]}
        tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in [*ids.items(), *special.items()]:
            tokens[i] = token
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            merges[ids[left] << 32 | ids[right]] = rank << 32 | ids[left + right]
        chars = byte_characters()
        split = next(p for p in said["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        return Vocabulary(
            tokens, merges, [ids[c] for c in chars], [ids[c + end] for c in chars], special, split["pattern"]["Regex"]
        )


def merge_short(parts: list[int], merges: dict[int, int]) -> list[int]:
    """Join neighbours, the pair of least rank first and the leftmost of equals.

    ``ranks[i]`` belongs to the boundary between parts ``i`` and ``i + 1``.  Each
    step scans the array for its minimum, deletes that boundary and looks up the
    ranks on both sides of it anew.
    """
    look = merges.get
    ranks = [look(a << 32 | b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while ranks:
        least = min(ranks)
        if least == NONE:
            break
        i = ranks.index(least)
        parts[i] = least & 0xFFFFFFFF
        del parts[i + 1], ranks[i]
        if i:
            ranks[i - 1] = look(parts[i - 1] << 32 | parts[i], NONE)
        if i < len(ranks):
            ranks[i] = look(parts[i] << 32 | parts[i + 1], NONE)
    return parts


def merge_long(parts: list[int], merges: dict[int, int]) -> list[int]:
    """The same result for a word of any length: boundaries in a heap, parts in a linked list."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m, i) for i in range(n - 1) if (m := merges.get(parts[i] << 32 | parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        m, i = heapq.heappop(heap)
        j = after[i] if parts[i] >= 0 else n
        if j >= n or merges.get(parts[i] << 32 | parts[j]) != m:
            continue  # one of the two has been joined with another meanwhile
        parts[i], parts[j] = m & 0xFFFFFFFF, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (found := merges.get(parts[a] << 32 | parts[b])) is not None:
                heapq.heappush(heap, (found, a))
    return [p for p in parts if p >= 0]


class Encoder(dict):
    """Ids, packed as little-endian 32-bit integers, by word between white space."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.words = regex.compile(vocabulary.words)
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.spaces = regex.compile(f"[{WHITE}]+")

    def __missing__(self, chunk: str) -> bytes:
        ids: list[int] = []
        for piece in self.special.split(chunk) if self.special else [chunk]:
            if piece in self.vocabulary.special:
                ids.append(self.vocabulary.special[piece])
            elif piece:
                # Lower case character by character: a sigma at a word's end is like any other.
                plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                for word in self.words.findall(plain):
                    ids += self.word(word)
        packed = np.array(ids, dtype="<u4").tobytes()
        if len(chunk) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[chunk] = packed
        return packed

    def word(self, word: str) -> list[int]:
        raw, v = word.encode("utf-8"), self.vocabulary
        parts = [v.inner[b] for b in raw]
        parts[-1] = v.final[raw[-1]]
        return merge_short(parts, v.merges) if len(parts) <= SHORT else merge_long(parts, v.merges)

    def encode(self, text: str) -> bytes:
        chunks = self.spaces.split(text) if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.__getitem__, filter(None, chunks)))


def decode(packed: bytes, tokens: list[str]) -> str:
    return " ".join(map(tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def encode_texts(df: DataFrame, vocabulary_path: str, text_col: str = "text", decoded: bool = True) -> DataFrame:
    """``df`` with ``ids`` (binary: 32-bit little-endian), ``n_tokens`` and, if asked for, ``decoded``.

    Words are normalised as the file says (NFC, lower case) and special tokens in a
    text become their ids.  A null text counts as empty: no ids, an empty decoded
    text.  Columns of those names in the input are replaced; others pass through,
    and repeated rows are encoded alike.
    """
    added = ["ids", "n_tokens"] + ["decoded"] * decoded
    df = df.drop(*added)
    schema = T.StructType([*df.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
    if decoded:
        schema.add("decoded", T.StringType())
    shared = ship(df.sparkSession, Vocabulary.load(vocabulary_path))
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared()
        encoder, tokens = Encoder(vocabulary), vocabulary.tokens
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                packed = [encoder.encode(t) if t else b"" for t in batch.column(place).to_pylist()]
                columns = [*batch.columns, pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]
                if decoded:
                    columns.append(pa.array([decode(p, tokens) for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)
