"""Words of many texts at once, as numpy arrays over their bytes.

A word is a run of digits, letters a-z after folding A-Z, and characters beyond ASCII.
On UTF-8 bytes that is a run of bytes 30-39, 61-7A and 80-FF, so that texts needn't be
decoded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes hashed at once, few enough for a core's cache; a longer text goes in pieces cut between words.
PIECE = 1 << 15
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _folded() -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = np.arange(low, high + 1)
    table[0x41 : 0x5A + 1] = np.arange(0x61, 0x7A + 1)
    return table


FOLDED = _folded()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: a bijection whose bits all depend on all bits."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in UTF-8 bytes, of the characters of scripts that put no blanks between words.

    Thai, Lao and Tibetan (U+0E00-0FFF), Myanmar (1000-109F), Khmer (1780-17FF), Chinese and Japanese
    (2E80-9FFF, without Hangul's letters 3130-318F; F900-FAFF; FF66-FF9F; from 20000 on).
    """
    at = np.flatnonzero(data >= 0xE0)
    if not len(at):
        return at, at
    lead = data[at]
    one, two = (data[np.minimum(at + k, len(data) - 1)] for k in (1, 2))
    point = (lead & 0xF).astype(np.int64) << 12 | (one & 0x3F).astype(np.int64) << 6 | two & 0x3F
    three = lead < 0xF0
    is_in = np.zeros(len(at), dtype=bool)
    for low, high in ((0x0E00, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x312F), (0x3190, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F)):
        is_in |= three & (point >= low) & (point <= high)
    is_in |= (lead == 0xF0) & (one >= 0xA0)
    return at[is_in], np.minimum(at + np.where(three, 3, 4), len(data))[is_in]


def _split(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with the characters of scripts without blanks cut out of them."""
    first, after = unspaced(data)
    if not len(first):
        return starts, ends
    after = np.minimum(after, ends[np.searchsorted(starts, first, side="right") - 1])
    cut = np.unique(np.concatenate([starts, first, after[data[np.minimum(after, len(data) - 1)] != 0]]))
    end = ends[np.searchsorted(starts, cut, side="right") - 1]
    return cut, np.minimum(end, np.append(cut[1:], len(data)))


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE + 4096)
            inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
            for name, base in (("up", _PRIME), ("down", inverse)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


@dataclass
class Words:
    data: np.ndarray  # folded bytes, 0 where no word is
    starts: np.ndarray  # of each word, in ``data``
    ends: np.ndarray
    owner: np.ndarray  # the text each word is in
    counts: np.ndarray  # words of each text
    offsets: np.ndarray  # where each text starts in ``data``
    hashes: np.ndarray

    def first(self) -> np.ndarray:
        """The number of each text's first word."""
        return np.concatenate([[0], np.cumsum(self.counts)])[:-1]


class Scanner:
    """Finds and hashes words; keeps its tables between calls."""

    def __init__(self) -> None:
        self.powers = _Powers()

    def scan(self, texts: list[bytes | None], characters: bool = False) -> Words:
        """``characters``: each character of a script without blanks is a word of its own."""
        held = [t or b"" for t in texts]
        data = FOLDED[np.frombuffer(b"\n".join(held) + b"\n", dtype=np.uint8)] if held else np.zeros(0, np.uint8)
        lengths = np.array([len(t) + 1 for t in held], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64)
        edge = np.diff((data != 0).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if characters:
            starts, ends = _split(data, starts, ends)
        cuts = np.searchsorted(starts, np.append(offsets, len(data)))
        counts = np.diff(cuts)
        owner = np.repeat(np.arange(len(held)), counts)
        return Words(data, starts, ends, owner, counts, offsets, self._hashes(data, starts, ends))

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A sum of bytes times powers for each word, by differences of running sums."""
        out = np.empty(len(starts), dtype=np.uint64)
        done = 0
        while done < len(starts):
            base = starts[done]
            # as many words as end within a piece, one at least
            upto = max(done + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
            part = data[base : ends[upto - 1]].astype(np.uint64)
            up, down = self.powers.upto(len(part) + 1)
            part *= up[: len(part)]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(part, out=sums[1:])
            s, e = starts[done:upto] - base, ends[done:upto] - base
            out[done:upto] = (sums[e] - sums[s]) * down[s]
            done = upto
        lengths = (ends - starts).astype(np.uint64)
        return mix(out + lengths * np.uint64(0xD6E8FEB86659FD93))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` successive words, and the text each is in.

    A text of fewer words, but not none, has one of all its words.
    """
    n = len(words.hashes)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(min(size, n)):
        moved = np.zeros(n, dtype=np.uint64)
        moved[: n - k] = words.hashes[k:]
        total = mix(total * np.uint64(0x2545F4914F6CDD1D) + moved)
    place = np.arange(n) - np.repeat(words.first(), words.counts)
    whole = place + size <= np.repeat(words.counts, words.counts)
    hashes, owner = total[whole], words.owner[whole]
    first, tails = words.first(), []
    for count in range(1, size):
        short = np.flatnonzero(words.counts == count)
        total = np.zeros(len(short), dtype=np.uint64)
        for k in range(count):
            total = mix(total * np.uint64(0x2545F4914F6CDD1D) + words.hashes[first[short] + k])
        tails.append((mix(total + np.uint64(count)), short))
    if any(len(t) for _, t in tails):
        hashes = np.concatenate([hashes, *[h for h, _ in tails]])
        owner = np.concatenate([owner, *[t for _, t in tails]])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner
