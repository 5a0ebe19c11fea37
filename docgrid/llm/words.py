"""Words of a text as 64-bit hashes, and hashes of runs of words."""

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
#: Odd multipliers of the polynomial and of the final mix.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Words that a task remembers.
REMEMBERED = 300_000


def lowered(text: str) -> list[str]:
    """The words of a text in small letters, one for each word of the text as it is (a few letters grow when lowered)."""
    small = text.lower()
    return WORD.findall(small) if len(small) == len(text) else [w.lower() for w in WORD.findall(text)]


def spans(text: str) -> list[tuple[int, int]]:
    """Where each of these words lies, in code points of the text."""
    return [m.span() for m in WORD.finditer(text)]


class Hashes(dict):
    """Word to hash; computed when missing, forgotten when too many."""

    def __missing__(self, word: str | bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_known = Hashes()


def hashes(words: list) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n words, in order; none if there are fewer.

    The polynomial of a run of a + b words comes from those of its parts, so a run takes about log2(n) steps.
    """
    if len(words) < n:
        return np.zeros(0, np.uint64)
    size, value, power = 1, words, np.array([STEP])  # an array, as products may pass 64 bits; value: runs of `size` words; power: STEP ** size
    done, out, out_power = 0, None, None
    rest = n
    while rest:
        if rest & 1:
            if out is None:
                out, out_power, done = value, power, size
            else:  # the runs so far, then `size` more words
                m = len(words) - done - size + 1
                out, done = out[:m] * power + value[done : done + m], done + size
        rest >>= 1
        if rest:
            m = len(words) - 2 * size + 1
            value, power, size = value[:m] * power + value[size : size + m], power * power, 2 * size
    return mixed(out)
