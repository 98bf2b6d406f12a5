"""Counts of words, symbols and repetition for each text of a chunk."""

from __future__ import annotations

import numpy as np

from bitloom.llm import kernels as K

SYMBOLS = "#*$%&|<>"
_SYMBOL = bytes(int(chr(b) in SYMBOLS) for b in range(256))


def statistics(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text of a chunk; equal lines and windows are found by hash and compared byte by byte."""
    n = len(off) - 1
    starts, ends, row = K.spans(buf, off)
    words = K.Segments(buf, starts, ends)
    bound = np.searchsorted(starts, off)

    lines = np.unique(np.concatenate((off[:-1], np.flatnonzero(buf == 10) + 1)))
    to = np.append(lines[1:], len(buf))
    to = to - ((to > lines) & (np.append(buf, 0)[np.maximum(to, 1) - 1] == 10))
    some = np.searchsorted(starts, to) > np.searchsorted(starts, lines)  # with a word
    lines, to = lines[some], to[some]
    lines_row = K.rows_of(off, lines)
    whole = K.Segments(buf, lines, to)
    by_row = lambda key, r: K.mix(key ^ K.mix(r.astype(np.uint64) + K._GOLD))
    again = K.later(by_row(whole.hash(), lines_row), lambda i, j: (lines_row[i] == lines_row[j]) & whole.same(i, whole, j))

    h, at = K.windows(words.hash(), row, 3)
    same = lambda i, j: (row[at[i]] == row[at[j]]) & words.same(at[i], words, at[j]) & words.same(at[i] + 1, words, at[j] + 1) & words.same(at[i] + 2, words, at[j] + 2)
    hit = at[K.ties(by_row(h, row[at]), same)[0]]
    covered = np.zeros(len(starts) + 2, bool)
    for j in range(3):
        covered[hit + j] = True
    return {
        "n_words": np.diff(bound),
        "word_chars": K.counts(((buf & 0xC0) != 0x80) & ~K.blank(buf), off),
        "n_symbols": K.counts(np.frombuffer(buf.tobytes().translate(_SYMBOL), bool), off),
        "n_dup_lines": np.bincount(lines_row[again], minlength=n),
        "n_repeat_words": K.counts(covered[: len(starts)], bound),
    }


def shape_buckets(buf: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Four (row, bucket) pairs a row: bands of length, repetition, duplicate lines and symbols."""
    s = statistics(buf, off)
    n = len(off) - 1
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    lines = K.counts(buf == 10, off) + 1
    bands = [np.floor(2 * np.log2(words)), np.floor(20 * s["n_repeat_words"] / words), np.floor(20 * s["n_dup_lines"] / lines), np.floor(50 * s["n_symbols"] / chars)]
    code = np.stack(bands, 1).astype(np.uint64) + (np.arange(1, 5, dtype=np.uint64) << np.uint64(32))
    return np.repeat(np.arange(n, dtype=np.int32), 4), (K.mix(code.ravel()) >> np.uint64(64 - bits)).astype(np.uint32)
