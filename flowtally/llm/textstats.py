"""Statistics of whole texts that rules and classifiers share.

Words are runs of other bytes than blank and control white space (x20, x09-x0D).  The
statistics of a text depend on that text alone; a null text counts as empty.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
UPPER, LOWER, DIGITS, MARKS, STOPS = (bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"!?", b".,;:")


def _repeats(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    hit = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def text_stats(text: str) -> tuple[float, ...]:
    """The five base counts, then the ratios of ``RATIOS``."""
    raw = text.encode()
    n, words = len(raw), raw.split()
    count = lambda chars: n - len(raw.translate(None, chars))
    spaces, symbols, upper, lower = count(SPACES), count(SYMBOLS), count(UPPER), count(LOWER)
    chars = len(text) - spaces
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats, distinct = _repeats(words), len(set(words))
    w, c = max(len(words), 1), max(chars, 1)
    ratios = (
        np.log1p(len(words)),
        chars / w,
        symbols / c,
        dup_lines / max(len(lines), 1),
        repeats / w,
        upper / max(upper + lower, 1),
        count(DIGITS) / c,
        count(MARKS) / c,
        count(STOPS) / w,
        distinct / w,
        max(map(len, words), default=0) / c,
        len(lines) / w,
        (n - len(text)) / c,
        max(Counter(words).values(), default=0) / w,
    )
    return (len(words), chars, symbols, dup_lines, repeats, *ratios)


RATIOS = ("log_words", "chars_per_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "stops_per_word", "distinct_share", "longest_share", "lines_per_word", "wide_share", "top_word_share")
ALL = BASE + RATIOS


def stat_matrix(texts: list[str]) -> np.ndarray:
    """One row of ``ALL`` for each text."""
    return np.array([text_stats(t) for t in texts], np.float64).reshape(len(texts), len(ALL))
