"""Remove word runs that occur elsewhere, by recompression.

The first round gives every run of one symbol a name, and all rounds every pair of a
left and a right symbol. (Later runs stay as they are: naming them too would leave
two more symbols of each round open at the borders, of 35 words.) A name is a 64-bit hash of what it stands for, so all tasks
agree on it without a dictionary, and equal stretches of words get equal symbols
inside, whatever stands around them. At the borders of a stretch each round leaves
a few symbols open: those whose run or pair might reach across. What is certain
from a window's words alone is tracked exactly. Of the certain symbols of the last
round, taken three in a row so that few are shared by chance, the least triple is
the window's anchor. Windows without any (as inside long runs of one word) are
named themselves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from plumbline.llm.hashing import RangeHash, U, mix, runs, signed, words_of_rows
from plumbline.llm.repeats import Method, covered, find_repeats, pack
from plumbline.llm.tables import segments

WINDOW = 35
ROUNDS = 3
# Rounds in which runs are named.
RUN_ROUNDS = 1
# Symbols of the last round that make an anchor together.
JOINED = 3
# Words a task names at a time.
PIECE = 1 << 18


def dedup_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True
) -> DataFrame:
    """Cut every word that a repeated window of ``window`` words covers, judged on the input.

    Words are maximal runs of bytes other than ASCII white space, unchanged.
    Returns id, th, n_units (words), n_removed, n_spans, kept_sha256 and kept
    (words joined by one space, UTF-8) per row; rows with the same id and text
    have equal results. NULL texts have no words; an empty table gives an empty
    result.
    """
    return find_repeats(docs, RecompressionMethod(window), id_col, text_col, with_text)


def compress(symbols: np.ndarray, walls: np.ndarray, level: int):
    """One round: (symbols, walls, index of each old symbol's run, of each run's new symbol, is it a left one).

    ``walls`` are symbols that end documents; they stay as they are.
    """
    opens = np.ones(len(symbols), bool)
    if level < RUN_ROUNDS:
        opens[1:] = symbols[1:] != symbols[:-1]
    run = np.cumsum(opens) - 1
    begins = np.flatnonzero(opens)
    length = np.diff(np.append(begins, len(symbols)))
    named, fixed = symbols[begins], walls[begins]
    named = np.where(length > 1, mix(named * U(0x9E3779B97F4A7C15) + length.astype(U)), named)

    left = (mix(named ^ U(0x5851F42D4C957F2D * (level + 1) % (1 << 64))) & U(1)) == 0
    joins = np.zeros(len(named), bool)
    joins[:-1] = left[:-1] & ~left[1:] & ~fixed[:-1] & ~fixed[1:]
    stays = np.ones(len(named), bool)
    stays[1:] = ~joins[:-1]
    pair = np.cumsum(stays) - 1
    paired = named.copy()
    at = np.flatnonzero(joins)
    paired[at] = mix(mix(named[at]) * U(0xC2B2AE3D27D4EB4F) + named[at + 1])
    return paired[stays], fixed[stays], run, pair, left, begins[stays]


class RecompressionMethod(Method):
    sorted_chunks = 0  # contested windows are few; all are verified by their words' hashes

    def __init__(self, window: int = WINDOW, rounds: int = ROUNDS, piece: int = PIECE):
        if not 1 <= window <= 255:
            raise ValueError("the window must have 1 to 255 words")
        self.window, self.rounds, self.piece = window, rounds, piece

    def chunks(self, offsets, data):
        words, _, _, at = words_of_rows(offsets, data)
        found = [self._piece(at, words, *s) for s in segments(at, self.piece, self.window - 1)]
        if not found:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(*found))

    def _piece(self, at, words, row, end_row, low, high):
        none = np.zeros(0, np.int64)
        if high - low < self.window:
            return none, none, none, none
        # A wall of its own name behind each document.
        bounds = np.clip(at[row : end_row + 1] - low, 0, high - low)
        inner = np.insert(words[low:high], bounds[1:], mix(np.arange(len(bounds) - 1, dtype=U) + U(1 << 50)))
        walls = np.zeros(len(inner), bool)
        walls[bounds[1:] + np.arange(len(bounds) - 1)] = True
        size = len(inner) - self.window + 1
        apart = np.concatenate([[0], np.cumsum(walls)])
        inside = apart[self.window :] == apart[:size]
        place = np.arange(size)
        anchor, name = self._anchors(inner, walls, size)
        # Windows without a certain symbol are their own anchor.
        whole = RangeHash(inner)
        lone = anchor < 0
        label = np.where(lone, -place - 1, anchor)
        first, last = runs(inside, label, np.zeros(size, bool))
        key = name[first]
        alone = lone[first]
        key[alone] = whole(first[alone], first[alone] + self.window, seed=2)
        spot = np.where(alone, first, anchor[first])
        content = whole(first, last + self.window)
        shift_rows = np.searchsorted(bounds[1:] + np.arange(len(bounds) - 1), first, "left")
        rows = row + shift_rows
        shift = low - at[rows] - shift_rows
        return rows, signed(key), signed(content), pack(first + shift, spot + shift, last + shift)

    def _anchors(self, words, walls, size):
        """Per window: place of its least certain symbol (-1 if none), and the symbol's name."""
        symbols, starts = words, np.arange(len(words))
        low = np.arange(size)
        high = low + self.window  # certain symbols are low..high-1
        for level in range(self.rounds):
            symbols, walls, run, pair, left, begins = compress(symbols, walls, level)
            starts = starts[begins]
            # the first and the last run may reach across the window's borders
            none = low >= high
            if level < RUN_ROUNDS:
                low = run[np.minimum(low, len(run) - 1)] + 1
                high = run[np.maximum(high - 1, 0)]
            none |= low >= high
            # the first may be the right half of a pair, the last the left half
            at, end = np.minimum(low, len(pair) - 1), np.maximum(high - 1, 0)
            low = pair[at] + ~left[at]
            high = pair[end] + ~left[end]
            low[none], high[none] = 0, 0
        names = symbols
        for _ in range(JOINED - 1):
            names = mix(names[:-1] * U(0x9E3779B97F4A7C15) + symbols[len(symbols) - len(names) + 1 :])
        high = high - (JOINED - 1)
        anchor, name = np.full(size, -1, np.int64), np.zeros(size, U)
        some = np.flatnonzero(low < high)
        if not len(some):
            return anchor, name
        bits = U((1 << 24) - 1)
        least = [(mix(names + U(11)) & ~bits) | np.arange(len(names), dtype=U)]
        low, high = low[some], high[some]
        step = np.floor(np.log2(high - low)).astype(np.int64)
        for power in range(int(step.max())):
            before = least[-1]
            least.append(np.minimum(before[: -(1 << power)], before[1 << power :]))
        best = np.zeros(len(some), U)
        for power, table in enumerate(least):
            mine = np.flatnonzero(step == power)
            best[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << power)])
        chosen = (best & bits).astype(np.int64)
        anchor[some], name[some] = starts[chosen], names[chosen]
        return anchor, name

    def cut(self, text, starts, ends):
        words = text.split()
        if not len(starts):
            return b" ".join(words), len(words), None
        gone = covered(len(words), starts, ends)
        return b" ".join([w for w, g in zip(words, gone.tolist()) if not g]), len(words), gone

    def window_hashes(self, text, first, last):
        data = np.frombuffer(text, np.uint8)
        words = words_of_rows(np.array([0, len(data)]), data)[0]
        whole = RangeHash(words)
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
        one, two = whole(starts, starts + self.window), whole(starts, starts + self.window, seed=1)
        return starts.tolist(), signed(one).tolist(), signed(two).tolist()
