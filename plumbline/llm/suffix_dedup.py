"""Remove byte strings that occur elsewhere, by sorting sampled suffixes.

A full suffix array has an entry per byte. Here only the suffixes at anchors are
sorted: an anchor is the place of the least 64-byte hash among those a window of
200 bytes holds, so every window contains one and equal windows agree on it.
Suffixes at equal anchors are ordered by deep-shallow sorting: multikey quicksort,
eight bytes a character, to a shallow depth, and a blind trie for groups that are
still equal there. The text before the anchors is ordered the same way, backwards.
A window that reaches r bytes back occurs twice if two of its anchors stay in one
group both r bytes backwards and 200 - r bytes forwards; groups at any depth are
read off the common prefixes of neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.hashing import RangeHash, byte_table, gram_hashes, runs, signed, U, window_minimum
from plumbline.llm.repeats import Method, covered, find_repeats, pack, unpack
from plumbline.llm.tables import record_batch, segments

WINDOW = 200
GRAM = 64
# Bytes of text a task hashes at a time, and contexts it sorts at a time.
PIECE = 1 << 20
SORT_ROWS = 16_384
# Multikey quicksort goes to this depth; anchors already share GRAM bytes.
SHALLOW = 96


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True
) -> DataFrame:
    """Cut every byte that a repeated ``window``-byte string covers, judged on the input.

    Returns id, th, n_units (bytes), n_removed, n_spans, kept_sha256 and kept
    (binary, since a cut may fall inside a character) per row of ``docs``; rows
    with the same id and text have equal results. Matches never cross documents;
    a string that occurs twice in one document counts, overlapping or not. NULL
    texts are empty; an empty table gives an empty result.
    """
    return find_repeats(docs, SuffixMethod(window), id_col, text_col, with_text)


class SuffixMethod(Method):
    def __init__(self, window: int = WINDOW, gram: int = GRAM, piece: int = PIECE):
        if not gram < window <= gram + 255:
            raise ValueError("the window must be longer than a gram, by 255 bytes at most")
        self.window, self.gram, self.piece = window, gram, piece

    def chunks(self, offsets, data):
        found = [self._piece(offsets, data, *s) for s in segments(offsets, self.piece, self.window - 1)]
        if not found:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(*found))

    def _piece(self, offsets, data, row, end_row, low, high):
        piece = data[low:high]
        grams = gram_hashes(piece, self.gram)
        size = len(piece) - self.window + 1
        none = np.zeros(0, np.int64)
        if size <= 0:
            return none, none, none, none
        bits = U((1 << 22) - 1)
        order = (grams & ~bits) | np.arange(len(grams), dtype=U)
        at = (window_minimum(order, self.window - self.gram + 1) & bits).astype(np.int64)
        bounds = np.clip(offsets[row : end_row + 1] - low, 0, len(piece))
        ends = np.repeat(bounds[1:], np.diff(bounds))[:size]
        place = np.arange(size)
        fresh = np.zeros(size, bool)
        fresh[bounds[:-1][bounds[:-1] < size]] = True
        first, last = runs(place + self.window <= ends, at, fresh)
        anchor = at[first]
        content = RangeHash(byte_table(7)[piece])(first, last + self.window)
        rows = row + np.searchsorted(bounds, first, "right") - 1
        shift = low - offsets[rows]
        return rows, signed(grams[anchor]), signed(content), pack(first + shift, anchor + shift, last + shift)

    def cut(self, text, starts, ends):
        if not len(starts):
            return text, len(text), None
        gone = covered(len(text), starts, ends)
        return np.frombuffer(text, np.uint8)[~gone].tobytes(), len(text), gone

    def context(self, text, first, last):
        return text[first : last + self.window]

    def window_hashes(self, text, first, last):
        data = np.frombuffer(text, np.uint8)
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
        low = int(starts.min())
        part = data[low : int(starts.max()) + self.window]
        hashes = RangeHash(byte_table(7)[part])
        one = hashes(starts - low, starts - low + self.window)
        two = hashes(starts - low, starts - low + self.window, seed=1)
        return starts.tolist(), signed(one).tolist(), signed(two).tolist()

    def settle(self, contexts: DataFrame) -> DataFrame:
        id_type = contexts.schema["id"].dataType
        schema = T.StructType().add("id", id_type).add("th", "long").add("start", "long").add("end", "long")
        by_key = contexts.repartition("key").sortWithinPartitions("key")
        return by_key.mapInArrow(_sort_contexts(self.window, schema), schema)


def _sort_contexts(window: int, schema: T.StructType):
    arrow = to_arrow_schema(schema)

    def solve(table: pa.Table) -> pa.RecordBatch:
        row, start, end = repeated_runs(
            table.column("key").to_numpy(), table.column("place").to_numpy(), table.column("blob").to_pylist(), window
        )
        rows = table.take(pa.array(row)).combine_chunks()
        ids, ths = (rows.column(n).combine_chunks() for n in ("id", "th"))
        return record_batch(arrow, [ids, ths, start, end])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < SORT_ROWS:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last anchor may go on in the next batch
            if whole:
                yield solve(table.slice(0, whole))
            held = table.slice(whole).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return work


def repeated_runs(key, place, blobs: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end) of runs of windows that occur in two contexts of one anchor."""
    first, anchor, last = unpack(place)
    back, ahead = anchor - first, last - anchor + window
    right = np.zeros((len(blobs), -(-window // 8) * 8), np.uint8)
    left = np.zeros((len(blobs), max(8, -(-int(back.max()) // 8) * 8)), np.uint8)
    for i, blob in enumerate(blobs):
        data = np.frombuffer(blob, np.uint8)
        right[i, : min(ahead[i], window)] = data[back[i] : back[i] + window]
        left[i, : back[i]] = data[: back[i]][::-1]
    group = np.unique(key, return_inverse=True)[1]
    orders = [suffix_order(group, right), suffix_order(group, left)]
    twice = np.zeros((len(blobs), int(back.max()) + 2), bool)
    for reach in range(int(back.max()) + 1):
        has = np.flatnonzero((back >= reach) & (anchor - last <= reach))
        if len(has) < 2:
            continue
        both = np.zeros(len(blobs), np.int64)
        for (order, common), depth in zip(orders, (window - reach, reach)):
            groups = np.empty(len(blobs), np.int64)
            groups[order] = np.cumsum(common < depth)
            both = both * (len(blobs) + 1) + groups
        _, inverse, n = np.unique(both[has], return_inverse=True, return_counts=True)
        twice[has, reach] = n[inverse] > 1
    flat = np.flatnonzero(twice)
    context, reach = np.divmod(flat, twice.shape[1])
    joined = np.zeros(len(flat), bool)
    joined[1:] = flat[1:] == flat[:-1] + 1  # the spare column keeps contexts apart
    begins = np.flatnonzero(~joined)
    ends = np.append(begins[1:], len(flat)) - 1
    of = context[begins]
    return of, anchor[of] - reach[ends], anchor[of] - reach[begins] + window


def suffix_order(group: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of (group, text), and the bytes each has in common with the one before.

    The first of a group has -1 in common. ``text`` has one row of equal width
    per suffix; the width is a multiple of eight.
    """
    size, width = text.shape
    characters = text.reshape(size, -1, 8).view(">u8")[:, :, 0].astype(np.uint64)
    order = np.argsort(group, kind="stable")
    begins = np.ones(size, bool)
    begins[1:] = group[order][1:] != group[order][:-1]
    for depth in range(min(SHALLOW, width) // 8):
        part = np.cumsum(begins)
        alone = begins.copy()
        alone[:-1] &= begins[1:]
        tied = np.flatnonzero(~alone)  # groups of one are in place
        if not len(tied):
            break
        column = characters[order[tied], depth]
        sorted_ = np.lexsort((column, part[tied]))
        order[tied] = order[tied][sorted_]
        column, parts = column[sorted_], part[tied][sorted_]
        begins[tied[1:]] = (parts[1:] != parts[:-1]) | (column[1:] != column[:-1])
    starts = np.flatnonzero(begins)
    for low, high in zip(starts, np.append(starts[1:], size)):
        if high - low > 1 and width > SHALLOW:
            rows = order[low:high]
            order[low:high] = rows[blind_trie_order([text[r, SHALLOW:].tobytes() for r in rows])]
    common = np.full(size, -1, np.int64)
    if size > 1:
        differ = text[order[1:]] != text[order[:-1]]
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, common


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Sorted order of strings of equal length.

    A node keeps only the depth at which strings part, and one byte per branch.
    To insert, go down comparing just those bytes, compare once with the string
    at the leaf found, and split at the depth where the two differ.
    """
    width = len(strings[0])
    numbers = [int.from_bytes(s) for s in strings]
    root = [width, [0]]  # a leaf: (width, equal strings); a node: (depth, {byte: child})
    for i in range(1, len(strings)):
        text, node = strings[i], root
        while node[0] < width:
            branches = node[1]
            node = branches.get(text[node[0]]) or next(iter(branches.values()))
        other = node[1][0]
        apart = numbers[i] ^ numbers[other]
        if not apart:
            node[1].append(i)
            continue
        depth = width - (apart.bit_length() + 7) // 8
        above, node = None, root
        while node[0] < depth:
            above, node = node, node[1][text[node[0]]]
        if node[0] == depth:
            node[1][text[depth]] = [width, [i]]
            continue
        split = [depth, {text[depth]: [width, [i]], strings[other][depth]: node}]
        if above is None:
            root = split
        else:
            above[1][text[above[0]]] = split
    out: list[int] = []
    stack = [root]
    while stack:
        depth, inside = stack.pop()
        if depth == width:
            out.extend(inside)
        else:
            stack.extend(inside[b] for b in sorted(inside, reverse=True))
    return out
