"""Small awkward tables, and plain versions of the operators to hold them against."""

from __future__ import annotations

import hashlib
import random
import re

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, row string, id double, size string"


def awkward_docs(spark, seed: int = 1):
    """Documents with shared passages, copies, NULLs, empty and long texts, and columns named like internals."""
    draw = random.Random(seed)
    words = ["the", "of", "naïve", "Übung", "x", "stone", "river", "Cloud", "forty", "two", "license", "cc", "by", "all"]

    def prose(n):
        return " ".join(draw.choice(words) + str(draw.randint(0, 40)) * draw.randint(0, 1) for _ in range(n))

    shared = [prose(60) for _ in range(3)]
    texts = [None, None, "", "", " \n\t ", "ONE", "a b", "ab " * 120, "z" * 700, "\n".join(["same line here", "x"] * 4)]
    texts += [prose(draw.randint(1, 90)) for _ in range(25)]
    texts += [prose(20) + "\n" + draw.choice(shared) + "\n" + prose(25) for _ in range(15)]
    texts += [prose(4000) + "\n" + shared[0] + " " + shared[1]]
    texts += [texts[12]] * 3 + [texts[20] + " tail"] + ["  SAME line here  \nunlike"]
    texts += ["Intro. All rights reserved. CC BY text", "Licensed under the Apache License, Version 2.0."]
    rows = [(i, t, "en", draw.choice(["a", "b", "é", None, ""]), len(t or ""), "t", "r", 0.5, "s") for i, t in enumerate(texts)]
    rows.append(rows[14])  # a repeated row
    rows.append((None, shared[2], None, None, None, None, None, None, None))
    rows.append((None, shared[2], None, None, None, None, None, None, None))
    rows.append((3, "another text under a known id", "en", "a", 1, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeated_units(rows, window, split, join):
    """(id, units, removed, digest) per row: units in a window that occurs twice anywhere go."""
    units = [split((r[1] or "").encode()) for r in rows]
    seen = {}
    for u in units:
        for i in range(len(u) - window + 1):
            key = tuple(u[i : i + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for r, u in zip(rows, units):
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = join([x for x, g in zip(u, gone) if not g])
        out.append((r[0], len(u), sum(gone), sha(kept)))
    return out


def line_dedup(rows):
    """(id, lines, dropped, digest): rows with one id are one document, rows without id the last."""

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)

    last = float("inf")
    first = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            k = key(line)
            first[k] = min(first.get(k, last), last if r[0] is None else r[0])
    out = []
    for r in rows:
        mine = last if r[0] is None else r[0]
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] >= mine]
        out.append((r[0], len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    return out


def fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_of(rows, radius=3):
    """Least id of each row's component, in row order; None if it has no id."""
    marks = [fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= radius and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    ids = {}
    for g, r in zip(group, rows):
        if r[0] is not None:
            ids[g] = min(ids.get(g, r[0]), r[0])
    return [(r[0], f"{m:016x}", ids.get(g)) for r, m, g in zip(rows, marks, group)]


def closest_below(lengths, target, most=2):
    """Greatest sum up to the target of the lengths, each taken 0 to ``most`` times."""
    reach = 1
    for n in lengths:
        for _ in range(most):
            reach |= reach << n
    return (reach & ((1 << (target + 1)) - 1)).bit_length() - 1


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def order(rows):
    return sorted(rows, key=repr)


def least_reachable(links):
    """The least node that each node of the links reaches, step by step."""
    near = {}
    for a, b in links:
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)
    out = {}
    for node in sorted(near):
        open_ = [] if node in out else [node]
        while open_:
            x = open_.pop()
            if x not in out:
                out[x] = node
                open_ += near[x]
    return out
