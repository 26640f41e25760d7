"""Find licence phrases and notices with a positional index of rare words.

Each notice is a list of words with offsets. Of its key phrase, which every match
must hold, the rarest words by document counts over the whole table are looked up
in a file; each hit says where the notice would start, and starts that they agree on
are candidates: no match has others, whatever other words it lacks. A candidate
counts if the whole key phrase stands at its place and enough other words do.
DataFrame functions throughout; a file is scanned where it lies, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.line_runs import LOWER, UPPER
from plumbline.llm.tables import whole_text

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases of the contract, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices as projects use them: label -> (words, key phrase that must be there).
NOTICES = {
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license"),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistribution and use",
    ),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "cc by nc"),
    "gpl-3.0": ("licensed under the gnu general public license version 3", "general public license version 3"),
    "mit": ("released under the mit license", "mit license"),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "hereby granted free of charge",
    ),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
}
# Words of a key phrase that are looked up, and how much of the notice must match.
RARE_WORDS = 2
LEAST_SHARE = 0.6


def words_of(text: Column) -> Column:
    """Runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NOT_WORD), "")


def document_counts(words: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many rows each word of the vocabulary occurs; one row per word comes back."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = words.select(F.explode(F.array_intersect("words", known)).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in found.collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def rare_words(notice: Sequence[str], phrase: Sequence[str], counts: Mapping[str, int]) -> list[tuple[int, str]]:
    """(offset in the notice, word) of the key phrase's words in fewest documents, each at its first place there."""
    order = sorted(set(phrase), key=lambda w: (counts[w], w))
    return [(_key_at(notice, phrase) + phrase.index(w), w) for w in order[:RARE_WORDS]]


def _key_at(notice: Sequence[str], phrase: Sequence[str]) -> int:
    return next(i for i in range(len(notice)) if list(notice[i : i + len(phrase)]) == list(phrase))


def scan_licenses(
    docs: DataFrame,
    text_col: str = "text",
    notices: Mapping[str, tuple[str, str]] = NOTICES,
    base: Mapping[str, str] = BASE,
) -> DataFrame:
    """All rows as a struct ``row``, with what was found in them.

    ``n_words``; ``n_base`` places of base phrases, ``first_word`` and
    ``last_word`` the least and greatest of their starts (NULL without any);
    ``base_labels``, and ``labels`` with those of verified notices too, sorted and
    joined by commas, empty without any; ``score``, the share of the best notice
    that matches, 0.5 for a base phrase alone, else 0. NULL texts are empty.
    """
    texts = {label: (t.split(), p.split()) for label, (t, p) in notices.items()}
    rows = docs.select(F.struct("*").alias("row"), words_of(whole_text(text_col)).alias("words"))
    counts = document_counts(rows, sorted({w for t, _ in texts.values() for w in t}))
    rare = {label: rare_words(t, p, counts) for label, (t, p) in texts.items()}
    wanted = sorted({w for r in rare.values() for _, w in r} | {p.split()[-1] for p in base})

    hits = F.filter(
        F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(wanted)
    )
    rows = rows.withColumn("hits", hits)
    rows = rows.select(
        "row", "words",
        F.struct(*[_places(p).alias(label) for p, label in base.items()]).alias("base"),
        F.struct(*[_shares(t, p, rare[label]).alias(label) for label, (t, p) in texts.items()]).alias("own"),
    )
    places = F.concat(*[F.col("base").getField(label) for label in base.values()])
    best = F.greatest(*[F.col("own").getField(label) for label in texts])
    base_labels = [F.when(F.size(F.col("base").getField(b)) > 0, b) for b in base.values()]
    own_labels = [F.when(F.col("own").getField(b) > 0, b) for b in texts]
    rows = rows.withColumn("places", places)

    def joined(labels: list[Column]) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")

    return rows.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(base_labels + own_labels).alias("labels"),
        F.greatest(best, F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def _stands(start: Column, words: Sequence[str]) -> Column:
    """Whether the words stand at ``start`` one after another."""
    found = F.lit(True)
    for k, word in enumerate(words):
        found = found & F.coalesce(F.get(F.col("words"), start + k) == word, F.lit(False))
    return found


def _places(phrase: str) -> Column:
    """All starts of a phrase, found at its last word."""
    words = phrase.split()
    ahead = len(words) - 1
    hits = F.filter("hits", lambda x: (x["w"] == words[-1]) & _stands(x["i"] - ahead, words[:-1]))
    return F.transform(hits, lambda x: x["i"] - ahead)


def _starts(offset: int, word: str) -> Column:
    """Where a notice would start by each hit of one of its words."""
    return F.transform(F.filter("hits", lambda x: x["w"] == word), lambda x: x["i"] - offset)


def _shares(notice: Sequence[str], phrase: Sequence[str], rare: Sequence[tuple[int, str]]) -> Column:
    """Share of the notice's words in place at its best verified start; 0 without one."""
    starts = [_starts(offset, word) for offset, word in rare]
    agreed = F.array_distinct(reduce(F.array_intersect, starts))
    key_at = _key_at(notice, phrase)

    def share(start: Column) -> Column:
        matched = F.lit(0)
        for k, word in enumerate(notice):
            matched = matched + F.coalesce((F.get(F.col("words"), start + k) == word).cast("int"), F.lit(0))
        return F.when(_stands(start + key_at, phrase), matched / len(notice)).otherwise(0.0)

    best = F.coalesce(F.array_max(F.transform(agreed, share)), F.lit(0.0))
    return F.when(best >= LEAST_SHARE, best).otherwise(0.0)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        "base_labels", "labels", F.round("score", 6).alias("score"),
    )
