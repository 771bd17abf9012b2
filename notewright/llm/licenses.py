"""Licence scans by a positional rare-token index, and op2_license_scan.

Templates are runs of words with mandatory key phrases. A file's licence words that are
rarest in the corpus (highest IDF) are looked up in the postings of all templates; a
posting's place gives the place where the template would begin, and a template found so is
aligned word by word and stands only if a key phrase does, whole."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.llm.common import Words, chunks, map_text, table, texts

# Phrase -> label.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
    "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
    "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
    "to the following conditions"
)
MIT_CONDITION = "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
BSD_LEAD = "redistribution and use in source and binary forms with or without modification are permitted"
BSD_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
BSD_BINARY = (
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
    "the documentation and or other materials provided with the distribution"
)
BSD_NAMES = "may be used to endorse or promote products derived from this software without specific prior written permission"
ISC_GRANT = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
    "the above copyright notice and this permission notice appear in all copies"
)
ZERO_GRANT = "for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties"
UNLICENSE = "this is free and unencumbered software released into the public domain"
UNLICENSE_GRANT = (
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled "
    "binary for any purpose commercial or non commercial and by any means"
)
APACHE_HEADER = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
    "obtain a copy of the license at"
)
CC0_WAIVER = "has waived all copyright and related or neighboring rights to this work"


def gnu_notices() -> list[tuple[str, str, tuple[str, ...]]]:
    """Notices of the GNU licences: of any version, and of one."""
    out = []
    for label, name, versions in (
        ("gpl", "gnu general public license", ("2", "3")),
        ("lgpl", "gnu lesser general public license", ("2 1", "3")),
        ("lgpl", "gnu library general public license", ("2",)),
        ("agpl", "gnu affero general public license", ("3",)),
    ):
        terms = f"is free software you can redistribute it and or modify it under the terms of the {name}"
        published = "as published by the free software foundation"
        out.append((f"{label}-notice", terms, (name,)))
        for v in versions:
            own = f"{label}-{v.replace(' ', '.')}-notice"
            out.append((own, f"this work is licensed under the {name} version {v}", (f"{name} version {v}",)))
            for either in ("either version", "version"):
                grant = f"under the terms of the {name} {published} {either} {v} of the license"
                out.append((own, grant, (f"{name} {published} {either} {v} of the license",)))
            out.append((own, f"under the terms of the {name} version {v} {published}", (f"{name} version {v}",)))
    return out


def cc_notices() -> list[tuple[str, str, tuple[str, ...]]]:
    """Notices of the Creative Commons licences, version 4.0, by initials and by name."""
    names = {"by": "attribution", "nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
    out = []
    for kind in ("by", "by nc", "by sa", "by nd", "by nc sa", "by nc nd"):
        label = f"cc-{kind.replace(' ', '-')}-4.0-notice"
        title = f"creative commons {' '.join(names[k] for k in kind.split())} 4 0"
        key = "cc by nc" if kind == "by nc" else f"cc {kind} 4 0"
        out.append((label, f"licensed under cc {kind} 4 0", (key,)))
        out.append((label, f"licensed under a {title} international license", (title,)))
    return out


# Fixed values: (label, words of a notice, phrases of which one must stand whole in it). A
# label may have several notices: a text that differs in length in one is found by another.
NOTICES = [
    ("mit-notice", "released under the mit license", ("mit license",)),
    ("mit-notice", MIT_GRANT, ("to deal in the software without restriction",)),
    ("mit-notice", MIT_CONDITION, ("shall be included in all copies or substantial portions of the software",)),
    ("apache-2.0-notice", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0-notice", APACHE_HEADER, ("apache license version 2 0",)),
    *gnu_notices(),
    *cc_notices(),
    ("cc0-1.0-notice", "cc0 1 0 universal", ("cc0 1 0 universal",)),
    ("cc0-1.0-notice", CC0_WAIVER, ("waived all copyright and related or neighboring rights",)),
    ("bsd-notice", BSD_LEAD, ("redistribution and use in source and binary forms",)),
    ("bsd-notice", BSD_SOURCE, ("redistributions of source code must retain the above copyright notice",)),
    ("bsd-notice", BSD_BINARY, ("redistributions in binary form must reproduce the above copyright notice",)),
    ("bsd-3-clause-notice", BSD_NAMES, ("used to endorse or promote products derived from this software",)),
    ("isc-notice", ISC_GRANT, ("provided that the above copyright notice and this permission notice appear in all copies",)),
    ("isc-notice", ISC_GRANT.replace("and or", "and"), ("provided that the above copyright notice and this permission notice appear in all copies",)),
    ("0bsd-notice", ZERO_GRANT, ("hereby granted the software is provided as is",)),
    ("unlicense-notice", UNLICENSE, ("free and unencumbered software",)),
    ("unlicense-notice", UNLICENSE_GRANT, ("anyone is free to copy modify publish use compile sell or distribute this software",)),
    (
        "mpl-2.0-notice",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
]


@dataclass(frozen=True)
class ScanParams:
    """``rare`` licence words of a template are looked up, of those that the file has;
    ``aligned`` is the share of a notice's words that must stand in their places."""

    rare: int = 3
    aligned: float = 0.8


class Index:
    """Postings of the templates, with IDF by document counts ``df`` of ``n_docs``."""

    def __init__(self, df: dict[str, int], n_docs: int):
        self.templates = [(label, phrase.split(), [phrase.split()], True) for phrase, label in PHRASES.items()]
        self.templates += [(label, text.split(), [k.split() for k in keys], False) for label, text, keys in NOTICES]
        self.words = vocabulary()
        number = {w: i for i, w in enumerate(self.words)}
        hashes = word_hashes(self.words)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.idf = np.log((1 + n_docs) / (1 + np.array([df.get(w, 0) for w in self.words])))
        self.ids = [np.array([number[w] for w in words]) for _, words, _, _ in self.templates]
        self.keys = [[np.array([number[w] for w in key]) for key in keys] for _, _, keys, _ in self.templates]
        self.flat = np.concatenate(self.ids)
        self.lengths = np.array([len(i) for i in self.ids])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.wholes = np.array([t[3] for t in self.templates])
        self.rarest = [sorted(set(ids.tolist()), key=lambda i: (-self.idf[i], i)) for ids in self.ids]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number in the vocabulary of each word, -1 for others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def scan(self, ids: np.ndarray, params: ScanParams) -> list[tuple[int, int, float]]:
        """(template, start, share of words in place) of all that are found in a file."""
        out = []
        have = np.flatnonzero(ids >= 0)
        known = np.zeros(len(self.words), bool)
        known[ids[have]] = True
        present = set(np.flatnonzero(known).tolist())
        # a template of which the file lacks too many words has no place at all
        most = np.add.reduceat(known[self.flat].astype(np.int64), self.offsets) / self.lengths
        for t in np.flatnonzero(most >= np.where(self.wholes, 1.0, params.aligned)).tolist():
            words, whole = self.ids[t], self.wholes[t]
            look = [w for w in self.rarest[t] if w in present][: params.rare]
            starts = set()
            for w in look[:1] if whole else look:
                at = have[ids[have] == w]
                for place in np.flatnonzero(words == w):
                    starts.update((at - place).tolist())
            for start in sorted(starts):
                lo, hi = max(0, start), min(len(ids), start + len(words))
                part = ids[lo:hi]
                share = float((part == words[lo - start : hi - start]).sum()) / len(words)
                if share >= (1.0 if whole else params.aligned) and any(_stands(part, key) for key in self.keys[t]):
                    out.append((t, start, share))
        return out


def _stands(ids: np.ndarray, key: np.ndarray) -> bool:
    return any(np.array_equal(ids[i : i + len(key)], key) for i in range(len(ids) - len(key) + 1))


def vocabulary() -> list[str]:
    return sorted({w for text in [*PHRASES, *(n for _, n, _ in NOTICES), *(k for _, _, ks in NOTICES for k in ks)] for w in text.split()})


def word_hashes(words: list[str]) -> np.ndarray:
    return Words([" ".join(words).encode()]).hash


def document_counts(docs: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each licence word stands, over all documents; and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary()
        index = Index({}, 0)
        seen, n = np.zeros(len(words), np.int64), 0
        for batch in batches:
            items = texts(batch.column(0))
            n += len(items)
            for start, end in chunks(items):
                found = Words(items[start:end])
                ids = index.numbers(found.hash)
                hit = ids >= 0
                pairs = np.unique(found.doc[hit] * len(words) + ids[hit])
                seen += np.bincount(pairs % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array([*words, ""]), pa.array([*seen.tolist(), n])], names=["word", "n"])

    sums = docs.select(docs[text].cast("binary")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df = {r["word"]: r["n"] for r in sums.collect()}  # a row a licence word
    return df, df.pop("", 0)


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField(
        "spans",
        T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("share", T.DoubleType())])),
    ),
]


def scan_licenses(docs: DataFrame, text: str = "text", keep: list[str] | None = None, params: ScanParams = ScanParams()) -> DataFrame:
    """``docs`` with FIELDS. n_base, first_word and last_word are of all places of PHRASES;
    ``spans`` has every place of phrases and notices with the share of words in place, and
    ``score`` is the largest share. Null and empty texts have no words and no labels;
    repeated rows give repeated results; a column of a result's name gives way to it."""
    df, n_docs = document_counts(docs, text)

    def make():
        index = Index(df, n_docs)

        def one(ids: np.ndarray):
            found = sorted((s, index.templates[t][0], share, index.templates[t][3]) for t, s, share in index.scan(ids, params))
            base = [s for s, _, _, whole in found if whole]
            return (
                len(ids), len(base), min(base, default=None), max(base, default=None),
                ",".join(sorted({label for _, label, _, whole in found if whole})),
                ",".join(sorted({label for _, label, _, _ in found})),
                max((share for _, _, share, _ in found), default=0.0),
                [{"label": label, "start": s, "share": share} for s, label, share, _ in found],
            )

        def work(items):
            rows = []
            for start, end in chunks(items):
                words = Words(items[start:end])
                ids = index.numbers(words.hash)
                rows += [one(ids[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            return list(zip(*rows, strict=True)) if rows else [[]] * len(FIELDS)

        return work

    return map_text(docs, make, FIELDS, text, keep)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", *(f.name for f in FIELDS[:-1]))


QUERIES = {"op2_license_scan": op2_license_scan}
SQL: dict[str, str] = {}
