"""License scan with a positional index of rare licence words.

Templates are short notices.  Each word of a template has a posting (template, offset).  The document
frequencies of all template words are counted over the whole corpus; a file's licence words of high
inverse frequency are looked up and their postings are intersected by relative position (place in
the file minus offset).  A place goes on only where the rare words that agree on it, within the
slack, weigh what the coverage demands of them; it is confirmed by all words it shares with the
template and by the template's mandatory phrases.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that count wherever they stand, and their labels (fixed by the contract).
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: label, notice, mandatory phrases
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     ("permission is hereby granted free of charge",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
     ("gnu general public license", "version 3 of the license")),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "this library is licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ("redistribution and use in source and binary forms",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify and or distribute this software for any purpose",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related",)),
)
_TO_SPACE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return text.encode().translate(_TO_SPACE).split() if text else []


def _split(phrase: str) -> list[bytes]:
    return phrase.encode().split()


def vocabulary(templates=TEMPLATES) -> list[bytes]:
    return sorted({w for _, notice, _ in templates for w in _split(notice)} | {w for phrase, _ in BASE for w in _split(phrase)})


def document_frequencies(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> tuple[int, dict[bytes, int]]:
    """Rows of ``docs``, and rows that hold each template word.  The driver gets a number a template word."""
    known = frozenset(vocabulary(templates))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for b in batches:
            seen[b""] += b.num_rows
            for x in b.column(0):
                seen.update(known.intersection(words_of(x.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(text).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r["word"]): r["n"] for r in rows}
    return found.pop(b"", 0), found


class Index:
    """Postings of the rare template words.  Rare: an inverse document frequency no lower than the
    median of the template's own words, so that each template has rare words in any corpus."""

    def __init__(self, n_docs: int, frequency: dict[bytes, int], coverage: float = 0.7, slack: int = 2, templates=TEMPLATES):
        self.coverage, self.slack = coverage, slack
        self.idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) for w in vocabulary(templates)}
        self.templates = [(label, _split(notice), [_split(m) for m in must]) for label, notice, must in templates]
        self.base = defaultdict(list)
        for phrase, label in BASE:
            words = _split(phrase)
            rarest = max(range(len(words)), key=lambda i: (self.idf[words[i]], -i))
            self.base[words[rarest]].append((words, rarest, label))
        self.postings = defaultdict(list)
        self.weights = [[self.idf[w] + 1e-9 for w in words] for _, words, _ in self.templates]
        self.needed = []
        for t, (_, words, _) in enumerate(self.templates):
            level = sorted(self.idf[w] for w in words)[len(words) // 2]
            common = 0.0
            for o, w in enumerate(words):
                if self.idf[w] >= level:
                    self.postings[w].append((t, o))
                else:
                    common += self.weights[t][o]
            # A place that reaches the coverage has at least this weight among its rare words, even if every common word is there.
            self.needed.append((coverage - 1e-9) * sum(self.weights[t]) - common)
        self.lookup = frozenset(self.postings) | frozenset(self.base)

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Starts of base phrases, base labels, all labels, and the best score."""
        places = [(i, w) for i, w in enumerate(words) if w in self.lookup]
        starts, base = [], set()
        for i, w in places:
            for phrase, at, label in self.base.get(w, ()):
                if i >= at and words[i - at: i - at + len(phrase)] == phrase:
                    starts.append(i - at)
                    base.add(label)
        found, best = set(base), 1.0 if base else 0.0
        aligned = defaultdict(set)
        for i, w in places:
            for t, o in self.postings.get(w, ()):
                aligned[t, i - o].add(o)
        for t, at in aligned:
            label, notice, must = self.templates[t]
            offsets = set().union(*(aligned.get((t, at + d), ()) for d in range(-self.slack, self.slack + 1)))
            if sum(self.weights[t][o] for o in offsets) < self.needed[t]:
                continue
            lo = max(0, at - self.slack)
            near = words[lo: at + len(notice) + self.slack]
            if not all(self.holds(near, phrase) for phrase in must):
                continue
            share = self.shared(near, t, at - lo)
            if share >= self.coverage:
                found.add(label)
                best = max(best, share)
        return starts, base, found, best

    @staticmethod
    def holds(words: list[bytes], phrase: list[bytes]) -> bool:
        return any(words[i: i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))

    def shared(self, near: list[bytes], t: int, at: int) -> float:
        """Share of the template's inverse frequency found within ``slack`` of its place."""
        got = sum(weight for o, (w, weight) in enumerate(zip(self.templates[t][1], self.weights[t], strict=True))
                  if w in near[max(0, at + o - self.slack): max(0, at + o + self.slack + 1)])
        return got / sum(self.weights[t])


def scan_licenses(docs: DataFrame, coverage: float = 0.7, slack: int = 2, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null or empty text: no words, no labels, score 0; an empty table gives no rows.  Every place of a
    base phrase counts, also overlapping ones.  A text is read whole; its memory grows with its own
    words.  Of several places or templates of one label the best score stands.  Ids are passed on, null and repeated ones included; other columns are not read."""
    n_docs, frequency = document_frequencies(docs, text, templates)
    index = Index(n_docs, frequency, coverage, slack, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1):
                words = words_of(x.as_py())
                starts, base, found, score = index.scan(words)
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(found)), score))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                             names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double").withColumnRenamed("doc_id", doc_id)
