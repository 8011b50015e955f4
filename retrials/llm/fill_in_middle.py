"""Fill-in-the-middle texts by one match that keeps all its captures.

``(unit)*`` is matched once against the whole text; the regex library keeps every repetition of the
group, so the number of units and the offset behind the k-th one are read off the list of ends.
The two cuts are drawn from a keyed hash of the id, hence the same in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT, GRAPHEME = "(?s:.)", r"\X"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four 32-bit draws from the SHA-256 of ``seed:id``; a null id counts as the word null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def parts(match: regex.Pattern, text: str, first: int, second: int) -> tuple[int, str, str, str]:
    """(units, prefix, middle, suffix) of a text for two draws; ``match`` is ``(unit)*``."""
    ends = match.fullmatch(text).ends(1)
    n = len(ends)
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    return n, text[:a], text[a:b], text[b:]


def _cut(unit: str, plain_from: int, spm_below: int):
    marks = (PREFIX, SUFFIX, MIDDLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = regex.compile(f"({unit})*")
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = []
                for text, *h in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True):
                    n, prefix, middle, suffix = parts(match, text, h[0], h[1])
                    if not text or h[2] % 100 >= plain_from or any(m in text for m in marks):
                        rows.append((n, "plain", None, None, text))
                    elif h[3] % 100 < spm_below:
                        rows.append((n, "spm", len(prefix), len(middle), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"))
                    else:
                        rows.append((n, "psm", len(prefix), len(middle), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))],
                                                 names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def fill_in_middle(docs: DataFrame, seed: int = 1, unit: str = CODE_POINT, fim_percent: int = 90, spm_percent: int = 20,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    ``unit`` is a pattern of which a text is a sequence (a code point, a grapheme, ...).  ``fim_percent``
    of the texts are cut, ``spm_percent`` of those put the suffix first.  An empty or null text stays plain
    (null as empty), and so does one that holds a mark, as it couldn't be put together again.  Both cuts
    may fall on one place or an end: parts may be empty.  Rows are taken one by one: repeated rows give
    equal rows, an empty table none, other columns are not read.  Memory follows the longest single
    text, some 40 bytes a unit."""
    kind = docs.schema[doc_id].dataType.simpleString()
    src = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                      *(h.alias(f"h{i}") for i, h in enumerate(draws(F.col(doc_id), seed))))
    out = src.mapInArrow(_cut(unit, fim_percent, spm_percent), f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return out.withColumnRenamed("doc_id", doc_id)


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of."""
    def after(mark: str) -> Column:
        return F.instr(output, mark) + len(mark)

    def between(mark: str, following: str) -> Column:
        return F.substring(output, after(mark), F.instr(output, following) - after(mark))

    middle = F.substring(output, after(MIDDLE), F.length(output))
    return (F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
            .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))).otherwise(output))
