"""Rollout archives: tar files whose members hold one problem's samples each.

Reading takes two steps of tasks: the headers of every archive are listed, then members are read by their
byte ranges, so that one large archive is shared among all tasks.  Compressed archives can't be entered in
the middle and are one task each.
"""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrials.sources.remote import create_file, open_file

MEMBERS = "archive string, member string, start long, size long"
SAMPLES = "archive string, member string, problem string, reference string, sample long, text string"
#: Rows of output held at a time.
ROWS = 256


def parse_document(body: bytes) -> dict:
    """A YAML mapping.  JSON, which YAML contains, is tried first because it parses much faster."""
    try:
        found = json.loads(body)
    except ValueError:
        import yaml
        found = yaml.load(body, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    if not isinstance(found, dict):
        raise ValueError("not a mapping")
    return found


def _wanted(info: tarfile.TarInfo, suffix: str, skip: str) -> bool:
    return info.isfile() and info.name.endswith(suffix) and f"/{skip}/" not in f"/{info.name}"


def _samples(archive: str, member: str, body: bytes, reference: str, samples: str) -> Iterator[tuple]:
    try:
        document = parse_document(body)
        texts = document[samples]
    except Exception as error:
        raise ValueError(f"{archive}: {member} is no document with {samples!r}") from error
    known = document.get(reference)
    problem = member.rpartition("/")[2].rpartition(".")[0]
    for i, text in enumerate(texts or []):
        yield archive, member, problem, None if known is None else str(known), i, None if text is None else str(text)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def read_rollout_archives(spark: SparkSession, root: str, pattern: str = "*.tar*", reference: str = "gt_answer", samples: str = "samples",
                          suffix: str = ".yaml", skip: str = "logs") -> DataFrame:
    """One row per sample of every document in every archive below ``root``: archive, member, problem
    (the member's name without folder and suffix), reference, sample (from 0), text.

    Members of another suffix or below a ``skip`` folder are left out; a document without a sample list
    is an error, an empty list gives no row.  A task holds one document at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    packed = F.col("path").rlike(r"\.(tgz|tbz2?|txz|gz|bz2|xz)$")
    names = ["archive", "member", "problem", "reference", "sample", "text"]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string()]

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for path in b.column(0).to_pylist():
                    with open_file(path) as source, tarfile.open(fileobj=source, mode="r:") as tar:
                        for info in tar:
                            if _wanted(info, suffix, skip):
                                yield path, info.name, info.offset_data, info.size
                            tar.members = []  # the list of headers would grow with the archive
        yield from _batches(rows(), ["archive", "member", "start", "size"], [pa.string(), pa.string(), pa.int64(), pa.int64()])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for path, member, start, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    with open_file(path) as source:
                        source.seek(start)
                        body = source.read(size)
                    yield from _samples(path, member, body, reference, samples)
        yield from _batches(rows(), names, kinds)

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for path in b.column(0).to_pylist():
                    with open_file(path) as source, tarfile.open(fileobj=source, mode="r|*") as tar:
                        for info in tar:
                            if _wanted(info, suffix, skip):
                                yield from _samples(path, info.name, tar.extractfile(info).read(), reference, samples)
                            tar.members = []
        yield from _batches(rows(), names, kinds)

    members = files.where(~packed).mapInArrow(headers, MEMBERS)
    spread = members.repartition("archive", "start")  # headers only: the documents are read behind it
    return spread.mapInArrow(ranges, SAMPLES).union(files.where(packed).mapInArrow(streams, SAMPLES))


def write_rollout_archives(documents: DataFrame, root: str, problem: str = "problem", samples: str = "samples", reference: str = "gt_answer") -> int:
    """One tar below ``root`` for each partition that has rows: a document a row, flow-style YAML.
    Returns the number of documents.  A repeated task writes the same file again."""
    chosen = documents.select(F.col(problem).cast("string"), F.col(samples), F.col(reference).cast("string"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        path, written = f"{root.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.tar", 0
        tar = sink = None
        for b in batches:
            for name, texts, known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if tar is None:
                    sink = create_file(path)
                    tar = tarfile.open(fileobj=sink, mode="w|")
                body = json.dumps({reference: known, samples: texts}, ensure_ascii=False).encode()
                info = tarfile.TarInfo(f"rollouts/{name}.yaml")
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
                tar.members = []
                written += 1
        if tar is not None:
            tar.close()
            sink.close()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["n"])

    return chosen.mapInArrow(pack, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
