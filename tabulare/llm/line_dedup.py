"""Line dedup: a repeated line stays only in the first document that holds it.

A line's key is the line stripped of ASCII white space at both ends, with A-Z
lower-cased. Keys of at least ``LEAST`` code points found in more than one
document lose their lines everywhere but in the document with the smallest id
(there all of them stay, repeats too). The result is no text: it is one
compressed bitmap per document that loses lines, a bit per line, 1 for a line
that stays. ``apply`` reads texts through the bitmaps.

Scale: the texts are read once and leave the task as (128-bit hash of the
key, document, position). These rows are partitioned by range on the hash
*and* the document and position, and sorted within the partition, so a line
that a third of all documents hold is spread over many partitions. Each
partition is streamed once: in a run of equal hashes every row of another
document than the run's first goes. Only the head of a partition's first run
may have an earlier one in the partition before; those few rows are left open
and settled against the heads of the partitions' last runs, a row each. The
bitmaps then meet the texts in one join on id and text hash.

Defined results for odd input: NULL or empty text is one empty line; rows with
one id are one document to the others (a line found only there stays), each
with its own bitmap; rows without id come after all ids, in order of a 64-bit
hash of their texts, equal texts without id being one document; repeated rows
(id and text) have one bitmap; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulare.llm.common import materialize

LEAST = 10                 # code points a key has at least
ROWS = 1 << 16             # line rows a task holds at a time
SPACE = b" \t\n\x0b\x0c\r"
DROP, OPEN, HEAD = range(3)
_LINE = "hi long, lo long, late boolean, doc long, tie long, at int, lines int"
_ORDER = ["hi", "lo", "late", "doc", "tie", "at"]
_FOUND = "kind int, " + _LINE


def _named(batch: pa.RecordBatch) -> Iterator[tuple[bool, int, int, bytes]]:
    """``late, doc, tie, text`` per row: rows without id come late, named by their text's hash."""
    for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        text = text or b""
        tie = xxhash.xxh64_intdigest(text)
        tie -= tie >> 63 << 64
        yield i is None, tie if i is None else i, tie, text


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines long enough to count; a row repeated within the task once."""
    digest, seen = xxhash.xxh3_128_digest, set()
    names, at, of, hashes = [], [], [], []

    def flush():
        k = np.repeat(np.arange(len(names)), of)
        late, doc, tie, lines = (np.array(x)[k] for x in zip(*names))
        h = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
        out = pa.RecordBatch.from_arrays(
            [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(late), pa.array(doc), pa.array(tie), pa.array(np.array(at, np.int32)),
             pa.array(lines.astype(np.int32))], names=["hi", "lo", "late", "doc", "tie", "at", "lines"])
        for x in (names, at, of, hashes):
            x.clear()
        return out

    for batch in batches:
        for late, doc, tie, text in _named(batch):
            if (late, doc, tie) in seen:
                continue
            seen.add((late, doc, tie))
            all_lines = text.split(b"\n")
            for start in range(0, len(all_lines), ROWS):
                n = len(at)
                for i, line in enumerate(all_lines[start:start + ROWS], start):
                    key = line.strip(SPACE)
                    if len(key) >= 4 * LEAST or len(key) >= LEAST and len(key.decode("utf-8", "replace")) >= LEAST:
                        at.append(i)
                        hashes.append(digest(key.lower()))      # bytes: A-Z alone change
                names.append((late, doc, tie, len(all_lines)))
                of.append(len(at) - n)
                if len(at) >= ROWS:
                    yield flush()
    if at:
        yield flush()


def _first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted partition: the rows that go, those open, and the head of the last run."""
    head = None                                  # hi, lo, late, doc, tie, at, lines of the current run's first row
    opening = True                               # still in the partition's first run
    names = ["kind", "hi", "lo", "late", "doc", "tie", "at", "lines"]

    def rows(kind, cols, pick):
        return pa.RecordBatch.from_arrays([pa.array(np.full(int(pick.sum()), kind, np.int32)), *(pa.array(c[pick]) for c in cols)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        hi, lo, late, doc = cols[:4]
        same = np.r_[head is not None and (hi[0], lo[0]) == head[:2], (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1])]
        if head is not None and not same[0]:
            opening = False
        run = np.cumsum(~same)                   # 0: the run that was open before this batch
        start = np.flatnonzero(~same)
        first = lambda c, i: np.r_[[head[i]] if head is not None else c[:1], c[start]][run].astype(c.dtype)
        own = (late == first(late, 2)) & (doc == first(doc, 3))
        if not own.all():
            yield rows(DROP, cols, ~own)
        if opening:
            lead = run == (0 if head is not None else 1)
            if (own & lead).any():
                yield rows(OPEN, cols, own & lead)
            opening = bool(lead.all())
        if len(start):
            head = tuple(c[start[-1]] for c in cols)
    if head is not None:
        yield rows(HEAD, [np.array([x]) for x in head], np.array([True]))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone, keep = [], []
        for lines, dropped in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            bits = np.ones(lines, bool)
            bits[dropped] = False
            gone.append(len(dropped))
            keep.append(zlib.compress(np.packbits(bits).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(gone, pa.int32()),
                                          pa.array(keep, pa.binary())], names=["doc_id", "tie", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """``doc_id, tie, n_lines, n_dropped, keep`` of the documents that lose lines.

    ``tie`` is the XXH64 of the text (signed, seed 0), ``keep`` the deflated bitmap.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    lines = materialize(texts.mapInArrow(_keyed, _LINE), "line-keys")     # range bounds are sampled from it
    found = lines.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(_first_runs, _FOUND)
    found = materialize(found, "line-runs")
    heads = found.where(F.col("kind") == HEAD).groupBy("hi", "lo").agg(F.min(F.struct("late", "doc")).alias("head"))
    open_ = found.where(F.col("kind") == OPEN).join(heads, ["hi", "lo"]).where(F.struct("late", "doc") > F.col("head"))
    names = ["late", "doc", "tie", "lines", "at"]
    gone = found.where(F.col("kind") == DROP).select(names).unionByName(open_.select(names))
    gone = gone.groupBy("late", "doc", "tie").agg(F.max("lines").alias("lines"), F.collect_set("at").alias("dropped"))
    gone = gone.selectExpr("IF(late, NULL, doc) AS doc_id", "tie", "lines", "dropped")
    return gone.mapInArrow(_bitmaps, "doc_id long, tie long, n_lines int, n_dropped int, keep binary")


def apply(docs: DataFrame, bitmaps: DataFrame, text: bool = True, digest: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_lines, n_dropped`` and, as asked for, the kept ``text`` and its SHA-256."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ties = [tie for _, _, tie, _ in _named(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ties, pa.int64())], names=["doc_id", "text", "tie"])

    named = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(name, f"doc_id {kind}, text binary, tie long").alias("d")
    b = bitmaps.select(F.col("doc_id").alias("of"), F.col("tie").alias("named"), "keep").alias("b")
    both = named.join(b.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col("of")) & (F.col("tie") == F.col("named")), "left")
    ddl = f"doc_id {kind}, n_lines long, n_dropped long" + ", text binary" * text + ", kept_sha256 string" * digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, left = [], [], []
            for t, keep in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                t = t or b""
                n, kept = t.count(b"\n") + 1, None
                if keep is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n)
                    kept = n - int(bits.sum())
                    t = b"\n".join(line for line, stays in zip(t.split(b"\n"), bits.tolist()) if stays)
                sizes.append(n)
                gone.append(kept or 0)
                left.append(t)
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())] + [pa.array(left, pa.binary())] * text
            arrays += [pa.array([hashlib.sha256(t).hexdigest() for t in left], pa.string())] * digest
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_lines", "n_dropped"] + ["text"] * text + ["kept_sha256"] * digest)

    out = both.select("doc_id", "text", "keep").mapInArrow(run, ddl)
    return out.withColumn("text", F.col("text").cast("string")) if text else out


def dedup_lines(docs: DataFrame, text: bool = True, digest: bool = False) -> DataFrame:
    """Texts without their repeated lines."""
    return apply(docs, keep_bitmaps(docs), text, digest)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE_SQL = f"""
WITH lists AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM lists),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_UPPER.lower()}') AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS f FROM keyed WHERE length(k) >= {LEAST} GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT keyed.*, coalesce(f < doc_id, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
