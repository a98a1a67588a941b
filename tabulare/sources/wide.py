"""Fixed-width records of many fields, parsed a column at a time.

``fwf.parse_fwf`` makes one substring expression per field and row; with the
244 fields of the published person layout that is past what Spark compiles
into one method. Here a task views a batch of equally long lines as one byte
matrix and turns whole columns of it into values: digits by a weighted sum,
blanks into NULL, text through Arrow. A row that holds anything else in any
number field (a sign, an exponent, a number out of range), or that has
another length than the batch's other lines, is left to ``fwf.field_column``,
so values, NULLs and errors are the same as ``parse_fwf``'s, always.

Writing such records has the same limit (one ``CASE`` and ``lpad`` per field,
interpreted row by row), and the same way out: ``encode_line_wide``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulare.sources.fwf import LATIN1, encode_field, encode_fwf, field_column, parse_fwf
from tabulare.sources.layout import Field, Layout

WIDE = 100                 # fields from which the byte matrix is the faster way
_EXACT = 15                # digits a double holds exactly
_LONG = 18                 # digits a long holds
_RANGE = {"tinyint": 1 << 7, "smallint": 1 << 15, "int": 1 << 31, "bigint": 1 << 63}
_ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
_SPACE, _ZERO, _POINT, _MINUS = 32, 48, 46, 45


def _numbers(seg: np.ndarray, kind: str, scale: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``values, blank, odd`` of a number field: spaces, then digits, in a double also a point among them."""
    n, width = seg.shape
    if not width:                              # the line ends before the field
        return np.zeros(n, float if kind == "double" else np.int64), np.ones(n, bool), np.zeros(n, bool)
    digit = seg - np.uint8(_ZERO)              # wraps: anything else is above 9
    is_digit = digit < 10
    if is_digit.all() and width <= (_LONG if kind != "double" or scale is not None else _EXACT):
        values = np.zeros(n, np.int64)
        for j in range(width):
            values = values * 10 + digit[:, j]
        blank = odd = np.zeros(n, bool)
        places = None
    else:
        space = seg == _SPACE
        point = seg == _POINT if kind == "double" else np.zeros_like(space)
        blank = space.all(axis=1)
        odd = ~(is_digit | space | point).all(axis=1) | (~space[:, :-1] & space[:, 1:]).any(axis=1) | (point.sum(axis=1) > 1)
        count = is_digit.sum(axis=1)
        values = np.zeros(n, np.int64)
        places = np.zeros(n, np.int64)
        seen = np.zeros(n, bool)
        significant = np.zeros(n, np.int64)
        for j in range(width):
            d = is_digit[:, j]
            values = np.where(d, values * 10 + digit[:, j], values)
            significant += d & ((significant > 0) | (digit[:, j] > 0))
            places += d & seen
            seen |= point[:, j]
        whole = ~seen                          # without a point a long is rounded once, as a parser rounds
        odd |= ~blank & ((count == 0) | (significant > np.where(whole, _LONG, _EXACT)))
    if kind == "double":
        values = values.astype(float)
        if places is not None and places.any():
            values = values / 10.0 ** np.minimum(places, 22)
            odd = odd | (places > 22)          # 10^22 is the last power of ten that a double holds
        if scale is not None:
            values = values / 10.0 ** scale
    else:
        odd = odd | (values >= _RANGE[kind]) if kind != "bigint" else odd
    return values, blank, odd


def _texts(seg: np.ndarray) -> pa.Array:
    """Trimmed text of a field, NULL if blank."""
    n, width = seg.shape
    if not width:
        return pa.nulls(n, pa.string())
    if seg.size and seg.max() > 127:           # Latin-1: a byte is a character
        wide = np.ascontiguousarray(seg).astype("<u4").view(f"<U{width}")[:, 0]
        text = pa.array(wide.tolist(), pa.string())
    else:
        text = pa.Array.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(seg))]).cast(pa.binary()).cast(pa.string())
    text = pc.utf8_trim(text, characters=" ")
    return pc.if_else(pc.equal(text, ""), pa.scalar(None, pa.string()), text)


def _matrix(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The batch as a byte matrix, and which rows are not in it (another length, or NULL)."""
    sizes = pc.binary_length(lines).fill_null(-1).to_numpy(zero_copy_only=False)
    held = sizes[sizes >= 0]
    width = int(np.bincount(held).argmax()) if len(held) else 0
    out = sizes != width
    if out.any():
        matrix = np.full((len(lines), width), _SPACE, np.uint8)
        inside = lines.filter(pa.array(~out))
        matrix[~out] = np.frombuffer(b"".join(inside.to_pylist()), np.uint8).reshape(-1, width)
        return matrix, out
    start = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset] if len(lines) and width else 0
    data = np.frombuffer(lines.buffers()[2], np.uint8, len(lines) * width, start) if len(lines) and width else np.empty(0, np.uint8)
    return data.reshape(len(lines), width), out


def parse_fwf_wide(df: DataFrame, layout: Layout, line_col: str = "value", encoding: str | None = LATIN1, mapped: bool = True,
                   strict: bool = True, fields: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``fwf.parse_fwf`` by byte matrix: same arguments, same result."""
    if encoding not in (None, LATIN1):
        raise ValueError("the byte matrix reads Latin-1, or UTF-8 lines of ASCII")
    chosen = [f for f in layout.fields if fields is None or f.variable in set(fields)]
    kinds = [layout.spark_type(f).simpleString() for f in chosen]
    cut = [(f.start - 1, f.start - 1 + f.width, layout.scale(f)) for f in chosen]
    kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(kept)
            matrix, odd = _matrix(lines)
            if encoding is None:
                odd = odd | (matrix > 127).any(axis=1)
            by_position = np.ascontiguousarray(matrix.T)      # a field's bytes side by side
            columns, blanks = [], []
            for (a, b, scale), kind in zip(cut, kinds):
                seg = by_position[a:b].T
                if kind == "string":
                    columns.append(_texts(np.where(odd[:, None], _SPACE, seg).astype(np.uint8) if encoding is None and odd.any() else seg))
                    blanks.append(None)
                else:
                    values, blank, bad = _numbers(seg, kind, scale)
                    odd = odd | bad
                    columns.append(values)
                    blanks.append(blank)
            arrays = [batch.column(i) for i in range(kept)]
            for c, blank, kind in zip(columns, blanks, kinds):
                arrays.append(c if blank is None else pa.array(np.where(odd, 0, c), _ARROW[kind], mask=blank | odd))
            rest = pa.nulls(len(lines), pa.string())
            if odd.any():
                name = encoding or "utf-8"
                text = [x.decode(name, "replace") if o and x is not None else None for x, o in zip(lines.to_pylist(), odd)]
                rest = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, rest], names=names)

    names = [f"k{i}" for i in range(kept)] + [f"f{i}" for i in range(len(chosen))] + ["rest"]
    schema = T.StructType([T.StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(keep)]
                          + [T.StructField(f"f{i}", layout.spark_type(f)) for i, f in enumerate(chosen)] + [T.StructField("rest", T.StringType())])
    from tabulare.session import ship_package

    ship_package()                             # tasks run this module
    parsed = df.select(*keep, F.col(line_col).cast("binary").alias("line")).mapInArrow(run, schema)
    rest = F.col("rest")
    return parsed.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], *[
        F.when(rest.isNull(), F.col(f"f{i}")).otherwise(field_column(layout, f, rest, strict)).alias(layout.name(f) if mapped else f.variable)
        for i, f in enumerate(chosen)])


def _put_number(out: np.ndarray, number: pa.Array, name: str) -> None:
    """Zero-padded digits with the sign first, NULL as blanks, into ``out`` (a row per position, a column per record)."""
    width = len(out)
    values = number.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    negative = values < 0
    some_negative = negative.any()
    rest = np.abs(values).view(np.uint64)                      # the smallest long has 2^63
    for room, rows in ((width, ~negative), (width - 1, negative)) if some_negative else ((width, slice(None)),):
        if room < 20 and (rest[rows] >= np.uint64(10 ** room)).any():
            raise ValueError(f"value too wide for fixed-width field {name}")
    if width < 10:
        rest = rest.astype(np.uint32)                          # half the time
    ten = rest.dtype.type(10)
    for j in range(width - 1, -1, -1):
        left = rest // ten
        out[j] = rest - left * ten
        rest = left
    out += np.uint8(_ZERO)
    if some_negative:
        out[0, negative] = _MINUS
    if number.null_count:
        out[:, number.is_null().to_numpy(zero_copy_only=False)] = _SPACE


def _number_run(fields: Sequence[Field]):
    """The text of neighbouring number fields, gaps between them blank, from one long per field."""
    first, size = fields[0].start, fields[-1].end - fields[0].start + 1
    places = [(f.start - first, f.end + 1 - first, f.variable) for f in fields]

    def run(*numbers: pa.Array) -> pa.Array:
        n = len(numbers[0])
        matrix = np.full((size, n), _SPACE, np.uint8)
        for (a, b, name), number in zip(places, numbers):
            _put_number(matrix[a:b], number, name)
        at = pa.py_buffer(np.arange(n + 1, dtype=np.int64) * size)
        return pa.Array.from_buffers(pa.large_string(), n, [None, at, pa.py_buffer(np.ascontiguousarray(matrix.T))]).cast(pa.string())
    return F.arrow_udf(run, T.StringType())


def encode_line_wide(layout: Layout, values: dict[str, Column]) -> Column:
    """``fwf.encode_line`` by byte matrix: same text. Texts and numbers with a written point stay column expressions."""
    pieces: list[Column] = []
    numbers: list[tuple[Field, Column]] = []
    pos = 1

    def flush():
        if numbers:
            pieces.append(_number_run([f for f, _ in numbers])(*[c for _, c in numbers]))
            numbers.clear()

    for f in sorted(layout.fields, key=lambda x: x.start):
        kind, scale, value = layout.spark_type(f), layout.scale(f), values[f.variable]
        plain = not isinstance(kind, T.StringType) and (scale is not None or not isinstance(kind, T.DoubleType))
        if not plain or f.start < pos:                         # fields that overlap are written one after the other
            flush()
        if f.start > pos and not (plain and numbers):
            pieces.append(F.lit(" " * (f.start - pos)))
        if plain:
            number = value if scale is None else F.rint(value * F.lit(10.0 ** scale))
            numbers.append((f, number.cast("bigint")))
        else:
            pieces.append(encode_field(layout, f, value))
        pos = f.end + 1
    flush()
    return F.concat(*pieces) if len(pieces) > 1 else pieces[0]


def encode_records(df: DataFrame, layout: Layout, values: dict[str, Column]) -> DataFrame:
    """``encode_fwf``, by the way that suits the number of fields."""
    if len(layout.fields) <= WIDE:
        return encode_fwf(df, layout, values)
    from tabulare.session import ship_package

    ship_package()                             # tasks run this module
    return df.select(encode_line_wide(layout, values).alias("value"))


def parse_records(df: DataFrame, layout: Layout, **kw) -> DataFrame:
    """``parse_fwf``, by the way that suits the number of fields."""
    return (parse_fwf_wide if len(layout.fields) > WIDE else parse_fwf)(df, layout, **kw)
