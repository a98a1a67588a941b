"""Fixed-width records (S1–S3, P2–P5) as one ``select`` over ``read.text``.

Latin-1 bytes are decoded before any ``substring`` so offsets are in
characters; blanks become NULL; each field is cast by the layout's type rule;
implied decimals are scaled. Every field expression is a plain Column, so a
query that uses 2 of 244 fields only computes those 2 substrings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulare.sources.layout import Field, Layout

LATIN1 = "ISO-8859-1"


def decoded_line(line: Column, encoding: str | None = LATIN1) -> Column:
    """S3: bytes of the line read back as ``encoding`` (None = already UTF-8)."""
    if encoding is None:
        return line
    return F.decode(line.cast("binary"), encoding)


def field_column(layout: Layout, f: Field, text: Column, strict: bool = True) -> Column:
    raw = F.substring(text, f.start, f.width)
    val = F.nullif(F.trim(raw), F.lit(""))                     # P4
    t = layout.spark_type(f)
    if isinstance(t, T.StringType):
        return val
    cast = (lambda c, to: c.cast(to)) if strict else (lambda c, to: c.try_cast(to))  # P2 / P5
    scale = layout.scale(f)
    if scale is not None:                                         # P3
        return cast(val, T.DoubleType()) / F.lit(10.0 ** scale)
    return cast(val, t)


def parse_fwf(df: DataFrame, layout: Layout, line_col: str = "value",
              encoding: str | None = LATIN1, mapped: bool = True, strict: bool = True,
              fields: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Parse one fixed-width line per row into typed columns.

    ``mapped`` names columns by the layout (P1) instead of variable codes;
    ``strict=False`` turns bad numbers into NULL instead of failing (P5);
    ``fields`` restricts to some variables; ``keep`` carries other columns.
    """
    text = decoded_line(F.col(line_col), encoding)
    chosen = [f for f in layout.fields if fields is None or f.variable in set(fields)]
    cols = [field_column(layout, f, text, strict).alias(layout.name(f) if mapped else f.variable)
            for f in chosen]
    return df.select(*[F.col(k) for k in keep], *cols)


def read_fwf(spark: SparkSession, paths: str | Sequence[str], layout: Layout,
             encoding: str | None = LATIN1, with_path: bool = False, **kw) -> DataFrame:
    """Every line of every input file; several parts are simply more paths."""
    df = spark.read.text(paths if isinstance(paths, str) else list(paths))
    keep = list(kw.pop("keep", ()))
    if with_path:
        df = df.select("value", F.col("_metadata.file_path").alias("arquivo"))
        keep.append("arquivo")
    return parse_fwf(df, layout, encoding=encoding, keep=keep, **kw)


# ---------------------------------------------------------------------------
# Writing fixed-width lines (used to build stand-in inputs and round trips)
# ---------------------------------------------------------------------------
def _zero_pad(text: Column, negative: Column, width: int, name: str) -> Column:
    """Right-aligned, zero-filled, sign first (what ``%0Nd`` prints).

    A number too wide for its field fails the job (``lpad`` would silently
    cut it)."""
    room = F.when(negative, F.lit(width - 1)).otherwise(F.lit(width))
    padded = F.when(negative, F.concat(F.lit("-"), F.lpad(text, width - 1, "0"))).otherwise(
        F.lpad(text, width, "0"))
    return F.when(F.length(text) > room,
                  F.raise_error(F.lit(f"value too wide for fixed-width field {name}")).cast("string")
                  ).otherwise(padded)


def encode_field(layout: Layout, f: Field, value: Column) -> Column:
    """Inverse of ``field_column``: right-aligned zero-padded numbers, left-
    aligned text, implied or explicit decimals, NULL → blanks.

    Built from ``lpad``/casts rather than ``format_string``: same text, no
    per-value ``java.util.Formatter``.
    """
    t = layout.spark_type(f)
    w = f.width
    if isinstance(t, T.StringType):
        txt = F.rpad(value.cast("string"), w, " ")
    elif layout.scale(f) is not None:
        digits = F.rint(value * F.lit(10.0 ** layout.scale(f))).cast("bigint")
        txt = _zero_pad(F.abs(digits).cast("string"), digits < 0, w, f.variable)
    elif isinstance(t, T.DoubleType):
        d = f.decimals if f.decimals is not None else 0
        dec = value.cast("double").cast(T.DecimalType(38, d))          # HALF_UP, like %f
        txt = _zero_pad(F.abs(dec).cast("string"), dec < 0, w, f.variable)
    else:
        n = value.cast("bigint")
        txt = _zero_pad(F.abs(n).cast("string"), n < 0, w, f.variable)
    return F.when(value.isNull(), F.lit(" " * w)).otherwise(txt)


def encode_line(layout: Layout, values: dict[str, Column]) -> Column:
    """The fixed-width line as one Column; gaps between sparse fields are spaces.

    ``values`` maps layout variables to the Column holding their value.
    """
    pieces: list[Column] = []
    pos = 1
    for f in sorted(layout.fields, key=lambda x: x.start):
        if f.start > pos:
            pieces.append(F.lit(" " * (f.start - pos)))
        pieces.append(encode_field(layout, f, values[f.variable]))
        pos = f.end + 1
    return F.concat(*pieces)


def encode_fwf(df: DataFrame, layout: Layout, values: dict[str, Column]) -> DataFrame:
    """One ``value`` line per row of ``df``."""
    return df.select(encode_line(layout, values).alias("value"))
