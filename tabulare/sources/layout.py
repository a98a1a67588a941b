"""Layout tables.

A layout row is ``variable, description, start, end, length, decimals, type``
with 1-based inclusive positions. The field width comes from start/end: the
``length`` column counts integer digits only when decimals exist.

Two type rules exist:

* ``census``: decimals present → double (value scaled by 10^-decimals);
  else by length ≤2 byte, ≤4 short, ≤9 int, longer long. The type letter is
  ignored.
* ``pnadc``: ``UF`` stays text (looked up to an abbreviation); numeric
  (``N``) fields of length ≥8 → double with an explicit decimal point; else
  ≤2 byte, ≤4 short, longer int.
"""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass
from functools import cached_property
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabulare.functions.text import slug_py

LAYOUT_SCHEMA = T.StructType([
    T.StructField(n, T.StringType(), True)
    for n in ("variable", "description", "start", "end", "length", "decimals", "type")
])


@dataclass(frozen=True)
class Field:
    variable: str
    description: str | None
    start: int
    end: int
    length: int
    decimals: int | None
    type: str

    @property
    def width(self) -> int:
        return self.end - self.start + 1


def _blank(x) -> bool:
    return x is None or str(x).strip() == ""


@dataclass(frozen=True)
class Layout:
    fields: tuple[Field, ...]
    rule: str = "census"  # or "pnadc"
    # variables kept as text (the survey files only have the PNADC ``UF``;
    # stand-in layouts mark theirs with type letter ``T``)
    text: frozenset = frozenset()

    @staticmethod
    def from_rows(rows, rule: str = "census") -> "Layout":
        out = []
        for r in rows:
            get = r.get if isinstance(r, dict) else (lambda k, _r=r: _r[k])
            dec = get("decimals")
            out.append(Field(
                variable=str(get("variable")).strip(),
                description=None if _blank(get("description")) else str(get("description")),
                start=int(float(get("start"))), end=int(float(get("end"))),
                length=int(float(get("length"))),
                decimals=None if _blank(dec) else int(float(dec)),
                type=("" if _blank(get("type")) else str(get("type")).strip().upper()),
            ))
        return Layout(tuple(out), rule, frozenset(f.variable for f in out if f.type == "T"))

    # -- S4: type rules ----------------------------------------------------
    def spark_type(self, f: Field) -> T.DataType:
        if f.variable in self.text:
            return T.StringType()
        if self.rule == "pnadc":
            if f.variable == "UF":
                return T.StringType()
            if f.type == "N" and f.length >= 8:
                return T.DoubleType()
            if f.length <= 2:
                return T.ByteType()
            if f.length <= 4:
                return T.ShortType()
            return T.IntegerType()
        if f.decimals is not None:
            return T.DoubleType()
        if f.length <= 2:
            return T.ByteType()
        if f.length <= 4:
            return T.ShortType()
        if f.length <= 9:
            return T.IntegerType()
        return T.LongType()

    def scale(self, f: Field) -> int | None:
        """Implied decimals (census only); PNADC writes the point explicitly."""
        return f.decimals if self.rule == "census" else None

    # -- P1: readable names -------------------------------------------------
    def _base_name(self, f: Field) -> str:
        if self.rule == "pnadc" and f.variable == "UF":
            return "uf"
        s = slug_py(f.description, heading=(self.rule == "census"))
        return s or f.variable.lower()

    def names(self) -> dict[str, str]:
        """Variable → column name. A name already taken by an earlier field gets
        the variable code appended, so a parsed frame never has two equal columns."""
        return dict(self._names)

    @cached_property
    def _names(self) -> dict[str, str]:
        out: dict[str, str] = {}
        seen: set[str] = set()
        for f in self.fields:
            n = self._base_name(f)
            if n in seen:
                n = f"{n}_{f.variable.lower()}"
            seen.add(n)
            out[f.variable] = n
        return out

    def name(self, f: Field) -> str:
        return self._names[f.variable]

    def schema(self, mapped: bool = True) -> T.StructType:
        return T.StructType([
            T.StructField(self.name(f) if mapped else f.variable, self.spark_type(f), True)
            for f in self.fields
        ])

    def record_width(self) -> int:
        return max(f.end for f in self.fields)


def packaged_layout(name: str, rule: str = "census") -> Layout:
    """A layout CSV shipped with the package (driver-side metadata)."""
    text = resources.files("tabulare.sources.layouts").joinpath(f"{name}.csv").read_text("utf-8")
    return Layout.from_rows(list(csv.DictReader(io.StringIO(text))), rule)


def read_layout_csv(spark: SparkSession, path: str) -> DataFrame:
    """A layout CSV on shared storage, every column read as text."""
    return spark.read.csv(path, header=True, schema=LAYOUT_SCHEMA, encoding="UTF-8")


def layout_from_df(df: DataFrame, rule: str = "census") -> Layout:
    """Layouts are bounded metadata (one row per field), safe to bring to the driver."""
    return Layout.from_rows([r.asDict() for r in df.collect()], rule)
