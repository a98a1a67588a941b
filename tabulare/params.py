"""Job parameters and their domain checks.

Checked on the driver before any Spark work, so a bad argument fails fast
with ``ValueError`` instead of producing an empty or partial result.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from tabulare.functions.codes import NEGOCIO, UFS

# The sources a harmonized load knows, and the deal types.
SOURCES = ("census_2010", "pnadc")
DEALS = tuple(NEGOCIO.values())


def check_ufs(ufs: Iterable[str] | None) -> tuple[str, ...] | None:
    """None or empty = every state; otherwise each must be a known abbreviation."""
    if not ufs:
        return None
    out = tuple(str(u).upper() for u in ufs)
    unknown = sorted(set(out) - set(UFS))
    if unknown:
        raise ValueError(f"unknown state(s): {', '.join(unknown)}")
    return out


@dataclass(frozen=True)
class HousingParams:
    """What to ingest: which source, which states, which PNADC year."""
    source: str
    ufs: tuple[str, ...] | None = None
    pnadc_year: int = 2025

    def __post_init__(self):
        if self.source not in SOURCES:
            raise ValueError(f"source must be one of {SOURCES}, got {self.source!r}")
        object.__setattr__(self, "ufs", check_ufs(self.ufs))
        if not isinstance(self.pnadc_year, int) or self.pnadc_year < 2012:
            raise ValueError(f"invalid PNADC year {self.pnadc_year!r}")


@dataclass(frozen=True)
class ListingParams:
    """Which listings to keep: states and deal type (None = all)."""
    ufs: tuple[str, ...] | None = None
    negocio: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "ufs", check_ufs(self.ufs))
        if self.negocio is not None and self.negocio not in DEALS:
            raise ValueError(f"negocio must be one of {DEALS}, got {self.negocio!r}")
