"""tabulare — weighted survey analytics on Spark DataFrames.

Subpackages:
  sources    fixed-width, archive, listing-JSON and Parquet inputs; ingest jobs
  functions  Column-level helpers (code labels, text, numeric rules)
  operators  weighted estimates, household grain, bands, harmonization, quality
  sinks      Parquet / table storage with idempotent and replace-by-source writes
  plans      the registered queries over the driver tables, and their SQL oracles
  streaming  incremental (file-stream) ingest of fixed-width drops

The names below are the everyday API; everything else is one import deeper.
"""

__version__ = "0.1.0"

from tabulare.operators.bands import affordability, band, band_distribution, cumulative_pct
from tabulare.operators.filters import filter_source, filter_states
from tabulare.operators.harmonize import census_to_morador, harmonize, pnadc_to_morador
from tabulare.operators.household import (
    collapse, count_distinct_households, first_row, grain_totals, household_key, weight_consistency,
)
from tabulare.operators.portrait import household_portrait
from tabulare.operators.quality import benchmark_deviation, encoding_check, null_profile
from tabulare.operators.weighted import (
    filtered_ratio, flag_shares, share_true, top_categories, weighted_distribution,
    weighted_distributions, weighted_modes, weighted_total,
)
from tabulare.params import HousingParams, ListingParams
from tabulare.schemas import IMOVEL, MORADOR, conform
from tabulare.session import build_session
from tabulare.sources.fwf import parse_fwf, read_fwf
from tabulare.sources.layout import Layout, read_layout_csv
from tabulare.sources.listings import parse_listings, read_listing_pages
from tabulare.sources.surveys import ingest_census, ingest_census_archives, ingest_listings, ingest_pnadc, load_morador

__all__ = [
    "affordability", "band", "band_distribution", "cumulative_pct", "filter_source", "filter_states",
    "census_to_morador", "harmonize", "pnadc_to_morador", "collapse", "count_distinct_households",
    "first_row", "grain_totals", "household_key", "weight_consistency", "household_portrait",
    "benchmark_deviation",
    "encoding_check", "null_profile", "filtered_ratio", "flag_shares", "share_true", "top_categories",
    "weighted_distribution", "weighted_distributions", "weighted_modes", "weighted_total",
    "HousingParams", "ListingParams", "IMOVEL", "MORADOR", "conform", "build_session", "parse_fwf",
    "read_fwf", "Layout", "read_layout_csv", "parse_listings", "read_listing_pages", "ingest_census",
    "ingest_census_archives", "ingest_listings", "ingest_pnadc", "load_morador",
]
