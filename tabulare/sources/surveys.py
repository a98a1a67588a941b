"""End-to-end ingest jobs (per-source collection minus the network).

Each is one Spark job per file type over all its states at once: read the
text of the states in scope → parse every field with its final name → write
Parquet partitioned by state. The unit of work is (state, file type): a state
that is stored is skipped (K4) unless ``overwrite=True``, and no call touches
the states out of its scope.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulare.functions.codes import UF_CODES
from tabulare.operators.filters import filter_in, filter_states, with_known_state
from tabulare.operators.harmonize import census_to_morador, harmonize, lookup_state, pnadc_to_morador, uf_dimension
from tabulare.params import HousingParams, ListingParams
from tabulare.schemas import IMOVEL, MORADOR
from tabulare.sinks.store import recover, replace_source, write_partitioned, write_states
from tabulare.session import delete_path
from tabulare.sources.fwf import LATIN1
from tabulare.sources.layout import Layout
from tabulare.sources.listings import listings_to_imovel, parse_listings, read_listing_pages
from tabulare.sources.wide import parse_records

# census files sit in one folder per state: .../<UF>/Amostra_Pessoas_12.txt
STATE_DIR = r"/([A-Z]{2})/[^/]+$"
# Census sample file types and their file-name prefixes.
CENSUS_FILE_TYPES = {
    "domicilios": "Amostra_Domicilios",
    "pessoas": "Amostra_Pessoas",
    "emigracao": "Amostra_Emigracao",
    "mortalidade": "Amostra_Mortalidade",
}
# a state's archive is named by its abbreviation, big states in parts (SP1, SP2_RM)
ARCHIVE_STATE = r"/([A-Z]{2})[^/]*\.zip$"


def census_files(root: str) -> dict[str, str]:
    """Globs of every state's text files per file type, for ``ingest_census``."""
    return {t: f"{root.rstrip('/')}/*/{prefix}*.txt" for t, prefix in CENSUS_FILE_TYPES.items()}


def ingest_census(spark: SparkSession, files: Mapping[str, str | Sequence[str]],
                  layouts: Mapping[str, Layout], out_root: str, params: HousingParams | None = None,
                  overwrite: bool = False) -> dict[str, str]:
    """Census sample: ``files[file_type]`` are text paths/globs over all states
    (several archive parts are just more files); the state comes from the
    folder name. Returns ``{file_type: output path}``.
    """
    out: dict[str, str] = {}
    ufs = params.ufs if params else None
    for file_type, paths in files.items():
        lines = spark.read.text(paths if isinstance(paths, str) else list(paths))
        lines = lines.withColumn("uf", F.regexp_extract(F.col("_metadata.file_path"), STATE_DIR, 1))
        lines = filter_states(lines, ufs)                     # pruned before parsing
        parsed = parse_records(lines, layouts[file_type], encoding=LATIN1, keep=["uf"])
        path = f"{out_root.rstrip('/')}/{file_type}"
        write_states(parsed, path, ufs, overwrite=overwrite)
        out[file_type] = path
    return out


def ingest_census_archives(spark: SparkSession, archives: str | Sequence[str],
                           layouts: Mapping[str, Layout], out_root: str, staging: str,
                           params: HousingParams | None = None, overwrite: bool = False,
                           broken: str = "fail") -> dict[str, str]:
    """Census sample straight from the state archives (S8 + S1, one pass over the ZIPs).

    Only the archives of the states in scope are opened (by file name). Every
    ``.txt`` member is unpacked once into ``staging`` (Parquet partitioned by
    state and file type, on shared storage: it also cuts the lineage, so a
    lost executor never re-reads archives; deleted when the call ends); then each
    file type is parsed from its own partition with its layout. Members whose name has no known prefix
    are ignored; archive parts of one state are appended. ``broken`` as in
    ``archive_lines``; rejects are not stored here, list them with it.
    """
    from tabulare.sources.archive import archive_lines

    ufs = params.ufs if params else None
    names = "{" + ",".join(ufs) + "}*.zip" if ufs else None
    lines = archive_lines(spark, archives, broken, names).where("erro IS NULL")
    prefix = F.regexp_extract("membro", r"([^/]+)$", 1)
    file_type = None
    for t, p in CENSUS_FILE_TYPES.items():
        cond = prefix.startswith(p)
        file_type = F.when(cond, F.lit(t)) if file_type is None else file_type.when(cond, F.lit(t))
    staged = (lines.select(F.regexp_extract("arquivo", ARCHIVE_STATE, 1).alias("uf"),
                           file_type.alias("file_type"), "value")
              .where(F.col("file_type").isNotNull()))
    staged = filter_states(staged, ufs)
    own = f"{staging.rstrip('/')}/{uuid.uuid4().hex}"             # this call's own unpacked lines
    out: dict[str, str] = {}
    try:
        write_partitioned(staged, own, by=("file_type", "uf"))
        stored = spark.read.schema("value string, file_type string, uf string").parquet(own)
        for t, layout in layouts.items():
            part = stored.where(F.col("file_type") == t)          # partition pruning
            parsed = parse_records(part, layout, encoding=None, keep=["uf"])
            path = f"{out_root.rstrip('/')}/{t}"
            write_states(parsed, path, ufs, overwrite=overwrite)
            out[t] = path
    finally:
        delete_path(spark, own)
    return out


def pnadc_archive_lines(spark: SparkSession, archives: str | Sequence[str]) -> DataFrame:
    """The PNADC's text straight from its archive(s); an archive without a text member is an error.

    That is seen in the archives' directories; the text itself is read once.
    """
    from tabulare.sources.archive import archive_lines, archives_without_text

    empty = archives_without_text(spark, archives)
    if empty:
        raise ValueError(f"no text member in {empty[0]}")
    return archive_lines(spark, archives).select("value")


def ingest_pnadc(spark: SparkSession, paths: str | Sequence[str], layout: Layout, out_root: str,
                 params: HousingParams | None = None, overwrite: bool = False) -> str:
    """PNADC visit 1: one national file, text or ZIP (by name); the state number
    is looked up to its abbreviation (unknown numbers are dropped) and the
    output is split by state. Unlike the reference, ``params.ufs`` is applied.
    """
    each = [paths] if isinstance(paths, str) else list(paths)
    if all(p.lower().endswith(".zip") for p in each):
        lines, encoding = pnadc_archive_lines(spark, each), None
    else:
        lines, encoding = spark.read.text(each), LATIN1
    parsed = parse_records(lines, layout, encoding=encoding)
    coded = parsed.withColumn("_uf_num", F.col("uf").try_cast("int")).drop("uf")
    with_uf = lookup_state(coded, "_uf_num", uf_dimension(spark)).drop("_uf_num")
    path = f"{out_root.rstrip('/')}/pnadc_{params.pnadc_year if params else 2025}"
    write_states(with_uf, path, params.ufs if params else None, overwrite=overwrite)
    return path


def ingest_listings(spark: SparkSession, pages_path: str, out_root: str,
                    params: ListingParams | None = None, malformed: str = "fail") -> DataFrame:
    """Listing pages → ``imovel`` rows split by state; listings without a state
    are dropped. Unlike the reference, ``params.ufs`` and ``params.negocio``
    are applied. The states of this load are rewritten, all others stay.
    Returns the rows stored per state of this load. ``malformed`` as in
    ``read_listing_pages``.
    """
    flat = parse_listings(read_listing_pages(spark, pages_path, malformed))
    flat = with_known_state(flat)
    ufs = params.ufs if params is not None else None
    if params is not None:
        flat = filter_in(flat, "negocio", [params.negocio] if params.negocio else None)
    path = f"{out_root.rstrip('/')}/imovel"
    states = write_states(listings_to_imovel(flat), path, ufs, overwrite=True)
    stored = spark.read.schema(IMOVEL).parquet(path)
    return stored.where(F.col("uf").isin(states)).groupBy("uf").agg(F.count(F.lit(1)).alias("n_linhas"))


def load_morador(root: str, *, persons: DataFrame | None = None, households: DataFrame | None = None,
                 pnadc: DataFrame | None = None, pnadc_year: int = 2025) -> DataFrame:
    """The ``morador`` load as one call: harmonize each given source, replace
    its rows under ``root`` (K10) and count what is stored per source.

    ``persons`` and ``households`` are the stored census files (with ``uf``),
    ``pnadc`` the stored PNADC; a source that is not given stays as it is.
    """
    loads = {}
    if persons is not None and households is not None:
        loads["census_2010"] = census_to_morador(persons, households)
    if pnadc is not None:
        loads[f"pnadc_{pnadc_year}"] = pnadc_to_morador(pnadc, pnadc_year)
    if not loads:
        raise ValueError("no source to load")
    for source, rows in loads.items():
        replace_source(harmonize(rows, full_schema=True), root, source)
    spark = next(iter(loads.values())).sparkSession
    recover(spark, root)                    # a source that an earlier, interrupted call left half swapped
    stored = spark.read.schema(MORADOR).parquet(root)
    return stored.groupBy("fonte").agg(F.count(F.lit(1)).alias("n_linhas"))


__all__ = ["ingest_census", "ingest_census_archives", "ingest_pnadc", "ingest_listings", "load_morador", "census_files",
           "pnadc_archive_lines", "CENSUS_FILE_TYPES", "UF_CODES"]
