"""Ingest queries: fixed-width files, archives, listing JSON, text helpers.

Each builds its input file(s) from a driver table with Spark (below the
shared scratch folder), then runs the library's reader on them and returns
what it parsed, so the oracle can compute the same values from the table.
"""

from __future__ import annotations

import csv
import io
import zipfile
from importlib import resources

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from tabulare.functions.text import parse_int_strict, slug, slug_heading
from tabulare.plans.registry import register
from tabulare.plans.standins import table, table_path
from tabulare.session import derived_input, files_key, local_fs_path, scratch_path
from tabulare.sinks import store
from tabulare.sources import archive, listings
from tabulare.sources.fwf import LATIN1, encode_fwf, encode_line, parse_fwf, read_fwf
from tabulare.sources.wide import encode_records, parse_records
from tabulare.schemas import IMOVEL
from tabulare.sources.catalog import split_stem
from tabulare.sources.layout import Layout, packaged_layout, read_layout_csv

# Bump when the way a derived input is built changes, so cached copies are not reused.
DERIVED_VERSION = "7"

# ---------------------------------------------------------------- S1, P2, P4, P3
LINEITEM = packaged_layout("lineitem_census", "census")


def _lineitem_lines(spark, d) -> str:
    """``lineitem`` as census-style fixed-width text (built once per table version)."""
    def build(path):
        li = table(spark, d, "lineitem")
        c = F.col
        values = {"L0001": c("l_orderkey"), "L0002": c("l_partkey"), "L0003": c("l_suppkey"),
                  "L0004": c("l_linenumber"), "L0005": c("l_quantity"), "L0006": c("l_extendedprice"),
                  "L0007": c("l_discount"), "L0008": c("l_tax"), "L0009": F.year("l_shipdate")}
        encode_fwf(li, LINEITEM, values).write.mode("overwrite").text(path)
    return derived_input(spark, "fwf-lineitem", [table_path(d, "lineitem")], build,
                         version=DERIVED_VERSION)


register("fwf_scan",
         "SELECT CAST(l_orderkey AS BIGINT) AS chave_do_pedido, CAST(l_partkey AS BIGINT) AS chave_da_peca, "
         "CAST(l_suppkey AS BIGINT) AS chave_do_fornecedor, CAST(l_linenumber AS TINYINT) AS numero_da_linha, "
         "CAST(l_quantity AS TINYINT) AS quantidade_pedida, CAST(year(l_shipdate) AS SMALLINT) AS l0009 "
         "FROM lineitem")(
    lambda spark, d: read_fwf(spark, _lineitem_lines(spark, d), LINEITEM,
                              fields=["L0001", "L0002", "L0003", "L0004", "L0005", "L0009"]))

register("decimal_scaling",
         "SELECT CAST(l_orderkey AS BIGINT) AS chave_do_pedido, CAST(l_linenumber AS TINYINT) AS numero_da_linha, "
         "CAST(ROUND(l_extendedprice * 100) AS DOUBLE) / 100 AS preco_estendido_em_reais, "
         "CAST(ROUND(l_discount * 100) AS DOUBLE) / 100 AS desconto_concedido, "
         "CAST(ROUND(l_tax * 100) AS DOUBLE) / 100 AS imposto FROM lineitem")(
    lambda spark, d: read_fwf(spark, _lineitem_lines(spark, d), LINEITEM,
                              fields=["L0001", "L0004", "L0006", "L0007", "L0008"]))

# ---------------------------------------------------------------- S1, S4, P1, P2 at the published width
_WIDE_KINDS = ((2, "", "CAST((o_orderkey + {i}) % 100 AS TINYINT)"),
               (1, "", "CASE WHEN (o_orderkey + {i}) % 11 > 0 THEN CAST((o_custkey * {i}) % 10 AS TINYINT) END"),
               (8, "2", "CAST((o_orderkey * 7 + {i} * 13) % 100000000 AS DOUBLE) / 100"),
               (4, "", "CAST((o_custkey + {i} * 37) % 10000 AS SMALLINT)"))


def _wide_layout() -> tuple[Layout, dict[str, str]]:
    """244 fields over the columns of ``orders``, and each field's value as SQL."""
    rows, values, at = [], {}, 1
    for i in range(244):
        width, decimals, value = _WIDE_KINDS[i % len(_WIDE_KINDS)]
        code = f"W{i:04d}"
        rows.append({"variable": code, "description": f"CAMPO {i}", "start": at, "end": at + width - 1, "length": width,
                     "decimals": decimals, "type": "N"})
        values[code] = value.format(i=i)
        at += width
    return Layout.from_rows(rows), values


WIDE, _WIDE_VALUES = _wide_layout()


_WIDE_TASK_BYTES = 4 << 20   # of the table, whose rows are some fifty times as long when written
_WIDE_LINES_PER_FILE = 150_000   # 137 MB of lines: a compressed file is read by one task


def _fwf_wide(spark, d):
    def build(path):
        size = sum(f[1] for f in files_key(spark, table_path(d, "orders")))
        tasks = max(spark.sparkContext.defaultParallelism, -(-size // _WIDE_TASK_BYTES))
        # two columns are moved, so that tasks do not depend on how the table is cut into row groups; near keys stay together
        orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").repartitionByRange(tasks, "o_orderkey", "o_custkey")
        (encode_records(orders, WIDE, {k: F.expr(v) for k, v in _WIDE_VALUES.items()})
         .write.option("compression", "snappy").option("maxRecordsPerFile", _WIDE_LINES_PER_FILE).text(path))
    path = derived_input(spark, "fwf-wide", [table_path(d, "orders")], build, version=DERIVED_VERSION)
    return parse_records(spark.read.text(path), WIDE)


register("fwf_scan_wide",
         "SELECT " + ", ".join(f"{v} AS campo_{i}" for i, v in enumerate(_WIDE_VALUES.values())) + " FROM orders")(_fwf_wide)

# ---------------------------------------------------------------- S2 (sparse, explicit point)
ORDERS = packaged_layout("orders_pnadc", "pnadc")
_ORDERS_VALUES = {
    "Ano": "year(o_orderdate)", "CTRL": "o_orderkey",
    "V1022": "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END",
    "PRIO": "CAST(substr(o_orderpriority, 1, 1) AS INT)", "V1032": "o_totalprice", "CLI": "o_custkey",
}
_ORDERS_ORACLE = (
    "SELECT CAST(year(o_orderdate) AS SMALLINT) AS ano_de_referencia, "
    "CAST(o_orderkey AS DOUBLE) AS numero_de_controle_do_domicilio, "
    "CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS TINYINT) AS tipo_de_situacao_da_regiao, "
    "CAST(substr(o_orderpriority, 1, 1) AS TINYINT) AS prioridade_do_pedido, "
    "o_totalprice AS peso_com_calibracao, CAST(o_custkey AS DOUBLE) AS codigo_do_cliente FROM orders")


def _encoded_value():
    """An ``orders`` row as a PNADC-style fixed-width line."""
    return encode_line(ORDERS, {k: F.expr(v) for k, v in _ORDERS_VALUES.items()}).alias("value")


def _fwf_sparse(spark, d):
    def build(path):
        table(spark, d, "orders").select(_encoded_value()).write.mode("overwrite").text(path)
    path = derived_input(spark, "fwf-orders", [table_path(d, "orders")], build, version=DERIVED_VERSION)
    return read_fwf(spark, path, ORDERS)


register("fwf_scan_sparse", _ORDERS_ORACLE)(_fwf_sparse)

# ---------------------------------------------------------------- A17, A18, A20, A21: the profile of an ingest, from its writing job
_PROFILED = ("ano_de_referencia", "tipo_de_situacao_da_regiao", "prioridade_do_pedido", "peso_com_calibracao")
_PRIORITIES = (1, 2, 3, 4, 5)


def _ingest_profile(spark, d):
    parsed = _fwf_sparse(spark, d).select(*_PROFILED)
    return store.write_profiled(parsed, scratch_path(spark, "profiled"), "prioridade_do_pedido", _PRIORITIES)


register("ingest_profile",
         f"WITH o AS ({_ORDERS_ORACLE}) SELECT * FROM ("
         + " UNION ALL ".join(f"SELECT 'coluna' AS medida, '{c}' AS nome, COUNT(*) AS n_linhas, COUNT(*) - COUNT({c}) AS n_nulos, "
                              "CAST(0 AS BIGINT) AS n_nao_ascii FROM o" for c in _PROFILED)
         + " UNION ALL SELECT 'prioridade_do_pedido', CAST(prioridade_do_pedido AS VARCHAR), COUNT(*), NULL, NULL FROM o "
           "GROUP BY prioridade_do_pedido) t")(lambda spark, d: _ingest_profile(spark, d))

# ---------------------------------------------------------------- S3 (Latin-1)
WORDS = packaged_layout("document_words", "census")
_SPLIT = r"[ \t\n\r\f]+"
_PIECE = 40
_LINES_PER_FILE = 500_000   # 33 MB of lines: a compressed file is read by one task


def _document_words(spark, d):
    path = derived_input(spark, "fwf-latin1", [table_path(d, "documents")],
                         lambda p: _write_document_words(spark, d, p), version=DERIVED_VERSION)
    parsed = read_fwf(spark, path, WORDS, encoding=LATIN1)
    return parsed.groupBy(F.col("identificador_do_documento")).agg(
        F.count(F.when(F.col("pedaco_da_palavra") == 0, 1)).alias("n_palavras"),
        F.count(F.lit(1)).alias("n_pedacos"),
        F.sum(F.length("palavra_texto_latin_1")).alias("n_caracteres"),
        F.count(F.when(F.col("palavra_texto_latin_1").rlike(r"[^\x00-\x7F]"), 1)).alias("n_pedacos_nao_ascii"))


def _write_document_words(spark, d, path):
    """Every word of every document as a Latin-1 fixed-width record (long words in pieces).

    A code point Latin-1 lacks is written as one "?" (the charset encoder's
    replacement), so widths in characters are kept. A record is ten times as
    long as its word, mostly blanks and zeros: the files are compressed.
    """
    docs = table(spark, d, "documents")
    words = (docs.select("doc_id", F.posexplode(F.split("text", _SPLIT)).alias("pos", "w"))
             .where(F.col("w") != ""))
    pieces = words.select("doc_id", "pos", "w", F.explode(F.sequence(
        F.lit(0), F.floor((F.length("w") - 1) / _PIECE).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "pos", "piece",
                           F.expr(f"substring(w, piece * {_PIECE} + 1, {_PIECE})").alias("s"))
    lines = encode_fwf(pieces, WORDS, {"D001": F.col("doc_id"), "D002": F.col("pos"),
                                       "D003": F.col("piece"), "D004": F.col("s")})
    # text sink is UTF-8 only; the CSV sink writes any charset (unquoted, one column)
    (lines.write.mode("overwrite").option("encoding", LATIN1).option("quote", "").option("sep", "\u0001")
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
     .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", _LINES_PER_FILE)
     .option("header", "false").csv(path))


register("fwf_latin1",
         "WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+')) AS w FROM documents), "
         f"p AS (SELECT doc_id, w, unnest(range(0, (length(w) - 1) // {_PIECE} + 1)) AS piece FROM w WHERE w <> ''), "
         # the Latin-1 file holds "?" for every code point Latin-1 lacks
         f"q AS (SELECT doc_id, piece, regexp_replace(substr(w, piece * {_PIECE} + 1, {_PIECE}), "
         "'[^\\x{00}-\\x{FF}]', '?', 'g') AS s FROM p) "
         "SELECT doc_id AS identificador_do_documento, COUNT(*) FILTER (WHERE piece = 0) AS n_palavras, "
         "COUNT(*) AS n_pedacos, CAST(SUM(length(s)) AS BIGINT) AS n_caracteres, "
         "COUNT(*) FILTER (WHERE regexp_matches(s, '[^\\x00-\\x7F]')) AS n_pedacos_nao_ascii "
         "FROM q GROUP BY doc_id")(_document_words)

# ---------------------------------------------------------------- P1, S4
PART_CODES = packaged_layout("part_codes", "census")
_PART_BY_CODE = {"P0001": "p_partkey", "P0002": "p_name", "P0003": "p_brand", "P0004": "p_type",
                 "P0005": "p_size", "P0006": "p_retailprice"}
register("layout_rename",
         "SELECT " + ", ".join(f"{src} AS {PART_CODES.names()[code]}" for code, src in _PART_BY_CODE.items())
         + " FROM part")(
    lambda spark, d: table(spark, d, "part").select(
        *[F.col(src).alias(code) for code, src in _PART_BY_CODE.items()]).withColumnsRenamed(PART_CODES.names()))

# ---------------------------------------------------------------- S8, S9, U3
def _filesystem(path: str):
    """A pyarrow filesystem for a local, HDFS, S3 or GCS path, usable inside tasks."""
    from pyarrow import fs

    local = local_fs_path(path)
    if local is not None:
        return fs.LocalFileSystem(), local
    return fs.FileSystem.from_uri(path)


def _write_archives(out_dir: str, cut: tuple = (), lines: int | None = None):
    """Task-side writer of the archive test inputs: one ZIP per (status, task),
    one member per batch or ``lines`` lines; those of a status in ``cut`` stop halfway, like an interrupted download.
    Archives are written under a name of the attempt and renamed when they are
    complete, so retried and speculative tasks do not race each other."""

    def fn(batches):
        filesystem, root = _filesystem(out_dir)
        ctx = TaskContext.get()
        pid, own = ctx.partitionId(), ctx.taskAttemptId()
        buffers: dict[str, io.BytesIO] = {}
        zips: dict[str, zipfile.ZipFile] = {}
        for n, pdf in enumerate(batches):
            for status, g in pdf.groupby("status"):
                if status not in zips:
                    buffers[status] = io.BytesIO()
                    zips[status] = zipfile.ZipFile(buffers[status], "w", zipfile.ZIP_DEFLATED)
                values = g["value"].tolist()
                for k, at in enumerate(range(0, len(values), lines or len(values))):
                    body = ("\r\n".join(values[at:at + (lines or len(values))]) + "\r\n").encode("latin-1")
                    zips[status].writestr(f"{status}_{pid:05d}_{n:04d}_{k:04d}.txt", body)
        out = []
        for status, zf in zips.items():
            zf.close()
            data = buffers[status].getvalue()
            if status in cut:
                data = data[: len(data) // 2]
            name = f"{root}/{status}_{pid:05d}.zip"
            with filesystem.open_output_stream(f"{root}/_{status}_{pid:05d}_{own}") as fh:
                fh.write(data)
            filesystem.move(f"{root}/_{status}_{pid:05d}_{own}", name)
            out.append((status, name))
        yield pd.DataFrame(out, columns=["status", "arquivo"])
    return fn


def _archives(spark, d, cut: tuple = (), lines: int | None = None) -> str:
    """Folder of ZIP archives of every order's line, by status."""
    def build(out_dir):
        filesystem, root = _filesystem(out_dir)
        filesystem.create_dir(root, recursive=True)
        (table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), _encoded_value())
         .mapInPandas(_write_archives(out_dir, cut, lines), "status string, arquivo string")
         .write.format("noop").mode("overwrite").save())
        with filesystem.open_output_stream(f"{root}/_SUCCESS"):
            pass
    return derived_input(spark, "zips" + "".join(cut) + (f"-{lines}" if lines else ""), [table_path(d, "orders")], build,
                         version=DERIVED_VERSION)


register("zip_ingest", _ORDERS_ORACLE)(
    lambda spark, d: parse_fwf(archive.archive_lines(spark, _archives(spark, d) + "/*.zip"), ORDERS,
                               encoding=None))

# many small members to an archive, several to a task
register("zip_members",
         "SELECT o_orderstatus AS status, o_orderkey AS chave, COUNT(*) OVER (PARTITION BY o_orderstatus) AS n_linhas, "
         "o_totalprice AS peso FROM orders")(
    lambda spark, d: _zip_members(spark, d))


def _zip_members(spark, d):
    """Every line of every member, with what its archives hold in all."""
    lines = archive.archive_lines(spark, _archives(spark, d, lines=500) + "/*.zip")
    parsed = parse_fwf(lines.withColumn("status", F.regexp_extract("membro", "^([A-Z])_", 1)), ORDERS, encoding=None, mapped=False,
                       fields=["CTRL", "V1032"], keep=["status"])
    counts = parsed.groupBy(F.col("status").alias("s")).agg(F.count(F.lit(1)).alias("n_linhas"))
    # a status is one letter: few rows, and the lines stay where they are
    return parsed.join(F.broadcast(counts), parsed["status"] == counts["s"]).select(
        "status", F.col("CTRL").cast("bigint").alias("chave"), "n_linhas", F.col("V1032").alias("peso"))


register("zip_validity",
         "SELECT DISTINCT o_orderstatus AS status, o_orderstatus <> 'P' AS valido FROM orders")(
    lambda spark, d: archive.archive_validity(spark, _archives(spark, d, ("P",)) + "/*.zip")
    .select(F.regexp_extract("arquivo", r"/([A-Z])_\d+\.zip$", 1).alias("status"), "valido")
    .groupBy("status").agg(F.bool_and("valido").alias("valido")))

# broken archives are rows of their own, the others are read in full
register("zip_rejects",
         "SELECT o_orderstatus AS status, o_orderstatus = 'P' AS rejeitado, "
         "CASE WHEN o_orderstatus = 'P' THEN 0 ELSE COUNT(*) END AS n_linhas FROM orders GROUP BY o_orderstatus")(
    lambda spark, d: archive.archive_lines(spark, _archives(spark, d, ("P",)) + "/*.zip", broken="reject")
    .groupBy(F.regexp_extract("arquivo", r"/([A-Z])_\d+\.zip$", 1).alias("status"))
    .agg(F.bool_or(F.col("erro").isNotNull()).alias("rejeitado"), F.count("value").alias("n_linhas")))

# ---------------------------------------------------------------- P5: numbers that are none
_TOLERANT = Layout.from_rows([
    {"variable": "T0001", "description": "CHAVE", "start": 1, "end": 9, "length": 9, "decimals": None, "type": "N"},
    {"variable": "T0002", "description": "TAMANHO", "start": 10, "end": 13, "length": 4, "decimals": None, "type": "N"},
])
register("tolerant_parse",
         "SELECT CAST(p_partkey AS INTEGER) AS chave, CASE WHEN p_size % 5 = 0 THEN NULL "
         "ELSE CAST(p_size AS SMALLINT) END AS tamanho FROM part")(
    lambda spark, d: parse_fwf(table(spark, d, "part").selectExpr(
        "concat(lpad(CAST(p_partkey AS STRING), 9, '0'), CASE WHEN p_size % 5 = 0 THEN ' x9 ' "
        "ELSE lpad(CAST(p_size AS STRING), 4, ' ') END) AS value"), _TOLERANT, encoding=None, strict=False))

# ---------------------------------------------------------------- S5: a layout CSV on shared storage
def _layout_csv(spark, d):
    rows = table(spark, d, "part").selectExpr(
        "concat('V', lpad(CAST(p_partkey AS STRING), 7, '0')) AS variable", "p_name AS description",
        "CAST(p_size AS STRING) AS start", "CAST(p_size + 3 AS STRING) AS end", "'4' AS length",
        "CASE WHEN p_size % 2 = 0 THEN '2' END AS decimals", "'N' AS type")
    path = derived_input(spark, "layout-csv", [table_path(d, "part")],
                         lambda p: rows.write.option("header", True).csv(p), version=DERIVED_VERSION)
    return read_layout_csv(spark, path).select("variable", "description", "start", "end", "length", "decimals", "type")


register("layout_csv_scan",
         "SELECT 'V' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS variable, p_name AS description, "
         "CAST(p_size AS VARCHAR) AS start, CAST(p_size + 3 AS VARCHAR) AS \"end\", '4' AS length, "
         "CASE WHEN p_size % 2 = 0 THEN '2' END AS decimals, 'N' AS type FROM part")(_layout_csv)

# ---------------------------------------------------------------- X10
def _stems(spark, d):
    uf, kind = split_stem("stem")
    return table(spark, d, "part").selectExpr(
        "CASE WHEN p_size % 4 = 0 THEN replace(p_brand, '#', '') ELSE concat(replace(p_brand, '#', ''), '_', p_type) END AS stem"
    ).select("stem", uf.alias("uf"), kind.alias("file_type"))


register("split_stem",
         "SELECT stem, CASE WHEN contains(stem, '_') THEN split_part(stem, '_', 1) END AS uf, "
         "CASE WHEN contains(stem, '_') THEN substr(stem, instr(stem, '_') + 1) END AS file_type FROM "
         "(SELECT CASE WHEN p_size % 4 = 0 THEN replace(p_brand, '#', '') "
         "ELSE replace(p_brand, '#', '') || '_' || p_type END AS stem FROM part) t")(_stems)

# ---------------------------------------------------------------- S10, P15-P18, X5-X9
_ITEM_SQL = {
    "deal": "CASE p_size % 4 WHEN 0 THEN 'Venda' WHEN 1 THEN 'Aluguel' WHEN 2 THEN 'Temporada' ELSE 'Permuta' END",
    "bedrooms": "CASE WHEN p_size % 5 = 0 THEN '3.0' ELSE CAST(p_size % 5 AS STRING) END",
    "total_area": "CASE WHEN p_size % 3 = 0 THEN concat(CAST(p_size AS STRING), ' m²') "
                  "ELSE replace(CAST(p_retailprice AS STRING), '.', ',') END",
    "covered_area": "CASE WHEN p_size % 4 = 3 THEN '5d' ELSE '1_000,5' END",
    "pool": "CASE p_size % 3 WHEN 0 THEN 'Sim' WHEN 1 THEN 'Não' ELSE '' END",
    "elevator": "CASE WHEN p_size % 2 = 0 THEN 'Yes' ELSE 'no' END",
    "state_id": "CASE WHEN p_size % 11 = 0 THEN NULL ELSE concat('BR-', substr(p_brand, 7, 2)) END",
    "price": "CASE WHEN p_size % 10 = 0 THEN 0.0 ELSE p_retailprice END",
}


def _listing_pages(spark, d, cut: int = 0):
    """Listing pages (≤ 50 items each) built from ``part``, as JSON text rows; one in ``cut`` pages stops halfway."""
    p = table(spark, d, "part")
    e = {k: F.expr(v) for k, v in _ITEM_SQL.items()}
    attr = lambda i, v: F.struct(F.lit(i).alias("id"), v.alias("value_name"))
    attrs = F.filter(F.array(
        attr("OPERATION_TYPE", e["deal"]), attr("BEDROOMS", e["bedrooms"]),
        F.when(F.col("p_size") % 6 == 0, attr("BEDROOMS", F.lit("9"))),      # duplicate: last wins
        attr("TOTAL_AREA", e["total_area"]), attr("COVERED_AREA", e["covered_area"]),
        attr("POOL", e["pool"]), attr("ELEVATOR", e["elevator"]),
        attr("PROPERTY_TYPE", F.col("p_type")), attr("COLOR", F.lit("azul")),  # unknown id
        attr("FLOOR", F.col("p_size").cast("string")), attr("SPORTS_COURT", F.lit("tenis, basquete")),
    ), lambda x: x.isNotNull())
    nested_place = lambda c: F.struct(c.alias("name"))
    address = F.when(F.col("p_size") % 7 != 0, F.struct(
        e["state_id"].alias("state_id"), F.col("p_brand").alias("city_name"),
        F.col("p_type").alias("neighborhood_name"),
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("zip_code")))
    location = F.when(F.col("p_size") % 7 == 0, F.struct(
        e["state_id"].alias("state_id"), nested_place(F.col("p_brand")).alias("city"),
        nested_place(F.col("p_type")).alias("neighborhood")))
    item = F.struct(
        F.concat(F.lit("MLB"), F.col("p_partkey").cast("string")).alias("id"),
        F.concat(F.lit("item/"), F.col("p_partkey").cast("string")).alias("permalink"),
        F.col("p_name").alias("title"), e["price"].cast("double").alias("price"),
        address.alias("address"), location.alias("location"), attrs.alias("attributes"))
    # pages of at most 50 items, as the listing API serves them
    pages = p.groupBy(F.floor(F.col("p_partkey") / 50).alias("pagina")).agg(
        F.collect_list(item).alias("results"), F.count(F.lit(1)).alias("total"))
    text = F.to_json(F.struct("results", F.struct("total").alias("paging")))
    if cut:
        text = F.when(F.col("pagina") % cut == 3, F.substr(text, F.lit(1), (F.length(text) / 2).cast("int"))).otherwise(text)
    return pages.select(text.alias("value"))


def _listings(spark, d):
    path = derived_input(spark, "listings", [table_path(d, "part")],
                         lambda p: _listing_pages(spark, d).write.mode("overwrite").text(p),
                         version=DERIVED_VERSION)
    return listings.parse_listings(listings.read_listing_pages(spark, path))


_LISTING_EXPECTED = {
    "provedor": "'mercadolivre'", "id_externo": "'MLB' || CAST(p_partkey AS VARCHAR)",
    "url": "'item/' || CAST(p_partkey AS VARCHAR)", "titulo_anuncio": "p_name",
    "uf": "CASE WHEN p_size % 11 = 0 THEN NULL ELSE substr(p_brand, 7, 2) END",
    "cidade": "p_brand", "bairro": "p_type",
    "cep": "CASE WHEN p_size % 7 = 0 THEN NULL ELSE lpad(CAST(p_partkey AS VARCHAR), 8, '0') END",
    "negocio": "CASE p_size % 4 WHEN 0 THEN 'venda' WHEN 1 THEN 'aluguel' WHEN 2 THEN 'temporada' END",
    "valor_aluguel": "CASE WHEN p_size % 4 = 1 AND p_size % 10 <> 0 THEN p_retailprice END",
    "valor_venda": "CASE WHEN p_size % 4 = 0 AND p_size % 10 <> 0 THEN p_retailprice END",
    "tipo_imovel": "p_type",
    "n_quartos": "CAST(CASE WHEN p_size % 6 = 0 THEN 9 WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 5 END AS INTEGER)",
    "area_total_m2": "CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice END",
    "area_construida_m2": "CASE WHEN p_size % 4 = 3 THEN NULL ELSE 1000.5::DOUBLE END",
    "andar": "CAST(p_size AS INTEGER)", "tipos_quadra": "'tenis, basquete'",
    "tem_piscina": "CASE p_size % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
    "tem_elevador": "p_size % 2 = 0",
}


def _attr_sql_type(column: str) -> str:
    if column.startswith("tem_"):
        return "BOOLEAN"
    if column in listings.DECIMAL_COLUMNS:
        return "DOUBLE"
    if column in listings.INTEGER_COLUMNS:
        return "INTEGER"
    return "VARCHAR"


def _listing_sql(columns) -> str:
    sel = ", ".join(f"CAST({_LISTING_EXPECTED.get(c, 'NULL')} AS "
                    f"{'DOUBLE' if c.startswith('valor_') else _attr_sql_type(c)}) AS {c}" for c in columns)
    return f"SELECT {sel} FROM part"


_PARSE_COLS = ("provedor", "url", "id_externo", "titulo_anuncio", "uf", "cidade", "bairro", "cep")
_PIVOT_COLS = ("id_externo",) + tuple(listings.ATTRIBUTE_COLUMNS.values())
_ROUTE_COLS = ("id_externo", "negocio", "valor_aluguel", "valor_venda")
_FLAG_COLS = ("id_externo", "tem_piscina", "tem_elevador", "tem_sauna")
def _attributes_long(spark, d):
    path = derived_input(spark, "listings", [table_path(d, "part")],
                         lambda p: _listing_pages(spark, d).write.mode("overwrite").text(p), version=DERIVED_VERSION)
    return listings.listing_attributes(spark, path).groupBy("atributo", "valor", "conhecido").agg(F.count(F.lit(1)).alias("n"))


_DUCK_ITEM = {k: v.replace("AS STRING", "AS VARCHAR") for k, v in _ITEM_SQL.items()}
_LONG_ATTRIBUTES = (("OPERATION_TYPE", _DUCK_ITEM["deal"], ""), ("BEDROOMS", _DUCK_ITEM["bedrooms"], ""),
                    ("BEDROOMS", "'9'", " WHERE p_size % 6 = 0"), ("TOTAL_AREA", _DUCK_ITEM["total_area"], ""),
                    ("COVERED_AREA", _DUCK_ITEM["covered_area"], ""), ("POOL", _DUCK_ITEM["pool"], ""),
                    ("ELEVATOR", _DUCK_ITEM["elevator"], ""), ("PROPERTY_TYPE", "p_type", ""), ("COLOR", "'azul'", ""),
                    ("FLOOR", "CAST(p_size AS VARCHAR)", ""), ("SPORTS_COURT", "'tenis, basquete'", ""))
register("listing_attributes_long",
         "SELECT atributo, valor, atributo <> 'COLOR' AS conhecido, COUNT(*) AS n FROM ("
         + " UNION ALL ".join(f"SELECT '{a}' AS atributo, {v} AS valor FROM part{w}" for a, v, w in _LONG_ATTRIBUTES)
         + ") t GROUP BY 1, 2, 3")(_attributes_long)

# pages of which one in seven is cut off: its items are rejects, all others are read
def _listing_rejects(spark, d):
    cut = lambda p: _listing_pages(spark, d, cut=7).write.mode("overwrite").text(p)
    path = derived_input(spark, "listings-cut", [table_path(d, "part")], cut, version=DERIVED_VERSION)
    good = listings.parse_listings(listings.read_listing_pages(spark, path, "reject")).select(
        F.lit("item").alias("motivo"), "id_externo")
    return good.unionByName(listings.listing_rejects(spark, path).select("motivo", "id_externo")).groupBy("motivo").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id_externo").alias("n_itens"))


register("listing_rejects",
         "SELECT CASE WHEN p_partkey // 50 % 7 = 3 THEN 'pagina' ELSE 'item' END AS motivo, "
         "CASE WHEN p_partkey // 50 % 7 = 3 THEN COUNT(DISTINCT p_partkey // 50) ELSE COUNT(*) END AS n, "
         "CASE WHEN p_partkey // 50 % 7 = 3 THEN 0 ELSE COUNT(*) END AS n_itens FROM part GROUP BY p_partkey // 50 % 7 = 3")(
    _listing_rejects)

_AREA_COLS = ("id_externo", "area_total_m2", "area_construida_m2", "area_terreno_m2")
for _name, _cols in (("listing_parse", _PARSE_COLS), ("attribute_pivot", _PIVOT_COLS),
                     ("conditional_route", _ROUTE_COLS), ("token_flags", _FLAG_COLS),
                     ("decimal_comma", _AREA_COLS)):
    register(_name, _listing_sql(_cols))(
        lambda spark, d, _c=_cols: _listings(spark, d).select(*_c))

# ---------------------------------------------------------------- K11, imovel side (data_coleta is the load time)
_IMOVEL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
register("imovel_conform",
         "SELECT " + ", ".join(f"CAST({_LISTING_EXPECTED.get(f.name, 'NULL')} AS {_IMOVEL_TYPES[f.dataType.simpleString()]}) AS {f.name}"
                               for f in IMOVEL.fields if f.name != "data_coleta") + " FROM part")(
    lambda spark, d: listings.listings_to_imovel(_listings(spark, d)).drop("data_coleta"))

# ---------------------------------------------------------------- P5, X7
_MIXED = ("CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN concat(CAST(p_size AS STRING), '.0') "
          "ELSE concat(' ', CAST(p_size AS STRING), ' ') END")
register("safe_cast",
         f"SELECT p_partkey, texto, CASE WHEN regexp_matches(texto, '^\\s*[+-]?\\d+(_\\d+)*\\s*$') "
         f"THEN TRY_CAST(replace(trim(texto), '_', '') AS INTEGER) END AS valor "
         f"FROM (SELECT p_partkey, {_MIXED} AS texto FROM part) t")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", F.expr(_MIXED).alias("texto")).select(
        "p_partkey", "texto", parse_int_strict("texto").alias("valor")))

# ---------------------------------------------------------------- X1, X2
def _counted_slugs(texts, to_slug):
    return (texts.groupBy("t").agg(F.count(F.lit(1)).alias("n")).select(to_slug("t").alias("slug"), "n")
            .groupBy("slug").agg(F.sum("n").alias("n")))


_HEADING = "concat(p_type, ' — Situação ', p_brand, ' 1- Urbana 2- Rural')"
register("slugify_heading",
         "SELECT trim(regexp_replace(strip_accents(lower(regexp_split_to_array(h, "
         "':\\s*|\\s+\\d+\\s*[-–]\\s*')[1])), '[^a-z0-9]+', '_', 'g'), '_') AS slug, COUNT(*) AS n "
         f"FROM (SELECT {_HEADING} AS h FROM part) t GROUP BY 1")(
    # equal headings are folded once: group the raw text first (partial aggregate), then the slugs
    lambda spark, d: _counted_slugs(table(spark, d, "part").select(F.expr(_HEADING).alias("t")), slug_heading))


_LABEL = "concat(c_mktsegment, ' – Região ', r_name, ' / ', n_name)"
register("slugify",
         "SELECT trim(regexp_replace(lower(strip_accents(t)), '[^a-z0-9]+', '_', 'g'), '_') AS slug, "
         f"COUNT(*) AS n FROM (SELECT {_LABEL} AS t FROM customer JOIN nation ON c_nationkey = n_nationkey "
         "JOIN region ON n_regionkey = r_regionkey) x GROUP BY 1")(
    lambda spark, d: _counted_slugs(
        table(spark, d, "customer")
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.expr(_LABEL).alias("t")), slug))

# ---------------------------------------------------------------- S5, J4
def _brand_dictionary_rows():
    text = resources.files("tabulare.sources.layouts").joinpath("marcas.csv").read_text("utf-8")
    return [(r["marca"], r["descricao"]) for r in csv.DictReader(io.StringIO(text))]


_DEFAULT_DESC = "(nao encontrado)"
register("label_dictionary",
         "SELECT p_partkey, p_brand, COALESCE(descricao, '" + _DEFAULT_DESC + "') AS descricao FROM part "
         "LEFT JOIN (VALUES " + ", ".join(f"('{m}', '{t}')" for m, t in _brand_dictionary_rows())
         + ") AS dic(marca, descricao) ON p_brand = marca")(
    lambda spark, d: table(spark, d, "part").join(
        spark.createDataFrame(_brand_dictionary_rows(), "marca string, descricao string"),
        F.col("p_brand") == F.col("marca"), "left").select(
        "p_partkey", "p_brand", F.coalesce("descricao", F.lit(_DEFAULT_DESC)).alias("descricao")))
