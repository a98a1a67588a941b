"""Nested listing JSON → flat ``imovel`` rows.

Pages are read with an explicit schema (no inference pass over the data),
``results`` is exploded, and every output column is a Column expression over
the item struct; there is no per-item Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulare.functions import codes
from tabulare.functions.text import decimal_comma_sql, int_strict_sql, token_flag_sql
from tabulare.schemas import IMOVEL, conform

_S = T.StringType()
_PLACE = T.StructType([T.StructField("name", _S)])
ADDRESS = T.StructType([
    T.StructField("state_id", _S), T.StructField("city_name", _S),
    T.StructField("neighborhood_name", _S), T.StructField("zip_code", _S),
    T.StructField("city", _PLACE), T.StructField("neighborhood", _PLACE),
])
ITEM = T.StructType([
    T.StructField("id", _S), T.StructField("permalink", _S), T.StructField("title", _S),
    T.StructField("price", _S),                  # as written; a number or a reject
    T.StructField("address", ADDRESS), T.StructField("location", ADDRESS),
    T.StructField("attributes", T.ArrayType(T.StructType([
        T.StructField("id", _S), T.StructField("value_name", _S)]))),
])
PAGE = T.StructType([
    T.StructField("results", T.ArrayType(ITEM)),
    T.StructField("paging", T.StructType([T.StructField("total", T.LongType())])),
])

# Listing attribute id -> imovel column, in the source's order.
ATTRIBUTE_COLUMNS = {
    "PROPERTY_TYPE": "tipo_imovel", "BEDROOMS": "n_quartos", "SUITES": "n_suites",
    "FULL_BATHROOMS": "n_banheiros", "HALF_BATHROOMS": "n_lavabos",
    "TOTAL_AREA": "area_total_m2", "COVERED_AREA": "area_construida_m2",
    "LOT_AREA": "area_terreno_m2", "GARAGE_SPACES": "n_vagas_total",
    "GARAGE_TYPE": "tipo_garagem", "FLOORS": "n_andares", "FLOOR": "andar",
    "OPERATION_TYPE": "negocio",
    "POOL": "tem_piscina", "BALCONY": "tem_varanda", "TERRACE": "tem_terraco",
    "GARDEN": "tem_jardim", "BARBECUE_GRILL": "tem_churrasqueira",
    "GOURMET_SPACE": "tem_area_gourmet", "PARTY_ROOM": "tem_salao_festas",
    "GAME_ROOM": "tem_salao_jogos", "GYM": "tem_academia", "PLAYGROUND": "tem_playground",
    "SAUNA": "tem_sauna", "ELEVATOR": "tem_elevador", "DOORMAN": "tem_portaria",
    "ELECTRIC_GATE": "tem_portao_eletrico", "CONDOMINIUM_GATE": "tem_portao",
    "SECURITY_CAMERA": "tem_camera", "ALARM": "tem_alarme",
    "AIR_CONDITIONING": "tem_ar_condicionado", "SOLAR_PANEL": "tem_placa_solar",
    "GENERATOR": "tem_gerador", "ARTESIAN_WELL": "tem_poco_artesiano",
    "PET_AREA": "tem_area_pet", "SPORTS_COURT": "tipos_quadra",
}
DECIMAL_COLUMNS = ("area_total_m2", "area_construida_m2", "area_terreno_m2")
INTEGER_COLUMNS = ("n_quartos", "n_suites", "n_banheiros", "n_lavabos", "n_vagas_total",
                   "n_andares", "andar")
PROVIDER = "mercadolivre"


CORRUPT = "_corrupt_record"
_PAGE_OR_TEXT = T.StructType(PAGE.fields + [T.StructField(CORRUPT, _S)])


def read_listing_pages(spark: SparkSession, path: str, malformed: str = "fail") -> DataFrame:
    """JSON pages (one per line) with the fixed page schema.

    A page that is no valid JSON of that schema fails the job, or, with
    ``malformed="reject"``, is left to ``listing_rejects``.
    """
    if malformed == "fail":
        return spark.read.schema(PAGE).option("mode", "FAILFAST").json(path)
    return _pages_or_text(spark, path).where(f"page.{CORRUPT} IS NULL").select("page.results", "page.paging")


def _pages_or_text(spark: SparkSession, path: str) -> DataFrame:
    """One ``page`` per line; parsed as a whole, so that what a query selects does not decide what is malformed."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.from_json("value", _PAGE_OR_TEXT, options).alias("page"))


def listing_rejects(spark: SparkSession, path: str) -> DataFrame:
    """What ``read_listing_pages`` and ``parse_listings`` cannot use: ``motivo, id_externo, texto``.

    One row per malformed page (its text) and one per item whose price is not
    a number (the price's text).
    """
    rows = _pages_or_text(spark, path)
    pages = rows.where(f"page.{CORRUPT} IS NOT NULL").selectExpr(
        "'pagina' AS motivo", "CAST(NULL AS STRING) AS id_externo", f"page.{CORRUPT} AS texto")
    items = rows.where(f"page.{CORRUPT} IS NULL").select(F.explode("page.results").alias("item"))
    prices = items.where("item.price IS NOT NULL AND try_cast(item.price AS DOUBLE) IS NULL").selectExpr(
        "'preco' AS motivo", "item.id AS id_externo", "item.price AS texto")
    return pages.unionByName(prices)


def listing_attributes(spark: SparkSession, path: str, malformed: str = "fail") -> DataFrame:
    """P15/X16 without a fixed map: ``id_externo, atributo, valor, conhecido``, one row per attribute of every item.

    Pages are read as VARIANT, so attributes the ``imovel`` columns do not
    know are kept as written; of an id that repeats every value is a row. A
    page that is no JSON fails the job, or, with ``malformed="reject"``, is
    left to ``listing_rejects``.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    pages = lines.select((F.parse_json if malformed == "fail" else F.try_parse_json)("value").alias("page")).where("page IS NOT NULL")
    items = pages.select(F.explode(F.variant_get("page", "$.results", "array<variant>")).alias("item"))
    each = items.select(F.variant_get("item", "$.id", "string").alias("id_externo"),
                        F.explode(F.try_variant_get("item", "$.attributes", "array<variant>")).alias("a"))
    return each.select("id_externo", F.variant_get("a", "$.id", "string").alias("atributo"),
                       F.variant_get("a", "$.value_name", "string").alias("valor")).withColumn(
        "conhecido", F.coalesce(F.col("atributo").isin(list(ATTRIBUTE_COLUMNS)), F.lit(False)))


def _attribute_value_sql(attr_id: str) -> str:
    """``value_name`` of the *last* attribute with this id (NULL if none)."""
    return f"try_element_at(filter(_attrs, a -> a.id = '{attr_id}'), -1).value_name"


def _attribute_sql(column: str, raw: str) -> str:
    """Conversion of one attribute's text to its ``imovel`` column, as SQL text."""
    if column.startswith("tem_"):
        return token_flag_sql(raw)                             # X8
    if column == "negocio":
        return codes.label_sql(raw, codes.NEGOCIO)             # X9
    if column in DECIMAL_COLUMNS:
        return decimal_comma_sql(raw)                          # X5/X6
    if column in INTEGER_COLUMNS:
        return int_strict_sql(raw)                             # X7
    return raw


def parse_listings(pages: DataFrame) -> DataFrame:
    """Explode ``results`` and flatten each item to ``imovel`` columns.

    The ~40 output columns are SQL expressions applied in two projections
    (raw attribute texts, then their conversions): the same Catalyst plan as
    the Column-API form, built with two calls into the JVM instead of hundreds.
    """
    items = pages.select(F.explode("results").alias("item"))
    addr = ("CASE WHEN item.address IS NULL OR (item.address.state_id IS NULL AND item.address.city_name IS NULL"
            " AND item.address.neighborhood_name IS NULL AND item.address.zip_code IS NULL"
            " AND item.address.city IS NULL AND item.address.neighborhood IS NULL)"
            " THEN item.location ELSE item.address END")
    first = items.selectExpr(
        "item", f"{addr} AS _addr", "coalesce(item.attributes, array()) AS _attrs")
    raw = first.selectExpr(
        f"'{PROVIDER}' AS provedor", "item.permalink AS url", "item.id AS id_externo",
        "item.title AS titulo_anuncio",
        # P18: "BR-SP" -> "SP"; a missing/empty state stays NULL
        "CASE WHEN nullif(_addr.state_id, '') IS NOT NULL THEN replace(_addr.state_id, 'BR-', '') END AS uf",
        "coalesce(nullif(_addr.city_name, ''), _addr.city.name) AS cidade",
        "coalesce(nullif(_addr.neighborhood_name, ''), _addr.neighborhood.name) AS bairro",
        "_addr.zip_code AS cep", "try_cast(item.price AS DOUBLE) AS _price",
        *[f"{_attribute_value_sql(k)} AS `_raw_{c}`" for k, c in ATTRIBUTE_COLUMNS.items()])
    fixed = ["provedor", "url", "id_externo", "titulo_anuncio", "uf", "cidade", "bairro", "cep"]
    converted = raw.selectExpr(
        *fixed, "_price",
        *[f"{_attribute_sql(c, f'`_raw_{c}`')} AS {c}" for c in ATTRIBUTE_COLUMNS.values()])
    # A non-zero price goes to rent or sale by deal type; seasonal gets neither
    return converted.selectExpr(
        *fixed, *ATTRIBUTE_COLUMNS.values(),
        "CASE WHEN _price IS NOT NULL AND _price <> 0 AND negocio = 'aluguel' THEN _price END AS valor_aluguel",
        "CASE WHEN _price IS NOT NULL AND _price <> 0 AND negocio = 'venda' THEN _price END AS valor_venda",
        "CAST(NULL AS STRING) AS descricao_texto")


def listings_to_imovel(flat: DataFrame) -> DataFrame:
    """The 78-column ``imovel`` shape; ``data_coleta`` = load time."""
    return conform(flat, IMOVEL)
