"""Layout type rules and fixed-width parsing (census and PNADC)."""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulare.functions.codes import UF_CODES
from tabulare.operators.harmonize import lookup_state, uf_dimension
from tabulare.sources.fwf import encode_fwf, parse_fwf, read_fwf
from tabulare.sources.layout import Layout, packaged_layout


def _layout(rows, rule="census"):
    keys = ("variable", "description", "start", "end", "length", "decimals", "type")
    return Layout.from_rows([dict(zip(keys, r)) for r in rows], rule)


def test_census_type_rule():
    L = _layout([("A", "x", "1", "1", "1", "", "A"), ("B", "x", "2", "3", "2", "", "N"),
                 ("C", "x", "4", "6", "3", "", "N"), ("D", "x", "7", "10", "4", "", "N"),
                 ("E", "x", "11", "15", "5", "", "N"), ("F", "x", "16", "24", "9", "", "N"),
                 ("G", "x", "25", "37", "13", "", "A"), ("H", "x", "38", "53", "3", "13", "N"),
                 ("I", "x", "54", "55", "2", "0", "N")])
    got = [L.spark_type(f) for f in L.fields]
    assert got == [T.ByteType(), T.ByteType(), T.ShortType(), T.ShortType(), T.IntegerType(),
                   T.IntegerType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    assert L.fields[7].width == 16          # width from start/end, not length


def test_pnadc_type_rule():
    L = _layout([("UF", "Unidade da Federação", "6", "7", "2", "", "C"),
                 ("V1032", "Peso", "58", "72", "15", "", "N"), ("V2009", "Idade", "103", "105", "3", "", "C"),
                 ("UPA", "UPA", "12", "20", "9", "", "C"), ("X", "curto numérico", "1", "7", "7", "", "N")],
                "pnadc")
    assert [L.spark_type(f) for f in L.fields] == [T.StringType(), T.DoubleType(), T.ShortType(),
                                                   T.IntegerType(), T.IntegerType()]
    assert L.name(L.fields[0]) == "uf"


def test_rename_fallback_for_blank_description():
    L = packaged_layout("part_codes")
    names = L.names()
    assert names["P0001"] == "chave_da_peca"
    assert names["P0005"] == "tamanho"              # cut at " 1- "
    assert names["P0006"] == "p0006"                # blank description


def _write_lines(path, lines, encoding="latin-1"):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part1.txt"), "wb") as fh:
        fh.write(("\r\n".join(lines) + "\r\n").encode(encoding))


CENSUS = _layout([("V0001", "UNIDADE DA FEDERAÇÃO: 11- Rondônia", "1", "2", "2", "", "A"),
                  ("V0011", "ÁREA DE PONDERAÇÃO", "3", "15", "13", "", "A"),
                  ("V0300", "CONTROLE", "16", "23", "8", "", "N"),
                  ("V0010", "PESO AMOSTRAL", "24", "39", "3", "13", "N"),
                  ("V1006", "SITUAÇÃO DO DOMICÍLIO: 1- Urbana 2- Rural", "40", "40", "1", "", "N"),
                  ("V9999", "", "41", "42", "2", "", "N")])


def test_census_lines_parse(spark, tmpdir_path):
    lines = ["12" + "1200013000001" + "00000005" + "0004964240000000" + "1" + "  ",
             "12" + "1200013000001" + "00000006" + "0012500000000000" + " " + "07"]
    _write_lines(tmpdir_path, lines)
    df = read_fwf(spark, tmpdir_path, CENSUS)
    assert df.columns == ["unidade_da_federacao", "area_de_ponderacao", "controle", "peso_amostral",
                          "situacao_do_domicilio", "v9999"]
    rows = df.orderBy("controle").collect()
    assert rows[0].area_de_ponderacao == 1200013000001 and rows[0].controle == 5
    assert abs(rows[0].peso_amostral - 0.496424) < 1e-12           # 13 implied decimals
    assert rows[1].peso_amostral == 1.25
    assert rows[0].situacao_do_domicilio == 1 and rows[1].situacao_do_domicilio is None   # blank → NULL
    assert rows[0].v9999 is None and rows[1].v9999 == 7


def test_latin1_text_field(spark, tmpdir_path):
    L = _layout([("N", "nome", "1", "10", "10", "", "T"), ("K", "codigo", "11", "12", "2", "", "N")])
    _write_lines(tmpdir_path, ["São Paulo 35", "Goiânia   52"])
    rows = read_fwf(spark, tmpdir_path, L).orderBy("codigo").collect()
    assert [(r.nome, r.codigo) for r in rows] == [("São Paulo", 35), ("Goiânia", 52)]


def test_tolerant_cast(spark, tmpdir_path):
    L = _layout([("A", "a", "1", "3", "3", "", "N")])
    _write_lines(tmpdir_path, ["12x", " 7 "])
    assert sorted(r.a for r in read_fwf(spark, tmpdir_path, L, strict=False).collect()
                  if r.a is not None) == [7]
    assert read_fwf(spark, tmpdir_path, L, strict=False).where("a IS NULL").count() == 1


def test_pnadc_lines_split_by_state(spark, tmpdir_path):
    L = _layout([("Ano", "Ano de referência", "1", "4", "4", "", "C"),
                 ("UF", "Unidade da Federação", "6", "7", "2", "", "C"),
                 ("V1032", "Peso com calibração", "10", "24", "15", "", "N"),
                 ("V2009", "Idade na data de referência", "26", "28", "3", "", "C")], "pnadc")
    lines = ["2025 12  1234.5678900000 025", "2025 11  0000010.500000 030", "2025 12  1.0000000000000 040",
             "2025 99  1.0000000000000 001"]
    _write_lines(tmpdir_path, lines)
    parsed = read_fwf(spark, tmpdir_path, L).withColumn("uf_num", F.col("uf").cast("int"))
    by_uf = lookup_state(parsed.drop("uf"), "uf_num", uf_dimension(spark))
    counts = {r.uf: r["count"] for r in by_uf.groupBy("uf").count().collect()}
    assert counts == {"AC": 2, "RO": 1}                   # unknown 99 dropped
    ac = by_uf.where("uf = 'AC'").orderBy("idade_na_data_de_referencia").first()
    assert ac.peso_com_calibracao == 1234.56789 and ac.idade_na_data_de_referencia == 25
    assert len(UF_CODES) == 27


def test_encode_parse_round_trip(spark, tmpdir_path):
    L = packaged_layout("lineitem_census")
    src = spark.createDataFrame(
        [(1, 2, 3, 1, 5.0, 1234.56, 0.05, 0.08, 1998), (600000000, 20000, 999, 7, 50.0, 0.01, 0.0, 0.0, 2001),
         (42, 7, 1, 3, 1.0, 99999.99, 0.1, None, None)],
        "a long, b long, c long, d int, e double, f double, g double, h double, y int")
    cols = dict(zip([f.variable for f in L.fields], [F.col(c) for c in "abcdefghy"]))
    encode_fwf(src, L, cols).write.text(tmpdir_path + "/out")
    back = read_fwf(spark, tmpdir_path + "/out", L).orderBy("chave_do_pedido").collect()
    assert [tuple(r) for r in back] == [
        (1, 2, 3, 1, 5, 1234.56, 0.05, 0.08, 1998), (42, 7, 1, 3, 1, 99999.99, 0.1, None, None),
        (600000000, 20000, 999, 7, 50, 0.01, 0.0, 0.0, 2001)]


def test_only_needed_fields_are_computed(spark):
    L = packaged_layout("lineitem_census")
    df = parse_fwf(spark.createDataFrame([("x" * 57,)], "value string"), L, fields=["L0001"])
    assert df.columns == ["chave_do_pedido"]


def test_layout_csv_from_storage(spark, tmpdir_path):
    from tabulare.sources.layout import layout_from_df, read_layout_csv

    path = os.path.join(tmpdir_path, "domicilios.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("variable,description,start,end,length,decimals,type\n"
                 "V0001,\"UNIDADE DA FEDERAÇÃO: 11- Rondônia, 12- Acre\",1,2,2,,A\n"
                 "V0010,PESO AMOSTRAL,29,44,3,13,N\n"
                 "V1006,,53,53,1,,N\n")
    df = read_layout_csv(spark, path)
    assert df.count() == 3 and all(t == "string" for _, t in df.dtypes)
    L = layout_from_df(df)
    assert L.names() == {"V0001": "unidade_da_federacao", "V0010": "peso_amostral", "V1006": "v1006"}
    assert [L.spark_type(f).simpleString() for f in L.fields] == ["tinyint", "double", "tinyint"]
    assert L.fields[1].width == 16 and L.scale(L.fields[1]) == 13


def test_colliding_names_are_made_unique():
    L = _layout([("V1", "RENDA: total", "1", "2", "2", "", "N"), ("V2", "RENDA 1- faixa", "3", "4", "2", "", "N")])
    assert L.names() == {"V1": "renda", "V2": "renda_v2"}


def test_person_file_width_layout_round_trip(spark, tmpdir_path):
    """244 fields (the census person file's count): more than codegen's field limit."""
    rows, pos = [], 1
    for i in range(244):
        w = 2 + i % 3
        rows.append(("V%04d" % i, f"CAMPO NÚMERO {i}", str(pos), str(pos + w - 1), str(w),
                     "2" if i % 10 == 0 else "", "N"))
        pos += w
    L = _layout(rows)
    src = spark.range(50).select(F.col("id").alias("id"))
    vals = {f.variable: ((F.col("id") * (j + 1)) % (10 ** (f.width - 1))) / 10 ** (f.decimals or 0)
            for j, f in enumerate(L.fields)}
    encode_fwf(src, L, vals).write.text(tmpdir_path + "/wide")
    back = read_fwf(spark, tmpdir_path + "/wide", L)
    assert len(back.columns) == 244 and back.count() == 50
    r = back.orderBy("campo_numero_1").collect()[7]             # id 7
    assert r["campo_numero_1"] == (7 * 2) % 10 ** 2
    assert r["campo_numero_10"] == ((7 * 11) % 10 ** 2) / 100     # implied decimals


def test_encoder_refuses_values_wider_than_the_field(spark):
    import pytest as _pytest

    L = _layout([("A", "a", "1", "2", "2", "", "N")])
    with _pytest.raises(Exception, match="too wide"):
        encode_fwf(spark.createDataFrame([(123,)], "a int"), L, {"A": F.col("a")}).collect()


def test_latin1_lines_are_stored_compressed_in_files_of_bounded_length(spark, tmpdir_path, monkeypatch):
    from tabulare.plans import q_ingest

    monkeypatch.setattr(q_ingest, "_LINES_PER_FILE", 1000)
    texts = {1: "ação " * 2000 + "x" * 85, 2: "日本 fim\tcom  \n espaço", 3: "", 4: None, 5: " ".join(f"palavra{i}" for i in range(1500))}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmpdir_path}/documents.parquet")
    out = f"{tmpdir_path}/lines"
    q_ingest._write_document_words(spark, tmpdir_path, out)
    sizes = [os.path.getsize(f"{out}/{f}") for f in os.listdir(out) if f.startswith("part-")]
    assert len(sizes) == 4                                       # 3,507 lines
    lines = read_fwf(spark, out, q_ingest.WORDS, encoding="ISO-8859-1", mapped=False).orderBy("D001", "D002", "D003").collect()
    assert sum(sizes) * 4 < len(lines) * (q_ingest.WORDS.record_width() + 1)
    want = [(k, w) for k, t in texts.items() for w in (t or "").split()]
    want = [(k, w[i:i + 40]) for k, w in want for i in range(0, len(w), 40)]
    assert [(r.D001, r.D004) for r in lines] == [(k, w.encode("latin-1", "replace").decode("latin-1")) for k, w in want]
    got = {r[0]: tuple(r)[1:] for r in q_ingest._document_words(spark, tmpdir_path).collect()}
    assert got == {1: (2001, 2003, 8085, 2000), 2: (4, 4, 14, 1), 5: (1500, 1500, 7 * 1500 + 10 + 180 + 2700 + 2000, 0)}
