"""One-job ingest flows: census (all states), PNADC (split by state), listings."""

import json
import os

from tabulare.params import HousingParams, ListingParams
from tabulare.sources.layout import Layout
from tabulare.sources.surveys import ingest_census, ingest_listings, ingest_pnadc

_K = ("variable", "description", "start", "end", "length", "decimals", "type")
DOM = Layout.from_rows([dict(zip(_K, r)) for r in [
    ("V0011", "ÁREA DE PONDERAÇÃO", "1", "13", "13", "", "A"),
    ("V0300", "CONTROLE", "14", "21", "8", "", "N"),
    ("V0010", "PESO AMOSTRAL", "22", "37", "3", "13", "N"),
]])
PNADC = Layout.from_rows([dict(zip(_K, r)) for r in [
    ("Ano", "Ano de referência", "1", "4", "4", "", "C"),
    ("UF", "Unidade da Federação", "6", "7", "2", "", "C"),
    ("V2007", "Sexo", "9", "9", "1", "", "C"),
]], "pnadc")


def _file(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as fh:
        fh.write(("\r\n".join(lines) + "\r\n").encode("latin-1"))


def test_census_all_states_one_job(spark, tmpdir_path):
    raw = tmpdir_path + "/raw"
    line = lambda c: "1200013000001" + f"{c:08d}" + "0000005000000000"
    _file(f"{raw}/AC/Amostra_Domicilios_12.txt", [line(1), line(2)])
    _file(f"{raw}/SP/Amostra_Domicilios_35_1.txt", [line(3)])
    _file(f"{raw}/SP/Amostra_Domicilios_35_2.txt", [line(4)])            # second archive part
    out = ingest_census(spark, {"domicilios": f"{raw}/*/Amostra_Domicilios_*.txt"}, {"domicilios": DOM},
                        tmpdir_path + "/out")
    df = spark.read.parquet(out["domicilios"])
    assert {r.uf: r["count"] for r in df.groupBy("uf").count().collect()} == {"AC": 2, "SP": 2}
    assert df.where("controle = 4").first().peso_amostral == 0.0005
    # idempotent: an existing output is not rewritten
    before = sorted(os.listdir(out["domicilios"]))
    ingest_census(spark, {"domicilios": f"{raw}/*/Amostra_Domicilios_*.txt"}, {"domicilios": DOM},
                  tmpdir_path + "/out")
    assert sorted(os.listdir(out["domicilios"])) == before
    only_ac = ingest_census(spark, {"domicilios": f"{raw}/*/*.txt"}, {"domicilios": DOM},
                            tmpdir_path + "/out_ac", HousingParams("census_2010", ["AC"]))
    assert spark.read.parquet(only_ac["domicilios"]).count() == 2


def test_pnadc_split_by_state(spark, tmpdir_path):
    _file(tmpdir_path + "/pnadc.txt", ["2025 12 1", "2025 11 2", "2025 12 2", "2025 77 1"])
    path = ingest_pnadc(spark, tmpdir_path + "/pnadc.txt", PNADC, tmpdir_path + "/out")
    df = spark.read.parquet(path)
    assert {r.uf: r["count"] for r in df.groupBy("uf").count().collect()} == {"AC": 2, "RO": 1}
    assert sorted(p for p in os.listdir(path) if p.startswith("uf=")) == ["uf=AC", "uf=RO"]
    ro = ingest_pnadc(spark, tmpdir_path + "/pnadc.txt", PNADC, tmpdir_path + "/out_ro",
                      HousingParams("pnadc", ["RO"]))
    assert spark.read.parquet(ro).count() == 1


def test_listings_by_state(spark, tmpdir_path):
    def item(i, state, deal):
        return {"id": f"MLB{i}", "price": 10.0, "address": {"state_id": state, "city_name": "c"},
                "attributes": [{"id": "OPERATION_TYPE", "value_name": deal}]}
    page = {"results": [item(1, "BR-SP", "Venda"), item(2, "BR-SP", "Aluguel"), item(3, "BR-RJ", "Venda"),
                        item(4, None, "Venda"), item(5, "BR-", "Venda")]}
    with open(tmpdir_path + "/p.json", "w") as fh:
        fh.write(json.dumps(page) + "\n")
    counts = {r.uf: r.n_linhas for r in ingest_listings(spark, tmpdir_path + "/p.json", tmpdir_path + "/o").collect()}
    assert counts == {"SP": 2, "RJ": 1}                     # no state / empty state dropped
    sale_sp = ingest_listings(spark, tmpdir_path + "/p.json", tmpdir_path + "/o2",
                              ListingParams(ufs=["SP"], negocio="venda")).collect()
    assert [(r.uf, r.n_linhas) for r in sale_sp] == [("SP", 1)]


def test_census_from_archives(spark, tmpdir_path):
    import zipfile

    from tabulare.sources.surveys import census_files, ingest_census_archives

    def archive(name, members):
        with zipfile.ZipFile(os.path.join(tmpdir_path, name), "w") as zf:
            for member, lines in members.items():
                zf.writestr(member, ("\r\n".join(lines) + "\r\n").encode("latin-1"))

    line = lambda c: "1200013000001" + f"{c:08d}" + "0000005000000000"
    archive("AC.zip", {"Amostra_Domicilios_12.txt": [line(1), line(2)], "Amostra_Pessoas_12.txt": [line(1)],
                       "Leia_me.txt": ["not data"]})
    archive("SP1.zip", {"Amostra_Domicilios_35.txt": [line(3)]})
    archive("SP2_RM.zip", {"SP2_RM/Amostra_Domicilios_35_RM.txt": [line(4), line(5)]})
    out = ingest_census_archives(spark, tmpdir_path + "/*.zip", {"domicilios": DOM, "pessoas": DOM},
                                 tmpdir_path + "/out", tmpdir_path + "/staging")
    dom = spark.read.parquet(out["domicilios"])
    assert {r.uf: r["count"] for r in dom.groupBy("uf").count().collect()} == {"AC": 2, "SP": 3}
    assert spark.read.parquet(out["pessoas"]).count() == 1
    assert set(census_files("/data")) == {"domicilios", "pessoas", "emigracao", "mortalidade"}


def test_ingest_state_by_state(spark, tmpdir_path):
    raw, out = tmpdir_path + "/raw", tmpdir_path + "/out"
    line = lambda c: "1200013000001" + f"{c:08d}" + "0000005000000000"
    _file(f"{raw}/AC/Amostra_Domicilios_12.txt", [line(1)])
    _file(f"{raw}/SP/Amostra_Domicilios_35.txt", [line(2), line(3)])
    files = {"domicilios": f"{raw}/*/Amostra_Domicilios_*.txt"}

    def run(uf, **kw):
        ingest_census(spark, files, {"domicilios": DOM}, out, HousingParams("census_2010", [uf]), **kw)
        return {r.uf: r["count"] for r in spark.read.parquet(out + "/domicilios").groupBy("uf").count().collect()}

    assert run("AC") == {"AC": 1}
    kept = sorted(os.listdir(out + "/domicilios/uf=AC"))
    assert run("SP") == {"AC": 1, "SP": 2}
    assert sorted(os.listdir(out + "/domicilios/uf=AC")) == kept      # untouched
    _file(f"{raw}/SP/Amostra_Domicilios_35.txt", [line(2)])
    assert run("SP") == {"AC": 1, "SP": 2}                            # stored: skipped
    assert run("SP", overwrite=True) == {"AC": 1, "SP": 1}


def test_listings_of_other_states_stay(spark, tmpdir_path):
    item = lambda i, s: {"id": f"M{i}", "price": 1.0, "address": {"state_id": s, "city_name": "c"}}
    with open(tmpdir_path + "/p.json", "w") as fh:
        fh.write(json.dumps({"results": [item(1, "BR-SP"), item(2, "BR-RJ")]}) + "\n")
    for uf in ("SP", "RJ"):
        got = ingest_listings(spark, tmpdir_path + "/p.json", tmpdir_path + "/o", ListingParams(ufs=[uf])).collect()
        assert [(r.uf, r.n_linhas) for r in got] == [(uf, 1)]
    assert spark.read.parquet(tmpdir_path + "/o/imovel").count() == 2


def test_pnadc_from_its_archive(spark, tmpdir_path):
    import zipfile

    import pytest

    def archive(name, member):
        with zipfile.ZipFile(os.path.join(tmpdir_path, name), "w") as zf:
            zf.writestr(member, "2025 12 1\r\n2025 11 2\r\n2025 12 2\r\n")
    archive("PNADC.zip", "PNADC_2025.txt")
    path = ingest_pnadc(spark, tmpdir_path + "/PNADC.zip", PNADC, tmpdir_path + "/out")
    assert {r.uf: r["count"] for r in spark.read.parquet(path).groupBy("uf").count().collect()} == {"AC": 2, "RO": 1}
    archive("empty.zip", "leia-me.pdf")
    with pytest.raises(ValueError, match="no text member"):
        ingest_pnadc(spark, tmpdir_path + "/empty.zip", PNADC, tmpdir_path + "/out2")


def test_wide_layout_end_to_end(spark, tmpdir_path):
    """A 244-field layout through ingest: every field parsed under its own name and type."""
    rows = [dict(zip(_K, (f"W{i:04d}", f"CAMPO {i}", str(2 * i + 1), str(2 * i + 2), "2", "", "N"))) for i in range(244)]
    wide = Layout.from_rows(rows)
    _file(tmpdir_path + "/raw/AC/Amostra_Pessoas_12.txt", ["".join(f"{(i + k) % 100:02d}" for i in range(244)) for k in range(5)])
    out = ingest_census(spark, {"pessoas": tmpdir_path + "/raw/*/*.txt"}, {"pessoas": wide}, tmpdir_path + "/out")
    df = spark.read.parquet(out["pessoas"])
    assert len(df.columns) == 245 and df.count() == 5
    got = df.orderBy("campo_0").first()
    assert all(got[f"campo_{i}"] == i % 100 for i in range(244))
