"""Incremental ingest: new files are parsed once, reruns add nothing."""

import os

from tabulare.sources.layout import Layout
from tabulare.streaming import ingest_fwf_stream

LAYOUT = Layout.from_rows([
    {"variable": "V0300", "description": "CONTROLE", "start": "1", "end": "8", "length": "8",
     "decimals": "", "type": "N"},
    {"variable": "V0010", "description": "PESO AMOSTRAL", "start": "9", "end": "14", "length": "2",
     "decimals": "4", "type": "N"},
])


def _drop(root, uf, name, rows):
    os.makedirs(os.path.join(root, uf), exist_ok=True)
    with open(os.path.join(root, uf, name), "wb") as fh:
        fh.write("".join(f"{c:08d}{w:06d}\r\n" for c, w in rows).encode("latin-1"))


def test_incremental_ingest(spark, tmpdir_path):
    src, out, ckpt = tmpdir_path + "/in", tmpdir_path + "/out", tmpdir_path + "/ckpt"
    _drop(src, "AC", "Amostra_Domicilios_12.txt", [(1, 15000), (2, 25000)])
    _drop(src, "RO", "Amostra_Domicilios_11.txt", [(3, 10000)])

    def run():
        q = ingest_fwf_stream(spark, src + "/*", LAYOUT, out, ckpt, partition_by=["uf"],
                              state_from_path=r"/([A-Z]{2})/[^/]+$")
        q.awaitTermination()

    run()
    df = spark.read.parquet(out)
    assert {(r.uf, r.controle, r.peso_amostral) for r in df.collect()} == {
        ("AC", 1, 1.5), ("AC", 2, 2.5), ("RO", 3, 1.0)}
    run()                                                    # nothing new: nothing added
    assert spark.read.parquet(out).count() == 3
    _drop(src, "AC", "Amostra_Domicilios_12_parte2.txt", [(4, 5000)])
    run()
    assert spark.read.parquet(out).count() == 4


def test_a_new_checkpoint_on_an_old_output_is_refused(spark, tmpdir_path):
    import pytest

    src, out = tmpdir_path + "/in", tmpdir_path + "/out"
    _drop(src, "AC", "a.txt", [(1, 15000)])
    ingest_fwf_stream(spark, src + "/*", LAYOUT, out, tmpdir_path + "/c1").awaitTermination()
    _drop(src, "AC", "b.txt", [(2, 15000)])
    with pytest.raises(ValueError, match="another checkpoint"):
        ingest_fwf_stream(spark, src + "/*", LAYOUT, out, tmpdir_path + "/c2")
    ingest_fwf_stream(spark, src + "/*", LAYOUT, out, tmpdir_path + "/c1").awaitTermination()
    assert spark.read.parquet(out).count() == 2
