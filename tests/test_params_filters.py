"""F2, F3, F4, F7, F9."""

import pytest

from tabulare.operators import filters
from tabulare.params import HousingParams, ListingParams, check_ufs


def test_params_domain():
    assert HousingParams("census_2010", ["ac", "SP"]).ufs == ("AC", "SP")
    assert HousingParams("pnadc").ufs is None
    assert check_ufs([]) is None
    with pytest.raises(ValueError):
        HousingParams("censo")
    with pytest.raises(ValueError):
        HousingParams("census_2010", ["XX"])
    with pytest.raises(ValueError):
        ListingParams(negocio="Venda")
    assert ListingParams(negocio="venda").negocio == "venda"


def test_filters(spark):
    df = spark.createDataFrame([("AC", "census_2010"), ("SP", "pnadc_2025"), ("", "pnadc_2025"),
                                (None, "census_2010")], "uf string, fonte string")
    assert filters.filter_states(df, None).count() == 4
    assert filters.filter_states(df, []).count() == 4
    assert filters.filter_states(df, ["SP", "AC"]).count() == 2
    assert filters.filter_source(df, "pnadc_2025").count() == 2
    assert filters.with_known_state(df).count() == 2
