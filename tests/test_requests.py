import datetime as dt

import pytest

from lodestrata.plans.requests import BadRequest, read_date, read_request


def test_requests():
    r = read_request([" dano  moral ", "Dano Moral", "", "prescrição"], ["stj", "trt"], [["multa"]], "idoso", "01/02/2024", "2024-03-01")
    assert r.formulations == ("dano moral", "prescrição") and len(r.courts) == 25
    assert r.must == [["multa"]] and r.must_not == ["idoso"] and r.since == dt.date(2024, 2, 1)


@pytest.mark.parametrize("change", [{"formulations": []}, {"formulations": ["x" * 301]}, {"courts": []}, {"since": "2024-02-30"}, {"since": "2024-02-02", "until": "2024-02-01"}, {"most": 0}, {"must": ["a"]}, {"must_not": [""]}, {"known": frozenset({"stf"})}])
def test_errors_teach(change):
    with pytest.raises(BadRequest):
        read_request(**({"formulations": ["a tese"], "courts": ["stj"]} | change))


def test_dates():
    assert read_date(None, "x") is None and read_date(" ", "x") is None and read_date("2024-02-29", "x") == dt.date(2024, 2, 29)
