"""The path language, search pages and bundles."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cohortry.operators.fhirpath import PathError, path, truth
from cohortry.operators.search import Param, Registry, SearchError, search_page
from cohortry.sources import resources as resources_module
from cohortry.sources.resources import typed
from cohortry.sources.store import Store

OBSERVATION = {
    "resourceType": "Observation",
    "id": "o",
    "status": "final",
    "code": {"coding": [{"system": "s", "code": "a"}, {"system": "t", "code": "b"}]},
    "category": [{"coding": [{"code": "x"}]}, {"coding": [{"code": "y"}, {"code": "z"}]}],
    "subject": {"reference": "Patient/7"},
    "valueQuantity": {"value": 3.5, "unit": "g"},
    "component": [{"code": {"coding": [{"code": "c1"}]}, "valueQuantity": {"value": 1}}, {"code": {"coding": [{"code": "c2"}]}}],
}


@pytest.fixture(scope="module")
def obs(spark):
    return typed(spark.createDataFrame([("Observation", "o", json.dumps(OBSERVATION))], "type string, id string, content string"), "Observation")


@pytest.mark.parametrize(
    "text, want",
    [
        ("Observation.status", ["final"]), ("code.coding.code", ["a", "b"]), ("Observation.category.coding.code", ["x", "y", "z"]), ("code.coding.where(system = 't').code", ["b"]), ("code.coding[0].code", ["a"]),
        ("code.coding.first().system", ["s"]), ("code.coding[9].code", []), ("code.exists()", [True]), ("specimen.exists()", [False]), ("status = 'final'", [True]), ("status != 'final'", [False]), ("effectiveDateTime = 'x'", []),
        ("value.ofType(Quantity).unit", ["g"]), ("(value as Quantity).unit", ["g"]), ("value.as(CodeableConcept).text", []), ("value is Quantity", [True]), ("value is CodeableConcept", [False]),
        ("subject.where(resolve() is Patient).reference", ["Patient/7"]), ("subject.where(resolve() is Group).reference", []), ("subject.resolve().id", ["7"]), ("code.coding.code | status", ["a", "b", "final"]),
        ("status + '-' + id", ["final-o"]), ("status = 'final' and id = 'o'", [True]), ("component.where(code.coding.code = 'c1').value.ofType(Quantity).unit", []), ("component.code.coding.code", ["c1", "c2"]), ("'lit'", ["lit"]),
    ],
)
def test_paths(obs, text, want):
    assert obs.select(path(text, obs.schema, "Observation")).first()[0] == want


def test_path_conditions_and_errors(obs):
    assert obs.where(truth("status = 'final'", obs.schema)).count() == 1
    assert obs.where(truth("effectiveDateTime = 'x'", obs.schema)).count() == 0
    for bad in ("status.unknown()", "nothing", "status.", "code[", "status ~ 'x'", "exists(status)"):
        with pytest.raises(PathError):
            path(bad, obs.schema)
    with pytest.raises(Exception, match="single value"):
        obs.select(path("code.coding.code + 'x'", obs.schema)).collect()


@pytest.fixture(scope="module")
def reg(spark):
    p = spark.createDataFrame([(f"{i:02}", i % 3) for i in range(20)], "id string, n int")
    o = spark.createDataFrame([(str(i), f"{i % 5:02}") for i in range(30)], "id string, who string")
    ref = lambda: F.array(F.struct(F.lit("P").alias("type"), F.col("who").alias("id")))
    return Registry({"P": p, "O": o}, {"P": {"n": Param("number", lambda: F.array(F.col("n").cast("decimal(28,8)")))}, "O": {"who": Param("reference", ref, ("P",))}}, {"O": "who"}, "P")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_search_pages(reg):
    first = search_page(reg, "P", "n=1&_count=3&_total=accurate")
    assert ids(first.matches) == ["01", "04", "07"] and first.total == 7 and first.next_id() == "10"
    second = search_page(reg, "P", "n=1&_count=5&__page-id=10")
    assert ids(second.matches) == ["10", "13", "16", "19"] and second.next_id() is None
    assert search_page(reg, "P", "n=2&_summary=count").total == 6
    assert search_page(reg, "P", "_count=2&_elements=id").matches.columns == ["id"]
    assert ids(search_page(reg, "P", "_sort=-n&_count=2", {"n": "n"}).matches) == ["02", "05"]
    got = search_page(reg, "O", "who=P/03&_include=O:who")
    assert [tuple(r) for r in got.included.collect()] == [("P", "03")]
    assert search_page(reg, "P", "_id=03&_revinclude=O:who").included.count() == 6
    with pytest.raises(SearchError):
        search_page(reg, "P", "nonsense=1", lenient=False)


def test_too_many_includes_halve_the_page(reg, monkeypatch):
    from cohortry.operators import search

    monkeypatch.setattr(search, "MAX_INCLUDES", 3)
    got = search_page(reg, "O", "_count=16&_include=O:who")
    assert got.included.count() <= 3 and len(ids(got.matches)) < 16


def test_bundles_as_transactions_and_batches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    entry = lambda r, method="PUT", **more: {"resource": r, "request": {"method": method, "url": f"{r['resourceType']}/{r['id']}", **more}}
    p, o = {"resourceType": "Patient", "id": "7"}, {**OBSERVATION}
    assert store.apply_bundle({"entry": [entry(o), entry(p)]}, datetime(2024, 1, 1)) == 1
    got = store.apply_batch({"entry": [entry({**p, "gender": "male"}, ifMatch='W/"9"'), entry({**p, "gender": "male"}, ifMatch='W/"1"'), {"request": {"method": "DELETE", "url": "Patient/7"}}]}, datetime(2024, 1, 2))
    assert "not at version" in got[0] and got[1] == 3 and "is referenced" in got[2]


def test_xml_files_hold_a_bounded_number_of_resources(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(resources_module, "XML_RESOURCES", 3, raising=False)
    rows = [("Patient", str(i), json.dumps({"resourceType": "Patient", "id": str(i), "gender": "male" if i % 2 else "female"})) for i in range(10)]
    path = tmp_path / "x"
    resources_module.write_xml(spark.createDataFrame(rows, "type string, id string, content string").coalesce(1), "Patient", str(path))
    texts = [f.read_text() for f in path.glob("part-*")]
    assert sorted(t.count("</Patient>") for t in texts) == [1, 3, 3, 3] and all("<Bundle>" in t for t in texts)
    got = resources_module.read_xml(spark, str(path), "Patient")
    assert sorted(tuple(r) for r in got.select("id", "gender").collect()) == [(i, "male" if i % 2 else "female") for i in range(10)]
