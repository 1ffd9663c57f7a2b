"""The cohort query language: parser, definitions over clinical resources, and measures."""

import json

import pytest
from pyspark.sql import functions as F

from cohortry.plans.cql import Compiler
from cohortry.plans.cql_parser import CqlError, parse, parse_expression
from cohortry.plans.measure import Group, Measure, Stratifier, evaluate_expression, report_resource, subject_list_resources
from cohortry.plans.models import clinical


def concept(*codes):
    return {"coding": [{"system": "s", "code": c} for c in codes]}


def resource(type_, id_, patient=None, **more):
    r = {"resourceType": type_, "id": id_, **more}
    if patient is not None:
        r["subject"] = {"reference": f"Patient/{patient}"}
    return r


def obs(id_, patient, code, value=None, unit="g/dL", **more):
    q = {} if value is None else {"valueQuantity": {"value": value, "unit": unit, "system": "u", "code": unit}}
    return resource("Observation", id_, patient, status="final", code=concept(code), **q, **more)


RESOURCES = [
    resource("Patient", "0", gender="male", birthDate="1980-05-01", address=[{"city": "Jena"}]),
    resource("Patient", "1", gender="female", birthDate="2005", address=[{"city": "Leipzig"}]),
    resource("Patient", "2", gender="female", birthDate="1950-01"),
    obs("a", "0", "hb", 13.5, effectiveDateTime="2019-03-01", encounter={"reference": "Encounter/e"}),
    obs("b", "0", "hb", 9.0, effectiveDateTime="2018-03-01"),
    obs("c", "1", "hb", 120, "g/L", effectiveDateTime="2019"),
    obs("d", "2", "wt", 80, "kg", specimen={"reference": "Specimen/sp"}),
    resource("Specimen", "sp", "2", type=concept("blood")),
    resource("Specimen", "sq", "0", type=concept("urine")),
    resource("Encounter", "e", "0", status="finished", **{"class": {"system": "c", "code": "IMP"}}, period={"start": "2019-02-27", "end": "2019-03-05"}),
    resource("Encounter", "f", "2", status="finished", **{"class": {"system": "c", "code": "AMB"}}, period={"start": "2019-04-01"}),
    resource("Condition", "g", "0", code=concept("I10", "x"), onsetDateTime="2019-03-02", encounter={"reference": "Encounter/e"}),
    resource("Medication", "m", code=concept("A")),
    resource("MedicationStatement", "n", "2", status="active", medicationReference={"reference": "Medication/m"}),
]
HEAD = """
using FHIR version '4.0.0'
codesystem s: 's'
code hb: 'hb' from s
code wt: 'wt' from s
code I10: 'I10' from s
parameter Gender String default 'male'
context Unfiltered
define Drugs: [Medication: 'A'] M return 'Medication/' + M.id
define NumDrugs: Count([Medication])
define Oldest: Min(Births)
define Births: [Patient] P return year from P.birthDate
define Measured: Count(HasHb) - AnyHb
define AnyHb: if AnyTrue(HasHb) then 1 else 0
define Kinds: [Observation] O where O.value is not null return O.status
context Patient
define HasHb: exists [Observation: hb]
define Inpatient: First([Encounter] E where E.class = 'IMP')
define Female: if Patient.gender = 'female' then Patient else null
define Blood: First([Specimen: 'blood'])
define function Status(o Observation): o.status
define City: Patient.city
"""


@pytest.fixture(scope="module")
def model(spark):
    rows = [(r["resourceType"], r["id"], json.dumps(r)) for r in RESOURCES]
    codes = spark.createDataFrame([("s", "hb"), ("s", "wt")], "system string, code string")
    return clinical(spark.createDataFrame(rows, "type string, id string, content string").repartition(2), code_systems=lambda url: codes.where(F.col("system") == url))


CASES = {
    "exists [Observation: hb]": "TTF",
    "not exists [Observation: wt]": "TTF",
    "exists [Observation: { hb, wt }]": "TTT",
    "exists ([Observation: hb] O where O.value > 100 'g/L')": "TTF",
    "exists ([Observation: hb] O where O.value >= 13 'g/dL' and O.effective after @2019-01-01)": "TFF",
    "exists ([Observation: hb] O where Status(O) = 'final')": "TTF",
    "exists [Observation: hb] or exists [Encounter]": "TTT",
    "exists [Observation: hb] and exists [Encounter]": "TFF",
    "AgeInYearsAt(@2020-01-01) >= 18": "TFT",
    "Patient.gender = Gender": "TFF",
    "Patient.birthDate before @2005-06-01": "TNT",
    "exists ([Observation] O with [Encounter] E such that O.effective during E.period)": "TFF",
    "exists ([Encounter] E without [Observation: hb] O such that O.encounter.reference = 'Encounter/' + E.id)": "FFT",
    "exists ([MedicationStatement] M where M.medication.reference in Drugs)": "FFT",
    "exists ([Encounter] E where E.class = 'IMP' and start of E.period before @2019-03-01)": "TFF",
    "exists ([Encounter] E where E.period overlaps Interval[@2019-03-05, @2019-03-31])": "TFF",
    "exists ([Condition] C where C.code ~ I10)": "TFF",
    "Count([Observation]) > 1": "TFF",
    "First([Observation: hb] O sort by effective desc).value > 13 'g/dL'": "TFN",
    "First([Observation: hb] O sort by effective).value > 13 'g/dL'": "FFN",
    "Sum([Observation: hb] O return all O.value.value) > 100.0": "FTN",
    "Patient.gender in { 'male', 'other' }": "TFF",
    "case when Patient.gender = 'male' then true else false end": "TFF",
    "if Patient.gender = 'male' then null else true": "NTT",
    "Interval[1, 5] overlaps Interval[5, 9] and 3 in Interval[1, 5] and not (6 in Interval[1, 5))": "TTT",
    "{1, 2} union {2, 3} = {1, 2, 3}": "TTT",
    "Length('abc') = 3 and Substring('abc', 1) = 'bc' and Upper('a') = 'A'": "TTT",
    "duration in months between @2000-01-31 and @2000-02-29 = 0": "TTT",
    "@2020-01-31 + 1 month = @2020-02-29": "TTT",
    "1 / 0 is null": "TTT",
    "5 between 1 and 9": "TTT",
    "year from @2020-05-06 = 2020": "TTT",
    "exists ([Encounter] E with ([Observation: hb] O where O.value > 10 'g/dL') X such that X.effective during E.period)": "TFF",
    "Count([Encounter] E return E.status) = 1": "TFT",
    "Count(Drugs) = 1 and exists Drugs": "TTT",
    "NumDrugs = 1": "TTT",
    "exists [Inpatient -> Observation: hb]": "TFF",
    "Count([Inpatient -> Condition]) = 1": "TFF",
    "Count([Female -> Observation]) = 1": "FTT",
    "First([Blood -> Patient]).gender = 'female'": "NNT",
    "Slice({1, 2, 3, 4}, 1, 3) = {2, 3} and Skip({1, 2}, 1) = {2} and Take({1, 2}, 1) = {1} and Tail({1, 2}) = {2}": "TTT",
    "ToLong('5') = 5 and ToChars('ab') = {'a', 'b'} and ToList(3) = {3}": "TTT",
    "convert 1 'kg' to 'g' = 1000 'g' and CanConvertQuantity(1 'kg', 'mg') and not CanConvertQuantity(1 'kg', 'm')": "TTT",
    "ToTime('T12:30') < ToTime('T12:45') and Time(9, 5) = @T09:05": "TTT",
    "ToRatio('1 \\'g\\':2 \\'L\\'').numerator = 1 'g'": "TTT",
    "ConvertsToBoolean('yes') and not ConvertsToDate('x') and ConvertsToQuantity('3 \\'g\\'') and ConvertsToLong('4') and ConvertsToTime('T10:00') and ConvertsToString(1) and not ConvertsToRatio('q')": "TTT",
    "Sum([Observation: hb] O return all O.value) > 100 'g/L'": "TTN",
    "Flatten({{1, 2}, {3}}) = {1, 2, 3} and Flatten({{{1}}, {{2}, {3}}}) = {1, 2, 3}": "TTT",
    "Children(Code { system: 's', code: 'c' })[0] = 'c'": "TTT",
    "Quantity { value: 5, unit: 'kg' } = 5000 'g'": "TTT",
    "CalculateAgeInYears(Patient.birthDate) >= 15 and CalculateAgeInMonthsAt(@2000-01-01, @2000-03-01) = 2": "TTT",
    "TimeOfDay() = @T00:00:00": "TTT",
    "Tuple { a: 1, b: 'x' }.a = 1": "TTT",
    "hb in s and not (Code { system: 's', code: 'zz' } in s)": "TTT",
    "exists ([Observation] O where O.code in s and O.value > 70 'kg')": "FFT",
}


@pytest.fixture(scope="module")
def answers(model):
    text = HEAD + "\n".join(f'define "{i}": {e}' for i, e in enumerate(CASES))
    names = [str(i) for i in range(len(CASES))]
    return {r["id"]: r for r in Compiler(model, text).plan(names).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_definitions(answers, i):
    got = "".join({True: "T", False: "F", None: "N"}[answers[p][str(i)]] for p in "012")
    assert got == list(CASES.values())[i], list(CASES)[i]


def test_unfiltered_context(model):
    got = Compiler(model, HEAD).plan(["NumDrugs", "Oldest", "Measured"]).distinct().drop("id").distinct().collect()
    assert [tuple(r) for r in got] == [(1, 1950, 2)]
    assert [r["v"] for r in Compiler(model, HEAD).values("Kinds").collect()] == ["final"]
    with pytest.raises(CqlError):
        Compiler(model, HEAD).values("City")


def test_specimens_as_subjects(spark):
    rows = [(r["resourceType"], r["id"], json.dumps(r)) for r in RESOURCES]
    model = clinical(spark.createDataFrame(rows, "type string, id string, content string"), subject="Specimen")
    text = "context Specimen define g: First([Patient]).gender define n: Count([Observation]) define x: exists [Observation: 'wt']"
    got = {r["id"]: (r["g"], r["n"], r["x"]) for r in Compiler(model, text).plan(["g", "n", "x"]).collect()}
    assert got == {"sp": ("female", 1, True), "sq": ("male", 0, False)}
    with pytest.raises(CqlError, match="does not belong"):
        Compiler(model, "define x: First([Condition])").plan(["x"])


def test_relations_are_joins_of_rows(model):
    text = HEAD + "define a: exists ([Encounter] E with [Observation: hb] O such that O.effective during E.period)\ndefine b: exists ([Encounter] E without [Observation] O such that O.encounter.reference = 'Encounter/' + E.id)"
    plan = Compiler(model, text).plan(["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join ExistenceJoin" in plan and "collect_list" not in plan


def test_populations_share_a_plan(model):
    text = HEAD + "define a: exists [Observation: hb]\ndefine b: a and exists [Observation: wt]\ndefine c: Patient.gender = 'female'"
    group = Group({"initial-population": "a", "numerator": "b", "denominator": "c"}, (Stratifier("city", "City"), Stratifier("again", "City")))
    report = Measure(model, text, [group]).report()
    got = {(r["population"], r["stratifier"], r["stratum"]): r["count"] for r in report.collect()}
    assert got[("initial-population", None, None)] == 2 and got[("numerator", None, None)] == 0 and got[("denominator", "city", "null")] == 1 == got[("denominator", "again", "null")]
    assert report._jdf.queryExecution().optimizedPlan().toString().count("= Observation)") == 1


def test_strata_with_bars_stay_apart(spark):
    rows = [resource("Patient", str(i), gender=g, address=[{"city": c}]) for i, (g, c) in enumerate([("a|b", "c"), ("a", "b|c"), ("a\\", "b")])]
    model = clinical(spark.createDataFrame([("Patient", r["id"], json.dumps(r)) for r in rows], "type string, id string, content string"))
    group = Group({"p": "All"}, (Stratifier("both", components=(("g", "G"), ("c", "City"))),))
    got = Measure(model, "context Patient define All: true define G: Patient.gender define City: Patient.city", [group]).report().where("stratifier = 'both'").collect()
    assert sorted(r["stratum"] for r in got) == sorted(["a\\|b|c", "a|b\\|c", "a\\\\|b"])


def test_subject_lists_are_split(model):
    measure = Measure(model, "context Patient define All: true define None: false", [Group({"all": "All", "none": "None"})])
    got = subject_list_resources(measure, 0, "all", "l", size=1).collect()
    entries = [e["item"]["reference"] for r in got for e in json.loads(r["content"])["entry"]]
    assert sorted(entries) == ["Patient/0", "Patient/1", "Patient/2"] and all(r["id"].startswith("l-") for r in got)
    assert [json.loads(r["content"])["entry"] for r in subject_list_resources(measure, 0, "none", "l").collect()] == [[]]


def test_one_scan_for_many_definitions(model):
    text = HEAD + "define a: exists [Observation: hb]\ndefine b: exists [Observation: wt]\ndefine c: Count([Observation])\ndefine all: a and b and c > 1"
    plan = Compiler(model, text).plan(["all"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_measure_report(model):
    text = HEAD + "define Cohort: exists [Observation]\ndefine Newest: First([Observation: hb] O sort by effective desc).value"
    group = Group({"initial-population": "Cohort"}, (Stratifier("city", "City"), Stratifier("value", "Newest"), Stratifier("both", components=(("g", "City"), ("v", "Newest")))))
    got = {(r["stratifier"], r["stratum"]): r["count"] for r in Measure(model, text, [group]).report().collect()}
    assert got[None, None] == 3 and got["city", "Jena"] == 1 and got["city", "null"] == 1
    assert got["value", "13.50000000 g/dL"] == 1 and got["both", "null|null"] == 1 and len(got) == 10
    m = Measure(model, text, [Group({"initial-population": "Cohort"})], {})
    assert sorted(r["id"] for r in m.subjects(0, "initial-population").collect()) == ["0", "1", "2"]


def test_report_resources(model):
    measure = Measure(model, HEAD + "define Cohort: exists [Observation: hb]", [Group({"initial-population": "Cohort"}, (Stratifier("city", "City"),))])
    got = report_resource(measure, "urn:m")
    assert got["group"][0]["population"] == [{"code": {"coding": [{"code": "initial-population"}]}, "count": 2}]
    assert [s["value"]["text"] for s in got["group"][0]["stratifier"][0]["stratum"]] == ["Jena", "Leipzig"]
    row = subject_list_resources(measure, 0, "initial-population", "l").first()
    assert [e["item"]["reference"] for e in json.loads(row["content"])["entry"]] == ["Patient/0", "Patient/1"]


def test_population_of_resources(model):
    group = Group({"initial-population": "All"}, (Stratifier("status", "Status"),), "Observation")
    got = {(r["stratifier"], r["stratum"]): r["count"] for r in Measure(model, HEAD + "define All: [Observation: hb]", [group]).report().collect()}
    assert got == {(None, None): 3, ("status", "final"): 3}


def test_parameters(model):
    text = HEAD + "define x: Patient.gender = Gender"
    count = lambda p: Measure(model, text, [Group({"p": "x"})], p).report().first()["count"]
    assert (count({}), count({"Gender": "female"}), count({"Gender": "other"})) == (1, 2, 0)
    with pytest.raises(CqlError):
        count({"Nothing": 1})
    listed = HEAD + "parameter Genders List<String>\nparameter Both\ndefine x: Patient.gender in Genders\ndefine y: Patient.gender = Both.first and Both.second > 1"
    many = lambda e, p: Measure(model, listed, [Group({"p": e})], p).report().first()["count"]
    assert (many("x", {"Genders": ["male", "female"]}), many("x", {"Genders": ["other"]}), many("y", {"Both": {"first": "male", "second": 2}})) == (3, 0, 1)
    with pytest.raises(CqlError):
        count({"Gender": object()})


def test_ad_hoc_expression(model):
    got = {r["id"]: r["value"] for r in evaluate_expression(model, "Count([Observation])").collect()}
    assert got == {"0": 2, "1": 1, "2": 1}


@pytest.mark.parametrize("text", ["define x: from [A] a, [B] b return a", "define x: [Nothing]", "define x: y", "define x: x", "define x: Frobnicate(1)", "define x: exists [Observation: nothing]", "define x: 1 +"])
def test_errors(model, text):
    with pytest.raises(CqlError):
        Compiler(model, text).plan(["x"])


def test_parser():
    assert parse_expression("1 + 2 * 3 = 7 and not false") == ("and", ("=", ("+", ("integer", 1), ("*", ("integer", 2), ("integer", 3))), ("integer", 7)), ("not", ("boolean", False)))
    lib = parse("library L version '1' codesystem \"c s\": 'u' code c: '1' from \"c s\" display 'd' valueset v: 'w' define function f(a Integer, b List<String>): a")
    assert lib.codes == {"c": ("u", "1")} and lib.valuesets == {"v": "w"} and ("f", 2) in lib.functions
    with pytest.raises(CqlError):
        parse("define x 1")
