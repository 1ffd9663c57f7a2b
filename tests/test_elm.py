"""Libraries in JSON form give the same plans as their text."""

import json

from cohortry.plans.cql import Compiler
from cohortry.plans.elm import library
from tests.test_cql import model  # noqa: F401

FHIR = "{http://hl7.org/fhir}"
SYS = "{urn:hl7-org:elm-types:r1}"


def lit(kind, v):
    return {"type": "Literal", "valueType": SYS + kind, "value": v}


RETRIEVE = {"type": "Retrieve", "dataType": FHIR + "Observation", "codeProperty": "code", "codes": {"type": "ToList", "operand": {"type": "CodeRef", "name": "hb"}}}
ELM = {
    "library": {
        "identifier": {"id": "Test"},
        "codeSystems": {"def": [{"name": "s", "id": "s"}]},
        "codes": {"def": [{"name": "hb", "id": "hb", "codeSystem": {"name": "s"}}]},
        "parameters": {"def": [{"name": "Gender", "parameterTypeSpecifier": {"name": SYS + "String"}, "default": lit("String", "male")}]},
        "statements": {
            "def": [
                {"name": "Patient", "context": "Patient", "expression": {"type": "SingletonFrom", "operand": {"type": "Retrieve", "dataType": FHIR + "Patient"}}},
                {"name": "a", "context": "Patient", "expression": {"type": "Exists", "operand": RETRIEVE}},
                {
                    "name": "b",
                    "context": "Patient",
                    "expression": {
                        "type": "Exists",
                        "operand": {
                            "type": "Query",
                            "source": [{"alias": "O", "expression": RETRIEVE}],
                            "where": {"type": "Greater", "operand": [{"type": "Property", "scope": "O", "path": "value"}, {"type": "Quantity", "value": 100, "unit": "g/L"}]},
                        },
                    },
                },
                {"name": "c", "context": "Patient", "expression": {"type": "And", "operand": [{"type": "Equal", "operand": [{"type": "Property", "path": "gender", "source": {"type": "ExpressionRef", "name": "Patient"}}, {"type": "ParameterRef", "name": "Gender"}]}, {"type": "ExpressionRef", "name": "a"}]}},
                {"name": "d", "context": "Patient", "expression": {"type": "If", "condition": {"type": "ExpressionRef", "name": "c"}, "then": lit("Integer", "1"), "else": {"type": "Null"}}},
                {"name": "e", "context": "Patient", "expression": {"type": "In", "operand": [lit("Integer", "3"), {"type": "Interval", "low": lit("Integer", "1"), "high": lit("Integer", "3"), "highClosed": False}]}},
                {"name": "f", "context": "Patient", "expression": {"type": "Greater", "operand": [{"type": "CalculateAgeAt", "precision": "Year", "operand": [{"type": "Property", "path": "birthDate", "source": {"type": "ExpressionRef", "name": "Patient"}}, {"type": "Date", "year": lit("Integer", "2020"), "month": lit("Integer", "1"), "day": lit("Integer", "1")}]}, lit("Integer", "18")]}},
                {"name": "g", "context": "Patient", "type": "FunctionDef", "operand": [{"name": "x"}], "expression": {"type": "Add", "operand": [{"type": "OperandRef", "name": "x"}, lit("Integer", "1")]}},
                {"name": "h", "context": "Patient", "expression": {"type": "FunctionRef", "name": "g", "operand": [lit("Integer", "4")]}},
            ]
        },
    }
}


def test_json_library(model):  # noqa: F811
    got = {r["id"]: tuple(r)[1:] for r in Compiler(model, library(json.dumps(ELM))).plan(list("abcdefh")).collect()}
    assert got["0"] == (True, True, True, 1, False, True, 5)
    assert got["1"] == (True, True, False, None, False, False, 5)
    assert got["2"] == (False, False, False, None, False, True, 5)
