"""Libraries in the expression language's JSON form, as the syntax trees that the compiler takes."""

from __future__ import annotations

import json

from cohortry.plans.cql_parser import CqlError, Library

_BINARY = {
    "And": "and", "Or": "or", "Xor": "xor", "Implies": "implies", "Equal": "=", "NotEqual": "!=", "Equivalent": "~", "Less": "<", "Greater": ">", "LessOrEqual": "<=", "GreaterOrEqual": ">=", "Add": "+", "Subtract": "-",
    "Multiply": "*", "Divide": "/", "TruncatedDivide": "div", "Modulo": "mod", "Power": "^", "Union": "union", "Intersect": "intersect", "Except": "except", "Concatenate": "&",
}
_TIMING = {
    "In": "in", "Contains": "contains", "Includes": "includes", "IncludedIn": "includedin", "ProperIncludes": "properincludes", "ProperIncludedIn": "properincludedin", "ProperContains": "propercontains", "ProperIn": "properin",
    "Before": "before", "After": "after", "SameAs": "sameas", "SameOrBefore": "sameorbefore", "SameOrAfter": "sameorafter", "Overlaps": "overlaps", "OverlapsBefore": "overlapsbefore", "OverlapsAfter": "overlapsafter",
    "Starts": "starts", "Ends": "ends", "Meets": "meets", "MeetsBefore": "meetsbefore", "MeetsAfter": "meetsafter",
}
_UNARY = {"Not": "not", "IsNull": "isnull", "IsTrue": "istrue", "IsFalse": "isfalse", "Negate": "negate"}
_CALLS = {"Start": "StartOf", "End": "EndOf", "Width": "WidthOf", "Successor": "SuccessorOf", "Predecessor": "PredecessorOf", "DateFrom": "DateFrom"}
_ARGS = ("operand", "source", "substring", "string", "stringToSplit", "separator", "stringToSub", "startIndex", "length", "pattern", "element", "precision")


def local(name: str) -> str:
    """A qualified type name without its namespace."""
    return name.rpartition("}")[2]


def library(elm: str | dict) -> Library:
    root = json.loads(elm) if isinstance(elm, str) else elm
    root = root.get("library", root)
    items = lambda key: root.get(key, {}).get("def", [])
    lib = Library(root.get("identifier", {}).get("id", ""))
    lib.codesystems = {d["name"]: d["id"] for d in items("codeSystems")}
    lib.valuesets = {d["name"]: d["id"] for d in items("valueSets")}
    lib.codes = {d["name"]: (lib.codesystems[d["codeSystem"]["name"]], d["id"]) for d in items("codes")}
    for d in items("parameters"):
        kind = d.get("parameterTypeSpecifier", {}).get("name")
        lib.parameters[d["name"]] = (local(kind) if kind else None, tree(d["default"]) if "default" in d else None)
    for d in items("statements"):
        if d.get("type") == "FunctionDef":
            names = [o["name"] for o in d.get("operand", [])]
            lib.functions[d["name"], len(names)] = (names, tree(d["expression"]))
        elif d["expression"]["type"] != "SingletonFrom" or d["name"] != d.get("context"):
            lib.defines[d["name"]] = (d.get("context", "Unfiltered"), tree(d["expression"]))
    return lib


def tree(e: dict) -> tuple:
    """The syntax tree of an expression."""
    t = e["type"]
    operands = e.get("operand", [])
    args = [tree(o) for o in (operands if isinstance(operands, list) else [operands])]
    if t in _BINARY:
        return (_BINARY[t], *args)
    if t in _TIMING:
        return (_TIMING[t], *args, e.get("precision", "").lower() or None)
    if t in _UNARY:
        return (_UNARY[t], args[0])
    if t == "Literal":
        kind, v = local(e["valueType"]), e.get("value")
        return {"Boolean": ("boolean", v == "true"), "String": ("string", v)}.get(kind) or (("decimal", v) if kind == "Decimal" else ("integer", int(v)))
    if t == "Null":
        return ("null",)
    if t == "Quantity":
        return ("quantity", str(e["value"]), e.get("unit", "1"))
    if t in ("ExpressionRef", "ParameterRef", "CodeRef", "ValueSetRef", "AliasRef", "OperandRef", "IdentifierRef", "ConceptRef"):
        return ("ref", e["name"])
    if t == "Property":
        source = tree(e["source"]) if "source" in e else ("ref", e["scope"])
        for name in e["path"].split("."):
            source = ("property", source, name)
        return source
    if t == "Retrieve":
        context = e.get("context")
        if context is not None and context["type"] != "ExpressionRef":
            raise CqlError("the context of a retrieve is another expression")
        return ("retrieve", local(e["dataType"]), e.get("codeProperty"), tree(e["codes"]) if "codes" in e else None, context["name"] if context else None)
    if t in ("InValueSet", "InCodeSystem"):
        ref = e.get("valueset") or e["codesystem"]
        return ("in", tree(e["code"]), ("ref", ref["name"]), None)
    if t == "Instance":
        return ("instance", local(e["classType"]), [(x["name"], tree(x["value"])) for x in e.get("element", [])])
    if t == "Query":
        if len(e["source"]) > 1:
            raise CqlError("queries have one source")
        relations = [(r["type"].lower(), tree(r["expression"]), r["alias"], tree(r["suchThat"])) for r in e.get("relationship", [])]
        ret, sort = e.get("return"), None
        if "sort" in e:
            by = e["sort"]["by"][0]  # only the first item counts
            key = ("ref", by["path"]) if by["type"] == "ByColumn" else tree(by["expression"]) if by["type"] == "ByExpression" else None
            sort = (key, by["direction"] in ("desc", "descending"))
        return ("query", tree(e["source"][0]["expression"]), e["source"][0]["alias"], relations, tree(e["where"]) if "where" in e else None, tree(ret["expression"]) if ret else None, ret.get("distinct", True) if ret else True, sort)
    if t == "Interval":
        return ("interval", tree(e["low"]), tree(e["high"]), e.get("lowClosed", True), e.get("highClosed", True))
    if t == "List":
        return ("list", [tree(x) for x in e.get("element", [])])
    if t == "Tuple":
        return ("tuple", [(x["name"], tree(x["value"])) for x in e.get("element", [])])
    if t == "If":
        return ("if", tree(e["condition"]), tree(e["then"]), tree(e["else"]))
    if t == "Case":
        return ("case", tree(e["comparand"]) if "comparand" in e else None, [(tree(i["when"]), tree(i["then"])) for i in e["caseItem"]], tree(e["else"]))
    if t in ("As", "Is"):
        kind = e.get("strictType") or e.get("asType") or e.get("isType") or e.get("asTypeSpecifier", e.get("isTypeSpecifier", {})).get("name", "")
        return (t.lower(), args[0], local(kind))
    if t == "Exists":
        return ("call", "Exists", args)
    if t in ("DurationBetween", "DifferenceBetween"):
        return (t.removesuffix("Between").lower(), *args, e["precision"].lower())
    if t == "DateTimeComponentFrom":
        return ("component", args[0], e["precision"].lower())
    if t == "CalculateAgeAt":
        return ("duration", *args, e["precision"].lower())
    if t in ("Date", "DateTime"):
        return ("call", t, [tree(e[k]) for k in ("year", "month", "day", "hour", "minute", "second", "millisecond") if k in e])
    if t == "FunctionRef":
        return ("call", e["name"], args)
    rest = args or [tree(e[k]) for k in _ARGS if isinstance(e.get(k), dict)]
    return ("call", _CALLS.get(t, t), rest)
