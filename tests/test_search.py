"""Typed search on small tables, and terminology."""

import pytest
from pyspark.sql import functions as F

from cohortry.operators import navigate, search
from cohortry.operators.search import Param, Registry, SearchError
from cohortry.operators.terminology import Filter, Include, Terminology, ValueSet, valid_by_grammar, vcl


@pytest.fixture(scope="module")
def reg(spark):
    p = spark.createDataFrame([("a", "O'Neil", ["x|1", "y|2"], 1), ("b", "Smith", ["x|2"], 2), ("c", None, [], 3)], "id string, name string, codes array<string>, n int")
    o = spark.createDataFrame([("1", "a", "b"), ("2", "a", None), ("3", "c", "1")], "id string, who string, other string")
    token = lambda: F.transform("codes", lambda c: F.struct(F.split_part(c, F.lit("|"), F.lit(1)).alias("system"), F.split_part(c, F.lit("|"), F.lit(2)).alias("code")))
    ref = lambda t, c: lambda: F.when(F.col(c).isNotNull(), F.array(F.struct(F.lit(t).alias("type"), F.col(c).alias("id"))))
    return Registry(
        {"P": p, "O": o},
        {
            "P": {"code": Param("token", token), "name": Param("string", lambda: F.array("name")), "sound": Param("phonetic", lambda: F.array("name")), "n": Param("number", lambda: F.array(F.col("n").cast("decimal(28,8)")))},
            "O": {"who": Param("reference", ref("P", "who"), ("P",)), "other": Param("reference", ref("O", "other"), ("O", "P"))},
        },
        {"O": "who"},
        "P",
    )


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    "clauses, want",
    [
        ([("code", ["x|1"])], ["a"]), ([("code", ["2"])], ["a", "b"]), ([("code", ["x|"])], ["a", "b"]), ([("code", ["|2"])], []), ([("name", ["o neil"])], ["a"]), ([("sound", ["Smyth"])], ["b"]),
        ([("n", ["ge2"])], ["b", "c"]), ([("n", ["2"])], ["b"]), ([("_id", ["c", "a"])], ["a", "c"]), ([("_has:O:who:_id", ["3"])], ["c"]), ([("code", ["2"]), ("name", ["smi"])], ["b"]), ([], ["a", "b", "c"]),
    ],
)
def test_clauses(reg, clauses, want):
    assert ids(reg.search("P", clauses)) == want


def test_chains_and_compartments(reg):
    assert ids(reg.search("O", [("who.name", ["o'neil"])])) == ["1", "2"]
    assert ids(reg.search("O", [("who", ["P/c"])])) == ["3"]
    assert ids(reg.compartment_search("a", "O")) == ["1", "2"]
    with pytest.raises(SearchError, match="needs a type"):
        reg.search("O", [("other.name", ["x"])])


def test_errors(reg):
    for clause in (("zzz", ["1"]), ("n", ["ne1"]), ("n", ["x"]), ("name:exact", ["x"]), ("code:not", ["x"])):
        with pytest.raises(SearchError):
            reg.search("P", [clause])
    assert len(ids(reg.search("P", [("zzz", ["1"])], lenient=True))) == 3


def test_includes(reg):
    pairs = lambda df: sorted(tuple(r) for r in df.collect())
    assert pairs(reg.include(reg.tables["O"], "O", "O:who")) == [("P", "a"), ("P", "c")]
    assert pairs(reg.include(reg.search("O", [("_id", ["3"])]), "O", "O:other:O", iterate=True)) == [("O", "1"), ("O", "b")]
    assert ids(reg.rev_include(reg.search("P", [("_id", ["c"])]), "P", "O:who")) == ["3"]
    got = navigate.everything(reg, reg.tables["P"].select("id").where("id <> 'b'"))
    assert sorted((r["subject_id"], r["type"], r["id"]) for r in got.collect()) == [("a", "O", "1"), ("a", "O", "2"), ("a", "P", "a"), ("c", "O", "3"), ("c", "P", "c")]
    walk = navigate.graph(reg, reg.search("P", [("_id", ["c"])]), "P", [navigate.Link("P", "O", "who", backward=True), navigate.Link("O", "O", "other")])
    assert pairs(walk) == [("O", "1"), ("O", "3"), ("O", "b"), ("P", "c")]


def test_date_ranges():
    day = 86400
    assert search.date_range("1970") == (0, 365 * day - 1)
    assert search.date_range("1970-02") == (31 * day, 59 * day - 1)
    assert search.date_range("1970-01-01T00:00") == (0, 59)
    assert search.date_range("1970-01-01T02:00:00+02:00") == (0, 0)
    for bad in ("x", "1970-13", "70"):
        with pytest.raises(SearchError):
            search.date_range(bad)


@pytest.mark.parametrize("op, want", [("eq", "d"), ("ne", "abcef"), ("gt", "ef"), ("lt", "abc"), ("ge", "def"), ("le", "abcd"), ("sa", "f"), ("eb", "ab"), ("ap", "cde")])
def test_date_prefixes(spark, op, want):
    # Values around [10, 20]: before, touching before, overlapping the start, inside, overlapping the end, after.
    rows = [("a", 1, 5), ("b", 1, 9), ("c", 5, 15), ("d", 12, 15), ("e", 15, 25), ("f", 25, 30)]
    df = spark.createDataFrame(rows, "id string, lo long, hi long").withColumn("v", F.array(F.struct("lo", "hi")))
    got = "".join(ids(df.where(search.any_(F.col("v"), search.date_test(op, 10, 20)))))
    assert got == want


def test_pages_and_sorting(reg):
    rows, following = search.page(reg.tables["P"], 2)
    assert ids(rows) == ["a", "b"] and following() == "c"
    rows, following = search.page(reg.tables["P"], 2, "c")
    assert ids(rows) == ["c"] and following() is None
    assert [r["id"] for r in search.sort(reg.tables["P"], "-n", {"n": "n"}).collect()] == ["c", "b", "a"]
    with pytest.raises(SearchError):
        search.sort(reg.tables["P"], "-_id", {})
    clauses, result = search.parse_query("code=x|1,y&_sort=n&_count=5&name=a%20b")
    assert clauses == [("code", ["x|1", "y"]), ("name", ["a b"])] and result == {"_sort": ["n"], "_count": ["5"]}
    with pytest.raises(SearchError):
        search.parse_query("_sort=a,b")


@pytest.fixture(scope="module")
def terms(spark):
    concepts = spark.createDataFrame([("s", c, f"Display {c}", c != "d") for c in "abcde"], "system string, code string, display string, active boolean")
    edges = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("s", "b", "d"), ("s", "a", "e"), ("s", "e", "d")], "system string, parent string, child string")
    props = spark.createDataFrame([("s", "c", "kind", "x"), ("s", "d", "kind", "y")], "system string, code string, property string, value string")
    f = lambda *a: Include("s", filters=(Filter(*a),))
    sets = {
        "below": ValueSet("below", (f("concept", "descendent-of", "b"),)),
        "isa": ValueSet("isa", (f("concept", "is-a", "b"),), (Include("s", codes=("d",)),)),
        "kind": ValueSet("kind", (f("kind", "=", "x"),)),
        "exists": ValueSet("exists", (f("kind", "exists", "false"),)),
        "regex": ValueSet("regex", (f("code", "regex", "[ab]"),)),
        "parent": ValueSet("parent", (f("parent", "=", "b"),)),
        "nested": ValueSet("nested", (Include(value_sets=("below", "kind")),)),
        "loop": ValueSet("loop", (Include(value_sets=("loop",)),)),
    }
    return Terminology(concepts, edges, props, sets)


@pytest.mark.parametrize("name, want", [("below", "cd"), ("isa", "bc"), ("kind", "c"), ("exists", "abe"), ("regex", "ab"), ("parent", "cd"), ("nested", "c"), ("http://fhir.org/VCL?v1=(s)<<e", "de"), ("http://fhir.org/VCL?v1=(s)a;c", "ac")])
def test_expansion(terms, name, want):
    assert "".join(sorted(r["code"] for r in terms.expand(name).collect())) == want


def test_expansion_options(terms):
    every = ValueSet("all", (Include("s"),))
    codes = lambda df: "".join(sorted(r["code"] for r in df.collect()))
    assert codes(terms.expand(every, active_only=True)) == "abce"
    assert codes(terms.expand(every, text="play c")) == "c"
    assert codes(terms.expand(every, count=2)) == "ab"
    with pytest.raises(ValueError, match="itself"):
        terms.expand("loop")
    with pytest.raises(ValueError):
        vcl("http://fhir.org/VCL?v1=nonsense")


def test_validation(spark, terms):
    codes = spark.createDataFrame([("s", "c", "Display c"), ("s", "d", "wrong"), ("s", "a", "Display a"), ("s", "z", None)], "system string, code string, display string")
    got = {r["code"]: (r["result"], r["message"]) for r in terms.validate_code(codes, "below").collect()}
    assert got == {"c": (True, None), "d": (False, "wrong display"), "a": (False, "not in the value set"), "z": (False, "unknown code")}
    assert terms.lookup("s", "c").first()["value"] == "x"
    units = spark.createDataFrame([("mg/dL", True), ("kg.m/s2", True), ("10*3/uL", True), ("mg//", False), ("", False)], "c string, ok boolean")
    assert all(r["ok"] == r["v"] for r in units.withColumn("v", valid_by_grammar("http://unitsofmeasure.org", F.col("c"))).collect())
    tags = spark.createDataFrame([("en-US", True), ("de", True), ("x", False)], "c string, ok boolean")
    assert all(r["ok"] == r["v"] for r in tags.withColumn("v", valid_by_grammar("urn:ietf:bcp:47", F.col("c"))).collect())


def test_pages_show_one_time(spark):
    def at(t):
        t = 2 if t is None else t
        rows = [(c,) for c in ("abcdef" if t == 1 else "abxcdef")]
        return Registry({"P": spark.createDataFrame(rows, "id string")}, {"P": {}}, at=at, t=t)

    first = search.search_page(at(1), "P", "__t=1&_count=2")
    assert ids(first.matches) == ["a", "b"] and first.previous() is None
    second = search.search_page(at(2), "P", first.next())  # the store has moved on
    assert ids(second.matches) == ["c", "d"] and "__t=1" in second.next()
    third = search.search_page(at(2), "P", second.next())
    assert ids(third.matches) == ["e", "f"] and third.next() is None
    assert ids(search.search_page(at(2), "P", third.previous()).matches) == ["c", "d"]
    assert ids(search.search_page(at(2), "P", second.previous()).matches) == ["a", "b"]
    assert "x" in ids(search.search_page(at(2), "P", "").matches)


def test_escapes_and_texts(reg):
    assert search.parse_query("code=a%5C,b,c%5C%5C")[0] == [("code", ["a\\,b", "c\\\\"])]
    assert search.split_escaped("a\\|b|c", "|") == ["a\\|b", "c"] and search.unescape("a\\|b\\$") == "a|b$"
    fields = {"P": {"id": lambda: F.col("id"), "name": lambda: F.col("name")}}
    assert [tuple(r) for r in navigate.graphql(reg, '{ PList(code: "x|1") { key: id name } }', fields).collect()] == [("a", "O'Neil")]
    for bad in ("{ PList { nothing } }", "{ QList { id } }", "mutation { x }"):
        with pytest.raises(SearchError):
            navigate.graphql(reg, bad, fields)
    with pytest.raises(SearchError, match="identifiers"):
        reg.search("O", [("who:identifier", ["x"])])


def test_everything_is_refused_or_paged(reg, monkeypatch):
    monkeypatch.setattr(navigate, "MAX_EVERYTHING", 2)
    with pytest.raises(SearchError, match="more than 2"):
        navigate.everything_page(reg, "a")
    rows, following = navigate.everything_page(reg, "a", 2)
    assert [tuple(r) for r in rows.collect()] == [("O", "1"), ("O", "2")] and following() == 2
    rows, following = navigate.everything_page(reg, "a", 2, 2)
    assert [tuple(r) for r in rows.collect()] == [("P", "a")] and following() is None
