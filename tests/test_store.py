"""The version store: transactions, preconditions, integrity, time travel, purge; and streams of its changes."""

import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cohortry.operators import snapshots
from cohortry.sources import resources
from cohortry.sources import store as store_module
from cohortry.sources.store import Command, Conflict, Store
from cohortry.streaming import changes


def doc(type_, id_, **more):
    return json.dumps({"resourceType": type_, "id": id_, **more})


def put(type_, id_, **more):
    return Command("put", type_, id_, doc(type_, id_, **more))


def at(n):
    return datetime(2024, 1, n)


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.transact([put("Patient", "0", gender="male"), put("Observation", "o", subject={"reference": "Patient/0"}, status="final")], at(1))
    return s


def ids(df):
    return sorted((r["type"], r["id"]) for r in df.collect())


def test_versions_and_time_travel(store):
    t = store.transact([put("Patient", "0", gender="female"), put("Patient", "1")], at(2))
    assert t == 2 == store.basis_t()
    assert ids(store.as_of(1)) == [("Observation", "o"), ("Patient", "0")]
    now = {r["id"]: r for r in store.as_of().where("type = 'Patient'").collect()}
    assert json.loads(now["0"]["content"])["gender"] == "female" and now["0"]["num_changes"] == 2
    assert [r["t"] for r in store.history("Patient", "0").collect()] == [2, 1]
    assert ids(store.as_of(since=1)) == [("Patient", "0"), ("Patient", "1")]
    assert {r["type"]: r["total"] for r in store.totals().collect()} == {"Patient": 2, "Observation": 1}
    assert store.t_at(datetime(2024, 1, 1, 12)) == 1
    assert snapshots.changes(store.versions(), 2).count() == 2


def test_identical_put_makes_no_version(store):
    store.transact([put("Patient", "0", gender="male")], at(2))
    assert store.history("Patient", "0").count() == 1


def test_preconditions(store):
    with pytest.raises(Conflict):
        store.transact([Command("put", "Patient", "0", doc("Patient", "0"), if_match=7)], at(2))
    with pytest.raises(Conflict):
        store.transact([Command("put", "Patient", "0", doc("Patient", "0"), if_none_match="*")], at(3))
    with pytest.raises(Conflict):
        store.transact([Command("create", "Patient", "0", doc("Patient", "0"))], at(4))
    with pytest.raises(Conflict, match="duplicate"):
        store.transact([put("Patient", "5"), put("Patient", "5")], at(5))
    assert store.transactions().where("not success").count() == 4
    assert store.transact([Command("put", "Patient", "0", doc("Patient", "0", x=1), if_match=1)], at(6)) == 6


def test_conditional_create_and_delete(store):
    male = F.get_json_object("content", "$.gender") == "male"
    store.transact([Command("create", "Patient", "9", doc("Patient", "9"), if_none_exist=male)], at(2))
    assert ("Patient", "9") not in ids(store.as_of())
    store.transact([Command("create", "Patient", "9", doc("Patient", "9", gender="male"), if_none_exist=F.lit(False))], at(3))
    with pytest.raises(Conflict, match="several"):
        store.transact([Command("create", "Patient", "8", doc("Patient", "8"), if_none_exist=male)], at(4))
    store.transact([Command("delete", "Patient", where=F.col("id") == "9"), Command("delete", "Patient", where=F.lit(False))], at(5))
    assert ("Patient", "9") not in ids(store.as_of()) and ("Patient", "9") in ids(store.as_of(4))


def test_referential_integrity(store):
    with pytest.raises(Conflict, match="does not exist"):
        store.transact([put("Observation", "p", subject={"reference": "Patient/404"})], at(2))
    with pytest.raises(Conflict, match="is referenced"):
        store.transact([Command("delete", "Patient", "0")], at(3))
    store.transact([Command("delete", "Patient", "0"), Command("delete", "Observation", "o")], at(4))
    assert ids(store.as_of()) == []


def test_purge(store):
    store.transact([put("Patient", "0", gender="other")], at(2))
    store.transact([Command("delete-history", "Patient", "0")], at(3))
    assert [r["t"] for r in store.history("Patient", "0").collect()] == [2]
    assert store.history("Patient", "0", t=2).count() == 2  # as it was before the purge
    store.transact([Command("patient-purge", "Patient", "0")], at(4))
    assert ids(store.as_of()) == []


def test_bundles_and_references(spark, tmp_path):
    bundle = {"resourceType": "Bundle", "entry": [{"resource": json.loads(doc("Observation", "o", subject={"reference": "Patient/0"}))}, {"resource": json.loads(doc("Patient", "0", birthDate="2000")), "request": {"method": "POST"}}]}
    (tmp_path / "b.json").write_text(json.dumps(bundle, indent=1))
    got = resources.read_bundles(spark, str(tmp_path / "b.json"))
    assert sorted((r["position"], r["method"], r["type"], r["id"]) for r in got.collect()) == [(0, "PUT", "Observation", "o"), (1, "POST", "Patient", "0")]
    assert [tuple(r) for r in resources.references(got).collect()] == [("Observation", "o", "Patient", "0")]
    assert resources.typed(got, "Patient").select("birthDate").first()[0] == "2000"
    resources.write_ndjson(got, str(tmp_path / "nd"))
    again = resources.read_ndjson(spark, str(tmp_path / "nd"))
    assert ids(again) == ids(got)
    assert json.loads(resources.summary(again.where("type = 'Patient'"), ["gender"]).first()["content"]).get("birthDate") is None


def test_change_feed(store, tmp_path):
    store.transact([put("Patient", "1"), put("Patient", "2")], at(2))
    seen = []
    run = lambda: changes.subscribe(store, lambda df, t: seen.append((t, sorted(r["id"] for r in df.collect()))), str(tmp_path / "ck"), "Patient").awaitTermination()
    run()
    assert seen == [(1, ["0"]), (2, ["1", "2"])]
    store.transact([put("Observation", "x")], at(3))
    store.transact([put("Patient", "2", gender="male")], at(4))
    run()
    assert seen[2:] == [(4, ["2"])]


def test_crash_between_writes_leaves_nothing(store, tmp_path, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(Store, "_log", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            store.transact([put("Patient", "7"), Command("delete-history", "Patient", "0")], at(2))
    assert store.basis_t() == 1 and ("Patient", "7") not in ids(store.as_of())
    assert store.transact([put("Patient", "8")], at(3)) == 2  # the t is used again
    assert ("Patient", "7") not in ids(store.as_of()) and ids(store.changes(2)) == [("Patient", "8")]
    seen = []
    changes.subscribe(store, lambda df, t: seen.extend(ids(df)), str(tmp_path / "ck")).awaitTermination()
    assert ("Patient", "7") not in seen and ("Patient", "8") in seen


def test_keep_hold_and_versions(store):
    content = doc("Patient", "0", gender="male")
    same = hashlib.sha256(content.encode()).hexdigest()
    assert store.transact([Command("keep", "Patient", "0", hash=same), Command("hold", "Patient", "0x")], at(2)) == 2
    assert store.history("Patient", "0").count() == 1
    for bad in (Command("keep", "Patient", "0", hash="x"), Command("keep", "Patient", "0", hash=same, if_match=9), Command("keep", "Patient", "none", hash=same)):
        with pytest.raises(Conflict):
            store.transact([bad], at(3))
    store.transact([Command("put", "Patient", "0", doc("Patient", "0", gender="x"), if_match=(1, 99))], at(4))
    store.transact([Command("delete", "Observation", "o")], at(5))
    with pytest.raises(Conflict):  # it has versions, though deleted
        store.transact([Command("put", "Observation", "o", doc("Observation", "o"), if_none_match="*")], at(6))
    t = store.basis_t()
    assert store.read("Observation", "o").count() == 0 and store.vread("Observation", "o", 1).first()["op"] == "put"
    assert json.loads(store.read("Patient", "0").first()["content"])["gender"] == "x" and json.loads(store.read("Patient", "0", 1).first()["content"])["gender"] == "male"
    assert store.sync(t).count() == 1
    with pytest.raises(TimeoutError):
        store.sync(t + 1, 0.3)


def test_a_table_of_commands(spark, store):
    rows = [("put", "Patient", str(i), doc("Patient", str(i), n=i)) for i in range(50)] + [("delete", "Observation", "o", None)]
    assert store.apply(spark.createDataFrame(rows, "op string, type string, id string, content string"), at(2)) == 2
    assert store.as_of().count() == 50 and store.read("Patient", "0").first()["num_changes"] == 2
    store.apply(spark.createDataFrame(rows, "op string, type string, id string, content string"), at(3))
    assert store.changes(3).isEmpty()  # nothing new
    with pytest.raises(Conflict, match="Patient/3 is not at version 1"):
        store.apply(spark.createDataFrame([("put", "Patient", "3", doc("Patient", "3"), [1])], "op string, type string, id string, content string, if_match array<long>"), at(4))


def test_conditional_delete_of_several(store, monkeypatch):
    store.transact([put("Patient", str(i), gender="x") for i in range(10, 14)], at(2))
    x = F.get_json_object("content", "$.gender") == "x"
    with pytest.raises(Conflict, match="several"):
        store.transact([Command("delete", "Patient", where=x)], at(3))
    monkeypatch.setattr(store_module, "MAX_DELETES", 3)
    with pytest.raises(Conflict, match="more than 3"):
        store.transact([Command("delete", "Patient", where=x, allow_multiple=True)], at(4))
    monkeypatch.setattr(store_module, "MAX_DELETES", 4)
    store.transact([Command("delete", "Patient", where=x, allow_multiple=True)], at(5))
    assert ids(store.as_of()) == [("Observation", "o"), ("Patient", "0")]


def test_a_damaged_store_is_not_empty(spark, tmp_path):
    (tmp_path / "s" / "transactions").mkdir(parents=True)
    (tmp_path / "s" / "transactions" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception):  # noqa: B017
        Store(spark, str(tmp_path / "s")).basis_t()


def test_a_log_of_bundles_is_applied_once(spark, store, tmp_path):
    entry = lambda *r: json.dumps({"entry": [{"resource": json.loads(doc(*x))} for x in r]})
    log = [(1, at(1), entry(("Patient", "no"))), (2, at(2), entry(("Patient", "5"))), (3, at(3), entry(("Patient", "6"), ("Patient", "6"))), (4, at(4), entry(("Patient", "7")))]
    spark.createDataFrame(log, "t long, instant timestamp, commands string").write.parquet(str(tmp_path / "log"))
    for k in (1, 2):  # the second checkpoint is new: all is read again
        stream = spark.readStream.schema("t long, instant timestamp, commands string").parquet(str(tmp_path / "log"))
        changes.kafka_subscribe(store, stream, str(tmp_path / f"ck{k}")).awaitTermination()
        assert store.basis_t() == 4 and [i for _, i in ids(store.as_of())] == ["o", "0", "5", "7"]


def test_upsert_stream_survives_replay(spark, store, tmp_path):
    store.transact([put("Patient", "0", gender="female")], at(2))
    out = str(tmp_path / "state")
    handle = changes.upsert_into(out, ["type", "id"], "t")
    changes.subscribe(store, handle, str(tmp_path / "ck2")).awaitTermination()
    handle(store.changes(2), 2)
    got = {(r["type"], r["id"]): r["t"] for r in changes.current(spark, out, ["type", "id"], "t").collect()}
    assert got == {("Patient", "0"): 2, ("Observation", "o"): 1}


def test_commands_are_evaluated_once(spark, tmp_path):
    store, seen = Store(spark, str(tmp_path / "s")), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(n):
        seen.add(1)
        return str(n)

    rows = spark.range(20).select(F.lit("put").alias("op"), F.lit("Patient").alias("type"), key("id").alias("id"), F.lit("{}").alias("content"))
    assert [store.apply(rows, at(n)) for n in (1, 2)] == [1, 2] and seen.value == 40
    assert store.history().count() == 20


def test_what_no_query_asks_for_is_not_joined_or_read(spark, store, tmp_path):
    assert "LeftOuter" not in store.versions()._jdf.queryExecution().optimizedPlan().toString()  # nothing was purged
    out = str(tmp_path / "state")
    changes.subscribe(store, changes.upsert_into(out, ["type", "id"], "t"), str(tmp_path / "ck")).awaitTermination()
    now = changes.current(spark, out, ["type", "id"], "t")
    assert sorted(now.columns) == sorted(store.versions().columns) and now.where("id = 'o'").first()["content"] is not None
    assert "content" not in now.select("id", "t")._jdf.queryExecution().executedPlan().toString()


def test_references_of_older_versions_and_of_what_goes_too_hold_nothing(store):
    store.transact([put("Observation", "p", subject={"reference": "Patient/0"}), put("Observation", "o")], at(2))
    with pytest.raises(Conflict, match="Patient/0 is referenced"):
        store.transact([Command("delete", "Patient", "0")], at(3))
    store.transact([Command("delete", "Patient", "0"), Command("delete", "Observation", "p")], at(4))
    with pytest.raises(Conflict, match="Patient/0 does not exist"):
        store.transact([put("Observation", "q", subject={"reference": "Patient/0"})], at(5))
    assert ids(store.as_of()) == [("Observation", "o")]
