"""Ingestion end to end: golden counts, replay, guards, folder source, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.plans import engine
from tessera.sources import folder, snapshots
from tessera.sources.store import Conflict, Store
from tessera.streaming.ingest import ingest_folder

SUBNET = {"SubnetId": "subnet-1", "VpcId": "vpc-1"}
RESOURCES = [
    ("AWS::EC2::VPC", "vpc-1", {"VpcId": "vpc-1"}),
    ("AWS::EC2::Subnet", "subnet-1", SUBNET),
    ("AWS::EC2::SecurityGroup", "sg-1", {"GroupId": "sg-1", "VpcId": "vpc-1"}),
    ("AWS::EC2::Instance", "i-1", {"InstanceId": "i-1", "VpcId": "vpc-1", "SubnetId": "subnet-1", "SecurityGroups": [{"GroupId": "sg-1"}], "State": {"Name": "running"}}),
    ("AWS::EC2::EIP", "eip-1", {"AllocationId": "eip-1", "InstanceId": "i-1"}),
    ("AWS::EC2::NatGateway", "nat-1", {"NatGatewayId": "nat-1", "NatGatewayAddresses": [{"AllocationId": "eip-1"}], "SubnetId": "subnet-1"}),
]


def arn(kind, rid):
    return f"arn:aws:ec2:us-east-1:111122223333:{kind.split('::')[-1].lower()}/{rid}"


def write(root, resources, at, lifecycle="active"):
    for kind, rid, payload in resources:
        body = {"resourceArn": arn(kind, rid), "resourceId": rid, "resourceType": kind, "accountId": "111122223333", "awsRegion": "us-east-1", "capturedAt": at, "payload": payload, "lifecycle": lifecycle}
        (root / f"{rid}-{at[11:13]}{lifecycle}.json").write_text(json.dumps(body, indent=1))


def drafts(spark, root):
    return snapshots.usable_keys(folder.entities(folder.envelopes(folder.read(spark, str(root))).where("problem is null"), "ns", "aws"))


def test_lifecycle_of_a_folder(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    def step(name, resources, at, **kw):
        (tmp_path / name).mkdir()
        write(tmp_path / name, resources, at, **kw)
        return engine.ingest(store, drafts(spark, tmp_path / name), name)["counts"]

    first = step("r1", RESOURCES, "2026-01-01T10:00:00Z")
    # subnet-vpc, group-vpc, instance-vpc, instance-subnet, instance-group, address-instance, gateway-address, gateway-subnet
    assert first == {"entities_created": 6, "entities_updated": 0, "entities_deleted": 0, "edges_created": 8, "edges_closed": 0}
    assert not any(engine.ingest(store, drafts(spark, tmp_path / "r1"), "r1")["counts"].values())
    assert not any(step("r2", RESOURCES, "2026-01-01T11:00:00Z").values())
    stopped = [(k, r, p | ({"State": {"Name": "stopped"}} if r == "i-1" else {})) for k, r, p in RESOURCES if r == "i-1"]
    assert step("r3", stopped, "2026-01-01T12:00:00Z")["entities_updated"] == 1
    gone = step("r4", [RESOURCES[4]], "2026-01-01T13:00:00Z", lifecycle="deleted")
    assert (gone["entities_deleted"], gone["edges_closed"]) == (1, 2)
    versions = store.table("entity_version").where("entity_type = 'AWS::EC2::Instance'").orderBy("version").select("version", "is_latest", F.col("properties")["State.Name"].alias("s")).collect()
    assert [tuple(v) for v in versions] == [(1, False, "running"), (2, True, "stopped")]
    assert store.table("edge").count() == 6 and store.table("edge", 1).count() == 8
    # a removed file deletes nothing, a return after deletion is a new version
    back = step("r5", [RESOURCES[4]], "2026-01-01T14:00:00Z")
    assert back["edges_created"] == 2 and store.table("entity_version").where("entity_type = 'AWS::EC2::EIP'").count() == 2


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({"accountId": "1"}, "invalid_resource_account"), ({"awsRegion": "EU!"}, "invalid_resource_region"), ({"resourceArn": "x"}, "invalid_resource_arn"), ({"resourceId": " "}, "invalid_resource_identity"),
        ({"accountId": "999922223333"}, "resource_arn_scope_mismatch"), ({"capturedAt": "soon"}, "invalid_capture_time"), ({"lifecycle": "gone"}, "invalid_resource_lifecycle"), ({"extra": 1}, "invalid_resource_envelope"),
        ({"payload": {"_scope": {}}}, "invalid_resource_object"), ({}, None),
    ],
)
def test_envelope_rules(spark, change, problem):
    body = {"resourceArn": arn("AWS::EC2::VPC", "vpc-1"), "resourceId": "vpc-1", "resourceType": "AWS::EC2::VPC", "accountId": "111122223333", "awsRegion": "us-east-1", "capturedAt": "2026-01-01T10:00:00Z", "payload": {"VpcId": "vpc-1"}} | change
    assert folder.envelopes(spark.createDataFrame([(json.dumps(body),)], "text string")).first().problem == problem


def test_store_guards(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    df = spark.range(3)
    store.commit("a", {"t": df}, {"n": 3}, 0, {"ns/src/k": 5})
    with pytest.raises(Conflict):
        store.commit("b", {"t": df}, {}, 0)
    with pytest.raises(Conflict):
        store.commit("c", {"t": df}, {}, 1, {"ns/src/k": 5})
    store.commit("d", {"t": spark.range(4)}, {}, 1, {"ns/src/k": 6})
    assert (store.table("t", 1).count(), store.table("t").count(), store.revision()) == (3, 4, 2)
    assert store.commit("a", {"t": df}, {}, 2)["revision"] == 1
    store.advance("s", None, "x")
    with pytest.raises(Conflict):
        store.advance("s", None, "y")
    store.advance("s", "x", "y")
    assert store.cursor("s") == "y"
    store.put_profile("p", 1, {"a": 1})
    with pytest.raises(Conflict):
        store.put_profile("p", 1, {"a": 2})
    assert store.profile("p") == {"a": 1} and store.profile("p", 2) is None


def test_crash_right_after_the_manifest_counts_once(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", RESOURCES, "2026-01-01T10:00:00Z")
    store = Store(spark, str(tmp_path / "store"))
    create = Store._create

    def dying(self, name, text):
        create(self, name, text)
        if name.startswith("manifest"):
            raise KeyboardInterrupt

    monkeypatch.setattr(Store, "_create", dying)
    with pytest.raises(KeyboardInterrupt):
        engine.ingest(store, drafts(spark, tmp_path / "in"), "r1")
    monkeypatch.setattr(Store, "_create", create)
    again = engine.ingest(store, drafts(spark, tmp_path / "in"), "r1")
    assert again["revision"] == store.revision() == 1 and not any(again["counts"].values())
    assert store.receipt("r1")["counts"]["edges_created"] == 8 and store.table("observation").count() == 6


def test_only_an_existing_file_is_a_conflict(spark, tmp_path):
    (tmp_path / "plain").write_text("a file where a folder is needed")
    store = Store(spark, str(tmp_path / "plain"))
    with pytest.raises(Exception) as e:
        store._create("a/b.json", "{}")
    assert not isinstance(e.value, Conflict)


def test_intermediates_need_a_shared_folder_and_can_be_released(spark):
    from types import SimpleNamespace

    from tessera import storage

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: None), sparkContext=SimpleNamespace(master="spark://head:7077"))
    with pytest.raises(RuntimeError):
        storage.shared_folder(far)
    kept = storage.materialise(spark.range(3), "numbers")
    assert kept.count() == 3
    storage.release(spark)
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0]).count()


def plain_drafts(spark, rows):
    """``(type, name, keys, additional, properties, lifecycle, day[, snapshot])`` rows as drafts."""
    shape = "entity_type string, name string, primary_key array<string>, additional_keys array<array<string>>, properties map<string,string>, lifecycle string, captured_at string, snapshot string"
    df = spark.createDataFrame([(*r, r[1] if len(r) < 8 else r[7])[:8] for r in rows], shape)
    return snapshots.usable_keys(df.withColumn("namespace", F.lit("ns")).withColumn("source", F.lit("s")).withColumn("captured_at", F.to_timestamp("captured_at")))


def heads(store):
    return {r.name: (r.version, r.deleted_at is not None) for r in store.table("entity_version").where("is_latest").collect()}


def test_identity_conflicts_and_observations_that_change_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    one = lambda name, props, day, life="active", snap=None, alt=(("alias",),): ("t", name, ["id"], [list(a) for a in alt], props, life, f"2026-01-{day:02d}", snap or name)
    run = lambda name, rows: engine.ingest(store, plain_drafts(spark, rows), name)
    run("r1", [one("a", {"id": "1", "alias": "x"}, 1), one("b", {"id": "2", "alias": "y"}, 1), one("c", {"id": "3"}, 1)])
    # a draft that is both stored chains at once is refused, with the other draft of its snapshot
    second = run("r2", [one("ab", {"id": "1", "alias": "y"}, 2, snap="s1"), one("c", {"id": "3", "v": "new"}, 2, snap="s1"), one("d", {"id": "4"}, 2)])
    assert second["outcomes"] == {"identity conflict": 2} and second["counts"]["entities_created"] == 1
    assert heads(store) == {"a": (1, False), "b": (1, False), "c": (1, False), "d": (1, False)}
    # older, disagreeing at one instant, deleting nothing
    third = run("r3", [one("a", {"id": "1", "alias": "x", "v": "old"}, 1), one("b", {"id": "2", "alias": "y", "v": "1"}, 3), one("b", {"id": "2", "alias": "y", "v": "2"}, 3), one("e", {"id": "5"}, 3, "deleted"), one("d", {"id": "4"}, 1)])
    assert third["outcomes"] == {"two contents at one time": 3, "ignored": 1, "stale": 1} and not any(third["counts"].values())
    # the alternate key of a deleted chain does not bring it back; its primary key does
    run("r4", [one("a", {"id": "1", "alias": "x"}, 4, "deleted")])
    run("r5", [one("f", {"id": "6", "alias": "x"}, 5)])
    assert heads(store)["a"] == (1, True) and heads(store)["f"] == (1, False)
    run("r6", [one("a", {"id": "1"}, 6)])
    assert heads(store)["a"] == (2, False)
    assert store.table("observation").count() == 3 + 3 + 5 + 1 + 1 + 1


def test_sweeps_orphans_and_woken_sources(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    one = lambda name, props, day, life="active": ("t" if "ref" not in name else "u", name, ["tid"] if "ref" not in name else ["uid"], [], props, life, f"2026-01-{day:02d}")
    run = lambda name, rows, **kw: engine.ingest(store, plain_drafts(spark, rows), name, **kw)
    scan = engine.Scan
    run("r1", [one(n, {"tid": n}, 1) for n in "abc"], scan=scan("k", 1))
    run("r2", [one("a", {"tid": "a"}, 2)], scan=scan("other", 1))
    late = run("r3", [one("ref", {"uid": "r", "tid": "z"}, 2)])  # names what is not there yet
    assert late["counts"]["edges_created"] == 0
    woken = run("r4", [one("z", {"tid": "z"}, 3)])  # its key wakes the source, which is not in this run
    assert woken["counts"]["edges_created"] == 1
    partial = run("r5", [one("b", {"tid": "b"}, 4)], scan=scan("k", 2, whole=False))
    assert partial["counts"]["entities_deleted"] == 0
    swept = run("r6", [one("b", {"tid": "b"}, 5)], scan=scan("k", 3))  # c is gone, a is held by the other collection
    assert swept["counts"]["entities_deleted"] == 1 and heads(store)["c"] == (1, True) and heads(store)["a"] == (1, False)
    with pytest.raises(Conflict):
        run("r7", [one("b", {"tid": "b"}, 6)], scan=scan("k", 2))
    chain = {r.name: r.chain_id for r in store.table("entity_version").where("is_latest").collect()}
    owned = spark.createDataFrame([(chain["z"], chain["ref"]), (chain["a"], chain["b"]), (chain["z"], chain["b"])], "parent string, child string")
    dead = run("r8", [one("z", {"tid": "z"}, 7, "deleted")], owned=owned)  # takes its only child along, not the one with another parent
    assert dead["counts"]["entities_deleted"] == 2 and heads(store)["ref"] == (1, True) and heads(store)["b"] == (1, False)
    assert dead["counts"]["edges_closed"] == 1 and store.table("edge").count() == 0


def test_streaming_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", RESOURCES, "2026-01-01T10:00:00Z")
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):  # the second run finds nothing new
        ingest_folder(store, str(tmp_path / "in"), "ns", "aws", str(tmp_path / "cp")).awaitTermination(120)
        assert store.table("edge").count() == 8 and store.revision() == 1


def test_snapshot_rules(spark):
    rows = [("acme", "ns", "s", "2026-01-01 00:00:00", True, None), ("other", "", "s", None, False, None), ("acme", "ns", "s", "2026-01-01 00:00:00", True, 4)]
    df = spark.createDataFrame(rows, "org_id string, namespace string, source string, captured_at string, complete boolean, sync_generation long").selectExpr(
        "org_id", "namespace", "source", "'n' as name", "'entities' as data_type", "'full' as snapshot_kind", "complete", "sync_generation", "if(sync_generation is null, null, named_struct('key', 'k', 'relationships_complete', false)) as collection",
        "to_timestamp(captured_at) as captured_at", "cast(null as string) as content", f"cast(array() as array<{snapshots.ENTITY}>) as entities",
    )
    assert [sorted(p.field for p in r.problems) for r in snapshots.problems(df, "acme").collect()] == [["collection"], ["captured_at", "namespace", "org_id"], []]
    pages = df.where("sync_generation = 4").union(df.where("sync_generation = 4").withColumn("sync_generation", F.lit(5).cast("long")))
    assert snapshots.collection_conflicts(pages).count() == 1


def test_children_and_schema(spark):
    df = spark.createDataFrame([("p", '[{"id":"1","port":"80"},{"x":1},{"id":"2"}]', {"port": "80", "mode": "x"})], "chain_id string, parts string, props map<string,string>")
    rows, edges = snapshots.children(df, "chain_id", "parts", "id", "Part")
    assert {r.chain_id for r in rows.collect()} == {"p/Part/1", "p/Part/2"} and edges.count() == 2
    rule = {"required": ["port", "name"], "properties": {"port": {"type": "integer", "maximum": 79}, "mode": {"enum": ["a"]}}}
    assert df.select(snapshots.schema_problems(F.col("props"), rule).alias("p")).first().p == ["name: required", "port: maximum", "mode: enum"]


def test_usable_keys_are_those_of_the_pairs_without_the_pairs(spark):
    """Forty observations and forty stored keys share one alternate key: no join gives their product."""
    import random

    from pyspark.sql import functions as F

    from tessera.operators import identity

    draw = random.Random(3)
    index = [(f"p{i}", f"c{i % 6}", True) for i in range(240)] + [(f"a{i % 4}", f"c{i}", False) for i in range(6)] + [("a9", "c7", False), ("p3", "c5", True)]
    heads = [(f"c{i}", None if i % 2 else 1) for i in range(8)]
    asked = [("a0", False, f"p{i}") for i in range(40)] + [("a2", False, f"p{i}") for i in range(0, 60, 5)] + [("a9", False, "p1"), ("p0", True, "p0"), ("a1", True, "a1"), ("p2", False, "p7")]
    asked += [(draw.choice(["a2", "a3", "p4"]), draw.random() < 0.2, f"p{draw.randrange(90)}") for _ in range(20)]
    asked = spark.createDataFrame(asked, "hash string, is_primary boolean, observed_primary string").distinct()
    index, heads = spark.createDataFrame(index, "hash string, chain_id string, is_primary boolean"), spark.createDataFrame(heads, "chain_id string, deleted_at int")
    stored = index.join(index.where("is_primary").select("chain_id", F.col("hash").alias("stored_primary")), "chain_id", "left").join(heads, "chain_id")
    want = identity.without_revived(asked.join(stored.drop("is_primary"), "hash")).select("hash", "chain_id").distinct()
    found = identity.usable(asked, index, heads)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    most = []

    def visit(node):
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            most.append(node.metrics().apply("numOutputRows").value())
        inner = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if "QueryStage" in node.nodeName() else None
        for child in [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]:
            visit(child)

    visit(found._jdf.queryExecution().executedPlan())
    assert most and max(most) <= asked.count() + index.count()
