import json

import pytest
from pyspark.sql import functions as F

from cratewise.operators import merge as M
from cratewise.operators import quality as Q
from cratewise.operators import skew as K
from cratewise.operators import star as R
from cratewise.operators.normalize import normalize, normalize_map
from cratewise.plans.refresh import refresh
from cratewise.sources import catalog as L
from cratewise.sources import documents as O
from cratewise.sources import snapshot as S

HEADER = {"_metadata": {"extraction_timestamp": "t0", "nixpkgs_branch": "main", "total_packages": 3}}
LINUX = {
    "attrPath": ["pkgs", "foo", "x86_64-linux"],
    "name": "foo-1.2",
    "drvPath": "/d/1",
    "outputs": {"out": "/o"},
    "inputDrvs": {"/d/3": {}, "/d/none": {}, "/d/1": {}},
    "meta": {
        "description": 5,
        "license": "mit",
        "platforms": ["x86_64-linux", {"cpu": 1}, *[f"p{i:02d}" for i in range(30)]],
        "maintainers": [{"name": "Ann", "email": "", "github": "ann"}, {"name": ""}, "Bob", None],
        "available": None,
        "outputsToInstall": ["out", 5],
    },
}
DARWIN = {
    "attrPath": ["pkgs", "foo", "x86_64-darwin"],
    "name": "foo-1.2",
    "drvPath": "/d/2",
    "meta": {
        "description": "  A tool ",
        "license": [{"shortName": "gpl", "free": True, "redistributable": "yes"}, "bsd", None, 5],
        "platforms": ["x86_64-darwin"],
        "maintainers": [{"name": "Ann", "email": "", "github": "ann", "githubId": 7}, {"name": "Cy", "email": "", "github": ""}],
        "category": "Tools.Text",
        "broken": 1,
    },
}
BAR = {"attrPath": ["pkgs", "bar"], "name": "bar-2", "drvPath": "/d/3", "meta": None}
ODD = [
    {"name": "unknown"},
    {"name": ""},
    {"name": 5},
    {"drvPath": "/d/9"},
    {"name": "odd-1", "meta": []},
    {"name": "odd-2", "attrPath": ["a", 1]},
    [1],
    7,
]


def text(rows):
    return [r if isinstance(r, str) else json.dumps(r) for r in rows]


@pytest.fixture(scope="module")
def snapshot(spark):
    lines = text([HEADER, "", LINUX, DARWIN, BAR, *ODD, '{"name":"cut-1"', "  "])
    return S.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))


@pytest.fixture(scope="module")
def packages(snapshot):
    return normalize(snapshot.records, "run").cache()


def test_snapshot_parts(snapshot):
    assert [r["nixpkgs_branch"] for r in snapshot.header.collect()] == ["main"]
    assert [r["line"] for r in snapshot.bad.collect()] == ['{"name":"cut-1"']
    assert snapshot.records.count() == 3 + len(ODD)


def test_normalize(packages):
    rows = {r["attribute_path"]: r for r in packages.collect()}
    assert set(rows) == {"pkgs.foo.x86_64-linux", "pkgs.foo.x86_64-darwin", "pkgs.bar"}
    linux, darwin, bar = rows["pkgs.foo.x86_64-linux"], rows["pkgs.foo.x86_64-darwin"], rows["pkgs.bar"]
    assert linux["description"] == "" and darwin["description"] == "A tool"
    assert linux["license_kind"] == "string" and [x["shortName"] for x in linux["licenses"]] == ["mit"]
    assert [x["shortName"] for x in darwin["licenses"]] == ["gpl", "bsd", "5"]
    assert darwin["licenses"][0]["free"] is True and darwin["licenses"][0]["redistributable"] is None
    assert linux["platforms"] == ["x86_64-linux", *[f"p{i:02d}" for i in range(30)]]
    assert [m["name"] for m in linux["maintainers"]] == ["Ann", "Bob", "None"]
    assert (linux["available"], darwin["available"], bar["available"]) == (False, True, True)
    assert (linux["broken"], darwin["broken"]) == (False, True)
    assert linux["outputs_to_install"] == ["out", "5"] and bar["licenses"] is None
    assert (darwin["category"], bar["category"]) == ("text-tools", "misc")


def test_merge_does_not_depend_on_partitioning(packages):
    merged = [M.merge_variants(packages.repartition(n)).orderBy("package_id").collect() for n in (1, 4, 16)]
    assert merged[0] == merged[1] == merged[2]
    foo = {r["package_id"]: r for r in merged[0]}["pkgs.foo"]
    # "darwin" sorts before "linux", so it is the first variant.
    assert foo["description"] == "A tool" and foo["license_kind"] == "array"
    assert foo["broken"] is True and foo["available"] is False
    people = {(m["name"], m["github"]): m["githubId"] for m in foo["maintainers"]}
    # The last variant wins, here the one without an id.
    assert people == {("Ann", "ann"): None, ("Bob", ""): None, ("Cy", ""): None, ("None", ""): None}


def test_variations_come_from_all_variants(packages):
    got = {r["variation_id"]: (r["drv_path"], r["outputs"]) for r in M.variations(packages).collect()}
    assert got["pkgs.foo.x86_64-linux"] == ("/d/1", '{"out":"/o"}')
    assert got["pkgs.foo.x86_64-darwin"] == ("/d/2", "{}")
    assert got["pkgs.bar.bar"] == ("/d/3", "{}")


def test_catalog_round_trip(spark, packages, tmp_path):
    L.write_catalog(R.build_catalog(packages), str(tmp_path / "catalog"))
    catalog = L.read_catalog(spark, str(tmp_path / "catalog"))
    assert {r["rule"]: r["violations"] for r in Q.key_violations(catalog).collect() if r["violations"]} == {}
    ids = [r["license_id"] for r in catalog.licenses.orderBy("short_name").collect()]
    assert ids == list(range(1, len(ids) + 1))
    ann = catalog.maintainers.where("github = 'ann'").first()
    assert ann["github_id"] == 7  # the first variant gives it
    docs = {r["package_id"]: r for r in L.catalog_documents(catalog).collect()}
    assert docs["pkgs.foo"]["license"]["type"] == "array"
    assert sorted(x["shortName"] for x in docs["pkgs.foo"]["license"]["licenses"]) == ["5", "bsd", "gpl"]
    assert docs["pkgs.bar"]["license"] is None and docs["pkgs.bar"]["platforms"] is None
    cover = Q.coverage(L.catalog_documents(catalog)).first()
    assert tuple(cover) == (2, 1, 1, 1)
    hashed = R.with_key(R.license_lookup(packages), ["short_name"], "license_id", keys="hash")
    assert hashed.select("license_id").distinct().count() == len(ids)


def test_maintainer_matching(spark):
    person = "name string, email string, github string"
    merged = spark.createDataFrame(
        [("p", [("Ann", "", "x")]), ("q", [("Bea", "", "x")]), ("r", [("Cy", "", "")])],
        f"package_id string, maintainers array<struct<{person.replace(' string', ': string')}>>",
    )
    lookup = spark.createDataFrame([("Ann", "", "x", 1), ("Bea", "", "x", 2), ("Cy", "", "", 3)], f"{person}, maintainer_id int")
    exact = {tuple(r) for r in R.maintainer_links(merged, lookup).collect()}
    either = {tuple(r) for r in R.maintainer_links(merged, lookup, "any").collect()}
    assert exact == {("p", 1), ("q", 2), ("r", 3)}
    assert either == exact | {("p", 2), ("q", 1)}
    with pytest.raises(ValueError):
        R.maintainer_links(merged, lookup, "fuzzy")


def test_a_key_of_half_the_rows_is_joined_evenly(spark, monkeypatch):
    """Links, their lookups and nested lists are the same whether the hot name travels or is broadcast."""
    rows = [(f"p{i}", [{"shortName": "mit" if i % 2 else f"l{i % 7}"}], ["x86" if i % 2 else f"arch{i % 5}"]) for i in range(200)]
    merged = spark.createDataFrame(rows, "package_id string, licenses array<struct<shortName:string>>, platforms array<string>")
    licenses = spark.createDataFrame([("mit", 1)] + [(f"l{i}", i + 2) for i in range(7)], "short_name string, license_id bigint")
    names = spark.createDataFrame([("x86", 1)] + [(f"arch{i}", i + 2) for i in range(5)], "name string, arch_id bigint")
    want = [sorted(map(tuple, f.collect())) for f in (R.license_links(merged, licenses), R.architecture_links(merged, names))]
    hot = []
    monkeypatch.setattr(R, "even_join", lambda rows, lookup, key: hot.append(key) or K.even_join(rows, lookup, key, min_rows=50))
    got = [sorted(map(tuple, f.collect())) for f in (R.license_links(merged, licenses), R.architecture_links(merged, names))]
    assert got == want and hot == ["short_name", "name"] and [len(w) for w in want] == [200, 200]


def test_map_snapshot(spark, tmp_path):
    entries = {
        "a.b": {"pname": "b", "version": "1", "description": "top", "meta": {"description": "inner", "broken": False}, "broken": True},
        "a.c": {"meta": {"description": ""}, "description": "top", "license": {"shortName": "mit"}},
        "a.unknown": {},
        "a.text": "no object",
    }
    (tmp_path / "all.json").write_text(json.dumps(entries) + "\n\n" + json.dumps({"d": {"pname": "dd"}}))
    got = {r["attribute_path"]: r for r in normalize_map(S.read_snapshot_map(spark, str(tmp_path)), "run").collect()}
    assert set(got) == {"a.b", "a.c", "d"}
    assert (got["a.b"]["description"], got["a.b"]["broken"], got["a.b"]["version"]) == ("inner", True, "1")
    assert (got["a.c"]["package_name"], got["a.c"]["version"], got["a.c"]["description"]) == ("c", "unknown", "top")
    assert got["a.c"]["licenses"][0]["shortName"] == "mit"


def test_write_snapshot(spark, tmp_path):
    lines = spark.createDataFrame([(x,) for x in text([HEADER, LINUX, "", BAR])], "value string")
    manifest = S.write_snapshot(lines, str(tmp_path / "s"), "main", "t1", "in.jsonl").first()
    assert manifest["total_packages"] == 2 and manifest["stored_bytes"] > 0
    again = S.read_snapshot(spark, str(tmp_path / "s" / "*"))
    assert again.records.count() == 2
    assert again.header.first()["total_packages"] == 2


def test_document_store(spark, packages, tmp_path):
    merged = M.merge_variants(packages)
    docs = O.store_documents(
        merged.withColumns({"license": O.typed_license(F.col("license_kind"), F.col("licenses")), "content_hash": R.content_hash(merged)})
    )
    O.write_document_store(docs, str(tmp_path / "store"))
    store = spark.read.parquet(str(tmp_path / "store"))
    assert Q.round_trip_differences(docs, store).count() == 0
    got = {r["id"]: r for r in O.decode_documents(O.fetch_documents(store, ["pkgs.foo", "gone"])).collect()}
    assert got["pkgs.foo"]["package_name"] == "foo" and got["pkgs.foo"]["platforms"][0] == "p00"
    assert got["gone"]["is_stub"] and got["gone"]["package_id"] == "gone" and got["gone"]["available"]
    broken = spark.createDataFrame([("x", "{nope"), ("y", '{"available":"no","platforms":["a",1]}')], "id string, doc string")
    rows = {r["id"]: r for r in O.decode_documents(broken).collect()}
    assert rows["x"]["is_stub"] and rows["y"]["available"] and rows["y"]["platforms"] == ["a"]
    last = O.last_per_id(spark.createDataFrame([("a", "1", 1), ("a", "2", 2)], "id string, doc string, ord int"), "ord")
    assert last.first()["doc"] == "2"
    stats = Q.storage_stats(store, Q.folder_bytes(spark, str(tmp_path / "store"))).first()
    assert stats["total_documents"] == 2 and stats["stored_bytes"] > 0


def test_count_writes(spark, tmp_path):
    docs = spark.createDataFrame([("a", "{}"), ("b", None)], "id string, doc string")
    good, seen = Q.count_writes(docs, F.col("doc").isNotNull())
    good.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"success": 1, "errors": 1, "total": 2}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_refresh_end_to_end(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("\n".join(text([HEADER, LINUX, DARWIN, BAR])))
    done = refresh(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"), "run")
    assert done.packages == 3
    checks = Q.verify_output(spark, done.folders["store"], done.folders["index"])
    assert all(checks.values())
    node = json.loads(O.read_node_documents(spark, done.folders["nodes"], ["foo-1.2"]).first()["doc"])
    assert node["dependencies"] == {"all": ["bar-2"], "count": 1, "direct": ["bar-2"], "totalCount": 1}
    assert node["nodeMetadata"] == {"generatedAt": "t0", "hasDependencies": True, "hasDependents": False, "nixpkgsBranch": "main"}
    assert list(node) == sorted(node)
    stats = json.loads(spark.read.text(done.folders["stats"]).first()["value"])
    assert stats["stats"]["total_packages"] == 2 and stats["stats"]["top_100_most_dependents"][0] == {"package": "bar-2", "count": 1}
    index = json.loads(spark.read.text(done.folders["node_index"] + "/header").first()["value"])
    assert index["metadata"]["totalPackages"] == 3
    empty = tmp_path / "empty.jsonl"
    empty.write_text(json.dumps(HEADER))
    with pytest.raises(ValueError):
        refresh(spark, str(empty), str(tmp_path / "none"), "run")


def test_streaming_gives_the_batch_result(spark, packages, tmp_path):
    from cratewise.streaming.ingest import ingest_snapshots

    (tmp_path / "in").mkdir()
    for i, rows in enumerate([[HEADER, LINUX], [DARWIN, "", BAR, *ODD]]):
        (tmp_path / "in" / f"{i}.jsonl").write_text("\n".join(text(rows)))
    for _ in range(2):  # the second run finds nothing new
        ingest_snapshots(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "p"), "run").awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select("package_id", "drv_path").collect())) == sorted(
        map(tuple, packages.select("package_id", "drv_path").collect())
    )
