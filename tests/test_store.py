"""Known answers, the listing against a walk of the keys, fold invariants, and the store's interface."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepool.functions import digest, scalars
from tidepool.operators import listing, retention, state
from tidepool.plans.store import Store, StoreError
from tidepool.sources import config, tables
from tidepool.streaming import flows


def test_digests():
    assert digest.blake3_hex(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert digest.blake3_hex(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    # the published vectors: the bytes 0 to 250, again and again
    known = {
        1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213", 1023: "10108970eeda3eb932baac1428c7a2163b0e924c9a9e25b35bba72b28f70bd11",
        1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
        2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a", 2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
        3072: "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2", 102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
    }
    given = [(bytes(range(251)) * (n // 251 + 1))[:n] for n in known]
    assert digest.blake3_many(given) == list(known.values())
    assert [digest.blake3_hex(x) for x in given] == list(known.values())
    assert len({digest.blake3_hex(bytes(n)) for n in (63, 64, 65, 1023, 1024, 1025, 2048, 2049, 5000)}) == 9


def test_published_signature():
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    headers = f"host:examplebucket.s3.amazonaws.com\nrange:bytes=0-9\nx-amz-content-sha256:{empty}\nx-amz-date:20130524T000000Z\n"
    got = digest.request_signature("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "GET", "/test.txt", "", headers, "host;range;x-amz-content-sha256;x-amz-date", empty, "20130524T000000Z", "20130524", "us-east-1", "s3")
    assert got == "f0e8bdb87c964420e857bd35b5d6ed310bd44f0170aba48dd91039c6036bdb41"
    assert digest.canonical_query("b=2&a=1%20x&c") == "a=1%20x&b=2&c="


def test_signed_values():
    said = digest.signed_value("one", b"payload")
    assert digest.unsigned_value("one", said) == b"payload"
    assert digest.unsigned_value("two", said) is None
    assert digest.unsigned_value("one", "x" + said) is None
    assert digest.unsigned_value("one", "no dot") is None


def _walk(keys, prefix, delimiter, marker, k):
    entries = []
    for key in sorted(x for x in set(keys) if x.startswith(prefix) and x > marker):
        rest = key[len(prefix) :]
        entry = (prefix + rest[: rest.index(delimiter) + 1], True) if delimiter in rest else (key, False)
        if entry not in entries:
            entries.append(entry)
    entries.sort()
    return [(e, p, len(entries) > k) for e, p in entries[:k]]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab/0.", min_size=1, max_size=5), min_size=1, max_size=20), st.sampled_from(["", "a", "a/"]), st.sampled_from(["", "a/", "b"]), st.integers(1, 6))
def test_listing_is_a_walk(spark, keys, prefix, marker, k):
    df = spark.createDataFrame([(x,) for x in sorted(set(keys))], "key string")
    got = [tuple(r) for r in listing.page(listing.grouped(df, prefix, "/", marker), k).orderBy("entry").collect()]
    assert got == _walk(keys, prefix, "/", marker, k)


def test_plans_push_down(spark, sf, capsys):
    path = f"{sf}/customer.parquet"
    spark.read.parquet(path).select(F.col("c_name").alias("key"), "c_acctbal").where(F.col("key").startswith("Customer#0000001")).select("key").explain("formatted")
    plan = capsys.readouterr().out
    assert "StringStartsWith" in plan and "ReadSchema: struct<c_name:string>" in plan


def test_fold_invariants(spark, sf):
    ops = tables.operations(spark, sf)
    counts = state.refcounts(ops)
    assert counts.agg(F.sum("refcount")).first()[0] == state.current(ops).count()
    wrong = counts.join(state.incremental_refcounts(ops).withColumnRenamed("refcount", "c"), "hash", "full").where(~F.col("refcount").eqNullSafe(F.col("c")))
    assert wrong.count() == 0


def test_retention_boundaries(spark):
    files = spark.sql("select * from values ('a', timestamp_ntz '2024-01-01 00:00:00'), ('b', timestamp_ntz '2024-01-01 00:00:01'), ('c', null) as v(path, modified)")
    parts = spark.sql("select 'x' as staging_key")
    got = retention.orphans(files, parts, F.expr("timestamp_ntz '2024-01-01 00:05:00'"), 300).collect()
    assert [r.path for r in got] == ["a"]  # equal is old enough; undated files stay


def test_names_and_markers(spark):
    df = spark.sql("select * from values ('abc\n'), ('abc') as v(s)")
    assert [r[0] for r in df.select(scalars.valid_name(F.col("s"))).collect()] == [False, True]
    back = df.select(scalars.from_marker(scalars.marker(F.col("s"))), scalars.from_marker(F.lit("%%%"))).collect()
    assert [tuple(r) for r in back] == [("abc\n", None), ("abc", None)]


def test_store(spark, sf):
    store = Store(spark, sf)
    assert store.stats().first()["ratio"] >= 1
    assert store.stats("nobody@example.com").first()["objects"] == 0
    assert store.list("ns-src0", "", "/").count() > 0
    with pytest.raises(StoreError) as e:
        store.list("nowhere")
    assert e.value.status == 404
    with pytest.raises(StoreError):
        store.list("ns-src0", delimiter="//")


def _code(call):
    with pytest.raises(StoreError) as e:
        call()
    return e.value.code


def test_store_reads(spark, sf):
    store = Store(spark, sf)
    one = store.objects.where("size > 30").first()
    got = store.get(one.ns, one.key, "bytes=5-9").first()
    assert (got.code, got.length, len(got.content), got.etag) == (206, 5, 5, f'"{one.hash}"')
    whole = store.get(one.ns, one.key).first()
    assert whole.code == 200 and len(whole.content) == one.size and bytes(whole.content[5:10]) == bytes(got.content)
    assert _code(lambda: store.get(one.ns, one.key, "bytes=999999999-")) == "InvalidRange"
    assert _code(lambda: store.head(one.ns, "none")) == "NoSuchKey"
    assert _code(lambda: store.namespace("none")) == "NoSuchBucket"
    upload = tables.uploads(spark, sf).first()
    assert store.parts(upload.ns, upload.key, upload.id, limit=1).first().part_number == 1
    assert _code(lambda: store.parts(upload.ns, "other", upload.id)) == "NoSuchUpload"
    assert store.uploads(upload.ns).count() > 0


def test_store_tenancy(spark, sf):
    store = Store(spark, sf)
    member = tables.members(spark, sf).where("role = 'member'").join(tables.tenants(spark, sf), F.col("id") == F.col("tenant_id")).first()
    assert store.members(member["name"], member.email).count() > 0
    assert _code(lambda: store.members(member["name"], member.email, owner_only=True)) == "AccessDenied"
    assert _code(lambda: store.members(member["name"], "nobody@example.com")) == "NoSuchTenant"
    assert store.tenants(member.email).count() == 1
    assert 0 < store.namespaces(member.email).count() < store.namespaces().count()


def test_settings(spark, tmp_path):
    path = tmp_path / "store.toml"
    path.write_text('[gc]\ninterval_secs = 2\ngrace_secs = 7\n[storage]\nbackend = "s3"\nbucket = "b"\nroot = "r"\n[other]\nx = 1\n')
    got = config.load(str(path), {"TIDEPOOL__GC__GRACE_SECS": "9", "TIDEPOOL__OIDC__ENABLED": "true", "TIDEPOOL__OIDC__ALLOWED_DOMAINS": "a.io, b.io", "TIDEPOOL__X__Y": "1", "PATH": "p"})
    assert (got.gc.interval_secs, got.gc.every, got.gc.grace_secs, got.gc.multipart_expiry_secs) == (2, 5, 9, 86_400)
    assert got.storage.address == "s3a://b/r" and got.oidc.enabled and got.oidc.allowed_domains == ["a.io", "b.io"]
    assert config.load(str(tmp_path / "none.toml"), {}) == config.Settings()
    with pytest.raises(ValueError):
        config.load(str(path), {"TIDEPOOL__OIDC__ENABLED": "maybe"})
    assert config.healthy(spark, f"file://{tmp_path}") and not config.healthy(spark, f"file://{tmp_path}/none")


def test_backends():
    assert tables.backend_root("s3", bucket="b", root="r") == "s3a://b/r"
    with pytest.raises(ValueError):
        tables.backend_root("ftp")
    with pytest.raises(ValueError):
        tables.backend_root("gcs")


def test_new_blobs_are_written_once(spark, tmp_path):
    contents = spark.sql("select * from values ('aa1', 'x'), ('aa1', 'x'), ('bb2', 'y') as v(hash, content)")
    tables.write_new_blobs(contents, spark.sql("select 'bb2' as hash"), str(tmp_path / "blobs"))
    assert [r.hash for r in spark.read.parquet(str(tmp_path / "blobs")).collect()] == ["aa1"]


def test_ingest_commits_batches(spark, sf, tmp_path):
    seen = {}
    query = flows.ingest(flows.log_stream(spark, sf), lambda df, n: seen.__setitem__(n, df.count()), str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    assert sum(seen.values()) == spark.read.parquet(f"{sf}/events.parquet").count()


def test_signing_in_sql_is_that_of_the_standard_library(spark):
    queries = ["b=2&a=1", "", "a=%2F/+x&a=&b", "é=1&z==", "x=%zz"]
    df = spark.createDataFrame([(q, f"text {q}") for q in queries], "q string, t string")
    for key in (b"", b"k", b"x" * 64, b"y" * 100):
        for r in df.select("t", scalars.hmac_sha256(key, F.col("t")).alias("tag")).collect():
            assert r.tag == digest.hmac_sha256(key, r.t).hex()
    scope = ("20240101", "us-east-1", "s3")
    key = digest.signing_key("secret", *scope)
    rest = ("host:h\n", "host", "UNSIGNED-PAYLOAD")
    said = scalars.request_signature(key, "/".join(scope) + "/aws4_request", "20240101T000000Z", F.lit("GET"), F.lit("/p"), F.col("q"), *map(F.lit, rest))
    for r in df.select("q", scalars.canonical_query(F.col("q")).alias("c"), said.alias("s"), scalars.signed_value("one", F.col("t")).alias("v"), "t").collect():
        if r.q != "x=%zz":  # not an encoding: taken as it stands
            assert r.c == digest.canonical_query(r.q)
            assert r.s == digest.request_signature("secret", "GET", "/p", r.q, *rest, "20240101T000000Z", *scope)
        assert r.v == digest.signed_value("one", r.t.encode()) and digest.unsigned_value("one", r.v) == r.t.encode()


def test_uploads_are_paged(spark):
    from tidepool.operators import multipart

    uploads = spark.createDataFrame([(i, f"up/{i % 3}") for i in range(10)], "id long, key string")
    seen, after = [], None
    while True:
        page = multipart.uploads_under(uploads, "up/", limit=4, after=after).collect()
        seen += [(r.key, r.id) for r in page]
        if not page[-1].truncated:
            break
        after = seen[-1]
    assert seen == sorted((f"up/{i % 3}", i) for i in range(10))


def test_writes_of_the_store(spark, sf):
    store = Store(spark, sf)
    ns = store.objects.first()["ns"]
    key = store.objects.where(F.col("ns") == ns).first()["key"]
    made = store.create_upload(ns, "a/b.txt").first()
    assert made["status"] == "created" and made["content_type"] == "text/plain" and made["id"] == store.create_upload(ns, "a/b.txt").first()["id"]
    assert {(r.key, r.existed) for r in store.delete(ns, [key, "nothing"]).collect()} == {(key, True), ("nothing", False)}
    copy = store.copy("other", f"/{ns}/{key}", "x").first()
    assert copy["dst"] == "other/x" and copy["hash"]
    assert store.list("nation_3").collect() == []  # there, and empty
    for code, call in (("NoSuchBucket", lambda: store.create_upload("nowhere", "k")), ("NoSuchKey", lambda: store.copy(ns, f"{ns}/nothing", "x")), ("InvalidArgument", lambda: store.copy(ns, "x", "x")), ("NoSuchBucket", lambda: store.list("nowhere"))):
        with pytest.raises(StoreError) as e:
            call()
        assert e.value.code == code


def test_guides_and_places_against_a_plain_loop(spark):
    import random

    from tidepool.operators import tree

    rng = random.Random(1)
    keys = sorted({"/".join(rng.choice("abc1") * rng.randrange(1, 3) for _ in range(rng.randrange(2, 6))) for _ in range(60)})
    nodes = tree.rows(spark.createDataFrame([(f"r/{k}",) for k in keys], "key string"))
    placed = tree.positions(nodes, "r/")
    rows = sorted((r.pos, r.id, r.depth) for r in placed.collect())
    assert [r[1] for r in rows] == sorted(r.id for r in nodes.collect()) and [r[0] for r in rows] == list(range(len(rows)))
    want = {(a[1], b[2]) for a in rows for b in rows if b[0] > a[0] and 0 < b[2] < a[2]}
    assert {(r.id, r.guide) for r in tree.guides(placed).collect()} == want


def test_listing_of_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one").write_bytes(b"x" * 5)
    (tmp_path / "a" / "b" / "two").write_bytes(b"")
    assert {(r.path.rsplit("/", 1)[1], r.length, r.modified is not None) for r in tables.listing(spark, str(tmp_path)).collect()} == {("one", 5, True)}  # an empty file is passed by


def test_sweeps_go_on_after_a_failure(spark, tmp_path):
    import time

    ticks = []

    def tick(number):
        ticks.append(number)
        if len(ticks) == 1:
            raise ValueError("once")

    running = flows.sweep_every(spark, tick, str(tmp_path / "c"), seconds=1)  # held to 5
    until = time.time() + 40
    while len(ticks) < 2 and time.time() < until and running.isActive:
        time.sleep(0.5)
    assert running.isActive and len(ticks) >= 2
    running.stop()


def test_a_quiet_batch_hides_what_succeeded(spark):
    objects = spark.createDataFrame([("a",)], "key string")
    asked = spark.createDataFrame([("a",), ("b",)], "key string")
    assert state.batch_delete(asked, objects, quiet=True).collect() == [] and state.batch_delete(asked, objects).count() == 2


def test_copies_need_the_blob(spark):
    ops = spark.createDataFrame([(1, "n", "a", "put", "h", 3, "t"), (5, "n", "a", "delete", "x", 0, "t"), (6, "n", "a", "put", "g", 4, "u")], "seq long, ns string, key string, op string, hash string, size long, content_type string")
    asked = spark.createDataFrame([(s, "n", "a", f"d{s}") for s in (0, 2, 5, 7, 9)], "seq long, ns string, src string, dst string")
    got = {r.seq: (r.hash, r.content_type, r.status) for r in state.copies_as_of(asked, ops, spark.createDataFrame([("h",)], "hash string")).collect()}
    none = (None, None, "NoSuchKey")
    assert got == {0: none, 2: ("h", "t", "copied"), 5: ("h", "t", "copied"), 7: none, 9: none}


def test_pages_of_xml_and_json_go_on_to_the_end(spark):
    import json
    import xml.etree.ElementTree as ET

    from tidepool.operators import listing

    keys = ["a", "a b&<c>", "d/1", "d/2", "d0", "e/x", "é", "z"]
    objects = spark.createDataFrame([(k, "h" * 64, i) for i, k in enumerate(keys)], "key string, hash string, size long").withColumn("updated", F.expr("timestamp_ntz '2024-01-01 00:00:00.120'"))
    want = ["a", "a b&<c>", "d/", "d0", "e/", "é", "z"]
    at = "{http://s3.amazonaws.com/doc/2006-03-01/}"
    # a page resumes above all of a group, and so past the key right there, as the walk does that it answers for
    for v2, size, lost in ((False, 2, set()), (True, 2, set()), (True, 3, {"d0"})):
        seen, start = [], None
        for _ in range(len(want)):
            more = {"token": start} if v2 else {"marker": start or ""}
            root = ET.fromstring(listing.answer_xml(objects, "ns", "", "/", size, v2=v2, **more).first()["xml"].encode())
            own = [x.text for x in root.iter(f"{at}Key")] + [x.find(f"{at}Prefix").text for x in root.iter(f"{at}CommonPrefixes")]
            assert int(root.find(f"{at}KeyCount").text) == len(own) and all(x.text == "2024-01-01T00:00:00.120Z" for x in root.iter(f"{at}LastModified"))
            seen += own
            start = root.findtext(f"{at}NextContinuationToken" if v2 else f"{at}NextMarker")
            assert (start is None) == (root.findtext(f"{at}IsTruncated") == "false")
            if start is None:
                break
        assert sorted(seen) == sorted(set(want) - lost)
    page = json.loads(listing.answer_json(objects, "", "/", 3).first()["json"])
    assert [o["key"] for o in page["objects"]] == ["a", "a b&<c>"] and page["common_prefixes"] == ["d/"] and page["objects"][0]["last_modified"] == "2024-01-01T00:00:00.120Z"
    empty = listing.answer_xml(objects.limit(0), "ns").first()["xml"]
    assert "<KeyCount>0</KeyCount><IsTruncated>false</IsTruncated><Marker/></ListBucketResult>" in empty
    assert json.loads(listing.answer_json(objects.limit(0)).first()["json"]) == {"objects": [], "common_prefixes": [], "next_token": None}
    with pytest.raises(ValueError):
        listing.answer_json(objects, token="no base64!")


def test_request_bodies_that_cannot_be_read(spark):
    from tidepool.functions import documents

    part = "<Part><PartNumber>{}</PartNumber></Part>"
    sent = [f"<CompleteMultipartUpload>{part.format(2)}{part.format(1)}</CompleteMultipartUpload>", f"<CompleteMultipartUpload>{part.format('x')}</CompleteMultipartUpload>", "<CompleteMultipartUpload/>", "<Comp", None]
    rows = spark.createDataFrame([(x,) for x in sent], "body string").select(documents.complete_body(F.col("body")).alias("p")).collect()
    assert [None if r.p is None else [(p.part_number, p.etag) for p in r.p] for r in rows] == [[(2, None), (1, None)], None, [], None, None]
    sent = ['{"parts":[{"part_number":1,"etag":"a"},{"part_number":2}]}', '{"parts":[{"etag":"a"}]}', '{"parts":[]}', "{}", "{", None]
    rows = spark.createDataFrame([(x,) for x in sent], "body string").select(documents.complete_body(F.col("body"), "json").alias("p")).collect()
    assert [None if r.p is None else [(p.part_number, p.etag) for p in r.p] for r in rows] == [[(1, "a"), (2, None)], None, [], None, None, None]


def test_answers_to_deletes_and_completions(spark):
    from tidepool.functions import documents

    keys, failed = F.array(F.lit("a&b"), F.lit("c")), F.array(F.struct(F.lit("d").alias("key"), F.lit("InternalError").alias("code"), F.lit("x<y").alias("message")))
    said = spark.range(1).select(*[documents.delete_answer(keys, failed, F.lit(q)) for q in (False, True)], documents.complete_answer(F.lit("ns"), F.lit("k/1"), F.lit('"t"'))).first()
    ill = "<Error><Key>d</Key><Code>InternalError</Code><Message>x&lt;y</Message></Error></DeleteResult>"
    assert said[0].endswith(f"<Deleted><Key>a&amp;b</Key></Deleted><Deleted><Key>c</Key></Deleted>{ill}") and said[1].endswith(f'2006-03-01/">{ill}')
    assert said[2].endswith('<Location>/ns/k/1</Location><Bucket>ns</Bucket><Key>k/1</Key><ETag>"t"</ETag></CompleteMultipartUploadResult>')


def test_places_of_a_hot_folder_and_of_none(spark):
    from tidepool.operators import tree

    nodes = tree.rows(spark.createDataFrame([(f"hot/{i}",) for i in range(700)] + [("cold/1",), ("top",)], "key string"))
    for buckets in (1, 2, 64):
        placed = sorted((r.pos, r.id) for r in tree.positions(nodes, buckets=buckets).collect())
        assert placed == list(enumerate(sorted(r.id for r in nodes.collect())))
    assert tree.positions(nodes.limit(0)).count() == 0


def test_store_changes_of_objects(spark, sf):
    import xml.etree.ElementTree as ET

    store = Store(spark, sf)
    old = store.get(*store.objects.select("ns", "key").first()).first()
    new = store.put("nation_3", "k", b"bytes of no object").first()
    assert (new.size, new.is_new) == (18, True) and not store.put("nation_3", "k", bytes(old.content)).first().is_new
    assert _code(lambda: store.put("nowhere", "k", b"")) == "NoSuchBucket"
    spaces = {r.id: r for r in tables.namespaces(spark, sf).collect()}
    blob = next(o for o in tables.nation_objects(spark, sf).collect() if spaces[o.namespace_id].tenant_id is not None)
    own = next(r.name for r in spaces.values() if r.tenant_id == spaces[blob.namespace_id].tenant_id)
    assert tuple(store.link(own, "k", blob.hash).first()) == (True, "k", blob.hash, blob.size)
    holders = {spaces[r.namespace_id].tenant_id for r in tables.nation_objects(spark, sf).where(F.col("hash") == blob.hash).collect()}
    other = next(r.name for r in spaces.values() if r.tenant_id not in {*holders, None})
    assert tuple(store.link(other, "k", blob.hash).first()) == tuple(store.link(own, "k", "0" * 64).first()) == (False, None, None, None)

    upload = tables.uploads(spark, sf).orderBy("id").first()
    parts = tables.parts(spark, sf).where(F.col("upload_id") == upload.id).orderBy("part_number").collect()
    body = "".join(f'<Part><PartNumber>{p.part_number}</PartNumber><ETag>"{p.etag}"</ETag></Part>' for p in parts)
    done = store.complete(upload.ns, upload.key, upload.id, f"<CompleteMultipartUpload>{body}</CompleteMultipartUpload>").first()
    assert done["size"] == sum(p["size"] for p in parts) and done.dropped == len(parts)
    assert ET.fromstring(done.xml.encode()).findtext("{http://s3.amazonaws.com/doc/2006-03-01/}ETag") == f'"{done.etag}"'
    assert store.complete(upload.ns, upload.key, upload.id, '{"parts":[{"part_number":1}]}', "json").first()["size"] == parts[0]["size"]
    for code, said, form in (
        ("InvalidPart", "<CompleteMultipartUpload/>", "xml"), ("MalformedXML", "<Part", "xml"), ("InvalidArgument", "{}", "json"), ("InvalidPart", '{"parts":[{"part_number":99}]}', "json"),
        ("InvalidPart", '{"parts":[{"part_number":1,"etag":"x"}]}', "json"), ("InvalidPart", '{"parts":[{"part_number":1},{"part_number":1}]}', "json"),
    ):
        assert _code(lambda: store.complete(upload.ns, upload.key, upload.id, said, form)) == code
    assert _code(lambda: store.complete(upload.ns, "other", upload.id, "{}", "json")) == _code(lambda: store.abort(upload.ns, "other", upload.id)) == "NoSuchUpload"
    assert store.abort(upload.ns, upload.key, upload.id).count() == tables.uploads(spark, sf).count() - 1


def test_store_changes_of_teams(spark, sf):
    store = Store(spark, sf)
    # customers are few here, owners rarer: the members of two tenants are stated
    teams = [(0, "boss@x.io", "owner"), (0, "hand@x.io", "member"), (1, "lone@x.io", "owner")]
    held = spark.createDataFrame(teams, "tenant_id long, email string, role string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tables, "members", lambda *_: held)
        first, second = (tables.tenants(spark, sf).where(F.col("id") == i).first()["name"] for i in (0, 1))
        as_set = lambda df: {tuple(r) for r in df.select("tenant_id", "email", "role").collect()}
        assert as_set(store.add_member(first, "boss@x.io", " New@X.io ")) == {*teams, (0, "new@x.io", "member")}
        assert as_set(store.add_member(first, "boss@x.io", "hand@x.io", "owner")) == {teams[0], (0, "hand@x.io", "owner"), teams[2]}
        assert as_set(store.remove_member(first, "boss@x.io", "HAND@x.io")) == {teams[0], teams[2]}
        assert as_set(store.remove_member(first, "boss@x.io", "nobody@x.io")) == set(teams)
        tenants, members = store.create_tenant("new-team", "a@x.io")
        assert tenants.where("name = 'new-team'").count() == 1 and members.where("email = 'a@x.io' and role = 'owner'").count() == 1
        spaces = store.create_namespace("new-space", first, "hand@x.io").where("name = 'new-space'").collect()
        assert [(r.tenant_id) for r in spaces] == [0] and store.create_namespace("new-space").where("name = 'new-space'").first()["tenant_id"] is None
        taken, owned = store.namespaces().first()["name"], tables.namespaces(spark, sf).where("tenant_id = 1").first()["name"]
        for code, call in (
            ("AccessDenied", lambda: store.add_member(first, "hand@x.io", "a@x.io")), ("NoSuchTenant", lambda: store.add_member(second, "boss@x.io", "a@x.io")),
            ("InvalidArgument", lambda: store.add_member(first, "boss@x.io", "no address")), ("InvalidArgument", lambda: store.add_member(first, "boss@x.io", "a@x.io", "king")),
            ("InvalidArgument", lambda: store.remove_member(second, "lone@x.io", "lone@x.io")), ("InvalidTenantName", lambda: store.create_tenant("No", "a@x.io")),
            ("TenantNotEmpty", lambda: store.delete_tenant(second, "lone@x.io")), ("AccessDenied", lambda: store.delete_tenant(first, "hand@x.io")),
            ("InvalidBucketName", lambda: store.create_namespace("No")), ("InvalidArgument", lambda: store.create_namespace("new-space", caller="boss@x.io")),
            ("BucketNotEmpty", lambda: store.delete_namespace(owned, "lone@x.io")), ("NoSuchBucket", lambda: store.delete_namespace(owned, "boss@x.io")), ("NoSuchBucket", lambda: store.delete_namespace("nowhere")),
        ):
            assert _code(call) == code
        empty = tables.nation_objects(spark, sf).limit(0)
        patch.setattr(tables, "nation_objects", lambda *_: empty)
        assert store.delete_namespace(taken).count() == store.namespaces().count() - 1
        patch.setattr(tables, "namespaces", lambda *_: spark.createDataFrame([], "id long, name string, tenant_id long"))
        tenants, members = store.delete_tenant(second, "lone@x.io")
        assert tenants.where(F.col("name") == second).count() == 0 and as_set(members) == set(teams[:2])
