"""Store: the operators over one set of tables, with the status codes that callers expect."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import documents, scalars
from tidepool.operators import listing, multipart, state, stats, tenancy
from tidepool.sources import tables

#: Codes by status.
STATUS = {
    "NoSuchBucket": 404, "NoSuchKey": 404, "NoSuchUpload": 404, "NoSuchTenant": 404, "BucketAlreadyOwnedByYou": 409, "BucketNotEmpty": 409, "TenantAlreadyExists": 409,
    "TenantNotEmpty": 409, "InvalidBucketName": 400, "InvalidTenantName": 400, "InvalidArgument": 400, "InvalidPart": 400, "MalformedXML": 400, "InvalidRange": 416,
    "AccessDenied": 403, "SignatureDoesNotMatch": 403, "InternalError": 500,
}


class StoreError(Exception):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.status = code, STATUS[code]


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    sf_dir: str

    @property
    def objects(self) -> DataFrame:
        return tables.objects(self.spark, self.sf_dir)

    def list(self, ns: str, prefix: str = "", delimiter: str | None = None, marker: str = "", max_keys: int | None = None) -> DataFrame:
        if delimiter is not None and (len(delimiter) != 1 or ord(delimiter) > 126):
            raise StoreError("InvalidArgument", "delimiter must be one ASCII character")
        own = self.objects.where(F.col("ns") == ns)
        if self.namespaces().where(F.col("name") == ns).isEmpty() and own.isEmpty():  # a namespace may hold nothing
            raise StoreError("NoSuchBucket", ns)
        return listing.page(listing.grouped(own, prefix, delimiter, marker), max_keys)

    def create_upload(self, ns: str, key: str, kind: str | None = None, seq: int = 0) -> DataFrame:
        """(seq, ns, key, content_type, id, status) of a new upload."""
        asked = self.spark.range(1).select(F.lit(seq).alias("seq"), F.lit(ns).alias("ns"), F.lit(key).alias("key"), scalars.content_type(F.lit(kind).cast("string"), F.lit(key)).alias("content_type"))
        known = self.namespaces().select("name").unionByName(self.objects.select(F.col("ns").alias("name")).distinct())
        out = multipart.created(asked, known)
        return self._found(out.where("status = 'created'"), "NoSuchBucket", ns)

    def delete(self, ns: str, keys: list[str]) -> DataFrame:
        """(key, status, existed) of a batch; keys that are not there count as deleted."""
        asked = self.spark.range(1).select(F.explode(F.array(*map(F.lit, keys))).alias("key")).distinct()
        return state.batch_delete(asked, self.objects.where(F.col("ns") == ns))

    def copy(self, ns: str, source: str, key: str) -> DataFrame:
        """(src, dst, hash, size, status) of a copy from a copy-source header; no bytes move."""
        asked = self.spark.range(1).select(scalars.copy_source(F.lit(source)).alias("s")).select("s.*").first()
        if asked["ns"] is None:
            raise StoreError("InvalidArgument", source)
        held = self.objects.where(F.col("ns") == asked["ns"])
        out = state.copies(self.spark.range(1).select(F.lit(asked["key"]).alias("src"), F.lit(f"{ns}/{key}").alias("dst")), held)
        return self._found(out.where("status = 'copied'"), "NoSuchKey", source)

    def stats(self, email: str | None = None) -> DataFrame:
        if email is None:
            return stats.with_savings(stats.totals(self.objects))
        mine = tenancy.visible_namespaces(tables.namespaces(self.spark, self.sf_dir), tables.members(self.spark, self.sf_dir), email)
        own = tables.nation_objects(self.spark, self.sf_dir).join(mine.select(F.col("id").alias("namespace_id")), "namespace_id", "left_semi")
        return stats.with_savings(stats.totals(own))

    def namespaces(self, email: str | None = None) -> DataFrame:
        """All by name; with an e-mail address, those of its tenants."""
        every = tables.namespaces(self.spark, self.sf_dir)
        return (every if email is None else tenancy.visible_namespaces(every, tables.members(self.spark, self.sf_dir), email)).orderBy("name")

    def namespace(self, name: str) -> DataFrame:
        return self._found(self.namespaces().where(F.col("name") == name), "NoSuchBucket", name)

    def tenants(self, email: str) -> DataFrame:
        return tenancy.tenants_of(tables.tenants(self.spark, self.sf_dir), tables.members(self.spark, self.sf_dir), email)

    def _tenant(self, tenant: str, email: str, owner_only: bool) -> int:
        """A tenant's id. It is hidden from those outside it; owner_only: and refused to its plain members."""
        known, held = tables.tenants(self.spark, self.sf_dir), tables.members(self.spark, self.sf_dir)
        asked = self.spark.range(1).select(F.lit(tenant).alias("tenant"), F.lit(email).alias("email"), F.lit(owner_only).alias("owner_only"))
        status = tenancy.authorise(asked, known, held).first()["status"]
        if status != 200:
            raise StoreError("NoSuchTenant" if status == 404 else "AccessDenied", tenant)
        return known.where(F.col("name") == tenant).first()["id"]

    def members(self, tenant: str, email: str, owner_only: bool = False) -> DataFrame:
        """Members by address, for a caller of that address."""
        own = self._tenant(tenant, email, owner_only)
        return tables.members(self.spark, self.sf_dir).where(F.col("tenant_id") == own).select("email", "role").orderBy("email")

    def head(self, ns: str, key: str, header: str | None = None) -> DataFrame:
        """(key, etag, size, code, length) of an object; header: a Range."""
        found = self._found(self.objects.where((F.col("ns") == ns) & (F.col("key") == key)), "NoSuchKey", f"{ns}/{key}")
        out = found.select("key", scalars.etag(F.col("hash")).alias("etag"), "size", scalars.response_of(F.lit(header).cast("string"), F.col("size")).alias("r"))
        if out.first()["r"]["code"] == 416:
            raise StoreError("InvalidRange", header or "")
        return out.select("key", "etag", "size", "r.code", "r.length")

    def get(self, ns: str, key: str, header: str | None = None) -> DataFrame:
        """head(), and the bytes asked for."""
        about = self.head(ns, key, header)
        contents = tables.contents(self.spark, self.sf_dir).where((F.col("ns") == ns) & (F.col("key") == key))
        return about.join(contents.select("key", scalars.ranged(F.col("content"), F.lit(header).cast("string")).alias("content")), "key")

    def uploads(self, ns: str, prefix: str = "", compat: bool = False) -> DataFrame:
        return multipart.uploads_under(tables.uploads(self.spark, self.sf_dir).where(F.col("ns") == ns), prefix, compat)

    def parts(self, ns: str, key: str, upload_id: int, after: int = 0, limit: int = 1000) -> DataFrame:
        """A page of an upload's parts; namespace and key must be the upload's own."""
        self._upload(ns, key, upload_id)
        return multipart.parts_page(tables.parts(self.spark, self.sf_dir), upload_id, after, limit)

    # -- changes: each gives what was done, or the table as it is afterwards

    def _one(self, value: Column) -> object:
        return self.spark.range(1).select(value.alias("v")).first()["v"]

    def put(self, ns: str, key: str, content: bytes) -> DataFrame:
        """(key, etag, size, is_new): an object with these bytes; is_new: no object holds them yet."""
        if self.namespaces().where(F.col("name") == ns).isEmpty() and self.objects.where(F.col("ns") == ns).isEmpty():
            raise StoreError("NoSuchBucket", ns)
        digest = F.sha2(F.lit(content), 256)
        held = self.objects.where(F.col("hash") == digest).agg(F.count("*").alias("n"))
        return held.select(F.lit(key).alias("key"), digest.alias("etag"), F.lit(len(content)).cast("long").alias("size"), (F.col("n") == 0).alias("is_new"))

    def link(self, name: str, key: str, digest: str) -> DataFrame:
        """(linked, key, etag, size): an object over a blob that the namespace's tenant can see; without one, linked is false and nothing is done."""
        tenant = self.namespace(name).first()["tenant_id"]
        held = tables.nation_objects(self.spark, self.sf_dir).where(F.col("hash") == digest)
        if tenant is not None:
            own = tables.namespaces(self.spark, self.sf_dir).where(F.col("tenant_id") == tenant)
            held = held.join(own.select(F.col("id").alias("namespace_id")), "namespace_id", "left_semi")
        there = F.col("size").isNotNull()
        return held.agg(F.max("size").alias("size")).select(there.alias("linked"), F.when(there, key).alias("key"), F.when(there, digest).alias("etag"), "size")

    def _upload(self, ns: str, key: str, upload_id: int) -> DataFrame:
        own = tables.uploads(self.spark, self.sf_dir).where((F.col("id") == upload_id) & (F.col("ns") == ns) & (F.col("key") == key))
        return self._found(own, "NoSuchUpload", str(upload_id))

    def complete(self, ns: str, key: str, upload_id: int, body: str, form: str = "xml") -> DataFrame:
        """(xml, etag, size, dropped) of an upload that a body in XML or JSON completes; all its parts go."""
        self._upload(ns, key, upload_id)
        said = documents.complete_body(F.lit(body), form)
        asked = self._one(said)  # a body is bounded
        if asked is None:
            raise StoreError("MalformedXML" if form == "xml" else "InvalidArgument", "the body cannot be read")
        if not asked:
            raise StoreError("InvalidPart", "no parts in request")
        lines = self.spark.range(1).select(F.posexplode(said).alias("pos", "p")).select(F.lit(upload_id).alias("upload_id"), "pos", "p.part_number", "p.etag")
        parts = tables.parts(self.spark, self.sf_dir).where(F.col("upload_id") == upload_id)
        done = multipart.completed(lines, parts)
        status = done.first()["status"]
        if status != "complete":
            raise StoreError("InvalidPart", status)
        answer = documents.complete_answer(F.lit(ns), F.lit(key), scalars.etag(F.col("digest")))
        return done.select(answer.alias("xml"), F.col("digest").alias("etag"), "size", "dropped")

    def abort(self, ns: str, key: str, upload_id: int) -> DataFrame:
        """The uploads that are left."""
        return tables.uploads(self.spark, self.sf_dir).join(self._upload(ns, key, upload_id).select("id"), "id", "left_anti")

    def create_namespace(self, name: str, tenant: str | None = None, caller: str | None = None) -> DataFrame:
        """The namespaces, with the new one. A caller must name a tenant of theirs; without a caller it is owned by nobody."""
        if not self._one(scalars.valid_name(F.lit(name))):
            raise StoreError("InvalidBucketName", name)
        if caller is not None and tenant is None:
            raise StoreError("InvalidArgument", "tenant is required")
        owner = None if caller is None else self._tenant(tenant, caller, False)
        known = tables.namespaces(self.spark, self.sf_dir)
        asked = self.spark.range(1).select(F.lit(0).alias("seq"), F.lit(name).alias("name"))
        if tenancy.create_outcomes(asked, known).first()["status"] == "exists":
            raise StoreError("BucketAlreadyOwnedByYou", name)
        new = known.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select("id", F.lit(name).alias("name"), F.lit(owner).cast("long").alias("tenant_id"))
        return known.unionByName(new)

    def delete_namespace(self, name: str, caller: str | None = None) -> DataFrame:
        """The namespaces that are left; one that holds objects stays, and one of others is not there for the caller."""
        known = tables.namespaces(self.spark, self.sf_dir)
        self._found(self.namespaces(caller).where(F.col("name") == name), "NoSuchBucket", name)
        asked = self.spark.range(1).select(F.lit(name).alias("name"))
        if tenancy.delete_namespace_outcomes(asked, known, tables.nation_objects(self.spark, self.sf_dir)).first()["status"] == "not_empty":
            raise StoreError("BucketNotEmpty", name)
        return known.where(F.col("name") != name)

    def create_tenant(self, name: str, email: str) -> tuple[DataFrame, DataFrame]:
        """The tenants and the members, with a new tenant and its first owner."""
        if not self._one(scalars.valid_name(F.lit(name))):
            raise StoreError("InvalidTenantName", name)
        known = tables.tenants(self.spark, self.sf_dir)
        if not known.where(F.col("name") == name).isEmpty():
            raise StoreError("TenantAlreadyExists", name)
        asked = self.spark.range(1).select(F.lit(0).alias("seq"), F.lit(name).alias("name"), F.lit(email).alias("email"))
        return tenancy.create_tenants(asked, known, tables.members(self.spark, self.sf_dir))

    def delete_tenant(self, name: str, caller: str) -> tuple[DataFrame, DataFrame]:
        """The tenants and members that are left; owners alone may, and only without namespaces."""
        own = self._tenant(name, caller, True)
        known = tables.tenants(self.spark, self.sf_dir)
        asked = self.spark.range(1).select(F.lit(name).alias("name"))
        if tenancy.delete_tenant_outcomes(asked, known, tables.namespaces(self.spark, self.sf_dir)).first()["status"] == "not_empty":
            raise StoreError("TenantNotEmpty", name)
        return known.where(F.col("id") != own), tables.members(self.spark, self.sf_dir).where(F.col("tenant_id") != own)

    def add_member(self, tenant: str, caller: str, email: str, role: str | None = None) -> DataFrame:
        """The members, with one added or of another role; owners alone may."""
        own = self._tenant(tenant, caller, True)
        address, kind = F.lit(email), F.lit(role).cast("string")
        said = self._one(F.struct(scalars.normal_email(address, F.lit(True)).alias("email"), scalars.plausible_email(address).alias("ok"), scalars.role_of(kind).alias("role")))
        if not said["ok"] or said["role"] is None:
            raise StoreError("InvalidArgument", role if said["ok"] else email)
        new = self.spark.range(1).select(F.lit(own).cast("long").alias("tenant_id"), F.lit(said["email"]).alias("email"), F.lit(said["role"]).alias("role"), F.lit(0).cast("long").alias("seq"))
        return tenancy.upsert_members(tables.members(self.spark, self.sf_dir), new)

    def remove_member(self, tenant: str, caller: str, email: str) -> DataFrame:
        """The members that are left; who is none is no error, the last owner is."""
        own = self._tenant(tenant, caller, True)
        held, address = tables.members(self.spark, self.sf_dir), self._one(scalars.normal_email(F.lit(email), F.lit(True)))
        asked = self.spark.range(1).select(F.lit(own).cast("long").alias("tenant_id"), F.lit(address).alias("email"))
        if tenancy.remove_member_outcomes(asked, held).first()["status"] == "last_owner":
            raise StoreError("InvalidArgument", "the last owner stays")
        return held.where(~((F.col("tenant_id") == own) & (F.col("email") == address)))

    @staticmethod
    def _found(rows: DataFrame, code: str, detail: str) -> DataFrame:
        if rows.isEmpty():
            raise StoreError(code, detail)
        return rows
