"""Validation, parsing and formatting as JVM-side column expressions."""

from __future__ import annotations

import base64
import hashlib
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1 << 20


def trimmed(s: Column) -> Column:
    """Without white space, Unicode's too, at both ends."""
    return F.regexp_replace(s, r"(?U)\A\s+|\s+\z", "")


def ascii_lower(s: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    return F.translate(s, ascii_uppercase, ascii_lowercase)


def byte_range(header: Column, size: Column) -> Column:
    """struct(status, first, last) of an HTTP Range header: none (serve all), ok, or invalid. White space around it and its bounds does not count."""
    whole = F.lit("none")
    header = trimmed(header)
    spec = F.regexp_extract(header, r"(?s)\Abytes=(.*)\z", 1)
    usable = header.startswith("bytes=") & ~F.contains(spec, F.lit(",")) & F.contains(spec, F.lit("-"))
    a, b = trimmed(F.substring_index(spec, "-", 1)), trimmed(F.substr(spec, F.instr(spec, "-") + 1))
    first, last = (F.when(x.rlike(r"\A\+?[0-9]{1,18}\z"), F.regexp_replace(x, r"\A\+", "")).cast("long") for x in (a, b))
    suffix, open_end = a == "", b == ""
    low = F.when(suffix, F.greatest(size - last, F.lit(0))).otherwise(first)
    high = F.when(suffix | open_end, size - 1).otherwise(F.least(last, size - 1))
    bad = F.when(suffix, last.isNull() | (last == 0)).otherwise(first.isNull() | (~open_end & last.isNull()))
    bad = bad | (low >= size) | (low > high)
    status = F.when(header.isNull() | ~usable, whole).when(bad, "invalid").otherwise("ok")
    return F.struct(status.alias("status"), F.when(status == "ok", low).alias("first"), F.when(status == "ok", high).alias("last"))


def response_of(header: Column, size: Column) -> Column:
    """struct(code, length): 206 with a good range, 416 with a bad one, else 200; an empty object ignores ranges."""
    r = byte_range(header, size)
    code = F.when((size == 0) | (r["status"] == "none"), 200).when(r["status"] == "ok", 206).otherwise(416)
    return F.struct(code.alias("code"), F.when(code == 206, r["last"] - r["first"] + 1).when(code == 200, size).otherwise(0).alias("length"))


def ranged(content: Column, header: Column) -> Column:
    """The bytes of a binary column that a Range header asks for: all without a usable header, null if it cannot be met."""
    asked = F.transform(F.array(byte_range(header, F.octet_length(content).cast("long"))), lambda r: (
        F.when(r["status"] == "none", content).when(r["status"] == "ok", F.substring(content, (r["first"] + 1).cast("int"), (r["last"] - r["first"] + 1).cast("int")))))
    return asked[0]


def retry_delay(attempt: Column, tries: int = 3, base_ms: int = 250) -> Column:
    """Milliseconds to wait after failed attempt n (from 0): doubled each time, null after the last."""
    return F.when(attempt < tries - 1, F.lit(base_ms).cast("long") * F.pow(F.lit(2), attempt).cast("long"))


def valid_name(name: Column) -> Column:
    """3 to 63 of a-z, 0-9, dot and dash, with a letter or digit at both ends."""
    return F.coalesce(name.rlike(r"\A[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]\z"), F.lit(False))


def normal_email(email: Column, verified: Column) -> Column:
    return F.when(verified, ascii_lower(trimmed(email)))


def plausible_email(email: Column) -> Column:
    return F.coalesce((trimmed(email) != "") & F.contains(email, F.lit("@")), F.lit(False))


def role_of(role: Column) -> Column:
    """member by default; null if it is neither owner nor member."""
    return F.when(role.isNull(), "member").when(role.isin("owner", "member"), role)


def admitted(email: Column, verified: Column, domains: list[str], emails: list[str]) -> Column:
    """Empty lists admit all; else a verified address that is listed, or whose part after the last @ is. Case counts beyond ASCII."""
    if not domains and not emails:
        return F.lit(True)
    low, lower = ascii_lower(email), str.maketrans(ascii_uppercase, ascii_lowercase)
    listed = low.isin([x.translate(lower) for x in emails]) | (F.contains(low, F.lit("@")) & F.substring_index(low, "@", -1).isin([x.translate(lower) for x in domains]))
    return F.coalesce(F.coalesce(verified, F.lit(False)) & listed, F.lit(False))


def safe_redirect(path: Column, home: str = "/ui/") -> Column:
    return F.when(path.startswith("/") & ~path.startswith("//"), path).otherwise(home)


def human_bytes(n: Column) -> Column:
    """Powers of 1024 up to PB, one decimal above bytes."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = out.when(n < 1024 ** (k + 1), F.format_string(f"%.1f {unit}", n / float(1024**k)))
    return out.otherwise(F.format_string("%.1f PB", n / float(1024**5)))


def etag(digest: Column) -> Column:
    return F.concat(F.lit('"'), digest, F.lit('"'))


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def rfc3339(ts: Column) -> Column:
    """With as many groups of three digits of a second as it takes, none for a whole one."""
    return F.concat(F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$|000$", ""), F.lit("Z"))


def http_date(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def like_escaped(s: Column) -> Column:
    for c in ("\\", "%", "_"):
        s = F.replace(s, F.lit(c), F.lit("\\" + c))
    return s


def marker(s: Column) -> Column:
    return F.translate(F.base64(s.cast("binary")), "\r\n", "")


def from_marker(s: Column) -> Column:
    """The marker's text; null if it is not base64."""
    return F.try_to_binary(s, F.lit("base64")).cast("string")


def decoded_marker(token: str) -> str:
    """The marker of a request's token. One that is no base64 of UTF-8 is an error."""
    return base64.b64decode(token, validate=True).decode()


def collapse_spaces(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def html_escaped(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def part_plan(size: Column) -> Column:
    """struct(part_size, parts): at least 8 MiB a part, at most 10,000 parts."""
    part = F.greatest(F.lit(8 * MIB), F.ceil(size / F.lit(10_000))).cast("long")
    return F.struct(part.alias("part_size"), F.ceil(size / part).cast("long").alias("parts"))


def part_rows(size: Column) -> Column:
    """array of struct(part_number, offset, length): the parts of part_plan()."""
    plan = part_plan(size)
    row = lambda k: F.struct(k.cast("int").alias("part_number"), ((k - 1) * plan["part_size"]).alias("offset"), F.least(plan["part_size"], size - (k - 1) * plan["part_size"]).alias("length"))
    return F.when(plan["parts"] > 0, F.transform(F.sequence(F.lit(1).cast("long"), plan["parts"]), row)).otherwise(F.array().cast("array<struct<part_number:int,offset:bigint,length:bigint>>"))


def upload_strategy(size: Column, known: Column) -> Column:
    return F.when(size < 16 * MIB, "single").when(known, "link").otherwise("multipart")


def is_uuid(s: Column) -> Column:
    return F.coalesce(s.rlike(r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"), F.lit(False))


def part_number(s: Column) -> Column:
    """1 to 10,000, else null."""
    n = F.when(s.rlike(r"\A[0-9]{1,9}\z"), s).cast("int")
    return F.when(n.between(1, 10_000), n)


def destination(s: Column) -> Column:
    """Trimmed, no leading slash, one at the end unless empty."""
    bare = F.regexp_replace(F.trim(s), "^/+", "")
    return F.when((bare == "") | bare.endswith("/"), bare).otherwise(F.concat(bare, F.lit("/")))


def browse_prefix(s: Column) -> Column:
    """Trimmed, no leading slash."""
    return F.regexp_replace(trimmed(s), r"\A/+", "")


def dirname(key: Column) -> Column:
    return F.regexp_replace(key, "[^/]*$", "")


def encoded(s: Column) -> Column:
    """RFC 3986: unreserved characters stay, all else is %XX by byte; the slash stays too."""
    return F.array_join(F.transform(F.split(s, "/"), lambda x: F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))), "/")


#: Content types by extension.
CONTENT_TYPES = {
    "txt": "text/plain", "html": "text/html", "css": "text/css", "csv": "text/csv", "md": "text/markdown", "json": "application/json", "xml": "text/xml", "js": "text/javascript",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "pdf": "application/pdf", "zip": "application/zip",
    "gz": "application/gzip", "mp3": "audio/mpeg", "wav": "audio/wav", "mp4": "video/mp4", "webm": "video/webm", "wasm": "application/wasm",
}
GENERIC = "application/octet-stream"


def content_type(header: Column, key: Column) -> Column:
    """The header, else by extension, else the generic type."""
    by = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    ext = F.lower(F.regexp_extract(key, r"\.([^./]+)$", 1))
    return F.coalesce(header, F.try_element_at(by, ext), F.lit(GENERIC))


def preview_kind(kind: Column, key: Column) -> Column:
    """image, video, audio, pdf, text or none; the extension decides only for generic types."""
    real = F.when(kind.isNull() | kind.isin(GENERIC, "binary/octet-stream"), content_type(F.lit(None).cast("string"), key)).otherwise(kind)
    out = F.when(real.startswith("image/"), "image").when(real.startswith("video/"), "video").when(real.startswith("audio/"), "audio").when(real == "application/pdf", "pdf")
    return out.when(real.startswith("text/") | real.isin("application/json", "application/xml"), "text").otherwise("none")


def auth_header(header: Column) -> Column:
    """struct of a signed Authorization header's parts; null unless the scheme, all three pairs and a five-part scope are there."""
    body = F.regexp_extract(header, r"^AWS4-HMAC-SHA256\s+(.*)$", 1)
    part = lambda name: F.regexp_extract(body, rf"(?:^|,)\s*{name}=([^,]*)", 1)
    scope = F.split(part("Credential"), "/")
    fields = F.struct(
        scope[0].alias("key_id"), scope[1].alias("day"), scope[2].alias("region"), scope[3].alias("service"), F.split(part("SignedHeaders"), ";").alias("signed"), part("Signature").alias("signature")
    )
    return F.when((F.size(scope) == 5) & (part("SignedHeaders") != "") & (part("Signature") != ""), fields)


def canonical_headers(headers: Column, signed: Column) -> Column:
    """Lines of the signed headers from a map; null if one is missing."""
    lines = F.transform(signed, lambda h: F.concat(h, F.lit(":"), collapse_spaces(F.try_element_at(headers, h)), F.lit("\n")))
    return F.when(~F.exists(lines, lambda x: x.isNull()), F.array_join(lines, ""))


def copy_source(header: Column) -> Column:
    """struct(ns, key) of a percent-encoded source; a plus stays a plus."""
    plain = F.regexp_replace(F.try_url_decode(F.replace(header, F.lit("+"), F.lit("%2B"))), "^/", "")
    at = F.instr(plain, "/")
    return F.when(at > 1, F.struct(F.left(plain, at - 1).alias("ns"), F.substr(plain, at + 1).alias("key")))


def scopes(asked: Column) -> Column:
    """The scopes asked for, or three defaults, without openid."""
    given = F.when(asked.isNull() | (F.size(asked) == 0), F.array(F.lit("openid"), F.lit("email"), F.lit("profile"))).otherwise(asked)
    return F.array_remove(given, "openid")


def within_cap(body: Column, cap: int = 8 * MIB) -> Column:
    return F.octet_length(body) <= cap


def preview_window(content: Column, cap: int = 512 * 1024) -> Column:
    """struct(shown, truncated): the first `cap` bytes of a binary column for a preview."""
    return F.struct(F.substring(content, 1, cap).alias("shown"), (F.octet_length(content) > cap).alias("truncated"))


def canonical_query(raw: Column) -> Column:
    """The pairs of a query string decoded, encoded again (the slash too) and sorted. A plus is a plus."""
    plain = lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    said = lambda x: F.replace(encoded(plain(x)), F.lit("/"), F.lit("%2F"))
    name = lambda x: F.substring_index(x, "=", 1)
    pairs = F.filter(F.split(raw, "&"), lambda x: x != "")
    return F.array_join(F.array_sort(F.transform(pairs, lambda x: F.concat(said(name(x)), F.lit("="), said(F.substr(x, F.length(name(x)) + 2))))), "&")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The hex tag of a string or binary column under a constant key."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def request_signature(key: bytes, scope: str, when: str, method: Column, path: Column, query: Column, headers: Column, signed: Column, payload: Column) -> Column:
    """The signature of canonical requests under a constant signing key and scope; headers: canonical lines, each with its line feed."""
    request = F.concat_ws("\n", method, path, canonical_query(query), headers, signed, payload)
    return hmac_sha256(key, F.concat_ws("\n", F.lit("AWS4-HMAC-SHA256"), F.lit(when), F.lit(scope), F.sha2(request, 256)))


def url_base64(data: Column) -> Column:
    """Base64 of a binary column, safe in addresses, without padding."""
    return F.translate(F.base64(data), "+/=\r\n", "-_")  # Spark breaks lines


def signed_value(secret: str, payload: Column) -> Column:
    """The payload and its tag, as a cookie holds them."""
    return F.concat(url_base64(payload.cast("binary")), F.lit("."), url_base64(F.unhex(hmac_sha256(secret.encode(), payload))))


def query_pairs(raw: Column) -> Column:
    """Map of a query string; of a repeated name the last value counts."""
    pairs = F.filter(F.split(raw, "&"), lambda x: x != "")
    entry = F.transform(pairs, lambda x: F.struct(F.try_url_decode(F.substring_index(x, "=", 1)).alias("k"), F.when(F.contains(x, F.lit("=")), F.try_url_decode(F.substr(x, F.instr(x, "=") + 1))).otherwise("").alias("v")))
    names = F.array_distinct(F.transform(entry, lambda e: e["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entry, lambda e: e["k"] == n), -1)["v"]))
