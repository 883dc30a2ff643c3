"""The store's XML and JSON documents: answers as string columns, request bodies as columns of what they ask for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of the answers, and what goes before every document.
XMLNS = "http://s3.amazonaws.com/doc/2006-03-01/"
PROLOGUE = '<?xml version="1.0" encoding="UTF-8"?>\n'


def text_escaped(s: Column) -> Column:
    for plain, said in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(plain), F.lit(said))
    return s


def element(name: str, value: Column) -> Column:
    """An element around text; short where the text is empty, and nothing at all where it is null."""
    text = value.cast("string")
    said = F.when(text == "", F.lit(f"<{name}/>")).otherwise(F.concat(F.lit(f"<{name}>"), text_escaped(text), F.lit(f"</{name}>")))
    return F.coalesce(said, F.lit(""))


def group(name: str, *children: Column) -> Column:
    """An element around elements."""
    return F.concat(F.lit(f"<{name}>"), *children, F.lit(f"</{name}>"))


def document(root: str, *children: Column) -> Column:
    return F.concat(F.lit(f'{PROLOGUE}<{root} xmlns="{XMLNS}">'), *children, F.lit(f"</{root}>"))


def error(code: Column, message: Column) -> Column:
    quoted = F.replace(F.replace(text_escaped(message), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&apos;"))
    return F.concat(F.lit(PROLOGUE), group("Error", element("Code", code), F.lit("<Message>"), quoted, F.lit("</Message>")))


def delete_body(xml: Column) -> Column:
    """struct(keys, quiet) of a batch delete; null where it cannot be read or an object has no key."""
    kind = "Object array<struct<Key: string>>, Quiet string, _corrupt_record string"
    said = F.from_xml(xml, kind, {"rowTag": "Delete", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"})
    keys = F.coalesce(F.transform(said["Object"], lambda o: o["Key"]), F.array().cast("array<string>"))
    quiet = F.coalesce(F.trim(said["Quiet"]) == "true", F.lit(False))
    good = said["_corrupt_record"].isNull() & xml.isNotNull() & ~F.exists(keys, lambda k: k.isNull())
    return F.when(good, F.struct(keys.alias("keys"), quiet.alias("quiet")))


def complete_body(body: Column, form: str = "xml") -> Column:
    """array of struct(part_number, etag) in the order of a completing request, in XML or JSON; an etag may be absent.
    Null where it cannot be read or a part has no number."""
    if form == "xml":
        said = F.from_xml(body, "Part array<struct<PartNumber: int, ETag: string>>, _corrupt_record string", {"rowTag": "CompleteMultipartUpload", "mode": "PERMISSIVE"})
        parts = F.coalesce(said["Part"], F.array().cast("array<struct<PartNumber: int, ETag: string>>"))
        parts = F.transform(parts, lambda p: F.struct(p["PartNumber"].alias("part_number"), p["ETag"].alias("etag")))
        good = said["_corrupt_record"].isNull() & body.isNotNull()
    else:
        said = F.from_json(body, "parts array<struct<part_number: int, etag: string>>, _corrupt_record string", {"mode": "PERMISSIVE"})
        parts, good = said["parts"], said["_corrupt_record"].isNull()  # parts must be there
    return F.when(good & ~F.exists(parts, lambda p: p["part_number"].isNull()), parts)


def delete_answer(deleted: Column, failed: Column, quiet: Column) -> Column:
    """deleted: array of keys; failed: array of struct(key, code, message). Quiet hides what went well, never what failed."""
    well = F.array_join(F.transform(deleted, lambda k: group("Deleted", element("Key", k))), "")
    ill = F.transform(failed, lambda e: group("Error", element("Key", e["key"]), element("Code", e["code"]), element("Message", e["message"])))
    return document("DeleteResult", F.when(quiet, "").otherwise(well), F.array_join(ill, ""))


def complete_answer(ns: Column, key: Column, tag: Column) -> Column:
    return document("CompleteMultipartUploadResult", element("Location", F.concat(F.lit("/"), ns, F.lit("/"), key)), element("Bucket", ns), element("Key", key), element("ETag", tag))
