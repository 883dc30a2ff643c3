"""Personal data: base patterns, and words that reveal the entities they find, by information content.

Base spans are e-mail and IP addresses, card and phone numbers. Around each, the words within a window are its context.
For a term t and a protected entity e (a base value), counts of documents over the whole corpus give the pointwise mutual
information PMI(t; e) and the entity's information content IC(e) = -log p(e); their ratio is the share of the entity's
identity that the term discloses. A term counts for e if it stands in the context of e in `support` different texts, or in all
texts of e if there are fewer; such thin evidence is smoothed by one more text that holds the term without e. With a ratio of
at least `generalise` the term is a span to generalise wherever it occurs in any text, and of at least `remove` one to remove.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.base import filled_slots, mapped, may_be_in, saved

KINDS = ("email", "ip", "card", "phone")
LEARNED = ("generalise", "remove")
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}
#: Slots of the filter of candidate terms that every counting task gets; each term fills as many as there are shifts of its hash.
SLOTS, SHIFTS = 1 << 23, (0, 21, 41)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_][^\W_]{2,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the whole pattern, found from each @: a long run without one costs nothing."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start. Candidates that fail their check are dropped."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdecimal, m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def terms_of(text: str) -> set[str]:
    return {w.lower() for w in set(_TERM.findall(text))}


def context(text: str, spans: list[tuple[str, int, int]], words: int, reach: int) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end): up to `words` terms on each side of each span, whole ones within `reach` characters, outside of all spans."""
    taken = [(a, b) for _, a, b in spans]
    found = []
    for kind, a, b in spans:
        entity = f"{kind}:{text[a:b].lower()}"
        before = [m for m in _TERM.finditer(text, max(0, a - reach), a) if m.start() > a - reach or a <= reach][-words:]
        after = [m for m in _TERM.finditer(text, b, min(len(text), b + reach)) if m.end() < b + reach or b + reach >= len(text)][:words]
        for m in before + after:
            if not any(x < m.end() and m.start() < y for x, y in taken):
                found.append((entity, m[0].lower(), m.start(), m.end()))
    return found


def _passing(terms: set[str], filled: bytes) -> set[str]:
    """The terms all of whose slots are filled."""
    digest, low = xxhash.xxh64_intdigest, SLOTS - 1
    hashed = ((t, digest(t.encode("utf-8", "surrogatepass"), 42)) for t in terms)
    return {t for t, h in hashed if filled[h & low] and all(filled[h >> k & low] for k in SHIFTS[1:])}


def _filter(wanted: DataFrame) -> Broadcast:
    """Of SLOTS slots, those that wanted(term) fill; its size is fixed."""
    h = F.xxhash64("term")
    slots = wanted.select(F.explode(F.array(*[F.shiftrightunsigned(h, k).bitwiseAND(F.lit(SLOTS - 1)).cast("int") for k in SHIFTS])).alias("s"))
    filled = filled_slots(slots, SLOTS)
    return wanted.sparkSession.sparkContext.broadcast(np.unpackbits(filled.view(np.uint8), bitorder="little").tobytes())  # a byte for each slot: the fastest to look up one by one


def _counted(texts: DataFrame, wanted: DataFrame, flush: int = 200_000) -> DataFrame:
    """(term, n): in how many rows of texts(text) each of wanted(term) occurs. The filter lets some others through; the join is exact."""
    shared = _filter(wanted)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        open_ = shared.value
        for batch in batches:
            for text in batch["text"]:
                if text:
                    seen.update(_passing(terms_of(text), open_))
                if len(seen) >= flush:
                    yield pd.DataFrame({"term": list(seen), "n": list(seen.values())})
                    seen.clear()
        if seen:
            yield pd.DataFrame({"term": list(seen), "n": list(seen.values())})

    counts = texts.mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    return counts.join(wanted, "term", "left_semi")


def occurrences(texts: DataFrame, told: DataFrame) -> DataFrame:
    """(t, start, end, share): every place of the terms of told(term, share) in texts(t, text), outside of base spans."""
    shared = _filter(told)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = shared.value
        for batch in batches:
            found = []
            for t, text in batch.drop_duplicates("t").itertuples(index=False):
                hits = _passing(terms_of(text), open_)
                if hits:
                    taken = base_spans(text)
                    for m in _TERM.finditer(text):
                        if (w := m[0].lower()) in hits and not any(a < m.end() and m.start() < b for _, a, b in taken):
                            found.append((t, w, m.start(), m.end()))
            if found:
                yield pd.DataFrame(found, columns=["t", "term", "start", "end"])

    places = texts.select("t", "text").mapInPandas(find, "t long, term string, start int, end int")
    return places.join(told, "term").groupBy("t", "start", "end").agg(F.max("share").alias("share"))


def found_spans(docs: DataFrame, text_col: str = "text", words: int = 8, reach: int = 200) -> Column:
    """struct(base, context) of a text column; null texts count as empty."""

    def find(texts: pd.Series) -> pd.DataFrame:
        base, near = [], []
        for text in texts:
            spans = base_spans(text) if text else []
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            near.append([{"entity": e, "term": t, "start": a, "end": b} for e, t, a, b in context(text, spans, words, reach)] if spans else [])
        return pd.DataFrame({"base": base, "context": near})

    kind = "struct<base: array<struct<kind: string, start: int, end: int>>, context: array<struct<entity: string, term: string, start: int, end: int>>>"
    return mapped(find, kind, F.col(text_col).cast("string"))


def disclosing_terms(found: DataFrame, texts: DataFrame, n: int, generalise: float, support: int) -> DataFrame:
    """(entity, term, share): the pairs whose disclosure reaches `generalise`.

    found(t, context) has a row for each document, t being the hash of its text; texts(text) are all documents, n their number.
    """
    near = found.where(F.size("context") > 0).select("t", F.explode(F.array_distinct(F.transform("context", lambda c: F.struct(c["entity"].alias("entity"), c["term"].alias("term"))))).alias("c"))
    pairs = near.groupBy("c.entity", "c.term", "t").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count("*").alias("texts"))
    held = found.where(F.size("context") > 0).select("t", F.explode(F.array_distinct(F.transform("context", lambda c: c["entity"]))).alias("entity"))
    n_e = held.groupBy("entity", "t").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("e_texts"))
    pairs = saved(pairs.join(n_e, "entity").where(F.col("texts") >= F.least(F.lit(support), F.col("e_texts"))))
    n_t = _counted(texts, pairs.select("term").distinct())
    both = pairs.join(n_t, "term").withColumn("n_t", F.col("n_t") + (F.col("texts") < support).cast("int"))
    information = F.log(F.lit(float(max(n, 1))) / F.col("n_e"))
    mutual = F.log(F.col("n_te") * F.lit(float(max(n, 1))) / (F.col("n_t") * F.col("n_e")))
    both = both.select("entity", "term", F.when(information > 0, mutual / information).otherwise(0.0).alias("share"))
    return both.where(F.col("share") >= generalise)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = 0.8, remove: float = 0.99, support: int = 2, words: int = 8, reach: int = 200) -> DataFrame:
    """(doc_id, t, base, learned) for every row of docs: arrays of struct(kind, start, end), by kind, then start.

    t is the hash of the text; equal texts get equal spans. Null texts count as empty and have no spans. Overlapping spans of
    different kinds are all given. Rows with equal or null ids are kept apart; an empty table gives no rows; extra
    columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    found = rows.select("doc_id", F.xxhash64("text").alias("t"), found_spans(rows, "text", words, reach).alias("f"))
    found = saved(found.select("doc_id", "t", "f.base", "f.context"))
    told = disclosing_terms(found.select("t", "context"), rows.select("text"), found.count(), generalise, support)
    told = saved(told.groupBy("term").agg(F.max("share").alias("share")))
    places = occurrences(rows.select(F.xxhash64("text").alias("t"), "text"), told)
    span = F.struct(F.when(F.col("share") >= remove, F.lit("remove")).otherwise(F.lit("generalise")).alias("kind"), "start", "end")
    # written first: then Spark can split a text that many rows share in the join
    learned = saved(places.groupBy("t").agg(F.sort_array(F.collect_list(span)).alias("learned")))
    none = F.array().cast("array<struct<kind: string, start: int, end: int>>")
    return found.select("doc_id", "t", "base").join(learned, "t", "left").select("doc_id", "t", "base", F.coalesce("learned", none).alias("learned"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _replaced(text: str | None, learned: list[tuple[str, int, int]]) -> str | None:
    """text with its base spans and the learned ones replaced by their marks; of overlapping spans, the first and longest whole."""
    spans = base_spans(text) + learned if text else []
    if not spans:
        return text
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            parts += [text[at:a], MARKS[kind]]
        at = max(at, b)
    return "".join(parts) + text[at:]


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """docs with the same columns, spans of its texts replaced by marks of their kind (removed terms by nothing), and n_chars, if there, recounted.

    Of overlapping spans, the first and longest is replaced whole. Null texts stay null. Base spans are found again in
    place; only texts with learned spans go through an exchange, to meet them.
    """
    learned = personal_data(docs, id_col, text_col, **options).where(F.size("learned") > 0).select(F.col("t").alias("__tp_t"), F.col("learned").alias("__tp_learned"))
    learned = saved(learned.dropDuplicates(["__tp_t"]))

    shared = may_be_in(learned.select(F.col("__tp_t").alias("key")))

    def replace(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        """The texts that surely have no learned spans; the others follow after the join."""
        later = shared(keys)
        return pd.DataFrame({"later": later, "text": pd.Series([None if w else _replaced(x, []) for x, w in zip(texts, later)], dtype=object)})

    def replace_all(texts: pd.Series, found: pd.Series) -> pd.Series:
        own = ([] if spans is None else [(s["kind"], s["start"], s["end"]) for s in spans] for spans in found)
        return pd.Series([_replaced(text, spans) for text, spans in zip(texts, own)], dtype=object)

    text = F.col(text_col).cast("string")
    keyed = docs.withColumn("__tp_t", F.xxhash64(F.coalesce(text, F.lit(""))))
    met = keyed.where(mapped(shared, "boolean", F.col("__tp_t"))).join(learned.hint("merge"), "__tp_t", "left")
    met = met.withColumn(text_col, mapped(replace_all, "string", text, F.col("__tp_learned")))
    done = keyed.withColumn("__tp_new", mapped(replace, "struct<later: boolean, text: string>", text, F.col("__tp_t"))).where("not __tp_new.later")
    out = done.withColumn(text_col, F.col("__tp_new.text")).select(*docs.columns).unionByName(met.select(*docs.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(text_col).isNotNull(), F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out
