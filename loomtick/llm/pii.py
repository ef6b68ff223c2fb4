"""Information-theoretic sanitisation of personal data.

The plain patterns (email, ip, card, phone) find the protected entities.  The
corpus says how much a term gives an entity away: with n(t), n(c) and n(t, c)
documents that hold the term, the entity, and both anywhere in them,

    pmi(t, c) = log2(N * n(t, c) / (n(t) * n(c)))      ic(c) = log2(N / n(c))

A term with pmi(t, c) >= disclosure * ic(c) > 0 discloses the entity, however few
documents hold it: all its occurrences in documents that hold the entity become
spans of kind ``term``.  Where the term never occurs without the entity it is
removed, otherwise generalised.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtick.llm.common import in_arrow, text_key, text_slices, written

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def _luhn(digits: list[int]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain patterns by kind, then start; linear in the text."""
    out: list[tuple[str, int, int]] = []
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        at += 1
        free = max(free, at)  # no match holds this sign before its domain
        if m:
            at = m.end()
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := _DIGIT.findall(m[0])) <= 19 and _luhn([*map(int, d)]):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by kind as listed, then start."""
    order = sorted({(KINDS.index(k), a, b) for k, a, b in spans})
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in order)


def entity_of(kind: str, value: str) -> bytes:
    """16 bytes that stand for an entity."""
    return hashlib.blake2b(f"{kind}:{value.lower()}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def free_terms(text: str, spans: list[tuple[str, int, int]]) -> dict[str, list[int]]:
    """Starts and ends, in turn, of all occurrences of each term outside the spans."""
    out: dict[str, list[int]] = {}
    ends: list[int] = []  # of the spans, united
    begins: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    for m in _TERM.finditer(text):
        a, b = m.span()
        i = bisect.bisect_right(ends, a)
        if i == len(ends) or begins[i] >= b:
            out.setdefault(m[0].lower(), []).extend((a, b))
    return out


def protected(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, entities, terms): the plain spans of every row, and the terms beside them where it has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_type = pa.list_(pa.struct([("term", pa.string()), ("at", pa.list_(pa.int64()))]))
        for batch in text_slices(batches, 2):
            base, entities, terms = [], [], []
            for value in batch.column(2):
                text = value.as_py() or ""
                spans = base_spans(text)
                base.append(joined(spans))
                entities.append(sorted({entity_of(k, text[a:b]) for k, a, b in spans}))
                terms.append([{"term": t, "at": at} for t, at in free_terms(text, spans).items()] if spans else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, pa.string()), pa.array(entities, pa.list_(pa.binary())), pa.array(terms, terms_type)], ["doc_id", "key", "base", "entities", "terms"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    return rows.transform(in_arrow, run, "doc_id long, key binary, base string, entities array<binary>, terms array<struct<term:string,at:array<long>>>")


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, n): documents that hold each term, counted over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        packed = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
        for batch in batches:
            for value in batch.column(0):
                counts.update({t.lower() for t in _TERM.findall(value.as_py() or "")})
                if len(counts) > 500_000:
                    yield packed()
                    counts.clear()
        yield packed()

    return docs.select(F.col("text").cast("string")).transform(in_arrow, run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing(rows: DataFrame, docs: DataFrame, disclosure: float = 0.8) -> DataFrame:
    """(key, at, removed): occurrences of terms that give an entity of a text away, by the counts of the whole corpus.

    n(t, c) is at most n(t) and n(c), so a term of too many documents can be left
    out before it meets the entities.  The entities that no other text holds stand
    in the same documents, so one of them stands for all.
    """
    total = rows.count()
    texts = rows.where(F.size("entities") > 0).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    texts = written(texts, "pii-texts")
    held = texts.select("key", "n", F.explode("entities").alias("entity"))
    entities = held.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("n_texts"))
    held = held.select("key", "entity").join(entities, "entity").groupBy("key", F.when(F.col("n_texts") > 1, F.col("entity")).alias("shared"))
    held = written(held.agg(F.min("entity").alias("entity"), F.min("n_entity").alias("n_entity")).select("key", "entity", "n_entity"), "pii-entities")
    share = F.col("n_entity") / F.lit(float(total))
    most = F.greatest(F.col("n_entity").cast("double"), total * F.pow(share, F.lit(float(disclosure))))  # of n(t)
    limits = held.groupBy("key").agg(F.max(most * (1 + 1e-9)).alias("most"))
    each = texts.join(limits, "key").select("key", "n", "most", F.explode("terms").alias("t")).select("key", "n", "most", "t.term", "t.at")
    each = each.join(document_frequencies(docs), "term").where(F.col("n_term") <= F.col("most"))
    each = written(each.select("key", "n", "term", "n_term", "at"), "pii-candidates")
    met = each.select("key", "n", "term", "n_term").join(held, "key").where(F.col("n_term") <= most * (1 + 1e-9))
    met = written(met, "pii-pairs")
    pairs = met.groupBy("term", "entity").agg(F.sum("n").alias("n_both"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"))
    pmi = F.log2(total * F.col("n_both").cast("double") / (F.col("n_term") * F.col("n_entity")))
    # equal counts are compared exactly: logarithms of both sides may differ in the last bits
    enough = (F.col("n_both") >= F.col("n_term")) & F.lit(disclosure <= 1) | (pmi >= disclosure * F.log2(1 / share))
    found = pairs.where(enough & (pmi > 0)).select("term", "entity", (F.col("n_both") >= F.col("n_term")).alias("removed"))
    found = met.select("key", "term", "entity").join(found, ["term", "entity"]).groupBy("key", "term").agg(F.max("removed").alias("removed"))
    return each.select("key", "term", "at").join(found, ["key", "term"]).select("key", "at", "removed")


def find_personal_data(docs: DataFrame, disclosure: float = 0.8) -> DataFrame:
    """Personal data and the terms that disclose it: one row for each row of ``docs``.

    doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (all, as code points,
    end exclusive), n_term, and removed (``start:end`` of the terms to cut; the
    other ones are to be generalised).  A null text counts as empty.  Equal texts
    have equal results, so decisions are taken once for each text and joined back
    to its rows; copies of one text are spread by the adaptive skew join.
    """
    rows = written(protected(docs), "pii")
    flagged = disclosing(rows, docs, disclosure)
    place = lambda i: F.struct(F.col("at")[2 * i].alias("a"), F.col("at")[2 * i + 1].alias("b"), F.col("removed").alias("removed"))
    places = F.transform(F.sequence(F.lit(0), (F.size("at") / 2).cast("int") - 1), place)
    spans = flagged.groupBy("key").agg(F.flatten(F.collect_list(places)).alias("found"))
    spans = spans.select(
        "key",
        F.array_sort(F.array_distinct(F.transform("found", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))))).alias("terms"),
        F.array_sort(F.transform(F.filter("found", lambda s: s["removed"]), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b")))).alias("cut"),
    )
    text = lambda prefix, c: F.array_join(F.transform(c, lambda s: F.concat(F.lit(prefix), s["a"].cast("string"), F.lit(":"), s["b"].cast("string"))), ",")
    spans = spans.select("key", F.size("terms").cast("long").alias("n_term"), text("term:", "terms").alias("term_spans"), text("", F.array_distinct("cut")).alias("removed"))
    out = rows.select("doc_id", "key", "base").join(written(spans, "pii-spans"), "key", "left")
    kinds = F.split("base", ",")
    count = lambda k: F.size(F.filter(kinds, lambda s: s.startswith(k + ":"))).cast("long").alias("n_" + k)
    full = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.coalesce(F.col("term_spans"), F.lit("")) != "", F.col("term_spans")))
    return out.select("doc_id", *map(count, KINDS[:4]), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), full.alias("spans"), F.coalesce("n_term", F.lit(0).cast("long")).alias("n_term"), F.coalesce("removed", F.lit("")).alias("removed"))


#: What a span of each kind is generalised to.
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}


def masked(text: str, spans: str, removed: str = "") -> str:
    """The text with its spans generalised, and terms in ``removed`` cut."""
    cut = set(removed.split(",")) if removed else set()
    parts, at = [], 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)), key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        parts += [text[at : max(a, at)], "" if kind == "term" and f"{a}:{b}" in cut else MASKS[kind]]
        at = b
    return "".join([*parts, text[at:]])


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text): every text with its personal data masked, by ``find_personal_data``.

    Rows of ``docs`` meet their spans by id and the spans' own text, so the id has
    to name a text (rows that share id and text are returned once).
    """
    found = find_personal_data(docs, **options).select("doc_id", "base_sha256", "spans", "removed").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [masked(t or "", s or "", r or "") for t, s, r in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4)), strict=True)]
            keep = [hashlib.sha256(joined(base_spans(t or "")).encode()).hexdigest() == h for t, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])
            yield made.filter(pa.array(keep))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).distinct()
    both = rows.join(found.withColumnRenamed("doc_id", "_id"), rows["doc_id"].eqNullSafe(F.col("_id"))).select("doc_id", "text", "base_sha256", "spans", "removed")
    return both.transform(in_arrow, run, "doc_id long, text string")
