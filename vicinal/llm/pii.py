"""Personal data: patterns, and information-theoretic sanitisation of what gives them away.

E-mail addresses, IPv4 addresses, card and phone numbers are found by pattern; they are the protected
entities. Other terms of their documents may reveal them as well: the corpus tells how strongly. With n(e),
n(t), n(t, e) the documents that hold an entity, a term and both, and N all documents, the term discloses
pmi(t, e) = log2(n(t, e) N / (n(t) n(e))) of the entity's information log2(N / n(e)) (Sanchez and Batet,
2013). Where the share of the two reaches a threshold, all of the term's occurrences in documents of that
entity are spans too. They are generalised to the term of the entity's documents that discloses most among
those that are safe (in nearly all of them, at less than half the threshold), or removed if there is none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.plans.shared import materialize

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Least share of an entity's information that a term must reveal; least documents that must hold both, so that
#: chance meetings of rare words don't count; share of an entity's documents that hold its general term.
DISCLOSURE, SUPPORT, GENERAL = 0.8, 3, 0.8
#: Terms or entities that are broadcast at most (a few MB); beyond it documents and terms meet in a shuffle.
BROADCAST_TERMS = 100_000
#: Counted pairs that a task holds before it passes them on.
HELD = 1 << 18

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits has no earlier start, so looking behind for one loses nothing and keeps scans linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping addresses, found from each @ outwards."""
    free, last, at = 0, -1, text.find("@")
    while at >= 0:
        low = max(free, last + 1)
        start = low + len(text[low:at].rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            free = m.end()
        last, at = at, text.find("@", max(at + 1, free))


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield "ip", m.start(), m.end()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m.group())) <= 15:
            yield "phone", m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns in code points, by kind as listed, then start."""
    out = list(emails(text)) if "@" in text else []
    if _DIGITS.search(text):
        out += [*ips(text), *cards(text), *(phones(text) if "+" in text else ())]
    return out


def entity(kind: str, shown: str) -> str:
    """What an entity is called across documents: its kind and value, numbers by their digits."""
    return f"{kind}:{shown.lower() if kind in ('email', 'ip') else ''.join(_DIGITS.findall(shown))}"


def words(text: str, spans: list[Span]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of all words outside all spans; a term is three or more letters, in lower case."""
    taken = sorted((s, e) for _, s, e in spans)
    at, n, reach = 0, len(taken), 0
    for m in _WORD.finditer(text):
        s, e = m.span()
        while at < n and taken[at][0] < e:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= s:
            yield m.group().lower(), s, e


def entities(text: str, spans: list[Span]) -> set[str]:
    return {entity(k, text[s:e]) for k, s, e in spans}


def shown(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity) of each document, once each."""
    for batch in batches:
        found: list[str] = []
        for text in batch.column(0):
            text = text.as_py() or ""
            found += entities(text, base_spans(text))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["entity"])


def _pairs(wanted):
    """(term, entity, documents of this task that hold both) for entities of a broadcast set, or all if null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, counts = wanted.value, {}
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                if not (spans := base_spans(text)):
                    continue
                mine = entities(text, spans)
                if only is not None:
                    mine &= only
                terms = {t for t, _, _ in words(text, spans)} if mine else ()
                for pair in ((t, e) for e in mine for t in terms):
                    counts[pair] = counts.get(pair, 0) + 1
                    if len(counts) >= HELD:
                        yield _counted(counts)
                        counts = {}
        yield _counted(counts)

    return run


def _counted(counts: dict[tuple[str, str], int]) -> pa.RecordBatch:
    columns = [pa.array([t for t, _ in counts], pa.string()), pa.array([e for _, e in counts], pa.string()), pa.array(list(counts.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["term", "entity", "n"])


def _occurrences(vocabulary):
    """(term, documents of this task that hold it) for terms of a broadcast set, over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts = vocabulary.value, {}
        for batch in batches:
            for text in batch.column(0):
                for t in wanted.intersection(_WORD.findall((text.as_py() or "").lower())):
                    counts[t] = counts.get(t, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return run


def _all_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            words = sorted(set(_WORD.findall((text.as_py() or "").lower())))
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([1] * len(words), pa.int64())], names=["term", "n"])


def disclosing_terms(
    docs: DataFrame, text_col: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT, broadcast_terms: int = BROADCAST_TERMS
) -> DataFrame:
    """(term, entity, share, general) over all documents: term reveals at least `disclosure` of entity, and
    general, which may be null, takes its place."""
    texts = docs.select(text_col)
    share = docs.sparkSession.sparkContext.broadcast
    total = texts.count()
    known = texts.mapInArrow(_entities, "entity string").groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    # an entity in fewer documents has no term with that support
    known = materialize(known.where(F.col("n_entity") >= support), "entities")
    few = known.count() <= broadcast_terms
    wanted = share(frozenset(r["entity"] for r in known.select("entity").collect()) if few else None)
    often = texts.mapInArrow(_pairs(wanted), "term string, entity string, n long").groupBy("term", "entity").agg(F.sum("n").alias("both"))
    often = materialize(often.where(F.col("both") >= support), "often")
    terms = materialize(often.select("term").distinct(), "terms")
    if terms.count() <= broadcast_terms:
        counted = texts.mapInArrow(_occurrences(share(frozenset(r["term"] for r in terms.collect()))), "term string, n long")
    else:
        counted = texts.mapInArrow(_all_words, "term string, n long").join(terms, "term", "left_semi")
    n_term = counted.groupBy("term").agg(F.sum("n").alias("n_term"))
    joined = often.join(n_term, "term").join(known, "entity")
    information = F.log2(F.lit(float(total)) / F.col("n_entity"))
    pmi = F.log2(F.col("both") * float(total) / (F.col("n_term") * F.col("n_entity")))
    shares = joined.withColumn("share", F.when(information > 0, pmi / information).otherwise(F.lit(0.0)))
    shares = materialize(shares, "shares")
    safe = (F.col("both") >= GENERAL * F.col("n_entity")) & (F.col("share") < disclosure / 2)
    general = shares.where(safe).groupBy("entity").agg(F.min(F.struct(-F.col("share"), "term")).alias("g")).select("entity", F.col("g.term").alias("general"))
    return shares.where(F.col("share") >= disclosure).join(general, "entity", "left").select("term", "entity", "share", "general")


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, entity, term) for every entity and term of a text; digest identifies the text."""
    for batch in batches:
        for digest, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py() or ""
            if not (spans := base_spans(text)):
                continue
            terms = sorted({t for t, _, _ in words(text, spans)})
            for e in sorted(entities(text, spans)):
                columns = [pa.array([digest.as_py()] * len(terms), pa.binary()), pa.array([e] * len(terms), pa.string()), pa.array(terms, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "entity", "term"])


def _marks(table, names: list[str], write: bool):
    """Marks rows (id, text, [(term, general)] or null); table: broadcast {entity: {term: general}} for null ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, known in zip(batch.column(1), batch.column(2), strict=True):
                text, known = text.as_py() or "", known.as_py()
                base = base_spans(text)
                pairs = [(x["term"], x["general"]) for x in known or ()]
                if known is None and base:
                    pairs = [x for e in entities(text, base) for x in table.value.get(e, {}).items()]
                # a term of several entities takes the general term that is first by name
                becomes: dict[str, str] = {}
                for t, g in pairs:
                    if becomes.setdefault(t, g or "") and g:
                        becomes[t] = min(becomes[t], g)
                    elif g:
                        becomes[t] = g
                more = [(t, s, e) for t, s, e in words(text, base) if t in becomes] if becomes else []
                spans = [*base, *((TERM, s, e) for _, s, e in more)]
                count = [sum(k == x for k, _, _ in base) for x in KINDS]
                digest = hashlib.sha256(shown(base).encode()).hexdigest()
                clean = [sanitise(text, base, [(becomes[t], s, e) for t, s, e in more])] if write else []
                rows.append((*count, digest, shown(spans), len(more), len(spans), *clean))
            columns = zip(*rows, strict=True) if rows else [[]] * (len(names) - 1)
            types = [*[pa.int64()] * len(KINDS), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=False))], names=names)

    return run


def sanitise(text: str, base: list[Span], terms: list[tuple[str, int, int]]) -> str:
    """Entities become their kind in brackets, terms (general, start, end) their general term in brackets or
    nothing. Overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, s, e in sorted([*base, *terms], key=lambda x: (x[1], -x[2])):
        if s < at:
            at = max(at, e)
            continue
        out += [text[at:s], f"[{kind}]" if kind else ""]
        at = e
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", write: bool = True, **options) -> DataFrame:
    """One row per row of docs: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms, n_spans and,
    with write, the sanitised text.

    spans lists kind:start:end in code points, ends exclusive: base kinds in the order of KINDS, then the
    disclosing terms, each by start. Null texts are empty. Repeated rows count as separate documents in
    the co-occurrence. Null ids pass through. An empty table gives no rows. Other columns are not read.

    Entities and disclosing terms are broadcast where there are at most BROADCAST_TERMS of them; beyond it
    the pairs of all entities are counted, and the documents with entities are joined with the terms.
    """
    options = {"broadcast_terms": BROADCAST_TERMS} | options
    table = materialize(disclosing_terms(docs, text_col, **options), "disclosing")
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_terms", "n_spans", *(["sanitised"] if write else [])]
    schema = f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_terms long, n_spans long"
    schema += ", sanitised string" if write else ""
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    terms: dict[str, dict[str, str | None]] = {}
    pair = "array<struct<term:string,general:string>>"
    if table.count() <= options["broadcast_terms"]:
        for r in table.collect():
            terms.setdefault(r["entity"], {})[r["term"]] = r["general"]
        found = found.withColumn("known", F.lit(None).cast(pair))
    else:
        keyed = found.withColumn("digest", F.unhex(F.sha2("text", 256)))
        known = keyed.select("digest", "text").mapInArrow(_candidates, "digest binary, entity string, term string")
        known = known.join(table, ["entity", "term"]).groupBy("digest").agg(F.collect_set(F.struct("term", "general")).alias("known"))
        found = keyed.join(known, "digest", "left").select("id", "text", F.coalesce("known", F.array().cast(pair)).alias("known"))
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    return found.mapInArrow(_marks(shared, names, write), schema).withColumnRenamed("id", id_col)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def pii_base_counts(spark, sf_dir: str) -> DataFrame:
    """Of op5's columns those that SQL can make too."""
    return op5_pii(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in KINDS))


BASE_COUNTS_SQL = r"""WITH m AS (SELECT doc_id,
      regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email,
      regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
      list_transform(regexp_extract_all(text, '[0-9]([ -]?[0-9])+'), lambda x: regexp_replace(x, '[ -]', '', 'g')) AS card,
      list_transform(regexp_extract_all(text, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM documents)
    SELECT doc_id, coalesce(len(email), 0) AS n_email,
      coalesce(len(list_filter(ip, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: coalesce(TRY_CAST(y AS HUGEINT), 999))) <= 255)), 0) AS n_ip,
      coalesce(len(list_filter(card, lambda x: len(x) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(x) + 1),
        lambda i: CASE WHEN i % 2 = 1 THEN CAST(x[-i] AS INTEGER) WHEN CAST(x[-i] AS INTEGER) < 5 THEN 2 * CAST(x[-i] AS INTEGER) ELSE 2 * CAST(x[-i] AS INTEGER) - 9 END)) % 10 = 0)), 0) AS n_card,
      coalesce(len(list_filter(phone, lambda x: len(x) BETWEEN 9 AND 15)), 0) AS n_phone FROM m"""
