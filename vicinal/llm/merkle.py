"""Document fingerprints: Merkle trees over sections, paragraphs and runs of words.

A leaf is the digest of a run of words' bytes; leaves joined are the text. A paragraph (a line) is the
digest of its leaves' digests, a section of its paragraphs', the root of its sections'. A section ends at
a blank line or at a paragraph whose digest says so, so equal runs of text build equal branches wherever
they stand. A fingerprint is the tree as text, root and leaves: all between follows from the leaves.

    root|leaves,leaves;leaves     root in hexadecimal, leaves in base 64, 16 characters each;
                                  ',' between paragraphs, ';' between sections

Roots test equality, a descent into branches that differ finds what was edited, and the digests beside a
paragraph's way to the root prove that it is part of the text.
"""

from __future__ import annotations

import re
from base64 import urlsafe_b64decode, urlsafe_b64encode
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.ranges import Ranges

#: Words of a leaf, at least and at most (between them it ends with a sentence); one in how many paragraphs closes a
#: section; bytes of the root and of other digests (96 bits: 10^10 texts have a pair of equal leaves by chance with
#: a probability of 10^-9).
FEWEST_WORDS, MOST_WORDS, SECTION, ROOT, NODE = 8, 16, 16, 16, 12
#: Characters of a digest in base 64.
SHOWN = NODE * 4 // 3
#: Rows of a range of ids, on average.
RANGE_ROWS = 5_000

_RUN = re.compile(rf"\s*(?:\S++\s++){{0,{FEWEST_WORDS - 1}}}(?:\S++(?<![.!?])\s++){{0,{MOST_WORDS - FEWEST_WORDS}}}\S++\s*+|\s+")


def leaf(data: bytes) -> bytes:
    return blake2b(data, digest_size=NODE, person=b"leaf").digest()


def node(children: list[bytes], size: int = NODE) -> bytes:
    """The digest of a node with these children; no leaf has it, whatever its bytes."""
    return blake2b(b"".join(children), digest_size=size, person=b"node").digest()


def runs(paragraph: str) -> list[str]:
    """A paragraph cut by words and, where that is near, at the ends of sentences; joined they are the paragraph."""
    return _RUN.findall(paragraph)


Paragraph = tuple[bytes, list[bytes]]


@dataclass
class Tree:
    """Sections, each its paragraphs; a paragraph is its digest and its leaves' digests."""

    sections: list[list[Paragraph]]

    @cached_property
    def branches(self) -> list[bytes]:
        return [node([p for p, _ in s]) for s in self.sections]

    @cached_property
    def root(self) -> str:
        return node(self.branches, ROOT).hex()

    def __str__(self) -> str:
        # digests are multiples of three bytes, so joined digests are joined characters
        shown = (",".join(urlsafe_b64encode(b"".join(ls)).decode() for _, ls in s) for s in self.sections)
        return f"{self.root}|{';'.join(shown)}"


def tree(text: str | None) -> Tree:
    """The tree of a text; null is the empty text, whose tree has no sections."""
    sections: list[list[Paragraph]] = []
    current: list[Paragraph] = []
    for line in (text or "").splitlines(keepends=True):
        leaves = [leaf(x.encode("utf-8", "surrogatepass")) for x in runs(line)]
        digest = node(leaves)
        current.append((digest, leaves))
        if not line.strip() or int.from_bytes(digest[:4]) % SECTION == 0:
            sections.append(current)
            current = []
    return Tree([*sections, current] if current else sections)


def fingerprint(text: str | None) -> str:
    return str(tree(text))


def parse(print_: str) -> Tree:
    """The tree of a fingerprint, made anew from its leaves; an error if they don't give the root."""
    root, _, body = print_.partition("|")
    sections = []
    for part in body.split(";") if body else []:
        shown = [urlsafe_b64decode(p) for p in part.split(",")]
        leaves = [[p[i : i + NODE] for i in range(0, len(p), NODE)] for p in shown]
        sections.append([(node(x), x) for x in leaves])
    found = Tree(sections)
    if found.root != root:
        raise ValueError("leaves and root disagree")
    return found


def proof(found: Tree, section: int, paragraph: int) -> tuple[list[bytes], list[bytes], int, int]:
    """What proves a paragraph's place: the digests of its section's paragraphs and of all sections."""
    return [p for p, _ in found.sections[section]], found.branches, section, paragraph


def proves(root: str, line: str, shown: tuple[list[bytes], list[bytes], int, int]) -> bool:
    """Whether a line, with its line end, stands where the proof says in the text of this root."""
    paragraphs, branches, i, j = shown
    own = node([leaf(x.encode("utf-8", "surrogatepass")) for x in runs(line)])
    return paragraphs[j] == own and branches[i] == node(paragraphs) and node(branches, ROOT).hex() == root


def differing(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """(section, paragraph) of tree a that are nowhere in tree b: where a was edited."""
    if a.root == b.root:
        return []
    whole = Counter(b.branches)
    apart = [i for i, s in enumerate(a.branches) if not _take(whole, s)]
    inside = Counter(p for s, ps in zip(b.branches, b.sections, strict=True) if _take(whole, s) for p, _ in ps)
    return [(i, j) for i in apart for j, (p, _) in enumerate(a.sections[i]) if not _take(inside, p)]


def _take(bag: Counter, key: bytes) -> bool:
    if bag[key] > 0:
        bag[key] -= 1
        return True
    return False


def likeness(a: Tree, b: Tree) -> float:
    """From 0 to 1: twice the leaves that both have, over all leaves, found from the root down. Equal
    branches count whole; only branches that differ are opened. Empty texts are only like each other."""
    if a.root == b.root:
        return 1.0
    total = sum(len(ls) for t in (a, b) for s in t.sections for _, ls in s)
    common, left, right = 0, list(zip(a.branches, a.sections, strict=True)), list(zip(b.branches, b.sections, strict=True))
    for size in (lambda ps: sum(len(ls) for _, ls in ps), len):
        bag = Counter(digest for digest, _ in right)
        rest_left = []
        for digest, inside in left:
            if _take(bag, digest):
                common += size(inside)
            else:
                rest_left.append(inside)
        rest_right = [inside for digest, inside in right if _take(bag, digest)]
        left, right = [x for s in rest_left for x in s], [x for s in rest_right for x in s]
    common += sum((Counter(left) & Counter(right)).values())
    return min(1.0, 2 * common / total)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points (rounded down) replaced by as many of the next text's first."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def _row(text: str, own: Tree, following: str, other: Tree) -> tuple:
    changed = edited(text, following)
    new = tree(changed)
    digest = sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), digest, str(own), str(new), likeness(own, new), likeness(own, other), own.root


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part and id; each is paired with the next. The last of a part meets a copy of the row
    that follows it, which is marked as ahead."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "root"]
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
    part, before = None, None
    for batch in batches:
        types[0] = batch.schema.field("id").type
        out = []
        for p, ahead, key, text in zip(*(batch.column(c) for c in ("part", "ahead", "id", "text")), strict=True):
            p, ahead, key, text = p.as_py(), ahead.as_py(), key.as_py(), text.as_py()
            if p != part:
                part, before = p, None
            elif before is None:
                continue  # a further copy of what is ahead
            own = tree(text)
            if before:
                out.append((before[0], *_row(before[1], before[2], text, own)))
            before = None if ahead else (key, text, own)
            if len(out) >= 500:
                yield _batch(out, names, types)
                out = []
        if out:
            yield _batch(out, names, types)


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, root.

    The edited text takes its new end from the next row by ascending id (after the last: the first, so a
    single row is its own next). Null texts are empty. Rows with one id follow each other by a hash of the
    text, then by text; null ids come before all others and are returned as null. Ids are of any type that
    has an order. An empty table gives no rows.

    Texts move once: rows are dealt by range of ids, of about equal numbers of rows, and sorted within it.
    Each range also gets a copy of the first row of the next one, whose ids (one for a range) are broadcast.
    """
    n = docs.count()
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    cut = Ranges(docs, id_col, RANGE_ROWS, n)
    tie = F.xxhash64("text")
    keyed = found.withColumn("part", cut.number(F.col("id"), tie))
    # texts are only read here where an id has several ranges
    least = F.min(F.struct(F.col("id").isNotNull().alias("some"), "id", (tie if cut.ties else F.lit(0).cast("long")).alias("tie"))).alias("f")
    firsts = keyed.groupBy("part").agg(least).select("part", "f.id", "f.tie").collect()
    firsts.sort(key=lambda r: r["part"])
    # the part before each first row's own, where a copy goes
    before = [(r["part"], firsts[i - 1]["part"], r["id"], r["tie"]) for i, r in enumerate(firsts)]
    kind = docs.schema[id_col].dataType.simpleString()
    copies = docs.sparkSession.createDataFrame(before, f"part int, to int, first {kind}, first_tie long")
    first = F.col("id").eqNullSafe(F.col("first")) & ((tie == F.col("first_tie")) if cut.ties else F.lit(True))
    ahead = keyed.join(F.broadcast(copies), "part").where(first).select(F.col("to").alias("part"), F.lit(True).alias("ahead"), "id", "text")
    own = keyed.select("part", F.lit(False).alias("ahead"), "id", "text")
    dealt = own.unionByName(ahead).repartitionById(cut.parts, "part")
    dealt = dealt.sortWithinPartitions("part", "ahead", F.col("id").asc_nulls_first(), tie, "text")
    chained = dealt.mapInArrow(
        _chain,
        f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, root string",
    )
    return chained.withColumnRenamed("id", id_col)


def op3_merkle(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def merkle_edited_texts(spark, sf_dir: str) -> DataFrame:
    """Of op3's columns those that SQL can make too."""
    return op3_merkle(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITED_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id) AS place, count(*) OVER () AS n FROM documents),
    e AS (SELECT a.doc_id, length(a.t) AS n_chars, left(a.t, length(a.t) - length(a.t) // 4) || left(b.t, length(a.t) // 4) AS edited FROM d a JOIN d b ON b.place = a.place % a.n + 1)
    SELECT doc_id, n_chars, sha256(edited) AS edited_sha256 FROM e"""
