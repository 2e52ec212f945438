"""Language identification by prediction by partial matching.

Each language has a context tree of byte contexts up to four bytes long with frozen counts. A byte
costs -log2 of its probability in the longest context that has seen it, plus an escape for every
longer context of that language that has not; below the empty context all 256 bytes are alike. The
language whose tree gives the text the shortest code wins. The trees are tabulated as costs by
n-gram, so whole texts are scored with a few vectorised look-ups a byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.llm.ranges import unused

ORDER = 4
#: The training sample: rows and bytes of text for a language at most, and bytes for all languages together, which
#: they share evenly; of one row an EIGHTH of its language's bytes at most. Every language is learned.
ROWS, TEXT_BYTES, ALL_BYTES, EIGHTH = 600, 1_500_000, 128 << 20, 8
#: Languages that share a table of costs, so that its size is in proportion to them.
GROUP = 8
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Before each text, so that its first bytes have contexts too.
PAD = b"\n" * ORDER
CHUNK = 1 << 20


def _has_letter(text: str) -> bool:
    """Whether a character of Unicode category L is in the text."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def _bytes(text: str) -> bytes:
    """UTF-8 with A-Z as a-z, so that capitals cost nothing."""
    return text.encode("utf-8", "surrogatepass").lower()


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """At i the k bytes that end at i as one number; only right from k - 1 on."""
    code = data.astype(np.int64)
    for j in range(1, k):
        code[j:] += data[:-j].astype(np.int64) << (8 * j)
    return code


class _Table:
    """Finds the row of an n-gram: open addressing, probed for all positions at once."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.row = np.full(1 << self.bits, -1, np.int32)
        rows, self.probes = np.arange(len(keys), dtype=np.int32), 0
        slots = self._slot(keys)
        while len(keys):
            free = self.key[slots] < 0
            first = np.zeros(len(keys), bool)
            first[np.unique(slots, return_index=True)[1]] = True
            put = free & first
            self.key[slots[put]], self.row[slots[put]] = keys[put], rows[put]
            keys, rows, slots = keys[~put], rows[~put], (slots[~put] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slot(keys)
        found = np.where((at := self.key[slots]) == keys, self.row[slots], np.int32(-1))
        todo = np.flatnonzero((at != keys) & (at >= 0))
        slots = slots[todo]
        for _ in range(self.probes):
            if not len(todo):
                break
            slots = (slots + 1) & ((1 << self.bits) - 1)
            at = self.key[slots]
            hit = at == keys[todo]
            found[todo[hit]] = self.row[slots[hit]]
            more = ~hit & (at >= 0)
            todo, slots = todo[more], slots[more]
        return found


class _Trees:
    """Context trees of a few languages, tabulated."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.languages = sorted(samples)
        n_lang = len(self.languages)
        coded = [[_bytes(t) for t in samples[x]] for x in self.languages]
        data = [np.frombuffer(b"".join(PAD + t for t in c), np.uint8) for c in coded]
        # padding gives contexts but is never predicted
        real = [np.concatenate([np.r_[np.zeros(ORDER, bool), np.ones(len(t), bool)] for t in c]) for c in coded]
        self.keys: list[np.ndarray] = [np.zeros(1, np.int64)]
        counts = [np.array([[r.sum() for r in real]], np.float64).reshape(1, n_lang)]
        for k in range(1, ORDER + 2):
            each = [np.unique(_grams(d, k)[r], return_counts=True) for d, r in zip(data, real, strict=True)]
            places = [np.unique(_grams(d, k)[k - 1 :]) for d in data]
            keys = np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)
            n = np.zeros((len(keys), n_lang))
            for j, (u, c) in enumerate(each):
                n[np.searchsorted(keys, u), j] = c
            self.keys.append(keys)
            counts.append(n)
        self.cost: list[np.ndarray] = [np.full((1, n_lang), 8.0)]
        self.escape: list[np.ndarray] = []
        for k in range(1, ORDER + 2):
            # what follows the context: occurrences and distinct bytes, by language
            context = np.searchsorted(self.keys[k - 1], self.keys[k] >> 8) if k > 1 else np.zeros(len(self.keys[k]), np.int64)
            known = context < len(self.keys[k - 1])
            known[known] = k == 1 or self.keys[k - 1][context[known]] == (self.keys[k] >> 8)[known]
            total, kinds = (np.zeros((len(self.keys[k - 1]), n_lang)) for _ in range(2))
            np.add.at(total, context[known], counts[k][known])
            np.add.at(kinds, context[known], (counts[k] > 0)[known])
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                at = np.where(known, context, 0)
                seen = -np.log2(counts[k] / (total + kinds)[at])
            shorter = np.searchsorted(self.keys[k - 1], self.keys[k] & ((1 << 8 * (k - 1)) - 1)) if k > 1 else context
            unseen = np.where(known[:, None], escape[at], 0.0) + self.cost[k - 1][shorter]
            self.escape.append(escape)
            self.cost.append(np.where((counts[k] > 0) & known[:, None], seen, unseen))
        self.cost = [c.astype(np.float32) for c in self.cost]
        self.escape = [e.astype(np.float32) for e in self.escape]
        self.table = [None, *(_Table(k) for k in self.keys[1:])]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language: one row for a text."""
        out = np.zeros((len(texts), len(self.languages)))
        data = np.frombuffer(b"".join(PAD + t for t in texts), np.uint8)
        if not len(data) or not self.languages:
            return out
        rows = {}
        for k in (ORDER + 1, ORDER):
            rows[k] = self.table[k].find(_grams(data, k))
        top = rows[ORDER + 1]
        cost = self.cost[ORDER + 1][np.maximum(top, 0)]
        left = np.flatnonzero(top < 0)
        rest = np.zeros((len(left), len(self.languages)), np.float32)
        open_, at = np.arange(len(left)), left
        for k in range(ORDER, -1, -1):
            if not len(at):
                break
            # the escape of the context of length k, then the cost in the next shorter one
            before = np.maximum(at - 1, 0)
            context = self._rows(rows, data, k, before)
            ok = (context >= 0) & (at > 0)
            rest[open_[ok]] += self.escape[k][context[ok]]
            row = self._rows(rows, data, k, at)
            hit = row >= 0
            rest[open_[hit]] += self.cost[k][row[hit]]
            open_, at = open_[~hit], at[~hit]
        cost[left] = rest
        lengths = np.array([len(t) for t in texts])
        starts = np.cumsum(lengths + ORDER) - lengths
        for i in range(0, len(texts)):
            if lengths[i]:
                out[i] = cost[starts[i] : starts[i] + lengths[i]].sum(axis=0, dtype=np.float64)
        return out

    def _rows(self, rows: dict, data: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
        """Rows of the k bytes that end at these places."""
        if k == 0:
            return np.zeros(len(at), np.int32)
        if k in rows:
            return rows[k][at]
        code = np.zeros(len(at), np.int64)
        for j in range(k):
            code += data[np.maximum(at - j, 0)].astype(np.int64) << (8 * j)
        return self.table[k].find(code)


class PpmModel:
    """Context trees of any number of languages."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.languages = sorted(samples)
        parts = [self.languages[i : i + GROUP] for i in range(0, len(self.languages), GROUP)]
        self.trees = [_Trees({x: samples[x] for x in part}) for part in parts]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language: one row for a text."""
        return np.hstack([t.code_lengths(texts) for t in self.trees])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, certainty (its posterior under equal priors) and bits a byte of each text."""
        pick = [UNDETERMINED] * len(texts)
        sure, rate = np.zeros(len(texts)), np.zeros(len(texts))
        if not self.languages:
            return pick, sure, rate
        todo = [i for i, t in enumerate(texts) if t and _has_letter(t)]
        while todo:
            some, size = [], 0
            while todo and size < CHUNK:
                some.append(todo.pop())
                size += len(texts[some[-1]])
            coded = [_bytes(texts[i]) for i in some]
            if size > CHUNK:
                bits = np.vstack([self._long(t) for t in coded])
            else:
                bits = self.code_lengths(coded)
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(some)), best]
            sure[some] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            rate[some] = least / [len(t) for t in coded]
            for i, b in zip(some, best, strict=True):
                pick[i] = self.languages[b]
        return pick, sure, rate

    def _long(self, text: bytes) -> np.ndarray:
        """A text in pieces of CHUNK; each piece starts with the contexts that end the one before."""
        total = np.zeros(len(self.languages))
        for at in range(0, len(text), CHUNK):
            piece = text[max(0, at - ORDER) : at + CHUNK]
            total += self.code_lengths([piece])[0]
            if at:
                total -= self.code_lengths([piece[:ORDER]])[0]
        return total


def training_sample(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = ROWS, text_bytes: int = TEXT_BYTES, all_bytes: int = ALL_BYTES
) -> dict[str, list[str]]:
    """Bounded sample of labelled rows: of each language the rows of least hash of their id, `rows` of them and
    `text_bytes` of text at most, and `all_bytes` over all languages. A very long row gives its beginning.
    Held-out rows are never among them."""
    labelled = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where(
        F.col("t").isNotNull() & F.col("l").isNotNull() & ~held_out(F.col("i")) & F.col("i").isNotNull()
    )
    counts = labelled.groupBy("l").count().collect()  # one row a language
    if not counts:
        return {}
    text_bytes = max(1, min(text_bytes, all_bytes // len(counts)))
    # a few more than wanted pass the threshold, so the exact ranking sees a bounded number of rows
    share = docs.sparkSession.createDataFrame([(r["l"], min(1.0, 1.5 * rows / r["count"]) * (1 << 40)) for r in counts], "l string, share double")
    order = F.pmod(F.xxhash64(F.lit("sample"), F.col("i")), F.lit(1 << 40))
    near = labelled.join(F.broadcast(share), "l").select("l", F.substring("t", 1, max(1, text_bytes // EIGHTH)).alias("t"), "i", order.alias("h")).where(order < F.col("share"))
    by = Window.partitionBy("l").orderBy("h", "i", "t")
    ranked = near.select(
        "l", "t", F.row_number().over(by).alias("n"), F.sum(F.octet_length("t")).over(by).alias("bytes")
    ).where((F.col("n") <= rows) & (F.col("bytes") <= text_bytes))
    out: dict[str, list[str]] = {}
    for r in ranked.orderBy("l", "n").collect():
        out.setdefault(r["l"], []).append(r["t"])
    return out


def held_out(id_column):
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))


def _scorer(broadcast_model, text_at: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast_model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                pick, sure, rate = model.predict(part.column(text_at).to_pylist())
                new = [pa.array(pick, pa.string()), pa.array(np.round(sure, 6)), pa.array(np.round(rate, 6))]
                columns = [c.cast(f.type) for c, f in zip([*part.columns, *new], schema, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def score(docs: DataFrame, samples: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """docs with three columns added at the end: language, certainty and bits a byte, under names like _lang,
    _score and _bits that docs does not use. One pass without a shuffle.

    The model, bounded by the sample's bounds, is built on the driver and broadcast.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = {"_lang": T.StringType(), "_score": T.DoubleType(), "_bits": T.DoubleType()}
    new = [T.StructField(unused(docs, n), k) for n, k in kinds.items()]
    schema = T.StructType([*docs.schema.fields, *new])
    model = docs.sparkSession.sparkContext.broadcast(PpmModel(samples))
    return docs.mapInArrow(_scorer(model, docs.columns.index(text_col), to_arrow_schema(schema)), schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id_col, held_out, lang_pred, score, bits_per_byte.

    A null text, or one without a letter, is `und` with score 0; so is every text where no row is
    labelled. Ties go to the language first by name. Repeated rows get equal results; null ids are
    never learned from and not held out. Prediction reads the whole text and nothing else.
    """
    samples = training_sample(docs, id_col, text_col, lang_col)
    scored = score(docs.select(F.col(id_col), F.col(text_col)), samples, text_col)
    return scored.select(
        id_col,
        held_out(F.col(id_col)).alias("held_out"),
        F.col("_lang").alias("lang_pred"),
        F.col("_score").alias("score"),
        F.col("_bits").alias("bits_per_byte"),
    )


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs in an identified language. Rejected: null texts, texts without a letter, and texts
    that their best language codes no shorter than raw bytes. A null language becomes the predicted one."""
    scored = score(docs, training_sample(docs, id_col, text_col, lang_col), text_col)
    lang, _, bits = scored.columns[-3:]
    kept = scored.where((F.col(lang) != UNDETERMINED) & (F.col(bits) < 8.0))
    return kept.select(*[F.coalesce(F.col(c), F.col(lang)).alias(c) if c == lang_col else F.col(c) for c in docs.columns])


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
