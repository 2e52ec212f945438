"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its inverse.

`Merges` computes from the merge list how many bytes beyond a token's end can still change that
token. `Transducer` takes bytes in pieces of any size, emits a token once that many bytes behind it
are known, and so holds a bounded number of bytes whatever the length of the input; every id comes
from it. `Encoder` feeds it: it cuts a text by the vocabulary's own pre-tokenisation pattern, stretch
by stretch, and passes a pre-token on before its end is known if it is long. `ByteToText` turns ids
back into text, also piece by piece, with a UTF-8 state machine that carries at most three bytes over.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The published split pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: The same pattern for texts whose characters all lie in _PLAIN, where the standard library agrees with it.
_FAST = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile(rf"[^\t\n\r -~{_LATIN}¡-©«-±´¶-¸»¿×÷‐-‧€]")
_SLOW = regex.compile(PATTERN)
#: A cut before a space that follows a non-space never splits a pre-token.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: What a pre-token goes on with, by the kind of its last character.
_RUNS = [regex.compile(x) for x in (r"\p{L}++", r"\p{N}++", r"\s++", r"[^\s\p{L}\p{N}]++")]
_SPACES = _RUNS[2]
#: Characters that are pre-tokenised at a time; those behind the end of a pre-token that settle it; those from
#: which on an unfinished pre-token is passed on in parts; bytes of a window whose ids are remembered, and how
#: many windows (together some 50 MB at most).
WINDOW, SETTLED, PART, SMALL, REMEMBERED = 1 << 16, 3, 1 << 12, 32, 250_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Ranks after every merge.
_NEVER = (1 << 62, 0)


class Merges:
    """A byte-level vocabulary with its ordered merges."""

    def __init__(self, spec: str) -> None:
        parsed = json.loads(spec)
        model, letters = parsed["model"], byte_alphabet()
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        vocab = model["vocab"]
        self.byte_id = [0] * 256
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        #: (left id, right id) -> (rank, id of both together)
        self.rule: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rule.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special: dict[str, int] = {}
        for t in parsed.get("added_tokens") or []:
            if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized"):
                raise ValueError(f"unsupported added token {t['content']!r}")
            self.special[t["content"]] = t["id"]
            self.bytes_of[t["id"]] = t["content"].encode()
        self.lookahead = self._sufficient_lookahead()
        self.longest = max(map(len, self.bytes_of.values()))

    def _sufficient_lookahead(self) -> int:
        """Bytes behind a token's end that suffice to know that the token stands.

        What comes later changes a token only through a chain of merges, each of higher priority than
        the one that it pre-empts: a rule (x, z) takes x, which is on the right edge of the token
        before x's own merge is due, and z may be changed in the same way by a rule earlier still.
        One pass in rank order adds up the longest such chain; `reach[x]` is the longest that starts
        with a rule whose left side is x, `inner[t]` the longest on t's right edge.
        """
        reach: dict[int, int] = {}
        inner: dict[int, int] = {}
        for (x, z), (_, t) in sorted(self.rule.items(), key=lambda kv: kv[1][0]):
            chain = max(inner.get(z, 0), reach.get(z, 0))
            inner[t] = max(inner.get(t, 0), chain)
            reach[x] = max(reach.get(x, 0), len(self.bytes_of[z]) + chain)
        return max([1, *inner.values(), *reach.values()])

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of a whole byte string: always the pair of least rank first, leftmost among equals."""
        ids = [self.byte_id[b] for b in data]
        if len(ids) > 48:
            return self._encode_long(ids)
        rule = self.rule.get
        due = [rule(p, _NEVER) for p in zip(ids, ids[1:])]
        while due and (best := min(due)) is not _NEVER:
            i = due.index(best)
            ids[i : i + 2] = [best[1]]
            del due[i]
            if i < len(due):
                due[i] = rule((ids[i], ids[i + 1]), _NEVER)
            if i:
                due[i - 1] = rule((ids[i - 1], ids[i]), _NEVER)
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := self.rule.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, t = heapq.heappop(queue)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = t, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := self.rule.get((ids[left], ids[right]))):
                    heapq.heappush(queue, (r[0], left, ids[left], ids[right], r[1]))
        return [x for x in ids if x >= 0]


class Transducer:
    """Bytes of pre-tokens in, ids out (packed as little-endian unsigned 32-bit integers); holds at most
    `block` bytes plus the lookahead and one feed's bytes. Ids of small windows are remembered, a bounded number."""

    def __init__(self, merges: Merges, block: int = 1024) -> None:
        self.merges, self.held = merges, b""
        self.block = max(block, merges.longest)  # so that each stretch emits a token at least
        self.known: dict[bytes, bytes] = {}

    def feed(self, data: bytes, end: bool = False) -> bytes:
        """The ids that are certain now; with `end` the pre-token ends here and all are."""
        if self.held:
            data = self.held + data
        if len(data) > self.block + self.merges.lookahead:
            out = []
            while len(data) > self.block + self.merges.lookahead:
                ids, done = self._stable(data[: self.block + self.merges.lookahead])
                out.append(ids)
                data = data[done:]
            self.held = data
            return b"".join([*out, self.feed(b"", True)]) if end else b"".join(out)
        if not end:
            self.held = data
            return b""
        self.held = b""
        return self.known.get(data) or self._window(data)

    def _stable(self, window: bytes) -> tuple[bytes, int]:
        """The tokens that end at least the lookahead before the end of what is known, and their bytes. The
        tokens of the rest don't depend on them: no merge has crossed, or ever crosses, the boundary."""
        out, done, limit = [], 0, len(window) - self.merges.lookahead
        for t in self.merges.encode_piece(window):
            n = len(self.merges.bytes_of[t])
            if done + n > limit:
                break
            out.append(t)
            done += n
        return np.array(out, "<u4").tobytes(), done

    def _window(self, data: bytes) -> bytes:
        ids = np.array(self.merges.encode_piece(data), "<u4").tobytes()
        if len(data) <= SMALL:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[data] = ids
        return ids


#: Of each first byte of a UTF-8 sequence: its length, and the least and greatest second byte (the Unicode
#: standard's table of well-formed sequences).
_SEQUENCES = (
    {b: (2, 0x80, 0xBF) for b in range(0xC2, 0xE0)}
    | {b: (3, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF) for b in range(0xE0, 0xF0)}
    | {b: (4, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF) for b in range(0xF0, 0xF5)}
)


def unfinished(data: bytes) -> int:
    """How many last bytes are the beginning of a character that more bytes may complete: 0 to 3."""
    for k in range(1, min(3, len(data)) + 1):
        b = data[-k]
        if 0x80 <= b < 0xC0:
            continue
        n, low, high = _SEQUENCES.get(b, (0, 0, 0))
        return k if n > k and (k == 1 or low <= data[-k + 1] <= high) else 0
    return 0


class ByteToText:
    """Ids in, text out, piece by piece. Its state is the beginning of a character, three bytes at most; bytes
    that can't be part of one give U+FFFD, one for each longest beginning of a character."""

    def __init__(self, merges: Merges) -> None:
        self.bytes_of, self.held = merges.bytes_of, b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.held + b"".join(map(self.bytes_of.__getitem__, ids))
        cut = len(data) - unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        data, self.held = self.held, b""
        return data.decode("utf-8", "replace")


class Encoder:
    """Cuts texts into pre-tokens for a transducer. It holds one stretch of text: what is cut off whole is
    passed on with its end, a pre-token that outgrows PART without it."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.machine = merges, Transducer(merges)
        self.tail, self.run = "", None
        alternatives = sorted(map(re.escape, merges.special), key=len, reverse=True)
        self.special = re.compile("|".join(alternatives)) if alternatives else None

    def packed(self, text: str) -> Iterator[bytes]:
        """The ids of a text as little-endian unsigned 32-bit integers, in pieces."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self._plain(text, at, m.start())
            yield np.array([self.merges.special[m.group()]], "<u4").tobytes()
            at = m.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, start: int, end: int) -> Iterator[bytes]:
        for at in range(start, end - WINDOW, WINDOW):
            yield self.feed(text[at : at + WINDOW])
            start = at + WINDOW
        self.tail += text[start:end]
        yield self.finish()

    def feed(self, text: str) -> bytes:
        """The ids that are certain now."""
        self.tail += text
        out = []
        if self.run:
            out.append(self._go_on())
        if not self.run and len(self.tail) > PART:
            cut = None
            for cut in _CUT.finditer(self.tail, len(self.tail) - PART):
                pass
            if cut:
                out.append(self._whole(self._pieces(self.tail[: cut.start()])))
                self.tail = self.tail[cut.start() :]
            else:
                out.append(self._cut())
        return b"".join(out)

    def finish(self) -> bytes:
        """The ids that are left at the end of a text."""
        out = [self._go_on()] if self.run else []
        rest, self.tail = self.tail, ""
        if self.run:
            self.run = None
            return b"".join([*out, self.machine.feed(_bytes(rest), True)])
        return b"".join([*out, self._whole(self._pieces(rest))])

    def _pieces(self, text: str) -> list[str]:
        return (_SLOW if _NOT_PLAIN.search(text) else _FAST).findall(text)

    def _whole(self, pieces: list[str]) -> bytes:
        feed = self.machine.feed
        return b"".join([feed(p.encode("utf-8", "surrogatepass"), True) for p in pieces])

    def _cut(self) -> bytes:
        """Where no space shows the way: pre-tokens that the characters behind them settle are whole; one that
        goes on beyond them is kept, or passed on in parts if it is long."""
        pieces, ends = self._pieces(self.tail), len(self.tail)
        last = ends
        while pieces and last > ends - SETTLED:
            last -= len(pieces.pop())
        out, rest = [self._whole(pieces)], self.tail[last:]
        first = _SLOW.match(rest).group()
        if len(first) < len(rest) or len(rest) <= PART:
            self.tail = rest
            return out[0]
        self.run = next(r for r in _RUNS if r.match(rest[-1]))
        keep = len(rest) - (self.run is _SPACES)
        self.tail = rest[keep:]
        return b"".join([*out, self.machine.feed(_bytes(rest[:keep]))])

    def _go_on(self) -> bytes:
        """Passes on what the tail holds of an open pre-token. The last white space of a run belongs to what
        follows, so one is held back."""
        m = self.run.match(self.tail)
        end = m.end() if m else 0
        open_ = end == len(self.tail)
        if end and self.run is _SPACES:
            end -= 1
        part, self.tail = self.tail[:end], self.tail[end:]
        if not open_:
            self.run = None
        return self.machine.feed(_bytes(part), not open_)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


_encoders: dict[int, Encoder] = {}


def _round_trip(spec, id_col: str, text_col: str, keep: tuple[str, ...], schema: pa.Schema):
    """spec: a broadcast vocabulary of fixed size; a worker parses it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(spec.value)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(Merges(spec.value))
        encoder = _encoders[key]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [_one(encoder, t.as_py() or "", keep) for t in part.column(text_col)]
                columns = [part.column(id_col), *(list(c) for c in zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
                    schema=schema,
                )

    return run


def _one(encoder: Encoder, text: str, keep: tuple[str, ...]) -> list:
    ids_hash, text_hash, back, n = hashlib.sha256(), hashlib.sha256(), ByteToText(encoder.merges), 0
    all_ids, all_text = [], []
    for packed in encoder.packed(text):
        ids = np.frombuffer(packed, "<u4").tolist()
        piece = back.feed(ids)
        n += len(ids)
        ids_hash.update(packed)
        text_hash.update(piece.encode())
        if "ids" in keep:
            all_ids += ids
        if "decoded" in keep:
            all_text.append(piece)
    last = back.finish()
    text_hash.update(last.encode())
    extra = {"ids": all_ids, "decoded": "".join([*all_text, last])}
    return [n, ids_hash.hexdigest(), text_hash.hexdigest(), *(extra[k] for k in keep)]


def bpe_round_trip(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = ("ids", "decoded"),
) -> DataFrame:
    """Encode and decode every text: id_col, n_tokens, ids_sha256, decoded_sha256 and the columns named
    in `keep` (ids: array of int; decoded: string).

    vocabulary: the path, on the driver, of a byte-level BPE file; its text (some MB, of fixed size) is
    broadcast. One pass without a shuffle. Null and empty texts have no tokens and decode to the empty
    text; any id, repeated or null, passes through; other columns are not read; an empty table gives
    no rows. Working memory does not grow with a text beyond the text itself and what `keep` asks for.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    wide = {"ids": "array<int>", "decoded": "string"}
    found = docs.select(id_col, text_col)
    kind = found.schema[id_col].dataType.simpleString()
    sql = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(
        f", {k} {wide[k]}" for k in keep
    )
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    out = spark.createDataFrame([], sql).schema
    return found.mapInArrow(_round_trip(spec, id_col, text_col, keep, to_arrow_schema(out)), out)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe_round_trip(docs, default_vocabulary(), keep=())
