"""SimHash near-duplicates by bit-sliced comparison.

Equal fingerprints are one class from the start. Distinct fingerprints meet in tables keyed by some
of their bits. Within a key, 64 fingerprints form a block that is stored by bit plane: word k holds
bit k of all 64. One query is then compared with a block at a time: the planes in which it differs
are added up in carry-save counters, one bit of the count to a word, and a (query, block) is
abandoned once all its 64 counts exceed the radius. Each task returns a spanning forest of the links
it found, never all pairs of a group.

For a small radius the tables are exact: the bits are cut into more parts than the radius, and of any
two fingerprints within it enough parts are equal (Manku et al., 2007). For a similarity threshold the
tables take seeded samples of bits, as many tables as give the stated recall at the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.components import connected_components
from vicinal.llm.ranges import unused
from vicinal.plans.shared import materialize

#: Rows of a key that one task compares; a key with more is compared by pairs of chunks, in many tasks.
CHUNK = 4096
#: Shingles whose bits are counted at a time.
STEP = 1 << 15
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str, words: int) -> list[bytes]:
    """XXH64 (seed 42) of each shingle of a text, repeats included; see fingerprint()."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    joined, digest = b" ".join(parts), xxhash.xxh64_digest
    if len(parts) <= words:
        return [digest(joined, 42)]
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends[:-words]]).tolist()
    return [digest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]


def fingerprint(text: str | None, words: int, n: int = 1) -> np.ndarray:
    """n 64-bit words. Bit j of the first is 1 if it is 1 in over half the shingles' hashes; a shingle is
    `words` words (maximal runs without ASCII white space, A-Z as a-z) joined by spaces, or all of them if
    there are fewer; without words all bits are 0. Further words use further mixes of the same hash."""
    return majority(np.frombuffer(b"".join(shingle_hashes(text or "", words)), ">u8").astype(np.uint64), n)


def majority(hashes: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of shingles with these hashes."""
    counts = np.zeros((n, 64), np.int64)
    for at in range(0, len(hashes), STEP):
        h = hashes[at : at + STEP]
        for w in range(n):
            mixed = h if w == 0 else _mixed(h, w)
            counts[w] += np.unpackbits(mixed.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).reshape(n)


def _mixed(h: np.ndarray, w: int) -> np.ndarray:
    """Another 64 bits from a hash (the finaliser of splitmix64 on a shifted sequence)."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * w) & int(_ALL))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, n: int = 1) -> DataFrame:
    """(id, w0 .. w[n-1]) of every row, words as signed 64-bit integers; one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", *(f"w{i}" for i in range(n))]
        for batch in batches:
            rows = [fingerprint(t.as_py(), words, n) for t in batch.column(1)]
            found = np.array(rows, np.uint64).reshape(len(rows), n).view(np.int64)
            columns = [pa.array(np.ascontiguousarray(found[:, i])) for i in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"w{i} long" for i in range(n))
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, schema)


def bit_planes(blocks: np.ndarray) -> np.ndarray:
    """(blocks, 64, words) fingerprints -> (blocks, 64 * words) planes: bit m of plane k is bit k of member m."""
    n, _, words = blocks.shape
    bits = np.unpackbits(blocks.astype("<u8").view(np.uint8).reshape(n, 64, words * 8), axis=2, bitorder="little")
    turned = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(turned).view("<u8").reshape(n, 64 * words)


def _add(a, b, c):
    """Carry-save addition of three bits a lane: (sum, carry)."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def within(queries: np.ndarray, planes: np.ndarray, block: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """For each query (a row of words) and its block: a word whose bit m tells that member m is within radius.

    planes: of all blocks; block: the block of each query; valid: the members of each block.
    """
    rows, words = queries.shape
    out = np.zeros(rows, np.uint64)
    live, q, at = np.arange(rows), queries, block
    levels = max(1, radius.bit_length() - 3)  # counts of 8, 16, ... ; beyond them `over`
    zero = np.zeros(rows, np.uint64)
    low = [zero.copy() for _ in range(3)]
    high = [zero.copy() for _ in range(levels)]
    over = zero.copy()
    for k in range(0, 64 * words, 8):
        w, j = divmod(k, 64)
        mine = q[:, w]
        d = [planes[at, k + i] ^ (np.uint64(0) - ((mine >> np.uint64(j + i)) & np.uint64(1))) for i in range(8)]
        low[0], a = _add(low[0], d[0], d[1])
        low[0], b = _add(low[0], d[2], d[3])
        low[1], e = _add(low[1], a, b)
        low[0], a = _add(low[0], d[4], d[5])
        low[0], b = _add(low[0], d[6], d[7])
        low[1], f = _add(low[1], a, b)
        low[2], carry = _add(low[2], e, f)
        for i in range(levels):
            high[i], carry = high[i] ^ carry, high[i] & carry
        over |= carry
        more, same = over.copy(), ~over
        for i, c in reversed(list(enumerate([*low, *high]))):
            if radius >> i & 1:
                same &= c
            else:
                more |= same & c
                same &= ~c
        near = ~more & valid[at]
        if k + 8 == 64 * words:
            out[live] = near
        else:
            keep = near != 0
            if keep.mean() < 0.7:  # abandon
                live, q, at, over = live[keep], q[keep], at[keep], over[keep]
                low, high = [c[keep] for c in low], [c[keep] for c in high]
                if not len(live):
                    break
    return out


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = parent[up]


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the sets of a[i] and b[i], for all i; the least member is a set's root."""
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        if len(a):
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _links(words: np.ndarray, left: np.ndarray, right: np.ndarray, starts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within radius, a left and a right one of the same group, some at a time. starts: first
    rows of the groups, and the number of rows."""
    queries, of_query, members, size = [], [], [], 0
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if e - s < 2:
            continue
        rows = np.arange(s, e)
        a, b = rows[left[s:e]], rows[right[s:e]]
        same = np.array_equal(a, b)
        for at in range(0, len(b), 64):
            part = b[at : at + 64]
            mine = a[a <= part[-1]] if same else a
            queries.append(mine)
            of_query.append(np.full(len(mine), len(members)))
            members.append(np.pad(part, (0, 64 - len(part)), constant_values=-1))
            size += len(mine)
        if size > 1 << 15:
            yield from _near(words, queries, of_query, members, radius)
            queries, of_query, members, size = [], [], [], 0
    if queries:
        yield from _near(words, queries, of_query, members, radius)


def _near(words, queries, of_query, members, radius) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    q, at, m = np.concatenate(queries), np.concatenate(of_query), np.array(members)
    planes = bit_planes(words[np.maximum(m, 0)])
    valid = np.packbits(m >= 0, axis=1, bitorder="little").view("<u8").reshape(-1)
    for s in range(0, len(q), 1 << 15):
        near = within(words[q[s : s + (1 << 15)]], planes, at[s : s + (1 << 15)], valid, radius)
        some = np.flatnonzero(near)
        bits = np.unpackbits(near[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, j = np.nonzero(bits)
        a, b = q[s + some[i]], m[at[s + some[i]], j]
        yield a[a != b], b[a != b]


def forest(words: np.ndarray, left: np.ndarray, right: np.ndarray, starts: np.ndarray, radius: int) -> np.ndarray:
    """The root (a row number) of each row, after all links within radius."""
    parent = np.arange(len(words))
    for a, b in _links(words, left, right, starts, radius):
        _join(parent, a, b)
    return _find(parent, np.arange(len(words)))


def shortest_forest(words: np.ndarray, left: np.ndarray, right: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of a minimum spanning forest by distance: for any smaller radius, what its shorter links
    connect is what all shorter links connect."""
    held = [np.zeros((3, 0), np.int64)]
    for a, b in _links(words, left, right, starts, radius):
        for s in range(0, len(a), STEP):
            x, y = a[s : s + STEP], b[s : s + STEP]
            held.append(np.stack([x, y, np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64)]))
            if sum(h.shape[1] for h in held) > 1 << 18:
                held = [_shortest(len(words), np.concatenate(held, axis=1))]
    a, b, _ = _shortest(len(words), np.concatenate(held, axis=1))
    return a, b


def _shortest(rows: int, edges: np.ndarray) -> np.ndarray:
    """Kruskal's algorithm, all links of one length at a time."""
    parent, chosen = np.arange(rows), [np.zeros((3, 0), np.int64)]
    edges = edges[:, np.argsort(edges[2], kind="stable")]
    cut = np.flatnonzero(np.r_[True, np.diff(edges[2]) != 0, True]) if edges.shape[1] else []
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        level = edges[:, s:e]
        while level.shape[1]:
            a, b = _find(parent, level[0]), _find(parent, level[1])
            apart = a != b
            level, a, b = level[:, apart], a[apart], b[apart]
            high, first = np.unique(np.maximum(a, b), return_index=True)
            parent[high] = np.minimum(a, b)[first]
            chosen.append(level[:, first])
    return np.concatenate(chosen, axis=1)


def _compare(n: int, radius: int, shortest: bool):
    names = [f"w{i}" for i in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key = held.column("task").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
            if cut < 1 << 15:
                continue
            yield from _forest_rows(held.slice(0, cut))
            held = held.slice(cut)
        if held is not None:
            yield from _forest_rows(held)

    def _forest_rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = table.column("task").to_numpy()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        words = np.stack([table.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
        sides = [table.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")]
        node = table.column("node").to_numpy()
        if shortest:
            a, b = shortest_forest(words, *sides, starts, radius)
        else:
            root = forest(words, *sides, starts, radius)
            a = np.flatnonzero(root != np.arange(len(root)))
            b = root[a]
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return run


def exact_tables(bits: int, radius: int, rows: int) -> list[list[int]]:
    """Sets of bits such that any two fingerprints within radius agree on all bits of at least one set.

    Of `parts` parts at most radius differ, so some parts - radius of them agree. More parts mean longer
    keys and more tables; the fewest are taken that leave about 64 of the rows to a key.
    """
    for parts in range(radius + 1, radius + 6):
        same = parts - radius
        if rows <= 64 << (bits * same // parts) or parts == radius + 5:
            edges = [bits * i // parts for i in range(parts + 1)]
            return [[k for p in c for k in range(edges[p], edges[p + 1])] for c in combinations(range(parts), same)]
    raise AssertionError


def sampled_tables(bits: int, agree: float, rows: int, recall: float) -> list[list[int]]:
    """Seeded sets of bits; fingerprints that agree on each bit with probability `agree` share a key of at
    least one set with probability `recall`. Keys grow with log2(rows), tables with a small power of rows."""
    width = max(8, math.ceil(math.log2(max(2, rows) / 128)))
    count = math.ceil(math.log(1 - recall) / math.log(1 - agree**width))
    draw, pool, out = np.random.default_rng(64), [], []
    for _ in range(count):
        if len(pool) < width:
            pool = draw.permutation(bits).tolist()
        out.append([pool.pop() for _ in range(width)])
    return out


def links(classes: DataFrame, n: int, radius: int, tables: list[list[int]], chunk: int = CHUNK, shortest: bool = False) -> DataFrame:
    """classes(node, w0 ..) of distinct fingerprints -> links (a, b) that connect all that are within radius
    and share the bits of a table; with `shortest`, by links as short as possible."""
    names = [f"w{i}" for i in range(n)]
    masks = []
    for bits in tables:
        m = [0] * n
        for k in bits:
            m[k // 64] |= 1 << (k % 64)
        masks.append([x - (1 << 64) if x >> 63 else x for x in m])
    keys = [F.xxhash64(F.lit(t), *[F.col(c).bitwiseAND(F.lit(x)) for c, x in zip(names, m, strict=True) if x]) for t, m in enumerate(masks)]
    keyed = classes.select("node", *names, F.explode(F.array(*keys)).alias("key"))
    large = (
        classes.select(F.explode(F.array(*keys)).alias("key")).groupBy("key").count()
        .where(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    )
    large = materialize(large, "large-keys")
    mine = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("chunks")).cast("int")
    # each row meets every chunk of its key: as left side of the later ones, as right side of the earlier
    split = (
        keyed.join(large, "key")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"), "node", *names,
            (F.col("mine") <= F.col("other")).alias("a"), (F.col("mine") >= F.col("other")).alias("b"),
        )
    )
    whole = keyed.join(large.select("key"), "key", "left_anti").select(
        F.col("key").alias("task"), "node", *names, F.lit(True).alias("a"), F.lit(True).alias("b")
    )
    dealt = whole.unionByName(split).repartition("task").sortWithinPartitions("task", "node")
    return dealt.mapInArrow(_compare(n, radius, shortest), "a long, b long")


def near_classes(prints: DataFrame, n: int, radius: int, tables_for) -> DataFrame:
    """prints(id, w0 ..) -> (id, w0 .., component): the smallest id that links reach, itself included."""
    names = [f"w{i}" for i in range(n)]
    node = F.col("w0") if n == 1 else F.xxhash64(*names)
    classes = prints.groupBy(*names).agg(F.min("id").alias("least")).withColumn("node", node)
    classes = materialize(classes, "classes")
    found = links(classes, n, radius, tables_for(classes.count()))
    found = materialize(connected_components(found), "components")
    rooted = classes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(rooted.join(least, "root").select(*names, "component"), names)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id.

    Every link of `radius` or fewer differing bits counts, without exception. Null texts are empty; texts
    without words have fingerprint zero and link like others. Rows with one id are separate rows; null ids
    never name a component unless it has no other. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    found = near_classes(prints, 1, radius, lambda rows: exact_tables(64, radius, rows))
    return found.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


#: Of the pipeline's stage: words of a shingle, similarity of shingle sets, fingerprint words, recall of the
#: tables at that similarity, and ids of linked texts that are broadcast at most (32 MB).
STAGE_WORDS, STAGE_SIMILARITY, STAGE_N, STAGE_RECALL, BROADCAST_IDS = 5, 0.8, 8, 0.999, 2_000_000
#: Standard deviations beyond the mean distance at that similarity up to which links are proposed; pairs of
#: sets of which one has at most SHORT shingles are found without fingerprints.
STAGE_SIGMAS, SHORT = 4, 64
#: Rows of a key that one task of the stage compares; a key with more is compared by pairs of chunks.
STAGE_CHUNK = 512
#: Members of the shingle sets that one task compares pair by pair on either side (some 8 bytes each, and as
#: much again for each of a few arrays), about; a group with more goes by pairs of bins.
SET_CHUNK = 1 << 18


def agreement(similarity: float) -> float:
    """Probability that a bit of two SimHashes agrees, for sets of one size with this Jaccard similarity."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def shingle_set(text: str | None) -> np.ndarray:
    """The hashes of a text's distinct shingles of the stage, ascending."""
    return np.unique(np.frombuffer(b"".join(shingle_hashes(text or "", STAGE_WORDS)), ">u8").astype(np.uint64))


def set_digest(members: np.ndarray) -> int:
    """64 bits (signed) that stand for a shingle set."""
    return xxhash.xxh3_64_intdigest(members.astype("<u8").tobytes()) - (1 << 63)


def first_members(members: np.ndarray, similarity: float) -> np.ndarray:
    """Of a set of at most SHORT / similarity members the least, so many that sets of the similarity have one
    of them in common; of a larger set none."""
    n = len(members)
    return members[: n - math.ceil(similarity * n - 1e-9) + 1 if 0 < n <= SHORT / similarity else 0]


def set_prints(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(id, node, w0 .., first) of every row: the digest of its shingle set, the fingerprint of the set
    (repeats don't count) and first_members()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "node", *(f"w{i}" for i in range(STAGE_N)), "first"]
        for batch in batches:
            nodes, rows, first = [], [], []
            for text in batch.column(1):
                members = shingle_set(text.as_py())
                nodes.append(set_digest(members))
                rows.append(majority(members, STAGE_N))
                first.append(first_members(members, similarity).view(np.int64))
            found = np.array(rows, np.uint64).reshape(len(rows), STAGE_N).view(np.int64)
            columns = [pa.array(np.ascontiguousarray(found[:, i])) for i in range(STAGE_N)]
            columns = [pa.array(nodes, pa.int64()), *columns, pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, node long, " + ", ".join(f"w{i} long" for i in range(STAGE_N)) + ", first array<long>"
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, schema)


def like(common, p, q, similarity: float):
    """Whether sets of p and q members with so many in common have the similarity."""
    return (common > 0) & (common >= similarity * (p + q - common) - 1e-9)


def exact_forest(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, comp: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect, together with equal comp, all left and right rows whose sets have the
    similarity: every pair of different comp is counted, over the rows that hold each member."""
    rows, sizes = len(sets), np.array([len(x) for x in sets])
    member = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.r_[0, np.cumsum(sizes)]
    order = np.argsort(member, kind="stable")
    holders = np.repeat(np.arange(rows), sizes)[order]
    order = order[left[holders]]
    holders = holders[left[holders]]
    starts = np.searchsorted(member[order], np.arange(member.max(initial=-1) + 2))
    _, first, of = np.unique(comp, return_index=True, return_inverse=True)
    own = first[of]
    parent = own.copy()
    for j in np.flatnonzero(right).tolist():
        mine = member[ends[j] : ends[j + 1]]
        length = starts[mine + 1] - starts[mine]
        at = np.arange(length.sum()) + np.repeat(starts[mine] - np.cumsum(length) + length, length)
        common = np.bincount(holders[at], minlength=rows)
        found = np.flatnonzero(like(common, sizes, sizes[j], similarity) & (own != own[j]))
        _join(parent, np.full(len(found), j), found)
    a = np.unique(own)
    root = _find(parent, a)
    return a[a != root], root[a != root]


def dealt(groups: DataFrame, known: DataFrame, chunk: int) -> DataFrame:
    """groups(group, node, size), known(node, comp) -> (task, node, comp, a, b): any two nodes of a group that
    are of different comp meet in a task, one as a left side (a), one as a right side (b).

    A comp whose sizes add up to over `chunk` is cut into bins of its own, which need not meet each other;
    the other comps share bins, each as a whole. A task is a pair of bins. Groups of one comp need no task."""
    rows = groups.join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    few = F.col("n") <= chunk
    totals = (
        rows.groupBy("group", "comp").agg(F.sum("size").alias("n")).groupBy("group")
        .agg(
            F.count(F.lit(1)).alias("comps"),
            F.ceil(F.coalesce(F.sum(F.when(few, F.col("n"))), F.lit(0)) / chunk).alias("shared"),
            F.sort_array(F.collect_list(F.when(~few, F.struct("comp", F.ceil(F.col("n") / chunk).alias("k"))))).alias("large"),
        )
        .where("comps > 1")
        .withColumn("bins", F.expr("shared + aggregate(large, 0L, (s, x) -> s + x.k)"))
    )
    totals = materialize(totals, "groups")
    return (
        rows.join(totals, "group")
        .withColumn("place", F.expr("cast(array_position(transform(large, x -> x.comp), comp) as int)"))
        .withColumn("low", F.expr("if(place > 0, shared + aggregate(slice(large, 1, greatest(place, 1) - 1), 0L, (s, x) -> s + x.k), 0L)"))
        .withColumn("k", F.expr("coalesce(get(large, place - 1).k, shared)"))
        .withColumn("bin", F.expr("low + pmod(xxhash64(if(place > 0, node, comp)), k)"))
        .withColumn("other", F.explode(F.expr("filter(sequence(0L, bins - 1), x -> place = 0 or x < low or x >= low + k)")))
        .select(
            F.xxhash64("group", F.least("bin", "other"), F.greatest("bin", "other")).alias("task"), "node", "comp",
            (F.col("bin") <= F.col("other")).alias("a"), (F.col("bin") >= F.col("other")).alias("b"),
        )
    )


def exact_links(groups: DataFrame, known: DataFrame, sets: DataFrame, similarity: float, chunk: int = SET_CHUNK) -> DataFrame:
    """Links (a, b) that connect, together with known(node, comp), all nodes of a common group(group, node)
    whose sets(node, set) have the similarity."""
    groups = groups.join(sets.select("node", (F.octet_length("set") / 8 + 1).cast("long").alias("size")), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                key = batch.column("task").to_numpy()
                if held and held[0].column("task")[0].as_py() != key[0]:
                    yield compared(held)
                    held = []
                cut = int(np.searchsorted(key, key[0], "right"))
                held.append(batch.slice(0, cut))
                batch = batch.slice(cut)
        if held:
            yield compared(held)

    def compared(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        sides = [table.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")]
        node = table.column("node").to_numpy()
        found = [np.frombuffer(x.as_py(), "<u8") for x in table.column("set")]
        a, b = exact_forest(found, *sides, table.column("comp").to_numpy(), similarity)
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    rows = dealt(groups, known, chunk).join(sets, "node").select("task", "node", "comp", "a", "b", "set")
    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, id_col: str, text_col: str, similarity: float):
    """A check of proposed links: returns links that connect all rows that proposals connect, or that are
    short and share a first member, and whose sets of five-word shingles are connected by pairs of this
    Jaccard similarity, counted exactly.

    The proposals themselves are checked first. What they connect and the links that stand do not is then
    compared pair by pair, so a proposal that fails loses no link between others."""

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = (np.frombuffer(s.as_py(), "<u8") for s in (x, y))
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(bool(like(common, len(p), len(q), similarity)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def check(prints: DataFrame, found: DataFrame, first: DataFrame) -> DataFrame:
        pairs = materialize(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-links")
        shared = first.groupBy("group").count().where("count > 1").select("group")
        groups = connected_components(pairs).select(F.col("root").alias("group"), "node").unionByName(first.join(shared, "group", "left_semi"))
        groups = materialize(groups, "proposed")
        sets = materialize(sets_of(docs, id_col, text_col, prints.join(groups.select("node").distinct(), "node", "left_semi")), "linked-sets")
        side = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"s{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
        stand = materialize(both.mapInArrow(holds, "a long, b long"), "standing")
        known = materialize(connected_components(stand).select("node", F.col("root").alias("comp")), "known")
        return stand.unionByName(materialize(exact_links(groups, known, sets, similarity), "exact-links"))

    return check


def sets_of(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(node, set) of each node of wanted(id, node): the hashes of the shingle set, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py()) for t in batch.column("t")]
            columns = [pa.array([set_digest(x) for x in found], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "set"])

    # an id may have several texts, and a text no id: sets go by their digests
    least = materialize(wanted.groupBy("node").agg(F.min("id").alias("i")), "linked-ids")
    nodes, ids = least.select("node"), least.where("i is not null").select("i").distinct()
    few = least.count() <= BROADCAST_IDS
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    texts = texts.join(F.broadcast(ids) if few else ids, "i", "left_semi").unionByName(texts.where("i is null")).select("t")
    found = texts.mapInArrow(run, "node long, set binary")
    return found.join(F.broadcast(nodes) if few else nodes, "node", "left_semi").dropDuplicates(["node"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """The rows of docs without those whose component of near duplicates has a smaller id.

    512-bit fingerprints over the sets of five-word shingles propose links: those of a minimum spanning
    forest of all pairs that differ in no more bits than sets of this similarity do on average, plus four
    standard deviations. Pairs with a set of at most SHORT shingles are all found, by members that they must
    share (prefix filter, Chaudhuri et al., 2006). A link stands if the shingle sets themselves have the similarity; where one fails, all pairs
    that proposals connect and links that stand do not are counted. Texts with one shingle
    set are copies, whatever their fingerprints. Rows with null ids stay; rows repeated with a component's least id all stay.
    """
    bits = 64 * STAGE_N
    p = agreement(similarity)
    radius = round(bits * (1 - p) + STAGE_SIGMAS * math.sqrt(bits * p * (1 - p)))
    prints = materialize(set_prints(docs, id_col, text_col, similarity), "fingerprints")
    classes = materialize(prints.drop("id").dropDuplicates(["node"]), "classes")
    found = links(classes, STAGE_N, radius, sampled_tables(bits, p, classes.count(), STAGE_RECALL), STAGE_CHUNK, shortest=True)
    first = classes.select(F.explode("first").alias("group"), "node")
    found = similar(docs, id_col, text_col, similarity)(prints.select("id", "node"), found, first)
    found = materialize(connected_components(found), "components")
    rooted = prints.select("id", "node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component"))
    gone = F.col("id").isNotNull() & (F.col("id") != F.col("component"))
    dropped = rooted.join(least, "root").where(gone).select(F.col("id").alias(unused(docs, "_id"))).distinct()
    return docs.join(dropped, docs[id_col] == F.col(dropped.columns[0]), "left_anti")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
