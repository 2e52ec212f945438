"""Line deduplication by a segment-partition edit join, in DataFrame operations only.

Equal lines are settled first, by digest. Distinct lines within an edit distance of `threshold` are then
found as in Pass-Join (Li et al., 2011): a line is cut into threshold + 1 segments, one of which any line
within the threshold holds unchanged. Segments are indexed under their number and the line's length; a
line probes the index with the few substrings whose places such a match leaves possible. Pairs that meet
are verified with a banded form of the bit-parallel edit distance (Myers, 1999; Hyyro, 2003), whose band
of 2 * threshold + 1 cells is a few bits of one integer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm.ranges import unused
from vicinal.plans.shared import materialize

#: Most edits between near-equal lines; code points from which a line is compared at all: three to a segment.
THRESHOLD, MIN_CHARS = 2, 9
#: Lines on either side of a key that one task compares; a key with more is compared by pairs of chunks.
CHUNK = 4096
#: 8-byte keys of segments or lines that met others that are broadcast at most (32 MB); beyond it they are shuffled.
BROADCAST_LINES = 2_000_000


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, line_no, line, h1, h2) of all lines that are not blank; h1 and h2 are 128 bits of digest."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = F.posexplode(F.split(text, "\n")).alias("line_no", "line")
    found = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), split).where(F.trim("line") != "")
    return found.select("id", "text_key", "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))


def distinct_lines(found: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, first: (id, text_key, line_no), line) of each distinct line; line is null if it is too short to compare."""
    text = F.when(F.char_length("line") >= min_chars, F.col("line"))
    first = F.min(F.struct("id", "text_key", "line_no", text.alias("line"))).alias("f")
    return found.groupBy("h1", "h2").agg(first).select("h1", "h2", F.struct("f.id", "f.text_key", "f.line_no").alias("first"), "f.line")


def _segment(i: int, parts: int, length: Column) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of a line of this length."""
    start = F.floor(length * i / parts).cast("int")
    return start + 1, F.floor(length * (i + 1) / parts).cast("int") - start


def index_keys(line: Column, threshold: int) -> list[Column]:
    n = F.char_length(line)
    out = []
    for i in range(threshold + 1):
        at, size = _segment(i, threshold + 1, n)
        out.append(F.xxhash64(F.lit(i), n, F.substring(line, at, size)))
    return out


def probe_keys(line: Column, threshold: int) -> list[Column]:
    """Keys of the substrings that may equal segment i of a line that is `less` code points shorter or as
    long. Left of the segment at most i edits, right of it at most threshold - i can have shifted it."""
    out = []
    for less in range(threshold + 1):
        n = F.char_length(line) - less
        for i in range(threshold + 1):
            at, size = _segment(i, threshold + 1, n)
            for shift in range(max(-i, less - (threshold - i)), min(i, less + (threshold - i)) + 1):
                out.append(F.xxhash64(F.lit(i), n, F.substring(line, at + shift, size)))
    return out


def meeting(distinct: DataFrame, threshold: int, broadcast_lines: int) -> tuple[DataFrame, DataFrame]:
    """(key, y) of probes and (key, x) of index entries that meet another line; semi-joins, so a key that
    many lines share gives a row for each line and never one for each pair."""
    compared = distinct.where(F.col("line").isNotNull())
    index = compared.select(F.col("h1").alias("x"), F.explode(F.array(*index_keys(F.col("line"), threshold))).alias("key"))
    probe = compared.select(F.col("h1").alias("y"), F.explode(F.array(*probe_keys(F.col("line"), threshold))).alias("key"))
    other = index.hint("shuffle_hash")
    probes = materialize(probe.join(other, (probe["key"] == other["key"]) & (probe["y"] != other["x"]), "left_semi").distinct(), "meeting-probes")
    keys = materialize(probes.select("key").distinct(), "meeting-keys")
    if keys.count() <= broadcast_lines:
        keys = F.broadcast(keys)
    return probes, materialize(index.join(keys, "key", "left_semi"), "meeting-entries")


def sketch(line: str) -> Column:
    """128 parities: each pair of neighbouring characters flips one of them. An edit changes four pairs at
    most, so lines within the threshold differ in no more than 4 * threshold bits."""
    return F.expr(f"""
      transform(array(split({line}, '')), c -> aggregate(sequence(0, size(c) - 2), named_struct('lo', 0L, 'hi', 0L),
        (s, i) -> transform(array(xxhash64(c[i], c[i + 1]) & 127L), h -> named_struct(
          'lo', IF(h < 64L, s.lo ^ shiftleft(1L, CAST(h AS INT)), s.lo),
          'hi', IF(h < 64L, s.hi, s.hi ^ shiftleft(1L, CAST(h - 64L AS INT)))))[0]))[0]""")


def candidates(probes: DataFrame, entries: DataFrame, texts: DataFrame, threshold: int, chunk: int) -> DataFrame:
    """Pairs of lines (y_..., x_...) that share a segment, each once, and whose sketches allow the threshold.

    The sketches are compared inside the join, which is how lines of a common template fall away. A pair that
    shares several keys is taken under the least. A key with over `chunk` probes or entries is cut: each
    chunk of probes meets each chunk of entries in a task of its own."""
    sizes = probes.groupBy("key").agg(F.count(F.lit(1)).alias("p")).join(entries.groupBy("key").agg(F.count(F.lit(1)).alias("e")), "key")
    large = sizes.where((F.col("p") > chunk) | (F.col("e") > chunk))
    large = materialize(large.select("key", *(F.ceil(F.col(c) / chunk).cast("int").alias(f"{c}_bins") for c in ("p", "e"))), "large-keys")

    def dealt(df: DataFrame, line: str, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(F.lit(7), line), F.coalesce(own, F.lit(1))).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return df.join(large, "key", "left").select("key", line, mine.alias(own[0]), others.alias(other[0]))

    def with_text(df: DataFrame, line: str) -> DataFrame:
        return df.join(texts.select(*[F.col(c).alias(f"{line}_{c}") for c in texts.columns]), F.col(line) == F.col(f"{line}_h1"))

    flips = F.bit_count(F.col("x_sketch.lo").bitwiseXOR(F.col("y_sketch.lo"))) + F.bit_count(F.col("x_sketch.hi").bitwiseXOR(F.col("y_sketch.hi")))
    less = F.char_length("y_line") - F.char_length("x_line")
    once = (less > 0) | (less == 0) & (F.col("x") < F.col("y"))
    first = F.col("key") == F.array_min(F.array_intersect("x_entries", "y_probes"))
    left, right = with_text(dealt(probes, "y", "p_bins", "e_bins"), "y"), with_text(dealt(entries, "x", "e_bins", "p_bins"), "x")
    return left.join(right, ["key", "p", "e"]).where((flips <= 4 * threshold) & once & (less <= threshold) & first)


def banded_distance(long: str, short: str, threshold: int) -> Column:
    """Edit distance of two string columns (long has 0 to threshold code points more), exact up to the
    threshold and larger than it otherwise.

    Bit k of a step at place j stands for the cell of long's place j + k - threshold. vp and vn tell where
    the distance rises or falls down the column, d where it stays along the diagonal; the last cell lies on
    one diagonal of the band throughout, along which `score` adds up what is not in d. The characters are
    bound to a lambda variable, so that no rewrite of the plan splits the strings again at every step.
    """
    width = 2 * threshold + 1
    mask = (1 << width) - 1
    cells = " | ".join(
        f"IF(get(p.l, j + {k - threshold}) <=> get(p.s, j), {1 << k}L, 0L)" for k in range(width)
    )
    start = mask & ~((1 << threshold) - 1)
    x, d, hp = "s.x", "s.d", "s.hp"
    step = f"""
      transform(transform(transform(array(named_struct('vp', s0.vp, 'vn', s0.vn, 'score', s0.score, 'x', {cells})),
        s -> named_struct('vp', s.vp, 'vn', s.vn, 'score', s.score, 'd', (((({x} & s.vp) + s.vp) ^ s.vp) | {x} | s.vn) & {mask}L)),
        s -> named_struct('vp', s.vp, 'd', {d}, 'hp', (s.vn | ~({d} | s.vp)) & {mask}L,
                          'score', s.score + 1 - CAST(shiftright({d}, size(p.l) - size(p.s) + {threshold}) & 1L AS INT))),
        s -> named_struct('vp', (({d} & s.vp) | ~(shiftright({d}, 1) | {hp})) & {mask}L,
                          'vn', shiftright({d}, 1) & {hp}, 'score', s.score))[0]"""
    return F.expr(f"""
      transform(array(named_struct('l', split({long}, ''), 's', split({short}, ''))), p -> aggregate(sequence(0, size(p.s) - 1),
        named_struct('vp', {start}L, 'vn', 0L, 'score', size(p.l) - size(p.s)),
        (s0, j) -> IF(s0.score > {threshold}, s0, {step}),
        s0 -> s0.score))[0]""")


def near_lines(distinct: DataFrame, threshold: int = THRESHOLD, broadcast_lines: int = BROADCAST_LINES, chunk: int = CHUNK) -> DataFrame:
    """(h1, h2, n_links, n_earlier) of distinct lines with links: lines within threshold edits, and those of
    them whose first occurrence is earlier. Pairs are verified where they meet and leave it as counts."""
    probes, entries = meeting(distinct, threshold, broadcast_lines)
    wanted = probes.select(F.col("y").alias("h1")).union(entries.select("x")).distinct()
    wanted = materialize(wanted, "meeting-lines")
    if wanted.count() <= broadcast_lines:
        wanted = F.broadcast(wanted)
    texts = distinct.where(F.col("line").isNotNull()).join(wanted, "h1", "left_semi")
    entry, probe = F.array(*index_keys(F.col("line"), threshold)), F.array(*probe_keys(F.col("line"), threshold))
    texts = materialize(texts.withColumns({"sketch": sketch("line"), "entries": entry, "probes": probe}), "meeting-texts")
    pairs = candidates(probes, entries, texts, threshold, chunk)
    side = lambda k, o: F.struct(F.col(f"{k}_h1").alias("h1"), F.col(f"{k}_h2").alias("h2"), (F.col(f"{o}_first") < F.col(f"{k}_first")).alias("earlier"))
    linked = F.when(banded_distance("y_line", "x_line", threshold) <= threshold, F.array(side("x", "y"), side("y", "x")))
    return pairs.select(F.explode(linked).alias("k")).groupBy("k.h1", "k.h2").agg(
        F.count(F.lit(1)).alias("n_links"), F.count_if("k.earlier").alias("n_earlier")
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per row of docs: id_col, text_key, copy, n_lines, n_exact, n_near, n_links, removed.

    Lines are what line feeds separate. A line is removed if an equal one stands earlier (by id, then line),
    or if one within `threshold` edits, whose first occurrence is earlier, is among all lines; both are
    judged on the input. Lines under min_chars code points are only compared for equality; blank lines
    stay and count in n_lines only. removed: the numbers of removed lines from 0, comma-joined. n_links:
    distinct other lines within the threshold, summed over the document's first occurrences.
    Null texts are empty, with one blank line. text_key is a hash of the text: rows that share an id are
    separate documents, in order of it. Rows that are equal in both are numbered by copy, from 0: the first
    is judged against all other documents, each line of a further one equals a line of the first. Null ids
    come before all others. An empty table gives no rows.
    """
    if min_chars < 3 * (threshold + 1):
        raise ValueError("lines must have three code points for each segment")
    found = lines(docs, id_col, text_col)
    distinct = materialize(distinct_lines(found, min_chars), "distinct-lines")
    near = materialize(near_lines(distinct, threshold), "near-lines")
    marks = distinct.drop("line").join(near, ["h1", "h2"], "left")
    placed = found.select("id", "text_key", "line_no", "h1", "h2").join(marks, ["h1", "h2"])
    is_first = F.struct("id", "text_key", "line_no").eqNullSafe(F.col("first"))
    exact, near = ~is_first, is_first & (F.coalesce("n_earlier", F.lit(0)) > 0)
    # of each place that matters: what it is, and its links; equal rows repeat places, so they form a set
    what = F.when(exact, F.lit("exact")).when(near, F.lit("near"))
    noted = F.when(exact | F.col("n_links").isNotNull(), F.struct("line_no", what.alias("what"), F.when(is_first, F.col("n_links")).alias("links")))
    per_doc = placed.groupBy("id", "text_key").agg(F.collect_set(noted).alias("noted"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = F.split(text, "\n")
    solid = F.filter(F.transform(split, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    counts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), F.size(split).alias("n"), F.array_join(solid, ",").alias("solid"))
    counts = counts.groupBy("id", "text_key").agg(F.max("n").cast("long").alias("n_lines"), F.max("solid").alias("solid"), F.count(F.lit(1)).alias("copies"))
    per_doc = per_doc.withColumnsRenamed({"id": "_id", "text_key": "_key"})
    joined = counts.join(per_doc, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    noted = F.coalesce("noted", F.array().cast(per_doc.schema["noted"].dataType))
    count = lambda kind: F.size(F.filter(noted, lambda x: x["what"] == kind)).cast("long")
    gone = F.transform(F.filter(noted, lambda x: x["what"].isNotNull()), lambda x: x["line_no"])
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    if_first = lambda a, b: F.when(F.col("copy") == 0, a).otherwise(b)
    none, solid_lines = F.lit(0).cast("long"), F.when(F.col("solid") == "", 0).otherwise(F.size(F.split("solid", ","))).cast("long")
    return joined.select(
        F.col("id").alias(id_col), "text_key", "copy", "n_lines", if_first(count("exact"), solid_lines).alias("n_exact"), if_first(count("near"), none).alias("n_near"),
        if_first(F.aggregate(noted, none, lambda s, x: s + F.coalesce(x["links"], F.lit(0))), none).alias("n_links"),
        if_first(F.array_join(F.array_sort(gone), ","), F.col("solid")).alias("removed"),
    )


def without_lines(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines taken out that line_dedup's result lists. Of rows equal in id and text one, which the
    order of partitions decides, is the first copy; docs is written once to number them."""
    key, mark, lost, place, second = (unused(docs, n) for n in ("_id", "_key", "_gone", "_place", "_second"))
    text_key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    docs = materialize(docs.withColumns({place: F.monotonically_increasing_id(), mark: text_key}), "numbered")
    firsts = docs.groupBy(id_col, mark).agg(F.min(place).alias(place)).select(place, F.lit(0).cast("long").alias(second))
    docs = docs.join(firsts, place, "left").withColumn(second, F.coalesce(second, F.lit(1)))
    gone = removed.where("removed <> '' and copy <= 1").select(
        F.col(id_col).alias(key), F.col("text_key").alias(f"{mark}_"), F.col("copy").alias(f"{second}_"), F.split("removed", ",").cast("array<int>").alias(lost)
    )
    none = F.array().cast("array<int>")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.coalesce(F.col(lost), none), i)), "\n")
    same = docs[id_col].eqNullSafe(F.col(key)) & (F.col(mark) == F.col(f"{mark}_")) & (F.col(second) == F.col(f"{second}_"))
    return docs.join(gone, same, "left").withColumn(text_col, kept).drop(key, mark, f"{mark}_", second, f"{second}_", lost, place)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
