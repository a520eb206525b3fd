"""Near-duplicate vectors by p-stable hashing for Euclidean distance, with exact cosine checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.components import components
from quillmere.llm.shared import ready, stash

#: Tables, projections in each, and the width of a step. For unit vectors at cosine 0.93 (distance 0.374) a projection
#: agrees with probability 0.851, so a table finds a pair with 0.104 and 36 tables find it with 0.98; at cosine 0.97 with
#: 0.9999. Unrelated unit vectors (distance about 1.4) agree in a table with about 4e-5.
TABLES, PROJECTIONS, WIDTH = 36, 14, 2.0
#: Rows of a bucket that are compared as one block; a larger bucket is split into pairs of blocks.
BLOCK = 1500
#: Share of a vector's turned coordinates in its sketch, groups that are compared in one product, and products at a time.
SKETCH, SMALL, ENTRIES = 3 / 8, 64, 4_000_000


def _normalised(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision and which rows have one, from a list array of `dim` components a row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), dim)
    top = np.abs(x).max(axis=1) if dim else np.zeros(len(x))
    good = np.isfinite(top) & (top > 0)
    x = np.where(good[:, None], x, 0.0) / np.where(good, top, 1.0)[:, None]
    return x / np.sqrt(np.where(good, np.einsum("ij,ij->i", x, x), 1.0))[:, None], good


def _whole_groups(batches, keys: int, most: int = 0):
    """Tables of whole groups, and whether they are the pieces of a group of more than `most` rows, from sorted batches.

    A group is a run of equal values in the first `keys` columns, whole numbers. With `most` a larger one is not gathered.
    """
    held, large = None, None

    def first(table, i):
        return tuple(table.column(k)[i].as_py() for k in range(keys))

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        if held is not None:
            table = pa.concat_tables([held, table])
        held = None
        columns = np.stack([table.column(k).to_numpy() for k in range(keys)])
        starts = np.flatnonzero(np.r_[True, (columns[:, 1:] != columns[:, :-1]).any(axis=0)])
        begin = 0
        if large is not None and first(table, 0) == large:
            begin = int(starts[1]) if len(starts) > 1 else len(table)
            yield table.slice(0, begin), True
        large = None if begin < len(table) else large
        last = int(starts[-1])
        if begin < last:
            yield table.slice(begin, last - begin), False
        if begin <= last:
            held = table.slice(last)
            if most and len(held) > most:
                large = first(held, 0)
                yield held, True
                held = None
    if held is not None:
        yield held, False


def _sizes(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal rows."""
    change = np.zeros(len(columns[0]), dtype=bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(change)
    return starts, np.diff(np.r_[starts, len(change)])


def _stacks(starts: np.ndarray, sizes: np.ndarray, most: int):
    """Groups of 2 to `most` rows as stacks of row numbers, equal sizes together."""
    for size in np.unique(sizes[(sizes > 1) & (sizes <= most)]).tolist():
        own = starts[sizes == size]
        step = max(1, ENTRIES // (size * size))
        for i in range(0, len(own), step):
            yield own[i : i + step, None] + np.arange(size)


def _sketches(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The first coordinates of the turned unit vectors as signed bytes, each within 1/254."""
    return np.rint(x @ turn * 127).astype("i1")


def _promising(sketch: np.ndarray, starts: np.ndarray, sizes: np.ndarray, threshold: float, most: int) -> np.ndarray:
    """Which rows may reach the threshold with another of their group; a row that does is never left out.

    With x = a + b, a the sketched part within e of its sketch s, x.y <= s.s' + e (|s| + |s'|) + e^2 + |b| |b'|, and |b|^2
    is at most 1 - (|s| - e)^2.
    """
    s = sketch.astype("f4") / np.float32(127)
    e = np.float32(np.sqrt(s.shape[1]) / 254)
    norm = np.sqrt(np.einsum("ij,ij->i", s, s))[:, None]
    rest = np.sqrt(np.maximum(0, 1 - np.maximum(0, norm - e) ** 2))
    one = np.ones_like(norm)
    left, right = np.hstack([s, e * norm, one, rest]), np.hstack([s, one, e * norm, rest])
    least = np.float32(threshold - 1e-4) - e * e
    keep = np.zeros(len(s), dtype=bool)
    for rows in _stacks(starts, sizes, most):
        near = left[rows] @ right[rows].swapaxes(1, 2) >= least
        near[:, np.arange(rows.shape[1]), np.arange(rows.shape[1])] = False
        keep[rows] = near.any(axis=2)
    return keep


def _settle(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Roots, each the smallest place of its component, after the links p to q."""
    while len(p):
        a, b = root[p], root[q]
        open_ = a != b
        p, q, a, b = p[open_], q[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while not np.array_equal(root, up := root[root]):
            root = up
    return root


def _mix(values: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of rows of whole numbers."""
    out = np.full(values.shape[:-1], np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    for j in range(values.shape[-1]):
        out ^= values[..., j].astype("i8").view("u8") + np.uint64(0x9E3779B97F4A7C15) + (out << np.uint64(6)) + (out >> np.uint64(2))
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(33)
    return out.view("i8")


def link_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = 0.93, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = 17) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row: links are pairs of equal, non-null label with cosine >= threshold.

    Equal vectors of a label are one representative with a multiplicity, so a hot vector costs one row. Representatives
    meet in buckets of each table, first with a sketch of some bytes, from which a bound on the cosine follows; only those
    that may have a link in their bucket have their vector shuffled. A pair that meets in several tables
    is counted in the first. Buckets give counts and a spanning forest of their links, never all pairs; a bucket larger
    than BLOCK is compared block against block in separate tasks. A null, empty, zero or non-finite vector is
    linked with nothing; a null label or vec_id likewise. Vectors of different lengths never link. Rows that repeat a
    vec_id and vector are links of each other. An empty table gives none; other columns are not read. Links may be missed
    (see TABLES) but none is below the threshold.
    """
    ready(spark)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    v = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.col("label").cast("string").alias("label"))
    usable = rows.where("label IS NOT NULL AND vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(v, x -> x <> 0)").withColumn("h", F.xxhash64("label", "v"))
    distinct = usable.groupBy("h", "label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    block = BLOCK

    def hashes(batches):
        plans: dict = {}
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("v"))
            sizes = np.diff(column.offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                if dim not in plans:
                    rng = np.random.default_rng([seed, dim])
                    directions, shifts = rng.standard_normal((dim, tables * projections)), rng.random(tables * projections) * width
                    plans[dim] = directions, shifts, np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : int(np.ceil(dim * SKETCH))]
                directions, shifts, turn = plans[dim]
                for at in range(0, len(own), 2000):
                    part = batch.take(pa.array(own[at : at + 2000]))
                    x, good = _normalised(part.column(batch.schema.get_field_index("v")), dim)
                    steps = np.floor((x @ directions + shifts) / width).astype("i4").reshape(len(x), tables, projections)
                    keys = np.stack([_mix(steps[:, t], t + 1) for t in range(tables)], axis=1)
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype="i4")), pa.array(keys.ravel()))
                    sketch = _sketches(x, turn)
                    packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, sketch.size + 1, sketch.shape[1], dtype="i4")), pa.py_buffer(sketch.tobytes())])
                    yield pa.RecordBatch.from_arrays([*part.columns, listed, packed], names=[*part.schema.names, "keys", "sketch"])

    kind = "array<float>" if single else "array<double>"
    reps = stash(spark, distinct.select("h", "label", "v", "rep", "mult").mapInArrow(hashes, f"h long, label string, v {kind}, rep long, mult long, keys array<long>, sketch binary"), "vec-reps")
    placed = reps.select("rep", F.xxhash64("label", F.size("v")).alias("lab"), "sketch", F.posexplode("keys").alias("t", "k")).select(F.xxhash64("lab", "t", "k").alias("bucket"), "rep", "t", "sketch")

    def promising(batches):
        for table, large in _whole_groups(batches, 1, block):
            hot = np.full(len(table), large)
            keep = hot
            if not large:
                starts, sizes = _sizes([table.column(0).to_numpy()])
                packed = table.column(3).combine_chunks()
                offsets = np.frombuffer(packed.buffers()[1], dtype="i4")[packed.offset : packed.offset + len(packed) + 1]
                data, lengths = np.frombuffer(packed.buffers()[2], dtype="i1"), np.diff(offsets)
                lowest, highest = np.minimum.reduceat(lengths, starts), np.maximum.reduceat(lengths, starts)
                hot = np.repeat(sizes > block, sizes)
                keep = hot | np.repeat(lowest != highest, sizes)
                for length in np.unique(lowest[(lowest == highest) & (sizes > 1)]).tolist():
                    groups = (lowest == length) & (highest == length) & (sizes > 1)
                    own = np.flatnonzero(np.repeat(groups, sizes))
                    sketch = data[offsets[own][:, None] + np.arange(length)]
                    keep[own] |= _promising(sketch, np.r_[0, np.cumsum(sizes[groups])[:-1]], sizes[groups], threshold, block)
            if keep.any():
                out = table.select([0, 1, 2]).filter(pa.array(keep)).append_column("large", pa.array(hot[keep]))
                yield from out.to_batches()

    near = stash(spark, placed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(promising, "bucket long, rep long, t int, large boolean"), "vec-near")
    parts = near.where("large").groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    split = near.where("large").join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64(F.lit(3), "rep"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = near.where("NOT large").select("bucket", F.lit(0).alias("low"), F.lit(0).alias("high"), "rep", "t", F.lit(0).alias("part")).union(
        split.select("bucket", F.least("part", "other"), F.greatest("part", "other"), "rep", "t", "part")
    )
    full = spread.join(reps.select("rep", "label", "v", "mult", "keys"), "rep").select("bucket", "low", "high", "rep", "t", "part", "mult", "label", "v", "keys")

    def compare(batches):
        for table, _ in _whole_groups(batches, 3):
            v = table.column("v").combine_chunks()
            dims = np.diff(v.offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                own = table if (dims == dim).all() else table.filter(pa.array(dims == dim))
                ids, t, part, mult, low, high = (own.column(c).to_numpy() for c in ("rep", "t", "part", "mult", "low", "high"))
                starts, sizes = _sizes([own.column("bucket").to_numpy(), low, high])
                labels = own.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
                keys = own.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), tables)
                x, _ = _normalised(own.column("v"), dim)
                counts, root = np.zeros(len(ids), dtype="i8"), np.arange(len(ids))
                ps, qs = [np.zeros(0, dtype="i8")], [np.zeros(0, dtype="i8")]
                for rows in _stacks(starts, sizes, SMALL):
                    i, j = np.triu_indices(rows.shape[1], 1)
                    g, e = np.nonzero((x[rows] @ x[rows].swapaxes(1, 2))[:, i, j] >= threshold)
                    p, q = rows[g, i[e]], rows[g, j[e]]
                    meet = (keys[p] == keys[q]).argmax(axis=1)
                    good = (labels[p] == labels[q]) & ((low[p] == high[p]) | (part[p] != part[q])) & (meet >= t[p])
                    ps.append(p[good])
                    qs.append(q[good])
                p, q = np.concatenate(ps), np.concatenate(qs)
                np.add.at(counts, p, mult[q])
                np.add.at(counts, q, mult[p])
                root = _settle(root, p, q)
                for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
                    place = slice(start, start + size)
                    local, columns = np.arange(size), np.ascontiguousarray(keys[place, : t[start]].T)
                    lab, mul, half, y = labels[place], mult[place], part[place], x[place]
                    for i in range(0, size, 500):
                        for j in range(i, size, 500):
                            a, b = slice(i, i + 500), slice(j, j + 500)
                            linked = (y[a] @ y[b].T >= threshold) & (lab[a, None] == lab[b])
                            if i == j:
                                linked = np.triu(linked, 1)
                            if low[start] != high[start]:
                                linked &= half[a, None] != half[b]
                            for column in columns:
                                if not linked.any():
                                    break
                                linked &= column[a, None] != column[b]
                            counts[place][a] += linked @ mul[b]
                            counts[place][b] += linked.T @ mul[a]
                            p, q = np.nonzero(linked)
                            local = _settle(local, p + i, q + j)
                    root[place] = start + local
                linked = counts > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(counts[linked]), pa.array(ids[root[linked]])], names=["rep", "n", "top"])

    found = stash(spark, full.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "rep").mapInArrow(compare, "rep long, n long, top long"), "vec-links")
    linked = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comps = components(spark, found.select(F.col("rep").alias("src"), F.col("top").alias("dst")).where("src <> dst").distinct())
    each = reps.select("rep", "mult", *[F.when(F.col("mult") > 1, F.col(c)).alias(f"r{c}") for c in ("h", "label", "v")]).join(linked, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    each = each.select("rep", "mult", "rh", "rlabel", "rv", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("component_id"))
    copies = usable.join(each.where("mult > 1"), (F.col("h") == F.col("rh")) & (F.col("label") == F.col("rlabel")) & (F.col("v") == F.col("rv"))).select("vec_id", "n_links", "component_id")
    judged = each.where("mult = 1").select(F.col("rep").alias("vec_id"), "n_links", "component_id").union(copies)
    valid = "label IS NOT NULL AND vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(v, x -> x <> 0)"
    alone = rows.where(f"NOT coalesce({valid}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return judged.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of `embeddings`."""
    return link_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs, by the same rule; equal results wherever no pair was missed.
VECTOR_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e
      WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
      AND list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id) AS n_links, (SELECT min(r.b) FROM r WHERE r.a = e.vec_id) AS component_id,
  e.vec_id = (SELECT min(r.b) FROM r WHERE r.a = e.vec_id) AS kept FROM e
"""
