"""Exact Jaccard self-join of 5-word shingle sets by universe partition and the pigeonhole principle.

Two sets of sizes x <= y with similarity 0.8 or more differ in at most (x + y) / 9 elements. Hashing the universe into more
segments than that leaves some segment where both hold the same subset. Sizes are dealt into bands so that a partner is in
the same band or the next; a set is cut once by its own band's segments and once by those of the band below. Of its
segments it indexes the cheapest of a global order (those with the rarest elements, then the largest), one more than the
elements that may differ: if both sides do so by the same order, a shared segment is among those of both. A set with too
few non-empty segments for that also indexes its one-deletion neighbourhood, where a segment counts for two differences,
and, if even that does not reach, its empty segments. Candidates are verified on the sets themselves.

Elements are 64-bit hashes of shingles and a set's name is a 64-bit hash of its elements; two different shingles of one
pair share a hash with probability below 1e-12.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.components import components
from quillmere.llm.shared import lean, ready, release, stash, unstash

WORDS = 5
#: Characters whose documents are handled together, rows of a reduce bucket, bytes of sets verified together.
CHUNK, BUCKET_ROWS, BUCKET_BYTES = 16_000_000, 2_000_000, 16_000_000
#: Ways that the rows of a hub are dealt while its leaves are numbered.
SPREAD = 64
#: Leaves of a hub that are verified in one group, and words that a worker remembers.
HUB_LEAVES, CACHE = 1000, 300_000
#: Sets of a block of a cluster; a cluster of more than so many blocks is settled group by group.
CLUSTER_BLOCK, CLUSTER_BLOCKS = 2000, 16
#: Members of a group that are joined together, so that a large group is many keys.
PART = 256
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEPS = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE:
            self[word] = h
        return h


def shingle_sets(texts: list[str], known: _Words) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes. Small letters are made of A-Z only and words end at ASCII white space."""
    import xxhash

    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.array([len(w) for w in split])
    flat = np.fromiter((known[w] for words in split for w in words), dtype="u8", count=int(sizes.sum()))
    n = max(0, len(flat) - WORDS + 1)
    grams = np.zeros(n, dtype="u8")
    for j, c in enumerate(_STEPS):
        grams += flat[j : j + n] * c
    grams = mix(grams)
    out, at = [], 0
    for words, size in zip(split, sizes.tolist()):
        if size >= WORDS:
            own = np.sort(grams[at : at + size - WORDS + 1])
            keep = np.empty(len(own), dtype=bool)
            keep[0], keep[1:] = True, own[1:] != own[:-1]
            out.append(own[keep])
        elif size:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=size)], dtype="u8"))
        else:
            out.append(grams[:0])
        at += size
    return out


def set_name(elements: np.ndarray) -> int:
    return int(mix(np.array([np.add.reduce(mix(elements ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(elements))], dtype="u8")).view("i8")[0])


class Bands:
    """Size bands for a similarity of num / den, their segments and how many elements may differ."""

    def __init__(self, percent: int = 80):
        self.percent, self.low = percent, [1, 2]

    def most_partner(self, size: int) -> int:
        return 100 * size // self.percent

    def differ(self, x: int, y: int) -> int:
        """100 I >= p (x + y - I) allows x + y - 2 I of at most (100 - p)(x + y) / (100 + p)."""
        return (100 - self.percent) * (x + y) // (100 + self.percent)

    def of(self, size: int) -> int:
        while self.low[-1] <= size:
            self.low.append(max(self.low[-1] + 1, self.most_partner(self.low[-1] - 1) + 1))
        return int(np.searchsorted(self.low, size, side="right")) - 1

    def segments(self, band: int) -> int:
        top = self.low[band + 1] - 1
        h = self.differ(top, self.most_partner(top))
        return 1 if h == 0 else max(-(-2 * top // 5), h + 3)

    def plans(self, size: int) -> list[tuple[int, int, int]]:
        """(band of the smaller set, segments, differences) of the two ways that a set is cut."""
        own = self.of(size)
        out = [(own, self.segments(own), self.differ(size, self.most_partner(size)))]
        if own:
            top = self.low[own] - 1
            if size <= self.most_partner(top):
                out.append((own - 1, self.segments(own - 1), self.differ(size, top)))
        return out


def signatures(elements: np.ndarray, bands: Bands, heavy: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The signatures a set is indexed by. heavy: sorted frequent elements, with their counts."""
    out = []
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, elements), len(heavy) - 1)
        often = np.where(heavy[at] == elements, counts[at], 0)
    else:
        often = np.zeros(len(elements), dtype="i8")
    for band, segments, differ in bands.plans(len(elements)):
        salt = np.uint64(((2 * band + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
        mixed = mix(elements + salt)
        segment = (mixed >> np.uint64(32)) % np.uint64(segments)
        order = np.argsort(segment, kind="stable")
        segment = segment[order]
        begin = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        size = np.diff(np.append(begin, len(elements)))
        ids = segment[begin] + salt
        content = np.add.reduceat(mixed[order], begin)
        exact = mix(content + mix(ids))
        need = differ + 1
        if len(begin) >= need:
            if len(begin) > need:
                cost = (np.minimum(np.minimum.reduceat(often[order], begin), 1 << 30).astype("u8") << np.uint64(32)) | ((np.uint64(4095) - np.minimum(size, 4095).astype("u8")) << np.uint64(20)) | (exact >> np.uint64(44))
                exact = exact[np.lexsort((exact, cost))[:need]]
            out.append(exact)
            continue
        # too few non-empty segments: all of them, their one-deletion neighbourhoods and, if it must be, the empty ones
        out.append(exact)
        large = size >= 2
        tag = mix(ids ^ np.uint64(0xD1B54A32D192ED03))
        wide = np.repeat(np.arange(len(begin)), size)
        less = (content[wide] - mixed[order])[large[wide]]
        out += [mix(content + tag), mix(less + tag[wide][large[wide]])]  # one element alone, too: what is left of two may face it
        if int(large.sum()) + len(begin) < need:
            empty = np.setdiff1d(np.arange(segments, dtype="u8"), segment)
            out.append(mix(mix(empty + salt) ^ np.uint64(0xA24BAED4963EE407)))
    return np.unique(np.concatenate(out)) if out else elements[:0]


def _chunks(batches):
    """(first column, texts) of about CHUNK characters, across batches."""
    ids, texts, chars = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(tuple(i.values()) if isinstance(i, dict) else i)
            texts.append(t.as_py() or "")
            chars += len(texts[-1])
            if chars >= CHUNK or len(ids) >= 60_000:
                yield ids, texts
                ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def _sets(texts, known):
    for at in range(0, len(texts), 400):
        yield from shingle_sets(texts[at : at + 400], known)


def text_key():
    """A row's text, as a key: rows of one doc_id with different texts are told apart by it."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def name_sets(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, size and name of its set, key of its text; kind 1: an element (as doc_id), how many different sets of a chunk hold it."""

    @lean
    def run(batches):
        known = _Words()
        for ids, texts in _chunks(batches):
            ids, keys = zip(*ids)
            sizes, names, seen, pool = [], [], set(), []
            for own in _sets(texts, known):
                sizes.append(len(own))
                names.append(set_name(own))
                if len(own) and names[-1] not in seen:
                    seen.add(names[-1])
                    pool.append(own)
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(keys, pa.int64())], names=["kind", "a", "n", "name", "h"])
            if pool:
                every = np.sort(np.concatenate(pool))
                first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
                count = np.diff(np.append(first, len(every)))
                often = count >= 3
                none = pa.array(np.zeros(int(often.sum()), "i8"))
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(int(often.sum()), "i4")), pa.array(every[first[often]].view("i8")), pa.array(count[often].astype("i8")), none, none], names=["kind", "a", "n", "name", "h"])

    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("h")).alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(run, "kind int, a long, n long, name long, h long")
    return stash(spark, rows, "jac-names")


def _index(docs: DataFrame, heavy, buckets: int, percent: int) -> DataFrame:
    """bucket, blob: the signatures of each chunk's sets, dealt by signature; equal sets of a chunk are indexed once."""

    @lean
    def run(batches):
        known, bands = _Words(), Bands(percent)
        elements, counts = heavy.value
        for _, texts in _chunks(batches):
            names, sigs, owners = [], [], []
            seen: set = set()
            for own in _sets(texts, known):
                if len(own):
                    name = set_name(own)
                    if name not in seen:
                        seen.add(name)
                        got = signatures(own, bands, elements, counts)
                        sigs.append(got)
                        owners.append(np.full(len(got), len(names), dtype="u2"))
                        names.append(name)
            if not names:
                continue
            names = np.array(names, dtype="i8")
            sig, owner = np.concatenate(sigs), np.concatenate(owners)
            del sigs, owners
            to = (sig % np.uint64(buckets)).astype("i4")
            order = np.argsort(to, kind="stable")
            sig, owner, edges = sig[order], owner[order], np.searchsorted(to[order], np.arange(buckets + 1))
            for b in range(buckets):
                if edges[b] < edges[b + 1]:
                    s, o = sig[edges[b] : edges[b + 1]], owner[edges[b] : edges[b + 1]]
                    used, o = np.unique(o, return_inverse=True)
                    blob = np.array([len(used), len(s)], dtype="i8").tobytes() + names[used].tobytes() + (s >> np.uint64(16)).astype("u4").tobytes() + (s >> np.uint64(48)).astype("u2").tobytes() + o.astype("u2").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "blob"])

    return docs.select(F.lit(0), F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, blob binary")


def _meet(table: pa.Table) -> pa.Table:
    """Of one bucket: kind 0, pairs of names that alone share a signature; kind 1, members of groups of three or more, by the group's hash, with their part and the group's size."""
    sigs, names = [], []
    for blob in table.column("blob"):
        raw = blob.as_buffer()
        k, n = np.frombuffer(raw, dtype="i8", count=2).tolist()
        own = np.frombuffer(raw, dtype="i8", count=k, offset=16)
        at = 16 + 8 * k
        low, high, o = (np.frombuffer(raw, dtype=t, count=n, offset=at + d * n) for t, d in (("u4", 0), ("u2", 4), ("u2", 6)))
        sigs.append(low.astype("u8") | high.astype("u8") << np.uint64(32))
        names.append(own[o])
    sig, name = np.concatenate(sigs), np.concatenate(names)
    del sigs, names
    order = np.argsort(sig, kind="stable")
    sig, name = sig[order], name[order]
    # only signatures with company matter from here on
    same = np.zeros(len(sig) + 1, dtype=bool)
    same[1:-1] = sig[1:] == sig[:-1]
    keep = same[1:] | same[:-1]
    sig, name = sig[keep], name[keep]
    order = np.lexsort((name, sig))
    sig, name = sig[order], name[order]
    keep = np.ones(len(sig), dtype=bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (name[1:] != name[:-1])
    sig, name = sig[keep], name[keep]
    begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, "i8")
    size = np.diff(np.append(begin, len(sig)))
    two = begin[size == 2]
    pairs = np.unique(np.stack([name[two], name[two + 1]], axis=1), axis=0) if len(two) else np.zeros((0, 2), "i8")
    big = np.repeat(size >= 3, size)
    if big.any():
        group = np.add.reduceat(mix(name.view("u8")), begin) + size.astype("u8")
        wide = np.repeat(mix(group), size).view("i8")
        members, at = np.unique(np.stack([wide[big], name[big]], axis=1), axis=0, return_index=True)
        part, many = ((np.arange(len(name)) - np.repeat(begin, size)) // PART)[big][at], np.repeat(size, size)[big][at]
    else:
        members, part, many = np.zeros((0, 2), "i8"), np.zeros(0, "i8"), np.zeros(0, "i8")
    both, none = np.concatenate([pairs, members]), np.zeros(len(pairs), "i8")
    return pa.table({"kind": pa.array(np.repeat(np.array([0, 1], "i4"), [len(pairs), len(members)])), "a": pa.array(both[:, 0].copy()), "b": pa.array(both[:, 1].copy()), "part": pa.array(np.concatenate([none, part]).astype("i4")), "size": pa.array(np.concatenate([none, many]))})


def _verify(spark: SparkSession, texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. texts: name, n, text of every name in pairs. A hub's leaves are dealt over several groups."""
    fan = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("fan")).where(F.col("fan") > HUB_LEAVES)
    hot = fan.select(F.col("a").alias("hot_a"), "fan", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("hot_s"))
    spread = pairs.join(hot, (F.col("a") == F.col("hot_a")) & (F.pmod(F.xxhash64(F.lit(1), "b"), F.lit(SPREAD)) == F.col("hot_s")), "left")
    dealt = stash(spark, spread.select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.ceil(F.col("fan") / HUB_LEAVES)), F.lit(0)).cast("int").alias("salt")), "jac-dealt")
    wanted = dealt.select(F.col("b").alias("name"), "a", "salt", F.lit(False).alias("hub")).union(dealt.select(F.col("a").alias("name"), "a", "salt", F.lit(True).alias("hub")).distinct())
    wanted = stash(spark, wanted.join(texts.select("name", "n"), "name"), "jac-wanted")
    unstash(spark, dealt)
    total = wanted.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-8 * total // BUCKET_BYTES))
    lists = wanted.groupBy("name").agg(F.collect_list(F.struct("a", "salt", "hub")).alias("to"))

    @lean
    def ship(batches):
        known = _Words()
        for batch in batches:
            for row in range(0, batch.num_rows, 200):
                part = batch.slice(row, 200)
                rows: list = []
                for name, own, to in zip(part.column(0).to_pylist(), shingle_sets([t or "" for t in part.column(1).to_pylist()], known), part.column(2).to_pylist()):
                    raw = own.tobytes()
                    rows += [(hash((x["a"], x["salt"])) % buckets, x["a"], x["salt"], x["hub"], name, raw) for x in to]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
                    for k in range(0, len(rows), 500):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 500]), kinds)], names=["bucket", "a", "salt", "hub", "name", "elements"])

    shipped = texts.join(lists.hint("merge"), "name").select("name", "text", "to").mapInArrow(ship, "bucket long, a long, salt int, hub boolean, name long, elements binary")

    def judge(table: pa.Table) -> pa.Table:
        keys = list(zip(table.column("a").to_pylist(), table.column("salt").to_pylist()))
        hubs, names, raws = table.column("hub").to_pylist(), table.column("name").to_pylist(), table.column("elements")
        centre = {key: np.frombuffer(raws[i].as_buffer(), dtype="u8") for i, key in enumerate(keys) if hubs[i]}
        out: list = []
        for i, key in enumerate(keys):
            if not hubs[i]:
                x, y = centre[key], np.frombuffer(raws[i].as_buffer(), dtype="u8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    out.append((key[0], names[i]))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"src": pa.array(a, pa.int64()), "dst": pa.array(b, pa.int64())})

    return stash(spark, shipped.groupBy("bucket").applyInArrow(judge, "src long, dst long"), "jac-links")


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every document; links are pairs with 100 |A and B| >= percent |A or B|.

    Documents with equal sets are one node. Every candidate pair is verified unless its ends are already in one component
    through verified links, so components are exact. A text without words (or null) has an empty set and is its own
    component; a null doc_id keeps a null component unless linked documents give one. Repeated rows get equal results; an
    empty table gives none; other columns are not read.
    """
    own = F.when(F.col("n") > 0, F.coalesce("comp_doc", "doc_id")).otherwise(F.col("doc_id"))
    return _judged(spark, docs, percent).select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _judged(spark: SparkSession, docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, h (its text's key), n, name of the set, and the smallest doc_id of its component with the smallest set of that doc_id."""
    ready(spark)
    named = name_sets(spark, docs)
    nodes = named.where("kind = 0").select(F.col("a").alias("doc_id"), "n", "name", "h")
    owner = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("owner")
    first = nodes.where("n > 0").groupBy("name").agg(owner, F.max("n").alias("n")).select("name", "n", F.col("owner.doc_id").alias("doc"), F.col("owner.h").alias("h"))
    first = stash(spark, first, "jac-first")
    sums = first.agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("elements")).first()
    links = None
    if sums["sets"]:
        often = max(24, sums["sets"] // 2000)
        heavy = named.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= often).orderBy(F.desc("n"), "a").limit(500_000).toArrow()
        elements, counts = heavy.column("a").to_numpy().view("u8"), heavy.column("n").to_numpy()
        order = np.argsort(elements)
        frequent = spark.sparkContext.broadcast((elements[order], counts[order]))  # half a million at most, and only costs hang on it
        buckets = max(1, -(-int(sums["elements"]) // (2 * BUCKET_ROWS)))
        met = stash(spark, _index(docs, frequent, buckets, percent).groupBy("bucket").applyInArrow(_meet, "kind int, a long, b long, part int, size long"), "jac-met")
        release(spark)
        links = _links(spark, docs, nodes, met, first, percent)
    if links is None:
        each = first.select("name", F.col("doc").alias("comp_doc"), F.col("name").alias("comp_name"))
    else:
        comps = components(spark, links)
        least = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "node"))
        tops = comps.join(first.select(F.col("name").alias("node"), "doc"), "node").groupBy("comp").agg(least.alias("top")).select("comp", F.col("top.doc").alias("comp_doc"), F.col("top.node").alias("comp_name"))
        linked = comps.join(tops, "comp").select(F.col("node").alias("name"), "comp_doc", "comp_name")
        each = first.join(linked, "name", "left").select("name", F.coalesce("comp_doc", "doc").alias("comp_doc"), F.coalesce("comp_name", "name").alias("comp_name"))
    return nodes.join(each, "name", "left").select("doc_id", "h", "n", "name", "comp_doc", "comp_name")


def rows_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents whose (doc_id, text key) is in wanted (doc, h and more, distinct), with wanted's other columns.

    Whole rows move once, in a merge join: rows that repeat a doc_id and a text many times are split by Spark when their
    partition is large, and never buffered.
    """
    given = docs.withColumns({"jac_doc": F.col("doc_id").cast("long"), "jac_key": text_key()})
    asked = wanted.withColumnRenamed("doc", "jac_w_doc").withColumnRenamed("h", "jac_w_key").hint("merge")
    return given.join(asked, F.col("jac_doc").eqNullSafe(F.col("jac_w_doc")) & (F.col("jac_key") == F.col("jac_w_key"))).drop("jac_doc", "jac_key", "jac_w_doc", "jac_w_key")


def _links(spark: SparkSession, docs: DataFrame, nodes: DataFrame, met: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Verified links that connect all that any candidate pair connects.

    First each set is held against one partner, the one that meets most others in its groups: of many near copies that is
    the text they stem from, so a large group takes as many comparisons as it has members. Groups whose members are not in
    one component after that are settled block by block. A group's rows are joined by its parts, so a large one is no hot key.
    """
    twos = met.where("kind = 0").select("a", "b").distinct()
    members = stash(spark, met.where("kind = 1").select(F.col("a").alias("g"), F.col("b").alias("name"), "part", "size").distinct(), "jac-members")
    central = members.groupBy("name").agg(F.sum("size").alias("c"))
    known = stash(spark, members.select("name").union(twos.select("a")).union(twos.select("b")).distinct().join(first, "name").join(central, "name", "left").select("name", "n", "doc", "h", F.coalesce("c", F.lit(0)).alias("c")), "jac-known")
    # the text of one document for each set that has a candidate: whole rows of docs move once, here
    owned = rows_of(docs.select("doc_id", F.col("text").cast("string").alias("text")), known.drop("c")).select("name", "n", "text")
    if nodes.groupBy("doc_id", "h").count().where("count > 1").limit(1).count():
        owned = owned.groupBy("name").agg(F.max("n").alias("n"), F.first("text").alias("text"))  # rows that are repeated; each task keeps one
    texts = stash(spark, owned, "jac-texts")
    release(spark)
    rank = lambda side, name: known.select(F.col("name").alias(side), F.struct("c", F.col("name").alias("who"), F.col("n").alias("size")).alias(name))
    by_part = lambda frame: frame.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / PART).cast("int")))).drop("size")
    ranked = members.join(rank("name", "r"), "name")
    hubs = stash(spark, ranked.groupBy("g", "size").agg(F.max("r").alias("top")), "jac-hubs")
    offers = ranked.drop("size").join(by_part(hubs), ["g", "part"]).select("name", "r", "top")
    both = twos.join(rank("a", "ra"), "a").join(rank("b", "rb"), "b")
    offers = offers.union(both.select("a", "ra", "rb")).union(both.select("b", "rb", "ra"))
    fits = 100 * F.least("r.size", "top.size") >= percent * F.greatest("r.size", "top.size")
    chosen = offers.where((F.col("r") < F.col("top")) & fits).groupBy(F.col("name").alias("b")).agg(F.max("top").alias("top")).select(F.col("top.who").alias("a"), "b")
    chosen = stash(spark, chosen, "jac-chosen")
    links = _verify(spark, texts, chosen, percent)
    comps = components(spark, links)
    lab = lambda side: comps.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
    # what is still open, as edges between components: a component is one node, however many sets it has
    grouped = members.join(by_part(hubs.select("g", "size", F.col("top.who").alias("who"))), ["g", "part"]).join(lab("name"), "name", "left").select("g", "part", "size", "name", "who", F.coalesce("cname", "name").alias("c"))
    mixed = grouped.groupBy("g", "size").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.when(F.col("name") == F.col("who"), F.col("c"))).alias("centre")).where("lo <> hi").select("g", "size", "centre")
    tried = chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    apart = twos.join(lab("a"), "a", "left").join(lab("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb").join(tried, ["a", "b"], "left_anti")
    opened = grouped.drop("size").join(by_part(mixed), ["g", "part"]).select("g", "name", "c", F.col("centre").alias("other"))
    pair = F.xxhash64(F.lit("pair"), "a", "b").alias("g")
    opened = opened.union(apart.select(pair, "a", "ca", "cb")).union(apart.select(pair, "b", "cb", "ca"))
    opened = stash(spark, opened, "jac-open")
    if opened.limit(1).count():
        edges = opened.where("c <> other").select(F.col("c").alias("src"), F.col("other").alias("dst")).distinct()
        clusters = components(spark, edges).select(F.col("node").alias("c"), F.col("comp").alias("cluster"))
        placed = stash(spark, opened.select("g", "name", "c").join(clusters, "c").select("g", "name", "cluster", F.col("c").alias("part_of")), "jac-placed")
        whole = placed.select("name", "cluster", "part_of").distinct()
        large = whole.groupBy("cluster").count().where(F.col("count") > CLUSTER_BLOCK * CLUSTER_BLOCKS).select("cluster")
        if large.limit(1).count():
            # chains of groups can tie very many sets into one cluster: there only members of one group are held against each other
            whole = whole.join(large, "cluster", "left_anti").select("name", "cluster", "part_of").union(placed.join(large, "cluster", "left_semi").select("name", F.col("g").alias("cluster"), "part_of").distinct())
        links = links.union(_settle(spark, texts, whole, percent))
        unstash(spark, placed)
    for used in (members, known, chosen, opened, hubs):
        unstash(spark, used)
    return links


def _settle(spark: SparkSession, texts: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Links between different components within each cluster of candidates.

    placed: name, cluster, part_of (its component). A cluster is compared block against block, each pair of blocks by
    itself: its sets come together once and meet over an index of their elements. Only a spanning forest of links comes out.
    """
    count = placed.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / CLUSTER_BLOCK).cast("int").alias("parts"))
    dealt = placed.join(count, "cluster").withColumn("part", F.pmod(F.xxhash64("name"), "parts").cast("int"))
    dealt = stash(spark, dealt.join(texts.select("name", "n"), "name"), "jac-dealt")
    total = dealt.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] or 0
    buckets = max(1, -(-8 * total // BUCKET_BYTES))

    @lean
    def ship(batches):
        known = _Words()
        for batch in batches:
            for row in range(0, batch.num_rows, 200):
                part = batch.slice(row, 200)
                rows: list = []
                for own, name, cluster, comp, at, parts in zip(shingle_sets([t or "" for t in part.column(0).to_pylist()], known), *(part.column(i).to_pylist() for i in range(1, 6))):
                    raw = own.tobytes()
                    for other in range(parts):
                        i, j = min(at, other), max(at, other)
                        rows.append((hash((cluster, i, j)) % buckets, cluster, i, j, at, name, comp, raw))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                for k in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 500]), kinds)], names=["bucket", "cluster", "i", "j", "part", "name", "comp", "elements"])

    shipped = texts.select("name", "text").join(dealt.hint("merge"), "name").select("text", "name", "cluster", "part_of", "part", "parts").mapInArrow(ship, "bucket long, cluster long, i int, j int, part int, name long, comp long, elements binary")

    def judge(table):
        where: dict = {}
        for row, key in enumerate(zip(*(table.column(k).to_pylist() for k in ("cluster", "i", "j")))):
            where.setdefault(key, []).append(row)
        parts, names, comps, raws = (table.column(k) for k in ("part", "name", "comp", "elements"))
        out: list = []
        for (_, i, j), rows in where.items():
            out += _between([np.frombuffer(raws[r].as_buffer(), dtype="u8") for r in rows], np.array([names[r].as_py() for r in rows]), np.array([comps[r].as_py() for r in rows]), np.array([parts[r].as_py() for r in rows]), i, j, percent)
        a, b = zip(*out) if out else ((), ())
        return pa.table({"src": pa.array(a, pa.int64()), "dst": pa.array(b, pa.int64())})

    return stash(spark, shipped.groupBy("bucket").applyInArrow(judge, "src long, dst long"), "jac-settled")


def _between(sets: list, names: np.ndarray, comps: np.ndarray, part: np.ndarray, i: int, j: int, percent: int) -> list:
    """Links between sets of part i and part j that join different components, none that earlier ones make needless."""
    labels, comp = np.unique(comps, return_inverse=True)
    most = np.bincount(comp).argmax()  # members of the largest component are not held against each other
    root = np.arange(len(labels))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    values, code = np.unique(flat, return_inverse=True)
    order = np.argsort(code, kind="stable")
    holders, edge = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(values)))])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for x in np.flatnonzero(comp != most).tolist():
        own = code[begin[x] : begin[x + 1]]
        own = own[edge[own + 1] - edge[own] > 1]
        if not len(own):
            continue
        common = np.bincount(np.concatenate([holders[edge[k] : edge[k + 1]] for k in own.tolist()]), minlength=len(sets))
        near = 100 * common >= percent * (sizes[x] + sizes - common)
        if i != j:
            near &= part != part[x]
        for y in np.flatnonzero(near & (comp != comp[x])).tolist():
            u, w = find(comp[x]), find(comp[y])
            if u != w:
                root[u] = w
                out.append((int(names[x]), int(names[y])))
    return out


def keep_one_of_each(spark: SparkSession, docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents, all columns as they are, one row of each component: that with the smallest doc_id and, in it, set.

    Rows of one doc_id with different sets are judged each by their own component. A component without any doc_id leaves
    one row too. A text without words is its own component: it leaves one row per doc_id, and stays where that is null.
    Among rows that are equal in doc_id and text the one with the smallest hash of all columns stays.
    """
    best = (F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("comp_doc")) & (F.col("name") == F.col("comp_name")))
    judged = _judged(spark, docs, percent)
    nodes = stash(spark, judged.select("doc_id", "h", "n", "name", best.alias("best")), "jac-judged")
    bare = (F.col("n") == 0) & F.col("doc_id").isNull()
    wanted = nodes.where("best").where(~bare)
    kept = stash(spark, wanted.groupBy(F.col("doc_id").alias("doc"), "name").agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("jac_rows")).select("doc", "h", "jac_rows"), "jac-kept")
    rows = rows_of(docs, kept)
    if kept.where("jac_rows > 1").limit(1).count():
        columns = [F.col(f"`{c}`") for c in docs.columns]
        order = F.xxhash64(*[c.cast("string") for c in columns])
        many = rows.where("jac_rows > 1").groupBy("doc_id", text_key().alias("jac_h")).agg(F.min_by(F.struct(*columns), order).alias("jac_one")).select("jac_one.*")
        rows = rows.where("jac_rows = 1").select(*columns).unionByName(many)
    rows = rows.select(*[F.col(f"`{c}`") for c in docs.columns])
    if nodes.where(bare).limit(1).count():
        empty = nodes.where(bare).select(F.col("h").alias("jac_bare")).distinct()
        rows = rows.unionByName(docs.where("doc_id IS NULL").withColumn("jac_h", text_key()).join(empty, F.col("jac_h") == F.col("jac_bare"), "left_semi").drop("jac_h"))
    return rows


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
