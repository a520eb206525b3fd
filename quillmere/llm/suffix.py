"""Exact removal of long byte strings that repeat across documents, by prefix-free parsing.

A trigger is the place with the smallest rolling hash among those of some 100-byte window; every window has one, and equal
windows have it at the same place inside. The phrase of a trigger is what its windows cover, so phrases overlap as in a
prefix-free parse, and each window of a document starts in just one of them.

* The parse: every trigger with the hash of its phrase, dealt by trigger. Of equal phrases only the first in the corpus can
  be news; the others' windows are repeats. Each task sends just the first of its own equal phrases.
* The dictionary: where one trigger has several phrases, their bytes are fetched, once each. The suffix array of the
  dictionary (by prefix doubling over whole numbers, to 100 bytes) puts equal windows side by side, and the parse's first
  places put them in corpus order: all but the first of each are repeats.

* A trigger with many phrases (the edge of a passage that a third of the documents share) would be one task's work. Its
  phrases are cut into their windows instead, and those are dealt by 128 bits of hash.

So the suffix arrays' size follows the distinct text around differences, not the corpus. As a phrase covers its windows
whole, no order beyond a phrase decides anything, and the parse needs no suffix array of its own: its order is that of
first places. Phrases are compared by 96 bits or more of hash, windows of different phrases byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.shared import lean, ready, release, stash

SPAN, GRAM = 100, 28
#: Bytes parsed at once, bytes whose phrases are combined before they are sent, triggers and dictionary bytes of a reduce bucket.
PARSE, CHUNK, BUCKET_TRIGGERS, BUCKET_BYTES = 2_000_000, 32_000_000, 600_000, 3_000_000
#: Phrases of one trigger, in a chunk and in a bucket, above which they are dealt by window. Both ways give the same result.
HOT_CHUNK, HOT_BUCKET = 64, 4096
_POS = 28
_C = 0x9E3779B97F4A7C15 | 1
_NULL = -(1 << 63)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_C, n, 1 << 64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % (1 << 64)))
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict = {}


def _tables(n: int):
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PARSE + 200_000)
        _POWERS["up"], _POWERS["down"] = _powers(_C, size), _powers(pow(_C, -1, 1 << 64), size)
    return _POWERS["up"], _POWERS["down"]


def _grams(value: np.ndarray, size: int) -> np.ndarray:
    """Rolling hashes of `size` bytes at every place, by doubling."""
    parts, width, own = [], 1, value
    left = size
    while left:
        if left & 1:
            parts.append((width, own))
        left >>= 1
        if left:
            own = own[: len(own) - width] * _power(width) + own[width:]
            width *= 2
    out, done, n = None, 0, len(value) - size + 1
    for width, own in reversed(parts):
        piece = own[done : done + n]
        out = piece.copy() if out is None else out * _power(width) + piece
        done += width
    return out


def parse(raws: list[bytes]) -> dict:
    """Triggers of documents laid end to end: doc (index), a (first window), n (windows), left (bytes from a to the trigger), v and p (hashes of trigger and phrase)."""
    sizes = np.array([len(r) for r in raws], dtype="i8")
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.frombuffer(b"".join(raws), dtype="u1")
    long = np.flatnonzero(sizes >= SPAN)
    if not len(long):
        return {k: np.zeros(0, t) for k, t in (("doc", "i4"), ("a", "u4"), ("n", "u1"), ("left", "u1"), ("v", "u4"), ("p", "u8"), ("deal", "u4"))}
    value = _BYTES[flat]
    hashed = _mix(_grams(value, GRAM))
    mask = np.uint64((1 << _POS) - 1)
    key = (hashed & ~mask) | np.arange(len(hashed), dtype="u8")
    width, low, want = 1, key, SPAN - GRAM + 1
    while 2 * width <= want:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < want:
        low = np.minimum(low[: len(low) - (want - width)], low[want - width :])
    trigger = (low & mask).astype("i8")
    # windows inside documents only; runs of windows with one trigger
    counts = sizes[long] - SPAN + 1
    starts = np.repeat(offsets[long] - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(int(counts.sum()))
    at = trigger[starts]
    first = np.ones(len(at), dtype=bool)
    first[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    edge = np.flatnonzero(first)
    n = np.diff(np.append(edge, len(at)))
    a, t = starts[edge], at[edge]
    up, down = _tables(len(flat) + 1)
    summed = np.zeros(len(flat) + 1, dtype="u8")
    np.cumsum(value * up[: len(flat)], out=summed[1:])
    phrase = (summed[a + n + SPAN - 1] - summed[a]) * down[a]
    left = t - a
    doc = np.searchsorted(offsets, a, side="right") - 1
    mark = hashed[t]
    return {
        "doc": doc.astype("i4"), "a": (a - offsets[doc]).astype("u4"), "n": n.astype("u1"), "left": left.astype("u1"), "v": (mark >> np.uint64(32)).astype("u4"),
        "p": _mix(phrase + (left.astype("u8") << np.uint64(8) | n.astype("u8")) * np.uint64(0xD6E8FEB86659FD93)), "deal": (mark & np.uint64(0xFFFFFFFF)).astype("u4"),
    }


def _firsts(t: dict, ids: np.ndarray, crcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first of each (v, p) in corpus order, and of those after it. One document's equal rows are neither."""
    order = np.lexsort((t["a"], crcs, ids, t["p"], t["v"]))
    v, p, i, c, a = t["v"][order], t["p"][order], ids[order], crcs[order], t["a"][order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (p[1:] != p[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = (i != i[head]) | (c != c[head]) | (a != a[head])
    return order[new], order[later]


def _by_doc(ids, crcs, records: np.ndarray):
    """(ids, crcs, binary array): the records of each document as one value."""
    order = np.lexsort((crcs, ids))
    ids, crcs, records = ids[order], crcs[order], records[order]
    edge = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (crcs[1:] != crcs[:-1])])) if len(ids) else np.zeros(0, "i8")
    ends = np.append(edge, len(ids)) * records.dtype.itemsize
    blob = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(ends.astype("i4").tobytes()), pa.py_buffer(np.ascontiguousarray(records).tobytes())])
    return pa.array(ids[edge]), pa.array(crcs[edge].astype("i8")), blob


_COVER = np.dtype([("s", "<u4"), ("n", "<u4")])
_WANT = np.dtype([("a", "<u4"), ("v", "<u4"), ("n", "u1"), ("left", "u1")])
_NAMES = ["kind", "bucket", "doc_key", "crc", "blob"]
_SCHEMA = "kind int, bucket int, doc_key long, crc long, blob binary"


def _rows(kind: int, bucket, ids, crcs, blobs) -> pa.RecordBatch:
    n = len(blobs)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, "i4")), pa.array(np.broadcast_to(np.asarray(bucket, "i4"), n).copy()), ids, crcs, blobs], names=_NAMES)


_NOTHING = pa.Table.from_batches([_rows(1, 0, pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary()))])


def _cover_rows(ids, crcs, s, n, buckets: int = 1):
    """Runs by document; what passes through a shuffle on the way is dealt by the document, equal texts apart."""
    records = np.empty(len(s), dtype=_COVER)
    records["s"], records["n"] = s, n
    ids, crcs, blobs = _by_doc(ids, crcs, records)
    to = _mix(ids.to_numpy().view("u8") ^ (crcs.to_numpy().view("u8") << np.uint64(20))) % np.uint64(buckets)
    return _rows(1, to.astype("i4"), ids, crcs, blobs)


def _merged_runs(ids, crcs, starts, buckets: int = 1):
    """Runs by document of single window starts."""
    order = np.lexsort((starts, crcs, ids))
    i, c, s = ids[order], crcs[order], starts[order].astype("i8")
    edge = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (c[1:] != c[:-1]) | (s[1:] > s[:-1] + 1)]))
    last = np.append(edge[1:], len(s)) - 1
    return _cover_rows(i[edge], c[edge], s[edge], s[last] - s[edge] + 1, buckets)


def _send(parts: list[dict], ids: np.ndarray, crcs: np.ndarray, buckets: int):
    """Rows of one chunk: its first phrases by bucket (kind 0) and the windows already known to repeat (kind 1)."""
    t = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    first, later = _firsts(t, ids[t["doc"]], crcs[t["doc"]])
    if len(later):
        yield _cover_rows(ids[t["doc"][later]], crcs[t["doc"][later]], t["a"][later], t["n"][later], buckets)
    # triggers with many phrases here: the phrases are dealt by themselves, and a note goes to where the trigger's others are
    v, deal = t["v"][first], t["deal"][first]
    edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, "i8")
    count = np.diff(np.append(edge, len(v)))
    hot = np.repeat(count > HOT_CHUNK, count)
    if hot.any():
        at = edge[count > HOT_CHUNK]
        where, many = (deal[at] % np.uint32(buckets)).astype("i4"), v[at]
        used = np.unique(where)
        none = pa.array(np.zeros(len(used), "i8"))
        yield _rows(6, used, none, none, pa.array([many[where == b].tobytes() for b in used.tolist()], pa.binary()))
    for kind, own, key in ((0, first[~hot], deal[~hot]), (4, first[hot], t["p"][first[hot]])):
        to = (key % key.dtype.type(buckets)).astype("i4")
        order = np.argsort(to, kind="stable")
        own, edges = own[order], np.searchsorted(to[order], np.arange(buckets + 1))
        for b in range(buckets):
            mine = own[edges[b] : edges[b + 1]]
            if len(mine):
                used, doc = np.unique(t["doc"][mine], return_inverse=True)
                blob = np.array([len(used), len(mine)], dtype="i8").tobytes() + ids[used].tobytes() + crcs[used].astype("u4").tobytes() + b"".join(x.tobytes() for x in (t["p"][mine], t["v"][mine], t["a"][mine], doc.astype("u4"), t["n"][mine], t["left"][mine]))
                yield _rows(kind, b, pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([blob], pa.binary()))


def _parse_all(docs: DataFrame, buckets: int) -> DataFrame:
    @lean
    def run(batches):
        parts, ids, crcs, chunk = [], [], [], 0
        raws, bases, size = [], [], 0

        def close():
            nonlocal raws, bases, size
            if raws:
                t = parse(raws)
                t["a"] = t["a"] + np.array(bases, dtype="u4")[t["doc"]]
                t["doc"] = t["doc"] + np.int32(len(ids) - len(raws))
                parts.append(t)
                raws, bases, size = [], [], 0

        for batch in batches:
            for key, crc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = (text.as_py() or "").encode()
                # a long text is parsed in segments, each window in one of them
                for at in range(0, max(1, len(raw) - SPAN + 1), PARSE):
                    raws.append(raw[at : at + PARSE + SPAN - 1])
                    bases.append(at)
                    ids.append(key)
                    crcs.append(crc)
                    size += len(raws[-1])
                    chunk += len(raws[-1])
                    if size >= PARSE or len(raws) >= 100_000:
                        close()
                    if chunk >= CHUNK or len(ids) >= 1_000_000:
                        close()
                        yield from _send(parts, np.array(ids, "i8"), np.array(crcs, "i8"), buckets)
                        parts, ids, crcs, chunk = [], [], [], 0
        close()
        if parts:
            yield from _send(parts, np.array(ids, "i8"), np.array(crcs, "i8"), buckets)

    return docs.select("doc_key", "crc", "text").mapInArrow(run, _SCHEMA)


def _unpacked(blobs) -> dict | None:
    """The phrases that _send laid into blobs."""
    parts: dict = {k: [] for k in ("p", "v", "a", "n", "left", "id", "crc")}
    for blob in blobs:
        raw, at = blob.as_buffer(), 16
        docs, n = np.frombuffer(raw, dtype="i8", count=2).tolist()

        def take(kind, count):
            nonlocal at
            got = np.frombuffer(raw, dtype=kind, count=count, offset=at)
            at += got.nbytes
            return got

        ids, crcs = take("i8", docs), take("u4", docs)
        for k, kind in (("p", "u8"), ("v", "u4"), ("a", "u4")):
            parts[k].append(take(kind, n))
        doc = take("u4", n)
        parts["n"].append(take("u1", n))
        parts["left"].append(take("u1", n))
        parts["id"].append(ids[doc])
        parts["crc"].append(crcs[doc].astype("i8"))
    return {k: np.concatenate(x) for k, x in parts.items()} if parts["p"] else None


def _first_pass(table):
    """One bucket of the parse: repeats (kind 1) and, where a trigger has several phrases, the wish for their bytes (kind 2) or windows (kind 5)."""
    kinds = np.array(table.column("kind").to_pylist())
    out = []

    def blobs(kind):
        return table.filter(pa.array(kinds == kind)).column("blob")

    def wish(kind, t, own):
        if len(own):
            records = np.empty(len(own), dtype=_WANT)
            for k in ("a", "v", "n", "left"):
                records[k] = t[k][own]
            out.append(pa.Table.from_batches([_rows(kind, 0, *_by_doc(t["id"][own], t["crc"][own], records))]))

    known = table.filter(pa.array(kinds == 1))
    if known.num_rows:
        out.append(known)
    noted = [np.frombuffer(x.as_buffer(), dtype="u4") for x in blobs(6)]
    for kind in (0, 4):
        t = _unpacked(blobs(kind))
        if t is None:
            continue
        first, later = _firsts(t, t["id"], t["crc"])
        if len(later):
            out.append(pa.Table.from_batches([_cover_rows(t["id"][later], t["crc"][later], t["a"][later], t["n"][later])]))
        if kind == 4:
            wish(5, t, first)
            continue
        v = t["v"][first]  # sorted
        edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        count = np.repeat(np.diff(np.append(edge, len(v))), np.diff(np.append(edge, len(v))))
        hot = count > HOT_BUCKET
        if noted:
            hot |= np.isin(v, np.concatenate(noted))
        wish(2, t, first[(count > 1) & ~hot])
        wish(5, t, first[hot])
    if not out:
        return _NOTHING
    return pa.concat_tables([x.cast(out[0].schema) for x in out]).combine_chunks()


def suffix_ranks(flat: np.ndarray, span: int = SPAN) -> np.ndarray:
    """For each place with `span` bytes from it, its rank among the suffixes by those bytes; equal strings, equal ranks.

    Prefix doubling from 8 bytes: a rank of a length and one further on make the rank of the longer string.
    """
    def dense(key):
        order = np.argsort(key, kind="stable")
        new = np.zeros(len(key), dtype="u8")
        ranked = key[order]
        new[1:] = ranked[1:] != ranked[:-1]
        out = np.empty(len(key), dtype="u8")
        out[order] = np.cumsum(new)
        return out

    width = 8
    word = np.zeros(len(flat) - width + 1, dtype="u8")
    for j in range(width):
        word = word << np.uint64(8) | flat[j : j + len(word)]
    rank = dense(word)
    while 2 * width <= span:
        rank = dense(rank[: len(rank) - width] << np.uint64(32) | rank[width:])
        width *= 2
    if width < span:
        step = span - width
        rank = dense(rank[: len(rank) - step] << np.uint64(32) | rank[step:])
    return rank


def _dictionary(table):
    """One bucket of the dictionary: the windows of its phrases that occur earlier in the corpus, as runs (kind 1)."""
    ids, crcs, heads, texts = [], [], [], []
    for blob in table.column("blob"):
        raw = blob.as_buffer()
        n = int(np.frombuffer(raw, dtype="i8", count=1)[0])
        ids.append(np.frombuffer(raw, dtype="i8", count=n, offset=8))
        crcs.append(np.frombuffer(raw, dtype="i8", count=n, offset=8 + 8 * n))
        at = 8 + 16 * n
        heads.append(np.frombuffer(raw, dtype=_WANT, count=n, offset=at))
        texts.append(memoryview(raw)[at + n * _WANT.itemsize :])
    own, ids, crcs = np.concatenate(heads), np.concatenate(ids), np.concatenate(crcs)
    flat = np.frombuffer(b"".join(texts), dtype="u1")
    n = own["n"].astype("i8")
    offsets = np.concatenate([[0], np.cumsum(n + SPAN - 1)])[:-1]
    places = np.repeat(offsets - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(int(n.sum()))
    rank = suffix_ranks(flat)[places]
    phrase = np.repeat(np.arange(len(n)), n)
    start = own["a"].astype("i8")[phrase] + (places - offsets[phrase])
    _, doc = np.unique(np.stack([ids, crcs], axis=1), axis=0, return_inverse=True)  # ranks of documents in corpus order
    where = doc.reshape(-1)[phrase].astype("u8") << np.uint64(32) | start.astype("u8")
    order = np.lexsort((where, rank))
    ranked, placed = rank[order], where[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    covered = np.zeros(len(order), dtype=bool)
    covered[order] = placed != placed[head]
    hit = np.flatnonzero(covered)
    if len(hit):
        fresh = np.ones(len(hit), dtype=bool)
        fresh[1:] = (phrase[hit[1:]] != phrase[hit[:-1]]) | (hit[1:] != hit[:-1] + 1)
        edge = np.flatnonzero(fresh)
        length = np.diff(np.append(edge, len(hit)))
        at = hit[edge]
        return pa.Table.from_batches([_cover_rows(ids[phrase[at]], crcs[phrase[at]], start[at], length)])
    return _NOTHING


def _fetch(docs: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """The bytes of the phrases that are wanted, dealt by trigger."""

    @lean
    def run(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 500):
                part = batch.slice(row, 500)
                heads, ids, crcs, texts = [], [], [], []
                for key, crc, text, blobs in zip(*(part.column(i).to_pylist() for i in range(4))):
                    own, raw = np.frombuffer(b"".join(blobs), dtype=_WANT), text.encode()
                    heads.append(own)
                    ids.append(np.full(len(own), key))
                    crcs.append(np.full(len(own), crc))
                    texts += [raw[a : a + n + SPAN - 1] for a, n in zip(own["a"].tolist(), own["n"].tolist())]
                if not heads:
                    continue
                own, ids, crcs = np.concatenate(heads), np.concatenate(ids).astype("i8"), np.concatenate(crcs).astype("i8")
                to = (own["v"] % np.uint32(buckets)).astype("i4")
                order = np.argsort(to, kind="stable")
                edge = np.flatnonzero(np.concatenate([[True], to[order][1:] != to[order][:-1]]))
                b, x = [], []
                for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(order)]):
                    mine = order[lo:hi]
                    b.append(int(to[mine[0]]))
                    x.append(np.array([len(mine)], dtype="i8").tobytes() + ids[mine].tobytes() + crcs[mine].tobytes() + own[mine].tobytes() + b"".join(map(texts.__getitem__, mine.tolist())))
                none = pa.array(np.zeros(len(b), "i8"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), 3, "i4")), pa.array(b, pa.int32()), none, none, pa.array(x, pa.binary())], names=_NAMES)

    lists = wanted.groupBy("doc_key", "crc").agg(F.collect_list("blob").alias("blobs"))
    return docs.join(lists, ["doc_key", "crc"]).select("doc_key", "crc", "text", "blobs").mapInArrow(run, _SCHEMA)


_WINDOW = np.dtype([("h", "<u8"), ("l", "<u8"), ("id", "<i8"), ("crc", "<i8"), ("s", "<u4")])


def _first_windows(w: np.ndarray, buckets: int = 1):
    """(the first of each window in corpus order, rows of those after it)."""
    order = np.lexsort((w["s"], w["crc"], w["id"], w["l"], w["h"]))
    w = w[order]
    new = np.ones(len(w), dtype=bool)
    new[1:] = (w["h"][1:] != w["h"][:-1]) | (w["l"][1:] != w["l"][:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
    later = w[(w["id"] != w["id"][head]) | (w["crc"] != w["crc"][head]) | (w["s"] != w["s"][head])]
    return w[new], _merged_runs(later["id"], later["crc"], later["s"], buckets) if len(later) else None


def _windows(docs: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """The windows of phrases whose trigger has many, by 128 bits of hash and dealt by them (kind 3), each batch's repeats left out (kind 1)."""

    @lean
    def run(batches):
        import xxhash

        def send(rows):
            w = np.array(rows, dtype=_WINDOW)
            first, covered = _first_windows(w, buckets)
            if covered is not None:
                yield covered
            to = (first["h"] % np.uint64(buckets)).astype("i4")
            order = np.argsort(to, kind="stable")
            first, to = first[order], to[order]
            edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            none = pa.array(np.zeros(len(edge), "i8"))
            yield _rows(3, to[edge], none, none, pa.array([first[a:b].tobytes() for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(first)])], pa.binary()))

        rows: list = []
        for batch in batches:
            for row in range(batch.num_rows):
                key, crc, text, blobs = (batch.column(i)[row].as_py() for i in range(4))
                raw = memoryview(text.encode())
                own = np.unique(np.frombuffer(b"".join(blobs), dtype=_WANT))
                for a, n in zip(own["a"].tolist(), own["n"].tolist()):
                    for s in range(a, a + n):
                        h = xxhash.xxh3_128_intdigest(raw[s : s + SPAN])
                        rows.append((h >> 64, h & 0xFFFFFFFFFFFFFFFF, key, crc, s))
                    if len(rows) >= 200_000:
                        yield from send(rows)
                        rows = []
        if rows:
            yield from send(rows)

    lists = wanted.groupBy("doc_key", "crc").agg(F.collect_list("blob").alias("blobs"))
    return docs.join(lists, ["doc_key", "crc"]).select("doc_key", "crc", "text", "blobs").mapInArrow(run, _SCHEMA)


def _window_pass(table):
    """One bucket of windows: which of them occur earlier (kind 1)."""
    kinds = np.array(table.column("kind").to_pylist())
    out = [table.filter(pa.array(kinds == 1))]
    own = [np.frombuffer(x.as_buffer(), dtype=_WINDOW) for x in table.filter(pa.array(kinds == 3)).column("blob")]
    if own:
        covered = _first_windows(np.concatenate(own))[1]
        if covered is not None:
            out.append(pa.Table.from_batches([covered]).cast(table.schema))
    return pa.concat_tables(out).combine_chunks()


def repeats(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with doc_key and crc, rows of doc_key, crc and runs of window starts that repeat an earlier window)."""
    ready(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_key"), F.crc32(text.cast("binary")).alias("crc"), text.alias("text"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))  # so that small inputs use all tasks too
    buckets = max(least, int(total * 2 / (SPAN - GRAM + 2) / BUCKET_TRIGGERS) + 1)
    passed = stash(spark, _parse_all(keyed, buckets).groupBy("bucket").applyInArrow(_first_pass, _SCHEMA), "pfp-parse")
    release(spark)
    wishes = {r["kind"]: r["size"] // _WANT.itemsize for r in passed.where("kind <> 1").groupBy("kind").agg(F.sum(F.length("blob")).alias("size")).collect()}
    cover = passed.where("kind = 1").select("doc_key", "crc", "blob")
    if wishes.get(2):
        pieces = max(least, int(wishes[2] * (SPAN + 36) / BUCKET_BYTES) + 1)
        more = stash(spark, _fetch(keyed, passed.where("kind = 2"), pieces).groupBy("bucket").applyInArrow(_dictionary, _SCHEMA), "pfp-dictionary")
        cover = cover.union(more.select("doc_key", "crc", "blob"))
    if wishes.get(5):
        pieces = max(least, int(wishes[5] * (SPAN - GRAM + 1) * _WINDOW.itemsize / (8 * BUCKET_BYTES)) + 1)
        more = stash(spark, _windows(keyed, passed.where("kind = 5"), pieces).groupBy("bucket").applyInArrow(_window_pass, _SCHEMA), "pfp-windows")
        cover = cover.union(more.select("doc_key", "crc", "blob"))
    release(spark)
    return keyed, cover


def kept_parts(raw: bytes, runs: np.ndarray) -> tuple[bytes, int]:
    """What the windows that start in the runs do not cover, and how many stretches they do."""
    order = np.argsort(runs["s"], kind="stable")
    begin = runs["s"][order].astype("i8")
    end = np.maximum.accumulate(begin + runs["n"][order] + SPAN - 1)
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    begin, end = begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
    return b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(raw)])), len(begin)


def drop_repeats(spark: SparkSession, docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document; with_text adds what is kept, as bytes.

    A byte goes if some 100-byte string over it also starts earlier: in a smaller doc_id, or earlier in the same document.
    Rows that share a doc_id but not a text are ordered by the text's crc32; identical rows are one document and get equal
    results. A null doc_id comes before all others, a null text is empty, an empty table gives none, other columns are not
    read. A very long text is parsed in segments. Long runs of one byte, and lines that a third of the rows share, leave each
    task once; triggers with many phrases are dealt by window.
    """
    keyed, cover = repeats(spark, docs)
    lists = cover.groupBy("doc_key", "crc").agg(F.collect_list("blob").alias("blobs"))
    joined = keyed.join(lists, ["doc_key", "crc"], "left").select("doc_id", "text", "blobs")

    @lean
    def run(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(row, 1000), []
                for text, blobs in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw = text.encode()
                    if blobs:
                        kept, spans = kept_parts(raw, np.frombuffer(b"".join(blobs), dtype=_COVER))
                    else:
                        kept, spans = raw, 0
                    rows.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
                cols = list(zip(*rows))
                out = [part.column(0), *[pa.array(c, t) for c, t in zip(cols[:4], (pa.int64(), pa.int64(), pa.int64(), pa.string()))]]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    out, names = [*out, pa.array(cols[4], pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))


def op9_drop_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`. The rows are small against the texts they come from, so they are gathered into fewer files."""
    return drop_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).hint("rebalance")
