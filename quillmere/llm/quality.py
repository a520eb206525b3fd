"""Quality by attention-based multiple-instance learning: a document is a bag of passages, its label the only teacher."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.langid import fold
from quillmere.llm.mixing import unit
from quillmere.llm.shared import lean, ready, stash, unstash

#: Words of a passage.
PASSAGE = 64
#: Byte classes: white space, small and capital ASCII letters, digits, other bytes of letters, and some punctuation.
_NAMES = [b" ", b"\n\r\t\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b".,", b";:?'\"", b"!", b"|", b"#$%&*@^~", b"()[]{}<>", b"-_/\\=+`"]
_CLASSES = len(_NAMES) + 1
_CLASS = np.full(256, _CLASSES - 1, dtype="i8")
for _i, _b in enumerate(_NAMES):
    _CLASS[list(_b)] = _i
#: Hashed small words (up to 4 letters), which tell prose from lists.
_SHORT = 32
WIDTH = _CLASSES + _CLASSES * _CLASSES + 6 + _SHORT
#: Characters of a text whose passages are handled together.
SLICE = 1 << 20
_SPACE = re.compile(r"\s")


def word_blocks(text: str):
    """The words of a text in lists whose lengths, but for the last, are multiples of PASSAGE."""
    left, at, given = [], 0, False
    while True:
        m = _SPACE.search(text, at + SLICE) if len(text) - at > SLICE else None
        words = left + text[at : m.end() if m else len(text)].split()
        if m is None:
            if words or not given:
                yield words
            return
        whole = len(words) - len(words) % PASSAGE
        left, at = words[whole:], m.end()
        if whole:
            given = True
            yield words[:whole]


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and how many each text has; an empty text has one empty passage."""
    return word_passages([t.split() for t in texts])


def word_passages(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    parts, counts, extra = [], [], []
    for words in lists:
        n = 0
        for at in range(0, max(1, len(words)), PASSAGE):
            own = words[at : at + PASSAGE]
            parts.append(" ".join(own).encode("utf-8", "replace"))
            m = max(1, len(own))
            unique = len(set(own))
            same = sum(map(str.__eq__, own, own[1:]))
            extra.append((m / PASSAGE, unique / m, same / m, len(parts[-1]) / m / 10.0, max(map(len, own), default=0) / 20.0, len({w.lower() for w in own}) / m))
            n += 1
        counts.append(n)
    flat = np.frombuffer(b"".join(parts), dtype="u1")
    sizes = np.array([len(p) for p in parts])
    owner = np.repeat(np.arange(len(parts)), sizes)
    kind = _CLASS[flat]
    out = np.zeros((len(parts), WIDTH), dtype="f4")
    per = np.maximum(1, sizes)[:, None]
    out[:, :_CLASSES] = np.bincount(owner * _CLASSES + kind, minlength=len(parts) * _CLASSES).reshape(-1, _CLASSES) / per
    if len(flat) > 1:
        pair = kind[:-1] * _CLASSES + kind[1:]
        same = owner[:-1] == owner[1:]
        wide = _CLASSES * _CLASSES
        out[:, _CLASSES : _CLASSES + wide] = np.bincount((owner[:-1] * wide + pair)[same], minlength=len(parts) * wide).reshape(-1, wide) / per
    out[:, _CLASSES + _CLASSES * _CLASSES :][:, :6] = np.array(extra, dtype="f4").reshape(-1, 6)
    # words of up to 4 bytes, by a hash of their bytes
    space = np.flatnonzero(kind <= 1)
    if len(space) > 1:
        gap = np.diff(space)
        ok = (gap >= 2) & (gap <= 5) & (owner[space[:-1]] == owner[np.minimum(space[:-1] + 1, len(flat) - 1)])
        begin, length = space[:-1][ok] + 1, gap[ok] - 1
        code = np.zeros(len(begin), dtype="i8")
        for j in range(4):
            code = np.where(length > j, code * 131 + (flat[np.minimum(begin + j, len(flat) - 1)] | 0x20), code)
        np.add.at(out, (owner[begin], WIDTH - _SHORT + (code * 2654435761 >> 7) % _SHORT), 1.0 / PASSAGE)
    return out, np.array(counts)


@dataclass
class Network:
    """tanh encoder, gated attention (tanh times sigmoid) and a logistic score of the weighted passage."""

    mean: np.ndarray
    scale: np.ndarray
    params: dict

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        p = self.params
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["w"] + p["b"])
        v, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-np.clip(h @ p["g"], -30, 30)))
        starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
        a = (v * g) @ p["a"]
        e = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), counts))
        weight = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "v": v, "g": g, "weight": weight, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30))), "starts": starts}

    def score_long(self, text: str) -> float:
        """The score of one text whose passages are read block by block: the attention's sums are carried along."""
        p, top, total, z = self.params, -np.inf, 0.0, 0.0
        for words in word_blocks(text):
            x = np.clip((word_passages([words])[0] - self.mean) / self.scale, -8, 8)
            h = np.tanh(x @ p["w"] + p["b"])
            a = (np.tanh(h @ p["v"]) * (1 / (1 + np.exp(-np.clip(h @ p["g"], -30, 30))))) @ p["a"]
            new = max(top, float(a.max()))
            keep, e = np.exp(top - new), np.exp(a - new)
            top, total, z = new, total * keep + e.sum(), z * keep + e @ h
        return float(1 / (1 + np.exp(-np.clip((z / total) @ p["c"] + p["d"][0], -30, 30))))

    def gradients(self, f: dict, counts: np.ndarray, y: np.ndarray) -> dict:
        p, n = self.params, len(y)
        out = (f["score"] - y) / n
        dz = out[:, None] * p["c"][None]
        wide = np.repeat(dz, counts, axis=0)
        dh = f["weight"][:, None] * wide
        gain = (wide * f["h"]).sum(axis=1)
        da = f["weight"] * (gain - np.repeat(np.add.reduceat(f["weight"] * gain, f["starts"]), counts))
        dv = da[:, None] * p["a"][None] * f["g"] * (1 - f["v"] ** 2)
        dg = da[:, None] * p["a"][None] * f["v"] * f["g"] * (1 - f["g"])
        dh = dh + dv @ p["v"].T + dg @ p["g"].T
        pre = dh * (1 - f["h"] ** 2)
        return {"w": f["x"].T @ pre, "b": pre.sum(axis=0), "v": f["h"].T @ dv, "g": f["h"].T @ dg, "a": ((f["v"] * f["g"]) * da[:, None]).sum(axis=0), "c": f["z"].T @ out, "d": np.array([out.sum()])}


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gates: int = 12, epochs: int = 10, batch: int = 128, rate: float = 0.01, decay: float = 1e-3, seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    x, counts = (np.concatenate(bags), np.array([len(b) for b in bags])) if bags else (np.zeros((1, WIDTH), "f4"), np.array([1]))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    params = {"w": rng.standard_normal((WIDTH, hidden)) / np.sqrt(WIDTH), "b": np.zeros(hidden), "v": rng.standard_normal((hidden, gates)) * 0.3, "g": rng.standard_normal((hidden, gates)) * 0.3, "a": rng.standard_normal(gates) * 0.3, "c": rng.standard_normal(hidden) * 0.3, "d": np.zeros(1)}
    net = Network(mean, scale, params)
    if not bags:
        return net
    if len(set(labels.tolist())) == 1:
        params["c"][:], params["d"][0] = 0.0, 4.0 if labels[0] else -4.0
        return net
    moments, t = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in params.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            n = counts[own]
            f = net.forward(np.concatenate([bags[i] for i in own]), n)
            t += 1
            for k, g in net.gradients(f, n, labels[own]).items():
                g = g + decay * params[k] * (k in "wvgac")
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[k] -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = 4000, most_passages: int = 200_000) -> Network:
    """Learns from a bounded sample of labelled rows, whole texts: those that come first by a hash of their id, `most` at
    most and as many as have `most_passages` passages together (a row that alone has more is passed over).

    labels: doc_id, quality 0 or 1. A document with several labels counts with the smallest. The passages' features, at
    half precision (some 100 MB at most), come to the driver. Without any labelled row every score is 0.5; where all labels
    are equal, scores are near that label.
    """
    ready(spark)
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    order = unit(F.lit("quality"), F.col("doc_id").cast("string"))
    sample = known.withColumn("turn", order).orderBy("turn", "doc_id").limit(most)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "turn", "text")  # at most `most` rows of three numbers

    @lean
    def encode(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                bag, n = [], 0
                for words in word_blocks(batch.column(3)[row].as_py() or ""):
                    x = word_passages([words])[0]
                    n += len(x)
                    if n <= most_passages:
                        bag.append(x.astype("f2").tobytes())
                    else:
                        bag = []  # passed over, so nothing of it is kept
                part = batch.slice(row, 1)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), part.column(2), pa.array([n], pa.int64()), pa.array([b"".join(bag)], pa.binary())], names=["doc_id", "quality", "turn", "n", "bag"])

    bags = stash(spark, joined.mapInArrow(encode, "doc_id long, quality int, turn double, n long, bag binary").where(F.col("n") <= most_passages), "quality-bags")
    sizes = bags.groupBy("doc_id").agg(F.min("turn").alias("turn"), F.sum("n").alias("n")).orderBy("turn", "doc_id").limit(most).toArrow().to_pylist()
    taken, total = [], 0
    for r in sizes:
        total += r["n"]
        if total > most_passages:
            break
        taken.append(r["doc_id"])
    got = bags.where(F.col("doc_id").isin(taken)).select("doc_id", "quality", "bag").toArrow().to_pylist() if taken else []
    unstash(spark, bags)
    if not got:
        net = fit([], np.zeros(0))
        net.params["c"][:] = 0.0
        return net
    got.sort(key=lambda r: (r["doc_id"], r["bag"]))
    return fit([np.frombuffer(r["bag"], dtype="f2").astype("f4").reshape(-1, WIDTH) for r in got], np.array([r["quality"] for r in got], dtype="f8"))


def score_quality(spark: SparkSession, docs: DataFrame, net: Network, cut: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for every document, from its text alone; a null text is an empty one, which has a score too.

    A very long text is read whole, block by block, with the attention over all its passages. Scores at the cut are
    predicted 1. Repeated rows are scored each; an empty table gives none; other columns are not read.
    """
    ready(spark)
    held = spark.sparkContext.broadcast(net)

    @lean
    def run(batches):
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                first = batch.column(1)[begin].as_py() or ""
                if len(first) > SLICE:
                    score = np.array([held.value.score_long(first)])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, 1), pa.array(score, pa.float64()), pa.array((score >= cut).astype("i4"))], names=["doc_id", "score", "predicted"])
                    begin += 1
                    continue
                texts, chars = [], 0
                while begin + len(texts) < batch.num_rows and chars < SLICE:
                    text = batch.column(1)[begin + len(texts)].as_py() or ""
                    if len(text) > SLICE:
                        break
                    texts.append(text)
                    chars += len(text)
                x, counts = passages(texts)
                score = held.value.forward(x, counts)["score"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array(score, pa.float64()), pa.array((score >= cut).astype("i4"))], names=["doc_id", "score", "predicted"])
                begin += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`; the network learns from labels whose fold of 4 is not 2."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = train(spark, docs, labels.where(fold(4) != 2))
    held_out = F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out")
    return score_quality(spark, docs, net).select("doc_id", held_out, "score", "predicted")
