"""Language identification: known words first, then ever shorter character n-grams of the unknown ones."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmere.llm.mixing import unit
from quillmere.llm.shared import lean, ready, stash, unstash

_WORD = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s")
ORDERS = (5, 4, 3, 2, 1)
_SMOOTH = 0.1


@dataclass
class Model:
    """Rows are log posteriors over langs under a flat prior. words and grams give the row of each."""

    langs: list
    words: dict
    word_rows: np.ndarray
    grams: dict
    gram_rows: np.ndarray


def _posteriors(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    logs = np.log(counts + _SMOOTH) - np.log(totals + _SMOOTH * max(1, len(counts)))
    return (logs - np.logaddexp.reduce(logs, axis=1, keepdims=True)).astype("f4")


class _Ids(dict):
    def __missing__(self, key):
        at = self[key] = len(self)
        return at


def count_grams(words: list[str], counts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The n-grams of the words between < and >, and how often each language has them."""
    grams, flat, lengths = _Ids(), [], []
    for word in words:
        padded, before = f"<{word}>", len(flat)
        for n in ORDERS:
            flat += [padded[k : k + n] for k in range(len(padded) - n + 1)]
        lengths.append(len(flat) - before)
    owner, members = np.fromiter(map(grams.__getitem__, flat), dtype="i4", count=len(flat)), np.repeat(np.arange(len(words)), lengths)
    return list(grams), np.stack([np.bincount(owner, weights=counts[members, j], minlength=len(grams)) for j in range(counts.shape[1])], axis=1) if grams else np.zeros((0, counts.shape[1]))


def assemble(langs: list, words: list[str], counts: np.ndarray, grams: list[str], by_gram: np.ndarray) -> Model:
    size = np.array([len(g) for g in grams], dtype="i4")
    rows = np.zeros((len(grams), len(langs)), dtype="f4")
    for n in ORDERS:
        own = size == n
        if own.any():
            rows[own] = _posteriors(by_gram[own], by_gram[own].sum(axis=0))
    word_rows = _posteriors(counts, counts.sum(axis=0)) if len(words) else np.zeros((0, len(langs)), "f4")
    return Model(langs, {w: i for i, w in enumerate(words)}, word_rows, {g: i for i, g in enumerate(grams)}, rows)


def build(langs: list, table: list[tuple[str, list]]) -> Model:
    """table: words with their counts by language."""
    words, counts = [w for w, _ in table], np.array([c for _, c in table], dtype="f8").reshape(len(table), len(langs))
    return assemble(langs, words, counts, *count_grams(words, counts))


class _Rows(dict):
    """The row of any word; an unknown word gets one when first seen, which `settle` fills for all new words at once."""

    def __init__(self, model: Model, room: int):
        super().__init__(model.words)
        self.model, self.base, self.room = model, len(model.words), room
        self.rows = np.zeros((self.base + room, max(1, len(model.langs))), "f4")
        self.rows[: self.base, : len(model.langs)] = model.word_rows
        self.next, self.new = self.base, []

    def __missing__(self, word: str) -> int:
        at = self[word] = self.next
        self.next += 1
        self.new.append(word)
        return at

    def settle(self) -> None:
        """Rows of the new words: the mean over their longest known n-grams; a word without any says nothing."""
        if not self.new:
            return
        if self.next > len(self.rows):
            self.rows = np.concatenate([self.rows[: self.base + self.room], np.zeros((self.next - self.base - self.room, self.rows.shape[1]), "f4")])
        get, found, counts = self.model.grams.get, [], []
        for word in self.new:
            padded, before = f"<{word}>", len(found)
            for n in ORDERS:
                found += [i for k in range(len(padded) - n + 1) if (i := get(padded[k : k + n])) is not None]
                if len(found) > before:
                    break
            counts.append(len(found) - before)
        counts = np.array(counts)
        out = np.full((len(self.new), self.rows.shape[1]), -np.log(self.rows.shape[1]), "f4")
        known = counts > 0
        if known.any():
            begin = (np.cumsum(counts) - counts)[known]
            out[known] = np.add.reduceat(self.model.gram_rows[np.array(found)], begin, axis=0) / counts[known][:, None]
        self.rows[self.next - len(self.new) : self.next] = out
        self.new = []

    def tidy(self) -> None:
        """Forgets unknown words when there is no more room for them."""
        if self.next - self.base > self.room:
            self.clear()
            self.update(self.model.words)
            self.next, self.rows = self.base, self.rows[: self.base + self.room]


def slices(text: str, size: int = 1 << 20):
    """The text in parts of about `size` characters that end at white space, so that no word is cut."""
    at = 0
    while len(text) - at > size:
        m = _SPACE.search(text, at + size)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


class Identifier:
    """Languages of texts. The score is the posterior over the languages when the text's words, if they are more than
    `evidence`, count as that many: words of a text are not independent, and the full product would always say 1."""

    def __init__(self, model: Model, room: int = 200_000, evidence: float = 40.0):
        self.model, self.rows, self.evidence = model, _Rows(model, room), evidence

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.many([text])[0]

    def many(self, texts: list) -> list[tuple[str, float]]:
        out: list = []
        part, chars = [], 0
        for text in texts:
            part.append(text)
            chars += len(text or "")
            if chars >= 1 << 20:
                out += self._some(part)
                part, chars = [], 0
        return out + self._some(part)

    def _some(self, texts: list) -> list[tuple[str, float]]:
        index, width = self.rows.__getitem__, max(1, len(self.model.langs))
        total, letters, sums = np.zeros(len(texts)), np.zeros(len(texts), dtype=bool), np.zeros((len(texts), width))
        owners, ids = [], []

        def add() -> None:
            self.rows.settle()
            if ids:
                sizes = np.array([len(x) for x in ids])
                sums[owners] += np.add.reduceat(self.rows.rows[np.concatenate(ids)].astype("f8"), np.cumsum(sizes) - sizes, axis=0)
            owners.clear()
            ids.clear()
            self.rows.tidy()

        for i, text in enumerate(texts):
            if not text or not self.model.langs:
                continue
            for own in slices(text):
                words = _WORD.findall(own.lower())
                if words:
                    if owners and owners[-1] == i:  # one part of a document at a time
                        add()
                    letters[i] = letters[i] or any(c.isalpha() for w in words for c in w)
                    total[i] += len(words)
                    owners.append(i)
                    ids.append(np.fromiter(map(index, words), dtype="i8", count=len(words)))
        add()
        out = []
        for i in range(len(texts)):
            if not letters[i]:
                out.append(("und", 0.0))
                continue
            logs = sums[i] * min(1.0, self.evidence / total[i])
            odds = np.exp(logs - logs.max())
            best = int(odds.argmax())
            out.append((self.model.langs[best], float(odds[best] / odds.sum())))
        return out


def train(spark: SparkSession, labelled: DataFrame, per_lang: int = 3000, vocabulary: int | None = None, max_langs: int = 500, most_cells: int = 250_000_000) -> Model:
    """Learns from text and lang of a bounded sample: about per_lang documents of each language, dealt by a hash of doc_id.

    Every word of the sample is learned, and every n-gram of every word. The driver receives these words with their counts
    and nothing else. With `vocabulary` only so many words are kept, by their best rank in any language, so that languages
    share it evenly. More than max_langs languages, or words times languages over most_cells, are an error: nothing is left
    out in silence.
    """
    ready(spark)
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = usable.groupBy("lang").count().limit(max_langs + 1).collect()
    if not sizes:
        return build([], [])
    if len(sizes) > max_langs:
        raise ValueError(f"the labelled documents have over {max_langs} languages; max_langs must be raised to learn them all")
    langs = sorted(r["lang"] for r in sizes)
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, per_lang / r["count"])))])
    sample = usable.where(unit(F.lit("langid"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))

    @lean
    def count(batches):
        for batch in batches:
            seen: dict = {}
            for text, lang in zip(batch.column(0), batch.column(1)):
                seen.setdefault(lang.as_py(), Counter()).update(_WORD.findall(text.as_py().lower()))
            rows = [(lang, w, n) for lang, words in seen.items() for w, n in words.items()]
            if rows:
                a, b, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64())], names=["lang", "word", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, word string, n long")
    cells = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"c{j}") for j, lang in enumerate(langs)]
    each = stash(spark, counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    if vocabulary is None:
        top = each.groupBy("word").agg(*cells)
    else:
        # ranks come from the numbers of words by count, a small table as the sample is bounded; equal counts are spread over their ranks by a hash
        higher = Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranks = each.groupBy("lang", "n").count().select("lang", "n", F.col("count").alias("equal"), (F.sum("count").over(higher) - F.col("count")).alias("above"))
        rank = F.col("above") + F.col("equal") * F.pmod(F.xxhash64("word"), F.lit(1 << 20)) / (1 << 20)
        ranked = each.join(F.broadcast(ranks), ["lang", "n"])
        top = ranked.groupBy("word").agg(F.sum("n").alias("n"), F.min(rank).alias("rank"), *cells).orderBy("rank", F.desc("n"), "word").limit(vocabulary).select("word", *[f"c{j}" for j in range(len(langs))])
    top = stash(spark, top, "langid-counts")
    if top.count() * len(langs) > most_cells:
        raise ValueError("the sample holds more words than most_cells allows; lower per_lang")

    def matrix(table) -> np.ndarray:
        return np.stack([table.column(j + 1).to_numpy(zero_copy_only=False) for j in range(len(langs))], axis=1).astype("f8")

    @lean
    def split(batches):
        for batch in batches:
            grams, sums = count_grams(batch.column(0).to_pylist(), matrix(batch))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), *[pa.array(sums[:, j], pa.float64()) for j in range(len(langs))]], names=["gram", *[f"c{j}" for j in range(len(langs))]])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the table is one small file; its words are work for all
    spread = top.repartition(parts, "word").mapInArrow(split, "gram string, " + ", ".join(f"c{j} double" for j in range(len(langs))))
    grams = spread.groupBy("gram").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(len(langs))]).toArrow()
    table = top.toArrow()
    unstash(spark, each)
    unstash(spark, top)
    return assemble(langs, table.column(0).to_pylist(), matrix(table), grams.column(0).to_pylist(), matrix(grams))


def identify(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every document, from its text alone.

    A null text, or one without a letter, is `und` with score 0; without any labelled row every text is. Ties between
    languages go to the first by name. A very long text is read whole, in slices. Repeated rows are judged each; an empty
    table gives none; other columns are not read.
    """
    ready(spark)
    held = spark.sparkContext.broadcast(model)

    @lean
    def run(batches):
        judge = Identifier(held.value)
        for batch in batches:
            got = judge.many(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(spark: SparkSession, docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, all columns as they are, without those that are `und` or score below `least`."""
    ready(spark)
    held, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    @lean
    def run(batches):
        judge = Identifier(held.value)
        for batch in batches:
            got = judge.many(batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(folds: int):
    return F.crc32(F.col("doc_id").cast("string")) % folds


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`; the model learns from those whose fold of 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(spark, docs.where(fold(3) != 1))
    held_out = F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out")
    return identify(spark, docs, model).select("doc_id", held_out, "lang_pred", "score")
