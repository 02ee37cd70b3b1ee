"""Language identification: known words by their log frequency in each language, others by ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.token_files import pieces

#: Rows of a language that the classifier is fitted on, about (chosen by hash, evenly over the table); fewer where there are fewer. All languages count, and all words and
#: n-grams of these rows, so the sample bounds what is broadcast.
SAMPLE_PER_LANGUAGE = 1000
#: Orders of n-grams, longest first. Words are set between two marks.
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"

WORD = re.compile(r"[^\W\d_]+")
SMOOTH = 0.5
#: Entries of a worker's cache of words.
KEPT_WORDS = 400_000


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)] if n > 1 else list(word)


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for word in words for c in word)


class Model:
    def __init__(self, languages: list[str], words: tuple[list[str], np.ndarray], tables: tuple[list[str], np.ndarray]):
        """words and tables: items, and their counts by language. A table's n-grams have their order as length."""
        self.languages = languages
        self.words = {w: k for k, w in enumerate(words[0])}
        self.grams = {g: k for k, g in enumerate(tables[0])}
        c = words[1].reshape(len(self.words), -1)
        self.word_logs = np.log((c + SMOOTH) / (np.maximum(c.sum(0), 1) + SMOOTH * (len(c) + 1))).astype(np.float32) if len(c) else c
        order = np.array([len(g) for g in tables[0]], np.int64)
        self.gram_logs = tables[1].reshape(len(order), -1).astype(np.float32)
        for n in np.unique(order):
            c = tables[1][order == n]
            self.gram_logs[order == n] = np.log((c + SMOOTH) / (c.sum(0) + SMOOTH * (len(c) + 1)))
        self.none = np.zeros(len(languages))

    def of_word(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return self.word_logs[known]
        for n in ORDERS:
            found = [x for g in grams(word, n) if (x := self.grams.get(g)) is not None]
            if found:
                return self.gram_logs[found].mean(0)
        return self.none


class Rows(dict):
    """word -> row of a table of scores, worked out when first met."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.table, self.n = model, np.zeros((1024, len(model.languages))), 0

    def __missing__(self, word: str) -> int:
        if self.n == len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self.table[self.n] = self.model.of_word(word)
        self[word] = self.n
        self.n += 1
        return self[word]

    def trim(self) -> None:
        if self.n > KEPT_WORDS:
            self.clear()
            self.n = 0


def fit(df: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """From text and lang of df(doc_id, text, lang) where both are there; None without such rows. The sample is evenly spread by a hash."""
    labelled = df.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").count().collect()  # one row a language
    if not sizes:
        return None
    languages = sorted(r.lang for r in sizes)
    share = {r.lang: min(1.0, per_language / r["count"]) for r in sizes}
    spread = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000))
    chosen = F.lit(False)
    for lang, part in share.items():
        chosen = chosen | ((F.col("lang") == lang) & (spread < int(1_000_000 * part)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            names = ["lang", "is_word", "item", "n"]
            columns = list(zip(*((*k, n) for k, n in found.items())))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.string(), pa.int64()))], names=names)

        for batch in batches:
            for text, lang in zip(common.texts(batch.column("text")), batch.column("lang").to_pylist()):
                for word, n in Counter(WORD.findall(text.lower())).items():
                    found[lang, True, word] += n
                    for order in ORDERS:
                        for g in grams(word, order):
                            found[lang, False, g] += n
                if len(found) > 400_000:
                    yield out()
                    found.clear()
        if found:
            yield out()

    counts = labelled.filter(chosen).select("text", "lang").mapInArrow(count, "lang string, is_word boolean, item string, n long")
    index = {lang: k for k, lang in enumerate(languages)}
    each = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{index[lang]}") for lang in languages]
    sums, path = common.written(counts.groupBy("is_word", "item").agg(F.sum("n").alias("n"), *each), "language")
    tables = []
    for is_word in (True, False):
        rows = sums.filter(F.col("is_word") == is_word).drop("is_word", "n").toPandas().sort_values("item")
        tables.append((rows["item"].tolist(), rows.drop(columns="item").to_numpy(np.float64)))
    common.drop(df.sparkSession, path)
    return Model(languages, *tables)


def predict(df: DataFrame, model: Model | None) -> DataFrame:
    """df(doc_id, text, ...) with lang_pred and score (the posterior of lang_pred with even priors, 0 to 1).

    Repeated rows get the same; an empty table gives no rows. A text that is null or has no letters gets `und` and score 0, and so does every text where nothing could be learned. Ties go to the
    language first in order. Whole texts count; other columns stay, but ones named lang_pred or score are replaced.
    """
    spark = df.sparkSession
    df = df.drop("lang_pred", "score")
    common.small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    kept: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        rows_of = kept.setdefault("rows", Rows(model)) if model else None
        for batch in batches:
            for rows, found in pieces(batch) if batch.num_rows else ():
                said, score = [], []
                for text in found:
                    words = WORD.findall(text.lower())
                    if not model or not has_letter(words):
                        said.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    at = list(map(rows_of.__getitem__, words))
                    total = rows_of.table[at].sum(0)
                    total -= total.max()
                    best = int(total.argmax())
                    said.append(model.languages[best])
                    score.append(float(1 / np.exp(total).sum()))
                    rows_of.trim()
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(said, pa.string()), pa.array(score, pa.float64())], names=[*rows.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, common.schema_with(df, "lang_pred string, score double"))


def held_out(doc_id: Column) -> Column:
    return common.crc_bucket(doc_id, 3) == 1


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
