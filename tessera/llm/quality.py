"""Quality rules: a base of counts, and bands of n-gram perplexity for each language.

The language model is modified Kneser-Ney over characters (80 symbols: each letter a-z and each ASCII mark has its own; order 4), so that the n-grams of
a language are at most 80**4 however large the corpus is. Spark counts them over all documents. A model is a sorted array of the seen n-grams with
their logarithms, and the tables of the lower orders; a worker spreads it over a table of all seen contexts once. Documents whose perplexity is outside the band
of their language (median and quartiles over all documents that pass the base) are rejected: above it is noise, below it repetition. There are
two bands: by character, and by word, as marks that many words carry are cheap by character but make each word dear.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, textbytes
from tessera.llm.token_files import pieces

SYMBOLS, ORDER = 80, 4
#: Languages that have a model of their own, the most frequent ones; documents of all others share one more.
MAX_LANGUAGES = 8
OTHER = ""
#: Half-widths of the bands above and below the median, by character and by word, in units of the standard deviation that the quartiles imply; set
#: where labelled low documents of the 0.1 table that pass the base leave the clean ones.
ABOVE, BELOW, WORD_ABOVE, WORD_BELOW = 3.5, 5.0, 4.0, 3.0
#: Characters that are given to one language together; texts that are not much longer than SHORT get a wider band.
BLOCK, SHORT = 48, 300
#: n-grams that are gathered before they are added up.
GATHER = 1 << 21

MARKS = np.zeros(256, bool)
MARKS[[ord(c) for c in "#*$%&|<>"]] = True

_class: list[np.ndarray] = []


def symbol_table() -> np.ndarray:
    """The symbol of each code point: 1-26 a-z in either case, 27-44 other letters, 45 digits, 46 white space, 47-78 ASCII marks, 79 the rest. 0 stands before a text."""
    if not _class:
        table = np.full(0x110000, 79, np.uint8)
        marks = [c for c in range(33, 127) if not chr(c).isalnum()]
        for c in range(0x110000):
            ch = chr(c).lower()[0]
            if "a" <= ch <= "z":
                table[c] = ord(ch) - 96
            elif ch.isalpha():
                table[c] = 27 + ord(ch) % 18
            elif ch.isdigit():
                table[c] = 45
            elif ch.isspace():
                table[c] = 46
        table[marks] = 47 + np.arange(len(marks))
        _class.append(table)
    return _class[0]


def ngram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character, in base SYMBOLS, and how many characters each text has."""
    pad = "\0" * (ORDER - 1)
    points = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.array([len(t) for t in texts])
    s = symbol_table()[points].astype(np.int32)
    real = np.ones(len(s), bool)
    starts = np.cumsum(counts + ORDER - 1) - counts
    for k in range(1, ORDER):
        real[starts - k] = False
    s[~real] = 0
    code = s.copy()
    for k in range(1, ORDER):
        code[k:] += s[:-k] * SYMBOLS**k
    return code[real], counts


@dataclass
class NGramModel:
    codes: np.ndarray  # sorted
    logs: np.ndarray  # log10 of p(last | first three) of each
    rest: np.ndarray  # log10 of the weight that a context leaves to the lower orders
    lower: np.ndarray  # log10 of p(last | two before), for all trigrams

    def table(self) -> np.ndarray:
        """log10 p of every n-gram."""
        out = (self.rest[:, None] + np.tile(self.lower.reshape(-1, SYMBOLS), (SYMBOLS, 1))).astype(np.float32).ravel()
        out[self.codes] = self.logs
        return out

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The same, for the contexts that were seen only: the row of each context of three, and log10 p of each symbol in each row. Others have the row of their last two."""
        lower = self.lower.reshape(-1, SYMBOLS)
        context, index = np.unique(self.codes // SYMBOLS, return_inverse=True)
        row = np.arange(SYMBOLS ** (ORDER - 1), dtype=np.int32) % len(lower)
        row[context] = len(lower) + np.arange(len(context))
        seen = self.rest[context][:, None] + lower[context % len(lower)]
        seen[index, self.codes % SYMBOLS] = self.logs
        return row, np.concatenate([lower, seen]).ravel()


def discounts(counts: np.ndarray) -> np.ndarray:
    """D(1), D(2), D(3 or more) of modified Kneser-Ney; usual values where counts of counts are missing."""
    n1, n2, n3, n4 = (max(int((counts == k).sum()), 0) for k in (1, 2, 3, 4))
    if not n1 or not n2 or not n3 or not n4:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(float(np.clip(d, 0.05, k - 0.05)) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))])


def smoothed(codes: np.ndarray, counts: np.ndarray, lower: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """p of each seen n-gram, and the weight left to lower orders in each context; lower: p by all n-grams without their first symbol."""
    d = discounts(counts)[np.minimum(counts, 3)]
    context = codes // SYMBOLS
    total = np.bincount(context, counts, contexts)
    left = np.bincount(context, d, contexts)
    weight = np.where(total > 0, left / np.maximum(total, 1), 1.0)
    return (counts - d) / total[context] + weight[context] * lower[codes % len(lower)], weight


def kneser_ney(codes: np.ndarray, counts: np.ndarray) -> NGramModel:
    """From the counts of all 4-grams; lower orders use the number of distinct symbols before."""
    order = np.argsort(codes)
    codes, counts = codes[order].astype(np.int64), counts[order].astype(np.int64)
    levels = [(codes, counts)]
    for n in range(ORDER - 1, 0, -1):
        before = np.bincount(levels[-1][0] % SYMBOLS**n, minlength=SYMBOLS**n)
        seen = np.flatnonzero(before)
        levels.append((seen, before[seen]))
    lower = np.full(1, 1 / SYMBOLS)
    for n in range(1, ORDER):
        seen, number = levels[ORDER - n]
        p, weight = smoothed(seen, number, lower, SYMBOLS ** (n - 1))
        full = np.repeat(weight, SYMBOLS) * lower[np.arange(SYMBOLS**n) % len(lower)]
        full[seen] = p
        lower = full
    p, weight = smoothed(codes, counts, lower, SYMBOLS ** (ORDER - 1))
    return NGramModel(codes.astype(np.int32), np.log10(p).astype(np.float32), np.log10(weight).astype(np.float32), np.log10(lower).astype(np.float32))


def base_counts(texts: list[str]) -> dict[str, np.ndarray]:
    """Of each whole text: words, code points in words, symbols, lines with a word that equal an earlier line, and words in 5-word windows found twice or more."""
    t = textbytes.Texts(texts)
    start, end, counts = t.words()
    sizes = t.end - t.start + 1
    in_word = ~textbytes.SPACE[t.data]
    letters = in_word & ((t.data & 0xC0) != 0x80)
    hashes = textbytes.span_hashes(t.data, start, end)
    five, n = textbytes.windows(hashes, counts, 5)
    twice = textbytes.repeated(textbytes.owned(five, n))
    cover = np.zeros(len(hashes) + 1, np.int32)
    first = np.repeat(np.cumsum(counts) - counts, n) + (np.arange(len(five)) - np.repeat(np.cumsum(n) - n, n))
    at = first[twice]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + 5, -1)
    l_start, l_end, l_text = t.lines()
    words_before = np.concatenate([[0], np.cumsum(in_word)])
    some = words_before[l_end] > words_before[l_start]
    l_start, l_end, l_text = l_start[some], l_end[some], l_text[some]
    l_counts = np.bincount(l_text, minlength=t.n)
    keys = textbytes.owned(textbytes.span_hashes(t.data, l_start, l_end), l_counts)
    distinct = np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    distinct[order] = np.concatenate([[True], keys[order][1:] != keys[order][:-1]]) if len(keys) else []
    return {
        "n_words": counts,
        "word_chars": textbytes.sums(letters, sizes),
        "n_symbols": textbytes.sums(MARKS[t.data], sizes),
        "n_dup_lines": textbytes.sums(~distinct, l_counts),
        "n_repeat_words": textbytes.sums(np.cumsum(cover[:-1]) > 0, counts),
    }


def block_logs(texts: list[str], tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of log10 p over each text, each block of BLOCK characters by the language that explains it best, and the characters of each text.

    So a passage in another language than the document's is no noise.
    """
    codes, counts = ngram_codes(texts)
    blocks = -(-counts // BLOCK)
    first = np.repeat(np.cumsum(counts) - counts, blocks) + BLOCK * (np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    best = np.full(len(first), -np.inf)
    context, symbol = np.divmod(codes, SYMBOLS)
    for row, table in tables if len(first) else ():
        np.maximum(best, np.add.reduceat(table[row[context] * SYMBOLS + symbol], first, dtype=np.float64), out=best)
    return textbytes.sums(best, blocks), counts


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_ngrams(df: DataFrame) -> DataFrame:
    """language, code, n over all texts of df(text, language)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # sorted codes, counts
        waiting: dict[str, list[str]] = {}
        size: dict[str, int] = {}

        def add(language: str) -> None:
            codes, _ = ngram_codes(waiting.pop(language))
            some, n = np.unique(codes, return_counts=True)
            if language in total:
                some, back = np.unique(np.concatenate([total[language][0], some]), return_inverse=True)
                n = np.bincount(back, np.concatenate([total[language][1], n]), len(some)).astype(np.int64)
            total[language] = some, n
            size[language] = 0

        for batch in batches:
            for language, text in zip(batch.column("language").to_pylist(), common.texts(batch.column("text"))):
                waiting.setdefault(language, []).append(text)
                size[language] = size.get(language, 0) + len(text)
                if size[language] > GATHER:
                    add(language)
        for language in list(waiting):
            add(language)
        for language, (seen, n) in total.items():
            for k in range(0, len(seen), 1 << 16):
                some = seen[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[k : k + (1 << 16)])], names=["language", "code", "n"])

    counted = df.select("text", "language").mapInArrow(run, "language string, code int, n long")
    return counted.groupBy("language", "code").agg(F.sum("n").alias("n"))


def with_language(df: DataFrame, languages: list[str]) -> DataFrame:
    return df.withColumn("language", F.when(F.col("lang").isin(languages), F.col("lang")).otherwise(F.lit(OTHER)) if languages else F.lit(OTHER))


def fit(df: DataFrame) -> dict[str, NGramModel]:
    """A model for each of the most frequent languages of df(text, lang), and one for the documents of all others (or of none)."""
    common.small_batches(df.sparkSession)
    sizes = df.filter("lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    languages = sorted(r.lang for r in sizes)
    counted = count_ngrams(with_language(df.select("text", "lang"), languages)).toArrow()
    of = counted.column("language").to_numpy(zero_copy_only=False)
    code, n = counted.column("code").to_numpy(), counted.column("n").to_numpy()
    return {k: kneser_ney(code[of == k], n[of == k]) if (of == k).any() else kneser_ney(np.zeros(0, np.int64), np.zeros(0, np.int64)) for k in [*languages, OTHER]}


def scored(df: DataFrame, models: dict[str, NGramModel]) -> DataFrame:
    """doc_id, language, the counts, base_failed and perplexity (log10, a character; null without characters) of each row of df(doc_id, text, lang)."""
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(models)
    kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found in pieces(batch, at_once=2_000_000) if batch.num_rows else ():
                base = base_counts(found)
                if not kept:
                    kept.update({k: m.rows() for k, m in held.value.items()})
                total, counts = block_logs(found, list(kept.values()))
                mean = -total / np.maximum(counts, 1)
                failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("language"), *(pa.array(base[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(mean, mask=counts == 0), pa.array(counts.astype(np.int64))],
                    names=["doc_id", "language", *COUNTS, "base_failed", "perplexity", "n_chars"],
                )

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return with_language(df.select("doc_id", "text", "lang"), sorted(k for k in models if k != OTHER)).select("doc_id", "text", "language").mapInArrow(run, f"doc_id long, language string, {counts}, base_failed boolean, perplexity double, n_chars long")


def judged(df: DataFrame, above: float = ABOVE, below: float = BELOW, word_above: float = WORD_ABOVE, word_below: float = WORD_BELOW) -> DataFrame:
    """doc_id, the counts, base_failed, perplexity and kept for each row of df(doc_id, text, lang); extra columns are ignored.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated windows. Of the others those are kept whose perplexity by character and by
    word lies in the bands of their language. A null or empty text fails the base. Documents without a language (null, or a rare one) are judged
    by a model of their own. Repeated rows get the same verdict; an empty table gives no rows.
    """
    scores, _ = common.written(scored(df, fit(df)), "quality")
    scores = scores.withColumn("by_word", F.when(F.col("n_words") > 0, F.col("perplexity") * F.col("n_chars") / F.col("n_words")))
    measures = {"perplexity": (above, below), "by_word": (word_above, word_below)}
    bands = scores.filter("NOT base_failed").groupBy("language").agg(*(F.percentile_approx(c, [0.25, 0.5, 0.75], 10000).alias(f"{c}_q") for c in measures))
    verdict = ~F.col("base_failed")
    for c, (up, down) in measures.items():
        q = F.col(f"{c}_q")
        away = (F.col(c) - q[1]) / F.greatest((q[2] - q[0]) / 1.349, F.lit(1e-6)) * F.sqrt(F.col("n_chars") / (F.col("n_chars") + SHORT))
        verdict &= F.coalesce(away.between(-down, up), F.lit(False))
    return scores.join(F.broadcast(bands), "language", "left").select("doc_id", *COUNTS, "base_failed", verdict.alias("kept"), "perplexity")  # at most MAX_LANGUAGES + 1 bands


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
