"""The corpus pipeline: toxic documents go, one document of each group of near copies stays, repeated passages are cut, the rest is mixed to target
weights and encoded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, common, minhash, mixing, substrings, toxicity

#: Parts of all tokens that the mix aims at. A document's rate is 1 at least: mixing repeats documents, it drops none.
WEIGHTS = {"clean": 0.92, "low": 0.08}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return common.table(spark, sf_dir, name)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field scores below 0.5. Empty and null texts stay; repeated rows fare alike, extra columns stay, an empty table stays empty."""
    field = toxicity.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    keyed = docs.select(F.struct("*").alias("_row"), F.col("text").alias("text"))
    return toxicity.score(keyed, field, spans=False).filter("score < 0.5").select("_row.*")


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (shingles of 5 words, 0.8): the one with the least doc_id; of rows that share doc_id and text one stays. Rows without
    a doc_id take part under a number made from their text, above all others. Empty and null texts have no copies but their own rows."""
    own = F.coalesce("doc_id", F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 62)))
    keyed = docs.select(F.struct("*").alias("_row"), own.alias("_key"), F.col("text").alias("_text"))
    found = minhash.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), F.col("_text").alias("text")), size=5, percent=80)
    kept, _ = common.written(found.filter("kept").select(F.col("doc_id").alias("_key")).distinct(), "kept")
    return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key", "_text"]).select("_row.*")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without spans of its bytes, in order, and without the characters that their borders go through."""
    data, at, kept = text.encode("utf-8"), 0, []
    for start, end in [*spans, (None, None)]:
        kept.append(data[at:start].decode("utf-8", "ignore"))  # each run of a valid text is valid but for its ends
        at = end
    return "".join(kept)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; n_chars follows. A character that a cut goes through goes too. All rows stay."""
    found = substrings.covered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("_text").to_pylist(), batch.column("_spans").to_pylist()
            left = [without(t, substrings.joined_up([(x["a"], x["b"]) for x in s])) if s else t for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(left, pa.string())], names=["_row", "_text"])

    cut = found.mapInArrow(run, common.schema_with(found.select("_row"), "_text string"))
    new = {"text": F.col("_text"), "n_chars": F.char_length(F.coalesce("_text", F.lit(""))).cast("long")}
    return cut.select(*((new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: the whole part, and once more with the fraction as its chance (by a hash of doc_id and text, so always alike, and alike for
    repeated rows). Null and empty texts have the domains' shares; extra columns stay, an empty table stays empty."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", mixing.label_domain().alias("domain"))
    model = mixing.fit(docs, labels, list(WEIGHTS))
    goal = mixing.np.array(list(WEIGHTS.values()))
    keyed = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    small, _ = common.written(mixing.posteriors(keyed.select("text"), model).drop("text"), "posteriors")
    pushes = mixing.solve(small, goal / goal.sum(), least=1.0)
    rated = mixing.posteriors(keyed, model, pushes, least=1.0)
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(1 << 30)) / (1 << 30)
    copies = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return rated.select("_row", F.explode(F.sequence(F.lit(1), copies))).select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each row, repeated rows too; no ids for a null or empty text; extra columns are left out, an empty table stays empty."""
    return bpe.encode(docs.select("doc_id", "text")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", remove_toxic),
    ("near_dedup", remove_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express the field, the minima and the classifier; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
