"""Label rows and the bounded sample of labelled documents that a model is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigrane.llm.state import cut


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of an id written as text, mod a number; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def training(labels: DataFrame, label: str, mod: int, held_out: int, id_col: str = "doc_id") -> DataFrame:
    """(_lid, _label): one row for each labelled id outside the held-out part.

    Rows with a null id or label are left out; of several labels of one id the largest counts."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (remainder(id_col, mod) != held_out))
    return rows.groupBy(F.col(id_col).alias("_lid")).agg(F.max(F.col(label).cast("int")).alias("_label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, bound: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, _label, _text) of about ``bound`` labelled documents, stored; all of them where there are no more.

    Labelled ids that have a document are counted and chosen by a hash of the id, so
    the choice is the same in every run. Only ids are shuffled for that; the chosen
    ids, about ``bound``, are broadcast, and their texts alone leave the scan. An id with several documents
    gives one, that with the least hash of its text."""
    train = training(labels, label, mod, held_out)
    known = cut(train.join(docs.select(F.col(id_col).alias("_lid")).distinct(), "_lid", "left_semi"))
    share = min(1.0, bound / max(1, known.count()))
    chosen = cut(known.where(F.pmod(F.xxhash64("_lid", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))))
    texts = docs.select(F.col(id_col).alias("_lid"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_lid")
    one = texts.groupBy("_lid", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("t"))).alias("least"))
    return cut(one.select(F.col("_lid").alias("_id"), "_label", F.col("least.t").alias("_text")))
