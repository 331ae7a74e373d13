"""Benchmark decontamination by a prefix-filtered join of words with item windows.

Built-in functions only. Every 10-word window of a benchmark item (a whole item
if it is shorter) is a set of placed words that a document must contain. Words
are ordered by their count over all documents, and a window is joined only by
its rarest word: any occurrence of the window holds that word at the window's
own offset, so no occurrence is missed and frequent words never meet. A
candidate must leave room for the window before and after the place (length and
positional bounds), and is then verified word by word on the item-sized slice.

The windows are the stated query set. They are broadcast in blocks of at most
``BLOCK_ROWS`` windows, after counting them; a larger benchmark takes more
passes, never a larger broadcast. Documents are exploded inside one generated
stage, only hits and one row a document are shuffled, and hits are combined by
document, so a passage that many documents share burdens none.

Edge cases: a null text has no words; an item without words has no window; an
empty benchmark leaves every document clean. Documents are told apart by id and
text together, null ids included, so repeated rows give repeated results and
rows of one id with different texts stay apart. Texts of any length are read whole.
Of equally rare words the first in the window is joined. Only id and text columns
are read, whatever the others are called; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigrane.llm.state import cut

WINDOW = 10
BLOCK_ROWS = 200_000
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends each document's words; no word has a space.
END = " "


def words(text: Column) -> Column:
    """Words in order, A-Z lower-cased."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BETWEEN), "")


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(item, win): each distinct window of each item as an array of words."""
    d = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return d.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("win")).distinct()


def _counts(texts: DataFrame, wins: DataFrame) -> DataFrame:
    """(word, n): how often each word of the windows occurs in all documents."""
    vocabulary = cut(wins.select(F.explode("win").alias("word")).distinct())
    small = vocabulary.count() <= WINDOW * BLOCK_ROWS
    every = texts.select(F.explode_outer(words(F.col("_t"))).alias("word"))  # outer: no filter that splits the text a second time
    found = every.join(F.broadcast(vocabulary) if small else vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    return vocabulary.join(found, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def prefixes(texts: DataFrame, wins: DataFrame) -> DataFrame:
    """(item, win, prefix, off): the rarest word of each window and its first offset in it."""
    placed = wins.select("item", "win", F.posexplode("win").alias("off", "word")).join(_counts(texts, wins), "word")
    rare = placed.groupBy("item", "win").agg(F.min(F.struct("n", "word", "off")).alias("least"))
    return rare.select("item", "win", F.col("least.word").alias("prefix"), F.col("least.off").alias("off"))


def _hits(texts: DataFrame, wins: DataFrame) -> DataFrame:
    """(id, h, start, size, item): verified occurrences, and one row with a null item and start n_words for each document row."""
    ending = texts.sparkSession.createDataFrame([(None, [], END, 0)], wins.schema)
    placed = texts.select("id", "h", F.concat(words(F.col("_t")), F.array(F.lit(END))).alias("w")).select("id", "h", "w", F.posexplode_outer("w").alias("p", "word"))
    at = F.col("p") - F.col("off")
    fits = (at >= 0) & (at + F.size("win") <= F.size("w") - 1)
    same = F.when(F.size("win") == 0, True).otherwise(F.when(fits, F.slice("w", F.greatest(at, F.lit(0)) + 1, F.size("win")) == F.col("win")).otherwise(False))
    found = placed.join(F.broadcast(wins.union(ending)), (F.col("word") == F.col("prefix")) & same)
    return found.select("id", "h", at.alias("start"), F.size("win").alias("size"), "item")


def _covered(spans: Column) -> Column:
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = x["start"] + x["size"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(acc["end"], x["start"]), F.lit(0))).alias("n"))

    return F.aggregate(F.array_sort(spans), start, step, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """One row a document: id_col, n_words, n_hit, n_items, items (array of string, sorted) and contaminated."""
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("_t"))
    wins = cut(windows(items, item_id, item_text, size))
    n_blocks = -(-wins.count() // BLOCK_ROWS) or 1
    ordered = cut(prefixes(texts, wins))
    blocks = [ordered.where(F.pmod(F.xxhash64("item", "win"), F.lit(n_blocks)) == i) if n_blocks > 1 else ordered for i in range(n_blocks)]
    found = reduce(DataFrame.union, [_hits(texts, b) for b in blocks])
    hit = F.col("item").isNotNull()
    per = found.groupBy("id", "h").agg(
        F.max(F.when(~hit, F.col("start"))).cast("long").alias("n_words"),
        F.sum(F.when(~hit, 1)).alias("_rows"),
        F.collect_set(F.when(hit, F.struct("start", "size"))).alias("_spans"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    one = per.select("id", "n_words", _covered(F.col("_spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (F.size("_spans") > 0).alias("contaminated"), "_rows", "h")
    each = one.select("*", F.explode(F.sequence(F.lit(1), (F.col("_rows") / n_blocks).cast("int"))).alias("_copy"))
    return each.select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items", "contaminated", F.col("h").alias("text_hash"))


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated documents."""
    bad = contamination(docs, items, id_col, text_col).where("contaminated").select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_h")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_id"]) & (F.xxhash64(docs[text_col]) == bad["_h"]), "left_anti")


ORACLE = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + 9), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM win), dwin AS (
  SELECT rid, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)
), hit AS (SELECT rid, i, win.k, item_id FROM dwin JOIN win ON dwin.k = win.k AND dwin.s = win.s),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (rid) LEFT JOIN its USING (rid)
"""
