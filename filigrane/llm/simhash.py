"""SimHash near-duplicates by a segment-popcount embedding and a grid join.

A text's fingerprint has bit i set if over half of its shingles' XXH64 hashes
do. Copies collapse at once: everything after works on distinct fingerprints.

Search: a fingerprint is embedded as the bit counts of its 32 two-bit segments,
each 0 to 2. The Manhattan distance of two embeddings never exceeds the Hamming
distance of the fingerprints. The embedding is held as a thermometer code in
one long (count 0: 00, 1: 01, 2: 11), so Manhattan distance is one xor and one
bit count. The segments form b blocks; within distance 3 at least b - 3 blocks have
equal counts, so each choice of b - 3 blocks is a grid whose cells are
joined by equality, and a pair within range meets in at least one cell. Within
a cell the Manhattan bound is tested first, then the exact distance. More blocks
make more grids, of finer cells; b follows the counted number of distinct
fingerprints, so that chance meetings don't grow with its square. Every b finds the
same links.

Large cells: nobody lists a cell's pairs. Each cell first links its members to
one pivot, which joins most of a group of near copies in linear work; cells
whose members then share a component are done. In the rest, only members
outside the cell's largest component are compared, and only with members of
other components; in cells of over ``HOT_CELL`` members their join is salted, so that
such a cell is many keys. A component's pairs are merged to one row a pair of components. No link between
different components is left out, so components are exactly those of the full
link graph.

Edge cases: a null text counts as empty; a text without words has fingerprint
zero and links like any other; fewer words than a shingle make one shingle. A
null id stays a row and is no candidate for a component's smallest id. Hashes of a
text of any length are taken in blocks of bounded size. Ties: of pivots the one
with the least hash counts, of rows with one id and fingerprint that with the least
hash of all its columns is kept. Only the id and text columns are read, whatever
the others are called; repeated rows give repeated results; an empty table gives
an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigrane.llm.components import components
from filigrane.llm.state import cut

SHINGLE = 3
SEED = 42
MAX_BITS = 3
BLOCKS = (6, 8, 12, 16)
SEGMENT_BITS = 1.415  # -log2 of the chance that a two-bit segment has the same count in two random fingerprints
PIVOT_ROUNDS = 2
HOT_CELL, SALTS = 50_000, 16
BROADCAST_IDS = 1_000_000  # of repeated ids, some 50 MB in an executor; beyond it the same join shuffles
_AT_ONCE = 1 << 15
_ODD = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text. Hashes are counted in blocks, so memory doesn't grow with their number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return hashed(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, n)
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    starts, ends = start[: n - shingle + 1].tolist(), (start + size)[shingle - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for k in range(0, len(starts), _AT_ONCE):
        h = np.array([hashed(joined[s:e], SEED) for s, e in zip(starts[k : k + _AT_ONCE], ends[k : k + _AT_ONCE], strict=True)], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row a document, fp the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made)], ["id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, fp long")


def embedding(fp: Column) -> Column:
    """Bit counts of the two-bit segments as a thermometer code: the bits of each segment, sorted."""
    high, odd = F.shiftrightunsigned(fp, 1), F.lit(_ODD)
    some, both = fp.bitwiseOR(high).bitwiseAND(odd), fp.bitwiseAND(high).bitwiseAND(odd)
    return some.bitwiseOR(F.shiftleft(both, 1))


def blocks_for(n: int, max_bits: int = MAX_BITS) -> int:
    """The number of blocks that makes the fewest rows of n random fingerprints: those dealt to the grids, and chance meetings in their cells."""
    choices = [b for b in BLOCKS if b > max_bits] or [max_bits + 1]
    return min(choices, key=lambda b: comb(b, max_bits) * n * (1 + n / 2 ** (32 * SEGMENT_BITS * (b - max_bits) / b)))


def grid_masks(max_bits: int = MAX_BITS, blocks: int = BLOCKS[0]) -> list[int]:
    """Masks of the grids: every choice of the blocks that must agree when at most max_bits differ."""
    edges = [round(32 * i / blocks) for i in range(blocks + 1)]
    block = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(block, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near(a: Column, b: Column, max_bits: int) -> Column:
    """The Manhattan lower bound, then the exact distance."""
    return (F.bit_count(embedding(a).bitwiseXOR(embedding(b))) <= max_bits) & (F.bit_count(a.bitwiseXOR(b)) <= max_bits)


def _cells(fps: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """(g, cell, fp): the members of every grid cell that holds two or more."""
    keys = F.array(*[F.struct(F.lit(i).alias("g"), embedding(F.col("fp")).bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(grid_masks(max_bits, blocks))])
    every = fps.select("fp", F.explode(keys).alias("k")).select("k.g", "k.cell", "fp")
    shared = every.groupBy("g", "cell").agg(F.count("*").alias("n")).where("n > 1").select("g", "cell")
    return every.join(shared, ["g", "cell"], "left_semi")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("g", "cell", "fp", F.coalesce("root", "fp").alias("root"))


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after more links (u, v) between nodes or roots."""
    known = links if labels is None else links.union(labels.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    return components(known)


def link_classes(fps: DataFrame, max_bits: int = MAX_BITS, pivot_rounds: int = PIVOT_ROUNDS, blocks: int | None = None) -> DataFrame:
    """fps (fp, distinct) → (node, root): each fingerprint that has a link, and the least of its component."""
    members, labels = cut(_cells(fps, max_bits, blocks or blocks_for(fps.count(), max_bits))), None
    for turn in range(pivot_rounds):
        pivots = members.groupBy("g", "cell").agg(F.min(F.struct(F.xxhash64("fp", F.lit(turn)).alias("h"), F.col("fp").alias("pivot")))["pivot"].alias("pivot"))
        links = members.join(pivots, ["g", "cell"]).where((F.col("fp") != F.col("pivot")) & near(F.col("fp"), F.col("pivot"), max_bits))
        labels = cut(_merged(labels, links.select(F.col("fp").alias("u"), F.col("pivot").alias("v"))))
        rooted = _labelled(members.select("g", "cell", "fp"), labels)
        split = rooted.groupBy("g", "cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("g", "cell")
        members = cut(rooted.join(split, ["g", "cell"], "left_semi"))
        if members.isEmpty():
            return labels
    if labels is None:
        members = _labelled(members, fps.select(F.col("fp").alias("node"), F.col("fp").alias("root")))
    sizes = members.groupBy("g", "cell", "root").agg(F.count("*").alias("n"))
    cells = sizes.groupBy("g", "cell").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("n").alias("size"))
    few = cut(members.join(cells, ["g", "cell"]).where("root != main").select("g", "cell", "fp", "root", "size"))
    hot = few.where(F.col("size") > HOT_CELL)
    salted = members.join(hot.select("g", "cell").distinct(), ["g", "cell"], "left_semi").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    pairs = _pairs(few.where(F.col("size") <= HOT_CELL), members, ["g", "cell"], max_bits).union(_pairs(hot.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))), salted, ["g", "cell", "salt"], max_bits))
    links = cut(pairs.distinct())
    return cut(_merged(labels, links))


def _pairs(few: DataFrame, members: DataFrame, keys: list[str], max_bits: int) -> DataFrame:
    """(u, v): components of near fingerprints that share their keys."""
    a, b = few.alias("a"), members.alias("b")
    same = (F.col("a.root") != F.col("b.root")) & near(F.col("a.fp"), F.col("b.fp"), max_bits)
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, same).select(F.least("a.root", "b.root").alias("u"), F.greatest("a.root", "b.root").alias("v"))


def _rooted(seen: DataFrame, max_bits: int) -> DataFrame:
    """(fp, low, root): each fingerprint of seen (id, fp), its least id and its component, stored."""
    least = cut(seen.groupBy("fp").agg(F.min("id").alias("low")))
    labels = link_classes(least.select("fp"), max_bits)
    return least.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row a document: id_col, fingerprint (16 hex digits) and component_id, the smallest id that its links reach."""
    seen = cut(fingerprints(docs, id_col, text_col))
    rooted = _rooted(seen, max_bits)
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    known = rooted.join(ids, "root").select("fp", "component_id")
    return seen.join(known, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """docs with one document of each component: that of the smallest id. Rows without an id aren't judged and stay.

    Ids may repeat: rows of one id whose texts are in different components are different
    documents, and one of each stays. Only their texts are read again for that."""
    seen = cut(fingerprints(docs, id_col, text_col).where("id IS NOT NULL"))
    rooted = _rooted(seen, max_bits).where("low IS NOT NULL")
    keep = cut(rooted.groupBy("root").agg(F.min(F.struct("low", "fp")).alias("k")).select(F.col("k.low").alias("_keep"), F.col("k.fp").alias("_fp")))
    many = cut(seen.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("_keep")).join(keep.select("_keep").distinct(), "_keep", "left_semi"))
    n_many = many.count()
    single = keep.join(many, "_keep", "left_anti") if n_many else keep
    alone = docs.join(single, docs[id_col] == single["_keep"], "left_semi").unionByName(docs.where(docs[id_col].isNull()))
    if not n_many:
        return alone
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(id_col).alias("_keep"), F.col(text_col).alias("_text"))

    @F.pandas_udf("long")
    def printed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    again = packed.join(F.broadcast(many) if n_many <= BROADCAST_IDS else many, "_keep", "left_semi").withColumn("_fp", printed("_text"))
    one = again.join(keep, ["_keep", "_fp"], "left_semi").groupBy("_keep", "_fp").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    parted = one.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
    return alone.unionByName(parted)
