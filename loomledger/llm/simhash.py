"""SimHash near-duplicates with pigeonring filtering.

Fingerprints: a text's words (bytes between white space, A-Z lower-cased) form shingles of three words, repeats
included; a bit is set when it is set in over half of the shingles' XXH64 hashes.

Links: two fingerprints link at THRESHOLD or fewer differing bits. The 64 bits form a ring of m segments. If two
fingerprints differ in at most t bits, the pigeonring principle promises a segment from which every chain of l
consecutive segments differs in at most l * t / m bits (rounded down). With m = 5 and t = 2 the budgets of chains
of 1 to 5 segments are 0, 0, 1, 1, 2: so some two neighbouring segments (25 or 26 bits) are equal, which makes the
join key, and the longer chains prune what the key brings together before the full Hamming check.

Equal fingerprints are one class from the start. A key that brings many classes together isn't compared pair by
pair: each of its classes emits itself and its one-bit neighbours outside the key, and those that meet in one of
them differ in at most two bits. That is exact, linear in the bucket, and used for every bucket over ``dense`` classes.

Null and empty texts, and texts of white space alone, have fingerprint zero and link like any other. Repeated
doc_ids: each row has its fingerprint, and rows of one id are linked. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomledger.llm.common import split_batches, written
from loomledger.llm.components import connected_components

#: Segments of the ring: (first bit, bits).
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints that differ in at most so many bits link; the segments and the star of one-bit neighbours fit it.
THRESHOLD = 2
_BLOCK = 1 << 16


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


_ONE_BIT = [[0, *(_signed(1 << b) for b in range(64) if not any(low <= b < low + n for low, n in (SEGMENTS[i], SEGMENTS[(i + 1) % len(SEGMENTS)])))] for i in range(len(SEGMENTS))]


def fingerprint(text: str, words: int = 3) -> int:
    """The fingerprint of one text as an unsigned integer."""
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(tokens), 42)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    ones = np.zeros(64, dtype=np.int64)
    values = np.array(hashes, dtype="<u8")
    for low in range(0, len(values), _BLOCK):
        part = values[low : low + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches):
        for batch in split_batches(batches, "text", 4 << 20):
            found = np.array([fingerprint(t) for t in batch.column("text").to_numpy(zero_copy_only=False)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    low, bits = SEGMENTS[i % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))


def _key(fp: Column, i: int) -> Column:
    """Two neighbouring segments, and which."""
    return F.shiftleft(_segment(fp, i), 16).bitwiseOR(_segment(fp, i + 1)).bitwiseOR(F.lit(i << 40))


def _prefix_viable(x: Column, i: int, threshold: int) -> Column:
    """Whether the chain that starts at segment i keeps within its budget at every length; x: the differing bits."""
    m = len(SEGMENTS)
    spent, kept = F.lit(0), F.lit(True)
    for length in range(1, m + 1):
        spent = spent + F.bit_count(_segment(x, i + length - 1))
        kept = kept & (spent <= length * threshold // m)
    return kept


def fingerprint_links(classes: DataFrame, dense: int = 48) -> DataFrame:
    """Links u, v between classes (columns rep long, fp long, one row for each fingerprint) enough to connect all that differ in at most THRESHOLD bits."""
    m, threshold = len(SEGMENTS), THRESHOLD
    keyed = classes.select("rep", "fp", F.explode(F.array(*(_key(F.col("fp"), i) for i in range(m)))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = written(keyed.join(sizes, "key"), "keyed")
    which = F.shiftright(F.col("key"), 40)

    sparse = keyed.where(F.col("n") <= dense).select("key", "rep", "fp")
    other = sparse.select("key", F.col("rep").alias("rep2"), F.col("fp").alias("fp2"))
    x = F.col("fp").bitwiseXOR(F.col("fp2"))
    viable = F.lit(False)
    for i in range(m):
        viable = F.when(which == i, _prefix_viable(x, i, threshold)).otherwise(viable)
    pairs = sparse.join(other, "key").where(F.col("rep") < F.col("rep2")).where(viable).where(F.bit_count(x) <= threshold)
    links = pairs.select(F.col("rep2").alias("u"), F.col("rep").alias("v"))

    # The fingerprint itself and those that differ from it in one bit outside the two segments of the key.
    near = F.lit(None)
    for i, masks in enumerate(_ONE_BIT):
        near = F.when(which == i, F.transform(F.array(*map(F.lit, masks)), lambda mask: F.col("fp").bitwiseXOR(mask))).otherwise(near)
    met = keyed.where(F.col("n") > dense).select("key", "rep", F.explode(near).alias("at"))
    hubs = met.groupBy("key", "at").agg(F.min("rep").alias("v"), F.max("rep").alias("w")).where("v < w")
    links = links.union(met.join(hubs, ["key", "at"]).where("rep <> v").select(F.col("rep").alias("u"), "v"))
    return links.distinct()


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are the smallest document of their component. Rows without an id stay."""
    others = near_duplicates(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(others, id_col, "left_anti").select(*docs.columns)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id that links reach."""
    found = written(fingerprints(docs, id_col, text_col), "fingerprints")
    # One class for each fingerprint, named by its smallest document; rows of one id are in one component anyway.
    classes = found.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    repeated = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id")
    same_row = found.join(repeated, "doc_id").join(classes, "fp").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    # Class names must be distinct: an id that is the smallest of two fingerprints joins them by name.
    links = fingerprint_links(classes).union(same_row)
    components = connected_components(links)
    named = classes.join(components, classes["rep"] == components["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return found.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
