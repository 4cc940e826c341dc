"""Importance resampling towards a target distribution, over hashed n-grams, with Arrow kernels.

1. A batch of texts is lower-cased (ascii_lower), cut at everything that is no word character (split_pattern_regex), flattened
   (list_flatten) and dictionary-encoded. Words are then small integers; shifted indices next to each other are n-grams,
   dictionary-encoded again, so that only a batch's distinct words and n-grams are ever hashed: the CRC of an n-gram goes on from the
   CRC of its first words. Take gives every feature its bucket.
2. Both tables are counted by bucket; a task sends at most one number a bucket. The gain of a bucket, a thousand times the logarithm of
   target share over corpus share, is one fixed table of ``buckets`` integers.
3. Texts are read again: take gives the gains of a document's features, a segmented sum divides into the floored mean, its weight.
4. A Gumbel number, from the hash of seed and doc_id alone, is added to the weight; the highest sums are a sample without replacement in
   proportion to the weights. Places are given by a range-partitioned sort: a row's place is its place in its own partition plus the rows
   of the partitions before, so no task sees all rows.

Null and empty texts have no feature, weight 0 and a score like others; they are never drawn while ``min_words`` is over 0. Texts over
8 MB are worked through in stretches that overlap by n - 1 words, which gives the same features. Rows of one doc_id have one Gumbel
number and are drawn each by itself. A null doc_id hashes like an empty one and comes last among ties. An empty table gives an empty
result; an empty target has equal counts everywhere. Other columns, whatever their names, are ignored by ``score`` and travel along in
``drawn``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomledger.llm.common import split_batches, stretches, written

#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before that.
_CUT = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Bytes of text that are worked on at once.
STRETCH = 8 << 20
#: Rows of a partition before its number starts in monotonically_increasing_id.
_PLACE = 33


def encoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Row and index of every word of a large_string array, and the distinct words."""
    lists = pc.split_pattern_regex(pc.ascii_lower(column), pattern=BETWEEN)
    rows = np.repeat(np.arange(len(column)), np.asarray(pc.list_value_length(lists)))
    coded = pc.list_flatten(lists).dictionary_encode()
    index, names = np.asarray(coded.indices, dtype=np.int64), coded.dictionary.cast(pa.large_binary()).to_pylist()
    if b"" in names:  # what stands before the first and after the last separator
        kept = index != names.index(b"")
        rows, index = rows[kept], index[kept]
    return rows, index, names


def buckets_of(column: pa.Array, orders: int, buckets: int, skip: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n-grams of each order: the row and the bucket of every one, in the order of the text. Of a single row that starts with
    ``skip`` known words, those n-grams are left out that have no other word."""
    rows, index, names = encoded(column)
    crc = np.fromiter(map(zlib.crc32, names), dtype=np.int64, count=len(names))
    spaced = [b" " + name for name in names]
    grams, ends = index, index
    for order in range(1, orders + 1):
        if order > 1:
            # The n-gram that starts at a word: the one of an order less, and the word that follows it in the same row.
            ends = ends[1:]
            inside = rows[: len(rows) - order + 1] == rows[order - 1 :]
            pairs = pa.array(grams[:-1] * max(len(names), 1) + ends).dictionary_encode() if len(grams) > 1 else pa.array([], pa.int64()).dictionary_encode()
            left, right = np.divmod(np.asarray(pairs.dictionary, dtype=np.int64), max(len(names), 1))
            crc = np.fromiter((zlib.crc32(spaced[r], c) for r, c in zip(right.tolist(), crc[left].tolist(), strict=True)), dtype=np.int64, count=len(right))
            grams = np.asarray(pairs.indices, dtype=np.int64)
        else:
            inside = np.ones(len(rows), bool)
        at = np.flatnonzero(inside)[max(0, skip - order + 1) :]
        yield rows[at], np.take(crc % buckets, grams[at])


def _texts(batches: Iterator[pa.RecordBatch], text: str, orders: int) -> Iterator[tuple[pa.RecordBatch, pa.Array, int, bool]]:
    """Batch, its texts, known words at the start, and whether the batch ends here: a text over STRETCH comes alone, in stretches."""
    for batch in split_batches(batches, text, STRETCH):
        column = batch.column(batch.schema.get_field_index(text))
        if batch.num_rows > 1 or len(raw := column[0].as_py().encode()) <= STRETCH:
            yield batch, column, 0, True
            continue
        last = None
        for piece, known in stretches(raw, STRETCH, _CUT, orders - 1):
            if last:
                yield batch, *last, False
            last = pa.array([piece.decode()], pa.large_string()), known
        yield batch, *last, True


def bucket_counts(texts: DataFrame, text_col: str, orders: int, buckets: int) -> DataFrame:
    """bucket and n, the number of features in it, of all texts together; buckets without a feature are absent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, column, known, _ in _texts(batches, "text", orders):
            for _, bucket in buckets_of(column, orders, buckets, known):
                total += np.bincount(bucket, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(hit, pa.int64()), "n": pa.array(total[hit], pa.int64())})

    counted = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the logarithm of the smoothed share in the target over that in the corpus, by bucket."""
    size, of_corpus, of_target = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t + 1) * (of_corpus + size)) / (float(s + 1) * (of_target + size)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, orders: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = features = total = None
        for batch, column, known, ends in _texts(batches, "text", orders):
            if words is None:
                words, features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for order, (rows, bucket) in enumerate(buckets_of(column, orders, buckets, known), 1):
                # Segmented sums: rows ascend, so a row's features lie between two places.
                places = np.searchsorted(rows, np.arange(batch.num_rows + 1))
                sums = np.concatenate(([0], np.cumsum(np.take(gain, bucket))))
                n = np.diff(places)
                features += n
                total += np.diff(sums[places])
                if order == 1:
                    words += n
            if ends:
                mean = np.where(features > 0, total // np.maximum(features, 1), 0)
                yield pa.record_batch({"doc_id": batch.column(0), "n_words": pa.array(words), "n_features": pa.array(features), "weight": pa.array(mean)})
                words = None

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, *order) -> DataFrame:
    """rows with ``rank``, 1 for the first in the given order: sorted in ranges, numbered in each, offset by the ranges before. The order has
    to be total (end it with a unique column), so that many equal rows are several ranges."""
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ranked")
    range_ = F.shiftright("place", _PLACE)
    sizes = placed.groupBy(range_.alias("range")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each partition of the sort: as many as shuffle partitions at most.
    starts = F.broadcast(sizes.select(F.col("range").alias("of"), before.alias("before")))
    inside = F.col("place") - F.shiftleft(range_, _PLACE)
    return placed.join(starts, range_ == F.col("of")).withColumn("rank", F.col("before") + inside + 1).drop("of", "before", "place")


def score(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = 10_000, orders: int = 2, seed: int = 7, percent: int = 25, min_words: int = 20
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every row."""
    counts = []
    for table, column in ((docs, text_col), (target, target_col)):
        dense = np.zeros(buckets, np.int64)
        for bucket, n in bucket_counts(table, column, orders, buckets).collect():  # a row a bucket at most
            dense[bucket] = n
        counts.append(dense)
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((hashed + 0.5) / F.lit(4294967296.0))))
    scored = weights(docs, gains(*counts), id_col, text_col, orders)
    scored = written(scored.withColumn("score", F.col("weight") + gumbel).withColumn("row", F.monotonically_increasing_id()), "scored")
    able = scored.where(F.col("n_words") >= min_words)
    places = ranked(able.select("doc_id", "n_features", "weight", "score", "row"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    drawn = able.count() * percent // 100
    answer = ("doc_id", "n_features", "weight", "score")
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    return places.select(*answer, rank).unionByName(scored.where(F.col("n_words") < min_words).select(*answer, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose doc_id was drawn, with all their columns."""
    chosen = score(docs, target, id_col, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(chosen, F.col(f"`{id_col}`").cast("long") == F.col("_drawn"), "left_semi")


#: The words of a text, lower-cased, for DuckDB.
_SQL_WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle_sql() -> str:
    """op11_importance_resampling for DuckDB, over documents and benchmark. DuckDB has no CRC: its table of bytes is made from the polynomial."""
    return rf"""
WITH RECURSIVE steps AS (
  SELECT b, b AS c, 0 AS step FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, step + 1 FROM steps WHERE step < 8
), crc AS (
  SELECT list(c ORDER BY b) AS table_ FROM steps WHERE step = 8
), texts AS (
  SELECT true AS corpus, doc_id, {_SQL_WORDS.format(text="coalesce(text, '')")} AS words FROM documents
  UNION ALL
  SELECT false, item_id, {_SQL_WORDS.format(text="coalesce(text, '')")} FROM benchmark
), runs AS (
  SELECT corpus, doc_id, len(words) AS n_words, list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS features FROM texts
), spread AS (
  SELECT corpus, doc_id, unnest(features) AS feature FROM runs
), counted AS (
  SELECT corpus, doc_id, feature, count(*) AS n FROM spread GROUP BY ALL
), hashed AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(feature) + 1), lambda i: ('0x' || substr(hex(encode(feature)), 2 * i - 1, 2))::BIGINT)),
    lambda a, x: xor(a // 256, crc.table_[xor(a % 256, x) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM counted), crc
), bucketed AS (
  SELECT corpus, doc_id, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (feature) GROUP BY ALL
), sides AS (
  SELECT range AS bucket, coalesce(sum(n) FILTER (corpus), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT corpus), 0)::DOUBLE AS t
  FROM range(10000) LEFT JOIN bucketed ON bucket = range GROUP BY ALL
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM sides
), weighed AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM bucketed JOIN gain USING (bucket) WHERE corpus GROUP BY ALL
), scored AS (
  SELECT r.doc_id, r.n_words, coalesce(n_features, 0) AS n_features,
         CASE WHEN n_features IS NULL THEN 0 ELSE ((total - ((total % n_features) + n_features) % n_features) // n_features) END AS weight
  FROM (SELECT * FROM runs WHERE corpus) r LEFT JOIN weighed USING (doc_id)
), summed AS (
  SELECT doc_id, n_words, n_features, weight,
         weight + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM scored
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM summed WHERE n_words >= 20
)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
FROM summed s LEFT JOIN placed USING (doc_id)"""
