"""How much each source's use of words diverges from other sources' and from its language's, in exact integers.

1. A language's vocabulary is the terms of at least ``least`` of its documents, found by counting documents.
2. Its terms are sorted by their bytes and numbered in ranges; a minimal acyclic transducer is built from every 100 000 sorted terms, in
   tasks of their own, and gives each term its ordinal.
3. The transducers are broadcast, at most 64 MB of them at a time, and the texts stream through them again: a batch's terms come out as
   ordinals with counts, and nothing else is counted. A vocabulary over 64 MB takes several rounds, each over its own range of terms of a
   table that was aggregated and sorted once, so the work doesn't grow with the rounds.
4. Smoothed shares and divergences are integers. Terms are ranked by value, ties by ordinal, which is the order of their bytes. For pairs
   of sources, blocks of ordinals become matrices of shares, a row a source, and the blocks' sums are added up.

A document is a row of the table, whatever its doc_id, so repeated rows count again. Null text, lang and source are empty strings. Texts
over 8 MB are worked through in stretches. A language without kept terms has pairs with value 0 and no terms; a source that is alone in its
language has no pairs. An empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomledger.llm import transducer
from loomledger.llm.common import split_batches, stretches, text_bytes, words_of, written
from loomledger.llm.resample import ranked

#: Terms of one transducer, and bytes of the transducers that are broadcast at once.
SHARD, RESIDENT = 100_000, 64 << 20
#: Bytes of text that are worked on at once.
STRETCH = 8 << 20
#: Shares are counted in billionths.
UNIT = 1_000_000_000
#: Groups of language and source up to which their totals are broadcast.
FEW = 100_000
_CUT = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")

#: What a byte becomes: letters small, all else of ASCII a space.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:0x80] = [b | 0x20 if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 0x20 for b in range(0x80)]


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and index of each term of a large_string array, and the distinct terms."""
    raw, offsets = text_bytes(column)
    plain = pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(_PLAIN[raw])])
    return words_of(plain)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, bool]]:
    """Batches with their texts, and whether the batch ends there: a text over STRETCH comes alone, in stretches."""
    for batch in split_batches(batches, "text", STRETCH):
        column = batch.column(batch.schema.get_field_index("text"))
        if batch.num_rows > 1 or len(raw := column[0].as_py().encode()) <= STRETCH:
            yield batch, column, True
            continue
        left = len(raw)
        for piece, _ in stretches(raw, STRETCH, _CUT):
            left -= len(piece)
            yield batch, pa.array([piece.decode()], pa.large_string()), left == 0


def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def document_counts(docs: DataFrame) -> DataFrame:
    """lang, term, docs: in how many documents of the language the term occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long_text: set[str] = set()
        for batch, column, ends in _pieces(batches):
            rows, index, names = terms_of(column)
            if long_text or not ends:
                long_text.update(names.to_pylist())
                if not ends:
                    continue
                names = pa.array(sorted(long_text), pa.large_string())
                rows, index = np.zeros(len(names), np.int64), np.arange(len(names))
                long_text = set()
            size = max(len(names), 1)
            lang, langs = _coded(batch.column(batch.schema.get_field_index("lang")))
            once = np.unique(rows * size + index)
            keys, docs_ = np.unique(lang[once // size] * size + once % size, return_counts=True)
            yield pa.record_batch({"lang": langs.take(pa.array(keys // size)), "term": names.take(pa.array(keys % size)).cast(pa.string()), "docs": pa.array(docs_, pa.int64())})

    return docs.select("lang", "text").mapInArrow(count, "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def vocabulary(docs: DataFrame, least: int) -> DataFrame:
    """lang, term, ordinal of the kept terms. Ordinals ascend with (lang, term) over all languages; written."""
    kept = document_counts(docs).where(F.col("docs") >= least).select("lang", "term")
    return written(ranked(kept, "lang", "term").select("lang", "term", (F.col("rank") - 1).alias("ordinal")), "vocabulary")


def transducers(terms: DataFrame, shard: int = SHARD) -> DataFrame:
    """lang, base (the first ordinal), first and last term, size in bytes and the packed transducer of every shard; written."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("ordinal")
        words = table.column("term").cast(pa.large_binary()).to_pylist()
        raw = transducer.build(words).packed()
        return pa.table({"lang": table.column("lang")[:1], "base": table.column("ordinal")[:1], "first": table.column("term")[:1], "last": table.column("term")[-1:], "bytes": pa.array([len(raw)], pa.int64()), "raw": pa.array([raw], pa.binary())})

    sharded = terms.withColumn("shard", F.expr(f"ordinal div {shard}"))
    return written(sharded.groupBy("lang", "shard").applyInArrow(build, "lang string, base long, first string, last string, bytes long, raw binary"), "transducers")


class Machines:
    """The transducers of a round, by language; a term goes to the one whose range it is in."""

    def __init__(self, rows: list[tuple[str, int, str, bytes]]) -> None:
        self.of: dict[str, tuple[list[bytes], list[int], list[transducer.Transducer]]] = {}
        for lang, base, first, raw in sorted(rows, key=lambda r: r[1]):
            firsts, bases, machines = self.of.setdefault(lang, ([], [], []))
            firsts.append(first.encode())
            bases.append(base)
            machines.append(transducer.Transducer.unpacked(bytes(raw)))

    def ordinals(self, lang: str, names: pa.Array) -> np.ndarray:
        """The ordinal of each term, -1 of those without."""
        found = np.full(len(names), -1, dtype=np.int64)
        if lang not in self.of or not len(names):
            return found
        firsts, bases, machines = self.of[lang]
        shard = np.zeros(len(names), np.int64) if len(firsts) == 1 else np.array([bisect.bisect_right(firsts, x) - 1 for x in names.cast(pa.large_binary()).to_pylist()])
        data, offsets = text_bytes(names)
        for at in np.unique(shard[shard >= 0]):
            own = np.flatnonzero(shard == at)
            local = machines[at].ordinals(data, offsets[own], offsets[own + 1])
            found[own] = np.where(local >= 0, local + bases[at], -1)
        return found


def _rounds(machines: DataFrame, resident: int) -> list[list[tuple[str, int]]]:
    """Shards in order, as many to a round as resident bytes hold: (lang, base) of each. One short row a shard comes to the driver."""
    rounds, held = [[]], 0
    for lang, base, size in machines.select("lang", "base", "bytes").orderBy("base").collect():
        if rounds[-1] and held + size > resident:
            rounds.append([])
            held = 0
        rounds[-1].append((lang, base))
        held += size
    return rounds


def _emitted(machines: Machines, lang: np.ndarray, langs: pa.Array, source: pa.Array, index: np.ndarray, names: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    """What is in the vocabulary of rows of (lang, source, term, n)."""
    ordinal = np.full(len(index), -1, dtype=np.int64)
    for at, name in enumerate(langs.to_pylist()):
        own = np.flatnonzero(lang == at)
        used, back = np.unique(index[own], return_inverse=True)
        ordinal[own] = machines.ordinals(name, names.take(pa.array(used)))[back]
    hit = np.flatnonzero(ordinal >= 0)
    return pa.record_batch({"lang": langs.take(pa.array(lang[hit])), "source": source.take(pa.array(hit)), "ordinal": pa.array(ordinal[hit]), "n": pa.array(n[hit])})


def _streamed(docs: DataFrame, machines, terms: bool) -> DataFrame:
    """lang, source, ordinal, n of texts that stream through the machines (a broadcast), or all terms of the texts if ``terms``."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = None if terms else Machines(machines.value)
        for batch, column, _ in _pieces(batches):
            rows, index, names = terms_of(column)
            size = max(len(names), 1)
            lang, langs = _coded(batch.column(batch.schema.get_field_index("lang")))
            source, sources = _coded(batch.column(batch.schema.get_field_index("source")))
            keys, n = np.unique((lang * len(sources) + source)[rows] * size + index, return_counts=True)
            group, index = np.divmod(keys, size)
            lang, named = group // max(len(sources), 1), sources.take(pa.array(group % max(len(sources), 1)))
            if terms:
                yield pa.record_batch({"lang": langs.take(pa.array(lang)), "source": named, "term": names.take(pa.array(index)).cast(pa.string()), "n": pa.array(n, pa.int64())})
            else:
                yield _emitted(loaded, lang, langs, named, index, names, n)

    return docs.select("lang", "source", "text").mapInArrow(stream, f"lang string, source string, {'term string' if terms else 'ordinal long'}, n long")


def _looked_up(parts: DataFrame, machines) -> DataFrame:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = Machines(machines.value)
        for batch in batches:
            lang, langs = _coded(batch.column(0))
            index, names = _coded(batch.column(2).cast(pa.large_string()))
            yield _emitted(loaded, lang, langs, batch.column(1), index, names, np.asarray(batch.column(3), dtype=np.int64))

    return parts.mapInArrow(look, "lang string, source string, ordinal long, n long")


def recounted(docs: DataFrame, machines: DataFrame, resident: int = RESIDENT) -> DataFrame:
    """lang, source, ordinal, n (over 0) of the kept terms; written."""
    context = docs.sparkSession.sparkContext
    rounds = _rounds(machines, resident)

    def sent(shards):
        chosen = machines.where(F.col("base").between(shards[0][1], shards[-1][1])) if shards else machines.limit(0)
        return context.broadcast([(r["lang"], r["base"], r["first"], bytes(r["raw"])) for r in chosen.select("lang", "base", "first", "raw").collect()])

    def summed(df: DataFrame) -> DataFrame:
        return df.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))

    if len(rounds) == 1:
        return written(summed(_streamed(docs, sent(rounds[0]), False)), "recounted")
    parts = _streamed(docs, None, True).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    parts = written(parts.repartitionByRange("lang", "term", "source").sortWithinPartitions("lang", "term"), "terms")
    done = []
    for shards in rounds:
        of = machines.where(F.col("base").between(shards[0][1], shards[-1][1])).groupBy("lang").agg(F.min("first").alias("low"), F.max("last").alias("high")).collect()
        inside = F.lit(False)
        for lang, low, high in of:
            inside = inside | ((F.col("lang") == lang) & F.col("term").between(low, high))
        done.append(written(summed(_looked_up(parts.where(inside), sent(shards))), "recounted"))
    counts = done[0]
    for more in done[1:]:
        counts = counts.unionByName(more)
    return counts


def _share(n: Column, total: Column) -> Column:
    whole = "decimal(19,0)"
    return F.lit(1).cast("long") + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast(whole), total.cast(whole))


def _shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (n + 1) / total) in 64 bits: a long division, three digits at a time."""
    share, rest = np.divmod(n + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        share = share * 1000 + digit
    return share + 1


def _pair_sums(counts: DataFrame, totals: DataFrame, width: int) -> DataFrame:
    """lang, source, item, value: sums over all kept terms. Blocks of ordinals are matrices of shares; every source of a language is a row."""

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block = key[1].as_py()
        names = right.column("source").combine_chunks()
        low, high = max(right.column("low")[0].as_py(), block * width), min(right.column("high")[0].as_py(), (block + 1) * width)
        dense = np.zeros((len(names), high - low), np.int64)
        at = {name: i for i, name in enumerate(names.to_pylist())}
        coded = left.column("source").combine_chunks().dictionary_encode()
        row = np.array([at[x] for x in coded.dictionary.to_pylist()], dtype=np.int64)[np.asarray(coded.indices, dtype=np.int64)]
        dense[row, np.asarray(left.column("ordinal"), dtype=np.int64) - low] = np.asarray(left.column("n"), dtype=np.int64)
        p = _shares(dense, np.asarray(right.column("total"), dtype=np.int64)[:, None])
        value = np.empty((len(names), len(names)), np.int64)
        for i in range(len(names)):
            gap = p[i] - p
            value[i] = (gap * gap // p).sum(axis=1)
        first, other = np.nonzero(~np.eye(len(names), dtype=bool))
        return pa.table({"lang": pa.array([key[0].as_py()] * len(first), pa.string()), "source": names.take(pa.array(first)), "item": names.take(pa.array(other)), "value": pa.array(value[first, other])})

    blocks = totals.where("kept > 0").withColumn("block", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))))
    own = counts.withColumn("block", F.expr(f"ordinal div {width}"))
    sums = own.groupBy("lang", "block").cogroup(blocks.groupBy("lang", "block")).applyInArrow(compare, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 3, top: int = 200, resident: int = RESIDENT, shard: int = SHARD) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows against every other source of the language, ``term`` rows of the ``top`` terms that a
    source uses more than its language."""
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    terms = vocabulary(docs, least)
    counts = recounted(docs, transducers(terms, shard), resident)
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.min("ordinal").alias("low"), (F.max("ordinal") + 1).alias("high"))
    groups = docs.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(sizes, "lang", "left")
    totals = written(groups.select("lang", "source", F.coalesce("kept", F.lit(0)).alias("kept"), "low", "high", (F.coalesce("n", F.lit(0)) + F.coalesce("kept", F.lit(0))).alias("total")), "groups")

    widest = totals.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    width = max(1, min(4096, (4 << 20) // widest))
    pairs = totals.select("lang", "source").join(totals.select("lang", F.col("source").alias("item")), "lang").where("source != item")
    pairs = pairs.join(_pair_sums(counts, totals, width), ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    of_group = Window.partitionBy("lang", "source")
    pairs = pairs.withColumn("rank", F.row_number().over(of_group.orderBy(F.desc("value"), "item")))

    few = totals.count() <= FEW
    total = totals.select("lang", "source", "total", "kept")
    lang_total = totals.groupBy("lang").agg((F.sum(F.col("total") - F.col("kept")) + F.max("kept")).alias("lang_total"))
    of_lang = counts.groupBy("ordinal").agg(F.sum("n").alias("lang_n"))
    rated = counts.join(of_lang, "ordinal").join(F.broadcast(total) if few else total, ["lang", "source"]).join(F.broadcast(lang_total) if few else lang_total, "lang")
    rated = rated.withColumn("p", _share(F.col("n"), F.col("total"))).withColumn("q", _share(F.col("lang_n"), F.col("lang_total"))).where("p > q")
    rated = rated.select("lang", "source", "ordinal", F.expr("((p - q) * (p - q)) div q").alias("value"))
    best = rated.withColumn("rank", F.row_number().over(of_group.orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= top)
    best = best.join(terms.select("ordinal", F.col("term").alias("item")), "ordinal")
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(best.withColumn("part", F.lit("term")).select(*columns))


def oracle_sql() -> str:
    """op13_source_divergence for DuckDB, over the view documents."""
    share = "(1 + (1000000000::HUGEINT * ({n} + 1)) // ({total}))"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), spread AS (
  SELECT row, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term, count(DISTINCT row) AS docs, count(*) AS n FROM spread GROUP BY ALL HAVING count(DISTINCT row) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM kept GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM spread SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.term, {share.format(n="coalesce(c.n, 0)", total="g.n + l.v")} AS p
  FROM totals g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), rated AS (
  SELECT c.lang, c.source, c.term AS item, {share.format(n="c.n", total="g.n + l.v")} AS p, {share.format(n="k.n", total="l.n + l.v")} AS q
  FROM counts c JOIN totals g USING (lang, source) JOIN langs l USING (lang) JOIN kept k ON k.lang = c.lang AND k.term = c.term
), answers AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, ((p - q) * (p - q) // q)::BIGINT FROM rated WHERE p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM answers QUALIFY part = 'pair' OR rank <= 200"""
