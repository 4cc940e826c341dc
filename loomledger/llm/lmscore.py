"""Language-model scoring by cross-entropy difference.

Two bigram models, one of a target text and one of the background, share one vocabulary, one order and one smoothing; a
document's score is the mean over its tokens of the target's loss less the background's: the lower, the more the
document reads like the target.

Vocabulary: every word of the documents, and an end of text. A bigram's probability is (count + mass * P(word)) / (count of
its first word + mass), with P(word) the word's share of all tokens: both models fall back to one prior with one mass.
Counts cover every document of both sides, and grow with the corpus: nothing but one total is gathered or broadcast.

1. Documents are dealt by id into parts of about ``part_bytes`` of text. A part asks for the counts of its distinct bigrams and
   words once each, by hash, with its own counts of them, and the questions are dealt over buckets by hash. So a bigram that all
   documents have reaches its bucket once for each part.
2. A bucket adds the counts up and answers each part in the order of its question, so answers carry no names. Parts and
   buckets grow in number with the bytes of the input, not in size.
3. A part meets its answers, and scores its documents. The parts' exchange is used for both steps.

Words are what white space separates, with A-Z lower-cased. They stand for themselves by 64-bit hashes, of which the remainder that
names the bucket and the 48 leading bits of the quotient travel, in order, so that the upper 16 are small steps; two codes of a bucket of a few million agree by chance about once in a hundred buckets,
which adds their counts. Null and empty texts score as an end of text alone. Repeated rows count and are scored each; rows
without an id are no target. Rows of one repeated id are dealt over ``salts`` parts. An empty target makes the scores
differ by the background's shape alone; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomledger.llm.common import split_batches, words_of

_END = xxhash.xxh64_intdigest(b"")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
_QUESTION = "bucket long, kind int, part long, low binary, high binary, b binary, t binary"
_ANSWER = "part long, kind int, bucket long, b binary, t binary"


def token_totals(texts: DataFrame) -> tuple[int, int]:
    """Bytes and tokens (ends of text included) of all texts (column text)."""

    def run(batches):
        for batch in split_batches(batches, "text", 8 << 20):
            column = batch.column("text")
            size = pc.sum(pc.binary_length(column)).as_py() or 0
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([len(words_of(column)[0]) + len(column)], pa.int64())], names=["bytes", "tokens"])

    found = texts.select("text").mapInArrow(run, "bytes long, tokens long").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens")).first()
    return found["bytes"] or 0, found["tokens"] or 0


def hashed_bigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and second word of every bigram of every row, words by their hash; a row begins and ends with the end of text."""
    n = len(column)
    rows, index, names = words_of(pc.ascii_lower(column))
    codes = np.array([*(xxhash.xxh64_intdigest(w) for w in names.cast(pa.large_binary()).to_pylist()), _END], dtype=np.uint64)
    counts = np.bincount(rows, minlength=n)
    ends = np.cumsum(counts)
    second = np.insert(codes[index], ends, codes[-1])
    first = np.roll(second, 1)
    first[np.r_[0, ends[:-1] + np.arange(1, n)] if n else []] = codes[-1]
    return np.repeat(np.arange(n), counts + 1), first, second


def pair_codes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One hash for each bigram."""
    code = first * _MIX[0] + second
    code ^= code >> np.uint64(29)
    code *= _MIX[1]
    code ^= code >> np.uint64(32)
    return code


def told(code: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each code, and the 48 leading bits of what else there is of it: in order, where the codes are."""
    spare = max(0, ((1 << 64) // buckets).bit_length() - 48)
    return code % np.uint64(buckets), code // np.uint64(buckets) >> np.uint64(spare)


def _squeezed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _read(blob: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _texts(table: pa.Table) -> tuple[pa.Table, pa.Array]:
    """The documents of a part (not the ids of the target), and their texts."""
    docs = table.filter(pc.equal(table.column("asks"), 0))
    return docs, pc.fill_null(docs.column("text").cast(pa.large_string()), "").combine_chunks()


def score(docs: DataFrame, target: DataFrame, mass: float = 4.0, part_bytes: int = 8 << 20, bucket_bytes: int = 16 << 20, salts: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score (target loss less background loss, each the mean over the tokens) of every document.

    target: a table with the ids of the target's documents. The background is all documents."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size, total = token_totals(texts)
    parts, buckets = 1 + size // part_bytes, 1 + size // bucket_bytes
    salted = lambda salt: F.pmod(F.xxhash64("id", salt), F.lit(parts))
    # Nulls have no id to be dealt by, so all of their text's hash deals them.
    salt = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.pmod(F.xxhash64("text"), F.lit(salts)))
    wanted = target.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    wanted = wanted.select("id", F.lit(None).cast("string").alias("text"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    dealt = texts.withColumn("salt", salt).select(salted("salt").alias("part"), F.lit(0).alias("asks"), "id", "text").union(wanted.select(salted("salt").alias("part"), F.lit(1).alias("asks"), "id", "text"))
    dealt = dealt.repartition(parts, "part")

    def ask(key, table):
        held, column = _texts(table)
        goal = pc.is_in(held.column("id"), value_set=table.filter(pc.equal(table.column("asks"), 1)).column("id").combine_chunks())
        goal = np.asarray(pc.and_(goal, pc.is_valid(held.column("id"))).combine_chunks(), dtype=bool) if held.num_rows else np.zeros(0, bool)
        row, first, second = hashed_bigrams(column)
        out = {c: [] for c in ("bucket", "kind", "low", "high", "b", "t")}
        for kind, code in enumerate((pair_codes(first, second), second)):
            code, at = np.unique(code, return_inverse=True)
            b, t = np.bincount(at, minlength=len(code)), np.bincount(at, weights=goal[row], minlength=len(code))
            bucket, rest = told(code, buckets)
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, bucket[by][1:] != bucket[by][:-1], True]) if len(by) else []
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                i = by[low:high]
                steps = np.diff((rest[i] >> np.uint64(32)).astype("<u2"), prepend=np.uint16(0))
                for c, value in zip(out, (int(bucket[i[0]]), kind, rest[i].astype("<u4").tobytes(), *map(_squeezed, (steps, b[i].astype("<u4"), t[i].astype("<u4")))), strict=True):
                    out[c].append(value)
        n = len(out["bucket"])
        return pa.table([pa.array(out["bucket"], pa.int64()), pa.array(out["kind"], pa.int32()), pa.array([key[0].as_py()] * n, pa.int64()), *(pa.array(out[c], pa.binary()) for c in ("low", "high", "b", "t"))], names=["bucket", "kind", "part", "low", "high", "b", "t"])

    def answered(held: list[dict]) -> pa.RecordBatch:
        sizes = [len(h["low"]) // 4 for h in held]
        low = np.concatenate([np.frombuffer(h["low"], "<u4") for h in held]).astype(np.uint64)
        high = np.concatenate([np.cumsum(_read(h["high"], "<u2", n), dtype="<u2") for h, n in zip(held, sizes, strict=True)]).astype(np.uint64)
        _, at = np.unique(high << np.uint64(32) | low, return_inverse=True)
        counts = ([_read(h[c], "<u4", n) for h, n in zip(held, sizes, strict=True)] for c in ("b", "t"))
        b, t = (np.bincount(at, weights=np.concatenate(c)).astype("<u4")[at] for c in counts)
        cuts = np.cumsum([0, *sizes])
        slices = list(zip(cuts[:-1], cuts[1:], strict=True))
        names = [pa.array([h[c] for h in held], kind) for c, kind in (("part", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()))]
        return pa.RecordBatch.from_arrays([*names, *(pa.array([_squeezed(v[low:high]) for low, high in slices], pa.binary()) for v in (b, t))], names=["part", "kind", "bucket", "b", "t"])

    def answer(batches):
        now, held = None, []
        for batch in batches:
            for question in batch.to_pylist():
                key = question["bucket"], question["kind"]
                if key != now and held:
                    yield answered(held)
                    held = []
                now = key
                held.append(question)
        if held:
            yield answered(held)

    asked = dealt.groupBy("part").applyInArrow(ask, _QUESTION)
    answers = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(answer, _ANSWER)

    def finish(left, right):
        held, column = _texts(left)
        row, first, second = hashed_bigrams(column)
        counted = []
        for kind, code in enumerate((pair_codes(first, second), second)):
            code, at, place = np.unique(code, return_index=True, return_inverse=True)
            own = right.filter(pc.equal(right.column("kind"), kind)).sort_by("bucket")
            bucket = told(code, buckets)[0]
            by, sizes = np.argsort(bucket, kind="stable"), np.unique(bucket, return_counts=True)[1].tolist()
            sums = []
            for c in ("b", "t"):
                sums.append(np.empty(len(code)))
                sums[-1][by] = np.concatenate([_read(blob, "<u4", n) for blob, n in zip(own.column(c).to_pylist(), sizes, strict=True)] or [np.zeros(0)])
            counted.append((code, at, place, *sums))
        (_, at, place, pair_b, pair_t), (word, _, _, word_b, word_t) = counted
        head, tail = np.searchsorted(word, first[at]), np.searchsorted(word, second[at])
        prior = mass * word_b[tail] / max(total, 1)
        n = len(column)
        tokens = np.bincount(row, minlength=n)
        means = [np.bincount(row, weights=-np.log((pair + prior) / (single[head] + mass))[place], minlength=n) / np.maximum(tokens, 1) for pair, single in ((pair_t, word_t), (pair_b, word_b))]
        return pa.table([held.column("id"), pa.array(tokens.astype(np.int64)), pa.array(means[0]), pa.array(means[1]), pa.array(means[0] - means[1])], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    met = dealt.groupBy("part").cogroup(answers.repartition(parts, "part").groupBy("part"))
    return met.applyInArrow(finish, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def oracle_sql(mass: float, digits: int = 6) -> str:
    """The same scores for DuckDB, over the views documents and labels (target: documents labelled good and not toxic)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH texts AS (
  SELECT d.doc_id, l.doc_id IS NOT NULL AS wanted, list_filter(string_split_regex(translate(coalesce(d.text, ''), '{upper}', '{lower}'), '[\\x09-\\x0D ]+'), lambda w: w <> '') AS words
  FROM documents d LEFT JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(toxic) = 0) l ON d.doc_id = l.doc_id
), tokens AS (
  SELECT doc_id, wanted, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM texts
  UNION ALL SELECT doc_id, wanted, '' AS word, len(words) + 1 AS place FROM texts
), bigrams AS (
  SELECT doc_id, wanted, coalesce(lag(word) OVER (PARTITION BY doc_id ORDER BY place), '') AS head, word AS tail FROM tokens
), pairs AS (SELECT head, tail, count(*) AS b, count(*) FILTER (wanted) AS t FROM bigrams GROUP BY ALL
), firsts AS (SELECT head, sum(b) AS b, sum(t) AS t FROM pairs GROUP BY head
), seconds AS (SELECT tail, sum(b) / (SELECT count(*) FROM tokens) AS share FROM pairs GROUP BY tail
), losses AS (
  SELECT p.head, p.tail, -ln((p.t + {mass} * s.share) / (f.t + {mass})) AS t, -ln((p.b + {mass} * s.share) / (f.b + {mass})) AS b
  FROM pairs p JOIN firsts f ON p.head = f.head JOIN seconds s ON p.tail = s.tail
)
SELECT doc_id, count(*) AS n_tokens, round(avg(l.t), {digits}) AS target_loss, round(avg(l.b), {digits}) AS background_loss, round(avg(l.t) - avg(l.b), {digits}) AS score
FROM bigrams g JOIN losses l ON g.head = l.head AND g.tail = l.tail GROUP BY doc_id"""
