"""Removal of repeated passages with suffix arrays built block by block over a difference cover.

A byte goes when a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id.

1. Exact copies: of documents with one text only the smallest id stays in the comparison; the others repeat it whole.
2. Suffix buckets: every string of ``length`` bytes has a minimizer, the k-gram of smallest hash in it (the leftmost,
   on ties). Equal strings have equal minimizers, so the minimizer's hash deals suffixes to buckets, and neighbouring
   suffixes of one minimizer travel as one stretch of text instead of one string each. A first, narrow exchange of
   the hashes alone tells each document which of its minimizers another document has too; only stretches around those
   are sent. Hashes met several times in one batch travel once, and so do equal stretches of one batch: all of its documents
   but the smallest lose such a stretch at once, and only the smallest is sent. So a passage that very many documents share
   reaches a task once for each batch.
3. One bucket at a time, in the order of a sorted exchange: equal stretches are merged (a stretch keeps its smallest document), and the suffixes of what
   is left are sorted. The suffixes at the positions of a difference cover modulo 13 (0, 1, 3, 9: any two positions
   have offsets under 13 at which both lie in the cover) are ranked once by their leading bytes; all others are
   sorted by the bytes before the next cover position, and long ties are resolved by the ranks of cover
   positions. A bucket is sorted in parts, by its minimizers' bytes, of about ``part_bytes`` of stretches each. Memory is bounded by
   the bucket's stretches and one part's sort, and there is a bucket for every ``bucket_bytes`` of text.
4. In the sorted bucket, suffixes that agree in ``length`` bytes are neighbours; the smallest document of each such
   group keeps the bytes, the others lose them.

Documents shorter than ``length`` bytes lose nothing, null texts count as empty, rows without a doc_id take no part and
lose nothing. Rows of one doc_id are one document's texts: they never remove bytes from each other, and equal rows get
equal results. Empty table: no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomledger.llm.common import split_batches, text_bytes

#: A perfect difference set: every residue modulo 13 is a difference of two of its members.
COVER_MODULUS, COVER = 13, (0, 1, 3, 9)
#: Bytes of the grams that minimizers are chosen from, and bits of their hashes that are exchanged beside the bucket.
_K, _TOLD = 26, 40
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def _gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes at every position; raw has k bytes of padding at its end."""
    n = len(raw) - k
    hashes = np.zeros(n, dtype=np.uint64)
    for at in [*range(0, k - 7, 8), *([k - 8] if k % 8 else [])]:
        hashes ^= np.ndarray((n,), "<u8", raw, offset=at, strides=(1,))
        hashes *= _MIX[0]
        hashes ^= hashes >> np.uint64(29)
    hashes *= _MIX[1]
    hashes ^= hashes >> np.uint64(32)
    return hashes


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, k: int = _K) -> dict[str, np.ndarray]:
    """Of all strings of the given length inside the rows: row, hash and position of their minimizers, in order, and first and last start of the strings that have it."""
    sizes = np.diff(offsets)
    n = len(raw)
    empty = {c: np.zeros(0, np.int64) for c in ("row", "at", "first", "last")} | {"hash": np.zeros(0, np.uint64)}
    if n < length or not (sizes >= length).any():
        return empty
    hashes = _gram_hashes(np.concatenate([raw, np.zeros(k, np.uint8)]), k)
    window = length - k + 1
    best, where, span = hashes.copy(), np.arange(n, dtype=np.int32), 1
    while span < window:
        step = min(span, window - span)
        later = best[step:] < best[:-step]
        best = np.where(later, best[step:], best[:-step])
        where = np.where(later, where[step:], where[:-step])
        span += step
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[: len(where)]
    starts = np.flatnonzero(np.arange(len(where)) + length <= offsets[1:][row])
    chosen = where[starts]
    new = np.r_[True, (chosen[1:] != chosen[:-1]) | (row[starts[1:]] != row[starts[:-1]])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)] - 1
    at = chosen[first].astype(np.int64)
    return {"row": row[starts[first]].astype(np.int64), "hash": hashes[at], "at": at, "first": starts[first], "last": starts[last]}


def batch_anchors(batch: pa.RecordBatch, length: int, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Bytes and offsets of a batch's texts, and their anchors, found a piece at a time to bound memory."""
    raw, offsets = text_bytes(batch.column("text"))
    parts, row = [], 0
    for part in split_batches(iter([batch.select(["text"])]), "text", piece):
        found = anchors(*text_bytes(part.column("text")), length)
        for c in ("at", "first", "last"):
            found[c] += offsets[row]
        found["row"] += row
        parts.append(found)
        row += part.num_rows
    return raw, offsets, {c: np.concatenate([p[c] for p in parts]) for c in ("row", "hash", "at", "first", "last")}


def _gather(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    stop = np.cumsum(size)
    return raw[np.repeat(begin - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]


def _words(raw: np.ndarray, positions: np.ndarray, at: int) -> np.ndarray:
    """Eight bytes from each position + at on, as a big-endian number: numbers sort as the bytes do."""
    return np.ndarray((len(raw) - 7 - at,), ">u8", raw, offset=at, strides=(1,))[positions].astype(np.uint64)


def _dense(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by several keys (the first leads), and the rank of each row among the distinct rows."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    if len(order):
        new[0] = True
    for key in keys:
        inside = key[order]
        new[1:] |= inside[1:] != inside[:-1]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new) - 1
    return order, rank


def suffix_groups(text: np.ndarray, residue: np.ndarray, suffixes: np.ndarray, length: int) -> np.ndarray:
    """For each suffix the number of its group: suffixes of one group agree in their first length bytes. Groups are numbered by alignment, then in lexicographic order.

    text: the bucket's bytes with length + 16 bytes of padding; residue: each byte's position, counted so that two
    equal stretches have equal residues where they agree. All suffixes have length bytes before their stretch ends."""
    covered = np.zeros(COVER_MODULUS, dtype=bool)
    covered[list(COVER)] = True
    # Bytes to the next position of the cover, by residue: at most the largest gap of the cover.
    ahead = np.array([next(d for d in range(COVER_MODULUS) if covered[(r + d) % COVER_MODULUS]) for r in range(COVER_MODULUS)])
    tail = length - int(ahead.max())
    is_sample = covered[residue % COVER_MODULUS]
    needed = np.unique(suffixes + ahead[residue[suffixes] % COVER_MODULUS])
    assert is_sample[needed].all()
    words = [*range(0, tail - 7, 8), *([tail - 8] if tail % 8 else [])]
    _, rank = _dense([_words(text, needed, at) for at in words])
    sample_rank = np.zeros(len(text), dtype=np.int64)
    sample_rank[needed] = rank
    # The bytes ahead of the cover position, then the cover position's rank, then what the rank doesn't reach.
    gap = ahead[residue[suffixes] % COVER_MODULUS]
    head = _words(text, suffixes, 0) & ~((np.uint64(1) << (np.uint64(8) * (np.uint64(8) - np.minimum(gap, 7).astype(np.uint64)))) - np.uint64(1))
    head[gap == 0] = 0
    rest = _words(text, suffixes, length - 8)
    _, group = _dense([gap, head, sample_rank[suffixes + gap], rest])
    return group


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, behind its size and theirs."""
    raw = b"".join(a.tobytes() for a in arrays)
    head = np.array([len(raw), *(len(a) for a in arrays)], dtype=np.int64)
    return head.tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, *types) -> list[np.ndarray]:
    head = np.frombuffer(blob, np.int64, 1 + len(types))
    raw, at, out = pa.decompress(blob[8 * len(head) :], int(head[0]), codec="zstd", asbytes=True), 0, []
    for n, kind in zip(head[1:].tolist(), types, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _places(row: np.ndarray, docs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in order of row, as documents (each one's difference from the one before), places a document and differences of positions."""
    edge = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    starts = np.flatnonzero(edge)
    who = docs[row[starts]]
    steps = np.diff(at, prepend=0)
    steps[starts] = at[starts]
    return np.diff(who, prepend=0), np.diff(np.r_[starts, len(row)]).astype(np.uint32), steps.astype(np.uint32)


def _placed(who: np.ndarray, counts: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents and positions of _places."""
    counts, total = counts.astype(np.int64), np.cumsum(steps.astype(np.int64))
    starts = np.cumsum(counts) - counts
    return np.repeat(np.cumsum(who), counts), total - np.repeat(total[starts] - steps[starts], counts)


def _shared(hashes: np.ndarray, flags: np.ndarray, docs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and positions of those whose hash is flagged or has several documents."""
    order = np.argsort(hashes, kind="stable")
    hashes, flags, docs, at = hashes[order], flags[order], docs[order], at[order]
    starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
    if not len(starts):
        return docs, at
    several = (np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts)) | np.logical_or.reduceat(flags, starts)
    keep = np.repeat(several, np.diff(np.r_[starts, len(hashes)]))
    return docs[keep], at[keep]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(_TOLD)) % np.uint64(buckets)).astype(np.int64)


def _buckets(batches):
    """Each bucket's number and blobs, one bucket at a time; the rows come sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if b != now and held:
                yield now, held
                held = []
            now = b
            held.append(blob)
    if held:
        yield now, held


def shared_anchors(texts: DataFrame, length: int, buckets: int, per_batch: int = 8 << 20) -> DataFrame:
    """doc (a number) and positions of the minimizers that several documents have. texts: doc long, text.

    Of a hash its bucket and _TOLD more bits travel: a chance agreement only costs a comparison later."""

    def ask(batches):
        for batch in split_batches(batches, "text", per_batch):
            _, offsets, found = batch_anchors(batch, length)
            docs = np.asarray(batch.column("doc"), dtype=np.int64)
            row, hashes = found["row"], found["hash"]
            at = (found["at"] - offsets[row]).astype(np.int64)
            if not len(hashes):
                continue
            order = np.argsort(hashes, kind="stable")
            sorted_, doc = hashes[order], docs[row[order]]
            starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
            several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
            # Known to be shared already: an answer, dealt anywhere, and one question for the other batches' sake.
            answered, asked = np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=bool)
            answered[order] = np.repeat(several, np.diff(np.r_[starts, len(hashes)]))
            asked[order[starts]] = True
            q = np.flatnonzero(asked | ~answered)
            bucket = _bucket(hashes[q], buckets)
            by = np.argsort(bucket, kind="stable")
            q, q_cuts = q[by], np.searchsorted(bucket[by], np.arange(buckets + 1))
            a = np.flatnonzero(answered)
            a_cuts = np.linspace(0, len(a), buckets + 1).astype(np.int64)
            told = hashes & np.uint64((1 << _TOLD) - 1)
            used, blobs = [], []
            for b in range(buckets):
                i, j = q[q_cuts[b] : q_cuts[b + 1]], a[a_cuts[b] : a_cuts[b + 1]]
                if len(i) + len(j):
                    used.append(b)
                    blobs.append(_packed((told[i] >> np.uint64(8)).astype(np.uint32), told[i].astype(np.uint8), answered[i], *_places(row[i], docs, at[i]), *_places(row[j], docs, at[j])))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def answer(batches):
        for _, blobs in _buckets(batches):
            asked, known = [], []
            for blob in blobs:
                high, low, flags, *places = _unpacked(blob, np.uint32, np.uint8, bool, np.int64, np.uint32, np.uint32, np.int64, np.uint32, np.uint32)
                asked.append((high.astype(np.uint64) << np.uint64(8) | low, flags, *_placed(*places[:3])))
                known.append(_placed(*places[3:]))
            for docs, at in (_shared(*(np.concatenate(c) for c in zip(*asked, strict=True))), *known):
                for low in range(0, len(docs), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(docs[low : low + (1 << 18)]), pa.array(at[low : low + (1 << 18)].astype(np.int32))], names=["doc", "at"])

    questions = texts.mapInArrow(ask, "bucket int, blob binary")
    pairs = questions.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, "doc long, at int")
    return pairs.groupBy("doc").agg(F.collect_list("at").alias("positions"))


def _kinds(begin: np.ndarray, size: np.ndarray, lead: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of stretches, and the number of each one's kind: equal size, lead and bytes."""
    padded = np.concatenate([text, np.zeros(int(size.max()) + 16, np.uint8)])
    keys = [size, lead]
    for at in range(0, int(size.max()), 8):
        word = _words(padded, begin, at)
        over = np.clip(at + 8 - size, 0, 8).astype(np.uint64)
        mask = np.where(over >= 8, np.uint64(0), ~((np.uint64(1) << (np.uint64(8) * np.minimum(over, np.uint64(7)))) - np.uint64(1)))
        keys.append(word & mask)
    return _dense(keys)


def lost_at_once(hashes: np.ndarray, doc: np.ndarray, begin: np.ndarray, size: np.ndarray, lead: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Whether a smaller document of the batch has the same stretch. Only stretches whose minimizer several documents have are compared."""
    lost = np.zeros(len(hashes), dtype=bool)
    order = np.argsort(hashes, kind="stable")
    starts = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]])
    several = np.minimum.reduceat(doc[order], starts) != np.maximum.reduceat(doc[order], starts)
    some = order[np.repeat(several, np.diff(np.r_[starts, len(order)]))]
    if len(some):
        _, kind = _kinds(begin[some], size[some], lead[some], raw)
        least = np.full(int(kind.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, kind, doc[some])
        lost[some] = doc[some] > least[kind]
    return lost


def stretches(asked: DataFrame, length: int, buckets: int) -> DataFrame:
    """bucket and packed stretches around the shared minimizers, with the spans that the batch answers by itself. asked: doc, key (a number for the row), text, positions."""
    if length > 1 << 14:
        raise ValueError("strings of over 16384 bytes aren't supported")

    def run(batches):
        for whole in batches:
            for batch in split_batches(iter([whole]), "text", 8 << 20):
                raw, offsets, found = batch_anchors(batch, length)
                if not len(found["row"]):
                    continue
                lists = batch.column("positions")
                counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
                wanted = np.asarray(pc.list_flatten(lists), dtype=np.int64) + np.repeat(offsets[:-1], counts)
                keep = np.flatnonzero(np.isin(found["at"], wanted))
                if not len(keep):
                    continue
                row, first, last, at, hashes = (found[c][keep] for c in ("row", "first", "last", "at", "hash"))
                docs, keys = (np.asarray(batch.column(c), dtype=np.int64) for c in ("doc", "key"))
                size, lead, start = last - first + length, at - first, first - offsets[row]
                lost = lost_at_once(hashes, docs[row], first, size, lead, raw)
                bucket = _bucket(hashes, buckets)
                send, known = np.flatnonzero(~lost), np.flatnonzero(lost)
                by = send[np.argsort(bucket[send], kind="stable")]
                cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
                used = np.flatnonzero(np.diff(cuts)).tolist()
                # What is answered already goes along, dealt evenly.
                shares = np.linspace(0, len(known), len(used) + 1).astype(np.int64)
                blobs = []
                for n, b in enumerate(used):
                    i, j = by[cuts[b] : cuts[b + 1]], known[shares[n] : shares[n + 1]]
                    who, times, steps = _places(row[i], docs, start[i])
                    here = row[i][np.cumsum(times) - times]
                    known_who, known_times, known_steps = _places(row[j], docs, start[j])
                    known_here = row[j][np.cumsum(known_times) - known_times] if len(j) else row[:0]
                    blobs.append(_packed(who, keys[here], times, steps, lead[i].astype(np.uint16), size[i].astype(np.uint16), _gather(raw, first[i], size[i]), known_who, keys[known_here], known_times, known_steps, size[j].astype(np.uint16)))
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return asked.mapInArrow(run, "bucket int, blob binary")


def _stretches_of(blob: bytes) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Document, row key, first start, lead, size and bytes of a blob's stretches; document, row key, first start and size of those lost already."""
    who, keys, times, steps, lead, size, text, *known = _unpacked(blob, np.int64, np.int64, np.uint32, np.uint32, np.uint16, np.uint16, np.uint8, np.int64, np.int64, np.uint32, np.uint32, np.uint16)
    doc, first = _placed(who, times, steps)
    lost_doc, lost_first = _placed(known[0], known[2], known[3])
    return (doc, np.repeat(keys, times), first, lead.astype(np.int64), size.astype(np.int64), text), (lost_doc, np.repeat(known[1], known[2]), lost_first, known[4].astype(np.int64))


def repeated_starts(doc: np.ndarray, first: np.ndarray, lead: np.ndarray, size: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket's stretches: (stretch, first start, last start) of runs of strings that a smaller document has too."""
    begin = np.cumsum(size) - size
    # Merge equal stretches: equal size, lead and bytes.
    order, kind = _kinds(begin, size, lead, text)
    kinds = int(kind.max()) + 1
    least = np.full(kinds, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, doc)
    sample = np.empty(kinds, dtype=np.int64)
    sample[kind[order[::-1]]] = order[::-1]
    # The bucket's text: one stretch of each kind, positions counted from its minimizer.
    k_size, k_lead = size[sample], lead[sample].astype(np.int64)
    bucket_text = np.concatenate([_gather(text, begin[sample], k_size), np.zeros(length + 16, np.uint8)])
    k_begin = np.cumsum(k_size) - k_size
    within = np.arange(int(k_size.sum())) - np.repeat(k_begin, k_size)
    residue = np.concatenate([(within - np.repeat(k_lead, k_size)) % COVER_MODULUS, np.zeros(length + 16, np.int64)])
    starts = k_size - length + 1
    owner = np.repeat(np.arange(kinds), starts)
    inside = np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts)
    suffixes = k_begin[owner] + inside
    group = suffix_groups(bucket_text, residue, suffixes, length)
    smallest = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, group, least[owner])
    keeper = smallest[group]
    # A document above its kind's smallest loses every string of the stretch.
    above = np.flatnonzero(doc > least[kind])
    out = [(above, first[above], first[above] + size[above] - length)]
    # The smallest of a kind loses those strings that still smaller documents have in other stretches.
    lost = keeper < least[owner]
    edge = np.flatnonzero(lost & ~(np.r_[False, lost[:-1]] & np.r_[False, owner[1:] == owner[:-1]]))
    last = np.flatnonzero(lost & ~(np.r_[lost[1:], False] & np.r_[owner[1:] == owner[:-1], False]))
    if len(edge):
        runs_of, from_, to = owner[edge], inside[edge], inside[last]
        rows = np.flatnonzero(doc == least[kind])
        rows = rows[np.argsort(kind[rows], kind="stable")]
        low, high = np.searchsorted(kind[rows], runs_of, "left"), np.searchsorted(kind[rows], runs_of, "right")
        times = high - low
        row = rows[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
        out.append((row, first[row] + np.repeat(from_, times), first[row] + np.repeat(to, times)))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _dealt(doc: np.ndarray, key: np.ndarray, first: np.ndarray, lead: np.ndarray, size: np.ndarray, text: np.ndarray, many: int) -> list[tuple[np.ndarray, ...]]:
    """The stretches of a blob in so many parts; those of equal minimizers come into the same part of every blob."""
    begin = np.cumsum(size) - size
    mixed = np.zeros(len(doc), dtype=np.uint64)
    for at in (*range(0, _K - 7, 8), _K - 8):
        mixed = (mixed ^ _words(text, begin + lead, at)) * _MIX[0]
        mixed ^= mixed >> np.uint64(29)
    part = (mixed % np.uint64(many)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(many + 1))
    return [(doc[i], key[i], first[i], lead[i], size[i], _gather(text, begin[i], size[i])) for i in (order[low:high] for low, high in zip(cuts[:-1], cuts[1:], strict=True))]


def _merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals [first, last) as sorted, separate intervals; touching ones join."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.r_[True, first[1:] > last[:-1]]
    ends = np.flatnonzero(np.r_[new[1:], True])
    return first[new], last[ends]


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_bytes, the kept bytes of every row."""

    def finish(batches):
        for whole in batches:
            for batch in split_batches(iter([whole]), "text", 4 << 20):
                out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
                for n, removed, spans, own in _kept(batch, length):
                    kept = own.tobytes()
                    for c, v in zip(out, (n, removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None), strict=True):
                        out[c].append(v)
                types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()} | ({"kept": pa.binary()} if keep_bytes else {})
                yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(out[c], type=t) for c, t in types.items())], names=["doc_id", *types])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_bytes else "")
    return _with_spans(docs, length, id_col, text_col).select("doc", "text", "keeps", "spans").mapInArrow(finish, schema)


def without_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of docs, with all their columns, their texts without the repeated bytes (what is left of a character cut through goes too) and the number of characters anew."""
    columns = docs.columns

    def finish(batches):
        for whole in batches:
            at = 0
            for batch in split_batches(iter([whole]), "text", 4 << 20):
                texts = pa.array([own.tobytes().decode("utf-8", "ignore") for _, _, _, own in _kept(batch, length)], pa.string())
                row = whole.slice(at, batch.num_rows).column("row")
                at += batch.num_rows
                fields = {f.name: row.field(i) for i, f in enumerate(row.type)} | {text_col: texts}
                if chars_col in fields:
                    fields[chars_col] = pc.utf8_length(texts).cast(fields[chars_col].type)
                yield pa.RecordBatch.from_arrays([fields[c] for c in columns], names=columns)

    row = F.struct(*(F.col(f"`{c}`") for c in columns if c != text_col), F.lit(None).cast("string").alias(text_col)).alias("row")
    return _with_spans(docs, length, id_col, text_col, row).select("text", "keeps", "spans", "row").mapInArrow(finish, docs.schema)


def _kept(batch: pa.RecordBatch, length: int):
    """Bytes, removed bytes, removed runs and what is left of every text of a batch of text, keeps, spans."""
    raw, offsets = text_bytes(batch.column("text"))
    keeps, lists = batch.column("keeps").to_pylist(), batch.column("spans")
    counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    flat, at = pc.list_flatten(lists), 0
    lows, highs = (np.asarray(pc.struct_field(flat, f), dtype=np.int64) for f in ("low", "high"))
    for i in range(batch.num_rows):
        own, n = raw[offsets[i] : offsets[i + 1]], int(offsets[i + 1] - offsets[i])
        removed, spans = 0, 0
        if not keeps[i] and n >= length:
            removed, spans, own = n, 1, own[:0]
        elif counts[i] and keeps[i]:
            first, last = _merged(lows[at : at + counts[i]], highs[at : at + counts[i]])
            mark = np.zeros(n + 1, dtype=np.int8)
            mark[first] = 1
            mark[last] -= 1
            own = own[np.cumsum(mark[:n], dtype=np.int32) == 0]
            removed, spans = int((last - first).sum()), len(first)
        at += counts[i]
        yield n, removed, spans, own


def _with_spans(docs: DataFrame, length: int, id_col: str, text_col: str, *more, bucket_bytes: int = 16 << 20, part_bytes: int = 4 << 20) -> DataFrame:
    """doc, text, keeps (no smaller document has the whole text), spans (low, high) that go, and more columns, of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.col(id_col).cast("long")
    # Buckets of about so many bytes each, and enough of them to go round where there is little text.
    buckets = max(32, 1 + (docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0) // bucket_bytes)
    # The key tells apart the texts of one id, nothing else. Rows without an id stand beside those of id 0, which costs only
    # repeated spans: a join key without nulls lets both joins use one exchange of the texts.
    at, key = F.coalesce(doc, F.lit(0)).alias("at"), F.xxhash64(F.sha2(text, 256)).alias("key")
    rows = docs.select(doc.alias("doc"), at, key, text.alias("text"))
    # Exact copies: the smallest document of each text is compared, the others repeat it.
    digests = docs.where(F.col(id_col).isNotNull() & (F.octet_length(text) >= length)).select(doc.alias("doc"), F.sha2(text, 256).alias("digest")).distinct()
    least = digests.groupBy("digest").agg(F.min("doc").alias("doc"))
    keepers = least.select(F.coalesce("doc", F.lit(0)).alias("at"), F.xxhash64("digest").alias("key"))
    shared = shared_anchors(rows.where(F.col("doc").isNotNull() & (F.octet_length("text") >= length)).select("doc", "text"), length, buckets)
    wanted = keepers.join(shared.withColumnRenamed("doc", "at"), "at").select("at", "key", "positions")
    # Both joins take the same columns of the texts, or they would be exchanged twice.
    asked = rows.join(wanted, ["at", "key"]).select(F.coalesce("doc", "at").alias("doc"), "key", "text", "positions")

    def spans(doc: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray):
        for i in range(0, len(doc), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 18)]) for c in (doc, key, low, high)], names=["doc", "key", "low", "high"])

    def dedup(batches):
        for _, blobs in _buckets(batches):
            many = 1 + sum(int(np.frombuffer(blob, np.int64, 1)[0]) for blob in blobs) // part_bytes
            parts = [[] for _ in range(many)]
            while blobs:
                sent, (doc, key, first, size) = _stretches_of(blobs.pop())
                yield from spans(doc, key, first, first + size)
                for part, held in zip(_dealt(*sent, many), parts, strict=True):
                    held.append(part)
            while parts:
                doc, key, *rest = (np.concatenate(c) for c in zip(*parts.pop(), strict=True))
                if len(doc):
                    at, low, high = repeated_starts(doc, *rest, length)
                    yield from spans(doc[at], key[at], low, high + length)

    found = stretches(asked, length, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(dedup, "doc long, key long, low long, high long")
    by_row = found.groupBy(F.col("doc").alias("at"), "key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    kept = keepers.select("at", "key", F.lit(True).alias("keeps")).join(by_row, ["at", "key"], "left")
    if more:
        rows = docs.select(doc.alias("doc"), at, key, text.alias("text"), *more)
    nameless = F.col("doc").isNull()
    return rows.join(kept, ["at", "key"], "left").withColumn("keeps", nameless | F.coalesce("keeps", F.lit(False))).withColumn("spans", F.when(~nameless, F.col("spans")))
