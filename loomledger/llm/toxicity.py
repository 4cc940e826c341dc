"""Toxicity by a subsequence string kernel and a support vector machine on Nystroem landmarks.

Kernel: K(s, t) sums, over all subsequences u of three characters that span at most six places, decay^span in s times
decay^span in t, scaled by the strings' norms. A gap or an inserted character lowers a match without ending it; signs
between letters are dropped, letters spelled apart ("i d i o t") are joined, accents are characters of their own and
digits are read as the letters they imitate. A word's start and end are characters too, and subsequences run over them.

Training: two machines with one kernel, each linear with squared hinge loss on the Nystroem features of landmarks.

* The sentence machine's instances are the labelled documents' sentences, in windows of 24 characters that overlap by half. A
  sentence has its document's label: every sentence of a clean document is clean, of a toxic one at least one is toxic. So in
  each round a job picks from every toxic document the sentence window that scores highest and from every clean one the two
  highest and one by hash, and the machine learns from all windows picked so far. The first round picks with the word machine's table.
* The word machine's instances are the same sentences' words: first, words that are significantly more frequent in toxic than
  in clean documents; then it picks the best words of each toxic document itself, and learns again.

Copies with an inserted character are added, so the margin allows for them. Training sets are bounded by parameters of
``fit`` (documents of each label, landmarks, clean words, copied instances); what is bounded is the fit, not the scoring. A
logistic layer turns a document's three highest word scores, the number of positive words, their share and its two highest
sentence scores into a probability.

Scoring: the machines are linear in the subsequences, so landmarks, projection and weights fold into a table of 32^3
numbers each, and a place costs a few look-ups. Every word and every sentence of every text is scored; equal ones of a batch once.

Null and empty texts have no words and get the lowest score. Without labels of both classes every score is 0. Empty table:
no rows. Repeated rows are scored each. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomledger.llm.common import bounded_sample, crc32_of, labelled, split_batches, words_of, written

DECAY, SPAN, WINDOW = 0.6, 5, 24
_START, _END, _SIZE = 30, 31, 32
_STEPS = [(i, j) for i in range(1, SPAN) for j in range(1, SPAN) if i + j <= SPAN]
#: Digits as the letters they imitate.
_LOOK = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
_CODE = np.zeros(256, dtype=np.uint8)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz", 1):
    _CODE[ord(_c)] = _i
for _d in "0123456789":
    _CODE[ord(_d)] = _CODE[ord(_LOOK[_d])] if _d in _LOOK else 27
_CODE[0x80:0xC0] = 28 + (np.arange(64) & 1)
#: White space in a sentence: the end of a word and the start of the next one.
_SPACE = "\x1f\x1e"
_CODE[0x1E], _CODE[0x1F] = _START, _END
#: Where a sentence ends.
_BREAK = r"[.!?]+\s+|[\r\n]+"
#: Floor of a score, and the score of a word or sentence that isn't there.
_FLOOR = -1.0


def window_blocks(names: pa.Array, step: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Character codes of each name, in windows of WINDOW codes that overlap by half, and the name of each window; so many windows at a time.

    Rows are padded with zero; names without a letter have no window."""
    if not len(names):
        return
    folded = pc.utf8_normalize(pc.utf8_lower(names), form="NFKD").cast(pa.large_string())
    offsets = np.frombuffer(folded.buffers()[1], dtype=np.int64)[folded.offset : folded.offset + len(folded) + 1]
    raw = np.frombuffer(folded.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    codes = _CODE[raw]
    kept = np.concatenate([[0], np.cumsum(codes > 0)])
    ends = kept[offsets - offsets[0]]
    letters, size = codes[codes > 0], np.diff(ends)
    named = np.flatnonzero(size)
    size = size[named] + 2
    begin = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()) + WINDOW, dtype=np.uint8)
    flat[begin] = _START
    flat[begin + size - 1] = _END
    inner = np.ones(len(flat), dtype=bool)
    inner[begin] = inner[begin + size - 1] = False
    inner[int(size.sum()) :] = False
    flat[inner] = letters
    half = WINDOW // 2
    times = np.maximum(1, -(-(size - WINDOW) // half) + 1)
    after = np.cumsum(times)
    for low in range(0, int(times.sum()), step):
        number = np.arange(low, min(low + step, int(after[-1])))
        owner = np.searchsorted(after, number, side="right")
        shift = (number - after[owner] + times[owner]) * half
        at = (begin[owner] + shift)[:, None] + np.arange(WINDOW)
        valid = shift[:, None] + np.arange(WINDOW) < size[owner][:, None]
        yield np.where(valid, flat[np.minimum(at, len(flat) - 1)], 0).astype(np.int32), named[owner]


def windows(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All of window_blocks at once."""
    found = [*window_blocks(names)]
    if not found:
        return np.zeros((0, WINDOW), np.int32), np.zeros(0, np.int64)
    return np.concatenate([c for c, _ in found]), np.concatenate([o for _, o in found])


def document_sentences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Sentences of each text: row of each sentence, index of each sentence, the distinct sentences."""
    lists = pc.split_pattern_regex(column, _BREAK)
    rows = np.repeat(np.arange(len(column), dtype=np.int64), np.asarray(pc.list_value_length(lists), dtype=np.int64))
    spaced = pc.replace_substring_regex(pc.ascii_trim_whitespace(pc.list_flatten(lists)), r"\s+", _SPACE)
    coded = spaced.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return rows, np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def _norms(codes: np.ndarray) -> np.ndarray:
    there = codes > 0
    total = np.zeros(len(codes))
    for i, j in _STEPS:
        total += DECAY ** (2 * (i + j)) * (there[:, : WINDOW - i - j] & there[:, i : WINDOW - j] & there[:, i + j :]).sum(axis=1)
    return np.sqrt(np.maximum(total, 1e-12))


def kernel_scores(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Inner product of each window's normed subsequences with a table of 32^3 weights."""
    out = np.empty(len(codes))
    length = (codes > 0).sum(axis=1)
    for low, high in ((0, 8), (8, 14), (14, WINDOW)):
        rows = np.flatnonzero((length > low) & (length <= high))
        if not len(rows):
            continue
        part = codes[rows, :high]
        total = np.zeros(len(rows), dtype=np.float32)
        for i, j in _STEPS:
            if i + j < high:
                total += np.float32(DECAY ** (i + j)) * table[part[:, : high - i - j] * 1024 + part[:, i : high - j] * 32 + part[:, i + j :]].sum(axis=1)
        out[rows] = total / _norms(codes[rows])
    return out


def subsequence_table(codes: np.ndarray) -> np.ndarray:
    """The normed subsequences of one window as a table of 32^3 weights."""
    table = np.zeros(_SIZE**3)
    for i, j in _STEPS:
        a, b, c = codes[: WINDOW - i - j], codes[i : WINDOW - j], codes[i + j :]
        there = (a > 0) & (b > 0) & (c > 0)
        np.add.at(table, (a * 1024 + b * 32 + c)[there], DECAY ** (i + j))
    return table / _norms(codes[None])[0]


def _gram(codes: np.ndarray, tables: np.ndarray, step: int = 2048) -> np.ndarray:
    """kernel_scores of many tables at once: the windows' subsequences are listed one time, so many windows at once."""
    out = np.empty((len(codes), len(tables)), dtype=np.float32)
    for low in range(0, len(codes), step):
        part, rows, keys, weights = codes[low : low + step], [], [], []
        for i, j in _STEPS:
            a, b, c = part[:, : WINDOW - i - j], part[:, i : WINDOW - j], part[:, i + j :]
            row, place = np.nonzero((a > 0) & (b > 0) & (c > 0))
            rows.append(row)
            keys.append((a * 1024 + b * 32 + c)[row, place])
            weights.append(np.full(len(row), DECAY ** (i + j)))
        row, key, weight = (np.concatenate(x) for x in (rows, keys, weights))
        weight /= _norms(part)[row]
        for k, table in enumerate(tables):
            out[low : low + step, k] = np.bincount(row, weights=table[key] * weight, minlength=len(part))
    return out


def _best_windows(names: pa.Array, table: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """The score of each name's best window, and that window's codes."""
    best = np.full(len(names), _FLOOR)
    codes_of = np.zeros((len(names), WINDOW), dtype=np.uint8)
    for codes, owner in window_blocks(names):
        scores = kernel_scores(codes, table) + bias
        order = np.lexsort((-scores, owner))
        first = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
        new = first[(scores[first] > best[owner[first]]) | ~codes_of[owner[first]].any(axis=1)]
        best[owner[new]] = np.maximum(scores[new], _FLOOR)
        codes_of[owner[new]] = codes[new]
    return best, codes_of


def _highest(out: np.ndarray, rows: np.ndarray, index: np.ndarray, scores: np.ndarray) -> None:
    """Fill each row of out with the highest scores of its names, each name once, in falling order."""
    hot = scores[index] > _FLOOR * 0.75
    key = np.unique(rows[hot] * max(1, len(scores)) + index[hot])
    row, value = key // max(1, len(scores)), scores[key % max(1, len(scores))]
    order = np.lexsort((-value, row))
    row, value = row[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    for k in range(out.shape[1]):
        at = place == k
        out[row[at], k] = value[at]


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float, rounds: int = 30, step: int = 2048) -> np.ndarray:
    """Weights (the last one is the bias) of a linear machine: Newton steps on the squared hinge loss, summed so many rows at a time."""
    d = x.shape[1] + 1
    w = np.zeros(d)
    ridge = np.ones(d)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        gradient, curve = ridge * w, np.diag(ridge)
        for low in range(0, len(x), step):
            part = np.hstack([x[low : low + step].astype(np.float64), np.ones((len(x[low : low + step]), 1))])
            sign = y[low : low + step]
            margin = 1 - sign * (part @ w)
            active = margin > 0
            a, c = part[active], cost * weight[low : low + step][active]
            gradient = gradient - 2 * (a.T @ (c * sign[active] * margin[active]))
            curve = curve + 2 * (a.T * c) @ a
        change = np.linalg.solve(curve, gradient)
        w = w - change
        if np.abs(change).max() < 1e-6:
            break
    return w


def _learn(positive: dict[str, float], negative: list[str], landmarks: int, copied: int) -> tuple[np.ndarray, float]:
    """A table and a bias from words: Nystroem features on landmark words, a linear machine on them, folded."""
    rng = np.random.default_rng(11)
    best = sorted(positive, key=lambda t: (-positive[t], t))
    copies = []
    for token in best[:copied]:
        for _ in range(2):
            at = int(rng.integers(1, max(2, len(token))))
            copies.append(token[:at] + "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))] + token[at:])
    names = [*best, *copies, *negative]
    top = max(positive.values())
    weight = np.array([*(positive[t] / top for t in best), *(0.2 * positive[t] / top for t in best[:copied] for _ in range(2)), *[1.0] * len(negative)])
    y = np.array([1.0] * (len(best) + len(copies)) + [-1.0] * len(negative))
    codes, owner = windows(pa.array(names, pa.string()))
    return _machine(codes, y[owner], weight[owner], np.flatnonzero(owner < len(best)), landmarks)


def _machine(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, is_best: np.ndarray, landmarks: int) -> tuple[np.ndarray, float]:
    """A table and a bias from windows: half the landmarks are the first of is_best, half spread over the negative ones."""
    half = landmarks // 2
    is_negative = np.flatnonzero(y < 0)
    chosen = [*is_best[:half], *(is_negative[np.linspace(0, len(is_negative) - 1, half).astype(int)] if len(is_negative) else [])]
    tables = np.stack([subsequence_table(c).astype(np.float32) for c in np.unique(codes[chosen], axis=0)])
    gram = _gram(codes, tables)
    values, vectors = np.linalg.eigh((tables @ tables.T).astype(np.float64))
    keep = values > 1e-4 * values.max()
    projection = vectors[:, keep] / np.sqrt(values[keep])
    balance = np.where(y > 0, weight / weight[y > 0].sum(), weight / max(1e-9, weight[y < 0].sum())) * len(y) / 2
    w = _squared_hinge(gram @ projection.astype(np.float32), y, balance, 1.0)
    return tables.T @ (projection @ w[:-1]).astype(np.float32), float(w[-1])


def _learn_windows(positive: list[bytes], negative: list[bytes], landmarks: int, copied: int) -> tuple[np.ndarray, float]:
    """A table and a bias from sentence windows; the first of positive also with an inserted character."""
    rng = np.random.default_rng(17)
    copies = []
    for window in positive[:copied]:
        at = int(rng.integers(1, WINDOW - 1))
        copies.append((window[:at] + bytes([int(rng.integers(1, 27))]) + window[at:])[:WINDOW] if window[at] else window)
    codes = np.frombuffer(b"".join([*positive, *copies, *negative]), dtype=np.uint8).reshape(-1, WINDOW).astype(np.int32)
    y = np.array([1.0] * (len(positive) + len(copies)) + [-1.0] * len(negative))
    weight = np.array([1.0] * len(positive) + [0.4] * len(copies) + [1.0] * len(negative))
    return _machine(codes, y, weight, np.arange(len(positive)), landmarks)


class ToxicityModel:
    """The folded machines for words and sentences, and the logistic layer over a document's scores."""

    def __init__(self, words: tuple[np.ndarray, float], sentences: tuple[np.ndarray, float], layer: np.ndarray | None = None):
        self.words, self.sentences, self.layer = words, sentences, layer

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Per text: three highest word scores, log of the number of positive words, their share, two highest sentence scores."""
        n = len(column)
        out = np.full((n, 7), _FLOOR)
        rows, index, names = document_words(column)
        scores = word_scores(names, *self.words)
        words = np.bincount(rows, minlength=n)
        _highest(out[:, :3], rows, index, scores)
        positive = np.bincount(rows, weights=scores[index] > 0, minlength=n)
        out[:, 3], out[:, 4] = np.log1p(positive), np.sqrt(positive / np.maximum(words, 1))
        rows, index, names = document_sentences(column)
        _highest(out[:, 5:], rows, index, _best_windows(names, *self.sentences)[0])
        return out

    def probabilities(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.layer[:-1] + self.layer[-1], -30, 30)))


def word_scores(names: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    """The score of each name."""
    best = np.full(len(names), _FLOOR)
    for codes, owner in window_blocks(names):
        np.maximum.at(best, owner, kernel_scores(codes, table) + bias)
    return best


def document_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """words_of, and one more word for each run of three or more single letters: the letters joined."""
    rows, index, names = words_of(column)
    if not len(index):
        return rows, index, names
    single = np.asarray(pc.less_equal(pc.utf8_length(pc.utf8_trim(names, characters=".,;:!?-_*'\"()|")), 1)) & np.asarray(pc.match_substring_regex(names, r"\pL"))
    alone = single[index]
    same = np.r_[False, rows[1:] == rows[:-1]]
    begin = np.flatnonzero(alone & ~(np.r_[False, alone[:-1]] & same))
    end = np.flatnonzero(alone & ~(np.r_[alone[1:], False] & np.r_[same[1:], False])) + 1
    runs = np.flatnonzero(end - begin >= 3)
    if len(runs):
        joined = ["".join(names[int(i)].as_py() for i in index[begin[r] : end[r]]) for r in runs]
        rows, index = np.r_[rows, rows[begin[runs]]], np.r_[index, len(names) + np.arange(len(runs))]
        names = pa.concat_arrays([names, pa.array(joined, names.type)])
        order = np.argsort(rows, kind="stable")
        rows, index = rows[order], index[order]
    return rows, index, names


#: Of so many smallest hashes of their words, copies share at least so many.
SKETCH, SHARED = 16, 12


def _families(documents: list[tuple[int, list[str]]]) -> list[int]:
    """The place of the first document of each family of near copies with one label: copies say no more about words than one of them."""
    seen: dict[tuple[int, int], list[int]] = {}
    kept = []
    for at, (label, tokens) in enumerate(documents):
        sketch = sorted({zlib.crc32(t.encode()) for t in tokens})[:SKETCH]
        met = Counter(i for h in sketch for i in seen.get((label, h), ()))
        if tokens and any(n >= min(SHARED, len(sketch)) for n in met.values()):
            continue
        kept.append(at)
        for h in sketch:
            seen.setdefault((label, h), []).append(at)
    return kept


def _trained(documents: list[tuple[int, list[str]]], landmarks: int, clean_words: int, copied: int) -> tuple[np.ndarray, float] | None:
    """The word machine. documents: (label, distinct words); near copies count once, or the words of one text that is there many times would pass for insults."""
    documents = [documents[i] for i in _families(documents)]
    count = {y: sum(1 for d in documents if d[0] == y) for y in (0, 1)}
    if not count[0] or not count[1]:
        return None
    found = {y: Counter(t for label, tokens in documents if label == y for t in tokens) for y in (0, 1)}
    share = lambda t, y: (found[y][t] + 0.1) / (count[y] + 1)
    ratio = {t: share(t, 1) / share(t, 0) for t in found[1]}

    def surplus(t: str) -> float:
        """How many standard errors the word is more frequent in toxic documents."""
        p1, p0 = found[1][t] / count[1], found[0][t] / count[0]
        p = (found[1][t] + found[0][t]) / (count[0] + count[1])
        return (p1 - p0) / max(1e-12, p * (1 - p) * (1 / count[0] + 1 / count[1])) ** 0.5

    negative = sorted(t for t, n in found[0].items() if ratio.get(t, 0) < 1.5)
    rng = np.random.default_rng(3)
    if len(negative) > clean_words:
        # A third of them the most frequent, the others drawn.
        common = sorted(negative, key=lambda t: (-found[0][t], t))[: clean_words // 3]
        negative = sorted({*common, *(negative[i] for i in rng.permutation(len(negative))[: clean_words - len(common)])})
    telling = {t: surplus(t) for t in found[1] if ratio[t] >= 6}
    positive = {t: float(found[1][t]) for t, z in telling.items() if z >= 6}
    if not positive:
        positive = {t: float(found[1][t]) for t in sorted(telling or ratio, key=lambda t: (-ratio[t], t))[:20]}
    every = sorted(set(found[0]) | set(found[1]))
    place = {t: i for i, t in enumerate(every)}
    names = pa.array(every, pa.string())
    for _ in range(3):
        table, bias = _learn(positive, negative, landmarks, copied)
        scores = word_scores(names, table, bias)
        # The machine's own choice: in each toxic document its best word, where clean documents hardly have it.
        chosen = Counter()
        for label, tokens in documents:
            if label == 1:
                likely = [t for t in tokens if t in positive or t in telling and scores[place[t]] > 0]
                best = max(likely, key=lambda t: (scores[place[t]], t), default=None)
                chosen.update(t for t in likely if t in positive or t == best)
        hard = [t for t in found[0] if scores[place[t]] > -0.5 and ratio.get(t, 0) < 1.5 and t not in chosen]
        negative = sorted({*negative, *sorted(hard, key=lambda t: (-scores[place[t]], t))[: clean_words // 3]})
        if chosen:
            positive = {t: float(n) for t, n in chosen.items()}
    return table, bias


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float | np.ndarray = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights and bias of a logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.append(np.broadcast_to(ridge, x.shape[1] - 1), 1e-6)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + np.diag(penalty), gradient)
        w = w - step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w


def _picked(texts: DataFrame, table: np.ndarray, bias: float) -> tuple[list[bytes], list[bytes]]:
    """(toxic, clean) sentence windows: the highest of each toxic document, the two highest and one by hash of each clean one; the highest first."""
    machine = texts.sparkSession.sparkContext.broadcast((table, bias))

    def run(batches):
        for batch in split_batches(batches, "text", 4 << 20):
            rows, index, names = document_sentences(batch.column("text"))
            best, codes = _best_windows(names, *machine.value)
            there = codes[index].any(axis=1)
            rows, index = rows[there], index[there]
            chance = np.array([zlib.crc32(c.tobytes()) for c in codes], dtype=np.int64)
            label = np.asarray(batch.column("label"))
            taken = []
            for key, most in ((-best[index], np.where(label == 1, 1, 2)), (chance[index], np.where(label == 1, 0, 1))):
                order = np.lexsort((np.arange(len(rows)), key, rows))
                place = np.arange(len(rows)) - np.searchsorted(rows[order], rows[order])
                taken.append(order[place < most[rows[order]]])
            taken = np.concatenate(taken)
            yield pa.RecordBatch.from_arrays(
                [pa.array(label[rows[taken]], pa.int32()), pa.array(best[index[taken]], pa.float64()), pa.array([codes[i].tobytes() for i in index[taken]], pa.binary())], names=["label", "score", "codes"]
            )

    # At most three rows of 24 bytes for each document of the sample.
    rows = sorted((-r["score"], bytes(r["codes"]), r["label"]) for r in texts.mapInArrow(run, "label int, score double, codes binary").collect())
    return [c for _, c, label in rows if label == 1], [c for _, c, label in rows if label == 0]


def fit(
    docs: DataFrame, learnable: DataFrame, toxic: int = 1500, clean: int = 3000, landmarks: int = 160, clean_words: int = 12_000, copied: int = 300, rounds: int = 2, toxic_weight: float = 2.0, sentence_ridge: float = 30.0
) -> ToxicityModel | None:
    """Fit on at most ``toxic`` and ``clean`` labelled documents: those whose hashed id is smallest.

    clean_words: of the sample's clean words so many teach the word machine at first, and a third more of those it gets wrong in
    each later round; copied: of the insults, and of the toxic sentence windows, so many get copies with an inserted character;
    rounds: how often the sentence machine picks its windows; toxic_weight: what a toxic document counts in the last layer; sentence_ridge: how much more the layer
    holds back the sentence machine's scores, which fit the documents that it learned from too well. Of a labelled id that is there several times one text is
    taken, so the bounds are bounds of rows."""
    total = {r["label"]: r["n"] for r in learnable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = bounded_sample(learnable.where("label = 1"), toxic).unionByName(bounded_sample(learnable.where("label = 0"), clean))
    # A few thousand rows of two numbers: safe to broadcast. The sample is written once: every round reads it, not the corpus.
    texts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text"), "toxicity_sample")

    def words(batches):
        for batch in split_batches(batches, "text", 4 << 20):
            rows, index, names = document_words(batch.column("text"))
            names = pc.utf8_lower(names).to_numpy(zero_copy_only=False)
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            found = ["\n".join(sorted({names[i] for i in index[a:b].tolist()})) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.string())], names=["label", "words"])

    gathered = sorted((r["label"], r["words"]) for r in texts.mapInArrow(words, "label int, words string").collect())
    # One string for each distinct word of the sample.
    pool: dict[str, str] = {}
    documents = [(label, [pool.setdefault(w, w) for w in found.split("\n")] if found else []) for label, found in gathered]
    count = Counter(label for label, _ in gathered)
    del gathered
    machine = _trained(documents, landmarks, clean_words, copied)
    if machine is None:
        return None
    del documents, pool
    sentences, negative = machine, set()
    for _ in range(rounds):
        picked, clean_windows = _picked(texts, *sentences)
        negative.update(clean_windows)
        if not picked:
            break
        sentences = _learn_windows(picked, sorted(negative), landmarks, copied)
    model = ToxicityModel(machine, sentences)
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def evidence(batches):
        for batch in split_batches(batches, "text", 4 << 20):
            x = shared.value.evidence(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    judged = sorted((r["label"], *r["x"]) for r in texts.mapInArrow(evidence, "label int, x array<double>").collect())
    y = np.array([r[0] for r in judged], dtype=float)
    weight = np.array([total[r[0]] / count[r[0]] for r in judged])
    weight = weight * np.where(y == 1, toxic_weight, 1.0)
    x = np.array([r[1:] for r in judged])
    # First the highest words and the number of insults; their share and the sentences, which fit the sample too well, are held back.
    ridge = np.where(np.arange(x.shape[1]) < 4, 1.0, sentence_ridge)
    model.layer = _logistic(x, y, weight / weight.mean(), ridge)
    return model


def accepted(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 5, held_out: int = 0, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores under the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labelled(labels, label, fold, held_out)))

    def run(batches):
        for whole in batches:
            at = 0
            for batch in split_batches(iter([whole]), "text", 4 << 20):
                yield whole.slice(at, batch.num_rows).filter(pa.array(_probabilities(model.value, batch.column("text")) < threshold))
                at += batch.num_rows

    return docs.mapInArrow(run, docs.schema)


def _probabilities(model: ToxicityModel | None, column: pa.Array) -> np.ndarray:
    if model is None:
        return np.zeros(len(column))
    return model.probabilities(model.evidence(column))


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 5, held_out: int = 0, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labelled(labels, label, fold, held_out)))

    def run(batches):
        for batch in split_batches(batches, "text", 4 << 20):
            found = _probabilities(model.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(F.pmod(crc32_of("doc_id"), F.lit(fold)) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
