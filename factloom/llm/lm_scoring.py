"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are words after lower-casing A-Z, and one end for each text.  Every token
belongs to one of ``CLASSES`` classes by a fixed rule on its letters, the end to a
class of its own.  The units of the network are words: those with at least
tokens ** 0.75 / 500 training tokens, so that they grow with the corpus, at most as
500 times the fourth root of its tokens, and for each class one unit that all its
rarer words share.  The model factors a token's
probability into that of its class given the units of the two tokens before it,
that of its unit within the class given the same, and, for a rare word, that of
the token among the class's rare ones:

* Class and unit are scored by a log-bilinear network: the context's
  representation is the sum of the two units' vectors, each of its position; its
  product with the target's vector, and a bias, is the score.  Every unit starts
  from its class's vectors, which are trained on the driver by noise-contrastive
  estimation on all class trigram counts.  Then each task trains all vectors by
  noise-contrastive estimation on every training token it holds, once, and the
  tasks' parameters are averaged, weighted by tokens.  Noise counts by its
  expectation, so nothing is drawn.  Scores are normalised over the classes and
  over the units of a class.
* A rare token's part is (c + 1) / (N + V + 1) over the rare tokens N and types V
  of its class, where the last 1 is that of all unseen tokens of the class
  together, so that probabilities of all tokens, unseen ones as one type for each
  class, sum to 1.

How rows are dealt over tasks moves ``score`` a little, as each task trains from
the same start on its own rows; the other columns don't depend on it.

Counting covers the whole corpus and never gathers it anywhere.  Texts are read
once, into blocks of bounded size that hold them as numbers into a word list of the
block's own, words as 64-bit hashes.  Each block sends its word list, cut into hash
ranges, with its counts; a range sums them and sends each block the counts of its
words, so a word of every document costs one entry for each block.  Training reads
the blocks where they are.  Only class totals and trigram counts, of a fixed size,
and the frequent words with their vectors, at most 500 * tokens ** 0.25, come to
the driver.

Null text is empty: its one token is the end.  A row without doc_id is a
training row.  Rows that share a doc_id are scored, and learned from, each.  A very
long text is a block of its own, held by one task.  An empty table gives an empty
result; without a training row every class follows every other one alike.  Other
columns are not looked at.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import held_out
from .scratch import written
from .workers import bounded_batches, give_back, lean

CLASSES = 64
BLOCK_BYTES = 12_000_000
RANGE_BYTES = 500_000_000  # of text to a hash range of words, so that one fits into a task whatever the corpus
CELLS = CLASSES**3
CELLS_A_ROW = 4096
SIZE, NOISE = 16, 48
PART = 8192  # parameters that a task sends in one row
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
END = b""  # no word is empty


def class_of(word: bytes) -> int:
    """Short words by themselves, longer ones by their ending; 0 is the end's."""
    if word == END:
        return 0
    return 1 + zlib.crc32(word if len(word) <= 4 else b"-" + word[-2:]) % (CLASSES - 1)


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


class _Numbers(dict):
    """Word -> number in order of appearance."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


_BLOCK = pa.schema([
    ("kind", pa.string()), ("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary()),
    ("part", pa.int32()), ("hashes", pa.binary()), ("classes", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("cell_row", pa.int32()), ("cells", pa.list_(pa.int64())),
])
BLOCK_SCHEMA = (
    "kind string, block string, doc_ids array<bigint>, held array<boolean>, lengths array<bigint>, ids binary, "
    "part int, hashes binary, classes binary, counts binary, n bigint, cell_row int, cells array<bigint>"
)


def packed(values: np.ndarray) -> bytes:
    data = values.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), dtype)


def before(values: np.ndarray, lengths: np.ndarray, start) -> tuple[np.ndarray, np.ndarray]:
    """What stands two places and one place before each value in its text; ``start`` before the first."""
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    one, two = np.roll(values, 1), np.roll(values, 2)
    one[place < 1], two[place < 2] = start, start
    return two, one


def pieces(lengths: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[slice, slice]]:
    """Runs of texts with about ``most`` tokens, as slices of the texts and of their tokens; a longer text is a run of its own."""
    ends = np.cumsum(lengths)
    first = at = 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(ends, at + most, "right")))
        yield slice(first, last), slice(at, int(ends[last - 1]))
        first, at = last, int(ends[last - 1])


def _cuts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of the sorted hashes begins and the last ends."""
    edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _blocks(parts: int):
    """Each block's texts, its word list for each range, and class trigram counts, as rows of one table."""

    def run(tables) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)

        def rows():
            for t in tables:
                yield from zip(t.column(0), t.column(1), t.column(2))

        def closed(numbers: _Numbers, docs: list):
            name, words = uuid.uuid4().hex, list(numbers)
            classes = np.fromiter(map(class_of, words), np.uint8, len(words))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            held, lengths = np.array([h for _, h, _ in docs]), np.array([len(ids) for _, _, ids in docs])
            ids = np.concatenate([ids for _, _, ids in docs])
            counts = np.zeros(len(words), np.int64)
            for some, of in pieces(lengths):
                learned = np.repeat(~held[some], lengths[some])
                counts += np.bincount(ids[of][learned], minlength=len(words))
                c = classes[ids[of]].astype(np.int64)
                a, b = before(c, lengths[some], 0)
                cells[:] += np.bincount(((a * CLASSES + b) * CLASSES + c)[learned], minlength=CELLS)
            out = [{"kind": "texts", "block": name, "doc_ids": [d for d, _, _ in docs], "held": held.tolist(), "lengths": lengths.tolist(), "ids": packed(ids), "hashes": packed(hashes), "classes": packed(classes)}]
            by = np.argsort(hashes)
            cuts = _cuts(hashes[by], parts)
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                at = by[cuts[k] : cuts[k + 1]]
                out.append({"kind": "words", "block": name, "part": k, "hashes": packed(hashes[at]), "classes": packed(classes[at]), "counts": packed(counts[at].astype("<u4")), "n": int(counts[at].sum())})
            return pa.RecordBatch.from_pylist(out, _BLOCK)

        numbers, docs, size = _Numbers({END: 0}), [], 0
        for doc_id, held, text in rows():
            text = text.as_py() or ""
            docs.append((doc_id.as_py(), held.as_py(), np.fromiter(map(numbers.__getitem__, tokens_of(text) + [END]), np.uint32)))
            size += len(text)
            if size >= BLOCK_BYTES:
                yield closed(numbers, docs)
                numbers, docs, size = _Numbers({END: 0}), [], 0
        if docs:
            yield closed(numbers, docs)
        for i in np.flatnonzero(cells.reshape(-1, CELLS_A_ROW).any(1)).tolist():
            yield pa.RecordBatch.from_pylist([{"kind": "cells", "cell_row": i, "cells": cells[i * CELLS_A_ROW : (i + 1) * CELLS_A_ROW].tolist()}], _BLOCK)

    return run


COUNT_SCHEMA = "kind string, block string, part int, counts binary, hash bigint, class int, tokens bigint, types bigint"
_COUNT = pa.schema([("kind", pa.string()), ("block", pa.string()), ("part", pa.int32()), ("counts", pa.binary()), ("hash", pa.int64()), ("class", pa.int32()), ("tokens", pa.int64()), ("types", pa.int64())])


def _counted(least: int):
    """One range: the corpus's counts of each block's words, class totals, and the words with ``least`` tokens."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        hashes = [unpacked(x.as_py(), "<u8") for x in table.column("hashes")]
        every, first, of = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        classes = np.concatenate([unpacked(x.as_py(), np.uint8) for x in table.column("classes")])[first]
        counts = np.bincount(of, np.concatenate([unpacked(x.as_py(), "<u4") for x in table.column("counts")]), len(every)).astype(np.int64)
        back = np.split(counts[of], np.cumsum([len(h) for h in hashes])[:-1])
        rows = [{"kind": "counts", "block": b, "part": part, "counts": packed(c)} for b, c in zip(table.column("block").to_pylist(), back)]
        known = counts > 0
        tokens, types = np.bincount(classes, counts, CLASSES).astype(np.int64), np.bincount(classes[known], minlength=CLASSES)
        rows += [{"kind": "class", "class": k, "tokens": int(tokens[k]), "types": int(types[k])} for k in np.flatnonzero(types).tolist()]
        for i in np.flatnonzero(counts >= least).tolist():
            rows.append({"kind": "frequent", "hash": int(every[i].astype(np.int64)), "class": int(classes[i]), "tokens": int(counts[i])})
        out = pa.Table.from_pylist(rows, _COUNT)
        del hashes, every, first, of, back, rows
        give_back()
        return out

    return run


def fit_classes(cells: np.ndarray, size: int = SIZE, noise: int = NOISE, steps: int = 300, rate: float = 0.2, seed: int = 7) -> tuple[np.ndarray, ...]:
    """Vectors of both context positions, target vectors and biases of the classes, from all counted trigrams."""
    rng = np.random.default_rng(seed)
    counts = cells.reshape(CLASSES * CLASSES, CLASSES).astype(float)
    total = counts.sum()
    first, second, target = (rng.normal(0, 0.1, (CLASSES, size)) for _ in range(3))
    if not total:
        return first, second, np.zeros((CLASSES, size)), np.full(CLASSES, -np.log(CLASSES))
    unigram = (counts.sum(0) + 1) / (total + CLASSES)
    bias = np.log(unigram)  # scores start as the noise's own log-probabilities
    params = [first, second, target, bias]
    squares = [np.full_like(p, 1e-3) for p in params]
    met = np.flatnonzero(counts.any(1))
    one = np.eye(CLASSES)
    a, b, shares = one[met // CLASSES], one[met % CLASSES], counts[met] / total
    wrong = noise * unigram * shares.sum(1, keepdims=True)  # noise that each context is due to meet
    log_noise = np.log(noise * unigram)
    for _ in range(steps):
        q = a @ first + b @ second
        true = 1 / (1 + np.exp(log_noise - q @ target.T - bias))
        onto = shares * (1 - true) - wrong * true
        dq = onto @ target
        for p, g, s in zip(params, (a.T @ dq, b.T @ dq, onto.T @ q, onto.sum(0)), squares):
            s += g * g
            p += rate * g / np.sqrt(s)
    return first, second, target, bias


def train_classes(cells: np.ndarray, **options) -> np.ndarray:
    """log P(class | two classes before) as a (CLASSES, CLASSES, CLASSES) table, from trigram counts."""
    first, second, target, bias = fit_classes(cells, **options)
    logits = (first[:, None, :] + second[None, :, :]) @ target.T + bias
    logits -= logits.max(-1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(-1, keepdims=True))


class Units:
    """What the network knows: of each class a slot for its rare words, then its frequent words, side by side."""

    def __init__(self, hashes, classes, counts, class_tokens: np.ndarray, class_types: np.ndarray):
        """``hashes``: of the frequent words, in ascending order."""
        hashes, classes, counts = np.array(hashes, np.uint64), np.array(classes, np.int64), np.array(counts, np.int64)
        known = np.bincount(classes, minlength=CLASSES)
        self.first = np.concatenate([[0], np.cumsum(known + 1)])
        at = np.argsort(classes, kind="stable")
        number = np.empty(len(hashes), np.int64)
        number[at] = np.arange(len(hashes)) + classes[at] + 1
        self.hashes, self.number, self.n = hashes, number, int(self.first[-1])
        self.classes = np.repeat(np.arange(CLASSES), known + 1)
        self.rare_tokens = class_tokens - np.bincount(classes, counts, CLASSES)
        self.rare_types = class_types - known
        slots = np.zeros(self.n)
        slots[number], slots[self.first[:-1]] = counts, self.rare_tokens
        self.class_share = (class_tokens + 1) / (class_tokens.sum() + CLASSES)
        self.share = (slots + 1) / (class_tokens + known + 1)[self.classes]  # of its class

    def of(self, hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Units of words; a rare word's is its class's slot."""
        slots = self.first[classes]
        if not len(self.hashes):
            return slots
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.number[at], slots)


class Network:
    """Log-bilinear over units: the sum of two context vectors scores the class, then the unit within its class."""

    def __init__(self, units: Units, cells: np.ndarray):
        first, second, target, bias = fit_classes(cells)
        # every unit starts near its class, or words of a class could not part, and within it as the counts have it
        k = units.classes
        near = np.random.default_rng(11).normal(0, 0.1, (3, units.n, SIZE))
        parts = [first[k] + near[0], second[k] + near[1], target, bias, near[2], np.log(units.share)]
        self.params = [p.astype(np.float32) for p in parts]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params])

    def take(self, flat: np.ndarray) -> None:
        cuts = np.cumsum([p.size for p in self.params])[:-1]
        self.params = [x.reshape(p.shape).astype(np.float32) for x, p in zip(np.split(flat, cuts), self.params)]


def _by_class(units: Units, unit: np.ndarray):
    """(class's slots, where its tokens are, their places among the slots) of each class with a choice of slots."""
    k = units.classes[unit]
    at = np.argsort(k, kind="stable")
    ends = np.searchsorted(k[at], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        if ends[c] < ends[c + 1] and units.first[c + 1] - units.first[c] > 1:
            mine = at[ends[c] : ends[c + 1]]
            yield slice(units.first[c], units.first[c + 1]), mine, unit[mine] - units.first[c]


def _told(q, target, bias, noise, right):
    """The error at each score: examples against the noise that they are due to meet."""
    z = q @ target.T
    z += bias - np.log(noise)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1
    np.divide(-noise, z, out=z)  # what noise pulls down
    rows = np.arange(len(q))
    z[rows, right] += 1 + z[rows, right] / noise[right]  # and what the examples lift
    return z


def train(net: Network, units: Units, texts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], batch: int, rate: float = 0.1) -> int:
    """One pass of noise-contrastive estimation over all tokens, as arrays of (two units before, unit); how many they were."""
    of_class, of_unit = (NOISE * units.class_share).astype(np.float32), (NOISE * units.share).astype(np.float32)
    squares = [np.ones_like(p) for p in net.params]
    lanes = np.arange(SIZE)

    def onto_units(at, g):
        return np.bincount((at[:, None] * SIZE + lanes).ravel(), g.ravel(), units.n * SIZE).reshape(units.n, SIZE)

    def step(a, b, unit):
        first, second, target, bias, word, word_bias = net.params
        q = first[a] + second[b]
        onto = _told(q, target, bias, of_class, units.classes[unit])
        dq, d_word, d_word_bias = onto @ target, np.zeros_like(word), np.zeros_like(word_bias)
        for slots, mine, right in _by_class(units, unit):
            x = _told(q[mine], word[slots], word_bias[slots], of_unit[slots], right)
            dq[mine] += x @ word[slots]
            d_word[slots], d_word_bias[slots] = x.T @ q[mine], x.sum(0)
        for p, g, s in zip(net.params, (onto_units(a, dq), onto_units(b, dq), onto.T @ q, onto.sum(0), d_word, d_word_bias), squares):
            s += g * g
            p += rate * g / np.sqrt(s)

    n, waiting, held = 0, [], 0

    def flush(all_of_it: bool):
        nonlocal waiting, held
        a, b, unit = (np.concatenate(x) for x in zip(*waiting))
        end = held if all_of_it else held - held % batch
        for i in range(0, end, batch):
            part = slice(i, min(i + batch, end))
            step(a[part], b[part], unit[part])
        waiting, held = [(a[end:], b[end:], unit[end:])], held - end

    for a, b, unit in texts:
        waiting.append((a, b, unit))
        n, held = n + len(unit), held + len(unit)
        if held >= batch:
            flush(False)
    if held:
        flush(True)
    return n


class Scorer:
    """What scoring needs besides a block: it grows as the units do."""

    def __init__(self, units: Units, net: Network, tokens: int, types: int):
        self.units, self.net, self.tokens, self.types = units, net, tokens, types
        self.rare_log = np.log10(units.rare_tokens + units.rare_types + 1)

    def logs(self, a: np.ndarray, b: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """log10 P(unit | two units before)."""
        first, second, target, bias, word, word_bias = self.net.params
        q = first[a] + second[b]

        def chosen(q, target, bias, right):
            x = q @ target.T
            x += bias
            x -= x.max(1, keepdims=True)
            at = x[np.arange(len(x)), right]
            np.exp(x, out=x)
            return at - np.log(x.sum(1))

        out = chosen(q, target, bias, self.units.classes[unit]).astype(float)
        for slots, mine, right in _by_class(self.units, unit):
            out[mine] += chosen(q[mine], word[slots], word_bias[slots], right)
        return out / np.log(10)

    def score(self, ids: np.ndarray, lengths: np.ndarray, counts: np.ndarray, unit_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and score of each text, from its block's counts and units."""
        word_logs = np.log10(counts + 1.0)
        k = self.units.classes[unit_of]
        rare = np.where(unit_of == self.units.first[k], word_logs - self.rare_log[k], 0.0)
        known, base, score, step = [], [], [], 1 << 15
        for some, of in pieces(lengths):
            n, mine = lengths[some], ids[of]
            starts, unit = np.cumsum(n) - n, unit_of[mine]
            a, b = before(unit, n, unit_of[0])
            logs = rare[mine] + np.concatenate([self.logs(a[i : i + step], b[i : i + step], unit[i : i + step]) for i in range(0, len(unit), step)])
            known.append(np.add.reduceat((counts[mine] > 0).astype(np.int64), starts))
            base.append(np.add.reduceat(word_logs[mine], starts) - n * float(np.log10(self.tokens + self.types + 1)))
            score.append(np.add.reduceat(logs, starts))
        return np.concatenate(known), np.concatenate(base), np.concatenate(score)


SCORE_SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(sent):
    def run(key, texts, ranges):
        scorer = sent.value
        hashes, classes = unpacked(texts.column("hashes")[0].as_py(), "<u8"), unpacked(texts.column("classes")[0].as_py(), np.uint8)
        parts = sorted(zip(ranges.column("part").to_pylist(), ranges.column("counts")), key=lambda p: p[0])
        counts = np.empty(len(hashes), np.int64)
        counts[np.argsort(hashes)] = np.concatenate([unpacked(c.as_py(), "<i8") for _, c in parts])
        ids, lengths = unpacked(texts.column("ids")[0].as_py(), "<u4"), np.array(texts.column("lengths")[0].as_py())
        known, base, score = scorer.score(ids, lengths, counts, scorer.units.of(hashes, classes))
        doc_ids, held = texts.column("doc_ids")[0].as_py(), texts.column("held")[0].as_py()
        cols = [doc_ids, held, lengths, known, np.full(len(lengths), scorer.tokens), base, score]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        give_back()
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


FIT_SCHEMA = "part int, task int, n bigint, data binary"
FAN_IN, LEVELS = 64, 3  # of the tree over tasks that averages parameters: enough for FAN_IN ** LEVELS tasks


def _fitted(sent, batch: int):
    """Each task trains on its own blocks; its parameters go out in parts, with the number of tokens that they have seen."""

    def run(tables):
        units, net = sent.value

        def texts():
            for t in tables:
                for r in range(t.num_rows):
                    hashes, classes, ids = (unpacked(t.column(c)[r].as_py(), d) for c, d in (("hashes", "<u8"), ("classes", np.uint8), ("ids", "<u4")))
                    lengths = np.array(t.column("lengths")[r].as_py())
                    held, unit_of = np.array(t.column("held")[r].as_py()), units.of(hashes, classes)
                    for some, of in pieces(lengths):
                        unit = unit_of[ids[of]]
                        a, b = before(unit, lengths[some], unit_of[0])
                        learned = np.repeat(~held[some], lengths[some])
                        yield a[learned], b[learned], unit[learned]

        if n := train(net, units, texts(), batch):
            flat = net.flat()
            for k, i in enumerate(range(0, len(flat), PART)):
                of = [pa.array([k], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([flat[i : i + PART].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(of, ["part", "task", "n", "data"])

    return run


def _mean(table: pa.Table) -> pa.Table:
    n = table.column("n").to_pylist()
    data = sum(k * np.frombuffer(d.as_py(), np.float32).astype(float) for k, d in zip(n, table.column("data"))) / sum(n)
    one = [pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("part", "task")]
    return pa.table([*one, pa.array([sum(n)], pa.int64()), pa.array([data.astype(np.float32).tobytes()], pa.binary())], ["part", "task", "n", "data"])


def mean_of_tasks(run: DataFrame) -> DataFrame:
    """One row for each part: the tasks' parameters averaged by their tokens, level by level, FAN_IN of them at a time in a worker."""
    for _ in range(LEVELS):
        run = run.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("part", "task").applyInArrow(_mean, FIT_SCHEMA)
    return run.groupBy("part").applyInArrow(_mean, FIT_SCHEMA)


def score(docs: DataFrame, of: int = 7, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    rows = docs.select("doc_id", held_out(F.col("doc_id"), of, remainder).alias("held_out"), "text")
    table = written(rows.mapInArrow(lean(_blocks(parts)), BLOCK_SCHEMA), "lm-blocks")
    words = table.filter("kind = 'words'")
    tokens = words.agg(F.sum("n")).first()[0] or 0
    # words that often are at most 500 * tokens ** 0.25 in number, and a token's work follows them
    least = max(2, math.isqrt(tokens * math.isqrt(tokens)) // 500)
    counted = written(words.select("block", "part", "hashes", "classes", "counts").groupBy("part").applyInArrow(_counted(least), COUNT_SCHEMA), "lm-counts")
    class_tokens, class_types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counted.filter("kind = 'class'").groupBy("class").agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).collect():  # CLASSES rows
        class_tokens[r["class"]], class_types[r["class"]] = r["n"], r["v"]
    cells = np.zeros(CELLS, np.int64)
    summed = table.filter("kind = 'cells'").select("cell_row", F.posexplode("cells").alias("i", "n")).filter("n > 0").groupBy("cell_row", "i").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    cells[summed.column("cell_row").to_numpy() * CELLS_A_ROW + summed.column("i").to_numpy()] = summed.column("n").to_numpy()
    frequent = counted.filter("kind = 'frequent'").select("hash", "class", "tokens").toArrow()
    hashes = frequent.column("hash").to_numpy().astype(np.int64).view(np.uint64)
    by = np.argsort(hashes)
    units = Units(hashes[by], frequent.column("class").to_numpy()[by], frequent.column("tokens").to_numpy()[by], class_tokens, class_types)
    net = Network(units, cells)
    batch = min(8192, max(256, tokens // 256))
    to_fit = spark.sparkContext.broadcast((units, net))
    blocks = table.filter("kind = 'texts'").select("block", "doc_ids", "held", "lengths", "ids", "hashes", "classes")
    run = blocks.select("held", "lengths", "ids", "hashes", "classes").mapInArrow(lean(_fitted(to_fit, batch)), FIT_SCHEMA)
    fitted = sorted(mean_of_tasks(run).collect(), key=lambda r: r["part"])  # one set of parameters
    if fitted:
        net.take(np.concatenate([np.frombuffer(r["data"], np.float32) for r in fitted]))
    sent = spark.sparkContext.broadcast(Scorer(units, net, tokens, int(class_types.sum())))
    ranges = counted.filter("kind = 'counts'").select(F.col("block").alias("of_block"), "part", "counts")
    return blocks.groupBy("block").cogroup(ranges.groupBy("of_block")).applyInArrow(_score(sent), SCORE_SCHEMA)
