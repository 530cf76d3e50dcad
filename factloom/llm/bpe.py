"""BPE ids of whole texts, and texts of ids, by tree concatenation.

What a tokenizer leaves unsplit (a pre-token) is cut into halves down to short leaves,
the leaves are encoded on their own, and neighbours are joined: a window around the join,
of a few ids on each side, is encoded again and grows until its outermost ids are the
ones that were there.  Ids of such a window fit what lies outside it, as an id sequence
is an encoding if each two neighbours in it are one, so the join is exact.

Pre-tokens of ordinary texts are joined where they are met, once for each different one
that the task's cache doesn't hold.  Texts with a run without white space of ``spread``
code points and more are dealt out: their leaves are rows that any task encodes, and one
task joins the leaves of a text, which costs a few short windows each.

Null text is empty and has no ids.  Rows are encoded apart, whether or not they share a
doc_id or have one; other columns go along.  Special tokens within a text are the ids that
the library gives them.  A file with other rules than ``wordpieces`` knows goes to the library
text by text.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .wordpieces import _SIGNS, WordEncoder, batches
from .workers import bounded_batches, give_back, lean

LEAF = 16  # signs of a pre-token that are encoded in one step
SPREAD = 1024  # code points without white space from which on a text's leaves are dealt over tasks
SPREAD_LEAF = 4096  # signs of a leaf that is a row of its own
BLOCK = 1 << 20  # code points without white space that are split into pre-tokens at a time
WINDOW = 2  # ids on each side of a join, at first

_AT_SPACE = r"[ \t\n\x0B\f\r]"
#: Where a run may be cut without changing its pre-tokens: before a digit, or between a letter and a sign that is no apostrophe.
_SAFE = re.compile(r"(?=[0-9])|(?<=[A-Za-z])(?=[!-&(-/:-@\[-`{-~])")


def joined(a: array, b: array, ends: bool, names: list[str], encode: Callable[[str, bool], array]) -> array:
    """The ids of two neighbouring parts' whole; ``ends``: ``b`` ends a pre-token."""
    n = WINDOW
    while True:
        i, j = max(0, len(a) - n), min(len(b), n)
        closed = ends and j == len(b)
        text = "".join(map(names.__getitem__, a[i:] + b[:j]))
        again = encode(text.removesuffix("</w>") if closed else text, closed)
        if (i == 0 or again[0] == a[i]) and (j == len(b) or again[-1] == b[j - 1]):
            return a[:i] + again + b[j:]
        n *= 2


def tree(parts: list[array], ends: bool, names: list[str], encode: Callable[[str, bool], array]) -> array:
    """Neighbours are joined, level by level."""
    while len(parts) > 1:
        last = len(parts) - 1
        parts = [joined(parts[k], parts[k + 1], ends and k + 1 == last, names, encode) if k < last else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else array("I")


def halves(signs: str, leaf: int) -> list[str]:
    """``signs`` in halves of halves, none longer than ``leaf``."""
    n = 1
    while len(signs) > leaf * n:
        n *= 2
    cuts = [len(signs) * k // n for k in range(n + 1)]
    return [signs[a:b] for a, b in zip(cuts, cuts[1:])]


class TreeEncoder(WordEncoder):
    """A WordEncoder whose pre-tokens are encoded by tree concatenation.

    The model is opened twice, with and without its mark for a word's end, as only the
    last part of a pre-token has that mark.
    """

    def __init__(self, path: str):
        super().__init__(path)
        if not self.known:
            return
        from tokenizers.models import BPE

        model = json.loads(self.tokenizer.to_str())["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.known = model["type"] == "BPE" and self.suffix == "</w>" and not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        self.open = BPE(vocab=model["vocab"], merges=[tuple(m) for m in model["merges"]])
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        marks = {t["content"]: t["id"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]}
        self.marks, self.mark = marks, re.compile("(" + "|".join(map(re.escape, sorted(marks, key=len, reverse=True))) + ")") if marks else None

    def step(self, signs: str, closed: bool) -> array:
        """Ids of signs in one step; ``closed``: they end a pre-token."""
        return array("I", [t.id for t in (self.tokenizer.model if closed else self.open).tokenize(signs)])

    def piece(self, signs: str) -> array:
        if len(signs) <= LEAF:
            return self.step(signs, True)
        leaves = halves(signs, LEAF)
        last = len(leaves) - 1
        return tree([self.step(x, k == last) for k, x in enumerate(leaves)], True, self.names, self.step)

    def packed(self, ids: array) -> bytes:
        return np.frombuffer(ids, np.uint32).astype(self.dtype).tobytes() if ids else b""

    def _learn_pieces(self, new: set[str]) -> None:
        for p in new:
            self.pieces[p] = self.packed(self.piece(p if p.isascii() else p.encode().decode("latin-1").translate(_SIGNS)))

    def split(self, run: str) -> Iterator[tuple[int | None, str]]:
        """(id, '') of special tokens and (None, signs) of pre-tokens, in order."""
        for part in self.mark.split(run) if self.mark else [run]:
            if part in self.marks:
                yield self.marks[part], ""
                continue
            at = 0
            while at < len(part):
                cut = _SAFE.search(part, at + BLOCK) if len(part) - at > BLOCK else None
                end = cut.start() if cut else len(part)
                block = self.tokenizer.normalizer.normalize_str(part[at:end])
                for signs, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(block):
                    yield None, signs
                at = end

    def _whole(self, text: str) -> bytes:
        if not self.known:
            return super()._whole(text)
        return b"".join(self.packed(self.piece(signs)) if i is None else np.array([i], self.dtype).tobytes() for i, signs in self.split(text))


_ENCODERS: dict[str, TreeEncoder] = {}


def encoder(path: str) -> TreeEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TreeEncoder(path)
    return _ENCODERS[path]


def _as_lists(packed: list[bytes], dtype: np.dtype) -> pa.ListArray:
    ends = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // dtype.itemsize for p in packed], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype).astype(np.int32)))


def ids_column(text: Column, tokenizer: str) -> Column:
    """The ids of each text, as array<int>."""

    @F.arrow_udf("array<int>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = encoder(tokenizer)
        try:
            for column in columns:
                out = [ids for group in batches(column.to_pylist(), lambda t: len(t or "")) for ids in words.encode(group)]
                yield _as_lists(out, words.dtype)
        finally:
            words.forget()
            give_back()

    return run(text)


_PARTS = "row long, at int, leaf int, last boolean, signs string, ids binary"


def _cut(tokenizer: str, spread: int):
    """Parts of texts in order: ids of what lies between long pre-tokens, and the leaves of these."""
    schema = pa.schema([("row", pa.int64()), ("at", pa.int32()), ("leaf", pa.int32()), ("last", pa.bool_()), ("signs", pa.string()), ("ids", pa.binary())])

    def run(tables):
        words = encoder(tokenizer)
        kept = lambda run_: len(run_) >= spread

        def parts(row: int, text: str):
            at, short, size = 0, [], 0

            def ids(packed: bytes):
                return {"row": row, "at": at, "leaf": 0, "last": True, "signs": None, "ids": packed}

            for chunk in re.split(f"{_AT_SPACE}+", text):
                if not kept(chunk):
                    short.append(chunk)
                    size += len(chunk) + 1
                    if size < BLOCK:
                        continue
                if short:
                    yield ids(words.encode([" ".join(short)])[0])
                    at, short, size = at + 1, [], 0
                if not kept(chunk):
                    continue
                between = []
                for i, signs in words.split(chunk):
                    if i is None and len(signs) > SPREAD_LEAF:
                        if between:
                            yield ids(b"".join(between))
                            at, between = at + 1, []
                        leaves = halves(signs, SPREAD_LEAF)
                        for k, x in enumerate(leaves):
                            yield {"row": row, "at": at, "leaf": k, "last": k + 1 == len(leaves), "signs": x, "ids": None}
                        at += 1
                    else:
                        between.append(words.packed(words.piece(signs)) if i is None else np.array([i], words.dtype).tobytes())
                if between:
                    yield ids(b"".join(between))
                    at += 1
            if short:
                yield ids(words.encode([" ".join(short)])[0])

        for t in tables:
            for row, text in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
                for some in batches(parts(row, text), lambda p: len(p["signs"] or p["ids"] or "")):
                    yield pa.RecordBatch.from_pylist(some, schema)
        words.forget()

    return run


def _encode_leaves(tokenizer: str):
    def run(tables):
        words = encoder(tokenizer)
        for t in tables:
            ids = [words.packed(words.step(s, last)) for s, last in zip(t.column("signs").to_pylist(), t.column("last").to_pylist())]
            yield t.set_column(t.schema.get_field_index("ids"), "ids", pa.array(ids, pa.binary()))

    return run


def _join_leaves(tokenizer: str):
    def run(group: pa.Table) -> pa.Table:
        words = encoder(tokenizer)
        group = group.sort_by([("at", "ascending"), ("leaf", "ascending")])
        out, leaves = [], []
        for signs, last, ids in zip(*(group.column(c).to_pylist() for c in ("signs", "last", "ids"))):
            if signs is None:
                out.append(ids)
                continue
            leaves.append(array("I", np.frombuffer(ids, words.dtype).astype(np.uint32).tobytes()))
            if last:
                out.append(words.packed(tree(leaves, True, words.names, words.step)))
                leaves = []
        return pa.table({"__row": group.column("row").slice(0, 1), "__ids": _as_lists([b"".join(out)], words.dtype)})

    return run


def encode(docs: DataFrame, tokenizer: str, text: str = "text", into: str = "ids", spread: int = SPREAD) -> DataFrame:
    """``docs`` with the ids of their whole texts, as the tokenizers library gives them without special tokens added."""
    bounded_batches(docs.sparkSession)
    if not encoder(tokenizer).known:
        return docs.withColumn(into, ids_column(F.col(text), tokenizer))
    # the look for a long run starts at its first sign alone
    long_run = F.coalesce(F.col(text).rlike(f"(?:^|{_AT_SPACE})[^ \\t\\n\\x0B\\f\\r]{{{spread}}}"), F.lit(False))
    short = docs.filter(~long_run).withColumn(into, ids_column(F.col(text), tokenizer))
    rows = written(docs.filter(long_run).withColumn("__row", F.monotonically_increasing_id()), "long-texts")  # numbered once
    parts = written(rows.select(F.col("__row").alias("row"), text).mapInArrow(lean(_cut(tokenizer, spread)), _PARTS), "text-parts")
    leaves = parts.filter("signs is not null").repartition("row", "at", "leaf").mapInArrow(lean(_encode_leaves(tokenizer)), _PARTS)
    whole = parts.filter("signs is null").unionByName(leaves).groupBy("row").applyInArrow(_join_leaves(tokenizer), "__row long, __ids array<int>")
    long = rows.drop(into).join(whole, "__row").withColumnRenamed("__ids", into).drop("__row")
    return short.unionByName(long.select(*[F.col(f"`{c}`") for c in short.columns]))


@functools.cache
def token_names(path: str) -> pa.Array | None:
    """The tokens by id, from the file alone; None where it has a decoder of its own."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    if file.get("decoder") is not None or file["model"].get("type") != "BPE":
        return None
    ids = file["model"]["vocab"] | {t["content"]: t["id"] for t in file.get("added_tokens") or []}
    names = [""] * (max(ids.values()) + 1)
    for name, i in ids.items():
        names[i] = name
    return pa.array(names, pa.large_string())


def decoded_column(ids: Column, tokenizer: str) -> Column:
    """The text of each array of ids, special tokens kept, as the library's decode gives it."""

    @F.arrow_udf("string")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = token_names(tokenizer)
        words = None if names is not None else encoder(tokenizer)
        for column in columns:
            if names is not None:  # without a decoder, the tokens' names joined by blanks
                listed = pa.ListArray.from_arrays(pa.array(np.asarray(column.offsets) - column.offsets[0].as_py()), names.take(column.flatten()))
                yield pc.binary_join(listed, pa.scalar(" ", pa.large_string())).cast(pa.string())
            else:
                yield pa.array([words.tokenizer.decode(i, skip_special_tokens=False) for i in column.to_pylist()], pa.string())

    return run(ids)


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    bounded_batches(rows.sparkSession)
    return rows.withColumn(into, decoded_column(F.col(ids), tokenizer))
