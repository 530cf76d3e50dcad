"""Exact ids of a tokenizer whose pre-tokens never span white space.

The vocabulary file lower-cases, drops white space and splits letters, single
digits and other signs, so the ids of a text are the ids of its blank-separated
chunks, one after the other.  Arrow splits a batch and finds its distinct chunks,
each is looked up once in a bounded cache of the task, and the ids of all texts
are taken from these in one step.  Chunks outside Latin script, or holding a special
token's marker, go to the tokenizer whole, so every text gets the ids the library
itself would give.  A file with other rules than these is recognised by its settings,
and all its texts go to the library.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_CHARS = 4_000_000
CHUNKS_KEPT = 20_000  # the pieces that chunks are made of are worth more room
PIECES_KEPT = 450_000

# Characters up to U+017F are stable under NFC, and all but U+0130 lower-case
# to a single character; U+0080-U+00A0 hold white space.
_PLAIN = re.compile("[!-~¡-įı-ſ]+")
_LINES = re.compile("[!-~¡-įı-ſ\n]+")
_PIECE = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d"
    "|[a-zªµºß-öø-ſ]+"
    "|[0-9²³¹¼-¾]"
    "|\n"
    "|[^\na-z0-9ªµº²³¹¼-¾ß-öø-ſ]+"
)

# The sign by which byte-level vocabularies write a byte: itself if printable, else the next free one from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


# The settings that the pieces above follow, fixed values.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def follows_rules(settings: dict) -> bool:
    """Whether a tokenizer's file has the normaliser, the splits and the special tokens that this encoder stands for."""
    steps = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        (settings.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and steps[0].get("pattern") == {"Regex": SPLIT} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
        and [s.get("type") for s in steps[1:]] == ["ByteLevel"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        and all(t["content"].startswith("<|") for t in settings.get("added_tokens") or [])
        and settings.get("truncation") is None
    )


class WordEncoder:
    """``encode(texts)`` gives, for each text, its ids as packed little-endian integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = follows_rules(json.loads(self.tokenizer.to_str()))
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empty the caches: an idle worker should not hold them."""
        self.chunks.clear()
        self.pieces.clear()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn_pieces(self, new: set[str]) -> None:
        # A piece is one pre-token: the model itself encodes it, without the steps around it.
        model, kind = self.tokenizer.model.tokenize, "H" if self.dtype.itemsize == 2 else "I"
        for p in new:
            signs = p if p.isascii() else p.encode().decode("latin-1").translate(_SIGNS)
            self.pieces[p] = array(kind, [t.id for t in model(signs)]).tobytes()

    def _learn(self, new: list[str]) -> None:
        whole = "\n".join(new)
        if not _LINES.fullmatch(whole) or "<|" in whole:
            odd = [c for c in new if not _PLAIN.fullmatch(c) or "<|" in c]
            self.chunks.update((c, self._whole(c)) for c in odd)
            if not (new := list(set(new).difference(odd))):
                return
            whole = "\n".join(new)
        if len(self.pieces) > PIECES_KEPT:
            self.pieces.clear()
        # One mark between chunks: no id is as large, so the joined ids split at it again.
        mark = b"\xff" * self.dtype.itemsize
        self.pieces["\n"] = mark
        parts = _PIECE.findall(whole.lower())
        if unknown := set(parts) - self.pieces.keys():
            self._learn_pieces(unknown)
        self.chunks.update(zip(new, b"".join(map(self.pieces.__getitem__, parts)).split(mark)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Texts are taken whole; a batch should hold a few MB of text at most."""
        if not self.known:
            return [self._whole((t or "").encode("utf-8", "replace").decode()) for t in texts]
        try:
            column = pa.array([t or "" for t in texts], pa.large_string())
        except UnicodeEncodeError:  # half a surrogate pair
            column = pa.array([(t or "").encode("utf-8", "replace").decode() for t in texts], pa.large_string())
        split = pc.ascii_split_whitespace(column)
        coded = split.values.dictionary_encode()
        # Chunks hold no line break, so one join and one split make the list.
        listed = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        seen = pc.binary_join(listed, pa.scalar("\n", pa.large_string()))[0].as_py().split("\n") if len(coded.dictionary) else []
        if len(self.chunks) > CHUNKS_KEPT:
            self.chunks.clear()
        if new := [c for c in seen if c not in self.chunks]:
            self._learn(new)
        ids = pa.array(map(self.chunks.__getitem__, seen), pa.large_binary(), size=len(seen)).take(coded.indices)
        _, ends, values = ids.buffers()
        if values is None or not len(ids):
            return [b""] * len(texts)
        at = np.frombuffer(ends, np.int64)[split.offsets.to_numpy()].tolist()
        return [values[a:b].to_pybytes() for a, b in zip(at, at[1:])]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker, as reading the file takes a while; tasks end by ``forget``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def batches(rows, size=lambda r: 0, most: int = BATCH_CHARS):
    """Lists of rows of a bounded total size; a single larger row is a list of its own."""
    held, total = [], 0
    for r in rows:
        n = size(r)
        if held and total + n > most:
            yield held
            held, total = [], 0
        held.append(r)
        total += n
    if held:
        yield held
