"""SentencePiece encoding and decoding: batched Viterbi in numpy.

A text gets a space in front, spaces become the marker, and it is cut into words before each run of markers; no piece of
a vocabulary crosses such a cut (checked when it is loaded).  Distinct words are grouped by length, and all words of a
length advance together: polynomial hashes of their substrings probe the sorted keys of the pieces, one vectorised
maximum per position keeps the best sum of piece scores and a backpointer.  The segmentation is the one of greatest
summed score; on equal sums the longest last piece wins.  Characters without a piece become byte pieces.  Every word's
pieces are compared with the word, so a hash collision cannot pass.

Decoding is the exact inverse: a marker character that the text itself holds is written as bytes.  Null and empty texts
have no ids.  Repeated rows get equal ids; an empty table gives no row; extra columns are ignored.  The vocabulary (a file of fixed size) is shared with the tasks; the word cache is bounded.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from candela.llm.common import id_and_text, long_id
from candela.llm.units import UnitEncoder

MARK = "▁"
BASE = 0x9E3779B97F4A7C15  # odd, for hashes modulo 2**64
LONG = 512  # words beyond this length are segmented one by one
BLOCK = 65_536
UNKNOWN_PENALTY = 10.0
_MASK = (1 << 64) - 1


def _code_points(words: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)


class Vocabulary:
    """Pieces with scores, their sorted hash keys and the byte pieces."""

    def __init__(self, pieces: Sequence[str], scores: Sequence[float], kinds: Sequence[int]):
        # kinds as in the model file: 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte
        self.pieces, self.scores = list(pieces), np.array(scores, np.float64)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 6}
        self.unknown = next((i for i, k in enumerate(kinds) if k == 2), 0)
        normal = [i for i, k in enumerate(kinds) if k in (1, 4)]
        if any(MARK in p.lstrip(MARK) for p in (pieces[i] for i in normal)):
            raise ValueError("a piece with a marker inside cannot be segmented word by word")
        self.ids = {pieces[i]: i for i in normal}
        self.longest = max((len(pieces[i]) for i in normal), default=1)
        keys = np.array([self.key(pieces[i]) for i in normal], np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have the same key")
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(normal, np.int64)[order]
        self.unknown_score = float(self.scores[normal].min() - UNKNOWN_PENALTY) if normal else -1.0
        self.powers = np.array([pow(BASE, k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        out: list[bytes] = [p.replace(MARK, " ").encode() if k in (1, 4) else b"" for p, k in zip(pieces, kinds)]
        for value, i in self.byte_ids.items():
            out[i] = bytes([value])
        self.bytes_of = out

    @staticmethod
    def key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * BASE + ord(c) + 1) & _MASK
        return h

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        return cls([p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces])

    def _bytes(self, char: str) -> list[int]:
        return [self.byte_ids.get(b, self.unknown) for b in char.encode()]

    def _probe(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """Piece ids (or -1) of all substrings of ``length``; ``prefix`` holds the hashes of all prefixes."""
        with np.errstate(over="ignore"):
            h = prefix[:, length:] - prefix[:, :-length] * self.powers[length]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.key_ids[at], -1)

    def _prefixes(self, codes: np.ndarray) -> np.ndarray:
        prefix = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        base = np.uint64(BASE)
        with np.errstate(over="ignore"):
            for j in range(codes.shape[1]):
                prefix[:, j + 1] = prefix[:, j] * base + codes[:, j] + np.uint64(1)
        return prefix

    def _same_length(self, words: list[str]) -> list[list[int]]:
        codes = _code_points(words)
        m, n = codes.shape
        prefix = self._prefixes(codes)
        lengths = range(min(n, self.longest), 0, -1)  # the longest first: it wins on equal sums
        found = {k: self._probe(prefix, k) for k in lengths}
        value = {k: np.where(ids >= 0, self.scores[ids], -np.inf if k > 1 else self.unknown_score) for k, ids in found.items()}
        best = np.zeros((m, n + 1))
        back = np.zeros((m, n + 1), np.int64)
        for end in range(1, n + 1):
            ks = [k for k in lengths if k <= end]
            sums = np.stack([best[:, end - k] + value[k][:, end - k] for k in ks])
            top = sums.argmax(0)
            best[:, end] = np.take_along_axis(sums, top[None], 0)[0]
            back[:, end] = np.array(ks)[top]
        out = []
        for i, word in enumerate(words):
            ids: list[int] = []
            end, row = n, back[i]
            while end:
                k = int(row[end])
                piece = int(found[k][i, end - k])
                ids += [piece] if piece >= 0 else self._bytes(word[end - 1])[::-1]
                end -= k
            out.append(ids[::-1])
        return out

    def _one_long(self, word: str) -> list[int]:
        """The same search over one word, probing blocks of positions."""
        n = len(word)
        best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        piece_at = [0] * (n + 1)
        for start in range(0, n, BLOCK):
            stop = min(n, start + BLOCK)
            part = word[start : min(n, stop + self.longest - 1)]
            prefix = self._prefixes_of_one(part)
            found = [(k, self._probe(prefix, k)[0].tolist()) for k in range(1, min(len(part), self.longest) + 1)]
            for at in range(start, stop):
                for k, ids in found:
                    if at - start >= len(ids):
                        break
                    piece = ids[at - start]
                    if piece < 0 and k > 1:
                        continue
                    total = best[at] + (self.scores[piece] if piece >= 0 else self.unknown_score)
                    if total > best[at + k] or (total == best[at + k] and k > back[at + k]):
                        best[at + k], back[at + k], piece_at[at + k] = total, k, piece
        ids, end = [], n
        while end:
            ids += [piece_at[end]] if piece_at[end] >= 0 else self._bytes(word[end - 1])[::-1]
            end -= back[end]
        return ids[::-1]

    def _prefixes_of_one(self, part: str) -> np.ndarray:
        prefix, h = [0], 0
        for c in part:
            h = (h * BASE + ord(c) + 1) & _MASK
            prefix.append(h)
        return np.array(prefix, np.uint64)[None]

    def segment(self, words: Sequence[str]) -> list[list[int]]:
        """Ids of each word (spaces as markers)."""
        groups: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            groups[len(w)].append(i)
        out: list[list[int]] = [[] for _ in words]
        for n, members in groups.items():
            if not n:
                continue
            for at in range(0, len(members), max(1, 2_000_000 // (n * 16))):
                some = members[at : at + max(1, 2_000_000 // (n * 16))]
                these = [words[i] for i in some]
                for i, ids in zip(some, self._same_length(these) if n <= LONG else [self._one_long(w) for w in these]):
                    out[i] = ids
        for w, ids in zip(words, out):
            if self.decode_bytes(ids) != w.replace(MARK, " ").encode() and self.unknown not in ids:
                raise ValueError("two different strings have the same key")
        return out

    def decode_bytes(self, ids: Sequence[int]) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ``ids``: the space in front is taken off."""
        return self.decode_bytes(ids)[1:].decode("utf-8", "replace")


class TextEncoder:
    """Texts to ids, with a cache of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.mark = np.array([vocabulary.byte_ids.get(b, vocabulary.unknown) for b in MARK.encode()], "<u4").tobytes()
        self.cache = UnitEncoder(self._codes)

    def _codes(self, units: list[str]) -> list[bytes]:
        # a unit that holds the marker character itself is cut there, so that the marker can be written as bytes
        parts = [u.split(MARK) for u in units]
        flat = [p.replace(" ", MARK) for ps in parts for p in ps]
        ids = iter(self.vocabulary.segment(flat))
        return [self.mark.join([np.array(next(ids), "<u4").tobytes() for _ in ps]) for ps in parts]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        filled = [" " + t if isinstance(t, str) and t else "" for t in texts]
        return [b"".join(codes) for codes in self.cache.encode(filled)]


_LOADED: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = TextEncoder(Vocabulary.load(path))
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (array), ids_crc32 and whether decoding gives the text back."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            codes = enc.encode(texts)
            ids = [np.frombuffer(c, "<u4").astype(np.int32) for c in codes]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "n_tokens": [len(i) for i in ids], "ids": ids,
                "ids_crc32": [zlib.crc32(c) for c in codes],
                "round_trip": [enc.vocabulary.decode(i.tolist()) == t for i, t in zip(ids, texts)]})

    return long_id(id_and_text(docs).mapInPandas(run, "doc_id string, n_tokens long, ids array<int>, ids_crc32 long, round_trip boolean"))


def decode_documents(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows that hold ``ids``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = encoder(path).vocabulary
        for b in batches:
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "text": [vocabulary.decode(list(i)) if i is not None else "" for i in b["ids"]]})

    return long_id(rows.select(F.col("doc_id").cast("string").alias("doc_id"), "ids").mapInPandas(run, "doc_id string, text string"))
