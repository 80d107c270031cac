"""Token ids of many texts through the distinct words of a batch, in Arrow and numpy.

For vocabularies whose pre-tokenization drops white space and never spans it, a text may be cut at spaces and line ends, and the ids of the words concatenate to those of the text.  Words of a batch are dictionary-encoded in Arrow;
only words that are not known yet go to the library, and ids are gathered in numpy.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

JOINED = 2_000
KNOWN_WORDS = 700_000
TEXT_BYTES = 16 << 20
STOPS = r"(\pL)([.,])( |$)"  # a stop that ends a word of the text is a token of its own
STOPS_OR_LINES = r"(\pL)([.,])(\s|$)"
ODD = r"[\s\pZ\x0B\x1C-\x1F\x{85}][\s\pZ\x0B\x1C-\x1F\x{85}]"  # white space of any definition beside white space
MARK = "\ue000"
PUNCTUATION = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())


def lines_of(offsets: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[offsets[r]:offsets[r + 1]]`` of all ``rows`` one after the other, and their ends."""
    sizes = offsets[rows + 1] - offsets[rows]
    ends = sizes.cumsum()
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(offsets[rows] - ends + sizes, sizes)
    return values[at], ends


def gathered(batches: Iterable[pa.RecordBatch], text: int, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together while their texts (column ``text``) have fewer than ``most`` bytes, as words repeat."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(text).nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


class WordTokenizer:
    """Ids of texts under a vocabulary whose words end at white space (unsigned 16-bit when they fit)."""

    def __init__(self, path: str, limit: int = KNOWN_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True  # their strings are ordinary text
        self.size = self.t.get_vocab_size()
        self.ends = np.zeros(self.size, bool)
        for token, i in self.t.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.limit = limit
        self.known: dict[str, bytes] = {"": b""}

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.t.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters alone: each has one token or more that ends a word, joined they are cut there."""
        out: list[bytes] = []
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            ids = np.array(self.t.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.nonzero(self.ends[ids])[0] + 1
            if len(cuts) != len(some):  # a word fell apart under normalization
                out += self._alone(some)
                continue
            codes, width, start = ids.tobytes(), self.kind.itemsize, 0
            for cut in (cuts * width).tolist():
                out.append(codes[start:cut])
                start = cut
        return out

    def _learn(self, words: list[str]) -> None:
        """A word of letters before a run of ASCII punctuation is two tokens or more, cut between the two."""
        stems, rest, pairs = set(), set(), []
        for w in words:
            stem = w.rstrip(PUNCTUATION)
            if stem and stem.isalpha():
                pairs.append((w, stem, w[len(stem):]))
                stems.add(stem), rest.add(w[len(stem):])
            else:
                rest.add(w)
        new = [w for w in stems if w not in self.known]
        self.known.update(zip(new, self._letters(new)))
        new = [w for w in rest if w not in self.known]
        self.known.update(zip(new, self._alone(new)))
        for w, stem, tail in pairs:
            if tail:
                self.known[w] = self.known[stem] + self.known[tail]

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, dict[int, bytes]]:
        """Words of each text, and the codes of texts that were not cut."""
        texts = pc.replace_substring(texts, "\n", " ")
        return pc.split_pattern(pc.replace_substring_regex(texts, STOPS, r"\1 \2\3"), " "), {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the end of each text among them; null gives none."""
        words, whole = self._cut(pc.fill_null(texts.cast(pa.large_string()), ""))
        ends = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        coded = pc.dictionary_encode(words.flatten())
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > self.limit:  # the earlier half stays, as common words come early; no result changes
            self.known = dict(islice(self.known.items(), self.limit // 2))
        known = self.known
        fresh = [w for w in distinct if w not in known]
        if fresh:
            self._learn(fresh)
        codes = [known[w] for w in distinct]
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in codes])]) // self.kind.itemsize
        ids, stops = lines_of(offsets.astype(np.int64), np.frombuffer(b"".join(codes), self.kind), coded.indices.to_numpy().astype(np.int64))
        ends = np.concatenate([[0], stops])[ends]
        return with_whole(ids, ends, {i: np.frombuffer(c, self.kind) for i, c in whole.items()}) if whole else (ids, ends)


def with_whole(ids: np.ndarray, ends: np.ndarray, whole: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Put the ids of some texts in; the words of these texts gave none."""
    sizes = np.diff(ends, prepend=0)
    parts, at = [], 0
    for i in sorted(whole):
        parts += [ids[at : ends[i]], whole[i]]
        at = ends[i]
        sizes[i] = len(whole[i])
    return np.concatenate([*parts, ids[at:]]), sizes.cumsum()


def with_ends(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text closed by ``end_id``."""
    ends = ends + np.arange(1, len(ends) + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, end_id, ids.dtype)
    own = np.ones(len(out), bool)
    own[ends - 1] = False
    out[own] = ids
    return out, ends


class ByteTokenizer(WordTokenizer):
    """Ids of texts under a byte-level vocabulary.  ``MARK`` begins a word that has no space before it."""

    def __init__(self, path: str, limit: int = KNOWN_WORDS):
        super().__init__(path, limit)
        if type(self.t.pre_tokenizer).__name__ != "ByteLevel" or self.t.normalizer is not None:
            raise ValueError("a byte-level vocabulary is needed")
        self.sizes = np.zeros(self.size, np.int64)  # bytes that each id stands for: a character of its token each
        for token, i in self.t.get_vocab().items():
            self.sizes[i] = len(token)
        self.line_end = self.t.encode("\n", add_special_tokens=False).ids
        self.known = {MARK: b""}

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, dict[int, bytes]]:
        odd = np.nonzero(pc.or_(pc.match_substring_regex(texts, ODD), pc.match_substring(texts, MARK)).to_numpy(zero_copy_only=False))[0]
        whole = {}
        if len(odd):
            whole = dict(zip(odd.tolist(), self._alone(texts.take(pa.array(odd)).to_pylist())))
            even = np.ones(len(texts), bool)
            even[odd] = False
            texts = pc.if_else(pa.array(even), texts, "")
        texts = pc.replace_substring_regex(texts, STOPS_OR_LINES, rf"\1 {MARK}\2\3")
        texts = pc.replace_substring(texts, "\n", f" {MARK}\n {MARK}")
        return pc.split_pattern(pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), texts, pa.scalar("", pa.large_string())), " "), whole

    def _lines(self, words: list[str]) -> list[bytes]:
        """Words of letters alone, without a space before them, joined by line ends."""
        out: list[bytes] = []
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            ids = np.array(self.t.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.nonzero(ids == self.line_end[0])[0]
            if len(self.line_end) != 1 or len(cuts) != len(some) - 1:
                out += self._alone(some)
            else:
                out += [x[min(1, i):].tobytes() for i, x in enumerate(np.split(ids, cuts))]
        return out

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Words with a space before each: cut where the bytes of their tokens add up."""
        out: list[bytes] = []
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            ids = np.array(self.t.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, self.kind)
            ends, have = np.cumsum([len(w.encode()) for w in some]), self.sizes[ids].cumsum()
            cuts = np.searchsorted(have, ends) + 1
            if not len(have) or (have[np.minimum(cuts, len(have)) - 1] != ends).any():
                raise ValueError("the tokens do not add up to the words")
            codes, start = ids.tobytes(), 0
            for cut in (cuts * self.kind.itemsize).tolist():
                out.append(codes[start:cut])
                start = cut
        return out

    def _learn(self, words: list[str]) -> None:
        for keep, text, encode in (
                (lambda w: w[:1] != MARK and w != "" and not w[0].isspace() and not w[-1].isspace(), lambda w: " " + w, self._spaced),
                (lambda w: w[:1] == MARK and w[1:].isalpha(), lambda w: w[1:], self._lines),
                (lambda w: True, lambda w: w[1:] if w[:1] == MARK else " " + w, self._alone)):
            some = [w for w in words if w not in self.known and keep(w)]
            self.known.update(zip(some, encode([text(w) for w in some])))


_LOADED: dict[tuple, WordTokenizer] = {}


def word_tokenizer(path: str, kind: type[WordTokenizer] = WordTokenizer) -> WordTokenizer:
    """One per worker process and file."""
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = kind(path)
    return _LOADED[path, kind]
