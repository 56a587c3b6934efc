"""Token ids from the tokenizers library, with each distinct word encoded once per worker."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

from tidemark.llm.common import trim

#: Distinct words a worker remembers (about 45 bytes each); beyond it the longer half is forgotten.
MAX_WORDS = 800_000
#: Bytes of text encoded at a time.
GROUP_BYTES = 2 << 20
#: Unseen words encoded in one call.
_JOIN = 512

_RANDOM = np.random.Generator(np.random.Philox(11))
_BYTE_CODES = _RANDOM.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = _RANDOM.integers(0, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indices of ranges that begin at ``start`` and hold ``n``, one after the other."""
    total = int(n.sum(dtype=np.int64))
    kind = np.int32 if max(total, int(start.max(initial=0))) < 1 << 30 else np.int64
    out = np.repeat((start + n).astype(kind) - np.cumsum(n, dtype=kind), n)
    out += np.arange(total, dtype=kind)
    return out


def _word_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each string; 0 for the empty one."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    length = np.diff(offsets)
    out = np.zeros((2, len(words)), dtype=np.uint64)
    if offsets[-1] > offsets[0]:
        data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        some = length > 0
        first = (offsets[:-1] - offsets[0])[some]
        place = np.arange(len(data)) - np.repeat(first, length[some])
        for k in (0, 1):
            powers = np.cumprod(np.full(int(length.max()), _BASES[k]), dtype=np.uint64)
            h = np.add.reduceat(_BYTE_CODES[k][data] * powers[place], first)
            out[k, some] = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out[0], out[1]


class WordEncoder:
    """Encodes whole texts with a byte-level BPE of the tokenizers library.

    Its pre-tokenizer always cuts before a single space between two non-space
    characters, so a text's ids are the ids of its space-separated parts, one
    after the other. Each distinct part is encoded once and remembered, under a
    128-bit hash in sorted arrays. A text in which white space touches a space,
    or which begins or ends with one, is encoded whole. Strings of special
    tokens count as ordinary text.
    """

    def __init__(self, vocabulary: bytes) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab()
        self.vocab_size = max(vocab.values()) + 1
        self._space = np.zeros(self.vocab_size, dtype=bool)
        for token, i in vocab.items():
            self._space[i] = token.startswith("Ġ")  # the byte-level form of a space
        # sorted keys, second keys, where a word's ids begin in the pool, how many (-1: not to be cut out)
        self._key, self._check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self._at, self._n = np.empty(0, np.int64), np.empty(0, np.int32)
        self._pool, self._used = np.empty(1 << 16, dtype="<u4"), 0

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return (np.concatenate(found) if found else np.empty(0, "<u4")), np.array([len(f) for f in found], dtype=np.int64)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words, one after the other, and their numbers."""
        odd = [not w or w[0].isspace() or w[-1].isspace() for w in words]
        safe = [w for w, o in zip(words, odd, strict=True) if not o]
        ids, numbers = [], []
        groups = [safe[i : i + _JOIN] for i in range(0, len(safe), _JOIN)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False), strict=True):
            got = np.array(e.ids, dtype="<u4")
            cuts = np.flatnonzero(self._space[got])
            if len(cuts) == len(group):
                n = np.diff(cuts, append=len(got))
            else:
                got, n = self._whole([" " + w for w in group])
            ids.append(got)
            numbers.append(n)
        n = np.full(len(words), -1, dtype=np.int32)
        if safe:
            n[~np.array(odd)] = np.concatenate(numbers)
        return (np.concatenate(ids) if ids else np.empty(0, "<u4")), n

    def _find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self._key):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        place = np.minimum(np.searchsorted(self._key, key), len(self._key) - 1)
        return place, (self._key[place] == key) & (self._check[place] == check)

    def _remember(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        while self._used + len(ids) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.empty_like(self._pool)])
        self._pool[self._used : self._used + len(ids)] = ids
        size = np.maximum(n, 0).astype(np.int64)
        at = self._used + np.cumsum(size) - size
        self._used += len(ids)
        order = np.argsort(key, kind="stable")
        place = np.searchsorted(self._key, key[order])
        self._key, self._check = np.insert(self._key, place, key[order]), np.insert(self._check, place, check[order])
        self._at, self._n = np.insert(self._at, place, at[order]), np.insert(self._n, place, n[order])

    def _forget(self) -> None:
        keep = np.sort(np.argsort(self._n, kind="stable")[: len(self._n) // 2])  # long words are rare words
        size = np.maximum(self._n[keep], 0).astype(np.int64)
        kept = self._pool[_ranges(self._at[keep], size)]
        self._key, self._check, self._n, self._at = self._key[keep], self._check[keep], self._n[keep], np.cumsum(size) - size
        self._pool, self._used = np.concatenate([kept, np.empty(1 << 16, "<u4")]), len(kept)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array, one text after the other, and the ``len(texts) + 1`` borders.

        Null counts as empty. Splitting, counting distinct words, looking them
        up and laying out their ids are array operations; Python sees a word
        when it is new.
        """
        if not len(texts):
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(texts, " ")
        first = split.offsets.to_numpy().astype(np.int64)
        first, words = first - first[0], split.flatten()
        coded = words.dictionary_encode()
        place, vocabulary = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary
        heads = pc.take(words, pa.array(first[:-1])).to_pylist()
        inner = np.ones(len(place), dtype=bool)
        inner[first[:-1]] = False
        later = np.zeros(len(vocabulary), dtype=bool)
        later[place[inner]] = True
        if len(self._key) > MAX_WORDS:
            self._forget()
        key, check = _word_keys(vocabulary)
        found, known = self._find(key, check)
        fresh = np.flatnonzero(later & ~known)
        if len(fresh):
            self._remember(key[fresh], check[fresh], *self._learn(pc.take(vocabulary, pa.array(fresh)).to_pylist()))
            found, known = self._find(key, check)
        number = np.where(later & known, self._n[found] if len(self._n) else 0, 0).astype(np.int64)
        odd_word = number < 0
        odd = np.zeros(len(texts), dtype=bool)
        if odd_word.any():
            odd[np.searchsorted(first, np.flatnonzero(odd_word[place] & inner), side="right") - 1] = True
        odd |= (np.diff(first) > 1) & np.array([not h or h[-1].isspace() for h in heads], dtype=bool)
        number[odd_word] = 0
        for i in np.flatnonzero(odd).tolist():
            heads[i] = texts[i].as_py()
        head_ids, head_n = self._whole(heads)
        # the words of this group, then the heads, then nothing
        table = np.concatenate([self._pool[_ranges(self._at[found] if len(self._at) else found, number)], head_ids])
        length = np.concatenate([number, head_n, [0]])
        if odd.any():
            place[np.repeat(odd, np.diff(first))] = len(length) - 1
        place[first[:-1]] = len(number) + np.arange(len(heads))
        del words, coded, inner
        start, n = (np.cumsum(length) - length).astype(np.int32), length.astype(np.int32)[place]
        borders = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[first]
        return table[_ranges(start[place], n)], borders

    def encode_ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, with ``end_id`` after each text."""
        ids, edges = self.encode(texts)
        after = edges + np.arange(len(edges))
        out = np.empty(len(ids) + len(texts), dtype="<u4")
        hold = np.ones(len(out), dtype=bool)
        hold[after[1:] - 1] = False
        out[hold], out[~hold] = ids, end_id
        return out, after


def grouped(batches: Iterator[pa.RecordBatch], text: int = 1, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Deal rows of Arrow batches into groups whose column ``text`` holds about ``size`` bytes, or one longer text.

    Larger groups repeat more words; smaller ones need less memory.
    """
    size = size or GROUP_BYTES
    held: list[pa.RecordBatch] = []
    filled = 0

    def group() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = int(np.searchsorted(ends, before + size - filled, side="right"))
            if end > at or not held:
                end = max(end, at + 1)
                held.append(batch.slice(at, end - at))
                filled, at = filled + int(ends[end - 1]) - before, end
            if at < batch.num_rows:  # the next row doesn't fit
                yield group()
                held, filled = [], 0
                trim()
    if held:
        yield group()
    held = []
    trim()


_ENCODERS: dict[str, WordEncoder] = {}


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary file on its way to the executors: they need no file of that name."""

    digest: str
    content: Broadcast

    @staticmethod
    def ship(spark: SparkSession, path: str) -> Vocabulary:
        """Read the file on the driver and broadcast its bytes (some MB, whatever the corpus)."""
        with open(path, "rb") as f:
            raw = f.read()
        return Vocabulary(hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw))

    def encoder(self) -> WordEncoder:
        """One encoder a worker process; workers serve many tasks."""
        if self.digest not in _ENCODERS:
            _ENCODERS[self.digest] = WordEncoder(self.content.value)
        return _ENCODERS[self.digest]


def public_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
