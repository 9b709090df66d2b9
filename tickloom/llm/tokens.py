"""Token ids of whole texts with the tokenizers library, many texts at once.

Neither vocabulary lets a token span the step from a visible character to white space, or from a letter of ASCII or Latin-1 to an
ASCII mark other than the apostrophe, so a text's ids are the ids of its chunks between such steps put end to end. A batch is cut into chunks with numpy,
every chunk that the worker has not met is encoded once by the library, and the ids are gathered per document. Chunks that are new go
to the library some at a time. Letters with at most a space before them are one piece to a byte-level vocabulary, so they go straight to its model, named as it names bytes;
others of such a vocabulary that begin with white space and end otherwise are put end to end. The bytes of the ids tell both apart; what is left has the name of a special token between them, whose id tells. Texts with white space
outside ASCII are encoded whole, because there a run of white space can be cut in its middle, and so are texts that hold the name of one
of the vocabulary's special tokens, which the library takes for that token.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tickloom.llm.common import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of chunks that a worker remembers at most between two batches, each takes some 150 bytes besides; beyond, it keeps the half that it met first, which has the frequent ones.
MOST_BYTES = 10 << 20
MOST_CHUNKS = 1_000_000
#: Bytes of text to encode at once: the more, the fewer chunks are looked up again.
SLICE_BYTES = 8 << 20
#: New chunks that the library is given as one text.
TOGETHER = 64
_ODD_SPACE = "[\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
# Bytes as 1 for white space, 2 for the marks that are cut off, 3 for those that white space outside ASCII may start with.
_KINDS = bytes(1 if b in b"\t\n\x0b\x0c\r " else 2 if b in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" else 3 if b in (0xC2, 0xE1, 0xE2, 0xE3) else 0 for b in range(256))
# Second bytes of the letters from U+00C0 to U+00FF, after 0xC3.
_LATIN = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])
# The character by which a byte-level vocabulary names each byte: itself where it is visible, or else the next one from U+0100 on.
_NAMED = np.array([b if 33 <= b <= 126 or 161 <= b != 173 else 256 + sum(not (33 <= c <= 126 or 161 <= c != 173) for c in range(b)) for b in range(256)], np.uint32)
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[9, 10, 11, 12, 13]] = 32


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


class Chunks:
    """Byte strings end to end in an Arrow array; iterates over them as bytes, without a pyarrow object for each."""

    def __init__(self, strings: pa.LargeBinaryArray):
        at = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
        self.strings, self.at = strings, at - at[0]
        self.raw = np.frombuffer(strings.buffers()[2], np.uint8)[at[0] : at[-1]] if len(strings) else np.zeros(0, np.uint8)

    def __len__(self) -> int:
        return len(self.strings)

    def __iter__(self) -> Iterator[bytes]:
        at, data = self.at.tolist(), self.raw.tobytes()
        return (data[a:b] for a, b in zip(at, at[1:]))


class Encoder:
    """Encodes arrays of texts; keeps the ids of the chunks it has met, up to a bound."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # A vocabulary that lower-cases and drops white space lets chunks be folded before they are looked up.
        self.folds = isinstance(self.tokenizer.normalizer, Sequence) and self._ids("Ab\tC\n d") == self._ids("ab c  d")
        added = self.tokenizer.get_added_tokens_decoder()
        special = [t.content for t in added.values()]
        # A token that may stand between chunks: its name is taken wherever it stands, and with nothing around it.
        plain = [(t.content.encode(), i) for i, t in added.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.between = next((p for p in plain if self._ids(f" a{p[0].decode()}b\tc") == [*self._ids(" a"), p[1], *self._ids("b\tc")]), None)
        # How many bytes each id stands for, where the vocabulary names every byte by a character.
        cutter = self.tokenizer.pre_tokenizer
        self.widths = None
        if isinstance(cutter, ByteLevel) and cutter.use_regex and not cutter.add_prefix_space and self.tokenizer.normalizer is None:
            named = self.tokenizer.get_vocab()
            self.widths = np.zeros(max(named.values()) + 1, np.int64)
            self.widths[list(named.values())] = list(map(len, named))
            # The same model for words that are already named so and stand between spaces.
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = WhitespaceSplit()
        self.special = "|".join(re.escape(t) for t in special)
        self.hints = {t[:2].encode() for t in special}
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        """The numbers of the chunks met, the number of ids of each, and these ids end to end."""
        self.known, self.sizes, self.flat, self.bytes = _Numbers(), np.zeros(0, np.int64), np.zeros(0, np.int32), 0

    def _trim(self) -> None:
        """Keep the chunks met first that make half of what may be remembered."""
        ends = np.cumsum(np.fromiter(map(len, self.known), np.int64, len(self.known)))
        n = min(int(np.searchsorted(ends, MOST_BYTES // 2, side="right")), MOST_CHUNKS // 2, len(ends))
        self.known, self.bytes = _Numbers(zip(islice(self.known, n), range(n))), int(ends[n - 1]) if n else 0
        self.sizes = self.sizes[:n].copy()
        self.flat = self.flat[: int(self.sizes.sum())].copy()

    def _library(self, chunks: Chunks) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks end to end, and the number of ids of each."""
        if self.widths is None or not len(chunks):
            return self._apart(chunks)
        lengths, ends, raw = np.diff(chunks.at), chunks.at[1:], chunks.raw
        latin = np.zeros(len(raw), bool)
        latin[1:] = _LATIN[raw[1:]] & (raw[:-1] == 0xC3)
        letter = _LETTER[raw] | latin
        letter[:-1] |= latin[1:]
        spaced = raw[ends - lengths] == 32
        word = np.add.reduceat(letter, ends - lengths, dtype=np.int64) + spaced == lengths
        joins = ~word & _SPACE[raw[ends - lengths]] & ((~_SPACE[raw[ends - 1]] & (raw[ends - 1] < 0x80)) | latin[ends - 1])
        rest = ~word & ~joins
        sizes = np.zeros(len(chunks), np.int64)
        ids = []
        for kind, found in ((word, self._words), (joins, self._joined), (rest, self._apart)):
            part, sizes[kind] = found(Chunks(chunks.strings.filter(pa.array(kind)))) if kind.any() else (np.zeros(0, np.int32), 0)
            ids.append(part)
        kind = np.repeat(joins + 2 * rest.astype(np.int8), sizes)
        out = np.zeros(len(kind), np.int32)
        for k, part in enumerate(ids):
            out[kind == k] = part
        return out, sizes

    def _words(self, chunks: Chunks) -> tuple[np.ndarray, np.ndarray]:
        """As ``_library``, for letters with at most a space before them; each is one piece to a byte-level vocabulary."""
        lengths, ends = np.diff(chunks.at), chunks.at[1:]
        named = np.full(len(chunks.raw) + len(chunks), 32, np.uint32)
        named[np.arange(len(chunks.raw)) + np.repeat(np.arange(len(chunks)), lengths)] = _NAMED[chunks.raw]
        text = named.tobytes().decode("utf-32-le")
        return self._cut(self.words, text, ends + np.arange(1, len(chunks) + 1), ends)

    def _joined(self, chunks: Chunks) -> tuple[np.ndarray, np.ndarray]:
        """As ``_library``, for chunks that no id spans when they stand end to end."""
        return self._cut(self.tokenizer, chunks.raw.tobytes(), chunks.at[1:], chunks.at[1:])

    def _cut(self, tokenizer, text: str | bytes, stops: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks that end at ``stops`` in a text and after so many bytes."""
        cuts = [0, *stops[TOGETHER - 1 : -1 : TOGETHER].tolist(), len(text)]
        parts = [text[a:b] if isinstance(text, str) else text[a:b].decode() for a, b in zip(cuts, cuts[1:])]
        ids = np.fromiter(chain.from_iterable(e.ids for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)), np.int32)
        reached = np.cumsum(self.widths[ids])
        upto = np.searchsorted(reached, ends) + 1
        if upto[-1] != len(ids) or (reached[upto - 1] != ends).any():
            raise ValueError("an id spans two chunks")
        return ids, np.diff(upto, prepend=0)

    def _apart(self, chunks: Chunks) -> tuple[np.ndarray, np.ndarray]:
        """As ``_library``, for any chunks."""
        chunks = list(chunks)
        if not chunks:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if self.between is None:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for ids in found for i in ids), np.int32, int(sizes.sum())), sizes
        name, end = self.between
        joined = [name.join(chunks[k : k + TOGETHER]).decode() for k in range(0, len(chunks), TOGETHER)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False) for i in (*e.ids, end)], np.int32)
        ends = np.flatnonzero(ids == end)
        if len(ends) != len(chunks):
            raise ValueError("a chunk holds the name of a special token")
        return ids[ids != end], np.diff(ends, prepend=-1) - 1

    def _learn(self, chunks: pa.LargeBinaryArray) -> None:
        """Keep the ids of chunks, which have the numbers after those met before."""
        learnt = [self._library(Chunks(chunks.slice(k, 50_000))) for k in range(0, len(chunks), 50_000)]
        self.flat = np.concatenate([self.flat, *(ids for ids, _ in learnt)])
        self.sizes = np.concatenate([self.sizes, *(sizes for _, sizes in learnt)])
        self.bytes += int(Chunks(chunks).at[-1])

    def _numbers(self, distinct: pa.LargeBinaryArray) -> np.ndarray:
        """The numbers of distinct chunks; new ones are learnt."""
        met = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, Chunks(distinct)), np.int64, len(distinct))
        try:
            self._learn(distinct.filter(pa.array(at >= met)))
        except BaseException:
            self._forget()  # a later task may get this worker
            raise
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the number of ids of each; a null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if len(self.known) > MOST_CHUNKS or self.bytes > MOST_BYTES:
            self._trim()
        lengths = np.asarray(pc.binary_length(texts)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        data = b"".join(texts.cast(pa.large_binary()).to_pylist())
        if self.special and any(h in data for h in self.hints):
            named = np.asarray(pc.match_substring_regex(texts, self.special))
            if named.any():
                return self._around(texts, named)
        raw = np.frombuffer(data, np.uint8)
        if self.folds:
            raw = _PLAIN[raw]
            data = raw.data
        odd = np.zeros(len(texts), bool)
        kinds = np.frombuffer(bytes(data).translate(_KINDS), np.uint8)
        if (kinds == 3).any():
            odd = np.asarray(pc.match_substring_regex(texts, _ODD_SPACE))
        space = kinds == 1
        first = space.copy()
        first[1:] &= ~space[:-1]
        mark = np.flatnonzero(kinds == 2)
        before, lead = raw[np.maximum(mark - 1, 0)], raw[np.maximum(mark - 2, 0)]
        first[mark[_LETTER[before] | (_LATIN[before] & (lead == 0xC3))]] = True
        first[offsets[:-1][lengths > 0]] = True
        cuts = np.flatnonzero(first)
        doc = np.searchsorted(offsets, cuts, side="right") - 1
        if odd.any():
            keep = ~odd[doc] | (cuts == offsets[doc])
            cuts, doc = cuts[keep], doc[keep]
        bounds = np.concatenate([cuts, [len(raw)]]).astype(np.int64)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = chunks.dictionary_encode()
        entry = self._numbers(coded.dictionary)[np.asarray(coded.indices)]
        sizes = self.sizes[entry]
        starts = (np.cumsum(self.sizes) - self.sizes)[entry]
        ids = self.flat.take(np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum())), mode="clip")
        counts = np.bincount(doc, weights=sizes, minlength=len(texts)).astype(np.int64)
        return ids, counts

    def _around(self, texts: pa.Array, named: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``; the texts ``named`` go to the library as they are."""
        ids, counts = self.encode(pc.if_else(pa.array(named), "", texts))
        whole = {i: np.array(self._ids(texts[i].as_py()), ids.dtype) for i in np.flatnonzero(named).tolist()}
        parts, stop = [], 0
        for i in sorted(whole):
            upto = int(counts[:i].sum())
            parts += [ids[stop:upto], whole[i]]
            stop = upto
        parts.append(ids[stop:])
        counts[list(whole)] = [len(w) for w in whole.values()]
        return np.concatenate(parts), counts


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file; it lives on from task to task, until one does other work."""
    return held(path, lambda: Encoder(path))


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)
