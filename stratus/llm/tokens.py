"""Token ids of whole texts from a public byte-level BPE vocabulary.

A text is cut before every space (and around every line feed) that stands
alone between two other characters. No token of a GPT-2 style vocabulary
crosses such a place, and the cut depends only on the characters beside it, so
the ids of a text are the ids of its chunks in order. Chunks repeat: a slice's
chunks are dictionary-encoded, so each distinct one is looked up once, by its
bytes, in a table of bounded size. New ones are tokenised by the library, those
without inner white space by the faster of two that read the same vocabulary.
"""

from __future__ import annotations

import json
import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

#: Longer chunks are tokenised but not kept.
MAX_CHUNK = 64
#: The table is emptied when it holds more chunks than this.
MAX_KEPT = 400_000

_SOLID = np.zeros(256, bool)  # last byte of a character that is no white space
_SOLID[0x21:0x7F] = True
_TWO_BYTE = np.zeros(256, bool)  # lead bytes of two-byte characters that are no white space
_TWO_BYTE[0xC3:0xE0] = True
#: Bytes of characters that may be white space, or that are not looked into.
_ODD = ~(_SOLID | _TWO_BYTE)
_ODD[0x80:0xC0] = False


#: How a byte-level vocabulary of this kind cuts a text into words (a fixed value).
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary's tokens as bytes with their ids, if the ids follow the
    order of the merges and nothing else is done to a text; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or model["type"] != "BPE" or cut.get("type") != "ByteLevel" \
            or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                  "byte_fallback", "ignore_merges")):
        return None
    vocabulary = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = [vocabulary[a + b] for a, b in pairs]
    if any(a >= b for a, b in zip(order, order[1:])):
        return None
    # A byte that has no printing character of its own is written by one from 256 on.
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in printed}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in byte.values())}
    added = {t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if i not in added}
    return ranks if all(bytes([b]) in ranks for b in range(256)) else None


def _chunk_edges(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk starts and ends; every byte is in one chunk of one text."""
    n = len(raw)
    solid = _SOLID[raw]  # solid[i]: the character ending at i is no white space
    solid[1:] |= (raw[1:] >= 0x80) & _TWO_BYTE[raw[:-1]]
    opens = _SOLID[raw] | _TWO_BYTE[raw]  # the character starting at i is no white space
    inner = np.zeros(n + 1, bool)
    inner[offsets] = True
    before = np.zeros(n, bool)  # a solid character of the same text ends just before
    before[1:] = solid[:-1] & ~inner[1:n]
    edge = inner.copy()
    edge[:n] |= (raw == 0x20) & before
    feed = (raw == 0x0A) & before
    feed[:-1] &= opens[1:] & ~inner[1:n]
    feed[-1:] = False
    edge[:n] |= feed
    edge[1:] |= feed
    at = np.flatnonzero(edge)
    return at[:-1], at[1:]


class Encoder:
    """Ids of batches of texts; keeps the ids of chunks that it has seen."""

    def __init__(self, path: str, max_kept: int = MAX_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.max_kept = max_kept
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = _byte_ranks(path)
        self.fast = None
        if ranks is not None:
            self.fast = tiktoken.Encoding("bytes", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            self.sizes[list(ranks.values())] = [len(t) for t in ranks]
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}  # a chunk's place in begin and count
        self.begin = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 14, np.uint32)
        self.pooled = 0

    def _tokenise(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, one after the other, and how many each has."""
        spaced = raw[starts] == 0x20
        odd = np.concatenate([[0], np.cumsum(_ODD[raw])])
        simple = (odd[ends] == odd[starts + spaced]) & (ends - starts > spaced)
        counts = np.zeros(len(starts), np.int64)
        found: list[np.ndarray] = []
        order: list[np.ndarray] = []
        group = np.flatnonzero(simple)
        for part in np.array_split(group, len(group) // 16384 + 1):
            if len(part):
                ids, n = self._tokenise_simple(raw, starts[part], ends[part], spaced[part])
                found.append(ids)
                counts[part] = n
                order.append(part)
        rest = np.flatnonzero(~simple)
        if len(rest):
            data = raw.tobytes()
            texts = [data[a:b].decode() for a, b in zip(starts[rest].tolist(), ends[rest].tolist())]
            codes = [np.array(c.ids, np.uint32) for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            counts[rest] = [len(c) for c in codes]
            found.append(np.concatenate(codes))
            order.append(rest)
        ids = np.concatenate(found)
        order_ = np.concatenate(order)
        begin = np.zeros(len(starts), np.int64)
        begin[order_] = np.concatenate([[0], np.cumsum(counts[order_])[:-1]])
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        return ids[at + np.arange(len(ids))], counts

    def _tokenise_simple(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, spaced: np.ndarray
                         ) -> tuple[np.ndarray, np.ndarray]:
        """Chunks without inner white space, tokenised as one text.

        A chunk without a space of its own is put after a line feed, which is a
        token by itself and is taken out again.
        """
        sizes = ends - starts + ~spaced
        where = np.concatenate([[0], np.cumsum(sizes)])
        data = np.full(where[-1], 0x0A, np.uint8)
        body = np.arange(where[-1]) - np.repeat(where[:-1] + ~spaced, sizes)
        inside = body >= 0
        data[inside] = raw[(np.repeat(starts, sizes) + body)[inside]]
        text = data.tobytes().decode()
        if self.fast and not any(token in text for token in self.added):
            ids = np.array(self.fast.encode_ordinary(text), np.uint32)
            ends = np.cumsum(self.sizes[ids])
            cuts = np.append(np.searchsorted(ends, where[:-1], "right"), len(ids))
        else:
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            code = self.tokenizer.encode(text, add_special_tokens=False)
            ids = np.array(code.ids, np.uint32)
            begins = np.array(code.offsets, np.int64)[:, 0]
            cuts = np.append(np.searchsorted(begins, chars[where[:-1]], "left"), len(ids))
        keep = np.ones(len(ids), bool)
        keep[cuts[:-1][~spaced]] = False
        return ids[keep], np.diff(cuts) - ~spaced

    def encode(self, raw: np.ndarray, offsets: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice's texts, each text followed by ``last``; their edges."""
        n_docs = len(offsets) - 1
        starts, ends = _chunk_edges(raw, offsets) if len(raw) else (np.zeros(0, np.int64),) * 2
        begin, count = self._look_up(raw, starts, ends)
        before = np.concatenate([[0], np.cumsum(count)])
        total = int(before[-1])
        ids = self.pool[np.repeat(begin - before[:-1], count) + np.arange(total)]
        per_doc = np.diff(before[np.searchsorted(starts, offsets)]) + 1
        edges = np.concatenate([[0], np.cumsum(per_doc)])
        out = np.full(edges[-1], last, np.uint32)
        out[np.arange(total) + np.repeat(np.arange(n_docs), per_doc - 1)] = ids
        if len(self.known) > self.max_kept or self.pooled > 8 * self.max_kept:
            self._reset()
        return out, edges

    def _look_up(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each chunk's ids lie in the pool, and how many they are."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edges = pa.py_buffer(np.append(starts, ends[-1]).astype(np.int64))
        data = pa.py_buffer(np.ascontiguousarray(raw))
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, edges, data]).dictionary_encode()
        distinct, inverse = chunks.dictionary.to_pylist(), chunks.indices.to_numpy()
        place = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        begin, count = self.begin[place], self.count[place]
        new = np.flatnonzero(place < 0)
        if len(new):
            first = np.zeros(len(distinct), np.int64)
            first[inverse[::-1]] = np.arange(len(starts) - 1, -1, -1)
            ids, counts = self._tokenise(raw, starts[first[new]], ends[first[new]])
            begin[new] = self.pooled + np.concatenate([[0], np.cumsum(counts)[:-1]])
            count[new] = counts
            self.pool = _room(self.pool, self.pooled + len(ids))
            self.pool[self.pooled:self.pooled + len(ids)] = ids
            self.pooled += len(ids)
            add = new[(ends - starts)[first[new]] <= MAX_CHUNK]
            at = len(self.known)
            self.known.update(zip([distinct[i] for i in add.tolist()], range(at, at + len(add))))
            self.begin, self.count = _room(self.begin, at + len(add)), _room(self.count, at + len(add))
            self.begin[at:at + len(add)], self.count[at:at + len(add)] = begin[add], count[add]
        return begin[inverse], count[inverse]


def _room(table: np.ndarray, size: int) -> np.ndarray:
    """``table`` with room for ``size`` entries; it at least doubles when it grows."""
    if size <= len(table):
        return table
    return np.concatenate([table, np.zeros(max(size, 2 * len(table)) - len(table), table.dtype)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
