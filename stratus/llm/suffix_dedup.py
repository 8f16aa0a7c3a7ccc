"""Exact substring de-duplication across documents by suffix sorting.

A byte is removed when some ``width``-byte string that covers it also starts
in a document with a smaller id. Strings are judged on the input.

Every ``width``-byte window names one anchor: the ``gram``-byte string inside
it with the least hash. Equal windows have equal anchors at equal offsets, so
equal windows always meet at their anchor, while a text has an anchor only
about every eighteenth byte. Three passes over hash chunks of the documents
use one shuffle of the texts:

1. an anchor's windows reach at least half of their other bytes to its left, or
   else to its right: the anchor with those bytes is the key of that half, and
   equal windows have equal keys. (Anchors alone are too short: in a large corpus
   nearly each of them is met again by chance.) The distinct keys of each chunk are
   dealt to buckets by their anchors, with the number of their contexts; the answer
   is two bits per key: does another chunk have it too, and are the contexts of
   its anchor too many for one bucket;
2. for the keys that other documents have too, the text of their
   windows goes to the anchor's bucket, once per chunk with the chunk's least
   document id (the windows of a very common anchor go to buckets by their own
   hashes instead, so that no bucket gathers them all). There the window suffixes are put in order by a mergesort
   whose comparisons find the common extension of two suffixes by binary
   search over prefix polynomial hashes; the order is verified byte by byte,
   and equal neighbours give every window its least document id;
3. the removed ranges return to the chunks, which cut the texts.

Chunks and buckets hold a bounded number of bytes, and a bucket is settled in lots
of whole anchors; the copies of a passage in
one chunk are sent once, so a passage that many documents share is a row per
chunk at most. A row is a chunk and a bucket, so rows grow faster than the text:
both are large enough that a row holds many keys. Nothing is collected.

Defined cases: a null text is empty; texts shorter than ``width`` lose
nothing; documents with equal ids do not remove each other's bytes; a row
without an id neither loses bytes nor makes others lose them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

WIDTH, GRAM = 50, 16
#: Bytes of text in a chunk, and of text that a bucket's anchors stand for.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
#: Windows around an anchor whose contexts have more bytes than this are dealt
#: one by one, at about 13 times the bytes: that many chunks have it is no reason.
HOT_BYTES = 8 << 20
#: Bytes of contexts that are settled at once.
LOT_BYTES = 4 << 20
#: Windows that are sorted at once.
SORT_WINDOWS = 100_000

_POSITION_BITS = 26
#: Bytes that anchors are searched in at once, and rows compared at once.
_SEGMENT, _ROWS = 1 << 18, 10_000
#: Places of a context that take the room of another context.
_USES = 8
#: A key inside its bucket: bits of its anchor, then bits of its own.
_ANCHOR_BITS, _KEY_BITS = 12, 20


def anchor_runs(raw: np.ndarray, offsets: np.ndarray, powers: blocks.Powers, width: int = WIDTH, gram: int = GRAM
                ) -> tuple[np.ndarray, ...]:
    """Halves of the runs of windows with one anchor: the hashes of the anchor,
    of the half's key and of its text, the anchor's position, the first and the
    last window. A run's left half stands before its right half."""
    right = (width - gram) // 2  # bytes of a right key after the anchor
    left = width - gram - right + 1  # and of a left key before it
    found = [np.zeros((6, 0), np.int64)]
    for base in range(0, max(len(raw) - width + 1, 0), _SEGMENT):
        part = raw[base:base + _SEGMENT + width - 1]
        prefix = blocks.PrefixHash(part, powers)
        h = blocks.mix(prefix.windows(gram))
        low = np.uint64((1 << _POSITION_BITS) - 1)
        # The least of the leading hash bits, the leftmost of equal ones.
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        n, span, reach = len(part) - width + 1, width - gram + 1, 1
        while reach * 2 <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        least = np.minimum(least[:n], least[span - reach:span - reach + n])
        window = np.arange(n)
        doc = np.searchsorted(offsets, base + window, "right") - 1
        window = window[base + window + width <= offsets[doc + 1]]
        if not len(window):
            continue
        at, doc = (least[window] & low).astype(np.int64), doc[window]
        fresh = np.ones(len(window), bool)
        fresh[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        edge = np.flatnonzero(fresh)
        at, first, last = at[edge], window[edge], np.append(window[edge[1:] - 1], window[-1])
        # The windows up to ``left`` bytes before the anchor hold the left key, the others the right one.
        cut = np.clip(at - left + 1, first, last + 1)
        first, last = np.stack([first, cut], 1), np.stack([cut - 1, last], 1)
        some = np.flatnonzero((first <= last).ravel())
        at, first, last, after = np.repeat(at, 2)[some], first.ravel()[some], last.ravel()[some], some % 2
        key = prefix.span(at - left * (1 - after), at + gram + right * after)
        text = prefix.span(first, last + width)
        # Least hashes crowd the low end of their range: mixed again, they deal evenly.
        anchor = blocks.mix(h[at] * np.uint64(blocks.BASE))
        found.append(np.stack([anchor.view(np.int64), blocks.mix(key + after.astype(np.uint64)).view(np.int64),
                               text.view(np.int64), base + at, base + first, base + last]))
    runs = np.concatenate(found, axis=1)
    return runs[0].view(np.uint64), runs[1].view(np.uint64), runs[2].view(np.uint64), runs[3], runs[4], runs[5]


def half_keys(anchor: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The anchor's leading bits, by which its keys are dealt, and below them the
    key as it is told apart inside a bucket."""
    return ((anchor >> np.uint64(32) << np.uint64(32)) | ((anchor & np.uint64((1 << _ANCHOR_BITS) - 1)) << np.uint64(_KEY_BITS))
            | (key >> np.uint64(64 - _KEY_BITS)))


def _bucket(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)


def _group_edges(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


_ZSTD = "zstd"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes with their lengths; one that does not get shorter stays as it is."""
    codec = pa.Codec(_ZSTD)
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        packed = [min(t, codec.compress(t, asbytes=True), key=len) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(packed, pa.binary()),
             batch.column("row_key"), batch.column("chunk")], ["doc_id", "size", "packed", "row_key", "chunk"])


def unpacked(table: pa.Table) -> list[bytes]:
    codec = pa.Codec(_ZSTD)
    return [p if len(p) == n else codec.decompress(p, n, asbytes=True)
            for p, n in zip(table.column("packed").to_pylist(), table.column("size").to_pylist())]


class _Chunk:
    """The documents of a chunk in a fixed order, as bytes."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("doc_id", "ascending"), ("row_key", "ascending")])
        texts = unpacked(table)
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        self.doc_id = table.column("doc_id")
        known = np.asarray(self.doc_id.is_valid())
        self.ids = np.asarray(self.doc_id.fill_null(0).to_numpy(), np.int64)
        self.known = known

    def runs(self, powers: blocks.Powers, width: int, gram: int):
        found = anchor_runs(self.raw, self.offsets, powers, width, gram)
        doc = np.searchsorted(self.offsets, found[4], "right") - 1
        keep = self.known[doc]
        return tuple(x[keep] for x in (*found, doc))


def _emit_anchors(n_buckets: int, width: int, gram: int):
    def emit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        anchor, half, text = _Chunk(table).runs(blocks.Powers(), width, gram)[:3]
        keys, loads = anchor_loads(half_keys(anchor, half), text)
        edges = _group_edges(_bucket(keys, n_buckets))
        # Inside a bucket 32 bits tell keys apart; a clash only costs a comparison.
        short = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :4]
        return pa.table({
            "bucket": pa.array(_bucket(keys, n_buckets)[edges[:-1]], pa.int64()),
            "chunk": pa.array(np.full(len(edges) - 1, key[0].as_py()), pa.int64()),
            "anchors": pa.array([short[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
            "loads": pa.array([loads[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())})
    return emit


def anchor_loads(anchor: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a chunk, and what each sends to its bucket: one
    for every different context, and one for every ``_USES`` places of them."""
    order = np.lexsort((text, anchor))
    anchor, text = anchor[order], text[order]
    edges = _group_edges(anchor)
    fresh = np.ones(len(order), np.int64)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    loads = (np.add.reduceat(fresh, edges[:-1]) if len(order) else fresh) + np.diff(edges) // _USES
    return anchor[edges[:-1]], np.minimum(loads, 0xFFFF).astype("<u2")


def _mark_shared(hot_chunks: int | None, hot_load: int):
    def mark(table: pa.Table) -> pa.Table:
        return _marks(table, hot_chunks, hot_load, 4, _KEY_BITS)
    return mark


def _marks(table: pa.Table, hot_chunks: int | None, hot_load: int, key_bytes: int = 5, own_bits: int = 0) -> pa.Table:
    """Per chunk two bits for each of its keys: another chunk has it too, and
    what its anchor sends is above ``hot_load`` (or more than ``hot_chunks`` have
    the key). The bits above the ``own_bits`` of a key are its anchor's."""
    blobs = table.column("anchors").to_pylist()
    sizes = np.array([len(b) // key_bytes for b in blobs])
    short = np.zeros((sizes.sum(), 8), np.uint8)
    short[:, :key_bytes] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, key_bytes)
    values = short.view("<u8")[:, 0]
    order = np.argsort(values, kind="stable")
    values = values[order]
    edges = _group_edges(values)
    stops = np.concatenate([[0], np.cumsum(sizes)])
    loads = np.frombuffer(b"".join(table.column("loads").to_pylist()), "<u2").astype(np.int64)
    chunks = np.diff(edges)
    shared = chunks > 1
    load = np.add.reduceat(loads[order], edges[:-1]) if len(order) else loads
    load = load * (shared | (load > 1))  # the others send nothing, or one context from their chunk
    per_anchor = _group_edges(values[edges[:-1]] >> np.uint64(own_bits))
    crowd = np.maximum.reduceat(chunks, per_anchor[:-1]) if len(order) else chunks
    hot = (np.add.reduceat(load, per_anchor[:-1]) if len(order) else load) > hot_load
    if hot_chunks is not None:
        hot |= crowd > hot_chunks
    hot = np.repeat(hot, np.diff(per_anchor))

    def bits(keys: np.ndarray) -> pa.Array:
        flags = np.zeros(len(values), bool)
        flags[order] = np.repeat(keys, chunks)
        return pa.array([np.packbits(flags[a:b]).tobytes() for a, b in zip(stops[:-1], stops[1:])], pa.binary())
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"),
                     "shared": bits(shared), "hot": bits(hot)})


#: ``packed``: of n contexts, their lengths, places of their anchors, least ids and numbers
#: of uses; their bytes; of all uses, the document, the place and whether it is a later one.
_REQUEST = "bucket bigint, chunk bigint, n int, size bigint, packed binary"


def _emit_contexts(n_buckets: int, width: int, gram: int):
    def emit(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "n": pa.array([], pa.int32()),
                          "size": pa.array([], pa.int64()), "packed": pa.array([], pa.binary())})
        if not left.num_rows or not right.num_rows:
            return empty
        chunk = _Chunk(left)
        powers = blocks.Powers()
        anchor, key_of, text, at, first, last, doc = chunk.runs(powers, width, gram)
        keys, inverse = np.unique(half_keys(anchor, key_of), return_inverse=True)
        right = right.sort_by("bucket")
        edges = _group_edges(_bucket(keys, n_buckets))
        shared, hot = (np.concatenate([
            np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a) for bits, a, b in
            zip(right.column(name).to_pylist(), edges[:-1], edges[1:])]).astype(bool) for name in ("shared", "hot"))
        ids = chunk.ids[doc]
        low, high = np.full(len(keys), 2 ** 63 - 1), np.full(len(keys), -2 ** 63)
        np.minimum.at(low, inverse, ids)
        np.maximum.at(high, inverse, ids)
        wanted = np.flatnonzero((shared | (low != high))[inverse])
        if not len(wanted):
            return empty
        hot = hot[inverse][wanted]
        anchor, text, at, first, last, doc, ids = (x[wanted] for x in (anchor, text, at, first, last, doc, ids))
        # The halves of a run that meet are one context.
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (first[1:] != last[:-1] + 1)
        heads = np.flatnonzero(fresh)
        ends = np.append(heads[1:], len(at)) - 1
        nth = (np.arange(len(at)) - np.repeat(heads, ends - heads + 1)).astype(np.uint64)
        text = np.add.reduceat(text * (nth * np.uint64(blocks.BASE - 1) + np.uint64(1)), heads)
        last = last[ends]
        anchor, at, first, doc, ids, hot = (x[heads] for x in (anchor, at, first, doc, ids, hot))
        route = anchor
        if hot.any():  # the windows of a hot anchor go their own ways, by their own hashes
            n = np.where(hot, last - first + 1, 1)
            inner = _spread(np.zeros(len(n), np.int64), n)
            anchor, text, at, first, last, doc, ids, hot = (np.repeat(x, n) for x in (anchor, text, at, first, last, doc, ids, hot))
            first = first + inner
            last = np.where(hot, first, last)
            single = np.flatnonzero(hot)
            text[single] = blocks.PrefixHash(chunk.raw, powers).span(first[single], first[single] + width)
            route = np.where(hot, blocks.mix(text), anchor)
        length, lead = last - first + width, at - first
        order = np.lexsort((ids, lead, length, text, anchor, route))
        anchor, first, length, lead, doc, ids, text, route = (
            x[order] for x in (anchor, first, length, lead, doc, ids, text, route))
        fresh = np.ones(len(order), bool)
        fresh[1:] = ((anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (length[1:] != length[:-1])
                     | (lead[1:] != lead[:-1]))
        same = np.flatnonzero(~fresh)
        fresh[same] = ~_equal_bytes(chunk.raw, first[same - 1], first[same], length[same])
        heads = np.flatnonzero(fresh)
        uses = np.diff(np.append(heads, len(order)))
        later = ids > np.repeat(ids[heads], uses)
        edges = _group_edges(_bucket(route[heads], n_buckets))
        stops = np.append(heads, len(order))[edges]
        codec, sizes, packed = pa.Codec(_ZSTD), [], []
        for a, b, x, y in zip(edges[:-1], edges[1:], stops[:-1], stops[1:]):
            parts = (length[heads[a:b]].astype("u1"), lead[heads[a:b]].astype("u1"), ids[heads[a:b]].astype("<i8"),
                     uses[a:b].astype("<u4"), chunk.raw[_spread(first[heads[a:b]], length[heads[a:b]])],
                     doc[x:y].astype("<u4"), (first[x:y] - chunk.offsets[doc[x:y]]).astype("<u4"), np.packbits(later[x:y]))
            blob = b"".join(p.tobytes() for p in parts)
            sizes.append(len(blob))
            packed.append(min(blob, codec.compress(blob, asbytes=True), key=len))
        return pa.table({
            "bucket": pa.array(_bucket(route[heads], n_buckets)[edges[:-1]], pa.int64()),
            "chunk": pa.array(np.full(len(edges) - 1, key[0].as_py()), pa.int64()),
            "n": pa.array(np.diff(edges), pa.int32()),
            "size": pa.array(sizes, pa.int64()), "packed": pa.array(packed, pa.binary())})
    return emit


def _contexts(table: pa.Table) -> tuple[np.ndarray, ...]:
    """What the rows of ``_REQUEST`` hold, each joined over the rows, and where each row's uses end."""
    rows = []
    for n, blob in zip(table.column("n").to_pylist(), unpacked(table)):
        at, row = 0, []

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(blob, kind, count, at)  # noqa: B023
            at += part.nbytes
            return part
        row += [take(n, "u1"), take(n, "u1"), take(n, "<i8"), take(n, "<u4")]
        row.append(take(int(row[0].sum(dtype=np.int64)), "u1"))
        n_uses = int(row[3].sum(dtype=np.int64))
        row += [take(n_uses, "<u4"), take(n_uses, "<u4")]
        row.append(np.unpackbits(take(-(-n_uses // 8), "u1"), count=n_uses).astype(bool))
        rows.append(row)
    length, lead, least, uses, raw, docs, places, later = (np.concatenate(x) for x in zip(*rows))
    ends = np.cumsum([len(row[5]) for row in rows])
    return (raw, *(x.astype(np.int64) for x in (length, lead, least, uses, docs, places)), later, ends)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the given spans, one span after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _equal_bytes(raw: np.ndarray, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for lo in range(0, len(x), _ROWS):
        part = slice(lo, lo + _ROWS)
        n = length[part]
        differ = raw[_spread(x[part], n)] != raw[_spread(y[part], n)]
        if len(n):
            out[part] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
    return out


class SuffixOrder:
    """Order of ``width``-byte suffix prefixes of ``raw`` within groups."""

    def __init__(self, raw: np.ndarray, hashes: blocks.PrefixHash, width: int):
        self.raw, self.width, self.hash = raw, width, hashes

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search over prefix hashes."""
        length = np.zeros(len(x), np.int64)
        step = 1 << (self.width.bit_length() - 1)
        while step:
            longer = np.minimum(length + step, self.width)
            equal = self.hash.span(x + length, x + longer) == self.hash.span(y + length, y + longer)
            length = np.where(equal, longer, length)
            step >>= 1
        return length

    def before(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether the suffix at x comes before (or equals) the one at y."""
        out = or_equal.copy()
        # Most pairs that are still compared are equal: the whole length is tried first.
        some = np.flatnonzero(self.hash.span(x, x + self.width) != self.hash.span(y, y + self.width))
        x, y = x[some], y[some]
        at = self.common(x, y)
        out[some] = self.raw[x + at] < self.raw[y + at]
        return out

    def sort(self, starts: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Bottom-up mergesort of each group's suffixes; ``groups`` is sorted."""
        order = np.arange(len(starts))
        edges = _group_edges(groups)
        size = np.repeat(np.diff(edges), np.diff(edges))
        inside = np.arange(len(starts)) - np.repeat(edges[:-1], np.diff(edges))
        run, largest = 1, int(size.max(initial=0))
        while run < largest:
            at = np.flatnonzero(size > run)
            place = inside[at]
            pair = at - place % (2 * run)  # where the two runs begin
            left = place % (2 * run) < run
            lo = np.where(left, pair + run, pair)
            hi = np.where(left, np.minimum(pair + 2 * run, at - place + size[at]), pair + run)
            lo = np.minimum(lo, hi)
            begin = lo.copy()
            own = starts[order[at]]
            open_ = np.flatnonzero(lo < hi)
            while len(open_):  # how many of the other run come first
                mid = (lo[open_] + hi[open_]) >> 1
                other = starts[order[mid]]
                first = self.before(other, own[open_], ~left[open_])
                lo[open_] = np.where(first, mid + 1, lo[open_])
                hi[open_] = np.where(first, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            target = pair + (place % (2 * run)) % run + (lo - begin)
            merged = order.copy()
            merged[target] = order[at]
            order = merged
            run *= 2
        return order

    def verified(self, starts: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order, and which suffix equals the one before it, by its bytes."""
        order = self.sort(starts, groups)
        equal = np.zeros(len(order), bool)
        sorted_, columns = True, np.arange(self.width)
        for lo in range(1, len(order), _ROWS):
            x, y = starts[order[lo - 1:lo + _ROWS - 1]], starts[order[lo:lo + _ROWS]]
            x = x[:len(y)]
            differ = self.raw[x[:, None] + columns] != self.raw[y[:, None] + columns]
            some = differ.any(1)
            at = differ.argmax(1)
            mates = groups[lo:lo + len(y)] == groups[lo - 1:lo - 1 + len(y)]
            sorted_ &= not (mates & some & (self.raw[x + at] > self.raw[y + at])).any()
            equal[lo:lo + len(y)] = mates & ~some
        if not sorted_:  # hashes of different bytes were equal: order by the bytes themselves
            words = np.unique(self.raw[starts[:, None] + columns], axis=0, return_inverse=True)[1].ravel()
            order = np.lexsort((words, groups))
            equal = np.zeros(len(order), bool)
            equal[1:] = (words[order][1:] == words[order][:-1]) & (groups[order][1:] == groups[order][:-1])
        return order, equal


def _words(raw: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` (up to 8) bytes at each position as one number, in byte order."""
    out = np.zeros(len(at), np.uint64)
    for i in range(n):
        out = (out << np.uint64(8)) | raw[at + i]
    return out


def _batches(numbers: np.ndarray) -> list[np.ndarray]:
    """Positions of equal neighbours."""
    edges = _group_edges(numbers)
    return [np.arange(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _least_ids(order: np.ndarray, equal: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Per suffix the least id among the equal ones."""
    out = np.empty(len(ids), np.int64)
    if len(ids):
        heads = np.flatnonzero(~equal)
        least = np.minimum.reduceat(ids[order], heads)
        out[order] = np.repeat(least, np.diff(np.append(heads, len(ids))))
    return out


def _anchor_lots(raw: np.ndarray, at: np.ndarray, gram: int, n_lots: int) -> np.ndarray:
    """The lot of each context, by the bytes of its anchor."""
    code = np.zeros(len(at), np.uint64)
    for i in range(gram):
        code = code * np.uint64(blocks.BASE) + raw[at + i]
    return (blocks.mix(code) % np.uint64(n_lots)).astype(np.int64)


def _hit_windows(raw: np.ndarray, length: np.ndarray, lead: np.ndarray, least: np.ndarray, width: int, gram: int,
                 sort_windows: int) -> tuple[np.ndarray, np.ndarray]:
    """The head of each context (of equal ones that with the least id), and for
    every window whether it also starts in a document of smaller id: of heads only."""
    powers = blocks.Powers()
    start = np.cumsum(length) - length
    n_windows = length - width + 1
    hashes = blocks.PrefixHash(raw, powers)
    anchor, text = hashes.span(start + lead, start + lead + gram), hashes.span(start, start + length)
    order = np.lexsort((least, lead, length, text, anchor))
    same = np.zeros(len(order), bool)
    s = (anchor[order], text[order], length[order], lead[order])
    same[1:] = np.logical_and.reduce([x[1:] == x[:-1] for x in s])
    at = np.flatnonzero(same)
    same[at] = _equal_bytes(raw, start[order[at - 1]], start[order[at]], length[order[at]])
    heads = np.flatnonzero(~same)  # the first of equal contexts has the least id
    head_of = np.empty(len(order), np.int64)
    head_of[order] = np.repeat(order[heads], np.diff(np.append(heads, len(order))))
    # Windows of different contexts around one anchor, at one offset, may be equal.
    firsts = order[heads]
    edges = _group_edges(anchor[firsts])
    many = firsts[np.repeat(np.diff(edges) > 1, np.diff(edges))]
    base = np.cumsum(n_windows) - n_windows
    hit = np.zeros(int(n_windows.sum()), bool)
    suffixes = SuffixOrder(raw, hashes, width)

    def settle(owner: np.ndarray, offset: np.ndarray) -> None:
        """Mark the windows that also start in a document of smaller id."""
        ahead = lead[owner] - offset
        group = np.unique(anchor[owner], return_inverse=True)[1] * 256 + ahead
        # Around one anchor most suffixes differ in their first bytes or next to
        # the anchor: dealt by those, few are left to compare by hashes.
        n = min(8, width)
        beside = np.minimum(np.where(ahead <= n, ahead + gram, n), width - n)
        begin = start[owner] + offset
        keys = group, _words(raw, begin, n), _words(raw, begin + beside, n)
        by = np.lexsort(keys[::-1])
        offset, owner = offset[by], owner[by]
        fresh = np.zeros(len(by), bool)
        fresh[1:] = np.logical_or.reduce([k[by[1:]] != k[by[:-1]] for k in keys])
        group = np.cumsum(fresh)
        place, equal = suffixes.verified(start[owner] + offset, group)
        hit[base[owner] + offset] = _least_ids(place, equal, least[owner]) < least[owner]

    edges = _group_edges(anchor[many])
    load = np.add.reduceat(n_windows[many], edges[:-1]) if len(many) else np.zeros(0, np.int64)
    batch = np.cumsum(load) // sort_windows
    for lot in _batches(batch):
        part = many[edges[lot[0]]:edges[lot[-1] + 1]]
        if load[lot].sum() <= 2 * sort_windows:
            settle(np.repeat(part, n_windows[part]), _spread(np.zeros(len(part), np.int64), n_windows[part]))
            continue
        for ahead in range(width):  # many contexts: windows of one offset at a time
            chosen = part[(lead[part] >= ahead) & (lead[part] - ahead < n_windows[part])]
            if len(chosen):
                settle(chosen, lead[chosen] - ahead)
    return head_of, hit


def _use_ranges(head_of: np.ndarray, hit: np.ndarray, length: np.ndarray, least: np.ndarray, width: int,
                context: np.ndarray, later: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The removed ranges of the uses of contexts: the use, begin and end of each.

    A context's windows are hit when its head's are, or when its chunk's least
    id is above the head's; a use that is not of its chunk's least id is hit
    throughout."""
    n_windows = length - width + 1
    base = np.cumsum(n_windows) - n_windows
    whole = later | (least[context] > least[head_of[context]])
    some = np.flatnonzero(~whole)
    some = some[np.add.reduceat(hit, base)[head_of[context[some]]] > 0] if len(hit) else some[:0]
    n = n_windows[context[some]]
    inner = _spread(np.zeros(len(some), np.int64), n)
    user = np.repeat(some, n)
    flag = hit[base[head_of[context[user]]] + inner]
    opens = flag.copy()
    opens[1:] &= ~(flag[:-1] & (user[1:] == user[:-1]))
    closes = flag.copy()
    closes[:-1] &= ~(flag[1:] & (user[1:] == user[:-1]))
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    full = np.flatnonzero(whole)
    return (np.concatenate([full, user[a]]), np.concatenate([places[full], places[user[a]] + inner[a]]),
            np.concatenate([places[full] + length[context[full]], places[user[a]] + inner[b] + width]))


def _resolve_bucket(width: int, gram: int, sort_windows: int = SORT_WINDOWS, lot_bytes: int = LOT_BYTES):
    def resolve(table: pa.Table) -> pa.Table:
        raw, length, lead, least, uses, docs, places, later, use_ends = _contexts(table)
        start = np.cumsum(length) - length
        context = np.repeat(np.arange(len(length)), uses)
        rows = table.num_rows
        use_row = np.repeat(np.arange(rows), np.diff(use_ends, prepend=0))
        n_lots = -(-len(raw) // lot_bytes)
        lots = _anchor_lots(raw, start + lead, gram, n_lots) if n_lots > 1 else np.zeros(len(length), np.int64)
        found = [np.zeros((3, 0), np.int64)]
        for lot in range(n_lots):
            mine = np.flatnonzero(lots == lot)
            if not len(mine):
                continue
            inside = np.flatnonzero(lots[context] == lot)
            part = raw if n_lots == 1 else raw[_spread(start[mine], length[mine])]
            head_of, hit = _hit_windows(part, length[mine], lead[mine], least[mine], width, gram, sort_windows)
            used, begin, end = _use_ranges(head_of, hit, length[mine], least[mine], width,
                                           np.searchsorted(mine, context[inside]), later[inside], places[inside])
            found.append(np.stack([inside[used], begin, end]))
        owner, begin, end = np.concatenate(found, axis=1)
        by = np.lexsort((begin, docs[owner], use_row[owner]))
        owner, begin, end = owner[by], begin[by], end[by]
        triples = np.stack([docs[owner], begin, end], 1).astype("<u4")
        cuts = np.searchsorted(use_row[owner], np.arange(rows + 1), "left")
        return pa.table({"chunk": table.column("chunk"),
                         "ranges": pa.array([triples[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:])], pa.binary())})
    return resolve


_RESULT = ("doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def _cut(keep_text: bool):
    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _Chunk(left)
        n = len(chunk.ids)
        ranges = np.frombuffer(b"".join(b for b in right.column("ranges").to_pylist() if b), "<u4").reshape(-1, 3).astype(np.int64)
        depth = np.zeros(len(chunk.raw) + 1, np.int32)
        np.add.at(depth, chunk.offsets[ranges[:, 0]] + ranges[:, 1], 1)
        np.add.at(depth, chunk.offsets[ranges[:, 0]] + ranges[:, 2], -1)
        gone = np.cumsum(depth[:-1]) > 0
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        inner = chunk.offsets[:-1][chunk.offsets[:-1] < len(gone)]
        starts[inner] = gone[inner]
        total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[chunk.offsets])
        removed = total(gone)
        size = np.diff(chunk.offsets)
        kept = chunk.raw[~gone].tobytes()
        edges = np.concatenate([[0], np.cumsum(size - removed)]).tolist()
        texts = [kept[a:b] for a, b in zip(edges[:-1], edges[1:])]
        out = {"doc_id": chunk.doc_id, "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
               "n_spans": pa.array(total(starts), pa.int64()),
               "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())}
        if keep_text:
            out["kept"] = pa.array(texts, pa.binary())
        assert n == len(texts)
        return pa.table(out)
    return cut


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES,
                   bucket_bytes: int = BUCKET_BYTES, hot_chunks: int | None = None, hot_bytes: int = HOT_BYTES,
                   sort_windows: int = SORT_WINDOWS, keep_text: bool = False, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    ``keep_text`` adds the remaining bytes as ``kept`` (a cut may fall inside
    a character). ``width`` may be up to 128 bytes. ``hot_chunks`` also deals out
    the windows of an anchor with a key that more chunks have.
    """
    if not gram <= width <= 128:
        raise ValueError("width must lie between gram and 128")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n_chunks, n_buckets = max(1, -(-total // chunk_bytes)), max(1, -(-total // bucket_bytes))
    key = F.xxhash64("doc_id", "text")
    chunked = texts.select("doc_id", "text", key.alias("row_key"), F.pmod(key, F.lit(n_chunks)).alias("chunk")).mapInArrow(
        _pack, "doc_id bigint, size bigint, packed binary, row_key bigint, chunk bigint")
    # Every pass reads this one shuffle: the exchanges are the same and are reused.
    # Fewer partitions than the session's would be dealt again for the cogroups.
    n_parts = max(min(n_chunks, 20_000), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunks = chunked.repartition(int(n_parts), "chunk")
    anchors = chunks.groupBy("chunk").applyInArrow(
        _emit_anchors(n_buckets, width, gram), "bucket bigint, chunk bigint, anchors binary, loads binary")
    shared = anchors.groupBy("bucket").applyInArrow(
        _mark_shared(hot_chunks, hot_bytes // (2 * width - gram)), "chunk bigint, bucket bigint, shared binary, hot binary")
    requests = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(
        _emit_contexts(n_buckets, width, gram), _REQUEST)
    ranges = requests.groupBy("bucket").applyInArrow(_resolve_bucket(width, gram, sort_windows, lot_bytes), "chunk bigint, ranges binary")
    return chunks.groupBy("chunk").cogroup(ranges.groupBy("chunk")).applyInArrow(
        _cut(keep_text), _RESULT + (", kept binary" if keep_text else ""))
