"""Exact repeated-substring removal by a common-prefix-aware distributed merge sort of suffixes.

Sparse suffixes. In every 50-byte string the 8-gram of smallest hash (the leftmost of equal ones) is its anchor. Equal
strings have their anchors at the same place, so comparing the suffixes that begin at anchors, with the bytes before
them, finds every repeat; about one position in 22 is an anchor. A record is an anchor with as many bytes after and
before it as the strings that it anchors cover.

Runs. Tasks read documents in chunks and sort each chunk's records; equal records become one with a list of places.
A run is cut into ranges by the record's first 8-gram, front-coded (common prefix with the predecessor, then the rest)
and compressed: this is all that is exchanged. A chunk is cut into `FAN` pieces at most, as short pieces share no
prefixes. Where the input needs more ranges, runs of one coarse range meet in groups of about a chunk, are merged into
one sorted run and cut into `FAN` finer ranges, and so on: pieces stay as long, and what is exchanged grows by one round
for every factor of `FAN`.

Merge. For each range one task decodes its runs and drops the records neither of whose halves any other record shares
(no string through them can repeat). A loser tree merges the rest: players carry the length of their common prefix with
the last winner, unequal lengths decide without a look at the bytes, equal ones compare from there on, so a known prefix
is never read again. Common prefixes of the sorted suffixes, and of the sorted bytes before them, split records
into classes of equal strings for every offset of the string's start; a string in a document beyond its class's smallest
one is removed. Removed runs go back to the documents' buckets, by hash of the id.

Memory is bounded by chunk, range and bucket, whose number grows with the bytes of the input.

Defined results: null and empty texts have no bytes; texts under 50 bytes lose none; equal strings within one document
stay; rows that share an id are one document for the comparison and are told apart by a 64-bit digest of their text, which
only such rows carry (and those whose id falls into the same slot of a bitmap); a null id comes last; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN, GRAM = 50, 8
LEFT = SPAN - GRAM  # bytes before an anchor at most
#: Bytes of a chunk, records of a run, bytes of text to a range and to a bucket, positions hashed at once.
CHUNK, RUN, RANGE, BLOCK = 8_000_000, 400_000, 4_000_000, 1 << 20
#: Ranges that a run is cut into at most.
FAN = 512
#: Slots that ids are hashed to, one bit each: whether rows share an id of the slot (a power of two).
SLOTS = 1 << 22
_LAST = 2**63 - 1
_U = np.uint64
_COEF = np.random.default_rng(5).integers(0, 2**63, SPAN + LEFT, dtype=np.uint64) * _U(2) + _U(1)


def _scatter(x: np.ndarray) -> np.ndarray:
    x = x * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def find_anchors(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of data's documents: (anchor, first start, last start) of the strings that it anchors."""
    last = ends - SPAN
    ok = last >= starts
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, starts[ok], 1)
    np.add.at(edge, last[ok] + 1, -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    padded = data + bytes(SPAN + GRAM)
    out = []
    for lo in range(0, len(data), BLOCK):
        hi = min(lo + BLOCK, len(data))
        here = np.flatnonzero(valid[lo:hi])
        if not len(here):
            continue
        n = hi - lo + LEFT
        grams = np.ndarray(n, "<u8", padded, lo, (1,))
        key = (_scatter(grams) & ~_U(0xFFFFFF)) | np.arange(n, dtype=_U)
        width = 1
        while 2 * width <= LEFT + 1:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        rest = LEFT + 1 - width
        least = np.minimum(key[: hi - lo], key[rest : rest + hi - lo])
        anchor = (least & _U(0xFFFFFF)).astype(np.int64)[here]
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(here) != 1)]))
        out.append((anchor[new] + lo, here[new] + lo, here[np.concatenate([new[1:], [len(here)]]) - 1] + lo))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _planes(a: np.ndarray) -> np.ndarray:
    """Four-byte numbers byte by byte, all low bytes first: high bytes compress to next to nothing."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4).T) if a.dtype == np.dtype("<u4") else a


def _pack(arrays: list[np.ndarray]) -> bytes:
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=6).compress(head + b"".join(_planes(np.ascontiguousarray(a)).tobytes() for a in arrays))


def _unpack(blob: bytes, kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<i8", k, 8), 8 * (k + 1), []
    for kind, size in zip(kinds.split(), sizes.tolist()):
        if kind == "<u4":
            out.append(np.ascontiguousarray(np.frombuffer(raw, "u1", size, at).reshape(4, -1).T).view("<u4").ravel())
        else:
            out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


_RUN = "u1 u1 u1 u1 u1 <u4 <u4 <u4 <i8 <i8"


def widths(ranges: int) -> list[int]:
    """Fine ranges to a range of each round, the last one 1."""
    out = [1]
    while ranges > FAN * out[0]:
        out.insert(0, out[0] * FAN)
    return out


def sorted_runs(data: bytes, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, tags: np.ndarray, ranges: int, width: int = 1) -> Iterator[tuple[int, bytes]]:
    """(range of width fine ranges, front-coded run) of a chunk of documents."""
    anchors, firsts, lasts = find_anchors(data, starts, ends)
    padded = np.frombuffer(bytes(64) + data + bytes(64), np.uint8)
    after = np.lib.stride_tricks.sliding_window_view(padded, SPAN)
    before = np.lib.stride_tricks.sliding_window_view(padded, LEFT)
    for at in range(0, len(anchors), RUN):
        a, first, last = anchors[at : at + RUN], firsts[at : at + RUN], lasts[at : at + RUN]
        lo, ro = (a - first).astype(np.uint8), (last + SPAN - a).astype(np.uint8)
        rows = np.empty((len(a), SPAN + LEFT + 2), np.uint8)
        rows[:, :SPAN] = after[a + 64]
        rows[:, :SPAN][np.arange(SPAN) >= ro[:, None]] = 0
        rows[:, SPAN:-2] = before[a + 64 - LEFT][:, ::-1]
        rows[:, SPAN:-2][np.arange(LEFT) >= lo[:, None]] = 0
        rows[:, -2], rows[:, -1] = lo, ro
        doc = np.searchsorted(starts, a, "right") - 1
        yield from _cut(rows, np.ones(len(a), np.int64), doc, a - starts[doc], ids, tags, ranges, width)


def _cut(rows: np.ndarray, count: np.ndarray, doc: np.ndarray, place: np.ndarray, ids: np.ndarray, tags: np.ndarray, ranges: int, width: int) -> Iterator[tuple[int, bytes]]:
    """Front-coded runs by range of records (rows) that stand at count places each; doc: rows of ids and tags."""
    text = rows.view(f"S{rows.shape[1]}").ravel()
    order = np.argsort(text, kind="stable")
    rows, text = rows[order], text[order]
    begin = (np.cumsum(count) - count)[order]
    member = np.repeat(begin - np.cumsum(count[order]) + count[order], count[order]) + np.arange(count.sum())
    doc, place = doc[member], place[member]
    new = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    members = np.add.reduceat(count[order], new)
    first = np.cumsum(members) - members
    rows = rows[new]
    gram = np.ascontiguousarray(rows[:, :GRAM]).view("<u8").ravel()
    part = ((_scatter(gram + _U(1)) >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64) // width
    by = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(part[by]) != 0, [True]]))
    for a, b in zip(edges, edges[1:]):
        pick = by[a:b]
        r, n = rows[pick], members[pick]
        same = r[1:, :SPAN] == r[:-1, :SPAN]
        lcp = np.concatenate([[0], np.where(same.all(1), SPAN, np.argmin(same, 1))]).astype(np.uint8)
        column = np.arange(SPAN)
        tails = r[:, :SPAN][(column >= lcp[:, None]) & (column < r[:, -1:])]
        lefts = r[:, SPAN:-2][np.arange(LEFT) < r[:, -2:-1]]
        where = np.repeat(first[pick], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        used, table = np.unique(doc[where], return_inverse=True)
        yield int(part[pick[0]]), _pack([lcp, r[:, -2], r[:, -1], tails, lefts, n.astype("<u4"), table.astype("<u4"), place[where].astype("<u4"), np.diff(ids[used], prepend=0), tags[used]])


def merged_runs(blobs: list[bytes], ranges: int, width: int) -> Iterator[tuple[int, bytes]]:
    """Runs of one range as one sorted run, cut into finer ranges."""
    runs = [decode_run(b) for b in blobs]
    cat = {k: np.concatenate([r[k] for r in runs]) for k in runs[0]}
    runs.clear()
    rows = np.concatenate([cat["right"], cat["left"], cat["lo"][:, None].astype(np.uint8), cat["ro"][:, None].astype(np.uint8)], 1)
    order = np.lexsort((cat["tag"], cat["doc"]))
    d, t = cat["doc"][order], cat["tag"][order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    yield from _cut(rows, cat["count"], number, cat["place"], d[new], t[new], ranges, width)


def decode_run(blob: bytes) -> dict[str, np.ndarray]:
    """The records of a front-coded run."""
    lcp, lo, ro, tails, lefts, count, table, place, ids, tags = _unpack(blob, _RUN)
    n = len(lcp)
    row, size = np.arange(n), np.maximum(ro.astype(np.int64) - lcp, 0)
    begin = np.cumsum(size) - size
    right = np.zeros((n, SPAN), np.uint8)
    for j in range(SPAN):
        own = lcp <= j
        given = own & (j < ro)
        value = np.zeros(n, np.uint8)
        value[given] = tails[begin[given] + j - lcp[given]]
        right[:, j] = value[np.maximum.accumulate(np.where(own, row, 0))]
    left = np.zeros((n, LEFT), np.uint8)
    left[np.arange(LEFT) < lo[:, None]] = lefts
    ids = np.cumsum(ids)
    return {"right": right, "left": left, "lo": lo.astype(np.int64), "ro": ro.astype(np.int64), "count": count.astype(np.int64), "doc": ids[table], "tag": tags[table], "place": place.astype(np.int64)}


def _shared(keys: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Which keys occur more than once, or are of a record with several places."""
    _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return (n[at] > 1) | again


def _hash(m: np.ndarray, salt: int) -> np.ndarray:
    h = np.zeros(len(m), _U)
    for j in range(m.shape[1]):
        h += m[:, j] * _COEF[(j + salt) % len(_COEF)]
    return h


def loser_tree(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs (strings, common prefix with the predecessor): the run of each output, and its common prefix with the output before."""
    k = 1
    while k < len(runs):
        k *= 2
    size = [len(r[0]) for r in runs] + [0] * (k - len(runs))
    at = [0] * k
    head = [r[0][0] if r[0] else b"" for r in runs] + [b""] * (k - len(runs))
    known = [0 if n else -1 for n in size]  # common prefix with the last winner; -1: the run is at its end
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes that with the winner."""
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = head[a][x:], head[b][x:]
        if s == t:
            known[b] = SPAN
            return a, b
        apart = int.from_bytes(s) ^ int.from_bytes(t)
        same = x + len(s) - (apart.bit_length() + 7) // 8
        if s < t:
            known[b] = same
            return a, b
        known[a] = same
        return b, a

    winners = list(range(k))
    level = k
    best = winners
    while level > 1:
        level //= 2
        nxt = []
        for i in range(level):
            w, losers[level + i] = play(best[2 * i], best[2 * i + 1])
            nxt.append(w)
        best = nxt
    w = best[0]
    order, prefix = [], []
    for _ in range(sum(size)):
        order.append(w)
        prefix.append(known[w])
        at[w] += 1
        if at[w] < size[w]:
            head[w], known[w] = runs[w][0][at[w]], runs[w][1][at[w]]
        else:
            known[w] = -1
        node = (k + w) // 2
        while node:
            w, losers[node] = play(w, losers[node])
            node //= 2
    return order, prefix


def _prefixes(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before; 0 for the first."""
    same = rows[1:] == rows[:-1]
    return np.concatenate([[0], np.where(same.all(1), rows.shape[1], np.argmin(same, 1))])


def repeats_of_range(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, tag, begin, end) of removed runs found in one range."""
    runs = [decode_run(b) for b in blobs]
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    if not runs:
        return none
    bounds = np.cumsum([0] + [len(r["lo"]) for r in runs])
    cat = {k: np.concatenate([r[k] for r in runs]) for k in runs[0]}
    runs.clear()
    begin = np.cumsum(cat["count"]) - cat["count"]
    again = cat["count"] > 1
    # a string covers an anchor's first 29 bytes, or 22 before and 8 after it
    half = SPAN - LEFT // 2
    early, late = cat["ro"] >= half, cat["lo"] > SPAN - half
    live = np.zeros(len(again), bool)
    for pick, m, salt in ((early, cat["right"][:, :half], 0), (late, np.concatenate([cat["left"][:, : SPAN - half + 1], cat["right"][:, :GRAM]], 1), 40)):
        at = np.flatnonzero(pick)
        live[at] |= _shared(_hash(m[at], salt), again[at])
    kept = np.flatnonzero(live)
    if not len(kept):
        return none
    merged_runs, where = [], []
    for a, b in zip(bounds, bounds[1:]):
        own = kept[np.searchsorted(kept, a) : np.searchsorted(kept, b)]
        if len(own):
            rows = cat["right"][own]
            raw = rows.tobytes()
            merged_runs.append(([raw[i : i + SPAN] for i in range(0, len(raw), SPAN)], _prefixes(rows).tolist()))
            where.append(own)
    order, prefix = loser_tree(merged_runs)
    order = np.array(order)
    sorted_ = np.empty(len(order), np.int64)
    for r, own in enumerate(where):
        sorted_[order == r] = own
    lcp = np.array(prefix)
    rows = np.ascontiguousarray(cat["left"][sorted_])
    by_left = np.argsort(rows.view(f"S{LEFT}").ravel(), kind="stable")
    left_lcp = _prefixes(rows[by_left])
    low, high = SPAN - cat["ro"][sorted_], cat["lo"][sorted_]  # offsets at which the string may begin
    ends = begin + cat["count"]
    smallest = np.minimum.reduceat(cat["doc"], begin)[sorted_]
    largest = np.maximum.reduceat(cat["doc"], begin)[sorted_]
    found_doc, found_tag, found_at = [], [], []
    left_class = np.empty(len(sorted_), np.int64)
    for offset in range(LEFT + 1):
        pick = np.flatnonzero((low <= offset) & (offset <= high))
        if not len(pick):
            continue
        right_class = np.cumsum(lcp < SPAN - offset)
        left_class[by_left] = np.cumsum(left_lcp < offset)
        key = right_class[pick] * (len(sorted_) + 1) + left_class[pick]
        turn = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], np.diff(key[turn]) != 0]))
        first = np.empty(len(pick), np.int64)
        first[turn] = np.repeat(np.minimum.reduceat(smallest[pick][turn], new), np.diff(np.concatenate([new, [len(pick)]])))
        hit = largest[pick] > first
        rec, limit = sorted_[pick[hit]], first[hit]
        n = cat["count"][rec]
        member = np.repeat(ends[rec] - np.cumsum(n), n) + np.arange(n.sum())
        member = member[cat["doc"][member] > np.repeat(limit, n)]
        found_doc.append(cat["doc"][member])
        found_tag.append(cat["tag"][member])
        found_at.append(cat["place"][member] - offset)
    doc, tag, at = np.concatenate(found_doc), np.concatenate(found_tag), np.concatenate(found_at)
    if not len(doc):
        return none
    turn = np.lexsort((at, tag, doc))
    doc, tag, at = doc[turn], tag[turn], at[turn]
    cut = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (np.diff(at) > 1)
    new = np.flatnonzero(np.concatenate([[True], cut]))
    stop = np.concatenate([new[1:], [len(doc)]]) - 1
    return doc[new], tag[new], at[new], at[stop] + SPAN


def _columns(batch: pa.RecordBatch, shared: np.ndarray) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of a batch (id, digest, text): bytes, starts, ends, ids, tags; ordered by id. The tag is the digest where
    the id's slot is marked as shared by rows, else 0."""
    batch = batch.take(pc.sort_indices(batch, [("id", "ascending")]))
    text = pc.fill_null(batch.column("text"), b"").cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], "<i8")[text.offset : text.offset + len(text) + 1]
    data = memoryview(text.buffers()[2] or b"")
    ids = batch.column("id").to_numpy()
    tags = np.where(shared[_bucket(ids, SLOTS)], batch.column("digest").to_numpy(), 0)
    a = 0
    while a < len(text):
        b = max(int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1, a + 1)
        edges = offsets[a : b + 1] - offsets[a]
        yield bytes(data[offsets[a] : offsets[b]]), edges[:-1], edges[1:], ids[a:b], tags[a:b]
        a = b


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return ((_scatter(ids.astype(np.int64).view(_U) + _U(3)) >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _by_bucket(ids: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    b = _bucket(ids, buckets)
    order = np.argsort(b, kind="stable")
    bounds = np.searchsorted(b[order], np.arange(buckets + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        yield int(p), order[bounds[p] : bounds[p + 1]]


def _settle(packs: list[bytes], found: list[bytes]) -> pd.DataFrame:
    """The results of one bucket's documents."""
    parts = [_unpack(b, "<i8 <i8 <i8 <i8") for b in found]
    doc, tag, begin, end = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(4))
    order = np.lexsort((begin, tag, doc))
    doc, tag, begin, end = doc[order], tag[order], begin[order], end[order]
    rows = []
    for pack in packs:
        ids, tags, sizes, data = _unpack(pack, "<i8 <i8 <i8 u1")
        edges = np.concatenate([[0], np.cumsum(sizes)])
        lo, hi = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
        for i in range(len(ids)):
            text = data[edges[i] : edges[i + 1]]
            runs, n = [], len(text)
            if hi[i] > lo[i]:
                mine = np.arange(lo[i], hi[i])[tag[lo[i] : hi[i]] == tags[i]]
                if len(mine):
                    b, e = begin[mine], np.maximum.accumulate(end[mine])
                    new = np.flatnonzero(np.concatenate([[True], b[1:] > e[:-1]]))
                    runs = list(zip(b[new].tolist(), e[np.concatenate([new[1:], [len(b)]]) - 1].tolist()))
            digest, at = hashlib.sha256(), 0
            for b, e in runs:
                digest.update(text[at:b].tobytes())
                at = e
            digest.update(text[at:].tobytes())
            rows.append((int(ids[i]), n, sum(e - b for b, e in runs), len(runs), digest.hexdigest(), [[b, e] for b, e in runs]))
    return pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def shared_slots(read: DataFrame) -> np.ndarray:
    """For every slot, whether more than one row has one of its ids; only slots reach the driver, not ids."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"slot": pa.array(np.unique(_bucket(batch.column("id").to_numpy(), SLOTS)), pa.int32())})

    again = read.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    out = np.zeros(SLOTS, bool)
    out[again.mapInArrow(slots, "slot int").distinct().toArrow()["slot"].to_numpy()] = True
    return out


def find_repeats(docs: DataFrame, text: str = "text", range_bytes: int = RANGE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed: array of [begin, end) in bytes) of every row."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).collect()[0][0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // range_bytes))
    read = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
    )

    marks = spark.sparkContext.broadcast(np.packbits(shared_slots(read)).tobytes())

    def marked() -> np.ndarray:
        return np.unpackbits(np.frombuffer(marks.value, np.uint8)).astype(bool)

    rounds = widths(parts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = marked()
        for batch in batches:
            for chunk in _columns(batch, shared):
                found = list(sorted_runs(*chunk, parts, rounds[0]))
                yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in found], pa.int32()), "run": pa.array([r for _, r in found], pa.binary())})

    def finer(width: int):
        def cut_again(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(list(merged_runs(list(group["run"]), parts, width)), columns=["part", "run"])

        return cut_again

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        doc, tag, begin, end = repeats_of_range(list(group["run"]))
        out = [(p, None, _pack([doc[i], tag[i], begin[i], end[i]])) for p, i in _by_bucket(doc, parts)]
        return pd.DataFrame(out, columns=["part", "docs", "found"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = marked()
        for batch in batches:
            for data, starts, ends, ids, tags in _columns(batch, shared):
                raw = np.frombuffer(data, np.uint8)
                rows = [(p, _pack([ids[i], tags[i], (ends - starts)[i], np.concatenate([raw[starts[j] : ends[j]] for j in i])])) for p, i in _by_bucket(ids, parts)]
                yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in rows], pa.int32()), "docs": pa.array([r for _, r in rows], pa.binary()), "found": pa.nulls(len(rows), pa.binary())})

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        return _settle([b for b in group["docs"] if b is not None], [b for b in group["found"] if b is not None])

    runs = read.mapInArrow(cut, "part int, run binary")
    for coarse, width in zip(rounds, rounds[1:]):
        # groups of a coarse range with about a chunk's records each
        groups = max(int(total or 0) * coarse // parts // CHUNK, 1)
        runs = runs.withColumn("g", F.pmod(F.xxhash64("run"), F.lit(groups))).groupBy("part", "g").applyInPandas(finer(width), "part int, run binary")
    found = runs.groupBy("part").applyInPandas(merge, "part int, docs binary, found binary")
    packs = read.mapInArrow(pack, "part int, docs binary, found binary")
    settled = packs.unionByName(found).groupBy("part").applyInPandas(settle, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<array<long>>")
    return settled.select(F.when(F.col("id") != _LAST, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")
