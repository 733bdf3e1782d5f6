"""Benchmark decontamination by a distributed positional inverted index.

Index. The corpus is read once. Tasks cut it into shards of documents and store each shard's inverted index in shared
storage: for every word of the benchmark its sorted postings, places in the shard's word sequence, where documents are
kept apart by gaps. Which words the benchmark has is told by a bitmap of `SLOTS` bits, the only thing broadcast here.

Search. The benchmark's windows are a stored table, read in blocks of about `BLOCK_WINDOWS`; a block is broadcast, run
against every stored shard, and what it finds is written before the next block is read, so that driver and tasks hold
one block and one shard whatever the size of benchmark and corpus. Every window has a lead, its rarest word by the
counts of the whole benchmark; a shard looks only at the windows whose lead it holds. Of these it takes the postings of
the rarest word in the shard, adjusted by the word's offset, and intersects them with the lists of the next rarest
until none are left or all have agreed: an exact phrase match. Proximity matches need `RAREST` of the window's
`RAREST + SPARE` rarest words, by counts in the benchmark, ties by offset, within `slack` of their places relative to
one of the first `SPARE + 1` of them; so what a document comes near to depends on no other document.

Defined results: null and empty texts have no words and no hits; an item without words has no window; an item shorter
than a window is one window; repeated item rows count once; a null item_id counts as an item, named by the empty
string; repeated documents are judged alike; very long texts are shards of their own; empty tables give empty or unhit
results. Further columns pass through and those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLDED_WORD, LOWER, UPPER, digest, lower_ascii, materialise, once

WINDOW, SLACK, RAREST, SPARE = 10, 3, 4, 2
#: Windows of the benchmark that one pass holds, words of a shard, candidate places that are looked at together.
BLOCK_WINDOWS, SHARD_WORDS, CANDIDATES = 200_000, 500_000, 2_000_000
#: Bits that tell the benchmark's words (a power of two); bytes of results up to which they are broadcast.
SLOTS, BROADCAST_BYTES = 1 << 22, 32_000_000
_LAST = 2**63 - 1
#: UTF-8 bytes: A-Z to a-z; digits, letters and all bytes of wider characters stay, the rest is blank.
_FOLD = bytes(c if chr(c) in "0123456789" + LOWER or c > 0x7F else ord(chr(c).lower()) if chr(c) in UPPER else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def term_of(word: bytes) -> int:
    """The word's 64-bit hash, in bits equal to the built-in xxhash64 of the string."""
    return xxhash.xxh64_intdigest(word, 42)


def signed(word: bytes) -> int:
    return (term_of(word) + 2**63) % 2**64 - 2**63


def _slots(terms: np.ndarray) -> np.ndarray:
    return (terms.view(np.uint64) >> np.uint64(40)).astype(np.int64) % SLOTS


class _Ids(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every (start, count), one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - starts, counts)


class Shard:
    """Positional inverted index of some documents: sorted terms, the edges of their postings, places; doc starts."""

    def __init__(self, terms: np.ndarray, lengths: np.ndarray, places: np.ndarray, counts: np.ndarray, gap: int):
        self.terms, self.lengths, self.places, self.counts = terms, lengths.astype(np.int64), places.astype(np.int64), counts.astype(np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.starts = np.cumsum(self.counts + gap) - self.counts
        self.size = int((self.counts + gap).sum()) + gap
        self._at = None

    @classmethod
    def of_texts(cls, texts: Iterable[str | None], wanted: np.ndarray | None, gap: int) -> Shard:
        """wanted: bits by slot of the terms that the index keeps; all of them where none are given."""
        ids, parts, counts = _Ids(), [], []
        for text in texts:
            words = words_of(text)
            counts.append(len(words))
            parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
        terms = np.fromiter(map(term_of, ids), np.uint64, len(ids)).view(np.int64)
        keep = np.ones(len(terms), bool) if wanted is None else wanted[_slots(terms)]
        known, number = np.unique(terms[keep], return_inverse=True)
        rank = np.full(len(terms) + 1, -1, np.int32)
        rank[:-1][keep] = number
        flat = rank[np.concatenate(parts)] if parts else np.empty(0, np.int32)
        counts = np.array(counts, np.int64)
        held = np.flatnonzero(flat >= 0)
        order = held[np.argsort(flat[held], kind="stable")]
        place = order + gap * (np.repeat(np.arange(len(counts)), counts)[order] + 1)
        return cls(known, np.bincount(flat[held], minlength=len(known)), place, counts, gap)

    def packed(self) -> bytes:
        """Places as differences within a term; big blocks of small numbers compress well."""
        gaps = np.diff(self.places, prepend=0)
        gaps[self.begin] = self.places[self.begin]
        arrays = [self.terms, self.lengths.astype("<u4"), gaps.astype("<u4"), self.counts.astype("<u4")]
        head = np.array([len(a) for a in arrays], "<i8").tobytes()
        return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))

    @classmethod
    def unpacked(cls, blob: bytes, gap: int) -> Shard:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        sizes, at, arrays = np.frombuffer(raw, "<i8", 4), 32, []
        for n, kind in zip(sizes.tolist(), ("<i8", "<u4", "<u4", "<u4")):
            arrays.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        terms, lengths, gaps, counts = arrays
        sums = np.cumsum(gaps, dtype=np.int64)
        begin = np.cumsum(lengths, dtype=np.int64) - lengths
        before = np.concatenate([[0], sums])[begin]
        return cls(terms, lengths, sums - np.repeat(before, lengths), counts, gap)

    def at(self) -> np.ndarray:
        """The term of every place, -1 where none is indexed: whether a list holds a place is one look."""
        if self._at is None:
            self._at = np.full(self.size, -1, np.int32)
            self._at[self.places] = np.repeat(np.arange(len(self.terms), dtype=np.int32), self.lengths)
        return self._at


class Block:
    """Windows of the benchmark: their terms (-1 beyond the end of a short one), items, and offsets rarest first."""

    def __init__(self, rows: Iterable[tuple[str, list[int], list[int]]], window: int = WINDOW):
        owners: dict[tuple[int, ...], set[str]] = {}
        often: dict[int, int] = {}
        for item, terms, counts in rows:
            owners.setdefault(tuple(terms), set()).add(item)
            often.update(zip(terms, counts))
        self.window, listed = window, sorted(owners)
        self.owners = [sorted(owners[w]) for w in listed]
        self.terms = np.array(sorted(often), np.int64)
        size = np.array([len(w) for w in listed], np.int64)
        flat = np.searchsorted(self.terms, np.array([t for w in listed for t in w], np.int64))
        self.windows = np.full((len(listed), window), -1, np.int32)
        inside = np.arange(window) < size[:, None]
        self.windows[inside] = flat
        count = np.array([often[t] for t in self.terms.tolist()], np.int64)
        rare = np.where(inside, count[self.windows] if len(count) else 0, _LAST)
        self.keys = np.argsort(rare, 1, kind="stable")[:, : RAREST + SPARE].astype(np.int8)
        self.keys[np.arange(self.keys.shape[1]) >= size[:, None]] = -1
        self.leads = self._by_term(0)
        # whoever comes near holds one of the first SPARE + 1 keys
        self.anchors = [self._by_term(k, size >= RAREST) for k in range(min(SPARE + 1, self.keys.shape[1]))]

    def _by_term(self, key: int, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Windows by the term at a key's offset: edges by term, windows."""
        given = (self.keys[:, key] >= 0) & (which if which is not None else True)
        rows = np.flatnonzero(given)
        term = self.windows[rows, self.keys[rows, key]]
        order = np.argsort(term, kind="stable")
        return np.searchsorted(term[order], np.arange(len(self.terms) + 1)), rows[order]


def search(shard: Shard, block: Block, slack: int = SLACK) -> Iterator[tuple[int, list[list[int]], list[str], list[str]]]:
    """(document of the shard, [start, end) runs of hit words, items it holds, items it comes near to) where any."""
    place = np.searchsorted(block.terms, shard.terms)
    known = place < len(block.terms)
    known[known] = block.terms[place[known]] == shard.terms[known]
    there = place[known]  # the block's terms in the shard
    local = np.full(len(block.terms) + 1, -1, np.int32)  # the last one: beyond a window's end
    local[there] = np.flatnonzero(known)
    lengths = np.append(shard.lengths, _LAST)
    items: dict[int, set[str]] = {}
    near: dict[int, set[str]] = {}
    hits: list[tuple[np.ndarray, np.ndarray]] = []

    def named(found: dict[int, set[str]], windows: np.ndarray, places: np.ndarray) -> None:
        doc = np.searchsorted(shard.starts, places, "right") - 1
        for w, d in {*zip(windows.tolist(), doc.tolist())}:
            found.setdefault(d, set()).update(block.owners[w])

    def selected(lists: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        edges, windows = lists
        return windows[_spread(edges[there], edges[there + 1] - edges[there])]

    def pieces(counts: np.ndarray) -> Iterator[slice]:
        """Slices of bounded total; a longer one stands alone."""
        ends, a = np.cumsum(counts), 0
        while a < len(counts):
            b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CANDIDATES, "right")), a + 1)
            yield slice(a, b)
            a = b

    # exact phrases: all words are there, from the rarest list on
    live = selected(block.leads)
    own = local[block.windows[live]]
    beyond = block.windows[live] < 0
    keep = ((own >= 0) | beyond).all(1)
    live, own, beyond = live[keep], own[keep], beyond[keep]
    own[beyond] = -1
    ranked = np.argsort(lengths[own], 1, kind="stable")
    first = ranked[:, 0] if len(live) else np.empty(0, np.int64)
    term = own[np.arange(len(live)), first]
    for part in pieces(shard.lengths[term]):
        counts = shard.lengths[term[part]]
        row = np.repeat(np.arange(len(live))[part], counts)
        start = shard.places[_spread(shard.begin[term[part]], counts)] - first[row]
        for r in range(1, block.window):
            if not len(row):
                break
            offset = ranked[row, r]
            wanted = own[row, offset]
            ok = (wanted < 0) | (shard.at()[start + np.where(wanted < 0, 0, offset)] == wanted)
            row, start = row[ok], start[ok]
        if len(row):
            hits.append((start, (~beyond[row]).sum(1)))
            named(items, live[row], start)
    # proximity: enough of the rarest words near their places, seen from one of them
    for k, lists in enumerate(block.anchors):
        live = selected(lists)
        keys = block.keys[live]
        own = np.where(keys >= 0, local[block.windows[live[:, None], keys]], -1)
        keep = (own >= 0).sum(1) >= RAREST
        live, keys, own = live[keep], keys[keep].astype(np.int64), own[keep]
        for part in pieces(shard.lengths[own[:, k]]):
            counts = shard.lengths[own[part, k]]
            row = np.repeat(np.arange(len(live))[part], counts)
            at = shard.places[_spread(shard.begin[own[part, k]], counts)]
            held = np.ones(len(row), np.int64)
            for turn, j in enumerate(x for x in range(keys.shape[1]) if x != k):
                wanted = own[row, j]
                spot = at - keys[row, k] + keys[row, j]
                seen = np.zeros(len(row), bool)
                for e in range(-slack, slack + 1):
                    seen |= shard.at()[np.clip(spot + e, 0, shard.size - 1)] == wanted
                held = held + (seen & (wanted >= 0))
                ok = held + keys.shape[1] - 2 - turn >= RAREST  # what is still to come could do
                row, at, held = row[ok], at[ok], held[ok]
            named(near, live[row], at)
    runs: dict[int, list[list[int]]] = {}
    if hits:
        start, size = (np.concatenate(x) for x in zip(*hits))
        order = np.argsort(start, kind="stable")
        start, end = start[order], np.maximum.accumulate((start + size)[order])
        new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
        doc = np.searchsorted(shard.starts, start[new], "right") - 1
        for d, a, b in zip(doc.tolist(), start[new].tolist(), end[np.concatenate([new[1:], [len(end)]]) - 1].tolist()):
            runs.setdefault(d, []).append([a - int(shard.starts[d]), b - int(shard.starts[d])])
    for d in sorted({*items, *near}):
        yield d, runs.get(d, []), sorted(items.get(d, ())), sorted(near.get(d, ()))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, terms, counts): the windows of every item as hashed words, with the words' counts in the distinct texts."""
    read = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    pattern = FOLDED_WORD.replace("\\", "\\\\")
    texts = once(read.select("text").distinct().withColumn("low", lower_ascii(F.col("text"))), "w", f"transform(regexp_extract_all(low, '{pattern}', 0), x -> xxhash64(x))")
    spots = texts.select("text", F.posexplode("w").alias("pos", "term"))
    counted = spots.join(spots.groupBy("term").agg(F.count("*").alias("n")), "term")
    lists = counted.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("pos", "term", "n"))).alias("s"))
    begins = F.explode(F.sequence(F.lit(1), F.greatest(F.size("s") - window + 1, F.lit(1))))
    cut = read.join(lists, "text").select("item", "s", begins.alias("i")).select("item", F.slice("s", F.col("i"), window).alias("s"))
    return cut.select("item", F.col("s.term").alias("terms"), F.col("s.n").alias("counts")).distinct()


def wanted_slots(windows: DataFrame) -> np.ndarray:
    """Bits by slot of the benchmark's words; slots, of bounded number, reach the driver."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column("terms").flatten().to_numpy()
            yield pa.RecordBatch.from_pydict({"slot": pa.array(np.unique(_slots(terms)), pa.int32())})

    out = np.zeros(SLOTS, bool)
    out[windows.select("terms").mapInArrow(slots, "slot int").distinct().toArrow()["slot"].to_numpy()] = True
    return out


def _batches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of a batch with about SHARD_WORDS words each; a longer document is a slice of its own."""
    begin, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if held and held + n // 6 > SHARD_WORDS:
            yield begin, i
            begin, held = i, 0
        held += n // 6
    if len(texts) > begin:
        yield begin, len(texts)


def build_index(read: DataFrame, wanted: np.ndarray, gap: int) -> DataFrame:
    """(ids, digests, postings) of shards of documents (id, digest, text)."""
    bits = read.sparkSession.sparkContext.broadcast(np.packbits(wanted).tobytes())

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool)
        for batch in batches:
            ids, digests, texts = (batch.column(c) for c in ("id", "digest", "text"))
            for a, b in _batches(texts):
                shard = Shard.of_texts(texts[a:b].to_pylist(), mask, gap)
                yield pa.RecordBatch.from_pydict({
                    "ids": pa.array([ids[a:b].to_numpy()], pa.list_(pa.int64())),
                    "digests": pa.array([digests[a:b].to_numpy()], pa.list_(pa.int64())),
                    "postings": pa.array([shard.packed()], pa.binary()),
                })

    return read.mapInArrow(shards, "ids array<long>, digests array<long>, postings binary")


_FOUND = "id long, digest long, runs array<array<long>>, items array<string>, near array<string>"


def search_index(index: DataFrame, block: Block, gap: int, slack: int = SLACK) -> DataFrame:
    """What one block of windows finds in the stored shards."""
    shared = index.sparkSession.sparkContext.broadcast(block.__dict__)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Block.__new__(Block)
        own.__dict__.update(shared.value)
        for batch in batches:
            for ids, digests, postings in zip(batch.column("ids"), batch.column("digests"), batch.column("postings")):
                ids, digests = ids.values.to_numpy(), digests.values.to_numpy()
                rows = [(int(ids[d]), int(digests[d]), runs, items, near) for d, runs, items, near in search(Shard.unpacked(postings.as_py(), gap), own, slack)]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()), pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "digest", "runs", "items", "near"])

    return index.mapInArrow(found, _FOUND)


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))


def find_overlap(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = SLACK, text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with n_words, hit_runs ([start, end) in words), items and near_items (sorted ids)."""
    results = {"n_words", "hit_runs", "items", "near_items"}
    passing = [c for c in docs.columns if c not in results]
    gap = window + slack
    windows = materialise(benchmark_windows(benchmark, window), "windows")
    n_blocks = max(-(-windows.count() // block_windows), 1)
    read = docs.select(_id().alias("id"), digest(text).alias("digest"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    index = materialise(build_index(read, wanted_slots(windows), gap), "postings")
    parts = []
    for i in range(n_blocks):
        rows = windows.filter(F.pmod(F.xxhash64("terms", F.lit(7)), F.lit(n_blocks)) == i).toArrow()
        block = Block(zip(*(rows[c].to_pylist() for c in ("item", "terms", "counts"))), window)
        parts.append(materialise(search_index(index, block, gap, slack), "found"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # rows that share id and text are judged alike; several blocks may have hit a document
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    hits = every.groupBy(F.col("id").alias("__d_id"), F.col("digest").alias("__d_digest")).agg(merged("runs").alias("__d_runs"), merged("items").alias("items"), merged("near").alias("near_items"))
    bytes_ = every.agg(F.sum(F.lit(64) + 48 * F.size("runs") + 24 * (F.size("items") + F.size("near")))).collect()[0][0] or 0
    keyed = docs.select(*[F.col(f"`{c}`") for c in passing], _id().alias("__d_id"), digest(text).alias("__d_digest"))
    joined = keyed.join(F.broadcast(hits) if bytes_ <= BROADCAST_BYTES else hits, ["__d_id", "__d_digest"], "left")
    none = lambda kind: F.expr(f"cast(array() as {kind})")
    return joined.select(
        *[F.col(f"`{c}`") for c in passing],
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(FOLDED_WORD)), F.lit(0)).cast("long").alias("n_words"),
        F.coalesce("__d_runs", none("array<array<long>>")).alias("hit_runs"),
        F.coalesce("items", none("array<string>")).alias("items"),
        F.coalesce("near_items", none("array<string>")).alias("near_items"),
    )


def hit_words(runs: str = "hit_runs"):
    """Words under any of the sorted runs, overlaps counted once."""
    return F.expr(
        f"aggregate({runs}, named_struct('n', 0L, 'upto', 0L), (a, r) -> named_struct('n', a.n + greatest(0L, r[1] - greatest(a.upto, r[0])), 'upto', greatest(a.upto, r[1])), a -> a.n)"
    )
