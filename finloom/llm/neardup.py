"""MinHash near-duplicate classes by ProbMinHash, banding and exact verification.

A text is the set of its five-word shingles (blank-separated words, lower-cased; shorter texts are one shingle). Every
shingle is a Poisson process of arrivals with its weight as rate, each arrival at a random one of m registers; a
register keeps the shingle that arrives first. Two texts agree in a register with the probability Jaccard similarity of
their weighted shingles. All weights are equal here, so candidates are sought by the very measure that links are
verified by, however often a shingle repeats. Arrivals later than the latest first arrival of all registers change
nothing, so a shingle is done as soon as its next arrival is that late (early termination); long texts need little more
than one arrival a shingle.

Identical texts are one node. Registers are banded, and nodes that share a band are candidates. Links are verified on
the texts themselves: Jaccard similarity of their shingles of at least 0.8. Within a band's bucket no pairs are spread
out: (1) each node is verified against the smallest of its buckets' first nodes; (2) against the first nodes of those
buckets which lie in another component; (3) the members outside a bucket's largest component against the members of
other components, in tiles of bounded size where a bucket is large. What (3) leaves out lies in one component already,
so no link between components is lost.

Defined results: a null text counts as empty; identical texts, empty ones too, are one class; texts without words have
no further links; rows that share an id are told apart by their texts; a class is named by its smallest doc_id, null
ids last; an empty table gives an empty table. Extra columns are ignored by `classes` and pass through `keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: Words of a shingle, similarity, and bands x rows: a pair at 0.8 shares no band with a probability of 1e-6.
SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 36, 5
#: Rows of a key from which it is hot, and hot keys at most.
HUB, HUBS = 256, 100_000
#: Bytes of text that are sketched at once; pairs of a bucket that are listed, and texts on a side of a tile beyond.
CHUNK_BYTES, FEW, TILE = 1_000_000, 16, 256
_LAST = 2**63 - 1
_U = np.uint64


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


_BYTE, _STEP, _PART = _odd(1, 256), _odd(2, SHINGLE), _odd(3, 64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64 bits (a finalizer of shifts and odd multipliers)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_known_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    if n not in _known_powers:
        base = 0x9E3779B97F4A7C15
        _known_powers.clear()
        with np.errstate(over="ignore"):
            _known_powers[n] = tuple(np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n, _U(b), _U)])) for b in (base, pow(base, -1, 2**64)))
    return _known_powers[n]


def shingle_hashes(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts: text index, 64-bit hash, count; sorted by index and hash."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[buf]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    stops = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    size = 1 << int(len(buf)).bit_length()
    up, down = _powers(size)
    sums = np.concatenate([[_U(0)], np.cumsum(_BYTE[buf] * up[: len(buf)], dtype=_U)])
    words = mix((sums[stops] - sums[starts]) * down[starts])
    doc = np.searchsorted(ends, starts, "right")
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, _U), np.empty(0, np.int64)
    at = np.arange(n)
    first = np.searchsorted(doc, doc, "left")
    held = np.bincount(doc, minlength=len(texts))[doc]
    begin = (at - first == 0) | (at - first <= held - k)
    padded = np.concatenate([words, np.zeros(k, _U)])
    last = first + held  # words of the next text do not count
    total = np.zeros(n, _U)
    for j in range(k):
        total += np.where(at + j < last, padded[j : j + n], _U(0)) * _STEP[j]
    d, s = doc[begin], mix(total[begin])
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1])]))
    return d[new], s[new], np.diff(np.concatenate([new, [len(d)]]))


def prob_minhash(doc: np.ndarray, shingles: np.ndarray, weights: np.ndarray, texts: int, m: int) -> np.ndarray:
    """texts x m registers, each the shingle that arrives first (0: none, for texts without shingles)."""
    first = np.full(texts * m, np.inf)
    holder = np.zeros(texts * m, _U)
    time = np.zeros(len(shingles))
    state, rate, row = shingles, weights, doc
    turn = 0
    while len(state):
        turn += 1
        draw = mix(state + _U(turn * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log((draw >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / rate
        register = row * m + ((mix(draw) >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        np.minimum.at(first, register, time)
        won = first[register] == time
        holder[register[won]] = state[won]
        late = first.reshape(texts, m).max(1)
        on = time < late[row]
        state, rate, row, time = state[on], rate[on], row[on], time[on]
    return holder.reshape(texts, m)


def sketch(texts: list[str | None], bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x bands, int64) and the number of distinct shingles of each text."""
    out, sizes = np.zeros((len(texts), bands), np.int64), np.zeros(len(texts), np.int64)
    salt = mix(np.arange(1, bands + 1, dtype=_U))
    for at, raw in _chunks(texts):
        end = at + len(raw)
        doc, hashes, _ = shingle_hashes(raw)
        keys = prob_minhash(doc, hashes, np.ones(len(hashes)), end - at, bands * rows).reshape(end - at, bands, rows)
        out[at:end] = mix((keys * _STEP[:rows]).sum(2, dtype=_U) + salt).view(np.int64)
        sizes[at:end] = np.bincount(doc, minlength=end - at)
    return out, sizes


def shingles(text: str, k: int = SHINGLE) -> frozenset:
    """The shingles themselves; verification trusts no hash."""
    words = text.lower().encode().split()
    return frozenset(zip(*[words[i:] for i in range(k)])) if len(words) >= k else frozenset([tuple(words)] if words else [])


def similarity(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / max(1, len(a) + len(b) - both)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Lower-cased texts in pieces of about CHUNK_BYTES, each with its place."""
    at = 0
    while at < len(texts):
        end, held, raw = at, 0, []
        while end < len(texts) and held < CHUNK_BYTES:
            raw.append((texts[end] or "").lower().encode())
            held += len(raw[-1])
            end += 1
        yield at, raw
        at = end


def spanning_links(rows: pd.DataFrame) -> list[tuple[bytes, bytes]]:
    """Links of a tile (node, l, outside, text) between components, as many as it takes to connect them.

    Every text becomes a bit set over the shingle hashes that another text of the tile has too, so a pair costs one AND
    and one bit count; a pair that passes is verified on the shingles themselves.
    """
    texts = rows.drop_duplicates("node")
    place = {n: i for i, n in enumerate(texts["node"])}
    text = list(texts["text"])
    found = [(doc + at, s) for at, raw in _chunks(text) for doc, s, _ in [shingle_hashes(raw)]]
    doc, s = (np.concatenate(x) for x in zip(*found))
    sizes = np.bincount(doc, minlength=len(text)).tolist()
    _, ids, n = np.unique(s, return_inverse=True, return_counts=True)
    common = n > 1
    number = np.cumsum(common) - 1
    edges = np.searchsorted(doc, np.arange(len(text) + 1))
    bits = []
    for i in range(len(text)):
        own = ids[edges[i] : edges[i + 1]]
        flags = np.zeros(int(common.sum()), np.uint8)
        flags[number[own[common[own]]]] = 1
        bits.append(int.from_bytes(np.packbits(flags).tobytes()))
    root: dict[bytes, bytes] = {l: l for l in rows["l"]}

    def find(l: bytes) -> bytes:
        while root[l] != l:
            root[l] = l = root[root[l]]
        return l

    out = []
    sides = [(n, l, o, place[n]) for n, l, o in zip(rows["node"], rows["l"], rows["outside"])]
    members = [(n, l, bits[i], sizes[i], i) for n, l, o, i in sides if not o]
    for a, la, o, i in sides:
        if not o:
            continue
        top, own, n = find(la), bits[i], sizes[i]
        for b, lb, other, m, j in members:
            if la != lb and n >= THRESHOLD * m and m >= THRESHOLD * n:
                both = (own & other).bit_count()
                if both >= THRESHOLD * (n + m - both) and find(lb) != top and similarity(shingles(text[i]), shingles(text[j])) >= THRESHOLD:
                    root[find(lb)] = top
                    out.append((min(a, b), max(a, b)))
    return out


_SKETCH = T.StructType([T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


@F.pandas_udf(_SKETCH)
def _sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        distinct = texts.drop_duplicates()
        bands, sizes = sketch(list(distinct))
        place = {t: i for i, t in enumerate(distinct)}
        rows = [place[t] for t in texts]
        yield pd.DataFrame({"n": sizes[rows], "bands": [bands[i] if sizes[i] else np.empty(0, np.int64) for i in rows]})


@F.pandas_udf(T.BooleanType())
def _similar(left: pd.Series, right: pd.Series) -> pd.Series:
    known: dict[str, frozenset] = {}

    def bag(text: str) -> frozenset:
        if text not in known:
            if len(known) > 16:
                known.clear()
            known[text] = shingles(text)
        return known[text]

    return pd.Series([similarity(bag(a), bag(b)) >= THRESHOLD for a, b in zip(left, right)], dtype=bool)


def _node(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))


def _hot(df: DataFrame, key: str) -> DataFrame:
    """(hot): the keys of very many rows of a written table. There are at most HUBS of them, as each has a share of
    1 / HUBS of the rows at least, so they may be broadcast at any size."""
    least = max(HUB, df.count() // HUBS)
    return materialise(df.groupBy(F.col(key).alias("hot")).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("hot"), "hot")


def spread_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """many joined with one, a row a key: rows of hot keys go to as many tasks as there are partitions, by hash of a
    column, and the other side's rows of these keys are copied to all of them."""
    n = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.broadcast(hot.withColumnRenamed("hot", key).withColumn("__hot", F.lit(True)))
    left = many.join(is_hot, key, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(n))).otherwise(0).cast("int")).drop("__hot")
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))
    right = one.join(is_hot, key, "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    return left.join(right, [key, "__salt"], how).drop("__salt")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (a, b): the smallest node that it is connected with.

    Each round takes the smallest label around and then that label's own label; labels are written to shared storage
    after each round. Nodes with very many links, and labels of very many nodes, are spread over all tasks.
    """
    edges = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    hubs = _hot(edges, "b")
    labels = materialise(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        around = spread_join(edges, labels.withColumnRenamed("node", "b"), "b", hubs, "a").groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around, labels["node"] == around["a"]).select("node", F.least("label", "near").alias("step"), F.col("label").alias("old"))
        onward = labels.select(F.col("node").alias("step"), F.col("label").alias("jump"))
        further = spread_join(nearer, onward, "step", hubs, "node", "left")  # whatever many nodes are labelled by has many links
        fresh = materialise(further.select("node", F.least("step", F.coalesce("jump", "step")).alias("label"), "old"), "labels")
        if fresh.filter("label <> old").isEmpty():
            return fresh.select("node", "label")
        labels = fresh.select("node", "label")


def _relabel(of: DataFrame, merged: DataFrame) -> DataFrame:
    """Labels (node, label) after their labels were merged further."""
    more = merged.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = spread_join(of, more, "label", _hot(of, "label"), "node", "left").select("node", F.coalesce("to", "label").alias("label"))
    new = merged.join(of.select("node"), "node", "left_anti").select("node", "label")
    return materialise(old.unionByName(new), "labels")


def node_classes(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows of documents: id, node), (classes of nodes: node, rep_id, rep_node); reps are the smallest of their class."""
    read = docs.select(_id().alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("node", _node("text"))
    rows = materialise(read.withColumn("s", _sketch("text")).select("id", "node", "s.bands"), "sketch")
    nodes = rows.groupBy("node").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    members = materialise(nodes.select("node", "id", F.explode("bands").alias("key")), "bands")
    buckets = members.groupBy("key").agg(F.min("node").alias("rep"), F.max("node").alias("other")).filter("rep <> other").select("key", "rep")
    candidates = materialise(members.join(buckets, "key").filter("node <> rep").select("node", "id", "key", "rep"), "candidates")
    wanted = candidates.select("node", "id").distinct()
    firsts = candidates.select(F.col("rep").alias("node")).distinct().join(nodes.select("node", "id"), "node").select("node", "id")
    texts = materialise(read.join(wanted.unionByName(firsts).distinct(), ["id", "node"], "left_semi").select("node", "text"), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        both = spread_join(pairs, left, "a", _hot(pairs, "a"), "b")
        return materialise(spread_join(both, right, "b", _hot(pairs, "b"), "a").filter(_similar("ta", "tb")).select("a", "b"), "links")

    # 1. every node against the smallest of its buckets' first nodes
    star = candidates.groupBy("node").agg(F.min("rep").alias("rep")).select(F.col("node").alias("a"), F.col("rep").alias("b"))
    star = materialise(star, "pairs")
    labels = components(verified(star))

    def label(side: str) -> DataFrame:
        return labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))

    def merge_links(links: DataFrame) -> DataFrame:
        if links.isEmpty():
            return labels
        half = spread_join(links, label("a"), "a", _hot(links, "a"), "b", "left")
        between = spread_join(half, label("b"), "b", _hot(links, "b"), "a", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        return _relabel(labels, components(between))

    # 2. against the first nodes in other components
    others = candidates.select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    apart = others.join(label("a"), "a", "left").join(label("b"), "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b"))
    labels = merge_links(verified(materialise(apart.select("a", "b"), "pairs")))
    # 3. members outside a bucket's largest component against those of other components
    crowd = members.join(buckets.select("key"), "key", "left_semi").select("key", F.col("node").alias("a")).join(label("a"), "a", "left").select("key", F.col("a").alias("node"), F.coalesce("la", "a").alias("l"))
    crowd = materialise(crowd, "crowd")
    sizes = crowd.groupBy("key", "l").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "l")).alias("m"), F.sum("n").alias("all")).filter("m.n < all").select("key", F.col("m.l").alias("main"), "all", (F.col("all") - F.col("m.n")).alias("out"))
    split = materialise(crowd.join(main, "key").withColumn("outside", F.col("l") != F.col("main")), "split")
    few = split.filter(F.col("all") * F.col("out") <= FEW)
    outside = few.filter("outside").select("key", F.col("node").alias("b"), F.col("l").alias("lb"))
    pairs = few.join(outside, "key").filter("l <> lb").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    done = others.unionByName(star).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = verified(materialise(pairs.join(done, ["a", "b"], "left_anti"), "pairs"))
    # large buckets: tiles of bounded size, each text once in a tile
    many = split.filter(F.col("all") * F.col("out") > FEW).withColumns({"wide": F.ceil(F.col("all") / TILE).cast("int"), "high": F.ceil(F.col("out") / TILE).cast("int")})
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    rows_of = many.filter("outside").select("key", "node", "l", "outside", spot("high").alias("i"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"))
    columns_of = many.select("key", "node", "l", F.lit(False).alias("outside"), F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("i"), spot("wide").alias("j"))

    def tile(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(spanning_links(group), columns=["a", "b"])

    tiles = rows_of.unionByName(columns_of).join(texts, "node").groupBy("key", "i", "j").applyInPandas(tile, "a binary, b binary")
    labels = merge_links(materialise(links.unionByName(tiles.distinct()), "links"))

    linked = materialise(labels.join(nodes.select("node", "id"), "node"), "linked")
    named = linked.groupBy("label").agg(F.min(F.struct("id", "node")).alias("rep"))
    linked = spread_join(linked, named, "label", _hot(linked, "label"), "node").select("node", F.col("rep.id").alias("rep_id"), F.col("rep.node").alias("rep_node"))
    alone = nodes.select("node", "id").join(linked.select("node"), "node", "left_anti").select("node", F.col("id").alias("rep_id"), F.col("node").alias("rep_node"))
    return rows.select("id", "node"), materialise(linked.unionByName(alone), "classes")


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, class_id) for every row of docs: the smallest doc_id of its class of near duplicates."""
    rows, found = node_classes(docs, text)
    none = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return spread_join(rows, found, "node", _hot(rows, "node"), "id").select(none("id").alias("doc_id"), none("rep_id").alias("class_id"))


def keep_first(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of docs for each class: that of the smallest doc_id."""
    _, found = node_classes(docs, text)
    reps = found.select(F.col("rep_id").alias("__n_id"), F.col("rep_node").alias("__n_node")).distinct()
    keyed = docs.withColumns({"__n_id": _id(), "__n_node": _node(text)})
    return keyed.join(reps, ["__n_id", "__n_node"], "left_semi").dropDuplicates(["__n_id", "__n_node"]).drop("__n_id", "__n_node")
