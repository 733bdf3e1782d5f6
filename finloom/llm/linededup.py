"""Line dedup (native: DataFrame and SQL functions only).

A line's key is the line without blanks at both ends, A-Z lower-cased; keys shorter than `min_chars` code points stay.
Every line hash is salted with a slice number of its document, and the salted hashes are range-partitioned, in ranges of
equal width as hashes are even: so no sample of the lines is read to find bounds, and a line that a third of all
documents hold spreads over as many ranges as there are slices, whose number grows with that of the partitions. Within
a range rows are sorted by hash, document and position and one pass streams the first document of each hash; only these
first rows (at most one document a slice) meet once more to find the first of all slices. What comes back to the
documents is no text but a bitmap of the lines to drop: 64 lines to a word, words without a dropped line left out.

Defined results: a null or empty text is one empty line, which stays; lines of equal key in one document all stay if it
is the smallest holding them; rows that share a doc_id are one document; a null doc_id comes after all others, as one
document; very long texts are read whole, their lines one by one; an empty table gives an empty table; further columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BLANKS, digest, lower_ascii

MIN_CHARS, SLICES = 10, 16
_LAST = 2**63 - 1


def line_rows(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each line with a key: document (__l_doc, __l_dig), __l_pos and two 64-bit hashes of the key."""
    # the digest stands below the generator: above, it would read the whole text again for every line
    read = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("__l_doc"), digest(text).alias("__l_dig"), F.coalesce(F.col(text), F.lit("")).alias("__l_text"))
    lines = read.select("__l_doc", "__l_dig", F.posexplode(F.split("__l_text", "\n", -1)).alias("__l_pos", "line"))
    stripped = lines.select("__l_doc", "__l_dig", "__l_pos", F.btrim("line", F.lit(BLANKS)).alias("line")).filter(F.char_length("line") >= min_chars)
    key = stripped.select("__l_doc", "__l_dig", "__l_pos", lower_ascii(F.col("line")).alias("key"))
    return key.select("__l_doc", "__l_dig", "__l_pos", F.xxhash64("key").alias("__l_h"), F.xxhash64(F.lit(1), F.col("key")).alias("__l_g"))


def dropped_lines(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, slices: int | None = None) -> DataFrame:
    """(__l_doc, __l_dig, __l_pos) of every line whose key a smaller document holds."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = line_rows(docs, text, min_chars).withColumn("__l_slice", F.pmod(F.xxhash64("__l_doc"), F.lit(slices or max(SLICES, n))))
    # the upper 32 bits of the salted hash, in n ranges of equal width
    salted = F.shiftrightunsigned(F.xxhash64("__l_h", "__l_slice"), 32)
    ranged = rows.withColumn("__l_range", F.shiftright(salted * n, 32).cast("int")).repartitionById(n, F.col("__l_range"))
    stream = W.partitionBy("__l_range", "__l_h", "__l_g", "__l_slice").orderBy("__l_doc", "__l_dig", "__l_pos")
    ranged = ranged.withColumn("__l_first", F.first("__l_doc").over(stream.rowsBetween(W.unboundedPreceding, 0)))
    later = ranged.filter("__l_doc <> __l_first")
    firsts = ranged.filter("__l_doc = __l_first")
    # the first document of every slice against the first of all slices
    over_slices = firsts.groupBy("__l_h", "__l_g").agg(F.min("__l_doc").alias("__l_all"), F.max("__l_doc").alias("__l_max")).filter("__l_all < __l_max").select("__l_h", "__l_g", "__l_all")
    beaten = firsts.join(over_slices, ["__l_h", "__l_g"]).filter("__l_doc > __l_all")
    cols = ["__l_doc", "__l_dig", "__l_pos"]
    return later.select(*cols).unionByName(beaten.select(*cols))


def drop_bitmaps(dropped: DataFrame) -> DataFrame:
    """One row a document: __l_bits, the non-zero 64-line words of its bitmap of dropped lines, as (word, bits)."""
    words = dropped.groupBy("__l_doc", "__l_dig", F.expr("__l_pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, __l_pos % 64)")).alias("bits"))
    return words.groupBy("__l_doc", "__l_dig").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("__l_bits"))


def dedup_lines(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, slices: int | None = None) -> DataFrame:
    """docs with n_lines (before), n_dropped, __drops' effect in kept_text, and line_bitmap (word, bits) of the lines dropped."""
    results = {"n_lines", "n_dropped", "kept_text", "line_bitmap"}
    bitmaps = drop_bitmaps(dropped_lines(docs, text, min_chars, slices))
    passing = [c for c in docs.columns if c not in results]
    keyed = docs.select(*[F.col(f"`{c}`") for c in passing], F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("__l_doc"), digest(text).alias("__l_dig"))
    joined = keyed.join(bitmaps, ["__l_doc", "__l_dig"], "left")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    gone = F.expr("flatten(transform(__l_bits, w -> transform(filter(sequence(0, 63), b -> (shiftright(w.bits, b) & 1L) = 1L), b -> w.word * 64 + b)))")
    staged = joined.withColumn("__l_lines", lines).withColumn("__l_gone", F.coalesce(gone, F.expr("cast(array() as array<int>)")))
    kept = F.when(F.size("__l_gone") == 0, F.coalesce(F.col(text), F.lit(""))).otherwise(F.expr("array_join(transform(array_except(sequence(0, size(__l_lines) - 1), __l_gone), i -> __l_lines[i]), '\\n')"))
    return staged.select(
        *[F.col(f"`{c}`") for c in passing],
        F.size("__l_lines").cast("long").alias("n_lines"),
        F.size("__l_gone").cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
        F.col("__l_bits").alias("line_bitmap"),
    )
