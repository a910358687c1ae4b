"""Document fingerprints by winnowing, in DataFrame functions alone.

A text is a sequence of tokens: its words, and the single code points of words of more than LONGEST, so that tokens do
not depend on where a text without spaces is entered. Each run of K tokens has a rolling (polynomial) hash; of each W
consecutive hashes the least is kept, the rightmost of equal ones, with its position. Any passage of W + K - 1 whole
tokens that two texts share leaves a common hash in both fingerprints.

The hashes of all positions are rolled at once: two runs of n tokens, one right after the other, make those of 2 n. The
least of each window comes about in the same way, so a text costs some log2(K) + log2(W) passes over its tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stored

K = 5
W = 8
#: Code points of the longest word that is a token.
LONGEST = 16
#: Modulus and base of the rolling hash; products of two residues stay below 2**62.
PRIME, BASE = 2**31 - 1, 1_103_515_245
#: Positions count down from here.
LAST = 2**31 - 2
#: Positions in order: at most PIECES knots (a small array on the driver), each cut into PIECES equal ranges.
PIECES = 64


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: lambda variables are never inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    space = r"\x20\x09-\x0D"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?<![^{space}])[^{space}]{{1,{LONGEST}}}(?![^{space}])|[^{space}]"), F.lit(0))


def _ahead(values: Column, by: int) -> Column:
    """The values from the (by + 1)-th on."""
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _rolled(hashes: Column, k: int) -> Column:
    """sum(hash * BASE**(k - 1 - place)) modulo PRIME of the k values from each one on; what lies beyond the last counts 0."""

    def joined(left: Column, right: Column, size: int) -> Column:
        power = pow(BASE, size, PRIME)
        return F.zip_with(left, right, lambda x, y: (x * F.lit(power) + F.coalesce(y, F.lit(0))) % F.lit(PRIME))

    def doubled(runs: Column, size: int) -> Column:
        if 2 * size > k:
            return extended(runs, size)
        return let(joined(runs, _ahead(runs, size), size), lambda out: doubled(out, 2 * size))

    def extended(runs: Column, size: int) -> Column:
        return runs if size == k else let(joined(runs, _ahead(hashes, size), 1), lambda out: extended(out, size + 1))

    return doubled(hashes, 1)


def _least(values: Column, w: int) -> Column:
    """The least of the w values from each one on, or of those that are left."""

    def doubled(runs: Column, size: int) -> Column:
        if size == w:
            return runs
        step = min(size, w - size)
        return let(F.zip_with(runs, _ahead(runs, step), lambda x, y: F.least(x, y)), lambda out: doubled(out, size + step))

    return doubled(values, 1)


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """The kept grams in order, each as one long: the gram's hash above the lowest 32 bits, its position in these.

    Fewer than k tokens make one gram, fewer than w grams one window; a text without tokens has no gram.
    """

    def grams(ts: Column) -> Column:
        # the lower half falls with the position, so the least of a window is the rightmost of its least hashes
        runs = F.slice(let(F.transform(ts, lambda t: F.shiftrightunsigned(F.xxhash64(t), 33)), lambda hs: _rolled(hs, k)), 1, F.greatest(F.size(ts) - k + 1, F.lit(1)))
        return F.transform(runs, lambda h, i: F.shiftleft(h, 32).bitwiseOR(F.lit(LAST) - i))

    def kept(gs: Column) -> Column:
        return F.array_distinct(F.slice(_least(gs, w), 1, F.greatest(F.size(gs) - w + 1, F.lit(1))))

    empty = F.array().cast("array<bigint>")
    return let(tokens(text), lambda ts: F.when(F.size(ts) == 0, empty).otherwise(let(grams(ts), kept)))


def grams_of(kept: Column) -> Column:
    """The distinct gram hashes of a fingerprint."""
    return F.array_distinct(F.transform(kept, lambda v: F.shiftright(v, 32).cast("int")))


def as_text(kept: Column) -> Column:
    """A fingerprint as text: ``hash:position`` for each kept gram, in order, the hash in hex."""
    return F.array_join(F.transform(kept, lambda v: F.concat(F.hex(F.shiftrightunsigned(v, 32)), F.lit(":"), F.lit(LAST) - v.bitwiseAND(F.lit(2**31 - 1)))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of gram hashes; two empty ones are alike (1)."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(let(both, lambda n: n / (F.size(a) + F.size(b) - n).cast("double")))


def neighbours(ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """For each distinct non-null id, ``prev_id``: the next lesser one, or the greatest before the least.

    The order is cut into ranges of about equal counts, each ordered in a task of its own; what lies between two
    ranges is a table of PIECES**2 rows at most. ``prev_chars`` is the greatest n_chars of the rows of that id.
    """
    rows = ids.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("id")).agg(F.max("n_chars").alias("n_chars"))
    knots = rows.select(F.percentile_approx("id", [i / PIECES for i in range(PIECES + 1)], 10_000)).first()[0] or [0, 0]
    knots = sorted(set(knots))
    los = F.array(*map(F.lit, [int(k) for k in knots])).cast("array<bigint>")
    piece = F.greatest(F.size(F.filter(los, lambda k: k <= F.col("id"))), F.lit(1))
    lo, hi = F.element_at(los, F.col("piece")), F.element_at(los, F.least(F.col("piece") + 1, F.lit(len(knots))))
    part = F.floor((F.col("id") - lo).cast("double") * PIECES / F.greatest((hi - lo).cast("double"), F.lit(1.0)))
    rows = rows.withColumn("piece", piece).withColumn("part", F.least(F.greatest(part, F.lit(0)), F.lit(PIECES - 1)).cast("int"))
    within = Window.partitionBy("piece", "part").orderBy("id")
    rows = rows.withColumns({"prev_id": F.lag("id").over(within), "prev_chars": F.lag("n_chars").over(within)})
    ends = rows.groupBy("piece", "part").agg(F.max(F.struct("id", "n_chars")).alias("last"))
    whole = Window.orderBy("piece", "part")
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "piece",
        "part",
        F.coalesce(F.lag("last").over(whole), F.max("last").over(every)).alias("before"),
    )
    joined = rows.join(F.broadcast(ends), ["piece", "part"])
    return joined.select(
        F.col("id").alias(column),
        F.coalesce("prev_id", "before.id").alias("prev_id"),
        F.when(F.col("prev_id").isNull(), F.col("before.n_chars")).otherwise(F.col("prev_chars")).alias("prev_chars"),
    )


def fingerprint_edits(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and their likeness to each other and to the next document's.

    The edited text has the last floor(n/4) code points replaced by the first as many (or all) of the next document
    in ascending doc_id; the first follows the last. A null text is empty. A null doc_id has no next document: nothing
    replaces the tail and near_next is null. Of rows that repeat a doc_id, the one whose text begins least is what the
    document before sees as its next. Columns other than doc_id and text are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
    # a key that cannot be null and the same columns keep the two uses of ``marked`` alike, so that it is exchanged once.
    # Rows without an id meet nothing; they are spread by their texts
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text")))
    order = neighbours(stored(rows.select("doc_id", "n_chars"), "ids")).select(F.col("doc_id").cast("string").alias("key"), F.col("prev_id").cast("string").alias("prev_key"), "prev_chars")
    marked = rows.withColumn("kept", winnow(F.col("text"), k, w)).withColumn("key", key).repartition("key")
    # what the document before needs of this one: its first quarter's worth of code points, and the gram hashes
    ahead = marked.join(order, "key").select(
        F.col("prev_key").alias("key"),
        F.struct(F.substring("text", F.lit(1), F.floor(F.col("prev_chars") / 4).cast("int")).alias("head"), "doc_id", "n_chars", grams_of(F.col("kept")).alias("grams")).alias("next"),
    )
    ahead = ahead.groupBy("key").agg(F.min("next").alias("next"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    head = F.coalesce(F.substring(F.col("next.head"), F.lit(1), cut), F.lit(""))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), head)
    both = marked.join(ahead, "key", "left").withColumn("edited", edited)
    both = both.withColumn("edited_kept", winnow(F.col("edited"), k, w))
    both = both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "kept",
        "edited_kept",
        grams_of(F.col("kept")).alias("grams"),
        grams_of(F.col("edited_kept")).alias("edited_grams"),
        F.col("next.grams").alias("next_grams"),
    )
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("kept")).alias("fingerprint"),
        as_text(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("grams"), F.col("edited_grams")).alias("near_edited"),
        likeness(F.col("grams"), F.col("next_grams")).alias("near_next"),
    )


def op1_winnowing(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
