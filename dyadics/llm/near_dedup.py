"""Near-duplicate groups by SetSketch registers.

A text's set is that of its distinct 5-word shingles. Each of M registers keeps, of all members, the least of an
exponential hash, truncated to a power of B: registers of a union are the maxima of the parts' registers, and two
registers are equal with a probability that follows the Jaccard similarity. Bands of ROWS registers make the
candidates; the joint likelihood of the registers, with both set sizes known, drops those far below the threshold;
what remains is verified on full sets.

Equal sets are collapsed first. In each band bucket every member meets the bucket's most central member. After the
verified links are joined to groups, only members of different groups of a bucket still have to meet: those outside
the bucket's largest group, the roamers, meet each other and that group, in pairs of blocks of bounded size. A bucket of
more roamers than a block holds is crowded: most of its members share a passage without being near. Its members are
dealt anew by the shingles that are rarest among such members, so many of each text that any two near sets have one in
common (a prefix filter, which is exact). A pair of blocks hands on the links that connect its groups, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import small, stored
from .text_arrays import LOWER, chunks, distinct, hashes, mix, shingles, words

K = 5
BANDS, ROWS = 21, 6
M = BANDS * ROWS
#: Base and number of steps of the truncation; the least hash of up to 10**18 members stays in range.
B, STEPS = 1.001, 62_000
#: Links at PERCENT of similarity or more, by exact integer comparison.
PERCENT = 85
#: Five standard errors of the estimate at the threshold: a pair estimated lower is not verified.
SLACK = 5 * (0.85 * 0.15 / M) ** 0.5
#: Members of a block, and shingles of a pivot's partners, that one task compares.
BLOCK = 512
SHINGLES_A_TASK = 100_000
#: Rows dealt to blocks that one partition gets on average.
ROWS_A_PARTITION = 4_000
#: Counters by which shingles of crowded buckets are ordered; any order is exact, a better one makes fewer candidates.
COUNTERS = 1 << 18
#: A hash that tells the rows of a doc_id apart.
MARK = "xxhash64(text)"
_A = mix(np.arange(1, M + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their offsets."""
    data = LOWER[data]
    starts, ends, owner = words(data, offsets)
    value, of, _ = shingles(hashes(data, starts, ends), owner, K)
    return distinct(value, of, len(offsets) - 1)


def registers(value: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SetSketch registers [texts, M] of sets given as hashes and offsets; those of an empty set are 0."""
    texts = len(ends) - 1
    least = np.full((texts, M), np.iinfo(np.uint64).max, dtype=np.uint64)
    full = np.flatnonzero(np.diff(ends))
    step = 1 << 15  # values that stay in the cache while all registers pass over them
    if len(full):
        begins = ends[:-1][full]
        at = 0
        while at < len(full):
            to = max(at + 1, int(np.searchsorted(begins, begins[at] + step)))
            lo = begins[at]
            hi = ends[1:][full[min(to, len(full)) - 1]]
            part, cuts = value[lo:hi], begins[at:to] - lo
            for r in range(M):
                least[full[at:to], r] = np.minimum.reduceat(part * _A[r], cuts)
            at = to
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64)
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(exponential) / np.log(B))
    out = np.clip(level + 4_000, 0, STEPS + 1).astype(np.uint16)  # the offset stands for SetSketch's rate
    out[np.diff(ends) == 0] = 0
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band [texts, BANDS]."""
    key = np.zeros((len(sketch), BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x100000001B3) + sketch[:, r::ROWS].astype(np.uint64))
    return key.view(np.int64)


def _log_likelihood(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray):
    """The log-likelihood of a Jaccard similarity, given pairs of sketches [pairs, M] of sets of known sizes, as a function."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = M - more - less
    u, v = na / (na + nb), nb / (na + nb)

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-x * (B - 1) / B) / np.log(B), 1e-12, 1)

    def value(j: np.ndarray) -> np.ndarray:
        # a greater register means that the least hash lies in that set alone
        up, down = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    return value


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches [pairs, M] of sets of known sizes."""
    value = _log_likelihood(a, b, na, nb)
    lo, hi = np.zeros(len(a)), np.minimum(na / nb, nb / na)
    for _ in range(25):  # the likelihood has one maximum
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = value(x) > value(y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


def promising(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether the most likely similarity is no further below the threshold than SLACK: there the likelihood still rises.

    Sets whose sizes allow the threshold alone are asked about.
    """
    value, at = _log_likelihood(a, b, na, nb), np.full(len(a), PERCENT / 100 - SLACK)
    return value(at + 1e-6) >= value(at - 1e-6)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, mark (of the text), n, digest (of the set), bands, sketch of each row; a narrow table without texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for part, data, offsets in chunks(batch):
                value, ends = shingle_sets(data, offsets)
                sketch = registers(value, ends)
                keys = band_keys(sketch)
                texts = len(ends) - 1
                digest = [hashlib.blake2b(value[ends[i] : ends[i + 1]].tobytes(), digest_size=16).digest() for i in range(texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.array(digest, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(texts + 1) * BANDS, pa.int32()), pa.array(keys.ravel())),
                        pa.array([row.tobytes() for row in sketch], pa.binary()),
                    ],
                    names=["doc_id", "mark", "n", "digest", "bands", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(MARK).alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, n long, digest binary, bands array<long>, sketch binary")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, M)


def _promising(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The (id, pivot) whose sizes allow the threshold and whose sketches come near it."""
    one = reps.select("id", "n", "sketch")
    two = reps.select(F.col("id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("sketch").alias("pivot_sketch"))
    fit = pairs.join(one, "id").join(two, "pivot").where((F.least("n", "pivot_n") * 100) >= F.greatest("n", "pivot_n") * PERCENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("n", "pivot_n"))
            a, b = (_matrix(batch.column(batch.schema.get_field_index(c))) for c in ("sketch", "pivot_sketch"))
            yield batch.select(["id", "pivot", "n"]).filter(pa.array(promising(a, b, na, nb)))

    return fit.select("id", "pivot", "n", "pivot_n", "sketch", "pivot_sketch").mapInArrow(run, "id long, pivot long, n long")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (id, pivot) at the threshold or above on full sets. A pivot's partners are dealt out by their sizes."""
    load = pairs.groupBy("pivot").agg(F.ceil(F.sum("n") / SHINGLES_A_TASK).alias("blocks"))
    dealt = pairs.join(load, "pivot").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).select("id", "pivot", "block")
    # the pivot goes to each of its blocks: known from their number, without a second join on a pivot that may be hot
    homes = load.select(F.col("pivot").alias("id"), "pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    roles = dealt.unionByName(homes)
    rows = roles.join(texts, "id").select("pivot", "block", "id", "text")

    def run(group: pa.Table) -> pa.Table:
        ids, pivot = group.column("id").to_numpy(), group.column("pivot")[0].as_py()
        home = int(np.flatnonzero(ids == pivot)[0])
        _, data, offsets = next(chunks(pa.RecordBatch.from_arrays([group.column("text").combine_chunks().slice(home, 1)], names=["text"])))
        own, _ = shingle_sets(data, offsets)
        out = []
        for batch in group.select(["id", "text"]).to_batches():
            for part, data, offsets in chunks(batch):
                value, ends = shingle_sets(data, offsets)
                ok = part.column(0).to_numpy()[_near_sets(own, value, ends)]
                out.append(ok[ok != pivot])
        found = np.concatenate(out)
        return pa.table({"id": pa.array(found, pa.int64()), "pivot": pa.array(np.full(len(found), pivot), pa.int64())})

    return rows.groupBy("pivot", "block").applyInArrow(run, "id long, pivot long")


def _near_sets(own: np.ndarray, value: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the sets, given as hashes and offsets, have the threshold's similarity to ``own`` (ascending) or more."""
    hit = np.r_[0, np.cumsum(own[np.minimum(np.searchsorted(own, value), len(own) - 1)] == value)]
    both = hit[ends[1:]] - hit[ends[:-1]]
    return 100 * both >= PERCENT * (np.diff(ends) + len(own) - both)


def _buckets(members: DataFrame) -> DataFrame:
    """key, main, roamers, others of each bucket of several groups: the largest group, and how many are outside and in it."""
    sizes = members.groupBy("key", "group").agg(F.count("*").alias("many"))
    whole = sizes.groupBy("key").agg(F.max(F.struct("many", "group")).alias("most"), F.sum("many").alias("size"), F.count("*").alias("groups"))
    return whole.where("groups > 1").select("key", F.col("most.group").alias("main"), (F.col("size") - F.col("most.many")).alias("roamers"), F.col("most.many").alias("others"))


_DEALT = ("key", "inside", "i", "j", "band", "guest", "leads", "id", "group", "n", "sketch")


def _dealt(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows of buckets (key, main, roamers, others, band, leads, id, group) dealt to pairs of blocks (key, inside, i, j).

    Roamers are cut into blocks, and so are the members of the main group. Each two blocks of roamers meet, ``inside``
    the roamers, and each block of roamers meets each of the main group. Both blocks of a pair hold some BLOCK rows.
    """
    cut = rows.withColumns({"a": F.ceil(F.col("roamers") / BLOCK).cast("int"), "b": F.ceil(F.col("others") / BLOCK).cast("int"), "roams": F.col("group") != F.col("main")})
    cut = cut.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("roams"), F.col("a")).otherwise(F.col("b"))).cast("int"))

    def pair(inside: bool, i: Column, j: Column, guest: Column) -> Column:
        return F.struct(F.lit(inside).alias("inside"), i.cast("int").alias("i"), j.cast("int").alias("j"), guest.alias("guest"))

    own, yes, no = F.col("own"), F.lit(True), F.lit(False)
    each_a, each_b = F.sequence(F.lit(0), F.col("a") - 1), F.sequence(F.lit(0), F.col("b") - 1)
    roaming = F.concat(F.transform(each_a, lambda x: pair(True, F.least(own, x), F.greatest(own, x), own <= x)), F.transform(each_b, lambda x: pair(False, own, x, yes)))
    home = F.transform(each_a, lambda x: pair(False, x, own, no))
    dealt = cut.select("key", "band", "leads", "id", "group", F.explode(F.when(F.col("roams"), roaming).otherwise(home)).alias("to"))
    return dealt.select("key", "to.*", "band", "leads", "id", "group").join(reps.select("id", "n", "sketch"), "id").select(*_DEALT)


_BY = ("key", "inside", "i", "j")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole groups, and the rows from and to which each group goes, of batches that are sorted by ``_BY``.

    Most groups are small: many go through one table, and none is handed over by itself.
    """
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows, dtype=bool)
        for c in _BY:
            values = table.column(c).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        starts = np.r_[0, np.flatnonzero(new)]
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
        rest = table.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest, [(0, rest.num_rows)]


class _Blocks:
    """The rows of a pair of blocks as arrays, and which pairs of a guest and a member at home are near by their sketches."""

    @classmethod
    def of(cls, table: pa.Table, spans: list[tuple[int, int]]) -> Iterator[_Blocks]:
        """Those of each group of a table."""
        columns = {c: table.column(c).to_numpy() for c in ("n", "group", "id", "leads", "guest", "band", "inside", "i", "j")}
        columns["sketch"] = _matrix(table.column("sketch"))
        for a, b in spans:
            yield cls({c: v[a:b] for c, v in columns.items()})

    def __init__(self, part: dict[str, np.ndarray]):
        self.sketch, self.n, self.group, self.id, self.leads = (part[c] for c in ("sketch", "n", "group", "id", "leads"))
        self.band = int(part["band"][0])
        self.alone = bool(part["inside"][0]) and part["i"][0] == part["j"][0]  # a block that meets itself
        self.guests = np.flatnonzero(part["guest"])
        self.home = self.guests if self.alone else np.flatnonzero(~part["guest"])

    def near(self, guest: int) -> np.ndarray:
        """Places at home whose pair with the guest is to be verified here; of pairs that share bands, in the first of them."""
        at = self.home
        fit = self.group[at] != self.group[guest]
        if self.alone:
            fit &= self.id[at] < self.id[guest]
        fit &= PERCENT * np.maximum(self.n[at], self.n[guest]) <= 100 * np.minimum(self.n[at], self.n[guest])
        # of two sets that met by a rare shingle, the smaller one has it among those it leads with
        fit &= np.where(self.n[at] <= self.n[guest], self.leads[at], False) | np.where(self.n[at] >= self.n[guest], self.leads[guest], False)
        at = at[fit]
        if len(at):
            same = self.sketch[at] == self.sketch[guest]
            # far fewer equal registers than the threshold asks for need no likelihood; M of them fit a byte
            enough = np.add.reduce(same.view(np.uint8), axis=1, dtype=np.uint8) >= M * (PERCENT / 100 - SLACK - 0.1)
            at, same = at[enough], same[enough]
            if self.band >= 0:
                whole = np.logical_and.reduce([same[:, r::ROWS] for r in range(ROWS)])
                at = at[whole.argmax(axis=1) == self.band]
        if len(at):
            own = np.broadcast_to(self.sketch[guest], (len(at), M))
            at = at[promising(self.sketch[at], own, self.n[at], np.full(len(at), self.n[guest]))]
        return at


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of pairs of blocks that have a near partner in theirs."""
    for table, spans in _groups(batches):
        takes_part = np.zeros(table.num_rows, dtype=bool)
        for (start, _), blocks in zip(spans, _Blocks.of(table, spans), strict=True):
            for guest in blocks.guests:
                at = blocks.near(guest)
                takes_part[start + at] = True
                takes_part[start + guest] |= len(at) > 0
        if takes_part.any():
            yield from table.filter(pa.array(takes_part)).to_batches()


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links of pairs of blocks that join their groups: as many as it takes to connect them, not one for each pair."""
    for table, spans in _groups(batches):
        found = []
        for (start, stop), blocks in zip(spans, _Blocks.of(table, spans), strict=True):
            sets = []
            for batch in table.select(["text"]).slice(start, stop - start).combine_chunks().to_batches():
                for _, data, offsets in chunks(batch):
                    value, ends = shingle_sets(data, offsets)
                    sets += [value[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            found += _links_of(blocks, sets)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["id", "pivot"])


def _links_of(blocks: _Blocks, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    found, root = [], {g: g for g in blocks.group.tolist()}

    def top(g: int) -> int:
        while root[g] != g:
            root[g] = root[root[g]]
            g = root[g]
        return g

    for guest in blocks.guests:
        own = top(int(blocks.group[guest]))
        at = np.array([i for i in blocks.near(guest).tolist() if top(int(blocks.group[i])) != own], dtype=np.int64)
        if not len(at):
            continue
        value, ends = np.concatenate([sets[i] for i in at]), np.r_[0, np.cumsum([len(sets[i]) for i in at])]
        for i in at[_near_sets(sets[guest], value, ends)].tolist():
            a, b = top(int(blocks.group[i])), top(int(blocks.group[guest]))
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((int(blocks.id[guest]), int(blocks.id[i])))
    return found


def _links_between(rows: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links that connect different groups of the same bucket. ``rows`` are those of ``_dealt``."""
    dealt = stored(_dealt(rows, reps), "dealt-rows")

    def by_group(table: DataFrame, rows: int) -> DataFrame:
        # a partitioning by bucket alone would put all blocks of a bucket in one task
        return table.repartition(1 + rows // ROWS_A_PARTITION, *_BY).sortWithinPartitions(*_BY)

    near = stored(by_group(dealt, dealt.count()).mapInArrow(_partners, dealt.schema), "near-rows")
    together = by_group(near.join(texts, "id"), near.count())
    return stored(together.mapInArrow(_spanning, "id long, pivot long"), "links")


def _commonness(texts: DataFrame) -> np.ndarray:
    """How many of the texts' shingles fall to each of COUNTERS counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for _, data, offsets in chunks(batch):
                total += np.bincount((shingle_sets(data, offsets)[0] % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    got = texts.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out


def _prefixes(texts: DataFrame) -> DataFrame:
    """key, id, leads: the rarest shingles of each text, so many that near sets share one.

    Two near sets of sizes a <= b have at least PERCENT * (a + b) / (100 + PERCENT) in common, so some shingle is among the
    rarest of both, even if each set leaves out as many, less one, as it must share with any partner at all. Where a set is
    the smaller of the two it must share more, so it leads with fewer shingles than it looks up.
    """
    shared = texts.sparkSession.sparkContext.broadcast(_commonness(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch):
                value, ends = shingle_sets(data, offsets)
                n = np.diff(ends)
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((value, shared.value[(value % np.uint64(COUNTERS)).astype(np.int64)], owner))
                place = np.arange(len(value)) - ends[owner]
                looks_up = place <= (n - -(-PERCENT * n // 100))[owner]
                leads = place <= (n - -(-2 * PERCENT * n // (100 + PERCENT)))[owner]
                yield pa.RecordBatch.from_arrays([pa.array(value[order][looks_up].view(np.int64)), part.column(0).take(pa.array(owner[looks_up])), pa.array(leads[looks_up])], names=["key", "id", "leads"])

    return texts.select("id", "text").mapInArrow(run, "key long, id long, leads boolean")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, mark, group for each row of ``docs``.

    Two rows are linked if 100 * |intersection| >= 85 * |union| of their shingle sets; component_id is the least doc_id
    reachable. Texts without words (null and empty ones too) are linked with nothing. Rows with a null doc_id stand alone,
    with a null component_id, and are kept. Rows that repeat a doc_id are linked by their own texts, each for itself; equal
    ones share a component. ``mark`` is a hash of the text that tells such rows apart, ``group`` a number of the linked texts, null for
    those that are linked with nothing by rule. Other columns are ignored.
    """
    sketched = stored(sketches(docs), "sketches")
    whole = sketched.where("n > 0 AND doc_id IS NOT NULL")
    # equal sets collapse to one row each; a group of any size is combined before the exchange
    classes = whole.groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("first"), *(F.first(c).alias(c) for c in ("n", "bands", "sketch")))
    reps = stored(classes.select(F.monotonically_increasing_id().alias("id"), "digest", "first.*", "n", "bands", "sketch"), "reps")
    banded = reps.select("id", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    # written right after each join on a bucket's key, so that adaptive execution may split a hot one
    met = stored(banded.join(shared, "key"), "bucket-members")
    # the pivot of a bucket is its most central member: the one that meets most others over all its bands
    central = met.groupBy("id").agg(F.sum("many").alias("meets"))
    pivots = stored(met.join(central, "id"), "central").groupBy("key").agg(F.max(F.struct("meets", (-F.col("id")).alias("less"))).alias("best")).select("key", (-F.col("best.less")).alias("pivot"))
    members = stored(met.join(pivots, "key").select("key", "band", "id", "pivot"), "buckets")
    inside = stored(members.select("id").distinct().join(reps, "id").select("id", F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")), "bucket-ids")
    # the texts of bucket members alone, one for each set, kept for all rounds
    read = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.expr(MARK).alias("_mark"), "text").join(small(inside, inside.count()), ["_doc", "_mark"])
    texts = stored(read.groupBy("id").agg(F.first("text").alias("text")), "bucket-texts")
    narrow = reps.select("id", "n", "sketch")
    links = stored(_verified(_promising(members.where("id != pivot").select("id", "pivot").distinct(), narrow), texts), "links")
    groups = connected(links)
    grouped = stored(members.select("key", "band", "id").join(groups, "id", "left").withColumn("group", F.coalesce("group", "id")), "grouped-members")
    mixed = stored(grouped.join(_buckets(grouped), "key").withColumn("leads", F.lit(True)), "mixed-buckets")
    links = links.unionByName(_links_between(mixed.where(F.col("roamers") <= BLOCK), narrow, texts))
    crowded = mixed.where(F.col("roamers") > BLOCK).select("id", "group").distinct()
    if not crowded.isEmpty():
        crowded = stored(crowded, "crowded")
        own = stored(texts.join(crowded.select("id"), "id"), "crowded-texts")
        rare = stored(_prefixes(own), "prefixes")
        # a shingle that no set leads with, or that one group has for itself, joins nothing
        useful = rare.groupBy("key").agg(F.count("*").alias("many"), F.bool_or("leads").alias("led")).where("many > 1 AND led").select("key")
        met = stored(rare.join(useful, "key").join(crowded, "id"), "prefix-members").withColumn("band", F.lit(-1))
        links = links.unionByName(_links_between(stored(met.join(_buckets(met), "key"), "prefix-buckets"), narrow, texts))
    groups = connected(links)
    # back to every row: its set's class, the class's group, the least doc_id of all classes of the group
    labelled = reps.select("id", "digest", "doc_id").join(groups, "id", "left").select("digest", "doc_id", F.coalesce("group", "id").alias("group"))
    least = labelled.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    named = stored(labelled.join(least, "group").select("digest", "component_id", "group"), "classes")
    rest = sketched.where("n = 0 OR doc_id IS NULL").select("doc_id", "mark", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"))
    every = whole.select("doc_id", "mark", "n", "digest").join(named, "digest").select("doc_id", "mark", "n", "component_id", "group").unionByName(rest)
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "mark", "group")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group of ``docs`` with all its columns: that of the least doc_id, of several texts under it the one of
    the least mark, of several equal rows any one. Rows with a null doc_id or without words all stay.

    The rows that go, and those that come twice, are few as a rule; while they are within the bound they are broadcast and
    no text is exchanged.
    """
    linked = near_groups(docs).where("group IS NOT NULL").groupBy("group", F.col("doc_id").alias("_id"), "mark").agg(F.count("*").alias("rows"))
    linked = stored(linked, "linked-texts")
    best = linked.groupBy("group").agg(F.min(F.struct("_id", "mark")).alias("best"))
    ruled = stored(linked.join(best, "group").select("_id", "mark", "rows", (F.struct("_id", "mark") == F.col("best")).alias("stays")), "ruled-texts")
    gone, again = ruled.where("NOT stays").select("_id", "mark"), ruled.where("stays AND rows > 1").select("_id", "mark")
    left = docs.join(small(gone.withColumnRenamed("mark", "_mark"), gone.count()), (docs["doc_id"].cast("long") == F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_mark")), "left_anti")
    many = again.count()
    if not many:
        return left
    again = small(again.withColumnRenamed("mark", "_mark"), many)
    same = (left["doc_id"].cast("long") == F.col("_id")) & (F.xxhash64(left["text"]) == F.col("_mark"))
    once = left.join(again, same).groupBy("_id", "_mark").agg(F.first(F.struct(*(left[c] for c in docs.columns))).alias("row"))
    return left.join(again, same, "left_anti").unionByName(once.select("row.*"))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("mark", "group")
