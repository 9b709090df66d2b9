"""SimHash near-duplicates: fingerprints, a segment-popcount grid join under Manhattan distance, exact verification.

A 64-bit fingerprint is embedded as the bit counts of 16 segments of 4 bits. Flipping one bit moves one count by one, so
the Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints. Two fingerprints
within 2 bits therefore both lie within one step of some lattice cell, and more exactly both are within one bit of a
common midpoint whose embedding is that cell. The join publishes each distinct fingerprint into the cells of its unit
ball (33 at most), drops the cells that only one fingerprint reaches, and verifies the rest bit by bit: in a crowded
cell each fingerprint names those of its one-bit neighbours that are embedded there, and fingerprints with a
neighbour in common are linked to the smallest of them. Such a link is exact (two steps of one bit are two bits at most, so the
last comparison of bits holds by construction), and since a midpoint has at most 65 fingerprints around it, no group of
copies is ever expanded into pairs.

Nulls and edge cases: a null or blank text has fingerprint zero and is linked like any other; equal texts share a
fingerprint, so repeated rows meet in one class before the join; an empty table gives an empty result; other columns
of the input are ignored. A null doc_id takes part in linking but never names a component while another id can.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut, prepare, tidy

#: Segments of the embedding, and bits of each; a count takes 3 bits of the packed cell.
SEGMENTS, WIDTH = 16, 4
#: The radius that unit balls around common midpoints cover.
MAX_BITS = 2
_ROWS_AT_ONCE = 1 << 15


def shingle_hashes(text: bytes | None, words_each: int, seed: int) -> Iterator[bytes]:
    """The shingles' hashes, 8 big-endian bytes each, some thousands at a time."""
    words = (text or b"").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= words_each:
        yield xxhash.xxh64_digest(joined, seed)
        return
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[words_each - 1 :].tolist()
    digest = xxhash.xxh64_digest
    for k in range(0, len(ends), _ROWS_AT_ONCE):
        yield b"".join([digest(joined[a:b], seed) for a, b in zip(starts[k : k + _ROWS_AT_ONCE], ends[k : k + _ROWS_AT_ONCE])])


def _votes(hashes: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
    # 255 rows of 8-bit counters fit without carry, so eight bits are summed in each 64-bit addition
    lanes = np.add.reduceat(bits.view(np.uint64), np.arange(0, len(bits), 255), axis=0)
    return lanes.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)


def fingerprint(text: bytes | None, words_each: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of one text, as an unsigned integer; bit i is bit i of the hashes' majority."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, words_each, seed):
        counts, n = counts + _votes(hashes), n + len(hashes) // 8
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words_each: int = 3, seed: int = 42, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a signed 64-bit column."""
    prepare(docs.sparkSession)

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in tidy(batches):
            values = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, words_each, seed) for x in batch.cast(pa.large_binary())]
            yield pa.array(np.array(values, np.uint64).view(np.int64))

    return docs.withColumn(out, of(F.col(text)))


def _segment_count(i: int) -> F.Column:
    return F.bit_count(F.shiftrightunsigned("fp", WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1)))


def _cells(prints: DataFrame) -> DataFrame:
    """fp with each lattice cell of its unit ball: the packed cell, and the step to it (0, or segment+1 with the sign)."""
    counted = prints.select("fp", *(_segment_count(i).cast("long").alias(f"c{i}") for i in range(SEGMENTS)))
    own = sum((F.col(f"c{i}") * F.lit(1 << (3 * i)) for i in range(1, SEGMENTS)), F.col("c0"))
    counted = counted.withColumn("own", own)
    steps = [F.struct(F.lit(0).alias("step"), F.col("own").alias("cell"))]
    for i in range(SEGMENTS):
        unit = F.lit(1 << (3 * i))
        steps.append(F.when(F.col(f"c{i}") < WIDTH, F.struct(F.lit(i + 1).alias("step"), (F.col("own") + unit).alias("cell"))))
        steps.append(F.when(F.col(f"c{i}") > 0, F.struct(F.lit(-i - 1).alias("step"), (F.col("own") - unit).alias("cell"))))
    return counted.select("fp", F.explode(F.array(*steps)).alias("s")).where("s is not null").select("fp", "s.step", "s.cell")


def _midpoints(crowded: DataFrame) -> DataFrame:
    """Each one-bit neighbour of a fingerprint (or itself) that is embedded in the crowded cell it stands in."""
    flips = []
    for j in range(WIDTH):
        bit = F.expr(f"shiftleft(1L, cast((abs(step) - 1) * {WIDTH} + {j} as int))")
        held = F.col("fp").bitwiseAND(bit) != 0
        flips.append(F.when(F.when(F.col("step") > 0, ~held).otherwise(held), F.col("fp").bitwiseXOR(bit)))
    near = F.when(F.col("step") == 0, F.array(F.col("fp"))).otherwise(F.array(*flips))
    return crowded.select("fp", F.explode(near).alias("mid")).where("mid is not null")


def links(prints: DataFrame, parts: int | None = None) -> DataFrame:
    """Links (fp, hub) between distinct fingerprints within MAX_BITS bits, hub the smaller; they connect what all such pairs would.

    ``prints`` has one column fp without repeats.
    """
    cells = _cells(prints)
    cells = cells.repartition(parts, "cell") if parts else cells.repartition("cell")
    crowded = cells.groupBy("cell").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select("cell")
    mids = _midpoints(cells.join(crowded, "cell", "left_semi"))
    # At most 65 fingerprints surround a midpoint, so this list is bounded.
    around = mids.groupBy("mid").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    linked = around.select(F.array_min("fps").alias("hub"), F.explode("fps").alias("fp")).where("fp > hub").distinct()
    return linked.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= MAX_BITS)


#: Edges that one task contracts by itself: shuffling so few costs more than it spreads.
FEW_EDGES = 100_000


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge and leads to a node that leads nowhere."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out = 1 and into = 1").isEmpty()


def components(edges: DataFrame, a: str = "fp", b: str = "hub", most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over the edges, for every node that has one.

    Alternating large-star and small-star contraction until all edges are stars; every round is written to the shared
    folder. A long chain halves in each round, and a hub with many neighbours is only ever reduced to its minimum.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    few = now.count() <= FEW_EDGES
    for _ in range(most_rounds):
        now = now.coalesce(1) if few else now
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.coalesce(1) if few else both
        large = both.join(smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = smallest(large)
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = cut((small.coalesce(1) if few else small).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, words_each: int = 3, seed: int = 42, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, fp (signed 64-bit), component_id (the smallest id reachable over links of 2 bits)."""
    keyed = cut(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")), words_each, seed, "t").select("id", "fp"), "fingerprints")
    classes = cut(keyed.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return keyed.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


#: Shingle similarity of a link beyond 2 bits, 4 of 5 in whole numbers; pairs for each posting beyond which hubs come first, and most of their rounds.
SIMILAR, PAIRS_EACH, HUB_ROUNDS = 0.8, 8, 8
#: Bits of a text's parities.
PARITIES = 1024
PROFILE = "struct<fp:bigint,key:bigint,n:int,half:array<bigint>>"


def distinct_shingles(text: bytes | None, words_each: int, seed: int) -> np.ndarray:
    """The distinct shingle hashes of one text, sorted, as signed integers."""
    return np.unique(np.frombuffer(b"".join(shingle_hashes(text, words_each, seed)), ">i8").astype(np.int64))


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two texts from all their distinct shingle hashes, 8 bytes each."""
    x, y = np.frombuffer(a, ">u8"), np.frombuffer(b, ">u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def profiles(docs: DataFrame, words_each: int, seed: int = 42, text: str = "text", out: str = "profile") -> DataFrame:
    """``docs`` with fingerprint, a hash of the words, the number of distinct shingles and those with a hash of at least zero of ``text``."""
    prepare(docs.sparkSession)

    @F.arrow_udf(PROFILE)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in tidy(batches):
            fps, keys, sizes, halves = np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.int32), []
            for i, x in enumerate(batch.cast(pa.large_binary())):
                words = b" ".join((x.as_buffer().to_pybytes() if x.is_valid else b"").lower().split())
                counts, n, parts = np.zeros(64, np.int64), 0, []
                for hashes in shingle_hashes(words, words_each, seed):
                    counts, n = counts + _votes(hashes), n + len(hashes) // 8
                    parts.append(hashes)
                found = np.unique(np.frombuffer(b"".join(parts), ">i8").astype(np.int64))
                fps[i] = int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")
                keys[i], sizes[i] = xxhash.xxh64_intdigest(words, seed + 1), len(found)
                halves.append(found[np.searchsorted(found, 0) :])
            yield pa.StructArray.from_arrays([pa.array(fps.view(np.int64)), pa.array(keys.view(np.int64)), pa.array(sizes), _lists(halves)], names=["fp", "key", "n", "half"])

    return docs.withColumn(out, of.asNondeterministic()(F.col(text)))


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether each remainder of the hashes by PARITIES is that of an odd number of them, as 64-bit words.

    A shingle that only one of two texts has turns one bit, so their parities differ in no more bits than the texts in shingles.
    """
    odd = np.bincount(shingles & (PARITIES - 1), minlength=PARITIES) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def shingle_sets(texts: DataFrame, words_each: int, seed: int = 42) -> DataFrame:
    """key, all distinct shingle hashes and their parities of each text (key, text)."""
    prepare(texts.sparkSession)

    @F.arrow_udf("struct<shingles:array<bigint>,odd:array<bigint>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in tidy(batches):
            found = [distinct_shingles(x.as_buffer().to_pybytes() if x.is_valid else None, words_each, seed) for x in batch.cast(pa.large_binary())]
            yield pa.StructArray.from_arrays([_lists(found), _lists([parities(x) for x in found])], names=["shingles", "odd"])

    return texts.select("key", of.asNondeterministic()(F.col("text")).alias("s")).select("key", "s.*")


def _with_similar(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes that may have a similar partner.

    A text of n shingles shares at least 4n/5 of them with any text of a similarity of 0.8, so at most n/5 are in no other
    text. Half of all hash values are enough to see that most texts have more.
    """
    seen = prints.select("key", F.explode("half").alias("h")).groupBy("h").agg(F.min("key").alias("key"), F.max("key").alias("last"))
    lone = seen.where("key = last").groupBy("key").agg(F.count("*").alias("lone"))
    return classes.where("n > 0").join(lone, "key", "left").where("coalesce(lone, 0) <= n div 5").drop("lone")


def _postings(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """h, prev and pos, with key, n, odd and comp of the text, of the shared shingles among the n/5 + 1 rarest of each text; similar texts have one of them in common.

    Rarest means in the fewest of ``sets``, then the smallest hash. A shingle of one text only counts for its place but has no partner.
    prev: the shared shingle before h in that order, null for a text's first; pos: how many of the text's shingles come up to h.
    """
    each = sets.select("key", F.explode("shingles").alias("h"))
    shared = each.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1")
    ranked = each.join(shared, "h").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("texts", "h"))).alias("common")).join(classes.select("key", "n", "odd", "comp"), "key")
    kept = F.expr("slice(common, 1, greatest(0, cast(n div 5 as int) + 1 - (n - size(common))))")
    ranked = ranked.withColumn("kept", kept).withColumn("kept", F.expr("transform(kept, (s, i) -> struct(s.h AS h, if(i > 0, kept[greatest(i - 1, 0)].h, NULL) AS prev, n - size(common) + i + 1 AS pos))"))
    return ranked.select("key", "n", "odd", "comp", F.explode("kept").alias("s")).select("s.h", "key", "n", "odd", "s.prev", "s.pos", "comp")


def _may_be_similar() -> str:
    """SQL of what similar texts have in common: numbers of shingles, and parities that differ in at most a ninth of both.

    A similarity of 4/5 or more means that at most a ninth of all shingles of the two are in one of them alone.
    """
    turned = " + ".join(f"bit_count(odd[{i}] ^ other_odd[{i}])" for i in range(PARITIES // 64))
    return f"least(n, other_n) * 5L >= greatest(n, other_n) * 4L AND ({turned}) * 9L <= n + other_n"


def similar_roots(sets: DataFrame, classes: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, root) of the fingerprints over ``linked`` and over all pairs of texts with a shingle similarity of SIMILAR or more.

    sets: key, all shingles and their parities; classes: key, fp and n of distinct texts. Only pairs of different components matter, so where
    many texts share a rare shingle each is first held against one of them, another in each round, until that joins few
    more or the pairs that are left are few; then all pairs left are compared. Pairs whose parities tell that they are not
    similar go where they meet, so that whole sets are fetched for hardly more pairs than are similar.
    """

    @F.arrow_udf("double")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([similarity(np.asarray(x.values).tobytes(), np.asarray(y.values).tobytes()) for x, y in zip(a, b)], pa.float64())

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = sets.select("key", F.col("shingles").alias("a")), sets.select(F.col("key").alias("other"), F.col("shingles").alias("b"))
        sure = pairs.distinct().join(one, "key").join(two, "other").where(alike("a", "b") >= SIMILAR)
        return cut(sure.select(F.col("comp").alias("fp"), F.col("other_comp").alias("hub")).distinct(), "similar")

    def facing(pairs: DataFrame) -> DataFrame:
        return pairs.where(f"comp <> other_comp and {_may_be_similar()}").select("key", "comp", "other", "other_comp")

    base = components(linked)
    named = classes.join(base, classes.fp == base.node, "left").select("key", "n", F.coalesce("root", "fp").alias("comp"))
    placed = cut(_postings(sets, named.join(sets.select("key", "odd"), "key")), "postings")
    most = PAIRS_EACH * placed.count()
    found = []
    for k in range(HUB_ROUNDS + 1):
        placed = cut(placed, "placed") if k else placed
        counts = placed.groupBy("h", "comp").agg(F.count("*").alias("c")).groupBy("h").agg(F.sum("c").alias("rows"), F.sum(F.expr("c * c")).alias("same"), F.count("*").alias("comps"))
        mixed = cut(counts.where("comps > 1"), "mixed")
        left = mixed.agg(F.sum(F.expr("(double(rows) * rows - same) / 2"))).first()[0] or 0
        placed = placed.join(mixed.select("h"), "h", "left_semi")
        if left <= most or k == HUB_ROUNDS:
            break
        hubs = placed.groupBy("h").agg(F.min_by(F.struct("key", "n", "odd", "comp"), F.xxhash64("key", F.lit(k))).alias("o"))
        against = hubs.select("h", F.col("o.key").alias("other"), F.col("o.n").alias("other_n"), F.col("o.odd").alias("other_odd"), F.col("o.comp").alias("other_comp"))
        more = verified(facing(placed.join(against, "h")))
        if more.isEmpty():
            break
        found.append(more)
        if more.count() * 10 < found[0].count():
            break  # the comparison of all pairs left costs less than a new name for all postings
        # Only the groups that were joined just now change their names.
        merged = components(more)
        placed = placed.join(merged, placed.comp == merged.node, "left").select("h", "key", "n", "odd", "prev", "pos", F.coalesce("root", "comp").alias("comp"))
    # Texts that share a passage share many of its shingles: where both have the same one before h, they meet there or earlier.
    # Where they meet first, they have nothing in common before h, so what follows must be enough for their similarity.
    others = placed.select("h", F.col("key").alias("other"), F.col("n").alias("other_n"), F.col("odd").alias("other_odd"), F.col("prev").alias("other_prev"), F.col("pos").alias("other_pos"), F.col("comp").alias("other_comp"))
    enough = "(1 + least(n - pos, other_n - other_pos)) * 9L >= (n + other_n) * 4L"
    more = verified(facing(placed.join(others, "h").where(f"key < other and coalesce(prev <> other_prev, true) and {enough}")))
    if not more.isEmpty():
        found.append(more)
    if not found:
        return base
    for more in found:
        linked = linked.union(more)
    return components(linked)


def representatives(docs: DataFrame, words_each: int = 5, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) without all but one of each near-duplicate group.

    Groups are connected by the exact links of 2 bits and by all pairs of texts whose shingles are similar. The row with the
    smallest doc_id stays, nulls last; rows equal in doc_id and text are one row.
    """
    # The rows' own columns travel in a struct, where no name of theirs can meet one of these.
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.struct("*").alias("row"))
    prints = cut(profiles(keyed.select("doc_id", "text", "h"), words_each, seed).select("doc_id", "h", "profile.*"), "profiles")
    classes = cut(prints.groupBy("key").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("h").alias("source")), "classes")
    linked = cut(links(classes.select("fp").distinct()).select("fp", "hub"), "links")
    some = cut(_with_similar(prints, classes), "partners")
    texts = keyed.select("text", "h").join(some.select("key", "source"), F.col("h") == F.col("source")).select("key", "text").dropDuplicates(["key"])
    roots = similar_roots(cut(shingle_sets(texts, words_each, seed), "sets"), some, linked)
    rooted = prints.select("doc_id", "h", "fp").join(roots, prints.fp == roots.node, "left").withColumn("group", F.coalesce("root", "fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    kept = rooted.groupBy("group").agg(first).select(F.col("first.doc_id").alias("kept_id"), F.col("first.h").alias("kept_text"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("h") == F.col("kept_text"))
    return keyed.select("doc_id", "h", "row").join(kept, same, "left_semi").dropDuplicates(["doc_id", "h"]).select("row.*")
