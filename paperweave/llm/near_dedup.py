"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard verification, connected components.

Signature: two permutations only. The first, sigma, scatters a shingle (its mixed 64-bit hash, modulo D) over D
positions; the second, pi, is one fixed permutation of 0..D-1. Coordinate k of a document is the smallest
pi[(sigma(s) - k) mod D] over its shingles s, so all coordinates are circular shifts of one table and the
coordinates of one shingle are K neighbouring entries of it.

Bands of ROWS coordinates give candidate groups. No group is ever expanded into all its pairs:

1. documents with identical shingle sets become one class, represented by its smallest id;
2. every band group is compared with its smallest representative only (a star, linear in the group);
3. large groups that then still lie in different components: whoever is outside a group's largest component is compared with one member of
   that, another one for each band (linear again), and components are cut anew, for as long as a round takes a quarter off the pairs across components;
4. what still lies in different components is compared across them: all cross pairs where
   those are few, otherwise by an exact prefix join on the shingles that are rarest among the members concerned. FEW_PAIRS only
   chooses between two exact ways. A family whose members share much, yet less than the threshold, has its rarest shingles
   in no other member, and what is left of a set after its first shared shingle is then too short for a link: such rows do
   not enter the join at all, so they cost no pairs.

So every pair that shares a band is either verified on full sets or already known to be connected. Keys that many rows share
(bands, sets, hubs, leads) never meet in one task: the heaviest, bounded in number, are broadcast or dealt out by the other side.

Defined cases: null or blank text has the empty set and is linked with nothing; a very long text is read whole and is a batch of
its own; fewer than five words make one shingle; ties between ids go to the smallest; rows repeated whole are copies of one
another; null ids form no links; an empty table gives an empty result; columns other than the id and the text are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_HEAVY, discard, join_heavy, materialize, may_survive, survivor_bits
from .wordhash import SPACE, U64, Texts, batches, give_back, hashes, mix, windows

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: 40 bands of 5 rows miss a pair of similarity 0.75 with probability (1 - 0.75**5)**40 = 2e-5, one of 0.8 with 1e-7.
BANDS, ROWS = 40, 5
POSITIONS = 1 << 20
#: Up to so many cross pairs of a band group are verified one by one; beyond it the prefix join takes the group.
FEW_PAIRS = 100
#: Shingles before a row's own that it carries, so that a pair is made once and not at each common shingle; a pair without one among them is made more than once and then taken as one.
BEFORE = 64
SET_BITS = 1 << 24
#: Words of 64 bits in a sketch of a set: bit h is whether an odd number of its shingles hash to h. Two sketches differ in no more bits than their sets differ in shingles.
SKETCH = 16
#: Bytes of texts whose shingles are hashed at once: some 60 bytes of work arrays for each.
BATCH = 1 << 18
#: A set that is in very many pairs is copied once for so many of them.
PAIRS_PER_COPY = 64

_windows_of_pi: np.ndarray | None = None


def _circulant() -> np.ndarray:
    """Row p holds pi[p - K + 1], ..., pi[p] (indices modulo D): the coordinates K-1..0 of a shingle at position p."""
    global _windows_of_pi
    if _windows_of_pi is None:
        k = BANDS * ROWS
        pi = np.random.default_rng(20240607).permutation(POSITIONS).astype(np.uint32)
        _windows_of_pi = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi[-(k - 1) :], pi]), k)
    return _windows_of_pi


def signature(shingles: np.ndarray) -> np.ndarray:
    table, out = _circulant(), None
    at = (mix(shingles) % U64(POSITIONS)).astype(np.int64)
    for i in range(0, len(at), 1024):
        low = table[at[i : i + 1024]].min(axis=0)
        out = low if out is None else np.minimum(out, low)
    return out


def shingle_sets(texts: Texts) -> list[np.ndarray]:
    """Sorted distinct hashes of the 5-word shingles of every text."""
    data = texts.lower_ascii()
    start, end, doc = texts.spans(SPACE)
    words = hashes(data, start, end)
    grams, at = windows(words, doc, SHINGLE)
    of = doc[at]
    cut = np.searchsorted(of, np.arange(texts.n + 1))
    word_cut = np.searchsorted(doc, np.arange(texts.n + 1))
    out = []
    for i in range(texts.n):
        mine = grams[cut[i] : cut[i + 1]]
        own = words[word_cut[i] : word_cut[i + 1]]
        if not len(mine) and len(own):  # fewer than five words: the whole sequence is one shingle
            h = np.full(1, len(own), U64)
            for w in own:
                h = mix(h * U64(31) + w)
            mine = h
        out.append(np.unique(mine))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _describe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it, size=BATCH):
        sets = shingle_sets(Texts(batch.column(1)))
        keys, bands, n = [], [], []
        for s in sets:
            n.append(len(s))
            if not len(s):
                keys.append(None)
                bands.append(None)
                continue
            x = mix(s + U64(7))
            keys.append(f"{len(s):x}-{int(np.add.reduce(x)):016x}{int(np.bitwise_xor.reduce(mix(x))):016x}")
            sig = signature(s).reshape(BANDS, ROWS).astype(U64)
            h = np.arange(1, BANDS + 1, dtype=U64)
            for r in range(ROWS):
                h = mix(h * U64(0x100000001B3) + sig[:, r])
            bands.append(_signed(h))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.string()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands"])


def _set_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it, size=BATCH):
        sets = [s.tobytes() for s in shingle_sets(Texts(batch.column(1)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "shingles"])


def _linked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64)
            if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
                keep.append(False)
                continue
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    give_back()


def _with_set(rows: DataFrame, pairs: DataFrame, sets: DataFrame, side: str, other: str, name: str, total: int) -> DataFrame:
    """rows, the pairs or what was made of them, with the set of one side. Of ids in very many pairs (at most MOST_HEAVY) the pairs are dealt out by the other side and the set is copied to each part. Which ids these are, and which sets are needed, is read from the written pairs, so that no join is made anew for it."""
    least = max(PAIRS_PER_COPY, -(-total // MOST_HEAVY))
    heavy = F.broadcast(pairs.groupBy(side).agg(F.ceil(F.count("*") / PAIRS_PER_COPY).cast("int").alias("_parts")).where(F.col("_parts") * PAIRS_PER_COPY > least))
    dealt = rows.join(heavy, side, "left").withColumn("_part", F.pmod(F.xxhash64(other), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    # Sets of no pair stay where they are.
    needed = may_survive(sets.select(F.col("rep").alias(side), F.col("shingles").alias(name)), survivor_bits(pairs, side), side, "_hit").where("_hit").drop("_hit")
    copied = needed.join(heavy, side, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [side, "_part"]).drop("_part")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links on their full sets. pairs: a written table."""
    total = pairs.count()
    wide = _with_set(_with_set(pairs, pairs, sets, "a", "b", "x", total), pairs, sets, "b", "a", "y", total)
    return wide.select("a", "b", "x", "y").mapInArrow(_linked, "a long, b long")


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, comp), a written table, with comp the smallest rep reachable, for the nodes that have links: large-star / small-star rounds on written tables until nothing changes."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    mark = _mark(edges)
    while mark[0]:
        # Large star: each node links its larger neighbours to its smallest neighbour or itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        # Written, as the second half of the round names it several times and its plan would hold as many copies of the first.
        large = materialize(join_heavy(both, low, "u", "n", 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "cc")
        # Small star: each node links its smaller neighbours and itself to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_heavy(large, least, "u", "n", 2 * mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, edges = edges, materialize(small.where("u <> v").distinct(), "cc")
        discard(old, large)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    top = edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("rep"), "comp")
    out = materialize(nodes.select("rep").join(top, "rep", "left").select("rep", F.coalesce("comp", "rep").alias("comp")), "comp")
    discard(edges)
    return out


def _alike(a: str, b: str) -> Column:
    """Sets of too different sizes are no link, whatever is in them."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _heads(members: DataFrame) -> DataFrame:
    """(band, head, head_comp, head_size, n, cross) of the groups with more than FEW_PAIRS pairs across components: a member of the largest component, picked by a hash so that bands with the same members pick different ones. members: band, rep, comp, size."""
    by_comp = members.groupBy("band", "comp").agg(F.count("*").alias("n"), F.min_by(F.struct("rep", "size"), F.xxhash64("rep", "band")).alias("head"))
    groups = by_comp.groupBy("band").agg(F.max(F.struct("n", "comp", "head")).alias("top"), F.sum("n").alias("n"), ((F.pow(F.sum("n"), 2) - F.sum(F.pow("n", F.lit(2)))) / 2).alias("cross"))
    return groups.where(F.col("cross") > FEW_PAIRS).select("band", F.col("top.head.rep").alias("head"), F.col("top.comp").alias("head_comp"), F.col("top.head.size").alias("head_size"), "n", "cross")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _rest(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs across components that share a band but were not compared with each other. members: band, rep, comp, size."""
    by_comp = members.groupBy("band", "comp").agg(F.count("*").alias("n"))
    groups = by_comp.groupBy("band").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), ((F.pow(F.sum("n"), 2) - F.sum(F.pow("n", F.lit(2)))) / 2).alias("cross")).where("comps > 1")
    left = materialize(join_heavy(members, groups.select("band", "cross", "n"), "band", "n", members.count()), "rest")
    few = left.where(F.col("cross") <= FEW_PAIRS)
    x, y = (few.select("band", F.col("rep").alias(r), F.col("comp").alias(c), F.col("size").alias(n)) for r, c, n in (("a", "ca", "na"), ("b", "cb", "nb")))
    pairs = x.join(y, "band").where(F.col("ca") < F.col("cb")).where(_alike("na", "nb")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    many = left.where(F.col("cross") > FEW_PAIRS).select("rep", "comp").distinct()
    return pairs.unionByName(_prefix_pairs(many, sets)).distinct()


def _prefix_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact: two sets that overlap by PERCENT of their union share one of the first n - ceil(PERCENT% of n) + 1 shingles of each, in any one order of all shingles; here the rarest come first. Their first common shingle also leaves enough shingles after it in both."""
    each = nodes.join(sets, "rep").mapInArrow(_explode_sets, "rep long, comp long, size int, shingle long, sketch array<long>")
    counts = each.groupBy("shingle").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("size").alias("least"))
    ranked = each.join(counts, "shingle").groupBy("rep", "comp", "size").agg(F.first("sketch", ignorenulls=True).alias("sketch"), F.sort_array(F.collect_list(F.struct("df", "shingle", (F.col("lo") < F.col("hi")).alias("mixed"), "least"))).alias("s"))
    # Of the prefix only shingles that other components have as well can meet; each row also carries the first of those before it.
    numbered = F.transform(F.expr(f"slice(s, 1, size - cast(ceil({PERCENT} * size / 100.0) as int) + 1)"), lambda e, i: F.struct(i.alias("at"), e["shingle"].alias("shingle"), e["mixed"].alias("mixed"), e["least"].alias("least")))
    meeting = ranked.select("rep", "comp", "size", "sketch", F.filter(numbered, lambda e: e["mixed"]).alias("p"))
    prefix = meeting.select("rep", "comp", "size", "sketch", "p", F.posexplode("p").alias("k", "e"))
    prefix = prefix.select("rep", "comp", "size", "sketch", (F.col("size") - F.col("e.at")).alias("rest"), "e.shingle", "e.least", F.transform(F.slice("p", F.lit(1), F.least("k", F.lit(BEFORE))), lambda e: e["shingle"]).alias("before"))
    # No partner is smaller than the smallest set with the shingle; what is left of a set has to suffice for one of that size.
    partner = F.greatest("least", F.ceil(PERCENT * F.col("size") / 100))
    prefix = prefix.where((100 + PERCENT) * F.col("rest") >= PERCENT * (F.col("size") + partner))
    x, y = (prefix.select("shingle", *[F.col(c).alias(c + side) for c in ("rep", "comp", "size", "rest", "before", "sketch")]) for side in ("_x", "_y"))
    # An overlap of PERCENT of the union is at least PERCENT / (100 + PERCENT) of both sizes together. A pair is made at its first common shingle alone.
    enough = (100 + PERCENT) * F.least("rest_x", "rest_y") >= PERCENT * (F.col("size_x") + F.col("size_y"))
    # So the sets of a link differ in at most (100 - PERCENT) / (100 + PERCENT) of both sizes together, and their sketches in no more bits.
    differ = sum(F.bit_count(F.get("sketch_x", F.lit(i)).bitwiseXOR(F.get("sketch_y", F.lit(i)))) for i in range(SKETCH))
    alike = (100 + PERCENT) * differ <= (100 - PERCENT) * (F.col("size_x") + F.col("size_y"))
    close = x.join(y, "shingle").where((F.col("comp_x") < F.col("comp_y")) & enough & ~F.arrays_overlap("before_x", "before_y") & alike).select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b"))
    return close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def sketch(shingles: np.ndarray) -> list[int]:
    odd = np.bincount((mix(shingles.view(U64) + U64(11)) % U64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _explode_sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it, 100):
        sets = [np.frombuffer(b, np.int64) for b in batch.column(batch.schema.get_field_index("shingles")).to_pylist()]
        n = np.array([len(s) for s in sets], np.int64)
        rep, comp = (np.repeat(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False), n) for c in ("rep", "comp"))
        sketches = [x for s in sets for x in (sketch(s), *[None] * (len(s) - 1))]  # with a set's first shingle alone
        yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(comp, pa.int64()), pa.array(np.repeat(n, n).astype(np.int32)), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)), pa.array(sketches, pa.list_(pa.int64()))], names=["rep", "comp", "size", "shingle", "sketch"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for every row of docs."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = materialize(texts.mapInArrow(_describe, "doc_id long, n_shingles long, set_key string, bands array<long>"), "sets")
    # All rows of a class have the same bands, so any of them serves.
    classes = materialize(described.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size"), F.count("*").alias("n")), "classes")

    banded = classes.select("rep", "size", F.explode("bands").alias("band"))
    groups = banded.groupBy("band").agg(F.min(F.struct("rep", "size")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups.select("band", F.col("lead.rep").alias("lead"), F.col("lead.size").alias("lead_size"), "n"), "bands")
    # Only rows whose band may have others are shuffled once more.
    shared = may_survive(banded, survivor_bits(groups, "band", SET_BITS), "band", "_hit", SET_BITS).where("_hit").drop("_hit")
    members = materialize(join_heavy(shared, groups, "band", "n", groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), "members")
    star = materialize(members.where((F.col("rep") != F.col("lead")) & _alike("size", "lead_size")).select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), "star")

    reps = materialize(members.select("rep").distinct(), "reps")
    bits = survivor_bits(reps, "rep", SET_BITS)
    wanted = may_survive(texts, bits, "doc_id", "_hit", SET_BITS).where("_hit").drop("_hit").withColumnRenamed("doc_id", "rep").join(reps, "rep", "left_semi")
    # A repeated id would make its pairs repeat, never lose one.
    sets = materialize(wanted.select("rep", "text").mapInArrow(_set_rows, "rep long, shingles binary"), "shingles")

    links, tried = materialize(verify(star, sets), "links"), star
    made, comp = [groups, members, star, reps, sets, links], components(reps, links)
    others = members.where("rep <> lead").select("band", "rep", "size")  # the lead of a band has been compared with all its members
    before = float("inf")
    while True:
        pending = materialize(others.join(comp, "rep"), "pending")
        heads = materialize(_heads(pending), "heads")
        cross, rows = heads.agg(F.coalesce(F.sum("cross"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not cross or 4 * cross > 3 * before:
            break
        before = cross
        asked = join_heavy(pending, heads.drop("cross"), "band", "n", rows).where((F.col("comp") != F.col("head_comp")) & _alike("size", "head_size")).select(*_pair("rep", "head")).distinct()
        asked = materialize(asked.join(tried, ["a", "b"], "left_anti"), "asked")
        more = materialize(verify(asked, sets), "links")
        made += [asked, more]
        tried, links = tried.unionByName(asked), links.unionByName(more)
        discard(pending, heads)
        old, comp = comp, components(reps, links)
        discard(old)
    rest = materialize(_rest(pending, sets).join(tried, ["a", "b"], "left_anti"), "rest")
    more = materialize(verify(rest, sets), "links")
    if not more.isEmpty():
        old, comp = comp, components(reps, links.unionByName(more))
        discard(old)
    discard(*made, pending, heads, rest, more)

    of_class = classes.select("set_key", "rep", "n").join(comp, "rep", "left").select("set_key", "n", F.coalesce("comp", "rep").alias("comp"))
    alone = described.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    known = described.where("set_key is not null and doc_id is not null").select("doc_id", "n_shingles", "set_key")
    joined = join_heavy(known, of_class, "set_key", "n", described.count()).select("doc_id", "n_shingles", F.col("comp").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
