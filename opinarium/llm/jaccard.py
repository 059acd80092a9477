"""Similarity join of texts on word shingles with parity sketches.

A text is the set of its distinct shingles. Every shingle flips one bit of a
sketch, so two sketches differ in at most as many bits as the sets differ in
shingles. Linked sets of sizes a and b differ in at most
``D = (1 - t) / (1 + t) * (a + b)`` shingles; a sketch cut into D + 1 + c blocks
therefore has c + 1 equal blocks for every linked pair (pigeonhole), and equal
blocks are an equi-join. Of c + 1 equal blocks one has a bit unless both texts
have more than c blocks without any, so a text with at most c such blocks leaves
them out; c belongs to the band, so that few texts have more. A text with e <= c
blocks without a bit shares c + 1 - e others with every partner; where fewer of
its blocks are shared at all, it has no partner in that band. Of the blocks that it
shares with every partner it may leave out half, the most crowded ones. Sketch length and D
belong to a size band; a text appears in its own band and in the lower bands
whose partners it can have.
A block of ``BLOCK_BITS`` bits is kept as a 64-bit code of its set bits.

All keys go through one exchange on the key; those that one class alone has, most of
them, fall away there.

Equal sets are one class. In each block group every class meets one leader, the member with
the fewest shingles of its own, and is measured against the best of its leaders, its pivot; linked
classes belong to the pivot's cluster. Classes of one pivot link only if they differ from it
in some of the same shingles, so those not connected yet meet in the rarest of these.
Clusters of different pivots that meet in a block group and are not connected compare their
leaders, and members that the distances to a leader leave room for meet in the same way. So no
component is split. Links inside a component are not all verified, and none are returned or
counted. Leaders of different pivots, near each other but not linked, are compared pair by pair.

Defined cases. Null and empty texts have no shingles, size 0 and link with
nothing; texts with fewer words than a shingle are one shingle. Repeated rows
are separate rows of one class. The component id is the smallest id reachable;
null ids are ignored by it unless a component has no other. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinarium.llm import textscan
from opinarium.llm.columns import unused
from opinarium.llm.tables import components, prefilter
from opinarium.session import broadcast_if_small, materialize

BLOCK_BITS = 1024
BAND_GROWTH = 1.2
# Blocks of fewer shingles than this are narrow: texts that are not linked share some of them.
NARROW = 5
# Least c of a band of narrow blocks, as a share of its D.
SPARE_SHARE = 0.4


@dataclass(frozen=True)
class Rule:
    """Shingle length in words and the similarity, in percent, from which texts link."""

    shingle: int = 3
    percent: int = 90

    def most_different(self, a: int, b: int) -> int:
        """The largest symmetric difference of linked sets of sizes ``a`` and ``b``."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def largest_partner(self, a: int) -> int:
        return a * 100 // self.percent

    def bands(self, largest: int) -> tuple[np.ndarray, list[int], list[int], list[int]]:
        """Lower ends of the size bands, their D, the largest size in each and c."""
        lows = [1]
        while lows[-1] <= largest:
            lows.append(max(lows[-1] + 1, int(lows[-1] * BAND_GROWTH)))
        tops = [self.largest_partner(high - 1) for high in lows[1:]]
        errors = [self.most_different(high - 1, top) for high, top in zip(lows[1:], tops)]
        return np.array(lows), errors, tops, [spare_blocks(low, error) for low, error in zip(lows, errors)]


def spare_blocks(size: int, errors: int) -> int:
    """The least c that the number of blocks without a shingle, of the
    ``errors + 1 + c`` blocks of a set of ``size`` shingles, hardly ever exceeds:
    three deviations above the mean, or 0 where the mean is below 0.01. Where blocks are
    narrow it is ``SPARE_SHARE`` of the errors at least, so that linked texts must share
    more blocks than texts of one vocabulary share by chance."""
    spare = 0
    while spare <= errors:
        blocks = errors + 1 + spare
        bare = blocks * np.exp(-size / blocks)
        if bare + 3 * np.sqrt(bare) <= spare or (not spare and bare <= 0.01):
            break
        spare += 1
    return max(spare, int(SPARE_SHARE * errors)) if size < NARROW * (errors + 1) else spare


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    for row, last, data, offsets in textscan.chunks(column):
        folded = textscan.LOWER[data]
        found = textscan.split_words(folded, offsets, textscan.BLANK_SEPARATED)
        hashes = textscan.span_hashes(folded, found.start, found.end)
        runs = textscan.run_hashes(hashes, shingle)
        for i in range(last - row):
            begin, end = int(found.first[i]), int(found.first[i + 1])
            if end - begin >= shingle:
                yield row + i, np.unique(runs[begin : end - shingle + 1])
            elif end > begin:
                yield row + i, textscan.run_hashes(hashes[begin:end], end - begin)
            else:
                yield row + i, np.zeros(0, dtype=np.uint64)


def set_code(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit codes of a set, equal for equal sets."""
    if not len(shingles):
        return 0, 0
    one = np.bitwise_xor.reduce(textscan.mix(shingles + np.uint64(0x5851F42D4C957F2D)))
    two = np.add.reduce(textscan.mix(shingles ^ np.uint64(0x14057B7EF767814F)))
    return int(one.view(np.int64)), int(two.view(np.int64))


# The low bits of a block's code hold its band.
BANDS = 1 << 7


def block_codes(shingles: np.ndarray, band: int, errors: int, spare: int = 0) -> tuple[np.ndarray, int]:
    """Codes of the ``errors + 1 + spare`` blocks of the parity sketch of one band,
    without those that have no bit where these are at most ``spare``, and how many
    of the codes are shared with every linked set at least."""
    blocks = errors + 1 + spare
    # Sorted hashes give sorted blocks: the high bits choose the block, the low ones the bit.
    block = ((shingles >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    edges = np.searchsorted(block, np.arange(blocks + 1, dtype=np.uint64))
    bit = block * np.uint64(BLOCK_BITS) + shingles % np.uint64(BLOCK_BITS)
    codes = textscan.mix(bit + np.uint64(((band + 1) * 0x2545F4914F6CDD1D) % 2**64))
    parity = np.bitwise_xor.reduceat(np.append(codes, np.uint64(0)), np.minimum(edges[:-1], len(codes)))
    parity[edges[:-1] == edges[1:]] = 0
    place = np.arange(blocks, dtype=np.uint64) + np.uint64(band << 40)
    out = textscan.mix(parity ^ textscan.mix(place)) & ~np.uint64(BANDS - 1) | np.uint64(band)
    bare = np.count_nonzero(parity == 0)
    return (out[parity != 0], spare + 1 - bare) if bare <= spare else (out, 1)


def sketch_keys(shingles: np.ndarray, rule: Rule, bands: tuple) -> tuple[np.ndarray, np.ndarray]:
    """All join keys of a set, and per band ``BANDS * (keys shared at least) + band``;
    bands without errors are left to the classes."""
    lows, errors, tops, spare = bands
    size, out, needs = len(shingles), [], []
    band = int(np.searchsorted(lows, size, side="right")) - 1
    while band >= 0 and size <= tops[band]:
        if errors[band]:
            codes, need = block_codes(shingles, band, errors[band], spare[band])
            out.append(codes)
            needs.append(BANDS * need + band)
        band -= 1
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64), np.array(needs, dtype=np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


# Rows of one output batch; a batch also ends at this many list values.
_OUT_ROWS, _OUT_VALUES = 4096, 1 << 20


def _describe(rule: Rule, sets: bool):
    """Arrow function: ``row, id, text`` to sizes, set codes and sets or needs."""

    def run(batches):
        bands = rule.bands(1 << 10)
        for batch in batches:
            keep, codes, sizes, lists, held = [], [], [], [], 0

            def flush():
                own = batch.select([n for n in batch.schema.names if n != "_text"]).take(pa.array(keep, pa.int64()))
                columns = [pa.array(sizes, pa.int64()), pa.array([c[0] for c in codes], pa.int64()), pa.array([c[1] for c in codes], pa.int64())]
                return pa.RecordBatch.from_arrays([*own.columns, *columns, _lists(lists)], [*own.schema.names, "n", "f1", "f2", "list"])

            for row, shingles in shingle_sets(batch.column(batch.schema.get_field_index("_text")), rule.shingle):
                while len(shingles) >= bands[0][-1]:
                    bands = rule.bands(2 * len(shingles))
                keep.append(row)
                codes.append(set_code(shingles))
                sizes.append(len(shingles))
                lists.append(shingles if sets else sketch_keys(shingles, rule, bands)[1])
                held += len(lists[-1])
                if len(keep) >= _OUT_ROWS or held >= _OUT_VALUES:
                    yield flush()
                    keep, codes, sizes, lists, held = [], [], [], [], 0
            if keep:
                yield flush()

    return run


def signatures(docs: DataFrame, rule: Rule, id_column: str, text_column: str) -> DataFrame:
    """Stored ``(row, id, digest, n, f1, f2, needs)``: digest of the text, set size, set
    codes and needs of the bands per row."""
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.xxhash64(text_column).alias("digest"), F.col(text_column).alias("_text"))
    schema = f"row long, id {kind}, digest long, n long, f1 long, f2 long, list array<long>"
    return materialize(source.mapInArrow(_describe(rule, False), schema).withColumnRenamed("list", "needs"), "signatures")


def _keys(docs: DataFrame, rule: Rule, text_column: str) -> DataFrame:
    """``(key, f1, g)`` of all join keys of every text, where f1 and g name its set.
    A task gives the keys of equal sets once, so copies are few rows of a key."""

    def run(batches):
        bands = rule.bands(1 << 10)
        met: set[tuple[int, int]] = set()
        keys, names, held = [], [], 0

        def flush():
            sizes = [len(k) for k in keys]
            columns = [np.concatenate(keys).view(np.int64), *[np.repeat(np.array(part), sizes) for part in zip(*names)]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int32))], ["key", "f1", "g"])

        for batch in batches:
            for _, shingles in shingle_sets(batch.column(0), rule.shingle):
                while len(shingles) >= bands[0][-1]:
                    bands = rule.bands(2 * len(shingles))
                code = set_code(shingles)
                if not len(shingles) or code in met:
                    continue
                met.add(code)
                keys.append(sketch_keys(shingles, rule, bands)[0])
                names.append((code[0], short_code(code[1])))
                held += len(keys[-1])
                if held >= _OUT_VALUES:
                    yield flush()
                    keys, names, held = [], [], 0
        if keys:
            yield flush()

    return docs.select(text_column).mapInArrow(run, "key long, f1 long, g int")


def short_code(code: int) -> int:
    """The low 32 bits of a set code as a signed number; with the other code 96 bits name a set."""
    low = code & 0xFFFFFFFF
    return low - (1 << 32) if low >> 31 else low


def _needed_sets(docs: DataFrame, needed: DataFrame, rule: Rule, id_column: str, text_column: str) -> DataFrame:
    """Stored ``(node, set)`` of the needed classes, read again from their texts."""
    source = prefilter(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("_text")), needed, "id")
    kind = docs.schema[id_column].dataType.simpleString()
    found = source.mapInArrow(_describe(rule, True), f"id {kind}, n long, f1 long, f2 long, list array<long>")
    same = found["id"].eqNullSafe(needed["id"]) & (found["f1"] == needed["f1"]) & (found["f2"] == needed["f2"])
    sets = prefilter(found, needed, "f1", "f2").join(needed, same).select("node", F.col("list").alias("set"))
    return materialize(sets, "sets")


def _distance(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds the exact symmetric difference ``d`` of the pairs ``(a, b, na, nb)``, which are
    written first so that only sets of theirs are exchanged."""
    pairs = materialize(pairs, "pairs")
    left = prefilter(sets.select(F.col("node").alias("a"), F.col("set").alias("_a")), pairs, "a")
    right = prefilter(sets.select(F.col("node").alias("b"), F.col("set").alias("_b")), pairs, "b")
    met = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("_a", "_b"))
    return met.select("a", "b", "na", "nb", (F.col("na") + F.col("nb") - 2 * common).alias("d")).distinct()


def _linked(rule: Rule) -> Column:
    return (100 + rule.percent) * F.col("d") <= (100 - rule.percent) * (F.col("na") + F.col("nb"))


def _jaccard_distance() -> Column:
    return 2.0 * F.col("d") / (F.col("na") + F.col("nb") + F.col("d"))


def _similar_size(rule: Rule, a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= rule.percent * F.greatest(a, b)


def _block_groups(docs: DataFrame, rule: Rule, text_column: str, found: DataFrame, classes: DataFrame) -> DataFrame:
    """Stored ``(key, node, n, need)``: block groups that two classes or more share, without the
    most crowded ones of a class and without the classes that share too few blocks of a band
    to have a partner in it. ``need`` is the number of these keys of the band that the class
    shares with every partner.

    All keys go through one exchange, in which those of one class alone fall away;
    what is left is a small part and meets its classes.
    """
    low = F.col("f2").bitwiseAND(F.lit(0xFFFFFFFF))
    short = F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")
    reps = found.join(classes.select("node"), found["row"] == classes["node"]).select("node", "n", "f1", short.alias("g"), "needs")
    reps = materialize(reps, "representatives")
    group = Window.partitionBy("key")
    ends = {f"_{name}_{end.__name__}": end(name).over(group) for name in ("f1", "g") for end in (F.min, F.max)}
    several = (F.col("_f1_min") != F.col("_f1_max")) | (F.col("_g_min") != F.col("_g_max"))
    crowd = F.count("*").over(group).cast("int")
    shared = _keys(docs, rule, text_column).withColumns(ends | {"crowd": crowd}).filter(several).select("key", "f1", "g", "crowd").distinct()
    met = materialize(shared.join(reps.select("node", "n", "f1", "g"), ["f1", "g"]).select("key", "node", "n", "crowd"), "shared-blocks")
    band = F.pmod(F.col("key"), F.lit(BANDS)).alias("band")
    needs = reps.select("node", F.explode("needs").alias("_need"))
    needs = needs.select("node", F.pmod(F.col("_need"), F.lit(BANDS)).alias("band"), F.floor(F.col("_need") / BANDS).alias("need"))
    counts = met.groupBy("node", band).agg(F.count("*").alias("met"))
    enough = counts.join(needs, ["node", "band"]).filter("met >= need").select("node", "band", F.col("need").cast("int"))
    kept = _without_crowded(met.select("*", band).join(enough, ["node", "band"])).select("key", "node", "n", "band", "need")
    members = kept.withColumns({"_low": F.min("node").over(group), "_high": F.max("node").over(group)}).filter("_low <> _high")
    # Classes left in too few groups have no partner; a group may keep one member alone.
    left = F.count("*").over(Window.partitionBy("node", "band"))
    return materialize(members.withColumn("_left", left).filter("_left >= need").select("key", "node", "n", "need"), "blocks")


def _without_crowded(entries: DataFrame) -> DataFrame:
    """``entries`` without the most crowded half of the ``need`` keys of each class and
    band; ``need`` becomes the other half.

    Keys have one order, so what linked classes x and y lose of the keys they share are the
    last ones of both: no more than the larger half, and the larger other half is left.
    """
    last = Window.partitionBy("node", "band").orderBy(F.desc("crowd"), F.desc("key"))
    dropped = F.floor(F.col("need") / 2).cast("int")
    return entries.withColumn("_last", F.row_number().over(last)).filter(F.col("_last") > dropped).withColumn("need", F.col("need") - dropped).drop("_last")


def _often_enough(pairs: DataFrame, *columns: str) -> DataFrame:
    """The distinct pairs that meet in ``need`` keys of a band or more.

    Linked classes share that many, and so do the clusters they belong to. Pairs are
    counted by partial sums before any shingle set is read for them.
    """
    band = F.pmod(F.col("key"), F.lit(BANDS)).alias("_band")
    counts = pairs.groupBy(*columns, band).agg(F.count("*").alias("_keys"), F.min("need").alias("need"))
    return counts.filter("_keys >= need").select(*columns).distinct()


def _with_slack(blocks: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Stored block groups with ``slack`` and the leader, the member of most slack.

    Shingles that no other class of any block group has are differences to every
    partner, so classes x and y can link only if slack(x) + slack(y) >= 0 with
    slack = (100 - percent) * n - (100 + percent) * (own shingles). Members that
    cannot link with the leader cannot link with anybody in the group.
    """
    owned = sets.select("node", F.explode("set").alias("shingle")).groupBy("shingle").agg(F.min("node").alias("node"), F.count("*").alias("owners"))
    own = owned.filter("owners = 1").groupBy("node").agg(F.count("*").alias("own"))
    slack = (100 - rule.percent) * F.col("n") - (100 + rule.percent) * F.coalesce("own", F.lit(0))
    entries = materialize(blocks.join(own, "node", "left").select("key", "node", "n", "need", F.coalesce("own", F.lit(0)).alias("own"), slack.alias("slack")), "slack")
    lead = entries.groupBy("key").agg(F.max(F.struct("slack", "node", "n")).alias("lead"))
    led = entries.join(lead, "key").filter(F.col("slack") + F.col("lead.slack") >= 0)
    return materialize(led.select("key", "node", "n", "need", "own", "slack", F.col("lead.node").alias("leader"), F.col("lead.n").alias("leader_n"), F.col("lead.slack").alias("leader_slack")), "led")


def links(docs: DataFrame, rule: Rule, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures, classes, edges): edges join classes whose components equal
    those of all linked pairs."""
    found = signatures(docs, rule, id_column, text_column)
    nonempty = found.filter("n > 0")
    classes = nonempty.groupBy("f1", "f2").agg(F.min("row").alias("node"), F.min("id").alias("least_id"))
    classes = materialize(classes, "classes")
    blocks = _block_groups(docs, rule, text_column, nonempty, classes)
    rows = nonempty.select(F.col("row").alias("node"), "id", "f1", "f2")
    needed = materialize(blocks.select("node").distinct().join(rows, "node"), "needed")
    sets = _needed_sets(docs, needed, rule, id_column, text_column)
    blocks = _with_slack(blocks, sets, rule)

    # One leader per class: the one of most slack over all its block groups.
    to_leader = blocks.filter(_similar_size(rule, "n", "leader_n") & (F.struct("leader_slack", "leader") > F.struct("slack", "node")))
    to_leader = to_leader.groupBy("node", "n").agg(F.max(F.struct("leader_slack", "leader", "leader_n")).alias("lead"))
    to_leader = to_leader.select(F.col("lead.leader").alias("a"), F.col("node").alias("b"), F.col("lead.leader_n").alias("na"), F.col("n").alias("nb"))
    limit = 3 * (100 - rule.percent) / 100 + 1e-9
    near = materialize(_distance(to_leader, sets).filter(_jaccard_distance() <= limit), "near-leaders")
    verified = near.filter(_linked(rule))
    roots = components(verified.select("a", "b"), "roots")

    # A leader of others is a pivot and the center of its cluster, the classes linked to it. Classes
    # near it that are not linked to it have it as pivot too, but are centers of their own.
    pivots = near.select(F.col("a").alias("b")).distinct()
    home = near.join(pivots, "b", "left_anti").select(
        F.col("b").alias("node"), F.col("a").alias("pivot"), "d", F.when(_linked(rule), F.struct(F.col("a").alias("node"), F.col("na").alias("n"))).alias("center")
    )
    placed = (
        blocks.select("key", "node", "n", "need", "own", "slack")
        .join(home, "node", "left")
        .join(roots, "node", "left")
        .select(
            "key", "node", "n", "need", "own", "slack",
            F.coalesce("center.node", "node").alias("center"),
            F.coalesce("center.n", "n").alias("center_n"),
            F.coalesce("pivot", "node").alias("pivot"),
            F.coalesce("d", F.lit(0)).alias("d"),
            F.coalesce("root", "node").alias("root"),
        )
    )
    placed = materialize(placed, "placed")
    open_keys = placed.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low <> _high").select("key")
    placed = materialize(placed.join(open_keys, "key", "left_semi"), "open-blocks")
    members = materialize(placed.select("center", "pivot", "node", "n", "own", "d", "root").distinct(), "members")
    inside = _inside_groups(members, sets, rule)

    # Clusters of different pivots that meet in a block group without being connected.
    met = placed.groupBy("key", "center", "center_n", "pivot", "root").agg(F.max("slack").alias("slack"), F.min("need").alias("need"))
    other = met.select(
        "key", F.col("need").alias("_need"), F.col("center").alias("b"), F.col("center_n").alias("nb"), F.col("pivot").alias("_pivot"), F.col("root").alias("_root"), F.col("slack").alias("_slack")
    )
    centers = met.join(other, "key").filter("center < b and pivot <> _pivot and root <> _root and slack + _slack >= 0")
    centers = centers.filter(1.0 - F.least("center_n", "nb") / F.greatest("center_n", "nb") <= limit)
    centers = centers.select("key", F.col("center").alias("a"), "b", F.col("center_n").alias("na"), "nb", F.greatest("need", "_need").alias("need"))
    centers = _often_enough(centers, "a", "b", "na", "nb")
    measured = materialize(_distance(centers, sets).filter(_jaccard_distance() <= limit), "centers")
    joined = measured.filter(_linked(rule)).select("a", "b").unionByName(verified.select("a", "b")).unionByName(inside)
    joined = materialize(joined, "links")
    return found, classes, joined.unionByName(_between_clusters(measured.filter(~_linked(rule)), members, joined, sets, rule))


def _inside_groups(members: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links between classes of one pivot, of which one at least is not linked to the pivot."""
    apart = members.filter("node = center and node <> pivot")
    linked = members.filter("node <> center").join(apart.select("pivot").distinct(), "pivot", "left_semi")
    apart, linked = (_differences(side, sets) for side in (apart, linked))
    pairs = _overlapping(linked, apart, rule).unionByName(_overlapping(apart, apart, rule))
    return _distance(pairs, sets).filter(_linked(rule)).select("a", "b")


def _differences(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """Stored ``entries`` ``(pivot, node, n, d, root)`` with ``diff``, the ``d`` shingles in which node and pivot differ."""
    entries = materialize(entries.select("pivot", "node", "n", "d", "root"), "differing")
    own = prefilter(sets.withColumnRenamed("set", "_own"), entries, "node")
    pivot = prefilter(sets.select(F.col("node").alias("pivot"), F.col("set").alias("_pivot")), entries, "pivot")
    diff = F.concat(F.array_except("_own", "_pivot"), F.array_except("_pivot", "_own"))
    return materialize(entries.join(own, "node").join(pivot, "pivot").select("pivot", "node", "n", "d", "root", diff.alias("diff")), "differences")


def _overlapping(ones: DataFrame, twos: DataFrame, rule: Rule) -> DataFrame:
    """Pairs ``(a, b, na, nb)`` of one pivot, from ``ones`` and ``twos``, that may link; all that do are among them.

    ``d(x, y) = dx + dy - 2 * (shingles in both differences)``, so x and y link only if their
    differences share ``(excess(x) + excess(y)) / (2 * (100 + percent))`` shingles, with
    ``excess = (100 + percent) * d - (100 - percent) * n``: one at least, where not both are linked
    to the pivot. With the least excess of the other side that is a number for x alone, and of
    the differences that the other side has too x needs only the rarest: all but that number less one.
    """
    both = 2 * (100 + rule.percent)
    excess = (100 + rule.percent) * F.col("d") - (100 - rule.percent) * F.col("n")
    cells = [side.select("pivot", "node", "n", "root", excess.alias("excess"), F.explode("diff").alias("shingle")) for side in (ones, twos)]
    owners = [side.groupBy("pivot", "shingle").agg(F.count("*").alias(name)) for side, name in zip(cells, ("_ones", "_twos"))]
    crowd = owners[0].join(owners[1], ["pivot", "shingle"]).select("pivot", "shingle", (F.col("_ones") + F.col("_twos")).alias("crowd"))
    # Of one table alone, a shingle of one class is counted twice.
    crowd = materialize(crowd.filter("crowd > 2") if ones is twos else crowd, "crowds")

    def rarest(side: DataFrame, other: DataFrame) -> DataFrame:
        least = other.groupBy("pivot").agg(F.min(excess).alias("_least"))
        own = Window.partitionBy("pivot", "node")
        shared = side.join(crowd, ["pivot", "shingle"]).withColumns({"common": F.count("*").over(own), "_place": F.row_number().over(own.orderBy("crowd", "shingle"))})
        needed = F.greatest(F.lit(1), F.ceil((F.col("excess") + F.col("_least")) / both))
        return shared.join(least, "pivot").filter(F.col("_place") <= F.col("common") - needed + 1).select("pivot", "shingle", "node", "n", "root", "excess", "common")

    left, right = rarest(cells[0], twos), rarest(cells[1], ones)
    right = right.select("pivot", "shingle", *[F.col(c).alias(f"_{c}") for c in ("node", "n", "root", "excess", "common")])
    room = (both * F.least("common", "_common") >= F.col("excess") + F.col("_excess")) & (F.col("root") != F.col("_root")) & _similar_size(rule, "n", "_n")
    met = left.join(right, ["pivot", "shingle"]).filter(room & (F.col("node") < F.col("_node")) if ones is twos else room)
    return met.select(F.col("node").alias("a"), F.col("_node").alias("b"), F.col("n").alias("na"), F.col("_n").alias("nb")).distinct()


def _between_clusters(grey: DataFrame, members: DataFrame, joined: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links between members of clusters whose leaders are near but not linked.

    Members ``y`` of the smaller cluster are measured against the leader ``a`` of
    the larger one. Members ``x`` of the larger one meet those that are not linked to ``a``
    in the shingles in which both differ from it.
    """
    sizes = members.groupBy("center").agg(
        F.count("*").alias("members"),
        F.max("n").alias("most_n"),
        F.max(F.when(F.col("node") != F.col("center"), F.col("d") - 2 * F.col("own"))).alias("give"),
    )
    sided = lambda side: sizes.select(F.col("center").alias(side), F.struct("members", "most_n", "give").alias(f"_{side}"))
    pairs = grey.join(sided("a"), "a").join(sided("b"), "b")
    swap = F.col("_a.members") < F.col("_b.members")
    turned = pairs.select(
        *[F.when(swap, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("b", "a"), ("a", "b"), ("nb", "na"), ("na", "nb"))], "d"
    )
    near = turned.join(members.select(F.col("center").alias("b"), F.col("node").alias("y"), F.col("n").alias("ny")), "b")
    others = near.filter("y <> b").select("a", F.col("y").alias("b"), "na", F.col("ny").alias("nb")).distinct()
    measured = materialize(_distance(others, sets), "members-to-leaders")
    roots = components(joined.unionByName(measured.filter(_linked(rule)).select("a", "b")), "roots")
    # Larger clusters that have members beside their leader, and what those can give at most.
    to_leader = turned.select("a", "b", "na", "nb", "d").unionByName(measured.filter(~_linked(rule))).join(sided("a"), "a")
    possible = (100 + rule.percent) * (F.col("d") - F.col("_a.give")) <= (100 - rule.percent) * (F.col("nb") + F.col("_a.most_n"))
    rest = to_leader.filter(possible).select(F.col("a").alias("pivot"), F.col("b").alias("node"), F.col("nb").alias("n"), "d").distinct()
    rooted = lambda side: side.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = _differences(rooted(rest), sets)
    clusters = members.filter("node <> center").drop("root").join(rest.select("pivot").distinct(), "pivot", "left_semi")
    pairs = _overlapping(_differences(rooted(clusters), sets), rest, rule)
    return _distance(pairs, sets).filter(_linked(rule)).select("a", "b").unionByName(measured.filter(_linked(rule)).select("a", "b"))


def _rooted(docs: DataFrame, rule: Rule, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """(signatures, ``(f1, f2, root, least_id)`` of every class): classes of one component have one root."""
    found, classes, edges = links(docs, rule, id_column, text_column)
    roots = components(edges, "roots")
    return found, classes.join(roots, "node", "left").select("f1", "f2", F.coalesce("root", "node").alias("root"), "least_id")


def linked_components(docs: DataFrame, rule: Rule = Rule(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row of ``docs``."""
    found, rooted = _rooted(docs, rule, id_column, text_column)
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    members = rooted.join(least, "root").select("f1", "f2", "component_id")
    return (
        found.select("id", "n", "f1", "f2")
        .join(members, ["f1", "f2"], "left")
        .select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    )


def keep_representatives(docs: DataFrame, rule: Rule = Rule(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of every group of linked rows: the smallest id (null ids last), and
    of several texts under it one. Rows without shingles are linked with nothing and all stay.
    """
    found, rooted = _rooted(docs, rule, id_column, text_column)
    # Per class first: copies meet in partial aggregates, then few rows per component are left.
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", "digest")
    best = found.filter("n > 0").groupBy("f1", "f2").agg(F.min(order).alias("best"), F.count("*").alias("rows"))
    chosen = best.join(rooted, ["f1", "f2"]).groupBy("root").agg(F.min("best").alias("best"))
    id_name, digest_name = unused(docs, "kept_id"), unused(docs, "kept_digest")
    chosen = materialize(chosen.select(F.col("best.id").alias(id_name), F.col("best.digest").alias(digest_name)), "representatives")
    bare = ~F.coalesce(F.col(f"`{text_column}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # Texts are not exchanged but for repeated rows, of equal ids and texts, of which one stays.
    rows = found.filter("n > 0").groupBy(F.col("id").alias(id_name), F.col("digest").alias(digest_name)).agg(F.count("*").alias("_rows"))
    stays = chosen.withColumn("_stays", F.lit(True))
    both = rows[id_name].eqNullSafe(stays[id_name]) & (rows[digest_name] == stays[digest_name])
    fates = rows.join(stays, both, "left").select(rows[id_name], rows[digest_name], "_rows", "_stays")
    fates = materialize(fates.filter("_stays is null or _rows > 1"), "fates")
    same = lambda names: docs[id_column].eqNullSafe(names[id_name]) & (F.xxhash64(docs[text_column]) == names[digest_name])
    pick = lambda which: broadcast_if_small(fates.filter(which).select(id_name, digest_name), F.col(id_name).cast("string"))
    others, repeated = pick("true"), pick("_stays and _rows > 1")
    single = docs.filter(~bare).join(others, same(others), "left_anti")
    several = docs.filter(~bare).join(repeated, same(repeated), "left_semi")
    return docs.filter(bare).unionByName(single).unionByName(several.dropDuplicates([id_column, text_column]))
