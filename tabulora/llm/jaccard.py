"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the hashes of its distinct word shingles. Sets of nearly equal size form a band; within a band a
similarity of num / den bounds the number k of differing shingles. The domain of shingles is cut into g groups of
`parts` partitions each, where g * (drop + 1) > k, so two similar sets differ by at most `drop` shingles in some group
and agree on some subset of parts - drop of its partitions: each such subset gives one signature, the hash of the
shingles in it. A set that may have partners in the next band gives that band's signatures too.

Empty subsets would be shared by chance, by a share of all documents. There are t groups more than needed, so similar
sets agree in at least t + 1 groups. A set with at most t groups that hold an empty subset is done without those. Another
gives its other subsets and goes on to a partitioning by another salt, and only after ROUNDS of them gives empty subsets
too. No pair is lost: in the first round that either set is done in, both take part and agree on a subset with shingles.

Signatures are dealt out and sorted; one pass over each part keeps those of at least two different sets, in constant
memory. A shingle that differs spoils the signatures of its own partition alone, so a set shares with each partner all but k times as
many of those it has of a band and salt (a few, its need). Sets that share fewer with others have no partner and go, before their
shingles are written; so do, later, sets that share fewer with sets of other components. What many texts have in common (a
line, a passage) makes some of their signatures equal, but not so many. Links are then found without listing all pairs of a group. Every set is compared with its group's pivot, the
member whose signatures most members of their groups share (the text of which the others are near copies). Groups that then lie in one
component are done. Of the others, small ones are listed in pairs. Large ones with pivots of one component take one of these for
all, which is compared with their members. The members are cut up by their differences from the pivot b: let D(x) hold the shingles that just one of x and b has. Two similar sets x and y of
different components differ in at most k shingles, at least one of them is not linked with b, and so D(x) and D(y) share
at least t = (|D(x)| + |D(y)| - k) / 2 >= 1 shingles. In one order of all shingles - rare ones outside b first, common ones
outside b, those of b - they therefore share one among the first |D| - t + 1 of each (prefix filtering), which gives new,
smaller groups; a shingle that only one set has gives none. Rows grow with the members, whatever the group's size. New
groups of up to BLOCK members are compared within a task; while larger ones are left and shrink, they get a pivot in their
turn; what does not shrink (sets that differ from one another only in common shingles) is compared block by block.

A pair is first looked at by sketches, the parities of the shingles in cells: the cells that differ are at most the
shingles that do, so too many of them rule it out for sure, and few that are ruled in are not similar. For these the
whole sets are intersected.

The links themselves are an output of their own, similar_links: there all pairs of all groups are looked at, whatever
their components, so its work and its pairs grow with the number of links.

Defined results: null, empty or blank text: no shingles, linked with nothing, its own component; fewer words than a
shingle: the whole sequence is the one shingle; equal sets (repeated rows, other case, repeated passages): linked; null
id: the row counts for others' links only with its text, its component is the least id there is, or null.
"""

from __future__ import annotations

import functools
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tabulora.llm.common import LOWER, STEP, Work, as_long, find_words, in_filter, key_filter, longs, mix, out_batch, partitions, rows_of, slices, window_hashes, with_types, word_hashes
from tabulora.llm.graph import components

#: Partitions of a group, and how many of them a signature leaves out.
PARTS, DROP = 2, 1
#: Groups besides those needed, as a share of them: this at least, and the first step up to MOST_SPARE at which they
#: are MARGIN times as many as the groups that a set of its band's least size is expected to leave with an empty subset.
SPARE, MOST_SPARE, MARGIN = 0.1, 1.0, 1.5
#: Partitionings by different salts before empty subsets are used.
ROUNDS = 4
#: Low bits of a signature: the band's parity and the partitioning that it is of.
PART_OF = 2 * ROUNDS - 1
#: Times that sets which share too few signatures are left out.
SIFTS = 2
#: A band's largest size by its smallest; at least den / num.
BAND = 1.4
#: Members up to which a group in several components is listed in pairs, and up to which it is compared within a task (a
#: block); the share of its rows that cutting up must leave at most for another round to follow.
SMALL, BLOCK, SHRINK = 18, 512, 0.75
#: Most shingles of pivots that are shipped to the members of their groups (8 bytes each).
SHIP = 1_000_000


def band_tops(num: int, den: int, largest: int) -> np.ndarray:
    """Largest sizes of the bands; in the first, similar sets are equal."""
    tops, ratio = [max(1, (den + num - 1) // (2 * (den - num)))], max(BAND, den / num)
    while tops[-1] < largest:
        tops.append(int(np.ceil(tops[-1] * ratio)))
    return np.array(tops, np.int64)


def spare_share(num: int, den: int) -> float:
    """Spare groups as a share of those needed, for a threshold."""
    share, size = SPARE, (den + num) / (den - num) / PARTS / max(BAND, den / num)
    while share < MOST_SPARE:
        empty = np.exp(-size * (PARTS - DROP) / (1 + share))
        if share / (1 + share) >= MARGIN * (1 - (1 - empty) ** PARTS):
            break
        share += 0.05
    return share


def groups_of(top: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of groups in all, and of spare ones, for bands whose largest size is top."""
    differ = 2 * top * (den - num) // (den + num)
    need = differ // (DROP + 1) + 1
    spare = (spare_share(num, den) * need).astype(np.int64)
    return need + spare, spare


def shingle_sets(data, off, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted within it, and where each row's begin."""
    data = LOWER[data]
    starts, ends, tok = find_words(data, off)
    words, n = word_hashes(data, starts, ends), len(off) - 1
    row = rows_of(tok)
    h = window_hashes(words, size)
    at = np.flatnonzero(row[: len(h)] == row[size - 1 :][: len(h)]) if len(h) else np.zeros(0, np.int64)
    h, row = h[at], row[at]
    counts = np.diff(tok)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = counts[short] > j
            with np.errstate(over="ignore"):
                whole[has] = whole[has] * np.uint64(STEP) + words[tok[short[has]] + j] + np.uint64(1)
        h, row = np.concatenate([h, mix(whole)]), np.concatenate([row, short])
    order = np.argsort((row.astype(np.uint64) << np.uint64(51)) | (h >> np.uint64(13)))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(n + 1))


def set_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash for each whole set."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0xA5A5A5A5)))])
        return mix((sums[at[1:]] - sums[at[:-1]]) ^ (np.diff(at).astype(np.uint64) * np.uint64(STEP)))


def signatures(h: np.ndarray, at: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, and the row of each."""
    return signatures_and_needs(h, at, num, den)[:2]


def signatures_and_needs(h: np.ndarray, at: np.ndarray, num: int, den: int):
    """Signatures and the row of each; rows, parts (the low bits of signatures) and how many signatures of that part the row must share
    with others if a partner is to be found there."""
    sizes = np.diff(at)
    if not len(h):
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    tops = band_tops(num, den, int(sizes.max()) * den // num + 1)
    own = np.searchsorted(tops, sizes)
    whole = np.flatnonzero((sizes > 0) & (own == 0))
    sigs, rows, needs = [set_keys(h, at)[whole]], [whole], []
    for step in (0, 1):
        use = np.flatnonzero((sizes > 0) & (own + step > 0) & ((sizes * den // num > tops[own]) if step else True))
        for salt in range(ROUNDS):
            if not len(use):
                break
            band = own[use] + step
            sig, row, full, on = _subsets(h, at, use, band, tops, num, den, salt)
            part = (band & 1) * ROUNDS + salt
            most = (den - num) * (sizes[use] + np.minimum(tops[band], sizes[use] * den // num)) // (den + num)
            needs.append((use, part, np.maximum(1, full - most * comb(PARTS - 1, PARTS - DROP - 1))))
            parts = np.zeros(len(sizes), np.uint64)
            parts[use] = part
            sigs.append((sig & ~np.uint64(PART_OF)) | parts[row])
            rows.append(row)
            use = use[on]
    return (np.concatenate(sigs), np.concatenate(rows), *(np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*needs, strict=True) if needs else [()] * 3)))


def _subsets(h, at, use, band, tops, num, den, salt):
    """Signatures of the rows `use` in these bands, the row of each; by row of `use`, subsets with shingles and whether it goes on to the
    next salt."""
    n_groups, spare = groups_of(tops[band], num, den)
    cells = np.concatenate([[0], np.cumsum(n_groups * PARTS)])
    n = at[use + 1] - at[use]
    which = np.repeat(np.arange(len(use)), n)
    value = h[np.repeat(at[use] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
    with np.errstate(over="ignore"):
        code = (band.astype(np.uint64) * np.uint64(ROUNDS) + np.uint64(salt + 1)) * np.uint64(STEP)
        salted = mix(value + code[which])
        cell = ((salted >> np.uint64(32)) * (n_groups[which] * PARTS).astype(np.uint64) >> np.uint64(32)).astype(np.int64) + cells[which]
        count = np.bincount(cell, minlength=cells[-1]).reshape(-1, PARTS)
        total = np.zeros(cells[-1], np.uint64)
        np.add.at(total, cell, mix(salted))
        total = total.reshape(-1, PARTS)
        group_row = np.repeat(np.arange(len(use)), n_groups)
        group_no = np.arange(len(group_row)) - np.repeat(cells[:-1] // PARTS, n_groups)
        base = mix(code[group_row] + group_no.astype(np.uint64))
        empty, made = np.zeros(len(group_row), bool), []
        for subset in combinations(range(PARTS), PARTS - DROP):
            few = count[:, subset].sum(axis=1) == 0
            sig = base + np.uint64(sum(1 << p for p in subset))
            for p in subset:
                sig = mix(sig) + total[:, p]
            made.append((mix(sig), few))
            empty |= few
    on = np.bincount(group_row, weights=empty, minlength=len(use)) > spare
    every = on & (salt == ROUNDS - 1)
    keeps = [np.flatnonzero(~few | every[group_row]) for _, few in made]
    full = sum(np.bincount(group_row[~few], minlength=len(use)) for _, few in made)
    return np.concatenate([sig[k] for (sig, _), k in zip(made, keeps, strict=True)]), use[group_row[np.concatenate(keeps)]], full, on


DEAL = pa.schema([("h", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("id", pa.int64())])


def _sign(size, num, den):
    """Rows for documents (n >= 0), for signatures (n = -1) and for how many of them a set must share (n = -2, the number as id); copies in
    a slice give both once."""

    def run(batches):
        for rb, data, off in slices(batches):
            h, at = shingle_sets(data, off, size)
            key, n = set_keys(h, at), np.diff(at)
            first = np.unique(key, return_index=True)[1]
            spread = mix(np.arange(rb.num_rows, dtype=np.uint64) ^ key)
            yield out_batch(DEAL, as_long(spread), as_long(key), n, rb.column("id"))
            sig, row, of, part, need = signatures_and_needs(h, at, num, den)
            once = np.zeros(rb.num_rows, bool)
            once[first] = True
            keep = once[row]
            sig, row = sig[keep], row[keep]
            yield out_batch(DEAL, as_long(sig), as_long(key[row]), np.full(len(sig), -1), pa.nulls(len(sig), pa.int64()))
            keep = once[of]
            of, part, need = of[keep], part[keep], need[keep]
            yield out_batch(DEAL, as_long((mix(key[of]) & ~np.uint64(PART_OF)) | part.astype(np.uint64)), as_long(key[of]), np.full(len(of), -2), need)

    return run


def _shared(batches):
    """Of rows sorted by h and key: documents and needs as they are, and signatures that at least two different sets have."""
    last = None
    for rb in batches:
        h, key, n = (np.asarray(rb.column(c)) for c in ("h", "key", "n"))
        if len(at := np.flatnonzero(n != -1)):
            yield rb.take(pa.array(at))
        at = np.flatnonzero(n == -1)
        h, key, old = h[at], key[at], last
        if not len(h):
            continue
        if old:
            h, key = np.concatenate([[old[0]], h]), np.concatenate([[old[1]], key])
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])
        h, key = h[new], key[new]
        head = np.ones(len(h), bool)
        head[1:] = h[1:] != h[:-1]
        run = np.cumsum(head) - 1
        several = np.bincount(run) > 1
        several[0] |= bool(old and old[2])
        out = several[run]
        last = (h[-1], key[-1], bool(out[-1]))
        if old and old[2]:
            out = out.copy()
            out[0] = False
        at = np.flatnonzero(out)
        yield out_batch(DEAL, h[at], key[at], np.full(len(at), -1), pa.nulls(len(at), pa.int64()))


SETS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("s", pa.list_(pa.int64()))])
SETS_SQL = "key long, id long, n long, sketch binary, s array<bigint>"


def sketch(h: np.ndarray) -> bytes:
    """The parity of the shingles in each of a power of two of cells, about four to a shingle, as bits."""
    cells = 128
    while cells < 4 * len(h):
        cells *= 2
    at = (mix(h ^ np.uint64(0x5C5C5C5C)) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    while x.shape[-1] > size:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def cells_apart(x: bytes, y: bytes) -> int:
    """Cells that differ, after the longer sketch is folded to the shorter one's cells; no more than shingles that do."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    return int(np.bitwise_count((_fold(a, size) ^ _fold(b, size)).view(np.uint64)).sum())


def _sets(size, bitmap):
    def run(batches):
        for rb, data, off in slices(batches):
            h, at = shingle_sets(data, off, size)
            key = set_keys(h, at)
            ids, ok = longs(rb.column("id"))
            want = np.flatnonzero(in_filter(bitmap, key) & (np.diff(at) > 0) & ok)
            want = want[np.lexsort((ids[want], key[want]))]
            want = want[np.unique(key[want], return_index=True)[1]]  # the least id of each set in this slice
            lists = [as_long(h[at[i] : at[i + 1]]) for i in want.tolist()]
            n = np.array([len(x) for x in lists], np.int64)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            values = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            yield out_batch(SETS, as_long(key[want]), ids[want], n, [sketch(x.view(np.uint64)) for x in lists], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)))

    return run


def _near(num, den):
    def run(batches):
        for rb in batches:
            na, nb = (np.asarray(rb.column(c)) for c in ("na", "nb"))
            apart = [cells_apart(x, y) for x, y in zip(rb.column("x").to_pylist(), rb.column("y").to_pylist(), strict=True)]
            ok = (np.array(apart, np.int64) <= (den - num) * (na + nb) // (den + num)) & (den * np.minimum(na, nb) >= num * np.maximum(na, nb))
            yield rb.select(["a", "b"]).take(pa.array(np.flatnonzero(ok)))

    return run


def _linked(work: Work, pairs: DataFrame, sets: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    near = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(_near(num, den), "a long, b long")
    near = work.write(near, f"near-{name}")
    left, right = sets.select(F.col("key").alias("a"), F.col("s").alias("x")), sets.select(F.col("key").alias("b"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y")).alias("both")
    got = near.join(left, "a").join(right, "b").select("a", "b", both, (F.size("x") + F.size("y")).alias("all"))
    return work.write(got.where(f"{den} * both >= {num} * (all - both)").select("a", "b").distinct(), name)


def _part():
    return F.col("h").bitwiseAND(PART_OF).alias("part")


def _enough(work: Work, groups: DataFrame, needs: DataFrame, name: str) -> DataFrame:
    """The rows of groups (h, key, ..) whose sets are in as many of them as one with a partner must be."""
    enough = groups.groupBy("key", _part()).agg(F.count("*").alias("m")).join(needs, ["key", "part"]).where("m >= need")
    return groups.join(work.write(enough.select("key").distinct(), name), "key", "left_semi")


def _signed(work: Work, docs: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int):
    """Documents (key, n, id), the least id of each set (key, lead), signatures (h, key) that different sets share, how many of each part
    one with a partner must share (key, part, need), and those sets (key, n, sketch, s), or None if there are none."""
    spark, rows = work.spark, with_types(docs, id_col, text_col)
    dealt = rows.mapInArrow(_sign(size, num, den), "h long, key long, n long, id long").repartition(partitions(spark), "h").sortWithinPartitions("h", "key")
    found = work.write(dealt.mapInArrow(_shared, "h long, key long, n long, id long"), "found", compression="zstd")
    of_docs = found.where("n >= 0").select("key", "n", "id")
    lead = of_docs.where("n > 0").groupBy("key").agg(F.min("id").alias("lead"))
    shared = found.where("n = -1").select("h", "key")
    needs = found.where("n = -2").select("key", _part(), F.col("id").alias("need")).distinct()
    for k in range(SIFTS):
        left = _enough(work, shared, needs, f"enough{k}")
        several = left.groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi")
        shared = work.write(left.join(several, "h", "left_semi"), f"shared{k}", compression="zstd")
    keys = work.write(shared.select("key").distinct(), "keys")
    n_keys = keys.count()
    if not n_keys:
        return of_docs, lead, shared, needs, None
    needs = work.write(needs.join(keys, "key", "left_semi"), "needs")
    sets = rows.mapInArrow(_sets(size, key_filter(keys, "key", n_keys)), SETS_SQL)
    leads = lead.join(keys, "key", "left_semi")
    one = sets.join(leads, "key").where("id = lead").select("key", "n", "sketch", "s")
    # the sets are the largest table and are joined by key time and again: in buckets they stay where they are
    total = of_docs.join(keys, "key", "left_semi").groupBy("key").agg(F.max("n").alias("n")).agg(F.sum("n").alias("n")).first().n
    return of_docs, lead, shared, needs, work.buckets(one, "sets", "key", 8 * total)


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of docs: id, n_shingles and component_id, the least id that links of similarity num / den reach."""
    spark = docs.sparkSession
    work = Work(spark, "jaccard")
    of_docs, lead, shared, needs, sets = _signed(work, docs, id_col, text_col, size, num, den)
    if sets is not None:
        comp = _resolve(work, shared, needs, sets, num, den)
        least = comp.join(lead, comp.node == lead.key).groupBy("comp").agg(F.min("lead").alias("c"))
        names = work.write(comp.join(least, "comp").select(F.col("node").alias("key"), F.col("c")), "names")
    else:
        names = spark.createDataFrame([], "key long, c long")
    # a table of its own, so that the join below deals both sides and a key with very many copies can be split
    named = work.write(lead.join(names, "key", "left").select("key", F.coalesce("c", "lead").alias("component_id")), "named")
    out = of_docs.where("n > 0").join(named, "key").select("id", F.col("n").alias("n_shingles"), "component_id")
    out = work.write(out.union(of_docs.where("n = 0").select("id", "n", "id")), "classes")
    work.only("classes")
    return out


def _keyed(size):
    def run(batches):
        for rb, data, off in slices(batches):
            key = set_keys(*shingle_sets(data, off, size))
            yield pa.RecordBatch.from_arrays([rb.column("row"), rb.column("id"), pa.array(as_long(key))], names=["row", "id", "key"])

    return run


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of docs for each group that links of similarity num / den join, and all rows without words.

    The row with the least id stays; of several with that id, that with the least hash of its shingles, then the least
    row in the order of its columns (of maps: of their JSON). Rows without an id stay only in groups that have no id at
    all. Each row is decided by its own text, so rows that share an id but not a group are decided apart.
    """
    work = Work(docs.sparkSession, "distinct")
    of_docs, lead, shared, needs, sets = _signed(work, docs, id_col, text_col, size, num, den)
    group = F.col("key")
    if sets is not None:
        lead = lead.join(_resolve(work, shared, needs, sets, num, den).withColumnRenamed("node", "key"), "key", "left")
        group = F.coalesce("comp", "key")
    null, number = F.col("id").isNull().alias("z"), F.coalesce("id", F.lit(0)).alias("i")
    first = lead.groupBy(group.alias("group")).agg(F.min(F.struct(F.col("lead").isNull(), F.col("lead").alias("id"), "key")).alias("r"))
    stay = work.write(first.select("r.key", "r.id").select("key", null, number), "stay")
    # the sets and their links have done their work
    work.only("stay")
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = text.rlike(r"[^\x20\x09-\x0D]")
    rows = docs.where(some).select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), text.alias("text"))
    keyed = rows.mapInArrow(_keyed(size), StructType([rows.schema["row"], rows.schema["id"], StructField("key", LongType())]))
    # copies with one id are put together before anything is dealt out, and others have keys of their own
    # maps have no order; their JSON has
    maps = ["map<" in f.dataType.simpleString() for f in docs.schema]
    fields = [F.to_json(f"row.`{f.name}`") if m else F.col(f"row.`{f.name}`") for f, m in zip(docs.schema, maps, strict=True)]
    least = F.min_by("row", F.struct(*fields)) if any(maps) else F.min("row")
    whole = keyed.select("row", "key", null, number).groupBy("key", "z", "i").agg(least.alias("row"))
    return whole.join(stay, ["key", "z", "i"], "left_semi").select("row.*").union(docs.where(~some))


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """All links of similarity num / den: members and pairs.

    A class is the rows with one set of shingles; class_id is their least id, and rows of a class are linked. Members:
    per row of docs id, n_shingles, class_id and n_links, the number of other rows that it is linked with. Pairs: (a, b),
    a < b, the class_id of each two different classes that are linked, each once; a class whose ids are all null (and
    whose class_id is null) has b null.
    """
    spark = docs.sparkSession
    work = Work(spark, "links")
    of_docs, lead, shared, needs, sets = _signed(work, docs, id_col, text_col, size, num, den)
    if sets is not None:
        groups = work.write(shared.groupBy("h").agg(F.count("*").alias("m")), "groups")
        every = shared.join(groups, "h").select("h", "key", F.col("key").alias("comp"), "m")
        small = every.where(f"m <= {SMALL}")
        pairs = small.join(small.select("h", F.col("key").alias("b")), "h").where("key < b").select(F.col("key").alias("a"), "b")
        pairs = pairs.union(_blocks(every.where(f"m > {SMALL}"), sets, num, den, partitions(spark)))
        pairs = _linked(work, work.write(pairs.distinct(), "pairs"), sets, num, den, "linked")
    else:
        pairs = spark.createDataFrame([], "a long, b long")
    sizes = of_docs.where("n > 0").groupBy("key").agg(F.min("id").alias("class_id"), F.count("*").alias("m"))
    sizes = work.write(sizes, "sizes")
    both = pairs.union(pairs.select("b", "a"))
    others = both.join(sizes.select(F.col("key").alias("b"), "m"), "b").groupBy(F.col("a").alias("key")).agg(F.sum("m").alias("others"))
    # a table of its own, as above
    counted = work.write(sizes.join(others, "key", "left").select("key", "class_id", (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links")), "counted")
    out = of_docs.where("n > 0").join(counted, "key").select("id", F.col("n").alias("n_shingles"), "class_id", "n_links")
    members = work.write(out.union(of_docs.where("n = 0").select("id", "n", "id", F.lit(0).cast("long"))), "members")
    left, right = counted.select(F.col("key").alias("a"), F.col("class_id").alias("x")), counted.select(F.col("key").alias("b"), F.col("class_id").alias("y"))
    named = pairs.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.greatest("x", "y")).alias("b"))
    named = work.write(named, "named")
    work.only("members", "named")
    return members, named


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(num, den):
    """Of rows sorted by (h, lo, hi), a block or two of a group: pairs of different components that sketches allow."""

    def of_group(rows):
        key, comp, own, n = (np.array([r[c] for r in rows]) for c in ("key", "comp", "own", "n"))
        size = min(len(r["sketch"]) for r in rows)
        x = np.stack([_fold(np.frombuffer(r["sketch"], np.uint8), size) for r in rows]).view(np.uint64)
        across = rows[0]["lo"] != rows[0]["hi"]
        left, right = [], []
        for i in range(len(rows) - 1):
            rest = slice(i + 1, None)
            other = comp[rest] != comp[i]
            if across:
                other &= own[rest] != own[i]
            at = i + 1 + np.flatnonzero(other)
            apart = np.bitwise_count(x[at] ^ x[i]).sum(axis=1)
            at = at[(apart <= (den - num) * (n[at] + n[i]) // (den + num)) & (den * np.minimum(n[at], n[i]) >= num * np.maximum(n[at], n[i]))]
            left.append(np.minimum(key[at], key[i]))
            right.append(np.maximum(key[at], key[i]))
        if left:
            yield out_batch(PAIR, np.concatenate(left), np.concatenate(right))

    def run(batches):
        name, held = None, []
        for rb in batches:
            for r in rb.to_pylist():
                if (r["h"], r["lo"], r["hi"]) != name:
                    if held:
                        yield from of_group(held)
                    name, held = (r["h"], r["lo"], r["hi"]), []
                held.append(r)
        if held:
            yield from of_group(held)

    return run


def _blocks(large: DataFrame, sets: DataFrame, num: int, den: int, n_parts: int) -> DataFrame:
    """Pairs (a, b) of large groups (h, key, comp, m) that sketches allow.

    A group is cut into blocks of about BLOCK members; two blocks at a time are compared within a task, and only what
    the sketches allow leaves it.
    """
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    rows = large.select("h", "key", "comp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.select("h", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "key", "comp", "own")
    rows = rows.join(sets.select("key", "n", "sketch"), "key")
    dealt = rows.repartition(n_parts, "h", "lo", "hi").sortWithinPartitions("h", "lo", "hi")
    return dealt.mapInArrow(_compare(num, den), "a long, b long")


APART = pa.schema([("b", pa.int64()), ("key", pa.int64()), ("comp", pa.int64()), ("size", pa.int64()), ("own", pa.int64()), ("other", pa.int64()), ("plus", pa.list_(pa.int64())), ("minus", pa.list_(pa.int64()))])
APART_SQL = "b long, key long, comp long, size long, own long, other long, plus array<bigint>, minus array<bigint>"
DELTA = pa.schema([("b", pa.int64()), ("key", pa.int64()), ("comp", pa.int64()), ("size", pa.int64()), ("own", pa.int64()), ("other", pa.int64()), ("d", pa.list_(pa.int64()))])
DELTA_SQL = "b long, key long, comp long, size long, own long, other long, d array<bigint>"


def prefixes(size, n, nb, low, high, num, den):
    """How many of the `size` shingles of D(x) to look at for partners whose own D is no smaller, and no larger; n, nb: sizes of
    x and of the pivot; low, high: least and largest size of the members."""
    most = (den - num) * (n + min(high, n * den // num)) // (den + num)
    linked = size * (den + num) <= (den - num) * (n + nb)
    # of two members in different components at least one is not linked with the pivot
    unlinked = (den - num) * (max(low, -(-n * num // den)) + nb) // (den + num) + 1
    larger = max(size, unlinked) if linked else size
    up = max(1, -(-(size + larger - most) // 2))
    down = max(1, -(-(size + unlinked - most) // 2) if linked else size - most)
    return max(0, size - up + 1), max(0, size - down + 1)


def _lists(col):
    return np.asarray(col.offsets).astype(np.int64), np.asarray(col.values).view(np.uint64)


def _listed(lists: list) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(as_long(np.concatenate([np.zeros(0, np.uint64), *lists]))))


def _in_star(b, e):
    """A hash of each shingle e of a member of the star of pivot b."""
    with np.errstate(over="ignore"):
        return mix(e + b * np.uint64(STEP))


def _apart(num, den):
    """D(x) of each member of a star, as the shingles that only x has and those that only the pivot has, and the lengths of
    its prefixes."""

    def run(batches):
        for rb in batches:
            (so, s), (bo, sb) = _lists(rb.column("s")), _lists(rb.column("sb"))
            out, plus, minus = [], [], []
            for i, (nb, low, high) in enumerate(zip(*(rb.column(c).to_pylist() for c in ("nb", "low", "high")), strict=True)):
                x, y = s[so[i] : so[i + 1]], sb[bo[i] : bo[i + 1]]
                plus.append(np.setdiff1d(x, y, assume_unique=True))
                minus.append(np.setdiff1d(y, x, assume_unique=True))
                size = len(plus[-1]) + len(minus[-1])
                out.append((size, *prefixes(size, len(x), nb, low, high, num, den)))
            if out:
                yield out_batch(APART, *(rb.column(c) for c in ("b", "key", "comp")), *np.array(out, np.int64).T, _listed(plus), _listed(minus))

    return run


def _outside(batches):
    """A row for each shingle that a member of a star has outside its pivot."""
    for rb in batches:
        off, e = _lists(rb.column("plus"))
        b = np.repeat(np.asarray(rb.column("b")).view(np.uint64), np.diff(off))
        yield pa.RecordBatch.from_arrays([pa.array(as_long(_in_star(b, e[off[0] : off[-1]])))], names=["e"])


def _deltas(shared, common):
    """D(x) of each member of a star, in order and without shingles of only one member, and the lengths of its prefixes."""

    def run(batches):
        for rb in batches:
            (po, plus), (mo, minus) = _lists(rb.column("plus")), _lists(rb.column("minus"))
            plus, minus, every = plus[po[0] : po[-1]], minus[mo[0] : mo[-1]], np.arange(rb.num_rows)
            row = np.repeat(every, np.diff(po))
            e = _in_star(np.asarray(rb.column("b")).view(np.uint64)[row], plus)
            keep = in_filter(shared, e)
            plus, row, rank = plus[keep], row[keep], in_filter(common, e[keep]).astype(np.int64)
            size, own, other = (np.asarray(rb.column(c)) for c in ("size", "own", "other"))
            gone = np.diff(po) - np.bincount(row, minlength=rb.num_rows)
            d, rank = np.concatenate([plus, minus]), np.concatenate([rank, np.full(len(minus), 2)])
            row = np.concatenate([row, np.repeat(every, np.diff(mo))])
            d = d[np.lexsort((d, rank, row))]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rb.num_rows))]).astype(np.int32)
            yield out_batch(DELTA, *(rb.column(c) for c in ("b", "key", "comp")), size, np.maximum(own - gone, 0), np.maximum(other - gone, 0), pa.ListArray.from_arrays(pa.array(ends), pa.array(as_long(d))))

    return run


PREFIX = pa.schema([("h", pa.int64()), ("key", pa.int64()), ("comp", pa.int64()), ("size", pa.int64()), ("own", pa.bool_())])


def _prefixes(bitmap=None):
    """A row for each shingle of the prefix for partners that are no smaller, or, with a filter of those, of the other one."""

    def run(batches):
        for rb in batches:
            d, own, other = rb.column("d"), np.asarray(rb.column("own")), np.asarray(rb.column("other"))
            offsets, values = np.asarray(d.offsets).astype(np.int64), np.asarray(d.values).view(np.uint64)
            first, last = (np.zeros_like(own), own) if bitmap is None else (own, np.maximum(own, other))
            last = np.minimum(last, np.diff(offsets))
            n = np.maximum(last - first, 0)
            row = np.repeat(np.arange(rb.num_rows), n)
            at = offsets[row] + first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            h = _in_star(np.asarray(rb.column("b")).view(np.uint64)[row], values[at])
            if bitmap is not None:
                keep = in_filter(bitmap, h)
                h, row = h[keep], row[keep]
            take = pa.array(row)
            yield out_batch(PREFIX, as_long(h), *(rb.column(c).take(take) for c in ("key", "comp", "size")), np.full(len(row), bitmap is None))

    return run


PREFIX_SQL = "h long, key long, comp long, size long, own boolean"


def _cut_up(work: Work, stars: DataFrame, sets: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """Groups (h, key, comp, size, own) of the members of stars (b, key, comp): similar members of different components
    are together in some group, the one with the smaller difference (either, if equal) as `own`."""
    of = stars.join(sets.select("key", "n"), "key").groupBy("b").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    # pivots are few and shipped where their sets hold at most SHIP shingles; else both sides are dealt out
    pivots = stars.select(F.col("b").alias("key")).distinct()
    pivots = work.write(sets.join(pivots, "key", "left_semi").join(of, F.col("key") == F.col("b")).select("b", "low", "high", F.col("n").alias("nb"), F.col("s").alias("sb")), f"centres{k}")
    n_shingles = pivots.agg(F.coalesce(F.sum("nb"), F.lit(0)).alias("n")).first().n
    each = stars.groupBy("key", "comp").agg(F.collect_list("b").alias("bs"))
    rows = sets.select("key", "s").join(each, "key").select("key", "comp", "s", F.explode("bs").alias("b")).join(F.broadcast(pivots) if n_shingles <= SHIP else pivots, "b")
    rows = rows.select("b", "key", "comp", "nb", "low", "high", "s", "sb")
    apart = work.write(rows.mapInArrow(_apart(num, den), APART_SQL), f"apart{k}", compression="zstd")
    # shingles outside the pivot are counted within their star; those of the whole sets would be most of the sets again
    counts = work.write(apart.select("b", "plus").mapInArrow(_outside, "e long").groupBy("e").agg(F.count("*").alias("m")).where("m > 1"), f"counts{k}")
    both, often = counts.count(), counts.where(f"m > {SMALL}")
    shared, common = key_filter(counts, "e", both), key_filter(often, "e", often.count())
    deltas = work.write(apart.mapInArrow(_deltas(shared, common), DELTA_SQL), f"deltas{k}", compression="zstd")
    work.drop(f"apart{k}")
    own = work.write(deltas.mapInArrow(_prefixes(), PREFIX_SQL), f"own{k}")
    other = deltas.mapInArrow(_prefixes(key_filter(own, "h", own.count())), PREFIX_SQL)
    out = work.write(own.union(other), f"cut{k}")
    work.drop(f"counts{k}", f"centres{k}", f"deltas{k}", f"own{k}")
    return out


def _merged(work: Work, comp: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Components (node, comp) after further links (a, b)."""
    left, right = comp.select(F.col("node").alias("a"), F.col("comp").alias("x")), comp.select(F.col("node").alias("b"), F.col("comp").alias("y"))
    edges = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    over = components(work, edges, name).select(F.col("node").alias("comp"), F.col("comp").alias("of"))
    old = comp.join(over, "comp", "left").select("node", F.coalesce("of", "comp").alias("comp"))
    new = over.select(F.col("comp").alias("node"), F.col("of").alias("comp")).join(comp, "node", "left_anti")
    return work.write(old.union(new), f"{name}-all")


def _resolve(work: Work, shared: DataFrame, needs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Components (node, comp) of the sets that share a signature."""
    spark = work.spark
    sizes = shared.groupBy("h").agg(F.count("*").alias("m"))
    weight = work.write(shared.join(sizes, "h").groupBy("key").agg(F.sum("m").alias("w")), "weight")
    pair = [F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")]
    done = comp = None
    pending, groups, n_big, k = [], shared, 0, 0

    def listed(mixed):
        """Pairs of small groups, and of those that fit into a task."""
        small = mixed.where(f"m <= {SMALL}")
        others = small.select("h", F.col("key").alias("other"), F.col("comp").alias("of"), F.col("size").alias("larger"))
        pairs = small.where("own").join(others, "h").where("comp <> of and key <> other and size <= larger").select(*pair)
        mid = mixed.where(f"m > {SMALL} and m <= {BLOCK}")
        return pairs, _blocks(mid.select("h", "key", "comp", "m").distinct(), sets, num, den, partitions(spark))

    def still_mixed(groups, name):
        several = groups.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("own").alias("some"), F.count("*").alias("m")).where("lo < hi and some")
        return work.write(groups.join(several.select("h", "m"), "h"), name)

    while True:
        # the pivot of each group, and pairs of it and each member
        pivots = work.write(groups.join(weight, "key").groupBy("h").agg(F.max_by("key", F.struct("w", "key")).alias("other")), f"pivots{k}")
        pairs = groups.join(pivots, "h").where("key <> other").select(*pair).distinct()
        pairs = work.write(pairs.join(done, ["a", "b"], "left_anti") if done else pairs, f"pairs{k}")
        links = _linked(work, pairs, sets, num, den, f"links{k}")
        done = done.union(pairs) if done else pairs
        comp = _merged(work, comp, links, f"comp{k}") if comp else components(work, links, f"comp{k}")
        own = [F.lit(0).cast("long").alias("size"), F.lit(True).alias("own")]
        now = groups.join(comp, groups.key == comp.node, "left").select("h", "key", F.coalesce("comp", "key").alias("comp"), *own)
        mixed = still_mixed(now, f"mixed{k}")
        # partners of another component share their signatures in groups that are still mixed; later groups are not of signatures
        for i in range(SIFTS if k == 0 else 0):
            mixed = still_mixed(_enough(work, mixed.drop("m"), needs, f"enough-mixed{i}"), f"mixed{k}-{i}")
        small, _ = listed(mixed)
        pending.append(work.write(small.distinct(), f"small{k}"))
        large = mixed.where(f"m > {SMALL}")
        if large.isEmpty():
            break
        if k == 0:
            # groups whose pivots are of one component take one pivot for all, so that a set is in few stars
            of = large.select("h").distinct().join(pivots, "h").join(comp, F.col("other") == F.col("node"), "left").select("h", "other", F.coalesce("comp", "other").alias("c"))
            heads = of.select("c", F.col("other").alias("key")).distinct().join(weight, "key").groupBy("c").agg(F.max_by("key", F.struct("w", "key")).alias("other"))
            pivots = work.write(of.select("h", "c").join(heads, "c").select("h", "other"), "heads")
            pairs = large.join(pivots, "h").where("key <> other").select(*pair).distinct()
            pairs = work.write(pairs.join(done, ["a", "b"], "left_anti"), "pairs-heads")
            links = _linked(work, pairs, sets, num, den, "links-heads")
            done, comp = done.union(pairs), _merged(work, comp, links, "comp-heads")
            now = large.select("h", "key").join(comp, F.col("key") == F.col("node"), "left").select("h", "key", F.coalesce("comp", "key").alias("comp"), *own)
            large = still_mixed(now, "mixed-heads")
        stars = work.write(large.join(pivots, "h").where("key <> other").select(F.col("other").alias("b"), "key", "comp").distinct(), f"stars{k}")
        cut = still_mixed(_cut_up(work, stars, sets, num, den, k), f"parts{k}")
        pending += listed(cut)
        big = cut.where(f"m > {BLOCK}")
        before, n_big = n_big, big.count()
        if not n_big:
            break
        if k and n_big > SHRINK * before:
            pending.append(_blocks(big.select("h", "key", "comp", "m").distinct(), sets, num, den, partitions(spark)))
            break
        groups, k = big.select("h", "key"), k + 1
    pairs = functools.reduce(DataFrame.union, pending).distinct().join(done, ["a", "b"], "left_anti")
    return _merged(work, comp, _linked(work, work.write(pairs, "pairs-last"), sets, num, den, "links-last"), "comp-last")


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = similar_classes(docs, size=4, num=85, den=100)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op3_ngram_jaccard_links(spark, sf_dir: str) -> DataFrame:
    """The same join, with the number of links instead of components."""
    members, _ = similar_links(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4, num=85, den=100)
    return members.withColumnRenamed("id", "doc_id")
