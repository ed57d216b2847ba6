"""N-gram Jaccard join by vertical partitioning.

Two documents link when the Jaccard similarity of their sets of five-word shingles is at least 3/4. The join is exact, up to
collisions of 64-bit shingle hashes.

1. Windows. Documents are dealt to windows of about WINDOW_BYTES of text. A window's sets are computed together, equal sets once.
2. Global order. The hash range is dealt over as many counters as a shuffle has partitions. Every window sends each counter its
   distinct shingles with the number of its sets that hold them, so a shingle of a third of all documents costs a row per window, not
   per document. A counter sums them and answers each window with a one-byte frequency class per shingle. Class and hash together are
   the global order, rare shingles first.
3. Prefixes. A set of n shingles needs 3/4 of them in common with any partner, so two linked sets share one of their first
   floor(n / 4) + 1 shingles in the order. Class 0 (in one set only) can't be shared: a set with more than floor(n / 4) of those links
   to nothing and leaves.
4. Vertical fragments. EDGES cut the global order by class. A set's shingles in one fragment are its segment. A candidate pair's overlap is
   counted fragment by fragment, where both have a segment, and the partial counts are summed per pair.
5. Candidates. First, in ROUNDS rounds, each list of a prefix shingle names one pivot, the member with the smallest share of shingles of
   its own, and each set proposes one pair: with the best pivot of all its lists that is in another component. So a group of
   thousands of near copies costs a pair a set. Links found give components, and only lists whose members are in several of them go on.
   Then all pairs across components that can still link are verified; a list's join is dealt over blocks of its members. A pair can link when
   - both sets, after the place of their first common shingle, have enough left: min(n - i, m - j) >= 3/7 (n + m);
   - the parities of their shingle counts in BITS buckets differ in at most (n + m) / 7 places, since a set's symmetric difference with
     its partner has no more members than that and each flips one bit.
   Within a component no further link can change a result. Every pair that could link is thus either inside a component or verified.

Defined results: null and empty texts, and texts without words, have an empty set, n_shingles 0, verified_links 0 and their own doc_id as
component; equal texts and repeated rows share a component, whose id is the smallest doc_id; rows with a null doc_id are kept, and
null is an id only if no other is there; texts with fewer than five words are one shingle; very long texts are one window of
their own; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtally.llm import textscan
from loomtally.llm.shared import BROADCAST_ROWS, pack, release, remove, scratch_since, unpack, written

WIDTH = 5
WINDOW_BYTES = 8 << 20
#: Rounds of pivots before the pairs that are left are all verified.
ROUNDS = 2
#: Fragments of the global order: a shingle of class c is in fragment k, the number of edges that are not above c. Class 0 is in none.
EDGES = (4, 16, 128)
#: Buckets whose parities are compared before a pair is verified.
BITS = 256
#: Members of a list that one block of its join holds on average.
BLOCK = 1000


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes row after row, where each row begins, and each row's fingerprint (0: no shingles)."""
    parts, sizes = [], []
    for first, last, data, bounds in textscan.windows(texts):
        data = textscan.lowered(data)
        starts, ends, firsts = textscan.find_words(data, bounds)
        hashes, rows = textscan.shingle_sets(textscan.hash_words(data, starts, ends), firsts, width)
        parts.append(hashes)
        sizes.append(np.diff(rows))
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    every = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    total = np.zeros(len(every) + 1, np.uint64)
    np.cumsum(textscan.mix(every + np.uint64(0xA5)), out=total[1:])
    print_ = textscan.mix((total[at[1:]] - total[at[:-1]]) ^ textscan.mix(size.astype(np.uint64) + np.uint64(3)))
    print_[size == 0] = 0
    return every, at, print_


def _short(hashes: np.ndarray, fragments: int) -> np.ndarray:
    """Fragment in the upper and 32 further bits in the lower half. Equal for unequal shingles only now and then, which makes one
    of them look more frequent than it is; that changes the order, not the result."""
    fragment = ((hashes >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
    return (fragment << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _first_rows(prints: np.ndarray) -> np.ndarray:
    """The first row of each fingerprint but 0."""
    _, first = np.unique(prints, return_index=True)
    first = np.sort(first)
    return first[prints[first] != 0]


def _gathered(every: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.concatenate([every[at[i] : at[i + 1]] for i in rows]) if len(rows) else np.zeros(0, np.uint64)


def _classes(counts: np.ndarray) -> np.ndarray:
    """0 for a single set, else finer for small counts than for large ones, at most 255."""
    c = np.where(counts < 128, counts, 128 + 4 * np.log2(np.maximum(counts, 1) / 128.0))
    return np.where(counts <= 1, 0, np.minimum(255, c)).astype(np.uint8)


def shingle_table(df: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, n, fp, and for the first row in its window of each set that may have a partner: prefix, the part of its prefix that
    other sets share, single, the place at which that begins in the order, bits, the parities of its shingles, and segments, its
    shingles in each fragment as sorted 64-bit integers. Written to the shared folder."""
    spark = df.sparkSession
    rows = df.select("doc_id", F.col(text).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // WINDOW_BYTES))
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counters = min(count, shuffle)
    dealt = rows.withColumn("win", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(count)).cast("int"))
    dealt = dealt.repartition(max(count, shuffle), "win")

    def to_counters(key: tuple, table: pa.Table) -> pa.Table:
        every, at, prints = _sets(table["text"].combine_chunks(), width)
        mine = _gathered(every, at, _first_rows(prints))
        del every
        short, counts = np.unique(_short(mine, counters), return_counts=True)
        del mine
        textscan.trim()
        cuts = np.searchsorted(short, np.arange(counters + 1, dtype=np.uint64) << np.uint64(32))
        low, few = short.astype(np.uint32), np.minimum(counts, 65535).astype(np.uint16)
        return pa.table(
            {
                "counter": pa.array(np.arange(counters, dtype=np.int32)),
                "win": pa.array(np.full(counters, key[0].as_py(), np.int32)),
                "low": pa.array([low[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                "counts": pa.array([few[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            }
        )

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        lows = [np.frombuffer(x, np.uint32) for x in table["low"].to_pylist()]
        every = np.concatenate(lows)
        counts = np.concatenate([np.frombuffer(x, np.uint16) for x in table["counts"].to_pylist()]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        total = np.bincount(group, weights=counts[order]) if len(ranked) else np.zeros(0)
        classes = np.empty(len(every), np.uint8)
        classes[order] = _classes(total)[group]
        ends = np.cumsum([len(x) for x in lows])
        told = pa.array([classes[e - len(x) : e].tobytes() for e, x in zip(ends, lows, strict=True)], pa.binary())
        return pa.table({"win": table["win"], "counter": table["counter"], "classes": told})

    def ordered(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        every, at, prints = _sets(docs["text"].combine_chunks(), width)
        n, mine = np.diff(at), _first_rows(prints)
        own = _gathered(every, at, mine)
        del every
        row = np.repeat(mine, n[mine])
        told = dict(zip(answers["counter"].to_pylist(), answers["classes"].to_pylist(), strict=True))
        classes = np.frombuffer(b"".join(told[k] for k in range(counters)) if told else b"", np.uint8)
        by_short = np.argsort(_short(own, counters), kind="stable")
        ranked = _short(own[by_short], counters)
        c = np.zeros(len(own), np.uint8)
        if len(own):
            c[by_short] = classes[np.cumsum(np.concatenate(([False], ranked[1:] != ranked[:-1])))]
        del by_short, ranked
        single = np.bincount(row[c == 0], minlength=len(n))
        quota = n // 4 + 1
        stays = np.zeros(len(n), bool)
        stays[mine] = single[mine] < quota[mine]
        kept = stays[row]
        own, row, c = own[kept], row[kept], c[kept]
        flips = np.zeros((len(n), BITS), np.uint8)
        np.add.at(flips.reshape(-1), row * BITS + ((own >> np.uint64(20)) % np.uint64(BITS)).astype(np.int64), 1)
        bits = np.packbits(flips & 1, axis=1).view(np.int64)
        shared = c > 0
        own, row, c = own[shared], row[shared], c[shared]
        # Rows stand in order and hashes within a row too: stable sorts by class, then by fragment, keep that.
        order = np.argsort(row * 256 + c, kind="stable")
        left = np.where(stays, n - single, 0)
        ends = np.cumsum(left)
        place = np.arange(len(own)) - np.repeat(ends - left, left)
        taken = place < np.repeat(quota - single, left)
        prefix = own[order][taken].view(np.int64)
        fragment = np.searchsorted(EDGES, c, "right")
        pieces = len(EDGES) + 1
        order = np.argsort(row * pieces + fragment, kind="stable")
        bounds = np.zeros(len(n) * pieces + 1, np.int64)
        np.cumsum(8 * np.bincount(row * pieces + fragment, minlength=len(n) * pieces), out=bounds[1:])
        segments = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n) * pieces, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(own[order].tobytes())]).cast(pa.binary())
        gone = pa.array(~stays)
        each = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values, mask=gone)
        return pa.table(
            {
                "doc_id": docs["doc_id"].cast(pa.int64()),
                "text_hash": docs["text_hash"],
                "win": pa.array(np.full(len(n), key[0].as_py(), np.int32)),
                "n": pa.array(n, pa.int64()),
                "fp": pa.array(prints.view(np.int64)),
                "single": pa.array(single, pa.int32()),
                "prefix": each(np.where(stays, quota - single, 0), pa.array(prefix)),
                "bits": each(np.full(len(n), BITS // 64), pa.array(bits.reshape(-1))),
                "segments": each(np.full(len(n), pieces), segments),
            }
        )

    sent = dealt.groupBy("win").applyInArrow(to_counters, "counter int, win int, low binary, counts binary")
    answers = sent.groupBy("counter").applyInArrow(answer, "win int, counter int, classes binary")
    both = dealt.groupBy("win").cogroup(answers.groupBy("win"))
    kinds = "doc_id long, text_hash long, win int, n long, fp long, single int, prefix array<long>, bits array<long>, segments array<binary>"
    return written(both.applyInArrow(ordered, kinds), "shingles")


def _linked(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """pairs: a, b, na, nb, written. Returns a, b of those with 100 * intersection >= 75 * union. segments: fp, frag, part. What two sets have
    in common is counted in each fragment and summed. Pairs are broadcast to the segments when they are few enough."""
    few = pairs.count() <= BROADCAST_ROWS
    own = F.broadcast(pairs) if few else pairs
    others = pairs.select(F.col("b").alias("fp")).distinct()
    left = own.join(segments.select(F.col("fp").alias("a"), "frag", F.col("part").alias("pa")), "a")
    wanted = segments.join(F.broadcast(others) if few else others, "fp", "left_semi")
    both = left.join(wanted.select(F.col("fp").alias("b"), "frag", F.col("part").alias("pb")), ["b", "frag"]).select("a", "b", "na", "nb", "pa", "pb")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(4), batch.column(5)
            got = np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                at = np.searchsorted(p, q)
                at[at == len(p)] = 0
                got[i] = (p[at] == q).sum()
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], pa.array(got)], ["a", "b", "na", "nb", "common"])

    partial = both.mapInArrow(count, "a long, b long, na long, nb long, common long")
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return summed.where("100 * common >= 75 * (na + nb - common)").select("a", "b")


def _components(links: DataFrame, spark) -> DataFrame:
    """links: a, b. Returns fp, comp: the smallest fp that is reachable, by alternating large and small stars. Few enough edges are kept in one
    partition, where no step needs a shuffle; more are dealt over all tasks."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    few = edges.count() <= BROADCAST_ROWS
    dealt = lambda df: df.coalesce(1) if few else df
    while True:
        # Large star: the larger neighbours of each node are tied to its smallest neighbour, itself included.
        old = dealt(edges)
        both = dealt(old.unionByName(old.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: the smaller neighbours of each node, and itself, are tied to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        new = written(dealt(small).distinct(), "edges")
        # Equal numbers of edges and equal sums of their hashes: nothing changed.
        told = [dealt(x).agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (edges, new)]
        edges = new
        if told[0] == told[1]:
            break
    found = dealt(edges).groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("fp"), F.col("v").alias("comp"))
    return found.unionByName(found.select(F.col("comp").alias("fp"), "comp").distinct())


def jaccard_components(df: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, verified_links (links of its set to other sets that were verified; those inside a component need
    not be), copies (rows with its set) and text_hash (xxhash64 of the text)."""
    spark = df.sparkSession
    table = shingle_table(df, text, width)
    release(spark)
    reps = _one_row_each(table.where("prefix is not null"))
    sets = written(reps.select("fp", "n", "single", "bits"), "sets")
    segments = written(reps.select("fp", F.posexplode("segments").alias("frag", "part")).where(F.octet_length("part") > 0), "segments")
    placed = reps.select("fp", "n", "single", F.posexplode("prefix").alias("i", "h"))
    placed = written(placed.select("h", "fp", "n", (F.col("single") + F.col("i")).alias("i"), F.col("fp").alias("comp")), "lists")
    comps = links = tested = None
    for round_ in range(ROUNDS + 1):
        last = round_ == ROUNDS
        placed, pairs = _across(placed, sets) if last else _stars(placed, sets, round_)
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        found = written(_linked(pairs, segments), "links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            comps = _merged(comps, found, spark)
            if not last:
                placed = written(placed.drop("comp").join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), "placed")
        tested = pairs if tested is None else tested.unionByName(pairs)
        release(spark)
    if comps is None:
        comps, links = spark.createDataFrame([], "fp long, comp long"), spark.createDataFrame([], "a long, b long")

    # Results: the smallest doc_id of each set, then of each component.
    own = table.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    tied = own.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    top = tied.groupBy("comp").agg(F.min("least").alias("component_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    facts = tied.join(top, "comp").join(degree, "fp", "left").select("fp", "component_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    # Only sets with copies or links need a lookup; a set's fingerprint decides whether it has an answer of its own.
    facts = facts.where("copies > 1 or links > 0")
    out = table.select("doc_id", "text_hash", "n", "fp").join(facts, "fp", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("verified_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        "text_hash",
    )


def _one_row_each(rows: DataFrame) -> DataFrame:
    """rows with one row for each fp, that of its first window. The others, copies in further windows, are few as a rule and then broadcast."""
    first = rows.groupBy("fp").agg(F.min("win").alias("_w"), F.count("*").alias("_c")).where("_c > 1").select("fp", "_w")
    extra = written(rows.select("fp", "win").join(first, "fp").where("win <> _w").select("fp", "win"), "extra")
    return rows.join(F.broadcast(extra) if extra.count() <= BROADCAST_ROWS else extra, ["fp", "win"], "left_anti")


def _several(placed: DataFrame, *more) -> DataFrame:
    """A row for each list whose members are in several components, with its number of members k. Written, so that a long list's join can be split."""
    per = placed.groupBy("h").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count("*").alias("k"), *more)
    return written(per.where("_lo <> _hi").drop("_lo", "_hi"), "lists")


def _alike() -> Column:
    """Whether the lengths n and n2 and the parities bits and bits2 let two sets have 3/4 in common."""
    differ = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("bits2")[k])) for k in range(BITS // 64)), F.lit(0))
    return (F.col("n") * 4 >= F.col("n2") * 3) & (F.col("n2") * 4 >= F.col("n") * 3) & (7 * differ <= F.col("n") + F.col("n2"))


def _pairs(found: DataFrame) -> DataFrame:
    turn = F.col("fp") < F.col("fp2")
    pick = lambda x, y: F.when(turn, F.col(x)).otherwise(F.col(y))
    return found.select(pick("fp", "fp2").alias("a"), pick("fp2", "fp").alias("b"), pick("n", "n2").alias("na"), pick("n2", "n").alias("nb")).distinct()


def _stars(placed: DataFrame, sets: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """What goes on of placed, and each set with the best pivot of its lists that is in another component and may link. Pivots are the members
    with the smallest share of shingles that no other set has; the seed decides among equal ones, which are more in later rounds."""
    steps = (1 << 14) >> min(11 * seed, 14)
    # The share in the upper bits, a hash of the set in the lower 48: no two sets have one rank but by a collision, which costs a proposal.
    share = F.expr(f"{steps} - ({steps} * single) div n") * (1 << 48)
    ranked = sets.select("fp", "n", "bits", (share + F.shiftrightunsigned(F.xxhash64(F.lit(seed), "fp"), 16)).alias("rank"))
    placed = placed.join(ranked.select("fp", "rank"), "fp")
    going = written(placed.join(_several(placed, F.max("rank").alias("top")), "h"), "mixed")
    asks = going.where("rank <> top").select("fp", "comp", "top").distinct()
    asks = asks.join(ranked.select("fp", "n", "bits"), "fp")
    pivot = ranked.select(F.col("fp").alias("fp2"), F.col("n").alias("n2"), F.col("bits").alias("bits2"), F.col("rank").alias("top"))
    # A pivot's component is that of its set in any of its rows.
    home = going.where("rank = top").select("top", F.col("comp").alias("comp2")).distinct()
    asks = asks.join(home, "top").where("comp <> comp2").join(pivot, "top").where(_alike())
    best = asks.groupBy("fp").agg(F.max("top").alias("top")).join(asks, ["fp", "top"])
    return going.drop("rank", "top", "k"), _pairs(best)


def _across(placed: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What goes on of placed, and all pairs of a list's members that are in different components and may link."""
    # A member may have partners of at most `most` shingles; it stays if the list has one so short, and one that may have a partner of its length.
    placed = placed.withColumn("most", F.expr("(7 * (n - i)) div 3 - n"))
    for _ in range(2):
        per = _several(placed, F.min("n").alias("_n"), F.max("most").alias("_most"))
        placed = written(placed.join(per, "h").where("most >= _n and n <= _most").drop("_n", "_most"), "mixed").drop("k")
    per = _several(placed).withColumn("blocks", F.expr(f"cast((k - 1) div {BLOCK} + 1 as int)")).drop("k")
    going = placed.join(per, "h").join(sets.select("fp", "bits"), "fp")
    going = written(going.withColumn("block", F.expr("pmod(xxhash64(fp), blocks)").cast("int")), "across")
    # Each member stands in its block, and meets a copy of every other member in each block of the list.
    other = going.select("h", *[F.col(c).alias(f"{c}2") for c in ("fp", "n", "comp", "bits", "most")], F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    bound = (F.col("comp") != F.col("comp2")) & (F.col("fp") < F.col("fp2")) & (F.col("n") <= F.col("most2")) & (F.col("n2") <= F.col("most"))
    return placed, _pairs(going.join(other, ["h", "block"]).where(bound & _alike()))


def _merged(comps: DataFrame | None, found: DataFrame, spark) -> DataFrame:
    """Components after further links: those of the graph of components that the links tie together."""
    if comps is None:
        return written(_components(found, spark), "comps")
    of = lambda c: comps.select(F.col("fp").alias(c), F.col("comp").alias(f"_{c}"))
    tied = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).distinct()
    up = written(_components(tied, spark), "merged").select(F.col("fp").alias("comp"), F.col("comp").alias("_to"))
    moved = comps.join(up, "comp", "left").select("fp", F.coalesce("_to", "comp").alias("comp"))
    # Sets that were in no component are their own node of that graph.
    new = up.join(comps.select(F.col("fp").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("fp"), F.col("_to").alias("comp"))
    return written(moved.unionByName(new), "comps")


def keep_one(df: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """df with one document of each component, that with the smallest doc_id. Columns as in df. Repeated rows of it are reduced to one;
    rows with a null doc_id stay, as nothing tells them apart; so do rows of one doc_id whose texts differ, unless theirs is a copy of a smaller id's."""
    known = scratch_since([])
    judged = jaccard_components(df, text, width)
    used = scratch_since(known)
    gone = written(judged.where("doc_id <> component_id").select("doc_id", F.col("text_hash").alias("_text_hash")).distinct(), "gone")
    remove(df.sparkSession, used)
    # Few enough ids are broadcast; else the texts are shuffled once.
    own, row = pack(df)
    hashed = df.select(*row, F.col("doc_id").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("_text_hash"))
    kept = hashed.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, ["doc_id", "_text_hash"], "left_anti")
    doubles = kept.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    if doubles.isEmpty():
        return kept.select(*unpack(own))
    again = Window.partitionBy("doc_id", "_text_hash").orderBy(F.xxhash64("_row"))
    return kept.withColumn("_n", F.row_number().over(again)).where("_n = 1 or doc_id is null").select(*unpack(own))
