"""N-gram Jaccard self join by grouped prefixes.

Method: the distinct shingles of a text, in one global order (rare first), are
cut to the prefix that two sets must share a member of if their similarity is
0.75 or more. Texts with equal sets become one (a copy needs no comparing);
sets with identical prefixes and sizes become one group, and only groups go
into the inverted index on prefix members. Group pairs are filtered by size
and position, then expanded to members and verified on whole sets.

No group emits all its pairs. Within the sorted list of an index key each
entry has a leader, the first one whose size allows a link; an entry is first
verified against the leader it shares most keys with, which gives components
of copies at one comparison a text. Every list that then still holds different
components is taken up again: once with the likeliest pair of each component,
and last with all pairs of entries whose components differ, so that no link
between components is lost and none within a component is tried. Before texts
are compared, bit parities of the sets (four to eight bits for each member)
bound the overlap from above and drop pairs that cannot link.

Sizes: the order comes from a sketch of fixed size (2^20 counters) over all
texts; index entries travel as packed arrays, one blob for each index part and
batch, and the parts grow in number with the input; texts travel, packed, only
for the candidates that a fixed-size Bloom filter of candidate ids lets through
(it saturates at scale and then merely stops saving). All tables between steps
are in spark.checkpoint.dir; those that the result does not read are dropped. The order by
frequency keeps very common keys out of all but short texts' prefixes; those
that are left are dealt, by the sketch's count, into several lists with leaders
of their own, which the second round takes up as one. There a long list is
dealt into blocks, and each two blocks are compared in a group of their own,
but for two of its commonest component: no group is large, but the work grows
with the square of the blocks of other components. So are the texts that one
leader is verified against dealt into groups.

Cases: a null or blank text has no shingles and links with nothing; a text of
fewer than five words is one shingle; rows that share a doc_id are one node; a
row with a null doc_id gets its n_shingles and a null component_id; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .components import connected_components
from .words import mix, opened, shingle_sets, small_batches, squeezed, utf8

WIDTH, NUMERATOR, DENOMINATOR = 5, 75, 100
SKETCH_BITS = 20
SKETCH_ROW = 4096
BLOOM_BITS = 23
HOT_ENTRIES = 2_000_000
BLOCK = 512
FOLLOWERS = 1000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def least_overlap(a, b, num: int = NUMERATOR, den: int = DENOMINATOR):
    """Members that sets of sizes a and b must share at least: ceil(t / (1 + t) * (a + b))."""
    return -((-num * (a + b)) // (den + num))


def prefix_length(n: int, num: int = NUMERATOR, den: int = DENOMINATOR) -> int:
    return n - -(-num * n // den) + 1


def _sketch_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        low = np.uint64((1 << SKETCH_BITS) - 1)
        for batch in batches:
            for piece in small_batches(batch, "text"):
                for s in shingle_sets(utf8(piece["text"]), width):
                    np.add.at(counts, (s & low).astype(np.int64), 1)
        if counts.any():
            yield shared.as_rows(counts, SKETCH_ROW)

    return rows


def shingle_sketch(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """How many (text, shingle) pairs fall on each of 2^20 buckets, over all texts. 4 MB, whatever the input."""
    rows = docs.select("text").mapInArrow(_sketch_rows(width), shared.ARRAY)
    return np.minimum(shared.total_of(rows, 1 << SKETCH_BITS, SKETCH_ROW, "u4", "i8"), (1 << 32) - 1).astype(np.uint32)


def parities(members: np.ndarray) -> bytes:
    """For each of 64 or more buckets whether an odd number of members falls on it: four to eight buckets a member."""
    size = max(64, 1 << (4 * len(members) - 1).bit_length()) if len(members) else 64
    return np.packbits((np.bincount((members & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool), bitorder="little").tobytes()


def _rows_of(parity: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parity), np.uint64).reshape(len(parity), -1)


def _folded(rows: np.ndarray) -> np.ndarray:
    half = rows.shape[1] // 2
    return rows[:, :half] ^ rows[:, half:]


def distance_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the number of members that only one of two sets has."""
    x, y = _rows_of([a]), _rows_of([b])
    while x.shape[1] > y.shape[1]:
        x = _folded(x)
    while y.shape[1] > x.shape[1]:
        y = _folded(y)
    return int(np.bitwise_count(x ^ y).sum())


def _prefix_rows(sketch, width: int, num: int, den: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sketch.value
        low = np.uint64((1 << SKETCH_BITS) - 1)
        for batch in batches:
            for piece in small_batches(batch, "text"):
                n, s1, s2, group, prefixes, bits = [], [], [], [], [], []
                for s in shingle_sets(utf8(piece["text"]), width):
                    n.append(len(s))
                    bits.append(parities(s))
                    if not len(s):
                        s1.append(0), s2.append(0), group.append(0), prefixes.append(b"")
                        continue
                    whole = xxhash.xxh3_128_intdigest(s.tobytes())
                    order = np.lexsort((s, common[(s & low).astype(np.int64)]))
                    prefix = s[order[: prefix_length(len(s), num, den)]].tobytes()
                    s1.append(_signed(whole >> 64)), s2.append(_signed(whole & (1 << 64) - 1))
                    group.append(_signed(xxhash.xxh3_64_intdigest(prefix, len(s)))), prefixes.append(prefix)
                yield pa.RecordBatch.from_arrays(
                    [piece["doc_id"].cast(pa.int64()), pa.array(n, pa.int64()), *(pa.array(x, pa.int64()) for x in (s1, s2, group)), pa.array(prefixes, pa.binary()), pa.array(bits, pa.binary())],
                    ["doc_id", "n_shingles", "s1", "s2", "g", "prefix", "bits"],
                )

    return rows


_ENTRY = ("u8", "i8", "u4", "u2", "u1")  # token, gid, n, at, whether the group has several members


def _salts(tokens: np.ndarray, common: np.ndarray, limit: int) -> np.ndarray:
    """Into how many lists a key is dealt: by what its bucket of the sketch counts beyond twice the mean of all."""
    more = common[(tokens & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(np.int64) - int(2 * common.mean())
    return np.maximum(more, 0) // limit + 1


def _index_rows(parts: int, sketch, limit: int):
    """Index entries of groups (gid, n, prefix, many), packed by part of the index; very common keys have several."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate([np.frombuffer(p, np.uint64) for _, _, p, _ in held])
        lengths = np.array([len(p) // 8 for _, _, p, _ in held])
        gid = np.repeat(np.array([g for g, _, _, _ in held], np.int64), lengths)
        n = np.repeat(np.array([x for _, x, _, _ in held], np.uint32), lengths)
        many = np.repeat(np.array([m for _, _, _, m in held], np.uint8), lengths)
        at = np.minimum(np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths), 65535).astype(np.uint16)
        salt = mix(gid.view(np.uint64)) % _salts(tokens, sketch.value, limit).astype(np.uint64)
        part = (((tokens >> np.uint64(20)) + salt) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        keys, blobs = [], []
        for k in range(parts):
            pick = order[cuts[k] : cuts[k + 1]]
            if len(pick):
                keys.append(k)
                blobs.append(squeezed([tokens[pick], gid[pick], n[pick], at[pick], many[pick]]))
        yield pa.RecordBatch.from_pydict({"part": pa.array(keys, pa.int32()), "entries": pa.array(blobs, pa.binary())})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("gid", "n", "prefix", "many")), strict=True):
                held.append(row)
                size += len(row[2])
                if size > 32 << 20:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return rows


def _first_round(sketch, limit: int, num: int, den: int):
    """From packed entries: pairs of each entry with its leader, and each distinct list that is more than one pair.

    Such are lists of three or more entries, and those of two of which one
    stands for several members.
    The parts of a very common key's list keep the key's own number, so that
    the second round takes them up as one list.
    """

    def led(gids: list[int], sizes: list[int]) -> list[tuple[int, int]]:
        """Each entry with its leader, given entries by size."""
        out, leader, most = [], gids[0], sizes[0]
        for x, m in zip(gids[1:], sizes[1:], strict=True):
            if most * den < num * m:  # too short for this one and all that follow
                leader, most = x, m
            elif x != leader:
                out.append((leader, x))
        return out

    def lists_of(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        token, gid, n, at, many = (np.concatenate(x) for x in zip(*(opened(x, _ENTRY) for x in blobs), strict=True))
        order = np.lexsort((gid, n, token))
        token, gid, n, at, many = token[order], gid[order], n[order], at[order], many[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = token[1:] != token[:-1]
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], len(token))
        hot = _salts(token[starts], sketch.value, limit) > 1
        long_ = (ends - starts >= 2) & ~hot
        pairs, alone, seen = Counter(), Counter(), {}
        for a, b in zip(starts[hot].tolist(), ends[hot].tolist(), strict=True):
            pairs.update(led(gid[a:b].tolist(), n[a:b].tolist()))
            yield _out(list=pa.array(mix(token[a:b]).view(np.int64)), gid=pa.array(gid[a:b]), n=pa.array(n[a:b].astype(np.int64)), at=pa.array(at[a:b].astype(np.int64)))
        for a, b in zip(starts[long_].tolist(), ends[long_].tolist(), strict=True):
            own = led(gid[a:b].tolist(), n[a:b].tolist())
            pairs.update(own)
            if b - a == 2 and not many[a:b].any():
                alone.update(own)
            else:
                key = gid[a:b].tobytes()
                held = seen.get(key)
                seen[key] = (n[a:b], at[a:b] if held is None else np.minimum(held[1], at[a:b]))
        if pairs:
            a, b = zip(*pairs, strict=True)
            yield _out(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()), keys=pa.array(pairs.values(), pa.int64()), alone=pa.array([alone[x] for x in pairs], pa.int64()))
        if seen:
            g = np.frombuffer(b"".join(seen), np.int64)
            k = np.repeat(np.array([_signed(xxhash.xxh3_64_intdigest(x)) for x in seen], np.int64), [len(x) // 8 for x in seen])
            size, place = (np.concatenate([x[i] for x in seen.values()]).astype(np.int64) for i in (0, 1))
            yield _out(list=pa.array(k), gid=pa.array(g), n=pa.array(size), at=pa.array(place))

    return shared.by_part(lambda part, rows: lists_of([x for (x,) in rows]), ("entries",))


_ROUND = ("a", "b", "keys", "alone", "list", "gid", "n", "at")


def _out(**columns: pa.Array) -> pa.RecordBatch:
    length = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(length, pa.int64())) for c in _ROUND], list(_ROUND))


def _across(best: bool, num: int, den: int):
    """Pairs of one list whose components differ and whose sizes, places and parities allow a link.

    With best, only the likeliest pair of each component.
    """

    def pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        rep, n, at, component, block = (np.asarray(table[c].combine_chunks()) for c in ("rep", "n", "at", "component", "block"))
        order = np.lexsort((rep, n))
        rep, n, at, component, block = rep[order], n[order], at[order], component[order], block[order]
        one = (block == block[0]).all()
        bits = table["bits"].take(pa.array(order)).to_pylist()
        width = np.array([len(x) for x in bits])
        last = np.searchsorted(n * num, n * den, side="right")
        for w in np.unique(width).tolist():
            lo, mid, hi = np.searchsorted(width, [w, w + 1, 2 * w + 1]).tolist()
            rows = _rows_of(bits[lo:mid])
            if hi > mid:
                rows = np.concatenate([rows, _folded(_rows_of(bits[mid:hi]))])
            for i in range(lo, mid):
                j = np.arange(i + 1, last[i])
                j = j[component[j] != component[i]]
                if not one:  # two blocks of a long list: those within a block meet elsewhere
                    j = j[block[j] != block[i]]
                if len(j):
                    apart = np.bitwise_count(rows[i - lo] ^ rows[j - lo]).sum(axis=1).astype(np.int64)
                    bound = np.minimum(1 + np.minimum(n[i] - at[i] - 1, n[j] - at[j] - 1), (n[i] + n[j] - apart) // 2)
                    good = (bound >= least_overlap(n[i], n[j], num, den)) & (rep[j] != rep[i])
                    if good.any():
                        j = j[good]
                        yield np.full(len(j), rep[i]), rep[j], np.full(len(j), component[i]), component[j], apart[good] / (n[i] + n[j])

    def run(table: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        made = list(pairs(table))
        if not made:
            return schema.empty_table()
        a, b, c, d, apart = (np.concatenate(x) for x in zip(*made, strict=True))
        if best:
            # the nearest other component of each: a list of m gives m pairs at most
            ends = np.concatenate([c, d])
            order = np.lexsort((np.tile(b, 2), np.tile(a, 2), np.tile(apart, 2), ends))
            first = order[np.append(True, ends[order][1:] != ends[order][:-1])] % len(a)
            a, b = a[first], b[first]
        return pa.table({"a": a, "b": b}, schema=schema)

    return run


def _possible(num: int, den: int):
    """Pairs that the parities of their sets do not rule out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("na", "nb", "bits_a", "bits_b"))
            keep = [(x + y - distance_at_least(p, q)) // 2 >= least_overlap(x, y, num, den) for x, y, p, q in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << BLOOM_BITS, bool)
    for batch in batches:
        seen[_bit(np.asarray(batch["id"]))] = True
    yield shared.as_rows(np.packbits(seen), SKETCH_ROW)


def _passing(bloom):
    """Texts whose ids the filter lets through, packed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, packer = bloom.value, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch["doc_id"].cast(pa.int64())
            keep = pa.array(seen[_bit(np.asarray(ids))])
            texts = [packer.compress(x) for x in utf8(batch["text"].filter(keep))]
            yield pa.RecordBatch.from_arrays([ids.filter(keep), pa.array(texts, pa.binary())], ["doc_id", "packed"])

    return rows


def _verify(width: int, num: int, den: int):
    """Rows come sorted by leader and salt, the leader's own text (b null) first."""

    def similar(x: np.ndarray, s: np.ndarray) -> bool:
        if not len(x) or len(x) * num > den * len(s) or len(s) * num > den * len(x):
            return False
        place = np.searchsorted(x, s)
        place[place == len(x)] = 0
        both = int((x[place] == s).sum())
        return den * both >= num * (len(x) + len(s) - both)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders: list[np.ndarray] = []
        now, opener = None, zstandard.ZstdDecompressor()
        for batch in batches:
            for piece in small_batches(batch, "packed", 4 << 20):
                out_a, out_b = [], []
                sets = shingle_sets([opener.decompress(x) for x in piece["packed"].to_pylist()], width)
                for a, b, salt, s in zip(*(piece[c].to_pylist() for c in ("a", "b", "salt")), sets, strict=True):
                    if (a, salt) != now:
                        now, leaders = (a, salt), []
                    if b is None:
                        leaders.append(s)
                    elif any(similar(x, s) for x in leaders):
                        out_a.append(a)
                        out_b.append(b)
                if out_a:
                    yield pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return rows


def verified(docs: DataFrame, pairs: DataFrame, width: int = WIDTH, num: int = NUMERATOR, den: int = DENOMINATOR, followers: int = FOLLOWERS) -> DataFrame:
    """Those pairs (a, b) of doc_ids whose whole shingle sets are similar enough.

    The texts paired with one a meet it in a group; if there are more than
    followers of them, in several groups, each with a's text. pairs is read
    several times: a written table.
    """
    spark = docs.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    seen = shared.total_of(ids.mapInArrow(_bits, shared.ARRAY), (1 << BLOOM_BITS) // 8, SKETCH_ROW, "u1", "u1", shared.either)
    bloom = spark.sparkContext.broadcast(np.unpackbits(seen).astype(bool))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_passing(bloom), "doc_id long, packed binary")
    # a table of so few rows that Spark, which knows its size, need not shuffle pairs for it
    heavy = pairs.groupBy("a").agg(F.ceil(F.count("*") / followers).cast("int").alias("salts")).where("salts > 1")
    heavy = shared.written(heavy, "heavy")
    salt = F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int")
    wanted = pairs.join(heavy, "a", "left").select("a", salt.alias("salt"), F.col("b").alias("doc_id"))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    leaders = pairs.select("a").distinct().join(heavy, "a", "left").select("a", every.alias("salt"), F.col("a").alias("doc_id"))
    rows = wanted.union(leaders).join(texts, "doc_id").select("a", "salt", F.when(F.col("doc_id") != F.col("a"), F.col("doc_id")).alias("b"), "packed")
    rows = rows.repartition(shared.parts_for(docs), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_verify(width, num, den), "a long, b long").distinct()


def jaccard_components(
    docs: DataFrame, width: int = WIDTH, num: int = NUMERATOR, den: int = DENOMINATOR, hot_entries: int = HOT_ENTRIES, block: int = BLOCK, followers: int = FOLLOWERS
) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_shingles, component_id, set_id (smallest doc_id with an equal set)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    parts, own = shared.parts_for(docs), shared.Tables(spark)
    sketch = spark.sparkContext.broadcast(shingle_sketch(docs, width))
    made = docs.mapInArrow(_prefix_rows(sketch, width, num, den), "doc_id long, n_shingles long, s1 long, s2 long, g long, prefix binary, bits binary")
    kept = shared.written(made, "prefixes")
    full = kept.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = shared.written(full.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("g").alias("g")), "sets")
    groups = sets.groupBy("g", "n").agg(F.min("rep").alias("gid"), F.count("*").alias("size"))
    many = groups.groupBy("gid").agg((F.max("size") > 1).alias("many"))
    indexed = full.select(F.col("doc_id").alias("gid"), F.col("n_shingles").alias("n"), "prefix").join(many, "gid")
    blobs = shared.dealt(indexed.mapInArrow(_index_rows(parts, sketch, hot_entries), "part int, entries binary"), parts)
    found = own.written(blobs.mapInArrow(_first_round(sketch, hot_entries, num, den), ", ".join(f"{c} long" for c in _ROUND)), "lists")
    members = sets.select("rep", "g", "n").join(groups.where("size > 1"), ["g", "n"])
    bits = full.select("doc_id", "n_shingles", "bits")

    def possible(pairs: DataFrame) -> DataFrame:
        sides = [bits.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("bits").alias(f"bits_{k}")) for k in ("a", "b")]
        return pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").mapInArrow(_possible(num, den), "a long, b long").distinct()

    def links_of(pairs: DataFrame) -> DataFrame:
        pairs = own.written(pairs, "pairs")
        links = pairs if pairs.isEmpty() else shared.written(verified(docs, pairs, width, num, den, followers), "links")
        if links is not pairs:
            own.drop(pairs)
        return links

    # each entry with the leader it shares most keys with, each member of a group with its first
    pairs = own.written(found.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("keys").alias("keys"), F.sum("alone").alias("alone")), "leaders")
    first = pairs.groupBy("b").agg(F.max_by("a", F.struct("keys", -F.col("a"))).alias("a")).select("a", "b")
    of_groups = members.where("rep <> gid").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
    links = links_of(possible(first.union(of_groups)))
    nodes = shared.written(connected_components(links), "nodes")

    entries = own.written(_entries(found, members, block), "entries")
    own.drop(found)
    # what lists and groups still hold of different components
    for best in (True, False):
        label = nodes.withColumnRenamed("node", "rep")
        named = entries.join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        one_list = Window.partitionBy("list")
        short = named.where("NOT long").withColumn("c1", F.min("component").over(one_list)).withColumn("c2", F.max("component").over(one_list))
        short = short.where("c1 <> c2").select("list", "rep", "n", "at", "component", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("block"))
        mixed = own.written(short.unionByName(_in_blocks(named.where("long").drop("long"), block)), "mixed")
        with_bits = mixed.join(bits.select(F.col("doc_id").alias("rep"), "bits"), "rep")
        more = with_bits.groupBy("list", "x", "y").applyInArrow(_across(best, num, den), "a long, b long").distinct()
        if best:  # and the lists of two groups of one member each
            twos = pairs.where("alone > 0").select("a", "b").join(first, ["a", "b"], "left_anti")
            for k in ("a", "b"):
                twos = twos.join(nodes.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")), k, "left")
            more = more.union(possible(twos.where("coalesce(ca, a) <> coalesce(cb, b)"))).distinct()
        new = links_of(more)
        own.drop(mixed)
        if not new.isEmpty():
            links = links.union(new)
            nodes = shared.written(connected_components(links), "nodes")

    classes = sets.select("s1", "s2", "rep").join(nodes.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("s1", "s2", "rep", F.coalesce("component", "rep").alias("component"))
    rows = kept.select("doc_id", "n_shingles", "s1", "s2")
    joined = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").join(classes, ["s1", "s2"])
    joined = joined.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("rep").alias("set_id"))
    alone = rows.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("set_id"))
    return joined.union(alone)


def _entries(found: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """list, rep, n, at, long: entries of index lists and of groups, with all members of their groups."""
    lists = found.where("list IS NOT NULL").groupBy("list", "gid").agg(F.min("n").alias("n"), F.min("at").alias("at"))
    lists = lists.join(members.select("gid", "rep"), "gid", "left").select("list", F.coalesce("rep", "gid").alias("rep"), "n", "at")
    grouped = members.where("size > 2").select(F.xxhash64("g", "n", F.lit("group")).alias("list"), "rep", "n", F.lit(0).cast("long").alias("at"))
    rows = shared.written(lists.union(grouped), "list-entries")
    # a table of so few rows that Spark, which knows its size, need not shuffle entries for it
    long_ = shared.written(rows.groupBy("list").agg(F.count("*").alias("c")).where(F.col("c") > block).select("list", F.lit(True).alias("long")), "long-lists")
    return rows.join(long_, "list", "left").withColumn("long", F.coalesce("long", F.lit(False)))


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Entries of long lists (list, rep, n, at, component) in groups (x, y) of at most two blocks, in one of which each two meet.

    Entries of a list's commonest component need not meet each other: they are
    in blocks of their own, and meet the blocks of all others. A list whose
    entries are all of one component is left out.
    """
    each = rows.groupBy("list", "component").agg(F.count("*").alias("c"))
    lists = each.groupBy("list").agg(F.max_by("component", F.struct("c", "component")).alias("major"), F.max("c").alias("m"), (F.sum("c") - F.max("c")).alias("k")).where("k > 0")
    of = lambda c: F.ceil(F.col(c) / block).cast("int")
    lists = shared.written(lists.select("list", "major", of("m").alias("bm"), of("k").alias("bn")), "mixed-lists")
    rows = rows.join(lists, "list").withColumn("is_major", F.col("component") == F.col("major"))
    own = F.when(F.col("is_major"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("bm"))).otherwise(F.col("bm") + F.pmod(F.xxhash64("rep", F.lit(1)), F.col("bn"))).cast("int")
    # blocks are numbered with those of the commonest component first
    others = F.when(F.col("is_major"), F.sequence(F.col("bm"), F.col("bm") + F.col("bn") - 1)).otherwise(F.sequence(F.lit(0), F.col("bm") + F.col("bn") - 1))
    rows = rows.withColumn("block", own).withColumn("other", F.explode(others))
    return rows.select("list", "rep", "n", "at", "component", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of docs for each component, the smallest doc_id's, with all columns; rows without doc_id all stay."""
    keep = jaccard_components(docs, **options).where("component_id = doc_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    one = docs.join(keep, docs["doc_id"] == keep["_kept_id"], "left_semi").dropDuplicates(["doc_id"])
    return one.select(docs.columns).union(docs.where("doc_id IS NULL"))
