"""Near-duplicate documents by SimHash, compared bit-sliced.

A fingerprint is one or more words of 64 bits; two link at no more differing bits than the radius.  Fingerprints meet in
buckets, one for each chosen pair of bit ranges.  With ``EXACT`` (64 bits in 6 ranges, radius 4) two fingerprints within
the radius agree in two ranges at least, so that no link is lost.  With ``WIDE`` (256 bits of five-word shingles, radius
50) the bits estimate similarity: texts whose shingles agree by 0.8 differ in 39 bits on average, with a deviation of 6.
These links are candidates only: near copies are texts whose sets of shingles agree by ``SIMILAR``, which is checked on
the sets before components are formed.  Near copies whose fingerprints don't link are found without loss by their prefixes:
of n shingles in one order for all texts, the first n - ceil(0.8 n) + 1 of two texts that agree by 0.8 have one in common.

A bucket's fingerprints lie in memory as bit planes.  Comparing all members with those some places on is a shift and an
exclusive-or of whole planes; carry-save adders count the differing bits of 64 members per machine word, and words all
of whose counts exceed the radius are abandoned.  Members that are linked already aren't compared again.

Larger buckets than ``TILE`` are split into pairs of tiles, each a group of its own.  A bucket returns a spanning forest
of its links, not its pairs; components are then found by alternating star contractions on Spark tables, cut by
checkpoints.  Copies count once, as the fingerprint is the node.

Defined cases: a null or wordless text has fingerprint 0; rows with equal texts, also repeated doc_ids, share a
component; a component's id is its smallest doc_id that is not null, null if it has none; an empty table gives no row;
very long texts are fingerprinted whole, in blocks of hashes; extra columns pass through ``keep_one`` under any name, and
of rows with equal doc_id and text it keeps one, with the extra columns of any of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import bloom
from ledgerloom.llm.common import BOOL, INT, LONG, durable, free_name, map_batches, map_rows, passing, release_memory, send, shuffle_width, struct, tidy, whole_keys
from ledgerloom.llm.graph import components

TILE, SEED = 2048, 42
#: The least similarity of near copies, as a fraction.
SIMILAR = (4, 5)
#: Bits of a hash by which its commonness is kept: a table of 1 MB.
SLOTS = 20
#: Sets that a task remembers to have given.
RECENT = 1 << 16


@dataclass(frozen=True)
class Setting:
    """width: words of a shingle; words: 64-bit words of a fingerprint; parts: bit ranges; tables: the ranges that form each bucket's key."""

    width: int
    words: int
    radius: int
    parts: int
    tables: tuple[tuple[int, ...], ...]

    @property
    def columns(self) -> list[str]:
        return [f"w{i}" for i in range(self.words)]


EXACT = Setting(4, 1, 4, 6, tuple(combinations(range(6), 2)))
#: Each table's key is 16 bits, two of 32 ranges.  These links are only tried first; what they miss is found by ``_shared``.
WIDE = Setting(5, 4, 50, 32, tuple((i, (i + 5) % 32) for i in range(32)) + tuple((i, i + 16) for i in range(16)))
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Hashes counted at a time.
BLOCK = 1 << 16


def shingle_hashes(text: str, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, in blocks."""
    words = WORDS.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))
    if not words:
        return
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    width = min(width, len(words))
    first, last = starts[: len(words) - width + 1], ends[width - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(first), BLOCK):
        yield np.array([digest(line[a:b], SEED) for a, b in zip(first[k : k + BLOCK].tolist(), last[k : k + BLOCK].tolist(), strict=True)], np.uint64)


def _again(h: np.ndarray, k: int) -> np.ndarray:
    """Further bits of the same shingles: the hashes, mixed for the k-th word of the fingerprint."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def fingerprint(text: str | None, setting: Setting = EXACT) -> tuple[int, ...]:
    """A bit is 1 if set in over half the hashes; signed 64-bit words."""
    return _print(shingle_hashes(text or "", setting.width), setting)


def _print(blocks: Iterable[np.ndarray], setting: Setting) -> tuple[int, ...]:
    ones, n = np.zeros((setting.words, 64), np.int64), 0
    for h in blocks:
        for k in range(setting.words):
            ones[k] += np.unpackbits(_again(h, k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return tuple(np.packbits(ones * 2 > n, axis=1).view(">i8")[:, 0].tolist()) if n else (0,) * setting.words


def fingerprints(docs: DataFrame, keep: list[str], setting: Setting = EXACT) -> DataFrame:
    """The kept columns, the words of the fingerprint and ``fp``, a long that stands for it (the only word, or a hash)."""

    def rows(it):
        for text, *kept in it:
            yield (*kept, *fingerprint(text, setting))

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, LONG) for c in setting.columns])
    return map_rows(docs.select("text", *keep), rows, schema).withColumn("fp", _node(setting.columns))


def _node(columns: list[str]) -> F.Column:
    return F.col(columns[0]) if len(columns) == 1 else F.xxhash64(*columns)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """A row of packed bits for each bit of the fingerprints (members x words); little-endian words of 64 members."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros((n, fps.shape[1]), np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def shifted(planes: np.ndarray, by: int) -> np.ndarray:
    """The planes with member i + by in the place of member i."""
    words, bits = divmod(by, 64)
    out = np.zeros_like(planes)
    n = planes.shape[1] - words
    if n > 0:
        out[:, :n] = planes[:, words:] >> np.uint64(bits)
        if bits and n > 1:
            out[:, : n - 1] |= planes[:, words + 1 :] << np.uint64(64 - bits)
    return out


def close_words(a: np.ndarray, b: np.ndarray, alive: np.ndarray, radius: int, step: int = 8) -> np.ndarray:
    """Bits set where two members, one from each set of planes, differ in at most radius bits.

    alive: bits of the members that count.  The counts are held as carry-save digits, one word of bits for each digit;
    what a count loses past its last digit is remembered as being over."""
    out = np.zeros_like(alive)
    at = np.flatnonzero(alive)
    live, over = alive[at], np.zeros(len(at), np.uint64)
    digits = [np.zeros(len(at), np.uint64) for _ in range(radius.bit_length())]
    for k in range(0, len(a), step):
        for p in range(k, min(k + step, len(a))):
            carry = a[p, at] ^ b[p, at]
            for j, digit in enumerate(digits):
                carry, digits[j] = digit & carry, digit ^ carry
            over |= carry
        over |= _above(digits, radius)
        live = live & ~over
        keep = live != 0
        if not keep.all():
            at, live, over = at[keep], live[keep], over[keep]
            digits = [d[keep] for d in digits]
            if not len(at):
                return out
    out[at] = live
    return out


def _above(digits: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits whose count exceeds the radius."""
    over, equal = np.zeros_like(digits[0]), ~np.zeros_like(digits[0])
    for j in reversed(range(len(digits))):
        if radius >> j & 1:
            equal = equal & digits[j]
        else:
            over = over | (equal & digits[j])
            equal = equal & ~digits[j]
    return over


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def links_of(keys: np.ndarray, fps: np.ndarray, sides: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links, as places of two rows, of fingerprints (rows x words) with equal keys, by which the rows are sorted.  sides 1 and 2 compare only with each other, 0 with all."""
    n, found, forest = len(fps), [], Forest(len(fps))
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, n])
    left = np.repeat(starts + sizes, sizes) - np.arange(n)  # members from here to the end of the bucket
    order = np.argsort(-sizes, kind="stable")  # large buckets first, so that long shifts see few members
    idx = np.concatenate([np.arange(starts[o], starts[o] + sizes[o]) for o in order]) if n else np.zeros(0, np.int64)
    fps, left, sides = fps[idx], left[idx], sides[idx]
    planes, group = planes_of(fps), np.arange(n)
    for shift in range(1, int(sizes.max(initial=0))):
        reach = int(np.searchsorted(-sizes[order], -shift, side="left"))  # buckets longer than the shift
        m = int(sizes[order][:reach].sum())
        a, b = slice(0, m - shift), slice(shift, m)
        # members already in one group need no comparison
        pair = (left[a] > shift) & ((sides[a] != sides[b]) | (sides[b] == 0)) & (group[a] != group[b])
        if not pair.any():
            continue
        w = -(-m // 64)
        alive = np.packbits(np.r_[pair, np.zeros(w * 64 - len(pair), bool)], bitorder="little").view("<u8")
        near = shifted(planes[:, : w + shift // 64 + 2], shift)[:, :w]
        close = close_words(planes[:, :w], near, alive, radius)
        joined = [(i, i + shift) for i in np.flatnonzero(np.unpackbits(close.view(np.uint8), bitorder="little")).tolist() if forest.join(i, i + shift)]
        if joined:
            found += [(int(idx[i]), int(idx[j])) for i, j in joined]
            seen, at = np.unique(group[:m], return_inverse=True)
            group[:m] = np.array([forest.root(i) for i in seen.tolist()])[at]
    return found


def links(fps: DataFrame, setting: Setting = EXACT, tile: int = TILE) -> DataFrame:
    """fps: distinct fingerprints.  Spanning links a, b, as their fp, of those within the radius."""
    columns, bits = setting.columns, 64 * setting.words
    edges = [round(k * bits / setting.parts) for k in range(setting.parts + 1)]

    def part(k: int) -> F.Column:
        word, lo = divmod(edges[k], 64)
        hi = edges[k + 1] - 64 * word
        return F.shiftrightunsigned(F.shiftleft(columns[word], 64 - hi), 64 - hi + lo)

    # the key is a hash: two buckets that share one are compared together, which costs time but no result
    keys = F.array(*(F.xxhash64(F.lit(t), *map(part, ranges)) for t, ranges in enumerate(setting.tables)))
    rows = fps.select(*columns, F.explode(keys).alias("bucket"))
    hot = durable(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > tile))
    cells = rows.withColumns({"cell": F.col("bucket"), "side": F.lit(0)})
    if not hot.isEmpty():
        sent = bloom.build(hot, "bucket")
        # a large bucket becomes tiles i <= j; a member of tile k enters (k, j) and (i, k)
        large = bloom.rows_where(rows, "bucket", sent).join(hot, "bucket", "left").withColumn("tiles", F.ceil(F.coalesce("n", F.lit(1)) / F.lit(tile)).cast("int"))
        own = F.pmod(F.xxhash64(*columns), F.col("tiles")).cast("int")
        tiled = large.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        tiled = tiled.withColumns({"cell": F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")), "side": side})
        cells = bloom.rows_where(rows, "bucket", sent, inside=False).withColumns({"cell": F.col("bucket"), "side": F.lit(0)}).select("cell", "side", *columns).unionByName(tiled.select("cell", "side", *columns))
    ends = [f"{end}{c}" for end in "ab" for c in columns]

    def run(batches):
        for t in whole_keys(batches, ["cell"], 1 << 17):
            fp = np.stack([t[c].to_numpy().view(np.uint64) for c in columns], axis=1)
            found = np.array(links_of(t["cell"].to_numpy(), fp, t["side"].to_numpy(), setting.radius), np.int64).reshape(-1, 2)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(fp[found[:, e], w].view(np.int64)) for e in (0, 1) for w in range(setting.words)], names=ends)

    dealt = cells.select("cell", "side", *columns).repartition(shuffle_width(fps.sparkSession), "cell").sortWithinPartitions("cell")
    found = map_batches(dealt, run, struct(**dict.fromkeys(ends, LONG)))
    return found.select(_node([f"a{c}" for c in columns]).alias("a"), _node([f"b{c}" for c in columns]).alias("b"))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    blocks = list(shingle_hashes(text or "", width))
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def _set_node(h: np.ndarray) -> int:
    """A signed long that stands for a set of shingles, 0 for the empty one."""
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63) if len(h) else 0


def _set_rows(docs: DataFrame, keep: list[str], setting: Setting) -> DataFrame:
    """The kept columns, the fingerprint of the set of shingles with its ``fp``, and ``node``, which stands for the set."""

    def rows(it):
        for text, *kept in it:
            h = shingle_set(text, setting.width)
            yield (*kept, *_print([h[k : k + BLOCK] for k in range(0, len(h), BLOCK)], setting), _set_node(h))

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, LONG) for c in [*setting.columns, "node"]])
    return map_rows(docs.select("text", *keep), rows, schema).withColumn("fp", _node(setting.columns))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _print_pairs(marked: DataFrame, setting: Setting) -> DataFrame:
    """a, b: nodes whose fingerprints link, by spanning links, or are equal."""
    nodes = durable(marked.select("fp", "node").distinct())
    least = durable(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    found = links(marked.select(*setting.columns).distinct(), setting)
    apart = found.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return _ordered(apart.unionByName(nodes.join(least, "fp").select(F.col("least").alias("a"), F.col("node").alias("b"))))


def _texts(hashed: DataFrame, rid: str, marked: DataFrame, pairs: DataFrame) -> DataFrame:
    """node and a text that has its set, of the nodes of the pairs."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    owners = durable(marked.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("rid").alias(rid)))
    texts = bloom.rows_where(hashed.select("text", rid), rid, bloom.build(owners, rid)).join(owners, rid)
    return texts.select("node", "text").dropDuplicates(["node"])


def verified(pairs: DataFrame, hashed: DataFrame, rid: str, marked: DataFrame, width: int) -> DataFrame:
    """The pairs a, b, a checkpoint, whose sets agree by SIMILAR: 5 |A and B| >= 4 |A or B|.

    Only the texts of the pairs meet, and not their shingles' hashes, which take more room."""

    def run(batches):
        of, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            near = []
            for a, s, t in zip(*(batch[c].to_pylist() for c in ("a", "x", "y")), strict=True):
                if a != of:
                    of, x = a, shingle_set(s, width)
                near.append(agree(x, shingle_set(t, width)))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    with passing(_texts(hashed, rid, marked, pairs)) as texts:
        met = pairs.join(texts.toDF("b", "y"), "b").join(texts.toDF("a", "x"), "a").select("a", "b", "x", "y")
        return durable(map_batches(met, run, struct(a=LONG, b=LONG)))


def agree(x: np.ndarray, y: np.ndarray) -> bool:
    common, (up, down) = len(np.intersect1d(x, y, assume_unique=True)), SIMILAR
    return common > 0 and (up + down) * common >= up * (len(x) + len(y))


def _commonness(docs: DataFrame, width: int):
    """A broadcast of fixed size, of two arrays by a hash's first bits: how many digits the count of the hashes has that
    repeat within a batch, and whether that count is more than a quarter of a task's share of all.

    The digits only order the shingles; any order gives the same pairs, one with rare shingles first tries fewer."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(text, width) for text in batch["text"].to_pylist()]
            h, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array((h[n > 1] >> np.uint64(64 - SLOTS)).astype(np.int32)), pa.array(n[n > 1].astype(np.int64))], names=["slot", "n"])

    counts = np.zeros(1 << SLOTS, np.int64)
    counted = map_batches(docs.select("text"), run, struct(slot=INT, n=LONG)).groupBy("slot").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # at most 2**SLOTS rows
    counts[got["slot"].to_numpy()] = got["n"].to_numpy()
    del got
    release_memory()
    spark = docs.sparkSession
    return send(spark, (np.frexp(counts.astype(np.float64))[1].astype(np.uint8), hot_slots(counts, shuffle_width(spark))))


def hot_slots(counts: np.ndarray, tasks: int) -> np.ndarray:
    """At most four slots a task."""
    return 4 * tasks * counts > counts.sum()


def prefix(h: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """The shingles, rarest first, of which two sets that agree by SIMILAR share one: all but what a common part must exceed."""
    up, down = SIMILAR[0], SIMILAR[1]
    order = np.lexsort((h, digits[(h >> np.uint64(64 - SLOTS)).astype(np.int64)]))
    return h[order[: len(h) - -(-up * len(h) // down) + 1]]


def _shared(docs: DataFrame, width: int) -> DataFrame:
    """token, node, n, at: the shingles of each set's prefix that another set's prefix has, the set's size and the shingle's place.

    A task gives a set once among ``RECENT`` different ones, so that copies are few; what is left of them meets in
    ``repeated``.  Shingles of hot slots are dealt out by set instead of meeting in one task, and stay without being asked
    whether others have them."""
    sent, names = _commonness(docs, width), ["token", "node", "n", "at", "hot"]

    def run(batches):
        digits, common = sent.value
        seen: set[int] = set()
        for batch in batches:
            for text in batch["text"].to_pylist():
                h = shingle_set(text, width)
                node = _set_node(h)
                if not len(h) or node in seen:
                    continue
                if len(seen) >= RECENT:
                    seen.clear()
                seen.add(node)
                p = prefix(h, digits)
                hot = common[(p >> np.uint64(64 - SLOTS)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(np.full(len(p), node)), pa.array(np.full(len(p), len(h), np.int32)), pa.array(np.arange(len(p), dtype=np.int32)), pa.array(hot)], names=names)

    rows = map_batches(docs.select("text"), run, struct(token=LONG, node=LONG, n=INT, at=INT, hot=BOOL))
    dealt = rows.repartition(shuffle_width(docs.sparkSession), F.when(F.col("hot"), F.col("node")).otherwise(F.col("token"))).sortWithinPartitions("hot", "token", "node")
    return map_batches(dealt, repeated, rows.schema).drop("hot")


def repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hot, token and node, one each, those that are hot or whose token another node has too; one row is held from batch to batch.

    A token is hot in all rows or in none."""
    held: tuple[pa.RecordBatch, bool] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([held[0], batch] if held else [batch])
        again = [np.r_[False, c[1:] == c[:-1]] for c in (rows[k].to_numpy() for k in ("token", "node"))]
        rows = rows.filter(pa.array(~(again[0] & again[1]))).combine_chunks()
        # the last row waits for the next; a row held knows whether the one before it was like it
        token, hot = rows["token"].to_numpy(), rows["hot"].to_numpy()
        same = token[1:] == token[:-1]
        keep = np.r_[held[1] if held else False, same] | np.r_[same, False] | hot
        yield from rows.slice(0, rows.num_rows - 1).filter(pa.array(keep[:-1])).to_batches()
        held = rows.slice(rows.num_rows - 1).combine_chunks().to_batches()[0], bool(keep[-1])
    if held and held[1]:
        yield held[0]


def _may_agree(x: str, y: str) -> F.Column:
    """Whether the sizes, and the rest of both sets from the first shingle they share, leave room to agree by SIMILAR."""
    up, down = SIMILAR
    n, m = F.col(f"{x}.n").cast("long"), F.col(f"{y}.n").cast("long")
    rest = F.least(n - F.col(f"{x}.at"), m - F.col(f"{y}.at"))
    return (F.least(n, m) * down >= F.greatest(n, m) * up) & (rest * (up + down) >= (n + m) * up)


def near_sets(hashed: DataFrame, rid: str, marked: DataFrame, setting: Setting) -> DataFrame:
    """node, root: components of the sets of shingles, linked where two sets agree by SIMILAR.

    First the links of fingerprints are tried, which join most of a class.  Then, without loss, all pairs of sets of different
    components that share a shingle of their prefixes: of each shingle first one set of each component with one other,
    so that a large class that is in parts is whole before all pairs are tried."""
    tried = durable(_print_pairs(marked, setting))
    shared = durable(_shared(hashed, setting.width))
    near = verified(tried, hashed, rid, marked, setting.width)
    for every in (False, True):
        linked = components(near)
        rooted = shared.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
        rooted = durable(rooted.join(split, "token", "left_semi"))
        if rooted.isEmpty():
            return linked
        left = rooted
        if not every:
            ends = F.min(F.struct("node", "n", "at", "root")).alias("s")
            rooted = rooted.groupBy("token", "root").agg(ends).select("token", "s.node", "s.n", "s.at", "s.root")
            left = rooted.groupBy("token").agg(ends).select("token", "s.*")
        x, y = left.alias("x"), rooted.alias("y")
        apart = F.col("x.root") < F.col("y.root") if every else F.col("x.root") != F.col("y.root")
        met = x.join(y, (F.col("x.token") == F.col("y.token")) & apart & _may_agree("x", "y"))
        fresh = durable(_ordered(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))).join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(fresh)
        near = near.unionByName(verified(fresh, hashed, rid, marked, setting.width))
    return components(near)


def keep_one(docs: DataFrame, setting: Setting = WIDE) -> DataFrame:
    """One row of each class: that of least doc_id, of several such rows any one; a class without doc_ids keeps one row too.

    Decisions are made on hashes of doc_id and text; rows that stay for certain, being in no Bloom filter of the others,
    are passed on where they lie."""
    tidy(docs.sparkSession)
    rid = free_name("row_hash", docs.columns)
    hashed = docs.withColumn(rid, F.xxhash64("doc_id", "text"))
    marked = durable(_set_rows(hashed, ["doc_id", rid], setting).withColumnRenamed(rid, "rid"))
    per_row = marked.groupBy("node", "doc_id", "rid").agg(F.count("*").alias("n"))
    linked = near_sets(hashed, rid, marked, setting)
    # each set's first row, then each class's; nulls last
    order = lambda node: F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *node, "rid")
    first = marked.groupBy("node").agg(F.min(order([])).alias("f")).select("node", "f.*")
    rooted = first.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = durable(rooted.groupBy("root").agg(F.min(order(["node"])).alias("f")).select(F.col("f.node").alias("node"), F.col("f.rid").alias("kept")))
    # rid -> whether it goes, for those that go or occur more than once
    told = durable(per_row).join(kept, "node", "left").select("rid", "n", (~F.coalesce(F.col("rid") == F.col("kept"), F.lit(False))).alias("goes"))
    touched = durable(told.where(F.col("goes") | (F.col("n") > 1)).select(F.col("rid").alias(rid), F.col("goes").alias(free_name("row_goes", docs.columns))))
    sent = bloom.build(touched, rid)
    goes = touched.columns[1]
    maybe = bloom.rows_where(hashed, rid, sent).join(touched, rid, "left")
    once = maybe.where(F.col(goes).isNull()).drop(goes).unionByName(maybe.where(~F.col(goes)).drop(goes).dropDuplicates([rid]))
    return bloom.rows_where(hashed, rid, sent, inside=False).unionByName(once).drop(rid)


def op8_simhash(docs: DataFrame) -> DataFrame:
    marked = durable(fingerprints(docs, ["doc_id"]))
    linked = components(links(marked.select(*EXACT.columns).distinct()))
    # per fingerprint first, so that a hot one is one row before it meets its class
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = durable(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = durable(rooted.join(classes, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
