"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become ids (byte-level BPE and an end mark); those longer than a sequence are cut into pieces.  Whole-length
pieces fill a sequence each.  The others are dealt evenly over islands of at most ``ISLAND`` pieces, and every island
evolves a population of packings in its own Spark group: a child takes over whole well-filled bins of one parent, drops
the other parent's bins that hold the same pieces, and best-fits what this displaces, after pieces of bins with room
were exchanged for displaced ones that fill them.  The first packings are best fit in falling order and bins filled to
the last token by one, two or three pieces where such exist.  An island whose packing reaches the bound, its tokens
divided by the capacity, is done.  Between epochs the best-filled
bins of an island migrate to the next one as patterns of lengths, since islands hold different documents; there they
are rebuilt from local pieces and injected in the same way.  Last, every island gives its ``RELEASED`` worst-filled
bins away; they are packed anew on fewer islands, level by level, until one island holds the rest.

A group never holds more than a constant number of pieces and no piece is dropped.  Only lengths and keys are shuffled,
never ids.  Defined cases: a null text counts as empty and is the end mark alone; repeated rows and ties are packed one
by one; a very long text is cut into as many pieces as it needs; an empty table gives no row; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import base64
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import INT, LONG, durable, map_rows, send, struct

CAPACITY, END, ISLAND, EPOCHS, RELEASED, ELITE = 1024, 2, 16384, 2, 256, 32
POPULATION, GENERATIONS = 8, 24
#: How often first packings begin a bin with a piece of any length.
WILD = (0.1, 0.25, 0.5)
#: Characters on whose classes all Unicode versions agree, none of them white space beyond ASCII.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-ɏ]*")
_loaded: dict[int, tuple] = {}


def byte_bpe(json: bytes, ranks: bytes, pattern: str):
    """A function from text to uint32 ids, equal to the tokenizers library on the same vocabulary.

    The rank form of the vocabulary is several times faster on plain text; special strings and rarer characters take
    the tokenizers library itself."""
    key = zlib.crc32(json)
    if key not in _loaded:
        import tiktoken
        from tokenizers import Tokenizer

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _loaded[key] = Tokenizer.from_str(json.decode()), tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    whole, fast = _loaded[key]

    def ids(text: str) -> np.ndarray:
        if "<|" not in text and PLAIN.fullmatch(text):
            return fast.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    return ids


def vocabulary(spark: SparkSession, json_path: str, ranks_path: str | None = None):
    """The vocabulary's files as a broadcast; their size is fixed (a few MB)."""
    return send(spark, tuple(open(p, "rb").read() if p else b"" for p in (json_path, ranks_path)))


PIECE = struct(piece=INT, start=LONG, length=LONG, ids_crc32=LONG)


def cut(docs: DataFrame, vocab, pattern: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id and PIECE."""

    def rows(it):
        ids = byte_bpe(*vocab.value, pattern)
        tail = np.array([end], np.uint32)
        for doc_id, text in it:
            got = np.concatenate([ids(text or ""), tail]).astype("<u4")
            first = len(got) % capacity or capacity
            edges = [0, *range(first, len(got) + 1, capacity)]
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                yield doc_id, k, a, b - a, zlib.crc32(got[a:b].tobytes())

    return map_rows(docs.select("doc_id", "text"), rows, T.StructType([docs.schema["doc_id"], *PIECE.fields]))


class Bins:
    """A packing: lists of piece numbers, their fills, and the open bins by free room with a bit mask of the rooms in use."""

    def __init__(self, lengths: list[int], capacity: int, bins=()):
        self.lengths, self.capacity = lengths, capacity
        self.bins = [list(b) for b in bins]
        self.fill = [sum(lengths[i] for i in b) for b in self.bins]
        self.rooms: dict[int, list[int]] = {}
        self.mask = 0
        for b, f in enumerate(self.fill):
            self._open(b, capacity - f)

    def _open(self, b: int, room: int) -> None:
        if room:
            self.rooms.setdefault(room, []).append(b)
            self.mask |= 1 << room

    def best_fit(self, pieces) -> None:
        """Longest first, each into the fullest bin with room."""
        for i in sorted(pieces, key=lambda i: -self.lengths[i]):
            n = self.lengths[i]
            fitting = self.mask >> n
            if fitting:
                room = n + (fitting & -fitting).bit_length() - 1
                b = self.rooms[room].pop()
                if not self.rooms[room]:
                    del self.rooms[room]
                    self.mask &= ~(1 << room)
                self.bins[b].append(i)
                self.fill[b] += n
            else:
                b = len(self.bins)
                self.bins.append([i])
                self.fill.append(n)
            self._open(b, self.capacity - self.fill[b])

    def fitness(self) -> tuple[int, float]:
        return -len(self.bins), sum(f * f for f in self.fill)


class Stock:
    """Pieces by length, with the lengths in stock as bits of a number, from below and from the capacity downwards."""

    def __init__(self, lengths: list[int], pieces, capacity: int):
        self.capacity, self.own = capacity, {}
        for i in pieces:
            self.own.setdefault(lengths[i], []).append(i)
        self.up = sum(1 << n for n in self.own)
        self.down = sum(1 << capacity - n for n in self.own)

    def take(self, n: int) -> int:
        own = self.own[n]
        i = own.pop()
        if not own:
            del self.own[n]
            self.up ^= 1 << n
            self.down ^= 1 << self.capacity - n
        return i

    def put(self, n: int, i: int) -> None:
        if n not in self.own:
            self.own[n] = []
            self.up |= 1 << n
            self.down |= 1 << self.capacity - n
        self.own[n].append(i)

    def pair(self, room: int) -> int:
        """The lesser of the two most equal lengths in stock that add up to room, or 0."""
        both = self.up & (1 << room) - 1 & self.down >> self.capacity - room
        if room % 2 == 0 and both >> room // 2 & 1 and len(self.own[room // 2]) < 2:
            both ^= 1 << room // 2
        both &= (2 << room // 2) - 1
        return both.bit_length() - 1 if both else 0

    def filling(self, room: int, tries: int) -> list[int]:
        """Lengths of one to three pieces that fill the room, or else the longest that fits, if any."""
        low = self.up & (2 << room) - 1
        if not low:
            return []
        longest = low.bit_length() - 1
        if longest == room:
            return [room]
        if b := self.pair(room):
            return [b, room - b]
        for _ in range(tries):
            if not low:
                break
            a = low.bit_length() - 1
            low ^= 1 << a
            if (b := self.pair(room - a)) and len(self.own[a]) >= 1 + (b == a) + (room - a - b == a):
                return [a, b, room - a - b]
        return [longest]


def filled(lengths: list[int], pieces, capacity: int, rng: random.Random | None = None, wild: float = 0.0, tries: int = 64) -> list[list[int]]:
    """Bins, each begun by the longest piece left, or by one of any length as often as wild says, and filled to the last token where that can be."""
    stock, bins = Stock(lengths, pieces, capacity), []
    while stock.own:
        n = rng.choice(list(stock.own)) if wild and rng.random() < wild else stock.up.bit_length() - 1
        bins.append([stock.take(n)])
        room = capacity - n
        while room and (more := stock.filling(room, tries)):
            bins[-1] += [stock.take(k) for k in more]
            room -= sum(more)
    return bins


def crossover(into: Bins, injected: list[list[int]]) -> Bins:
    """The injected bins stay whole; bins of the other parent that share a piece with them go, and what they alone held is best-fitted."""
    taken = {i for b in injected for i in b}
    kept, displaced = list(injected), []
    for b in into.bins:
        if taken.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in taken]
    stock = exchange(kept, len(injected), Stock(into.lengths, displaced, into.capacity), into)
    child = Bins(into.lengths, into.capacity, kept)
    child.best_fit([i for own in stock.own.values() for i in own])
    return child


def exchange(bins: list[list[int]], start: int, stock: Stock, of: Bins) -> Stock:
    """Gives bins with room, from a place on, a displaced piece for one of theirs that is as much shorter as fills them, or is shorter at all."""
    for k in range(start, len(bins)):
        room = of.capacity - sum(of.lengths[i] for i in bins[k])
        if not room or not stock.own:
            continue
        best = None
        for place, i in enumerate(bins[k]):
            n = of.lengths[i]
            fits = (stock.up & (2 << n + room) - 1).bit_length() - 1
            if fits > n and (best is None or fits - n > best[0]):
                best = fits - n, place, fits
        if best:
            bins[k] = list(bins[k])
            i, bins[k][best[1]] = bins[k][best[1]], stock.take(best[2])
            stock.put(of.lengths[i], i)
    return stock


def immigrants(lengths: list[int], patterns: list[list[int]]) -> list[list[int]]:
    """Bins with the given lengths, built from local pieces, each piece used once."""
    stock: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        stock.setdefault(n, []).append(i)
    built = []
    for pattern in patterns:
        need = {n: pattern.count(n) for n in pattern}
        if all(len(stock.get(n, ())) >= k for n, k in need.items()):
            built.append([stock[n].pop() for n in pattern])
    return built


def evolve(lengths: list[int], capacity: int, seed: int, known: list[list[int]], patterns: list[list[int]], population: int = POPULATION, generations: int = GENERATIONS) -> Bins:
    """The best packing of one island after an epoch; known is its packing so far, if any."""
    rng, everyone = random.Random(seed), []
    bound = -(-sum(lengths) // capacity)
    everyone.append(Bins(lengths, capacity, known or filled(lengths, range(len(lengths)), capacity)))
    if len(everyone[0].bins) > bound:
        everyone.append(Bins(lengths, capacity))
        everyone[1].best_fit(range(len(lengths)))
    if known and patterns and (new := immigrants(lengths, patterns)):
        everyone.append(crossover(everyone[0], new))
    while len(everyone) < population and max(map(Bins.fitness, everyone))[0] < -bound:
        if len(everyone) % 4:
            everyone.append(Bins(lengths, capacity, filled(lengths, range(len(lengths)), capacity, rng, WILD[len(everyone) % 4 - 1])))
            continue
        other = Bins(lengths, capacity)
        early = set(rng.sample(range(len(lengths)), len(lengths) // 8))
        other.best_fit(early)
        other.best_fit(set(range(len(lengths))) - early)
        everyone.append(other)
    for _ in range(generations):
        everyone.sort(key=Bins.fitness, reverse=True)
        if len(everyone[0].bins) <= bound or len(everyone) < 2:
            break
        mother, father = everyone[0], everyone[rng.randrange(1, len(everyone))]
        if rng.random() < 0.5:
            mother, father = father, mother
        full = sorted(range(len(father.bins)), key=lambda b: -father.fill[b])[: max(1, len(father.bins) // 2)]
        child = crossover(mother, [father.bins[b] for b in rng.sample(full, max(1, len(full) // 2))])
        if child.fitness() > everyone[-1].fitness():
            everyone[-1] = child
    return max(everyone, key=Bins.fitness)


def _epoch(state: DataFrame, elite: DataFrame | None, capacity: int, seed: int) -> DataFrame:
    """state: piece rows with island, bin (null at first).  The same rows with new bins."""
    place = state.columns.index("bin")

    def run(key: tuple, left: pa.Table, right: pa.Table | None) -> pa.Table:
        left = left.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        known: dict[int, list[int]] = {}
        for i, b in enumerate(left["bin"].to_pylist()):
            if b is not None:
                known.setdefault(b, []).append(i)
        patterns = sorted(right["pattern"].to_pylist()) if right is not None else []
        packed = evolve(left["length"].to_pylist(), capacity, seed * 1_000_003 + key[0].as_py(), [known[b] for b in sorted(known)], patterns)
        where = np.zeros(left.num_rows, np.int64)
        for b, members in enumerate(packed.bins):
            where[members] = b
        return left.set_column(place, "bin", pa.array(where))

    if elite is None:
        return state.groupBy("island").applyInArrow(lambda key, left: run(key, left, None), state.schema)
    # an island without immigrants still runs; one without pieces can't occur, as elites go to islands that exist
    return state.groupBy("island").cogroup(elite.groupBy("island")).applyInArrow(run, state.schema)


def _elite(state: DataFrame, islands: int) -> DataFrame:
    """The ELITE best-filled bins of each island as patterns of lengths, bound for the next island."""
    bins = state.groupBy("island", "bin").agg(F.sum("length").alias("fill"), F.sort_array(F.collect_list("length")).alias("pattern"))
    ranked = bins.withColumn("rank", F.row_number().over(Window.partitionBy("island").orderBy(F.desc("fill"), "pattern", "bin")))
    return ranked.where(F.col("rank") <= ELITE).select(F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "pattern")


def pack(pieces: DataFrame, capacity: int = CAPACITY, island: int = ISLAND, epochs: int = EPOCHS) -> DataFrame:
    """pieces: doc_id and PIECE with lengths of 1 to capacity.  Adds sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = durable(pieces)
    whole = pieces.where(F.col("length") >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, settled, level = pieces.where(F.col("length") < capacity), [], 0
    while True:
        count = rest.count()
        islands = max(1, -(-count // island))
        state = rest.repartition(islands).select("*", F.spark_partition_id().alias("island"), F.lit(None).cast("long").alias("bin"))
        state = durable(_epoch(state, None, capacity, level))
        for epoch in range(1, epochs):
            if islands > 1:
                state = durable(_epoch(state, _elite(state, islands), capacity, 100 * level + epoch))
        placed = (F.lit(level << 56) + F.col("island").cast("long") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id")
        if islands == 1:
            settled.append(state.select(*pieces.columns, placed))
            break
        fill = state.groupBy("island", "bin").agg(F.sum("length").alias("fill"), F.count("*").alias("n"))
        # of equally filled bins those of many pieces, which fit in more ways
        rank = F.row_number().over(Window.partitionBy("island").orderBy("fill", F.desc("n"), "bin"))
        worst = fill.withColumn("rank", rank).where(F.col("rank") <= RELEASED).select("island", "bin", F.lit(True).alias("worst"))
        state = state.join(worst, ["island", "bin"], "left")
        settled.append(state.where(F.col("worst").isNull()).select(*pieces.columns, placed))
        # a piece of a released bin moves on; the count shrinks at each level, so the loop ends
        rest, level = durable(state.where("worst").select(*pieces.columns)), level + 1
        if -(-rest.count() // island) >= islands:
            island *= 2
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    w = Window.partitionBy("sequence_id").orderBy("doc_id", "piece", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long"))
    return out.unionByName(whole.select(*out.columns))


def op1_pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str) -> DataFrame:
    return pack(cut(docs, vocabulary(docs.sparkSession, json_path, ranks_path), pattern))
