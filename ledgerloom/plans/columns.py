"""What whole columns tell: the values that columns of two sources share, and the keys of several columns.

All rows count; sketches keep what is gathered small.  A table's sketches are built in one pass and merged in two steps,
so that no task merges those of all others.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import field_name
from ledgerloom.session import durable

#: Values a sketch of shared values keeps (as a power of two), the least of them that must be left to tell a share, registers of a sketch of counts.
VALUES, LEAST_KEPT, REGISTERS = 12, 256, 12
#: Groups of the first merge, and sketches of one pass.
FOLD, AT_ONCE = 64, 128
#: A sketched count may be less than the true one by this share (six standard errors).
SLACK = 0.1


def _sketches(df: DataFrame, columns: list[Column], make, merge) -> DataFrame:
    """place, sketch of each column."""
    held = df.select(F.pmod(F.spark_partition_id(), F.lit(FOLD)).alias("fold"), *(c.alias(f"c{i}") for i, c in enumerate(columns)))
    folded = held.groupBy("fold").agg(*(make(f"c{i}").alias(f"s{i}") for i in range(len(columns))))
    each = folded.select(F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.col(f"s{i}").alias("sketch")) for i in range(len(columns))))).alias("s"))
    return each.groupBy("s.place").agg(merge("s.sketch").alias("sketch"))


def _text(column: str) -> Column:
    return F.nullif(F.col(f"`{column}`").cast("string"), F.lit(""))


def _value_sketches(df: DataFrame) -> DataFrame:
    return _sketches(df, [_text(c) for c in df.columns], lambda c: F.theta_sketch_agg(c, VALUES), lambda s: F.theta_union_agg(s, VALUES))


def _distinct_texts(df: DataFrame, places: list[int]) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(i).alias("place"), _text(df.columns[i]).alias("text")) for i in places))
    return df.select(F.explode(cells).alias("c")).select("c.*").where("text IS NOT NULL").distinct()


def shared_values(left: DataFrame, right: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """i, j, overlap of pairs of column places: the share of the left column's distinct texts that the right one has.

    Sketched, and exact up to 2**VALUES texts; where the left column's texts are so few beside the right one's that under
    ``LEAST_KEPT`` of them are in the sketch, they are counted.  The error is then at most 0.03 (one standard error)."""
    spark = left.sparkSession
    if not pairs:
        return spark.createDataFrame([], "i int, j int, overlap double")
    asked = spark.createDataFrame(pairs, "i int, j int")
    l, r = (_value_sketches(df).select(F.col("place").alias(k), F.col("sketch").alias(s)) for df, k, s in ((left, "i", "a"), (right, "j", "b")))  # noqa: E741
    size = lambda c: F.theta_sketch_estimate(c)
    # a row for each pair of columns: no more than the schemas allow
    told = asked.join(l, "i").join(r, "j").select("i", "j", size("a").alias("n"), size("b").alias("m"), size(F.theta_intersection("a", "b")).alias("both")).collect()
    kept = 1 << VALUES
    thin = [(t.i, t.j) for t in told if t.n and max(t.n, t.m) > kept and kept * t.n < LEAST_KEPT * max(t.n, t.m)]
    sketched = spark.createDataFrame([(t.i, t.j, min(1.0, t.both / t.n) if t.n else 0.0) for t in told if (t.i, t.j) not in set(thin)], "i int, j int, overlap double")
    if not thin:
        return sketched
    a, b = (_distinct_texts(df, sorted({p[side] for p in thin})).withColumnRenamed("place", k) for side, df, k in ((0, left, "i"), (1, right, "j")))
    sizes, both = a.groupBy("i").agg(F.count("*").alias("n")), a.join(b, "text").groupBy("i", "j").agg(F.count("*").alias("both"))
    counted = spark.createDataFrame(thin, "i int, j int").join(sizes, "i").join(both, ["i", "j"], "left")
    return sketched.unionByName(counted.select("i", "j", F.coalesce(F.col("both") / F.col("n"), F.lit(0.0)).alias("overlap")))


def field_mapping(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """left_col, right_col, score: one-to-one, by likeness of names (0.4), equal types (0.2) and shared values of all rows (0.4).

    Values are compared only where names and types leave a pair a chance.  Of equal scores the pair whose names sort first
    stays; an empty column shares nothing."""
    spark = left.sparkSession
    a, b = field_name(F.col("left_col")), field_name(F.col("right_col"))
    likeness = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    every = [(i, j, x, y, tx == ty) for i, (x, tx) in enumerate(left.dtypes) for j, (y, ty) in enumerate(right.dtypes)]
    named = spark.createDataFrame(every, "i int, j int, left_col string, right_col string, same_type boolean").withColumn("prior", 0.4 * likeness + 0.2 * F.col("same_type").cast("double"))
    may = named.where(F.col("prior") + 0.4 > least)
    overlap = shared_values(left, right, [(r.i, r.j) for r in may.select("i", "j").collect()])
    scored = may.join(overlap, ["i", "j"]).select("left_col", "right_col", (F.col("prior") + 0.4 * F.col("overlap")).alias("score")).where(F.col("score") > least)
    best = lambda k, other: F.row_number().over(Window.partitionBy(k).orderBy(F.desc("score"), other))
    return scored.withColumns({"p": best("left_col", "right_col"), "q": best("right_col", "left_col")}).where("p = 1 AND q = 1").drop("p", "q")


def find_keys(df: DataFrame, columns: list[str] | None = None, most: int = 3) -> DataFrame:
    """key (array of columns), rows: all least sets of at most ``most`` columns that no two rows share and that are never null.

    Level by level: a set that holds a key is none; one whose parts' distinct counts can't multiply to the rows is left out;
    the rest are sketched in passes of ``AT_ONCE``, and those that come near the rows are checked exactly.  A check keeps the rows
    that repeat, and a larger set is checked on those of its part alone.  A table without rows has no key."""
    names = columns or [c for c, t in df.dtypes if "map<" not in t and t != "variant"]
    held = df.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)))
    total, *filled = held.agg(F.count("*"), *(F.count(c) for c in held.columns)).first()
    narrow = held.select(*(c for c, n in zip(held.columns, filled, strict=True) if n == total)) if total else held.select()
    least = total * (1 - SLACK)
    counts: dict[frozenset, float] = {}
    repeats: dict[frozenset, DataFrame] = {}
    keys: list[tuple[str, ...]] = []
    for size in range(1, most + 1):
        sets = [s for s in combinations(narrow.columns, size) if not any(set(k) <= set(s) for k in keys)]
        unknown = []
        for s in map(frozenset, sets):
            parts = [s - {c} for c in s] if size > 1 else []
            counts[s] = min((counts[p] * max(1.0, counts[s - p]) for p in parts), default=float("inf"))
            if counts[s] >= least and not any(p in repeats for p in parts):
                unknown.append(s)
        for i in range(0, len(unknown), AT_ONCE):
            some = unknown[i : i + AT_ONCE]
            made = _sketches(narrow, [F.xxhash64(*sorted(s)) for s in some], lambda c: F.hll_sketch_agg(c, F.lit(REGISTERS)), F.hll_union_agg)
            for r in made.select("place", F.hll_sketch_estimate("sketch").alias("n")).collect():
                counts[some[r.place]] = float(r.n)
        for s in (s for s in sets if counts[frozenset(s)] >= least):
            own = frozenset(s)
            base = next((repeats[own - {c}] for c in s if own - {c} in repeats), narrow)
            twice = base.groupBy(*s).agg(F.count("*").alias("n")).where("n > 1").drop("n")
            again = durable(base.join(twice, list(s), "left_semi").select(*narrow.columns))
            if again.isEmpty():
                keys.append(s)
            else:
                repeats[own] = again
    return df.sparkSession.createDataFrame([([names[int(c[1:])] for c in k], total) for k in keys], "key array<string>, rows long")
