"""Language identification: known words first, then ever shorter character n-grams.

The model is fitted with Spark aggregates on a bounded sample of labelled rows: at most ``SAMPLE`` documents of at most
``LONGEST_TEXT`` characters, of each language as many, or all it has, and those of least hash.  A word seen ``KNOWN`` times or more is scored by its log frequency in each language; any other word by the
mean log frequency of its n-grams of the greatest length, ``LONGEST`` downwards, of which at least one was seen that often.  The
scores of a text's words add up; the softmax of the sums gives the language and the score.  The tables of the fitted
model are bounded by the sample and go to the tasks as a broadcast; prediction is one pass without a shuffle.

Defined cases: a null text, or one without a letter, gives ``und`` with score 0; a text of which nothing is known gives
the first language with an even score; ties go to the language that sorts first; a null doc_id is never learnt from and
not held out; without any labelled row, as in an empty table, every prediction is ``und``; repeated rows count as often as they
occur, within the bound; very long texts are predicted whole; kept columns may have any name but those of the prediction.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import DBL, STR, durable, map_rows, release_memory, send

SAMPLE, LONGEST_TEXT, KNOWN, LONGEST, FOLDS, MEMO = 4000, 200_000, 2, 5, 5, 1 << 17
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Up to so many languages their bounds are broadcast, a row each.
BROADCAST_LANGS = 10_000


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def sample_of(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """lang, text of the labelled documents of least hash of each language.

    Counts of the hashes' first 16 bits tell below which of them each language has enough, so that only about the
    sample's rows are sorted, first those of a task and then those of a language, whatever the number of languages."""
    may = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & (F.length("text") <= LONGEST_TEXT))
    may = may.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    slot = F.shiftright("h", 48)
    slots = durable(may.groupBy("lang", slot.alias("slot")).agg(F.count("*").alias("n")))
    langs = slots.select("lang").distinct().count()
    each = max(1, size // max(1, langs))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # first of the 256 ranges of slots, then of the slots of one range
    ranges = slots.groupBy("lang", F.shiftright("slot", 8).alias("slot")).agg(F.sum("n").alias("n")).withColumn("before", before).where(F.col("before") < each)
    ranges = ranges.groupBy("lang").agg(F.max(F.struct("slot", "before")).alias("r")).select("lang", F.col("r.slot").alias("range"), F.col("r.before").alias("below"))
    inside = slots.join(ranges, "lang").where(F.shiftright("slot", 8) == F.col("range"))
    last = inside.withColumn("before", before).where(F.col("before") + F.col("below") < each).groupBy("lang").agg(F.max("slot").alias("last"))
    near = may.join(F.broadcast(last) if langs <= BROADCAST_LANGS else last, "lang").where(slot <= F.col("last")).withColumn("task", F.spark_partition_id())
    for group in (["lang", "task"], ["lang"]):
        near = near.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy("h"))).where(F.col("n") <= each)
    return near.select("lang", "text")


def count_tables(sample: DataFrame, known: int = KNOWN, longest: int = LONGEST) -> DataFrame:
    """n (0 for a word), gram, lang, count."""
    words = sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("gram")).where("gram <> ''").groupBy("lang", "gram").agg(F.count("*").alias("count"))
    words = durable(words)
    seen = words.groupBy("gram").agg(F.sum("count").alias("total")).where(F.col("total") >= known)
    edged, size = F.concat(F.lit("<"), "gram", F.lit(">")), F.length("gram") + 2
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), size))
    grams = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.struct(n.alias("n"), F.substring(edged, i, n).alias("gram")))))
    parts = words.select("lang", "count", F.explode(grams).alias("g")).groupBy("g.n", "g.gram", "lang").agg(F.sum("count").alias("count")).where(F.col("count") >= known)
    return words.join(seen, "gram", "left_semi").select(F.lit(0).alias("n"), "gram", "lang", "count").unionByName(parts)


class Model:
    """Log frequencies: for each n a dictionary from gram to row of a table with a column for each language."""

    def __init__(self, counts):
        self.langs = sorted(set(counts["lang"].to_pylist()))
        place = {x: i for i, x in enumerate(self.langs)}
        self.index: dict[int, dict[str, int]] = {}
        self.table: dict[int, np.ndarray] = {}
        for n in sorted(set(counts["n"].to_pylist())):
            own = counts.filter(pc.equal(counts["n"], n))
            index: dict[str, int] = {}
            rows = [index.setdefault(g, len(index)) for g in own["gram"].to_pylist()]
            self.index[n] = index
            table = np.full((len(index), len(self.langs)), 0.5)
            np.add.at(table, (rows, [place[x] for x in own["lang"].to_pylist()]), own["count"].to_numpy())
            self.table[n] = np.log(table / table.sum(axis=0))

    def unseen(self, word: str) -> np.ndarray:
        edged = f"<{word}>"
        for n in range(min(LONGEST, len(edged)), 0, -1):
            index = self.index.get(n, {})
            rows = [i for i in (index.get(edged[k : k + n]) for k in range(len(edged) - n + 1)) if i is not None]
            if rows:
                return self.table[n][rows].mean(axis=0)
        return np.zeros(len(self.langs))

    def predictor(self):
        """text -> (language, score).  What unseen words score is remembered for up to MEMO words, then forgotten."""
        known, table = self.index.get(0, {}), self.table.get(0)
        memo: dict[str, int] = {}
        scores = np.zeros((MEMO, len(self.langs)))

        def predict(text: str | None) -> tuple[str, float]:
            words = WORD.findall((text or "").lower())
            if not self.langs or not any(c.isalpha() for w in words for c in w):
                return UNKNOWN, 0.0
            total, rows, others = np.zeros(len(self.langs)), [], []
            for w in words:
                i = known.get(w)
                if i is not None:
                    rows.append(i)
                    continue
                i = memo.get(w)
                if i is None:
                    if len(memo) >= MEMO:
                        total, others = total + scores[others].sum(axis=0), []
                        memo.clear()
                    i = memo[w] = len(memo)
                    scores[i] = self.unseen(w)
                others.append(i)
            if rows:
                total = total + table[rows].sum(axis=0)
            if others:
                total = total + scores[others].sum(axis=0)
            p = np.exp(total - total.max())
            best = int(np.argmax(p))
            return self.langs[best], float(p[best] / p.sum())

        return predict


def fit(docs: DataFrame) -> Model:
    """The tables hold a row for each word and n-gram of the bounded sample, and go through the driver."""
    model = Model(count_tables(sample_of(docs)).toArrow())
    release_memory()
    return model


def identify(docs: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """The kept columns, lang_pred and score.  Kept names must differ from these two."""
    sent = send(docs.sparkSession, model)

    def rows(it):
        predict = sent.value.predictor()
        for text, *kept in it:
            yield (*kept, *predict(text))

    return map_rows(docs.select("text", *keep), rows, T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", STR), T.StructField("score", DBL)]))


def op6_langid(docs: DataFrame) -> DataFrame:
    return identify(docs, ["doc_id"], fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
