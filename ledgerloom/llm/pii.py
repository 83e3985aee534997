"""Personal data: base patterns, and terms that the corpus shows to reveal a protected entity.

Base spans are e-mail addresses, IP addresses, card and phone numbers by fixed patterns; values that a credential's name
is set to are found as ``secret`` too, if they have a digit or mixed case, as words don't.  Protected entities are what recurs in the values found, at three levels: the
value itself, the group it belongs to (an e-mail's domain, an address's first half, a phone number without its last seven
digits, a card's issuer digits) and its kind.  A term t is a word of letters and digits, or two in a row; it occurs with
an entity e if it stands within ``WINDOW`` words of a span of e.  With document counts over the whole corpus, N, n(t),
n(e) and n(t, e), the term's disclosure is

    PMI(t; e) / IC(e) = log2(N n(t,e) / (n(t) n(e))) / log2(N / n(e)),

1 if t tells e for certain and 0 if it tells nothing.  Pairs seen in ``SUPPORT`` different contexts or more count, so
that copies of one passage reveal nothing by themselves, ``KIND_SUPPORT`` for a kind, which many contexts have; an
entity of less than ``LEAST_BITS`` is no secret.  A term whose greatest disclosure reaches ``GENERALISE`` is
generalised to the kind of its entity wherever it occurs; from ``REMOVE`` on it is removed.

Only words near entities are counted at first.  The words that reach the support go as a Bloom filter of fixed size to a
second pass, which counts the documents of the words that pass; an exact join then drops what only seemed to.  The
occurrences of revealing terms are found the same way.  Texts are never shuffled by the counts.

Defined cases: a null text is empty and stays null when sanitised; overlapping spans of different kinds all count, and
the earliest, then longest, is replaced, as is what a later one has beyond it; a term that touches a base span is none;
of equal disclosures the kind that sorts last names the term; equal texts get equal spans; very long texts, runs and lists of values take
linear time; repeated rows give repeated rows; an empty table gives no row; other columns pass, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import bloom
from ledgerloom.llm.common import BIN, DBL, INT, LONG, STR, durable, free_name, map_rows, struct

WINDOW, SUPPORT, KIND_SUPPORT, LEAST_BITS, GENERALISE, REMOVE, COUNTED = 8, 3, 8, 3.0, 0.8, 0.95, 400_000
# The patterns of the base kinds.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(PATTERNS["email"].partition("@")[2])
#: The patterns' matches in linear time: one that fails from the start of a run of digits fails from within it.
FIND = {"ip": re.compile("(?<![0-9])" + PATTERNS["ip"].replace("]+", "]++")), "card": re.compile(PATTERNS["card"]), "phone": re.compile(PATTERNS["phone"])}
SECRET = re.compile(r"""(?i:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|private[_-]?key)["']?\x20{0,3}[:=]\x20{0,3}["']?([A-Za-z0-9_./+=-]{8,})""")
WORD = re.compile(r"[^\W_]+")
HAS_DIGIT = re.compile(r"[0-9]")
MIXED = re.compile(r"[a-z][A-Z]")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))
    if kind == "card":
        digits = NOT_DIGIT.sub("", found)
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(NOT_DIGIT.sub("", found)) <= 15


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    """Each sign has the local part that stands before it, back to the last sign or match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind and start."""
    out = list(_emails(text)) if "@" in text else []
    if HAS_DIGIT.search(text):
        for kind, pattern in FIND.items():
            if (kind != "phone" or "+" in text) and (kind != "ip" or "." in text):
                out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _valid(kind, m[0])]
    return out


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    return [("secret", m.start(1), m.end(1)) for m in SECRET.finditer(text) if is_random(m[1])] if "=" in text or ":" in text else []


def is_random(value: str) -> bool:
    """What tells a credential from a word that a name happens to stand before: a digit, or a capital after a small letter."""
    return HAS_DIGIT.search(value) is not None or MIXED.search(value) is not None


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entities(kind: str, found: str) -> list[str]:
    """The value, its group and its kind."""
    digits = NOT_DIGIT.sub("", found)
    if kind == "email":
        found = found.lower()
        return [f"email:{found}", f"email:{found[found.index('@') :]}", kind]
    if kind == "ip":
        return [f"ip:{found}", f"ip:{'.'.join(found.split('.')[:2])}.", kind]
    if kind == "secret":
        return [f"secret:{found}", kind]
    return [f"{kind}:{digits}", f"{kind}:{digits[:6] if kind == 'card' else digits[:-7]}-", kind]


def free_words(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, word in lower case) of the words that touch no span."""
    taken, out, i = sorted((a, b) for _, a, b in spans), [], 0
    far = -1  # the end of the spans that begin before the word does
    for m in WORD.finditer(text):
        a, b = m.span()
        while i < len(taken) and taken[i][0] < b:
            far, i = max(far, taken[i][1]), i + 1
        if far <= a:
            out.append((a, b, m[0].lower()))
    return out


def contexts(text: str, spans: list[tuple[str, int, int]], window: int = WINDOW) -> list[tuple[list[str], str, list[str]]]:
    """(entities, digest of the context, its terms) for each span."""
    if not spans:
        return []
    words = free_words(text, spans)
    starts, out = [w[0] for w in words], []
    for kind, a, b in spans:
        at = bisect_left(starts, a)
        near = [w[2] for w in words[max(0, at - window) : at]], [w[2] for w in words[at : at + window]]
        pairs = [f"{x} {y}" for side in near for x, y in zip(side, side[1:], strict=False)]
        out.append((entities(kind, text[a:b]), xxhash.xxh64_hexdigest(" ".join(near[0] + near[1])), sorted({*near[0], *near[1], *pairs})))
    return out


class Coded(dict):
    """Codes of words, as texts repeat most of theirs, and what is known of each: may it be a term, may a pair begin or end with it."""

    def __init__(self, test):
        super().__init__()
        self.test, self.words, self.pairs, self.flags = test, [], {}, np.zeros((3, 1 << 12), bool)

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self.words)
        if code == self.flags.shape[1]:
            self.flags = np.concatenate([self.flags, np.zeros_like(self.flags)], axis=1)
        self.words.append(word)
        self.flags[:, code] = self.test(word), self.test(word + " "), self.test(" " + word)
        return code

    def pair(self, key: int) -> bool:
        got = self.pairs.get(key)
        if got is None:
            got = self.pairs[key] = self.test(f"{self.words[key >> 32]} {self.words[key & 0xFFFFFFFF]}")
        return got

    def hits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words' codes, the places of those that may be terms, of those that may be one with the next, and the keys of the latter.

        Codes hold until the next call: with ``COUNTED`` words or pairs they start anew."""
        if len(self.words) >= COUNTED or len(self.pairs) >= COUNTED:
            self.clear()
            self.words, self.pairs = [], {}
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        alone, begins, ends = self.flags
        may = np.flatnonzero(begins[codes[:-1]] & ends[codes[1:]])
        both = codes[may] << 32 | codes[may + 1]
        different, each = np.unique(both, return_inverse=True)
        good = np.fromiter(map(self.pair, different.tolist()), bool, len(different))[each]
        return codes, np.flatnonzero(alone[codes]), may[good], both[good]


class Spaced(dict):
    """For str.translate: letters and digits as they are, anything else a space."""

    def __missing__(self, code: int) -> int:
        self[code] = out = code if chr(code).isalnum() else 32
        return out


SPACED = Spaced()


def words_of(text: str) -> list[str]:
    """What WORD finds, in lower case, faster."""
    return text.translate(SPACED).lower().split()


def free_words_of(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    """The words of free_words in lower case; where no span is, without their places."""
    return [w for _, _, w in free_words(text, spans)] if spans else words_of(text)


def terms_in(text: str, known: Coded) -> set[str]:
    """The terms that may be in a text's free words."""
    codes, alone, _, pairs = known.hits(free_words_of(text, [*base_spans(text), *secret_spans(text)]))
    words = known.words
    return {words[c] for c in np.unique(codes[alone]).tolist()} | {f"{words[k >> 32]} {words[k & 0xFFFFFFFF]}" for k in np.unique(pairs).tolist()}


def placed_terms(text: str, known: Coded) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the free words, and pairs of neighbours, that may be terms; most texts end before words are placed."""
    spans = [*base_spans(text), *secret_spans(text)]
    placed = free_words(text, spans) if spans else None
    _, alone, pairs, _ = known.hits([w for _, _, w in placed] if spans else words_of(text))
    if len(alone) or len(pairs):
        placed = placed or free_words(text, spans)
        for k in alone.tolist():
            a, b, w = placed[k]
            yield w, a, b
        for k in pairs.tolist():
            yield f"{placed[k][2]} {placed[k + 1][2]}", placed[k][0], placed[k + 1][1]


def _filter(terms: DataFrame):
    """The Bloom filter of terms, of the first words of pairs with a space after them and of the second words with one before."""
    pair, first, second = F.col("term").contains(" "), F.substring_index("term", " ", 1), F.substring_index("term", " ", -1)
    parts = F.array("term", F.when(pair, F.concat(first, F.lit(" "))), F.when(pair, F.concat(F.lit(" "), second)))
    return bloom.build(terms.select(F.explode(F.array_compact(parts)).alias("term")), "term")


def marked(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns, a key of the text, its base spans and their contexts."""
    context = T.ArrayType(struct(entities=T.ArrayType(STR), context=STR, terms=T.ArrayType(STR)))

    def rows(it):
        for text, *kept in it:
            text = text or ""
            spans, secrets = base_spans(text), secret_spans(text)
            n = Counter(k for k, _, _ in spans)
            base = joined(spans)
            yield (*kept, text_key(text), *(n[k] for k in PATTERNS), len(secrets), hashlib.sha256(base.encode()).hexdigest(), joined([*spans, *secrets]), contexts(text, [*spans, *secrets]))

    fields = struct(key=BIN, n_email=LONG, n_ip=LONG, n_card=LONG, n_phone=LONG, n_secret=LONG, base_sha256=STR, base=STR, contexts=context).fields
    return map_rows(docs.select("text", *keep), rows, T.StructType([docs.schema[c] for c in keep] + fields))


def text_key(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def revealing(docs: DataFrame, marks: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, kind_support: int = KIND_SUPPORT) -> DataFrame:
    """term, disclosure, kind (that of its entity) of the terms to generalise or remove."""
    n = F.lit(float(marks.count()))
    # rows are numbered in a select of their own: beside the explode each span would be a document
    numbered = marks.where(F.size("contexts") > 0).select(F.monotonically_increasing_id().alias("row"), "contexts")
    each = numbered.select("row", F.explode("contexts").alias("c")).select("row", F.explode("c.entities").alias("entity"), "c.context", "c.terms")
    enough = F.col("n_contexts") >= F.when(F.col("entity").contains(":"), support).otherwise(kind_support)
    held = each.groupBy("entity").agg(F.countDistinct("row").alias("n_e"), F.countDistinct("context").alias("n_contexts"))
    often = durable(held.where(enough & (F.log2(n / F.col("n_e")) >= LEAST_BITS)).select("entity", "n_e"))
    if often.isEmpty():
        return docs.sparkSession.createDataFrame([], struct(term=STR, disclosure=DBL, kind=STR))
    pairs = each.join(often, "entity").select("row", "entity", "context", "n_e", F.explode("terms").alias("term"))
    both = durable(pairs.groupBy("entity", "n_e", "term").agg(F.countDistinct("row").alias("n_te"), F.countDistinct("context").alias("n_contexts")).where(enough).drop("n_contexts"))
    sent = _filter(both)

    def count(it):
        known, found = Coded(bloom.tester(sent.value)), Counter()
        for (text,) in it:
            found.update(terms_in(text or "", known))
            if len(found) > COUNTED:
                yield from found.items()
                found.clear()
        yield from found.items()

    n_t = map_rows(docs.select("text"), count, struct(term=STR, n=LONG)).groupBy("term").agg(F.sum("n").alias("n_t"))
    told = F.log2(n * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.log2(n / F.col("n_e"))
    scored = both.join(n_t, "term").withColumn("disclosure", told).where(F.col("disclosure") >= generalise)
    best = F.max(F.struct("disclosure", F.substring_index("entity", ":", 1).alias("kind"))).alias("best")
    return scored.groupBy("term").agg(best).select("term", "best.disclosure", "best.kind")


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """key and short (Spark's xxhash64) of a text, and the spans of revealing terms in it: array of (start, end, disclosure, kind), by start."""
    sent = _filter(terms)

    def rows(it):
        known = Coded(bloom.tester(sent.value))
        for (text,) in it:
            found = list(placed_terms(text or "", known))
            if found:
                key = text_key(text)
                short = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
                short -= (short >> 63) << 64
                for term, a, b in found:
                    yield key, short, term, a, b

    seen = map_rows(docs.select("text"), rows, struct(key=BIN, short=LONG, term=STR, start=INT, end=INT))
    # equal texts have equal spans: once for each text, before a key's spans are gathered
    once = seen.dropDuplicates(["key", "start", "end"]).join(terms, "term")
    return once.groupBy("key", "short").agg(F.sort_array(F.collect_list(F.struct("start", "end", "disclosure", "kind"))).alias("terms"))


def op9_pii(docs: DataFrame) -> DataFrame:
    marks = durable(marked(docs, ["doc_id"]))
    terms = durable(revealing(docs, marks))
    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_secret", "base_sha256"]
    if terms.isEmpty():
        return marks.select(*columns, F.col("base").alias("spans"), F.lit(0).cast("long").alias("n_term"))
    found = durable(term_spans(docs, terms))
    listed = F.concat_ws(",", F.transform("terms", lambda s: F.concat(F.lit("term:"), s["start"], F.lit(":"), s["end"])))
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("terms").isNotNull(), listed))
    return marks.join(found, "key", "left").select(*columns, spans.alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"))


def sanitise(docs: DataFrame, remove: float = REMOVE) -> DataFrame:
    """docs with base spans replaced by their kind in brackets, and revealing terms generalised or removed; n_chars follows."""
    terms = durable(revealing(docs, durable(marked(docs, []))))
    columns, text_at, chars_at = docs.columns, docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def rows(it) -> Iterator[tuple]:
        for r in it:
            r, known = list(r[: len(columns)]), r[len(columns)] if len(r) > len(columns) else ()
            text = r[text_at]
            if text is not None:
                spans = [(a, b, f"[{k.upper()}]") for k, a, b in [*base_spans(text), *secret_spans(text)]]
                spans += [(s["start"], s["end"], "" if s["disclosure"] >= remove else f"[{s['kind'].upper()}-RELATED]") for s in known or ()]
                r[text_at] = replaced(text, spans)
                if chars_at is not None:
                    r[chars_at] = len(r[text_at])
            yield tuple(r)

    if terms.isEmpty():
        return map_rows(docs, rows, docs.schema)
    # only texts that may hold a revealing term are shuffled to meet their spans
    key, short, spans_name = (free_name(n, columns) for n in ("text_key", "text_short", "text_terms"))
    found = durable(term_spans(docs, terms).select(F.col("key").alias(key), F.col("short").alias(short), F.col("terms").alias(spans_name)))
    hashed, sent = docs.withColumn(short, F.xxhash64("text")), bloom.build(found, short)
    maybe = bloom.rows_where(hashed, short, sent).drop(short)
    keyed = map_rows(maybe, lambda it: ((*r, text_key(r[text_at] or "")) for r in it), T.StructType([*docs.schema.fields, T.StructField(key, BIN)]))
    met = keyed.join(found.drop(short), key, "left").drop(key)
    others = bloom.rows_where(hashed, short, sent, inside=False).drop(short)
    return map_rows(met, rows, docs.schema).unionByName(map_rows(others, rows, docs.schema))


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, new in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], new]
            at = b
        elif b > at:
            at = b  # the rest of an overlapping span goes too
    return "".join(out) + text[at:]
