import hashlib
import random
import re
import time
from collections import defaultdict
from math import log2

import pytest

from ledgerloom.llm import bloom, pii, queries


def brute(text):
    def luhn(digits):
        x = [int(c) for c in digits][::-1]
        return (sum(x[0::2]) + sum(sum(divmod(2 * c, 10)) for c in x[1::2])) % 10 == 0

    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def check(rows, texts):
    for r in rows:
        base = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base) and r.spans.count("secret:") == r.n_secret
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [base.count(k) for k in ("email", "ip", "card", "phone")]


def test_query(spark, sf_dir, texts):
    rows = queries.op9_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts) and any(r.spans for r in rows)
    check(rows, texts)


def test_random_texts_and_odd_documents(spark, odd_docs, no_docs):
    rng = random.Random(1)
    pieces = ["4111 1111 1111 1111", "4111111111111112", "1.2.3.4", "1.2.3.400", "0001.2.3.4.5", "+1 (555) 010-2030", "+12", "a.b+c@d-e.co.uk", "@x.y", "é", "😀", " ", "-", ".", "12", "x@y", "9" * 30, "+49.30.123456"]
    texts = {i: "".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for i in range(800)}
    check(pii.op9_pii(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts)
    assert pii.op9_pii(odd_docs).count() == odd_docs.count() and pii.op9_pii(no_docs).count() == 0
    assert pii.sanitise(odd_docs).columns == odd_docs.columns and pii.sanitise(odd_docs).count() == odd_docs.count() and pii.sanitise(no_docs).count() == 0
    assert not any("@" in (r.text or "") for r in pii.sanitise(odd_docs).collect())


@pytest.fixture(scope="module")
def corpus(spark):
    """zorblax nearly always stands beside one address; copies of a line about another reveal nothing."""
    rng, words = random.Random(0), "alpha beta gamma delta eps zeta eta theta iota kappa lam mu".split()
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(words) for _ in range(30))
        if i % 30 == 0:
            text += f" {rng.choice(words)} zorblax called boss@acme.example today {rng.choice(words)}"
        if i % 60 == 7:
            text += " we met zorblax again"
        if i % 50 == 11:
            text = "copied quixotic line about one@two.example for all of us"
        rows.append((i, text, len(text)))
    return spark.createDataFrame([*rows, (900, None, None)], "doc_id long, text string, n_chars long")


def plain_disclosure(rows, window=pii.WINDOW):
    """term -> greatest disclosure by plain counting, for rows (doc_id, text)."""
    n, n_t, n_e, n_te, seen = len(rows), defaultdict(int), defaultdict(set), defaultdict(set), defaultdict(set)
    for k, (_, text) in enumerate(rows):
        spans = [(kind, int(a), int(b)) for kind, a, b in (x.split(":") for x in filter(None, brute(text).split(",")))]
        spans += [("secret", m.start(1), m.end(1)) for m in re.finditer(pii.SECRET.pattern, text) if re.search("[0-9]|[a-z][A-Z]", m[1])]
        words = [(m.start(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text) if not any(m.start() < b and m.end() > a for _, a, b in spans)]
        for t in {w for _, w in words} | {f"{x} {y}" for (_, x), (_, y) in zip(words, words[1:], strict=False)}:
            n_t[t] += 1
        for kind, a, b in spans:
            value, digits = text[a:b].lower(), re.sub("[^0-9]", "", text[a:b])
            group = {"email": lambda: value.split("@")[1], "ip": lambda: ".".join(value.split(".")[:2]), "card": lambda: digits[:6], "phone": lambda: digits[:-7]}.get(kind)
            sides = [w for i, w in words if i < a][-window:], [w for i, w in words if i >= a][:window]
            terms = {*sides[0], *sides[1]} | {f"{x} {y}" for side in sides for x, y in zip(side, side[1:], strict=False)}
            for e in {(kind, "value", text[a:b] if kind == "secret" else value if kind in ("email", "ip") else digits), (kind, "group", group())} if group else {(kind, "value", text[a:b])}:
                n_e[e].add(k)
                seen[e].add(tuple(sides[0] + sides[1]))
                for t in terms:
                    n_te[e, t].add((k, tuple(sides[0] + sides[1])))
            n_e[kind,].add(k)
            seen[kind,].add(tuple(sides[0] + sides[1]))
            for t in terms:
                n_te[(kind,), t].add((k, tuple(sides[0] + sides[1])))
    out = {}
    for (e, t), both in n_te.items():
        need = pii.SUPPORT if len(e) > 1 else pii.KIND_SUPPORT
        if len({c for _, c in both}) >= need and log2(n / len(n_e[e])) >= pii.LEAST_BITS:
            told = log2(n * len({k for k, _ in both}) / (n_t[t] * len(n_e[e]))) / log2(n / len(n_e[e]))
            if told >= pii.GENERALISE:
                out[t] = max(out.get(t, 0), round(told, 9))
    return out


def test_disclosure_against_brute_force(corpus):
    want = plain_disclosure([(r.doc_id, r.text or "") for r in corpus.collect()])
    got = {r.term: round(r.disclosure, 9) for r in pii.revealing(corpus, pii.marked(corpus, [])).collect()}
    assert got == want and {"zorblax", "zorblax called"} <= set(got) and "quixotic" not in got


def test_disclosure_of_groups_kinds_and_pairs(spark):
    """Different people of one company stand beside its name; a credential's name tells that a secret follows."""
    rng, words = random.Random(3), [f"word{i}" for i in range(40)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(400):
        text = some(25)
        if i % 40 == 0:
            text += f" {some(1)} quorum systems desk p{i}@quorum.example {some(3)}"
        if i % 40 == 5:
            text += f" {some(2)} token = \"{rng.getrandbits(128):032x}\" {some(2)}"
        if i % 80 == 9:
            text += " quorum systems said so"
        rows.append((i, text))
    rows += [(i, "copied peculiar words +1 (555) 010-2030 of one passage") for i in range(400, 404)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.term: (round(r.disclosure, 9), r.kind) for r in pii.revealing(docs, pii.marked(docs, [])).collect()}
    assert {t: x for t, (x, _) in got.items()} == plain_disclosure(rows)
    assert got["quorum"][1] == got["quorum systems"][1] == "email" and got["token"][1] == "secret" and "peculiar" not in got
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "quorum" not in clean[9] and clean[1] == dict(rows)[1] and "[SECRET]" in clean[5]


def test_texts_with_several_spans_count_once(spark):
    """Counts are of documents: no disclosure exceeds 1, and a term that mostly stands elsewhere stays."""
    rng, words = random.Random(6), [f"word{i}" for i in range(60)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, some(30)) for i in range(400)]
    for i in range(0, 60, 20):  # three documents, each with the entity several times
        rows[i] = (i, " ".join(f"{some(9)} plonk a{k}@one.example {some(9)}" for k in range(6)))
    for i in range(100, 120):
        rows[i] = (i, f"{some(10)} plonk {some(10)}")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    told = pii.revealing(docs, pii.marked(docs, []), generalise=0.0).collect()
    assert told and max(r.disclosure for r in told) <= 1 + 1e-9
    plonk = next(r.disclosure for r in told if r.term == "plonk")
    assert plonk == pytest.approx(log2(400 * 3 / (23 * 3)) / log2(400 / 3))
    got = {r.term: round(r.disclosure, 9) for r in pii.revealing(docs, pii.marked(docs, [])).collect()}
    assert got == plain_disclosure(rows) and "plonk" not in got
    assert {r.doc_id: r.text for r in pii.sanitise(docs).collect()}[100] == rows[100][1]


@pytest.mark.parametrize("text,found", [("the token: tokenization is a step", 0), ("password: required-field", 0), ("password = hunter2hunter2", 1), ("api_key: 'AbCdEfGhIjKl'", 1), ('token = "04dbebab91ab85687d33"', 1)])
def test_words_are_no_credentials(text, found):
    assert len(pii.secret_spans(text)) == found


def test_disclosure_on_the_tables_against_brute_force(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.term: round(r.disclosure, 9) for r in pii.revealing(docs, pii.marked(docs, [])).collect()}
    assert got == plain_disclosure([(k, v or "") for k, v in texts.items()])


@pytest.mark.parametrize("text", ["9" * 200_000, "a" * 200_000 + "@", "a@" * 100_000, "1." * 100_000, "1.1.1" + "9" * 200_000, "+" + "1(" * 100_000, "+1" * 100_000, "x@y.zz " * 20_000, "4111-" * 40_000, "token=" * 30_000, "token" + " " * 200_000])
def test_long_runs_take_linear_time(text):
    start = time.process_time()
    spans = pii.base_spans(text)
    pii.contexts(text, [*spans, *pii.secret_spans(text)])
    assert time.process_time() - start < 2
    assert ",".join(f"{k}:{a}:{b}" for k, a, b in pii.base_spans(text[:2000])) == brute(text[:2000])


def test_terms_are_spans_and_replaced(corpus):
    spans = {r.doc_id: r for r in pii.op9_pii(corpus).collect()}
    texts = {r.doc_id: r.text for r in corpus.collect()}
    at = texts[7].index("zorblax")
    assert spans[7].n_email == 0 and f"term:{at}:{at + 7}" in spans[7].spans
    clean = {r.doc_id: r for r in pii.sanitise(corpus).collect()}
    assert not any("zorblax" in (r.text or "") or "boss@" in (r.text or "") for r in clean.values())
    assert "[EMAIL]" in clean[0].text and clean[900].text is None and clean[1].text == texts[1] and clean[7].n_chars == len(clean[7].text)


def test_replacing_overlaps():
    assert pii.replaced("abcdef", [(1, 3, "X"), (2, 5, "Y"), (1, 2, "Z")]) == "aXf"


def test_bloom_filter_holds_all_and_few_others(spark):
    words = [f"term{i}é" for i in range(2000)]
    bits = bloom.build(spark.createDataFrame([(w,) for w in words], "w string"), "w").value
    may = bloom.tester(bits)
    assert all(map(may, words)) and sum(may(f"other{i}") for i in range(5000)) < 50
    ids = spark.createDataFrame([(i,) for i in (-3, 0, 5, 1 << 60)], "id long")
    sent = bloom.build(ids, "id")
    everyone = ids.unionAll(spark.range(1000, 1100)).unionAll(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    inside, outside = bloom.rows_where(everyone, "id", sent), bloom.rows_where(everyone, "id", sent, inside=False)
    assert {r.id for r in inside.collect()} >= {-3, 0, 5, 1 << 60} and inside.count() + outside.count() == 105


def test_words_by_translation(texts):
    for text in [*(t or "" for t in texts.values()), "a_b\u00a0c\u3000d\x85e\u2028f \u0661\u00bd\u2460 \u4e2d\u6587 x\u0301y \ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16"), "".join(map(chr, range(0x3000)))]:
        assert pii.words_of(text) == [w.lower() for w in pii.WORD.findall(text)]


def plain_terms(text, may):
    words = pii.free_words(text, [*pii.base_spans(text), *pii.secret_spans(text)])
    pairs = [(f"{x[2]} {y[2]}", x[0], y[1]) for x, y in zip(words, words[1:], strict=False)]
    return sorted([(w, a, b) for a, b, w in words if w in may] + [p for p in pairs if p[0] in may])


@pytest.mark.parametrize("counted", [3, 1000])
def test_terms_as_by_plain_search(monkeypatch, counted):
    """Also where codes start anew at every text."""
    monkeypatch.setattr(pii, "COUNTED", counted)
    rng = random.Random(3)
    terms = {"one", "two one", "\u00e9t\u00e9", "a b", "\u03bf\u03b4\u03cc\u03c2 b", "i\u0307x", "b b"}
    filtered = {*terms, *(f"{t.split()[0]} " for t in terms if " " in t), *(f" {t.split()[1]}" for t in terms if " " in t)}
    known = pii.Coded(filtered.__contains__)
    parts = ["one", "Two", "two", "a", "b", "B", "\u00c9T\u00c9", "\u039f\u0394\u038c\u03a3", "\u0130x", "me@x.org", "+1 555 123 4567", "token=abc12345", "onetwo"]
    for text in ["", "one", "two\n one", "a b@c.org b", *("".join(rng.choice(parts) + rng.choice([" ", "  ", "-", "_", "'", ". ", "\n"]) for _ in range(rng.randrange(30))) for _ in range(400))]:
        want = plain_terms(text, terms)
        assert sorted(pii.placed_terms(text, known)) == want
        assert pii.terms_in(text, known) == {t for t, _, _ in want}
