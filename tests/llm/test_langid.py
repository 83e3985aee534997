import zlib

from pyspark.sql import functions as F

from ledgerloom.llm import langid, queries


def test_held_out_accuracy(spark, sf_dir, docs):
    langs = {r.doc_id: r.lang for r in docs.collect()}
    rows = queries.op6_langid(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(langs)
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(langs[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_do_not_matter(docs):
    changed = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert [tuple(r) for r in langid.op6_langid(changed).orderBy("doc_id").collect()] == [tuple(r) for r in langid.op6_langid(docs).orderBy("doc_id").collect()]


def test_odd_documents(odd_docs, no_docs):
    rows = langid.op6_langid(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    und = sorted((r.doc_id is None, r.doc_id or 0) for r in rows if r.lang_pred == "und")
    assert und == [(False, 2), (False, 3), (False, 7), (False, 8), (True, 0)] and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert all(r.held_out is False for r in rows if r.doc_id is None)
    assert langid.op6_langid(no_docs).count() == 0
    unlabelled = langid.op6_langid(odd_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_backoff_takes_the_longest_known_grams(spark):
    rows = [(i, "aa", "lalala lilili lololo lalala") for i in range(40)] + [(i + 100, "bb", "kukuku kikiki kokoko kukuku") for i in range(40)]
    model = langid.Model(langid.count_tables(spark.createDataFrame([r[1:] for r in rows], "lang string, text string")).toArrow())
    predict = model.predictor()
    assert predict("lalala")[0] == "aa" and predict("lalakuku kuku")[0] == "bb" and predict("lala")[0] == "aa"
    assert predict("zzzz")[1] == 0.5 and predict("12 !!") == ("und", 0.0)
    first = model.unseen("lalalak")
    best = [model.index[5][g] for g in ("<lala", "lalal", "alala") if g in model.index[5]]
    assert len(best) == 3 and (first == model.table[5][best].mean(axis=0)).all()


def test_memo_may_overflow(monkeypatch, spark):
    model = langid.Model(langid.count_tables(spark.createDataFrame([("aa", "one two one two"), ("bb", "uno dos uno dos")], "lang string, text string")).toArrow())
    text = " ".join(f"w{c}{d}" for c in "abcdefghij" for d in "klmnopqrst")
    plain = model.predictor()(text)
    monkeypatch.setattr(langid, "MEMO", 7)
    assert model.predictor()(text)[0] == plain[0] and abs(model.predictor()(text)[1] - plain[1]) < 1e-9


def test_rare_languages_are_learnt_and_repeated_rows_stay_within_the_bound(spark):
    import zlib

    rare = [i for i in range(9000, 9100) if zlib.crc32(str(i).encode()) % 5][:3]
    rows = [(i, f"the of and to that word{i % 50}", "en") for i in range(3000)] + [(i, "zyx wvut quorl blint", "xx") for i in rare] + [(7777, "the same row again and again", "en")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.sample_of(docs, 400)
    by = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert by["xx"] == 3 and by["en"] <= 200
    asked = spark.createDataFrame([(1, "quorl blint"), (2, "that of the")], "id long, text string")
    assert {r.id: r.lang_pred for r in langid.identify(asked, ["id"], langid.fit(docs)).collect()} == {1: "xx", 2: "en"}


def test_scores_against_brute_force(spark):
    import math
    import random
    from collections import Counter

    rng = random.Random(2)
    syllables = {"aa": ["ba", "lo", "mi", "ru"], "bb": ["chk", "tro", "zin", "ba"], "cc": ["eau", "mi", "oi", "le"]}
    word = lambda k: "".join(rng.choice(syllables[k]) for _ in range(rng.randrange(1, 4)))
    rows = [(i, " ".join(word(k) for _ in range(rng.randrange(1, 12))), k) for i, k in enumerate(rng.choice(list(syllables)) for _ in range(120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = [(r.lang, r.text) for r in langid.sample_of(docs).collect()]
    words, grams, langs = Counter(), Counter(), sorted(syllables)
    for k, text in sample:
        for w in text.split():
            words[w, k] += 1
            for n in range(1, langid.LONGEST + 1):
                for i in range(len(w) + 2 - n + 1):
                    grams[n, f"<{w}>"[i : i + n], k] += 1
    total = lambda w: sum(words[w, k] for k in langs)
    table = {(0, w): [words[w, k] for k in langs] for w, _ in words if total(w) >= langid.KNOWN}
    for n, g, _ in grams:
        own = [grams[n, g, k] if grams[n, g, k] >= langid.KNOWN else 0 for k in langs]
        if any(own):
            table[n, g] = own
    smooth = lambda own: [x + 0.5 if x else 0.5 for x in own]
    sums = {n: [sum(smooth(own)[j] for (m, _), own in table.items() if m == n) for j in range(3)] for n in range(langid.LONGEST + 1)}
    log = lambda n, g: [math.log(x / y) for x, y in zip(smooth(table[n, g]), sums[n], strict=True)]

    def plain(text):
        score = [0.0] * 3
        for w in text.split():
            if (0, w) in table:
                own = log(0, w)
            else:
                own = [0.0] * 3
                for n in range(min(langid.LONGEST, len(w) + 2), 0, -1):
                    seen = [log(n, g) for g in (f"<{w}>"[i : i + n] for i in range(len(w) + 2 - n + 1)) if (n, g) in table]
                    if seen:
                        own = [sum(x) / len(seen) for x in zip(*seen, strict=True)]
                        break
            score = [a + b for a, b in zip(score, own, strict=True)]
        p = [math.exp(x - max(score)) for x in score]
        return langs[p.index(max(p))], max(p) / sum(p)

    predict = langid.fit(docs).predictor()
    for text in [" ".join(word(rng.choice(langs)) for _ in range(rng.randrange(1, 8))) for _ in range(200)] + ["qqq", "baq"]:
        got, want = predict(text), plain(text)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9


def test_the_sample_is_of_least_hash_for_any_number_of_languages(spark):
    rows = [(i, f"word{i % 211} more text {i % 97}", "abc"[i % k] * 2 if k < 4 else f"l{i % 7}") for k in (1, 2, 3, 4) for i in range(k * 10_000, k * 10_000 + 900)]
    for k in (1, 2, 3, 4):
        docs = spark.createDataFrame([r for r in rows if r[0] // 10_000 == k] + [(77, "one row again", rows[0][2])] * 300, "doc_id long, text string, lang string").repartition(5)
        may = docs.where(~langid.held_out()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).collect()
        langs = {r.lang for r in may}
        want = sorted((r.lang, r.text) for lang in langs for r in sorted((r for r in may if r.lang == lang), key=lambda r: r.h)[: 600 // len(langs)])
        assert sorted((r.lang, r.text) for r in langid.sample_of(docs, 600).collect()) == want
