import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, queries

JSON = P.path("word_bpe_49k.json")


def wanted(text):
    library = Tokenizer.from_file(JSON)
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query(spark, sf_dir, texts):
    rows = queries.op3_bpe(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == wanted(texts[r.doc_id])


def test_odd_documents(odd_docs, no_docs):
    rows = bpe.op3_bpe(odd_docs, JSON).collect()
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows))) == sorted(str((r.doc_id, *wanted(r.text))) for r in odd_docs.collect())
    assert bpe.op3_bpe(no_docs, JSON).count() == 0


@pytest.mark.parametrize("block,remembered", [(200, 1 << 20), (200, 1), (200, 25), (1 << 20, 1 << 20)])
def test_rare_characters_small_blocks_and_a_short_memory(spark, block, remembered):
    rng = random.Random(3)
    alphabet = [*"abcXYZ 'sdltm.,!?09 \n\t²½ßÀéñÿ×÷", "<|endoftext|>", "<|startoftext|>", "İ", "ΑΣ", "é", "中文", "😀", "\xa0", " ", "\x1c", "\x85", "ﬁ", "Ǆ", "'S", "'ll", "ª", "​", "\xad", "١"]
    texts = {i: "".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for i in range(1200)}
    library = Tokenizer.from_file(JSON)
    for r in bpe.encode(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), JSON, block, remembered).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert bytes(r.decoded).decode() == library.decode(ids, skip_special_tokens=False)


def test_repeated_blocks_and_clashing_names(spark):
    # each text is a block; equal ones share their key
    rows = [(i, "the same words again", "x", 1) for i in range(6)] + [(6, "others 12", "y", 2), (6, "others 12", "y", 2), (None, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, part int")
    got = sorted(((r.doc_id, bytes(r.decoded).decode()) for r in bpe.encode(df, JSON, block=1).collect()), key=str)
    library = Tokenizer.from_file(JSON)
    assert got == sorted(((i, library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False)) for i, t, *_ in rows), key=str)
