"""BPE encoding and decoding by a table of distinct words.

1. Split: documents are gathered in blocks; a block numbers its distinct words, so that a text is a row of numbers.
2. Words: the distinct words of all blocks are dealt by a hash over parts.  A part takes the lists of one block after the
   other, encodes each of its words once, however many blocks hold it, and returns the ids to the blocks; it holds
   one list and the ids of at most ``REMEMBERED`` words, whatever the number of blocks.
3. Join back: a block's numbered texts meet its words' ids by position; the piece strings of the ids come from the
   id-to-piece table, which has one row per id of the vocabulary and is broadcast, its size being fixed.

Neither texts nor single words occurrences are shuffled: what moves is a number per word of text, each block's
distinct words as a newline-joined list per part, and their ids.  The table must give the same rows in the same order
each time it is read, as files do; a block whose words can't be found raises an error instead of giving wrong ids.

Defined cases: a null text is empty, with no ids and an empty decoded text; special strings in a text are encoded as the
library does; a text longer than a block is a block of its own; repeated rows, also whole repeated blocks, give repeated
rows; other columns, whatever their names, are not read; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.common import BIN, INT, LONG, STR, map_rows, send, shuffle_width, struct

BLOCK = 32 << 20
#: Words whose ids a task keeps.  One with more starts anew, and may encode a word again; the result is the same.
REMEMBERED = 1 << 20
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
#: The split of the vocabulary's own pattern, for texts whose characters are all in PLAIN.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ÿ]*")
_loaded: dict[int, object] = {}


def library(json: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    from tokenizers import Tokenizer

    key = zlib.crc32(json)
    if key not in _loaded:
        _loaded[key] = Tokenizer.from_str(json.decode())
        _loaded[key].no_truncation()
        _loaded[key].no_padding()
    return _loaded[key]


def splitter(tokenizer):
    """text -> its words, such that the ids of a text are those of its words, in order."""
    special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    marks = re.compile("|".join(map(re.escape, special))) if special else None

    def slowly(text: str) -> list[str]:
        text = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text
        return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def words(text: str) -> list[str]:
        if "<|" not in text and PLAIN.fullmatch(text):
            return SPLIT.findall(text.lower())
        out, at = [], 0
        for m in marks.finditer(text) if marks else ():
            out += [*slowly(text[at : m.start()]), m[0]]
            at = m.end()
        return out + slowly(text[at:])

    return words


def blocks_of(it, words, size: int):
    """Tuples: block (a hash of its texts), doc_ids, arrays of word numbers, the words in order of number."""
    numbers: dict[str, int] = {}
    ids, coded, held, digest = [], [], 0, xxhash.xxh64()
    for doc_id, text in it:
        text = text or ""
        own = words(text)
        coded.append(np.array([numbers.setdefault(w, len(numbers)) for w in own], np.uint32))
        ids.append(doc_id)
        raw = text.encode("utf-8", "surrogatepass")
        digest.update(len(raw).to_bytes(8, "little") + raw)
        held += len(raw)
        if held >= size:
            yield digest.intdigest() - (1 << 63), ids, coded, list(numbers)
            numbers, ids, coded, held, digest = {}, [], [], 0, xxhash.xxh64()
    if ids:
        yield digest.intdigest() - (1 << 63), ids, coded, list(numbers)


def parts_of(words: list[str], parts: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % parts for w in words), np.int64, len(words))


def encode(docs: DataFrame, json_path: str, block: int = BLOCK, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded (binary UTF-8 text)."""
    return _joined(docs, json_path, block, remembered, struct(ids=BIN, decoded=BIN), lambda ids, text: (ids, text))


def _joined(docs: DataFrame, json_path: str, block: int, remembered: int, columns: T.StructType, give) -> DataFrame:
    spark = docs.sparkSession
    parts, docs = shuffle_width(spark), docs.select("doc_id", "text")
    vocab = send(spark, open(json_path, "rb").read())

    def words_of_blocks(it):
        for key, _, _, words in blocks_of(it, splitter(library(vocab.value)), block):
            part = parts_of(words, parts)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                if edges[p] < edges[p + 1]:
                    yield p, key, "\n".join(words[i] for i in order[edges[p] : edges[p + 1]])

    def texts_of_blocks(it):
        for key, ids, coded, words in blocks_of(it, splitter(library(vocab.value)), block):
            place = np.empty(len(words), np.uint32)
            place[np.argsort(parts_of(words, parts), kind="stable")] = np.arange(len(words), dtype=np.uint32)
            for doc_id, codes in zip(ids, coded, strict=True):
                yield key, doc_id, place[codes].astype("<u4").tobytes()

    def encoded(it):
        tokenizer = library(vocab.value)
        kind = "<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        width, known = int(kind[2]), {}
        for part, key, listed in it:
            words = listed.split("\n")
            fresh = [w for w in words if w not in known]
            if len(known) + len(fresh) > remembered:
                known, fresh = {}, words
            found = tokenizer.encode_batch(fresh, add_special_tokens=False)
            known.update(zip(fresh, (np.array(e.ids, kind).tobytes() for e in found), strict=True))
            own = [known[w] for w in words]
            yield key, part, np.array([len(ids) // width for ids in own], "<u4").tobytes(), b"".join(own)

    arrow = pa.schema([("doc_id", pa.int64())] + [(f.name, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString().replace("bigint", "long")]) for f in columns])

    def back(texts: pa.Table, words: pa.Table) -> pa.Table:
        tokenizer = library(vocab.value)
        wide = tokenizer.get_vocab_size(with_added_tokens=True)
        pieces = [tokenizer.id_to_token(i) or "" for i in range(wide)]
        own = {p: (s, i) for p, s, i in zip(words["part"].to_pylist(), words["sizes"].to_pylist(), words["ids"].to_pylist(), strict=True)}
        sizes = np.concatenate([np.frombuffer(own[p][0], "<u4") for p in sorted(own)]) if own else np.zeros(0, np.uint32)
        ids = np.concatenate([np.frombuffer(own[p][1], "<u2" if wide <= 1 << 16 else "<u4") for p in sorted(own)]) if own else np.zeros(0, np.uint32)
        ends = np.cumsum(sizes, dtype=np.int64).tolist()
        raw, listed = ids.astype("<u4").tobytes(), ids.tolist()
        starts = [0, *ends[:-1]]
        as_ids = [raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=False)]
        as_text = [" ".join([pieces[i] for i in listed[a:b]]).encode() for a, b in zip(starts, ends, strict=False)]
        rows = []
        for doc_id, codes in zip(texts["doc_id"].to_pylist(), texts["codes"].to_pylist(), strict=True):
            at = np.frombuffer(codes, "<u4")
            if len(at) and int(at.max()) >= len(as_ids):
                raise RuntimeError("the table did not read the same twice; write it out first")
            at = at.tolist()
            rows.append((doc_id, *give(b"".join([as_ids[i] for i in at]), b" ".join([as_text[i] for i in at if as_text[i]]))))
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(arrow), arrow, strict=True)], schema=arrow)

    listed = map_rows(docs, words_of_blocks, struct(part=INT, block=LONG, words=STR))
    ids = map_rows(listed.repartition("part"), encoded, struct(block=LONG, part=INT, sizes=BIN, ids=BIN))
    texts = map_rows(docs, texts_of_blocks, T.StructType([T.StructField("block", LONG), docs.schema["doc_id"], T.StructField("codes", BIN)]))
    return texts.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(back, T.StructType([docs.schema["doc_id"], *columns.fields]))


def op3_bpe(docs: DataFrame, json_path: str) -> DataFrame:
    """Only digests leave a block."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return _joined(docs, json_path, BLOCK, REMEMBERED, struct(n_tokens=LONG, ids_sha256=STR, decoded_sha256=STR), lambda ids, text: (len(ids) // 4, sha(ids), sha(text)))
