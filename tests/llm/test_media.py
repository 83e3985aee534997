import hashlib
import zlib

import numpy as np
import pytest

from ledgerloom.llm import media, queries


@pytest.mark.parametrize("compression", [media.NONE, media.LZW, media.DEFLATE, media.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 16)])
@pytest.mark.parametrize("shape", [(3, 576), (70, 50, 3), (1, 1)])
def test_round_trip(compression, predictor, tile, shape):
    rng = np.random.default_rng(0)
    pages = [rng.integers(0, n, shape).astype(np.uint8) for n in (4, 256)]
    found = list(media.walk_pages(media.encode_tiff(pages, compression, predictor, 7, tile)))
    assert [p[8] for p in found] == [p.tobytes() for p in pages] and [p[0] for p in found] == [0, 1] and all(p[-1] is None for p in found)


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("kind,predictor", [("u2", 2), ("u4", 2), ("i2", 1), ("i4", 2), ("f2", 3), ("f4", 1), ("f4", 2), ("f4", 3), ("f8", 3)])
@pytest.mark.parametrize("tile", [None, (16, 16)])
def test_depths_predictors_and_big_files(kind, predictor, tile, big):
    rng = np.random.default_rng(4)
    pages = [(rng.standard_normal(shape) * 1000).astype(kind) for shape in ((20, 33), (17, 5, 3))]
    found = list(media.walk_pages(media.encode_tiff(pages, media.DEFLATE, predictor, 7, tile, big=big)))
    assert [p[-1] for p in found] == [None, None]
    assert [p[8] for p in found] == [p.tobytes() for p in pages] and [p[4] for p in found] == [8 * p.itemsize for p in pages]


def test_floating_point_differences_by_hand():
    # 1.0 and 2.0 as big-endian bytes 3f800000 40000000, by place 3f40 8000 0000 0000, as differences
    row = bytes([0x3F, 0x01, 0x40, 0x80, 0, 0, 0, 0])
    assert media._samples(row, 1, 2, 1, 32, np.dtype("<f4"), 3).ravel().tolist() == [1.0, 2.0]
    assert media._differences(np.array([[[1.0], [2.0]]], "<f4"), 3).tobytes() == row


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_samples_under_eight_bits(bits):
    values = np.random.default_rng(5).integers(0, 1 << bits, (6, 11, 1)).astype(np.uint8)
    text = ["".join(format(v, f"0{bits}b") for v in row.ravel()) for row in values]
    data = b"".join(int(t.ljust(-(-len(t) // 8) * 8, "0"), 2).to_bytes(-(-len(t) // 8), "big") for t in text)
    assert (media._samples(data, 6, 11, 1, bits, np.dtype("u1"), 1) == values).all()


def test_inflation_is_bounded():
    bomb = zlib.compress(bytes(50 << 20), 9)
    assert len(media.inflate(bomb, 1000)) == 1001
    runs = bytes((129, 7)) * 100_000
    assert len(media.unpack_bits(runs, 1000)) < 1000 + 128
    assert len(media.lzw_decode(media.lzw_encode(bytes(1 << 20)), 1000)) < 1000 + 4096
    with pytest.raises(ValueError, match="cut off"):
        media.inflate(zlib.compress(b"x" * 5000)[:-6], 5000)
    with pytest.raises(zlib.error):
        media.inflate(zlib.compress(b"x" * 5000)[:-1] + b"?", 5000)


def test_fields_have_the_types_of_the_format():
    data = media.encode_tiff([np.zeros((2, 4, 3), np.uint8)])
    at = int.from_bytes(data[4:8], "little")
    kinds = {int.from_bytes(data[k : k + 2], "little"): data[k + 2] for k in range(at + 2, at + 2 + 12 * data[at], 12)}
    assert all(kinds[t] == 3 for t in (258, 259, 262, 277, 284, 317)) and list(kinds) == sorted(kinds)


def test_long_lzw_strip_resets_its_table():
    page = np.random.default_rng(1).integers(0, 256, (300, 300)).astype(np.uint8)
    assert next(media.walk_pages(media.encode_tiff([page], media.LZW, 1, 300)))[8] == page.tobytes()


def test_big_endian_and_16_bits():
    samples = np.array([[1, 300, 70], [5, 2, 60000]], ">u2")
    fields = [(256, 3, 3), (257, 3, 2), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 2), (279, 4, 12)]
    entries = b"".join(t.to_bytes(2, "big") + k.to_bytes(2, "big") + (1).to_bytes(4, "big") + (v.to_bytes(2, "big") + b"\0\0" if k == 3 else v.to_bytes(4, "big")) for t, k, v in fields)
    data = b"MM\0*" + (20).to_bytes(4, "big") + samples.tobytes() + len(fields).to_bytes(2, "big") + entries + b"\0\0\0\0"
    (page,) = media.walk_pages(data)
    assert page[1:5] == (3, 2, 1, 16) and np.frombuffer(page[8], np.uint16).tolist() == [1, 300, 70, 5, 2, 60000]


def test_bad_files():
    good = media.encode_tiff([np.zeros((2, 576), np.uint8)])
    for data in (b"", b"II*\0", b"PK\3\4rest of it", good[:-10], good[:20] + b"\xff" * 20 + good[40:], good[:4] + b"\xff\xff\xff\xff" + good[8:]):
        pages = list(media.walk_pages(data))
        assert pages and pages[-1][0] is None and pages[-1][-1]
    looped = bytearray(good)
    looped[-4:] = looped[4:8]
    pages = list(media.walk_pages(bytes(looped)))
    assert len(pages) == 2 and pages[0][-1] is None and "loop" in pages[1][-1]


def test_pages_of_a_column(spark):
    two = media.encode_tiff([np.zeros((1, 2), np.uint8), np.ones((1, 2), np.uint8)])
    df = spark.createDataFrame([(1, 7, two), (2, 8, None), (3, 9, b"no"), (1, 7, two)], "id int, page int, m binary")
    rows = media.tiff_pages(df, "m", ["id", "page"]).collect()
    assert sorted((r.id, r.page_in, -1 if r.page is None else r.page) for r in rows) == [(1, 7, 0), (1, 7, 0), (1, 7, 1), (1, 7, 1), (3, 9, -1)]
    assert media.tiff_pages(df.limit(0), "m", ["id"]).count() == 0


def wanted(text):
    data = (text or "").encode()
    payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def test_query_and_odd_documents(spark, sf_dir, texts, odd_docs, no_docs):
    rows = queries.op5_tiff(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == wanted(texts[r.doc_id])
    odd = media.op5_tiff(odd_docs).collect()
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in odd))) == sorted(str((r.doc_id, *wanted(r.text))) for r in odd_docs.collect())
    assert media.op5_tiff(no_docs).count() == 0
