"""Byte-pair encoding and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rollcall.llm import bpe, packing

ALPHABET = "ab  c'st' \n\t é中文1२٣½!?\x1c\x85 ́Σ😀ǅ.,"


def texts():
    rng = random.Random(4)
    out = ["", " ", "a", "  two  spaces ", "it's\r\nso.\n\nNext<|endoftext|> x <|endoftext|>", "x" * 5000, "ab" * 9000 + " end",
           "Straße ÉCOLE İ ſ ª ²", "<|startoftext|>A<|endoftext|>"]
    for k in range(300):
        s = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40)))
        out.append(s * (60 if k % 50 == 0 else 1))
    return out


@pytest.mark.parametrize("name, make", [("byte_bpe_50k.json", bpe.Codec), ("word_bpe_49k.json", packing.WordCodec)])
def test_ids_are_the_librarys(name, make):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), make(path)
    for text, got in zip(texts(), own.encode(texts()), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text)
        if make is bpe.Codec:
            assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_decode_mends_broken_text():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.Codec(path)
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(20)]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_heap_and_matrix_merge_alike(monkeypatch):
    own = bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    words = [t.encode() for t in texts() if 0 < len(t) < 90]
    matrix = own.merges.encode(words)
    monkeypatch.setattr(bpe, "LONG", 0)
    assert own.merges.encode(words) == matrix


def test_encode_decode_tables(spark):
    rows = [(1, "it is", "x"), (1, "it is", "x"), (None, "né ", None), (3, None, ""), (4, "", "y"), (5, "long " * 30000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    enc = bpe.encode(docs)
    assert enc.columns == ["doc_id", "ids"]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in bpe.decode(enc).collect())
    assert got == sorted((i or 0, t or "") for i, t, _ in rows)
    trip = {r["doc_id"]: r["n_tokens"] for r in bpe.round_trip(docs).collect()}
    assert trip[3] == trip[4] == 0 and trip[5] >= 30000
    assert bpe.round_trip(docs.limit(0)).count() == bpe.encode(docs.limit(0)).count() == 0


def check_places(rows, size):
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by) == list(range(len(by)))
    for held in by.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by)


def test_pack_documents(spark):
    rows = [(i, "word and more " * (i * 13 % 400), "k", -1) for i in range(120)]
    rows += [(500, None, "n", 0), (501, "", "e", 0), (None, "no id", "n", 0), (7, rows[7][1], "again", 0), (600, "very long " * 9000, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, offset int")
    packed = packing.pack_documents(docs).collect()
    n = check_places(packed, 4096)
    total = sum(r["length"] for r in packed)
    assert n == -(-total // 4096)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((-1 if i is None else i, tuple(library.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, *_ in rows)
    parts: dict = {}
    for r in sorted(packed, key=lambda r: r["start"]):
        parts.setdefault((r["doc_id"] if r["doc_id"] is not None else -1, r["doc_tokens"]), []).append(r)
    for i, ids in want:
        mine = parts[i, len(ids)]
        starts = sorted({r["start"] for r in mine})
        assert starts == list(range(0, len(ids), 4096))
        for r in mine:
            assert tuple(r["ids"]) == ids[r["start"] : r["start"] + r["length"]]
    digests = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in packing.pack_documents(docs, digest=True).collect()}
    for r in packed:
        assert digests[r["doc_id"], r["start"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    lengths = {r["sequence_id"]: len(r["ids"]) for r in packing.sequences(packing.pack_documents(docs)).collect()}
    assert sum(lengths.values()) == total and max(lengths.values()) <= 4096
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_hot_length_is_ranked_in_groups(spark):
    rows = spark.range(9000).selectExpr("id as doc_id", "0L as start", "case when id % 3 = 0 then 7 else id % 50 + 1 end as length")
    n = check_places(packing.pack(rows, 64).collect(), 64)
    total = rows.groupBy().sum("length").first()[0]
    assert n <= total / 64 * 1.02 + 1


def test_shortest_pack_first_holds_the_histogram():
    rng = random.Random(1)
    for _ in range(50):
        size = rng.choice([10, 64, 4096])
        hist = {rng.randint(1, size): rng.randint(1, 500) for _ in range(rng.randint(1, 60))}
        got: dict = {}
        patterns = packing.shortest_pack_first(hist, size)
        for packs, pattern in patterns:
            assert packs > 0 and sum(a * b for a, b in pattern) <= size
            for length, times in pattern:
                got[length] = got.get(length, 0) + packs * times
        assert got == hist and len(patterns) <= 3 * len(hist)


def test_plain_words_are_learnt_without_pattern_or_collector():
    import gc

    codec = packing.WordCodec(packing.default_vocabulary())
    asked, runs, was = [], [], gc.get_threshold()

    class Counted:
        def fullmatch(self, unit):
            asked.append(unit)
            return pattern.fullmatch(unit)

    pattern, codec.plain = codec.plain, Counted()
    texts = ["Plain words, and More words. " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)),
             "naïve \x07bell a\x7fb Ünder, İx 3.14 don't x, , . ĳ"]
    # Letters and their marks need no pattern; the others are as the library has them.
    gc.callbacks.append(lambda phase, info: runs.append(phase))
    try:
        gc.set_threshold(50)
        found = codec.encode(texts)
    finally:
        gc.set_threshold(*was)
        gc.callbacks.pop()
    assert gc.isenabled()
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [
        codec.library.encode(t, add_special_tokens=False).ids for t in texts
    ]
    assert not {u for u in asked if u.isascii() and u.rstrip(",.").isalpha()}
    # At most the collection that turning it on again lets happen.
    assert len(runs) <= 4
