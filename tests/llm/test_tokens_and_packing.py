import json
import random
import struct
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rastrel.llm import packing, repair, tokens
from tests.conftest import DATA
from tests.llm.cases import documents, empty, odd

FILES = [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)]
PIECES = [" the", "\nThe", ".\nA", "\n\n", " ", "  ", "\n", " \n", "\t", "a", "Word", "é", "é", "1", "23", "'s", "'", "!", "...", ".", ",", " ", "　", "\x1c", "́", "Σ", "ς", "İ", "<|endoftext|>", "​", "᠎", "日本", "🙂", "\r\n", "\x85", "don't", "﻿", "ſ", "K", "\x00", "T̈", " T̈.", "x" * 60, "Été", " straße", " µm", " ªº", " ÀÉÎÕÜ.", "ÿÝ", "Ǆ", " naïve,", " ñandú", " I", " À"]


def reference(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize(("name", "blanks"), FILES)
@pytest.mark.parametrize("block", [1 << 20, 3])
def test_encoder_equals_the_library(name, blanks, block, monkeypatch):
    monkeypatch.setattr(tokens, "_BLOCK", block)
    rng = random.Random(3)
    texts = [None, ""] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    want = reference(name)
    assert list(tokens.Encoder(public_tokenizers.path(name), blanks, 40 if block == 3 else 1000).encode_many(texts)) == [want(t or "") for t in texts]


@pytest.mark.parametrize(("name", "blanks"), FILES)
def test_markers_are_their_own_ids(name, blanks):
    want, encode = reference(name), tokens.Encoder(public_tokenizers.path(name), blanks)
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", " <|startoftext|>\nx ", "<|ENDOFTEXT|> y", "<|endoftext| >", "é<|endoftext|>\u0301 z", "x <|endoftext|>  "]
    assert list(encode.encode_many(texts)) == [want(t) for t in texts]


def test_files_of_unknown_cutting_go_to_the_library(tmp_path):
    made = json.loads(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())
    made["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(made))
    own = Tokenizer.from_file(str(tmp_path / "other.json"))
    texts = ["hello there", "", " two\nlines <|endoftext|> of  text", None]
    got = list(tokens.Encoder(str(tmp_path / "other.json"), True).encode_many(texts))
    assert got == [np.array(own.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    made = json.loads(Path(public_tokenizers.path("word_bpe_49k.json")).read_text())
    got = list(tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), True).encode_many(texts))  # not a file that keeps its blanks
    assert got == [reference("word_bpe_49k.json")(t or "") for t in texts]


def test_cuts_cover_and_waste_little():
    for n in [0, 1, 31, 32, 33, 63, 64, 1023, 1024, 1025, 2047, 2048, 2049, 5000, *range(100, 2048, 7)]:
        lengths = packing.cuts(n)
        assert sum(lengths) == n and all(x > 0 for x in lengths)
        assert all((2048 // x) * x >= 2048 - 48 for x in lengths)


def check_pieces(rows, texts):
    """rows of the query against the texts (doc_id, text): every id once, in its place, sequences gapless."""
    want = reference("word_bpe_49k.json")
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    expected = defaultdict(list)
    for doc_id, text in texts:
        expected[doc_id].append(want(text or "") + struct.pack("<I", 1))
    assert set(by_doc) == set(expected)
    for doc_id, pieces in by_doc.items():
        assert sum(p["length"] for p in pieces) == sum(len(x) // 4 for x in expected[doc_id])
        for ids in expected[doc_id]:
            own = sorted((p["start"], p["length"], p["ids_crc32"]) for p in pieces if p["doc_tokens"] == len(ids) // 4)
            assert {(s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for s, n, _ in own} >= ({x for x in own} if len(expected[doc_id]) == 1 else set())
            at = 0
            for s, n, _ in sorted(set(own)):
                if len(expected[doc_id]) == 1:
                    assert s == at
                    at = s + n
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.02 * total


def test_packing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    check_pieces(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])
    check_pieces(packing.pack(odd(spark), public_tokenizers.path("word_bpe_49k.json")).collect(), [tuple(r) for r in odd(spark).select("doc_id", "text").collect()])
    assert packing.pack(empty(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0
    some = packing.pack(documents(spark, [(1, "hello there")]), public_tokenizers.path("word_bpe_49k.json"), with_ids=True).collect()
    ids = [x for r in sorted(some, key=lambda r: r["start"]) for x in r["ids"]]
    assert np.array(ids, "<u4").tobytes() == reference("word_bpe_49k.json")("hello there") + b"\1\0\0\0"


def test_classes_hold_a_fixed_count():
    rng = random.Random(1)
    lengths = [rng.randint(1, 5000) for _ in range(3000)]
    for k, pieces in packing.harmonic_bins((i, bytes(4 * n)) for i, n in enumerate(lengths)):
        assert not k or len(pieces) == k and all(2048 // (len(p.ids) // 4) == k for p in pieces)


@pytest.mark.parametrize("shard_tokens", [50, 1 << 20])
def test_repair_round_trip(spark, shard_tokens):
    rng = random.Random(2)
    docs = [[rng.choice([0, 1, 2, 2, 2, 7, 50256]) for _ in range(rng.randint(1, 400))] for _ in range(60)] + [[5] * 1000, [0]]
    data = [np.array(d, "<u4").tobytes() for d in docs]
    packed = repair.write_shard([None, *range(1, len(docs))], data, 50257)
    shard = repair.read_shard(packed)
    assert shard.doc_ids[:2] == [None, 1] and len(shard.rules) > 0
    assert [shard.document(i).tolist() for i in range(len(docs))] == docs
    assert shard.every().tolist() == [x for d in docs for x in d]
    for j in range(len(shard.rules)):
        assert len(repair.expand(np.array([shard.base + j]), shard.rules, shard.base)) == shard.lengths[j]
    for i, d in enumerate(docs):
        for start, n in ((0, 1), (len(d) // 3, 7), (len(d) - 1, 5), (0, len(d)), (len(d), 2)):
            assert shard.tokens_at(i, start, n).tolist() == d[start : start + n]
    with pytest.raises(ValueError):
        repair.read_shard(packed[:-5] + b"xxxxx")
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    stored = repair.shards(table, public_tokenizers.path("byte_bpe_50k.json"), shard_tokens=shard_tokens)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in repair.read_documents(stored).collect()}
    want = reference("byte_bpe_50k.json")
    for doc_id, text in table.select("doc_id", "text").collect():
        ids = want(text or "") + bytes(4)
        assert got[doc_id] == (len(ids) // 4, zlib.crc32(ids))


def test_stored_order(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for table in (spark.read.parquet(f"{DATA}/documents.parquet").repartition(7), odd(spark)):
        got = repair.store_and_read(table, path).collect()
        assert len(got) == table.count()
        at, last = 0, -1
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at and (r["doc_id"] is None or r["doc_id"] >= last)
            at, last = at + r["n_tokens"], r["doc_id"] if r["doc_id"] is not None else last
    assert repair.store_and_read(empty(spark), path).count() == 0


@pytest.mark.parametrize("base", [50257, 70000])
def test_no_frequent_pair_is_left(base):
    rng = np.random.default_rng(4)
    copies = np.tile(rng.integers(0, 50257, 1000), 40)
    ends = np.arange(1, copies.size + 1) % 1000 == 0
    codes, _, rules = repair._compress(copies, ends, base)
    assert codes.size == 40 and repair.expand(codes, rules, base).tolist() == copies.tolist()
    ids = (rng.pareto(0.6, 200_000) * 3).clip(0, 50256).astype(np.int64)
    ends = rng.random(ids.size) < 0.01
    ends[-1] = True
    codes, ends, rules = repair._compress(ids.copy(), ends, base)
    inside = np.stack([codes[:-1], codes[1:]], axis=1)[~ends[:-1]]
    _, counts = np.unique(inside, axis=0, return_counts=True)
    assert repair.expand(codes, rules, base).tolist() == ids.tolist()
    assert counts.max() < repair.LEAST


def test_symbols_beyond_16_bits():
    rng = np.random.default_rng(5)
    pairs = rng.integers(0, 50257, (20_000, 2))
    ids = np.tile(pairs, (8, 1)).reshape(-1)
    docs = [ids[2 * k : 2 * k + 2].astype("<u4").tobytes() for k in range(ids.size // 2)]
    shard = repair.read_shard(repair.write_shard(list(range(len(docs))), docs, 50257))
    assert len(shard.rules) > 15_278 and shard.codes.size == len(docs) and shard.every().tolist() == ids.tolist()
