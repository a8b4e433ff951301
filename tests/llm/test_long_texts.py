"""Texts longer than a block of the kernels: every operator takes them whole, beside short ones and a copy."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from ledgershift.llm import importance, line_rules, media, mixing, packing, token_files, toxicity
from tokenizers import Tokenizer

MODEL = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def long_texts():
    text = " ".join(f"word{i * 7919 % 100_003:06d}end{i % 11}" for i in range(300_000)) + "\nlast line here"
    assert len(text) > 4 << 20
    return {1: text, 2: "a short one", 3: text, 4: None}


@pytest.fixture(scope="module")
def long_docs(spark, long_texts):
    rows = [(i, t, "s") for i, t in long_texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)


@pytest.fixture(scope="module")
def long_ids(long_texts):
    tokenizer = Tokenizer.from_file(str(MODEL))
    return {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4") for i, t in long_texts.items() if i != 3}


def test_tokens_and_pieces(long_docs, long_ids):
    out = {r.doc_id: r for r in token_files.token_digests(long_docs, MODEL).collect()}
    for i, ids in long_ids.items():
        assert (out[i].n_tokens, out[i].ids_crc32) == (len(ids) + 1, zlib.crc32(np.append(ids, 1).astype("<u4").tobytes()))
    assert out[3].ids_crc32 == out[1].ids_crc32
    pieces = sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packing.pack_documents(long_docs, MODEL, end_id=2).collect())
    for i, ids in long_ids.items():
        every, at = np.append(ids, 2).astype("<u4"), 0
        for _, start, length, crc, total in (p for p in pieces if p[0] == i):
            assert (start, total) == (at, len(every)) and length <= 4096 and crc == zlib.crc32(every[at : at + length].tobytes())
            at += length
        assert at == len(every)


def test_rules_and_sizes(long_docs, long_texts):
    n = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in long_texts.items()}
    assert {r.doc_id: r.n_words for r in line_rules.quality_rules(long_docs).collect()} == n
    assert {r.doc_id: r["size"] for r in mixing.mix_plan(long_docs).collect()} == n


def test_pictures(long_docs, long_texts):
    out = {r.doc_id: r for r in media.media_features(long_docs).collect()}
    data = long_texts[1].encode()
    data += b"\0" * (-len(data) % 64)
    assert out[1].payload_sha256 == hashlib.sha256(data).hexdigest() and (out[1].media_sha256, out[1].feature) == (out[3].media_sha256, out[3].feature)


def test_scores(spark, long_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r for r in importance.resample(long_docs, labels, columns=("doc_id",)).collect()}
    assert len(kept) == 4 and kept[1].log_ratio == kept[3].log_ratio > 0 == kept[4].log_ratio > kept[2].log_ratio
    scores = {r.doc_id: r.score for r in toxicity.toxicity(long_docs, labels).collect()}
    assert scores[1] == scores[3] and all(0 <= s <= 1 for s in scores.values())
