"""Packing, token files, media: exact round trips."""

from __future__ import annotations

import glob
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ledgershift.llm import media, packing, token_files
from ledgershift.llm.token_ids import TextIds, text_ids
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text, end):
    return np.array(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40))
def test_cached_ids_equal_the_tokenizer(text):
    own = test_cached_ids_equal_the_tokenizer.__dict__.setdefault("own", TextIds(PATH))
    assert np.frombuffer(own.ids([text.encode()])[0], "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_cache_has_a_bound():
    own = TextIds(PATH, most=3)
    for text in ("a b c d", "e f g h", "a b c d"):
        assert np.frombuffer(own.ids([text.encode()])[0], "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([*"aAhHsTéÉıİΣ5²,.;'*|<>—_ \n\u0331\u030c\u0301\x1c\u2028", "<|endoftext|>", "<|STARTOFTEXT|>", "'S", "Word", "word", "über"]), max_size=30))
def test_folded_and_cut_words_have_the_same_ids(pieces):
    own = text_ids(PATH, 40)
    text = "".join(pieces)
    assert np.frombuffer(own.ids([text.encode()])[0], "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


class Counted:
    """A tokenizer model that counts what it is asked for."""

    def __init__(self, model):
        self.model, self.asked = model, []

    def tokenize(self, part):
        self.asked.append(part)
        return self.model.tokenize(part)


def test_common_words_stay_in_a_full_cache():
    own = TextIds(PATH, most=200)
    own.model = Counted(own.model)
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    common = " ".join("common" + name(k) for k in range(40))
    for k in range(0, 1500, 30):
        text = common + " " + " ".join("rare" + name(k + i) for i in range(30))
        assert np.frombuffer(own.ids([text.encode()])[0], "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(own.model.asked) == len(set(own.model.asked)) == 1540
    assert len(own.words) + len(own.words.older) <= 200


def test_a_word_is_encoded_once_in_capitals_and_before_punctuation():
    own = TextIds(PATH)
    own.model = Counted(own.model)
    for text in ("Wording wording WORDING", "Wording, wording. WORDING; (wording) wording!"):
        assert np.frombuffer(own.ids([text.encode()])[0], "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert own.model.asked.count("wording") == 1


def test_other_tokenizer_files_encode_whole_texts():
    own = TextIds(public_tokenizers.path("byte_bpe_50k.json"))
    text = "Some  spaces\n and words"
    assert not own.by_word and np.frombuffer(own.ids([text.encode()])[0], "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_places_each_id_once(docs, texts):
    rows = packing.pack_documents(docs, PATH, capacity=256, group_tokens=2000).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(ids_of(t, 2))
    for i, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, want[i]))
        if len(want[i]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(want[i][0]) and p.ids_crc32 == zlib.crc32(want[i][0][at : at + p.length])
                at += p.length
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 256


@pytest.mark.parametrize("seed", range(5))
def test_assignment_balances_cost_with_little_padding(seed):
    rnd = random.Random(seed)
    lengths = np.array([rnd.choice([1, 5, 60, 300, 900, 5000]) + rnd.randint(0, 50) for _ in range(200)])
    pieces, costs = packing.assign(lengths, 1024)
    used = defaultdict(int)
    for _, _, n, s in pieces:
        used[s] += n
    assert sum(used.values()) == lengths.sum() and max(used.values()) <= 1024
    assert len(costs) * 1024 - lengths.sum() < 1024
    assert np.std(costs) < 0.5 * np.mean(costs)


def test_packing_nothing(empty):
    assert packing.pack_documents(empty, PATH).count() == 0


def test_token_files_round_trip(spark, docs, texts, tmp_path):
    out = f"file://{tmp_path}/tokens"
    rows = sorted(token_files.token_digests(docs, PATH, 1, out).collect(), key=lambda r: r.start)
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    at = 0
    assert len(rows) == len(order)
    for r, (i, t) in zip(rows, order, strict=True):
        ids = ids_of(t, 1)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids))
        at += len(ids)
    some = {r.doc_id: r.tokens for r in token_files.read_tokens(spark, out, 3, 6).collect()}
    assert sorted(some) == [3, 4, 5] and some[3] == ids_of(texts[3][1], 1).tolist()
    assert sum(r.n_tokens for r in token_files.read_metadata(spark, out).collect()) == at
    meta = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/tokens/*.parquet")]
    column = next(m for m in meta if m.num_rows).row_group(0).column(4)
    assert column.has_column_index and column.has_offset_index and "DELTA_BINARY_PACKED" in column.encodings


def test_token_files_of_nothing(empty, tmp_path):
    assert token_files.token_digests(empty, PATH, 1, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("kind", range(5))
def test_all_png_filters_decode(kind):
    import struct

    rng = np.random.default_rng(kind)
    samples = rng.integers(0, 256, (9, 64), dtype=np.uint8)
    raw = bytearray()
    for y in range(9):
        raw.append(kind)
        for x in range(64):
            left = int(samples[y, x - 1]) if x else 0
            up = int(samples[y - 1, x]) if y else 0
            corner = int(samples[y - 1, x - 1]) if x and y else 0
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            raw.append((int(samples[y, x]) - [0, left, up, (left + up) // 2, paeth][kind]) & 255)
    head = struct.pack(">IIBBBBB", 64, 9, 8, 0, 0, 0, 0)
    png = media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(bytes(raw))) + media._chunk(b"IEND", b"")
    assert (media.decode_png(png) == samples).all()
    assert (media.decode_png(media.encode_png(samples)) == samples).all()


def test_pictures_are_decoded_together():
    """Several pictures at once, of all filters and heights, as each alone."""
    rng = np.random.default_rng(8)
    base = [rng.integers(0, 256, (h, 64)).astype(np.uint8) for h in (1, 2, 70, 3, 1, 300)]
    smooth = [np.cumsum(x % 3, axis=0, dtype=np.uint8) + np.cumsum(x % 2, axis=1, dtype=np.uint8) for x in base]
    pictures = [media.encode_png(x) for x in base + smooth]
    for got, want in zip(media.decode_pngs(pictures), base + smooth, strict=True):
        assert (got == want).all()
    kinds = np.concatenate([media.filtered(x)[0] for x in base + smooth])
    assert len(set(kinds.tolist())) >= 4


def test_png_checksums_are_tested():
    png = bytearray(media.encode_png(np.arange(128, dtype=np.uint8).reshape(2, 64)))
    for at in (20, 45, len(png) - 3):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        media.decode_png(bytes(png[:-6]))


def test_media_rows(docs, texts):
    import hashlib

    rows = sorted(media.media_features(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_bytes))
    order = sorted(texts, key=lambda x: (x[0] is None, x[0] or 0, len((x[1] or "").encode())))
    for r, (i, t) in zip(rows, order, strict=True):
        data = media.payload((t or "").encode())
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len((t or "").encode()), len(data)) and len(data) % 64 == 0 and data
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-64:]) and len(r.feature) == 16


def test_media_of_nothing(empty):
    assert media.media_features(empty).count() == 0
