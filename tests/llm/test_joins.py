"""N-gram join and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from ledgershift.llm import kernels, ngram_join, substring_dedup
from ledgershift.llm.graph import components
from ledgershift.llm.ngram_join import near_duplicates

SIMPLE = "doc_id long, text string"


def split(text):
    return (text or "").encode().split()


def shingle_set(text):
    w = split(text)
    w = [x.lower() for x in w]
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    ids = [2**63 - 1 if i is None else i for i, _ in rows]
    least = defaultdict(lambda: 2**63 - 1)
    for g, i in zip(group, ids, strict=True):
        least[g] = min(least[g], i)
    return sorted((i, len(s), least[g]) for i, s, g in zip(ids, sets, group, strict=True))


def check_join(rows, out):
    got = sorted((2**63 - 1 if r.doc_id is None else r.doc_id, r.n_shingles, 2**63 - 1 if r.component_id is None else r.component_id) for r in out.collect())
    assert got == brute_components(rows)


def brute_removed(rows):
    first = {}
    rows = [(2**63 - 1 if i is None else i, t) for i, t in rows]
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, 2**63), i)
    out = []
    for i, t in rows:
        w = split(t)
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check_removed(rows, out):
    got = sorted((2**63 - 1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect())
    assert got == brute_removed(rows)


def mutated(seed: int, n: int = 90):
    rnd = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(400)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.randint(8, 160))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 9])):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        if rnd.random() < 0.3:
            w = w[: rnd.randint(1, len(w))] + rnd.choice(bases)[: rnd.randint(0, 80)]
        rows.append((i * 7 % 97, " ".join(w)))
    return rows


def test_join_on_awkward_documents(docs, texts):
    check_join(texts, near_duplicates(docs))


def test_join_finds_every_link_in_mutated_families(spark):
    rows = mutated(1)
    docs = spark.createDataFrame(rows, SIMPLE)
    check_join(rows, near_duplicates(docs, rare=2, buckets=16, block=8))
    check_join(rows, near_duplicates(docs, buckets=16))


def test_join_of_nothing(empty):
    assert near_duplicates(empty).count() == 0


def test_substrings_on_awkward_documents(docs, texts):
    check_removed(texts, substring_dedup.remove_repeats(docs))


def test_substrings_in_mutated_families_and_in_increments(spark):
    rows = sorted(mutated(2, 60))
    check_removed(rows, substring_dedup.ingest(spark.createDataFrame(rows, SIMPLE), batches=3, buckets=16)[0])
    old, new = spark.createDataFrame(rows[:30], SIMPLE), spark.createDataFrame(rows[30:], SIMPLE)
    first, index = substring_dedup.ingest(old, batches=2, buckets=16)
    index = substring_dedup.write_index(index)
    second, _ = substring_dedup.ingest(new, index=index, history=old, batches=1, buckets=16)
    check_removed(rows, first.union(second))


def test_substrings_keep_texts_and_other_columns(docs, texts):
    out = {r.key: r for r in substring_dedup.ingest(docs, keep_texts=True, buckets=16)[0].collect()}
    gone = {1, 2, 3, 11, 12, 16}  # whole copies of document 0 need not stay
    assert set(range(len(texts))) - gone <= set(out) and out[0].text == texts[0][1] and out[0].block == "b"
    assert 11 not in out and len(out[5].text.split()) == len(texts[5][1].split()) - 70


def test_substrings_pass_clashing_columns(spark, texts):
    rows = [(i, t, k, k, k, k) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, n_removed int, windows int, code int")
    out = substring_dedup.remove_repeats(docs, keep_texts=True)
    assert out.columns == docs.columns and {r.code for r in out.collect()} <= set(range(len(texts)))
    check_removed(texts, substring_dedup.remove_repeats(docs, increments=3))


def test_merge_is_the_sorted_union():
    """A merge equals sorting both together, with the least document of each entry."""
    rng = np.random.default_rng(3)
    make = lambda n, low: (rng.integers(0, 40, n).astype(np.uint64), rng.integers(0, 3, n).astype(np.uint64), (low + rng.integers(0, 50, n)).astype(np.int64))
    run = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    seen = {}
    for low in (0, 100, 50, 200):
        f, c, doc = make(80, low)
        order = np.lexsort((doc, c, f))
        before = dict(seen)
        run, late, check = substring_dedup._merge(run, [f[order], c[order], doc[order]])
        for a, b, d in zip(f.tolist(), c.tolist(), doc.tolist(), strict=True):
            seen[a, b] = min(d, seen.get((a, b), d))
        assert list(zip(run[0].tolist(), run[1].tolist(), strict=True)) == sorted(seen) and run[2].tolist() == [seen[k] for k in sorted(seen)]
        assert sorted(late[0].tolist()) == sorted(d for a, b, d in zip(f.tolist(), c.tolist(), doc.tolist(), strict=True) if d > seen[a, b])
        fresh = {a for a, b in seen if before.get((a, b)) != seen[a, b]}
        assert len(check[0]) == sum(a in fresh and sum(x == a for x, _ in seen) > 1 for a, _ in seen)


def test_texts_longer_than_a_block(spark, words):
    """A text of over 4 MB is a block alone; what it shares with a short one goes, what it has alone stays."""
    passage = " ".join(words(77, 60))
    long = " ".join(f"w{i}" for i in range(620_000))
    rows = [(1, f"{passage} tail"), (2, f"{long} {passage}"), (3, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {1: (61, 0), 2: (620_060, 60), 3: (620_000, 620_000)}
    links = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, counts=False).collect()}
    assert links == {1: (57, 1), 2: (620_056, 2), 3: (619_996, 2)}


def test_hot_keys_are_joined_like_others(spark):
    from ledgershift.llm.common import join_hot, materialize

    rows = materialize(spark.range(2000).selectExpr("id", "CASE WHEN id < 1500 THEN 0 ELSE id END AS k"), "hot-test")
    right = spark.createDataFrame([(0, "a"), (1600, "b"), (1, "c")], "k long, x string")
    got = join_hot(rows, right, "k", share=10)
    assert got.groupBy("x").count().collect() and {r.x: r["count"] for r in got.groupBy("x").count().collect()} == {"a": 1500, "b": 1}


def test_substrings_of_nothing(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (21, 20)]
    got = {r.v: r.c for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {v: got.get(v, v) for v in (1, 2, 3, 7, 8, 9, 20, 21)} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


def test_word_hashes_follow_words_only():
    data = pa.record_batch({"text": ["a B  c\n", "", None, "x" * 600 + " é\x0bq", "b c", "  a"]})
    w = kernels.hash_words(*kernels.text_buffer(data.column(0)), lower=True)
    assert np.diff(w.first).tolist() == [3, 0, 0, 3, 2, 2]
    assert w.hash[1] == w.hash[6] and w.hash[0] == w.hash[9] and len(set(w.hash.tolist())) == 7
    assert [b.num_rows for b in kernels.blocks([data], size=5)] == [1, 2, 1, 1, 1] or sum(b.num_rows for b in kernels.blocks([data], size=5)) == 6


@pytest.mark.parametrize("rare, block", [(64, 1024), (2, 8)])
def test_join_counts_every_link(spark, rare, block):
    """Links between different set classes, by brute force; five texts that are all alike have ten."""
    long = [f"q{i}" for i in range(300)]
    rows = mutated(3) + [(100 + k, " ".join([*long[: 50 * k + 20], f"new{k}", *long[50 * k + 20 :]])) for k in range(5)] + [(200, " ".join(long)), (201, " ".join(long))]
    docs = spark.createDataFrame(rows, SIMPLE)
    out = near_duplicates(docs, rare=rare, buckets=16, block=block)
    check_join(rows, out)
    check_join(rows, near_duplicates(docs, rare=rare, buckets=16, block=block, counts=False))
    sets = {shingle_set(t) for _, t in rows}
    links = {s: sum(x != s and 100 * len(x & s) >= 75 * len(x | s) for x in sets if s) for s in sets}
    assert sorted((r.doc_id, r.n_links) for r in out.collect()) == sorted((i, links[shingle_set(t)]) for i, t in rows)
    assert [links[shingle_set(t)] for i, t in rows if 100 <= i < 105] == [5] * 5


@pytest.mark.parametrize("counts", [True, False])
def test_join_cuts_groups_of_long_texts_by_bytes(spark, monkeypatch, counts):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 2048)
    rows = mutated(19)
    docs = spark.createDataFrame(rows, SIMPLE).repartition(3)
    check_join(rows, near_duplicates(docs, rare=2, buckets=16, counts=counts))


@pytest.mark.parametrize("first_buckets, second_buckets", [(None, None), (64, 16), (16, 64)])
def test_increments_with_another_number_of_buckets(spark, first_buckets, second_buckets):
    """An index of many splits takes a small increment: passages that stand in history still go."""
    rows = sorted(mutated(2, 60))
    old, new = spark.createDataFrame(rows[:30], SIMPLE), spark.createDataFrame(rows[30:], SIMPLE)
    base = old if first_buckets else old.repartition(300)
    first, index = substring_dedup.ingest(base, batches=1, buckets=first_buckets)
    index = substring_dedup.write_index(index)
    second, grown = substring_dedup.ingest(new, index=index, history=old, batches=1, buckets=second_buckets)
    check_removed(rows, first.union(second))
    assert {r.bits for r in grown.select("bits").collect()} == {(second_buckets or 2048).bit_length() - 1}


def test_an_index_without_its_history_is_refused(spark):
    docs = spark.createDataFrame([(1, "a b c")], SIMPLE)
    _, index = substring_dedup.ingest(docs, batches=1, buckets=16)
    with pytest.raises(ValueError, match="history"):
        substring_dedup.ingest(docs, index=index, batches=1, buckets=16)
