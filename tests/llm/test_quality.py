"""Line rules, chat formatting, mixing, classifiers and the pipeline."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from ledgershift.llm import chat, importance, line_rules, mixing, toxicity
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts(docs, texts):
    rows = line_rules.quality_rules(docs).collect()
    want = Counter((i, *brute_rules(t)) for i, t in texts)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (not r.base_failed or not r.kept)


def test_frequent_lines_deplete_documents(spark, words):
    footer = " ".join(words(40, 80))
    rows = [(i, " ".join(words(100 + i, 60)) + "\n" + footer + f" {i}!", "host") for i in range(30)] + [(99, " ".join(words(7, 200)) + "\n" + footer, "host"), (100, footer, "other")]
    got = {r.doc_id: r for r in line_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), least_docs=5, percent=10).collect()}
    assert got[0].removed_words == 81 and not got[0].kept and got[99].removed_words == 80 and got[99].kept
    assert got[100].removed_words == 0 and got[100].kept


def test_line_rules_of_nothing(empty):
    assert line_rules.quality_rules(empty).count() == 0


def test_roles_with_any_character(spark):
    roles = ["a\x00b", "\\n", "\n\\", "\\b\n", "<|im_end|>\n", ""]
    df = spark.createDataFrame([(k, 0, r, "x") for k, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r.turns_sha256 for r in chat.read_back(chat.format_chats(chat.canonical_turns(chat.conversation_records(df)))).collect()}
    assert out == {k: hashlib.sha256(f"{r}\nx\n".encode()).hexdigest() for k, r in enumerate(roles)}


def test_fingerprints_follow_what_is_filled_inside(spark):
    kind = "conv_id long, messages array<struct<role:string,content:string,name:string>>, fingerprint int"
    rows = [(1, [("user", "q", None), ("assistant", "a", None)], 7), (2, [("user", "q", "bob")], 7), (3, [(None, "q", None)], 7), (4, [], 7), (5, None, 7)]
    out = {r.conv_id: r for r in chat.canonical_turns(spark.createDataFrame(rows, kind), keep=("fingerprint",)).collect()}
    turns = {k: r.turns and [(t.role, t.text) for t in r.turns] for k, r in out.items()}
    assert turns == {1: [("user", "q"), ("assistant", "a")], 2: None, 3: [("", "q")], 4: [], 5: None}
    assert len({out[k].fingerprint for k in (1, 2, 3, 4, 5)}) == 5
    plain = spark.createDataFrame([(1, "text")], "conv_id long, messages string")
    assert chat.canonical_turns(plain).first().turns is None


TRICKY = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s> <|im_end|>\n<|im_start|>user\n", "", None, "[[INST]] <<SYS>> <</SYS>>", "line\nline", "a\\nb", "<|<s>|>"]


def test_chats_round_trip(spark):
    rows = [(c, t, r, x) for c, (r, x) in enumerate([("user", TRICKY)] * 1) for t, r, x in [(k, "assistant" if k % 2 else "user", y) for k, y in enumerate(x)]]
    rows += [(5, 0, None, "no role"), (5, 1, "odd\nrole\\n", "x"), (6, 0, "assistant", "same"), (6, 0, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.canonical_turns(chat.conversation_records(df)))).collect()}
    by = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda y: (y[0], y[1], y[2] or "", y[3] or "")):
        by[c].append((r or "", x or ""))
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert out[c].n_turns == len(turns)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_layouts_are_told_by_their_field_paths(spark):
    rows = [
        (1, "p", "c", None, None, None, None),
        (2, None, None, "do", "in", "out", None),
        (3, None, None, "do", None, "out", None),
        (4, None, None, None, None, None, [("human", "q"), ("gpt", "a")]),
        (5, "p", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, prompt string, completion string, instruction string, input string, output string, conversations array<struct<from:string,value:string>>")
    got = {r.conv_id: r.turns and [(t.role, t.text) for t in r.turns] for r in chat.canonical_turns(df).collect()}
    assert got[1] == [("user", "p"), ("assistant", "c")] and got[2] == [("user", "do"), ("user", "in"), ("assistant", "out")]
    assert got[3] == [("user", "do"), ("assistant", "out")] and got[4] == [("user", "q"), ("assistant", "a")] and got[5] is None


def test_chats_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chats(chat.canonical_turns(chat.conversation_records(none)))).count() == 0


def brute_targets(sizes, weights):
    """Share by weight; stop the ones above twice their size; share the rest again."""
    need, open_, out = 1.5 * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if need * weights[i] / total > 2 * sizes[i]]
        if not over:
            for i in open_:
                out[i] = need * weights[i] / total
            break
        for i in over:
            out[i] = 2.0 * sizes[i]
        need -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return out


def test_mix_meets_its_targets(docs, texts):
    rows = mixing.mix_plan(docs).collect()
    source = {k: None if k % 7 == 3 else f"s{k % 3}" for k in range(len(texts))}
    size = defaultdict(int)
    for k, (_, t) in enumerate(texts):
        size[source[k]] += len(WORD.findall(t or ""))
    names = sorted((s for s in size if s), key=lambda s: s.encode()) + [None]
    want = dict(zip(names, brute_targets([size[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True))
    taken, of = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        of[r.source_size, round(r.target, 6)] = 1
        taken[r.source_size, round(r.target, 6)] += r.taken
        assert r.position is None or 0 <= r.position <= 1
    assert sorted(of) == sorted((size[n], round(want[n], 6)) for n in names if any(source[k] == n for k in source))
    for (_, target), words in taken.items():
        assert abs(words - target) < 1
    again = mixing.mix_plan(docs).collect()
    assert sorted((r.doc_id or -1, r.size, r.taken, r.position or 0) for r in again) == sorted((r.doc_id or -1, r.size, r.taken, r.position or 0) for r in rows)


def test_mixed_documents_hold_the_taken_words(docs):
    """Repeated rows, null ids and ties included: each row has a place of its own."""
    plan = mixing.mix_plan(docs).agg(F.sum("taken")).first()[0]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == plan


def test_mix_positions_by_hand(spark):
    """Two sources: the running sums in the order of the hash give each document its share of the demand, and that its time."""
    rows = [(i, " ".join(["w"] * (3 + i % 5)), "ab"[i % 2]) for i in range(40)]
    got = {r.doc_id: r for r in mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for k, source in enumerate("ab"):
        mine = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, len(t.split())) for i, t, s in rows if s == source)
        size, target = sum(x[2] for x in mine), got[mine[0][1]].target
        a, b = mixing.SCHEDULES[k]
        for epoch, name in enumerate(("position", "again_position")):
            at = size * epoch
            for _, i, n in mine:
                take = max(0, min(n, int(target) - at))
                due = getattr(got[i], name)
                if take:
                    assert abs(a * due + (b - a) * due**2 / 2 - (at + take / 2) / target * (a + b) / 2) < 1e-9
                else:
                    assert due is None
                at += n


def test_mix_passes_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 1, 2, 3), (2, None, None, 1, 2, 3)], "doc_id long, text string, source string, _row int, takes int, size int")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and {(r.doc_id, r.size) for r in out.collect()} == {(1, 3)}


def test_positions_follow_the_schedule(spark):
    rows = spark.createDataFrame([(float(i) / 100, k) for i in range(101) for k in (0, 1, 2)], "at double, weight_no int")
    got = rows.withColumn("t", mixing._position(F.col("at"), mixing.SCHEDULES)).collect()
    for r in got:
        a, b = mixing.SCHEDULES[r.weight_no]
        assert abs(a * r.t + (b - a) * r.t**2 / 2 - r.at * (a + b) / 2) < 1e-9


def test_mix_of_nothing(empty):
    assert mixing.mix_plan(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_importance_rejects_junk_and_keeps_clean(spark, words):
    known = words(1, 60)
    clean = [(i, " ".join(known[(i * k) % 60] for k in range(1, 31)).capitalize() + ".") for i in range(120)]
    junk = [(1000 + i, " ".join(f"{known[(i * k) % 60]}***" for k in range(1, 31))) for i in range(40)]
    docs = spark.createDataFrame([*clean, *junk, (5000, ""), (5001, None), (None, "some words")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(1000 + i, 0) for i in range(20)] + [(1000, 0), (None, 1)], "doc_id long, quality int")
    rows = importance.resample(docs.withColumn("kept", F.lit(1)), labels).collect()
    assert all(r.kept for r in rows if r.doc_id is not None and r.doc_id < 1000)
    share = 60 / 80 + importance.ERRORS * (0.75 * 0.25 / 80) ** 0.5
    assert sum(r.kept for r in rows) == round(share * len(rows))  # the budget: junk fills what clean texts leave
    assert len(rows) == 163 and {r.log_ratio for r in rows if r.doc_id in (5000, 5001)} == {0.0}


def test_importance_by_hand(spark, words):
    """Counts, log ratios and the drawn set against plain loops over the same n-grams."""
    import pyarrow as pa

    texts = [" ".join(words(i, 20 + i % 7)) + ("!!! ###" if i % 4 == 0 else ".") for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 60, 2)], "doc_id long, quality int")
    raw, good, per = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS), []
    for i, t in enumerate(texts):
        f, _ = importance.features(pa.array([t]))
        per.append(f)
        for x in f.tolist():
            raw[x] += 1
            good[x] += i % 2 == 0 and i % 4 != 0
    common = good.sum() / raw.sum()
    ratio = np.log((good + importance.PRIOR * common) / ((raw + importance.PRIOR) * common))
    rows = {r.doc_id: r for r in importance.resample(docs, labels).collect()}
    for i, f in enumerate(per):
        assert abs(rows[i].log_ratio - ratio[f].mean()) < 1e-8
    p, n = 15 / 30, 30
    k = round(60 * (p + importance.ERRORS * (p * (1 - p) / n) ** 0.5))
    assert {i for i, r in rows.items() if r.kept} == set(sorted(rows, key=lambda i: -rows[i].sampling_key)[:k])
    assert any(rows[i].kept for i in rows if rows[i].log_ratio < np.median([r.log_ratio for r in rows.values()]))


def test_splits_of_blank_texts(spark):
    """Blocks that hold only empty, null or blank texts."""
    rows = [(i, t) for i, t in enumerate(["", None, " \t"] * 4)] + [(99, "one two three"), (98, "one *** ###")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(14, "doc_id").withColumn("source", F.lit("s"))
    labels = spark.createDataFrame([(99, 1, 0), (98, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r.log_ratio for r in importance.resample(docs, labels).collect() if r.doc_id < 90} == {0.0}
    assert toxicity.toxicity(docs, labels).count() == line_rules.quality_rules(docs).count() == mixing.mix_plan(docs).count() == 14


def test_importance_without_labels_or_documents(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept for r in importance.resample(docs, none).collect())
    assert importance.resample(empty, none).count() == 0


@pytest.mark.parametrize("k", [1, 7, 500, 999, 1000])
def test_kth_key_is_exact(spark, k):
    rng = np.random.default_rng(5)
    keys = np.round(np.concatenate([rng.normal(size=900) * 100, np.repeat(3.5, 100)]), 3)
    got = importance._kth_largest(spark.createDataFrame([(float(x),) for x in keys], "key double"), k, bins=16)
    assert got == np.sort(keys)[::-1][k - 1]


def test_toxic_words_and_beginnings_are_learnt(spark, words):
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        w = words(i, 25)
        if bad:
            w[i % 20] = ("blarg", f"zork{w[0][1:3]}")[i % 2]
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "blarg")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [i for i in range(400) if out[i].held_out]
    assert 40 < len(held) < 120
    right = sum(out[i].predicted == int(i % 5 == 0) for i in held)
    assert right >= 0.95 * len(held)
    assert out[1000].score == out[1001].score < 0.5 <= out[None].score and out[None].held_out is False


def test_toxicity_without_labels_or_documents(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(empty, none).count() == 0


def _patterns(spark, votes):
    rows = Counter(np.flatnonzero(v).astype("<u4").tobytes() for v in votes)
    return spark.createDataFrame([(bytearray(k), n) for k, n in rows.items()], "votes binary, n long")


def test_label_model_by_hand(spark):
    """Its rounds against the same expectation maximisation in plain loops over documents."""
    rng = np.random.default_rng(1)
    y = rng.random(300) < 0.3
    votes = np.column_stack([y & (rng.random(300) < 0.5) | (rng.random(300) < 0.02) for _ in range(4)])
    known = votes[:60], y[:60]

    def sums(v, post):
        cast = v.sum(axis=1)
        return [len(v), post.sum(), (cast > 0).sum(), post[cast > 0].sum(), (post * cast).sum(), *v.sum(axis=0), *(post @ v), *((post * cast) @ v)]

    def step(total):
        n, toxic, some, some_toxic, cast = total[:5]
        fired, fired_toxic, fired_cast = np.array(total[5:]).reshape(3, -1)
        out = {"share": toxic / n, "some": [(some - some_toxic + 0.5) / (n - toxic + 1), (some_toxic + 0.5) / (toxic + 1)], "rate": [], "voice": []}
        for j in range(4):
            usual = (fired[j] + 1e-3) / (some + 1)
            out["rate"].append([(fired[j] - fired_toxic[j] + 2 * usual) / (some - some_toxic + 2), (fired_toxic[j] + 2 * usual) / (some_toxic + 2)])
            out["voice"].append(1 / (1 + max(0, fired_cast[j] / fired_toxic[j] - 1 - (cast - fired_toxic[j]) / some_toxic)))
        return out

    def posterior(m, v):
        z = np.log(m["share"] / (1 - m["share"]))
        on = [j for j in range(4) if v[j]]
        if not on:
            z += np.log((1 - m["some"][1]) / (1 - m["some"][0]))
        else:
            voices = sum(m["voice"][j] for j in on)
            z += np.log(m["some"][1] / m["some"][0]) + sum(m["voice"][j] * np.log(m["rate"][j][1] / m["rate"][j][0]) for j in on) / min(1, voices)
        return 1 / (1 + np.exp(-z))

    first = np.array(sums(known[0], known[1].astype(float)), float)
    model = step(first)
    for _ in range(3):
        model = step(first + np.array(sums(votes, np.array([posterior(model, v) for v in votes]))))
    got = toxicity.label_model(_patterns(spark, votes), first, rounds=3)
    assert np.allclose(got.share[1], model["share"]) and np.allclose(got.some, model["some"]) and np.allclose(got.rate.T, model["rate"]) and np.allclose(got.voice, model["voice"])


def test_label_model_lowers_the_voice_of_copies(spark):
    rng = np.random.default_rng(1)
    y = rng.random(2000) < 0.2
    votes = np.column_stack([y & (rng.random(2000) < 0.6) | (rng.random(2000) < 0.01) for _ in range(4)])
    votes = np.column_stack([votes, votes[:, :1], votes[:, :1]])
    row, voter = np.nonzero(votes)
    known = toxicity.expected(y[:200].astype(float), voter[row < 200], row[row < 200], np.ones(200), 6)
    model = toxicity.label_model(_patterns(spark, votes), known)
    post = model.posterior(voter, row, 2000)
    assert ((post > 0.5) == y).mean() > 0.9 and model.voice[[0, 4, 5]].max() < 0.6 * model.voice[1:4].min()


def test_correlations_by_hand(spark):
    """Pairs of voters and their voices against plain loops over documents."""
    rng = np.random.default_rng(3)
    y = rng.random(400) < 0.4
    votes = np.column_stack([y & (rng.random(400) < 0.4) | (rng.random(400) < 0.02) for _ in range(3)])
    votes = np.column_stack([votes, votes[:, 0] & (rng.random(400) < 0.9), np.zeros(400, bool)])
    m = votes.shape[1]
    model = toxicity.LabelModel(np.array([0.6, 0.4]), np.array([0.1, 0.7]), np.array([[0.3] * m, [0.5, 0.6, 0.7, 0.4, 0.1]]), np.array([0.5, 1.0, 0.8, 0.7, 1.0]))
    post = []
    for v in votes:
        on = [j for j in range(m) if v[j]]
        z = np.log(0.4 / 0.6)
        if on:
            heard = sum(model.voice[j] * np.log(model.rate[1, j] / model.rate[0, j]) for j in on)
            z += np.log(0.7 / 0.1) + heard / min(1, sum(model.voice[j] for j in on))
        else:
            z += np.log(0.3 / 0.9)
        post.append(1 / (1 + np.exp(-z)))
    some = sum(p for p, v in zip(post, votes, strict=True) if v.any())
    n = [[sum(p for p, v in zip(post, votes, strict=True) if v[a] and v[b]) for b in range(m)] for a in range(m)]
    pairs = [(a, b) for a in range(m) for b in range(a + 1, m) if any(v[a] and v[b] for v in votes)]
    want, more = {}, [0.0] * m
    for a, b in pairs:
        due = n[a][a] * n[b][b] / some
        if n[a][b] > due and 2 * (n[a][b] * np.log(n[a][b] / due) - (n[a][b] - due)) >= 2 * np.log(len(pairs)):
            want[a, b] = (n[a][b] / n[a][a] - n[b][b] / some, n[a][b] / n[b][b] - n[a][a] / some)
            more[a] += want[a, b][0]
            more[b] += want[a, b][1]
    found = toxicity.correlations(_patterns(spark, votes), model)
    got = {(r.a, r.b): (r.given_a, r.given_b) for r in found.collect()}
    assert (0, 3) in want and got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    assert np.allclose(toxicity.voices(found, m), [1 / (1 + x) for x in more], atol=1e-6)


def test_pairs_of_nothing(spark):
    model = toxicity.LabelModel(np.array([0.6, 0.4]), np.array([0.1, 0.7]), np.array([[0.3], [0.5]]), np.ones(1))
    none = _patterns(spark, np.zeros((3, 1), bool))
    assert toxicity.correlations(none, model).count() == 0 == toxicity.correlations(none.limit(0), model).count()
    key, n = toxicity.paired(np.array([1, 4, 2]), np.array([2, 0, 1]), np.array([0.5, 1.0, 2.0]), 5)
    assert dict(zip(key.tolist(), n.tolist(), strict=True)) == {1 * 5 + 1: 0.5, 1 * 5 + 4: 0.5, 4 * 5 + 4: 0.5, 2 * 5 + 2: 2.0}


def test_classifier_learns_from_unlabelled_texts(spark, words):
    """A word that only texts without a label have, always beside a voter, raises a score; without those texts it does not."""
    rows = [(i, " ".join([*words(i, 12), *(["blarg"] if i % 4 == 0 else [])])) for i in range(400)]
    rows += [(1000 + i, " ".join([*words(5000 + i, 6), "blarg", "quumix", "quumix", "quumix"])) for i in range(200)]
    rows += [(3000, "quumix quumix quumix quumix quumix"), (3001, " ".join(words(9999, 5)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    score = lambda model: model.logits(pa.array([rows[-2][1]]))[0] - model.bias
    assert score(toxicity.fit(docs, labels)) > score(toxicity.fit(docs, labels, unlabelled=0)) + 0.5


def test_many_voters_are_all_used(spark, words):
    """More toxic words than any fixed number of voters: each has its own few documents, and all are found."""
    rows = [(i, " ".join([*words(i, 20), f"bad{i % 300:03d}x", *words(i + 9000, 5)])) for i in range(3000)]
    rows += [(10_000 + i, " ".join(words(20_000 + i, 26))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 10_000)) for i, _ in rows], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).where("held_out").collect()
    assert np.mean([r.predicted == int(r.doc_id < 10_000) for r in out]) > 0.97


def test_pipeline_stages_on_awkward_documents(spark, docs, tmp_path):
    import corpus_pipeline as P

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(*names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1), (3, 1)], "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "pack":
            assert out.columns == names
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        assert at.count() > 0
        if name == "near_duplicate":
            left = {r.doc_id for r in at.collect()}
            assert {0, 3, 4, 5, 6, 9, 12} <= left and not {1, 2, 10, 11} & left
    assert P.run(spark, str(tmp_path)).count() == at.count()


def test_pipeline_of_nothing(spark, empty, tmp_path):
    import corpus_pipeline as P

    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
