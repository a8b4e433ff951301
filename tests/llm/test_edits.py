"""Conversation repair, secret scans and fill-in-the-middle against plain Python."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ledgershift.llm import infill, repair, secret_scan

SF = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string, block string, copies_of long, fault string"


def search(turns):
    """Cheapest edits, ASCII-least, by best-first search over all edit strings; turns: (role, text, fault)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, shape, out = heapq.heappop(heap)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", shape):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
        if (i, shape[:1], len(shape) % 2, shape[-1:]) in seen or not re.match("s?(ua)*u?$", shape):
            continue
        seen.add((i, shape[:1], len(shape) % 2, shape[-1:]))
        for name in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", i, shape + name[0], (*out, (name, ""))))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, shape, out))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault else 0
                if role[:1] in "sua" and role:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, shape + role[0], (*out, (role, text))))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, shape + name[0], (*out, (name, text))))


def plain_repair(rows):
    """The contract of op11 for rows (conv_id, turn, role, text), row by row."""
    after, convs = defaultdict(list), set()
    for conv, turn, role, text in rows:
        convs.add(conv)
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv in convs:
        turns = sorted(after[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = {t for t, _, _ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        first = [r[1][:1] for r in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        cost, audit, text = search([(r, t, f) for (_, r, t), f in zip(turns, faults, strict=True)])
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["", "truncated", "blank"])), max_size=7))
def test_walk_is_the_cheapest_ascii_least_repair(turns):
    turns = [(r, f"t{i}", f) for i, (r, f) in enumerate(turns)]
    steps = list(repair._steps([(r, t, f, 1) for r, t, f in turns]))
    cost = repair.costs_to_go(steps, repair.END)
    audit, out, _ = repair.walk(steps, cost, repair.START, True)
    assert (cost[0][0], audit, repair._repaired(out)) == search(turns)


@pytest.fixture(scope="module")
def chats():
    rnd = random.Random(4)
    say = ["Yes.", "No!", "half", " ", "", None, "Yes. \n", "é?\x85", "A" * 5000 + ".", "ok."]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool", None, ""]), rnd.choice(say)) for c in (1, 2, 3, None, -7) for t in rnd.sample(range(9), 6)]
    rows += [(4, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(300)]
    rows += [(5, 3, "user", "same.")] * 40 + [(5, t, "assistant", "same.") for t in range(40)]
    rows += [(6, None, "user", "a."), (6, None, "assistant", "b."), (6, None, None, None)]
    rows += [(c, t, "user", "gone.") for c in (7,) for t in range(200) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    rows += [(8, -(2**62), "user", "far."), (8, 2**62, "assistant", "away.")]
    return rows


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_repair_equals_search(spark, chats, parts):
    """Conversations inside one partition, cut by its edge, and spread over many."""
    df = spark.createDataFrame([(*r, "b", 9, "x") for r in chats], ROWS)
    assert got(repair.repair(repair.damaged(df), parts)) == plain_repair(chats)


def test_repair_of_a_table(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    assert got(repair.repair(repair.damaged(rows))) == plain_repair([(r.conv_id, r.turn, r.role, r.text) for r in rows.collect()])


def test_repair_of_nothing(spark):
    assert repair.repair(repair.damaged(spark.createDataFrame([], ROWS))).count() == 0


def plain_secrets(text, allowed=secret_scan.ALLOWED):
    """All spans, with every window's entropy computed by itself."""
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    base = list(spans)
    for k, c in enumerate(secret_scan.CLASSES, 3):
        for m in re.finditer(f"[{c.chars}]+", text):
            if any(re.search(a, m[0]) for a in allowed):
                continue
            hit = set()
            for i in range(len(m[0]) - c.window + 1):
                w = m[0][i : i + c.window]
                bits = -sum(w.count(x) / len(w) * math.log2(w.count(x) / len(w)) for x in set(w))
                if bits >= c.bits - 1e-9 and all(re.search(f"[{h}]", w) for h in c.holds):
                    hit |= set(range(m.start() + i, m.start() + i + c.window))
            for a in sorted(hit):
                if a - 1 not in hit:
                    b = a
                    while b in hit:
                        b += 1
                    if not any(x <= a and b <= y for x, _, y in base):
                        spans.append((a, k, b))
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _secret_texts():
    rnd = random.Random(11)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    key = lambda n, some=chars: "".join(rnd.choice(some) for _ in range(n))
    return [
        None,
        "",
        'é token = "4bb0c75cc3b0398440b6ca30dd75e60ee4a65a87" ü Password:x api_key=\'abc.def\' PASSWD = short',
        "token=secret=abcdef secret:token:abcdefgh toKen: KELVIN ſecret=abcdefgh toKen=abcdefgh",
        "AKIA" + key(16, "ABCDEF0123456789") + " AKIASHORT AKIAAKIA" + key(20, "ABC1"),
        "ü" * 30 + " " + key(40) + "\n" + key(25, "0123456789ABCDEF") + " " + key(24, "0123456789abcdef") + "g",
        "550e8400-e29b-41d4-a716-446655440000 0123456789abcdefABCDEF0123 usr/lib/x86_64-linux-gnu/Qt5Core9 sha256-" + key(44),
        "exampleKEY" + key(30) + " antidisestablishmentarianismus Donaudampfschifffahrtsgesellschaft",
        key(700) + "A" * 60 + key(300) + "b" * 21 + key(25),
        " ".join(key(rnd.randint(15, 50)) for _ in range(60)),
        "\x00 " + key(30) + "\x00",
    ]


def test_secrets_equal_window_by_window(spark):
    texts = _secret_texts()
    rows = [(i, t, i, "x") for i, t in enumerate(texts)] + [(None, texts[2], 0, "x"), (2, texts[2], 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans long, kind string")
    out = secret_scan.secret_digests(df).collect()
    want = {i: plain_secrets(t or "") for i, t in enumerate(texts)} | {None: plain_secrets(texts[2])}
    assert len(out) == len(rows)
    for r in out:
        assert r.spans == want[r.doc_id]
        base = [s for s in r.spans.split(",") if s.split(":")[0] in secret_scan.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in base) for k in secret_scan.BASE]
    assert "entropy_base64" in want[5] and "entropy_hex" in want[5] and not want[7] and want[6] == ""


def test_segments_do_not_change_a_verdict(monkeypatch):
    text = _secret_texts()[8].encode()
    c = secret_scan.Windows(secret_scan.CLASSES[1])
    whole = c.hits([text, text[:20]])
    monkeypatch.setattr(secret_scan, "SEGMENT", 7)
    for a, b in zip(whole, c.hits([text, text[:20]]), strict=True):
        assert (a == b).all()


def test_a_secret_in_a_long_text_is_found(spark):
    text = "prose and words é " * 300_000 + 'token = "Zk3vQ9xT1bLw8RyPd5Hn" ' + "x " * 1000
    (r,) = secret_scan.secret_digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.spans.startswith(f"assign:{18 * 300_000}:") and r.n_assign == 1


def test_secrets_of_nothing(empty):
    assert secret_scan.secret_digests(empty).count() == 0


def plain_infill(doc_id, text, pattern=r"[^\n]*\n|[^\n]+", rate=100, spm=50, seed=7):
    units = re.findall(pattern, text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("unit", "pattern"), [("line", r"[^\n]*\n|[^\n]+"), ("word", r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+"), ("char", r"(?s).")])
@pytest.mark.parametrize("chunk", [1, 5, 4096])
def test_chunks_place_every_rank(unit, pattern, chunk):
    texts = ["", "a", "\n", "\n\n\n", "é\nüß 漢字\n\n x", "one two  three\nfour ", "ab\ncd", " lead"]
    import numpy as np

    data = [t.encode() for t in texts]
    edge = np.append(0, np.cumsum([len(x) for x in data]))
    own = infill.Chunks(np.frombuffer(b"".join([*data, b"\0"]), np.uint8), edge, unit, chunk)
    for k, t in enumerate(texts):
        units = re.findall(pattern, t)
        assert own.n[k] == len(units)
        for r in range(len(units) + 1):
            assert own.place(k, r) - edge[k] == len("".join(units[:r]).encode())


def test_infill_rows_and_round_trip(spark, texts):
    odd = [(50 + i, t) for i, t in enumerate(["<", "a<\nb>\n<S\nP>", "has <M> mark", "<S>", "\n" * 9, "no newline", "x\r\ny\r\nz", "tail\n", "\x00\n\x00"])]
    long = (90, "\n".join(f"line {i} é" for i in range(400_000)))
    rows = [*texts, *odd, long]
    df = spark.createDataFrame([(i, t, "n", 5) for i, t in rows], "doc_id long, text string, form string, n long")
    made = infill.fill_in_middle(df)
    out = made.withColumn("back", infill.restored(made["output"], made["form"])).collect()
    key = lambda r: (str(r[0]), r[1])
    want = sorted(((i, t or "", *plain_infill(i, t or "")) for i, t in rows), key=key)
    have = sorted(((r.doc_id, r.back, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=key)
    assert have == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_infill_rates_and_units(spark):
    df = spark.createDataFrame([(i, f"some words of text {i}") for i in range(200)], "doc_id long, text string")
    out = infill.fill_in_middle(df, "word", 40, 100, 3).collect()
    for r in out:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_infill(r.doc_id, f"some words of text {r.doc_id}", r"\s*\S+", 40, 100, 3)
    assert {r.form for r in out} == {"plain", "spm"}
    with pytest.raises(ValueError):
        infill.fill_in_middle(df, "page")


def test_infill_of_nothing(empty):
    assert infill.fill_in_middle(empty).count() == 0
