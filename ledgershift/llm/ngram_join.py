"""N-gram Jaccard join: token-combination prefixes, an exact set-similarity join over word shingles.

Every text becomes its set of five-word shingles. Two sets can reach Jaccard 3/4 only if they share enough of their
rarest shingles, so each set is cut to a prefix of the global order (document frequency, then hash). Shingles of up to
`rare` documents are indexed one by one; more frequent ones fall into classes by hash and are indexed as pairs within a
class, for which the prefix is extended by one shingle a class. If |x & y| >= 3/4 max(|x|, |y|), then x and y share a
single or a pair of their prefixes: to break all of them, x would have to lack more of its prefix than it may.
Candidates are verified on all shingles that have two documents or more.

Scale: frequencies come from one exchange of packed 32-bit hashes in blocks (a block sends a shingle once, with its count,
so a shingle of a third of all documents costs a block one entry) and its answer; documents with over a quarter of unique
shingles leave here, which needs no index. Equal sets collapse to one class before the index.
A posting list is known by its hub, its smallest class; lists with one hub are one group, so that a pair that shares
hundreds of signatures is looked at once. A star to one hub is verified first. Then only members outside their hub's
component ask, and are compared with the whole group by an inverted index, in blocks of askers and asked of bounded size.
Where links are counted, a group compares all its pairs instead, save those that meet under a smaller hub; it gives one
count a class, and a spanning set of its links for the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, bucket_count, join_hot, materialize, pack, ship, unpack
from .graph import components, roots
from .kernels import blocks, grams, hash_words, mix, text_buffer

SHINGLE = 5
#: A shingle of more documents than this belongs to the frequent classes.
RARE = 64
#: Frequent prefix shingles a class, about.
CLASS_SIZE = 16

#: Members of a posting group, asking or asked, in one task at most (about), and the bytes of their shingles.
BLOCK, BLOCK_BYTES = 1024, 16 << 20

_ROWS = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])
_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("tokens", pa.binary()), ("sigs", pa.list_(pa.int64()))])


def _size_classes(limit: int = 1 << 40) -> np.ndarray:
    """Lower bounds of size classes: sets with sizes within 3/4 are in one class or in neighbours."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, 4 * (out[-1] - 1) // 3 + 1))
    return np.array(out)


_CLASSES = _size_classes()


def shingles(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text's index) of each shingle, with repeats, in the order of the texts; a text of 1 to 4 words is one shingle."""
    w = hash_words(*text_buffer(block.column("text")), lower=True)
    size = np.diff(w.first)
    owner = w.owner
    g = grams(w.hash, SHINGLE)
    whole = owner[: len(g)] == owner[SHINGLE - 1 :][: len(g)] if len(g) else np.zeros(0, bool)
    tok, own = [g[whole]], [owner[: len(g)][whole]]
    for k in range(1, SHINGLE):
        t = np.flatnonzero(size == k)
        if len(t):
            tok.append(mix(grams(w.hash, k)[w.first[t]] + np.uint64(k)))
            own.append(t)
    return np.concatenate(tok), np.concatenate(own)


def _requests(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """For each block and hash bucket the shingles (once if in one text, with the text's index; else with a count), and a row on the block's texts."""
    part = TaskContext.get().partitionId()
    for seq, block in enumerate(blocks(batches)):
        name = part << 32 | seq
        ids = block.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        tok, own = shingles(block)
        order = np.argsort(tok, kind="stable")
        t, o = tok[order], own[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
        t, o = t[new], o[new]
        n = np.bincount(o, minlength=len(ids))
        s1, s2 = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
        np.add.at(s1, o, mix(t + np.uint64(1)))
        np.add.at(s2, o, mix(t ^ np.uint64(0x5851F42D4C957F2D)))
        t >>= np.uint64(64 - bits - 32)
        first = np.ones(len(t), bool)
        first[1:] = t[1:] != t[:-1]
        at = np.flatnonzero(first)
        count = np.diff(np.append(at, len(t)))
        alone = np.repeat(count == 1, count)
        many_t, many_n = t[at[count > 1]], count[count > 1]
        meta = pack(ids.astype("<i8"), n.astype("<i4"), s1, s2, many_t, many_n.astype("<u4"), o[~alone].astype("<u2"))
        p_many = (many_t >> np.uint64(32)).astype(np.int64)
        t, o = t[alone], o[alone]
        order = np.argsort(o.astype("<u2"), kind="stable")
        t, o = t[order], o[order]
        p = (t >> np.uint64(32)).astype("<u2" if bits <= 16 else "<u4")
        order = np.argsort(p, kind="stable")
        t, o, p = t[order], o[order], p[order]
        low, low_many = t.astype("<u4"), many_t.astype("<u4")
        edges = np.arange((1 << bits) + 1)
        cut, cut_many = np.searchsorted(p, edges), np.searchsorted(p_many, edges)
        keys, data = [-1 - name], [meta]
        for k in range(1 << bits):
            a, b, c, d = cut[k], cut[k + 1], cut_many[k], cut_many[k + 1]
            if a == b and c == d:
                continue
            step = np.diff(o[a:b], prepend=0)
            step = step.astype("<u1" if not len(step) or step.max() < 256 else "<u2")
            keys.append(k)
            data.append(pack(low[a:b], step, low_many[c:d], many_n[c:d].astype("<u4")))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.full(len(keys), name)), pa.array(data, pa.binary())], schema=_ROWS)


def _answers(rows: pa.Table) -> pa.Table:
    """Within a hash bucket: each block's shingles that two documents or more have, with that number (at most 65535)."""
    if rows.column("key")[0].as_py() < 0:
        return rows
    sent = [unpack(x) for x in rows.column("data").to_pylist()]
    h = np.concatenate([x[0] for x in sent] + [x[2] for x in sent])
    weight = np.concatenate([np.ones(sum(len(x[0]) for x in sent), np.int64)] + [x[3].astype(np.int64) for x in sent])
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    total = np.add.reduceat(weight[order], np.flatnonzero(first))
    df = np.empty(len(h), "<u2")
    df[order] = np.minimum(total, 65535)[np.cumsum(first) - 1]
    at, at_many, data, keep = 0, sum(len(x[0]) for x in sent), [], []
    for i, (low, step, low_many, _) in enumerate(sent):
        d, m = df[at : at + len(low)], df[at_many : at_many + len(low_many)]
        at, at_many = at + len(low), at_many + len(low_many)
        shared = d > 1
        if shared.any() or len(m):
            own = np.cumsum(step, dtype=np.int64)[shared]
            keep.append(i)
            data.append(pack(low[shared], own.astype("<u2"), d[shared], low_many, m))
    return pa.Table.from_arrays([rows.column("key").take(pa.array(keep, pa.int64())), rows.column("block").take(pa.array(keep, pa.int64())), pa.array(data, pa.binary())], schema=_ROWS)


def _signatures(n: int, tok: np.ndarray, df: np.ndarray, rare: int) -> np.ndarray:
    """Hashes of the prefix's singles and pairs; tok in the global order, shingles of one document left out."""
    need = n // 4 + 1 - (n - len(tok))
    r = int(np.searchsorted(df, rare, "right"))
    singles = mix(tok[: min(need, r)] * np.uint64(2) + np.uint64(1))
    if need <= r:
        return singles
    out, often = [singles], tok[r:]
    size_class = int(np.searchsorted(_CLASSES, n, "right")) - 1
    for s in (size_class, size_class + 1):
        group = mix(often + np.uint64(77)) % np.uint64(max(1, _CLASSES[s] // (4 * CLASS_SIZE)))
        order = np.argsort(group, kind="stable")
        g = group[order]
        later = np.zeros(len(often), np.int64)
        later[order[1:]] = g[1:] == g[:-1]
        end = int(np.searchsorted(np.cumsum(later), need - r)) + 1
        order = order[order < end]
        g, t = group[order], often[order]
        for step in range(1, len(t)):
            same = g[step:] == g[:-step]
            if not same.any():
                break
            a, b = t[step:][same], t[:-step][same]
            out.append(mix(mix(np.minimum(a, b)) + np.maximum(a, b) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * s)))
    return np.unique(np.concatenate(out))


def _assemble(rows: pa.Table, rare: int) -> pa.Table:
    """A block's texts again, with set size and set hash; those that can have a partner also with shared shingles and signatures."""
    keys, data = rows.column("key").to_numpy(), rows.column("data").to_pylist()
    ids, n, s1, s2, many_t, many_n, many_o = unpack(data[int(np.flatnonzero(keys < 0)[0])])
    tok, own, df, mt, mdf = [], [], [], [], []
    for key, x in zip(keys.tolist(), data, strict=True):
        if key >= 0:
            low, o, d, low_many, dm = unpack(x)
            tok.append(low.astype(np.uint64) | np.uint64(key << 32))
            own.append(o)
            df.append(d)
            mt.append(low_many.astype(np.uint64) | np.uint64(key << 32))
            mdf.append(dm)
    if mt:
        mt, mdf = np.concatenate(mt), np.concatenate(mdf)
        of = mdf[np.argsort(mt)]  # many_t ascends, and each of its shingles has got an answer
        tok.append(np.repeat(many_t, many_n))
        df.append(np.repeat(of, many_n))
        own.append(many_o)
    tok = np.concatenate(tok) if tok else np.zeros(0, np.uint64)
    own = np.concatenate(own).astype(np.int64) if own else np.zeros(0, np.int64)
    df = np.concatenate(df) if df else np.zeros(0, "<u2")
    shared = np.bincount(own, minlength=len(ids))
    able = (n > 0) & (n - shared <= n // 4)
    mine = able[own]
    tok, own, df = tok[mine], own[mine], df[mine]
    order = np.lexsort((tok, df, own))
    tok, own, df = tok[order], own[order], df[order]
    cut = np.searchsorted(own, np.arange(len(ids) + 1))
    tokens, sigs = [None] * len(ids), [None] * len(ids)
    for i in np.flatnonzero(able):
        t = tok[cut[i] : cut[i + 1]]
        sigs[i] = _signatures(int(n[i]), t, df[cut[i] : cut[i + 1]], rare).view(np.int64)
        t = np.sort(t)
        tokens[i] = pack(t.astype("<u4"), (t >> np.uint64(32)).astype("<u2"))
    return pa.Table.from_arrays([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(tokens, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], schema=_SETS)


def _tokens(data: bytes) -> np.ndarray:
    low, high = unpack(data)
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)


def _across(rows: pa.Table, percent: int) -> pa.Table:
    """Links between those that ask and those asked in other components; none between components that links here have joined."""
    asks = rows.column("asks").to_numpy()
    v, c, n = (rows.column(x).to_numpy() for x in ("v", "c", "n"))
    tokens = [_tokens(x) for x in rows.column("tokens").to_pylist()]
    asked = np.flatnonzero(~asks)
    a, b = [], []
    _, part = np.unique(c, return_inverse=True)
    if len(asked):
        index = np.concatenate([tokens[i] for i in asked.tolist()])
        owner = np.repeat(np.arange(len(asked)), [len(tokens[i]) for i in asked.tolist()])
        order = np.argsort(index, kind="stable")
        index, owner = index[order], owner[order]
        for q in np.flatnonzero(asks).tolist():
            left, right = np.searchsorted(index, tokens[q], "left"), np.searchsorted(index, tokens[q], "right")
            size = right - left
            hits = np.repeat(left - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            common = np.bincount(owner[hits], minlength=len(asked))
            good = asked[(100 * common >= percent * (n[q] + n[asked] - common)) & (part[asked] != part[q])]
            other, one = np.unique(part[good], return_index=True)
            a += [int(v[q])] * len(one)
            b += v[good[one]].tolist()
            part[np.isin(part, other)] = part[q]
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def _met(mine: np.ndarray, index: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many of `mine` each of n owners has in the sorted index."""
    left, right = np.searchsorted(index, mine, "left"), np.searchsorted(index, mine, "right")
    size = right - left
    hits = np.repeat(left - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    return np.bincount(owner[hits], minlength=n)


def _inverted(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    index, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(index, kind="stable")
    return index[order], owner[order]


def _count(rows: pa.Table, percent: int) -> pa.Table:
    """All pairs of one part with another of a group, without those that share a smaller hub: (v, null, links of v) and a spanning set (a, b, null)."""
    hub, i, j = (rows.column(x)[0].as_py() for x in ("hub", "i", "j"))
    v, n, part = (rows.column(x).to_numpy() for x in ("v", "n", "part"))
    tokens = [_tokens(x) for x in rows.column("tokens").to_pylist()]
    values, of = _ragged(rows.column("hubs"))
    less = values < hub
    values, cut = values[less], np.searchsorted(of[less], np.arange(len(v) + 1))
    hubs = [values[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    asks, asked = np.flatnonzero(part == i), np.flatnonzero(part == j)
    links, joined, a, b = np.zeros(len(v), np.int64), np.arange(len(v)), [], []
    if len(asks) and len(asked):
        by_token, by_hub = _inverted([tokens[x] for x in asked.tolist()]), _inverted([hubs[x] for x in asked.tolist()])
        for q in asks.tolist():
            common = _met(tokens[q], *by_token, len(asked))
            good = (100 * common >= percent * (n[q] + n[asked] - common)) & ((asked > q) | (i != j))
            if not good.any():
                continue
            good = asked[good & (_met(hubs[q], *by_hub, len(asked)) == 0)]
            links[q] += len(good)
            links[good] += 1
            new = good[joined[good] != joined[q]]
            other, one = np.unique(joined[new], return_index=True)
            a += [int(v[q])] * len(one)
            b += v[new[one]].tolist()
            joined[np.isin(joined, other)] = joined[q]
    some = np.flatnonzero(links)
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    counts = pa.table([pa.array(v[some]), pa.nulls(len(some), pa.int64()), pa.array(links[some])], names=["a", "b", "k"])
    return pa.concat_tables([counts, pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())], names=["a", "b", "k"])])


def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = []
        for i, (na, nb, ta, tb) in enumerate(zip(*(b.column(c).to_pylist() for c in ("na", "nb", "ta", "tb")), strict=True)):
            both = np.concatenate((_tokens(ta), _tokens(tb)))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= percent * (na + nb - common):
                good.append(i)
        yield b.select(["a", "b"]).take(pa.array(good, pa.int64()))


def shingle_sets(docs: DataFrame, rare: int = RARE, buckets: int | None = None) -> DataFrame:
    """(doc_id, n, s1, s2, tokens, sigs) for each row of docs(doc_id, text); tokens and sigs only where a partner is possible."""
    ship(docs.sparkSession)
    bits = (buckets or bucket_count(docs)).bit_length() - 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = rows.mapInArrow(partial(_requests, bits=bits), "key long, block long, data binary")
    told = sent.groupBy("key").applyInArrow(lambda rows: _answers(rows), "key long, block long, data binary")
    return told.groupBy("block").applyInArrow(lambda rows: _assemble(rows, rare), "doc_id long, n long, s1 long, s2 long, tokens binary, sigs array<long>")


def near_duplicates(docs: DataFrame, percent: int = 75, rare: int = RARE, buckets: int | None = None, block: int = BLOCK, counts: bool = True) -> DataFrame:
    """One row per row of docs(doc_id long, text string, ...): doc_id, n_shingles, component_id, n_links.

    component_id: the smallest doc_id that links reach; n_links: the classes of equal sets that its own class links to.
    Without counts no n_links are given, and a pair inside a component need not be compared. percent: 75 or more.
    Null or empty text: no shingle, its own component. Repeated rows are equal sets and link. A null doc_id stays null,
    after every id. Other columns are not read. Very long texts are blocks of their own. An empty table gives no row.
    """
    if percent < 75:
        raise ValueError("prefixes are made for a similarity of 75 % or more")
    sets = materialize(shingle_sets(docs, rare, buckets), "shingle-sets")
    reps = materialize(sets.where("sigs is not null").select(F.col("s1").alias("v"), "s2", "n", "tokens", "sigs").dropDuplicates(["v", "s2"]), "set-classes")
    sig = reps.select("v", F.octet_length("tokens").alias("size"), F.explode("sigs").alias("sig"))
    shared = sig.groupBy("sig").agg(F.min("v").alias("hub"), F.max("v").alias("last")).where("hub < last").drop("last")
    member = materialize(sig.join(materialize(shared, "postings"), "sig").select("hub", "v", "size").distinct(), "posting-members")
    sized = reps.select("v", "n", "tokens")
    if counts:
        links, label, degree = _all_links(member, sized, percent, block)
    else:
        links, label = _spanning_links(member, sized, percent, block)
    of = sets.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("low")).join(label.withColumnRenamed("v", "s1"), "s1", "left")
    of = materialize(of.select("s1", "s2", "low", F.coalesce("c", "s1").alias("c")), "set-components")
    of = join_hot(of, of.groupBy("c").agg(F.min("low").alias("component_id")), "c")
    if counts:
        of = of.join(degree, "s1", "left")
    of = materialize(of.select("s1", "s2", "component_id", *(["n_links"] if counts else [])), "class-components")
    out = sets.select("doc_id", "n", "s1", "s2").join(of, ["s1", "s2"], "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    null = F.lit(NULL_ID)
    more = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if counts else []
    return out.select(F.nullif("doc_id", null).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(own, null).alias("component_id"), *more)


def _parts(block: int) -> Column:
    """Into how many parts a group of members falls, by their number and by the size of their shingles: few long texts fill a task too."""
    return F.ceil(F.greatest(F.count("*") / block, F.sum("size") / BLOCK_BYTES)).cast("int")


def _all_links(member: DataFrame, sized: DataFrame, percent: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A spanning set of links (a, b), the components (v, c), and (s1, n_links): each candidate pair is verified once."""
    parts = member.groupBy("hub").agg(_parts(block).alias("parts"))
    hubs = member.groupBy("v").agg(F.collect_list("hub").alias("hubs"))
    at = member.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    at = at.select("hub", "v", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to"))
    at = at.select("hub", "v", "part", F.least("part", "to").alias("i"), F.greatest("part", "to").alias("j"))
    full = at.join(sized.join(hubs, "v"), "v")
    found = materialize(full.groupBy("hub", "i", "j").applyInArrow(lambda rows: _count(rows, percent), "a long, b long, k long"), "links")
    links = found.where("b is not null").select("a", "b")
    degree = found.where("b is null").groupBy(F.col("a").alias("s1")).agg(F.sum("k").alias("n_links"))
    return links, components(links), degree


def _spanning_links(member: DataFrame, sized: DataFrame, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """A spanning set of links (a, b) and the components (v, c)."""

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among pairs(a, b)."""
        full = pairs.join(sized.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), "a")
        full = full.join(sized.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b")
        full = full.where(F.col("na") * 100 >= F.col("nb") * percent).where(F.col("nb") * 100 >= F.col("na") * percent)
        return full.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(partial(_verify, percent=percent), "a long, b long")

    star = member.where("v <> hub").groupBy("v").agg(F.min("hub").alias("a")).select("a", F.col("v").alias("b"))
    links = materialize(verified(star), "links")
    label = roots(links.select(F.col("b").alias("v"), F.col("a").alias("p")))
    at = member.join(label, "v", "left").select("hub", "v", "size", F.coalesce("c", "v").alias("c"))
    group = at.groupBy("hub").agg(_parts(block).alias("parts"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.max(F.when(F.col("v") == F.col("hub"), F.col("c"))).alias("hub_c"))
    group = group.where("c0 < c1").select("hub", "hub_c", "parts")
    at = at.join(materialize(group, "posting-groups"), "hub").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    asks = at.where("c <> hub_c").select("hub", "v", "c", F.lit(True).alias("asks"), F.col("part").alias("i"), F.explode(every).alias("j"))
    asked = at.select("hub", "v", "c", F.lit(False).alias("asks"), F.explode(every).alias("i"), F.col("part").alias("j"))
    full = asks.union(asked).join(sized, "v")
    more = materialize(full.groupBy("hub", "i", "j").applyInArrow(lambda rows: _across(rows, percent), "a long, b long"), "links")
    if not more.isEmpty():
        links = links.union(more)
        label = components(links)
    return links, label
