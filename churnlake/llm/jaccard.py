"""Operator 5: n-gram Jaccard join by universe partition and pigeonhole, with near-duplicate classes.

A text's set holds its distinct shingles of ``SHINGLE`` words (64-bit hashes; A-Z lower-cased; a shorter text is one shingle).
Two sets of sizes a and b link if 9 * intersection >= 4 * (a + b), that is Jaccard >= 0.8; then at most (a + b) / 9 shingles differ.

Signatures. Sizes fall into bands; a band's scheme serves the pairs whose smaller set is in the band (a set also follows
the schemes of the lower bands that its smaller partners can be in). With H the most shingles that can differ there,
the scheme hashes the universe of shingles into segments and spends H + 1 units on them, so that by the
pigeonhole principle any linked pair agrees in a segment to within its units:

* one unit: the segment's subset is the signature, for wide segments. A scheme has ``spare`` segments more than H + 1, and each set leaves out
  as many of its costliest ones (fewest shingles; then by signature): of the segments in which two sets agree, the
  cheapest is left out by neither.
* two units: the subset and its one-deletion neighbourhood, for bands whose one-unit segments would hold under
  ``WIDTH`` shingles.

An empty subset is never a signature: a set with more of them than spare segments is dealt once more with the next seed, as is its partner
if only empty segments agree.

Classes. Rows are dealt by signature and compared with their neighbours in a sorted stream; only shared signatures go on, and
each piece of text sends one row of a signature. A signature's hub is its smallest text. Each text is first verified with the hub
it shares most signatures with (a bound prunes: sets hashed into ``BINS`` counters differ by at least the counters' differences).
Texts that share a signature share its hub: the groups of hubs that still span several classes are then compared whole, in blocks
of about ``BLOCK`` texts and ``BLOCK_SHINGLES`` shingles at most, as exact matrix products of their sets; no pair is emitted, only a forest of the links. Copies of a text are one
node.

Defined results: every row has a result; null or wordless text has an empty set and links with nothing; rows without doc_id take part
and get the smallest doc_id of their class, null if it has none; different texts that share a doc_id are judged apart;
repeated rows are copies; empty tables and pieces of text without a word give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Prefix, Words, as_signed, components, cut, grouped, hash128, memo, mix64, pieces, small

SHINGLE, RATIO, WIDTH, BINS, SEEDS, BLOCK, BLOCK_SHINGLES = 5, 1.3, 2.6, 32, 24, 512, 1_000_000
_U = np.uint64


def sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, sorted within each text; first one of each text) of a piece."""
    w = Words(data, offsets, lower=True)
    n = np.diff(w.first)
    counts = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), counts)
    at = w.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    h = Prefix(w.hash).of(at, np.minimum(at + SHINGLE, w.first[text + 1]))
    order = np.lexsort((h, text))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(n)))])


@memo
def schemes(largest: int = 1 << 34) -> dict[str, np.ndarray]:
    """Per band: ``edge`` (smallest size), ``units`` (H + 1), ``segments``, ``spare`` and ``double`` (two units each)."""
    edge = [1]
    while edge[-1] < largest:
        edge.append(max(edge[-1] + 1, int(edge[-1] * RATIO)))
    e = np.array(edge)
    top = e[1:] - 1
    units = (top + 5 * top // 4) // 9 + 1
    spare = np.where(units > 1, np.ceil(0.12 * units).astype(int) + 3, 0)
    double = (units > 1) & (top / (units + spare) < WIDTH)
    return {"edge": e[:-1], "units": units, "spare": np.where(double, 0, spare), "double": double, "segments": np.where(double, (units + 1) // 2, units + spare)}


def band(size: np.ndarray) -> np.ndarray:
    return np.searchsorted(schemes()["edge"], size, "right") - 1


def _deal(h: np.ndarray, first: np.ndarray, who: np.ndarray, k: np.ndarray, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(signatures, texts); at the end also the texts to deal again. ``who``: texts, ``k``: the scheme of each."""
    s = schemes()
    sizes = first[who + 1] - first[who]
    local = np.repeat(np.arange(len(who)), sizes)
    token = h[np.repeat(first[who] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(local))]
    m = s["segments"][k]
    base = np.concatenate([[0], np.cumsum(m)])
    salt = mix64(k.astype(_U) * _U(1000) + _U(seed))
    cell = base[local] + (mix64(token ^ salt[local]) % m[local].astype(_U)).astype(np.int64)
    value = mix64(token + _U(0xC0FFEE))
    order = np.argsort(cell, kind="stable")
    total = np.concatenate([np.zeros(1, _U), np.cumsum(value[order], dtype=_U)])
    count = np.bincount(cell, minlength=base[-1])
    end = np.cumsum(count)
    content = total[end] - total[end - count]
    owner = np.repeat(np.arange(len(who)), m)
    mark = mix64(salt[owner] + (np.arange(base[-1]) - base[owner]).astype(_U) * _U(0x9E3779B97F4A7C15))
    name = mix64(content ^ mark)
    last = seed == SEEDS - 1
    double = s["double"][k]
    # one unit: leave out the costliest
    rank_key = (owner.astype(_U) << _U(44)) | (np.minimum(count, 255).astype(_U) << _U(36)) | (name >> _U(28))
    by_cost = np.argsort(rank_key, kind="stable")
    rank = np.empty(len(by_cost), np.int64)
    rank[by_cost] = np.arange(len(by_cost)) - base[owner[by_cost]]
    send = np.where(double[owner], True, rank >= s["spare"][k][owner]) & ((count > 0) | last)
    yield name[send], who[owner[send]], None
    # two units: the subsets without one shingle
    pick = double[local[order]] & ((count[cell[order]] > 1) | last)
    if pick.any():
        c = cell[order][pick]
        yield mix64((content[c] - value[order][pick]) ^ mark[c]), who[owner[c]], None
    none = np.bincount(owner, weights=count == 0, minlength=len(who))
    thin = np.bincount(owner, weights=count < 2, minlength=len(who))
    again = np.where(double, thin > 0, none > s["spare"][k])
    yield np.zeros(0, _U), np.zeros(0, np.int64), np.flatnonzero(again)


def signatures(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text) of all sets of a piece."""
    size = np.diff(first)
    names, texts = [], []
    own, least = band(size), band(-(-4 * size // 5))
    for lower in range(int((own - least).max(initial=0)) + 1):
        who = np.flatnonzero((size > 0) & (own - lower >= least))
        k = own[who] - lower
        for seed in range(SEEDS):
            if not len(who):
                break
            for name, text, again in _deal(h, first, who, k, seed):
                names.append(name)
                texts.append(text)
            who, k = who[again], k[again]
    return (np.concatenate(names), np.concatenate(texts)) if names else (np.zeros(0, _U), np.zeros(0, np.int64))


def counters(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.bincount(text * BINS + (mix64(h + _U(5)) % _U(BINS)).astype(np.int64), minlength=(len(first) - 1) * BINS).reshape(-1, BINS)


# The low bits of ``key`` tell the kind of a row.
SIGNATURE, SIZE, MEMBER = 0, 1, 2
ROWS = "key long, rid long, x long, bins array<int>"


def _as_batch(key, rid, x, bins) -> pa.RecordBatch:
    if bins is None:
        lists = pa.nulls(len(key), pa.list_(pa.int32()))
    else:
        lists = pa.ListArray.from_arrays(np.arange(0, bins.size + 1, BINS, dtype=np.int32), pa.array(bins.ravel().astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(as_signed(key)), pa.array(rid), pa.array(x), lists], ["key", "rid", "x", "bins"])


def _map_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = ~_U(3)
    for batch in batches:
        rids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in pieces(batch.column(1)):
            h, first = sets(data, offsets)
            rid = rids[lo:hi]
            yield _as_batch((mix64(rid.view(_U)) & low) | _U(SIZE), rid, np.diff(first), counters(h, first))
            name, text = signatures(h, first)
            key, who = name & low, rid[text]
            order = np.lexsort((who, key))
            key, who = key[order], who[order]
            before = np.zeros(len(key), bool)  # no rows: none of the texts has a word
            before[1:] = key[1:] == key[:-1]
            shared = before.copy()
            shared[:-1] |= before[1:]
            yield _as_batch(key[~before], who[~before], np.zeros(int((~before).sum()), np.int64), None)
            if shared.any():
                key, who = key[shared], who[shared]
                yield _as_batch((mix64(key + who.view(_U)) & low) | _U(MEMBER), who, as_signed(key), None)


def _reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: sizes pass, signatures become (MEMBER, rid, signature) if the row beside has the same."""
    held, fresh = None, True

    def out(key, rid, x, bins, a, b):
        before = np.concatenate([[False], key[1:] == key[:-1]])
        shared = (before | np.concatenate([before[1:], [False]])) & (key & 3 == SIGNATURE)
        p = np.flatnonzero(shared[a:b]) + a
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), MEMBER)), pa.array(rid[p]), pa.array(key[p]), pa.nulls(len(p), pa.list_(pa.int32()))], ["key", "rid", "x", "bins"])
        p = np.flatnonzero(key[a:b] & 3 != SIGNATURE) + a
        if len(p):
            at = pa.array(p)
            yield pa.RecordBatch.from_arrays([pa.array(key[p] & 3), pa.array(rid[p]), pa.array(x[p]), bins.take(at)], ["key", "rid", "x", "bins"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, rid, x = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        bins = batch.column(3)
        if held:
            key, rid, x = (np.concatenate([p, q]) for p, q in zip(held[:3], (key, rid, x), strict=True))
            bins = pa.concat_arrays([held[3], bins])
        yield from out(key, rid, x, bins, 0 if fresh else 1, len(key) - 1)
        fresh = fresh and len(key) < 2
        held = (key[-2:], rid[-2:], x[-2:], bins[-2:])
    if held:
        n = len(held[0])
        yield from out(*held, 0 if fresh else n - 1, n)


def _verify_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns a, b, text_a, text_b: the pairs that link."""
    for batch in batches:
        of = []
        for c in (2, 3):
            got: list[np.ndarray] = []
            for lo, hi, data, offsets in pieces(batch.column(c)):
                h, first = sets(data, offsets)
                got += [h[first[i]:first[i + 1]] for i in range(hi - lo)]
            of.append(got)
        keep = []
        for x, y in zip(*of, strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(bool(len(x) and len(y) and 9 * both >= 4 * (len(x) + len(y))))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts link. Only the texts of the pairs are moved."""
    ids = cut(pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid"))).distinct())
    t = cut(texts.join(small(ids), "rid").select("rid", "text"))
    rows = pairs.join(t.selectExpr("rid a", "text text_a"), "a").join(t.selectExpr("rid b", "text text_b"), "b")
    return rows.select("a", "b", "text_a", "text_b").repartition("a", "b").mapInArrow(_verify_rows, "a long, b long")


def _possible(a: str, b: str):
    """The counters of two sets do not rule out a link."""
    apart = F.aggregate(F.zip_with(f"{a}.bins", f"{b}.bins", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, v: s + v)
    return 9 * apart <= F.col(f"{a}.n") + F.col(f"{b}.n")


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns hub, lo, hi, rid, comp, block, text, sorted by the first three: exact intersections of all sets of a block, or of two,
    as a matrix product over the shingles they share; the links between different classes leave as a forest (a, b)."""
    for group in grouped(batches, ("hub", "lo", "hi")):
        if group.num_rows < 2:
            continue
        order = np.argsort(group["rid"].to_numpy(), kind="stable")
        group = group.take(order).combine_chunks()
        rid, comp, block = (group[c].to_numpy() for c in ("rid", "comp", "block"))
        inner, low = group["lo"][0].as_py() == group["hi"][0].as_py(), group["lo"][0].as_py()
        hs, sizes = [], []
        for c in group["text"].chunks:
            for _, _, data, offsets in pieces(c):
                h, first = sets(data, offsets)
                hs.append(h)
                sizes.append(np.diff(first))
        h, n = np.concatenate(hs), np.concatenate(sizes)
        who = np.repeat(np.arange(len(n)), n)
        _, name, df = np.unique(h, return_inverse=True, return_counts=True)
        shared = df[name] > 1
        _, name = np.unique(name[shared], return_inverse=True)
        who = who[shared]
        by_name = np.argsort(name, kind="stable")
        name, who = name[by_name], who[by_name]
        left = np.arange(len(n)) if inner else np.flatnonzero(block == low)
        right = np.arange(len(n)) if inner else np.flatnonzero(block != low)
        both = np.zeros((len(left), len(right)), np.float32)
        place = np.zeros(len(n), np.int64)
        for lo in range(0, int(name.max(initial=-1)) + 1, 4096):
            a, b = np.searchsorted(name, (lo, lo + 4096))
            m = np.zeros((len(n), 4096), np.float32)
            m[who[a:b], name[a:b] - lo] = 1
            both += m[left] @ m[right].T
        i, j = np.nonzero((9 * both >= 4 * (n[left][:, None] + n[right][None, :])) & (both > 0) & (comp[left][:, None] != comp[right][None, :]))
        if not len(i):
            continue
        i, j = left[i], right[j]
        classes_, label = np.unique(comp, return_inverse=True)
        parent = np.arange(len(classes_))
        while True:
            old = parent.copy()
            np.minimum.at(parent, label[i], parent[label[j]])
            np.minimum.at(parent, label[j], parent[label[i]])
            parent = parent[parent]
            if (parent == old).all():
                break
        moved = np.flatnonzero(parent != np.arange(len(parent)))
        yield pa.RecordBatch.from_arrays([pa.array(classes_[moved]), pa.array(classes_[parent[moved]])], ["a", "b"])


def links(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rid, n_shingles) of every text and (id, comp) of the texts that link. ``texts``: rid, text."""
    rows = texts.select("rid", "text").mapInArrow(_map_rows, ROWS)
    rows = cut(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_reduce_rows, ROWS))
    info = rows.where(F.col("key") == SIZE).groupBy("rid").agg(F.max_by(F.struct(F.col("x").alias("n"), "bins"), "x").alias("i")).select("rid", "i.n", "i.bins")
    member = rows.where(F.col("key") == MEMBER).selectExpr("x sig", "rid").distinct()
    hub = member.groupBy("sig").agg(F.min("rid").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1").select("sig", "hub")
    spokes = cut(member.join(hub, "sig").where("rid <> hub").groupBy("rid", "hub").agg(F.count(F.lit(1)).alias("shared")))
    # First each text with the hub of most shared signatures.
    near = spokes.join(info, "rid").alias("p").join(info.alias("q"), F.col("p.hub") == F.col("q.rid")).where(_possible("p", "q")).select("p.rid", "p.hub", "p.shared")
    best = cut(near.groupBy("rid").agg(F.max_by("hub", F.struct("shared", F.negative("hub"))).alias("hub")).selectExpr("rid a", "hub b"))
    edges = cut(verify(best, texts))
    comp = components(edges)
    # Texts that share a signature share its hub: groups of a hub that span several classes are compared whole.
    group = spokes.select("hub", "rid").union(spokes.selectExpr("hub", "hub rid").distinct())
    group = group.join(comp.withColumnRenamed("id", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    mixed = group.groupBy("hub").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("k")).where("c0 <> c1")
    mixed = cut(mixed.select("hub", "k"))
    if not mixed.isEmpty():
        # blocks are bounded by texts and by shingles: long texts are dealt into more of them
        left = cut(group.join(small(mixed), "hub").join(info.select("rid", "n"), "rid"))
        sizes = left.groupBy("hub").agg(F.greatest(F.ceil(F.max("k") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        left = left.drop("k", "n").join(small(cut(sizes)), "hub").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
        wanted = cut(left.select("rid").distinct())
        some = cut(texts.join(small(wanted), "rid").select("rid", "text"))
        cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("lo"), F.greatest("block", o).alias("hi")))
        left = left.join(some, "rid").select("hub", F.explode(cells).alias("c"), "rid", "comp", "block", "text").select("hub", "c.lo", "c.hi", "rid", "comp", "block", "text")
        more = left.repartition("hub", "lo", "hi").sortWithinPartitions("hub", "lo", "hi").mapInArrow(_link_groups, "a long, b long")
        more = cut(more)
        if not more.isEmpty():
            comp = components(cut(edges.union(more)))
    return info.select("rid", F.col("n").alias("n_shingles")), comp


def _known(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(rid, doc_id, t1, t2, text) of every row, and whether rows without an id of their own exist. ``rid`` is the doc_id; rows with
    no doc_id, or with one that another text has too, are known by a hash of their text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumns(dict(zip(("t1", "t2"), hash128(F.col("text")), strict=True)))
    ids = docs.groupBy("doc_id").agg(F.min("t1").alias("a1"), F.max("t1").alias("b1"), F.min("t2").alias("a2"), F.max("t2").alias("b2"))
    shared = cut(ids.where("doc_id is null or a1 <> b1 or a2 <> b2").select(F.col("doc_id").alias("shared")))
    if shared.isEmpty():
        return docs.withColumn("rid", F.col("doc_id")), False
    marked = docs.join(small(shared), F.col("doc_id").eqNullSafe(F.col("shared")), "left")
    own = (F.col("shared").isNull()) & F.col("doc_id").isNotNull()
    return marked.withColumn("rid", F.when(own, F.col("doc_id")).otherwise(F.xxhash64(F.lit(9), "t1", "t2"))).drop("shared"), True


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, n_shingles, component_id, class) of every row: ``class`` names the class of near duplicates, component_id is its
    smallest doc_id (null if none of its rows has one)."""
    docs, odd = _known(docs)
    copies = cut(docs.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.min("rid").alias("one")).where("copies > 1"))
    marked = docs.join(small(copies), ["t1", "t2"], "left")
    texts = marked.where("copies is null or rid = one").select("rid", "text")
    if odd:  # the rows of one text and one id are one text
        texts = texts.dropDuplicates(["rid"])
    size, comp = links(texts)
    per = cut(size.join(comp.withColumnRenamed("id", "rid"), "rid", "left").withColumnRenamed("rid", "one_rid"))
    # Copies of a wordless text are not linked.
    rows = marked.select("doc_id", "t1", "t2", F.col("rid").alias("own"), F.coalesce("one", "rid").alias("one_rid")).join(per, "one_rid", "left")
    alone = F.col("n_shingles") == 0
    rows = rows.select("doc_id", "t1", "t2", "n_shingles", F.when(alone, F.col("own")).otherwise(F.coalesce("comp", "one_rid")).alias("class"))
    if not odd:
        return rows.withColumn("component_id", F.col("class"))
    rows = cut(rows)
    least = cut(rows.groupBy("class").agg(F.min("doc_id").alias("component_id")))
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(small(least), "class").withColumn("component_id", own)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``."""
    return labelled(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest doc_id (null last, then by text). Texts without words are no near
    duplicates, but rows that repeat one of them under one doc_id are one row."""
    rows = cut(labelled(docs))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "t1", "t2")
    kept = rows.groupBy("class", F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias("alone")).agg(F.min(first).alias("f"), F.count(F.lit(1)).alias("n"))
    gone = cut(kept.where("n > 1"))
    if gone.isEmpty():
        return docs
    names = {c: f"_{c}_{len(docs.columns)}" for c in ("doc_id", "t1", "t2")}
    # rows that go: all of their class but the first one, of which one copy stays
    drop = rows.join(small(gone.select(F.col("class").alias("k"), F.col("alone").alias("a"), "f")), (F.col("class") == F.col("k")) & F.when(F.col("n_shingles") == 0, F.col("doc_id")).eqNullSafe(F.col("a")))
    again = (F.col("doc_id").eqNullSafe(F.col("f.doc_id"))) & (F.col("t1") == F.col("f.t1")) & (F.col("t2") == F.col("f.t2"))
    drop = cut(drop.groupBy("doc_id", "t1", "t2").agg(F.min(again).alias("first"), F.count(F.lit(1)).alias("times")).where("not first or times > 1").withColumnsRenamed(names))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns(dict(zip((names["t1"], names["t2"]), hash128(text), strict=True)))
    left = F.col("doc_id").cast("long").eqNullSafe(F.col(f"x.{names['doc_id']}")) & (F.col(f"d.{names['t1']}") == F.col(f"x.{names['t1']}")) & (F.col(f"d.{names['t2']}") == F.col(f"x.{names['t2']}"))
    joined = keyed.alias("d").join(small(drop).alias("x"), left, "left")
    plain = joined.where(F.col("x.first").isNull()).select(*[F.col(f"d.`{c}`") for c in docs.columns])
    repeated = joined.where(F.col("x.first")).select(*[F.col(f"d.`{c}`") for c in docs.columns])
    if drop.where("first").isEmpty():
        return plain
    return plain.unionByName(repeated.dropDuplicates(["doc_id", "text"]))
