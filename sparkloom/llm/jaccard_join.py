"""Exact n-gram Jaccard join by parity sketches.

A document is the set of its word shingles.  Its sketch deals the shingles to blocks and keeps the XOR of their
hashes in each block; a shingle that only one of two sets holds spoils one block at most, so the number of blocks
in which two sketches differ is a lower bound of the symmetric difference.  Two linked sets of sizes a and b differ
in (a + b) / 9 shingles at most (Jaccard 0.8), hence among the first a / 4 + 1 non-empty blocks of each there is one
that agrees: documents are joined on (size band, block, XOR), candidates are filtered by the distance of whole
sketches, and what remains is verified on the sets.

Links are only needed between components: copies with equal sets stand for one; each group of the join first tries
its members against one of them; what then still lies in different components is compared pair by pair, inside
the group and without being emitted, unless the sketches say that no link is possible.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import ascii_lower, discard, pick, slices, small_batches, written
from sparkloom.llm._components import components
from sparkloom.llm._words import mix, shared, shingle_sets

WIDTH, PERCENT = 5, 80
#: Members of a group that one task compares with as many others.
CHUNK = 2048
#: Partners of a document in other components that a group tries first; eight times as many in each further round.
NEAREST = 4
#: Documents whose signatures are counted to see which are common, and keys kept of those.
SAMPLE, MAX_COMMON = 10_000, 500_000
#: Up to so many ids, a filter by ids is broadcast; beyond it, it is a shuffle join.
BROADCAST_IDS = 1_000_000


class Bounds:
    """What a Jaccard threshold of percent / 100 says about sizes and differences."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent

    def difference(self, a, b):
        """The largest symmetric difference of linked sets of sizes a and b."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def sizes(self, a, b):
        """Whether sets of sizes a <= b can be linked at all."""
        return 100 * a >= self.percent * b

    def reach(self, a: int) -> int:
        """The largest symmetric difference of a set of size a and any set linked with it."""
        return int(self.difference(a, a * 100 // self.percent))


def bands(n: int, percent: int = PERCENT) -> list[int]:
    """The size bands of a set: its own, and the one below if a linked set may lie there."""
    own = n.bit_length() - 1
    return [own, own - 1] if own and 100 * ((1 << own) - 1) >= percent * n else [own]


def needed(n: int, band: int, percent: int = PERCENT) -> int:
    """Of so many blocks of a set of size n, a set of the band that is linked with it cannot spoil all."""
    rule = Bounds(percent)
    return 1 + min(rule.reach(n), int(rule.difference(n, max(n * 100 // percent if n < 2 << band else 0, (2 << band) - 1))))


def n_blocks(band: int) -> int:
    """Blocks of the sketches of a band: a few more than differences are allowed, so that most hold several shingles."""
    return max(8, 5 << band >> 3)


def sketch(shingles: np.ndarray, band: int, blocks: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(non-empty blocks in order, XOR of the shingles' hashes in each, shingles in each)."""
    m = blocks or n_blocks(band)
    block = ((mix(shingles, 2) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    order = np.argsort(block, kind="stable")
    block = block[order]
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    return block[first], np.bitwise_xor.reduceat(mix(shingles, 3)[order], first), np.diff(np.append(first, len(block)))


def all_signatures(shingles: np.ndarray, percent: int = PERCENT) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(band, join keys of the blocks, shingles in each) for each band of a set; a block's key covers its XOR and count.

    Empty blocks are among them only where the others are fewer than a linked set can spoil.
    """
    out = []
    for band in bands(len(shingles), percent):
        block, parity, count = sketch(shingles, band)
        if len(block) < needed(len(shingles), band, percent):
            empty = np.setdiff1d(np.arange(n_blocks(band), dtype=np.uint64), block)
            block, parity, count = np.append(block, empty), np.append(parity, np.zeros(len(empty), np.uint64)), np.append(count, np.zeros(len(empty), np.int64))
        out.append((band, mix(parity ^ mix(block + (count.astype(np.uint64) << np.uint64(40)), 100 + band), 4), count))
    return out


def signatures(shingles: np.ndarray, percent: int = PERCENT, common: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, np.ndarray]]:
    """(band, join keys) for each band of a set: as many as a linked set cannot all spoil.

    Keys are taken in an order that all documents share, as what it looks at is part of the key: those not in
    ``common`` (sorted keys, their frequencies in a sample) first, then the rarer ones; among these, blocks of many
    shingles first, for they seldom agree by chance.  Any such order keeps the guarantee.
    """
    out = []
    for band, keys, count in all_signatures(shingles, percent):
        often = np.zeros(len(keys), np.int64)
        if common is not None and len(common[0]):
            at = np.searchsorted(common[0], keys)
            at[at == len(common[0])] = 0
            often = np.where(common[0][at] == keys, common[1][at], 0)
        out.append((band, keys[np.lexsort((keys, -count, often))][: needed(len(shingles), band, percent)]))
    return out


def parity_bits(shingles: np.ndarray, band: int) -> bytes:
    """The parities of the shingles hashed to each of a band's bits: two of these differ in no more bits than the sets
    differ in shingles."""
    bits = max(512, 8 << band)
    at = ((mix(shingles, 5) >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def distances(sketches: np.ndarray, one: bytes) -> np.ndarray:
    """Differing bits of each row of sketches (as 64-bit words) and one sketch."""
    return np.bitwise_count(sketches ^ np.frombuffer(one, np.uint64)).sum(axis=1, dtype=np.int64)


def _sets(texts) -> list[tuple[np.ndarray, np.ndarray]]:
    return shingle_sets([ascii_lower(t) for t in texts], WIDTH)


def _names(texts) -> list[np.ndarray]:
    """The first names of the shingles; sketches and signatures need no more."""
    return [s[0] for s in _sets(texts)]


def _with_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with ids (doc_id), broadcast only if they are few."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (a 128-bit digest of the set; null if it is empty)."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary())])
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sets = _sets(batch.column(1).to_pylist())
                keys = [hashlib.blake2b(s[0].tobytes() + s[1].tobytes(), digest_size=16).digest() if len(s[0]) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s[0]) for s in sets], pa.int64()), pa.array(keys, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary")


def common_signatures(docs: DataFrame, percent: int = PERCENT, sample: int = SAMPLE, most: int = MAX_COMMON) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, frequencies) of the signatures that occur three times or more in a bounded sample of documents.

    The sample is the ``sample`` documents with the smallest hashed ids; at most ``most`` keys come back.  They decide
    the order of signatures and nothing else.
    """

    def emit(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                keys = [k for s in _names(batch.column(0).to_pylist()) if len(s) for _, k, _ in all_signatures(s, percent)]
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64))], ["sig"])

    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id")).limit(sample)
    some = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text")  # ``sample`` ids
    counts = some.mapInArrow(emit, "sig long").groupBy("sig").agg(F.count("*").alias("n")).where("n >= 3")
    got = counts.orderBy(F.desc("n"), "sig").limit(most).toArrow()
    keys, n = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def groups_of(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """sig, band, doc_id, centre: the groups of two or more documents (doc_id, text) that share a signature.

    ``centre`` is the group's smallest id.  Signatures are sorted in the shuffle and read as a stream, so a group
    of any size needs no memory.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common_signatures(docs, percent))  # bounded by MAX_COMMON

    def emit(batches):
        schema = pa.schema([("sig", pa.int64()), ("band", pa.int16()), ("doc_id", pa.int64())])
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sig, band, owner = [], [], []
                for doc, s in zip(batch.column(0).to_pylist(), _names(batch.column(1).to_pylist()), strict=True):
                    for b, keys in signatures(s, percent, shared.value) if len(s) else ():
                        sig.append(keys.view(np.int64)), band.append(np.full(len(keys), b, np.int16)), owner.append(np.full(len(keys), doc, np.int64))
                if sig:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sig, band, owner)], schema=schema)

    def groups(batches):
        schema = pa.schema([("sig", pa.int64()), ("band", pa.int16()), ("doc_id", pa.int64()), ("centre", pa.int64())])
        last = None  # the row not yet emitted (sig, band, doc, centre, whether its group has been opened)
        for batch in batches:
            sig, band, doc = [c.to_numpy() for c in batch.columns]
            if not len(sig):
                continue
            if last is not None:
                sig, band, doc = np.append(last[0], sig), np.append(last[1], band), np.append(last[2], doc)
            new = np.concatenate([[True], sig[1:] != sig[:-1]])
            keep = new | np.concatenate([[True], doc[1:] != doc[:-1]])
            at = np.flatnonzero(keep)
            sig, band, doc, new = sig[at], band[at], doc[at], new[at]
            start = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            centre = doc[start][group]
            size = np.bincount(group)[group]
            if last is not None:
                centre[group == 0] = last[3]
            out = size > 1
            if last is not None and last[4]:
                out |= group == 0
                out[0] = False  # emitted before
            opened = bool(size[-1] > 1 or (group[-1] == 0 and last is not None and last[4]))
            last = (sig[-1], band[-1], doc[-1], centre[-1], opened)
            if not out.any():
                continue
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (sig, band, doc, centre)], schema=schema)

    rows = docs.mapInArrow(emit, "sig long, band short, doc_id long").repartition("sig").sortWithinPartitions("sig", "doc_id")
    return rows.mapInArrow(groups, "sig long, band short, doc_id long, centre long")


def verified(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets are linked; ``docs`` (doc_id, text) has all their documents.

    Shingles are compared by both their names, 128 bits of their words.  Only the texts of the pairs' documents move.
    """

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for whole in batches:
            for batch in slices(whole, "text_a", 1 << 20):
                a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                ta, tb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                distinct = list({*ta, *tb})
                sets = dict(zip(distinct, _sets(distinct), strict=True))
                good = []
                for i in range(len(a)):
                    x, y = sets[ta[i]], sets[tb[i]]
                    n = shared(x, y)
                    if n and 100 * n >= percent * (len(x[0]) + len(y[0]) - n):
                        good.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], schema=schema)

    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "paired")
    texts = _with_ids(docs, ids, "left_semi")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    out = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()
    out = written(out, "verified")
    discard(ids)
    return out


def _labels(links: DataFrame) -> DataFrame:
    """A written table: doc_id, component of every document with links."""
    out = components(links)
    table = out.withColumnRenamed("node", "doc_id")
    table.written_to = out.written_to
    return table


def _short_sketches(texts: DataFrame, percent: int) -> DataFrame:
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("band", pa.int16()), ("size", pa.int64()), ("sketch", pa.binary())])
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                rows = []
                for doc, s in zip(batch.column(0).to_pylist(), _names(batch.column(1).to_pylist()), strict=True):
                    rows += [(doc, b, len(s), parity_bits(s, b)) for b in (bands(len(s), percent) if len(s) else ())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)

    return texts.mapInArrow(run, "doc_id long, band short, size long, sketch binary")


def near_enough(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, band) whose sizes and sketches allow a link."""
    rule = Bounds(percent)

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            a, b, x, y = [batch.column(i).to_numpy() for i in range(4)]
            far = np.array([int.from_bytes(p, "little") ^ int.from_bytes(q, "little") for p, q in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], object)
            far = np.array([n.bit_count() for n in far], np.int64)
            ok = rule.sizes(np.minimum(x, y), np.maximum(x, y)) & (far <= rule.difference(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], schema=schema)

    side = lambda k: sketches.select(F.col("doc_id").alias(k), "band", F.col("size").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))
    both = pairs.join(side("a"), ["a", "band"]).join(side("b"), ["b", "band"])
    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _cell(role, doc, comp, size, book, most: int, rule: Bounds) -> tuple[list[int], list[int], list[bool]]:
    """(a, b, cut) pairs of a cell that lie in different components and whose sketches allow a link.

    Role 0 are documents outside the group's largest component, role 1 all that they meet.  Of a document's partners
    only the nearest ``most`` are given, and ``cut`` says that some were left out.
    """
    full = np.flatnonzero(role == 1)
    out_a, out_b, out_cut = [], [], []
    docs, comps, sizes = doc[full], comp[full], size[full]
    sketches = np.frombuffer(b"".join([book[i] for i in full]), np.uint64).reshape(len(full), -1)
    for i in np.flatnonzero(role == 0):
        n = size[i]
        at = np.flatnonzero((comps != comp[i]) & rule.sizes(np.minimum(sizes, n), np.maximum(sizes, n)))
        if not len(at):
            continue
        far = distances(sketches[at], book[i])
        near = far <= rule.difference(sizes[at], n)
        at, far, cut = at[near], far[near], False
        if len(at) > most:
            cut, at = True, at[np.lexsort((docs[at], far))[:most]]
        out_a += np.minimum(docs[at], doc[i]).tolist()
        out_b += np.maximum(docs[at], doc[i]).tolist()
        out_cut += [cut] * len(at)
    return out_a, out_b, out_cut


def _compare(most: int, percent: int):
    """The pairs of all cells; rows come sorted by cell, and a cell has a bounded number of them."""
    rule = Bounds(percent)

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cut", pa.bool_())])
        held = None

        def pairs(table):
            key = [table.column(c).to_numpy() for c in range(3)]
            role, doc, comp, size = [table.column(c).to_numpy() for c in range(3, 7)]
            book = table.column(7).to_pylist()
            new = np.concatenate([[True], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])])
            edge = np.append(np.flatnonzero(new), len(doc)).tolist()
            a, b, cut = [], [], []
            for x, y in zip(edge, edge[1:], strict=False):
                if 0 < role[x:y].sum() < y - x:
                    for to, got in zip((a, b, cut), _cell(role[x:y], doc[x:y], comp[x:y], size[x:y], book[x:y], most, rule), strict=True):
                        to += got
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cut, pa.bool_())], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = [table.column(c)[table.num_rows - 1].as_py() for c in range(3)]
            same = np.logical_and.reduce([table.column(c).to_numpy() == v for c, v in enumerate(last)])
            begin = int(np.argmax(same))  # the last cell may go on in the next batch
            if begin:
                yield pairs(table.slice(0, begin))
            held = table.slice(begin)
        if held is not None:
            yield pairs(held)

    return run


def across(members: DataFrame, labels: DataFrame, sketches: DataFrame, most: int, percent: int) -> DataFrame:
    """a, b, cut: pairs of members of one group in different components that may be linked; cut: some were left out.

    Groups of equal members and components count once.
    """
    known = members.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")).select("sig", "band", "doc_id", "component")
    parts = known.groupBy("sig", "component").agg(F.count("*").alias("c"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("x"))
    one = parts.groupBy("sig").agg(F.count("*").alias("k"), F.sum("c").alias("g"), F.max(F.struct("c", "component")).alias("m"), F.sum("h").alias("h"), F.bit_xor("x").alias("x")).where("k > 1")
    one = one.groupBy("g", "h", "x").agg(F.min_by(F.struct("sig", "m"), "sig").alias("o")).select("o.sig", "g", F.col("o.m.component").alias("major"), F.col("o.m.c").alias("c"))
    one = written(one.select("sig", "major", F.ceil(F.col("g") / CHUNK).cast("int").alias("nj"), F.ceil((F.col("g") - F.col("c")) / CHUNK).cast("int").alias("ni")), "open")
    rows = known.join(one, "sig").join(sketches, ["doc_id", "band"])
    cut = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    full = F.transform(F.sequence(F.lit(0), F.col("ni") - 1), lambda i: F.struct(F.lit(1).alias("role"), i.alias("i"), cut("nj").alias("j")))
    minor = F.transform(F.sequence(F.lit(0), F.col("nj") - 1), lambda j: F.struct(F.lit(0).alias("role"), cut("ni").alias("i"), j.alias("j")))
    places = F.explode(F.when(F.col("component") != F.col("major"), F.concat(full, minor)).otherwise(full))
    cells = rows.select("sig", "doc_id", "component", "size", "sketch", places.alias("p")).select("sig", "p.i", "p.j", "p.role", "doc_id", "component", "size", "sketch")
    cells = cells.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    pairs = cells.mapInArrow(_compare(most, percent), "a long, b long, cut boolean")
    out = written(pairs.groupBy("a", "b").agg(F.max("cut").alias("cut")), "pairs")
    discard(one)
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Shingles are five words, with A-Z in lower case; a text of fewer words is one shingle; null text and text
    without words have none and are linked with nothing.  Documents are linked when their sets' Jaccard similarity
    is ``percent`` / 100 or more; component_id is the smallest doc_id reachable by links, the document included.
    Rows that repeat a doc_id count as one document (if their texts differ, with the links of all of them); a null
    doc_id takes no part and has a null component.  An empty table gives an empty result.
    """
    small_batches(docs)
    base = pick(docs, "doc_id", "text")
    sets = written(digests(base), "sets")
    named = sets.where("doc_id is not null and set_key is not null")
    first = named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    first = written(first, "copies")
    copied = named.join(first, "set_key").where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    several = named.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x != y").select(F.col("doc_id").alias("b"))
    several = written(copied.join(several, "b", "left_semi").select("a", "b"), "several")  # ids of different texts take part themselves
    extra = written(copied.join(several, "b", "left_anti").select(F.col("b").alias("doc_id")).distinct(), "extra")
    texts = base.where("doc_id is not null and text is not null")
    members = written(groups_of(_with_ids(texts, extra, "left_anti"), percent), "members")

    ids = written(members.select("doc_id").distinct(), "candidates")
    sketches = written(_short_sketches(_with_ids(texts, ids, "left_semi"), percent).dropDuplicates(["doc_id", "band", "sketch"]), "sketches")
    star = members.where("doc_id != centre").groupBy(F.col("centre").alias("a"), F.col("doc_id").alias("b")).agg(F.min("band").alias("band"))
    # every document's smallest partner first; what that does not link is met below, with all the others
    tree = written(near_enough(star, sketches, percent).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    links = verified(tree, texts, percent)
    labels = _labels(links.unionByName(several))
    discard(tree, links, several)
    most, cut = NEAREST, True
    while cut:  # ends with all partners looked at; nearly all of them are known to be linked by then
        pairs = across(members, labels, sketches, most, percent)
        n, cut = pairs.agg(F.count("*"), F.coalesce(F.bool_or("cut"), F.lit(False))).first()
        most *= 8
        if n:
            found = verified(pairs, texts, percent)
            old, labels = labels, _labels(labels.select(F.col("component").alias("a"), F.col("doc_id").alias("b")).unionByName(found))
            discard(old, found)
        discard(pairs)
    discard(extra, members, ids, sketches)
    root = labels.withColumnsRenamed({"doc_id": "rep", "component": "_root"})
    by_set = first.join(root, "rep", "left").select("set_key", F.coalesce("_root", "rep").alias("_copied"))
    out = sets.join(by_set, "set_key", "left").join(labels.withColumnRenamed("component", "_own"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_own", "_copied", "doc_id")).alias("component_id"))


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of near-duplicates among all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, md5('whole:' || array_to_string(ws, ' ')) FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, other) AS (SELECT a, b FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, min(other) AS least FROM r GROUP BY 1) m ON m.doc_id = w.doc_id
"""
