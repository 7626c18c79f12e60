"""MinHash near-duplicates: BagMinHash signatures of word 5-shingle multisets, banding, exact verification.

Two texts are linked if the Jaccard similarity of their shingle multisets is at least 0.8; classes are the
connected components of the links. Equal texts are one node from the start. The bands of a signature put a node into
buckets. First each node is verified against the leader (least node) of each of its buckets, one row a node and leader;
the links found make components. Where the other nodes of a bucket then lie in different components, all pairs across
these are verified: pair by pair in buckets of up to ``FEW`` nodes, else chunk by chunk (``CHUNK`` nodes), without
the pairs that got connected meanwhile. So every pair that shares a band is verified or already connected, whatever the
size of its bucket, and a group of copies costs rows in proportion to its members.

Cases: null counts as empty; empty texts are equal to each other; texts without words, or with fewer than five
words, are compared as one shingle of all their words (without words: only equal texts are linked); very long texts
are taken whole; repeated rows share a class; null ids are kept and a class of null ids only has the class id null;
no rows give no rows; extra columns are ignored, whatever their names (``kept`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bagminhash, components, counts, store, text

FEW = 32
CHUNK = 256
HOT_ROWS = 1000  # a text of more rows is joined apart; there is at most one for so many rows
_LOWEST = -(2**63)
_CODEC = "zstd"


def _digest():
    return F.unhex(F.substring(F.sha2("text", 256), 1, 32))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, digest, weight (shingles), signature (16 bits a register) of every document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text.slices(batches):
            words = text.words_of(piece.column(2))
            doc, value, n = text.counted(*text.shingles(words, words.hashes()))
            made = bagminhash.signatures(doc, value, n, words.n_docs)
            narrow = (text.mix(made) & np.uint64(0xFFFF)).astype("<u2").tobytes()
            weight = np.bincount(doc, n, words.n_docs).astype(np.int64)
            kept = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * bagminhash.REGISTERS), words.n_docs, [None, pa.py_buffer(narrow)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(weight), kept], ["doc_id", "digest", "weight", "signature"])

    whole = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.select("doc_id", _digest().alias("digest"), "text").mapInArrow(sign, "doc_id long, digest binary, weight long, signature binary")


def _bucketed(nodes: DataFrame) -> DataFrame:
    """(key, node): one row a node and band."""
    size = 2 * bagminhash.ROWS
    bands = [F.xxhash64(F.lit(b), F.substring("signature", b * size + 1, size)) for b in range(bagminhash.REGISTERS // bagminhash.ROWS)]
    return nodes.where("weight > 0").select("node", F.explode(F.array(*bands)).alias("key"))


def _bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compressed texts -> where each one's shingles begin (one more at the end), their hashes and counts."""
    raw = [pa.decompress(b[4:], int.from_bytes(b[:4], "little"), _CODEC).to_pybytes() for b in column.to_pylist()]
    words = text.words_of(pa.array(raw, pa.binary()))
    doc, value, n = text.counted(*text.shingles(words, words.hashes()))
    return np.searchsorted(doc, np.arange(len(raw) + 1)), value, n


def _shared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """The size of the intersection of two sorted multisets."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    return int(np.where(b[0][at] == a[0], np.minimum(a[1], b[1][at]), 0).sum())


def _similar(shared: int, total: int) -> bool:
    return 5 * shared >= 4 * (total - shared)


def _streams(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, bool]]:
    """Rows of a sorted stream, a slice of bags at a time, and whether a group of equal ``keys`` begins with the slice. Slices end
    where a group does."""
    last = None
    for piece in text.slices(batches, "bag", 1 << 18):
        table = pa.Table.from_batches([piece])
        columns = [table[k].to_numpy() for k in keys]
        new = np.ones(len(table), bool)
        for i in range(1, len(table)):
            new[i] = any(c[i] != c[i - 1] for c in columns)
        edges = np.append(np.flatnonzero(new), len(table))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = tuple(int(c[lo]) for c in columns)
            yield table.slice(lo, hi - lo), own != last
            last = own


def _verified(pairs: DataFrame, bags: DataFrame, chunk: int) -> DataFrame:
    """The pairs (u, v) whose multisets are similar. The bag of v travels with each pair; that of u once for ``chunk`` of its pairs."""
    many = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts"))
    hot = many.where("parts > 1")
    part = F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int")
    bags = bags.select("node", "weight", "bag")
    dealt = counts.joined_by_size(pairs, hot, ["u"], "left").select("u", part.alias("part"), F.col("v").alias("node"))
    members = dealt.join(bags, "node").select("u", "part", F.lit(1).alias("side"), "node", "weight", "bag")
    leaders = bags.join(many.withColumnRenamed("u", "node"), "node").select(F.col("node").alias("u"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "node", "weight", "bag")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = None
        for rows, new in _streams(batches, ["u", "part"]):
            at, value, n = _bags(rows["bag"].combine_chunks())
            weight, node = rows["weight"].to_numpy(), rows["node"].to_numpy()
            if new:
                leader = (value[at[0] : at[1]], n[at[0] : at[1]], int(weight[0]))
            keep = []
            for i in range(int(new), len(rows)):
                w = int(weight[i])
                near = 5 * min(w, leader[2]) >= 4 * max(w, leader[2])
                keep.append(near and _similar(_shared(leader[:2], (value[at[i] : at[i + 1]], n[at[i] : at[i + 1]])), w + leader[2]))
            hit = np.flatnonzero(keep) + int(new)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(rows["u"].to_numpy()[hit]), pa.array(node[hit])], ["u", "v"])

    return leaders.union(members).repartition("u", "part").sortWithinPartitions("u", "part", "side").mapInArrow(verify, "u long, v long")


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def _block_links(rows: pa.Table) -> list[tuple[int, int]]:
    """A forest of the links between the components of the two sides of a block (or of one side, if it is alone), of pairs that share
    a band."""
    side, node, weight, component = (rows[c].to_numpy() for c in ("side", "node", "weight", "component"))
    signature = np.frombuffer(text.bytes_of(rows["signature"])[0].tobytes(), "<u2").reshape(len(node), -1, bagminhash.ROWS)
    at, value, n = _bags(rows["bag"].combine_chunks())
    places = {c: i for i, c in enumerate(dict.fromkeys(component.tolist()))}
    own = np.array([places[c] for c in component.tolist()])
    forest, out = _Forest(len(places)), []
    left = np.flatnonzero(side == 1)
    alone = not (side == 0).any() or not len(left)
    left = np.arange(len(side)) if alone else left
    right = left if alone else np.flatnonzero(side == 0)
    for i in left.tolist():
        others = right[right > i] if alone else right
        others = others[(own[others] != own[i]) & (5 * weight[others] >= 4 * weight[i]) & (4 * weight[others] <= 5 * weight[i])]
        others = others[(signature[others] == signature[i]).all(axis=2).any(axis=1)]
        for j in others.tolist():
            a, b = forest.root(int(own[i])), forest.root(int(own[j]))
            if a != b and _similar(_shared((value[at[i] : at[i + 1]], n[at[i] : at[i + 1]]), (value[at[j] : at[j + 1]], n[at[j] : at[j + 1]])), int(weight[i] + weight[j])):
                forest.up[a] = b
                out.append((int(node[i]), int(node[j])))
    return out


def _apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` (key, node, n) of buckets whose nodes lie in several components: with component, and whether it is the one of most."""
    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    each = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    most = each.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max_by("component", F.struct("c", "component")).alias("most")).where("kinds > 1")
    return placed.join(most.select("key", "most"), "key").select("key", "node", "component", "n", "most", (F.col("component") == F.col("most")).alias("main"))


def _across(members: DataFrame, bags: DataFrame, chunk: int) -> DataFrame:
    """``_apart`` members of large buckets: links between components of a bucket. Buckets of one main component are taken together:
    its nodes are dealt to chunks once; the others go to each chunk, and to chunks of their own that are compared two by two."""
    members = members.select(F.col("most").alias("key"), "node", "component", "main").distinct()
    sizes = members.groupBy("key").agg(F.ceil(F.count_if("main") / chunk).cast("int").alias("mains"), F.ceil(F.count_if(~F.col("main")) / chunk).cast("int").alias("others"))
    dealt = members.join(sizes, "key")
    place = lambda n: F.pmod(F.xxhash64("node", F.lit(5)), n).cast("int")
    rest = dealt.where("NOT main").withColumn("own", place(F.col("others")))
    columns = ["key", "lo", "hi", "side", "node", "component"]
    main = dealt.where("main").select("key", place(F.col("mains")).alias("lo"), F.lit(-1).alias("hi"), F.lit(0).alias("side"), "node", "component")
    facing = rest.select("key", F.explode(F.sequence(F.lit(0), F.col("mains") - 1)).alias("lo"), F.lit(-1).alias("hi"), F.lit(1).alias("side"), "node", "component")
    among = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    among = among.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "component")
    every = main.select(*columns).union(facing.select(*columns)).union(among.select(*columns))

    def link(rows: pa.Table) -> pa.Table:
        out = _block_links(rows)
        return pa.table({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})

    return every.join(bags, "node").groupBy("key", "lo", "hi").applyInArrow(link, "u long, v long")


def bags_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (node, weight, signature, digest, first_id) -> node, weight, signature, bag: the compressed text, read at one document
    of each node."""
    holder = F.xxhash64("digest", "first_id")
    shared = docs.sparkSession.sparkContext.broadcast(store.sketch(wanted.select(holder.alias("h"))))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text.slices(batches, "text"):
            asked = pa.array(store.marked(shared.value, piece.column(3).to_numpy()))
            piece = piece.filter(asked)
            raw = piece.column(2).cast(pa.binary()).to_pylist()
            bags = [len(x).to_bytes(4, "little") + pa.compress(x, _CODEC, asbytes=True) for x in raw]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(bags, pa.binary())], ["digest", "first_id", "bag"])

    whole = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("first_id"))
    whole = whole.select(_digest().alias("digest"), "first_id", "text").withColumn("h", holder)
    found = whole.mapInArrow(compress, "digest binary, first_id long, bag binary").dropDuplicates(["digest"])
    return wanted.join(found.select("digest", "bag"), "digest").select("node", "weight", "signature", "bag")


def classes(docs: DataFrame, few: int = FEW, chunk: int = CHUNK) -> DataFrame:
    """doc_id, class_id (least doc_id of the class) and class_node of every document."""
    store.release(docs.sparkSession)
    rows = store.saved(signed(docs), "signed")
    lowest = F.lit(_LOWEST)
    nodes = rows.groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.min(F.coalesce("doc_id", lowest)).alias("first_id"), F.first("weight").alias("weight"), F.first("signature").alias("signature"))
    nodes = store.saved(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # fixed once written
    store.release(docs.sparkSession)
    keyed = _bucketed(nodes)
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1")
    members = store.saved(keyed.join(buckets, "key"), "buckets")
    pairs = store.saved(members.where("node != leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct(), "pairs")
    involved = members.select("node").distinct()
    bags = store.saved(bags_of(docs, involved.join(nodes, "node").select("node", "weight", "signature", "digest", "first_id")), "bags")
    store.release(docs.sparkSession)
    links = store.saved(_verified(pairs, bags, chunk), "links")
    found = store.saved(components.components(links), "components")
    store.release(docs.sparkSession)

    # a bucket's leader has met all others; these have to meet where they are still apart
    rest = members.where("n > 2 AND node != leader").select("key", "node", "n")
    edges = lambda known: known.select(F.col("node").alias("u"), F.col("component").alias("v"))
    rest = store.saved(_apart(rest, found), "apart")
    small = rest.where(F.col("n") <= few).select("key", "node", "component")
    a, b = (small.select("key", F.col("node").alias(u), F.col("component").alias(f"{u}_component")) for u in "uv")
    more = a.join(b, "key").where("u < v AND u_component != v_component").select("u", "v").distinct().join(pairs, ["u", "v"], "left_anti")
    more = store.saved(_verified(more, bags, chunk).union(_across(rest.where(F.col("n") > few), bags, chunk)), "links")
    linked = components.components(edges(found).union(more)) if more.limit(1).count() else found
    of_node = nodes.select("node", "digest", "least_id").join(linked, "node", "left").withColumn("class_node", F.coalesce("component", "node"))
    ids = of_node.groupBy("class_node").agg(F.min("least_id").alias("class_id"))
    of_digest = of_node.join(ids, "class_node").select("digest", "class_id", "class_node")
    out = store.saved(of_digest, "classes")
    store.delete(members, pairs, bags, links, rest, more)
    often = rows.groupBy("digest").count().where(F.col("count") > HOT_ROWS).select("digest")
    often = counts.joined_by_size(out, often, ["digest"], "left_semi")
    columns = ["doc_id", "class_id", "class_node", "digest"]
    seldom = counts.joined_by_size(rows.select("doc_id", "digest"), often.select("digest"), ["digest"], "left_anti").join(out, "digest")
    return seldom.select(*columns).union(counts.joined_by_size(rows.select("doc_id", "digest"), often, ["digest"], "inner").select(*columns))


def kept(docs: DataFrame) -> DataFrame:
    """One document of each class, whole: that of the least doc_id (null last; equal ids: any one)."""
    spark = docs.sparkSession
    of_class = classes(docs)
    chosen = of_class.groupBy("class_node").agg(F.min_by(F.struct("doc_id", "digest"), F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("c"))
    names = store.fresh(docs, "id", "digest")
    id_, digest = names.values()
    lowest = F.lit(_LOWEST)
    chosen = store.saved(chosen.select(F.coalesce("c.doc_id", lowest).alias(id_), F.col("c.digest").alias(digest)), "kept")
    store.release(spark)
    rows = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), lowest)).withColumn(digest, F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)))
    rows = counts.joined_by_size(rows, chosen, [id_, digest], "left_semi")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if repeated:  # rows that repeat both id and text are told apart by nothing else
        rows = rows.dropDuplicates([id_, digest])
    return rows.select(*docs.columns)
