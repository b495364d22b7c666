"""MinHash near-dedup: SuperMinHash signatures, banding, verification, union-find.

1.  One scan names each document's shingle set (128 bits) and gives its band
    keys.  Documents with equal sets are one node from here on, however many
    they are.
2.  Nodes that share a band are candidates.  They are joined with the band's
    least node, never pair by pair, and connected through it into clusters.
3.  The full sets of the nodes in clusters (a second scan, thinned by a bit sieve
    of bounded size) are compared exactly, in tiles of at most a few hundred nodes and
    some megabytes: all intersection sizes of a tile come from products of 0/1
    matrices.  A tile returns a spanning forest of its links, found by union-find.
4.  A cluster that fits a tile is compared in one.  A larger one first passes two
    rounds of random tiles, which join a group of near copies at a cost in
    proportion to its size; then the nodes that share a band but are still in
    different components meet in tiles, band by band.

Bands of 5 of 120 values miss a pair at the similarity of 0.85 with a
probability of 8e-7.

Cases: a text without words, or null, has an empty set and is linked with
nothing.  Repeated rows are members of one node.  Documents with equal ids count as
one when components are named; a null id never names a component that has another.
A very long text is scanned whole, with 120 bytes of scratch for each shingle; two sets
always meet, whatever their size.  Empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.llm._spark import Scratch, Sieve, cut, forget, importable, small, split_by_sieve, table
from countloom.llm._words import NON_SPACE, chunks
from countloom.llm.graph import TASK_EDGES, components
from countloom.llm.superminhash import bands, set_keys, shingle_sets, signatures

VALUES = 120
BAND_ROWS = 5
TILE = 256
TILE_BYTES = 16 << 20  #: of the sets that meet in a tile
#: Bytes of text whose signatures are made at once; each shingle holds a permutation of the values meanwhile.
SCAN_BYTES = 1 << 20


def _fingerprints(docs: DataFrame, words: int, values: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, key, bands) of every document; key and bands are null for an empty set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in chunks(batch.column(1), NON_SPACE, limit=SCAN_BYTES):
                h, ptr = shingle_sets(w, words)
                n = np.diff(ptr)
                keys = set_keys(h, ptr)
                keyed = bands(signatures(h, ptr, values), rows).view(np.int64)
                empty = n == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j],
                        pa.array(n, pa.int64()),
                        pa.array([None if e else k.tobytes() for k, e in zip(keys, empty, strict=True)], pa.binary()),
                        pa.array([None if e else k for k, e in zip(keyed, empty, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "key", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, key binary, bands array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``nodes`` (key, doc_id, ...) with ``shingles``, each node's from a document with its set."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Sieve(nodes.select(F.xxhash64("doc_id").alias("at")), "at"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely = np.flatnonzero(shared.value.may_hold(batch.column(1).to_numpy()))
            for i, j, w in chunks(batch.column(0).take(pa.array(likely)), NON_SPACE):
                h, ptr = shingle_sets(w, words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k.tobytes() for k in set_keys(h, ptr)], pa.binary()), pa.array([h[ptr[d] : ptr[d + 1]].tobytes() for d in range(j - i)], pa.binary())],
                    names=["k", "shingles"],
                )

    found = docs.select("text", F.xxhash64("doc_id").alias("at")).mapInArrow(scan, "k binary, shingles binary")
    return found.join(nodes, F.col("k") == F.col("key")).dropDuplicates(["key"]).drop("k")


def links_of(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Symmetric matrix: 100 * intersection >= percent * union, from exact sizes."""
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(often > 1) - 1
    shared = often[column] > 1
    row, column = row[shared], number[column[shared]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    common = np.zeros((len(sets), len(sets)))
    width = 4096
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        held = np.zeros((len(sets), width), np.float32)
        held[row[a:b], column[a:b] - low] = 1
        common += held @ held.T
    return 100 * common >= percent * (n[:, None] + n[None, :] - common)


def _tile_links(placed: DataFrame, percent: int) -> DataFrame:
    """(a, b): links found within the tiles of ``placed`` (tile, node, comp, shingles) that join different components."""

    def compare(part: pa.Table) -> pa.Table:
        nodes, comps = part["node"].to_pylist(), part["comp"].to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in part["shingles"].to_pylist()]
        linked = links_of(sets, percent)
        parent = {c: c for c in comps}

        def top(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        a, b = [], []
        for i, j in np.argwhere(np.triu(linked, 1)).tolist():
            x, y = top(comps[i]), top(comps[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                a.append(nodes[i])
                b.append(nodes[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return placed.select("tile", "node", "comp", "shingles").groupBy("tile").applyInArrow(compare, "a long, b long")


def _relabel(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (node, ...) with comp: the component under all ``links`` so far."""
    found = components(links).withColumnRenamed("key", "node")
    return nodes.drop("comp").join(found, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")


def _parts(tile: int) -> Column:
    """How many tiles a group of nodes needs, by number and by bytes."""
    return F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("bytes") / F.lit(TILE_BYTES))).cast("long").alias("parts")


def _across(nodes: DataFrame, classes: DataFrame, tile: int, scratch: Scratch) -> DataFrame:
    """Places for ``nodes`` (node, comp, bytes, shingles): any two that share a band, in different components, share a tile.

    Bands that hold nodes of one component end at once; the others' members are
    written.  Within a band, nodes of a component that fills a tile are dealt into
    blocks of their own; the others are dealt into blocks by component.  Tiles are
    the pairs of blocks, but not two of the same large component.
    """
    held = classes.select("node", "bands").join(nodes.select("node", "comp", F.col("bytes").alias("size")), "node")
    held = held.select("node", "comp", F.col("size").alias("bytes"), F.explode("bands").alias("band"))
    several = held.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("band")
    held = scratch.cut(held.join(several, "band", "left_semi"))
    size = held.groupBy("band", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("all_bytes"), _parts(tile))
    own = size.where("parts > 1").select("band", "comp", "parts")
    rest = size.where("parts = 1").groupBy("band").agg(F.greatest(F.ceil(F.sum("n") / tile), F.ceil(F.sum("all_bytes") / F.lit(TILE_BYTES))).alias("rest"))
    spread = held.join(own, ["band", "comp"], "left").join(rest, "band", "left")
    large = F.col("parts").isNotNull()
    dealt = spread.withColumn("of", F.when(large, F.col("comp"))).withColumn("block", F.when(large, F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("comp"), F.col("rest"))))
    dealt = dealt.select("band", "of", F.xxhash64("band", F.coalesce("of", F.lit(-1)), "block").alias("name"), "node")
    blocks = dealt.select("band", "of", "name").distinct()
    other = blocks.select("band", F.col("of").alias("of2"), F.col("name").alias("name2"))
    pairs = blocks.join(other, "band").where((F.col("name") <= F.col("name2")) & ~F.coalesce(F.col("of") == F.col("of2"), F.lit(False)))
    pairs = pairs.withColumn("tile", F.xxhash64("band", "name", "name2"))
    members = pairs.select("tile", "name").union(pairs.select("tile", F.col("name2"))).distinct()
    return dealt.join(members, "name").select("tile", "node").join(nodes.select("node", "comp", "shingles"), "node")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, values: int = VALUES, rows: int = BAND_ROWS, tile: int = TILE, task_edges: int = TASK_EDGES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    importable(docs.sparkSession)
    scratch = Scratch()
    prints = scratch.cut(_fingerprints(docs, words, values, rows))
    classes = prints.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), (F.first("n_shingles") * 8).alias("bytes"))
    classes = scratch.cut(classes.withColumn("node", F.monotonically_increasing_id()))
    banded = classes.select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where(F.col("n") > 1)
    cluster = scratch.own(components(banded.join(hubs, "band").select(F.col("node").alias("a"), F.col("hub").alias("b")), task_edges)).withColumnsRenamed({"key": "node", "label": "cluster"})
    near = cluster.join(classes.drop("bands"), "node")
    several = small(scratch.cut(near.groupBy("cluster").agg(_parts(tile)).where("parts > 1")))
    near = scratch.cut(near.join(several, "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))))
    nodes = scratch.cut(_sets(docs, near, words).select("cluster", "parts", "bytes", "node", "shingles", F.col("node").alias("comp")))
    alone, large = nodes.where("parts = 1"), nodes.where("parts > 1")
    total = alone.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    packs = max(1, total.n * 2 // tile, total.b * 2 // TILE_BYTES)
    links = scratch.cut(_tile_links(alone.withColumn("tile", F.pmod(F.xxhash64("cluster"), F.lit(packs))), percent))
    if not large.isEmpty():
        for number in range(2):
            dealt = large.withColumn("tile", F.xxhash64("cluster", F.pmod(F.xxhash64("node", F.lit(number)), F.col("parts"))))
            links = scratch.cut(links.union(_tile_links(dealt, percent)))
            large = scratch.cut(_relabel(large, links))
        mixed = scratch.cut(large.groupBy("cluster").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("cluster"))
        if not mixed.isEmpty():
            links = scratch.cut(links.union(_tile_links(_across(large.join(small(mixed), "cluster", "left_semi"), classes, tile, scratch), percent)))
    label = scratch.own(components(links, task_edges)).withColumnRenamed("key", "node")
    label = scratch.cut(label.join(near.select("node", "key", "doc_id"), "node"))
    component = scratch.cut(label.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    linked = label.join(small(component), "label").select("key", "component_id")
    out = prints.select("doc_id", "n_shingles", "key").join(
        classes.select("key", F.col("doc_id").alias("least")).join(linked, "key", "left").select("key", F.coalesce("component_id", "least").alias("component_id")), "key", "left"
    )
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return scratch.finish(out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


#: The contract of the query and of the pipeline's stage.
SHINGLE_WORDS, PERCENT = 3, 85


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), SHINGLE_WORDS, PERCENT)


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, number): the rows of ``docs``, each with a number of its own that stays the same however often they are read.

    Numbers are places in files, in the order of the files' names.  A table that is not
    read from Parquet files as it stands is written first.
    """
    row = F.struct(*docs.columns).alias("row")
    if "_metadata" in map(str.lower, docs.columns) or not _read_as_it_stands(docs):
        docs, row = scratch.cut(docs.select(row)), F.col("row")
    at = docs.select(row, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index"))
    names = sorted(r.file for r in at.select("file").distinct().collect())
    order = docs.sparkSession.createDataFrame(list(enumerate(names)), "place long, file string")
    return at.join(F.broadcast(order), "file").select("row", (F.shiftleft("place", 40) + F.col("index")).alias("number"))


def _read_as_it_stands(docs: DataFrame) -> bool:
    plan = docs._jdf.queryExecution().analyzed()
    return plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.relation().toString().lower()


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the least id (the first, by file name and place, of equal ids or none); repeated rows and rows without an id are rows like others."""
    scratch = Scratch()
    rows = _numbered(docs, scratch)
    found = near_duplicates(rows.select(F.col("number").alias("doc_id"), "row.text"), SHINGLE_WORDS, PERCENT)
    label = found.select(F.col("doc_id").alias("number"), F.col("component_id").alias("group"), "kept")
    groups = cut(label.where("not kept").select("group").distinct())
    members = label.join(small(groups), "group", "left_semi").join(rows.select("number", "row.doc_id"), "number")
    members = cut(members.select("group", "number", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "number").alias("place")))
    first = cut(members.groupBy("group").agg(F.min("place").alias("first")))
    gone = scratch.cut(members.join(small(first), "group").where("number != first.number").select("number"))
    for x in (found, groups, members, first):
        forget(x)
    doubtful, sure = split_by_sieve(rows, "number", gone, "number")
    kept = sure.select("row").unionAll(doubtful.join(gone, "number", "left_anti").select("row"))
    return kept.select("row.*")


QUERIES = {"op10_near_dedup": op10_near_dedup}
ORACLE_SQL: dict[str, str] = {}
