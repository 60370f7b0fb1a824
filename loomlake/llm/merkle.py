"""A Merkle manifest of a dataset, and re-folding of changed rows, by a tree of SHA-256 states (operator 12).

Leaves are ordered within their language by a range partitioning; a rank within a partition plus the
counts of the partitions before it is a leaf's place, so no language passes through one task. The tree has
FANOUT children a node. FANOUT ** LEVELS neighbouring nodes are one group, which a task folds by
LEVELS levels at once; their results are the nodes of the next round, until each language has one node.
The languages' nodes are one more tree of the same kind.

A parent takes its children's digests one after another and retains a copy of the hash state before each
of them. To fold a changed child, the state before its slot is resumed with the replacement and with the
siblings to its right only; what stands to its left is never hashed again. Going down again, each group
gets the siblings above it, and its leaves get their proofs and their new roots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.llm.common import checked, written

#: Children of a node, and levels that a task folds at once.
FANOUT, LEVELS = 8, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(row: dict[str, Column]) -> Column:
    """The digest of a row: each field as its byte count, a colon and its UTF-8 text; a null field as a minus."""
    fields = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in row.values()]
    return F.sha2(F.concat(*fields), 256)


class Node:
    """A parent: its digest, and the hash state before each child slot."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[bytes]) -> None:
        self.children, self.states = children, []
        h = hashlib.sha256()
        for c in children:
            self.states.append(h.copy())
            h.update(c)
        self.digest = h.hexdigest().encode()

    def folded(self, slot: int, replacement: bytes) -> bytes:
        """The digest with another child in the slot."""
        h = self.states[slot].copy()
        h.update(replacement)
        for c in self.children[slot + 1 :]:
            h.update(c)
        return h.hexdigest().encode()

    def siblings(self, slot: int) -> tuple[bytes, bytes]:
        return b"".join(self.children[:slot]), b"".join(self.children[slot + 1 :])


def levels_of(digests: list[bytes], height: int) -> list[list[Node]]:
    """The parents of a group of neighbouring nodes, level by level."""
    out, now = [], digests
    for _ in range(height):
        out.append([Node(now[at : at + FANOUT]) for at in range(0, len(now), FANOUT)])
        now = [p.digest for p in out[-1]]
    return out


class Above:
    """What stands above a group: the siblings at each level, with the states before the group's own slot."""

    def __init__(self, path: list[tuple[bytes, bytes]]) -> None:
        self.siblings = b"".join([left + right for left, right in path])
        self.path = [(hashlib.sha256(left), right) for left, right in path]

    def folded(self, digest: bytes) -> bytes:
        for state, right in self.path:
            h = state.copy()
            h.update(digest)
            h.update(right)
            digest = h.hexdigest().encode()
        return digest


def _height(n: Column) -> Column:
    """Levels until n nodes are one."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), lambda a, k: F.when(F.pow(F.lit(float(FANOUT)), (k - 1).cast("double")) < n, k).otherwise(a))


def _roots(nodes: pa.Table) -> pa.Table:
    nodes = nodes.sort_by("pos")
    top = levels_of([d.encode() for d in nodes["digest"].to_pylist()], nodes["height"][0].as_py())
    digest = top[-1][0].digest.decode() if top else nodes["digest"][0].as_py()
    return pa.table({"tree": nodes["tree"][:1], "pos": nodes["group"][:1], "digest": pa.array([digest])})


_PATH = "array<struct<l:string,r:string>>"


def _paths(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """The siblings above every node of a group, from those above the group."""
    nodes = nodes.sort_by("pos")
    parents = levels_of([d.encode() for d in nodes["digest"].to_pylist()], nodes["height"][0].as_py()) if nodes.num_rows else []
    rest = above["path"][0].as_py() if above.num_rows else []
    paths = []
    for k in range(nodes.num_rows):
        own = []
        for level in parents:
            left, right = level[k // FANOUT].siblings(k % FANOUT)
            own.append({"l": left.decode(), "r": right.decode()})
            k //= FANOUT
        paths.append(own + rest)
    kind = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
    return pa.table({"tree": nodes["tree"], "pos": nodes["pos"], "path": pa.array(paths, kind)})


def _proofs(root: str, kind: pa.DataType):
    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        digests = [d.encode() for d in nodes["digest"].to_pylist()]
        parents = levels_of(digests, nodes["height"][0].as_py()) if nodes.num_rows else []
        rest = Above([(x["l"].encode(), x["r"].encode()) for x in above["path"][0].as_py()] if above.num_rows else [])
        proofs, folded = [], []
        for k, (digest, changed) in enumerate(zip(digests, nodes["changed"].to_pylist(), strict=True)):
            proof, new = hashlib.sha256(), (changed or digest.decode()).encode()
            for level in parents:
                node, slot, k = level[k // FANOUT], k % FANOUT, k // FANOUT
                proof.update(b"".join(node.siblings(slot)))
                new = node.folded(slot, new)
            proof.update(rest.siblings)
            proofs.append(proof.hexdigest())
            folded.append(rest.folded(new).decode())
        verified = [f == root for f in folded]
        cols = {"doc_id": nodes["doc_id"].cast(kind), "leaf": nodes["digest"], "subroot": nodes["subroot"], "root": pa.array([root] * len(proofs), pa.string())}
        return pa.table(cols | {"proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array(verified, pa.bool_())})

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rank of every row among the rows of its language in this partition, which is sorted."""
    from pyspark import TaskContext

    part, last, rank = TaskContext.get().partitionId(), object(), 0
    for b in batches:
        ranks = []
        for lang in b["lang"].to_pylist():
            rank = rank + 1 if lang == last else 0
            last = lang
            ranks.append(rank)
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(ranks), pa.int32()), pa.array(ranks, pa.int64()), *b.columns], names=["part", "rank", *b.schema.names])


class Forest:
    """Trees over nodes (tree, pos, digest, n: the nodes of the tree): the nodes of every round, and one node a tree at last."""

    def __init__(self, nodes: DataFrame, most: int, levels: int) -> None:
        span = FANOUT**levels
        self.rounds: list[DataFrame] = []
        now = nodes
        while most > 1:
            height = F.least(_height(F.col("n")), F.lit(levels))
            now = now.withColumns({"height": height, "group": F.floor(F.col("pos") / span)})
            self.rounds.append(now)
            sizes = now.select("tree", F.ceil(F.col("n") / span).alias("n")).distinct()
            up = now.groupBy("tree", "group").applyInArrow(_roots, "tree long, pos long, digest string")
            now = written(up.join(sizes, "tree"), "merkle-nodes")
            most = -(-most // span)
        self.tops = now  # tree, pos, digest

    def _with_above(self, k: int, above: DataFrame | None, each, schema: str, tree_path: DataFrame) -> DataFrame:
        nodes = self.rounds[k]
        over = (above if above is not None else tree_path).select(F.col("tree").alias("t"), F.col("pos").alias("g"), "path")
        return nodes.groupBy("tree", "group").cogroup(over.groupBy("t", "g")).applyInArrow(each, schema)

    def paths(self, tree_path: DataFrame, below: int) -> DataFrame:
        """The paths above the nodes of round `below`, from those above the trees (tree, pos: 0, path)."""
        above = None
        for k in range(len(self.rounds) - 1, below - 1, -1):
            above = written(self._with_above(k, above, _paths, f"tree long, pos long, path {_PATH}", tree_path), "merkle-paths")
        return above if above is not None else tree_path

    def finish(self, tree_path: DataFrame, root: str, doc_id) -> DataFrame:
        """Proofs and re-folded roots of the first round's nodes."""
        from pyspark.sql.pandas.types import to_arrow_type

        above = self.paths(tree_path, 1) if len(self.rounds) > 1 else None
        schema = f"doc_id {doc_id.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return self._with_above(0, above, _proofs(root, to_arrow_type(doc_id)), schema, tree_path)


def manifest(docs: DataFrame, tampered: Column | None = None, changed: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    Leaves are rows of doc_id, source, lang, n_chars, text; where `tampered` holds, the fields in
    `changed` replace the row's own before it is folded again (the query: A-Z of the text in lower case).
    Null fields are told from empty ones; a null lang is a language, the first; a null doc_id comes first
    in its language and is not tampered with; rows with one doc_id are ordered by their leaves, so that
    repeated rows get neighbouring places, in any order; texts of any length are hashed whole; an empty
    table gives no rows; other columns are not read.
    """
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    doc_id = docs.schema["doc_id"].dataType
    if tampered is None:
        tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
        changed = {"text": F.translate("text", _UPPER, _LOWER)}
    slim = docs.select("doc_id", "lang", leaf(fields).alias("digest"), F.when(tampered, leaf(fields | (changed or {}))).alias("changed"))
    slim = slim.withColumn("nth", F.monotonically_increasing_id())  # repeated rows may stand in several partitions
    slim = written(slim, "merkle-digests")  # finding the ranges reads the rows once more
    ranged = slim.repartitionByRange("lang", "doc_id", "digest", "nth").sortWithinPartitions("lang", "doc_id", "digest", "nth").drop("nth")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema)
    placed = written(ranged.mapInArrow(_places, f"part int, rank long, {kinds}"), "merkle-leaves")

    # where each language's rows of a partition begin, and the languages in order
    parts = placed.groupBy("part", "lang").agg(F.count("*").alias("rows"))
    parts = parts.withColumn("before", F.coalesce(F.sum("rows").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = written(parts, "merkle-parts")
    langs = parts.groupBy("lang").agg(F.sum("rows").alias("n")).withColumn("tree", F.row_number().over(Window.orderBy("lang")).cast("long") - 1)  # one row a language
    langs = written(langs, "merkle-langs")
    most = langs.agg(F.max("n"), F.count("*")).first()
    offsets = parts.join(langs.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l"))).select(F.col("part").alias("_p"), F.col("lang").alias("_l"), "before", "tree", "n")
    leaves = placed.join(checked(written(offsets, "merkle-offsets")), (F.col("part") == F.col("_p")) & F.col("lang").eqNullSafe(F.col("_l")))
    leaves = leaves.select("tree", (F.col("rank") + F.col("before")).alias("pos"), "n", "doc_id", "digest", "changed")

    own = Forest(leaves, max(2, most[0] or 0), levels)
    top = Forest(own.tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(most[1]).cast("long").alias("n")), max(2, most[1]), levels)
    root = top.tops.first()
    over = written(docs.sparkSession.createDataFrame([(0, 0, [])], f"tree long, pos long, path {_PATH}"), "merkle-top")
    tree_path = top.paths(over, 0).select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path")
    subroots = own.tops.select(F.col("tree").alias("_t"), F.col("digest").alias("subroot"))
    own.rounds[0] = own.rounds[0].join(checked(subroots), F.col("tree") == F.col("_t"), "left").drop("_t")
    return own.finish(written(tree_path, "merkle-trees"), root["digest"] if root else "", doc_id)
