"""Merkle manifest of a dataset: one hash tree per language, kept as a log of nodes in the order in which they complete.

Leaves are appended in order; a node is written as soon as the last leaf below it is, so children stand before their parent
(postorder). The place of any node follows from numbers alone: before leaf j stand j leaves and floor(j / 2) + floor(j / 4) +
... inner nodes, and a node stands `level` places behind the last leaf below it. A left child's sibling therefore stands the
size of the sibling's subtree further on, a right child's the size of its own subtree further back.

Builders work on aligned runs of 2^HEIGHT leaves, whose nodes are one gapless segment of the log; the runs' roots are the
leaves of the next tier, until one node is left. A proof is read from the run's segment and, above it, from the log of the
tiers, once for a run.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from plectra.llm.common import discard, small_batches, stored

#: Levels that one builder makes: runs of 1024 leaves, some 130 KB of nodes.
HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def before(leaf: int) -> int:
    """Nodes that are complete before leaf number `leaf` is written."""
    return 2 * leaf - leaf.bit_count()


def position(level: int, index: int, leaves: int) -> int:
    """Place in the log of a node of a tree with so many leaves."""
    return before(min((index + 1) << level, leaves) - 1) + level


def size(level: int, index: int, leaves: int) -> int:
    """Nodes of the subtree below a node, itself included."""
    return position(level, index, leaves) - before(index << level) + 1


def sibling(level: int, index: int, leaves: int) -> int | None:
    """Place in the log of the other child of the node's parent; None for one without."""
    own = position(level, index, leaves)
    if index & 1:
        return own - size(level, index, leaves)
    return own + size(level, index + 1, leaves) if (index + 1) << level < leaves else None


def parent(left: str, right: str = "") -> str:
    return sha256((left + right).encode()).hexdigest()


def build(leaves: list[str], levels: int) -> list[str]:
    """The nodes of one run in the order in which they complete; `levels` above the leaves, also where one node is left sooner."""
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in range(levels + 1)]  # nodes of each level that wait for their parent
    last = len(leaves) - 1
    for k, node in enumerate(leaves):
        for level in range(levels + 1):
            log.append(node)
            open_[level].append(node)
            if level == levels or (len(open_[level]) < 2 and k < last):
                break
            node = parent(*open_[level])
            open_[level].clear()
    return log


def fold(node: str, index: int, siblings: list[str | None]) -> str:
    """The root from a leaf, its place, and a sibling (or none) for each level."""
    for level, other in enumerate(siblings):
        node = parent(node) if other is None else parent(other, node) if index >> level & 1 else parent(node, other)
    return node


def leaf(*fields: F.Column) -> F.Column:
    """Hash of fields, each `-` if null, else its number of bytes, a colon and itself."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _tree() -> F.Column:
    """Name of a language's tree: the empty one for null, which sorts first."""
    return F.coalesce(F.concat(F.lit("."), F.col("lang").cast("string")), F.lit(""))


def manifest_leaves(docs: DataFrame) -> DataFrame:
    """docs -> (doc_id, tree, leaf, changed): the leaf of each row, and of the tampered row where it is tampered with; no shuffle."""
    fields = {c: F.col(c) for c in FIELDS}
    more = F.col("n_chars").cast("decimal(38,0)") + 1  # the largest long has a successor, too
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    changed = F.when(hit, leaf(*(fields | {"n_chars": more}).values()))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tree().alias("tree"), leaf(*fields.values()).alias("leaf"), changed.alias("changed"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds `index` (from 0, in `order` within a tree) and `n`, the leaves of the tree.

    Ranges of the order are sorted on their own, so a tree with most of the rows is spread over tasks; rows that are equal
    in `order` are told apart by a stored number. The offsets of ranges are a row per range and tree.
    """
    named = stored(rows.withColumn("row__", F.monotonically_increasing_id()))
    keys = ["tree", *order, "row__"]
    dealt = named.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = stored(dealt.withColumns({"part__": F.spark_partition_id(), "at__": F.monotonically_increasing_id()}))
    counts = ranged.groupBy("tree", "part__").agg(F.count("*").alias("c"), F.min("at__").alias("first__"))
    by_part = Window.partitionBy("tree").orderBy("part__")
    offsets = counts.select(
        "tree", "part__", "first__",
        F.coalesce(F.sum("c").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset__"),
        F.sum("c").over(Window.partitionBy("tree")).alias("n"),
    )
    out = ranged.join(offsets, ["tree", "part__"]).withColumn("index", F.col("offset__") + F.col("at__") - F.col("first__"))
    out = stored(out.drop("row__", "part__", "at__", "offset__", "first__"))
    discard(named, ranged)
    return out


def _levels(n: int, height: int) -> int:
    """Levels that a builder makes in a tree with n nodes: all to its top, or `height` of them."""
    return min(height, (n - 1).bit_length())


def _upper(runs: DataFrame, height: int) -> DataFrame:
    """The runs' roots as the leaves of the tier above."""
    return runs.select("tree", F.col("run").alias("index"), F.expr(f"(n + {(1 << height) - 1}) >> {height}").alias("n"), F.col("root").alias("hash"))


def segments(leaves: DataFrame, height: int) -> DataFrame:
    """(tree, index, n, hash, ...) -> a row per aligned run: (tree, run, n, items, nodes, root).

    items: the run's rows as given, in order; nodes: its segment of the log.
    """
    rest = [c for c in leaves.columns if c not in ("tree", "n")]
    runs = leaves.groupBy("tree", F.shiftright("index", height).alias("run")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("index", *(c for c in rest if c != "index")))).alias("items")
    )
    names = runs.columns
    at = names.index("items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(at).flatten().field("hash").to_pylist()
            starts = [0, *batch.column(at).value_lengths().to_pylist()]
            nodes, place = [], 0
            for n, k in zip(batch.column(2).to_pylist(), starts[1:], strict=True):
                nodes.append(build(hashes[place : place + k], _levels(n, height)))
                place += k
            made = [pa.array(nodes, pa.list_(pa.string())), pa.array([x[-1] for x in nodes], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, "nodes", "root"])

    schema = StructType([*runs.schema.fields, StructField("nodes", ArrayType(StringType())), StructField("root", StringType())])
    return runs.mapInArrow(run, schema)


def path(nodes: list[str], index: int, n: int, height: int) -> list[str | None]:
    """Siblings from a leaf to the root of its run, read from the run's segment by their places in the log."""
    start = before(index >> height << height)
    places = (sibling(level, index >> level, n) for level in range(_levels(n, height)))
    return [None if p is None else nodes[p - start] for p in places]


def _inner(height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each node of a run, the siblings on its way up to the run's root: (tree, index, siblings)."""
        for batch in batches:
            for i in range(batch.num_rows):
                tree, first, n, count, nodes = (c[0].as_py() for c in batch.slice(i, 1).columns)
                indices = range(first << height, (first << height) + count)
                found = [path(nodes, index, n, height) for index in indices]
                yield pa.RecordBatch.from_arrays([pa.array([tree] * count, pa.string()), pa.array(indices, pa.int64()), pa.array(found, pa.list_(pa.string()))], names=["tree", "index", "siblings"])

    return run


def above(roots: DataFrame, height: int) -> DataFrame:
    """(tree, index, n, hash) of nodes that are the leaves of trees -> (tree, index, siblings, top): the way up to each tree's top.

    Tier by tier, each over a 2^height-th of the nodes below; a tier's ways are joined to the next one's by run.
    """
    tiers, nodes = [], roots
    while True:
        runs = stored(segments(nodes.select("tree", "index", "n", "hash"), height))
        tiers.append(runs)
        if runs.where(f"n > {1 << height}").isEmpty():
            break
        nodes = _upper(runs, height)
    way = None
    for runs in reversed(tiers):
        own = runs.select("tree", "run", "n", F.size("items").alias("count"), "nodes").mapInArrow(_inner(height), "tree string, index long, siblings array<string>")
        if way is None:
            way = own.join(runs.where("run = 0").select("tree", F.col("root").alias("top")), "tree")
        else:
            up = way.select("tree", F.col("index").alias("run__"), F.col("siblings").alias("up__"), "top")
            way = own.withColumn("run__", F.shiftright("index", height)).join(up, ["tree", "run__"]).select("tree", "index", F.concat("siblings", "up__").alias("siblings"), "top")
    return way


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """docs(doc_id, source, lang, n_chars, text, ...) -> a row per row: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).

    Null fields count as `-`; a null lang has a tree of its own, which comes first; rows without a doc_id come first in their
    tree and are not tampered with. Rows that repeat a doc_id are leaves each, ordered by their hash; equal rows are leaves each.
    Empty and very long texts are hashed as they are, and texts are never shuffled. Other columns are left out; an empty
    table gives none.
    """
    small_batches(docs.sparkSession)
    leaves = numbered(manifest_leaves(docs).withColumnRenamed("leaf", "hash"), "doc_id", "hash")
    runs = stored(segments(leaves, height))
    discard(leaves)
    ways = stored(above(_upper(runs, height), height))
    # Over the languages' trees stands one more, whose leaves are their tops.
    tops = ways.where("index = 0").select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("top").alias("hash"))
    langs = numbered(tops, "lang")
    last = above(langs.drop("lang"), height).join(langs.select("index", F.col("lang").alias("tree__")), "index")
    last = last.select(F.col("tree__").alias("tree"), F.col("index").alias("lang_at"), F.col("siblings").alias("lang_siblings"), F.col("top").alias("root"))
    up = ways.select("tree", F.col("index").alias("run"), F.col("siblings").alias("up"), F.col("top").alias("subroot")).join(last, "tree")
    whole = runs.select("tree", "run", "n", "items", "nodes").join(up, ["tree", "run"])
    return whole.drop("tree").mapInArrow(_verified(height), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _verified(height: int):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of whole runs with their proofs, folded from the tampered leaf where there is one."""
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                items, upper, langs = row["items"], row["up"], row["lang_siblings"]
                proofs, folded = [], []
                for item in items:
                    inner = path(row["nodes"], item["index"], row["n"], height)
                    proofs.append(sha256("".join(filter(None, (*inner, *upper, *langs))).encode()).hexdigest())
                    node = fold(item["changed"] or item["hash"], item["index"], inner)
                    folded.append(fold(fold(node, row["run"], upper), row["lang_at"], langs))
                k = len(items)
                columns = [
                    pa.array([x["doc_id"] for x in items], pa.int64()), pa.array([x["hash"] for x in items], pa.string()),
                    pa.array([row["subroot"]] * k, pa.string()), pa.array([row["root"]] * k, pa.string()),
                    pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array([x == row["root"] for x in folded], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Levels by a recursive query: every two neighbours become their hash, an odd last one its own.
ORACLE = """
WITH RECURSIVE fields AS (SELECT doc_id, lang, n_chars,
  coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
  coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail FROM documents),
bytes AS (SELECT d.doc_id, i, ascii(substr(CAST(d.doc_id AS VARCHAR), i, 1)) AS b FROM documents d, range(1, length(CAST(d.doc_id AS VARCHAR)) + 1) AS g(i)),
crc AS (SELECT doc_id, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS k, xor(CAST(4294967295 AS BIGINT), CAST(b AS BIGINT)) AS c FROM bytes WHERE i = 1
  UNION ALL SELECT crc.doc_id, CASE WHEN k = 7 THEN crc.i + 1 ELSE crc.i END, (k + 1) % 8,
    xor(CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END, CASE WHEN k = 7 THEN coalesce(CAST(b AS BIGINT), 0) ELSE 0 END)
  FROM crc LEFT JOIN bytes ON bytes.doc_id = crc.doc_id AND bytes.i = crc.i + 1 WHERE crc.i <= length(CAST(crc.doc_id AS VARCHAR))),
sums AS (SELECT doc_id, xor(c, CAST(4294967295 AS BIGINT)) AS crc32 FROM crc WHERE i = length(CAST(doc_id AS VARCHAR)) + 1 AND k = 0),
leaves AS (SELECT f.doc_id, f.lang, sha256(head || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') || tail) AS leaf,
  sha256(head || coalesce(octet_length(encode(CAST(n_chars + CASE WHEN crc32 % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR))) || ':' || (n_chars + CASE WHEN crc32 % 7 = 0 THEN 1 ELSE 0 END), '-') || tail) AS changed,
  row_number() OVER (PARTITION BY f.lang ORDER BY f.doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY f.lang) AS n FROM fields f LEFT JOIN sums s ON s.doc_id = f.doc_id),
nodes AS (SELECT lang, CAST(0 AS BIGINT) AS level, i, n, leaf AS h FROM leaves
  UNION ALL SELECT a.lang, a.level + 1, a.i // 2, (a.n + 1) // 2, sha256(a.h || coalesce(b.h, '')) FROM nodes a LEFT JOIN nodes b ON b.lang IS NOT DISTINCT FROM a.lang AND b.i = a.i + 1 WHERE a.i % 2 = 0 AND a.n > 1),
tops AS (SELECT lang, level AS height, h, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (SELECT CAST(0 AS BIGINT) AS level, i, n, h FROM tops
  UNION ALL SELECT a.level + 1, a.i // 2, (a.n + 1) // 2, sha256(a.h || coalesce(b.h, '')) FROM upper a LEFT JOIN upper b ON b.i = a.i + 1 WHERE a.i % 2 = 0 AND a.n > 1),
fold AS (SELECT l.lang, l.i AS leaf_i, l.i, CAST(0 AS BIGINT) AS level, changed AS h, CAST('' AS VARCHAR) AS proof FROM leaves l
  UNION ALL SELECT f.lang, f.leaf_i, f.i // 2, f.level + 1, sha256(CASE WHEN f.i % 2 = 1 THEN o.h || f.h ELSE f.h || coalesce(o.h, '') END), f.proof || coalesce(o.h, '')
  FROM fold f JOIN tops t ON t.lang IS NOT DISTINCT FROM f.lang AND f.level < t.height LEFT JOIN nodes o ON o.lang IS NOT DISTINCT FROM f.lang AND o.level = f.level AND o.i = xor(f.i, 1)),
fold2 AS (SELECT f.lang, leaf_i, t.i, CAST(0 AS BIGINT) AS level, f.h, proof FROM fold f JOIN tops t ON t.lang IS NOT DISTINCT FROM f.lang AND f.level = t.height
  UNION ALL SELECT f.lang, leaf_i, f.i // 2, f.level + 1, sha256(CASE WHEN f.i % 2 = 1 THEN o.h || f.h ELSE f.h || coalesce(o.h, '') END), f.proof || coalesce(o.h, '')
  FROM fold2 f LEFT JOIN upper o ON o.level = f.level AND o.i = xor(f.i, 1) WHERE f.level < (SELECT max(level) FROM upper))
SELECT l.doc_id, l.leaf, t.h AS subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = (SELECT h FROM upper WHERE n = 1) AS verified
FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang JOIN fold2 f ON f.lang IS NOT DISTINCT FROM l.lang AND f.leaf_i = l.i AND f.level = (SELECT max(level) FROM upper)
"""
