"""A Merkle manifest of documents, with a proof for each of them found by pointer jumping.

Every document is a leaf: the digest of its doc_id, source, lang, n_chars and text, each written as its length in bytes, a
colon and its value, or as `-` where it is null. The leaves of a lang ascend by doc_id; eight in a row make a node, the
digest of theirs, until one is left, the lang's subroot. The subroots, ordered by lang (null first), make the root likewise.

Proofs: a node knows its parent and what stands left and right of it among the parent's children. Joining these links with
themselves doubles the distance to the ancestor that each knows and strings the pieces together, until all reach the root;
a document's proof is its own piece and its parent's. So rounds grow with the logarithm of the height.

Null doc_ids come first in their lang; rows that repeat an id are leaves of their own, in the order of their digests. A lang
of one document has it as its subroot; a table of one lang has the subroot as its root; an empty table gives no rows. A
document without siblings on its whole way has the empty proof. Other columns are ignored, whatever their names.

Texts are read once and never shuffled; what moves is a digest for each document. Numbers within a lang come from counts of
ranges, so a lang of any size is spread over all tasks. Links are broadcast only once they are few (BROADCAST bytes at most).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm._common import Scratch, partitions

#: Children of a node.
WIDTH = 8
#: Bytes of links, by a bound of their rows' size, that are sent to all tasks.
BROADCAST = 8 << 20
#: The tree above the langs. Keys of langs are empty (null) or begin with "=", so that they differ from it and sort as langs do.
TOP = "top"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return digest(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text))


def _numbered(rows: DataFrame, group: str, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """rows with idx: their number within the group from 0, by order, and n: how many rows their group has."""
    rows = rows.repartitionByRange(partitions(rows.sparkSession), F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    rows = scratch.table(rows.withColumn("m", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("m", 33))
    runs = rows.groupBy("part", group).agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("here"))
    of_group = Window.partitionBy(group)
    before = F.coalesce(F.sum("here").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    runs = scratch.table(runs.select("part", group, (before - F.col("first")).alias("shift"), F.sum("here").over(of_group).alias("n")), f"{name}-runs")
    rows = rows.join(_small(runs, 64, F.octet_length(group)), ["part", group])
    return rows.withColumn("idx", F.col("m") + F.col("shift")).drop("m", "part", "shift")


def _small(df: DataFrame, fixed: int, more: Column | None = None) -> DataFrame:
    """df, to be broadcast if its rows of `fixed` bytes, and `more`, are few."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.lit(0) if more is None else more)).first()
    return F.broadcast(df) if n * fixed + (size or 0) <= BROADCAST else df


def _joined(kids: str | Column, at: str = "digest") -> Column:
    return F.array_join(F.transform(kids, lambda k: k[at]), "")


def _piece(kids: str, at: Column, of: str = "digest") -> Column:
    """What stands left and right of the child at place `at` (from 1)."""
    return F.struct(_joined(F.slice(kids, F.lit(1), at - 1), of).alias("left"), _joined(F.slice(kids, at + 1, F.lit(WIDTH)), of).alias("right"))


def _tree(nodes: DataFrame, most: int, level: int, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame | None]:
    """The top nodes (key, level, digest) of every key's tree over nodes (key, idx, n, digest) at `level`, and the links below
    them: key, level, idx, up_level, up_idx, and pieces. most: the largest n."""
    tops, links = [], None
    while most > 1:
        tops.append(nodes.where("n = 1").select("key", F.lit(level).alias("level"), "digest"))
        up = nodes.where("n > 1").groupBy("key", F.expr(f"idx div {WIDTH}").alias("idx")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("kids"), F.first("n").alias("n"))
        up = scratch.table(up.select("key", "idx", F.expr(f"(n + {WIDTH - 1}) div {WIDTH}").alias("n"), "kids", digest(_joined("kids")).alias("digest")), f"{name}-{level}")
        kids = up.select("key", F.col("idx").alias("up_idx"), "kids", F.posexplode("kids").alias("at", "kid"))
        kids = kids.select("key", F.lit(level).alias("level"), F.col("kid.idx").alias("idx"), F.lit(level + 1).alias("up_level"), "up_idx", F.array(_piece("kids", F.col("at") + 1)).alias("pieces"))
        links = kids if links is None else links.unionByName(kids)
        nodes, most, level = up.select("key", "idx", "n", "digest"), -(-most // WIDTH), level + 1
    tops.append(nodes.where("n = 1").select("key", F.lit(level).alias("level"), "digest"))
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out, links


def _jumped(links: DataFrame, height: int, scratch: Scratch) -> DataFrame:
    """links after as many rounds as it takes until `up` is the root everywhere."""
    links, known = scratch.table(links, "links-1"), 1
    while known < height:
        above = links.select(*[F.col(c).alias(f"up_{c}") for c in ("key", "level", "idx")], *[F.col(c).alias(f"{c}_2") for c in ("up_key", "up_level", "up_idx", "pieces", "subroot")])
        # A node below the first `known` levels is nobody's ancestor any more; the root has no link.
        above = above.where((F.col("up_level") > known) | (F.col("up_key") == TOP))
        above = _small(above, 200 + known * (64 * (WIDTH - 1) + 32), F.octet_length("up_key") + F.octet_length("up_key_2"))
        links = links.join(above, ["up_key", "up_level", "up_idx"], "left").select(
            "key", "level", "idx", *[F.coalesce(f"{c}_2", c).alias(c) for c in ("up_key", "up_level", "up_idx")],
            F.when(F.col("pieces_2").isNull(), F.col("pieces")).otherwise(F.concat("pieces", "pieces_2")).alias("pieces"), F.coalesce("subroot", "subroot_2").alias("subroot"),
        )
        known *= 2
        links = scratch.table(links, f"links-{known}")
    return links


def manifest(docs: DataFrame, now: Callable[[Column], Column] | None = None, check: Column | None = None, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (an array of left and right, from the leaf on), and folded_root: the root that the proof
    gives for the leaf of what the document holds now, which is now(text) where `check` is true, else its text."""
    scratch = scratch or Scratch(docs.sparkSession)
    now, check = now or (lambda text: text), F.lit(False) if check is None else check
    leaves = docs.select(
        F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang").cast("string"))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(F.col("text")).alias("digest"),
        F.when(check, leaf_of(now(F.col("text")))).alias("found"), F.monotonically_increasing_id().alias("read"),
    )
    leaves = scratch.table(leaves, "leaves")  # ranges are sampled from here, not from the texts
    leaves = _numbered(leaves, "key", [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("read")], scratch, "numbered")
    runs = leaves.groupBy("key", F.expr(f"idx div {WIDTH}").alias("idx")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest", "doc_id", "found"))).alias("kids"), F.first("n").alias("n"))
    bare = F.col("n") == 1  # the leaf is the subroot itself
    runs = scratch.table(runs.select("key", "idx", "kids", bare.alias("bare"), F.expr(f"(n + {WIDTH - 1}) div {WIDTH}").alias("n"), F.when(bare, F.col("kids")[0]["digest"]).otherwise(digest(_joined("kids"))).alias("digest")), "runs")
    most = runs.agg(F.max("n")).first()[0]
    if most is None:
        return runs.selectExpr("0L AS doc_id", "digest AS leaf", "digest AS subroot", "digest AS root", "array(struct('' AS left, '' AS right)) AS proof", "digest AS folded_root")
    subroots, links = _tree(runs.select("key", "idx", "n", "digest"), most, 1, scratch, "lang")
    height = _height(most)
    subroots = scratch.table(subroots.withColumn("all", F.lit(TOP)), "subroots")
    top = _numbered(subroots, "all", [F.col("key")], scratch, "langs")
    top = scratch.table(top.select("all", "idx", "n", "key", "level", "digest"), "langs-numbered")
    langs = top.count()
    nodes = top.select(F.col("all").alias("key"), "idx", "n", "digest")
    root_row, above = _tree(nodes, langs, 0, scratch, "top")
    root = root_row.first()["digest"]
    none = F.lit(None).cast("string")
    parts = [] if links is None else [links.select("key", "level", "idx", F.col("key").alias("up_key"), "up_level", "up_idx", "pieces", none.alias("subroot"))]
    if above is not None:
        # A subroot stands in the top tree as node 0 of its place; its link there begins at its own tree's top.
        first = above.where("level = 0").join(top.select("idx", F.col("key").alias("lang"), F.col("level").alias("at"), "digest"), "idx")
        parts.append(first.select(F.col("lang").alias("key"), F.col("at").alias("level"), F.lit(0).cast("long").alias("idx"), F.col("key").alias("up_key"), "up_level", "up_idx", "pieces", F.col("digest").alias("subroot")))
        parts.append(above.where("level > 0").select("key", "level", "idx", F.col("key").alias("up_key"), "up_level", "up_idx", "pieces", none.alias("subroot")))
    if parts:
        all_links = parts[0]
        for p in parts[1:]:
            all_links = all_links.unionByName(p)
        reached = _jumped(all_links, height + _height(langs), scratch).where(f"level = 1 AND key <> '{TOP}'").select("key", "idx", "pieces", "subroot")
        runs = runs.join(reached, ["key", "idx"], "left")
    else:
        runs = runs.withColumns({"pieces": F.array().cast("array<struct<left:string,right:string>>"), "subroot": none})
    pieces = F.coalesce("pieces", F.array().cast("array<struct<left:string,right:string>>"))
    out = runs.select("kids", "bare", pieces.alias("pieces"), F.coalesce("subroot", F.lit(root)).alias("subroot"), F.posexplode("kids").alias("at", "kid"))
    own = F.when(F.col("bare"), F.array().cast("array<struct<left:string,right:string>>")).otherwise(F.array(_piece("kids", F.col("at") + 1)))
    out = out.select("kid.doc_id", F.col("kid.digest").alias("leaf"), F.coalesce("kid.found", "kid.digest").alias("found"), "subroot", F.lit(root).alias("root"), F.concat(own, "pieces").alias("proof"))
    folded = F.aggregate("proof", F.col("found"), lambda at, p: digest(p["left"], at, p["right"]))
    return out.select("doc_id", "leaf", "subroot", "root", "proof", folded.alias("folded_root"))


def _height(n: int) -> int:
    out = 0
    while n > 1:
        n, out = -(-n // WIDTH), out + 1
    return out


def proof_digest() -> Column:
    """The digest of a proof's siblings, strung together."""
    return digest(F.array_join(F.transform("proof", lambda p: F.concat(p["left"], p["right"])), ""))
