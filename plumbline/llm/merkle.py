"""A Merkle manifest of a table: a root per source, one over all sources, and a proof per row.

Rows are ranked within their source. Written to base three, a rank's digits are
columns; grouping the lowest digit away gives the level above, and so on, with
the children nested in their parent's struct. Six digits make a block, so a
struct never holds more than 729 nodes; the blocks' own nodes are rolled up in
the same way until a source has one. Proofs come out of the nested structs by
transform and explode. Only a block as a whole, one row in 729, is joined with
the path that leads from it to the root.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.llm.tables import stash

FAN = 3
DIGITS = 6
BLOCK = FAN**DIGITS
ROWS_PER_SLICE = 200_000
HASH_BITS = 256
NO_PATH = "CAST(array() AS array<struct<left: string, right: string>>)"


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` for NULL, else its length in bytes, a colon, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), HASH_BITS)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings, from the lowest level up, lead to."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), HASH_BITS))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), HASH_BITS)


def _ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``rank`` (from 0) and ``total`` within each ``group``; a group of any size spreads over slices."""
    keys = [F.asc("group"), *[F.asc_nulls_first(c) for c in order]]
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_SLICE))
    cut = rows.repartitionByRange(n, *keys).withColumn("slice", F.spark_partition_id())
    # range bounds are sampled anew per run, so the slice numbers are written down
    cut = stash(cut, "ranked")
    counts = cut.groupBy("group", "slice").agg(F.count(F.lit(1)).alias("n"))
    of_group = Window.partitionBy("group")
    ahead = of_group.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "group", "slice", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"), F.sum("n").over(of_group).alias("total")
    )
    inside = F.row_number().over(Window.partitionBy("group", "slice").orderBy(*keys)) - 1
    placed = cut.withColumn("inside", inside).join(starts, ["group", "slice"])
    return placed.withColumn("rank", F.col("start") + F.col("inside")).drop("slice", "inside", "start")


def _width(level: int) -> Column:
    """Nodes that a group has at a level."""
    return F.ceil(F.col("total") / F.lit(FAN**level))


def _blocks(nodes: DataFrame) -> DataFrame:
    """Roll (group, rank, total, node, item) up to blocks (group, rank, total, node, size, kids).

    ``size`` keeps the group's number of nodes below, which tells how many levels
    there are; ``kids`` nests the whole block. All levels share one shuffle.
    """
    digit = lambda i: (F.floor(F.col("rank") / F.lit(FAN**i)) % FAN).cast("int")
    level = nodes.select(
        "group", F.floor(F.col("rank") / F.lit(BLOCK)).alias("block"), "total", "node", F.col("item").alias("kids"),
        *[digit(i).alias(f"d{i}") for i in range(DIGITS)],
    ).repartition("group", "block")
    for i in range(DIGITS):
        run = F.sort_array(F.collect_list(F.struct(F.col(f"d{i}").alias("d"), "node", "kids")))
        rest = [f"d{j}" for j in range(i + 1, DIGITS)]
        grouped = level.groupBy("group", "block", "total", *rest).agg(run.alias("kids"))
        joined = F.sha2(F.array_join(F.transform("kids", lambda k: k["node"]), ""), HASH_BITS)
        level = grouped.withColumn("node", F.when(_width(i) > 1, joined).otherwise(F.col("kids")[0]["node"]))
    return level.select(
        "group", F.col("block").alias("rank"), _width(DIGITS).cast("long").alias("total"), "node",
        F.col("total").alias("size"), "kids",
    )


def _paths(blocks: DataFrame, carried: Sequence[str]) -> DataFrame:
    """(group, item, node, path, carried columns) of every node of blocks that know their own ``path``."""

    def siblings(run: Column, child: Column) -> Column:
        beside = lambda keep: F.array_join(F.transform(F.filter(run, keep), lambda s: s["node"]), "")
        return F.struct(
            beside(lambda s: s["d"] < child["d"]).alias("left"), beside(lambda s: s["d"] > child["d"]).alias("right")
        )

    def opened(several: Column):
        def below(parent: Column) -> Column:
            def child(c: Column) -> Column:
                longer = F.concat(F.array(siblings(parent["kids"], c)), parent["path"])
                path = F.when(several, longer).otherwise(parent["path"])
                return F.struct(c["kids"].alias("kids"), path.alias("path"), c["node"].alias("node"))

            return F.transform(parent["kids"], child)

        return below

    level = blocks.withColumn("total", F.col("size"))
    open_ = F.array(F.struct("kids", "path", "node"))
    for i in reversed(range(DIGITS)):
        open_ = F.flatten(F.transform(open_, opened(_width(i) > 1)))
    found = level.select("group", F.explode(open_).alias("x"), *carried)
    return found.select("group", F.col("x.kids").alias("item"), F.col("x.node").alias("node"), F.col("x.path").alias("path"), *carried)


def _rolled(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of every round, up to one block per group."""
    rounds = [stash(_blocks(nodes), "blocks")]
    while not rounds[-1].where("total > 1").isEmpty():
        # a block's number within its group leads back to it
        above = rounds[-1].select("group", "rank", "total", "node", F.struct("rank").alias("item"))
        rounds.append(stash(_blocks(above), "blocks"))
    return rounds


def _unrolled(rounds: list[DataFrame], top: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Paths of all nodes below ``rounds``; ``top`` has (group, path, carried columns) of each group's root."""
    known = rounds[-1].join(top, "group")
    for blocks in reversed(rounds[:-1]):
        above = _paths(known, carried).select("group", F.col("item.rank").alias("rank"), "path", *carried)
        known = blocks.join(above, ["group", "rank"])
    return _paths(known, carried)


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    source_col: str = "source",
    more: Mapping[str, Column] | None = None,
) -> DataFrame:
    """(id, leaf, subroot, root, path, more...): one row per row of ``docs``.

    A leaf is the hash of the named columns in order, NULL or not. Leaves of a
    source ascend by id (NULL first, then by hash; rows equal in all columns take
    neighbouring places, which of them comes first makes no difference). Every
    three consecutive nodes, or what is left of them, become their hash while
    there are several; subroots, by source (NULL first, bytewise), do likewise.
    ``path`` has the siblings to the left and right at each level of several
    nodes, from the leaf up. ``more`` are further values of a row, such as a
    second leaf. Other columns are not read; an empty table gives no rows, and
    texts never leave the scan.
    """
    more = dict(more or {})
    leaves = docs.select(
        field(F.col(source_col)).alias("group"),
        leaf([F.col(c) for c in columns]).alias("node"),
        F.struct(
            F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
            *[value.alias(name) for name, value in more.items()],
        ).alias("item"),
    )
    # a number for each row lets even a third of equal rows be cut
    leaves = leaves.select("*", F.col("item.id").alias("id"), F.monotonically_increasing_id().alias("row"))
    # written before bounds are sampled, so texts are hashed once
    leaves = stash(leaves, "leaves")
    by_source = _rolled(_ranked(leaves, ["id", "node", "row"]).drop("id", "row"))

    first = by_source[-1].select(F.lit("").alias("group"), "node", F.col("group").alias("of"), _first_source().alias("source"))
    subroots = _ranked(first, ["source"]).withColumn("item", F.struct("of")).drop("of", "source")
    over_all = _rolled(subroots)
    start = over_all[-1].select("group", F.expr(NO_PATH).alias("path"), F.col("node").alias("root"))
    tops = _unrolled(over_all, start, ["root"])
    tops = tops.select(F.col("item.of").alias("group"), F.col("node").alias("subroot"), "path", "root")

    found = _unrolled(by_source, stash(tops, "subroots"), ["subroot", "root"])
    return found.select(
        F.col("item.id").alias("id"), F.col("node").alias("leaf"), "subroot", "root", "path",
        *[F.col("item").getField(name).alias(name) for name in more],
    )


def _first_source() -> Column:
    """The source itself, from its field: NULL for ``-``, else what follows the first colon."""
    return F.when(F.col("group") != "-", F.substring(F.col("group"), F.instr("group", ":") + 1, F.length("group")))


def tampered(id_col: str = "doc_id") -> Column:
    """Rows that the query tampers with: the id's CRC-32 is even; never without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 2 == 0, F.lit(False))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = ["doc_id", "source", "lang", "n_chars"]
    joined = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    changed = leaf([*[F.col(c) for c in columns], F.when(tampered(), joined).otherwise(F.col("text"))])
    found = manifest(docs, [*columns, "text"], more={"changed": changed})
    found = found.withColumn("folded_root", folded(F.col("changed"), F.col("path")))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


# CRC-32 of a text of ASCII characters, bit by bit.
CRC32_SQL = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || range(8),
    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

_FIELD = "CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
_HEAD = " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars"))
_RUN = "PARTITION BY level, source, pos // 3 ORDER BY pos ROWS BETWEEN"

OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, sha256({_HEAD} || {_FIELD.format(c='text')}) AS leaf,
    sha256({_HEAD} || CASE WHEN text IS NULL THEN '-'
      WHEN doc_id IS NOT NULL AND ({CRC32_SQL.format(text="coalesce(doc_id, 0)::VARCHAR")}) % 2 = 0
      THEN strlen(replace(text, chr(10), ''))::VARCHAR || ':' || replace(text, chr(10), '')
      ELSE strlen(text)::VARCHAR || ':' || text END) AS changed
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree AS (
  SELECT 0 AS level, source, pos, leaf AS node, n FROM placed
  UNION ALL
  SELECT level + 1, source, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM tree WHERE n > 1 GROUP BY level, source, pos // 3),
subroots AS (
  SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, node, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM top WHERE n > 1 GROUP BY level, pos // 3),
nodes AS (
  SELECT level, source, pos, node, n FROM tree WHERE n > 1
  UNION ALL SELECT 100 + level, NULL, pos, node, n FROM top WHERE n > 1),
beside AS (
  SELECT level, source, pos,
    coalesce(string_agg(node, '') OVER ({_RUN} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(node, '') OVER ({_RUN} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes),
depth AS (SELECT source, max(level) AS levels FROM tree GROUP BY source),
heights AS (SELECT max(level) AS levels FROM top),
steps AS (
  SELECT p.source, p.pos AS leaf_pos, b.level, b.l, b.r
  FROM placed p JOIN depth d ON d.source IS NOT DISTINCT FROM p.source
  JOIN beside b ON b.level < 100 AND b.source IS NOT DISTINCT FROM p.source AND b.pos = p.pos // (3 ** b.level)::BIGINT
  UNION ALL
  SELECT p.source, p.pos, b.level, b.l, b.r
  FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source
  JOIN beside b ON b.level >= 100 AND b.pos = s.pos // (3 ** (b.level - 100))::BIGINT),
paths AS (
  SELECT source, leaf_pos, list(l ORDER BY level) AS ls, list(r ORDER BY level) AS rs,
    string_agg(l || r, '' ORDER BY level) AS siblings FROM steps GROUP BY source, leaf_pos),
folds AS (
  SELECT p.source, p.pos, 0 AS i, p.changed AS node, q.ls, q.rs
  FROM placed p LEFT JOIN paths q ON q.source IS NOT DISTINCT FROM p.source AND q.leaf_pos = p.pos
  UNION ALL
  SELECT source, pos, i + 1, sha256(ls[i + 1] || node || rs[i + 1]), ls, rs FROM folds WHERE i < coalesce(len(ls), 0)),
ends AS (SELECT source, pos, node FROM folds WHERE i = coalesce(len(ls), 0))
SELECT p.doc_id, p.leaf, s.node AS subroot, t.node AS root, sha256(coalesce(q.siblings, '')) AS proof_sha256,
  e.node AS folded_root, e.node = t.node AS verified
FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source
CROSS JOIN (SELECT node FROM top WHERE n = 1) t
JOIN ends e ON e.source IS NOT DISTINCT FROM p.source AND e.pos = p.pos
LEFT JOIN paths q ON q.source IS NOT DISTINCT FROM p.source AND q.leaf_pos = p.pos
"""
