"""Merkle manifest of a dataset: a leaf per row, a subtree per source, one root, a proof per row.

Method: an aligned block of 256 nodes keeps a level of its tree as one hex string of 64 characters
a node. Substrings of 16 digests give the 16 parents, which are the block's next string, and that
string's hash is what the block sends up. The blocks of a level are the nodes of the next round, so a
source of any size is cut into blocks that never meet, and the rounds are as many as the size has
digits in base 256. On the way down every block hands each of its nodes the digests to its left and
right (substrings again) before what it got from above. A row's proof is the concatenation of those
segments, and its path is folded again from its leaf. SQL functions only.

Results for odd input: null values are `-` in a leaf; a null source is a source of its own, the first;
null ids come first within a source. Ties of an id are ordered by leaf; repeated rows are leaves of
their own with equal values. Empty texts are values of no bytes; texts of any length are hashed whole.
A lone leaf is its own subroot, and a lone subroot is the root; both leave the proof without siblings.
Extra columns, whatever their names, are neither hashed nor returned. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylight.llm.common import LOWER, UPPER, crc32_sql, lower_az
from querylight.llm.registry import query, table
from querylight.operators.numbering import number_rows
from querylight.session import stage

FAN, DIGEST = 16, 64
RUN = FAN * DIGEST
BLOCK = FAN * FAN
TAMPERED_SHARE = 5


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def ceil_div(number: Column, by: int) -> Column:
    return F.floor((number + (by - 1)) / by).cast("bigint")


def blocks(nodes: DataFrame) -> DataFrame:
    """`nodes` (grp, pos, total, node, own) to aligned blocks (grp, block, total, items, level0, level1, up).

    `own` goes along with its node. `up` is the block's digest for the next round, or the root of a group
    that fits the block.
    """
    grouped = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).cast("bigint").alias("block"), "total").agg(
        F.array_sort(F.collect_list(F.struct("pos", "node", "own"))).alias("items")
    )
    whole = grouped.withColumn("level0", F.array_join(F.transform("items", lambda x: x["node"]), ""))
    runs = F.sequence(F.lit(0), F.floor((F.size("items") - 1) / FAN).cast("int"))
    parents = F.transform(runs, lambda i: digest(F.substr("level0", i * RUN + 1, F.lit(RUN))))
    up = F.when(F.col("total") == 1, F.col("level0")).when(F.col("total") <= FAN, digest(F.col("level0")))
    return whole.withColumn("level1", F.array_join(parents, "")).withColumn("up", up.otherwise(digest(F.col("level1"))))


def flanks(text: Column, at: Column) -> Column:
    """What stands left and right of the digest at place `at` of a string of digests."""
    return F.struct(
        F.substr(text, F.lit(1), at * DIGEST).alias("left"),
        F.substr(text, at * DIGEST + DIGEST + 1, F.lit(RUN)).alias("right"),
    )


def node_paths(parts: DataFrame) -> DataFrame:
    """Blocks with their `path` from above to one row per node: grp, pos, node, own, path, and what else is there."""
    inner = ["block", "items", "level0", "level1", "up", "path", "total"]
    rest = [c for c in parts.columns if c not in inner]
    i = F.col("i")
    run = F.substr("level0", i * RUN + 1, F.lit(RUN))
    second = F.when(F.col("total") > FAN, F.array(flanks(F.col("level1"), i))).otherwise(F.array())
    by_run = parts.select(
        *rest, "items", "level0", "level1", "total", "path", F.explode(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / FAN).cast("int"))).alias("i")
    ).select(
        *rest, "total", run.alias("run"), F.concat(second, "path").alias("path"), F.slice("items", i * FAN + 1, FAN).alias("items")
    )
    each = by_run.select(*rest, "total", "run", "path", F.posexplode("items").alias("at", "item"))
    first = F.when(F.col("total") > 1, F.array(flanks(F.col("run"), F.col("at")))).otherwise(F.array())
    return each.select(*rest, "item.pos", "item.node", "item.own", F.concat(first, "path").alias("path"))


NO_PATH = "array<struct<left:string,right:string>>"


class Forest:
    """The trees of all groups of `nodes` (grp, pos, total, node, own), staged round by round."""

    def __init__(self, nodes: DataFrame):
        self.rounds: list[DataFrame] = []
        most = nodes.agg(F.max("total")).first()[0] or 0
        while True:
            built = stage(blocks(nodes), "merkle")
            self.rounds.append(built)
            if most <= BLOCK:
                break
            nodes = built.filter(F.col("total") > BLOCK).select(
                "grp", F.col("block").alias("pos"), ceil_div(F.col("total"), BLOCK).alias("total"), F.col("up").alias("node"), F.lit(None).cast("string").alias("own")
            )
            most = -(-most // BLOCK)

    def roots(self) -> DataFrame:
        """(grp, node) of every group."""
        tops = [r.filter(F.col("total") <= BLOCK).select("grp", F.col("up").alias("node")) for r in self.rounds]
        out = tops[0]
        for more in tops[1:]:
            out = out.unionByName(more)
        return out

    def paths(self, groups: DataFrame) -> DataFrame:
        """One row per node of the first round; `groups` (grp, path, …) has what every node of a group gets from above."""
        above = None
        given = [c for c in groups.columns if c not in ("grp", "path")]
        for built in reversed(self.rounds):
            whole = built.filter(F.col("total") <= BLOCK).join(groups, "grp")
            if above is not None:
                whole = whole.unionByName(built.filter(F.col("total") > BLOCK).join(above, ["grp", "block"]))
            nodes = node_paths(whole)
            above = nodes.select("grp", F.col("pos").alias("block"), *given, "path")
        return nodes


def fold(start: Column, path: Column) -> Column:
    return F.aggregate(path, start, lambda acc, seg: digest(F.concat(seg["left"], acc, seg["right"])))


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "source",
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    changed: dict[str, Column] | None = None,
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of `docs`.

    `changed` replaces fields before the path is folded again, as a reader would who got altered rows.
    """
    changed = changed or {}
    group = F.col(group_col).cast("string")
    true = leaf([F.col(f) for f in fields])
    seen = leaf([changed.get(f, F.col(f)) for f in fields])
    # The mark in front keeps the null group apart and first.
    marked = F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group))
    hashed = docs.select(marked.alias("grp"), F.col(id_col).alias("id"), true.alias("node"), seen.alias("seen"))
    leaves = stage(hashed.withColumn("seen", F.when(F.col("seen") != F.col("node"), F.col("seen"))), "leaves")
    numbered = number_rows(leaves, ["grp"], ["id", "node"], out="pos", total="total")
    sources = Forest(numbered.withColumn("own", F.struct("id", "seen")))
    subroots = number_rows(sources.roots(), [], ["grp"], out="pos", total="total")
    top = Forest(subroots.select(F.lit("").alias("grp"), "pos", "total", "node", F.col("grp").alias("own")))
    no_path = F.array().cast(NO_PATH)
    root = top.roots().select("grp", F.col("node").alias("root"), no_path.alias("path"))
    groups = top.paths(root).select(F.col("own").alias("grp"), F.col("node").alias("subroot"), "root", "path")
    each = sources.paths(stage(groups, "subroots"))
    proof = F.array_join(F.transform("path", lambda seg: F.concat(seg["left"], seg["right"])), "")
    folded = fold(F.coalesce("own.seen", "node"), F.col("path"))
    return each.select(
        F.col("own.id").alias("id"), F.col("node").alias("leaf"), "subroot", "root", digest(proof).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = f"""with recursive plain as (
  select doc_id, source, lang, n_chars, text, {crc32_sql("doc_id::varchar")} as crc from documents),
  altered as (select *, case when crc % {TAMPERED_SHARE} = 0 then translate(text, '{UPPER}', '{LOWER}') else text end as other from plain),
  hashed as (select doc_id, source, {", ".join(
    "sha256(" + " || ".join(
        f"coalesce(strlen({f}::varchar) || ':' || {f}::varchar, '-')" for f in ("doc_id", "source", "lang", "n_chars", text)
    ) + f") as {name}" for text, name in (("text", "leaf"), ("other", "seen"))
  )} from altered),
  leaves as (select *, dense_rank() over (order by source nulls first) - 1 as g,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, row_number() over () as k from hashed),
  nodes as (
    select 0 as lvl, g, pos, leaf as node, count(*) over (partition by g) as n from leaves
    union all
    select any_value(lvl) + 1, g, pos // 16, sha256(string_agg(node, '' order by pos)), (any_value(n) + 15) // 16
    from nodes where n > 1 group by g, pos // 16),
  subroots as (select g, node as subroot from nodes where n = 1),
  tops as (
    select 0 as lvl, g as pos, subroot as node, count(*) over () as n from subroots
    union all
    select any_value(lvl) + 1, pos // 16, sha256(string_agg(node, '' order by pos)), (any_value(n) + 15) // 16
    from tops where n > 1 group by pos // 16),
  segments as (
    select k, lvl, coalesce(string_agg(node, '' order by x.pos) filter (x.pos < l.pos >> (4 * lvl)), '') as l,
      coalesce(string_agg(node, '' order by x.pos) filter (x.pos > l.pos >> (4 * lvl)), '') as r
    from leaves l join nodes x on x.g = l.g and x.n > 1 and x.pos >> 4 = l.pos >> (4 * lvl + 4) group by k, lvl
    union all
    select k, 1000 + lvl, coalesce(string_agg(node, '' order by x.pos) filter (x.pos < l.g >> (4 * lvl)), ''),
      coalesce(string_agg(node, '' order by x.pos) filter (x.pos > l.g >> (4 * lvl)), '')
    from leaves l join tops x on x.n > 1 and x.pos >> 4 = l.g >> (4 * lvl + 4) group by k, lvl),
  paths as (select k, string_agg(l || r, '' order by lvl) as proof, list({{'l': l, 'r': r}} order by lvl) as path from segments group by k),
  folded as (
    select leaves.*, subroot, (select node from tops where n = 1) as root, sha256(coalesce(proof, '')) as proof_sha256,
      list_reduce(list_concat([{{'l': seen, 'r': ''}}], coalesce(path, [])),
        lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l as folded_root
    from leaves join subroots using (g) left join paths using (k))
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from folded"""


@query("op12_merkle_manifest", ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPERED_SHARE == 0
    altered = F.when(tampered, lower_az(F.col("text"))).otherwise(F.col("text"))
    return manifest(docs, changed={"text": altered}).withColumnRenamed("id", "doc_id")
