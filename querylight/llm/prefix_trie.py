"""Prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns. Its key is a sum of 128 hashed bits per turn, tagged with the
turn's place, so keys come from running sums over cut chunks and a conversation of any length never meets in
one task; the turn's text stays in its own row. Grouping by key gives members, children and parents.

The rollup over subtrees splits the forest of parent edges at centroids. A node's weight is the number of
(conversation, turn) pairs at or below it, which grouping already yields. In a component, the nodes that hold more
than half of its weight form the path from the centroid to the component's top. The centroid leaves; the subtrees
below it and the rest above it are the new components. Their totals are summed, and the centroid's (its own
value and the totals below it) is added to each node of that path; the path's weights drop by the centroid's. Every node and
descendant are parted by exactly one centroid, so each value is added once to each of its ancestors, and weights halve
from split to split whatever the depth. Components above `large` are split by joins, all at once a round; the others are
dealt to bins of bounded size and split in numpy there.

Results for odd input: rows without conv_id belong to no conversation and are left out. Null turns come first; turns
of equal number follow the hash of role and text, and repeated rows are turns of their own. Null roles and texts
are empty. Texts may have any length. A conversation may be rebuilt to no turns; it is a member of the root only.
An empty table has no nodes. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylight.llm.common import crc32_sql, small, text_or_empty
from querylight.llm.registry import query, table
from querylight.operators.numbering import number_rows
from querylight.session import stage

SHARED, EVERY = 4, 20
WORD = r"[^\x20\x09-\x0D]+"
LARGE, BIN = 8192, 16384
IDS_AT_ONCE = 4096
HOT_PARENTS = 200
LOW = 0xFFFFFFFF
KEY = ["depth", "a", "b"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, i, h, words, n): the turns of each conversation from 0, with how many there are."""
    role, text = text_or_empty(F.col("role")), text_or_empty(F.col("text"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("h"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    ranked = number_rows(stage(turns, "turns"), ["conv"], ["turn", "h"], out="i", total="n")
    return stage(ranked.select("conv", "i", "h", "words", "n"), "numbered")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, h, words, len) after sharing, and all conversations (conv, len).

    A conversation takes its first turns, as many as its checksum says, from the one whose id is the next multiple
    of 20 below, and goes on with its own behind as many.
    """
    convs = own.groupBy("conv").agg(F.first("n").alias("n"))
    taken = F.crc32(F.col("conv").cast("string")) % SHARED
    sized = convs.withColumn("taken", taken).withColumn("base", F.col("conv") - F.col("conv") % EVERY)
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    had = F.least("taken", F.coalesce("n_base", F.lit(0)))
    sized = sized.join(bases, "base", "left").withColumn("had", had)
    sized = stage(sized.withColumn("len", F.col("had") + F.greatest(F.col("n") - F.col("taken"), F.lit(0))), "sized")
    first = own.filter(F.col("i") < SHARED - 1).select(F.col("conv").alias("base"), "i", "h", "words")
    given = sized.join(first, "base").filter(F.col("i") < F.col("taken"))
    kept = own.drop("n").join(sized, "conv").filter(F.col("i") >= F.col("taken"))
    out = ["h", "words", "len"]
    rows = given.select("conv", (F.col("i") + 1).alias("depth"), *out).unionByName(
        kept.select("conv", (F.col("had") + F.col("i") - F.col("taken") + 1).alias("depth"), *out)
    )
    return rows, sized.select("conv", "len")


def running_sums(rows: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """`rows` with each of `columns` summed up to the row, as `number_rows` counts: chunk by chunk, shifted by those before."""
    chunked = stage(rows.repartitionByRange(*group, *order).withColumn("_chunk", F.spark_partition_id()), "running")
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = chunked.groupBy(*group, "_chunk").agg(*[F.sum(c).alias(c) for c in columns])
    shifts = sums.select(*group, "_chunk", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = {c: F.sum(c).over(inside) + F.col(f"_{c}") for c in columns}
    return chunked.join(shifts, [*group, "_chunk"]).withColumns(summed).drop("_chunk", *[f"_{c}" for c in columns])


def packed(high: Column, low: Column) -> Column:
    """The low 32 bits of two numbers in one."""
    return F.shiftleft(high.bitwiseAND(LOW), 32).bitwiseOR(low.bitwiseAND(LOW))


def with_keys(rows: DataFrame) -> DataFrame:
    """(conv, depth, words, len, a, b, pa, pb): the key of each prefix and that of the prefix before it."""
    one, two = (F.xxhash64(F.lit(i), "depth", "h") for i in (1, 2))
    lanes = {"x0": F.shiftrightunsigned(one, 32), "x1": one.bitwiseAND(LOW), "x2": F.shiftrightunsigned(two, 32), "x3": two.bitwiseAND(LOW)}
    tagged = rows.select("conv", "depth", "words", "len", *[v.alias(c) for c, v in lanes.items()])
    summed = running_sums(tagged.select("*", *[F.col(c).alias(f"s{c}") for c in lanes]), ["conv"], ["depth"], [f"s{c}" for c in lanes])
    s, p = [F.col(f"sx{i}") for i in range(4)], [F.col(f"sx{i}") - F.col(f"x{i}") for i in range(4)]
    return summed.select(
        "conv", "depth", "words", "len",
        packed(s[0], s[1]).alias("a"), packed(s[2], s[3]).alias("b"), packed(p[0], p[1]).alias("pa"), packed(p[2], p[3]).alias("pb"),
    )


def trie_nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: key, parent's key, conv_id, n_convs, weight, words, n_children, parent_conv_id."""
    zero = F.lit(0).cast("long")
    inner = rows.groupBy(*KEY).agg(
        F.min("pa").alias("pa"),
        F.min("pb").alias("pb"),
        F.min("conv").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.sum(F.col("len") - F.col("depth") + 1).alias("weight"),
        F.min("words").alias("words"),
    )
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("len") + 1).alias("weight")).select(
        zero.alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"),
        "conv_id", "n_convs", "weight", zero.alias("words"),
    ).filter("n_convs > 0")
    nodes = stage(inner.unionByName(root), "nodes")
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    counted = nodes.join(kids.agg(F.count("*").alias("n_children")), KEY, "left").fillna(0, ["n_children"])
    counted = stage(counted, "counted")
    parents = counted.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children"
    )
    # At most HOT_PARENTS nodes have that share of all nodes as children each; their children stay where they are.
    share = F.col("n_children") * HOT_PARENTS >= counted.count()
    link = ["depth", "pa", "pb"]
    hot = F.broadcast(parents.filter(share).drop("n_children"))
    rest = parents.filter(~share).drop("n_children")
    return counted.join(hot, link).unionByName(counted.join(hot, link, "left_anti").join(rest, link, "left"), allowMissingColumns=True)


def split_large(nodes: DataFrame, rows: DataFrame, total: int, large: int) -> tuple[DataFrame, list[DataFrame]]:
    """Splits components heavier than `large` until none is left.

    `nodes` has conv_id, parent_conv_id, KEY, weight and the values. Gives the nodes of the components left
    (with `top`, the key of their component's top) and what was added to nodes on the way.
    """
    values = ["leaves", "saved"]
    forest = nodes.withColumn("top", F.struct(*[F.lit(0).cast("long").alias(c) for c in KEY]))
    if total <= large:
        return forest, []
    paths = rows.select(F.col("conv").alias("conv_id"), F.col("depth").alias("cut"), "a", "b", "pa", "pb")
    finished, added = [], []
    heavy_nodes = forest.withColumn("total", F.lit(total).cast("long"))
    while True:
        here = stage(heavy_nodes, "heavy")
        heavy = 2 * F.col("weight") > F.col("total")
        centroids = here.filter(heavy).groupBy("top").agg(F.max(F.struct("depth", "a", "b", "weight")).alias("z"))
        centroids = stage(centroids, "centroids")
        split = here.join(small(centroids, centroids.count(), 256), "top").withColumn("cut", F.col("z.depth") + 1)
        below = split.filter("depth >= cut").select("conv_id", "cut", F.col("z.a").alias("pa"), F.col("z.b").alias("pb")).distinct()
        # The prefix of the node's own conversation right below the centroid's depth: a new top when the centroid is its parent.
        found = below.join(paths, ["conv_id", "cut", "pa", "pb"]).select("conv_id", "cut", "pa", "pb", F.struct(F.col("cut").alias("depth"), "a", "b").alias("into"))
        met = split.withColumn("pa", F.when(F.expr("depth >= cut"), F.col("z.a"))).withColumn("pb", F.col("z.b"))
        labelled = met.join(found, ["conv_id", "cut", "pa", "pb"], "left").drop("pa", "pb")
        labelled = labelled.withColumn("is_z", F.struct(*KEY) == F.struct("z.depth", "z.a", "z.b"))
        labelled = stage(labelled.withColumn("heavy", heavy), "labelled")
        inside = F.col("is_z") | F.col("into").isNotNull()
        sums = labelled.filter(inside).groupBy("top").agg(*[F.sum(v).alias(v) for v in values])
        sums = stage(sums, "sums")
        path = labelled.filter("heavy").select("conv_id", "depth", "top")
        added.append(path.join(small(sums, sums.count(), 128), "top").select("conv_id", "depth", *values))
        lighter = F.col("weight") - F.when(F.col("heavy"), F.col("z.weight")).otherwise(0)
        parts = labelled.filter("not is_z").withColumn("weight", lighter).withColumn("top", F.coalesce("into", "top"))
        parts = parts.select(*nodes.columns, "top")
        tops = parts.filter((F.struct(*KEY) == F.col("top")) & (F.col("weight") > large)).select("top", F.col("weight").alias("total"))
        tops = stage(tops, "tops")
        n_tops = tops.count()
        known = small(tops, n_tops, 128)
        finished.append(parts.join(known, "top", "left_anti"))
        if not n_tops:
            break
        heavy_nodes = parts.join(known, "top")
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out, added


def jump(pointer: np.ndarray) -> np.ndarray:
    """Where each chain of pointers ends, in as many steps as its length has binary digits."""
    while True:
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            return pointer
        pointer = further


def centroid_sums(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of `values` (rows by columns) over the subtrees of a forest; `parent` is -1 for tops.

    `weight` falls from parent to child by more than the other children have, as sums of positive numbers do.
    """
    m = len(parent)
    out, weight, every = np.zeros_like(values), weight.copy(), np.arange(m)
    label = jump(np.where(parent < 0, every, parent))
    active = every
    while len(active):
        top = label[active]
        path = active[2 * weight[active] > weight[top]]
        deepest = np.full(m, -1, dtype=np.int64)
        np.maximum.at(deepest, label[path], depth[path])
        centre = path[depth[path] == deepest[label[path]]]
        centre_of = np.full(m, -1, dtype=np.int64)
        centre_of[label[centre]] = centre
        is_centre = np.zeros(m, dtype=bool)
        is_centre[centre] = True
        rest = active[~is_centre[active]]
        below = rest[(parent[rest] >= 0) & is_centre[parent[rest]]]
        pointer = every.copy()
        pointer[rest] = np.where(label[rest] == rest, rest, parent[rest])
        pointer[below] = below
        ends = jump(pointer)
        totals = np.zeros_like(values)
        np.add.at(totals, ends[rest], values[rest])
        at_centre = values[centre].copy()
        order = np.full(m, -1, dtype=np.int64)
        order[centre] = np.arange(len(centre))
        np.add.at(at_centre, order[parent[below]], totals[below])
        out[path] += at_centre[order[centre_of[label[path]]]]
        lighter = path[~is_centre[path]]
        weight[lighter] -= weight[centre_of[label[lighter]]]
        label[rest] = ends[rest]
        active = rest
    return out


def subtree_sums(nodes: DataFrame, rows: DataFrame, large: int = LARGE, bin_nodes: int = BIN) -> DataFrame:
    """(conv_id, depth, leaves, saved): the values of `nodes` summed over each node's subtree."""
    total = nodes.agg(F.max("weight")).first()[0] or 0
    left, added = split_large(nodes, rows, total, large)
    left = stage(left, "components")
    bins = max(1, -(-left.count() // bin_nodes))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        place = pd.Series(np.arange(len(part)), index=pd.MultiIndex.from_arrays([part["conv_id"], part["depth"]]))
        up = pd.MultiIndex.from_arrays([part["parent_conv_id"].fillna(0).astype(np.int64), part["depth"] - 1])
        parent = place.reindex(up).fillna(-1).to_numpy().astype(np.int64)
        sums = centroid_sums(parent, part["depth"].to_numpy(), part["weight"].to_numpy(), part[["leaves", "saved"]].to_numpy())
        return pd.DataFrame({"conv_id": part["conv_id"].to_numpy(), "depth": part["depth"].to_numpy(), "leaves": sums[:, 0], "saved": sums[:, 1]})

    schema = "conv_id long, depth long, leaves long, saved long"
    dealt = left.select("conv_id", "parent_conv_id", "depth", "weight", "leaves", "saved", F.pmod(F.xxhash64("top"), F.lit(bins)).alias("bin"))
    sums = dealt.groupBy("bin").applyInPandas(solve, schema)
    for more in added:
        sums = sums.unionByName(more)
    return sums.groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def end_digests(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """KEY with ends_sha256: the digest of the ids of the conversations that end at a node, ascending and comma-joined.

    Ids meet in texts of some thousand; where a node has more than one, a task hashes them in order and
    keeps nothing but the hash's state.
    """
    zero = F.lit(0).cast("long")
    ends = rows.filter("depth = len").select(*KEY, "conv").unionByName(
        convs.filter("len = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv")
    )
    ranked = number_rows(ends, KEY, ["conv"], out="rank", total="of").withColumn("part", F.floor(F.col("rank") / IDS_AT_ONCE))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    parts = stage(ranked.groupBy(*KEY, "part", "of").agg(ids.alias("ids")), "ends")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, done = None, None, []
        for batch in batches:
            for depth, a, b, ids in zip(batch["depth"], batch["a"], batch["b"], batch["ids"]):
                if (depth, a, b) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = (depth, a, b), hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=[*KEY, "ends_sha256"])
            done = []
        if key:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=[*KEY, "ends_sha256"])

    long = parts.filter(F.col("of") > IDS_AT_ONCE).select(*KEY, "part", "ids").repartition(*KEY).sortWithinPartitions(*KEY, "part")
    few = parts.filter(F.col("of") <= IDS_AT_ONCE).select(*KEY, F.sha2("ids", 256).alias("ends_sha256"))
    return few.unionByName(long.mapInPandas(run, "depth long, a long, b long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, large: int = LARGE, bin_nodes: int = BIN) -> DataFrame:
    """One row per node of the trie of rebuilt `conversations` (conv_id, turn, role, text)."""
    turns, convs = rebuilt(numbered_turns(conversations))
    rows = stage(with_keys(turns), "prefixes")
    nodes = trie_nodes(rows, convs).withColumn("leaves", (F.col("n_children") == 0).cast("long"))
    nodes = stage(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "trie")
    sums = subtree_sums(nodes.select("conv_id", "parent_conv_id", *KEY, "weight", "leaves", "saved"), rows, large, bin_nodes)
    whole = nodes.drop("leaves", "saved").join(sums, ["conv_id", "depth"]).join(end_digests(rows, convs), KEY, "left")
    return whole.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


ORACLE = rf"""with
  turns as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as txt from conversations where conv_id is not null),
  own as (select c, role, txt, row_number() over (partition by c order by turn nulls first, md5(strlen(role) || ':' || role || txt)) - 1 as i from turns),
  counts as (select c, count(*) as n, c - c % {EVERY} as base from own group by c),
  convs as (select counts.*, {crc32_sql("c::varchar")} % {SHARED} as h from counts),
  sized as (select convs.*, least(h, coalesce(o.n, 0)) as k from convs left join counts o on o.c = convs.base),
  rebuilt as (
    select s.c, i + 1 as d, role, txt from sized s join own on own.c = s.base and i < h
    union all select s.c, k + i - h + 1, role, txt from sized s join own on own.c = s.c and i >= h),
  prefixes as (
    select c, d, sha256(string_agg(strlen(role) || ':' || role || strlen(txt) || ':' || txt, '') over (
        partition by c order by d rows between unbounded preceding and current row)) as key,
      len(list_filter(string_split_regex(txt, '[\x20\x09-\x0D]+'), lambda w: w <> '')) as words
    from rebuilt
    union all select c, 0, '', 0 from sized),
  nodes as (select d, key, min(c) as conv_id, count(*) as n_convs, (count(*) - 1) * min(words) as saved from prefixes group by d, key),
  edges as (select n.d, n.key, q.key as pkey, p.conv_id as parent_conv_id
    from nodes n join prefixes q on q.c = n.conv_id and q.d = n.d - 1 join nodes p on p.d = q.d and p.key = q.key),
  kids as (select d - 1 as d, pkey as key, count(*) as n_children from edges group by all),
  sums as (select q.d, q.key, sum(case when k.key is null then 1 else 0 end) as n_leaves, sum(u.saved) as saved_tokens
    from nodes u left join kids k on k.d = u.d and k.key = u.key join prefixes q on q.c = u.conv_id and q.d <= u.d group by q.d, q.key),
  ends as (select d, key, sha256(string_agg(c::varchar, ',' order by c)) as ends_sha256
    from prefixes p where d = (select max(d) from prefixes x where x.c = p.c) group by d, key)
select conv_id, n.d as depth, parent_conv_id, n_convs, coalesce(n_children, 0) as n_children, n_leaves::bigint as n_leaves,
  saved_tokens::bigint as saved_tokens, coalesce(ends_sha256, sha256('')) as ends_sha256
from nodes n left join edges e on e.d = n.d and e.key = n.key left join kids k on k.d = n.d and k.key = n.key
  join sums s on s.d = n.d and s.key = n.key left join ends x on x.d = n.d and x.key = n.key"""


@query("op13_prefix_trie", ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
