"""Result comparison, verdicts and scores."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from querylight.operators import frames, match, similarity, verdicts
from querylight.operators.cells import canonical_cells
from querylight.plans.eval_inputs import EVAL_CTE, eval_inputs, eval_pairs, eval_raw_cells
from querylight.plans.registry import query, table
from querylight.session import stage


def joined(column: str):
    return F.array_join(column, "|")


@query("eval_canonical_cells", f"with {EVAL_CTE} select pair_id, side, row_idx, col_idx, cell from cells")
def eval_canonical_cells(spark, sf_dir):
    return canonical_cells(eval_raw_cells(spark, sf_dir))


@query("eval_unordered_rows", f"with {EVAL_CTE} select pair_id, side, row_idx, bag_key as row_key from full_rows")
def eval_unordered_rows(spark, sf_dir):
    cells, _ = eval_inputs(spark, sf_dir)
    return match.unordered_rows(cells).select("pair_id", "side", "row_idx", joined("vals").alias("row_key"))


@query(
    "eval_quick_reject",
    f"""with {EVAL_CTE},
    marks as (select pair_id, bag_key, bit_or(case side when 'gold' then 1 else 2 end) as sides
              from full_rows group by all),
    v as (select pair_id, min(sides) = 3 as may_match from marks group by all)
    select pair_id, coalesce(may_match, true) as may_match from pairs left join v using (pair_id)""",
)
def eval_quick_reject(spark, sf_dir):
    return match.quick_reject(*eval_inputs(spark, sf_dir))


@query(
    "eval_multiset_eq",
    f"""with {EVAL_CTE},
    marks as (select pair_id, row_key, sum(case side when 'gold' then 1 else -1 end) as b
              from full_rows group by all),
    v as (select pair_id, bool_and(b = 0) as same_bag from marks group by all)
    select pair_id, coalesce(same_bag, true) as same_bag from pairs left join v using (pair_id)""",
)
def eval_multiset_eq(spark, sf_dir):
    return match.multiset_eq(*eval_inputs(spark, sf_dir))


PERMUTED = """
    shape as (
      select pair_id, count(distinct case when side = 'gold' then row_idx end) as gr,
        count(distinct case when side = 'pred' then row_idx end) as pr,
        coalesce(max(case when side = 'gold' then col_idx end), -1) as gc,
        coalesce(max(case when side = 'pred' then col_idx end), -1) as pc
      from cells group by pair_id),
    perms as (
      select a.i as p0, b.i as p1, c.i as p2, d.i as p3
      from range(4) a(i), range(4) b(i), range(4) c(i), range(4) d(i)
      where a.i <> b.i and a.i <> c.i and a.i <> d.i and b.i <> c.i and b.i <> d.i and c.i <> d.i),
    wide as (
      select pair_id, side, row_idx, list(cell order by col_idx) as vals from cells
      where pair_id in (select pair_id from shape where gr = pr and gc = pc) group by all),
    laid as (
      select pair_id, p0, p1, p2, p3, side, row_idx,
        case side when 'gold' then vals else [vals[p0 + 1], vals[p1 + 1], vals[p2 + 1], vals[p3 + 1]] end as vals
      from wide, perms),
    balance as (
      select pair_id, p0, p1, p2, p3, vals, {place} sum(case side when 'gold' then 1 else -1 end) as b
      from laid group by all),
    per_perm as (select pair_id, p0, p1, p2, p3, bool_and(b = 0) as same from balance group by all),
    hit as (select pair_id, bool_or(same) as match from per_perm group by all)
    select pair_id, case when shape.pair_id is null then true else coalesce(match, false) end as match
    from pairs left join shape using (pair_id) left join hit using (pair_id)"""


@query("eval_result_eq", f"with {EVAL_CTE}, {PERMUTED.format(place='')}")
def eval_result_eq(spark, sf_dir):
    return match.result_eq(*eval_inputs(spark, sf_dir))


@query("eval_result_eq_ordered", f"with {EVAL_CTE}, {PERMUTED.format(place='row_idx,')}")
def eval_result_eq_ordered(spark, sf_dir):
    return match.result_eq(*eval_inputs(spark, sf_dir), ordered=True)


@query(
    "eval_column_candidates",
    f"""with {EVAL_CTE},
    bags as (select pair_id, side, col_idx, list_sort(list(cell)) as bag from cells group by all)
    select g.pair_id, g.col_idx as gold_col, p.col_idx as pred_col
    from bags g join bags p on g.pair_id = p.pair_id and g.bag = p.bag and g.side = 'gold' and p.side = 'pred'""",
)
def eval_column_candidates(spark, sf_dir):
    cells, _ = eval_inputs(spark, sf_dir)
    return match.column_candidates(cells)


@query(
    "eval_normalize",
    f"""with {EVAL_CTE},
    d as (select pair_id, side, row_key, min(row_idx) as first_idx from full_rows group by all)
    select pair_id, side, row_key, row_number() over (partition by pair_id, side
        order by case when pair_id % 2 = 0 then first_idx else 0 end, row_key) - 1 as new_idx
    from d""",
)
def eval_normalize(spark, sf_dir):
    cells, _ = eval_inputs(spark, sf_dir)
    return frames.normalize(cells, F.col("pair_id") % 2 == 0).select(
        "pair_id", "side", "new_idx", joined("vals").alias("row_key")
    )


SUBSET = """
    bags as (select pair_id, side, col_idx, list_sort(list(cell)) as bag from cells group by all),
    ranked as (select *, row_number() over (partition by pair_id, side, bag order by col_idx) as k from bags),
    mapped as (
      select g.pair_id, g.col_idx as gold_col, p.col_idx as pred_col
      from ranked g join ranked p on g.pair_id = p.pair_id and g.bag = p.bag and g.k = p.k
      where g.side = 'gold' and p.side = 'pred'),
    width as (select pair_id, max(col_idx) + 1 as w from cells where side = 'gold' group by all),
    full_map as (select pair_id from mapped join width using (pair_id) group by pair_id, w having count(*) = w),
    laid as (
      select c.pair_id, c.side, c.row_idx, m.gold_col as col_idx, c.cell
      from cells c join mapped m on c.pair_id = m.pair_id
        and c.col_idx = case c.side when 'gold' then m.gold_col else m.pred_col end
      where c.pair_id in (select pair_id from full_map)),
    r as (select pair_id, side, row_idx, list(cell order by col_idx) as vals from laid group by all),
    d as (select pair_id, side, vals, min(row_idx) as first_idx from r group by all),
    p as (select *, row_number() over (partition by pair_id, side order by first_idx) as place from d),
    marks as (select pair_id, vals, {place} bit_or(case side when 'gold' then 1 else 2 end) as sides
              from p group by all),
    subset_v as (select pair_id, min(sides) = 3 as subset from marks group by all)"""


@query(
    "eval_subset_match",
    f"""with {EVAL_CTE}, {SUBSET.format(place='')}
    select pair_id, coalesce(subset, false) as subset from pairs left join subset_v using (pair_id)""",
)
def eval_subset_match(spark, sf_dir):
    return frames.subset_match(*eval_inputs(spark, sf_dir))


@query(
    "eval_subset_match_ordered",
    f"""with {EVAL_CTE}, {SUBSET.format(place='place,')}
    select pair_id, coalesce(subset, false) as subset from pairs left join subset_v using (pair_id)""",
)
def eval_subset_match_ordered(spark, sf_dir):
    return frames.subset_match(*eval_inputs(spark, sf_dir), ordered=True)


@query(
    "eval_row_jaccard",
    f"""with {EVAL_CTE},
    marks as (select pair_id, row_idx, cell, bit_or(case side when 'gold' then 1 else 2 end) as sides
              from cells group by all)
    select pair_id, row_idx, round(count(*) filter (sides = 3) / count(*), 6) as sim
    from marks group by all having bit_or(sides) = 3""",
)
def eval_row_jaccard(spark, sf_dir):
    cells, _ = eval_inputs(spark, sf_dir)
    return similarity.row_jaccard(cells).withColumn("sim", F.round("sim", 6))


# The walk over places carries the open rows of the longer side as a list of value sets.
@query(
    "eval_align_score",
    f"""with recursive {EVAL_CTE},
    sets as (select pair_id, side, row_idx, list(distinct cell) as vals from cells group by all),
    lists as (
      select pair_id, coalesce(list(vals order by row_idx) filter (side = 'gold'), []) as l,
        coalesce(list(vals order by row_idx) filter (side = 'pred'), []) as r, sum(len(vals)) as total
      from sets group by pair_id),
    walk as (
      select pair_id, 0 as i, case when len(l) > len(r) then r else l end as s,
        case when len(l) > len(r) then l else r end as o, 0 as shared, total from lists
      union all
      select pair_id, i + 1, s, list_transform(range(len(o)), lambda k: case when k = i then o[j] when k = j - 1
          then o[i + 1] else o[k + 1] end), shared + len(list_intersect(s[i + 1], o[j])), total
      from (
        select *, list_position(scores, list_max(scores)) + i as j from (
          select *, list_transform(range(i, len(o)), lambda k: len(list_intersect(s[i + 1], o[k + 1]))
            / len(list_distinct(list_concat(s[i + 1], o[k + 1])))) as scores
          from walk where i < len(s)))),
    scored as (select pair_id, arg_max(shared, i) / (any_value(total) - arg_max(shared, i)) as score from walk group by pair_id)
    select pair_id, round(coalesce(score, 1.0), 6) as score from pairs left join scored using (pair_id)""",
)
def eval_align_score(spark, sf_dir):
    return similarity.align_score(*eval_inputs(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(
    "eval_sim_listview",
    f"""with {EVAL_CTE},
    marks as (select pair_id, row_idx, cell, bit_or(case side when 'gold' then 1 else 2 end) as sides
              from cells group by all),
    v as (select pair_id, count(*) filter (sides = 3) / count(*) as sim from marks group by all)
    select pair_id, round(coalesce(sim, 1.0), 6) as sim from pairs left join v using (pair_id)""",
)
def eval_sim_listview(spark, sf_dir):
    return similarity.sim_listview(*eval_inputs(spark, sf_dir)).withColumn("sim", F.round("sim", 6))


SAME_FRAME = """
    marks as (select pair_id, row_idx, cell, bit_or(case side when 'gold' then 1 else 2 end) as sides
              from cells group by all),
    listed as (select pair_id, min(sides) = 3 as same from marks group by all),
    balance as (select pair_id, set_key, sum(case side when 'gold' then 1 else -1 end) as b
                from full_rows group by all),
    bagged as (select pair_id, bool_and(b = 0) as same from balance group by all),
    sim_one as (
      select pairs.pair_id, coalesce(case when lower(gold_sql || ' ' || pred_sql) like '%order by%'
          then listed.same else bagged.same end, true) as same
      from pairs left join listed using (pair_id) left join bagged using (pair_id))"""


@query("eval_df_sim_pair", f"with {EVAL_CTE}, {SAME_FRAME} select pair_id, same from sim_one")
def eval_df_sim_pair(spark, sf_dir):
    return similarity.df_sim_is_one(*eval_inputs(spark, sf_dir))


@query(
    "sim_jaro_winkler",
    f"""with {EVAL_CTE}
    select pair_id, sql_type, round(jaro_winkler_similarity(gold_sql, pred_sql), 6) as similarity from pairs""",
)
def sim_jaro_winkler(spark, sf_dir):
    pairs = eval_pairs(spark, sf_dir)
    scored = similarity.text_similarity(pairs, "gold_sql", "pred_sql")
    return scored.select("pair_id", "sql_type", F.round("similarity", 6).alias("similarity"))


@query(
    "sim_fuzzy_join",
    """with named as (select distinct p_type, p_size, p_name from part)
    select 'pair' as kind, p_type, p_size, null as p_partkey, l.p_name as left_name, r.p_name as right_name,
      round(jaro_winkler_similarity(l.p_name, r.p_name), 6) as similarity
    from named l join named r using (p_type, p_size)
    where l.p_name < r.p_name and jaro_winkler_similarity(l.p_name, r.p_name) >= 0.7
    union all select 'member', p_type, p_size, p_partkey, p_name, null, null from part""",
)
def sim_fuzzy_join(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    joined = similarity.fuzzy_join(names, "p_partkey", "p_name", ["p_type", "p_size"], 0.7)
    return joined.withColumn("similarity", F.round("similarity", 6))


@query(
    "sim_fuzzy_pairs",
    """with named as (select p_type, p_size, p_name, count(*) as n from part where p_name is not null group by all)
    select l.p_type, l.p_size, l.p_name as left_name, r.p_name as right_name, l.n as left_rows, r.n as right_rows,
      round(jaro_winkler_similarity(l.p_name, r.p_name), 6) as similarity
    from named l join named r on l.p_type = r.p_type and l.p_size = r.p_size
      and (l.p_name < r.p_name or l.p_name = r.p_name and l.n > 1)
    where jaro_winkler_similarity(l.p_name, r.p_name) >= 0.7""",
)
def sim_fuzzy_pairs(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name", "p_type", "p_size")
    near = similarity.fuzzy_pairs(names, "p_name", ["p_type", "p_size"], 0.7)
    return near.withColumn("similarity", F.round("similarity", 6))


@query(
    "eval_valid_gold",
    f"""with {EVAL_CTE},
    v as (select pair_id, count(*) filter (cell = 'null:') = 0 as valid from cells where side = 'gold' group by all)
    select pair_id, coalesce(valid, false) as valid from pairs left join v using (pair_id)""",
)
def eval_valid_gold(spark, sf_dir):
    return verdicts.valid_gold(*eval_inputs(spark, sf_dir))


# The same search over all column permutations as in `eval_result_eq`, under names of its own.
EQUAL = re.sub(r"\b(shape|perms|wide|laid|balance|per_perm|hit)\b", r"eq_\1", PERMUTED.format(place=""))
EQUAL_CTE = EQUAL.replace("\n    select pair_id, case when eq_shape.pair_id", ",\n    eq as (select pair_id, case when eq_shape.pair_id") + ")"
VERDICTS = (
    SUBSET.format(place="")
    + ","
    + SAME_FRAME.replace("marks", "cell_marks")
    + """,
    """
    + EQUAL_CTE.strip()
    + """,
    valid_v as (select pair_id, count(*) filter (cell = 'null:') = 0 as valid
                from cells where side = 'gold' group by all),
    coded as (
      select pairs.*,
        case when sql_type in ('cypher', 'ngql')
          then case when err is not null then -1 when coalesce(sim_one.same, false) then 1 else 0 end
          else case when not coalesce(valid, false) then -2 when err is not null then -1
            when coalesce(match, true) then 1 else 0 end end as execution_match,
        case when sql_type in ('cypher', 'ngql') then case when err is not null then -1 else 0 end
          else case when not coalesce(valid, false) then -2 when err is not null then -1
            when coalesce(subset, false) then 1 else 0 end end as df_match,
        jaro_winkler_similarity(gold_sql, pred_sql) as similarity
      from pairs left join eq using (pair_id) left join subset_v using (pair_id)
        left join sim_one using (pair_id) left join valid_v using (pair_id))"""
)
CODED_CTE = f"with {EVAL_CTE}, {VERDICTS}"

TALLY = """count(*) filter (execution_match <> -2) as valid_count,
    count(*) filter (execution_match = 1) as match_count,
    count(*) filter (df_match = 1) as df_match_count,
    count(*) filter (execution_match = -1) as sql_error_count,
    sum(case when execution_match <> -2 then similarity else 0 end) as similarity_sum"""
SCORES = """valid_count, match_count, df_match_count, sql_error_count,
    round(100 * round(match_count / valid_count, 5), 3) as ex,
    round(100 * round(df_match_count / valid_count, 5), 3) as df_ex,
    round(100 * round((valid_count - sql_error_count) / valid_count, 5), 3) as executable,
    round(100 * round(similarity_sum / valid_count, 5), 3) as similarity"""


def tidy(df):
    for name in verdicts.METRICS:
        df = df.withColumn(name, F.round(name, 3))
    return df


def coded(spark, sf_dir):
    return verdicts.verdicts(*eval_inputs(spark, sf_dir))


ERROR = "case when execution_match = -1 then err else '' end as error"


@query(
    "eval_verdict",
    f"""{CODED_CTE} select pair_id, sql_type, execution_match, df_match, {ERROR} from coded
    where sql_type not in ('cypher', 'ngql')""",
)
def eval_verdict(spark, sf_dir):
    out = verdicts.relational_verdicts(*eval_inputs(spark, sf_dir))
    return out.select("pair_id", "sql_type", "execution_match", "df_match", "error")


@query(
    "eval_verdict_graph",
    f"""{CODED_CTE} select pair_id, sql_type, execution_match, df_match, {ERROR} from coded
    where sql_type in ('cypher', 'ngql')""",
)
def eval_verdict_graph(spark, sf_dir):
    out = verdicts.graph_verdicts(*eval_inputs(spark, sf_dir))
    return out.select("pair_id", "sql_type", "execution_match", "df_match", "error")


@query(
    "metric_by_dialect",
    f"{CODED_CTE}, t as (select sql_type, {TALLY} from coded group by all) select sql_type, {SCORES} from t",
)
def metric_by_dialect(spark, sf_dir):
    return tidy(verdicts.metric_by_dialect(coded(spark, sf_dir)))


@query("metric_overall", f"{CODED_CTE}, t as (select {TALLY} from coded) select {SCORES} from t")
def metric_overall(spark, sf_dir):
    return tidy(verdicts.metric_overall(coded(spark, sf_dir)))


WIDE = ", ".join(
    f"max(case when sql_type = '{d}' then {m} end) as eval_{d}_{m}" for d in verdicts.DIALECTS for m in verdicts.METRICS
)


@query(
    "metric_wide",
    f"""{CODED_CTE}, t as (select sql_type, {TALLY} from coded group by all),
    s as (select sql_type, {SCORES} from t) select {WIDE} from s""",
)
def metric_wide(spark, sf_dir):
    return verdicts.metric_wide(tidy(verdicts.metric_by_dialect(coded(spark, sf_dir))))


@query(
    "metric_history",
    f"""{CODED_CTE}, t as (select (pair_id % 3 + 1) * 50 as step, sql_type, {TALLY} from coded group by all)
    select step, sql_type, {SCORES} from t""",
)
def metric_history(spark, sf_dir):
    called = coded(spark, sf_dir).withColumn("call", F.col("pair_id") % 3 + 1)
    return tidy(verdicts.metric_history(called, "call", 50))


@query(
    "metric_verdicts",
    f"""{CODED_CTE}, e as (select *, {ERROR} from coded)
    select coalesce(sql_type, '*') as sql_type, coalesce(cast(execution_match as varchar), '*') as execution_match,
      coalesce(error, '*') as error, grouping_id(sql_type, execution_match, error) as level, count(*) as n
    from e group by rollup (sql_type, execution_match, error)""",
)
def metric_verdicts(spark, sf_dir):
    return verdicts.verdict_counts(coded(spark, sf_dir))
