"""Routing analytics over `embeddings`: tokens, expert gates and dialect gates are its vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from querylight.functions.vectors import softmax, top_k
from querylight.operators import balance, routing
from querylight.plans.registry import query, table

E, D, K, LAYERS = 8, 4, 2, 3
G = E // D

TOKENS = """select cast(floor(vec_id / 16) as bigint) as seq, cast(vec_id % 16 as bigint) as pos,
    case when vec_id % 16 < 16 - floor(vec_id / 16) % 5 then 1 else 0 end as mask,
    label % 4 as dialect, embedding as x
  from embeddings"""

ROUTE_CTE = f"""tokens as ({TOKENS}),
    gates as (select list(embedding::double[] order by vec_id) as g from embeddings where vec_id < {E}),
    dgates as (select list(embedding::double[] order by vec_id) as g from embeddings where vec_id between 100 and 103),
    elog as (select seq, pos, mask, dialect, unnest(range({E})) as e,
        unnest(list_transform(g, lambda r: list_dot_product(x::double[], r))) as v from tokens, gates),
    dlog as (select seq, pos, unnest(range({D})) as d,
        unnest(list_transform(g, lambda r: list_dot_product(x::double[], r))) as v from tokens, dgates),
    layers as (select unnest(range({LAYERS})) as layer),
    elayer as (select layer, seq, pos, mask, dialect, e, v * (1 + layer) as v from elog, layers),
    dlayer as (select layer, seq, pos, d, v * (1 + layer) as v from dlog, layers),
    esoft as (select layer, seq, pos, mask, dialect, e, v, x / sum(x) over t as p from (
        select *, exp(v - max(v) over (partition by layer, seq, pos)) as x from elayer)
      window t as (partition by layer, seq, pos)),
    dsoft as (select layer, seq, pos, d, v, x / sum(x) over (partition by layer, seq, pos) as p from (
        select *, exp(v - max(v) over (partition by layer, seq, pos)) as x from dlayer)),
    combined as (select s.layer, s.seq, s.pos, s.e, s.p * d.p as w from esoft s join dsoft d
        on s.layer = d.layer and s.seq = d.seq and s.pos = d.pos and d.d = s.e // {G}),
    ranked as (select *, row_number() over (partition by layer, seq, pos order by w desc, e) - 1 as rank from combined),
    chosen as (select * from ranked where rank < {K})"""


def q(sql: str) -> str:
    return f"with {ROUTE_CTE} {sql}"


def tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").selectExpr(
        "cast(floor(vec_id / 16) as bigint) as seq",
        "cast(vec_id % 16 as bigint) as pos",
        "case when vec_id % 16 < 16 - floor(vec_id / 16) % 5 then 1 else 0 end as mask",
        "label % 4 as dialect",
        "embedding as x",
    )

    def gates(condition):
        return table(spark, sf_dir, "embeddings").filter(condition).selectExpr(
            "vec_id as e", "cast(embedding as array<double>) as g"
        )

    scored = routing.gate_logits(rows, gates(f"vec_id < {E}"), "x", "expert_logits")
    return routing.gate_logits(scored, gates("vec_id between 100 and 103"), "x", "dialect_logits")


def router_log(spark, sf_dir):
    layered = tokens(spark, sf_dir).withColumn("layer", F.explode(F.array(*[F.lit(i) for i in range(LAYERS)])))
    grow = F.col("layer") + 1
    return layered.withColumn(
        "expert_logits", F.transform("expert_logits", lambda v: v * grow)
    ).withColumn("dialect_logits", F.transform("dialect_logits", lambda v: v * grow))


def six(column):
    return F.round(column, 6).alias(column)


def exploded(rows, values, index, name):
    return rows.select("seq", "pos", F.posexplode(values).alias(index, name)).withColumn(name, F.round(name, 6))


def choice(rows):
    return routing.long_choice(rows, top_k(routing.soft_weights(G), K))


@query(
    "route_logits",
    q("""select seq, pos, 'expert' as gate, e as idx, round(v, 6) as logit from elog
      union all select seq, pos, 'dialect', d, round(v, 6) from dlog"""),
)
def route_logits(spark, sf_dir):
    both = F.array(
        F.struct(F.lit("expert").alias("gate"), F.col("expert_logits").alias("l")),
        F.struct(F.lit("dialect").alias("gate"), F.col("dialect_logits").alias("l")),
    )
    each = tokens(spark, sf_dir).select("seq", "pos", F.explode(both).alias("b"))
    return each.select("seq", "pos", "b.gate", F.posexplode("b.l").alias("idx", "logit")).withColumn("logit", F.round("logit", 6))


@query("route_softmax", q("select seq, pos, e, round(p, 6) as w from esoft where layer = 0"))
def route_softmax(spark, sf_dir):
    return exploded(tokens(spark, sf_dir), softmax("expert_logits"), "e", "w")


@query("route_dialect_weighted", q("select seq, pos, e, round(w, 6) as w from combined where layer = 0"))
def route_dialect_weighted(spark, sf_dir):
    return exploded(tokens(spark, sf_dir), routing.soft_weights(G), "e", "w")


@query("route_topk", q("select seq, pos, rank, e, round(w, 6) as w from chosen where layer = 0"))
def route_topk(spark, sf_dir):
    return choice(tokens(spark, sf_dir)).withColumn("w", F.round("w", 6))


@query(
    "route_topk_norm",
    q("""select seq, pos, rank, e, round(w / (sum(w) over (partition by seq, pos) + 1e-20), 6) as w_norm,
      round(w * 2.5, 6) as w_scaled from chosen where layer = 0"""),
)
def route_topk_norm(spark, sf_dir):
    best = top_k(routing.soft_weights(G), K)
    rows = tokens(spark, sf_dir).select("seq", "pos", best.alias("best"))
    both = F.arrays_zip(
        routing.renormalised(F.col("best")).alias("norm"), routing.scaled(F.col("best"), 2.5).alias("scaled")
    )
    each = rows.select("seq", "pos", F.posexplode(both).alias("rank", "b"))
    return each.select(
        "seq", "pos", "rank", F.col("b.norm.e").alias("e"),
        F.round("b.norm.w", 6).alias("w_norm"), F.round("b.scaled.w", 6).alias("w_scaled"),
    )


@query(
    "route_hard_group",
    q(f"""select seq, pos, grp, rank, e, round(w, 6) as w from (
      select *, row_number() over (partition by seq, pos order by w desc, e) - 1 as rank from (
        select s.seq, s.pos, grp, s.e, case when s.e // {G} = grp then s.p else 0 end as w
        from esoft s join (select seq, arg_max(d, (m, -d)) as grp from (
            select seq, d, avg(v) as m from dlog group by seq, d) group by seq) using (seq)
        where s.layer = 0)) where rank < {K}"""),
)
def route_hard_group(spark, sf_dir):
    rows = routing.hard_group(tokens(spark, sf_dir), D, G, K).select("seq", "pos", F.col("group").alias("grp"), F.posexplode("chosen").alias("rank", "c"))
    return rows.select("seq", "pos", "grp", "rank", "c.e", F.round("c.w", 6).alias("w"))


@query(
    "route_group_limited",
    q(f"""select seq, pos, rank, e, round(w, 6) as w from (
      select *, row_number() over (partition by seq, pos order by w desc, e) - 1 as rank from (
        select s.seq, s.pos, s.e, case when gr.grank <= 2 then s.p else 0 end as w
        from esoft s join (
          select seq, pos, grp, row_number() over (partition by seq, pos order by best desc, grp) as grank from (
            select seq, pos, e // {G} as grp, max(p) as best from esoft where layer = 0 group by all)) gr
          on s.seq = gr.seq and s.pos = gr.pos and s.e // {G} = gr.grp
        where s.layer = 0)) where rank < {K}"""),
)
def route_group_limited(spark, sf_dir):
    rows = tokens(spark, sf_dir).withColumn("s", softmax("expert_logits"))
    picked = routing.long_choice(rows, routing.group_limited(F.col("s"), D, G, 2, K))
    return picked.withColumn("w", F.round("w", 6))


@query(
    "route_sequence_groups",
    q("""select seq, label, count(*) over (partition by label) as group_size from (
      select seq, arg_max(d, (m, -d)) as label from (select seq, d, avg(v) as m from dlog group by seq, d) group by seq)"""),
)
def route_sequence_groups(spark, sf_dir):
    return routing.sequence_groups(tokens(spark, sf_dir), "dialect_logits", D)


@query(
    "route_dispatch_plan",
    q("""select e, n as n_tokens, cast(sum(n) over (order by e) as bigint) as end_at,
      cast(sum(n) over (order by e) - n as bigint) as start_at
      from (select e, count(*) as n from chosen where layer = 0 group by e)"""),
)
def route_dispatch_plan(spark, sf_dir):
    return routing.dispatch_plan(choice(tokens(spark, sf_dir)))


def loss_sql(source: str, n: int, k: int) -> str:
    """Balance loss over `source(layer, …, e, p)` with n experts; a row is one softmax."""
    return q(f"""select round({n} * sum(f * m), 6) as loss from (
      select e, avg(case when rank <= {k} then 1.0 else 0.0 end) as f, avg(p) as m from (
        select e, p, row_number() over (partition by row_key order by p desc, e) as rank from ({source}))
      group by e)""")


@query("balance_loss", loss_sql("select (layer, seq, pos) as row_key, e, p from esoft", E, K))
def balance_loss(spark, sf_dir):
    return balance.balance_loss(router_log(spark, sf_dir), E, K).select(six("loss"))


@query("balance_loss_masked", loss_sql("select (layer, seq, pos) as row_key, e, p from esoft where mask = 1", E, K))
def balance_loss_masked(spark, sf_dir):
    return balance.balance_loss_masked(router_log(spark, sf_dir), E, K).select(six("loss"))


@query(
    "balance_loss_in_group",
    loss_sql(
        f"""select (layer, seq, pos, e // {G}) as row_key, e % {G} as e,
          p / sum(p) over (partition by layer, seq, pos, e // {G}) as p from esoft""",
        G,
        1,
    ),
)
def balance_loss_in_group(spark, sf_dir):
    return balance.balance_loss_in_group(router_log(spark, sf_dir), G, 1).select(six("loss"))


@query(
    "balance_loss_seq",
    q(f"""select round(0.01 * (select avg(v) from (select seq, sum(c * m) as v from (
          select seq, e, sum(case when rank <= {K} then 1.0 else 0 end) * {E} / (count(*) * {K}) as c, avg(p) as m
          from r group by seq, e) group by seq)), 6) as seq_loss,
        round(0.01 * {E} * (select sum(c * m) from (
          select e, sum(case when rank <= {K} then 1.0 else 0 end) / (count(*) * {K}) as c, avg(p) as m
          from r group by e)), 6) as global_loss""").replace(
        "chosen as (", f"r as (select *, row_number() over (partition by seq, pos order by p desc, e) as rank from esoft where layer = 0),\n    chosen as ("
    ),
)
def balance_loss_seq(spark, sf_dir):
    return balance.balance_loss_seq(tokens(spark, sf_dir), E, K, 0.01).select(six("seq_loss"), six("global_loss"))


def seq_labels(spark, sf_dir):
    """One dialect id per sequence, that of its first token; every seventh sequence has none."""
    first = tokens(spark, sf_dir).groupBy("seq").agg(F.min_by("dialect", "pos").alias("label"))
    known = F.when(F.col("seq") % 7 != 3, F.col("label"))
    return first.select("seq", F.floor(F.col("seq") / 3).alias("batch"), known.alias("label"))


DIALECT_LOSS = f"""select batch, {{value}} from (
    select seq, cast(floor(seq / 3) as bigint) as batch, case when seq % 7 <> 3 then label end as label, d,
      m - ln(sum(exp(m)) over (partition by seq)) as logp
    from (select seq, d, avg(v) as m from dlayer group by seq, d)
      join (select seq, arg_min(dialect, pos) as label from tokens group by seq) using (seq))
  group by batch having count(*) filter (label is null) = 0"""


@query(
    "dialect_cross_entropy",
    q(DIALECT_LOSS.format(value="round(sum(case when d = label then -logp end) / count(distinct seq), 6) as cross_entropy")),
)
def dialect_cross_entropy(spark, sf_dir):
    losses = balance.dialect_losses(router_log(spark, sf_dir), seq_labels(spark, sf_dir), D)
    return losses.select("batch", six("cross_entropy"))


@query(
    "dialect_label_smoothing",
    q(DIALECT_LOSS.format(
        value=f"""round(sum(-logp * (case when d = label then 0.9 else 0 end + 0.1 / {D})) / count(distinct seq), 6)
          as smoothed"""
    )),
)
def dialect_label_smoothing(spark, sf_dir):
    losses = balance.dialect_losses(router_log(spark, sf_dir), seq_labels(spark, sf_dir), D)
    return losses.select("batch", six("smoothed"))


@query(
    "report_expert_weights",
    q(f"""select e, round(ep * dp, 6) as weight from (
        select e, exp(m) / sum(exp(m)) over () as ep from (select e, avg(v) as m from elayer group by e))
      join (select d, exp(m) / sum(exp(m)) over () as dp from (select d, avg(v) as m from dlayer group by d))
      on d = e // {G}"""),
)
def report_expert_weights(spark, sf_dir):
    return balance.report_expert_weights(router_log(spark, sf_dir), E, D).select("e", six("weight"))


@query(
    "report_dialect_votes",
    q(f"""select dialect, votes, round(exp(votes - max(votes) over ()) / sum(exp(votes - mx)) over (), 6) as share from (
        select *, max(votes) over () as mx from (
          select i as dialect, count(d) as votes from (select unnest(range({D})) as i) left join (
            select seq, pos, arg_max(d, (m, -d)) as d from (
              select seq, pos, d, avg(v) as m from dlayer group by all) group by all) on i = d group by i))"""),
)
def report_dialect_votes(spark, sf_dir):
    return balance.report_dialect_votes(router_log(spark, sf_dir), D).select("dialect", "votes", six("share"))


@query("report_layer_weights", q("select e, round(avg(w), 6) as weight from combined where layer = 2 group by e"))
def report_layer_weights(spark, sf_dir):
    return balance.report_layer_weights(router_log(spark, sf_dir), 2, E, G).select("e", six("weight"))


@query("report_expert_hits", q("select e, count(*) as hits from chosen group by e"))
def report_expert_hits(spark, sf_dir):
    return balance.report_expert_hits(router_log(spark, sf_dir), G, K)


@query(
    "router_log_assemble",
    q("select layer, seq, row_number() over (partition by layer, seq order by pos) - 1 as pos, round(v, 6) as first_logit from elayer where e = 0"),
)
def router_log_assemble(spark, sf_dir):
    """The first ten tokens of a sequence are the prompt step; every later token is a step of its own."""
    log = router_log(spark, sf_dir)
    step = F.when(F.col("pos") < 10, 0).otherwise(F.col("pos") - 9)
    # A sequence may start inside the table's first row range, so places restart at its first token.
    first = log.groupBy("layer", "seq").agg(F.min("pos").alias("first_pos"))
    shifted = log.join(first, ["layer", "seq"])
    at = F.when(F.col("pos") < 10, F.col("pos") - F.least("first_pos", F.lit(10))).otherwise(0)
    steps = shifted.select("layer", "seq", step.alias("step"), at.alias("at"), F.get("expert_logits", F.lit(0)).alias("v"))
    return routing.assemble_log(steps).select("layer", "seq", "pos", F.round("v", 6).alias("first_logit"))
