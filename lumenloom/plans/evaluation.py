"""Evaluation queries over the driver's tables: orders as cases, flags and suppliers as conditions, prices as costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenloom.functions import scalars as S
from lumenloom.operators import judging as J
from lumenloom.operators import statistics as A
from lumenloom.operators import transcripts as E
from lumenloom.plans.registry import Registry
from lumenloom.session import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items as judge results: discount at most 8 % is the gate, quantity on [1, 50] the score."""
    return table(spark, d, "lineitem").withColumn("cond", F.concat("l_returnflag", F.lit("/"), "l_linestatus"))


def _union(df: DataFrame, keys: list[str], parts: list[tuple[str, str, Column]]) -> DataFrame:
    """Long judge results of a wide table, in one pass."""
    rows = [F.struct(F.lit(name).alias("judge"), *J.tagged(kind, value)) for name, kind, value in parts]
    return df.select(*keys, F.inline(F.array(*rows)))


_CASES = """
with j as (select l_orderkey as case_id, concat(l_returnflag, '/', l_linestatus) as cond, l_discount <= 0.08 as gate,
                  least(1.0, greatest(0.0, (l_quantity - 1.0) / 49.0)) as norm, l_extendedprice as cost from lineitem),
per_case as (select cond, case_id, case when bool_and(gate) then avg(norm) else 0.0 end as reward, sum(cost) as cost from j group by cond, case_id)
"""


def _rewards(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d)
    results = _union(rows, ["cond", F.col("l_orderkey").alias("case_id"), "l_extendedprice"], [("gate", "bool", F.col("l_discount") <= 0.08), ("score", "num", F.col("l_quantity"))])
    costs = results.groupBy("cond", "case_id").agg(F.sum(F.when(F.col("judge") == "score", F.col("l_extendedprice"))).alias("cost"))
    # both aggregates are over the same groups of the same rows, so the join reuses their exchange
    return J.compose_reward(results, "cond", "case_id", low=1.0, high=50.0).join(costs, ["cond", "case_id"])


@query(_CASES + """, summ as (select cond, avg(reward) as mean, coalesce(stddev_samp(reward), 0.0) as std, count(*) as n, avg(cost) as cost from per_case group by cond)
select a.cond, round(a.mean, 6) as mean, round(a.std, 6) as std, round(a.cost, 2) as cost, a.n,
  not exists (select 1 from summ b where b.cost <= a.cost and b.mean >= a.mean and (b.cost < a.cost or b.mean > a.mean)) as on_frontier from summ a""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Rewards of cases, their replications by condition, and the frontier of cost and quality."""
    cases = _rewards(spark, d)
    summary = J.replications(cases, "reward", "cond").join(cases.groupBy("cond").agg(F.avg("cost").alias("cost")), "cond")
    return J.frontier(summary, "cost", "mean").select("cond", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("cost", 2).alias("cost"), "n", "on_frontier")


@query(_CASES + "select cond, case_id, round(reward, 9) as reward from per_case")
def reward_composed(spark: SparkSession, d: str) -> DataFrame:
    return _rewards(spark, d).select("cond", "case_id", F.round("reward", 9).alias("reward"))


@query("""select l_suppkey, round(case when bool_and(l_discount <= 0.09) then least(1.0, greatest(0.0,
  (sum(2.0 * least(1.0, greatest(0.0, (l_quantity - 1) / 49.0))) + sum(1.0 * least(1.0, greatest(0.0, (l_tax * 500 - 1) / 49.0)))) / (3.0 * count(*)))) else 0.0 end, 9) as reward
  from lineitem group by 1""")
def reward_weighted(spark: SparkSession, d: str) -> DataFrame:
    results = _union(table(spark, d, "lineitem"), ["l_suppkey"], [("gate", "bool", F.col("l_discount") <= 0.09), ("quantity", "num", F.col("l_quantity")), ("tax", "num", F.col("l_tax") * 500)])
    return J.weighted_reward(results, {"quantity": 2.0, "tax": 1.0}, "l_suppkey", low=1.0, high=50.0).select("l_suppkey", F.round("reward", 9).alias("reward"))


@query("""select l_orderkey, l_linenumber, round(case when l_discount > 0.08 then 0.0 else greatest(0.0, least(1.0, case when l_tax = 0 then 0.0
  when l_quantity > 25 then (l_quantity / 50.0) / (l_tax * 100) else least(l_quantity / 50.0, 0.5) end)) end, 9) as reward from lineitem""")
def reward_formula(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"), "l_discount")
    value = J.formula_reward(wide, "0 if t == 0 else ((q / 50) / (t * 100) if q > 25 else min(q / 50, 0.5))", ["q", "t"], F.col("l_discount") <= 0.08)
    return wide.select("l_orderkey", "l_linenumber", F.round(value, 9).alias("reward"))


@query("""select l_orderkey, round(case when not bool_and(l_returnflag <> 'R') then 0.0 else (sum(l_linenumber * least(1.0, greatest(0.0, l_quantity / 50.0))) / sum(l_linenumber))
  * avg((l_linestatus = 'F')::int) end, 9) as composite from lineitem group by 1""")
def reward_composite(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    parts = [
        F.struct(*J.tagged("num", F.col("l_quantity")), F.lit(False).alias("gate"), F.col("l_linenumber").cast("double").alias("weight")),
        F.struct(*J.tagged("bool", F.col("l_returnflag") != "R"), F.lit(True).alias("gate"), F.lit(1.0).alias("weight")),
        F.struct(*J.tagged("bool", F.col("l_linestatus") == "F"), F.lit(False).alias("gate"), F.lit(1.0).alias("weight")),
    ]
    return J.composite(rows.select("l_orderkey", F.inline(F.array(*parts))), "l_orderkey", low=0.0, high=50.0).select("l_orderkey", F.round("composite", 9).alias("composite"))


@query("""select l_shipmode_like as judge, round(avg(v), 9) as mean, null::double as pass_rate, count(v) as scored_cases, count(*) - count(v) as errored_cases
  from (select concat('q', l_linenumber) as l_shipmode_like, case when l_quantity between 5 and 45 then l_quantity end as v from lineitem) group by 1
  union all select 'late', round(avg((l_discount > 0.05)::int), 9), round(avg((l_discount > 0.05)::int), 9), count(*), 0 from lineitem""")
def judge_aggregate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    numbers = rows.select(F.concat(F.lit("q"), "l_linenumber").alias("judge"), *J.tagged("num", F.col("l_quantity")), F.lit(5.0).alias("low"), F.lit(45.0).alias("high"))
    flags = rows.select(F.lit("late").alias("judge"), *J.tagged("bool", F.col("l_discount") > 0.05))
    both = J.enforce_bounds(numbers).drop("low", "high").unionByName(flags)
    return J.judge_aggregate(both).select("judge", F.round("mean", 9).alias("mean"), F.round("pass_rate", 9).alias("pass_rate"), "scored_cases", "errored_cases")


@query("""select l_orderkey, count(*) as samples, quantile_disc(l_quantity, 0.5) as value_num, min(l_quantity) as lowest, max(l_quantity) as highest,
  round(avg(l_quantity), 2) as mean, count(distinct l_quantity) = 1 as stable from lineitem group by 1""")
def sample_reduce(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *J.tagged("num", F.col("l_quantity")))
    return J.reduce_samples(samples, "l_orderkey", order="l_linenumber").select("l_orderkey", "samples", "value_num", "lowest", "highest", "mean", "stable")


@query("""select l_orderkey, count(*) as samples, count(*) filter (l_discount <= 0.05) * 2 > count(*) as value_bool, count(distinct l_discount <= 0.05) = 1 as stable from lineitem group by 1""")
def sample_majority(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *J.tagged("bool", F.col("l_discount") <= 0.05))
    return J.reduce_samples(samples, "l_orderkey", order="l_linenumber").select("l_orderkey", "samples", "value_bool", "stable")


@query("""with r as (select l_suppkey, l_orderkey, count(distinct l_discount <= 0.05) = 1 as stable, count(*) as samples from lineitem group by 1, 2)
select l_suppkey, count(*) filter (stable) as stable_cases, count(*) as total_cases, max(samples) as samples from r group by 1""")
def sample_stability(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", *J.tagged("bool", F.col("l_discount") <= 0.05))
    return J.stability(J.reduce_samples(samples, "l_suppkey", "l_orderkey", order="l_linenumber"), "l_suppkey")


@query("""with a as (select concat('s', l_suppkey % 20) as judge, avg(l_quantity) as mean, null::double as pass_rate, 0.0 as err from lineitem group by 1),
t(judge, rule, bound) as (values ('s1', 'min_mean', 25.4), ('s2', 'min_mean', 25.6), ('s3', 'min_pass_rate', 0.5), ('s4', 'max_error_rate', 0.1), ('s5', 'min_win_rate', 0.5), ('s99', 'min_mean', 1.0))
select judge, rule, bound::double as bound, round(v, 9) as value from (select *, case rule when 'min_mean' then mean when 'min_pass_rate' then pass_rate when 'max_error_rate' then err end as v from a join t using (judge))
where v is null or case when rule like 'max%' then v > bound else v < bound end""")
def regressions(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "lineitem").select(F.concat(F.lit("s"), (F.col("l_suppkey") % 20).cast("string")).alias("judge"), *J.tagged("num", F.col("l_quantity")))
    bounds = [("s1", "min_mean", 25.4), ("s2", "min_mean", 25.6), ("s3", "min_pass_rate", 0.5), ("s4", "max_error_rate", 0.1), ("s5", "min_win_rate", 0.5), ("s99", "min_mean", 1.0)]
    thresholds = spark.createDataFrame(bounds, "judge string, rule string, bound double")
    return J.regressions(J.judge_aggregate(results), thresholds).select("judge", "rule", "bound", F.round("value", 9).alias("value"))


_PAIRS = """with o as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderkey) as n from orders),
p as (select a.o_custkey as case_id, case when a.o_totalprice > b.o_totalprice * 1.02 then 'A' when a.o_totalprice < b.o_totalprice then 'B' end as ab,
  case when b.o_totalprice > a.o_totalprice * 1.02 then 'A' else 'B' end as ba from o a left join o b on a.o_custkey = b.o_custkey and b.n = 2 where a.n = 1),
w as (select case_id, case when ab is null or ba is null then 'error' when ab = 'A' and ba = 'B' then 'A' when ab = 'B' and ba = 'A' then 'B' else 'tie' end as winner from p)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    a = orders.filter("n = 1").select(F.col("o_custkey").alias("case_id"), F.col("o_totalprice").alias("a"))
    b = orders.filter("n = 2").select(F.col("o_custkey").alias("case_id"), F.col("o_totalprice").alias("b"))
    both = a.join(b, "case_id", "left")
    ab = F.when(F.col("a") > F.col("b") * 1.02, "A").when(F.col("a") < F.col("b"), "B")
    ba = F.when(F.col("b") > F.col("a") * 1.02, "A").otherwise("B")
    return both.select("case_id", J.winner(ab, ba).alias("winner"))


@query(_PAIRS + " select case_id, winner from w")
def pairwise(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


@query(_PAIRS + " select count(*) as cases_compared, count(*) filter (winner = 'A') as wins_a, count(*) filter (winner = 'B') as wins_b, count(*) filter (winner = 'tie') as ties, count(*) filter (winner = 'error') as errors from w")
def pairwise_tally(spark: SparkSession, d: str) -> DataFrame:
    return J.pairwise_tally(_pairs(spark, d))


@query("""with v as (select l_orderkey as c, l_returnflag as winner, count(*) as n, min(l_linenumber) as seen from lineitem group by 1, 2)
select c as case_id, count(*) = 1 as stable, arg_min(winner, (-n, seen, winner)) as majority, sum(n)::bigint as runs from v group by 1""")
def pairwise_stability(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("winner"), "l_linenumber")
    return J.pairwise_stability(runs, "case_id", "l_linenumber")


_CELLS = "with c as (select c_nationkey as s, o_orderpriority as f, avg(o_totalprice) as y from orders join customer on o_custkey = c_custkey group by 1, 2), "


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))


@query(_CELLS + """w as (select *, avg(y) over () as g, avg(y) over (partition by f) as ml, avg(y) over (partition by s) as ms, (select count(distinct f) from c) as k, (select count(distinct s) from c) as n from c)
select round((sum((ml - g) ^ 2) / (any_value(k) - 1)) / (sum((y - ml - ms + g) ^ 2) / ((any_value(n) - 1) * (any_value(k) - 1))), 6) as f, (any_value(k) - 1)::double as df1, ((any_value(n) - 1) * (any_value(k) - 1))::double as df2 from w""")
def anova_repeated(spark: SparkSession, d: str) -> DataFrame:
    return A.repeated_measures(_cells(spark, d), "c_nationkey", "o_orderpriority", "o_totalprice").select(F.round("f", 6).alias("f"), "df1", "df2")


@query()
def anova_probability(spark: SparkSession, d: str) -> DataFrame:
    """With its p value, for which SQL has no function; tested against published F tables."""
    out = A.repeated_measures(_cells(spark, d), "c_nationkey", "o_orderpriority", "o_totalprice")
    return out.select("f", "df1", "df2", A.f_probability("f", "df1", "df2").alias("p_value"))


@query("""with g as (select o_orderpriority, count(*) as n, avg(o_totalprice) as m, var_pop(o_totalprice) as v from orders group by 1)
select round(((sum(n * m * m) - sum(n * m) ^ 2 / sum(n)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 6) as f, (count(*) - 1)::double as df1, (sum(n) - count(*))::double as df2 from g""")
def anova_one_way(spark: SparkSession, d: str) -> DataFrame:
    return A.one_way(table(spark, d, "orders"), "o_orderpriority", "o_totalprice").select(F.round("f", 6).alias("f"), "df1", "df2")


@query()
def anova_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Random-intercept REML fit of two factors; no SQL, tested against simulated effects."""
    return A.mixed_effects(_cells(spark, d), "c_nationkey", ["o_orderpriority", "o_orderstatus"], "o_totalprice")


@query("select user_id, count(*) as n from events where user_id in (select user_id from events group by 1 having count(distinct event_type) = (select count(distinct event_type) from events)) group by 1")
def common_cases(spark: SparkSession, d: str) -> DataFrame:
    return A.common_cases(table(spark, d, "events"), "user_id", "event_type").groupBy("user_id").agg(F.count("*").alias("n"))


_LEVELS = {"flag": ["A", "N", "R"], "mode": ["fast", "slow"], "status": ["F", "O"]}


@query("""select (row_number() over (order by flag, mode, status)) - 1 as position, flag, mode, status,
  left(sha256('{"flag": "' || flag || '", "mode": "' || mode || '", "status": "' || status || '"}'), 12) as condition_id
  from (values ('A'), ('N'), ('R')) f(flag), (values ('fast'), ('slow')) m(mode), (values ('F'), ('O')) s(status)""")
def design_factorial(spark: SparkSession, d: str) -> DataFrame:
    return A.full_factorial(spark, _LEVELS)


@query("""select n_nationkey, left(sha256('{"nation": "' || n_name || '", "region": "' || n_regionkey || '"}'), 12) as condition_id from nation""")
def condition_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", S.condition_id({"region": F.col("n_regionkey").cast("string"), "nation": F.col("n_name")}).alias("condition_id"))


@query("select o_custkey, o_orderkey, (row_number() over (partition by o_custkey order by o_orderkey)) - 1 as replication from orders")
def replication(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return orders.select("o_custkey", "o_orderkey", A.replication_number(orders, "o_custkey", "o_orderkey").alias("replication"))


@query("""with a as (select s_nationkey as model, avg(l_quantity) as q, avg(l_discount) as di, avg(l_tax) as t, min(l_extendedprice) as lo, max(l_extendedprice) as hi, count(*) as n from lineitem join supplier on l_suppkey = s_suppkey group by 1)
select model, round(q, 6) as quantity, round(di, 6) as discount, round(t, 6) as tax, lo as cheapest, hi as dearest, n from a""")
def model_compare(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("model"))
        .agg(F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.avg("l_tax"), 6).alias("tax"), F.min("l_extendedprice").alias("cheapest"), F.max("l_extendedprice").alias("dearest"), F.count("*").alias("n"))
    )


@query("""with m as (select judge, model, avg(v) as mean from (select s_nationkey as model, unnest(['quantity', 'discount', 'tax', 'price', 'line']) as judge, unnest([l_quantity, l_discount, l_tax, l_extendedprice, l_linenumber]) as v
  from lineitem join supplier on l_suppkey = s_suppkey) group by 1, 2)
select judge, round(max(mean) - min(mean), 6) as spread from m group by 1 order by max(mean) - min(mean) desc, judge limit 4""")
def card_judges(spark: SparkSession, d: str) -> DataFrame:
    """The four judges whose model means differ most: a top-k report, the limit is the feature."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    long = rows.select(
        F.col("s_nationkey").alias("model"),
        F.expr("stack(5, 'quantity', l_quantity, 'discount', l_discount, 'tax', l_tax, 'price', l_extendedprice, 'line', double(l_linenumber)) as (judge, v)"),
    )
    means = long.groupBy("judge", "model").agg(F.avg("v").alias("mean")).groupBy("judge").agg((F.max("mean") - F.min("mean")).alias("s"))
    return means.orderBy(F.desc("s"), "judge").limit(4).select("judge", F.round("s", 6).alias("spread"))


@query("""select o_orderpriority as case_id, round(avg(o_totalprice) filter (o_orderstatus = 'F'), 4) as "F", round(avg(o_totalprice) filter (o_orderstatus = 'O'), 4) as "O", round(avg(o_totalprice) filter (o_orderstatus = 'P'), 4) as "P" from orders group by 1""")
def case_pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("case_id")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 4))


@query("""with s as (select l_orderkey, l_linenumber, l_extendedprice as cost, l_quantity as tokens, case l_linestatus when 'F' then 0 else l_linenumber end as code from lineitem),
c as (select l_orderkey as k, sum(tokens) as tokens, round(sum(cost), 4) as cost, coalesce(arg_min(code, l_linenumber) filter (code <> 0), 0) as exit_code from s group by 1)
select o_custkey as run, sum(tokens) as tokens, round(sum(cost), 2) as cost, max(exit_code) as worst, count(*) as cases from c join orders on k = o_orderkey group by 1""")
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Steps to cases to runs: sums, the first exit code that is not 0 of a case, the worst of a run."""
    code = F.when(F.col("l_linestatus") == "F", 0).otherwise(F.col("l_linenumber"))
    cases = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("tokens"), F.round(F.sum("l_extendedprice"), 4).alias("cost"),
        F.coalesce(F.min_by(F.when(code != 0, code), F.when(code != 0, F.col("l_linenumber"))), F.lit(0)).alias("exit_code"),
    )
    runs = cases.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("run"))
    return runs.agg(F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 2).alias("cost"), F.max("exit_code").alias("worst"), F.count("*").alias("cases"))


@query("""select l_orderkey, round(cost / turns, 6) as cost_per_turn, round(tout / turns, 2) as output_per_turn, round(cache / nullif(tin + cache + made, 0), 6) as cache_hit_rate, round(cost * 1e6 / nullif(tin + cache + made + tout, 0), 4) as cost_per_mtok
  from (select l_orderkey, sum(l_tax) as cost, count(*) as turns, sum(l_extendedprice) as tin, sum(l_quantity) as tout, sum(l_discount) as cache, sum(l_linenumber) as made from lineitem group by 1)""")
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_tax").alias("cost"), F.count("*").alias("turns"), F.sum("l_extendedprice").alias("tin"), F.sum("l_quantity").alias("tout"), F.sum("l_discount").alias("cache"), F.sum("l_linenumber").alias("made"))
    return E.run_metrics(runs, "cost", "turns", "tin", "tout", "cache", "made").select("l_orderkey", "cost_per_turn", "output_per_turn", "cache_hit_rate", "cost_per_mtok")


@query("""with c as (select l_suppkey as model, sum(l_extendedprice) as cost from lineitem group by 1)
select l_orderkey, l_linenumber, round(cost / count(*) over (partition by l_suppkey), 4) as span_cost from lineitem join c on l_suppkey = model""")
def span_cost(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "model")
    costs = lines.groupBy("model").agg(F.sum("l_extendedprice").alias("cost"))
    return E.apportion(lines.select("l_orderkey", "l_linenumber", "model"), costs, "model", "cost").select("l_orderkey", "l_linenumber", F.round("span_cost", 4).alias("span_cost"))


@query("""select c_custkey, case when m > coalesce(c, 0) + 0.01 then m else c end as billed from (select c_custkey, nullif(c_acctbal, 0) as c, sum(o_totalprice) / 100 as m from customer left join orders on c_custkey = o_custkey group by 1, 2)""")
def billed_cost(spark: SparkSession, d: str) -> DataFrame:
    models = table(spark, d, "orders").groupBy("o_custkey").agg((F.sum("o_totalprice") / 100).alias("m"))
    both = table(spark, d, "customer").join(models, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.select("c_custkey", S.billed_cost(F.nullif("c_acctbal", F.lit(0.0)), F.col("m")).alias("billed"))


@query("""with b as (select s_suppkey, (s_suppkey % 7) as size, coalesce(sum(s_suppkey % 7) over (order by s_suppkey rows between unbounded preceding and 1 preceding), 0) as st from supplier)
select p_partkey, s_suppkey from part join b on p_partkey >= st and p_partkey < st + size""")
def routing(spark: SparkSession, d: str) -> DataFrame:
    batches = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 7).alias("size"))
    return E.route(table(spark, d, "part").select("p_partkey"), batches, "p_partkey", "s_suppkey", "size").select("p_partkey", "s_suppkey")


@query("""with h as (select ceil(p_size / 5.0)::int as bin, count(*) as n from part group by 1)
select b.bin, coalesce(n, 0) as n, round_even(coalesce(n, 0) / (max(n) over ())::double * 7, 0)::int as level from (select unnest(range(0, 13)) as bin) b left join h using (bin)""")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "part").groupBy(F.ceil(F.col("p_size") / 5.0).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    axis = spark.range(13).select(F.col("id").cast("int").alias("bin"))
    top = F.max("n").over(Window.partitionBy(F.lit(0)))
    return axis.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.bround(F.coalesce("n", F.lit(0)) / top * 7).cast("int").alias("level"))


@query("""select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug, trim(regexp_replace(p_type, '[^\\p{L}\\p{N}._-]', '_', 'g'), '_') as segment,
  case when p_size < 0 or p_size > 50 then 'fail' when p_size / 50.0 >= 0.75 then 'pass' when p_size / 50.0 >= 0.375 then 'warn' else 'fail' end as band,
  case when p_retailprice / 10000 < 0.06 then 'small' when p_retailprice / 10000 < 0.14 then 'medium' else 'large' end as effect from part""")
def labels(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.select("p_partkey", S.slug(F.col("p_name")).alias("slug"), S.safe_segment(F.col("p_type")).alias("segment"), S.score_band(F.col("p_size"), 0, 50).alias("band"), S.effect_band(F.col("p_retailprice") / 10000).alias("effect"))


@query("select event_id, try_cast(json_extract(props, '$.k') as int) as k from events")
def props_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query("""with b as (select *, coalesce(event_type <> lag(event_type) over w, true) as cut from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(cut::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as segment from b)
select user_id, segment::bigint as segment, any_value(event_type) as event_type, count(*) as n, round(sum(value), 6) as value from s group by 1, 2""")
def batch_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = rows.withColumn("cut", F.coalesce(F.col("event_type") != F.lag("event_type").over(w), F.lit(True)))
    return E.segments(rows, ["user_id"], ["ts", "event_id"], F.col("cut")).groupBy("user_id", "segment").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))
