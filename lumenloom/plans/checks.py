"""Queries of scoring, comparison, trials, analysis and usage over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions import scalars as S
from lumenloom.functions import verdicts as V
from lumenloom.operators import analysis, compare, scoring, trials
from lumenloom.operators import judging as J
from lumenloom.operators import reports as R
from lumenloom.operators import statistics as A
from lumenloom.operators import transcripts as E
from lumenloom.plans.registry import Registry
from lumenloom.session import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_O = r"""with o as (select * from (select line_id, run_id, case_id, case when json_valid(trim(line, e' \t\n\r')) then trim(line, e' \t\n\r') end as j from transcript_lines) where json_type(j) = 'OBJECT') """


# scoring ----------------------------------------------------------------------------------------------------


def _registry() -> scoring.Registry:
    registry = scoring.Registry()
    registry.add(scoring.Judge("cheap", "builtin", value=scoring.cost_budget(30_000.0, "l_extendedprice"), feedback="bool"))
    registry.add(scoring.Judge("quantity", "check", value=lambda: F.col("l_quantity"), scale=(1.0, 45.0)))
    registry.add(scoring.Judge("late", "check", value=lambda: F.col("l_returnflag") == "R", feedback="bool", condition="l_discount > 0.05", condition_columns=("l_discount",)))
    return registry


def _scored(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumn("case_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.round(F.col("l_extendedprice") * 100).cast("bigint")))
    return scoring.score_cases(lines, _registry())


@query("""with j as (
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::int, round(l_extendedprice * 100)::bigint) as case_id, 'cheap' as judge, (l_extendedprice <= 30000)::int::double as v, null as error from lineitem union all
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::int, round(l_extendedprice * 100)::bigint), 'quantity', case when l_quantity between 1 and 45 then l_quantity end, case when l_quantity not between 1 and 45 then 'out of bounds' end from lineitem union all
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::int, round(l_extendedprice * 100)::bigint), 'late', case when l_discount > 0.05 then (l_returnflag = 'R')::int end, null from lineitem)
select case_id, judge, v as value, error from j""")
def score_cases(spark: SparkSession, d: str) -> DataFrame:
    """All judges over all cases: a builtin, a bounded number, and a flag behind a condition."""
    value = F.coalesce(F.col("value_num"), F.col("value_bool").cast("double"))
    return _scored(spark, d).select("case_id", "judge", value.alias("value"), "error")


@query("""select 'cheap' as judge, round(avg((l_extendedprice <= 30000)::int), 9) as mean, round(avg((l_extendedprice <= 30000)::int), 9) as pass_rate, count(*) as scored_cases, 0 as errored_cases from lineitem union all
select 'quantity', round(avg(l_quantity) filter (l_quantity between 1 and 45), 9), null, count(*) filter (l_quantity between 1 and 45), count(*) filter (l_quantity not between 1 and 45) from lineitem union all
select 'late', round(avg((l_returnflag = 'R')::int) filter (l_discount > 0.05), 9), round(avg((l_returnflag = 'R')::int) filter (l_discount > 0.05), 9), count(*) filter (l_discount > 0.05), 0 from lineitem""")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    """The four forms of aggregates of scored cases."""
    out = scoring.summary(_scored(spark, d))
    return out.select("judge", F.round("mean", 9).alias("mean"), F.round("pass_rate", 9).alias("pass_rate"), "scored_cases", "errored_cases")


_STUB = """with s as (select o_orderkey, unnest(range(0, 3)) as sample from orders),
r as (select o_orderkey, sample, case when (o_orderkey + sample) % 11 = 0 then null else least(5, 1 + (o_orderkey * 7 + sample) % 6) end as raw, (o_orderkey * 7 + sample) % 6 = 5 as off from s),
v as (select o_orderkey, sample, case when not off then raw end as v from r)"""


@query(_STUB + """ select o_orderkey::varchar as case_id, 3::bigint as samples, count(*) - count(v) as errors, case when count(v) > 0 then quantile_disc(v, 0.5)::double end as value, count(v) = 3 and min(v) = max(v) as stable from v group by 1""")
def score_samples(spark: SparkSession, d: str) -> DataFrame:
    """Three samples of a judge with a client, here a stub that fails, leaves the scale, or answers in JSON."""

    def client(prompt: str) -> str:
        key, sample = map(int, prompt.split("/"))
        if (key + sample) % 11 == 0:
            raise RuntimeError("client failed")
        points = 1 + (key * 7 + sample) % 6
        return f'Here it is: {{"score": {points}, "rationale": "counted"}}'

    judge = scoring.Judge("stub", "llm", prompt=lambda: F.concat_ws("/", "case_id", "sample"), client=client, scale=(1.0, 5.0), samples=3)
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"))
    out = scoring.reduced(scoring.score_cases(cases, scoring.Registry().add(judge)))
    return out.select("case_id", "samples", "errors", F.col("value_num").alias("value"), "stable")


@query("""with r as (select l_suppkey, l_linenumber, l_quantity, l_discount <= 0.08 as ok, l_tax from lineitem where l_linenumber <= 3),
w as (select l_suppkey, max(case when l_linenumber = 1 then least(1, greatest(0, (q - 1) / 49)) end) as j1, max(case when l_linenumber = 2 then least(1, greatest(0, q / 50)) end) as j2
  from (select l_suppkey, l_linenumber, avg(l_quantity) as q from r group by 1, 2) group by 1)
select l_suppkey, round(coalesce(greatest(0, least(1, (j1 + j2) / 2 * case when least(j1, j2) > 0.3 then 1 else 0.5 end)), 0), 9) as formula, round(coalesce(j1, 0), 9) as single from w""")
def reward_configured(spark: SparkSession, d: str) -> DataFrame:
    """A formula with a named part over judges with scales of their own, and a single judge on its scale."""
    means = table(spark, d, "lineitem").filter("l_linenumber <= 3").groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_quantity").alias("q"))
    rows = means.select("l_suppkey", F.concat(F.lit("j"), "l_linenumber").alias("judge"), *J.tagged("num", F.col("q")))
    ranges = {"j1": (1.0, 50.0), "j2": (0.0, 50.0)}
    formula = "part = 1 if min(j1, j2) > 0.3 else 0.5\nmean([j1, j2]) * part"
    a = J.configured_reward(rows, "l_suppkey", formula=formula, ranges=ranges).select("l_suppkey", F.round("reward", 9).alias("formula"))
    b = J.configured_reward(rows, "l_suppkey", judge="j1", ranges=ranges, normalise_judge=True).select("l_suppkey", F.round("reward", 9).alias("single"))
    return a.join(b, "l_suppkey")


@query("""select l_suppkey, round(avg(l_quantity), 6) as q, avg((l_discount > 0.05)::int) > 0.5 as flag from lineitem group by 1""")
def metric_maps(spark: SparkSession, d: str) -> DataFrame:
    """Map of judge to number for each case, read back."""
    by = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_quantity"), 6).alias("q"), (F.avg((F.col("l_discount") > 0.05).cast("int")) > 0.5).alias("f"))
    rows = by.select("l_suppkey", F.inline(F.array(F.struct(F.lit("q").alias("judge"), *J.tagged("num", F.col("q"))), F.struct(F.lit("f").alias("judge"), *J.tagged("bool", F.col("f"))), F.struct(F.lit("s").alias("judge"), *J.tagged("str", F.lit("x"))))))
    return J.metric_map(rows, "l_suppkey").filter(F.size("metrics") == 2).select("l_suppkey", F.col("metrics")["q"].alias("q"), (F.col("metrics")["f"] == 1).alias("flag"))


@query("""select concat('s', l_suppkey) as judge, count(*) filter (l_discount > 0.1 and l_quantity < 3) = 0 as failed_every_case from lineitem group by 1""")
def judges_never_passed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("judge"), *J.tagged("bool", (F.col("l_discount") > 0.1) & (F.col("l_quantity") < 3)))
    return J.never_passed(rows)


@query("""with k(judge, judge_type, builtin) as (values ('a', 'llm', null), ('b', 'check', null), ('c', 'builtin', 'x'), ('d', 'builtin', 'y'), ('e', 'builtin', 'gone'), ('f', 'agent', null), ('g', 'code', null)), b(builtin, kind) as (values ('x', 'llm'), ('y', 'code'))
select judge from k left join b using (builtin) where judge_type not in ('llm', 'agent') and (judge_type <> 'builtin' or coalesce(kind <> 'llm', false))""")
def judges_without_models(spark: SparkSession, d: str) -> DataFrame:
    judges = spark.createDataFrame([("a", "llm", None), ("b", "check", None), ("c", "builtin", "x"), ("d", "builtin", "y"), ("e", "builtin", "gone"), ("f", "agent", None), ("g", "code", None)], "judge string, judge_type string, builtin string")
    return J.without_model_calls(judges, spark.createDataFrame([("x", "llm"), ("y", "code")], "builtin string, kind string")).select("judge")


@query("""with v as (select l_orderkey as c, l_linenumber as run, l_returnflag as w from lineitem where l_linenumber <= 3), f as (select c from v where run = 1),
s as (select c, count(distinct w) = 1 as stable from v semi join f using (c) group by 1)
select (select count(distinct run) from v) as runs, (select count(*) from s) as total_cases, (select count(*) from s where stable) as stable_cases, round((select avg(stable::int) from s), 9) as agreement_rate,
  (select string_agg(n, ',' order by run) from (select run, count(*) filter (w = 'A') as n from v group by 1)) as wins""")
def pairwise_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of repeated comparisons over the cases of the first run, with the wins of each run."""
    rows = table(spark, d, "lineitem").filter("l_linenumber <= 3").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("winner"))
    return J.agreement(rows, "l_orderkey", "l_linenumber").select("runs", "total_cases", "stable_cases", F.round("agreement_rate", 9).alias("agreement_rate"), F.array_join("wins_a_counts", ",").alias("wins"))


_RESPONSES = [
    ('{"score": #, "rationale": "read all \\\\"files\\\\""}', 1), ("Some prose first.\n```json\n{\"score\": #.4}\n```", 1), ("Overall rating: #, see item 4", 1), ("I give it # / 5 in the end, not 2", 1),
    ("7/10 files pass. #", 1), ("No number on the scale: 77 and v1.2x", 0), ("**#**/5 for this", 1), ('broken {"score": #', 1),
]


@query("""select o_orderkey, case when o_orderkey % 8 = 5 then null else (1 + o_custkey % 5)::double end as score, case when o_orderkey % 8 = 0 then 'read all "files"' end as rationale from orders""")
def score_parse(spark: SparkSession, d: str) -> DataFrame:
    """Scores and reasons of responses in eight notations: JSON, fenced, named, a fraction, the last number on the scale, none."""
    k, points = F.col("o_orderkey") % 8, (1 + F.col("o_custkey") % 5).cast("string")
    text = F.coalesce(*[F.when(k == n, F.replace(F.lit(form.replace("\\\\", "\\")), F.lit("#"), points)) for n, (form, _) in enumerate(_RESPONSES)])
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("text"))
    return rows.select("o_orderkey", V.score(F.col("text"), 1.0, 5.0).alias("score"), V.rationale(F.col("text")).alias("rationale"))


@query("""select o_orderkey, (case o_orderkey % 5 when 0 then 1.0 when 1 then 0.0 when 2 then 1.0 when 3 then 0.0 end)::double as flag, case o_orderkey % 5 when 0 then 1.0 when 1 then 0.0 when 2 then (o_custkey % 4 + 1)::double when 3 then 0.0 end as number from orders""")
def agent_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Values of the last verdict in the output of agents, for judges of flags and of whole numbers."""
    k = F.col("o_orderkey") % 5
    forms = ['{"passed": false} then {"passed": true, "rationale": "x"}', 'done {"score": 3} {"passed": false}', 'so {"score": #, "n": [1]} {"passed": oops}', '{"score": 0}', "nothing to parse"]
    text = F.coalesce(*[F.when(k == n, F.replace(F.lit(form), F.lit("#"), (F.col("o_custkey") % 4 + 1).cast("string"))) for n, form in enumerate(forms)])
    rows = table(spark, d, "orders").select("o_orderkey", V.last_verdict(text).alias("v"))
    return rows.select("o_orderkey", V.agent_value(F.col("v"), True).alias("flag"), V.agent_value(F.col("v"), False, True).alias("number"))


# comparison -------------------------------------------------------------------------------------------------


@query("""with s as (select l_linenumber as judge, l_partkey % 50 as case_id, s_nationkey as model, avg(l_quantity) as score from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2, 3)
select judge, case_id, model, round(score, 6) as score from s a where (select min(score) < max(score) from s b where a.judge = b.judge and a.case_id = b.case_id)""")
def case_differences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    results = rows.select(F.col("l_linenumber").alias("judge"), (F.col("l_partkey") % 50).alias("case_id"), F.col("s_nationkey").alias("model"), *J.tagged("num", F.col("l_quantity")))
    return compare.case_differences(results, "model").withColumn("score", F.round("score", 6))


@query("""with m as (select l_shipmode as model, avg(l_quantity) as q from (select l_suppkey % 13 as l_shipmode, l_quantity, l_returnflag from lineitem) where l_returnflag = 'R' group by 1)
select model, round(q, 9) as primary_mean, row_number() over (order by q desc, model) as place from m""")
def model_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 13).alias("model"), F.col("l_returnflag").alias("judge")).agg(F.avg("l_quantity").alias("mean")).withColumn("pass_rate", F.lit(None).cast("double"))
    return compare.model_order(rows, "model", "R").select("model", F.round("primary_mean", 9).alias("primary_mean"), "place")


@query("""with f as (select c_nationkey, c_custkey, c_acctbal from customer where c_acctbal is not null)
select c_nationkey, case when count(*) > 1 and min(c_acctbal) < max(c_acctbal) then arg_min(c_custkey, (-c_acctbal, c_custkey)) end as best, case when count(*) > 1 and min(c_acctbal) < max(c_acctbal) then arg_min(c_custkey, (c_acctbal, c_custkey)) end as worst from f group by 1""")
def best_worst(spark: SparkSession, d: str) -> DataFrame:
    return compare.best_and_worst(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal", "c_custkey")


@query(r"""with m as (select l_suppkey, count(*) as n, avg(l_extendedprice) as a, sum(l_quantity) as q, avg(l_discount) as di from lineitem group by 1)
select l_suppkey, format('${:t,.2f}', a) as usd, format('{:.1f}%', di * 100) as pct, format('{:t,}', floor(a)::bigint) as whole, case when q < 60 then floor(q)::bigint || 's' else floor(q / 60)::bigint || ' min' end as duration,
  case when a >= 1000000 then format('{:.1f}M', a / 1e6) when a >= 1000 then format('{:.1f}K', a / 1e3) else floor(a)::bigint::varchar end as tokens from m""".replace("{:t,.2f}", "{:,.2f}").replace("{:t,}", "{:,}"))
def number_texts(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("a"), F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("di"))
    return m.select("l_suppkey", S.text_of(F.col("a"), "usd").alias("usd"), S.text_of(F.col("di"), "pct").alias("pct"), S.text_of(F.col("a"), "int").alias("whole"), S.text_of(F.col("q"), "time").alias("duration"), S.text_of(F.col("a"), "tokens").alias("tokens"))


@query("""with c as (select r_name || '-' || n_nationkey as case_id from nation join region on n_regionkey = r_regionkey), f as (select r_name || '-' || (p_partkey % 30) || '-' || p_size || '.md' as name from part join region on p_partkey % 5 = r_regionkey)
select distinct case_id, name from c join f on starts_with(name, case_id)""")
def batch_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of a batch to the cases whose filled pattern begins their name."""
    region = table(spark, d, "region")
    cases = table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("-", "r_name", "n_nationkey").alias("case_id"))
    files = table(spark, d, "part").join(region, F.col("p_partkey") % 5 == F.col("r_regionkey")).select(F.concat(F.concat_ws("-", "r_name", F.col("p_partkey") % 30, "p_size"), F.lit(".md")).alias("name")).distinct()
    return compare.cases_by_prefix(files, cases, "{case}")


@query("""with e as (select doc_id, source, unnest(list_distinct(regexp_extract_all(regexp_replace(text, 'https?://\\S+', ' ', 'g'), '([a-z]+/[a-z_]+\\.(?:py|sh|json))', 1))) as target from documents where text is not null),
n as (select distinct target from e where target not like 's%'),
k as (select distinct replace(t.input_json ->> '$.file_path', '\\', '/') as name from (select unnest(tools) as t from flat_events) where json_valid(t.input_json) and t.input_json ->> '$.file_path' is not null)
select name from k where name not in (select target from n) and name not in (select regexp_extract(target, '[^:/]*$') from n)""")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Files that tools touched and no document refers to."""
    texts = table(spark, d, "documents").filter("text is not null").withColumn("key", F.col("doc_id").cast("string"))
    edges = R.references(texts, "key", "text", r"([a-z]+/[a-z_]+\.(?:py|sh|json))").filter("target not like 's%'")
    tools = table(spark, d, "flat_events").select(F.explode("tools").alias("t"))
    known = tools.select(F.replace(F.try_variant_get(F.try_parse_json("t.input_json"), "$.file_path", "string"), F.lit("\\"), F.lit("/")).alias("name")).filter("name is not null").distinct()
    return R.orphans(known, "name", edges)


# trials -----------------------------------------------------------------------------------------------------


@query("""with s as (select l_orderkey as trial, l_linenumber as step, case when l_quantity > 5 then l_discount * 10 end as reward, l_returnflag = 'A' as unjudged, case when l_quantity > 48 then 0.5 end as engine, l_tax as cost, (l_quantity)::bigint as turns from lineitem)
select trial, round(coalesce(arg_max(engine, step) filter (engine is not null), avg(reward) filter (not unjudged)), 9) as reward, count(*) as steps, count(reward) filter (not unjudged) as verified_steps,
  coalesce(string_agg(step, ',' order by step) filter (reward is null and not unjudged), '') as infra, coalesce(string_agg(step, ',' order by step) filter (unjudged), '') as unjudged, round(sum(cost), 6) as cost_usd, nullif(sum(turns), 0)::bigint as num_turns from s group by 1""")
def trial_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps rolled up to trials."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("trial"), F.col("l_linenumber").alias("step"), F.when(F.col("l_quantity") > 5, F.col("l_discount") * 10).alias("reward"), (F.col("l_returnflag") == "A").alias("unjudged"),
        F.when(F.col("l_quantity") > 48, 0.5).alias("engine_reward"), F.col("l_tax").alias("cost_usd"), F.col("l_quantity").cast("bigint").alias("num_turns"), F.lit(None).cast("double").alias("duration_s"), F.lit(None).cast("bigint").alias("tokens"),
    )
    out = trials.step_rollup(rows, "trial", "step")
    return out.select("trial", F.round("reward", 9).alias("reward"), "steps", "verified_steps", F.array_join("infra_error_steps", ",").alias("infra"), F.array_join("unjudged_steps", ",").alias("unjudged"), F.round("cost_usd", 6).alias("cost_usd"), "num_turns")


@query("""with t as (select o_custkey as case_id, o_orderkey as trial, o_orderpriority as judge, o_totalprice as v from orders), l as (select case_id, max(trial) as trial from t group by 1)
select case_id, judge, v as value from t semi join l on t.case_id = l.case_id and t.trial = l.trial""")
def trial_cases(spark: SparkSession, d: str) -> DataFrame:
    """Of cases that were tried again, the results of the last trial."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("trial"), F.col("o_orderpriority").alias("judge"), F.col("o_totalprice").alias("value"))
    return trials.per_case(rows, "trial").select("case_id", "judge", "value")


@query("""select o_custkey as run, arg_max(code, (abs(code), code)) as exit_code, nullif(round(sum(c), 2), 0) as cost_usd, nullif(sum(n), 0)::bigint as num_turns from (
  select o_custkey, (o_orderkey % 7 - 1)::int * 3 + (o_orderkey % 7)::int as code, case when o_orderkey % 2 = 0 then o_totalprice end as c, o_orderkey % 3 as n from orders) group by 1""")
def run_overall(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_custkey", ((k % 7 - 1).cast("int") * 3 + (k % 7).cast("int")).alias("exit_code"), F.when(k % 2 == 0, F.col("o_totalprice")).alias("cost_usd"), (k % 3).alias("num_turns"))
    out = trials.overall(rows, "o_custkey")
    return out.select(F.col("o_custkey").alias("run"), "exit_code", F.round("cost_usd", 2).alias("cost_usd"), "num_turns")


# analysis ---------------------------------------------------------------------------------------------------


def _experiment(spark: SparkSession, d: str) -> DataFrame:
    """Orders as replications: customers' nations as cases, priorities as the factor."""
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.select(F.col("c_nationkey").alias("case_id"), F.col("o_orderpriority").alias("condition_id"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("composite"), F.col("o_shippriority").alias("cost") if "o_shippriority" in both.columns else F.lit(1).alias("cost"))


_E = "with e as (select c_nationkey as case_id, o_orderpriority as condition_id, o_totalprice as composite from orders join customer on o_custkey = c_custkey) "


@query(_E + """select condition_id, round(avg(composite), 4) as mean, round(coalesce(stddev_samp(composite), 0), 4) as std, min(composite) as min, max(composite) as max, count(*) as n, true as on_frontier from e
where case_id in (select case_id from e group by 1 having count(distinct condition_id) = (select count(distinct condition_id) from e)) group by 1""")
def analysis_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summaries by condition of the whole analysis; no costs are known, so all are on the frontier."""
    out = analysis.analyse(_experiment(spark, d), ["priority"]).summaries
    return out.select("condition_id", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max", "n", "on_frontier")


@query(_E + """select condition_id as condition, case_id::varchar as case_id, round(avg(composite), 4) as mean from e
where case_id in (select case_id from e group by 1 having count(distinct condition_id) = (select count(distinct condition_id) from e)) group by 1, 2""")
def analysis_cases(spark: SparkSession, d: str) -> DataFrame:
    return analysis.analyse(_experiment(spark, d), ["priority"]).per_case.withColumn("mean", F.round("mean", 4))


@query(_E + """select (select string_agg(condition_id, ',' order by condition_id) from (select distinct condition_id from e)) as levels, count(distinct case_id) as n_cases, (select max(n) from (select count(*) as n from e group by condition_id, case_id)) as replications from e""")
def analysis_design(spark: SparkSession, d: str) -> DataFrame:
    out = analysis.design(_experiment(spark, d), ["priority"])
    return out.select(F.array_join("priority", ",").alias("levels"), "n_cases", "replications")


@query(_E + """, c as (select case_id, condition_id, avg(composite) as y from e group by 1, 2), f as (select * from c where case_id in (select case_id from c group by 1 having count(*) = (select count(distinct condition_id) from c))),
d as (select case_id, condition_id, y - avg(y) over (partition by condition_id) as x from f),
v as (select a.condition_id as i, b.condition_id as j, sum(a.x * b.x) as s from d a join d b using (case_id) group by 1, 2),
r as (select i, avg(s) as m, sum(s) filter (i = j) as dg, sum(s * s) as q from v group by 1)
select round(least(1, greatest((count(*) * (avg(dg) - avg(m))) ^ 2 / ((count(*) - 1) * (sum(q) - 2 * count(*) * sum(m * m) + count(*) ^ 2 * avg(m) ^ 2)), 1.0 / (count(*) - 1))), 6) as epsilon from r""")
def anova_sphericity(spark: SparkSession, d: str) -> DataFrame:
    return A.sphericity(_experiment(spark, d), "case_id", "priority", "composite").select(F.round("epsilon", 6).alias("epsilon"))


@query()
def analysis_test(spark: SparkSession, d: str) -> DataFrame:
    """The test that the analysis chooses, with its corrected p value, for which SQL has no function."""
    return analysis.analyse(_experiment(spark, d), ["priority"]).test


# events and usage -------------------------------------------------------------------------------------------


@query(_O + """, i as (select line_id, j from o where j ->> '$.type' = 'item.completed' and json_type(j, '$.item') = 'OBJECT' and j ->> '$.item.type' = 'command_execution')
select line_id, 0 as event_no, 'assistant' as type, 'Bash' as tool, coalesce(j ->> '$.item.id', '') as id, coalesce(j ->> '$.item.command', '') as command, null as content, null::boolean as is_error, j ->> '$.timestamp' as timestamp from i
union all select line_id, 1, 'tool_result', null, coalesce(j ->> '$.item.id', ''), null, coalesce(j ->> '$.item.aggregated_output', ''), coalesce(json_type(j, '$.item.exit_code') in ('BIGINT', 'UBIGINT') and (j ->> '$.item.exit_code')::bigint <> 0, false), j ->> '$.timestamp' from i""")
def item_events(spark: SparkSession, d: str) -> DataFrame:
    """Whole events of the lines of the second producer."""
    lines = table(spark, d, "transcript_lines")
    items = E.parsed(lines).filter(E.text("$.type") == "item.completed").select(*lines.columns)
    out, t = E.flat_events(items), F.get("tools", F.lit(0))
    return out.select("line_id", "event_no", "type", t["name"].alias("tool"), F.coalesce(t["id"], "tool_use_id").alias("id"), F.try_variant_get(F.try_parse_json(t["input_json"]), "$.command", "string").alias("command"), "content", "is_error", "timestamp")


@query(_O + """select run_id, max(line_id) as line_id, count(*) as num_turns from o where j ->> '$.type' in ('turn.completed', 'turn_completed') group by 1""")
def turn_results(spark: SparkSession, d: str) -> DataFrame:
    """One result for the completed turns of each run."""
    return E.turn_results(table(spark, d, "transcript_lines"), ["run_id"]).select("run_id", "line_id", "num_turns")


@query(_O + """, u as (select run_id, greatest(coalesce(try_cast(j ->> '$.usage.input_tokens' as bigint), 0), 0) as i, greatest(coalesce(try_cast(j ->> '$.usage.cached_input_tokens' as bigint), 0), 0) as c, greatest(coalesce(try_cast(j ->> '$.usage.output_tokens' as bigint), 0), 0) as t from o where j ->> '$.type' in ('turn.completed', 'turn_completed'))
select run_id, sum(greatest(i - c, 0))::bigint as input, sum(t)::bigint as output, sum(c)::bigint as cache_read, count(*) as num_turns from u group by 1""")
def turn_usage(spark: SparkSession, d: str) -> DataFrame:
    return E.turn_usage(table(spark, d, "transcript_lines"), ["run_id"])


@query(_O + """, a as (select run_id, j from o where j ->> '$.type' = 'assistant' and run_id is not null), r as (select run_id, line_id, j from o where j ->> '$.type' = 'result' and run_id is not null),
f as (select run_id, sum(coalesce(try_cast(j ->> '$.message.usage.input_tokens' as bigint), 0)) as i, sum(coalesce(try_cast(j ->> '$.message.usage.output_tokens' as bigint), 0)) as t,
  nullif(count(distinct nullif(j ->> '$.message.id', '')), 0) as num_turns from a group by 1),
c as (select run_id, arg_max(try_cast(j ->> '$.total_cost_usd' as double), line_id) as cost_usd from r where json_exists(j, '$.total_cost_usd') group by 1),
m as (select run_id, arg_max(j -> '$.modelUsage', line_id) as mu from r where json_type(j, '$.modelUsage') = 'OBJECT' group by 1),
k as (select run_id, mu, unnest(json_keys(mu)) as name from m),
s as (select run_id, sum(coalesce(try_cast(json_extract_string(mu, '$."' || name || '".inputTokens') as bigint), 0))::bigint as i, sum(coalesce(try_cast(json_extract_string(mu, '$."' || name || '".outputTokens') as bigint), 0))::bigint as t from k group by 1),
x as (select distinct run_id from o where run_id is not null)
select x.run_id, coalesce(s.i, case when f.i <> 0 or f.t <> 0 then f.i end)::bigint as input_tokens, coalesce(s.t, case when f.i <> 0 or f.t <> 0 then f.t end)::bigint as output_tokens, f.num_turns, c.cost_usd
from x left join f using (run_id) left join c using (run_id) left join s using (run_id)""")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, turns and cost of every run: from the usage by model where a result has it, else from its messages."""
    return E.usage(table(spark, d, "transcript_lines").filter("run_id is not null"), ["run_id"]).select("run_id", "input_tokens", "output_tokens", "num_turns", "cost_usd")


@query("""with e as (select run_id, model, lower(_msg_id) as _msg_id, agent_id from flat_events where type = 'assistant' and _msg_id is not null and run_id is not null and model is not null and not (starts_with(model, '<') and ends_with(model, '>'))),
s as (select distinct run_id, model, _msg_id from e where agent_id is null), x as (select distinct run_id, model, _msg_id from e where agent_id is not null), n as (select * from x except select * from s)
select run_id, model, sum(k)::bigint as stream_turns, sum(1 - k)::bigint as subagent_turns, count(*) as turns from (select *, 1 as k from s union all select *, 0 from n) group by 1, 2""")
def turns_with_subagents(spark: SparkSession, d: str) -> DataFrame:
    """Turns of the stream and the new ones of sub-agents, by model."""
    rows = table(spark, d, "flat_events").filter("type = 'assistant' and _msg_id is not null and run_id is not null and model is not null").filter(S.is_real_model(F.col("model")))
    slim = lambda when: rows.filter(when).select("run_id", "model", F.lower("_msg_id").alias("_msg_id")).distinct()
    return E.new_turns(slim("agent_id is null"), slim("agent_id is not null"), ["run_id"])


@query("""with t as (select event_id, generate_subscripts(tools, 1) - 1 as tool_pos, unnest(tools) as t from flat_events where type = 'assistant' and coalesce(parent_tool_use_id, '') = '')
select event_id, tool_pos::int as tool_pos, t.name as name, t.input_json as input_json from t where contains(t.name, 'Web') or contains(t.name, 'ash')""")
def matching_calls(spark: SparkSession, d: str) -> DataFrame:
    return E.matching_calls(table(spark, d, "flat_events"), ["Web", "ash", "Bash"], ["event_id"])


@query("""with t as (select session_id, event_id, unnest(tools) as t from flat_events where type = 'assistant' and session_id is not null),
c as (select session_id, lower(t.name) as n, case when json_valid(t.input_json) then coalesce(nullif(t.input_json ->> '$.file_path', ''), nullif(t.input_json ->> '$.path', ''), nullif(t.input_json ->> '$.file', ''), nullif(t.input_json ->> '$.filename', '')) end as p from t where coalesce(t.name, '') <> ''),
r as (select session_id, arg_max(coalesce(num_turns, 0), event_id) as turns from flat_events where type = 'result' and session_id is not null group by 1),
u as (select session_id, count(*) as calls, coalesce(string_agg(distinct regexp_extract(p, '[^/]*$'), ',' order by regexp_extract(p, '[^/]*$')) filter (n in ('read', 'read_file', 'readfile', 'view', 'cat', 'open') and p is not null), '') as files_read from c group by 1)
select session_id, coalesce(turns, 0) as turns, calls, files_read from u full join r using (session_id)""")
def evidence(spark: SparkSession, d: str) -> DataFrame:
    """What can be verified of each session."""
    out = E.evidence(table(spark, d, "flat_events").filter("session_id is not null"), ["session_id"], "event_id")
    calls = F.aggregate(F.map_values("tool_calls"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("session_id", "turns", calls.alias("calls"), F.array_join("files_read", ",").alias("files_read"))


@query("""select row_id, case when name = 'Read' then coalesce(v ->> '$.file_path', '?') when name = 'Bash' then case when length(coalesce(v ->> '$.command', '?')) > 200 then left(v ->> '$.command', 200) || '...' else coalesce(v ->> '$.command', '?') end
  when name in ('Edit', 'Write') then coalesce(v ->> '$.file_path', '?') when name in ('Glob', 'Grep') then coalesce(v ->> '$.pattern', v ->> '$.query', '?') when name = 'WebFetch' then coalesce(v ->> '$.url', '?') when name = 'WebSearch' then coalesce(v ->> '$.query', '?') when name = 'Skill' then coalesce(v ->> '$.skill', '?') end as summary
from (select row_id, name, case when json_valid(input_json) then input_json end as v from tool_calls) where name in ('Bash', 'Edit', 'Write', 'Glob', 'Grep', 'WebFetch', 'WebSearch', 'Skill')""")
def tool_summaries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tool_calls").filter("name in ('Bash', 'Edit', 'Write', 'Glob', 'Grep', 'WebFetch', 'WebSearch', 'Skill')")
    return rows.select("row_id", S.tool_summary(F.col("name"), F.col("input_json")).alias("summary"))


@query("""select n_name, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1 having count(*) > 10""")
def sql_views(spark: SparkSession, d: str) -> DataFrame:
    """SQL text over registered views."""
    from lumenloom.api import register

    register(spark, d, ["orders", "customer", "nation"])
    return spark.sql(ORACLES["sql_views"])


@query("""select l_suppkey, '{"other":[1,null,"x"],"judges":{"mean":' || round(avg(l_quantity), 3)::decimal(9,3) || '}}' as summary from lineitem group by 1""")
def merged_summaries(spark: SparkSession, d: str) -> DataFrame:
    """One key of a summary replaced, the others as they were."""
    from lumenloom.sources.sinks import merged_summary

    mean = F.round(F.avg("l_quantity"), 3).cast("decimal(9,3)").cast("string")
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.concat(F.lit('{"mean":'), mean, F.lit("}")).alias("v"))
    return rows.select("l_suppkey", merged_summary(F.lit('{"other": [1, null, "x"], "judges": 1}'), "judges", F.col("v")).alias("summary"))
