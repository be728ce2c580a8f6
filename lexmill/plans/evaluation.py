"""Queries of the statistics that compare methods, and of plans and tables made by arithmetic, with their SQL.

The test tables hold no losses, so the score table is made from hashes of documents, methods and seeds in the same way in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import ids, tables
from lexmill.operators import evaluation
from lexmill.plans.subset import COUNTS, counts
from lexmill.session import table

MILESTONES = (5_000_000, 10_000_000, 20_000_000, 50_000_000)
#: As the reference's evaluation protocol.
RESAMPLES = 10_000

M_LIST = "[" + ", ".join(f"'{m}'" for m in tables.METHODS) + "]"
S_LIST = "[" + ", ".join(map(str, tables.SEEDS)) + "]"
RUNS = f"""
methods as (select generate_subscripts(m, 1) - 1 mi, unnest(m) "method" from (select {M_LIST} m)),
seeds as (select unnest({S_LIST}) seed),
runs as (select * from methods, seeds)"""
SCORES = f"""{COUNTS}, {RUNS},
docs as (select document_id, token_count from counts where split = 'test' and token_count > 1),
scores as (select "method", seed, document_id, token_count, token_count * (5.0::double + 0.02::double * mi + 0.2::double * (('0x' || substr(md5("method" || ':' || seed || ':' || document_id), 1, 8))::ubigint::double / 4294967296)) nll_sum from docs, runs),
by_seed as (select "method", seed, sum(nll_sum) / sum(token_count) nll, sum(token_count)::bigint tokens from scores group by all)"""
LEARNING = f"""{SCORES}, ms as (select unnest([5000000, 10000000, 20000000, 50000000]) milestone),
learning as (select "method", milestone, avg(nll * (1 + 5000000 / milestone::double / 10)) mean_nll from by_seed, ms group by all)"""
DRAWS = f"""{SCORES},
means as (select "method", document_id, avg(nll_sum) m, max(token_count) n from scores group by all),
numbered as (select document_id, row_number() over (order by document_id) - 1 d from docs),
picks as (select r.replicate, p.position, (select count(*) from docs) n from (select unnest(range(0, {RESAMPLES})) replicate) r, (select unnest(range(0, (select count(*) from docs))) position) p),
drawn as (select replicate, (('0x' || substr(md5('5:' || replicate || ':' || position), 1, 12))::ubigint % n)::bigint d, count(*) times from picks group by all),
draws as (select replicate, "method", sum(m * times) / sum(n * times) nll from drawn join numbered using (d) join means using (document_id) group by all)"""
PAIRS = f"""{DRAWS},
top as (select "method", avg(nll) nll from by_seed group by 1),
pairs as (select a."method" a, b."method" b, a.nll - b.nll delta from top a join top b on a."method" < b."method"),
agree as (select p.a, p.b, count(*) filter (where sign(x.nll - y.nll) = sign(delta) and delta <> 0) consistent_seeds from pairs p join by_seed x on x."method" = p.a join by_seed y on y."method" = p.b and y.seed = x.seed group by all),
deltas as (select p.a, p.b, p.delta, x.nll - y.nll d from pairs p join draws x on x."method" = p.a join draws y on y."method" = p.b and y.replicate = x.replicate),
stats as (select a, b, any_value(delta) delta, quantile_cont(d, 0.025) ci_low, quantile_cont(d, 0.975) ci_high, (1 + count(*) filter (where abs(d - delta) >= abs(delta))) / (count(*) + 1) p from deltas group by a, b),
steps as (select *, (count(*) over () - row_number() over (order by p, a || '/' || b) + 1) * p s from stats),
adjusted as (select *, least(1.0, max(s) over (order by p, a || '/' || b rows unbounded preceding)) p_holm from steps)"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def scores(s, d) -> DataFrame:
    """method, seed, document_id, token_count, nll_sum for the test documents."""
    docs = counts(s, d).where("split = 'test' and token_count > 1").select("document_id", "token_count")
    runs = F.explode(F.array(*[F.struct(F.lit(i).alias("mi"), F.lit(m).alias("method"), F.lit(x).alias("seed")) for i, m in enumerate(tables.METHODS) for x in tables.SEEDS])).alias("run")
    u = F.conv(F.substring(F.md5(F.concat_ws(":", "method", "seed", "document_id")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rows = docs.select("*", runs).select("document_id", "token_count", "run.*")  # the 25 runs of the matrix, for each document
    return rows.select("method", "seed", "document_id", "token_count", (F.col("token_count") * (F.lit(5.0) + F.lit(0.02) * F.col("mi") + F.lit(0.2) * u)).alias("nll_sum"))


def by_seed(s, d) -> DataFrame:
    return evaluation.weighted_nll(scores(s, d), "method", "seed")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f'with {SCORES} select "method", seed, tokens, round(nll, 6) nll, round(exp(nll), 6) ppl from by_seed')
def token_weighted_nll(s, d):
    return rounded(by_seed(s, d))


@query(f'with {SCORES} select "method", count(*) seeds, round(avg(nll), 6) mean_nll, round(stddev_samp(nll), 6) sd_nll, round(exp(avg(nll)), 6) ppl_of_mean, round(avg(exp(nll)), 6) mean_ppl from by_seed group by 1')
def seed_summary(s, d):
    return rounded(evaluation.seed_summary(by_seed(s, d), "method"))


@query(f"""with {SCORES} select "method", seed, rank() over (partition by seed order by nll) + (count(*) over (partition by seed, nll) - 1) / 2 seed_rank, rank() over (partition by seed order by nll) = 1 tied_for_lowest from by_seed""")
def seed_ranks(s, d):
    rows = by_seed(s, d).withColumn("seed_rank", evaluation.average_rank("nll", "seed"))
    return rows.withColumn("tied_for_lowest", F.rank().over(evaluation.Window.partitionBy("seed").orderBy("nll")) == 1).select("method", "seed", "seed_rank", "tied_for_lowest")


def _learning(s, d):
    ms = F.explode(F.array(*[F.lit(m) for m in MILESTONES])).alias("milestone")
    rows = by_seed(s, d).select("method", "nll", ms)
    return rows.groupBy("method", "milestone").agg(F.avg(F.col("nll") * (1 + F.lit(5000000) / F.col("milestone").cast("double") / 10)).alias("mean_nll")).withColumn("actual_tokens", F.col("milestone"))


@query(f"""with {LEARNING} select "method", milestone, round(mean_nll, 6) mean_nll, rank() over (partition by milestone order by mean_nll) + (count(*) over (partition by milestone, mean_nll) - 1) / 2 descriptive_rank,
    round(first_value(mean_nll) over (partition by "method" order by milestone) - mean_nll, 6) nll_reduction, rank() over (partition by milestone order by mean_nll) = 1 lowest, round(exp(mean_nll), 6) ppl from learning""")
def learning_summary(s, d):
    return rounded(evaluation.learning(_learning(s, d), "milestone").drop("actual_tokens"))


@query(f"""with {DRAWS} select "method", round(avg(nll), 6) mean_nll, round(quantile_cont(nll, 0.025), 6) ci_low, round(quantile_cont(nll, 0.975), 6) ci_high, count(*) replicates from draws group by 1""")
def bootstrap_ci(s, d):
    drawn = evaluation.draws(scores(s, d), RESAMPLES)
    return rounded(drawn.groupBy("method").agg(F.avg("nll").alias("mean_nll"), F.percentile("nll", F.lit(0.025)).alias("ci_low"), F.percentile("nll", F.lit(0.975)).alias("ci_high"), F.count("*").alias("replicates")))


@query(f"""with {PAIRS} select a, b, round(delta, 6) delta, round(ci_low, 6) ci_low, round(ci_high, 6) ci_high, round(p, 6) p, consistent_seeds, round(p_holm, 6) p_holm, round(100 * (exp(delta) - 1), 6) relative_ppl_percent,
    abs(delta) >= 0.01 practical, p_holm < 0.05 and (ci_high < 0 or ci_low > 0) and consistent_seeds >= 4 supported from adjusted join agree using (a, b)""")
def pairwise_compare(s, d):
    sc = scores(s, d)
    return rounded(evaluation.compare(evaluation.weighted_nll(sc, "method", "seed"), evaluation.draws(sc, RESAMPLES)))


HOLM = "t as (select i, p from (values (0, 0.03::double), (1, 0.001::double), (2, 0.04::double), (3, 0.2::double)) v(i, p))"


@query(f"with {HOLM}, x as (select *, (4 - row_number() over (order by p, i) + 1) * p s from t) select i, p, round(least(1.0, max(s) over (order by p, i rows unbounded preceding)), 9) p_holm from x")
def holm_adjust(s, d):
    tests = s.createDataFrame([(0, 0.03), (1, 0.001), (2, 0.04), (3, 0.2)], "i int, p double")
    return evaluation.holm_adjusted(tests, "p", "i").select("i", "p", F.round("p_holm", 9).alias("p_holm"))


@query(f"with {RUNS} select \"method\", seed, format('run-{{}}-s{{}}-t50m-c512-v16k', \"method\", seed) run_id from runs")
def run_matrix(s, d):
    return tables.run_matrix(s)


@query("""with n as (select unnest([5000000, 10000000, 20000000, 50000000]) nominal_tokens), a as (select nominal_tokens, case when nominal_tokens = 50000000 then 50000000 else least(ceil(nominal_tokens / 65536)::bigint * 65536, 50000000) end actual_tokens from n)
select nominal_tokens::bigint nominal_tokens, actual_tokens::bigint actual_tokens, (actual_tokens - nominal_tokens)::bigint overshoot, actual_tokens = 50000000 is_final from a""")
def milestones(s, d):
    return tables.milestones(s)


@query("""with x as (select unnest(range(0, 768)) step) select step, round(case when step < 7 then 0.0006::double * (step + 1) / 7 when step >= 763 then 0.00006::double
    else 0.00006::double + (0.0006::double - 0.00006::double) * (0.5 * (1 + cos(pi() * (step - 7) / 756.0::double))) end, 12) lr from x""")
def lr_schedule(s, d):
    return tables.lr_schedule(s, 763).select("step", F.round("lr", 12).alias("lr"))


@query("""with p as (select unnest(range(0, 64)) pos), q as (select unnest(range(0, 16)) pair), a as (select pos, pair, pos * exp(-ln(10000.0::double) * (pair * 2) / 32) angle from p, q)
select pos, pair * 2 dim, round(sin(angle), 9) "value" from a union all select pos, pair * 2 + 1, round(cos(angle), 9) from a""")
def sinusoidal_table(s, d):
    return tables.sinusoidal(s, 64, 32).select("pos", "dim", F.round("value", 9).alias("value"))


@query("""with h as (select unnest(range(0, 12)) head), d as (select unnest(range(0, 64)) distance), s as (select head, case when head < 8 then pow(2.0::double, -8.0 * (head + 1) / 8) else pow(2.0::double, -8.0 * (2 * (head - 8) + 1) / 16) end slope from h)
select head, distance, round(slope, 12) slope, round(0.0::double - slope * distance, 12) bias from s, d""")
def alibi_bias(s, d):
    return tables.alibi(s, 12, 64).select("head", "distance", F.round("slope", 12).alias("slope"), F.round("bias", 12).alias("bias"))


@query("""with p as (select unnest(range(0, 512)) pos), q as (select unnest(range(0, 128)) pair), a as (select pos, pair, pos * exp(-ln(10000.0::double) * (pair * 2) / 256) angle from p, q)
select pos, pair * 2 dim, round(sin(angle), 9) "value" from a union all select pos, pair * 2 + 1, round(cos(angle), 9) from a""")
def sinusoidal_table_512(s, d):
    """The table at the reference's max_seq_len and d_model."""
    return tables.sinusoidal(s, 512, 256).select("pos", "dim", F.round("value", 9).alias("value"))


@query("""with h as (select unnest(range(0, 8)) head), d as (select unnest(range(0, 512)) distance), s as (select head, pow(2.0::double, -8.0 * (head + 1) / 8) slope from h)
select head, distance, round(slope, 12) slope, round(0.0::double - slope * distance, 12) bias from s, d""")
def alibi_bias_512(s, d):
    """The biases at the reference's n_head and max_seq_len."""
    return tables.alibi(s, 8, 512).select("head", "distance", F.round("slope", 12).alias("slope"), F.round("bias", 12).alias("bias"))


@query("with m as (select unnest(range(1, 257)) micro_batch) select micro_batch, 65536 // (micro_batch * 512) accumulation from m where 65536 % (micro_batch * 512) = 0")
def benchmark_candidates(s, d):
    return tables.benchmark_candidates(s)


@query(f"with {RUNS}, k as (select unnest([512, 1024, 2048]) context), m as (select unnest([5000000, 10000000, 20000000, 50000000])::bigint milestone) select \"method\", seed, milestone, context, case when \"method\" = 'learned' and context > 512 then 'not_applicable' else 'pending' end status from runs, m, k")
def evaluation_jobs(s, d):
    runs = tables.run_matrix(s).select("method", "seed")
    more = runs.select("method", "seed", F.explode(F.array(*[F.lit(m).cast("bigint") for m in MILESTONES])).alias("milestone"))
    rows = more.select("*", F.explode(F.array(F.lit(512), F.lit(1024), F.lit(2048))).alias("context"))
    return rows.withColumn("status", F.when((F.col("method") == "learned") & (F.col("context") > 512), "not_applicable").otherwise("pending"))


@query("""with x as (select source k, 'source_group' field, source_group v from source_settings union all select source, 'component_label', component_label from source_settings union all select source, 'included_in_core', included_in_core::varchar from source_settings)
select field, count(distinct v) "values", count(*) filter (where v is null) missing from x group by 1""")
def config_diff(s, d):
    t = table(s, d, "source_settings")
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in ("source_group", "component_label", "included_in_core")])).alias("x")
    return t.select(fields).select("x.*").groupBy("field").agg(F.count_distinct("v").alias("values"), F.count_if(F.col("v").isNull()).alias("missing"))


CRC = """xor(list_reduce(list_transform(range(0, length(source)), lambda i: ascii(substr(source, (i + 1)::int, 1))::bigint),
    lambda c, b: list_reduce(range(0, 8), lambda r, z: case when r & 1 = 1 then xor(r >> 1, 3988292384::bigint) else r >> 1 end, xor(c, b)), 4294967295::bigint), 4294967295::bigint)"""


@query(f"select source, (17 * 1000003 + {CRC}) % 2147483647 seed from source_settings")
def name_seeds(s, d):
    t = table(s, d, "source_settings")
    return t.select("source", ids.name_seed(F.lit(17), F.col("source")).alias("seed"))


@query(f"""with {LEARNING}, r as (select *, rank() over (partition by milestone order by mean_nll) k from learning), led as (select milestone, string_agg("method", ',' order by "method") methods from r where k = 1 group by 1)
select milestone, methods, (select count(distinct methods) > 1 from led) changes from led""")
def leading_methods(s, d):
    rows = evaluation.learning(_learning(s, d), "milestone").where("lowest").groupBy("milestone").agg(F.array_join(F.array_sort(F.collect_list("method")), ",").alias("methods"))
    every = F.collect_set("methods").over(evaluation.Window.partitionBy(F.lit(0)))  # one row for each milestone
    return rows.select("*", (F.size(every) > 1).alias("changes"))
