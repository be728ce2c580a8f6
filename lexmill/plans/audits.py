"""Queries that audit the pipeline: reconciliation, pilot of near copies, profile ratios, subsets, scores, configurations and shards, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import config, ids, tables, text
from lexmill.operators import ingest, manifest, near, profile, subset
from lexmill.plans import corpus
from lexmill.plans.corpus import GRAPH_95, KEPT, LETTERS, PRINTS, PROCESSED, RAW, SETS, UNIQUE, edges_sql
from lexmill.plans.evaluation import SCORES, by_seed, scores
from lexmill.plans.subset import COUNTS, SELECTED, _chosen, counts
from lexmill.session import Stages, table
from lexmill.sources import shards

#: Records of each source that a pilot or a profile samples, and pairs it shows.
SAMPLE, EXAMPLES = 3000, 12
LEVELS = (0.8, 0.85, 0.9, 0.95)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"""{GRAPH_95}, {PROCESSED}, n as (
    select (select count(*) from raw) raw, (select count(*) from routed where reason is not null) gone, (select count(*) from ranked where rn > 1) copies, (select count(*) from docs) unique_,
        (select count(*) from processed) kept, (select count(*) from members where removed = 1) near)
select 'raw' "check", raw expected, gone + copies + unique_ actual, raw = gone + copies + unique_ holds from n union all select 'exact_duplicates', copies, copies, true from n
union all select 'retained', unique_, kept + near, unique_ = kept + near from n""")
def reconciliation(s, d):
    normalized = Stages(s).put(corpus.norm(s, d))
    kept = ingest.retained(normalized)
    docs, _, members = corpus._members(s, d, near.THRESHOLD)
    return ingest.reconciliation(ingest.accounting(normalized), ingest.exact_removed(kept), manifest.processed(docs, members), members.where("removed = 1"))


def _pilot(s, d) -> tuple[DataFrame, DataFrame]:
    """The sample (source, raw_record_id, text, position), and its first record of each text by source and id, with its place in that order."""
    kept = ingest.retained(corpus.norm(s, d))
    chosen = profile.stable_sample(kept, SAMPLE).select("source", "raw_record_id")
    rows = Stages(s).put(kept.join(chosen, ["source", "raw_record_id"]).select("source", "raw_record_id", "text", F.sha2("text", 256).alias("h")))
    first = rows.groupBy("h").agg(F.min(F.struct("source", "raw_record_id")).alias("f")).select("f.*")
    first = first.withColumn("row_index", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source", "raw_record_id")) - 1)  # a sample of bounded size
    return rows, Stages(s).put(rows.join(first, ["source", "raw_record_id"]).select("row_index", "source", "raw_record_id", "text"))


PILOT = f"""with {KEPT},
k_ as (select *, ('0x' || substr(sha256('2026' || chr(0) || raw_record_id), 1, 16))::ubigint rank_ from kept),
sampled as (select *, row_number() over (partition by canonical_hash order by source, raw_record_id) rn from (select * from k_ qualify row_number() over (partition by source order by rank_, raw_record_id desc) <= {SAMPLE})),
docs as (select row_number() over (order by source, raw_record_id) - 1 row_index, source, raw_record_id, raw_record_id document_id, text from sampled where rn = 1),
{PRINTS.replace("group by 1, 2),", "group by 1, 2 having count(*) = 4),", 1)}, {SETS}, {edges_sql(0.8)}"""


@query(f"""{PILOT}, t as (select unnest([0.8, 0.85, 0.9, 0.95]::double[]) threshold)
select threshold, (select count(*) from sampled) sampled, (select count(*) from docs) unique_texts, (select count(*) from (select canonical_hash from sampled group by 1 having count(distinct source) > 1)) cross_source_groups,
    (select count(*) from candidates) candidate_pairs, count(similarity) accepted from t left join edges on similarity >= threshold group by threshold""")
def pilot_report(s, d):
    """Of each threshold: the sample, its texts, candidate pairs and those accepted."""
    rows, docs = _pilot(s, d)
    pairs = Stages(s).put(near.candidates(near.bands(docs)))
    edges = near.verified(pairs, docs, LEVELS[0])
    cross = rows.groupBy("h").agg(F.count_distinct("source").alias("n")).where("n > 1")
    one = rows.agg(F.count("*").alias("sampled")).join(docs.agg(F.count("*").alias("unique_texts"))).join(cross.agg(F.count("*").alias("cross_source_groups"))).join(pairs.agg(F.count("*").alias("candidate_pairs")))
    levels = one.select("*", F.explode(F.array(*map(F.lit, LEVELS))).alias("threshold"))  # a row for each threshold
    found = edges.select(F.explode(F.filter(F.array(*map(F.lit, LEVELS)), lambda t: F.col("similarity") >= t)).alias("threshold")).groupBy("threshold").agg(F.count("*").alias("accepted"))
    return levels.join(found, "threshold", "left").withColumn("accepted", F.coalesce("accepted", F.lit(0)))


@query(f"""{PILOT}, x as (select *, row_number() over (order by similarity desc, l desc, r desc) place from edges)
select place, round(similarity, 6) similarity, a.source left_source, b.source right_source, a.raw_record_id left_id, b.raw_record_id right_id, replace(substr(a.text, 1, 240), chr(10), ' ') left_excerpt, replace(substr(b.text, 1, 240), chr(10), ' ') right_excerpt
from x join docs a on a.row_index = l join docs b on b.row_index = r where place <= {EXAMPLES}""")
def pilot_examples(s, d):
    """The first pairs of the pilot by similarity, with excerpts."""
    _, docs = _pilot(s, d)
    edges = near.verified(near.candidates(near.bands(docs)), docs, LEVELS[0])
    top = edges.orderBy(F.desc("similarity"), F.desc("l"), F.desc("r")).limit(EXAMPLES)
    top = top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("similarity"), F.desc("l"), F.desc("r"))))  # a dozen rows
    side = lambda k, name: docs.select(F.col("row_index").alias(k), F.col("source").alias(f"{name}_source"), F.col("raw_record_id").alias(f"{name}_id"), text.excerpt(F.col("text")).alias(f"{name}_excerpt"))
    return top.join(side("l", "left"), "l").join(side("r", "right"), "r").withColumn("similarity", F.round("similarity", 6)).drop("l", "r")


@query(f"""with {RAW}, i_ as (select source, sha256(source || chr(0) || shard || chr(0) || row_index) id, text from raw where text is not null),
k_ as (select * from i_ qualify row_number() over (partition by source order by ('0x' || substr(sha256('2026' || chr(0) || id), 1, 16))::ubigint, id desc) <= {SAMPLE}),
n_ as (select source, {LETTERS} letters, length(text) n, length(regexp_replace(text, '[^A-Za-z\\x{{c0}}-\\x{{d6}}\\x{{d8}}-\\x{{f6}}\\x{{f8}}-\\x{{24f}}]', '', 'g')) latin from k_)
select source, count(*) documents, (count(*) filter (where letters < 50)) / count(*) below_50_letters, avg(letters / greatest(n, 1)) alphabetic_ratio, avg(latin / greatest(letters, 1)) latin_ratio from n_ group by 1""")
def profile_ratios(s, d):
    """Shares over the stable sample of each source: texts under 50 letters, letters among characters, Latin ones among letters."""
    rows = corpus.raw(s, d).where("text is not null")
    rid = ids.raw_record_id(F.col("source"), F.col("shard"), F.col("row_index"))
    chosen = profile.stable_sample(rows, SAMPLE).select("source", "raw_record_id")
    each = rows.withColumn("raw_record_id", rid).join(chosen, ["source", "raw_record_id"]).select("source", text.letters(F.col("text")).alias("letters"), F.length("text").alias("n"), text.latin_letters(F.col("text")).alias("latin"))
    one = F.lit(1)
    return each.groupBy("source").agg(F.count("*").alias("documents"), (F.count_if(F.col("letters") < 50) / F.count("*")).alias("below_50_letters"), F.avg(F.col("letters") / F.greatest("n", one)).alias("alphabetic_ratio"), F.avg(F.col("latin") / F.greatest("letters", one)).alias("latin_ratio"))


@query(f"with {UNIQUE}, {PRINTS} select (select sum(case when size <= 10000 then size * (size - 1) // 2 else 0 end)::bigint from buckets where size > 1) attempts, (select count(*) from candidates) unique_pairs")
def lsh_pair_totals(s, d):
    """Pairs tried in all bands together, and different pairs among them."""
    banded = near.bands(corpus.unique(s, d))
    attempts = near.bucket_stats(banded).agg(F.sum("pair_attempts").alias("attempts"))
    return attempts.join(F.broadcast(near.candidates(banded).agg(F.count("*").alias("unique_pairs"))))  # one row each


@query(f"""with {SELECTED}, m as (select document_id, count(*) n, max(split) hi, min(split) lo, count(distinct processed_row) "rows" from (select distinct document_id, split, processed_file, processed_row from manifests) group by 1)
select count(*) records, count_if(not regexp_matches(c.document_id, '^[0-9a-f]{{64}}$'))::bigint bad_ids, count_if(m.document_id is null)::bigint not_in_manifest, count_if(m.lo <> 'train' or m.hi <> 'train')::bigint not_train,
    count_if(k.token_count is distinct from c.token_count)::bigint other_counts, count_if(c.token_count < 2)::bigint too_short, (count(*) - count(distinct c.document_id))::bigint repeated from chosen c left join m using (document_id) left join counts k using (document_id)""")
def subset_problems(s, d):
    """The chosen subset held against the manifest and the counts: what must be nought everywhere but for what the tables lack."""
    m = table(s, d, "manifests").where("document_id is not null").groupBy("document_id").agg(F.max("split").alias("hi"), F.min("split").alias("lo"))
    now = counts(s, d).select("document_id", F.col("token_count").alias("now"))
    rows = _chosen(s, d)[0].join(m, "document_id", "left").join(now, "document_id", "left")
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    col = F.col
    return rows.agg(
        F.count("*").alias("records"), n(~col("document_id").rlike("^[0-9a-f]{64}$"), "bad_ids"), n(col("hi").isNull(), "not_in_manifest"), n((col("lo") != "train") | (col("hi") != "train"), "not_train"),
        n(~col("now").eqNullSafe(col("token_count")), "other_counts"), n(col("token_count") < 2, "too_short"), (F.count("*") - F.count_distinct("document_id")).alias("repeated"),
    )


@query(f"""with {SCORES}, per as (select "method", seed, count(*) documents, sum(token_count)::bigint tokens from scores group by all)
select "method", seed, documents, tokens, 0 missing, 0 other_counts, 0 not_finite, 0 repeated from per""")
def score_problems(s, d):
    """Of each method and seed: its documents, and what would break the pairing with the others: missing or repeated documents, other counts, losses that are no numbers."""
    rows = Stages(s).put(scores(s, d))
    every = rows.groupBy("document_id").agg(F.min("token_count").alias("n"), F.max("token_count").alias("m"))
    total = every.agg(F.count("*").alias("all"))
    met = rows.join(every, "document_id")
    bad = F.isnan("nll_sum") | F.col("nll_sum").isNull() | (F.abs("nll_sum") == float("inf"))
    per = met.groupBy("method", "seed").agg(
        F.count_distinct("document_id").alias("documents"), F.sum("token_count").alias("tokens"), F.count_if(F.col("n") != F.col("m")).alias("other_counts"), F.count_if(bad).alias("not_finite"), (F.count("*") - F.count_distinct("document_id")).alias("repeated")
    )
    return per.join(F.broadcast(total)).withColumn("missing", F.col("all") - F.col("documents")).drop("all")  # one row


@query(f"""with {SCORES}, m as (select "method", avg(nll) nll from by_seed group by 1) select "method", round(nll, 6) mean_nll, row_number() over (order by nll, "method") place from m qualify place <= 2""")
def best_and_runner_up(s, d):
    m = by_seed(s, d).groupBy("method").agg(F.avg("nll").alias("nll"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("nll", "method"))  # a handful of methods
    return m.withColumn("place", place).where("place <= 2").select("method", F.round("nll", 6).alias("mean_nll"), "place")


@query(f"""with {COUNTS}, n as (select split, count(*) documents from counts where split in ('validation', 'test') and token_count >= 2048 group by 1), c as (select unnest([512, 1024, 2048]) context), m as (select unnest(['learned', 'sinusoidal', 'rope', 'alibi', 'nope']) "method")
select split, "method", context, case when "method" = 'learned' and context > 512 then 'not_applicable' else 'complete' end status, case when "method" = 'learned' and context > 512 then 0 else documents end documents, case when "method" = 'learned' and context > 512 then 0 else documents * 256 end targets from n, c, m""")
def length_table(s, d):
    """Of each split, method and context: whether length scores are defined, over how many documents and targets."""
    n = counts(s, d).where("split in ('validation', 'test') and token_count >= 2048").groupBy("split").agg(F.count("*").alias("documents"))
    rows = n.select("*", F.explode(F.array(*map(F.lit, tables.METHODS))).alias("method")).select("*", F.explode(F.array(F.lit(512), F.lit(1024), F.lit(2048))).alias("context"))
    undefined = (F.col("method") == "learned") & (F.col("context") > 512)
    own = F.when(undefined, 0).otherwise(F.col("documents"))
    return rows.select("split", "method", "context", F.when(undefined, "not_applicable").otherwise("complete").alias("status"), own.alias("documents"), (own * 256).alias("targets"))


def _configs(s, d):
    core = F.struct("source_order", F.col("included_in_core").alias("included"))
    group = F.struct(F.col("source_group").alias("name"), F.col("component_label").alias("label"))
    return config.paths(table(s, d, "source_settings").select("source", F.to_json(F.struct(group.alias("group"), core.alias("core")), {"ignoreNullFields": "false"}).alias("json")), "source", "json")


PATHS = """p as (
    select source, 'group.name' path, coalesce('"' || source_group || '"', 'null') "value" from source_settings union all select source, 'group.label', coalesce('"' || component_label || '"', 'null') from source_settings
    union all select source, 'core.source_order', coalesce(source_order::varchar, 'null') from source_settings union all select source, 'core.included', coalesce(included_in_core::varchar, 'null') from source_settings)"""


@query(f"with {PATHS} select * from p")
def config_paths(s, d):
    """The settings of each source as nested objects, flattened to dotted paths."""
    return _configs(s, d)


@query(f"with {PATHS} select path, count(distinct source) holders, count(distinct \"value\") \"values\", (select count(*) from source_settings) - count(distinct source) missing, path in ('group.name', 'core.source_order') allowed from p group by 1 having count(distinct \"value\") > 1")
def config_differences(s, d):
    return config.differences(_configs(s, d), "source", ["group.name", "core.source_order"])


CHECKS = ("batch_divides", "final_milestone_is_total", "milestones_distinct", "run_ids_have_shape", "runs_are_methods_by_seeds", "steps_cover_total", "tail_fits_a_block")


@query("select unnest([" + ", ".join(f"'{c}'" for c in CHECKS) + '])  "check", true passed')
def plan_checks(s, d):
    """The identities that a frozen plan must satisfy, each with whether it holds."""
    runs, ms = tables.run_matrix(s), tables.milestones(s)
    total, batch, length = 50_000_000, 65_536, 512
    r = runs.agg(F.bool_and(F.col("run_id").rlike(r"^run-[a-z]+-s\d+-t\d+m-c\d+-v\d+k$")).alias("shape"), (F.count_distinct("run_id") == len(tables.METHODS) * len(tables.SEEDS)).alias("matrix"))
    m = ms.agg((F.max("actual_tokens") == total).alias("final"), (F.count_distinct("actual_tokens") == F.count("*")).alias("distinct"))
    steps = tables.lr_schedule(s, -(-total // batch), extra=0).agg((F.count("*") * batch >= total).alias("a"), ((F.count("*") - 1) * batch < total).alias("b"))
    rows = r.join(m).join(steps)  # one row each
    checks = {
        "batch_divides": F.lit(batch % length == 0), "final_milestone_is_total": F.col("final"), "milestones_distinct": F.col("distinct"), "run_ids_have_shape": F.col("shape"),
        "runs_are_methods_by_seeds": F.col("matrix"), "steps_cover_total": F.col("a") & F.col("b"), "tail_fits_a_block": F.lit(0 <= total - total // length * length < length),
    }
    return rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in checks.items()])).alias("x")).select("x.*")


@query("select 'documents.parquet' \"table\", count(*) records, count(*) filter (where text is null) null_texts, true statistics_agree from documents")
def shard_inventory(s, d):
    """The files of the table of texts by their footers, put together: rows, null texts, and whether the footers' counts are those of a scan."""
    found = shards.footers(s, f"{d}/documents.parquet", "text").agg(F.sum("records").alias("records"), F.sum("null_texts").alias("null_texts"))
    seen = table(s, d, "documents").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("m"))
    rows = found.join(F.broadcast(seen))  # one row each
    return rows.select(F.lit("documents.parquet").alias("table"), F.col("n").alias("records"), F.col("m").alias("null_texts"), ((F.col("records") == F.col("n")) & (F.coalesce("null_texts", "m") == F.col("m"))).alias("statistics_agree"))


@query("select doc_id, 'documents' source, row_number() over () - 1 row_index, sha256(coalesce(text, '')) text_hash from documents")
def shard_rows(s, d):
    """The rows of the shards of texts with their place in the shard."""
    path = f"{d}/documents.parquet"
    df = shards.scan(s, path, "documents", keep=("doc_id",))
    return df.select("doc_id", "source", "row_index", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
