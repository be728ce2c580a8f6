"""Queries of token totals, quota subsets, the token stream and evaluation windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import ids, text
from lexmill.operators import evaluation, records, subset
from lexmill.plans.corpus import UNIQUE, unique
from lexmill.session import table

SHARE, PLENTY = 0.4, 0.9

COUNTS = """
latest as (
    select document_id, max(struct_pack(counted_at := counted_at, source := source, source_group := source_group, split := split, token_count := token_count)) r
    from token_counts where document_id is not null group by document_id
),
spelled as (
    select document_id, r.token_count token_count, regexp_replace(lower(trim(r.source)), '[\\s_-]+', '-', 'g') key, regexp_replace(lower(trim(r.source_group)), '[\\s_-]+', '-', 'g') gkey,
        case when lower(trim(r.split)) in ('train', 'training') then 'train' when lower(trim(r.split)) in ('validation', 'valid', 'val', 'dev') then 'validation' when lower(trim(r.split)) = 'test' then 'test' end split
    from latest
),
settings as (select *, regexp_replace(lower(trim(source_group)), '[\\s_-]+', '-', 'g') gkey from source_settings),
groups as (select gkey, min(source_group) group_name from settings group by 1),
counts as (
    select c.document_id, coalesce(s.source, c.key) source, coalesce(g.group_name, s.source_group) source_group, c.split, c.token_count
    from spelled c left join source_settings s on s.source = c.key left join groups g on g.gkey = c.gkey
)"""
SELECTED = f"""{COUNTS},
budget as (select floor(coalesce(sum(token_count), 0) * {SHARE}::double)::bigint target from counts where split = 'train' and token_count > 0),
asked as (select * from (values ('News', 0.25::double), ('Native Wikipedia', 0.20::double), ('Books', 0.30::double), ('Laws', 0.15::double), ('Blogs', 0.10::double)) v(source_group, w)),
quota0 as (select source_group, floor(target * w)::bigint q, target from asked, budget),
quota as (select source_group, q + case when source_group = 'News' then target - (select sum(q) from quota0) else 0 end q from quota0),
pool as (
    select c.*, coalesce(s.source_order, 999) priority, sha256('quota' || chr(0) || '2026' || chr(0) || document_id) sampling_rank
    from counts c left join source_settings s using (source) where split = 'train' and token_count is not null and c.source_group in (select source_group from asked)
),
placed as (select *, sum(token_count) over (partition by source_group order by priority, sampling_rank, document_id) - token_count before from pool),
chosen as (select p.document_id, p.source, p.source_group, p.token_count, p.sampling_rank, 'requested_quota' selection_phase from placed p join quota q using (source_group) where p.before < q.q)"""
STREAM = f"""{SELECTED},
shuffled as (select *, sha256('order' || chr(0) || '2026' || chr(0) || document_id) order_rank from chosen),
stream as (select *, row_number() over (order by order_rank, document_id) - 1 sampling_order, (sum(token_count) over (order by order_rank, document_id) - token_count)::bigint tokens_before from shuffled)"""
CUT = "(select floor(target * 0.9::double)::bigint from budget)"
PLAN = f"""{STREAM},
plan as (
    select sampling_order, document_id, token_count, tokens_before stream_offset, least(token_count, {CUT} - tokens_before) take_tokens, tokens_before + least(token_count, {CUT} - tokens_before) stream_end,
        least(token_count, {CUT} - tokens_before) < token_count is_partial
    from stream where tokens_before < {CUT} and token_count > 0
)"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def counts(s, d):
    return records.clean_counts(table(s, d, "token_counts"), table(s, d, "source_settings"))


def _target(rows, share):
    return int((rows.where("split = 'train' and token_count > 0").agg(F.sum("token_count")).first()[0] or 0) * share)


def _chosen(s, d, share=SHARE):
    rows = counts(s, d)
    target = _target(rows, share)
    return (*subset.select(subset.ranked(rows, table(s, d, "source_settings"), subset.WEIGHTS), target, subset.WEIGHTS, subset.REDISTRIBUTION), target)


def _stream(s, d):
    chosen, _, target = _chosen(s, d)
    return subset.ordered(chosen), int(target * 0.9)


@query(f"""with {COUNTS} select case when grouping(split) = 1 then '*' else split end split, case when grouping(source) = 1 then '*' else source end source, case when grouping(source_group) = 1 then '*' else source_group end source_group,
    count(*) documents, coalesce(sum(token_count), 0)::bigint tokens from counts group by grouping sets ((split, source), (split), (source), (source_group))""")
def token_totals(s, d):
    return subset.totals(counts(s, d))


@query(f"with {SELECTED} select document_id, source, source_group, token_count, selection_phase, sampling_rank from chosen")
def quota_selection(s, d):
    return _chosen(s, d)[0]


REDISTRIBUTED = f"""with recursive {SELECTED.replace(f"* {SHARE}::double", f"* {PLENTY}::double").rsplit("chosen as", 1)[0].rstrip().rstrip(",")},
order_ as (select * from (values ('News', 0, 0.25::double), ('Native Wikipedia', 1, 0.20::double), ('Books', 2, 0.30::double), ('Laws', 3, 0.15::double), ('Blogs', 4, null)) v(source_group, i, w)),
have as (select o.source_group, i, w, coalesce(sum(token_count), 0)::bigint have from order_ o left join placed p on p.source_group = o.source_group group by all),
cuts as (select source_group, before, before + token_count after from placed where token_count > 0),
rounds(k, lists, was) as (
    select 0, (select list(struct_pack(g := h.source_group, i := h.i, w := h.w, have := h.have, lim := q.q::bigint, got := coalesce((select max(after) from cuts c where c.source_group = h.source_group and c.before < q.q), 0)::bigint) order by h.i)
        from have h join quota q using (source_group)), -1::bigint
    union all
    select k + 1, (
        select list(struct_pack(g := x.g, i := x.i, w := x.w, have := x.have, lim := x.lim, got := coalesce((select max(after) from cuts c where c.source_group = x.g and c.before < x.lim), 0)::bigint) order by x.i) from (
            select g, i, w, have, case when not open_ then lim else got + floor(lack * w / total_w)::bigint + case when i = first_ then lack - sum(case when open_ then floor(lack * w / total_w)::bigint else 0 end) over () else 0 end end::bigint lim
            from (select *, sum(case when open_ then w end) over () total_w, min(case when open_ then i end) over () first_ from (
                select u.*, (select max(target) from quota0) - sum(u.got) over () lack, u.w is not null and not (u.got = u.have and u.got < u.lim) open_ from (select unnest(lists, recursive := true))  u))
        ) x), list_sum(list_transform(lists, lambda z: z.got))::bigint
    from rounds where k < 20 and list_sum(list_transform(lists, lambda z: z.got)) < (select max(target) from quota0) and list_sum(list_transform(lists, lambda z: z.got)) <> was
        and len(list_filter(lists, lambda z: z.w is not null and not (z.got = z.have and z.got < z.lim))) > 0
),
limits as (select k, unnest(lists, recursive := true) from rounds),
phased as (select p.document_id, min(l.k) k from placed p join limits l on l.g = p.source_group and p.before < l.lim group by 1)
select document_id, source, source_group, token_count, case k when 0 then 'requested_quota' else 'redistribution_' || k end selection_phase, sampling_rank from phased join placed using (document_id)"""


@query(REDISTRIBUTED)
def quota_redistribution(s, d):
    return _chosen(s, d, PLENTY)[0]


@query(f"""with {SELECTED}, have as (select source_group, sum(token_count)::bigint available from pool group by 1), got as (select source_group, sum(token_count)::bigint selected from chosen group by 1)
select q.source_group, coalesce(available, 0) available, q.q::bigint requested, coalesce(selected, 0) selected, greatest(0, q.q - coalesce(available, 0))::bigint shortage,
    round(coalesce(selected, 0) / greatest(1, sum(coalesce(selected, 0)) over ()), 9) proportion from quota q left join have using (source_group) left join got using (source_group)""")
def group_shortage(s, d):
    rows = [tuple(r.values()) for r in _chosen(s, d)[1]]
    return s.createDataFrame(rows, "source_group string, available bigint, requested bigint, selected bigint, shortage bigint, proportion double").withColumn("proportion", F.round("proportion", 9))


@query(f"with {STREAM} select sampling_order, document_id, token_count, tokens_before from stream")
def training_order(s, d):
    return _stream(s, d)[0].select("sampling_order", "document_id", "token_count", "tokens_before")


@query(f"""with {STREAM} select sampling_order, document_id, token_count, tokens_before, {CUT} - tokens_before consumed, token_count - ({CUT} - tokens_before) unconsumed, {CUT} - tokens_before = token_count eod_included
from stream where tokens_before < {CUT} and tokens_before + token_count >= {CUT}""")
def budget_boundary(s, d):
    stream, target = _stream(s, d)
    return subset.boundary(stream, target)


@query(f"with {PLAN} select * from plan")
def consumption_plan(s, d):
    return subset.plan(*_stream(s, d))


@query(f"""with {PLAN}, x as (select *, unnest(range(stream_offset // 512, (stream_end - 1) // 512 + 1)) block from plan)
select block, count(*) documents, sum(least(stream_end, (block + 1) * 512) - greatest(stream_offset, block * 512))::bigint tokens, arg_min(document_id, sampling_order) first_document from x group by 1""")
def stream_blocks(s, d):
    return subset.blocks(subset.plan(*_stream(s, d)))


@query(f"""with {PLAN}, t as (select max(stream_end) total from plan), b as (select total, unnest(range(0, (total - 1) // 65536 + 1)) batch from t)
select batch, batch * 65536 start_offset, least(total, (batch + 1) * 65536) end_offset, least(total, (batch + 1) * 65536) - batch * 65536 real_tokens, (batch + 1) * 65536 - least(total, (batch + 1) * 65536) padding from b""")
def micro_batches(s, d):
    return subset.micro_batches(subset.plan(*_stream(s, d)))


REFERENCES = "(select document_id, min(processed_file) processed_file, min(processed_row) processed_row, min(split) split from manifests where document_id is not null group by 1)"


@query(f"with {SELECTED} select c.document_id, c.token_count, m.processed_file, m.processed_row, m.split is distinct from 'train' mismatch from chosen c left join {REFERENCES} m using (document_id)")
def subset_references(s, d):
    m = table(s, d, "manifests").where("document_id is not null").groupBy("document_id").agg(F.min("processed_file").alias("processed_file"), F.min("processed_row").alias("processed_row"), F.min("split").alias("split"))
    return _chosen(s, d)[0].join(m, "document_id", "left").select("document_id", "token_count", "processed_file", "processed_row", (~F.col("split").eqNullSafe(F.lit("train"))).alias("mismatch"))


@query(rf"""with {UNIQUE}, l as (select document_id, source, source_group, replace(text, chr(10), ' ') line from docs where ('0x' || substr(sha256(document_id || chr(0) || '2026'), 1, 16))::ubigint % 1000 < 900)
select document_id, source, source_group, sha256(line) line_hash, row_number() over (order by document_id) - 1 selection_order from l""")
def tokenizer_corpus(s, d):
    from lexmill.operators.running import hex_prefix, row_index

    docs = unique(s, d).where(ids.split_of(ids.split_bucket(F.col("document_id"))) == "train")
    rows = docs.select("document_id", "source", "source_group", F.sha2(text.one_line(F.col("text")), 256).alias("line_hash"))
    return row_index(rows, [], ["document_id"], "selection_order", hex_prefix("document_id"))


@query(f"""with {COUNTS}, w as (select document_id, token_count n, unnest(range(0, ceil(greatest(token_count - 512, 0) / 256)::bigint + 1)) j from counts where token_count >= 2),
e as (select *, least(j * 256 + 512, n) stop, case when j = 0 then 1 else least((j - 1) * 256 + 512, n) end before from w)
select document_id, j::int "window", greatest(0, stop - 512)::bigint start, stop::bigint "end", (before - greatest(0, stop - 512))::bigint first_target from e""")
def eval_windows(s, d):
    return evaluation.windows(counts(s, d))


@query(f"with {COUNTS}, c as (select unnest([512, 1024, 2048]) context) select document_id, context, 2048 - context start, 2048 \"end\", context - 256 first_target from counts, c where token_count >= 2048")
def length_windows(s, d):
    return evaluation.length_windows(counts(s, d))


QUANTILES = " union all ".join(f"select source, {p}::double level, quantile_disc(token_count, {p}) tokens from counts where token_count is not null group by source" for p in (0.5, 0.95, 0.99))


@query(f"with {COUNTS} {QUANTILES}")
def token_quantiles(s, d):
    rows = counts(s, d).where("token_count is not null").groupBy("source")
    got = rows.agg(*[F.expr(f"percentile_disc({p}) within group (order by token_count)").cast("bigint").alias(str(i)) for i, p in enumerate((0.5, 0.95, 0.99))])
    return got.select("source", F.explode(F.array(*[F.struct(F.lit(p).alias("level"), F.col(str(i)).alias("tokens")) for i, p in enumerate((0.5, 0.95, 0.99))])).alias("x")).select("source", "x.*")
