"""Queries of ingest, profiles, exact and near copies, splits and manifests, with their SQL.

Every query runs over the whole of its tables. The SQL repeats the steps as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import ids, text
from lexmill.operators import ingest, manifest, near, profile
from lexmill.session import Stages, table, texts

LOW = 0.80


def raw(s: SparkSession, d: str) -> DataFrame:
    return ingest.raw_records(texts(s, d), table(s, d, "source_settings"))


def norm(s: SparkSession, d: str) -> DataFrame:
    return ingest.normalize(raw(s, d))


def unique(s: SparkSession, d: str) -> DataFrame:
    return ingest.unique(ingest.retained(norm(s, d)))


W, SP = text.WIDE_SPACE, text.SPACE
WORDS = f"len(regexp_extract_all(text, '[^{SP}]+'))"
LETTERS = r"length(regexp_replace(text, '[^\p{L}]', '', 'g'))"

RAW = """
raw as (
    select s.source, s.source_group, s.source_order, 'documents.parquet' shard, d.doc_id row_index, d.text
    from documents d join source_settings s on s.source = regexp_replace(lower(trim(d.source)), '[ _]', '-', 'g')
    where s.included_in_core
)"""
# nfc_normalize stops at a null character, so the pieces between are normalized
NFC = "array_to_string(list_transform(string_split(coalesce(text, ''), chr(0)), lambda x: nfc_normalize(x)), chr(0))"
NORM = (
    RAW
    + rf""",
n1 as (select *, {NFC} n1 from raw),
n2 as (select *, regexp_replace(n1, '\r\n?', chr(10), 'g') n2 from n1),
n3 as (select *, regexp_replace(n2, '{text.CONTROL}', '', 'g') n3 from n2),
n4 as (select *, regexp_replace(regexp_replace(n3, '[\x{{9}}\x{{20}}{W}]+', ' ', 'g'), '(?m)^ +| +$', '', 'g') n4 from n3),
norm as (
    select source, source_group, source_order, shard, row_index, regexp_replace(regexp_replace(n4, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') text,
        n1 <> coalesce(text, '') changed_nfc, n2 <> n1 changed_newlines, n4 <> n3 changed_horizontal_space, length(n2) - length(n3) removed_control_characters
    from n4
),
lettered as (select *, {LETTERS} letter_count from norm),
routed as (select *, case when text = '' then 'empty' when letter_count < 50 then 'short' end reason from lettered)"""
)
KEPT = (
    NORM
    + """,
kept as (
    select *, sha256(source || chr(0) || text) document_id, sha256(source || chr(0) || shard || chr(0) || row_index) raw_record_id, sha256(text) canonical_hash
    from routed where reason is null
)"""
)
UNIQUE = (
    KEPT
    + """,
ranked as (select *, row_number() over w rn, count(*) over (partition by canonical_hash) exact_group_size from kept
    window w as (partition by canonical_hash order by source_order, shard, row_index)),
docs as (select * from ranked where rn = 1)"""
)


def _flag_sql(t: str) -> str:
    urls = f"len(regexp_extract_all({t}, '{text.URL}'))"
    letter = "regexp_matches(c[i], '[\\p{L}\\p{Nl}\\p{No}]')"
    run = f"len(list_filter(range(1, greatest(len(c) - 4, 1)), lambda i: {letter} and c[i] = c[i+1] and c[i] = c[i+2] and c[i] = c[i+3] and c[i] = c[i+4] and c[i] = c[i+5])) > 0"
    cases = [
        f"contains({t}, chr(65533))", f"contains({t}, chr(0))", f"regexp_matches({t}, '{text.CONTROL}')",
        rf"regexp_matches({t}, '[\x{{b}}\x{{c}}\x{{1c}}-\x{{1f}}\x{{85}}{W}]')", f"regexp_matches({t}, '{text.MARKUP}')",
        f"{urls} > 0 and {urls} * 30 > greatest(length({t}), 1)", run,
        f"(length({t}) - length(replace({t}, chr(10), ''))) / greatest(length({t}), 1) > 0.05", f"length({t}) >= 100000", f"regexp_matches({t}, '{text.MOJIBAKE}')",
    ]
    return "list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in zip(text.FLAGS, cases)) + "], lambda x: x is not null)"


def flagged(source: str) -> str:
    return f"chars as (select *, string_split(lower(text), '') c from {source}), flagged as (select *, {_flag_sql('text')} flags from chars)"


SHINGLED = rf"""
compacted as (select *, trim(regexp_replace(text, '[{SP}]+', ' ', 'g')) k from docs),
shingled as (select *, list_distinct(list_transform(range(1, length(k) - 3), lambda i: substr(k, i, 5))) g from compacted)"""
PRINTS = rf"""
compacted as (select row_index, document_id, text, trim(regexp_replace(text, '[{SP}]+', ' ', 'g')) k from docs),
points as (select row_index, list_transform(string_split(k, ''), lambda c: unicode(c)::hugeint) p from compacted),
hashes as (
    select row_index, unnest(list_distinct(list_transform(range(1, len(p) - 3), lambda i:
        (p[i] * 1000012000054000108000081::hugeint + p[i+1] * 1000009000027000027::hugeint + p[i+2] * 1000006000009::hugeint + p[i+3] * 1000003::hugeint + p[i+4]) % 18446744073709551616::hugeint))) h
    from points
),
least_ as (select row_index, h, row_number() over (partition by row_index order by h) - 1 k from hashes qualify k < 32),
banded as (select row_index doc, k // 4 band, string_agg(h::varchar, ',' order by h) key from least_ group by 1, 2),
buckets as (select band, key, count(*) size from banded group by 1, 2),
candidates as (select distinct a.doc l, b.doc r from banded a join banded b on a.band = b.band and a.key = b.key and a.doc < b.doc)"""
SETS = rf"""
sets as (select row_index, length(text) n, list_distinct(list_transform(range(1, length(k) - 3), lambda i: substr(k, i, 5))) g from compacted
    where row_index in (select l from candidates union select r from candidates))"""


def edges_sql(threshold: float, pairs: str = "candidates") -> str:
    return f"""edges as (
    select l, r, m / (na + nb - m) similarity from (
        select c.l, c.r, len(a.g) na, len(b.g) nb, len(list_intersect(a.g, b.g)) m
        from {pairs} c join sets a on a.row_index = c.l join sets b on b.row_index = c.r
        where least(a.n, b.n) / greatest(a.n, b.n) >= {threshold}
    ) where m / (na + nb - m) >= {threshold}
)"""


CLUSTERS = """
both_ways as (select l a, r b from edges union select r, l from edges),
reach(v, x) as (select a, a from both_ways union select e.b, r.x from reach r join both_ways e on e.a = r.v where r.x < e.b),
labels as (select v, min(x) label from reach group by v),
named as (select v, label, document_id from labels join docs on row_index = v),
members as (
    select v rowid, sha256('near' || chr(0) || first_value(document_id) over w) cluster_id, first_value(v) over w representative_rowid,
        (v <> first_value(v) over w)::int removed
    from named window w as (partition by label order by document_id)
)"""
PROCESSED = """
processed as (
    select d.*, coalesce(m.cluster_id, d.document_id) duplicate_cluster_id from docs d left join members m on m.rowid = d.row_index where coalesce(m.removed, 0) = 0
),
bucketed as (select *, ('0x' || substr(sha256(duplicate_cluster_id || chr(0) || '2026'), 1, 16))::ubigint % 1000 bucket from processed),
assigned as (select *, case when bucket < 900 then 'train' when bucket < 950 then 'validation' else 'test' end split from bucketed)"""
GRAPH = f"with recursive {UNIQUE}, {PRINTS}, {SETS}, {edges_sql(LOW)}, {CLUSTERS}"
GRAPH_95 = f"with recursive {UNIQUE}, {PRINTS}, {SETS}, {edges_sql(0.95)}, {CLUSTERS}"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"with {NORM} select source, row_index, sha256(text) text_hash, length(text) characters, letter_count, {WORDS} words, changed_nfc, changed_newlines, changed_horizontal_space, removed_control_characters from routed")
def normalize_documents(s, d):
    cols = ["changed_nfc", "changed_newlines", "changed_horizontal_space", "removed_control_characters"]
    return norm(s, d).select("source", "row_index", F.sha2("text", 256).alias("text_hash"), F.length("text").alias("characters"), "letter_count", text.word_count(F.col("text")).alias("words"), *cols)


@query(f"with {RAW}, {flagged('raw where text is not null')} select source, row_index, array_to_string(flags, ',') flags from flagged")
def quality_flags(s, d):
    return raw(s, d).where("text is not null").select("source", "row_index", F.array_join(text.quality_flags(F.col("text")), ",").alias("flags"))


@query(f"with {RAW}, {flagged('raw where text is not null')} select source, flag, count(*) documents from (select source, unnest(flags) flag from flagged) group by all")
def quality_flag_histogram(s, d):
    return profile.flag_histogram(raw(s, d))


@query(f"with {RAW}, {flagged('raw where text is not null')}, x as (select source, shard, row_index, replace(substr(text, 1, 240), chr(10), ' ') excerpt, unnest(flags) flag from flagged) select source, flag, row_index, excerpt, position from (select *, row_number() over (partition by source, flag order by shard, row_index) position from x) where position <= 5")
def flag_examples(s, d):
    return profile.flag_examples(raw(s, d)).select("source", "flag", "row_index", "excerpt", "position")


@query(f"with {KEPT} select document_id, raw_record_id, canonical_hash, row_index from kept")
def document_ids(s, d):
    return ingest.retained(norm(s, d)).select("document_id", "raw_record_id", "canonical_hash", "row_index")


@query(f"with {NORM} select source, reason, count(*) records, sum(case when reason = 'empty' then 0 else letter_count end)::bigint letters from routed where reason is not null group by all")
def removals_by_reason(s, d):
    return ingest.removals(norm(s, d)).groupBy("source", "reason").agg(F.count("*").alias("records"), F.sum("letter_count").alias("letters"))


@query(f"with {UNIQUE} select document_id, source, row_index, exact_group_size, length(text) character_count, {WORDS} word_count, letter_count from docs")
def exact_dedup_documents(s, d):
    return unique(s, d).select("document_id", "source", "row_index", "exact_group_size", F.length("text").alias("character_count"), text.word_count(F.col("text")).alias("word_count"), "letter_count")


@query(f"with {UNIQUE} select r.raw_record_id, r.source, r.row_index, r.document_id, d.document_id representative_document_id, d.source representative_source from ranked r join docs d using (canonical_hash) where r.rn > 1")
def exact_removed(s, d):
    return ingest.exact_removed(ingest.retained(norm(s, d))).drop("shard", "canonical_hash")


GROUPS = f"with {KEPT}, g as (select canonical_hash, count(*) group_size, count(distinct source) sources, string_agg(distinct source, ',' order by source) source_list, arg_min(document_id, (source_order, shard, row_index)) representative_document_id from kept group by 1 having count(*) > 1)"


@query(f"{GROUPS} select * from g")
def exact_group_report(s, d):
    return ingest.exact_groups(ingest.retained(norm(s, d)))


@query(f"{GROUPS} select * from g where sources > 1")
def cross_source_groups(s, d):
    return ingest.exact_groups(ingest.retained(norm(s, d))).where("sources > 1")


@query(f"""with {UNIQUE}, u as (select source, count(*) n from docs group by 1)
select r.source, count(*) raw, count(*) filter (where changed_nfc) changed_nfc, count(*) filter (where changed_newlines) changed_newlines, count(*) filter (where changed_horizontal_space) changed_horizontal_space,
    sum(removed_control_characters)::bigint removed_control_characters, count(*) filter (where reason = 'empty') removed_empty, count(*) filter (where reason = 'short') removed_short, coalesce(any_value(u.n), 0) unique_documents,
    count(*) - count(*) filter (where reason = 'empty') - count(*) filter (where reason = 'short') - coalesce(any_value(u.n), 0) exact_duplicate
from routed r left join u using (source) group by r.source""")
def source_accounting(s, d):
    return ingest.accounting(norm(s, d))


@query(f"""with {RAW} select source, count(*) documents, count(*) filter (where text is null) null_documents, count(*) filter (where text = '') empty_documents,
    count(*) filter (where text <> '' and regexp_replace(text, '[{SP}]+', '', 'g') = '') whitespace_only_documents, coalesce(sum(length(text)), 0)::bigint characters, coalesce(sum({WORDS}), 0)::bigint words,
    coalesce(sum({LETTERS}), 0)::bigint letters, coalesce(sum(length(regexp_replace(text, '[^A-Za-z\\x{{c0}}-\\x{{d6}}\\x{{d8}}-\\x{{f6}}\\x{{f8}}-\\x{{24f}}]', '', 'g'))), 0)::bigint latin_letters
from raw group by source""")
def source_profile(s, d):
    return profile.source_profile(raw(s, d))


LEVEL_LIST = ", ".join(map(str, profile.LEVELS))


@query(f"""with {RAW}, h as (select source, length(text) v, count(*) n from raw where text is not null group by all),
c as (select *, sum(n) over (partition by source order by v) c, sum(n) over (partition by source) t from h), l as (select unnest([{LEVEL_LIST}]::double[]) level)
select source, level, min(v) "value" from c, l where c >= greatest(1, floor(t * level + 0.999999)) group by all""")
def length_quantiles(s, d):
    return profile.nearest_rank(raw(s, d), "source", F.length("text"))


@query(f"""with {RAW}, i as (select source, sha256(source || chr(0) || shard || chr(0) || row_index) raw_record_id from raw),
k as (select *, ('0x' || substr(sha256('2026' || chr(0) || raw_record_id), 1, 16))::ubigint rank from i)
select source, raw_record_id, position from (select *, row_number() over (partition by source order by rank, raw_record_id desc) position from k) where position <= 3000""")
def stable_sample(s, d):
    return profile.stable_sample(raw(s, d), 3000).select("source", "raw_record_id", "position")


@query(f"""with {UNIQUE}, w as (select document_id, unnest(regexp_extract_all(text, '{text.WORD}')) word, generate_subscripts(regexp_extract_all(text, '{text.WORD}'), 1) p from docs),
f as (select lower(replace(word, 'İ', 'i' || chr(775))) f, arg_min(word, (document_id, p)) word from w where length(word) >= 12 group by 1) select word, length(word) length from f order by length(word) desc, word desc limit 20""")
def longest_words(s, d):
    return profile.longest_words(unique(s, d))


@query(f"with {UNIQUE}, {SHINGLED} select document_id, len(g) shingles from shingled")
def shingle_counts(s, d):
    return unique(s, d).select("document_id", F.size(text.shingles(F.col("text"))).alias("shingles"))


@query(f"""with {UNIQUE}, {PRINTS} select band, count(*) colliding, count(*) filter (where size <= 10000) complete, count(*) filter (where size > 10000) skipped, max(size) largest,
    sum(case when size <= 10000 then size * (size - 1) // 2 else 0 end)::bigint pair_attempts from buckets where size > 1 group by band""")
def lsh_bucket_stats(s, d):
    return near.bucket_stats(near.bands(unique(s, d)))


@query(f"""with {UNIQUE}, {PRINTS} select case when size <= 10 then '2-10' when size <= 50 then '11-50' when size <= 100 then '51-100' when size <= 200 then '101-200'
    when size <= 500 then '201-500' when size <= 1000 then '501-1000' else '>1000' end bucket, count(*) buckets from buckets where size > 1 group by 1""")
def bucket_size_histogram(s, d):
    return near.bucket_histogram(near.bands(unique(s, d)))


@query(f"with {UNIQUE}, {PRINTS} select l, r from candidates")
def near_candidate_pairs(s, d):
    return near.candidates(near.bands(unique(s, d)))


def _edges(s, d, threshold):
    docs = unique(s, d)
    return docs, near.verified(near.candidates(near.bands(docs)), docs, threshold)


@query(f"with {UNIQUE}, {PRINTS}, {SETS}, {edges_sql(0.95)} select l, r, similarity from edges")
def near_edges_lsh(s, d):
    return _edges(s, d, 0.95)[1]


def _members(s, d, threshold=LOW):
    docs, edges = _edges(s, d, threshold)
    edges = Stages(s).put(edges)
    return docs, edges, Stages(s).put(near.clusters(edges, docs))


@query(f"{GRAPH} select rowid, cluster_id, representative_rowid, removed from members")
def near_clusters(s, d):
    return _members(s, d)[2]


@query(f"{GRAPH_95} select rowid, cluster_id, representative_rowid, removed from members")
def near_clusters_95(s, d):
    """Clusters at the reference's threshold."""
    return _members(s, d, near.THRESHOLD)[2]


@query(f"{GRAPH}, z as (select count(*) size from members group by cluster_id) select size, count(*) clusters from z group by size")
def cluster_distribution(s, d):
    return near.distribution(_members(s, d)[2])


@query(f"""{GRAPH}, p as (select cluster_id, count(*) n, count(*) filter (where removed = 0) kept, count(distinct representative_rowid) reps from members group by 1)
select count(*) clusters, count(*) filter (where kept <> 1) bad_kept, count(*) filter (where reps <> 1) bad_representative, count(*) filter (where n < 2) single from p""")
def graph_invariants(s, d):
    return near.invariants(_members(s, d)[2])


@query(f"{GRAPH} select count(*) crossing from edges e join members l on l.rowid = e.l join members r on r.rowid = e.r where l.cluster_id <> r.cluster_id")
def crossing_edges(s, d):
    _, edges, members = _members(s, d)
    return near.crossing_edges(edges, members).agg(F.count("*").alias("crossing"))


@query(f"""{GRAPH}, w as (select l.cluster_id, min(similarity) least_similarity, count(*) edges from edges e join members l on l.rowid = e.l group by 1)
select m.cluster_id, count(*) size, any_value(least_similarity) least_similarity, any_value(edges) edges from members m join w using (cluster_id) group by 1""")
def cluster_similarity(s, d):
    _, edges, members = _members(s, d)
    own = edges.join(members.select(F.col("rowid").alias("l"), "cluster_id"), "l").groupBy("cluster_id").agg(F.min("similarity").alias("least_similarity"), F.count("*").alias("edges"))
    return members.groupBy("cluster_id").agg(F.count("*").alias("size")).join(own, "cluster_id")


@query(f"{GRAPH}, z as (select cluster_id, count(*) size, count(*) filter (where removed = 1) removed from members group by 1 having count(*) > 2) select * from z order by size desc, cluster_id limit 25")
def largest_clusters(s, d):
    m = _members(s, d)[2].groupBy("cluster_id").agg(F.count("*").alias("size"), F.sum("removed").alias("removed"))
    return m.where("size > 2").orderBy(F.desc("size"), "cluster_id").limit(25)


def _processed(s, d, threshold=LOW):
    docs, _, members = _members(s, d, threshold)
    return manifest.processed(docs, members)


@query(f"""{GRAPH}, {PROCESSED} select document_id, source, source_group, duplicate_cluster_id, canonical_hash canonical_text_hash, split, raw_record_id, shard raw_shard, row_index raw_row_index,
    row_number() over (partition by split order by document_id) - 1 processed_row from assigned""")
def retained_manifest(s, d):
    return manifest.manifest(_processed(s, d))


@query(f"""{GRAPH_95}, {PROCESSED} select document_id, source, source_group, duplicate_cluster_id, canonical_hash canonical_text_hash, split, raw_record_id, shard raw_shard, row_index raw_row_index,
    row_number() over (partition by split order by document_id) - 1 processed_row from assigned""")
def retained_manifest_95(s, d):
    return manifest.manifest(_processed(s, d, near.THRESHOLD))


@query(f"""{GRAPH}, {PROCESSED} select case when grouping(split) = 1 then '*' else split end split, case when grouping(source) = 1 then '*' else source end source,
    count(*) documents, sum(length(text))::bigint characters, sum({WORDS})::bigint words from assigned group by rollup(split, source)""")
def split_summary(s, d):
    return manifest.summary(_processed(s, d))


@query(f"""{GRAPH_95}, {PROCESSED} select case when grouping(split) = 1 then '*' else split end split, case when grouping(source) = 1 then '*' else source end source,
    count(*) documents, sum(length(text))::bigint characters, sum({WORDS})::bigint words from assigned group by rollup(split, source)""")
def split_summary_95(s, d):
    return manifest.summary(_processed(s, d, near.THRESHOLD))


@query("""with r as (select document_id, ('0x' || substr(sha256(document_id || chr(0) || '2026'), 1, 16))::ubigint % 1000 b from (select distinct document_id from manifests))
select document_id, b::int bucket, case when b < 900 then 'train' when b < 950 then 'validation' else 'test' end split from r""")
def split_assignment(s, d):
    b = ids.split_bucket(F.col("document_id"))
    return table(s, d, "manifests").select("document_id").distinct().select("document_id", b.alias("bucket"), ids.split_of(b).alias("split"))


@query("""with x as (select 'document_id' field, document_id "value", split from manifests union all select 'canonical_text_hash', canonical_text_hash, split from manifests union all select 'duplicate_cluster_id', duplicate_cluster_id, split from manifests)
select field, "value", string_agg(distinct split, ',' order by split) splits from (select field, coalesce(nullif(lower(regexp_extract("value", '[0-9a-fA-F]{64}')), ''), "value") "value", split from x)
where "value" is not null group by all having count(distinct split) > 1""")
def cross_split_values(s, d):
    return manifest.shared_between_splits(table(s, d, "manifests"), ["document_id", "canonical_text_hash", "duplicate_cluster_id"])


@query("""with p as (select processed_file, processed_row, count(*) n, count(*) filter (where not regexp_matches(document_id, '^[0-9a-f]{64}$')) bad from manifests group by all)
select processed_file, sum(n)::bigint records, sum(bad)::bigint bad_ids, count(*) filter (where n > 1) repeated_positions, min(processed_row) first_row, max(processed_row) last_row from p group by 1""")
def manifest_problems(s, d):
    return manifest.row_problems(table(s, d, "manifests"))


@query(f"""with {UNIQUE}, {PRINTS}, {SETS}, {edges_sql(0.8)}, t as (select unnest([0.8, 0.85, 0.9, 0.95]::double[]) threshold)
select threshold, least(a.source, b.source) source_a, greatest(a.source, b.source) source_b, count(*) pairs
from t join edges on similarity >= threshold join docs a on a.row_index = l join docs b on b.row_index = r group by all""")
def pilot_thresholds(s, d):
    docs, edges = _edges(s, d, LOW)
    src = docs.select("row_index", "source")
    levels = F.explode(F.array(*[F.lit(t) for t in (0.8, 0.85, 0.9, 0.95)])).alias("threshold")
    both = edges.join(src.toDF("l", "sl"), "l").join(src.toDF("r", "sr"), "r").select("similarity", "sl", "sr", levels).where("similarity >= threshold")
    return both.groupBy("threshold", F.least("sl", "sr").alias("source_a"), F.greatest("sl", "sr").alias("source_b")).agg(F.count("*").alias("pairs"))


EXACT = f"""
compacted as (select row_index, document_id, text, trim(regexp_replace(text, '[{SP}]+', ' ', 'g')) k from docs),
sets as (select row_index, length(text) n, list_distinct(list_transform(range(1, length(k) - 3), lambda i: substr(k, i, 5))) g from compacted),
each as (select row_index, len(g) size, unnest(g) g from sets),
held as (select g, count(*) df from each group by g),
rare as (select row_index, size, g from (select e.row_index, e.size, e.g, row_number() over (partition by e.row_index order by h.df, e.g) k from each e join held h using (g)) where k <= size - ceil(0.8 * size) + 1),
close_ as (select distinct a.row_index l, b.row_index r from rare a join rare b on a.g = b.g and a.row_index < b.row_index and least(a.size, b.size) >= 0.8 * greatest(a.size, b.size)),
{edges_sql(LOW, 'close_')}"""


def _exact(s, d):
    docs = unique(s, d)
    return docs, near.exact_edges(docs, LOW)


@query(f"with {UNIQUE}, {EXACT} select l, r, similarity from edges")
def near_edges_exact(s, d):
    return _exact(s, d)[1]


@query(f"""with {UNIQUE}, {EXACT.replace('edges as', 'exact as')}, {PRINTS.replace('compacted as', 'compacted2 as').replace('from compacted)', 'from compacted2)')},
t as (select unnest([0.8, 0.85, 0.9, 0.95]::double[]) threshold)
select threshold, count(*) eligible, count(c.l) found, count(c.l) / count(*) recall from t join exact e on similarity >= threshold left join candidates c on c.l = e.l and c.r = e.r group by threshold""")
def candidate_recall(s, d):
    docs, exact = _exact(s, d)
    return near.recall(exact, near.candidates(near.bands(docs)))


@query(f"""with {UNIQUE}, {EXACT}, b as (select row_index, ('0x' || substr(sha256(document_id || chr(0) || '2026'), 1, 16))::ubigint % 1000 b from docs),
a as (select row_index, case when b < 900 then 'train' when b < 950 then 'validation' else 'test' end split from b)
select e.l, e.r, x.split split_l, y.split split_r, e.similarity from edges e join a x on x.row_index = e.l join a y on y.row_index = e.r where x.split <> y.split""")
def cross_split_leakage(s, d):
    """What a split by document would leak: near pairs whose ends it tears apart."""
    docs, exact = _exact(s, d)
    return near.leakage(exact, docs.withColumn("split", ids.split_of(ids.split_bucket(F.col("document_id")))))


@query(f"""{GRAPH}, full_sets as (select row_index, list_distinct(list_transform(range(1, length(k) - 3), lambda i: substr(k, i, 5))) g from compacted),
w as (select a.cluster_id, a.rowid l, b.rowid r, a.representative_rowid rep from members a join members b on a.cluster_id = b.cluster_id and a.rowid < b.rowid),
s as (select w.*, len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) similarity from w join full_sets x on x.row_index = l join full_sets y on y.row_index = r)
select cluster_id, count(*) pairs, min(similarity) least_pair, min(case when l = rep or r = rep then similarity end) least_to_representative from s group by 1""")
def cluster_transitivity(s, d):
    docs, _, members = _members(s, d)
    return near.transitivity(members, docs)


LETTERS_AZ = "əğıöüşçƏĞİÖÜŞÇ"


@query(f"with {RAW}, l as (select unnest(string_split('{LETTERS_AZ}', '')) letter) select source, letter, sum(length(text) - length(replace(text, letter, '')))::bigint occurrences from raw, l where text is not null group by all")
def azerbaijani_letters(s, d):
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("letter"), (F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).alias("n")) for c in LETTERS_AZ])).alias("x")
    return raw(s, d).where("text is not null").select("source", each).groupBy("source", "x.letter").agg(F.sum("x.n").alias("occurrences"))


@query("""with m as (select distinct processed_file, processed_row, document_id from manifests), z as (select processed_file, max(processed_row) last_, count(*) "rows" from m group by 1)
select m.processed_file, any_value(z.rows) "rows", count(*) filter (where m.processed_row < z.last_ and n.document_id is null) gaps, count(*) filter (where n.document_id <= m.document_id) disorder
from m join z using (processed_file) left join m n on n.processed_file = m.processed_file and n.processed_row = m.processed_row + 1 group by 1""")
def manifest_order(s, d):
    return manifest.order_problems(table(s, d, "manifests"), "processed_file", "processed_row", "document_id")
