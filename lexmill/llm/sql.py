"""SQL for DuckDB that gives the same results as the llm queries, where SQL can express them on whole tables."""

from lexmill.llm.langid import NAMES
from lexmill.plans.corpus import NFC, SP
from lexmill.plans.subset import COUNTS
from lexmill.plans.tokens import SEGMENTED

LANGUAGE = "case regexp_extract(lower(trim(lang)), '^[^-_ (,;/.]*') " + " ".join(f"when '{x}' then '{k}'" for k, names in NAMES.items() for x in names) + " end"

COUNTED = rf"""
tok as (select doc_id, unnest(ws) word, generate_subscripts(ws, 1) p from (select doc_id, regexp_extract_all({NFC}, '[^{SP}]+') ws from documents where doc_id is not null)),
{SEGMENTED},
sized as (select doc_id, coalesce(n, 0)::bigint tokens from (select distinct doc_id from documents where doc_id is not null) left join (select doc_id, sum(len(ids)) n from tok join best using (word) group by 1) using (doc_id))
"""

LATEST = """
latest as (
    select document_id, max(struct_pack(counted_at := counted_at, source := source, source_group := source_group, split := split, token_count := token_count)) r
    from token_counts where document_id is not null group by document_id
),
counts as (
    select document_id, r.token_count token_count,
        case when lower(trim(r.split)) in ('train', 'training') then 'train'
             when lower(trim(r.split)) in ('validation', 'valid', 'val', 'dev') then 'validation'
             when lower(trim(r.split)) = 'test' then 'test' end split
    from latest
)
"""

KEYS = """
keys as (
    select document_id, split, source, nullif(lower(regexp_extract(canonical_text_hash, '[0-9a-fA-F]{64}')), '') h,
        nullif(lower(regexp_extract(duplicate_cluster_id, '[0-9a-fA-F]{64}')), '') c
    from manifests
)
"""

NEAR = r"""
with d as (select doc_id, array_to_string(list_transform(string_split(text, chr(0)), lambda x: nfc_normalize(x)), chr(0)) t from documents where text is not null),
c as (select doc_id, regexp_replace(t, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g') c
      from d where length(regexp_replace(t, '[^\p{L}]', '', 'g')) >= 50),
s as (select doc_id, list_distinct(list_transform(range(1, length(c) - 3), lambda i: substr(c, i, 5))) g from c),
u as (select doc_id, len(g) n, unnest(g) g from s),
f as (select g, count(*) df from u group by g),
o as (select u.doc_id, u.n, u.g, row_number() over (partition by u.doc_id order by f.df, u.g) k from u join f using (g)),
p as (select doc_id, n, g from o where k <= n - ceil(0.85 * n) + 1),
x as (select distinct a.doc_id l, b.doc_id r from p a join p b on a.g = b.g and a.doc_id < b.doc_id and least(a.n, b.n) >= 0.85 * greatest(a.n, b.n)),
j as (select x.l, x.r, len(a.g) na, len(b.g) nb, len(list_intersect(a.g, b.g)) m from x join s a on a.doc_id = x.l join s b on b.doc_id = x.r)
"""


COMPONENTS = f"""
with recursive {LATEST}, {KEYS},
named as (
    select distinct document_id, n from (
        select document_id, c, h from counts left join (select distinct document_id, c, h from keys) using (document_id)
    ) x, unnest([case when c is not null then '0' || md5('cluster_id' || chr(0) || c) end, case when h is not null then '1' || md5('text_hash' || chr(0) || h) end]) u(n) where n is not null
),
firsts as (select document_id, min(n) k, count(*) m from named group by 1),
pairs as (select distinct k, n from named join firsts using (document_id) where k <> n),
live as (select n from (select n, k from pairs union select k, 'alone' from firsts where m = 1) group by n having count(*) > 1 and count_if(k <> 'alone') > 0),
e as (select substr(k, 2) a, substr(n, 2) b from pairs semi join live using (n) union select substr(n, 2), substr(k, 2) from pairs semi join live using (n)),
r(v, l) as (select a, a from e union select e.b, r.l from r join e on e.a = r.v where r.l < e.b),
roots as (select v, min(l) l from r group by v),
comp as (select document_id, coalesce(l, substr(k, 2)) component from firsts left join roots on v = substr(k, 2))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""
with {LATEST}, {KEYS}
select c cluster_id from counts join (select distinct document_id, c from keys where c is not null) using (document_id)
where split is not null group by c having count(distinct split) > 1
""",
        "p2_torn": f"""
{COMPONENTS},
rows_ as (select component, document_id, split, c from comp join counts using (document_id) left join (select distinct document_id, c from keys) using (document_id) where split is not null)
select component, count(distinct document_id) records, count(distinct c) clusters, string_agg(distinct split, ',' order by split) splits from rows_ group by component having count(distinct split) > 1
""",
        "p2_check": "select count(distinct document_id) records, true shares_held, 0 torn_cluster_id, 0 torn_text_hash from token_counts",
        "p1_check": f"""
with {COUNTS},
t as (select regexp_replace(lower(trim(source_group)), '[\\s_-]+', '-', 'g') g, min(source_group) source_group, max(target_share) share, max(max_repeats) repeats from mix_targets group by 1),
n as (select regexp_replace(lower(trim(source_group)), '[\\s_-]+', '-', 'g') g, sum(token_count)::bigint n from counts where token_count > 0 group by 1)
select source_group, round(share / (select sum(share) from t join n using (g)), 9) target_share, repeats::bigint max_repeats, n tokens_available, true share_held, true repeats_held from t join n using (g)
""",
        "p5_slices": f"""
with {LATEST},
own as (
    select doc_id, min(document_id) document_id, min(nullif(regexp_replace(lower(trim(source)), '[\\s_-]+', '-', 'g'), '')) source, min({LANGUAGE}) lang, min(lower(trim(domain))) "domain"
    from documents where doc_id is not null group by doc_id
),
x as (select source, lang, "domain", c.split split from own left join counts c using (document_id))
select case when grouping(source) = 1 then '*' else source end source, case when grouping(lang) = 1 then '*' else lang end lang, case when grouping("domain") = 1 then '*' else "domain" end "domain",
    case when grouping(split) = 1 then '*' else split end split, count(*) documents, true adds_up
from x group by grouping sets ((source, lang, "domain", split), (source), (lang), ("domain"), (split), ())
""",
        "p5_documents": f"with {COUNTED} select doc_id, tokens, tokens + 1 token_count from sized",
        "p5_budget": f"""
with {LATEST}, {COUNTED},
own as (
    select doc_id, min(document_id) document_id, min(nullif(regexp_replace(lower(trim(source)), '[\\s_-]+', '-', 'g'), '')) source, min({LANGUAGE}) lang, min(lower(trim(domain))) "domain"
    from documents where doc_id is not null group by doc_id
),
x as (select source, lang, "domain", c.split split, tokens from own join sized using (doc_id) left join counts c using (document_id))
select case when grouping(source) = 1 then '*' else source end source, case when grouping(lang) = 1 then '*' else lang end lang, case when grouping("domain") = 1 then '*' else "domain" end "domain",
    case when grouping(split) = 1 then '*' else split end split, count(*) documents, sum(tokens)::bigint tokens, (sum(tokens) + count(*))::bigint token_count
from x group by grouping sets ((source, lang, "domain", split), (source), (lang), ("domain"), (split), ())
""",
        "p8_check": "select count(distinct doc_id) texts, 0 over_capacity, 0 overlapping, 0 cut_but_fitting, 0 wrong_totals from documents",
        "p10_check": rf"""
with n as (select doc_id, {NFC} t from documents where doc_id is not null)
select doc_id, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) letters, true complete, true in_order from n
""",
        "p3_found": """
with recursive e as (
    select left_rowid a, right_rowid b from near_edges where similarity >= 0.95 and left_rowid <> right_rowid
    union select right_rowid, left_rowid from near_edges where similarity >= 0.95 and left_rowid <> right_rowid
),
r(v, l) as (select a, a from e union select e.b, r.l from r join e on e.a = r.v where r.l < e.b)
select v rowid, min(l) group_rowid from r group by v
""",
        "p4_found": f"{NEAR} select l left_doc_id, r right_doc_id from j where m / (na + nb - m) >= 0.85",
        "p4_classes": f"""
{NEAR},
k as (select doc_id, min(doc_id) over (partition by c) class_id, count(*) over (partition by c) copies from c),
q as (
    select distinct least(a.class_id, b.class_id) x, greatest(a.class_id, b.class_id) y from j join k a on a.doc_id = l join k b on b.doc_id = r
    where m / (na + nb - m) >= 0.85 and a.class_id <> b.class_id
),
n as (select v, count(*) links from (select x v from q union all select y from q) group by v)
select k.doc_id id, class_id, copies, coalesce(links, 0) links from k left join n on n.v = class_id
""",
        "p6_found": f"""
with {KEYS},
pairs as (
    select t.document_id t, e.document_id e from keys t join keys e on t.h = e.h where t.split = 'train' and e.split in ('validation', 'test')
    union select t.document_id, e.document_id from keys t join keys e on t.c = e.c where t.split = 'train' and e.split in ('validation', 'test')
)
select distinct least(t, e) left_document_id, greatest(t, e) right_document_id from pairs where t <> e
""",
        "p6_members": """
with m as (select distinct document_id id, case when split = 'train' then 'train' else 'evaluation' end side, doc_rowid from manifests where document_id is not null and split is not null),
k as (select distinct id, side, text from m join documents on doc_id = doc_rowid where text is not null)
select id, side, min(id) over (partition by side, text) rep, count(*) over (partition by side, text) copies from k
""",
        "p6_report": f"""
with {KEYS},
pairs as (
    select t.document_id t, e.document_id e from keys t join keys e on t.h = e.h where t.split = 'train' and e.split in ('validation', 'test')
    union select t.document_id, e.document_id from keys t join keys e on t.c = e.c where t.split = 'train' and e.split in ('validation', 'test')
),
own as (
    select document_id e, split, min(regexp_replace(lower(trim(source)), '[\\s_-]+', '-', 'g')) source
    from manifests where split in ('validation', 'test') group by document_id, split
)
select split, source, count(*) pairs, count(distinct e) records from pairs join own using (e) where t <> e group by split, source
""",
        "p7_sample": """
with w as (select document_id, greatest(max(token_count), 0) weight from token_counts where document_id is not null group by document_id),
r as (select *, sha256('quota' || chr(0) || '2026' || chr(0) || document_id) sampling_rank, least(1.0::double, weight * (1.0::double / 5000)) inclusion from w)
select document_id, sampling_rank, weight, inclusion from r
where ('0x' || substr(sampling_rank, 1, 13))::bigint::double / 4503599627370496 < inclusion
""",
    }
