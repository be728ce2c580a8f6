"""Queries of token ids: encoding, the stream, its blocks and batches, evaluation windows and caches, and audits of the vocabulary, with their SQL.

The SQL finds each word's best segmentation by the same steps: spans of the word that are pieces, folded in order into the best way up to each place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import ids, text
from lexmill.functions.tokens import encoded, encoded_ids, piece_counter, piece_encoder
from lexmill.operators import profile, stream
from lexmill.plans.corpus import SP, UNIQUE, unique
from lexmill.session import Stages, table

#: Documents of the vocabulary's audit, as the reference has it.
AUDITED = 100_000

SEGMENTED = """
vocab as (select piece, piece_id id, score s from tokenizer_pieces where piece_id > 1 and piece is not null and score is not null and piece <> ''),
lim as (select max(length(piece)) longest, min(s) - 10 bad from vocab),
words as (select distinct word from tok),
w as (select word, '▁' || word w, length(word) + 1 n from words),
spans as (select word, w, i, unnest(range(i + 1, least(n, i + (select longest from lim)) + 1)) j from (select word, w, n, unnest(range(0, n)) i from w)),
known as (select word, i, j, s, id from spans join vocab on piece = substr(w, i::int + 1, (j - i)::int)),
edges_ as (
    select word, i, j, s, id, false lost from known
    union all select word, i, i + 1, (select bad from lim), 0, true from (select word, unnest(range(0, n)) i from w) x where not exists (select 1 from known k where k.word = x.word and k.i = x.i and k.j = x.i + 1)
),
best as (
    select word, list_reduce(list(struct_pack(i := i::int, j := j::int, s := s, id := id::int, lost := lost, best := null::struct(s double, ids int[], lost boolean)[]) order by i, lost, j),
        lambda a, x: struct_pack(i := x.i, j := x.j, s := x.s, id := x.id, lost := x.lost, best := case when a.best[x.i + 1].s + x.s > coalesce(a.best[x.j + 1].s, '-inf'::double) then
            list_concat(a.best[1:x.j], [struct_pack(s := a.best[x.i + 1].s + x.s, ids := case when x.lost and a.best[x.i + 1].lost then a.best[x.i + 1].ids else list_append(a.best[x.i + 1].ids, x.id) end, lost := x.lost)], a.best[x.j + 2:]) else a.best end),
        struct_pack(i := 0, j := 0, s := 0::double, id := 0, lost := false, best := list_prepend(struct_pack(s := 0::double, ids := []::int[], lost := false),
            list_transform(range(0, length(any_value(word)) + 1), lambda z: null::struct(s double, ids int[], lost boolean))))).best[-1].ids ids
    from edges_ group by word
)"""
TOKENIZED = rf"""{UNIQUE},
tok as (select document_id, unnest(ws) word, generate_subscripts(ws, 1) p from (select document_id, regexp_extract_all(nfc_normalize(text), '[^{SP}]+') ws from docs)),
{SEGMENTED},
enc as (
    select document_id, source, text, case when b < 900 then 'train' when b < 950 then 'validation' else 'test' end split, coalesce(x.ids, []::int[]) plain, list_append(coalesce(x.ids, []::int[]), 1) ids
    from (select *, ('0x' || substr(sha256(document_id || chr(0) || '2026'), 1, 16))::ubigint % 1000 b from docs)
        left join (select document_id, flatten(list(ids order by p)) ids from tok join best using (word) group by 1) x using (document_id)
)"""
STREAM = f"""{TOKENIZED},
ranked_ as (select *, len(ids) tokens, sha256('order' || chr(0) || '2026' || chr(0) || document_id) r from enc),
stream as (select document_id, ids, tokens, row_number() over (order by r, document_id) - 1 sampling_order, (sum(tokens) over (order by r, document_id) - tokens)::bigint stream_offset from ranked_)"""
CUT = f"""{STREAM},
goal as (select floor(sum(tokens) * 0.9::double)::bigint target from stream),
part as (select document_id, ids[1:least(tokens, target - stream_offset)] ids, least(tokens, target - stream_offset) tokens, sampling_order, stream_offset from stream, goal where stream_offset < target),
flat as (select flatten(list(ids order by stream_offset)) f from part),
cut_blocks as (select block, f[block * 512 + 1:(block + 1) * 512] ids from flat, (select unnest(range(0, (select sum(tokens) from part)::bigint // 512 + case when (select sum(tokens) from part)::bigint % 512 > 0 then 1 else 0 end)) block))"""
H = "md5(array_to_string({}, ','))"
WINDOWS = f"""{TOKENIZED},
w_ as (select document_id, ids, len(ids) n, unnest(range(0, ceil(greatest(len(ids) - 512, 0) / 256)::bigint + 1)) j from enc where len(ids) >= 2),
placed_ as (select *, least(j * 256 + 512, n) stop, greatest(least(j * 256 + 512, n) - 512, 0) begin_, case when j = 0 then 1 else least((j - 1) * 256 + 512, n) end before from w_),
windows_ as (select document_id, j, ids[begin_ + 1:stop] i, list_concat(list_transform(range(0, before - begin_), lambda z: -100), ids[before + 1:stop]) l, stop - before targets, ceil((stop - begin_) / 64)::int bucket from placed_)"""
INDEX = f"{TOKENIZED}, index_ as (select split, document_id, len(ids) tokens, row_number() over (partition by split order by document_id) - 1 processed_row, (sum(len(ids)) over (partition by split order by document_id) - len(ids))::bigint \"offset\" from enc)"
AUDIT = f"{TOKENIZED}, audited as (select * from enc where split = 'train' order by document_id limit {AUDITED})"
FERTILITY = f"""count(*) documents, sum(len(plain)) / greatest(sum(len(regexp_extract_all(text, '[^{SP}]+'))), 1) tokens_per_word, sum(length(text)) / greatest(sum(len(plain)), 1) characters_per_token,
    sum(len(list_filter(plain, lambda x: x = 0))) / greatest(sum(len(plain)), 1) unknown_rate"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _docs(s, d) -> DataFrame:
    return unique(s, d).withColumn("split", ids.split_of(ids.split_bucket(F.col("document_id"))))


def _ids(s, d) -> DataFrame:
    """document_id, source, split, ids (with the end mark) of the kept texts; encoded and written once."""
    docs = _docs(s, d)
    got = encoded_ids(docs, "document_id", "text", piece_encoder(table(s, d, "tokenizer_pieces")), stream.END)
    slim = Stages(s).put(docs.select("document_id", "source", "split"))
    return Stages(s).put(got.join(slim, "document_id"))


def _plain() -> F.Column:
    return F.slice("ids", F.lit(1), F.size("ids") - 1)


def _unknown() -> F.Column:
    return F.size(F.filter("ids", lambda x: x == 0))


@query(f"with {TOKENIZED} select document_id, len(ids) tokens, len(list_filter(ids, lambda x: x = 0)) unknown_tokens, {H.format('ids')} ids_hash from enc")
def token_ids(s, d):
    return _ids(s, d).select("document_id", F.size("ids").alias("tokens"), _unknown().alias("unknown_tokens"), stream.hashed("ids").alias("ids_hash"))


@query(f"with {TOKENIZED} select document_id, len(ids) token_count, len(list_filter(plain, lambda x: x = 0)) unknown_tokens from enc")
def encoded_token_counts(s, d):
    """token_count with the end mark, and unknown tokens, of every kept text under the vocabulary of the tables."""
    return encoded(unique(s, d), "document_id", "text", piece_counter(table(s, d, "tokenizer_pieces")))


def _fertility(docs, got):
    rows = docs.select("document_id", "source", F.length("text").alias("c"), text.word_count(F.col("text")).alias("w")).join(got, "document_id")
    sums = rows.rollup("source").agg(F.count("*").alias("documents"), F.sum("token_count").alias("t"), F.sum("w").alias("w"), F.sum("c").alias("c"), F.sum("unknown_tokens").alias("u"), F.count_if(F.col("unknown_tokens") > 0).alias("lost"), F.grouping("source").alias("g"))
    plain = F.col("t") - F.col("documents")
    return sums.select(F.when(F.col("g") == 1, "*").otherwise(F.col("source")).alias("source"), "documents", (plain / F.greatest("w", F.lit(1))).alias("tokens_per_word"), (F.col("c") / F.greatest(plain, F.lit(1))).alias("characters_per_token"), (F.col("u") / F.greatest(plain, F.lit(1))).alias("unknown_rate"), F.col("lost").alias("documents_with_unknown"))


@query(f"with {TOKENIZED} select case when grouping(source) = 1 then '*' else source end source, {FERTILITY}, sum(len(list_filter(plain, lambda x: x = 0))) <= 0.001 * sum(len(plain)) passes_gate from enc group by rollup(source)")
def tokenizer_fertility(s, d):
    """Tokens a word, characters a token and the share of unknown tokens, of each source and of all."""
    docs = unique(s, d)
    got = encoded(docs, "document_id", "text", piece_counter(table(s, d, "tokenizer_pieces")))
    return _fertility(docs, got).drop("documents_with_unknown").withColumn("passes_gate", F.col("unknown_rate") <= 0.001)


@query(f"with {AUDIT} select case when grouping(source) = 1 then '*' else source end source, {FERTILITY}, count_if(len(list_filter(plain, lambda x: x = 0)) > 0)::bigint documents_with_unknown from audited group by rollup(source)")
def tokenizer_audit(s, d):
    """The same of the first training documents in id order, as the audit of a vocabulary takes them."""
    docs = _first_train(s, d)
    return _fertility(docs, encoded(docs, "document_id", "text", piece_counter(table(s, d, "tokenizer_pieces"))))


def _first_train(s, d):
    return Stages(s).put(_docs(s, d).where("split = 'train'").orderBy("document_id").limit(AUDITED))


@query(f"""with {AUDIT}, l as (select length(replace(piece, '▁', '')) v, count(*) n from (select unnest(plain) id from audited) x join tokenizer_pieces on piece_id = id group by 1),
c as (select v, sum(n) over (order by v) c, sum(n) over () t from l), p as (select unnest([{", ".join(map(str, profile.LEVELS))}]::double[]) level)
select level, min(v) "value" from c, p where c >= greatest(1, floor(t * level + 0.999999)) group by level""")
def piece_lengths(s, d):
    """Quantiles of the lengths of the pieces that the audited documents are cut into, the word mark aside."""
    pieces = table(s, d, "tokenizer_pieces")
    got = encoded_ids(_first_train(s, d), "document_id", "text", piece_encoder(pieces))
    used = got.select(F.explode("ids").alias("piece_id")).groupBy("piece_id").agg(F.count("*").alias("n"))
    lengths = used.join(pieces, "piece_id").select(F.length(F.replace("piece", F.lit("▁"), F.lit(""))).alias("v"), "n")
    return profile.nearest_rank_counts(lengths.withColumn("g", F.lit(0)), "g", "v", "n").drop("g")


@query(f"""with {AUDIT.replace("tok as (", "tok0 as (", 1).replace("words as (select distinct word from tok)", "words as (select word from tok0 union select word from top)").replace("tok join best", "tok0 join best").replace("vocab as", f'''w_ as (select document_id, unnest(regexp_extract_all(text, '{text.WORD}')) word, generate_subscripts(regexp_extract_all(text, '{text.WORD}'), 1) p from
    (select * from docs where ('0x' || substr(sha256(document_id || chr(0) || '2026'), 1, 16))::ubigint % 1000 < 900 order by document_id limit {AUDITED})),
f_ as (select lower(replace(word, 'İ', 'i' || chr(775))) f, arg_min(word, (document_id, p)) word from w_ where length(word) >= 12 group by 1),
top as (select word from f_ order by length(word) desc, word desc limit 12),
vocab as''', 1)} select word, len(ids) piece_count, array_to_string(ids, ' ') ids from top join best using (word)""")
def long_word_pieces(s, d):
    """The twelve longest words of the audited documents and their pieces."""
    encoder = piece_encoder(table(s, d, "tokenizer_pieces"))
    top = profile.longest_words(_first_train(s, d), k=12).select("word")
    return encoded_ids(top, "word", "word", encoder).select("word", F.size("ids").alias("piece_count"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query(f"with {AUDIT}, v as (select count(*) pieces, count(distinct piece_id) ids, max(piece_id) + 1 size from tokenizer_pieces) select pieces, ids = size and pieces = size complete, (select sum(len(list_filter(plain, lambda x: x = 0))) <= 0.001 * sum(len(plain)) from audited) unknown_rate_holds from v")
def tokenizer_gate(s, d):
    """Whether the vocabulary is whole (each id once, without gaps) and unknown tokens are at most one in a thousand."""
    v = table(s, d, "tokenizer_pieces").agg(F.count("*").alias("pieces"), F.count_distinct("piece_id").alias("ids"), (F.max("piece_id") + 1).alias("size"))
    rate = tokenizer_audit(s, d).where("source = '*'").select((F.col("unknown_rate") <= 0.001).alias("unknown_rate_holds"))
    return v.join(F.broadcast(rate), how="left").select("pieces", ((F.col("ids") == F.col("size")) & (F.col("pieces") == F.col("size"))).alias("complete"), "unknown_rate_holds")  # one row each


@query(f"""with {TOKENIZED} select case when grouping(split) = 1 then '*' else split end split, case when grouping(source) = 1 then '*' else source end source, count(*) documents, sum(len(ids))::bigint tokens,
    sum(len(list_filter(ids, lambda x: x = 0)))::bigint unknown_tokens, count_if(len(list_filter(ids, lambda x: x = 0)) > 0)::bigint documents_with_unknown, sum(len(list_filter(ids, lambda x: x = 0))) / sum(len(ids)) unknown_rate from enc group by rollup(split, source)""")
def token_unknowns(s, d):
    rows = _ids(s, d).select("split", "source", F.size("ids").alias("n"), _unknown().alias("u"))
    sums = rows.rollup("split", "source").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.sum("u").alias("unknown_tokens"), F.count_if(F.col("u") > 0).alias("documents_with_unknown"), F.grouping_id().alias("g"))
    return sums.select(F.when(F.col("g") == 3, "*").otherwise(F.col("split")).alias("split"), F.when(F.col("g") >= 1, "*").otherwise(F.col("source")).alias("source"), "documents", "tokens", "unknown_tokens", "documents_with_unknown", (F.col("unknown_tokens") / F.col("tokens")).alias("unknown_rate"))


@query(f"with {TOKENIZED}, v as (select max(piece_id) + 1 size from tokenizer_pieces) select document_id, len(ids) tokens, list_min(ids) least, list_max(ids) greatest, list_min(ids) >= 0 and list_max(ids) < least(size, 65536) in_bounds from enc, v")
def token_bounds(s, d):
    size = table(s, d, "tokenizer_pieces").agg(F.max("piece_id")).first()[0] or 0
    return stream.bounds(_ids(s, d), size + 1)


@query(f"with {STREAM} select sampling_order, document_id, tokens, stream_offset from stream")
def token_stream(s, d):
    return stream.placed(_ids(s, d)).select("sampling_order", "document_id", "tokens", "stream_offset")


def _cut(s, d):
    """The stream up to nine tenths of its tokens, so that the last document is cut."""
    rows = Stages(s).put(stream.placed(_ids(s, d)))
    return stream.truncated(rows, int((rows.agg(F.sum("tokens")).first()[0] or 0) * 0.9))


@query(f"with {CUT}, n_ as (select block, count(*) documents from (select unnest(range(stream_offset // 512, (stream_offset + tokens - 1) // 512 + 1)) block from part) group by 1) select block, documents, len(ids) tokens, {H.format('ids')} ids_hash from cut_blocks join n_ using (block)")
def block_ids(s, d):
    return stream.blocks(_cut(s, d)).select("block", "documents", F.size("ids").alias("tokens"), stream.hashed("ids").alias("ids_hash"))


@query(f"""with {CUT}, t as (select sum(tokens)::bigint total from part), r as (select unnest(range(0, ceil((select max(block) + 1 from cut_blocks) / 128)::bigint * 128)) block),
x as (select block, coalesce(ids, []::int[]) ids from r left join cut_blocks using (block))
select block // 128 batch, block % 128 "row", {H.format('list_concat(ids, list_transform(range(0, 512 - len(ids)), lambda z: 1))')} input_hash, {H.format('list_concat(ids, list_transform(range(0, 512 - len(ids)), lambda z: -100))')} label_hash,
    len(ids) real_tokens, least((block // 128 + 1) * 65536, total) end_offset from x, t""")
def batch_ids(s, d):
    rows = stream.batches(Stages(s).put(stream.blocks(_cut(s, d))))
    return rows.select("batch", "row", stream.hashed("input_ids").alias("input_hash"), stream.hashed("labels").alias("label_hash"), "real_tokens", "end_offset")


@query(f"with {WINDOWS} select document_id, j::int \"window\", {H.format('i')} input_hash, {H.format('l')} label_hash, targets, bucket from windows_")
def window_tokens(s, d):
    return stream.window_ids(_ids(s, d)).select("document_id", "window", stream.hashed("input_ids").alias("input_hash"), stream.hashed("labels").alias("label_hash"), "targets", "bucket")


@query(f"with {TOKENIZED} select document_id, len(ids) - 1 expected, len(ids) - 1 counted, true holds from enc where len(ids) >= 2")
def target_identity(s, d):
    rows = _ids(s, d)
    return stream.target_identity(rows, stream.window_ids(rows))


@query(f"with {INDEX} select * from index_")
def cache_index(s, d):
    return stream.cache_index(_ids(s, d))


@query(f"with {INDEX} select split, count(*) documents, sum(tokens)::bigint tokens_including_eod, (sum(tokens) - count(*))::bigint primary_targets, count_if(tokens >= 2048)::bigint length_documents, (2 * sum(tokens))::bigint bytes, sum(tokens)::bigint // 512 full_blocks, sum(tokens)::bigint % 512 tail from index_ group by 1")
def cache_metadata(s, d):
    return stream.cache_metadata(stream.cache_index(_ids(s, d)))


@query(f"""with {INDEX}, s as (select document_id, stream_offset, tokens from part),
c as (select document_id, split || '.bin' processed_file, processed_row from index_)
select document_id, processed_file, processed_row, stream_offset, tokens, t.n stored_tokens, null::varchar problem from s join c using (document_id) join (select document_id, len(ids) n from enc) t using (document_id)""".replace(f"with {INDEX}", f"with {CUT}, index_ as (select split, document_id, row_number() over (partition by split order by document_id) - 1 processed_row from enc)"))
def stream_positions(s, d):
    """The plan of the stream joined with the stored documents by file and row: who stands where, and what is wrong (nothing, here)."""
    rows = _ids(s, d)
    index = Stages(s).put(stream.cache_index(rows).select("document_id", F.concat("split", F.lit(".bin")).alias("processed_file"), "processed_row", F.col("tokens").alias("token_count")))
    placed = Stages(s).put(stream.placed(rows).join(index.drop("token_count"), "document_id"))
    return stream.positions(placed, int((placed.agg(F.sum("tokens")).first()[0] or 0) * 0.9), index)


ROWS = "(select distinct document_id, source, source_group, split, processed_file, processed_row from manifests where document_id is not null)"


@query(f"""with {UNIQUE}, a as (select document_id, source, row_number() over (order by document_id) - 1 "position" from docs), b as (select document_id, regexp_replace(lower(trim(source)), '[ _]', '-', 'g') source, row_number() over (order by document_id) - 1 "position" from (select distinct document_id, source from documents where document_id is not null)),
z as (select coalesce(a.position, b.position) "position", a.document_id x, b.document_id y, a.source sx, b.source sy from a full join b on a.position = b.position),
r as (select "position", case when x is null then 'manifest only' when y is null then 'corpus only' else 'both' end side, case when x is null or y is null then [null::varchar] else list_filter([case when x is distinct from y then 'document_id' end, case when sx is distinct from sy then 'source' end], lambda v: v is not null) end f from z)
select "position", side, unnest(f) field from r""")
def corpus_zip(s, d):
    """The kept documents and the raw table's rows set side by side by position, and every field in which they differ: the check that two tables agree row for row."""
    from lexmill.operators.running import hex_prefix, row_index

    corpus = row_index(unique(s, d).select("document_id", "source"), [], ["document_id"], "position", hex_prefix("document_id"))
    raw = table(s, d, "documents").where("document_id is not null").select("document_id", text.source_key(F.col("source")).alias("source")).distinct()
    return stream.zipped(corpus, row_index(raw, [], ["document_id"], "position", hex_prefix("document_id")), ["position"], ["document_id", "source"])
