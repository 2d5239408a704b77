"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe_reuse, embedding_dedup, license_scan, maxent, mixing, near_dup, prefix_trie, quality, quotes, rans, toxicity
from .common import read_documents, remainder, written


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.threads(quotes.linked(_read(spark, sf_dir, "conversations")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    model = quality.fit(docs, _read(spark, sf_dir, "labels"), folds=4, held_out=2)
    out = quality.score(docs, model, 0.7)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_reuse.encode(read_documents(spark, sf_dir), word_bpe_path(), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(read_documents(spark, sf_dir), folds=5, held_out=1)


def op5_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = rans.new_folder(spark)
    rans.write_files(read_documents(spark, sf_dir), word_bpe_path(), folder)
    return rans.read_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_documents(spark, sf_dir))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(_read(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), folds=5, held_out=0)
    out = toxicity.score(docs, model, 0.5)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(read_documents(spark, sf_dir), width=4, percent=80)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings")).drop("n_compared")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.link_counts(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_read(spark, sf_dir, "conversations"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(read_documents(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (op1_quotation_links, op2_quality_classifier, op3_bpe, op4_maxent_scores, op5_rans_files, op6_source_mix, op7_embedding_dedup, op8_toxicity, op9_near_duplicates, op10_nearest, op11_token_alignment, op12_prefix_trie, op13_license_scan)}

#: Sources by code point, null last; targets by a level that is raised over the sources in the order in which they reach their limits.
#: Then the schedule: points on a grid of 2**31, slots of 16 words, ranked by source, and each document in each of three passes.
OP6_SQL = """
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from sized group by source),
o as (select *, row_number() over (order by source nulls last) - 1 as k from s),
w as (select *, [5, 2, 1][k % 3 + 1]::double as w, source_size * 3 as cap from o),
c as (select *, sum(source_size) over () as total, sum(w) over () as all_w,
  sum(cap) over (order by cap / w, k rows unbounded preceding) as sum_cap, sum(w) over (order by cap / w, k rows unbounded preceding) as sum_w from w),
l as (select *, (total - (sum_cap - cap)) / (all_w - sum_w + w) as level from c),
t as (select source, k, source_size, least(cap::double, coalesce((select arg_min(level, sum_w) from l where cap / w >= level) * w, cap::double)) as target from l),
e as (select k, floor(sum(target) over (order by k rows unbounded preceding) / sum(target) over () * 2147483648)::bigint as hi from t where target > 0),
g as (select k, coalesce(lag(hi) over (order by k), 0) as lo, hi from e),
x as (select i as slot, i % 2147483648 * 1327217885 % 2147483648 as x from (select unnest(range((select sum(source_size)::bigint // 16 + 1 from t))) as i)),
r as (select k, slot, row_number() over (partition by k order by slot) - 1 as rank from x join g on x >= lo and x < hi),
n as (select k, count(*) * 16 as given from r group by k),
p as (select row_number() over () as row, d.doc_id, d.size, t.k, t.source_size, t.target, coalesce(n.given, 0) as given,
  sum(d.size) over (partition by t.k order by md5('mix' || coalesce(d.doc_id::varchar, '')), d.doc_id, d.size rows unbounded preceding) - d.size as start
  from sized d join t on d.source is not distinct from t.source left join n on n.k = t.k),
v as (select row, k, start + pass * source_size as pos, least(size, given - (start + pass * source_size)) as words
  from p, (select unnest([0, 1, 2]) as pass) where size > 0 and start + pass * source_size < given),
y as (select v.row, sum(words)::bigint as taken, min(slot) as first_slot, sum((pos + words - 1) // 16 - pos // 16 + 1)::bigint as n_slots
  from v join r on r.k = v.k and r.rank = v.pos // 16 group by v.row)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken, first_slot, coalesce(n_slots, 0)::bigint as n_slots from p left join y using (row)
"""

_FINE = """with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings where embedding is not null),
g as (select * from v where len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0)"""

OP7_SQL = (
    _FINE.replace("with v", "with recursive v")
    + """,
p as (select a.vec_id as a, b.vec_id as b from g a join g b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  and list_cosine_similarity(a.e, b.e) >= 0.98),
r as (select vec_id as n, vec_id as c from embeddings union select p.a, r.c from r join p on p.b = r.n),
m as (select n, min(c) as c from r group by n), k as (select a, count(*) as n from p group by a)
select e.vec_id, coalesce(k.n, 0)::bigint as n_links, m.c as component_id, e.vec_id = m.c as kept
from embeddings e join m on m.n = e.vec_id left join k on k.a = e.vec_id
"""
)

#: All candidates compared: what the search returns where it finds every neighbour.
OP10_SQL = (
    _FINE
    + """,
s as (select a.vec_id as query_id, b.vec_id, list_cosine_similarity(a.e, b.e) as score from g a join g b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
)

OP9_SQL = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * shared >= 80 * (x.n + y.n - shared)),
r as (select doc_id as n, doc_id as c from documents union select e.a, r.c from r join e on e.b = r.n),
m as (select n, min(c) as c from r group by n)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.c as component_id, d.doc_id = m.c as kept
from documents d join m on m.n = d.doc_id left join n on n.doc_id = d.doc_id
"""

#: crc32 of a short ASCII text: a table of 256 remainders, then one fold over the bytes.
_CRC = """b as (select n, list_reduce([n] || range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as v from (select unnest(range(256)) as n)),
t as (select list(v order by n) as t from b)"""

#: Every conversation rebuilt as a list, every prefix of every list.
OP12_SQL = (
    "with "
    + _CRC
    + """,
r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
o as (select conv_id, list({'role': role, 'text': text} order by turn nulls first, role, sha256(text)) as own from r group by conv_id),
h as (select conv_id, own, conv_id - conv_id % 100 as base, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint),
  lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 6 as h from o, t),
c as (select h.conv_id, coalesce(o.own[1:h.h], []) || h.own[h.h + 1:] as seq from h left join o on o.conv_id = h.base),
p as (select conv_id, len(seq) as size, unnest(range(len(seq) + 1)) as depth, seq from c),
q as (select conv_id, size, depth, seq[1:depth] as pre, seq[1:depth - 1] as up, length(seq[depth].text) as chars from p),
n as (select depth, pre, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (size = depth), '')) as ends_sha256 from q group by depth, pre),
k as (select depth - 1 as depth, up as pre, count(*) as n_children from n where depth > 0 group by all),
m as (select n.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * coalesce(chars, 0) as value from n left join k on k.depth = n.depth and k.pre = n.pre),
s as (select a.depth, a.pre, sum(b.value)::bigint as saved_tokens, sum((b.n_children = 0)::int)::bigint as n_leaves
  from m a join m b on b.depth >= a.depth and b.pre[1:a.depth] = a.pre group by all)
select m.conv_id, m.depth, u.conv_id as parent_conv_id, m.n_convs, m.n_children::bigint as n_children, n_leaves, saved_tokens, m.ends_sha256
from m join s on s.depth = m.depth and s.pre = m.pre left join m u on m.depth > 0 and u.depth = m.depth - 1 and u.pre = m.up
"""
)

ORACLE_SQL = {"op12_prefix_trie": OP12_SQL, "op9_near_duplicates": OP9_SQL, "op7_embedding_dedup": OP7_SQL, "op10_nearest": OP10_SQL, "op6_source_mix": OP6_SQL}
