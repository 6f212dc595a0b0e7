"""The queries op1 to op13 and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, gru, mainhtml, merkle, mixing, neardup, phrases, pieces, quality, sharding, simhash, sstable, urls
from .common import documents


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir)).select("doc_id", "class_id")


def op2_range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir), n_shards=40)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(documents(spark, sf_dir, "pages"))


def op4_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(documents(spark, sf_dir))


def op5_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.scored(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extracted(documents(spark, sf_dir, "pages"))


def op9_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.digests(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(documents(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_near_duplicates, op2_range_shards, op3_url_filter, op4_merkle_fingerprints, op5_gru_scores, op6_quality_rules, op7_sentencepiece, op8_main_text, op9_token_tables, op10_mix_sources, op11_simhash_classes, op12_token_alignment, op13_collocations)}


OP4_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, lead(coalesce(text, '')) over (order by doc_id desc) as nxt from documents
), e as (
  select doc_id, text, coalesce(nxt, (select coalesce(text, '') from documents order by doc_id desc limit 1)) as nxt,
         length(text) as n_chars from d
), f as (
  select doc_id, n_chars, text, nxt, substr(text, 1, n_chars - n_chars // 3) || substr(nxt, 1, n_chars // 3) as edited from e
), g as (
  select doc_id, n_chars, edited,
    list_transform(string_split(text, chr(10)), lambda p: case when p = '' then [substr(md5(''), 1, 16)] else list_transform(regexp_extract_all(p, '(?s).{1,96}'), lambda x: substr(md5(x), 1, 16)) end) as own,
    list_transform(string_split(edited, chr(10)), lambda p: case when p = '' then [substr(md5(''), 1, 16)] else list_transform(regexp_extract_all(p, '(?s).{1,96}'), lambda x: substr(md5(x), 1, 16)) end) as new,
    list_transform(string_split(nxt, chr(10)), lambda p: case when p = '' then [substr(md5(''), 1, 16)] else list_transform(regexp_extract_all(p, '(?s).{1,96}'), lambda x: substr(md5(x), 1, 16)) end) as other
  from f
), h as (
  select *, flatten(own) as a, flatten(new) as b, flatten(other) as c,
    array_to_string(list_transform(own, lambda p: array_to_string(p, ',') || case when right(array_to_string(p, ','), 1) in ('0', '8') then '|' else ';' end), '') as own_s,
    array_to_string(list_transform(new, lambda p: array_to_string(p, ',') || case when right(array_to_string(p, ','), 1) in ('0', '8') then '|' else ';' end), '') as new_s
  from g
), t as (
  select *, array_to_string(list_transform(string_split(left(own_s, length(own_s) - 1), '|'), lambda x: substr(md5(x), 1, 16) || '=' || x), '|') as own_tree,
    array_to_string(list_transform(string_split(left(new_s, length(new_s) - 1), '|'), lambda x: substr(md5(x), 1, 16) || '=' || x), '|') as new_tree
  from h
)
select doc_id, n_chars, sha256(edited) as edited_sha256, sha256(own_tree) || ':' || own_tree as fingerprint,
  sha256(new_tree) || ':' || new_tree as edited_fingerprint,
  cast(2 * len(list_intersect(a, b)) as double) / (len(list_distinct(a)) + len(list_distinct(b))) as near_edited,
  cast(2 * len(list_intersect(a, c)) as double) / (len(list_distinct(a)) + len(list_distinct(c))) as near_next
from t
"""

OP6_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text from documents
), w as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d
), grams as (
  select rid, i, md5(array_to_string(list_slice(words, i, i + 7), ' ')) as g
  from (select rid, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8)
), twice as (
  select rid, i, coalesce(least(8, lead(i) over (partition by rid order by i) - i), 8) as adds
  from (select rid, i, count(*) over (partition by rid, g) as n from grams) where n > 1
), covered as (
  select rid, cast(sum(adds) as bigint) as n from twice group by rid
), m as (
  select w.doc_id, w.lang, w.source, len(words) as n_words,
    cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    coalesce(c.n, 0) as n_repeat_words, len(regexp_extract_all(text, '\p{Lu}')) as capitals
  from w left join covered c on c.rid = w.rid
), b as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    case when word_chars > 0 then (1000 * n_symbols) // word_chars end as symbols_v,
    case when word_chars > 0 then (1000 * capitals) // word_chars end as capitals_v,
    case when n_words > 0 then (100 * word_chars) // n_words end as length_v from m
), v as (
  select lang, source, 'symbols' as measure, 5 as least_, symbols_v as v from b where not base_failed
  union all select lang, source, 'capitals', 15, capitals_v from b where not base_failed
  union all select lang, source, 'length', 60, length_v from b where not base_failed
), s as (
  select lang, source, measure, least_, (v >> greatest(length(bin(v)) - 5, 0)) << greatest(length(bin(v)) - 5, 0) as bucket from v
), q as (
  select *, row_number() over (partition by lang, source, measure order by bucket) as k2, count(*) over (partition by lang, source, measure) as n2,
    row_number() over (partition by lang, measure order by bucket) as k1, count(*) over (partition by lang, measure) as n1,
    row_number() over (partition by measure order by bucket) as k0, count(*) over (partition by measure) as n0 from s
), f2 as (
  select lang, source, measure, max(n2) as n, min(bucket) filter (where 4 * k2 >= n2) as q1, min(bucket) filter (where 4 * k2 >= 3 * n2) as q3, max(least_) as l from q group by 1, 2, 3
), f1 as (
  select lang, measure, max(n1) as n, min(bucket) filter (where 4 * k1 >= n1) as q1, min(bucket) filter (where 4 * k1 >= 3 * n1) as q3 from q group by 1, 2
), f0 as (
  select measure, min(bucket) filter (where 4 * k0 >= n0) as q1, min(bucket) filter (where 4 * k0 >= 3 * n0) as q3 from q group by 1
), f as (
  select f2.lang, f2.source, f2.measure,
    case when f2.n >= 200 then f2.q1 when f1.n >= 200 then f1.q1 else f0.q1 end as q1,
    case when f2.n >= 200 then f2.q3 when f1.n >= 200 then f1.q3 else f0.q3 end as q3, f2.l
  from f2 join f1 on f1.lang is not distinct from f2.lang and f1.measure = f2.measure join f0 on f0.measure = f2.measure
), t as (
  select lang, source, max(case when measure = 'symbols' then q3 + 3 * greatest(q3 - q1, l) end) as s_high,
    max(case when measure = 'capitals' then q3 + 3 * greatest(q3 - q1, l) end) as c_high,
    max(case when measure = 'length' then q3 + 3 * greatest(q3 - q1, l) end) as l_high,
    max(case when measure = 'length' then q1 - 3 * greatest(q3 - q1, l) end) as l_low from f group by 1, 2
)
select b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.base_failed,
  not b.base_failed and coalesce(symbols_v <= s_high and capitals_v <= c_high and length_v <= l_high and length_v >= l_low, false) as kept
from b left join t on t.lang is not distinct from b.lang and t.source is not distinct from b.source
"""

OP10_SQL = r"""
with s as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':mix'), 1, 8) as bigint) as key from documents
), g as (
  select source, cast(sum(size) as bigint) as source_size from s group by source
), w as (
  select *, row_number() over (order by source nulls last) - 1 as src,
    cast(case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as double) as weight from g
), fill as (
  select *, 3.0e0 * source_size as cap, row_number() over (order by 3.0e0 * source_size / weight, src) as k from w
), level as (
  select *, (select cast(sum(source_size) as double) from w) - coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0) as left_,
    sum(weight) over (order by k rows between current row and unbounded following) as rest from fill
), lambda_ as (
  select left_ / rest as lam, k as stop from level where (left_ / rest) * weight <= cap order by k limit 1
), tgt as (
  select src, source, source_size, case when k < stop then cap else least(cap, lam * weight) end as target from level cross join lambda_
), tot as (
  select cast(sum(source_size) as bigint) as total, greatest(1, cast(ceil(sum(source_size) / 131072.0e0) as bigint)) as block from w
), tb as (
  select t.*, total, (source_size + block - 1) // block as blocks, (total + block - 1) // block as slots from tgt t cross join tot
), edges as (
  select *, case when src = (select max(src) from tb) then 4294967296 else cast(floor(sum(target) over (order by src rows unbounded preceding) / (select sum(target) from tb) * 4294967296.0e0) as bigint) end as edge from tb
), cut as (
  select *, coalesce(lag(edge) over (order by src), 0) as edge0 from edges
), slots as (
  select i as slot, (i * 2654435769) % 4294967296 as point from (select unnest(range(0, (select max(slots) from tb))) as i)
), ranked as (
  select c.src, row_number() over (partition by c.src order by slot) - 1 as r, blocks from slots join cut c on point >= edge0 and point < edge
), uses as (
  select src, r % blocks as block, count(*) as times from ranked where r < 3 * blocks group by 1, 2
), placed as (
  select tb.src, s.doc_id, s.size, tb.source_size, tb.target, tb.blocks,
    coalesce(sum(s.size) over (partition by tb.src order by s.key, s.doc_id nulls last, s.size rows between unbounded preceding and 1 preceding), 0) as first_
  from s join tb on tb.source is not distinct from s.source
), pieces as (
  select *, unnest(range(cast(((first_ + 1) * blocks - 1) // source_size as bigint), cast(((first_ + size) * blocks - 1) // source_size + 1 as bigint))) as block
  from placed where size > 0
), taken as (
  select p.src, p.doc_id, p.size, p.source_size, p.target, p.first_,
    sum((least(first_ + size, ((p.block + 1) * source_size) // blocks) - greatest(first_, (p.block * source_size) // blocks)) * coalesce(u.times, 0)) as taken
  from pieces p left join uses u on u.src = p.src and u.block = p.block group by 1, 2, 3, 4, 5, 6
)
select doc_id, size, source_size, target, cast(taken as bigint) as taken from taken
union all select doc_id, size, source_size, target, 0 from placed where size = 0
"""


OP13_SQL = r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), w as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p
), g as (
  select lang, 1 as k, unnest(w) as phrase from w
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from w
), c as (
  select lang, k, phrase, count(*) as f, string_split(phrase, ' ') as w from g group by lang, k, phrase having count(*) >= 10
), total as (
  select lang, sum(len(w)) as n from w group by lang
), cuts as (
  select lang, phrase, k, w, f as a, unnest(range(1, k)) as cut from c where k > 1
), s as (
  select x.lang, x.phrase, x.k, x.a, x.cut, h.f as l, t.f as r, (1000000::hugeint * x.a * x.a) // (h.f::hugeint * t.f) as score
  from cuts x join c h on h.lang = x.lang and h.phrase = array_to_string(x.w[1:x.cut], ' ') join c t on t.lang = x.lang and t.phrase = array_to_string(x.w[x.cut + 1:], ' ')
), low as (
  select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), inside as (
  select lang, phrase, max(f) as f from (
    select lang, w[1] || ' ' || w[2] as phrase, f from c where k = 3 union all select lang, w[2] || ' ' || w[3], f from c where k = 3
  ) group by lang, phrase
), kept as (
  select low.* from low left join inside i on i.lang = low.lang and i.phrase = low.phrase where i.f is null or 100 * i.f < 50 * low.a
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
)
select r.lang, r.rank, r.phrase, r.a, cast(r.l as bigint) as l, cast(r.r as bigint) as r, cast(n as bigint) as n, cast(r.score as bigint) as score
from ranked r join total on total.lang = r.lang where r.rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_merkle_fingerprints": OP4_SQL, "op6_quality_rules": OP6_SQL, "op10_mix_sources": OP10_SQL, "op13_collocations": OP13_SQL}
