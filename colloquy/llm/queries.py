"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import ann, bpe, jaccard, language, licenses, merkle, packing, spelling, spotsigs, substring, suffix, urls, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_components(table(spark, sf_dir, "documents"), width=3, percent=90).drop("node")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_word_windows(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_byte_windows(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spotsigs.compare_with_next(docs, classes=spotsigs.near_copies(docs))


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.cross_check(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.encode(docs["doc_id"].cast("string"), "UTF-8")) % 7 == 0
    return merkle.manifest(docs, claims={"n_chars": F.when(tampered, docs["n_chars"] + 1).otherwise(docs["n_chars"])}).drop("proof")


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_bpe, op2_license_scan, op3_ngram_jaccard, op4_substring_dedup, op5_best_fit_packing, op6_suffix_dedup, op7_warc, op8_spotsigs, op9_permutation_index, op10_language_id, op11_merkle_manifest, op12_url_filter, op13_spelling_variants)}


#: Of the archives' records: what the pages say.
OP7_SQL = """
with p as (select page_id, coalesce(html, '') h from pages),
     f as (select h, min(page_id) first_id from p where strlen(h) >= 100 group by h)
select p.page_id, strlen(p.h)::bigint payload_bytes, sha256(p.h) payload_digest,
       case when f.first_id is null or p.page_id = f.first_id then 'response' else 'revisit' end record_type,
       case when f.first_id is null or p.page_id = f.first_id then null else f.first_id end refers_to
from p left join f on p.h = f.h
"""


#: The crc32 table and, with it, the unsigned crc32 of {text}; {table} is a column with the table.
CRC_TABLE = "select list_transform(range(256), lambda n: list_reduce([n::ubigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384::ubigint) else a >> 1 end)) crc_of"
CRC = "xor(4294967295::ubigint, list_reduce(list_concat([4294967295::ubigint], list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::ubigint)), lambda a, b: xor(crc_of[((xor(a, b) & 255) + 1)::bigint], a >> 8)))"

#: Each level of a tree as a list, then each leaf's siblings, the subroot's included.
OP11_SQL = f"""
with recursive crc as ({CRC_TABLE}),
     fields as (select doc_id, lang, n_chars, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') a,
                       coalesce(strlen(text) || ':' || text, '-') z, coalesce({CRC.format(text="doc_id::varchar")} % 7 = 0, false) tampered from documents, crc),
     leaves as (select doc_id, lang, sha256(a || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || z) leaf,
                       sha256(a || coalesce(strlen((n_chars + tampered::int)::varchar) || ':' || (n_chars + tampered::int), '-') || z) claimed from fields),
     placed as (select *, row_number() over () id, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 place from leaves),
     up as (select lang, 0 lvl, list(leaf order by place) d from placed group by lang
            union all select lang, lvl + 1, list_transform(range(0, (len(d) + 1) // 2), lambda i: sha256(d[2 * i + 1] || coalesce(d[2 * i + 2], ''))) from up where len(d) > 1),
     subroots as (select lang, lvl height, d[1] subroot, row_number() over (order by lang nulls first) - 1 slot from up where len(d) = 1),
     crown as (select 0 lvl, list(subroot order by slot) d from subroots
            union all select lvl + 1, list_transform(range(0, (len(d) + 1) // 2), lambda i: sha256(d[2 * i + 1] || coalesce(d[2 * i + 2], ''))) from crown where len(d) > 1),
     steps as (select id, lvl, place >> lvl spot, d[xor(place >> lvl, 1) + 1] sibling from placed join up on placed.lang is not distinct from up.lang where len(d) > 1
            union all select id, 1000 + crown.lvl, slot >> crown.lvl, d[xor(slot >> crown.lvl, 1) + 1] from placed join subroots on placed.lang is not distinct from subroots.lang, crown where len(d) > 1),
     proofs as (select id, string_agg(sibling, '' order by lvl) proof, list(case when sibling is null then '-' when spot % 2 = 1 then '<' || sibling else '>' || sibling end order by lvl) path from steps group by id),
     folded as (select p.doc_id, p.leaf, s.subroot, (select d[1] from crown where len(d) = 1) root, sha256(coalesce(proof, '')) proof_sha256,
                       list_reduce(list_concat([claimed], coalesce(path, [])), lambda a, x: case x[1] when '<' then sha256(substr(x, 2) || a) when '>' then sha256(a || substr(x, 2)) else sha256(a) end) folded_root
                from placed p join subroots s on p.lang is not distinct from s.lang left join proofs using (id))
select *, folded_root = root verified from folded
"""

#: All combinations of each labelled URL's tokens are counted.
OP12_SQL = r"""
with given as (select * from (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) t(v, h, b)),
     rest as (select row_number() over () id, page_id, url, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end r from pages),
     parsed as (select *, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path from rest),
     fits as (select id, max_by(v, length(h || b)) v, max_by(h || b, length(h || b)) rule from parsed join given on (host = h or ends_with(host, '.' || h)) and starts_with(path, b) group by id),
     pieces as (select parsed.*, fits.v, fits.rule, string_split(host, '.') l, list_filter(string_split(path, '/'), lambda x: x <> '') p,
                       list_sort(list_distinct(list_filter(list_transform(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: regexp_extract(x, '^[^=]*')), lambda x: x <> ''))) q
                from parsed left join fits using (id)),
     named as (select id, page_id, host, path, rule, v,
                      list_sort(list_filter(['host:' || nullif(host, ''), case when len(l) > 1 then 'site:' || l[-2] || '.' || l[-1] end, 'top:' || nullif(l[-1], ''), case when len(l) > 2 then 'sub:' || nullif(l[1], '') end,
                        'first:' || regexp_replace(p[1], '[0-9]+', '#', 'g'), 'second:' || regexp_replace(p[2], '[0-9]+', '#', 'g'),
                        'ending:' || nullif(case when ends_with(path, '/') then '/' else regexp_extract(path, '\.[A-Za-z0-9]{1,8}$') end, ''), 'parts:' || len(p), 'query:' || nullif(array_to_string(q, '&'), '')], lambda x: x is not null)) t from pieces),
     masks as (select v, t, unnest(range(1, 1 << len(t))) k from named where v is not null),
     combos as (select v, list_filter(t, lambda x, i: (k >> (i - 1)) & 1 = 1) c from masks),
     counted as (select v, c, count(*) hits, sum(count(*)) over (partition by c) seen from combos group by v, c),
     mined as (select v, c, hits, hits::double / seen::double conf from counted where hits >= ceil(0.02::double * (select count(*) from named where v is not null)) and hits::double / seen::double >= 0.8),
     best as (select t, first(mined.v order by conf desc, hits desc, len(c), c, mined.v) v from (select distinct t from named where v is null) n join mined on list_has_all(n.t, c) group by t),
     usual as (select coalesce(first(v order by n desc, v), 'allow') v from (select v, count(*) n from named where v is not null group by v))
select page_id, host, path, rule, coalesce(named.v, best.v, usual.v) verdict from named left join best using (t), usual
"""

#: Words one letter apart share what is left when a letter is taken out of one or both.
OP13_SQL = f"""
with recursive crc as ({CRC_TABLE}),
     runs as (select coalesce(doc_id::varchar, '') || ':' id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run from documents),
     each as (select id || run t, run, count(*) n from runs group by all),
     coded as (select run, n, {CRC.format(text="t")} h from each, crc),
     words as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end word, sum(n)::bigint n from coded group by 1),
     v as (select word, n from words where length(word) >= 7 and n >= 2),
     cut as (select word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) rest from (select word, n, unnest(range(1, length(word) + 1)) k from v)),
     pairs as (select a.word, b.word other, b.n from cut a join cut b on a.rest = b.rest and a.k = b.k and a.word <> b.word
               union select a.word, b.word, b.n from cut a join v b on a.rest = b.word
               union select b.word, a.word, a.n from cut a join v b on a.rest = b.word),
     near as (select word, count(*) n_near, max(n) best_n from pairs group by word),
     best as (select p.word, min(other) best from pairs p join near on p.word = near.word and p.n = near.best_n group by p.word),
     f as (select v.word, v.n, coalesce(n_near, 0)::bigint n_near, case when best_n >= 10 * v.n then best end form, case when best_n >= 10 * v.n then best_n end form_n
           from v left join near using (word) left join best using (word)),
     walk as (select word, word place from f union all select walk.word, f.form from walk join f on f.word = walk.place where f.form is not null)
select f.word, f.form, walk.place root, f.n, f.n_near, f.form_n
from f join walk on walk.word = f.word join f last on last.word = walk.place where last.form is null
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": OP7_SQL, "op11_merkle_manifest": OP11_SQL, "op12_url_filter": OP12_SQL, "op13_spelling_variants": OP13_SQL}
