"""Queries of this subpackage: name -> function (spark, sf_dir), and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import decontam
from . import divergence
from . import fim
from . import fingerprint
from . import line_dedup
from . import mix
from . import ngram_join
from . import pack
from . import quality
from . import shard
from . import substring_dedup
from . import url_filter
from . import warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op9_ngram_jaccard_join")
def op9(spark, sf_dir):
    """Shingle count and link component of every document."""
    return ngram_join.ngram_jaccard_join(C.table(spark, sf_dir, "documents"))


@query("op3_substring_dedup")
def op3(spark, sf_dir):
    """Words left of every document once all repeated 35-word windows are cut out."""
    kept = substring_dedup.remove_repeats(C.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op1_sampled_splitter_shards")
def op1(spark, sf_dir):
    """Shard and slot of every document, shards of near-equal bytes."""
    return shard.shard_documents(C.table(spark, sf_dir, "documents"), shards=8)


def tokenizer_path() -> str:
    """The vocabulary file of the packing contract, where the tokenizer package keeps it."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op6_differencing_pack")
def op6(spark, sf_dir):
    """Every piece of every document with its place in a sequence of at most 2048 ids."""
    return pack.pack_documents(C.table(spark, sf_dir, "documents"), tokenizer_path())


@query("op10_winnowed_fingerprints")
def op10(spark, sf_dir):
    """Fingerprint of every document and of its edited text, with the likeness of both and of the next document."""
    return fingerprint.fingerprint_neighbours(C.table(spark, sf_dir, "documents"))


#: fixed values: the rules of the URL contract
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query("op4_tree_url_filter")
def op4(spark, sf_dir):
    """Verdict on every page's URL: rules first, boosted trees for the rest."""
    return url_filter.judge_urls(C.table(spark, sf_dir, "pages"), URL_RULES).drop("score")


def archive_records(pages: DataFrame) -> DataFrame:
    """Stand-in archive records in the schema of resolve_revisits: a response and a later revisit of every page."""
    url, page = F.coalesce(F.col("url"), F.lit("")), F.col("page_id")
    digest = F.md5(F.coalesce("html", F.lit("")))
    day = F.lit("day ")
    later = page * 60 + F.when(page % 11 == 0, -3600).otherwise(3600)
    response = F.struct(
        (page * 2).alias("record_id"), url.alias("url"), (page * 60).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
        F.concat(F.lit('"'), digest, F.lit('"')).alias("etag"), F.concat(day, (page % 7).cast("string")).alias("last_modified"), digest.alias("digest"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"),
                     F.lit("date"), (page * 60).cast("string"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"))
    revisit = F.struct(
        (page * 2 + 1).alias("record_id"), F.concat(F.regexp_replace(url, "^https:", "HTTPS:"), F.lit("#again")).alias("url"), later.alias("ts"),
        F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.when(page % 3 == 0, F.concat(F.lit('W/"'), digest, F.lit('"'))).when(page % 5 == 0, F.lit('"other"')).otherwise(F.lit(None).cast("string")).alias("etag"),
        F.when(page % 4 != 0, F.concat(day, (page % 7).cast("string"))).otherwise(F.lit(None).cast("string")).alias("last_modified"),
        F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), later.cast("string"), F.lit("expires"), F.lit("never")).alias("headers"))
    return pages.select(F.explode(F.array(response, revisit)).alias("r")).select("r.*")


OP7_SQL = r"""
with p as (select page_id, coalesce(url, '') as url, md5(coalesce(html, '')) as digest, strlen(coalesce(html, '')) as bytes from pages),
recs as (
  select page_id * 2 as record_id, url, page_id * 60 as ts, 'response' as kind, '"' || digest || '"' as etag, 'day ' || (page_id % 7) as last_modified, digest, bytes from p
  union all
  select page_id * 2 + 1, regexp_replace(url, '^https:', 'HTTPS:') || '#again', page_id * 60 + case when page_id % 11 = 0 then -3600 else 3600 end, 'revisit',
    case when page_id % 3 = 0 then 'W/"' || digest || '"' when page_id % 5 = 0 then '"other"' end,
    case when page_id % 4 <> 0 then 'day ' || (page_id % 7) end, null, 0 from p),
cut as (select *, lower(regexp_extract(regexp_replace(url, '#.*$', ''), '^([^:/?#]+://[^/?]*)', 1)) as head, regexp_replace(url, '#.*$', '') as bare from recs),
canon as (select *, case when head <> '' then
    regexp_replace(regexp_replace(head, '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1')
    || case when starts_with(substr(bare, length(head) + 1), '/') then substr(bare, length(head) + 1) else '/' || substr(bare, length(head) + 1) end end as canon from cut),
latest as (
  select v.record_id, v.canon, v.ts, v.etag, v.last_modified, r.record_id as rid, r.etag as retag, r.last_modified as rlast, r.digest as rdigest, r.bytes, r.ts as rts
  from canon v left join canon r on r.kind = 'response' and r.canon = v.canon and r.ts < v.ts
  where v.kind = 'revisit'
  qualify row_number() over (partition by v.record_id order by r.ts desc nulls last, r.record_id desc) = 1),
judged as (select *, case when rid is null then 'missing'
    when coalesce(case when etag is not null and retag is not null then regexp_replace(etag, '^W/', '') = regexp_replace(retag, '^W/', '')
                       when last_modified is not null and rlast is not null then last_modified = rlast end, true) then 'resolved' else 'changed' end as outcome from latest)
select record_id, canon, ts, outcome, case when outcome = 'resolved' then rid end as response_id, case when outcome = 'resolved' then rdigest end as digest,
  case when outcome = 'resolved' then 'cache-control: max-age=60 | content-length: ' || bytes || ' | content-type: text/html | date: ' || ts || ' | expires: never' end as headers
from judged"""


@query("op7_revisit_resolution", OP7_SQL)
def op7(spark, sf_dir):
    """Every revisit with the latest earlier response of its canonical URL and the merged headers."""
    got = warc.resolve_revisits(archive_records(C.table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return got.withColumn("headers", F.array_join(lines, " | "))


@query("op2_line_set_join")
def op2(spark, sf_dir):
    """Lines of every document, and the numbers of those that an earlier line matches."""
    return line_dedup.line_report(C.table(spark, sf_dir, "documents"))


@query("op5_latent_decontamination")
def op5(spark, sf_dir):
    """Documents with the benchmark items found in them."""
    return decontam.find_leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


@query("op8_cotrained_quality")
def op8(spark, sf_dir):
    """Quality score of every document and whether it is kept."""
    return quality.score_documents(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


OP11_SQL = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
        source_size * 2.0::double as room, cast(sum(source_size) over () as bigint) * 1.5::double as budget from s),
l as (select *, (budget - coalesce(sum(room) over (order by room / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
        / sum(weight) over (order by room / weight, source nulls last rows between current row and unbounded following) as level from w),
t as (select source, source_size, budget, least(room, max(level) over () * weight) as target from l),
b as (select *, cast(coalesce(greatest(1, least(4096, floor(min(case when target > 0 then target end) over () / 128.0))), 1) as bigint) as block from t),
house as (select cast(floor(max(budget) / max(block) + 0.5) as bigint) as m, max(budget) as budget, max(block) as block, count_if(target > 0) as n from b),
award as (select b.source, target / (2 * k + 1) as quotient, k from b, house, generate_series(0, house.m) as g(k)
        where b.target > 0 and k <= target / house.block + n + 2),
seat as (select source, count(*) as seats from (select *, row_number() over (order by quotient desc, source nulls last, k) as place from award) z, house where place <= m group by source),
src as (select b.*, least(coalesce(seats, 0) * block, 2 * source_size) as tokens,
        cast(('0x' || substr(md5('7:first:' || coalesce(b.source, '')), 1, 8))::ubigint as bigint) % greatest(1, cast(ceil(source_size / block) as bigint)) * block as origin
        from b left join seat on b.source is not distinct from seat.source),
p as (select doc_id, source, size, coalesce(sum(size) over (partition by source order by md5('7:' || coalesce(cast(doc_id as varchar), '') || ':' || size), doc_id nulls last, size
        rows between unbounded preceding and 1 preceding), 0) as start from d),
c as (select p.doc_id, p.size, s.source_size, s.target, s.tokens, (start - origin + 2 * s.source_size * block) % greatest(1, s.source_size) as place
      from p join src s on p.source is not distinct from s.source)
select doc_id, size, source_size, target, cast((select sum(greatest(0, least(u + width, tokens) - least(u, tokens))) from (values
    (place, least(size, source_size - place)), (place + source_size, least(size, source_size - place)),
    (0, size - least(size, source_size - place)), (source_size, size - least(size, source_size - place))) as v(u, width)) as bigint) as taken
from c"""


@query("op11_sainte_lague_mix", OP11_SQL)
def op11(spark, sf_dir):
    """Size of every document, and how many of its words the mix of sources takes."""
    return mix.mix_documents(C.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP12_SQL = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms,
    row_number() over () as doc from documents),
occ as (select lang, source, doc, unnest(terms) as term from d),
vocab as (select lang, term from occ group by lang, term having count(distinct doc) >= 10),
cnt as (select o.lang, o.source, o.term, count(*) as n from occ o join vocab using (lang, term) group by all),
v as (select lang, count(*) as v from vocab group by lang),
grp as (select distinct lang, source from d),
gn as (select g.lang, g.source, coalesce(sum(n), 0) as total from grp g left join cnt using (lang, source) group by all),
share as (select g.lang, g.source, w.term, coalesce(c.n, 0) as n, cast(1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (g.total + 2 * v.v) as bigint) as p
    from gn g join vocab w using (lang) join v using (lang) left join cnt c on c.lang = g.lang and c.source = g.source and c.term = w.term),
lshare as (select lang, term, cast(1 + 1000000000::hugeint * (sum(n) + 2) // (sum(sum(n)) over (partition by lang) + 2 * max(v.v)) as bigint) as q
    from cnt join v using (lang) group by lang, term),
pair as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
    from share a join share b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select g.lang, g.source, 'pair' as part, h.source as item, cast(coalesce(p.value, 0) as bigint) as value
    from grp g join grp h on g.lang = h.lang and g.source <> h.source left join pair p on p.lang = g.lang and p.source = g.source and p.item = h.source),
terms as (select s.lang, s.source, 'term' as part, s.term as item, cast((p - q) * (p - q) // (p + q) as bigint) as value from share s join lshare using (lang, term) where n > 0 and p > q)
select * from (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank
    from (select * from pairs union all select * from terms)) where part = 'pair' or rank <= 10"""


@query("op12_source_divergence", OP12_SQL)
def op12(spark, sf_dir):
    """How far every source of a language lies from each other one, and its foremost terms."""
    return divergence.source_divergence(C.table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with h as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
k as (select *, cast(('0x' || substr(h, 1, 8))::ubigint as bigint) as h1, cast(('0x' || substr(h, 9, 8))::ubigint as bigint) as h2,
    cast(('0x' || substr(h, 17, 8))::ubigint as bigint) as h3, cast(('0x' || substr(h, 25, 8))::ubigint as bigint) as h4 from h),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
    case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from k),
u as (select *, substr(text, 1, lo) as p, substr(text, lo + 1, hi - lo) as m, substr(text, hi + 1) as s from c)
select doc_id, cast(n as bigint) as n, form, cast(case when form <> 'plain' then lo end as bigint) as prefix_chars, cast(case when form <> 'plain' then hi - lo end as bigint) as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from u"""


@query("op13_fill_in_middle", OP13_SQL)
def op13(spark, sf_dir):
    """Form and cuts of every document, digests of its transformed text and of the text rebuilt from that."""
    made = fim.restore(fim.fill_in_middle(C.table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
