"""The pN_ queries over the test tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..tables import Scratch, latest_of_wide, read
from . import contributors, email_body, mixing, near_duplicates, neighbours, page_body, shared_spans, site_lines, tokens

Query = Callable[[SparkSession, str], DataFrame]


def _capped(spark: SparkSession, d: str, **ranking) -> DataFrame:
    scratch = Scratch(spark, "p1")
    records = scratch.cut(contributors.with_contributor(read(spark, d, "ready_articles"), read(spark, d, "sources")))
    return contributors.cap(records, scratch, share=0.02, score="intrinsic_score", **ranking)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _capped(spark, d).filter("not kept").select("id")


def p1_pool(spark: SparkSession, d: str) -> DataFrame:
    """The capped pool with its contributors and places."""
    return _capped(spark, d).filter("kept").select("id", "contributor", F.col("score").alias("intrinsic_score"), "place")


def p1_reservoir(spark: SparkSession, d: str) -> DataFrame:
    """The pool drawn by weight: a score higher by one is worth e times as much."""
    return _capped(spark, d, sharpness=1.0).filter("kept").select("id", "contributor", "place")


def _repeated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    articles = read(spark, d, "extracted_articles")
    return articles, site_lines.repeated_lines(articles, Scratch(spark, "p2"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.exact_lines(_repeated(spark, d)[1])


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """Each article's text without the lines of its site's repeated clusters."""
    articles, repeated = _repeated(spark, d)
    return site_lines.without_lines(articles.dropDuplicates(["article_id", "text"]), repeated)


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "extracted_articles").select(F.col("article_id").alias("id"), F.col("extracted_at").alias("version"), "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    setup = near_duplicates.Setup(words=3, similarity=0.6, bands=32, rows=3, bags=False)
    found = near_duplicates.classes(_articles(spark, d), Scratch(spark, "p3"), setup)
    return near_duplicates.pairs_of_members(found).select(F.col("a").alias("article_id_a"), F.col("b").alias("article_id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups by weighted similarity of 0.8 or more over multisets of five words."""
    scratch = Scratch(spark, "p3")
    found = near_duplicates.classes(_articles(spark, d), scratch, near_duplicates.Setup())
    return near_duplicates.groups(found, scratch).withColumnRenamed("id", "article_id")


DIMENSIONS, NEIGHBOURS, LEAST_COSINE = 384, 5, 0.8


def _graph(spark: SparkSession, d: str, scratch: Scratch) -> neighbours.Graph:
    rows = read(spark, d, "article_embeddings").filter("embedding_version = 'emb-v2'").select(F.col("article_id").alias("id"), F.col("created_at").alias("version"), F.col("vec_values").alias("vec"))
    return neighbours.build(neighbours.vectors(rows, scratch, DIMENSIONS), scratch)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "p4")
    near = neighbours.expanded(_graph(spark, d, scratch), scratch, NEIGHBOURS, LEAST_COSINE)
    return near.select(F.least("id", "other").alias("article_id_a"), F.greatest("id", "other").alias("article_id_b")).distinct()


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest other articles of every article with a usable vector."""
    scratch = Scratch(spark, "p4")
    near = neighbours.expanded(_graph(spark, d, scratch), scratch, NEIGHBOURS)
    return near.select(F.col("id").alias("article_id"), F.col("other").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"))


def p4_search(spark: SparkSession, d: str) -> DataFrame:
    """Greedy graph search; queries are the articles with a usable vector whose hexadecimal id is divisible by 100."""
    scratch = Scratch(spark, "p4")
    graph = _graph(spark, d, scratch)
    asked = graph.vectors.members.filter((F.conv(F.substring("id", -8, 8), 16, 10).cast("long") + F.pmod(F.conv(F.substring("id", 1, 8), 16, 10).cast("long"), F.lit(100)) * F.lit(pow(2, 32, 100))) % 100 == 0)
    near = neighbours.search_members(graph, asked, scratch, NEIGHBOURS)
    return near.select(F.col("id").alias("article_id"), F.col("other").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "discovered_articles").select(F.col("article_id").alias("id"), "discovered_at", "text", F.col("inline_html").alias("markup"), "title", F.col("source_id").alias("source"), "author", F.col("extraction_confidence").alias("confidence"))
    return latest_of_wide(pages, "id", [F.col("discovered_at")]).drop("discovered_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    return page_body.furniture_lines(pages, Scratch(spark, "p5")).select(F.col("id").alias("article_id"), "line_no")


def p5_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Each page's main body and its share of the text, beside the confidence of the extraction."""
    pages = _pages(spark, d)
    return page_body.bodies(pages, page_body.furniture_lines(pages, Scratch(spark, "p5"))).withColumnRenamed("id", "article_id")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    mail = read(spark, d, "email_payloads").select(F.col("message_id").alias("id"), "subject", "author", F.col("from_address").alias("sender"), F.col("received_at").alias("at"), F.col("text_body").alias("text"), F.when(F.col("text_body").isNull(), F.col("html_body")).alias("html"))
    return latest_of_wide(mail, "id", [F.col("at")])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return email_body.not_newly_written(_messages(spark, d), Scratch(spark, "p6")).select(F.col("id").alias("message_id"), "line_no")


def p6_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The newly written text of every message."""
    mail = _messages(spark, d)
    return email_body.bodies(mail, email_body.not_newly_written(mail, Scratch(spark, "p6"))).withColumnRenamed("id", "message_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(read(spark, d, "documents").select("doc_id", "text"))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.count(read(spark, d, "documents").select("doc_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    counted = tokens.count(read(spark, d, "documents").select("source", "text"))
    return mixing.plan(counted, read(spark, d, "mix_targets")).filter("short").select("source")


def _mixed(spark: SparkSession, d: str, tempered: bool) -> tuple[DataFrame, DataFrame]:
    counted = mixing.counted_documents(read(spark, d, "documents"), Scratch(spark, "p8"))
    planned = mixing.plan(counted, read(spark, d, "mix_targets"), tempered=tempered)
    return planned, mixing.realise(counted, planned)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Each source's target, budget and the shares really reached."""
    planned, realised = _mixed(spark, d, False)
    return mixing.reached(realised, planned)


def p8_tempered(spark: SparkSession, d: str) -> DataFrame:
    """The same at the exponent at which every source stays within its repeats."""
    planned, realised = _mixed(spark, d, True)
    return mixing.reached(realised, planned)


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used in the mix."""
    return _mixed(spark, d, False)[1]


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, shared_spans.Runs]:
    scratch, documents = Scratch(spark, "p9"), read(spark, d, "documents")
    return documents, shared_spans.runs(shared_spans.repeated_windows(documents, scratch), scratch)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.pairs(_runs(spark, d)[1]).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document stands elsewhere."""
    return shared_spans.covered(*_runs(spark, d))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_pool, p1_reservoir, p2_found, p2_clean, p3_found, p3_groups, p4_found, p4_neighbours, p4_search, p5_found, p5_bodies, p6_found, p6_bodies, p7_ids, p7_counts, p8_found, p8_mix, p8_tempered, p8_documents, p9_found, p9_shared)}

_P1_PLACES = r"""
with latest as (
  select id, arg_max(struct_pack(source_id := source_id, author := author, score := intrinsic_score), (analyzed_at, coalesce(author, ''), coalesce(intrinsic_score, -1))) r
  from ready_articles where id is not null group by id),
folded as (
  select id, r.source_id source_id, r.score score, r.author author,
    regexp_extract_all(lower(strip_accents(replace(replace(coalesce(r.author, ''), 'ø', 'o'), 'Ø', 'O'))), '[a-z]+') words
  from latest),
scopes as (
  select id source_id, unnest(author_scope) name from sources),
names as (
  select source_id, name, regexp_extract_all(lower(strip_accents(replace(replace(name, 'ø', 'o'), 'Ø', 'O'))), '[a-z]+') w from scopes),
matched as (
  select f.id, min(n.name) name
  from folded f join names n on n.source_id = f.source_id
    and (list_has_all(f.words, n.w) or (list_has_all(f.words, n.w[2:]) and list_contains(f.words, n.w[1][1:1])))
  where trim(coalesce(f.author, '')) <> ''
  group by f.id),
named as (
  select f.id, f.score, coalesce(m.name, f.source_id) contributor from folded f left join matched m on m.id = f.id),
placed as (
  select id, contributor, score, row_number() over (partition by contributor order by score desc nulls last, id) place, count(*) over () n from named)
"""

SQL: dict[str, str] = {
    "p1_found": _P1_PLACES + "select id from placed where place > (n * 2) // 100",
    "p1_pool": _P1_PLACES + "select id, contributor, score as intrinsic_score, place from placed where place <= (n * 2) // 100",
    "p1_reservoir": _P1_PLACES + """,
keyed as (select id, contributor, score, n, score - ln(-ln((cast('0x' || substr(md5('11:' || id), 1, 13) as bigint)::double + 0.5) / 4503599627370496.0)) key from placed),
drawn as (select id, contributor, n, row_number() over (partition by contributor order by key desc nulls last, id) place from keyed)
select id, contributor, place from drawn where place <= (n * 2) // 100""",
    "p2_found": r"""
with parts as (select distinct source_id, article_id, string_split(text, chr(10)) lines from extracted_articles where text is not null),
lines as (select source_id, article_id, unnest(lines) line, unnest(range(len(lines))) line_no from parts),
keyed as (select source_id, article_id, cast(line_no as int) line_no, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') key from lines),
sizes as (select source_id, count(distinct article_id) n from extracted_articles group by source_id),
repeated as (
  select k.source_id, key from keyed k join sizes s on s.source_id = k.source_id where length(key) >= 3
  group by k.source_id, key, s.n having count(distinct article_id) >= 3 and count(distinct article_id) * 20 >= s.n)
select distinct article_id, line_no from keyed join repeated using (source_id, key)""",
    "p3_found": r"""
with texts as (select article_id, arg_max(text, extracted_at) text from extracted_articles where text is not null group by article_id),
words as (select article_id, regexp_extract_all(lower(replace(text, 'İ', 'i' || chr(775))), '[\p{L}\p{N}]+') w from texts),
sets as (select article_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) s from words where len(w) >= 3),
posts as (select article_id, len(s) n, unnest(s) x from sets),
common as (
  select a.article_id a, b.article_id b, a.n na, b.n nb, count(*) shared from posts a join posts b on a.x = b.x and a.article_id < b.article_id group by all)
select a as article_id_a, b as article_id_b from common where shared >= 0.6 * (na + nb - shared)""",
    "p9_found": """
with long as (select doc_id, text, length(text) n from documents where length(text) >= 200),
places as (select doc_id, text, unnest(range(1, n - 198)) i from long),
windows as (select distinct doc_id, md5(substring(text, i, 200)) h from places)
select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from windows a join windows b on a.h = b.h and a.doc_id < b.doc_id""",
    "p9_shared": """
with long as (select doc_id, text, length(text) n from documents where length(text) >= 200),
windows as (select doc_id, i, md5(substring(text, i, 200)) h from (select doc_id, text, unnest(range(1, n - 198)) i from long)),
common as (select h from windows group by h having count(distinct doc_id) > 1),
starts as (select distinct doc_id, i from windows where h in (select h from common)),
spans as (select doc_id, least(200, coalesce(lead(i) over (partition by doc_id order by i) - i, 200)) c from starts),
sums as (select doc_id, sum(c) shared from spans group by 1), sizes as (select doc_id, max(coalesce(length(text), 0)) chars from documents where doc_id is not null group by 1)
select doc_id, cast(chars as int) as chars, cast(coalesce(shared, 0) as bigint) as shared_chars, case when chars > 0 then coalesce(shared, 0) / chars::double else 0.0 end as shared_share from sizes left join sums using (doc_id)""",
    "p3_groups": r"""
with recursive ids as (select distinct article_id id from extracted_articles where article_id is not null),
texts as (select article_id id, arg_max(text, extracted_at) t from extracted_articles where text is not null and article_id is not null group by article_id),
words as (select id, regexp_extract_all(lower(replace(t, 'İ', 'i' || chr(775))), '[\p{L}\p{N}]+') w from texts),
bag as (select id, x, count(*) n from (select id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) x from words where len(w) >= 5) group by all),
keyed as (select id, md5(string_agg(x || ':' || n, '|' order by x)) k, sum(n) size from bag group by id),
reps as (select k, min(id) rep, count(*) copies, any_value(size) size from keyed group by k),
mine as (select b.* from bag b join reps r on r.rep = b.id),
common as (select a.id a, b.id b, sum(least(a.n, b.n)) m from mine a join mine b on a.x = b.x and a.id < b.id group by all),
near as (select c.a, c.b from common c join reps p on p.rep = c.a join reps q on q.rep = c.b where m >= 0.8 * (p.size + q.size - m)),
edges as (select a, b from near union all select b, a from near),
reach as (select rep id, rep r from reps union select reach.id, e.b from reach join edges e on e.a = reach.r),
groups as (select id rep, min(r) g from reach group by id),
linked as (select e.a rep, sum(q.copies) links from edges e join reps q on q.rep = e.b group by e.a)
select i.id as article_id, coalesce(r.rep, i.id) as class_id, coalesce(g.g, i.id) as group_id, cast(coalesce(l.links, 0) as bigint) as links
from ids i left join keyed k on k.id = i.id left join reps r on r.k = k.k left join groups g on g.rep = r.rep left join linked l on l.rep = r.rep""",
    "p4_neighbours": """
with usable as (
  select article_id, arg_max(list_transform(vec_values, lambda x: x::double), created_at) v from article_embeddings
  where embedding_version = 'emb-v2' and len(vec_values) = 384
    and len(list_filter(vec_values, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vec_values, lambda x: x <> 0)) > 0
  group by article_id),
scored as (select a.article_id a, b.article_id b, round(list_cosine_similarity(a.v, b.v), 12) c from usable a join usable b on a.article_id <> b.article_id),
placed as (select a, b, c, row_number() over (partition by a order by c desc, b) place from scored)
select a as article_id, b as neighbour_id, round(c, 6) as cosine from placed where place <= 5""",
    "p4_found": """
with usable as (
  select article_id, arg_max(list_transform(vec_values, lambda x: x::double), created_at) v from article_embeddings
  where embedding_version = 'emb-v2' and len(vec_values) = 384
    and len(list_filter(vec_values, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vec_values, lambda x: x <> 0)) > 0
  group by article_id),
scored as (
  select a.article_id a, b.article_id b, round(list_cosine_similarity(a.v, b.v), 12) c from usable a join usable b on a.article_id <> b.article_id),
placed as (select a, b, c, row_number() over (partition by a order by c desc, b) place from scored)
select distinct least(a, b) as article_id_a, greatest(a, b) as article_id_b from placed where place <= 5 and c >= 0.8""",
}
