"""Queries over text, validation and sources: analysis by rule, keywords, chunk vectors, feeds, indexes and sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import dates, text as tx, urls, validation as va, vectors
from ..operators import learning, planning, ranking, relations as rel
from ..sources import adapters as ad, feeds
from ..tables import read
from .catalogue import _NORM, _URL, ART, articles, hexed_sql, micros, query, r6

_LAST_BODY = "body as (select * from (select *, row_number() over (partition by article_id order by extracted_at desc, coalesce(text, '') desc) rn from extracted_articles where article_id is not null) where rn = 1)"


def last_bodies(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    rows = read(spark, d, "extracted_articles").select("article_id", "extracted_at", F.coalesce("text", F.lit("")).alias("t"), *cols)
    return rows.filter("article_id is not null").groupBy("article_id").agg(F.max_by(F.struct("t", *cols), F.struct("extracted_at", "t")).alias("r")).select("article_id", "r.*")


# ---- analysis by rule ----------------------------------------------------------------------------------------------

_SCORE = "least(9.2, floor(({0} + lf + {1}) * 10 + 0.5) / 10)"


@query("with " + _LAST_BODY + r""",
n as (select article_id, coalesce(title, '') title, coalesce(text, '') t, coalesce(word_count, 0) w from body),
f as (select *, least(1.0, log10(greatest(w, 100)) / 4) lf, len(regexp_extract_all(t, '(?i)\b(?:because|therefore|however|although|for example|the reason|but)\b')) signals, len(list_filter(regexp_split_to_array(t, '\n+'), lambda x: x <> '')) paragraphs from n),
s as (select article_id, """ + ", ".join([
    _SCORE.format("6.8", "case when regexp_matches(title, '(?i)today|this week|breaking') then -0.4 else 0.4 end") + " a", _SCORE.format("6.9", "least(0.8, signals / 50.0::double)") + " b",
    _SCORE.format("6.7", "least(0.9, signals / 40.0::double)") + " c", _SCORE.format("6.8", "case when regexp_matches(t, '(?i)I believe|I think|my view|the paradox|the problem') then 0.5 else 0.2 end") + " d",
    _SCORE.format("7.0", "least(0.7, paragraphs / 100.0::double)") + " e"]) + r""" from f)
select article_id, a as long_term_value, b as idea_density, c as argument_quality, d as originality, e as clarity_structure, floor((a * 0.3 + b * 0.25 + c * 0.2 + d * 0.15 + e * 0.1) * 1000 + 0.5) / 1000 as intrinsic_score,
  ['long_term_value', 'idea_density', 'argument_quality', 'originality', 'clarity_structure'][list_position([a, b, c, d, e], greatest(a, b, c, d, e))] as strongest from s""")
def q66_rule_analysis(spark, d):
    """Five scores from length, connectives and paragraphs, their weighted sum, and the strongest (the first of equals)."""
    return learning.rule_analysis(last_bodies(spark, d, "title", "word_count"), "t").select("article_id", *ranking.WEIGHTS, "intrinsic_score", "strongest")


@query("""
with v as (select label grp, vec_id, list_transform(embedding, lambda x: x::double) e, 100 + vec_id % 900 w from embeddings),
u as (select grp, unnest(e) x, unnest(range(len(e))) i, w from v), s as (select grp, i, sum(x * w) / sum(w) m from u group by 1, 2), n as (select grp, sqrt(sum(m * m)) n from s group by 1)
select grp as label, cast(i as int) as place, floor(case when n > 0 then m / n else 0.0 end * 1000000 + 0.5) / 1000000 as value from s join n using (grp)""")
def q67_chunk_means(spark, d):
    """Vectors of pieces put together by length: weighted mean, then unit length."""
    rows = read(spark, d, "embeddings").select("label", "embedding", (F.col("vec_id") % 900 + 100).alias("chars"))
    return learning.weighted_mean(rows, "label", "embedding", "chars").select("label", F.posexplode("vec").alias("place", "v")).select("label", "place", r6(F.col("v")).alias("value"))


@query("with " + ART + r""",
k as (select id, list_filter(list_transform(list_prepend(coalesce(primary_theme, ''), coalesce(keywords, [])), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(coalesce(x, ''), '<\|[^|>]*\|>', '', 'g'), '[\x{200b}-\x{200f}\x{2060}\x{feff}\x{fffc}]', '', 'g'), '\s+', ' ', 'g'))), lambda x: length(x) between 1 and 80 and not contains(x, '?')) c from art),
u as (select id, list_filter(c, lambda x, i: list_position(c, x) = i)[1:5] u from k),
p as (select id, list_concat(u, list_filter(['reading', 'thinking', 'views'], lambda x: not list_contains(u, x))[1:greatest(0, 3 - len(u))]) p from u)
select p.id, array_to_string(p, '|') as keywords, len(p) between 3 and 5 as valid, array_to_string(list_filter(p, lambda x: not list_contains(coalesce(a.secondary_themes, []), x)), '|') as unlike_themes from p join art a using (id)""")
def q68_keywords(spark, d):
    """Keywords cleaned, once each in order, five at most, filled up to three; and those that are no further theme."""
    arts = articles(spark, d, "keywords", "secondary_themes")
    words = tx.keywords(F.col("primary_theme"), F.col("keywords"), ["reading", "thinking", "views"])
    out = arts.select("id", words.alias("k"), F.coalesce("secondary_themes", F.array().cast("array<string>")).alias("themes"))
    return out.select("id", F.array_join("k", "|").alias("keywords"), F.size("k").between(3, 5).alias("valid"), F.array_join(F.filter("k", lambda x: ~F.array_contains("themes", x)), "|").alias("unlike_themes"))


@query("with " + ART + r""",
s as (select id, list_filter(list_transform(regexp_extract_all(coalesce(context_summary, ''), '[^.!?]+[.!?]?'), lambda x: trim(x)), lambda x: length(x) >= 15 and not contains(x, '?')) s from art)
select id, coalesce(s[1], '') as highlight, len(s) as usable from s""")
def q69_highlights(spark, d):
    """The first sentence of the summary that says something, and how many there are."""
    arts = articles(spark, d, "context_summary")
    usable = F.filter(tx.sentences(F.coalesce("context_summary", F.lit("")), ".!?"), lambda s: (F.length(s) >= 15) & ~F.contains(s, F.lit("?")))
    return arts.select("id", F.coalesce(F.get(usable, F.lit(0)), F.lit("")).alias("highlight"), F.size(usable).cast("long").alias("usable"))


@query(r"""
with m as (select distinct on (message_id) message_id, coalesce(subject, '') s from email_payloads where message_id is not null order by message_id, received_at desc, coalesce(subject, '') desc),
j as (select *, '```json' || chr(10) || '{"title": "' || regexp_replace(s, '["\\\x00-\x1f]', '', 'g') || '"}' || chr(10) || '```' raw from m),
u as (select *, trim(replace(replace(raw, '```json', ''), '```', '')) inner_ from j)
select message_id, json_extract_string(inner_, '$.title') as title, '<p>' || replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</p>' as wrapped,
  case when trim(s) = '' then 'unknown_error' else substring(s, 1, 20) end as error, length(s) > 20 as was_cut from u""")
def q70_text_codecs(spark, d):
    """JSON taken out of its fence, plain text wrapped as markup, messages with a fallback and a greatest length."""
    mail = read(spark, d, "email_payloads").filter("message_id is not null").groupBy("message_id").agg(F.max(F.struct("received_at", F.coalesce("subject", F.lit("")).alias("s"))).alias("r")).select("message_id", F.col("r.s").alias("s"))
    fenced = F.concat(F.lit('```json\n{"title": "'), F.regexp_replace("s", r'["\\\x00-\x1f]', ""), F.lit('"}\n```'))
    return mail.select(
        "message_id", F.get_json_object(tx.unfenced(fenced), "$.title").alias("title"), tx.wrapped(F.col("s")).alias("wrapped"),
        tx.message(F.col("s"), "unknown_error", 20).alias("error"), (F.length("s") > 20).alias("was_cut"),
    )


@query(r"""
with m as (select message_id, coalesce(text_body, html_body, '') t, row_number() over (partition by message_id order by received_at desc, coalesce(text_body, html_body, '') desc) rn from email_payloads where message_id is not null),
l as (select message_id, list_transform(regexp_extract_all(t, 'https?://[^\s"''<>]+'), lambda u: regexp_replace(u, '[),.;]+$', '')) us from m where rn = 1)
select message_id, coalesce(list_filter(us, lambda u: regexp_matches(u, '^https?://[^/]+/(?:p|posts|letters)/'))[1], us[1], '') as link, len(us) as links from l""")
def q71_mail_links(spark, d):
    """The link a mail is about: the first to a post, else the first; closing punctuation is no part of it."""
    mail = read(spark, d, "email_payloads").filter("message_id is not null").groupBy("message_id").agg(F.max(F.struct("received_at", F.coalesce("text_body", "html_body", F.lit("")).alias("t"))).alias("r")).select("message_id", F.col("r.t").alias("t"))
    found = urls.links_in(F.col("t"))
    return mail.select("message_id", F.coalesce(urls.preferred(found, r"^https?://[^/]+/(?:p|posts|letters)/"), F.lit("")).alias("link"), F.size(found).cast("long").alias("links"))


@query("with " + _LAST_BODY + """,
k as (select article_id, coalesce(word_count, 0) w, ['feed', 'page', 'post', 'short', 'essay'][1 + cast('0x' || substr(article_id, 1, 1) as int) % 5] kind from body)
select article_id, kind, case kind when 'feed' then case when w >= 600 then 0.99 when w >= 200 then 0.98 when w >= 80 then 0.95 when w >= 30 then 0.91 else 0.75 end when 'page' then case when w >= 200 then 0.98 when w >= 80 then 0.93 else 0.8 end
  when 'post' then case when w >= 200 then 0.99 when w >= 80 then 0.95 else 0.82 end when 'short' then case when w >= 150 then 0.96 else 0.9 end else case when w >= 301 then 0.98 else 0.91 end end as confidence from k""")
def q72_confidence_steps(spark, d):
    """How sure an extraction is, by the words it gave and the kind of its source."""
    rows = last_bodies(spark, d, "word_count")
    kind = F.element_at(F.array(*map(F.lit, ad.CONFIDENCE)), F.conv(F.substring("article_id", 1, 1), 16, 10).cast("int") % 5 + 1)
    return rows.select("article_id", kind.alias("kind"), ad.confidence(F.coalesce("word_count", F.lit(0)), kind).alias("confidence"))


@query("with " + ART + """,
l as (select id, pub, make_timestamp(pub + 28800000000) t from art where pub is not null), m as (select *, extract(hour from t) * 60 + extract(minute from t) mins, cast(t as date) d from l)
select id, upper(strftime(d, '%b')) as month, strftime(d, '%d') as day, strftime(d, '%Y') as year, upper(strftime(d, '%A')) as weekday, strftime(t, '%Y%m%d%H%M') as minute_key, cast(mins as int) as minutes,
  cast(case when mins < 360 then d - 1 else d end as varchar) as expected, mins >= 360 and mins < 390 as grace,
  epoch_us((case when mins < 420 then d - 1 else d end)::timestamp) - 5400000000 as check_since_us, epoch_us(d::timestamp) - 9000000000 as deferred_us, d::varchar || ' 06:00' as shown from m""")
def q73_date_parts(spark, d):
    """Civil dates as they are shown, keys by the minute, what must be out by now and when it is due."""
    at = F.col("published_at")
    arts = articles(spark, d).filter(at.isNotNull()).select("id", dates.public_parts(dates.civil_date(at)).alias("p"), dates.minute_key(at).alias("minute_key"), dates.health_window(at).alias("w"))
    return arts.select(
        "id", "p.month", "p.day", "p.year", "p.weekday", "minute_key", "w.minutes", F.col("w.expected").cast("string").alias("expected"), "w.grace", micros("w.check_since").alias("check_since_us"),
        micros(dates.at_civil_minute(F.col("w.day"), 330)).alias("deferred_us"), F.concat(F.col("w.day").cast("string"), F.lit(" 06:00")).alias("shown"),
    )


# ---- validation ----------------------------------------------------------------------------------------------------

@query("with " + ART + "," + _LAST_BODY + r""",
j as (select a.id, a.content_eligibility c, case when json_valid(a.content_eligibility) then a.content_eligibility end ok, b.text from art a left join body b on b.article_id = a.id),
p as (select id, c, ok, json_extract_string(ok, '$.version') v, json_extract_string(ok, '$.format') f, json_extract_string(ok, '$.reason') r, coalesce(try_cast(json_extract(ok, '$.bodyEvidence') as varchar[]), []) q, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) t from j)
select id, c is null as unknown, c is not null and ok is null as broken, coalesce(f, '') as format, coalesce(ok is not null and v = 'standalone-v1' and f in ('standalone_essay', 'media', 'roundup', 'abstract', 'announcement', 'excerpt', 'uncertain') and length(trim(r)) between 1 and 1000 and len(q) between 1 and 5
    and len(list_filter(q, lambda x: not coalesce(length(x) between 1 and 1000, false))) = 0, false) as valid,
  len(list_filter(q, lambda x: contains(t, trim(regexp_replace(x, '\s+', ' ', 'g'))) or (length(x) >= 40 and contains(t, substring(trim(regexp_replace(x, '\s+', ' ', 'g')), 1, 80))))) as quotes_found from p""")
def q40_eligibility_validation(spark, d):
    """Verdicts kept as JSON: unknown, broken or valid by version, format, reason and quotes, and quotes the body really has."""
    bodies = last_bodies(spark, d).select(F.col("article_id").alias("id"), "t")
    rows = articles(spark, d, "content_eligibility").select("id", "content_eligibility").join(bodies, "id", "left")
    c = F.col("content_eligibility")
    v = va.verdict(c)
    out = rows.select("id", c.isNull().alias("unknown"), (c.isNotNull() & F.try_parse_json(c).isNull()).alias("broken"), v.alias("v"), "t")
    quotes = F.coalesce("v.bodyEvidence", F.array().cast("array<string>"))
    return out.select("id", "unknown", "broken", F.coalesce("v.format", F.lit("")).alias("format"), va.valid_verdict(F.col("v")).alias("valid"), F.size(F.filter(quotes, lambda q: va.quoted(F.coalesce("t", F.lit("")), q))).cast("long").alias("quotes_found"))


@query("with " + ART + """,
c as (select id, intrinsic s, coalesce(primary_theme, '') th, coalesce(title, '') ti, coalesce(context_summary, '') su, coalesce(keywords, []) k, coalesce(analysis_confidence, -1.0) a from art)
select id, coalesce(s between 0 and 10, false) as score_ok, coalesce(a between 0 and 1, false) as confidence_ok, th in ('education', 'history', 'economics', 'science', 'markets', 'startups', 'decision-making', 'writing', 'investing', 'psychology', 'philosophy', 'technology', 'culture', 'policy') as theme_ok,
  length(su) between 40 and 240 and length(ti) between 10 and 200 as copy_ok, len(k) between 3 and 5 and len(list_filter(k, lambda x: not coalesce(length(trim(x)) between 1 and 80, false))) = 0 as keywords_ok from c""")
def q65_field_validators(spark, d):
    """Which fields of an analysis that was sent in are as they must be."""
    c = articles(spark, d, "title", "context_summary", "keywords", "analysis_confidence")
    none = F.array().cast("array<string>")
    return c.select(
        "id", va.number_in(F.col("intrinsic"), 0, 10).alias("score_ok"), va.number_in(F.col("analysis_confidence"), 0, 1).alias("confidence_ok"), F.coalesce("primary_theme", F.lit("")).isin(*va.THEMES).alias("theme_ok"),
        (va.length_in(F.col("context_summary"), 40, 240) & va.length_in(F.col("title"), 10, 200)).alias("copy_ok"), va.strings_in(F.coalesce("keywords", none), 3, 5, 80).alias("keywords_ok"),
    )


# ---- sources -------------------------------------------------------------------------------------------------------

_PAGES = f"""
one as (select article_id, source_id, trim(min(coalesce(title, '')), ' ' || chr(9) || chr(10) || chr(13)) title, trim(min(coalesce(author, '')), ' ' || chr(9) || chr(10) || chr(13)) author from discovered_articles where article_id is not null and source_id is not null group by 1, 2),
placed as (select *, (row_number() over (partition by source_id order by article_id) - 1) // 5 + 1 as page, row_number() over (partition by source_id order by article_id) - 1 as n, 'https://' || source_id || '.example/p/' || substr(article_id, 1, 2) link, {hexed_sql("article_id", 2)} % 4 = 0 video from one),
win as (select id source_id, case when history_pages <= 5 then range(1, greatest(history_pages, 1) + 1) else list_prepend(1, range(history_pages - 3, history_pages + 1)) end pages, author_scope from sources),
ends as (select p.source_id, min(case when page > 1 and {hexed_sql("article_id", 3)} = 0 and n % 5 = 0 then page end) stop from placed p join win w on w.source_id = p.source_id and list_contains(w.pages, p.page) group by 1)
"""


def feed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Feeds as they were fetched: five items a page, some pages refused."""
    one = read(spark, d, "discovered_articles").filter("article_id is not null and source_id is not null").groupBy("article_id", "source_id").agg(F.min(F.coalesce("title", F.lit(""))).alias("title"), F.min(F.coalesce("author", F.lit(""))).alias("author"))
    n = F.row_number().over(W.partitionBy("source_id").orderBy("article_id")) - 1
    placed = one.withColumn("n", n).withColumn("page", F.floor(F.col("n") / 5).cast("int") + 1)
    item = feeds.item(F.col("title"), F.concat(F.lit("https://"), "source_id", F.lit(".example/p/"), F.substring("article_id", 1, 2)), F.col("author"), F.lit("<p>Body</p>"), F.when(F.conv(F.substring("article_id", 2, 1), 16, 10).cast("int") % 4 == 0, "Video").otherwise("Articles"))
    refused = F.max(((F.conv(F.substring("article_id", 3, 1), 16, 10) == "0") & (F.col("n") % 5 == 0) & (F.col("page") > 1)).cast("int"))
    return placed.groupBy("source_id", "page").agg(F.concat(F.lit("<channel>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("x")))), lambda s: s["x"]), ""), F.lit("</channel>")).alias("body"), F.when(refused == 1, 404).otherwise(200).alias("status"))


@query("with " + _PAGES + """,
kept as (select p.* from placed p join win w on w.source_id = p.source_id and list_contains(w.pages, p.page) left join ends e on e.source_id = p.source_id
  where (e.stop is null or p.page < e.stop) and trim(p.title) <> '' and not p.video and list_contains(w.author_scope, p.author))
select source_id, link, cast(page as int) as page, title from (select *, row_number() over (partition by source_id, link order by page, n) rn from kept) where rn = 1""")
def q74_feed_scan(spark, d):
    """The pages of each source's window up to the first that was refused: items by the source's authors, no videos, once each."""
    sources = read(spark, d, "sources").select(F.col("id").alias("source_id"), "author_scope", planning.page_window(F.greatest(F.lit(1), "history_pages")).alias("pages"))
    asked = feed_pages(spark, d).join(sources.select("source_id", F.explode("pages").alias("page")), ["source_id", "page"])
    parsed = asked.withColumn("items", feeds.items(F.col("body")))
    listed = ad.reached(parsed, F.size("items")).select("source_id", "page", F.posexplode("items").alias("n", "i")).select("source_id", "page", "n", "i.title", "i.link", "i.author", "i.body", "i.categories")
    settings = sources.select("source_id", F.col("author_scope").alias("allowed"), F.lit("Video").alias("without"))
    return ad.first_listed(ad.accepted_items(listed, settings), "page", "n").select("source_id", "link", "page", "title")


@query(f"""
with one as (select source_id, article_id, regexp_replace(trim(min(coalesce(title, ''))), '[ \\t]+', ' ', 'g') title from discovered_articles where source_id is not null and article_id is not null group by 1, 2)
select source_id, 'https://index.example/blog/' || article_id as link, title from one where {hexed_sql("article_id", 1)} % 4 < 2 and title <> ''""")
def q75_index_scan(spark, d):
    """The articles of every source's index pages: relative and absolute links, without query and fragment, no podcasts, on
    the host only."""
    rows = read(spark, d, "discovered_articles").filter("source_id is not null and article_id is not null")
    one = rows.groupBy("source_id", "article_id").agg(F.min(F.coalesce("title", F.lit(""))).alias("title"))
    k = F.conv(F.substring("article_id", 1, 1), 16, 10).cast("int") % 4
    href = F.when(k == 0, F.concat(F.lit("/blog/"), "article_id", F.lit("?ref=x"))).when(k == 1, F.concat(F.lit("https://index.example/blog/"), "article_id", F.lit("#top"))).when(k == 2, F.concat(F.lit("/podcast/"), "article_id")).otherwise(F.concat(F.lit("https://other.example/blog/"), "article_id"))
    anchor = F.concat(F.lit('<li><a class="t" href="'), href, F.lit('">'), tx.escaped(F.trim("title")), F.lit("</a></li>"))
    pages = one.groupBy("source_id", F.pmod(F.hash("article_id"), F.lit(7)).alias("page")).agg(F.array_join(F.array_sort(F.collect_list(anchor)), "\n").alias("body"))
    rules = ad.Source("index", "index", "https://index.example", segments=2, deny="^/(?:podcast|video|members)/")
    return ad.index_links(pages, rules).select("source_id", "link", "title")


@query(f"""
with one as (select source_id, article_id, min(coalesce(title, '')) title from discovered_articles where article_id is not null group by 1, 2),
n as (select *, row_number() over (partition by source_id order by article_id) k, 'https://' || source_id || '.example/p/' || case when {hexed_sql("article_id", 1)} = 0 then 'links-for-' else 'slug-' end || article_id link from one),
feed as (select source_id, link, title, -1 place from n where k <= 3),
more as (select source_id, link, (case when link like '%links-for-%' then 'Links For ' else 'Slug ' end) || upper(substr(article_id, 1, 1)) || substr(article_id, 2) title, k place from n where k > 3 and link not like '%links-for-%'),
both_ as (select * from feed union all select * from more), r as (select *, row_number() over (partition by source_id order by place, link) rn from both_)
select source_id, link, title from r where place < 0 or rn <= 40""")
def q76_sitemap_union(spark, d):
    """What the feed shows, filled up from the sitemap to forty articles, round-ups left out."""
    one = read(spark, d, "discovered_articles").filter("article_id is not null").groupBy("source_id", "article_id").agg(F.min(F.coalesce("title", F.lit(""))).alias("title"))
    slug = F.when(F.conv(F.substring("article_id", 1, 1), 16, 10) == "0", F.lit("links-for-")).otherwise(F.lit("slug-"))
    n = one.withColumn("link", F.concat(F.lit("https://"), "source_id", F.lit(".example/p/"), slug, "article_id")).withColumn("k", F.row_number().over(W.partitionBy("source_id").orderBy("article_id")))
    maps = n.groupBy("source_id").agg(feeds.sitemap(F.transform(F.array_sort(F.collect_list(F.struct("k", "link"))), lambda s: s["link"])).alias("body")).withColumn("status", F.lit(200))
    found = maps.select("source_id", F.posexplode(feeds.sitemap_links(F.col("body"), F.concat(F.lit("https://"), "source_id", F.lit(".example")))).alias("place", "link"))
    return ad.filled_up(n.filter("k <= 3").select("source_id", "link", "title"), found, ad.NO_ARTICLES, 40).select("source_id", "link", "title")


@query(f"""
with p as (select article_id, coalesce(title, '') title, inline_html h, discovered_at t, row_number() over (partition by article_id order by discovered_at desc, coalesce(title, '') desc) rn from discovered_articles where article_id is not null),
q as (select *, {hexed_sql("article_id", 1)} k from p where rn = 1)
select article_id, k % 5 <> 0 and k % 7 <> 0 and coalesce(trim(h), '') <> '' as free, case when k % 5 <> 0 and k % 7 <> 0 and coalesce(trim(h), '') <> '' then title end as title, case when k % 5 <> 0 and k % 7 <> 0 and coalesce(trim(h), '') <> '' then strlen(h) else -1 end as bytes from q""")
def q78_json_posts(spark, d):
    """Posts sent as JSON: read by schema, kept if anyone may read them as text."""
    rows = read(spark, d, "discovered_articles").filter("article_id is not null").groupBy("article_id").agg(F.max_by(F.struct(F.coalesce("title", F.lit("")).alias("title"), "inline_html"), F.struct("discovered_at", F.coalesce("title", F.lit("")))).alias("r"))
    k = F.conv(F.substring("article_id", 1, 1), 16, 10).cast("int")
    sent = F.to_json(F.struct(F.when(k % 5 == 0, "only_paid").otherwise("everyone").alias("audience"), F.lit("newsletter").alias("type"), F.when(k % 7 == 0, "https://x.example/a.mp3").alias("podcast_url"), F.col("r.title").alias("title"), F.col("r.inline_html").alias("body_html")))
    post = F.from_json(sent, "audience string, type string, podcast_url string, video_upload_id string, free_unlock_required boolean, title string, body_html string")
    out = rows.select("article_id", post.alias("p"))
    free = ad.free_post(F.col("p")) & (F.coalesce(F.trim("p.body_html"), F.lit("")) != "")
    return out.select("article_id", free.alias("free"), F.when(free, F.col("p.title")).alias("title"), F.when(free, F.octet_length("p.body_html")).otherwise(-1).cast("long").alias("bytes"))


@query(r"""
with t as (select article_id, canonical_url base, inline_html h, row_number() over (partition by article_id order by discovered_at desc) rn from discovered_articles where article_id is not null),
l as (select article_id, base, regexp_extract_all(h, '(?is)<a\s[^>]*href\s*=\s*["'']([^"'']*)["''][^>]*>.*?</a>', 1) hs from t where rn = 1),
f as (select article_id, base, unnest(hs) raw from l), r as (select article_id, base, trim(replace(raw, '&amp;', '&')) c from f),
a as (select article_id, case when regexp_matches(c, '(?i)^https?://') then c when c like '//%' then regexp_extract(base, '(?i)^(https?:)', 1) || c when c like '/%' then regexp_extract(base, '(?i)^(https?://[^/?#]+)', 1) || c
  when c = '' or c like '#%' or regexp_matches(c, '(?i)^[a-z][a-z0-9+.-]*:') then null else regexp_extract(base, '(?i)^(https?://[^?#]*/)', 1) || c end url from r),
n as (select article_id, """ + _NORM + " as href from (select article_id, " + _URL.format("url") + """ u from a where url is not null))
select article_id, href, count(*) as times from n where href is not null group by 1, 2""")
def q42_link_targets(spark, d):
    """The pages each page links to, resolved and normalised, and how often."""
    pages = read(spark, d, "discovered_articles").filter("article_id is not null").groupBy("article_id").agg(F.max_by(F.struct("canonical_url", "inline_html"), F.struct("discovered_at", "canonical_url")).alias("r")).select("article_id", "r.*")
    return feeds.page_links(pages, "inline_html", "canonical_url", "article_id").groupBy("article_id", "href").agg(F.count(F.lit(1)).alias("times"))


@query()
def q77_selected_text(spark, d):
    """Headings and paragraphs inside the article element of each page, by selector."""
    from ..sources.selectors import selected

    pages = rel.latest(read(spark, d, "discovered_articles").select("article_id", "discovered_at", "inline_html"), "article_id", [F.col("discovered_at")])
    return pages.select("article_id", selected(F.col("inline_html"), "h1").alias("heading"), F.length(selected(F.col("inline_html"), "article p")).alias("paragraph_chars"))


# ---- facets and counts ---------------------------------------------------------------------------------------------

@query("with " + ART + """,
f as (select 'author' facet, author v from art where author is not null and trim(author) <> '' union all select 'theme', primary_theme from ready_articles where primary_theme is not null union all select 'year', cast(extract(year from published_at) as varchar) from art where published_at is not null),
u as (select distinct facet, v from f)
select facet, v as value, cast(row_number() over (partition by facet order by case when facet = 'year' then v end desc, v) as int) as place from u qualify place <= 50""")
def q79_sorted_facets(spark, d):
    """The values to filter by: authors and themes in order, years newest first; themes of all analyses, not only the latest."""
    last = rel.latest(read(spark, d, "ready_articles").select("id", "author", "published_at", "analyzed_at", "loaded_at"), "id", [F.col("analyzed_at"), F.col("loaded_at")])
    a = last.filter("trim(author) != ''").select(F.lit("author").alias("facet"), F.col("author").alias("v"))
    t = read(spark, d, "ready_articles").filter("primary_theme is not null").select(F.lit("theme").alias("facet"), F.col("primary_theme").alias("v"))
    y = last.filter("published_at is not null").select(F.lit("year").alias("facet"), F.year("published_at").cast("string").alias("v"))
    w = W.partitionBy("facet").orderBy(F.when(F.col("facet") == "year", F.col("v")).desc_nulls_first(), "v")
    return a.union(t).union(y).distinct().withColumn("place", F.row_number().over(w)).filter("place <= 50").select("facet", F.col("v").alias("value"), "place")


@query("""
with o as (select source_id, case when text is null then 'skipped' when extraction_confidence < 0.8 then 'error' when external_link_count > 8 then 'rejected' else 'analyzed' end outcome from (select *, row_number() over (partition by article_id order by extracted_at desc, coalesce(text, '') desc) rn from extracted_articles where article_id is not null) where rn = 1)
select coalesce(source_id, '') as source_id, count(*) as discovered, count(*) filter (where outcome = 'analyzed') as analyzed, count(*) filter (where outcome = 'rejected') as rejected, count(*) filter (where outcome = 'skipped') as skipped, count(*) filter (where outcome = 'error') as errors from o group by 1""")
def q80_ingest_summary(spark, d):
    """What became of each source's articles."""
    rows = read(spark, d, "extracted_articles").filter("article_id is not null").groupBy("article_id").agg(F.max_by(F.struct("source_id", "text", "extraction_confidence", "external_link_count"), F.struct("extracted_at", F.coalesce("text", F.lit("")))).alias("r")).select("r.*")
    outcome = F.when(F.col("text").isNull(), "skipped").when(F.col("extraction_confidence") < 0.8, "error").when(F.col("external_link_count") > 8, "rejected").otherwise("analyzed")
    n = lambda o: F.sum((F.col("o") == o).cast("int"))
    return rows.select(F.coalesce("source_id", F.lit("")).alias("source_id"), outcome.alias("o")).groupBy("source_id").agg(F.count(F.lit(1)).alias("discovered"), n("analyzed").alias("analyzed"), n("rejected").alias("rejected"), n("skipped").alias("skipped"), n("error").alias("errors"))


@query("""select source_id, url from (select distinct source_id, 'https://' || source_id || '.example/p/' || article_id url, cast(date_trunc('day', min(published_at) over (partition by source_id, article_id)) as varchar) d, article_id from discovered_articles where source_id is not null and article_id is not null)
  qualify row_number() over (partition by source_id order by d desc nulls last, article_id) <= 5000""")
def q46_sitemap_newest(spark, d):
    """The newest 5,000 posts of each source, written as a sitemap and read back."""
    posts = read(spark, d, "discovered_articles").filter("source_id is not null and article_id is not null").groupBy("source_id", "article_id").agg(F.date_trunc("DAY", F.min("published_at")).alias("day"))
    w = W.partitionBy("source_id").orderBy(F.col("day").desc_nulls_last(), "article_id")
    top = posts.withColumn("n", F.row_number().over(w)).filter("n <= 5000")
    url = F.concat(F.lit("https://"), "source_id", F.lit(".example/p/"), "article_id")
    maps = top.groupBy("source_id").agg(feeds.sitemap(F.transform(F.array_sort(F.collect_list(F.struct("n", url.alias("u")))), lambda s: s["u"])).alias("xml"))
    origin = F.concat(F.lit("https://"), "source_id", F.lit(".example"))
    return maps.select("source_id", F.explode(feeds.sitemap_links(F.col("xml"), origin)).alias("url"))


# ---- the rest of the reading path ------------------------------------------------------------------------------------

@query(f"""
with p as (select id, analyzed_at, {hexed_sql("id", 1)} % 5 k, {hexed_sql("id", 3)} % 5 tries from (select *, row_number() over (partition by id order by analyzed_at desc nulls last, loaded_at desc) rn from ready_articles where id is not null) where rn = 1)
select id, case k when 1 then 'analysis_failed' else 'discovered' end as status, cast(row_number() over (order by case k when 1 then 0 else 1 end, analyzed_at nulls first, id) as int) as place,
  coalesce(epoch_us(analyzed_at) + case k when 1 then 7 else 90 end * 86400000000, -1) as expires_us from p where k in (0, 1) and not (k = 1 and tries >= 3) qualify place <= 50""")
def q81_pending_order(spark, d):
    """Fifty articles to work on next: failed ones with retries left first, then new ones, the longest waiting first; and
    when their bodies expire."""
    last = rel.latest(read(spark, d, "ready_articles").select("id", "analyzed_at", "loaded_at"), "id", [F.col("analyzed_at"), F.col("loaded_at")])
    digit = lambda n: F.conv(F.substring("id", n, 1), 16, 10).cast("int") % 5
    rows = last.select("id", "analyzed_at", digit(1).alias("k"), digit(3).alias("tries")).filter("k in (0, 1) and not (k = 1 and tries >= 3)")
    order = [F.when(F.col("k") == 1, 0).otherwise(1), F.col("analyzed_at").asc_nulls_first(), F.col("id")]
    top = rows.orderBy(*order).limit(50).withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))  # fifty rows
    days = F.when(F.col("k") == 1, 7).otherwise(90)
    return top.select("id", F.when(F.col("k") == 1, "analysis_failed").otherwise("discovered").alias("status"), "place", F.coalesce(micros("analyzed_at") + days * 86_400_000_000, F.lit(-1)).alias("expires_us"))


@query("""
with a as (select case when event_id % 3 = 0 then 'Source-Failed:' || user_id when event_id % 3 = 1 then 'source-failed:' || user_id || ':' || cast(ts as date) else 'stalled' end key, event_type t, epoch_us(ts) u from events)
select t as kind, count(*) as rows, cast(sum(case when key ilike 'source-failed:7' or key ilike 'source-failed:7:%' then 1 else 0 end) as bigint) as resolved, max(case when key ilike 'source-failed:%' then u end) as last_us from a group by t""")
def q82_resolved_by_prefix(spark, d):
    """Alerts of one source, by their key or a key that begins with it and a colon, in any case; counts by kind."""
    rows = read(spark, d, "events").select("event_type", micros("ts").alias("u"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Source-Failed:"), F.col("user_id").cast("string"))).when(F.col("event_id") % 3 == 1, F.concat_ws(":", F.lit("source-failed"), F.col("user_id").cast("string"), F.to_date("ts").cast("string"))).otherwise("stalled").alias("key"))
    mine = va.under(F.col("key"), "source-failed:7")
    return rows.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("rows"), F.sum(mine.cast("int")).alias("resolved"), F.max(F.when(F.lower("key").startswith("source-failed:"), F.col("u"))).alias("last_us"))


@query(r"""
with m as (select message_id, from_address, canonical_url c, row_number() over (partition by message_id order by received_at desc, coalesce(from_address, '') desc) rn from email_payloads where message_id is not null),
s as (select message_id, lower(regexp_extract(coalesce(from_address, ''), '@([A-Za-z0-9.-]+)$', 1)) host, substring(regexp_replace(regexp_replace(trim(message_id), '[^a-zA-Z0-9._@+-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 180) slug, nullif(trim(c), '') c from m where rn = 1)
select message_id, 'https://' || case when host = '' then 'mail.invalid' else host end || '/mail/' || case when slug = '' then 'unknown' else slug end as address, c is not null as has_own from s""")
def q84_mail_addresses(spark, d):
    """The address a message without one gets from its sender's host and its id."""
    mail = read(spark, d, "email_payloads").filter("message_id is not null").groupBy("message_id").agg(F.max_by(F.struct("from_address", "canonical_url"), F.struct("received_at", F.coalesce("from_address", F.lit("")))).alias("r")).select("message_id", "r.*")
    made = feeds.mail_address(F.col("message_id"), F.coalesce("from_address", F.lit("")))
    return mail.select("message_id", made.alias("address"), F.nullif(F.trim("canonical_url"), F.lit("")).isNotNull().alias("has_own"))


@query(r"""
with t as (select doc_id, coalesce(text, '') t from documents)
select distinct doc_id, case when length(t) <= 120 then t when regexp_extract(substring(t, 1, 120), '(?s)^(.*[.!?。！？；])', 1) <> '' then regexp_extract(substring(t, 1, 120), '(?s)^(.*[.!?。！？；])', 1) else substring(t, 1, 120) end as short from t""")
def q85_cut_sentences(spark, d):
    """Texts of at most 120 characters that end with a sentence where one ends in them."""
    return read(spark, d, "documents").select("doc_id", tx.cut_at_punctuation(F.coalesce("text", F.lit("")), 120).alias("short")).distinct()


_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


@query(rf"""
with p as (select article_id, title, inline_html h, text t, row_number() over (partition by article_id order by discovered_at desc, coalesce(title, '') desc) rn from discovered_articles where article_id is not null),
q as (select article_id, coalesce(title, '') given, regexp_extract(coalesce(h, ''), '(?is)<meta[^>]*(?:property|name)\s*=\s*["'']og:title["''][^>]*content\s*=\s*["'']([^"'']*)["'']', 1) og, regexp_extract(coalesce(t, '') || ' May 2019', '\b({_MONTHS})\s+(\d{{4}})\b', 0) d from p where rn = 1)
select article_id, og <> '' as has_og, given, strftime(try_strptime(regexp_replace(d, '\s+', ' ', 'g') || ' 1', '%B %Y %d'), '%Y-%m-%d') as sniffed from q""")
def q83_page_titles(spark, d):
    """Whether a page names its title itself, the title given, and the first month and year its text tells."""
    p = read(spark, d, "discovered_articles").filter("article_id is not null").groupBy("article_id").agg(F.max_by(F.struct("title", F.coalesce("inline_html", F.lit("")).alias("h"), F.coalesce("text", F.lit("")).alias("t")), F.struct("discovered_at", F.coalesce("title", F.lit("")))).alias("r")).select("article_id", "r.*")
    return p.select("article_id", (F.coalesce(tx.meta(F.col("h"), "og:title"), F.lit("")) != "").alias("has_og"), F.coalesce("title", F.lit("")).alias("given"), dates.sniffed_month(F.concat("t", F.lit(" May 2019"))).cast("string").alias("sniffed"))
