"""Queries over the test tables that cover the core operators, and SQL that says the same.

Instants are parameters with fixed defaults, so results don't depend on the clock. Times leave as microseconds and dates
as text, so that both engines write them alike.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import dates, hashing, text as tx, urls, vectors
from ..functions.numbers import reading_minutes, storage_level
from ..operators import events as ev, learning, planning, ranking, relations as rel
from ..sources import feeds
from ..tables import read, size_checked

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AS_OF = "2025-08-22 22:00:00"  # 06:00 of the next civil day
DAY = "2025-08-23"
_EPOCH = int(dt.datetime.fromisoformat(AS_OF + "+00:00").timestamp() * 1_000_000)
SCORES = ["intrinsic_score", "long_term_value", "idea_density", "argument_quality", "originality", "clarity_structure"]
# Ordered themes and their patterns.
THEMES = [
    ("风险与不确定性", "risk|uncertain|probab|fragil|volatil"),
    ("工作与创造", "work|create|writing|maker|craft|career"),
    ("创业与商业", "startup|founder|business|company|entrepreneur"),
    ("投资与资本配置", "invest|capital|market|portfolio|return"),
    ("科技与产业", "technology|software|internet|industry|platform"),
    ("经济与制度", "econom|institution|policy|trade|regulat"),
    ("决策与判断", "decision|judgment|choice|strategy|think"),
    ("人生与长期主义", "life|long.term|compound|future|ambition"),
]
QUERIES_AT_ONCE = 16_384
OTHER_THEME = "学习与知识"
# Titles and words of pieces that don't stand alone.
GATE_TITLE_PATTERNS = [
    r"\bassorted links\b",
    r"\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday) links\b",
    r"\bpodcast\b",
    r"\bwebinar\b",
    r"^open thread\b",
    r"\bmeetups? everywhere\b",
]
GATE_TITLES = "|".join(GATE_TITLE_PATTERNS)
GATE_MEDIA_URL = r"(?i)knowledge-project-podcast|/podcast/"
GATE_MEDIA = "listen|watch|youtube|spotify"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def hexed_sql(c: str, place: int) -> str:
    """A hexadecimal digit of an id as a number, in SQL."""
    return f"cast('0x' || substr({c}, {place}, 1) as int)"


def now() -> Column:
    return F.timestamp_micros(F.lit(_EPOCH).cast("long"))


def r6(x: Column) -> Column:
    return F.floor(x * 1e6 + 0.5) / 1e6


def micros(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


# ---- views of the domain -------------------------------------------------------------------------------------------

def articles(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """The latest analysis of every article."""
    cols = ["id", "source_id", "author", "primary_theme", "published_at", "word_count", *SCORES, "analyzed_at", *more]
    last = rel.latest(read(spark, d, "ready_articles").select(*cols), "id", [F.col("analyzed_at")])
    return last.withColumns({"author": F.coalesce(F.nullif(F.trim("author"), F.lit("")), "source_id"), "theme": F.col("primary_theme"), "intrinsic": F.col("intrinsic_score")})


def history(arts: DataFrame) -> DataFrame:
    """The best article of each civil day of the last sixty days: what was read."""
    age = dates.age_days(F.col("published_at"), now())
    past = arts.filter((age > 0) & (age <= 60) & F.col("intrinsic").isNotNull()).withColumn("day", dates.civil_date(F.col("published_at")))
    best = past.groupBy("day").agg(F.max_by(F.struct("id", "author", "theme"), F.struct("intrinsic", F.col("id"))).alias("b"))
    return best.select("day", "b.*")


ART = """
latest as (select * from (select *, row_number() over (partition by id order by analyzed_at desc nulls last, loaded_at desc) rn from ready_articles where id is not null) where rn = 1),
art as (select *, coalesce(nullif(trim(author), ''), source_id) who, primary_theme theme, intrinsic_score intrinsic, epoch_us(published_at) pub from latest)
"""
HIST = ART + f""",
past as (select *, cast(make_timestamp(pub + 28800000000) as date) as d from art where pub is not null and intrinsic is not null and pub < {_EPOCH} and pub >= {_EPOCH} - 60 * 86400000000),
hist as (select d, id, who, theme, ({_EPOCH} - (epoch_us(d::timestamp) - 28800000000)) / 86400000000.0 age
  from (select *, row_number() over (partition by d order by intrinsic desc, id desc) k from past) where k = 1)
"""
RANKED = HIST + f""",
af as (select who, case when max(case when age < 2 then 1 else 0 end) = 1 then 100.0 else floor(sum(case when age <= 3 then 1.25 when age <= 7 then 0.65 when age <= 14 then 0.2 else 0 end) * 1000 + 0.5) / 1000 end ap from hist group by who),
tf as (select theme, floor(sum(case when age <= 7 then 1 else 0 end) * 0.35 * 1000 + 0.5) / 1000 tp, case when count(*) = 1 then 0.2 else 0.0 end ex from hist group by theme),
cand as (select id, who author, theme, pub, intrinsic, greatest(0.0, ({_EPOCH} - pub) / 86400000000.0) age from art
  where intrinsic >= 7.5 and long_term_value >= 7 and idea_density >= 7 and least(long_term_value, idea_density, argument_quality, originality, clarity_structure) >= 5),
parts as (select c.*, case when pub is null then 0.0 when age <= 3 then 0.8 when age <= 7 then 0.64 when age <= 14 then 0.4 when age <= 30 then 0.16 else 0.0 end fresh,
  coalesce(ap, 0.0) author_penalty, coalesce(tp, 0.0) theme_penalty, least(0.75, coalesce(ex, 0.45)) exploration
  from cand c left join af on af.who = c.author left join tf on tf.theme = c.theme),
ranked as (select id, author, theme, intrinsic, fresh, author_penalty, theme_penalty, exploration, floor((intrinsic + fresh + exploration + 0.0 + 0.0 - author_penalty - theme_penalty) * 1000 + 0.5) / 1000 dynamic from parts)
"""


def gated(arts: DataFrame) -> DataFrame:
    dims = [F.col(c) for c in SCORES[1:]]
    return arts.filter((F.col("intrinsic") >= 7.5) & (F.col("long_term_value") >= 7) & (F.col("idea_density") >= 7) & (F.least(*dims) >= 5) & F.forall(F.array(*dims), lambda x: x.isNotNull()))


# ---- gates and ranking ---------------------------------------------------------------------------------------------

@query("with " + ART + """
select id, floor((long_term_value * 0.3 + idea_density * 0.25 + argument_quality * 0.2 + originality * 0.15 + clarity_structure * 0.1) * 1000 + 0.5) / 1000 as weighted,
  coalesce(intrinsic >= 7.5 and long_term_value >= 7 and idea_density >= 7 and least(long_term_value, idea_density, argument_quality, originality, clarity_structure) >= 5
    and extraction_confidence >= 0.9 and analysis_confidence >= 0.7, false) as passes
from art""")
def q01_quality_gate(spark, d):
    arts = articles(spark, d, "extraction_confidence", "analysis_confidence")
    dims = [F.col(c) for c in SCORES[1:]]
    passes = (F.col("intrinsic") >= 7.5) & (F.col("long_term_value") >= 7) & (F.col("idea_density") >= 7) & (F.least(*dims) >= 5) & (F.col("extraction_confidence") >= 0.9) & (F.col("analysis_confidence") >= 0.7)
    return arts.select("id", ranking.weighted_score().alias("weighted"), F.coalesce(passes, F.lit(False)).alias("passes"))


@query("with " + ART + f"""
select id, case when pub is null then 0.0 when greatest(0.0, ({_EPOCH} - pub) / 86400000000.0) <= 3 then 0.8 when ({_EPOCH} - pub) / 86400000000.0 <= 7 then 0.64
  when ({_EPOCH} - pub) / 86400000000.0 <= 14 then 0.4 when ({_EPOCH} - pub) / 86400000000.0 <= 30 then 0.16 else 0.0 end as freshness from art""")
def q02_freshness_decay(spark, d):
    return articles(spark, d).select("id", ranking.freshness(F.col("published_at"), now()).alias("freshness"))


@query("with " + RANKED + "select who as author, ap as author_penalty from af")
def q03_author_fatigue(spark, d):
    return ranking.author_fatigue(history(articles(spark, d)), now())


@query("with " + RANKED + "select theme, tp as theme_penalty, ex as exploration from tf")
def q04_theme_fatigue(spark, d):
    return ranking.theme_fatigue(history(articles(spark, d)), now())


@query("with " + ART + f"""
select id, floor((list_reduce(list_prepend(2166136261::bigint, list_transform(string_split('{DAY}:' || id, ''), lambda c: ord(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) / 4294967295.0 * 2 * 0.3 - 0.3) * 1000 + 0.5) / 1000 as jitter from art""")
def q06_daily_jitter(spark, d):
    return articles(spark, d).select("id", hashing.jitter(F.concat(F.lit(f"{DAY}:"), "id")).alias("jitter"))


_RECENT = """usable as (select article_id, arg_max(list_transform(vec_values, lambda x: x::double), created_at) v from article_embeddings where embedding_version = 'emb-v2' and len(vec_values) = 384
  and len(list_filter(vec_values, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vec_values, lambda x: x <> 0)) > 0 group by article_id),
recent as (select v from (select u.v, a.pub, a.id from usable u join art a on a.id = u.article_id where a.pub is not null order by a.pub desc, a.id limit 7))"""


def usable_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "article_embeddings").filter("embedding_version = 'emb-v2'").filter(vectors.usable(F.col("vec_values"), 384))
    return rel.latest(rows.select(F.col("article_id").alias("id"), "created_at", F.col("vec_values").alias("vec")), "id", [F.col("created_at")]).drop("created_at")


@query("with " + ART + "," + _RECENT + """,
s as (select u.article_id id, max(list_cosine_similarity(u.v, r.v)) s from usable u, recent r group by u.article_id)
select id, floor(s * 1000000 + 0.5) / 1000000 as similarity, case when s between 0.25 and 0.82 then floor(least(0.35, (s - 0.25) * 0.65) * 1000000 + 0.5) / 1000000 else 0.0 end as connection,
  case when s < 0.2 then 0.3 when s < 0.35 then 0.15 else 0.0 end as semantic_exploration from s""")
def q08_semantic_signals(spark, d):
    vecs = usable_vectors(spark, d)
    last = vecs.join(articles(spark, d).select("id", "published_at").filter("published_at is not null"), "id").orderBy(F.col("published_at").desc(), "id").limit(7)
    recent = [[float(x) for x in r["vec"]] for r in last.collect()]
    out = ranking.semantic_signals(vecs, recent, vectors.cosine)
    return out.select("id", r6(F.col("similarity")).alias("similarity"), r6(F.col("connection")).alias("connection"), "semantic_exploration")


_MIX = "with m as (select i, xor(y, y >> 16) h from (select i, (xor(x, x >> 16) * 73244475) & 4294967295 y from (select i, (xor(i, i >> 16) * 73244475) & 4294967295 x from range(0, 17171 + 384) t(i))))"


@query(_MIX + """,
cells as (select a.i, a.h % 64 bucket, case when b.h % 2 = 0 then 1 else -1 end sign from m a join m b on b.i = a.i + 17171 where a.i < 384),
usable as (select article_id, arg_max(list_transform(vec_values, lambda x: x::double), created_at) v from article_embeddings where embedding_version = 'emb-v2' and len(vec_values) = 384
  and len(list_filter(vec_values, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vec_values, lambda x: x <> 0)) > 0 group by article_id),
flat as (select article_id, unnest(v) x, unnest(range(384)) i from usable),
sums as (select article_id, bucket, sum(x * sign) s from flat join cells using (i) group by all),
norms as (select article_id, sqrt(sum(s * s)) n from sums group by 1)
select article_id as id, cast(bucket as int) as place, floor(s / n * 1000000 + 0.5) / 1000000 as value from sums join norms using (article_id)""")
def q09_projection(spark, d):
    out = usable_vectors(spark, d).select("id", vectors.projected(F.col("vec"), 384).alias("p"))
    return out.select("id", F.posexplode("p").alias("place", "v")).select("id", "place", r6(F.col("v")).alias("value"))


@query(r"""
with docs as (select doc_id, regexp_extract_all(lower(replace(coalesce(title, '') || ' ' || coalesce(title, '') || ' ' || coalesce(text, ''), 'İ', 'i' || chr(775))), '[\p{L}\p{N}]{2,}') w from documents),
toks as (select doc_id, unnest(w) t, 1.0 weight from docs union all
  select doc_id, unnest(list_transform(range(2, len(w) + 1), lambda i: w[i - 1] || '_' || w[i])) t, 0.6 weight from docs where len(w) > 1),
names as (select distinct t from toks),
units as (select t, list_transform(range(1, length(t) + 1), lambda i: ord(substring(t, i, 1))::bigint) u from names),
hashed as (select t, list_reduce(list_prepend(2166136261::bigint, list_concat_all), lambda h, c: (xor(h, c) * 16777619) & 4294967295) h from (
  select t, flatten(list_transform(u, lambda c: case when c > 65535 then [55296 + ((c - 65536) >> 10), 56320 + ((c - 65536) & 1023)] else [c] end)) list_concat_all from units)),
sums as (select doc_id, h % 64 place, sum(case when h >= 2147483648 then -weight else weight end) s from toks join hashed using (t) group by all),
norms as (select doc_id, sqrt(sum(s * s)) n from sums group by 1)
select doc_id, cast(place as int) as place, floor(s / n * 1000000 + 0.5) / 1000000 as value from sums join norms using (doc_id) where abs(s) > 1e-9""")
def q10_feature_hash_embedding(spark, d):
    out = learning.feature_hash_embedding(read(spark, d, "documents"), "doc_id", "title", "text", 64)
    return out.select("doc_id", F.posexplode("vec").alias("place", "v")).filter(F.abs("v") > 1e-10).select("doc_id", "place", r6(F.col("v")).alias("value"))


_FNV = "list_reduce(list_prepend(2166136261::bigint, list_transform(string_split({0}, ''), lambda c: ord(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


# ---- relational reading path ---------------------------------------------------------------------------------------

def _archive(spark: SparkSession, d: str) -> DataFrame:
    orders, customer, nation = (read(spark, d, t) for t in ("orders", "customer", "nation"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(size_checked(nation, 10_000), F.col("c_nationkey") == F.col("n_nationkey"))


@query("""
with p as (select o_orderkey, c_name, n_name, o_totalprice from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  where c_mktsegment = 'MACHINERY' and year(o_orderdate) = 1997 order by o_orderdate desc, o_orderkey limit 21 offset 20)
select o_orderkey, c_name, n_name, o_totalprice, (select count(*) from p) > 20 as has_next from (select *, row_number() over () k from p) where k <= 20""")
def q14_archive_page(spark, d):
    """Page 2 of a filtered archive, twenty rows and a look ahead."""
    wanted = _archive(spark, d).filter((F.col("c_mktsegment") == "MACHINERY") & (F.year("o_orderdate") == 1997))
    return rel.page(wanted, [F.col("o_orderdate").desc(), F.col("o_orderkey").asc()], 2, 20).select("o_orderkey", "c_name", "n_name", "o_totalprice", "has_next")


@query("""
select 'segment' as facet, c_mktsegment as value, count(*) as rows from orders join customer on o_custkey = c_custkey group by c_mktsegment
union all select 'nation', n_name, count(*) from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name
union all select 'year', cast(year(o_orderdate) as varchar), count(*) from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by year(o_orderdate)""")
def q15_archive_facets(spark, d):
    rows = _archive(spark, d)
    facets = F.array(*[F.struct(F.lit(n).alias("facet"), v.cast("string").alias("value")) for n, v in (("segment", F.col("c_mktsegment")), ("nation", F.col("n_name")), ("year", F.year("o_orderdate")))])
    return rows.select(F.explode(facets).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("rows"))


@query("with " + ART + "select id, analysis_version, epoch_us(analyzed_at) as analyzed_us, intrinsic_score from latest")
def q16_latest_per_group(spark, d):
    return articles(spark, d, "analysis_version").select("id", "analysis_version", micros("analyzed_at").alias("analyzed_us"), "intrinsic_score")


@query("select id, min(epoch_us(analyzed_at)) as first_us, arg_min(analysis_version, (epoch_us(analyzed_at), analysis_version)) as first_version, count(distinct analyzed_at) as analyses from ready_articles where id is not null group by id")
def q17_earliest_per_group(spark, d):
    rows = read(spark, d, "ready_articles").filter("id is not null")
    return rows.groupBy("id").agg(F.min(micros("analyzed_at")).alias("first_us"), F.min_by("analysis_version", F.struct("analyzed_at", "analysis_version")).alias("first_version"), F.count_distinct("analyzed_at").alias("analyses"))


@query("with " + ART + f"select id, pub as published_us from art where pub is not null and pub // 1000000 <= {_EPOCH} // 1000000")
def q18_visible_as_of(spark, d):
    return articles(spark, d).filter(dates.visible(F.col("published_at"), now())).select("id", micros("published_at").alias("published_us"))


_SOURCES = ART + """,
ready as (select source_id, count(*) filter (where coalesce(intrinsic >= 7.5, false)) good, count(*) filter (where not coalesce(intrinsic >= 7.5, false)) poor from art group by 1),
todo as (select source_id, count(distinct article_id) pending from discovered_articles d where not exists (select 1 from latest l where l.id = d.article_id) group by 1),
""" + f"""
counted as (select s.id, coalesce(pending, 0) pending, coalesce(good, 0) ready, coalesce(poor, 0) rejected, s.last_scanned_at, s.history_pages,
  floor(((coalesce(good, 0) + 1) / (coalesce(good, 0) + coalesce(poor, 0) + 2.0) + least(72.0, coalesce(greatest(0.0, ({_EPOCH} + 30 * 86400000000 - epoch_us(last_scanned_at)) / 3600000000.0), 72.0)) / 72 * 0.08) * 1000000 + 0.5) / 1000000 score
  from sources s left join ready r on r.source_id = s.id left join todo t on t.source_id = s.id)"""


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    arts = articles(spark, d)
    good = F.coalesce(F.col("intrinsic") >= 7.5, F.lit(False)).cast("int")
    ready = arts.groupBy("source_id").agg(F.sum(good).alias("ready"), F.sum(1 - good).alias("rejected"))
    todo = read(spark, d, "discovered_articles").join(arts.select(F.col("id").alias("article_id")), "article_id", "left_anti").groupBy("source_id").agg(F.count_distinct("article_id").alias("pending"))
    out = read(spark, d, "sources").join(ready, F.col("id") == ready["source_id"], "left").drop("source_id").join(todo, F.col("id") == todo["source_id"], "left").drop("source_id").fillna(0, ["ready", "rejected", "pending"])
    later = F.timestamp_micros(F.lit(_EPOCH + 30 * 86_400_000_000).cast("long"))
    return out.withColumn("score", r6(planning.source_score(F.col("ready"), F.col("rejected"), F.col("last_scanned_at"), later)))


@query("with " + _SOURCES + "select id, pending, ready, rejected, score from counted")
def q22_source_plan(spark, d):
    return source_counts(spark, d).select("id", "pending", "ready", "rejected", "score")


@query("with " + _SOURCES + """,
a as (select *, case when pending > 0 then row_number() over (partition by pending > 0 order by score desc, id) end best from counted),
b as (select *, coalesce(best <= 5, false) taken from a),
c as (select *, case when not taken then row_number() over (partition by taken order by last_scanned_at nulls first, id) end old from b),
e as (select *, case when taken then 0 when old = 1 then 1 when best is not null then 2 else 3 end stage from c)
select id, cast(row_number() over (order by stage, case when stage = 3 then old else coalesce(best, 0) end, id) as int) as place from e qualify place <= 6""")
def q23_exploit_explore(spark, d):
    return planning.exploit_explore(source_counts(spark, d), 6).select("id", "place")


@query("""
select o_orderpriority, count(*) as orders, cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as filled, cast(sum(case when o_orderstatus = 'O' then 1 else 0 end) as bigint) as open, cast(sum(case when o_orderstatus = 'P' then 1 else 0 end) as bigint) as partial,
  floor(sum(o_totalprice) * 100 + 0.5) / 100 as total from orders group by 1""")
def q24_status_pivot(spark, d):
    state = lambda s: F.sum((F.col("o_orderstatus") == s).cast("int"))
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), state("F").alias("filled"), state("O").alias("open"), state("P").alias("partial"), (F.floor(F.sum("o_totalprice") * 100 + 0.5) / 100).alias("total"))


@query("""
with s as (select coalesce(lang, '') as lang, coalesce(sum(strlen(text)), 0) bytes, count(*) texts from documents group by 1), t as (select max(bytes) * 1.1::double room from s)
select lang, cast(bytes as bigint) as bytes, texts, case when bytes >= 0.85 * room then 'critical' when bytes >= 0.7 * room then 'warning' else 'ok' end as level from s, t""")
def q25_storage_usage(spark, d):
    """Bytes by language, and how full a store would be that has a tenth more room than the largest needs."""
    sums = read(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"), F.count(F.lit(1)).alias("texts"))
    room = F.max("bytes").over(W.partitionBy(F.lit(0))) * 1.1  # a few rows
    return sums.withColumn("level", storage_level(F.col("bytes"), room))


@query("""
select event_type, count(*) as rows, count(distinct user_id) as users, max(case when value > 50 then epoch_us(ts) end) as last_large_us, bool_or(value > 100) as any_huge, floor(avg(value) * 1000000 + 0.5) / 1000000 as mean from events group by 1""")
def q26_event_summary(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("users"), F.max(F.when(F.col("value") > 50, micros("ts"))).alias("last_large_us"), F.bool_or(F.col("value") > 100).alias("any_huge"), r6(F.avg("value")).alias("mean"))


@query("with " + ART + f""",
days as (select cast(make_timestamp(pub + 28800000000) as date) as d, count(*) n, max(pub) last from art where pub is not null and pub < {_EPOCH} and pub >= {_EPOCH} - 30 * 86400000000 group by 1),
spine as (select cast(unnest(generate_series(timestamp '{DAY}' - interval 30 day, timestamp '{DAY}', interval 1 day)) as date) as d)
select cast(s.d as varchar) as day, coalesce(n, 0) as published, coalesce(last, -1) as last_us from spine s left join days using (d)""")
def q27_publication_spine(spark, d):
    """Publications per civil day of the last month, days without any included."""
    age = dates.age_days(F.col("published_at"), now())
    days = articles(spark, d).filter((age > 0) & (age <= 30)).groupBy(dates.civil_date(F.col("published_at")).alias("d")).agg(F.count(F.lit(1)).alias("published"), F.max(micros("published_at")).alias("last_us"))
    spine = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(DAY).cast("date"), 30), F.lit(DAY).cast("date"))).alias("d"))
    return spine.join(days, "d", "left").select(F.col("d").cast("string").alias("day"), F.coalesce("published", F.lit(0)).alias("published"), F.coalesce("last_us", F.lit(-1)).alias("last_us"))


@query("""
with w as (select unnest(generate_series(0, 23)) k), e as (select epoch_us(ts) u, event_type from events),
p as (select (u // 3600000000 - k) * 3600000000 as s, event_type from e, w)
select s as start_us, count(*) as rows, cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as bad, count(*) >= 5 and sum(case when event_type = 'error' then 1 else 0 end) >= 0.22 * count(*) as alarm from p group by s""")
def q28_window_24h_failure(spark, d):
    out = ev.sliding_rates(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", F.col("event_type") == "error", "24 hours", "1 hour", 5, 0.22)
    return out.select(micros("start").alias("start_us"), "rows", "bad", "alarm")


@query("""
with g as (select user_id, epoch_us(ts) f, lead(epoch_us(ts)) over (partition by user_id order by ts) t from events where event_type = 'purchase')
select user_id, f as from_us, t as to_us from g where t - f >= 48 * 3600000000""")
def q29_stall_48h(spark, d):
    """Stretches of two days and more in which a user bought nothing."""
    out = ev.silent_stretches(read(spark, d, "events").filter("event_type = 'purchase'"), "user_id", "ts", 48)
    return out.select("user_id", micros("from").alias("from_us"), micros("to").alias("to_us"))


@query("""
with days as (select distinct user_id, cast(ts as date) as d from events), i as (select *, d + cast(row_number() over (partition by user_id order by d desc) as int) isl from days),
g as (select user_id, isl, max(d) newest, count(*) n from i group by all)
select user_id, cast(arg_max(n, newest) as int) as streak, cast(max(newest) as varchar) as newest from g group by 1""")
def q30_date_streak(spark, d):
    out = ev.newest_streak(read(spark, d, "events").withColumn("day", F.to_date("ts")), "user_id", "day")
    return out.select("user_id", "streak", F.col("newest").cast("string").alias("newest"))


# ---- identity, repeats and snapshots -------------------------------------------------------------------------------

_URL = r"regexp_replace(regexp_replace(trim({0}), '(?i)&amp;|&#0*38;|&#x0*26;', '&', 'g'), '#.*$', '')"
_KEPT = r"list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(lower(p), '^(utm_|(fbclid|gclid|mc_cid|mc_eid)(=|$))')))"
_NORM = rf"case when regexp_matches(u, '(?i)^https?://[^/?#]+') then lower(regexp_extract(u, '(?i)^(https?://[^/?#]+)', 1)) || coalesce(nullif(regexp_extract(u, '(?i)^https?://[^/?#]+([^?#]*)', 1), ''), '/') || case when len({_KEPT}) > 0 then '?' || array_to_string({_KEPT}, '&') else '' end end"


def _spelled(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of pages and articles, each also as a feed with tracking spells it."""
    a = read(spark, d, "ready_articles").select("id", F.col("canonical_url").alias("url"), F.col("intrinsic_score").alias("quality"), F.lit(0).alias("kind"))
    b = read(spark, d, "discovered_articles").select(F.col("article_id").alias("id"), F.concat("canonical_url", F.lit("?utm_source=feed&amp;b=2&#038;a=1&fbclid=x#top")).alias("url"), F.col("extraction_confidence").alias("quality"), F.lit(1).alias("kind"))
    c = read(spark, d, "discovered_articles").select(F.col("article_id").alias("id"), F.concat("canonical_url", F.lit("?a=1&b=2")).alias("url"), F.col("extraction_confidence").alias("quality"), F.lit(2).alias("kind"))
    return a.unionByName(b).unionByName(c)


_SPELLED = """spelled as (select id, canonical_url url, intrinsic_score quality, 0 kind from ready_articles
  union all select article_id, canonical_url || '?utm_source=feed&amp;b=2&#038;a=1&fbclid=x#top', extraction_confidence, 1 from discovered_articles
  union all select article_id, canonical_url || '?a=1&b=2', extraction_confidence, 2 from discovered_articles),
norm as (select *, """ + _NORM + " as n from (select *, " + _URL.format("url") + " u from spelled))"


@query("with " + _SPELLED + """,
g as (select n, id, quality, kind, row_number() over (partition by n order by quality desc nulls last, kind, id) place, first_value(id) over (partition by n order by quality desc nulls last, kind, id) keeper, count(*) over (partition by n) c from norm where n is not null)
select n as url, keeper, c as spellings, cast(sum(case when id <> keeper then 1 else 0 end) as bigint) as losers from g group by n, keeper, c""")
def q31_url_keeper(spark, d):
    """The row to keep of every address, and how many spellings and other ids it has."""
    rows = _spelled(spark, d).withColumn("n", urls.normalized_url(F.col("url"))).filter("n is not null")
    best = F.struct(F.col("quality").isNull(), -F.col("quality"), "kind")
    by_id = rows.groupBy("n", "id").agg(F.count(F.lit(1)).alias("c"), F.min(best).alias("o"))  # combined before each shuffle
    kept = by_id.groupBy("n").agg(F.sum("c").alias("spellings"), F.min(F.struct("o", "id", "c")).alias("k"))
    return kept.select(F.col("n").alias("url"), F.col("k.id").alias("keeper"), "spellings", (F.col("spellings") - F.col("k.c")).alias("losers"))


@query("""
with t as (select distinct article_id, sha256(text) h, content_hash from extracted_articles where text is not null)
select h as text_hash, count(distinct article_id) as articles, min(article_id) as keeper, count(distinct case when content_hash = h then article_id end) as fresh_hashes from t group by h""")
def q32_content_hash_groups(spark, d):
    rows = read(spark, d, "extracted_articles").filter("text is not null").select("article_id", F.sha2("text", 256).alias("text_hash"), "content_hash").distinct()
    return rows.groupBy("text_hash").agg(F.count_distinct("article_id").alias("articles"), F.min("article_id").alias("keeper"), F.count_distinct(F.when(F.col("content_hash") == F.col("text_hash"), F.col("article_id"))).alias("fresh_hashes"))


@query("with " + _SPELLED + "select n as url, min(id || ':' || kind) as first_row from norm where n is not null group by n")
def q33_ordered_url_dedup(spark, d):
    rows = _spelled(spark, d).select(urls.normalized_url(F.col("url")).alias("url"), F.concat("id", F.lit(":"), F.col("kind").cast("string")).alias("first_row"))
    return rel.first_of_each(rows.filter("url is not null"), "url", "first_row")


@query("""
with o as (select article_id, max(title) title, min(published_at) published_at, max(extraction_confidence) confidence from extracted_articles group by 1),
n as (select article_id, max(title) title, min(published_at) published_at, max(extraction_confidence) confidence from discovered_articles group by 1)
select coalesce(n.article_id, o.article_id) as article_id, coalesce(n.title, o.title) as title, coalesce(epoch_us(coalesce(o.published_at, n.published_at)), -1) as published_us, coalesce(n.confidence, o.confidence) as confidence from o full join n on o.article_id = n.article_id""")
def q34_upsert_snapshot(spark, d):
    """Discovered rows merged into extracted ones; a date once known stays."""
    def one(t: str) -> DataFrame:
        return read(spark, d, t).groupBy("article_id").agg(F.max("title").alias("title"), F.min("published_at").alias("published_at"), F.max("extraction_confidence").alias("confidence"))

    out = rel.upserted(one("extracted_articles"), one("discovered_articles"), "article_id", prefer_old=["published_at"])
    return out.select("article_id", "title", F.coalesce(micros("published_at"), F.lit(-1)).alias("published_us"), "confidence")


@query("""
with e as (select user_id, event_id, epoch_us(ts) u, event_type from events),
n as (select *, coalesce(sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by u, event_id rows between unbounded preceding and 1 preceding), 0) ep from e)
select user_id, cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as occurrences, min(case when event_type = 'error' then u end) as opened_us, max(case when event_type = 'error' then u end) as last_us, coalesce(max(case when event_type = 'purchase' then u end), -1) as closed_us
from n group by user_id, ep having sum(case when event_type = 'error' then 1 else 0 end) > 0""")
def q36_episodes(spark, d):
    """Errors of a user up to the next purchase, as episodes."""
    rows = read(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = ev.episodes(rows, "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "purchase")
    return out.select("user_id", "occurrences", micros("opened").alias("opened_us"), micros("last_seen").alias("last_us"), F.coalesce(micros("closed"), F.lit(-1)).alias("closed_us"))


@query(f"""
select doc_id, coalesce(strlen(text), 0) as bytes, cast(epoch_us(published_at) + 90 * 86400000000 as bigint) as expires_us from documents
where published_at is not null and epoch_us(published_at) + 90 * 86400000000 <= {_EPOCH} order by epoch_us(published_at), doc_id limit 100""")
def q38_expiry_queue(spark, d):
    """The hundred texts that expired first."""
    expires = F.col("published_at") + F.expr("interval 90 days")
    rows = read(spark, d, "documents").filter(expires <= now()).orderBy("published_at", "doc_id").limit(100)
    return rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), micros(expires).alias("expires_us"))


# ---- text, pages and payloads --------------------------------------------------------------------------------------

@query(rf"""
with t as (select article_id, arg_max(struct_pack(title := title, text := text, url := canonical_url, words := word_count, links := external_link_count), extracted_at) r from extracted_articles group by 1)
select article_id, case when regexp_matches(lower(r.title), '{GATE_TITLES}') then 'non_standalone_format' when trim(replace(coalesce(r.text, ''), chr(10), ' ')) = '' then 'empty_body' when regexp_matches(r.url, '{GATE_MEDIA_URL}') then 'media_first'
  when r.words < 80 and r.links >= 2 then 'link_roundup' when r.words < 50 and regexp_matches(lower(r.text), '{GATE_MEDIA}') then 'media_first' end as reason from t""")
def q39_content_gate(spark, d):
    """The first reason for which a text doesn't stand alone; null where it does."""
    cols = read(spark, d, "extracted_articles").select("article_id", "extracted_at", "title", "text", "canonical_url", "word_count", "external_link_count")
    rows = rel.latest(cols, "article_id", [F.col("extracted_at")])
    blank = F.trim(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))) == ""
    reason = (
        F.when(F.lower("title").rlike(GATE_TITLES), "non_standalone_format").when(blank, "empty_body").when(F.col("canonical_url").rlike(GATE_MEDIA_URL), "media_first")
        .when((F.col("word_count") < 80) & (F.col("external_link_count") >= 2), "link_roundup").when((F.col("word_count") < 50) & F.lower("text").rlike(GATE_MEDIA), "media_first")
    )
    return rows.select("article_id", reason.alias("reason"))


@query(r"""
select distinct doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*')) as words, greatest(1, cast(ceil(len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*')) / 230.0) as int)) as minutes from documents where text is not null""")
def q40_word_counts(spark, d):
    words = tx.word_count(F.col("text"))
    return read(spark, d, "documents").filter("text is not null").select("doc_id", words.cast("long").alias("words"), reading_minutes(words).alias("minutes")).distinct()


@query()
def q41_strip_html(spark, d):
    """Text, words and links of each page by expressions alone."""
    pages = rel.latest(read(spark, d, "discovered_articles").select("article_id", "discovered_at", "inline_html"), "article_id", [F.col("discovered_at")])
    body = tx.stripped(F.col("inline_html"))
    return pages.select("article_id", body.alias("text"), tx.word_count(body).alias("words"), tx.link_count(F.col("inline_html")).alias("links"))


@query(r"""
with t as (select distinct article_id, inline_html h from discovered_articles)
select article_id, nullif(trim(replace(replace(replace(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1), '&amp;', '&'), '&lt;', '<'), '&#8211;', '–')), '') as page_title, len(regexp_extract_all(h, '(?i)<a\s[^>]*href')) as links from t""")
def q42_page_meta(spark, d):
    pages = read(spark, d, "discovered_articles").select("article_id", "inline_html").distinct()
    return pages.select("article_id", tx.page_title(F.col("inline_html")).alias("page_title"), F.coalesce(tx.link_count(F.col("inline_html")), F.lit(0)).cast("long").alias("links"))


@query()
def q42_page_links(spark, d):
    """Every link of every page with its resolved address."""
    pages = rel.latest(read(spark, d, "discovered_articles").select("article_id", "discovered_at", "canonical_url", "inline_html"), "article_id", [F.col("discovered_at")])
    return feeds.page_links(pages, "inline_html", "canonical_url", "article_id")


_THEME_SQL = "[" + ", ".join(f"case when regexp_matches({{0}}, '{p}') then '{n}' end" for n, p in THEMES) + "]"


@query("with t as (select doc_id, lower(coalesce(title || ' ', '') || coalesce(text, '')) head, lower(coalesce(text, '')) body from documents), "
       + "f as (select doc_id, coalesce(list_filter(" + _THEME_SQL.format("head") + f", lambda x: x is not null)[1], '{OTHER_THEME}') p, " + _THEME_SQL.format("body")
       + " b from t) select doc_id, p as primary_theme, array_to_string(list_filter(b, lambda x: x is not null and x <> p)[1:3], ',') as more from f")
def q43_theme_classifier(spark, d):
    """The first theme whose words stand in title or text, and up to three further ones, of whole texts."""
    t = learning.themes_of(F.col("title"), F.col("text"), THEMES, OTHER_THEME)
    return read(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.col("t.primary").alias("primary_theme"), F.array_join("t.more", ",").alias("more"))


@query(r"""
with recursive t as (select doc_id, text, string_split(text, '') c, length(text) n from documents where text is not null),
e as (select doc_id, text, n, list_filter(range(1, n + 1), lambda i: c[i] = chr(10) or (c[i] = '.' and c[i + 1] = ' ')) ends from t),
b as (
  select doc_id, 0 k, 0::bigint start, least(1400, n) hard, n, ends from e
  union all
  select doc_id, k + 1, greatest(start + 1, stop - 100), least(greatest(start + 1, stop - 100) + 1400, n), n, ends from (
    select *, case when hard < n and coalesce(list_max(list_filter(ends, lambda x: x <= hard + 1)), 0) - 1 > start + 1400 * 0.55::double then list_max(list_filter(ends, lambda x: x <= hard + 1)) else hard end stop from b) where stop < n),
f as (select *, case when hard < n and coalesce(list_max(list_filter(ends, lambda x: x <= hard + 1)), 0) - 1 > start + 1400 * 0.55::double then list_max(list_filter(ends, lambda x: x <= hard + 1)) else hard end stop from b)
select f.doc_id, cast(k as int) as place, substring(e.text, cast(start + 1 as int), cast(stop - start as int)) as chunk from f join e using (doc_id)""")
def q44_chunks(spark, d):
    """Overlapping chunks of every text, with their places."""
    return read(spark, d, "documents").select("doc_id", F.posexplode(tx.chunks(F.col("text"), 1400, 100, 0.55)).alias("place", "chunk"))


@query(r"""
with m as (select distinct on (message_id) message_id, source_id, subject, author, published_at p, text_body, html_body, canonical_url, from_address from email_payloads where message_id is not null order by message_id, received_at desc)
select message_id, trim(coalesce(subject, '')) = '' as no_subject, case when trim(coalesce(source_id, '')) = '' then 'missing_source' when trim(message_id) = '' then 'missing_message_id' when trim(coalesce(subject, '')) = '' then 'missing_subject'
  when trim(coalesce(text_body, '')) = '' and trim(coalesce(html_body, '')) = '' then 'missing_body' end as error,
  coalesce(trim(source_id), '') as source_id, case when trim(coalesce(author, '')) = '' then coalesce(source_id, '') else regexp_replace(replace(trim(author), chr(160), ' '), '[ \t]+', ' ', 'g') end as author, length(coalesce(text_body, '')) as text_chars,
  coalesce(epoch_us(coalesce(try_strptime(trim(p), '%Y-%m-%dT%H:%M:%SZ'), try_strptime(trim(p), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(p), '%Y-%m-%d'), try_strptime(trim(p), '%d/%m/%Y'))), -1) as published_us from m""")
def q45_payload_parse(spark, d):
    mail = rel.latest(read(spark, d, "email_payloads"), "message_id", [F.col("received_at")])
    chars = mail.select(F.col("message_id").alias("_m"), F.coalesce(F.length("text_body"), F.lit(0)).cast("long").alias("text_chars"))
    parsed = feeds.parsed_mail(mail)
    return parsed.join(chars, parsed["message_id"] == chars["_m"]).select("message_id", (F.coalesce("title", F.lit("")) == "").alias("no_subject"), "error", F.coalesce(F.trim("source_id"), F.lit("")).alias("source_id"), F.coalesce("author", F.lit("")).alias("author"), F.col("text_chars"), F.coalesce(micros("published_at"), F.lit(-1)).alias("published_us"))


@query("""select id, array_to_string(case when history_pages <= 5 then range(1, history_pages + 1) else list_prepend(1, range(history_pages - 3, history_pages + 1)) end, ',') as pages, cast(least(history_pages + 2, 100) as int) as next_pages from sources""")
def q47_page_window(spark, d):
    return read(spark, d, "sources").select("id", F.array_join(planning.page_window(F.col("history_pages")).cast("array<string>"), ",").alias("pages"), planning.next_depth(F.col("history_pages"), F.lit(0)).alias("next_pages"))


@query("""
with a as (select distinct article_id, source_id, min(discovered_at) over (partition by article_id) f, bool_or(coalesce(extraction_confidence >= 0.8, false)) over (partition by article_id) ok from discovered_articles),
b as (select *, sum(case when ok then 1 else 0 end) over (partition by source_id order by f, article_id rows between unbounded preceding and current row) used from a)
select article_id, source_id, ok as usable from b where used < 5 or (used = 5 and ok)""")
def q48_work_limit(spark, d):
    """Of each source the rows up to the fifth usable one, skipped ones counted along."""
    rows = read(spark, d, "discovered_articles").groupBy("article_id", "source_id").agg(F.min("discovered_at").alias("f"), F.bool_or(F.coalesce(F.col("extraction_confidence") >= 0.8, F.lit(False))).alias("usable"))
    return rel.running_limit(rows, "source_id", [F.col("f").asc(), F.col("article_id").asc()], F.to_date("f"), F.col("usable"), 5).select("article_id", "source_id", "usable")


@query("""
select * from (select 'customers' as list, cast(c_custkey as varchar) as key, c_name as label from customer order by c_acctbal desc, c_custkey limit 20)
union all select * from (select 'orders', cast(o_orderkey as varchar), c_name from orders join customer on o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 20)
union all select * from (select 'suppliers', cast(s_suppkey as varchar), s_name from supplier order by s_name, s_suppkey limit 10)""")
def q49_dashboard(spark, d):
    """Top lists of several tables in one."""
    customer, orders, supplier = (read(spark, d, t) for t in ("customer", "orders", "supplier"))
    top = lambda df, order, n, name, key, label: df.orderBy(*order).limit(n).select(F.lit(name).alias("list"), F.col(key).cast("string").alias("key"), F.col(label).alias("label"))
    big = orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return (
        top(customer, [F.col("c_acctbal").desc(), "c_custkey"], 20, "customers", "c_custkey", "c_name")
        .unionByName(big.select(F.lit("orders").alias("list"), F.col("o_orderkey").cast("string").alias("key"), F.col("c_name").alias("label")))
        .unionByName(top(supplier, ["s_name", "s_suppkey"], 10, "suppliers", "s_suppkey", "s_name"))
    )


@query("with " + HIST + """
select 'read' as kind, cast(d as varchar) as day, id, theme from hist
union all select 'mailed', cast(cast(make_timestamp(min(epoch_us(received_at)) + 28800000000) as date) as varchar), message_id, '' from email_payloads where message_id is not null group by message_id""")
def q50_history_union(spark, d):
    """What was read and what came by mail, as one history."""
    read_ = history(articles(spark, d)).select(F.lit("read").alias("kind"), F.col("day").cast("string").alias("day"), "id", "theme")
    mail = read(spark, d, "email_payloads").filter("message_id is not null").groupBy(F.col("message_id").alias("id")).agg(dates.civil_date(F.min("received_at")).cast("string").alias("day"))
    return read_.unionByName(mail.select(F.lit("mailed").alias("kind"), "day", "id", F.lit("").alias("theme")))


# ---- extensions ----------------------------------------------------------------------------------------------------

@query("select c_mktsegment as segment, o_orderstatus as status, count(*) as orders from orders join customer on o_custkey = c_custkey group by rollup (c_mktsegment, o_orderstatus)")
def x01_rollup(spark, d):
    joined = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.rollup(F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("orders"))


@query()
def x02_approximate_distinct(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey").alias("orders"), F.percentile_approx("l_quantity", 0.5).alias("median_quantity"))


@query("""
with e as (select user_id, epoch_us(ts) u, lag(epoch_us(ts)) over (partition by user_id order by ts) p from events), s as (select user_id, u, sum(case when p is null or u - p >= 7200000000 then 1 else 0 end) over (partition by user_id order by u) k from e)
select user_id, min(u) as start_us, max(u) + 7200000000 as end_us, count(*) as rows from s group by user_id, k""")
def x03_sessions(spark, d):
    rows = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy("user_id", F.session_window("ts", "2 hours").alias("s")).agg(F.count(F.lit(1)).alias("rows"))
    return out.select("user_id", micros("s.start").alias("start_us"), micros("s.end").alias("end_us"), "rows")


@query("""
with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings), s as (select a.vec_id q, b.vec_id n, list_cosine_similarity(a.e, b.e) c from v a, v b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id)
select q as vec_id, n as neighbour_id, floor(c * 1000000 + 0.5) / 1000000 as cosine from (select *, row_number() over (partition by q order by floor(c * 1000000 + 0.5) desc, n) k from s) where k <= 5""")
def x04_exact_neighbours(spark, d):
    """The five nearest vectors of a stated query set, against all rows in blocks."""
    import numpy as np
    import pandas as pd

    rows = read(spark, d, "embeddings")
    wanted = rows.filter("vec_id % 100 = 0").select("vec_id", "embedding")
    blocks = -(-wanted.count() // QUERIES_AT_ONCE)

    def near(number: int) -> DataFrame:
        asked = wanted.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).orderBy("vec_id").collect()  # about QUERIES_AT_ONCE rows
        ids = np.array([r["vec_id"] for r in asked])
        q = np.array([r["embedding"] for r in asked], dtype=np.float64).reshape(len(asked), -1)
        shared = spark.sparkContext.broadcast((ids, q / np.linalg.norm(q, axis=1, keepdims=True)))
        return rows.select("vec_id", "embedding").mapInPandas(lambda frames: block(frames, shared), "vec_id long, neighbour_id long, cosine double").filter("cosine > -2")

    def block(frames, shared):
        queries, units = shared.value
        if not len(queries):
            return
        for f in frames:
            x = np.array(f["embedding"].tolist(), dtype=np.float64)
            c = np.floor(units @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T * 1e6 + 0.5) / 1e6
            c[queries[:, None] == f["vec_id"].to_numpy()[None, :]] = -2
            k = min(5, c.shape[1])
            best = np.lexsort((np.broadcast_to(f["vec_id"].to_numpy(), c.shape), -c), axis=1)[:, :k]
            yield pd.DataFrame({"vec_id": np.repeat(queries, k), "neighbour_id": f["vec_id"].to_numpy()[best.ravel()], "cosine": np.take_along_axis(c, best, 1).ravel()})

    found = near(0)
    for number in range(1, blocks):
        found = found.unionByName(near(number))
    w = W.partitionBy("vec_id").orderBy(F.col("cosine").desc(), "neighbour_id")
    return found.withColumn("k", F.row_number().over(w)).filter("k <= 5").drop("k")
