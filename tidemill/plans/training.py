"""Learning from feedback, and the daily slate with all parts of its score.

Feedback is a view of the analyses: some articles were recommended, others shown in a simulation, and each load of such
an article stands for one reaction. Weights are fitted on the driver from sums of the size of the features squared.
"""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import vectors
from ..operators import feedback as fb, learning, ranking, relations as rel
from ..tables import read
from .catalogue import _EPOCH, _FNV, ART, DAY, HIST, SCORES, articles, gated, history, micros, now, query, r6, usable_vectors

KINDS = ["valuable", "good", "not_for_me", "unfinished", "later"]
WIDTH, CANDIDATES, RECENT = 84, 250, 7
CUTS = ("2025-03-01 00:00:00", "2025-08-01 00:00:00", "2025-08-01 06:00:00")

FEEDBACK = """
acts as (select id article_id, loaded_at created_at, ['valuable', 'good', 'not_for_me', 'unfinished', 'later'][1 + (ord(right(id, 1)) + cast(extract(second from loaded_at) as int)) % 5] kind
  from ready_articles where id is not null and loaded_at is not null),
said as (select *, 'public' origin from acts where substr(article_id, 1, 1) < '4' union all select *, 'simulation' from acts where substr(article_id, 1, 1) >= 'a' and substr(article_id, 2, 1) < '8')
"""
LATEST = FEEDBACK + """,
reacted as (select article_id, created_at, kind from (select *, row_number() over (partition by article_id order by created_at desc, kind desc) rn from said) where rn = 1)
"""
FEATURES = f"""
usable as (select article_id, arg_max(list_transform(vec_values, lambda x: x::double), created_at) v from article_embeddings where embedding_version = 'emb-v2' and len(vec_values) = 384
  and len(list_filter(vec_values, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vec_values, lambda x: x <> 0)) > 0 group by article_id),
mixes as (select i, xor(y, y >> 16) h from (select i, (xor(x, x >> 16) * 73244475) & 4294967295 y from (select i, (xor(i, i >> 16) * 73244475) & 4294967295 x from range(0, 17171 + 384) t(i)))),
cells as (select a.i, a.h % 64 bucket, case when b.h % 2 = 0 then 1 else -1 end sign from mixes a join mixes b on b.i = a.i + 17171 where a.i < 384),
sums as (select article_id, bucket, sum(x * sign) s from (select article_id, unnest(v) x, unnest(range(384)) i from usable) join cells using (i) group by all),
proj as (select article_id, bucket, s / n p from sums join (select article_id, sqrt(sum(s * s)) n from sums group by 1) using (article_id)),
heads as (select id, [1.0, intrinsic / 10, long_term_value / 10, idea_density / 10, argument_quality / 10, originality / 10, clarity_structure / 10, least(1.5, ln(1 + word_count::double) / 10)] x,
  {_FNV.format("lower(who)")} ah, {_FNV.format("lower(theme)")} th from art
  where intrinsic is not null and long_term_value is not null and idea_density is not null and argument_quality is not null and originality is not null and clarity_structure is not null and word_count is not null
    and id in (select article_id from usable)),
feats as (select id, i, v from (select id, unnest(x) v, unnest(range(8)) i from heads)
  union all select article_id, bucket + 8, p from proj where article_id in (select id from heads)
  union all select id, 72 + ah % 6, case when ah < 2147483648 then 1.0 else -1.0 end from heads
  union all select id, 78 + th % 6, case when th < 2147483648 then 1.0 else -1.0 end from heads)
"""
TRAINING = LATEST + "," + FEATURES + """,
labels as (select h.id, r.kind, r.created_at, case r.kind when 'valuable' then 1.0 when 'good' then 0.35 when 'not_for_me' then -1.0 else -0.45 end y from heads h join reacted r on r.article_id = h.id where r.kind <> 'later')
"""
RIDGE = TRAINING + """,
gram as (select a.i, b.i j, sum(a.v * b.v) g from feats a join feats b using (id) join labels using (id) group by all),
side as (select f.i, sum(f.v * l.y) g from feats f join labels l using (id) group by 1),
rows_ as (select s.i, list_append(list(coalesce(g.g, 0.0) + case when s.i = t.j and s.i > 0 then 2.5 else 0.0 end order by t.j), coalesce(any_value(d.g), 0.0)) r
  from range(84) s(i) cross join range(84) t(j) left join gram g on g.i = s.i and g.j = t.j left join side d on d.i = s.i group by s.i),
gj as (select 0 k, list(r order by i) m from rows_
  union all
  select k + 1, list_transform(m, lambda r, i: case when i = k + 1 then list_transform(p, lambda x: x / p[k + 1]) else list_transform(r, lambda x, j: x - r[k + 1] / p[k + 1] * p[j]) end)
  from (select k, m, m[k + 1] p from gj where k < 84)),
weights as (select unnest(range(84)) i, unnest(list_transform(m, lambda r: r[85])) w from gj where k = 84),
strength as (select count(*) n, case when count(*) >= 200 then 0.3 when count(*) >= 100 then 0.2 when count(*) >= 60 then 0.15 when count(*) >= 30 then 0.1 when count(*) >= 10 then 0.05 else 0.0 end f from labels),
fits as (select id, tanh(sum(v * w)) * any_value(f) * 3 fit from feats join weights using (i), strength group by id)
"""
SLATE = HIST + "," + RIDGE + f""",
af as (select who, case when max(case when age < 2 then 1 else 0 end) = 1 then 100.0 else floor(sum(case when age <= 3 then 1.25 when age <= 7 then 0.65 when age <= 14 then 0.2 else 0 end) * 1000 + 0.5) / 1000 end ap from hist group by who),
tf as (select theme, floor(sum(case when age <= 7 then 1 else 0 end) * 0.35 * 1000 + 0.5) / 1000 tp, case when count(*) = 1 then 0.2 else 0.0 end ex from hist group by theme),
cand as (select id, who author, theme, pub, intrinsic, greatest(0.0, age_now) age from (select *, ({_EPOCH} - pub) / 86400000000.0 age_now from art)
  where intrinsic >= 7.5 and long_term_value >= 7 and idea_density >= 7 and least(long_term_value, idea_density, argument_quality, originality, clarity_structure) >= 5 order by intrinsic desc, id limit {CANDIDATES}),
lists as (select article_id id, list(p order by bucket) p from proj group by 1),
recent as (select p from (select id from hist order by d desc limit {RECENT}) join lists using (id)),
seen as (select c.id, count(r.p) n, max(list_cosine_similarity(l.p, r.p)) s, count(l.p) v from cand c left join lists l using (id) left join recent r on true group by c.id),
signals as (select id, case when v = 0 or n = 0 then 0.0 when s between 0.25 and 0.82 then least(0.35, (s - 0.25) * 0.65) else 0.0 end connection,
  case when v = 0 then 0.0 when n = 0 then 0.2 when s < 0.2 then 0.3 when s < 0.35 then 0.15 else 0.0 end sem from seen),
parts as (select c.*, case when pub is null then 0.0 when age <= 3 then 0.8 when age <= 7 then 0.64 when age <= 14 then 0.4 when age <= 30 then 0.16 else 0.0 end fresh,
  coalesce(ap, 0.0) author_penalty, coalesce(tp, 0.0) theme_penalty, least(0.75, coalesce(ex, 0.45) + sem) exploration, connection, greatest(-0.9, least(0.9, coalesce(fit, 0.0))) personal
  from cand c left join af on af.who = c.author left join tf on tf.theme = c.theme join signals using (id) left join fits using (id)),
ranked as (select *, floor((intrinsic + fresh + exploration + personal + connection - author_penalty - theme_penalty) * 1000 + 0.5) / 1000 dynamic from parts)
"""


def reactions(spark: SparkSession, d: str) -> DataFrame:
    """article_id, created_at, kind, origin of all feedback, public and simulated."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.ascii(F.right("id", F.lit(1))) + F.second("loaded_at")) % 5 + 1)
    acts = read(spark, d, "ready_articles").filter("id is not null and loaded_at is not null").select(F.col("id").alias("article_id"), F.col("loaded_at").alias("created_at"), kind.alias("kind"))
    first, second = F.substring("article_id", 1, 1), F.substring("article_id", 2, 1)
    recommended = acts.filter(first < "4").select(F.concat(F.lit("r-"), "article_id").alias("recommendation_id"), "article_id").distinct()
    simulated = acts.filter((first >= "a") & (second < "8")).select(F.concat(F.lit("s-"), "article_id").alias("recommendation_id"), "article_id").distinct()
    given = lambda mark: acts.select(F.concat(F.lit(mark), "article_id").alias("recommendation_id"), "created_at", "kind")
    return fb.all_feedback([(given("r-"), recommended, "public"), (given("s-"), simulated, "simulation")])


def projections(spark: SparkSession, d: str, some: DataFrame | None = None) -> DataFrame:
    """id and projection of every usable vector, or of some ids; only those are projected."""
    vecs = usable_vectors(spark, d)
    return (vecs if some is None else vecs.join(some, "id", "left_semi")).select("id", vectors.projected(F.col("vec"), 384).alias("projection"))


def featured(spark: SparkSession, d: str, some: DataFrame | None = None) -> DataFrame:
    """The articles (or some ids of them) that have all scores and a vector, with their features `x`."""
    arts = articles(spark, d).filter(F.forall(F.array(*SCORES), lambda x: x.isNotNull()) & F.col("word_count").isNotNull())
    return arts.join(projections(spark, d, some), "id").withColumn("x", learning.article_features(F.col("projection"), SCORES))


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    labels = fb.labelled(fb.latest_feedback(reactions(spark, d))).withColumnRenamed("article_id", "id")
    return featured(spark, d, labels.select("id")).join(labels, "id")


def model(spark: SparkSession, d: str) -> tuple[np.ndarray, int]:
    xx, xy, n = learning.gram(training_rows(spark, d), "x", "label", WIDTH)
    return learning.ridge(xx, xy), n


def few(df: DataFrame) -> DataFrame:
    """Rows whose number is bounded by a limit, made once for the several joins that need them."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def slate_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The best of the gated pool with all parts of their score."""
    with ThreadPoolExecutor(1) as beside:  # the fit needs nothing of the pool
        fitted = beside.submit(model, spark, d)
        known, past, signals = _pool_with_signals(spark, d)
        weights, n = fitted.result()
    complete = F.forall(F.array(*SCORES), lambda x: x.isNotNull()) & F.col("word_count").isNotNull() & F.col("vec").isNotNull()
    fit = learning.personal_fit(learning.article_features(F.col("vec"), SCORES), weights, learning.influence(n))
    full = known.withColumn("personal_fit", F.when(complete, fit).otherwise(0.0)).drop("vec").join(F.broadcast(signals.drop("similarity")), "id")
    return ranking.ranked(full, past, now())


def _pool_with_signals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    arts = articles(spark, d)
    past = few(history(arts))  # a row a day of sixty
    pool = few(gated(arts).orderBy(F.col("intrinsic").desc(), "id").limit(CANDIDATES).drop("secondary_themes"))
    last = past.orderBy(F.col("day").desc()).limit(RECENT).select("id")
    vecs = few(projections(spark, d, F.broadcast(pool.select("id").union(last))))  # no more than CANDIDATES + RECENT rows
    recent = last.join(vecs, "id").collect()
    known = pool.join(vecs, "id", "left").withColumnRenamed("projection", "vec")
    signals = ranking.semantic_signals(known.select("id", "vec"), [list(r["projection"]) for r in recent], vectors.cosine)
    return known, past, signals


@query("with " + ART + "," + FEATURES + """, spine as (select id, unnest(range(84)) i from heads)
select s.id, cast(s.i as int) as place, floor(coalesce(f.v, 0.0) * 1000000 + 0.5) / 1000000 as value from spine s left join feats f on f.id = s.id and f.i = s.i""")
def q11_article_features(spark, d):
    """All 84 features of every article that has its scores and a vector."""
    return featured(spark, d).select("id", F.posexplode("x").alias("place", "v")).select("id", "place", r6(F.col("v")).alias("value"))


@query("with " + ART + "," + TRAINING + "select id, kind, y as label, epoch_us(created_at) as created_us from labels")
def q12_preference_training_rows(spark, d):
    """The latest reaction of each article, public or simulated, joined with its analysis and vector."""
    return training_rows(spark, d).select("id", "kind", "label", micros("created_at").alias("created_us"))


@query("with recursive " + ART + "," + RIDGE + "select cast(i as int) as place, floor(w * 1000000 + 0.5) / 1000000 as weight from weights")
def q12_ridge_weights(spark, d):
    weights, _ = model(spark, d)
    return spark.createDataFrame([(i, float(np.floor(w * 1e6 + 0.5) / 1e6)) for i, w in enumerate(weights)], "place int, weight double")


@query("with recursive " + ART + "," + RIDGE + "select id, floor(fit * 1000000 + 0.5) / 1000000 as personal_fit from fits")
def q13_personal_fit(spark, d):
    weights, n = model(spark, d)
    return featured(spark, d).select("id", r6(learning.personal_fit(F.col("x"), weights, learning.influence(n))).alias("personal_fit"))


@query("with recursive " + ART + "," + RIDGE + """,
preds as (select id, sum(v * w) p from feats join weights using (i) group by id)
select n as samples, f as influence, floor(mse * 1000000 + 0.5) / 1000000 as mse, epoch_us(through) as trained_through_us from strength, (select avg((p - y) * (p - y)) mse, max(created_at) through from preds join labels using (id))""")
def q13_model_metrics(spark, d):
    """Samples, influence, error and last sample of the fitted model."""
    rows = training_rows(spark, d)
    weights, n = model(spark, d)
    error = learning.raw_fit(F.col("x"), weights) - F.col("label")
    out = rows.agg(F.count(F.lit(1)).alias("samples"), r6(F.avg(error * error)).alias("mse"), micros(F.max("created_at")).alias("trained_through_us"))
    return out.withColumn("influence", F.lit(learning.influence(n)))


_CUTS_SQL = ", ".join(f"({i}, timestamptz '{c}+00')" for i, c in enumerate(CUTS))


@query("with " + ART + "," + FEEDBACK + "," + FEATURES + f""",
runs as (select * from (values {_CUTS_SQL}) t(run, as_of)),
upto as (select run, as_of, article_id, kind, created_at, row_number() over (partition by run, article_id order by created_at desc, kind desc) rn from runs join said on created_at <= as_of),
counted as (select run, as_of, count(*) samples, max(created_at) through from upto join heads on heads.id = article_id where rn = 1 and kind <> 'later' group by 1, 2),
trained as (select *, samples < 10 as too_few, coalesce(samples = lag(samples) over (order by run) and through = lag(through) over (order by run), false) as reused from counted)
select run, samples, epoch_us(through) as trained_through_us, not too_few and not reused as trained, reused, not too_few and not reused and run = max(case when not too_few and not reused then run end) over () as active from trained""")
def q13_model_registry(spark, d):
    """Runs at several instants: a model is fitted anew if its samples changed, and only the newest is active."""
    runs = spark.createDataFrame([(i, dt.datetime.fromisoformat(c + "+00:00")) for i, c in enumerate(CUTS)], "run int, as_of timestamp")
    upto = reactions(spark, d).join(F.broadcast(runs), F.col("created_at") <= F.col("as_of"))  # a handful of runs
    labels = fb.labelled(fb.latest_feedback(upto, "run"))
    rows = labels.join(featured(spark, d, labels.select(F.col("article_id").alias("id"))).select(F.col("id").alias("article_id")), "article_id")
    counted = rows.groupBy("run").agg(F.count(F.lit(1)).alias("samples"), F.max("created_at").alias("through"))
    return fb.registry(counted).withColumn("through", micros("through")).withColumnRenamed("through", "trained_through_us")


_PART = "id, author, theme, intrinsic, fresh, author_penalty, theme_penalty, floor(exploration * 1000000 + 0.5) / 1000000 as exploration, floor(connection * 1000000 + 0.5) / 1000000 as connection, floor(personal * 1000000 + 0.5) / 1000000 as personal_fit, dynamic"


@query("with recursive " + SLATE + f"select {_PART} from ranked")
def q05_rank_candidates(spark, d):
    """The 250 best of the pool with every part of their score."""
    parts = [r6(F.col(c)).alias(c) for c in ("exploration", "connection", "personal_fit")]
    return slate_candidates(spark, d).select("id", "author", "theme", "intrinsic", "fresh", "author_penalty", "theme_penalty", *parts, "dynamic")


_TAKES = "len(g.ids) < 10 and len(list_filter(g.authors, lambda x: x = r.author)) < 2 and len(list_filter(g.themes, lambda x: x = r.theme)) < 3"


@query("with recursive " + SLATE + f""",
numbered as (select *, row_number() over (order by dynamic desc, intrinsic desc, id) rn from ranked where author_penalty < 100),
g as (
  select 0::bigint i, []::varchar[] ids, []::varchar[] authors, []::varchar[] themes
  union all
  select g.i + 1, case when {_TAKES} then list_append(g.ids, r.id) else g.ids end, case when {_TAKES} then list_append(g.authors, r.author) else g.authors end, case when {_TAKES} then list_append(g.themes, r.theme) else g.themes end
  from g join numbered r on r.rn = g.i + 1 where len(g.ids) < 10),
fin as (select ids from g order by i desc limit 1),
jit as (select n.*, floor(({_FNV.format("'" + DAY + ":' || id")} / 4294967295.0 * 2 * 0.3 - 0.3) * 1000 + 0.5) / 1000 jitter from numbered n)
select cast(list_position(ids, n.id) as int) as place, n.id, n.author, n.theme, n.dynamic, n.intrinsic, floor((n.dynamic + n.jitter) * 1000 + 0.5) / 1000 as shown from fin join jit n on list_contains(ids, n.id)""")
def q07_diverse_slate(spark, d):
    """Gate, rank by all parts, cool down, choose greedily under the caps; the jitter shows but doesn't reorder."""
    slate = ranking.diverse_top(slate_candidates(spark, d).filter("author_penalty < 100"))
    return ranking.with_jitter(slate, DAY).drop("jitter")
