"""Queries over state: the ready pool, transitions, runs, incidents, health and cleaning.

States are views of the analyses and events, made from ids and times by the same rule in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import dates
from ..operators import events as ev, feedback as fb, relations as rel, snapshots as snap
from ..tables import read
from .catalogue import _EPOCH, ART, AS_OF, DAY, HIST, articles, gated, history, micros, now, query, r6
from .training import FEEDBACK, reactions

_NOW = f"make_timestamp({_EPOCH})"


# ---- the pool ------------------------------------------------------------------------------------------------------

def hexed(c: str, place: int) -> Column:
    """A hexadecimal digit of an id as a number."""
    return F.conv(F.substring(c, place, 1), 16, 10).cast("int")


_HEX = "cast('0x' || substr({0}, {1}, 1) as int)"


@query("with " + HIST + "," + FEEDBACK + f""",
cand as (select id, intrinsic, extraction_confidence from art where intrinsic >= 7.5 and long_term_value >= 7 and idea_density >= 7 and least(long_term_value, idea_density, argument_quality, originality, clarity_structure) >= 5),
last_sim as (select article_id, created_at, kind from (select *, row_number() over (partition by article_id order by created_at desc, kind desc) rn from said where origin = 'simulation') where rn = 1),
pool as (select c.id, c.intrinsic from cand c
  where (not exists (select 1 from hist h where h.id = c.id) or ({_HEX.format("c.id", 2)} between 1 and 2 and exists (select 1 from hist h where h.id = c.id and h.age >= 14)))
    and (not exists (select 1 from last_sim s where s.article_id = c.id) or exists (select 1 from last_sim s where s.article_id = c.id and s.kind = 'later' and epoch_us(s.created_at) + 14 * 86400000000 <= {_EPOCH}))
    and coalesce(c.extraction_confidence, 0.0) >= 0.7)
select p.id, p.intrinsic, v.article_id is not null as has_vector from pool p left join (select distinct article_id from article_embeddings where embedding_version = 'emb-v2' and vec_values is not null) v on v.article_id = p.id
order by p.intrinsic desc, p.id limit 250""")
def q19_ready_pool(spark, d):
    """What may be recommended: never published or due again, not simulated unless put off and due, well extracted.

    Screens come before the limit, so a screened row costs no place.
    """
    arts = articles(spark, d, "extraction_confidence")
    past = history(arts).select("id", dates.age_days(dates.day_start(F.col("day")), now()).alias("age"))
    last = fb.latest_feedback(reactions(spark, d).filter("origin = 'simulation'"))
    due = (F.col("kind") == "later") & (F.unix_micros("created_at") + 14 * 86_400_000_000 <= _EPOCH)
    pool = gated(arts).join(past, "id", "left").filter(F.col("age").isNull() | (hexed("id", 2).between(1, 2) & (F.col("age") >= 14)))
    pool = pool.join(last.filter(~due).select(F.col("article_id").alias("id")), "id", "left_anti").filter(F.coalesce("extraction_confidence", F.lit(0.0)) >= 0.7)
    have = read(spark, d, "article_embeddings").filter("embedding_version = 'emb-v2' and vec_values is not null").select(F.col("article_id").alias("id")).distinct().withColumn("has_vector", F.lit(True))
    top = pool.select("id", "intrinsic").orderBy(F.col("intrinsic").desc(), "id").limit(250)
    return top.join(have, "id", "left").select("id", "intrinsic", F.coalesce("has_vector", F.lit(False)).alias("has_vector"))


@query("with " + ART + """select a.id, a.intrinsic from art a where not exists (select 1 from article_embeddings e where e.article_id = a.id and e.embedding_version = 'emb-v2' and e.vec_values is not null)
order by a.intrinsic desc nulls last, a.id limit 100""")
def q20_missing_embeddings(spark, d):
    """The hundred best articles that still lack a vector."""
    have = read(spark, d, "article_embeddings").filter("embedding_version = 'emb-v2' and vec_values is not null").select(F.col("article_id").alias("id")).distinct()
    return articles(spark, d).join(have, "id", "left_anti").select("id", "intrinsic").orderBy(F.col("intrinsic").desc_nulls_last(), "id").limit(100)


@query("with " + ART + """,
todo as (select a.id, a.analyzed_at, a.source_id from art a where coalesce(a.extraction_confidence, 0.0) < 0.8 and not exists (select 1 from extracted_articles x where x.article_id = a.id))
select t.id, epoch_us(t.analyzed_at) as updated_us, s.name as source_name, (select count(*) from todo) as waiting from todo t left join sources s on s.id = t.source_id order by t.analyzed_at desc nulls last, t.id limit 100""")
def q21_review_queue(spark, d):
    """Poorly extracted articles without a body: the hundred newest with their source, and how many there are."""
    bodies = read(spark, d, "extracted_articles").select(F.col("article_id").alias("id")).distinct()
    todo = articles(spark, d, "extraction_confidence").filter(F.coalesce("extraction_confidence", F.lit(0.0)) < 0.8).join(bodies, "id", "left_anti").select("id", "analyzed_at", "source_id")
    names = read(spark, d, "sources").select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    top = todo.orderBy(F.col("analyzed_at").desc_nulls_last(), "id").limit(100).join(names, "source_id", "left")
    return top.crossJoin(todo.agg(F.count(F.lit(1)).alias("waiting"))).select("id", micros("analyzed_at").alias("updated_us"), "source_name", "waiting")  # one row


@query("with " + HIST + "," + FEEDBACK + """,
latest_kind as (select article_id, kind from (select *, row_number() over (partition by article_id order by created_at desc, kind desc) rn from said where origin = 'public') where rn = 1)
select cast(h.d as varchar) as day, h.id, a.title, coalesce(k.kind, '') as latest_kind from hist h left join art a on a.id = h.id left join latest_kind k on k.article_id = h.id order by h.d desc limit 20""")
def q51_newest_runs(spark, d):
    """The twenty newest days with the title of their winner and the latest reaction to it."""
    arts = articles(spark, d, "title")
    kinds = fb.latest_feedback(reactions(spark, d).filter("origin = 'public'")).select(F.col("article_id").alias("id"), F.col("kind").alias("latest_kind"))
    newest = history(arts).orderBy(F.col("day").desc()).limit(20)
    return newest.join(arts.select("id", "title"), "id", "left").join(kinds, "id", "left").select(F.col("day").cast("string").alias("day"), "id", "title", F.coalesce("latest_kind", F.lit("")).alias("latest_kind"))


@query("""
with best as (select article_id, max(extraction_confidence) q from extracted_articles group by 1),
d as (select article_id, min(discovered_at) f from discovered_articles where article_id in (select article_id from extracted_articles) group by 1)
select article_id, coalesce(q, -1.0) as best_quality, epoch_us(f) as first_us from d left join best using (article_id)""")
def q52_best_quality(spark, d):
    """Of pages whose article has a body, the best quality any of its bodies has; a semi-join and a maximum."""
    bodies = read(spark, d, "extracted_articles")
    best = bodies.groupBy("article_id").agg(F.max("extraction_confidence").alias("q"))
    pages = read(spark, d, "discovered_articles").join(bodies.select("article_id").distinct(), "article_id", "left_semi").groupBy("article_id").agg(F.min("discovered_at").alias("f"))
    return pages.join(best, "article_id", "left").select("article_id", F.coalesce("q", F.lit(-1.0)).alias("best_quality"), micros("f").alias("first_us"))


# ---- transitions ---------------------------------------------------------------------------------------------------

_STATES = ["discovered", "analysis_failed", "rejected", "recommended", "blocked"]
_STATE_SQL = f"""
state as (select id, ['discovered', 'analysis_failed', 'rejected', 'recommended', 'blocked'][1 + {_HEX.format("id", 1)} % 5] status, {_HEX.format("id", 3)} % 5 retry_count,
  case when {_HEX.format("id", 1)} % 5 = 2 then case when {_HEX.format("id", 4)} < 8 then 'empty_body' else 'below_gate' end end rejection_reason, epoch_us(analyzed_at) updated_us from art)"""


def states(spark: SparkSession, d: str) -> DataFrame:
    arts = articles(spark, d)
    status = F.element_at(F.array(*map(F.lit, _STATES)), hexed("id", 1) % 5 + 1)
    reason = F.when(status == "rejected", F.when(hexed("id", 4) < 8, "empty_body").otherwise("below_gate"))
    return arts.select("id", status.alias("status"), (hexed("id", 3) % 5).alias("retry_count"), reason.alias("rejection_reason"), F.col("analyzed_at").alias("updated_at"))


@query("with " + ART + "," + _STATE_SQL + f""",
seen as (select article_id id, case when text is null or trim(replace(text, chr(10), ' ')) = '' then 'rejected' when extraction_confidence < 0.8 then 'failed' when external_link_count > 8 then 'unavailable' else 'ready' end outcome,
  case when text is null or trim(replace(text, chr(10), ' ')) = '' then 'empty_body' when extraction_confidence < 0.8 then '' when external_link_count > 8 then 'gone' end reason, extracted_at from extracted_articles),
one as (select id, outcome, reason from (select *, row_number() over (partition by id order by extracted_at desc, outcome desc) rn from seen) where rn = 1),
j as (select s.*, o.outcome, o.reason, o.outcome is not null and s.status not in ('recommended', 'blocked', 'unavailable') free from state s left join one o using (id))
select id, case when free then case outcome when 'failed' then 'analysis_failed' else outcome end else status end as status, cast(retry_count + case when free and outcome = 'failed' then 1 else 0 end as int) as retry_count,
  case when free and outcome <> 'ready' then substring(coalesce(nullif(reason, ''), 'unknown_error'), 1, 500) when free then null else rejection_reason end as rejection_reason,
  case when free then {_EPOCH} else updated_us end as updated_us,
  coalesce(status = 'discovered' or (status = 'analysis_failed' and retry_count < 3) or (status = 'rejected' and rejection_reason = 'empty_body'), false) as was_processable from j""")
def q53_status_transitions(spark, d):
    """Articles after the outcomes of their extraction, settled ones untouched."""
    blank = F.trim(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))) == ""
    outcome = F.when(blank, "rejected").when(F.col("extraction_confidence") < 0.8, "failed").when(F.col("external_link_count") > 8, "unavailable").otherwise("ready")
    reason = F.when(blank, "empty_body").when(F.col("extraction_confidence") < 0.8, "").when(F.col("external_link_count") > 8, "gone")
    seen = read(spark, d, "extracted_articles").select(F.col("article_id").alias("id"), outcome.alias("outcome"), reason.alias("reason"), "extracted_at")
    one = seen.groupBy("id").agg(F.max(F.struct("extracted_at", "outcome", "reason")).alias("m")).select("id", "m.outcome", "m.reason")
    before = states(spark, d)
    was = before.select("id", F.coalesce(snap.processable(F.col("status"), F.col("retry_count"), F.col("rejection_reason")), F.lit(False)).alias("was_processable"))
    out = snap.transition(before, one, now())
    return out.join(was, "id").select("id", "status", F.col("retry_count").cast("int").alias("retry_count"), "rejection_reason", micros("updated_at").alias("updated_us"), "was_processable")


@query("""
with x as (select article_id id, sha256(text) hash, strlen(text) bytes, extracted_at, row_number() over (partition by article_id order by extracted_at, sha256(text)) rn, count(*) over (partition by article_id) n from extracted_articles where text is not null),
known as (select id, hash from x where rn = 1 and substr(id, 1, 1) < '8'),
late as (select id, hash, bytes, extracted_at from x where substr(id, 1, 1) >= '8' and rn = 1 union all select id, hash, bytes, extracted_at from x where substr(id, 1, 1) < '8' and rn = 2),
cand as (select hash, id, 0 k, null::timestamptz t from known union all select hash, id, 1, extracted_at from late),
first as (select hash, id first_id from (select *, row_number() over (partition by hash order by k, t, id) rn from cand) where rn = 1)
select l.id, case when f.first_id <> l.id then f.first_id end as duplicate_of, case when f.first_id = l.id then 'articles/' || l.id || '/' || l.hash || '.txt' end as object_key, case when f.first_id = l.id then l.bytes else -1 end as bytes,
  case when f.first_id = l.id and o.hash <> l.hash then 'articles/' || l.id || '/' || o.hash || '.txt' end as expired_key from late l join first f using (hash) left join known o on o.id = l.id""")
def q54_saved_bodies(spark, d):
    """New bodies against those held: duplicates named, the others saved under their hash, replaced bodies expired."""
    w = W.partitionBy("article_id").orderBy("extracted_at", "hash")
    x = read(spark, d, "extracted_articles").filter("text is not null").select("article_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("bytes"), "extracted_at").withColumn("rn", F.row_number().over(w))
    early = F.substring("article_id", 1, 1) < "8"
    known = x.filter(early & (F.col("rn") == 1)).select(F.col("article_id").alias("id"), "hash")
    late = x.filter((~early & (F.col("rn") == 1)) | (early & (F.col("rn") == 2))).select(F.col("article_id").alias("id"), "hash", "bytes", F.col("extracted_at").alias("at"))
    return snap.saved_bodies(known, late).withColumn("bytes", F.coalesce("bytes", F.lit(-1)))


@query("""
with n as (select id, analysis_version v, intrinsic_score s, analyzed_at t, provider p, row_number() over (partition by id, analysis_version order by analyzed_at desc, provider desc, intrinsic_score desc nulls last) rn from ready_articles where id is not null and analysis_version is not null)
select id, v as analysis_version, provider, score, case when score >= 7.5 then 'ready' else 'rejected' end as status from (select id, v, p as provider, coalesce(s, -1.0) score from n where rn = 1)""")
def q55_saved_analyses(spark, d):
    """One analysis per article and version, the last written; the status follows from it."""
    rows = read(spark, d, "ready_articles").filter("id is not null and analysis_version is not null")
    best = rows.groupBy("id", "analysis_version").agg(F.max(F.struct("analyzed_at", "provider", "intrinsic_score")).alias("m"))
    score = F.coalesce("m.intrinsic_score", F.lit(-1.0))
    return best.select("id", "analysis_version", F.col("m.provider").alias("provider"), score.alias("score"), F.when(score >= 7.5, "ready").otherwise("rejected").alias("status"))


@query("with " + ART + """,
days as (select cast(make_timestamp(pub + 28800000000) as date) d, id, intrinsic from art where pub is not null and intrinsic >= 7.5),
ranked as (select *, row_number() over (partition by d order by intrinsic desc, id) place from days)
select cast(d as varchar) as day, id, cast(place as int) as place, intrinsic, place = 1 as chosen, max(case when place = 1 then id end) over (partition by d) as winner from ranked where place <= 10""")
def q56_candidate_snapshots(spark, d):
    """Each day's run: its ten best candidates in rank order, with the winner."""
    days = articles(spark, d).filter(F.col("published_at").isNotNull() & (F.col("intrinsic") >= 7.5)).withColumn("day", dates.civil_date(F.col("published_at")).cast("string"))
    w = W.partitionBy("day").orderBy(F.col("intrinsic").desc(), "id")
    top = days.withColumn("place", F.row_number().over(w)).filter("place <= 10")
    winners = top.filter("place = 1").select("day", F.col("id").alias("winner"))
    return top.join(winners, "day").select("day", "id", F.col("place").cast("int").alias("place"), "intrinsic", (F.col("place") == 1).alias("chosen"), "winner")


@query(f"""
with e as (select event_id, cast(ts as date) as d, epoch_us(ts) u, user_id from events where event_type = 'purchase'), taken as (select distinct cast(ts as date) d from events where event_type = 'signup' and event_id % 7 = 0),
f as (select d, min((u, event_id)) b from e where d not in (select d from taken) group by d)
select event_id, cast(e.d as varchar) as day, coalesce((u, event_id) = b, false) as won, case when coalesce((u, event_id) = b, false) then 'complete' else 'degraded' end as run_status,
  case when coalesce((u, event_id) = b, false) then u + 90 * 86400000000 else -1 end as body_expires_us from e left join f using (d)""")
def q35_slot_winners(spark, d):
    """The first purchase of each free day wins it; only the winner moves its run on and sets the expiry of its body."""
    rows = read(spark, d, "events").select("event_id", "event_type", micros("ts").alias("u"), F.to_date("ts").cast("string").alias("day"))
    taken = rows.filter("event_type = 'signup' and event_id % 7 = 0").select("day").distinct()
    out = snap.arbitrated(rows.filter("event_type = 'purchase'"), "day", ["u", "event_id"], taken)
    return out.select("event_id", "day", "won", "run_status", F.when(F.col("won"), F.col("u") + 90 * 86_400_000_000).otherwise(-1).alias("body_expires_us"))


@query(f"""
with x as (select distinct user_id, cast(ts as date) d from events where event_type = 'signup' and cast(ts as date) <= (select max(cast(ts as date)) from events)),
i as (select *, d + cast(row_number() over (partition by user_id order by d desc) as int) isl from x), g as (select user_id, isl, max(d) newest, count(*) n from i group by all),
s as (select user_id, arg_max(n, newest) streak, max(newest) newest from g group by 1), t as (select user_id, count(*) n_days from x group by 1), l as (select max(cast(ts as date)) last from events)
select user_id, n_days as days, cast(streak as int) as streak, streak >= 2 as ready, case when newest = last - 1 or newest = last then cast(streak as int) else 0 end as running from s join t using (user_id), l""")
def q57_simulation_days(spark, d):
    """Days with a sign-up, the streak that ends with the newest, and whether it still runs on the last day or the day before."""
    rows = read(spark, d, "events").withColumn("day", F.to_date("ts"))
    last = rows.agg(F.max("day").alias("last"))
    ups = rows.filter("event_type = 'signup'")
    days = ups.groupBy("user_id").agg(F.count_distinct("day").alias("days"))
    out = ev.newest_streak(ups, "user_id", "day").join(days, "user_id").crossJoin(last)  # one row
    running = F.when(F.col("newest") >= F.date_sub("last", 1), F.col("streak")).otherwise(0)
    return out.select("user_id", "days", "streak", (F.col("streak") >= 2).alias("ready"), running.alias("running"))


@query("""
with e as (select article_id, embedding_version v, min(embedding_id) first_id, count(*) writes, max(len(vec_values)) n from article_embeddings where article_id is not null group by 1, 2)
select article_id, v as embedding_version, first_id, writes - 1 as ignored, 'vectors/' || v || '/' || article_id || '.json' as object_key, cast(coalesce(n, 0) * 4 as bigint) as bytes from e""")
def q58_embedding_ledger(spark, d):
    """Vectors inserted once per article and version, later writes ignored, each with its object in the ledger."""
    e = read(spark, d, "article_embeddings").filter("article_id is not null").groupBy("article_id", "embedding_version").agg(F.min("embedding_id").alias("first_id"), (F.count(F.lit(1)) - 1).alias("ignored"), F.max(F.when(F.col("vec_values").isNotNull(), F.size("vec_values"))).alias("n"))
    key = F.concat(F.lit("vectors/"), "embedding_version", F.lit("/"), "article_id", F.lit(".json"))
    return e.select("article_id", "embedding_version", "first_id", "ignored", key.alias("object_key"), (F.coalesce("n", F.lit(0)) * 4).cast("long").alias("bytes"))


@query(f"""
with got as (select source_id, count(distinct article_id) n, max(discovered_at) t from discovered_articles group by 1)
select s.id, case when g.n is null then s.consecutive_failures + 1 else 0 end as consecutive_failures, greatest(s.history_pages, cast(coalesce(g.n, 0) // 3 as int)) as history_pages,
  coalesce(epoch_us(greatest(s.last_scanned_at, g.t)), -1) as last_scanned_us, s.consecutive_failures + case when g.n is null then 1 else 0 end >= 7 and g.n is null as alarm,
  case when s.status = 'active' then {_EPOCH} + 2 * 3600000000 else -1 end as locked_until_us from sources s left join got g on g.source_id = s.id""")
def q59_source_counters(spark, d):
    """Sources after a scan: failures counted or cleared, depth never less than before, a lock of two hours on the active."""
    got = read(spark, d, "discovered_articles").groupBy(F.col("source_id").alias("id")).agg(F.count_distinct("article_id").alias("n"), F.max("discovered_at").alias("t"))
    s = read(spark, d, "sources").join(got, "id", "left")
    failures = F.when(F.col("n").isNull(), F.col("consecutive_failures") + 1).otherwise(0)
    return s.select(
        "id", failures.alias("consecutive_failures"), F.greatest("history_pages", F.floor(F.coalesce("n", F.lit(0)) / 3).cast("int")).alias("history_pages"),
        F.coalesce(micros(F.greatest("last_scanned_at", "t")), F.lit(-1)).alias("last_scanned_us"), (F.col("n").isNull() & (failures >= 7)).alias("alarm"),
        F.when(F.col("status") == "active", F.lit(_EPOCH + 2 * 3_600_000_000).cast("long")).otherwise(-1).alias("locked_until_us"),
    )


@query("""
with w as (select user_id, event_id, epoch_us(ts) - (event_id % 5) * 3600000000 started, props from events), g as (select user_id, max((started, event_id)) m from w group by 1)
select w.user_id, w.started as started_us, w.event_id as check_id, cast(json_extract(w.props, '$.k') as int) as k, json_valid(w.props) as valid from w join g on g.user_id = w.user_id and (w.started, w.event_id) = g.m""")
def q60_heartbeats(spark, d):
    """Of each observer the check that started last, however late it wrote; its JSON is read and told valid or not."""
    writes = read(spark, d, "events").select("user_id", (micros("ts") - F.pmod("event_id", F.lit(5)) * 3_600_000_000).alias("started"), F.struct("event_id", "props").alias("value"))
    out = snap.latest_state(writes, "user_id", "started", "value")
    return out.select("user_id", F.col("started").alias("started_us"), F.col("value.event_id").alias("check_id"), F.get_json_object("value.props", "$.k").cast("int").alias("k"), F.try_parse_json("value.props").isNotNull().alias("valid"))


_LEDGER = f"""ledger as (select 'doc/' || doc_id key, coalesce(strlen(text), 0) bytes, published_at + interval 90 day expires_at, doc_id % 3 = 0 gone, doc_id % 10 = 1 failing from documents),
due as (select * from ledger where expires_at is not null and not gone and epoch_us(expires_at) <= {_EPOCH} order by expires_at, key limit 100)"""


@query("with " + _LEDGER + f"""
select cast(sum(case when failing then 0 else 1 end) as bigint) as deleted, cast(sum(case when failing then 0 else bytes end) as bigint) as bytes_freed, cast(sum(case when failing then 1 else 0 end) as bigint) as failed,
  (select count(*) from ledger where expires_at is not null and not gone and epoch_us(expires_at) <= {_EPOCH}) - sum(case when failing then 0 else 1 end)::bigint as remaining from due""")
def q61_expired_cleanup(spark, d):
    """One bounded sweep of expired objects: what was deleted, freed and failed, and what is left."""
    ledger = read(spark, d, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("object_key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        (F.col("published_at") + F.expr("interval 90 days")).alias("expires_at"), F.when(F.col("doc_id") % 3 == 0, now()).alias("deleted_at"), (F.col("doc_id") % 10 == 1).alias("failing"),
    )
    out = snap.swept(ledger, now(), 100, F.col("failing"))
    due = ledger.filter(F.col("expires_at").isNotNull() & F.col("deleted_at").isNull() & (F.col("expires_at") <= now())).agg(F.count(F.lit(1)).alias("due"))
    sums = out.agg(F.sum(F.col("deleted").cast("int")).alias("deleted"), F.sum(F.when(F.col("deleted"), F.col("bytes")).otherwise(0)).alias("bytes_freed"), F.sum((~F.col("deleted")).cast("int")).alias("failed"))
    return sums.crossJoin(due).select("deleted", "bytes_freed", "failed", (F.col("due") - F.col("deleted")).alias("remaining"))  # one row each


# ---- incidents and health ------------------------------------------------------------------------------------------

@query("""
with e as (select user_id, event_id, epoch_us(ts) u, case event_type when 'error' then 'raise' when 'view' then 'acknowledge' when 'purchase' then 'resolve' end act, case when value > 50 then 'critical' else 'warning' end severity from events),
n as (select *, coalesce(sum(case when act = 'resolve' then 1 else 0 end) over (partition by user_id order by u, event_id rows between unbounded preceding and 1 preceding), 0) ep from e where act is not null),
g as (select user_id, ep, min(case when act = 'raise' then (u, event_id) end) f, max(case when act = 'raise' then (u, event_id) end) l, count(*) filter (where act = 'raise') k, max(case when act = 'resolve' then u end) r from n group by 1, 2),
a as (select n.user_id, n.ep, min(n.u) ack from n join g using (user_id, ep) where n.act = 'acknowledge' and (n.u, n.event_id) > g.f group by 1, 2)
select g.user_id, struct_extract(g.f, 1) as opened_us, struct_extract(g.l, 1) as last_seen_us, k as occurrences, n.severity, 'error ' || n.event_id as subject, coalesce(ack, -1) as acknowledged_us, coalesce(r, -1) as resolved_us,
  case when r is not null then 'resolved' when ack is not null then 'acknowledged' else 'open' end as state
from g join n on n.user_id = g.user_id and n.event_id = struct_extract(g.l, 2) left join a on a.user_id = g.user_id and a.ep = g.ep where k > 0""")
def q36_incidents(spark, d):
    """Errors raise, views acknowledge, purchases resolve: the episodes of every user with their state."""
    action = F.when(F.col("event_type") == "error", "raise").when(F.col("event_type") == "view", "acknowledge").when(F.col("event_type") == "purchase", "resolve")
    log = read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), action.alias("action"), F.when(F.col("value") > 50, "critical").otherwise("warning").alias("severity"), F.concat(F.lit("error "), F.col("event_id").cast("string")).alias("subject")).filter("action is not null")
    out = snap.incidents(log)
    none = lambda c: F.coalesce(micros(c), F.lit(-1))
    return out.select(F.col("key").alias("user_id"), micros("opened_at").alias("opened_us"), micros("last_seen_at").alias("last_seen_us"), "occurrences", "severity", "subject", none("acknowledged_at").alias("acknowledged_us"), none("resolved_at").alias("resolved_us"), "state")


@query("""
with h as (select epoch_us(ts) // 3600000000 k, count(*) filter (where event_type = 'purchase') n from events group by 1),
p as (select k, n, sum(n) over (order by k) - n + n as total, lag(n) over (order by k) before from h),
q as (select k, n, max(case when before is null or n > before then k end) over (order by k rows between unbounded preceding and current row) last from p)
select k * 3600000000 as check_us, n as level, last * 3600000000 as progress_us, k - last > 6 as stalled from q""")
def q62_progress(spark, d):
    """Hourly checks of a level: when it last rose above the check before, and whether that is over six hours ago."""
    checks = read(spark, d, "events").groupBy(F.floor(micros("ts") / 3_600_000_000).alias("k")).agg(F.sum((F.col("event_type") == "purchase").cast("int")).alias("level")).withColumn("one", F.lit(0))
    out = snap.progress(checks, "one", "k", "level", F.lit(0))  # one row an hour
    return out.select((F.col("k") * 3_600_000_000).alias("check_us"), "level", (F.col("last_progress") * 3_600_000_000).alias("progress_us"), (F.col("k") - F.col("last_progress") > 6).alias("stalled"))


@query("""
with b as (select min(epoch_us(ts)) // 3600000000 a, max(epoch_us(ts)) // 3600000000 z from events), spine as (select unnest(range(a, z + 1)) k from b),
h as (select epoch_us(ts) // 3600000000 k, count(*) filter (where event_type = 'purchase') done, count(*) filter (where event_type = 'error') failed, count(*) filter (where event_type = 'view') pending from events group by 1),
s as (select s.k, coalesce(done, 0) done, coalesce(failed, 0) failed, coalesce(pending, 0) pending from spine s left join h using (k)),
r as (select k, sum(done) over (order by k rows between 47 preceding and current row) done48, sum(failed) over (order by k rows between 23 preceding and current row) failed24, sum(done + failed) over (order by k rows between 23 preceding and current row) all24, pending from s)
select k * 3600000000 as hour_us, cast(done48 as bigint) as done48, cast(failed24 as bigint) as failed24, all24 >= 5 and failed24 * 2 >= all24 as rate_alert, done48 = 0 and (pending > 0 or failed24 > 0) as stall_alert from r""")
def q63_health_hours(spark, d):
    """Every hour, empty ones too: failures of the last day, work done in the last two, and the alerts that follow."""
    at = F.floor(micros("ts") / 3_600_000_000)
    kind = lambda k: F.sum((F.col("event_type") == k).cast("int"))
    rows = read(spark, d, "events")
    hours = rows.groupBy(at.alias("k")).agg(kind("purchase").alias("done"), kind("error").alias("failed"), kind("view").alias("pending"))
    spine = hours.agg(F.min("k").alias("a"), F.max("k").alias("z")).select(F.explode(F.sequence("a", "z")).alias("k"))
    s = spine.join(hours, "k", "left").fillna(0, ["done", "failed", "pending"])
    last = lambda n: W.partitionBy(F.lit(0)).orderBy("k").rangeBetween(1 - n, 0)  # noqa: E731  (one row an hour)
    r = s.select("k", "pending", F.sum("done").over(last(48)).alias("done48"), F.sum("failed").over(last(24)).alias("failed24"), F.sum(F.col("done") + F.col("failed")).over(last(24)).alias("all24"))
    rate = (F.col("all24") >= 5) & (F.col("failed24") * 2 >= F.col("all24"))
    stall = (F.col("done48") == 0) & ((F.col("pending") > 0) | (F.col("failed24") > 0))
    return r.select((F.col("k") * 3_600_000_000).alias("hour_us"), "done48", "failed24", rate.alias("rate_alert"), stall.alias("stall_alert"))


@query("""
with c as (select user_id, count(*) filter (where event_type = 'error') failed, count(*) filter (where event_type = 'purchase') done, count(*) filter (where event_type = 'view') pending, max(epoch_us(ts)) last_us from events group by 1),
l as (select max(epoch_us(ts)) z from events)
select case when z - last_us > 30 * 86400000000 then 'stale' when failed >= 3 and failed * 2 >= done + failed then 'error' when done = 0 and pending > 0 then 'warning' else 'ok' end as status, count(*) as users from c, l group by 1""")
def q64_health_counts(spark, d):
    """How many users are in each state of health, the first rule that fits deciding."""
    rows = read(spark, d, "events")
    kind = lambda k: F.sum((F.col("event_type") == k).cast("int"))
    c = rows.groupBy("user_id").agg(kind("error").alias("failed"), kind("purchase").alias("done"), kind("view").alias("pending"), F.max(micros("ts")).alias("last_us")).crossJoin(rows.agg(F.max(micros("ts")).alias("z")))  # one row
    status = F.when(F.col("z") - F.col("last_us") > 30 * 86_400_000_000, "stale").when((F.col("failed") >= 3) & (F.col("failed") * 2 >= F.col("done") + F.col("failed")), "error").when((F.col("done") == 0) & (F.col("pending") > 0), "warning").otherwise("ok")
    return c.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("users"))


@query("with " + FEEDBACK + """
select article_id, kind, origin, epoch_us(created_at) as created_us, case when origin = 'simulation' and kind = 'later' then epoch_us(created_at) + 14 * 86400000000 else -1 end as retry_us from said""")
def q86_simulation_feedback(spark, d):
    """Every reaction with when its article may be shown again: two weeks after a simulated `later`."""
    put_off = (F.col("origin") == "simulation") & (F.col("kind") == "later")
    return reactions(spark, d).select("article_id", "kind", "origin", micros("created_at").alias("created_us"), F.when(put_off, micros("created_at") + 14 * 86_400_000_000).otherwise(-1).alias("retry_us"))


@query("with " + ART + f""",
a as (select id, 'https://' || source_id || '.example/p/' || substr(id, 1, 2) url, coalesce(intrinsic, -1.0) q from art where source_id is not null),
r as (select *, row_number() over (partition by url order by q desc, id) place, first_value(id) over (partition by url order by q desc, id) keeper from a),
v as (select article_id, count(*) n from article_embeddings where article_id is not null group by 1)
select r.id, r.url, r.keeper, place = 1 as kept, case when place = 1 then coalesce(v.n, 0) else 0 end as vectors_kept, case when place > 1 then coalesce(v.n, 0) else 0 end as vectors_deleted, case when place > 1 then {_EPOCH} else -1 end as body_expires_us
from r left join v on v.article_id = r.id""")
def q87_url_migration(spark, d):
    """Articles of one address merged: the best stays, of the others vectors are deleted and bodies expire."""
    url = F.concat(F.lit("https://"), "source_id", F.lit(".example/p/"), F.substring("id", 1, 2))
    arts = articles(spark, d).filter("source_id is not null").select("id", url.alias("url"), F.coalesce("intrinsic", F.lit(-1.0)).alias("q"))
    vecs = read(spark, d, "article_embeddings").filter("article_id is not null").groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    out = rel.merged(arts, "url", F.struct(-F.col("q"), "id"), "id").join(vecs, "id", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("id", "url", "keeper", "kept", F.when(F.col("kept"), n).otherwise(0).alias("vectors_kept"), F.when(F.col("kept"), 0).otherwise(n).alias("vectors_deleted"), F.when(F.col("kept"), -1).otherwise(F.lit(_EPOCH).cast("long")).alias("body_expires_us"))
