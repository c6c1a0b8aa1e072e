"""Audit, budget, session and retention analytics over events, and the states that event logs give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import admission
from ..operators import events as E
from ..operators import sequences
from ..streaming import admission as live
from ..streaming import events as stream
from .base import derived, query, table, twin


@query("t01_lockout", "select event_id, n >= 5 as locked from (select event_id, count(*) over (partition by user_id order by ts range between interval 1440 minutes preceding and current row) as n from events where event_type = 'error')")
def lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "events").where("event_type = 'error'")
    return E.trailing_count(failed, "user_id", "ts", 1440).select("event_id", (F.col("recent") >= 5).alias("locked"))


@query("a05_sliding_failures", "select event_id, count(*) over (partition by user_id order by ts range between interval 15 minutes preceding and current row) as recent from events where event_type = 'error'")
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.trailing_count(table(spark, sf_dir, "events").where("event_type = 'error'"), "user_id", "ts", 15).select("event_id", "recent")


@query("t02_sessions", "with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 720 minutes then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as no from g) select user_id, min(ts)::varchar as began, count(*) as n from s group by user_id, no")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return E.sessions(e, "user_id", "ts", 720).select("user_id", F.col("began").cast("string").alias("began"), "n")


@query("t03_daily_budget", "select event_type, date_trunc('day', ts)::date::varchar as day, count(*) as calls, sum(value::decimal(10,6))::double as spent from events group by all")
def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    g = e.groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).agg(F.count("*").alias("calls"), F.sum(F.col("value").cast("decimal(10,6)")).cast("double").alias("spent"))
    return g.select("event_type", F.to_date("w.start").cast("string").alias("day"), "calls", "spent")


@query("a04_run_spend", "select user_id, count(*) as calls, coalesce(sum(value::decimal(10,6)) filter (where event_type = 'purchase'), 0)::double as spent from events group by user_id")
def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = F.sum(F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(10,6)")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.coalesce(paid.cast("double"), F.lit(0.0)).alias("spent"))


@query("c25_budget_guard", "with s as (select user_id, count(*) as calls, sum(value::decimal(10,6))::double as spent, max(length(props)) * 40 as tokens from events where event_type = 'purchase' group by user_id) select user_id, case when tokens > 1000 then 'input_too_large' when calls >= 18 then 'max_calls' when spent + tokens * 0.5 > 800 then 'budget' end as refused from s")
def guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("calls"), F.sum(F.col("value").cast("decimal(10,6)")).cast("double").alias("spent"), (F.max(F.length("props")) * 40).alias("tokens"))
    return s.select("user_id", E.budget_decision(F.col("spent"), F.col("calls"), F.col("tokens"), F.col("tokens") * 0.5, 1000, 18, 800).alias("refused"))


@query("c29_review_state", "select user_id, arg_max(event_type, (ts, event_id)) as event_type, count(*) as version from events group by user_id")
def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.last_state(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("c29_illegal_steps", "select event_id from (select event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) where before is not null and (before, event_type) not in (('view', 'click'), ('click', 'purchase'), ('view', 'view'), ('click', 'view'), ('purchase', 'view'))")
def illegal(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = [("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view"), ("purchase", "view")]
    return E.illegal_steps(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", allowed).select("event_id")


@query("s24_query_audit", "select event_id, sha256(event_type || ' ' || user_id::varchar) as query_hash, case when user_id % 2 = 0 then event_type end as query_text, round(value)::int as latency_ms from events where value % 1 <> 0.5")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.concat("event_type", F.lit(" "), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").where("value % 1 <> 0.5").select("event_id", F.sha2(asked, 256).alias("query_hash"), F.when(F.col("user_id") % 2 == 0, F.col("event_type")).alias("query_text"), F.round("value").cast("int").alias("latency_ms"))


#: One row for each model call: tokens in and out, and whose prices they are charged at.
CALLS = "select event_id, case user_id % 3 when 0 then 'near' when 1 then 'far' else 'free' end as provider, cast(floor(value * 40) as int) as plain, cast(event_id % 200 as int) as cached, cast(user_id % 150 as int) as output, event_type = 'error' as failed from {events}"
PRICES = {"near": ("0.10", "0.01", "0.50"), "far": ("1.25", "0.125", "10.00"), "free": ("0", "0", "0")}
CHARGED = " ".join(f"when '{p}' then greatest(plain - cached, 0) * {a} + cached * {b} + output * {c}" for p, (a, b, c) in PRICES.items())


@query("s25_usage_ledger", f"select event_id, provider, case when failed then 'failed' else 'ok' end as status, (round(case provider {CHARGED} end, 0) / 1000000)::decimal(10,6)::double as usd from ({twin(CALLS)})")
def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, usd = derived(spark, sf_dir, CALLS), F.lit(None).cast("decimal(10,6)")
    for provider, rates in PRICES.items():
        usd = F.when(F.col("provider") == provider, V.estimate_usd(F.col("plain"), F.col("cached"), F.col("output"), rates)).otherwise(usd)
    return c.select("event_id", "provider", F.when(F.col("failed"), "failed").otherwise("ok").alias("status"), usd.cast("double").alias("usd"))


@query("r11_price_lookup", "select c_custkey, price, case when price is null then 'no price' end as problem from customer left join (select * from (values ('BUILDING', 0.1), ('MACHINERY', 0.5)) t(seg, price)) on seg = c_mktsegment".replace("price, case", "price::double as price, case"))
def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.createDataFrame([("BUILDING", 0.1), ("MACHINERY", 0.5)], "c_mktsegment string, price double")
    return table(spark, sf_dir, "customer").join(p, "c_mktsegment", "left").select("c_custkey", "price", F.when(F.col("price").isNull(), "no price").alias("problem"))


@query("r14_list_users", "select c_custkey, lower(trim(c_name)) as email from customer order by email")
def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.lower(F.trim("c_name")).alias("email")).orderBy("email")


@query("t06_progress_order", "select user_id, count(*) filter (where event_type = 'signup') as finals, max(ts) filter (where event_type = 'signup') = max(ts) as final_is_last from events group by user_id")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("event_type") == "signup"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(done).alias("finals"), (F.max(F.when(done, F.col("ts"))) == F.max("ts")).alias("final_is_last"))


#: Each event as a priced call of an endpoint and provider on its day; money in thousandths of millionths. The third provider has no price.
PRICED = """
select event_id as call_id, ts, event_type || '/' || cast(user_id % 3 as string) || '/' || substr(cast(ts as string), 1, 10) as scope, cast(floor(value * 40) as bigint) as tokens,
  case user_id % 3 when 0 then cast(floor(value * 40) as bigint) * 100 + (user_id % 150) * 500 when 1 then cast(floor(value * 40) as bigint) * 1250 + (user_id % 150) * 10000 end as worst,
  case user_id % 3 when 0 then cast(floor(value * 40) as bigint) * 60 + (user_id % 150) * 300 when 1 then cast(floor(value * 40) as bigint) * 900 + (user_id % 150) * 7000 end as cost
from {events}
"""
LIMITS = admission.Limits(input_tokens=3000, calls=12, budget=12_000_000)
ADMITTED = f"""
with recursive c as (select *, row_number() over (partition by scope order by ts, call_id) as n from ({twin(PRICED)})),
r(scope, call_id, n, refused, calls, spent) as (
  select distinct scope, -1::bigint, 0::bigint, null::varchar, 0::bigint, 0::bigint from c
  union all
  select scope, call_id, n, why, calls + (why is null and worst is not null)::bigint, spent + case when why is null and worst is not null then cost else 0 end
  from (select c.*, r.calls, r.spent, case when worst is null then null when tokens > {LIMITS.input_tokens} then 'input_too_large' when r.calls >= {LIMITS.calls} then 'max_calls' when r.spent + worst > {LIMITS.budget} then 'budget' end as why
    from r join c on c.scope = r.scope and c.n = r.n + 1))
"""


@query("c25_admission", f"{ADMITTED} select scope, call_id, refused, calls, spent from r where n > 0")
def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.admissions(derived(spark, sf_dir, PRICED).withColumnRenamed("ts", "at"), LIMITS)


@query("c25_stream_admission", f"{ADMITTED} select scope, call_id, refused, calls, spent from r where n > 0")
def admitted_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = {k: spark.conf.get(k, None) for k in live.STORE}
    for k, v in live.STORE.items():
        spark.conf.set(k, v)
    try:
        stream.read_events(spark, sf_dir, table(spark, sf_dir, "events").schema).createOrReplaceTempView("_admission_events")
        return stream.run_to_table(live.admissions(spark.sql(PRICED.format(events="_admission_events")), LIMITS), "admissions", "append")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@query("a04_admitted_spend", f"{ADMITTED} select scope, count(*) as asked, max(calls) as admitted, count(*) filter (where refused = 'input_too_large') as input_too_large, count(*) filter (where refused = 'max_calls') as max_calls, count(*) filter (where refused = 'budget') as budget, max(spent) as spent from r where n > 0 group by scope")
def admitted_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.spent_by_scope(admitted(spark, sf_dir))


#: A user's day is a run; kinds of events stand for its stages, sources and ends.
RUNS = "select event_id, ts, user_id, substr(cast(ts as string), 1, 10) as day, case event_type when 'view' then 'searching' when 'click' then 'reading' when 'purchase' then 'sources' when 'signup' then 'answer' when 'error' then case when event_id % 11 = 0 then 'lost' else 'error' end end as kind from {events}"


@query("t06_violations", f"""with e as (select *, case kind when 'searching' then 1 when 'reading' then 2 else 0 end as stage from ({twin(RUNS)})),
w as (select *, coalesce(max(stage) over b, 0) as reached, coalesce(bool_or(kind in ('answer', 'error')) over b, false) as ended, coalesce(bool_or(kind = 'sources') over b, false) as sourced, lead(1) over (partition by user_id, day order by ts, event_id) is null as last
  from e window b as (partition by user_id, day order by ts, event_id rows between unbounded preceding and 1 preceding)),
v as (select event_id, case when kind = 'lost' then 'unknown_kind' when kind in ('answer', 'error') and ended then 'second_final' when ended then 'after_final' when kind = 'sources' and sourced then 'sources_twice' when stage > 0 and sourced then 'stage_after_sources'
  when stage > 0 and stage < reached then 'stage_back' when last and kind not in ('answer', 'error') then 'no_final' end as violation from w)
select event_id, violation from v where violation is not null""")
def progress_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.violations(derived(spark, sf_dir, RUNS), ["user_id", "day"], ["ts", "event_id"], "kind", ["searching", "reading"]).select("event_id", "violation")
