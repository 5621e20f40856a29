"""Registration, table access and the roles that the given tables play."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


class Tables:
    """The given tables and the role views over them, for one session and folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in ROLES:
            return self.view(ROLES[name])
        raise AttributeError(name)

    def view(self, text: str) -> DataFrame:
        """A role view: plain SQL that both engines read the same way."""
        used = {n: getattr(self, n) for n in TABLES if "{" + n + "}" in text}
        return self.spark.sql(text, **used)


@dataclass
class Entry:
    run: Callable[[Tables], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None):
    """Register a function under its own name. ``{persons}`` etc. in the SQL stand for role views."""

    def keep(function: Callable[[Tables], DataFrame]):
        name = function.__name__
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Entry(function, None if sql is None else with_roles(sql), tuple(covers.split()))
        return function

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded for comparison between engines (never inside an operator)."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name) if isinstance(f.dataType, floating) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


PERSONS = """
select c_custkey as person_id, cast(floor((c_acctbal + 1000) / 150) as int) + 15 as age,
  c_nationkey % 2 as sex,
  case c_nationkey % 4 when 0 then 'de' when 1 then 'en' when 2 then 'es' else 'fr' end as language,
  case when c_mktsegment = 'BUILDING' then 1 else 0 end as label, c_mktsegment as segment,
  cast(c_custkey % 3 = 0 as int) as flag_a, cast(c_custkey % 7 < 2 as int) as flag_b,
  case when c_custkey % 5 = 0 then null else cast(c_custkey % 2 as int) end as flag_c,
  c_nationkey as site, c_acctbal as balance
from {customer}
"""

RECORDINGS = """
select o_orderkey as rec_no, o_custkey as audio_id,
  case o_orderpriority when '1-URGENT' then 'a' when '2-HIGH' then 'i' when '3-MEDIUM' then 'o' else 'poem' end
    as recording_category,
  cast(cast(o_orderdate as date) as string) as date,
  case o_orderstatus when 'F' then 1 when 'O' then 0 else null end as longitudinal,
  case when o_orderkey % 4 = 0 then cast(o_orderkey % 9 + 1 as int) else null end as chunk_number,
  '/raw/audio/voice_' || cast(o_orderkey as string) || '.wav' as audio_sample_path,
  case when o_custkey % 2 = 0 then 'charite' else 'uk_covid' end as data_source,
  o_totalprice as price
from {orders}
"""

PREDICTIONS = """
select o.o_orderkey as row_id, o.o_custkey as person_id, cast(o.o_orderkey % 50 + 1 as int) as fold,
  case when c.c_mktsegment = 'BUILDING' then 1 else 0 end as truth,
  o.o_totalprice / 599983.0 as score, cast(1 + o.o_orderkey % 3 as double) as weight,
  cast(floor((c.c_acctbal + 1000) / 150) as int) + 15 as age, c.c_nationkey % 2 as sex,
  case c.c_nationkey % 4 when 0 then 'de' when 1 then 'en' when 2 then 'es' else 'fr' end as language
from {orders} o join {customer} c on o.o_custkey = c.c_custkey
"""

AUDIT = """
select l_orderkey, l_linenumber, l_partkey, case when l_returnflag = 'R' then 1 else 0 end as y,
  l_extendedprice / 109987.0 as score, 1 + l_tax * 10 as weight, l_linestatus as grp, l_discount as discount
from {lineitem}
"""

RUNS = """
select event_id as run_id,
  case event_type when 'error' then 'FAILED' when 'view' then 'RUNNING' else 'FINISHED' end as status,
  event_id * 1000 as start_time, event_id * 1000 + user_id as end_time,
  case when event_id % 10 < 2 then
    case event_id % 2 when 0 then 'age_sex_only' else 'comorbidity_only' end || '__none__extended__task__'
      || case user_id % 3 when 0 then 'lr' when 1 then 'rf' else 'gb' end
  else
    case event_id % 2 when 0 then 'norm_on' else 'norm_off' end || '__'
    || case cast(floor(event_id / 2) as bigint) % 2 when 0 then 'voice_only' else 'voice_plus_age_sex_comorbidity' end || '__'
    || case user_id % 8 when 0 then 'wav2vec_poem' when 1 then 'wav2vec_a' when 2 then 'parsel_a_egemaps'
         when 3 then 'parsel_i_spectral' when 4 then 'parsel_o_basic_acoustics' when 5 then 'parsel_poem_temporal'
         when 6 then 'parsel_all_vowels_all_features' else 'other' end
    || '__extended__task__' || case user_id % 2 when 0 then 'split' else 'unsplit' end || '__'
    || case user_id % 3 when 0 then 'lr' when 1 then 'rf' else 'gb' end
  end as run_name,
  case user_id % 3 when 0 then 'LogisticRegression' when 1 then 'RandomForest' else 'GradientBoosting' end as classifier_name,
  case when event_id % 13 = 0 then null when event_id % 4 = 0 then 'basic' else 'extended' end as hyperparam,
  case when event_id % 11 = 0 then null else 0.4 + value / 200 end as wauroc,
  user_id
from {events}
"""

ROLES = {"persons": PERSONS, "recordings": RECORDINGS, "predictions": PREDICTIONS, "audit": AUDIT, "runs": RUNS}


def with_roles(sql: str) -> str:
    """SQL text with role views as sub-selects and given tables by their plain names."""
    for name, text in ROLES.items():
        sql = sql.replace("{" + name + "}", "(" + text.strip() + ")")
    for name in TABLES:
        sql = sql.replace("{" + name + "}", name)
    return sql


def cumulated_sql(source: str, label: str, score: str, weight: str = "1.0", keys: str = "") -> str:
    """``cum`` rows per distinct score with the weights below it and in total (for metric statements)."""
    k = f"{keys}, " if keys else ""
    part = f"partition by {keys}" if keys else ""
    return f"""
mass as (select {k}{score} as score, sum(case when {label} = 1 then {weight} else 0 end) as wp,
    sum(case when {label} = 1 then 0 else {weight} end) as wn
  from {source} where {score} is not null group by all),
cum as (select *,
    coalesce(sum(wp) over ({part} order by score rows between unbounded preceding and 1 preceding), 0) as pb,
    coalesce(sum(wn) over ({part} order by score rows between unbounded preceding and 1 preceding), 0) as nb,
    sum(wp) over ({part}) as pt, sum(wn) over ({part}) as nt from mass)"""
