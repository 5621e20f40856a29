"""Cleaning and scalar derivations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.catalog.base import query, rounded
from pairwell.functions import expressions as E
from pairwell.functions import frames
from pairwell.functions import vocabulary as V


@query(
    "P1 P2 P3 P5",
    """select c_custkey as study_id,
         case when c_nationkey % 5 = 0 then null else lower(trim('  ' || c_mktsegment || ' ')) end as sex,
         case when c_nationkey % 3 = 0 then null else lower(c_name) end as bmi
       from customer""",
)
def clean_headers_tokens_and_texts(t):
    raw = t.view(
        """select c_custkey as ` Studien - ID`,
             case when c_nationkey % 5 = 0 then 'unbekannt' else '  ' || c_mktsegment || ' ' end as `Sex `,
             case when c_nationkey % 3 = 0 then '/' else c_name end as `B M I` from {customer}"""
    )
    return frames.trim_lower(frames.null_tokens(frames.rename(frames.normalize_names(raw), V.MAIN_HEADERS)))


@query(
    "P4",
    """select event_id, try_cast(v as double) as number from (
         select event_id, case event_id % 4 when 0 then cast(value as varchar) when 1 then 'x' || event_id
           when 2 then ' ' || cast(event_id as varchar) || ' ' else '' end as v from events)""",
)
def coerce_numbers(t):
    raw = t.view(
        """select event_id, case event_id % 4 when 0 then cast(value as string) when 1 then 'x' || event_id
             when 2 then ' ' || cast(event_id as string) || ' ' else '' end as number from {events}"""
    )
    return frames.numbers(raw, ["number"])


@query(
    "P6",
    """select c_custkey, case c_mktsegment when 'BUILDING' then 'copd' when 'MACHINERY' then 'control'
         when 'FURNITURE' then 'fibrosis' else lower(c_mktsegment) end as disease from customer""",
)
def standardize_terms(t):
    raw = t.view(
        """select c_custkey, case c_mktsegment when 'BUILDING' then ' COPD' when 'MACHINERY' then 'Keine   bekannt '
             when 'FURNITURE' then 'Lungenfibrose' else c_mktsegment end as disease from {customer}"""
    )
    return frames.standard_terms(raw, ["disease"])


@query(
    "P7 P8",
    """select o_orderkey,
         case when o_orderkey % 7 = 0 then null else strftime(o_orderdate, '%Y-%m-%d') end as iso,
         strftime(o_orderdate, '%Y-%m-%d') as reordered from orders""",
)
def normalize_dates(t):
    raw = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 == 0, "31/02/2020")
        .when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss"))
        .otherwise(F.date_format("o_orderdate", "d/M/yyyy"))
        .alias("a"),
        F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
        .otherwise(F.date_format("o_orderdate", "dd-MM-yyyy HH:mm"))
        .alias("b"),
    )
    return raw.select("o_orderkey", E.iso_date(F.col("a")).alias("iso"), E.year_first(F.col("b")).alias("reordered"))


@query(
    "P9",
    """with r as (select p_partkey, case p_partkey % 4 when 0 then p_size || '-' || (p_size + 9)
           when 1 then cast(p_size as varchar) when 2 then 'unknown' else p_size || '-' || (p_size + 4) || '-' || (p_size + 5) end as age_text,
           case p_partkey % 4 when 0 then cast(floor(p_size + 4.5) as int) when 1 then p_size when 2 then null else p_size + 4 end as parsed from part)
       select p_partkey, age_text, coalesce(parsed, cast(floor((select quantile_cont(parsed, 0.5) from r)) as int)) as age from r""",
)
def fill_ages_from_ranges(t):
    raw = t.view(
        """select p_partkey, case p_partkey % 4 when 0 then p_size || '-' || (p_size + 9)
             when 1 then cast(p_size as string) when 2 then 'unknown' else p_size || '-' || (p_size + 4) || '-' || (p_size + 5) end as age_text
           from {part}"""
    )
    return frames.fill_ages_from_ranges(raw, "age_text", "age")


@query(
    "P10",
    """select p_partkey, cast(p_partkey % 2 = 0 as int) as even, cast(p_partkey % 3 = 0 as int) as third,
         cast(p_size > 25 as int) as large from part""",
)
def one_hot_tokens(t):
    raw = t.view(
        """select p_partkey, concat_ws(',', case when p_partkey % 2 = 0 then 'even' end,
             case when p_partkey % 3 = 0 then 'third' end, case when p_size > 25 then 'large' end) as tokens from {part}"""
    )
    return frames.one_hot(raw, "tokens").drop("tokens")


@query(
    "P11 P12 P13 P15 P16 P17 P37",
    """select person_id, case sex when 1 then 1 else 0 end as sex_num, 2025 - (2025 - age) as age_ref,
         cast(floor(age / 10) * 10 as int) as decade,
         case when age <= 65 then '<=65' when age <= 75 then '66-75' else '>75' end as band,
         case when age <= 55 then '<=55' when age <= 65 then '56-65' when age <= 75 then '66-75' else '>75' end as fine_band,
         coalesce(cast(flag_c as varchar), 'nan') || '|' || language as stratum,
         case segment when 'BUILDING' then 'copd' when 'MACHINERY' then 'control' end as disease,
         case when site % 5 = 0 then case when person_id % 2 = 0 then 'de' else 'unknown' end else language end as language_clean
       from {persons}""",
)
def derive_person_columns(t):
    raw = t.persons.withColumns(
        {
            "sex_text": F.when(F.col("sex") == 1, " Male").otherwise("f"),
            "lang": F.when(F.col("site") % 5 == 0, F.when(F.col("person_id") % 2 == 0, F.lit(""))).otherwise(F.col("language")),
            "source": F.when(F.col("person_id") % 2 == 0, "charite").otherwise("uk_covid"),
        }
    )
    return raw.select(
        "person_id",
        E.sex_code(F.col("sex_text")).alias("sex_num"),
        E.age_at(V.REFERENCE_YEAR, 2025 - F.col("age")).alias("age_ref"),
        E.decade(F.col("age")).alias("decade"),
        E.band(F.col("age")).alias("band"),
        E.band(F.col("age"), V.FINE_EDGES, V.FINE_LABELS).alias("fine_band"),
        E.composite_key([F.col("flag_c"), F.col("language")]).alias("stratum"),
        E.lookup(F.col("segment"), {"BUILDING": "copd", "MACHINERY": "control"}).alias("disease"),
        E.default_language(F.col("lang"), F.col("source")).alias("language_clean"),
    )


@query("P14", "select rec_no, cast(substr(date, 1, 4) as int) - 1950 as age_at_recording from {recordings}")
def age_at_recording(t):
    r = t.recordings
    return r.select("rec_no", E.age_at(F.year(F.col("date").cast("date")), F.lit(1950)).alias("age_at_recording"))


@query(
    "P18 P19 P20",
    """select person_id, cast(flag_a > 0 or coalesce(flag_c, 0) > 0 as int) as group_flag, 0 as empty_group,
         cast(language not in ('de') or segment not in ('BUILDING') as int) as other_text,
         case flag_a + flag_b + coalesce(flag_c, 0) when 0 then 0 when 1 then 1 when 2 then 1 else 2 end as count_bin
       from {persons}""",
)
def combine_flags(t):
    p = t.persons
    return p.select(
        "person_id",
        E.any_positive([F.col("flag_a"), F.col("flag_c")]).alias("group_flag"),
        E.any_positive([]).alias("empty_group"),
        F.greatest(
            E.any_other_text([F.col("language"), F.lit(" ")], "de"), E.any_other_text([F.col("segment")], "building")
        ).alias("other_text"),
        E.count_bin([F.col("flag_a"), F.col("flag_b"), F.col("flag_c")]).alias("count_bin"),
    )


@query(
    "P21",
    """select rec_no, cast('0x' || substr(md5(audio_id || '_' || recording_category || '_' || date ||
         case when chunk_number is null then '' else '_chunk' || chunk_number end), 1, 8) as bigint) as recording_identifier
       from {recordings}""",
)
def recording_identifiers(t):
    ident = E.recording_identifier(F.col("audio_id"), F.col("recording_category"), F.col("date"), F.col("chunk_number"))
    return t.recordings.select("rec_no", ident.alias("recording_identifier"))


@query(
    "P22",
    """with ids as (select *, cast('0x' || substr(md5(audio_id || '_' || recording_category || '_' || date), 1, 8) as bigint) as rid from {recordings}),
       wanted as (select rid from ids where chunk_number = 1 group by rid)
       select rid, audio_id, recording_category, date, count(*) as n from ids semi join wanted using (rid) group by all""",
)
def reverse_identifier_lookup(t):
    ids = t.recordings.withColumn("rid", E.recording_identifier(F.col("audio_id"), F.col("recording_category"), F.col("date")))
    wanted = ids.where("chunk_number = 1").select("rid")
    return ids.join(wanted, "rid", "left_semi").groupBy("rid", "audio_id", "recording_category", "date").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "P23",
    """select p_partkey, round(case p_partkey % 3 when 0 then p_size when 1 then null
         else (case when p_size > 1 then p_retailprice / 20 / pow((p_size + 140) / 100, 2) end) end, 6) as bmi from part""",
)
def body_mass_index(t):
    raw = t.part.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_partkey") % 3 == 1, "nicht vorhanden").alias("b"),
        F.when(F.col("p_size") > 1, F.col("p_size") + 140).otherwise(0).alias("h"),
        (F.col("p_retailprice") / 20).alias("w"),
    )
    return rounded(raw.select("p_partkey", E.body_mass_index(F.col("b"), F.col("h"), F.col("w")).alias("bmi")))


@query(
    "P24",
    """with p as (select person_id, case when person_id % 4 = 0 then null else age end as age, flag_c from {persons})
       select person_id, round(coalesce(age, (select quantile_cont(age, 0.5) from p)), 6) as age,
         cast(coalesce(flag_c, 0) as double) as flag_c from p""",
)
def fill_missing_values(t):
    p = t.persons.select("person_id", F.when(F.col("person_id") % 4 != 0, F.col("age")).alias("age"), "flag_c")
    return rounded(frames.fill_missing(p, ["age"], ["flag_c"]))


@query(
    "P25",
    """with s as (select avg(age) as m, stddev_pop(age) as s from {persons})
       select person_id, round((age - m) / (s + 1e-9), 6) as age_z, round(pow((age - m) / (s + 1e-9), 2), 6) as age_z2
       from {persons}, s""",
)
def standardize_age(t):
    return rounded(frames.standardize(t.persons, "age", "age_z", "age_z2").select("person_id", "age_z", "age_z2"))


@query(
    "P26 P27",
    """with a as (select l_orderkey, l_linenumber, l_partkey, l_discount * 10 as p from lineitem),
       z as (select *, case when p > 0 and p < 1 then ln(p / (1 - p)) end as z from a)
       select l_orderkey, l_linenumber, l_partkey, round(coalesce(z, (select quantile_cont(z, 0.5) from z)), 6) as z,
         round(least(greatest(p, 0.001), 0.999), 6) as clipped from z""",
)
def finite_logits(t):
    a = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") * 10).alias("p"))
    z = frames.repaired_logit(a, "p", "z").withColumn("clipped", E.clip(F.col("p"), 0.001, 0.999))
    return rounded(z.drop("p"))


@query("P28", "select rec_no, '/clean/wav/voice_' || rec_no || '.wav' as path from {recordings}")
def rebase_paths(t):
    return t.recordings.select("rec_no", E.rebase_path(F.col("audio_sample_path"), "/clean/wav/").alias("path"))


@query(
    "P29 P30",
    """with s as (select run_id, string_split(run_name, '__') as p, run_name from {runs}),
       f as (select run_id, p[1] in ('age_sex_only', 'comorbidity_only', 'age_sex_comorbidity') as d, p from s),
       g as (select run_id, case when d then '' else p[1] end as norm, case when d then p[1] else p[2] end as scope,
         case when d then p[2] else p[3] end as feat_variant, case when d then '' else p[6] end as splitting,
         case when d then p[5] else p[7] end as clf_short from f),
       h as (select *, case when feat_variant like 'wav2vec\\_%' escape '\\' then replace(feat_variant, 'wav2vec_', '')
           when regexp_matches(feat_variant, '^parsel_(.*_)?(all_features|basic_acoustics|egemaps|spectral|temporal)$')
           then regexp_extract(feat_variant, '^parsel_(?:(.*)_)?(all_features|basic_acoustics|egemaps|spectral|temporal)$', 1) end as raw,
         case when feat_variant like 'wav2vec\\_%' escape '\\' then 'wav2vec2'
           when regexp_matches(feat_variant, '^parsel_(.*_)?(all_features|basic_acoustics|egemaps|spectral|temporal)$')
           then regexp_extract(feat_variant, '^parsel_(?:(.*)_)?(all_features|basic_acoustics|egemaps|spectral|temporal)$', 2) end as feature_family from g)
       select run_id, norm, scope, feat_variant, splitting, clf_short, feature_family,
         case when raw = 'poem' and splitting = 'split' then 'poem_chunked' else raw end as recording_type from h""",
)
def parse_run_names(t):
    named = t.runs.select("run_id", *[c.alias(n) for n, c in E.run_name_parts(F.col("run_name")).items()])
    return named.withColumns(E.variant_parts(F.col("feat_variant"), F.col("splitting")))


@query(
    "P31",
    "select run_id, wauroc as \"metrics.wauroc\", classifier_name as clf, wauroc, hyperparam as \"tags.hyperparam\" from {runs}",
)
def strip_header_prefixes(t):
    wide = t.runs.select(
        "run_id", F.col("wauroc").alias("metrics.wauroc"), F.col("classifier_name").alias("params.clf"), "wauroc",
        F.col("hyperparam").alias("tags.hyperparam"),
    )
    return frames.strip_prefixes(wide)


@query(
    "P32",
    """select event_id, 'k' as key, json_extract_string(props, '$.k') as value from events
       union all select event_id, 'a.b', json_extract_string(props, '$.k') from events
       union all select event_id, 'a.list', '[1,2]' from events""",
)
def flatten_properties(t):
    nested = t.events.select(
        "event_id",
        F.concat(F.lit('{"a":{"b":'), F.get_json_object("props", "$.k"), F.lit(',"list":[1,2]},"k":'), F.get_json_object("props", "$.k"), F.lit("}")).alias("j"),
    )
    return frames.flatten_json(nested, "j", ["event_id"])


@query(
    "P33 P34",
    """select run_id, case when wauroc - 0.4 < 0.001 then '***' when wauroc - 0.4 < 0.01 then '**' when wauroc - 0.4 < 0.05 then '*' else '' end as stars,
         case run_id % 3 when 0 then 'Recording type' when 1 then 'Classifier' else 'Other' end as factor,
         case run_id % 2 when 0 then 'le65' else 'gt75' end as stratum from {runs}""",
)
def label_findings(t):
    r = t.runs
    term = F.when(F.col("run_id") % 3 == 0, "rec: o").when(F.col("run_id") % 3 == 1, "clf: rf").otherwise("x")
    key = F.when(F.col("run_id") % 2 == 0, "<=65").otherwise(">75")
    return r.select("run_id", E.stars(F.col("wauroc") - 0.4).alias("stars"), E.factor_of(term).alias("factor"), E.safe_key(key).alias("stratum"))


@query(
    "P35 P36",
    """select person_id, age, sex, case label when 1 then 'copd' else 'control' end as lung_disease_main,
         'uk_covid' as data_source, 'poem' as recording_category, 0 as longitudinal, 1.0::double as temporal_order,
         2020 - age as birth_year, 1 - label as control from {persons}""",
)
def fulfil_target_contract(t):
    p = t.persons.select("person_id", "age", "sex", "label", F.lit(0.5).alias("ps"), F.lit("x").alias("stratum"))
    return frames.contract_columns(p, "label", "uk_covid", "poem")


@query(
    "P38",
    """with base as (select p_type, row_number() over (order by p_type) - 1 as i, count(*) over () as m from (select distinct p_type from part)),
       rec(r, j) as (values ('a', 0), ('poem', 1))
       select 'acoustic' as block, p_type || '_' || r as name, j * m + i as pos from base, rec
       union all select 'demographic', 'age', (select 2 * count(distinct p_type) from part)
       union all select 'demographic', 'sex', (select 2 * count(distinct p_type) + 1 from part)""",
)
def feature_name_catalogue(t):
    base = [r.p_type for r in t.part.select("p_type").distinct().orderBy("p_type").collect()]
    return frames.feature_names(t.spark, [("acoustic", base, ["a", "poem"]), ("demographic", ["age", "sex"], [])])
