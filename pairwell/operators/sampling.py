"""Folds, bootstrap samples, hold-outs and interval plans.

Every random choice is a function of md5 over a seed and ids. Results do not depend on the
partitioning, survive the loss of executors and can be recomputed by any engine with md5.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.functions import expressions as E
from pairwell.operators.contracts import ContractError
from pairwell.operators.resampling import Resamples
from pairwell.operators.scan import exact_percentiles, hash_ranks, md5_digits, md5_number, measured_join, null_safe_join
from pairwell.session import durable


def _fold_table(persons: DataFrame, person: str, stratum: Column, k: int, seed: Column | str, keys, out: str):
    """Fold per person: rank in hash order inside the stratum, modulo k.

    If the rarest stratum of a key has fewer than k persons, all strata of that key are pooled.
    """
    base = persons.withColumn("_s", stratum).withColumn("_h", md5_number(seed, F.col(person)))
    sizes = base.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        smallest = sizes.groupBy(*keys).agg(F.min("_n").alias("_min"))
        base = measured_join(base, smallest, list(keys))
    else:
        base = base.withColumn("_min", sizes.agg(F.min("_n")).scalar())
    base = base.withColumn("_s", F.when(F.col("_min") >= k, F.col("_s")).otherwise("_all_")).drop("_min")
    ranked = hash_ranks(base, [*keys, "_s"], "_h", [person], "_r")
    return ranked.withColumn(out, (F.col("_r") % k).cast("int")).drop("_s", "_h", "_r")


def grouped_folds(
    df: DataFrame, person: str, strata: Sequence[str], k: int, seed: int = 42, out: str = "fold"
) -> DataFrame:
    """Stratified k-fold over persons: all rows of a person share a fold (0 .. k-1).

    The label of a person is taken to be constant; check it with ``label_conflicts``.
    """
    persons = df.groupBy(person).agg(*[F.max(c).alias(c) for c in strata])
    n = persons.count()
    if n < k:
        raise ContractError(f"{k} folds need at least {k} persons, found {n}")
    stratum = E.composite_key([F.col(c) for c in strata]) if strata else F.lit("_all_")
    folds = _fold_table(persons, person, stratum, k, str(seed), [], out)
    return null_safe_join(df, folds.select(person, out), [person])


def repeated_folds(
    df: DataFrame, person: str, strata: Sequence[str], k: int, repeats: int, seed: int = 42, out: str = "fold"
) -> DataFrame:
    """Fold numbers 1 .. repeats*k per person, one row per repeat: ``repeat * k + fold + 1``."""
    persons = df.groupBy(person).agg(*[F.max(c).alias(c) for c in strata])
    spread = persons.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    stratum = E.composite_key([F.col(c) for c in strata]) if strata else F.lit("_all_")
    seed_column = F.concat(F.lit(f"{seed}-"), F.col("repeat").cast("string"))
    folds = _fold_table(spread, person, stratum, k, seed_column, ["repeat"], "_f")
    return folds.select(person, "repeat", (F.col("repeat") * k + F.col("_f") + 1).alias(out))


def seed_folds(df: DataFrame, person: str, strata: Sequence[str], k: int, seeds: Sequence[int], out: str = "fold"):
    """Folds for a list of seeds; the seed is one more key."""
    persons = df.groupBy(person).agg(*[F.max(c).alias(c) for c in strata])
    spread = persons.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    stratum = E.composite_key([F.col(c) for c in strata]) if strata else F.lit("_all_")
    folds = _fold_table(spread, person, stratum, k, F.col("seed").cast("string"), ["seed"], out)
    return folds.select(person, "seed", out)


def chunk_report(df: DataFrame, person: str, chunk: str) -> DataFrame:
    """Whether there are chunks, of how many persons, and the most chunks of one person."""
    if chunk not in df.columns:
        df = df.withColumn(chunk, F.lit(None).cast("int"))
    per = df.groupBy(person).agg(F.count(chunk).alias("c"))
    return per.agg(
        (F.coalesce(F.sum("c"), F.lit(0)) > 0).alias("chunked"),
        F.count_if(F.col("c") > 0).alias("n_persons"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_chunks"),
        F.coalesce(F.max("c"), F.lit(0)).alias("max_per_person"),
    )


def bootstrap(
    persons: DataFrame, person: str, replicates: int, strata: Sequence[str] = (), seed: int = 42
) -> DataFrame:
    """Resampling with replacement: (b, person, multiplicity), inside each stratum.

    Slot i of replicate b draws the person with rank ``md5(seed, b, stratum, i) mod n``. Only drawn
    persons are kept; multiplicities of a stratum add up to its size in every replicate.
    """
    return Resamples(persons.select(person, *strata), person, replicates, strata, seed).rows()


def bootstrap_auroc(
    persons: DataFrame,
    person: str,
    label: str,
    scores: Sequence[str],
    weight: str | None,
    replicates: int,
    stratified: bool = True,
    seed: int = 42,
) -> DataFrame:
    """AUROC of several scores on the same resamples: one row per replicate, one column per score.

    Replicates that lost a class give NULL, as the plain bootstrap has to skip them.
    """
    needed = [c for c in dict.fromkeys([person, label, *scores, weight]) if c is not None]
    drawn = Resamples(persons.select(*needed), person, replicates, [label] if stratified else [], seed)
    return drawn.aurocs(label, {score: (score, weight) for score in scores})


def interval(replicated: DataFrame, column: str, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of a replicated figure. One row per replicate needs no blocks."""
    return exact_percentiles(replicated, column, {"lo": alpha / 2, "hi": 1 - alpha / 2}, bounds=[])


def quantile_placement(df: DataFrame, column: str, value: float) -> DataFrame:
    """5/25/50/75/95 % points, mean, and where a fixed value falls in the distribution."""
    points = exact_percentiles(df, column, {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95})
    facts = df.where(F.col(column).isNotNull()).agg(
        F.avg(column).alias("mean"),
        F.avg((F.col(column) <= value).cast("double")).alias("le"),
        F.avg((F.col(column) >= value).cast("double")).alias("ge"),
    )
    return points.withColumns(
        {
            "mean": facts.select("mean").scalar(),
            "frac_le": facts.select("le").scalar(),
            "frac_ge": facts.select("ge").scalar(),
        }
    )


#: How many more units than four times the drawn ones are expected below the hash limit of a hold-out.
SPARE = 40


def holdouts(
    units: DataFrame, unit: str, strata: Sequence[str], per_stratum: int, replicates: int, seed: int = 42
) -> DataFrame:
    """Repeated draws without replacement of ``per_stratum`` units from every stratum: (b, unit).

    Only units with a hash below a limit are ranked, so that some ``4 * per_stratum + SPARE`` of a stratum
    are left per replicate whatever its size. Where fewer than needed are left, all units are ranked.
    """
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = [*strata, "_g"]
    rows = units.select(unit, *strata, F.lit(0).alias("_g"))
    wanted = 4 * per_stratum + SPARE
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    share = F.lower(F.lpad(F.hex((F.lit(float(1 << 60)) * wanted / F.col("_n")).cast("long")), 15, "0"))
    # A limit above every hex digit keeps all units of a small stratum.
    sizes = durable(sizes.withColumn("_limit", F.when(F.col("_n") > wanted, share).otherwise("g")))
    spread = measured_join(rows.repartition(parts, unit), sizes.select(*groups, "_limit"), groups)
    spread = spread.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    digits = md5_digits(str(seed), F.col("b"), F.col(unit))
    near = durable(spread.withColumn("_h", digits).where(F.col("_h") < F.col("_limit")).drop("_limit"))
    found = near.groupBy("b", *groups).agg(F.count(F.lit(1)).alias("_found"))
    every = sizes.drop("_limit").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    short = null_safe_join(every, found, ["b", *groups], "left").where(
        F.coalesce("_found", F.lit(0)) < F.least(F.lit(per_stratum), F.col("_n"))
    )
    short = durable(short.select("b", *groups))
    kept = near
    if not short.isEmpty():
        whole = measured_join(rows, short, groups).withColumn("_h", digits)
        kept = null_safe_join(near, short, ["b", *groups], "left_anti").unionByName(whole)
    w = Window.partitionBy("b", *groups).orderBy("_h", unit)
    ranked = kept.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_stratum)
    return ranked.select(unit, *strata, "b")


def chunk_plan(df: DataFrame, keys: Sequence[str], duration_ms: str, length_ms: int, overlap_ms: int = 0) -> DataFrame:
    """Start and duration of fixed-length chunks.

    Shorter recordings give one chunk. A last piece below half the length is merged into the chunk
    before it; short pieces elsewhere (they need an overlap) are dropped.
    """
    step = length_ms - overlap_ms
    if step <= 0:
        raise ValueError("overlap must be below the chunk length")
    total = F.col(duration_ms).cast("long")
    starts = F.when(total < length_ms, F.array(F.lit(0).cast("long"))).otherwise(
        F.sequence(F.lit(0).cast("long"), F.greatest(total - 1, F.lit(0)), F.lit(step).cast("long"))
    )
    long_enough = F.filter(
        starts, lambda s: (total < length_ms) | (F.least(s + length_ms, total) - s >= length_ms / 2)
    )
    last = F.element_at(starts, -1)
    tail_merged = (total >= length_ms) & (F.least(last + length_ms, total) - last < length_ms / 2)
    rows = df.select(
        *keys,
        total.alias("_t"),
        tail_merged.alias("_tail"),
        F.size(long_enough).alias("_n"),
        F.posexplode(long_enough).alias("_i", "_s"),
    )
    end = F.when(
        F.col("_tail") & (F.col("_i") == F.col("_n") - 1), F.col("_t")
    ).otherwise(F.least(F.col("_s") + length_ms, F.col("_t")))
    return rows.select(
        *keys,
        (F.col("_i") + 1).alias("chunk_number"),
        (F.col("_s") / 1000.0).alias("chunk_start_sec"),
        ((end - F.col("_s")) / 1000.0).alias("chunk_duration_sec"),
    )


def append_chunks(
    recordings: DataFrame, chunks: DataFrame, order: Sequence[str], person: str = "audio_id",
    category: str = "recording_category", value: str = "poem",
) -> DataFrame:
    """Recording table with a row per chunk added.

    A chunk inherits the first row of its person and category; originals stay as they are. Rows are
    unique by person, category, date and chunk number afterwards, originals first.
    """
    from pairwell.operators.cohort import keep_first

    added = {
        "is_chunked": F.lit(False),
        "chunk_number": F.lit(None).cast("int"),
        "chunk_start_sec": F.lit(None).cast("double"),
        "chunk_duration_sec": F.lit(None).cast("double"),
    }
    originals = recordings.withColumns({k: v for k, v in added.items() if k not in recordings.columns})
    base = keep_first(originals.where(F.col(category) == value), [person], order)
    base = base.drop("chunk_number", "chunk_start_sec", "chunk_duration_sec", "is_chunked", "audio_sample_path")
    rows = chunks.join(base, person, "left").withColumns(
        {
            category: F.lit(value),
            "date": F.coalesce("date", F.lit("1900-01-01")),
            "is_chunked": F.lit(True),
        }
    )
    rows = rows.withColumn(
        "recording_identifier",
        E.recording_identifier(F.col(person), F.col(category), F.col("date"), F.col("chunk_number")),
    )
    both = originals.withColumn("_o", F.lit(0)).unionByName(rows.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, [person, category, "date", "chunk_number"], ["_o", *order]).drop("_o")
