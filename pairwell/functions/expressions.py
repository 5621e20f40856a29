"""Column expressions for cleaning and deriving. Everything here stays on the JVM side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwell.functions import vocabulary as V


def null_tokens(column: Column, tokens: Sequence[str] = V.RAW_NULL_TOKENS) -> Column:
    """Texts that mean "missing" become NULL."""
    return F.when(~column.isin(*tokens), column)


def to_number(column: Column, kind: str = "double") -> Column:
    """Number or NULL; never an error on bad text."""
    return F.trim(column.cast("string")).try_cast(kind)


def trim_lower(column: Column) -> Column:
    return F.lower(F.trim(column))


def collapse_spaces(column: Column) -> Column:
    return F.regexp_replace(F.trim(column), r"\s+", " ")


def lookup(column: Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Value of a small fixed mapping; unmapped values give ``default`` (NULL if none)."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), column)
    return found if default is None else F.coalesce(found, default)


def standard_term(column: Column, mapping: Mapping[str, str] = V.DISEASE_TERMS) -> Column:
    """Collapse whitespace, lower, translate; unmapped terms pass through."""
    cleaned = F.lower(collapse_spaces(column))
    return lookup(cleaned, mapping, default=cleaned)


def iso_date(column: Column) -> Column:
    """``d/m/yyyy`` with an optional time part to ``yyyy-MM-dd``; anything else to NULL."""
    day = F.split(F.trim(column), r"\s+").getItem(0)
    parsed = F.try_to_date(F.when(day.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), day), "d/M/yyyy")
    return F.date_format(parsed, "yyyy-MM-dd")


def year_first(column: Column) -> Column:
    """First ten characters with the date parts reversed if the year comes last."""
    parts = F.split(F.substring(column, 1, 10), "-")
    return F.concat_ws("-", F.when(F.length(F.element_at(parts, -1)) == 4, F.reverse(parts)).otherwise(parts))


def age_from_range(column: Column) -> Column:
    """``20-29`` to the whole part of the median of its numbers, ``25`` to 25, else NULL."""
    text = F.trim(column.cast("string"))
    parts = F.filter(F.transform(F.split(text, "-"), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d+$"))
    numbers = F.array_sort(F.transform(parts, lambda p: p.cast("int")))
    n = F.size(numbers)
    low = F.get(numbers, F.floor((n - 1) / 2).cast("int"))
    high = F.get(numbers, F.floor(n / 2).cast("int"))
    middle = F.floor((low + high) / 2).cast("int")
    return F.when(text.contains("-"), F.when(n > 0, middle)).when(text.rlike(r"^\d+$"), text.try_cast("int"))


def sex_code(column: Column, accepted: Sequence[str] = ("m", "male")) -> Column:
    """1 for the accepted spellings, 0 for any other text, NULL kept."""
    cleaned = trim_lower(column.cast("string"))
    return F.when(cleaned.isin(*accepted), 1).when(column.isNotNull(), 0)


def age_at(reference_year: int | Column, birth_year: Column) -> Column:
    year = F.lit(reference_year) if isinstance(reference_year, int) else reference_year
    return year - birth_year


def decade(age: Column) -> Column:
    return (F.floor(age / 10) * 10).cast("int")


def band(value: Column, edges: Sequence[float] = V.COARSE_EDGES, labels: Sequence[str] = V.COARSE_LABELS) -> Column:
    """Label of the first band whose upper edge is not exceeded; NULL falls in the last band."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one more label than edges is needed")
    expression = F.when(value <= edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:-1]):
        expression = expression.when(value <= edge, label)
    return expression.otherwise(labels[-1])


def composite_key(columns: Sequence[Column], separator: str = "|", missing: str = "nan") -> Column:
    """Joined key in which NULL is a value of its own."""
    return F.concat_ws(separator, *[F.coalesce(c.cast("string"), F.lit(missing)) for c in columns])


def any_positive(columns: Sequence[Column]) -> Column:
    """1 if any member is above zero; NULL counts as zero; no members gives 0."""
    if not columns:
        return F.lit(0)
    tests = [F.coalesce(c.cast("double"), F.lit(0.0)) > 0 for c in columns]
    return reduce(lambda a, b: a | b, tests).cast("int")


def any_other_text(columns: Sequence[Column], value: str) -> Column:
    """1 if any text is neither blank nor the given value."""
    cleaned = F.array(*[trim_lower(c) for c in columns])
    return F.coalesce(
        F.exists(cleaned, lambda t: F.coalesce((t != "") & (t != value), F.lit(False))), F.lit(False)
    ).cast("int")


def count_bin(flags: Sequence[Column]) -> Column:
    """0 for no flag, 1 for up to two, 2 for more."""
    if not flags:
        return F.lit(0)
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in flags])
    return F.when(total == 0, 0).when(total <= 2, 1).otherwise(2)


def recording_key(person: Column, category: Column, date: Column, chunk: Column | None = None) -> Column:
    base = F.concat_ws("_", person.cast("string"), category, F.trim(date))
    if chunk is None:
        return base
    return F.when(chunk.isNull(), base).otherwise(
        F.concat(base, F.lit("_chunk"), F.floor(chunk).cast("long").cast("string"))
    )


def recording_identifier(person: Column, category: Column, date: Column, chunk: Column | None = None) -> Column:
    """Stable 32-bit identifier: first eight hex digits of md5 of the recording key."""
    key = recording_key(person, category, date, chunk)
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def recording_problem(date: Column, chunk: Column | None = None) -> Column:
    """Why no identifier can be made: NULL if all is well."""
    text = F.trim(date)
    shape = (F.length(text) != 10) | (F.length(text) - F.length(F.replace(text, F.lit("-"))) != 2)
    problem = F.when(date.isNull() | (text == ""), "date missing").when(shape, "date not YYYY-MM-DD")
    if chunk is not None:
        problem = problem.when(chunk.isNotNull() & (chunk % 1 != 0), "chunk not whole")
    return problem


def body_mass_index(bmi: Column, height_cm: Column, weight_kg: Column) -> Column:
    """Stated value if there is one, however odd; else weight over squared height."""
    computed = F.when(height_cm > 0, weight_kg / F.pow(height_cm / 100, 2))
    return F.when(bmi.isNotNull(), to_number(bmi)).otherwise(computed)


def logit(p: Column) -> Column:
    return F.when((p > 0) & (p < 1), F.ln(p / (1 - p)))


def clip(value: Column, low: float | Column | None, high: float | Column | None) -> Column:
    """Value forced into the bounds; NULL stays NULL."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low) if isinstance(low, (int, float)) else low)
    if high is not None:
        bounded = F.least(bounded, F.lit(high) if isinstance(high, (int, float)) else high)
    return F.when(value.isNotNull(), bounded)


def rebase_path(path: Column, folder: str) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.element_at(F.split(path, "/"), -1))


def run_name_parts(name: Column) -> dict[str, Column]:
    """Fields of ``norm__scope__feature__hyper__task__splitting__classifier``.

    Names without voice features start with the scope, so their fields move one place to the left.
    """
    parts = F.split(name, "__")
    first = F.get(parts, F.lit(0))
    plain = first.isin(*V.DEMOGRAPHIC_SCOPES)
    return {
        "norm": F.when(plain, "").otherwise(first),
        "scope": F.when(plain, first).otherwise(F.get(parts, F.lit(1))),
        "feat_variant": F.when(plain, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(2))),
        "splitting": F.when(plain, "").otherwise(F.get(parts, F.lit(5))),
        "clf_short": F.when(plain, F.get(parts, F.lit(4))).otherwise(F.get(parts, F.lit(6))),
    }


def variant_parts(variant: Column, splitting: Column) -> dict[str, Column]:
    """Recording type and feature family of a variant name such as ``parsel_a_egemaps``."""
    families = "|".join(V.FEATURE_FAMILIES)
    acoustic = rf"^parsel_(?:(.*)_)?({families})$"
    embedded = variant.startswith("wav2vec_")
    hit = variant.rlike(acoustic)
    bare = F.replace(variant, F.lit("wav2vec_"), F.lit(""))
    raw = F.when(embedded, bare).when(hit, F.regexp_extract(variant, acoustic, 1))
    kind = F.when((raw == "poem") & (splitting == "split"), "poem_chunked").otherwise(raw)
    family = F.when(embedded, "wav2vec2").when(hit, F.regexp_extract(variant, acoustic, 2))
    return {"recording_type": kind, "feature_family": family}


def table_cell(variant: Column, splitting: Column) -> dict[str, Column]:
    """Row and column titles of the run matrix; NULL where the vocabulary has no entry."""
    column = F.when(variant.startswith("wav2vec_"), "wav2vec2")
    for suffix, title in V.FAMILY_TITLES.items():
        column = column.when(variant.endswith(suffix), title)
    row = (
        F.when(variant.contains("poem"), F.when(splitting == "split", "poem chunked").otherwise("poem unchunked"))
        .when(variant.contains("all_vowels"), "all vowels")
        .when(variant.startswith("parsel_a_") | (variant == "wav2vec_a"), "vowel /a/")
        .when(variant.startswith("parsel_i_") | (variant == "wav2vec_i"), "vowel /i/")
        .when(variant.startswith("parsel_o_") | (variant == "wav2vec_o"), "vowel /o/")
    )
    return {"table_row": row, "table_col": column}


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def factor_of(term: Column) -> Column:
    return (
        F.when(term.startswith("rec:"), "Recording type")
        .when(term.startswith("feat:"), "Feature family")
        .when(term.startswith("clf:"), "Classifier")
        .when(term.startswith("norm:"), "Normalization")
        .when(term.startswith("scope:"), "Scope")
        .otherwise("Other")
    )


def safe_key(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<="), F.lit("le")), F.lit(">"), F.lit("gt"))


def default_language(language: Column, source: Column, local_source: str = V.LOCAL_SOURCE, local: str = "de") -> Column:
    """Blank language of the local source becomes its language; other NULLs become ``unknown``."""
    blank = language.isNull() | (language == "")
    return F.coalesce(F.when(blank & (source == local_source), local).otherwise(language), F.lit("unknown"))
