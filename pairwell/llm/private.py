"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides.

Patterns give the spans that always count (email, ip, card, phone) and candidates for more: keys and tokens
(``secret``), assigned passwords, bank accounts (``iban``), identity numbers (``id``), person names and postal
addresses. On every candidate a regex, a gazetteer, a context and a shape labeler vote. The gazetteer looks up given
and family names, street words and places; the context labeler reads the words before the candidate.

A candidate's kind, votes and features are packed into one small number, its code. The corpus is counted by code,
expectation-maximisation over these counts (at most ``CODES``) estimates how reliable each labeler is and how often each
kind is personal, a logistic model trained on the resulting probabilities decides on every code, and the decisions are
looked up. The lists and the number of codes do not grow with the corpus.

Offsets are code points, the end exclusive. Patterns are linear: they start only where a run starts, and their inner
repetitions never give back. Starts are running sums in blocks of the square root of the number of matches.

Defined cases: NULL and empty texts have no spans; repeated rows get equal spans; without candidates nothing is
trained and the base spans stand; an empty table gives no rows; extra columns are ignored; very long texts are read
whole. Spans of different kinds may overlap; those of one kind never do.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.llm.gazetteer import Gazetteer
from pairwell.session import durable

KINDS = ("email", "ip", "card", "phone", "secret", "password", "iban", "id", "name", "address")
BASE = 4
LOCAL, DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
CAPITAL = r"\p{Lu}[\p{L}.'’-]*+"
#: What comes before an assigned password; the span is what follows.
ASSIGNED = (
    r"(?i)(?:pass(?:word|wd|phrase|code|wort)|pwd|(?:client|access|secret|api|auth)[ _-]?(?:key|secret|token)|secret|token)"
    r"[\"']?+ ?+(?:[:=]|is ) ?+[\"']?+"
)
PATTERNS = {
    # After a match, \G lets the next one start inside the rest of a run.
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{DOMAIN}++(?:\.{DOMAIN}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    # Whole chains of digits only, of 12 to 19 digits.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+",
    "password": rf"(?=[acpstACPST])(?<![\p{{L}}\p{{N}}]){ASSIGNED}[^\s\"',;]{{6,}}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    # Groups of digits with few capitals, six digits or more.
    "id": (
        r"(?=[A-Z0-9])(?<![\p{L}\p{N}_+./:@-])(?=(?:[A-Z]{0,3}[ -]?[A-Z]?[0-9]){6})"
        r"[A-Z]{0,3}+ ?+[0-9]++[A-Z]?+(?:[ -](?:[A-Z]?[0-9]++[A-Z]?+|[A-Z](?![\p{L}]))){0,8}+(?![\p{L}\p{N}_@])"
    ),
    "name": r"\p{Lu}(?<![\p{L}\p{N}_@./'-]\p{Lu})\p{Ll}++(?: \p{Lu}\.)?+(?: \p{Lu}\p{Ll}++(?:[-'’]\p{Lu}\p{Ll}++)?+){1,3}+",
    # A number before capitalised words, or after them; a town and a postal code may follow.
    "address": (
        rf"(?=[0-9\p{{Lu}}])(?:(?<![\p{{L}}\p{{N}}.,:/-])[0-9]{{1,5}}[A-Za-z]?+,?+(?: (?:rue|avenue|boulevard|place|allée|chemin|quai)(?: (?:de|du|des|la|le|les))*+)?+(?: {CAPITAL}){{1,4}}+"
        rf"|(?<![\p{{L}}\p{{N}}.'’-]){CAPITAL}(?: (?:{CAPITAL}|de|del|la|di|der|van)){{0,3}}+ [0-9]{{1,4}}[a-z]?+(?![\p{{L}}\p{{N}}.:-]))"
        rf"(?:,(?: {CAPITAL}){{1,2}}+)*+(?:,? [0-9]{{5}}(?:-[0-9]{{4}})?+(?![0-9]))?+(?: {CAPITAL})?+"
    ),
}
#: Published forms of keys: the key itself, or what stands right before it.
KNOWN_TOKEN, BEFORE_TOKEN = r"^(?:A[KS]IA[A-Z0-9]{16}$|AIza|eyJ)", r"(?:gh[oprsu]_|github_pat_|glpat-|xox[abprs]-|[prs]k[_-](?:live_|test_|proj-)?)$"
KNOWN_ID = (
    r"^(?:[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}"  # three, two and four digits
    r"|[A-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]"
    r"|[0-9]{8}-?[A-Z]|[XYZ]-?[0-9]{7}-?[A-Z]"
    r"|[12] [0-9]{2} [0-9]{2} [0-9]{2} [0-9]{3} [0-9]{3}(?: [0-9]{2})?)$"
)
DATE = r"^(?:(?:19|20)[0-9]{2}[- ][0-9]{1,2}[- ][0-9]{1,2}|[0-9]{1,2}[- ][0-9]{1,2}[- ](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[- ](?:19|20)[0-9]{2})(?: |$)"
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach)\P{L}*$",
    "ip": r"(?i)(?:ip|host|addr\p{L}*|server|login|from)\P{L}*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|payment)\P{L}*(?:(?:number|no|nr)\P{L}*)?$",
    "phone": r"(?i)(?:phone|tel|telefon|call|mobile|cell|fax|contact)\P{L}*$",
    "secret": r"(?i)(?:token|secret|passw\p{L}*|api|key|auth|bearer)[^A-Za-z0-9]*$",
    "password": r"(?i)(?:login|user|account|credential|my|your|the|with)\p{L}*[^\p{L}]*$",
    "iban": r"(?i)(?:iban|account|konto|bank|transfer|cuenta|compte|pay)\p{L}*\P{L}*(?:(?:to|number|no|nr)\P{L}*)?$",
    "id": (
        r"(?i)(?:ssn|social security|passport|passeport|pasaporte|reisepass|licen[cs]e|tax|dni|nie|nif|nino|insurance|identity|national|steuer|\bid)"
        r"\P{L}*(?:(?:number|card|no|nr|num|id|is)\P{L}*){0,3}$"
    ),
    "name": r"(?i)(?:\b(?:mr|mrs|ms|miss|dr|prof|sr|sra|señor|señora|herr|frau|mme|mlle|signed|sincerely|regards|dear|patient|customer|employee|named|called)|name(?: is)?|i am|i'm|contact)\P{L}{0,3}$",
    "address": r"(?i)(?:address|adresse|dirección|lives at|living at|live at|resid\p{L}* (?:at|in)|located at|ship to|deliver to|wohnhaft|home|moved to)\P{L}*$",
}
SIDE = 32
ROUNDS, STILL = 20, 0.001
LABELERS = ("regex", "gazetteer", "context", "shape")
#: Digits of a code below the kind: a vote (0 to 2) for each labeler, then these features with their numbers of values.
FEATURES = {"long": 2, "quoted": 2, "digits": 4}
CODES_OF_KIND = 3 ** len(LABELERS) * math.prod(FEATURES.values())
CODES = CODES_OF_KIND * len(KINDS)
#: Limits of a labeler's reliability and of the share of personal candidates in a kind.
RELIABLE, SHARE = (0.6, 0.97), (0.3, 0.8)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))

    def add(total: Column, x: Column) -> Column:
        doubled = 2 * x["d"]
        return total + F.when(x["i"] % 2 == 0, x["d"]).when(doubled > 9, doubled - 9).otherwise(doubled)

    placed = F.transform(F.filter(each, lambda c: c.isNotNull()), lambda c, i: F.struct(c.alias("d"), i.alias("i")))
    return F.aggregate(placed, F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes its check: its first four characters moved to the end, letters as 10 to 35."""
    packed = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(packed, F.lit(5)), F.substring(packed, 1, 4))
    digit = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + digit(c)) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def valid(kind: str, value: Column) -> Column:
    """Whether a match counts as a base span."""
    digits = F.translate(value, " ().-+", "")
    if kind == "ip":
        small = lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(kind == "email")


def digits_in(value: Column) -> Column:
    return F.length(value) - F.length(F.translate(value, "0123456789", ""))


def votes(kind: str, value: Column, left: Column, lists: Gazetteer) -> dict[str, Column]:
    """+1 personal, -1 not, 0 no opinion, from the candidate itself and from what stands before it."""
    share, length = digits_in(value) / F.length(value), F.length(value)
    words = F.regexp_extract_all(F.lower(value), F.lit(r"\p{L}+"), F.lit(0))
    listed = lambda words, names: F.exists(words, lambda w: w.isin(*names)) if names else F.lit(False)
    hexadecimal = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    side = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    cued = left.rlike(CUES[kind])
    none = F.lit(0)
    if kind in KINDS[:BASE]:
        good = valid(kind, value)
        return {"regex": side(good, ~good), "gazetteer": none, "context": side(cued, F.lit(False)), "shape": side(good, F.lit(False))}
    if kind == "secret":
        # The known form of a key needs no cue and no mixture of digits.
        known, mixed = value.rlike(KNOWN_TOKEN) | left.rlike(BEFORE_TOKEN), share.between(0.25, 0.75)
        regex = side(known | (hexadecimal & (length >= 32)), ~hexadecimal & (length < 32))
        return {"regex": regex, "gazetteer": none, "context": side(cued, ~cued & ~known), "shape": side(known | mixed, ~mixed)}
    if kind == "password":
        mixed = value.rlike(r"[0-9]") | value.rlike(r"[^\p{L}0-9.?!)-]")
        return {"regex": side(mixed, ~mixed), "gazetteer": none, "context": side(cued, F.lit(False)), "shape": side(mixed & value.rlike(r"\p{L}"), ~mixed)}
    if kind == "iban":
        good = mod97(value)
        return {"regex": side(good, ~good), "gazetteer": none, "context": side(cued, F.lit(False)), "shape": side(share > 0.5, share < 0.3)}
    if kind == "id":
        known, plain = value.rlike(KNOWN_ID), value.rlike("^[0-9]+$")
        return {"regex": side(known, value.rlike(DATE) | plain), "gazetteer": none, "context": side(cued, ~cued & ~known), "shape": side(~plain & digits_in(value).between(7, 15), plain)}
    if kind == "name":
        given, family = listed(F.slice(words, 1, 2), lists.given), listed(F.slice(words, 2, F.size(words)), lists.family)
        opens = left.rlike(r"(?:^|[.!?\n])\s*$")
        return {"regex": none, "gazetteer": side(given | (family & cued), ~given & ~family), "context": side(cued, ~cued & ~given), "shape": side(given & family, opens & ~family)}
    street = listed(words, lists.streets) | F.exists(words, lambda w: F.lit(False) if not lists.street_ends else w.rlike(f"(?:{'|'.join(lists.street_ends)})$"))
    code = value.rlike(r"[0-9]{5}(?:-[0-9]{4})?(?:$| )") & value.rlike(r"[0-9][^0-9]+[0-9]")
    year = value.rlike(r"(?:^| )(?:19|20)[0-9]{2}(?: |$)")
    return {"regex": side(street & ~year, ~street), "gazetteer": side(street | (listed(words, lists.places) & code), ~street), "context": side(cued, ~cued & ~street), "shape": side(code, year)}


def code_of(kind: str, value: Column, left: Column, right: Column, lists: Gazetteer) -> Column:
    """A candidate's kind, votes and features as one number below ``CODES``."""
    share = digits_in(value) / F.length(value)
    features = {
        "long": (F.length(value) >= 32).cast("int"),
        "quoted": (F.substring(left, -1, 1).isin('"', "'", "=", "`") & right.isin('"', "'", "`", "", " ", "\n")).cast("int"),
        "digits": F.floor(3.999 * share).cast("int"),
    }
    code = F.lit(KINDS.index(kind))
    for vote in votes(kind, value, left, lists).values():
        code = 3 * code + vote + 1
    for name, values in FEATURES.items():
        code = values * code + features[name]
    return code.cast("int")


def unpacked(code: Column) -> dict[str, Column]:
    """``kind``, the votes and the features of a code."""
    out = {}
    for name, values in reversed([*((v, 3) for v in LABELERS), *FEATURES.items()]):
        out[name] = (code % values).cast("int") - (1 if name in LABELERS else 0)
        code = F.floor(code / values)
    return {"kind": code.cast("int"), **out}


PLACED = "array<struct<start:int,end:int,left:string,value:string,right:string>>"


def placed(pieces: Column) -> Column:
    """Matches with their starts and ends, from ``pieces``: the text before each match, the match and the one character after.

    A fold copies its array at every step, so it runs over blocks of the square root of the number of pieces.
    """
    size = F.size(pieces)
    block = F.ceil(F.sqrt(size)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(size / block).cast("int") - 1), lambda b: F.slice(pieces, b * block + 1, block))
    none = F.array().cast(PLACED)

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.length(piece["gap"]) + piece["skip"]
        end = start + F.length(piece["value"])
        left = F.substring(piece["gap"], -SIDE, SIDE)
        span = F.struct(start.alias("start"), end.alias("end"), left.alias("left"), piece["value"].alias("value"), piece["right"].alias("right"))
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    first = F.array(F.struct(F.lit(0).alias("at"), none.alias("spans")))
    fold = lambda at, part: F.aggregate(part, F.struct(at.alias("at"), none.alias("spans")), step)
    done = F.aggregate(blocks, first, lambda acc, part: F.array_append(acc, fold(F.element_at(acc, -1)["at"], part)))
    return F.when(size > 0, F.flatten(F.transform(done, lambda x: x["spans"]))).otherwise(none)


def candidates(docs: DataFrame, lists: Gazetteer = Gazetteer()) -> DataFrame:  # noqa: B008
    """``doc_id, spans``: all matches of all kinds as (start, code, end), in order.

    The steps stand in columns of their own, so that none is evaluated once for each element of another.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"))
    rows = rows.select("doc_id", "_text", *[F.regexp_extract_all("_text", F.lit(PATTERNS[k]), F.lit(0)).alias(f"_v_{k}") for k in KINDS])
    gaps = [F.when(F.size(f"_v_{k}") > 0, F.split("_text", PATTERNS[k], -1)).otherwise(F.array().cast("array<string>")).alias(f"_g_{k}") for k in KINDS]
    rows = rows.select("doc_id", *[f"_v_{k}" for k in KINDS], *gaps)

    def pieces(kind: str) -> Column:
        values, gaps = F.col(f"_v_{kind}"), F.col(f"_g_{kind}")
        n = F.size(values)
        pairs = F.zip_with(F.slice(gaps, 1, n), values, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))

        def piece(pair: Column, after: Column) -> Column:
            whole = pair["value"]
            value = F.regexp_replace(whole, f"^{ASSIGNED}", "") if kind == "password" else whole
            skip = F.length(whole) - F.length(value)
            return F.struct(pair["gap"].alias("gap"), skip.alias("skip"), value.alias("value"), F.substring(after, 1, 1).alias("right"))

        return F.zip_with(pairs, F.slice(gaps, 2, n), piece)

    rows = rows.select("doc_id", *[pieces(k).alias(f"_p_{k}") for k in KINDS])
    rows = rows.select("doc_id", *[placed(F.col(f"_p_{k}")).alias(f"_s_{k}") for k in KINDS])

    def coded(kind: str) -> Column:
        return F.transform(
            f"_s_{kind}",
            lambda s: F.struct(s["start"].alias("start"), code_of(kind, s["value"], s["left"], s["right"], lists).alias("code"), s["end"].alias("end")),
        )

    return rows.select("doc_id", F.array_sort(F.concat(*[coded(k) for k in KINDS])).alias("spans"))


def probabilities(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Add ``p``, the probability that a candidate of the pattern is personal, by expectation-maximisation.

    ``patterns`` has ``kind``, a column per labeler and ``n``. A labeler is right with one probability wherever it
    votes, every kind has its own share of personal candidates; both stay within ``RELIABLE`` and ``SHARE``, so that
    labels cannot turn over. Rounds end when no figure moves by ``STILL`` or more. Every round is one aggregate over this table of at most ``CODES`` rows.
    """
    within = lambda x, limits: min(max(x, limits[0]), limits[1])
    right, share = dict.fromkeys(LABELERS, 0.8), [0.5] * len(KINDS)

    def posterior() -> Column:
        prior = F.array(*[F.lit(math.log(s / (1 - s))) for s in share])
        score = F.get(prior, F.col("kind"))
        for v in LABELERS:
            score = score + F.col(v) * math.log(right[v] / (1 - right[v]))
        return 1 / (1 + F.exp(-score))

    for _ in range(rounds):
        p, n = posterior(), F.col("n")
        agrees = lambda v: F.when(F.col(v) == 1, p).when(F.col(v) == -1, 1 - p).otherwise(0.0) * n  # noqa: E731,B023
        m = patterns.agg(
            *[F.sum(agrees(v)).alias(f"{v}_right") for v in LABELERS],
            *[F.sum(F.abs(v) * n).alias(f"{v}_all") for v in LABELERS],
            *[F.sum(F.when(F.col("kind") == k, p * n).otherwise(0.0)).alias(f"k{k}") for k in range(len(KINDS))],
            *[F.sum(F.when(F.col("kind") == k, n).otherwise(0.0)).alias(f"n{k}") for k in range(len(KINDS))],
        ).first()
        before = [*right.values(), *share]
        right = {v: within((m[f"{v}_right"] + 4) / (m[f"{v}_all"] + 5), RELIABLE) for v in LABELERS}
        share = [within((m[f"k{k}"] + 1) / (m[f"n{k}"] + 2), SHARE) for k in range(len(KINDS))]
        if max(abs(a - b) for a, b in zip(before, [*right.values(), *share], strict=True)) < STILL:
            break
    return patterns.withColumn("p", posterior())


def features_of(columns: dict[str, Column]) -> Column:
    """Every vote and feature of a code in the place of its kind, and the kind itself."""
    of_kind = lambda k, c: F.when(columns["kind"] == k, c.cast("double")).otherwise(0.0)
    named = [F.lit(1), *[columns[v] for v in (*LABELERS, *FEATURES)]]
    return F.array(*[of_kind(k, c) for k in range(len(KINDS)) for c in named])


def accepted(found: DataFrame) -> list[int]:
    """The codes of open kinds that the span classifier takes for personal data, at most ``CODES``."""
    codes = found.select(F.explode("spans").alias("s")).groupBy("s.code").agg(F.count(F.lit(1)).cast("double").alias("n"))
    named = {k: v.alias(k) for k, v in unpacked(F.col("code")).items()}
    patterns = durable(codes.select("code", "n", *named.values()))
    if patterns.where(F.col("kind") >= BASE).isEmpty():
        return []
    soft = probabilities(patterns)
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("p") * F.col("n")).alias("w")), F.struct(F.lit(0.0).alias("label"), ((1 - F.col("p")) * F.col("n")).alias("w"))))
    columns = {k: F.col(k) for k in named}
    rows = soft.select("code", "kind", sides.alias("_s"), array_to_vector(features_of(columns)).alias("features")).select("code", "kind", "features", "_s.label", "_s.w")
    # At most twice as many rows as there are codes.
    rows = rows.coalesce(1)
    model = LogisticRegression(weightCol="w", regParam=1e-6, standardization=False, maxIter=200).fit(rows)
    judged = model.transform(rows.where((F.col("kind") >= BASE) & (F.col("label") == 1.0)))
    return sorted(r["code"] for r in judged.where(vector_to_array("probability")[1] > 0.5).select("code").collect())


def find_private(docs: DataFrame, lists: Gazetteer = Gazetteer()) -> DataFrame:  # noqa: B008
    """One row per document: base counts and digest, and all spans as ``kind:start:end``."""
    found = durable(candidates(docs, lists))
    return told(found, accepted(found))


def told(found: DataFrame, codes: Sequence[int]) -> DataFrame:
    """Counts and spans of the candidates that are base spans or have one of the given codes."""
    top = F.lit(3 ** (len(LABELERS) - 1) * math.prod(FEATURES.values()))
    kind_of = lambda c: F.floor(c["code"] / CODES_OF_KIND).cast("int")
    # The vote of the first labeler, the pattern's own check.
    base = lambda c: (c["code"] < BASE * CODES_OF_KIND) & (F.floor(c["code"] / top) % 3 == 2)
    added = lambda c: c["code"].isin(*codes) if codes else F.lit(False)
    names = F.array(*[F.lit(k) for k in KINDS])
    tell = lambda spans: F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, kind_of(c)), c["start"].cast("string"), c["end"].cast("string"))), ",")
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda c: base(c) & (kind_of(c) == k))).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id",
        *[count(k) for k in range(BASE)],
        F.sha2(tell(F.filter(spans, base)), 256).alias("base_sha256"),
        tell(F.filter(spans, lambda c: base(c) | added(c))).alias("spans"),
    )
