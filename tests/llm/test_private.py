"""Spans that the labelers add to the base ones: what is planted is found, clean texts stay without spans."""

import hashlib
import random
import time

from pairwell.llm import private

FILLER = "the report of the meeting was read by many people and the plans for the next season were agreed without further words".split()


def iban(rng):
    body = "".join(rng.choice("0123456789") for _ in range(18))
    check = 98 - int(body + "131400") % 97
    packed = f"DE{check:02d}{body}"
    return " ".join(packed[i : i + 4] for i in range(0, len(packed), 4)) if rng.random() < 0.5 else packed


def planted(rng):
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    given, family = rng.choice(["Maria", "John", "Sarah", "Thomas"]), rng.choice(["Garcia", "Smith", "Okonkwo", "Lindqvist"])
    token = hashlib.sha256(digits(8).encode()).hexdigest()
    return rng.choice(
        [
            ("name", f"{given} {family}", "as agreed with {} last week"),
            ("name", f"Anneke {rng.choice(['Smith', 'Garcia', 'Weber'])}", "the patient {} was seen again"),
            ("address", f"{rng.randrange(1, 900)} {rng.choice(['Oak', 'Main', 'Mill'])} Street, Springfield {digits(5)}", "she lives at {} since then"),
            ("address", f"Hauptstraße {rng.randrange(1, 200)}", "the shop in der {} was closed"),
            ("iban", iban(rng), "please transfer it to {} today"),
            ("id", f"{digits(3)}-{digits(2)}-{digits(4)}", "the social security number {} was used"),
            ("id", f"P{digits(8)}", "with passport number {} at the border"),
            ("password", f"hunter{digits(3)}!", "log in with password: {} there"),
            ("secret", "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23") for _ in range(16)), "we saw {} in the logs"),
            ("secret", token, 'the api key = "{}" is still valid'),
        ]
    )


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    words = lambda k: " ".join(rng.choice(FILLER) for _ in range(k))
    rows, expected = [], {}
    for i in range(n):
        if i % 2:
            clean = rng.choice(["In Chapter 5 of it", "on 2021-03-04 the", "the 2019 World Cup and", "New Plans were", "version 10.2 with 123456789 rows", "the password is required for", "Table 12 shows"])
            rows.append((i, f"{words(12)} {clean} {words(9)}"))
            continue
        kind, value, frame = planted(rng)
        before = f"{words(10)} " + frame.split("{}")[0]
        rows.append((i, before + value + frame.split("{}")[1] + " " + words(8)))
        expected[i] = f"{kind}:{len(before)}:{len(before) + len(value)}"
    return rows, expected


def test_planted_spans_are_found_and_clean_texts_left_alone(spark):
    rows, expected = corpus()
    got = {r["doc_id"]: r["spans"].split(",") for r in private.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(span in got[i] for i, span in expected.items())
    assert caught >= 0.95 * len(expected), [(rows[i][1], s, got[i]) for i, s in expected.items() if s not in got[i]][:8]
    flagged = [(rows[i][1], got[i]) for i, _ in rows if i not in expected and got[i] != [""]]
    assert not flagged, flagged[:8]


def test_own_lists_decide_on_names(spark):
    docs = spark.createDataFrame([(1, "we met Zorblat Quux there"), (2, "we met Maria Smith there")], "doc_id long, text string")
    lists = private.Gazetteer(given=("zorblat",), family=("quux",))
    got = dict(private.find_private(docs, lists).select("doc_id", "spans").collect())
    assert got == {1: "name:7:19", 2: ""}


def test_check_digits_of_accounts(spark):
    values = [("DE89 3704 0044 0532 0130 00", True), ("GB82WEST12345698765432", True), ("DE88 3704 0044 0532 0130 00", False)]
    got = spark.createDataFrame(values, "v string, ok boolean").select(private.mod97(private.F.col("v")), "ok").collect()
    assert all(a == b for a, b in got)


def test_many_matches_in_one_text_take_linear_steps(spark):
    n = 40_000
    text = " ".join(f"user{i}@example.org" for i in range(n))
    start = time.perf_counter()
    row = private.find_private(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_email"] == n and row["spans"].count("email:") == n
    assert row["spans"].split(",")[-1].endswith(f":{len(text)}")
    assert time.perf_counter() - start < 60


def test_runs_that_end_without_a_match_take_linear_steps(spark):
    start = time.perf_counter()
    texts = ["12 34 " * 200_000 + "56x", "Aa " * 300_000 + "x", "A." * 300_000, "AB12 CD34 " * 100_000, "1 Aa, " * 100_000, "password" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    assert private.candidates(docs).count() == 6
    assert [r["n_email"] for r in private.find_private(docs).collect()] == [0] * 6
    assert time.perf_counter() - start < 90


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None), (None, ""), (3, "a@b.c 😀 a@b.c"), (3, "a@b.c 😀 a@b.c")], "doc_id long, text string")
    got = sorted(r["spans"] for r in private.find_private(docs).collect())
    assert got == ["", "", "email:0:5,email:8:13", "email:0:5,email:8:13"]
    assert private.find_private(docs.limit(0)).count() == 0
