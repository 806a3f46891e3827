"""Pseudonyms of numbers with ranges, against a permutation written in plain Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from rollcall.llm import pii


def permuted(a, b, size_a, size_b, key, kind):
    for i in range(pii.ROUNDS):
        text = "|".join([key, kind, str(i), str(size_a * 7 + size_b), str(b)])
        drawn = int(hashlib.sha256(text.encode()).hexdigest()[:12], 16)
        a, b = b, (a + drawn) % (size_a if i % 2 == 0 else size_b)
    return a, b


def ssn(text, key):
    areas = [n for n in range(1, 900) if n != 666]
    area, group, serial = map(int, text.split("-"))
    a, b = permuted(areas.index(area), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    return f"{areas[a]:03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"


def phone(digits, key):
    a, b = permuted(int(digits[:3]) - 200, int(digits[3:]) - 2_000_000, 800, 8_000_000, key, "local")
    return f"{a + 200}{b + 2_000_000:07}"


def masked(spark, texts, key):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.o for r in rows.select("i", pii.pseudonymise(F.col("t"), key).alias("o")).orderBy("i").collect()]


def test_numbers_stay_in_their_ranges(spark):
    draw = random.Random(5)
    areas = [1, 665, 667, 899] + [draw.choice([n for n in range(1, 900) if n != 666]) for _ in range(600)]
    ssns = [f"{a:03}-{draw.choice([1, 99, draw.randint(1, 99)]):02}-{draw.choice([1, 9999, draw.randint(1, 9999)]):04}" for a in areas]
    got = masked(spark, ssns, "k")
    assert got == [ssn(s, "k") for s in ssns]
    assert all(re.fullmatch(pii.KINDS["ssn"], g) for g in got)
    assert len(set(got)) == len(set(ssns)) and masked(spark, ssns[:50], "other") != got[:50]
    numbers = ["2002000000", "9999999999"] + [f"{draw.randint(200, 999)}{draw.randint(200, 999)}{draw.randint(0, 9999):04}" for _ in range(600)]
    shapes = ["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]
    texts = [shapes[i % 4].format(n[:3], n[3:6], n[6:]) for i, n in enumerate(numbers)]
    got = masked(spark, texts, "k")
    wanted = [phone(n, "k") for n in numbers]
    assert got == [shapes[i % 4].format(n[:3], n[3:6], n[6:]) for i, n in enumerate(wanted)]
    assert all(re.fullmatch(pii.KINDS["phone"], g) for g in got)
