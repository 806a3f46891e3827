import random

from pyspark.sql import functions as F

from rollcall.functions.utf7 import decode_utf7

LETTERS = list("Ab9 ,;\"'-+/&~\\\t") + ["é", "ß", "Ω", "漢", "﻿", "😀", "𝄞", "\x00"]


def expected(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    try:
        text = raw.decode("utf-7")
        text.encode("utf-8")
    except UnicodeError:
        return None
    return text


def decoded(spark, raws):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw binary").repartition(4)
    return [r.text for r in rows.select("i", decode_utf7(F.col("raw")).alias("text")).orderBy("i").collect()]


def test_lines_decode_as_the_codec_does(spark):
    draw = random.Random(7)
    raws: list[bytes | None] = [None, b"", b"+", b"+-", b"+ ", b"a+", b"+-+-", b"++-", b"+AOk", b"+AOk-", b"+AOl-", b"+AO-",
                                b"+AOkA6Q-x", b"+AOk-b+AOk.", b"caf\xe9", b"+2D3eAA-", b"+2D0-", b"+3gA-", b"+AOkAAA-", b"+A", b"+AOk+"]
    for _ in range(1500):
        raws.append("".join(draw.choices(LETTERS, k=draw.randrange(0, 30))).encode("utf-7"))
    for _ in range(3000):
        raws.append("".join(draw.choices("AOkQgw4D2+-/ x", k=draw.randrange(0, 14))).encode())
    got = decoded(spark, raws)
    wrong = [(r, g, expected(r)) for r, g in zip(raws, got) if g != expected(r)]
    assert not wrong, wrong[:5]


def test_very_long_lines(spark):
    texts = ["é" * 200_000, "aé" * 100_000, "+" * 50_000, "x" * 1_000_000]
    assert decoded(spark, [t.encode("utf-7") for t in texts]) == texts
