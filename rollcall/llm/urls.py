"""URL filter by rules and a character language model (operator 9), built-in functions only.

Two variable-order Markov models over the characters of host and path, one of
accepted and one of rejected URLs, are counted over all URLs. Orders are mixed by
how many different characters follow a context (Witten-Bell), so a context seen
rarely leans on its shorter form. A URL's score is the difference of the two
log-likelihoods by character; it is blocked above a threshold that a part of the
URLs, kept out of the counts, sets.

Which URLs teach which model: those with one of ``terms`` among the words of the
host are rejected, the others accepted. The characters are 32 classes, so the
models of ``order`` 2 have 32^3 cells, however many URLs there are; that many
numbers reach the driver and go into the plan as one constant array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.tables import narrow, stage

#: Rules (verdict, host and path); the longest that fits wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words of a host that mark a URL as rejected when the models are taught.
TERMS = (
    "ads", "adult", "bet", "bets", "betting", "casino", "cheap", "click", "escort", "free", "gambling", "jackpot",
    "loans", "pharma", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "track", "viagra", "xxx",
)
ORDER = 2
LETTERS = "abcdefghijklmnopqrstuvwxyz0./-"
_SIZE = 32
_OTHER, _EDGE = len(LETTERS), _SIZE - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as a struct ``(rule, verdict)``; null if none does.

    A rule fits its host and all subdomains where the path starts with the rule's.
    The list travels in the plan, so it is meant for up to some hundred rules.
    """
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    # The last one in this order wins ties: the same text twice is the first rule given.
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def _grams(text: Column, order: int) -> Column:
    """Cell of each character with the ``order`` characters before it."""
    plain = F.translate(text, _UPPER + "123456789", _LOWER + "0" * 9)
    place = lambda c: F.instr(F.lit(LETTERS), c)
    codes = F.transform(
        F.filter(F.split(plain, ""), lambda c: c != ""),
        lambda c: F.when(place(c) > 0, place(c) - 1).otherwise(F.lit(_OTHER)),
    )
    codes = F.concat(F.array_repeat(F.lit(_EDGE), order), codes, F.array(F.lit(_EDGE)))
    cells = codes
    for k in range(1, order + 1):
        cells = F.zip_with(cells, F.slice(codes, k + 1, F.size(codes)), lambda x, y: x * _SIZE + y)
    return F.filter(cells, lambda c: c.isNotNull())


def _chances(counts: DataFrame, order: int) -> DataFrame:
    """``rejected, cell, chance``: log-probability of every cell under both models."""
    spark = counts.sparkSession
    below = None
    for k in range(order + 1):
        size = _SIZE ** (k + 1)
        seen = counts.groupBy("rejected", F.pmod("cell", F.lit(size)).alias("cell")).agg(F.sum("n").alias("n"))
        context = F.floor(F.col("cell") / _SIZE).cast("long")
        total = seen.groupBy("rejected", context.alias("context")).agg(
            F.sum("n").alias("total"), F.count("*").alias("kinds")
        )
        grid = spark.range(size).select(F.col("id").alias("cell"), F.explode(F.array(F.lit(False), F.lit(True))).alias("rejected"))
        grid = grid.withColumn("context", context).join(seen, ["rejected", "cell"], "left").join(
            total, ["rejected", "context"], "left"
        )
        if below is None:
            grid = grid.withColumn("rest", F.lit(1.0 / _SIZE))
        else:
            grid = grid.withColumn("short", F.pmod("cell", F.lit(size // _SIZE))).join(
                below.withColumnsRenamed({"cell": "short", "chance": "rest"}), ["rejected", "short"]
            )
        kinds = F.coalesce("kinds", F.lit(1))
        below = grid.select(
            "rejected", "cell",
            ((F.coalesce("n", F.lit(0)) + kinds * F.col("rest")) / (F.coalesce("total", F.lit(0)) + kinds)).alias("chance"),
        )
    return below


def language_models(urls: DataFrame, order: int = ORDER) -> Column:
    """The log-ratio of rejected to accepted by cell, as a constant array.

    ``urls`` has ``text`` and ``rejected``. The array has 32^(order + 1) entries;
    without examples of a kind its model is uniform.
    """
    counts = urls.select("rejected", F.explode(_grams(F.col("text"), order)).alias("cell")).groupBy(
        "rejected", "cell"
    ).agg(F.count("*").alias("n"))
    counts = stage(counts, "url_counts")
    sign = F.when(F.col("rejected"), F.log("chance")).otherwise(-F.log("chance"))
    cells = _chances(counts, order).groupBy("cell").agg(F.sum(sign).alias("ratio")).orderBy("cell")
    ratio = ",".join(f"{r['ratio']:.4f}" for r in cells.collect())
    return F.split(F.lit(ratio), ",").cast("array<float>")


def score(text: Column, ratio: Column, order: int = ORDER) -> Column:
    """Mean log-ratio by character (the end counts as one)."""
    cells = _grams(text, order)
    return F.aggregate(cells, F.lit(0.0), lambda s, c: s + F.element_at(ratio, c + 1)) / F.size(cells)


def threshold(scores: DataFrame, kept: float = 0.995) -> DataFrame:
    """One row ``least``: URLs that score above it are blocked.

    ``scores`` has ``score`` and ``rejected`` of URLs the models haven't seen. Of
    all limits that let at least the share ``kept`` of accepted URLs pass, the one
    that separates best; if there is none, or no rejected example, the limit is
    infinite and none blocks. Scores are
    counted in steps of a hundredth, some thousand at most.
    """
    step = F.round("score", 2).alias("step")
    bins = scores.groupBy(step).agg(
        F.sum(F.col("rejected").cast("long")).alias("bad"), F.sum((~F.col("rejected")).cast("long")).alias("good")
    )
    up = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = bins.select(
        "step",
        (F.sum("good").over(up) / F.greatest(F.sum("good").over(every), F.lit(1))).alias("pass"),
        (1 - F.sum("bad").over(up) / F.nullif(F.sum("bad").over(every), F.lit(0))).alias("caught"),
        F.coalesce(F.lead("step").over(Window.orderBy("step")), F.col("step")).alias("next"),
    ).filter((F.col("pass") >= kept) & (F.col("caught") > 0))
    best = F.max_by((F.col("step") + F.col("next")) / 2, F.struct(F.col("pass") + F.col("caught"), "step"))
    return runs.agg(F.coalesce(best, F.lit(float("inf"))).alias("least"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES,
          terms: tuple[str, ...] = TERMS, order: int = ORDER, kept: float = 0.995) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every URL, one row per input row.

    The verdict is the longest fitting rule's, else the models'. Null URLs and
    those without ``://`` have an empty host and path and are allowed unless a rule
    says otherwise. Null and repeated ids pass through; extra columns are dropped;
    an empty table gives an empty result.
    """
    src = narrow(pages, page_id=id_col, url=url_col)
    src = src.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    text = F.concat("host", "path")
    taught = src.filter(text != "").select(
        text.alias("text"),
        F.arrays_overlap(F.split("host", "[^a-z0-9]+"), F.array(*map(F.lit, terms))).alias("rejected"),
        (F.pmod(F.xxhash64(text), F.lit(5)) == 0).alias("apart"),
    )
    # Several URLs with one text say no more than one; a hot page counts once.
    taught = stage(taught.distinct(), "urls")
    ratio = language_models(taught.filter(~F.col("apart")), order)
    apart = taught.filter("apart").select("rejected", score(F.col("text"), ratio, order).alias("score"))
    least = threshold(apart, kept).first()["least"]
    judged = src.select(
        "page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("found"),
        F.when(text != "", score(text, ratio, order)).alias("score"),
    )
    by_model = F.when(F.coalesce(F.col("score") > least, F.lit(False)), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), by_model).alias("verdict"), "score",
    )
