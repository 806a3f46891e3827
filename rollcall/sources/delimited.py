"""Delimited text of unknown encoding and delimiter, read in splits.

Lines are read as raw bytes by Spark's text source, so one file of any size is
shared by many tasks. They are written once with their place; encoding,
delimiter and line numbers then come from aggregates over that table, and
decoding and splitting are built-in functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.constants import UTF7_PATTERN
from rollcall.functions.utf7 import decode_utf7
from rollcall.operators.lookup import Limits, is_small
from rollcall.sources.inputs import literal, plain_path
from rollcall.sources.staging import stage

# Delimiters in order of preference at equal counts: a comma may be a decimal mark.
DELIMITERS = ["\t", ";", "|", ","]
BYTE_ORDER_MARK = "\ufeff"
C1 = "".join(map(chr, range(0x80, 0xA0)))
# Bytes that the Windows code page leaves undefined follow from its codec.
CP1252_UNDEFINED = [b for b in range(0x80, 0xA0) if not bytes([b]).decode("cp1252", "ignore")]
CP1252 = "".join(bytes([ord(c)]).decode("cp1252", "ignore") or c for c in C1)


BLANKS = " \t\x0b\x0c\x00"
# Lines to a mask of bits.
WORD = 64
#: Longest record that is put together from lines; a file with a longer one is reported.
RECORD_BYTES = 256 * 1024 * 1024


def raw_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All lines with their file, split and rising number, written once.

    The number depends on how files are packed into tasks, so it is fixed in a
    table before anything is derived from it.
    """
    lines = spark.read.text([literal(p) for p in paths]).select(
        plain_path(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))).alias("plain"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("raw"),
    )
    blank = F.trim(latin1(), F.lit(BLANKS)) == ""
    return stage(lines.withColumns({"blank": blank, "n": F.monotonically_increasing_id()}), "lines")


def blocks(raw: DataFrame) -> DataFrame:
    """Lines of each split, those that are not blank, and how many of these its file has before it."""
    counted = raw.groupBy("plain", "block").agg(
        F.min("n").alias("first_n"), F.count(F.lit(1)).alias("n_all"), F.count_if(~F.col("blank")).alias("n_lines")
    )
    of_file = Window.partitionBy("plain").orderBy("block")
    before = of_file.rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumns(
        {"skip": F.coalesce(F.sum("n_lines").over(before), F.lit(0)), "opens": F.row_number().over(of_file) == 1}
    )


def placed(raw: DataFrame, where: DataFrame, small: bool) -> DataFrame:
    """Lines that are not blank with row_idx, their number among these in the file.

    Numbers rise by one within a split, so only splits with blank lines are sorted.
    """
    sent = F.broadcast(where) if small else where
    every = raw.join(sent, ["plain", "block"])
    full = every.where("n_all = n_lines").withColumn("row_idx", F.col("skip") + F.col("n") - F.col("first_n"))
    within = Window.partitionBy("plain", "block").orderBy("n")
    gaps = every.where("n_all > n_lines and not blank").withColumn(
        "row_idx", F.col("skip") + F.row_number().over(within) - 1
    )
    return full.unionByName(gaps)


def latin1() -> Column:
    return F.decode("raw", "ISO-8859-1")


def _outside_quotes(c: Column) -> Column:
    return F.when(F.contains(c, F.lit('"')), F.regexp_replace(c, '"[^"]*"', "")).otherwise(c)


QUOTED = '"[^"]*+(?:""[^"]*+)*+"'


def _mark(delimiter: str) -> str:
    return f"\\{delimiter}" if delimiter == "|" else delimiter


def opens(text: Column, delimiter: str) -> Column:
    """Whether a line that begins outside quotes ends inside them.

    A quote opens at the start of a cell only; the next one that is not doubled
    closes. Possessive patterns need no stack, however long a line is.
    """
    d = _mark(delimiter)
    # The quote comes first in the pattern, so that other characters are passed over quickly.
    left = F.regexp_replace(text, f'"(?<![^{d}]"){QUOTED[1:]}[^{d}]*+', "")

    def begins(c: Column) -> Column:
        return F.contains(F.concat(F.lit(delimiter), c), F.lit(f'{delimiter}"'))

    return begins(text) & begins(left)


def stays_open(text: Column, delimiter: str) -> Column:
    """Whether a line that begins inside quotes ends inside them."""
    d = _mark(delimiter)
    close = f'^[^"]*+(?:""[^"]*+)*+"[^{d}]*+'
    return ~text.rlike(close) | opens(F.regexp_replace(text, close, ""), delimiter)


def by_delimiter(make) -> Column:
    """``make`` for the delimiter of the row's file."""
    return reduce(lambda out, d: out.when(F.col("delimiter") == d, make(d)), DELIMITERS, F.when(F.lit(False), None))


def profile(lines: DataFrame) -> DataFrame:
    """Encoding and delimiter per file.

    UTF-8 if every line decodes, else the Windows code page if no line has a
    byte it leaves undefined, else Latin-1. A shift sequence in the first two
    lines makes it UTF-7 if every line decodes as such. The delimiter is the
    one found on most lines, then the most frequent.
    """
    undefined = "[" + "".join(f"\\x{{{b:x}}}" for b in CP1252_UNDEFINED) + "]"
    # Columns of their own: aggregates would look at a line anew for each count.
    told = lines.withColumn("latin", latin1())
    told = told.withColumns({"seen": _outside_quotes(F.col("latin")), "unmarked": _unmarked(F.col("latin"))})
    told = told.select(
        "plain",
        F.is_valid_utf8(F.col("raw").cast("string")).alias("utf8"),
        (~F.col("latin").rlike(undefined)).alias("cp1252"),
        ((F.col("row_idx") < 2) & F.col("latin").rlike(UTF7_PATTERN)).alias("shifted"),
        *(opens(F.col("unmarked"), d).alias(f"open{i}") for i, d in enumerate(DELIMITERS)),
        *(
            (F.length("seen") - F.length(F.replace(F.col("seen"), F.lit(d), F.lit("")))).alias(f"of{i}")
            for i, d in enumerate(DELIMITERS)
        ),
    )
    each = range(len(DELIMITERS))
    per_file = told.groupBy("plain").agg(
        F.bool_and("utf8").alias("utf8"), F.bool_and("cp1252").alias("cp1252"), F.bool_or("shifted").alias("shifted"),
        *(F.bool_or(f"open{i}").alias(f"open{i}") for i in each),
        *(F.count_if(F.col(f"of{i}") > 0).alias(f"on{i}") for i in each),
        *(F.sum(f"of{i}").alias(f"of{i}") for i in each),
    )
    ranked = F.array(
        *(
            F.struct(F.col(f"on{i}").alias("lines"), F.col(f"of{i}").alias("total"), F.lit(-i).alias("rank"),
                     F.lit(d).alias("delimiter"), F.col(f"open{i}").alias("opens"))
            for i, d in enumerate(DELIMITERS)
        )
    )
    best = F.array_max(ranked)
    found = best["lines"] > 0
    comma = DELIMITERS.index(",")
    return per_file.select(
        "plain",
        F.when(F.col("utf8"), "utf-8").when(F.col("cp1252"), "cp1252").otherwise("latin-1").alias("encoding"),
        F.when(found, best["delimiter"]).otherwise(",").alias("delimiter"),
        "shifted",
        # UTF-7 may hide quotes in shift sequences.
        (F.when(found, best["opens"]).otherwise(F.col(f"open{comma}")) | F.col("shifted")).alias("open_quote"),
    )


def _unmarked(text: Column) -> Column:
    """Without the bytes of a byte order mark, which may stand before a quote."""
    return F.regexp_replace(text, "^\u00ef\u00bb\u00bf", "")


def with_utf7(lines: DataFrame, profiles: DataFrame) -> DataFrame:
    """Turn shifted files into UTF-7 where every line decodes; others stay."""
    shifted = profiles.where("shifted").select("plain")
    if shifted.isEmpty():
        return profiles
    decodes = (
        lines.join(shifted, "plain", "left_semi")
        .select("plain", decode_utf7(F.col("raw")).alias("text"))
        .groupBy("plain")
        .agg(F.bool_and(F.col("text").isNotNull()).alias("is_utf7"))
    )
    utf7 = F.coalesce("is_utf7", F.lit(False))
    return profiles.join(decodes, "plain", "left").withColumn(
        "encoding", F.when(utf7, "utf-7").otherwise(F.col("encoding"))
    ).drop("is_utf7")


def decoded(lines: DataFrame) -> DataFrame:
    """Text of each line by the encoding of its file."""
    text = (
        F.when(F.col("encoding") == "utf-8", F.col("raw").cast("string"))
        .when(F.col("encoding") == "cp1252", F.translate(latin1(), C1, CP1252))
        .when(F.col("encoding") == "latin-1", latin1())
        .when(F.col("encoding") == "utf-7", decode_utf7(F.col("raw")))
    )
    text = F.when(F.col("row_idx") == 0, F.ltrim(text, F.lit(BYTE_ORDER_MARK))).otherwise(text)
    return lines.withColumn("text", text)


def split_line(text: Column | str, delimiter: Column | str) -> Column:
    """Cells of one record: quoted cells may hold delimiters, breaks and doubled quotes."""
    out = None
    for d in DELIMITERS:
        p = _mark(d)
        cell = f"{p}({QUOTED}[^{p}]*+|[^{p}]*+)"
        cells = F.regexp_extract_all(F.concat(F.lit(d), text), F.lit(cell), F.lit(1))
        here = F.col(delimiter) == d if isinstance(delimiter, str) else delimiter == d
        out = F.when(here, cells) if out is None else out.when(here, cells)

    def unquote(c: Column) -> Column:
        # A quote that never closes is part of the text.
        body = F.regexp_extract(c, f"(?s)^({QUOTED})", 1)
        inner = F.replace(F.substring(body, F.lit(2), F.length(body) - 2), F.lit('""'), F.lit('"'))
        rest = F.substring(c, F.length(body) + 1, F.length(c))
        return F.when(body != "", F.concat(inner, rest)).otherwise(c)

    quoted = F.contains(F.col(text) if isinstance(text, str) else text, F.lit('"'))
    return F.when(quoted, F.transform(out, unquote)).otherwise(out)


def _bit(k: Column | str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(k) if isinstance(k, str) else k)


def _below(k: Column) -> Column:
    """All bits below bit ``k``."""
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), k))


def _has(mask: Column | str, k: Column | str) -> Column:
    """Bit ``k`` of a mask, 0 or 1."""
    mask, k = (F.col(c) if isinstance(c, str) else c for c in (mask, k))
    return F.call_function("shiftrightunsigned", mask, k).bitwiseAND(F.lit(1).cast("bigint"))


def _in_word(lines: DataFrame) -> DataFrame:
    """Lines with their word, 64 numbers in a row, and their bit in it."""
    return lines.withColumns(
        {"word": F.shiftright("n", 6), "k": F.col("n").bitwiseAND(F.lit(WORD - 1)).cast("int")}
    )


def _through(start: int) -> Column:
    """From one state before a word: the lines of it that begin inside quotes, and the state after it."""
    zero = F.struct(F.lit(0).cast("bigint").alias("inside"), F.lit(start).cast("bigint").alias("state"))

    def step(seen: Column, k: Column) -> Column:
        inside = seen["state"] == 1
        return F.struct(
            F.when(inside, seen["inside"].bitwiseOR(_bit(k))).otherwise(seen["inside"]).alias("inside"),
            F.when(inside, _has("open1", k)).otherwise(_has("open0", k)).alias("state"),
        )

    same = F.struct(F.lit(-start).cast("bigint").alias("inside"), F.lit(start).cast("bigint").alias("state"))
    calm = (F.col("open0") == 0) & (F.lit(start == 0) | (F.col("open1") == -1))
    return F.when(calm, same).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(WORD - 1)), zero, step))


def _words(lines: DataFrame, small: bool) -> DataFrame:
    """Per word, one bit for each line: present, blank, and the state it ends in from either state.

    A quote that no later line of the file closes opens nothing.
    """
    flags = {
        "present": F.lit(True),
        "blank": F.col("blank"),
        "open0": by_delimiter(lambda d: opens(F.col("text"), d)),
        "open1": by_delimiter(lambda d: stays_open(F.col("text"), d)),
    }
    none = F.lit(0).cast("bigint")
    words = _in_word(lines).groupBy("plain", "block", "word").agg(
        F.min("n").alias("first_n"),
        *(F.bit_or(F.when(c, _bit("k")).otherwise(none)).alias(name) for name, c in flags.items()),
    )
    # Several aggregates and joins read the masks, each of other columns: the text is looked at once.
    words = stage(words, "masks")
    words = words.withColumn("shuts", F.col("present").bitwiseAND(F.bitwise_not("open1")))
    highest = F.length(F.bin("shuts")) - 1
    last = words.where("shuts <> 0").groupBy("plain").agg(F.max(F.struct("block", "word", highest.alias("k"))).alias("last"))
    if small:
        words = words.join(F.broadcast(last), "plain", "left")
    else:
        ends = words.select("plain", "block").distinct().join(last, "plain", "left")
        words = words.join(ends, ["plain", "block"])
    place, end = F.struct("block", "word"), F.struct("last.block", "last.word")
    closed = (
        F.when(place < end, F.col("open0"))
        .when(place == end, F.col("open0").bitwiseAND(_below(F.col("last.k"))))
        .otherwise(none)
    )
    # Numbers that are not lines of this split change nothing.
    return words.withColumns(
        {"open0": closed, "open1": F.col("open1").bitwiseOR(F.bitwise_not("present"))}
    ).drop("shuts", "last")


def numbered_words(lines: DataFrame, small: bool) -> DataFrame:
    """Words with masks of their lines: ``inside`` quotes at their beginning, ``begun`` a
    record, left ``open`` by it; ``base`` counts the records of the file before the word.

    A line maps the state it begins in, inside quotes or outside, to the one it
    ends in: it keeps it, turns it round, or fixes it. So does a word, and a split. The
    state before a unit is that of the last one that fixed it, turned round as often as
    units since then do so: within each split over words, then over the splits of a
    file. Only masks are shuffled, never text: a word is some 50 bytes.
    """
    words = _words(lines, small)
    words = words.withColumns({"from0": _through(0), "from1": _through(1)})
    end0, end1 = F.col("from0.state"), F.col("from1.state")
    words = words.withColumns(
        {"turn": ((end0 == 1) & (end1 == 0)).cast("int"), "fix": F.when(end0 == end1, end0)}
    )
    of_split = Window.partitionBy("plain", "block").orderBy("word")
    upto, before = (of_split.rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    words = words.withColumn("turns", F.sum("turn").over(upto))
    mark = F.when(F.col("fix").isNotNull(), F.struct("fix", "turns"))
    words = words.withColumn("fixed", F.last(mark, ignorenulls=True).over(before))
    # What a whole split does to the state.
    done = words.groupBy("plain", "block").agg(
        F.sum("turn").alias("all_turns"), F.max(F.when(mark.isNotNull(), F.struct("word", "fix", "turns"))).alias("end")
    ).withColumns(
        {
            "s_fix": F.when(F.col("end").isNotNull(), (F.col("end.fix") + F.col("all_turns") - F.col("end.turns")) % 2),
            "s_turn": F.when(F.col("end").isNull(), F.col("all_turns") % 2).otherwise(0),
        }
    )
    of_file = Window.partitionBy("plain").orderBy("block")
    file_upto, file_before = (of_file.rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    done = done.withColumn("s_turns", F.sum("s_turn").over(file_upto))
    s_mark = F.when(F.col("s_fix").isNotNull(), F.struct("s_fix", "s_turns"))
    done = done.withColumn("s_fixed", F.last(s_mark, ignorenulls=True).over(file_before))
    turned = F.col("s_turns") - F.col("s_turn")
    start = F.coalesce(F.col("s_fixed.s_fix") + turned - F.col("s_fixed.s_turns"), turned) % 2
    words = words.join(done.select("plain", "block", start.alias("start")), ["plain", "block"])
    turned = F.col("turns") - F.col("turn")
    state = F.coalesce(F.col("fixed.fix") + turned - F.col("fixed.turns"), F.col("start") + turned) % 2
    inside = F.when(state == 1, F.col("from1.inside")).otherwise(F.col("from0.inside"))
    words = words.withColumn("inside", inside.bitwiseAND(F.col("present")))
    outside = F.col("present").bitwiseAND(F.bitwise_not("inside"))
    words = words.withColumns(
        {"begun": outside.bitwiseAND(F.bitwise_not("blank")), "open": outside.bitwiseAND(F.col("open0"))}
    )
    begun = F.bit_count("begun").cast("bigint")
    counts = words.groupBy("plain", "block").agg(F.sum(begun).alias("in_split")).withColumn(
        "earlier", F.coalesce(F.sum("in_split").over(file_before), F.lit(0))
    )
    words = words.join(counts.drop("in_split"), ["plain", "block"])
    base = F.col("earlier") + F.coalesce(F.sum(begun).over(before), F.lit(0))
    return words.select("plain", "block", "word", "first_n", "present", "inside", "begun", "open", base.alias("base"))


def records(
    lines: DataFrame, limits: Limits, small: bool, splits_small: bool, record_bytes: int
) -> tuple[DataFrame, DataFrame]:
    """Records of files with open quotes as (plain, delimiter, row_idx, text), and files given up.

    Lines that are a record of their own go straight on; only those of records with
    breaks are grouped. A record of over ``record_bytes`` bytes is not collected:
    its file is reported and counts for nothing.
    """
    words = stage(numbered_words(lines, small), "words")
    splits = words.groupBy("plain", "block").agg(
        F.min("first_n").alias("first_n"), F.min("base").alias("base"),
        F.bool_and((F.col("begun") == F.col("present")) & (F.col("open") == 0)).alias("straight"),
    )
    splits = stage(splits, "splits")
    every = lines.join(F.broadcast(splits) if splits_small else splits, ["plain", "block"])
    straight = every.where("straight").withColumn("row_idx", F.col("base") + F.col("n") - F.col("first_n"))
    told = words.join(splits.where("not straight").select("plain", "block"), ["plain", "block"], "left_semi")
    told = told.drop("first_n", "present")
    told = F.broadcast(told) if is_small(told, limits) else told
    rest = _in_word(every.where("not straight").drop("base", "first_n")).join(told, ["plain", "block", "word"])
    until = _below(F.col("k")).bitwiseOR(_bit("k"))
    rest = rest.withColumn("row_idx", F.col("base") + F.bit_count(F.col("begun").bitwiseAND(until)) - 1)
    alone = (_has("begun", "k") == 1) & (_has("open", "k") == 0)
    parts = rest.where((_has("inside", "k") == 1) | (_has("open", "k") == 1))
    sizes = parts.groupBy("plain", "row_idx").agg(F.sum(F.octet_length("raw") + 1).alias("size"))
    failed = sizes.where(F.col("size") > record_bytes).select("plain").distinct()
    failed = stage(failed.withColumn("error", F.lit(f"a record of over {record_bytes} bytes")), "too_long")
    if failed.isEmpty():
        return _records_of(straight, rest.where(alone), parts), failed
    known = F.broadcast(failed) if is_small(failed, limits) else failed
    good = [t.join(known.select("plain"), "plain", "left_anti") for t in (straight, rest.where(alone), parts)]
    return _records_of(*good), failed


def _records_of(straight: DataFrame, alone: DataFrame, parts: DataFrame) -> DataFrame:
    columns = ["plain", "delimiter", "row_idx", "text"]
    joined = (
        parts.groupBy("plain", "delimiter", "row_idx")
        .agg(F.array_sort(F.collect_list(F.struct("block", "n", "text"))).alias("parts"))
        .select("plain", "delimiter", "row_idx", F.array_join("parts.text", "\n").alias("text"))
    )
    return straight.select(*columns).unionByName(alone.select(*columns)).unionByName(joined)


def scan_delimited(
    spark: SparkSession, paths: list[str], limits: Limits = Limits(), record_bytes: int = RECORD_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Records as (plain, row_idx, cells), and (plain, error) for files that are given up."""
    raw = raw_lines(spark, paths)
    where = stage(blocks(raw), "blocks")
    few = is_small(where, limits)
    lines = placed(raw, where, few)
    profiles = stage(with_utf7(lines, profile(lines)), "profiles")
    small = is_small(profiles, limits)
    any_open = profiles.agg(F.bool_or("open_quote")).first()[0]
    # What is known of a file goes to its splits first, so that no file is one key of the lines.
    where = stage(where.join(F.broadcast(profiles) if small else profiles, "plain"), "split_profiles")
    few = is_small(where, limits)
    plain = placed(raw, where.where(~F.col("open_quote")), few)
    text = decoded(plain).select("plain", "delimiter", "row_idx", "text")
    errors = spark.createDataFrame([], "plain string, error string")
    if any_open:
        first = F.col("opens") & (F.col("n") == F.col("first_n"))
        told = where.where("open_quote")
        every = raw.join(F.broadcast(told) if few else told, ["plain", "block"]).withColumn("row_idx", F.when(first, 0).otherwise(1))
        every = decoded(every).select("plain", "block", "n", "blank", "raw", "delimiter", "text")
        quoted, errors = records(every, limits, small, few, record_bytes)
        text = text.unionByName(quoted.withColumn("row_idx", F.col("row_idx").cast("bigint")))
    return text.select("plain", "row_idx", split_line("text", "delimiter").alias("cells")), errors
