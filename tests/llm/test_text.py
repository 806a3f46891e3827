"""Pseudonyms, URL filter and chat formatting."""

import hashlib
import re

from pyspark.sql import functions as F

from rollcall.llm import chat, pii, urls
from rollcall.llm.queries import CHAT_EXTRA

PII = "Mail ab.cd@mail1.example.com, call +1 (743) 555-3824. IP 227.5.221.1; card 4111 1111 1111 1111 on 2020-02-29, IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789!"


def masked(spark, texts, key="k"):
    rows = [(i, t) for i, t in enumerate(texts)]
    out = pii.mask_documents(spark.createDataFrame(rows, "doc_id long, text string"), key).collect()
    return [r["text"] for r in sorted(out, key=lambda r: r["doc_id"])]


def luhn(text):
    d = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def test_pseudonyms_keep_the_format(spark):
    one, two, other = masked(spark, [PII, "x " + PII, None])[:2] + masked(spark, [PII], "other")
    assert two == "x " + one and other != one
    assert re.sub(r"[0-9]", "9", one.split(",", 1)[1]) == re.sub(r"[0-9]", "9", PII.split(",", 1)[1]) or "IP" in one
    for secret in ("ab.cd@mail1", "743) 555-3824", "227.5.221.1", "4111 1111 1111 1111", "2020-02-29", "3704 0044", "123-45-6789"):
        assert secret not in one
    card = re.search(r"card ([0-9 ]{19})", one)[1]
    assert luhn(card) % 10 == 0 and [len(x) for x in card.split()] == [4, 4, 4, 4]
    code = re.search(r"IBAN ([A-Z0-9 ]+),", one)[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1
    assert all(int(x) < 256 for x in re.search(r"IP ([0-9.]+);", one)[1].split("."))
    assert re.search(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}\.", one)


def test_invalid_numbers_and_clean_texts_stay(spark):
    clean = ["card 4111111111111112", "2021-02-29 31.02.2020 2020-13-01", "300.1.1.1 1.2.3.4.5", "IBAN DE88 3704 0044 0532 0130 00",
             "ssn 000-12-3456", "a 12-34 @x x@ 3.14 v1.2", "", None, "né\n\t  ok "]
    assert masked(spark, clean) == clean


def test_same_value_in_any_form_is_linked(spark):
    a, b = masked(spark, ["4111-1111-1111-1111", "no. 4111111111111111."])
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "4" + "1" * 15


def test_numbers_beside_others(spark):
    card, iban, phones = "4111 1111 1111 1111", "BE68 5390 0754 7034", ("415-555-2671", "415-555-2672")
    alone = dict(zip((card, iban, *phones, "378282246310005"), masked(spark, [card, iban, *phones, "378282246310005"]), strict=True))
    assert all(k != v for k, v in alone.items())
    around = ["{} 12/27", "{} 123", "3 {}", "12 {} 7", "{} IS", "NO {} 12 AB", "{}, 2020", "id 77 {} 4111 1111 1111 1112"]
    texts = [(form, x) for form in around for x in (card, iban, "378282246310005")]
    for (form, x), got in zip(texts, masked(spark, [form.format(x) for form, x in texts]), strict=True):
        assert got == form.format(alone[x])
    mixed = [f"{phones[0]} {phones[1]}", f"{phones[0]} {card}", f"{card} {phones[1]}", f"{iban} {card}", f"{card} {iban} OK", f"{card} {card}"]
    wanted = [m.replace(card, alone[card]).replace(iban, alone[iban]).replace(phones[1], alone[phones[1]]).replace(phones[0], alone[phones[0]])
              for m in mixed]
    assert masked(spark, mixed) == wanted
    got = masked(spark, [f"+1 415 555 2671 {card}", f"+44 20 7946 0958 {card}", "+44 20 7946 0958 2020-02-29", "+44 20 7946 0958 1.2.3.4", f"+44 20 7946 0958 {card} 9"])
    for text, one in zip((alone[card], alone[card], masked(spark, ["2020-02-29"])[0], masked(spark, ["1.2.3.4"])[0], alone[card] + " 9"), got, strict=True):
        assert one.endswith(text) and "7946 0958" not in one and "555 2671" not in one
    odd = "411111 1111111111"
    assert masked(spark, [odd])[0] != odd and luhn(masked(spark, [odd])[0]) % 10 == 0


def test_permutation_is_one_to_one(spark):
    df = spark.range(10000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("d"))
    out = df.select(pii.permute_digits(F.col("d"), "k", "t").alias("p"))
    assert out.distinct().count() == 10000 and out.filter("length(p) <> 4").count() == 0
    days = spark.range(73049).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    assert days.select(pii._date(F.col("d"), "k").alias("p")).distinct().count() == 73049


def test_mask_keeps_rows_and_columns(spark):
    rows = [(1, "a@b.example", "x"), (1, "a@b.example", "x"), (None, None, None), (2, "word " * 50000 + "1.2.3.4", "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _new string")
    out = pii.mask_documents(docs, "k")
    assert out.schema == docs.schema and out.count() == 4 and pii.mask_documents(docs.limit(0), "k").count() == 0
    assert "1.2.3.4" not in out.filter("_new = 'long'").first()["text"]
    assert {r["kind"] for r in pii.findings(docs).collect()} == {"email", "ip"}


URLS = [
    (1, "http://A.Example.NET/en/1?x#y"), (2, "https://x.example.net/de"), (3, "ftp://example.com/de/9"), (4, "q.org/fr/"),
    (5, "http://q.org/fr/2"), (6, None), (7, ""), (8, "http://"), (9, "http://net?x=http://a/"), (10, "http://www.casino-win.example.com/a/1"),
    (11, "http://notnet/"), (12, "http://www.casino-win.example.com/a/1"), (12, "http://www.casino-win.example.com/a/1"), (None, "x://y.net/"),
]


def test_urls(spark):
    more = [(100 + i, f"http://blog{i % 7}.example.com/en/{i}") for i in range(200)]
    more += [(400 + i, f"http://www.cheap-pills{i % 3}.example.com/en/{i}") for i in range(40)]
    df = spark.createDataFrame([(i, u, "z") for i, u in URLS + more], "page_id long, url string, host string")
    out = {r["page_id"]: r for r in urls.judge(df).collect()}
    assert urls.judge(df).count() == len(URLS + more)
    want = {1: ("a.example.net", "/en/1", "example.net/en/", "allow"), 2: ("x.example.net", "/de", "net/", "block"),
            3: ("example.com", "/de/9", "example.com/de/", "block"), 4: ("", "", None, "allow"), 5: ("q.org", "/fr/2", "org/fr/", "allow"),
            6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("net", "", None, None),
            10: ("www.casino-win.example.com", "/a/1", None, "block"), 11: ("notnet", "/", None, None), None: ("y.net", "/", "net/", "block")}
    for i, (host, path, rule, verdict) in want.items():
        r = out[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r
        assert verdict is None or r["verdict"] == verdict, r
    assert {out[i]["verdict"] for i, u in more if "blog" in u} == {"allow"}
    assert {out[i]["verdict"] for i, u in more if "pills" in u} == {"block"}
    assert urls.judge(df.limit(0)).count() == 0


def test_no_limit_without_rejected_examples_or_separation(spark):
    clean = spark.createDataFrame([(i, f"http://blog{i % 7}.example.org/en/{i * i}") for i in range(150)], "page_id long, url string")
    assert urls.judge(clean, rules=()).filter("verdict = 'block'").count() == 0
    mixed = [(0.1 * i, False) for i in range(1, 50)] + [(-1.0, True)]
    for rows in (mixed, [r for r in mixed if not r[1]], []):
        assert urls.threshold(spark.createDataFrame(rows, "score double, rejected boolean")).first()["least"] == float("inf")


def test_url_models_sum_to_one(spark):
    taught = spark.createDataFrame([("a.b/c", False), ("pills.x/", True), ("a.b/d", False)], "text string, rejected boolean")
    counts = taught.select("rejected", F.explode(urls._grams(F.col("text"), 1)).alias("cell")).groupBy("rejected", "cell").agg(F.count("*").alias("n"))
    sums = urls._chances(counts, 1).groupBy("rejected", F.floor(F.col("cell") / 32)).agg(F.sum("chance").alias("s")).collect()
    assert len(sums) == 64 and all(abs(r["s"] - 1) < 1e-9 for r in sums)


def test_chat_round_trip(spark):
    odd = ["", None, "\\", "<|", "<|im_end|>\n<|im_start|>user\nx", "\\p<\\p\\s<", "a<", "|im_end|>", CHAT_EXTRA, "é😀\r\n", "long " * 20000]
    rows = [(1, i, ("user", "assistant")[i % 2], t, "x") for i, t in enumerate(odd)]
    rows += [(2, 1, "assistant", "first", ""), (2, 0, "user\n<|im_start|>", "role", ""), (2, None, None, "nullturn", ""), (3, 0, "user", "u", ""),
             (3, 0, "user", "u", ""), (3, 0, "assistant", "tie", ""), (None, 0, "system", "s", ""), (None, 1, "user", "q", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    out = chat.format_chats(df)
    back = out.select("conv_id", "valid", "first_bad", "n_turns", chat.parse(F.col("formatted")).alias("turns"),
                      chat.loss_text(F.col("segments")).alias("loss"), "formatted", "segments").collect()
    got = {r["conv_id"]: r for r in back}
    want: dict = {}
    for c, t, role, text, _ in rows:
        want.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c, turns in want.items():
        turns.sort()
        r = got[c]
        assert [(x["role"], x["text"]) for x in r["turns"]] == [(t[2], t[3]) for t in turns]
        assert r["loss"] == "".join(t[3] for t in turns if t[2] == "assistant")
        assert r["n_turns"] == len(turns) and r["formatted"].count("<|im_start|>") == len(turns)
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
    assert got[1]["valid"] and got[None]["valid"] and not got[2]["valid"] and got[2]["first_bad"] == 0
    assert not got[3]["valid"] and got[3]["first_bad"] == 0
    assert hashlib.sha256(got[1]["formatted"].encode()).hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0
