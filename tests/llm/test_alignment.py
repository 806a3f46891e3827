"""Fill-in-middle, token counts and alignment against the libraries and brute force."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import regex
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rollcall.llm import align, counts, fim
from rollcall.llm.bpe import byte_letters

ALPHABET = "ab  c'st' \n\t é中文1२٣½!?\x1c\x85 ́Σ😀ǅ.,\x00<>▁"


def texts():
    rng = random.Random(11)
    out = ["", " ", "a", "\n", "  two  spaces ", "it's\r\nso.\n\nNext<|endoftext|> x <|endoftext|>", "x" * 5000,
           "ab" * 9000 + " end", "<s>hi</s><unk> <0x41>", "a \nb", "\nb", "　x 　", "word, word. word.\nword" * 400]
    for k in range(300):
        s = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40)))
        out.append(s * (60 if k % 50 == 0 else 1))
    return out


def rows():
    return [(i, t, "x", -1) for i, t in enumerate(texts())] + [
        (3, "another text of id three", "y", 0), (3, "another text of id three", "y", 0), (None, "no id here", None, 0),
        (900, None, "z", 0), (901, "very long text, " * 60_000, "z", 0), (902, "<P> is a mark", "", 1)]


# ---- fill in the middle


def expected_fim(key, text):
    text = text or ""
    units, i = [], 0
    while i < len(text):
        j = i + 1
        if text[i].isascii() and text[i].isalpha():
            while j < len(text) and text[j].isascii() and text[j].isalpha():
                j += 1
        units.append(text[i:j])
        i = j
    digest = hashlib.sha256(("1:" + ("" if key is None else str(key))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return key, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return key, n, form, len(p), len(m), out


def test_fim_cuts_and_restores(spark):
    data = rows() + [(1000 + i, "one <S two> <<P x M> 3." + " w" * (i % 9), "", 0) for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string, output string, n int")
    cut = fim.transform(docs)
    back = cut.select("*", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    got = sorted((tuple(r)[:-1] for r in back), key=repr)
    assert got == sorted((expected_fim(i, t) for i, t, *_ in data), key=repr)
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}
    assert Counter(r["back"] for r in back) == Counter(t or "" for _, t, *_ in data)
    assert fim.transform(docs.limit(0)).count() == 0


def test_fim_needs_units_that_cover_texts():
    rules = fim.Rules(unit="[a-z]")
    with pytest.raises(ValueError):
        fim.transform_text(regex.compile(f"({rules.unit})*+"), "a b", 1, rules)


# ---- counts


def test_counts_are_the_librarys():
    own = counts.Counter(counts.default_model())
    library = sentencepiece.SentencePieceProcessor(model_file=counts.default_model())
    assert own.apart
    for text, got in zip(texts(), own.count(texts()), strict=True):
        assert got == len(library.encode(text)), repr(text)
    own.apart = False  # the same without units
    assert own.count(texts()) == [len(library.encode(t)) for t in texts()]


def test_counts_start_anew(monkeypatch):
    monkeypatch.setattr(counts, "KEPT", 3)
    own = counts.Counter(counts.default_model())
    assert own.count(texts()) == [len(own.model.encode(t)) for t in texts()]


def test_count_table(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, n_tokens string, over_limit int")
    library = sentencepiece.SentencePieceProcessor(model_file=counts.default_model())
    want = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, *_ in rows()]
    got = counts.count_tokens(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((*w, w[2] > 4096) for w in want), key=repr)
    assert any(r["over_limit"] for r in got)
    assert counts.count_tokens(docs.limit(0)).count() == 0


# ---- alignment


def test_gallop_finds_common_values():
    rng = random.Random(3)
    for _ in range(500):
        a, b = (sorted(rng.sample(range(60), rng.randint(1, 50))) for _ in range(2))
        want = [(a.index(x), b.index(x)) for x in sorted({*a} & {*b})]
        assert align.gallop(a, b) == want
    assert align.gallop([], [1]) == align.gallop([1], []) == []


class Brute:
    """Both encodings of whole texts by the libraries, and all pairs of tokens."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.letters = {c: b for b, c in byte_letters().items()}

    def tokens(self, text):
        if not text:
            return None
        raw = (" " + text).encode()
        a = self.a.encode(" " + text, add_special_tokens=False)
        b = self.b.encode(text)
        left = [bytes(self.letters[c] for c in t) for t in a.tokens]
        right = []
        for p in map(self.b.id_to_piece, b):
            right.append(bytes([int(p[3:5], 16)]) if regex.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode())
        if b"".join(left) != raw or b"".join(right) != raw:
            return None
        spans = []
        for ids, parts in ((a.ids, left), (b, right)):
            at = 0
            spans.append([])
            for i, t in zip(ids, parts, strict=True):
                at += len(t)
                spans[-1].append((i, at))
        return spans

    def run(self, data):
        docs, total = [], Counter()
        for key, text in data:
            spans = self.tokens(text)
            if spans is None:
                docs.append((key, None, None, None))
                continue
            a, b = spans
            at = {e: i for i, e in b}
            links = [(i, at[e]) for i, e in a if e in at]
            total.update(links)
            cuts, parts, begin = [e for _, e in a if e in at], [], 0
            ab = [[(i, e) for i, e in side] for side in spans]
            for c in cuts:
                parts.append("|".join(",".join(str(i) for i, e in side if begin < e <= c) for side in ab) if len(a) < 500 else "")
                begin = c
            docs.append((key, spans, links, ";".join(parts)))
        top: dict = {}
        for (_, b), n in total.items():
            top[b] = max(top.get(b, 0), n)
        out = []
        for key, spans, links, text in docs:
            if spans is None:
                out.append((key, 0, 0, 0, 0, 0, 0, ""))
                continue
            best = sum(total[p] == top[p[1]] for p in links)
            long = len(spans[0]) >= 500
            out.append((key, len(spans[0]), len(spans[1]), len(links), len(links), best, sum(total[p] for p in links),
                        None if long else hashlib.sha256(text.encode()).hexdigest()))
        return out


@pytest.mark.parametrize("piece, kept", [(2_000_000, 600_000), (50, 3)])
def test_alignment_is_that_of_all_pairs(spark, monkeypatch, piece, kept):
    data = [(i, t) for i, t, *_ in rows() if t is None or len(t) < 100_000]
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in data], "doc_id long, text string, n_a int, pairs string")
    monkeypatch.setattr(align, "PIECE", piece)
    monkeypatch.setattr(align, "KEPT", kept)
    own = align.Aligner(*align._paths(None, None))
    assert own.cut is not None
    want = Brute().run(data)
    if piece == 50:  # inside this process, as the settings do not reach workers
        for (_, t), w in zip(data, want, strict=True):
            units = own.align(t) if t else None
            assert sum(u.n_groups for u in units or []) == w[3]
            if w[7]:
                assert hashlib.sha256(";".join(u.text for u in units).encode()).hexdigest() == w[7]
        return
    got = sorted(map(tuple, align.align_documents(docs).collect()), key=repr)
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g[:7] == w[:7] and (w[7] is None or g[7] == w[7]), (g, w)
    assert sum(w[3] for w in want) > 1000 and any(w[7] == "" for w in want)


def test_alignment_bound_and_empty(spark):
    own = align.Aligner(*align._paths(None, None))
    assert own.pair_bound() < 500_000
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align.align_documents(docs).count() == 0 and align.groups(docs).count() == 0


def test_groups_cover_all_tokens(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, a_ends string, n_b int")
    brute = Brute()
    by = Counter()
    for r in align.groups(docs).collect():
        by[r["doc_id"], r["n_a"], r["n_b"], len(r["a_ends"])] += 1
        assert r["a_ends"][-1:] == ([r["n_a"]] if r["n_a"] else []) and r["b_ends"][-1:] == ([r["n_b"]] if r["n_b"] else [])
        assert r["a_ends"] == sorted(set(r["a_ends"])) and r["b_ends"] == sorted(set(r["b_ends"]))
    want = Counter()
    for i, t, *_ in rows():
        spans = brute.tokens(t)
        if spans is None:
            want[i, 0, 0, 0] += 1
        else:
            want[i, len(spans[0]), len(spans[1]), len({e for _, e in spans[0]} & {e for _, e in spans[1]})] += 1
    assert by == want
