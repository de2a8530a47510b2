"""Divergence rules, cross-tokenizer alignment and the source audit: brute force, odd inputs."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from deltadoc.llm import audit, crosstoken, divergence
from deltadoc.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, term string, block string, words string, pairs int"


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) among columns of names that the operators use inside."""
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], COLUMNS).repartition(3)


ODD = [
    (1, None, "en", "a"), (2, "", None, None), (3, "one two", "en", "a"), (3, "one two", "en", "a"), (None, "no id here", "en", None),
    (5, "ab " * 40000, "en", "b"), (6, "x" * 200000, "de", "b"), (7, "Straße İ 日本語 a\x00b 'tis don't\n\n a\n a \nb", "de", "a"), (8, "  two  blanks ", "", ""),
]


# 11: distribution divergence


def repeated(words, k=8):
    windows = collections.Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return len({j for i in range(len(words) - k + 1) if windows[tuple(words[i : i + k])] > 1 for j in range(i, i + k)})


def test_repeated_words_equal_a_scan(spark):
    rng = random.Random(5)
    lists = [[rng.choice("ab" if n % 3 else "abcdefgh") for _ in range(n)] for n in range(0, 60)]
    lists += [x + ["mid"] * k + x for k, x in enumerate([[str(rng.random()) for _ in range(n)] for n in range(5, 20)])]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, w array<string>").select("k", divergence.repeated_words(F.col("w")).alias("n"))
    assert {r.k: r.n for r in df.collect()} == {k: repeated(x) for k, x in enumerate(lists)}


def test_distance(spark):
    def plain(p, q):
        kl = lambda x, y: sum(a * math.log2(a / b) for a, b in zip(x, y) if a)
        m = [(a + b) / 2 for a, b in zip(p, q)]
        return math.sqrt((kl(p, m) + kl(q, m)) / 2)

    pairs = [([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.2, 0.3, 0.5], [0.1, 0.0, 0.9])]
    df = spark.createDataFrame(pairs, "p array<double>, q array<double>").select("p", divergence.distance(F.col("p"), F.col("q")).alias("d"))
    for r in df.collect():
        assert r.d == pytest.approx(plain(r.p, dict((tuple(a), b) for a, b in pairs)[tuple(r.p)]), abs=1e-9)


def test_base_measures_of_odd_rows(spark):
    got = divergence.judge(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    for r in got:
        texts = {t or "" for i, t, *_ in ODD if i == r.doc_id}
        assert len(texts) == 1
        text, words = next(iter(texts)), WORD.findall(next(iter(texts)))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated(words))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 20 or 100 * want[4] > 30 * len(words)) and r.kept == (not r.base_failed)


def test_foreign_and_symbol_texts_go_clean_ones_stay(spark):
    rng = random.Random(9)
    english = ["the", "of", "and", "to", "a", *[f"word{k}" if k % 50 == 0 else "".join(rng.choice("abcdefghij") for _ in range(6)) for k in range(500)]]
    text = lambda words, n: " ".join(rng.choice(words[:5]) if rng.random() < 0.35 else rng.choice(words[5:]) for _ in range(n))
    rows = [(k, text(english, 300), "en", "s") for k in range(60)]
    rows += [(100, " ".join(f"{rng.choice(english)}{rng.choice(['###', '$$$', '&&&'])}" for _ in range(300)), "en", "s")]
    rows += [(101, " ".join("".join(rng.choice("qwxyz") for _ in range(7)) for _ in range(300)), "en", "s")]
    rows += [(102, rows[100 - 40][1], None, "s"), (103, text(english, 30), "en", "s")]
    kept = {r.doc_id for r in divergence.judge(frame(spark, rows)).where("kept").collect()}
    assert kept == {*range(60), 102, 103}  # without a language or with few words there's no verdict by histograms


def test_no_rows(spark):
    none = frame(spark, ODD).limit(0)
    assert divergence.judge(none).count() == crosstoken.crosstoken(none).count() == audit.audit(none).count() == 0


# 12: cross-tokenizer alignment


class Plain:
    """Tokens, groups and links of a whole text by loops."""

    def __init__(self):
        import public_tokenizers as public
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public.path(crosstoken.BYTE_LEVEL))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public.path(crosstoken.PIECES))
        letters = crosstoken.byte_letters()
        self.bytes_a = {i: bytes(letters[c] for c in k) for k, i in self.a.get_vocab().items() if all(c in letters for c in k)}

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    def __call__(self, text):
        if not text:
            return 0, 0, 0, 0, "", {}
        tokens = [[(i, self.bytes_a[i]) for i in self.a.encode(f" {text}", add_special_tokens=False).ids], [(i, self.bytes_b(i)) for i in self.b.encode(text)]]
        if any(b"".join(x for _, x in side) != f" {text}".encode() for side in tokens):
            return 0, 0, 0, 0, "", {}
        spans = []
        for side in tokens:
            at = 0
            spans.append([])
            for i, x in side:
                spans[-1].append((at, at + len(x), i))
                at += len(x)
        a, b = spans
        cuts = sorted({y for _, y, _ in a} & {y for _, y, _ in b})
        at = {c: k for k, c in enumerate(cuts)}
        groups = [([], []) for _ in cuts]
        for side, own in enumerate(spans):
            k = 0
            for _, y, i in own:
                groups[k][side].append(str(i))
                k += y in at
        groups = ["|".join(map(",".join, g)) for g in groups]
        links, first = collections.Counter(), 0
        for x, y, i in a:
            while first < len(b) and b[first][1] <= x:
                first += 1
            k = first
            while k < len(b) and b[k][0] < y:
                links[i, b[k][2]] += 1
                k += 1
        return len(a), len(b), len(cuts), links.total(), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


@pytest.fixture(scope="module")
def plain():
    return Plain()


def test_pieces_align_as_whole_texts(plain):
    letters = ["a", "b", " ", "  ", "\n", "\t", "é", "'s", "<|endoftext|>", "<s>", "▁", "日本", "😀", "\x00", "\x85", "　", "\x1c", "1", "23", "!", "...", "<0x41>", "Straße", " \n", "don't", "İ"]
    rng = random.Random(2)
    of = crosstoken.Aligner(*[__import__("public_tokenizers").path(n) for n in (crosstoken.BYTE_LEVEL, crosstoken.PIECES)])
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        got = of(text)
        assert (*got[:5], {(p >> 32, p & 0xFFFFFFFF): n for p, n in zip(got[5].tolist(), got[6].tolist())}) == plain(text), text


def test_spans_of_a_long_text(plain, monkeypatch):
    monkeypatch.setattr(crosstoken, "_SPAN", 50)
    monkeypatch.setattr(crosstoken, "_CACHE_PIECES", 20)
    text = " ".join(f"word{k % 37} ä{k}" for k in range(300))
    texts = ["word1 word2", text, "word1 other", None, text[:120], "", "word2"]
    for t, got in zip(texts, crosstoken.aligner().several(texts)):
        assert (*got[:5], {(p >> 32, p & 0xFFFFFFFF): n for p, n in zip(got[5].tolist(), got[6].tolist())}) == plain(t)


def expected(plain, rows):
    """Rows by doc_id, with the counts over all of them."""
    alone = [(i, plain(t)) for i, t in rows]
    counts = collections.Counter(p for _, x in alone for p in x[5])
    most = collections.defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    sums = lambda links: (sum(n for p, n in links.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in links.items()))
    return collections.Counter((i, *x[:4], *sums(x[5]), x[4]) for i, x in alone)


def test_counts_over_all_documents(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = expected(plain, [(r.doc_id, r.text) for r in docs.collect()])
    assert collections.Counter(map(tuple, QUERIES["op12_crosstoken"](spark, sf_dir).collect())) == want
    few = crosstoken.crosstoken(docs, block_bytes=2000)  # many blocks
    assert collections.Counter(map(tuple, few.collect())) == want


def test_alignment_of_odd_rows(spark, plain):
    rows = [r for r in ODD if r[0] != 6]
    want = expected(plain, [(i, t) for i, t, *_ in rows])
    assert collections.Counter(map(tuple, crosstoken.crosstoken(frame(spark, rows)).collect())) == want


# 13: source divergence audit


def brute(rows, least, top):
    rows = [(t or "", g or "", s or "") for _, t, g, s in rows]
    terms = lambda t: [w.translate({k: k + 32 for k in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    out = set()
    for lang in {g for _, g, _ in rows}:
        own = [(terms(t), s) for t, g, s in rows if g == lang]
        among = collections.Counter(w for t, _ in own for w in set(t))
        kept = {w for w, n in among.items() if n >= least}
        counts = {s: collections.Counter(w for t, x in own if x == s for w in t if w in kept) for s in {s for _, s in own}}
        whole = sum(counts.values(), collections.Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 2) // (c.total() + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in counts.items():
            pairs = [(-sum(f(share(c, w), share(d, w)) for w in kept), x.encode()) for x, d in counts.items() if x != s]
            single = [(-f(share(c, w), share(whole, w)), w.encode()) for w in kept if c[w] and share(c, w) > share(whole, w)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(single)[:top])):
                out |= {(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("least", [1, 3])
def test_audit_equals_the_grid(spark, least):
    rng = random.Random(least)
    words = ["the", "The", "é", "naïve", "x", "co-op", "日本", "İ", "ſ", *[f"{a}{b}" for a in "abcd" for b in "efgh"]]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "s4", None])) for k in range(120)]
    rows += [*ODD, (900, "!!! 123", "xx", "only"), (901, "", "xx", "other"), (902, None, "en", "late")]
    got = audit.audit(frame(spark, rows), least=least, top=4).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows, least, 4)


def test_joint_cells_in_slices(spark):
    lists = [("en", [(1, 5), (2, 5), (7, 1)]), ("en", [(1, 5), (2, 5)]), ("de", [(1, 5), (2, 5)]), ("en", [(2, 3), (7, 9)]), ("en", [(3, 3)])]
    want = collections.Counter((g, a, b, x, y) for g, cells in lists for k, (a, x) in enumerate(cells) for b, y in cells[k + 1 :])
    df = spark.createDataFrame(lists, "lang string, counts array<struct<sid:bigint,n:bigint>>")
    for at_once in (1, 2, 1 << 20):
        assert {tuple(r)[:5]: r.terms for r in audit.joint_cells(df, at_once=at_once).collect()} == want
