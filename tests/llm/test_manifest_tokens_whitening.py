"""Manifest, token counts and whitening against brute force on small tables with hard rows."""

import hashlib
import random
import string
import zlib

import numpy as np
import pytest

from loglake.llm import merkle, whitening
from loglake.llm.token_counts import RankMerger, _cut, token_counts

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, r long, h string, g string, id long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 16 * 16
        out.append((level[a:i], level[i + 1 : a + 16]))
        i //= 16
    return out


def manifest_by_loop(rows):
    def leaf(r, text):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r, leaf(r, r["text"])))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for k in order:
        groups[k].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
    trees = [levels_of([h for _, h in groups[k]]) for k in order]
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for j, k in enumerate(order):
        for i, (r, own) in enumerate(groups[k]):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            way, h = path(trees[j], i) + path(top, j), leaf(r, text)
            for before, behind in way:
                h = sha(*before, h, *behind)
            out.append((r["doc_id"], own, trees[j][-1][0], top[-1][0], sha(*(x for a, b in way for x in a + b)), h, h == top[-1][0]))
    return sorted(out, key=str)


def doc_rows(sizes):
    texts = [None, "", "Ab ß 日本", "x" * 70_000, "Same", "Same"]
    rows, n = [], 0
    for s, k in sizes.items():
        for _ in range(k):
            rows.append({"doc_id": n, "text": texts[n % 6], "lang": [None, "en"][n % 2], "source": s, "n_chars": [None, n][n % 2], "r": 1, "h": "h", "g": None, "id": 3})
            n += 1
    return rows


@pytest.mark.parametrize("depth", [1, 3])
def test_manifest(spark, depth, monkeypatch):
    """One group with most rows, groups of one row, more groups than fit a run, nulls, repeated
    rows; with partitions of sixteen leaves too."""
    sizes = {"hot": 300, None: 17, "": 16, "é": 2} | {f"s{i}": 1 + i % 3 for i in range(40)}
    rows = doc_rows(sizes)
    rows += [dict(rows[5]), dict(rows[5]), dict(rows[400], doc_id=None), dict(rows[400], doc_id=None, text="other")]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    if depth == 3:
        got = merkle.document_manifest(df).collect()
    else:
        lower = merkle.leaf_digest(*[merkle.lower_ascii(merkle.F.col(c)) if c == "text" else merkle.F.col(c) for c in merkle.FIELDS])
        got = merkle.manifest(df, merkle.FIELDS, merkle.F.when(merkle.fold(merkle.F.col("doc_id"), 5) == 0, lower), depth=1).collect()
    assert sorted(map(tuple, got), key=str) == manifest_by_loop(rows)
    assert not all(r["verified"] for r in got)


def test_manifest_of_few_rows_and_whole_proofs(spark):
    assert merkle.document_manifest(spark.createDataFrame([], DOCS)).count() == 0
    rows = doc_rows({"a": 1})
    one = merkle.document_manifest(spark.createDataFrame(rows, DOCS)).first()
    assert one["leaf"] == one["root"] == one["subroot"] and one["proof_sha256"] == sha()
    df = spark.createDataFrame([(f"k{i}", i % 3) for i in range(60)], "k string, grp int")
    for r in merkle.manifest(df, ["k"], id_col="k", group_col="grp", proofs=True).collect():
        assert r["leaf"] == sha(f"{len(r['k'])}:{r['k']}") and merkle.fold_proof(r["leaf"], r["proof"]) == r["root"] and r["verified"]


def test_octopus_lists_each_missing_node_once():
    known, n = np.array([3, 3, 4, 40]), 100
    got = [x.tolist() for x in merkle.octopus(known, n)]
    assert got[0] == [*range(3), *range(5, 16), *range(32, 40), *range(41, 48)]
    assert got[1] == [1, 3, 4, 5, 6] and len(got) == 2


@pytest.fixture(scope="module")
def merger():
    return RankMerger(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_token_counts_equal_the_library(merger, library):
    random.seed(5)
    texts = ["", " ", "a", "it's  We'LL 'S x\n\n y\r\n", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "日本語" * 400, "՘֋ ꟒ é́", " " * 777, "\n" * 1000, "ab" * 3000]
    texts += ["a" * k for k in (2, 3, 7, 127, 128, 129, 130, 1000, 5001)]
    texts += ["".join(random.choices("aeioutsn", k=k)) for k in (20, 100, 128, 129, 400, 4000)]
    texts += ["".join(random.choices(string.printable, k=2000)), "".join(chr(random.randrange(1, 0xD7FF)) for _ in range(3000))]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert merger.count(texts).tolist() == want
    assert merger.count(texts).tolist() == want  # from the memo


def test_merges_by_rounds_and_by_queue_are_plain_bpe(merger, library):
    """Each piece both ways, against the library."""
    random.seed(6)
    pieces = ["".join(random.choices("abcdet", k=random.randint(1, 60))) for _ in range(300)] + ["a" * k for k in range(1, 40)]
    want = [len(library.encode(p, add_special_tokens=False).ids) for p in pieces]
    sym = merger.first[np.frombuffer("".join(pieces).encode(), np.uint8)]
    seq = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    for way in (merger._rounds, merger._queue):
        out = np.zeros(len(pieces), np.int64)
        way(sym.copy(), seq, out)
        assert out.tolist() == want


def test_very_long_texts_are_cut_between_pieces(merger, library, monkeypatch):
    import loglake.llm.token_counts as T

    monkeypatch.setattr(T, "CUT_EVERY", 50)
    monkeypatch.setattr(T, "AT_ONCE", 300)
    text = "we'll see  what it's 12 3 worth <|endoftext|> now\n ok 日本 then some more " * 40
    assert "".join(_cut(text)) == text and len(list(_cut(text))) > 20
    assert merger.count([text, "", text[7:]]).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in (text, "", text[7:])]


def test_token_counts_of_a_table(spark, library):
    rows = [(1, "hello world", 5), (2, None, 6), (None, "", 7), (1, "hello world", 5), (9, "x y " * 2000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = sorted(map(tuple, token_counts(df, P.path("byte_bpe_50k.json")).collect()), key=str)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((i, len((t or "").encode()), count(t), count(t) > 1024) for i, t, _ in rows), key=str)
    assert token_counts(df.filter("false"), P.path("byte_bpe_50k.json")).count() == 0
    assert token_counts(spark.createDataFrame([("a", "b")], "doc_id string, text string"), P.path("byte_bpe_50k.json")).first()["n_tokens"] == 1


def test_polar_factor_and_spectrum():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 40):
        a = rng.standard_normal((n, n))
        a = a + a.T
        e, q = np.linalg.eigh(a)
        assert np.abs(whitening.polar(a) - (q * np.sign(e)) @ q.T).max() < 1e-10
        for v in (a @ a, np.eye(n) * 2.5, np.zeros((n, n)), np.diag(np.repeat([4.0, 1.0], [n // 2, n - n // 2])), (q * np.logspace(0, -11, n)) @ q.T):
            v = (v + v.T) / 2
            got, vecs = whitening.spectrum(v)
            assert np.abs(got - np.linalg.eigvalsh(v)[::-1]).max() <= 1e-13 * max(1, np.abs(v).max()) * n
            assert np.abs(vecs.T @ vecs - np.eye(n)).max() < 1e-13 and np.abs(v @ vecs - vecs * got).max() <= 1e-13 * max(1, np.abs(v).max()) * n


def whiten_by_loop(rows):
    x = {i: [int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for i, v in rows}
    n, d = len(x), len(next(iter(x.values())))
    s = [sum(v[k] for v in x.values()) for k in range(d)]
    y = np.array([[v[k] - s[k] / n for k in range(d)] for v in x.values()])
    e, q = np.linalg.eigh(y.T @ y / n)
    return n, {i: sum((n * v[k] - s[k]) ** 2 for k in range(d)) for i, v in x.items()}, e[::-1], q[:, ::-1], dict(zip(x, y))


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.standard_normal(12) * np.arange(1, 13) / 8 + (i % 5)]) for i in range(400)]
    bad = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, [1.0] * 11), (905, []), (906, [1e30] * 12), (907, [1.0] * 5 + [None] + [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in good + bad], "vec_id long, embedding array<float>, component int, n int").repartition(5)
    n, far, e, q, y = whiten_by_loop(good)
    got = whitening.whitening(df).collect()
    assert len(got) == 8 * n and {r["vec_id"] for r in got} == set(range(400))
    signs = {}
    for r in got:
        k = r["component"] - 1
        want = y[r["vec_id"]] @ q[:, k] / np.sqrt(e[k])
        sign = signs.setdefault(k, np.sign(want * r["whitened"]))
        assert abs(sign * r["whitened"] - want) < 1e-9 and r["n"] == n and r["deviation"] == far[r["vec_id"]] == int(r["deviation_wide"])
        assert abs(r["explained"] / (e[k] / e.sum()) - 1) < 1e-10 and r["identity_error"] < 1e-9
    again = whitening.whitening(df.repartition(2)).collect()
    assert {(r["vec_id"], r["component"], r["explained"]) for r in again} == {(r["vec_id"], r["component"], r["explained"]) for r in got}


def test_whitening_of_hard_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitening(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitening(spark.createDataFrame([(1, None), (2, [None])], schema)).count() == 0
    assert whitening.whitening(spark.createDataFrame([(1, []), (2, [])], schema)).count() == 0
    same = whitening.whitening(spark.createDataFrame([(1, [0.5, 2.0]), (1, [0.5, 2.0]), (None, [0.5, 2.0])], schema)).collect()
    assert len(same) == 6 and all((r["whitened"], r["explained"], r["deviation"], r["identity_error"]) == (None, None, 0, None) for r in same)
    line = whitening.whitening(spark.createDataFrame([(i, [float(i), float(2 * i)]) for i in range(9)], schema)).collect()
    assert {r["component"]: r["explained"] for r in line} == {1: pytest.approx(1.0), 2: 0.0}
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and line[0]["identity_error"] < 1e-9
    wide = whitening.whitening(spark.createDataFrame([(i, [float(10**9 * (i % 7)), float(i)]) for i in range(50)], schema)).collect()
    xs = [1024 * 10**9 * (i % 7) + 100_000 for i in range(50)], [1024 * i + 100_000 for i in range(50)]
    want = {i: sum((50 * x[i] - sum(x)) ** 2 for x in xs) for i in range(50)}
    assert {r["vec_id"]: int(r["deviation_wide"]) for r in wide} == want and all(r["deviation"] == (want[r["vec_id"]] if want[r["vec_id"]] < 1 << 63 else None) for r in wide)
    assert wide[0]["identity_error"] < 1e-4


def test_fast_pieces_equal_the_library_for_every_common_character(merger):
    common = [c for c in map(chr, range(0x3000)) if not merger.other(c)]
    assert len(common) > 500
    for at in range(0, len(common), 50):
        text = "".join(f"a{c}1{c}!{c} {c}{c}  {c}" for c in common[at : at + 50])
        assert merger.fast(text) == [text[a:z] for _, (a, z) in merger.full(text)]


def test_templated_lines_meet_by_their_variants(spark, monkeypatch):
    """Crowded keys of one template, with the classes of all pairs; numbers of four to six
    digits, so that lengths differ too."""
    from loglake.llm import line_dedup

    monkeypatch.setattr(line_dedup, "CROWD", 20)
    r = random.Random(7)
    short, long = "the serial of this part is ", "".join(r.choice("abcdefgh ") for _ in range(70))
    numbers = [str(r.randint(1000, 1100)) for _ in range(15)] + [str(r.randint(10_000, 999_999)) for _ in range(30)]
    lines = sorted({f"{short}{n} end of it" for n in numbers}) + sorted({f"{long}{n}{long}" for n in numbers})
    got = line_dedup.line_classes(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)).collect()

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    of = list(range(len(lines)))
    for i, x in enumerate(lines):
        for j, y in enumerate(lines[:i]):
            t = 2 if min(len(x), len(y)) >= 128 else 1
            if abs(len(x) - len(y)) <= t and of[i] != of[j] and distance(x[20:60] if t == 1 else x[60:90], y[20:60] if t == 1 else y[60:90]) <= t and distance(x, y) <= t:
                a, b = min(of[i], of[j]), max(of[i], of[j])
                of = [a if k == b else k for k in of]
    assert {x["doc_id"]: x["class_id"] for x in got} == dict(enumerate(of))
    assert len(set(of)) < len(lines)
