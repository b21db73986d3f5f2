"""The training-data operators against brute force on small tables with hard rows: nulls in
every column, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglake.llm import bpe, exact_dedup, language_id, line_dedup, lm_score, minhash, packing, pii, quality_classifier, quality_rules

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
TEXTS = [
    "the quick brown fox jumps over the lazy dog and runs far away from here today " * 3,
    "der schnelle braune Fuchs springt ueber den faulen Hund und laeuft heute weit weg " * 3,
    "", None, "a", " \t\n ", LONG, LONG + " tail", "same", "same", "x" * 5000, "mail a@b.example.org now +1 (988) 555-2485 or 4111 1111 1111 1111 at 10.0.0.256 10.0.0.25",
    "line one is long enough to be counted here, yes\nline two\nline one is long enough to be counted here, yes", "line one is long enough to be counted here, yas",
    "日本語のテキスト 😀 é́ \x00 <|endoftext|> \x85 ²³", "|".join("#*$%&<>" * 40),
]


def rows_of():
    out = [(i, t, ["en", "de", None][i % 3], ["s", None][i % 2], None, None, 7) for i, t in enumerate(TEXTS)]
    return [*out, (None, "no id", None, None, None, True, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_empty_tables(spark, empty):
    import corpus_pipeline

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    for out in (
        exact_dedup.exact_dedup(empty), quality_rules.quality_rules(empty), language_id.language_id(empty), packing.pack(empty), minhash.near_dedup(empty),
        bpe.bpe_digest(empty, ranks, P.PATTERN), line_dedup.line_classes(empty), pii.pii_digest(empty), lm_score.lm_score(empty), quality_classifier.quality_classifier(empty, labels),
    ):
        assert out.count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "pii", "packing"]


def test_exact_dedup_in_slices_with_text_ids(spark):
    rows = [(f"id{i:04d}", f"text {i % 700}") for i in range(1000)]
    got = by_id(exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id string, text string").repartition(5), max_bits=1 << 11))  # eight slices
    assert len(got) == 1000
    for i, (k, _) in enumerate(rows):
        twin = i + 700 if i < 300 else i
        assert (got[k]["keep_id"], got[k]["group_size"], got[k]["kept"]) == (f"id{twin:04d}", 2 if i < 300 or i >= 700 else 1, twin == i)


@pytest.mark.parametrize("max_bits", [1 << 30, 128])
def test_exact_dedup(docs, max_bits):
    """The second bound takes the rows in several slices."""
    got = exact_dedup.exact_dedup(docs, max_bits=max_bits).collect()
    groups = collections.defaultdict(list)
    for r in rows_of():
        groups[r[1] or ""].append(r[0])
    assert len(got) == len(rows_of())
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = sha[r["text_sha256"]]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)


def test_quality_rules(docs):
    got = by_id(quality_rules.quality_rules(docs))
    for i, text, *_ in rows_of()[:-2]:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        assert (r["n_symbols"], r["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r["kept"] and r["base_failed"])


@pytest.mark.parametrize("junk", [45, 60])
def test_quality_fence_is_not_lifted_by_junk(spark, junk):
    rows = []
    for i in range(300):  # 15 or 20 in a hundred are junk
        words = [f"word{i}x{k}" for k in range(40)]
        if i < junk:
            words = [w + "#" * (1 + i % 4) for w in words]
        rows.append((i, " ".join(words), "en", "s"))
    for i in range(junk):  # and another source with as many of repeated lines
        rows.append((1000 + i, "\n".join(f"foot {i}\nline {k} of text {i}" for k in range(20)), "en", "t"))
    for i in range(junk, 300):
        rows.append((1000 + i, "\n".join(f"line {k} of text {i}" for k in range(20)), "en", "t"))
    got = by_id(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert not any(r["base_failed"] for r in got.values())
    assert {i for i, r in got.items() if not r["kept"]} == {i + d for i in range(junk) for d in (0, 1000)}


def test_quality_verdicts_equal_exact_quantiles(spark, monkeypatch):
    """Fences by brute force: a source of its own, one that takes its language's, a language
    that takes the corpus's, and texts of one line, which no rule of lines can fail."""
    monkeypatch.setattr(quality_rules, "LEAST_GROUP", 40)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(140):
        lang, source = ("en", "a") if i < 60 else ("en", "b") if i < 85 else ("de", "c") if i < 110 else ("fr", "one line")
        words = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 7)))) + str(k) for k in range(int(rng.integers(150, 300)))]
        if i % 7 == 0:
            words = [w + "#" * (i % 3) for w in words]
        if i % 9 == 0:
            words += words[: 9 * (1 + i % 4)]
        if i % 11 == 0:
            words = [w * 3 for w in words]
        lines = [" ".join(words[k : k + 6]) for k in range(0, len(words), 6)]
        rows.append((i, (" " if source == "one line" else "\n").join(x for line in lines for x in [line, "foot"][: 1 + (i % 13 == 3)]), lang, source))
    got = by_id(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)))

    def values(i, text):
        r, n, lines = got[i], len(text.split()), len(text.split("\n"))
        ratios = [r["n_symbols"] / n, r["n_dup_lines"] / lines, r["n_repeat_words"] / n, r["word_chars"] / n]
        return ratios, [1 / n, 1 / lines if lines > 1 else None, 16 / n, ratios[3] / math.sqrt(n)]

    known = {i: (values(i, t), lang, source) for i, t, lang, source in rows if not got[i]["base_failed"]}
    quantile = lambda v, p: sorted(v)[math.ceil(p * len(v)) - 1]

    def fence(k, *group):
        v = [x for x, *g in known.values() if tuple(g[: len(group)]) == group]
        steps = [s[k] for _, s in v if s[k] is not None]
        if len(v) < (40 if group else 1) or not steps:
            return None
        q = [x[k] for x, _ in v]
        return quantile(q, 0.75) + 8.5 * (quantile(q, 0.75) - quantile(q, 0.5)), quantile(steps, 0.75)

    failed = [0] * 4
    for i, ((ratios, own), lang, source) in known.items():
        fences = [next(f for g in ((lang, source), (lang,), ()) if (f := fence(k, *g)) is not None) for k in range(4)]
        fences = [spread + 2 * max(step, mine or 0) for (spread, step), mine in zip(fences, own)]
        over = [x > f for x, f in zip(ratios, fences)]
        failed = [a + b for a, b in zip(failed, over)]
        assert got[i]["kept"] == (not any(over)), (i, ratios, fences)
    assert all(failed) and len(known) > 100


def test_language_id(docs):
    got = by_id(language_id.language_id(docs))
    assert len(got) == len(TEXTS) + 1
    for i in (2, 3, 5, 15):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    protos = language_id.learn(docs.filter("doc_id < 2"))
    pred = by_id(language_id.predict(docs.filter("doc_id < 2"), protos))
    assert (pred[0]["lang_pred"], pred[1]["lang_pred"]) == ("en", "de") and 0.5 < pred[0]["score"] <= 1


def test_language_vectors_are_sums_of_bound_letters():
    s = language_id.Space()
    v, n = s.sums(["ab", "1"])
    code = [0, s.kind[ord("a")], s.kind[ord("b")], 0]
    want = sum(np.prod([s.rolled[k][code[i + k]].astype(int) for k in range(3)], axis=0) for i in range(2))
    assert (v[0] == want).all() and n.tolist() == [2, 0]


def test_packing(docs):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: np.array([*full.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, *_ in rows_of()[:-2]}
    seqs, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(docs).collect():
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] is not None:
            a = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(a.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
            pieces[r["doc_id"]].append((r["start"], r["length"]))
    for group, size in [*((v, None) for v in seqs.values()), *((pieces[i], len(ids[i])) for i in ids)]:
        at = 0
        for start, n in sorted(group):
            assert start == at
            at += n
        assert at <= 2048 if size is None else at == size
    assert all(sum(n for _, n in v) in {1 << k for k in range(12)} for v in seqs.values())


def test_fast_tokens_equal_for_every_character():
    t = packing.Tokens(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for c in map(chr, [*range(0x250), *range(0x2010, 0x2020), 0x2026]):
        for s in (c, f"a{c}b", f" {c} 1{c}{c} ", f"  {c}", f"{c}'s"):
            assert t.full.encode(s, add_special_tokens=False).ids == t.fast.encode_ordinary(s)


def test_vector_packing_respects_all_limits(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(1, 200)), int(rng.integers(0, 90))) for i in range(300)] + [(900, None, 4), (901, 0, 0)]
    d = spark.createDataFrame(rows, "i long, t long, l long")
    size = {i: (t or 0, min(l, t or 0)) for i, t, l in rows}
    bins = collections.defaultdict(list)
    for r in packing.pack_examples(d, "i", "t", "l", max_tokens=512, max_segments=7, max_loss=150).collect():
        bins[r["sequence_id"]].append(r["i"])
    assert sorted(x for b in bins.values() for x in b) == list(range(300))
    for b in bins.values():
        assert len(b) <= 7 and sum(size[i][0] for i in b) <= 512 and sum(size[i][1] for i in b) <= 150
    with pytest.raises(ValueError):
        packing.dot_product_pack([600], [1], 512, cut=False)


def test_packing_with_text_ids(spark):
    rows = [(f"d{i}", "some words " * (i % 40), i % 60, i % 7) for i in range(120)] + [(None, None, 3, 1)]
    d = spark.createDataFrame(rows, "doc_id string, text string, t int, l int")
    ends = collections.Counter()
    for r in packing.pack(d).collect():
        ends[r["doc_id"]] += r["length"] / r["doc_tokens"]
    assert set(ends) == {r[0] for r in rows} and all(abs(v - 1) < 1e-9 for v in ends.values())
    got = packing.pack_examples(d, "doc_id", "t", "l", max_tokens=128, max_loss=20).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows if r[2])


def test_near_dedup_of_unlinked_crowds(spark, monkeypatch):
    """Texts with a long common part, too different to be linked, but for some pairs; crowds
    meet in blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    common = " ".join(f"shared{i}" for i in range(120))
    own = lambda i, n: " ".join(f"own{i}x{k}" for k in range(n))
    texts = [f"{common} {own(i // 2 if i < 20 else i, 40 if i < 20 else 34)} tail{i}" for i in range(90)]
    got = by_id(minhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), minhash.CONTRACT))
    assert [got[i]["component_id"] for i in range(90)] == [i - i % 2 if i < 20 else i for i in range(90)]


def test_bpe(docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = by_id(bpe.bpe_digest(docs, path, P.PATTERN))
    for i, t, *_ in rows_of()[:-2]:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = by_id(bpe.bpe_decode(bpe.bpe_encode(docs.filter("doc_id IS NOT NULL"), path, P.PATTERN), path, P.PATTERN))
    assert all(back[i]["text"] == (t or "") for i, t, *_ in rows_of()[:-2])


def test_bpe_on_random_texts():
    import random

    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c, r = bpe.Codec(ranks, P.PATTERN), random.Random(5)
    bits = ["a", "e", "th", "in", "ing", " ", "  ", "\n", "é", "ß", "日", "本", "😀", "1", "23", "!!", "'s", "'ll", "́", "Привет", " the", "aaaa", "====", "\t", "\x00", "　", "zz"]
    for _ in range(1500):
        s = "".join(r.choices(bits, k=r.randint(0, 30)))
        ids = c.encode(s)
        assert ids.tolist() == enc.encode_ordinary(s) and c.decode(ids, 3) == s
    for s in ("a" * 3000, "ab" * 2000, "é" * 1000, "=" * 5000, " " * 1000 + "x"):
        assert c.encode(s).tolist() == enc.encode_ordinary(s)
    import regex

    full = regex.compile(P.PATTERN).findall
    for cp in [*range(0x300), *range(0x2000, 0x2030)]:
        s = f"a{chr(cp)}1 {chr(cp)}{chr(cp)}b"
        assert c.split(s) == full(s)


def test_utf8_automaton_equals_a_decoder():
    import random

    r = random.Random(1)
    for _ in range(20000):
        b = bytearray("".join(r.choices(["a", "é", "日", "😀", "߿", "\ud7ff", "\ue000", "\U0010ffff", " "], k=r.randint(0, 6))).encode())
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 1)] = bytes([r.randrange(256)]) if r.random() < 0.5 else b""
        k, s = r.randint(0, len(b)), bpe.Utf8Stream()
        assert s.feed(bytes(b[:k])) + s.feed(bytes(b[k:]), last=True) == bytes(b).decode("utf-8", "replace")


def test_broken_utf8_streams():
    s = bpe.Utf8Stream()
    assert s.feed(b"\xe6\x97") + s.feed(b"\xa5a\xff") + s.feed(b"\xf0\x9f", last=True) == "日a��"


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components_of(nodes, linked):
    up = {i: i for i in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: top(i) for i in nodes}


@pytest.mark.parametrize("shape", [minhash.CONTRACT, minhash.Shape()])
def test_near_dedup(spark, shape):
    import random

    r = random.Random(9)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    texts = list(TEXTS)
    for k in range(40):  # a group whose members are linked by others only
        w = list(base)
        for _ in range(k % 9):
            w[r.randrange(150)] = f"n{r.randrange(10**6)}"
        texts.append(" ".join(w) if k % 2 else " ".join(w).upper())
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None)]
    got = {x["doc_id"]: x for x in minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shape).collect()}
    sets = {i: shingles(t, shape.words) for i, t in enumerate(texts)}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both > 0 and 100 * both >= shape.percent * (len(sets[a]) + len(sets[b]) - both)

    want = components_of(range(len(texts)), linked)
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i)
    assert got[None]["component_id"] is None and got[None]["kept"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edits_allowed(a, b, bands):
    n = min(len(a), len(b))
    return max((x for x in bands if n >= x[0]), default=(0, 0))[1]


@pytest.mark.parametrize("bands", [((0, 0), (40, 1)), ((0, 0), (20, 1), (45, 2)), ((0, 0), (40, 3))])
def test_line_dedup(spark, bands, monkeypatch):
    monkeypatch.setattr(line_dedup, "CROWD", 5)  # keys are split again
    import random

    r = random.Random(2)
    base = "".join(r.choices("abcdefgh ", k=46))
    lines = [base, base]
    for _ in range(60):
        x = list(base)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(x))
            x[k : k + 1] = r.choice([[], ["z"], [x[k], "q"]])
        lines.append("".join(x))
    texts = ["\n".join(lines[i : i + 7]) for i in range(0, len(lines), 7)] + ["", None, "short\nshort\n  \n  ", base]
    rows = [(i, t) for i, t in enumerate(texts)]
    all_lines = {(i, k): x for i, t in rows for k, x in enumerate((t or "").split("\n"))}
    counted = [k for k, x in all_lines.items() if x.strip()]
    want = {k: k for k in all_lines} | components_of(counted, lambda a, b: edits(all_lines[a], all_lines[b]) <= edits_allowed(all_lines[a], all_lines[b], bands))
    size = collections.Counter(want.values())
    got = line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string"), bands=bands).collect()
    assert len(got) == len(all_lines)
    for x in got:
        k = (x["doc_id"], x["line_no"])
        assert (x["class_id"], x["class_line_no"]) == want[k] and x["class_size"] == size[want[k]] and x["kept"] == (want[k] == k)
    left = {x["doc_id"]: x["text"] for x in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), bands=bands).collect()}
    for i, t in rows:
        assert left[i] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if want[i, k] == (i, k)))


def test_line_dedup_keeps_every_row_of_a_large_class(spark):
    lines = [f"Page {i:04d} of the handbook for the operators of the plant" for i in range(3000)]
    got = line_dedup.line_classes(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(3000))
    assert {(x["class_id"], x["class_size"]) for x in got} == {(0, 3000)} and [x["doc_id"] for x in got if x["kept"]] == [0]


def test_banded_edit_distance(spark):
    import random

    r, rows = random.Random(1), []
    for _ in range(1500):
        a = "".join(r.choices("abcdefghij"[: r.choice([2, 3, 10])], k=r.randint(3, 40)))
        b = list(a)
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 1)] = r.choice([[], ["a"], ["b", "c"]])
        if len(b) >= 3:
            rows.append((a, "".join(b), edits(a, b)))
    d = spark.createDataFrame(rows, "x string, y string, d int")
    for t in (1, 2, 3):
        assert d.filter(F.expr(f"{line_dedup.within('x', 'y', t)} <> (d <= {t})")).count() == 0 < d.filter(f"d <= {t}").count()


def test_line_dedup_splits_crowded_keys(spark):
    """Thousands of lines with one first half and a few links: found without meeting all."""
    import random

    r = random.Random(7)
    head = "2024-05-01T10:00:00Z host-a service started with the following id: "
    rows = [(i, head + "".join(r.choices("0123456789abcdef", k=72))) for i in range(4000)]
    for i in range(50):
        k = len(head) + r.randrange(70)
        x = rows[i][1]
        rows.append((4000 + i, x[:k] + "zz" + x[k + 2 :]))
    got = by_id(line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert len(got) == 4050
    for i, x in got.items():
        assert (x["class_id"], x["class_size"]) == ((i - 4000, 2) if i >= 4000 else (i, 2 if i < 50 else 1))


def test_line_dedup_follows_every_shared_key(spark):
    import random

    r = random.Random(5)
    rows = []
    for i in range(640):  # two shared keys each, in a table of fewer than 2000 lines
        x = "".join(r.choices("abcdefgh", k=48))
        rows += [(3 * i, x), (3 * i + 1, x[:5] + "z" + x[6:]), (3 * i + 2, x[:40] + "z" + x[41:])]
    got = line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert all((x["class_id"], x["class_size"]) == (x["doc_id"] // 3 * 3, 3) for x in got)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    total = sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(d)))
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and total % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]


def test_pii(spark):
    hard = ["a@b.c_q@w.v x..y@z.com.. +1 (22) 333-44-55- 1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.4", "😀 me@x.org 4041894974608795 4041 8949 7460 8795 1" * 3, "9" * 50_000, "+1" + " " * 9000 + "2", "a" * 90_000 + "@b.c", "1.1.1.1" * 2000]
    rows = [(i, t) for i, t in enumerate([*TEXTS, *hard])] + [(None, None)]
    rows += [(1000 + i, f"call +1 (9{i:02d}) 555-{1000 + i} about {4000 + i} password=ab{i:04d}cdef9876 or AKIAABCDEFGHIJKL{i:04d}") for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(pii.pii_digest(d))
    more = 0
    for i, t in rows:
        t = t or ""
        found = sorted((m.start(), k, m.end(), n) for k, n in enumerate(BASE) for m in re.finditer(BASE[n], t) if valid(n, m.group()))
        want = [f"{n}:{a}:{b}" for a, _, b, n in found]
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(spans)
        assert [got[i][f"n_{n}"] for n in BASE] == [sum(x[3] == n for x in found) for n in BASE]
        more += len(spans) - len(want)
    assert more >= 100  # the secrets
    out = {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}
    assert "[PHONE]" in out[1000] and "[SECRET]" in out[1000] and "555" not in out[1000] and out[0] == TEXTS[0] and out[None] is None


def _luhn(digits):
    return sum(v * (1 + i % 2) - 9 * (v * (1 + i % 2) > 9) for i, v in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def test_pii_adds_what_base_patterns_leave_out(spark):
    """Other forms of each kind are selected, invalid and unlike things are not."""
    r = __import__("random").Random(3)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        while not _luhn(x := "4" + digits(15)):
            pass
        return x

    forms = {
        "email": [lambda: f"{r.choice('abcd')}{digits(2)}@mail{r.randint(1, 9)}.example.com"] * 4 + [lambda: f"{r.choice('abcd')}{digits(2)} (at) mail{r.randint(1, 9)}.example.com"],
        "ip": [lambda: ".".join(str(r.randint(10, 250)) for _ in range(4))] * 4 + [lambda: "[.]".join(str(r.randint(10, 250)) for _ in range(4))],
        "card": [card] * 4 + [lambda: ".".join(re.findall("....", card()))],
        "phone": [lambda: f"+1 ({digits(3)}) 555-{digits(4)}"] * 12 + [lambda: f"({digits(3)}) 555-{digits(4)}"],
    }
    rows, planted = [], {}
    for i in range(900):
        kind = ["email", "ip", "card", "phone", None][i % 5]
        if kind is None:
            text = f"nothing here but {digits(5)} and 2024-0{r.randint(1, 9)}-1{r.randint(0, 9)} or v1.2.{r.randint(300, 900)}.4"
        else:
            x = r.choice(forms[kind])()
            text = f"some words then {x} and more"
            planted[i] = (kind, 16, 16 + len(x))
        rows.append((i, text))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["spans"] for x in pii.pii_digest(d).collect()}
    added = collections.Counter()
    for i, text in rows:
        if i in planted:
            k, a, b = planted[i]
            base = any(valid(n, m.group()) for n in BASE for m in re.finditer(BASE[n], text))
            hit = f"{k}:{a}:{b}" in got[i].split(",")
            assert hit or not base
            added[k, base, hit] += 1
        else:
            assert got[i] == ""  # dates, versions and short numbers are left alone
    for k in ("email", "ip", "card", "phone"):
        assert added[k, False, True] >= 0.9 * (added[k, False, True] + added[k, False, False]) > 0, (k, added)


def test_pii_spans_equal_a_loop(spark):
    """Islands and gaps, over more spans than a block holds, as a loop finds them."""
    r = __import__("random").Random(8)
    rows = []
    for i in range(12):
        n = [0, 1, 5, 300, 700][i % 5]
        make = lambda m: sorted((x := r.randint(0, 6000), r.randint(0, 4), x + r.randint(1, 30)) for _ in range(m))
        rows.append((i, make(n), make(n // 2 + i % 2)))
    d = spark.createDataFrame(rows, f"i int, base array<{pii.SPAN}>, picks array<{pii.SPAN}>")
    got = d.select("i", F.expr(pii._islands("base")).alias("m"), F.expr(f"array_sort({pii._apart('picks')})").alias("p")).collect()
    for (i, base, picks), g in zip(rows, sorted(got)):
        m = []
        for s, k, e in base:
            if m and s < m[-1][2]:
                m[-1] = (*m[-1][:2], max(m[-1][2], e))
            else:
                m.append((s, k, e))
        assert [tuple(x) for x in g["m"]] == m
        assert [tuple(x) for x in g["p"]] == sorted(x for x in picks if not any(b[0] < x[2] and x[0] < b[2] for b in base))


def test_redact_with_many_spans_and_any_column_names(spark):
    text = "ä " + " ".join(f"u{i}@h.example.org" for i in range(3000)) + " ö"
    d = spark.createDataFrame([(1, text, 5, "b", 7, "x"), (1, None, 6, "c", 8, "y")], "doc_id long, text string, spans int, base string, id int, all string")
    got = {x["spans"]: x for x in pii.redact(d).collect()}
    assert got[5]["text"] == "ä " + " ".join(["[EMAIL]"] * 3000) + " ö" and got[6]["text"] is None
    assert (got[5]["base"], got[5]["id"], got[5]["all"]) == ("b", 7, "x") and pii.redact(d).columns == d.columns
    lines = line_dedup.drop_repeated_lines(d.withColumnRenamed("spans", "gone").withColumnRenamed("base", "t"))
    assert sorted(x["gone"] for x in lines.collect()) == [5, 6]


def test_classifier_learns_grades(spark):
    rows = [(i, ["idiot scum " * (1 + i % 3), "buy now !! || ## ", "a calm and useful text "][i % 3] + " ".join(f"w{(i * 7 + k) % 400}" for k in range(20))) for i in range(600)]
    d = spark.createDataFrame([*rows, (None, None), (700, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 2), int(i % 3 == 0)) for i in range(0, 600, 2)] + [(700, None, None)], "doc_id long, quality int, toxic int")
    got = by_id(quality_classifier.quality_classifier(d, labels))
    assert len(got) == 602
    held = range(1, 600, 2)
    right = sum(abs(got[i]["expected_grade"] - i % 3) < 0.5 for i in held)
    assert right > 0.97 * len(held)
    assert all(got[i]["p_not_toxic"] >= got[i]["p_fine"] for i in held)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, u in ((0, 10), (1, 1), (5, 100), (1000, 5000), (20_000, 1 << 40), (30_000, 40_000)):
        v = np.unique(rng.integers(0, u, n, dtype=np.uint64)) if n else np.zeros(0, np.uint64)
        e = lm_score.EliasFano(lm_score.EliasFano.build(v, u, "x"), "x")
        assert (e.access(np.arange(len(v))) == v).all() if n else True
        x = np.unique(np.r_[v, rng.integers(0, u, 2000, dtype=np.uint64)]).astype(np.uint64)
        place = {a: i for i, a in enumerate(v.tolist())}
        assert e.find(x).tolist() == [place.get(i, -1) for i in x.tolist()]


def test_packed_bits_and_places_in_words():
    rng = np.random.default_rng(2)
    for bits in (1, 7, 20, 32, 33, 63):
        v = rng.integers(0, 1 << bits, 1000, dtype=np.uint64)
        assert (lm_score.bits_at(lm_score.bits_packed(v, bits), bits, np.arange(1000)) == v).all()
    x = np.r_[rng.integers(1, 1 << 64, 500, dtype=np.uint64), np.uint64((1 << 64) - 1), np.uint64(1 << 63)]
    for word in x:
        places = [i for i in range(64) if int(word) >> i & 1]
        k = np.arange(len(places), dtype=np.uint64)
        assert lm_score._in_word(np.full(len(k), word), k).tolist() == places
    for a in (np.array([3, 2**40, 1], np.uint64), np.array([5, 5, 2**63], np.uint64), np.zeros(4, np.uint32), np.zeros(0, np.uint64), np.array([-1, 7], np.int32)):
        got = lm_score.unpack(lm_score.pack({"a": a}))["a"]
        assert got.dtype == a.dtype and (got == a).all()


def tokens_of(t):
    return (t or "").encode().lower().split() + [b"\n"]


def trigram_scores(train, texts):
    """Brute force: (base, full) log10 probabilities by counts of words, pairs and triples."""
    c, b, t3 = collections.Counter(), collections.Counter(), collections.Counter()
    for t in train:
        w = [b"\n", *tokens_of(t)]
        c.update(w[1:])
        b.update(zip(w, w[1:]))
        t3.update(zip(w, w[1:], w[2:]))
    n, v, (m2, m3) = sum(c.values()), len(c), lm_score.WEIGHTS
    out = []
    for t in texts:
        w, base, full = [b"\n", *tokens_of(t)], 0.0, 0.0
        for i in range(1, len(w)):
            one = (c[w[i]] + 1) / (n + v + 1)
            two = (b[w[i - 1], w[i]] + m2 * one) / (c[w[i - 1]] + m2)
            pair = b[w[i - 2], w[i - 1]] if i > 1 else 0
            base += math.log10(one)
            full += math.log10(((t3[w[i - 2], w[i - 1], w[i]] if pair else 0) + m3 * two) / (pair + m3))
        out.append((base, full))
    return out


def test_lm_score(docs, monkeypatch):
    rows = rows_of()[:-2]
    out_of = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [t for i, t, *_ in rows if not out_of(i)]
    want = trigram_scores(train, [t for _, t, *_ in rows])
    known = {x for t in train for x in tokens_of(t)}
    got = by_id(lm_score.lm_score(docs))
    assert len(got) == len(rows) + 1  # two rows without id
    for (i, t, *_), (base, full) in zip(rows, want):
        w, r = tokens_of(t), got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out_of(i), len(w), sum(x in known for x in w), sum(len(tokens_of(t)) for t in train))
        assert abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - full) < 1e-3 * len(w)


def test_lm_keeps_no_level_but_a_model_does(spark, tmp_path, monkeypatch):
    import glob

    d = spark.createDataFrame([(i, "a b c a b") for i in range(20)], "doc_id long, text string")
    monkeypatch.setattr(lm_score, "shared_path", lambda spark, name: f"file://{tmp_path}/{name}")
    assert len(by_id(lm_score.lm_score(d))) == 20 and not glob.glob(f"{tmp_path}/lm/level*")
    lm_score.train(d)
    assert {p.rsplit("/", 1)[1].split("-")[0] for p in glob.glob(f"{tmp_path}/lm/level*")} == {"level1", "level2", "level3"}


def test_lm_model_is_used_again(spark):
    train = ["a b c", "c a", "a b c d", None, ""]
    model = lm_score.train(spark.createDataFrame([(t,) for t in train], "text string"))
    texts = ["a b", "b c d", "x y", None, "c a a b c"]
    got = by_id(lm_score.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model))
    for i, (base, full) in enumerate(trigram_scores(train, texts)):
        assert abs(got[i]["base_score"] - base) < 1e-9 and abs(got[i]["score"] - full) < 5e-3


def test_lm_in_many_chunks_and_shards(spark, monkeypatch):
    """Small chunks and shards, inside the tasks too, give the same scores."""
    import random

    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(0, 60))) for _ in range(200)]
    want = trigram_scores([t for i, t in enumerate(texts) if i % 2], texts)
    docs = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "id long, train byte, text string").repartition(7)
    monkeypatch.setattr(lm_score, "SHARD", 500)
    model, out = lm_score._run(docs, None)
    assert model.shards > 5
    for x in out.collect():
        assert abs(x["score"] - want[x["id"]][1]) < 5e-2


def test_pipeline_runs(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, f"{t} " * 3 if i % 2 else t, "en", "s", 1) for i, t in enumerate([TEXTS[0] + f" number {k}" for k in range(20)] + TEXTS[6:14])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = corpus_pipeline.documents(spark, str(tmp_path))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = corpus_pipeline.materialize(stage(spark, d, str(tmp_path)), name)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"] and d.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).select(F.sum("length")).first()[0] > 0


def test_pipeline_stages_take_any_columns_nulls_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    extra = ["_id", "_label_id", "_grade", "gone", "all", "spans", "base", "t", "m", "h", "id", "kept", "component_id", "slice", "class_id"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    rows = [(i, t, None, None, None, *extra) for i, t in enumerate(["", None, " \t", "one\ntwo a@b.example.org\none", "word " * 30_000, "a line of some length here\n" * 3000, "x@y.example.org " * 2000])]
    rows += [rows[3], (None, None, *rows[0][2:]), (None, "no id at all", *rows[0][2:])]
    spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, empty = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, str(tmp_path)), stage(spark, empty, str(tmp_path))
        assert none.count() == 0, name
        if name == "packing":
            continue
        assert out.columns == docs.columns == none.columns, name
        got = out.collect()
        assert all([r[c] for c in extra] == extra for r in got), name
        if name == "line_dedup":
            assert [r["text"] for r in got if r["doc_id"] == 5] == ["a line of some length here\n"]  # the empty last line stays
        if name == "pii":
            assert len(got) == len(rows) and [r["text"] for r in got if r["doc_id"] == 6] == ["[EMAIL] " * 2000]
            assert sum(r["text"] is None for r in got) == 2


def test_shuffle_files_go_when_a_table_is_written(spark, tmp_path):
    from loglake.llm.common import materialize

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())}
    before = files()
    out = materialize(spark.range(100).repartition(3, "id"), "x", path=str(tmp_path / "x"))
    assert not {f for f in files() - before if f.startswith("shuffle_")} and out.count() == 100


def test_lm_keeps_no_answers_that_chunks_have(spark, tmp_path, monkeypatch):
    import glob

    d = spark.createDataFrame([(i, "a b c a b") for i in range(20)], "doc_id long, text string")
    monkeypatch.setattr(lm_score, "shared_path", lambda spark, name: f"file://{tmp_path}/{name}")
    monkeypatch.setattr("loglake.llm.common.shared_path", lambda spark, name: f"file://{tmp_path}/{name}")
    assert len(by_id(lm_score.lm_score(d))) == 20
    assert [p.rsplit("-", 1)[1] for p in glob.glob(f"{tmp_path}/lm-answers*")] == ["answers3"]


def test_lm_counts_and_codes():
    """A count takes the place of a code without a change of any code."""
    r = np.random.default_rng(1)
    for weight in lm_score.WEIGHTS:
        n = np.r_[np.arange(0, 3000), r.integers(3000, 1 << 40, 20_000)].astype(np.uint64)
        total = n + r.integers(0, 5000, len(n)).astype(np.uint64)
        code = lm_score._code_of(n, total, weight)
        back = lm_score._count_of(code, total, weight)
        assert (back[n < 1000] == n[n < 1000]).all()
        assert (lm_score._code_of(back, total, weight) == code).all()
