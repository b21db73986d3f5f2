"""Personal data: base patterns, and more spans by boosted trees over candidates.

Generators of high recall propose spans that may overlap. Features of a candidate's form
and context are small integers, so the whole training set is a table of cells with
counts of two classes, whose number is bounded by the product of the features' sizes. A
few boosted trees are fitted on it, a threshold for each kind is calibrated on documents
held out, and the trees become a column expression that selects candidates. Base spans
always stay.

Labels come from what the features do not show: whether a candidate's content is valid
once separators and spelled-out signs are left out (check digit, ranges of parts, dialling
prefix, name and top-level domain, mixed letters and digits). So the trees learn which
forms and contexts valid content has, and select what the base patterns do not match.

Everything on the main path is DataFrame expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import materialize

KINDS = ["email", "ip", "card", "phone", "secret"]

# Base patterns. A match starts where the last one ended or where its run of characters
# starts, and the repeats are possessive: the same matches, in linear time and no stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}

GENERATORS = {
    # digits with separators, of any grouping
    "number": r"(?<![A-Za-z0-9])\+?\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,40}+(?![A-Za-z0-9])",
    # addresses with spelled-out signs
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}){1,8}",
    # assignments to names of secrets, and long tokens of mixed characters
    "key": r"(?i:password|passwd|pwd|secret|token|api_?key)[\"']?\x20?[:=]\x20?[\"']?[A-Za-z0-9/+_.-]{6,200}|(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{16,40}(?![A-Za-z0-9])",
    # four numbers with any form of dot
    "dotted": r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\x20?(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?[0-9]{1,3}){3}(?![A-Za-z0-9])",
    # groups of hexadecimal digits between colons
    "colons": r"(?<![A-Za-z0-9:.])(?:[0-9A-Fa-f]{1,4}:{1,2}){2,7}[0-9A-Fa-f]{0,4}(?![A-Za-z0-9:])",
}
NEEDS_ANY = {
    "number": "[0-9]{2}|[0-9][\\x20().-][0-9]", "address": "@|\\(at\\)|\\[at\\]", "key": "[:=]|[A-Z0-9]{16}",
    "dotted": "[0-9]\\x20?[.(\\[]", "colons": "[0-9A-Fa-f]:[:0-9A-Fa-f]",
}
CONTEXT = r"(?i)(?:e-?mail|contact|write|call|phone|tel|mobile|fax|card|visa|pay|ip|host|server|login|user|key|secret|token|password)[^\n]{0,12}$"

#: Sizes of the features; their product bounds the cells that come to the driver.
FEATURES = {"kind": 5, "digits": 7, "separators": 4, "lead": 5, "context": 2, "before": 3, "after": 3, "letters": 3, "length": 5}
CELLS = math.prod(FEATURES.values())

TREES = 24
RATE = 0.3
#: A kind's threshold is the least above which this share of its held-out picks is valid.
PRECISION = 0.97


def _starts(gaps: str, matches: str) -> str:
    """SQL: the start of each match, by sums over gaps and matches. Sums run in blocks, so
    that a text with very many matches does not copy a growing array for each."""
    return f"""
        transform(array({matches}), m0 -> transform(array(transform(sequence(0, (size(m0) - 1) div 256), b -> aggregate(
            zip_with(slice({gaps}, b * 256 + 1, least(256, size(m0) - b * 256)), slice(m0, b * 256 + 1, 256), (g, m) -> length(g) + length(m)),
            array(0), (a, v) -> concat(a, array(element_at(a, -1) + v))))),
          inner -> transform(array(aggregate(inner, array(0), (a, x) -> concat(a, array(element_at(a, -1) + element_at(x, -1))))),
            total -> flatten(transform(inner, (x, b) -> transform(slice(x, 1, size(x) - 1), (v, i) -> v + total[b] + length({gaps}[b * 256 + i])))))[0])[0])[0]"""


_DIGITS = "regexp_replace({x}, '[^0-9]', '')"
_LUHN = """aggregate(transform(sequence(1, length({d})), i -> transform(array(int(substr({d}, -i, 1)) * (2 - i % 2)), v -> v - if(v > 9, 9, 0))[0]), 0, (a, v) -> a + v) % 10 = 0"""


def _valid(kind: str, x: str) -> str:
    d = _DIGITS.format(x=x)
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return rf"{x} rlike '^{part}([.]{part}){{3}}$'"
    if kind == "card":
        return f"if(length({d}) between 12 and 19, {_LUHN.format(d=d)}, false)"
    if kind == "phone":
        return f"length({d}) between 9 and 15"
    return "true"


def _lit(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _spans(df: DataFrame, patterns: dict[str, str], guards: dict[str, str]) -> DataFrame:
    """Adds for each pattern an array ``s_*`` of (s, e, m, b, a): start, end and text of its
    matches, the last characters of the gap before and the first one of the gap after."""
    for k, p in patterns.items():
        df = df.withColumn(f"m_{k}", F.expr(f"if({guards[k]}, regexp_extract_all(t, {_lit(p)}, 0), cast(array() as array<string>))"))
        df = df.withColumn(f"g_{k}", F.expr(f"if(size(m_{k}) > 0, split(t, {_lit(p)}, -1), cast(array() as array<string>))"))
    for k in patterns:
        df = df.withColumn(f"p_{k}", F.expr(f"if(size(m_{k}) > 0, {_starts(f'g_{k}', f'm_{k}')}, cast(array() as array<int>))"))
    cols = [c for c in df.columns if c[:2] not in ("m_", "g_", "p_")]
    span = "struct(p_{k}[i] as s, p_{k}[i] + length(m) as e, m as m, right(g_{k}[i], 24) as b, left(g_{k}[i + 1], 1) as a)"
    return df.select(*cols, *[F.expr(f"transform(m_{k}, (m, i) -> {span.format(k=k)})").alias(f"s_{k}") for k in patterns])


def base_spans(df: DataFrame) -> DataFrame:
    """Adds ``base``: an array of (s, k, e), by start and then kind, of valid base matches."""
    guards = {k: f"contains(t, '{NEEDS[k]}')" if k in NEEDS else "t rlike '[0-9]'" for k in BASE}
    guards["ip"] = "t rlike '[0-9][.][0-9]'"
    df = _spans(df, BASE, guards)
    parts = [f"transform(filter(s_{k}, x -> {_valid(k, 'x.m')}), x -> struct(x.s as s, {KINDS.index(k)} as k, x.e as e))" for k in BASE]
    return df.withColumn("base", F.expr(f"array_sort(concat({', '.join(parts)}))")).drop(*[f"s_{k}" for k in BASE])


def _bucket(x: str, edges: list[int]) -> str:
    return "case " + " ".join(f"when {x} < {e} then {i}" for i, e in enumerate(edges)) + f" else {len(edges)} end"


def _label(generator: str, d: str) -> str:
    """SQL: whether the content of candidate ``x.m`` with the digits ``d`` is valid."""
    if generator == "number":
        phone = f"length({d}) between 9 and 15 AND x.m rlike '^[+]|^00|[(][0-9]{{2,4}}[)]'"
        return f"case x.k when 2 then if(length({d}) between 13 and 19, {_LUHN.format(d=d)}, false) else {phone} end"
    if generator == "address":
        return r"x.m rlike '^[A-Za-z0-9][A-Za-z0-9._%+-]*[^A-Za-z0-9].*[A-Za-z]{2}$'"
    if generator == "key":
        return r"x.m rlike '(?=[A-Za-z/+_.-]*[0-9])(?=[0-9/+_.-]*[A-Za-z])[A-Za-z0-9/+_.-]{12,200}$'"
    if generator == "dotted":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return rf"x.m rlike '^{part}(?:[^0-9]+{part}){{3}}$'"
    return r"x.m rlike '^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$' OR (x.m rlike '^[0-9A-Fa-f:]*::[0-9A-Fa-f:]*$' AND NOT x.m rlike '::.*::')"


_KIND = {"number": "if(length({d}) < 12 OR x.m like '+%' OR x.m like '%(%', 3, 2)", "address": "0", "key": "4", "dotted": "1", "colons": "1"}


def candidates(df: DataFrame) -> DataFrame:
    """Adds ``cand``: an array of (s, e, label, f): a span, whether it is valid, features."""
    df = _spans(df, GENERATORS, {k: f"t rlike {_lit(v)}" for k, v in NEEDS_ANY.items()})
    d = _DIGITS.format(x="x.m")
    char = "case when {c} is null or {c} = '' or {c} rlike '\\\\s' then 0 when {c} rlike '[A-Za-z0-9]' then 1 else 2 end"
    f = {
        "kind": "x.k",
        "digits": _bucket(f"length({d})", [1, 7, 9, 12, 16, 20]),
        "separators": "case when x.m like '%(%' then 3 when x.m like '%.%' then 2 when x.m rlike '[^A-Za-z0-9]' then 1 else 0 end",
        "lead": f"case left({d}, 1) when '' then 0 when '3' then 1 when '4' then 2 when '5' then 3 else 4 end",
        "context": f"int(x.b rlike {_lit(CONTEXT)})",
        "before": char.format(c="right(x.b, 1)"),
        "after": char.format(c="x.a"),
        "letters": _bucket("length(regexp_replace(x.m, '[^A-Za-z]', ''))", [1, 12]),
        "length": _bucket("length(x.m)", [12, 18, 24, 40]),
    }
    named = ", ".join(f"{v} as {n}" for n, v in f.items())
    arrays = []
    for g in GENERATORS:
        kinds = f"transform(s_{g}, x -> struct(x.s as s, x.e as e, x.m as m, x.b as b, x.a as a, {_KIND[g].format(d=d)} as k))"
        arrays.append(f"transform({kinds}, x -> struct(x.s as s, x.e as e, {_label(g, d)} as label, struct({named}) as f))")
    return df.withColumn("cand", F.expr(f"concat({', '.join(arrays)})")).drop(*[f"s_{k}" for k in GENERATORS])


@dataclass
class Trees:
    """Trees of depth two: (feature, cut, feature, cut, feature, cut, four leaves)."""

    start: float
    trees: list[tuple]
    #: By kind: scores above it are selected. A kind without one selects nothing.
    thresholds: dict[int, float]

    def sql(self, f: str) -> str:
        parts = [str(float(self.start))]
        for a, ca, b, cb, c, cc, w in self.trees:
            parts.append(f"if({f}.{a} < {ca}, if({f}.{b} < {cb}, {w[0]}D, {w[1]}D), if({f}.{c} < {cc}, {w[2]}D, {w[3]}D))")
        return " + ".join(parts)

    def picks(self, f: str) -> str:
        """SQL condition: the trees select the candidate with these features."""
        if not self.thresholds:
            return "false"
        cases = " ".join(f"when {k} then {t + 1e-9}D" for k, t in sorted(self.thresholds.items()))
        return f"coalesce(({self.sql(f)}) > case {f}.kind {cases} end, false)"

    def score(self, x: dict) -> float:
        s = self.start
        for a, ca, b, cb, c, cc, w in self.trees:
            s += w[(0 if x[b] < cb else 1) if x[a] < ca else (2 if x[c] < cc else 3)]
        return s


def _split(cells, grads):
    """The best cut of these cells: (gain, feature, cut)."""
    total_g, total_h = sum(g for g, _ in grads), sum(h for _, h in grads)
    best = (0.0, "kind", 0)
    for f, size in FEATURES.items():
        by_g, by_h = [0.0] * size, [0.0] * size
        for (x, _, _), (g, h) in zip(cells, grads):
            by_g[x[f]] += g
            by_h[x[f]] += h
        g = h = 0.0
        for cut in range(1, size):
            g, h = g + by_g[cut - 1], h + by_h[cut - 1]
            gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            if gain > best[0] + 1e-12:
                best = (gain, f, cut)
    return best


def fit_trees(cells: list[tuple[dict, float, float]]) -> tuple[float, list[tuple]]:
    """Logistic boosting on cells of (features, positives, negatives)."""
    pos, neg = sum(c[1] for c in cells), sum(c[2] for c in cells)
    start = math.log((pos + 1) / (neg + 1))
    scores, trees = [start] * len(cells), []
    for _ in range(TREES):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        grads = [(c[1] - (c[1] + c[2]) * q, (c[1] + c[2]) * q * (1 - q)) for c, q in zip(cells, p)]
        _, a, ca = _split(cells, grads)
        sides = [[i for i, c in enumerate(cells) if (c[0][a] < ca) == s] for s in (True, False)]
        cuts, leaves = [], []
        for side in sides:
            _, f, cut = _split([cells[i] for i in side], [grads[i] for i in side])
            cuts += [f, cut]
            for s in (True, False):
                own = [i for i in side if (cells[i][0][f] < cut) == s]
                w = RATE * sum(grads[i][0] for i in own) / (sum(grads[i][1] for i in own) + 1)
                leaves.append(round(w, 9))
                for i in own:
                    scores[i] += leaves[-1]
        trees.append((a, ca, *cuts, leaves))
    return start, trees


def train(df: DataFrame) -> Trees:
    """Trees from the cells of all candidates; three quarters of the documents fit them,
    the others set each kind's threshold. Kinds without valid candidates select nothing."""
    x = df.select((F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % 4 == 2).alias("held"), F.explode("cand").alias("c"))
    cells = x.groupBy("held", *[F.col(f"c.f.{n}").alias(n) for n in FEATURES]).agg(F.count_if("c.label").alias("pos"), F.count_if(~F.col("c.label")).alias("neg"))
    fit, held = [], []
    for r in sorted(cells.collect(), key=tuple):  # 2 * CELLS rows at most
        (held if r["held"] else fit).append(({n: r[n] for n in FEATURES}, float(r["pos"]), float(r["neg"])))
    if not sum(c[1] for c in fit) or not held:
        return Trees(0.0, [], {})
    model = Trees(*fit_trees(fit), {})
    for kind in range(len(KINDS)):
        cells = sorted(((model.score(c[0]), c[1], c[2]) for c in held if c[0]["kind"] == kind), reverse=True)
        below = [x[0] for x in cells[1:]] + [0.0]
        right = picked = 0.0
        for (score, pos, neg), lower in zip(cells, below):
            right, picked = right + pos, picked + pos + neg
            if score > max(lower, 0.0) + 1e-9 and right >= PRECISION * picked:
                model.thresholds[kind] = max(lower, 0.0)  # down to what is known to be worse
    return model


SPAN = "struct<s: int, k: int, e: int>"


def _fold(items: str, state: str, emit: str, what: str, then: str, last: str = "cast(array() as array<{span}>)") -> str:
    """SQL: goes over the array ``items`` with a state ``c.st`` and collects ``what`` of the
    items ``x`` for which ``emit`` holds; ``last`` of the final state ``a.st`` is added. In
    blocks, so that no growing array is copied for each item."""
    empty = f"cast(array() as array<{SPAN}>)"
    inner = f"aggregate(slice(v, b * 256 + 1, 256), struct({empty} as l, a.st as st), (c, x) -> struct(if({emit}, concat(c.l, array({what})), c.l) as l, {then} as st))"
    blocks = "if(size(v) = 0, cast(array() as array<int>), sequence(0, int((size(v) - 1) div 256)))"
    step = f"transform(array({inner}), r -> struct(concat(a.done, array(r.l)) as done, r.st as st))[0]"
    done = f"concat(flatten(a.done), {last.format(span=SPAN)})"
    return f"transform(array({items}), v -> aggregate({blocks}, struct(cast(array() as array<array<{SPAN}>>) as done, {state} as st), (a, b) -> {step}, a -> {done}))[0]"


def _islands(spans: str) -> str:
    """SQL: runs of overlapping spans of a sorted array as one span, of the first one's kind."""
    overlaps = "c.st.s >= 0 AND x.s < c.st.e"
    return _fold(
        spans, "struct(-1 as s, -1 as k, -1 as e)", f"c.st.s >= 0 AND NOT ({overlaps})", "c.st",
        f"if({overlaps}, struct(c.st.s as s, c.st.k as k, greatest(c.st.e, x.e) as e), struct(x.s as s, x.k as k, x.e as e))",
        f"if(a.st.s >= 0, array(a.st), cast(array() as array<{SPAN}>))",
    )


def _apart(picks: str) -> str:
    """SQL: the spans of ``picks`` that no base span touches: none that starts before them
    and ends in them, then none that starts in them."""
    one = "concat(transform(base, x -> struct({s} as s, 0 as o, x.k as k, x.e as e)), transform({p}, x -> struct({s} as s, 1 as o, x.k as k, x.e as e)))"
    found = "struct({s} as s, x.k as k, x.e as e)"
    left = _fold(f"array_sort({one.format(s='x.s', p=picks)})", "0", "x.o = 1 AND x.s >= c.st", found.format(s="x.s"), "if(x.o = 0, greatest(c.st, x.e), c.st)")
    return _fold(f"array_sort({one.format(s='-x.s', p=left)})", "2147483647", "x.o = 1 AND x.e <= c.st", found.format(s="-x.s"), "if(x.o = 0, -x.s, c.st)")


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rest: bool = False) -> DataFrame:
    """(id, base, spans), and with ``rest`` all columns of ``df`` as one struct ``all``: a row
    for every row. base and spans are arrays of (s, k, e), k an index of KINDS.

    Null and empty texts have no spans; a null id is as any other. Positions count code
    points; the end is exclusive. spans holds base and what the trees add: selected
    candidates that no base span touches, those that overlap each other as one span.
    Rows that share an id or a text are found one by one; an empty table gives no rows;
    other columns may have any names.
    """
    more = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("all")] if rest else []
    docs = df.select(F.col(id_col).alias("id"), *more, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = materialize(candidates(base_spans(docs)).drop("t"), "candidates")
    picks = f"transform(filter(cand, x -> {train(found).picks('x.f')}), x -> struct(x.s as s, x.f.kind as k, x.e as e))"
    found = found.withColumn("picks", F.expr(picks))
    added = f"if(size(picks) = 0, cast(array() as array<{SPAN}>), {_islands(f'array_sort({_apart('picks')})')})"
    return found.withColumn("added", F.expr(added)).select("id", *[c for c in ["all"] if rest], "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def _joined(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"


def pii_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans: a row for every row, as
    ``find_pii`` has them."""
    counts = [F.expr(f"bigint(size(filter(base, x -> x.k = {i})))").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    out = find_pii(df, id_col, text_col).select("id", *counts, F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"), F.expr(_joined("spans")).alias("spans"))
    return out.withColumnRenamed("id", id_col)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``df``, with each run of overlapping spans in the text replaced by
    its first kind in brackets, as [EMAIL]. A null text stays null; a row for every row;
    columns may have any names. Texts are cut at every 256th span first, as a substring's
    place is found by counting characters."""
    found = find_pii(df, id_col, text_col, rest=True).select("all", F.expr(_islands("spans")).alias("m"), F.col("all")[text_col].alias("t"))
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    inner = f"array_join(transform(u.own, (x, i) -> concat(substr(c, coalesce(get(u.own, i - 1).e, u.at) - u.at + 1, x.s - coalesce(get(u.own, i - 1).e, u.at)), {names}[x.k])), '')"
    text = f"""
        if(size(m) = 0, t, concat(
            array_join(transform(sequence(0, int((size(m) - 1) div 256)), g -> transform(transform(
                array(struct(slice(m, g * 256 + 1, 256) as own, coalesce(get(m, g * 256 - 1).e, 0) as at)),
                u -> struct(u.own as own, u.at as at, substr(t, u.at + 1, element_at(u.own, -1).e - u.at) as c)),
                u -> transform(array(u.c), c -> {inner})[0])[0]), ''),
            substr(t, element_at(m, -1).e + 1)))"""
    return found.withColumn("t", F.expr(text)).select(*[F.col("t").alias(c) if c == text_col else F.col("all")[c].alias(c) for c in df.columns])
