"""Line deduplication by a segment-partition edit join.

Lines within edit distance t are linked; t follows the length of the shorter line
(``BANDS``). A line is split into t + 1 even segments; one of them must occur unchanged in
a line within t edits, near its own place. So each line is indexed by (its length, segment
number, segment), and probes the lengths it may link to with the substrings around each
segment's place. Where many lines share a key and differ in a few characters only, as lines
of one template do, these characters are matched by their variants, each a star around one
line. Where they differ in more, the same split is done again on the side of the match that
may hold the most edits, as often as it takes: lines then meet only if they share that piece
too. Pairs that meet are compared by the parities of
their characters and verified by a bit-parallel edit distance in a band of 2t + 2 rows. Linked lines and exact copies form classes, of which the first
line stays.

Everything is DataFrame expressions. Keys are 64-bit hashes; a line is identified by its
hash and length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import SPACES, join_salted, materialize
from loglake.llm.components import components

#: (least characters of the shorter line, edits of a link); 0: exact copies only.
BANDS = ((0, 0), (16, 1), (128, 2))
#: Keys of more lines than this are matched by what differs in them, or split further.
CROWD = 512
#: Places of the filter that is broadcast before texts are moved.
PLACES = 1 << 18


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("pos", "l"))


def _segment(n: str, i: int, t: int) -> tuple[str, str]:
    """SQL: start (from 1) and length of segment ``i`` (from 1) of a line of ``n`` characters;
    the last ones take what is left over."""
    k = t + 1
    base, extra = f"({n} div {k})", f"({n} % {k})"
    first = f"greatest(0, {i - 1} - ({k} - {extra}))"
    return f"({i - 1} * {base} + {first} + 1)", f"({base} + if({i} > {k} - {extra}, 1, 0))"


def _probes(t: int):
    """(d, i, o, role): a line's segment i, moved by o, is looked for in lines shorter by d.
    Role 0 is the index, which lines of the same length share as probes."""
    for d in range(t + 1):
        for i in range(1, t + 2):
            for o in range(max(-(i - 1), d - (t + 1 - i)), min(i - 1, d + (t + 1 - i)) + 1):
                yield d, i, o, int(bool(d or o))


def _for_each_probe(bands, item: str) -> str:
    """SQL: the array of ``item`` for every probe ``x`` of a line of ``n`` characters; in it,
    {m} is the other length, {p} and {q} the segment's starts in both lines, {w} its length.

    A lambda over a list of probes, as a spelled-out array of them all is too much code for
    the compiler. Near the ends of a band, the list depends on the other line's length."""
    most = max(t for _, t in bands)
    list_of = lambda t: ", ".join(f"struct({d} as d, {t} as t, {i} as i, {o} as o, {role} as role)" for d, i, o, role in _probes(t)) if t else ""
    every = ", ".join(x for x in (list_of(t) for _, t in bands) if x)
    band = " ".join(f"when n - x.d >= {least} then {t}" for least, t in sorted(bands, reverse=True))
    cases, above = [], 1 << 30
    for least, t in sorted(bands, reverse=True):
        if t:
            cases.append(f"when n >= {least + most} AND n < {above} then array({list_of(t)})")
        above = least
    kind = "array<struct<d: int, t: int, i: int, o: int, role: int>>"
    probes = f"case {' '.join(cases)} when n < {min(least for least, t in bands if t)} then cast(array() as {kind}) else filter(array({every}), x -> x.t = case {band} else 0 end) end"
    base, extra = "((n - x.d) div (x.t + 1))", "((n - x.d) % (x.t + 1))"
    q = f"int((x.i - 1) * {base} + greatest(0, x.i - 2 - x.t + {extra}) + 1)"
    w = f"int({base} + if(x.i > x.t + 1 - {extra}, 1, 0))"
    return f"transform({probes}, x -> {item.format(m='(n - x.d)', q=q, w=w, p=f'({q} + x.o)')})"


#: A key with its role as the last bit. ``b`` is the line in UTF-32, where a substring is
#: found without counting characters.
_KEY = "((xxhash64({m}, x.i, substr(b, 4 * {p} - 3, 4 * {w})) & -2L) | x.role)"
#: The same with the side that may hold the most edits, its length in the other line, edits.
_PART = f"""if(2 * x.i <= x.t + 2,
    struct({_KEY} as key, substr(l, {{p}} + {{w}}) as s, int({{m}} - {{q}} - {{w}} + 1) as yl, x.t + 1 - x.i as e, x.t as t),
    struct({_KEY} as key, substr(l, 1, {{p}} - 1) as s, int({{q}} - 1) as yl, x.i - 1 as e, x.t as t))"""


def _finer(e: int) -> str:
    """SQL: the keys of the next split of ``s``, for ``e`` edits."""
    out = []
    for j in range(1, e + 2):
        q, w = _segment("yl", j, e)
        right = e + 1 - j >= j - 1
        for o in range(-(j - 1), j):
            fits = f"abs(length(s) - yl - {o}) <= {e + 1 - j} AND {q} + {o} >= 1"
            s, yl, e2 = (f"substr(s, {q} + {o} + {w})", f"(yl - {q} - {w} + 1)", e + 1 - j) if right else (f"substr(s, 1, {q} + {o} - 1)", f"({q} - 1)", j - 1)
            key = f"((xxhash64(key & -2L, {j}, substr(s, {q} + {o}, {w})) & -2L) | {'key & 1' if o == 0 else '1L'})"
            out.append(f"if({fits}, struct({key} as key, {s} as s, int({yl}) as yl, {e2} as e, t), null)")
    return f"filter(array({', '.join(out)}), x -> x is not null)"


def within(x: str, y: str, t: int) -> str:
    """SQL condition: the edit distance of ``x`` and ``y``, of ``t`` characters or more, is
    ``t`` at most. ``t`` is at least 1.

    Bit-parallel in a band: column j holds the vertical differences of rows j + t - 2t - 1
    to j + t of the table in the bits of two numbers, and a step moves the band down by
    one. The value on the band's lowest diagonal is counted; from the last row on, that row.
    """
    width = 2 * t + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    start = ((1 << (t + 1)) - 1) << (width - t - 1)
    match = " | ".join(f"if(get(s.x, j + {t - width + k}) = get(s.y, j - 1), {1 << k}L, 0L)" for k in range(width))
    # one column: the matches m; then d0; then the horizontal differences hp and hn
    d0 = "((((m & a.vp) + a.vp) ^ a.vp) | m | a.vn)"
    row = f"shiftleft(1L, int({width - 1} - (j - s.n + {t})))"
    step = f"""
      transform(transform(transform(array({match}),
        m -> struct({d0} & {full}L as d0)),
        u -> struct(u.d0 as d0, (a.vn | ~(u.d0 | a.vp)) & {full}L as hp, u.d0 & a.vp as hn)),
        u -> struct((u.hn | ~(shiftright(u.d0, 1) | u.hp)) & {full}L as vp, shiftright(u.d0, 1) & u.hp as vn,
          a.d + if(j <= s.n - {t}, if((u.d0 & {top}L) = 0, 1, 0), if((u.hp & {row}) != 0, 1, 0) - if((u.hn & {row}) != 0, 1, 0)) as d))[0]"""
    # what both start or end with, but for t + 1 characters, changes nothing; found by halving
    most = f"least(length({x}), length({y}))"
    steps = "array(" + ", ".join(str(1 << k) for k in range(16, -1, -1)) + ")"
    head = f"aggregate({steps}, 0, (p, k) -> if(p + k <= {most} AND substr({x}, p + 1, k) = substr({y}, p + 1, k), p + k, p), p -> greatest(0, p - {t + 1}))"
    tail = f"aggregate({steps}, 0, (p, k) -> if(p + k <= {most} - h AND substr({x}, -p - k, k) = substr({y}, -p - k, k), p + k, p), p -> greatest(0, p - {t + 1}))"
    middle = lambda c: f"split(substr({c}, c.h + 1, length({c}) - c.h - c.e), '')"
    cut = f"transform(transform(array({head}), h -> struct(h as h, {tail} as e)), c -> struct({middle(x)} as x, {middle(y)} as y, length({x}) - c.h - c.e as n))"
    # the characters stay outside the state, which is copied in each step; a value on the
    # lowest diagonal never falls, and the last row takes 2t off it at most
    return f"""(abs(length({x}) - length({y})) <= {t} AND transform({cut}, s ->
      aggregate(sequence(1, size(s.y)), struct({start}L as vp, 0L as vn, {t} as d), (a, j) -> if(a.d > {3 * t}, a, {step}), a -> a.d))[0] <= {t})"""


def _common(x: str, y: str, most: str, back: bool) -> str:
    """SQL: the number of characters, up to ``most``, that two texts begin (or end) with."""
    steps = "array(" + ", ".join(str(1 << k) for k in range(16, -1, -1)) + ")"
    part = (lambda c: f"substr({c}, -p - k, k)") if back else (lambda c: f"substr({c}, p + 1, k)")
    return f"aggregate({steps}, 0, (p, k) -> if(p + k <= {most} AND {part(x)} = {part(y)}, p + k, p))"


def _variants(t: int) -> str:
    """SQL: the keys by which texts ``m`` (longer by ``d`` than the shortest of their group) of
    ``t`` edits meet, as (kind and text, whether it is an index).

    All holders of a key are within ``t`` edits of each of its index holders: texts of one
    length with up to t signs masked (substitutions), or, for two edits, with one sign left
    out (one more and one less); longer texts with their surplus left out, and the sign
    masked that may be changed besides."""
    n, mark = "length(m)", "char(1)"
    masked = lambda c, i: f"concat(substr({c}, 1, {i} - 1), {mark}, substr({c}, {i} + 1))"
    without = lambda c, i: f"concat(substr({c}, 1, {i} - 1), substr({c}, {i} + 1))"
    places = lambda size: f"if({size} > 0, sequence(1, {size}), cast(array() as array<int>))"
    each = lambda size, item, v: f"transform({places(size)}, {v} -> {item})"
    row = lambda kind, text, index: f"struct(concat('{kind}', {text}) as v, {str(index).lower()} as index)"
    none = "cast(array() as array<struct<v: string, index: boolean>>)"
    if t == 1:
        same = f"concat(array({row('D', 'm', True)}), {each(n, row('A', masked('m', 'i'), True), 'i')})"
        return f"case d when 0 then {same} when 1 then {each(n, row('D', without('m', 'i'), False), 'i')} else {none} end"
    pair = lambda item: f"flatten(transform({places(n)}, i -> transform({places(f'{n} - i')}, j -> {item})))"  # noqa: E731  i < i + j
    same = f"concat(array({row('D', 'm', True)}, {row('C', 'm', True)}, {row('A', 'm', True)}), {each(n, row('C', masked('m', 'i'), True), 'i')}, {each(n, row('B', without('m', 'i'), True), 'i')}, if({n} = 1, array({row('A', mark, True)}), {pair(row('A', masked(masked('m', '(i + j)'), 'i'), True))}))"
    one = f"flatten({each(n, f'concat(array({row("C", without("m", "i"), False)}), transform({places(f"{n} - 1")}, k -> {row("C", masked(without("m", "i"), "k"), False)}))', 'i')})"
    two = pair(row("D", without(without("m", "(i + j)"), "i"), False))
    return f"case d when 0 then {same} when 1 then {one} when 2 then {two} else {none} end"


#: Most characters of what differs in a crowded key's lines for their variants to be listed.
NARROW = 12


def _narrow(many: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, rest) of crowded keys. What all lines of a key begin and end with is cut off; it
    does not change a distance. Where only ``NARROW`` characters or fewer are left, as in
    lines of one template, the lines meet by variants of these. Each key of a variant is a
    star around one line that is within the edits of all others, so there are as many pairs
    as keys, however many lines there are. Other keys are the rest, to be split further."""
    whole = materialize(many.select("key", "role", "h", "t", "size").join(texts.select("h", "n", "l"), "h"), "line-crowds")
    total = whole.count()
    pivots = whole.groupBy("key").agg(F.min_by("l", "h").alias("pivot"), F.max("size").alias("size"))
    near = join_salted(whole.drop("size"), pivots, ["key"], "size", total)
    short = "least(length(l), length(pivot))"
    near = near.withColumn("head", F.expr(_common("l", "pivot", short, False))).withColumn("tail", F.expr(_common("l", "pivot", short, True)))
    ends = near.groupBy("key").agg(F.min("head").alias("head"), F.min("tail").alias("tail"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("size").alias("size"))
    ends = ends.withColumn("tail", F.least("tail", F.col("least") - F.col("head"))).filter(F.col("most") - F.col("head") - F.col("tail") <= NARROW)
    ends = materialize(ends.select("key", "head", "tail", "least", "size"), "line-ends")
    rest = many.join(ends.select("key"), "key", "left_anti")
    middle = join_salted(whole.drop("size"), ends, ["key"], "size", total).withColumn("m", F.expr("substr(l, head + 1, n - head - tail)")).withColumn("d", F.expr("n - least"))
    kinds = " ".join(f"when t = {t} then {_variants(t)}" for t in (1, 2))
    rows = middle.select("key", "role", "h", F.explode(F.expr(f"case {kinds} end")).alias("v"))
    rows = rows.select(F.xxhash64("key", "v.v").alias("key"), "h", (F.col("v.index") & (F.col("role") == 0)).alias("index"))
    stars = rows.groupBy("key").agg(F.min(F.when(F.col("index"), F.col("h"))).alias("center"), F.min("h").alias("a"), F.max("h").alias("b"), F.count(F.lit(1)).alias("size"))
    stars = materialize(stars.filter("center IS NOT NULL AND a <> b").select("key", "center", "size"), "line-stars")
    met = join_salted(rows.select("key", "h"), stars, ["key"], "size", stars.agg(F.sum("size")).first()[0] or 0).filter("h <> center")
    return met.select(F.least("h", "center").alias("a"), F.greatest("h", "center").alias("b")).distinct(), rest


def _pairs(parts: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) of lines that share a key and whose character parities allow ``most``
    edits. Rows: key with the role as its last bit, h, odd, s, yl, e, t. Crowded keys whose
    lines differ in few places meet there; others are split until they are small or nothing
    is left to split."""
    out = []
    while True:
        parts = materialize(parts.withColumn("role", F.col("key").bitwiseAND(1)).withColumn("key", F.col("key").bitwiseAND(-2)), "line-parts")
        sizes = parts.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("role").alias("least"), F.min("h").alias("a"), F.max("h").alias("b"))
        met = join_salted(parts, sizes.filter("a <> b AND least = 0").select("key", "size"), ["key"], "size", parts.count())
        met = materialize(met, "line-met")
        many = met.filter(f"size > {CROWD}")
        few = met.filter(f"size <= {CROWD}")
        crowded = not many.isEmpty()
        if crowded:
            pairs, many = _narrow(many, texts)
            out.append(materialize(pairs, "line-pairs"))
            many = materialize(many, "line-many")
            few = few.unionByName(many.filter("yl <= e"))
            many = many.filter("yl > e")
        x, y = few.select("key", "h", "role", "odd").alias("x"), few.filter("role = 0").select("key", "h", "odd").alias("y")
        join = x.join(y, F.expr(f"x.key = y.key AND x.h <> y.h AND (x.role = 1 OR x.h < y.h) AND bit_count(x.odd ^ y.odd) <= {2 * most}"))
        out.append(materialize(join.select(F.expr("least(x.h, y.h) as a"), F.expr("greatest(x.h, y.h) as b")).distinct(), "line-pairs"))
        if not crowded or many.isEmpty():
            return reduce(DataFrame.union, out).distinct()
        many = many.select("h", "odd", F.col("key").bitwiseOR(F.col("role")).alias("key"), "s", "yl", "e", "t")
        cases = " ".join(f"when e = {e} then {_finer(e)}" for e in range(1, most + 1))
        parts = many.select("h", "odd", F.explode(F.expr(f"case {cases} end")).alias("p")).select("h", "odd", "p.*")


def line_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS) -> DataFrame:
    """One row per line: id, line_no (from 0), class_id, class_line_no, class_size, kept.

    A class is a connected set of lines, equal or within the edits that ``bands`` allow for
    the shorter of two, and is named by its first line in the order of (id, line_no), which
    is kept. Lines without a word are kept, each a class of its own. A null or empty text
    is one empty line. A null id goes before all others. Rows that share an id and line
    number are kept if one of them is the first. Other columns, whatever their names, are
    not read; an empty table gives no rows.
    """
    lines = _lines(df, id_col, text_col)
    n = F.length("l")
    counted = F.btrim("l", F.lit(SPACES)) != ""
    known = materialize(lines.select("id", "pos", n.alias("n"), F.when(counted, F.xxhash64("l")).alias("h")), "lines")
    copies = known.filter("h IS NOT NULL").groupBy("h", "n").agg(F.min(F.struct("id", "pos")).alias("first"), F.count(F.lit(1)).alias("size"))
    copies = materialize(copies, "copies")
    total = known.count()

    # keys that two different lines share, one of them by its index
    least = min([b for b, t in bands if t], default=1 << 30)
    joined = lines.filter(counted & (n >= least)).select(F.xxhash64("l").alias("h"), n.alias("n"), F.encode("l", "UTF-32").alias("b"))
    keys = joined.select("h", F.explode(F.expr(_for_each_probe(bands, _KEY))).alias("k")).select("h", F.col("k").bitwiseAND(-2).alias("key"), F.col("k").bitwiseAND(1).alias("role"))
    shared = keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.min("role").alias("role"), F.count(F.lit(1)).alias("size")).filter("a <> b AND role = 0")
    shared = materialize(shared.select("key", "size"), "shared-keys")
    key_rows = shared.agg(F.sum("size")).first()[0] or 0
    wanted = materialize(join_salted(keys.select("h", "key"), shared, ["key"], "size", key_rows).select("h").distinct(), "wanted-lines")

    # their text, from the first line of each; a filter of bounded size goes ahead of the join
    first = copies.join(wanted, "h", "left_semi").select(F.col("first.id").alias("i"), F.col("first.pos").alias("p"), F.col("h").alias("g"))
    places = wanted.select(F.pmod("h", F.lit(PLACES)).alias("place")).distinct()
    near = lines.filter(counted & (n >= least)).withColumn("h", F.xxhash64("l")).join(F.broadcast(places), F.pmod("h", F.lit(PLACES)) == F.col("place"), "left_semi")
    texts = near.join(first, F.col("id").eqNullSafe(F.col("i")) & (F.col("pos") == F.col("p")) & (F.col("h") == F.col("g"))).select("h", n.alias("n"), "l").dropDuplicates(["h"])
    # the characters that occur an odd number of times: an edit changes two of them at most
    texts = texts.withColumn("odd", F.expr("aggregate(split(l, ''), 0L, (a, c) -> a ^ shiftleft(1L, ascii(c) % 64))"))
    texts = materialize(texts, "line-texts")
    parts = texts.withColumn("b", F.encode("l", "UTF-32")).select("h", "odd", F.explode(F.expr(_for_each_probe(bands, _PART))).alias("k")).select("h", "odd", "k.*")
    pairs = _pairs(parts, texts, max(t for _, t in bands)) if least < 1 << 30 else texts.select(F.col("h").alias("a"), F.col("h").alias("b")).limit(0)
    j = pairs.join(texts.select(F.col("h").alias("a"), F.col("l").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("l").alias("y")), "b")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = j.repartition(parts, "a", "b")  # few rows, but each one takes time: a filter would go ahead of this
    fits = " ".join(f"when least(length(x), length(y)) >= {b} then {within('x', 'y', t) if t else 'false'}" for b, t in sorted(bands, reverse=True))
    links = materialize(j.select("a", "b", F.explode(F.expr(f"array(case {fits} end)")).alias("fit")).filter("fit").select("a", "b"), "line-links")

    comp = components(links).withColumnRenamed("node", "h")
    named = copies.join(comp, "h", "left").withColumn("component", F.coalesce("component", "h"))
    merged = named.groupBy("component").agg(F.min("first").alias("class"), F.sum("size").alias("class_size"))
    table = named.select("h", "n", "size", "component").join(merged, "component").select("h", "n", "size", "class", "class_size")
    table = materialize(table, "line-classes")
    # hot by its own copies: a class may have any number of distinct lines
    out = join_salted(known.filter("h IS NOT NULL"), table, ["h", "n"], "size", total).select("id", "pos", "class", "class_size")
    alone = known.filter("h IS NULL").select("id", "pos", F.struct("id", "pos").alias("class"), F.lit(1).cast("long").alias("class_size"))
    out = out.unionByName(alone)
    kept = F.col("id").eqNullSafe(F.col("class.id")) & (F.col("pos") == F.col("class.pos"))
    return out.select(F.col("id").alias(id_col), F.col("pos").alias("line_no"), F.col("class.id").alias("class_id"), F.col("class.pos").alias("class_line_no"), "class_size", kept.alias("kept"))


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """All columns of ``df``, with the lines left out that are not the first of their class.

    Documents without a repeated line, null texts and null ids are not changed; an empty
    table stays empty. Rows that share an id lose the lines of all of them. Further columns
    may have any names.
    """
    lines = line_classes(df, id_col, text_col, **how)
    gone = lines.filter(F.col("kept") == F.lit(False)).filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.collect_set("line_no").alias("gone"))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("all"))
    stay = F.expr("array_join(filter(split(t, '\\n'), (x, i) -> not array_contains(gone, i)), '\\n')")
    j = rows.join(gone, "id", "left").withColumn("t", F.when(F.col("gone").isNull(), F.col("t")).otherwise(stay))
    return j.select(*[F.col("t").alias(c) if c == text_col else F.col("all")[c].alias(c) for c in df.columns])
