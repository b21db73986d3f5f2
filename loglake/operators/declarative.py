"""Sources that are declared in YAML: detection, extraction, types and normalisation are
compiled into column expressions."""

from __future__ import annotations

import pathlib
import re
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.functions.scalars import let, once, parse_ts, safe_double, safe_int, safe_port, strip_quotes, valid_ip
from loglake.operators.detect import valid_json
from loglake.operators.extract import Parsed, json_fields, lookup, strings, value
from loglake.schema import CATEGORIES, FIELDS

# Fields that may hold the time or an address, and words of outcomes.
TIME_FIELDS = ["time", "timestamp", "event_time", "devtime", "datetime", "date", "@timestamp", "rt", "ts"]
IP_FIELDS = ["src", "dst", "src_ip", "dst_ip", "source_ip", "dest_ip", "srcip", "dstip", "remip", "locip"]
GOOD = ["allow", "permit", "permitted", "accept", "success", "login_success", "ok", "pass"]
BAD = ["deny", "denied", "block", "blocked", "drop", "dropped", "reject", "fail", "failure", "failed", "error"]
IGNORED = ["end_pattern", "match_mode", "max_lines_per_event", "source_tag_prefix"]


def extract_kv(s: Column, pair_delim: str = " ", kv_delim: str = "=", quotes: bool = True) -> Column:
    """key=value pairs with quoted or plain values; else a plain split at the delimiters."""
    kv, pd = re.escape(kv_delim), re.escape(pair_delim)
    pat = rf"""(?:^|[\s{pd}])([a-zA-Z0-9_.-]+){kv}("[^"]*"|'[^']*'|\S+)"""
    keys, vals = F.regexp_extract_all(s, F.lit(pat), F.lit(1)), F.regexp_extract_all(s, F.lit(pat), F.lit(2))
    vals = F.transform(vals, strip_quotes)
    parts = F.filter(F.split(s, pd), lambda p: F.contains(p, F.lit(kv_delim)))
    cut = lambda p: F.trim(F.substr(p, F.instr(p, kv_delim) + len(kv_delim)))
    plain = F.map_from_arrays(F.transform(parts, lambda p: F.trim(F.substring_index(p, kv_delim, 1))), F.transform(parts, (lambda p: strip_quotes(cut(p))) if quotes else cut))
    return F.when(F.size(keys) > 0, F.map_from_arrays(keys, vals)).otherwise(plain)


def _named(parts: Column, columns: list[str]) -> Column:
    """Parts by name, those without one as col_0, col_1, ..."""
    given = F.array(*[F.lit(c) for c in columns]) if columns else F.array().cast("array<string>")
    return F.map_from_entries(F.transform(parts, lambda p, i: F.struct(F.coalesce(F.get(given, i), F.concat(F.lit("col_"), i)).alias("k"), F.trim(p).alias("v"))))


def extract_csv(s: Column, columns: list[str], delim: str = ",") -> Column:
    """Quote-aware: a delimiter counts where an even number of quotes follows it."""
    parts = F.split(s, re.escape(delim) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    bare = lambda p: F.when(F.trim(p).rlike('^".*"$'), F.replace(F.regexp_replace(F.trim(p), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(p)
    return _named(F.transform(parts, bare), columns)


def extract_delimited(s: Column, columns: list[str], delim: str = "|") -> Column:
    return _named(F.split(s, re.escape(delim), -1), columns)


def extract_json_paths(s: Column, paths: dict[str, str]) -> Column:
    """Top-level keys, and values at dotted paths with indexes as a.b[0].c."""
    found = [F.struct(F.lit(k).alias("k"), value(F.get_json_object(s, "$." + p)).alias("x")) for k, p in paths.items()]
    top = json_fields(s)
    return F.map_concat(top, F.map_from_entries(F.array(*found))) if found else top


def java_pattern(pattern: str, flags: list[str] | None = None) -> tuple[str, dict[str, int]]:
    """A Python pattern for Java: names of groups are taken off, and map to their numbers."""
    names = dict(re.compile(pattern).groupindex)
    bare = re.sub(r"\(\?P<\w+>", "(", pattern)
    on = "".join(sorted({{"ignorecase": "i", "multiline": "m", "dotall": "s"}.get(f.lower(), f.lower()) for f in flags or []} & set("ims")))
    return f"(?U{on})" + bare, names


def extract_regex(s: Column, pattern: str, flags: list[str] | None = None) -> Column:
    """Named groups of the first match; null where nothing matches."""
    p, names = java_pattern(pattern, flags)
    pairs = [x for k, i in names.items() for x in (F.lit(k), F.regexp_extract(s, p, i))]
    return F.when(s.rlike(p), F.create_map(*pairs))


def convert(c: Column, kind: str) -> Column:
    """The text of a converted value; what does not convert stays as it is, blank is null."""
    s = F.nullif(F.trim(c), F.lit(""))
    number = s.try_cast("double")
    iso = lambda ts: F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    micros = lambda f: F.timestamp_micros((number * f).try_cast("bigint"))
    made = {
        "int": safe_int(s).cast("string"),
        "float": safe_double(s).cast("string"),
        "bool": F.lower(s).isin("true", "1", "yes", "t", "y").cast("string"),
        "port": safe_port(s).cast("string"),
        "ip": valid_ip(s),
        "iso_timestamp": iso(parse_ts(s)),
        "epoch_timestamp_s": iso(micros(1e6)),
        "epoch_timestamp_ms": iso(micros(1e3)),
        "epoch_timestamp_us": iso(micros(1.0)),
    }.get(kind, s)
    return made if kind == "port" else F.coalesce(made, s)


TAGS = {"int": "long", "float": "double", "bool": "boolean", "port": "long"}


def convert_types(fields: Column, types: dict[str, str]) -> Column:
    """A map of fields with the given ones converted."""
    if not types:
        return fields

    def one(k: Column, v: Column) -> Column:
        out = v
        for name, kind in types.items():
            text = convert(v["v"], kind)
            tag = F.when(text.isNull(), "null").when(F.lit(kind in TAGS) & (safe_double(text).isNotNull() | text.isin("true", "false")), TAGS.get(kind, "string")).otherwise("string")
            out = F.when(k == name, F.struct(text.alias("v"), tag.alias("t"))).otherwise(out)
        return out

    return F.transform_values(fields, one)


def resolve_event_time(fields: Column, field: str | dict | None) -> Column:
    name = field.get("field") if isinstance(field, dict) else field
    names = ([name] if name else []) + TIME_FIELDS
    return F.coalesce(*[parse_ts(F.try_element_at(fields, F.lit(n))["v"]) for n in names])


class SourceRule:
    """A compiled definition of a source."""

    def __init__(self, cfg: dict):
        self.cfg = cfg
        self.name = cfg.get("name", "custom_declarative")
        self.vendor, self.product = cfg.get("vendor", "Custom"), cfg.get("product", "CustomProduct")
        self.version, self.enabled = str(cfg.get("version", "1.0.0")), bool(cfg.get("enabled", True))
        self.log_format = cfg.get("log_format", self.name)
        self.parser, self.detection = cfg.get("parser") or {}, cfg.get("detection") or {}
        self.fields, self.norm = cfg.get("fields") or {}, cfg.get("normalize") or {}
        for k in IGNORED:
            if k in self.detection or k in (cfg.get("framing") or {}):
                warnings.warn(f"source {self.name}: {k} has no effect", stacklevel=2)
        if self.parser.get("type", "key_value") not in ("key_value", "csv", "json", "regex", "delimiter"):
            raise ValueError(f"source {self.name}: unknown parser type {self.parser.get('type')!r}")
        if self.parser.get("type") == "regex":
            re.compile(self.parser["pattern"])

    def predicate(self, line: Column) -> Column:
        s, d = F.btrim(line, F.lit(" \t\r\n")), self.detection
        conds = [s != ""]
        if d.get("prefix"):
            conds.append(s.startswith(d["prefix"]))
        if d.get("contains"):
            words = [d["contains"]] if isinstance(d["contains"], str) else d["contains"]
            hits = [s.contains(w) for w in words]
            out = hits[0]
            for h in hits[1:]:
                out = (out & h) if d.get("contains_mode", "all") == "all" else (out | h)
            conds.append(out)
        if d.get("regex"):
            conds.append(s.rlike(java_pattern(d["regex"])[0]))
        if d.get("json_keys"):
            keys = F.json_object_keys(s)
            conds += [valid_json(s), *[F.coalesce(F.array_contains(keys, k), F.lit(False)) for k in d["json_keys"]]]
        if len(conds) == 1:  # nothing is declared: what the parser could take
            kind = self.parser.get("type")
            if kind == "regex":
                conds.append(s.rlike(java_pattern(self.parser["pattern"], self.parser.get("flags"))[0]))
            elif kind == "json":
                conds.append(s.startswith("{") & s.endswith("}"))
            elif kind == "key_value":
                conds.append(s.contains(self.parser.get("kv_delimiter", "=")))
        out = conds[0]
        for c in conds[1:]:
            out = out & c
        return F.coalesce(out, F.lit(False)) if self.enabled else F.lit(False)

    def parsed(self, s: Column) -> Column:
        p, kind = self.parser, self.parser.get("type", "key_value")
        cols = p.get("columns", [])
        if kind == "key_value":
            m = strings(extract_kv(s, p.get("pair_delimiter", " "), p.get("kv_delimiter", "="), p.get("strip_quotes", True)))
        elif kind == "csv":
            m = strings(extract_csv(s, cols, p.get("delimiter", ",")))
        elif kind == "json":
            m = extract_json_paths(s, p.get("json_paths") or {})
        elif kind == "regex":
            m = strings(extract_regex(s, p["pattern"], p.get("flags")))
        else:
            m = strings(extract_delimited(s, cols, p.get("delimiter", "|")))
        ok = valid_json(s) if kind == "json" else F.lit(True)
        return let(convert_types(m, self.fields.get("types") or {}), lambda m: self._parsed(m, ok))

    def _parsed(self, m: Column, ok: Column) -> Column:
        m = F.transform_values(m, lambda k, v: F.when(k.isin(IP_FIELDS) & (v["t"] == "string"), F.struct(F.coalesce(valid_ip(v["v"]), v["v"]).alias("v"), v["t"].alias("t"))).otherwise(v))
        return Parsed(m, resolve_event_time(m, self.fields.get("timestamp")), m.isNotNull() & ok)

    def _ref(self, expr) -> Column:
        """A field where one has this name, else the text itself."""
        if expr is None:
            return F.lit(None).cast("string")
        e = str(expr).strip()
        if e.startswith("_literal:"):
            return F.lit(e.split(":", 1)[1])
        m = F.col("extracted")
        return F.when(F.map_contains_key(m, F.lit(e)), F.try_element_at(m, F.lit(e))["v"]).otherwise(F.lit(e))

    def normalized(self) -> dict[str, Column]:
        r = lambda k, d=None: self._ref(self.norm.get(k, d))
        cat = F.lower(r("event.category", "network"))
        action, given = r("event.action"), r("event.outcome")
        words = lambda c: F.when(F.lower(c).isin(GOOD), "success").when(F.lower(c).isin(BAD), "failure").otherwise("unknown")
        first = F.coalesce(F.nullif(given, F.lit("")), F.when(F.nullif(action, F.lit("")).isNotNull(), words(action)))
        table = (self.norm.get("value_mappings") or {}).get("outcome")
        outcome = F.coalesce(lookup({str(k).lower(): v for k, v in table.items()}, F.lower(first)), first) if table else F.when(first.isNotNull(), words(first))
        none, vendor_type = F.lit(None).cast("string"), r("event.event_type_vendor_specific")
        used = ["timestamp_dt", *[v for v in self.norm.values() if isinstance(v, str)], *[v for v in self.fields.values() if isinstance(v, str)]]
        bag = F.map_filter("extracted", lambda k, v: ~k.isin(used) & ~k.startswith("_")) if self.norm.get("retain_unmapped", True) else F.create_map().cast(FIELDS)
        s = lambda **m: F.struct(*[c.alias(k) for k, c in m.items()])
        return {
            "source": s(vendor=r("source.vendor", f"_literal:{self.vendor}"), product=r("source.product", f"_literal:{self.product}"), device_hostname=r("source.device_hostname"), source_ip=r("source.source_ip"), log_format=F.lit(self.log_format)),
            "event": s(
                category=F.when(cat.isin(CATEGORIES), cat).otherwise("unknown"), class_name=none, class_uid=none.cast("int"), activity_name=none, activity_id=none.cast("int"), action=action, outcome=outcome,
                severity_numeric=F.coalesce(safe_double(r("event.severity_numeric")), F.lit(5.0)), severity_original=r("event.severity_original"), severity_inferred=none.cast("boolean"), event_type_vendor_specific=vendor_type,
            ),
            "network": s(
                src_ip=r("network.src_ip"), src_port=safe_port(r("network.src_port")), dst_ip=r("network.dst_ip"), dst_port=safe_port(r("network.dst_port")), protocol=F.lower(r("network.protocol")),
                bytes_in=safe_int(r("network.bytes_in")), bytes_out=safe_int(r("network.bytes_out")), direction=r("network.direction"), interface=r("network.interface"),
            ),
            "identity": s(username=r("identity.username"), user_domain=r("identity.user_domain")),
            "rule": s(rule_id=r("rule.rule_id"), rule_name=r("rule.rule_name"), policy_action=r("rule.policy_action")),
            "vendor_attributes": bag,
        }


def load_sources(path: str) -> list[SourceRule]:
    """The definitions of a folder; a bad one is refused here."""
    import yaml

    return [SourceRule(yaml.safe_load(f.read_text(encoding="utf-8")) or {}) for f in sorted(pathlib.Path(path).glob("*.y*ml"))]


def normalize_declarative(df: DataFrame, rule: SourceRule) -> DataFrame:
    return df.withColumns(rule.normalized())


def extract_declarative(df: DataFrame, rule: SourceRule) -> DataFrame:
    df = once(df, {"_p": rule.parsed(F.btrim(F.col("line"), F.lit(" \t\r\n")))})
    cols = {"extracted": F.col("_p.fields"), "event_ts": F.col("_p.ts"), "parse_error": F.when(~F.col("_p.ok"), F.lit("not a valid line of " + rule.name))}
    return df.withColumns(cols).drop("_p")


def dry_run(sample: DataFrame, rule: SourceRule) -> DataFrame:
    """One row: lines, matched, extracted, with a time, and how many fields were found."""
    d = extract_declarative(sample.withColumn("_m", rule.predicate(F.col("line"))), rule)
    good = F.col("_m") & F.col("parse_error").isNull()
    return d.agg(F.count(F.lit(1)).alias("lines"), F.count_if("_m").alias("matched"), F.count_if(good).alias("extracted"), F.count_if(good & F.col("event_ts").isNotNull()).alias("timed"), F.count_if(F.col("_m") & F.col("parse_error").isNotNull()).alias("errors"))


# What a field's name says about its role.
ROLES = [
    ("network.src_port", "srcport|spt|src_port|sport"), ("network.src_ip", "srcip|src_ip|src|source|client_ip|clientip"), ("network.dst_port", "dstport|dpt|dst_port|dport"),
    ("network.dst_ip", "dstip|dst_ip|dst|dest|server_ip|serverip"), ("identity.username", "user|usr"), ("event.action", "action|act|status"), ("network.protocol", "proto"), ("timestamp", "time|date|ts"),
]


def key_profile(sample: DataFrame) -> DataFrame:
    """(key, n, coverage, role): the keys of key=value or JSON lines and what they may be."""
    s = F.btrim(F.col("line"), F.lit(" \t\r\n"))
    keys = F.when(valid_json(s), F.json_object_keys(s)).otherwise(F.map_keys(extract_kv(s)))
    total = sample.count()
    role = F.lit(None).cast("string")
    for name, words in reversed(ROLES):
        role = F.when(F.lower("key").rlike(words), name).otherwise(role)
    n = sample.select(F.explode(F.array_distinct(keys)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("coverage", F.round(F.col("n") / max(1, total), 6)).withColumn("role", role)


def infer_source(sample: DataFrame, coverage: float = 0.5, name: str = "custom_source", vendor: str = "CustomVendor", product: str = "CustomLog") -> dict:
    """A draft definition from a table of lines: the format that most lines have, and roles of
    the keys that at least ``coverage`` of them have."""
    s = F.btrim(F.col("line"), F.lit(" \t\r\n"))
    kind = F.when(valid_json(s), "json").when(F.size(F.regexp_extract_all(s, F.lit(r"[\w.-]+=\S"), F.lit(0))) >= 3, "key_value").when(F.size(F.split(s, ",")) >= 4, "csv").when(F.size(F.split(s, r"\|")) >= 3, "pipe").when(F.size(F.split(s, "\t")) >= 3, "tab").otherwise("regex")
    top = sample.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split(s, ","))).alias("commas"), F.max(F.size(F.split(s, r"\|"))).alias("pipes"), F.max(F.size(F.split(s, "\t"))).alias("tabs")).orderBy(F.desc("n"), "kind").first()
    cfg = {"name": name.lower().replace(" ", "_"), "vendor": vendor, "product": product, "version": "1.0.0", "enabled": True, "detection": {}, "parser": {}, "fields": {"types": {}}, "normalize": {"retain_unmapped": True}}
    if top is None:
        return cfg
    k = top["kind"]
    if k in ("json", "key_value"):
        rows = key_profile(sample).filter(F.col("coverage") >= coverage).orderBy(F.desc("n"), "key").collect()  # keys, not lines
        cfg["parser"] = {"type": k} if k == "json" else {"type": k, "pair_delimiter": " ", "kv_delimiter": "=", "strip_quotes": True}
        names = [r["key"] for r in rows]
        cfg["detection"] = {"json_keys": names[:3]} if k == "json" else {"contains": [f"{n}=" for n in names[:2]], "contains_mode": "all"}
        for r in rows:
            if r["role"] == "timestamp":
                cfg["fields"].setdefault("timestamp", r["key"])
            elif r["role"]:
                cfg["normalize"].setdefault(r["role"], r["key"])
                if r["role"].endswith("_port"):
                    cfg["fields"]["types"][r["key"]] = "port"
    elif k == "regex":
        cfg["parser"] = {"type": "regex", "pattern": r"^(?P<timestamp>\S+)\s+(?P<hostname>\S+)\s+(?P<message>.*)$"}
        cfg["fields"]["timestamp"], cfg["normalize"]["source.device_hostname"] = "timestamp", "hostname"
    else:
        n, delim = {"csv": (top["commas"], ","), "pipe": (top["pipes"], "|"), "tab": (top["tabs"], "\t")}[k]
        cfg["parser"] = {"type": "csv" if k == "csv" else "delimiter", "delimiter": delim, "columns": [f"field_{i + 1}" for i in range(n)]}
    return cfg
