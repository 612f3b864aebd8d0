"""Trust: validation rules, normalisation, confidence, review queue, over entities.

entities: entity_id, run_id, seq, entity_type, raw_value, normalized_value, confidence, page_number, bbox (x0, y0, x1, y1), provider.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp, flexible_date, number, shown, weighted
from ..functions.text import alias_key, contract_literal, digits, keys_of_words, slug
from .relational import conflicts, repeats

SEVERITY = {"info": 1.0, "warning": 1.0, "error": 2.0, "critical": 3.0}
#: Confidence weights and priors; fixed values.
WEIGHTS = {"extraction": 0.20, "geometry": 0.10, "layout": 0.05, "table": 0.05, "validation": 0.25, "consistency": 0.10, "normalization": 0.15, "provider": 0.10}
PROVIDERS = {"groq": 0.85, "claude": 0.95, "openai": 0.93, "ollama": 0.75}
OTHER_PROVIDER = 0.80
RATE_HINT = r"(?i)exchange rate|fx rate|/\s?[a-z]{3}\b|per\s+[a-z]{3}\b"
HS_CODE = r"^\d{2}(\.?\d{2}){0,4}$"
SLUGGED = ("company", "organization", "vessel", "terminal")
REGISTERED = ("country", "currency", "unit", "incoterm")
#: Types of whose registry entry rules or normal forms take anything.
LOOKED_UP = (*REGISTERED, "commodity", "port")
#: Types of findings between entities.
BETWEEN = ("duplicate", "conflict", "consistency")


def given(c: str = "normalized_value", raw: str = "raw_value") -> Column:
    """The normalised value, or the raw one where it is null or empty."""
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(raw))


def with_alias(entities: DataFrame, aliases: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Entities with alias_id and alias_name: the registry entry of their type and key; aliases (registry, alias, canonical_id, canonical_name).

    kinds: types to look up, all by default. Others have no key and no entry; for aliases that are sent to all tasks, since rows without a key would be dealt to one."""
    a = aliases.select(F.col("registry").alias("entity_type"), F.col("alias").alias("_key"), F.col("canonical_id").alias("alias_id"), F.col("canonical_name").alias("alias_name"))
    key = alias_key(given()) if kinds is None else F.when(F.col("entity_type").isin(*kinds), alias_key(given()))
    return entities.withColumn("_key", key).join(a, ["entity_type", "_key"], "left").drop("_key")


def _read(entities: DataFrame, currencies: dict[str, str] | None = None, units: dict[str, str] | None = None) -> DataFrame:
    """Entities with what rules and normalisation read of a value, each made once a row and only for the types that ask for it."""
    kind, value = F.col("entity_type"), F.col("_value")
    of = lambda *kinds: F.when(kind.isin(*kinds), value)
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    first_of = lambda m, c: F.try_element_at(table(m), F.get(F.filter(keys_of_words(c), lambda k: k.isin(*m)), F.lit(0))) if m else F.lit(None).cast("string")
    return entities.withColumn("_value", given()).withColumns({
        "_number": number(of("currency", "price", "quantity")),
        "_day": flexible_date(of("date")),
        "_digits": digits(of("hs_code")),
        "_literal": contract_literal(of("contract")),
        "_slug": slug(of("commodity", "port", *SLUGGED)),
        "_hs": F.rlike(F.trim(of("hs_code")), F.lit(HS_CODE)),
        "_rate": F.rlike(F.when(kind.isin("currency", "price"), F.col("raw_value")), F.lit(RATE_HINT)),
        "_unit": first_of(units or {}, of("quantity")),
        "_currency": first_of(currencies or {}, of("price")),
    })


def _rules(year_now: int) -> list[tuple[str, str, str, Column, Column]]:
    """Rules on a row of _read(): rule_id, validation_type, severity, whether it applies, whether it is passed."""
    n, day = F.col("_number"), F.col("_day")
    box = F.col("bbox")
    bad_box = (box["x0"] < 0) | (box["y0"] < 0) | (box["x1"] <= box["x0"]) | (box["y1"] <= box["y0"]) | (box["x1"] > 5000) | (box["y1"] > 5000)
    kind = F.col("entity_type")
    return [
        ("date.impossible", "date", "error", kind == "date", day.isNotNull() & F.year(day).between(1990, year_now + 5)),
        ("currency.invalid_code", "currency", "error", kind == "currency", F.col("alias_id").isNotNull()),
        ("quantity.impossible", "quantity", "error", kind == "quantity", n.isNotNull() & (n >= 0) & (n <= 1e12)),
        ("hs_code.invalid_format", "hs_code", "error", kind == "hs_code", F.col("_hs")),
        ("incoterm.invalid_code", "incoterm", "error", kind == "incoterm", F.col("alias_id").isNotNull()),
        ("unit.unrecognized", "unit", "warning", kind == "unit", F.col("alias_id").isNotNull()),
        ("exchange_rate.impossible", "exchange_rate", "error", F.col("_rate") & n.isNotNull(), n.between(1e-4, 1e4)),
        ("geometry.impossible_bounding_box", "geometry", "error", box.isNotNull(), ~bad_box),
    ]


def _checked(read: DataFrame, year_now: int) -> DataFrame:
    """Rows of _read() with a column a rule: passed or not, null if the rule does not apply. Each is asked once a row."""
    return read.withColumns({f"_{r}": F.when(applies, F.coalesce(passed, F.lit(False))) for r, _, _, applies, passed in _rules(year_now)})


def _found(year_now: int) -> Column:
    """The findings of a row of _checked()."""
    passed = lambda r: F.col(f"`_{r}`")
    found = [F.when(passed(r).isNotNull(), F.struct(F.lit(r).alias("rule_id"), F.lit(t).alias("validation_type"), F.lit(s).alias("severity"), passed(r).alias("passed"))) for r, t, s, _, _ in _rules(year_now)]
    return F.array_compact(F.array(*found))


def _share(year_now: int, between: bool) -> Column:
    """The weight of the passed rules of a row of _checked() over that of all that apply, of those between entities or the others; null where none applies.

    Plain sums of the rules' columns: functions over the array of findings are not compiled, and cost more than all else of a row."""
    mine = [(F.col(f"`_{r}`"), SEVERITY[s]) for r, t, s, _, _ in _rules(year_now) if (t in BETWEEN) == between]
    total = lambda of: sum((F.when(of(p), w).otherwise(0.0) for p, w in mine), F.lit(0.0))
    return total(lambda p: p) / F.nullif(total(lambda p: p.isNotNull()), F.lit(0.0))


def entity_findings(entities: DataFrame, year_now: int) -> DataFrame:
    """entity_id, rule_id, validation_type, severity, passed of the entity rules that apply; entities come from with_alias()."""
    return _checked(_read(entities), year_now).select("run_id", "entity_id", F.explode(_found(year_now)).alias("f")).select("run_id", "entity_id", "f.*")


def cross_findings(entities: DataFrame) -> DataFrame:
    """Failing rows of the rules between entities: duplicates, and conflicting numbers."""
    e = entities.withColumn("_k", alias_key(F.col("raw_value"))).withColumn("_n", number(given()))
    fail = lambda df, rule, kind: df.select("run_id", "entity_id", F.lit(rule).alias("rule_id"), F.lit(kind).alias("validation_type"), F.lit("warning").alias("severity"), F.lit(False).alias("passed"))
    order = F.struct("seq", "entity_id")
    dup = repeats(e.withColumn("_o", order), ["run_id", "entity_type", "page_number", "_k"], "_o").select(F.col("_o.entity_id").alias("entity_id"))
    dup = e.join(dup, "entity_id", "left_semi")
    name = F.trim(F.regexp_replace("_k", r"[-+0-9.,]+", ""))
    conflict = conflicts(e.where(F.col("entity_type").isin("price", "quantity")).withColumn("_name", name), ["run_id", "entity_type", "page_number", "_name"], ["seq", "entity_id"], "_n")
    return fail(dup, "entity.duplicate", "duplicate").unionByName(fail(conflict, "entity.conflicting_values", "conflict"))


def totals_findings(cells: DataFrame) -> DataFrame:
    """table_id, column, stated, total, passed for each table whose first row named total or sum can be checked, within 2 %.

    cells: table_id, row, column, raw_value."""
    v = cells.withColumn("_n", number(F.col("raw_value")))
    total_row = v.where((F.col("column") == 0) & F.rlike(F.lower("raw_value"), F.lit("total|sum"))).groupBy("table_id").agg(F.min("row").alias("_total"))
    per = v.where("column > 0").join(total_row, "table_id").groupBy("table_id", "column").agg(F.max(F.when(F.col("row") == F.col("_total"), F.col("_n"))).alias("stated"), F.sum(F.when(F.col("row") != F.col("_total"), F.col("_n"))).alias("total"))
    top = F.greatest(F.abs("stated"), F.abs("total"))
    return per.where("stated is not null and total is not null").withColumn("passed", (top == 0) | (F.abs(F.col("stated") - F.col("total")) <= 0.02 * top))


#: Fields of a normal form.
FORM = ("canonical_id", "canonical_name", "normalized", "method", "confidence")


def _formed(read: DataFrame, prefixes: list[str]) -> DataFrame:
    """Rows of _read() with the normal form, a column a field, so that one that nobody asks for is not made; _form() puts them together.

    The case is found once a row, and fields go by its number: Spark compiles all this to one method, and long methods are left to the JVM's interpreter."""
    kind, value, d, n, day, literal, unit, currency = (F.col(c) for c in ("entity_type", "_value", "_digits", "_number", "_day", "_literal", "_unit", "_currency"))
    none = F.lit(None).cast("string")
    hs, named = F.concat(F.lit("hs:"), F.substring(d, 1, 2)), F.concat(kind, F.lit(":"), F.col("_slug"))
    cases = [  # condition; canonical_id, canonical_name, normalized, method, confidence
        (kind.isin(*LOOKED_UP) & F.col("alias_id").isNotNull(), F.col("alias_id"), F.col("alias_name"), none, "alias_lookup", 1.0),
        (kind == "commodity", named, value, none, "slug_derived_fallback", 0.5),
        (kind == "port", named, value, none, "slug_derived_fallback", 0.5),
        (kind.isin(*SLUGGED), F.concat(kind, F.lit(":"), F.substring("_slug", 1, 1000)), value, none, "slug_derived", 0.7),
        ((kind == "hs_code") & F.substring(d, 1, 2).isin(*prefixes), hs, none, none, "prefix_lookup", 0.8),
        ((kind == "hs_code") & (F.length(d) >= 6), hs, none, d, "format_normalized", 0.5),
        ((kind == "contract") & (literal != ""), F.concat(F.lit("contract:"), literal), value, literal, "literal_normalized", 0.6),
        ((kind == "date") & day.isNotNull(), none, none, day.cast("string"), "value_parsed", 0.9),
        ((kind == "quantity") & n.isNotNull() & unit.isNotNull(), none, none, F.concat_ws(" ", shown(n), unit), "value_parsed", 0.9),
        ((kind == "price") & n.isNotNull() & currency.isNotNull(), none, none, F.concat_ws(" ", shown(n), currency), "value_parsed", 0.9),
        (kind.isin("quantity", "price") & n.isNotNull(), none, none, shown(n), "value_parsed", 0.6),
    ]
    unresolved = (none, none, none, "unresolved", 0.0)

    which = F.when(cases[0][0], 0)
    for k, case in enumerate(cases[1:], 1):
        which = which.when(case[0], k)
    values = [*(case[1:] for case in cases), unresolved]
    constant = lambda k: F.get(F.array(*[F.lit(v[k]) for v in values]), F.col("_case"))

    def field(k: int) -> Column:
        out = none
        for x in {id(v[k]): v[k] for v in values if v[k] is not none}.values():
            out = F.when(F.col("_case").isin(*[n for n, v in enumerate(values) if v[k] is x]), x).otherwise(out)
        return out

    fields = [*map(field, range(3)), constant(3), constant(4)]
    return read.withColumn("_case", which.otherwise(len(cases))).withColumns({f"_form_{name}": x for name, x in zip(FORM, fields)})


def _form() -> Column:
    return F.struct(*[F.col(f"_form_{name}").alias(name) for name in FORM])


def normalised(entities: DataFrame, prefixes: list[str], currencies: dict[str, str], units: dict[str, str]) -> DataFrame:
    """entity_id, canonical_id, canonical_name, normalized_value, method, confidence; entities come from with_alias().

    prefixes: two-digit commodity chapters; currencies, units: alias key to canonical id."""
    out = _formed(_read(entities, currencies, units), prefixes).select("entity_id", _form().alias("o"))
    return out.select("entity_id", "o.canonical_id", "o.canonical_name", F.col("o.normalized").alias("normalized_value"), "o.method", "o.confidence")


def judged(entities: DataFrame, year_now: int, prefixes: list[str], currencies: dict[str, str], units: dict[str, str]) -> DataFrame:
    """entities with findings, an array of what entity_findings() gives, validation and consistency, the shares of their weights that passed, and normal, what
    normalised() gives: all are of the row itself, so nothing is shuffled.

    For entities whose ids are their own; findings between entities are another table, for confidences()."""
    e = _formed(_checked(_read(entities, currencies, units), year_now), prefixes)
    shares = _share(year_now, False).alias("validation"), _share(year_now, True).alias("consistency")
    return e.select(*entities.columns, _found(year_now).alias("findings"), *shares, _form().alias("normal"))


def _weight(severity: Column) -> Column:
    w = F.lit(0.0)
    for name, x in SEVERITY.items():
        w = F.when(severity == name, x).otherwise(w)
    return w


def confidences(entities: DataFrame, findings: DataFrame, normal: DataFrame, tables: DataFrame, layout: DataFrame) -> DataFrame:
    """entity_id, the eight components and overall.

    tables: run_id, page_number, confidence; layout: run_id, page_number, is_multi_column."""
    w, between = _weight(F.col("severity")), F.col("validation_type").isin(*BETWEEN)
    ratio = lambda c: F.sum(F.when(c & F.col("passed"), w).otherwise(0.0)) / F.nullif(F.sum(F.when(c, w).otherwise(0.0)), F.lit(0.0))
    f = findings.where("entity_id is not null").groupBy("entity_id").agg(ratio(~between).alias("validation"), ratio(between).alias("consistency"))
    e = entities.join(f, "entity_id", "left").join(normal.select("entity_id", F.col("confidence").alias("_norm")), "entity_id", "left")
    return _components(e, tables, layout).select("run_id", "entity_id", *WEIGHTS, "overall")


def scored(entities: DataFrame, tables: DataFrame, layout: DataFrame, few: bool = False) -> DataFrame:
    """Entities of judged() with the components and overall that confidences() gives, from their own findings and normal form, row by row.

    few: the pages of tables and layout are so few that they are sent to all tasks."""
    e = entities.withColumn("_norm", F.col("normal.confidence"))
    return _components(e, tables, layout, few).select("run_id", "entity_id", "entity_type", "raw_value", "normalized_value", "seq", *WEIGHTS, "overall", "findings", "normal")


def _components(e: DataFrame, tables: DataFrame, layout: DataFrame, few: bool = False) -> DataFrame:
    """e with the components, of entities with validation, consistency and _norm, and overall."""
    t = tables.groupBy("run_id", "page_number").agg(F.avg("confidence").alias("table"))
    prior = F.lit(OTHER_PROVIDER)
    for name, x in PROVIDERS.items():
        prior = F.when(F.col("provider") == name, x).otherwise(prior)
    t, layout = (F.broadcast(t), F.broadcast(layout)) if few else (t, layout)
    e = e.join(t, ["run_id", "page_number"], "left").join(layout, ["run_id", "page_number"], "left")
    parts = {
        "extraction": clamp(F.col("confidence")),
        "geometry": F.when(F.col("bbox").isNotNull(), 1.0).otherwise(0.4),
        "layout": F.when(F.col("is_multi_column").isNull(), 0.85).when(F.col("is_multi_column"), 0.75).otherwise(1.0),
        "table": F.coalesce("table", F.lit(1.0)),
        "validation": F.coalesce("validation", F.lit(1.0)),
        "consistency": F.coalesce("consistency", F.lit(1.0)),
        "normalization": F.coalesce(clamp(F.col("_norm")), F.lit(0.0)),
        "provider": prior,
    }
    return e.withColumns(parts).withColumn("overall", F.round(clamp(weighted([(F.col(k), x) for k, x in WEIGHTS.items()])), 9))


def _reason(reason: Column, rank: Column) -> Column:
    return F.struct(reason.alias("reason"), rank.cast("int").alias("rank"))


def _low(overall: Column) -> Column:
    return _reason(F.when(overall < 0.4, "confidence very low").otherwise("confidence below threshold"), F.when(overall < 0.4, 3).otherwise(2))


def _failed(rule: Column, severity: Column) -> Column:
    rank = F.when(rule == "entity.conflicting_values", 3).when(severity == "critical", 4).when(severity == "error", 3).otherwise(1)
    return _reason(F.concat(F.when(rule == "entity.conflicting_values", "conflicting value: ").when(severity.isin("critical", "error"), "validation failed: ").otherwise("validation warning: "), rule), rank)


def _unresolved(normal: Column) -> Column:
    return F.when(normal["canonical_id"].isNull() & (normal["method"] == "unresolved"), _reason(F.lit("unresolved canonical identity"), F.lit(1)))


def _queue(reasons: DataFrame) -> DataFrame:
    all_ = reasons.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("t.reason")), "; ").alias("reason"), F.max("t.rank").alias("rank"))
    return all_.select("entity_id", "reason", F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), F.col("rank")).alias("priority"))


def review_queue(scores: DataFrame, findings: DataFrame, normal: DataFrame) -> DataFrame:
    """entity_id, reason (sorted, joined by "; ") and priority (the highest) of entities that need a look."""
    low = scores.where("overall < 0.6").select("entity_id", _low(F.col("overall")).alias("t"))
    failed = findings.where("not passed and entity_id is not null").select("entity_id", _failed(F.col("rule_id"), F.col("severity")).alias("t"))
    unknown = normal.select("entity_id", _unresolved(F.struct("canonical_id", "method")).alias("t")).where("t is not null")
    return _queue(low.unionByName(failed).unionByName(unknown))


def review_of(scores: DataFrame) -> DataFrame:
    """What review_queue() gives for entities of scored(), from their own rows: only reasons are shuffled."""
    failed = F.transform(F.filter("findings", lambda x: ~x["passed"]), lambda x: _failed(x["rule_id"], x["severity"]))
    one = F.array(F.when(F.col("overall") < 0.6, _low(F.col("overall"))), _unresolved(F.col("normal")))
    return _queue(scores.select("entity_id", F.explode(F.concat(F.array_compact(one), failed)).alias("t")))
