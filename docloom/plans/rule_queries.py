"""Rules of trust, relations and times on entities and texts that are made of every line item and order.

A line item (order and number; the least of its rows) is one entity: its number picks one of the cases, its keys and quantity fill it in.
The expressions of raw values are read by both engines; what the rules should make of them is said beside them in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, retrieval, trust
from .catalogue import query, table

# type, raw value, rule, passed, canonical id, normalised value, method, confidence; over p (part), s (supplier), q (quantity), o (order).
CASES = [
    ("currency", "' usd '", "currency.invalid_code", "true", "'currency:USD'", "NULL", "alias_lookup", 1.0),
    ("currency", "printf('galleon %d', p)", "currency.invalid_code", "false", "NULL", "NULL", "unresolved", 0.0),
    ("hs_code", "printf('27%02d.%02d', p % 100, q)", "hs_code.invalid_format", "true", "'hs:27'", "NULL", "prefix_lookup", 0.8),
    ("hs_code", "printf('99.%02d.%02d', p % 100, q)", "hs_code.invalid_format", "true", "'hs:99'", "printf('99%02d%02d', p % 100, q)", "format_normalized", 0.5),
    ("hs_code", "printf('99%02d', q)", "hs_code.invalid_format", "true", "NULL", "NULL", "unresolved", 0.0),
    ("hs_code", "concat('coa', repeat('l', q))", "hs_code.invalid_format", "false", "NULL", "NULL", "unresolved", 0.0),
    ("incoterm", "'FOB'", "incoterm.invalid_code", "true", "'incoterm:FOB'", "NULL", "alias_lookup", 1.0),
    ("incoterm", "printf('X%d', p)", "incoterm.invalid_code", "false", "NULL", "NULL", "unresolved", 0.0),
    ("unit", "'MT'", "unit.unrecognized", "true", "'unit:metric_ton'", "NULL", "alias_lookup", 1.0),
    ("unit", "printf('%d armfuls', p)", "unit.unrecognized", "false", "NULL", "NULL", "unresolved", 0.0),
    ("price", "printf('fx rate %d', p * 10)", "exchange_rate.impossible", "p BETWEEN 1 AND 1000", "NULL", "printf('%d.0', p * 10)", "value_parsed", 0.6),
    ("price", "printf('%d.5 USD/INR', p % 100)", "exchange_rate.impossible", "true", "NULL", "printf('%d.5', p % 100)", "value_parsed", 0.6),
    ("price", "printf('%d USD', p)", None, "NULL", "NULL", "printf('%d.0 currency:USD', p)", "value_parsed", 0.9),
    ("price", "printf('%d', p)", None, "NULL", "NULL", "printf('%d.0', p)", "value_parsed", 0.6),
    ("price", "concat('dea', repeat('r', q))", None, "NULL", "NULL", "NULL", "unresolved", 0.0),
    ("quantity", "printf('%d MT', q - 25)", "quantity.impossible", "q >= 25", "NULL", "printf('%d.0 unit:metric_ton', q - 25)", "value_parsed", 0.9),
    ("quantity", "printf('%d sacks', p)", "quantity.impossible", "true", "NULL", "printf('%d.0', p)", "value_parsed", 0.6),
    ("quantity", "concat('man', repeat('y', q))", "quantity.impossible", "false", "NULL", "NULL", "unresolved", 0.0),
    ("date", "printf('%d January %d', p % 28 + 1, 1980 + o % 60)", "date.impossible", "1980 + o % 60 BETWEEN 1990 AND 2031", "NULL", "printf('%d-01-%02d', 1980 + o % 60, p % 28 + 1)", "value_parsed", 0.9),
    ("date", "printf('2026-02-%d', 30 + p % 2)", "date.impossible", "false", "NULL", "NULL", "unresolved", 0.0),
    ("country", "printf('Nation_%d', p % 25)", None, "NULL", "printf('country:%d', p % 25)", "NULL", "alias_lookup", 1.0),
    ("country", "printf('Atlantis %d', p)", None, "NULL", "NULL", "NULL", "unresolved", 0.0),
    ("commodity", "'Thermal  Coal'", None, "NULL", "'commodity:coal'", "NULL", "alias_lookup", 1.0),
    ("commodity", "printf('Fly Ash %d', p)", None, "NULL", "printf('commodity:fly_ash_%d', p)", "NULL", "slug_derived_fallback", 0.5),
    ("port", "'mundra'", None, "NULL", "'port:INMUN'", "NULL", "alias_lookup", 1.0),
    ("port", "printf('New Port %d', p)", None, "NULL", "printf('port:new_port_%d', p)", "NULL", "slug_derived_fallback", 0.5),
    ("company", "printf('Supplier#%09d Ltd.', s)", None, "NULL", "printf('company:supplier_%09d', s)", "NULL", "slug_derived", 0.7),
    ("organization", "printf('Port Trust %d', p)", None, "NULL", "printf('organization:port_trust_%d', p)", "NULL", "slug_derived", 0.7),
    ("vessel", "printf('MV Star %d', p)", None, "NULL", "printf('vessel:mv_star_%d', p)", "NULL", "slug_derived", 0.7),
    ("terminal", "printf('West Basin %d', p)", "geometry.impossible_bounding_box", "q > 25", "printf('terminal:west_basin_%d', p)", "NULL", "slug_derived", 0.7),
    ("contract", "printf(' ct-%d / a', o)", None, "NULL", "printf('contract:CT-%d/A', o)", "printf('CT-%d/A', o)", "literal_normalized", 0.6),
    ("contract", "'...'", None, "NULL", "NULL", "NULL", "unresolved", 0.0),
]
ALIASES = [("currency", "usd", "currency:USD", "US dollar"), ("incoterm", "fob", "incoterm:FOB", "Free on board"), ("unit", "mt", "unit:metric_ton", "Metric ton"), ("commodity", "thermal coal", "commodity:coal", "Coal"), ("port", "mundra", "port:INMUN", "Mundra")]
PROVIDERS = ("groq", "claude", "openai", "ollama", "another")

_LINES = f"""lines AS (SELECT o, n, x.p AS p, x.s AS s, x.q AS q, concat(o, '.', n) AS entity_id, CAST((o * 7 + n) % {len(CASES)} AS INTEGER) AS k FROM (
  SELECT l_orderkey AS o, l_linenumber AS n, min(struct_pack(p := l_partkey, s := l_suppkey, q := CAST(trunc(l_quantity) AS INTEGER))) AS x FROM lineitem GROUP BY 1, 2))"""


def _pick(values: list[str], kind: str) -> str:
    """The expression of each case, in SQL."""
    return "CASE k " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + f" ELSE CAST(NULL AS {kind}) END"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o, n, p, s, q, entity_id of every line item."""
    least = F.min(F.struct(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("int").alias("q")))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(least.alias("x"))
    return rows.select("o", "n", "x.*", F.concat_ws(".", "o", "n").alias("entity_id"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity of each line item, with its registry's entry."""
    e = lines(spark, sf_dir).withColumn("k", (F.col("o") * 7 + F.col("n")) % len(CASES))
    kind, raw = F.expr(_pick([f"'{c[0]}'" for c in CASES], "string")), F.expr(_pick([c[1] for c in CASES], "string"))
    box = F.struct(F.lit(25.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("q").cast("double").alias("x1"), F.lit(9.0).alias("y1"))
    boxed = next(k for k, c in enumerate(CASES) if c[2] and c[2].startswith("geometry"))
    provider = F.element_at(F.array(*map(F.lit, PROVIDERS)), (F.col("o") % 5 + 1).cast("int"))
    e = e.select(F.col("o").alias("run_id"), "entity_id", kind.alias("entity_type"), raw.alias("raw_value"), F.col("n").cast("long").alias("seq"), provider.alias("provider"), F.lit(None).cast("string").alias("normalized_value"), F.lit(0.9).alias("confidence"), F.lit(1).alias("page_number"), F.when(F.col("k") == boxed, box).alias("bbox"))
    nations = table(spark, sf_dir, "nation").select(F.lit("country").alias("registry"), F.lower("n_name").alias("alias"), F.concat(F.lit("country:"), "n_nationkey").alias("canonical_id"), F.col("n_name").alias("canonical_name"))
    few = nations.unionByName(spark.createDataFrame(ALIASES, "registry string, alias string, canonical_id string, canonical_name string"))
    return trust.with_alias(e, F.broadcast(few))


FORMS = (["27"], {"usd": "currency:USD"}, {"mt": "unit:metric_ton"})


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with findings, normal form and confidence; no page has tables or a layout."""
    none = table(spark, sf_dir, "lineitem").where("false").select(F.col("l_orderkey").alias("run_id"), F.lit(1).alias("page_number"), F.lit(1.0).alias("confidence"), F.lit(True).alias("is_multi_column"))
    return trust.scored(trust.judged(entities(spark, sf_dir), 2026, *FORMS), none.drop("is_multi_column"), none.drop("confidence"))


@query(f"""WITH {_LINES} SELECT * FROM (SELECT entity_id, {_pick([f"'{c[2]}'" if c[2] else "NULL" for c in CASES], "VARCHAR")} AS rule_id, {_pick(["'warning'" if c[0] == "unit" else "'error'" for c in CASES], "VARCHAR")} AS severity, {_pick([c[3] for c in CASES], "BOOLEAN")} AS passed FROM lines) WHERE rule_id IS NOT NULL""")
def validation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-1..8: each rule passing and failing, on an entity of each line item."""
    return trust.entity_findings(entities(spark, sf_dir), 2026).select("entity_id", "rule_id", "severity", "passed")


@query(f"""WITH {_LINES} SELECT entity_id, {_pick([c[4] for c in CASES], "VARCHAR")} AS canonical_id, {_pick([c[5] for c in CASES], "VARCHAR")} AS normalized_value, {_pick([f"'{c[6]}'" for c in CASES], "VARCHAR")} AS method, {_pick([f"{c[7]}::DOUBLE" for c in CASES], "DOUBLE")} AS confidence FROM lines""")
def normalisation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM-1, NRM-3..11: each method for each type of entity, and what stays unresolved."""
    return trust.normalised(entities(spark, sf_dir), *FORMS).select("entity_id", "canonical_id", "normalized_value", "method", "confidence")


@query(f"""WITH {_LINES} SELECT entity_id, CASE o % 5 WHEN 0 THEN 0.85 WHEN 1 THEN 0.95 WHEN 2 THEN 0.93 WHEN 3 THEN 0.75 ELSE 0.8 END::DOUBLE AS provider, {_pick([f"{c[7]}::DOUBLE" for c in CASES], "DOUBLE")} AS normalization, CASE WHEN {_pick([c[3] for c in CASES], "BOOLEAN")} = false THEN 0.0 ELSE 1.0 END::DOUBLE AS validation FROM lines""")
def provider_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNF-5, CNF-7, CNF-8: priors of all providers, and components that follow findings and normalisation."""
    return scored(spark, sf_dir).select("entity_id", "provider", "normalization", "validation")


# first type, what stands between, second type, relationship, base, whether the second is the source.
RELATIONS = [
    ("company", "' owns '", "port", "owns", 0.75, False), ("port", "' owned by '", "company", "owns", 0.75, True), ("port", "' owns '", "company", None, 0, False),
    ("commodity", "' shipped from '", "port", "shipped_from", 0.70, False), ("commodity", "' loaded at '", "port", "shipped_from", 0.70, False), ("commodity", "' shipped to '", "country", "shipped_to", 0.70, False),
    ("commodity", "' imported into '", "country", "shipped_to", 0.70, False), ("port", "', '", "country", "located_in", 0.60, False), ("company", "', '", "country", None, 0, False), ("contract", "' for '", "commodity", "references", 0.55, False),
    ("commodity", "' under '", "contract", "references", 0.55, True), ("company", "' operates '", "terminal", "operates", 0.75, False), ("terminal", "', operated by '", "company", "operates", 0.75, True), ("terminal", "' operates '", "company", None, 0, False),
    ("company", "', headquartered in '", "country", "located_in", 0.70, False), ("country", "' is where the firm is based in: '", "company", None, 0, False), ("port", "' is situated in '", "country", "located_in", 0.70, False), ("port", "' trades with '", "country", None, 0, False),
    ("company", "concat(' owns ', repeat('far ', 25))", "port", None, 0, False), ("contract", "concat(' of ', repeat('far ', 25))", "commodity", "references", 0.55, False), ("company", "' downs '", "port", None, 0, False),
]
NAMES = {"company": "printf('Supplier#%09d', s)", "port": "printf('Port %d', p)", "commodity": "printf('Coal %d', p)", "country": "printf('NATION_%d', s % 25)", "terminal": "printf('Basin %d', p)", "contract": "printf('CT-%d', o)"}
_NTH = f"CAST((o * 5 + n) % {len(RELATIONS)} AS INTEGER)"


@query(f"""WITH {_LINES.replace(f"CAST((o * 7 + n) % {len(CASES)} AS INTEGER)", _NTH)}, found AS (SELECT entity_id AS chunk_id, concat(CASE WHEN {_pick([str(r[5]) for r in RELATIONS], "BOOLEAN")} THEN 'b' ELSE 'a' END, entity_id) AS source_id, concat(CASE WHEN {_pick([str(r[5]) for r in RELATIONS], "BOOLEAN")} THEN 'a' ELSE 'b' END, entity_id) AS target_id,
  {_pick([f"'{r[3]}'" if r[3] else "NULL" for r in RELATIONS], "VARCHAR")} AS relationship, round({_pick([f"{r[4]}::DOUBLE" for r in RELATIONS], "DOUBLE")} * (1.0::DOUBLE + (p % 5) / 4.0::DOUBLE - 0.5::DOUBLE * (s % 3)) / 2, 9) AS confidence FROM lines) SELECT * FROM found WHERE relationship IS NOT NULL AND confidence >= 0.3""")
def relationship_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-10, REL-1..7, GRB-3, MTH-5: what the text between two mentions says, for a sentence of each line item; weak findings are dropped."""
    e = lines(spark, sf_dir).withColumn("k", F.expr(_NTH.replace("AS INTEGER", "AS INT")))
    name = lambda side: F.expr(_pick([NAMES[r[side]] for r in RELATIONS], "string"))
    kind = lambda side: F.expr(_pick([f"'{r[side]}'" for r in RELATIONS], "string"))
    between = F.expr(_pick([r[1] for r in RELATIONS], "string"))
    e = e.select(F.col("entity_id").alias("chunk_id"), "p", "s", name(0).alias("a"), between.alias("between"), name(2).alias("b"), kind(0).alias("ka"), kind(2).alias("kb"))
    text = F.concat(F.lit("Note: "), "a", "between", "b", F.lit("."))
    side = lambda tag, kind, raw, at, trust_: F.struct(F.concat(F.lit(tag), "chunk_id").alias("entity_id"), F.col(kind).alias("entity_type"), F.col(raw).alias("raw_value"), at.cast("int").alias("character_offset"), trust_.alias("trust"))
    two = F.array(side("a", "ka", "a", F.lit(6), F.lit(1.0) - 0.5 * (F.col("s") % 3)), side("b", "kb", "b", F.length("a") + F.length("between") + 6, (F.col("p") % 5) / 4.0))
    return graph.findings(e.select("chunk_id", text.alias("text"), F.explode(two).alias("m")).select("chunk_id", "text", "m.*")).select("chunk_id", "source_id", "target_id", "relationship", "confidence")


_DAY = "CAST(o_orderdate AS DATE)"
# the question, and the start and end that it speaks of when asked on the order's day.
TIMES = [
    (f"printf('Q%d %d shipment volumes', quarter({_DAY}), year({_DAY}))", f"date_trunc('quarter', {_DAY})", f"date_trunc('quarter', {_DAY}) + INTERVAL 3 MONTH"),
    (f"printf('Shipments in %d', year({_DAY}))", f"date_trunc('year', {_DAY})", f"date_trunc('year', {_DAY}) + INTERVAL 12 MONTH"),
    (f"concat('from ', CAST({_DAY} AS STRING), ' to ', CAST({_DAY} + INTERVAL 40 DAY AS STRING))", _DAY, f"{_DAY} + INTERVAL 40 DAY"),
    ("'What moved last quarter?'", f"date_trunc('quarter', {_DAY}) - INTERVAL 3 MONTH", f"date_trunc('quarter', {_DAY})"),
    ("'prices this year'", f"date_trunc('year', {_DAY})", "NULL"),
    ("'Last month, in ports'", f"date_trunc('month', {_DAY}) - INTERVAL 1 MONTH", f"date_trunc('month', {_DAY})"),
    ("'last year'", f"date_trunc('year', {_DAY}) - INTERVAL 12 MONTH", f"date_trunc('year', {_DAY})"),
    ("'no time at all'", "NULL", "NULL"),
    (f"concat('on ', CAST({_DAY} AS STRING), ' only')", _DAY, _DAY),
]


def _of_order(values: list[str], kind: str) -> str:
    return _pick(values, kind).replace("CASE k ", f"CASE CAST(o_orderkey % {len(TIMES)} AS INT) ")


@query(f"""SELECT o_orderkey, CAST({_of_order([t[1] for t in TIMES], "TIMESTAMP")} AS TIMESTAMP) AS start_at, CAST({_of_order([t[2] for t in TIMES], "TIMESTAMP")} AS TIMESTAMP) AS end_at FROM orders""")
def query_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-4, DAT-3: the time that a question of each order speaks of, seen from the order's day."""
    question = _of_order([t[0] for t in TIMES], "string").replace("CAST(CAST(o_orderdate AS DATE) + INTERVAL 40 DAY AS STRING)", "CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 40 DAY AS DATE) AS STRING)")
    q = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(question).alias("query"), F.col("o_orderdate").cast("timestamp").alias("now"))
    r = q.withColumn("r", retrieval.time_range(F.col("query"), F.col("now")))
    return r.select("o_orderkey", F.col("r.start").cast("timestamp_ntz").alias("start_at"), F.col("r.end").cast("timestamp_ntz").alias("end_at"))
