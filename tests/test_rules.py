"""Rules of trust, relations and times on one hand-written case each, passing and failing."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import graph, retrieval, trust

# One entity a line: id, type, value, rule and whether it passes (None: no rule), then canonical id, value, method and confidence.
_CASES = [
    ("c1", "currency", " usd ", "currency.invalid_code", True, "currency:USD", None, "alias_lookup", 1.0),
    ("c2", "currency", "Galleons", "currency.invalid_code", False, None, None, "unresolved", 0.0),
    ("h1", "hs_code", "2701.12", "hs_code.invalid_format", True, "hs:27", None, "prefix_lookup", 0.8),
    ("h2", "hs_code", "99.88.77", "hs_code.invalid_format", True, "hs:99", "998877", "format_normalized", 0.5),
    ("h3", "hs_code", "9988", "hs_code.invalid_format", True, None, None, "unresolved", 0.0),
    ("h4", "hs_code", "coal", "hs_code.invalid_format", False, None, None, "unresolved", 0.0),
    ("i1", "incoterm", "FOB", "incoterm.invalid_code", True, "incoterm:FOB", None, "alias_lookup", 1.0),
    ("i2", "incoterm", "XYZ", "incoterm.invalid_code", False, None, None, "unresolved", 0.0),
    ("u1", "unit", "MT", "unit.unrecognized", True, "unit:metric_ton", None, "alias_lookup", 1.0),
    ("u2", "unit", "armfuls", "unit.unrecognized", False, None, None, "unresolved", 0.0),
    ("x1", "price", "83.5 USD/INR", "exchange_rate.impossible", True, None, "83.5", "value_parsed", 0.6),
    ("x2", "price", "exchange rate 20000", "exchange_rate.impossible", False, None, "20000.0", "value_parsed", 0.6),
    ("x3", "price", "fx rate 0", "exchange_rate.impossible", False, None, "0.0", "value_parsed", 0.6),
    ("p1", "price", "1,200 USD", None, None, None, "1200.0 currency:USD", "value_parsed", 0.9),
    ("p2", "price", "1200", None, None, None, "1200.0", "value_parsed", 0.6),
    ("p3", "price", "dear", None, None, None, None, "unresolved", 0.0),
    ("q1", "quantity", "-500 MT", "quantity.impossible", False, None, "-500.0 unit:metric_ton", "value_parsed", 0.9),
    ("q2", "quantity", "7 sacks", "quantity.impossible", True, None, "7.0", "value_parsed", 0.6),
    ("d1", "date", "12 January 2026", "date.impossible", True, None, "2026-01-12", "value_parsed", 0.9),
    ("d2", "date", "2026-02-30", "date.impossible", False, None, None, "unresolved", 0.0),
    ("n1", "country", "INDIA", None, None, "country:IN", None, "alias_lookup", 1.0),
    ("n2", "country", "Atlantis", None, None, None, None, "unresolved", 0.0),
    ("m1", "commodity", "Thermal Coal", None, None, "commodity:coal", None, "alias_lookup", 1.0),
    ("m2", "commodity", "Fly Ash", None, None, "commodity:fly_ash", None, "slug_derived_fallback", 0.5),
    ("o1", "port", "mundra", None, None, "port:INMUN", None, "alias_lookup", 1.0),
    ("o2", "port", "New Port", None, None, "port:new_port", None, "slug_derived_fallback", 0.5),
    ("y1", "company", "Adani Ports Ltd.", None, None, "company:adani_ports", None, "slug_derived", 0.7),
    ("y2", "organization", "Port Trust", None, None, "organization:port_trust", None, "slug_derived", 0.7),
    ("y3", "vessel", "MV Star", None, None, "vessel:mv_star", None, "slug_derived", 0.7),
    ("y4", "terminal", "West Basin", None, None, "terminal:west_basin", None, "slug_derived", 0.7),
    ("k1", "contract", " ct-17 / a", None, None, "contract:CT-17/A", "CT-17/A", "literal_normalized", 0.6),
    ("k2", "contract", "...", None, None, None, None, "unresolved", 0.0),
]
_ALIASES = [("currency", "usd", "currency:USD", "US dollar"), ("incoterm", "fob", "incoterm:FOB", "Free on board"), ("unit", "mt", "unit:metric_ton", "Metric ton"), ("country", "india", "country:IN", "India"), ("commodity", "thermal coal", "commodity:coal", "Coal"), ("commodity", "steam coal", "commodity:coal", "Coal"), ("port", "mundra", "port:INMUN", "Mundra")]
_PROVIDERS = ("groq", "claude", "openai", "ollama", "another")
_TEXTS = [
    (1, "Adani Ports owns Mundra Port in Gujarat.", "company", "Adani Ports", "port", "Mundra Port", "owns", 0.75, False),
    (2, "Mundra Port owned by Adani Ports.", "port", "Mundra Port", "company", "Adani Ports", "owns", 0.75, True),
    (3, "Mundra Port owns Adani Ports.", "port", "Mundra Port", "company", "Adani Ports", None, None, False),
    (4, "Brent crude shipped from Rotterdam.", "commodity", "Brent crude", "port", "Rotterdam", "shipped_from", 0.70, False),
    (5, "Thermal coal shipped to India.", "commodity", "Thermal coal", "country", "India", "shipped_to", 0.70, False),
    (6, "Mundra, India.", "port", "Mundra", "country", "India", "located_in", 0.60, False),
    (7, "Adani Ports, India.", "company", "Adani Ports", "country", "India", None, None, False),
    (8, "CT-1 for Brent crude.", "contract", "CT-1", "commodity", "Brent crude", "references", 0.55, False),
    (9, "Adani Ports operates Mundra Terminal.", "company", "Adani Ports", "terminal", "Mundra Terminal", "operates", 0.75, False),
    (10, "Mundra Terminal, operated by Adani Ports.", "terminal", "Mundra Terminal", "company", "Adani Ports", "operates", 0.75, True),
    (11, "Mundra Terminal operates Adani Ports.", "terminal", "Mundra Terminal", "company", "Adani Ports", None, None, False),
    (12, "Adani Ports, headquartered in India.", "company", "Adani Ports", "country", "India", "located_in", 0.70, False),
    (13, "India is where Adani Ports is based in.", "country", "India", "company", "Adani Ports", None, None, False),
    (14, "Mundra Port is situated in India.", "port", "Mundra Port", "country", "India", "located_in", 0.70, False),
    (15, "Mundra Port trades with India.", "port", "Mundra Port", "country", "India", None, None, False),
    (16, "Thermal coal loaded at Rotterdam.", "commodity", "Thermal coal", "port", "Rotterdam", "shipped_from", 0.70, False),
]
_TIMES = [("Q1 2026 shipment volumes", "2026-01-01", "2026-04-01"), ("Shipments in 2025", "2025-01-01", "2026-01-01"), ("from 2024-02-03 to 2024-05-06", "2024-02-03", "2024-05-06"), ("last quarter", "2025-10-01", "2026-01-01"), ("this year", "2026-01-01", None), ("last month", "2026-01-01", "2026-02-01"), ("last year", "2025-01-01", "2026-01-01"), ("no time", None, None)]


def cases(spark):
    rows = [(r[0], r[1], r[2], k, _PROVIDERS[k % len(_PROVIDERS)]) for k, r in enumerate(_CASES)]
    e = spark.createDataFrame(rows, "entity_id string, entity_type string, raw_value string, seq long, provider string")
    box = F.struct(*(F.lit(x).alias(k) for k, x in (("x0", 0.0), ("y0", 0.0), ("x1", 9.0), ("y1", 9.0))))
    e = e.select(F.lit(1).alias("run_id"), "*", F.lit(None).cast("string").alias("normalized_value"), F.lit(0.9).alias("confidence"), F.lit(1).alias("page_number"), F.when(F.lit(False), box).alias("bbox"))
    return trust.with_alias(e, spark.createDataFrame(_ALIASES, "registry string, alias string, canonical_id string, canonical_name string"))


def test_validation_and_normalisation(spark) -> None:
    e = cases(spark)
    findings, normal = trust.entity_findings(e, 2026), trust.normalised(e, ["27"], {"usd": "currency:USD"}, {"mt": "unit:metric_ton"})
    assert {(r.entity_id, r.rule_id, r.severity, r.passed) for r in findings.collect()} == {(r[0], r[3], "warning" if r[1] == "unit" else "error", r[4]) for r in _CASES if r[3]}
    assert {(r.entity_id, r.canonical_id, r.normalized_value, r.method, r.confidence) for r in normal.collect()} == {(r[0], *r[5:]) for r in _CASES}
    none = spark.createDataFrame([], "run_id int, page_number int, confidence double"), spark.createDataFrame([], "run_id int, page_number int, is_multi_column boolean")
    got = {(r.entity_id, r.provider, r.normalization, r.validation) for r in trust.confidences(e, findings, normal, *none).collect()}
    assert got == {(r[0], {"groq": 0.85, "claude": 0.95, "openai": 0.93, "ollama": 0.75}.get(_PROVIDERS[k % 5], 0.8), r[8], 1.0 if r[4] is None or r[4] else 0.0) for k, r in enumerate(_CASES)}


def test_relations(spark) -> None:
    rows = [(i, t, f"{s}{i}", kind, raw, t.index(raw), 1.0) for i, t, k1, r1, k2, r2, *_ in _TEXTS for s, kind, raw in (("a", k1, r1), ("b", k2, r2))]
    m = spark.createDataFrame(rows, "chunk_id int, text string, entity_id string, entity_type string, raw_value string, character_offset int, trust double")
    got = {(r.chunk_id, r.source_id, r.target_id, r.relationship, r.confidence) for r in graph.findings(m).collect()}
    assert got == {(i, f"{'b' if flip else 'a'}{i}", f"{'a' if flip else 'b'}{i}", r, c) for i, *_, r, c, flip in _TEXTS if r}


def test_times(spark) -> None:
    q = spark.createDataFrame([(x[0],) for x in _TIMES], "query string")
    r = q.select("query", retrieval.time_range(F.col("query"), F.lit("2026-02-15 10:00:00").cast("timestamp")).alias("r")).select("query", F.date_format("r.start", "yyyy-MM-dd").alias("a"), F.date_format("r.end", "yyyy-MM-dd").alias("b"))
    assert {tuple(x) for x in r.collect()} == set(_TIMES)
