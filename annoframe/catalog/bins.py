"""Statistics, edges, labels and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoframe.functions import binning as B
from annoframe.functions import vocabulary as V
from annoframe.operators import bins, speakers
from annoframe.plans import stages
from annoframe.sources import tables

from .registry import Tables, case_label, query

EVENT_SPEC = bins.BinSpec("value", "label", V.SPEAKING_RATE_LABELS, V.SPEAKING_RATE_TOLERANCE)

EVENT_BOUNDS = """
WITH stats AS (SELECT avg(value) AS mean, stddev_pop(value) AS std FROM events),
bounds AS (SELECT min(value) AS lo, max(value) AS hi FROM events, stats WHERE abs(value - mean) < 4 * std)
"""


def fitted(lo: str, hi: str, count: int) -> list[str]:
    return [f"({lo} + {i} * (({hi} - {lo}) / {count}))" for i in range(count)] + [hi]


@query(
    """
    SELECT event_id, user_id, value FROM events,
      (SELECT avg(value) AS mean, stddev_pop(value) AS std FROM events)
    WHERE abs(value - mean) < 2.5 * std
    """
)
def outlier_filter(t: Tables) -> DataFrame:
    return bins.without_outliers(t.events.select("event_id", "user_id", "value"), "value", 2.5)


@query(
    EVENT_BOUNDS
    + """
    SELECT i AS edge_no, CASE WHEN i = 7 THEN hi ELSE lo + i * ((hi - lo) / 7) END AS edge
    FROM bounds, range(8) AS r(i)
    """
)
def fit_bin_edges(t: Tables) -> DataFrame:
    edges = bins.fit_bin_edges(t.events, [EVENT_SPEC])
    return edges.select(F.posexplode("label").alias("edge_no", "edge")).withColumn("edge_no", F.col("edge_no").cast("long"))


MANY_SPECS = [
    bins.BinSpec("l_extendedprice", "price", V.NOISE_LABELS, 1.5),
    bins.BinSpec("l_quantity", "amount", V.REVERBERATION_LABELS, None, lower_range=0.0),
    bins.BinSpec("l_discount", "rebate", V.MONOTONY_LABELS, 3.0),
]


@query(
    """
    WITH s AS (SELECT avg(l_extendedprice) AS pm, stddev_pop(l_extendedprice) AS ps,
                      avg(l_discount) AS dm, stddev_pop(l_discount) AS ds FROM lineitem),
    b AS (SELECT min(CASE WHEN abs(l_extendedprice - pm) < 1.5 * ps THEN l_extendedprice END) AS plo,
                 max(CASE WHEN abs(l_extendedprice - pm) < 1.5 * ps THEN l_extendedprice END) AS phi,
                 max(l_quantity) AS ahi,
                 min(CASE WHEN abs(l_discount - dm) < 3 * ds THEN l_discount END) AS dlo,
                 max(CASE WHEN abs(l_discount - dm) < 3 * ds THEN l_discount END) AS dhi
          FROM lineitem, s)
    SELECT 'price' AS label, i AS edge_no, CASE WHEN i = 7 THEN phi ELSE plo + i * ((phi - plo) / 7) END AS edge
    FROM b, range(8) AS r(i)
    UNION ALL SELECT 'amount', i, CASE WHEN i = 5 THEN ahi ELSE i * (ahi / 5) END FROM b, range(6) AS r(i)
    UNION ALL SELECT 'rebate', i, CASE WHEN i = 5 THEN dhi ELSE dlo + i * ((dhi - dlo) / 5) END FROM b, range(6) AS r(i)
    """
)
def fit_bin_edges_many_columns(t: Tables) -> DataFrame:
    edges = bins.fit_bin_edges(t.lineitem, MANY_SPECS)
    named = F.create_map(*[part for spec in MANY_SPECS for part in (F.lit(spec.label), F.col(spec.label))])
    return edges.select(F.explode(named).alias("label", "edges")).select(
        "label", F.posexplode("edges").alias("edge_no", "edge")
    ).withColumn("edge_no", F.col("edge_no").cast("long"))


@query(
    EVENT_BOUNDS
    + f"SELECT event_id, value, {case_label('value', fitted('lo', 'hi', 7), V.SPEAKING_RATE_LABELS)} AS label "
    + "FROM events, bounds"
)
def fit_and_apply_bins(t: Tables) -> DataFrame:
    return bins.label_columns(t.events, [EVENT_SPEC]).select("event_id", "value", "label")


# Some edges equal prices or quantities in the data, some values lie outside.
PRICE_EDGES = [1500.0, 10000.0, 20000.0, 34000.5, 50000.0, 63058.35, 80000.0, 90000.0]


@query(
    f"""
    SELECT l_orderkey, l_linenumber, l_extendedprice,
      {case_label('l_extendedprice', [f'{edge}::DOUBLE' for edge in PRICE_EDGES], V.NOISE_LABELS)} AS noise,
      {case_label('l_quantity', [f'{edge}::DOUBLE' for edge in V.PUBLISHED_EDGES['reverberation']],
                  V.REVERBERATION_LABELS)} AS reverberation
    FROM lineitem
    """
)
def apply_fixed_bins(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        B.interval_label(F.col("l_extendedprice"), PRICE_EDGES, V.NOISE_LABELS).alias("noise"),
        B.interval_label(F.col("l_quantity"), V.PUBLISHED_EDGES["reverberation"], V.REVERBERATION_LABELS).alias(
            "reverberation"
        ),
    )


@query(
    """
    WITH stats AS (SELECT avg(value) AS mean, stddev_pop(value) AS std FROM events),
    vals AS (SELECT 'before' AS series, value FROM events
             UNION ALL SELECT 'after', value FROM events, stats WHERE abs(value - mean) < 4 * std),
    ranges AS (SELECT series, min(value) AS lo, max(value) AS hi FROM vals GROUP BY series),
    slots AS (SELECT series, i AS slot, lo + i * ((hi - lo) / 100) AS slot_from,
                     CASE WHEN i = 99 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 100) END AS slot_to
              FROM ranges, range(100) AS r(i))
    SELECT s.series, s.slot, round(s.slot_from, 6) AS slot_from, round(s.slot_to, 6) AS slot_to,
           count(v.value) AS "rows"
    FROM slots s LEFT JOIN vals v ON v.series = s.series AND v.value >= s.slot_from
      AND (v.value < s.slot_to OR (s.slot = 99 AND v.value = s.slot_to))
    GROUP BY ALL
    """
)
def histogram_before_after(t: Tables) -> DataFrame:
    return bins.histogram_before_after(t.events, "value", V.SPEAKING_RATE_TOLERANCE).withColumns(
        {"slot_from": F.round("slot_from", 6), "slot_to": F.round("slot_to", 6)}
    )


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    """
    WITH ranges AS (SELECT c_mktsegment AS series, min(c_acctbal) AS lo, max(c_acctbal) AS hi
                    FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment),
    slots AS (SELECT series, i AS slot, lo + i * ((hi - lo) / 20) AS slot_from,
                     CASE WHEN i = 19 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 20) END AS slot_to
              FROM ranges, range(20) AS r(i))
    SELECT s.series, s.slot, round(s.slot_from, 6) AS slot_from, round(s.slot_to, 6) AS slot_to,
           count(c.c_acctbal) AS "rows"
    FROM slots s LEFT JOIN customer c ON c.c_mktsegment = s.series AND c.c_acctbal >= s.slot_from
      AND (c.c_acctbal < s.slot_to OR (s.slot = 19 AND c.c_acctbal = s.slot_to))
    GROUP BY ALL
    """
)
def histogram_by_category(t: Tables) -> DataFrame:
    return bins.histogram_by(t.customer, "c_mktsegment", "c_acctbal", SEGMENTS, 20).withColumns(
        {"slot_from": F.round("slot_from", 6), "slot_to": F.round("slot_to", 6)}
    )


FITTED_CATEGORIES = ("2-HIGH", "5-LOW")

# The category of a speaker is the one of its first utterance that has any; status P stands for "unknown".
SPEAKERS_SQL = """
u AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS category
      FROM orders),
sp AS (SELECT o_custkey AS speaker, avg(o_totalprice) AS mean,
              arg_min(category, o_orderkey) FILTER (WHERE category IS NOT NULL) AS category
       FROM u WHERE o_custkey IS NOT NULL GROUP BY o_custkey),
st AS (SELECT category, avg(mean) AS m, stddev_pop(mean) AS s FROM sp GROUP BY category),
bd AS (SELECT category, min(mean) AS lo, max(mean) AS hi FROM sp JOIN st USING (category)
       WHERE abs(mean - m) < 2 * s GROUP BY category)
"""


def utterances(t: Tables) -> DataFrame:
    """Orders as utterances of their customer, with a category some of them lack."""
    category = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice", category.alias("category"))


@query(
    f"""
    WITH {SPEAKERS_SQL}
    SELECT u.o_orderkey, u.o_custkey,
      CASE WHEN sp.category IN ('2-HIGH', '5-LOW')
           THEN {case_label('sp.mean', fitted('bd.lo', 'bd.hi', 7), V.PITCH_LABELS)} END AS pitch
    FROM u LEFT JOIN sp ON u.o_custkey = sp.speaker LEFT JOIN bd ON sp.category = bd.category
    """
)
def speaker_level_bins(t: Tables) -> DataFrame:
    return speakers.label_by_speaker(
        utterances(t), "o_custkey", "category", "o_totalprice", categories=FITTED_CATEGORIES, order_by="o_orderkey",
        spread=["o_orderkey"],
    ).select("o_orderkey", "o_custkey", "pitch")


@query(
    f"""
    WITH {SPEAKERS_SQL}
    SELECT category, i AS edge_no, round(CASE WHEN i = 7 THEN hi ELSE lo + i * ((hi - lo) / 7) END, 4) AS edge
    FROM bd, range(8) AS r(i) WHERE category IN ('2-HIGH', '5-LOW')
    """
)
def category_edges(t: Tables) -> DataFrame:
    table = speakers.speaker_table(utterances(t), "o_custkey", "category", "o_totalprice", "o_orderkey")
    edges = speakers.fit_category_edges(table, 7, FITTED_CATEGORIES)
    named = F.create_map(*[part for name in FITTED_CATEGORIES for part in (F.lit(name), F.col(name))])
    return edges.select(F.explode(named).alias("category", "edges")).select(
        "category", F.posexplode("edges").alias("edge_no", "edge")
    ).select("category", F.col("edge_no").cast("long").alias("edge_no"), F.round("edge", 4).alias("edge"))


def measured_orders(t: Tables) -> DataFrame:
    """Orders in the layout of a measured table: exact numbers per order, a gender for most."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("segment_id")).agg(
        F.sum("l_quantity").alias("speaking_rate_value"),
        F.max("l_extendedprice").alias("snr"),
        F.min("l_extendedprice").alias("c50"),
        F.max("l_quantity").alias("utterance_pitch_std"),
    )
    gender = F.when(F.col("o_orderstatus") == "F", "female").when(F.col("o_orderstatus") == "O", "male")
    orders = t.orders.select(
        F.col("o_orderkey").alias("segment_id"), F.col("o_custkey").alias("speaker"),
        gender.alias("gender_ori"), F.col("o_totalprice").alias("utterance_pitch_mean"),
    )
    return orders.join(lines, "segment_id", "left")


def _described_sql() -> str:
    bounds, labels = [], []
    for spec in bins.DEFAULT_SPECS:
        name, k = spec.value, spec.tolerance
        near = f"CASE WHEN abs({name} - {name}_m) < {k} * {name}_s THEN {name} END"
        bounds.append(f"min({near}) AS {name}_lo, max({near}) AS {name}_hi")
        edges = fitted(f"{name}_lo", f"{name}_hi", len(spec.labels))
        labels.append(f"{case_label(name, edges, spec.labels)} AS {spec.label}")
    stats = ", ".join(f"avg({s.value}) AS {s.value}_m, stddev_pop({s.value}) AS {s.value}_s" for s in bins.DEFAULT_SPECS)
    return f"""
    WITH li AS (SELECT l_orderkey, sum(l_quantity) AS speaking_rate_value, max(l_extendedprice) AS snr,
                       min(l_extendedprice) AS c50, max(l_quantity) AS utterance_pitch_std
                FROM lineitem GROUP BY l_orderkey),
    m AS (SELECT o_orderkey AS segment_id, o_custkey AS speaker, o_totalprice AS utterance_pitch_mean, li.*,
            CASE o_orderstatus WHEN 'O' THEN 'male' WHEN 'F' THEN 'female' END AS gender_ori
          FROM orders LEFT JOIN li ON o_orderkey = l_orderkey),
    sp AS (SELECT speaker, avg(utterance_pitch_mean) AS mean,
                  arg_min(gender_ori, segment_id) FILTER (WHERE gender_ori IS NOT NULL) AS category
           FROM m WHERE speaker IS NOT NULL GROUP BY speaker),
    st AS (SELECT category, avg(mean) AS m, stddev_pop(mean) AS s FROM sp GROUP BY category),
    bd AS (SELECT category, min(mean) AS lo, max(mean) AS hi FROM sp JOIN st USING (category)
           WHERE abs(mean - m) < 2 * s GROUP BY category),
    stats AS (SELECT {stats} FROM m),
    bounds AS (SELECT {', '.join(bounds)} FROM m, stats)
    SELECT segment_id, {', '.join(labels)},
      CASE WHEN sp.category IS NOT NULL
           THEN {case_label('sp.mean', fitted('bd.lo', 'bd.hi', 7), V.PITCH_LABELS)} END AS pitch
    FROM m JOIN bounds ON true LEFT JOIN sp ON m.speaker = sp.speaker LEFT JOIN bd ON sp.category = bd.category
    """


@query(_described_sql())
def describe_stage(t: Tables) -> DataFrame:
    return stages.describe(measured_orders(t)).select(
        "segment_id", "speaking_rate", "noise", "reverberation", "speech_monotony", "pitch"
    )


def _histogram_all_sql() -> str:
    stats, vals, wanted = [], [], []
    for spec in MANY_SPECS:
        stats.append(f"avg({spec.value}) AS {spec.label}_m, stddev_pop({spec.value}) AS {spec.label}_s")
        near = "" if spec.tolerance is None else f" AND abs({spec.value} - {spec.label}_m) < {spec.tolerance} * {spec.label}_s"
        for series, where in (("before", ""), ("after", near)):
            vals.append(f"SELECT '{spec.label}' AS label, '{series}' AS series, {spec.value} AS value FROM lineitem, stats WHERE {spec.value} IS NOT NULL{where}")
        low = "lo" if spec.lower_range is None else f"{spec.lower_range}::DOUBLE"
        edges = ", ".join(f"round({edge}, 6)" for edge in fitted(low, "hi", len(spec.labels)))
        wanted.append(f"WHEN label = '{spec.label}' THEN [{edges}]")
    return f"""
    WITH stats AS (SELECT {', '.join(stats)} FROM lineitem),
    vals AS ({' UNION ALL '.join(vals)}),
    ranges AS (SELECT label, series, min(value) AS lo, max(value) AS hi FROM vals GROUP BY label, series),
    slots AS (SELECT label, series, i AS slot, lo + i * ((hi - lo) / 100) AS slot_from,
                CASE WHEN i = 99 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 100) END AS slot_to,
                CASE {' '.join(wanted)} END AS edges
              FROM ranges, range(100) AS r(i))
    SELECT s.label, s.series, s.slot, round(s.slot_from, 6) AS slot_from, round(s.slot_to, 6) AS slot_to, s.edges, count(v.value) AS "rows"
    FROM slots s LEFT JOIN vals v ON v.label = s.label AND v.series = s.series AND v.value >= s.slot_from
      AND (v.value < s.slot_to OR (s.slot = 99 AND v.value = s.slot_to))
    GROUP BY ALL
    """


@query(_histogram_all_sql())
def histogram_all_columns(t: Tables) -> DataFrame:
    return bins.histogram_all(t.lineitem, MANY_SPECS).withColumns(
        {"slot_from": F.round("slot_from", 6), "slot_to": F.round("slot_to", 6), "edges": F.transform("edges", lambda e: F.round(e, 6))}
    )


@query(
    """
    WITH c AS (SELECT c_mktsegment AS category, c_acctbal AS value FROM customer WHERE c_mktsegment IS NOT NULL AND c_acctbal IS NOT NULL),
    stats AS (SELECT category, avg(value) AS m, stddev_pop(value) AS s FROM c GROUP BY category),
    vals AS (SELECT category, 'before' AS series, value FROM c
             UNION ALL SELECT c.category, 'after', value FROM c JOIN stats ON c.category = stats.category WHERE abs(value - m) < 1.5 * s),
    ranges AS (SELECT category, series, min(value) AS lo, max(value) AS hi FROM vals GROUP BY category, series),
    slots AS (SELECT category, series, i AS slot, lo + i * ((hi - lo) / 20) AS slot_from,
                     CASE WHEN i = 19 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 20) END AS slot_to
              FROM ranges, range(20) AS r(i))
    SELECT s.category, s.series, s.slot, round(s.slot_from, 6) AS slot_from, round(s.slot_to, 6) AS slot_to, count(v.value) AS "rows"
    FROM slots s LEFT JOIN vals v ON v.category = s.category AND v.series = s.series AND v.value >= s.slot_from
      AND (v.value < s.slot_to OR (s.slot = 19 AND v.value = s.slot_to))
    GROUP BY ALL
    """
)
def histogram_by_category_before_after(t: Tables) -> DataFrame:
    counted = bins.histogram_by_before_after(t.customer, "c_mktsegment", "c_acctbal", SEGMENTS, 1.5, 20)
    return counted.withColumns({"slot_from": F.round("slot_from", 6), "slot_to": F.round("slot_to", 6)})


LENGTH_SPEC = bins.BinSpec("n_chars", "size", V.SPEAKING_RATE_LABELS, 2.0)


@query(
    f"""
    WITH lead AS (SELECT n_chars FROM documents WHERE lang LIKE '%f%' OR lang LIKE '%de%'),
    stats AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM lead),
    bounds AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM lead, stats WHERE abs(n_chars - m) < 2 * s)
    SELECT doc_id, lang, {case_label('n_chars', fitted('lo', 'hi', 7), V.SPEAKING_RATE_LABELS)} AS size FROM documents, bounds
    """
)
def fit_on_leading_split(t: Tables) -> DataFrame:
    documents = t.documents.select("doc_id", "lang", "n_chars")
    leading = tables.leading_splits(documents, ["f", "de"], "lang")
    return bins.label_columns(documents, [LENGTH_SPEC], fit_on=leading).select("doc_id", "lang", "size")
