"""Frame tables and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoframe.functions import signal as S
from annoframe.functions import vocabulary as V
from annoframe.operators import frames
from annoframe.plans import stages

from .registry import Tables, query

RATE = 16


@query(
    """
    SELECT vec_id, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std
    FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id
    """
)
def frame_mean_std(t: Tables) -> DataFrame:
    signal = F.col("embedding")
    return t.embeddings.select(
        "vec_id", F.round(S.array_mean(signal), 6).alias("mean"), F.round(S.array_sample_std(signal), 6).alias("std")
    )


@query(
    """
    SELECT l_orderkey, round(avg(l_quantity), 6) AS utterance_pitch_mean,
           round(stddev_samp(l_quantity), 6) AS utterance_pitch_std
    FROM lineitem GROUP BY l_orderkey
    """
)
def frame_mean_std_long(t: Tables) -> DataFrame:
    levels = frames.mean_and_std(t.lineitem, "l_quantity", "utterance_pitch", "l_orderkey")
    return levels.select(
        "l_orderkey", F.round("utterance_pitch_mean", 6).alias("utterance_pitch_mean"),
        F.round("utterance_pitch_std", 6).alias("utterance_pitch_std"),
    )


@query(f"SELECT vec_id, len(embedding) / {RATE}::DOUBLE AS seconds FROM embeddings")
def array_duration(t: Tables) -> DataFrame:
    samples = S.flat_samples(F.array("embedding"), nested=True)
    return t.embeddings.select("vec_id", S.sample_seconds(samples, F.lit(RATE)).alias("seconds"))


@query(
    f"""
    SELECT vec_id, len(list_slice(embedding, 1, {2 * RATE}))::INTEGER AS samples,
           round(embedding[{2 * RATE}]::DOUBLE, 6) AS last_sample FROM embeddings
    """
)
def truncate_array(t: Tables) -> DataFrame:
    cut = t.embeddings.select("vec_id", S.first_seconds(F.col("embedding"), F.lit(RATE), 2).alias("cut"))
    return cut.select(
        "vec_id", F.size("cut").alias("samples"), F.round(F.element_at("cut", -1).cast("double"), 6).alias("last_sample")
    )


def speech_ranges(t: Tables) -> DataFrame:
    """Two overlapping ranges per order, in seconds."""
    begin = (F.col("o_orderkey") % 5) * F.lit(0.017)
    ranges = F.array(
        F.struct(begin.alias("start"), (begin + 0.05).alias("end")),
        F.struct((begin + 0.02).alias("start"), (begin + 0.06).alias("end")),
    )
    return t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.inline(ranges))


SPEECH_RANGES_SQL = """
b AS (SELECT o_orderkey, (o_orderkey % 5) * 0.017::DOUBLE AS s FROM orders),
seg AS (SELECT o_orderkey AS k, s AS "start", s + 0.05::DOUBLE AS "end" FROM b
        UNION ALL SELECT o_orderkey, s + 0.02::DOUBLE, s + 0.06::DOUBLE FROM b)
"""


@query(
    f"""
    WITH {SPEECH_RANGES_SQL},
    f AS (SELECT l_orderkey, l_discount, l_tax, NOT (l_discount = 0 AND l_tax = 0) AND EXISTS (
            SELECT 1 FROM seg WHERE k = l_orderkey
              AND l_linenumber >= trunc("start" * {V.VAD_FRAMES_PER_SECOND}::DOUBLE)
              AND l_linenumber < trunc("end" * {V.VAD_FRAMES_PER_SECOND}::DOUBLE)) AS speech FROM lineitem)
    SELECT l_orderkey, round(avg(CASE WHEN speech THEN l_discount END), 6) AS snr,
           round(avg(CASE WHEN speech THEN l_tax END), 6) AS c50
    FROM f GROUP BY l_orderkey
    """
)
def masked_frame_mean(t: Tables) -> DataFrame:
    voice = t.lineitem.select(
        "l_orderkey", F.col("l_linenumber").alias("frame_idx"), F.col("l_discount").alias("snr"), F.col("l_tax").alias("c50")
    )
    means = frames.masked_means(voice, speech_ranges(t), on="l_orderkey")
    return means.select("l_orderkey", F.round("snr", 6).alias("snr"), F.round("c50", 6).alias("c50"))


@query(
    """
    SELECT o_orderkey, round(coalesce(sum(l_quantity - l_discount), 0), 6) AS speech_duration
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
    """
)
def speech_duration(t: Tables) -> DataFrame:
    ranges = t.lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_discount").alias("start"), F.col("l_quantity").alias("end")
    )
    spoken = frames.speech_duration(t.orders.select("o_orderkey"), ranges, "o_orderkey")
    return spoken.withColumn("speech_duration", F.round("speech_duration", 6))


VOICED_FROM = 12.0


@query(
    f"""
    WITH v AS (SELECT event_id, user_id, value, CASE WHEN value >= {VOICED_FROM} THEN event_id END AS here,
                      CASE WHEN value >= {VOICED_FROM} THEN value END AS level FROM events),
    w AS (SELECT *, last_value(here IGNORE NULLS) OVER p AS pa, last_value(level IGNORE NULLS) OVER p AS pv,
                 first_value(here IGNORE NULLS) OVER n AS na, first_value(level IGNORE NULLS) OVER n AS nv
          FROM v WINDOW
            p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            n AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, user_id, round(CASE WHEN here IS NOT NULL OR (pa IS NULL AND na IS NULL) THEN value
        WHEN pa IS NULL THEN nv WHEN na IS NULL THEN pv
        ELSE pv + (nv - pv) * ((event_id - pa) / (na - pa)::DOUBLE) END, 6) AS value
    FROM w
    """
)
def interpolate_unvoiced(t: Tables) -> DataFrame:
    line = frames.interpolate_unvoiced(
        t.events.select("event_id", "user_id", "value"), "value", "value", "user_id", "event_id", VOICED_FROM
    )
    return line.select("event_id", "user_id", F.round("value", 6).alias("value"))


@query(
    f"""
    WITH v AS (SELECT event_id, user_id, value + 1 AS value, CASE WHEN value >= {VOICED_FROM} THEN event_id END AS here,
                      CASE WHEN value >= {VOICED_FROM} THEN log2(value + 1) END AS level FROM events),
    w AS (SELECT *, last_value(here IGNORE NULLS) OVER p AS pa, last_value(level IGNORE NULLS) OVER p AS pv,
                 first_value(here IGNORE NULLS) OVER n AS na, first_value(level IGNORE NULLS) OVER n AS nv
          FROM v WINDOW
            p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            n AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, user_id, round(CASE WHEN here IS NOT NULL OR (pa IS NULL AND na IS NULL) THEN value
        WHEN pa IS NULL THEN pow(2::DOUBLE, nv) WHEN na IS NULL THEN pow(2::DOUBLE, pv)
        ELSE pow(2::DOUBLE, pv + (nv - pv) * ((event_id - pa) / (na - pa)::DOUBLE)) END, 6) AS value
    FROM w
    """
)
def interpolate_unvoiced_log2(t: Tables) -> DataFrame:
    levels = t.events.select("event_id", "user_id", (F.col("value") + 1).alias("value"))
    line = frames.interpolate_unvoiced(levels, "value", "value", "user_id", "event_id", VOICED_FROM + 1, space="log2")
    return line.select("event_id", "user_id", F.round("value", 6).alias("value"))


@query(
    """
    WITH c AS (SELECT l_orderkey AS segment_id, l_partkey % 8 AS t, l_suppkey AS channel,
                 sum(CASE WHEN l_linenumber % 4 = 3 THEN l_quantity END) AS vocals,
                 sum(CASE WHEN l_linenumber % 4 <> 3 THEN l_quantity END) AS others
               FROM lineitem WHERE l_partkey % 8 < 4 + l_orderkey % 4 GROUP BY ALL)
    SELECT segment_id, t, round(avg(vocals), 6) AS vocals, round(avg(others), 6) AS others FROM c GROUP BY segment_id, t
    """
)
def stem_mixdown(t: Tables) -> DataFrame:
    stems = t.lineitem.select(
        F.col("l_orderkey").alias("segment_id"), (F.col("l_linenumber") % 4).alias("stem"),
        F.col("l_suppkey").alias("channel"), (F.col("l_partkey") % 8).alias("t"), F.col("l_quantity").alias("amp"),
        (4 + F.col("l_orderkey") % 4).alias("length"),
    )
    mixed = frames.stem_mixdown(stems, 3, length="length")
    return mixed.select("segment_id", "t", F.round("vocals", 6).alias("vocals"), F.round("others", 6).alias("others"))


@query(
    """
    WITH x AS (SELECT label, vec_id % 4 = 3 AS voice, vec_id // 4 % 3 AS channel,
                 generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
    c AS (SELECT label, i, channel, sum(v) FILTER (WHERE voice) AS vocals, sum(v) FILTER (WHERE NOT voice) AS others
          FROM x GROUP BY label, i, channel),
    m AS (SELECT label, i, avg(vocals) AS vocals, avg(others) AS others FROM c GROUP BY label, i)
    SELECT label, list(round(vocals, 6) ORDER BY i) AS vocals, list(round(others, 6) ORDER BY i) AS others FROM m GROUP BY label
    """
)
def stem_mixdown_arrays(t: Tables) -> DataFrame:
    stems = t.embeddings.select("label", "vec_id", F.floor(F.col("vec_id") / 4 % 3).alias("channel"), "embedding")
    mixed = frames.stem_mixdown_arrays(stems, F.col("vec_id") % 4 == 3, "label", "channel", "embedding")
    return mixed.withColumns({name: F.transform(name, lambda x: F.round(x, 6)) for name in ("vocals", "others")})


SOUNDS = {"urgent": "ɜːdʒənt", "high": "haɪ", "medium": "miːdiəm", "low": "loʊ"}
TRANSCRIBED_SQL = "o_orderpriority"
for word, sounds in SOUNDS.items():
    TRANSCRIBED_SQL = f"replace({TRANSCRIBED_SQL}, '{word.upper()}', '{sounds}')"


@query(
    f"""
    WITH {SPEECH_RANGES_SQL},
    f AS (SELECT l_orderkey, l_discount, l_tax, NOT (l_discount = 0 AND l_tax = 0) AND EXISTS (
            SELECT 1 FROM seg WHERE k = l_orderkey
              AND l_linenumber >= trunc("start" * {V.VAD_FRAMES_PER_SECOND}::DOUBLE)
              AND l_linenumber < trunc("end" * {V.VAD_FRAMES_PER_SECOND}::DOUBLE)) AS speech FROM lineitem),
    means AS (SELECT l_orderkey, avg(CASE WHEN speech THEN l_discount END) AS snr, avg(CASE WHEN speech THEN l_tax END) AS c50
              FROM f GROUP BY l_orderkey),
    pitch AS (SELECT l_orderkey, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std FROM lineitem GROUP BY l_orderkey),
    spoken AS (SELECT k, sum("end" - "start") AS seconds FROM seg GROUP BY k)
    SELECT o_orderkey AS segment_id, round(mean, 6) AS utterance_pitch_mean, round(std, 6) AS utterance_pitch_std,
      round(snr, 6) AS snr, round(c50, 6) AS c50, {TRANSCRIBED_SQL} AS phonemes, round(seconds, 6) AS speech_duration,
      round(length({TRANSCRIBED_SQL}) / seconds, 4) AS speaking_rate_value
    FROM orders LEFT JOIN pitch p ON o_orderkey = p.l_orderkey LEFT JOIN means m ON o_orderkey = m.l_orderkey
      LEFT JOIN spoken ON o_orderkey = k
    """
)
def measure_stage(t: Tables) -> DataFrame:
    by_order = t.lineitem.withColumnRenamed("l_orderkey", "segment_id").withColumnRenamed("l_linenumber", "frame_idx")
    sounds = F.create_map(*[F.lit(x) for pair in SOUNDS.items() for x in pair])
    lexicon = t.orders.select(F.explode(F.split(F.lower("o_orderpriority"), "[^a-z]+")).alias("word")).distinct()
    measured = stages.measure(
        t.orders.select(F.col("o_orderkey").alias("segment_id"), F.col("o_orderpriority").alias("text")),
        by_order.select("segment_id", "frame_idx", F.col("l_quantity").alias("f0"), F.lit(1.0).alias("periodicity")),
        by_order.select("segment_id", "frame_idx", F.col("l_discount").alias("snr"), F.col("l_tax").alias("c50")),
        speech_ranges(t).withColumnRenamed("l_orderkey", "segment_id"),
        lexicon.select("word", F.try_element_at(sounds, F.col("word")).alias("phonemes")).where("phonemes IS NOT NULL"),
    )
    rounded = {name: F.round(name, 6) for name in ("utterance_pitch_mean", "utterance_pitch_std", "snr", "c50", "speech_duration")}
    return measured.withColumns({**rounded, "speaking_rate_value": F.round("speaking_rate_value", 4)}).drop("text")
