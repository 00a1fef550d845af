"""Each operator as a query over a whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoframe.llm import alignment, attribution, decontam, fim, jaccard, language, licenses, lines, minhash, packing, quality, shared, token_files, toxicity

QUERIES = {}
SQL: dict[str, str] = {}

_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            SQL[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _words(text: str) -> str:
    """SQL for the words of the licence and benchmark scans, in order."""
    return f"regexp_extract_all({_LOWER.format(f"coalesce({text}, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


_TEMPLATE_ROWS = ", ".join(f"({k}, '{name}', '{text.replace("'", "''")}')" for k, (name, text) in enumerate(licenses.TEMPLATES))


@query(f"""
WITH template AS (SELECT number, name, {_words("text")} AS words FROM (VALUES {_TEMPLATE_ROWS}) AS t(number, name, text)),
own AS (
  SELECT DISTINCT number, name, list_extract(words, pos) || ' ' || list_extract(words, pos + 1) AS pair
  FROM (SELECT number, name, words, unnest(range(1, len(words))) AS pos FROM template)),
own_size AS (SELECT number, name, count(*) AS n FROM own GROUP BY number, name),
unit AS (
  SELECT doc_id, kind, place, {_words("unit")} AS words FROM (
    SELECT doc_id, 'whole' AS kind, 1 AS place, text AS unit FROM documents
    UNION ALL SELECT doc_id, 'line', generate_subscripts(string_split(text, chr(10)), 1), unnest(string_split(text, chr(10))) FROM documents
    UNION ALL SELECT doc_id, 'paragraph', generate_subscripts(string_split(text, chr(10) || chr(10)), 1), unnest(string_split(text, chr(10) || chr(10))) FROM documents)),
pair AS (
  SELECT DISTINCT doc_id, kind, place, list_extract(words, pos) || ' ' || list_extract(words, pos + 1) AS pair
  FROM (SELECT doc_id, kind, place, words, unnest(range(1, len(words))) AS pos FROM unit WHERE len(words) > 1)),
unit_size AS (SELECT doc_id, kind, place, count(*) AS n FROM pair GROUP BY doc_id, kind, place),
common AS (
  SELECT p.doc_id, p.kind, p.place, o.number, o.name, count(*) AS n
  FROM pair p JOIN own o ON p.pair = o.pair GROUP BY p.doc_id, p.kind, p.place, o.number, o.name),
dice AS (
  SELECT c.doc_id, c.kind, c.place, c.name, 2 * c.n / CAST(u.n + o.n AS DOUBLE) AS dice
  FROM common c JOIN unit_size u ON c.doc_id = u.doc_id AND c.kind = u.kind AND c.place = u.place JOIN own_size o ON c.number = o.number),
matched AS (SELECT * FROM dice WHERE dice >= {licenses.LEAST_DICE}),
best AS (SELECT doc_id, name, dice FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name) AS r FROM matched) WHERE r = 1),
counted AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, kind, place FROM matched) GROUP BY doc_id)
SELECT d.doc_id, b.name AS license, b.dice, coalesce(c.n, 0) AS n_matches
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id LEFT JOIN counted c ON d.doc_id = c.doc_id""")
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col("__license").alias("license"), F.col("__dice").alias("dice"), F.col("__n_matches").alias("n_matches"))


@query()
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"), toxicity.not_held_out())
    return toxicity.score(docs, model).select(
        "doc_id", shared.held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


@query(f"""
WITH line AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS place, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (SELECT doc_id, place, line, {_LOWER.format(f"trim(line, {_WHITE})")} AS key FROM line),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.place, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = lines.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query(f"""
WITH item AS (SELECT item_id, {_words("text")} AS words FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, words, least(10, len(words)) AS size FROM item WHERE len(words) > 0),
win AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(words, pos, pos + size - 1), ' ') AS win
  FROM (SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS pos FROM sized)),
sizes AS (SELECT DISTINCT size FROM win),
doc AS (SELECT doc_id, {_words("text")} AS words FROM documents),
place AS (
  SELECT doc_id, size, pos, array_to_string(list_slice(words, pos, pos + size - 1), ' ') AS win
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS pos FROM doc, sizes WHERE len(words) >= size)),
found AS (SELECT p.doc_id, p.pos, p.size, w.item_id FROM place p JOIN win w ON p.size = w.size AND p.win = w.win),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS word FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
  sha256(coalesce(n.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id""")
def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = decontam.find_items(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return docs.select(
        "doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("__n_hit") > 0).alias("contaminated"),
    )


_SETS = f"""
doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(list_slice(words, pos, pos + 4), ' ') END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS pos FROM doc WHERE len(words) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id)"""


@query(f"""
WITH RECURSIVE {_SETS.strip()},
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingle x JOIN shingle y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN size sa ON sa.doc_id = a JOIN size sb ON sb.doc_id = b WHERE 100 * common.n >= 80 * (sa.n + sb.n - common.n)),
reach AS (SELECT a AS doc_id, a AS other FROM (SELECT DISTINCT a FROM link) UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(r.component_id, d.doc_id) AS component_id
FROM doc d LEFT JOIN size s ON d.doc_id = s.doc_id LEFT JOIN least r ON d.doc_id = r.doc_id""")
def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, folder, "documents").select("doc_id", "text"))


@query()
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, folder, "labels"), toxicity.not_held_out())
    names = {f"__{name}": name for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")}
    return quality.judge(docs, model).select("doc_id", *(F.col(a).alias(b) for a, b in names.items()))


@query()
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, toxicity.not_held_out())
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", shared.held_out(F.col("doc_id")).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score")
    )


@query()
def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query()
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return attribution.attribute(table(spark, folder, "documents"), ("source", "lang", "text"))


@query()
def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = shared.new_path(spark, "tokens")
    manifest = token_files.write_files(table(spark, folder, "documents"), files)
    return token_files.read_files(spark, files, manifest).select(F.col("__id").alias("doc_id"), F.col("__start").alias("start"), F.col("__n_tokens").alias("n_tokens"), F.col("__crc32").alias("ids_crc32"))


_HEX = "CAST('0x' || substr(digest, {}, 8) AS BIGINT)"


@query(f"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || CAST(doc_id AS VARCHAR)) AS digest,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units FROM documents),
drawn AS (
  SELECT *, len(units) AS n, {_HEX.format(1)} % (len(units) + 1) AS a, {_HEX.format(9)} % (len(units) + 1) AS b, {_HEX.format(17)} AS h3, {_HEX.format(25)} AS h4 FROM doc),
cut AS (
  SELECT doc_id, text, n, array_to_string(list_slice(units, 1, least(a, b)), '') AS prefix, array_to_string(list_slice(units, least(a, b) + 1, greatest(a, b)), '') AS middle,
    array_to_string(list_slice(units, greatest(a, b) + 1, n), '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut""")
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    moved = fim.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    back = fim.restore(moved.withColumn("__output", F.sha2(F.col("text").cast("binary"), 256)))
    return back.select(
        "doc_id", F.col("__n").alias("n"), F.col("__form").alias("form"), F.col("__prefix_chars").alias("prefix_chars"), F.col("__middle_chars").alias("middle_chars"),
        F.col("__output").alias("output_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("restored_sha256"),
    )


@query()
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned_documents(table(spark, folder, "documents").select("doc_id", "text"))


@query(f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 2 THEN words[1] ELSE array_to_string(list_slice(words, pos, pos + 1), ' ') END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1) + 1)) AS pos FROM doc WHERE len(words) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
rare AS (SELECT doc_id, shingle, row_number() OVER (PARTITION BY doc_id ORDER BY held, shingle) AS place, n FROM shingle JOIN size USING (doc_id) JOIN (SELECT shingle, count(*) AS held FROM shingle GROUP BY shingle) USING (shingle)),
head AS (SELECT doc_id, shingle FROM rare WHERE place <= n - ceil(0.8 * n) + 1),
may AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM head x JOIN head y ON x.shingle = y.shingle AND x.doc_id < y.doc_id),
near AS (SELECT a, b, sa.n + sb.n AS total FROM may JOIN size sa ON sa.doc_id = a JOIN size sb ON sb.doc_id = b WHERE 5 * least(sa.n, sb.n) >= 4 * greatest(sa.n, sb.n)),
half AS (
  SELECT a, b, total, count(*) AS n FROM near JOIN shingle x ON x.doc_id = a JOIN shingle y ON y.doc_id = b AND x.shingle = y.shingle GROUP BY a, b, total HAVING 100 * count(*) >= 80 * (total - count(*))),
link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT a AS doc_id, a AS other FROM (SELECT DISTINCT a FROM link) UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(r.component_id, d.doc_id) AS component_id, coalesce(r.component_id, d.doc_id) = d.doc_id AS kept
FROM doc d LEFT JOIN size s ON d.doc_id = s.doc_id LEFT JOIN least r ON d.doc_id = r.doc_id""")
def op13_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
