"""The registered queries over ``documents`` and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import audit, bestfit, fingerprint, jaccard, language, licenses, media, mixing, packing, pii, quality, resampling, toxicity
from flowlens.llm.common import fold, labelled, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = table(spark, sf_dir, "documents").select("doc_id", pii.spans_column(spark, "text").alias("found"))
    return found.select("doc_id", *[count(kind) for kind in pii.BASE_KINDS], F.sha2(written(F.col("found.base")), 256).alias("base_sha256"), written(F.col("found.spans")).alias("spans"), F.size("found.spans").cast("long").alias("n_spans"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 4) == 2
    model = language.fit(docs.where(~held))
    found = language.predict_column(spark, model, "text")
    return docs.select("doc_id", held.alias("held_out"), found.alias("found")).select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(labelled(docs, table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 5) != 0, toxicity.DOCS_PER_CLASS))
    signals = toxicity.signals_column(spark, model, "text")
    scored = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), signals.alias("s"))
    return scored.select("doc_id", "held_out", F.col("s.score").alias("score"), (F.col("s.score") >= 0.5).cast("int").alias("predicted"), F.col("s.spans").alias("spans"))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Forest:
    rows = labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", fold("doc_id", 4) != 2, quality.DOCS_PER_CLASS)
    return quality.fit(rows)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = quality.score_column(spark, quality_model(spark, sf_dir), "text")
    return docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), media.store_column("text").alias("media"))
    return stored.select("doc_id", "n_bytes", media.features_column("media").alias("m")).select("doc_id", "n_bytes", "m.*")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = licenses.scan_column(spark, "text")
    got = table(spark, sf_dir, "documents").select("doc_id", scan.alias("s")).select("doc_id", "s.*")
    starts, base, found = F.transform("base", lambda b: b["start"]), F.transform("base", lambda b: b["label"]), F.transform("found", lambda m: m["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    # A matched template is full evidence; a phrase alone, without the wording around it, is half.
    score = F.when(F.size("found") > 0, 1.0).when(F.size("base") > 0, 0.5).otherwise(0.0)
    return got.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, found)).alias("labels"), score.alias("score"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"))


def op11_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_documents(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    every = (op1_pii, op2_packing, op3_language, op4_toxicity, op5_quality, op6_mixing, op7_media, op8_licenses, op9_fingerprint, op10_jaccard, op11_bestfit, op12_resampling, op13_audit)
    return {query.__name__: query for query in every}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP10_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * i >= 90 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, c.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY 1) c ON c.a = n.doc_id
"""




def _crc_step() -> str:
    """The CRC-32 state ``c`` after a byte ``b``. The table of the CRC is linear: an entry is the sum of those of its bits."""
    terms = []
    for k in range(8):
        value = 1 << k
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        terms.append(f"(xor(c, b) >> {k} & 1) * {value}")
    out = "c >> 8"
    for term in terms:
        out = f"xor({out}, {term})"
    return out


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_DIGIT = "instr('0123456789ABCDEF', substr(h, {}, 1)) - 1"
OP12_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
v AS (SELECT {_WORDS} AS ws FROM benchmark),
f AS (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])))) AS f FROM w),
bf AS (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])))) AS f FROM v),
x AS (SELECT f, hex(f) AS h FROM (SELECT f FROM f UNION SELECT f FROM bf)),
y AS (SELECT f, list_transform(range(0, len(h) // 2), lambda i: CAST(16 * ({_DIGIT.format("2 * i + 1")}) + {_DIGIT.format("2 * i + 2")} AS BIGINT)) AS bytes FROM x),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: {_crc_step()}), 4294967295) % 10000 AS bucket FROM y),
s AS (SELECT bucket, count(*) AS n FROM f JOIN b USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN b USING (f) GROUP BY 1),
k AS (SELECT (SELECT count(*) FROM f) AS s, (SELECT count(*) FROM bf) AS t),
g AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (k.s + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * (k.t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM k, s LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN b USING (f) JOIN g USING (bucket) GROUP BY 1),
h AS (SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST(concat('0x', substr(sha256(concat('7:', doc_id)), 1, 8)) AS BIGINT) AS h FROM w LEFT JOIN m USING (doc_id)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM z WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * (SELECT count(*) FROM r) // 100 THEN place END AS rank FROM z LEFT JOIN r USING (doc_id)
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
c AS (SELECT doc_id, part, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals, length(t) AS points, regexp_matches(t, '[#$%&*|]') AS symbol, coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS copy FROM d),
m AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END + CASE WHEN 100 * capitals > 5 * points THEN 4 ELSE 0 END + CASE WHEN symbol THEN 8 ELSE 0 END + CASE WHEN copy THEN 16 ELSE 0 END AS mask FROM c LEFT JOIN l USING (doc_id)),
n AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY 1, 2),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
o AS (SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step]) - bits[step] AS earlier FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
FROM (SELECT part, filter_order, step, bit, CAST(earlier AS BIGINT) AS earlier, CAST(mask AS BIGINT) AS mask, n, good, toxic FROM n, s) q GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""


def oracle_sql() -> dict[str, str]:
    """The other numbered queries rest on models, automata, tokenizers or Spark's hashes, which SQL lacks; tests hold them against brute force."""
    return {"op10_jaccard": OP10_SQL, "op12_resampling": OP12_SQL, "op13_audit": OP13_SQL}
