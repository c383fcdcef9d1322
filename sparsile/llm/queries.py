"""Registered queries of the training-data operators, and their check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsile.llm import (chosen_path, gam, lanczos_whiten, line_crf, oph, pareto_mix, phrase_parse, piece_codec, rendezvous, simhash_trie, suffix_tree,
                          token_frames, trigram_scan)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(check: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[build.__name__] = build
        if check is not None:
            CHECKS[build.__name__] = check
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(key: str, of: int):
    return F.crc32(F.col(key).cast("string").cast("binary")) % of


@query()
def op1_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = line_crf.train(docs, table(spark, folder, "labels"))
    rows = docs.select("doc_id", line_crf.label_lines(F.col("text"), model).alias("r")).select("doc_id", "r.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= line_crf.MIN_SHARE))


@query()
def op2_token_frames(spark: SparkSession, folder: str) -> DataFrame:
    return token_frames.read_tokens(token_frames.write_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


@query()
def op3_additive_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = gam.train(docs, table(spark, folder, "labels").filter(~held_out))
    return docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), gam.score(F.col("text"), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.7).cast("int"))


@query()
def op4_one_permutation(spark: SparkSession, folder: str) -> DataFrame:
    return oph.compare_with_edits(table(spark, folder, "documents"))


@query()
def op5_rendezvous(spark: SparkSession, folder: str) -> DataFrame:
    return rendezvous.place(table(spark, folder, "documents"), shards=40)


MIX_SQL = r"""
WITH e AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws('|', CAST(doc_id AS VARCHAR), md5(text), source)) AS digest
  FROM documents),
d AS (
  SELECT doc_id, source, size,
         (CAST('0x' || substr(md5(digest || '#' || CAST(row_number() OVER (PARTITION BY digest) AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM e),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM s),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER f, 0) AS DOUBLE) / CAST((SELECT sum(w) FROM w) - coalesce(sum(w) OVER f, 0) AS DOUBLE) AS level
      FROM w WINDOW f AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT max(level) FROM l) * w) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS share, floor(share) AS copies, target - copies * source_size AS owed FROM t),
h AS (SELECT source, size, CAST(count(*) AS HUGEINT) * size AS words, CAST(count(*) AS HUGEINT) * size * size AS squares FROM d WHERE size > 0 GROUP BY source, size),
c AS (SELECT h.source, h.size, (owed - CAST(coalesce(sum(words) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
             / CAST(sum(squares) OVER (PARTITION BY h.source ORDER BY size) AS DOUBLE) AS factor
      FROM h JOIN p ON h.source IS NOT DISTINCT FROM p.source WHERE owed > 0),
f AS (SELECT source, max_by(factor, size) AS factor FROM c WHERE factor * size < 1 GROUP BY source),
o AS (SELECT p.source, source_size, target, copies, owed, CASE WHEN owed > 0 THEN coalesce(f.factor, 1.0) END AS factor FROM p LEFT JOIN f ON p.source IS NOT DISTINCT FROM f.source),
k AS (SELECT d.doc_id, d.source, d.size, o.source_size, o.target, o.copies, o.owed,
             CASE WHEN factor * size >= 1 THEN 0 WHEN factor * size > 0 THEN (u / (1 - u)) / (factor * size / (1 - factor * size)) END AS rank
      FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST) - sum(size) OVER (PARTITION BY source, rank) / 2 AS upto FROM k)
SELECT doc_id, size, source_size, target, CAST(size * (copies + CASE WHEN rank IS NOT NULL AND upto <= owed THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""


@query(MIX_SQL)
def op6_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    return pareto_mix.mix(table(spark, folder, "documents"))


@query()
def op7_trigram_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").select("doc_id", trigram_scan.find_secrets(F.col("text")).alias("s"))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    number = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    kinds = [r.kind for r in trigram_scan.BASE_RULES]
    base = F.filter("s", lambda x: x["kind"].isin(kinds))
    return found.select("doc_id", *[number(k) for k in kinds], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))


@query()
def op9_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", piece_codec.round_trip(F.col("text"), public_tokenizers.path("piece_bpe_32k.model")).alias("r")).select("doc_id", "r.*")


JOIN_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) ELSE [array_to_string(ws, ' ')] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c >= 0.8 * (nx.n + ny.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, (SELECT min(y) FROM r WHERE x = d.doc_id) AS class_id, (SELECT count(*) FROM e WHERE x = d.doc_id) AS n_links FROM documents d
"""


@query(JOIN_SQL)
def op10_chosen_path(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.similarity_join(table(spark, folder, "documents"))


@query()
def op8_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(remainder("doc_id", 5) == 1, F.lit(False))
    rows = suffix_tree.train_and_score(docs, ~held_out)
    return rows.select("doc_id", F.coalesce(remainder("doc_id", 5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


PHRASE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, ws FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p) WHERE len(ws) > 0),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) r(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, gram, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, gram AS phrase, f AS a, string_split(gram, ' ') AS ws FROM f WHERE k > 1),
s AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) r(m) WHERE m < k) GROUP BY ALL),
x AS (SELECT c.* FROM c LEFT JOIN s USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
y AS (SELECT x.lang, x.phrase, x.a, q.cut, l.f AS l, r.f AS r, t.n, CAST(1000 * x.a::HUGEINT * t.n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
      FROM x JOIN range(1, 5) q(cut) ON q.cut < x.k JOIN t ON t.lang = x.lang JOIN f l ON l.lang = x.lang AND l.gram = array_to_string(x.ws[1:q.cut], ' ')
      JOIN f r ON r.lang = x.lang AND r.gram = array_to_string(x.ws[q.cut + 1:], ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score FROM z
QUALIFY rank <= 2000
"""


@query(PHRASE_SQL)
def op11_phrase_parse(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_parse.mine(table(spark, folder, "documents"))


@query()
def op12_lanczos_whiten(spark: SparkSession, folder: str) -> DataFrame:
    return lanczos_whiten.whiten(table(spark, folder, "embeddings"))


@query()
def op13_simhash_trie(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_trie.classes(table(spark, folder, "documents"))
