"""One query per operator with production parameters, over whole tables, and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.ship import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.substring_dedup import SubstringDedup

    out = SubstringDedup(window=13).transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op5_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS p FROM w WHERE len(ws) >= 13),
k AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS win FROM s),
least_id AS (SELECT win, min(doc_id) AS m FROM k GROUP BY win),
gone AS (SELECT DISTINCT doc_id, p + o AS p FROM k JOIN least_id USING (win), generate_series(0, 12) AS t(o) WHERE m < doc_id),
one AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.ngram_jaccard import NgramJaccardJoin

    return NgramJaccardJoin(size=5, percent=75).classes(table(spark, sf_dir, "documents"))


ORACLES["op3_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) AS p FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS sh FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM w UNION SELECT r.d, e.y FROM r JOIN e ON r.c = e.x)
SELECT w.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.d = w.doc_id GROUP BY w.doc_id
"""


@query
def op3_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of documents it links with, over all links."""
    from lattica.llm.ngram_jaccard import NgramJaccardJoin

    return NgramJaccardJoin(size=5, percent=75).linked(table(spark, sf_dir, "documents"))[1]


ORACLES["op3_ngram_jaccard_links"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) AS p FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS sh FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y, c = a.n AND c = b.n AS same FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x AS d, y AS o, same FROM l UNION ALL SELECT y, x, same FROM l),
k AS (SELECT d, count(*) AS n_links, min(o) FILTER (same) AS least_same FROM e GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CASE WHEN n > 0 THEN least(w.doc_id, coalesce(least_same, w.doc_id)) END AS rep,
       CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.d = w.doc_id
"""


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.decontaminate import Decontaminator

    leaks = Decontaminator(min_match=5, coverage=0.5).leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.drop("tiles")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.toxicity import PuToxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    scored = PuToxicity().fit(docs, labels, learn=~held_out).transform(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.mix import SourceMix

    return SourceMix().takes(table(spark, sf_dir, "documents")).drop("source", "_row")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query
def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.topk import ExactTopK

    vectors = table(spark, sf_dir, "embeddings")
    return ExactTopK(k=5, scale=256).transform(vectors, vectors.where("vec_id % 50 = 0")).drop("read")


ORACLES["op2_exact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.html_text import TemplateRemoval

    return TemplateRemoval(slots=True).transform(table(spark, sf_dir, "pages"))


@query
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.lm_score import StupidBackoff

    scored = StupidBackoff(order=3, alpha=0.4).score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("score", 4).alias("score"), "n_full")


ORACLES["op10_lm_score"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w1, unnest(generate_series(1, len(ws))) AS i FROM w),
g AS (SELECT doc_id, i, w1, lag(w1) OVER d AS c1, lag(w1) OVER d || ' ' || w1 AS w2,
             lag(w1, 2) OVER d || ' ' || lag(w1) OVER d AS c2, lag(w1, 2) OVER d || ' ' || lag(w1) OVER d || ' ' || w1 AS w3
      FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
o1 AS (SELECT doc_id, w1 AS k, count(*) AS n FROM g GROUP BY 1, 2), t1 AS (SELECT k, sum(n) AS n FROM o1 GROUP BY 1),
o2 AS (SELECT doc_id, w2 AS k, count(*) AS n FROM g WHERE i > 1 GROUP BY 1, 2), t2 AS (SELECT k, sum(n) AS n FROM o2 GROUP BY 1),
o3 AS (SELECT doc_id, w3 AS k, count(*) AS n FROM g WHERE i > 2 GROUP BY 1, 2), t3 AS (SELECT k, sum(n) AS n FROM o3 GROUP BY 1),
n1 AS (SELECT o1.doc_id, k, t1.n - o1.n AS n FROM o1 JOIN t1 USING (k)),
n2 AS (SELECT o2.doc_id, k, t2.n - o2.n AS n FROM o2 JOIN t2 USING (k)),
n3 AS (SELECT o3.doc_id, k, t3.n - o3.n AS n FROM o3 JOIN t3 USING (k)),
s AS (SELECT g.doc_id, i, a.n AS u, b.n AS b, c.n AS c, x.n AS cb, y.n AS cc, len(w.ws) AS nw FROM g JOIN w USING (doc_id)
      JOIN n1 a ON a.doc_id = g.doc_id AND a.k = g.w1
      LEFT JOIN n2 b ON b.doc_id = g.doc_id AND b.k = g.w2 LEFT JOIN n3 c ON c.doc_id = g.doc_id AND c.k = g.w3
      LEFT JOIN n1 x ON x.doc_id = g.doc_id AND x.k = g.c1 LEFT JOIN n2 y ON y.doc_id = g.doc_id AND y.k = g.c2),
z AS (SELECT doc_id, CASE WHEN c > 0 THEN 3 WHEN b > 0 THEN 2 ELSE 1 END AS level, least(i, 3) AS top,
             CASE WHEN c > 0 THEN ln(CAST(c AS DOUBLE) / cc) WHEN b > 0 THEN ln(CAST(b AS DOUBLE) / cb)
                  ELSE ln(greatest(u, 1)::DOUBLE) - ln(greatest((SELECT count(*) FROM t) - nw, 1)::DOUBLE) END AS v FROM s),
r AS (SELECT doc_id, sum(v + (top - level) * ln(0.4)) AS score, count(*) FILTER (level = top) AS n_full FROM z GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(score, 0), 4) AS score, CAST(coalesce(n_full, 0) AS BIGINT) AS n_full
FROM w LEFT JOIN r USING (doc_id)
"""


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.shared import cut, new_path
    from lattica.llm.warc import PageArchive

    archive, path = PageArchive(min_bytes=1000), new_path(spark, "warc")
    archive.write(table(spark, sf_dir, "pages"), path, cut)
    return archive.read(spark, path).drop("url")


ORACLES["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS first FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html
"""


#: Marks of junk text that a revision strips before it counts anew.
JUNK = "[*#$%&]+"


@query
def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in, those labelled toxic go, those labelled of low quality are counted anew without junk."""
    from lattica.llm.shared import cut, new_path
    from lattica.llm.token_rollup import TokenRollup, quarter_tokens, word_tokens

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rollup = TokenRollup(spark, new_path(spark, "rollup"), {"words-1": word_tokens, "quarter-bytes-1": quarter_tokens})
    gone, poor = labels.where("toxic = 1"), labels.where("quality = 0 AND toxic = 0")
    counted = cut(rollup.counted(docs, text="text", clean=F.regexp_replace("text", F.lit(JUNK), F.lit(""))), "counted")
    rollup.apply("insert", rollup.changes(counted, 1))
    for _ in range(2):  # a retried batch counts once
        rollup.apply("toxic", rollup.changes(counted, -1, among=gone))
        rollup.apply("revise", rollup.revision(counted, "text", "clean", among=poor))
    return rollup.totals()


ORACLES["op9_token_rollup"] = r"""
WITH d AS (SELECT source, lang, CASE WHEN p.doc_id IS NULL THEN text ELSE regexp_replace(text, '[*#$%&]+', '', 'g') END AS text
           FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0 AND toxic = 0) p USING (doc_id)
           ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) t USING (doc_id)),
c AS (SELECT source, lang, 'words-1' AS tokenizer, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM d
      UNION ALL SELECT source, lang, 'quarter-bytes-1', coalesce(ceil(strlen(text) / 4.0), 0) FROM d)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM c GROUP BY 1, 2, 3
"""


WORDS = r"[^\x20\x09-\x0D]+"


def _looped(docs: DataFrame) -> DataFrame:
    """The documents, every tenth of which by hash repeats a stretch of its words to its end."""
    ws, h = F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), F.crc32(F.col("doc_id").cast("string"))
    own = docs.select("doc_id", "text", h.alias("_h"), F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, ws).alias("_ws"))
    n = F.size("_ws")
    own = own.withColumn("_a", F.when(n > 0, F.col("_g") % n))
    own = own.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    a, rest = F.col("_a").cast("int"), (n - F.col("_a")).cast("int")
    cycle = F.slice("_ws", a + 1, F.col("_p"))
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(rest / F.col("_p")).cast("int"))), F.lit(1), rest)
    looped = F.concat_ws(" ", F.concat(F.slice("_ws", F.lit(1), a), tail))
    return own.select("doc_id", F.when(F.col("_a").isNull(), F.col("text")).otherwise(looped).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.periodic import PeriodicRuns

    out = PeriodicRuns(min_length=6, min_exponent=4).transform(_looped(table(spark, sf_dir, "documents")))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))))
    told = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("f"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))
    length = -F.col("f.less")
    return told.select("doc_id", "n_runs", F.col("f.start").alias("start"), length.alias("length"), F.col("f.period").alias("period"), F.expr("-f.less * 1000 div f.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    from lattica.llm.centroids import WeightedLloyd

    out = WeightedLloyd(k=8, rounds=10, scale=1024, size=64, seed="3").fit(table(spark, sf_dir, "embeddings"))
    fits = lambda n: n if n < 1 << 63 else None
    of = [(k, fits(n), fits(sum(out.inertias)), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, (c, n) in enumerate(zip(out.centroids, out.inertias, strict=True))]
    clusters = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.members.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # 8 rows


def _lloyd_sql(k: int, rounds: int, scale: int, seed: str) -> str:
    """Lloyd's rounds over all vectors, one after the other."""
    near = "(SELECT v.r, v.q, min(dist * 16 + k) % 16 AS k, min(dist * 16 + k) // 16 AS distance FROM (SELECT v.r, v.q, c.k, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS dist FROM v, {c} c) v GROUP BY v.r, v.q)"
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(%d * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)" % scale,
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS k, q FROM (SELECT sha256('{seed}:' || vec_id) AS h, q FROM v ORDER BY h, q LIMIT {k}))",
    ]
    for n in range(1, rounds + 1):
        last = f"c{n - 1}"
        steps += [
            f"a{n} AS MATERIALIZED {near.format(c=last)}",
            f"e{n} AS (SELECT k, unnest(q) AS x, unnest(generate_series(1, 64)) AS d FROM a{n})",
            f"f{n} AS (SELECT k, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS m FROM e{n} GROUP BY 1, 2)",
            f"g{n} AS (SELECT k, list((s - ((s % m) + m) % m) // m ORDER BY d) AS q FROM f{n} GROUP BY 1)",
            f"c{n} AS MATERIALIZED (SELECT k, coalesce(g{n}.q, {last}.q) AS q FROM {last} LEFT JOIN g{n} USING (k))",
        ]
    last = f"c{rounds}"
    steps.append(f"p AS MATERIALIZED {near.format(c=last)}")
    steps.append("i AS (SELECT k, CAST(sum(distance) AS BIGINT) AS own FROM p GROUP BY 1)")
    return f"WITH {', '.join(steps)} SELECT vec_id, CAST(p.k AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, own AS cluster_inertia, (SELECT CAST(sum(own) AS BIGINT) FROM i) AS inertia, sha256(array_to_string({last}.q, ',')) AS centroid_sha256 FROM p JOIN v USING (r) JOIN i ON i.k = p.k JOIN {last} ON {last}.k = p.k"


ORACLES["op12_centroid_clusters"] = _lloyd_sql(8, 10, 1024, "3")


@query
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.quality import QualityMachine

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = QualityMachine(rank=8).fit(docs, labels, learn=~held_out).transform(docs.select("doc_id", "text", "n_chars"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
