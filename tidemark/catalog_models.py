"""Queries of text features, regressions, word vectors and evaluation, and the SQL that gives the same rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tidemark.catalog import ORACLES, QUERIES, WORDS, docs, events, lines, query, r, table, vocab
from tidemark.functions import text as T
from tidemark.operators import asof as A
from tidemark.operators import evaluation as K
from tidemark.operators import features as X
from tidemark.operators import models as M
from tidemark.operators import vectors as V
from tidemark.operators import vocab as J
from tidemark.operators import word2vec as N
from tidemark.plans import ladder as L

FEATURES = 5000
_TERMS = rf"""w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{X.TERM}') AS ws FROM documents),
t AS (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
v AS (SELECT term, row_number() OVER (ORDER BY sum(tf) DESC, term) - 1 AS idx, sum(tf)::BIGINT AS total, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY 1 ORDER BY idx LIMIT {FEATURES})"""


@query(f"WITH {_TERMS} SELECT term, idx::INTEGER AS idx, total, df, round(idf, 6) AS idf FROM v")
def tfidf_vocabulary(spark, folder, size=FEATURES):
    return X.fit_tfidf(docs(spark, folder), "doc_id", "text", size).select("term", "idx", "total", "df", r("idf").alias("idf"))


@query(f"WITH {_TERMS}, x AS (SELECT doc_id, idx, tf * idf AS w FROM c JOIN v USING (term)), n AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM x GROUP BY 1) SELECT doc_id, count(*) AS terms, round(sum(w / n), 6) AS total, round(max(w / n), 6) AS most FROM x JOIN n USING (doc_id) GROUP BY 1")
def tfidf_weights(spark, folder, size=FEATURES):
    d = docs(spark, folder)
    w = X.tfidf(d, X.fit_tfidf(d, "doc_id", "text", size), "doc_id", "text")
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), r(F.sum("weight")).alias("total"), r(F.max("weight")).alias("most"))


#: The reference's number of TF-IDF terms; the two queries above hold FEATURES, as their SQL says.
TERMS = 50_000
for _name in ("tfidf_vocabulary", "tfidf_weights"):
    QUERIES[f"{_name}_50k"] = partial(QUERIES[_name], size=TERMS)
    ORACLES[f"{_name}_50k"] = ORACLES[_name].replace(f"LIMIT {FEATURES})", f"LIMIT {TERMS})")


def items(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), F.col("l_extendedprice").cast("double").alias("price"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS quantity, round((l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER (), 6) AS discount FROM lineitem")
def scaled_columns(spark, folder):
    i = items(spark, folder)
    return X.scale(i, X.fit_scaler(i, ["quantity", "discount"])).select("l_orderkey", "l_linenumber", r("quantity").alias("quantity"), r("discount").alias("discount"))


@query("""WITH x AS (SELECT l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_extendedprice::DOUBLE AS y FROM lineitem),
m AS (SELECT count(*) * var_pop(a) + 1 AS aa, count(*) * covar_pop(a, b) AS ab, count(*) * var_pop(b) + 1 AS bb, count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS yb, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM x),
w AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM m)
SELECT 'quantity' AS name, round(wa, 4) AS weight FROM w UNION ALL SELECT 'discount', round(wb, 4) FROM w UNION ALL SELECT 'intercept', round(my - ma * wa - mb * wb, 4) FROM w""")
def ridge_weights(spark, folder):
    w = M.ridge_dense(items(spark, folder), ["quantity", "discount"], "price")
    return spark.createDataFrame(list(w.items()), "name string, weight double").select("name", r("weight", 4).alias("weight"))


def stories(spark, folder):
    """Documents as stories: an id is an hour, the source an author, pages give URLs, the first 80 characters are the title, log1p of the number of different words the label."""
    pages = table(spark, folder, "pages").groupBy(F.col("page_id").alias("doc_id")).agg(F.min("url").alias("url"))
    d = docs(spark, folder).join(pages, "doc_id", "left")
    text = F.coalesce("text", F.lit(""))
    return d.select("doc_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 3600).alias("time"), F.substring(text, 1, 80).alias("title"), text.alias("text"), F.col("source").alias("by"), "url", F.log1p(F.size(F.array_distinct(F.split(text, " ")))).alias("label"))


_PAST = """s AS (SELECT doc_id, source AS by_, 1700000000 + doc_id * 3600 AS t, ln(1 + len(list_distinct(string_split(coalesce(text, ''), ' ')))) AS y FROM documents),
p AS (SELECT a.doc_id, a.y, a.by_, avg(b.y) FILTER (b.t >= a.t - 86400 - 30 * 86400) AS near, count(b.y) FILTER (b.t >= a.t - 86400 - 30 * 86400) AS n, avg(b.y) AS every, avg(b.y) FILTER (b.by_ = a.by_) AS own FROM s a LEFT JOIN s b ON b.t < a.t - 86400 GROUP BY 1, 2, 3),
q AS (SELECT doc_id, y, coalesce(CASE WHEN n >= 30 THEN near END, every, 0) AS rung1, own FROM p)"""


@query(f"WITH {_PAST} SELECT doc_id, round(rung1, 6) AS rung1, round(coalesce(own, rung1), 6) AS author_prior FROM q")
def story_priors(spark, folder):
    return L.story_features(stories(spark, folder), "label", "doc_id").select("doc_id", r("rung1").alias("rung1"), r("author_prior").alias("author_prior"))


@query("WITH s AS (SELECT doc_id, source, 1700000000 + doc_id * 3600 AS t, ln(1 + len(list_distinct(string_split(coalesce(text, ''), ' ')))) AS y FROM documents) SELECT a.doc_id, count(b.y) AS source_prior_count, CASE WHEN count(b.y) >= 3 THEN round(avg(b.y), 6) END AS source_prior_mean, CASE WHEN count(b.y) >= 3 THEN round(stddev_pop(b.y), 6) END AS source_prior_std FROM s a LEFT JOIN s b ON b.source = a.source AND b.t < a.t - 172800 GROUP BY 1")
def expanding_author_stats(spark, folder):
    s = A.expanding_stats(stories(spark, folder), "by", "time", F.col("label"), 3, "source")
    return s.select("doc_id", "source_prior_count", r("source_prior_mean").alias("source_prior_mean"), r("source_prior_std").alias("source_prior_std"))


@query()
def regression_ladder(spark, folder):
    rows = L.story_features(stories(spark, folder), "label", "doc_id").persist()
    middle = rows.agg(F.percentile_approx("doc_id", 0.7)).first()[0]
    out = L.run_ladder(spark, L.six_rungs("label", "doc_id"), L.spread(rows.where(F.col("doc_id") < middle)), L.spread(rows.where(F.col("doc_id") >= middle)), "label", "doc_id", 10)
    rows.unpersist()
    return out


@query("SELECT coalesce(sum(len(regexp_extract_all(lower(t), '[a-z0-9]+(?:[''\\-][a-z0-9]+)*'))), 0)::BIGINT AS tokens, count(*) AS lines FROM (SELECT text AS t FROM conversations) WHERE len(regexp_extract_all(lower(t), '[a-z0-9]+(?:[''\\-][a-z0-9]+)*')) > 0")
def corpus_totals(spark, folder):
    return J.corpus_totals(table(spark, folder, "conversations").select(T.tokens(F.col("text")).alias("tokens")).where("size(tokens) > 0"))


@query("WITH c AS (SELECT source, count(*) AS n FROM documents WHERE source <> '' GROUP BY 1 HAVING count(*) >= 20) SELECT doc_id, CASE WHEN coalesce(source, '') = '' THEN 1 ELSE coalesce(idx, 0) END::INTEGER AS domain_idx FROM documents LEFT JOIN (SELECT source AS s, row_number() OVER (ORDER BY n DESC, source) + 1 AS idx FROM c) ON s = source")
def domain_encoder(spark, folder):
    d = docs(spark, folder)
    return J.domain_index(d, J.encoder(d, "source", 20, 2), "source").select("doc_id", F.col("domain_idx").cast("int").alias("domain_idx"))


@query("WITH t AS (SELECT conv_id, turn, greatest(len(regexp_extract_all(coalesce(text, ''), '[^ ]+')), 0)::BIGINT AS n FROM conversations), m AS (SELECT n, least(n - 1, 5) AS m FROM t WHERE n > 1) SELECT coalesce(sum(2 * m * n - m * (m + 1)), 0)::BIGINT AS pairs, coalesce(sum(n), 0)::BIGINT AS centres FROM m")
def example_counts(spark, folder):
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ ]+"), F.lit(0))
    return J.count_examples(table(spark, folder, "conversations").select(words.alias("ids")), 5)


def _assembled(spark, folder):
    return X.vectors(items(spark, folder), [], ["quantity", "discount"])


@query()
def boosted_tree_ladder(spark, folder):
    rows = _assembled(spark, folder).persist()
    train, test = rows.where("l_orderkey % 5 > 0"), rows.where("l_orderkey % 5 = 0")
    model = M.boosted(train, "price", trees=10, depth=3)
    out = M.tree_ladder(model, test, "price", [1, 2, 5, 10, 20])
    rows.unpersist()
    return spark.createDataFrame(out, "trees int, rmse double")


_SPACE = "s AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS u FROM s)"


def space(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vector"), "label")


@query(f"""WITH {_SPACE}, q AS (SELECT a.vec_id AS qid, b.vec_id AS b, c.vec_id AS c, d.vec_id AS d, list_transform(range(1, len(a.u) + 1), lambda i: b.u[i] - a.u[i] + c.u[i]) AS v FROM u a JOIN u b ON b.vec_id = a.vec_id + 1 JOIN u c ON c.vec_id = a.vec_id + 2 JOIN u d ON d.vec_id = a.vec_id + 3 WHERE a.vec_id % 20 = 0),
f AS (SELECT qid, d, max_by(u.vec_id, list_dot_product(u.u, v)) AS found FROM q JOIN u ON u.vec_id NOT IN (qid, b, c) GROUP BY 1, 2)
SELECT round(avg(CASE WHEN found = d THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS covered FROM f""")
def analogy_accuracy(spark, folder):
    s = space(spark, folder)
    asked = s.where("word % 20 = 0").select(F.col("word").alias("qid"), F.col("word").alias("a"), *[(F.col("word") + i).alias(n) for i, n in enumerate("bcd", 1)])
    return K.analogies(s, asked).select(r("accuracy").alias("accuracy"), "covered")


@query("""WITH p AS (SELECT x.vec_id, (x.vec_id * 37) % 101 AS rating, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS s FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1),
k AS (SELECT rank() OVER (ORDER BY rating) + (count(*) OVER (PARTITION BY rating) - 1) / 2 AS a, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS b FROM p) SELECT round(corr(a, b), 4) AS spearman, count(*) AS covered FROM k""")
def word_similarity(spark, folder):
    s = space(spark, folder)
    pairs = s.select(F.col("word").alias("left"), (F.col("word") + 1).alias("right"), ((F.col("word") * 37) % 101).cast("double").alias("rating"))
    return K.word_similarity(s, pairs).select(r("spearman", 4).alias("spearman"), "covered")


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), n AS (SELECT q.vec_id AS query, max_by(e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS found FROM q JOIN embeddings e ON e.vec_id <> q.vec_id GROUP BY 1), p AS (SELECT x.vec_id AS query, min(y.vec_id) AS id FROM q x JOIN embeddings y ON y.label = x.label AND y.vec_id <> x.vec_id GROUP BY 1)
SELECT round(avg(CASE WHEN found = id THEN 1.0 ELSE 0.0 END), 6) AS recall FROM p LEFT JOIN n USING (query)""")
def synonym_recall(spark, folder):
    s = table(spark, folder, "embeddings")
    asked = s.where("vec_id % 20 = 0")
    pairs = asked.alias("x").join(s.alias("y"), F.expr("y.label = x.label AND y.vec_id <> x.vec_id")).groupBy(F.col("x.vec_id").alias("query")).agg(F.min("y.vec_id").alias("id"))
    return K.synonym_recall(V.neighbours(s, asked, 1), pairs).select(r("recall").alias("recall"))


@query(f"""WITH {_SPACE.replace('embedding::DOUBLE[]', 'embedding[1:8]::DOUBLE[]')}, h AS (SELECT vec_id, e AS h FROM s), q AS (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0),
a AS (SELECT * FROM (SELECT q.vec_id AS query, y.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) DESC, y.vec_id) AS rank FROM q JOIN embeddings x USING (vec_id) JOIN embeddings y ON y.vec_id <> q.vec_id) WHERE rank <= 10),
b AS (SELECT * FROM (SELECT q.vec_id AS query, y.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(x.h, y.h) DESC, y.vec_id) AS rank FROM q JOIN h x USING (vec_id) JOIN h y ON y.vec_id <> q.vec_id) WHERE rank <= 10)
SELECT round((SELECT count(*) FROM a JOIN b USING (query, id)) / (SELECT count(*) FROM q) / 10, 6) AS overlap""")
def neighbour_overlap(spark, folder):
    s = table(spark, folder, "embeddings")
    short = s.withColumn("embedding", F.slice("embedding", 1, 8))
    near = lambda x: V.neighbours(x, x.where("vec_id % 20 = 0"), 10)
    return V.overlap(near(s), near(short), 10).select(r("overlap").alias("overlap"))


@query("""WITH p AS (SELECT year(o_orderdate) AS run, month(o_orderdate) AS step, avg(o_totalprice)::DOUBLE AS loss FROM orders GROUP BY 1, 2), x AS (SELECT *, loss - lag(loss) OVER (PARTITION BY run ORDER BY step) AS rise FROM p),
g AS (SELECT run, count(*) AS points, max_by(loss, step) > min_by(loss, step) AS diverged, count(*) FILTER (rise > 0) AS up, max(rise) AS most, min_by(loss, step) - max_by(loss, step) AS fall FROM x GROUP BY 1)
SELECT run, points, diverged, CASE WHEN diverged THEN points ELSE up END AS upticks, CASE WHEN NOT diverged AND points > 1 THEN round(most, 4) END AS largest_uptick, CASE WHEN NOT diverged AND points > 1 THEN round(fall, 4) END AS fall FROM g""")
def loss_curves(spark, folder):
    p = table(spark, folder, "orders").groupBy(F.year("o_orderdate").alias("run"), F.month("o_orderdate").alias("step")).agg(F.avg("o_totalprice").alias("loss"))
    c = K.curve_report(p, "run", "step", "loss")
    return c.select("run", "points", "diverged", "upticks", r("largest_uptick", 4).alias("largest_uptick"), r("fall", 4).alias("fall"))


@query("SELECT event_type, count(*) AS runs, count(*) FILTER (value > 20) AS survivors, round(avg(value) FILTER (value > 20), 6) AS mean, round((max(value) FILTER (value > 20)) - (min(value) FILTER (value > 20)), 6) AS spread, round(max(value) FILTER (value > 20), 6) AS worst FROM events GROUP BY 1")
def seed_summary(spark, folder):
    g = K.seed_summary(events(spark, folder), "event_type", F.col("value"), F.col("value") > 20)
    return g.select("event_type", "runs", "survivors", *[r(c).alias(c) for c in ("mean", "spread", "worst")])


@query()
def sif_without_component(spark, folder):
    s = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    left = X.without_component(F.col("embedding"), X.common_component(s, "embedding"))
    return s.select("vec_id", r(V.norm(left)).alias("length"))


def _trained(spark, folder, objective):
    v = vocab(spark, folder, WORDS).persist()
    config = N.Config(objective=objective, width=16, window=2, rounds=2, rate=0.05, threshold=1e-3, partitions=4)
    model = N.train(J.known_ids(lines(spark, folder), v).persist(), v, config)
    return spark.createDataFrame([(i, x) for i, x in enumerate(model.loss_trace, 1)], "round int, loss double").select("round", r("loss", 4).alias("loss"))


@query()
def word2vec_skipgram(spark, folder):
    return _trained(spark, folder, "skipgram")


@query()
def word2vec_cbow(spark, folder):
    return _trained(spark, folder, "cbow")
