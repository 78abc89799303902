"""Queries over features, folds, metrics, vectors and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import crossfit, dedup, graph, ml, sequence, stats
from ..sources.shared import written
from . import adapters as A
from .registry import query


@query(
    """WITH r AS (SELECT source, avg(quality) AS rate, count(*) AS total FROM documents JOIN labels USING (doc_id) GROUP BY source)
    SELECT source, round(rate, 9) AS rate, total, ((row_number() OVER (ORDER BY rate DESC, total DESC, source DESC) - 1) % 5 + 1)::INT AS fold FROM r"""
)
def fold_assignment(spark, sf_dir):
    d = A.labelled(spark, sf_dir).filter("quality IS NOT NULL")
    return sequence.fold_of(d, "source", "quality", 5).withColumn("rate", F.round("rate", 9))


_FOLDS = """r AS (SELECT source, avg(quality) AS rate, count(*) AS total FROM documents JOIN labels USING (doc_id) GROUP BY source),
    folds AS (SELECT source, ((row_number() OVER (ORDER BY rate DESC, total DESC, source DESC) - 1) % 5 + 1)::INT AS fold FROM r)"""


def _leaks(rows, group, fold):
    """Groups that are in the training and the test side of a fold, counted once a fold."""
    found = None
    for k in range(1, 6):
        both = dedup.shared_keys(rows.filter(F.col(fold) == k), rows.filter(F.col(fold) != k), group)
        found = both if found is None else found.unionByName(both)
    return found.agg(F.count("*").alias("shared"))


def fold_leaks(spark, sf_dir):
    """The leaks of the folds by source."""
    return _leaks(sequence.fold_of(A.labelled(spark, sf_dir).filter("quality IS NOT NULL"), "source", "quality", 5), "source", "fold")


@query(
    f"""WITH {_FOLDS}, k AS (SELECT unnest(range(1, 6)) AS k), loose AS (SELECT DISTINCT source, doc_id % 5 + 1 AS fold FROM documents)
    SELECT (SELECT count(*) FROM (SELECT k, source FROM folds JOIN k ON fold = k INTERSECT SELECT k, source FROM folds JOIN k ON fold <> k)) AS shared,
           (SELECT count(*) FROM (SELECT k, source FROM loose JOIN k ON fold = k INTERSECT SELECT k, source FROM loose JOIN k ON fold <> k)) AS shared_of_loose"""
)
def fold_overlap_audit(spark, sf_dir):
    """Sources on both sides of a fold: none of folds by source, many of folds by row."""
    loose = A.table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 5 + 1).alias("fold"))
    return fold_leaks(spark, sf_dir).crossJoin(_leaks(loose, "source", "fold").withColumnRenamed("shared", "shared_of_loose"))


_TEXT = "concat('Predicate: Buffer Overflow 42 in free() | Code: if (a) {', chr(10), '    return malloc(n);', chr(10), '} ', text)"
_COUNT = "((length({0}) - length(replace({0}, '{1}', ''))) / {2})::DOUBLE"
_FEATURES_SQL = ", ".join(
    [
        "len(lines)::DOUBLE AS line_count", "length(code)::DOUBLE AS char_count", "round(length(code) / len(lines)::DOUBLE, 6) AS avg_line_len",
        r"list_max(list_transform(lines, lambda s: length(s) - length(regexp_replace(s, '^\s+', '')))) / 4.0::DOUBLE AS max_indent",
        *(f"len(list_filter(tokens, lambda t: t = '{w}'))::DOUBLE AS control_{k:02d}" for k, w in enumerate(fixed.CONTROL_KEYWORDS)),
        *(f"{_COUNT.format('b', w, len(w))} AS safety_{k:02d}" for k, w in enumerate(fixed.SAFETY_KEYWORDS)),
        *(f"{_COUNT.format('code', w, len(w))} AS symbol_{k:02d}" for k, w in enumerate(fixed.SYMBOLS)),
        "5.0::DOUBLE AS pred_words", "length(p)::DOUBLE AS pred_chars", "round(2.0 / length(p), 6)::DOUBLE AS pred_upper", "round(2.0 / length(p), 6)::DOUBLE AS pred_digit",
    ]
)


@query(
    rf"""WITH t AS (SELECT doc_id, substr(x, instr(x, ' | Code: ') + 9) AS code, replace(substr(x, 1, instr(x, ' | Code: ') - 1), 'Predicate: ', '') AS p FROM (SELECT doc_id, {_TEXT} AS x FROM documents)),
    l AS (SELECT *, string_split(code, chr(10)) AS lines, regexp_split_to_array(lower(code), '\s+') AS tokens, lower(p) || ' ' || lower(code) AS b FROM t) SELECT doc_id, {_FEATURES_SQL} FROM l"""
)
def domain_features(spark, sf_dir):
    """All 60 features of a predicate and each document's whole text."""
    d = A.table(spark, sf_dir, "documents").withColumn("x", F.expr(_TEXT)).select("doc_id", *ml.domain_features("x"))
    return d.withColumns({c: F.round(c, 6) for c in ("avg_line_len", "pred_upper", "pred_digit")})


@query(
    """WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - mq) / sq, 6) AS l_quantity, round((l_tax - mt) / st, 6) AS l_tax FROM lineitem, s"""
)
def standard_scaler(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    found = ml.scaled(li, li, "l_quantity", "l_tax")
    return found.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_tax")})


@query(
    """WITH p AS (SELECT item_id, ' ' || lower(text) || ' ' AS t FROM benchmark), g AS (SELECT DISTINCT item_id, substr(t, i, n) AS gram FROM p, unnest([3, 4, 5]) AS a(n), unnest(range(1, length(t) + 1)) AS u(i) WHERE i + n - 1 <= length(t)), d AS (SELECT gram, count(*) AS df FROM g GROUP BY gram)
    SELECT gram, df, round(ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)::DOUBLE) + 1, 9) AS idf FROM d ORDER BY df DESC, gram LIMIT 1000"""
)
def ngram_tfidf_top(spark, sf_dir):
    """The vocabulary of the thousand most frequent n-grams."""
    found = ml.vocabulary(A.table(spark, sf_dir, "benchmark"), "item_id", "text", 1000)
    return found.select("gram", "df", F.round("idf", 9).alias("idf"))


@query(
    """WITH p AS (SELECT item_id, ' ' || lower(text) || ' ' AS t FROM benchmark), g AS (SELECT item_id, substr(t, i, n) AS gram FROM p, unnest([3, 4, 5]) AS a(n), unnest(range(1, length(t) + 1)) AS u(i) WHERE i + n - 1 <= length(t)),
    c AS (SELECT item_id, gram, count(*) AS c FROM g GROUP BY ALL), v AS (SELECT gram, count(*) AS df FROM c GROUP BY gram ORDER BY df DESC, gram LIMIT 1000),
    w AS (SELECT item_id, gram, (1 + ln(c)) * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)::DOUBLE) + 1) AS w FROM c JOIN v USING (gram))
    SELECT item_id, gram, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 9) AS weight FROM w"""
)
def tfidf_weights(spark, sf_dir):
    b = A.table(spark, sf_dir, "benchmark")
    return ml.tfidf(b, "item_id", "text", ml.vocabulary(b, "item_id", "text", 1000)).withColumn("weight", F.round("weight", 9))


@query(
    """WITH l AS (SELECT vec_id, (label < 5)::INT AS y, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT k, avg(x) FILTER (WHERE y = 1) AS p, avg(x) FILTER (WHERE y = 0) AS n FROM l GROUP BY k),
    d AS (SELECT vec_id, sqrt(sum((x - p) * (x - p))) AS dp, sqrt(sum((x - n) * (x - n))) AS dn FROM l JOIN m USING (k) GROUP BY vec_id) SELECT vec_id, round(dn / (dp + dn + 1e-6), 9) AS p FROM d"""
)
def centroid_classifier(spark, sf_dir):
    v = A.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") < 5).cast("int").alias("y"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return ml.centroid_scores(v, v.select("vec_id", "v"), "y", "v").select("vec_id", F.round("p", 9).alias("p"))


_SCORED = "s AS (SELECT doc_id, lang, quality, (doc_id * 7919 % 100) / 100.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"


def _scored(spark, sf_dir):
    return A.labelled(spark, sf_dir).filter("quality IS NOT NULL").select("doc_id", "lang", "quality", (F.col("doc_id") * 7919 % 100 / 100.0).alias("score"))


@query(
    f"""WITH {_SCORED}, c AS (SELECT lang, count(*) FILTER (WHERE quality = 0 AND score < 0.5) AS tn, count(*) FILTER (WHERE quality = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE quality = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE quality = 1 AND score >= 0.5) AS tp FROM s GROUP BY lang)
    SELECT *, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS sensitivity, coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS specificity, (coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0.5) + coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0.5)) / 2 AS balanced_accuracy FROM c"""
)
def confusion_matrix(spark, sf_dir):
    return ml.confusion(_scored(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.5).cast("int")), "quality", "predicted", "lang")


@query(
    f"""WITH {_SCORED}, r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r FROM s), c AS (SELECT lang, count(*) FILTER (WHERE quality = 1) AS positives, count(*) FILTER (WHERE quality <> 1) AS negatives, coalesce(sum(r) FILTER (WHERE quality = 1), 0) AS t FROM r GROUP BY lang)
    SELECT lang, positives, negatives, round(coalesce((t - positives * (positives + 1) / 2.0) / nullif(positives * negatives, 0), 0.5), 9)::DOUBLE AS auc FROM c"""
)
def roc_auc(spark, sf_dir):
    return ml.roc_auc(_scored(spark, sf_dir), "quality", "score", "lang").withColumn("positives", F.col("positives").cast("long")).withColumn("negatives", F.col("negatives").cast("long")).withColumn("auc", F.round("auc", 9))


_STEPS = f"""{_SCORED}, g AS (SELECT score, count(*) FILTER (WHERE quality = 1) AS p, count(*) AS n FROM s GROUP BY score), c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS al, sum(p) OVER () AS total FROM g)"""


@query(f"WITH {_STEPS} SELECT round(sum(p * tp / al) / sum(p), 9)::DOUBLE AS average_precision FROM c")
def average_precision(spark, sf_dir):
    found = ml.average_precision(_scored(spark, sf_dir), "quality", "score")
    return found.select(F.round("average_precision", 9).alias("average_precision"))


@query(f"WITH {_STEPS}, r AS (SELECT score, tp / total AS r, tp / al AS q FROM c), t AS (SELECT (r - lag(r, 1, 0) OVER (ORDER BY score DESC)) * (q + lag(q, 1, 1) OVER (ORDER BY score DESC)) / 2 AS a FROM r) SELECT round(sum(a), 9)::DOUBLE AS pr_auc FROM t")
def trapezoid_pr_auc(spark, sf_dir):
    found = ml.trapezoid_pr_auc(_scored(spark, sf_dir), "quality", "score")
    return found.select(F.round("pr_auc", 9).alias("pr_auc"))


@query(f"WITH {_SCORED}, f AS (SELECT lang, avg((quality = (score >= 0.5)::INT)::INT) AS a FROM s GROUP BY lang) SELECT round(avg(a), 9) AS accuracy_mean, round(stddev_pop(a), 9) AS accuracy_std FROM f")
def macro_metrics(spark, sf_dir):
    s = _scored(spark, sf_dir)
    folds = s.groupBy("lang").agg(F.avg((F.col("quality") == (F.col("score") >= 0.5).cast("int")).cast("int")).alias("accuracy"))
    found = ml.macro(folds, "accuracy")
    return found.select(*(F.round(c, 9).alias(c) for c in found.columns))


def _stage_features(spark, sf_dir, size=1000, dealt=None):
    """The labelled documents in stratified folds by source, with what each fold's model sees of them."""
    d = A.labelled(spark, sf_dir).filter("quality IS NOT NULL")
    folds = crossfit.stratified_group_folds(d, "source", "quality", 5, [42]).select("source", "fold")
    x = F.concat(F.lit(fixed.PREDICATE_PREFIX), F.col("lang"), F.lit(fixed.CODE_DELIMITER), F.col("text"))
    placed = written(d.join(folds, "source").select("doc_id", "quality", "fold", x.alias("x")), "placed")
    return crossfit.stage_features(placed, "doc_id", "x", "quality", "fold", size, dealt)


@query()
def null_model(spark, sf_dir):
    """The control: trees fitted to labels dealt out anew among each fold's training rows, judged by true ones."""
    return crossfit.null_check(_stage_features(spark, sf_dir, dealt=42), "doc_id", "quality").withColumn("balanced_accuracy", F.round("balanced_accuracy", 9))


@query()
def gbt_classifier(spark, sf_dir):
    """Boosted trees on the domain features: every labelled row scored by the model that its fold had no part in."""
    judged = crossfit.out_of_fold(_stage_features(spark, sf_dir, 0), "doc_id", "quality")
    return judged.select("doc_id", "fold", F.round("score", 9).alias("score"), "predicted")


@query()
def gbt_fold_report(spark, sf_dir):
    """One row a fold of the cross-validation of boosted trees on n-gram weights and domain features, with the spread over folds and the pooled areas."""
    found = crossfit.fold_report(crossfit.out_of_fold(_stage_features(spark, sf_dir), "doc_id", "quality"), "quality")
    return found.withColumns({c: F.round(c, 9) for c, kind in found.dtypes if kind == "double"})


#: Folds of groups (table h: grp, n0, n1) by seed; the folds of what is left over come one after another.
_STRATIFIED = """seeds AS (SELECT unnest([42, 43, 44, 45, 46]) AS seed),
    ranked AS (SELECT seed, grp, n0, n1, count(*) OVER (PARTITION BY seed, n0, n1) AS m, row_number() OVER (PARTITION BY seed, n0, n1 ORDER BY md5(seed || ':' || coalesce(grp::VARCHAR, '')), grp::VARCHAR NULLS FIRST) AS r FROM h, seeds),
    items AS (SELECT n0, n1, j, row_number() OVER (ORDER BY n0 + n1 DESC, n1 DESC, j) AS i FROM (SELECT n0, n1, count(*) % 5 AS m FROM h GROUP BY ALL), unnest(range(1, m + 1)) AS t(j)),
    whole AS (SELECT sum(n0)::HUGEINT AS w0, sum(n1)::HUGEINT AS w1 FROM items),
    dealt(i, n0, n1, j, fold, l0, l1) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], [0, 0, 0, 0, 0]::BIGINT[]
      UNION ALL SELECT i, n0, n1, j, f, list_transform(l0, lambda x, p: x + CASE WHEN p = f THEN n0 ELSE 0 END), list_transform(l1, lambda x, p: x + CASE WHEN p = f THEN n1 ELSE 0 END)
      FROM (SELECT x.i, x.n0, x.n1, x.j, l0, l1, list_sort(list_transform(range(1, 6), lambda f: {'c': l0[f] * x.n0 * w1 * w1 + l1[f] * x.n1 * w0 * w0, 'n': l0[f] + l1[f], 'f': f}))[1].f AS f FROM dealt d JOIN items x ON x.i = d.i + 1, whole)),
    placed AS (SELECT seed, grp, (CASE WHEN r <= m - m % 5 THEN (r - 1) % 5 + 1 ELSE d.fold END)::INT AS fold FROM ranked k LEFT JOIN dealt d ON d.n0 = k.n0 AND d.n1 = k.n1 AND d.j = r - (m - m % 5) AND d.i > 0)"""


@query(
    f"""WITH RECURSIVE h AS (SELECT source AS grp, count(*) FILTER (WHERE quality = 0) AS n0, count(*) FILTER (WHERE quality = 1) AS n1 FROM documents JOIN labels USING (doc_id) GROUP BY source), {_STRATIFIED}
    SELECT seed, grp AS source, fold FROM placed"""
)
def stratified_folds(spark, sf_dir):
    """Whole sources in five folds that even out both classes, for five seeds."""
    d = A.labelled(spark, sf_dir).filter("quality IS NOT NULL")
    return crossfit.stratified_group_folds(d, "source", "quality", 5, [42, 43, 44, 45, 46])


@query(
    """WITH v AS (SELECT vec_id, vec_id % 13 AS g, (label < 5)::INT AS y, embedding::DOUBLE[] AS v FROM embeddings), r AS (SELECT g, avg(y) AS rate, count(*) AS total FROM v GROUP BY g),
    f AS (SELECT g, ((row_number() OVER (ORDER BY rate DESC, total DESC, g DESC) - 1) % 5 + 1)::INT AS fold FROM r), l AS (SELECT vec_id, y, fold, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM v JOIN f USING (g)),
    m AS (SELECT t AS fold, k, avg(x) FILTER (WHERE y = 1) AS p, avg(x) FILTER (WHERE y = 0) AS n FROM l, unnest(range(1, 6)) AS u(t) WHERE fold <> t GROUP BY 1, 2),
    d AS (SELECT fold, vec_id, y, sqrt(sum((x - p) * (x - p))) AS dp, sqrt(sum((x - n) * (x - n))) AS dn FROM l JOIN m USING (fold, k) GROUP BY 1, 2, 3), s AS (SELECT fold, y, dn / (dp + dn + 1e-6) >= 0.5 AS q FROM d),
    c AS (SELECT fold, count(*) AS n, count(*) FILTER (WHERE y = 0 AND NOT q) AS tn, count(*) FILTER (WHERE y = 0 AND q) AS fp, count(*) FILTER (WHERE y = 1 AND NOT q) AS fn, count(*) FILTER (WHERE y = 1 AND q) AS tp FROM s GROUP BY fold)
    SELECT fold, n, tn, fp, fn, tp, (tp + tn) / n::DOUBLE AS accuracy, round(avg((tp + tn) / n::DOUBLE) OVER (), 9) AS accuracy_mean, round(stddev_pop((tp + tn) / n::DOUBLE) OVER (), 9) AS accuracy_std FROM c"""
)
def cross_validation(spark, sf_dir):
    """The centroid classifier trained and evaluated fold by fold."""
    v = A.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 13).alias("g"), (F.col("label") < 5).cast("int").alias("y"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    judged = ml.cross_validated(v, "g", "y", 5, lambda train, test: ml.centroid_scores(train, test, "y", "v").withColumn("score", F.col("p")))
    found = ml.fold_metrics(judged, "y")
    return found.crossJoin(F.broadcast(ml.macro(found, "accuracy"))).withColumns({c: F.round(c, 9) for c in ("accuracy_mean", "accuracy_std")}).select(
        "fold", "n", "tn", "fp", "fn", "tp", "accuracy", "accuracy_mean", "accuracy_std"
    )


#: Vectors, every third with a near copy under another id.
_VECTORS_SQL = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings
      UNION ALL SELECT vec_id + 1000000, list_transform(embedding::DOUBLE[], lambda x, i: x + 0.01 * ((i * 7 + vec_id) % 5 - 2)) FROM embeddings WHERE vec_id % 3 = 0)"""


def _vectors(spark, sf_dir):
    e = A.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    copy = F.transform("v", lambda x, i: x + 0.01 * (((i + 1) * 7 + F.col("vec_id")) % 5 - 2))
    return e.select(F.col("vec_id").alias("id"), "v").unionByName(e.filter("vec_id % 3 = 0").select((F.col("vec_id") + 1000000).alias("id"), copy.alias("v")))


@query(
    f"""WITH {_VECTORS_SQL}, u AS (SELECT min(id) AS id, v FROM v GROUP BY v), p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS cosine FROM u a JOIN u b ON a.id < b.id)
    SELECT a, b, round(cosine, 9) AS cosine FROM p WHERE cosine >= 0.95"""
)
def cosine_pairs(spark, sf_dir):
    return dedup.cosine_pairs(_vectors(spark, sf_dir), "id", "v", 0.95).withColumn("cosine", F.round("cosine", 9))


@query(
    f"""WITH {_VECTORS_SQL}, u AS (SELECT min(id) AS id, v FROM v GROUP BY v), p AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.95)
    SELECT id FROM v WHERE id NOT IN (SELECT b FROM p)"""
)
def near_dup_leaders(spark, sf_dir):
    """The vectors that a greedy pass keeps; here no near copy has a near copy, so each with a smaller partner goes."""
    v = _vectors(spark, sf_dir)
    return dedup.leaders(v.select("id"), "id", dedup.cosine_pairs(v, "id", "v", 0.95))


@query(
    f"""WITH {A.GRAPHS_SQL}, r AS (SELECT g.graph_id, count(e.edge_no) FILTER (WHERE invalid_at > created_at) AS live, coalesce(bool_or(invalid_at > created_at AND source_type = 'UNTRUSTED_INPUT' AND NOT (fits AND guarded_target = target_var)), false) AS open, any_value(is_complete) AS ok
      FROM g LEFT JOIN f e ON e.graph_id = g.graph_id GROUP BY g.graph_id) SELECT graph_id, CASE WHEN ok AND live > 0 AND NOT open THEN 0.05 ELSE 1.0 END::DOUBLE AS risk FROM r"""
)
def graph_reachability(spark, sf_dir):
    g, n, e = A.graphs(spark, sf_dir)
    return graph.reachability(g, n, e)


@query(
    f"""WITH {A.GRAPHS_SQL}, a AS (SELECT graph_id, count(*) AS sinks, count(*) FILTER (WHERE source_type <> 'UNKNOWN_ORIGIN') AS tracked, min(CASE WHEN source_type = 'UNTRUSTED_INPUT' AND NOT (fits AND guarded_target = target_var) THEN edge_no END) AS o FROM f GROUP BY graph_id),
    j AS (SELECT g.*, a.sinks, a.tracked, a.o, x.fits FROM g LEFT JOIN a ON a.graph_id = g.graph_id LEFT JOIN (SELECT DISTINCT graph_id, edge_no, fits FROM f) x ON x.graph_id = g.graph_id AND x.edge_no = a.o)
    SELECT graph_id, CASE WHEN NOT is_complete AND sinks IS NULL THEN 'B_UNSUPPORTED_SYNTAX' WHEN logic_error THEN 'B_LOGIC_ERROR' WHEN strict_fail OR NOT anchor_match THEN 'B_ANCHOR_UNMATCHED' WHEN sinks > 0 AND tracked = 0 THEN 'B_SOURCE_MISSING' WHEN sinks IS NULL THEN 'B_SINK_MISSING'
      WHEN o IS NOT NULL THEN CASE WHEN fits THEN 'B_SANITIZER_TARGET_MISMATCH' ELSE 'B_SANITIZER_MISMATCH' END ELSE 'B_LOGIC_ERROR' END AS bucket FROM j"""
)
def graph_failure_bucket(spark, sf_dir):
    g, n, e = A.graphs(spark, sf_dir)
    return graph.failure_buckets(g, n, e).select("graph_id", "bucket")


@query(
    f"""WITH {A.GRAPHS_SQL}, r AS (SELECT g.graph_id, any_value(is_complete) AS ok, count(f.edge_no) AS edges, count(f.edge_no) FILTER (WHERE invalid_at > created_at) AS live,
        coalesce(bool_or(invalid_at > created_at AND source_type = 'UNTRUSTED_INPUT' AND NOT (fits AND guarded_target = target_var)), false) AS open,
        arg_min(CASE WHEN sanitizer_type IS NULL THEN 'missing_sanitizer' ELSE 'wrong_sanitizer' END, edge_no) FILTER (WHERE source_type = 'UNTRUSTED_INPUT' AND (sanitizer_type IS NULL OR NOT (fits AND guarded_target = target_var))) AS kind
      FROM g LEFT JOIN f ON f.graph_id = g.graph_id GROUP BY g.graph_id),
    b AS (SELECT CASE WHEN NOT ok THEN 'unsupported_syntax' WHEN edges = 0 THEN 'missing_source' WHEN live > 0 AND NOT open THEN 'guarded_or_safe' ELSE coalesce(kind, 'graph_high_risk') END AS bucket FROM r),
    s AS (SELECT bucket, CASE WHEN bucket = 'guarded_or_safe' THEN 'proven_safe' WHEN bucket IN ('missing_sanitizer', 'wrong_sanitizer', 'graph_high_risk') THEN 'proven_unsafe' ELSE 'unsupported_or_unproven' END AS proof_state FROM b)
    SELECT bucket, proof_state, CASE WHEN proof_state = 'proven_unsafe' THEN 0.95 ELSE 0.0 END::DOUBLE AS acceptance, count(*) AS n FROM s GROUP BY ALL"""
)
def graph_proof_states(spark, sf_dir):
    g, n, e = A.graphs(spark, sf_dir)
    return graph.extraction_buckets(g, n, e).groupBy("bucket", "proof_state", "acceptance").agg(F.count("*").alias("n"))


_RISK = f"""WITH {A.GRAPHS_SQL}, r AS (SELECT g.graph_id, count(e.edge_no) AS edges, count(e.edge_no) FILTER (WHERE invalid_at > created_at) AS live, any_value(is_complete) AS ok,
      coalesce(bool_or(invalid_at > created_at AND source_type = 'UNTRUSTED_INPUT' AND NOT (fits AND guarded_target = target_var)), false) AS open FROM g LEFT JOIN f e ON e.graph_id = g.graph_id GROUP BY g.graph_id),
    o AS (SELECT graph_id, ok AS complete, ok AND edges > 0 AS has_signatures, CASE WHEN NOT ok THEN 0.0 WHEN edges = 0 OR (live > 0 AND NOT open) THEN 0.05 ELSE 0.95 END::DOUBLE AS probability FROM r)"""


@query(f"{_RISK} SELECT * FROM o")
def extractor_outcomes(spark, sf_dir):
    """Completeness, signatures and acceptance probability of every extracted graph."""
    return graph.sample_outcomes(*A.graphs(spark, sf_dir))


_SEEDED = f"""WITH RECURSIVE {A.GRAPHS_SQL}, r AS (SELECT g.graph_id, any_value(is_complete) AS ok, count(f.edge_no) AS edges, count(f.edge_no) FILTER (WHERE invalid_at > created_at) AS live,
        coalesce(bool_or(invalid_at > created_at AND source_type = 'UNTRUSTED_INPUT' AND NOT (fits AND guarded_target = target_var)), false) AS open,
        arg_min(CASE WHEN sanitizer_type IS NULL THEN 'missing_sanitizer' ELSE 'wrong_sanitizer' END, edge_no) FILTER (WHERE source_type = 'UNTRUSTED_INPUT' AND (sanitizer_type IS NULL OR NOT (fits AND guarded_target = target_var))) AS kind
      FROM g LEFT JOIN f ON f.graph_id = g.graph_id GROUP BY g.graph_id),
    b AS (SELECT graph_id, CASE WHEN NOT ok THEN 'unsupported_syntax' WHEN edges = 0 THEN 'missing_source' WHEN live > 0 AND NOT open THEN 'guarded_or_safe' ELSE coalesce(kind, 'graph_high_risk') END AS bucket FROM r),
    y AS (SELECT o_custkey AS grp, bucket, (o_totalprice > 150000)::INT AS y FROM b JOIN orders ON o_orderkey = graph_id),
    h AS (SELECT grp, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1 FROM y GROUP BY grp), {_STRATIFIED},
    x AS (SELECT seed, fold, bucket, y FROM y JOIN placed USING (grp)), own AS (SELECT seed, fold, bucket, sum(y) AS p, count(*) AS n FROM x GROUP BY ALL),
    rate AS (SELECT seed, fold, bucket, (sum(p) OVER (PARTITION BY seed, bucket) - p + 1)::DOUBLE / (sum(n) OVER (PARTITION BY seed, bucket) - n + 2)::DOUBLE AS score FROM own),
    s AS (SELECT seed, fold, y, score FROM x JOIN rate USING (seed, fold, bucket)),"""


@query(
    f"""{_SEEDED} q AS (SELECT seed, y, rank() OVER (PARTITION BY seed ORDER BY score) + (count(*) OVER (PARTITION BY seed, score) - 1) / 2.0 AS r FROM s),
    a AS (SELECT seed, count(*) AS n, (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS roc_auc FROM q GROUP BY seed),
    k AS (SELECT seed, score, sum(y) AS p, count(*) AS k FROM s GROUP BY seed, score), c AS (SELECT seed, p, sum(p) OVER w AS tp, sum(k) OVER w AS al FROM k WINDOW w AS (PARTITION BY seed ORDER BY score DESC)),
    t AS (SELECT seed, sum(p * tp / al) / sum(p) AS average_precision FROM c GROUP BY seed),
    acc AS (SELECT seed, fold, avg((y = (score >= 0.5)::INT)::INT) AS v FROM s GROUP BY ALL), dev AS (SELECT seed, stddev_pop(v) AS accuracy_std FROM acc GROUP BY seed),
    l AS (SELECT n, unnest(['roc_auc', 'average_precision', 'accuracy_std']) AS metric, unnest([round(roc_auc, 9)::DOUBLE, round(average_precision, 9)::DOUBLE, round(accuracy_std, 9)::DOUBLE]) AS v FROM a JOIN t USING (seed) JOIN dev USING (seed))
    SELECT metric, any_value(n) AS n, count(*) AS seeds, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std, round(quantile_cont(v, 0.5), 9) AS median, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high FROM l GROUP BY metric"""
)
def seeded_graph_report(spark, sf_dir):
    """Mean, deviation, median and percentile interval, over five seeds of stratified customer folds, of the acceptance rates of graph buckets as the other folds have them."""
    orders = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("graph_id"), F.col("o_custkey").alias("grp"), (F.col("o_totalprice") > 150000).cast("int").alias("y"))
    rows = written(graph.extraction_buckets(*A.graphs(spark, sf_dir)).select("graph_id", "bucket").join(orders, "graph_id"), "graph-buckets")
    found = ml.seeded_report(rows, "grp", "y", "bucket", 5, [42, 43, 44, 45, 46])
    names = ("roc_auc", "average_precision", "accuracy_std")
    long = found.select("n", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.round(m, 9).alias("value")) for m in names))).alias("r")).select("n", "r.*")
    means = long.groupBy("metric").agg(F.first("n").alias("n"), F.count("*").alias("seeds"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    both = means.join(stats.percentile_interval(long, "value", "metric"), "metric")
    return both.withColumns({c: F.round(c, 9) for c in ("mean", "std", "median", "low", "high")})
