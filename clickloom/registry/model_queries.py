"""Queries over vectors, retrieval, ranking, training data and offline quality."""

from __future__ import annotations

import dataclasses
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions import scalars as S
from clickloom.functions import vectors as V
from clickloom.operators import catalogue as C
from clickloom.operators import item_index as X
from clickloom.operators import factor_search as FS
from clickloom.operators import knn as K
from clickloom.operators import ranking as R
from clickloom.operators import sessions as E
from clickloom.plans import recommend as REC
from clickloom.registry.batch_queries import DAY, r6
from clickloom.session import cut, new_path, shared_dir
from clickloom.sources import datasets as D
from clickloom.sources import tables as T

Q = {}

# Weights of the linear scorer that stands in for the trees where results must be repeatable.
WEIGHTS = {
    "session_length": 0.01,
    "session_age_seconds": 0.00001,
    "n_recent_views": 0.02,
    "candidate_in_recent_views": -1.5,
    "candidate_avg_rating": 0.8,
    "candidate_price": -0.0004,
    "candidate_review_count": 0.03,
    "time_of_day": 0.1,
    "device_mobile": 0.05,
}


def query(fn):
    Q[fn.__name__] = fn
    return fn


def session_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of all customers with the session features as of the request."""
    req = T.requests(spark, d)
    at = E.state_at(req, T.events(spark, d), DAY, T.CART_EVENT)
    return cut(req.join(at.drop("user_id", "request_ts"), "request_id"))


def serving_tables(spark: SparkSession, d: str, exact: bool = True) -> REC.Tables:
    items, vectors = T.items(spark, d), T.item_embeddings(spark, d)
    # only items with both a vector and catalogue data are searched, so none takes a place in vain
    known = vectors.join(items.select("item_id"), "item_id", "left_semi")
    return REC.Tables(
        items=items,
        vectors=vectors,
        factors=T.user_factors(spark, d),
        history=C.history(T.interactions(spark, d)),
        index=K.pivot_index(known) if exact else None,
        total_dim=T.TOTAL_DIM,
    )


def stored_index(spark: SparkSession, d: str, users: DataFrame | None = None) -> X.StoredIndex:
    """The stored index of the items that have catalogue data; built when it is not there, then loaded.

    Its path names the folder of the tables, so one application builds it once for all queries.
    """
    items, vectors = T.items(spark, d), T.item_embeddings(spark, d)
    path = f"{shared_dir(spark).rstrip('/')}/item-index/{spark.sparkContext.applicationId}/{hashlib.md5(d.encode()).hexdigest()}"
    if X.manifest(spark, path) is None:
        if users is None:
            users = T.user_factors(spark, d).select(V.project_user("features", T.TOTAL_DIM).alias("vec"))
        X.create(spark, path, items.join(vectors, "item_id", "left"), queries=users)
    return X.load(spark, path)


def _changed(spark, d) -> X.StoredIndex:
    """An index of its own after one upsert: replaced, deleted, new and vectorless items, some of them twice."""
    path = new_path(spark, "upserted")
    items = T.items(spark, d).join(T.item_embeddings(spark, d), "item_id").select("item_id", "title", "price", "embedding")
    X.create(spark, path, items, k=10)
    kind, turned = F.col("item_id").cast("long") % 10, F.transform("embedding", lambda x: -x)
    none = F.lit(None).cast("array<float>")
    at = [F.lit(False).alias("deleted"), F.lit(2).alias("at")]
    moved = items.where(kind == 1).select("item_id", "title", F.lit(1.0).alias("price"), turned.alias("embedding"), *at)
    stale = items.where(kind == 1).select("item_id", "title", F.lit(0.0).alias("price"), "embedding", F.lit(True), F.lit(1))
    gone = items.where(kind == 2).select("item_id", "title", "price", none, F.lit(True), F.lit(2))
    bare = items.where(kind == 3).select("item_id", "title", "price", none, F.lit(False), F.lit(2))
    new = items.where(kind == 4).select(F.concat(F.lit("n"), "item_id"), "title", "price", "embedding", F.lit(False), F.lit(2))
    X.upsert(spark, path, moved.union(stale).union(gone).union(bare).union(new), latest="at")
    return X.load(spark, path)


@query
def item_index_upsert(spark, d):
    """Latest state of all items after one upsert, with the counts that the upsert observed."""
    index = _changed(spark, d)
    m = index.manifest
    return index.items.select(
        "item_id", "title", "price", r6(F.col("vec")[0]).alias("x"), r6(F.col("vec")[63]).alias("y"),
        *[F.lit(m[c]).cast("long").alias(c) for c in ("upserted", "deleted", "missing")],
    )


@query
def item_index_search_delta(spark, d):
    """Every vector before and after the upsert as a query: the items that a search for its own vector finds first."""
    index = _changed(spark, d)
    items = T.item_embeddings(spark, d).join(T.items(spark, d).select("item_id"), "item_id")
    turned = items.where(F.col("item_id").cast("long") % 10 == 1).select("item_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    asked = items.select(F.concat(F.lit("was:"), "item_id").alias("query_id"), F.col("embedding").alias("vec")).unionByName(
        turned.select(F.concat(F.lit("now:"), "item_id").alias("query_id"), F.col("embedding").alias("vec"))
    )
    hits = K.search(asked, index, 3, exact=False)
    return hits.where(F.col("score") > 0.999999).select("query_id", "item_id", "rank")


@query
def ivf_recall(spark, d):
    """Whether the stored index finds 95 % of the exact top 100 of all users with its tuned number of probes."""
    users = T.user_factors(spark, d).select("user_id", V.project_user("features", T.TOTAL_DIM).alias("vec"))
    index = stored_index(spark, d)
    exact = K.search(users, K.pivot_index(T.item_embeddings(spark, d).join(T.items(spark, d).select("item_id"), "item_id")), 100, id_col="user_id")
    found = K.search(users, index, 100, id_col="user_id", exact=False)
    return K.recall(found, exact).select("queries", (F.col("recall") >= 0.95).alias("reached"))


@query
def recommend_stored(spark, d):
    """Recommendations with the stored index: requests and full lists per source."""
    tables = dataclasses.replace(serving_tables(spark, d, exact=False), index=stored_index(spark, d))
    requests = session_requests(spark, d)
    top = cut(REC.recommend(requests, tables, R.linear_scorer(WEIGHTS)))
    answers = REC.respond(requests, top).join(requests.select("request_id", "n_recommendations"), "request_id")
    return answers.groupBy("source").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.size("recommendations") == F.col("n_recommendations")).alias("full_lists")
    )


@query
def item_index_build(spark, d):
    """Write the index twice (the second call finds it and does nothing) and read it back."""
    vectors = T.item_embeddings(spark, d)
    index = K.kmeans_index(vectors)
    rows = C.index_rows(T.items(spark, d), vectors).join(index.rows.select("item_id", "cluster_id"), "item_id")
    path = new_path(spark, "item-index")
    for _ in range(2):
        D.write_index(spark, rows, path)
    back = spark.read.parquet(path)
    return back.select(
        "item_id", "title", "category", "price", r6("avg_rating").alias("avg_rating"), "review_count",
        F.size("embedding").alias("dims"), r6(V.norm("embedding")).alias("norm"),
    )


@query
def item_index_stats(spark, d):
    items, vectors = T.items(spark, d), T.item_embeddings(spark, d)
    have = vectors.filter(~V.is_zero("embedding")).select("item_id", F.lit(True).alias("ok"))
    return items.join(have, "item_id", "left").agg(
        F.count("ok").alias("indexed"), F.count_if(F.col("ok").isNull()).alias("without_vector")
    )


@query
def retrieve_popular(spark, d):
    return C.popular(T.items(spark, d), 50).withColumn("avg_rating", r6("avg_rating"))


@query
def retrieve_knn(spark, d):
    """Exact top 100 items of every user with a factor vector."""
    users = T.user_factors(spark, d).select("user_id", V.project_user("features", T.TOTAL_DIM).alias("vec"))
    hits = K.search(users, K.pivot_index(T.item_embeddings(spark, d)), 100, id_col="user_id")
    return hits.select(F.col("query_id").alias("user_id"), "item_id", "score", "rank")


@query
def retrieve_by_session(spark, d):
    """Exact top 100 items of every user's mean view vector."""
    views = E.recent_views(E.view_runs(T.events(spark, d), DAY))
    vectors = T.item_embeddings(spark, d)
    means = REC.mean_vectors(views, vectors, "user_id")
    hits = K.search(means, K.pivot_index(vectors), 100, id_col="user_id")
    return hits.select(F.col("query_id").alias("user_id"), "item_id", "score", "rank")


@query
def retrieve_cascade(spark, d):
    t = serving_tables(spark, d)
    found = REC.candidates(session_requests(spark, d), t.factors, t.vectors, t.items, t.index, t.total_dim, exact=True)
    return found.select("request_id", "source", "item_id", F.col("retrieval_rank").alias("rank"), F.col("retrieval_score").alias("score"))


@query
def ranker_features(spark, d):
    rows = REC.features(session_requests(spark, d), serving_tables(spark, d), exact=True)
    return rows.select("request_id", "item_id", *[r6(F.col(c).cast("double")).alias(c) for c in R.FEATURES])


def _top(spark, d):
    requests = session_requests(spark, d)
    return requests, REC.recommend(requests, serving_tables(spark, d), R.linear_scorer(WEIGHTS), exact=True)


@query
def recommend_batch(spark, d):
    _, top = _top(spark, d)
    return top.select(
        "request_id", "user_id", "rank", "item_id", "title", "category", "price",
        r6("avg_rating").alias("avg_rating"), r6("score").alias("score"), "source",
    )


@query
def recommend_response(spark, d):
    requests, top = _top(spark, d)
    out = REC.respond(requests, top)
    return out.select(
        "request_id", "user_id", "status", F.size("recommendations").alias("n"),
        F.array_join(F.transform("recommendations", lambda x: x["item_id"]), ",").alias("item_ids"),
        r6("diversity").alias("diversity"), "model_version",
    )


@query
def diversity_score(spark, d):
    """Mean diversity of the responses per retrieval source."""
    requests, top = _top(spark, d)
    out = REC.respond(requests, top)
    return out.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(
        F.count(F.lit(1)).alias("responses"), r6(F.avg("diversity")).alias("diversity")
    )


@query
def retrieve_knn_ivf(spark, d):
    """Approximate top 100 per user from the stored index."""
    users = T.user_factors(spark, d).select("user_id", V.project_user("features", T.TOTAL_DIM).alias("vec"))
    return K.search(users, stored_index(spark, d, users), 100, id_col="user_id", exact=False)


@query
def retrieve_knn_lsh(spark, d):
    """Approximate top 100 per user from hyperplane buckets."""
    users = T.user_factors(spark, d).select("user_id", V.project_user("features", T.TOTAL_DIM).alias("vec"))
    index = K.plane_index(T.item_embeddings(spark, d))
    return K.search(users, index, 100, id_col="user_id", n_probe=6, exact=False)


@query
def ann_recall(spark, d):
    """Recall at 10 of both approximate indexes against the exact search."""
    users = T.user_factors(spark, d).select("user_id", V.project_user("features", T.TOTAL_DIM).alias("vec"))
    vectors = T.item_embeddings(spark, d)
    exact = cut(K.search(users, K.pivot_index(vectors), 10, id_col="user_id"))
    out = None
    for name, index, probes in (("ivf", K.kmeans_index(vectors), 8), ("lsh", K.plane_index(vectors), 6)):
        found = K.search(users, index, 10, id_col="user_id", n_probe=probes, exact=False)
        one = K.recall(found, exact).withColumn("index", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("index", "queries", r6("recall").alias("recall"))


# ------------------------------------------------------------------ samples, training data, quality


@query
def val_user_sample(spark, d):
    from clickloom.operators import sampling

    return sampling.sample_share(T.interactions(spark, d), "user_id", 0.1)


@query
def training_user_sample(spark, d):
    from clickloom.operators import sampling

    return sampling.sample_count(T.interactions(spark, d), "user_id", 500)


@query
def weighted_user_sample(spark, d):
    from clickloom.operators import sampling

    w = T.interactions(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return sampling.weighted_sample(w, "user_id", "n", 100)


@query
def stratified_split(spark, d):
    from clickloom.operators import sampling

    return sampling.stratified_split(T.scored_labels(spark, d), "row_id", "label").select("row_id", "label", "is_validation")


def _user_candidates(spark, d):
    """Exact top 100 items of all users with a factor vector."""
    users = T.user_factors(spark, d).select("user_id", V.project_user("features", T.TOTAL_DIM).alias("vec"))
    hits = K.search(users, K.pivot_index(T.item_embeddings(spark, d)), 100, id_col="user_id")
    return hits.select(F.col("query_id").alias("user_id"), "item_id", "rank")


def _pairs(spark, d):
    from clickloom.plans import training as TR

    pairs = TR.training_pairs(T.interactions(spark, d), T.items(spark, d), cut(_user_candidates(spark, d)))
    return pairs


@query
def training_pairs(spark, d):
    return _pairs(spark, d).select("user_id", "item_id", "label")


@query
def training_pairs_stats(spark, d):
    return _pairs(spark, d).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("label") == 1).alias("positives"),
        F.count_if(F.col("label") == 0).alias("negatives"),
    )


def _features(spark, d):
    from clickloom.plans import training as TR

    return TR.training_features(cut(_pairs(spark, d)), T.interactions(spark, d), T.items(spark, d))


@query
def training_features(spark, d):
    return _features(spark, d).select("user_id", "item_id", "label", *[r6(F.col(c).cast("double")).alias(c) for c in R.FEATURES])


@query
def precision_recall_at_k(spark, d):
    """Quality of the vector retrieval on a tenth of its users."""
    from clickloom.operators import quality, sampling

    recs = cut(_user_candidates(spark, d))
    users = sampling.sample_share(recs, "user_id", 0.1)
    out = quality.precision_recall(recs, T.interactions(spark, d), users)
    return out.select("users", r6("precision_at_k").alias("precision_at_k"), r6("recall_at_k").alias("recall_at_k"))


@query
def auc(spark, d):
    from clickloom.operators import quality

    return quality.roc_auc(T.scored_labels(spark, d)).withColumn("auc", r6("auc"))


# ------------------------------------------------------------------ text


@query
def tfidf(spark, d):
    from clickloom.operators import textvec as TV

    return TV.tfidf(T.documents(spark, d), "doc_id", "text").withColumn("weight", r6("weight"))


@query
def text_svd(spark, d):
    from clickloom.operators import textvec as TV

    out = TV.text_vectors(T.documents(spark, d), "doc_id", "text", dim=32)
    return out.select("doc", F.size("vec").alias("dims"), r6(V.norm("vec")).alias("norm"))


def _title_queries(spark, d, typo: bool):
    titles = T.read(spark, d, "part").select(F.col("p_name").alias("title")).distinct()
    # The typo swaps the letters "in" and turns "a" into "e", so words move by one or two edits.
    text = F.translate(F.regexp_replace("title", "in", "ni"), "a", "e") if typo else F.col("title")
    return titles.select(F.col("title").alias("query_id"), text.alias("text"))


@query
def search_text(spark, d):
    from clickloom.operators import textvec as TV

    out = TV.search_titles(_title_queries(spark, d, False), T.items(spark, d))
    return out.select("query_id", "item_id", r6("score").alias("score"), "rank")


@query
def search_fuzzy(spark, d):
    from clickloom.operators import textvec as TV

    out = TV.search_titles(_title_queries(spark, d, True), T.items(spark, d), fuzzy=True)
    return out.select("query_id", "item_id", r6("score").alias("score"), "rank")


# ------------------------------------------------------------------ iterative models

# of the training job of `_trained`; the other queries train at full size
ALS_SETTINGS = {"factors": 16, "iterations": 5}
TREE_SETTINGS = {"trees": 10, "depth": 4, "step": 0.1}


def _factor_model(spark, d):
    from clickloom.operators import factors as A

    return A.train(C.confidence_cells(T.interactions(spark, d)))


@query
def als_factors(spark, d):
    m = _factor_model(spark, d)
    users = m.user_factors().select(F.lit("user").alias("side"), F.col("user_id").alias("id"), F.size("features").alias("dims"))
    return users.unionByName(m.item_factors().select(F.lit("item").alias("side"), F.col("item_id").alias("id"), F.size("features").alias("dims")))


@query
def als_recommend(spark, d):
    m = _factor_model(spark, d)
    return FS.top(m.user_factors(), m.index(new_path(spark, "factor-index")), 10)


@query
def als_recommend_unseen(spark, d):
    return _factor_model(spark, d).recommend_unseen(10, T.interactions(spark, d))


@query
def als_recommend_recall(spark, d):
    """How many users the indexed lists cover, and whether they find 95 % of the exact ones, on all users."""
    m = _factor_model(spark, d)
    index = m.index(new_path(spark, "factor-index"))
    as_hits = lambda df: df.withColumnRenamed("user_id", "query_id")
    exact = FS.top(m.user_factors(), index, 10, n_probe=len(index.sizes))
    found = K.recall(as_hits(FS.top(m.user_factors(), index, 10)), as_hits(exact))
    return found.select(F.col("queries").alias("users"), (F.col("recall") >= 0.95).alias("recall_reached"))


@query
def als_unseen_check(spark, d):
    """Per user the length of the unseen list, its first and last rank, and how many of its items the user has seen (none)."""
    seen = T.interactions(spark, d)
    recs = _factor_model(spark, d).recommend_unseen(10, seen)
    own = seen.select("user_id", "item_id").distinct().withColumn("own", F.lit(1))
    return recs.join(own, ["user_id", "item_id"], "left").groupBy("user_id").agg(
        F.count_distinct("item_id").alias("n"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"), F.count("own").alias("seen")
    )


@query
def als_roundtrip(spark, d):
    """Users whose recommendations survive a save and load unchanged."""
    from clickloom.operators import factors as A

    m = _factor_model(spark, d)
    path = new_path(spark, "als")
    m.save(path)
    a, b = m.recommend(10), A.FactorModel.load(spark, path).recommend(10)
    same = a.join(b.select("user_id", "item_id", "rank"), ["user_id", "item_id", "rank"], "left_semi")
    return same.groupBy("user_id").agg(F.count(F.lit(1)).alias("same"))


def _embeddings(spark, d):
    from clickloom.operators import textvec as TV

    return TV.item_embeddings(T.items(spark, d), _factor_model(spark, d).item_factors())


@query
def item_embeddings(spark, d):
    path = new_path(spark, "embeddings")
    _embeddings(spark, d).write.parquet(path)
    return spark.read.parquet(path).select("item_id", F.size("embedding").alias("dims"), "has_cf")


@query
def item_embedding_stats(spark, d):
    return _embeddings(spark, d).agg(F.count(F.lit(1)).alias("embeddings"), F.count_if(~F.col("has_cf")).alias("without_cf"))


def _ranker(spark, d):
    from clickloom.operators import sampling

    rows = cut(_features(spark, d).withColumn("row_id", F.concat_ws("|", "user_id", "item_id")))
    split = cut(sampling.stratified_split(rows, "row_id", "label"))
    return split, R.train_ranker(split)


@query
def ranker_scores(spark, d):
    """Probabilities of all training rows, from the reloaded model."""
    from pyspark.ml import PipelineModel

    split, model = _ranker(spark, d)
    path = new_path(spark, "ranker")
    model.write().save(path)
    return R.tree_scorer(PipelineModel.load(path))(split).select("row_id", "label", "is_validation", "score")


@query
def ranker_importance(spark, d):
    _, model = _ranker(spark, d)
    return R.importance(model, spark)


def _trained(spark, d) -> str:
    """Where the training job has written its models and log; one application trains once for all queries."""
    from clickloom.plans import training as TR

    done = f"{shared_dir(spark).rstrip('/')}/trained/{spark.sparkContext.applicationId}/{hashlib.md5(d.encode()).hexdigest()}"
    if not D.exists(spark, done):
        path = new_path(spark, "trained")
        TR.train_all(spark, T.interactions(spark, d), T.items(spark, d), path, f"{path}/log", "run-1", als=ALS_SETTINGS, trees=TREE_SETTINGS)
        spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").parquet(done)
    return spark.read.parquet(done).first().path


@query
def run_metrics(spark, d):
    """The log of the whole training job: metrics and parameters."""
    return spark.read.parquet(f"{_trained(spark, d)}/log").select("run_id", "stage", "kind", "name", "value", "text")


@query
def recommend_trained(spark, d):
    """Requests answered with what the training job has written: factors, embeddings, stored index and trees.

    Per source the requests, the full lists, and the faults: items of the user's own history, scores that are no
    probability or rise along a list, ranks with gaps.
    """
    from clickloom.plans import training as TR

    tables, trees = TR.load_trained(spark, _trained(spark, d), T.interactions(spark, d), T.items(spark, d))
    requests = session_requests(spark, d)
    top = cut(REC.recommend(requests, tables, trees))
    answers = REC.respond(requests, top).join(requests.select("request_id", "n_recommendations"), "request_id")
    scores = F.col("recommendations.score")
    odd = F.exists(scores, lambda x: ~x.between(0.0, 1.0)) | (scores != F.reverse(F.array_sort(scores)))
    gaps = F.col("recommendations.rank") != F.transform(F.sequence(F.lit(1), F.greatest(F.size(scores), F.lit(1))), lambda x: x.cast("int"))
    seen = top.join(tables.history, ["user_id", "item_id"], "left_semi").groupBy("request_id").agg(F.count(F.lit(1)).alias("seen"))
    return answers.join(seen, "request_id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.size(scores) == F.col("n_recommendations")).alias("full_lists"),
        F.coalesce(F.sum("seen"), F.lit(0)).alias("seen_items"),
        F.count_if(odd).alias("odd_scores"),
        F.count_if(gaps).alias("odd_ranks"),
    )
