"""Queries over the test tables, one or more per operator."""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardfit.catalog.fixtures import (
    document_rows, embedding_classes, embedding_rows, event_rows, fixed_beta, lineitem_part_rows,
    lineitem_rows, r6,
)
from shardfit.catalog.many_columns import MANY_COLUMNS
from shardfit.catalog.stored import STORED
from shardfit.functions.hashing import hash_word
from shardfit.functions.losses import hinge_loss, logistic_loss, sigmoid, squared_loss
from shardfit.operators import layout as L
from shardfit.operators import metrics as M
from shardfit.operators import projection as P
from shardfit.operators.design import block_design
from shardfit.operators.gram import gram, gram_rows
from shardfit.operators.ridge import assemble_coefficients, own_coefficients
from shardfit.operators.rows import (
    as_rows, feature_count, sparse_rows, to_dense, to_flat_array, to_long, to_sparse,
)
from shardfit.operators.scaling import center_scale, column_range, column_stats, scale_long
from shardfit.plans.crossval import (
    cv_summary, fit_local_lambda, global_cv, lambda_grid, local_cv, select_lambda,
)
from shardfit.plans.evaluate import evaluate
from shardfit.plans.model import (
    fit_block, fit_model, fit_path, fit_weights, joined_design, model_layout,
)
from shardfit.sources import text

LAMBDAS = [0.1, 1.0, 4.4]
EMB_P, LI_P = 64, 8


def wide(rows: DataFrame, p: int, digits: int = 6) -> DataFrame:
    """Features as columns x0, x1, ..."""
    return rows.select(
        "row_id", r6(F.col("y")).alias("y"),
        *[r6(F.get("features", F.lit(c)), digits).alias(f"x{c}") for c in range(p)],
    )


def checksum(long: DataFrame) -> DataFrame:
    """Per row: label, number of entries and a position-weighted sum."""
    return long.groupBy("row_id").agg(
        F.first("y").alias("y"), F.count("*").alias("n"),
        r6(F.sum((F.col("col") + 1) * F.col("x"))).alias("s"),
    )


# sources -------------------------------------------------------------------

def libsvm_roundtrip(spark, d):
    rows = lineitem_rows(spark, d)
    tokens = F.transform("features", lambda x, i: F.concat_ws(":", (i + 1).cast("string"), x.cast("string")))
    lines = rows.select(
        "row_id", F.concat_ws(" ", F.col("y").cast("string"), F.array_join(tokens, " ")).alias("value")
    )
    return checksum(to_long(text.parse_libsvm(lines)))


def spaces_roundtrip(spark, d):
    rows = lineitem_rows(spark, d)
    values = F.array_join(F.col("features").cast("array<string>"), "  ")
    lines = rows.select("row_id", F.concat_ws(" ", F.col("y").cast("string"), values).alias("value"))
    return wide(text.parse_spaces(lines), LI_P)


def comma_roundtrip(spark, d):
    rows = lineitem_rows(spark, d)
    values = F.array_join(F.col("features").cast("array<string>"), " ")
    lines = rows.select("row_id", F.concat_ws(",", F.col("y").cast("string"), values).alias("value"))
    return wide(text.parse_comma(lines), LI_P)


def flat_array_roundtrip(spark, d):
    return wide(as_rows(to_flat_array(lineitem_rows(spark, d))), LI_P)


def events_one_hot(spark, d):
    return wide(event_rows(spark, d), 8)


# row forms -----------------------------------------------------------------

def sparse_entries(spark, d):
    return checksum(to_long(to_sparse(lineitem_rows(spark, d))))


def sparse_dense_roundtrip(spark, d):
    return wide(to_dense(to_sparse(lineitem_rows(spark, d)), LI_P), LI_P)


def document_entries(spark, d):
    rows = document_rows(spark, d, labelled=False)
    sums = checksum(to_long(rows))  # a document without words has no entry, but its row
    return rows.select("row_id", "y").join(sums.drop("y"), "row_id", "left").select(
        "row_id", "y", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s", F.lit(0.0)).alias("s"))


def document_width(spark, d):
    docs = document_rows(spark, d, labelled=False)
    sums = docs.agg(F.sum(F.size("entries")).cast("bigint").alias("n_entries"))
    return sums.withColumn("n_features", F.lit(feature_count(docs)).cast("bigint"))


def vector_rows(spark, d):
    """Sparse rows from labelled ML vectors, dense and sparse ones."""
    rows = embedding_rows(spark, d)
    vectors = rows.select("row_id", F.col("y").alias("label"), array_to_vector("features").alias("features"))
    return checksum(to_long(sparse_rows(vectors)))


def sparse_vector_rows(spark, d):
    """ML vectors as the assembler stores them, sparse where that is shorter."""
    rows = event_rows(spark, d)
    columns = [F.get("features", F.lit(c)).alias(f"x{c}") for c in range(8)]
    vectors = VectorAssembler(inputCols=[f"x{c}" for c in range(8)], outputCol="features").transform(
        rows.select("row_id", "y", *columns))
    return checksum(to_long(sparse_rows(vectors.select("row_id", "y", "features"))))


def stored_sparse_to_dense(spark, d):
    return wide(as_rows(to_sparse(lineitem_rows(spark, d)), n_features=LI_P), LI_P)


def libsvm_blank_and_comment_lines(spark, d):
    """Comments and blank lines between the records are skipped."""
    rows = lineitem_rows(spark, d)
    tokens = F.transform("features", lambda x, i: F.concat_ws(":", (i + 1).cast("string"), x.cast("string")))
    line = F.concat_ws(" ", F.col("y").cast("string"), F.array_join(tokens, " "))
    lines = rows.select("row_id", F.explode(F.array(F.lit("# a comment"), line, F.lit("  "))).alias("value"))
    return checksum(to_long(text.parse_libsvm(lines)))


# layout --------------------------------------------------------------------

def train_test_split(spark, d):
    train, test = L.split_train_test(lineitem_rows(spark, d).select("row_id", "y"), 0.2, 3)
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )


def folds_hash(spark, d):
    return L.assign_folds(event_rows(spark, d).select("row_id"), 5, 1, "hash")


def folds_rank(spark, d):
    return L.assign_folds(lineitem_rows(spark, d).select("row_id"), 5, 1, "rank")


def fold_held_out(spark, d):
    folded = L.assign_folds(event_rows(spark, d).select("row_id", "y"), 5)
    train, test = L.fold_rows(folded, 2, False), L.fold_rows(folded, 2, True)
    sums = [F.count("*").alias("n"), r6(F.sum("y"), 4).alias("s")]
    return train.agg(*sums).withColumn("part", F.lit("train")).unionByName(
        test.agg(*sums).withColumn("part", F.lit("test"))
    )


def response_positions(spark, d):
    return L.response(lineitem_rows(spark, d))


def transpose_dense(spark, d):
    cols = L.transpose(lineitem_rows(spark, d), LI_P, chunk_rows=1000)
    cells = cols.select("col", "start", F.posexplode("obs").alias("k", "x"))
    return cells.groupBy("col").agg(
        F.count("*").alias("n"),
        r6(F.sum(F.col("x") * ((F.col("start") + F.col("k")) % 97))).alias("s"),
    )


def transpose_sparse(spark, d):
    cols = L.transpose(document_rows(spark, d, labelled=False), chunk_rows=100)
    cells = cols.select("col", F.inline(F.arrays_zip("pos", "obs")))
    return cells.groupBy("col").agg(
        F.count("*").alias("n"), r6(F.sum(F.col("obs") * (F.col("pos") % 97))).alias("s"),
    )


def _block_stats(spark, d, blocks):
    return column_range(to_long(embedding_rows(spark, d)), blocks).select(
        "block", r6(F.col("range")).alias("range")
    )


def blocks_range(spark, d):
    rows = embedding_rows(spark, d)
    return _block_stats(spark, d, L.assign_blocks(spark, feature_count(rows), 4, "range"))


def blocks_random(spark, d):
    rows = embedding_rows(spark, d)
    return _block_stats(spark, d, L.assign_blocks(spark, feature_count(rows), 4, "random"))


def blocks_explicit(spark, d):
    """Columns with a mean below zero form block 0, the others block 1."""
    means = column_stats(to_long(embedding_rows(spark, d)))
    chosen = means.select("col", F.when(F.col("mean") < 0, 0).otherwise(1).alias("block"))
    blocks = L.assign_blocks(spark, EMB_P, 2, "explicit", block_map=chosen)
    return _block_stats(spark, d, blocks)


# scaling -------------------------------------------------------------------

def scale_stats(spark, d):
    return column_stats(to_long(embedding_rows(spark, d))).select(
        "col", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "sd", "lo", "hi")]
    )


def scaled_features(spark, d):
    return wide(center_scale(lineitem_rows(spark, d)), LI_P)


def centered_features(spark, d):
    return wide(center_scale(lineitem_rows(spark, d), features=(True, False)), LI_P, 9)


def scaled_response(spark, d):
    return wide(center_scale(lineitem_rows(spark, d), features=(False, False),
                             response=(True, True)), LI_P)


def scaled_long(spark, d):
    return scale_long(to_long(embedding_rows(spark, d)), EMB_P).select(
        "row_id", "col", r6(F.col("x")).alias("x")
    )


def _scaled_test(spark, d, fit_on):
    train, test = L.split_train_test(event_rows(spark, d), 0.2, 3)
    return wide(center_scale(train, test, fit_on=fit_on)[1], 8)


def scaled_by_train(spark, d):
    return _scaled_test(spark, d, "train")


def scaled_by_own(spark, d):
    return _scaled_test(spark, d, "each")


# projections ---------------------------------------------------------------

def _rp(spark, d, q=8, projection="sparse", blocks_mode="range"):
    rows = embedding_rows(spark, d)
    blocks = L.assign_blocks(spark, feature_count(rows), 4, blocks_mode)
    pi = P.projection_matrix(blocks, q, projection, 1)
    return P.apply_projection(to_long(rows), pi, EMB_P * q)


def _r(rp, *keys):
    return rp.select("row_id", "block", *keys, "proj", r6(F.col("r")).alias("r"))


def sparse_projection(spark, d):
    return _r(_rp(spark, d))


def sdct_projection(spark, d):
    return _r(_rp(spark, d, 8, "SDCT", "random"))


def sum_projections(spark, d):
    return P.sum_projections(_rp(spark, d)).select("row_id", "proj", r6(F.col("r")).alias("r"))


def leave_one_out(spark, d):
    return _r(P.leave_one_out(_rp(spark, d)))


def concat_projections(spark, d):
    return _r(P.concat_projections(_rp(spark, d, 2, "SDCT"), 4), "other_block")


def sparse_document_projection(spark, d):
    """Sparse rows: rows without words in a block still get its zeros and the others' sums."""
    rows = document_rows(spark, d, labelled=False)
    blocks = L.assign_blocks(spark, 1024, 4, "range")
    pi = P.sparse_projection_matrix(blocks, 2, 1)
    rp = P.apply_projection(to_long(rows), pi, 2048, (rows, 4, 2))
    return _r(P.leave_one_out(rp))


def dct_features(spark, d):
    rows = P.dct(embedding_rows(spark, d))
    return to_long(rows).select("row_id", "col", r6(F.col("x")).alias("x"))


def private_noise_sd(spark, d):
    rows = embedding_rows(spark, d)
    ranges = column_range(to_long(rows), L.assign_blocks(spark, EMB_P, 4, "range"))
    return ranges.select("block", r6(P.noise_sd(F.col("range"), 10.0, 0.05)).alias("sigma"))


def private_projection(spark, d):
    rows = embedding_rows(spark, d)
    ranges = column_range(to_long(rows), L.assign_blocks(spark, EMB_P, 4, "range"))
    return _r(P.add_private_noise(_rp(spark, d, 8, "SDCT"), ranges, 10.0, 0.05, 7))


# block designs and fits ----------------------------------------------------

def _layout(rows, k, q, projection="SDCT", mode="add", partitioner="range", **kw):
    return model_layout(rows, k, q, projection, mode, partitioner, 1, **kw)


def block_designs(spark, d):
    rows = embedding_rows(spark, d)
    layout, _ = _layout(rows, 4, 8)
    z = block_design(rows, layout).select("row_id", "block", F.posexplode("z").alias("i", "v"))
    return z.select("row_id", "block", "i", r6(F.col("v")).alias("v"))


def joined_designs(spark, d):
    rows = document_rows(spark, d, labelled=False)
    blocks = L.assign_blocks(spark, 1024, 4, "range")
    design = joined_design(rows, 1024, blocks, 4, 2, "sparse", "concatenate", 1)
    weighted = F.transform("z", lambda v, i: v * (i + 1))
    total = F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v)
    return design.groupBy("row_id", "block").agg(
        F.sum(F.size("z")).alias("n"), r6(F.sum(total), 5).alias("s")
    )


def _gram(g):
    return g.where("i >= 0").select("block", "i", "j", r6(F.col("v")).alias("v"))


def gram_block(spark, d):
    rows = embedding_rows(spark, d)
    layout, _ = _layout(rows, 4, 8)
    return _gram(gram_rows(rows, layout))


def gram_design(spark, d):
    rows = embedding_rows(spark, d)
    layout, _ = _layout(rows, 4, 4, "sparse", "concatenate")
    return _gram(gram(block_design(rows, layout)))


def _coef(c, *keys, digits=6):
    return c.select("col", "block", "lambda", *keys, r6(F.col("beta"), digits).alias("beta"))


def ridge_naive_k64(spark, d):
    return _coef(fit_model(embedding_rows(spark, d), 64, 0, lam=0.1, partitioner="range"))


def ridge_k64_q1(spark, d):
    return _coef(fit_model(embedding_rows(spark, d), 64, 1, lam=0.1, projection="sparse",
                           partitioner="range"))


def fit_model_ridge(spark, d):
    return _coef(fit_model(embedding_rows(spark, d), 4, 8, lam=0.1, partitioner="range"))


def fit_model_random_blocks(spark, d):
    return _coef(fit_model(embedding_rows(spark, d), 4, 8, lam=0.1))


def fit_model_concatenate(spark, d):
    return _coef(fit_model(embedding_rows(spark, d), 4, 4, lam=0.1, projection="sparse",
                           mode="concatenate", partitioner="range"))


def fit_model_private(spark, d):
    return _coef(fit_model(embedding_rows(spark, d), 4, 8, lam=0.1, partitioner="range",
                           private=True, noise_seed=7))


def fit_model_tall(spark, d):
    """Scaled line items: many rows, few columns."""
    rows = center_scale(lineitem_rows(spark, d), response=(True, True))
    return _coef(fit_model(rows, 4, 1, lam=0.1, partitioner="range"))


def fit_model_line_parts(spark, d):
    rows = center_scale(lineitem_part_rows(spark, d), response=(True, True))
    return _coef(fit_model(rows, 2, 2, lam=0.1, partitioner="range"))


def fit_model_documents(spark, d):
    """Sparse rows, solved per block of 16 columns."""
    return _coef(fit_model(document_rows(spark, d), 64, 2, lam=0.5, projection="sparse",
                           partitioner="range", n_features=1024))


def fit_joined_documents(spark, d):
    """The same model by joins, with no matrix on any executor."""
    rows = document_rows(spark, d)
    blocks = L.assign_blocks(spark, 1024, 64, "range")
    design = joined_design(rows, 1024, blocks, 64, 2, "sparse", "add", 1)
    return _coef(own_coefficients(fit_block(design, "squared", 0.5), blocks))


def fit_path_ridge(spark, d):
    rows = embedding_rows(spark, d)
    layout, blocks = _layout(rows, 4, 8)
    return _coef(fit_path(rows, layout, blocks, "squared", LAMBDAS))


def assembled_coefficients(spark, d):
    """Only the even columns are fitted; the others get 0."""
    coef = fit_model(embedding_rows(spark, d), 64, 0, lam=0.1, partitioner="range")
    return assemble_coefficients(coef.where("col % 2 = 0"), EMB_P).select(
        "col", r6(F.col("beta")).alias("beta")
    )


def svm_naive_k64(spark, d):
    return _coef(fit_model(embedding_classes(spark, d), 64, 0, "hinge", 0.001, partitioner="range",
                           stopping_gap=1e-11), digits=4)


def logistic_naive_k64(spark, d):
    return _coef(fit_model(embedding_classes(spark, d), 64, 0, "logistic", 0.01,
                           partitioner="range", stopping_gap=0.0))


def logistic_k64_q1(spark, d):
    """One own column and one shared feature per block."""
    return _coef(fit_model(embedding_classes(spark, d), 64, 1, "logistic", 0.05, "sparse",
                           partitioner="range", stopping_gap=0.0))


def logistic_path_k64(spark, d):
    rows = embedding_classes(spark, d)
    layout, blocks = _layout(rows, 64, 0)
    return _coef(fit_path(rows, layout, blocks, "logistic", LAMBDAS, stopping_gap=0.0))


# predictions, errors, certificates -----------------------------------------

def _fixed_pred(spark, d, rows=None):
    rows = embedding_rows(spark, d) if rows is None else rows
    return M.predict(rows, fixed_beta(spark, EMB_P), EMB_P)


def _class_pred(spark, d):
    return _fixed_pred(spark, d, embedding_classes(spark, d))


def predict(spark, d):
    return _fixed_pred(spark, d).select("row_id", "y", r6(F.col("pred")).alias("pred"))


def predict_documents(spark, d):
    rows = document_rows(spark, d, labelled=False)
    pred = M.predict_long(to_long(rows), fixed_beta(spark, 1024), 1024, rows)
    return pred.select("row_id", "y", r6(F.col("pred")).alias("pred"))


def mse(spark, d):
    return M.mse(_fixed_pred(spark, d)).select(r6(F.col("mse")).alias("mse"))


def standardized_mse(spark, d):
    return M.standardized_mse(_fixed_pred(spark, d)).select(
        r6(F.col("standardized_mse")).alias("standardized_mse"), r6(F.col("mse")).alias("mse")
    )


def classification_error(spark, d):
    return M.classification_error(_class_pred(spark, d)).select(r6(F.col("error")).alias("error"))


def classification_error_logistic(spark, d):
    return M.classification_error(_class_pred(spark, d), logistic=True).select(
        r6(F.col("error")).alias("error")
    )


def row_losses(spark, d):
    y, p = F.col("y"), F.col("pred")
    return _class_pred(spark, d).select(
        "row_id", r6(squared_loss(y, p)).alias("squared"), r6(hinge_loss(y, p)).alias("hinge"),
        r6(logistic_loss(y, p)).alias("logistic"), r6(sigmoid(p)).alias("probability"),
    )


def _per_loss(make):
    out = None
    for loss in ("squared", "hinge", "logistic"):
        df = make(loss).withColumn("loss", F.lit(loss))
        out = df if out is None else out.unionByName(df)
    return out


def average_losses(spark, d):
    pred = _class_pred(spark, d)
    return _per_loss(lambda loss: M.average_loss(pred, loss).select(
        r6(F.col("average_loss")).alias("average_loss")))


def primal_objectives(spark, d):
    pred, beta = _class_pred(spark, d), fixed_beta(spark, EMB_P)
    return _per_loss(lambda loss: M.primal_objective(pred, beta, 0.1, loss).select(
        r6(F.col("primal")).alias("primal")))


def dual_values(spark, d):
    pred = _class_pred(spark, d)
    ridge = M.dual_from_primal(pred, "squared").withColumnRenamed("alpha", "ridge")
    logit = M.dual_from_primal(pred, "logistic").withColumnRenamed("alpha", "logistic")
    return ridge.join(logit, "row_id").select(
        "row_id", r6(F.col("ridge")).alias("ridge"), r6(F.col("logistic")).alias("logistic")
    )


def _alphas(pred, loss):
    if loss == "hinge":
        u = hash_word(1, "alpha", F.col("row_id")) / F.lit(4294967296.0)
        return pred.select("row_id", (F.col("y") * u).alias("alpha"))
    return M.dual_from_primal(pred, loss)


def _alpha(loss):
    """Hinge dual values drawn by row id; the others follow from the predictions."""
    if loss == "hinge":
        return F.col("y") * hash_word(1, "alpha", F.col("row_id")) / F.lit(4294967296.0)
    return None


def dual_to_primal(spark, d):
    """From the dual values of all rows, joined by row id and summed by column."""
    rows = embedding_classes(spark, d)
    alpha = _alphas(_fixed_pred(spark, d, rows), "squared")
    v = M.dual_to_primal(rows, alpha, rows.count(), 0.1)
    return v.select("col", r6(F.col("beta")).alias("beta"))


def dual_sums(spark, d):
    """The same in one pass that predicts, takes dual values and adds up."""
    rows = embedding_classes(spark, d)
    sums = M.dual_sums(rows, fixed_beta(spark, EMB_P), EMB_P, "squared")
    n = sums.where("i = -1").first()["v"]
    return sums.where("i >= 0").select(F.col("i").alias("col"), r6(F.col("v") / (n * 0.1)).alias("beta"))


def dual_objectives(spark, d):
    rows = embedding_classes(spark, d)
    pred, n = _fixed_pred(spark, d, rows), rows.count()

    def one(loss):
        alpha = _alphas(pred, loss)
        v = M.dual_to_primal(rows, alpha, n, 0.1)
        signed = pred.select("row_id", "y").join(alpha, "row_id")
        return M.dual_objective(signed, v, 0.1, loss).select(r6(F.col("dual")).alias("dual"))

    return _per_loss(one)


def duality_gaps(spark, d):
    rows = embedding_classes(spark, d)
    pred, beta = _fixed_pred(spark, d, rows), fixed_beta(spark, EMB_P)
    return _per_loss(lambda loss: M.duality_gap(
        rows, pred, beta, _alphas(pred, loss), 0.1, loss
    ).select(*[r6(F.col(c)).alias(c) for c in ("primal", "dual", "gap")]))


def certificates(spark, d):
    """Primal, dual and gap without a join."""
    rows, beta = embedding_classes(spark, d), fixed_beta(spark, EMB_P)
    return _per_loss(lambda loss: M.certificate(rows, beta, EMB_P, 0.1, loss, _alpha(loss)).select(
        *[r6(F.col(c)).alias(c) for c in ("primal", "dual", "gap")]))


def evaluate_ridge(spark, d):
    """Fit on the train part, score both parts."""
    train, test = L.split_train_test(embedding_rows(spark, d), 0.2, 3)
    coef = fit_model(train, 64, 0, lam=0.1, partitioner="range")
    both = evaluate(train, coef, EMB_P, "squared", "train").unionByName(
        evaluate(test, coef, EMB_P, "squared", "test"))
    return both.select("data", r6(F.col("error")).alias("error"), r6(F.col("mse")).alias("mse"))


# penalty selection ---------------------------------------------------------

def _grid(spark):
    return lambda_grid(spark, 0.5, 2.0, 0.5)


def ridge_cv_path(spark, d):
    cv = global_cv(embedding_rows(spark, d), _grid(spark), 5, n_blocks=64, q=0,
                   partitioner="range")
    return cv.select("fold", "lambda", r6(F.col("error")).alias("error"))


def ridge_cv_summary(spark, d):
    cv = global_cv(embedding_rows(spark, d), _grid(spark), 5, n_blocks=4, q=8,
                   partitioner="range")
    return cv_summary(cv).select("lambda", *[r6(F.col(c)).alias(c) for c in ("mean", "sd", "var")])


def select_lambda_global(spark, d):
    cv = global_cv(embedding_rows(spark, d), _grid(spark), 5, n_blocks=4, q=8,
                   partitioner="range")
    return select_lambda(cv).select("lambda", r6(F.col("mean")).alias("mean"))


def ridge_cv_tall(spark, d):
    rows = center_scale(lineitem_rows(spark, d), response=(True, True))
    cv = global_cv(rows, [0.1, 1.0], 5, n_blocks=4, q=1, partitioner="range")
    return cv.select("fold", "lambda", r6(F.col("error")).alias("error"))


def local_cv_ridge(spark, d):
    rows = embedding_rows(spark, d)
    layout, _ = _layout(rows, 4, 8)
    return local_cv(rows, layout, _grid(spark), 5).select(
        "block", "fold", "lambda", r6(F.col("error")).alias("error")
    )


def local_cv_spread(spark, d):
    rows = embedding_rows(spark, d)
    layout, _ = _layout(rows, 4, 8)
    return cv_summary(local_cv(rows, layout, _grid(spark), 5)).select(
        "block", "lambda", r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("sd")
    )


def select_lambda_local(spark, d):
    rows = embedding_rows(spark, d)
    layout, _ = _layout(rows, 4, 8)
    return select_lambda(local_cv(rows, layout, _grid(spark), 5)).select(
        "block", "lambda", r6(F.col("mean")).alias("mean")
    )


def fit_local_lambdas(spark, d):
    rows = embedding_rows(spark, d)
    layout, blocks = _layout(rows, 4, 8)
    return _coef(fit_local_lambda(rows, layout, blocks, _grid(spark), 5))


def logistic_cv(spark, d):
    cv = global_cv(embedding_classes(spark, d), [0.01, 0.1], 5, loss="logistic", n_blocks=64, q=0,
                   partitioner="range", fit={"stopping_gap": 0.0})
    return cv.select("fold", "lambda", r6(F.col("error")).alias("error"))


def svm_cv_k64(spark, d):
    cv = global_cv(embedding_classes(spark, d), [0.001, 0.01], 5, loss="hinge", n_blocks=64, q=0,
                   partitioner="range", fit={"stopping_gap": 1e-9})
    return cv.select("fold", "lambda", r6(F.col("error")).alias("error"))


def local_cv_svm_k64(spark, d):
    rows = embedding_classes(spark, d)
    layout, _ = _layout(rows, 64, 0)
    cv = local_cv(rows, layout, [0.001, 0.01], 5, loss="hinge", stopping_gap=1e-9)
    return cv.select("block", "fold", "lambda", r6(F.col("error")).alias("error"))


QUERIES = {
    f.__name__: f
    for f in (
        libsvm_roundtrip, spaces_roundtrip, comma_roundtrip, flat_array_roundtrip, events_one_hot,
        sparse_entries, sparse_dense_roundtrip, document_entries, document_width, vector_rows, sparse_vector_rows,
        stored_sparse_to_dense, libsvm_blank_and_comment_lines, local_cv_spread,
        train_test_split, folds_hash, folds_rank, fold_held_out, response_positions,
        transpose_dense, transpose_sparse, blocks_range, blocks_random, blocks_explicit,
        scale_stats, scaled_features, centered_features, scaled_response, scaled_long,
        scaled_by_train, scaled_by_own,
        sparse_projection, sdct_projection, sum_projections, leave_one_out, concat_projections,
        sparse_document_projection, dct_features, private_noise_sd, private_projection,
        block_designs, joined_designs, gram_block, gram_design, ridge_naive_k64, ridge_k64_q1,
        fit_model_ridge, fit_model_random_blocks, fit_model_concatenate, fit_model_private,
        fit_model_tall, fit_model_line_parts, fit_model_documents, fit_joined_documents,
        fit_path_ridge, assembled_coefficients, svm_naive_k64, logistic_naive_k64,
        logistic_path_k64, logistic_k64_q1,
        predict, predict_documents, mse, standardized_mse, classification_error,
        classification_error_logistic, row_losses, average_losses, primal_objectives, dual_values,
        dual_to_primal, dual_sums, dual_objectives, duality_gaps, certificates, evaluate_ridge,
        ridge_cv_path, ridge_cv_summary, select_lambda_global, ridge_cv_tall, local_cv_ridge,
        select_lambda_local, fit_local_lambdas, logistic_cv, svm_cv_k64, local_cv_svm_k64,
    )
} | MANY_COLUMNS | STORED
