"""The queries again as SQL for DuckDB over the same tables."""

import re

from shardfit.catalog import kernels as K
from shardfit.catalog import parts as S
from shardfit.catalog.parts import query, r6

COEF = f"select col, block, lambda, {r6('beta')} as beta from coef"
WIDE8 = ", ".join(f"{r6(f'features[{c + 1}]')} as x{c}" for c in range(8))
FLAT_LI = query(S.LI, select=f"select row_id, {r6('y')} as y, {WIDE8} from flat")
CHECKSUM = (
    f"select row_id, any_value(y) as y, count(*) as n, {r6('sum((col+1)*x)')} as s "
    "from long where x<>0 group by row_id"
)


def pivot8(digits: int = 6) -> str:
    return ", ".join(
        f"{r6(f'max(case when col={c} then x end)', digits)} as x{c}" for c in range(8))


RANGE = f"select block, {r6('max(w)')} as range from widths join blocks using(col) group by block"
WIDTHS = "widths as (select col, max(x)-min(x) as w from long group by col)"
NAMED_SCALED = "select row_id, {y} as y, " + pivot8() + " from scaled group by row_id, y"
TEST_ROW = S.word("'3'", "'split'", "row_id") + "<858993459"



def full(docs: str) -> str:
    """Long form of the documents with its zeros, for dense elimination."""
    return docs.replace("\nlong as (select c.row_id, d.y, c.col, c.x from counts c join docs d on c.row_id=d.row_id)", """
long as (select d.row_id, d.y, k::int as col, coalesce(c.x,0.0) as x from docs d cross join range(1024) t(k)
  left join counts c on c.row_id=d.row_id and c.col=k)""")


# a coefficient per column from a formula
FIXED = """
beta as (select c::int as col, (c%7-3)/10.0::double as beta from range({p}) t(c)),
pred as (select row_id, any_value(y) as y, sum(x*beta) as pred from long l join beta b on l.col=b.col
  group by row_id)"""
FIXED64 = FIXED.format(p=64)
MARGIN = "case when y*pred>0 then 0.0 else 1.0 end"
LOGISTIC = "greatest(-y*pred,0.0)+ln(1+exp(-abs(y*pred)))"
LOSS_SQL = {
    "squared": "(y-pred)*(y-pred)", "hinge": "greatest(1-y*pred,0.0)", "logistic": LOGISTIC,
}
ALPHA = {
    "squared": "2*(y-pred)",
    "hinge": "y*(" + S.word("'1'", "'alpha'", "row_id") + "/4294967296.0::double)",
    "logistic": "y/(1+exp(y*pred))",
}
CONJUGATE = {
    "squared": "0.25*alpha*alpha-y*alpha", "hinge": "-y*alpha",
    "logistic": "y*alpha*ln(y*alpha)+(1-y*alpha)*ln(1-y*alpha)",
}
PENALTY = "0.5*0.1*(select sum(beta*beta) from beta)"


def per_loss(template: str, ctes: list[str]) -> str:
    selects = [template.replace("{loss}", name) for name in LOSS_SQL]
    return query(*ctes, select=" union all ".join(selects))


def duals() -> list[str]:
    out = []
    for name in LOSS_SQL:
        out.append(f"a_{name} as (select row_id, y, pred, {ALPHA[name]} as alpha from pred)")
        out.append(
            f"v_{name} as (select l.col, sum(x*alpha)/((select count(*) from pred)*0.1) as v "
            f"from long l join a_{name} a on l.row_id=a.row_id group by l.col)"
        )
        out.append(
            f"d_{name} as (select -0.5*0.1*(select sum(v*v) from v_{name})-avg({CONJUGATE[name]}) "
            f"as dual from a_{name})"
        )
        out.append(f"p_{name} as (select avg({LOSS_SQL[name]})+{PENALTY} as primal from pred)")
    return out


def ridge(source: str, blocks: str, lambdas, shared: list[str] | None = None,
          folds: str = S.NO_FOLDS, systems: str = S.ALL_ROWS, data: str = "") -> list[str]:
    ctes = [source, *([data] if data else []), blocks]
    ctes += [*shared, S.SHARED_Z] if shared else [S.RAW_Z]
    return [*ctes, folds, S.GRAM, systems, S.ridge_solve(lambdas)]


SDCT8 = [S.sdct_pi(8), S.RP, S.LOO]
B4 = S.range_blocks(64, 4)
B64 = S.range_blocks(64, 64)
GRID = (0.5, 1.0, 1.5, 2.0)
FOLDS5 = S.hash_folds(5)
SCALED_LI = [
    S.LI.replace("long as", "raw as"),
    """
stats as (select col, avg(x) as mean, stddev_samp(x) as sd from raw group by col),
ystats as (select avg(y) as ym, stddev_samp(y) as ys from flat),
long as (select row_id, (y-ym)/ys as y, r.col, case when sd>0 then (x-mean)/sd else 0.0 end as x
  from raw r join stats s on r.col=s.col, ystats)""",
]
SCALED_PARTS = [S.LI_PART.replace("long as", "raw as"), SCALED_LI[1]]
NOISY = [
    S.sdct_pi(8), S.RP.replace("rp as", "clean as"), WIDTHS,
    "sigma as (select block, max(w)/10.0*sqrt(2*(ln(1/(2*0.05::double))+10.0)) as sd "
    "from widths join blocks using(col) group by block)",
    "rp as (select row_id, c.block, proj, r+sd*"
    + S.normal("'7'", "'noise'", "row_id", "c.block", "proj")
    + " as r from clean c join sigma s on c.block=s.block)",
]
# mean squared error of every left-out model on its fold
FOLD_ERROR = """
scored as (select f.fold, lambda, f.row_id, any_value(l.y) as y, sum(x*beta) as pred
  from long l join folds f on l.row_id=f.row_id join coef c on c.fold=f.fold and c.col=l.col
  group by f.fold, lambda, f.row_id),
cv as (select fold, lambda, avg({error}) as error from scored group by fold, lambda)"""
SQUARED_CV = FOLD_ERROR.format(error="(y-pred)*(y-pred)")
LOCAL_CV = """
scored as (select w.block, w.fold, lambda, z.row_id, any_value(y) as y, sum(v*beta) as pred
  from zf z join weights w on z.fold=w.fold and z.block=w.block and z.i=w.i
  group by w.block, w.fold, lambda, z.row_id),
cv as (select block, fold, lambda, sum((y-pred)*(y-pred))/(var_pop(y)*count(*)) as error
  from scored group by block, fold, lambda)"""
CHOSEN = """
chosen as (select block, arg_min(lambda, m) as lambda, min(m) as mean from (
  select block, lambda, avg(error) as m from cv group by block, lambda) group by block)"""


def newton(lambdas, folds: bool = False, steps: int = 25) -> list[str]:
    """Newton steps of the one-column logistic fits, per fold, column and lambda."""
    grid = ",".join(f"({v}::double)" for v in lambdas)
    left_out = "join folds f on f.row_id=l.row_id" if folds else ""
    fold = "s.fold" if folds else "0"
    keep = "join sides s on s.fold<>f.fold" if folds else ""
    return [
        "grid as (select * from (values " + grid + ") t(lambda))",
        *(["sides as (select distinct fold from folds)"] if folds else []),
        f"obs as materialized (select {fold} as fold, l.col, l.x, l.y from long l {left_out} {keep})",
        f"""
steps as (select distinct fold, col, lambda, 0 as it, 0.0::double as w from obs, grid union all
  select s.fold, s.col, s.lambda, s.it+1, any_value(w) - (lambda*any_value(w)
    - avg(x*y/(1+exp(y*x*w)))) / (lambda + avg(x*x*exp(y*x*w)/(1+exp(y*x*w))^2))
  from steps s join obs o on s.fold=o.fold and s.col=o.col where s.it<{steps}
  group by s.fold, s.col, s.lambda, s.it),
coef as (select fold, s.col, block, lambda, w as beta from steps s join blocks b on s.col=b.col
  where it={steps})""",
    ]


def hinge_1d(lambdas, folds: bool = False) -> list[str]:
    """One-column hinge fits: the slope rises in w, so the root is the largest min(kink, root of piece)."""
    grid = ",".join(f"({v}::double)" for v in lambdas)
    if folds:
        sx = """
sides as (select distinct fold from folds),
sx as (select s.fold, col, x*y as s, count(*) over (partition by s.fold, col) as n from long l
  join folds f on f.row_id=l.row_id join sides s on s.fold<>f.fold)"""
    else:
        sx = "sx as (select 0 as fold, col, x*y as s, count(*) over (partition by col) as n from long)"
    return [f"grid as (select * from (values {grid}) t(lambda))", sx, """
turn as (select fold, col, case when sum(s)>=0 then 1.0 else -1.0 end as g from sx group by all),
side as (select sx.fold, sx.col, s*g as s, g, n from sx join turn t on sx.fold=t.fold and sx.col=t.col),
fixed as (select fold, col, any_value(g) as g, any_value(n) as n,
  coalesce(sum(s) filter (where s<=0),0.0) as base from side group by fold, col),
kinks as (select s.fold, s.col, f.g, 1/s as kink, (base+sum(s) over (partition by s.fold, s.col
  order by s rows between unbounded preceding and current row))/f.n as pull
  from side s join fixed f on s.fold=f.fold and s.col=f.col where s>0),
coef as (select fold, k.col, block, lambda, any_value(g)*max(least(kink,pull/lambda)) as beta
  from kinks k join blocks b on k.col=b.col, grid group by fold, k.col, block, lambda)"""]


TWO_COLUMNS = """
total as (select row_id, sum(r) as r from rp group by row_id),
two as materialized (select l.row_id, l.y, l.col, l.x, t.r-coalesce(p.r,0.0) as s from long l
  join total t on l.row_id=t.row_id left join rp p on p.row_id=l.row_id and p.block=l.col)"""
NEWTON_2D = """
steps as (select distinct col, 0 as it, 0.0::double as a, 0.0::double as b from two union all
  select col, it+1, a-(h22*g1-h12*g2)/(h11*h22-h12*h12), b-(h11*g2-h12*g1)/(h11*h22-h12*h12)
  from (select w.col, w.it, any_value(a) as a, any_value(b) as b,
    0.05*any_value(a)-avg(x*y/(1+exp(y*(a*x+b*s)))) as g1,
    0.05*any_value(b)-avg(s*y/(1+exp(y*(a*x+b*s)))) as g2,
    0.05+avg(x*x*exp(y*(a*x+b*s))/(1+exp(y*(a*x+b*s)))^2) as h11,
    avg(x*s*exp(y*(a*x+b*s))/(1+exp(y*(a*x+b*s)))^2) as h12,
    0.05+avg(s*s*exp(y*(a*x+b*s))/(1+exp(y*(a*x+b*s)))^2) as h22
    from steps w join two o on w.col=o.col where w.it<25 group by w.col, w.it))"""


def positions(source: str) -> str:
    return f"place as (select row_id, row_number() over (order by row_id)-1 as pos from {source})"


def build() -> dict[str, str]:
    q = {}
    q["libsvm_roundtrip"] = query(S.LI, select=CHECKSUM)
    q["spaces_roundtrip"] = FLAT_LI
    q["comma_roundtrip"] = FLAT_LI
    q["flat_array_roundtrip"] = FLAT_LI
    q["sparse_entries"] = query(S.LI, select=CHECKSUM)
    q["sparse_dense_roundtrip"] = FLAT_LI
    q["vector_rows"] = query(S.EMB, select=CHECKSUM)
    q["sparse_vector_rows"] = query(
        S.EVENTS, select=CHECKSUM)
    q["stored_sparse_to_dense"] = FLAT_LI
    q["libsvm_blank_and_comment_lines"] = query(S.LI, select=CHECKSUM)
    q["events_one_hot"] = query(S.EVENTS, select=f"select row_id, {r6('y')} as y, {WIDE8} from flat")
    q["document_entries"] = query(
        S.ALL_DOCS, "sums as (" + CHECKSUM + ")", select="select d.row_id, d.y, coalesce(n,0) as n, "
        "coalesce(s,0.0) as s from docs d left join sums t on d.row_id=t.row_id")
    q["document_width"] = query(
        S.ALL_DOCS, select="select (max(col)+1)::bigint as n_features, count(*)::bigint as n_entries from long"
    )

    q["train_test_split"] = query(
        S.LI, select=f"select row_id, y, case when {TEST_ROW} then 'test' else 'train' end as part from flat"
    )
    q["folds_hash"] = query(
        S.EVENTS, select="select row_id, (" + S.word("'1'", "'fold'", "row_id") + "%5+1)::int as fold from flat"
    )
    q["folds_rank"] = query(
        S.LI, select="select row_id, ((row_number() over (order by " + S.word("'1'", "'fold'", "row_id")
        + ", row_id)-1)%5+1)::int as fold from flat"
    )
    fold = "(" + S.word("'1'", "'fold'", "row_id") + "%5+1)"
    q["fold_held_out"] = query(
        S.EVENTS, select=f"select count(*) as n, {r6('sum(y)', 4)} as s, case when {fold}=2 then 'test' "
        "else 'train' end as part from flat group by part"
    )
    q["response_positions"] = query(
        S.LI, select="select row_number() over (order by row_id)-1 as pos, y from flat"
    )
    q["transpose_dense"] = query(
        S.LI, positions("flat"),
        select=f"select col, count(*) as n, {r6('sum(x*(pos%97))')} as s from long join place "
        "using(row_id) group by col",
    )
    q["transpose_sparse"] = query(
        S.ALL_DOCS, positions("docs"),
        select=f"select col, count(*) as n, {r6('sum(x*(pos%97))')} as s from long join place "
        "using(row_id) group by col",
    )
    q["blocks_range"] = query(S.EMB, B4, WIDTHS, select=RANGE)
    q["blocks_random"] = query(S.EMB, S.random_blocks(64, 4), WIDTHS, select=RANGE)
    q["blocks_explicit"] = query(
        S.EMB, "blocks as (select col, case when avg(x)<0 then 0 else 1 end as block from long group by col)",
        WIDTHS, select=RANGE,
    )

    q["scale_stats"] = query(
        S.EMB, select=f"select col, count(*) as n, {r6('avg(x)')} as mean, {r6('stddev_samp(x)')} as sd, "
        f"{r6('min(x)')} as lo, {r6('max(x)')} as hi from long group by col"
    )
    q["scaled_features"] = query(S.LI, S.SCALED, select=NAMED_SCALED.format(y=r6("y")))
    q["centered_features"] = query(
        S.LI, "scaled as (select row_id, y, col, x-avg(x) over (partition by col) as x from long)",
        select=f"select row_id, {r6('y')} as y, {pivot8(9)} from scaled group by row_id, y",
    )
    q["scaled_response"] = query(
        S.LI, select="select row_id, "
        + r6("(y-avg(y) over ())/stddev_samp(y) over ()") + f" as y, {WIDE8} from flat"
    )
    q["scaled_long"] = query(S.EMB, S.SCALED, select=f"select row_id, col, {r6('x')} as x from scaled")
    own = S.EVENTS.replace("long as", "whole as")
    q["scaled_by_train"] = query(
        own, f"""
stats as (select col, avg(x) as mean, stddev_samp(x) as sd from whole where not ({TEST_ROW}) group by col),
scaled as (select row_id, y, w.col, case when sd>0 then (x-mean)/sd else 0.0 end as x
  from whole w join stats s on w.col=s.col where {TEST_ROW})""",
        select=NAMED_SCALED.format(y=r6("y")),
    )
    q["scaled_by_own"] = query(
        own, f"long as (select * from whole where {TEST_ROW})", S.SCALED,
        select=NAMED_SCALED.format(y=r6("y")),
    )

    rp = f"select row_id, block, proj, {r6('r')} as r from rp"
    loo = f"select row_id, block, slot as proj, {r6('r')} as r from shared"
    q["sparse_projection"] = query(S.EMB, B4, S.sparse_pi(8), S.RP, select=rp)
    q["sdct_projection"] = query(S.EMB, S.random_blocks(64, 4), S.sdct_pi(8), S.RP, select=rp)
    q["sum_projections"] = query(
        S.EMB, B4, S.sparse_pi(8), S.RP,
        select=f"select row_id, proj, {r6('sum(r)')} as r from rp group by row_id, proj",
    )
    q["leave_one_out"] = query(S.EMB, B4, S.sparse_pi(8), S.RP, S.LOO, select=loo)
    q["concat_projections"] = query(
        S.EMB, B4, S.sdct_pi(2), S.RP,
        select=f"select a.row_id, b.block, a.block as other_block, proj, {r6('r')} as r from rp a "
        "join (select distinct block from blocks) b on a.block<>b.block",
    )
    full_rp = S.RP.replace("rp as (", """
slots as (select row_id, block, proj::int as proj from (select distinct row_id from docs),
  (select distinct block from blocks), range(2) t(proj)),
found as (""") + """,
rp as (select s.row_id, s.block, s.proj, coalesce(r,0.0) as r from slots s left join found o
  on s.row_id=o.row_id and s.block=o.block and s.proj=o.proj)"""
    q["sparse_document_projection"] = query(
        S.ALL_DOCS, S.range_blocks(1024, 4), S.sparse_pi(2), full_rp, S.LOO, select=loo
    )
    q["dct_features"] = query(
        S.EMB, select="select row_id, t::int as col, "
        + r6("sum(x*case when t=0 then sqrt(1/64.0::double) else sqrt(2/64.0::double) end"
             "*cos(pi()*(col+0.5::double)*t/64))")
        + " as x from long, range(64) f(t) group by row_id, t"
    )
    q["private_noise_sd"] = query(
        S.EMB, B4, WIDTHS, select="select block, "
        + r6("max(w)/10.0*sqrt(2*(ln(1/(2*0.05::double))+10.0))")
        + " as sigma from widths join blocks using(col) group by block"
    )
    q["private_projection"] = query(S.EMB, B4, *NOISY, select=rp)

    q["block_designs"] = query(
        S.EMB, B4, *SDCT8, S.SHARED_Z, select=f"select row_id, block, i::int as i, {r6('v')} as v from z"
    )
    q["joined_designs"] = query(
        full(S.ALL_DOCS), S.range_blocks(1024, 4), S.sparse_pi(2), S.RP, S.concat(2), S.SHARED_Z,
        select=f"select row_id, block, (max(d)+6)::bigint as n, {r6('sum(v*(i+1))', 5)} as s from ("
        "select z.*, 256 as d from z) group by row_id, block",
    )
    triangle = f"select block, i::int as i, j::int as j, {r6('v')} as v from gram where i<=j"
    q["gram_block"] = query(S.EMB, B4, *SDCT8, S.SHARED_Z, S.NO_FOLDS, S.GRAM, select=triangle)
    q["gram_design"] = query(
        S.EMB, B4, S.sparse_pi(4), S.RP, S.concat(4), S.SHARED_Z, S.NO_FOLDS, S.GRAM, select=triangle
    )

    q["ridge_naive_k64"] = query(
        S.EMB, select="select col, col as block, 0.1::double as lambda, "
        + r6("sum(x*y)/(sum(x*x)+count(*)*0.05::double)") + " as beta from long group by col"
    )
    q["ridge_k64_q1"] = query(
        S.EMB, B64, S.sparse_pi(1), S.RP, TWO_COLUMNS, """
sums as (select col, sum(x*x)+count(*)*0.05::double as a, sum(x*s) as b,
  sum(s*s)+count(*)*0.05::double as c, sum(x*y) as e, sum(s*y) as f from two group by col)""",
        select=f"select col, col as block, 0.1::double as lambda, {r6('(e*c-b*f)/(a*c-b*b)')} as beta from sums",
    )
    q["fit_model_ridge"] = query(*ridge(S.EMB, B4, [0.1], SDCT8), select=COEF)
    q["fit_model_random_blocks"] = query(
        *ridge(S.EMB, S.random_blocks(64, 4), [0.1], SDCT8), select=COEF)
    q["fit_model_concatenate"] = query(
        *ridge(S.EMB, B4, [0.1], [S.sparse_pi(4), S.RP, S.concat(4)]), select=COEF)
    q["fit_model_private"] = query(*ridge(S.EMB, B4, [0.1], [*NOISY, S.LOO]), select=COEF)
    q["fit_model_tall"] = query(
        *ridge(SCALED_LI[0], S.range_blocks(8, 4), [0.1], [S.sdct_pi(1), S.RP, S.LOO],
               data=SCALED_LI[1]), select=COEF)
    q["fit_model_line_parts"] = query(
        *ridge(SCALED_PARTS[0], S.range_blocks(5, 2), [0.1], [S.sdct_pi(2), S.RP, S.LOO],
               data=SCALED_PARTS[1]), select=COEF)
    docs = query(*ridge(full(S.DOCS), S.range_blocks(1024, 64), [0.5],
                        [S.sparse_pi(2), S.RP, S.LOO]), select=COEF)
    q["fit_model_documents"] = docs
    q["fit_joined_documents"] = docs
    q["fit_path_ridge"] = query(*ridge(S.EMB, B4, [0.1, 1.0, 4.4], SDCT8), select=COEF)
    q["assembled_coefficients"] = query(
        S.EMB, select="select col, case when col%2=0 then "
        + r6("sum(x*y)/(sum(x*x)+count(*)*0.05::double)") + " else 0.0 end as beta from long group by col"
    )
    q["svm_naive_k64"] = query(
        S.EMB_CLS, B64, *hinge_1d([0.001]),
        select=f"select col, block, lambda, {r6('beta', 4)} as beta from coef")
    q["logistic_naive_k64"] = query(S.EMB_CLS, B64, *newton([0.01]), select=COEF)
    q["logistic_path_k64"] = query(S.EMB_CLS, B64, *newton([0.1, 1.0, 4.4]), select=COEF)

    q["logistic_k64_q1"] = query(
        S.EMB_CLS, B64, S.sparse_pi(1), S.RP, TWO_COLUMNS, NEWTON_2D,
        select=f"select col, col as block, 0.05::double as lambda, {r6('a')} as beta from steps where it=25")

    q["predict"] = query(S.EMB, FIXED64, select=f"select row_id, y, {r6('pred')} as pred from pred")
    q["predict_documents"] = query(
        S.ALL_DOCS, FIXED.format(p=1024), select=f"select d.row_id, d.y, coalesce({r6('pred')},0.0) as pred "
        "from docs d left join pred p on d.row_id=p.row_id")
    q["mse"] = query(S.EMB, FIXED64, select=f"select {r6('avg((y-pred)*(y-pred))')} as mse from pred")
    q["standardized_mse"] = query(
        S.EMB, FIXED64, select="select "
        + r6("sum((y-pred)*(y-pred))/(var_pop(y)*count(*))") + " as standardized_mse, "
        + r6("avg((y-pred)*(y-pred))") + " as mse from pred")
    q["classification_error"] = query(
        S.EMB_CLS, FIXED64, select=f"select {r6(f'avg({MARGIN})')} as error from pred")
    q["classification_error_logistic"] = query(
        S.EMB_CLS, FIXED64, select="select "
        + r6("avg(0.5*abs(case when 1/(1+exp(-pred))>0.5 then 1.0 else -1.0 end-y))")
        + " as error from pred")
    q["row_losses"] = query(
        S.EMB_CLS, FIXED64, select="select row_id, " + ", ".join(
            f"{r6(sql)} as {name}" for name, sql in LOSS_SQL.items())
        + f", {r6('1/(1+exp(-pred))')} as probability from pred")
    q["average_losses"] = query(S.EMB_CLS, FIXED64, select=" union all ".join(
        f"select {r6(f'avg({sql})')} as average_loss, '{name}' as loss from pred"
        for name, sql in LOSS_SQL.items()))
    q["primal_objectives"] = per_loss(
        f"select {r6('primal')} as primal, '{{loss}}' as loss from p_{{loss}}",
        [S.EMB_CLS, FIXED64, *duals()])
    q["dual_values"] = query(
        S.EMB_CLS, FIXED64, select=f"select row_id, {r6(ALPHA['squared'])} as ridge, "
        f"{r6(ALPHA['logistic'])} as logistic from pred")
    q["dual_to_primal"] = query(
        S.EMB_CLS, FIXED64, *duals(), select=f"select col, {r6('v')} as beta from v_squared")
    q["dual_objectives"] = per_loss(
        f"select {r6('dual')} as dual, '{{loss}}' as loss from d_{{loss}}",
        [S.EMB_CLS, FIXED64, *duals()])
    q["duality_gaps"] = per_loss(
        f"select {r6('primal')} as primal, {r6('dual')} as dual, {r6('primal-dual')} as gap, "
        "'{loss}' as loss from p_{loss}, d_{loss}", [S.EMB_CLS, FIXED64, *duals()])
    q["certificates"], q["dual_sums"] = q["duality_gaps"], q["dual_to_primal"]
    q["evaluate_ridge"] = query(
        S.EMB, "coef as (select col, sum(x*y)/(sum(x*x)+count(*)*0.05::double) as beta from long "
        f"where not ({TEST_ROW}) group by col)",
        f"pred as (select row_id, any_value(y) as y, sum(x*beta) as pred, case when {TEST_ROW} then 'test' "
        "else 'train' end as data from long l join coef c on l.col=c.col group by row_id)",
        select="select data, " + r6("sum((y-pred)*(y-pred))/(var_pop(y)*count(*))") + " as error, "
        + r6("avg((y-pred)*(y-pred))") + " as mse from pred group by data")

    naive = ["sides as (select distinct fold from folds)", """
grid as (select * from (values (0.5::double),(1.0),(1.5),(2.0)) t(lambda)),
coef as (select s.fold, col, lambda, sum(x*y)/(sum(x*x)+count(*)*0.5*lambda) as beta
  from long l join folds f on l.row_id=f.row_id join sides s on s.fold<>f.fold, grid
  group by s.fold, col, lambda)"""]
    q["ridge_cv_path"] = query(
        S.EMB, FOLDS5, *naive, SQUARED_CV, select=f"select fold, lambda, {r6('error')} as error from cv")
    cv = [*ridge(S.EMB, B4, GRID, SDCT8, FOLDS5, S.LEFT_OUT), SQUARED_CV]
    q["ridge_cv_summary"] = query(
        *cv, select=f"select lambda, {r6('avg(error)')} as mean, {r6('stddev_samp(error)')} as sd, "
        f"{r6('var_samp(error)')} as var from cv group by lambda")
    q["select_lambda_global"] = query(
        *cv, select=f"select lambda, {r6('m')} as mean from (select lambda, avg(error) as m from cv "
        "group by lambda) order by m, lambda limit 1")
    q["ridge_cv_tall"] = query(
        *ridge(SCALED_LI[0], S.range_blocks(8, 4), [0.1, 1.0], [S.sdct_pi(1), S.RP, S.LOO],
               FOLDS5, S.LEFT_OUT, data=SCALED_LI[1]), SQUARED_CV,
        select=f"select fold, lambda, {r6('error')} as error from cv")
    local = [*ridge(S.EMB, B4, GRID, SDCT8, FOLDS5, S.LEFT_OUT), LOCAL_CV]
    q["local_cv_ridge"] = query(
        *local, select=f"select block, fold, lambda, {r6('error')} as error from cv")
    q["local_cv_spread"] = query(
        *local, select=f"select block, lambda, {r6('avg(error)')} as mean, {r6('stddev_samp(error)')} as sd "
        "from cv group by block, lambda")
    q["select_lambda_local"] = query(
        *local, CHOSEN, select=f"select block, lambda, {r6('mean')} as mean from chosen")
    again = S.GRAM + "," + S.ALL_ROWS + "," + S.ridge_solve(GRID)
    for name in ("zf", "gram", "zy", "sizes", "tgram", "tzy", "tsizes", "grid", "lines", "systems",
                 "gj", "weights", "coef", "folds"):
        again = re.sub(rf"\b{name}\b", f"all_{name}", again)
    q["fit_local_lambdas"] = query(
        *local, CHOSEN, "all_folds as (select row_id, 0 as fold from folds)", again,
        select=f"select col, c.block, c.lambda, {r6('beta')} as beta from all_coef c join chosen h "
        "on c.block=h.block and c.lambda=h.lambda")
    q["logistic_cv"] = query(
        S.EMB_CLS, B64, FOLDS5, *newton([0.01, 0.1], folds=True),
        FOLD_ERROR.format(error="0.5*abs(case when pred>0 then 1.0 else -1.0 end-y)"),
        select=f"select fold, lambda, {r6('error')} as error from cv")
    hinge = [S.EMB_CLS, B64, FOLDS5, *hinge_1d([0.001, 0.01], folds=True)]
    q["svm_cv_k64"] = query(
        *hinge, FOLD_ERROR.format(error=MARGIN),
        select=f"select fold, lambda, {r6('error')} as error from cv")
    q["local_cv_svm_k64"] = query(
        *hinge, select="select block, c.fold, lambda, " + r6("avg(case when y*x*beta>0 then 0.0 else 1.0 end)")
        + " as error from long l join folds f on l.row_id=f.row_id "
        "join coef c on c.fold=f.fold and c.col=l.col group by block, c.fold, lambda")
    return q | stored(q) | many_columns()


PART = f"case when {TEST_ROW} then 'test' else 'train' end as part"


def stored(q: dict) -> dict[str, str]:
    """What has been written and read again is what it was."""
    out = {}
    spaces = query(S.EVENTS, select=f"select row_id, {r6('y')} as y, {PART}, {WIDE8} from flat")
    out["dataset_of_spaces"] = out["dataset_of_commas"] = spaces
    out["dataset_of_libsvm"] = query(
        S.ALL_DOCS, "sums as (" + CHECKSUM + ")", f"parts as (select row_id, {PART} from docs)",
        select="select d.row_id, d.y, part, 1025::int as width, coalesce(s,0.0) as s from docs d "
        "join parts p on d.row_id=p.row_id left join sums t on d.row_id=t.row_id")
    rows = query(S.LI, select=f"select row_id, y, {PART}, {WIDE8} from flat")
    out["stored_rows"] = out["stored_flat_arrays"] = rows
    out["stored_sparse_rows"] = query(S.ALL_DOCS, select=f"select row_id, {PART}, col, x from long")
    out["response_file"] = q["response_positions"]
    out["feature_count_file"] = query(S.ALL_DOCS, select="select (max(col)+1)::int as n_features from long")
    out["block_map_file"] = query(
        S.EMB, select="select col, (case when avg(x)<0 then 0 else 1 end)::int as block from long group by col")
    out["columns_file"] = q["transpose_dense"]
    out["preprocessed_rows"] = f"select *, 9::int as n from ({q['scaled_by_train']})"
    out["preprocessed_columns"] = query(
        S.EVENTS.replace("long as", "whole as"), f"long as (select * from whole where not ({TEST_ROW}))", S.SCALED,
        select=f"select col, count(*) as n, {r6('avg(x*y)')} as m, 8::int as width from scaled group by col")
    out["fit_columns_ridge"] = q["fit_model_ridge"]
    out["fit_columns_documents"] = q["fit_model_documents"]
    out["run_report"] = f"select *, 64::int as n_coef, 64::int as blocks from ({q['evaluate_ridge']})"
    out["cv_file"] = f"select *, true as converged from ({q['ridge_cv_summary']})"
    return out


def unit(p: int) -> str:
    """Labelled documents as hashed word counts of length one."""
    return S.DOCS.replace("% 1024", f"% {p}").replace(
        "long as (select c.row_id, d.y, c.col, c.x from",
        "long as (select c.row_id, d.y, c.col, c.x/sqrt(sum(c.x*c.x) over (partition by c.row_id)) as x from")


def many_columns() -> dict[str, str]:
    out = {}
    wide = [unit(1 << 15), S.range_blocks(1 << 15, 2), S.sparse_pi(8), S.RP, ENTRIES_LOO.format(q=8), K.OF_ENTRIES,
            K.ALL_ROWS, K.MATS]
    sums = (f"select b.block, lambda, {r6('sum(beta*(col%7+1))', 5)} as s, {r6('sum(beta*beta)', 5)} as squares, "
            "true as converged from coef b group by b.block, lambda")
    out["fit_ridge_wide"] = query(*wide, *K.ridge([0.1]), K.COEF, select=sums)
    out["fit_logistic_wide"] = query(*wide, *K.logistic([0.1]), K.COEF, select=sums)
    value = "select block, lambda, {v} as objective, true as converged from objective"
    out["fit_svm_wide"] = query(*wide, *K.hinge([0.1]), K.objective("greatest(1-y*pred,0.0)"),
                                select=value.format(v=r6("objective", 4)))
    folds3 = S.hash_folds(3).replace("(select distinct row_id from long)", "labelled")
    out["ridge_cv_documents"] = query(
        unit(1 << 16), S.range_blocks(1 << 16, 4), S.sparse_pi(8), S.RP, ENTRIES_LOO.format(q=8), K.OF_ENTRIES, folds3,
        K.SIDES, K.MATS, *K.ridge([0.1, 1.0]), K.JOINT,
        select=f"select fold, lambda, {r6('avg((y-pred)*(y-pred))', 5)} as error, true as converged from scored group by fold, lambda")

    designs = [S.EMB_CLS, B4, *SDCT8, S.SHARED_Z, K.OF_DESIGNS]
    fits = [*designs, K.ALL_ROWS, K.MATS]
    out["fit_svm"] = query(*fits, *K.hinge([0.1]), K.objective("greatest(1-y*pred,0.0)"),
                           select=value.format(v=r6("objective")))
    out["fit_logistic"] = query(*fits, *K.logistic([0.1]), K.COEF, select=COEF).replace(
        "as beta from coef", "as beta, true as converged from coef")
    own = """
own as materialized (select b.block, a.row_id as a, c.row_id as b, sum(a.x*c.x) as v from long a join long c on a.col=c.col
  join blocks b on a.col=b.col group by all)"""
    left_out = [*designs, own, FOLDS5, K.SIDES, K.MATS, *K.hinge([0.1, 1.0], 1000)]
    out["svm_cv"] = query(*left_out, K.JOINT, select=f"select fold, lambda, {r6(f'avg({MARGIN})')} as error, "
                          "true as converged from scored group by fold, lambda")
    out["local_cv_svm"] = query(*left_out, K.ALONE, select=f"select block, fold, lambda, {r6(f'avg({MARGIN})')} as error, "
                                "true as converged from scored group by block, fold, lambda")
    out["fit_path_concatenate"] = query(
        *ridge(S.EMB, B4, [0.1, 1.0, 4.4], [S.sparse_pi(4), S.RP, S.concat(4)]), select=COEF)
    noise = S.normal("'7'", "'noise'", "row_id", "c.block", "proj")
    out["ridge_cv_private"] = query(
        S.EMB, B4, S.sdct_pi(8), S.RP.replace("rp as", "clean as"), FOLDS5, K.SIDES, f"""
sigma as (select fold, block, max(w)/10.0*sqrt(2*(ln(1/(2*0.05::double))+10.0)) as sd from (
  select s.fold, col, max(x)-min(x) as w from long l join folds f on l.row_id=f.row_id join sides s on s.fold<>f.fold
  group by s.fold, col) w join blocks b on w.col=b.col group by fold, block),
noise as materialized (select row_id, c.block, proj, r, {noise} as e from clean c),
rp as (select s.fold, row_id, c.block, proj, r+sd*e as r from noise c join sigma s on c.block=s.block),
shared as (select fold, row_id, block, proj as slot, sum(r) over (partition by fold, row_id, proj)-r as r from rp),
pos as (select col, block, row_number() over (partition by block order by col)-1 as i,
  count(*) over (partition by block) as d from blocks),
labelled as (select distinct row_id, y from long),
z as materialized (select s.fold, l.row_id, y, block, i, x as v from long l join pos p on l.col=p.col
    join folds f on f.row_id=l.row_id join sides s on s.fold<>f.fold
  union all select s.fold, s.row_id, o.y, s.block, w.d+s.slot as i, s.r as v from shared s
  join labelled o on s.row_id=o.row_id join folds f on f.row_id=s.row_id and s.fold<>f.fold
  join (select distinct block, d from pos) w on s.block=w.block),
tgram as materialized (select a.fold, a.block, a.i, b.i as j, sum(a.v*b.v) as v from z a join z b
  on a.fold=b.fold and a.row_id=b.row_id and a.block=b.block group by all),
tzy as materialized (select fold, block, i, sum(v*y) as v from z group by all),
tsizes as (select s.fold, count(*) as n from folds f join sides s on s.fold<>f.fold group by s.fold)""",
        S.ridge_solve([0.5, 1.0]), SQUARED_CV, select=f"select fold, lambda, {r6('error')} as error from cv")
    return out


# shared features of every row and block, also of rows without entries in some block
ENTRIES_LOO = """
slots as (select row_id, block, proj::int as proj from (select distinct row_id from docs),
  (select distinct block from blocks), range({q}) t(proj)),
shared as (select row_id, block, proj as slot, sum(r) over (partition by row_id, proj)-r as r from (
  select s.row_id, s.block, s.proj, coalesce(r, 0.0) as r from slots s left join rp o
  on s.row_id=o.row_id and s.block=o.block and s.proj=o.proj))"""


ORACLE = build()
