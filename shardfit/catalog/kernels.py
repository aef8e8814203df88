"""SQL that solves fits of many columns by their rows: inner products in lists, iterations as recursion.

A problem is a (fold, block, lambda) with w = Z'c. ``whole`` holds the inner products of the rows
of every Z_k, ``own`` those of the raw columns alone; ``mats`` has them per fold as lists without
the fold's rows; ``points`` is the solution: ``fold, block, lambda, row_id, c``.
"""

ALL_ROWS = "folds as (select row_id, 1 as fold from labelled), sides as (select 0 as fold)"
SIDES = "sides as (select distinct fold from folds)"

# from designs without gaps
OF_DESIGNS = """
labelled as (select distinct row_id, y from long),
whole as materialized (select a.block, a.row_id as a, b.row_id as b, sum(a.v*b.v) as v from z a join z b
  on a.block=b.block and a.i=b.i group by all)"""

# from entries and shared features
OF_ENTRIES = """
labelled as (select distinct row_id, y from docs),
owned as materialized (select l.*, block from long l join blocks b on l.col=b.col),
own as materialized (select a.block, a.row_id as a, b.row_id as b, sum(a.x*b.x) as v from owned a
  join owned b on a.col=b.col group by all),
whole as materialized (select block, a, b, sum(v) as v from (from own union all
  select a.block, a.row_id as a, b.row_id as b, sum(a.r*b.r) as v from shared a
  join shared b on a.block=b.block and a.slot=b.slot group by all) group by all)"""

MATS = """
kept as materialized (select s.fold, l.row_id, y from labelled l join folds f on l.row_id=f.row_id
  join sides s on s.fold<>f.fold),
cells as materialized (select a.fold, k.block, a.row_id as a, b.row_id as b, a.y from kept a join kept b on a.fold=b.fold,
  (select distinct block from blocks) k),
mats as materialized (select fold, block, list(line order by a) as rows, list(y order by a) as y, list(a order by a) as ids,
    count(*)::double as n, max(list_sum(list_transform(line, lambda e: abs(e)))) as top
  from (select c.fold, c.block, c.a, any_value(c.y) as y, list(coalesce(w.v, 0.0) order by c.b) as line
    from cells c left join whole w on w.block=c.block and w.a=c.a and w.b=c.b group by c.fold, c.block, c.a)
  group by fold, block)"""

ZEROS = "list_transform(y, lambda e: 0.0::double)"


def grid(lambdas) -> str:
    return "grid as (select * from (values " + ",".join(f"({v}::double)" for v in lambdas) + ") t(lambda))"


def _points(table: str, c: str, steps: int) -> str:
    return f"""
points as (select fold, block, lambda, unnest(ids) as row_id, unnest({c}) as c from (
  select t.*, m.ids, m.y, m.n from {table} t join mats m on t.fold=m.fold and t.block=m.block where it={steps}))"""


def ridge(lambdas, steps: int = 150) -> list[str]:
    """Conjugate gradients for (K + n lambda/2) c = y."""
    return [grid(lambdas), f"""
cg as (select fold, block, lambda, 0 as it, {ZEROS} as x, y as r, y as p, list_dot_product(y, y) as rr from mats, grid
  union all select fold, block, lambda, it+1, list_transform(x, lambda e, i: e + a*p[i]), r2,
    list_transform(r2, lambda e, i: e + case when a=0 then 0.0 else list_dot_product(r2, r2)/rr end*p[i]),
    list_dot_product(r2, r2)
  from (select *, list_transform(r, lambda e, i: e - a*ap[i]) as r2 from (
    select *, case when rr<1e-26 then 0.0 else rr/list_dot_product(p, ap) end as a from (
      select g.*, list_transform(m.rows, lambda row, i: list_dot_product(row, p) + 0.5*n*lambda*p[i]) as ap
      from cg g join mats m on g.fold=m.fold and g.block=m.block where it<{steps}))))""", _points("cg", "x", steps)]


def logistic(lambdas, steps: int = 400) -> list[str]:
    """Accelerated gradient of the logistic objective, in the metric of w."""
    return [grid(lambdas), f"""
fast as (select fold, block, lambda, 0 as it, {ZEROS} as x, {ZEROS} as v, lambda+0.25*top/n as curve from mats, grid
  union all select fold, block, lambda, it+1, x2, list_transform(x2, lambda e, i: e
    + (1-sqrt(lambda/curve))/(1+sqrt(lambda/curve))*(e - x[i])), curve
  from (select *, list_transform(v, lambda e, i: e - (lambda*e - y[i]/(1+exp(y[i]*f[i]))/n)/curve) as x2
    from (select g.*, m.y, m.n, list_transform(m.rows, lambda row: list_dot_product(row, v)) as f
      from fast g join mats m on g.fold=m.fold and g.block=m.block where it<{steps})))""", _points("fast", "x", steps)]


def hinge(lambdas, steps: int = 3000) -> list[str]:
    """Accelerated projected ascent of the dual a in [0, 1], begun anew where it turns back; c = y a/(n lambda)."""
    return [grid(lambdas), f"""
up as (select fold, block, lambda, 0 as it, {ZEROS} as a, {ZEROS} as v, 1.0::double as t, n*n*lambda/top as step from mats, grid
  union all select fold, block, lambda, it+1, a2,
    case when back then a2 else list_transform(a2, lambda e, i: e + (t-1)/t2*(e - a[i])) end,
    case when back then 1.0 else t2 end, step
  from (select *, (1+sqrt(1+4*t*t))/2 as t2, list_sum(list_transform(a2, lambda e, i: (v[i]-e)*(e-a[i])))>0 as back
    from (select *, list_transform(v, lambda e, i: least(greatest(e + step*(1 - y[i]*f[i])/n, 0.0), 1.0)) as a2
      from (select g.*, m.y, m.n, list_transform(m.rows, lambda row: list_dot_product(row, ya)/(m.n*lambda)) as f
        from (select u.*, list_transform(v, lambda e, i: e*y[i]) as ya
          from up u join (select fold as pf, block as pb, y from mats) on fold=pf and block=pb where it<{steps}) g
        join mats m on g.fold=m.fold and g.block=m.block))))""",
            _points("up", "list_transform(a, lambda e, i: e*y[i]/(n*lambda))", steps)]


# coefficients of the raw columns; all weights' squares and average losses at the solution
COEF = """
coef as (select fold, l.col, p.block, lambda, sum(x*c) as beta from points p join long l on p.row_id=l.row_id
  join blocks b on b.col=l.col and b.block=p.block group by all)"""


def objective(loss: str) -> str:
    """Average loss on the training rows plus (lambda/2) |w|^2, by problem."""
    return f"""
fitted as (select p.fold, p.block, p.lambda, k.row_id, any_value(k.y) as y, sum(coalesce(w.v, 0.0)*p.c) as pred,
    any_value(o.c) as c from points p join kept k on k.fold=p.fold
  join points o on o.fold=p.fold and o.block=p.block and o.lambda=p.lambda and o.row_id=k.row_id
  left join whole w on w.block=p.block and w.a=k.row_id and w.b=p.row_id group by p.fold, p.block, p.lambda, k.row_id),
objective as (select fold, block, lambda, avg({loss}) + 0.5*lambda*sum(c*pred) as objective from fitted
  group by fold, block, lambda)"""


# predictions of held-out rows: by the joint model, and by every block's own
JOINT = """
scored as (select f.fold, lambda, f.row_id, any_value(l.y) as y, sum(coalesce(o.v, 0.0)*c) as pred
  from points p join folds f on f.fold=p.fold join labelled l on l.row_id=f.row_id
  left join own o on o.block=p.block and o.a=f.row_id and o.b=p.row_id group by f.fold, lambda, f.row_id)"""
ALONE = """
scored as (select f.fold, p.block, lambda, f.row_id, any_value(l.y) as y, sum(coalesce(w.v, 0.0)*c) as pred
  from points p join folds f on f.fold=p.fold join labelled l on l.row_id=f.row_id
  left join whole w on w.block=p.block and w.a=f.row_id and w.b=p.row_id group by f.fold, p.block, lambda, f.row_id)"""
