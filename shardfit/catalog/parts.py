"""SQL building blocks of the comparison queries, in DuckDB's dialect."""

import re

LINEITEM_ID = (
    "('0x'||substr(md5(concat_ws('|',l_orderkey,l_partkey,l_suppkey,"
    "date_diff('day',date '1995-01-01',l_shipdate::date))),1,15))::bigint"
)


def r6(x: str, digits: int = 6) -> str:
    return f"case when round({x},{digits})=0 then 0.0::double else round({x},{digits})::double end"


def word(*parts: str, index: int = 0) -> str:
    return f"('0x'||substr(md5(concat_ws('|',{','.join(parts)})),{1 + 8 * index},8))::bigint"


def normal(*parts: str) -> str:
    return (
        f"sqrt(-2*ln(({word(*parts)}+1)/4294967297.0::double))"
        f"*cos(2*pi()*{word(*parts, index=1)}/4294967296.0::double)"
    )


# sources in long form: row_id, y, col, x
EMB = """
long as (select vec_id as row_id, label::double as y,
  unnest(range(0, len(embedding)))::int as col, unnest(embedding)::double as x from embeddings)"""
EMB_CLS = EMB.replace("label::double", "case when label>=5 then 1.0::double else -1.0::double end")


def lists(source: str, row_id: str, y: str, features: list[str]) -> str:
    values = ",".join(f"({f})::double" for f in features)
    return f"""
flat as (select {row_id} as row_id, ({y})::double as y, [{values}] as features from {source}),
long as (select row_id, y, unnest(range(0, len(features)))::int as col,
  unnest(features)::double as x from flat)"""


def flags(name: str, values) -> list[str]:
    return [f"case when {name}='{v}' then 1.0 else 0.0 end" for v in values]


LI = lists("lineitem", LINEITEM_ID, "l_extendedprice",
           ["l_quantity", "l_discount", "l_tax", *flags("l_returnflag", "ANR"),
            *flags("l_linestatus", "FO")])
LI_PART = lists("lineitem join part on l_partkey=p_partkey", LINEITEM_ID, "l_extendedprice",
                ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"])
EVENTS = lists("events", "event_id", "value",
               ["hour(ts)", "isodow(ts)-1",
                *flags("event_type", ("click", "error", "purchase", "signup", "view")),
                "(props->>'$.k')::double"])
DOCS = """
docs as (select d.doc_id as row_id, case when quality=1 then 1.0::double else -1.0::double end as y,
  text from documents d join labels l on d.doc_id=l.doc_id),
words as (select row_id, unnest(list_filter(string_split_regex(text,'\\s+'), lambda w: w<>'')) as word
  from docs),
counts as (select row_id, (('0x'||substr(md5(word),1,8))::bigint % 1024)::int as col,
  count(*)::double as x from words group by all),
long as (select c.row_id, d.y, c.col, c.x from counts c join docs d on c.row_id=d.row_id)"""

# the same of all documents, labelled or not
ALL_DOCS = DOCS.replace("case when quality=1 then 1.0::double else -1.0::double end", (
    "case quality when 1 then 1.0::double when 0 then -1.0::double else 0.0::double end")).replace(
    "from documents d join labels", "from documents d left join labels")

# train statistics of long, applied to long: zero mean, unit sample deviation
SCALED = """
stats as (select col, avg(x) as mean, stddev_samp(x) as sd from long group by col),
scaled as (select row_id, y, l.col, case when sd>0 then (x-mean)/sd else 0.0 end as x
  from long l join stats s on l.col=s.col)"""


def range_blocks(p: int, k: int) -> str:
    return f"blocks as (select c::int as col, ((c*{k})//{p})::int as block from range({p}) t(c))"


def random_blocks(p: int, k: int, seed: int = 1) -> str:
    h = word(f"'{seed}'", "'block'", "c")
    return (
        f"blocks as (select c::int as col, ((row_number() over (order by {h}, c)-1)%{k})::int "
        f"as block from range({p}) t(c))"
    )


def sparse_pi(q: int, seed: int = 1) -> str:
    h = word(f"'{seed}'", "col", "proj") + "%6"
    return f"""
pi as (select col, block, proj, sqrt(3.0::double/{q})*s as v from (
  select col, block, proj::int as proj, case {h} when 0 then -1.0 when 5 then 1.0 else 0.0 end as s
  from blocks, range({q}) t(proj)) where s<>0)"""


def sdct_pi(q: int, seed: int = 1) -> str:
    return f"""
placed as (select block, col, row_number() over (partition by block order by col)-1 as j,
  count(*) over (partition by block) as d,
  case when {word(f"'{seed}'", "'sign'", "col")}%2=0 then -1.0 else 1.0 end as sign from blocks),
coords as (select * from (select block, t, row_number() over (partition by block order by
  {word(f"'{seed}'", "'coordinate'", "block", "t")}, t)-1 as proj from
  (select block, unnest(range(count(*))) as t from blocks group by block)) where proj<{q}),
pi as (select col, p.block, proj::int as proj, sqrt(d/{q}::double)*sign
  *case when t=0 then sqrt(1.0::double/d) else sqrt(2.0::double/d) end
  *cos(pi()*(j+0.5::double)*t/d) as v from placed p join coords c on p.block=c.block)"""


RP = """
rp as (select row_id, block, proj, sum(x*v) as r from long l join pi on l.col=pi.col
  group by row_id, block, proj)"""
LOO = """
shared as (select row_id, block, proj as slot, sum(r) over (partition by row_id, proj)-r as r
  from rp)"""


def concat(q: int) -> str:
    return f"""
shared as (select a.row_id, b.block, (a.block-case when a.block>b.block then 1 else 0 end)*{q}+proj
  as slot, r from rp a join (select distinct block from blocks) b on a.block<>b.block)"""


RAW_Z = """
pos as (select col, block, row_number() over (partition by block order by col)-1 as i,
  count(*) over (partition by block) as d from blocks),
z as (select row_id, y, block, i, x as v from long l join pos p on l.col=p.col)"""
SHARED_Z = """
pos as (select col, block, row_number() over (partition by block order by col)-1 as i,
  count(*) over (partition by block) as d from blocks),
z as (select row_id, y, block, i, x as v from long l join pos p on l.col=p.col
  union all select s.row_id, o.y, s.block, w.d+s.slot as i, s.r as v from shared s
  join (select distinct row_id, y from long) o on s.row_id=o.row_id
  join (select distinct block, d from pos) w on s.block=w.block)"""

# Gram sums per fold; without folds every row is in fold 0
NO_FOLDS = "folds as (select distinct row_id, 0 as fold from long)"


def hash_folds(k: int, seed: int = 1) -> str:
    return (
        "folds as (select row_id, (" + word(f"'{seed}'", "'fold'", "row_id")
        + f"%{k}+1)::int as fold from (select distinct row_id from long))"
    )


GRAM = """
zf as materialized (select z.*, fold from z join folds f on z.row_id=f.row_id),
gram as materialized (select a.fold, a.block, a.i, b.i as j, sum(a.v*b.v) as v
  from zf a join zf b on a.row_id=b.row_id and a.block=b.block group by all),
zy as materialized (select fold, block, i, sum(v*y) as v from zf group by all),
sizes as (select fold, count(*) as n from folds group by fold)"""
# the systems to solve: all rows as fold 0, or every fold left out
ALL_ROWS = """
tgram as (select * from gram), tzy as (select * from zy), tsizes as (select * from sizes)"""
LEFT_OUT = """
tgram as (select f.fold, block, i, j, sum(v) as v from gram g join sizes f on g.fold<>f.fold group by all),
tzy as (select f.fold, block, i, sum(v) as v from zy g join sizes f on g.fold<>f.fold group by all),
tsizes as (select f.fold, sum(g.n) as n from sizes g join sizes f on g.fold<>f.fold group by all)"""


def ridge_solve(lambdas) -> str:
    """Gauss-Jordan elimination of (Z'Z + (n lambda/2) I | Z'y) per fold, block and lambda."""
    grid = ",".join(f"({v}::double)" for v in lambdas)
    return f"""
grid as (select * from (values {grid}) t(lambda)),
lines as (select g.fold, g.block, lambda, g.i, list(
    v + case when g.i=g.j then 0.5*n*lambda else 0 end order by g.j) as line
  from tgram g join tsizes s on g.fold=s.fold, grid group by g.fold, g.block, lambda, g.i),
systems as (select l.fold, l.block, lambda, list(list_append(line, v) order by l.i) as m,
    count(*) as size
  from lines l join tzy t on l.fold=t.fold and l.block=t.block and l.i=t.i
  group by l.fold, l.block, lambda),
gj as (select fold, block, lambda, size, 1 as k, m from systems union all
  select fold, block, lambda, size, k+1, list_transform(m, lambda r, i: case when i=k
    then list_transform(r, lambda x: x/m[k][k])
    else list_transform(r, lambda x, j: x - r[k]/m[k][k]*m[k][j]) end) from gj where k<=size),
weights as (select fold, block, lambda, unnest(range(size)) as i,
    unnest(list_transform(m, lambda r: r[size+1])) as beta from gj where k=size+1),
coef as (select p.col, w.fold, w.block, lambda, beta from weights w
  join pos p on w.block=p.block and w.i=p.i)"""


def query(*ctes: str, select: str) -> str:
    sql = "with recursive " + ",".join(ctes) + "\n" + select
    # the column of that name is quoted, since the word also starts a function
    return re.sub(r"\blambda\b(?!\s+\w+\s*[,:])", '"lambda"', sql)
