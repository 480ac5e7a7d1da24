"""Graph-pattern algebra over triple frames: scans, joins, filters and solution forms.

Variables are columns. A solution frame holds one column per variable.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from govgraph.session import local_frame, scratch_path

VARIABLE = "?"


def pattern(triples: DataFrame, s: str, p: str, o: str, kind: str | None = None) -> DataFrame:
    """Scan one triple pattern; ``?name`` is a variable, other text a constant.

    A repeated variable asks for equality. ``kind`` restricts the object kind.
    """
    condition = F.lit(True)
    bound: dict[str, Column] = {}
    for column, term in (("p", p), ("s", s), ("o", o)):
        if not term.startswith(VARIABLE):
            condition = condition & (F.col(column) == term)
        elif term[1:] in bound:
            condition = condition & (F.col(column) == bound[term[1:]])
        else:
            bound[term[1:]] = F.col(column)
    if kind is not None:
        condition = condition & (F.col("o_kind") == kind)
    scanned = triples.filter(condition)
    order = [t[1:] for t in (s, p, o) if t.startswith(VARIABLE)]
    return scanned.select(*[bound[name].alias(name) for name in dict.fromkeys(order)])


def compatible_join(left: DataFrame, right: DataFrame, how: str = "inner", unbound: tuple[str, ...] = ()) -> DataFrame:
    """Join on the shared variables; one of ``unbound`` that is null in ``left`` agrees with anything.

    Solutions are parted by which of these variables they lack, and every part is an equi-join on
    the rest. A part that lacks all shared variables is a product, as the algebra asks.
    """
    shared = [c for c in left.columns if c in right.columns]
    open_ = [c for c in shared if c in unbound]
    if not open_:
        return left.join(right, shared, how)
    parts = []
    for lacking in (c for n in range(len(open_) + 1) for c in combinations(open_, n)):
        state = reduce(lambda a, b: a & b, [F.col(c).isNull() if c in lacking else F.col(c).isNotNull() for c in open_])
        part, keys = left.filter(state), [c for c in shared if c not in lacking]
        if how == "left_anti":
            # Nothing bound in common takes nothing away.
            parts.append(part.join(right, keys, how) if keys else part)
            continue
        part = part.drop(*lacking)
        joined = part.join(right, keys, how) if keys else _product(part, right, how)
        parts.append(joined)
    return reduce(lambda a, b: a.unionByName(b), parts)


def _product(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    return left.join(right, F.lit(True), how)


def bgp(*patterns: DataFrame, product: bool = False, unbound: tuple[str, ...] = ()) -> DataFrame:
    """Conjunction of solution frames on their shared variables.

    Patterns are joined in the given order, a connected one first. A part without any shared variable is a
    product; it is refused unless the caller asks for it. ``unbound`` names variables that an
    optional part may have left without a value.
    """
    left, rest = patterns[0], list(patterns[1:])
    while rest:
        nearest = next((p for p in rest if set(p.columns) & set(left.columns)), None)
        if nearest is not None:
            left = compatible_join(left, nearest, unbound=unbound)
        elif product:
            nearest = rest[0]
            left = _product(left, nearest, "inner")
        else:
            raise ValueError("patterns share no variable; ask for product=True")
        rest.remove(nearest)
    return left


def optional(left: DataFrame, right: DataFrame, unbound: tuple[str, ...] = ()) -> DataFrame:
    """Left outer extension; variables only in ``right`` are null where unmatched."""
    if not set(left.columns) & set(right.columns):
        return _product(left, right, "left")
    return compatible_join(left, right, "left", unbound)


def where(solutions: DataFrame, condition: Column) -> DataFrame:
    """Keep solutions for which the condition holds; an error or null drops the row."""
    return solutions.filter(condition)


def project(solutions: DataFrame, variables: list[str]) -> DataFrame:
    """The named variables as a bag."""
    return solutions.select(*variables)


def project_distinct(solutions: DataFrame, variables: list[str]) -> DataFrame:
    """The named variables as a set."""
    return solutions.select(*variables).distinct()


def order_by(solutions: DataFrame, variables: list[str]) -> DataFrame:
    """Ascending order; unbound values first."""
    return solutions.orderBy(*[F.asc_nulls_first(v) for v in variables])


def limited(solutions: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` solutions with a flag whether there were more."""
    keys = [F.asc_nulls_first(v) for v in order]
    # At most n + 1 rows reach the window.
    page = solutions.orderBy(*keys).limit(n + 1)
    whole = Window.partitionBy(F.lit(1))
    numbered = page.select(
        "*",
        F.row_number().over(whole.orderBy(*keys)).alias("_rank"),
        (F.count(F.lit(1)).over(whole) > n).alias("truncated"),
    )
    return numbered.filter(F.col("_rank") <= n).drop("_rank")


def ask(solutions: DataFrame) -> DataFrame:
    """One row ``answer``: is there any solution."""
    return solutions.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))


def construct(solutions: DataFrame, template: list[tuple[str, str, str, str]]) -> DataFrame:
    """New triples ``(s, p, o, o_kind)`` per solution, as a set; unbound ones drop out."""

    def term(text: str) -> Column:
        return F.col(text[1:]) if text.startswith(VARIABLE) else F.lit(text)

    made = F.array(*[
        F.struct(
            term(s).alias("s"), term(p).alias("p"), term(o).alias("o"), F.lit(kind).alias("o_kind")
        )
        for s, p, o, kind in template
    ])
    rows = solutions.select(F.explode(made).alias("t")).select("t.*")
    return rows.filter("s IS NOT NULL AND o IS NOT NULL").distinct()


def describe(triples: DataFrame, iri: str) -> DataFrame:
    """Triples of a resource and of the blank nodes it points at."""
    own = triples.filter(F.col("s") == iri)
    nodes = own.filter("o_kind = 'bnode'").select(F.col("o").alias("s")).distinct()
    return own.unionByName(triples.join(nodes, "s", "left_semi").select(*triples.columns)).distinct()


def pattern_union(*parts: DataFrame) -> DataFrame:
    """Solutions of any part, as a bag; variables a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def exists(solutions: DataFrame, inner: DataFrame) -> DataFrame:
    """Solutions with a match in ``inner``; without shared variables all or none."""
    shared = [c for c in solutions.columns if c in inner.columns]
    return solutions.join(inner, shared, "left_semi") if shared else _if_any(solutions, inner, True)


def not_exists(solutions: DataFrame, inner: DataFrame) -> DataFrame:
    """Solutions without a match in ``inner``; without shared variables all or none."""
    shared = [c for c in solutions.columns if c in inner.columns]
    return solutions.join(inner, shared, "left_anti") if shared else _if_any(solutions, inner, False)


def _if_any(solutions: DataFrame, inner: DataFrame, wanted: bool) -> DataFrame:
    found = inner.limit(1).agg((F.count(F.lit(1)) > 0).alias("_any"))  # one row
    return solutions.join(F.broadcast(found), F.lit(True)).filter(F.col("_any") == wanted).drop("_any")


def pattern_minus(solutions: DataFrame, other: DataFrame, unbound: tuple[str, ...] = ()) -> DataFrame:
    """Solutions without a compatible one in ``other``; unchanged if nothing is shared."""
    if not set(solutions.columns) & set(other.columns):
        return solutions
    return compatible_join(solutions, other, "left_anti", unbound)


def bind(solutions: DataFrame, name: str, value: Column) -> DataFrame:
    if name in solutions.columns:
        raise ValueError(f"variable {name} is bound already")
    return solutions.withColumn(name, value)


def values(
    solutions: DataFrame, variables: list[str], rows: list[tuple], unbound: tuple[str, ...] = ()
) -> DataFrame:
    """Join with the rows given in the query; without shared variables every solution meets every row.

    A null in a row (UNDEF) agrees with anything, as does a variable of ``unbound`` that a solution lacks.
    """
    schema = ", ".join(f"`{v}` string" for v in variables)
    shared = [v for v in variables if v in solutions.columns]
    parts = []
    for given in dict.fromkeys(tuple(v for v, x in zip(variables, r, strict=True) if x is not None or v not in shared) for r in rows):
        own = [tuple(x for v, x in zip(variables, r, strict=True) if v in given) for r in rows
               if given == tuple(v for v, x in zip(variables, r, strict=True) if x is not None or v not in shared)]
        inline = local_frame(solutions.sparkSession, own, ", ".join(f"`{v}` string" for v in given)) if given else None
        if inline is None:
            parts.extend([solutions] * len(own))
        elif set(given) & set(shared):
            parts.append(compatible_join(solutions, F.broadcast(inline), unbound=unbound))
        else:
            parts.append(_product(solutions, F.broadcast(inline), "inner"))
    if not parts:
        none = local_frame(solutions.sparkSession, [], schema)
        return _product(solutions.limit(0), none.drop(*shared), "inner")
    return reduce(lambda a, b: a.unionByName(b), parts)


def path_closure(edges: DataFrame, min_hops: int = 1) -> DataFrame:
    """All ``(s, o)`` joined by one or more ``edges(s, o)``; zero hops with ``min_hops=0``.

    Paths double: the pairs that are more than 2 ** (k - 1) and at most 2 ** k hops apart, found last, are extended by
    all pairs known, which finds those up to 2 ** (k + 1) apart. Rounds are a logarithm of the longest distance. Each
    round writes only its new pairs, in the folder that the cluster shares; nothing known is written again.
    """
    spark = edges.sparkSession
    path = scratch_path(spark, "closure")
    rounds = [f"{path}/round=0"]
    steps = edges.select("s", "o").filter("s IS NOT NULL AND o IS NOT NULL").distinct()
    steps.write.parquet(rounds[0])
    schema = steps.schema
    while True:
        fresh = spark.read.schema(schema).parquet(rounds[-1])
        known = spark.read.schema(schema).parquet(*rounds)
        if fresh.isEmpty():
            break
        longer = (
            fresh.select("s", F.col("o").alias("_mid"))
            .join(known.select(F.col("s").alias("_mid"), "o"), "_mid")
            .select("s", "o")
            .distinct()
        )
        rounds.append(f"{path}/round={len(rounds)}")
        longer.join(known, ["s", "o"], "left_anti").write.parquet(rounds[-1])
    if min_hops == 0:
        nodes = edges.select("s").union(edges.select("o")).distinct()
        known = known.unionByName(nodes.select("s", F.col("s").alias("o"))).distinct()
    return known


def typed_value(value: Column, datatype: Column) -> Column:
    """A decimal view of numeric literals; null for other datatypes."""
    numeric = datatype.endswith("#decimal") | datatype.endswith("#integer")
    return F.when(numeric, value.try_cast("decimal(38,18)"))
