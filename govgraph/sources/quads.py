"""N-Quads and N-Triples text to and from triple rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govgraph.operators.merkle import differing_leaves, differing_rows, hash_tree, root_digest, tree_depth

# Fixed value: one statement of the line format; groups are subject, predicate,
# object, graph.
STATEMENT = (
    r"^\s*(<[^<>]*>|_:\S+)\s+(<[^<>]*>)\s+"
    r'(<[^<>]*>|_:\S+|"(?:[^"\\]++|\\.)*+"(?:\^\^<[^<>]*>|@[A-Za-z0-9-]+)?)'
    r"\s*(<[^<>]*>|_:\S+)?\s*\.\s*$"
)
# Escapes inside literals.
ESCAPES = (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), ('\\"', '"'))
PIECE = r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]++"

TRIPLE_COLUMNS = ["s", "p", "o", "o_kind", "o_datatype", "o_lang"]


def _term(text: Column) -> Column:
    return F.when(text.startswith("<"), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(
        text
    )


def _unescape(text: Column) -> Column:
    def meant(piece: Column) -> Column:
        code = F.lpad(F.substr(piece, F.lit(3)), 8, "0")
        out = F.when(piece.rlike(r"\A\\[uU]"), F.decode(F.unhex(code), "UTF-32"))
        for written, char in ESCAPES:
            out = out.when(piece == written, F.lit(char))
        return out.when(piece.startswith("\\"), F.substr(piece, F.lit(2))).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(pieces, meant), "")).otherwise(text)


def _escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for written, meant in ESCAPES:
        out = F.replace(out, F.lit(meant), F.lit(written))
    return out


def parse_nquads(lines: DataFrame, value: str = "value") -> DataFrame:
    """Statement lines to triple rows; ``malformed`` marks what is no statement."""
    body = lines.filter(F.col(value).rlike(r"^\s*[^#\s]"))
    parts = [F.regexp_extract(value, STATEMENT, i).alias(n) for i, n in enumerate("spog", 1)]
    raw = body.select(*parts)
    literal = F.col("o").startswith('"')
    lexical = _unescape(F.regexp_extract("o", r'(?s)^"(.*)"[^"]*$', 1))
    datatype = F.regexp_extract("o", r'"\^\^<([^<>]*)>$', 1)
    language = F.regexp_extract("o", r'"@([A-Za-z0-9-]+)$', 1)
    return raw.select(
        _term(F.col("s")).alias("s"),
        _term(F.col("p")).alias("p"),
        F.when(literal, lexical).otherwise(_term(F.col("o"))).alias("o"),
        F.when(literal, "literal")
        .when(F.col("o").startswith("_:"), "bnode")
        .otherwise("iri")
        .alias("o_kind"),
        F.when(literal & (datatype != ""), datatype).alias("o_datatype"),
        F.when(literal & (language != ""), language).alias("o_lang"),
        F.when(F.col("g") != "", _term(F.col("g"))).alias("graph"),
        (F.col("s") == "").alias("malformed"),
    )


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    return parse_nquads(spark.read.text(path))


def format_nquads(triples: DataFrame) -> DataFrame:
    """Triple rows to statement lines in column ``value``."""

    def resource(name: str) -> Column:
        c = F.col(name)
        return F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))

    literal = F.concat(
        F.lit('"'),
        _escape(F.col("o")),
        F.lit('"'),
        F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang")))
        .when(
            F.col("o_datatype").isNotNull(),
            F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">")),
        )
        .otherwise(""),
    )
    parts = [
        resource("s"),
        resource("p"),
        F.when(F.col("o_kind") == "literal", literal).otherwise(resource("o")),
    ]
    if "graph" in triples.columns:
        parts.append(F.when(F.col("graph").isNotNull(), resource("graph")))
    return triples.select(F.concat_ws(" ", *parts, F.lit(".")).alias("value"))


# Beside the lines of a dump, hidden from readers: the hash tree over them.
TREE = "_hash_tree"


def write_nquads(triples: DataFrame, path: str, depth: int | None = None) -> None:
    """Sorted statement lines; the range sort keeps the write parallel. A hash tree over the lines as they were written
    is kept with them."""
    format_nquads(triples).orderBy("value").write.mode("errorifexists").text(path)
    lines = _line_hashes(triples.sparkSession, path)
    hash_tree(lines, tree_depth(lines.count()) if depth is None else depth).write.parquet(f"{path}/{TREE}")


def _line_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.sha2("value", 256).alias("h"))


def dump_tree(spark: SparkSession, path: str) -> DataFrame:
    """The hash tree that was written with a dump."""
    return spark.read.parquet(f"{path}/{TREE}")


def dump_digest(spark: SparkSession, path: str) -> str | None:
    """One digest of all lines of a dump, whatever their order and files; null for an empty one."""
    return root_digest(dump_tree(spark, path))


def damaged_parts(spark: SparkSession, path: str) -> DataFrame:
    """Leaves of the tree that the lines do not match any more; none for a dump as it was written."""
    kept = dump_tree(spark, path)
    depth = kept.agg(F.max("level")).first()[0] or 1
    return differing_leaves(kept, hash_tree(_line_hashes(spark, path), depth), depth)


def changed_lines(spark: SparkSession, path: str, other: str) -> DataFrame:
    """Hashes of the lines in which two dumps differ, found down the trees, with their counts."""
    left, right = dump_tree(spark, path), dump_tree(spark, other)
    depth = left.agg(F.max("level")).first()[0] or 1
    if (right.agg(F.max("level")).first()[0] or 1) != depth:
        right = hash_tree(_line_hashes(spark, other), depth)
    leaves = differing_leaves(left, right, depth)
    return differing_rows(_line_hashes(spark, path), _line_hashes(spark, other), leaves, depth)
