"""A folder of parquet tables as one read-only database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lakequill.session import TABLES, table


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] | list[str] = tuple(TABLES)) -> None:
    """Every table as a temporary view; a missing one is passed over."""
    for name in names:
        if _there(spark, f"{sf_dir}/{name}.parquet"):
            table(spark, sf_dir, name).createOrReplaceTempView(name)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


_DECLARED = {"tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "boolean": "INTEGER", "float": "REAL", "double": "REAL", "string": "TEXT", "binary": "BLOB"}


def declared_type(kind: T.DataType) -> str:
    """The affinity name of a Spark type."""
    return _DECLARED.get(kind.simpleString(), "NUMERIC")


def affinity(declared: str | None) -> str:
    """Affinity from a declared type, by what its text contains."""
    if not declared:
        return "BLOB"
    t = declared.upper()
    for words, name in ((("INT",), "INTEGER"), (("CHAR", "CLOB", "TEXT"), "TEXT"), (("BLOB",), "BLOB"), (("REAL", "FLOA", "DOUB"), "REAL")):
        if any(w in t for w in words):
            return name
    return "NUMERIC"


_INFO = "cid int, name string, type string, notnull int, dflt_value string, pk int"


def table_info(spark: SparkSession, name: str, hidden: bool = False) -> DataFrame:
    """One row per column; with `hidden` the column that says whether it is hidden."""
    try:
        fields = spark.table(f"`{name}`").schema.fields
    except Exception as e:  # no such table: no rows
        if "TABLE_OR_VIEW_NOT_FOUND" not in str(e):
            raise
        fields = []
    rows = [(i, f.name, declared_type(f.dataType), int(not f.nullable), None, 0) + ((0,) if hidden else ()) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, _INFO + (", hidden int" if hidden else ""))


def database_list(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    return spark.createDataFrame([(0, "main", sf_dir)], "seq int, name string, file string")


def schema_table(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """type, name, tbl_name, rootpage, sql of every view that is registered."""
    rows = []
    for t in spark.catalog.listTables():
        if names is None or t.name in names:
            cols = ", ".join(f'"{f.name}" {declared_type(f.dataType)}' for f in spark.table(f"`{t.name}`").schema.fields)
            rows.append(("table", t.name, t.name, 0, f'CREATE TABLE "{t.name}"({cols})'))
    return spark.createDataFrame(sorted(rows), "type string, name string, tbl_name string, rootpage int, sql string")


#: Metadata that parquet has none of: always empty, with these columns.
EMPTY_PRAGMAS = {
    "index_list": "seq int, name string, unique int, origin string, partial int",
    "index_info": "seqno int, cid int, name string",
    "index_xinfo": "seqno int, cid int, name string, desc int, coll string, key int",
    "foreign_key_list": "id int, seq int, table string, from string, to string, on_update string, on_delete string, match string",
}


def pragma(spark: SparkSession, name: str, argument: str | None = None, sf_dir: str = "") -> DataFrame | None:
    """Rows of a metadata pragma; None for a name that is not known."""
    name = name.lower()
    if name in ("table_info", "table_xinfo"):
        return table_info(spark, argument or "", name == "table_xinfo")
    if name == "database_list":
        return database_list(spark, sf_dir)
    if name in EMPTY_PRAGMAS:
        return spark.createDataFrame([], EMPTY_PRAGMAS[name].replace("table string", "`table` string").replace("from string", "`from` string").replace("to string", "`to` string"))
    return None
