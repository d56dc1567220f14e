"""DuckDB files as a Spark source (A5), read-only.

A Python Data Source: the planner asks each file for its id range and cuts
it into ranges; every Spark partition opens its file read-only and streams
its range as Arrow record batches. The files must be on a path every
executor can open. Ingest once, write Parquet, and read Parquet after that.

    spark.dataSource.register(DuckDBDataSource)
    df = (spark.read.format("duckdb_file").option("paths", "a.duckdb,b.duckdb")
          .option("id_column", "__hf_index_id").load())
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


NULL_IDS = "null"          # the partition of the rows without an id


@dataclass
class _Range(InputPartition):
    path: str
    lo: int | str | None
    hi: int | str | None


class DuckDBDataSource(DataSource):
    """Options: ``paths`` (comma separated), ``table`` (default: the first
    table by name in each file), ``id_column`` (integer column for range
    splits), ``rows_per_partition`` (default 100000)."""

    @classmethod
    def name(cls):
        return "duckdb_file"

    def _first(self):
        """Table name and its Arrow schema (from an empty result)."""
        import duckdb
        path = self.options["paths"].split(",")[0]
        con = duckdb.connect(path, read_only=True)
        try:
            table = self.options.get("table") or sorted(r[0] for r in con.execute("SHOW TABLES").fetchall())[0]
            arrow_schema = con.execute(f"SELECT * FROM {_quote(table)} LIMIT 0").to_arrow_table().schema
        finally:
            con.close()
        return table, arrow_schema

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema
        _, arrow_schema = self._first()
        return from_arrow_schema(arrow_schema)

    def reader(self, schema):
        table, _ = self._first()
        return _Reader(self.options, table, [f.name for f in schema.fields])


class _Reader(DataSourceReader):
    def __init__(self, options, table, columns):
        self.paths = [p for p in options["paths"].split(",") if p]
        self.table = table
        self.columns = columns
        self.id_column = options.get("id_column")
        self.rows = int(options.get("rows_per_partition", 100000))

    def partitions(self):
        import duckdb
        parts = []
        for p in self.paths:
            if not self.id_column:
                parts.append(_Range(p, None, None))
                continue
            con = duckdb.connect(p, read_only=True)
            try:
                lo, hi, n, rows = con.execute(
                    f"SELECT min({_quote(self.id_column)}), max({_quote(self.id_column)}), "
                    f"count({_quote(self.id_column)}), count(*) FROM {_quote(self.table)}").fetchone()
            finally:
                con.close()
            if rows > n:
                parts.append(_Range(p, NULL_IDS, NULL_IDS))     # rows without an id
            if n == 0:
                continue
            k = max(1, -(-n // self.rows))
            width = max(1, -(-(hi - lo + 1) // k))
            parts.extend(_Range(p, a, min(a + width, hi + 1)) for a in range(lo, hi + 1, width))
        return parts

    def read(self, partition):
        import duckdb
        con = duckdb.connect(partition.path, read_only=True)
        try:
            cols = ", ".join(_quote(c) for c in self.columns)
            sql = f"SELECT {cols} FROM {_quote(self.table)}"
            if partition.lo == NULL_IDS:
                sql += f" WHERE {_quote(self.id_column)} IS NULL"
            elif partition.lo is not None:
                idc = _quote(self.id_column)
                sql += f" WHERE {idc} >= {int(partition.lo)} AND {idc} < {int(partition.hi)}"
            res = con.execute(sql)
            reader = (res.to_arrow_reader(10000) if hasattr(res, "to_arrow_reader")
                      else res.fetch_record_batch(10000))
            for batch in reader:
                yield batch
        finally:
            con.close()
