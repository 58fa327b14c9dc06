"""A tenant's SQL: views over its own tables in a session of its own, under scope, row cap and deadline.

Statements are in the tenant's dialect and are rewritten before Spark parses them. A session with a staging folder may
also write: each INSERT, REPLACE, UPDATE, DELETE, CREATE TABLE, ALTER TABLE or DROP TABLE makes the next version of a table
there, which later statements of the session see, and ``tables_now`` gives them all for one publication, so a script is
one transaction that is published or dropped.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import library, regex
from quillon.operators import dml
from quillon.operators.paging import ResultTooLarge, capped
from quillon.tenant import dialect, errors, splitter

#: Words that begin a statement which only reads.
READS = {"SELECT", "VALUES", "WITH", "EXPLAIN", "DESCRIBE", "DESC", "SHOW", "TABLE", "FROM"}
#: Words that reach beyond the tenant's tables, or change the session; refused in every scope.
BLOCKED = {"ATTACH", "DETACH", "VACUUM", "ADD", "SET", "RESET", "USE", "LIST", "CACHE", "UNCACHE", "REFRESH", "LOAD", "ANALYZE", "MSCK", "PRAGMA"}
#: Functions that run code, read files by name, or tell where files are.
REFUSED_FUNCTIONS = {"java_method", "reflect", "try_reflect", "read_files", "input_file_name", "input_file_block_start", "input_file_block_length"}


@dataclass
class Result:
    rows: list
    affected: int


NAME = r'(?P<name>"[^"]+"|`[^`]+`|\[[^\]]+\]|\w+)'
INSERT = re.compile(rf"(?is)(?:(?P<replace>replace|insert\s+or\s+replace)|insert)\s+into\s+{NAME}\s*(?:\((?P<columns>[^()]*)\))?\s*(?P<query>(?:values|select|with|default)\b.*)")
RETURNING = re.compile(r"(?i)\breturning\b(?=[^']*$)")
CREATE = re.compile(rf"(?is)create\s+table\s+(?P<maybe>if\s+not\s+exists\s+)?{NAME}\s*\((?P<columns>.*)\)$")
DROP = re.compile(rf"(?is)drop\s+table\s+(?P<maybe>if\s+exists\s+)?{NAME}$")
ALTER = re.compile(rf"(?is)alter\s+table\s+{NAME}\s+(?P<change>.+)$")
#: Column kinds of the dialect.
KINDS = {"INTEGER": T.LongType(), "INT": T.LongType(), "BIGINT": T.LongType(), "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(), "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType(), "BLOB": T.BinaryType()}


def _split_columns(text: str) -> list[str]:
    """Column definitions, without constraints of the table."""
    out, depth, now = [], 0, ""
    for c in text + ",":
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [c for c in out if c and not re.match(r"(?i)(primary|unique|foreign|check|constraint)\b", c)]


def _with_literals(statement: str, args: list) -> str:
    """The statement with its ? markers as literals."""
    left = iter(args)

    def literal(x: object) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else repr(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"

    return "".join(literal(next(left)) if m[0] == "?" else m[0] for m in splitter.TOKEN.finditer(statement))


class TenantSession:
    """SQL over one tenant's tables.

    tables: name to path or DataFrame. The session has its own views and functions; a statement is parsed
    before it runs, and may name those views only, so no path and no other catalog can be reached.
    """

    def __init__(self, spark: SparkSession, tenant: str, tables: Mapping[str, str | DataFrame], *, status: str = "active", row_cap: int = 100_000, deadline_s: float = 30.0, staging: str | None = None):
        if status in ("suspended", "deleted"):
            raise errors.failure(errors.SUSPENDED, f"{tenant} is {status}")
        self.spark, self.tenant, self.row_cap, self.deadline_s = spark.newSession(), tenant, row_cap, deadline_s
        self.spark.conf.set("spark.sql.ansi.enabled", "false")  # a zero divisor gives NULL, as does text that is no number
        library.register(self.spark)
        self.spark.udf.register("py_regexp", regex.search_column)
        self.names = set()
        self.staging, self.written = staging, set()
        for name, source in tables.items():
            if isinstance(source, str):
                df = self.spark.read.parquet(source)
            else:  # a view that both sessions see carries the plan over
                shared = f"t_{uuid.uuid4().hex}"
                source.createOrReplaceGlobalTempView(shared)
                df = self.spark.table(f"global_temp.{shared}")
            df.createOrReplaceTempView(name)
            self.names.add(name.lower())

    def check(self, statement: str) -> None:
        """Refuse what does not only read the tenant's own views."""
        word = splitter.leading_word(statement)
        if word in BLOCKED:
            raise errors.failure(errors.BLOCKED, f"{word} is not available")
        if word not in READS:
            raise errors.failure(errors.READONLY, f"{word or 'this statement'} is not a query")
        try:
            plan = self._parsed(statement)
        except PySparkException as e:
            raise errors.mapped(e) from e
        if word in ("EXPLAIN", "DESCRIBE", "DESC", "SHOW"):
            body = splitter.bare(statement)
            if word == "EXPLAIN":
                rest = body.split(None, 1)[1] if " " in body else ""
                for mode in ("EXTENDED", "CODEGEN", "COST", "FORMATTED"):
                    rest = rest[len(mode) :].strip() if rest.upper().startswith(mode + " ") else rest
                self.check(rest)
            elif word == "SHOW" or body.split()[-1].lower() not in self.names:
                raise errors.failure(errors.BLOCKED, "only the tenant's own tables can be described; see tables()")
            return
        self._check_plan(plan)

    def _parsed(self, statement: str):
        return self.spark._jsparkSession.sessionState().sqlParser().parsePlan(dialect.translate(statement))

    def _check_plan(self, plan) -> None:
        nodes = list(_nodes(plan))
        known = self.names | {name for node in nodes if node.nodeName() == "UnresolvedWith" for name in _cte_names(node)}
        for node in nodes:
            kind = node.nodeName()
            if kind == "UnresolvedRelation":
                parts = _items(node.multipartIdentifier())
                if len(parts) != 1 or parts[0].lower() not in known:
                    raise errors.failure(errors.BLOCKED, f"no table {'.'.join(parts)}")
            elif "UnresolvedIdentifier" in kind:
                raise errors.failure(errors.BLOCKED, "a table must be named, not computed")
            elif any(w in kind for w in WRITING):
                raise errors.failure(errors.READONLY, f"{kind} is not a query")
        text = plan.toString().lower()
        if "_metadata" in text:
            raise errors.failure(errors.BLOCKED, "_metadata is not available")
        for name in REFUSED_FUNCTIONS:
            if f"{name}(" in text:
                raise errors.failure(errors.BLOCKED, f"{name} is not available")

    def query(self, statement: str, args: list | None = None) -> DataFrame:
        """The result as a DataFrame, not yet run."""
        self.check(statement)
        try:
            text = dialect.translate(statement)
            return self.spark.sql(text, args=args) if args else self.spark.sql(text)
        except PySparkException as e:
            raise errors.mapped(e) from e

    def rows(self, statement: str, args: list | None = None) -> list[Row]:
        """All rows, under the row cap and the deadline."""
        group, late, done = f"{self.tenant}-{uuid.uuid4().hex}", threading.Event(), threading.Event()
        context = self.spark.sparkContext

        def stop() -> None:
            late.set()
            while not done.wait(0.2):  # a job that starts only after the deadline is stopped too
                context.cancelJobsWithTag(group)

        timer = threading.Timer(self.deadline_s, stop)
        timer.daemon = True
        context.addJobTag(group)
        timer.start()
        try:
            return capped(self.query(statement, args), self.row_cap)
        except ResultTooLarge as e:
            raise errors.failure(errors.TOO_LARGE, str(e)) from e
        except errors.TenantError:
            raise
        except Exception as e:
            if late.is_set():
                raise errors.failure(errors.TIMEOUT, f"over {self.deadline_s} s") from e
            raise errors.mapped(e) from e
        finally:
            done.set()
            timer.cancel()
            context.removeJobTag(group)

    def script(self, text: str) -> list[list[Row]]:
        """Every statement's rows; if one is refused, none runs."""
        statements = splitter.split(text)
        for s in statements:
            self.check(s)
        return [self.rows(s) for s in statements]

    def execute(self, statement: str, args: list | None = None) -> Result:
        """A query's rows, or what a write changed: affected rows, and those of its RETURNING clause."""
        word = splitter.leading_word(statement)
        if word not in ("INSERT", "REPLACE", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP"):
            return Result(self.rows(statement, args), 0)
        if self.staging is None:
            raise errors.failure(errors.READONLY, f"{word} is not a query")
        text = splitter.bare(_with_literals(statement, args or [])).rstrip(";").strip()
        try:
            return self._define(text) if word in ("CREATE", "ALTER", "DROP") else self._write(word, text)
        except errors.TenantError:
            raise
        except Exception as e:
            raise errors.mapped(e) from e

    def _own(self, name: str) -> str:
        name = name.strip('"`[]').lower()
        if name not in self.names:
            raise errors.failure(errors.BLOCKED, f"no table {name}")
        return name

    def _stage(self, name: str, df: DataFrame) -> None:
        path = f"{self.staging}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.spark.read.schema(df.schema).parquet(path).createOrReplaceTempView(name)
        self.names.add(name)
        self.written.add(name)

    def tables_now(self) -> dict[str, DataFrame]:
        """Every table as the session left it."""
        return {name: self.spark.table(name) for name in sorted(self.names)}

    def _write(self, word: str, text: str) -> Result:
        body, _, returning = text.partition(m[0]) if (m := RETURNING.search(text)) else (text, "", "")
        if word in ("INSERT", "REPLACE"):
            found = INSERT.match(body)
            if not found:
                raise errors.TenantError("SQLITE_ERROR", 400, "INSERT INTO table [(columns)] query is understood")
            name = self._own(found["name"])
            table = self.spark.table(name)
            names = [c.strip().strip('"`[]') for c in found["columns"].split(",")] if found["columns"] else table.columns
            self.check(found["query"] if not found["query"].upper().startswith("DEFAULT") else "SELECT 1")
            rows = self.query(found["query"])
            if len(rows.columns) != len(names) or not set(names) <= set(table.columns):
                raise errors.TenantError("SQLITE_ERROR", 400, f"{len(rows.columns)} values for {len(names)} columns")
            rows = rows.toDF(*names)
            after, changed = dml.insert(table, rows) if word == "INSERT" and not found["replace"] else dml.replace(table, rows, [table.columns[0]])
        else:
            plan = self._parsed(body)
            if plan.nodeName() not in ("UpdateTable", "DeleteFromTable"):
                raise errors.TenantError("SQLITE_ERROR", 400, f"{plan.nodeName()} is not understood")
            name = self._own(_items(plan.table().multipartIdentifier())[-1])
            table = self.spark.table(name)
            condition = plan.condition()
            if plan.nodeName() == "UpdateTable":
                where = F.expr(condition.get().sql()) if condition.isDefined() else F.lit(True)
                changes = {a.key().sql().strip("`"): F.expr(a.value().sql()) for a in _items(plan.assignments())}
                if not set(changes) <= set(table.columns):
                    raise errors.TenantError("SQLITE_ERROR", 400, f"no column {sorted(set(changes) - set(table.columns))[0]}")
                after, changed = dml.update(table, where, changes)
            else:
                after, changed = dml.delete(table, F.expr(condition.sql()))
        kept = self.spark.createDataFrame(capped(changed, self.row_cap), changed.schema) if returning else None
        affected = changed.count()
        self._stage(name, after)
        if kept is None:
            return Result([], affected)
        wanted = [dialect.translate(c.strip()) for c in returning.split(",")]
        return Result(kept.selectExpr(*wanted).collect(), affected)

    def _define(self, text: str) -> Result:
        if m := CREATE.match(text):
            name = m["name"].strip('"`[]').lower()
            if name in self.names:
                if m["maybe"]:
                    return Result([], 0)
                raise errors.TenantError("SQLITE_ERROR", 400, f"table {name} exists")
            fields = [c.split() for c in _split_columns(m["columns"])]
            schema = T.StructType([T.StructField(f[0].strip('"`[]'), KINDS.get(re.sub(r"\W.*", "", f[1]).upper() if len(f) > 1 else "", T.StringType())) for f in fields])
            self._stage(name, self.spark.createDataFrame([], schema))
        elif m := DROP.match(text):
            name = m["name"].strip('"`[]').lower()
            if name not in self.names:
                if m["maybe"]:
                    return Result([], 0)
                raise errors.TenantError("SQLITE_ERROR", 400, f"no table {name}")
            self.spark.catalog.dropTempView(name)
            self.names.discard(name)
            self.written.add(name)
        elif m := ALTER.match(text):
            name = self._own(m["name"])
            table, words = self.spark.table(name), m["change"].split()
            plain = [w.strip('"`[]') for w in words]
            upper = [w.upper() for w in words if w.upper() != "COLUMN"]
            plain = [w for w in plain if w.upper() != "COLUMN"]
            if upper[0] == "ADD":
                self._stage(name, table.withColumn(plain[1], F.lit(None).cast(KINDS.get(upper[2] if len(upper) > 2 else "", T.StringType()))))
            elif upper[0] == "DROP":
                self._stage(name, table.drop(plain[1]))
            elif upper[:2] == ["RENAME", "TO"]:
                self._stage(plain[2].lower(), table)
                self.spark.catalog.dropTempView(name)
                self.names.discard(name)
            elif upper[0] == "RENAME" and upper[2] == "TO":
                self._stage(name, table.withColumnRenamed(plain[1], plain[3]))
            else:
                raise errors.TenantError("SQLITE_ERROR", 400, f"{m['change']} is not understood")
        else:
            raise errors.failure(errors.BLOCKED, "only tables can be created, altered and dropped")
        return Result([], 0)

    def tables(self) -> dict[str, list[tuple[str, str]]]:
        """The tenant's tables with their columns and types."""
        return {name: self.spark.table(name).dtypes for name in sorted(self.names)}

    def stream(self, statement: str, args: list | None = None) -> Iterator[Row]:
        """Rows one after another, a partition at a time in memory; the row cap ends the stream with an error."""
        for i, row in enumerate(self.query(statement, args).toLocalIterator()):
            if i >= self.row_cap:
                raise errors.failure(errors.TOO_LARGE, f"over {self.row_cap} rows")
            yield row

    def describe(self, statement: str) -> dict:
        """Columns, parameter count and kind, without running anything."""
        self.check(statement)
        n = splitter.parameters(statement)
        text = dialect.translate(statement)
        df = self.spark.sql(text, args=[None] * n) if n else self.spark.sql(text)
        return {"columns": df.dtypes, "parameters": n, "explain": splitter.leading_word(statement) == "EXPLAIN", "readonly": True}


#: Parts of the names of plan nodes that change something.
WRITING = ("Insert", "Create", "Drop", "Write", "Command", "Delete", "Update", "Merge", "Script", "SetCatalog", "Alter", "Rename")


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _nodes(plan):
    yield plan
    for child in [*_items(plan.children()), *_items(plan.subqueries()), *(_items(plan.innerChildren()) if plan.nodeName() == "UnresolvedWith" else [])]:
        yield from _nodes(child)


def _cte_names(node) -> list[str]:
    return [pair.productElement(0).lower() for pair in _items(node.cteRelations())]
