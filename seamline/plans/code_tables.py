"""Source files made from the driver's parts: a text in Python or JavaScript for each, as DataFrame and as SQL.

The files' symbols, imports, calls and so on follow from the templates, so SQL tells them without a parser.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as ad

#: Texts of the files; {k} is the part, {j} the next one, {h} its place among seven, {n} its name, {c} its component.
PYTHON = """import json as js
from src.{c} import helper_{h}, Base as B

@app.get('/items/{k}')
def list_{n}(limit):
    \"\"\"Lists {n}.\"\"\"
    rows = Part{j}(limit, size=3)
    return client.get('https://example.com/{n}', rows)

class Part{k}(B, metaclass=Meta):
    def total(self, price):
        if price > 1:
            return self.list(price)
        return js.dumps(eval('price'))

    @property
    def label(self):
        return '{n}'

def unused_{k}():
    token = 'abcd1234efgh'
    return requests.get(url, list_{n}(1))
"""
JAVASCRIPT = """import {{ api as call, Base }} from './{c}'
import './style.css'
const fs = require('fs')

class Part{k} extends Base {{
  load(id) {{
    return fetchOrders(id)
  }}
}}

const go{k} = async (x) => {{
  return helper_{h}(x)
}}

function run{k}(a) {{
  go{k}(a)
}}

router.get('/items/{k}', go{k})
test('{n} works', () => {{ run{k}(1) }})
"""
BROKEN = "def f(:\n"
FIELDS = ["k", "j", "h", "n", "c"]


def _parts(template: str) -> list[tuple[bool, str]]:
    """(is a field, text) pieces of a template."""
    found = []
    for piece in re.split(r"(\{\{|\}\}|\{[a-z]\})", template):
        if piece in ("{{", "}}"):
            found.append((False, piece[0]))
        elif re.fullmatch(r"\{[a-z]\}", piece):
            found.append((True, piece[1]))
        elif piece:
            found.append((False, piece))
    return found


def _column(template: str) -> Column:
    return F.concat(*[F.col(p).cast("string") if field else F.lit(p) for field, p in _parts(template)])


def _sql(template: str) -> str:
    quoted = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return " || ".join(p if field else quoted(p) for field, p in _parts(template))


def _once(rows: DataFrame) -> DataFrame:
    """The same rows. Filters on their columns stay above, and expressions that use a column several times don't make it as often."""
    return rows.where(F.spark_partition_id() >= 0)


def sources(spark: SparkSession, sf_dir: str, edited: bool = False) -> DataFrame:
    """file_id, path, kind, language, content. edited: a later state, in which some files are changed, gone or new."""
    kind = F.when(F.col("k") % 50 == 7, "broken").when(F.col("k") % 50 == 9, "unknown").when(F.col("k") % 50 == 11, "ignored").when(F.col("language") == "javascript", "javascript").otherwise("python")
    # a file and its symbol are one row of part, whose key is unique, so they need no join; rows are spread before
    # anything is made of them: a table of one small file would have all of it made in one task
    part = ad.table(spark, sf_dir, "part").where("p_partkey is not null").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    rows = _once(part.select(*ad.file_columns(), F.replace("p_name", F.lit(" "), F.lit("_")).alias("n")).withColumnRenamed("file_id", "k"))
    rows = rows.withColumns({"kind": kind, "j": F.col("k") + 1, "h": F.col("k") % 7, "c": F.col("component")})
    text = F.when(F.col("kind") == "javascript", _column(JAVASCRIPT)).when(F.col("kind") == "broken", BROKEN).otherwise(_column(PYTHON))
    path = F.when(F.col("kind") == "ignored", F.concat(F.lit("node_modules/"), "path")).when(F.col("kind") == "broken", F.regexp_replace("path", r"\.ts$", ".py")).otherwise(F.col("path"))
    language = F.when(F.col("kind") == "unknown", "cobol").when(F.col("kind") == "broken", "python").otherwise(F.col("language"))
    if edited:
        rows = rows.where(F.col("k") % 13 != 0)
        text = F.when((F.col("kind") == "python") & (F.col("k") % 10 == 3), F.concat(text, F.lit("\ndef added_"), F.col("k").cast("string"), F.lit("():\n    return unused_"), F.col("k").cast("string"), F.lit("()\n"))).otherwise(text)
    else:
        rows = rows.where(F.col("k") % 17 != 5)
    return _once(rows.select(F.col("k").alias("file_id"), path.alias("path"), "kind", language.alias("language"), text.alias("content")))


#: The same, with what the templates say: srcs (all states), py and js (the first state's files that parse).
SQL = f"""{ad.SQL}, srcs AS (
  SELECT k, k + 1 AS j, k % 7 AS h, n, c, kind, CASE kind WHEN 'ignored' THEN 'node_modules/' || path WHEN 'broken' THEN regexp_replace(path, '[.]ts$', '.py') ELSE path END AS path,
         CASE kind WHEN 'unknown' THEN 'cobol' WHEN 'broken' THEN 'python' ELSE language END AS language
  FROM (SELECT file_id AS k, s.name AS n, f.component AS c, f.path, f.language,
               CASE WHEN file_id % 50 = 7 THEN 'broken' WHEN file_id % 50 = 9 THEN 'unknown' WHEN file_id % 50 = 11 THEN 'ignored' WHEN f.language = 'javascript' THEN 'javascript' ELSE 'python' END AS kind
        FROM files f JOIN symbols s ON s.symbol_id = f.file_id)
), texts_of AS (
  SELECT *, replace(regexp_replace(path, '[.][^./]+$', ''), '/', '.') AS m, CASE kind WHEN 'javascript' THEN {_sql(JAVASCRIPT)} WHEN 'broken' THEN {_sql(BROKEN)} ELSE {_sql(PYTHON)} END AS content FROM srcs
), first_state AS (SELECT * FROM texts_of WHERE k % 17 <> 5
), py AS (SELECT * FROM first_state WHERE kind = 'python'), js AS (SELECT * FROM first_state WHERE kind = 'javascript'
), sym AS (
  SELECT path, m || '.list_' || n AS q, 'list_' || n AS name, 'FUNCTION' AS kind, m, 5 AS line_start, 8 AS line_end, 'Lists ' || n || '.' AS docstring, 'app.get(''/items/' || k || ''')' AS decorators, 'def list_' || n || '(limit)' AS signature, NULL AS parent FROM py
  UNION ALL SELECT path, m || '.Part' || k, 'Part' || k, 'CLASS', m, 10, 18, NULL, '', 'class Part' || k || '(B, metaclass=Meta)', NULL FROM py
  UNION ALL SELECT path, m || '.Part' || k || '.total', 'total', 'METHOD', m, 11, 14, NULL, '', 'def total(self, price)', m || '.Part' || k FROM py
  UNION ALL SELECT path, m || '.Part' || k || '.label', 'label', 'METHOD', m, 17, 18, NULL, 'property', 'def label(self)', m || '.Part' || k FROM py
  UNION ALL SELECT path, m || '.unused_' || k, 'unused_' || k, 'FUNCTION', m, 20, 22, NULL, '', 'def unused_' || k || '()', NULL FROM py
  UNION ALL SELECT path, m || '.Part' || k, 'Part' || k, 'CLASS', m, 4, 9, NULL, '', NULL, NULL FROM js
  UNION ALL SELECT path, m || '.Part' || k || '.load', 'load', 'METHOD', m, 6, 13, NULL, '', 'load(id) {{', m || '.Part' || k FROM js
  UNION ALL SELECT path, m || '.go' || k, 'go' || k, 'FUNCTION', m, 10, 13, NULL, '', NULL, NULL FROM js
  UNION ALL SELECT path, m || '.run' || k, 'run' || k, 'FUNCTION', m, 14, 17, NULL, '', NULL, NULL FROM js
  UNION ALL SELECT path, m || '.route_get_items_' || k, 'route_get_items_' || k, 'FUNCTION', m, 19, 20, NULL, '', 'router.get(''/items/' || k || ''', go' || k || ')', NULL FROM js
  UNION ALL SELECT path, m || '.test_' || n || '_works', 'test_' || n || '_works', 'FUNCTION', m, 20, 20, NULL, '', 'test(''' || n || ' works'', () => {{ run' || k || '(1) }})', NULL FROM js
), imp AS (
  SELECT path, 'json' AS module, NULL AS name, 'js' AS alias, 1 AS line_number, false AS is_from FROM py UNION ALL SELECT path, 'src.' || c, 'helper_' || h, NULL, 2, true FROM py UNION ALL SELECT path, 'src.' || c, 'Base', 'B', 2, true FROM py
  UNION ALL SELECT path, './' || c, 'api', 'call', 1, true FROM js UNION ALL SELECT path, './' || c, 'Base', NULL, 1, true FROM js UNION ALL SELECT path, './style.css', NULL, NULL, 2, false FROM js UNION ALL SELECT path, 'fs', NULL, 'fs', 3, false FROM js
), called AS (
  SELECT path, m, m || '.list_' || n AS caller, 'Part' || j AS target, 'Part' || j AS display, 'limit|size=3' AS arguments, 7 AS line_number FROM py
  UNION ALL SELECT path, m, m || '.list_' || n, 'get', 'client.get', '''https://example.com/' || n || '''|rows', 8 FROM py
  UNION ALL SELECT path, m, m || '.Part' || k || '.total', 'list', 'self.list', 'price', 13 FROM py UNION ALL SELECT path, m, m || '.Part' || k || '.total', 'eval', 'eval', '''price''', 14 FROM py
  UNION ALL SELECT path, m, m || '.Part' || k || '.total', 'dumps', 'js.dumps', 'eval(''price'')', 14 FROM py
  UNION ALL SELECT path, m, m || '.unused_' || k, 'get', 'requests.get', 'url|list_' || n || '(1)', 22 FROM py UNION ALL SELECT path, m, m || '.unused_' || k, 'list_' || n, 'list_' || n, '1', 22 FROM py
  UNION ALL SELECT path, m, m || '.Part' || k, unnest(['load', 'fetchOrders']), unnest(['load', 'fetchOrders']), '', unnest([6, 7]) FROM js
  UNION ALL SELECT path, m, m || '.Part' || k || '.load', unnest(['load', 'fetchOrders', 'async', 'helper_' || h]), unnest(['load', 'fetchOrders', 'async', 'helper_' || h]), '', unnest([6, 7, 11, 12]) FROM js
  UNION ALL SELECT path, m, m || '.go' || k, unnest(['async', 'helper_' || h]), unnest(['async', 'helper_' || h]), '', unnest([11, 12]) FROM js
  UNION ALL SELECT path, m, m || '.run' || k, 'go' || k, 'go' || k, '', 16 FROM js
  UNION ALL SELECT path, m, m || '.route_get_items_' || k, unnest(['route_get', 'test', 'run' || k]), unnest(['router.get', 'test', 'run' || k]), '', unnest([19, 20, 20]) FROM js
  UNION ALL SELECT path, m, m || '.test_' || n || '_works', unnest(['test', 'run' || k]), unnest(['test', 'run' || k]), '', 20 FROM js
), inh AS (
  SELECT path, m, m || '.Part' || k AS child, 'B' AS parent, 10 AS line_number FROM py UNION ALL SELECT path, m, m || '.Part' || k, 'metaclass=Meta', 10 FROM py
), refd AS (
  SELECT path, m, m || '.list_' || n AS source, unnest(['rows', 'Part' || j, 'limit', 'get', 'client', 'rows']) AS name, unnest([7, 7, 7, 8, 8, 8]) AS line_number FROM py
  UNION ALL SELECT path, m, m || '.Part' || k || '.total', unnest(['price', 'list', 'price', 'dumps', 'js', 'eval']), unnest([12, 13, 13, 14, 14, 14]) FROM py
  UNION ALL SELECT path, m, m || '.unused_' || k, unnest(['token', 'get', 'requests', 'url', 'list_' || n]), unnest([21, 22, 22, 22, 22]) FROM py
  UNION ALL SELECT path, m, m || '.Part' || k, 'Base', 4 FROM js
)
"""
